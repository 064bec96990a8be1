"""Column aliases from CSVW metadata. Its size is that of a header, so this is plain Python.

Every column of a table description gives (label, key) pairs: the key that the column
names itself or that its property stands for, or none. Labels without a key are looked up
in an index of hints, first by equality, then by containment either way.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from .readers import ALIASES

#: Labels that point to a canonical column.
HINTS = {
    "product_id": ("product_id", "productid", "product id", "ticker", "symbol", "sku", "id"),
    "name": ("name", "title", "product_name", "product name", "label"),
    "description": ("description", "desc", "summary", "details"),
}
#: Properties that stand for a canonical column, by the last part of their identifier.
PROPERTIES = {"identifier": "product_id", "title": "name", "longName": "name", "abstract": "description", "description": "description", "featuresAndBenefitsDescription": "description"}


def _plain(label: str) -> str:
    return " ".join(label.replace("_", " ").lower().split())


def _texts(value) -> Iterator[str]:
    """The strings of a CSVW natural-language property: a string, a list, or a map by language."""
    if isinstance(value, str):
        yield from [value.strip()] if value.strip() else []
    elif isinstance(value, Mapping):
        for inner in value.values():
            yield from _texts(inner)
    elif isinstance(value, (list, tuple)):
        for inner in value:
            yield from _texts(inner)


def _of(node: Mapping, name: str):
    return node.get(name, node.get(f"csvw:{name}"))


def pairs(document: Mapping, keys=tuple(HINTS)) -> Iterator[tuple[int, str, str | None]]:
    """Column number, label and the key that the column itself names."""
    schema = _of(document, "tableSchema")
    columns = _of(schema, "columns") if isinstance(schema, Mapping) else None
    for number, column in enumerate([columns] if isinstance(columns, Mapping) else columns or []):
        own = column.get("canonical")
        tail = str(_of(column, "propertyUrl") or "").replace("#", "/").replace(":", "/").rsplit("/", 1)[-1]
        key = own if own in keys else PROPERTIES.get(tail)
        for label in [*_texts(_of(column, "name")), *_texts(_of(column, "titles"))]:
            yield number, label, key


def resolve(label: str, hints: Mapping[str, tuple[str, ...]] = HINTS) -> tuple[int, str] | None:
    """How well a label is known (0: equal to a hint, 1: contains one or lies in one), and its key."""
    index = {_plain(hint): key for key, own in reversed(hints.items()) for hint in own}
    plain = _plain(label)
    if plain in index:
        return 0, index[plain]
    near = [key for key in hints if any(_plain(h) in plain or plain in _plain(h) for h in hints[key])]
    return (1, near[0]) if near else None


def aliases(document: Mapping, base: Mapping[str, tuple[str, ...]] = ALIASES) -> dict[str, tuple[str, ...]]:
    """The base aliases extended by the labels of the document's columns, in lower case."""
    by_column: dict[int, list[tuple[str, str | None]]] = {}
    for number, label, key in pairs(document, tuple(base)):
        by_column.setdefault(number, []).append((label, key))
    more: dict[str, dict[str, None]] = {}
    for found in by_column.values():
        known = [(0, key) for _, key in found if key] or sorted(filter(None, (resolve(label) for label, _ in found)), key=lambda x: x[0])
        if known:
            more.setdefault(known[0][1], {}).update(dict.fromkeys(label.lower() for label, _ in found))
    return {key: tuple(dict.fromkeys([*own, *more.get(key, ())])) for key, own in base.items()}
