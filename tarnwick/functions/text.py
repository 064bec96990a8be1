"""Column expressions for cleaning, tokenising and composing text."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: strftime directives and the date patterns that mean the same.
_DIRECTIVES = {
    "Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "H": "HH", "I": "hh", "M": "mm", "S": "ss",
    "f": "SSSSSS", "p": "a", "b": "MMM", "B": "MMMM", "a": "EEE", "A": "EEEE", "j": "DDD", "z": "xx", "Z": "z",
}

TEXT_CAP = 2000


def trim(c: Column, side: str = "trim") -> Column:
    """Strip Unicode white space at both ends, or with ltrim or rtrim at one."""
    pattern = {"trim": r"(?U)^\s+|\s+$", "ltrim": r"(?U)^\s+", "rtrim": r"(?U)\s+$"}[side]
    return F.regexp_replace(c, pattern, "")


def blank_to_null(c: Column) -> Column:
    return F.nullif(trim(c), F.lit(""))


def first_truthy(*columns: Column) -> Column:
    """The first that is neither null nor blank."""
    return F.coalesce(*(blank_to_null(c) for c in columns)) if columns else F.lit(None).cast("string")


def recase(c: Column, how: str) -> Column:
    """upper, lower, or sentence: the first character upper and all others lower."""
    if how == "upper":
        return F.upper(c)
    if how == "lower":
        return F.lower(c)
    if how == "sentence":
        return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(c.substr(F.lit(2), F.length(c))))
    raise ValueError(f"unknown case option {how!r}")


def date_pattern(strftime: str) -> str:
    """A strftime format as a datetime pattern."""
    out, quoted, i = [], "", 0
    while i < len(strftime):
        if strftime[i] == "%" and i + 1 < len(strftime):
            name = strftime[i + 1]
            if name != "%" and name not in _DIRECTIVES:
                raise ValueError(f"unsupported directive %{name}")
            if name == "%":
                quoted += "%"
            else:
                out += [f"'{quoted}'"] if quoted else []
                quoted = ""
                out.append(_DIRECTIVES[name])
            i += 2
        else:
            if strftime[i].isalpha():
                quoted += strftime[i]
            else:
                out += [f"'{quoted}'"] if quoted else []
                quoted = ""
                out.append("''" if strftime[i] == "'" else strftime[i])
            i += 1
    return "".join([*out, *([f"'{quoted}'"] if quoted else [])])


def reformat_date(c: Column, source: str, target: str) -> Column:
    """Parse with one strftime format and write with another; what doesn't parse is null."""
    return F.date_format(F.try_to_timestamp(c, F.lit(date_pattern(source))), date_pattern(target))


def identifier(c: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one underscore, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")


#: A token: from the first letter or digit of a run to its last, with dots between.
TOKEN = "[a-z0-9](?:[a-z0-9.]*[a-z0-9])?"


def tokens(c: Column) -> Column:
    """Lower-case runs of a-z, 0-9 and dots, without dots at their ends; empty ones dropped. Null gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN), F.lit(0))


def collapse(c: Column) -> Column:
    return F.regexp_replace(trim(c), r"(?U)\s+", " ")


def vendor_signature(vendor: Column, name: Column, product_id: Column) -> Column:
    """The key under which decisions on like-named products of a vendor are counted."""
    named = F.coalesce(F.nullif(name, F.lit("")), product_id)
    return F.concat(F.lower(trim(vendor)), F.lit("::"), collapse(F.lower(named)))


def query_text(name: Column, description: Column, product_id: Column) -> Column:
    joined = trim(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(description, F.lit(""))))
    return F.coalesce(F.nullif(joined, F.lit("")), product_id)


def capped(c: Column, cap: int = TEXT_CAP) -> Column:
    """At most cap characters, the last three replaced by an ellipsis where text was cut."""
    return F.when(F.length(c) > cap, F.concat(F.substring(c, 1, cap - 3), F.lit("…"))).otherwise(c)


def dense_text(label: Column, definition: Column, with_text: bool = False) -> Column:
    return trim(F.concat_ws(" ", label, blank_to_null(definition))) if with_text else label


def lexical_text(label: Column, alt_labels: Column, definition: Column, signals: Sequence[Column] = (), with_text: bool = False, with_signals: bool = False) -> Column:
    """The document that lexical ranking indexes; signal fields join only together with the texts, each once."""
    if not with_text:
        return label
    alternatives = capped(F.concat_ws(" ", F.coalesce(alt_labels, F.array().cast("array<string>"))))
    parts = [label, blank_to_null(alternatives), blank_to_null(definition)]
    if with_signals:
        parts.append(blank_to_null(F.concat_ws(" ", F.array_distinct(F.array_compact(F.array(*(blank_to_null(s) for s in signals)))))))
    return F.concat_ws(" ", *parts)


def definition(*parts: Column) -> Column:
    """The parts that are not blank, joined by bars and capped."""
    return capped(F.concat_ws(" | ", *(blank_to_null(p) for p in parts)))


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.nanvl(F.coalesce(c.cast("double"), F.lit(0.0)), F.lit(0.0))))


def map_value(m: Column, keys: Sequence[str]) -> Column:
    """The value of the first key with one that is not blank."""
    return first_truthy(*(F.try_element_at(m, F.lit(k)) for k in keys))


def data_class(raw: Column) -> Column:
    return F.lower(map_value(raw, ("data_class", "dataClass", "asset_class", "assetClass")))


def bare_identifier(name: Column) -> Column:
    """Whether a name reads as a code: all tokens upper case or digits, and a digit, a separator or a second token."""
    parts = F.filter(F.split(name, r"[ \-_./]+"), lambda t: t != "")
    coded = F.forall(parts, lambda t: ((F.upper(t) == t) & (F.lower(t) != t)) | t.rlike(r"^\p{Nd}+$"))
    marked = name.rlike(r"\p{Nd}") | name.rlike(r"[\-_./]") | (F.size(parts) > 1)
    return F.coalesce((F.size(parts) > 0) & coded & marked, F.lit(False))


def contains_any(needle: Column | str, *columns: Column) -> Column:
    """Case-insensitive substring search in any of the columns; a null column doesn't match."""
    wanted = F.lower(F.lit(needle) if isinstance(needle, str) else needle)
    found = F.lit(False)
    for c in columns:
        found = found | F.contains(F.lower(F.coalesce(c, F.lit(""))), wanted)
    return found


def json_or(c: Column, schema: str, default: Column) -> Column:
    """The parsed JSON, or the default where it is missing, null or broken."""
    return F.coalesce(F.from_json(c, schema, {"mode": "PERMISSIVE"}), default)


def required(c: Column, name: str) -> Column:
    """The value; a null one raises an error that names the column."""
    return F.when(c.isNull(), F.raise_error(F.lit(f"required column {name} is null"))).otherwise(c)


def merged_map(first: Column, second: Column) -> Column:
    """Both maps; on a common key the first one's value holds."""
    rest = F.map_filter(second, lambda k, v: ~F.map_contains_key(first, k))
    return F.map_concat(first, rest)


def drift_map(columns: Mapping[str, Column], typed: Sequence[str]) -> Column:
    """Columns outside typed that have a value, as a map to strings."""
    extra = {k: v for k, v in columns.items() if k.lower() not in {t.lower() for t in typed}}
    if not extra:
        return F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    made = F.map_from_arrays(F.array(*(F.lit(k) for k in extra)), F.array(*(v.cast("string") for v in extra.values())))
    return F.map_filter(made, lambda k, v: v.isNotNull())


def iri_kind(iri: Column, prefix: str = ":") -> Column:
    return F.when(F.contains(iri, F.lit(f"{prefix}domain:")), "domain").when(F.contains(iri, F.lit(f"{prefix}subdomain:")), "subdomain").otherwise("concept")


def whitelisted(fields: Column, raw: Column) -> Column:
    """Of an array of structs with a name, those whose name is a key of the raw row."""
    return F.filter(fields, lambda f: F.map_contains_key(raw, f["name"]))


#: Logical types that a proposed field may have.
DATA_TYPES = ("string", "date", "decimal", "integer", "boolean")


def proposed_fields(text: Column, raw: Column) -> Column:
    """Fields proposed as a JSON array, held to what the raw row has: name, label, data_type, primary_key, nullable and sequence_number.

    Elements that are no objects, or whose vendor_field_name is missing or no key of raw, go.
    An unknown type is string, a key only what is true itself, and a nullable or sequence
    number of another JSON type null. Text that is no array gives null.
    """
    def typed(v: Column, name: str, json_type: str, sql_type: str) -> Column:
        inner = F.try_variant_get(v, f"$.{name}", "variant")
        return F.when(F.schema_of_variant(inner) == json_type, F.try_variant_get(v, f"$.{name}", sql_type))

    def field(v: Column) -> Column:
        get = lambda name: F.try_variant_get(v, f"$.{name}", "string")
        kind = F.lower(F.trim(get("data_type")))
        return F.struct(
            get("vendor_field_name").alias("name"),
            F.coalesce(F.nullif(get("label"), F.lit("")), get("vendor_field_name")).alias("label"),
            F.when(kind.isin(*DATA_TYPES), kind).otherwise("string").alias("data_type"),
            F.coalesce(typed(v, "primary_key", "BOOLEAN", "boolean"), F.lit(False)).alias("primary_key"),
            typed(v, "nullable", "BOOLEAN", "boolean").alias("nullable"),
            typed(v, "sequence_number", "BIGINT", "bigint").alias("sequence_number"),
        )

    listed = F.when(F.startswith(F.trim(text), F.lit("[")), F.from_json(text, "array<variant>"))
    return F.filter(F.transform(listed, field), lambda f: f["name"].isNotNull() & F.map_contains_key(raw, f["name"]))
