"""N-Triples and a subset of Turtle as quads: subject, predicate, object, object_is_iri, graph.

Turtle: prefixes and base, a for the type, semicolon and comma lists, literals with
language or datatype, long strings, numbers and booleans, comments. Blank-node property
lists and collections are not read and raise an error.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

QUADS = "subject string, predicate string, object string, object_is_iri boolean, graph string"
TYPE = "http://www.w3.org/1999/02/22-rdf-syntax-ns#type"
SUFFIXES = (".ttl", ".nt", ".n3")
_TOKEN = re.compile(
    r'''\s+|\#[^\n]*|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<long>"""(?:[^"\\]|\\.|"(?!""))*""")|(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<lang>@[A-Za-z][A-Za-z0-9-]*)|(?P<type>\^\^)|(?P<number>[+-]?(?:\d+\.\d+|\d+)(?:[eE][+-]?\d+)?)|(?P<mark>[.;,\[\]()])|(?P<name>[A-Za-z_][\w.-]*(?<!\.))?(?P<local>:(?:[\w%-][\w.%:-]*(?<![.]))?)?''',
    re.S,
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f"}


def _literal(raw: str) -> str:
    body = raw[3:-3] if raw.startswith('"""') else raw[1:-1]
    return re.sub(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.)", lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else _ESCAPES.get(m[1], m[1]), body, flags=re.S)


def _tokens(text: str) -> Iterator[tuple[str, str]]:
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise ValueError(f"unexpected {text[at : at + 20]!r} at {at}")
        at = m.end()
        if m["name"] or m["local"]:
            yield ("pname", m[0]) if m["local"] else ("word", m["name"])
        elif m.lastgroup:
            yield m.lastgroup, m[0]


def parse(text: str) -> Iterator[tuple[str, str, str, bool]]:
    """Triples of a document, in its order."""
    prefixes, base = {}, ""
    stream = list(_tokens(text))
    i = 0

    def iri(kind: str, raw: str) -> str:
        if kind == "iri":
            return raw[1:-1] if ":" in raw or not base else base + raw[1:-1]
        if kind == "pname":
            prefix, _, local = raw.partition(":")
            if prefix == "_":
                return raw
            if prefix not in prefixes:
                raise ValueError(f"unknown prefix {prefix!r}")
            return prefixes[prefix] + local
        raise ValueError(f"expected an IRI, found {raw!r}")

    def expect(mark: str) -> None:
        nonlocal i
        if i >= len(stream) or stream[i][1] != mark:
            raise ValueError(f"expected {mark!r}")
        i += 1

    while i < len(stream):
        kind, raw = stream[i]
        directive = raw.lstrip("@").lower() if kind in ("lang", "word") else ""
        if directive == "prefix":
            prefixes[stream[i + 1][1].rstrip(":")] = iri(*stream[i + 2])
            i += 3
            if kind == "lang":
                expect(".")
            continue
        if directive == "base":
            base = stream[i + 1][1][1:-1]
            i += 2
            if kind == "lang":
                expect(".")
            continue
        subject = iri(kind, raw)
        i += 1
        while True:
            kind, raw = stream[i]
            predicate = TYPE if (kind, raw) == ("word", "a") else iri(kind, raw)
            i += 1
            while True:
                kind, raw = stream[i]
                i += 1
                if kind in ("iri", "pname"):
                    yield subject, predicate, iri(kind, raw), True
                elif kind in ("text", "long"):
                    if i < len(stream) and stream[i][0] == "lang":
                        i += 1
                    elif i < len(stream) and stream[i][0] == "type":
                        i += 2
                    yield subject, predicate, _literal(raw), False
                elif kind == "number" or raw in ("true", "false"):
                    yield subject, predicate, raw, False
                else:
                    raise ValueError(f"unsupported {raw!r}")
                if i < len(stream) and stream[i][1] == ",":
                    i += 1
                    continue
                break
            while i < len(stream) and stream[i][1] == ";":
                i += 1
                more = True
            else:
                more = stream[i - 1][1] == ";"
            if not more or stream[i][1] == ".":
                break
        expect(".")


def read(spark: SparkSession, path: str, graph: str = "default") -> DataFrame:
    """Quads of the files under path. A Turtle file has prefixes and is read as a whole, N-Triples line by line."""
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            found = [t for text in batch.column("value").to_pylist() for t in parse(text)]
            columns = [pa.array([t[k] for t in found], pa.string() if k < 3 else pa.bool_()) for k in range(4)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([graph] * len(found), pa.string())], ["subject", "predicate", "object", "object_is_iri", "graph"])

    files = spark.read.text(path, wholetext=not path.lower().endswith(".nt"))
    return files.mapInArrow(run, QUADS)
