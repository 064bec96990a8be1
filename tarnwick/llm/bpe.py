"""BPE encoding and decoding with forced-boundary splitting.

A pair of adjacent bytes that occurs inside no vocabulary token can't be spanned by any
token, so a cut between the two is certain. White space occurs in no token at all, and
the tokenizer's own pattern never matches it, so every run of ASCII white space is such a
cut even before normalisation and pattern. The fragments between are encoded
independently and their ids concatenated. A fragment met before comes from a bounded
cache. New ones are normalised and split into words by the tokenizer's own rules, cut
again at forced byte pairs, and the parts go to a byte-pair merge engine that is given
the vocabulary's merge ranks; no state crosses a cut. The engine's steps grow with the
square of a part, so parts of over LONG bytes are merged by merge(), in n log n steps.

Defined cases: null and empty texts have no ids and decode to the empty text. Special
tokens' strings inside a text become their ids, as the tokenizer's encode() does. Rows
are handled one by one, so repeats, ties and long texts need nothing of their own.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import itertools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Entries of the cache; when it is full the first quarter stays, which changes no result.
CACHE = 400_000
#: In the merge engine's input: the end of a word and a forced cut. White space is in no word.
END, CUT = "\n", "\r"
#: Parts of more bytes are merged by merge().
LONG = 500
#: Letters of ASCII and Latin-1, which normalisation only lower-cases, then ASCII signs without the apostrophe.
PLAIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]*)([!-&(-/:-@\[-`{-~]*)")


def byte_letters() -> dict[int, str]:
    """The letter by which byte-level vocabularies write each byte: itself if it prints, else one from U+0100 on."""
    printed = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(printed)]
    return {b: chr(b) for b in printed} | {b: chr(0x100 + i) for i, b in enumerate(rest)}


def merge(part: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ranks of the tokens of one part: the pair of lowest rank is joined first, the leftmost of equals.

    The last byte and the END after it are one symbol from the start.
    """
    cut = len(part) - 1 - part.endswith(END.encode())
    starts = [*range(cut + 1), len(part)]  # symbol i spans starts[i] to that of its successor
    after, before = list(range(1, len(starts))), list(range(-1, len(starts) - 2))
    alive = [True] * (cut + 1)

    def token(i: int, j: int) -> bytes:
        return part[starts[i] : starts[after[j]]]

    pairs = []
    for i in range(cut):
        if (rank := ranks.get(token(i, i + 1))) is not None:
            pairs.append((rank, i, i + 1, starts[after[i + 1]]))
    heapq.heapify(pairs)
    while pairs:
        _, i, j, end = heapq.heappop(pairs)
        if not (alive[i] and alive[j]) or after[i] != j or starts[after[j]] != end:
            continue
        alive[j] = False
        after[i] = after[j]
        if after[i] <= cut:
            before[after[i]] = i
            if (rank := ranks.get(token(i, after[i]))) is not None:
                heapq.heappush(pairs, (rank, i, after[i], starts[after[after[i]]]))
        if before[i] >= 0 and (rank := ranks.get(token(before[i], i))) is not None:
            heapq.heappush(pairs, (rank, before[i], i, starts[after[i]]))
    return [ranks[token(i, i)] for i in range(cut + 1) if alive[i]]


class Codec:
    """Encoder and decoder for a tokenizers JSON file of kind BPE, byte level, with word ends."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        if model["type"] != "BPE" or model["unk_token"] or model["byte_fallback"] or spec.get("decoder") or not suffix:
            raise ValueError("only byte-level BPE with word ends and without a decoder is supported")
        as_byte = {letter: byte for byte, letter in byte_letters().items()}

        def spelled(token: str) -> bytes:
            ends = token.endswith(suffix)
            return bytes(as_byte[c] for c in token[: -len(suffix) if ends else None]) + END.encode() * ends

        ids = {spelled(k): v for k, v in model["vocab"].items()}
        merges = [spelled(a) + spelled(b) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        #: The engine's ranks: single bytes, then a byte with its word end, then the merges in their order.
        order = dict.fromkeys([*(bytes([i]) for i in range(256)), *(bytes([i]) + END.encode() for i in range(256)), *merges])
        self.ranks = ranks = {t: i for i, t in enumerate(order)}
        self.engine = tiktoken.Encoding("words", pat_str=r"[^\n\r]+\n?|[\n\r]", mergeable_ranks=ranks, special_tokens={})
        self.id_of = np.array([ids.get(t, 0) for t in ranks], "<u4")
        self.ends = np.array([t.endswith(END.encode()) for t in ranks])
        self.cut = ranks[CUT.encode()]
        #: Pairs of bytes found inside some token, and those with a mark; all others are forced cuts.
        self.joined = np.zeros((256, 256), bool)
        for t in ranks:
            pair = np.frombuffer(t, np.uint8)
            self.joined[pair[:-1], pair[1:]] = True
        for mark in (END, CUT):
            self.joined[ord(mark)] = self.joined[:, ord(mark)] = True
        self.special = {a["content"].encode(): a["id"] for a in spec["added_tokens"]}
        names = {v: k for k, v in model["vocab"].items()} | {v: k.decode() for k, v in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.specials = re.compile(b"(" + b"|".join(map(re.escape, self.special)) + b")")
        self.known: dict[bytes, bytes] = {k: np.array([v], "<u4").tobytes() for k, v in self.special.items()}

    def words(self, fragment: str) -> list[str]:
        """The words of a fragment as the tokenizer normalises and splits it."""
        if plain := PLAIN.fullmatch(fragment):
            return [w for w in (plain[1].lower(), plain[2]) if w]
        text = self.tokenizer.normalizer.normalize_str(fragment)
        return [text[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def learn(self, fragments: list[bytes]) -> None:
        """Encode fragments without ASCII white space into the cache, all in one call of the engine."""
        words, lasts = [], []
        for raw in fragments:
            if raw.isalpha():  # letters of ASCII
                words.append(raw.lower().decode())
            else:
                words += self.words(raw.decode())
            lasts.append(len(words))
        if not words:
            self.known.update(dict.fromkeys(fragments, b""))
            return
        data = np.frombuffer((END.join(words) + END).encode(), np.uint8)
        forced = np.flatnonzero(~self.joined[data[:-1], data[1:]] & (data[1:] & 0xC0 != 0x80)) + 1  # between characters
        marked = np.insert(data, forced, ord(CUT))
        bounds = np.flatnonzero((marked == ord(END)) | (marked == ord(CUT)))
        long = np.flatnonzero(np.diff(bounds, prepend=-1) > LONG)
        if len(long):
            ids = self._with_long(marked.tobytes(), bounds.tolist(), long.tolist())
        else:
            ids = np.array(self.engine.encode_ordinary(marked.tobytes().decode("utf-8")), np.int64)
        ids = ids[ids != self.cut]
        stops = np.concatenate([[0], (np.flatnonzero(self.ends[ids]) + 1) * 4])
        out, start = self.id_of[ids].tobytes(), 0
        for raw, stop in zip(fragments, stops[lasts].tolist()):
            self.known[raw], start = out[start:stop], stop

    def _with_long(self, marked: bytes, bounds: list[int], long: list[int]) -> np.ndarray:
        """Ranks of the marked words, where the parts that end at the long bounds go to merge()."""
        ids, at = [], 0
        for k in long:
            start, stop = bounds[k - 1] + 1 if k else 0, bounds[k]
            ids += self.engine.encode_ordinary(marked[at:start].decode("utf-8"))
            at = stop + (marked[stop : stop + 1] == END.encode())
            ids += merge(marked[start:at], self.ranks)
        return np.array(ids + self.engine.encode_ordinary(marked[at:].decode("utf-8")), np.int64)

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as little-endian unsigned 32-bit integers."""
        flat, stops = [], []
        for text in texts:
            flat += self.fragments((text or "").encode())
            stops.append(len(flat))
        if len(self.known) > CACHE:  # those met first are mostly those met often
            self.known = dict(itertools.islice(self.known.items(), CACHE // 4))
        known = self.known
        found = list(map(known.get, flat))
        new = [i for i, ids in enumerate(found) if ids is None]
        missing = list({flat[i] for i in new})
        for i in range(0, len(missing), 1 << 17):
            self.learn(missing[i : i + (1 << 17)])
        for i in new:
            found[i] = known[flat[i]]
        return [b"".join(found[start:stop]) for start, stop in zip([0, *stops], stops)]

    def fragments(self, data: bytes) -> list[bytes]:
        """Cut at ASCII white space (x20, x09 to x0D), and around the special tokens' strings."""
        if not any(s in data for s in self.special):
            return data.split()
        return [x for i, p in enumerate(self.specials.split(data)) for x in ([p] if i % 2 else p.split())]

    def encode(self, text: str | None) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        """The text of ids; without a decoder the tokens' names are joined by one space."""
        return " ".join(map(self.names.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.cache
def codec(path: str) -> Codec:
    """One codec per worker process."""
    return Codec(path)


def release() -> None:
    """Let go of the codec and its cache, which a worker process otherwise keeps through stages that need none."""
    codec.cache_clear()


def pieces(batch: pa.RecordBatch, column: str, limit: int = 1 << 22) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Parts of a batch with at most about limit bytes of text each, with their texts.

    What a worker holds at a time follows from limit and the longest text, not from the
    rows of a batch.
    """
    texts = batch.column(column)
    sizes = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).cumsum()
    start = 0
    while start < batch.num_rows:
        base = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, base + limit, "right")))
        yield batch.slice(start, end - start), texts.slice(start, end - start).to_pylist()
        start = end


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (binary, little-endian uint32) of each row."""
    def run(batches):
        c = codec(tokenizer)
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(c.encode_all(texts), pa.binary())], ["doc_id", "ids"])

    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids and text from rows of encode()."""
    def run(batches):
        c = codec(tokenizer)
        for batch in batches:
            ids = batch.column("ids")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array([c.decode(x) for x in ids.to_pylist()], pa.string())], ["doc_id", "ids", "text"])

    return encoded.mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, ids binary, text string")


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256, encoded and decoded in one pass."""
    def run(batches):
        c, digest = codec(tokenizer), lambda b: hashlib.sha256(b).hexdigest()
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                n, a, b = [], [], []
                for ids in c.encode_all(texts):
                    n.append(len(ids) // 4)
                    a.append(digest(ids))
                    b.append(digest(c.decode(ids).encode()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
