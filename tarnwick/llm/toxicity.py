"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the set of a text's lower-cased words, word pairs, and pairs with one or two
words between, and the first bytes of every longer word (as many as in PREFIXES), which also
tell of words never met before, all hashed to DIMENSIONS slots. Texts and words of any
length are taken whole, in batches of BATCH characters. Training takes at most train_rows labelled rows (those with the smallest
hash of their id, so the sample does not depend on the order of the table). It runs over
them epochs times in a fixed order: each coordinate has its own learning rate, and the L1
term keeps a weight at exactly zero until its evidence outgrows it. The model is the list
of weights that are not zero.

Each step of the method needs the weights of the step before, so one task trains. What it
holds and how long it takes is bounded by train_rows and DIMENSIONS, whatever the size of
the tables; features are computed before it and scores after it in as many tasks as there
is data for. The slots of a row travel and are kept as the gaps between them, in about a
byte each.

Only the text is an input of a score. Defined cases: null and empty texts score like a
text without features, by the bias; without training rows, or with one label only, scores
follow from that (0.5 without rows). Rows with a null label or id are not trained on. A
label given twice counts twice. Other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bpe import pieces, release

DIMENSIONS = 1 << 18
TRAIN_ROWS, EPOCHS = 40_000, 5
ALPHA, BETA, L1, L2 = 1.0, 1.0, 15.0, 0.0
#: How much a row of label 1 counts, against one of label 0.
POSITIVE = 5.0
THRESHOLD = 0.7
#: Lengths of the beginnings of longer words, in bytes of UTF-8, and what tells one from a word.
PREFIXES, PREFIX_SALT = (4, 5, 6, 7), 0x51ED270B
WORD = re.compile(r"[^\W\d_]+")
#: A word's code is the sum of its bytes times the powers of this odd number, modulo 2**64.
BASE = 0x5851F42D4C957F2D
#: Characters of words looked at together; tables of powers are for a few times as many bytes.
BATCH = 1 << 17
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers_of(n: int) -> list[np.ndarray]:
    """The first powers of BASE and of its inverse, n at least."""
    if len(_powers[0]) < n:
        for k, base in enumerate((BASE, pow(BASE, -1, 1 << 64))):
            table = np.full(2 * n, base, np.uint64)
            table[0] = 1
            _powers[k] = np.multiply.accumulate(table)
    return _powers


def codes(words: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """The codes of words, and those of the beginnings of longer ones. Tables grow with the length of all words together."""
    if len(words) == 1 and len(words[0]) > BATCH:
        return _long_code(words[0].encode())
    data = np.frombuffer(" ".join(words).encode() + b" ", np.uint8)
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate([[0], ends[:-1] + 1])
    up, down = _powers_of(len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(data * up[: len(data)])])
    begun = []
    for k in PREFIXES:
        longer = starts[ends - starts > k]
        begun.append((sums[longer + k] - sums[longer]) * down[longer] ^ np.uint64(PREFIX_SALT))
    return (sums[ends] - sums[starts]) * down[starts], begun


def _long_code(data: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    """The same of one long word, block by block."""
    total = 0
    for i in range(0, len(data), BATCH):
        part = np.frombuffer(data, np.uint8, min(BATCH, len(data) - i), i)
        total += int((part * _powers_of(len(part))[0][: len(part)]).sum(dtype=np.uint64)) * pow(BASE, i, 1 << 64)
    begun = [np.array([sum(c * pow(BASE, j, 1 << 64) for j, c in enumerate(data[:k])) % (1 << 64)], np.uint64) ^ np.uint64(PREFIX_SALT) for k in PREFIXES if len(data) > k]
    return np.array([total % (1 << 64)], np.uint64), begun


def batches(text: str) -> Iterator[list[str]]:
    """The words of a text in order, BATCH characters or a little more at a time; a word above that is alone."""
    if len(text) <= BATCH:
        if words := WORD.findall(text):
            yield words
        return
    held, size = [], 0
    for match in WORD.finditer(text):
        n = match.end() - match.start()
        if held and size + n > BATCH:
            yield held
            held, size = [], 0
        held.append(match[0])
        size += n + 1
    if held:
        yield held


def features(text: str | None) -> np.ndarray:
    """The slots of a text, each once, in order; slot 0 is the bias. What it holds besides the text is bounded."""
    found, last = np.zeros(1, np.int64), np.zeros(0, np.uint64)
    for words in batches((text or "").lower()):
        h, begun = codes(words)
        run = np.concatenate([last, h])  # pairs whose second word is in this batch
        pairs = []
        for gap in (1, 2, 3):
            begin = max(0, len(last) - gap)
            pairs.append((run[begin : max(begin, len(run) - gap)] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(gap)) ^ (run[begin + gap :] * np.uint64(0x165667B19E3779F9)))
        mixed = np.concatenate([h, *begun, *pairs])
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        slots = (mixed >> np.uint64(40)) % np.uint64(DIMENSIONS - 1) + np.uint64(1)
        found = np.union1d(found, slots.astype(np.int64)) if len(last) else np.concatenate([found, np.unique(slots.astype(np.int64))])
        last = run[-3:]
    return found


def pack(slots: np.ndarray) -> bytes:
    """Slots in order as the gaps before them: a byte 255 for each whole 255 of a gap, then a byte for the rest."""
    whole, rest = np.divmod(np.diff(slots, prepend=0), 255)
    ends = (whole + 1).cumsum()
    out = np.full(int(ends[-1]) if len(ends) else 0, 255, np.uint8)
    out[ends - 1] = rest
    return out.tobytes()


def unpack(packed) -> np.ndarray:
    """The slots of pack(), from bytes or a buffer."""
    gaps = np.frombuffer(packed, np.uint8)
    return gaps.cumsum(dtype=np.int64)[gaps < 255]


class Ftrl:
    """Per-coordinate FTRL-proximal for logistic loss over binary features."""

    def __init__(self):
        self.z, self.n = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS)

    def weights(self, slots) -> np.ndarray:
        z, n = self.z[slots], self.n[slots]
        rate = (BETA + np.sqrt(n)) / ALPHA + L2
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / rate)

    def learn(self, slots: np.ndarray, label: int) -> None:
        w = self.weights(slots)
        g = (sigmoid(w.sum()) - label) * (POSITIVE if label else 1.0)
        n = self.n[slots]
        self.z[slots] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[slots] = n + g * g


def sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -35, 35))))


def train(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", train_rows: int = TRAIN_ROWS, epochs: int = EPOCHS) -> dict[int, float]:
    """Weights by slot, learnt from the labelled rows for which usable (over the column doc_id) holds, train_rows at most."""
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isNotNull() & F.col("doc_id").isNotNull() & usable)
    order = F.xxhash64(F.lit(7), F.col("doc_id"))
    sample = marked.orderBy(order, "doc_id", "label").limit(train_rows)  # bounded, so it may be broadcast
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")

    def featurised(batches):
        release()
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("label"), pa.array([pack(features(t)) for t in texts], pa.binary())], ["doc_id", "label", "slots"])

    def fitted(batches):
        model, held, at = Ftrl(), [], []  # the sample stays in the batches' own buffers
        for batch in batches:
            at += [(len(held), i, label) for i, label in enumerate(batch.column("label").to_pylist())]
            held.append(batch.column("slots"))
        for epoch in range(epochs):
            for k in np.random.default_rng(epoch).permutation(len(at)).tolist():
                part, i, label = at[k]
                model.learn(unpack(held[part][i].as_buffer()), label)
        w = model.weights(slice(None))
        used = np.flatnonzero(w)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(w[used])], ["slot", "weight"])

    made = rows.mapInArrow(featurised, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, label int, slots binary")
    ordered = made.repartition(1).sortWithinPartitions(F.xxhash64(F.lit(11), "doc_id"), "doc_id", "label", "slots")
    return {r["slot"]: r["weight"] for r in ordered.mapInArrow(fitted, "slot bigint, weight double").collect()}


def score(docs: DataFrame, weights: dict[int, float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score and predicted of each row."""
    dense = np.zeros(DIMENSIONS, np.float32)
    dense[list(weights)] = list(weights.values())
    model = docs.sparkSession.sparkContext.broadcast(dense)  # DIMENSIONS floats

    def run(batches):
        w = model.value
        for batch in batches:
            for part, texts in pieces(batch, "text"):
                scores = [sigmoid(float(w[features(t)].sum(dtype=np.float64))) for t in texts]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())], ["doc_id", "score", "predicted"])

    rows = docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text_col}` AS text")
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, score double, predicted int")


def reject(docs: DataFrame, weights: dict[int, float], text_col: str = "text") -> DataFrame:
    """The rows of docs that are not predicted toxic, with their columns as they were."""
    dense = np.zeros(DIMENSIONS, np.float32)
    dense[list(weights)] = list(weights.values())
    model = docs.sparkSession.sparkContext.broadcast(dense)
    at = docs.columns.index(text_col)

    def run(batches):
        release()
        w = model.value
        for batch in batches:
            named = batch.rename_columns([f"c{i}" for i in range(batch.num_columns)])
            for part, texts in pieces(named, f"c{at}"):
                keep = [sigmoid(float(w[features(t)].sum(dtype=np.float64))) < THRESHOLD for t in texts]
                yield part.filter(pa.array(keep, pa.bool_())).rename_columns(batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1
