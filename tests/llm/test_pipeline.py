import hashlib
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from tarnwick.llm import bpe, mixing, simhash, toxicity
from tarnwick.llm.queries import tokenizer_path, toxicity_weights
from tarnwick.runtime import batched


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "simhash", "mixing", "bpe"]


def test_pipeline_against_plain_steps(spark, sf_dir):
    from tokenizers import Tokenizer

    from .test_dedup import brute_near

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    weights = toxicity_weights(spark, sf_dir)
    rows = [r for r in docs.collect() if toxicity.sigmoid(sum(weights.get(int(i), 0.0) for i in toxicity.features(r.text))) < toxicity.THRESHOLD]
    largest = {}
    for r in rows:
        largest[r.text or ""] = max(r.doc_id, largest.get(r.text or "", -1))
    rows = [r for r in rows if largest[r.text or ""] == r.doc_id]
    component, _ = brute_near({r.doc_id: r.text for r in rows})
    rows = [r for r in rows if component[r.doc_id] == r.doc_id]
    drawn = Counter({r.doc_id: r.copies for r in mixing.draws(spark.createDataFrame(rows, docs.schema)).collect() if r.copies})
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert Counter(r.doc_id for r in got) == drawn
    library, texts = Tokenizer.from_file(tokenizer_path()), {r.doc_id: r.text for r in rows}
    for r in got[:50]:
        ids = np.array(library.encode(texts[r.doc_id], add_special_tokens=False).ids, "<u4").tobytes()
        assert r.ids_sha256 == hashlib.sha256(ids).hexdigest()


def test_stages_on_odd_rows(spark, odd, empty, sf_dir):
    for docs in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf_dir)
            if name != "bpe":
                assert out.columns == docs.columns
            docs = out.cache()
            docs.count()
    assert simhash.RADIUS == 3


def test_workers_let_go_of_the_codec_in_stages_that_need_none():
    batch, ran = pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["some words of a text"]}), []
    rows = SimpleNamespace(columns=["doc_id", "text"], mapInArrow=lambda run, schema: ran.extend(run([batch])), schema={"doc_id": SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "bigint"))})
    rows.selectExpr = lambda *names: rows
    rows.sparkSession = SimpleNamespace(sparkContext=SimpleNamespace(broadcast=lambda value: SimpleNamespace(value=value)))
    for stage in (simhash.sketches, lambda docs: toxicity.reject(docs, {0: -1.0})):
        bpe.codec(tokenizer_path())
        stage(rows)
        assert bpe.codec.cache_info().currsize == 0
    assert [b.num_rows for b in ran] == [1, 1]


def test_wide_rows_go_to_python_in_batches_of_bounded_size(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    wide = spark.range(0, 64, 1, 1).select(F.repeat(F.lit("x"), 1 << 20).alias("x"))
    with batched(spark):
        found = [r.n for r in wide.mapInArrow(sizes, "n bigint").collect()]
    assert sum(found) == 64 and max(found) <= 5
    assert [r.n for r in wide.mapInArrow(sizes, "n bigint").collect()] != found
