import datetime
import re
import uuid

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwick.functions import identity, similarity, temporal
from tarnwick.functions import text as tx


def one(spark, column, **values):
    frame = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return frame.select(column.alias("x")).first().x


def test_trim_and_case(spark):
    v = " \t Two WORDS \n"
    assert one(spark, tx.trim(F.col("v")), v=v) == "Two WORDS"
    assert one(spark, tx.trim(F.col("v"), "ltrim"), v=v) == "Two WORDS \n"
    assert one(spark, tx.recase(F.lit("two WORDS"), "sentence")) == "Two words"


def test_dates(spark):
    assert tx.date_pattern("%d/%m/%Y at %H:%M") == "dd/MM/yyyy 'at' HH:mm"
    assert one(spark, tx.reformat_date(F.lit("31-12-2020"), "%d-%m-%Y", "%Y%m%d")) == "20201231"
    assert one(spark, tx.reformat_date(F.lit("nope"), "%d-%m-%Y", "%Y%m%d")) is None


def test_tokens_equal_split_and_strip(spark):
    runs = ["", ".", "..a", "a..", "a.b", "..a..b..", "É.x", "A1.2-b", "x" * 1_000_000, "a" + "." * 1_000_000, "." * 1_000_000 + "b", "a. " * 300_000]
    frame = spark.createDataFrame([(i, r) for i, r in enumerate([*runs, " ".join(runs[:8])])], "i int, t string")
    got = {r.i: r.x for r in frame.select("i", tx.tokens(F.col("t")).alias("x")).collect()}
    plain = lambda t: [p for p in (p.strip(".") for p in re.split(r"[^a-z0-9.]+", t.lower())) if p]
    assert got == {r.i: plain(r.t) for r in frame.collect()}


def test_identifier_and_tokens(spark):
    assert one(spark, tx.identifier(F.lit("  Fee (EUR) / Day! "))) == "fee_eur_day"
    assert one(spark, tx.tokens(F.lit("U.S. rates, v2.1 -- ..x.. "))) == ["u.s", "rates", "v2.1", "x"]
    assert one(spark, tx.vendor_signature(F.lit(" ACME "), F.lit("Spot   Rates"), F.lit("p1"))) == "acme::spot rates"
    assert one(spark, tx.vendor_signature(F.lit("a"), F.lit(""), F.lit("P1"))) == "a::p1"


def test_bare_identifiers(spark):
    for name, wanted in {"EQUITY-PRICES": True, "EQP_RT_001": True, "X1REF": True, "Prices": False, "FX": False, "Equity Prices": False, "": False}.items():
        assert one(spark, tx.bare_identifier(F.lit(name))) is wanted, name


def test_caps_and_clamp(spark):
    assert len(one(spark, tx.capped(F.lit("x" * 3000)))) == 1998
    assert [one(spark, tx.clamp01(F.lit(v))) for v in (-1.0, 0.4, 7.0, float("nan"), None)] == [0, 0.4, 1, 0, 0]


def test_maps(spark):
    merged = one(spark, tx.merged_map(F.create_map(F.lit("a"), F.lit("1")), F.create_map(F.lit("a"), F.lit("2"), F.lit("b"), F.lit("3"))))
    assert merged == {"a": "1", "b": "3"}
    assert one(spark, tx.json_or(F.lit("{bad"), "map<string,string>", F.create_map().cast("map<string,string>"))) == {}


D = datetime.date


def test_intervals(spark):
    wanted = {
        "2019": (D(2019, 1, 1), D(2019, 12, 31)), "2019-06": (D(2019, 6, 1), D(2019, 6, 30)), "2019-06-30": (D(2019, 6, 30), D(2019, 6, 30)),
        "2019-2021": (D(2019, 1, 1), D(2021, 12, 31)), "2019/2020": (D(2019, 1, 1), D(2020, 12, 31)), "2019-01 to 2019-06": (D(2019, 1, 1), D(2019, 6, 30)),
        "../2020": (None, D(2020, 12, 31)), "2020/": (D(2020, 1, 1), None),
    }
    bad = ["0000", "2019-13", "2019-02-30", "2021/2019", "../..", "2019/2020/2021", "Jan 19", "historical", "", None]
    rows = spark.createDataFrame([(t,) for t in [*wanted, *bad]], "t string").select("t", temporal.interval(F.col("t")).alias("i")).collect()
    for r in rows:
        assert (tuple(r.i) if r.i else None) == wanted.get(r.t), r.t


def test_overlap_and_coverage(spark):
    a, b = temporal.interval(F.lit("2019")), temporal.interval(F.lit("2019-12-31/"))
    assert one(spark, temporal.overlap(a, b)) is True
    raw = F.create_map(*map(F.lit, ("coverage_start", "2019", "as_of", "2025-01-01")))
    assert one(spark, temporal.coverage(F.lit(None).cast("string"), raw)) == "2019/"
    assert one(spark, temporal.coverage(F.lit(" 2001 "), raw)) == "2001"
    assert one(spark, temporal.coverage(F.lit(None).cast("string"), F.create_map(F.lit("as_of"), F.lit("2025")))) is None


def test_watermarks(spark):
    mark = one(spark, temporal.format_watermark(temporal.parse_watermark(F.lit("acme-2024-01-02"), "acme"), "acme"))
    assert mark.startswith("acme-2024-01-02T00:00:00")


def test_identity(spark):
    for name in ("", "abc", "Zürich 🙂"):
        assert one(spark, identity.uuid5(F.lit(name))) == str(uuid.uuid5(identity.NAMESPACE, name))
    assert one(spark, identity.product_iri(F.lit(" ACME & Co"), F.lit("p "))) == one(spark, identity.product_iri(F.lit("acme & co"), F.lit("p")))


def test_jaro_winkler_values(spark):
    rows = spark.createDataFrame([("martha", "marhta"), ("", "x"), (" A ", "a"), ("abc", "xyz")], "a string, b string")
    got = [round(r.x, 4) for r in rows.select(similarity.jaro_winkler("a", "b").alias("x")).collect()]
    assert got == [0.9611, 0.0, 1.0, 0.0]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="abcd ", max_size=12), st.text(alphabet="abcd ", max_size=12))
def test_jaro_winkler_bounds(a, b):
    assert 0 <= similarity.jaro_winkler_of(a, b) <= 1
    assert similarity.jaro_winkler_of(a, a) == 1


def test_lexical_and_cosine(spark):
    score = lambda t: one(spark, similarity.lexical_score(F.lit(t), F.lit("Equity Prices"), F.array(F.lit("stock quotes"))))
    assert [score(t) for t in ("prices", "quotes", "old quotes", "bonds")] == [0.95, 0.85, 0.6, 0.0]
    assert one(spark, similarity.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(2.0), F.lit(0.0)))) == 1.0


def test_registered_functions(spark):
    similarity.register(spark)
    row = spark.sql("SELECT bm25_tokens('A b.') AS t, round(jaro_winkler('martha', 'marhta'), 4) AS j").first()
    assert row.t == ["a", "b"] and row.j == 0.9611


def test_proposed_fields_are_coerced_by_json_type(spark):
    raw = F.create_map(F.lit("a"), F.lit("x"), F.lit("1"), F.lit("y"))
    ask = lambda text: spark.range(1).select(tx.proposed_fields(F.lit(text).cast("string"), raw).alias("f")).first().f
    rows = ask('[{"vendor_field_name": "a", "label": "", "primary_key": "true", "nullable": true, "sequence_number": true}, {"vendor_field_name": 1, "data_type": "Integer ", "primary_key": true, "nullable": 1, "sequence_number": 3}, {"label": "b"}, {"vendor_field_name": "z"}, null, 3]')
    assert [tuple(r) for r in rows] == [("a", "a", "string", False, True, None), ("1", "1", "integer", True, None, 3)]
    assert ask("[]") == [] and ask(None) is None and ask("{}") is None
