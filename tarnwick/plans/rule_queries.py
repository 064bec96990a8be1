"""Queries for text rules, matching switches, graphs, precedents and evaluation over the driver's tables, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import identity, similarity, temporal
from ..functions import text as tx
from ..operators import catalog, evaluation, graph, ingest, matching, metadata, precedents, retrieval
from ..runtime import scratch_path, table
from ..streaming import streams
from .queries import BM25_SQL, EDGES_SQL, EVENTS_SQL, JW_SQL, POSITIVE_SQL, TOKENS_SQL, _tree, decisions, query

# Text rules.


@query("""SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN CAST(p_partkey AS VARCHAR) WHEN p_partkey % 5 = 1 THEN p_name WHEN p_partkey % 5 = 2 THEN p_brand ELSE p_name || ' ' || p_brand END AS text FROM part""")
def query_texts(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey") % 5
    name, description = F.when(~k.isin(0, 2), F.col("p_name")), F.when(~k.isin(0, 1), F.col("p_brand"))
    return p.select("p_partkey", tx.query_text(F.coalesce(name, F.lit("")), description, F.col("p_partkey").cast("string")).alias("text"))


@query("SELECT p_partkey, p_name AS plain, p_name || ' ' || p_brand || ' ' || p_type AS lexical, p_name || ' ' || p_brand || ' ' || p_type || ' s' || p_size || ' x' AS with_signals, p_name || ' ' || p_type AS dense FROM part")
def taxonomy_texts(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    args = F.col("p_name"), F.array("p_brand"), F.col("p_type"), [F.concat(F.lit("s"), "p_size"), F.lit(" "), F.lit("x"), F.concat(F.lit("s"), "p_size")]
    return p.select("p_partkey", tx.lexical_text(*args).alias("plain"), tx.lexical_text(*args, with_text=True).alias("lexical"), tx.lexical_text(*args, with_text=True, with_signals=True).alias("with_signals"), tx.dense_text(args[0], args[2], True).alias("dense"))


@query("SELECT doc_id, CASE WHEN length(t) > 2000 THEN left(t, 1997) || '…' ELSE t END AS definition FROM (SELECT doc_id, concat_ws(' | ', lang, CASE WHEN trim(source) <> '' THEN source END, 'doc ' || doc_id || repeat(' long', CAST(doc_id % 600 AS INT))) AS t FROM documents)")
def definitions(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    long = F.concat(F.lit("doc "), "doc_id", F.expr("repeat(' long', cast(doc_id % 600 AS INT))"))
    return d.select("doc_id", tx.definition(F.col("lang"), F.lit("  "), F.col("source"), long).alias("definition"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type WHEN 1 THEN 'second' WHEN 2 THEN NULL ELSE 'x' END AS class FROM events")
def data_classes(spark, sf_dir):
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 4
    raw = F.map_from_arrays(F.array(F.lit("assetClass"), F.lit("data_class"), F.lit("other")), F.array(F.when(k == 0, F.upper("event_type")).when(k == 1, "Second").when(k == 3, "no"), F.when(k == 1, " ").when(k == 3, "X"), F.lit("y")))
    return e.select("event_id", tx.data_class(raw).alias("class"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN y || '-01/' || y || '-06' WHEN 1 THEN y || '/' WHEN 2 THEN 'since ' || y ELSE y END AS coverage FROM (SELECT o_orderkey, CAST(year(o_orderdate) AS VARCHAR) AS y FROM orders)""")
def coverages(spark, sf_dir):
    y, k = F.year("o_orderdate").cast("string"), F.col("o_orderkey") % 4
    raw = F.map_filter(F.create_map(F.lit("startDate"), F.when(k == 0, F.concat(y, F.lit("-01"))).when(k == 1, y), F.lit("endDate"), F.when(k == 0, F.concat(y, F.lit("-06"))), F.lit("coveragePeriod"), F.when(k == 2, F.concat(F.lit("since "), y))), lambda _, v: v.isNotNull())
    return table(spark, sf_dir, "orders").select("o_orderkey", temporal.coverage(F.when(k == 3, y), raw).alias("coverage"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE o_orderdate END AS at, CASE o_orderkey % 3 WHEN 2 THEN NULL ELSE 'acme-' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || '.000000Z' END AS shown FROM orders")
def watermarks(spark, sf_dir):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    k = F.col("o_orderkey") % 3
    given = F.when(k == 0, F.concat(F.lit("acme-"), day)).when(k == 1, F.concat(day, F.lit("T00:00:00+00:00"))).otherwise("soon")
    at = temporal.parse_watermark(given, "acme")
    return table(spark, sf_dir, "orders").select("o_orderkey", at.cast("timestamp_ntz").alias("at"), temporal.format_watermark(at, "acme").alias("shown"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'domain' WHEN 1 THEN 'subdomain' ELSE 'concept' END AS kind FROM part")
def iri_kinds(spark, sf_dir):
    k = F.col("p_partkey") % 3
    iri = F.concat(F.when(k == 0, "catalog:domain:").when(k == 1, "catalog:subdomain:").otherwise("catalog:thing:"), F.col("p_name"))
    return table(spark, sf_dir, "part").select("p_partkey", tx.iri_kind(iri).alias("kind"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'k:1,user:2' ELSE 'k:1' END AS kept FROM events")
def enrichment_whitelist(spark, sf_dir):
    raw = F.map_from_arrays(F.array(F.lit("k"), F.when(F.col("event_id") % 2 == 0, "user").otherwise("else")), F.array(F.lit("v"), F.lit("w")))
    fields = F.array(*(F.struct(F.lit(n).alias("name"), F.lit(v).alias("value")) for n, v in (("k", "1"), ("user", "2"), ("absent", "3"))))
    kept = tx.whitelisted(fields, raw)
    return table(spark, sf_dir, "events").select("event_id", F.array_join(F.transform(kept, lambda f: F.concat_ws(":", f["name"], f["value"])), ",").alias("kept"))


@query("""SELECT event_id, 'k' AS name, CASE WHEN event_id % 3 = 0 THEN event_type ELSE 'k' END AS label, CASE WHEN event_id % 4 = 0 THEN 'date' ELSE 'string' END AS data_type, event_id % 5 = 0 AS primary_key,
    CASE WHEN event_id % 2 = 0 THEN event_id % 5 = 0 END AS nullable, CASE WHEN event_id % 3 = 1 THEN event_id END AS sequence_number FROM events""")
def coerced_fields(spark, sf_dir):
    """Two proposed fields for each event, one of them unknown; a type, a nullable or a number of the wrong kind is coerced."""
    n = F.col("event_id")
    pick = lambda *branches: F.concat(*(F.lit(b) if isinstance(b, str) else b for b in branches))
    label = F.when(n % 3 == 0, F.concat(F.lit('"'), "event_type", F.lit('"'))).otherwise("null")
    kind, key = F.when(n % 4 == 0, '" DATE"').otherwise('"money"'), (n % 5 == 0).cast("string")
    nullable = F.when(n % 2 == 0, key).otherwise(F.concat(F.lit('"'), key, F.lit('"')))
    number = F.when(n % 3 == 1, n.cast("string")).when(n % 3 == 2, F.concat(n.cast("string"), F.lit(".5"))).otherwise("true")
    text = pick('[{"vendor_field_name": "absent"}, 7, {"vendor_field_name": "k", "label": ', label, ', "data_type": ', kind, ', "primary_key": ', key, ', "nullable": ', nullable, ', "sequence_number": ', number, "}]")
    return table(spark, sf_dir, "events").select("event_id", F.inline(tx.proposed_fields(text, F.create_map(F.lit("k"), F.lit("v")))))


@query("""SELECT p_partkey, CASE WHEN contains(lower(p_name), 'ring') THEN 0.95 WHEN contains(lower(p_brand), 'ring') THEN 0.85 ELSE 0.0 END AS lone,
    CASE WHEN contains(lower(p_name), 'red ring') THEN 0.95 WHEN contains('a ring thing', 'red') OR contains('a ring thing', 'ring') THEN 0.6 ELSE 0.0 END AS by_word FROM part""")
def lexical_scores(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", similarity.lexical_score(F.lit("RING"), F.col("p_name"), F.array("p_brand")).alias("lone"), similarity.lexical_score(F.lit("red Ring"), F.col("p_name"), F.array(F.lit("a Ring thing"))).alias("by_word"))


@query("""WITH k AS (SELECT 'acme-' || p_brand AS vendor, CAST(p_partkey AS VARCHAR) AS id, sha1(unhex('{ns}') || encode(lower('acme-' || p_brand) || '::' || p_partkey)) AS h, sha1(unhex('{ns}') || encode('concept::class::' || lower(p_name))) AS g FROM part)
    SELECT 'mds.' || replace(lower(vendor), ' ', '') || ':' || {u} AS product, 'catalog:class:' || {c} AS concept FROM k""".format(
    ns=identity.NAMESPACE.hex,
    **{n: f"{h}[1:8] || '-' || {h}[9:12] || '-5' || {h}[14:16] || '-' || substr('89ab', 1 + (CAST('0x' || {h}[17:17] AS INT) % 4), 1) || {h}[18:20] || '-' || {h}[21:32]" for n, h in (("u", "h"), ("c", "g"))},
))
def minted_iris(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    vendor = F.concat(F.lit(" ACME-"), F.col("p_brand"), F.lit(" "))
    return p.select(identity.product_iri(vendor, F.concat(F.lit(" "), "p_partkey")).alias("product"), identity.concept_iri(F.lit("class"), F.upper("p_name")).alias("concept"))


@query("SELECT * FROM (VALUES ('next', 150), ('other vendor', -1), ('other filter', -1), ('broken', -1)) v(given, start)")
def cursors(spark, sf_dir):
    """The offset that a cursor gives, -1 where it is refused."""
    rows, cursor = catalog.list_products(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias(catalog.KEY), F.col("o_orderdate").alias("modified_at")), "v", catalog.encode_cursor("v", None, 100), 50)
    assert len(rows) == 50

    def at(c, vendor, since):
        try:
            return catalog.decode_cursor(c, vendor, since)
        except ValueError:
            return -1

    found = [("next", at(cursor, "v", None)), ("other vendor", at(cursor, "w", None)), ("other filter", at(cursor, "v", "2020")), ("broken", at("?", "v", None))]
    return spark.createDataFrame(found, "given string, start int")


@query("SELECT * FROM (VALUES ('vendor_product_ref', 'integer', true), ('title', 'string', true), ('created_at', 'datetime', false), ('version', 'integer', false)) v(name, type, required)")
def catalogue_schema(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("vendor_product_ref"), F.col("o_orderstatus").alias("title"), F.col("o_orderdate").alias("created_at"), F.col("o_custkey").alias("version"), "o_totalprice")
    return spark.createDataFrame([(x["name"], x["type"], x["required"]) for x in catalog.get_schema(orders)], "name string, type string, required boolean")


# Metadata, sinks and logs.


@query("SELECT o_orderkey AS dataset_id, o_orderstatus AS name, o_custkey AS provider_id, c_name AS provider_name FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus <> 'P' AND c_mktsegment <> 'MACHINERY'")
def datasets_with_provider(spark, sf_dir):
    datasets = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("dataset_id"), F.col("o_orderstatus").alias("name"), F.col("o_custkey").alias("provider_id"), F.when(F.col("o_orderstatus") == "P", "n").otherwise("y").alias("current_flag"))
    providers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("provider_id"), F.col("c_name").alias("provider_name"), F.when(F.col("c_mktsegment") == "MACHINERY", "d").otherwise("y").alias("current_flag"))
    return metadata.with_provider(datasets, providers).drop("current_flag")


@query("SELECT c_custkey AS user_id, coalesce(roles, '') AS roles FROM customer LEFT JOIN (SELECT o_custkey, string_agg(DISTINCT 'role ' || o_orderstatus, ',' ORDER BY 'role ' || o_orderstatus) AS roles FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1) ON o_custkey = c_custkey")
def users_with_roles(spark, sf_dir):
    roles = spark.createDataFrame([("F", "role F"), ("O", "role O")], "role_id string, role_name string")
    grants = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("role_id"))
    found = metadata.with_roles(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id")), roles, grants)
    return found.withColumn("roles", F.array_join("roles", ","))


@query("SELECT n_name AS col_name, n_regionkey AS pos, CASE WHEN n_regionkey = 1 THEN 'upper' END AS case_rule FROM nation")
def column_transforms(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    rules = n.filter("n_regionkey = 1").select(F.lower("n_name").alias("col_name"), F.lit("upper").alias("case_rule"))
    return metadata.transforms_on_columns(n.select(F.col("n_name").alias("col_name"), F.col("n_regionkey").alias("pos")), rules)


@query("SELECT c_nationkey AS dataset_id, count(*) AS n, count(*) FILTER (c_nationkey < 5) AS replaced FROM customer GROUP BY 1")
def replaced_partitions(spark, sf_dir):
    """All customers by nation, then those of five nations once more under another name."""
    c, path = table(spark, sf_dir, "customer").select(F.col("c_custkey"), F.lit("old").alias("name"), F.col("c_nationkey").alias("dataset_id")), scratch_path(spark, "rules")
    ingest.replace_partition(c, path)
    ingest.replace_partition(c.filter("dataset_id < 5").withColumn("name", F.lit("new")), path)
    return spark.read.parquet(path).groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("name") == "new").alias("replaced"))


TAXONOMY_HASH_SQL = "SELECT sha256(concat_ws(':', CAST(sum(CAST('0x' || h[1:15] AS HUGEINT)) AS VARCHAR), CAST(sum(CAST('0x' || h[16:30] AS HUGEINT)) AS VARCHAR), CAST(count(*) AS VARCHAR))) AS taxonomy_hash FROM (SELECT sha256('catalog:' || c_custkey || chr(31) || c_name || chr(31) || CASE WHEN c_nationkey = 0 THEN '' ELSE 'n' || c_nationkey END) AS h FROM customer)"


def _customers(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.concat(F.lit("catalog:"), "c_custkey").alias("iri"), F.col("c_name").alias("label"), F.when(F.col("c_nationkey") != 0, F.concat(F.lit("n"), "c_nationkey")).alias("parent_iri"))


@query(TAXONOMY_HASH_SQL)
def taxonomy_digest(spark, sf_dir):
    return precedents.taxonomy_hash(_customers(spark, sf_dir).repartition(5))


@query(f"WITH {POSITIVE_SQL} SELECT '1.0.0' AS version, taxonomy_hash, (SELECT count(*) FROM held) AS patterns FROM ({TAXONOMY_HASH_SQL})")
def bundle_manifest(spark, sf_dir):
    return precedents.bundle_manifest(decisions(spark, sf_dir), _customers(spark, sf_dir))



# Matching.

TAXONOMY_SQL = """labels AS (SELECT DISTINCT p_brand AS iri, lower(p_brand) AS label, p_brand || ' maker' AS definition FROM part), asked AS (SELECT p_partkey AS product, p_name || ' ' || p_brand AS text FROM part)"""


def _taxonomy(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    part = table(spark, sf_dir, "part")
    signals = F.array(F.lit("extra")).alias("signals")
    nodes = part.select(F.col("p_brand").alias("iri")).distinct().select("iri", F.lower("iri").alias("label"), F.array().cast("array<string>").alias("alt_labels"), F.concat("iri", F.lit(" maker")).alias("definition"), signals)
    return part.select(F.col("p_partkey").alias("product"), F.col("p_name").alias("name"), F.col("p_brand").alias("description")), nodes


def _nothing(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    return spark.createDataFrame([], "child string, parent string"), spark.createDataFrame([], "product bigint, iri string"), spark.createDataFrame([], "product bigint, iri string, n bigint")


def _multi_sql(dense: str, text: str, negative: str = "false", boost: str = "0") -> str:
    """All nodes are nominated first as far as 25 of them go: best by tokens shared, ties and zeros by iri."""
    return f"""WITH {TAXONOMY_SQL}, docs AS (SELECT iri, {TOKENS_SQL.format(text)} AS terms FROM labels), stats AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM docs),
    post AS (SELECT iri, len(terms) AS dl, unnest(terms) AS term FROM docs), tf AS (SELECT iri, dl, term, count(*) AS tf FROM post GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
    q AS (SELECT product, unnest({TOKENS_SQL.format('text')}) AS term FROM asked), qf AS (SELECT product, term, count(*) AS qf FROM q GROUP BY ALL),
    s AS (SELECT product, iri, round(sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qf JOIN df USING (term) JOIN tf USING (term), stats GROUP BY ALL),
    nom AS (SELECT product, text, iri, label, definition FROM asked CROSS JOIN labels LEFT JOIN s USING (product, iri) QUALIFY row_number() OVER (PARTITION BY product ORDER BY coalesce(score, 0) DESC, iri) <= 25),
    jw AS (SELECT product, iri, round({JW_SQL.format(a='lower(text)', b=dense)}, 4) AS similarity, {boost} AS boost FROM nom WHERE NOT ({negative}))
    SELECT product, iri, similarity FROM jw QUALIFY row_number() OVER (PARTITION BY product ORDER BY round(similarity + boost, 6) DESC, iri) <= 3"""


@query(_multi_sql("lower(label)", "label"))
def multi_path(spark, sf_dir):
    products, nodes = _taxonomy(spark, sf_dir)
    return retrieval.retrieve(products, nodes, *_nothing(spark), matching.Options(multi_path=True), 3).select("product", "iri", "similarity")


@query(_multi_sql("lower(label || ' ' || definition)", "label || ' ' || definition"))
def multi_path_texts(spark, sf_dir):
    products, nodes = _taxonomy(spark, sf_dir)
    return retrieval.retrieve(products, nodes, *_nothing(spark), matching.Options(multi_path=True, taxonomy_text=True), 3).select("product", "iri", "similarity")


@query(_multi_sql("lower(label || ' ' || definition)", "label || ' ' || definition || ' extra'"))
def multi_path_signals(spark, sf_dir):
    products, nodes = _taxonomy(spark, sf_dir)
    return retrieval.retrieve(products, nodes, *_nothing(spark), matching.Options(multi_path=True, taxonomy_text=True, signal_text=True), 3).select("product", "iri", "similarity")


@query(_multi_sql("lower(label)", "label", "(product + CAST(regexp_extract(iri, '[0-9]+') AS INT)) % 4 = 0", "CASE WHEN (product + CAST(regexp_extract(iri, '[0-9]+') AS INT)) % 5 = 0 THEN least(0.1, 0.02 * (1 + product % 7)) ELSE 0 END"))
def multi_path_precedents(spark, sf_dir):
    """A quarter of the pairs was rejected before, a fifth confirmed one to seven times."""
    products, nodes = _taxonomy(spark, sf_dir)
    number = F.col("product") + F.regexp_extract("iri", "[0-9]+", 0).cast("int")
    pairs = products.select("product").join(F.broadcast(nodes.select("iri")))  # brands, a few dozen
    boosts = pairs.filter(number % 5 == 0).withColumn("n", 1 + F.col("product") % 7)
    return retrieval.retrieve(products, nodes, _nothing(spark)[0], pairs.filter(number % 4 == 0), boosts, matching.Options(multi_path=True), 3).select("product", "iri", "similarity")


# The multi-path form where nomination decides: a node for every name of a brand, hundreds in all, of which 25 are nominated.


def _chosen_sql(name: str, text: str, expand: bool = False) -> str:
    """The nominated pairs (product, iri) by BM25 of text as a table of this name."""
    wide = f"""SELECT product, iri FROM {name}_best UNION SELECT product, parent FROM {name}_best JOIN nodes USING (iri) UNION SELECT product, n.iri FROM {name}_best b JOIN nodes n ON n.parent = b.iri"""
    return f"""{name}_docs AS (SELECT iri, {TOKENS_SQL.format(f'({text})')} AS terms FROM nodes), {name}_stats AS (SELECT count(*) AS n, avg(len(terms)) AS avgdl FROM {name}_docs),
    {name}_tf AS (SELECT iri, dl, term, count(*) AS tf FROM (SELECT iri, len(terms) AS dl, unnest(terms) AS term FROM {name}_docs) GROUP BY ALL), {name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY 1),
    {name}_s AS (SELECT product, iri, round(sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qf JOIN {name}_df USING (term) JOIN {name}_tf USING (term), {name}_stats GROUP BY ALL),
    {name}_best AS (SELECT product, iri FROM {name}_s QUALIFY row_number() OVER (PARTITION BY product ORDER BY score DESC, iri) <= 25), {name} AS ({wide if expand else f"SELECT product, iri FROM {name}_best"})"""


NAMED_SQL = f"""nodes AS (SELECT p_brand || '/' || p_name AS iri, p_name || ' ' || p_brand AS label, 'kind ' || min(p_type) AS definition, 'grade' || min(p_size) AS signal, p_brand || '/' || min(min(p_name)) OVER (PARTITION BY p_brand) AS parent FROM part GROUP BY p_brand, p_name),
    asked AS (SELECT p_partkey AS product, p_name || ' ' || p_type || ' grade' || p_size AS text FROM part),
    q AS (SELECT product, unnest({TOKENS_SQL.format('text')}) AS term FROM asked), qf AS (SELECT product, term, count(*) AS qf FROM q GROUP BY ALL)"""
LEXICAL_SQL = {"label": "label", "text": "label || ' ' || definition", "signal": "label || ' ' || definition || ' ' || signal"}


def _named_sql(lexical: str, dense: str = "lower(label || ' ' || definition)", expand: bool = False, score: str | None = None) -> str:
    score = score or JW_SQL.format(a="lower(text)", b=dense)
    return f"""WITH {NAMED_SQL}, {_chosen_sql("nom", LEXICAL_SQL[lexical], expand)}, jw AS (SELECT product, iri, round({score}, 4) AS similarity FROM nom JOIN asked USING (product) JOIN nodes USING (iri))
    SELECT product, iri, similarity FROM jw QUALIFY row_number() OVER (PARTITION BY product ORDER BY similarity DESC, iri) <= 3"""


def _named(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Products, nodes and edges; a brand's first name is the parent of its others."""
    part = table(spark, sf_dir, "part")
    iri = F.concat("p_brand", F.lit("/"), "p_name").alias("iri")
    nodes = part.groupBy("p_brand", "p_name").agg(F.concat(F.lit("kind "), F.min("p_type")).alias("definition"), F.array(F.concat(F.lit("grade"), F.min("p_size"))).alias("signals"))
    first = part.groupBy("p_brand").agg(F.min("p_name").alias("first"))
    edges = nodes.join(first, "p_brand").select(iri.alias("child"), F.concat("p_brand", F.lit("/"), "first").alias("parent"))
    nodes = nodes.select(iri, F.concat("p_name", F.lit(" "), "p_brand").alias("label"), F.array().cast("array<string>").alias("alt_labels"), "definition", "signals")
    return part.select(F.col("p_partkey").alias("product"), F.col("p_name").alias("name"), F.concat("p_type", F.lit(" grade"), "p_size").alias("description")), nodes, edges


def _named_path(spark, sf_dir, scorer=similarity.jaro_winkler, **switches):
    products, nodes, edges = _named(spark, sf_dir)
    return retrieval.retrieve(products, nodes, edges, *_nothing(spark)[1:], matching.Options(multi_path=True, **switches), 3, scorer=scorer).select("product", "iri", "similarity")


@query(_named_sql("label", "lower(label)"))
def nominated_labels(spark, sf_dir):
    return _named_path(spark, sf_dir)


@query(_named_sql("text"))
def nominated_texts(spark, sf_dir):
    return _named_path(spark, sf_dir, taxonomy_text=True)


@query(_named_sql("signal"))
def nominated_signals(spark, sf_dir):
    return _named_path(spark, sf_dir, taxonomy_text=True, signal_text=True)


@query(_named_sql("label", "lower(label)", expand=True))
def nominated_neighbours(spark, sf_dir):
    """With subsumption: parents and children of nominated nodes are scored too."""
    return _named_path(spark, sf_dir, subsumption=True)


@query(_named_sql("label", score=f"CASE WHEN text LIKE '%hot gear%' THEN 0.5 ELSE {JW_SQL.format(a='lower(text)', b='lower(label)')} END"))
def nominated_degraded(spark, sf_dir):
    """A scorer that fails on some products gives their candidates the degraded score."""
    def fragile(a, b):
        if a.str.contains("hot gear").any():
            raise ConnectionError("no answer")
        return similarity.jaro_winkler.func(a, b)

    return _named_path(spark, sf_dir, scorer=retrieval.guarded(fragile))


@query(f"""WITH {NAMED_SQL}, {_chosen_sql("live", LEXICAL_SQL["label"])}, {_chosen_sql("shadow", LEXICAL_SQL["text"])}
    SELECT product, iri, 'live' AS side FROM (FROM live EXCEPT FROM shadow) UNION ALL SELECT product, iri, 'shadow' FROM (FROM shadow EXCEPT FROM live)""")
def text_shadow(spark, sf_dir):
    """What indexing the texts would change in the nominations."""
    products, nodes, edges = _named(spark, sf_dir)
    live, shadow = (matching.Options(multi_path=True, taxonomy_text=text) for text in (False, True))
    return retrieval.shadow_nominations(products, nodes, edges, live, shadow).select(F.col("query").alias("product"), F.col("doc").alias("iri"), "side")


@query(f"""WITH {BM25_SQL}, best AS (SELECT query, doc, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM scored QUALIFY rank <= 25)
    SELECT query, doc, score, rank FROM best UNION ALL SELECT * FROM (SELECT -1 AS query, doc_id AS doc, 0 AS score, row_number() OVER (ORDER BY doc_id) AS rank FROM documents QUALIFY rank <= 25)""")
def zero_score_nomination(spark, sf_dir):
    """bm25_nominate with one more query, which no document answers."""
    items, docs = table(spark, sf_dir, "benchmark"), table(spark, sf_dir, "documents")
    asked = items.select("item_id", "text").union(spark.createDataFrame([(-1, "!!!")], "item_id bigint, text string"))
    scored = retrieval.best_bm25(asked, docs, "item_id", F.col("text"), "doc_id", F.col("text"))
    found = retrieval.nominate(scored, 25, asked.select(F.col("item_id").alias("query")), docs.select(F.col("doc_id").alias("doc")))
    return found.select("query", "doc", "score", F.col("rank").cast("bigint").alias("rank"))


@query("""WITH r AS (SELECT o_custkey AS query, o_orderkey AS doc, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS a, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS b FROM orders)
    SELECT query, doc, round(1.0 / (60 + a) + 1.0 / (60 + b), 9) AS fused FROM r""")
def fuse_rankings(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    own = lambda name, score: o.select(F.lit(name).alias("ranker"), F.col("o_custkey").alias("query"), F.col("o_orderkey").alias("doc"), F.col("o_orderkey").alias("ord"), score.alias("score"))
    rankings = own("price", F.col("o_totalprice")).unionByName(own("date", F.unix_date(F.col("o_orderdate").cast("date")).cast("double")))
    return retrieval.fuse(rankings).select("query", "doc", F.round("fused", 9).alias("fused"))


@query("SELECT s_suppkey AS query, s_nationkey AS doc, CASE WHEN s_suppkey % 3 = 0 THEN 'live' ELSE 'shadow' END AS side FROM supplier WHERE s_suppkey % 3 < 2")
def shadow_difference(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query"), F.col("s_nationkey").alias("doc"))
    return retrieval.shadow_diff(s.filter("query % 3 <> 1"), s.filter("query % 3 <> 0"))


@query("SELECT vendor, product_id, iri, status FROM (SELECT 'v' || (s_suppkey % 4) AS vendor, CAST(s_suppkey AS VARCHAR) AS product_id, CASE WHEN s_suppkey % 2 = 0 THEN 'n' || s_nationkey END AS iri, CASE WHEN s_suppkey % 2 = 0 THEN 'approve' ELSE 'open' END AS status FROM supplier)")
def settled_products(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.concat(F.lit("v"), F.col("s_suppkey") % 4).alias("vendor"), F.col("s_suppkey").cast("string").alias("product_id"), "s_nationkey", "s_suppkey")
    held = s.filter("s_suppkey % 2 = 0").select("vendor", "product_id", F.concat(F.lit("n"), "s_nationkey").alias("node_iri"), F.lit("approve").alias("decision"))
    done, left = matching.split_settled(s.select("vendor", "product_id"), held)
    return done.select("vendor", "product_id", F.col("precedent_iri").alias("iri"), F.col("precedent_decision").alias("status")).unionByName(left.select("vendor", "product_id", F.lit(None).cast("string").alias("iri"), F.lit("open").alias("status")))


LADDER_ROWS = ["allowed", "node_iri", "node_in_store", "name", "description", "raw", "node_class", "temporal_coverage", "node_coverage", "precedent_iri", "precedent_decision", "candidates", "pick_iri", "pick_score", "specialist_required"]


def _ladder(spark: SparkSession, sf_dir: str, **columns) -> DataFrame:
    """Parts as products in the ladder: first candidate of similarity p_size / 50, second of a tenth less."""
    p, text = table(spark, sf_dir, "part"), F.lit(None).cast("string")
    first = F.col("p_size") / 50.0
    plain = {
        "allowed": F.lit(True), "node_iri": F.lit("n1"), "node_in_store": F.lit(True), "name": F.col("p_name"), "description": F.lit("a part"), "raw": F.create_map().cast("map<string,string>"),
        "node_class": text, "temporal_coverage": text, "node_coverage": text, "precedent_iri": text, "precedent_decision": text,
        "candidates": F.array(F.struct(F.lit("n1").alias("iri"), first.alias("similarity")), F.struct(F.lit("n2").alias("iri"), (first - 0.1).alias("similarity"))),
        "pick_iri": text, "pick_score": F.lit(None).cast("double"), "specialist_required": F.lit(False),
    }
    return p.select("p_partkey", "p_size", *((columns.get(c, plain[c])).alias(c) for c in LADDER_ROWS))


BAND = "CASE WHEN p_size / 50.0 >= 0.8 THEN 'pass' WHEN p_size / 50.0 >= 0.7 THEN 'borderline' ELSE 'fail' END"
PLAIN_STATUS = "CASE WHEN p_size / 50.0 >= 0.8 OR (p_size / 50.0 >= 0.7 AND p_size / 50.0 >= (0.8 + 0.7) / 2) THEN 'auto_mapped' ELSE 'needs_review' END"


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'fail' ELSE {BAND} END AS band, CASE WHEN p_partkey % 2 = 0 THEN 'needs_review' ELSE {PLAIN_STATUS} END AS status_on, {PLAIN_STATUS} AS status_off FROM part")
def asset_class_switch(spark, sf_dir):
    """Half of the nodes have another class than their products: it counts only where the switch is set."""
    raw = F.create_map(F.lit("asset_class"), F.lit("FX")).cast("map<string,string>")
    rows = _ladder(spark, sf_dir, raw=raw, node_class=F.when(F.col("p_partkey") % 2 == 0, "Bond").when(F.col("p_partkey") % 3 == 0, "fx"))
    on = matching.decide(rows, matching.Options(asset_class=True)).select("p_partkey", "band", F.col("status").alias("status_on"))
    return on.join(matching.decide(rows).select("p_partkey", F.col("status").alias("status_off")), "p_partkey")


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN 'out_of_scope' WHEN p_partkey % 4 = 1 THEN 'needs_review' WHEN p_partkey % 4 = 2 THEN 'overridden' ELSE {PLAIN_STATUS} END AS status, CASE WHEN p_partkey % 4 = 0 THEN 0 WHEN p_partkey % 4 = 2 THEN 1 ELSE p_size / 50.0 END AS confidence, CASE WHEN p_partkey % 4 = 2 THEN 'n9' WHEN p_partkey % 4 > 0 THEN 'n1' END AS node FROM part")
def ladder_blocks(spark, sf_dir):
    """Products out of scope, with a node that is not in the store, with an override, and plain ones."""
    k = F.col("p_partkey") % 4
    rows = _ladder(spark, sf_dir, allowed=k != 0, node_in_store=k != 1, precedent_iri=F.when(k == 2, "n9"), precedent_decision=F.when(k == 2, "override"))
    return matching.decide(rows).select("p_partkey", "status", "confidence", F.col("mapped_node_iri").alias("node"))


@query(f"""SELECT p_partkey, CASE WHEN {BAND} <> 'borderline' THEN {PLAIN_STATUS} WHEN p_partkey % 4 = 0 THEN CASE WHEN least(p_size / 50.0, 0.76) >= (0.8 + 0.7) / 2 THEN 'auto_mapped' ELSE 'needs_review' END WHEN p_partkey % 4 IN (1, 2) THEN 'needs_review' ELSE 'needs_review' END AS status,
    CASE WHEN {BAND} <> 'borderline' OR p_partkey % 4 = 3 THEN p_size / 50.0 WHEN p_partkey % 4 = 0 THEN least(p_size / 50.0, 0.76) ELSE least(p_size / 50.0, 0.7 - 0.01) END AS confidence FROM part""")
def specialist_picks(spark, sf_dir):
    """In the borderline band the specialist concurs, picks the second candidate, picks an unknown node, or fails where it is required."""
    k = F.col("p_partkey") % 4
    rows = _ladder(spark, sf_dir, pick_iri=F.when(k == 0, "n1").when(k == 1, "n2").when(k == 2, "n7"), pick_score=F.lit(0.76), specialist_required=k == 3)
    return matching.decide(rows).select("p_partkey", "status", "confidence")


@query(f"SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'needs_review' ELSE {PLAIN_STATUS} END AS complete, CASE WHEN p_partkey % 3 = 0 THEN 'needs_review' ELSE {PLAIN_STATUS} END AS timely, CASE WHEN {PLAIN_STATUS} = 'auto_mapped' AND p_partkey % 5 = 0 THEN 'needs_review' ELSE {PLAIN_STATUS} END AS clear FROM part")
def other_switches(spark, sf_dir):
    """Input completeness, temporal coverage and margin, each by itself."""
    k, first = F.col("p_partkey"), F.col("p_size") / 50.0
    coded = _ladder(spark, sf_dir, name=F.when(k % 2 == 0, "EQ-01").otherwise(F.col("p_name")))
    late = _ladder(spark, sf_dir, temporal_coverage=F.lit("2020"), node_coverage=F.when(k % 3 == 0, "2010 to 2012").when(k % 3 == 1, "2019/"))
    close = _ladder(spark, sf_dir, candidates=F.array(F.struct(F.lit("n1").alias("iri"), first.alias("similarity")), F.struct(F.lit("n2").alias("iri"), (first - F.when(k % 5 == 0, 0.01).otherwise(0.03)).alias("similarity"))))
    out = matching.decide(coded, matching.Options(input_completeness=True)).select("p_partkey", F.col("status").alias("complete"))
    out = out.join(matching.decide(late, matching.Options(temporal=True)).select("p_partkey", F.col("status").alias("timely")), "p_partkey")
    return out.join(matching.decide(close, matching.Options(margin_gate=True)).select("p_partkey", F.col("status").alias("clear")), "p_partkey")


@query("SELECT * FROM (VALUES ('none', 0.8, 0.7), ('window', 0.9, 0.8), ('half', NULL, NULL), ('outside', NULL, NULL)) v(given, pass_cut, borderline)")
def cut_windows(spark, sf_dir):
    def cuts(floor, half):
        try:
            return matching.thresholds(floor, half)
        except ValueError:
            return None, None

    given = [("none", *cuts(None, None)), ("window", *cuts(0.85, 0.05)), ("half", *cuts(0.8, None)), ("outside", *cuts(0.97, 0.05))]
    return spark.createDataFrame(given, "given string, pass_cut double, borderline double")


@query("SELECT event_id, CASE WHEN event_type = 'view' OR event_id % 6 IN (4, 5) THEN 'refuse' ELSE 'queue_for_review' END AS route FROM events")
def commit_routes(spark, sf_dir):
    status = F.when(F.col("event_type") == "view", "out_of_scope").otherwise(F.element_at(F.array(*map(F.lit, ("approved", "overridden", "auto_mapped", "approved", "needs_review", "odd"))), (F.col("event_id") % 6 + 1).cast("int")))
    return table(spark, sf_dir, "events").select("event_id", matching.commit_route(status).alias("route"))


@query("SELECT s_suppkey FROM supplier WHERE s_nationkey = 3")
def vendor_frames(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("vendor"), "s_nationkey").alias("vendor"), F.col("s_suppkey").cast("string").alias("product_id"), F.concat(F.lit("mds:"), "s_suppkey").alias("iri"), F.lit(None).cast("string").alias("target_iri"))
    rules = spark.createDataFrame([], "policy_key string, kind string, target string, assignee string, action string, has_constraint boolean, ord int")
    return matching.list_frames(s, "vendor3", rules, spark.createDataFrame([("vendor3",), ("vendor4",)], "vendor string")).select("s_suppkey")


@query("""SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'published' ELSE 'rejected' END AS outcome, CASE event_id % 6 WHEN 1 THEN 'nothing to publish' WHEN 2 THEN 'triple without graph or with a foreign identifier' WHEN 3 THEN 'identity was not echoed' WHEN 4 THEN 'target was not offered' WHEN 5 THEN 'triple without graph or with a foreign identifier' END AS outcome_reason FROM events""")
def hard_checks(spark, sf_dir):
    """Each hard check of the publish gate fails for a sixth of the rows."""
    k, iri = F.col("event_id") % 6, F.concat(F.lit("mds.v:"), "user_id")
    triple = F.array(F.struct(F.when(k == 5, "no identifier").otherwise(iri).alias("subject"), F.when(k == 2, "").otherwise("g").alias("graph")))
    rows = table(spark, sf_dir, "events").select(
        "event_id", F.lit("new").alias("route"), F.lit(18).alias("verifier"), F.lit(0.9).alias("confidence"), F.lit(False).alias("self_flag"), F.lit("catalog:a").alias("target_iri"), iri.alias("product_iri"),
        F.when(k == 3, "mds.v:other").otherwise(iri).alias("minted_iri"), F.array(F.when(k == 4, "catalog:b").otherwise("catalog:a")).alias("candidate_iris"), F.when(k == 1, F.slice(triple, F.lit(1), F.lit(0))).otherwise(triple).alias("triples"),
    )
    return matching.publish(rows).select("event_id", "outcome", "outcome_reason")


@query("SELECT event_id, CASE WHEN event_id % 4 < 3 THEN 'published' ELSE 'quarantined' END AS outcome, least(3, 1 + event_id % 4) AS pass_no FROM events WHERE event_id % 5 <> 0")
def resumed_batch(spark, sf_dir):
    """A batch that goes on after a fifth of its units had ended."""
    units = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 4).alias("need"))
    ledger, _ = matching.run_batch(units, lambda pending, n: pending.withColumn("outcome", F.when(F.col("need") < n, "published").otherwise("retry")), "event_id", done=units.filter("event_id % 5 = 0"))
    return ledger.select("event_id", "outcome", F.col("pass_no").cast("bigint").alias("pass_no"))


# Graphs.

NODE_SQL = "nodes AS (SELECT 'n' || n_nationkey AS iri, n_name AS label, 'r' || n_regionkey AS parent_iri, n_nationkey AS k FROM nation UNION ALL SELECT 'r' || r_regionkey, r_name, NULL, 100 + r_regionkey FROM region)"


def _nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("iri"), F.col("n_name").alias("label"), F.concat(F.lit("r"), "n_regionkey").alias("parent_iri"), F.lit("concept").alias("node_kind"))
    r = table(spark, sf_dir, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("iri"), F.col("r_name").alias("label"), F.lit(None).cast("string").alias("parent_iri"), F.lit("class").alias("node_kind"))
    none = F.array().cast("array<string>")
    return n.unionByName(r).select("*", none.alias("superclass_iris"), none.alias("superproperty_iris"), none.alias("children_iris"), none.alias("alt_labels"))


@query("""SELECT 'urn:c' || c_custkey AS iri, CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE 'c' || c_custkey END AS label, CASE c_custkey % 2 WHEN 0 THEN 'concept' ELSE 'class' END AS node_kind, CASE WHEN c_custkey % 4 > 0 THEN 'urn:n' || c_nationkey END AS parent_iri, 'about ' || c_custkey || ' | note' AS definition FROM customer WHERE c_custkey % 5 > 0""")
def graph_nodes(spark, sf_dir):
    """Nodes of a graph in which a fifth of the subjects has no type, a third a label and three quarters a parent."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    facts = [
        (F.when(k % 5 > 0, graph.RDF + "type"), F.when(k % 2 == 0, graph.SKOS + "Concept").otherwise(graph.OWL + "Class")), (F.when(k % 3 == 0, graph.RDFS + "label"), F.col("c_name")), (F.when(k % 3 == 0, graph.DCT + "identifier"), F.lit("A first in order")),
        (F.when(k % 4 > 0, graph.SKOS + "broader"), F.concat(F.lit("urn:n"), "c_nationkey")), (F.lit(graph.SKOS + "definition"), F.concat(F.lit("about "), "c_custkey")), (F.lit(graph.SKOS + "scopeNote"), F.lit("note")),
    ]
    quads = c.select(F.concat(F.lit("urn:c"), "c_custkey").alias("subject"), F.explode(F.array(*(F.struct(p.alias("predicate"), o.alias("object")) for p, o in facts))).alias("f")).select("subject", "f.*").filter("predicate IS NOT NULL")
    return graph.nodes_from_quads(quads).select("iri", "label", "node_kind", "parent_iri", "definition")


@query(f"WITH {NODE_SQL} SELECT p.iri, coalesce(string_agg(c.iri, ',' ORDER BY c.iri), '') AS children FROM nodes p LEFT JOIN nodes c ON c.parent_iri = p.iri GROUP BY 1")
def wired_children(spark, sf_dir):
    return graph.wire_children(_nodes(spark, sf_dir)).select("iri", F.array_join("children_iris", ",").alias("children"))


@query(f"WITH {NODE_SQL} SELECT 'r1' AS iri, (SELECT label FROM nodes WHERE iri = 'r1') AS label, string_agg(iri, ',' ORDER BY iri) AS children FROM nodes WHERE parent_iri = 'r1'")
def node_read(spark, sf_dir):
    return graph.node_detail(_nodes(spark, sf_dir), "r1").select("iri", "label", F.array_join("child_iris", ",").alias("children"))


@query("WITH own AS (SELECT 'c' || c_custkey AS iri FROM customer WHERE c_nationkey = 2 ORDER BY iri LIMIT 100) SELECT a.iri AS child, b.iri AS parent FROM own a JOIN own b ON CAST(substr(b.iri, 2) AS BIGINT) = CAST(substr(a.iri, 2) AS BIGINT) // 2 AND a.iri <> b.iri")
def attached_subgraph(spark, sf_dir):
    """What is attached to one nation, and the edges among it, in a tree of all customers by halves of their keys."""
    c = table(spark, sf_dir, "customer")
    nodes = c.select(F.concat(F.lit("c"), "c_custkey").alias("iri"), F.concat(F.lit("n"), "c_nationkey").alias("anchor_iri"))
    edges = c.filter("c_custkey > 0").select(F.concat(F.lit("c"), "c_custkey").alias("child"), F.concat(F.lit("c"), F.floor(F.col("c_custkey") / 2)).alias("parent"))
    return graph.attached(nodes, edges, "n2")[1].select("child", "parent")


@query("SELECT * FROM (VALUES ('nodes', false), ('edges', false), ('identifier', false), ('list', false), ('fits', true)) v(bound, kept)")
def graph_bounds(spark, sf_dir):
    """Whether a graph is let through, once for each bound that it breaks."""
    nodes, edges = _nodes(spark, sf_dir), _tree(spark, sf_dir).limit(40)

    def kept(*args, **bounds):
        try:
            graph.check_bounds(*args, **bounds)
        except ValueError:
            return False
        return True

    long = nodes.withColumn("alt_labels", F.array_repeat(F.lit("x"), 26))
    cases = [("nodes", kept(nodes, edges, max_nodes=29)), ("edges", kept(nodes, edges, max_edges=39)), ("identifier", kept(nodes, edges, max_iri=1)), ("list", kept(long, edges)), ("fits", kept(nodes, edges))]
    return spark.createDataFrame(cases, "bound string, kept boolean")


@query("""SELECT 'missing_reference' AS issue, 'c' || c_custkey AS source, 'gone' AS target FROM customer WHERE c_custkey % 3 = 0
    UNION ALL SELECT 'cross_hierarchy', 'c' || c_custkey, 'c1' FROM customer WHERE c_custkey % 3 = 1 AND c_custkey <> 8 AND c_custkey % 2 = 0 UNION ALL SELECT 'asymmetric_child', 'c2', 'c5'""")
def graph_diagnostics(spark, sf_dir):
    """References to nothing, from a property to a class, and a child that does not refer back."""
    c, k = table(spark, sf_dir, "customer"), F.col("c_custkey")
    none = F.array().cast("array<string>")
    nodes = c.select(
        F.concat(F.lit("c"), "c_custkey").alias("iri"), F.when(k % 3 == 0, "gone").when((k % 3 == 1) & (k != 1), "c1").alias("parent_iri"), F.when(k % 2 == 0, "property").otherwise("class").alias("node_kind"),
        none.alias("superclass_iris"), none.alias("superproperty_iris"), F.when(k == 2, F.array(F.lit("c8"), F.lit("c5"))).otherwise(none).alias("children_iris"),
    )
    found = graph.diagnostics(nodes.withColumn("parent_iri", F.when(F.col("iri") == "c8", "c2").otherwise(F.col("parent_iri"))), limit=1 << 30)
    return found.filter("NOT (issue = 'cross_hierarchy' AND source = 'c2')")


@query(f"WITH {EDGES_SQL}, v AS (SELECT child AS node FROM e UNION SELECT parent FROM e) SELECT node, node LIKE 'c%' AS ancestry_truncated FROM v")
def ancestry_bounds(spark, sf_dir):
    tree = _tree(spark, sf_dir)
    return graph.truncated_ancestry(tree, tree.select(F.col("child").alias("node")).union(tree.select("parent")).distinct(), 2)


@query("SELECT event_id, event_type AS label, CASE event_type WHEN 'click' THEN 'property' WHEN 'error' THEN 'class' ELSE 'concept' END AS node_kind FROM events WHERE event_type <> 'signup'")
def enrichment_projection(spark, sf_dir):
    e, kind = table(spark, sf_dir, "events"), F.col("event_type")
    rows = e.select(F.concat(F.lit("x:y/"), "event_type", F.lit(":"), "event_id").alias("iri"), F.col("event_type").alias("title"), F.when(kind == "signup", "permission").when(kind == "click", "column").when(kind == "error", "table").alias("kind"), F.lit("d").alias("definition"), F.lit(None).cast("string").alias("notes"))
    return graph.project_enrichment(rows).select(F.element_at(F.split("iri", ":"), -1).cast("bigint").alias("event_id"), "label", "node_kind")


@query("SELECT predicate, count(*) AS n, count(DISTINCT subject) AS subjects FROM (SELECT 'p' || event_id AS subject, unnest(CASE WHEN event_type = 'view' THEN ['type', 'theme'] ELSE ['type', 'theme', 'description', 'version'] END) AS predicate FROM events) GROUP BY 1")
def mapping_facts(spark, sf_dir):
    e, view = table(spark, sf_dir, "events"), F.col("event_type") == "view"
    rows = e.select(F.concat(F.lit("p"), "event_id").alias("product_iri"), F.when(~view, F.col("props")).alias("rationale"), F.col("event_type").alias("mapped_node_iri"), F.when(~view, F.lit(2)).alias("version"), F.lit(None).cast("string").alias("decided_by"), F.lit(None).cast("string").alias("see_also"))
    quads = graph.mapping_quads(rows, "g")
    assert graph.shape_errors(quads).isEmpty()
    return quads.groupBy(F.element_at(F.split("predicate", "[/#]"), -1).alias("predicate")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("subject").alias("subjects"))


@query("SELECT n_nationkey AS k FROM nation WHERE n_nationkey % 4 = 0")
def shape_check(spark, sf_dir):
    k = F.col("n_nationkey")
    quads = table(spark, sf_dir, "nation").select("n_nationkey", F.when(k % 8 != 0, F.col("n_name")).alias("subject"), F.lit("p").alias("predicate"), F.when(k % 8 == 4, " ").otherwise("o").alias("object"), F.lit("g").alias("graph"))
    return graph.shape_errors(quads).select(k.alias("k"))


@query(f"""WITH {NODE_SQL} SELECT source, target, relation FROM (SELECT iri AS source, parent_iri AS target, 'parent' AS relation FROM nodes WHERE parent_iri IS NOT NULL UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'maps_to' FROM supplier WHERE s_suppkey % 3 > 0)""")
def match_graph(spark, sf_dir):
    k = F.col("s_suppkey")
    matches = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("product_iri"), F.col("s_name").alias("product_name"), F.lit("pass").alias("band"), F.when(k % 3 > 0, F.concat(F.lit("n"), "s_nationkey")).alias("mapped_node_iri"))
    return graph.match_payload(_nodes(spark, sf_dir).select("iri", "label", "parent_iri"), matches)[1]


# Precedents and evaluation.


@query(f"WITH {POSITIVE_SQL} SELECT vendor, product_id, node_iri FROM held")
def hydrated_bundle(spark, sf_dir):
    path = scratch_path(spark, "bundle")
    precedents.export_bundle(decisions(spark, sf_dir)).select(F.col("pattern").alias("value")).write.text(path)
    cold = precedents.hydrate(spark, f"{path}-absent")
    return precedents.hydrate(spark, path).unionByName(cold).select("vendor", "product_id", F.col("mapped_node_iri").alias("node_iri"))


@query("SELECT event_id, 'one' AS found FROM events WHERE event_id = 12 UNION ALL SELECT event_id, 'all' FROM events WHERE CAST(event_id AS VARCHAR) LIKE '12%'")
def memory_priors(spark, sf_dir):
    memory = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("k"), "event_id").alias("memory_key"))
    one, many = precedents.priors(memory, "k12"), precedents.priors(memory, "k12", prefix=True)
    return one.select("event_id", F.lit("one").alias("found")).unionByName(many.select("event_id", F.lit("all").alias("found")))


@query(f"WITH {EVENTS_SQL} SELECT vendor, product_id, min_by(seq, (decided_at_ms, seq)) AS first, max_by(seq, (decided_at_ms, seq)) AS last FROM d GROUP BY ALL")
def decision_span(spark, sf_dir):
    order = F.struct("decided_at_ms", "seq")
    return precedents.replay(decisions(spark, sf_dir).withColumn("_corrupt", F.lit(None).cast("string"))).groupBy("vendor", "product_id").agg(F.min_by("seq", order).alias("first"), F.max_by("seq", order).alias("last"))


@query("SELECT event_id AS source_event_id, sha256(props) AS digest FROM events")
def verified_observations(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("source_event_id"), F.sha2("props", 256).alias("digest"))
    return evaluation.verified(e, e.repartition(3)).select("source_event_id", "digest")


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'view' INTERSECT SELECT user_id FROM events WHERE event_type = 'purchase'")
def split_leakage(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return evaluation.leakage(e.filter("event_type = 'view'"), e.filter("event_type = 'purchase'"), "user_id")


@query("""SELECT event_id, event_id % 10 <> 3 AS delivered, CASE WHEN event_id % 10 <> 3 THEN 'doc ' || event_id END AS body, event_id % 10 = 3 AS failing FROM events WHERE event_type = 'purchase'""")
def outbox_sweep(spark, sf_dir):
    """Purchases as published outbox rows, a tenth of which cannot be projected: two sweeps, the second over what the first left."""
    e = table(spark, sf_dir, "events")
    rows = e.select("event_id", F.col("ts").alias("created_at"), F.when(F.col("event_type") == "purchase", "published").otherwise("draft").alias("detail_type"), F.col("event_id").cast("string").alias("payload"))
    sink, ledger = scratch_path(spark, "outbox"), scratch_path(spark, "ledger")
    half = int(rows.filter("detail_type = 'published'").count() / 2) + 1
    for most in (half, 2 * half):
        failed = streams.sweep(rows, sink, ledger, _projected, most=most)
    done = streams.delivered(spark, sink)
    left = failed.select("event_id", F.lit(False).alias("delivered"), F.lit(None).cast("string").alias("body"), F.col("error").isNotNull().alias("failing"))
    return done.select("event_id", F.lit(True).alias("delivered"), "body", F.lit(False).alias("failing")).unionByName(left)


def _projected(payload: str) -> str:
    if payload.endswith("3"):
        raise ValueError("no such product")
    return f"doc {payload}"
