"""The decision ladder over whole tables: scope, precedent, validations, bands, specialist, margin, publication."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import temporal
from ..functions.text import bare_identifier, blank_to_null, data_class, trim
from ..runtime import written

PASS, BORDERLINE = 0.80, 0.70
NAME_CAP, DESCRIPTION_CAP = 200, 2000
MARGIN = 0.02
VERIFIER_LOW, VERIFIER_HIGH, CONFIDENCE_FLOOR = 12, 15, 0.80


@dataclass(frozen=True)
class Options:
    """Semantic switches, passed along so that two settings can run side by side."""

    multi_path: bool = False
    taxonomy_text: bool = False
    signal_text: bool = False
    asset_class: bool = False
    subsumption: bool = False
    input_completeness: bool = False
    temporal: bool = False
    margin_gate: bool = False
    margin: float = MARGIN
    pass_cut: float = PASS
    borderline_cut: float = BORDERLINE


def thresholds(floor: float | None = None, half: float | None = None) -> tuple[float, float]:
    """Pass and borderline cuts of a requested window; both or neither must be given, within 0 and 1."""
    if floor is None and half is None:
        return PASS, BORDERLINE
    if any(isinstance(v, bool) or not isinstance(v, (int, float)) for v in (floor, half)):
        raise ValueError("floor and half width must both be numbers")
    if not 0 <= floor - half < floor + half <= 1:
        raise ValueError("the window must lie within 0 and 1")
    return round(floor + half, 2), round(floor - half, 2)


def scope(products: DataFrame, rules: DataFrame, vendors: DataFrame, action: str = "use") -> DataFrame:
    """Products with allowed and reason.

    rules: policy_key, kind (prohibition or permission), target, assignee, action,
    has_constraint, ord. The policy of a product is the one under its iri, target, vendor
    or product id, in that order. Without one the vendor list decides. Else a matching
    prohibition denies, the first matching permission decides, and all else is denied.
    """
    keys = [F.col(k) for k in ("iri", "target_iri", "vendor", "product_id")]
    tagged = products.withColumn("__id", F.xxhash64(*keys))
    offered = tagged.select("__id", "vendor", F.coalesce("target_iri", "iri").alias("aim"), F.posexplode(F.array(*keys)).alias("place", "policy_key")).filter("policy_key IS NOT NULL").distinct()
    joined = offered.join(rules, "policy_key")
    own = joined.groupBy("__id").agg(F.min("place").alias("place"))
    mine = joined.join(own, ["__id", "place"])
    slug = lambda c: F.regexp_replace(F.lower(c), " ", "")
    on_target = F.col("target").isNull() | (F.col("target") == F.col("aim")) | F.contains(slug(F.col("target")), slug(F.col("vendor")))
    acts = F.coalesce(F.lower("action"), F.lit("")).isin(action, "all")
    prohibited = F.max(F.when((F.col("kind") == "prohibition") & on_target & acts, 1).otherwise(0))
    may = (F.col("kind") == "permission") & on_target & (acts | F.col("action").isNull() | (F.col("action") == ""))
    assigned = F.col("assignee").isNull() | F.contains(slug(F.col("assignee")), slug(F.col("vendor")))
    verdict = F.when(~assigned, "assignee mismatch").when(F.coalesce(F.col("has_constraint"), F.lit(False)), "unmatched constraint").otherwise("permission granted")
    judged = mine.groupBy("__id").agg(prohibited.alias("no"), F.min_by(F.when(may, verdict), F.when(may, F.col("ord"))).alias("first"))
    listed = vendors.select(F.col("vendor"), F.lit(True).alias("__listed")).distinct()
    out = tagged.join(judged, "__id", "left").join(listed, "vendor", "left")
    reason = (
        F.when(F.col("no").isNull() & F.col("__listed").isNotNull(), "no policy, vendor in scope")
        .when(F.col("no").isNull(), "vendor out of scope")
        .when(F.col("no") == 1, "prohibited")
        .otherwise(F.coalesce("first", F.lit("no matching permission")))
    )
    allowed = F.coalesce(reason.isin("no policy, vendor in scope", "permission granted"), F.lit(False))
    return out.withColumn("reason", reason).withColumn("allowed", allowed).select(*products.columns, "allowed", "reason")


def _entry(name: str, ok: Column, required: bool, detail: Column | str = "", fail: str = "fail") -> Column:
    passed = F.coalesce(ok, F.lit(False))
    text = F.lit(detail) if isinstance(detail, str) else detail
    return F.struct(F.lit(name).alias("name"), F.when(passed, "pass").otherwise(fail).alias("status"), F.when(passed, "").otherwise(text).alias("detail"), F.lit(required).alias("required"))


def completeness(name: Column, description: Column) -> Column:
    """Whether the input says enough: a name of three characters that is no code, and a description."""
    n = trim(F.coalesce(name, F.lit("")))
    return (F.length(n) >= 3) & ~bare_identifier(n) & blank_to_null(description).isNotNull()


def validations(options: Options = Options()) -> Column:
    """The ordered array of checks of a product against its first candidate.

    Classes are compared only where options.asset_class is set; a class missing on either
    side passes.

    Columns read: allowed, node_iri, node_in_store, name, description, raw, node_class,
    temporal_coverage, node_coverage.
    """
    vendor_class = data_class(F.col("raw"))
    node_class = F.lower(blank_to_null(F.col("node_class"))) if options.asset_class else F.lit(None).cast("string")
    differ = F.coalesce(vendor_class != node_class, F.lit(False))
    name, description = F.coalesce("name", F.lit("")), F.coalesce("description", F.lit(""))
    checks = [
        _entry("scope_compatible", F.col("allowed"), True, "vendor is out of scope"),
        _entry("identifier_resolves", F.col("node_in_store") & blank_to_null(F.col("node_iri")).isNotNull(), True, "node is not in the taxonomy"),
        _entry("data_class_match", ~differ, True, F.concat_ws(" / ", vendor_class, node_class)),
        _entry("name_length", F.length(name) <= NAME_CAP, False, F.concat(F.lit("length "), F.length(name)), "warn"),
        _entry("description_length", F.length(description) <= DESCRIPTION_CAP, False, F.concat(F.lit("length "), F.length(description)), "warn"),
    ]
    if options.input_completeness:
        checks.append(_entry("input_completeness", completeness(F.col("name"), F.col("description")), True, "name or description says too little"))
    if options.temporal:
        covered = temporal.coverage(F.col("temporal_coverage"), F.col("raw"))
        checks.append(temporal.let(temporal.compatible(covered, F.col("node_coverage")), lambda ok: _entry("temporal_compatible", ok, True, "temporal coverage is disjoint")))
    return F.array(*checks)


def blocked(checks: Column) -> Column:
    return F.exists(checks, lambda v: v["required"] & (v["status"] == "fail"))


def band(similarity: Column, options: Options = Options()) -> Column:
    return F.when(similarity >= options.pass_cut, "pass").when(similarity >= options.borderline_cut, "borderline").otherwise("fail")


def decide(rows: DataFrame, options: Options = Options()) -> DataFrame:
    """Adds validations, band, status, confidence, mapped_node_iri, margin and note; the first rule that fits holds.

    rows: one per product with allowed; precedent_iri and precedent_decision where a
    confirmed decision exists; candidates, an array of (iri, similarity), best first; the
    columns of validations(); and, after a specialist ran, pick_iri, pick_score and
    specialist_required.
    """
    first = F.try_element_at("candidates", F.lit(1))
    best = F.col("best")
    iris = F.transform("candidates", lambda c: c["iri"])
    rest = F.array_max(F.transform(F.slice("candidates", F.lit(2), F.greatest(F.size("candidates") - 1, F.lit(0))), lambda c: c["similarity"]))
    low = F.lit(options.borderline_cut - 0.01)
    capped = F.least(best, low)
    offlist = F.col("pick_iri").isNotNull() & ~F.array_contains(iris, F.col("pick_iri"))
    concur = F.col("pick_iri") == F.col("best_iri")
    agreed = F.least(best, F.coalesce(F.col("pick_score"), best))
    on = F.col("band") == "borderline"
    middle = (F.lit(options.pass_cut) + F.lit(options.borderline_cut)) / 2
    staged = (
        rows.withColumn("best", first["similarity"])
        .withColumn("best_iri", first["iri"])
        .withColumn("margin", F.when(F.size("candidates") > 1, F.round(F.col("best") - rest, 6)))
        .withColumn("validations", validations(options))
        .withColumn("band", band(F.col("best"), options))
    )
    bar = F.col("blocked")
    status = (
        F.when(~F.col("allowed"), "out_of_scope")
        .when(F.col("precedent_iri").isNotNull(), F.when(F.col("precedent_decision") == "override", "overridden").otherwise("approved"))
        .when(best.isNull() | bar, "needs_review")
        .when(F.col("band") == "pass", "auto_mapped")
        .when(on & offlist, "needs_review")
        .when(on & F.col("pick_iri").isNull(), F.when(F.coalesce(F.col("specialist_required"), F.lit(False)), "needs_review").when(best >= middle, "auto_mapped").otherwise("needs_review"))
        .when(on & concur, F.when(agreed >= middle, "auto_mapped").otherwise("needs_review"))
        .otherwise("needs_review")
    )
    confidence = F.when(F.col("status").isin("approved", "overridden"), 1.0).when(F.col("status") == "out_of_scope", 0.0).when(on & offlist, capped).when(on & concur, agreed).when(on & F.col("pick_iri").isNotNull(), capped).otherwise(F.coalesce(best, F.lit(0.0)))
    note = F.when(on & offlist, "pick is not among the candidates").when(on & F.col("pick_iri").isNotNull() & ~concur, F.concat(F.lit("alternative "), F.col("pick_iri")))
    out = staged.withColumn("blocked", blocked(F.col("validations"))).withColumn("status", status).withColumn("confidence", confidence).withColumn("note", note)
    if options.margin_gate:
        close = (F.col("status") == "auto_mapped") & (F.size("candidates") >= 2) & (F.col("margin") < options.margin)
        out = out.withColumn("note", F.when(close, "margin too small").otherwise(F.col("note"))).withColumn("status", F.when(close, "needs_review").otherwise(F.col("status")))
    shown = F.when(F.col("status").isin("approved", "overridden", "out_of_scope"), "n/a").when(bar, "fail").otherwise(F.col("band"))
    mapped = F.when(F.col("status").isin("approved", "overridden"), F.col("precedent_iri")).when(F.col("status") != "out_of_scope", F.col("best_iri"))
    return out.withColumn("band", F.coalesce(shown, F.lit("fail"))).withColumn("mapped_node_iri", mapped).drop("best", "best_iri")


def split_settled(products: DataFrame, positives: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Products with a confirmed decision, and those still to be scored; the key is matched exactly."""
    keys = ["vendor", "product_id"]
    held = positives.select(*keys, F.col("node_iri").alias("precedent_iri"), F.col("decision").alias("precedent_decision"))
    return products.join(held, keys), products.join(held, keys, "left_anti")


def list_frames(products: DataFrame, vendor: str, rules: DataFrame, vendors: DataFrame) -> DataFrame:
    """A vendor's products that the scope gate lets through; the name is matched exactly."""
    return scope(products.filter(F.col("vendor") == vendor), rules, vendors).filter("allowed").select(products.columns)


def route(gap: Column, conflict: Column, precedent: Column) -> Column:
    return F.when(gap, "research").when(conflict, "reconcile").when(precedent, "extend").otherwise("new")


def publish(rows: DataFrame) -> DataFrame:
    """Adds outcome and outcome_reason.

    Columns: route, verifier, confidence, self_flag, target_iri, product_iri, minted_iri,
    candidate_iris, triples (array of subject and graph). Hard checks come last and always.
    """
    floor = (F.col("verifier") < VERIFIER_LOW) | (F.col("confidence") < CONFIDENCE_FLOOR) | F.coalesce("self_flag", F.lit(False))
    shaped = F.forall("triples", lambda t: F.coalesce(t["graph"] != "", F.lit(False)) & t["subject"].rlike(r"^[a-z][\w.-]*:\S+$"))
    reason = (
        F.when(F.col("route") == "research", "research never publishes")
        .when(floor, "below the floor")
        .when(F.col("verifier").between(VERIFIER_LOW, VERIFIER_HIGH), "verifier asks for a retry")
        .when(F.size("triples") == 0, "nothing to publish")
        .when(~shaped, "triple without graph or with a foreign identifier")
        .when(~F.col("product_iri").eqNullSafe(F.col("minted_iri")), "identity was not echoed")
        .when(~F.coalesce(F.array_contains("candidate_iris", F.col("target_iri")), F.lit(False)), "target was not offered")
    )
    outcome = F.when(F.col("route") == "research", "research_queued").when(floor, "hitl").when(F.col("verifier").between(VERIFIER_LOW, VERIFIER_HIGH), "retry").when(reason.isNull(), "published").otherwise("rejected")
    return rows.withColumn("outcome", outcome).withColumn("outcome_reason", reason)


def run_batch(units: DataFrame, attempt: Callable[[DataFrame, int], DataFrame], key: str, budget: int = 3, done: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Ledger of units with their final outcome, and counts per pass.

    attempt(pending, pass_no) returns pending with outcome. Units asking for a retry go on
    until the budget ends and are quarantined then. done holds units of an earlier run
    that ended. A pass is one job, and its result is written before the next.
    """
    pending, ended, passes = units.join(done, key, "left_anti") if done is not None else units, [], []
    for n in range(1, budget + 1):
        tried = written(attempt(pending, n).select(*units.columns, "outcome"), "pass")
        counts = {r["outcome"]: r["count"] for r in tried.groupBy("outcome").count().collect()}
        passes.append((n, sum(counts.values()), counts.get("published", 0), counts.get("retry", 0)))
        last = n == budget
        over = tried if last else tried.filter("outcome <> 'retry'")
        final = F.when(F.col("outcome").isin("published", "research_queued"), F.col("outcome")).otherwise("quarantined")
        ended.append(over.select(key, final.alias("outcome"), F.lit(n).alias("pass_no")))
        pending = tried.filter("outcome = 'retry'").select(units.columns)
        if not counts.get("retry"):
            break
    ledger = ended[0]
    for more in ended[1:]:
        ledger = ledger.unionByName(more)
    return ledger, units.sparkSession.createDataFrame(passes, "pass_no int, checked bigint, passed bigint, requeued bigint")


def commit_route(status: Column) -> Column:
    return F.when(status == "out_of_scope", "refuse").when(status.isin("approved", "overridden", "auto_mapped"), "queue_for_review").otherwise("refuse")
