"""Taxonomy graphs: extraction from triples, closure, paths, ancestors, components, ranks and diagnostics.

Edges are (child, parent). Iterations keep only new pairs, write each round, and end when
a round adds nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import definition
from ..runtime import written
from .components import connected_components
from .cycles import cyclic_components  # noqa: F401  one of the graph operators

SKOS, DCT, RDFS = "http://www.w3.org/2004/02/skos/core#", "http://purl.org/dc/terms/", "http://www.w3.org/2000/01/rdf-schema#"
DCAT, OWL, RDF = "http://www.w3.org/ns/dcat#", "http://www.w3.org/2002/07/owl#", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
DEPTH, NODES = 3, 100
#: Rounds of a rank iteration that run as one plan.
STEPS = 8


def nodes_from_quads(quads: DataFrame) -> DataFrame:
    """One node per typed subject: iri, label, definition, alt_labels, node_kind, parent_iri, superclass_iris, superproperty_iris.

    Labels are taken by the order of their predicates, then alphabetically; the tail of
    the identifier stands in. All values of a subject are gathered in one aggregation.
    """
    p, o = F.col("predicate"), F.col("object")
    labels = [SKOS + "prefLabel", DCT + "title", RDFS + "label", DCT + "identifier"]
    rank = reduce(lambda acc, x: acc.when(p == x[1], x[0]), enumerate(labels), F.when(F.lit(False), 0))
    kind = F.when((p == RDF + "type") & (o.isin(OWL + "ObjectProperty", OWL + "DatatypeProperty", RDF + "Property")), 0).when((p == RDF + "type") & o.isin(OWL + "Class", RDFS + "Class"), 1).when((p == RDF + "type") & o.isin(SKOS + "Concept", DCAT + "Dataset"), 2)

    def values(*predicates: str) -> Column:
        return F.array_sort(F.collect_set(F.when(p.isin(*predicates), o)))

    grouped = quads.groupBy("subject").agg(
        F.min_by(o, F.when(rank.isNotNull(), F.struct(rank.alias("r"), o.alias("o")))).alias("label"),
        F.min(kind).alias("kind"),
        *(values(*names).alias(a) for a, names in (("defs", (SKOS + "definition", DCT + "description", RDFS + "comment")), ("notes", (SKOS + "scopeNote",)), ("examples", (SKOS + "example",)), ("alt_labels", (SKOS + "altLabel", DCAT + "keyword")), ("broader", (SKOS + "broader",)), ("superclass_iris", (RDFS + "subClassOf", DCAT + "theme")), ("superproperty_iris", (RDFS + "subPropertyOf",)))),
    )
    return grouped.filter("kind IS NOT NULL").select(
        F.col("subject").alias("iri"),
        F.coalesce("label", F.element_at(F.split("subject", "[:/#]"), -1)).alias("label"),
        definition(F.array_join("defs", " "), F.array_join("notes", " "), F.array_join("examples", " ")).alias("definition"),
        "alt_labels",
        F.element_at(F.array(*map(F.lit, ("property", "class", "concept"))), F.col("kind") + 1).alias("node_kind"),
        F.try_element_at("broader", F.lit(1)).alias("parent_iri"),
        "superclass_iris",
        "superproperty_iris",
    )


def edges_of(nodes: DataFrame) -> DataFrame:
    """child, parent and relation of every reference upwards."""
    one = nodes.filter("parent_iri IS NOT NULL").select(F.col("iri").alias("child"), F.col("parent_iri").alias("parent"), F.lit("parent").alias("relation"))
    more = [nodes.select(F.col("iri").alias("child"), F.explode(c).alias("parent"), F.lit(r).alias("relation")) for c, r in (("superclass_iris", "superclass"), ("superproperty_iris", "superproperty")) if c in nodes.columns]
    return reduce(DataFrame.unionByName, more, one).distinct()


def wire_children(nodes: DataFrame) -> DataFrame:
    """Nodes with children_iris: those declared and those that refer upwards to them, sorted."""
    declared = nodes.select(F.col("iri").alias("parent"), F.explode("children_iris").alias("child")) if "children_iris" in nodes.columns else None
    found = edges_of(nodes).select("parent", "child")
    found = found.unionByName(declared) if declared is not None else found
    grouped = found.groupBy(F.col("parent").alias("iri")).agg(F.array_sort(F.collect_set("child")).alias("children_iris"))
    base = nodes.drop("children_iris")
    return base.join(grouped, "iri", "left").withColumn("children_iris", F.coalesce("children_iris", F.array().cast("array<string>")))


def closure(edges: DataFrame, max_depth: int | None = None, of: DataFrame | None = None) -> DataFrame:
    """node, ancestor and the least depth at which it is reached, itself left out; of all nodes, or of those in of (node)."""
    step = written(edges.select("child", "parent").filter("child IS NOT NULL AND parent IS NOT NULL").distinct(), "edges")
    first = step if of is None else step.join(of.select(F.col("node").alias("child")), "child", "left_semi")
    found = written(first.filter("child <> parent").select(F.col("child").alias("node"), F.col("parent").alias("ancestor"), F.lit(1).alias("depth")), "closure")
    fresh, depth = found, 1
    while max_depth is None or depth < max_depth:
        depth += 1
        reached = fresh.join(step, F.col("ancestor") == F.col("child")).select("node", F.col("parent").alias("ancestor")).filter("node <> ancestor").distinct()
        fresh = written(reached.join(found, ["node", "ancestor"], "left_anti").withColumn("depth", F.lit(depth)), "fresh")
        if fresh.isEmpty():
            break
        found = found.unionByName(fresh)
    return found


def materialise_closure(nodes: DataFrame, max_depth: int) -> DataFrame:
    """Nodes with all_superclass_iris and all_superproperty_iris: ancestors by their own kind, and the direct references."""
    up = closure(edges_of(nodes), max_depth)
    kinds = nodes.select(F.col("iri").alias("ancestor"), "node_kind")
    by_kind = up.join(kinds, "ancestor").groupBy(F.col("node").alias("iri")).agg(
        F.collect_set(F.when(F.col("node_kind") != "property", F.col("ancestor"))).alias("c"), F.collect_set(F.when(F.col("node_kind") == "property", F.col("ancestor"))).alias("p")
    )
    none = F.array().cast("array<string>")
    joined = nodes.join(by_kind, "iri", "left")
    own = lambda direct, all_: F.array_sort(F.array_union(F.coalesce(direct, none), F.coalesce(all_, none)))
    return joined.withColumn("all_superclass_iris", own("superclass_iris", "c")).withColumn("all_superproperty_iris", own("superproperty_iris", "p")).drop("c", "p")


def neighbourhood(edges: DataFrame, root, max_depth: int = DEPTH, max_paths: int = NODES) -> DataFrame:
    """Edges (parent, child, depth) down from a root, at most max_depth deep and max_paths paths in their order."""
    depth, cap = max(1, min(max_depth, DEPTH)), max(1, min(max_paths, NODES))
    down = edges.select("parent", "child").distinct()
    level = down.filter(F.col("parent") == F.lit(root)).select("parent", "child", F.array("child").alias("path"))
    levels = [level]
    for _ in range(depth - 1):
        step = down.select(F.col("parent").alias("p"), F.col("child").alias("c"))
        level = level.join(step, F.col("child") == F.col("p")).filter(~F.array_contains("path", F.col("c"))).select(F.col("p").alias("parent"), F.col("c").alias("child"), F.array_append("path", F.col("c")).alias("path"))
        levels.append(level)
    paths = reduce(DataFrame.unionByName, levels).orderBy(F.size("path"), "path").limit(cap)
    return paths.groupBy("parent", "child").agg(F.min(F.size("path")).alias("depth"))


def node_detail(nodes: DataFrame, iri: str) -> DataFrame:
    """A node with its parent's label and its children."""
    one = nodes.filter(F.col("iri") == iri)
    parents = nodes.select(F.col("iri").alias("parent_iri"), F.col("label").alias("parent_label"))
    children = nodes.filter(F.col("parent_iri") == iri).agg(F.array_sort(F.collect_set("iri")).alias("child_iris"))
    return one.join(parents, "parent_iri", "left").join(F.broadcast(children))  # one row


def attached(nodes: DataFrame, edges: DataFrame, anchor: str, cap: int = NODES) -> tuple[DataFrame, DataFrame]:
    """Enrichment nodes that name the anchor, in the order of their identifiers up to a cap, and the edges among them."""
    own = nodes.filter(F.col("anchor_iri") == anchor).orderBy("iri").limit(max(1, min(cap, NODES)))
    return own, induced(own.select("iri"), edges)


def induced(kept: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with both ends in kept."""
    left, right = kept.select(F.col("iri").alias("child")), kept.select(F.col("iri").alias("parent"))
    return edges.join(left, "child", "left_semi").join(right, "parent", "left_semi")


def check_bounds(nodes: DataFrame, edges: DataFrame, max_nodes: int = 100, max_edges: int = 500, max_iri: int = 512, max_list: int = 25) -> None:
    """Raise ValueError where a graph or a list of a node exceeds its bounds; each count stops one above its bound."""
    if nodes.limit(max_nodes + 1).count() > max_nodes:
        raise ValueError(f"more than {max_nodes} nodes")
    if edges.limit(max_edges + 1).count() > max_edges:
        raise ValueError(f"more than {max_edges} edges")
    if not nodes.filter(F.length("iri") > max_iri).isEmpty():
        raise ValueError(f"an identifier is longer than {max_iri}")
    for name in ("superclass_iris", "superproperty_iris", "children_iris", "alt_labels"):
        if name in nodes.columns and not nodes.filter(F.size(name) > max_list).isEmpty():
            raise ValueError(f"a node has more than {max_list} entries in {name}")


def diagnostics(nodes: DataFrame, limit: int = 100) -> DataFrame:
    """issue, source, target: missing references, then references across kinds and asymmetric children, sorted, limit rows in all."""
    kind = nodes.select(F.col("iri").alias("target"), F.when(F.col("node_kind") == "property", "property").otherwise("class").alias("target_kind"))
    refs = edges_of(nodes).select(F.col("child").alias("source"), F.col("parent").alias("target"), "relation")
    declared = nodes.select(F.col("iri").alias("source"), F.explode("children_iris").alias("target"), F.lit("child").alias("relation"))
    own = nodes.select(F.col("iri").alias("source"), F.when(F.col("node_kind") == "property", "property").otherwise("class").alias("source_kind"))
    joined = refs.unionByName(declared).distinct().join(own, "source").join(kind, "target", "left")
    missing = joined.filter("target_kind IS NULL").select(F.lit(0).alias("o"), F.lit("missing_reference").alias("issue"), "source", "target")
    crossed = joined.filter("target_kind <> source_kind").select(F.lit(1).alias("o"), F.lit("cross_hierarchy").alias("issue"), "source", "target")
    upward = refs.select(F.col("target").alias("source"), F.col("source").alias("target"))
    asymmetric = declared.select("source", "target").distinct().join(upward, ["source", "target"], "left_anti").join(kind.select("target"), "target", "left_semi").select(F.lit(2).alias("o"), F.lit("asymmetric_child").alias("issue"), "source", "target")
    return missing.unionByName(crossed).unionByName(asymmetric).distinct().orderBy("o", "source", "target").limit(limit).drop("o")


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, component and orphan (without any edge) of every node."""
    found = connected_components(edges.filter("child <> parent"), "child", "parent")
    joined = nodes.select(F.col("iri").alias("node")).join(found, "node", "left")
    return joined.select("node", F.coalesce("component", "node").alias("component"), F.col("component").isNull().alias("orphan"))


def shortest_paths(edges: DataFrame, pairs: DataFrame, max_depth: int | None = None) -> DataFrame:
    """source, target, path and length of a shortest undirected path of each pair; the first path in order among equal ones."""
    both = written(edges.select(F.col("child").alias("a"), F.col("parent").alias("b")).unionByName(edges.select(F.col("parent").alias("a"), F.col("child").alias("b"))).filter("a <> b").distinct(), "edges")
    wanted = written(pairs.select("source", "target").distinct(), "pairs")
    front = wanted.select("source").distinct().select("source", F.col("source").alias("at"), F.array("source").alias("path"))
    seen, done, depth = front, [], 0
    while True:
        done.append(front.join(wanted, (front["source"] == wanted["source"]) & (front["at"] == wanted["target"])).select(front["source"], F.col("at").alias("target"), "path"))
        if max_depth is not None and depth >= max_depth:
            break
        depth += 1
        grown = front.join(both, F.col("at") == F.col("a")).select("source", F.col("b").alias("at"), F.array_append("path", F.col("b")).alias("path"))
        front = written(grown.groupBy("source", "at").agg(F.min("path").alias("path")).join(seen, ["source", "at"], "left_anti"), "front")
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    found = reduce(DataFrame.unionByName, done).withColumn("length", F.size("path") - 1)
    return found


def truncated_ancestry(edges: DataFrame, nodes: DataFrame, max_depth: int) -> DataFrame:
    """node and ancestry_truncated: whether a node has ancestors beyond max_depth."""
    up = closure(edges, max_depth + 1, nodes.select("node"))
    beyond = up.groupBy("node").agg((F.max("depth") > max_depth).alias("ancestry_truncated"))
    return nodes.select("node").join(beyond, "node", "left").select("node", F.coalesce("ancestry_truncated", F.lit(False)).alias("ancestry_truncated"))


def ancestor_distances(edges: DataFrame, max_depth: int | None = None) -> DataFrame:
    return closure(edges, max_depth)


def lowest_common_ancestors(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, lca and the two distances: common ancestors (a node counts as its own) above no other common one, the nearest of them.

    Nearest is the least sum of distances, then the least larger one, then the identifier.
    """
    wanted = written(pairs.select("a", "b").distinct(), "pairs")
    ends = written(wanted.select(F.col("a").alias("node")).unionByName(wanted.select(F.col("b").alias("node"))).distinct(), "ends")
    up = closure(edges, of=ends)
    lines = written(up.unionByName(ends.select("node", F.col("node").alias("ancestor"), F.lit(0).alias("depth"))), "lines")
    left = lines.select(F.col("node").alias("a"), F.col("ancestor").alias("lca"), F.col("depth").alias("da"))
    right = lines.select(F.col("node").alias("b"), F.col("ancestor").alias("lca"), F.col("depth").alias("db"))
    common = written(wanted.join(left, "a").join(right, ["b", "lca"]), "common")
    # what lies above a common ancestor: only those are closed, not all nodes
    over = closure(edges, of=common.select(F.col("lca").alias("node")).distinct())
    above = common.join(over.select(F.col("node").alias("lca"), F.col("ancestor").alias("over")), "lca").select("a", "b", F.col("over").alias("lca")).distinct()
    lowest = common.join(above, ["a", "b", "lca"], "left_anti")
    key = F.struct(F.col("da") + F.col("db"), F.greatest("da", "db"), F.col("lca"))
    best = lowest.groupBy("a", "b").agg(F.min_by(F.struct("lca", "da", "db"), key).alias("r"), F.count(F.lit(1)).alias("n_lowest"))
    return best.select("a", "b", F.col("r.lca").alias("lca"), F.col("r.da").alias("distance_a"), F.col("r.db").alias("distance_b"), "n_lowest")


def pagerank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, tolerance: float = 1e-10, max_iterations: int = 200) -> tuple[DataFrame, bool]:
    """node and rank of a personalised PageRank over undirected edges, and whether it converged.

    Seeds share the restart mass and that of nodes without edges evenly. A node with one
    edge that is no seed has the same rank as its neighbour's others of that kind, so
    they are a number and a rank of the neighbour, and only the other nodes and their edges
    take part in the rounds. Each round is two aggregations; it is written, and the change
    over all nodes decides on the next. Ranks that did not converge should not be used.
    """
    both = written(edges.select(F.col("child").alias("a"), F.col("parent").alias("b")).unionByName(edges.select(F.col("parent").alias("a"), F.col("child").alias("b"))).filter("a <> b").distinct(), "edges")
    spec = "node string" if dict(both.dtypes)["a"] == "string" else "node bigint"
    start = seeds.select(F.col(seeds.columns[0]).cast(spec.split()[1]).alias("node")).distinct()
    n_seeds = start.count()
    if not n_seeds:
        raise ValueError("no seeds")
    ends = both.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.min("b").alias("hub"))
    marked = start.withColumn("seed", F.lit(True)).join(ends, "node", "full").select("node", F.coalesce("seed", F.lit(False)).alias("seed"), F.coalesce("degree", F.lit(0)).alias("degree"), "hub")
    marked = written(marked, "marked")
    leaves = marked.filter("degree = 1 AND NOT seed").select("node", "hub")
    inner = written(both.join(leaves.select(F.col("node").alias("a")), "a", "left_anti").join(leaves.select(F.col("node").alias("b")), "b", "left_anti").select("a", "b"), "inner")
    held = leaves.groupBy(F.col("hub").alias("node")).agg(F.count(F.lit(1)).alias("leaves"))
    base = marked.filter("degree <> 1 OR seed").join(held, "node", "left").select("node", "seed", "degree", F.coalesce("leaves", F.lit(0)).alias("leaves"))
    restart = F.when(F.col("seed"), 1.0 / n_seeds).otherwise(0.0)
    ranks = written(base.withColumns({"rank": restart, "leaf": F.lit(0.0)}), "ranks")
    isolated = not ranks.filter("degree = 0").isEmpty()
    steps, done, converged = (1 if isolated else STEPS), 0, False  # the mass of isolated seeds is an aggregate of its own
    while done < max_iterations and not converged:
        for step in range(steps):
            loose = ranks.filter("degree = 0").agg(F.sum("rank")).first()[0] if isolated else 0.0
            share = F.col("rank") / F.nullif("degree", F.lit(0))
            given = ranks.filter("degree > 0").select(F.col("node").alias("a"), share.alias("share")).join(inner, "a").groupBy(F.col("b").alias("node")).agg(F.sum("share").alias("got"))
            new = damping * (F.coalesce("got", F.lit(0.0)) + F.col("leaves") * F.col("leaf")) + (1 - damping + damping * loose) * restart
            following = ranks.join(given, "node", "left").select("node", "seed", "degree", "leaves", new.alias("rank"), F.when(F.col("leaves") > 0, damping * share).otherwise(0.0).alias("leaf"), F.col("rank").alias("old"), F.col("leaf").alias("old_leaf"))
            ranks = following if step + 1 == steps else following.drop("old", "old_leaf")
        done += steps
        ranks = written(ranks, "ranks")
        change = ranks.agg(F.sum(F.abs(F.col("rank") - F.col("old")) + F.col("leaves") * F.abs(F.col("leaf") - F.col("old_leaf")))).first()[0]
        ranks, converged = ranks.drop("old", "old_leaf"), (change or 0.0) < tolerance
    total = ranks.agg(F.sum(F.col("rank") + F.col("leaves") * F.col("leaf"))).first()[0] or 1.0
    # Two nodes with no edge but their own and no seed are each other's leaf: nothing reaches them.
    outer = leaves.join(ranks.filter("leaves > 0").select(F.col("node").alias("hub"), "leaf"), "hub", "left").select("node", F.coalesce("leaf", F.lit(0.0)).alias("rank"))
    return ranks.select("node", "rank").unionByName(outer).select("node", F.round(F.col("rank") / total, 15).alias("rank")), converged


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, degree, n_children, n_parents and whether it has several parents."""
    down = edges.groupBy(F.col("parent").alias("node")).agg(F.countDistinct("child").alias("n_children"))
    up = edges.groupBy(F.col("child").alias("node")).agg(F.countDistinct("parent").alias("n_parents"))
    joined = nodes.select(F.col("iri").alias("node")).join(down, "node", "left").join(up, "node", "left").fillna(0)
    return joined.select("node", (F.col("n_children") + F.col("n_parents")).alias("degree"), "n_children", "n_parents", (F.col("n_parents") > 1).alias("ambiguous"))


def project_enrichment(nodes: DataFrame) -> DataFrame:
    """Enrichment nodes as taxonomy nodes; those on rights drop out."""
    kept = nodes.filter(~F.coalesce(F.col("kind").isin("permission", "prohibition", "duty", "policy", "constraint"), F.lit(False)))
    kind = F.when(F.col("kind").isin("property", "attribute", "column"), "property").when(F.col("kind").isin("class", "entity", "table"), "class").otherwise("concept")
    return kept.select("iri", F.coalesce("title", F.element_at(F.split("iri", "[:/#]"), -1)).alias("label"), definition(F.col("definition"), F.col("notes")).alias("definition"), kind.alias("node_kind"))


def mapping_quads(mappings: DataFrame, graph: str) -> DataFrame:
    """Quads of mappings: type, description, theme, version, attribution and a link; absent values give none."""
    facts = F.array(*(
        F.struct(F.lit(predicate).alias("predicate"), value.cast("string").alias("object"), F.lit(is_iri).alias("object_is_iri"))
        for predicate, value, is_iri in (
            (RDF + "type", F.lit(DCAT + "Dataset"), True), (DCT + "description", F.left("rationale", F.lit(200)), False), (DCAT + "theme", F.col("mapped_node_iri"), True),
            (DCAT + "version", F.col("version"), False), (DCT + "creator", F.col("decided_by"), False), (RDFS + "seeAlso", F.col("see_also"), True),
        )
    ))
    rows = mappings.select(F.col("product_iri").alias("subject"), F.explode(facts).alias("f")).select("subject", "f.*").filter("object IS NOT NULL")
    return rows.withColumn("graph", F.lit(graph))


def shape_errors(quads: DataFrame) -> DataFrame:
    """Quads that lack a part."""
    missing = [F.coalesce(F.trim(c), F.lit("")) == "" for c in ("subject", "predicate", "object", "graph")]
    return quads.filter(reduce(lambda a, b: a | b, missing))


def match_payload(taxonomy: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label, kind, colour) and edges (source, target, relation) of a match graph."""
    colour = F.when(F.col("band") == "pass", "green").when(F.col("band") == "borderline", "amber").otherwise("red")
    products = matches.select(F.col("product_iri").alias("id"), F.col("product_name").alias("label"), F.lit("product").alias("kind"), colour.alias("colour"))
    nodes = taxonomy.select(F.col("iri").alias("id"), "label", F.lit("taxonomy").alias("kind"), F.lit("grey").alias("colour")).unionByName(products).dropDuplicates(["id"])
    mapped = matches.filter("mapped_node_iri IS NOT NULL").select(F.col("product_iri").alias("source"), F.col("mapped_node_iri").alias("target"), F.lit("maps_to").alias("relation"))
    tree = taxonomy.filter("parent_iri IS NOT NULL").select(F.col("iri").alias("source"), F.col("parent_iri").alias("target"), F.lit("parent").alias("relation"))
    return nodes, tree.unionByName(mapped)
