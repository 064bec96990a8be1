"""Strong components of a directed graph by contraction, without a closure.

Each round every node walks along one of its edges, drawn anew by hash; odd rounds walk
backwards. Doubling finds in a logarithm of steps where all walks end: in a cycle, which is
part of one strong component and becomes a single node, or in a node without a way on. A
node all of whose ways are forced and end so lies on no cycle, and a whole chain of such
nodes goes at once. Where a round takes away little, as in one large, well connected component,
the next one spreads colours instead: each node passes the highest priority that reaches it
on for a bounded number of steps, and the nodes of a colour that lead back to the node that
gave it are in its component. Both only ever join nodes that reach each other, so the order
of rounds decides nothing.

Before the first round the edges are dealt out in ranges of node ids, and a task contracts the
strong components of the edges it holds, BLOCK at a time; that settles cycles of neighbouring ids.
Once the edges that are left fit into one block, that block settles them all.

A chain of cycles halves in each round, however long it is, and so does a long chain of
nodes; a large component of small diameter takes one round of colours. What still takes a round
for each layer is an acyclic part with branching in both directions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..runtime import written

#: Share of the nodes that a round of walks has to take away; below it a round of colours follows.
SHRINK = 0.1
#: Most steps that a colour spreads, forwards and backwards.
SPREAD = 32
#: Edges that a task holds to contract their strong components.
BLOCK = 1 << 18


def _walks(edges: DataFrame, seed: int) -> DataFrame:
    """node, to, low, forced, stop and sink: where each node's walk along drawn edges (a, b) ends, and the least node on it.

    forced: no other way existed on it. stop: it ended in a sink, a node without edges out.
    """
    drawn = edges.groupBy(F.col("a").alias("node")).agg(F.min_by("b", F.xxhash64("a", "b", F.lit(seed))).alias("to"), (F.count(F.lit(1)) == 1).alias("forced"))
    starts = drawn.withColumns({"stop": F.lit(False), "sink": F.lit(False)})
    sinks = edges.select(F.col("b").alias("node")).distinct().join(drawn, "node", "left_anti").select("node", F.col("node").alias("to"), F.lit(True).alias("forced"), F.lit(True).alias("stop"), F.lit(True).alias("sink"))
    walk, ends = written(starts.unionByName(sinks).withColumn("low", F.least("node", "to")), "walks"), None
    while True:
        seen = Observation()
        further = _onward(_onward(walk.withColumns({"low0": F.col("low"), "stop0": F.col("stop")})))
        counted = further.observe(seen, F.count_if((F.col("low") < F.col("low0")) | (F.col("stop") != F.col("stop0"))).alias("changed"))
        walk = written(counted.drop("low0", "stop0"), "walks")
        if seen.get["changed"]:
            continue
        now = walk.agg(F.count_distinct("to")).first()[0]  # as long as it falls, some walk has not come to its end
        if now == ends:
            return walk
        ends = now


def _onward(walk: DataFrame) -> DataFrame:
    """The walks twice as far."""
    rest = walk.select(F.col("node").alias("to"), F.col("to").alias("next"), F.col("low").alias("low2"), F.col("forced").alias("forced2"), F.col("stop").alias("stop2"))
    return walk.join(rest, "to").select("node", F.col("next").alias("to"), F.least("low", "low2").alias("low"), (F.col("forced") & F.col("forced2")).alias("forced"), F.col("stop2").alias("stop"), "sink", "low0", "stop0")


def _colours(edges: DataFrame, seed: int) -> DataFrame:
    """node and rep of nodes that the colours of a round put into one component."""
    nodes = edges.select(F.col("a").alias("node")).unionByName(edges.select(F.col("b").alias("node"))).distinct()
    painted = written(nodes.withColumn("colour", F.struct(F.xxhash64("node", F.lit(seed)).alias("p"), F.col("node").alias("id"))), "colours")
    for _ in range(SPREAD):
        given = edges.join(painted.withColumnRenamed("node", "a"), "a").groupBy(F.col("b").alias("node")).agg(F.max("colour").alias("given"))
        new = painted.join(given, "node", "left").select("node", F.greatest("colour", F.coalesce("given", "colour")).alias("colour"), (F.col("given") > F.col("colour")).alias("changed"))
        new = written(new, "colours")
        moved = new.agg(F.count_if("changed")).first()[0]
        painted = new.drop("changed")
        if not moved:
            break
    of = painted.select("node", F.col("colour.id").alias("colour"))
    inside = written(edges.join(of.select(F.col("node").alias("a"), F.col("colour").alias("ca")), "a").join(of.select(F.col("node").alias("b"), F.col("colour").alias("cb")), "b").filter("ca = cb").select("a", "b"), "inside")
    reached = fresh = of.filter("node = colour").select("node")
    for _ in range(SPREAD):
        back = inside.join(fresh.select(F.col("node").alias("b")), "b", "left_semi").select(F.col("a").alias("node")).distinct()
        fresh = written(back.join(reached, "node", "left_anti"), "fresh")
        if fresh.isEmpty():
            break
        reached = written(reached.unionByName(fresh), "reached")
    members = of.join(reached, "node", "left_semi")
    groups = members.groupBy("colour").agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    return members.join(groups, "colour").select("node", "rep")


def _strong(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The least node of each node's strong component (Tarjan, without recursion); a is sorted."""
    first, after = np.searchsorted(a, np.arange(n)).tolist(), np.searchsorted(a, np.arange(n), "right").tolist()
    to, seen, low, rep, open_, count = b.tolist(), [0] * n, [0] * n, [-1] * n, [], 0
    for root in range(n):
        path = [root] if not seen[root] else []
        while path:
            node = path[-1]
            if not seen[node]:
                count += 1
                seen[node] = low[node] = count
                open_.append(node)
            deeper = False
            while first[node] < after[node]:
                other = to[first[node]]
                if not seen[other]:
                    path.append(other)
                    deeper = True
                    break
                if rep[other] < 0:
                    low[node] = min(low[node], low[other])
                first[node] += 1
            if deeper:
                continue
            path.pop()
            if low[node] == seen[node]:
                own = []
                while not own or own[-1] != node:
                    own.append(open_.pop())
                least = min(own)
                for other in own:
                    rep[other] = least
    return np.array(rep, np.int64)


def _contracted(edges: pa.Table) -> pa.Table:
    """node and rep of the nodes that are not the least of their strong component in these edges."""
    names = pc.unique(pa.chunked_array(edges["a"].chunks + edges["b"].chunks))
    names = names.take(pc.sort_indices(names))
    a, b = (pc.index_in(edges[c], value_set=names).to_numpy().astype(np.int64) for c in "ab")
    order = np.argsort(a, kind="stable")
    rep = _strong(a[order], b[order], len(names))
    moved = np.flatnonzero(rep != np.arange(len(names)))
    return pa.table([names.take(pa.array(moved)), names.take(pa.array(rep[moved]))], ["node", "rep"])


def _near(edges: DataFrame, count: int) -> DataFrame:
    """node and rep of nodes in strong components of the edges of one block; all edges are one block if they fit.

    A node in such a component has all its edges out in one range, and they are taken into one
    block, up to BLOCK of them: an edge that is left out hides a component and never makes one.
    """
    block, parts = BLOCK, -(-count // BLOCK)
    kind = dict(edges.dtypes)["a"]
    dealt = edges.coalesce(1) if parts <= 1 else edges.repartitionByRange(parts, "a").sortWithinPartitions("a")

    def run(batches):
        held, size, last = [], 0, None
        for batch in batches:
            for low in range(0, batch.num_rows, block):
                piece = pa.Table.from_batches([batch.slice(low, block)])
                if parts > 1 and size + piece.num_rows > block and held:
                    ends = pc.not_equal(piece["a"], last)  # the rest of the last node's edges stay with it
                    rest = piece.filter(pc.invert(ends)).slice(0, max(0, block - size))
                    held.append(rest)
                    size += rest.num_rows
                    piece = piece.filter(ends)
                    if piece.num_rows:
                        yield from _contracted(pa.concat_tables(held)).to_batches()
                        held, size = [], 0
                if piece.num_rows:
                    held.append(piece)
                    size += piece.num_rows
                    last = piece["a"][-1]
        if held:
            yield from _contracted(pa.concat_tables(held)).to_batches()

    return dealt.mapInArrow(run, f"node {kind}, rep {kind}")


def cyclic_components(edges: DataFrame, child: str = "child", parent: str = "parent") -> DataFrame:
    """node and component (its least node) of every strong component with over one node, and of nodes with a self loop.

    Null ends are ignored and repeated edges count once. An empty table gives no rows.
    """
    known = edges.select(F.col(child).alias("a"), F.col(parent).alias("b")).filter("a IS NOT NULL AND b IS NOT NULL").distinct()
    known = written(known, "edges")
    loops = known.filter("a = b").select(F.col("a").alias("node"))
    core, merged, turn, slow = known.filter("a <> b"), [], 0, False
    left, last = core.count(), False
    while left:
        seen, kept = Observation(), Observation()
        if not turn or left <= BLOCK:
            last = left <= BLOCK
            nodes = core.select(F.col("a").alias("node")).unionByName(core.select(F.col("b").alias("node"))).distinct()
            fate = nodes.join(written(_near(core, left), "near"), "node", "left").select("node", F.coalesce("rep", "node").alias("rep"), F.lit(False).alias("gone"))
        elif slow:
            nodes = core.select(F.col("a").alias("node")).unionByName(core.select(F.col("b").alias("node"))).distinct()
            fate = nodes.join(_colours(core, turn), "node", "left").select("node", F.coalesce("rep", "node").alias("rep"), F.lit(False).alias("gone"))
        else:
            walk = _walks(core.select(F.col("b").alias("a"), F.col("a").alias("b")) if turn % 2 == 0 else core, turn)
            ends = walk.select(F.col("to").alias("node")).distinct().withColumn("end", F.lit(True))
            fate = walk.join(ends, "node", "left").select("node", F.when(F.col("end") & ~F.col("sink"), F.col("low")).otherwise(F.col("node")).alias("rep"), (F.col("forced") & F.col("stop")).alias("gone"))
        fate = written(fate.observe(seen, F.count(F.lit(1)).alias("all"), F.count_if(F.col("gone") | (F.col("node") != F.col("rep"))).alias("lost")), "fate")
        slow, turn = bool(turn) and not slow and seen.get["lost"] < SHRINK * seen.get["all"], turn + 1
        merged.append(fate.filter("NOT gone").select("node", "rep"))
        if last:  # what one block held is settled
            break
        own = fate.filter("NOT gone")
        for end in ("a", "b"):
            core = core.join(own.select(F.col("node").alias(end), F.col("rep").alias(f"{end}_rep")), end)
        ahead = core.filter("a_rep <> b_rep").select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")).distinct()
        core = written(ahead.observe(kept, F.count(F.lit(1)).alias("edges")), "core")
        left = kept.get["edges"]
    found = None
    for same in reversed(merged):  # later rounds tell what became of the nodes of earlier ones
        if found is None:
            found = same
            continue
        became = found.select(F.col("node").alias("rep"), F.col("rep").alias("last"))
        found = written(same.join(became, "rep", "left").select("node", F.coalesce("last", "rep").alias("rep")).unionByName(found).distinct(), "found")
    alone = loops.select("node", F.col("node").alias("component"))
    if found is None:
        return alone
    sizes = found.groupBy("rep").agg((F.count(F.lit(1)) > 1).alias("strong"))
    strong = found.join(sizes.filter("strong"), "rep").select("node", F.col("rep").alias("component"))
    return strong.unionByName(alone.join(strong, "node", "left_anti"))
