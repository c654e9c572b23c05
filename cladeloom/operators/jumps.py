"""Trees by jump pointers, without listing every ancestor of every node.

Level k of the pointers leads 2**k steps up (or to the root, where the path is shorter), so a tree of height h has
log2(h) + 2 levels of one row per node, also when it is a ladder.  Everything else follows in as many rounds:

* sums over a subtree: what lies less than 2**(k+1) steps below a node lies less than 2**k steps below it or
  below a node exactly 2**k steps down, so each round adds one row per node;
* sums along the path to the root, by the same doubling;
* depth-first numbers: a node starts after its earlier siblings' subtrees, added up along its path, so that a subtree
  is an interval of numbers;
* lowest common ancestors: the parent of the node nearest to the root among those numbered after the group's first
  member up to its last; minima over any interval come from chunks of consecutive numbers, chunks of their minima and
  so on, of which an interval touches two a level, all in one join.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from cladeloom.operators.ordered import running_sums
from cladeloom.session import materialize


#: Nodes (or minima) of a chunk.
CHUNK = 512
#: Rounds of doubling in one job.
ROUNDS = 2


@dataclass(frozen=True)
class Tree:
    """Edges (parent, child, length), pointer levels (node, at, steps, length) and one index row per node."""

    edges: DataFrame
    levels: tuple[DataFrame, ...]
    index: DataFrame


def check_round(rounds: int, edges: int) -> None:
    """Paths of 2**rounds steps exist only where there are as many edges, unless nodes are visited twice."""
    if 2 ** rounds > 2 * max(edges, 1):
        raise ValueError("the edge table has a cycle")


def jump_levels(edges: DataFrame) -> tuple[DataFrame, ...]:
    """Pointer levels; in the last one every pointer has reached its root. A cycle raises."""
    limit = edges.count()
    levels = [materialize(edges.select(F.col("child").alias("node"), F.col("parent").alias("at"), F.lit(1).cast("long").alias("steps"), "length"))]
    while levels[-1].where(F.col("steps") == 2 ** (len(levels) - 1)).limit(1).count():
        check_round(len(levels), limit)
        ahead = levels[-1].select(F.col("node").alias("at"), F.col("at").alias("_at"), F.col("steps").alias("_steps"), F.col("length").alias("_length"))
        j = levels[-1].hint("shuffle_merge").join(ahead, "at", "left")  # never through the driver
        levels.append(materialize(j.select("node", F.coalesce("_at", "at").alias("at"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"),
                                           F.when(F.col("_at").isNull(), F.col("length")).otherwise(F.col("length") + F.col("_length")).alias("length"))))
    return tuple(levels)


def full_jumps(levels: Sequence[DataFrame], k: int) -> DataFrame:
    """(node, at): the ancestors exactly 2**k steps up."""
    return levels[k].where(F.col("steps") == 2 ** k).select("node", "at")


def fold_below(levels: Sequence[DataFrame], values: DataFrame, sums: Sequence[str] = (), maxes: Sequence[str] = ()) -> DataFrame:
    """Per node with data at or below it: sums and maxima of the columns over the node and all below."""
    cols = [*sums, *maxes]
    aggs = [*[F.sum(c).alias(c) for c in sums], *[F.max(c).alias(c) for c in maxes]]
    acc = values.select("node", *cols)
    for k in range(len(levels) - 1):
        far = full_jumps(levels, k).join(acc, "node").select(F.col("at").alias("node"), *cols)
        acc = _every(k, levels, acc.unionByName(far).groupBy("node").agg(*aggs))
    return acc


def _every(k: int, levels: Sequence[DataFrame], df: DataFrame) -> DataFrame:
    """Cuts the lineage after every few rounds and after the last."""
    return materialize(df) if k % ROUNDS == ROUNDS - 1 or k == len(levels) - 2 else df


def sum_above(levels: Sequence[DataFrame], values: DataFrame, col: str) -> DataFrame:
    """(node, col): the column summed along the path from every node up to and without its root."""
    acc = levels[0].select("node").join(values.select("node", col), "node")
    for k in range(len(levels) - 1):
        far = full_jumps(levels, k).join(acc.select(F.col("node").alias("at"), col), "at").select("node", col)
        # a sum of both and no added column: the optimizer would carry every round's equation into the next
        acc = _every(k, levels, acc.unionByName(far).groupBy("node").agg(F.sum(col).alias(col)))
    return acc


def grow(edges: DataFrame, levels: Sequence[DataFrame] | None = None) -> Tree:
    """Levels and index of a tree (or of several): node, parent, length, is_tip, depth, root_dist, height, n_tips
    (tips below, 1 for a tip) and the depth-first interval [tin, tout], siblings and roots in id order."""
    levels = jump_levels(edges) if levels is None else tuple(levels)
    inner = edges.select(F.col("parent").alias("node")).distinct().withColumn("_i", F.lit(True))
    child = edges.select(F.col("child").alias("node"), "parent", "length")
    top = levels[-1].select("node", F.col("at").alias("_root"), F.col("steps").alias("depth"), F.col("length").alias("root_dist"))
    n = child.join(inner, "node", "full").join(top, "node", "left")
    n = materialize(n.select("node", "parent", "length", F.col("_i").isNull().alias("is_tip"), F.coalesce("depth", F.lit(0)).cast("int").alias("depth"),
                             F.coalesce("root_dist", F.lit(0.0)).alias("root_dist"), F.coalesce("_root", "node").alias("_root")))
    f = fold_below(levels, n.select("node", F.lit(1).cast("long").alias("_size"), F.col("is_tip").cast("long").alias("n_tips"), F.col("depth").alias("_deepest")), ["_size", "n_tips"], ["_deepest"])
    n = n.join(f, "node")
    end = running_sums(n, {"_end": F.col("_size")}, ["node"], ["parent"])
    n = materialize(end.withColumn("_off", F.col("_end") - F.col("_size") + F.when(F.col("parent").isNull(), 0).otherwise(1)))
    above = sum_above(levels, n, "_off").withColumnRenamed("_off", "_above")
    start = n.where("parent is null").select(F.col("node").alias("_root"), F.col("_off").alias("_start"))
    n = n.join(above, "node", "left").join(start, "_root")
    tin = F.coalesce("_above", F.lit(0)) + F.col("_start")
    index = n.select("node", "parent", "length", "is_tip", "depth", "root_dist", (F.col("_deepest") - F.col("depth")).alias("height"), "n_tips", tin.alias("tin"), (tin + F.col("_size") - 1).alias("tout"))
    return Tree(edges, levels, materialize(index))


def common_ancestors(groups: DataFrame, by: Sequence[str], tree: Tree) -> DataFrame:
    """(by..., n_members, mrca): lowest node whose interval holds all the group's nodes; groups without one drop out."""
    t = groups.join(tree.index.select("node", "tin"), "node")
    g = t.groupBy(*by).agg(F.min("tin").alias("_first"), F.min_by("node", "tin").alias("_only"), F.max("tin").alias("_last"), F.count("*").alias("n_members"))
    same = g.where("_first = _last").select(*by, "n_members", F.col("_only").alias("mrca"))
    more = g.where("_first < _last").select(*by, "n_members", (F.col("_first") + 1).alias("_from"), F.col("_last").alias("_to"))
    top = interval_min(tree.index, F.struct("depth", "parent"), more, [*by, "n_members"], "_from", "_to", "_top")
    return same.unionByName(top.select(*by, "n_members", F.col("_top.parent").alias("mrca"))).where("mrca is not null")


def interval_min(index: DataFrame, value: Column, asked: DataFrame, by: Sequence[str], lo: str, hi: str, out: str) -> DataFrame:
    """(by..., out): least `value` of the nodes numbered lo..hi, for every row asked."""
    here = index.select(F.col("tin").alias("_at"), value.alias("_v"))
    size, chunks, requests = index.count(), [], []
    a, z, live = F.col(lo), F.col(hi), F.lit(True)
    level = 0
    while True:
        c, at = F.floor(F.col("_at") / CHUNK), F.struct("_at", "_v")
        packed = here.groupBy(c.alias("_chunk")).agg(F.transform(F.array_sort(F.collect_list(at)), lambda x: x["_v"]).alias("_values"))
        chunks.append(packed.select(F.lit(level).alias("_level"), "_chunk", "_values"))
        ca, cz = F.floor(a / CHUNK), F.floor(z / CHUNK)
        ask = lambda chunk, start, stop, when: F.when(when, F.struct(F.lit(level).alias("_level"), chunk.alias("_chunk"), (start % CHUNK + 1).cast("int").alias("_start"), (stop - start + 1).cast("int").alias("_n")))
        requests += [ask(ca, a, F.least(z, (ca + 1) * CHUNK - 1), live), ask(cz, cz * CHUNK, z, live & (cz > ca))]
        size = -(-size // CHUNK)
        if size <= 1:
            break
        here = packed.select(F.col("_chunk").alias("_at"), F.array_min("_values").alias("_v"))
        live, a, z, level = live & (cz - ca > 1), ca + 1, cz - 1, level + 1
    table = chunks[0]
    for x in chunks[1:]:
        table = table.unionByName(x)
    q = asked.withColumn("_q", F.explode(F.filter(F.array(*requests), lambda x: x.isNotNull()))).select(*by, "_q.*")
    part = q.join(table, ["_level", "_chunk"]).select(*by, F.array_min(F.slice("_values", F.col("_start"), F.col("_n"))).alias("_m"))
    return part.groupBy(*by).agg(F.min("_m").alias(out))


def near_ancestors(edges: DataFrame, max_steps: int) -> DataFrame:
    """(ancestor, node, steps) for ancestors at most `max_steps` up: that many rows per node."""
    up = edges.select(F.col("child").alias("ancestor"), F.col("parent").alias("_next"))
    here = edges.select(F.col("parent").alias("ancestor"), F.col("child").alias("node"), F.lit(1).alias("steps"))
    out = here
    for s in range(2, max_steps + 1):
        here = here.join(up, "ancestor").select(F.col("_next").alias("ancestor"), "node", F.lit(s).alias("steps"))
        out = out.unionByName(here)
    return out
