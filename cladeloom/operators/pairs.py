"""Pairwise work without emitting pairs: points are packed into bounded chunks, chunks
are joined with chunks, and a numpy kernel reduces each chunk pair inside the task.

A group of any size is cut into ceil(n / chunk_rows) chunks, so a hot group becomes
many small join keys instead of one task.
"""
from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from cladeloom.operators.ordered import join_same

Block = dict[str, np.ndarray]
CHUNK_ROWS = 512
#: Numbers of one intermediate array in `distances`, and result rows that a task gathers before it hands them on.
STRIP, GATHER = 1 << 20, 1 << 16


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of a to all rows of b, by strips of a so that differences take bounded memory."""
    out = np.empty((len(a), len(b)))
    if 0 < a.shape[1] < 8:  # sums of so few numbers are added in their order: the same result, a side at a time
        step = max(1, (STRIP >> 3) // max(1, len(b)))
        sides = b.T.copy()
        for i in range(0, len(a), step):
            d = out[i:i + step]
            np.subtract(a[i:i + step, 0, None], sides[0], out=d)
            d *= d
            for j in range(1, len(sides)):
                e = a[i:i + step, j, None] - sides[j]
                e *= e
                d += e
            np.sqrt(d, out=d)
        return out
    step = max(1, STRIP // max(1, b.size))
    for i in range(0, len(a), step):
        d = a[i:i + step, None, :] - b[None, :, :]
        d *= d
        out[i:i + step] = np.sqrt(d.sum(2))
    return out


def boxes(p: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order of the points by halving along the widest side into boxes of about `size`, where each box begins, least and largest corner."""
    rows, cuts = [np.arange(len(p))], True
    while cuts:
        cuts, halves = False, []
        for r in rows:
            if len(r) <= size:
                halves.append(r)
                continue
            cuts, m, side = True, len(r) // 2, int(np.ptp(p[r], axis=0).argmax())
            o = r[np.argpartition(p[r, side], m)]
            halves += [o[:m], o[m:]]
        rows = halves
    order, starts = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    return order, starts, np.minimum.reduceat(p[order], starts[:-1]), np.maximum.reduceat(p[order], starts[:-1])


def near_counts(a: np.ndarray, b: np.ndarray, radius: float, size: int = 64) -> np.ndarray:
    """Number of rows of b with 0 < d <= radius for every row of a, d as in `distances`.

    Boxes of points that lie apart from each other and wholly within the radius are counted as a whole, boxes beyond it not
    at all, and only the others point by point, copies of a point once. Rows that are not finite are near nothing.
    """
    out, rows = np.zeros(len(a), np.int64), np.flatnonzero(np.isfinite(a).all(1))
    b = b[np.isfinite(b).all(1)]
    if not len(rows) or not len(b):
        return out
    (a, of), (b, copies) = np.unique(a[rows], axis=0, return_inverse=True), np.unique(b, axis=0, return_counts=True)
    limit = float(radius) ** 2  # the largest number with a root of at most the radius
    while np.sqrt(np.nextafter(limit, np.inf)) <= radius:
        limit = np.nextafter(limit, np.inf)
    while np.sqrt(limit) > radius:
        limit = np.nextafter(limit, -np.inf)
    (oa, sa, la, ha), (ob, sb, lb, hb) = boxes(a, size), boxes(b, size)
    x, y, copies = a[oa].T.copy(), b[ob].T.copy(), copies[ob]
    weight = np.add.reduceat(copies, sb[:-1])
    single, found = bool((copies == 1).all()), np.zeros(len(a), np.int64)
    with np.errstate(over="ignore"):
        for i in range(len(la)):
            gap = (np.maximum(0, np.maximum(lb - ha[i], la[i] - hb)) ** 2).sum(1)
            span = (np.maximum(hb - la[i], ha[i] - lb) ** 2).sum(1)
            whole = (gap > 0) & (span < limit * (1 - 1e-9))
            box = np.flatnonzero((gap <= limit * (1 + 1e-9)) & ~whole)
            at, total = slice(sa[i], sa[i + 1]), int(weight[whole].sum())
            n = sb[box + 1] - sb[box]
            js = np.repeat(sb[box] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(box) else np.zeros(0, np.int64)
            step = max(1, STRIP // size)
            found[at] = total
            for k in range(0, len(js), step):
                j = js[k:k + step]
                d = np.zeros((sa[i + 1] - sa[i], len(j)))
                for u, v in zip(x, y):
                    e = u[at, None] - v[None, j]
                    e *= e
                    d += e
                hit = (d > 0) & (d <= limit)
                found[at] += np.count_nonzero(hit, axis=1) if single else hit @ copies[j]
    back = np.empty(len(a), np.int64)
    back[oa] = found
    out[rows] = back[of.ravel()]
    return out


def pack(points: DataFrame, by: Sequence[str], key: str, cols: Sequence[str], chunk_rows: int = CHUNK_ROWS, position: str | None = None) -> DataFrame:
    """One row per chunk: by..., _chunk, _chunks, and one array per column; `position` (from 1 in each group) keeps neighbours together."""
    if by:
        n = points.groupBy(*by).agg(F.count("*").alias("_n"))
        p = join_same(points, n, list(by))
    else:
        p = points.withColumn("_n", points.agg(F.count("*")).scalar())
    p = p.withColumn("_chunks", F.ceil(F.col("_n") / chunk_rows).cast("int"))
    p = p.withColumn("_chunk", (F.pmod(F.xxhash64(F.col(key)), F.col("_chunks")) if position is None else F.floor((F.col(position) - 1) / chunk_rows)).cast("int"))
    fields = list(dict.fromkeys([key, *cols]))
    g = p.groupBy(*by, "_chunks", "_chunk").agg(F.collect_list(F.struct(*fields)).alias("_pts"))
    return g.select(*by, "_chunks", "_chunk", *[F.col(f"_pts.{c}").alias(c) for c in fields])


def _as_block(row: pd.Series, prefix: str, fields: Sequence[str], vectors: set[str]) -> Block:
    out: Block = {}
    for f in fields:
        v = row[prefix + f]
        out[f] = np.vstack(v).astype(float) if f in vectors else np.asarray(v)
    return out


def chunk_pairs(
    points: DataFrame,
    by: Sequence[str],
    key: str,
    cols: Sequence[str],
    kernel: Callable[[Block, Block, bool], dict[str, np.ndarray]],
    schema: str,
    *,
    other: DataFrame | None = None,
    vectors: Sequence[str] = (),
    chunk_rows: int = CHUNK_ROWS,
    cells: Sequence[str] = (),
    position: str | None = None,
    most_tasks: int = 0,
) -> DataFrame:
    """Run `kernel(a, b, same)` once per chunk pair of each group; returns by... + `schema`.

    Without `other` every unordered chunk pair is visited once (a chunk with itself
    has same=True).  With `other` every chunk of `points` meets every chunk of it; `cells` names
    those of `by` that number cells, whose adjacent ones are met too.  With `position` chunks hold consecutive
    rows; they may be few and large, so pairs of them and not single chunks are dealt to tasks, of which there are more
    than the session sets (up to 8 times) where `most_tasks` is larger.
    Rows with a NULL group key belong to no group.
    """
    fields = list(dict.fromkeys([key, *cols]))
    meets = {c: f"t_{c}" if c in cells else f"l_{c}" for c in by}
    left = pack(points, by, key, cols, chunk_rows, position)
    right = left if other is None else pack(other, by, key, cols, chunk_rows)
    r = right.select(*[F.col(c).alias(f"r_{c}") for c in (*by, "_chunks", "_chunk", *fields)])
    l = left.select(*[F.col(c).alias(f"l_{c}") for c in (*by, "_chunks", "_chunk", *fields)])
    if other is None:
        l = l.withColumn("_peer", F.explode(F.sequence("l__chunk", F.col("l__chunks") - 1)))
        if position is not None:
            r = r.withColumn("_first", F.explode(F.sequence(F.lit(0), "r__chunk")))
    else:
        counts = (right.groupBy(*by) if by else right.groupBy()).agg(F.max("_chunks").alias("_peers"))
        for c in cells:
            l = l.withColumn(f"t_{c}", F.explode(F.array(*[F.col(f"l_{c}") + i for i in (-1, 0, 1)])))
        if by:
            l = l.join(counts.select(*[F.col(c).alias(f"c_{c}") for c in by], "_peers"),
                       [F.col(meets[c]) == F.col(f"c_{c}") for c in by]).drop(*[f"c_{c}" for c in by])
        else:
            l = l.withColumn("_peers", counts.scalar())
        l = l.withColumn("_peer", F.explode(F.sequence(F.lit(0), F.col("_peers") - 1)))
    # kernels are heavy per byte: fix the task count so small shuffles are not merged into one task
    tasks = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(tasks, min(8 * tasks, most_tasks))
    l = l.repartition(tasks, "_peer", *([] if position is None else ["l__chunk"]), *meets.values())
    cond = F.col("_peer") == F.col("r__chunk")
    if position is not None:
        cond = cond & (F.col("l__chunk") == F.col("_first"))
    for c in by:
        cond = cond & (F.col(meets[c]) == F.col(f"r_{c}"))
    # never through the driver: sizes of packed chunks are estimated far too small
    joined = l.join(r.hint("shuffle_hash"), cond)
    keep = [*[f"l_{c}" for c in by], "l__chunk", "r__chunk", *[f"l_{f}" for f in fields], *[f"r_{f}" for f in fields]]
    types = dict(points.dtypes)
    by_schema = ", ".join(f"`{c}` {types[c]}" for c in by)
    full = f"{by_schema}, {schema}" if by else schema
    names = [part.split()[0].strip("`") for part in schema.split(",")]
    vec, selfjoin, by_list = set(vectors), other is None, list(by)
    gather = 0 if "array<" in schema else GATHER

    def run(batches):
        outs, held = [], 0
        for pdf in batches:
            for _, row in pdf.iterrows():
                same = bool(selfjoin and row["l__chunk"] == row["r__chunk"])
                a = _as_block(row, "l_", fields, vec)
                # both sides collect a chunk anew, and the order within it is that in which the shuffle came in: kernels
                # leave out the diagonal, so a chunk meets itself in one order
                b = a if same else _as_block(row, "r_", fields, vec)
                res = pd.DataFrame(kernel(a, b, same))[names]
                for i, c in enumerate(by_list):
                    res.insert(i, c, row[f"l_{c}"])
                outs.append(res)
                held += len(res)
                if held > gather:
                    yield pd.concat(outs, ignore_index=True)
                    outs, held = [], 0
        if outs:
            yield pd.concat(outs, ignore_index=True)

    return joined.select(*keep).mapInPandas(run, full)
