"""Exact top-k inner-product search by a three-phase uniform threshold.

A vector's coordinates are cut into lists; a row's score is the sum of its scores in the lists. Queries
come in blocks of a fixed number of rows, each sent to all tasks:

1. list by list, every task gathers each query's k best rows by their scores in that list alone, and the list's
   lowest score. Those few rows, no others, are scored in full: their k-th best total, over all tasks, is a safe cutoff;
2. the cutoff is broadcast, shared out evenly among the lists above their lowest scores: a row below its share
   in every list cannot reach the cutoff. Lists are looked at in turn; once a row's scores so far and the highest
   scores of the lists to come cannot reach the cutoff either, the row is left. Rows that reach their share in some
   list are collected,
3. and the lists that they still lack are scored for them alone, exactly; rows whose total reaches the cutoff
   are sent, and the best k of each query are taken from these.

Components are floor(scale * x) and scores are integers, exact in float64 up to 2**53, in Python integers
beyond (then held to the range of a long). Cases: vectors that are null or hold null or non-finite
components, and null ids, take no part; rows of a query's own id are no candidates of it; a candidate row that
is repeated as a whole counts each time; of several query rows of one id with one vector one is asked, and those
with different vectors are asked together, the best k over all of them; vectors of another length than the query's are
no candidates; ties go to the smaller id; empty tables give no rows; other columns are ignored, whatever their names.
Of equal vectors only the k + 1 rows with the smallest ids, and those that share their ids, are kept, as no other
can be in a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import stash, trimmed

QUERY_BLOCK = 2048
ROWS = 1024


def quantise(vectors: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    v = F.col(vec_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & ~F.coalesce(bad, F.lit(False)))
    return rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("vec"))


def _matrix(column, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products of all rows of q with all rows of c."""
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(c.astype(np.float64)).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return q.astype(np.float64) @ c.astype(np.float64).T
    return np.array([[sum(int(x) * int(y) for x, y in zip(a, b)) for b in c] for a in q], object)


def _clip(x: np.ndarray) -> np.ndarray:
    return np.array([max(-(2**63), min(2**63 - 1, int(v))) for v in x], np.int64) if x.dtype == object else x.astype(np.int64)


def _tiles(batches: Iterator, dims: int):
    for batch in trimmed(batches):
        lens = batch.column(1).value_lengths().to_numpy(zero_copy_only=False)
        if (lens != dims).any():
            import pyarrow as pa

            batch = batch.filter(pa.array(lens == dims))
        ids = batch.column(0).to_numpy()
        c = _matrix(batch.column(1), dims) if dims else np.zeros((len(ids), 0), np.int64)
        for k in range(0, len(ids), ROWS):
            yield ids[k : k + ROWS], c[k : k + ROWS]


def _best(p: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores of each row."""
    return np.argpartition(p, -k, 1)[:, -k:] if p.shape[1] > k else np.tile(np.arange(p.shape[1]), (len(p), 1))


def _gather(block, k: int, dims: int, cuts: list[int]):
    """Phase 1: (q, lows, highs, seen): of each query the lists' lowest and highest scores, and the totals of the task's k best rows of each list."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        qid, q = block.value
        lists = list(zip(cuts, cuts[1:]))
        lows = highs = None
        best = [None] * len(lists)  # of each list: scores, rows' vectors, whether a query's own
        for ids, c in _tiles(batches, dims):
            if not len(ids):
                continue
            own = qid[:, None] == ids[None, :]
            low, high = [], []
            for n, (a, b) in enumerate(lists):
                p = _scores(q[:, a:b], c[:, a:b])
                low.append(p.min(1))
                high.append(p.max(1))
                p = np.where(own, -np.inf if p.dtype != object else -(10**40), p)
                at = _best(p, ids, k)
                score, rows = np.take_along_axis(p, at, 1), c[at]
                if best[n] is not None:
                    score, rows = np.concatenate([best[n][0], score], 1), np.concatenate([best[n][1], rows], 1)
                    at = _best(score, ids, k)
                    score, rows = np.take_along_axis(score, at, 1), np.take_along_axis(rows, at[:, :, None], 1)
                best[n] = (score, rows)
            low, high = np.stack(low, 1), np.stack(high, 1)
            lows, highs = (low, high) if lows is None else (np.minimum(lows, low), np.maximum(highs, high))
        if lows is None:
            return
        seen = []
        for j in range(len(qid)):
            # a row that is among the best of several lists counts once: the lists' own best are kept apart
            totals = []
            for score, rows in best:
                real = score[j] > (-np.inf if score.dtype != object else -(10**40))
                total = _scores(q[j : j + 1], rows[j][real.astype(bool)])[0]
                totals.append(sorted((int(x) for x in _clip(total)), reverse=True)[:k])
            seen.append(totals)
        kind = pa.list_(pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(qid))), pa.array([_clip(x).tolist() for x in lows], kind), pa.array([_clip(x).tolist() for x in highs], kind), pa.array(seen, pa.list_(kind))], names=["q", "lows", "highs", "seen"])

    return run


class Counts:
    """How many scores of lists phases 2 and 3 made, of how many there are."""

    def __init__(self):
        self.made = self.all = 0


def resolve(q, qid, c, ids, cutoff, share, highs, cuts: list[int], counts: Counts | None = None):
    """Phases 2 and 3 on a tile: (query, row, total) of the pairs whose total reaches the cutoff."""
    lists = list(zip(cuts, cuts[1:]))
    rest = np.cumsum(highs[:, ::-1], 1)[:, ::-1]  # highest scores of a list and those after it
    full = np.nonzero(qid[:, None] != ids[None, :])
    a, b = full
    sums = np.zeros(len(a))
    reach = np.zeros(len(a), bool)
    for n, (x, y) in enumerate(lists):
        if n and len(a) * 8 < len(qid) * len(ids):
            part = _pairs(q[:, x:y], c[:, x:y], a, b)  # few are left: theirs alone
            made = len(a)
        else:
            whole = _scores(q[:, x:y], c[:, x:y])
            part, made = whole[a, b], whole.size
        if counts is not None:
            counts.made += made
            counts.all += len(qid) * len(ids)
        sums = part if n == 0 else sums + part
        reach |= (part >= share[a, n]).astype(bool)
        if n + 1 < len(lists):
            keep = (sums + rest[a, n + 1] >= cutoff[a]).astype(bool)
            a, b, sums, reach = a[keep], b[keep], sums[keep], reach[keep]
    keep = reach & (sums >= cutoff[a]).astype(bool)
    return a[keep], b[keep], sums[keep]


def _pairs(q: np.ndarray, c: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the pairs (q[a], c[b])."""
    most = float(np.abs(q.astype(np.float64)).max(initial=0)) * float(np.abs(c.astype(np.float64)).max(initial=0)) * max(1, q.shape[1])
    if most < 2**53:
        return np.einsum("ij,ij->i", q[a].astype(np.float64), c[b].astype(np.float64))
    return np.array([sum(int(x) * int(y) for x, y in zip(q[i], c[j])) for i, j in zip(a, b)], object)


def _collect(block, shares, dims: int, cuts: list[int]):
    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        qid, q = block.value
        for ids, c in _tiles(batches, dims):
            if len(ids):
                a, b, total = resolve(q, qid, c, ids, *shares.value, cuts)
                yield pa.RecordBatch.from_arrays([pa.array(qid[a]), pa.array(ids[b]), pa.array(_clip(total))], names=["query_id", "vec_id", "score"])

    return run


def search(queries: DataFrame, vectors: DataFrame, k: int = 5, lists: int = 2, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of `vectors` for each row of `queries`, both (id, vector)."""
    spark = vectors.sparkSession
    same = F.dense_rank().over(Window.partitionBy("vec").orderBy("vec_id"))
    rows = quantise(vectors, scale, id_col, vec_col).withColumn("n", same).where(F.col("n") <= k + 1).select("vec_id", "vec")
    # of a row that is repeated as a whole k are enough
    times = F.row_number().over(Window.partitionBy("vec", "vec_id").orderBy("vec_id"))
    rows = stash(rows.withColumn("times", times).where(F.col("times") <= k).select("vec_id", "vec"), "vectors")
    asked = stash(quantise(queries, scale, id_col, vec_col).distinct().withColumn("d", F.size("vec")), "queries")
    parts = []
    for dims, n in asked.groupBy("d").count().orderBy("d").collect():
        blocks = -(-n // QUERY_BLOCK)
        cuts = sorted({dims * l // lists for l in range(lists + 1)}) if dims >= lists else [0, dims]
        for b in range(blocks):
            mine = asked.where((F.col("d") == dims) & (F.pmod(F.xxhash64("vec_id", "vec"), F.lit(blocks)) == b)).select("vec_id", "vec").toArrow()
            if not mine.num_rows:
                continue
            qid = mine.column("vec_id").to_numpy()
            q = _matrix(mine.column("vec").combine_chunks(), dims) if dims else np.zeros((len(qid), 0), np.int64)
            block = spark.sparkContext.broadcast((qid, q))
            seen = rows.mapInArrow(_gather(block, k, dims, cuts), "q long, lows array<long>, highs array<long>, seen array<array<long>>")
            seen = stash(seen, "seen")
            m = len(cuts) - 1
            ends = seen.groupBy("q").agg(*(f(F.col(c)[l]).alias(f"{c}{l}") for l in range(m) for f, c in ((F.min, "lows"), (F.max, "highs")))).orderBy("q").toPandas()
            # the k best totals of a list's best rows over all tasks: distinct rows, so the k-th is a safe cutoff
            each = seen.select("q", F.posexplode("seen").alias("l", "t")).select("q", "l", F.explode("t").alias("t"))
            each = each.withColumn("r", F.row_number().over(Window.partitionBy("q", "l").orderBy(F.desc("t")))).where(F.col("r") <= k)
            got = each.where(F.col("r") == k).groupBy("q").agg(F.max("t").alias("kth")).toPandas()
            cutoff = np.full(len(qid), -np.inf)
            share, lows, highs = np.full((len(qid), m), -np.inf), np.zeros((len(qid), m)), np.full((len(qid), m), np.inf)
            for l in range(m if len(ends) else 0):
                lows[ends["q"], l], highs[ends["q"], l] = ends[f"lows{l}"], ends[f"highs{l}"]
            cutoff[got["q"]] = got["kth"]
            found = np.isfinite(cutoff)
            share[found] = lows[found] + np.floor((cutoff[found] - lows[found].sum(1)) / m)[:, None]
            if max(np.abs(x[np.isfinite(x)]).max(initial=0) for x in (cutoff, lows, highs)) >= 2**53:
                cutoff[:], share[:], highs[:] = -np.inf, -np.inf, np.inf  # beyond exact floats: no pruning
            shares = spark.sparkContext.broadcast((cutoff, share, highs))
            parts.append(rows.mapInArrow(_collect(block, shares, dims, cuts), "query_id long, vec_id long, score long"))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = parts[0]
    for p in parts[1:]:
        found = found.union(p)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.select("query_id", rank.alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
