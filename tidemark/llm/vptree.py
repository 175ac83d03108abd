"""Nearest neighbours by cosine, with a vantage-point tree per shard of the vectors.

On unit vectors the Euclidean distance orders as the cosine does and obeys the triangle inequality. It is used
twice. Shards are cells around pivots (a bounded sample): a query first searches the shard of its own cell, and then only the
shards of cells that its k-th distance so far reaches, so queries aren't sent everywhere. Within a shard a side of
a tree node is left out if its least possible distance times `factor` exceeds the k-th distance. factor 1
is exact search; above 1 both prunings are relaxed towards speed.

Equal vectors are one point with their smallest ids (k + 1 of them suffice), gathered in two salted steps. A cell of more than
SHARD_ROWS points is dealt over several shards by hash, so a dense cell fills no task. A shard's task reads its points first,
builds the tree, then streams its queries through in batches. Points within rounding of the k-th are all kept until
scores are computed on the original vectors, scaled by powers of two, so that large and small components neither
overflow nor vanish.

Edge cases: vectors that are null, empty, zero or hold null or non-finite parts take no part, as queries or
candidates; vectors of different lengths never meet; fewer than k candidates are all returned; repeated
rows (equal id and vector) are one candidate; ties go to the smaller id.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

SHARD_ROWS = 65_536
CELL, PIVOTS = 512, 64  # points a cell holds about, and cells at most; their vectors and sizes are all that reaches the driver
LEAF = 16
TIE, SLACK = 1e-12, 2e-6  # cosines that count as equal while searching, and what that is in distance at most


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows divided by a power of two near their largest component, which changes no cosine."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None]) if len(x) else x


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distance(cosine: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * cosine))


class VPTree:
    def __init__(self, points: np.ndarray):
        self.x = unit(points)
        self.compared = 0  # query-point pairs whose distance was computed
        self.root = self._build(np.arange(len(points)))

    def _build(self, idx: np.ndarray):
        if len(idx) <= LEAF:
            return idx
        vantage = self.x[idx[len(idx) // 2]]
        d = distance(self.x[idx] @ vantage)
        mu = float(np.median(d))
        inner = d <= mu
        if inner.all():
            return idx
        return vantage, mu, self._build(idx[inner]), self._build(idx[~inner])

    def search(self, queries: np.ndarray, k: int, factor: float = 1.0, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and indices of the k nearest points found, (n, k), unfilled places -inf and -1; with a bound, points beyond that
        distance may be missing."""
        q = unit(queries)
        best, who = np.full((len(q), k), -np.inf), np.full((len(q), k), -1)
        reach = np.full(len(q), np.inf) if bound is None else bound

        def visit(node, rows):
            if not len(rows):
                return
            if isinstance(node, np.ndarray):
                self.compared += len(rows) * len(node)
                all_s = np.concatenate([best[rows], q[rows] @ self.x[node].T], axis=1)
                all_i = np.concatenate([who[rows], np.broadcast_to(node, (len(rows), len(node)))], axis=1)
                top = np.argpartition(-all_s, k - 1, axis=1)[:, :k]
                best[rows], who[rows] = np.take_along_axis(all_s, top, 1), np.take_along_axis(all_i, top, 1)
                return
            vantage, mu, inner, outer = node
            self.compared += len(rows)
            d = distance(q[rows] @ vantage)
            near = d <= mu
            visit(inner, rows[near])
            visit(outer, rows[~near])
            worst = best[rows].min(axis=1)
            tau = np.minimum(np.where(np.isneginf(worst), np.inf, distance(np.maximum(worst, -1.0))), reach[rows]) + SLACK
            open_ = np.abs(d - mu) * factor <= tau
            visit(outer, rows[near & open_])
            visit(inner, rows[~near & open_])

        visit(self.root, np.arange(len(q)))
        return best, who

    def within(self, queries: np.ndarray, least: np.ndarray, factor: float = 1.0) -> list[np.ndarray]:
        """Indices of the points found whose cosine is not under least, for each query."""
        q, out = unit(queries), [[] for _ in queries]
        reach = distance(np.maximum(least, -1.0)) + SLACK

        def visit(node, rows):
            if not len(rows):
                return
            if isinstance(node, np.ndarray):
                self.compared += len(rows) * len(node)
                for r, hit in zip(rows, q[rows] @ self.x[node].T >= least[rows, None]):
                    if hit.any():
                        out[r].append(node[hit])
                return
            vantage, mu, inner, outer = node
            self.compared += len(rows)
            d = distance(q[rows] @ vantage)
            visit(inner, rows[(d - mu) * factor <= reach[rows]])
            visit(outer, rows[(mu - d) * factor <= reach[rows]])

        visit(self.root, np.arange(len(q)))
        return [np.concatenate(o) if o else np.zeros(0, dtype=np.int64) for o in out]


def usable(vectors: DataFrame) -> DataFrame:
    v = F.col("embedding").cast("array<double>")
    ok = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).where(F.col("vec_id").isNotNull() & ok)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def runs(keys: np.ndarray):
    """(first, end) of each run of equal rows."""
    if len(keys):
        cut = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
        yield from zip(cut[:-1], cut[1:])


def by_length(batch: pa.RecordBatch, column: int):
    """(rows, vectors) of each length of the vectors in the column."""
    size = batch.column(column).value_lengths().to_numpy(zero_copy_only=False)
    for dim in np.unique(size):
        rows = np.flatnonzero(size == dim)
        yield rows, matrix(batch.column(column).take(pa.array(rows)), int(dim))


SHARDED = "shard int, dim int, kind int, query_id long, ids array<long>, embedding array<double>, tau double"
FOUND = "query_id long, vec_id long, score double, tau double"


def _celled(df: DataFrame, pivots: list[np.ndarray]) -> DataFrame:
    """df, which ends with embedding, and the cell of each vector (-1: no pivot of its length) with its distance from the pivot."""

    def run(batches):
        for b in batches:
            cell, far = np.full(b.num_rows, -1, dtype=np.int32), np.zeros(b.num_rows)
            for rows, x in by_length(b, b.num_columns - 1):
                own = [j for j, p in enumerate(pivots) if len(p) == x.shape[1]]
                if own:
                    d = distance(unit(x) @ unit(np.stack([pivots[j] for j in own])).T)
                    least = d.argmin(axis=1)
                    cell[rows], far[rows] = np.array(own, dtype=np.int32)[least], d[np.arange(len(d)), least]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell), pa.array(far)], [*b.schema.names, "cell", "far"])

    return df.mapInArrow(run, StructType([*df.schema.fields, StructField("cell", IntegerType()), StructField("far", DoubleType())]))


def _further(asked: DataFrame, pivots: list[np.ndarray], radius: dict[int, float], first: dict[int, int], count: dict[int, int], factor: float) -> DataFrame:
    """The queries (query_id, home shard, tau, cell, embedding) for each shard, but the home, that may hold something nearer than tau."""

    def run(batches):
        for b in batches:
            taus = b.column(2).to_numpy(zero_copy_only=False)
            reach, home, at, to = np.where(np.isnan(taus), np.inf, taus) + SLACK, b.column(1).to_pylist(), [], []
            for rows, x in by_length(b, 4):
                own = [j for j, p in enumerate(pivots) if len(p) == x.shape[1] and j in count]
                d = distance(unit(x) @ unit(np.stack([pivots[j] for j in own])).T) if own else np.zeros((len(x), 0))
                for n, r in enumerate(rows):
                    cells = [j for c, j in enumerate(own) if (d[n, c] - radius[j]) * factor <= reach[r]] if own else [-1]
                    shards = [s for j in cells if j in count for s in range(first[j], first[j] + count[j]) if s != home[r]]
                    at += [r] * len(shards)
                    to += shards
            if at:
                rows = b.take(pa.array(at))
                size = rows.column(4).value_lengths().cast(pa.int32())
                none = pa.array([[]] * len(at), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(to, pa.int32()), size, pa.array([1] * len(at), pa.int32()), rows.column(0), none, rows.column(4), rows.column(2)], ["shard", "dim", "kind", "query_id", "ids", "embedding", "tau"])

    return asked.mapInArrow(run, SHARDED)


def _searched(points: DataFrame, asked: DataFrame, shards: int, k: int, factor: float) -> DataFrame:
    """Candidates of the queries in their shards, and per query and shard a row without vec_id with the k-th distance found there."""
    some = k + 1

    def run(batches):
        at, pts, ids, tree = None, [], [], None
        for batch in batches:
            keys = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2)], axis=1)
            for s, e in runs(keys):
                (shard, dim, kind), part = keys[s].tolist(), batch.slice(s, e - s)
                if (shard, dim) != at:
                    at, pts, ids, tree = (shard, dim), [], [], None
                x = matrix(part.column(5), dim)
                if kind == 0:
                    pts.append(x)
                    ids += part.column(4).to_pylist()
                    continue
                if not pts:
                    continue
                if tree is None:
                    every = scaled(np.concatenate(pts))
                    tree, norm = VPTree(every), np.sqrt((every**2).sum(axis=1))
                tau = part.column(6).to_numpy(zero_copy_only=False)
                bound = np.where(np.isnan(tau), np.inf, tau)
                best, _ = tree.search(x, some, factor, bound)
                least = np.maximum(best.min(axis=1), np.where(np.isinf(bound), -np.inf, 1 - bound**2 / 2)) - TIE
                out = []
                for qid, v, w in zip(part.column(3).to_pylist(), scaled(x), tree.within(x, least, factor)):
                    score = (every[w] * v).sum(axis=1) / (norm[w] * np.sqrt((v**2).sum()))
                    found = sorted((-c, i) for c, j in zip(score.tolist(), w) for i in ids[j] if i != qid)[:k]
                    out += [(qid, i, -c, None) for c, i in found]
                    out.append((qid, None, None, float(distance(np.array(-found[-1][0]))) if len(found) == k else None))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64(), pa.float64()))], ["query_id", "vec_id", "score", "tau"])

    return points.union(asked).repartition(shards, "shard").sortWithinPartitions("shard", "dim", "kind").mapInArrow(run, FOUND)


def nearest(vectors: DataFrame, is_query, k: int = 5, factor: float = 1.0) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest other rows of each row for which is_query (a Column) holds."""
    rows = usable(vectors)
    some = k + 1
    pivots = [np.array(r["embedding"]) for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("embedding").limit(min(PIVOTS, -(-rows.count() // CELL))).collect()]
    salted = rows.groupBy("embedding", F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).agg(F.slice(F.sort_array(F.collect_set("vec_id")), 1, some).alias("ids"))
    points = salted.groupBy("embedding").agg(F.slice(F.sort_array(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, some).alias("ids"))
    celled = _celled(points.select("ids", "embedding"), pivots)
    cells = celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("radius")).collect()  # PIVOTS + 1 rows at most
    first, count, at = {}, {}, 0
    for c in sorted(cells):
        first[c["cell"]], count[c["cell"]] = at, -(-c["n"] // SHARD_ROWS)
        at += count[c["cell"]]
    if not at:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    radius = {c["cell"]: c["radius"] + SLACK for c in cells}
    pick = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])[F.col("cell")]
    home = (pick(first) + F.pmod(F.xxhash64("embedding"), pick(count))).cast("int")
    none, size = F.lit(None).cast("double").alias("tau"), F.size("embedding").alias("dim")
    dealt = celled.select(home.alias("shard"), size, F.lit(0).alias("kind"), F.lit(None).cast("long").alias("query_id"), "ids", "embedding", none)
    asked = _celled(rows.where(is_query).distinct().select(F.col("vec_id").alias("query_id"), "embedding"), pivots).withColumn("shard", home)
    near = _searched(dealt, asked.select("shard", size, F.lit(1).alias("kind"), "query_id", F.array().cast("array<bigint>").alias("ids"), "embedding", none), at, k, factor).checkpoint()
    bounds = near.where("vec_id is null").groupBy("query_id").agg(F.max("tau").alias("tau"))
    again = asked.join(bounds, "query_id", "left").select("query_id", "shard", "tau", "cell", "embedding")
    far = _searched(dealt, _further(again, pivots, radius, first, count, factor), at, k, factor)
    found = near.union(far).where("vec_id is not null")
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
