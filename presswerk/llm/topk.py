"""Exact top-k by integer inner product, with block-at-a-time pruning."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presswerk.llm.common import bound_batches, stage

#: Documents of a block, of a segment (the unit that meets a chunk of queries), and queries of a chunk.
BLOCK, SEGMENT, CHUNK = 64, 4096, 256
#: Segments whose bounds one task holds against a chunk.
BOUNDS = 256
#: Documents that set a query's first bound, drawn by a hash; and reference points that order the documents.
PILOTS, POINTS = 1024, 64
SCALE = 256
#: The range of a long.
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantised(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v array<double>): floor(256 * x) of every component, as a double, which holds it exactly for single-precision x of any size.

    Vectors without id, null, empty, or with null or non-finite components are left out.
    """
    v = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vec_col].cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & (F.size("v") > 0)
    rows = v.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    # floor() gives a long, so it is for numbers that fit one; larger doubles are whole anyway.
    whole = lambda x: F.when(F.abs(x) < F.lit(float(1 << 53)), F.floor(x).cast("double")).otherwise(x)
    return rows.select("vec_id", F.transform("v", lambda x: whole(x * SCALE)).alias("v")).distinct()


def _matrix(column) -> np.ndarray:
    return np.array(column.to_pylist(), np.float64)


def exact_kind(bound: float):
    """The kind of numbers in which sums of products up to ``bound`` are exact: doubles, longs, or Python's integers."""
    return np.float64 if bound < 1 << 53 else np.int64 if bound < 1 << 62 else object


def _as_kind(x: np.ndarray, kind) -> np.ndarray:
    if kind is not object:
        return x.astype(kind)
    out = np.empty(x.shape, object)
    out.flat = [int(y) for y in x.flat]
    return out


class Segment:
    """A forward index of documents cut into blocks, with the largest and smallest value of each term in a block."""

    def __init__(self, ids: np.ndarray, docs: np.ndarray):
        self.ids, self.docs = ids, docs
        self.starts = np.arange(0, len(ids), BLOCK)
        self.high = np.maximum.reduceat(docs, self.starts, axis=0)
        self.low = np.minimum.reduceat(docs, self.starts, axis=0)

    def top(self, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int):
        """For each query: (ids, scores) of its k best documents here (all that could be among its k best of all).

        A block's bound is the sum over terms of the largest product it can
        hold.  Blocks are scored in falling order of bounds, a few at a time,
        until the next bound is below the k-th score; ``floor`` is a score that
        k documents are known to reach.  Equal bounds are scored, since a tie goes
        to the smaller id.  Scores are exact, in numbers as wide as they need.
        """
        if not len(queries):
            return
        kind = exact_kind(float(np.abs(queries).max()) * float(np.abs(self.docs).max()) * self.docs.shape[1])
        queries, docs, high, low = (_as_kind(x, kind) for x in (queries, self.docs, self.high, self.low))
        bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
        order = np.argsort(-bounds, axis=1, kind="stable")
        for q, (query, me, least) in enumerate(zip(queries, own, floor)):
            ranked, at, step = order[q], 0, 2
            best: list[tuple] = []  # (negative score, id)
            while at < len(ranked) and bounds[q, ranked[at]] >= least:
                blocks = ranked[at : at + step]
                blocks = blocks[np.array(bounds[q, blocks] >= least, bool)]
                rows = (self.starts[blocks][:, None] + np.arange(BLOCK)).ravel()
                rows = rows[rows < len(self.ids)]
                rows = rows[self.ids[rows] != me]
                got = docs[rows] @ query
                on = np.flatnonzero(np.array(got >= least, bool))
                if len(on) > k and kind is not object:
                    edge = np.partition(got[on], -k)[-k]
                    on = on[got[on] >= edge]
                best = sorted([*best, *((-int(s), int(i)) for s, i in zip(got[on], self.ids[rows[on]]))])[:k]
                if len(best) == k:
                    least = max(least, -best[-1][0])
                at += step
                step *= 2
            yield [i for _, i in best], [-s for s, _ in best]


def _envelope_bounds(queries: np.ndarray, high: np.ndarray, low: np.ndarray) -> np.ndarray:
    """What a query can score in each segment at most; a little more than exact, as it is only compared."""
    bounds = np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T
    return bounds + np.abs(queries) @ np.maximum(np.abs(high), np.abs(low)).T * 1e-12


def search(spark: SparkSession, vectors: DataFrame, is_query: Column, *, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best other vectors of each query by integer inner product; ties to the smaller vec_id.

    ``is_query`` is a condition on the column vec_id.  Documents are numbered in
    the order of their nearest reference point, so that a block's vectors are
    alike and its bounds tight, and stored as segments of forward indexes.  A
    sample of documents gives each query a first bound.  Chunks of queries are
    first held against the summed term maxima of whole segments, many at a time;
    only queries that a segment could serve meet it, block by block.  Neither
    side is broadcast or gathered.

    A vector only meets vectors of its own dimension.  Vectors without id, null,
    empty, or with null or non-finite components take no part.  Scores of any
    size are ranked exactly; one that no long holds is given as the nearest
    long.  Repeated rows count once; an id with several vectors keeps the best
    score.  Queries with fewer than k others have fewer rows.  Empty tables give
    no rows; other columns are not read.
    """
    bound_batches(spark)
    v = stage(spark, quantised(vectors, id_col, vec_col).withColumn("dim", F.size("v")), "quantised")
    drawn = v.select(F.xxhash64("vec_id", F.lit(17)).alias("h"), "vec_id", "dim", "v").orderBy("h", "vec_id", "v").limit(PILOTS).toArrow()
    pilots: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for dim in set(drawn.column("dim").to_pylist()):
        rows = drawn.filter(pc.equal(drawn.column("dim"), dim))
        ids, first = np.unique(rows.column("vec_id").to_numpy(), return_index=True)
        pilots[dim] = (ids, _matrix(rows.column("v"))[first])
    shared = spark.sparkContext.broadcast(pilots)

    def near(batches):
        for batch in batches:
            dims, point = batch.column("dim").to_numpy(), np.zeros(batch.num_rows, np.int32)
            for dim in np.unique(dims):
                if dim in shared.value:
                    rows = np.flatnonzero(dims == dim)
                    points = shared.value[dim][1][:POINTS]
                    own = _matrix(batch.column("v").take(pa.array(rows)))
                    point[rows] = (own / max(1.0, np.abs(own).max()) @ points.T).argmax(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(point)], names=[*batch.schema.names, "point"])

    # Segments: the rows of one or more reference points, cut by their number within the point.
    placed = stage(spark, v.mapInArrow(near, "vec_id long, v array<double>, dim int, point int"), "placed")

    def dealt(rows: DataFrame, size: int, name: str) -> DataFrame:
        """Rows with the number of the segment (or chunk) of about ``size`` rows that they belong to; neighbours in the order of points."""
        sizes = rows.groupBy("dim", "point").agg(F.count("*").alias("n"))
        before = F.sum("n").over(Window.partitionBy("dim").orderBy("point").rowsBetween(Window.unboundedPreceding, -1))
        sizes = sizes.withColumn("before", F.coalesce(before, F.lit(0)))
        return rows.join(sizes, ["dim", "point"]).withColumn(name, F.floor((F.col("before") + F.pmod(F.xxhash64("vec_id", F.lit(23)), F.col("n"))) / size).cast("int"))

    docs = dealt(placed, SEGMENT, "segment").groupBy("dim", "segment").agg(F.sort_array(F.collect_list(F.struct("point", "vec_id", "v"))).alias("d"))
    docs = stage(spark, docs.select("dim", "segment", F.col("d.vec_id").alias("d_ids"), F.col("d.v").alias("d_v")), "segments")

    def envelopes(batches):
        for batch in batches:
            out = [[], []]
            for dim, vectors in zip(batch.column(0).to_pylist(), batch.column(2)):
                x = vectors.values.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                out[0].append(x.max(axis=0))
                out[1].append(x.min(axis=0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *(pa.array(x, pa.list_(pa.float64())) for x in out)], names=["dim", "segment", "high", "low"])

    bounds = docs.select("dim", "segment", "d_v").mapInArrow(envelopes, "dim int, segment int, high array<double>, low array<double>")
    bounds = bounds.groupBy("dim", F.floor(F.col("segment") / BOUNDS).cast("int").alias("part")).agg(F.array_sort(F.collect_list(F.struct("segment", "high", "low"))).alias("b"))
    bounds = stage(spark, bounds, "bounds")

    def floors(t: pa.Table) -> pa.Table:
        """The k-th best score among the pilots."""
        dim, ids, q = t.column("dim")[0].as_py(), t.column("vec_id").to_numpy(), _matrix(t.column("v"))
        floor = np.full(len(ids), -np.inf)
        if dim in shared.value and len(shared.value[dim][0]) > k:
            names, rows = shared.value[dim]
            with np.errstate(over="ignore", invalid="ignore"):
                scores = q @ rows.T
                slack = np.abs(q) @ np.abs(rows).T * 1e-12
            scores[ids[:, None] == names[None, :]] = -np.inf
            floor = np.partition(scores - slack, -k, axis=1)[:, -k]
            floor[~np.isfinite(floor)] = -np.inf
        flat = pa.array([q.ravel().tolist()], pa.list_(pa.float64()))
        return pa.table({"dim": t.column("dim")[:1], "chunk": t.column("chunk")[:1], "q_ids": pa.array([ids.tolist()], pa.list_(pa.int64())), "q_v": flat, "floor": pa.array([floor.tolist()], pa.list_(pa.float64()))})

    asked = dealt(placed.where(is_query), CHUNK, "chunk")
    queries = stage(spark, asked.groupBy("dim", "chunk").applyInArrow(floors, "dim int, chunk int, q_ids array<long>, q_v array<double>, floor array<double>"), "queries")

    def served(batches):
        """(dim, chunk, segment, which): the queries of the chunk that the segment could serve."""
        for batch in batches:
            out = [[], [], [], []]
            for r in range(batch.num_rows):
                dim, chunk, parts = batch.column("dim")[r].as_py(), batch.column("chunk")[r].as_py(), batch.column("b")[r].values
                q, floor = batch.column("q_v")[r].values.to_numpy(zero_copy_only=False).reshape(-1, dim), batch.column("floor")[r].values.to_numpy(zero_copy_only=False)
                high, low = (parts.field(c).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) for c in (1, 2))
                with np.errstate(over="ignore", invalid="ignore"):
                    could = ~(_envelope_bounds(q, high, low) < floor[:, None])
                for s in np.flatnonzero(could.any(axis=0)):
                    for column, x in zip(out, (dim, chunk, parts.field(0)[int(s)].as_py(), np.flatnonzero(could[:, s]).tolist())):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int32()) for c in out[:3]), pa.array(out[3], pa.list_(pa.int32()))], names=["dim", "chunk", "segment", "which"])

    pairs = queries.join(bounds, "dim").select("dim", "chunk", "q_v", "floor", "b").mapInArrow(served, "dim int, chunk int, segment int, which array<int>")
    pairs = stage(spark, pairs, "served")
    met = pairs.join(queries, ["dim", "chunk"]).join(docs, ["dim", "segment"]).select("dim", "q_ids", "q_v", "floor", "which", "d_ids", "d_v")

    def score(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                dim = batch.column("dim")[r].as_py()
                column = lambda name: batch.column(name)[r].values
                segment = Segment(column("d_ids").to_numpy(zero_copy_only=False), column("d_v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim))
                which = column("which").to_numpy(zero_copy_only=False)
                own = column("q_ids").to_numpy(zero_copy_only=False)[which]
                asking = column("q_v").to_numpy(zero_copy_only=False).reshape(-1, dim)[which]
                rows = [(int(q), i, s) for q, (ids, scores) in zip(own, segment.top(asking, own, column("floor").to_numpy(zero_copy_only=False)[which], k)) for i, s in zip(ids, scores)]
                ids, near_, scores = zip(*rows) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(near_, pa.int64()), pa.array([min(max(s, LEAST), MOST) for s in scores], pa.int64()), pa.array([beyond(s) for s in scores], pa.string())],
                    names=["query_id", "vec_id", "score", "beyond"],
                )

    best = met.mapInArrow(score, "query_id long, vec_id long, score long, beyond string").groupBy("query_id", "vec_id").agg(F.max(F.struct("score", "beyond")).alias("s"))
    order = Window.partitionBy("query_id").orderBy(F.desc("s.score"), F.desc("s.beyond"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "s.score")


def beyond(score: int) -> str:
    """A text that orders scores which one end of the range of longs stands for; empty for others."""
    if LEAST <= score <= MOST:
        return "" if score > LEAST else "~"
    # Sums of products of single-precision numbers, 256 times as large, have fewer than 100 digits.
    return f"{score if score > 0 else 10**100 + score:0100d}"


ORACLE = """
with e as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
           where vec_id is not null and embedding is not null and len(embedding) > 0
             and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id as query_id, d.vec_id, list_dot_product(q.v, d.v)::bigint as score
      from e q join e d on d.vec_id <> q.vec_id and q.vec_id % 50 = 0)
select query_id, (row_number() over (partition by query_id order by score desc, vec_id))::int as rank, vec_id, score
from s qualify row_number() over (partition by query_id order by score desc, vec_id) <= 5
"""
