"""Embedding near-duplicates: a pivot-permutation index with exact verification."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswerk.llm.common import bound_batches, connected_components, stage

#: Reference points: about 4 times the square root of the vectors, within bounds; a description is the NEAR nearest of them.
LEAST_PIVOTS, MOST_PIVOTS, NEAR = 64, 4096, 8
#: A pivot is left out if its cosine with an earlier one is above this, so that copies do not crowd the pivots.
APART = 0.8
#: Vectors are candidates of each other if they share this many of their nearest pivots.
SHARED = 3
#: Vectors that one task groups to clumps, and clumps that one compares, at a time.
ROWS, BLOCK = 512, 2048
#: Clumps of a list from which on they meet in blocks, as two matrices in a task, instead of pair by pair.
LONG_LIST = 512
#: Radians by which a bound must be clear of the threshold.
SLACK = 1e-7


def _unit(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    flat = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    x = flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def usable(vectors: DataFrame, id_col: str, vec_col: str, label_col: str) -> DataFrame:
    """(vec_id, label, v): rows that can link: a label, an id, and a vector without null or non-finite components that is not zero."""
    v = vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[label_col].cast("string").alias("label"), vectors[vec_col].cast("array<double>").alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    return v.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.coalesce(fine, F.lit(False)))


def spread(rows: np.ndarray) -> np.ndarray:
    """The rows, in order, that are not above APART with one taken before."""
    taken: list[int] = []
    for k in range(len(rows)):
        if not taken or (rows[taken] @ rows[k]).max() <= APART:
            taken.append(k)
    return rows[taken]


def describe(v: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Adds ``near``: the numbers of the NEAR nearest pivots, nearest first (ties to the smaller number)."""
    p = pivots
    near = min(NEAR, len(p))

    def run(batches):
        for batch in batches:
            dots = _unit(batch.column("v"), p.shape[1]) @ p.T
            order = np.sort(np.argpartition(-dots, near - 1, axis=1)[:, :near], axis=1)
            order = np.take_along_axis(order, np.argsort(-np.take_along_axis(dots, order, axis=1), axis=1, kind="stable"), axis=1).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, order.size + 1, near), pa.int32()), pa.array(order.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "near"])

    return v.mapInArrow(run, "vec_id long, label string, v array<double>, copies long, near array<int>")


CLUMPED = "vec_id long, label string, v array<double>, copies long, near array<int>, clump long, n long, center array<double>, radius double"


def _clumps(t: pa.Table, dim: int, cos: float) -> pa.Table:
    """Groups a block's rows around mean directions so tightly that all rows of a clump are linked with each other.

    A clump is named by its smallest vec_id, whose row also has the number of
    vectors (copies included), the center and the radius; these are null in the
    others.
    """
    x, ids, copies = _unit(t.column("v"), dim), t.column("vec_id").to_numpy(), t.column("copies").to_numpy()
    tight = math.cos(math.acos(cos) / 2 - 1e-9)
    owner, left = np.full(len(ids), -1), np.argsort(ids, kind="stable")
    n, centers, radius = [None] * len(ids), [None] * len(ids), [None] * len(ids)
    while len(left):
        seed = left[0]
        close = left[x[left] @ x[seed] >= cos]
        center = x[close].sum(axis=0)
        size = np.linalg.norm(center)
        inside = close[x[close] @ (center / size) >= tight] if size > 0 else close[:0]
        if seed not in inside:
            inside = left[:1]
        owner[inside] = ids[inside].min()
        left = left[owner[left] < 0] if (ids >= 0).all() else left[~np.isin(left, inside)]
        head, center = inside[ids[inside].argmin()], x[inside].sum(axis=0)
        center /= np.linalg.norm(center)
        n[head], centers[head] = int(copies[inside].sum()), center
        radius[head] = float(np.arccos(np.clip((x[inside] @ center).min(), -1, 1))) if len(inside) > 1 else 0.0
    own = [t.column(c) for c in ("vec_id", "label", "v", "copies", "near")]
    return pa.table([*own, pa.array(owner, pa.int64()), pa.array(n, pa.int64()), pa.array(centers, pa.list_(pa.float64())), pa.array(radius, pa.float64())], names=[c.split()[0] for c in CLUMPED.split(", ")])


def _pair_links(batch: pa.RecordBatch, dim: int, cos: float):
    """For each pair of clumps: the rows of either that are linked across, and with how many vectors."""
    a_ids, b_ids = batch.column("a_ids"), batch.column("b_ids")
    a_copies, b_copies = batch.column("a_copies"), batch.column("b_copies")
    out = []
    for k in range(batch.num_rows):
        ia, ib = np.array(a_ids[k].as_py()), np.array(b_ids[k].as_py())
        linked = _unit(batch.column("a_v")[k].values, dim) @ _unit(batch.column("b_v")[k].values, dim).T >= cos
        if linked.any():
            for ids, n in ((ia, linked @ np.array(b_copies[k].as_py())), (ib, np.array(a_copies[k].as_py()) @ linked)):
                out += [(int(i), int(c)) for i, c in zip(ids, n) if c]
            out.append((None, None))
        yield k, out
        out = []


def _meet(t: pa.Table, dim: int, most: float) -> pa.Table:
    """Pairs of clumps, each of one block of a list with each of the other (or of the same), that bounds do not rule out."""
    x, r = _unit(t.column("v"), dim), t.column("radius").to_numpy()
    clump, n, block = (t.column(c).to_numpy() for c in ("clump", "n", "block"))
    lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
    a, b = np.flatnonzero(block == lo), np.flatnonzero(block == hi)
    angle, reach = np.arccos(np.clip(x[a] @ x[b].T, -1, 1)), r[a][:, None] + r[b]
    i, j = np.nonzero((angle - reach <= most + SLACK) & ((lo < hi) | (clump[a][:, None] < clump[b])))
    whole = (angle + reach)[i, j] <= most - SLACK
    i, j = a[i], b[j]
    return pa.table({"a": clump[i], "b": clump[j], "a_n": n[i], "b_n": n[j], "bound": pa.array(np.where(whole, "all", "rows").tolist(), pa.string())})


def _linked(spark: SparkSession, v: DataFrame, dim: int, count: int, cos: float) -> DataFrame:
    """(vec_id, n_links, component_id) of the vectors, which are ``count`` of dimension ``dim``."""
    wanted = max(LEAST_PIVOTS, min(MOST_PIVOTS, 4 * math.isqrt(count)))
    drawn = v.select(F.xxhash64("vec_id", F.lit(3)).alias("h"), "vec_id", "v").orderBy("h", "vec_id").limit(wanted).toArrow()
    pivots = spread(_unit(drawn.column("v"), dim))
    described = describe(v, pivots)

    # Clumps: blocks of the rows that have the same label and nearest pivot.
    lists = described.select("*", F.col("near")[0].alias("first"))
    lists = stage(spark, lists, "described")
    sizes = stage(spark, lists.groupBy("label", "first").agg(F.count("*").alias("n")), "sizes")
    dealt = lists.join(sizes, ["label", "first"]).withColumn("block", F.expr(f"pmod(xxhash64(vec_id), ceil(n / {ROWS}))")).drop("n")
    clumped = dealt.repartition("label", "first", "block").groupBy("label", "first", "block").applyInArrow(lambda t: _clumps(t, dim, cos), CLUMPED)
    clumped = stage(spark, clumped, "clumped")
    heads = clumped.where("n is not null").select("clump", "label", "n", F.col("center").alias("v"), "radius")
    big = heads.where("n > 1").select("clump", "n")
    most = math.acos(cos)
    judged_kind = "a long, b long, a_n long, b_n long, bound string"

    def in_blocks(rows: DataFrame, *by: str) -> DataFrame:
        """Clumps of each list (with its number of ``blocks``) that bounds do not keep apart, block by block."""
        dealt = rows.withColumn("block", F.expr("pmod(xxhash64(clump), blocks)")).withColumn("other", F.explode(F.expr("sequence(0L, blocks - 1)")))
        dealt = dealt.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other"))
        return dealt.repartition(*by, "lo", "hi").groupBy(*by, "lo", "hi").applyInArrow(lambda t: _meet(t, dim, most), judged_kind)

    if len(pivots) < LEAST_PIVOTS:
        # Too few pivots tell nothing apart (copies, narrow cones, small tables): all clumps of a label meet.
        counts = stage(spark, heads.groupBy("label").agg(F.ceil(F.count("*") / BLOCK).alias("blocks")), "counts")
        judged = in_blocks(heads.join(counts, "label"), "label")
    else:
        # Inverted lists of SHARED pivots, in which a clump is posted for each of its rows' descriptions: clumps meet if two of their rows share SHARED.
        p = len(pivots)
        near = clumped.select("clump", "label", F.array_sort("near").alias("near")).distinct()
        keys = [reduce(lambda key, i: key * p + F.get("near", F.lit(i)).cast("long"), spots, F.lit(0).cast("long")) for spots in combinations(range(NEAR), SHARED)]
        posted = stage(spark, near.select("clump", "label", F.explode(F.array(*keys)).alias("key")).distinct(), "posted")
        long_ = stage(spark, posted.groupBy("label", "key").agg(F.count("*").alias("m")).where(F.col("m") > LONG_LIST).select("label", "key", F.ceil(F.col("m") / BLOCK).alias("blocks")), "long")
        short = posted.join(long_, ["label", "key"], "left_anti")
        a, b = short.alias("a"), short.alias("b")
        pairs = a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("a.label") == F.col("b.label")) & (F.col("a.clump") < F.col("b.clump"))).select(F.col("a.clump").alias("a"), F.col("b.clump").alias("b")).distinct()

        # Bounds by centers and radii.
        head = lambda s: heads.select(F.col("clump").alias(s), F.col("v").alias(f"{s}_c"), F.col("radius").alias(f"{s}_r"), F.col("n").alias(f"{s}_n"))
        angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.aggregate(F.zip_with("a_c", "b_c", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x))))
        judged = pairs.join(head("a"), "a").join(head("b"), "b").withColumn("angle", angle).select(
            "a", "b", "a_n", "b_n",
            F.when(F.col("angle") + F.col("a_r") + F.col("b_r") <= most - SLACK, "all").when(F.col("angle") - F.col("a_r") - F.col("b_r") > most + SLACK, "none").otherwise("rows").alias("bound"),
        )
        if not long_.isEmpty():
            rows = posted.join(long_, ["label", "key"]).join(heads.drop("label"), "clump")
            judged = judged.union(in_blocks(rows, "label", "key")).groupBy("a", "b").agg(F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"), F.min("bound").alias("bound"))
    judged = stage(spark, judged.where("bound <> 'none'"), "judged")
    whole = judged.where("bound = 'all'")
    open_ = judged.where("bound = 'rows'").select("a", "b")

    # Rows of the clumps that bounds leave open: at most ROWS of either side meet in one task.
    packed = clumped.join(open_.select(F.explode(F.array("a", "b")).alias("clump")).distinct(), "clump", "left_semi").groupBy("clump").agg(F.sort_array(F.collect_list(F.struct("vec_id", "v", "copies"))).alias("m"))
    packed = stage(spark, packed.select("clump", F.col("m.vec_id").alias("ids"), F.col("m.v").alias("vs"), F.col("m.copies").alias("copies")), "packed")
    side = lambda s: packed.select(F.col("clump").alias(s), F.col("ids").alias(f"{s}_ids"), F.col("vs").alias(f"{s}_v"), F.col("copies").alias(f"{s}_copies"))

    def compare(batches):
        for batch in batches:
            rows = []
            for k, links in _pair_links(batch, dim, cos):
                pair = (batch.column("a")[k].as_py(), batch.column("b")[k].as_py())
                rows += [(*pair, i, c) for i, c in links]
            cols = list(zip(*rows)) if rows else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], names=["a", "b", "vec_id", "links"])

    found = stage(spark, open_.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_ids", "a_v", "a_copies", "b_ids", "b_v", "b_copies").mapInArrow(compare, "a long, b long, vec_id long, links long"), "found")

    edges = whole.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(found.where("vec_id is null").select("a", "b"))
    parts = connected_components(spark, edges).withColumnRenamed("id", "clump")
    by_clump = whole.select(F.col("a").alias("clump"), F.col("b_n").alias("c")).union(whole.select("b", "a_n")).groupBy("clump").agg(F.sum("c").alias("across"))
    by_row = found.where("vec_id is not null").groupBy("vec_id").agg(F.sum("links").alias("more"))
    own = clumped.select("vec_id", "clump").join(big.select("clump", "n"), "clump", "left").join(by_clump, "clump", "left").join(parts, "clump", "left").join(by_row, "vec_id", "left")
    zero = F.lit(0).cast("long")
    return own.select("vec_id", (F.coalesce("n", F.lit(1).cast("long")) - 1 + F.coalesce("across", zero) + F.coalesce("more", zero)).alias("n_links"), F.coalesce("component", "clump").alias("component_id"))


def near_duplicates(spark: SparkSession, vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cos: float = 0.93) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id (smallest linked vec_id, itself included), kept.

    Vectors of one label link at a cosine of ``cos`` or more, computed in double
    precision.  Each is described by its nearest pivots (a sample drawn by a hash,
    of bounded size); an inverted list holds the vectors that share SHARED pivots
    of their descriptions, and they are verified.  Where fewer than LEAST_PIVOTS
    are apart, all vectors of a label meet, in blocks.

    Large groups of copies are kept linear: equal vectors of a label are one, with
    the number of its copies, and the rows of a list block are first clumped around mean directions, so tightly that all rows of a clump are
    linked, and a clump is indexed once for each description that its rows have.
    Two clumps are linked as a whole or not at all where their centers and radii
    prove it; else their rows are compared, as two matrices in one task.  So the
    counts of links are exact for all retrieved clumps, without a row for each pair.

    Vectors without id, label, or with null, non-finite or only zero components
    link with nothing.  Each dimension has an index of its own.  Rows that repeat
    a vec_id count as one vector, the smallest by (label, vector).
    Empty tables give no rows; other columns are not read.
    """
    bound_batches(spark)
    v = usable(vectors, id_col, vec_col, label_col)
    v = stage(spark, v.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("x")).select("vec_id", "x.label", "x.v"), "vectors")
    ids = vectors.select(vectors[id_col].cast("long").alias("vec_id")).distinct()
    alike = stage(spark, v.groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("copies")), "alike")
    copy_of = stage(spark, v.join(alike.where("copies > 1"), ["label", "v"]).where("vec_id <> first").select("vec_id", "first"), "copies")
    single = stage(spark, alike.select(F.col("first").alias("vec_id"), "label", "v", "copies"), "distinct")
    dims = single.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.max("copies").alias("most")).where("n > 1 or most > 1").orderBy("dim").collect()
    own = spark.createDataFrame([], "vec_id long, n_links long, component_id long")
    for dim, count, _ in dims:
        own = own.union(_linked(spark, single.where(F.size("v") == dim), dim, count, cos))
    zero = F.lit(0).cast("long")
    out = ids.join(copy_of, "vec_id", "left").withColumn("first", F.coalesce("first", "vec_id")).join(own.withColumnRenamed("vec_id", "first"), "first", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", zero).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
