"""Near-duplicate documents: MinHash bands, sequential Bayesian pruning, exact verification."""

from __future__ import annotations

import contextlib
import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswerk.llm.common import ChunkMemo, bound_batches, connected_components, drop_state, freeing_shuffles, give_back_memory, in_groups, stage

#: Bands of ROWS signature values each.  A pair at similarity 0.85 shares no band with probability 4e-7, at 0.8 with 5e-5.
BANDS, ROWS = 25, 5
HASHES = BANDS * ROWS
#: Signature values compared at a time, and the chance that a step drops a pair at the threshold.
STEP, MISS = 25, 1e-6
#: Rows of a bucket, and shingles of them, that one task compares with as many others.
BLOCK, BLOCK_SHINGLES = 512, 1 << 19

_M = np.uint64(0x9E3779B97F4A7C15)
_N = np.uint64(0xC2B2AE3D27D4EB4F)


def words_of(text: str) -> list[bytes]:
    """A-Z lower-cased, split at ASCII white space; the rules of ``bytes.lower`` and ``bytes.split``."""
    return text.encode("utf-8", "replace").lower().split()


@contextlib.contextmanager
def _memo():
    """A memo of word hashes for one task.

    A word is hashed so fast that it need not be remembered longer, while the
    workers, of which several wait at a time, would each hold on to theirs.
    """
    import xxhash

    drop_state()
    memo = ChunkMemo(lambda words: [xxhash.xxh3_64_digest(w) for w in words])
    try:
        yield memo
    finally:
        memo.clear()
        give_back_memory()


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles, from those of its words."""
    if not len(words):
        return words
    size = min(size, len(words))
    n = len(words) - size + 1
    h = np.full(n, size, np.uint64)
    for k in range(size):
        h = (h ^ (h >> np.uint64(31))) * _M + words[k : k + n]
    h = (h ^ (h >> np.uint64(29))) * _N
    return np.unique(h ^ (h >> np.uint64(32)))


@functools.lru_cache(maxsize=1)
def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240201)
    return rng.integers(0, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The last 16 bits of the least value of each of HASHES multiply-shift permutations; different values agree in them by chance once in 65,536 times."""
    a, b = _permutations()
    low = np.full(HASHES, 0xFFFFFFFF, np.uint64)
    for at in range(0, len(hashes), 256):
        low = np.minimum(low, ((hashes[at : at + 256, None] * a + b) >> np.uint64(32)).min(axis=0))
    return (low & np.uint64(0xFFFF)).astype("<u2")


@functools.lru_cache(maxsize=8)
def least_matches(num: int, den: int) -> tuple[int, ...]:
    """After 1, 2, ... steps: the fewest equal values with which a pair stays.

    Under a uniform prior the similarity's posterior after k of m equal values
    is Beta(k+1, m-k+1), and P(similarity >= t) = P(Binomial(m+1, t) <= k).
    """
    t, out = num / den, []
    for m in range(STEP, HASHES + 1, STEP):
        total, k = 0.0, -1
        while total < MISS:
            k += 1
            total += math.comb(m + 1, k) * t**k * (1 - t) ** (m + 1 - k)
        out.append(k)
    return tuple(out)


def stays(a: np.ndarray, b: np.ndarray, least: tuple[int, ...]) -> np.ndarray:
    """Which rows of two signature matrices remain after all steps; a step looks only at those that remained."""
    left, matches = np.arange(len(a)), np.zeros(len(a), np.int64)
    for step, k in enumerate(least):
        cut = slice(step * STEP, (step + 1) * STEP)
        matches = matches + (a[left, cut] == b[left, cut]).sum(axis=1)
        on = matches >= k
        left, matches = left[on], matches[on]
    return left


def similar(words_a: list[bytes], words_b: list[bytes], size: int, num: int, den: int) -> bool:
    """den * |A and B| >= num * |A or B| over the full shingle sets, without hashing."""
    if not words_a or not words_b or (len(words_a) < size) != (len(words_b) < size):
        return False
    if len(words_a) < size:
        return words_a == words_b
    ids: dict[bytes, int] = {}
    x = np.fromiter((ids.setdefault(w, len(ids)) for w in (*words_a, *words_b)), np.int64, len(words_a) + len(words_b))
    a, b = x[: len(words_a)], x[len(words_a) :]
    na, nb, wide = len(a) - size + 1, len(b) - size + 1, len(ids)
    code = np.concatenate([a[:na], b[:nb]])
    for k in range(1, size):
        code = code * wide + np.concatenate([a[k : k + na], b[k : k + nb]])
        if k + 1 < size and wide * wide * (len(code) + 1) >= 1 << 62 or k + 1 < size and int(code.max()) >= (1 << 62) // max(wide, 1):
            code = np.unique(code, return_inverse=True)[1]
    in_a, in_b = np.unique(code[:na]), np.unique(code[na:])
    both = len(np.intersect1d(in_a, in_b, assume_unique=True))
    return den * both >= num * (len(in_a) + len(in_b) - both)


def signatures(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(doc_id, n_shingles, c1, c2, sig): c1 and c2 are equal for equal shingle sets."""

    def run(batches):
        with _memo() as memo:
            yield from described(batches, memo)

    def described(batches, memo):
        for batch in batches:
            n, c1, c2, sig = [], [], [], []
            for texts in in_groups(batch.column(1)):
                for buffer in memo.buffers([words_of(x) for x in texts]):
                    h = shingle_hashes(np.frombuffer(buffer, np.uint64), size)
                    n.append(len(h))
                    c1.append(int(np.add.reduce(h, initial=np.uint64(0)).astype(np.int64)))
                    c2.append(int(np.bitwise_xor.reduce(h * _M >> np.uint64(7), initial=np.uint64(0)).astype(np.int64)))
                    sig.append(signature(h).tobytes() if len(h) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(sig, pa.binary())], names=["doc_id", "n_shingles", "c1", "c2", "sig"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, n_shingles long, c1 long, c2 long, sig binary")


def _pruned(pairs: DataFrame, sigs: DataFrame, num: int, den: int) -> DataFrame:
    """The (a, b) whose signatures stay."""
    least = least_matches(num, den)

    def run(batches):
        drop_state()
        for batch in batches:
            m = [np.frombuffer(b"".join(batch.column(k).to_pylist()), "<u2").reshape(-1, HASHES) for k in (2, 3)]
            yield batch.select([0, 1]).take(pa.array(stays(*m, least)))

    with_a = pairs.join(sigs.select(F.col("doc_id").alias("a"), F.col("sig").alias("sig_a")), "a")
    with_b = with_a.join(sigs.select(F.col("doc_id").alias("b"), F.col("sig").alias("sig_b")), "b")
    return with_b.select("a", "b", "sig_a", "sig_b").mapInArrow(run, "a long, b long")


def _verified(pairs: DataFrame, texts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """The (a, b) whose full shingle sets are similar."""

    def run(batches):
        drop_state()
        for batch in batches:
            keep, last, words = [], None, []
            for k, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                y = y.as_py()
                if y != last:
                    last, words = y, words_of(y)
                if similar(words_of(x.as_py()), words, size, num, den):
                    keep.append(k)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    joined = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


def _rest(spark: SparkSession, bands: DataFrame, reps: DataFrame, texts: DataFrame, parts: DataFrame, size: int, num: int, den: int) -> DataFrame:
    """Links within buckets between classes that are not connected yet, enough of them to connect what is linked.

    Only buckets that still hold two components take part.  There the rows that
    are not in the component of the bucket's smallest class ask, and all rows are
    asked, in blocks bounded by rows and shingles, so that no task gathers a
    bucket and a large group of copies is dealt once for each block of the rest.
    A task holds a pair's signatures against each other in the first band that
    both share, and those that stay by their full sets of 64-bit shingle hashes;
    a link joins two components, whose other pairs need no look, so that a task
    gives fewer rows than it has read.
    """
    least = least_matches(num, den)
    now = bands.join(parts.withColumnRenamed("id", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    main = now.where("rep = leader").select("key", F.col("component").alias("main")).distinct()
    blocks = lambda c: F.ceil(F.greatest(F.count(c) / BLOCK, F.coalesce(F.sum(F.when(c, F.col("n_shingles"))), F.lit(0)) / BLOCK_SHINGLES)).cast("int")
    apart = F.col("component") != F.col("main")
    mixed = stage(spark, now.join(main, "key").groupBy("key", "main").agg(blocks(F.when(apart, True)).alias("askers"), blocks(F.lit(True)).alias("asked")).where("askers > 0"), "mixed")
    rows = stage(spark, now.join(mixed, "key").select("key", "band", "rep", "component", "main", "askers", "asked"), "rows")

    def sets(batches):
        with _memo() as memo:
            yield from held_by(batches, memo)

    def held_by(batches, memo):
        for batch in batches:
            out = []
            for group in in_groups(batch.column(1)):
                out += [shingle_hashes(np.frombuffer(x, np.uint64), size).tobytes() for x in memo.buffers([words_of(t) for t in group])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["rep", "hashes"])

    wanted = rows.select("rep").distinct()
    own = texts.select(F.col("doc_id").alias("rep"), "text").join(wanted, "rep", "left_semi").mapInArrow(sets, "rep long, hashes binary")
    members = stage(spark, own.join(reps.select(F.col("doc_id").alias("rep"), "sig"), "rep"), "members")
    asker = rows.where(apart).selectExpr("key", "band", "rep", "component", "cast(pmod(xxhash64(rep), askers) as int) as i", "explode(sequence(0, asked - 1)) as j", "true as asks")
    asked = rows.selectExpr("key", "band", "rep", "component", "explode(sequence(0, askers - 1)) as i", "cast(pmod(xxhash64(rep), asked) as int) as j", "false as asks")
    dealt = asker.union(asked).join(members, "rep")

    def run(t: pa.Table) -> pa.Table:
        band, asks = t.column("band")[0].as_py(), t.column("asks").to_numpy()
        rep, part = t.column("rep").to_numpy(), t.column("component").to_numpy().copy()
        sig = np.frombuffer(b"".join(t.column("sig").to_pylist()), "<u2").reshape(-1, HASHES)
        held, found = [np.frombuffer(x, np.uint64) for x in t.column("hashes").to_pylist()], []
        for k in np.flatnonzero(asks):
            other = np.flatnonzero(~asks & (part != part[k]))
            if band and len(other):
                before = (sig[other, : band * ROWS] == sig[k, : band * ROWS]).reshape(len(other), band, ROWS).all(axis=2).any(axis=1)
                other = other[~before]
            other = other[stays(np.broadcast_to(sig[k], (len(other), HASHES)), sig[other], least)]
            for o in other:
                if part[o] != part[k]:
                    a, b = held[k], held[o]
                    if den * min(len(a), len(b)) < num * max(len(a), len(b)):
                        continue
                    both = int(np.count_nonzero(a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b))
                    if den * both >= num * (len(a) + len(b) - both):
                        found.append((max(rep[k], rep[o]), min(rep[k], rep[o])))
                        part[part == part[o]] = part[k]
        a, b = zip(*found) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return dealt.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


@freeing_shuffles
def near_duplicates(spark: SparkSession, docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest linked doc_id), kept.

    Documents are linked when den * |A and B| >= num * |A or B| over their sets of
    ``size``-word shingles.  Equal sets are one class, represented by its smallest
    doc_id.  Within a bucket of a band, first each class is held against the
    smallest one (a star, linear in the bucket); then only classes that are still
    in different components are held against each other, block by block.  Pairs
    are pruned batch by batch of signature values and verified on whole texts.

    Null and empty texts have no shingles and link with nothing; a text of fewer
    words than ``size`` is one shingle.  A null id links with nothing, has no
    component and is not kept.  Rows that repeat a document's text are rows of
    one class each; texts that share a doc_id are linked through it.  An empty
    table gives no rows.  Other columns are not read.
    """
    bound_batches(spark)
    rows = stage(spark, signatures(docs, id_col, text_col, size), "signatures")
    full = rows.where("n_shingles > 0 and doc_id is not null")
    classes = stage(spark, full.groupBy("c1", "c2").agg(F.min("doc_id").alias("rep")), "classes")
    of_class = rows.select("doc_id", "n_shingles", "c1", "c2").join(classes, ["c1", "c2"], "left")
    of_class = stage(spark, of_class.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("rep")).alias("rep"), "c1", "c2"), "of_class")
    # Of each class the row of its smallest id; an id can be that of several classes.
    first = of_class.where("doc_id = rep").select("doc_id", "c1", "c2").distinct()
    reps = stage(spark, full.join(first, ["doc_id", "c1", "c2"], "left_semi").dropDuplicates(["doc_id", "c1", "c2"]).select("doc_id", "n_shingles", "sig"), "reps")
    texts = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).where("text is not null")
    shared = stage(spark, of_class.where("rep is not null").groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count("*").alias("n")).where("n > 1"), "shared")
    if not shared.isEmpty():
        texts = texts.dropDuplicates(["doc_id", "text"])
    same_id = of_class.join(shared.where("lo < hi").select("doc_id", "lo"), "doc_id").where("rep <> lo").select(F.col("rep").alias("a"), F.col("lo").alias("b"))

    each = reps.select(F.col("doc_id").alias("rep"), "n_shingles", "sig", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))).alias("band"))
    keyed = each.select("rep", "n_shingles", "band", F.expr(f"xxhash64(band, substring(sig, {2 * ROWS} * band + 1, {2 * ROWS}))").alias("key"))
    leaders = keyed.groupBy("key").agg(F.min("rep").alias("leader"), F.count("*").alias("n")).where("n > 1").select("key", "leader")
    bands = stage(spark, keyed.join(leaders, "key").select("key", "band", "rep", "n_shingles", "leader"), "bands")

    star = stage(spark, bands.where("rep <> leader").select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct(), "pairs")
    tested = stage(spark, _pruned(star, reps, num, den).distinct(), "pruned")
    links = stage(spark, _verified(tested, texts, size, num, den).union(same_id).distinct(), "links")
    parts = connected_components(spark, links.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    rest = stage(spark, _rest(spark, bands, reps, texts, parts, size, num, den).distinct(), "rest")
    more = stage(spark, _verified(rest, texts, size, num, den), "links")
    if not more.isEmpty():
        edges = links.union(more).select(F.col("a").alias("src"), F.col("b").alias("dst"))
        parts = connected_components(spark, edges)

    whole = of_class.join(parts.withColumnRenamed("id", "rep"), "rep", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id"))
    return whole.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))
