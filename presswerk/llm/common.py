"""Shared folder, staged tables, connected components, memo of chunks."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors see.

    It is what ``spark.checkpoint.dir`` names.  Where that is unset a temporary
    folder is made, which is right for a local master only; on a cluster the
    setting is required.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="presswerk-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/presswerk/{uuid.uuid4().hex}/{name}"


def stage(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage, lets a lost executor's work be read again, and gives
    the planner the real size, so that a join is broadcast only if it is small.
    """
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def freeing_shuffles(f: Callable) -> Callable:
    """For f(spark, ...): the shuffle files of each query that runs in it go as soon as the query has ended.

    Else they stay until the driver happens to collect its garbage, so that
    those of all staged tables add up.  What is staged is read from its files.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    @functools.wraps(f)
    def run(spark: SparkSession, *args, **kwargs):
        before = spark.conf.get(key, "false")
        spark.conf.set(key, "true")
        try:
            return f(spark, *args, **kwargs)
        finally:
            spark.conf.set(key, before)

    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def connected_components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(id, component) of every node of ``edges`` (src, dst long).

    Alternates large-star and small-star steps until the edge set is stable; a
    node's component is then the smallest id it reaches.  A step is a grouped
    minimum (combined before the shuffle) and a join, so that a hub's edges are
    never gathered in one task's memory.
    """
    e = edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct()
    e = stage(spark, e, "edges")
    mark = None
    while True:
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        if now == mark or not now[0]:
            break
        mark = now
        sym = e.union(e.select("v", "u"))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = sym.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(low, "u")
            .select(F.explode(F.array(F.struct("u", "m"), F.struct(F.col("v").alias("u"), "m"))).alias("e"))
            .select("e.u", F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        e = stage(spark, small, "edges")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v").distinct())


class ChunkMemo(dict):
    """Maps white-space-free chunks to the bytes that ``make`` gives for a list of new ones.

    A text becomes one buffer, the joined bytes of its chunks, at the cost of a
    dictionary look-up each.  What is remembered takes about ``limit`` bytes at
    most: the chunks that come first, among which the frequent ones are, of 64
    characters or less.
    """

    #: Bytes that an entry takes besides its characters.
    ENTRY = 200

    def __init__(self, make: Callable[[list], list[bytes]], limit: int = 48 << 20):
        super().__init__()
        self.make, self.limit, self.held = make, limit, 0

    def buffers(self, texts: list[list]) -> list[bytes]:
        """One buffer for each list of chunks."""
        new = list(set().union(*texts).difference(self))
        made = self.make(new)
        self.update(zip(new, made))
        out = [b"".join(map(self.__getitem__, chunks)) for chunks in texts]
        for chunk, value in zip(new, made):
            size = self.ENTRY + len(chunk) + len(value)
            if len(chunk) > 64 or self.held + size > self.limit:
                del self[chunk]
            else:
                self.held += size
        return out


def give_back_memory() -> None:
    """Return to the system what this process has freed; allocators keep it otherwise."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


_worker_state: dict = {}


def worker_state(key, make: Callable):
    """What ``make`` gives, kept by this Python worker until it is asked for another key.

    Workers outlive a stage, so one that has read a model for one operator must
    let go of it before it reads another's.
    """
    if key not in _worker_state:
        drop_state()
        _worker_state[key] = make()
    return _worker_state[key]


def drop_state() -> None:
    """Lets go of what another operator has left in this worker."""
    if _worker_state:
        _worker_state.clear()
        give_back_memory()


def in_groups(values, chars: int = 1 << 20):
    """Lists of texts (null as empty) of about ``chars`` characters, so that memory follows neither batch nor table."""
    group, size = [], 0
    for v in values:
        text = v.as_py() or ""
        group.append(text)
        size += len(text) + 1
        if size >= chars:
            yield group
            group, size = [], 0
    if group:
        yield group


def bound_batches(spark: SparkSession, size: str = "8m") -> None:
    """Bound the Arrow batches to Python by bytes, since texts and blocks are of any length.

    This is a setting of the session, so it holds for its later queries too.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
