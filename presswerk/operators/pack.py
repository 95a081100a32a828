"""Greedy batches of ordered articles."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from presswerk.functions.text import clipped_length, text


def estimate(body_chars: Column, title: Column, url: Column) -> Column:
    """Characters that an article takes in a prompt."""
    return (body_chars + F.length(text(title)) + F.length(text(url)) + 200).cast("int")


def article_estimate(clip: int = 2500) -> Column:
    return estimate(clipped_length(F.col("text"), clip), F.col("title"), F.col("url"))


def pack(rows: DataFrame, *, by: str = "topic", order: str = "ord", size: str = "est_chars", max_chars: int = 18000, max_n: int = 10) -> DataFrame:
    """Adds ``batch_id`` (from 1 in each group) to rows in their order.

    A batch is closed if the next row would exceed ``max_chars`` or it has
    ``max_n`` rows; a row that is too large alone has its own batch, and with
    ``max_n`` 0 each row has one.  The rows of a group are sorted within a
    partition and folded as they stream by, so that a group of any size needs
    constant memory.  Rows should be narrow.
    """
    at, group, step = rows.columns.index(size), rows.columns.index(by), pa.int32()

    def fold(batches):
        key, batch_id, total, n = None, 0, 0, 0
        for b in batches:
            ids = []
            for k, est in zip(b.column(group).to_pylist(), b.column(at).to_pylist()):
                if not batch_id or k != key:
                    key, batch_id, total, n = k, 1, 0, 0
                if n and (total + est > max_chars or n >= max_n):
                    batch_id, total, n = batch_id + 1, 0, 0
                total, n = total + est, n + 1
                ids.append(batch_id)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, step)], names=[*b.schema.names, "batch_id"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.repartition(by).sortWithinPartitions(by, order).mapInArrow(fold, f"{kinds}, batch_id int")


def fits(batch_chars: Column, batch_n: Column, size: Column, max_chars: int, max_n: int) -> Column:
    """Whether an article fits a batch; here ``max_n`` 0 sets no bound."""
    room = batch_chars + size <= max_chars
    return room & (batch_n < max_n) if max_n else room


def batch_stats(packed: DataFrame, *by: str) -> DataFrame:
    from presswerk.functions.text import tokens_of_chars

    ts = F.when(F.col("eff_ts") > 0, F.col("eff_ts"))
    stats = packed.groupBy(*by, "batch_id").agg(F.count("*").alias("n_articles"), F.sum("est_chars").alias("est_chars"), F.coalesce(F.min(ts), F.lit(0)).alias("from_ts"), F.coalesce(F.max(ts), F.lit(0)).alias("to_ts"))
    return stats.withColumn("est_tokens", tokens_of_chars(F.col("est_chars")))


def batch_ids(packed: DataFrame, *by: str) -> DataFrame:
    """Ordered ids of each batch."""
    rows = packed.groupBy(*by, "batch_id").agg(F.array_sort(F.collect_list(F.struct("ord", "id"))).alias("x"))
    return rows.select(*by, "batch_id", F.transform("x", lambda x: x["id"]).alias("ids"))


def rebuild(checkpoint: DataFrame, articles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of the batches of a checkpoint (batch_id, ord, id), missing ids).

    Batches keep their number, so that finished ones are still theirs when
    others have lost all their articles.
    """
    return checkpoint.join(articles, "id"), checkpoint.join(articles.select("id"), "id", "left_anti").select("id").distinct()


def remaining(batches: DataFrame, done: DataFrame, *by: str) -> DataFrame:
    """Batches without a finished summary."""
    return batches.join(done.where(text(F.col("summary")) != "").select(*by, "batch_id"), [*by, "batch_id"], "left_anti")
