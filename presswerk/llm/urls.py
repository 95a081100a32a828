"""URL filters: host and path rules, and a blocked Bloom filter before an exact join."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswerk.llm.common import stage

#: One odd multiplier below 2**30 for each of a block's eight 32-bit words, so that products with 32 bits fit a long.
SALTS = tuple(((2 * k + 1) * 0x2545F491) & 0x3FFFFFFF | 1 for k in range(8))
#: A block has 256 bits; about 16 listed URLs share one.
URLS_PER_BLOCK = 16
#: A filter of at most so many blocks (32 MB) is sent to all workers; a larger one is a table that pages are joined with.
MAX_BLOCKS = 1 << 20

#: Rules of the production query: (host, path) and verdict.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """Host without ``www.`` or ``m.``, path without closing ``/``, query without tracking keys; no scheme or fragment."""
    query = F.split(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), "&")
    query = F.array_join(F.filter(query, lambda p: (p != "") & ~p.rlike("^(utm_[^=]*|ref|fbclid|gclid)(=|$)")), "&")
    return F.concat(F.regexp_replace(host_of(url), r"^(www|m)\.", ""), F.regexp_replace(path_of(url), "/+$", ""), F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule whose host is the url's or a parent of it and whose path starts the url's; null without one.

    The rules are few and part of the plan, so no join or shuffle is needed.
    """
    name = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name = F.when(fits, h + p).otherwise(F.lit(None) if name is None else name)
        verdict = F.when(fits, v).otherwise(F.lit(None) if verdict is None else verdict)
    return name.cast("string"), verdict.cast("string")


def block_of(h: Column, count: int) -> Column:
    return F.pmod(F.shiftrightunsigned(h, 32), F.lit(count))


def bits_of(hash_col: str) -> list[Column]:
    """The bit of each of a block's words that an entry sets."""
    return [F.expr(f"shiftleft(1, cast(shiftrightunsigned((({hash_col} & 4294967295L) * {m}L) & 4294967295L, 27) as int))") for m in SALTS]


def block_table(listed: DataFrame, hash_col: str, count: int) -> DataFrame:
    """block, w0 to w7: the blocks that hold an entry, put together by bit_or (combined before the shuffle)."""
    return listed.groupBy(block_of(F.col(hash_col), count).cast("int").alias("block")).agg(*[F.bit_or(b).alias(f"w{k}") for k, b in enumerate(bits_of(hash_col))])


class BlockedBloom:
    """256-bit blocks; an entry sets one bit in each of its block's eight words."""

    def __init__(self, words: np.ndarray):
        self.words = words

    @staticmethod
    def of(blocks: DataFrame, count: int) -> BlockedBloom:
        """The filter of a table of blocks, as ``block_table`` gives it."""
        words = np.zeros((count, len(SALTS)), np.uint32)
        got = blocks.toArrow()
        if got.num_rows:
            words[got.column("block").to_numpy()] = np.stack([got.column(f"w{k}").to_numpy().astype(np.int32).view(np.uint32) for k in range(len(SALTS))], axis=1)
        return BlockedBloom(words)

    def __contains__(self, h: int) -> bool:
        return bool(self.hits(np.array([h], np.int64))[0])

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        h = hashes.view(np.uint64)
        rows = self.words[((h >> np.uint64(32)) % np.uint64(len(self.words))).astype(np.int64)]
        low = h & np.uint64(0xFFFFFFFF)
        bit = np.stack([np.uint32(1) << ((low * np.uint64(s) & np.uint64(0xFFFFFFFF)) >> np.uint64(27)).astype(np.uint32) for s in SALTS], axis=1)
        return ((rows & bit) == bit).all(axis=1)


def _probed(spark: SparkSession, rows: DataFrame, blocks: DataFrame, count: int) -> DataFrame:
    """``rows`` with ``maybe``, from a filter that every worker has."""
    bloom = spark.sparkContext.broadcast(BlockedBloom.of(blocks, count))

    def probe(batches):
        for b in batches:
            maybe = bloom.value.hits(b.column("h").to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(maybe)], names=[*b.schema.names, "maybe"])

    return rows.mapInArrow(probe, "page_id long, host string, path string, canonical string, rule string, by_rule string, h long, maybe boolean")


def _joined(rows: DataFrame, blocks: DataFrame, count: int) -> DataFrame:
    """``rows`` with ``maybe``, from a filter whose blocks are rows of a table: of any size, at the cost of a shuffle by block."""
    both = rows.withColumn("block", block_of(F.col("h"), count).cast("int")).join(blocks, "block", "left")
    maybe = F.lit(True)
    for k, bit in enumerate(bits_of("h")):
        maybe = maybe & (F.coalesce(F.col(f"w{k}"), F.lit(0)).bitwiseAND(bit) == bit)
    return both.select(*rows.columns, maybe.alias("maybe"))


def judge(spark: SparkSession, pages: DataFrame, listed: DataFrame, rules=RULES, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """page_id, host, path, rule, verdict, canonical: the rule's verdict, else block if the canonical URL is listed, else allow.

    The filter passes possible hits; only they are joined with the list, on the
    canonical URL itself, which removes false positives.  The list is distinct,
    so a URL that many pages share has one row on that side.

    Null URLs and URLs without ``://`` have an empty host and path, fit no rule
    and are allowed.  Every input row gives a row, repeated ones too.  A null
    page_id stays null.  Empty tables give no rows; other columns are not read.
    """
    wanted = stage(spark, listed.select(canonical(listed["url"]).alias("canon")).where("canon <> ''").distinct().withColumn("h", F.xxhash64("canon")), "listed")
    count = max(1, -(-wanted.count() // URLS_PER_BLOCK))
    url = pages["url"]
    rows = pages.select(pages["page_id"].cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), F.coalesce(canonical(url), F.lit("")).alias("canonical"))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("by_rule"), F.xxhash64("canonical").alias("h"))
    blocks = block_table(wanted, "h", count)
    probed = stage(spark, _probed(spark, rows, blocks, count) if count <= max_blocks else _joined(rows, blocks, count), "probed")
    sure = probed.where("not maybe").withColumn("found", F.lit(None).cast("boolean"))
    hits = probed.where("maybe").join(wanted.select(F.col("canon").alias("canonical"), F.lit(True).alias("found")), "canonical", "left")
    both = sure.unionByName(hits)
    return both.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("found"), "block").otherwise("allow")).alias("verdict"), "canonical")


def feed_list(pages: DataFrame) -> DataFrame:
    """The production query's list: URLs that were taken from a feed or whose host is a spam host.  Null URLs are not in it; an empty table gives none."""
    return pages.where(pages["url"].rlike("[?&]utm_source=feed") | host_of(pages["url"]).rlike(r"(^|\.)spam"))


_PARTS = r"""
u as (select page_id, url,
        coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') as host,
        coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') as path,
        array_to_string(list_filter(string_split(regexp_extract(url, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' and not regexp_matches(p, '^(utm_[^=]*|ref|fbclid|gclid)(=|$)')), '&') as query
      from pages),
c as (select *, coalesce(regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/+$', '') || case when query <> '' then '?' || query else '' end, '') as canonical from u),
l as (select distinct canonical from c where canonical <> '' and (regexp_matches(url, '[?&]utm_source=feed') or regexp_matches(host, '(^|\.)spam')))
"""


def oracle(rules=RULES) -> str:
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')" for h, p, _ in ordered]
    rule = "case " + " ".join(f"when {f} then '{h + p}'" for f, (h, p, _) in zip(fits, ordered)) + " end"
    verdict = "case " + " ".join(f"when {f} then '{v}'" for f, (_, _, v) in zip(fits, ordered)) + " end"
    return f"""with {_PARTS}
select page_id, host, path, {rule} as "rule", coalesce({verdict}, case when l.canonical is not null then 'block' else 'allow' end) as verdict, c.canonical
from c left join l on l.canonical = c.canonical"""
