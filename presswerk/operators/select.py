"""Selection, ordering and topics of articles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from presswerk.functions.text import NO_TOPIC, eff_ts, minute, passes_categories, strip, text


def oldest(articles: DataFrame, limit: int = 2000) -> DataFrame:
    """The first ``limit`` by effective time (ties by pos)."""
    return articles.orderBy("eff_ts", "pos").limit(limit)


def by_filter(articles: DataFrame, sources: list[str], since: int, until: int | None = None, limit: int = 2000) -> DataFrame:
    """Articles of the sources within closed bounds, oldest first; no source, no article."""
    rows = articles.where(F.col("source").isin(sources) & (F.col("eff_ts") >= since)) if sources else articles.where(F.lit(False))
    return oldest(rows if until is None else rows.where(F.col("eff_ts") <= until), limit)


def window(articles: DataFrame, *, since: int | None = None, sources: list[str] | None = None, limit: int | None = 2000) -> DataFrame:
    """Selection of a digest: the filters first, then the limit."""
    rows = articles if sources is None else articles.where(F.col("source").isin(sources))
    rows = rows if since is None else rows.where(F.col("eff_ts") >= since)
    return rows if limit is None else oldest(rows, limit)


def unsummarized(articles: DataFrame, limit: int = 200) -> DataFrame:
    return oldest(articles.where(~F.coalesce("summarized", F.lit(False))), limit)


def by_ids(articles: DataFrame, ids: DataFrame) -> DataFrame:
    """Articles in the order of ``ids`` (ord, id), repeated ids repeated, unknown and blank ones dropped."""
    return ids.where("id <> ''").join(articles, "id")


def override_feeds(feeds: DataFrame, sources: list[str] | None = None, topics: list[str] | None = None) -> DataFrame:
    """Feeds named by ``sources``; without any, those with one of the ``topics``."""
    if sources:
        return feeds.where(F.col("name").isin(sources))
    if topics:
        return feeds.where(F.arrays_overlap("topics", F.array(*map(F.lit, topics))))
    return feeds


def with_topic(articles: DataFrame, feeds: DataFrame) -> DataFrame:
    """Adds the first topic of the article's feed.  Feeds are unique by name, so a hot source only meets one row."""
    first = feeds.groupBy(F.col("name").alias("source")).agg(F.max_by(F.get("topics", F.lit(0)), F.col("url")).alias("topic"))
    return articles.join(first, "source", "left").withColumn("topic", F.coalesce("topic", F.lit(NO_TOPIC)))


def topic_ranks(articles: DataFrame) -> DataFrame:
    """topic, n, rank: most articles first, ties by lower-case name, the fallback topic last."""
    counts = articles.groupBy("topic").agg(F.count("*").alias("n"))
    order = Window.orderBy(F.col("topic") == NO_TOPIC, F.desc("n"), F.lower("topic"))
    return counts.withColumn("rank", F.row_number().over(order))


def topic_spans(articles: DataFrame) -> DataFrame:
    """Smallest and largest positive effective time by topic, 0 without one."""
    ts = F.when(F.col("eff_ts") > 0, F.col("eff_ts"))
    return articles.groupBy("topic").agg(F.coalesce(F.min(ts), F.lit(0)).alias("from_ts"), F.coalesce(F.max(ts), F.lit(0)).alias("to_ts"), F.count("*").alias("n"))


def interleave(articles: DataFrame, *by: str) -> DataFrame:
    """Adds ``ord``: round-robin over sources, within each group of ``by``.

    Round n has the n-th oldest article of each source, sources in order of that
    article's time, then of first appearance.  Only windows are needed; the text
    should be joined back afterwards.
    """
    own = articles.withColumn("__source", F.coalesce(F.nullif(strip(F.col("source")), F.lit("")), F.lit("unknown")))
    per_source = Window.partitionBy(*by, "__source")
    ranked = own.withColumns({"__round": F.row_number().over(per_source.orderBy("ilv_ts", "pos")), "__first": F.min("pos").over(per_source)})
    order = (Window.partitionBy(*by) if by else Window).orderBy("__round", "ilv_ts", "__first")
    return ranked.withColumn("ord", F.row_number().over(order)).drop("__source", "__round", "__first")


def newest_per_feed(entries: DataFrame, max_items: int = 8, *, since: int | None = None) -> DataFrame:
    """With ``since``: dated entries from then on, the newest ``max_items`` of each feed (0: all).  Without: the first ``max_items`` (0: none)."""
    if since is None:
        rn = F.row_number().over(Window.partitionBy("feed").orderBy("pos"))
        return entries.withColumn("rn", rn).where(F.col("rn") <= max_items)
    rn = F.row_number().over(Window.partitionBy("feed").orderBy(F.desc("published_ts"), "pos"))
    rows = entries.where(F.col("published_ts") >= since).withColumn("rn", rn)
    return rows.where(F.col("rn") <= max_items) if max_items else rows


def category_filter(entries: DataFrame, feeds: DataFrame) -> DataFrame:
    """Entries that pass their feed's include and exclude lists; feeds without a config pass all."""
    own = feeds.select(F.col("name").alias("feed"), "category_include", "category_exclude")
    return entries.join(own, "feed", "left").where(passes_categories(F.col("categories"), F.col("category_include"), F.col("category_exclude"))).drop("category_include", "category_exclude")


def numbered(rows: DataFrame, time: str, *ties: str, into: str = "rank", slot: int = 3600) -> DataFrame:
    """Adds the place of each row, the newest first, without one task for all rows.

    Rows are ranked within slots of time; what newer slots hold is added from
    their counts, which are as few as there are slots.
    """
    own = rows.withColumn("__slot", F.floor(F.col(time) / slot))
    newer = Window.orderBy(F.desc("__slot")).rowsBetween(Window.unboundedPreceding, -1)
    before = own.groupBy("__slot").agg(F.count("*").alias("__n")).select("__slot", F.coalesce(F.sum("__n").over(newer), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__slot").orderBy(F.desc(time), *ties))
    ranked = own.withColumn(into, inside).join(before, own["__slot"].eqNullSafe(before["__slot"])).drop(before["__slot"])
    return ranked.withColumn(into, (F.col("__before") + F.col(into)).cast("long")).drop("__slot", "__before")


def decimate(rows: DataFrame, every: int, time: str, *ties: str) -> DataFrame:
    """Every ``every``-th row, the newest first."""
    return numbered(rows, time, *ties, into="__rn").where((F.col("__rn") - 1) % every == 0).drop("__rn")


def snapshots(articles: DataFrame, *by: str) -> DataFrame:
    """Ordered array of article snapshots of each group."""
    fields = [c for c in ("id", "title", "url", "source", "published_ts", "content_hash", "topic") if c in articles.columns]
    rows = articles.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("ord", F.struct(*fields).alias("snapshot")))).alias("s"))
    return rows.select(*by, F.transform("s", lambda x: x["snapshot"]).alias("sources_snapshots"))


def appendix(articles: DataFrame, *by: str) -> DataFrame:
    """Markdown list of sources of each group: sources by lower-case name, their articles newest first."""
    from presswerk.functions.text import NO_SOURCE, NO_TITLE

    source = F.coalesce(F.nullif(strip(F.col("source")), F.lit("")), F.lit(NO_SOURCE))
    title = F.coalesce(F.nullif(strip(F.col("title")), F.lit("")), F.lit(NO_TITLE))
    when = minute(F.col("published_ts"))
    line = F.concat(F.lit("- "), title, F.when(when == "", "").otherwise(F.concat(F.lit(" — "), when)), F.when(strip(F.col("url")) == "", "").otherwise(F.concat(F.lit("\n  "), strip(F.col("url")))))
    items = articles.select(*by, source.alias("src"), F.struct((-F.coalesce("published_ts", F.lit(0))).alias("t"), F.col("pos"), line.alias("line")).alias("item"))
    per_source = items.groupBy(*by, "src").agg(F.array_join(F.transform(F.array_sort(F.collect_list("item")), lambda x: x["line"]), "\n").alias("lines"))
    block = F.struct(F.lower("src").alias("k"), F.col("src"), F.concat(F.lit("### "), "src", F.lit("\n\n"), "lines").alias("block"))
    whole = per_source.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["block"]), "\n\n").alias("blocks"))
    return whole.select(*by, F.concat(F.lit("## Källor\n\n"), "blocks", F.lit("\n")).alias("appendix"))


def feed_topics(feeds: DataFrame) -> DataFrame:
    """Distinct topics, case-insensitively sorted (rank)."""
    t = feeds.select(F.explode("topics").alias("topic")).distinct()
    return t.withColumn("rank", F.row_number().over(Window.orderBy(F.lower("topic"), "topic")))


def with_times(articles: DataFrame) -> DataFrame:
    """Adds eff_ts (stored, so that filters on it are pushed to files) and ilv_ts."""
    return articles.withColumns({"eff_ts": eff_ts(F.col("published_ts"), F.col("fetched_at")), "ilv_ts": F.when(F.col("published_ts") > 0, F.col("published_ts")).otherwise(F.lit(0).cast("long"))})


def snapshot_topics(snapshots: DataFrame) -> DataFrame:
    """id, topic of snapshots (pos, id, topic): the last one wins."""
    return snapshots.where("topic is not null").groupBy("id").agg(F.max_by("topic", "pos").alias("topic"))


def blank_free(ids: DataFrame) -> DataFrame:
    return ids.where(text(F.col("id")) != "")
