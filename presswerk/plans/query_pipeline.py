"""Queries on chat stages, HTML, prompts and the digest: not for SQL, but for the row counts and texts that it can tell."""

from __future__ import annotations

from pyspark.sql import functions as F

from presswerk.functions import text as fn
from presswerk.plans import digest, views
from presswerk.plans.chat import ExtractiveModel
from presswerk.plans.query_articles import SINCE, batch_prompts_sql, topical
from presswerk.plans.registry import query
from presswerk.plans.views import with_views
from presswerk.sources import ingest
from presswerk.streaming.ingest import windowed_counts


#: Main text of a page that has one article and closes what it opens.
_MAIN = r"regexp_replace(regexp_extract(html, '(?s)<article[^>]*>(.*)</article>', 1), '(?s)<!--.*?-->|<(script|style|nav|table|aside)[^>]*>.*?</(script|style|nav|table|aside)>', '', 'g')"
_MAIN = rf"regexp_replace(regexp_replace({_MAIN}, '(?i)</?(p|div|br|li|ul|ol|h[1-6]|section|blockquote|article|main|tr)(\s[^>]*)?/?>', chr(10), 'g'), '</?[a-zA-Z][^>]*>', '', 'g')"
for _entity, _char in (("&lt;?", "<"), ("&gt;?", ">"), ("&quot;?", '"'), ("&#39;", "''"), ("&nbsp;?", " "), ("&amp;?", "&")):
    _MAIN = f"regexp_replace({_MAIN}, '{_entity}', '{_char}', 'g')"
_MAIN = rf"regexp_replace(regexp_replace(regexp_replace({_MAIN}, '[ \t\r\f\v]+', ' ', 'g'), ' ?\n\s*', chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query(f"select page_id, {_MAIN} as text from pages")
def article_text(spark, d):
    return ingest.extract_text(views.table(spark, d, "pages").select("page_id", "html")).select("page_id", "text")


@query(with_views("entries") + rf""", t as (select page_id as pos, {_MAIN} as text from pages)
select sha256(link) as id, link as url, feed as source, title, null::varchar as published, coalesce(published_ts, 0)::bigint as published_ts, {views.NOW}::bigint as fetched_at,
 sha256(title || '|' || link || '|' || regexp_replace(lower(text), '\s+', ' ', 'g')) as content_hash, text
from entries join t using (pos) where link is not null and length(text) >= {ingest.MIN_CHARS}""")
def ingest_articles(spark, d):
    """Pages as fetched entries, to articles with hashes."""
    pages = views.table(spark, d, "pages").select("page_id", "html").withColumnRenamed("page_id", "pos")
    e = views.entries(spark, d).join(pages, "pos").where("link is not null")
    return ingest.articles_of(e, views.NOW).drop("seq")


#: The offline model's answer to a prompt: the first sentence of each of the first 40 paragraphs.
_FIRST = r"array_to_string(list_transform(list_filter(list_transform(string_split_regex(prompt, '\n+'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')[:40], lambda x: regexp_replace(x, '(?s)^(.*?[.!?])\s.*$', '\1')), chr(10))[:4000]"


@query(batch_prompts_sql("'Batch ' || batch_id || '/' || total || chr(10)", f"topic, batch_id, n, ids, {_FIRST} as summary"))
def map_summaries(spark, d):
    """Batches, their articles, and their summaries by the offline model."""
    s = digest.Settings()
    a = topical(spark, d).where(F.col("eff_ts") >= SINCE)
    return digest.map_stage(digest.batches_of(a, s), ExtractiveModel(), s).select("topic", "batch_id", F.size("ids").cast("long").alias("n"), F.array_join("ids", ",").alias("ids"), "summary")


@query()
def topic_digests(spark, d):
    s = digest.Settings(lookback="14d")
    a = topical(spark, d).where(F.col("eff_ts") >= SINCE)
    lines = a.groupBy("topic").agg(F.array_join(F.array_sort(F.collect_list(fn.source_line(F.col("title"), F.col("url")))), "\n").alias("lines"))
    return digest.reduce_stage(digest.map_stage(digest.batches_of(a, s), ExtractiveModel(), s), lines, ExtractiveModel(), s)


@query("select date_trunc('hour', ts) as start, event_type, count(*) as n, round(sum(value), 6) as total from events group by all")
def event_windows(spark, d):
    return windowed_counts(views.table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query(with_views("entries") + f"select feed, pos, link from (select *, row_number() over (partition by feed order by published_ts desc, pos) as rn from entries where published_ts >= {views.NOW - 10 * views.DAY}) where rn <= 8 and link is not null")
def fetch_candidates(spark, d):
    feeds = views.feeds(spark, d)
    e = views.entries(spark, d).withColumn("categories", F.transform("tags", fn.norm_category)).withColumn("published", F.lit(None).cast("string"))
    return ingest.candidates(e, feeds, now=views.NOW, lookback="10d").select("feed", "pos", "link")
