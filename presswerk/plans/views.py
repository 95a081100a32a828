"""Articles, feeds, entries, jobs, summaries and messages as views of the given tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswerk.functions import text as fn

NOW = 1706745600
DAY = 86400


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def articles(spark: SparkSession, d: str, *, hashes: bool = False, flags: bool = False) -> DataFrame:
    """Hash and summarised flag only where wanted: the one reads the text, the other joins labels."""
    doc = table(spark, d, "documents")
    url = F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/"), F.col("doc_id"))
    a = doc.select("doc_id", "source", "text", url.alias("url"), F.concat(F.lit("Doc "), F.col("doc_id")).alias("title")).select(
        F.sha2("url", 256).alias("id"), F.col("doc_id").alias("pos"), "url", "source", "title",
        F.when(F.col("doc_id") % 17 == 0, F.lit(0).cast("long")).otherwise(NOW - (F.col("doc_id") * 7919) % (60 * DAY)).alias("published_ts"),
        (NOW - F.col("doc_id") % 3600).alias("fetched_at"), "text",
    )
    a = a.withColumns({"eff_ts": fn.eff_ts(F.col("published_ts"), F.col("fetched_at")), "ilv_ts": fn.interleave_ts(F.col("published_ts"))})
    if hashes:
        a = a.withColumn("content_hash", fn.content_hash(F.col("title"), F.col("url"), F.col("text")))
    if flags:
        good = table(spark, d, "labels").where("quality = 1").select(F.col("doc_id").alias("pos"), F.lit(True).alias("good")).distinct()
        a = a.join(good, "pos", "left").withColumn("summarized", F.coalesce("good", F.lit(False))).drop("good")
    return a


def feeds(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    names = table(spark, d, "documents").select("source").distinct().withColumn("k", F.regexp_extract("source", r"(\d+)", 1).cast("int"))
    topics = F.when(k % 4 == 0, F.array(F.lit("tech"), F.lit("science"))).when(k % 4 == 1, F.array(F.lit("politics"))).when(k % 4 == 2, F.array(F.lit("sports"))).otherwise(F.array().cast("array<string>"))
    inc = F.when(k % 3 == 0, F.array(F.lit("News "), F.lit("tech"))).otherwise(F.array().cast("array<string>"))
    exc = F.when(k % 5 == 0, F.array(F.lit("ADS"))).otherwise(F.array().cast("array<string>"))
    return names.select(F.col("source").alias("name"), F.concat(F.lit("https://"), "source", F.lit(".example.org/feed")).alias("url"), topics.alias("topics"), inc.alias("category_include"), exc.alias("category_exclude"))


def entries(spark: SparkSession, d: str) -> DataFrame:
    """A page is an entry of its host's feed; every eleventh has no link."""
    p = table(spark, d, "pages").select("page_id", "url")
    host = F.regexp_extract("url", r"://([^/?#]+)", 1)
    pid = F.col("page_id")
    tags = F.when(pid % 3 == 0, F.array(F.lit("News"), F.lit(" Tech  Talk "))).when(pid % 3 == 1, F.array(F.lit("ads"))).otherwise(F.array(F.lit("Sports")))
    ts = F.when(pid % 13 != 0, NOW - (pid * 3571) % (20 * DAY))
    return p.select(host.alias("feed"), pid.alias("pos"), F.when(pid % 11 != 0, F.col("url")).alias("link"), F.concat(F.lit("Page "), pid).alias("title"), tags.alias("tags"), ts.alias("published_ts"), (pid % 7).alias("k"))


def jobs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    created = F.unix_seconds(F.col("ts").cast("timestamp"))
    kind = F.col("event_type")
    status = F.when(kind == "view", "queued").when(kind == "click", "running").when(kind == "error", "failed").otherwise("done")
    done = status.isin("done", "failed")
    return e.select(
        (F.col("event_id") + 1).alias("id"), created.alias("created_at"), F.when(status != "queued", created + 5).alias("started_at"), F.when(done, created + 60).alias("finished_at"),
        status.alias("status"), F.lit("").alias("message"), F.when(status == "done", F.concat(F.lit("sum_"), F.col("event_id"))).alias("summary_id"), F.col("props").alias("fields_json"),
    )


def summaries(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    package = F.when(F.col("event_id") % 3 == 0, "daily_x").when(F.col("event_id") % 3 == 1, "weekly_x").otherwise("adhoc")
    doc = F.concat(F.lit('{"selection":{"prompt_package":"'), package, F.lit('"}}'))
    return e.select(F.concat(F.lit("sum_"), F.col("event_id")).alias("id"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("created"), F.lit("summary").alias("kind"), doc.alias("doc_json"))


def messages(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    rows = c.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return rows.select("conv_id", F.transform("t", lambda m: F.struct(m["role"].alias("role"), m["text"].alias("content"))).alias("messages"))


#: The same views for DuckDB; a query picks those that it needs.
SQL = {
    "articles": f"""articles as (select sha256(url) as id, *, case when published_ts > 0 then published_ts when fetched_at > 0 then fetched_at else 0 end as eff_ts,
   case when published_ts > 0 then published_ts else 0 end as ilv_ts
 from (select doc_id as pos, 'https://' || source || '.example.org/' || doc_id as url, source, 'Doc ' || doc_id as title,
   case when doc_id % 17 = 0 then 0 else {NOW} - (doc_id * 7919) % (60 * {DAY}) end as published_ts, {NOW} - doc_id % 3600 as fetched_at, text,
   exists (select 1 from labels l where l.doc_id = d.doc_id and l.quality = 1) as summarized from documents d))""",
    "feeds": """feeds as (select source as name, 'https://' || source || '.example.org/feed' as url,
   case k % 4 when 0 then ['tech', 'science'] when 1 then ['politics'] when 2 then ['sports'] else []::varchar[] end as topics,
   case when k % 3 = 0 then ['news', 'tech'] else []::varchar[] end as category_include, case when k % 5 = 0 then ['ads'] else []::varchar[] end as category_exclude
 from (select distinct source, regexp_extract(source, '(\\d+)', 1)::int as k from documents))""",
    "entries": f"""entries as (select regexp_extract(url, '://([^/?#]+)', 1) as feed, page_id as pos, case when page_id % 11 <> 0 then url end as link, 'Page ' || page_id as title,
   case page_id % 3 when 0 then ['news', 'tech talk'] when 1 then ['ads'] else ['sports'] end as tags,
   case when page_id % 13 <> 0 then {NOW} - (page_id * 3571) % (20 * {DAY}) end as published_ts, page_id % 7 as k from pages)""",
    "jobs": """jobs as (select event_id + 1 as id, created_at, case when status <> 'queued' then created_at + 5 end as started_at, case when status in ('done', 'failed') then created_at + 60 end as finished_at,
   status, '' as message, case when status = 'done' then 'sum_' || event_id end as summary_id, props as fields_json
 from (select event_id, props, floor(epoch(ts))::bigint as created_at, case event_type when 'view' then 'queued' when 'click' then 'running' when 'error' then 'failed' else 'done' end as status from events))""",
    "summaries": """summaries as (select 'sum_' || event_id as id, floor(epoch(ts))::bigint as created, 'summary' as kind, case event_id % 3 when 0 then 'daily' when 1 then 'weekly' else 'other' end as class from events)""",
    "messages": """messages as (select conv_id, list({'role': role, 'content': text} order by turn, role, text) as messages from conversations group by conv_id)""",
}


def with_views(*names: str, recursive: bool = False) -> str:
    return "with " + ("recursive " if recursive else "") + ",\n".join(SQL[n] for n in names)
