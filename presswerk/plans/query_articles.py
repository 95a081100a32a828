"""Queries on selection, topics, order and batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presswerk.functions import text as fn
from presswerk.operators import pack as pk
from presswerk.operators import select as sel
from presswerk.plans import views
from presswerk.plans.registry import query
from presswerk.plans.views import DAY, NOW, with_views

SINCE = NOW - 14 * DAY
SOURCES = ["src0", "src3", "src5", "src8"]
_IN = ", ".join(f"'{s}'" for s in SOURCES)
_TOPIC = """topics as (select a.*, coalesce(f.topics[1], 'Okategoriserat') as topic from articles a left join feeds f on f.name = a.source)"""
_S = r"regexp_replace(text, '^\s+|\s+$', '', 'g')"
_STRIPPED = r"length(regexp_replace(text, '^\s+|\s+$', '', 'g'))"
_EST = f"(case when {_STRIPPED} <= 6000 then {_STRIPPED} else 6001 end + length(title) + length(url) + 200)::int"
_ORDERED = f"""sel as (select * from topics where eff_ts >= {SINCE}),
r as (select *, row_number() over (partition by topic, source order by ilv_ts, pos) as rn, min(pos) over (partition by topic, source) as sp from sel),
o as (select id, pos, topic, source, eff_ts, {_EST} as est_chars, row_number() over (partition by topic order by rn, ilv_ts, sp)::int as ord from r)"""
_PACKED = """p as (select topic, ord, id, eff_ts, est_chars, 1 as batch_id, est_chars as total, 1 as n from o where ord = 1
  union all select o.topic, o.ord, o.id, o.eff_ts, o.est_chars,
    case when p.total + o.est_chars > 18000 or p.n >= 10 then p.batch_id + 1 else p.batch_id end,
    case when p.total + o.est_chars > 18000 or p.n >= 10 then o.est_chars else p.total + o.est_chars end,
    case when p.total + o.est_chars > 18000 or p.n >= 10 then 1 else p.n + 1 end
  from p join o on o.topic = p.topic and o.ord = p.ord + 1)"""
_PLAN = with_views("articles", "feeds", recursive=True) + f",\n{_TOPIC},\n{_ORDERED},\n{_PACKED}\n"
_TOPICS = with_views("articles", "feeds") + f",\n{_TOPIC}\n"


def topical(spark: SparkSession, d: str, **kw) -> DataFrame:
    return sel.with_topic(views.articles(spark, d, **kw), views.feeds(spark, d))


def ordered(spark: SparkSession, d: str) -> DataFrame:
    """Articles of the last 14 days by topic, interleaved; only what packing needs."""
    rows = topical(spark, d).where(F.col("eff_ts") >= SINCE).withColumn("est_chars", pk.article_estimate(6000))
    return sel.interleave(rows.select("id", "pos", "topic", "source", "eff_ts", "ilv_ts", "est_chars"), "topic")


def packed(spark: SparkSession, d: str) -> DataFrame:
    return pk.pack(ordered(spark, d).select("topic", "ord", "id", "eff_ts", "est_chars"))


@query(_PLAN + "select topic, batch_id, count(*) as n_articles, sum(est_chars)::bigint as est_chars, coalesce(min(case when eff_ts > 0 then eff_ts end), 0) as from_ts, coalesce(max(case when eff_ts > 0 then eff_ts end), 0) as to_ts, greatest(1, floor(sum(est_chars) / 2.4::double))::bigint as est_tokens from p group by all")
def batch_plan(spark, d):
    return pk.batch_stats(packed(spark, d), "topic")


@query(_PLAN + "select topic, ord, id, batch_id, est_chars from p")
def pack_batches(spark, d):
    return packed(spark, d).select("topic", "ord", "id", "batch_id", "est_chars")


@query(_PLAN + "select topic, batch_id, string_agg(id, ',' order by ord) as ids from p group by all")
def batch_id_map(spark, d):
    return pk.batch_ids(packed(spark, d), "topic").select("topic", "batch_id", F.array_join("ids", ",").alias("ids"))


@query(_PLAN + "select topic, id, ord from o")
def interleave_order(spark, d):
    return ordered(spark, d).select("topic", "id", "ord")


@query(_PLAN.replace("p.n >= 10", "p.n >= 0") + "select topic, ord, id, batch_id from p")
def pack_one_each(spark, d):
    return pk.pack(ordered(spark, d).select("topic", "ord", "id", "est_chars"), max_n=0).select("topic", "ord", "id", "batch_id")


@query(_PLAN + "select topic, batch_id, sum(est_chars) + 5000 <= 18000 and count(*) < 10 as fits from p group by all")
def batch_room(spark, d):
    b = packed(spark, d).groupBy("topic", "batch_id").agg(F.sum("est_chars").alias("c"), F.count("*").alias("n"))
    return b.select("topic", "batch_id", pk.fits(F.col("c"), F.col("n"), F.lit(5000), 18000, 10).alias("fits"))


@query(_PLAN + ", c as (select topic, batch_id, ord, id from p) select c.topic, c.batch_id, dense_rank() over (partition by c.topic order by c.batch_id)::int as batch_rank, c.ord, c.id from c join articles a on a.id = c.id and a.pos % 5 <> 0")
def rebuild_batches(spark, d):
    rows, _ = pk.rebuild(packed(spark, d).select("topic", "batch_id", "ord", "id"), views.articles(spark, d).where("pos % 5 <> 0").select("id"))
    return rows.select("topic", "batch_id", F.dense_rank().over(Window.partitionBy("topic").orderBy("batch_id")).alias("batch_rank"), "ord", "id")


@query(_PLAN + "select distinct p.id from p where not exists (select 1 from articles a where a.id = p.id and a.pos % 5 <> 0)")
def resume_missing_ids(spark, d):
    return pk.rebuild(packed(spark, d).select("batch_id", "ord", "id"), views.articles(spark, d).where("pos % 5 <> 0").select("id"))[1]


@query(_PLAN + "select topic, batch_id, count(*) as n from p where batch_id % 2 = 0 group by all")
def resume_remaining(spark, d):
    b = packed(spark, d).groupBy("topic", "batch_id").agg(F.count("*").alias("n"))
    done = b.where("batch_id % 2 = 1").select("topic", "batch_id", F.lit("done").alias("summary"))
    return pk.remaining(b, done, "topic")


@query(with_views("articles") + f"select id, source, eff_ts, pos from articles where source in ({_IN}) and eff_ts >= {SINCE} and eff_ts <= {NOW - DAY} order by eff_ts, pos limit 2000")
def articles_by_filter(spark, d):
    return sel.by_filter(views.articles(spark, d), SOURCES, SINCE, NOW - DAY).select("id", "source", "eff_ts", "pos")


@query(with_views("articles") + "select id, eff_ts, pos from articles order by eff_ts, pos limit 2000")
def articles_oldest(spark, d):
    return sel.oldest(views.articles(spark, d)).select("id", "eff_ts", "pos")


@query(with_views("articles") + "select id, eff_ts, pos from articles where not summarized order by eff_ts, pos limit 200")
def unsummarized(spark, d):
    return sel.unsummarized(views.articles(spark, d, flags=True)).select("id", "eff_ts", "pos")


@query(with_views("articles") + "select id, url, title from articles where pos = 17")
def article_by_id(spark, d):
    a = views.articles(spark, d)
    key = F.sha2(F.concat(F.lit("https://"), F.col("source"), F.lit(".example.org/17")), 256)
    return a.where(F.col("id") == key).select("id", "url", "title")


@query(with_views("articles") + ", i as (select id, row_number() over (order by pos desc) as ord from articles where pos % 3 = 0 union all select id, 1000000 + pos from articles where pos % 30 = 0 union all select 'unknown', 0) select i.ord, a.id, a.title from i join articles a on a.id = i.id")
def by_ids_ordered(spark, d):
    a = views.articles(spark, d)
    third = a.where("pos % 3 = 0").select("id", F.row_number().over(Window.orderBy(F.desc("pos"))).cast("long").alias("ord"))
    ids = third.union(a.where("pos % 30 = 0").select("id", F.col("pos") + 1000000)).union(spark.sql("select 'unknown', 0L"))
    return sel.by_ids(a, ids).select("ord", "id", "title")


@query(with_views("articles") + f"select id, source, eff_ts from articles where source in ({_IN}) and eff_ts >= {SINCE}")
def selection_window(spark, d):
    return sel.window(views.articles(spark, d), since=SINCE, sources=SOURCES, limit=None).select("id", "source", "eff_ts")


@query(with_views("feeds") + "select name, array_to_string(topics, ',') as topics from feeds where list_has_any(topics, ['science', 'sports'])")
def topic_override(spark, d):
    return sel.override_feeds(views.feeds(spark, d), topics=["science", "sports"]).select("name", F.array_join("topics", ",").alias("topics"))


@query(with_views("feeds") + f"select name from feeds where name in ({_IN})")
def source_override(spark, d):
    return sel.override_feeds(views.feeds(spark, d), sources=SOURCES, topics=["sports"]).select("name")


@query(with_views("articles", "feeds") + f"select a.id, a.source from articles a semi join feeds f on f.name = a.source and f.name in ({_IN})")
def articles_of_feeds(spark, d):
    own = sel.override_feeds(views.feeds(spark, d), sources=SOURCES).select(F.col("name").alias("source"))
    return views.articles(spark, d).join(own, "source", "left_semi").select("id", "source")


@query(_TOPICS + "select id, source, topic from topics")
def article_topics(spark, d):
    return topical(spark, d).select("id", "source", "topic")


@query(_TOPICS + "select topic, count(*) as n from topics group by all")
def primary_topic_counts(spark, d):
    return topical(spark, d).groupBy("topic").agg(F.count("*").alias("n"))


@query(_TOPICS + "select topic, n, row_number() over (order by topic = 'Okategoriserat', n desc, lower(topic))::int as rank from (select topic, count(*) as n from topics group by all)")
def topic_rank(spark, d):
    return sel.topic_ranks(topical(spark, d))


@query(_TOPICS + "select topic, coalesce(min(case when eff_ts > 0 then eff_ts end), 0) as from_ts, coalesce(max(case when eff_ts > 0 then eff_ts end), 0) as to_ts, count(*) as n from topics group by all")
def topic_span(spark, d):
    return sel.topic_spans(topical(spark, d))


@query(_TOPICS + f"select topic, string_agg(id, ',' order by eff_ts, pos) as ids from topics where eff_ts >= {SINCE} group by all")
def topic_groups(spark, d):
    a = topical(spark, d).where(F.col("eff_ts") >= SINCE)
    g = a.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("eff_ts", "pos", "id"))).alias("x"))
    return g.select("topic", F.array_join(F.transform("x", lambda x: x["id"]), ",").alias("ids"))


@query(with_views("feeds") + "select topic, row_number() over (order by lower(topic), topic)::int as rank from (select distinct unnest(topics) as topic from feeds)")
def topic_list(spark, d):
    return sel.feed_topics(views.feeds(spark, d))


@query(_TOPICS + f"""select topic, '## Källor' || chr(10) || chr(10) || string_agg('### ' || source || chr(10) || chr(10) || lines, chr(10) || chr(10) order by lower(source), source) || chr(10) as appendix
from (select topic, source, string_agg('- ' || title || case when published_ts > 0 then ' — ' || strftime(to_timestamp(published_ts) at time zone 'UTC', '%Y-%m-%d %H:%M') else '' end || chr(10) || '  ' || url, chr(10) order by published_ts desc, pos) as lines
  from topics where eff_ts >= {SINCE} group by all) group by all""")
def sources_appendix(spark, d):
    return sel.appendix(topical(spark, d).where(F.col("eff_ts") >= SINCE).drop("text"), "topic")


@query(_PLAN + "select o.topic, string_agg(o.id || '|' || a.source || '|' || a.published_ts, ';' order by o.ord) as snapshots from o join articles a on a.id = o.id group by all")
def topic_snapshots(spark, d):
    rows = ordered(spark, d).select("topic", "ord", "id").join(views.articles(spark, d).drop("text"), "id")
    s = sel.snapshots(rows, "topic")
    return s.select("topic", F.array_join(F.transform("sources_snapshots", lambda x: F.concat_ws("|", x["id"], x["source"], x["published_ts"])), ";").alias("snapshots"))


@query(_TOPICS + ", s as (select id, topic, pos from topics union all select id, 'again', pos + 1000000 from topics where pos % 4 = 0) select id, max_by(topic, pos) as topic from s group by id")
def snapshot_topics(spark, d):
    t = topical(spark, d).select("id", "topic", "pos")
    return sel.snapshot_topics(t.union(t.where("pos % 4 = 0").select("id", F.lit("again"), F.col("pos") + 1000000)))


@query(with_views("articles") + "select source, '1w (' || strftime(to_timestamp(min(eff_ts)) at time zone 'UTC', '%Y-%m-%d') || case when strftime(to_timestamp(min(eff_ts)) at time zone 'UTC', '%Y-%m-%d') <> strftime(to_timestamp(max(eff_ts)) at time zone 'UTC', '%Y-%m-%d') then '–' || strftime(to_timestamp(max(eff_ts)) at time zone 'UTC', '%Y-%m-%d') else '' end || ')' as label from articles where eff_ts > 0 group by source")
def lookback_label(spark, d):
    s = views.articles(spark, d).where("eff_ts > 0").groupBy("source").agg(F.min("eff_ts").alias("a"), F.max("eff_ts").alias("b"))
    return s.select("source", fn.lookback_label(F.lit(" 1w "), F.col("a"), F.col("b")).alias("label"))


@query(with_views("entries") + f"select feed, pos, published_ts, rn from (select *, row_number() over (partition by feed order by published_ts desc, pos)::int as rn from entries where published_ts >= {NOW - 10 * DAY}) where rn <= 8")
def newest_n_per_feed(spark, d):
    return sel.newest_per_feed(views.entries(spark, d), 8, since=NOW - 10 * DAY).select("feed", "pos", "published_ts", "rn")


@query(with_views("entries") + "select feed, pos, rn from (select *, row_number() over (partition by feed order by pos)::int as rn from entries) where rn <= 8")
def first_n_per_feed(spark, d):
    return sel.newest_per_feed(views.entries(spark, d), 8).select("feed", "pos", "rn")


def _categorised(spark, d):
    feeds = views.feeds(spark, d).withColumn("k", F.regexp_extract("name", r"(\d+)", 1).cast("long")).where("k < 7")
    e = views.entries(spark, d).withColumn("categories", F.array_distinct(F.filter(F.transform("tags", fn.norm_category), lambda c: c != "")))
    return e.join(feeds.select("k", "name"), "k").drop("feed").withColumnRenamed("name", "feed"), feeds.drop("k")


@query(with_views("entries", "feeds") + "select e.pos, f.name as feed from entries e join feeds f on f.name = 'src' || e.k where not list_has_any(e.tags, f.category_exclude) and (len(f.category_include) = 0 or list_has_any(e.tags, f.category_include))")
def category_filter(spark, d):
    return sel.category_filter(*_categorised(spark, d)).select("pos", "feed")


@query(with_views("entries") + "select pos, array_to_string(list_sort(tags), ',') as categories from entries")
def entry_categories(spark, d):
    none = F.array().cast("array<struct<term:string,label:string,name:string>>")
    tags = F.transform("tags", lambda t: F.struct(F.lit("").alias("term"), F.when(t == "ads", t).alias("label"), t.alias("name")))
    c = fn.categories(F.lit(None).cast("string"), F.lit(None).cast("array<string>"), F.coalesce(tags, none))
    return views.entries(spark, d).select("pos", F.array_join(F.array_sort(c), ",").alias("categories"))


@query(with_views("entries") + f"select pos, link from entries where link is not null and published_ts >= {NOW - 10 * DAY}")
def ingest_candidates(spark, d):
    """Entries with a link, newer than the lookback."""
    e = views.entries(spark, d)
    return e.where((fn.text(F.col("link")) != "") & (F.col("published_ts") >= NOW - F.lit(10 * DAY))).select("pos", "link")


@query(r"select doc_id from documents where length(regexp_replace(text, '^\s+|\s+$', '', 'g')) >= 200")
def long_enough(spark, d):
    return views.table(spark, d, "documents").where(F.length(fn.strip(F.col("text"))) >= 200).select("doc_id")


@query(with_views("summaries") + "select id, created from (select *, row_number() over (order by created desc, id) as rn from summaries) where (rn - 1) % 3 = 0")
def decimate_summaries(spark, d):
    return sel.decimate(views.summaries(spark, d), 3, "created", "id").select("id", "created")


_PROMPTS = (
    _PLAN
    + rf""", corpora as (select topic, batch_id, count(*) as n, string_agg(id, ',' order by rn) as ids,
    string_agg('[' || rn || '] ' || title || ' (' || source || ') ' || url || case when body = '' then '' else chr(10) || body end, chr(10) || chr(10) || '---' || chr(10) || chr(10) order by rn) as corpus from (
    select p.topic, p.batch_id, p.id, row_number() over (partition by p.topic, p.batch_id order by p.ord) as rn, title, source, url, case when length({_S}) <= 6000 then {_S} else {_S}[:6000] || '…' end as body
    from p join articles a on a.id = p.id) group by all),
prompts as (select topic, batch_id, n, ids, %HEAD% || corpus as prompt from (select *, max(batch_id) over (partition by topic) as total from corpora))
select %OUT% from prompts"""
)


def batch_prompts_sql(head: str, out: str) -> str:
    """SQL on the prompts of all batches: ``head`` comes before the articles, ``out`` are the columns."""
    return _PROMPTS.replace("%HEAD%", head).replace("%OUT%", out)


@query(batch_prompts_sql("'Batch ' || batch_id || ' of ' || total || ':' || chr(10)", "topic, batch_id, prompt"))
def batch_prompt(spark, d):
    """The prompt of every batch, with its number and how many its topic has."""
    rows = packed(spark, d).join(views.articles(spark, d).select("id", "title", "source", "url", fn.clip(F.col("text"), 6000).alias("body")), "id")
    rows = rows.withColumn("rn", F.row_number().over(Window.partitionBy("topic", "batch_id").orderBy("ord")))
    block = fn.article_block(F.col("rn"), F.col("title"), F.col("source"), F.col("url"), F.col("body"))
    g = rows.groupBy("topic", "batch_id").agg(F.array_sort(F.collect_list(F.struct("rn", block.alias("b")))).alias("x"))
    total = F.max("batch_id").over(Window.partitionBy("topic"))
    corpus = F.array_join(F.transform("x", lambda x: x["b"]), "\n\n---\n\n")
    prompt = fn.render(F.lit("Batch {batch_index} of {batch_total}:\n{articles_corpus}"), batch_index=F.col("batch_id").cast("string"), batch_total=total.cast("string"), articles_corpus=corpus)
    return g.select("topic", "batch_id", prompt.alias("prompt"))
