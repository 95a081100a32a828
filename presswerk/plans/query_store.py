"""Queries on writes, jobs and retention: the resulting state."""

from __future__ import annotations

from pyspark.sql import functions as F

from presswerk.operators import store as st
from presswerk.plans import views
from presswerk.plans.registry import query
from presswerk.plans.views import DAY, NOW, with_views

_A = with_views("articles")
_J = with_views("jobs")
_SUM = with_views("summaries")


def _stored(spark, d):
    return views.articles(spark, d).where("pos % 3 <> 0").select("id", "source", "title", F.concat(F.lit("h"), "pos").alias("content_hash"), F.lit(True).alias("summarized"))


def _new(spark, d):
    a = views.articles(spark, d).where("pos % 2 = 0")
    one = a.select("id", "source", F.concat("title", F.lit(" v1")).alias("title"), F.concat(F.lit("h"), "pos").alias("content_hash"), F.lit(1).alias("seq"))
    two = a.where("pos % 4 = 0").select("id", "source", F.concat("title", F.lit(" v2")), F.concat(F.lit("g"), "pos"), F.lit(2))
    return one.union(two)


_STATE = """, stored as (select id, source, title, 'h' || pos as content_hash, true as summarized from articles where pos % 3 <> 0),
new as (select id, source, title || case when pos % 4 = 0 then ' v2' else ' v1' end as title, case when pos % 4 = 0 then 'g' else 'h' end || pos as content_hash from articles where pos % 2 = 0)
"""


@query(_A + _STATE + "select id, source, title, content_hash, null::boolean as summarized from new union all select * from stored where id not in (select id from new)")
def upsert_replace(spark, d):
    return st.upsert(_stored(spark, d), _new(spark, d))


@query(_A + _STATE + "select n.id, n.source, n.title, n.content_hash, s.summarized from new n left join stored s using (id) union all select * from stored where id not in (select id from new)")
def upsert_merge(spark, d):
    return st.upsert(_stored(spark, d), _new(spark, d), mode="merge")


@query(_A + _STATE + "select n.id, case when s.id is null then 'insert' when s.content_hash <> n.content_hash then 'update' else 'unchanged' end as action from new n left join stored s using (id)")
def upsert_actions(spark, d):
    return st.change_actions(_stored(spark, d), st.latest(_new(spark, d), ["id"], "seq")).select("id", "action")


@query(_A + _STATE + "select case when s.id is null then 'insert' when s.content_hash <> n.content_hash then 'update' else 'unchanged' end as action, count(*) as n from new n left join stored s using (id) group by 1")
def ingest_counters(spark, d):
    return st.change_actions(_stored(spark, d), st.latest(_new(spark, d), ["id"], "seq")).groupBy("action").agg(F.count("*").alias("n"))


@query(_A + f"select id, summarized or pos % 5 = 0 as summarized, case when pos % 5 = 0 then {NOW} end::bigint as summarized_at from articles")
def mark_summarized(spark, d):
    a = views.articles(spark, d, flags=True)
    ids = a.where("pos % 5 = 0").select("id").union(spark.sql("select 'unknown'"))
    return st.mark_summarized(a, ids, NOW).select("id", "summarized", "summarized_at")


def _events(spark, d):
    """Each event is a change of one of some jobs."""
    e = views.jobs(spark, d)
    job = (F.col("id") % F.greatest(F.lit(1), F.lit(500)) + 1).alias("job_id")
    return e.select(job, F.col("id").alias("seq"), F.when(F.col("id") <= 500, F.col("created_at")).alias("created_at"), "started_at", "finished_at", "status", F.concat(F.lit("m"), "id").alias("message"), F.when(F.col("id") % 7 == 0, "none").otherwise(F.col("summary_id")).alias("summary_id"), F.concat(F.lit('{"k'), F.col("id") % 2, F.lit('":"'), "id", F.lit('"}')).alias("fields_json"))


@query(_J + """, e as (select id % 500 + 1 as job_id, id as seq, case when id <= 500 then created_at end as created_at, started_at, finished_at, status, 'm' || id as message, case when id % 7 = 0 then 'none' else summary_id end as summary_id, id % 2 as k from jobs)
select job_id, max_by(created_at, seq) filter (created_at is not null) as created_at, max_by(started_at, seq) filter (started_at is not null) as started_at, max_by(finished_at, seq) filter (finished_at is not null) as finished_at, max_by(status, seq) as status, max_by(message, seq) as message,
 nullif(max_by(summary_id, seq) filter (summary_id is not null), 'none') as summary_id, max(seq) filter (k = 0)::varchar as k0, max(seq) filter (k = 1)::varchar as k1 from e group by job_id""")
def job_state_fold(spark, d):
    s = st.fold_jobs(_events(spark, d))
    return s.select("job_id", "created_at", "started_at", "finished_at", "status", "message", "summary_id", F.get_json_object("fields_json", "$.k0").alias("k0"), F.get_json_object("fields_json", "$.k1").alias("k1"))


@query(_J + "select id, status, created_at from jobs order by created_at desc, id limit 200")
def jobs_recent(spark, d):
    return st.newest(views.jobs(spark, d), "created_at", 200).select("id", "status", "created_at")


@query(_J + "select id, created_at, started_at, finished_at, status, summary_id from jobs where id = 7")
def job_by_id(spark, d):
    return views.jobs(spark, d).where("id = 7").select("id", "created_at", "started_at", "finished_at", "status", "summary_id")


@query(_SUM + "select id, created from summaries order by created desc, id limit 1")
def latest_summary(spark, d):
    return st.newest(views.summaries(spark, d), "created", 1).select("id", "created")


@query(_SUM + "select id, created, row_number() over (order by created desc, id) as rank from summaries")
def summaries_newest(spark, d):
    from presswerk.operators.select import numbered

    return numbered(views.summaries(spark, d), "created", "id").select("id", "created", "rank")


@query(_SUM + "select id, created, class from summaries where id = 'sum_42'")
def summary_by_id(spark, d):
    from presswerk.functions.text import summary_class

    return views.summaries(spark, d).where("id = 'sum_42'").select("id", "created", summary_class(F.col("doc_json")).alias("class"))


_TTL = f"""select 'articles' as t, count(*) filter (eff_ts < {NOW - 30 * DAY}) as removed, count(*) as total from articles
union all select 'jobs', count(*) filter (coalesce(finished_at, created_at, 0) < {NOW - 10 * DAY} and status in ('done', 'failed')), count(*) from jobs
union all select 'summaries', count(*) filter (created < case when class = 'daily' then {NOW - 7 * DAY} else {NOW - 20 * DAY} end), count(*) from summaries"""


@query(with_views("articles", "jobs", "summaries") + _TTL)
def cleanup_counts(spark, d):
    def count(name, rows, gone):
        return rows.agg(F.count(F.when(gone, 1)).alias("removed"), F.count("*").alias("total")).select(F.lit(name).alias("t"), "removed", "total")

    a, j, s = views.articles(spark, d), views.jobs(spark, d), views.summaries(spark, d)
    return count("articles", a, st.expired_articles(a, NOW, 30)).union(count("jobs", j, st.expired_jobs(NOW, 10))).union(count("summaries", s, st.expired_summaries(NOW, 7, 20)))


@query(_A + f"select id from articles where not eff_ts < {NOW - 30 * DAY}")
def retained_articles(spark, d):
    a = views.articles(spark, d)
    return a.where(~st.expired_articles(a, NOW, 30)).select("id")


@query(_J + f"select id, status from jobs where not (coalesce(finished_at, created_at, 0) < {NOW - 10 * DAY} and status in ('done', 'failed'))")
def retained_jobs(spark, d):
    return views.jobs(spark, d).where(~st.expired_jobs(NOW, 10)).select("id", "status")


@query(_SUM + f"select id, class from summaries where not created < case when class = 'daily' then {NOW - 7 * DAY} else {NOW - 20 * DAY} end")
def retained_summaries(spark, d):
    from presswerk.functions.text import summary_class

    return views.summaries(spark, d).where(~st.expired_summaries(NOW, 7, 20)).select("id", summary_class(F.col("doc_json")).alias("class"))


@query(_J + f"select id as job_id from jobs where not created_at < {NOW - 15 * DAY}")
def retained_temp(spark, d):
    t = views.jobs(spark, d).select(F.col("id").alias("job_id"), "created_at")
    return t.where(~st.expired_temp(NOW, 15)).select("job_id")


@query(_J + "select id % 200 as job_id, max_by('s' || id, id) as summary from jobs group by 1")
def temp_summary_upsert(spark, d):
    t = views.jobs(spark, d).select((F.col("id") % 200).alias("job_id"), F.concat(F.lit("s"), "id").alias("summary"), F.col("id").alias("seq"))
    return st.latest(t, ["job_id"], "seq").drop("seq")
