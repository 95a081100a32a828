"""Order, batches and stores against small simulations."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from presswerk.operators import pack as pk
from presswerk.operators import select as sel
from presswerk.operators import store as st


def round_robin(rows):
    """rows: (pos, source, ts).  One row a source and round, sources by the time of their head."""
    queues: dict = {}
    for pos, source, ts in sorted(rows):
        queues.setdefault(source or "unknown", []).append((ts, pos))
    order = list(queues)
    for q in queues.values():
        q.sort()
    out = []
    while any(queues.values()):
        for s in sorted((s for s in order if queues[s]), key=lambda s: (queues[s][0][0], order.index(s))):
            out.append(queues[s].pop(0)[1])
    return out


def test_interleave(spark):
    rng = random.Random(4)
    rows = [(p, rng.choice(["a", "b", "c", None, ""]), rng.choice([0, 5, 5, 9, rng.randrange(100)])) for p in range(200)]
    df = spark.createDataFrame(rows, "pos long, source string, ilv_ts long")
    got = [r["pos"] for r in sel.interleave(df).orderBy("ord").collect()]
    assert got == round_robin(rows)


def greedy(sizes, max_chars, max_n):
    out, batch, total, n = [], 1, 0, 0
    for s in sizes:
        if n and (total + s > max_chars or n >= max_n):
            batch, total, n = batch + 1, 0, 0
        out.append(batch)
        total, n = total + s, n + 1
    return out


@pytest.mark.parametrize("max_chars,max_n", [(100, 3), (100, 0), (50, 100), (10, 2)])
def test_pack(spark, max_chars, max_n):
    rng = random.Random(max_chars + max_n)
    rows = [(t, k, rng.choice([1, 50, 99, 100, 101, rng.randrange(120)])) for t in "xyz" for k in range(60)]
    df = spark.createDataFrame(rows, "topic string, ord int, est_chars int")
    got = {t: [r["batch_id"] for r in pk.pack(df, max_chars=max_chars, max_n=max_n).where(F.col("topic") == t).orderBy("ord").collect()] for t in "xyz"}
    assert got == {t: greedy([r[2] for r in rows if r[0] == t], max_chars, max_n) for t in "xyz"}
    assert pk.pack(df.limit(0)).count() == 0


def test_newest_per_feed_limits(spark):
    e = spark.createDataFrame([("f", k, 100 + k % 3) for k in range(6)] + [("f", 9, None)], "feed string, pos long, published_ts long")
    assert sel.newest_per_feed(e, 2, since=0).count() == 2
    assert sel.newest_per_feed(e, 0, since=0).count() == 6
    assert sel.newest_per_feed(e, 0).count() == 0
    assert sorted(r["pos"] for r in sel.newest_per_feed(e, 2, since=0).collect()) == [2, 5]


def test_filter_without_sources_is_empty(spark):
    a = spark.createDataFrame([("s", 5, 1)], "source string, eff_ts long, pos long")
    assert sel.by_filter(a, [], 0).count() == 0
    assert sel.by_filter(a, ["s"], 5, 5).count() == 1


def article(k, h="h", url=None, **kw):
    return {"id": f"a{k}", "url": url or f"u{k}", "source": "s", "title": "t", "published_ts": 10, "fetched_at": 20, "text": "x", "content_hash": h, **kw}


KINDS = "id string, url string, source string, title string, published_ts long, fetched_at long, text string, content_hash string"


@pytest.mark.parametrize("mode", ["replace", "merge"])
def test_store_articles(spark, tmp_path, mode):
    s = st.Store(spark, f"file://{tmp_path}/{mode}", mode=mode)
    frame = lambda *rows: spark.createDataFrame([tuple(r[c.split()[0]] for c in KINDS.split(", ")) for r in rows], KINDS)
    assert s.upsert_articles(frame(article(1), article(2))) == {"inserted": 2, "updated": 0}
    s.mark_summarized(spark.createDataFrame([("a1",), ("zz",)], "id string"), 99)
    assert s.upsert_articles(frame(article(1))) == {"inserted": 0, "updated": 0}
    assert s.upsert_articles(frame(article(1, "new"), article(3))) == {"inserted": 1, "updated": 1}
    flags = {r["id"]: r["summarized"] for r in s.read("articles").collect()}
    assert flags == {"a1": None if mode == "replace" else True, "a2": None, "a3": None}
    with pytest.raises(ValueError):
        s.upsert_articles(frame(article(8, url="u1")))
    s.vacuum("articles", keep=1)
    assert len(s.versions("articles")) == 1 and s.read("articles").count() == 3


def test_store_jobs_and_cleanup(spark, tmp_path):
    s = st.Store(spark, f"file://{tmp_path}/store")
    now = 1_700_000_000
    job = s.create_job(now - 200 * 86400)
    s.update_job(job, status="done", finished_at=now - 91 * 86400, summary_id="NULL", note="n")
    other = s.create_job(now - 200 * 86400)
    s.update_job(other, status="running", status_note="x")
    got = s.get_job(job)
    assert (got["status"], got["summary_id"], got["note"], got["id"]) == ("done", None, "n", job)
    with pytest.raises(ValueError):
        s.update_job(0, status="x")
    s.save_temp_summary(job, "t", "{}", now - 31 * 86400)
    s.save_summary({"id": "d", "created": now - 8 * 86400, "doc_json": '{"selection":{"prompt_package":"my_daily"}}'}, now)
    s.save_summary({"id": "w", "created": now - 8 * 86400, "doc_json": '{"selection":{"prompt_package":"weekly_daily"}}'}, now)
    s.save_summary({"id": "b", "created": now - 8 * 86400, "doc_json": "{broken"}, now)
    assert s.cleanup(st.Retention(), now) == {"articles": 0, "temp_summaries": 1, "summary_docs": 1, "jobs": 1}
    assert s.cleanup(st.Retention(), now) == {"articles": 0, "temp_summaries": 0, "summary_docs": 0, "jobs": 0}
    assert {r["id"] for r in s.list_summaries().collect()} == {"w", "b"} and s.list_jobs().count() == 1


def test_backend_names(spark):
    assert st.create_store(spark, {"store": {"provider": "sqlite", "path": "x"}}).mode == "replace"
    assert st.create_store(spark, {}).mode == "merge"
    with pytest.raises(ValueError):
        st.create_store(spark, {"store": {"provider": "other"}})


def test_store_writes_only_touched_buckets(spark, tmp_path):
    s = st.Store(spark, f"file://{tmp_path}/s")
    rows = spark.range(400).selectExpr("cast(id as string) as id", "concat('u', id) as url", "concat('h', id) as content_hash")
    assert s.upsert_articles(rows) == {"inserted": 400, "updated": 0}
    one = rows.where("id = '7'").selectExpr("id", "url", "'changed' as content_hash")
    assert s.upsert_articles(one) == {"inserted": 0, "updated": 1}
    assert sum(x.startswith("bucket=") for x in s._names(f"{s.root}/articles/v=2")) == 1
    assert s.read("articles").count() == 400 and s.get_article("7").first()["content_hash"] == "changed"
    with pytest.raises(ValueError):
        s.upsert_articles(spark.sql("select 'new' as id, 'u9' as url, 'x' as content_hash"))
    s.vacuum("articles", keep=1)
    assert s.versions("articles") == [2] and s.read("articles").count() == 400


def test_writers_wait_for_each_other(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    s = st.Store(spark, f"file://{tmp_path}/s")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda k: s.save_summary({"id": f"s{k}", "summary": "x"}, 1), range(4)))
        jobs = list(pool.map(lambda k: s.create_job(k), range(4)))
    assert sorted(r["id"] for r in s.read("summary_docs").collect()) == ["s0", "s1", "s2", "s3"]
    assert sorted(jobs) == [1, 2, 3, 4] and s.jobs().count() == 4
    fs, p = s._fs(f"{s.root}/summary_docs/_claim99")
    fs.createNewFile(p)  # a writer that is at work
    with pytest.raises(st.Conflict):
        s.update("summary_docs", lambda old: old, tries=2)
    s.STALE = -1  # or gone
    s.update("summary_docs", lambda old: old, tries=2)
    assert s.versions("summary_docs")[-1] == 100 and s.read("summary_docs").count() == 4
