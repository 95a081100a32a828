"""Chat stages, proofreading, packages and the whole digest with offline and scripted models."""

from __future__ import annotations

import json
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from presswerk.operators import budget as bg
from presswerk.operators.select import with_times, with_topic
from presswerk.operators.store import Store
from presswerk.plans import chat, digest, edit
from presswerk.sources import ingest, packages

NOW = 1706745600
cloudpickle.register_pickle_by_value(sys.modules[__name__])  # models of this file go to workers that cannot import it


class Scripted(chat.ChatModel):
    """Raises or answers in turn; the last entry stays."""

    def __init__(self, *script):
        self.script, self.seen = list(script), []

    def chat(self, messages, *, temperature=0.2):
        self.seen.append(messages[-1]["content"])
        step = self.script.pop(0) if len(self.script) > 1 else self.script[0]
        if isinstance(step, Exception):
            raise step
        return step


def items(n, chars=1000):
    return [{"id": f"a{k}", "title": "t", "url": "u", "source": "s", "text": "w " * (chars // 2)} for k in range(n)]


def mapped(batches, model, done=None, log=None, **options):
    s = digest.Settings(**options)
    size = lambda a: len(a["text"]) + len(a["title"]) + len(a["url"]) + 200
    return list(digest.map_topic(enumerate(batches, 1), model, s, total=len(batches), last_chars=sum(map(size, batches[-1])), last_n=len(batches[-1]), done=done, log=log))


def named(letter, n, chars=1000):
    return [a | {"id": f"{letter}{k}"} for k, a in enumerate(items(n, chars))]


def test_overflow_moves_articles_to_later_batches():
    got = mapped([named("a", 4), named("b", 1)], Scripted(chat.PromptTooLong(900), chat.PromptTooLong(5000), "ok"))
    assert [(r["batch_id"], r["ids"], r["drops"]) for r in got] == [(1, ["a0"], 3), (2, ["b0", "a3", "a2", "a1"], 0)]


def test_overflow_beyond_the_last_batch_makes_new_ones():
    got = mapped([named("a", 3), named("b", 9)], Scripted(chat.PromptTooLong(900), chat.PromptTooLong(900), "ok"))
    assert [(r["batch_id"], r["ids"]) for r in got] == [(1, ["a0"]), (2, [*(f"b{k}" for k in range(9)), "a2"]), (3, ["a1"])]
    got = mapped([named("a", 3)], Scripted(chat.PromptTooLong(900), "ok"))
    assert [(r["batch_id"], r["ids"]) for r in got] == [(1, ["a0", "a1"]), (2, ["a2"])]


def test_single_article_is_cut():
    m = Scripted(chat.PromptTooLong(300), "ok")
    got = mapped([items(1, 20000)], m)
    assert got[0]["summary"] == "ok" and len(m.seen[1]) < len(m.seen[0])


def test_finished_batches_are_not_asked_for():
    m = Scripted("new")
    got = mapped([named("a", 1), named("b", 1)], m, {1: {"batch_id": 1, "ids": ["a0"], "summary": "old", "trims": 0, "drops": 0}})
    assert [r["summary"] for r in got] == ["old", "new"] and len(m.seen) == 1


@pytest.mark.parametrize("stop", range(1, 7))
def test_resume_after_overflow_loses_nothing(stop):
    """A run that fails at any call and is resumed has each article once, and asks for no answered batch again."""
    plan = [named("a", 6), named("b", 5), named("c", 2)]
    first = [chat.PromptTooLong(900), "one", chat.PromptTooLong(5000), "two", chat.PromptTooLong(300), "three", "four"][:stop]
    log, done = [], {}
    with pytest.raises(chat.AuthError):
        mapped(plan, Scripted(*first, chat.AuthError("stop")), log=log.append, max_n=6)
    done = {r["batch_id"]: r for r in log}
    m = Scripted("later")
    got = mapped(plan, m, done, max_n=6)
    assert sorted(i for r in got for i in r["ids"]) == sorted(a["id"] for b in plan for a in b)
    assert len({r["batch_id"] for r in got}) == len(got) and len(m.seen) == len(got) - len(done)
    assert all(r in got for r in log)


def test_guarded_chat_trims_small_overflows():
    m = Scripted(chat.PromptTooLong(100), "ok")
    answer, trims = chat.guarded_chat(m, [{"role": "user", "content": "word " * 500}])
    assert (answer, trims) == ("ok", 1) and len(m.seen[1]) < len(m.seen[0])
    with pytest.raises(chat.PromptTooLong) as e:
        chat.guarded_chat(Scripted(chat.PromptTooLong(201)), [{"role": "user", "content": "x"}])
    assert e.value.structural


def test_fallback_chain():
    waits = []
    limited, good = Scripted(chat.RateLimited("slow", 7)), Scripted("good")
    chain = chat.FallbackChain([limited, good], sleep=waits.append)
    assert chain.chat([{"role": "user", "content": "x"}]) == "good" and chain.first == 1
    chain = chat.FallbackChain([Scripted(chat.Unavailable("no"), "back")], sleep=waits.append)
    assert chain.chat([{"role": "user", "content": "x"}]) == "back" and waits
    with pytest.raises(chat.PromptTooLong):
        chat.FallbackChain([Scripted(chat.PromptTooLong(3)), good], sleep=waits.append).chat([{"role": "user", "content": "x"}])
    assert isinstance(chat.classify(400, "exceeded max context length by 12 tokens", None), chat.PromptTooLong)
    assert chat.classify(429, "", "9").retry_after == 9
    assert chat.read_answer([b'{"message":{"content":"a"}}', b"", b'{"message":{"content":"b"},"done":true}']) == "ab"


def test_providers_of_a_config():
    one = {"provider": "x_cloud", "base_url": "http://a/", "max_rps": 4, "quota": {"max_quota_retries": 2, "default_wait_s": 9}}
    chain = chat.from_config({"llm": one, "llm_fallback": {"provider": "x_local", "max_rps": 4, "max_retries": 5}})
    assert [(m.spacing, m.attempts) for m in chain.models] == [(1.0, 3), (0.25, 5)] and (chain.waits, chain.wait) == (2, 9)
    assert chain.models[0].url == "http://a/api/chat" and chat.from_config({"llm": [one]}).spacing == 1
    assert isinstance(chat.from_config({}), chat.ExtractiveModel)
    for wrong in ({"llm": ["x"]}, {"llm": one, "llm_fallback": "x"}):
        with pytest.raises(ValueError):
            chat.from_config(wrong)
    assert [m.spacing for m in chain.shared_by(4).models] == [4.0, 1.0] and chain.models[0].spacing == 1


def test_meta_fit_prefers_newest():
    t = "{lookback}|{batch_summaries}|{sources_list}"
    got = bg.fit_meta(t, [(1, "old " * 50), (2, "new " * 50)], "src", lookback="", budget=150)
    assert "Batch 2" in got and bg.tokens(got, 2.4) <= 150 and got.startswith(bg.NO_LOOKBACK)
    assert bg.NO_BATCHES in bg.fit_meta(t, [(1, "x" * 5000)], "s" * 900, lookback="1d", budget=10)


def test_edit_fit_cuts_desk_first():
    t = "{lookback}{draft_summary}{desk_underlag}{feedback}"
    user, seen = bg.fit_edit(t, "d" * 1000, "u" * 9000, "", lookback="", budget=1500)
    assert seen["draft_coverage"] == 1.0 and seen["est_tokens"] <= 1500 and seen["desk_chars"] < 9000 and len(user) < 10000


def test_json_payload():
    assert edit.json_payload('x\n```json\n{"a": 1}\n```') == {"a": 1}
    assert edit.json_payload("so [1, 2] it is") == [1, 2]
    assert edit.json_payload('a {"b": [1]} c ] d') == {"b": [1]}
    assert edit.json_payload("none {") is None
    assert edit.feedback_of("PASS, fine")["status"] == "PASS"
    assert edit.feedback_of('{"status":"odd","issues":[{}]}') == {"status": "REVISE", "issues": edit.issues_of([{}]), "structured": True}


def test_proofread_rounds():
    prompts = {"proofread_system": "p", "proofread_user_template": "{draft_summary}", "revise_system": "r", "revise_user_template": "{draft_summary}"}
    ops = json.dumps({"operations": [{"op": "replace", "target_quote": "bad", "text": "good"}]})
    out = edit.proofread(Scripted('{"status":"REVISE"}', ops, '{"status":"PASS"}'), prompts, "a bad text", "", lookback="")
    assert out.text == "a good text" and out.passed and len(out.rounds) == 2 and out.rounds[0]["applied"] == 1
    cut = json.dumps([{"op": "replace", "target_quote": "a long text that matters", "text": ""}])
    out = edit.proofread(Scripted("{}", cut), prompts, "a long text that matters", "", lookback="", max_rounds=1)
    assert out.text == "a long text that matters" and out.rounds[0]["blocked"] == 1
    assert edit.proofread(Scripted("x"), {}, "t", "", lookback="").text == "t"


def test_packages(tmp_path, spark):
    (tmp_path / "a.json").write_text('{"include": "_base.json", "x": {"b": 2}}')
    (tmp_path / "_base.json").write_text('{"x": {"a": 1, "b": 1}}')
    assert packages.package_map(tmp_path) == {"a": {"x": {"a": 1, "b": 2}}}
    (tmp_path / "_base.json").write_text('{"include": ["a.json"]}')
    with pytest.raises(ValueError):
        packages.package_map(tmp_path)
    with pytest.raises(ValueError):
        packages.save_package(tmp_path, "../x", {})
    assert packages.save_package(tmp_path / "n", "new", {"k": "v"}).exists()
    feeds = packages.feed_frame(spark, [{"title": " A ", "topic": "t"}, {"name": "A", "topics": ["u", " "]}, {"url": "x"}])
    assert [(r["name"], r["topics"]) for r in feeds.collect()] == [("A", ["u"])]


def test_fetch_retries():
    calls, waits = [], []

    def flaky(url):
        calls.append(url)
        if len(calls) < 3:
            raise ingest.FetchError(429, 90, True)
        return "page"

    assert ingest.fetch_retrying("u", flaky, sleep=waits.append) == ("page", 3, "") and waits == [60, 60]

    def gone(url):
        raise ingest.FetchError(404)

    assert ingest.fetch_retrying("u", gone, sleep=waits.append)[:2] == (None, 1)


def test_main_text():
    page = '<html><head><title>T</title></head><body><nav>n</nav><script>var t="</p>";</script><article><p>One &amp; <b>two</p><table><tr><td>x</td></tr></table><p>three</p></article><footer>f</footer></body></html>'
    assert ingest.main_text(page) == "One & two\nthree"
    assert ingest.main_text(None) == "" and ingest.main_text("<body>plain<!-- c --></body>") == "plain"


def test_main_text_is_read_once():
    import time

    start = time.monotonic()
    assert ingest.main_text("<nav>" * 20000 + "<p>text</p>") == "text"
    assert ingest.main_text("<p>a</p>" + "<script><b " * 20000).startswith("a") and time.monotonic() - start < 20


def test_ingest_from_feeds_to_articles(spark, tmp_path):
    """Feeds and pages of a local server; one feed is gone, one page is, one is too short, one entry is too old."""
    import threading
    from email.utils import formatdate
    from http.server import BaseHTTPRequestHandler, HTTPServer

    page = "<html><article><p>" + "word " * 60 + "</p></article></html>"
    item = lambda k, age=0: f"<item><title>T{k}</title><link>http://127.0.0.1:{{port}}/p{k}</link><pubDate>{formatdate(NOW - age, usegmt=True)}</pubDate><category>News</category></item>"
    served = {
        "/rss": "<rss><channel><title>c</title>" + item(1) + item(2, 60) + item(3, 99999) + item(4) + "</channel></rss>",
        "/atom": '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><link rel="self" href="x"/><link href="http://127.0.0.1:{port}/p5"/><updated>2024-01-31T23:59:00Z</updated></entry></feed>',
        "/p1": page, "/p2": "<p>short</p>", "/p5": page,
    }

    class Server(BaseHTTPRequestHandler):
        def do_GET(self):
            body = served.get(self.path)
            self.send_response(200 if body else 404)
            self.end_headers()
            self.wfile.write((body or "").replace("{port}", str(self.server.server_port)).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        url = f"http://127.0.0.1:{server.server_port}"
        config = {"ingest": {"lookback": "24h"}, "feeds": [{"name": "r", "url": f"{url}/rss", "category_include": ["news"]}, {"name": "a", "url": f"{url}/atom"}, {"name": "gone", "url": f"{url}/none"}]}
        s = Store(spark, f"file://{tmp_path}/store")
        got = ingest.run(spark, config, s, now=NOW, rate=1000)
        assert got == {"feeds": 3, "entries": 4, "feeds_failed": 1, "pages_failed": 1, "too_short": 1, "inserted": 2, "updated": 0}
        assert ingest.run(spark, config, s, now=NOW, rate=1000)["inserted"] == 0
        assert sorted((r["source"], r["title"], r["published_ts"]) for r in s.read("articles").collect()) == [("a", "A", NOW - 60), ("r", "T1", NOW)]
        assert not s._names(f"{s.root}/landing")
        assert digest.run(spark, config, s, packages.feed_frame(spark, config["feeds"]), now=NOW)
    finally:
        server.shutdown()


def test_feeds_of_xml(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title> A </title><link>http://x/1</link><pubDate>Thu, 01 Feb 2024 00:00:00 GMT</pubDate><category>News</category><category>b</category></item></channel></rss>")
    got = ingest.rss_entries(spark, str(tmp_path / "f.xml")).collect()
    assert [(r["feed"], r["link"], r["title"], r["categories"], r["published_ts"]) for r in got] == [("f", "http://x/1", "A", ["news", "b"], NOW)]


@pytest.fixture
def corpus(spark):
    rows = [(f"a{k}", k, f"http://x/{k}", f"s{k % 3}", f"T{k}", NOW - k * 3600, NOW, f"Article {k} tells a story. " * 20, f"h{k}") for k in range(12)]
    a = spark.createDataFrame(rows, "id string, pos long, url string, source string, title string, published_ts long, fetched_at long, text string, content_hash string")
    feeds = packages.feed_frame(spark, [{"name": "s0", "topic": "tech"}, {"name": "s1", "topic": "sports"}, {"name": "s2"}])
    return with_times(a), feeds


def test_digest_end_to_end(spark, tmp_path, corpus):
    articles, feeds = corpus
    s = Store(spark, f"file://{tmp_path}/store")
    assert s.upsert_articles(articles.drop("pos", "eff_ts", "ilv_ts")) == {"inserted": 12, "updated": 0}
    job = s.create_job(NOW)
    first = digest.run(spark, {"ingest": {"lookback": "6h"}}, s, feeds, now=NOW, job=job)
    doc = s.get_summary(first).first()
    assert [x["topic"] for x in doc["sections"]] == ["sports", "tech", "Okategoriserat"] or len(doc["sections"]) == 3
    assert set(doc["sources"]) == {f"a{k}" for k in range(7)} and doc["summary"].count("## Källor") == 1
    assert s.get_job(job)["summary_id"] == first and s.read("articles").where("summarized").count() == 7
    again = digest.replay(spark, {"ingest": {"lookback": "6h"}}, s, first, now=NOW + 60)
    assert set(again["sources"]) == set(doc["sources"])
    assert doc["sections"][0]["meta"]["blocked"] == "0"
    composed = digest.compose(spark, {}, s, [{"summary_id": first, "tag": "One"}, {"summary_id": "none"}], now=NOW)
    body = s.get_summary(composed).first()["summary"]
    assert body.startswith("## One") and "## Källor" not in body
    with pytest.raises(KeyError):
        digest.compose(spark, {}, s, [{"summary_id": "nope"}], now=NOW)
    assert digest.resume(spark, {}, s, job, now=NOW + 120) != first
    assert digest.run(spark, {"ingest": {"lookback": "odd"}}, s, feeds, now=NOW + 999999, job=job) is None


def test_failed_job_is_marked_and_resumes(spark, tmp_path, corpus):
    articles, feeds = corpus
    s = Store(spark, f"file://{tmp_path}/store")
    s.upsert_articles(articles.drop("pos", "eff_ts", "ilv_ts"))
    job = s.create_job(NOW)
    with pytest.raises(Exception):
        digest.run(spark, {}, s, feeds, now=NOW, job=job, model=Scripted(chat.AuthError("key")))
    assert s.get_job(job)["status"] == "failed"
    assert digest.resume(spark, {}, s, job, now=NOW)
    assert s.get_job(job)["status"] == "done"


class FailsAtReduce(chat.ExtractiveModel):
    """Answers batches, and fails where summaries are merged; counts its calls in a file."""

    def __init__(self, path, fail=True):
        super().__init__()
        self.path, self.fail = path, fail

    def chat(self, messages, *, temperature=0.2):
        with open(self.path, "a") as f:
            f.write(messages[0]["content"] + "\n")
        if self.fail and messages[0]["content"] == "Merge the summaries.":
            raise chat.AuthError("reduce")
        return super().chat(messages)


def test_answered_batches_are_kept_when_a_job_fails(spark, tmp_path, corpus):
    articles, feeds = corpus
    s = Store(spark, f"file://{tmp_path}/store")
    s.upsert_articles(articles.drop("pos", "eff_ts", "ilv_ts"))
    config = {"batching": {"max_articles_per_batch": 2}}
    job, calls = s.create_job(NOW), tmp_path / "calls"
    with pytest.raises(Exception):
        digest.run(spark, config, s, feeds, now=NOW, job=job, model=FailsAtReduce(calls))
    asked = calls.read_text().count("Summarise")
    assert asked == 6
    saved = digest.resume(spark, config, s, job, now=NOW, model=FailsAtReduce(calls, fail=False))
    assert calls.read_text().count("Summarise") == asked
    doc = s.get_summary(saved).first()
    assert sorted(doc["sources"]) == sorted(f"a{k}" for k in range(12)) and doc["batching"]["max_n"] == "2" and doc["selection"]["articles"] == "12"
    assert s.job_context(job)["topics"] == {"tech": 4, "sports": 4, "Okategoriserat": 4} and s.read("checkpoints").count() == 0


def test_package_is_used_and_kept(spark, tmp_path, corpus):
    """The package asked for changes the prompts; a digest of a daily package is kept for the daily time."""
    from presswerk.operators.store import Retention

    articles, feeds = corpus
    s = Store(spark, f"file://{tmp_path}/store")
    s.upsert_articles(articles.drop("pos", "eff_ts", "ilv_ts"))
    for name in ("daily_news", "weekly_news"):
        packages.save_package(tmp_path / "p", name, {"batch_system": f"as {name}", "proofread_system": "check", "proofread_user_template": "{draft_summary}"})
    config, calls = {"prompts": {"path": str(tmp_path / "p"), "default_package": "weekly_news"}}, tmp_path / "calls"
    a = digest.run(spark, config, s, feeds, now=NOW, model=FailsAtReduce(calls, fail=False))
    assert "as weekly_news" in calls.read_text() and "check" in calls.read_text()
    b = digest.run(spark, config, s, feeds, now=NOW + 60, overrides={"prompt_package": "daily_news"}, model=FailsAtReduce(calls, fail=False))
    assert "as daily_news" in calls.read_text()
    assert s.cleanup(Retention(articles=9999, daily=7, weekly=30), NOW + 10 * 86400)["summary_docs"] == 1
    assert [r["id"] for r in s.list_summaries().select("id").collect()] == [a] and b != a


def test_texts_only(spark, tmp_path, corpus):
    articles, feeds = corpus
    s = Store(spark, f"file://{tmp_path}/store")
    s.upsert_articles(articles.drop("pos", "eff_ts", "ilv_ts"))
    assert "## Källor" in digest.summarise_text(spark, {}, articles, now=NOW)
    job = s.create_job(NOW)
    with pytest.raises(RuntimeError):
        digest.resume_text(spark, {}, s, job, now=NOW)
    with pytest.raises(Exception):
        digest.run(spark, {}, s, feeds, now=NOW, job=job, model=Scripted(chat.AuthError("key")))
    text, numbers = digest.resume_text(spark, {}, s, job, now=NOW)
    assert "## Källor" in text and numbers["batch_total"] == "3" and s.list_summaries().count() == 0


def test_lab_keeps_a_temporary_summary(spark, tmp_path, corpus):
    articles, feeds = corpus
    s = Store(spark, f"file://{tmp_path}/store")
    text = digest.lab(spark, {}, s, articles.where("pos < 4"), feeds, job=5, now=NOW)
    assert s.get_temp_summary(5).first()["summary"] == text


def test_topic_of_feeds(spark, corpus):
    articles, feeds = corpus
    got = {r["source"]: r["topic"] for r in with_topic(articles, feeds).select("source", "topic").distinct().collect()}
    assert got == {"s0": "tech", "s1": "sports", "s2": "Okategoriserat"}


def test_stream_equals_batch(spark, tmp_path):
    from presswerk.streaming.ingest import landed, upsert_stream

    page = "<article><p>" + "word " * 60 + "</p></article>"
    rows = [("f", k, f"http://x/{k % 5}", f"t{k}", NOW, page) for k in range(8)]
    kinds = "feed string, pos long, link string, title string, published_ts long, html string"
    spark.createDataFrame(rows, kinds).write.parquet(f"{tmp_path}/in")
    s = Store(spark, f"file://{tmp_path}/store")
    for _ in range(2):
        upsert_stream(landed(spark, f"{tmp_path}/in", kinds), s, checkpoint=f"{tmp_path}/cp", now=NOW).awaitTermination()
    batch = ingest.articles_of(ingest.extract_text(spark.createDataFrame(rows, kinds)), NOW)
    assert s.read("articles").count() == batch.select("id").distinct().count() == 5
    assert s.read("articles").where(F.col("content_hash").isNull()).count() == 0
