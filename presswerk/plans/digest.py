"""The digest: batches are summarised, summaries reduced by topic, topics put together.

Everything up to the batches is one plan.  A topic's batches are summarised by
one task, in order, because an article that overflows a batch moves to a later
one; topics run side by side.  A batch is read when its turn comes, and its
summary is logged at once, so that neither a failed run nor a lost executor
costs a call that was answered.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from datetime import UTC, datetime
from itertools import chain, groupby

import pandas as pd
import pyarrow.fs as pa_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswerk.functions import text as fn
from presswerk.operators import pack as pk
from presswerk.operators import select as sel
from presswerk.operators.budget import fill, fit_meta, retrying, tokens, trim_words
from presswerk.operators.store import Store
from presswerk.plans.chat import ChatModel, ExtractiveModel, PromptTooLong, guarded_chat
from presswerk.plans.edit import proofread, title_prompt
from presswerk.sources.packages import package_name, select_prompts

DEFAULT_PROMPTS = {
    "batch_system": "Summarise the articles.",
    "batch_user_template": "Batch {batch_index}/{batch_total}\n{articles_corpus}",
    "meta_system": "Merge the summaries.",
    "meta_user_template": "{lookback}\n{batch_summaries}\n\n{sources_list}",
    "super_meta_system": "Write an overview.",
    "super_meta_user_template": "{lookback}\n{topic_summaries}",
}

SUMMARY = "topic string, batch_id int, ids array<string>, summary string, trims int, drops int"
SECTION = "topic string, summary string, batch_total int, trims int, drops int, budget int, feedback string, rounds int, requested int, applied int, skipped int, blocked int"


@dataclass
class Settings:
    max_chars: int = 18000
    max_n: int = 10
    clip: int = 6000
    context: int = 32768
    output: int = 700
    margin: int = 1024
    chars_per_token: float = 2.4
    structural_threshold: int = 1200
    proofread_rounds: int = 4
    topics_at_once: int = 4
    lookback: str = ""
    prompts: dict[str, str] = field(default_factory=lambda: dict(DEFAULT_PROMPTS))
    package: str = ""

    def projection(self, *names: str) -> dict[str, str]:
        return {name: str(getattr(self, name)) for name in names}

    @staticmethod
    def of(config: dict) -> Settings:
        batching, llm, ingest = (config.get(k) or {} for k in ("batching", "llm", "ingest"))
        llm = llm[0] if isinstance(llm, list) and llm else llm if isinstance(llm, dict) else {}
        base = Settings()
        return Settings(
            max_chars=int(batching.get("max_chars_per_batch") or base.max_chars), max_n=int(batching.get("max_articles_per_batch", base.max_n)), clip=int(batching.get("article_clip_chars") or base.clip),
            context=int(llm.get("context_window_tokens") or base.context), output=int(llm.get("max_output_tokens") or base.output), margin=int(llm.get("prompt_safety_margin") or base.margin),
            chars_per_token=float(llm.get("chars_per_token") or base.chars_per_token), topics_at_once=max(1, min(16, int(batching.get("topic_concurrency") or base.topics_at_once))), lookback=str(ingest.get("lookback") or ""), prompts=DEFAULT_PROMPTS | select_prompts(config, str((config.get("prompts") or {}).get("selected") or "") or None), package=package_name(config),
        )


def block(n: int, a: dict) -> str:
    title, source, url, body = (str(a.get(k) or "").strip() for k in ("title", "source", "url", "text"))
    return f"[{n}] {title or fn.NO_TITLE}" + (f" ({source})" if source else "") + (f" {url}" if url else "") + (f"\n{body}" if body else "")


def _size(a: dict) -> int:
    return sum(len(str(a.get(k) or "")) for k in ("text", "title", "url")) + 200


class Tail:
    """Where articles go that did not fit their batch: the last planned batch while there is room, then new ones."""

    def __init__(self, s: Settings, last: int, chars: int, n: int):
        self.s, self.last = s, last
        self.batches: list[tuple[int, list[dict]]] = [(last, [])]  # what comes to the last planned batch, then new batches
        self.chars, self.n = chars, n

    def add(self, a: dict, trying: int) -> None:
        room = trying != self.batches[-1][0] and (not self.s.max_n or self.n < self.s.max_n) and self.chars + _size(a) <= self.s.max_chars
        if not room:
            self.last += 1
            self.batches.append((self.last, []))
            self.chars = self.n = 0
        self.batches[-1][1].append(a)
        self.chars, self.n = self.chars + _size(a), self.n + 1


def map_topic(planned: Iterable[tuple[int, list[dict]]], model: ChatModel, s: Settings, *, total: int, last_chars: int, last_n: int, done: dict[int, dict] | None = None, log: Callable[[dict], None] | None = None) -> Iterator[dict]:
    """Summaries of a topic's batches (number, articles), one after the other.

    If a prompt overflows so far that cutting its end will not do, articles move
    to the tail and the batch is tried again; a batch of one article has its
    text cut instead.  Only the batch at hand and moved articles are held.

    ``done`` has the finished batches of an earlier run by number (with ids):
    they are not asked for again.  An article of a planned batch that is in no
    finished one is still open, wherever it was moved: it stays in its batch, or
    goes to the tail if that batch is finished without it.
    """
    done = done or {}
    finished = {i for r in done.values() for i in r["ids"]}
    tail = Tail(s, max([total, *done]), last_chars, last_n)
    if max([total, *done]) > total or total in done:
        tail.chars, tail.n = s.max_chars + 1, 1  # the last batch is finished, or not a planned one

    def ask(number: int, batch: list[dict]) -> dict:
        drops = 0
        while True:
            corpus = "\n\n---\n\n".join(block(i, a) for i, a in enumerate(batch, 1))
            user = fill(s.prompts["batch_user_template"], batch_index=str(number), batch_total=str(tail.last), articles_corpus=corpus)
            try:
                answer, trims = guarded_chat(model, [{"role": "system", "content": s.prompts["batch_system"]}, {"role": "user", "content": user}], context=s.context, output=s.output, margin=s.margin, chars_per_token=s.chars_per_token)
                return {"batch_id": number, "ids": [a["id"] for a in batch], "summary": answer, "trims": trims, "drops": drops}
            except PromptTooLong as e:
                if not e.structural:
                    raise
                if len(batch) == 1:
                    shorter = trim_words(batch[0].get("text") or "", (e.overflow or 2048) + 2048, s.chars_per_token, fn.CUT_MARK)
                    if not shorter:
                        return {"batch_id": number, "ids": [batch[0]["id"]], "summary": "", "trims": 1, "drops": drops}
                    batch[0] = batch[0] | {"text": shorter}
                    continue
                wanted = 0 if e.overflow <= s.structural_threshold else int((e.overflow + 1024) * s.chars_per_token)
                moved = 0
                while len(batch) > 1 and (not moved or moved < wanted):
                    a = batch.pop()
                    moved, drops = moved + _size(a), drops + 1
                    tail.add(a, number)

    def logged(row: dict) -> dict:
        if log is not None:
            log(row)
        return row

    yield from (done[n] for n in sorted(done))
    for number, batch in planned:
        batch = [a for a in batch if a["id"] not in finished]
        if number in done:
            for a in batch:
                tail.add(a, number)
            continue
        if number == total and tail.batches[0][0] == number:
            batch += tail.batches[0][1]
            tail.batches[0][1].clear()
        if batch:
            yield logged(ask(number, batch))
    at = 0
    while at < len(tail.batches):
        number, batch = tail.batches[at]
        at += 1
        if batch:
            yield logged(ask(number, batch))


class BatchLog:
    """Finished batches of a job in a shared folder: a file each, written by the worker that has the answer."""

    def __init__(self, uri: str):
        self.uri = uri

    def _place(self, topic: str):
        files, path = pa_fs.FileSystem.from_uri(self.uri)
        return files, f"{path}/{hashlib.sha1(topic.encode()).hexdigest()}"

    def read(self, topic: str) -> dict[int, dict]:
        files, path = self._place(topic)
        found = files.get_file_info(pa_fs.FileSelector(path, allow_not_found=True))
        rows = [json.loads(files.open_input_stream(x.path).read()) for x in found if x.path.endswith(".json")]
        return {r["batch_id"]: r for r in rows if r["summary"]}

    def add(self, topic: str, row: dict) -> None:
        files, path = self._place(topic)
        files.create_dir(path, recursive=True)
        name = f"{path}/{row['batch_id']:09d}"
        with files.open_output_stream(f"{name}.tmp") as out:
            out.write(json.dumps(row).encode())
        files.move(f"{name}.tmp", f"{name}.json")

    def clear(self) -> None:
        files, path = pa_fs.FileSystem.from_uri(self.uri)
        if files.get_file_info(path).type == pa_fs.FileType.Directory:
            files.delete_dir(path)


def batches_of(articles: DataFrame, s: Settings) -> DataFrame:
    """topic, ord, id, batch_id with the articles' fields; bodies are clipped and joined back after packing."""
    keys = sel.interleave(articles.withColumn("est_chars", pk.article_estimate(s.clip)).select("id", "pos", "topic", "source", "ilv_ts", "est_chars"), "topic")
    packed = pk.pack(keys.select("topic", "ord", "id", "est_chars"), max_chars=s.max_chars, max_n=s.max_n)
    body = articles.select("id", "title", "source", "url", "published_ts", "eff_ts", fn.clip(F.col("text"), s.clip).alias("text"))
    return packed.join(body, "id")


def map_stage(batches: DataFrame, model: ChatModel, s: Settings, log: BatchLog | None = None) -> DataFrame:
    """SUMMARY rows.  Topics are dealt to ``topics_at_once`` tasks; a task reads its topics' batches in order, as they stream by.

    With a log, batches that it has are not asked for, and each new summary is
    added to it at once.
    """
    size = F.length(fn.text(F.col("text"))) + F.length(fn.text(F.col("title"))) + F.length(fn.text(F.col("url"))) + 200
    ends = batches.groupBy("topic", "batch_id").agg(F.sum(size).alias("chars"), F.count("*").alias("n")).groupBy("topic").agg(F.max(F.struct("batch_id", "chars", "n")).alias("last"))
    model = model.shared_by(s.topics_at_once)
    rows = batches.join(ends, "topic").select("topic", "batch_id", "ord", "id", "title", "source", "url", "text", F.col("last.batch_id").alias("total"), F.col("last.chars").alias("last_chars"), F.col("last.n").alias("last_n"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream = (r for pdf in frames for r in pdf.to_dict("records"))
        for topic, own in groupby(stream, key=lambda r: r["topic"]):
            first = next(own)
            planned = ((n, list(g)) for n, g in groupby(chain([first], own), key=lambda r: r["batch_id"]))
            done = log.read(topic) if log else None
            add = (lambda row, topic=topic: log.add(topic, row)) if log else None
            for row in map_topic(planned, model, s, total=int(first["total"]), last_chars=int(first["last_chars"]), last_n=int(first["last_n"]), done=done, log=add):
                yield pd.DataFrame([{"topic": topic, **row}], columns=[c.split()[0] for c in SUMMARY.split(", ")])

    return rows.repartition(s.topics_at_once, "topic").sortWithinPartitions("topic", "batch_id", "ord").mapInPandas(run, SUMMARY)


def reduce_stage(summaries: DataFrame, sources: DataFrame, model: ChatModel, s: Settings) -> DataFrame:
    """SECTION rows: one reduce prompt a topic, fitted to a budget that shrinks if it is too long; then proofreading.

    ``sources``: topic, lines.
    """
    budget, model = max(256, s.context - s.output - s.margin), model.shared_by(s.topics_at_once)

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.to_dict("records"):
                parts = [(int(p["batch_id"]), p["summary"]) for p in r["parts"]]
                made = lambda b: fit_meta(s.prompts["meta_user_template"], parts, r["lines"] or "", lookback=s.lookback, budget=b, chars_per_token=s.chars_per_token)  # noqa: E731, B023
                ask = lambda user: model.chat([{"role": "system", "content": s.prompts["meta_system"]}, {"role": "user", "content": user}], temperature=0.2)
                text = retrying(made, ask, budget, 8, PromptTooLong, s.chars_per_token)
                desk = "\n\n".join(p[1] for p in parts)
                edited = proofread(model, s.prompts, text.strip(), desk, lookback=s.lookback, budget=budget, max_rounds=s.proofread_rounds, chars_per_token=s.chars_per_token)
                counts = [sum(x[k] for x in edited.rounds) for k in ("requested", "applied", "skipped", "blocked")]
                out.append((r["topic"], edited.text, len(parts), int(r["trims"]), int(r["drops"]), budget, edited.feedback, len(edited.rounds), *counts))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in SECTION.split(", ")])

    parts = summaries.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("batch_id", "summary"))).alias("parts"), F.sum("trims").alias("trims"), F.sum("drops").alias("drops"))
    return parts.join(sources, "topic", "left").repartition(s.topics_at_once, "topic").mapInPandas(run, SECTION)


def overview_of(model: ChatModel, sections: list[dict], s: Settings) -> str:
    """One prompt over all topics; empty without prompts or texts."""
    system, template = s.prompts.get("super_meta_system"), s.prompts.get("super_meta_user_template")
    text = "\n\n".join(f"## {x['topic']}\n\n{x['summary']}" for x in sections if (x["summary"] or "").strip())
    if not system or not template or not text:
        return ""

    def made(budget: int) -> str:
        t = text
        for _ in range(6):
            user = fill(template, lookback=s.lookback, topic_summaries=t)
            if tokens(user, s.chars_per_token) <= budget:
                return user
            t = t[: max(500, int(len(t) * 0.85))]
        return fill(template, lookback=s.lookback, topic_summaries=t[:2000])

    ask = lambda user: model.chat([{"role": "system", "content": system}, {"role": "user", "content": user}], temperature=0.2)
    return retrying(made, ask, max(256, s.context - s.output - s.margin), 6, PromptTooLong, s.chars_per_token).strip()


def _day(ts: int, pattern: str = "%Y-%m-%d") -> str:
    return datetime.fromtimestamp(ts, UTC).strftime(pattern) if ts else ""


def title_of(model: ChatModel, s: Settings, summary: str, from_ts: int, to_ts: int) -> str:
    a, b = _day(from_ts), _day(to_ts)
    span = "" if not a or not b else a if a == b else f"{a}–{b}"
    default = "Nyhetssammanfattning" + (f" {span}" if span else "") + (f" ({s.lookback.strip()})" if s.lookback.strip() else "")
    asked = title_prompt(s.prompts, summary, s.lookback, a, b)
    if asked is None:
        return default
    try:
        lines = guarded_chat(model, asked, structural_over=None)[0].strip().splitlines()
    except Exception:  # a digest without the model's title is better than none
        return default
    line = lines[0].strip().strip('"').strip("'").strip() if lines else ""
    return default if not line else line if len(line) <= 120 else line[:120].rstrip() + "…"


def ingress_of(model: ChatModel, s: Settings, text: str) -> str:
    """A few opening lines; empty without prompts or if the model fails."""
    system, template = s.prompts.get("ingress_system"), s.prompts.get("ingress_user_template")
    if not system or not template or not text:
        return ""
    try:
        return guarded_chat(model, [{"role": "system", "content": system}, {"role": "user", "content": fill(template, summary=text, lookback=s.lookback)}], structural_over=None)[0].strip()
    except Exception:  # the document is complete without
        return ""


def assemble(spark: SparkSession, topical: DataFrame, sections: DataFrame, model: ChatModel, s: Settings, *, now: int, job: int | None = None, kind: str = "summary") -> dict:
    """The summary document of the sections, in the order of the topics' ranks.  What comes to the driver is a row a topic and the selected articles' snapshots."""
    ranks = sel.topic_ranks(topical).select("topic", "rank")
    spans = sel.topic_spans(topical).select("topic", "from_ts", "to_ts")
    ordered = sel.interleave(topical.drop("text"), "topic")
    snaps = sel.snapshots(ordered, "topic")
    rows = [r.asDict(recursive=True) for r in sections.join(ranks, "topic").join(spans, "topic").join(snaps, "topic").orderBy("rank").collect()]
    out_sections = []
    for r in rows:
        out_sections.append({"topic": r["topic"], "from": r["from_ts"], "to": r["to_ts"], "sources": [x["id"] for x in r["sources_snapshots"]], "sources_snapshots": [x | {"topic": r["topic"]} for x in r["sources_snapshots"]], "summary": r["summary"], "meta": {k: str(r[k]) for k in ("batch_total", "trims", "drops", "rounds", "requested", "applied", "skipped", "blocked")}})
    overview = overview_of(model, out_sections, s) if len(out_sections) > 1 else ""
    stitched = out_sections[0]["summary"] if len(out_sections) == 1 else "\n\n".join(f"## {x['topic']}\n\n{x['summary']}" for x in out_sections)
    body = (f"{overview}\n\n{stitched}" if overview else stitched).strip()
    appendix = [r[0] for r in sel.appendix(topical.drop("text").withColumn("all", F.lit(1)), "all").select("appendix").collect()]
    starts, ends = [x["from"] for x in out_sections if x["from"]], [x["to"] for x in out_sections if x["to"]]
    lo, hi = min(starts, default=0), max(ends, default=0)
    return {
        "id": f"sum_{_day(now, '%Y%m%d_%H%M')}" + (f"_job{job}" if job is not None else ""), "title": title_of(model, s, body, lo, hi), "created": now, "kind": kind,
        "sources": list(dict.fromkeys(i for x in out_sections for i in x["sources"])), "sources_snapshots": [y for x in out_sections for y in x["sources_snapshots"]],
        "from": lo, "to": hi, "overview": overview, "summary": body + ("\n\n" + appendix[0] if appendix else ""), "sections": out_sections, "prompts": s.prompts, "meta": {"topics": str(len(out_sections))},
        "llm": s.projection("context", "output", "margin", "chars_per_token") | {"model": type(model).__name__}, "batching": s.projection("max_chars", "max_n", "clip", "structural_threshold", "topics_at_once"),
        "selection": {"prompt_package": s.package, "lookback": s.lookback, "articles": str(len({i for x in out_sections for i in x["sources"]}))}, "proofread_feedback": "\n\n".join(r["feedback"] for r in rows if r["feedback"]),
    }


def _with_order(articles: DataFrame) -> DataFrame:
    """Articles with ``pos``, the order of their first appearance: by the time they were fetched, then by id."""
    return articles.withColumn("pos", F.struct(F.coalesce("fetched_at", F.lit(0)).alias("at"), F.col("id").alias("key")))


def summarise(spark: SparkSession, topical: DataFrame, model: ChatModel, s: Settings, *, now: int, job: int | None = None, store: Store | None = None, key: str | None = None) -> dict:
    """Map, reduce and assembly over articles with a topic.

    With a store, each finished batch is logged under ``key`` with its articles,
    and a later run with that key asks only for the others.
    """
    lines = topical.groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("eff_ts", "pos", fn.source_line(F.col("title"), F.col("url")).alias("l")))).alias("x"))
    lines = lines.select("topic", F.array_join(F.transform("x", lambda x: x["l"]), "\n").alias("lines"))
    log = BatchLog(f"{store.root}/batch_log/{key}") if store and key else None
    mapped = map_stage(batches_of(topical, s), model, s, log)
    if store and key:
        store.save_checkpoint(mapped.withColumn("job_id", F.lit(job).cast("long")), key)
        mapped = store.load_checkpoint(key)
    sections = reduce_stage(mapped, lines, model, s)
    doc = assemble(spark, topical, sections, model, s, now=now, job=job)
    if store and key:
        store.clear_checkpoint(key)
        log.clear()
    return doc


def run(spark: SparkSession, config: dict, store: Store, feeds: DataFrame, *, now: int, model: ChatModel | None = None, job: int | None = None, overrides: dict | None = None, entries: DataFrame | None = None) -> str | None:
    """Ingest (if entries with pages are given), select, summarise, save; gives the id of the summary document, None if nothing was selected."""
    from presswerk.sources import ingest

    def tell(**fields) -> None:
        if job is not None:
            store.update_job(job, **fields)

    config = apply_overrides(config, overrides)
    s, model = Settings.of(config), model or ExtractiveModel()
    tell(status="running", started_at=now, message="selecting")
    try:
        if entries is not None:
            got = store.upsert_articles(ingest.articles_of(entries, now))
            tell(message=f"ingested {got['inserted']} new, {got['updated']} changed")
        own = sel.override_feeds(feeds, (overrides or {}).get("sources"), (overrides or {}).get("topics"))
        sources = [r["name"] for r in own.select("name").collect()]
        seconds = spark.range(1).select(fn.lookback_seconds(F.lit(s.lookback))).first()[0]
        chosen = sel.window(_with_order(store.articles()), since=now - seconds if s.lookback else None, sources=sources, limit=2000)
        chosen = sel.with_topic(chosen, own)
        if chosen.isEmpty():
            tell(status="done", finished_at=now, message="no articles")
            return None
        if job is not None:
            ids = sel.interleave(chosen.drop("text")).select("ord", F.col("id").alias("article_id"), "topic")
            store.save_corpus(ids, job)
            topics = {r["topic"]: r["n"] for r in chosen.groupBy("topic").agg(F.count("*").alias("n")).collect()}
            tell(context=json.dumps({"overrides": overrides or {}, "lookback": s.lookback, "selection": {"sources": sources, "articles": sum(topics.values()), "prompt_package": s.package}, "topics": topics}), message=f"summarising {sum(topics.values())} articles")
        doc = summarise(spark, chosen, model, s, now=now, job=job, store=store, key=f"job_{job}" if job is not None else None)
        return _finish(store, doc, chosen, now, tell)
    except Exception as e:
        tell(status="failed", finished_at=now, message=str(e)[:500])
        raise


def _finish(store: Store, doc: dict, chosen: DataFrame, now: int, tell: Callable) -> str:
    saved = store.save_summary(doc, now)
    store.mark_summarized(chosen.select("id"), now)
    tell(status="done", finished_at=now, summary_id=saved, message="done")
    return saved


def stored_corpus(store: Store, job: int) -> DataFrame:
    """The articles of a job with the topics and the order that it has stored; an error without any."""
    corpus = store.load_corpus(job).select(F.col("article_id").alias("id"), "topic", F.col("ord").alias("pos"))
    if corpus.isEmpty():
        raise RuntimeError(f"job {job} has no stored corpus")
    return store.articles().join(corpus, "id")


def resume(spark: SparkSession, config: dict, store: Store, job: int, *, now: int, model: ChatModel | None = None) -> str:
    """Goes on with a job from its stored corpus and finished batches, with the overrides it was started with."""
    config = apply_overrides(config, store.job_context(job).get("overrides"))
    chosen = stored_corpus(store, job)
    doc = summarise(spark, chosen, model or ExtractiveModel(), Settings.of(config), now=now, job=job, store=store, key=f"job_{job}")
    return _finish(store, doc, chosen, now, lambda **fields: store.update_job(job, **fields))


def summarise_text(spark: SparkSession, config: dict, articles: DataFrame, *, now: int, model: ChatModel | None = None) -> str:
    """Only the text of a digest of articles that have a topic (without one: the fallback topic); nothing is stored."""
    topical = articles if "topic" in articles.columns else articles.withColumn("topic", F.lit(fn.NO_TOPIC))
    return summarise(spark, topical, model or ExtractiveModel(), Settings.of(config), now=now)["summary"]


def resume_text(spark: SparkSession, config: dict, store: Store, job: int, *, now: int, model: ChatModel | None = None) -> tuple[str, dict[str, str]]:
    """The text of a resumed job and its numbers; the document is not saved and no article is marked."""
    doc = summarise(spark, stored_corpus(store, job), model or ExtractiveModel(), Settings.of(config), now=now, job=job, store=store, key=f"job_{job}")
    numbers = {k: str(sum(int(x["meta"][k]) for x in doc["sections"])) for k in ("batch_total", "trims", "drops")}
    return doc["summary"], doc["meta"] | numbers


def replay(spark: SparkSession, config: dict, store: Store, summary_id: str, *, now: int, model: ChatModel | None = None, prompts: dict[str, str] | None = None, package: str | None = None, save: bool = False) -> dict:
    """The document that other prompts (or those of a package) give for a stored summary's articles and topics; saved under an id of its own if asked for."""
    doc = store.get_summary(summary_id)
    if doc.isEmpty():
        raise KeyError(summary_id)
    topics = sel.snapshot_topics(doc.select(F.posexplode("sources_snapshots").alias("pos", "x")).select("pos", "x.id", F.coalesce("x.topic", F.lit(fn.NO_TOPIC)).alias("topic")))
    chosen = _with_order(store.articles()).join(topics, "id")
    s = Settings.of(apply_overrides(config, {"prompt_package": package}))
    s.prompts = s.prompts | (prompts or {})
    out = summarise(spark, chosen, model or ExtractiveModel(), s, now=now) | {"kind": "replay"}
    out |= {"id": f"{out['id']}_replay", "meta": out["meta"] | {"replay_of": summary_id}}
    if save:
        store.save_summary(out, now)
    return out


def compose(spark: SparkSession, config: dict, store: Store, parts: list[dict], *, now: int, name: str = "composed", model: ChatModel | None = None) -> str:
    """A document of stored summaries: parts have summary_id and a heading (schedule, else tag, else promptpackage)."""
    s, model = Settings.of(config), model or ExtractiveModel()
    wanted = [(i, str(p["summary_id"]).strip(), str(p.get("schedule") or p.get("tag") or p.get("promptpackage") or "")) for i, p in enumerate(parts) if str(p.get("summary_id") or "").strip().lower() not in ("", "none", "null")]
    asked = spark.createDataFrame(wanted, "pos int, id string, tag string")
    docs = store.read("summary_docs")
    missing = [r["id"] for r in asked.join(docs.select("id"), "id", "left_anti").collect()]
    if missing:
        raise KeyError(", ".join(missing))
    rows = asked.join(docs, "id").select("pos", "id", "tag", fn.strip_appendix(F.col("summary")).alias("summary"), "sources", "sources_snapshots", "from", "to")
    one = rows.agg(
        fn.composed_text(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag", "summary"))), lambda x: F.struct(x["tag"].alias("tag"), x["summary"].alias("summary"))), F.lit("")).alias("text"),
        F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sources"))), lambda x: x["sources"]))).alias("sources"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("pos", "sources_snapshots"))), lambda x: x["sources_snapshots"])).alias("snapshots"),
        F.coalesce(F.min(F.when(F.col("from") > 0, F.col("from"))), F.lit(0)).alias("lo"), F.coalesce(F.max(F.when(F.col("to") > 0, F.col("to"))), F.lit(0)).alias("hi"),
    ).first()
    edited = proofread(model, s.prompts, one["text"], "", lookback=s.lookback, max_rounds=1)
    verdict = spark.range(1).select(fn.rewrite_verdict(F.lit(one["text"]), F.lit(edited.text))).first()[0]
    body = edited.text if verdict.startswith("accepted") else one["text"]
    opening = ingress_of(model, s, body)
    body = f"{opening}\n\n{body}" if opening and body else opening or body
    doc = {
        "id": f"sum_{_day(now, '%Y%m%d_%H%M')}_composed", "title": title_of(model, s, body, one["lo"], one["hi"]), "created": now, "kind": "composed", "from": one["lo"], "to": one["hi"], "summary": body,
        "sources": one["sources"], "sources_snapshots": [x.asDict() for x in one["snapshots"] or []], "selection": {"name": name, "lookback": s.lookback}, "meta": {"composed": "true", "rewrite": verdict},
    }
    return store.save_summary(doc, now)


#: Characters of an article in a trial of prompts.
LAB_CLIP = 2500


def lab(spark: SparkSession, config: dict, store: Store, articles: DataFrame, feeds: DataFrame, *, job: int, now: int, model: ChatModel | None = None) -> str:
    """A trial of prompts: the same stages on shorter clips, the text kept as the job's temporary summary."""
    s = Settings.of(config)
    s.clip = int((config.get("batching") or {}).get("article_clip_chars") or LAB_CLIP)
    store.update_job(job, status="running", started_at=now, message="trying prompts")
    try:
        doc = summarise(spark, sel.with_topic(articles, feeds), model or ExtractiveModel(), s, now=now)
    except Exception as e:
        store.update_job(job, status="failed", finished_at=now, message=str(e)[:500])
        raise
    store.save_temp_summary(job, doc["summary"], json.dumps(doc["meta"]), now)
    store.update_job(job, status="done", finished_at=now, message="done")
    return doc["summary"]


def apply_overrides(config: dict, overrides: dict | None) -> dict:
    """A copy of the config with the lookback and prompt package of the overrides."""
    import copy

    out = copy.deepcopy(config)
    lookback = str((overrides or {}).get("lookback") or "").strip()
    if lookback:
        out.setdefault("ingest", {})["lookback"] = lookback
    package = str((overrides or {}).get("prompt_package") or "").strip()
    if package:
        prompts = out.setdefault("prompts", {})
        if isinstance(prompts, dict):
            prompts["selected"] = package
    return out
