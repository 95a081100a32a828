"""Tables kept as versioned Parquet folders: reads, upserts, job events, retention."""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from presswerk import schema
from presswerk.functions.text import normal_summary_id, summary_class, text


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row for each key, the one with the largest version (aggregated before the shuffle)."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.col(version)).alias("__r")).select(*keys, *[F.col(f"__r.`{c}`").alias(c) for c in rest])


def upsert(stored: DataFrame, new: DataFrame, key: str = "id", *, mode: str = "replace") -> DataFrame:
    """The table after new rows (with ``seq``, later wins) replaced those of the same key, or were merged into them.

    With ``merge`` a null in the new row keeps the stored value.
    """
    fresh = latest(new, [key], "seq").drop("seq")
    if mode == "replace":
        return stored.join(fresh.select(key), key, "left_anti").select(*stored.columns).unionByName(fresh, allowMissingColumns=True).select(*stored.columns)
    if mode != "merge":
        raise ValueError("mode is replace or merge")
    both = stored.alias("s").join(fresh.alias("n"), key, "full_outer")
    own = [key, *[c for c in stored.columns if c != key]]
    return both.select(key, *[(F.coalesce(F.col(f"n.`{c}`"), F.col(f"s.`{c}`")) if c in fresh.columns else F.col(f"s.`{c}`")).alias(c) for c in own[1:]]).select(*stored.columns)


def change_actions(stored: DataFrame, new: DataFrame) -> DataFrame:
    """``new`` with ``action``: insert if the id is unknown, update if the content hash differs, else unchanged."""
    old = stored.select("id", F.col("content_hash").alias("__old"), F.lit(True).alias("__known"))
    action = F.when(F.col("__known").isNull(), "insert").when(~F.col("__old").eqNullSafe(F.col("content_hash")), "update").otherwise("unchanged")
    return new.join(old, "id", "left").withColumn("action", action).drop("__old", "__known")


def mark_summarized(articles: DataFrame, ids: DataFrame, now: int) -> DataFrame:
    """Sets the flag and time of the articles in ``ids``; unknown ids are skipped."""
    hit = ids.select("id").distinct().withColumn("__hit", F.lit(True))
    rows = articles.join(hit, "id", "left")
    at = F.col("summarized_at") if "summarized_at" in articles.columns else F.lit(None).cast("long")
    return rows.withColumns({"summarized": F.coalesce("__hit", "summarized"), "summarized_at": F.when(F.col("__hit"), F.lit(now).cast("long")).otherwise(at)}).drop("__hit")


def fold_jobs(events: DataFrame) -> DataFrame:
    """State of each job: for each field the last value set; extra JSON fields are merged the same way."""
    fields = ["created_at", "started_at", "finished_at", "status", "message", "summary_id"]
    state = events.groupBy("job_id").agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("seq"))).alias(c) for c in fields])
    extra = events.select("job_id", "seq", F.explode(F.from_json("fields_json", "map<string,string>")).alias("k", "v")).groupBy("job_id", "k").agg(F.max_by("v", "seq").alias("v"))
    merged = extra.groupBy("job_id").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v"))))).alias("fields_json"))
    return state.withColumn("summary_id", normal_summary_id(F.col("summary_id"))).join(merged, "job_id", "left")


@dataclass(frozen=True)
class Retention:
    """Days that rows are kept."""

    articles: int = 180
    daily: int = 7
    weekly: int = 30
    temp: int = 30
    jobs: int = 90


def expired_articles(a: DataFrame, now: int, days: int) -> Column:
    return F.col("eff_ts") < now - days * 86400


def expired_jobs(now: int, days: int) -> Column:
    return (F.coalesce("finished_at", "created_at", F.lit(0)) < now - days * 86400) & F.col("status").isin("done", "failed")


def expired_summaries(now: int, daily: int, weekly: int, doc: str = "doc_json") -> Column:
    cut = F.when(summary_class(F.col(doc)) == "daily", now - daily * 86400).otherwise(now - weekly * 86400)
    return F.coalesce("created", F.lit(0)) < cut


def expired_temp(now: int, days: int) -> Column:
    return F.coalesce("created_at", F.lit(0)) < now - days * 86400


def bucket_of(key: Column, count: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(count)).cast("int")


def _read_json(value):
    """A mapping or list that is kept as JSON; other values as they are."""
    try:
        return json.loads(value) if str(value)[:1] in "{[" else value
    except ValueError:
        return value


class Conflict(RuntimeError):
    """Another writer holds the table."""


class Store:
    """Tables in folders ``root/<table>/v=<n>``; the newest version with a manifest is the table.

    A version holds the buckets that its write touched; its manifest says in
    which version each bucket is.  The manifest is written last, so that a read
    never sees half a write and a table can be read while its next version is
    written.  A writer first claims the next number by creating a file, which
    succeeds once; others wait until the version is there, or the claim is so old
    that its writer must be gone.  Rows are appended as files beside those of the
    newest version, each append in a folder of its own, without a rewrite.  Versions that nobody needs are dropped by
    ``vacuum``.
    """

    #: Seconds after which a claim without a version is void, and between tries.
    STALE, PAUSE = 3600, 0.2

    def __init__(self, spark: SparkSession, root: str, *, mode: str = "replace"):
        if mode not in ("replace", "merge"):
            raise ValueError("mode is replace or merge")
        self.spark, self.root, self.mode = spark, root.rstrip("/"), mode

    # -- versions --------------------------------------------------------
    def _fs(self, path: str):
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _names(self, path: str) -> dict[str, int]:
        """Names in a folder, with their times in ms."""
        fs, p = self._fs(path)
        return {x.getPath().getName(): x.getModificationTime() for x in fs.listStatus(p)} if fs.exists(p) else {}

    def versions(self, name: str) -> list[int]:
        return sorted(int(x[9:]) for x in self._names(f"{self.root}/{name}") if x.startswith("_manifest") and x[9:].isdigit())

    def manifest(self, name: str, version: int | None = None) -> dict[int, int]:
        """The version that holds each bucket."""
        have = self.versions(name)
        if not have:
            return {}
        fs, p = self._fs(f"{self.root}/{name}/_manifest{have[-1] if version is None else version}")
        stream = fs.open(p)
        try:
            return {int(k): v for k, v in json.loads(bytes(stream.readAllBytes()).decode()).items()}
        finally:
            stream.close()

    def _write_text(self, path: str, value: str) -> None:
        """Creates a file; it appears under its name when it is complete."""
        fs, draft = self._fs(f"{path}.{uuid.uuid4().hex}.tmp")
        stream = fs.create(draft, True)
        stream.write(value.encode())
        stream.close()
        if not fs.rename(draft, self._fs(path)[1]):
            raise Conflict(path)

    def _create(self, path: str) -> bool:
        """Whether this call created the file; of several at a time one does."""
        fs, p = self._fs(path)
        if fs.getUri().getScheme() == "file":  # where the library looks first and creates then
            local = fs.makeQualified(p).toUri().getPath()
            os.makedirs(os.path.dirname(local), exist_ok=True)
            try:
                os.close(os.open(local, os.O_CREAT | os.O_EXCL))
                return True
            except FileExistsError:
                return False
        try:
            return fs.createNewFile(p)
        except Py4JJavaError:
            if fs.exists(p):
                return False
            raise

    def _claim(self, name: str, tries: int) -> int:
        """The number of the next version, which no other writer has."""
        for k in range(tries):
            names, now = self._names(f"{self.root}/{name}"), time.time() * 1000
            have = self.versions(name)
            claims = {int(x[6:]): at for x, at in names.items() if x.startswith("_claim") and x[6:].isdigit()}
            if all(n in have or now - at > self.STALE * 1000 for n, at in claims.items()):
                if self._create(f"{self.root}/{name}/_claim{max([0, *have, *claims]) + 1}"):
                    return max([0, *have, *claims]) + 1
            if k + 1 < tries:
                time.sleep(self.PAUSE)
        raise Conflict(f"another writer holds {name}")

    def _rows(self, name: str, held: dict[int, int]) -> DataFrame:
        kind = schema.ddl(schema.TABLES[name])
        paths = [f"{self.root}/{name}/v={v}/bucket={b}" for b, v in sorted(held.items())]
        paths = [x for x in paths if (lambda fs, p: fs.exists(p))(*self._fs(x))]
        return self.spark.read.schema(kind).option("recursiveFileLookup", "true").parquet(*paths) if paths else self.spark.createDataFrame([], kind)

    def read(self, name: str) -> DataFrame:
        return self._rows(name, self.manifest(name))

    def _put(self, name: str, df: DataFrame, version: int) -> None:
        kind, (key, count) = schema.TABLES[name], schema.BUCKETS.get(name, (None, 1))
        bucket = bucket_of(F.col(key), count) if key else F.lit(0)
        rows = df.select(*[(F.col(f"`{f}`") if f in df.columns else F.lit(None)).cast(t).alias(f) for f, t in kind.items()], bucket.alias("bucket"))
        rows = rows.repartition("bucket") if key else rows
        rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/{name}/v={version}")

    def update(self, name: str, change: Callable[[DataFrame], DataFrame], *, buckets: list[int] | None = None, tries: int = 600, first: bool = False) -> None:
        """A new version: ``change`` of the table, or of the rows in some of its buckets, while other writers wait; with ``first`` only if there is none."""
        number = self._claim(name, tries)
        try:
            held = self.manifest(name)
            if first and held:
                fs, p = self._fs(f"{self.root}/{name}/_claim{number}")
                fs.delete(p, False)
                return
            count = schema.BUCKETS.get(name, (None, 1))[1]
            touched = list(range(count)) if buckets is None else buckets
            self._put(name, change(self._rows(name, {b: v for b, v in held.items() if b in set(touched)})), number)
            self._write_text(f"{self.root}/{name}/_manifest{number}", json.dumps(held | dict.fromkeys(touched, number)))
        except BaseException:
            fs, p = self._fs(f"{self.root}/{name}/_claim{number}")
            fs.delete(p, False)
            raise

    def write(self, name: str, df: DataFrame) -> None:
        self.update(name, lambda _: df)

    def append(self, name: str, df: DataFrame) -> None:
        """Adds rows to a table without a key, as further files of its newest version."""
        if not self.versions(name):
            self.update(name, lambda old: old, first=True)
        kind = schema.TABLES[name]
        rows = df.select(*[(F.col(f"`{f}`") if f in df.columns else F.lit(None)).cast(t).alias(f) for f, t in kind.items()])
        rows.write.parquet(f"{self.root}/{name}/v={self.manifest(name)[0]}/bucket=0/add-{uuid.uuid4().hex}")

    def vacuum(self, name: str, keep: int = 2) -> None:
        """Drops the versions that the newest ``keep`` manifests do not refer to."""
        have = self.versions(name)
        needed = {v for n in have[-keep:] for v in self.manifest(name, n).values()} | set(have[-keep:])
        for n in have:
            for x, own in ((f"v={n}", n in needed), (f"_manifest{n}", n in have[-keep:]), (f"_claim{n}", n in have[-keep:])):
                if not own:
                    fs, p = self._fs(f"{self.root}/{name}/{x}")
                    fs.delete(p, True)

    # -- articles --------------------------------------------------------
    def articles(self) -> DataFrame:
        from presswerk.operators.select import with_times

        return with_times(self.read("articles"))

    def get_article(self, article_id: str) -> DataFrame:
        return self.read("articles").where(F.col("id") == article_id)

    def upsert_articles(self, new: DataFrame) -> dict[str, int]:
        """Change-detecting upsert; gives the counts of inserted and updated articles.

        Two ids with one non-empty url are refused, as the url is unique.  Only
        the buckets of changed ids are written anew, and only the urls of new
        rows are looked for.
        """
        rows = new if "seq" in new.columns else new.withColumn("seq", F.lit(0))
        todo = change_actions(self.read("articles").select("id", "content_hash"), rows).where("action <> 'unchanged'").persist()
        try:
            counts = {r["action"]: r["n"] for r in todo.groupBy("action").agg(F.count_distinct("id").alias("n")).collect()}
            if counts:
                key, count = schema.BUCKETS["articles"]
                fresh = todo.drop("action")
                self._refuse_shared_urls(latest(fresh, ["id"], "seq"))
                touched = sorted(r[0] for r in todo.select(bucket_of(F.col(key), count)).distinct().collect())
                self.update("articles", lambda old: upsert(old, fresh, mode=self.mode), buckets=touched)
        finally:
            todo.unpersist()
        return {"inserted": counts.get("insert", 0), "updated": counts.get("update", 0)}

    def _refuse_shared_urls(self, fresh: DataFrame) -> None:
        own = fresh.where(text(F.col("url")) != "").select("id", "url")
        others = self.read("articles").select("id", "url").join(own.select("id"), "id", "left_anti").join(own.select("url"), "url", "left_semi")
        clash = own.unionByName(others).groupBy("url").agg(F.count_distinct("id").alias("n")).where("n > 1").limit(1).collect()
        if clash:
            raise ValueError(f"url {clash[0]['url']} belongs to two ids")

    def mark_summarized(self, ids: DataFrame, now: int) -> None:
        key, count = schema.BUCKETS["articles"]
        known = ids.select("id").distinct()
        touched = sorted(r[0] for r in known.select(bucket_of(F.col(key), count)).distinct().collect())
        self.update("articles", lambda old: mark_summarized(old, known, now), buckets=touched)

    # -- jobs ------------------------------------------------------------
    def jobs(self) -> DataFrame:
        return fold_jobs(self.read("jobs"))

    def create_job(self, now: int) -> int:
        """A queued job under the next free id, which is claimed by a file, so that no two writers get the same."""
        job = (self.read("jobs").agg(F.max("job_id")).first()[0] or 0) + 1
        while True:
            if self._create(f"{self.root}/jobs/_ids/{job}"):
                break
            job += 1
        self._job_event(job, created_at=now, status="queued", message="")
        return job

    def update_job(self, job_id: int, **fields) -> None:
        if job_id <= 0:
            raise ValueError("job ids are positive")
        self._job_event(job_id, **fields)

    def _job_event(self, job_id: int, **fields) -> None:
        known = {k: v for k, v in fields.items() if k in schema.JOB_EVENTS}
        extra = {k: v if isinstance(v, str) else json.dumps(v) for k, v in fields.items() if k not in known}
        row = {"job_id": job_id, "seq": time.time_ns(), **known, "fields_json": json.dumps(extra) if extra else None}
        event = self.spark.createDataFrame([tuple(row.get(f) for f in schema.JOB_EVENTS)], schema.ddl(schema.JOB_EVENTS))
        self.append("jobs", event.coalesce(1))

    def get_job(self, job_id: int) -> dict | None:
        """A job's fields with its extra ones, of which JSON is read, flattened over them."""
        row = self.jobs().where(F.col("job_id") == job_id).first()
        if row is None:
            return None
        out = row.asDict()
        return out | {k: _read_json(v) for k, v in json.loads(out.pop("fields_json") or "{}").items()} | {"id": job_id}

    def job_context(self, job_id: int) -> dict:
        """What the job was asked for; empty if there is none."""
        context = (self.get_job(job_id) or {}).get("context")
        return context if isinstance(context, dict) else {}

    def list_jobs(self, limit: int = 200) -> DataFrame:
        return self.jobs().orderBy(F.desc(F.coalesce("created_at", F.lit(0))), F.desc("job_id")).limit(limit if limit > 0 else 200)

    # -- summaries -------------------------------------------------------
    def save_summary(self, doc: dict, now: int) -> str:
        """Upserts a summary document by its id, with all of it as JSON beside its fields."""
        doc = {"created": now, "kind": "summary"} | doc
        doc.setdefault("id", f"summary_{doc['created']}_{uuid.uuid4().hex[:6]}")
        doc.setdefault("doc_json", json.dumps(doc, ensure_ascii=False, default=str))
        row = self.spark.createDataFrame([tuple(doc.get(f) for f in schema.SUMMARIES)], schema.ddl(schema.SUMMARIES))
        self.update("summary_docs", lambda old: upsert(old, row.withColumn("seq", F.lit(0))))
        return doc["id"]

    def get_summary(self, summary_id: str) -> DataFrame:
        return self.read("summary_docs").where(F.col("id") == summary_id)

    def list_summaries(self) -> DataFrame:
        return self.read("summary_docs").orderBy(F.desc(F.coalesce("created", F.lit(0))), "id")

    def latest_summary(self) -> DataFrame:
        return self.list_summaries().limit(1)

    def save_temp_summary(self, job_id: int, summary: str, meta: str, now: int) -> None:
        row = self.spark.createDataFrame([(job_id, now, summary, meta)], schema.ddl(schema.TEMP_SUMMARIES)).withColumn("seq", F.lit(0))
        self.update("temp_summaries", lambda old: upsert(old, row, "job_id"))

    def get_temp_summary(self, job_id: int) -> DataFrame:
        return self.read("temp_summaries").where(F.col("job_id") == job_id)

    # -- checkpoints -----------------------------------------------------
    def save_corpus(self, rows: DataFrame, job: int) -> None:
        """The articles of a job (article_id, ord, topic), instead of those that it had."""
        own = rows.withColumn("job_id", F.lit(job).cast("long"))
        self.update("corpus", lambda old: old.where(F.col("job_id") != job).unionByName(own.select(*old.columns)))

    def load_corpus(self, job: int) -> DataFrame:
        return self.read("corpus").where(F.col("job_id") == job)

    def save_checkpoint(self, rows: DataFrame, key: str) -> None:
        self.update("checkpoints", lambda old: old.where(F.col("key") != key).unionByName(rows.withColumn("key", F.lit(key)), allowMissingColumns=True))

    def load_checkpoint(self, key: str) -> DataFrame:
        return self.read("checkpoints").where(F.col("key") == key)

    def clear_checkpoint(self, key: str) -> None:
        self.update("checkpoints", lambda old: old.where(F.col("key") != key))

    # -- retention -------------------------------------------------------
    def cleanup(self, policy: Retention, now: int) -> dict[str, int]:
        """Drops expired rows; gives the number removed from each table.  Job events that others append meanwhile may be lost, so it is for quiet times."""
        from presswerk.operators.select import with_times

        removed = {}
        ended = self.jobs().where(expired_jobs(now, policy.jobs)).select("job_id")
        for name, rows, gone in (
            ("articles", self.articles(), expired_articles(None, now, policy.articles)),
            ("temp_summaries", self.read("temp_summaries"), expired_temp(now, policy.temp)),
            ("summary_docs", self.read("summary_docs"), expired_summaries(now, policy.daily, policy.weekly)),
        ):
            removed[name] = rows.where(gone).count()
            if removed[name]:
                timed = with_times if name == "articles" else lambda x: x
                self.update(name, lambda old, gone=gone, timed=timed: timed(old).where(~F.coalesce(gone, F.lit(False))))
        removed["jobs"] = ended.count()
        if removed["jobs"]:
            self.update("jobs", lambda old: old.join(ended, "job_id", "left_anti"))
        return removed


def create_store(spark: SparkSession, config: dict) -> Store:
    """A store of ``config['store']``: path, and provider tinydb (merge) or sqlite (replace) for their upsert rules."""
    own = config.get("store") or {}
    kind = str(own.get("provider") or "tinydb").strip().lower()
    modes = {"tinydb": "merge", "sqlite": "replace", "sqlite3": "replace", "parquet": "replace"}
    if kind not in modes:
        raise ValueError(f"no store of kind {kind}")
    return Store(spark, os.path.expanduser(os.path.expandvars(str(own.get("path") or "news_store"))), mode=modes[kind])


def newest(rows: DataFrame, order: str, limit: int) -> DataFrame:
    return rows.orderBy(F.desc(F.coalesce(order, F.lit(0))), "id").limit(limit)


def rank_newest(rows: DataFrame, order: str, by: str) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(F.desc(order))))
