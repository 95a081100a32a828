"""Feeds and articles: XML entries, fetching, text of HTML, legacy stores."""

from __future__ import annotations

import random
import time
import urllib.error
import urllib.request
import uuid
from collections.abc import Callable, Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswerk.functions import text as fn
from presswerk.operators import select as sel
from presswerk.operators.store import Store
from presswerk.sources import packages

MIN_CHARS = 200
ENTRY = "feed string, pos bigint, link string, title string, categories array<string>, published string, published_ts bigint"

_RSS = "title string, link string, pubDate string, category array<string>"
_ATOM = "title string, link array<struct<_href:string,_rel:string>>, published string, updated string, category array<struct<_term:string,_label:string>>"
#: A whole feed: RSS has its items in a channel (or beside it), Atom its entries at the top.
_FEED = f"channel struct<item:array<struct<{_RSS.replace(' array', ':array').replace(' string', ':string')}>>>, item array<struct<{_RSS.replace(' array', ':array').replace(' string', ':string')}>>, entry array<struct<{_ATOM.replace(' array', ':array').replace(' string', ':string')}>>"


def rss_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of RSS files; a feed is named by its file."""
    return _of_files(spark.read.format("xml").option("rowTag", "item").schema(_RSS).load(path), "rss")


def atom_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom files; the link is the alternate one, else the first."""
    return _of_files(spark.read.format("xml").option("rowTag", "entry").schema(_ATOM).load(path), "atom")


def _of_files(rows: DataFrame, kind: str) -> DataFrame:
    feed = F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]+)?$", 1)
    return rows.select(feed.alias("feed"), F.monotonically_increasing_id().alias("pos"), F.struct(*rows.columns).alias("x")).select("feed", "pos", *_fields(F.col("x"), kind))


def feed_entries(bodies: DataFrame) -> DataFrame:
    """Entries of fetched feeds (feed, body), RSS or Atom, in the order of the feed; a body that is no XML has none."""
    parsed = bodies.select("feed", F.from_xml("body", _FEED, {"mode": "PERMISSIVE"}).alias("f"))
    rss = parsed.select("feed", F.posexplode(F.coalesce("f.channel.item", "f.item")).alias("pos", "x")).select("feed", F.col("pos").cast("long").alias("pos"), *_fields(F.col("x"), "rss"))
    atom = parsed.select("feed", F.posexplode("f.entry").alias("pos", "x")).select("feed", F.col("pos").cast("long").alias("pos"), *_fields(F.col("x"), "atom"))
    return rss.unionByName(atom)


def _fields(x: Column, kind: str) -> list[Column]:
    none = F.lit(None).cast("array<struct<term:string,label:string,name:string>>")
    if kind == "rss":
        link, published, categories = x["link"], x["pubDate"], x["category"]
    else:
        alternate = F.filter(x["link"], lambda y: F.coalesce(y["_rel"], F.lit("alternate")) == "alternate")
        link, published = F.coalesce(F.get(alternate, F.lit(0)), F.get(x["link"], F.lit(0)))["_href"], F.coalesce(x["published"], x["updated"])
        categories = F.transform(x["category"], lambda c: F.coalesce(c["_term"], c["_label"]))
    iso = F.unix_timestamp(F.try_to_timestamp(published))
    return [
        fn.strip(link).alias("link"), fn.strip(x["title"]).alias("title"), fn.categories(F.lit(None).cast("string"), categories, none).alias("categories"),
        published.alias("published"), F.coalesce(fn.entry_ts(published), iso).alias("published_ts"),
    ]


def candidates(entries: DataFrame, feeds: DataFrame, *, now: int, lookback: str = "", max_items: int = 8) -> DataFrame:
    """Entries to fetch: within the lookback, the newest of each feed, of fitting categories, with a link.

    A lookback that cannot be read is 0 seconds.  The categories are looked at after the cut to the newest.
    """
    since = None
    if lookback:
        since = now - entries.sparkSession.range(1).select(fn.lookback_seconds(F.lit(lookback))).first()[0]
    chosen = sel.category_filter(sel.newest_per_feed(entries, max_items, since=since), feeds)
    return chosen.where(fn.text(F.col("link")) != "").drop("rn")


# -- fetching ---------------------------------------------------------------


class FetchError(Exception):
    def __init__(self, status: int, retry_after: int | None = None, transient: bool = False):
        super().__init__(f"status {status}")
        self.status, self.retry_after, self.transient = status, retry_after, transient


def fetch_once(url: str, timeout: float = 20) -> str:
    """The page; 429 and 5xx are transient, other 4xx are not."""
    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": "presswerk"}), timeout=timeout) as answer:
            return answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace")
    except urllib.error.HTTPError as e:
        after = (e.headers.get("Retry-After") or "").strip()
        raise FetchError(e.code, int(after) if after.isdigit() else None, e.code == 429 or e.code >= 500) from e
    except (urllib.error.URLError, TimeoutError, ConnectionError) as e:
        raise FetchError(0, None, True) from e


def fetch_retrying(url: str, fetch: Callable[[str], str] = fetch_once, attempts: int = 6, sleep: Callable[[float], None] = time.sleep) -> tuple[str | None, int, str]:
    """(page, attempts used, error): transient errors are tried again, after at most 60 s as told, or a growing random wait up to 30 s."""
    for n in range(1, attempts + 1):
        try:
            return fetch(url), n, ""
        except FetchError as e:
            if not e.transient or n == attempts:
                return None, n, str(e)
            sleep(min(e.retry_after, 60) if e.retry_after else random.uniform(1, min(30, 2**n)))
    return None, attempts, "no attempt"


def fetch_pages(entries: DataFrame, *, rate: float = 6.0, parallel: int = 8, fetch: Callable[[str], str] = fetch_once, url_col: str = "link", into: str = "html") -> DataFrame:
    """``entries`` with the page, attempts, error.  ``parallel`` tasks share the rate; an error is a value, not a failed job."""

    def run(batches: Iterator[pd.DataFrame]):
        for pdf in batches:
            got = []
            for url in pdf[url_col]:
                start = time.monotonic()
                got.append(fetch_retrying(url, fetch))
                time.sleep(max(0.0, parallel / rate - (time.monotonic() - start)))
            yield pdf.assign(**{into: [g[0] for g in got], "attempts": [g[1] for g in got], "error": [g[2] for g in got]})

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in entries.schema)
    return entries.repartition(parallel).mapInPandas(run, f"{kinds}, `{into}` string, attempts int, error string")


def run(spark: SparkSession, config: dict, store: Store, *, now: int, base: str = ".", fetch: Callable[[str], str] = fetch_once, rate: float = 6.0, parallel: int = 8) -> dict[str, int]:
    """From the config's feeds to stored articles; gives counters.

    Feeds are fetched and parsed, their newest entries within the lookback and of
    fitting categories are fetched, and articles with enough text are upserted.
    A feed or page that cannot be fetched is counted and skipped.  What was
    fetched is written to the store's folder first, so that no page is fetched
    twice; the folder goes when the articles are stored.
    """
    own = config.get("ingest") or {}
    feeds = packages.feed_frame(spark, packages.feeds_of(config, base))
    landing = f"{store.root}/landing/{uuid.uuid4().hex}"

    def landed(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{landing}/{name}")
        return spark.read.parquet(f"{landing}/{name}")

    try:
        wanted = feeds.where(fn.text(F.col("url")) != "").select(F.col("name").alias("feed"), F.col("url").alias("link"))
        bodies = landed(fetch_pages(wanted, rate=rate, parallel=parallel, fetch=fetch, into="body"), "feeds")
        chosen = candidates(feed_entries(bodies.where("body is not null")), feeds, now=now, lookback=str(own.get("lookback") or ""), max_items=int(own.get("max_items_per_feed") or 8))
        pages = landed(extract_text(fetch_pages(landed(chosen, "entries"), rate=rate, parallel=parallel, fetch=fetch)).drop("html"), "pages")
        failed = {name: rows.where("error <> ''").count() for name, rows in (("feeds_failed", bodies), ("pages_failed", pages))}
        fine = pages.where("error = ''")
        articles = articles_of(fine, now)
        counts = store.upsert_articles(articles)
        return {"feeds": bodies.count(), "entries": pages.count(), **failed, "too_short": fine.count() - articles.count(), **counts}
    finally:
        fs, p = store._fs(landing)
        fs.delete(p, True)


# -- text -------------------------------------------------------------------

#: Elements whose content is no part of the text, and those that begin a line.
_DROPPED = frozenset("script style nav header footer aside table noscript template head".split())
_LINES = frozenset("p div br li ul ol h1 h2 h3 h4 h5 h6 section blockquote article main tr".split())


class _MainText(HTMLParser):
    """Reads a page once; remembers text outside dropped elements, and whether it is in an article."""

    def __init__(self, dropped: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.dropped, self.inside, self.articles = dropped, [], 0
        self.text: list[tuple[bool, str]] = []
        self.found = False

    def handle_starttag(self, tag, attrs):
        if tag in self.dropped:
            self.inside.append(tag)
        elif tag == "article":
            self.articles, self.found = self.articles + 1, True
        if tag in _LINES:
            self.text.append((self.articles > 0, "\n"))

    def handle_startendtag(self, tag, attrs):
        if tag in _LINES:
            self.text.append((self.articles > 0, "\n"))

    def handle_endtag(self, tag):
        if tag in self.inside:
            while self.inside.pop() != tag:
                pass
        if tag in _LINES:
            self.text.append((self.articles > 0, "\n"))
        if tag == "article":
            self.articles = max(0, self.articles - 1)

    def handle_data(self, data):
        if not self.inside:
            self.text.append((self.articles > 0, data))


def main_text(page: str | None) -> str:
    """Main text of a page: without scripts, navigation, tables and comments; of its articles if it has any; one line a block.

    An element of these that is never closed is read as text, as its end is unknown.
    """
    dropped = _DROPPED
    while True:
        parser = _MainText(dropped)
        parser.feed(page or "")
        parser.close()
        if not parser.inside:
            break
        dropped = dropped - set(parser.inside)
    whole = "".join(x for own, x in parser.text if own or not parser.found)
    return "\n".join(x for x in (" ".join(line.split()) for line in whole.split("\n")) if x)


def extract_text(pages: DataFrame, html_col: str = "html", into: str = "text") -> DataFrame:
    @F.pandas_udf("string")
    def texts(pages: pd.Series) -> pd.Series:
        return pages.map(main_text)

    return pages.withColumn(into, texts(F.col(html_col)))


def articles_of(fetched: DataFrame, now: int) -> DataFrame:
    """Articles of fetched entries with at least MIN_CHARS of text."""
    rows = (fetched if "text" in fetched.columns else extract_text(fetched)).where(F.length(fn.strip(F.col("text"))) >= MIN_CHARS)
    return rows.select(
        fn.stable_id(F.col("link")).alias("id"), F.col("link").alias("url"), F.col("feed").alias("source"), "title", F.col("published") if "published" in rows.columns else F.lit(None).cast("string").alias("published"),
        F.coalesce("published_ts", F.lit(0).cast("long")).alias("published_ts"), F.lit(now).cast("long").alias("fetched_at"), "text",
        fn.content_hash(F.col("title"), F.col("link"), F.col("text")).alias("content_hash"), (-F.col("pos")).alias("seq"),
    )


# -- legacy stores ----------------------------------------------------------


def json_store(spark: SparkSession, path: str, table: str) -> DataFrame:
    """(key, document JSON) of a table of a JSON file store."""
    whole = spark.read.option("wholetext", True).text(path)
    docs = whole.select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("t", "rows")).where(F.col("t") == table)
    return docs.select(F.explode("rows").alias("key", "doc_json"))


def sqlite_store(spark: SparkSession, path: str, table: str) -> DataFrame:
    """(key, document JSON) of a table of an SQLite file, read where the driver can see it."""
    import sqlite3

    if not table.isidentifier():
        raise ValueError(table)
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as db:
        rows = [(str(k), d) for k, d in db.execute(f"select rowid, doc_json from {table}")]
    return spark.createDataFrame(rows, "key string, doc_json string")


def documents_as(docs: DataFrame, kind) -> DataFrame:
    """Documents' fields as columns; broken JSON gives a row of nulls, as the row exists."""
    return docs.select(F.from_json("doc_json", kind, {"mode": "PERMISSIVE"}).alias("x")).select("x.*")
