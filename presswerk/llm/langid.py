"""Language identification: known words first, character n-grams for the others."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from presswerk.llm.common import ChunkMemo, bound_batches, drop_state, give_back_memory, in_groups, worker_state

#: Bounds of the model: labelled rows it is fitted on (expected number), words, and n-grams of each length.
SAMPLE_ROWS, MAX_WORDS, MAX_GRAMS = 20_000, 60_000, 20_000
ORDERS = (4, 3, 2, 1)
#: Chunks that a task counts before it passes its counts on.
HELD_CHUNKS = 100_000
#: Words that count in full towards the score; a longer text's evidence is scaled to so many.
EVIDENCE = 24

_LETTERS = re.compile(r"[^\W\d_]+")


def words_of(chunk: str) -> list[str]:
    """Runs of letters."""
    found = _LETTERS.findall(chunk)
    if all(map(str.isalpha, found)):
        return found
    return [w for w in ("".join(c if c.isalpha() else " " for c in chunk)).split()]


def grams_of(word: str, n: int) -> list[str]:
    padded = f"<{word}>"
    return [padded[k : k + n] for k in range(len(padded) - n + 1)]


@dataclass
class LanguageModel:
    """log frequencies by language; rows of ``logs`` are named by ``words`` and, for each length, by ``grams``."""

    langs: list[str]
    words: dict[str, int]
    grams: dict[int, dict[str, int]]
    logs: np.ndarray

    @staticmethod
    def of(langs: list[str], counts: dict[int, dict[str, dict[str, int]]], totals: dict[tuple[int, str], int]) -> LanguageModel:
        """counts: for 0 (words) and each length: name -> language -> count; totals: of everything counted in the sample."""
        rows, names = [], {}
        for n in (0, *ORDERS):
            names[n] = {}
            size = len(counts.get(n, {})) + 1
            for name, by in counts.get(n, {}).items():
                names[n][name] = len(rows)
                rows.append([np.log((by.get(x, 0) + 0.2) / (totals.get((n, x), 0) + 0.2 * size)) for x in langs])
        return LanguageModel(langs, names[0], {n: names[n] for n in ORDERS}, np.array(rows, np.float64).reshape(len(rows), len(langs)))

    def rows_of(self, word: str) -> list[int]:
        """The known word, else its known n-grams of the greatest length that has any."""
        row = self.words.get(word)
        if row is not None:
            return [row]
        for n in ORDERS:
            names = self.grams[n]
            found = [names[g] for g in grams_of(word, n) if g in names]
            if found:
                return found
        return []

    def chunk_vectors(self, chunks: list[str]) -> list[bytes]:
        """For each chunk: the sum over its words of their mean log frequencies, and the number of words."""
        out = np.zeros((len(chunks), len(self.langs) + 1), np.float32)
        flat, sizes, owner = [], [], []
        for k, chunk in enumerate(chunks):
            for word in words_of(chunk):
                rows = self.rows_of(word)
                out[k, -1] += 1
                if rows:
                    flat += rows
                    sizes.append(len(rows))
                    owner.append(k)
        if flat:
            size = np.array(sizes)
            starts = np.concatenate([[0], np.cumsum(size)[:-1]])
            np.add.at(out[:, :-1], np.array(owner), (np.add.reduceat(self.logs[np.array(flat)], starts, axis=0) / size[:, None]).astype(np.float32))
        raw, step = out.tobytes(), 4 * (len(self.langs) + 1)
        return [raw[k : k + step] for k in range(0, len(raw), step)]

    def memo(self) -> ChunkMemo:
        return ChunkMemo(self.chunk_vectors)

    def predict(self, texts: list[str], memo: ChunkMemo | None = None) -> list[tuple[str, float]]:
        memo, width, out = self.memo() if memo is None else memo, len(self.langs) + 1, []
        for buffer in memo.buffers([x.lower().split() for x in texts]):
            total = np.frombuffer(buffer, np.float32).reshape(-1, width).sum(axis=0, dtype=np.float64)
            n = total[-1]
            if not n or width == 1:
                out.append(("und", 0.0))
                continue
            logit = total[:-1] * min(1.0, EVIDENCE / n)
            p = np.exp(logit - logit.max())
            best = int(p.argmax())
            out.append((self.langs[best], float(p[best] / p.sum())))
        return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(spark: SparkSession, labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> LanguageModel:
    """Counts words and n-grams of about ``sample_rows`` labelled rows, drawn by a hash of their id.

    Each task counts its rows, the counts are summed by key, and the most
    frequent words and n-grams make the model, MAX_WORDS and MAX_GRAMS of each
    length, among those that occur twice.  Rows with null id, text or lang are not
    used; repeated rows count each; other columns are not read.  An empty table
    gives a model without languages.
    """
    bound_batches(spark)
    rows = labelled.select(labelled[id_col].cast("string").alias("key"), labelled[text_col].alias("text"), labelled[lang_col].alias("lang")).where("text is not null and lang is not null and key is not null")
    share = min(1.0, sample_rows / max(1, rows.count()))
    drawn = rows.where(F.pmod(F.xxhash64("key", F.lit(5)), F.lit(1 << 20)) < int(share * (1 << 20))).select("lang", "text")

    def count(batches):
        drop_state()
        by: dict[str, dict[str, int]] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = by.setdefault(lang, {})
                for chunk in text.as_py().lower().split():
                    own[chunk] = own.get(chunk, 0) + 1
                if sum(map(len, by.values())) > HELD_CHUNKS:
                    yield from counted(by)
                    by = {}
        yield from counted(by)
        by = {}
        give_back_memory()

    def counted(by):
        for lang, chunks in by.items():
            totals: dict[tuple[int, str], int] = {}
            for chunk, c in chunks.items():
                for word in words_of(chunk):
                    totals[0, word] = totals.get((0, word), 0) + c
                    for n in ORDERS:
                        for g in grams_of(word, n):
                            totals[n, g] = totals.get((n, g), 0) + c
            if totals:
                kinds, names = zip(*totals)
                for at in range(0, len(names), 50_000):
                    cut = slice(at, at + 50_000)
                    values = list(totals.values())[cut]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values)), pa.array(kinds[cut], pa.int32()), pa.array(names[cut]), pa.array(values, pa.int64())], names=["lang", "n", "name", "c"])

    counts = drawn.mapInArrow(count, "lang string, n int, name string, c long").groupBy("lang", "n", "name").agg(F.sum("c").alias("c")).persist()
    try:
        totals = {(r["n"], r["lang"]): r["c"] for r in counts.groupBy("lang", "n").agg(F.sum("c").alias("c")).collect()}
        by_name = counts.groupBy("n", "name").agg(F.sum("c").alias("all"), F.map_from_entries(F.collect_list(F.struct("lang", "c"))).alias("by"))
        model: dict[int, dict[str, dict[str, int]]] = {}
        for n in (0, *ORDERS):
            top = by_name.where((F.col("n") == n) & (F.col("all") >= 2)).orderBy(F.desc("all"), "name").limit(MAX_GRAMS if n else MAX_WORDS)
            model[n] = {r["name"]: r["by"] for r in top.select("name", "by").collect()}
    finally:
        counts.unpersist()
    return LanguageModel.of(sorted({x for _, x in totals}), model, totals)


def predict(spark: SparkSession, docs: DataFrame, model: LanguageModel, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row, from its whole text alone.

    The language is one of the model's; ``und`` with score 0 if the text is null,
    has no letter, or the model knows no language.  Ties go to the first
    language in order.  Repeated rows give a row each; a null id stays null; an
    empty table gives no rows; other columns are not read.
    """
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batches):
        memo = _worker_memo(shared)
        for batch in batches:
            found = [p for texts in in_groups(batch.column(1)) for p in shared.value.predict(texts, memo)]
            langs, scores = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")


def with_language(spark: SparkSession, docs: DataFrame, model: LanguageModel, lang_to: str, score_to: str, *, text_col: str = "text") -> DataFrame:
    """``docs`` with two further columns, the language and its score, as ``predict`` gives them; the names must be new ones."""
    bound_batches(spark)
    shared, where = spark.sparkContext.broadcast(model), docs.columns.index(text_col)

    def run(batches):
        memo = _worker_memo(shared)
        for batch in batches:
            found = [p for texts in in_groups(batch.column(where)) for p in shared.value.predict(texts, memo)]
            langs, scores = zip(*found) if found else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, lang_to, score_to])

    kinds = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{lang_to}` string", f"`{score_to}` double"]
    return docs.mapInArrow(run, ", ".join(kinds))


def _worker_memo(shared) -> ChunkMemo:
    return worker_state(("language", id(shared.value)), lambda: shared.value.memo())
