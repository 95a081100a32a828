"""The corpus pipeline: language, near-duplicates, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of ``docs``.  A stage works on all documents that the
stage before it kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswerk.llm import langid, minhash, packing, pii
from presswerk.llm.common import freeing_shuffles, stage, table

#: A text whose best language is less likely than this is rejected, as is one without letters.
LEAST_SCORE = 0.5


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language is certain, and sets ``lang`` to it where it is null.

    The model learns from the labelled documents of this input.  Rejected are
    null texts, texts without a letter, and those whose best language has a
    probability below LEAST_SCORE.  All rows of a rejected text go, so repeated
    rows are judged alike.
    """
    model = langid.fit(spark, docs)
    if not model.langs:
        return docs.limit(0)
    return langid.with_language(spark, docs, model, "__lang", "__score").where((F.col("__lang") != "und") & (F.col("__score") >= LEAST_SCORE)).withColumn("lang", F.coalesce("lang", "__lang")).drop("__lang", "__score")


@freeing_shuffles
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate group (five words, 0.8), that with the smallest doc_id.

    Rows that repeat a doc_id are one document: one of them stays.  Rows with a
    null doc_id cannot be told apart and stay.
    """
    judged = minhash.near_duplicates(spark, docs, size=5, num=80, den=100)
    dropped = stage(spark, judged.where("not kept and doc_id is not null").select("doc_id").distinct(), "dropped")
    kept = docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
    repeated = judged.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if repeated.isEmpty():
        return kept
    return kept.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(kept.where("doc_id is null"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the text by its kind in brackets and counts ``n_chars`` anew."""
    return pii.redact(spark, docs, pii.fit(spark, docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 tokens."""
    import public_tokenizers

    out = packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", redact_personal_data),
    ("packing", pack_sequences),
]

#: The language model, the tagger and the packer cannot be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over ``documents``; each is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, step) in enumerate(STAGES):
        docs = step(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = stage(spark, docs, name)
    return docs
