"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from presswerk.llm import chat, topk, urls, warc
from presswerk.llm.common import table


def op1_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from presswerk.llm.pivots import near_duplicates

    return near_duplicates(spark, table(spark, sf_dir, "embeddings"))


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from presswerk.llm.topk import search

    return search(spark, table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from presswerk.llm.packing import pack

    out = pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return out.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document, and whether they decode to its text."""
    import public_tokenizers

    from presswerk.llm.pieces import decode, encode

    model = public_tokenizers.path("piece_bpe_32k.model")
    out = decode(spark, encode(spark, table(spark, sf_dir, "documents"), model), model)
    same = F.coalesce("text", F.lit("")) == F.col("decoded")
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_ids"), F.crc32("ids").alias("ids_crc32"), F.octet_length("decoded").cast("long").alias("decoded_bytes"), same.alias("round_trip"))


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from presswerk.llm.langid import fit, held_out, predict

    docs = table(spark, sf_dir, "documents")
    model = fit(spark, docs.where(~held_out(docs["doc_id"])))
    return predict(spark, docs, model).withColumn("held_out", held_out(F.col("doc_id")))


def op6_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from presswerk.llm.minhash import near_duplicates

    return near_duplicates(spark, table(spark, sf_dir, "documents"), size=3, num=85, den=100)


def op7_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    from presswerk.llm.chat import maximal_conversations

    return maximal_conversations(table(spark, sf_dir, "conversations"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    from presswerk.llm.urls import feed_list, judge

    pages = table(spark, sf_dir, "pages")
    return judge(spark, pages, feed_list(pages))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from presswerk.llm.pii import detect, digest, fit

    docs = table(spark, sf_dir, "documents")
    return digest(detect(spark, docs, fit(spark, docs)))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from presswerk.llm.warc import round_trip

    return round_trip(spark, table(spark, sf_dir, "pages"))


QUERIES = {
    "op1_pivots": op1_pivots,
    "op2_topk": op2_topk,
    "op3_packing": op3_packing,
    "op4_pieces": op4_pieces,
    "op5_langid": op5_langid,
    "op6_minhash": op6_minhash,
    "op7_chat": op7_chat,
    "op8_urls": op8_urls,
    "op9_pii": op9_pii,
    "op10_warc": op10_warc,
}
ORACLES: dict[str, str] = {"op2_topk": topk.ORACLE, "op7_chat": chat.ORACLE, "op8_urls": urls.oracle(), "op10_warc": warc.ORACLE}
