"""Registered queries of the training-data operators, with their DuckDB SQL where SQL can express them."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import chosenpath, fertility, langid, licenses, lineblocks, mih, mixing, phrases, suffixes, toxicity, warc, wfst, whitening
from millrace.llm.common import table


#: Folder of the public tokenizers' vocabulary files; set it where they lie elsewhere.
TOKENIZERS = os.environ.get("MILLRACE_TOKENIZERS", "/opt/tokenizers")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trained = docs.where(toxicity.is_training_row(F.col("doc_id")))
    labels = table(spark, sf_dir, "labels").where(toxicity.is_training_row(F.col("doc_id")))
    model = toxicity.train(trained, labels)
    held_out = (~toxicity.is_training_row(F.col("doc_id"))).alias("held_out")
    return toxicity.score(docs, model).select("doc_id", held_out, "score", "predicted")


def op2_mih(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mih.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    machine = wfst.PieceTransducer.compile(f"{TOKENIZERS}/piece_bpe_32k.model")
    return wfst.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), machine).drop("text")


def op4_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(table(spark, sf_dir, "documents"))


def op5_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosenpath.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


def op6_fertility(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fertility.judge(table(spark, sf_dir, "documents"), f"{TOKENIZERS}/piece_bpe_32k.model")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"))


def op8_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineblocks.extract(table(spark, sf_dir, "pages"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_and_index(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.where(langid.is_training_row(F.col("doc_id"))))
    return langid.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", (~langid.is_training_row(F.col("doc_id"))).alias("held_out"), "lang_pred", "score", "rejected"
    )


def op11_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_mih": op2_mih,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_suffix_array": op4_suffix_array,
    "op5_chosen_path": op5_chosen_path,
    "op6_fertility": op6_fertility,
    "op7_mixing": op7_mixing,
    "op8_line_blocks": op8_line_blocks,
    "op9_warc": op9_warc,
    "op10_langid": op10_langid,
    "op11_licenses": op11_licenses,
    "op12_phrases": op12_phrases,
    "op13_whitening": op13_whitening,
}

SQL = {"op7_mixing": mixing.MIX_SQL.replace("{docs}", "documents"), "op9_warc": warc.SQL, "op11_licenses": licenses.sql(), "op12_phrases": phrases.SQL}
