"""A training corpus from documents: language, near copies, repeated passages, source mix, token ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm import chosenpath, langid, mixing, suffixes, wfst
from millrace.llm.common import materialise, shared_dir, table
from millrace.llm.queries import TOKENIZERS

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language a model of the labelled ones recognises; the others (no letters, or below its rejection level)
    go, and so do rows with null or empty texts.  Rows without doc_id and repeated rows stay; further columns are left out."""
    model = langid.train(docs)
    return langid.predict(docs.select(*COLUMNS), model).where("NOT rejected").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that with the smallest doc_id.  Of rows that share a doc_id one stays, among those
    that no document with a smaller id stands for, that whose text has the smallest hash.  Rows without doc_id stay."""
    near = chosenpath.near_duplicates(docs)
    again = docs.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select("doc_id")
    near, again = materialise(near.select("doc_id", "text_hash", "kept")), materialise(again)
    docs = docs.select(*COLUMNS)
    once = docs.join(near.where("NOT kept").select("doc_id").distinct(), "doc_id", "left_anti").select(*COLUMNS)
    if again.isEmpty():
        return once
    of_id = Window.partitionBy("doc_id").orderBy("text_hash")
    best = near.where("kept").join(again, "doc_id", "left_semi").withColumn("nth", F.row_number().over(of_id)).where("nth = 1").drop("nth", "kept")
    rows = docs.join(again, "doc_id", "left_semi").withColumn("text_hash", F.xxhash64("text")).join(best, ["doc_id", "text_hash"]).dropDuplicates(["doc_id"])
    return once.join(again, "doc_id", "left_anti").select(*COLUMNS).unionByName(rows.select(*COLUMNS))


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of 100 bytes or more that occur earlier; documents of which nothing is left go.  Null texts become
    empty; rows without doc_id stay as they are."""
    kept = suffixes.remove_repeats(docs, with_text=True, carry=("lang", "source")).where("n_removed = 0 OR n_removed < n_bytes")
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.char_length("kept_text").cast("long").alias("n_chars"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it; a null source is one of its own, texts without words are not taken."""
    return mixing.apply_mix(docs.select(*COLUMNS))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of each document, and whether decoding gives its text back; every row stays."""
    machine = wfst.PieceTransducer.compile(f"{TOKENIZERS}/piece_bpe_32k.model")
    return wfst.encode(docs.select("doc_id", "source", "lang", "text"), machine).drop("text")


STAGES = [
    ("language_id", identify_language),
    ("minhash_near_dedup", drop_near_copies),
    ("suffix_array_dedup", drop_repeats),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode_pieces),
]

#: Several stages (a trained model, passages, piece ids) are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
