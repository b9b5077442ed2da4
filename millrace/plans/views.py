"""Views over the given tables in the shapes that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.geo import haversine_m
from millrace.functions.text import norm_domain

CENTER = (59.914403, 30.327319)


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def micros(ts):
    """Microseconds since 1970 of a time without zone."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)


def k_of(props):
    return F.get_json_object(props, "$.k")


def items(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(
        F.col("event_type").alias("source"),
        F.concat(F.col("user_id").cast("string"), F.lit("-"), k_of("props")).alias("id"),
        F.concat("event_type", F.lit(" "), "props").alias("title"),
        "user_id",
        "value",
        micros(F.col("ts")).alias("us"),
        F.col("event_id").alias("ord"),
    )


def run_results(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(
        F.col("event_id").alias("run"),
        F.col("event_type").alias("name"),
        (F.col("value") > 50).alias("ok"),
        (F.col("value") / 10).alias("seconds"),
        k_of("props").cast("long").alias("organic"),
        (1 + F.col("user_id") % 4).alias("attempts"),
    )


def log(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "events").select(
        F.col("event_id").alias("line"),
        F.col("user_id").alias("worker"),
        F.col("event_type").alias("bucket"),
        (micros(F.col("ts")) / 1e6).alias("t"),
        "value",
    )


def gigs(spark: SparkSession, d: str) -> DataFrame:
    part = read(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_name")
    return (
        read(spark, d, "lineitem")
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
            F.round("l_extendedprice").cast("long").alias("price"),
            F.col("p_brand").alias("leaf"),
            F.col("p_type").alias("parent"),
            F.col("l_suppkey").alias("seller"),
            (F.round(F.col("l_quantity") * 6).cast("long") - 6).alias("reviews"),
            F.col("p_name").alias("gtitle"),
            F.col("l_returnflag").alias("level"),
        )
    )


def orgs(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "customer").select(
        F.col("c_custkey").alias("oid"),
        F.col("c_name").alias("title"),
        F.col("c_mktsegment").alias("category"),
        F.col("c_nationkey").alias("nation"),
        (F.lit(CENTER[0]) + ((F.col("c_custkey") * 7919) % 601 - 300) * 1e-4).alias("lat"),
        (F.lit(CENTER[1]) + ((F.col("c_custkey") * 104729) % 1201 - 600) * 1e-4).alias("lon"),
    )


def org_dist(spark: SparkSession, d: str) -> DataFrame:
    o = orgs(spark, d)
    return o.withColumn("dist", haversine_m(F.lit(CENTER[0]), F.lit(CENTER[1]), F.col("lat"), F.col("lon")))


def sightings(spark: SparkSession, d: str) -> DataFrame:
    line = read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber")
    order = read(spark, d, "orders").select("o_orderkey", "o_custkey")
    customer = read(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return (
        line.join(order, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("sid"),
            (F.col("l_orderkey") % 9 - 4).alias("i"),
            (F.col("l_partkey") % 9 - 4).alias("j"),
            F.col("o_custkey").alias("oid"),
            (F.col("l_linenumber") * 5).alias("rank"),
            F.col("c_mktsegment").alias("category"),
        )
    )


EMAIL = r"[\p{L}\p{N}._+-]+@[\p{L}\p{N}-]+\.[\p{L}\p{N}.-]+"
PHONE = r"\+?[0-9][0-9() -]{8,}[0-9]"
LINK = r"https?://[^ \n]+"


def cards(spark: SparkSession, d: str) -> DataFrame:
    labels = read(spark, d, "labels")
    docs = read(spark, d, "documents")
    found = lambda p, n: F.coalesce(F.regexp_count("text", F.lit(p)), F.lit(0)).cast("long").alias(n)
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("oid"),
        F.col("source").alias("zone"),
        "text",
        "n_chars",
        F.col("quality").alias("score"),
        "toxic",
        found(EMAIL, "emails"),
        found(PHONE, "phones"),
        found(LINK, "links"),
    )


def arms(spark: SparkSession, d: str) -> DataFrame:
    return (
        read(spark, d, "lineitem")
        .where(F.col("l_returnflag").isin("A", "R"))
        .groupBy(F.col("l_partkey").alias("key"), F.col("l_returnflag").alias("arm"))
        .agg(
            F.round(F.sum("l_quantity")).cast("long").alias("m1"),
            F.count("*").alias("m2"),
            F.round(F.sum(F.col("l_tax") * 100)).cast("long").alias("m3"),
        )
    )


def turns(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "conversations").select(
        F.col("conv_id").alias("run"),
        "turn",
        F.col("role").alias("kind"),
        "text",
        F.substring(F.sha2(F.coalesce("text", F.lit("")), 256), 1, 1).alias("host"),
    )


def pages(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "pages").select("page_id", "url", "html", norm_domain(F.col("url")).alias("domain"))


def texts(spark: SparkSession, d: str) -> DataFrame:
    keyed = lambda t, prefix, key, text: read(spark, d, t).select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("key"), F.col(text).alias("text"))
    return keyed("documents", "d", "doc_id", "text").unionByName(keyed("customer", "c", "c_custkey", "c_name")).unionByName(keyed("part", "p", "p_partkey", "p_name"))
