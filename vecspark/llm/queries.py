"""One query for each operator of this subpackage, over its whole table, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.session import fresh_path, ready
from . import warc
from ._text import pick
from ._tokenize import vocabulary
from .decontaminate import report
from .langid import evaluate
from .lines import dedup_lines
from .packing import pack_documents
from .quality import assess
from .simhash import near_duplicates
from .sql import SQL
from .substring import dedup
from .tokens import read_documents, write_tokens
from .urls import Rule, judge, stated


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(_table(spark, sf_dir, "documents"), window=50, keep_text=False).drop("kept_text")


def op2_rank_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate(_table(spark, sf_dir, "documents"))


def op3_token_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = fresh_path(ready(spark), "tokens")
    write_tokens(_table(spark, sf_dir, "documents"), path, vocabulary("word_bpe_49k.json"), end_id=1)
    return read_documents(spark, path)


def op4_simhash_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_table(spark, sf_dir, "documents"), shingle=3, bits=3)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return assess(pick(_table(spark, sf_dir, "documents"), doc_id="long", text="string")).drop("text")


def op6_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each record that the builder derives, as it is read back from WARC files, with digests for its block."""
    path = fresh_path(ready(spark), "warc")
    warc.write_warc(warc.derive(warc.responses(warc.distinct_pages(_table(spark, sf_dir, "pages")))), path, once=False)
    records = warc.read_warc(spark, path)
    named = lambda n: F.try_element_at(F.filter("headers", lambda h: h["name"] == n), F.lit(1))["value"]
    return records.select(F.col("source_id").alias("page_id"), "type", "record_id", "refers_to", named("WARC-Target-URI").alias("target_uri"), named("WARC-Date").alias("date"), named("WARC-Source-Payload-Digest").alias("source_digest"), named("WARC-Block-Digest").alias("block_digest"), F.octet_length("block").cast("long").alias("n_bytes"), F.sha2("block", 256).alias("block_sha256"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(_table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), capacity=2048, end_id=0)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = pick(_table(spark, sf_dir, "documents"), doc_id="long", text="string")
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    return dedup_lines(docs).select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_removed").alias("n_removed"), F.col("_n_near").alias("n_near"), kept)


URL_RULES = [Rule(False, "com", "/en/"), Rule(True, "example.com", "/en/7"), Rule(True, "net", "/de/"), Rule(False, "example.net", "/de/8"), Rule(False, "org", "/es/")]


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(_table(spark, sf_dir, "pages"), URL_RULES, stated(ready(spark)))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_rank_profiles, op3_token_codes, op4_simhash_bytes, op5_quality_rules, op6_warc_derivatives, op7_best_fit_packing, op8_decontamination, op9_line_dedup, op10_url_filters)}
