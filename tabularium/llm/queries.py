"""The queries of this subpackage, each a thin use of its operator on whole tables, and the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabularium.llm import attention_lm, decontam, fill_middle, hilbert, lexical, license_scan, line_quality, packing, pii, secret_scan, simhash, tool_chat, warc
from tabularium.llm.common import new_path, read
from tabularium.llm.oracles import ORACLES  # noqa: F401


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


def op2_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_quality.verdicts(read(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(read(spark, sf_dir, "documents"))
    each = F.transform("matches", lambda x: F.concat_ws(":", x["license"], x["start"].cast("string"), x["end"].cast("string")))
    names = F.array_sort(F.array_distinct("matches.license"))
    return found.select("doc_id", F.size("matches").cast("long").alias("n_matches"), F.concat_ws(",", names).alias("licenses"), F.array_max("matches.coverage").alias("coverage"), F.concat_ws(",", each).alias("spans"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"), new_path(spark, "archive"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    named = F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), named, (F.col("n_hit") > 0).alias("contaminated"), F.concat_ws(",", "near").alias("near_items"))


def op6_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attention_lm.scored(read(spark, sf_dir, "documents"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(read(spark, sf_dir, "documents"))


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(read(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.scan(read(spark, sf_dir, "documents"))


def op10_tool_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = tool_chat.calls_of(read(spark, sf_dir, "conversations"))
    found = tool_chat.link(calls, results, tool_chat.TURN_SCHEMAS)
    return found.select(F.col("conv").cast("long").alias("conv_id"), F.col("call").alias("call_id"), "turn", "name", "level", "result_turn", "status", F.size("errors").cast("long").alias("n_errors"), F.sha2("record", 256).alias("record_sha256"))


def op11_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = hilbert.described(read(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang", "n_chars"))
    found = hilbert.sharded(docs, ["source", "lang", "n_chars", "doc_id"], 24, "rows", F.col("size"), ties=["text_hash", "doc_id"])
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "curve")


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fill_middle.examples(read(spark, sf_dir, "documents").select("doc_id", "text"))
    rebuilt = F.sha2(fill_middle.restored("form", "output"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), rebuilt.alias("restored_sha256"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.top_documents(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_line_quality": op2_line_quality,
    "op3_license_scan": op3_license_scan,
    "op4_warc": op4_warc,
    "op5_decontamination": op5_decontamination,
    "op6_attention_lm": op6_attention_lm,
    "op7_secret_scan": op7_secret_scan,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_pii": op9_pii,
    "op10_tool_chat": op10_tool_chat,
    "op11_hilbert_shards": op11_hilbert_shards,
    "op12_fill_middle": op12_fill_middle,
    "op13_lexical_search": op13_lexical_search,
}
