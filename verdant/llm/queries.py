"""Registered queries of the text operators: each applies one operator with its
production parameters to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdant.llm.common import ship, table
from verdant.llm.decontaminate import contamination
from verdant.llm.dialogues import repair_report
from verdant.llm.infill import fill_in_middle, restored
from verdant.llm.licenses import license_scan
from verdant.llm.lines import duplicate_lines
from verdant.llm.mixing import mix
from verdant.llm.near_duplicates import near_duplicate_classes
from verdant.llm.packing import pack_tokens
from verdant.llm.quality import quality
from verdant.llm.secrets import secret_scan
from verdant.llm.sketches import sketched_duplicates
from verdant.llm.substrings import repeated_passages
from verdant.llm.toxicity import fit, in_held_out, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = lambda spark, sf_dir: f(ship(spark), sf_dir)
    return f


@query
def op1_secret_scan(spark, sf_dir):
    return secret_scan(table(spark, sf_dir, "documents")).drop("found")


@query
def op2_substring_dedup(spark, sf_dir):
    return repeated_passages(table(spark, sf_dir, "documents")).drop("spans")


@query
def op3_ngram_jaccard_join(spark, sf_dir):
    return near_duplicate_classes(table(spark, sf_dir, "documents")).drop("is_head")


@query
def op8_benchmark_decontamination(spark, sf_dir):
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_line_dedup(spark, sf_dir):
    return duplicate_lines(table(spark, sf_dir, "documents"))


@query
def op5_source_mixing(spark, sf_dir):
    return mix(table(spark, sf_dir, "documents"))


@query
def op6_quality_outliers(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"))


@query
def op7_packed_tokens(spark, sf_dir):
    packed = pack_tokens(table(spark, sf_dir, "documents"))
    return packed.select("pack_id", "n_tokens", "doc_ids", "starts", "cu_seqlens",
                         F.sha2("input_ids", 256).alias("ids_sha256"),
                         F.sha2("position_ids", 256).alias("positions_sha256"))


@query
def op9_license_scan(spark, sf_dir):
    """A table without paths gets each document's own license only: no path is invented."""
    docs = table(spark, sf_dir, "documents")
    path = F.col("path") if "path" in docs.columns else F.lit(None).cast("string")
    return license_scan(docs.select("doc_id", "text", path.alias("path")))


@query
def op10_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"), held_out=in_held_out)
    return toxicity(docs, model).select("doc_id", in_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op11_fill_in_middle(spark, sf_dir):
    cut = fill_in_middle(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                      F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


@query
def op12_conversation_repair(spark, sf_dir):
    return repair_report(table(spark, sf_dir, "conversations"))


@query
def op13_sketched_duplicates(spark, sf_dir):
    return sketched_duplicates(table(spark, sf_dir, "documents"))
