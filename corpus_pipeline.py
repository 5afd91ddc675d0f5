"""A corpus pipeline of five stages, each over all that the one before it kept.

toxicity removes documents scored toxic; lines removes lines that many documents share; near_dedup keeps one document
of each group of near-duplicates; mixing repeats documents until the domains' expected tokens meet their targets, and
drops none; bpe encodes and decodes what is left. A stage gets only its predecessor's documents and the shared labels.

Every stage carries all columns of its documents through, whatever their names: a stage's own columns get names that are
free, and only n_tokens, ids_sha256 and decoded_sha256, which bpe returns, replace columns that are called so. Null and empty
texts count as empty in every stage and no stage drops them for it; empty tables give empty ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.bpe import bpe_encode
from gridloom.llm.common import bloom_slots, free_name, id_filter, saved, set_aside
from gridloom.llm.line_dedup import dedup_lines
from gridloom.llm.minhash import near_duplicates
from gridloom.llm.mixing import mixing_rates, quality_domains, repeat_by_rate
from gridloom.llm.queries import tokenizer_path, toxicity_held_out
from gridloom.llm.toxicity import fit_toxicity, score_toxicity

TOXIC_FROM = 0.3
NEAR_WORDS, NEAR_PERCENT = 5, 80
LINE_CHARS, LINE_DOCS = 40, 5
TARGETS = {"good": 0.8, "poor": 0.2}  # of tokens after mixing, which are as many more than before as that takes


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored under TOXIC_FROM, by a model of the labelled ones among them.

    Each row is scored by its text alone, so repeated rows share their fate. Without labels of both kinds all scores are
    alike (see ``fit_toxicity``); documents with a null id are scored as any others but teach nothing.
    """
    model, score = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~toxicity_held_out()), free_name(docs, "_toxic")
    return score_toxicity(docs, model, out=score).where(F.col(score) < TOXIC_FROM).drop(score)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that LINE_DOCS or more share, but for one holder of each; n_chars follows the text.

    Every row is a document, so a row given five times shares its lines with itself; rows of the largest id keep them.
    """
    docs, own = set_aside(docs, ["_n_lines", "_n_dropped"])
    out = dedup_lines(docs, min_chars=LINE_CHARS, min_docs=LINE_DOCS)
    out = out.withColumn("n_chars", F.when(F.col("_n_dropped") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*own(out))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the one with the least id. Documents without words are all kept.

    Rows of one id are one document, whatever their texts (see ``near_duplicates``): they all stay or all go. Null ids stay.
    """
    found = near_duplicates(docs, k=NEAR_WORDS, percent=NEAR_PERCENT)
    dropped = saved(found.where(~F.col("kept")).select("doc_id").distinct(), "near-dropped")
    maybe = F.coalesce(id_filter(dropped, bloom_slots(dropped.count()))(F.col("doc_id")), F.lit(False))
    held = docs.where(maybe).join(dropped.hint("merge"), "doc_id", "left_anti").select(docs.columns)
    return docs.where(~maybe).unionByName(held)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document at least once, and more often as the targets ask. Rows of one id and text are repeated alike."""
    docs, own = set_aside(docs, ["_tokens", "_posteriors", "_rate"])
    domains = quality_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = repeat_by_rate(mixing_rates(docs, domains, TARGETS, scale=None, floor=1.0))
    return out.select(*own(out))


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokens of each document, and digests of them and of the text decoded from them; an empty text has none."""
    docs, own = set_aside(docs.drop("n_tokens", "ids_sha256", "decoded_sha256"), ["ids", "decoded"])
    out = bpe_encode(docs, tokenizer_path(), decode=True, cache_words=40_000)  # workers also hold what earlier stages left
    return out.select(*own(out), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("toxicity", toxicity), ("lines", lines), ("near_dedup", near_dedup), ("mixing", mixing), ("bpe", bpe)]

#: SQL cannot express the models, MinHash and BPE; tests/llm/test_pipeline.py compares every stage with a slow version of it on the same input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
