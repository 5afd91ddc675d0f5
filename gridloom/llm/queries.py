"""The registered query of each operator of this package, with production parameters, and its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.align import align_tokenizers
from gridloom.llm.bpe import bpe_encode
from gridloom.llm.exact_dedup import exact_dedup
from gridloom.llm.imatch import fingerprint_and_edit
from gridloom.llm.langid import learn_profiles, predict_language
from gridloom.llm.line_dedup import dedup_lines
from gridloom.llm.minhash import near_duplicates
from gridloom.llm.mixing import mixing_rates, quality_domains
from gridloom.llm.ngram_lm import score_documents
from gridloom.llm.prefix_trie import lend_heads, number_turns, prefix_trie
from gridloom.llm.sharding import pack_shards
from gridloom.llm.toxicity import fit_toxicity, score_toxicity
from gridloom.llm.warc import warc_round_trip


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(_documents(spark, sf_dir))


OP1_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc_round_trip(pages, min_bytes=0).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), k=4, percent=80)


OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
sym AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
walk(doc_id, other) AS (SELECT doc_id, doc_id FROM documents UNION SELECT walk.doc_id, sym.b FROM walk JOIN sym ON sym.a = walk.other),
least_of AS (SELECT doc_id, min(other) AS component_id FROM walk GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least_of LEFT JOIN sizes USING (doc_id)
"""


def op4_imatch_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint_and_edit(_documents(spark, sf_dir))


def op5_ngram_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = _documents(spark, sf_dir), F.crc32(F.col("doc_id").cast("string")) % 10 == 0
    out = score_documents(docs, ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


MIX_TARGETS = {"good": 0.75, "poor": 0.25}


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, tokens, the posterior of each domain and the rate that brings the domains' expected tokens to MIX_TARGETS."""
    domains = quality_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = mixing_rates(_documents(spark, sf_dir).select("doc_id", "text"), domains, MIX_TARGETS)
    return out.select("doc_id", F.col("_tokens").alias("tokens"), *(F.element_at("_posteriors", i + 1).alias(f"p_{d}") for i, d in enumerate(MIX_TARGETS)), F.col("_rate").alias("rate"))


def tokenizer_path() -> str:
    """Where the public vocabulary file is installed."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe_encode(_documents(spark, sf_dir).select("doc_id", "text"), tokenizer_path(), decode=True)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def toxicity_held_out():
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    model = fit_toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), ~toxicity_held_out())
    out = score_toxicity(docs, model)
    return out.select("doc_id", toxicity_held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(_documents(spark, sf_dir).select("doc_id", "text"), min_chars=40, min_docs=5)
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = r"""
WITH split AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)),
common AS (
  SELECT key, max(doc_id) AS keep FROM split WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
marked AS (
  SELECT s.doc_id, s.pos, s.line, c.key IS NOT NULL AND s.doc_id <> c.keep AS lost FROM split s LEFT JOIN common c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = (F.crc32(F.col("doc_id").cast("string")) % 4 == 2).alias("held_out")
    docs = _documents(spark, sf_dir)
    profiles = learn_profiles(docs.where(~held_out))
    return predict_language(docs, profiles, ["doc_id", held_out])


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*lend_heads(number_turns(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


OP11_SQL = """
WITH said AS (
  SELECT conv_id, turn, sha256(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, ''))) AS said, length(coalesce(text, '')) AS n
  FROM conversations WHERE conv_id IS NOT NULL),
turns AS (SELECT conv_id, said, n, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, said) AS depth FROM said),
own AS (SELECT conv_id, max(depth) AS own FROM turns GROUP BY conv_id),
convs AS (
  SELECT conv_id, own, conv_id - conv_id % 100 AS lender,
         xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
           lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, (x & 1) * 3988292384))), 4294967295) % 6 AS h
  FROM own),
sized AS (
  SELECT c.conv_id, c.lender, c.h, least(c.h, coalesce(l.own, 0)) AS took, least(c.h, coalesce(l.own, 0)) + greatest(c.own - c.h, 0) AS turns
  FROM convs c LEFT JOIN own l ON l.conv_id = c.lender),
rebuilt AS (
  SELECT s.conv_id, t.depth, t.said, t.n FROM sized s JOIN turns t ON t.conv_id = s.lender AND t.depth <= s.h
  UNION ALL SELECT s.conv_id, t.depth - s.h + s.took, t.said, t.n FROM sized s JOIN turns t ON t.conv_id = s.conv_id AND t.depth > s.h),
prefixes AS (
  SELECT conv_id, depth, n, string_agg(said, '') OVER (PARTITION BY conv_id ORDER BY depth) AS prefix FROM rebuilt
  UNION ALL SELECT conv_id, 0, 0, '' FROM sized),
nodes AS (
  SELECT p.prefix, p.depth, min(p.conv_id) AS conv_id, count(*) AS n_convs, max(p.n) AS n,
         sha256(coalesce(string_agg(p.conv_id::VARCHAR, ',' ORDER BY p.conv_id) FILTER (p.depth = s.turns), '')) AS ends_sha256
  FROM prefixes p JOIN sized s ON s.conv_id = p.conv_id GROUP BY p.prefix, p.depth),
linked AS (
  SELECT v.*, u.conv_id AS parent_conv_id, (SELECT count(*) FROM nodes c WHERE c.depth > 0 AND left(c.prefix, 64 * (c.depth - 1)) = v.prefix AND c.depth = v.depth + 1) AS n_children
  FROM nodes v LEFT JOIN nodes u ON v.depth > 0 AND u.depth = v.depth - 1 AND u.prefix = left(v.prefix, 64 * (v.depth - 1))),
sums AS (
  SELECT p.prefix, p.depth, count(*) FILTER (v.n_children = 0) AS n_leaves, sum((v.n_convs - 1) * v.n)::BIGINT AS saved_tokens
  FROM linked v JOIN prefixes p ON p.conv_id = v.conv_id AND p.depth <= v.depth GROUP BY p.prefix, p.depth)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256 FROM linked JOIN sums USING (prefix, depth)
"""


def op12_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_shards(_documents(spark, sf_dir))


def piece_path() -> str:
    """Where the public sentencepiece model is installed."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(_documents(spark, sf_dir), tokenizer_path(), piece_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_exact_dedup": op1_exact_dedup, "op2_warc": op2_warc, "op3_minhash": op3_minhash, "op4_imatch_fingerprint": op4_imatch_fingerprint, "op5_ngram_lm": op5_ngram_lm, "op6_mixing": op6_mixing, "op7_bpe": op7_bpe, "op8_toxicity": op8_toxicity, "op9_line_dedup": op9_line_dedup, "op10_language": op10_language,
            "op11_prefix_trie": op11_prefix_trie, "op12_vector_packing": op12_vector_packing, "op13_alignment": op13_alignment}


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1_SQL, "op3_minhash": OP3_SQL, "op9_line_dedup": OP9_SQL, "op11_prefix_trie": OP11_SQL}
