"""I-Match document fingerprints with DataFrame functions only: a lexicon by document frequency, and randomised subsets of it."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from gridloom.llm.common import bloom_slots, pieces, saved

#: A level keeps 16 disjoint random subsets of the lexicon, each a share of 1 / (16, 64, ...) of it: long texts are told by the sparse levels.
LEVELS = (16, 64, 256, 1024, 4096)
SUBSETS, DIGITS, NONE = 16, 6, "------"
MOST_BITS = 1 << 23  # of a lexicon: 1 MB, a constant of the plan
UNLIMITED, PLAN_CHARS = "2147483632b", "100000"  # the setting's default, and what op4 sets in its place
_NO_TERM = 42  # xxhash64 of an empty array: its seed


def _hashed_words(text: Column) -> Column:
    return F.array_distinct(F.transform(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""), lambda w: F.xxhash64(w)))


class Lexicon:
    """The terms whose inverse document frequency lies in a band, as a bitmap in which each term has a bit.

    The band, idf from ln(1 / max_share) to ln(1 / min_share), is the same for any number of documents, and so is about the
    number of terms in it: those rarer than min_share stay out however many there are. Frequencies are exact, over all
    documents and for each 64-bit term hash. The bitmap has at least 32 bits a term, up to ``MOST_BITS``: it holds every term
    of the band, and takes at most one other of 32 for one of them (more past 262,144 terms). Which are taken depends on
    term and corpus alone, so equal texts always agree.
    """

    def __init__(self, docs: DataFrame, text_col: str = "text", min_share: float = 1e-5, max_share: float = 0.05, min_df: int = 2, most_bits: int = MOST_BITS):
        conf, key = docs.sparkSession.conf, "spark.sql.maxPlanStringLength"
        if conf.get(key) == UNLIMITED:  # the bitmap is part of plans, whose texts the driver keeps
            conf.set(key, PLAN_CHARS)
        n = docs.count()
        least = max(min_df, int(np.ceil(n * min_share)))
        terms = docs.select(F.explode(_hashed_words(F.coalesce(F.col(text_col), F.lit("")))).alias("t"))
        df = terms.groupBy("t").agg(F.count("*").alias("df"))
        held = saved(df.where(F.col("df").between(least, max(least, int(n * max_share)))).select("t"), "lexicon")
        self.bits = bloom_slots(held.count(), 32, most=most_bits)
        at = held.select(F.col("t").bitwiseAND(F.lit(self.bits - 1)).cast("int").alias("at"))
        longs = dict(at.groupBy(F.shiftright("at", 6).alias("k")).agg(F.expr("bit_or(shiftleft(1L, at & 63))").alias("bits")).collect())  # MOST_BITS / 64 rows at most
        self.longs = F.split(F.lit(",".join(str(longs.get(i, 0)) for i in range(self.bits // 64))), ",").cast("array<bigint>")

    def holds(self, t: Column) -> Column:
        at = t.bitwiseAND(F.lit(self.bits - 1)).cast("int")
        return F.getbit(F.element_at(self.longs, F.shiftright(at, 6) + 1), at.bitwiseAND(F.lit(63))) == 1


def with_fingerprint(df: DataFrame, text_col: str, lex: Lexicon, out: str, min_terms: int = 8) -> DataFrame:
    """Adds column ``out``: for each level and subset, six hex digits of the hash of the text's sorted distinct terms in it.

    A text with fewer than ``min_terms`` lexicon terms uses all its words, and one without words its own hash.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = df.withColumn("_all", _hashed_words(text))
    df = df.withColumn("_in", F.filter("_all", lex.holds))
    df = df.withColumn("_terms", F.sort_array(F.when(F.size("_in") >= min_terms, F.col("_in")).when(F.size("_all") > 0, F.col("_all")).otherwise(F.array(F.xxhash64(text)))))
    code = lambda t, i: F.shiftrightunsigned(t, 22 + 7 * i).bitwiseAND(F.lit(LEVELS[i] - 1))
    held_at = lambda i: F.filter("_terms", lambda t: code(t, i) < SUBSETS)
    df = df.withColumns({f"_c{i}": held_at(i) for i in range(1, len(LEVELS))} | {"_c0": F.col("_terms")})

    def level(i: int) -> Column:
        def subset(j: Column) -> Column:
            h = F.xxhash64(F.filter(f"_c{i}", lambda t: code(t, i) == j))
            return F.when(h == _NO_TERM, F.lit(NONE)).otherwise(F.right(F.lpad(F.hex(h), 16, "0"), F.lit(DIGITS)))

        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SUBSETS - 1)), subset), "")

    return df.withColumn(out, F.concat(*(level(i) for i in range(len(LEVELS))))).drop("_all", "_in", "_terms", *(f"_c{i}" for i in range(len(LEVELS))))


def likeness(a: str, b: str) -> Column:
    """0 to 1: 1 for equal fingerprints, else, at the level where it is largest, the share of equal subsets among those that hold a term of either."""
    part = lambda c, j: F.substr(F.col(c), j * DIGITS + 1, F.lit(DIGITS))

    def at(i: int) -> Column:
        seq = F.sequence(F.lit(i * SUBSETS), F.lit((i + 1) * SUBSETS - 1))
        same = F.size(F.filter(seq, lambda j: (part(a, j) == part(b, j)) & (part(a, j) != NONE)))
        used = F.size(F.filter(seq, lambda j: (part(a, j) != NONE) | (part(b, j) != NONE)))
        return same / F.greatest(used, F.lit(6))

    return F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(F.greatest(*(at(i) for i in range(len(LEVELS)))))


def in_order(docs: DataFrame, id_col: str, tie_col: str, carried: list[str], prepare=lambda df: df, per_bucket: int = 2 << 20, most_coarse: int = 1024, most_ranges: int = 1 << 16) -> DataFrame:
    """Adds to each row the ``carried`` columns, as next_*, of the row with the next larger id (after the last: of the first).

    ``prepare`` adds columns to rows before they are dealt. Rows that repeat an id are ordered by the hash of ``tie_col``.
    Rows are dealt by ranges of ids: quantiles, each cut evenly, so that one range has about ``per_bucket`` bytes of
    input; of ``most_ranges`` ranges each has what it must, and sorting it spills. Every range also gets a copy of the next
    range's first row, so that one window within ranges suffices; only these first ids pass the driver.
    """
    spark = docs.sparkSession
    n = min(pieces(spark, docs, per_bucket), most_ranges)
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        return _in_rank_order(docs, id_col, tie_col, carried, prepare, per_bucket, most_coarse, most_ranges)
    ids = docs.select(F.col(id_col).alias("id"))
    coarse = min(n, most_coarse)
    fine = -(-n // coarse)
    bounds = ids.agg(F.percentile_approx("id", [i / coarse for i in range(coarse + 1)], 20000)).first()[0] or [0, 0]
    bounds = sorted({int(x) for x in bounds})
    lows = F.array(*(F.lit(x).cast("long") for x in bounds))

    def bucket(c: Column) -> Column:
        k = F.size(F.filter(lows, lambda b: b <= c))
        lo, hi = F.element_at(lows, F.greatest(k, F.lit(1))), F.element_at(lows, F.least(k + 1, F.lit(len(bounds))))
        inner = F.when(hi > lo, F.least(F.lit(fine - 1), F.floor((c - lo).cast("double") / (hi - lo) * fine))).otherwise(0) if fine > 1 else F.lit(0)
        return F.when(c.isNull(), F.lit(-1).cast("long")).otherwise(k.cast("long") * fine + F.greatest(F.lit(0), inner))

    firsts = ids.groupBy(bucket(F.col("id")).alias("_b")).agg(F.min("id").alias("_first"))
    rows = docs.select(*docs.columns, bucket(F.col(id_col)).alias("_b"), F.lit(0).alias("_copy"))
    # A row for each range that has documents, most_ranges and a few at most: each begins where the one before it ends, and the last is followed by the first.
    begin = sorted(((r["_b"], r["_first"]) for r in firsts.collect()), key=lambda r: r[0])
    edges = spark.createDataFrame([(first, before) for (_, first), (before, _) in zip(begin, begin[-1:] + begin[:-1], strict=True)], f"_first {docs.schema[id_col].dataType.simpleString()}, _to long")
    copies = docs.join(F.broadcast(edges), F.col(id_col).eqNullSafe(F.col("_first"))).select(*docs.columns, F.col("_to").alias("_b"), F.lit(1).alias("_copy"))
    w = Window.partitionBy("_b").orderBy("_copy", F.col(id_col).asc_nulls_first(), "_tie")
    return prepare(rows.unionByName(copies)).withColumn("_tie", F.xxhash64(tie_col)).select("*", *(F.lead(c).over(w).alias(f"next_{c}") for c in carried)).where("_copy = 0").drop("_b", "_copy", "_tie")


def _in_rank_order(docs: DataFrame, id_col: str, tie_col: str, carried: list[str], prepare, per_bucket: int, most_coarse: int, most_ranges: int) -> DataFrame:
    """``in_order`` for ids of any type that can be sorted, by their ranks: distinct ids are dealt by ranges, numbered in each, and the numbers go to the rows."""
    ranged = saved(docs.select(F.col(id_col).alias("_id")).distinct().where("_id is not null").repartitionByRange("_id").withColumn("_part", F.spark_partition_id()), "ids")
    sizes = sorted((r["_part"], r["n"]) for r in ranged.groupBy("_part").agg(F.count("*").alias("n")).collect())  # a row for each range
    starts = dict(zip((p for p, _ in sizes), np.cumsum([0, *(n for _, n in sizes)]).tolist(), strict=False))
    start = F.element_at(F.array(*(F.lit(starts.get(p, 0)).cast("long") for p in range(max(starts, default=0) + 1))), F.col("_part") + 1)
    ranks = saved(ranged.select("_id", (start + F.row_number().over(Window.partitionBy("_part").orderBy("_id"))).alias("_rank")), "ranks")
    ranked = docs.join(ranks, F.col(id_col) == F.col("_id"), "left").drop("_id")
    return in_order(saved(ranked, "ranked"), "_rank", tie_col, carried, prepare, per_bucket, most_coarse, most_ranges).drop("_rank")


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_share: float = 1e-5, max_share: float = 0.05) -> DataFrame:
    """doc_id, text and fingerprint of every document. Null text counts as empty; equal texts have equal fingerprints."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return with_fingerprint(rows, "text", Lexicon(docs, text_col, min_share, max_share), "fingerprint")


def fingerprint_and_edit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_share: float = 1e-5, max_share: float = 0.05) -> DataFrame:
    """Fingerprints of each text and of its edited text, whose last quarter is the next document's beginning.

    Columns: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next. Null text
    counts as empty, very long texts are whole. Ids are of any type that can be sorted. Rows that repeat an id follow each other in an order fixed by their text; a null id comes first. A single
    row is its own next. Extra columns are ignored, whatever their names; an empty table gives an empty result.
    """
    lex = Lexicon(docs, text_col, min_share, max_share)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    dealt = in_order(rows, "doc_id", "text", ["text", "fingerprint"], lambda df: with_fingerprint(df, "text", lex, "fingerprint"))
    ordered = dealt.withColumns({"n_chars": F.char_length("text").cast("long"), "cut": F.floor(F.char_length("text") / 4).cast("int")})
    edited = ordered.withColumn("edited", F.concat(F.substr(F.col("text"), F.lit(1), (F.col("n_chars") - F.col("cut")).cast("int")), F.substr(F.col("next_text"), F.lit(1), F.col("cut"))))
    out = with_fingerprint(edited, "edited", lex, "edited_fingerprint")
    return out.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"))
