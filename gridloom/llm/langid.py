"""Language identification by hyperdimensional profiles: bound, permuted random letter vectors, bundled and compared by cosine."""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import give_back_memory, portions, small_batches

UNKNOWN = "und"
_BITS = 21  # of a code point; three make a trigram's code


def letter_table() -> np.ndarray:
    """The lower-case letter of each code point that is a letter; 0 for anything else."""
    out = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            out[cp] = ord(c.lower()[0])
    return out


def grams(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the trigrams of whole texts, one text after the other, and each one's text.

    Runs of anything but letters are one gap, and a text's ends are gaps. A trigram has a letter in its middle.
    """
    raw = "\x00".join(texts).encode("utf-32-le", "surrogatepass")
    s = np.concatenate([[0], table[np.frombuffer(raw, np.uint32)], [0]]).astype(np.int64)
    ends = np.cumsum([len(t) + 1 for t in texts])
    of = np.searchsorted(ends, np.arange(-1, len(s) - 1), side="right")
    keep = np.concatenate([[True], (s[1:] != 0) | (s[:-1] != 0)])
    s, of = s[keep], of[keep]
    if len(s) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mid = s[1:-1] != 0
    return ((s[:-2] << 2 * _BITS | s[1:-1] << _BITS | s[2:])[mid], of[1:-1][mid])


class Vectors:
    """n-gram vectors, made when first met: each letter's own random vector of +1 and -1, permuted by place and multiplied."""

    def __init__(self, dims: int, seed: int, most: int = 1 << 17):
        self.dims, self.seed, self.most = dims, seed, most
        self.letters: dict[int, np.ndarray] = {}
        self.forget()

    def forget(self) -> None:
        self.codes, self.place, self.rows = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, self.dims), np.int8)

    def letter(self, cp: int) -> np.ndarray:
        """The three places of a letter's vector (0: of a gap)."""
        if cp not in self.letters:
            v = (np.random.default_rng([self.seed, cp]).integers(0, 2, self.dims, np.int8) * 2 - 1).astype(np.int8)
            self.letters[cp] = np.stack([np.roll(v, 2), np.roll(v, 1), v])
        return self.letters[cp]

    def of(self, codes: np.ndarray) -> np.ndarray:
        """Rows of the vectors of distinct ascending codes. Beyond ``most`` n-grams, earlier ones are made again when they return."""
        if len(self.codes) > self.most:
            self.forget()
        at = np.minimum(np.searchsorted(self.codes, codes), max(0, len(self.codes) - 1))
        new = codes[self.codes[at] != codes] if len(self.codes) else codes
        if len(new):
            cps, which = np.unique(np.stack([new >> 2 * _BITS, new >> _BITS & (1 << _BITS) - 1, new & (1 << _BITS) - 1]), return_inverse=True)
            table, (a, b, c) = np.stack([self.letter(cp) for cp in cps.tolist()]), which.reshape(3, -1)
            made = table[a, 0] * table[b, 1] * table[c, 2]
            self.codes, self.place = np.concatenate([self.codes, new]), np.concatenate([self.place, np.arange(len(self.rows), len(self.rows) + len(new))])
            order = np.argsort(self.codes, kind="stable")
            self.codes, self.place, self.rows = self.codes[order], self.place[order], np.concatenate([self.rows, made])
            at = np.searchsorted(self.codes, codes)
        return self.place[at]

    def bundle(self, rows: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Sum of n-gram vectors by their counts; in blocks, so that many distinct ones take little memory."""
        out = np.zeros(self.dims, np.float64)
        for i in range(0, len(rows), 8192):
            out += counts[i : i + 8192].astype(np.float32) @ self.rows[rows[i : i + 8192]].astype(np.float32)
        return out


def learn_profiles(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", dims: int = 512, seed: int = 7) -> dict[str, np.ndarray]:
    """One prototype for each language: the bundle of all n-grams of its texts. Rows without text or language are passed over.

    Each task bundles its own rows by language, so that a frequent language is no hot key; sums of whole numbers are
    exact in any order. The driver gets ``dims`` numbers a language.
    """
    spark = labelled.sparkSession
    small_batches(spark)
    table = spark.sparkContext.broadcast(letter_table())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, sums = Vectors(dims, seed), {}

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([v.tolist() for v in sums.values()], pa.list_(pa.float64()))], ["lang", "v"])
            sums.clear()
            return out

        for b in batches:
            texts, langs, at = b.column(0).to_pylist(), b.column(1).to_pylist(), 0
            for part in portions(texts):
                codes, of = grams(part, table.value)
                names, lang = np.unique(langs[at : at + len(part)], return_inverse=True)
                distinct, place = np.unique(codes, return_inverse=True)
                rows, lang_of = vectors.of(distinct), lang[of]
                for k, name in enumerate(names.tolist()):
                    n = np.bincount(place[lang_of == k], minlength=len(distinct))
                    some = np.flatnonzero(n)
                    sums[name] = sums.get(name, 0) + vectors.bundle(rows[some], n[some])
                at += len(part)
            if len(sums) > 64:
                yield flush()
        if sums:
            yield flush()

    rows = labelled.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col), F.col(lang_col).cast("string"))
    parts = rows.mapInArrow(count, "lang string, v array<double>").select("lang", F.posexplode("v").alias("dim", "x"))
    out: dict[str, np.ndarray] = {}
    for r in parts.groupBy("lang", "dim").agg(F.sum("x").alias("x")).collect():
        out.setdefault(r.lang, np.zeros(dims))[r.dim] = r.x
    return out


def predict_language(docs: DataFrame, profiles: dict[str, np.ndarray], keep: list[Column | str], text_col: str = "text", dims: int = 512, seed: int = 7) -> DataFrame:
    """``keep`` columns of each row with lang_pred and score, the cosine to the nearest prototype, held to 0..1.

    A null text, one without letters, or no prototype gives ``und`` and 0; equal cosines go to the first language in
    order. Texts are read whole, however long, and only the text tells the language; repeated rows give repeated results, and
    columns of any name are carried.
    """
    spark = docs.sparkSession
    small_batches(spark)
    langs = sorted(profiles)
    unit = np.stack([profiles[x] / max(1e-12, float(np.linalg.norm(profiles[x]))) for x in langs]) if langs else np.zeros((0, dims))
    given = spark.sparkContext.broadcast((letter_table(), unit))
    names = docs.select(*keep).columns
    free = next(f"_text{i}" for i in itertools.count() if f"_text{i}" not in {n.lower() for n in names})
    rows = docs.select(*keep, F.col(text_col).alias(free))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]), "lang_pred string, score double"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors, (table, unit) = Vectors(dims, seed), given.value
        for b in batches:
            pred, score = [], []
            for part in portions([t or "" for t in b.column(len(names)).to_pylist()]):
                codes, of = grams(part, table)
                distinct, place = np.unique(codes, return_inverse=True)
                rows = vectors.of(distinct)
                for i, j in itertools.pairwise(np.searchsorted(of, np.arange(len(part) + 1)).tolist()):
                    if i == j or not langs:
                        pred.append(UNKNOWN)
                        score.append(0.0)
                        continue
                    own, n = np.unique(place[i:j], return_counts=True)
                    v = vectors.bundle(rows[own], n)
                    cos = unit @ v / max(1e-12, float(np.linalg.norm(v)))
                    k = int(np.argmax(cos))
                    pred.append(langs[k])
                    score.append(min(1.0, max(0.0, float(cos[k]))))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(names))), pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*names, "lang_pred", "score"])
        give_back_memory()

    return rows.mapInArrow(work, schema)
