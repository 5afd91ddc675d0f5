"""Toxicity by class-conditional Kneser-Ney models of how words are spelt, compared by length-normalised log-likelihoods.

Two letter models, of toxic and of ordinary documents, share the counts of their lower orders, so that a rare
expression is judged by its stem. A document's evidence is the log-likelihood ratio of its words, normalised by length:
over the whole text, over its most toxic passage, and over its most toxic words. A logistic function, fitted on
documents that their own models have not seen, turns it into a score.
"""

from __future__ import annotations

import pickle
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import give_back_memory, portions, saved, small_batches

_WORD = re.compile(r"[^\W_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
TOP = 8  # letters of the highest order, a word's begin among them
PASSAGE = 12
LONGEST_WORD = 64
FEATURES = 7


def words(text: str) -> list[str]:
    """Lower-cased runs of letters and digits of the whole text; very long runs are cut into words of ``LONGEST_WORD``."""
    out = _WORD.findall(text.lower())
    if any(len(w) > LONGEST_WORD for w in out):
        out = [w[i : i + LONGEST_WORD] for w in out for i in range(0, len(w), LONGEST_WORD)]
    return out


class _Letters:
    """The letters of a list of words, each word between its begin and its end."""

    def __init__(self, vocabulary: list[str]):
        self.code = np.frombuffer("".join(["\x02" + w + "\x03" for w in vocabulary]).encode("utf-32-le", "surrogatepass"), np.uint32)
        begin = self.code == 2
        self.word = (np.cumsum(begin) - 1).astype(np.int32)
        self.place = (np.arange(len(self.code)) - np.flatnonzero(begin)[self.word]).astype(np.int32)
        self.at = np.flatnonzero(~begin)

    def longer(self, at: np.ndarray, h: np.ndarray, k: int) -> np.ndarray:
        """From hashes of the last k letters up to each place those of the last k + 1; before a word's begin there is nothing."""
        place = self.place[at]
        letter = np.where(place >= k, self.code[at - np.minimum(k, place)], 0).astype(np.uint64)
        h = (h ^ letter) * _MIX[0]
        return h ^ (h >> np.uint64(29))

    def ending(self, at: np.ndarray, n: int, part: int = 1 << 18) -> np.ndarray:
        """Hash of the last n letters up to each place."""
        out = np.ones(len(at), np.uint64)
        for i in range(0, len(at), part):
            for k in range(n):
                out[i : i + part] = self.longer(at[i : i + part], out[i : i + part], k)
        return out


class _Table:
    """Values by hash, by open addressing (made when it is first asked); 0 where it has none. No hash is 0."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.given: tuple[np.ndarray, np.ndarray] | None = keys, values  # keys ascend

    def __getstate__(self) -> bytes:
        """As small as it can travel: hashes as differences, and values, in byte planes."""
        if self.given is not None:
            keys, values = self.given
        else:
            held = np.flatnonzero(self.keys)
            held = held[np.argsort(self.keys[held])]
            keys, values = self.keys[held], np.ascontiguousarray(self.values[:, self.row[held]])
        gaps = np.diff(keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T
        parts = np.ascontiguousarray(values).view(np.uint8).reshape(-1, 4).T
        raw = struct.pack("<II", len(keys), len(values)) + np.ascontiguousarray(gaps).tobytes() + np.ascontiguousarray(parts).tobytes()
        return zstandard.ZstdCompressor(level=3).compress(raw)

    def __setstate__(self, state: bytes) -> None:
        raw = zstandard.ZstdDecompressor().decompress(state)
        n, width = struct.unpack_from("<II", raw)
        gaps, parts = (np.frombuffer(raw, np.uint8, size, at) for size, at in ((8 * n, 8), (4 * n * width, 8 + 8 * n)))
        keys = np.cumsum(np.ascontiguousarray(gaps.reshape(8, n).T).reshape(-1).view(np.uint64), dtype=np.uint64)
        self.given = keys, np.ascontiguousarray(parts.reshape(4, -1).T).reshape(-1).view(np.float32).reshape(width, n)
        self.open()

    def open(self) -> None:
        if self.given is None:
            return
        (keys, values), self.given = self.given, None
        self.bits = max(4, int(np.ceil(np.log2(1.5 * max(1, len(keys))))))
        size = 1 << self.bits
        self.keys, self.row = np.zeros(size, np.uint64), np.zeros(size, np.int32)
        todo, at = np.arange(len(keys)), self._place(keys)
        while len(todo):
            free = self.keys[at[todo]] == 0
            first = np.zeros(len(todo), bool)
            first[np.unique(at[todo], return_index=True)[1]] = True
            put = todo[free & first]
            self.keys[at[put]], self.row[at[put]] = keys[put], put + 1
            todo = todo[~(free & first)]
            at[todo] = (at[todo] + 1) & (size - 1)
        self.values = np.concatenate([np.zeros((len(values), 1), np.float32), values], 1)

    def _place(self, h: np.ndarray) -> np.ndarray:
        return (h >> np.uint64(64 - self.bits)).astype(np.int64)

    def rows(self, h: np.ndarray) -> np.ndarray:
        """Column of ``values`` for each hash."""
        at = self._place(h)
        got = self.keys[at]
        out = np.where(got == h, self.row[at], 0)
        left = np.flatnonzero((got != h) & (got != 0))
        while len(left):
            at[left] = (at[left] + 1) & (len(self.keys) - 1)
            got = self.keys[at[left]]
            hit = got == h[left]
            out[left[hit]] = self.row[at[left[hit]]]
            left = left[~hit & (got != 0)]
        return out


class SpellingModel:
    """Kneser-Ney letter models of two classes, from each word's counts in them.

    The shared model interpolates all orders of both classes' counts together. On top of it, each class discounts its
    own counts of ``TOP`` letters and gives what that leaves to the shared model: a word that only one class has, but
    hardly ever, tells little, and a stem that one class has often tells much whatever its endings.

    ``tables[m]`` has a row for each run of m letters: its discounted count, and as a context of m letters the total of
    what follows and the weight of the next shorter one. ``own`` rows of the two longest add the classes' counts, and
    totals and weights.
    """

    def __init__(self, vocabulary: list[str], counts: np.ndarray):
        letters = _Letters(vocabulary)
        at = letters.at.astype(np.int32)
        c = counts.astype(np.float32)[:, letters.word[at]]
        columns: list[list[tuple[np.ndarray, np.ndarray, int]]] = [[] for _ in range(TOP + 1)]  # keys, values, first column

        def add(n: int, at: np.ndarray, weights: np.ndarray, column: int) -> np.ndarray:
            k, left, ctx, told, at = self._order(letters, at, n, weights)
            columns[n].append((k, left.astype(np.float32), column))
            columns[n - 1].append((ctx, told.astype(np.float32), column + len(left) if column else 1))
            return at

        def table(m: int) -> _Table:
            keys = np.unique(np.concatenate([k for k, _, _ in columns[m]]))
            values = np.zeros((9 if m == TOP - 1 else 5 if m == TOP else 3, len(keys)), np.float32)
            for k, v, column in columns[m]:
                values[column : column + len(v), np.searchsorted(keys, k)] = v
            columns[m].clear()
            return _Table(keys, values)

        n_of = c.sum(0, keepdims=True)
        add(TOP, at, c, 3)
        del c
        self.tables: list[_Table] = []
        for n in range(TOP, 0, -1):
            at = add(n, at, n_of, 0)
            if n == 1:
                self.letters = max(2, len(columns[1][-1][0]))
            self.tables.append(table(n))  # what n letters and their contexts add to it is there
            # lower orders count the different letters that come before, not how often
            n_of = np.ones((1, len(at)), np.float32)
        self.tables.append(table(0))
        self.tables.reverse()

    @staticmethod
    def _groups(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The order that sorts the keys, and where each distinct one begins in it; lighter than unique() with its inverse."""
        order = np.argsort(key, kind="stable").astype(np.int32)
        key = key[order]
        return order, np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).astype(np.int32)

    @classmethod
    def _order(cls, letters: _Letters, at: np.ndarray, n: int, weights: np.ndarray) -> tuple:
        """Distinct runs of n letters and their discounted counts; their contexts, with totals and the weights they leave; a place of each run."""
        key = letters.ending(at, n)
        order, starts = cls._groups(key)
        first = order[starts]
        k, sums, at = key[first], np.stack([np.add.reduceat(x[order], starts, dtype=np.float64) for x in weights]), at[first]
        del key, order, starts, first
        ctx = letters.ending(at - 1, n - 1)
        order, starts = cls._groups(ctx)
        total, kinds = (np.add.reduceat(x[:, order], starts, axis=1, dtype=np.float64) for x in (sums, (sums > 0).astype(np.float32)))
        ones, twos = (sums == 1).sum(1), (sums == 2).sum(1)
        d = np.clip(ones / np.maximum(1, ones + 2 * twos), 0.1, 0.95)[:, None]
        return k, np.maximum(sums - d, 0), ctx[order[starts]], np.concatenate([total, d * kinds]), at

    def ratios(self, vocabulary: list[str]) -> np.ndarray:
        """Log-likelihood of each word in class 1 less that in class 0."""
        if not vocabulary:
            return np.zeros(0)
        letters = _Letters(vocabulary)
        for x in self.tables:
            x.open()
        context = self.tables[TOP - 1]
        told = context.rows(letters.ending(letters.at - 1, TOP - 1))
        t = context.values[5:, told]
        some = t[:2].any(0)  # elsewhere neither class has counts of its own, and both agree
        at, t = letters.at[some], t[:, some]
        # Each place in question and the one before it, once.
        spot = np.flatnonzero(np.isin(np.arange(len(letters.code)), np.concatenate([at, at - 1])))
        here, before = np.searchsorted(spot, at), np.searchsorted(spot, at - 1)
        p, h = np.full(len(at), 1 / (self.letters + 1), np.float32), np.full(len(spot), 1, np.uint64)
        row = self.tables[0].rows(h)
        for n in range(1, TOP + 1):
            total, back = self.tables[n - 1].values[1:3, row[before]]
            h = letters.longer(spot, h, n - 1)
            row = self.tables[n].rows(h)
            c = self.tables[n].values[0, row[here]]
            p = np.where(total > 0, (c + back * p) / np.maximum(total, 1e-9), p)
        c = self.tables[TOP].values[3:5, row[here]]
        q = np.where(t[:2] > 0, (c + t[2:] * p) / np.maximum(t[:2], 1e-9), p)
        r = np.log(np.maximum(q[1], 1e-30)) - np.log(np.maximum(q[0], 1e-30))
        return np.bincount(letters.word[at], r, len(vocabulary))


def evidence(ratio: np.ndarray) -> np.ndarray:
    """A document's features from its words' ratios, in order."""
    n = len(ratio)
    if not n:
        return np.zeros(FEATURES)
    sums = np.cumsum(np.concatenate([[0.0], ratio]))
    w = min(n, PASSAGE)
    passage = (sums[w:] - sums[:-w]).max() / PASSAGE
    top = np.sort(np.partition(ratio, -min(4, n))[-min(4, n) :])[::-1]
    top = np.concatenate([top, np.zeros(4 - len(top))])
    return np.array([ratio.mean(), passage, top[0], top[1], top[2], top[3], np.log1p(n)])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and scale of the features, and the weights (the last: of 1), by Newton's method."""
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    w, pen = np.zeros(z.shape[1]), np.full(z.shape[1], ridge)
    pen[-1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        h = (z * (p * (1 - p))[:, None]).T @ z + np.diag(pen)
        step = np.linalg.solve(h, z.T @ (y - p) - pen * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return mean, scale, w


class ToxicityModel:
    """A spelling model, pickled until it is first used, and the logistic function of the evidence that it gives."""

    def __init__(self, packed: bytes | None, logistic: tuple[np.ndarray, np.ndarray, np.ndarray] | None, rate: float):
        self.packed, self.logistic, self.rate = packed, logistic, rate
        self.spelling: SpellingModel | None = None
        self.known: dict[str, float] = {}
        self.older: dict[str, float] = {}

    def forget(self) -> None:
        """What can be made again goes."""
        self.spelling, self.known, self.older = None, {}, {}

    def features(self, texts: list[str], most_known: int = 150_000) -> np.ndarray:
        self.spelling = self.spelling or pickle.loads(self.packed)
        found = [words(t) for t in texts]
        if len(self.known) > most_known:
            self.older, self.known = self.known, {}  # words met again come back from there
        new = set().union(*found).difference(self.known)
        again = new & self.older.keys()
        self.known.update((w, self.older[w]) for w in again)
        new = list(new - again)
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            self.known.update(zip(part, self.spelling.ratios(part).tolist(), strict=True))
        get = self.known.__getitem__
        return np.array([evidence(np.fromiter(map(get, ws), np.float64, len(ws))) for ws in found]).reshape(-1, FEATURES)

    def scores(self, texts: list[str]) -> np.ndarray:
        if self.packed is None or not texts:
            return np.full(len(texts), self.rate)
        mean, scale, w = self.logistic
        z = np.concatenate([((self.features(part) - mean) / scale) @ w[:-1] + w[-1] for part in portions(texts)])
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_toxicity(docs: DataFrame, labels: DataFrame, usable: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_toxic: int = 1000, max_ordinary: int = 2000) -> ToxicityModel:
    """Learns from labelled rows where ``usable`` holds: at most ``max_toxic`` and ``max_ordinary`` of them, the first by the hash of their id.

    That bound makes the model small, whatever the corpus. Words are counted by the number of documents that hold them, and
    the models of that bounded vocabulary are made in tasks; only the made ones, pickled, pass the driver. The documents' evidence for the logistic
    fit comes from a model of the other half of the sample; its constant is then moved from the sample's share of toxic
    rows to that of all usable labels. Labels other than 0 and 1, or null, are passed over; with one label only, every
    text scores the labels' share of toxic rows (0 without labels). Null texts count as empty and very long ones are read
    whole. Rows that repeat an id, and repeated labels of one, are samples of their own; a null id has no label. Extra columns
    are ignored.
    """
    spark = docs.sparkSession
    small_batches(spark)
    known = labels.where(usable & F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic"))
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    rate = n.get(1, 0) / max(1, sum(n.values()))
    first = lambda k, most: known.where(F.col("toxic") == k).orderBy(F.xxhash64("id"), "id").limit(most)
    chosen = saved(first(1, max_toxic).unionByName(first(0, max_ordinary)), "toxic-chosen")
    sample = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")
    sample = saved(sample.select("text", "toxic", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)).cast("int").alias("fold")), "toxic-sample")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sorted(set(words(t))) for t in b.column("text").to_pylist()]
            at = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]).astype(np.int64))
            kind = pa.array([2 * f + t for f, t in zip(b.column("fold").to_pylist(), b.column("toxic").to_pylist(), strict=True)], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([w for f in found for w in f], pa.string()), kind.take(at)], ["word", "kind"])

    kinds = [F.count(F.when(F.col("kind") == k, 1)).alias(f"k{k}") for k in range(4)]
    counts = saved(sample.mapInArrow(split, "word string, kind int").groupBy("word").agg(*kinds), "toxic-words")

    def learn(t: pa.Table) -> pa.Table:
        """The model of one half of the sample, or (2) of all of it; none where a class has no words."""
        which, by = t.column("which")[0].as_py(), np.stack([t.column(f"k{k}").to_numpy() for k in range(4)])
        if not by[[0, 2]].any() or not by[[1, 3]].any():
            return pa.table({"which": pa.array([], pa.int32()), "model": pa.array([], pa.binary())})
        c = by[:2] + by[2:] if which == 2 else by[2 * which : 2 * which + 2]
        held = np.flatnonzero(c.any(0))
        vocabulary = t.column("word").take(pa.array(held)).to_pylist()
        model = pickle.dumps(SpellingModel(vocabulary, c[:, held])) if vocabulary else None
        del t, by, c, vocabulary
        give_back_memory()
        return pa.table({"which": pa.array([which], pa.int32()), "model": pa.array([model], pa.binary())})

    each = counts.select("*", F.explode(F.array(*(F.lit(i) for i in range(3)))).alias("which"))
    # one after the other in one task: a bounded vocabulary, and one worker's memory
    learnt = saved(each.repartition(1, "which").groupBy("which").applyInArrow(learn, "which int, model binary"), "toxic-models")
    packed = {r["which"]: r["model"] for r in learnt.where("which < 2").collect()}
    if not packed:
        return ToxicityModel(None, None, rate)
    halves = spark.sparkContext.broadcast([packed.pop(1), packed.pop(0)])  # fold 0 is weighed by what fold 1 taught

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: list[ToxicityModel] | None = None
        for b in batches:
            models = models or [ToxicityModel(m, None, 0.0) for m in halves.value]
            texts, fold, toxic = (b.column(c).to_pylist() for c in ("text", "fold", "toxic"))
            for f in (0, 1):
                own = [i for i, x in enumerate(fold) if x == f]
                if own and models[f].packed is not None:
                    x = np.concatenate([models[f].features(part) for part in portions([texts[i] for i in own])])
                    yield pa.RecordBatch.from_arrays([pa.array(x.tolist(), pa.list_(pa.float64())), pa.array([toxic[i] for i in own], pa.int32())], ["x", "toxic"])
        del models
        give_back_memory()

    seen = sample.mapInArrow(weigh, "x array<double>, toxic int").collect()
    halves.destroy()
    x, y = np.array([r["x"] for r in seen]).reshape(-1, FEATURES), np.array([r["toxic"] for r in seen])
    order = np.lexsort([*x.T, y])
    mean, scale, w = fit_logistic(x[order], y[order])
    if 0 < y.mean() < 1 and 0 < rate < 1:
        w[-1] += np.log(rate / (1 - rate)) - np.log(y.mean() / (1 - y.mean()))
    return ToxicityModel(learnt.where("which = 2").first()["model"], (mean, scale, w), rate)


def score_toxicity(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``out``, the probability that a whole text is toxic; null counts as empty, very long texts are read whole, repeated rows score alike. An input column named ``out`` is replaced."""
    small_batches(docs.sparkSession)
    docs = docs.drop(out)
    names, given = docs.columns, docs.sparkSession.sparkContext.broadcast(model)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{out}` double"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = given.value
        for b in batches:
            s = m.scores([t or "" for t in b.column(text_col).to_pylist()])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(s, pa.float64())], [*names, out])
        m.forget()
        give_back_memory()

    return docs.mapInArrow(work, schema)
