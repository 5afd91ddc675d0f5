"""Mixing to target weights with soft membership: domain posteriors from a labelled table, and document rates fitted to token targets."""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import give_back_memory, saved, small_batches

FEATURES = 14


def style(text: str) -> tuple[int, np.ndarray]:
    """Words of the whole text, and features of how it is written: shares of kinds of characters, repetition, word and line lengths."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    ws = text.split()
    n, size = len(ws), max(1, len(raw))
    by = np.bincount(raw, minlength=256) / size
    low, up, digit, far = by[97:123].sum(), by[65:91].sum(), by[48:58].sum(), by[128:].sum()
    blank, line = by[32] + by[9] + by[13], by[10]
    stops = by[44] + by[46]
    marks = max(0.0, 1 - low - up - digit - far - blank - line - stops)
    distinct = len(set(ws))
    same = sum(a == b for a, b in zip(ws, ws[1:], strict=False)) / max(1, n - 1)
    return n, np.array([low, up, digit, far, line, stops, marks, np.log1p(n), distinct / max(1, n), same, sum(map(len, ws)) / max(1, n) / 10, up * 5 > low, np.sqrt(marks), np.log1p(n) * distinct / max(1, n)], np.float64)


class DomainClassifier:
    """Softmax regression on the features, their squares among them."""

    def __init__(self, names: list[str], x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 400):
        self.names, k = names, len(names)
        self.mean, self.scale = (x.mean(0), np.maximum(x.std(0), 1e-6)) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
        self.w = np.zeros((2 * FEATURES + 1, k))
        if k < 2 or not len(x):
            return
        z, hot = self._input(x), np.eye(k)[y]
        step = 1 / (0.5 * np.linalg.norm(z, 2) ** 2 / len(z) + ridge / len(z))
        at = self.w
        for t in range(steps):  # accelerated gradient steps of the convex loss
            p = self._softmax(z @ at)
            new = at - step * (z.T @ (p - hot) / len(z) + ridge / len(z) * at)
            at, self.w = new + t / (t + 3) * (new - self.w), new

    def _input(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.column_stack([z, z * z / 3, np.ones(len(z))])

    @staticmethod
    def _softmax(s: np.ndarray) -> np.ndarray:
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def posteriors(self, x: np.ndarray) -> np.ndarray:
        return self._softmax(self._input(x) @ self.w)


def learn_domains(docs: DataFrame, labelled: DataFrame, names: list[str], id_col: str = "doc_id", text_col: str = "text", most_rows: int = 2000) -> DomainClassifier:
    """A classifier of the domains in ``names`` from (id, domain) rows; at most ``most_rows`` a domain, the first by the hash of their id.

    The bound keeps what the driver gets small. Rows of other or null domains are passed over. Domains without rows
    share the prior equally with the others where nothing is known: with fewer than two domains seen, posteriors are uniform.
    """
    rows = labelled.where(F.col("domain").isin(names)).select(F.col(id_col).alias("id"), "domain")
    parts = [rows.where(F.col("domain") == d).orderBy(F.xxhash64("id"), "id").limit(most_rows) for d in names]
    chosen = parts[0]
    for p in parts[1:]:
        chosen = chosen.unionByName(p)
    chosen = saved(chosen, "domains-chosen")
    small_batches(docs.sparkSession)
    sample = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(chosen), "id")

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([style(t)[1].tolist() for t in b.column("text").to_pylist()], pa.list_(pa.float64())), b.column("domain")], ["x", "domain"])

    got = sample.select("text", "domain").mapInArrow(describe, "x array<double>, domain string").collect()
    got.sort(key=lambda r: (r["domain"], r["x"]))
    seen = {r["domain"] for r in got}
    if len(seen) < 2:
        return DomainClassifier(names, np.zeros((0, FEATURES)), np.zeros(0, np.int64), steps=0)
    return DomainClassifier(names, np.array([r["x"] for r in got]), np.array([names.index(r["domain"]) for r in got]))


def least_scale(shared: np.ndarray, want: np.ndarray, floor: float) -> float:
    """The least scale of the tokens, at least 1, at which rates of at least ``floor`` meet the targets ``want`` (summing to 1).

    ``shared[j, k]`` is the token share of posterior j times posterior k. The rates scale * sum_k u_k posterior_dk with
    shared @ u = want meet the targets; they keep the floor once scale * u_k reaches it for each k. With sharp posteriors
    this is the largest of share_k / target_k. Where some u_k is not positive (posteriors softer than the targets, a domain
    without tokens) no such rates exist: the largest share_k / target_k is returned, with a warning, and least squares
    come as near as they can.
    """
    share = shared.sum(1)
    bound = max([1.0, *(floor * share[want > 0] / want[want > 0])])
    if not share.any():
        return bound
    u = np.linalg.lstsq(shared, want, rcond=1e-9)[0]
    if np.abs(shared @ u - want).max() > 1e-6 or u.min() <= 0 < floor:
        warnings.warn(f"mixing: posteriors are too soft to meet the targets {want.tolist()} from shares {share.round(4).tolist()}", stacklevel=2)
        return bound
    return max(bound, floor / u.min()) if floor else bound


def mixing_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], id_col: str = "doc_id", text_col: str = "text", scale: float | None = 1.0, floor: float = 0.0, pull: float = 1e-3, most_steps: int = 100, tolerance: float = 1e-9) -> DataFrame:
    """All columns of ``docs`` with _tokens (words), _posteriors (in the order of ``targets``) and _rate.

    ``labelled`` (id, domain) trains a classifier; a document belongs to each domain in the share of its posterior.
    Nonnegative rates (at least ``floor``) minimise sum_k ((sum_d rate_d tokens_d posterior_dk - T_k) / S)^2 +
    pull * sum_d tokens_d / S (rate_d - 1)^2, where S is the total of tokens and T_k = scale * S * targets[k].

    Steps are projected gradients, scaled by the inverse of the Hessian of the documents that are above the floor; that is a
    multiple of the identity but for one row and column a domain, so that every iterate has the form max(floor, 1 - a
    posterior times one number a domain). Only these numbers and a few sums over all documents pass through the driver, and
    no rates are stored. A step that does not lower the objective is halved. Where ``most_steps`` do not bring the numbers to
    rest within ``tolerance``, a warning says how far off they are.

    Without a ``scale`` it is the least, at least 1, at which rates that rise with the posteriors meet the targets and none
    is under ``floor`` (see ``least_scale``).

    Null or empty text has no tokens and a rate from its posterior alike; very long texts are read whole. A target that no
    document can meet is met as nearly as least squares can. Repeated rows are documents of their own. Input columns named
    _tokens, _posteriors or _rate are replaced; others are carried through. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("_tokens", "_posteriors", "_rate")
    names = list(targets)
    total, n = sum(targets.values()), len(targets)
    want = np.array([targets[d] / total for d in names])
    classifier = spark.sparkContext.broadcast(learn_domains(docs, labelled, names, id_col, text_col))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [style(t or "") for t in b.column(text_col).to_pylist()]
            if got:
                p = classifier.value.posteriors(np.stack([g[1] for g in got]))
                yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array(p.tolist(), pa.list_(pa.float64()))], ["tokens", "p"])
        give_back_memory()

    facts = saved(docs.select(text_col).mapInArrow(place, "tokens long, p array<double>"), "mixing")

    def rates(p: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.maximum(floor, 1 - p @ at)

    def sums(*points: np.ndarray) -> list[dict[str, np.ndarray]]:
        """At each point, with tokens as weights: posteriors of free and of held documents, those of free ones times each other, posteriors times rates, squared moves, all tokens."""
        size = 3 * n + n * n + 2

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros((len(points), size))
            for b in batches:
                if b.num_rows:
                    p, t = b.column("p").flatten().to_numpy().reshape(-1, n), b.column("tokens").to_numpy().astype(float)
                    for k, at in enumerate(points):
                        r, free = rates(p, at), (1 - p @ at >= floor) * t
                        out[k] += np.concatenate([free @ p, (t - free) @ p, ((p * free[:, None]).T @ p).ravel(), (r * t) @ p, [t @ (r - 1) ** 2, t.sum()]])
            yield pa.RecordBatch.from_arrays([pa.array(range(out.size), pa.int32()), pa.array(out.ravel())], ["k", "x"])

        got = dict(facts.mapInArrow(add, "k int, x double").groupBy("k").agg(F.sum("x")).collect())
        flat = np.array([got.get(k, 0.0) for k in range(len(points) * size)]).reshape(len(points), size)
        cut = np.cumsum([n, n, n * n, n, 1])
        return [dict(zip(("free", "held", "cross", "made", "moved", "tokens"), np.split(row, cut), strict=True)) for row in flat]

    at = np.zeros(n)
    (now,) = sums(at)
    everything = max(1.0, now["tokens"][0])
    if scale is None:
        (all_free,) = sums(np.full(n, -1e6)) if now["held"].any() else (now,)  # every document's share in every pair of domains
        scale = least_scale(all_free["cross"].reshape(n, n) / everything, want, floor)
    want = want * scale
    loss = lambda f: float(((f["made"] / everything - want) ** 2).sum() + pull * f["moved"][0] / everything)

    for step in range(most_steps + 1):
        cross = now["cross"].reshape(n, n) / everything
        goal = np.linalg.solve(cross + pull * np.eye(n), (now["free"] + floor * now["held"]) / everything - want)
        off = float(np.abs(goal - at).max())
        if off <= tolerance * max(1.0, float(np.abs(goal).max())):
            break
        if step == most_steps:
            warnings.warn(f"mixing: after {most_steps} steps the domains' numbers are still {off:.2g} from rest", stacklevel=2)
            break
        for halved in range(0, 40, 4):  # four lengths in one pass
            tried = [at + (goal - at) * 0.5 ** (halved + k) for k in range(4)]
            seen = sums(*tried)
            best = int(np.argmin([loss(f) for f in seen]))
            if loss(seen[best]) < loss(now):
                break
        else:
            break  # at rest but for rounding
        at, now = tried[best], seen[best]

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "_tokens long, _posteriors array<double>, _rate double"])
    width = len(docs.columns)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [style(t or "") for t in b.column(text_col).to_pylist()]
            if got:
                p = classifier.value.posteriors(np.stack([g[1] for g in got]))
                yield pa.RecordBatch.from_arrays([*(b.column(c) for c in range(width)), pa.array([g[0] for g in got], pa.int64()), pa.array(p.tolist(), pa.list_(pa.float64())), pa.array(rates(p, at))], [*b.schema.names, "_tokens", "_posteriors", "_rate"])
        give_back_memory()

    return docs.mapInArrow(apply, schema)


def repeat_by_rate(rated: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Each row as often as its _rate says: its whole part, and once more with the chance of the rest, told by a hash of the id. Other columns stay."""
    chance = F.pmod(F.xxhash64(F.col(id_col), F.lit(23)), F.lit(1 << 30)) / float(1 << 30)
    times = (F.floor("_rate") + F.when(chance < F.col("_rate") - F.floor("_rate"), 1).otherwise(0)).cast("int")
    return rated.withColumn("_rate", F.explode(F.array_repeat(F.lit(1.0), times))).drop("_tokens", "_posteriors", "_rate")


def quality_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain) from a table of labels: good or poor by its quality of 1 or 0; other rows are left out."""
    domain = F.when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor")
    return labels.select("doc_id", domain.alias("domain")).where(domain.isNotNull())
