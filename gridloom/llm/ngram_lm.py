"""Language-model scoring with a weighted backoff automaton over n-gram counts of the whole corpus.

The model is never held in one place. Documents are packed into blocks; every block asks, bucket by bucket, for the counts
of just the words, pairs and triples of words that it holds, and builds from the answers its own part of the automaton: a
state for each context seen in training, an arc for each n-gram seen there, and from each state a failure arc to that of
the next shorter context. What moves is a few bytes for each distinct n-gram of a block, and no key is hot, as n-grams are
dealt by their hash and a block has each once.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import give_back_memory, pieces, saved, small_batches, words_of

BEGIN, END = (xxhash.xxh3_64_intdigest(x) for x in (b" begin", b" end"))  # of a text; no word holds a blank
ORDERS = 3
#: Observations of the shorter context's expectation that a context of one word, and one of two, starts with.
PRIOR = (3000.0, 15.0)
_MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_WIDTH = {1: 8, 2: 6, 3: 6}  # bytes of a word's hash, and of a pair's or triple's


def _planes(x: np.ndarray, width: int) -> bytes:
    return np.ascontiguousarray(x.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(raw: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(raw, np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def pack(counts: np.ndarray, keys: np.ndarray | None = None, width: int = 8) -> bytes:
    """Counts, and ascending keys as differences, in byte planes."""
    body = [struct.pack("<II", len(counts), width if keys is not None else 0)]
    if keys is not None:
        body.append(_planes(np.diff(keys, prepend=np.uint64(0)), width))
    return zstandard.ZstdCompressor(level=1).compress(b"".join([*body, _planes(counts, 5)]))


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The counts and keys that pack() took (no keys: an empty array)."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    n, width = struct.unpack_from("<II", raw)
    keys = np.cumsum(_unplanes(raw[8 : 8 + width * n], n, width), dtype=np.uint64) if width else np.zeros(0, np.uint64)
    return _unplanes(raw[8 + width * n :], n, 5).astype(np.int64), keys


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * _MIX[0] ^ b) * _MIX[1]
    return (h ^ (h >> np.uint64(31))) * _MIX[0]


class Block:
    """Tokens of a block's documents, and its distinct words, pairs and triples with their hashes.

    ``tokens`` are places in ``words`` (hashes, ascending); a document's tokens end with END. ``at[n]`` is the place of the
    n-gram that ends at each token among the distinct ones, -1 where a document has not begun n - 1 tokens before (but for
    BEGIN, which stands before its first).
    """

    def __init__(self, texts: list[str]):
        number: dict[bytes, int] = {}
        seqs, sizes = [], np.empty(len(texts), np.int64)
        for i, t in enumerate(texts):
            ws = words_of(t)
            sizes[i] = len(ws) + 1
            seqs.append(np.fromiter((number.setdefault(w, len(number)) for w in ws), np.int32, len(ws)))
        raw = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in number), np.uint64, len(number))
        del number
        self.words, place = np.unique(np.concatenate([np.array([BEGIN, END], np.uint64), raw]), return_inverse=True)
        self.begin, self.end = int(place[0]), int(place[1])
        self.sizes, self.ends = sizes, np.cumsum(sizes)
        self.tokens = np.full(int(sizes.sum()), self.end, np.int32)
        inner = np.ones(len(self.tokens), bool)
        inner[self.ends - 1] = False
        self.tokens[inner] = place[2:].astype(np.int32)[np.concatenate(seqs)] if seqs else 0
        del seqs
        first = self.ends - sizes
        before = np.concatenate([[self.begin], self.tokens[:-1]]).astype(np.int64) if len(self.tokens) else self.tokens.astype(np.int64)
        before[first] = self.begin
        self.pairs, self.at_pair = np.unique(before * len(self.words) + self.tokens, return_inverse=True)
        self.at_pair = self.at_pair.astype(np.int32)
        # A triple is a pair and one more token; a first token ends none.
        third = np.ones(len(self.tokens), bool)
        third[first] = False
        spot = np.flatnonzero(third)
        self.triples, inverse = np.unique(self.at_pair[spot - 1].astype(np.int64) * len(self.words) + self.tokens[spot], return_inverse=True)
        self.at_triple = np.full(len(self.tokens), -1, np.int32)
        self.at_triple[spot] = inverse

    def hashes(self) -> dict[int, np.ndarray]:
        """Hashes of the distinct words, pairs and triples, of 64, 48 and 48 bits."""
        w = len(self.words)
        pair = _mixed(self.words[self.pairs // w], self.words[self.pairs % w])
        triple = _mixed(pair[self.triples // w], self.words[self.triples % w])
        return {1: self.words, 2: pair >> np.uint64(16), 3: triple >> np.uint64(16)}

    def counts(self, learn: np.ndarray) -> dict[int, np.ndarray]:
        """How often each occurs at tokens where ``learn`` holds; BEGIN as often as documents begin there."""
        words = np.bincount(self.tokens[learn], minlength=len(self.words))
        words[self.begin] = int(learn[self.ends - 1].sum())
        triples = self.at_triple[learn]
        return {1: words, 2: np.bincount(self.at_pair[learn], minlength=len(self.pairs)), 3: np.bincount(triples[triples >= 0], minlength=len(self.triples))}


def _dealt(keys: np.ndarray, order: int, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places of its keys, which ascend) for each bucket that has some: ranges of the hash."""
    by = np.argsort(keys, kind="stable")
    bucket = ((keys[by] >> np.uint64(8 * _WIDTH[order] - 32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    edges = np.searchsorted(bucket, np.arange(buckets + 1))
    for k in np.flatnonzero(np.diff(edges)).tolist():
        yield k, by[edges[k] : edges[k + 1]]


def _batch(rows: list[tuple], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)


_REQUEST = "n int, bucket int, block long, data binary"
_REQUEST_NAMES, _REQUEST_KINDS = ["n", "bucket", "block", "data"], [pa.int32(), pa.int32(), pa.int64(), pa.binary()]
_REPLY = _REQUEST + ", total long, distinct long, ones long, twos long"
_REPLY_NAMES, _REPLY_KINDS = [*_REQUEST_NAMES, "total", "distinct", "ones", "twos"], [*_REQUEST_KINDS, *[pa.int64()] * 4]


def _merge(t: pa.Table) -> pa.Table:
    """Sums a bucket's counts of each order, and answers every block in its own order; one answer carries the bucket's totals of words."""
    out = []
    n, block, data = t.column("n").to_numpy(), t.column("block").to_pylist(), t.column("data")
    for order in range(1, ORDERS + 1):
        mine = np.flatnonzero(n == order).tolist()
        if not mine:
            continue
        got = [unpack(data[i].as_py()) for i in mine]
        keys = np.concatenate([k for _, k in got])
        distinct, at = np.unique(keys, return_inverse=True)
        del keys
        total = np.bincount(at, np.concatenate([c for c, _ in got]), len(distinct)).astype(np.int64)
        real = total[(distinct != BEGIN) & (total > 0)] if order == 1 else total[:0]
        stats = (int(real.sum()), len(real), int((real == 1).sum()), int((real == 2).sum()))
        p = 0
        for i, (c, _) in zip(mine, got, strict=True):
            out.append((order, t.column("bucket")[0].as_py(), block[i], pack(total[at[p : p + len(c)]]), *stats))
            stats, p = (0, 0, 0, 0), p + len(c)
        del got, distinct, at, total
    give_back_memory()
    return pa.Table.from_batches([_batch(out, _REPLY_NAMES, _REPLY_KINDS)])


class Automaton:
    """A block's part of the model.

    States are the root, contexts of one word, and contexts of two, as far as training has them. The arcs of a state are the
    n-grams seen after it; an arc's weight is the log10 probability of its word there, and it leads to the longest context
    that then holds. A state's failure arc leads to its context without the first word, at the log10 of the mass that its
    smoothing leaves: a context seen c times counts as much as ``prior`` observations of what the shorter one expects.
    """

    def __init__(self, block: Block, counts: dict[int, np.ndarray], total: int, distinct: int, ones: int, twos: int, prior: tuple[float, float]):
        w, (n1, n2, n3) = len(block.words), (counts[k] for k in (1, 2, 3))
        d = min(0.95, max(0.05, ones / max(1.0, ones + 2 * twos)))
        p1 = np.where(n1 > 0, (n1 - d) / max(1, total), d * distinct / total if total else 1.0)  # unknown words are one class
        self.words, self.root = w, np.log10(p1)
        # States: 0, then 1 + word, then 1 + words + pair. A context that training lacks is no state: its shorter one serves.
        known = np.append(n1 > 0, False)
        known[block.end] = False  # nothing follows an end
        self.of_word = np.where(known[:w], 1 + np.arange(w), 0).astype(np.int32)
        head, tail = (block.pairs // w).astype(np.int32), (block.pairs % w).astype(np.int32)
        self.of_pair = np.where((n2 > 0) & (tail != block.end), 1 + w + np.arange(len(head)), self.of_word[tail]).astype(np.int32)
        back1, back2 = prior[0] / (n1 + prior[0]), prior[1] / (n2 + prior[1])
        self.failure = np.concatenate([[0.0], np.log10(back1), np.log10(back2)])
        self.shorter = np.concatenate([np.zeros(1 + w, np.int32), self.of_word[tail]])
        p2 = (n2 + prior[0] * p1[tail]) / (n1[head] + prior[0])
        seen = np.flatnonzero(n2 > 0)
        keys2, weight2, to2 = (1 + head[seen].astype(np.int64)) * w + tail[seen], np.log10(p2[seen]), self.of_pair[seen]
        first, last = block.triples // w, (block.triples % w).astype(np.int32)
        seen = np.flatnonzero(n3 > 0)
        first, last = first[seen], last[seen]
        inner = np.searchsorted(block.pairs, tail[first].astype(np.int64) * w + last)
        p3 = (n3[seen] + prior[1] * p2[inner]) / (n2[first] + prior[1])
        keys3 = (1 + w + first) * w + last
        self.keys, self.weight, self.to = np.concatenate([keys2, keys3]), np.concatenate([weight2, np.log10(p3)]), np.concatenate([to2, self.of_pair[inner]])  # both parts ascend, and states of pairs come last

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states that ``word`` leads to from ``state``, and the weights on the way: of failure arcs until a state has the word's arc, and of that arc."""
        out, weight, todo, at = np.empty(len(state), np.int32), np.zeros(len(state)), np.arange(len(state)), state
        while len(todo):
            key = at.astype(np.int64) * self.words + word[todo]
            arc = np.minimum(np.searchsorted(self.keys, key), max(0, len(self.keys) - 1))
            hit = (self.keys[arc] == key) if len(self.keys) else np.zeros(len(key), bool)
            out[todo[hit]], weight[todo[hit]] = self.to[arc[hit]], weight[todo[hit]] + self.weight[arc[hit]]
            root = ~hit & (at == 0)  # the root has an arc for every word
            out[todo[root]], weight[todo[root]] = self.of_word[word[todo[root]]], weight[todo[root]] + self.root[word[todo[root]]]
            on = ~hit & ~root
            weight[todo[on]] += self.failure[at[on]]
            todo, at = todo[on], self.shorter[at[on]]
        return out, weight

    def traverse(self, block: Block, longest: int = 1024) -> np.ndarray:
        """Log10 probability of each document: one pass from left to right, all documents side by side, each with its state.

        A long document goes in pieces of ``longest`` tokens. A piece begins in the state that the two tokens before it lead
        to from the root, which is the one that the whole text before it leads to.
        """
        first, sizes = block.ends - block.sizes, block.sizes
        n_pieces = -(-sizes // longest)
        doc = np.repeat(np.arange(len(sizes)), n_pieces)
        nth = np.arange(len(doc)) - np.repeat(np.cumsum(n_pieces) - n_pieces, n_pieces)
        start, size = first[doc] + nth * longest, np.minimum(longest, sizes[doc] - nth * longest)
        order = np.argsort(-size, kind="stable")
        doc, nth, start, size = doc[order], nth[order], start[order], size[order]
        state = np.full(len(doc), self.of_word[block.begin], np.int32)
        later = np.flatnonzero(nth > 0)
        state[later] = 0
        for back in (2, 1):
            state[later] = self.step(state[later], block.tokens[start[later] - back])[0]
        total = np.zeros(len(doc))
        active = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")  # pieces that have a token at each place
        for t in range(int(size.max(initial=0))):
            k = int(active[t])
            state[:k], weight = self.step(state[:k], block.tokens[start[:k] + t])
            total[:k] += weight
        return np.bincount(doc, total, len(sizes))


def score_documents(docs: DataFrame, train: Column, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 4 << 20, bucket_bytes: int = 8 << 20, prior: tuple[float, float] = PRIOR) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of every whole text.

    ``train`` tells the rows to learn from (null: not). Tokens are words ``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased, then
    one end; base_score adds 0.1 to each unigram count. score is the log10 probability under triples of words, smoothed
    by pairs and these by single words: a context's counts and ``prior`` observations as the shorter context expects them.
    Single words are discounted absolutely, which leaves the mass D * V / N to unknown words as one class; each state's
    probabilities sum to 1. Counts cover all training rows. Null text counts as empty: one end. Very long texts are read
    whole. Without training rows every probability is 1. Repeated rows count as often as they occur; a null id is carried
    through; extra columns are ignored, whatever their names; an empty table gives an empty result. Words are told apart by
    64 bits of a hash, pairs and triples by 48.
    """
    spark = docs.sparkSession
    small_batches(spark)
    buckets = pieces(spark, docs, bucket_bytes)
    id_type = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))

    def to_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        part, k, size = TaskContext.get().partitionId(), 0, 0

        def flush() -> pa.RecordBatch:
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema) as w:
                for b in held:
                    w.write_batch(b)
            return _batch([(part << 32 | k, zstandard.ZstdCompressor(level=3).compress(sink.getvalue()))], ["block", "data"], [pa.int64(), pa.binary()])

        for b in batches:
            held.append(b)
            size += b.column("text").nbytes
            if size >= block_chars:
                yield flush()
                held, k, size = [], k + 1, 0
        if held:
            yield flush()

    def opened(data: bytes) -> pa.Table:
        return pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(data)).read_all()

    def request(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, data in zip(b.column("block").to_pylist(), b.column("data"), strict=True):
                t = opened(data.as_py())
                own = Block(t.column("text").to_pylist())
                counts = own.counts(np.repeat(np.array(t.column("train").to_pylist(), bool), own.sizes))
                del t
                for n, keys in own.hashes().items():
                    yield _batch([(n, k, block, pack(counts[n][i], keys[i], _WIDTH[n])) for k, i in _dealt(keys, n, buckets)], _REQUEST_NAMES, _REQUEST_KINDS)
                del own, counts, keys
                give_back_memory()

    blocks = saved(rows.mapInArrow(to_blocks, "block long, data binary"), "lm-blocks")
    replies = saved(blocks.mapInArrow(request, _REQUEST).groupBy("bucket").applyInArrow(_merge, _REPLY), "lm-counts")
    sums = replies.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("total", "distinct", "ones", "twos"))).first()
    total, distinct, ones, twos = sums

    def score(docs_of: pa.Table, answers: pa.Table) -> pa.Table:
        parts = []
        for data in docs_of.column("data"):
            t = opened(data.as_py())
            own, ids = Block(t.column("text").to_pylist()), t.column("doc_id")
            del t
            counts: dict[int, np.ndarray] = {}
            at = {(n, k): i for i, (n, k) in enumerate(zip(answers.column("n").to_pylist(), answers.column("bucket").to_pylist(), strict=True))}
            for n, keys in own.hashes().items():
                counts[n] = np.zeros(len(keys), np.int64)
                for k, i in _dealt(keys, n, buckets):
                    counts[n][i] = unpack(answers.column("data")[at[n, k]].as_py())[0]
            model = Automaton(own, counts, total, distinct, ones, twos, prior)
            begins = own.ends - own.sizes
            plain = np.log10((counts[1] + 0.1) / (total + 0.1 * (distinct + 1)))[own.tokens]
            known = np.add.reduceat((counts[1] > 0)[own.tokens].astype(np.int64), begins)
            base = np.add.reduceat(plain, begins)
            del plain, counts
            parts.append(pa.table({"doc_id": ids, "n_tokens": own.sizes, "n_known": known, "train_tokens": np.full(len(known), total, np.int64), "base_score": base, "score": model.traverse(own)}))
            del own, model
        give_back_memory()
        return pa.concat_tables(parts) if parts else schema.empty_table()

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
    answers = replies.select("n", "bucket", "block", "data")
    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, f"doc_id {id_type.simpleString()}, n_tokens long, n_known long, train_tokens long, base_score double, score double")
