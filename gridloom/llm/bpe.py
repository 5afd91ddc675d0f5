"""Byte-level BPE by speculation: greedy longest-match proposes tokens, pairwise checks accept them, only failing words are merged exactly."""

from __future__ import annotations

import gc
import heapq
import json
import re
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from gridloom.llm.common import give_back_memory, portions, small_batches

# Fixed value: the split pattern of this family of byte-level vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_DOUBLE_SPACE = re.compile(r"[\s\x1c-\x1f]{2}")
_SPACE = re.compile(r"[\s\x1c-\x1f]")


def byte_letters() -> dict[str, int]:
    """The letter by which vocabularies write each byte: itself where it prints, else the next unused one from U+0100."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    out = {chr(b): b for b in shown}
    for k, b in enumerate(b for b in range(256) if b not in set(shown)):
        out[chr(256 + k)] = b
    return out


class Bpe:
    """Tables of a vocabulary (a tokenizers JSON file with byte-level BPE), and encoding with them."""

    def __init__(self, path: str, cache_words: int = 150_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        as_bytes = lambda s: bytes(letters[c] for c in s)
        vocab = {as_bytes(t): i for t, i in spec["model"]["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        n = 1 + max([*vocab.values(), *self.special.values()])
        self.rank = np.full(n, -1, np.int64)  # of the merge that makes a token; -1: a single byte
        self.left, self.right = np.full(n, -1, np.int64), np.full(n, -1, np.int64)
        keys = np.empty(len(spec["model"]["merges"]), np.int64)
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = (as_bytes(x) for x in (pair.split(" ") if isinstance(pair, str) else pair))
            t = vocab[a + b]
            keys[r] = vocab[a] << 32 | vocab[b]
            if self.rank[t] < 0:
                self.rank[t], self.left[t], self.right[t] = r, vocab[a], vocab[b]
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        self.vocab = vocab
        self.bytes_of = [b""] * n
        for t, i in vocab.items():
            self.bytes_of[i] = t
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.of_byte = [vocab[bytes([b])] for b in range(256)]
        self.merges = {int(k): r for r, k in enumerate(keys)}
        self.made = {r: vocab[self.bytes_of[int(k) >> 32] + self.bytes_of[int(k) & 0xFFFFFFFF]] for r, k in enumerate(keys)}
        self.makes = np.array([self.made[r] for r in range(len(keys))], np.int64)
        single = np.array(self.of_byte, np.int64)
        self.byte_ranks = self._ranks(np.repeat(single, 256), np.tile(single, 256)).reshape(256, 256)
        self.prefixes: dict[bytes, int] = {t[:k]: -1 for t in vocab for k in range(1, len(t))} | vocab  # -1: begins a token, but is none
        merged = np.flatnonzero(self.rank >= 0)
        own = np.ones(n, bool)
        own[merged] = self._compatible(self.left[merged], self.right[merged], 2 * self.rank[merged])
        for t in merged[np.argsort(self.rank[merged])].tolist():
            own[t] &= own[self.left[t]] and own[self.right[t]]
        self.own = own  # whether a token's bytes alone encode to just it
        self.cache: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.cache_words = cache_words
        self.pattern = regex.compile(PATTERN)
        self.stops = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair's merge; the number of merges where there is none."""
        key = a << 32 | b
        i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[i] == key, self.order[i], len(self.keys))

    def _compatible(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """For each adjacent pair, whether merging their bytes together gives just these two tokens.

        Undoes, from the last, the merges along the border. Two parts that meet there stood side by side until one of
        them was merged away from the border; they would have joined if their own merge came before that. Merges of
        one rank run left to right, hence the odd limits for the right side.
        """
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max) if limit is None else limit.copy()
        ok, at = np.ones(len(a), bool), np.arange(len(a))
        while len(at):
            x, y = a[at], b[at]
            key = x << 32 | y
            i = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            join = np.where(self.keys[i] == key, 2 * self.order[i], np.iinfo(np.int64).max)
            bad = join < limit[at]
            ok[at[bad]] = False
            ra, rb = self.rank[x], self.rank[y]
            at = at[~bad & ((ra >= 0) | (rb >= 0))]
            undo_left = self.rank[a[at]] > self.rank[b[at]]
            l, r = at[undo_left], at[~undo_left]
            limit[l], limit[r] = 2 * self.rank[a[l]], 2 * self.rank[b[r]] + 1
            a[l], b[r] = self.right[a[l]], self.left[b[r]]
        return ok

    def _greedy(self, word: bytes) -> list[int]:
        get, n, p = self.prefixes.get, len(word), 0
        t = self.vocab.get(word)
        if t is not None:
            return [t]
        out = []
        while p < n:
            k, best, end = p + 1, -1, p
            while k <= n and (t := get(word[p:k])) is not None:
                if t >= 0:
                    best, end = t, k
                k += 1
            out.append(best)
            p = end
        return out

    def _exact(self, word: bytes) -> list[int]:
        """Merges the pair of the lowest rank, leftmost first, until none is left."""
        get, none = self.merges.get, len(self.keys)
        toks = list(map(self.of_byte.__getitem__, word))
        if len(toks) > 64:
            return self._exact_long(toks)
        ranks = [get(a << 32 | b, none) for a, b in zip(toks, toks[1:], strict=False)]
        while ranks and (r := min(ranks)) < none:
            i = ranks.index(r)
            toks[i : i + 2] = [self.made[r]]
            del ranks[i]
            if i:
                ranks[i - 1] = get(toks[i - 1] << 32 | toks[i], none)
            if i < len(ranks):
                ranks[i] = get(toks[i] << 32 | toks[i + 1], none)
        return toks

    def _exact_many(self, words: list[bytes], n: int) -> list[list[int]]:
        """The same for many words of ``n`` bytes side by side: in each turn every word merges one pair, and those without one are done."""
        out: list = [None] * len(words)
        raw = np.frombuffer(b"".join(words), np.uint8).reshape(-1, n)
        toks, at, none = np.array(self.of_byte, np.int64)[raw], np.arange(len(words)), len(self.keys)
        ranks = self.byte_ranks[raw[:, :-1], raw[:, 1:]]
        while len(at):
            go = ranks.min(1, initial=none) < none
            if not go.all():
                for i, t in zip(at[~go].tolist(), toks[~go].tolist(), strict=True):
                    out[i] = t
                toks, ranks, at = toks[go], ranks[go], at[go]
                if not len(at):
                    break
            row, k, i = np.arange(len(at)), toks.shape[1], ranks.argmin(1)
            toks[row, i] = self.makes[ranks[row, i]]
            col = np.arange(k - 1)
            toks = np.take_along_axis(toks, col + (col > i[:, None]), 1)
            col = col[:-1]
            ranks = np.take_along_axis(ranks, col + (col >= i[:, None]), 1)
            left, right = np.flatnonzero(i > 0), np.flatnonzero(i < k - 2)
            ranks[left, i[left] - 1] = self._ranks(toks[left, i[left] - 1], toks[left, i[left]])
            ranks[right, i[right]] = self._ranks(toks[right, i[right]], toks[right, i[right] + 1])
        return out

    def _exact_long(self, toks: list[int]) -> list[int]:
        """The same with a heap and linked places, for words of any length."""
        n = len(toks)
        after, before = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(r, i, toks[i], toks[i + 1]) for i in range(n - 1) if (r := self.merges.get(toks[i] << 32 | toks[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, x, y = heapq.heappop(heap)
            j = after[i]
            if toks[i] != x or j < 0 or toks[j] != y:
                continue
            toks[i], toks[j] = self.made[r], -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for p, q in ((before[i], i), (i, after[i])):
                if p >= 0 and q >= 0 and (s := self.merges.get(toks[p] << 32 | toks[q])) is not None:
                    heapq.heappush(heap, (s, p, toks[p], toks[q]))
        return [t for t in toks if t >= 0]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of each word (a piece of the split pattern)."""
        found = [self._greedy(w) for w in words]
        sizes = np.array([len(f) for f in found], np.int64)
        flat = np.array([t for f in found for t in f], np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        failed = np.zeros(len(words), bool)
        failed[owner[~self.own[flat]]] = True
        inner = np.flatnonzero(owner[1:] == owner[:-1])
        if len(inner):
            pairs, back = np.unique(flat[inner] << 32 | flat[inner + 1], return_inverse=True)
            failed[owner[inner[~self._compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]]]] = True
        by_length: dict[int, list[int]] = {}
        for i in np.flatnonzero(failed).tolist():
            by_length.setdefault(len(words[i]), []).append(i)
        for n, at in by_length.items():
            exact = self._exact_many([words[i] for i in at], n) if len(at) > 8 and n <= 64 else [self._exact(words[i]) for i in at]
            for i, toks in zip(at, exact, strict=True):
                found[i] = toks
        return found

    def _learn(self, chunks: list[str]) -> None:
        """Encodes chunks into the cache. A word of letters alone is one piece; the pattern cuts the others."""
        cache, find = self.cache, self.pattern.findall
        words = [[c] if c.isascii() and (c[1:] if c[0] == " " else c).isalpha() else find(c) for c in chunks]
        distinct = list({w for ws in words for w in ws}.difference(cache))
        found = self.encode_words([w.encode("utf-8", "surrogatepass") for w in distinct])
        ids = {w: struct.pack(f"<{len(x)}I", *x) for w, x in zip(distinct, found, strict=True)}
        for c, ws in zip(chunks, words, strict=True):
            cache[c] = ids[c] if len(ws) == 1 and c in ids else b"".join([ids[w] if w in ids else cache[w] for w in ws])

    def _chunks(self, text: str) -> list[str]:
        """The text cut where the split pattern always cuts: before a space between two characters that aren't white space."""
        if not text:
            return []
        if _DOUBLE_SPACE.search(text) or _SPACE.match(text[0]) or _SPACE.match(text[-1]):
            out, begin = [], 0
            for m in re.finditer(r"(?<=[^\s\x1c-\x1f]) (?=[^\s\x1c-\x1f])", text):
                out.append(text[begin : m.start()])
                begin = m.start()
            return [*out, text[begin:]]
        head, *rest = text.split(" ")
        return [head, *[" " + x for x in rest]]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; special tokens' strings become their ids."""
        cut: list[list[str | int]] = []
        for t in texts:
            if self.stops is not None and any(s in t for s in self.special):
                cut.append([y for x in self.stops.split(t) for y in ([self.special[x]] if x in self.special else self._chunks(x))])
            else:
                cut.append(self._chunks(t))
        if len(self.cache) > self.cache_words:
            self.older, self.cache = self.cache, {}  # what is met again comes back from there
        for i in self.special.values():
            self.cache[i] = struct.pack("<I", i)  # type: ignore[index]
        new = set().union(*cut).difference(self.cache)
        again = new & self.older.keys()
        self.cache.update((c, self.older[c]) for c in again)
        if new := new - again:
            self._learn(list(new))
        get = self.cache.__getitem__
        return [b"".join(map(get, cs)) for cs in cut]

    def decode(self, ids: bytes) -> str:
        get = self.bytes_of.__getitem__
        return b"".join(map(get, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_TABLES: dict[str, Bpe] = {}


def tables(path: str) -> Bpe:
    if path not in _TABLES:
        _TABLES[path] = Bpe(path)
        give_back_memory()
    return _TABLES[path]


def bpe_encode(docs: DataFrame, tokenizer: str, text_col: str = "text", decode: bool = False, cache_words: int = 150_000) -> DataFrame:
    """Adds n_tokens, ids (binary: little-endian unsigned 32-bit integers) and, with ``decode``, decoded, the text of these ids.

    ``tokenizer`` is the path of a tokenizers JSON file, installed alike on every machine. Whole texts are encoded;
    null counts as empty, and an empty text has no ids. A worker remembers up to twice ``cache_words`` words. Columns n_tokens, ids and decoded of the input are replaced,
    others are carried through. Each row is encoded by itself, so repeated rows give repeated results.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("n_tokens", "ids", "decoded")
    names = docs.columns
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + ["n_tokens long, ids binary"] + ["decoded string"] * decode)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tables(tokenizer)
        bpe.cache_words = cache_words
        gc.disable()  # millions of short-lived lists and no cycles
        for b in batches:
            texts = [t or "" for t in b.column(text_col).to_pylist()]
            ids = [x for part in portions(texts, 1 << 19) for x in bpe.encode_batch(part)]
            cols = [b.column(c) for c in names] + [pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
            if decode:
                cols.append(pa.array([bpe.decode(x) for x in ids], pa.string()))
            yield pa.RecordBatch.from_arrays(cols, [*names, "n_tokens", "ids", *["decoded"] * decode])
        bpe.cache, bpe.older = {}, {}  # the worker lives on
        gc.enable()
        give_back_memory()

    return docs.mapInArrow(work, schema)
