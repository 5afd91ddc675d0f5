"""Cross-tokenizer alignment: a two-pointer merge of token ends gives groups and links; Spark counts the linked pairs and joins the counts back."""

from __future__ import annotations

import hashlib
import itertools
import json
import os
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.bpe import PATTERN, byte_letters
from gridloom.llm.common import give_back_memory, portions, saved, small_batches

_CUT = re.compile(r"(?<=[^\s\x1c-\x1f]) (?=[^\s\x1c-\x1f])")
_ODD = re.compile(r"[\s\x1c-\x1f]{2}")


class Aligned(NamedTuple):
    """What a stretch of text gives."""

    groups: str
    #: Tokens of A and of B, groups, links; the codes of its linked pairs (A id << 32 | B id); how often each is linked. 64-bit integers.
    numbers: bytes


def merge_ends(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """After how many tokens of each side a group is cut: where both of two ascending lists of ends have one.

    The two lists are two sorted runs, which the stable sort merges in one pass; equal neighbours are the cuts.
    """
    merged = np.sort(np.concatenate([a_ends, b_ends]), kind="stable")
    both = merged[:-1][merged[1:] == merged[:-1]]
    return np.searchsorted(a_ends, both, "right"), np.searchsorted(b_ends, both, "right")


_SEPARATORS = np.array([",", "|", ";", "\n"], object)
_MANY = 1 << 12  # links of a group that are counted by distinct ids


class Sides(NamedTuple):
    """The bytes of every token of both vocabularies, and their lengths."""

    a: list[bytes]
    b: list[bytes]
    a_len: np.ndarray
    b_len: np.ndarray


def align_tokens(texts: list[bytes], a_ids: list[list[int]], b_ids: list[list[int]], sides: Sides) -> list[Aligned | None]:
    """Groups and links of the two token lists of each of ``texts``; None where a side's bytes differ from the text.

    The ends of all texts' tokens stand one after the other, so that one merge serves all of them: every text's end is a cut.
    A group's links are given by distinct pair, with their number.
    """
    if not texts:
        return []
    a, b = (np.fromiter(itertools.chain.from_iterable(ids), np.int64) for ids in (a_ids, b_ids))
    na, nb = (np.array(list(map(len, ids)), np.int64) for ids in (a_ids, b_ids))
    size, own = np.array(list(map(len, texts)), np.int64), np.arange(len(texts))
    whole = b"".join(texts)
    same = all(b"".join(map(of.__getitem__, ids.tolist())) == whole and (np.bincount(np.repeat(own, n), length[ids], len(own)) == size).all() for of, length, ids, n in ((sides.a, sides.a_len, a, na), (sides.b, sides.b_len, b, nb)))
    if not same:
        if len(texts) == 1:
            return [None]
        k = len(texts) // 2  # halves, down to the texts that differ
        return align_tokens(texts[:k], a_ids[:k], b_ids[:k], sides) + align_tokens(texts[k:], a_ids[k:], b_ids[k:], sides)
    a_ends, b_ends, ends = np.cumsum(sides.a_len[a]), np.cumsum(sides.b_len[b]), np.cumsum(size)
    p, q = merge_ends(a_ends, b_ends)
    ca, cb = np.diff(p, prepend=0), np.diff(q, prepend=0)
    text_of = np.searchsorted(ends, a_ends[p - 1], "left")
    links = ca * cb

    some = np.flatnonzero(links <= _MANY)
    g = np.repeat(some, links[some])
    k = np.arange(len(g)) - np.repeat(np.cumsum(links[some]) - links[some], links[some])
    found = [(text_of[g], a[p[g] - ca[g] + k // cb[g]], b[q[g] - cb[g] + k % cb[g]], np.ones(len(g), np.int64))]
    for g in np.flatnonzero(links > _MANY).tolist():
        (x, m), (y, n) = (np.unique(ids[end - n : end], return_counts=True) for ids, end, n in ((a, p[g], ca[g]), (b, q[g], cb[g])))
        found.append((np.full(len(x) * len(y), text_of[g]), np.repeat(x, len(y)), np.tile(y, len(x)), np.outer(m, n).ravel()))
    of, x, y, times = map(np.concatenate, zip(*found, strict=True))
    keys, back = np.unique((of * len(sides.a) + x) * len(sides.b) + y, return_inverse=True)
    times = np.bincount(back, times).astype(np.int64)
    pair, y = np.divmod(keys, len(sides.b))
    of, x = np.divmod(pair, len(sides.a))

    # each text's numbers: four sizes, its pairs, their times
    n_pairs = np.bincount(of, minlength=len(own))
    begin = np.concatenate([[0], np.cumsum(4 + 2 * n_pairs)])
    numbers = np.empty(begin[-1], np.int64)
    for k, v in enumerate((na, nb, np.bincount(text_of, minlength=len(own)), np.bincount(text_of, links, len(own)).astype(np.int64))):
        numbers[begin[:-1] + k] = v
    at = begin[of] + 4 + np.arange(len(of)) - (np.cumsum(n_pairs) - n_pairs)[of]
    numbers[at], numbers[at + n_pairs[of]] = x << 32 | y, times
    raw, cut = numbers.tobytes(), (8 * begin).tolist()

    # the tokens in order of their groups, A before B, with what stands after each
    place = np.concatenate([2 * np.repeat(np.arange(len(ca)), ca), 2 * np.repeat(np.arange(len(cb)), cb) + 1])
    order = np.argsort(place, kind="stable")
    last = np.append(place[order][1:] != place[order][:-1], True)
    end_of_text = np.append(text_of[1:] != text_of[:-1], True)
    side = place[order] % 2
    after = np.where(last, np.where(side == 0, 1, np.where(end_of_text[place[order] // 2], 3, 2)), 0)
    text = "".join(itertools.chain.from_iterable(zip(map(str, np.concatenate([a, b])[order].tolist()), _SEPARATORS[after].tolist(), strict=True)))
    return [Aligned(t, raw[i:j]) for t, (i, j) in zip(text.split("\n"), itertools.pairwise(cut), strict=False)]


def _encoder(path: str, spec: dict, vocab: dict[bytes, int], letters: dict[str, int]) -> Callable[[list[str]], list[list[int]]]:
    """Encodes texts, special tokens' strings as plain text.

    Where merges are listed in the order of the ids that they make, an id is its merge's rank, and encoding by ranks gives the
    same ids in a fraction of the time; the tests compare both on every code point. Other files go to their own library.
    """
    made = [vocab[bytes(map(letters.__getitem__, "".join(m.split(" ") if isinstance(m, str) else m)))] for m in spec["model"]["merges"]]
    if all(i < j for i, j in itertools.pairwise(made)):
        import tiktoken

        ranked = tiktoken.Encoding("side-a", pat_str=PATTERN, mergeable_ranks=vocab, special_tokens={})
        return lambda texts: list(map(ranked.encode_ordinary, texts))
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import tokenizers

    own = tokenizers.Tokenizer.from_file(path)
    own.encode_special_tokens = True
    own.no_truncation()
    own.no_padding()
    return lambda texts: [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


class Aligner:
    """Both tokenizers, and what they give for each stretch of text.

    Both cut a text before every single space between two other characters (side A by its split pattern, side B as no
    piece has a space after another letter, which is checked), so stretches are encoded, merged and remembered by
    themselves. Otherwise a text is one stretch.
    """

    def __init__(self, a_path: str, b_path: str, remember: int = 150_000):
        import sentencepiece

        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        with open(a_path, encoding="utf-8") as f:
            spec = json.load(f)
        letters, special = byte_letters(), {t["content"] for t in spec.get("added_tokens", [])}
        vocab = {bytes(map(letters.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
        a_bytes = [b""] * (1 + max(vocab.values()))
        for token, i in vocab.items():
            a_bytes[i] = token
        self.encode_a = _encoder(a_path, spec, vocab, letters)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.sides = Sides(a_bytes, b_bytes, *(np.array(list(map(len, of)), np.int64) for of in (a_bytes, b_bytes)))
        self.by_words = not any(re.search("[^▁]▁", p) for p in pieces)
        self.remember = remember
        self.known: dict[str, Aligned | None] = {}
        self.older: dict[str, Aligned | None] = {}

    def stretches(self, text: str) -> list[str]:
        """The space and the text, cut where both tokenizers cut. Every stretch begins with a space."""
        text = " " + text
        if not self.by_words:
            return [text]
        if _ODD.search(text) or _ODD.match(text[-1] * 2):
            at = [0, *(m.start() for m in _CUT.finditer(text)), len(text)]
            return [text[i:j] for i, j in itertools.pairwise(at)]
        return [" " + w for w in text[1:].split(" ")]

    def _encode(self, new: list[str]) -> Iterator[Aligned | None]:
        for k in range(0, len(new), 4096):
            part = new[k : k + 4096]
            a_ids = self.encode_a(part)
            b_ids = self.b.encode([s[1:] for s in part], num_threads=1)
            yield from align_tokens([s.encode("utf-8", "surrogatepass") for s in part], a_ids, b_ids, self.sides)

    def of(self, stretches: set[str]) -> dict[str, Aligned | None]:
        """What each stretch gives; None where a side's bytes differ from it."""
        if len(self.known) > self.remember:
            self.known, self.older = {}, self.known
        out = {s: self.known[s] for s in stretches if s in self.known}
        again = {s: self.older[s] for s in stretches if s not in out and s in self.older}
        new = [s for s in stretches if s not in out and s not in again]
        fresh = dict(zip(new, self._encode(new), strict=True))
        self.known.update((s, e) for s, e in itertools.chain(again.items(), fresh.items()) if len(s) <= 64)
        return out | again | fresh


_ALIGNERS: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    if (a_path, b_path) not in _ALIGNERS:
        _ALIGNERS[a_path, b_path] = Aligner(a_path, b_path)
    return _ALIGNERS[a_path, b_path]


def _documents(tool: Aligner, texts: list[str]) -> Iterator[tuple[int, int, int, int, str, np.ndarray, np.ndarray]]:
    """Of each text: sizes, the digest of its groups, its distinct pairs and how often each is linked."""
    cut = [tool.stretches(t) if t else [] for t in texts]
    given = tool.of(set().union(*cut))
    at = {s: i for i, s in enumerate(given)}
    odd = np.array([e is None for e in given.values()], bool)
    blobs = [bytes(32) if e is None else e.numbers for e in given.values()]
    n_pairs = np.array(list(map(len, blobs)), np.int64) // 16 - 2
    numbers = np.frombuffer(b"".join(blobs), np.int64)
    begin = np.cumsum(2 * n_pairs + 4) - 2 * n_pairs
    sizes = numbers[(begin - 4)[:, None] + np.arange(4)]
    none = np.zeros(0, np.int64)
    for stretches in cut:
        i = np.fromiter(map(at.__getitem__, stretches), np.int64, len(stretches))
        if not len(i) or odd[i].any():
            yield 0, 0, 0, 0, "", none, none.astype(np.int32)
            continue
        digest = hashlib.sha256(";".join([given[s][0] for s in stretches]).encode()).hexdigest()  # type: ignore[index]
        own, n = np.unique(i, return_counts=True)
        k = n_pairs[own]
        place = np.repeat(begin[own] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        codes, back = np.unique(numbers[place], return_inverse=True)
        linked = np.bincount(back, numbers[place + np.repeat(k, k)] * np.repeat(n, k))
        yield *sizes[i].sum(0).tolist(), digest, codes, linked.astype(np.int32)


_MADE = "block long, id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, at array<int>, n array<int>, whole boolean"


def align_tokenizers(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 8 << 20) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Side A is a tokenizers JSON file with byte-level BPE, of which the space and the text are encoded; side B a
    sentencepiece model with byte fallback, which adds that space itself. Special tokens' strings are plain text. Byte
    offsets where tokens of both sides end cut the tokens into groups; within a group, every token of A is linked with
    every one of B. A pair of ids counts in how many documents it is linked; n_best is how many of a document's links
    have a pair that no other pair with its A id outnumbers, count_sum the sum of the counts over its links.

    A task aligns its documents in blocks of about ``block_chars`` characters and writes, for each block, its distinct
    pairs once, with the number of documents that have them; documents refer to them by place. So what is counted and
    joined back is a row for each block and pair: no hot pair is in more rows than there are blocks, and the join's other
    side has each pair once, so that Spark can split what remains hot.

    Null and empty texts, and texts that either side doesn't give back byte for byte, have no tokens: zeros and an empty
    digest. Each row is a document, so repeated rows count as often as they occur and give equal rows; null ids are kept.
    Other columns are ignored, whatever their names. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)

    def blocked(rows: list[tuple], block: int) -> pd.DataFrame:
        """The rows of a block: one with its distinct pairs and their document counts, and one a document."""
        flat = np.concatenate([r[6] for r in rows])
        codes, place, n = np.unique(flat, return_inverse=True, return_counts=True)
        cut = np.cumsum([0, *(len(r[6]) for r in rows)])
        place = place.astype(np.int32)
        out = [(block, None, 0, 0, 0, 0, "", codes, None, n.astype(np.int32), True)]
        out += [(block, r[0], *r[1:6], None, place[cut[i] : cut[i + 1]], r[7], False) for i, r in enumerate(rows)]
        return pd.DataFrame(out, columns=["block", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "at", "n", "whole"])

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tool, rows, size = aligner(a_path, b_path), [], 0
        blocks = itertools.count(TaskContext.get().partitionId() << 32)
        for f in frames:
            texts = [t if isinstance(t, str) else "" for t in f["text"]]
            given = (r for part in portions(texts, 1 << 20) for r in _documents(tool, part))
            rows += [(i, *r) for i, r in zip(f["id"], given, strict=True)]
            size += sum(map(len, texts))
            if size >= block_chars:
                yield blocked(rows, next(blocks))
                rows, size = [], 0
        if rows:
            yield blocked(rows, next(blocks))
        tool.known, tool.older = {}, {}  # the worker lives on
        give_back_memory()

    def score(docs: pd.DataFrame, judged: pd.DataFrame) -> pd.DataFrame:
        count, best = np.zeros(len(judged), np.int64), np.zeros(len(judged), bool)
        count[judged["at"]], best[judged["at"]] = judged["count"], judged["best"]
        out = docs[["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]].copy()
        each = [(np.asarray(p, np.int64), np.asarray(n, np.int64)) for p, n in zip(docs["at"], docs["n"], strict=True)]
        out["n_best"] = [int(n[best[p]].sum()) for p, n in each]
        out["count_sum"] = [int((n * count[p]).sum()) for p, n in each]
        return out

    made = saved(docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInPandas(work, _MADE), "aligned")
    pairs = made.where("whole").select(F.col("block").alias("of"), F.posexplode(F.arrays_zip("pairs", "n")).alias("at", "p")).select("of", "at", F.col("p.pairs").alias("pair"), F.col("p.n").alias("n"))
    counts = saved(pairs.groupBy("pair").agg(F.sum("n").alias("count")).withColumn("a", F.shiftright("pair", 32)), "pair-counts")
    most = counts.groupBy("a").agg(F.max("count").alias("most"))
    judged = pairs.select("of", "at", "pair").join(counts.join(most, "a").select("pair", "count", (F.col("count") == F.col("most")).alias("best")), "pair").drop("pair")
    rows = made.where("not whole").select("block", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "at", "n")
    schema = "id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    out = rows.groupBy("block").cogroup(judged.groupBy("of")).applyInPandas(score, schema)
    return out.select(F.col("id").cast(docs.schema[id_col].dataType).alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
