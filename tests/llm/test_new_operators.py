"""Operators 11 to 13 against slow versions written from their contracts."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.llm import prefix_trie as trie_module
from gridloom.llm.align import Aligner, align_tokenizers, merge_ends
from gridloom.llm.prefix_trie import lend_heads, number_turns, prefix_trie
from gridloom.llm.queries import piece_path, tokenizer_path
from gridloom.llm.sharding import pack_shards, place

TURNS = "conv_id long, turn long, role string, text string, digest string, depth int, part int, h int"


# -- 11: prefix trie ----------------------------------------------------------------------------------


def slow_trie(turns):
    """Rebuilds conversations and walks a trie of Python tuples."""
    said = defaultdict(list)
    for c, turn, role, text, *_ in turns:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).digest()
            said[c].append(((turn is not None, turn or 0, tie), (role, text)))
    original = {c: [x for _, x in sorted(v, key=lambda r: r[0])] for c, v in said.items()}
    rebuilt = {}
    for c, own in original.items():
        h, lender = zlib.crc32(str(c).encode()) % 6, c - int(Decimal(c) % 100)  # Decimal's remainder has the sign of c
        rebuilt[c] = tuple(original.get(lender, [])[:h] + own[h:])
    members, ends = defaultdict(list), defaultdict(list)
    for c, v in rebuilt.items():
        ends[v].append(c)
        for d in range(len(v) + 1):
            members[v[:d]].append(c)
    children = Counter(v[:-1] for v in members if v)
    leaves, saves = Counter(), Counter()
    for v, m in members.items():
        for d in range(len(v) + 1):
            leaves[v[:d]] += not children[v]
            saves[v[:d]] += (len(m) - 1) * (len(v[-1][1]) if v else 0)
    digest = lambda v: hashlib.sha256(",".join(map(str, sorted(ends.get(v, [])))).encode()).hexdigest()
    return sorted((min(m), len(v), min(members[v[:-1]]) if v else None, len(m), children[v], leaves[v], saves[v], digest(v)) for v, m in members.items())


def fast_trie(spark, turns):
    df = spark.createDataFrame(turns, TURNS)
    out = prefix_trie(*lend_heads(number_turns(df)))
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    return sorted(tuple(r) for r in out.collect())


def more(rows):
    return [(*r, "x", 7, 8, 9) for r in rows]  # columns whose names the operator uses itself


def test_trie_equals_walked_trie_on_odd_rows(spark):
    r = random.Random(3)
    said = ["", "a", "b", None, "Ж\U0001f600", "a" * 300]
    rows = [(c, t, r.choice(["user", "assistant", None, ""]), r.choice(said)) for c in [*range(-130, -90), *range(95, 125), *range(300, 420)] for t in range(r.randint(1, 8))]
    rows += [(410, None, "user", "first"), (410, 3, "user", "tie"), (410, 3, "user", "tie"), (None, 0, "user", "lost"), (None, None, None, None), (5000, None, None, None), (10**17 + 99, 1, "a", "b")]
    rows += [(c, 0, "user", "copy") for c in range(10_000, 10_300)]
    r.shuffle(rows)
    assert fast_trie(spark, more(rows)) == slow_trie(rows)


def test_trie_of_long_conversations_crosses_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie_module, "BLOCK", 4)
    r = random.Random(4)
    rows = [(c, t, "user", "same" if t < 30 - c % 7 else str(r.randint(0, 2))) for c in range(1, 30) for t in range(r.choice([3, 4, 8, 9, 33, 40]))]
    assert fast_trie(spark, more(rows)) == slow_trie(rows)


def test_trie_of_no_conversation_is_empty(spark):
    assert fast_trie(spark, []) == [] == slow_trie([])
    assert fast_trie(spark, more([(None, 1, "user", "x")])) == []


# -- 12: sharding -------------------------------------------------------------------------------------

DOCS = "doc_id long, text string, shard int, slot int, size string, bytes int, task int, piece int, row int, law int"


def sharded(spark, rows, **kw):
    """Rows, after the promises that hold for every table: slots without gaps, sizes, checksums."""
    got = pack_shards(spark.createDataFrame([(i, t, 1, 2, "s", 3, 4, 5, 6, 7) for i, t in rows], DOCS), **kw).collect()
    slots = defaultdict(list)
    for g in got:
        slots[g.shard].append(g.slot)
        assert g.law == "bytes" and g.grown_shard is None
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in rows)
    assert Counter((g.doc_id, g.size, g.text_crc32) for g in got) == want
    return got


def spread(got, shards, of):
    total = Counter({k: 0 for k in range(shards)})
    for g in got:
        total[g.shard] += of(g)
    return max(total.values()) / max(1, min(total.values()))


def test_shards_balance_bytes_tokens_and_rows_over_many_packers(spark):
    r = random.Random(5)
    rows = [(i, " ".join(["w" * r.randint(1, 9)] * int(r.paretovariate(1.3) * 8))[:4000] + f" {i}") for i in range(6000)]
    words = {i: len(t.split()) for i, t in rows}
    got = sharded(spark, rows, packer_groups=1000)
    assert spread(got, 16, lambda g: g.size) < 1.02
    assert spread(got, 16, lambda g: 1) < 1.02
    assert spread(got, 16, lambda g: words[g.doc_id]) < 1.05


def test_equal_texts_share_a_shard_and_a_hot_group_is_split(spark):
    rows = [(i, f"text {i // 3} " + "x" * (i // 3 % 50)) for i in range(3000)] + [(10_000 + i, "the same text for a third of all rows") for i in range(1500)]
    got = sharded(spark, rows)
    by_text = defaultdict(set)
    texts = dict(rows)
    for g in got:
        by_text[texts[g.doc_id]].add(g.shard)
    assert all(len(v) == 1 for t, v in by_text.items() if t.startswith("text "))
    assert len(by_text["the same text for a third of all rows"]) > 8
    assert spread(got, 16, lambda g: g.size) < 1.05 and spread(got, 16, lambda g: 1) < 1.05


def test_odd_rows_get_shards(spark):
    assert sharded(spark, []) == []
    assert len({g.shard for g in sharded(spark, [(1, None), (2, ""), (None, None)] * 3)}) > 0
    got = sharded(spark, [(7, "again")] * 400)  # one repeated row
    assert spread(got, 16, lambda g: 1) < 1.05
    assert len(sharded(spark, [(1, "é" * 200_000), (2, "b"), (3, None)])) == 3


def test_place_takes_the_highest_dot_product():
    r = np.random.default_rng(6)
    sizes = r.integers(1, 50, (200, 3)).astype(float)
    got, left, share = place(sizes, 5), np.full((5, 3), 0.2), sizes / sizes.sum(0)
    for i in sorted(range(200), key=lambda i: (-share[i].max(), i)):
        dots = [sum(a * b for a, b in zip(left[k], share[i], strict=True)) for k in range(5)]
        assert dots[got[i]] == pytest.approx(max(dots))
        left[got[i]] -= share[i]


# -- 13: alignment ------------------------------------------------------------------------------------


def slow_alignment(rows):
    """Whole texts through both libraries, byte offsets as sets, every link listed."""
    import sentencepiece
    import tokenizers

    t = tokenizers.Tokenizer.from_file(tokenizer_path())
    t.encode_special_tokens = True
    s = sentencepiece.SentencePieceProcessor(model_file=piece_path())
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}

    def side_b(i):
        p = s.id_to_piece(i)
        return bytes([int(p[3:5], 16)]) if s.is_byte(i) else p.replace("▁", " ").encode()

    docs = []
    for i, text in rows:
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = s.encode(text) if text else []
        x, y = [bytes(letter[c] for c in t.id_to_token(k)) for k in a], [side_b(k) for k in b]
        raw = (" " + (text or "")).encode()
        groups = []
        if text and b"".join(x) == raw == b"".join(y):
            ends_a, ends_b = np.cumsum([len(k) for k in x]).tolist(), np.cumsum([len(k) for k in y]).tolist()
            begin = 0
            for cut in sorted({*ends_a} & {*ends_b}):
                groups.append(([k for k, e in zip(a, ends_a, strict=True) if begin < e <= cut], [k for k, e in zip(b, ends_b, strict=True) if begin < e <= cut]))
                begin = cut
        docs.append((i, groups, [(p, q) for u, v in groups for p in u for q in v]))
    counts = Counter(p for _, _, links in docs for p in set(links))
    most = defaultdict(int)
    for (p, _), n in counts.items():
        most[p] = max(most[p], n)
    out = []
    for i, groups, links in docs:
        text = ";".join(f"{','.join(map(str, u))}|{','.join(map(str, v))}" for u, v in groups)
        out.append((i, sum(len(u) for u, _ in groups), sum(len(v) for _, v in groups), len(groups), len(links), sum(counts[k] == most[k[0]] for k in links), sum(counts[k] for k in links), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def fast_alignment(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, 1, "x", 2, 3, None) for i, t in rows], "doc_id long, text string, block long, id string, n int, at int, pairs string")
    return sorted((tuple(r) for r in align_tokenizers(df, tokenizer_path(), piece_path(), **kw).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256").collect()), key=str)


ODD = [
    None, "", " ", "  ", "\n", "a", " lead", "trail ", "two  spaces", "tab\tand\r\nline\n\n end", "naïve café — “quotes”", "日本語のテキスト と 混ぜる", "emoji 👩‍👩‍👧 ok", "<|endoftext|> <s> </s> <unk>",
    "a▁b", "nul\x00byte", "\x1c\x1d x", "don't we'll I'M", "1234567890 3.14159", "x" * 5000, "aé" * 3000, "ﬁne ½ Å", " nbsp  x", "　wide space", "Привет мир " * 50, "#$%^&*()_+{}|:<>?", "é combining",
]


def test_alignment_equals_whole_texts_and_listed_links(spark):
    r = random.Random(7)
    alphabet = ["a", "th", "ing", " ", " ", "  ", "\n", ".", "é", "日", "▁", "7", "’", "\t", "Ж"]
    rows = list(enumerate(ODD)) + [(100 + i, "".join(r.choice(alphabet) for _ in range(r.randint(1, 80)))) for i in range(150)] + [(3, "a b c d a b"), (3, "a b c d a b"), (None, "the cat sat on the mat"), (None, None)]
    assert fast_alignment(spark, rows, block_chars=700) == slow_alignment(rows)


def test_alignment_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert fast_alignment(spark, rows) == slow_alignment(rows)
    assert fast_alignment(spark, []) == []


def test_two_pointers_meet_where_both_end():
    r = random.Random(8)
    for _ in range(100):
        a, b = (sorted(r.sample(range(1, 40), r.randint(0, 20))) for _ in range(2))
        p, q = merge_ends(np.array(a, np.int64), np.array(b, np.int64))
        assert list(zip(p, q, strict=True)) == [(a.index(x) + 1, b.index(x) + 1) for x in sorted({*a} & {*b})]


def test_both_encoders_of_side_a_agree_on_every_code_point():
    import tokenizers

    tool = Aligner(tokenizer_path(), piece_path())
    own = tokenizers.Tokenizer.from_file(tokenizer_path())
    own.encode_special_tokens = True
    for k in range(0, 0x110000, 40_000):
        texts = [f" a{c}b {c}{c} 1{c}2 {c} " for c in map(chr, range(k, min(k + 40_000, 0x110000))) if not 0xD800 <= ord(c) < 0xE000]
        assert tool.encode_a(texts) == [e.ids for e in own.encode_batch(texts, add_special_tokens=False)]


def test_string_ids_pass(spark):
    df = spark.createDataFrame([("b", "one two"), ("a", None)], "doc_id string, text string")
    assert sorted(r.doc_id for r in align_tokenizers(df, tokenizer_path(), piece_path()).collect()) == ["a", "b"]
    assert sorted(r.doc_id for r in pack_shards(df).collect()) == ["a", "b"]
    assert pack_shards(df, tokens=F.lit(None)).count() == 2
