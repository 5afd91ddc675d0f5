"""Each operator on hand-made rows: nulls, empty and long texts, ties, repeats, clashing columns, and against brute force."""

import base64
import collections
import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest

from gridloom.llm import imatch, langid, mixing, ngram_lm, toxicity, warc
from gridloom.llm.bpe import Bpe, bpe_encode
from gridloom.llm.components import components
from gridloom.llm.exact_dedup import exact_dedup
from gridloom.llm.line_dedup import dedup_lines
from gridloom.llm.minhash import near_duplicates

DOCS = "doc_id long, text string"
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))


def corpus(seed=5, groups=4):
    """Near copies, exact copies, null, empty, blank and very long texts, with repeated long lines."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7)))
    out = [None, "", "", " \n\t ", "one", "Two words", "A B C D", "a b c d"]
    shared = [" ".join(word() for _ in range(14)) for _ in range(3)]
    for _ in range(groups):
        base = [word() for _ in range(rng.choice([40, 120]))]
        for v in range(12):
            t = list(base)
            for _ in range(rng.randrange(0, 6)):
                t[rng.randrange(len(t))] = word()
            out.append(" ".join(t) + ("\n  " + shared[v % 3].upper() if v % 2 else "") + "\n" * (v % 3))
        out.append(" ".join(base))
        out.append(" ".join(base))
    out.append(" ".join(word() for _ in range(30000)))
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(corpus())), DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_exact_dedup_keeps_the_largest_id(spark, docs, empty):
    got = {r.doc_id: r for r in exact_dedup(docs).collect()}
    groups = collections.defaultdict(list)
    for i, t in enumerate(corpus()):
        groups[t or ""].append(i)
    for t, ids in groups.items():
        for i in ids:
            assert (got[i].keep_id, got[i].group_size, got[i].kept, got[i].text_sha256) == (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())
    assert exact_dedup(empty).count() == 0
    odd = spark.createDataFrame([(None, "x", 1), (3, "x", 2), (3, "x", 3), (None, "only", 4)], DOCS + ", keep_id int")
    rows = sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept) for r in exact_dedup(odd).collect())
    assert rows == [("3", "3", 3, True), ("3", "3", 3, True), ("None", "3", 3, False), ("None", "None", 1, True)]


def test_line_dedup_against_brute_force(docs, empty, spark):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    holders = collections.defaultdict(set)
    for i, t in enumerate(corpus()):
        for line in (t or "").split("\n"):
            if len(key(line)) >= 40:
                holders[key(line)].add(i)
    lost = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    assert lost
    for r in dedup_lines(docs).collect():
        lines = (corpus()[r.doc_id] or "").split("\n")
        stay = [x for x in lines if key(x) not in lost or lost[key(x)] == r.doc_id]
        assert (r.text, r._n_lines, r._n_dropped) == ("\n".join(stay), len(lines), len(lines) - len(stay))
    assert dedup_lines(empty).count() == 0
    odd = spark.createDataFrame([(None if i == 0 else 7, "x" * 50, "k", 1, 2, 3, 4) for i in range(6)], DOCS + ", _lost string, _lost_id int, _LOST0 int, id int, _n_lines int")
    got = dedup_lines(odd)
    assert got.columns == ["doc_id", "text", "_lost", "_lost_id", "_LOST0", "id", "_n_lines", "_n_dropped"]
    assert sorted(r._n_dropped for r in got.collect()) == [0] * 5 + [1] and {(r._lost, r._lost_id) for r in got.collect()} == {("k", 1)}


def test_filters_in_parts(spark):
    """Past the slots of one filter the keys are dealt to several: the same results, and still only suspects go on."""
    from pyspark.sql import functions as F

    from gridloom.llm.common import Repeats

    keys = spark.range(20000, numPartitions=4).select(F.xxhash64(F.when(F.col("id") < 400, F.col("id") % 200).otherwise(F.col("id"))).alias("h"))
    hashes = lambda b: b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
    h = np.array([r.h for r in keys.collect()], np.int64).view(np.uint64)
    for most, parts in ((1 << 16, 8), (1 << 27, 1)):
        r = Repeats(keys, hashes, 20000, 16, most)
        flag = r(h)
        assert len(r.twice) == parts and flag[:400].all() and flag[400:].mean() < 0.02


def test_results_do_not_depend_on_the_filters(spark, docs):
    small = {"most_slots": 1 << 9}
    rows = lambda df: sorted(map(str, df.collect()))
    assert rows(exact_dedup(docs, **small)) == rows(exact_dedup(docs))
    assert rows(dedup_lines(docs, most_slots=1 << 12)) == rows(dedup_lines(docs))
    assert rows(near_duplicates(docs, most_slots=1 << 14)) == rows(near_duplicates(docs))


def brute_components(texts, k, percent):
    sets = {}
    for i, t in enumerate(texts):
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates_against_brute_force(docs, k):
    comp, sizes = brute_components(corpus(), k, 80)
    for r in near_duplicates(docs, k=k).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (sizes[r.doc_id], comp[r.doc_id], comp[r.doc_id] == r.doc_id)


def template_pairs():
    """Pairs a little over the threshold in one group that shares long boilerplate and is otherwise a little under it."""
    for i in range(120):
        yield [f"b{j}" for j in range(354)] + [f"p{i % 60}-{j}" for j in range(4)] + [f"o{i}-{j}" for j in range(42)]


def borderline_copies():
    """Edited copies of one text, of which few are near enough to each other."""
    rng = random.Random(3)
    for _ in range(300):
        yield [f"w{j}" if rng.random() > 0.084 else f"v{j}" for j in range(400)]


@pytest.mark.parametrize("made", [template_pairs, borderline_copies])
def test_near_duplicates_of_mixed_tables(spark, made):
    sets = [set(ws) for ws in made()]
    parent = list(range(len(sets)))

    def top(i):
        return i if parent[i] == i else top(parent[i])

    for a in range(len(sets)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    assert 20 < len({top(i) for i in range(len(sets))}) < len(sets) - 20
    docs = spark.createDataFrame([(i, " ".join(ws)) for i, ws in enumerate(made())], DOCS)
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, k=1).collect()} == {i: top(i) for i in range(len(sets))}


def test_near_duplicates_of_edited_copies(spark):
    """700 copies of 400 words with seven edits each, in one group: few pairs link, and most by others."""
    rng, texts = random.Random(1), []
    for _ in range(700):
        ws = [f"w{j}" for j in range(400)]
        for at in rng.sample(range(0, 400, 4), 7):
            ws[at] = f"e{rng.randrange(10**9)}"
        texts.append(" ".join(ws))
    comp, _ = brute_components(texts, 4, 80)
    assert 1 < len(set(comp.values())) < 100
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    assert {r.doc_id: r.component_id for r in near_duplicates(docs).collect()} == comp


def test_near_duplicates_of_odd_tables(spark, empty):
    assert near_duplicates(empty).count() == 0
    odd = spark.createDataFrame([(None, "a b c d e"), (2, "a b c d e"), (9, "a b c d e"), (9, "a b c d e")], DOCS)
    assert sorted((str(r.doc_id), str(r.component_id), r.kept) for r in near_duplicates(odd).collect()) == [("2", "2", True), ("9", "2", False), ("9", "2", False), ("None", "None", True)]


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(3000)] + [(10000, 10000 + i) for i in range(1, 50)] + [(50000, 50000)]
    random.Random(1).shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(3001)}, **{10000 + i: 10000 for i in range(50)}}


def test_warc_round_trip(spark):
    html = ["<p>one</p>", "<p>two é</p>", "<p>one</p>", "", None, "<p>one</p>", "x" * 300_000]
    pages = spark.createDataFrame([(i, None if i == 1 else f"http://a/{i}\r\nX: y", h) for i, h in enumerate(html)], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.warc_round_trip(pages, roll_bytes=1000).collect()}
    assert len(got) == len(html)
    for i, h in enumerate(html):
        raw, last = (h or "").encode(), max(j for j, x in enumerate(html) if (x or "") == (h or ""))
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (got[i].record_type, got[i].refers_to) == (("response", None) if i == last else ("revisit", last))
        assert got[i].payload is None if i != last else bytes(got[i].payload) == raw
    assert warc.warc_round_trip(pages.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, None, "x", 1), ("null", "u", "x", 2), ("a>\r\nb c", "u", "y", 3), ("", "u", "z", 4), ("k", "u", "x", 5), ("k", "u", "x", 6)], "page_id string, url string, html string, sha string")
    back = sorted((str(r.page_id), r.record_type, r.refers_to) for r in warc.warc_round_trip(odd).collect())
    assert back == sorted([("None", "revisit", "null"), ("null", "response", None), ("a>\r\nb c", "response", None), ("", "response", None), ("k", "revisit", "null"), ("k", "revisit", "null")])
    few = {r.page_id: r.record_type for r in warc.warc_round_trip(pages, min_bytes=5).collect()}
    assert few[3] == few[4] == "response" and few[0] == "revisit"


def test_archive_is_plain_zstandard():
    import struct

    import zstandard

    data = warc.archive_bytes([b"WARC/1.1\r\n" + bytes([65 + i % 26]) * 500 for i in range(300)])
    magic, size = struct.unpack_from("<II", data)
    assert magic == 0x184D2A5D
    frame = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8 : 8 + size])).decompress(data[8 + size :])
    assert frame.startswith(b"WARC/1.1\r\nA")


def test_fingerprints(spark, docs, empty):
    got = {r.doc_id: r for r in imatch.fingerprint_and_edit(docs).collect()}
    texts = [t or "" for t in corpus()]
    for i, t in enumerate(texts):
        nxt, cut = texts[(i + 1) % len(texts)], len(t) // 4
        assert got[i].n_chars == len(t)
        assert got[i].edited_sha256 == hashlib.sha256((t[: len(t) - cut] + nxt[:cut]).encode()).hexdigest()
        assert 0 <= got[i].near_edited <= 1 and 0 <= got[i].near_next <= 1
    for a, b in itertools.combinations(range(len(texts)), 2):
        if texts[a] == texts[b]:
            assert got[a].fingerprint == got[b].fingerprint
    assert imatch.fingerprint_and_edit(empty).count() == 0
    one = imatch.fingerprint_and_edit(spark.createDataFrame([(5, "just one text here")], DOCS)).first()
    assert one.near_next == 1.0


def test_fingerprints_against_a_slow_version(spark, docs):
    """The lexicon's band, the subsets and the likeness, told by plain Python from Spark's own hashes of words."""
    from pyspark.sql import functions as F

    texts = [t or "" for t in corpus()]
    split = [[w for w in re.split(r"[\W_]+", t.lower()) if w] for t in texts]
    names = sorted({w for ws in split for w in ws} | set(texts))
    code = {r.w: r.h for r in spark.createDataFrame([(w,) for w in names], "w string").select("w", F.xxhash64("w").alias("h")).collect()}
    df = collections.Counter(w for ws in split for w in set(ws))
    most = max(2, int(len(texts) * 0.05))
    held = {code[w] for w in df if 2 <= df[w] <= most}
    lex = imatch.Lexicon(docs)
    bits = {h & lex.bits - 1 for h in held}
    terms = []
    for t, ws in zip(texts, split, strict=True):
        every = sorted({code[w] for w in ws})
        inside = [h for h in every if h & lex.bits - 1 in bits]
        assert held.intersection(every) <= set(inside)  # no term of the band is left out
        terms.append(inside if len(inside) >= 8 else every if every else [code[t]])
    levels = {i: [[[h for h in ts if (h % 2**64 >> 22 + 7 * i) & n - 1 == j] for j in range(16)] for ts in terms] for i, n in enumerate(imatch.LEVELS)}
    flat = [[h for i in levels for h in (levels[i][d])] for d in range(len(texts))]
    sets = spark.createDataFrame([(d, k, s) for d, f in enumerate(flat) for k, s in enumerate(f)], "d int, k int, s array<long>")
    digits = {(r.d, r.k): "------" if not r.s else f"{r.h % 2**64:016X}"[-6:] for r in sets.select("*", F.xxhash64("s").alias("h")).collect()}
    want = ["".join(digits[d, k] for k in range(80)) for d in range(len(texts))]
    got = {r.doc_id: r for r in imatch.fingerprint_and_edit(docs).collect()}
    assert [got[d].fingerprint for d in range(len(texts))] == want

    def near(a, b):
        if a == b:
            return 1.0
        parts = lambda f, i: [f[6 * (16 * i + j) : 6 * (16 * i + j) + 6] for j in range(16)]
        of = lambda x, y: sum(p == q != "------" for p, q in zip(x, y, strict=True)) / max(6, sum(p != "------" or q != "------" for p, q in zip(x, y, strict=True)))
        return max(of(parts(a, i), parts(b, i)) for i in range(5))

    for d in range(len(texts)):
        assert got[d].near_next == pytest.approx(near(want[d], want[(d + 1) % len(want)]))
        assert got[d].near_edited == pytest.approx(near(want[d], got[d].edited_fingerprint))


def test_fingerprints_of_odd_tables(spark, docs):
    from pyspark.sql import functions as F

    plain = {f"k{r.doc_id:05d}": tuple(r)[1:] for r in imatch.fingerprint_and_edit(docs).collect()}
    named = docs.select(F.format_string("k%05d", "doc_id").alias("doc_id"), "text", F.lit(1).alias("_b"), F.lit(2).alias("fingerprint"))
    assert {r.doc_id: tuple(r)[1:] for r in imatch.fingerprint_and_edit(named).collect()} == plain
    odd = spark.createDataFrame([(None, "first one"), (3, "b"), (3, "a"), (3, None)], DOCS)
    rows = imatch.fingerprint_and_edit(odd).collect()
    assert sorted(str(r.doc_id) for r in rows) == ["3", "3", "3", "None"] and all(r.near_edited is not None for r in rows)
    words_only = odd.withColumn("doc_id", F.col("doc_id").cast("string"))
    assert sorted(str(r.doc_id) for r in imatch.fingerprint_and_edit(words_only).collect()) == ["3", "3", "3", "None"]


def test_order_of_sparse_ids(spark):
    ids = [2**40, -7, 3, 2**41, 12, 13, 14]
    df = spark.createDataFrame([(i, f"t{i}") for i in ids], DOCS)
    got = {r.doc_id: r.next_text for r in imatch.in_order(df, "doc_id", "text", ["text"], per_bucket=1).collect()}
    s = sorted(ids)
    assert got == {a: f"t{b}" for a, b in zip(s, s[1:] + s[:1], strict=True)}


def test_language_model_against_brute_force(spark, docs):
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    from pyspark.sql import functions as F

    got = {r.doc_id: r for r in ngram_lm.score_documents(docs, F.crc32(F.col("doc_id").cast("string")) % 10 != 0, block_chars=3000, bucket_bytes=20000).collect()}
    toks = {i: [*words(t), None] for i, t in enumerate(corpus())}
    train = [i for i in toks if not held(i)]
    c = collections.Counter(w for i in train for w in toks[i])
    n, v = sum(c.values()), len(c)
    pairs = collections.Counter(p for i in train for p in itertools.pairwise(["<", *toks[i]]))
    triples = collections.Counter(p for i in train for p in zip(["<", *toks[i]], toks[i], toks[i][1:], strict=False))
    begun = collections.Counter(c)
    begun["<"] = len(train)
    once, twice = (sum(x == k for x in c.values()) for k in (1, 2))
    d, (a2, a3) = min(0.95, max(0.05, once / max(1, once + 2 * twice))), ngram_lm.PRIOR
    p1 = lambda w: (c[w] - d) / n if c[w] else d * v / n
    p2 = lambda a, w: (pairs[a, w] + a2 * p1(w)) / (begun[a] + a2)
    p3 = lambda a, b, w: (triples[a, b, w] + a3 * p2(b, w)) / (pairs[a, b] + a3)
    for i, ts in toks.items():
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(ts), sum(c[w] > 0 for w in ts), n)
        want = math.log10(p2("<", ts[0])) + sum(math.log10(p3(*x)) for x in zip(["<", *ts], ts, ts[1:], strict=False))
        assert got[i].score == pytest.approx(want, rel=1e-9)
        assert got[i].base_score == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ts), rel=1e-9)
    some = next(p for p in pairs if p[1] is not None)
    for p in (lambda w: p2("<", w), lambda w: p2("one", w), lambda w: p3(*some, w)):  # a state's probabilities sum to 1, unknown words as one class
        assert sum(map(p, c)) + p("unknown") == pytest.approx(1)


def test_automaton_follows_failure_arcs():
    texts = ["a b c", "a b d", "b c e", "x b c"]
    block = ngram_lm.Block(texts)
    learn = np.repeat([True, True, True, False], block.sizes)
    model = ngram_lm.Automaton(block, block.counts(learn), 12, 6, 1, 1, (2.0, 1.0))
    place = {w: int(np.searchsorted(block.words, ngram_lm.xxhash.xxh3_64_intdigest(w.encode()))) for w in "abcdex"}
    go = lambda state, w: tuple(int(z[0]) if k == 0 else float(z[0]) for k, z in enumerate(model.step(np.array([state], np.int32), np.array([place[w]], np.int32))))
    state, _ = go(0, "a")
    assert state == 1 + place["a"]
    state, _ = go(state, "b")
    assert state > 1 + len(block.words)  # the pair a b has a state
    after, weight = go(state, "e")  # neither "a b e" nor "b e" was seen: two failure arcs, then the root's arc
    assert after == 1 + place["e"]
    assert weight == pytest.approx(model.failure[state] + model.failure[1 + place["b"]] + model.root[place["e"]])
    assert go(0, "x")[0] == 0  # a word that training lacks is no context
    long = "a b c d e " * 700
    block = ngram_lm.Block([long, "a b"])
    model = ngram_lm.Automaton(block, block.counts(np.ones(len(block.tokens), bool)), len(block.tokens), 6, 1, 1, (2.0, 1.0))
    assert model.traverse(block, longest=10) == pytest.approx(model.traverse(block, longest=10**6))


def test_language_model_without_training(spark, docs, empty):
    from pyspark.sql import functions as F

    assert ngram_lm.score_documents(empty, F.lit(True)).count() == 0
    rows = ngram_lm.score_documents(docs, F.lit(False)).collect()
    assert {(r.train_tokens, r.n_known, r.score) for r in rows} == {(0, 0, 0.0)}


TOKENIZER = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


def test_bpe_agrees_with_the_library(spark):
    from tokenizers import Tokenizer

    t, own, rng = Tokenizer.from_file(TOKENIZER), Bpe(TOKENIZER, cache_words=50), random.Random(2)
    parts = ["a", "the", " ", "  ", "\n", "'s", "1", "23", "é", "漢字", "🙂", "\x1c", "\x85", "\xa0", "<|endoftext|>", "!!", "Ġ", "\r\n", "\x00", "aaaa", "ing", "Xyz"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(40))) for _ in range(2000)] + [t or "" for t in corpus()] + ["z" * 5000, "ab" * 3000]
    want = [e.ids for e in t.encode_batch(texts, add_special_tokens=False)]
    got = [np.frombuffer(x, "<u4").tolist() for x in own.encode_batch(texts)]
    assert got == want
    assert [own.decode(np.array(w, "<u4").tobytes()) for w in want[:500]] == t.decode_batch(want[:500], skip_special_tokens=False)
    df = spark.createDataFrame([(1, None, 5), (2, "hello hello", 6)], DOCS + ", ids int")
    rows = {r.doc_id: r for r in bpe_encode(df, TOKENIZER, decode=True).collect()}
    assert (rows[1].n_tokens, bytes(rows[1].ids), rows[1].decoded) == (0, b"", "") and rows[2].decoded == "hello hello"
    assert bpe_encode(df.limit(0), TOKENIZER).count() == 0


def test_language_id_against_brute_force(spark):
    """Trigrams of letters with gaps, each letter's own vector rotated by place and multiplied, sums, and cosines."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcäß Жщ漢.1\x00") for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["ABC abc", "Ж" * 9000, None]
    rows = [(i, t, "xyz"[i % 3] if i % 7 else None) for i, t in enumerate(texts)]
    vector = lambda cp: np.random.default_rng([7, cp]).integers(0, 2, 512, np.int8).astype(int) * 2 - 1

    def bundle(t):
        out, symbols = np.zeros(512), [0]
        for ch in t or "":
            symbols.append(ord(ch.lower()[0]) if ch.isalpha() else 0)
        symbols = [x for x, before in zip([*symbols, 0], [1, *symbols], strict=True) if x or before]
        for (a, b, c), k in collections.Counter(x for x in zip(symbols, symbols[1:], symbols[2:], strict=False) if x[1]).items():
            out += k * np.roll(vector(a), 2) * np.roll(vector(b), 1) * vector(c)
        return out

    want = {x: sum(bundle(t) for _, t, lang in rows if lang == x) for x in "xyz"}
    df = spark.createDataFrame(rows, DOCS + ", lang string")
    got = langid.learn_profiles(df)
    assert {x: v.tolist() for x, v in got.items()} == {x: v.tolist() for x, v in want.items()}
    clash = df.selectExpr("*", "1 as _text")
    for r in langid.predict_language(clash, got, ["doc_id", "_text"]).collect():
        v = bundle(texts[r.doc_id])
        if not v.any():
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        cos = {x: v @ w / np.linalg.norm(v) / np.linalg.norm(w) for x, w in want.items()}
        assert r.lang_pred == max(sorted(cos), key=cos.get) and r.score == pytest.approx(max(0.0, max(cos.values())), abs=1e-6)


def test_language_id_on_held_out_texts(spark, empty):
    rng = random.Random(3)
    made = {"xx": ["lor", "em", "ipsum"], "yy": ["zhu", "kra", "òt"], "zz": ["qwe", "rty"]}
    text = lambda x: " ".join("".join(rng.choice(made[x]) for _ in range(3)) for _ in range(rng.randint(3, 40)))
    rows = [(i, text(x), x) for i in range(120) for x in [rng.choice(list(made))]]
    df = spark.createDataFrame([*rows, (900, None, "xx"), (901, "12 .. 3", "xx"), (902, "", None), (903, "lorem", None)], DOCS + ", lang string")
    profiles = langid.learn_profiles(df.where("doc_id % 4 <> 2"))
    got = {r.doc_id: r for r in langid.predict_language(df, profiles, ["doc_id"]).collect()}
    assert all(got[i].lang_pred == x for i, _, x in rows) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "xx"]
    assert langid.learn_profiles(df.limit(0)) == {}
    assert {r.lang_pred for r in langid.predict_language(df, {}, ["doc_id"]).collect()} == {"und"}


def test_spelling_model_against_brute_force():
    """Interpolated Kneser-Ney by its definition, with dictionaries, for two classes over shared lower orders."""
    rng = random.Random(8)
    vocabulary = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(1, 11))) for _ in range(300)})
    counts = np.array([[rng.choice([0, 0, 1, 3]) for _ in vocabulary], [rng.choice([0, 1, 1, 2]) for _ in vocabulary]])
    vocabulary, counts = [w for w, k in zip(vocabulary, counts.any(0), strict=True) if k], counts[:, counts.any(0)]
    n = toxicity.TOP
    # the letters up to each place but the word's begin; before that there is nothing
    runs = lambda w, k: [("\0" * (k - 1) + "<" + w + ">")[i : i + k] for i in range(1, len(w) + 2)]
    own = [collections.Counter() for _ in range(2)]
    for j, w in enumerate(vocabulary):
        for c in range(2):
            for r in runs(w, n):
                own[c][r] += int(counts[c, j])
    shared = {n: own[0] + own[1]}
    for k in range(n - 1, 0, -1):
        shared[k] = collections.Counter(r[1:] for r in shared[k + 1])  # how many letters come before

    def discounted(c):
        ones, twos = (sum(v == k for v in c.values()) for k in (1, 2))
        d, total, kinds = min(0.95, max(0.1, ones / max(1, ones + 2 * twos))), collections.Counter(), collections.Counter()
        for r, v in c.items():
            total[r[:-1]] += v
            kinds[r[:-1]] += v > 0
        return lambda r, low: (max(c[r] - d, 0) + d * kinds[r[:-1]] * low) / total[r[:-1]] if total[r[:-1]] else low

    orders, classes = {k: discounted(c) for k, c in shared.items()}, [discounted(c) for c in own]
    letters = len(shared[1])

    def ratio(w):
        out = 0.0
        for r in runs(w, n):
            p = 1 / (letters + 1)
            for k in range(1, n + 1):
                p = orders[k](r[n - k :], p)
            out += math.log(classes[1](r, p)) - math.log(classes[0](r, p))
        return out

    asked = vocabulary[:80] + ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 12))) for _ in range(40)]
    model = toxicity.SpellingModel(vocabulary, counts)
    assert model.ratios(asked) == pytest.approx([ratio(w) for w in asked], abs=2e-4)  # tables hold 32-bit numbers
    import pickle

    assert (pickle.loads(pickle.dumps(model)).ratios(asked) == model.ratios(asked)).all()


def test_toxicity_of_odd_tables(spark):
    from pyspark.sql import functions as F

    rows = [(i, "zorg zorg bad" if i % 2 else "plain words here", 1) for i in range(40)]
    df = spark.createDataFrame([*rows, (1, "zorg again", 2), (None, "zorg", 3), (99, "w" * 300_000 + " zorg", 4)], DOCS + ", toxic int")
    lab = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(1, 1), (None, 1), (7, 5), (8, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(df, lab, F.lit(True))
    got = toxicity.score_toxicity(df.withColumn("score", F.lit("x")), model)
    assert got.columns == ["doc_id", "text", "toxic", "score"] and got.count() == 43
    assert got.where("score is null or score < 0 or score > 1").count() == 0


def test_toxicity_learns_stems(spark):
    from pyspark.sql import functions as F

    rng = random.Random(4)
    word = lambda: "".join(rng.choice(["ta", "ri", "mo", "ne", "ku", "sel"]) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(400):
        ws, bad = [word() for _ in range(rng.randint(20, 60))], i % 5 == 0
        if bad:
            for _ in range(3):
                ws[rng.randrange(len(ws))] = "zorg" + word()
        rows.append((i, " ".join(ws)))
        labels.append((i, int(bad)))
    df, lab = spark.createDataFrame([*rows, (900, None), (901, "")], DOCS), spark.createDataFrame([*labels, (5, None)], "doc_id long, toxic int")
    model = toxicity.fit_toxicity(df, lab, F.col("doc_id") % 4 != 2)
    got = {r.doc_id: r.score for r in toxicity.score_toxicity(df, model).collect()}
    right = [(got[i] >= 0.3) == bool(y) for i, y in labels if i % 4 == 2]
    assert sum(right) >= 0.95 * len(right) and all(0 <= s <= 1 for s in got.values()) and got[900] == got[901]
    one = toxicity.fit_toxicity(df, lab.where("toxic = 0"), F.lit(True))
    assert {r.score for r in toxicity.score_toxicity(df, one).collect()} == {0.0}
    assert toxicity.score_toxicity(df.limit(0), model).count() == 0


def test_mixing_meets_its_targets(spark):
    rng = random.Random(6)
    texts = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "eps"]) for _ in range(50)) if i % 3 else "JUNK!! " * 50) for i in range(300)]
    df = spark.createDataFrame([*texts, (900, None)], DOCS)
    domains = spark.createDataFrame([(i, "good" if i % 3 else "poor") for i in range(0, 300, 2)] + [(1, None)], "doc_id long, domain string")
    targets = {"good": 0.5, "poor": 0.5}
    rows = mixing.mixing_rates(df, domains, targets, pull=1e-4).collect()
    total = sum(r._tokens for r in rows)
    for k in range(2):
        assert sum(r._rate * r._tokens * r._posteriors[k] for r in rows) / total == pytest.approx(0.5, abs=0.01)
    assert all(r._rate >= 0 for r in rows) and len(rows) == 301
    x = np.ones(len(rows))  # plain projected gradient, for long, comes to the same rates
    p, t = np.array([r._posteriors for r in rows]), np.array([r._tokens for r in rows]) / total
    for floor in (0.0, 1.0):
        rows = mixing.mixing_rates(df, domains, targets, pull=1e-2, floor=floor).collect()
        x = np.ones(len(rows))
        for _ in range(20000):
            x = np.maximum(floor, x - 0.9 * (p @ ((x * t) @ p - np.array([0.5, 0.5])) + 1e-2 * (x - 1)))
        assert [r._rate for r in rows] == pytest.approx(x.tolist(), abs=1e-6)
    clash = df.selectExpr("*", "1 as _times", "2 as _copy", "3 as _rate")
    kept = mixing.repeat_by_rate(mixing.mixing_rates(clash, domains, targets))
    assert kept.columns == ["doc_id", "text", "_times", "_copy"]
    twice = mixing.mixing_rates(df.unionByName(df), domains, targets).groupBy("doc_id").agg({"_rate": "count"}).collect()
    assert {r[1] for r in twice} == {2}
    kept = mixing.repeat_by_rate(mixing.mixing_rates(df, domains, targets, floor=1.0, scale=1.2))
    assert kept.select("doc_id").distinct().count() == 301 and kept.columns == ["doc_id", "text"]
    assert mixing.mixing_rates(df.limit(0), domains, targets).count() == 0
    lone = mixing.mixing_rates(df, domains.limit(0), targets).first()
    assert list(lone._posteriors) == [0.5, 0.5]
