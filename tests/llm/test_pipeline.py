"""The registered queries against their SQL, and the pipeline's promises on the small tables."""

import os

import duckdb
import pytest

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")


def test_queries_agree_with_their_sql(spark):
    from gridloom.llm import queries as q

    c = duckdb.connect()
    for table in ("documents", "conversations"):
        c.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    for name, sql in q.oracle_sql().items():
        df = q.queries()[name](spark, SF)
        got = c.sql(sql)
        cols = sorted(df.columns)
        assert cols == sorted(got.columns)
        at = [got.columns.index(x) for x in cols]
        assert sorted(str(tuple(r[x] for x in cols)) for r in df.collect()) == sorted(str(tuple(r[i] for i in at)) for r in got.fetchall())


def test_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, {r.doc_id for r in docs.collect()}
    for name, stage in p.STAGES:
        from gridloom.llm.common import saved

        docs = saved(stage(spark, docs, SF), name)
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        assert ids <= before and (name == "bpe" or docs.columns == columns)
        if name in ("lines", "mixing", "bpe"):
            assert ids == before  # nothing is dropped here
        before = ids
    assert docs.where("n_tokens is null or ids_sha256 is null").count() == 0


def test_stages_carry_columns_of_any_name(spark):
    """Names that the stages use themselves, in two spellings, come through with their values."""
    from pyspark.sql import functions as F

    import corpus_pipeline as p

    names = ["_toxic", "_Toxic1", "_n_lines", "_n_dropped", "_lost0", "_tokens", "_Posteriors", "_rate", "ids", "Decoded", "_own_ids", "n", "same", "sig", "rep", "id", "key", "component", "score", "up"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 60")
    odd = docs.withColumns({c: F.concat(F.lit(f"{k} "), F.col("doc_id").cast("string")) for k, c in enumerate(names)})
    for name, stage in p.STAGES:
        plain, got = stage(spark, docs, SF), stage(spark, odd, SF)
        assert got.columns == (odd.columns if name != "bpe" else [*odd.columns, "n_tokens", "ids_sha256", "decoded_sha256"])
        rows = got.collect()
        assert all(r[c] == f"{k} {r.doc_id}" for r in rows for k, c in enumerate(names))
        assert sorted((r.doc_id, r.text) for r in rows) == sorted((r.doc_id, r.text) for r in plain.collect())
    again = p.bpe(spark, docs.withColumns({"n_tokens": F.lit("x"), "ids_sha256": F.lit("y")}), SF)
    assert again.columns == [*docs.columns, "n_tokens", "ids_sha256", "decoded_sha256"] and dict(again.dtypes)["n_tokens"] == "bigint"


def test_near_dedup_of_rows_that_repeat_an_id(spark):
    import corpus_pipeline as p
    from gridloom.llm.minhash import near_duplicates

    a, b = (" ".join(f"{k}{i}" for i in range(60)) for k in "ab")
    rows = [(1, a), (5, a), (5, b), (9, b), (9, b), (20, "other words altogether here now"), (21, b + " more"), (30, ""), (30, a), (None, a), (None, b)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0, r.kept) for r in near_duplicates(docs, k=4, percent=80).collect())
    want = [(0, 57, 0, True)] * 2 + [(1, 57, 1, True)] + [(5, 57, 1, False)] * 2 + [(9, 57, 1, False)] * 2 + [(20, 2, 20, True), (21, 58, 1, False), (30, 0, 30, True), (30, 57, 1, False)]
    assert got == want
    kept = sorted((r.doc_id or 0, r.text) for r in p.near_dedup(spark, docs, SF).collect())
    assert kept == sorted([(0, a), (0, b), (1, a), (20, "other words altogether here now")])


@pytest.mark.parametrize("poor", [0.13, 0.5])
def test_mixing_meets_its_targets(spark, tmp_path, poor):
    import random

    import corpus_pipeline as p
    from gridloom.llm.mixing import mixing_rates, quality_domains

    rng = random.Random(4)
    rows = []
    for i in range(600):
        bad = i < 600 * poor
        ws = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(80)]
        if bad:
            ws = [w.upper() + "!!" if rng.random() < 0.3 else w for w in ws]
        rows.append((i, " ".join(ws), int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    docs.select("doc_id", "quality").write.parquet(f"{tmp_path}/labels.parquet")
    docs = docs.drop("quality")
    labels = quality_domains(spark.read.parquet(f"{tmp_path}/labels.parquet"))
    first = mixing_rates(docs, labels, p.TARGETS, scale=1.0, floor=1.0).collect()
    posterior = {r.doc_id: r._posteriors for r in first}
    got = p.mixing(spark, docs, str(tmp_path)).collect()
    share = [sum(posterior[r.doc_id][k] for r in got) / len(got) for k in (0, 1)]  # all texts have 80 tokens
    assert {r.doc_id for r in got} == set(posterior)
    assert abs(share[0] - p.TARGETS["good"]) < 0.02 and abs(share[1] - p.TARGETS["poor"]) < 0.02


def test_least_scale_of_soft_posteriors():
    import numpy as np
    from gridloom.llm.mixing import least_scale

    want = np.array([0.8, 0.2])
    for n, sure in ((0.13, 0.95), (0.4, 0.95), (0.5, 1.0)):
        p = np.array([[sure, 1 - sure], [1 - sure, sure]])
        shared = (p * np.array([1 - n, n])[:, None]).T @ p
        scale = least_scale(shared, want, 1.0)
        u = np.linalg.solve(shared, want) * scale
        assert (p @ u >= 1 - 1e-9).all() and np.allclose(shared @ u, scale * want)
    assert np.isclose(scale, 2.5)
    with pytest.warns(UserWarning):
        least_scale(np.full((2, 2), 0.25), want, 1.0)


def test_empty_documents_go_through(spark, tmp_path):
    import corpus_pipeline as p

    spark.read.parquet(f"{SF}/documents.parquet").limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    assert p.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_keeps_one_of_each_group(spark):
    import corpus_pipeline as p

    base = [[f"{g}w{j}" for j in range(100)] for g in range(4)]
    texts = [None, "", *(" ".join(ws[:at] + [f"x{at}"] + ws[at + 1 :]) for ws in base for at in (0, 50, 98)), "alone"]
    sets = [{tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if (ws := (t or "").split()) else set() for t in texts]
    near = lambda a, b: sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])
    kept = {i for i in range(len(texts)) if not any(near(i, j) for j in range(i))}  # every group here is a clique
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert len(kept) == 7 and {r.doc_id for r in p.near_dedup(spark, docs, "").collect()} == kept


@pytest.fixture(scope="module")
def odd(spark):
    """The small table's documents with null, empty and blank texts, null ids and fields, repeated rows and ids, and a column more."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "src1", 0), (10**6 + 2, " \n ", "en", "src1", 3), (None, "a text without an id", "en", None, 20), (10**6 + 3, "same id", "en", "s", 7), (10**6 + 3, "same id", "en", "s", 7)], docs.schema)
    return docs.unionByName(more).withColumn("_text", F.lit(1))


def test_toxicity_stage_against_each_score(spark, odd):
    import corpus_pipeline as p
    from gridloom.llm.queries import toxicity_held_out
    from gridloom.llm.toxicity import fit_toxicity

    model = fit_toxicity(odd, spark.read.parquet(f"{SF}/labels.parquet"), ~toxicity_held_out())
    want = [r for r in odd.collect() if model.scores([r.text or ""])[0] < 0.3]  # one text at a time
    got = p.toxicity(spark, odd, SF)
    assert got.columns == odd.columns and 0 < len(want) < odd.count()
    assert sorted(map(str, got.collect())) == sorted(map(str, want))


def test_lines_stage_against_brute_force(spark, odd):
    import collections

    import corpus_pipeline as p

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(lower)
    rows, holders = odd.collect(), collections.defaultdict(list)
    for r in rows:
        for k in {key(line) for line in (r.text or "").split("\n")}:
            if len(k) >= 40:
                holders[k].append(-1 if r.doc_id is None else r.doc_id)
    lost = {k: max(v) for k, v in holders.items() if len(v) >= 5}
    assert lost

    def of(r):
        lines = (r.text or "").split("\n")
        stay = [x for x in lines if key(x) not in lost or lost[key(x)] == r.doc_id]
        text = "\n".join(stay)
        return (r.doc_id, text, r.lang, r.source, r.n_chars if len(stay) == len(lines) else len(text), 1)

    got = p.lines(spark, odd, SF)
    assert got.columns == odd.columns
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(of, rows)))


def test_mixing_stage_against_its_rates(spark, odd):
    import collections
    import math

    import corpus_pipeline as p
    from gridloom.llm.mixing import mixing_rates, quality_domains

    rated = mixing_rates(odd, quality_domains(spark.read.parquet(f"{SF}/labels.parquet")), p.TARGETS, scale=None, floor=1.0).collect()
    got = p.mixing(spark, odd, SF)
    assert got.columns == odd.columns
    times = collections.Counter(str(tuple(r)) for r in got.collect())
    each = collections.defaultdict(list)
    for r in rated:
        each[str(tuple(r[c] for c in odd.columns))].append(r._rate)
    assert set(times) == set(each)
    for k, rates in each.items():
        assert sum(math.floor(x) for x in rates) <= times[k] <= sum(math.floor(x) + 1 for x in rates)


def test_bpe_stage_against_the_library(spark, odd):
    import hashlib

    import corpus_pipeline as p
    import numpy as np
    from gridloom.llm.queries import tokenizer_path
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(tokenizer_path())
    library.no_truncation()
    library.no_padding()

    def of(r):
        ids = library.encode(r.text or "", add_special_tokens=False).ids
        sha = lambda b: hashlib.sha256(b).hexdigest()
        return (*r, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(library.decode(ids, skip_special_tokens=False).encode()))

    got = p.bpe(spark, odd, SF)
    assert got.columns == [*odd.columns, "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, map(of, odd.collect())))


def test_near_dedup_stage_against_brute_force(spark, odd):
    import collections

    import corpus_pipeline as p

    rows, sets = odd.collect(), collections.defaultdict(set)
    for r in rows:
        ws = (r.text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        ws = [w for w in __import__("re").split("[\x20\x09-\x0D]+", ws) if w]
        if ws and r.doc_id is not None:
            sets[r.doc_id] |= {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))}
    least = {i: i for i in sets}

    def top(i):
        while least[i] != i:
            i = least[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                least[y] = x
    want = [r for r in rows if r.doc_id not in sets or top(r.doc_id) == r.doc_id]
    assert len(want) < len(rows)
    got = p.near_dedup(spark, odd, SF)
    assert got.columns == odd.columns and sorted(map(str, got.collect())) == sorted(map(str, want))
