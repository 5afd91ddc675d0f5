"""Queries over feature grids: images of four rows of cells each."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from gridloom.functions import similarity as S
from gridloom.operators import grid as G
from gridloom.operators import segment as X
from gridloom.operators import tiles as TL
from gridloom.plans.bridge import GRID_SQL, GRID_WIDTH, grid
from gridloom.plans.registry import query
from gridloom.sources.label_images import label_images, read_label_images
from gridloom.sources.storage import new_folder

ROWS = 4
CELLS_SQL = f"""
cells AS (SELECT vec_id // {GRID_WIDTH * ROWS} AS image, vec_id AS node, (vec_id // {GRID_WIDTH}) % {ROWS} AS y, vec_id % {GRID_WIDTH} AS x, CAST(embedding AS DOUBLE[]) AS feat, label FROM embeddings),
edges AS (SELECT a.image, a.node AS src, b.node AS dst, a.feat AS fa, b.feat AS fb, list_cosine_similarity(a.feat, b.feat) AS sim FROM cells a JOIN cells b ON a.image = b.image AND ((b.y = a.y AND b.x = a.x + 1) OR (b.y = a.y + 1 AND b.x = a.x)))"""


def cells(spark, sf):
    g = grid(spark, sf)
    return g.select(F.expr(f"node div {GRID_WIDTH * ROWS}").alias("image"), "node", (F.col("y") % ROWS).alias("y"), "x", "feat", "label")


def edges(spark, sf, kind="cosine"):
    return G.neighbour_edges(cells(spark, sf), S.similarity(kind))


@query("j17_neighbour_edges", f"WITH {CELLS_SQL} SELECT image, src, dst, round(sim, 6) AS sim FROM edges")
def j17(spark, sf):
    return edges(spark, sf).withColumn("sim", F.round("sim", 6))


L2 = "sqrt(list_sum(list_transform(list_zip(fa, fb), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))"
SIMS = {
    "cosine": "sim",
    "correlation": "list_cosine_similarity(list_transform(fa, lambda e: e - list_avg(fa)), list_transform(fb, lambda e: e - list_avg(fb)))",
    "dot": "list_dot_product(fa, fb)",
    "neg_sq_euclidean": f"-pow({L2}, 2)",
    "neg_euclidean": f"-{L2}",
    "neg_normalized_euclidean": "-sqrt(greatest(0, 2 - 2 * sim))",
    "neg_manhattan": "-list_sum(list_transform(list_zip(fa, fb), lambda z: abs(z[1] - z[2])))",
    "rbf": f"exp(-pow({L2}, 2) / 64)",
}
for _kind, _sql in SIMS.items():

    @query(f"sim_{_kind}", f"WITH {CELLS_SQL} SELECT src, dst, round({_sql}, 5) AS s FROM edges")
    def _sim(spark, sf, kind=_kind):
        return edges(spark, sf, kind).select("src", "dst", F.round("sim", 5).alias("s"))


@query("dist_cosine_euclidean", f"WITH {CELLS_SQL} SELECT src, dst, round(1 - list_dot_product(fa, fb) / (sqrt(list_dot_product(fa, fa)) * sqrt(list_dot_product(fb, fb)) + 1e-8), 6) AS dc, round({L2}, 5) AS de FROM edges")
def distances(spark, sf):
    both = lambda a, b: F.struct(S.cosine_distance(a, b).alias("dc"), S.euclidean_distance(a, b).alias("de"))
    e = G.neighbour_edges(cells(spark, sf), both)
    return e.select("src", "dst", F.round("sim.dc", 6).alias("dc"), F.round("sim.de", 5).alias("de"))


@query("l2_normalize", "SELECT vec_id AS node, round(embedding[1] / sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda e: e * e))), 6) AS first, 1.0::DOUBLE AS norm FROM embeddings")
def l2_normalize(spark, sf):
    g = grid(spark, sf).select("node", S.normalized(F.col("feat")).alias("u"))
    return g.select("node", F.round(F.element_at("u", 1), 6).alias("first"), F.round(S.norm(F.col("u")), 6).alias("norm"))


@query("l2_normalize_all", "SELECT vec_id AS node, list_transform(CAST(embedding AS DOUBLE[]), lambda e: round(e / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 6)) AS unit FROM embeddings")
def l2_normalize_all(spark, sf):
    g = grid(spark, sf).select("node", S.normalized(F.col("feat")).alias("u"))
    # a negative entry that rounds to zero keeps its sign
    return g.select("node", F.transform("u", lambda e: F.signum(e) * F.abs(F.round(e, 6))).alias("unit"))


@query("j19_pairwise_in_label", f"WITH {CELLS_SQL} SELECT a.node AS a, b.node AS b, round(list_cosine_similarity(a.feat, b.feat), 6) AS sim FROM cells a JOIN cells b ON a.image = b.image AND a.label = b.label AND a.node < b.node")
def j19(spark, sf):
    c = cells(spark, sf)
    r = c.select("image", "label", F.col("node").alias("b"), F.col("feat").alias("fb"))
    p = c.select("image", "label", F.col("node").alias("a"), F.col("feat").alias("fa")).join(r, ["image", "label"]).where("a < b")
    return p.select("a", "b", F.round(S.cosine(F.col("fa"), F.col("fb")), 6).alias("sim"))


@query("a13_quantile_threshold", f"WITH {CELLS_SQL} SELECT image, round(quantile_cont(sim, 0.6), 6) AS threshold FROM edges GROUP BY image")
def a13(spark, sf):
    return G.quantile(edges(spark, sf), "sim", 0.6).withColumn("threshold", F.round("threshold", 6))


@query("a14_robust_min_max", f"WITH {CELLS_SQL}, q AS (SELECT image, quantile_cont(sim, 0.02) AS lo, quantile_cont(sim, 0.98) AS hi FROM edges GROUP BY image) SELECT src, dst, round(greatest(0.0, least(1.0, (sim - lo) / (hi - lo + 1e-8))), 5) AS sim FROM edges JOIN q USING (image)")
def a14(spark, sf):
    return G.robust_min_max(edges(spark, sf), "sim").select("src", "dst", F.round("sim", 5).alias("sim"))


PROTO_SQL = CELLS_SQL + """,
one AS (SELECT image, label, d, avg(feat[d]) AS v, max(feat[d]) AS m FROM cells, (SELECT unnest(range(1, 65)) AS d) GROUP BY ALL),
proto AS (SELECT image, label, list(v ORDER BY d) AS prototype, sum(m) AS peak FROM one GROUP BY ALL)"""


@query("a10_prototypes", f"WITH {PROTO_SQL} SELECT image, label, round(list_sum(prototype), 5) AS total, round(prototype[1], 6) AS first, round(peak, 5) AS peak FROM proto")
def a10(spark, sf):
    c = cells(spark, sf)
    p, m = G.prototypes(c, ["image", "label"]), G.prototypes(c, ["image", "label"], "max")
    j = p.join(m.withColumnRenamed("prototype", "peak"), ["image", "label"])
    return j.select("image", "label", F.round(S.total(F.col("prototype")), 5).alias("total"), F.round(F.element_at("prototype", 1), 6).alias("first"), F.round(S.total(F.col("peak")), 5).alias("peak"))


@query("a11_consistency", f"WITH {PROTO_SQL} SELECT image, label, round(avg(list_cosine_similarity(feat, prototype)), 6) AS consistency FROM cells JOIN proto USING (image, label) GROUP BY ALL")
def a11(spark, sf):
    return G.consistency(cells(spark, sf), ["image", "label"]).withColumn("consistency", F.round("consistency", 6))


@query("a12_edge_strength", f"WITH {CELLS_SQL} SELECT a.image, a.node, round(avg(1 - list_dot_product(a.feat, b.feat) / (sqrt(list_dot_product(a.feat, a.feat)) * sqrt(list_dot_product(b.feat, b.feat)) + 1e-8)), 6) AS strength FROM cells a JOIN cells b ON a.image = b.image AND ((b.y = a.y AND b.x = (a.x + 1) % {GRID_WIDTH}) OR (b.y = (a.y + 1) % {ROWS} AND b.x = a.x)) GROUP BY ALL")
def a12(spark, sf):
    return G.edge_strength(cells(spark, sf), S.cosine_distance, ROWS, GRID_WIDTH).withColumn("strength", F.round("strength", 6))


def reach(condition: str, extra: str = "") -> str:
    """Components by recursion over the edges where ``condition`` holds."""
    return CELLS_SQL.replace("WITH", "") + f""",
cut AS (SELECT image, round(quantile_cont(round(sim, 9), 0.6), 9) AS t FROM edges GROUP BY image),
kept AS (SELECT src AS a, dst AS b FROM edges JOIN cut USING (image) WHERE {condition}),
pair AS (SELECT a, b FROM kept UNION SELECT b, a FROM kept),
walk(node, other) AS (SELECT node, node FROM cells UNION SELECT w.node, pair.b FROM walk w JOIN pair ON pair.a = w.other),
comp AS (SELECT node, min(other) AS c FROM walk GROUP BY node){extra}"""


RELABEL = """,
sized AS (SELECT image, c, count(*) AS n, min(node) AS first FROM comp JOIN cells USING (node) GROUP BY ALL),
ranked AS (SELECT image, c, row_number() OVER (PARTITION BY image ORDER BY n DESC, first) AS r, n FROM sized)"""


@query("g1_components", f"WITH RECURSIVE {reach('round(sim, 9) >= 0.05')} SELECT node, c AS component FROM comp")
def g1(spark, sf):
    def least(feat, y, x):
        e = X.edges_of(y, x)
        return X.components(len(feat), e[X._cosines(feat, e) >= 0.05])

    return X.segment(cells(spark, sf), least).select("node", (F.col("image") * GRID_WIDTH * ROWS + F.col("label")).alias("component"))


TILED_SQL = f"""
WITH RECURSIVE {GRID_SQL},
near AS (SELECT a.node AS a, b.node AS b FROM grid a JOIN grid b ON a.label % 3 = b.label % 3 AND ((a.y = b.y AND abs(a.x - b.x) = 1) OR (a.x = b.x AND abs(a.y - b.y) = 1))),
walk(node, other) AS (SELECT node, node FROM grid UNION SELECT w.node, n.b FROM walk w JOIN near n ON n.a = w.other),
comp AS (SELECT node, min(other) AS c FROM walk GROUP BY node)"""


@query("g1_tiled_components", f"{TILED_SQL} SELECT node, c AS component FROM comp")
def g1_tiled(spark, sf):
    """The whole grid as one image of label classes, in tiles of four by four cells."""
    g = grid(spark, sf).select(F.lit(0).alias("image"), "y", "x", (F.col("label") % 3).alias("class"))
    c, row = TL.components(g, tile=4, value="class"), F.lit(1 << 31)
    return c.select((F.col("y") * GRID_WIDTH + F.col("x")).alias("node"), (F.floor(F.col("component") / row) * GRID_WIDTH + F.col("component") % row).alias("component"))


@query("g22_tiled_islands", f"{TILED_SQL}, sized AS (SELECT c, count(*) AS n FROM comp JOIN grid USING (node) WHERE label % 3 = 1 GROUP BY c) SELECT node FROM comp JOIN sized USING (c) WHERE n >= 4 OR ((SELECT max(n) FROM sized) < 4 AND c = (SELECT min(c) FROM sized WHERE n = (SELECT max(n) FROM sized)))")
def g22_tiled(spark, sf):
    """One class of that image without its islands of fewer than four cells."""
    g = grid(spark, sf).where("label % 3 = 1").select(F.lit(0).alias("image"), "y", "x")
    return TL.without_islands(g, 4, tile=4, connectivity=4).select((F.col("y") * GRID_WIDTH + F.col("x")).alias("node"))


@query("g2_greedy_graph", f"WITH RECURSIVE {reach('round(sim, 9) >= t', RELABEL)} SELECT node, CAST(r - 1 AS BIGINT) AS label FROM comp JOIN cells USING (node) JOIN ranked USING (image, c)")
def g2(spark, sf):
    return X.segment(cells(spark, sf), "greedy_graph", q=0.6).select("node", "label")


@query("g3_cut_graph", f"WITH RECURSIVE {reach('1 - round(sim, 9) <= 0.95', RELABEL)} SELECT node, CAST(coalesce(CASE WHEN n >= 2 THEN r END, 0) AS BIGINT) AS label FROM comp JOIN cells USING (node) JOIN ranked USING (image, c)")
def g3(spark, sf):
    return X.segment(cells(spark, sf), "cut_graph", cut=0.95, min_size=2).select("node", "label")


@query("f15_filter_small", f"WITH {CELLS_SQL}, n AS (SELECT image, label, count(*) AS n FROM cells GROUP BY ALL), k AS (SELECT image, label, row_number() OVER (PARTITION BY image ORDER BY label) AS new FROM n WHERE label > 0 AND n >= 10) SELECT node, CAST(coalesce(new, 0) AS INTEGER) AS label FROM cells LEFT JOIN k USING (image, label)")
def f15(spark, sf):
    return G.filter_small(cells(spark, sf).select("image", "node", "label"), 10).select("node", "label")


@query("k8_label_images", f"WITH {CELLS_SQL} SELECT image, y, x, CAST(label * 257 + 1 AS BIGINT) AS label FROM cells")
def k8_images(spark, sf):
    """Labels written as 16-bit images, a file of images for each task, and read back."""
    path = new_folder(spark, "label-images")
    c = cells(spark, sf).withColumn("label", F.col("label") * 257 + 1)
    label_images(c).write.parquet(path)
    return read_label_images(spark.read.schema("image long, png binary").parquet(path)).where("label > 0")  # 0: no cell


@query("w5_relabel_by_size", f"WITH {CELLS_SQL}, n AS (SELECT image, label, count(*) AS n, min(node) AS f FROM cells GROUP BY ALL), k AS (SELECT image, label, row_number() OVER (PARTITION BY image ORDER BY n DESC, f) AS new FROM n WHERE n >= 8) SELECT node, CAST(coalesce(new, 0) AS INTEGER) AS label FROM cells LEFT JOIN k USING (image, label)")
def w5(spark, sf):
    return G.relabel_by_size(cells(spark, sf).select("image", "node", "label"), min_size=8).select("node", "label")


@query("j18_touching_labels", f"WITH {CELLS_SQL} SELECT DISTINCT image, least(la, lb) AS a, greatest(la, lb) AS b FROM (SELECT e.image, p.label AS la, q.label AS lb FROM edges e JOIN cells p ON p.node = e.src JOIN cells q ON q.node = e.dst) WHERE la <> lb")
def j18(spark, sf):
    return G.touching(cells(spark, sf))


@query("g9_prototype_merge_links", f"WITH {PROTO_SQL} SELECT a.image, a.label AS a, b.label AS b FROM proto a JOIN proto b ON a.image = b.image AND a.label < b.label WHERE round(list_cosine_similarity(a.prototype, b.prototype), 9) >= 0.1")
def g9(spark, sf):
    p = G.prototypes(cells(spark, sf), ["image", "label"])
    q = p.select("image", F.col("label").alias("b"), F.col("prototype").alias("pb"))
    return p.join(q, "image").where("label < b").where(F.round(S.cosine(F.col("prototype"), F.col("pb")), 9) >= 0.1).select("image", F.col("label").alias("a"), "b")


@query("g11_adjacent_merge_links", f"WITH {PROTO_SQL}, t AS (SELECT DISTINCT e.image, least(p.label, q.label) AS a, greatest(p.label, q.label) AS b FROM edges e JOIN cells p ON p.node = e.src JOIN cells q ON q.node = e.dst WHERE p.label <> q.label) SELECT t.image, t.a, t.b FROM t JOIN proto x ON x.image = t.image AND x.label = t.a JOIN proto y ON y.image = t.image AND y.label = t.b WHERE round(list_cosine_similarity(x.prototype, y.prototype), 9) >= 0.05")
def g11(spark, sf):
    c = cells(spark, sf)
    p = G.prototypes(c, ["image", "label"])
    side = lambda n: p.select("image", F.col("label").alias(n), F.col("prototype").alias(f"p{n}"))
    j = G.touching(c).join(side("a"), ["image", "a"]).join(side("b"), ["image", "b"])
    return j.where(F.round(S.cosine(F.col("pa"), F.col("pb")), 9) >= 0.05).select("image", "a", "b")


@query("g15_affinity", f"WITH {CELLS_SQL} SELECT a.node AS a, b.node AS b, round(CASE WHEN round(greatest(0, list_cosine_similarity(a.feat, b.feat)), 9) >= 0.1 THEN list_cosine_similarity(a.feat, b.feat) ELSE 0 END * 0.7 + exp(-((a.y - b.y)**2 + (a.x - b.x)**2) / 8.0::DOUBLE) * 0.3 + 1e-5, 5) AS w FROM cells a JOIN cells b ON a.image = b.image AND a.node < b.node")
def g15(spark, sf):
    return G.affinity(cells(spark, sf), 0.1, 2.0, 0.3).select("a", "b", F.round("w", 5).alias("w"))


@query("g16_binary_affinity", f"WITH {CELLS_SQL}, p AS (SELECT a.image, a.node AS a, b.node AS b, round(greatest(0, list_cosine_similarity(a.feat, b.feat)), 9) AS s FROM cells a JOIN cells b ON a.image = b.image AND a.node < b.node), t AS (SELECT image, round(quantile_cont(s, 0.9), 9) AS t FROM p GROUP BY image) SELECT a, b, CASE WHEN s > t THEN 1.0 ELSE 1e-5 END::DOUBLE AS w FROM p JOIN t USING (image)")
def g16(spark, sf):
    return G.binary_affinity(cells(spark, sf), 0.9).select("a", "b", "w")


@query("g18_kmeans_step", f"WITH {PROTO_SQL}, d AS (SELECT c.image, c.node, p.label AS centre, round(list_sum(list_transform(list_zip(c.feat, p.prototype), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) AS d FROM cells c JOIN proto p USING (image)) SELECT node, centre FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY d, centre) AS rn FROM d) WHERE rn = 1")
def g18(spark, sf):
    c = cells(spark, sf)
    centres = G.prototypes(c, ["image", "label"]).withColumnRenamed("label", "centre")
    return G.assign_to_centres(c, centres).select("node", "centre")


OBJ = "CAST(1 + node % 5 AS DOUBLE) / 5"


@query("g15_objectness_gate", f"WITH {CELLS_SQL}, o AS (SELECT *, {OBJ} AS obj FROM cells) SELECT a.node AS a, b.node AS b, round((CASE WHEN round(greatest(0, list_cosine_similarity(a.feat, b.feat)), 9) >= 0.1 THEN list_cosine_similarity(a.feat, b.feat) ELSE 0 END * 0.7 + exp(-((a.y - b.y)**2 + (a.x - b.x)**2) / 8.0::DOUBLE) * 0.3) * greatest(0.3, sqrt(a.obj * b.obj)) + 1e-5, 5) AS w FROM o a JOIN o b ON a.image = b.image AND a.node < b.node")
def g15_gate(spark, sf):
    c = cells(spark, sf).withColumn("obj", (1 + F.col("node") % 5).cast("double") / 5)
    return G.affinity(c, 0.1, 2.0, 0.3, objectness="obj", least_gate=0.3).select("a", "b", F.round("w", 5).alias("w"))


@query("g16_painted_affinity", f"WITH {CELLS_SQL}, p AS (SELECT a.image, a.node AS a, b.node AS b, a.label <> 0 AND b.label <> 0 AS free, round(greatest(0, list_cosine_similarity(a.feat, b.feat)), 9) AS s FROM cells a JOIN cells b ON a.image = b.image AND a.node < b.node), t AS (SELECT image, round(quantile_cont(s, 0.9), 9) AS t FROM p WHERE free GROUP BY image) SELECT a, b, CASE WHEN free AND s > t THEN 1.0 ELSE 1e-5 END::DOUBLE AS w FROM p LEFT JOIN t USING (image)")
def g16_painted(spark, sf):
    c = cells(spark, sf).withColumn("painted", F.col("label") == 0)
    return G.binary_affinity(c, 0.9, painted="painted").select("a", "b", "w")


@query("sim_rbf_adaptive", f"WITH {CELLS_SQL}, d AS (SELECT image, src, dst, {L2} AS d FROM edges), m AS (SELECT image, median(d) AS sigma FROM d GROUP BY image) SELECT src, dst, round(exp(-(d * d) / (2 * sigma * sigma + 1e-12)), 5) AS s FROM d JOIN m USING (image)")
def rbf_adaptive(spark, sf):
    return G.adaptive_rbf(cells(spark, sf)).select("src", "dst", F.round("sim", 5).alias("s"))


def merged_sql(links: str) -> str:
    """Labels that ``links`` (image, a, b) connect become the least of them, by recursion."""
    return f"""link AS ({links}), pair AS (SELECT image, a, b FROM link UNION SELECT image, b, a FROM link),
walk(image, label, other) AS (SELECT DISTINCT image, label, label FROM cells UNION SELECT w.image, w.label, pair.b FROM walk w JOIN pair ON pair.image = w.image AND pair.a = w.other),
least_of AS (SELECT image, label, min(other) AS least FROM walk GROUP BY ALL) SELECT node, CAST(least AS BIGINT) AS label FROM cells JOIN least_of USING (image, label)"""


@query("g9_prototype_merge", f"WITH RECURSIVE {PROTO_SQL}, {merged_sql('SELECT a.image, a.label AS a, b.label AS b FROM proto a JOIN proto b ON a.image = b.image AND a.label < b.label WHERE round(list_cosine_similarity(a.prototype, b.prototype), 9) >= 0.1')}")
def g9_merge(spark, sf):
    """Labels whose prototypes are alike, merged transitively."""
    return G.merge_linked(cells(spark, sf), g9(spark, sf)).select("node", "label")


@query("g11_adjacent_merge", f"WITH RECURSIVE {PROTO_SQL}, t AS (SELECT DISTINCT e.image, least(p.label, q.label) AS a, greatest(p.label, q.label) AS b FROM edges e JOIN cells p ON p.node = e.src JOIN cells q ON q.node = e.dst WHERE p.label <> q.label), {merged_sql('SELECT t.image, t.a, t.b FROM t JOIN proto x ON x.image = t.image AND x.label = t.a JOIN proto y ON y.image = t.image AND y.label = t.b WHERE round(list_cosine_similarity(x.prototype, y.prototype), 9) >= 0.05')}")
def g11_merge(spark, sf):
    """Touching labels whose prototypes are alike, merged transitively."""
    return G.merge_linked(cells(spark, sf), g11(spark, sf)).select("node", "label")


def _cut_sql(cut: float) -> str:
    """Labels of the cut graph at one radius, as recursion over the edges that it keeps."""
    k = int(cut * 100)
    return f"""kept{k} AS (SELECT src AS a, dst AS b FROM edges WHERE 1 - round(sim, 9) <= {cut}), pair{k} AS (SELECT a, b FROM kept{k} UNION SELECT b, a FROM kept{k}),
walk{k}(node, other) AS (SELECT node, node FROM cells UNION SELECT w.node, pair{k}.b FROM walk{k} w JOIN pair{k} ON pair{k}.a = w.other),
comp{k} AS (SELECT node, min(other) AS c FROM walk{k} GROUP BY node),
sized{k} AS (SELECT image, c, count(*) AS n, min(node) AS first FROM comp{k} JOIN cells USING (node) GROUP BY ALL),
ranked{k} AS (SELECT image, c, CASE WHEN n >= 2 THEN row_number() OVER (PARTITION BY image ORDER BY n DESC, first) ELSE 0 END AS label FROM sized{k}),
level{k} AS (SELECT image, {cut}::DOUBLE AS cut, node, r.label, max(r.label) OVER (PARTITION BY image) AS masks, count(*) FILTER (r.label = 0) OVER (PARTITION BY image) AS dropped FROM comp{k} JOIN cells USING (node) JOIN ranked{k} r USING (image, c))"""


@query("g3_cut_levels", f"WITH RECURSIVE {CELLS_SQL}, {', '.join(_cut_sql(c) for c in (0.9, 0.95, 1.0))} SELECT * FROM level90 UNION ALL SELECT * FROM level95 UNION ALL SELECT * FROM level100")
def g3_levels(spark, sf):
    """The cut graph at three radii, with the number of masks and of cells that belong to none."""
    return X.cut_levels(cells(spark, sf), [0.9, 0.95, 1.0])


def _mirror(c: str, n: int) -> str:
    m = f"((({c}) % {2 * n - 2} + {2 * n - 2}) % {2 * n - 2})"
    return f"CASE WHEN {m} < {n} THEN {m} ELSE {2 * n - 2} - {m} END"


@query("g20_gaussian_smooth", f"WITH {CELLS_SQL}, k AS (SELECT i, exp(-(i * i) / 0.98::DOUBLE) / (SELECT sum(exp(-(j * j) / 0.98::DOUBLE)) FROM (SELECT unnest(range(-2, 3)) AS j)) AS w FROM (SELECT unnest(range(-2, 3)) AS i)), v AS (SELECT image, y, x, feat[1] AS v FROM cells) SELECT a.image, a.y, a.x, round(sum(b.v * ky.w * kx.w), 6) AS v FROM v a, k ky, k kx, v b WHERE b.image = a.image AND b.y = {_mirror('a.y + ky.i', ROWS)} AND b.x = {_mirror('a.x + kx.i', GRID_WIDTH)} GROUP BY ALL")
def g20(spark, sf):
    v = cells(spark, sf).select("image", "y", "x", F.element_at("feat", 1).alias("v"))
    return G.gaussian_smooth(v, 0.7, ROWS, GRID_WIDTH, through_gaps=True).withColumn("v", F.round("v", 6))


@query("g20_gaussian_smooth_all", f"WITH {CELLS_SQL}, k AS (SELECT i, exp(-(i * i) / 0.98::DOUBLE) / (SELECT sum(exp(-(j * j) / 0.98::DOUBLE)) FROM (SELECT unnest(range(-2, 3)) AS j)) AS w FROM (SELECT unnest(range(-2, 3)) AS i)), v AS (SELECT image * 64 + d - 1 AS plane, y, x, feat[d] AS v FROM cells, (SELECT unnest(range(1, 65)) AS d)), h AS (SELECT a.plane, a.y, a.x, sum(b.v * ky.w) AS v FROM v a, k ky, v b WHERE b.plane = a.plane AND b.x = a.x AND b.y = {_mirror('a.y + ky.i', ROWS)} GROUP BY ALL) SELECT a.plane, a.y, a.x, round(sum(b.v * kx.w), 6) AS v FROM h a, k kx, h b WHERE b.plane = a.plane AND b.y = a.y AND b.x = {_mirror('a.x + kx.i', GRID_WIDTH)} GROUP BY ALL")
def g20_all(spark, sf):
    """All 64 features smoothed: each feature of each image is a plane."""
    v = cells(spark, sf).select("image", "y", "x", F.posexplode("feat").alias("d", "v")).select((F.col("image") * 64 + F.col("d")).alias("image"), "y", "x", "v")
    return G.gaussian_smooth(v, 0.7, ROWS, GRID_WIDTH).select(F.col("image").alias("plane"), "y", "x", F.round("v", 6).alias("v"))


@query("w15_spectral_eigengap")
def w15_spectral(spark, sf):
    """The number of clusters of each image by the gaps of the eigenvalues of its normalized Laplacian."""
    def gap(feat, y, x):
        return [X.eigengap(X.fiedler(X.affinity_matrix(feat, 0.15))[0])] * len(feat)

    return X.segment(cells(spark, sf), gap).groupBy("image").agg(F.first("label").alias("k"))


@query("w15_eigengap", "SELECT label, CAST(2 + arg_max(rn, (gap, -rn)) - 2 AS BIGINT) AS k FROM (SELECT label, rn, round(lead(v) OVER (PARTITION BY label ORDER BY rn) - v, 9) AS gap FROM (SELECT label, v, row_number() OVER (PARTITION BY label ORDER BY v) AS rn FROM (SELECT DISTINCT label, CAST(embedding[1] AS DOUBLE) AS v FROM embeddings))) WHERE gap IS NOT NULL AND rn >= 2 GROUP BY label")
def w15(spark, sf):
    """Place of the largest gap between consecutive values, the first left out."""
    v = grid(spark, sf).select("label", F.element_at("feat", 1).alias("v")).distinct()
    w = Window.partitionBy("label").orderBy("v")
    g = v.select("label", F.row_number().over(w).alias("rn"), F.round(F.lead("v").over(w) - F.col("v"), 9).alias("gap")).where("gap is not null and rn >= 2")
    return g.groupBy("label").agg(F.max(F.struct("gap", (-F.col("rn")).alias("neg"))).alias("m")).select("label", (-F.col("m.neg")).cast("long").alias("k"))


SEAM_SQL = reach("round(sim, 9) >= t", RELABEL).replace("quantile_cont(round(sim, 9), 0.6)", "quantile_cont(round(sim, 9), 0.7)") + """,
own AS (SELECT cells.image, node, feat, r AS part FROM comp JOIN cells USING (node) JOIN ranked ON ranked.image = cells.image AND ranked.c = comp.c),
seam AS (SELECT DISTINCT e.image, p.part AS a, q.part AS b, p.node FROM (SELECT image, src, dst FROM edges UNION ALL SELECT image, dst, src FROM edges) e JOIN own p ON p.node = e.src JOIN own q ON q.node = e.dst WHERE p.part <> q.part),
band AS (SELECT image, a, b, list(v ORDER BY d) AS mean FROM (SELECT s.image, s.a, s.b, d, avg(o.feat[d]) AS v FROM seam s JOIN own o ON o.node = s.node, (SELECT unnest(range(1, 65)) AS d) GROUP BY ALL) GROUP BY ALL),
alike AS (SELECT x.image, x.a, x.b FROM band x JOIN band y ON y.image = x.image AND y.a = x.b AND y.b = x.a WHERE round(list_cosine_similarity(x.mean, y.mean), 9) >= 0.4),
chain(image, part, other) AS (SELECT DISTINCT image, part, part FROM own UNION SELECT c.image, c.part, l.b FROM chain c JOIN alike l ON l.image = c.image AND l.a = c.other),
whole AS (SELECT image, part, min(other) AS least FROM chain GROUP BY ALL),
joined AS (SELECT own.image, node, least FROM own JOIN whole ON whole.image = own.image AND whole.part = own.part),
places AS (SELECT image, least, row_number() OVER (PARTITION BY image ORDER BY count(*) DESC, min(node)) AS label FROM joined GROUP BY image, least)"""
SEAM_QUERY = f"WITH RECURSIVE {SEAM_SQL} SELECT joined.image, node, CAST(label AS BIGINT) AS label FROM joined JOIN places ON places.image = joined.image AND places.least = joined.least"

def pieces_sql(name: str, nodes: str, links: str, q: float, by: str, least: int) -> str:
    """``name`` (by, node, part): components of ``links`` (by, a, b, sim) whose similarity reaches its q-quantile of ``by``; numbered by falling size from 1, those under ``least`` 0."""
    keys = [k.strip() for k in by.split(",")]
    same = lambda x, y: " AND ".join(f"{x}.{k} = {y}.{k}" for k in keys)
    return f"""{name}_link AS ({links}), {name}_cut AS (SELECT {by}, round(quantile_cont(round(sim, 9), {q}), 9) AS t FROM {name}_link GROUP BY ALL),
{name}_pair AS (SELECT a, b FROM {name}_link l JOIN {name}_cut c ON {same('l', 'c')} WHERE round(sim, 9) >= t UNION SELECT b, a FROM {name}_link l JOIN {name}_cut c ON {same('l', 'c')} WHERE round(sim, 9) >= t),
{name}_walk(node, other) AS (SELECT node, node FROM ({nodes}) UNION SELECT w.node, p.b FROM {name}_walk w JOIN {name}_pair p ON p.a = w.other),
{name}_comp AS (SELECT {by}, n.node, min(other) AS c FROM ({nodes}) n JOIN {name}_walk w ON w.node = n.node GROUP BY ALL),
{name}_rank AS (SELECT {by}, c, CASE WHEN count(*) >= {least} THEN row_number() OVER (PARTITION BY {by} ORDER BY count(*) DESC, min(node)) ELSE 0 END AS part FROM {name}_comp GROUP BY {by}, c),
{name} AS (SELECT {', '.join('x.' + k for k in keys)}, node, part FROM {name}_comp x JOIN {name}_rank r ON {same('x', 'r')} AND r.c = x.c)"""


COARSE = "SELECT image, image * 1000 + (y // 2) * 100 + x // 2 AS node, y // 2 AS y, x // 2 AS x, list(v ORDER BY d) AS feat FROM (SELECT image, y // 2 * 2 AS y, x // 2 * 2 AS x, d, avg(feat[d]) AS v FROM cells, (SELECT unnest(range(1, 65)) AS d) GROUP BY ALL) GROUP BY image, y, x"
BESIDE = "((b.y = a.y AND b.x = a.x + 1) OR (b.y = a.y + 1 AND b.x = a.x))"
LEVELS_SQL = f"""{CELLS_SQL}, small AS ({COARSE}),
{pieces_sql('coarse', 'SELECT image, node FROM small', f'SELECT a.image, a.node AS a, b.node AS b, list_cosine_similarity(a.feat, b.feat) AS sim FROM small a JOIN small b ON a.image = b.image AND {BESIDE}', 0.6, 'image', 2)},
top AS (SELECT cells.image, cells.node, part AS piece FROM cells JOIN coarse ON coarse.node = cells.image * 1000 + (y // 2) * 100 + x // 2),
{pieces_sql('fine', 'SELECT image, piece, node FROM top', 'SELECT e.image, p.piece, src AS a, dst AS b, sim FROM edges e JOIN top p ON p.node = e.src JOIN top q ON q.node = e.dst WHERE p.piece = q.piece', 0.8, 'image, piece', 2)},
numbered AS (SELECT image, piece, node, dense_rank() OVER (PARTITION BY image ORDER BY piece, part) AS label FROM fine)"""
LEVELS_QUERIES = {"seam_merge": SEAM_QUERY, "hierarchical": f"WITH RECURSIVE {LEVELS_SQL} SELECT image, node, CAST(label AS BIGINT) AS label FROM numbered"}

for _name, _extractor in (("g5_frontier_grow", "frontier_grow"), ("g6_sequential_grow", "sequential_grow"), ("g7_g8_multistage", "multistage"), ("g10_seam_merge", "seam_merge"), ("g12_grow_and_merge", "grow_and_merge"), ("g13_hierarchical", "hierarchical"), ("g14_agglomerative", "agglomerative"), ("g17_normalized_cut", "normalized_cut"), ("g18_kmeans", "kmeans"), ("g23_spectral_levels", "spectral_levels")):

    @query(_name, LEVELS_QUERIES.get(_extractor))
    def _extract(spark, sf, extractor=_extractor):
        return X.segment(cells(spark, sf), extractor).select("image", "node", "label")


@query("g19_pca")
def g19(spark, sf):
    """Two main axes of each image, in millionths."""
    axis = lambda k: X.segment(cells(spark, sf), lambda feat, y, x: (X.pca(feat, 2)[:, k] * 1e6).round()).select("image", "node", F.col("label").alias(f"axis{k + 1}_e6"))
    return axis(0).join(axis(1), ["image", "node"])


@query("g19_pca_rgb")
def g19_rgb(spark, sf):
    """Three main axes of each image as a colour, 0xRRGGBB."""
    return X.segment(cells(spark, sf), lambda feat, y, x: X.pca_rgb(feat) @ X.np.array([1 << 16, 1 << 8, 1])).select("image", "node", F.col("label").alias("rgb"))


@query("g7_region_multistage")
def g7_region(spark, sf):
    """Greedy multistage segmentation restricted to the left half of each image."""
    return X.segment(cells(spark, sf), lambda feat, y, x: X.multistage(feat, y, x, region=x < GRID_WIDTH // 2)).select("image", "node", "label")


@query("g13_parents", f"WITH RECURSIVE {LEVELS_SQL} SELECT DISTINCT image, CAST(label AS BIGINT) AS fine, CAST(piece AS BIGINT) AS coarse FROM numbered")
def g13_parents(spark, sf):
    """The coarse piece that each fine piece of the hierarchy lies in."""
    c = cells(spark, sf)
    fine = X.segment(c, "hierarchical").withColumnRenamed("label", "fine")
    return fine.join(X.segment(c, "hierarchical", parents=True), ["image", "node"]).select("image", "fine", F.col("label").alias("coarse")).distinct()


GROW_SQL = CELLS_SQL + """,
near AS (SELECT src AS a, dst AS b FROM edges UNION ALL SELECT dst, src FROM edges),
seed AS (SELECT image, min(node) AS node FROM cells GROUP BY image),
alike AS (SELECT c.image, c.node, list_cosine_similarity(c.feat, f.feat) AS s, (row_number() OVER (PARTITION BY c.image ORDER BY c.node) - 1) % 17 = 0 AND c.node <> f.node AS blocked FROM cells c JOIN seed USING (image) JOIN cells f ON f.node = seed.node),
span AS (SELECT image, quantile_cont(s, 0.02) AS lo, quantile_cont(s, 0.98) AS hi FROM alike GROUP BY image),
val AS (SELECT a.image, node, blocked, greatest(0.0, least(1.0, (s - lo) / (hi - lo + 1e-8))) AS v FROM alike a JOIN span USING (image)),
walk(image, k, inside) AS (SELECT image, 0, [node] FROM seed
  UNION ALL SELECT image, k + 1, list_concat(any_value(inside), list(b)) FROM (
    SELECT w.image, w.k, w.inside, n.b FROM walk w JOIN val i ON i.image = w.image AND list_contains(w.inside, i.node) JOIN near n ON n.a = i.node JOIN val j ON j.node = n.b AND NOT j.blocked AND NOT list_contains(w.inside, n.b)
    GROUP BY w.image, w.k, w.inside, n.b, j.v HAVING max(i.v) - j.v <= 0.3) GROUP BY image, k),
whole AS (SELECT image, arg_max(inside, k) AS inside FROM walk GROUP BY image)"""


@query("g4_region_grow", f"WITH RECURSIVE {GROW_SQL} SELECT c.image, node, CAST(list_contains(inside, node) AS BIGINT) AS inside FROM cells c JOIN whole USING (image)")
def g4(spark, sf):
    def from_first(feat, y, x):
        seed = X.np.arange(len(feat)) == 0
        near = X.neighbours_of(X.edges_of(y, x), len(feat))
        return X.grow(seed, X.stretched(X.unit(feat) @ X.unit(feat[0])), ~seed & (X.np.arange(len(feat)) % 17 == 0), near, 0.3).astype(int)

    return X.segment(cells(spark, sf), from_first).select("image", "node", F.col("label").alias("inside"))


def _box(expression: str) -> str:
    """The mean of an expression over b, the 3 x 3 cells around a cell a; the border's cells stand for those beyond it."""
    return f"SELECT a.image, a.y, a.x, b.d, {expression} FROM plain a, nine n, {{source}} b WHERE b.image = a.image AND b.y = greatest(0, least({ROWS - 1}, a.y + n.dy)) AND b.x = greatest(0, least({GRID_WIDTH - 1}, a.x + n.dx)) GROUP BY ALL"


def mean_field_sql(steps: int) -> str:
    """q{steps} (image, y, x, d, q): scores smoothed by a guided filter and renormalized, ``steps`` times."""
    out = [CELLS_SQL, "plain AS (SELECT image, y, x FROM cells)", "nine AS (SELECT dy, dx FROM (SELECT unnest([-1, 0, 1]) AS dy), (SELECT unnest([-1, 0, 1]) AS dx))"]
    out.append("u AS (SELECT image, y, x, d, feat[d] AS s, list_avg(feat) AS g FROM cells, (SELECT unnest(range(1, 65)) AS d))")
    renew = lambda name, source: f"{name} AS (SELECT image, y, x, d, g, exp(s - m) / sum(exp(s - m)) OVER (PARTITION BY image, y, x) AS q FROM (SELECT *, max(s) OVER (PARTITION BY image, y, x) AS m FROM {source}))"
    out.append(renew("q0", "u"))
    for k in range(steps):
        out.append(f"m{k} AS (" + _box("avg(b.g) AS mg, avg(b.q) AS mq, avg(b.g * b.q) AS mgq, avg(b.g * b.g) AS mgg").format(source=f"q{k}") + ")")
        out.append(f"c{k} AS (SELECT image, y, x, d, a, mq - a * mg AS b FROM (SELECT *, (mgq - mg * mq) / (mgg - mg * mg + 1e-2) AS a FROM m{k}))")
        out.append(f"f{k} AS (" + _box("avg(b.a) AS a, avg(b.b) AS b").format(source=f"c{k}") + ")")
        out.append(renew(f"q{k + 1}", f"(SELECT u.image, u.y, u.x, u.d, u.g, u.s + f.a * u.g + f.b AS s FROM u JOIN f{k} f ON f.image = u.image AND f.y = u.y AND f.x = u.x AND f.d = u.d)"))
    return ", ".join(out)


@query("g21_mean_field", f"WITH {mean_field_sql(3)} SELECT image, node, CAST(best.label AS BIGINT) AS label FROM cells JOIN (SELECT image, y, x, arg_max(d, (q, -d)) - 1 AS label FROM q3 GROUP BY image, y, x) best USING (image, y, x)")
def g21(spark, sf):
    def smooth(feat, y, x):
        h, w = int(y.max()) + 1, int(x.max()) + 1
        grid_of = X.np.zeros((h, w, feat.shape[1]))
        grid_of[y, x] = feat
        return X.mean_field(grid_of, grid_of.mean(-1)).argmax(-1)[y, x]

    return X.segment(cells(spark, sf), smooth).select("image", "node", "label")


CLEAN_SQL = CELLS_SQL + """,
sign AS (SELECT image, node, y, x, list_sum(feat) > 0 AS filled FROM cells),
near AS (SELECT a.node AS a, b.node AS b FROM cells a JOIN cells b ON a.image = b.image AND a.node <> b.node AND abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1),
hole(node, other) AS (SELECT node, node FROM sign WHERE NOT filled UNION SELECT h.node, n.b FROM hole h JOIN near n ON n.a = h.other JOIN sign s ON s.node = n.b AND NOT s.filled),
closed AS (SELECT image, s.node, filled OR coalesce(n < 3, false) AS filled FROM sign s LEFT JOIN (SELECT node, count(*) AS n FROM hole GROUP BY node) h ON h.node = s.node),
isle(node, other) AS (SELECT node, node FROM closed WHERE filled UNION SELECT i.node, n.b FROM isle i JOIN near n ON n.a = i.other JOIN closed c ON c.node = n.b AND c.filled),
part AS (SELECT image, i.node, count(*) AS n, min(other) AS first FROM isle i JOIN closed c ON c.node = i.node GROUP BY ALL),
best AS (SELECT image, max(n) AS most, arg_max(first, (n, -first)) AS largest FROM part GROUP BY image)"""


@query("g22_clean_regions", f"WITH RECURSIVE {CLEAN_SQL} SELECT c.image, c.node, CAST(coalesce(n >= 4 OR (most < 4 AND first = largest), false) AS BIGINT) AS inside FROM closed c LEFT JOIN part p ON p.node = c.node LEFT JOIN best b ON b.image = c.image")
def g22(spark, sf):
    def clean(feat, y, x):
        m = X.np.zeros((int(y.max()) + 1, int(x.max()) + 1), bool)
        m[y, x] = feat.sum(1) > 0
        return X.clean_regions(X.clean_regions(m, 3, True), 4, False)[y, x].astype(int)

    return X.segment(cells(spark, sf), clean).select("image", "node", F.col("label").alias("inside"))


PEAKS_SQL = CELLS_SQL + """,
v AS (SELECT image, node, y, x, round(sqrt(list_dot_product(feat, feat)), 9) AS v FROM cells),
walk(image, k, peaks) AS (SELECT DISTINCT image, 0, CAST([] AS STRUCT(node BIGINT, y BIGINT, x BIGINT)[]) FROM cells
  UNION ALL SELECT image, k + 1, list_append(any_value(peaks), arg_max({'node': node, 'y': y, 'x': x}, (v, -node)))
  FROM (SELECT w.image, w.k, w.peaks, v.node, v.y, v.x, v.v FROM walk w JOIN v ON v.image = w.image WHERE w.k < 5 AND len(list_filter(w.peaks, lambda p: abs(p.y - v.y) <= 2 AND abs(p.x - v.x) <= 2)) = 0) GROUP BY image, k),
peak AS (SELECT image, unnest(arg_max(peaks, k)).node AS node FROM walk GROUP BY image)"""


@query("t8_spaced_peaks", f"WITH RECURSIVE {PEAKS_SQL} SELECT image, node, CAST(node IN (SELECT node FROM peak) AS BIGINT) AS is_peak FROM cells")
def t8(spark, sf):
    """Up to five peaks of the features' length, with a cleared square around each: 1 where a node is one."""
    from gridloom.operators.suppress import spaced_peaks

    def peaks(feat, y, x):
        v = X.np.full((int(y.max()) + 1, int(x.max()) + 1), -X.np.inf)
        v[y, x] = X.np.round(X.np.linalg.norm(feat, axis=1), 9)  # so that ties are ties, which the first node wins
        got = set(spaced_peaks(v, 5, 2))
        return [int((a, b) in got) for a, b in zip(y.tolist(), x.tolist(), strict=True)]

    return X.segment(cells(spark, sf), peaks).select("image", "node", F.col("label").alias("is_peak"))


@query("g23_level_tree")
def g23_tree(spark, sf):
    """Two levels of objects: those of each image, and those of each object's box with a stricter threshold."""
    return X.spectral_tree(cells(spark, sf), [0.1, 0.25])


@query("g14_agglomerative_levels")
def g14_levels(spark, sf):
    """The merging's state at three falling thresholds, each going on from the one before."""
    return X.agglomerated(cells(spark, sf), [0.4, 0.2, 0.1], min_size=2)
