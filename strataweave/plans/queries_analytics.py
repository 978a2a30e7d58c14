"""Queries of the packaged analyses, lineage and trust."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model as M
from ..functions import vectors as V
from ..operators import provenance as PV
from ..operators.algorithms import characterization as C
from ..operators.algorithms import chronicle as H
from ..operators.algorithms import diagnostics as D
from ..operators.algorithms import reasoning as R
from ..operators.algorithms import semantic as S
from ..operators.vector import knn
from .catalog import query
from .queries_temporal import JAN, WRITES
from .queries_vector import LINKS, NODES, QS, VERSIONS, Q

DIM = 64


def _r(col: str, digits: int = 6):
    return F.round(F.col(col), digits).alias(col)


COSTS = "c AS (SELECT DISTINCT src, dst, greatest(0, 1 - list_cosine_similarity(a.e, b.e)) AS cost FROM k JOIN n a ON a.id = src JOIN n b ON b.id = dst)"


def _rank_rounds(rounds: int) -> str:
    """The power iteration of personalised PageRank, round by round."""
    out = ["s AS (SELECT id, 1.0::DOUBLE / count(*) OVER () AS p FROM n WHERE label = 2)", "h AS (SELECT src, dst, count(*) OVER (PARTITION BY src) AS deg FROM (SELECT DISTINCT src, dst FROM k))",
           "r0 AS (SELECT id, p AS rank FROM s)"]
    for i in range(rounds):
        out.append(f"f{i} AS (SELECT dst AS id, 0.85::DOUBLE * sum(rank / deg) AS rank FROM r{i} JOIN h ON src = id GROUP BY 1)")
        back = f"SELECT id, p * (1 - (SELECT coalesce(sum(rank), 0) FROM f{i})) FROM s"
        out.append(f"r{i + 1} AS (SELECT id, sum(rank) AS rank FROM (SELECT * FROM f{i} UNION ALL {back}) GROUP BY 1)")
    return ", ".join(out) + f" SELECT id, round(rank, 9) AS rank FROM r{rounds}"


def _mean(e: str) -> str:
    return f"[{', '.join(f'avg({e}[{i + 1}])' for i in range(DIM))}]"


@query("polygraph", f"""WITH {NODES}, {LINKS} SELECT eid, k.label, round(list_cosine_similarity(a.e, b.e), 6) AS similarity FROM k JOIN n a ON a.id = src JOIN n b ON b.id = dst
 WHERE (k.label = 'NEXT' AND list_cosine_similarity(a.e, b.e) < 0.0) OR (k.label = 'CHILD' AND list_cosine_similarity(a.e, b.e) > 0.3)""")
def polygraph(spark, d):
    return D.polygraph(M.vector_nodes(spark, d), M.vector_links(spark, d), {"NEXT": ("high", 0.0), "CHILD": ("low", 0.3)}).select("eid", "label", _r("similarity"))


@query("dissonance", f"""WITH {NODES}, {LINKS}, j AS (SELECT a.id AS qid, list_cosine_similarity(a.e, b.e) AS s, row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.id) AS r FROM n a JOIN n b ON a.id <> b.id),
 x AS (SELECT qid AS id, avg(s) AS semantic FROM j WHERE r <= 5 GROUP BY 1), u AS (SELECT src, dst FROM k WHERE src <> dst UNION SELECT dst, src FROM k WHERE src <> dst),
 y AS (SELECT a.id, avg(list_cosine_similarity(a.e, b.e)) AS structural FROM u JOIN n a ON a.id = src JOIN n b ON b.id = dst GROUP BY 1)
 SELECT x.id, round(semantic - structural, 6) AS dissonance FROM x JOIN y USING (id)""")
def dissonance(spark, d):
    return D.dissonance(M.vector_nodes(spark, d), M.vector_links(spark, d), 5).select("id", _r("dissonance"))


@query("thermos", f"""WITH {VERSIONS}, l AS (SELECT *, lag(e) OVER (PARTITION BY id ORDER BY vf) AS p FROM v WHERE vf < 300000000)
 SELECT id, round(sum(list_distance(p, e)), 6) AS travelled, round(sum(list_distance(p, e)) / 300, 6) AS rate FROM l WHERE p IS NOT NULL GROUP BY 1""")
def thermos(spark, d):
    return D.thermos(M.vector_versions(spark, d), 0, 300_000_000).select("id", _r("travelled"), _r("rate"))


@query("tremor", f"""WITH {NODES}, a AS (SELECT label, {_mean('e')} AS c FROM n WHERE id < 250 GROUP BY 1), b AS (SELECT label, {_mean('e')} AS c FROM n WHERE id >= 250 GROUP BY 1)
 SELECT label, round(list_distance(a.c, b.c), 6) AS tremor FROM a JOIN b USING (label)""")
def tremor(spark, d):
    n = M.vector_nodes(spark, d)
    return D.tremor(n.where("id < 250"), n.where("id >= 250"), DIM).select("label", _r("tremor"))


@query("archetypes", f"WITH {NODES}, c AS (SELECT label, {_mean('e')} AS c FROM n GROUP BY 1) SELECT id, label, round((1 + list_cosine_similarity(e, c)) / 2, 6) AS purity FROM n JOIN c USING (label)")
def archetypes(spark, d):
    return C.archetypes(M.vector_nodes(spark, d), "label", DIM).select("id", "label", _r("purity"))


@query("fossil", f"""WITH {NODES}, {LINKS}, h AS (SELECT DISTINCT src, dst FROM k), m AS (SELECT id, list_transform(e, lambda x: x * 2 + id % 3) AS e FROM n),
 ca AS (SELECT src AS id, {_mean('e')} AS c FROM h JOIN n ON n.id = dst GROUP BY 1), cb AS (SELECT src AS id, {_mean('e')} AS c FROM h JOIN m ON m.id = dst GROUP BY 1)
 SELECT n.id, round(list_distance(ca.c, cb.c) / (list_distance(n.e, m.e) + 1e-6), 6) AS fossil FROM n JOIN m USING (id) JOIN ca USING (id) JOIN cb USING (id)""")
def fossil(spark, d):
    n = M.vector_nodes(spark, d)
    after = n.withColumn("embedding", F.transform(F.col("embedding").cast("array<double>"), lambda x: x * 2 + F.col("id") % 3))
    return D.fossil(n, after, M.vector_links(spark, d), DIM).select("id", _r("fossil"))


@query("propagate", f"""WITH {NODES}, {LINKS}, m AS (SELECT dst AS id, {_mean('e')} AS m FROM (SELECT DISTINCT src, dst FROM k) JOIN n ON n.id = src GROUP BY 1)
 SELECT n.id, round(list_inner_product(CASE WHEN m IS NULL THEN e ELSE list_transform(list_zip(e, m), lambda z: 0.7 * z[1] + 0.3 * z[2]) END, {QS}), 6) AS along FROM n LEFT JOIN m ON m.id = n.id""")
def propagate(spark, d):
    return C.propagate(M.vector_nodes(spark, d), M.vector_links(spark, d), DIM, 0.3).select("id", F.round(V.dot(F.col("embedding"), Q), 6).alias("along"))


@query("predict_links", f"""WITH {NODES}, {LINKS}, u AS (SELECT src, dst FROM k WHERE src <> dst UNION SELECT dst, src FROM k WHERE src <> dst),
 g AS (SELECT i, count(*) AS deg FROM (SELECT src AS i FROM k UNION ALL SELECT dst FROM k) GROUP BY 1 HAVING count(*) > 1),
 p AS (SELECT x.src AS a, y.dst AS b, sum(1 / ln(deg)) AS aa FROM u x JOIN g ON i = x.dst JOIN u y ON y.src = x.dst WHERE x.src <> y.dst GROUP BY 1, 2)
 SELECT a, b, round(aa * (1 + list_cosine_similarity(s.e, t.e)), 6) AS score FROM p JOIN n s ON s.id = a JOIN n t ON t.id = b
 WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.src = a AND u.dst = b) AND aa * (1 + list_cosine_similarity(s.e, t.e)) > 0""")
def predict_links(spark, d):
    return R.predict_links(M.vector_nodes(spark, d), M.vector_links(spark, d)).select("a", "b", _r("score"))


@query("entanglement", f"""WITH v AS (SELECT label::BIGINT AS id, vec_id // 10 AS bin, vec_id AS version_id, embedding::DOUBLE[] AS e FROM embeddings),
 l AS (SELECT *, lag(e) OVER (PARTITION BY id ORDER BY version_id) AS p FROM v), m AS (SELECT id, bin, list_transform(list_zip(e, p), lambda z: z[1] - z[2]) AS dv FROM l WHERE p IS NOT NULL)
 SELECT x.id AS a, y.id AS b, round(avg(list_cosine_similarity(x.dv, y.dv)), 6) AS entanglement, count(*) AS n FROM m x JOIN m y ON x.bin = y.bin AND x.id < y.id GROUP BY 1, 2""")
def entanglement(spark, d):
    v = M.vector_versions(spark, d).withColumn("tf", F.floor(F.col("version_id") / 10))
    return D.entanglement(v).select("a", "b", _r("entanglement"), "n")


@query("aura", f"""WITH {VERSIONS}, w AS (SELECT id, vf, e, list_transform(e, lambda x: x * pow(0.5, (500000000 - vf) / 60000000.0::DOUBLE)) AS x FROM v WHERE vf <= 500000000),
 m AS (SELECT id, {_mean('x')} AS m, arg_max(e, vf) AS z FROM w GROUP BY 1) SELECT id, round(1 - list_cosine_similarity(z, m), 6) AS divergence FROM m""")
def aura(spark, d):
    return H.aura(M.vector_versions(spark, d), 500_000_000, 60e6, DIM).select("id", _r("divergence"))


@query("concept_analogy", f"""WITH {NODES}, q AS (SELECT list_transform(list_zip(list_zip(a.e, b.e), c.e), lambda z: z[1][1] - z[1][2] + z[2]) AS q FROM n a, n b, n c WHERE a.id = 3 AND b.id = 8 AND c.id = 21)
 SELECT id, round(list_cosine_similarity(e, q), 6) AS score FROM n, q WHERE id NOT IN (3, 8, 21) ORDER BY list_cosine_similarity(e, q) DESC, id LIMIT 10""")
def concept_analogy(spark, d):
    return S.concept(M.vector_nodes(spark, d), [3, 21], [8]).select("id", _r("score"))


@query("fishing_rod", f"""WITH {NODES}, {LINKS}, h AS (SELECT id, list_cosine_similarity(e, {QS}) AS s FROM n ORDER BY 2 DESC, 1 LIMIT 20),
 u AS (SELECT id, 0.7 * s AS s FROM h UNION ALL SELECT dst, 0.3 FROM h JOIN k ON src = h.id) SELECT id, round(sum(s), 6) AS score FROM u GROUP BY 1""")
def fishing_rod(spark, d):
    return S.cast_rod(M.vector_nodes(spark, d), M.vector_links(spark, d), Q, 20).select("id", _r("score"))


@query("telepathy", f"""WITH RECURSIVE {NODES}, {LINKS}, h AS (SELECT DISTINCT src, dst FROM k), w AS (SELECT src, dst, greatest(0, list_cosine_similarity(a.e, b.e)) * 0.8 AS w FROM h JOIN n a ON a.id = src JOIN n b ON b.id = dst),
 p AS (SELECT 2::BIGINT AS id, 1.0::DOUBLE AS s, 0 AS d UNION ALL SELECT dst, s * w, d + 1 FROM p JOIN w ON src = id WHERE d < 3 AND s * w >= 0.01)
 SELECT id, round(max(s), 6) AS signal FROM p WHERE id <> 2 GROUP BY 1""")
def telepathy(spark, d):
    return S.telepathy(2, M.vector_nodes(spark, d), M.vector_links(spark, d)).select("id", _r("signal"))


@query("wormholes", f"""WITH RECURSIVE {NODES}, {LINKS}, j AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.e, b.e) AS s, row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.id) AS r FROM n a JOIN n b ON a.id <> b.id),
 p AS (SELECT a, b, s FROM j WHERE r <= 3 AND s >= 0.2), w AS (SELECT DISTINCT a AS a, a AS i, 0 AS d FROM p UNION SELECT w.a, dst, d + 1 FROM w JOIN k ON src = i WHERE d < 2)
 SELECT p.a, p.b, round(s, 6) AS similarity FROM p WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.a = p.a AND w.i = p.b)""")
def wormholes(spark, d):
    return D.wormholes(M.vector_nodes(spark, d), M.vector_links(spark, d), 3, 0.2, 2).select("a", "b", _r("similarity"))


@query("lineage_upstream", """WITH RECURSIVE l AS (SELECT doc_id AS derived, doc_id // 2 AS source FROM documents WHERE doc_id > 0),
 w AS (SELECT doc_id AS root, doc_id AS v, 0 AS d FROM documents UNION ALL SELECT root, source, d + 1 FROM w JOIN l ON derived = v WHERE d < 4)
 SELECT root, v AS version, min(d) AS depth FROM w WHERE d > 0 GROUP BY 1, 2""")
def lineage_upstream(spark, d):
    roots = M.table(spark, d, "documents").select(F.col("doc_id").alias("root"))
    return PV.lineage_closure(M.document_lineage(spark, d), roots, 4).where("version <> root or depth > 0")


@query("lineage_downstream", """WITH RECURSIVE l AS (SELECT doc_id AS derived, doc_id // 2 AS source FROM documents WHERE doc_id > 0),
 w AS (SELECT doc_id AS root, doc_id AS v, 0 AS d FROM documents WHERE source = 'src1' UNION ALL SELECT root, derived, d + 1 FROM w JOIN l ON l.source = v WHERE d < 5)
 SELECT root, v AS version, min(d) AS depth FROM w WHERE d > 0 GROUP BY 1, 2""")
def lineage_downstream(spark, d):
    roots = M.table(spark, d, "documents").where("source = 'src1'").select(F.col("doc_id").alias("root"))
    return PV.lineage_closure(M.document_lineage(spark, d), roots, 5, upstream=False)


TRUST = """WITH RECURSIVE c AS (SELECT doc_id AS v, CASE WHEN (doc_id * 37 % 101) / 100.0::DOUBLE <= 1 THEN (doc_id * 37 % 101) / 100.0::DOUBLE END AS c FROM documents),
 l AS (SELECT doc_id AS derived, doc_id // 2 AS source FROM documents WHERE doc_id > 0),
 w AS (SELECT doc_id AS root, doc_id AS v FROM documents UNION SELECT root, source FROM w JOIN l ON derived = v)"""


@query("trust_weakest", f"{TRUST} SELECT root AS version, min(coalesce(c, 0)) AS trust FROM w JOIN c ON c.v = w.v GROUP BY 1")
def trust_weakest(spark, d):
    return PV.trust(M.document_confidence(spark, d), M.document_lineage(spark, d))


@query("trust_noisy_or", f"{TRUST} SELECT root AS version, round(1 - exp(sum(ln(1 - least(coalesce(c, 0), 1 - 1e-12)))), 6) AS trust FROM w JOIN c ON c.v = w.v GROUP BY 1")
def trust_noisy_or(spark, d):
    return PV.trust(M.document_confidence(spark, d), M.document_lineage(spark, d), "noisy_or").select("version", _r("trust"))


@query("provenance_filter", "SELECT doc_id AS version FROM documents WHERE source IN ('src0', 'src2') AND (doc_id * 37 % 101) / 100.0::DOUBLE >= 0.5")
def provenance_filter(spark, d):
    return PV.provenance_filter(M.document_confidence(spark, d), ["src0", "src2"], 0.5).select("version")


@query("counterfactual", f"""WITH {WRITES}, h AS (SELECT *, lag(value) OVER o AS pv, row_number() OVER o AS n FROM w WINDOW o AS (PARTITION BY id ORDER BY tf, version_id)),
 s AS (SELECT * FROM h WHERE kind <> 'purchase') SELECT id, arg_max(value, (tf, version_id)) FILTER (WHERE n = 1 OR value IS DISTINCT FROM pv) AS value FROM s
 GROUP BY 1 HAVING bool_or(n = 1) AND arg_max(op, (tf, version_id)) <> 'retract'""")
def counterfactual(spark, d):
    return PV.counterfactual(M.event_writes(spark, d), ["value"], F.col("kind") == "purchase")


@query("hash_chain", f"""WITH RECURSIVE {WRITES}, r AS (SELECT id, version_id, row_number() OVER (PARTITION BY id ORDER BY tf, version_id) AS rn,
  sha256('{{"id":' || id || ',"version_id":' || version_id || ',"vf":' || vf || ',"kind":"' || kind || '"}}') AS own FROM w),
 c AS (SELECT id, rn, version_id, sha256(own) AS digest FROM r WHERE rn = 1 UNION ALL SELECT r.id, r.rn, r.version_id, sha256(c.digest || r.own) FROM c JOIN r ON r.id = c.id AND r.rn = c.rn + 1)
 SELECT id, version_id, digest FROM c""")
def hash_chain(spark, d):
    return PV.hash_chain(M.event_writes(spark, d), ["id", "version_id", "vf", "kind"])


@query("kept_versions", f"""WITH RECURSIVE {VERSIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY vf, version_id) AS rn FROM v),
 w AS (SELECT id, rn, version_id, e AS last, true AS kept FROM r WHERE rn = 1 UNION ALL SELECT r.id, r.rn, r.version_id,
   CASE WHEN 1 - list_cosine_similarity(r.e, w.last) >= 0.8 THEN r.e ELSE w.last END, 1 - list_cosine_similarity(r.e, w.last) >= 0.8 FROM w JOIN r ON r.id = w.id AND r.rn = w.rn + 1)
 SELECT id, version_id FROM w WHERE kept""")
def kept_versions(spark, d):
    return PV.kept_versions(M.vector_versions(spark, d), 0.8)


@query("regions_kmeans")
def regions_kmeans(spark, d):
    return S.kmeans(M.vector_nodes(spark, d), 4, DIM, 25)


@query("two_faced_nodes")
def two_faced_nodes(spark, d):
    return S.two_means(M.vector_nodes(spark, d), M.vector_links(spark, d)).select("id", _r("score"))


@query("semantic_path", f"""WITH RECURSIVE {NODES}, {LINKS}, {COSTS}, w AS (SELECT [1::BIGINT] AS path, 1::BIGINT AS here, 0.0::DOUBLE AS cost
 UNION ALL SELECT list_append(path, dst), dst, w.cost + (c.cost + 0.1) FROM w JOIN c ON src = here WHERE dst <= 40)
 SELECT path, round(cost, 6) AS cost FROM w WHERE here = 40 ORDER BY w.cost, path LIMIT 1""")
def semantic_path(spark, d):
    return S.semantic_path(M.vector_nodes(spark, d), M.vector_links(spark, d), 1, 40, 0.1).select("path", _r("cost"))


@query("semantic_horizon", f"""WITH RECURSIVE {NODES}, {LINKS}, u AS (SELECT src, dst FROM k UNION SELECT dst, src FROM k),
 i AS (SELECT id, list_cosine_similarity(e, (SELECT e FROM n WHERE id = 5)) >= 0 AS inside FROM n),
 w AS (SELECT 5::BIGINT AS id, true AS inside, 0 AS depth UNION SELECT i.id, i.inside, depth + 1 FROM w JOIN u ON src = w.id JOIN i ON i.id = dst WHERE w.inside AND depth < 4)
 SELECT id, inside, min(depth) AS depth FROM w GROUP BY 1, 2""")
def semantic_horizon(spark, d):
    return S.horizon(5, M.vector_nodes(spark, d), M.vector_links(spark, d), 0.0, 4)


@query("personalized_rank", f"WITH {NODES}, {LINKS}, {_rank_rounds(6)}")
def personalized_rank(spark, d):
    seeds = M.vector_nodes(spark, d).where("label = 2").select("id")
    return R.personalized_rank(M.vector_links(spark, d), seeds, rounds=6).select("id", _r("rank", 9))


@query("orbit_velocity", f"""WITH {NODES}, {LINKS}, t AS (SELECT DISTINCT dst FROM k WHERE src = 7), c AS (SELECT e FROM n WHERE id = 7)
 SELECT n.id, round((list_cosine_similarity(n.e, c.e) - list_cosine_similarity(list_transform(n.e, lambda x: x + 1), list_transform(c.e, lambda x: x + 1))) / 60, 9) AS velocity FROM n JOIN t ON t.dst = n.id, c""")
def orbit_velocity(spark, d):
    n = M.vector_nodes(spark, d)
    after = n.withColumn("embedding", F.transform(F.col("embedding").cast("array<double>"), lambda x: x + 1))
    return C.orbit(n, after, M.vector_links(spark, d), 7, 60.0).select("id", _r("velocity", 9))


@query("stability", f"""WITH {WRITES}, b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id, vf ORDER BY tf DESC, version_id DESC) AS rn FROM w) WHERE rn = 1),
 s AS (SELECT *, lead(vf, 1, 9223372036854775807) OVER (PARTITION BY id ORDER BY vf) AS vt FROM b)
 SELECT id, round(sum(least(vt, {JAN + 20 * 86400000000}) - greatest(vf, {JAN})) / {20 * 86400000000}.0::DOUBLE, 6) AS stability FROM s WHERE op <> 'retract' AND vf < {JAN + 20 * 86400000000} AND vt > {JAN} GROUP BY 1""")
def stability(spark, d):
    return H.stability(M.event_writes(spark, d), JAN, JAN + 20 * 86_400_000_000).select("id", _r("stability"))


@query("volatility", f"WITH {WRITES} SELECT id, count(*) AS versions FROM w WHERE vf >= {JAN} AND vf < {JAN + 864000000000} GROUP BY 1")
def volatility(spark, d):
    return H.volatility(M.event_writes(spark, d), JAN, JAN + 864_000_000_000).select("id", "versions")


@query("investigate", f"""WITH {WRITES}, a AS (SELECT id, version_id, vf FROM w WHERE kind = 'signup'),
 b AS (SELECT a.id, a.version_id AS v0, a.vf AS t0, min((w.vf, w.version_id)) AS h FROM a JOIN w ON w.id = a.id AND w.kind = 'view' AND w.vf > a.vf GROUP BY 1, 2, 3),
 c AS (SELECT b.id, v0, t0, h, min((w.vf, w.version_id)) AS g FROM b JOIN w ON w.id = b.id AND w.kind = 'purchase' AND w.vf > h[1] WHERE h[1] - t0 <= 172800000000 GROUP BY 1, 2, 3, 4)
 SELECT id, [v0, h[2], g[2]] AS versions FROM c WHERE g[1] - t0 <= 172800000000""")
def investigate(spark, d):
    clues = [F.col("kind") == k for k in ("signup", "view", "purchase")]
    return H.investigate(M.event_writes(spark, d), clues, 2 * 86_400_000_000)


@query("drift_alarms", f"""WITH {VERSIONS}, x AS (SELECT id, arg_max(e, vf) FILTER (WHERE vf <= 400000000) AS a, arg_max(e, vf) FILTER (WHERE vf <= 300000000) AS b FROM v GROUP BY 1)
 SELECT id, round(1 - list_cosine_similarity(a, b), 6) AS distance FROM x WHERE 1 - list_cosine_similarity(a, b) > 0.1""")
def drift_alarms(spark, d):
    return H.drift_alarms(M.vector_versions(spark, d), 400_000_000, 100_000_000, 0.1).select("id", _r("distance"))


@query("echo_resonance", f"""WITH {WRITES}, b AS (SELECT id, (vf // 60000000) % 60 AS b, count(*) AS n FROM w GROUP BY 1, 2), s AS (SELECT id, sqrt(sum(n * n)) AS z FROM b GROUP BY 1),
 q AS (SELECT b, n / z AS x FROM b JOIN s USING (id) WHERE id = 5) SELECT s.id, round(coalesce(sum(n / z * x), 0), 6) AS resonance FROM s LEFT JOIN b ON b.id = s.id LEFT JOIN q ON q.b = b.b WHERE s.id <> 5 GROUP BY 1""")
def echo_resonance(spark, d):
    return H.resonance(H.echo(M.event_writes(spark, d)), 5).select("id", _r("resonance"))


@query("ripple", f"""WITH {VERSIONS}, l AS (SELECT id, vf, list_distance(e, lag(e) OVER (PARTITION BY id ORDER BY vf)) AS m FROM v), f AS (SELECT id, vf // 20000000 AS b, sum(m) AS f FROM l WHERE m IS NOT NULL GROUP BY 1, 2),
 g AS (SELECT unnest(generate_series(min(b), max(b))) AS b FROM f WHERE id IN (1, 2)), x AS (SELECT g.b, coalesce(f, 0) AS x FROM g LEFT JOIN f ON f.b = g.b AND id = 1), y AS (SELECT g.b, coalesce(f, 0) AS y FROM g LEFT JOIN f ON f.b = g.b AND id = 2)
 SELECT k::INT AS lag, round(coalesce(corr(x, y), 0), 6) AS correlation FROM generate_series(0, 4) s(k) JOIN x ON true JOIN y ON y.b = x.b + k GROUP BY 1""")
def ripple(spark, d):
    f = D.flux(M.vector_versions(spark, d), 20_000_000)
    return D.ripple(f.where("id = 1"), f.where("id = 2"), 4).select("lag", _r("correlation"))


@query("prism", f"""WITH {NODES}, a AS (SELECT list_transform({QS}, lambda x: x / sqrt(list_inner_product({QS}, {QS}))) AS u)
 SELECT id, round(list_inner_product(e, u), 6) AS first, round(sqrt(greatest(0, list_inner_product(e, e) - list_inner_product(e, u) ** 2)), 5) AS residual FROM n, a""")
def prism(spark, d):
    return C.prism(M.vector_nodes(spark, d), [("first", Q), ("none", [2 * x for x in Q])]).select("id", _r("first"), _r("residual", 5))


@query("gravity_pull", f"""WITH {NODES}, g AS (SELECT id, e, greatest(1e-4, list_distance(e, {QS})) AS d FROM n), m AS (SELECT id, list_transform(list_zip(e, {QS}), lambda z: z[1] + (z[2] - z[1]) * 0.1 * 2 / (d * d + 0.1) / d) AS m FROM g)
 SELECT id, round(list_cosine_similarity(m, {QS}), 6) AS along FROM m""")
def gravity_pull(spark, d):
    return C.pull(M.vector_nodes(spark, d), Q, 0.1, 2.0).select("id", F.round(V.cosine(F.col("embedding"), Q), 6).alias("along"))


@query("encounter", """WITH v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), p AS (SELECT a.id, list_transform(list_zip(b.e, d.e), lambda z: z[1] - z[2]) AS p,
 list_transform(list_zip(list_zip(b.e, a.e), list_zip(d.e, c.e)), lambda z: z[1][1] - z[1][2] - z[2][1] + z[2][2]) AS v FROM v a JOIN v b ON b.id = a.id + 1 JOIN v c ON c.id = a.id + 2 JOIN v d ON d.id = a.id + 3)
 SELECT id, round(-list_inner_product(p, v) / list_inner_product(v, v), 6) AS t, -list_inner_product(p, v) / list_inner_product(v, v) < 0 AS is_past FROM p""")
def encounter(spark, d):
    n = M.vector_nodes(spark, d).select("id", "embedding")
    at = lambda k, name: n.select((F.col("id") - k).alias("id"), F.col("embedding").alias(name))
    rows = at(0, "a0").join(at(1, "a1"), "id").join(at(2, "b0"), "id").join(at(3, "b1"), "id")
    return R.encounter(rows).select("id", _r("t"), "is_past")


@query("muse_inspire", f"""WITH {NODES}, s AS (SELECT * FROM n WHERE id IN (4, 9, 30)), c AS (SELECT {_mean('e')} AS c FROM s)
 SELECT round(1 - greatest(0, (SELECT max(list_cosine_similarity(e, c)) FROM n, c WHERE id NOT IN (4, 9, 30))), 6) AS novelty, round((SELECT avg(list_cosine_similarity(e, c)) FROM s, c), 6) AS coherence""")
def muse_inspire(spark, d):
    return R.inspire(M.vector_nodes(spark, d), [4, 9, 30], DIM).select(_r("novelty"), _r("coherence"))


@query("reachability", f"""WITH RECURSIVE {LINKS}, p AS (SELECT vec_id AS a, vec_id + 3 AS b FROM embeddings), w AS (SELECT DISTINCT a, a AS i, 0 AS d FROM p UNION SELECT w.a, dst, d + 1 FROM w JOIN k ON src = i WHERE d < 2)
 SELECT a, b, EXISTS (SELECT 1 FROM w WHERE w.a = p.a AND w.i = p.b AND d > 0) AS reachable FROM p""")
def reachability(spark, d):
    pairs = M.vector_nodes(spark, d).select(F.col("id").alias("a"), (F.col("id") + 3).alias("b"))
    return R.reachability(M.vector_links(spark, d), pairs, 2)


@query("crystallize", f"""WITH RECURSIVE {NODES}, {LINKS}, j AS (SELECT a.id AS a, b.id AS b, list_cosine_similarity(a.e, b.e) AS s, row_number() OVER (PARTITION BY a.id ORDER BY list_cosine_similarity(a.e, b.e) DESC, b.id) AS r FROM n a JOIN n b ON a.id <> b.id),
 p AS (SELECT a, b, s FROM j WHERE r <= 10 AND s >= 0.25), w AS (SELECT DISTINCT a AS a, a AS i, 0 AS d FROM p UNION SELECT w.a, dst, d + 1 FROM w JOIN k ON src = i WHERE d < 2)
 SELECT p.a AS src, p.b AS dst, 'CRYSTALLIZED' AS label, round(s, 6) AS similarity FROM p WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.a = p.a AND w.i = p.b)""")
def crystallize(spark, d):
    return R.crystallize(M.vector_nodes(spark, d), M.vector_links(spark, d), 0.25).select("src", "dst", "label", _r("similarity"))


@query("narrative", f"""WITH {WRITES}, h AS (SELECT *, row_number() OVER o AS n, lag(kind) OVER o AS old FROM w WINDOW o AS (PARTITION BY id ORDER BY tf, version_id))
 SELECT id, 'v' || n || ': kind ' || CASE WHEN old IS NULL THEN 'added' ELSE 'modified' END || ' from ' || coalesce(old, '-') || ' to ' || kind AS line FROM h WHERE old IS DISTINCT FROM kind""")
def narrative(spark, d):
    return H.narrative(M.event_writes(spark, d), ["kind"]).select("id", "line")


@query("edge_mermaid", f"WITH {LINKS} SELECT '  n' || src || ' -->|' || label || '| n' || dst AS line FROM k")
def edge_mermaid(spark, d):
    return C.mermaid(M.vector_links(spark, d))


@query("audit_digests")
def audit_digests(spark, d):
    from ..sources.exporting import audit_rows

    return audit_rows(M.table(spark, d, "orders"), "o_orderkey")


@query("synergy", f"""WITH {NODES}, {LINKS}, m AS (SELECT id, e FROM n WHERE label = 1), u AS (SELECT src, dst FROM k WHERE src <> dst UNION SELECT dst, src FROM k WHERE src <> dst),
 g AS (SELECT src AS id, {_mean('e')} AS near FROM u JOIN m ON m.id = dst GROUP BY 1),
 x AS (SELECT e, CASE WHEN near IS NULL THEN e ELSE list_transform(range(1, {DIM + 1}), lambda i: e[i] * 0.5 + near[i] * 0.5) END AS y FROM m LEFT JOIN g USING (id))
 SELECT round(1 - list_cosine_similarity(p, q), 6) AS synergy FROM (SELECT {_mean('e')} AS p, {_mean('y')} AS q FROM x)""")
def synergy(spark, d):
    return R.synergy(M.vector_nodes(spark, d).where("label = 1"), M.vector_links(spark, d), DIM).select(_r("synergy"))


@query("scenic_route", f"""WITH RECURSIVE {NODES}, {LINKS}, {COSTS}, w AS (SELECT [1::BIGINT] AS path, 1::BIGINT AS here, 0.0::DOUBLE AS scenery
 UNION ALL SELECT list_append(path, dst), dst, scenery + cost FROM w JOIN c ON src = here WHERE here <> 9 AND len(path) <= 6 AND NOT list_contains(path, dst))
 SELECT path, round(scenery, 6) AS scenery FROM w WHERE here = 9 ORDER BY w.scenery DESC, path LIMIT 1""")
def scenic_route(spark, d):
    return S.scenic_route(M.vector_nodes(spark, d), M.vector_links(spark, d), 1, 9, 6).select("path", _r("scenery"))


@query("paradox", f"""WITH {NODES}, {LINKS}, h AS (SELECT DISTINCT src, dst FROM k), m AS (SELECT 0 AS t, id, e FROM n UNION ALL SELECT 1, id, list_transform(e, lambda x: x + id % 3) FROM n),
 p AS (SELECT a.t, src, dst, b.e AS vb, list_cosine_similarity(a.e, b.e) AS s FROM h JOIN m a ON a.id = src JOIN m b ON b.id = dst AND b.t = a.t),
 x AS (SELECT p.t, p.src, p.dst, p.s, list_cosine_similarity(c.e, p.vb) AS y FROM p JOIN h o ON o.src = p.src AND o.dst <> p.dst JOIN m c ON c.id = o.dst AND c.t = p.t),
 g AS (SELECT t, src, dst, any_value(s) AS s, coalesce(avg(y) FILTER (y <> 0), 0) AS a FROM x GROUP BY 1, 2, 3)
 SELECT f.src, f.dst, round(greatest(-1, least(1, -4 * (g.s - f.s) * (g.a - f.a))), 6) AS paradox FROM g f JOIN g ON g.src = f.src AND g.dst = f.dst WHERE f.t = 0 AND g.t = 1""")
def paradox(spark, d):
    n = M.vector_nodes(spark, d)
    after = n.withColumn("embedding", F.transform(F.col("embedding").cast("array<double>"), lambda x: x + F.col("id") % 3))
    return D.paradox(n, after, M.vector_links(spark, d)).select("src", "dst", _r("paradox"))


@query("trusted_versions", f"{TRUST}, x AS (SELECT root AS version, 1 - exp(sum(ln(1 - least(coalesce(c, 0), 1 - 1e-12)))) AS trust FROM w JOIN c ON c.v = w.v GROUP BY 1) SELECT version, round(trust, 6) AS trust FROM x WHERE trust >= 0.99")
def trusted_versions(spark, d):
    return PV.trusted(M.document_confidence(spark, d), M.document_lineage(spark, d), 0.99, "noisy_or").select("version", _r("trust"))


@query("lineage_page", """WITH RECURSIVE l AS (SELECT doc_id AS derived, doc_id // 2 AS source FROM documents WHERE doc_id > 0),
 w AS (SELECT doc_id AS root, doc_id AS v, 0 AS d FROM documents UNION ALL SELECT root, source, d + 1 FROM w JOIN l ON derived = v WHERE d < 5),
 c AS (SELECT root, v AS version, min(d) AS depth FROM w WHERE d > 0 GROUP BY 1, 2), n AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY depth, version) AS n FROM c),
 m AS (SELECT root, bool_or(n > 3 OR depth > 4) AS has_more FROM n GROUP BY 1) SELECT root, version, depth, has_more FROM n JOIN m USING (root) WHERE n <= 3 AND depth <= 4""")
def lineage_page(spark, d):
    roots = M.table(spark, d, "documents").select(F.col("doc_id").alias("root"))
    return PV.lineage_page(M.document_lineage(spark, d), roots, 4, 3)


@query("provenance_null", "SELECT doc_id AS version, source FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS NULL")
def provenance_null(spark, d):
    marks = M.table(spark, d, "labels").select("doc_id", F.col("quality").alias("confidence"))
    rows = M.table(spark, d, "documents").select("doc_id", "source").join(marks, "doc_id", "left")
    return PV.unattributed(rows, "confidence").select(F.col("doc_id").alias("version"), "source")


@query("provenance_projection", "SELECT doc_id AS version, source AS p_source, CASE WHEN (doc_id * 37 % 101) <= 100 THEN (doc_id * 37 % 101) / 100.0::DOUBLE END AS p_confidence FROM documents")
def provenance_projection(spark, d):
    out = PV.with_provenance(M.document_confidence(spark, d), ["version"])
    return out.select("version", F.col("provenance.source").alias("p_source"), F.col("provenance.confidence").alias("p_confidence"))


@query("merge_nodes", f"""WITH {NODES}, {LINKS}, m(s, v) AS (VALUES (3, 7), (10, 20), (3, 4)), t AS (SELECT eid, src, dst, coalesce(x.s, src) AS s, coalesce(y.s, dst) AS d
 FROM k LEFT JOIN m x ON x.v = src LEFT JOIN m y ON y.v = dst) SELECT eid, s AS src, d AS dst FROM t WHERE s <> d OR src = dst""")
def merge_nodes(spark, d):
    return S.merge_nodes(M.vector_nodes(spark, d), M.vector_links(spark, d), [(3, 7), (10, 20), (3, 4)])[1].select("eid", "src", "dst")


@query("duplicates_of", f"WITH {NODES} SELECT a.id, round(list_cosine_similarity(a.e, b.e), 6) AS score FROM n a, n b WHERE b.id = 5 AND a.id <> 5 AND list_cosine_similarity(a.e, b.e) >= 0.2 ORDER BY 2 DESC, 1 LIMIT 10")
def duplicates_of(spark, d):
    return S.duplicates_of(M.vector_nodes(spark, d), 5, 0.2).select("id", _r("score"))


def _scenario(spark, d):
    """Nodes 3 and 8 removed, and node 9's vector put in place of node 5's and under a new id."""
    nodes = M.vector_nodes(spark, d)
    nine = nodes.where("id = 9")
    return nodes, R.overlay(nodes, nine.withColumn("id", F.explode(F.array(F.lit(5).cast("long"), F.lit(-1).cast("long")))), [3, 8])


SCENARIO = "o AS (SELECT id, e, label FROM n WHERE id NOT IN (3, 5, 8) UNION ALL SELECT z.i AS id, e, label FROM n, (VALUES (5), (-1)) z(i) WHERE id = 9)"


@query("overlay_diff", f"""WITH {NODES}, {SCENARIO} SELECT coalesce(n.id, o.id) AS id, CASE WHEN n.id IS NULL THEN 'added' WHEN o.id IS NULL THEN 'removed' ELSE 'modified' END AS change
 FROM n FULL JOIN o ON n.id = o.id WHERE n.id IS NULL OR o.id IS NULL OR n.e <> o.e OR n.label <> o.label""")
def overlay_diff(spark, d):
    return R.overlay_diff(*_scenario(spark, d))


@query("overlay_knn", f"WITH {NODES}, {SCENARIO} SELECT id, round(list_cosine_similarity(e, {QS}), 6) AS score FROM o ORDER BY list_cosine_similarity(e, {QS}) DESC, id LIMIT 10")
def overlay_knn(spark, d):
    return knn(_scenario(spark, d)[1], Q, 10).select("id", _r("score"))


@query("overlay_edges", f"""WITH {NODES}, {LINKS} SELECT src, count(*) AS n FROM (SELECT eid, src, dst FROM k WHERE eid <> 4 UNION ALL SELECT -1, 6, 3 UNION ALL SELECT -2, 6, 2)
 WHERE src NOT IN (3, 8) AND dst NOT IN (3, 8) GROUP BY 1""")
def overlay_edges(spark, d):
    added = spark.createDataFrame([(-1, 6, 3, "NEXT"), (-2, 6, 2, "NEXT")], "eid long, src long, dst long, label string")
    return R.overlay_edges(M.vector_links(spark, d), added, [4], [3, 8]).groupBy("src").agg(F.count("*").alias("n"))


@query("gestalt", f"""WITH {NODES}, {LINKS} SELECT x.src AS a, x.dst AS b, y.dst AS c, round(list_cosine_similarity(n.e, {QS}), 6) AS a_score FROM k x JOIN k y ON y.src = x.dst JOIN n ON n.id = x.src
 WHERE x.label = 'NEXT' AND y.label = 'CHILD' AND x.eid <> y.eid AND x.src <> x.dst AND x.dst <> y.dst AND x.src <> y.dst AND list_cosine_similarity(n.e, {QS}) >= 0.1""")
def gestalt(spark, d):
    k = M.vector_links(spark, d)
    out = S.gestalt(M.vector_nodes(spark, d), [("a", k.where("label = 'NEXT'"), "b"), ("b", k.where("label = 'CHILD'"), "c")], {"a": (Q, 0.1)})
    return out.select("a", "b", "c", _r("a_score"))


@query("weave", f"""WITH RECURSIVE {LINKS}, p AS (SELECT [1::BIGINT] AS path, 1::BIGINT AS here, 0 AS hops UNION ALL SELECT list_append(path, dst), dst, hops + 1
 FROM p JOIN k ON src = here WHERE hops < 6 AND dst % 50 >= here % 50) SELECT path, hops::DOUBLE AS cost FROM p WHERE here = 31 ORDER BY cost, path LIMIT 1""")
def weave(spark, d):
    dated = M.vector_nodes(spark, d).withColumn("vf", F.col("id") % 50)
    return H.weave(dated, M.vector_links(spark, d), 1, 31)
