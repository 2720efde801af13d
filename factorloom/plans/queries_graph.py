"""Checked queries: cell graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from factorloom.operators import graph as g
from factorloom.plans.inputs import CW, EMB, NB, cells, graph
from factorloom.plans.registry import query, rounded

_MORAN = f"{CW}, mi AS (SELECT factor, pos, sum(c * w) / nullif(sum(c * c), 0) AS i, sum(e) * sum(e) / nullif(count(*) * sum(e * e), 0) AS pr FROM cw GROUP BY factor, pos)"


def _linked(spark, d):
    nodes, names, nb = graph(spark, d)
    return nodes, names, g.neighbour_edges(nb, nodes)


@query(
    "neighbour_mean",
    f"""WITH {NB}, m AS (SELECT nb.src AS id, pos, avg(x) AS wx FROM nb JOIN xs ON xs.id = nb.dst WHERE rank < 6 GROUP BY 1, 2)
    SELECT xs.id, xs.pos, round(wx, 8) AS wx FROM xs LEFT JOIN m ON m.id = xs.id AND m.pos = xs.pos""",
)
def neighbour_mean(spark, d):
    nodes, _, nb = graph(spark, d)
    out = g.neighbour_mean(nodes, g.neighbour_edges(nb, k=6))
    return rounded(out.select("id", F.posexplode("wx").alias("pos", "wx")), 8)


@query("moran", f"WITH {_MORAN} SELECT factor, pos, round(i, 8) AS moran_i FROM mi")
def moran(spark, d):
    nodes, names, edges = _linked(spark, d)
    return rounded(g.moran(nodes, edges, names), 8)


@query("participation", f"WITH {_MORAN} SELECT factor, pos, round(pr, 8) AS pr FROM mi")
def participation(spark, d):
    nodes, names, edges = _linked(spark, d)
    return rounded(g.participation(nodes, edges, names), 8)


_SHARES = f"""{CW}, sh AS (SELECT factor, pos, label, sum(e) / sum(sum(e)) OVER (PARTITION BY pos) AS share FROM cw GROUP BY factor, pos, label)"""


@query("footprint_shares", f"WITH {_SHARES} SELECT factor, pos, label, round(share, 8) AS share FROM sh")
def footprint_shares(spark, d):
    nodes, names, edges = _linked(spark, d)
    return rounded(g.footprint_shares(nodes, edges, names, "label"), 8)


@query(
    "footprint_shares_unlabelled",
    f"""WITH {CW}, lb AS (SELECT id, pos, factor, e, CASE WHEN label % 3 <> 0 THEN label END AS lab FROM cw),
    al AS (SELECT pos, sum(e) AS t FROM lb GROUP BY pos)
    SELECT factor, lb.pos, lab AS label, round(sum(e) / any_value(t), 8) AS share
    FROM lb JOIN al ON al.pos = lb.pos WHERE lab IS NOT NULL GROUP BY factor, lb.pos, lab""",
)
def footprint_shares_unlabelled(spark, d):
    """A third of the labels is taken away; their nodes stay in the denominator."""
    nodes, names, edges = _linked(spark, d)
    nodes = nodes.withColumn("label", F.when(F.col("label") % 3 != 0, F.col("label")))
    return rounded(g.footprint_shares(nodes, edges, names, "label"), 8)


@query(
    "moran_sparse_graph",
    f"""WITH {NB}, ed AS (SELECT DISTINCT src, dst FROM nb WHERE rank % 4 <> 0 AND src <> dst),
    mu AS (SELECT pos, avg(x) AS m FROM xs GROUP BY pos),
    c AS (SELECT id, xs.pos, factor, x - m AS c FROM xs JOIN mu ON mu.pos = xs.pos),
    w AS (SELECT ed.src AS id, pos, avg(c) AS w FROM ed JOIN c ON c.id = ed.dst GROUP BY ed.src, pos)
    SELECT factor, c.pos, round(sum(c * coalesce(w, 0)) / nullif(sum(c * c), 0), 8) AS moran_i
    FROM c LEFT JOIN w ON w.id = c.id AND w.pos = c.pos GROUP BY factor, c.pos""",
)
def moran_sparse_graph(spark, d):
    """Edges from the entries of a sparse matrix: some are zero, some repeat, some lie on the diagonal."""
    nodes, names, nb = graph(spark, d)
    entries = nb.select("src", "dst", (F.col("rank") % 4).alias("weight"))
    entries = entries.unionByName(entries.where("weight = 1")).unionByName(
        nodes.select(F.col("id").alias("src"), F.col("id").alias("dst"), F.lit(1).alias("weight"))
    )
    return rounded(g.moran(nodes, g.graph_edges(entries, nodes, weight="weight"), names), 8)


@query(
    "footprint_top",
    f"""WITH {_SHARES} SELECT factor, pos, label AS top, round(share, 8) AS top_share
    FROM (SELECT *, row_number() OVER (PARTITION BY pos ORDER BY share DESC, label) AS k FROM sh) WHERE k = 1""",
)
def footprint_top(spark, d):
    nodes, names, edges = _linked(spark, d)
    return rounded(g.footprint_top(g.footprint_shares(nodes, edges, names, "label")), 8)


_WITHIN = f"""{NB}, same AS (SELECT src, dst FROM nb WHERE ls = ld), has AS (SELECT DISTINCT src AS id FROM same),
gm AS (SELECT label, pos, avg(x) AS gm FROM xs GROUP BY label, pos),
cg AS (SELECT xs.id, xs.factor, xs.pos, x, CASE WHEN has.id IS NOT NULL THEN x - gm ELSE 0 END AS c FROM xs JOIN gm ON gm.label = xs.label AND gm.pos = xs.pos LEFT JOIN has ON has.id = xs.id),
wg AS (SELECT same.src AS id, pos, avg(c) AS w FROM same JOIN cg ON cg.id = same.dst GROUP BY same.src, pos),
wi AS (SELECT factor, cg.pos, CASE WHEN sum(c * c) > 1e-12 * sum(x * x) THEN sum(c * coalesce(w, 0)) / sum(c * c) END AS i FROM cg LEFT JOIN wg ON wg.id = cg.id AND wg.pos = cg.pos GROUP BY factor, cg.pos)"""


@query("moran_within_groups", f"WITH {_WITHIN} SELECT factor, pos, round(i, 8) AS moran_i_within_group FROM wi")
def moran_within_groups(spark, d):
    nodes, names, edges = _linked(spark, d)
    return rounded(g.moran_within_groups(nodes, edges, names, "label"), 8)


_SPEAR = f"""{NB}, rk AS (SELECT factor, pos, rank() OVER (PARTITION BY pos ORDER BY x) + (count(*) OVER (PARTITION BY pos, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY pos ORDER BY cov) + (count(*) OVER (PARTITION BY pos, cov) - 1) / 2.0 AS ry FROM xs),
sp AS (SELECT factor, pos, corr(rx, ry) AS r FROM rk GROUP BY factor, pos)"""


@query("covariate_spearman", f"WITH {_SPEAR} SELECT factor, pos, round(r, 8) AS covariate_spearman FROM sp")
def covariate_spearman(spark, d):
    nodes, names, _ = graph(spark, d)
    return rounded(g.covariate_spearman(nodes, names, "covariate"), 8)


_RESID = f"""{NB}, fit AS (SELECT pos, regr_slope(x, cov) AS b, regr_intercept(x, cov) AS a FROM xs GROUP BY pos),
rs AS (SELECT id, xs.pos, factor, x - a - b * cov AS r FROM xs JOIN fit ON fit.pos = xs.pos),
wr AS (SELECT nb.src AS id, pos, avg(r) AS w FROM nb JOIN rs ON rs.id = nb.dst GROUP BY nb.src, pos),
re AS (SELECT factor, rs.pos, sum(r * coalesce(w, 0)) / nullif(sum(r * r), 0) AS i FROM rs LEFT JOIN wr ON wr.id = rs.id AND wr.pos = rs.pos GROUP BY factor, rs.pos)"""


@query("moran_residual", f"WITH {_RESID} SELECT factor, pos, round(i, 7) AS moran_i_resid FROM re")
def moran_residual(spark, d):
    nodes, names, edges = _linked(spark, d)
    return rounded(g.moran_residual(nodes, edges, names, "covariate"), 7)


@query(
    "same_process_neighbours",
    f"""WITH {EMB}, nx AS (SELECT factor, pos, label, lead(label) OVER (PARTITION BY pos ORDER BY v, vec_id) AS l2 FROM emb),
    ct AS (SELECT factor, pos, label, count(l2) AS o, count(*) FILTER (WHERE l2 = label) AS b FROM nx GROUP BY 1, 2, 3),
    fr AS (SELECT label, count(*) / (SELECT count(*) FROM embeddings)::DOUBLE AS f FROM embeddings GROUP BY label)
    SELECT factor, pos, ct.label, round(greatest(0, (b / nullif(o, 0)::DOUBLE - f) / (1 - f)), 8) AS spn FROM ct JOIN fr ON fr.label = ct.label""",
)
def same_process_neighbours(spark, d):
    rows, names = cells(spark, d)
    return rounded(g.same_process_neighbours(rows, "x", names, "label", row="cell_id"), 8)


def _perm_sql(n_perm: int) -> str:
    seeds = ", ".join(str(10 + k) for k in range(n_perm))
    return f"""pid AS (SELECT vec_id AS id, row_number() OVER (ORDER BY vec_id) AS k FROM embeddings),
    ph AS (SELECT seed, vec_id AS other, row_number() OVER (PARTITION BY seed ORDER BY md5(vec_id || ':' || seed), vec_id) AS k
           FROM embeddings, (SELECT unnest([1, 2, {seeds}]) AS seed)),
    perm AS (SELECT seed, id, other FROM pid JOIN ph ON ph.k = pid.k),
    cp AS (SELECT perm.seed, perm.id, c.pos, c.c FROM perm JOIN c ON c.id = perm.other WHERE seed >= 2),
    wp AS (SELECT seed, nb.src AS id, pos, avg(cp.c) AS w FROM nb JOIN cp ON cp.id = nb.dst GROUP BY 1, 2, 3),
    ip AS (SELECT cp.seed, cp.pos, sum(cp.c * coalesce(w, 0)) AS vw,
             sum(greatest(coalesce(w, -m), 0)) AS e1, sum(pow(greatest(coalesce(w, -m), 0), 2)) AS e2, count(*) AS n
           FROM cp JOIN mu ON mu.pos = cp.pos LEFT JOIN wp ON wp.seed = cp.seed AND wp.id = cp.id AND wp.pos = cp.pos GROUP BY 1, 2),
    vv AS (SELECT pos, sum(c * c) AS vv FROM c GROUP BY pos),
    pv AS (SELECT ip.pos, (1 + count(*) FILTER (WHERE vw / vv >= i)) / {n_perm + 1}.0::DOUBLE AS moran_p
           FROM ip JOIN vv ON vv.pos = ip.pos JOIN mi ON mi.pos = ip.pos WHERE seed > 2 GROUP BY ip.pos),
    pn AS (SELECT pos, e1 * e1 / (n * e2) AS pr_null FROM ip WHERE seed = 2)"""


_BASE_COLS = """mi.factor, mi.pos, round(i, 7) AS moran_i, moran_p, round(pr, 7) AS pr, round(pr_null, 7) AS pr_null, round(1 - pr / pr_null, 6) AS specificity"""


def _round_specificity(df):
    return df.select(
        *[
            F.round(c, 6 if c == "specificity" else 7).alias(c) if t == "double" and c != "moran_p" else F.col(c)
            for c, t in df.dtypes
        ]
    )


@query(
    "graph_specificity",
    f"WITH {_MORAN}, {_perm_sql(49)} SELECT {_BASE_COLS}, CAST(NULL AS INTEGER) AS k FROM mi JOIN pv ON pv.pos = mi.pos JOIN pn ON pn.pos = mi.pos",
)
def graph_specificity(spark, d):
    nodes, names, edges = _linked(spark, d)
    return _round_specificity(g.graph_specificity(nodes, edges, names))


_FULL = (
    "WITH " + NB.replace("xs AS (", "xb AS (")
    + """, ks AS (SELECT unnest([5, 10]) AS k), nk AS (SELECT k, src, dst, ls, ld FROM nb JOIN ks ON rank < k),
pid AS (SELECT vec_id AS id, label, CAST(vec_id % 17 AS DOUBLE) AS cov, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings),
ph AS (SELECT seed, vec_id AS other, row_number() OVER (PARTITION BY seed ORDER BY md5(vec_id || ':' || seed), vec_id) AS r
  FROM embeddings, (SELECT unnest([1, 2, 10, 11, 12, 13, 14, 15, 16, 17, 18]) AS seed)),
perm AS (SELECT seed, id, other FROM pid JOIN ph ON ph.r = pid.r),
width AS (SELECT CAST(max(pos) + 1 AS INTEGER) AS m FROM emb),
xs AS (SELECT id, label, pos, factor, x, cov FROM xb
  UNION ALL SELECT pid.id, pid.label, m, '_perm_control', xb.x, pid.cov FROM pid JOIN perm ON perm.id = pid.id AND seed = 1 JOIN xb ON xb.id = perm.other AND xb.pos = 0, width
  UNION ALL SELECT id, label, m + 1, '_covariate', cov, cov FROM pid, width),
mu AS (SELECT pos, avg(x) AS m FROM xs GROUP BY pos),
c AS (SELECT id, label, xs.pos, factor, x, cov, x - m AS c, m FROM xs JOIN mu ON mu.pos = xs.pos),
w AS (SELECT k, nk.src AS id, c.pos, avg(c.c) AS w FROM nk JOIN c ON c.id = nk.dst GROUP BY 1, 2, 3),
cw AS (SELECT ks.k, c.*, coalesce(w.w, 0) AS w, greatest(coalesce(w.w, -c.m), 0) AS e FROM c JOIN ks ON true LEFT JOIN w ON w.k = ks.k AND w.id = c.id AND w.pos = c.pos),
mi AS (SELECT k, factor, pos, sum(c * w) / nullif(sum(c * c), 0) AS i, sum(c * c) AS vv, sum(e) * sum(e) / nullif(count(*) * sum(e * e), 0) AS pr FROM cw GROUP BY 1, 2, 3),
cp AS (SELECT perm.seed, perm.id, c.pos, c.c, c.m FROM perm JOIN c ON c.id = perm.other WHERE seed >= 2),
wp AS (SELECT k, seed, nk.src AS id, pos, avg(cp.c) AS w FROM nk JOIN cp ON cp.id = nk.dst GROUP BY 1, 2, 3, 4),
ip AS (SELECT ks.k, cp.seed, cp.pos, sum(cp.c * coalesce(w, 0)) AS vw, sum(greatest(coalesce(w, -m), 0)) AS e1, sum(pow(greatest(coalesce(w, -m), 0), 2)) AS e2, count(*) AS n
  FROM cp JOIN ks ON true LEFT JOIN wp ON wp.k = ks.k AND wp.seed = cp.seed AND wp.id = cp.id AND wp.pos = cp.pos GROUP BY 1, 2, 3),
pv AS (SELECT ip.k, ip.pos, (1 + count(*) FILTER (WHERE vw / vv >= i)) / 10.0::DOUBLE AS moran_p FROM ip JOIN mi ON mi.k = ip.k AND mi.pos = ip.pos WHERE seed > 2 GROUP BY 1, 2),
pn AS (SELECT k, pos, e1 * e1 / (n * e2) AS pr_null FROM ip WHERE seed = 2),
same AS (SELECT k, src, dst FROM nk WHERE ls = ld), has AS (SELECT DISTINCT k, src AS id FROM same),
gm AS (SELECT label, pos, avg(x) AS gm FROM xs GROUP BY label, pos),
cg AS (SELECT ks.k, xs.id, xs.pos, x, CASE WHEN has.id IS NOT NULL THEN x - gm ELSE 0 END AS c FROM xs JOIN ks ON true JOIN gm ON gm.label = xs.label AND gm.pos = xs.pos LEFT JOIN has ON has.k = ks.k AND has.id = xs.id),
wg AS (SELECT same.k, same.src AS id, pos, avg(c) AS w FROM same JOIN cg ON cg.k = same.k AND cg.id = same.dst GROUP BY 1, 2, 3),
wi AS (SELECT cg.k, cg.pos, CASE WHEN sum(c * c) > 1e-12 * sum(x * x) THEN sum(c * coalesce(w, 0)) / sum(c * c) END AS iw FROM cg LEFT JOIN wg ON wg.k = cg.k AND wg.id = cg.id AND wg.pos = cg.pos GROUP BY 1, 2),
fit AS (SELECT pos, regr_slope(x, cov) AS b, regr_intercept(x, cov) AS a FROM xs GROUP BY pos),
rs AS (SELECT c.id, c.pos, c.c, x - a - b * cov AS r FROM c JOIN fit ON fit.pos = c.pos),
wr AS (SELECT k, nk.src AS id, pos, avg(r) AS w FROM nk JOIN rs ON rs.id = nk.dst GROUP BY 1, 2, 3),
re AS (SELECT ks.k, rs.pos, CASE WHEN sum(r * r) > 1e-12 * sum(c * c) THEN sum(r * coalesce(w, 0)) / sum(r * r) END AS ir FROM rs JOIN ks ON true LEFT JOIN wr ON wr.k = ks.k AND wr.id = rs.id AND wr.pos = rs.pos GROUP BY 1, 2),
rk AS (SELECT pos, rank() OVER (PARTITION BY pos ORDER BY x) + (count(*) OVER (PARTITION BY pos, x) - 1) / 2.0 AS rx,
  rank() OVER (PARTITION BY pos ORDER BY cov) + (count(*) OVER (PARTITION BY pos, cov) - 1) / 2.0 AS ry FROM xs),
sp AS (SELECT pos, corr(rx, ry) AS rho FROM rk GROUP BY pos),
sh AS (SELECT k, pos, label, sum(e) / sum(sum(e)) OVER (PARTITION BY k, pos) AS share FROM cw GROUP BY k, pos, label),
tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, pos ORDER BY share DESC, label) AS n FROM sh) WHERE n = 1)
SELECT mi.factor, mi.pos, mi.k, round(i, 7) AS moran_i, moran_p, round(pr, 7) AS pr, round(pr_null, 7) AS pr_null, round(1 - pr / pr_null, 6) AS specificity,
  round(iw, 7) AS moran_i_within_group, round(ir, 7) AS moran_i_resid, round(rho, 7) AS covariate_spearman, tp.label AS top_label, round(share, 7) AS top_label_share
FROM mi JOIN pv ON pv.k = mi.k AND pv.pos = mi.pos JOIN pn ON pn.k = mi.k AND pn.pos = mi.pos JOIN wi ON wi.k = mi.k AND wi.pos = mi.pos
JOIN re ON re.k = mi.k AND re.pos = mi.pos JOIN sp ON sp.pos = mi.pos JOIN tp ON tp.k = mi.k AND tp.pos = mi.pos"""
)


@query("graph_specificity_full", _FULL)
def graph_specificity_full(spark, d):
    """All column groups, both reference rows, two prefix lengths."""
    nodes, names, nb = graph(spark, d)
    out = g.graph_specificity(
        nodes, nb, names, ks=[5, 10], group="label", annotate=["label"], covariate="covariate", control="f0", n_perm=9
    )
    return _round_specificity(out)
