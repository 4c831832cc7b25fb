"""Queries of order statistics, rank correlation, folds and regressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.operators import effects, ordered, panel, ranks, stats
from turnlake.plans.queries import _FEATURES, _PANEL, _panel, q, qm, query, rounded
from turnlake.sources.tables import table


@query(f"""WITH {_PANEL}, s AS (SELECT unnest([0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE]) AS share), l AS (SELECT sector, 'mkvaltq' AS metric, mkvaltq AS v FROM panel UNION ALL SELECT sector, 'xrdq', xrdq FROM panel)
SELECT sector, metric, 0.25::DOUBLE AS share, {qm('quantile_cont(v, 0.25)')} AS value FROM l GROUP BY ALL UNION ALL SELECT sector, metric, 0.5::DOUBLE, {qm('quantile_cont(v, 0.5)')} FROM l GROUP BY ALL UNION ALL SELECT sector, metric, 0.75::DOUBLE, {qm('quantile_cont(v, 0.75)')} FROM l GROUP BY ALL""")
def sector_quartiles(spark: SparkSession, d: str) -> DataFrame:
    found = ordered.quantiles(_panel(spark, d), ["mkvaltq", "xrdq"], [0.25, 0.5, 0.75], ["sector"])
    return found.withColumn("value", F.floor(F.col("value") * 1e4 + 0.5) / 1e4)


_CUTS = [0.01, 0.5, 0.99]


@query("SELECT l_returnflag, metric, share, value FROM (" + " UNION ALL ".join(f"SELECT l_returnflag, '{c}' AS metric, {s}::DOUBLE AS share, {qm(f'quantile_cont({c}, {s})')} AS value FROM lineitem GROUP BY l_returnflag" for c in ("l_quantity", "l_extendedprice", "l_discount") for s in _CUTS) + ")")
def line_quantiles(spark: SparkSession, d: str) -> DataFrame:
    found = ordered.quantiles(table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], _CUTS, ["l_returnflag"])
    return found.withColumn("value", F.floor(F.col("value") * 1e4 + 0.5) / 1e4)


@query(f"""WITH j AS (SELECT n_chars AS x, quality, toxic FROM labels JOIN documents USING (doc_id)), l AS (SELECT 'quality' AS measure, x, quality AS y FROM j UNION ALL SELECT 'toxic', x, toxic FROM j),
p AS (SELECT a.measure, count(*) FILTER (WHERE (a.x < b.x AND a.y < b.y) OR (a.x > b.x AND a.y > b.y)) / 2 AS c, count(*) FILTER (WHERE (a.x < b.x AND a.y > b.y) OR (a.x > b.x AND a.y < b.y)) / 2 AS d, count(*) FILTER (WHERE a.x <> b.x) / 2 AS ux, count(*) FILTER (WHERE a.y <> b.y) / 2 AS uy FROM l a JOIN l b ON a.measure = b.measure GROUP BY a.measure),
n AS (SELECT measure, count(*) AS n FROM l WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY measure)
SELECT p.measure, n.n, CAST(c AS BIGINT) AS concordant, CAST(d AS BIGINT) AS discordant, {q('(c - d) / sqrt(ux) / sqrt(uy)')} AS tau FROM p JOIN n USING (measure)""")
def kendall_tau_b(spark: SparkSession, d: str) -> DataFrame:
    judged = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    rows = [(m, found["n"], found["concordant"], found["discordant"], found["tau"]) for m in ("quality", "toxic") for found in [ranks.kendall(judged, "n_chars", m)]]
    return rounded(spark.createDataFrame(rows, "measure string, n long, concordant long, discordant long, tau double"))


@query("""WITH RECURSIVE s AS (SELECT o_custkey, count(*) AS c, row_number() OVER (ORDER BY count(*) DESC, o_custkey) AS rn FROM orders GROUP BY o_custkey),
r AS (SELECT CAST(0 AS BIGINT) AS rn, [CAST(0 AS BIGINT) FOR x IN range(5)] AS load, [CAST(0 AS BIGINT) FOR x IN range(5)] AS own
UNION ALL SELECT s.rn, list_transform(load, lambda x, i: x + CASE WHEN i = list_position(load, list_min(load)) THEN c ELSE 0 END), list_transform(own, lambda x, i: x + CASE WHEN i = list_position(load, list_min(load)) THEN 1 ELSE 0 END) FROM r JOIN s ON s.rn = r.rn + 1)
SELECT CAST(i - 1 AS INTEGER) AS fold, own[i] AS n_groups, load[i] AS n_rows FROM (SELECT *, unnest(range(1, 6)) AS i FROM r ORDER BY rn DESC LIMIT 5)""")
def group_fold_loads(spark: SparkSession, d: str) -> DataFrame:
    dealt = stats.group_folds(table(spark, d, "orders"), "o_custkey", 5)
    return dealt.groupBy("fold").agg(F.count_distinct("o_custkey").alias("n_groups"), F.count("*").alias("n_rows"))


def _two_effects(absorbed: bool) -> str:
    """SQL of an OLS of y on x with effects of sector and year: dummies (all, or
    all but the first of each) are taken out of y, x and the constant one after
    another, and a regression on x, and the constant, of what is left remains."""
    first = 0 if absorbed else 1
    dummies = [f"s{i}" for i in range(first, 5)] + [f"t{i}" for i in range(1, 8)]
    steps = [
        f"{_FEATURES}, d AS (SELECT rd AS x, ym AS y, 1.0::DOUBLE AS c, dense_rank() OVER (ORDER BY sector) - 1 AS s, dense_rank() OVER (ORDER BY year) - 1 AS t FROM f WHERE rd IS NOT NULL AND ym IS NOT NULL)",
        "g0 AS (SELECT x, y, c, 0 AS used, " + ", ".join(f"CASE WHEN {c[0]} = {c[1:]} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS {c}" for c in dummies) + " FROM d)",
    ]
    for k, own in enumerate(dummies):
        rest = ["x", "y", "c", *dummies[k + 1 :]]
        steps.append(f"w{k} AS (SELECT CASE WHEN sum({own} * {own}) > 1e-9 THEN sum({own} * {own}) END AS nn, " + ", ".join(f"sum({own} * {c}) AS p_{c}" for c in rest) + f" FROM g{k})")
        steps.append(f"g{k + 1} AS (SELECT " + ", ".join(f"{c} - coalesce({own} * p_{c} / nn, 0) AS {c}" for c in rest) + f", used + CASE WHEN nn IS NULL THEN 0 ELSE 1 END AS used FROM g{k}, w{k})")
    constant = "0.0::DOUBLE" if absorbed else "c"
    steps += [
        f"m AS (SELECT x, y, {constant} AS c, used FROM g{len(dummies)})",
        "u AS (SELECT count(*) AS n, any_value(used) AS used, sum(x * x) AS a, sum(x * c) AS b, sum(c * c) AS k, sum(x * y) AS e, sum(c * y) AS g FROM m)",
        # The inverse of [[a, b], [b, k]], or of a alone.
        "i AS (SELECT n, used, CASE WHEN k > 0 THEN k / (a * k - b * b) ELSE 1 / a END AS p, CASE WHEN k > 0 THEN -b / (a * k - b * b) ELSE 0 END AS q, CASE WHEN k > 0 THEN a / (a * k - b * b) ELSE 0 END AS r, e, g, CASE WHEN k > 0 THEN 2 ELSE 1 END AS own FROM u)",
        "h AS (SELECT n, i.used, own, p * e + q * g AS b1, q * e + r * g AS b0, y - (p * e + q * g) * x - (q * e + r * g) * c AS res, p * x + q * c AS h1, q * x + r * c AS h0 FROM m, i)",
        "v AS (SELECT any_value(n) AS n, any_value(used) AS used, any_value(own) AS own, any_value(b1) AS b1, any_value(b0) AS b0, sum(res * res * h1 * h1) AS v1, sum(res * res * h0 * h0) AS v0 FROM h)",
        "l AS (SELECT unnest(['Intercept', 'rd_intensity']) AS term, unnest([b0, b1]) AS coef, unnest([sqrt(v0 * n / (n - used - own)), sqrt(v1 * n / (n - used - own))]) AS std_err, n, CAST(used AS BIGINT) AS absorbed FROM v)",
        "z AS (SELECT *, coef / nullif(std_err, 0) AS z, abs(coef / nullif(std_err, 0)) / sqrt(2.0) AS x FROM l)",
    ]
    chosen = "term, {}, n, absorbed FROM z WHERE term <> 'Intercept'" if absorbed else "term, {}, n FROM z"
    p = "CASE WHEN x > 4 THEN 0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 90), lambda j: (CASE WHEN j % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * j + 1) * ln(x) - lgamma(j + 1)) / (2 * j + 1))) END"
    return "WITH " + ",\n".join(steps) + " SELECT " + chosen.format(f"{q('coef')} AS coef, {q('std_err')} AS std_err, {q('z')} AS z, {q(p)} AS p")


@query(_two_effects(absorbed=False))
def fixed_effects(spark: SparkSession, d: str) -> DataFrame:
    rows = stats.fixed_effects(panel.panel_features(_panel(spark, d)), ["rd_intensity"], "y_next_mktcap_growth", ["sector", "year"], least=1)
    return rounded(spark.createDataFrame(rows, "coef double, n long, p double, std_err double, term string, z double"))


@query(_two_effects(absorbed=True))
def absorbed_effects(spark: SparkSession, d: str) -> DataFrame:
    rows = effects.absorbed_ols(panel.panel_features(_panel(spark, d)), ["rd_intensity"], "y_next_mktcap_growth", ["sector", "year"], least=1)
    return rounded(spark.createDataFrame(rows, "term string, coef double, std_err double, z double, p double, n long, absorbed long"))
