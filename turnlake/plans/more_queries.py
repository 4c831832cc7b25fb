"""Queries of roles, sections, trends, tests and frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.operators import panel, rankings, stats, textmodels, tokens, turns
from turnlake.operators.keywords import term_hits
from turnlake.plans.queries import _PANEL, _SENTENCES, _panel, _sentences, _texts, _turns, q, qm, query, rounded
from turnlake.sources.tables import table

# Conversations -----------------------------------------------------------

#: Speakers by the length of what they say: a title, a firm, and three names alone.
_SPEAKERS = ["Jane Roe, CEO", "Bob Lee, UBS", "Ann Poe", "Tim Ode", "Kim Moe"]
_KINDS = ["management", "analyst", "unknown", "unknown", "unknown"]


def _roles_sql() -> str:
    """Labels first, then the gaps from who spoke before, turn by turn."""
    pick = lambda values: "CASE WHEN role = 'system' THEN '{}' ELSE [" + ", ".join(f"'{v}'" for v in values) + "][length(coalesce(text, '')) % 5 + 1] END"
    asks = "(contains(left(coalesce(text, ''), 500), '?') OR regexp_matches(lower(trim(coalesce(text, ''))), '^(can|could|what|how|why|when|where|is|are|do|does|would|will|should|may|might) '))"
    return f"""WITH RECURSIVE t AS (SELECT conv_id AS d, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k, lower({pick(_SPEAKERS).format('Operator')}) AS n, {pick(_KINDS).format('operator')} AS f, {asks} AS a FROM conversations),
known AS (SELECT DISTINCT d, n FROM t WHERE k <= 2 AND f <> 'operator'),
s AS (SELECT t.d, t.turn, t.k - 2 AS k, t.n, t.f, t.a, CASE WHEN f = 'operator' THEN NULL WHEN known.n IS NOT NULL THEN 'management' WHEN f <> 'unknown' THEN f END AS found FROM t LEFT JOIN known ON known.d = t.d AND known.n = t.n WHERE t.k > 2),
c AS (SELECT d, n, arg_max(found, k) FILTER (WHERE found IS NOT NULL) AS c FROM s GROUP BY d, n),
p AS (SELECT s.*, c.c, CASE WHEN f = 'operator' THEN 'operator' ELSE coalesce(found, last_value(found IGNORE NULLS) OVER (PARTITION BY s.d, s.n ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) END AS o FROM s JOIN c ON c.d = s.d AND c.n = s.n),
r AS (SELECT d, CAST(0 AS BIGINT) AS k, CAST(NULL AS VARCHAR) AS before, MAP([]::VARCHAR[], []::VARCHAR[]) AS notes, CAST(NULL AS VARCHAR) AS g FROM (SELECT DISTINCT d FROM p)
UNION ALL SELECT d, k, coalesce(g, before), CASE WHEN o IS NULL AND g IS NOT NULL THEN map_concat(notes, MAP([n], [g])) ELSE notes END, g FROM (SELECT r.d, p.k, r.before, r.notes, p.n, p.o, coalesce(p.o, p.c, r.notes[p.n], CASE r.before WHEN 'operator' THEN 'analyst' WHEN 'analyst' THEN 'management' END, CASE WHEN p.a THEN 'analyst' WHEN r.before = 'management' THEN 'management' END) AS g FROM r JOIN p ON p.d = r.d AND p.k = r.k + 1)),
e AS (SELECT d, arg_max(notes, k) AS notes FROM r GROUP BY d)
SELECT p.d AS doc_id, p.turn AS turn_idx, coalesce(r.g, p.c, e.notes[p.n], CASE WHEN p.a THEN 'analyst' ELSE 'management' END) AS role FROM p JOIN r ON r.d = p.d AND r.k = p.k JOIN e ON e.d = p.d"""


@query(_roles_sql())
def session_roles(spark: SparkSession, d: str) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    speaker = F.when(F.col("role") == "operator", "Operator").otherwise(F.element_at(F.array(*map(F.lit, _SPEAKERS)), (F.length(text) % 5 + 1).cast("int")))
    own = F.array_sort(F.collect_list(F.struct("turn_idx", speaker.alias("speaker"), "text")))
    calls = _turns(spark, d).groupBy("doc_id").agg(own.alias("all")).select("doc_id", F.slice("all", 1, 2).alias("speech_turns"), F.slice("all", F.lit(3), F.greatest(F.size("all") - 2, F.lit(0))).alias("qa_turns"))
    return turns.session_roles(calls).select("doc_id", F.explode(F.arrays_zip("qa_turns", "roles")).alias("z")).select("doc_id", F.col("z.qa_turns.turn_idx").alias("turn_idx"), F.col("z.roles").alias("role"))


@query(f"WITH {_SENTENCES} SELECT doc_id, turn_idx, string_agg(text, ' ') AS text, any_value(role) AS role, any_value(role) AS speaker, count(*) AS n_sentences FROM s WHERE section = 'qa' GROUP BY doc_id, turn_idx")
def turns_of_sentences(spark: SparkSession, d: str) -> DataFrame:
    return turns.turns_of_sentences(_sentences(spark, d).withColumn("speaker", F.col("role")))


_METRICS = f"""WITH {_SENTENCES}, m AS (SELECT doc_id, 'T' || doc_id % 7 AS ticker, CAST(2020 + doc_id % 4 AS INTEGER) AS year, count(*) FILTER (WHERE section = 'speech') AS st, count(*) FILTER (WHERE section = 'qa') AS qt,
sum(CASE WHEN section = 'speech' THEN CAST(hit AS INTEGER) END) AS sa, sum(CASE WHEN section = 'qa' THEN CAST(hit AS INTEGER) END) AS qa FROM s GROUP BY doc_id)"""


@query(f"""{_METRICS} SELECT ticker, year, {q('avg((coalesce(sa, 0) + coalesce(qa, 0))::DOUBLE / (st + qt))')} AS overall_kw_ai_ratio, {q('avg(coalesce(sa::DOUBLE / nullif(st, 0), 0))')} AS speech_kw_ai_ratio, {q('avg(coalesce(qa::DOUBLE / nullif(qt, 0), 0))')} AS qa_kw_ai_ratio,
CAST(sum(sa) AS BIGINT) AS speech_kw_ai_sentences, CAST(sum(qa) AS BIGINT) AS qa_kw_ai_sentences, CAST(sum(st) AS BIGINT) AS speech_total_sentences, CAST(sum(qt) AS BIGINT) AS qa_total_sentences, count(*) AS num_calls,
CAST(coalesce(sum(sa), 0) + coalesce(sum(qa), 0) AS BIGINT) AS overall_kw_ai_sentences, CAST(sum(st) + sum(qt) AS BIGINT) AS overall_total_sentences FROM m GROUP BY ticker, year""")
def company_years(spark: SparkSession, d: str) -> DataFrame:
    from turnlake.operators import metrics

    found = metrics.document_metrics(metrics.section_metrics(_sentences(spark, d)))
    keyed = found.withColumn("ticker", F.concat(F.lit("T"), (F.col("doc_id") % 7).cast("string"))).withColumn("year", (F.col("doc_id") % 4 + 2020).cast("int"))
    return rounded(rankings.company_years(keyed))


# Texts -------------------------------------------------------------------

_PHRASES = ["of the", "in the", "and the", "to the end", "that is", "the"]


@query("WITH t AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z]+') AS w FROM documents), g AS (SELECT doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS term FROM t) "
       f"SELECT doc_id, term, count(*) AS hits FROM g WHERE term IN ({', '.join(map(repr, _PHRASES))}) GROUP BY doc_id, term")  # fmt: skip
def phrase_hits(spark: SparkSession, d: str) -> DataFrame:
    return term_hits(_texts(spark, d), spark.createDataFrame([(p,) for p in _PHRASES], "term string"))


@query(f"""WITH l AS (SELECT doc_id, CAST(quality AS DOUBLE) AS y, text FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL), g AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z]+')) AS term FROM l), w AS (SELECT doc_id, term, count(*) AS x FROM g GROUP BY ALL),
f AS (SELECT count(*) AS n, avg(y) AS m, stddev_pop(y) AS s FROM l), u AS (SELECT term, count(*) AS df, sum(x) AS sx, sum(x * x) AS sq, sum(x * y) AS sp FROM w JOIN l USING (doc_id) GROUP BY term)
SELECT term, df, {q('(sp / n - sx::DOUBLE / n * m) / nullif(sqrt(greatest(sq::DOUBLE / n - (sx::DOUBLE / n) * (sx::DOUBLE / n), 0)) * s, 0)')} AS correlation FROM u, f""")
def term_correlations(spark: SparkSession, d: str) -> DataFrame:
    judged = table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "text"), "doc_id").dropna(subset=["quality"])
    weights = tokens.grams(judged).groupBy("doc_id", "term").agg(F.count("*").cast("double").alias("weight"))
    none = spark.createDataFrame([], "term string, coefficient double")
    return rounded(textmodels.volcano(weights, judged, "quality", none).select("term", "df", "correlation"))


# Panel -------------------------------------------------------------------


@query(f"WITH {_PANEL} SELECT ticker, year, quarter, {q('(mkvaltq - avg(mkvaltq) OVER ()) / stddev_samp(mkvaltq) OVER ()')} AS mkvaltq, {q('(xrdq - avg(xrdq) OVER ()) / stddev_samp(xrdq) OVER ()')} AS xrdq FROM panel")
def zscored_panel(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.zscored(_panel(spark, d), ["mkvaltq", "xrdq"]).select("ticker", "year", "quarter", "mkvaltq", "xrdq"))


@query(f"""WITH {_PANEL}, c AS (SELECT median(mkvaltq) AS m FROM panel) SELECT year, quarter, CASE WHEN mkvaltq >= m THEN 'large' ELSE 'small' END AS size_group, {qm('avg(xrdq)')} AS xrdq, count(*) AS n FROM panel, c GROUP BY ALL""")
def trends_by_size(spark: SparkSession, d: str) -> DataFrame:
    found = textmodels.series_by_size(_panel(spark, d), "xrdq", "mkvaltq")
    return found.withColumn("xrdq", F.floor(F.col("xrdq") * 1e4 + 0.5) / 1e4)


@query(f"WITH {_PANEL} SELECT ticker, year, quarter, {qm('mkvaltq')} AS mkvaltq FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY mkvaltq DESC, year DESC, quarter DESC) AS r FROM panel) WHERE r = 1")
def peak_quarters(spark: SparkSession, d: str) -> DataFrame:
    return panel.latest(_panel(spark, d), ["ticker"], ["mkvaltq", "year", "quarter"]).select("ticker", "year", "quarter", (F.floor(F.col("mkvaltq") * 1e4 + 0.5) / 1e4).alias("mkvaltq"))


@query("SELECT o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS a, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey DESC) AS b FROM orders) WHERE a <= 5 OR b <= 5")
def first_and_last(spark: SparkSession, d: str) -> DataFrame:
    return textmodels.head_and_tail(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"], 5)


@query("""WITH g AS (SELECT l_returnflag AS g, avg(l_quantity) AS m, var_samp(l_quantity) AS v, count(*) AS n FROM lineitem GROUP BY 1), w AS (SELECT sum(m * n) / sum(n) AS mean, count(*) AS k, sum(n) AS n FROM g)
SELECT 'anova' AS test, """ + q("sum(g.n * (m - mean) * (m - mean)) / (any_value(k) - 1) / (sum(v * (g.n - 1)) / (any_value(w.n) - any_value(k)))") + """ AS statistic FROM g, w UNION ALL
SELECT 'welch', """ + q("(a.m - b.m) / sqrt(a.v / a.n + b.v / b.n)") + " FROM g a, g b WHERE a.g = 'A' AND b.g = 'N'")  # fmt: skip
def mean_tests(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    rows = [("anova", stats.anova(lines, "l_returnflag", "l_quantity")["f"]), ("welch", stats.welch_t(lines, "l_returnflag", "l_quantity", "A", "N")["t"])]
    return rounded(spark.createDataFrame(rows, "test string, statistic double"))


@query(f"""WITH b AS (SELECT l_returnflag AS g, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1)
SELECT g AS l_returnflag, 'l_extendedprice' AS metric, count(*) AS n, {qm('min(CASE WHEN l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN l_extendedprice END)')} AS low, {qm('any_value(q1)')} AS q1, {qm('any_value(median)')} AS median, {qm('any_value(q3)')} AS q3,
{qm('max(CASE WHEN l_extendedprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN l_extendedprice END)')} AS high FROM lineitem JOIN b ON g = l_returnflag GROUP BY g""")
def price_boxes(spark: SparkSession, d: str) -> DataFrame:
    found = rankings.boxes(table(spark, d, "lineitem"), "l_returnflag", ["l_extendedprice"])
    return found.select(*[(F.floor(F.col(c) * 1e4 + 0.5) / 1e4).alias(c) if t == "double" else F.col(c) for c, t in found.dtypes])


@query("""WITH l AS (SELECT unnest(['0', '1']) AS v), n AS (SELECT CAST(quality AS VARCHAR) AS t, CAST(toxic AS VARCHAR) AS g, count(*) AS n FROM labels WHERE quality IS NOT NULL AND toxic IS NOT NULL GROUP BY ALL), x AS (SELECT a.v AS quality, b.v AS toxic, coalesce(n.n, 0) AS n FROM l a, l b LEFT JOIN n ON n.t = a.v AND n.g = b.v)
SELECT quality, toxic, n, """ + q("coalesce(n::DOUBLE / nullif(sum(n) OVER (PARTITION BY quality), 0), 0)") + " AS row_share FROM x")  # fmt: skip
def confusion_table(spark: SparkSession, d: str) -> DataFrame:
    judged = table(spark, d, "labels").select(F.col("quality").cast("string").alias("quality"), F.col("toxic").cast("string").alias("toxic"))
    return rounded(stats.confusion(judged, "quality", "toxic", ["0", "1"]))
