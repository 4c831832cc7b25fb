"""Queries over the driver tables, each with the same question in SQL.

``query`` registers a function under its name together with its oracle SQL (None
where SQL can't say it).  Doubles are rounded alike on both sides.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnlake.functions import roles as R
from turnlake.functions import scalars as S
from turnlake.operators import metrics, panel, rankings, stats, tokens, turns
from turnlake.operators.keywords import Lexicon, term_hits, topical, with_keywords
from turnlake.operators.sentences import sentences_of
from turnlake.sources.tables import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Words that stand in for a topic dictionary on the driver's texts.
STRONG, WEAK = ["that", "this"], ["of", "and", "to", "in"]


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return put


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[S.quantised(F.col(f"`{c}`")).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in df.dtypes])


def q(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.5) / 1e6"


def money(x: Column | str) -> Column:
    """Amounts of many digits: half up to four places, alike in every engine."""
    x = F.col(x) if isinstance(x, str) else x
    return F.floor(x * 1e4 + 0.5) / 1e4


def qm(x: str) -> str:
    return f"floor(({x}) * 1e4 + 0.5) / 1e4"


# Conversations -----------------------------------------------------------


def _topical_sql(text: str = "text") -> str:
    word = lambda w: f"regexp_matches(lower({text}), '(^|[^a-z])({w})([^a-z]|$)')"
    return f"({word('|'.join(STRONG))} OR {' + '.join(f'CAST({word(w)} AS INTEGER)' for w in WEAK)} >= 2)"


def _turns(spark: SparkSession, d: str) -> DataFrame:
    role = F.when(F.col("role") == "user", "analyst").when(F.col("role") == "assistant", "management").otherwise("operator")
    return table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("turn_idx"), role.alias("role"), "text")


def _mixed(spark: SparkSession, d: str) -> DataFrame:
    """The same turns with sides by place, so that runs are longer than one."""
    side = F.when(F.col("turn_idx") % 5 < 2, "analyst").when(F.col("turn_idx") % 5 == 2, "operator").otherwise("management")
    return _turns(spark, d).withColumn("role", side)


def _sentences(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).select("doc_id", F.when(F.col("turn_idx") < 2, "speech").otherwise("qa").alias("section"), "turn_idx", F.lit(0).alias("sentence_idx"), "role", "text", topical(F.col("text"), STRONG, WEAK).alias("kw_is_ai"))


_TURNS = """turns AS (SELECT conv_id AS doc_id, turn AS turn_idx, CASE role WHEN 'user' THEN 'analyst' WHEN 'assistant' THEN 'management' ELSE 'operator' END AS role, text FROM conversations)"""
_MIXED = """turns AS (SELECT conv_id AS doc_id, turn AS turn_idx, CASE WHEN turn % 5 < 2 THEN 'analyst' WHEN turn % 5 = 2 THEN 'operator' ELSE 'management' END AS role, text FROM conversations)"""
_SENTENCES = f"""{_TURNS}, s AS (SELECT doc_id, CASE WHEN turn_idx < 2 THEN 'speech' ELSE 'qa' END AS section, turn_idx, role, text, {_topical_sql()} AS hit FROM turns)"""
_RUNS = """marked AS (SELECT *, CASE WHEN lag(role) OVER (PARTITION BY doc_id ORDER BY turn_idx) = role THEN 0 ELSE 1 END AS fresh FROM turns),
numbered AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY turn_idx) AS run FROM marked),
runs AS (SELECT doc_id, CAST(run AS BIGINT) AS run, min(role) AS role, string_agg(text, ' ' ORDER BY turn_idx) AS text, count(*) AS n_turns, min(turn_idx) AS first_turn FROM numbered GROUP BY doc_id, run)"""
_EXCHANGES = f"""{_RUNS},
spoken AS (SELECT *, lead(role) OVER (PARTITION BY doc_id ORDER BY run) AS next_role, lead(text) OVER (PARTITION BY doc_id ORDER BY run) AS answer FROM runs WHERE role <> 'operator'),
ex AS (SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY run) - 1 AS INTEGER) AS exchange_idx, text AS question_text, answer AS answer_text FROM spoken WHERE role = 'analyst' AND next_role = 'management')"""
_TYPED = f"""typed AS (SELECT doc_id, exchange_idx, CASE WHEN qa THEN CASE WHEN aa THEN 'analyst_initiated' ELSE 'analyst_only' END WHEN aa THEN 'management_pivot' ELSE 'non_ai' END AS initiation_type
FROM (SELECT doc_id, exchange_idx, {_topical_sql('question_text')} AS qa, {_topical_sql('answer_text')} AS aa FROM ex))"""


def _typed(t: DataFrame) -> DataFrame:
    return turns.exchanges(t).withColumn("initiation_type", turns.initiation_type(topical(F.col("question_text"), STRONG, WEAK), topical(F.col("answer_text"), STRONG, WEAK)))


_SCORES = f"""SELECT doc_id, total_exchanges, total_ai_exchanges, analyst_initiated_count, management_pivot_count, analyst_only_count, non_ai_count,
{q('coalesce(analyst_initiated_count::DOUBLE / nullif(total_ai_exchanges, 0), 0)')} AS analyst_initiated_ratio, {q('coalesce(management_pivot_count::DOUBLE / nullif(total_ai_exchanges, 0), 0)')} AS management_pivot_ratio,
{q('coalesce(management_pivot_count::DOUBLE / nullif(management_pivot_count + analyst_initiated_count, 0), 0.5)')} AS ai_initiation_score
FROM (SELECT doc_id, count(*) AS total_exchanges, count(*) FILTER (WHERE initiation_type <> 'non_ai') AS total_ai_exchanges, count(*) FILTER (WHERE initiation_type = 'analyst_initiated') AS analyst_initiated_count,
count(*) FILTER (WHERE initiation_type = 'management_pivot') AS management_pivot_count, count(*) FILTER (WHERE initiation_type = 'analyst_only') AS analyst_only_count, count(*) FILTER (WHERE initiation_type = 'non_ai') AS non_ai_count FROM typed GROUP BY doc_id)"""


@query(f"WITH {_TURNS}, {_EXCHANGES}, {_TYPED} {_SCORES}")
def initiation_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(turns.initiation_scores(_typed(_turns(spark, d))))


@query(f"WITH {_MIXED}, {_EXCHANGES}, {_TYPED} {_SCORES}")
def initiation_scores_runs(spark: SparkSession, d: str) -> DataFrame:
    return rounded(turns.initiation_scores(_typed(_mixed(spark, d))))


@query(f"WITH {_TURNS}, {_EXCHANGES} SELECT doc_id, exchange_idx, question_text, answer_text FROM ex")
def qa_exchanges(spark: SparkSession, d: str) -> DataFrame:
    return turns.exchanges(_turns(spark, d))


@query(f"WITH {_MIXED}, {_EXCHANGES} SELECT doc_id, exchange_idx, question_text, answer_text FROM ex")
def qa_exchanges_runs(spark: SparkSession, d: str) -> DataFrame:
    return turns.exchanges(_mixed(spark, d))


@query(f"WITH {_MIXED}, {_RUNS} SELECT doc_id, run, role, n_turns, first_turn FROM runs")
def turn_role_runs(spark: SparkSession, d: str) -> DataFrame:
    return turns.role_runs(_mixed(spark, d)).select("doc_id", "run", "role", "n_turns", "first_turn")


@query(f"WITH {_TURNS}, {_EXCHANGES}, {_TYPED} SELECT doc_id, exchange_idx, initiation_type FROM typed")
def exchange_types(spark: SparkSession, d: str) -> DataFrame:
    return _typed(_turns(spark, d)).select("doc_id", "exchange_idx", "initiation_type")


@query("""WITH t AS (SELECT conv_id, turn, role = 'system' AS is_op, CASE WHEN trim(text) = '' THEN 0 ELSE len(string_split_regex(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), ' ')) END AS w FROM conversations)
SELECT conv_id AS doc_id, turn AS pos, CAST(coalesce(sum(CASE WHEN is_op THEN 0 ELSE w END) OVER win, 0) AS BIGINT) AS words_before, CAST(coalesce(sum(CASE WHEN is_op THEN 0 ELSE 1 END) OVER win, 0) AS BIGINT) AS talks_before
FROM t WINDOW win AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def boundary_prefix_counts(spark: SparkSession, d: str) -> DataFrame:
    speaker = F.when(F.col("role") == "system", "Operator").otherwise("Speaker")
    t = table(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), speaker.alias("speaker"), "text")
    return turns.prefix_counts(t).select("doc_id", "pos", "words_before", "talks_before")


@query("SELECT conv_id AS doc_id, turn AS turn_idx, (contains(left(text, 500), '?') OR regexp_matches(lower(trim(text)), '^(can|could|what|how|why|when|where|is|are|do|does|would|will|should|may|might) ')) AS is_question FROM conversations")
def question_turns(spark: SparkSession, d: str) -> DataFrame:
    return _turns(spark, d).select("doc_id", "turn_idx", R.is_question("text").alias("is_question"))


def _session_sql() -> str:
    """The six rules as windows over what was said before."""
    found = lambda patterns: "regexp_matches(x, '(?i)" + "|".join(patterns).replace("'", "''") + "')"
    holds = lambda phrases: "(" + " OR ".join(f"contains(lower(x), '{p}')" for p in [y.replace("'", "''") for y in phrases]) + ")"
    return f"""WITH {_TURNS}, t AS (SELECT doc_id, turn_idx AS pos, coalesce(text, '') AS x, role = 'operator' AS op, role, trim(regexp_replace(coalesce(text, ''), '[ \\t-\\r]+', ' ', 'g')) AS flat FROM turns),
b AS (SELECT *, sum(CASE WHEN role = 'management' AND flat <> '' THEN len(string_split(flat, ' ')) ELSE 0 END) OVER before AS words, sum(CAST(role = 'management' AS INTEGER)) OVER before AS talks, sum(CAST(NOT op AS INTEGER)) OVER before AS others FROM t
WINDOW before AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
r AS (SELECT doc_id, pos, op AND NOT {holds(R.WELCOME)} AND {found(R.STRONG_OPENING)} AND coalesce(words, 0) < {turns.SPEECH_WORDS} AS r1, op AND {found(R.STRONG_OPENING)} AND coalesce(talks, 0) >= {turns.STRONG_TURNS} AS r2,
op AND {found(R.WEAK_OPENING)} AND coalesce(talks, 0) >= {turns.WEAK_TURNS} AS r3, NOT op AND coalesce(talks, 0) + CAST(role = 'management' AS INTEGER) >= {turns.STRONG_TURNS} AND {holds(R.TRANSITION)} AS r4,
op AND coalesce(others, 0) > 0 AND contains(lower(x), 'first question') AS r5, role = 'analyst' AND contains(left(trim(x), 300), '?') AS asked FROM b)
SELECT doc_id, count(*) AS n_turns, CAST(coalesce(min(CASE WHEN r1 THEN pos END), min(CASE WHEN r2 THEN pos END), min(CASE WHEN r3 THEN pos END), min(CASE WHEN r4 THEN pos END), min(CASE WHEN r5 THEN pos END),
CASE WHEN bool_or(asked) THEN greatest(min(CASE WHEN asked THEN pos END) - 1, 0) END, count(*)) AS BIGINT) AS qa_start FROM r GROUP BY doc_id"""


@query(_session_sql())
def question_session_start(spark: SparkSession, d: str) -> DataFrame:
    speaker = F.when(F.col("role") == "operator", "Operator").when(F.col("role") == "analyst", "Unidentified Analyst").otherwise("Chief Officer")
    return turns.question_start(_turns(spark, d).select("doc_id", F.col("turn_idx").alias("pos"), speaker.alias("speaker"), "text"))


@query(f"WITH {_SENTENCES} SELECT doc_id, section, count(*) AS total_sentences, CAST(sum(CAST(hit AS INTEGER)) AS BIGINT) AS kw_ai_sentences, {q('avg(CAST(hit AS INTEGER))')} AS kw_ai_ratio FROM s GROUP BY doc_id, section")
def section_intensity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.section_metrics(_sentences(spark, d)))


@query(f"""WITH {_SENTENCES} SELECT doc_id, count(*) FILTER (WHERE section = 'speech') AS speech_total_sentences, {q("coalesce(avg(CASE WHEN section = 'speech' THEN CAST(hit AS INTEGER) END), 0)")} AS speech_kw_ai_ratio,
CAST(sum(CASE WHEN section = 'speech' THEN CAST(hit AS INTEGER) END) AS BIGINT) AS speech_kw_ai_sentences, count(*) FILTER (WHERE section = 'qa') AS qa_total_sentences, {q("coalesce(avg(CASE WHEN section = 'qa' THEN CAST(hit AS INTEGER) END), 0)")} AS qa_kw_ai_ratio,
CAST(sum(CASE WHEN section = 'qa' THEN CAST(hit AS INTEGER) END) AS BIGINT) AS qa_kw_ai_sentences, {q('avg(CAST(hit AS INTEGER))')} AS overall_kw_ai_ratio FROM s GROUP BY doc_id""")
def document_intensity(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.document_metrics(metrics.section_metrics(_sentences(spark, d))))


@query(f"""WITH {_SENTENCES}, g AS (SELECT doc_id, count(*) AS n, count(*) FILTER (WHERE section = 'qa') AS nq, count(*) FILTER (WHERE hit) AS na, count(*) FILTER (WHERE hit AND section = 'qa') AS naq,
count(*) FILTER (WHERE section = 'qa' AND role = 'analyst') AS ra, count(*) FILTER (WHERE section = 'qa' AND role = 'analyst' AND hit) AS raa, count(*) FILTER (WHERE section = 'qa' AND role = 'management') AS rm, count(*) FILTER (WHERE section = 'qa' AND role = 'management' AND hit) AS rma,
max(CASE WHEN section = 'qa' THEN turn_idx END) AS lt, min(CASE WHEN section = 'qa' AND hit THEN turn_idx END) AS ft, arg_min(role, turn_idx) FILTER (section = 'qa' AND hit) AS fr FROM s GROUP BY doc_id)
SELECT doc_id, {q('1.0 * nq / nullif(n, 0)')} AS qa_share, {q('1.0 * naq / nullif(na, 0)')} AS ai_qa_share, {q('1.0 * raa / nullif(ra, 0)')} AS analyst_ai_share, {q('1.0 * rma / nullif(rm, 0)')} AS management_ai_share,
{q('1.0 * ft / nullif(lt, 0)')} AS first_ai_position, coalesce(fr, 'none') AS first_ai_role FROM g""")
def structural_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.structure(_sentences(spark, d)))


@query("SELECT conv_id AS doc_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def doc_text_concat(spark: SparkSession, d: str) -> DataFrame:
    return tokens.document_text(_sentences(spark, d).withColumn("section", F.lit("qa")))


@query(f"WITH {_SENTENCES} SELECT doc_id, count(*) FILTER (WHERE section = 'speech') AS speech, count(*) FILTER (WHERE section = 'qa') AS qa FROM s GROUP BY doc_id")
def pivot_sections(spark: SparkSession, d: str) -> DataFrame:
    return _sentences(spark, d).groupBy("doc_id").pivot("section", ["speech", "qa"]).count().fillna(0, ["speech", "qa"])


@query(f"""WITH {_SENTENCES}, hits AS (SELECT doc_id, turn_idx FROM s WHERE hit AND section = 'qa')
SELECT DISTINCT s.doc_id, s.turn_idx FROM s JOIN hits ON s.doc_id = hits.doc_id AND abs(s.turn_idx - hits.turn_idx) <= 1""")
def context_windows(spark: SparkSession, d: str) -> DataFrame:
    s = _sentences(spark, d)
    return rankings.around(s, s.filter(F.col("kw_is_ai") & (F.col("section") == "qa")), 1, place="turn_idx").select("doc_id", "turn_idx")


@query(f"""WITH {_SENTENCES}, {_EXCHANGES}, n AS (SELECT count(*) AS t, count(*) FILTER (WHERE section = 'speech') AS sp, count(*) FILTER (WHERE section = 'qa') AS qa, count(DISTINCT doc_id) AS c FROM s), x AS (SELECT count(DISTINCT doc_id) AS e FROM ex)
SELECT unnest(['calls', 'sentences', 'speech_sentences', 'qa_sentences', 'calls_with_exchanges']) AS step, unnest([c, t, sp, qa, e]) AS n, unnest([1.0::DOUBLE, 1.0::DOUBLE, {q('sp::DOUBLE / t')}, {q('qa::DOUBLE / t')}, {q('e::DOUBLE / c')}]) AS share FROM n, x""")
def funnel(spark: SparkSession, d: str) -> DataFrame:
    s = _sentences(spark, d)
    return rounded(metrics.funnel(s.select("doc_id").distinct(), s, turns.exchanges(_turns(spark, d))))


# Documents ---------------------------------------------------------------



def _texts(spark: SparkSession, d: str) -> DataFrame:
    return spread(table(spark, d, "documents").select("doc_id", "text"))


_TOKENS = "w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents)"


@query(f"WITH {_TOKENS} SELECT term, count(*) AS n FROM w GROUP BY term ORDER BY n DESC, term LIMIT 50")
def term_frequency_top50(spark: SparkSession, d: str) -> DataFrame:
    return tokens.term_frequency(_texts(spark, d)).orderBy(F.desc("n"), "term").limit(50)


@query(f"WITH {_TOKENS} SELECT term, count(DISTINCT doc_id) AS df FROM w GROUP BY term")
def document_frequency(spark: SparkSession, d: str) -> DataFrame:
    return tokens.document_frequency(_texts(spark, d), unique=True)


@query(f"WITH {_TOKENS} SELECT doc_id, term, count(*) AS hits FROM w WHERE term IN ('that', 'this', 'of', 'and', 'to', 'in') GROUP BY doc_id, term")
def keyword_hits(spark: SparkSession, d: str) -> DataFrame:
    return term_hits(table(spark, d, "documents"), spark.createDataFrame([(w,) for w in STRONG + WEAK], "term string"))


def _keyword_sql() -> str:
    """Every place of every keyword, its neighbours and its wider context.

    Word boundaries are those of ASCII in DuckDB, so all other letters are first
    replaced by a q, which no keyword holds.
    """
    lex = Lexicon()
    text = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({text(w)}, {text(c)}, {text('(?i)' + p.pattern)}, {c in lex.strong}, {text(lex.family[w])})" for c, w, p in lex.terms)
    near, wide = text("(?i)" + "|".join(lex.neighbours)), text("(?i)" + "|".join(lex.routine))
    around = lambda n: f"substr(x, greatest(a - {n}, 0) + 1, least(b + {n}, length(x)) - greatest(a - {n}, 0))"
    kept = "count(*) FILTER (WHERE NOT strong AND NOT routine)"
    score = f"coalesce((count(*) FILTER (WHERE strong) + {kept}) * 100.0::DOUBLE / nullif(any_value(words), 0), 0)"
    return f"""WITH t AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x{{AA}}\\x{{B5}}\\x{{BA}}\\x{{C0}}-\\x{{D6}}\\x{{D8}}-\\x{{F6}}\\x{{F8}}-\\x{{2FF}}\\x{{370}}-\\x{{1FFF}}\\x{{3040}}-\\x{{D7FF}}]', 'q', 'g') AS x FROM documents),
k(word, category, pattern, strong, family) AS (VALUES {rows}),
h AS (SELECT doc_id, x, category, strong, family, regexp_extract_all(x, pattern) AS f, string_split_regex(x, pattern) AS s FROM t JOIN k ON contains(lower(x), word)),
p AS (SELECT doc_id, x, category, strong, family, f, s, unnest(range(1, len(f) + 1)) AS i FROM h),
m AS (SELECT *, CAST(list_sum(list_transform(s[1:i], lambda y: length(y))) + coalesce(list_sum(list_transform(f[1:i - 1], lambda y: length(y))), 0) AS BIGINT) AS a, length(f[i]) AS n FROM p),
c AS (SELECT *, a + n AS b FROM m), g AS (SELECT *, NOT strong AND regexp_matches({around(120)}, {wide}) AS routine FROM c WHERE NOT regexp_matches({around(10)}, {near})),
w AS (SELECT doc_id, len(list_filter(string_split_regex(x, '[\\t-\\r\\x1C-\\x20\\x{{85}}\\x{{A0}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+'), lambda y: y <> '')) AS words FROM t)
SELECT w.doc_id, count(*) FILTER (WHERE strong) >= 1 OR count(DISTINCT family) FILTER (WHERE NOT strong AND NOT routine) >= 2 AS kw_is_ai, CAST(count(g.doc_id) AS INTEGER) AS kw_match_count, {q(score)} AS kw_ai_score,
CAST(count(*) FILTER (WHERE strong) AS INTEGER) AS kw_strong_count, CAST(count(*) FILTER (WHERE NOT strong) AS INTEGER) AS kw_weak_count, CAST({kept} AS INTEGER) AS kw_weak_nonexcluded_count,
{', '.join(f"CAST(count(*) FILTER (WHERE category = '{c}') AS INTEGER) AS kw_{c}_count" for c in lex.categories)} FROM w LEFT JOIN g ON g.doc_id = w.doc_id GROUP BY w.doc_id"""


@query(_keyword_sql())
def keyword_signal_exact(spark: SparkSession, d: str) -> DataFrame:
    return rounded(with_keywords(_texts(spark, d)).drop("text"))


@query(f"""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents)
SELECT doc_id, {q("coalesce(len(list_filter(w, lambda x: x IN ('that', 'this'))) / nullif(len(w)::DOUBLE, 0), 0)")} AS strong_ratio, {q("coalesce(len(list_filter(w, lambda x: x IN ('of', 'and', 'to', 'in'))) / nullif(len(w)::DOUBLE, 0), 0)")} AS weak_ratio FROM t""")
def mechanism_ratios(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tokens.lexicon_ratios(table(spark, d, "documents"), {"strong": STRONG, "weak": WEAK}))


@query(f"""WITH {_SENTENCES}, c AS (SELECT doc_id, sum(CASE WHEN hit THEN len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: x IN ({', '.join(repr(w) for w in tokens.POSITIVE)}))) ELSE 0 END) AS p,
sum(CASE WHEN hit THEN len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: x IN ({', '.join(repr(w) for w in tokens.NEGATIVE)}))) ELSE 0 END) AS n FROM s GROUP BY doc_id)
SELECT doc_id, {q('coalesce(p::DOUBLE / nullif(p + n, 0), 0)')} AS positive_tone_ratio, {q('coalesce(n::DOUBLE / nullif(p + n, 0), 0)')} AS negative_tone_ratio FROM c""")
def tone_ratios(spark: SparkSession, d: str) -> DataFrame:
    return rounded(tokens.tone(_sentences(spark, d)))


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z]+') AS w FROM documents), g AS (SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS term FROM t WHERE len(w) > 1)
SELECT term, count(*) AS n FROM g GROUP BY term""")
def bigram_counts(spark: SparkSession, d: str) -> DataFrame:
    return tokens.term_frequency(_texts(spark, d), 2, 2)


@query(f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM documents), c AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY doc_id, term), n AS (SELECT count(DISTINCT doc_id) AS docs FROM documents),
k AS (SELECT term, count(*) AS df FROM c GROUP BY term HAVING count(*) >= 2), r AS (SELECT c.doc_id, c.term, tf, df, (1 + ln(tf)) * (ln((1 + docs)::DOUBLE / (1 + df)) + 1) AS w FROM c JOIN k USING (term), n),
x AS (SELECT doc_id, term, tf, df, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS weight FROM r)
SELECT doc_id, term, tf, df, {q('weight')} AS weight FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY floor(weight * 1e6 + 0.5) DESC, term) AS n FROM x) WHERE n <= 3""")
def tfidf_top_terms(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = tokens.tfidf(table(spark, d, "documents"), 1, 1, min_df=2)
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc(F.floor(F.col("weight") * 1e6 + 0.5)), "term"))
    return rounded(w.withColumn("_n", rank).filter("_n <= 3").drop("_n"))


@query("SELECT doc_id, CAST(len(list_filter(string_split_regex(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), ' '), lambda x: x <> '')) AS INTEGER) AS words, CASE WHEN length(text) > 80 THEN left(text, 80) || '...' ELSE text END AS preview FROM documents")
def text_previews(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", S.word_count(F.regexp_replace("text", "[ \\t\\n\\r]+", " ")).alias("words"), S.truncated("text", 80).alias("preview"))


@query(r"""WITH f AS (SELECT doc_id, trim(regexp_replace(coalesce(text, ''), '[ \t-\r]+', ' ', 'g')) AS x FROM documents), c AS (SELECT doc_id, trim(regexp_replace(regexp_replace(x, '\[[^\]]*\]', '', 'g'), '\([^)]*\)', '', 'g')) AS x FROM f),
s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(x, '([.!?])[ \t-\r]+([\p{Lu}"“0-9])', E'\\1\x01\\2', 'g'), chr(1)), lambda y: trim(y)), lambda y: length(y) >= 10) AS s FROM c)
SELECT doc_id, CAST(i - 1 AS INTEGER) AS sentence_idx, CASE WHEN length(s[i]) > 512 THEN left(s[i], 512) || '...' ELSE s[i] END AS text FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM s)""")
def sentence_explode(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d).select("doc_id", F.posexplode(sentences_of(F.col("text"))).alias("sentence_idx", "text"))


# Panel -------------------------------------------------------------------


def _panel(spark: SparkSession, d: str) -> DataFrame:
    o, c, n, r = (table(spark, d, t) for t in ("orders", "customer", "nation", "region"))
    money = F.col("o_totalprice").cast("decimal(18,2)")
    joined = o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), c.c_nationkey == n.n_nationkey).join(F.broadcast(r), n.n_regionkey == r.r_regionkey)  # 25 and 5 rows
    total = F.sum(money).cast("double")
    return joined.groupBy(F.col("n_name").alias("ticker"), F.col("r_name").alias("sector"), F.year("o_orderdate").alias("year"), F.quarter("o_orderdate").alias("quarter")).agg(
        total.alias("mkvaltq"), F.coalesce(F.sum(F.when(F.col("o_orderpriority") == "1-URGENT", money)), F.lit(0)).cast("double").alias("xrdq"), F.max("o_totalprice").alias("prccq"), (total / F.count("*") - 250000.0).alias("epspxq"),
    )


_PANEL = """panel AS (SELECT n_name AS ticker, r_name AS sector, CAST(year(o_orderdate) AS INTEGER) AS year, CAST(quarter(o_orderdate) AS INTEGER) AS quarter, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS mkvaltq,
CAST(coalesce(sum(CASE WHEN o_orderpriority = '1-URGENT' THEN CAST(o_totalprice AS DECIMAL(18,2)) END), 0) AS DOUBLE) AS xrdq, max(o_totalprice) AS prccq, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) - 250000.0::DOUBLE AS epspxq
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2, 3, 4)"""
_FEATURES = f"""{_PANEL}, base AS (SELECT *, xrdq / nullif(mkvaltq, 0) AS rd, ln(nullif(mkvaltq, 0)) AS lm, ln(nullif(prccq, 0)) AS lp FROM panel),
f AS (SELECT *, epspxq / nullif(lag(epspxq, 4) OVER w, 0) - 1 AS eg, prccq / nullif(lag(prccq, 4) OVER w, 0) - 1 AS pg, mkvaltq / nullif(lag(mkvaltq) OVER w, 0) - 1 AS mg, rd - lag(rd) OVER w AS rc, lead(rd) OVER w - rd AS yr, lead(mkvaltq) OVER w / nullif(mkvaltq, 0) - 1 AS ym
FROM base WINDOW w AS (PARTITION BY ticker ORDER BY year, quarter))"""


@query(f"""WITH {_FEATURES} SELECT ticker, year, quarter, {q('rd')} AS rd_intensity, {q('lm')} AS log_mktcap, {q('lp')} AS ln_price, CASE WHEN epspxq > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS eps_positive, {q('eg')} AS eps_growth_yoy, {q('pg')} AS price_growth_yoy,
{q('mg')} AS mktcap_growth_qoq, {q('rc')} AS rd_intensity_change_qoq, {q('yr')} AS y_next_rd_intensity_change, {q('ym')} AS y_next_mktcap_growth, {q('lead(eg) OVER (PARTITION BY ticker ORDER BY year, quarter)')} AS y_next_eps_growth_yoy FROM f""")
def panel_features(spark: SparkSession, d: str) -> DataFrame:
    return rounded(panel.panel_features(_panel(spark, d)).drop("sector", "mkvaltq", "xrdq", "prccq", "epspxq"))


@query(f"""WITH {_FEATURES} SELECT ticker, year, quarter, CASE WHEN ym IS NOT NULL THEN CAST(ym > median(ym) OVER (PARTITION BY year, quarter, sector) AS INTEGER) END AS beats_sector_median FROM f""")
def beats_sector_median(spark: SparkSession, d: str) -> DataFrame:
    return panel.above_group_median(panel.panel_features(_panel(spark, d)), "y_next_mktcap_growth", ["year", "quarter", "sector"], "beats_sector_median").select("ticker", "year", "quarter", "beats_sector_median")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def dedupe_last(spark: SparkSession, d: str) -> DataFrame:
    return panel.latest(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderdate")


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders) WHERE n = 1")
def dedupe_first(spark: SparkSession, d: str) -> DataFrame:
    return panel.earliest(table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"]).select("o_custkey", "o_orderkey", "o_orderdate")


@query(f"""WITH {_PANEL}, b AS (SELECT quantile_cont(mkvaltq, 0.01) AS ml, quantile_cont(mkvaltq, 0.99) AS mh, quantile_cont(xrdq, 0.01) AS xl, quantile_cont(xrdq, 0.99) AS xh FROM panel)
SELECT ticker, year, quarter, {q('greatest(ml, least(mh, mkvaltq))')} AS mkvaltq, {q('greatest(xl, least(xh, xrdq))')} AS xrdq FROM panel, b""")
def winsorised_panel(spark: SparkSession, d: str) -> DataFrame:
    return rounded(panel.winsorised(_panel(spark, d), ["mkvaltq", "xrdq"]).select("ticker", "year", "quarter", "mkvaltq", "xrdq"))


@query(f"""WITH {_PANEL}, r AS (SELECT *, row_number() OVER (ORDER BY mkvaltq, ticker, year, quarter) AS r, count(*) OVER () AS n FROM panel), b AS (SELECT *, CAST(greatest(ceil((r - 1) * 10.0 / greatest(n - 1, 1)) - 1, 0) AS INTEGER) AS decile FROM r)
SELECT decile, count(*) AS n, {q('avg(xrdq)')} AS xrdq FROM b GROUP BY decile""")
def decile_means(spark: SparkSession, d: str) -> DataFrame:
    return rounded(panel.deciles(_panel(spark, d), "mkvaltq", ["ticker", "year", "quarter"]).groupBy("decile").agg(F.count("*").alias("n"), F.avg("xrdq").alias("xrdq")))


@query(f"""WITH {_PANEL} SELECT year, quarter, {qm('avg(mkvaltq)')} AS mkvaltq_mean, {qm('stddev_samp(mkvaltq)')} AS mkvaltq_std, {qm('avg(xrdq)')} AS xrdq_mean, {qm('stddev_samp(xrdq)')} AS xrdq_std, count(*) AS n FROM panel GROUP BY year, quarter""")
def quarter_trends(spark: SparkSession, d: str) -> DataFrame:
    t = rankings.quarter_trends(_panel(spark, d), ["mkvaltq", "xrdq"])
    return t.withColumns({c: money(c) for c in ("mkvaltq_mean", "mkvaltq_std", "xrdq_mean", "xrdq_std")})


@query(f"""WITH {_PANEL}, e AS (SELECT ticker, year, avg(mkvaltq) AS mkvaltq, avg(xrdq) AS xrdq FROM panel GROUP BY ticker, year), l AS (SELECT ticker, year, 'mkvaltq' AS metric, mkvaltq AS value FROM e UNION ALL SELECT ticker, year, 'xrdq', xrdq FROM e)
SELECT year, metric, CAST(rank AS INTEGER) AS rank, ticker, {q('value')} AS value FROM (SELECT *, row_number() OVER (PARTITION BY year, metric ORDER BY value DESC, ticker) AS rank FROM l) WHERE rank <= 10""")
def top_k_per_year(spark: SparkSession, d: str) -> DataFrame:
    e = rankings.entity_year(_panel(spark, d), "ticker", ["mkvaltq", "xrdq"], [])
    return rounded(rankings.top_k(e, ["year"], ["mkvaltq", "xrdq"], 10, "ticker"))


@query(f"""WITH {_PANEL}, e AS (SELECT sector, ticker, year, avg(mkvaltq) AS m FROM panel GROUP BY sector, ticker, year) SELECT sector, year, {q('avg(m)')} AS mkvaltq, count(DISTINCT ticker) AS n_entities FROM e GROUP BY sector, year""")
def industry_year(spark: SparkSession, d: str) -> DataFrame:
    p = _panel(spark, d)
    return rounded(rankings.group_year(p.groupBy("sector", "ticker", "year").agg(F.avg("mkvaltq").alias("mkvaltq")), "sector", "ticker", "mkvaltq"))


def _quadrant_sql(cut: str, op: str) -> str:
    return f"""WITH {_PANEL}, e AS (SELECT ticker, avg(mkvaltq) AS x, avg(xrdq) AS y FROM panel GROUP BY ticker), c AS (SELECT {cut.format(v='x')} AS cx, {cut.format(v='y')} AS cy FROM e)
SELECT ticker, CASE WHEN x {op} cx AND y {op} cy THEN 'Aligned' WHEN y {op} cy THEN 'Passive' WHEN x {op} cx THEN 'Self-Promoting' ELSE 'Silent' END AS quadrant FROM e, c"""


def _entities(spark: SparkSession, d: str) -> DataFrame:
    return _panel(spark, d).groupBy("ticker").agg(F.avg("mkvaltq").alias("x"), F.avg("xrdq").alias("y"))


@query(_quadrant_sql("avg({v})", ">"))
def quadrants_mean(spark: SparkSession, d: str) -> DataFrame:
    return rankings.quadrants(_entities(spark, d), "x", "y", "mean").select("ticker", "quadrant")


@query(_quadrant_sql("coalesce(median(CASE WHEN {v} <> 0 THEN {v} END), 0)", ">"))
def quadrants_median_nonzero(spark: SparkSession, d: str) -> DataFrame:
    return rankings.quadrants(_entities(spark, d), "x", "y", "median_nonzero").select("ticker", "quadrant")


@query(_quadrant_sql("median({v})", ">=").replace("'Aligned'", "'High-High'").replace("'Passive'", "'Low AI / High Analyst'").replace("'Self-Promoting'", "'High AI / Low Analyst'").replace("'Silent'", "'Low-Low'"))
def quadrants_association(spark: SparkSession, d: str) -> DataFrame:
    return rankings.quadrants(_entities(spark, d), "x", "y", "median", inclusive=True, labels=rankings.ASSOCIATION).select("ticker", "quadrant")


@query(_quadrant_sql("median({v})", ">="))
def quadrants_ge_median(spark: SparkSession, d: str) -> DataFrame:
    return rankings.quadrants(_entities(spark, d), "x", "y", "median", inclusive=True).select("ticker", "quadrant")


@query(f"""WITH z AS ({_quadrant_sql('median({v})', '>')}), p AS (WITH {_PANEL} SELECT * FROM panel), s AS (SELECT quadrant, avg(mkvaltq) AS m, stddev_samp(mkvaltq) AS sd, count(mkvaltq) AS n FROM p JOIN z USING (ticker) GROUP BY quadrant)
SELECT quadrant, {qm('m')} AS mkvaltq_mean, {qm('sd')} AS mkvaltq_std, coalesce(n, 0) AS mkvaltq_n FROM (SELECT unnest(['Aligned', 'Passive', 'Self-Promoting', 'Silent']) AS quadrant) LEFT JOIN s USING (quadrant)""")
def quadrant_financials(spark: SparkSession, d: str) -> DataFrame:
    z = rankings.quadrants(_entities(spark, d), "x", "y", "median").select("ticker", "quadrant")
    return rankings.quadrant_stats(_panel(spark, d).join(z, "ticker"), ["mkvaltq"]).withColumns({c: money(c) for c in ("mkvaltq_mean", "mkvaltq_std")})


@query("""WITH e AS (SELECT o_custkey AS k, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS v FROM orders GROUP BY 1), u AS ((SELECT * FROM e ORDER BY v DESC, k LIMIT 10) UNION (SELECT * FROM e ORDER BY v, k LIMIT 10)) SELECT k, v FROM u""")
def extremes_top10(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("v"))
    return rankings.extremes(e, "v", 10, "k")


@query("""WITH e AS (SELECT e.event_id, e.user_id, e.ts, p.event_id AS matched_event, p.ts AS matched_time FROM (SELECT * FROM events WHERE event_type = 'error') e ASOF LEFT JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events WHERE event_type = 'purchase' GROUP BY user_id, ts) p ON e.user_id = p.user_id AND e.ts >= p.ts) SELECT * FROM e""")
def asof_backward(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    right = e.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("matched_event"))
    return panel.asof_backward(e.filter("event_type = 'error'").select("event_id", "user_id", "ts"), right, "user_id", "ts", "ts", ["matched_event"], "matched_event")


@query("SELECT o_custkey FROM orders WHERE year(o_orderdate) IN (1995, 1996, 1997) GROUP BY o_custkey HAVING count(DISTINCT year(o_orderdate)) = 3")
def full_coverage_entities(spark: SparkSession, d: str) -> DataFrame:
    return panel.covering(table(spark, d, "orders"), "o_custkey", F.year("o_orderdate"), [1995, 1996, 1997])


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def semi_join(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_semi").select("c_custkey", "c_name")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def anti_join(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, d, "customer").join(o, "c_custkey", "left_anti").select("c_custkey", "c_name")


@query(f"""WITH {_PANEL}, x AS (SELECT ticker, year, quarter, prccq AS price_wrds FROM panel WHERE quarter <> 4) SELECT p.ticker, p.year, p.quarter, {q('p.mkvaltq')} AS mkvaltq, {q('coalesce(x.price_wrds, 0)')} AS price_wrds FROM panel p LEFT JOIN x USING (ticker, year, quarter)""")
def three_key_join_fill(spark: SparkSession, d: str) -> DataFrame:
    p = _panel(spark, d)
    x = p.filter("quarter <> 4").select("ticker", "year", "quarter", F.col("prccq").alias("price_wrds"))
    return rounded(p.select("ticker", "year", "quarter", "mkvaltq").join(x, ["ticker", "year", "quarter"], "left").fillna({"price_wrds": 0.0}))


@query("SELECT p_partkey AS k, p_name AS name, p_retailprice AS price, NULL::DOUBLE AS balance FROM part UNION ALL SELECT s_suppkey, s_name, NULL, s_acctbal FROM supplier")
def union_missing_columns(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@query(f"""WITH {_PANEL} SELECT n.n_name || '_' || year || 'Q' || quarter AS doc_id, p.ticker, p.year, p.quarter, p.year * 4 + p.quarter AS quarter_index, make_date(p.year, (p.quarter - 1) * 3 + 2, 15) AS mid FROM panel p JOIN nation n ON n.n_name = p.ticker""")
def doc_id_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    key = _panel(spark, d).select(S.doc_key("ticker", "year", "quarter").alias("doc_id"))
    out = key.select("doc_id", S.key_ticker("doc_id").alias("ticker"), S.key_year("doc_id").alias("year"), S.key_quarter("doc_id").alias("quarter"))
    return out.withColumn("quarter_index", S.quarter_index("year", "quarter")).withColumn("mid", S.mid_quarter("year", "quarter"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k int")["k"].alias("k"))


@query("SELECT c_custkey, upper(trim(c_mktsegment)) AS segment, 'GICS_' || lpad(CAST(c_nationkey AS VARCHAR), 8, '0') AS code, coalesce(nullif(trim(c_mktsegment), ''), c_name) AS label, CAST(c_acctbal > 0 AS INTEGER) AS positive FROM customer")
def cleaning(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select("c_custkey", S.normal_key("c_mktsegment").alias("segment"), S.sector_code("c_nationkey").alias("code"), S.first_filled("c_mktsegment", "c_name").alias("label"), S.positive_flag("c_acctbal").alias("positive"))


@query("SELECT doc_id, metric, value FROM (SELECT doc_id, 'quality' AS metric, quality AS value FROM labels UNION ALL SELECT doc_id, 'toxic', toxic FROM labels)")
def melt_metrics(spark: SparkSession, d: str) -> DataFrame:
    return panel.unpivoted(table(spark, d, "labels").select("doc_id", "quality", "toxic"), ["doc_id"], ["quality", "toxic"])


@query("SELECT doc_id, " + ", ".join(f"CAST(lang = '{v}' AS INTEGER) AS lang_{v}" for v in ("en", "de", "fr", "es")) + " FROM documents")
def one_hot(spark: SparkSession, d: str) -> DataFrame:
    return panel.one_hot(table(spark, d, "documents"), "doc_id", "lang", ["en", "de", "fr", "es"])


@query("SELECT event_type, count(*) AS n, " + q("count(*)::DOUBLE / (SELECT count(*) FROM events)") + " AS share FROM events GROUP BY event_type")
def value_shares(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    kinds = sorted(r[0] for r in e.select("event_type").distinct().collect())  # a handful of types
    return rounded(rankings.value_counts(e, "event_type", kinds))


@query(f"""SELECT 'n_chars' AS metric, count(n_chars) AS n, {q('avg(n_chars)')} AS mean, {q('median(n_chars)')} AS median, {q('stddev_pop(n_chars) / 1')} AS std, {q('quantile_cont(n_chars, 0.9)')} AS p90, {q('quantile_cont(n_chars, 0.95)')} AS p95,
{q('avg(CAST(n_chars = 0 AS INTEGER))')} AS zero_share, {q('avg(CAST(n_chars <> 0 AS INTEGER))')} AS nonzero_share FROM documents""")
def ratio_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.ratio_summary(table(spark, d, "documents"), ["n_chars"]))


@query("SELECT count(*) FILTER (WHERE toxic = 0) AS n_zero, count(*) FILTER (WHERE toxic <> 0) AS n_nonzero FROM labels")
def zero_split(spark: SparkSession, d: str) -> DataFrame:
    return metrics.zero_split(table(spark, d, "labels"), "toxic")


@query("""WITH e AS (SELECT greatest(quantile_cont(n_chars::DOUBLE, 0.995), 0.01) AS edge FROM documents) SELECT CAST(CASE WHEN n_chars = 0 THEN 0 ELSE least(floor(n_chars / edge * 60) + 1, 61) END AS INTEGER) AS bin, count(*) AS n FROM documents, e GROUP BY 1""")
def histogram60(spark: SparkSession, d: str) -> DataFrame:
    return metrics.histogram(table(spark, d, "documents"), "n_chars")


@query(f"SELECT unnest(['doc_id', 'quality', 'toxic']) AS \"column\", unnest(['bigint', 'int', 'int']) AS dtype, unnest([avg(CAST(doc_id IS NOT NULL AS INTEGER)), avg(CAST(quality IS NOT NULL AS INTEGER)), avg(CAST(toxic IS NOT NULL AS INTEGER))]) AS non_missing_share FROM labels")
def data_dictionary(spark: SparkSession, d: str) -> DataFrame:
    return panel.data_dictionary(table(spark, d, "labels").select("doc_id", "quality", "toxic"))


# Evaluation --------------------------------------------------------------

_JUDGED = "j AS (SELECT l.doc_id, l.quality, l.toxic, d.n_chars, 1.0::DOUBLE * d.n_chars / 5000 AS score FROM labels l JOIN documents d USING (doc_id))"


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "labels").join(table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").withColumn("score", F.col("n_chars") / 5000.0)


@query(f"""WITH {_JUDGED}, c AS (SELECT count(*) FILTER (WHERE quality = 1 AND score >= 0.5) AS tp, count(*) FILTER (WHERE quality <> 1 AND score >= 0.5) AS fp, count(*) FILTER (WHERE quality = 1 AND score < 0.5) AS fn, count(*) FILTER (WHERE quality <> 1 AND score < 0.5) AS tn FROM j)
SELECT tp, fp, fn, tn, {q('(tp + tn)::DOUBLE / (tp + fp + fn + tn)')} AS accuracy, {q('coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0)')} AS "precision", {q('coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0)')} AS recall, {q('coalesce(2 * tp::DOUBLE / nullif(2 * tp + fp + fn, 0), 0)')} AS f1 FROM c""")
def confusion_metrics(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.classification_metrics(_judged(spark, d), "quality", "score"))


@query(f"""WITH {_JUDGED}, s AS (SELECT score, count(*) FILTER (WHERE quality = 1) AS p, count(*) FILTER (WHERE quality <> 1) AS n FROM j GROUP BY score), w AS (SELECT p, n, p * (coalesce(sum(n) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + n / 2.0) AS w FROM s)
SELECT {q('sum(w)::DOUBLE / (sum(p) * sum(n))')} AS auc FROM w""")
def roc_auc(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.roc_auc(_judged(spark, d), "quality", "score"))


@query(f"""WITH {_JUDGED}, s AS (SELECT score AS threshold, count(*) FILTER (WHERE quality = 1) AS p, count(*) FILTER (WHERE quality <> 1) AS n FROM j GROUP BY score)
SELECT {q('threshold')} AS threshold, {q('sum(p) OVER (ORDER BY threshold DESC)::DOUBLE / sum(p) OVER ()')} AS tpr, {q('sum(n) OVER (ORDER BY threshold DESC)::DOUBLE / sum(n) OVER ()')} AS fpr FROM s""")
def roc_curve(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.roc_curve(_judged(spark, d), "quality", "score"))


@query(f"""WITH c AS (SELECT quality AS a, toxic AS b, count(*) AS n FROM labels GROUP BY 1, 2), t AS (SELECT sum(n) AS n, sum(CASE WHEN a = b THEN n ELSE 0 END) AS same FROM c), r AS (SELECT a AS l, sum(n) AS ra FROM c GROUP BY 1), k AS (SELECT b AS l, sum(n) AS rb FROM c GROUP BY 1),
x AS (SELECT sum(ra * rb) AS bt FROM r JOIN k USING (l)), y AS (SELECT n, same::DOUBLE / n AS po, bt::DOUBLE / (n * n) AS pe FROM t, x) SELECT CAST(n AS BIGINT) AS n, {q('po')} AS agreement, {q('(po - pe) / (1 - pe)')} AS kappa FROM y""")
def kappa(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.agreement(table(spark, d, "labels"), "quality", "toxic"))


@query(f"""WITH l AS (SELECT unnest(['0', '1']) AS label), r AS (SELECT CAST(quality AS VARCHAR) AS t, CAST(toxic AS VARCHAR) AS g FROM labels), s AS (SELECT label, count(*) FILTER (WHERE t = label AND g = label) AS tp, count(*) FILTER (WHERE t = label) AS support, count(*) FILTER (WHERE g = label) AS predicted FROM l, r GROUP BY label)
SELECT label, {q('coalesce(tp::DOUBLE / nullif(predicted, 0), 0)')} AS "precision", {q('coalesce(tp::DOUBLE / nullif(support, 0), 0)')} AS recall, {q('coalesce(2 * tp::DOUBLE / nullif(predicted + support, 0), 0)')} AS f1, support FROM s""")
def per_class_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(stats.per_class(table(spark, d, "labels"), "quality", "toxic", ["0", "1"]))


@query(f"""WITH {_PANEL}, e AS (SELECT mkvaltq AS y, mkvaltq - prccq AS e FROM panel) SELECT {qm('avg(abs(e))')} AS mae, round(avg(e * e), -4) AS mse, {qm('sqrt(avg(e * e))')} AS rmse, {q('1 - avg(e * e) / var_pop(y)')} AS r2 FROM e""")
def regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = stats.regression_metrics(_panel(spark, d), "mkvaltq", "prccq")
    return m.select(money("mae").alias("mae"), F.round("mse", -4).alias("mse"), money("rmse").alias("rmse"), S.quantised("r2").alias("r2"))


@query(f"WITH {_PANEL} SELECT {q('regr_slope(mkvaltq, xrdq)')} AS slope, {qm('regr_intercept(mkvaltq, xrdq)')} AS intercept FROM panel")
def trend_line(spark: SparkSession, d: str) -> DataFrame:
    t = stats.trend_line(_panel(spark, d), "mkvaltq", "xrdq")
    return t.select(S.quantised("slope").alias("slope"), money("intercept").alias("intercept"))


@query(f"""WITH {_FEATURES} SELECT unnest(['market value', 'lagged value', 'growth']) AS step, unnest([count(*) FILTER (WHERE mkvaltq > 0), count(*) FILTER (WHERE mkvaltq > 0 AND pg IS NOT NULL), count(*) FILTER (WHERE mkvaltq > 0 AND pg IS NOT NULL AND coalesce(ym > 0, false))]) AS kept,
unnest([count(*) - count(*) FILTER (WHERE mkvaltq > 0), count(*) - count(*) FILTER (WHERE mkvaltq > 0 AND pg IS NOT NULL), count(*) - count(*) FILTER (WHERE mkvaltq > 0 AND pg IS NOT NULL AND coalesce(ym > 0, false))]) AS removed FROM f""")
def sample_attrition(spark: SparkSession, d: str) -> DataFrame:
    f = panel.panel_features(_panel(spark, d))
    return stats.attrition(f, {"market value": F.col("mkvaltq") > 0, "lagged value": F.col("price_growth_yoy").isNotNull(), "growth": F.col("y_next_mktcap_growth") > 0})


#: Normal equations of centred regressors; 2 (1 - Phi(|z|)) by the series of erf, 0 from |z| = 5.6 on.
_OLS = f"""WITH {_FEATURES}, d AS (SELECT rd AS x1, lm AS x2, ym AS y FROM f WHERE rd IS NOT NULL AND lm IS NOT NULL AND ym IS NOT NULL), u AS (SELECT count(*) AS n, avg(x1) AS u1, avg(x2) AS u2, avg(y) AS uy FROM d),
c AS (SELECT x1 - u1 AS x1, x2 - u2 AS x2, y - uy AS y, n, u1, u2, uy FROM d, u), s AS (SELECT sum(x1 * x1) AS a, sum(x1 * x2) AS b, sum(x2 * x2) AS c, sum(x1 * y) AS e, sum(x2 * y) AS g FROM c),
i AS (SELECT c / (a * c - b * b) AS p, -b / (a * c - b * b) AS q, a / (a * c - b * b) AS r, e, g FROM s), k AS (SELECT *, p * e + q * g AS b1, q * e + r * g AS b2 FROM i),
w AS (SELECT n, u1, u2, uy, b1, b2, y - b1 * x1 - b2 * x2 AS res, p * x1 + q * x2 AS h1, q * x1 + r * x2 AS h2 FROM c, k),
v AS (SELECT any_value(n) AS n, any_value(b1) AS b1, any_value(b2) AS b2, any_value(uy - b1 * u1 - b2 * u2) AS b0, sum(res * res * h1 * h1) AS v1, sum(res * res * h2 * h2) AS v2, sum(res * res * (1.0 / n - u1 * h1 - u2 * h2) * (1.0 / n - u1 * h1 - u2 * h2)) AS v0 FROM w),
l AS (SELECT unnest(['Intercept', 'rd_intensity', 'log_mktcap']) AS term, unnest([b0, b1, b2]) AS coef, unnest([sqrt(v0 * n / (n - 3)), sqrt(v1 * n / (n - 3)), sqrt(v2 * n / (n - 3))]) AS std_err, n FROM v), z AS (SELECT *, coef / std_err AS z, abs(coef / std_err) / sqrt(2.0) AS x FROM l)
SELECT term, {q('coef')} AS coef, {q('std_err')} AS std_err, {q('z')} AS z, {q("CASE WHEN x > 4 THEN 0 ELSE 1 - 2 / sqrt(pi()) * list_sum(list_transform(range(0, 90), lambda j: (CASE WHEN j % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * j + 1) * ln(x) - lgamma(j + 1)) / (2 * j + 1))) END")} AS p, n FROM z"""


@query(_OLS)
def ols_robust(spark: SparkSession, d: str) -> DataFrame:
    rows = stats.ols_hc1(panel.panel_features(_panel(spark, d)), ["rd_intensity", "log_mktcap"], "y_next_mktcap_growth")
    return rounded(spark.createDataFrame(rows))


@query("SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS dominant FROM embeddings")
def dominant_component(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", S.dominant("embedding").alias("dominant"))
