"""Turns of a conversation: where questions begin, who speaks, who asks whom.

All windows are partitioned by document, so a plan shuffles turns once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.functions import roles as R
from turnlake.functions.scalars import guarded_ratio, word_count
from turnlake.sources.tables import decode_turns

#: Words, and turns of prepared remarks, that a session needs before it opens.
SPEECH_WORDS, STRONG_TURNS, WEAK_TURNS = 200, 2, 3


def explode_turns(calls: DataFrame, turns: str = "turns", key: str = "doc_id") -> DataFrame:
    """(key, pos, speaker, text), pos from 0."""
    return calls.select(key, F.posexplode(turns).alias("pos", "t")).select(key, "pos", "t.speaker", "t.text")


def prefix_counts(turns: DataFrame, key: str = "doc_id") -> DataFrame:
    """Running facts before each turn: words and turns of those who present."""
    before = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    marked = turns.withColumn("is_op", R.is_operator("speaker")).withColumn("role0", R.role_of("speaker"))
    talks = ~F.col("is_op") & F.col("role0").isin("management", "unknown")
    marked = marked.withColumn("talks", talks)
    words = F.sum(F.when(F.col("talks"), word_count("text")).otherwise(0)).over(before)
    spoken = F.sum(F.col("talks").cast("int")).over(before)
    others = F.sum((~F.col("is_op")).cast("int")).over(before)
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return marked.withColumn("words_before", zero(words)).withColumn("talks_before", zero(spoken)).withColumn("others_before", zero(others))


def question_start(turns: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, n_turns, qa_start): first turn of the question session, n_turns if
    there is none.  Six rules in order, each the first turn that satisfies a
    predicate over what came before it."""
    t = prefix_counts(turns, key)
    strong, weak = R.matches("text", R.STRONG_OPENING), R.matches("text", R.WEAK_OPENING)
    op = F.col("is_op")
    rules = [
        op & ~R.holds("text", R.WELCOME) & strong & (F.col("words_before") < SPEECH_WORDS),
        op & strong & (F.col("talks_before") >= STRONG_TURNS),
        op & weak & (F.col("talks_before") >= WEAK_TURNS),
        ~op & (F.col("talks_before") + F.col("talks").cast("int") >= STRONG_TURNS) & R.holds("text", R.TRANSITION),
        op & (F.col("others_before") > 0) & F.contains(F.lower("text"), F.lit("first question")),
    ]
    asked = F.contains(F.left(F.trim(F.coalesce("text", F.lit(""))), F.lit(300)), F.lit("?")) & (F.col("role0") == "analyst")
    found = [F.min(F.when(r, F.col("pos"))) for r in rules] + [F.greatest(F.min(F.when(asked, F.col("pos"))) - 1, F.lit(0))]
    # greatest() skips nulls, so the last rule must stay null where nobody asks.
    found[-1] = F.when(F.max(asked.cast("int")) == 1, found[-1])
    return t.groupBy(key).agg(F.count("*").alias("n_turns"), F.coalesce(*found, F.count("*")).cast("long").alias("qa_start"))


_ROLES = "array<struct<speaker:string,role:string,text:string,is_question:boolean>>"


def _known(cache: str, name: str) -> str:
    """SQL: what is noted last of a name in array<struct<name, role>>."""
    return f"try_element_at(filter({cache}, c -> c.name = {name}), -1).role"


def _noted(cache: str, name: str, role: str) -> str:
    """SQL: a note added if it is new, so that notes are as many as names."""
    return f"CASE WHEN {role} <=> {_known(cache, name)} THEN {cache} ELSE array_append({cache}, named_struct('name', {name}, 'role', {role})) END"


def roles_sql(first: str, names: str, asks: str, known: str, announced: str) -> str:
    """SQL of the roles of one question session, from arrays with an entry for
    each turn: the role of the label alone, the speaker, whether the turn asks,
    and whom an operator announces; ``known``: who spoke before the session.

    What is learnt of a speaker holds for all of their turns, so this is a
    recurrence: a fold over the turns notes what labels and announcements tell,
    a second one fills the gaps from who spoke before.  Time grows with the
    square of the turns of one call, by a copy of short arrays a turn.
    """
    none, notes = "cast(array() AS array<string>)", "cast(array() AS array<struct<name: string, role: string>>)"
    let = lambda value, name, body: f"transform(array({value}), {name} -> {body})[0]"
    turn = f"transform({names}, (n, i) -> named_struct('f', {first}[i], 'n', n, 't', {announced}[i], 'a', {asks}[i]))"
    told = "x.t IS NOT NULL AND x.t <> ''"
    operator = f"named_struct('notes', CASE WHEN {told} THEN {_noted('s.notes', 'x.t', chr(39) + 'analyst' + chr(39))} ELSE s.notes END, 'expected', CASE WHEN {told} THEN array_append(s.expected, x.t) ELSE s.expected END, 'out', array_append(s.out, 'operator'))"
    found = f"CASE WHEN array_contains({known}, x.n) THEN 'management' WHEN x.f IN ('analyst', 'management') THEN x.f WHEN array_contains(s.expected, x.n) THEN 'analyst' END"
    speaker = let(found, "g", f"named_struct('notes', CASE WHEN g IS NULL THEN s.notes ELSE {_noted('s.notes', 'x.n', 'g')} END, 'expected', s.expected, 'out', array_append(s.out, coalesce(g, {_known('s.notes', 'x.n')})))")
    start = f"named_struct('notes', {notes}, 'expected', {none}, 'out', {none})"
    told_first = f"aggregate(z, {start}, (s, x) -> CASE WHEN x.f = 'operator' THEN {operator} ELSE {speaker} END)"

    follows = "CASE s.before WHEN 'operator' THEN 'analyst' WHEN 'analyst' THEN 'management' END"
    guess = f"coalesce({_known('s.notes', 'x.n')}, {follows}, CASE WHEN x.a THEN 'analyst' WHEN s.before = 'management' THEN 'management' END)"
    settled = "named_struct('notes', s.notes, 'before', x.o, 'out', array_append(s.out, x.o))"
    filled = let(guess, "g", f"named_struct('notes', CASE WHEN g IS NULL THEN s.notes ELSE {_noted('s.notes', 'x.n', 'g')} END, 'before', coalesce(g, s.before), 'out', array_append(s.out, g))")
    second = f"aggregate(transform(z, (x, i) -> named_struct('n', x.n, 'a', x.a, 'o', p.out[i])), named_struct('notes', p.notes, 'before', cast(NULL AS string), 'out', {none}), (s, x) -> CASE WHEN x.o IS NULL THEN {filled} ELSE {settled} END)"
    last = let(second, "q", f"transform(z, (x, i) -> coalesce(q.out[i], {_known('q.notes', 'x.n')}, CASE WHEN x.a THEN 'analyst' ELSE 'management' END))")
    return let(turn, "z", let(told_first, "p", last))


def session_roles(calls: DataFrame) -> DataFrame:
    """Add ``roles`` (one per question turn) to (speech_turns, qa_turns), in the
    row: calls aren't moved, and rows that share an id stay apart."""
    name = lambda s: F.lower(F.regexp_replace(F.trim(F.coalesce(s, F.lit(""))), r"\s+", " "))
    spoke = F.filter("speech_turns", lambda t: ~R.is_operator(t["speaker"]))
    facts = {
        "_first": F.transform("qa_turns", lambda t: R.role_of(t["speaker"])), "_names": F.transform("qa_turns", lambda t: name(t["speaker"])), "_asks": F.transform("qa_turns", lambda t: R.is_question(t["text"])),
        "_known": F.array_distinct(F.transform(spoke, lambda t: name(t["speaker"]))), "_announced": F.transform("qa_turns", lambda t: F.when(R.is_operator(t["speaker"]), R.introduced_analyst(t["text"]))),
    }
    return calls.withColumns(facts).withColumn("roles", F.expr(roles_sql(*facts))).drop(*facts)


def parse_calls(calls: DataFrame) -> DataFrame:
    """(doc_id, turns array<struct<speaker,text>>) to sections with roles.

    A call without turns has empty sections and no words.
    """
    starts = question_start(explode_turns(calls)).select("doc_id", "qa_start")
    cut = calls.join(starts, "doc_id", "left").withColumn("qa_start", F.coalesce("qa_start", F.lit(0)).cast("int"))
    cut = cut.withColumn("speech_turns", F.slice("turns", F.lit(1), F.col("qa_start"))).withColumn("qa_turns", F.slice("turns", F.col("qa_start") + 1, F.greatest(F.size("turns") - F.col("qa_start"), F.lit(0))))
    cut = session_roles(cut)
    turn = lambda t, role: F.struct(t["speaker"].alias("speaker"), role.alias("role"), t["text"].alias("text"), R.is_question(t["text"]).alias("is_question"))
    joined = lambda c: F.array_join(F.transform(c, lambda t: F.coalesce(t["text"], F.lit(""))), "\n\n")
    out = cut.withColumn("speech_text", joined("speech_turns")).withColumn("qa_text", joined("qa_turns"))
    out = out.withColumn("speech_turns", F.transform("speech_turns", lambda t: turn(t, R.role_of(t["speaker"])))).withColumn("qa_turns", F.transform(F.arrays_zip("qa_turns", "roles"), lambda z: turn(z["qa_turns"], z["roles"])))
    asked = F.size(F.filter("qa_turns", lambda t: (t["role"] == "analyst") & t["is_question"]))
    return out.drop("roles").withColumn("speech_word_count", word_count("speech_text")).withColumn("qa_word_count", word_count("qa_text")).withColumn("num_qa_exchanges", asked)


def broken_turns(cell: str) -> Column:
    """Why a JSON cell isn't a list of turns with a speaker and a text, or null:
    the first thing that is wrong, with its turn."""
    turns = f"cast(try_parse_json(`{cell}`) AS array<variant>)"
    kind = f"schema_of_variant(try_parse_json(`{cell}`))"
    field = lambda c: f"CASE WHEN try_variant_get(x, '$.{c}', 'variant') IS NULL THEN concat('turn ', i, ': no {c}') WHEN schema_of_variant(try_variant_get(x, '$.{c}', 'variant')) NOT IN ('STRING', 'VOID') THEN concat('turn ', i, ': {c} is ', lower(schema_of_variant(try_variant_get(x, '$.{c}', 'variant')))) END"
    turn = f"CASE WHEN schema_of_variant(x) NOT LIKE 'OBJECT%' THEN concat('turn ', i, ' is ', lower(schema_of_variant(x))) ELSE coalesce({field('speaker')}, {field('text')}) END"
    first = f"filter(transform({turns}, (x, i) -> {turn}), r -> r IS NOT NULL)"
    return F.expr(f"CASE WHEN try_parse_json(`{cell}`) IS NULL THEN 'not JSON' WHEN {kind} NOT LIKE 'ARRAY%' THEN concat('not a list but ', lower({kind})) ELSE try_element_at({first}, 1) END")


def parse_batch(calls: DataFrame, cell: str = "structured_content", strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(parsed calls, (doc_id, error) of rows that can't be parsed).

    A row without an id, without content, or whose id is there more than once is
    an error of its own; all others are parsed.  A cell that isn't a list of turns
    is read as one turn of an unknown speaker; if ``strict`` it is an error, with
    what is wrong and where, and its row isn't parsed.
    """
    reason = F.when(F.col("doc_id").isNull(), "no id").when(F.col(cell).isNull() | (F.trim(F.col(cell)) == ""), "no content").when(F.col("_n") > 1, "repeated id")
    if strict:
        reason = reason.otherwise(broken_turns(cell))
    marked = calls.withColumn("_n", F.count("*").over(Window.partitionBy("doc_id"))).withColumn("error", reason).drop("_n")
    good = marked.filter("error IS NULL").drop("error").withColumn("turns", decode_turns(cell)).drop(cell)
    return parse_calls(good), marked.filter("error IS NOT NULL").select("doc_id", "error")


def turns_of_sentences(sentences: DataFrame) -> DataFrame:
    """Question-session sentences to turns: ordered text, first speaker."""
    return sentences.filter(F.col("section") == "qa").groupBy("doc_id", "turn_idx").agg(
        F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY sentence_idx)").alias("text"), F.min_by("role", "sentence_idx").alias("role"),
        F.min_by("speaker", "sentence_idx").alias("speaker"), F.count("*").alias("n_sentences"),
    )


def role_runs(turns: DataFrame) -> DataFrame:
    """(doc_id, run, role, text, n_turns, first_turn): consecutive turns of one
    side are one run; whoever is neither analyst nor operator is management."""
    side = F.when(F.col("role").isin("analyst", "operator"), F.col("role")).otherwise("management")
    order = Window.partitionBy("doc_id").orderBy("turn_idx")
    marked = turns.withColumn("side", side).withColumn("new", (F.coalesce(F.lag("side").over(order), F.lit("")) != F.col("side")).cast("int"))
    numbered = marked.withColumn("run", F.sum("new").over(order))
    return numbered.groupBy("doc_id", "run").agg(
        F.min("side").alias("role"), F.expr("listagg(text, ' ') WITHIN GROUP (ORDER BY turn_idx)").alias("text"), F.count("*").alias("n_turns"), F.min("turn_idx").alias("first_turn"),
    )


def exchanges(turns: DataFrame) -> DataFrame:
    """(doc_id, exchange_idx, question_text, answer_text): an analyst run and
    the run after it, operators left out, if that is management's."""
    order = Window.partitionBy("doc_id").orderBy("run")
    spoken = role_runs(turns).filter(F.col("role") != "operator")
    paired = spoken.withColumn("next_role", F.lead("role").over(order)).withColumn("answer_text", F.lead("text").over(order))
    kept = paired.filter((F.col("role") == "analyst") & (F.col("next_role") == "management"))
    return kept.select("doc_id", (F.row_number().over(order) - 1).alias("exchange_idx"), F.col("text").alias("question_text"), "answer_text")


def initiation_type(question: Column, answer: Column) -> Column:
    """Who brought the topic up."""
    return F.when(question & answer, "analyst_initiated").when(~question & answer, "management_pivot").when(question & ~answer, "analyst_only").otherwise("non_ai")


def initiation_scores(typed: DataFrame) -> DataFrame:
    """Counts by type, their shares among topical exchanges, and the score:
    pivots among pivots and answers to analysts, 0.5 where there is neither."""
    count = lambda t: F.count_if(F.col("initiation_type") == t)
    out = typed.groupBy("doc_id").agg(
        F.count("*").alias("total_exchanges"), F.count_if(F.col("initiation_type") != "non_ai").alias("total_ai_exchanges"), count("analyst_initiated").alias("analyst_initiated_count"),
        count("management_pivot").alias("management_pivot_count"), count("analyst_only").alias("analyst_only_count"), count("non_ai").alias("non_ai_count"),
    )
    both = F.col("management_pivot_count") + F.col("analyst_initiated_count")
    return out.withColumn("analyst_initiated_ratio", guarded_ratio("analyst_initiated_count", "total_ai_exchanges")).withColumn("management_pivot_ratio", guarded_ratio("management_pivot_count", "total_ai_exchanges")).withColumn(
        "ai_initiation_score", F.coalesce(F.try_divide(F.col("management_pivot_count").cast("double"), both.cast("double")), F.lit(0.5))
    )
