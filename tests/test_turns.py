import json
import random

from pyspark.sql import functions as F

from turnlake.functions import roles as R
from turnlake.operators import turns
from turnlake.sources.tables import decode_turns

LONG = "revenue rose in every region and " * 50


def _start(spark, rows):
    return turns.question_start(spark.createDataFrame([("d", i, s, t) for i, (s, t) in enumerate(rows)], "doc_id string, pos int, speaker string, text string")).first()


def test_single_turn_roles(spark):
    wanted = {"Operator": "operator", "Jane Roe - CEO": "management", "John Doe, Goldman Sachs": "analyst", "Unidentified Analyst": "analyst", "Tim Cook": "unknown", "Chief Analyst Officer": "analyst", "Spector": "unknown"}
    df = spark.createDataFrame([(k,) for k in wanted], "s string").select("s", R.role_of("s").alias("r"))
    assert {r.s: r.r for r in df.collect()} == wanted


def test_questions(spark):
    wanted = {"How is demand?": True, "Can you comment on margins": True, "what about costs": True, "Thank you all.": False, "x" * 600 + "?": False}
    df = spark.createDataFrame([(k,) for k in wanted], "s string").select("s", R.is_question("s").alias("r"))
    assert {r.s: r.r for r in df.collect()} == wanted


def test_boundary_passes(spark):
    ceo, op = "Jane Roe CEO", "Operator"
    assert _start(spark, [(op, "We will take our first question from Bob."), (ceo, "hi")]).qa_start == 0  # 0: no speech before
    assert _start(spark, [(op, "Welcome to the earnings call."), (ceo, LONG), (ceo, LONG), (op, "Our first question comes from Bob.")]).qa_start == 3  # 1
    assert _start(spark, [(ceo, LONG), (ceo, LONG), (ceo, LONG), (op, "now the q&a session")]).qa_start == 3  # 2: weak
    assert _start(spark, [(ceo, LONG), (ceo, "let's move to questions"), ("Bob, UBS", "hello")]).qa_start == 1  # 3
    assert _start(spark, [("Ann", LONG), (op, "here is the first question"), ("Bob, UBS", "so")]).qa_start == 1  # 4
    assert _start(spark, [(ceo, LONG), (ceo, LONG), ("Bob, UBS", "why is that?")]).qa_start == 1  # 5
    assert _start(spark, [(ceo, LONG), (ceo, LONG)]).qa_start == 2  # none


def _infer(first, names, asks, known, announced):
    """Roles of a session, turn by turn."""
    out, cache, expected = [], {}, set()
    for role, name, told in zip(first, names, announced, strict=True):
        if role == "operator":
            if told:
                expected.add(told)
                cache[told] = "analyst"
            out.append("operator")
            continue
        found = "management" if name in known else role if role in ("analyst", "management") else "analyst" if name in expected else None
        if found:
            cache[name] = found
        out.append(found or cache.get(name))
    after, before = {"operator": "analyst", "analyst": "management"}, None
    for i, role in enumerate(out):
        if role is None:
            role = cache.get(names[i]) or after.get(before) or ("analyst" if asks[i] else "management" if before == "management" else None)
            if role:
                cache[names[i]] = role
            out[i] = role
        before = role or before
    return [role or cache.get(name) or ("analyst" if ask else "management") for role, name, ask in zip(out, names, asks, strict=True)]


def _roles(spark, sessions):
    df = spark.createDataFrame(list(enumerate(sessions)), "i int, s struct<f:array<string>,n:array<string>,a:array<boolean>,k:array<string>,t:array<string>>").select("i", "s.*")
    out = df.select("i", F.expr(turns.roles_sql("f", "n", "a", "k", "t")).alias("r"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    return [r.r for r in out.orderBy("i").collect()]


def test_session_roles(spark):
    none = [None]
    sessions = [
        (["operator", "unknown", "unknown"], ["operator", "bob lee", "ann"], [False] * 3, [], ["bob lee", None, None]), (["unknown"], ["jane"], [True], ["jane"], none),
        (["unknown", "unknown"], ["x", "y"], [False, True], [], none * 2), (["operator"], ["operator"], [False], [], none), ([], [], [], [], []),
        # What is learnt of a speaker holds for the rest of the session.
        (["operator", "unknown", "unknown", "unknown"], ["operator", "bob", "ann", "bob"], [False] * 4, [], [None] * 4),
    ]
    assert _roles(spark, sessions) == [["operator", "analyst", "management"], ["management"], ["management", "analyst"], ["operator"], [], ["operator", "analyst", "management", "analyst"]]


def test_session_roles_of_many_sessions(spark):
    rng = random.Random(5)
    sessions = []
    for _ in range(20_000):
        n, people = rng.randrange(0, 9), ["a", "b", "c", "d", ""][: rng.randrange(1, 6)]
        first = [rng.choice(["operator", "analyst", "management", "unknown", "unknown", "unknown"]) for _ in range(n)]
        told = [rng.choice([*people, None, None]) if r == "operator" else None for r in first]
        sessions.append((first, [rng.choice(people) for _ in range(n)], [rng.random() < 0.4 for _ in range(n)], rng.sample(people, rng.randrange(0, 2)), told))
    assert _roles(spark, sessions) == [_infer(*s) for s in sessions]


def test_rows_that_share_an_id_keep_their_own_roles(spark):
    kind = "doc_id string, speech_turns array<struct<speaker:string,text:string>>, qa_turns array<struct<speaker:string,text:string>>"
    rows = [("a", [("Jane", "x")], [("Jane", "why?"), ("Bob", "so")]), ("a", [], [("Jane", "why?"), ("Bob", "so")]), (None, None, None)]
    out = turns.session_roles(spark.createDataFrame(rows, kind))
    assert sorted((len(r.speech_turns or []), r.roles) for r in out.collect() if r.doc_id) == [(0, ["analyst", "management"]), (1, ["management", "management"])] and out.count() == 3


def test_broken_cells_are_named(spark):
    good = json.dumps([{"speaker": "Jane CEO", "text": "Hello."}, {"speaker": "Bob", "text": None, "more": 1}])
    cells = {
        "good": good, "broken": good[:-2], "object": '{"speaker": "A"}', "number": "[1]", "missing": '[{"speaker": "A", "text": "x"}, {"text": "y"}]', "no text": '[{"speaker": "A"}]',
        "typed": '[{"speaker": 5, "text": "x"}]', "listed": '[{"speaker": "A", "text": ["x"]}]', "empty": "[]", "blank": " ",
    }
    df = spark.createDataFrame(list(cells.items()), "doc_id string, structured_content string")
    parsed, errors = turns.parse_batch(df, strict=True)
    assert {r.doc_id for r in parsed.collect()} == {"good", "empty"}
    assert {r.doc_id: r.error for r in errors.collect()} == {
        "broken": "not JSON", "object": "not a list but object<speaker: string>", "number": "turn 0 is bigint", "missing": "turn 1: no speaker", "no text": "turn 0: no text",
        "typed": "turn 0: speaker is bigint", "listed": "turn 0: text is array<string>", "blank": "no content",
    }
    lenient, errors = turns.parse_batch(df)
    assert lenient.count() == 9 and [tuple(r) for r in errors.collect()] == [("blank", "no content")]
    same = lambda frame: frame.filter("doc_id = 'good'").first().asDict(True)
    assert same(lenient) == same(parsed)


def test_parse_calls(spark):
    content = [("Operator", "Welcome to the conference call."), ("Jane Roe CEO", LONG), ("Tom CFO", LONG), ("Operator", "Our first question comes from Bob Lee with UBS. Please go ahead."), ("Bob Lee", "How is demand?"), ("Jane Roe CEO", "Strong."), ("Bob Lee", "Thanks."), ("Tom CFO", "Sure.")]
    calls = spark.createDataFrame([("a", json.dumps([{"speaker": s, "text": t} for s, t in content])), ("b", "[]"), ("c", "no json"), ("d", None)], "doc_id string, structured_content string")
    out = {r.doc_id: r for r in turns.parse_calls(calls.select("doc_id", decode_turns().alias("turns"))).collect()}
    a = out["a"]
    assert len(a.speech_turns) == 3 and [t.role for t in a.qa_turns] == ["operator", "analyst", "management", "analyst", "management"]
    assert a.num_qa_exchanges == 1 and a.qa_turns[1].is_question
    assert out["b"].speech_word_count == 0 and out["b"].qa_turns == [] and out["d"].speech_text == ""
    assert out["c"].speech_turns[0].speaker == "Unknown"


def _fold(roles):
    """Exchanges by a plain scan: (first turns of question, of answer)."""
    segments = []
    for i, r in enumerate(roles):
        if segments and segments[-1][0] == r:
            segments[-1][1].append(i)
        else:
            segments.append((r, [i]))
    spoken = [s for s in segments if s[0] != "operator"]
    return [(" ".join(map(str, a[1])), " ".join(map(str, b[1]))) for a, b in zip(spoken, spoken[1:], strict=False) if a[0] == "analyst" and b[0] == "management"]


def test_exchanges_equal_a_plain_fold(spark):
    rng = random.Random(1)
    docs = {d: [rng.choice(["analyst", "management", "operator", "unknown"]) for _ in range(rng.randint(0, 12))] for d in range(200)}
    df = spark.createDataFrame([(d, i, r, str(i)) for d, rs in docs.items() for i, r in enumerate(rs)], "doc_id int, turn_idx int, role string, text string")
    found = {}
    for r in turns.exchanges(df).orderBy("doc_id", "exchange_idx").collect():
        found.setdefault(r.doc_id, []).append((r.question_text, r.answer_text))
    side = {"unknown": "management"}
    assert found == {d: w for d, rs in docs.items() if (w := _fold([side.get(r, r) for r in rs]))}


def test_initiation_scores(spark):
    typed = spark.createDataFrame([("a", t) for t in ["analyst_initiated", "management_pivot", "management_pivot", "non_ai"]] + [("b", "non_ai")], "doc_id string, initiation_type string")
    out = {r.doc_id: r for r in turns.initiation_scores(typed).collect()}
    assert abs(out["a"].ai_initiation_score - 2 / 3) < 1e-12 and out["a"].total_ai_exchanges == 3
    assert out["b"].ai_initiation_score == 0.5 and out["b"].analyst_initiated_ratio == 0.0
    flags = spark.createDataFrame([(True, True), (False, True), (True, False), (False, False)], "q boolean, a boolean")
    assert [r[0] for r in flags.select(turns.initiation_type(F.col("q"), F.col("a"))).collect()] == ["analyst_initiated", "management_pivot", "analyst_only", "non_ai"]
