import glob
import json
import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from turnlake.operators.keywords import CATEGORIES, Lexicon
from turnlake.plans import catalogue as plans
from turnlake.plans.report import report
from turnlake.plans.stages import Pipeline, check_calls, check_dataset, research_dataset
from turnlake.sources import tables
from turnlake.streaming.intensity import windowed_intensity

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(v):
    return round(v, 6) + 0.0 if isinstance(v, float) and not math.isnan(v) else v if v is None or isinstance(v, (int, float)) else str(v)


def _same(spark, duck, name, data=DATA):
    df = plans.QUERIES[name](spark, data)
    columns = sorted(df.columns)
    ours = sorted((tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in columns]).collect()), key=repr)
    found = duck.execute(plans.ORACLE[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert ours == sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()), key=repr)


@pytest.mark.parametrize("name", sorted(plans.ORACLE))
def test_query_equals_sql(spark, duck, name):
    _same(spark, duck, name)


def _calls(spark):
    speech = "Our artificial intelligence products grew strongly this quarter. " * 40
    turns = [("Operator", "Welcome to the conference call."), ("Jane CEO", speech), ("Tom CFO", speech), ("Operator", "Our first question comes from Bob Lee with UBS. Please go ahead."), ("Bob Lee", "How do you use machine learning today?"), ("Jane CEO", "We use machine learning in all of our products now."), ("Bob Lee", "What is the outlook for margins?"), ("Tom CFO", "Our artificial intelligence work helps margins a lot.")]
    cell = json.dumps([{"speaker": s, "text": t} for s, t in turns])
    return spark.createDataFrame([("AAA", 2024, 1, cell), ("BBB", 2024, 1, "[]")], "ticker string, year int, quarter int, structured_content string")


def test_pipeline_end_to_end(spark, tmp_path):
    run = Pipeline(spark, str(tmp_path))
    out = run.run(_calls(spark))
    run.manifest()
    score = out["initiation_scores"].first()
    assert (score.doc_id, score.total_exchanges, score.analyst_initiated_count, score.management_pivot_count) == ("AAA_2024Q1", 2, 1, 1)
    money = spark.createDataFrame([("AAA", 2024, 1, 10.0, 1.0, 2.0, 1.0), ("AAA", 2024, 2, 20.0, 1.0, 2.0, 1.0)], "ticker string, year int, quarter int, mkvaltq double, xrdq double, prccq double, epspxq double")
    data = {r.ticker: r for r in research_dataset(out, money).collect()}
    assert data["AAA"].y_next_mktcap_growth == 1.0 and data["BBB"].ai_initiation_score == 0.5 and data["BBB"].total_exchanges == 0
    assert check_dataset(research_dataset(out, money))["ok"]
    again = Pipeline(spark, str(tmp_path)).run(_calls(spark), start=7)
    assert again["exchanges"].count() == 2
    assert "| AAA_2024Q1 |" in report("Run", {"Scores": out["initiation_scores"], "Note": "text"})


def test_stages_know_what_they_are_made_from(spark, tmp_path):
    calls = _calls(spark)
    first = Pipeline(spark, str(tmp_path))
    first.run(calls)
    assert len(first.made) == 7
    same = Pipeline(spark, f"file://{tmp_path}")  # a path of the store, rows in another order
    same.run(calls.orderBy(F.desc("ticker")).repartition(3))
    assert same.made == []
    fewer = Lexicon(categories={c: w for c, w in CATEGORIES.items() if c != "automation"})
    other = Pipeline(spark, str(tmp_path), lexicon=fewer)
    other.run(calls)
    assert other.made == ["sentences_with_keywords", "section_metrics", "document_metrics", "exchanges", "initiation_scores"]
    changed = Pipeline(spark, str(tmp_path), lexicon=fewer)
    changed.run(calls.withColumn("structured_content", F.regexp_replace("structured_content", "margins", "costs")))
    assert len(changed.made) == 7
    changed.manifest()
    assert tables.read_json(f"{tmp_path}/manifest.json")["made"] == changed.made and tables.read_json(f"{tmp_path}/none.json") is None
    (tmp_path / "cut").mkdir()
    (tmp_path / "cut" / "x.json").write_text("{")
    assert tables.read_json(f"{tmp_path}/cut/x.json") is None


def test_digests_of_rows(spark):
    df = spark.createDataFrame([(1, "a", None), (2, None, 1.0), (2, None, 1.0)], "i int, s string, d double")
    one = tables.content_digest(df)
    assert one == tables.content_digest(df.repartition(3)) and len({one, *(tables.content_digest(x) for x in (df.distinct(), df.withColumn("s", F.lit("b")), df.select("s", "i", "d"), df.limit(0), df.unionByName(df.filter("i = 2"))))}) == 6


def test_checks(spark):
    calls = _calls(spark)
    with pytest.raises(ValueError, match="missing"):
        check_calls(calls.drop("year"))
    with pytest.raises(ValueError, match="repeated"):
        check_calls(calls.unionByName(calls))
    with pytest.raises(ValueError, match="null"):
        check_calls(calls.withColumn("ticker", F.lit(None).cast("string")))


def test_tables(spark, tmp_path):
    tables.write_csv(spark.createDataFrame([(1, "x")], "a int, b string"), str(tmp_path / "t.csv"))
    assert tables.read_table(spark, str(tmp_path / "t.csv"), "a int, b string", ["b"]).first().b == "x"
    assert tables.read_table(spark, str(tmp_path / "none.parquet"), "a int", required=False).count() == 0
    with pytest.raises(ValueError):
        tables.read_table(spark, "x.txt")
    spark.createDataFrame([(1,)], "a int").write.parquet(str(tmp_path / "m" / "1.parquet"))
    spark.createDataFrame([(2, 3)], "a int, b int").write.parquet(str(tmp_path / "m" / "2.parquet"))
    assert sorted((r.a, r.b) for r in tables.read_many(spark, str(tmp_path / "m" / "*.parquet")).collect()) == [(1, None), (2, 3)]
    (tmp_path / "f").write_bytes(b"x")
    assert tables.file_digests(spark, str(tmp_path / "f")).first().sha256 == tables.digest(str(tmp_path / "f"))


def test_stream_equals_batch(spark, tmp_path):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:10:00' AS ts, 'analyst' AS role, 'that is it' AS text UNION ALL SELECT timestamp'2024-01-01 00:20:00', 'analyst', 'no' UNION ALL SELECT timestamp'2024-01-01 02:00:00', 'management', 'of and'")
    rows.write.parquet(str(tmp_path / "in"))
    batch = sorted((r.role, r.turns, r.topical_turns) for r in windowed_intensity(rows, ["that"], ["of", "and"]).collect())
    stream = windowed_intensity(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), ["that"], ["of", "and"])
    q = stream.writeStream.format("memory").queryName("live").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert sorted((r.role, r.turns, r.topical_turns) for r in spark.table("live").collect()) == batch == [("analyst", 2, 1), ("management", 1, 1)]


def test_sql_agrees_on_made_texts(spark, tmp_path):
    """Cases that the driver's tables don't hold: weak families, cancelling contexts, sessions that open by each rule."""
    from tests.test_texts import KEYWORD_TEXTS

    spark.createDataFrame([*enumerate(KEYWORD_TEXTS), (900, None), (901, "")], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    long = "We sold more. " * 90
    sessions = [
        [("system", "We will now begin the question and answer session."), ("user", "How are you?")],
        [("system", "Welcome to the call. We will now begin the Q&A."), ("assistant", long), ("assistant", long), ("system", "Our next question comes from Bob."), ("user", "Why?")],
        [("assistant", long), ("assistant", long), ("assistant", "x"), ("system", "A q & a session follows."), ("user", "so")],
        [("assistant", long), ("assistant", "Let's move to questions."), ("user", "so")],
        [("system", "hello"), ("user", "hm"), ("system", "The first question, then."), ("assistant", "yes")],
        [("assistant", "hi"), ("assistant", "hi"), ("user", "what? " * 3)],
        [("user", None), ("assistant", "")],
        # A line break ends what a rule may span.
        [("assistant", long), ("assistant", long), ("assistant", "x"), ("system", "open the lines now\nfor your questions please"), ("user", "so")],
        [("assistant", long), ("assistant", long), ("assistant", "x"), ("system", "open the lines now for your questions please"), ("user", "so")],
    ]
    spark.createDataFrame([(c, t, r, x) for c, s in enumerate(sessions) for t, (r, x) in enumerate(s)], "conv_id long, turn int, role string, text string").coalesce(1).write.parquet(str(tmp_path / "conversations.parquet"))
    con = duckdb.connect()
    for name in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("keyword_signal_exact", "question_session_start", "sentence_explode"):
        _same(spark, con, name, str(tmp_path))
    starts = [r.qa_start for r in plans.QUERIES["question_session_start"](spark, str(tmp_path)).orderBy("doc_id").collect()]
    assert starts == [0, 3, 3, 1, 2, 1, 2, 5, 3]
