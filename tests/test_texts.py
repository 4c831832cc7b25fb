import math
import re
from collections import Counter

from turnlake.functions import scalars as S
from turnlake.operators import metrics, rankings, sampling, tokens
from turnlake.operators.keywords import Lexicon, with_keywords
from turnlake.operators.sentences import sentences_of
from pyspark.sql import functions as F


#: A sentence or more for every rule of the keyword signals.
KEYWORD_TEXTS = [
    "We use artificial intelligence in every product.", "Our ChatGPTs grow.", "We came to the aid of customers.", "We paid ai vendors.", "The data center data centers grew.", "Tensor and cuda support is here.",
    "Data center power and cloud computing cost rose.", "generative AI", "We rolled out automation and automated checkout lanes.", "Our big data and data science teams grew.", "Inference and training data.",
    "An inference workload, the inference.", "Data-driven edge computing. And (noise) more! [aside] Was it? 3 times.", "J'ai vu, aié ai. Ça ai-je? Où l'éai?", "RPA rpa, robotic process automation; an algorithmic method, analytics, GPU gpus gput.",
    "Cloud computing " + "x" * 130 + " and big data " + "y" * 130 + " with workflow automation.", "Revenue from the algorithm; " + "z" * 100 + " the algorithm and long-term algorithm.", "no keyword", "word " * 200 + "ml nlp llm.",
]


def test_sentences(spark):
    text = "First  sentence here. [noise] Second one costs 3.5% more! Too short? No. " + "Long " * 200 + "end."
    found = spark.createDataFrame([(text,), (None,), ("",)], "t string").select(sentences_of(F.col("t")).alias("s")).collect()
    assert found[0].s[:2] == ["First sentence here.", "Second one costs 3.5% more!"] and found[0].s[-1].endswith("...") and len(found[0].s[-1]) == 515
    assert found[1].s == [] and found[2].s == []


def test_keyword_rules():
    lex = Lexicon()
    is_ai = lambda t: lex.signals(t)[0]
    assert is_ai("We use artificial intelligence in every product.") and is_ai("Our ChatGPTs grow.")
    assert not is_ai("We came to the aid of customers.") and not is_ai("We paid ai vendors.")  # a neighbour cancels
    assert not is_ai("The data center data centers grew.") and not is_ai("Tensor and cuda support is here.")  # one family each
    assert not is_ai("Data center power and cloud computing cost rose.")  # routine contexts
    topical, count, score, strong, weak, kept, *by = lex.signals("generative AI")
    assert (count, strong) == (2, 2) and score == 100.0 and by[:2] == [1, 1]
    assert lex.signals(None)[2] == 0.0


def test_keyword_families():
    is_ai = lambda t: Lexicon().signals(t)[0]
    one = {
        "data_center": "data center and data centers", "automation": "automation, automated, automate, automating and rpa", "algorithm": "an algorithmic method",
        "analytics": "big data, data science, data analytics and advanced analytics", "cloud": "cloud computing", "compute_hw": "gpu, gpus, cuda, tensor",
    }
    for text in one.values():
        assert not is_ai(f"We saw {text} here."), text
    names = list(one)
    for i, a in enumerate(names):
        for b in names[i + 1 :]:
            assert is_ai(f"We saw {one[a]} here, {'-' * 130} and {one[b]} there."), (a, b)
    assert is_ai("Inference and training data.") and is_ai("An inference workload.")  # inference, inference workload: two families
    assert not is_ai("We rolled out automation and automated checkout lanes.") and not is_ai("Our big data and data science teams grew.")
    assert not is_ai("Inference and inferences.") and is_ai("Data-driven edge computing.")


def test_keyword_columns(spark):
    df = spark.createDataFrame([("d", "machine learning", 1), ("e", None, 2), ("f", "MACHINE LEARNING and no more", 3), ("g", "none", None)], "doc_id string, text string, _kw int")
    out = {r.doc_id: r for r in with_keywords(df.drop("_kw")).collect()}
    assert out["d"].kw_is_ai and out["d"].kw_core_ai_count == 1 and not out["e"].kw_is_ai and out["f"].kw_core_ai_count == 1
    for r in out.values():
        assert tuple(r)[2:] == Lexicon().signals(r.text)


def test_intensity(spark):
    rows = [("d", "speech", i, i < 3) for i in range(5)] + [("d", "qa", i, i < 1) for i in range(4)] + [("e", "qa", 0, False)]
    s = metrics.section_metrics(spark.createDataFrame(rows, "doc_id string, section string, turn_idx int, kw_is_ai boolean"))
    d = {r.doc_id: r for r in metrics.document_metrics(s).collect()}
    assert d["d"].speech_kw_ai_ratio == 0.6 and abs(d["d"].overall_kw_ai_ratio - 4 / 9) < 1e-12
    assert d["e"].speech_total_sentences == 0 and d["e"].speech_kw_ai_ratio == 0.0 and d["e"].speech_kw_ai_sentences is None


def test_summary_and_split(spark):
    df = spark.createDataFrame([(0.0,), (0.0,), (0.1,), (0.3,)], "x double")
    r = metrics.ratio_summary(df, ["x"]).first()
    assert abs(r["median"] - 0.05) < 1e-12 and r["zero_share"] == 0.5
    assert metrics.zero_split(df, "x").first() == (2, 2)
    assert sum(r.n for r in metrics.histogram(df, "x").collect()) == 4


def test_tone(spark):
    rows = [("a", True, "strong growth, some risk and loss"), ("a", False, "weak"), ("b", True, "value"), ("c", True, "nothing")]
    out = {r.doc_id: (r.positive_tone_ratio, r.negative_tone_ratio) for r in tokens.tone(spark.createDataFrame(rows, "doc_id string, kw_is_ai boolean, text string")).collect()}
    assert out == {"a": (0.5, 0.5), "b": (1.0, 0.0), "c": (0.0, 0.0)}


def test_tfidf_is_normalised(spark):
    df = spark.createDataFrame([(1, "red red blue"), (2, "blue green"), (3, None)], "doc_id int, text string")
    w = {(r.doc_id, r.term): r.weight for r in tokens.tfidf(df, 1, 1).collect()}
    red, blue = (1 + math.log(2)) * (math.log(4 / 2) + 1), math.log(4 / 3) + 1
    assert abs(w[1, "red"] - red / math.hypot(red, blue)) < 1e-12 and abs(sum(v * v for (d, _), v in w.items() if d == 2) - 1) < 1e-12


def test_tfidf_keeps_pairs_where_they_are(spark, monkeypatch):
    """Parts exchange terms, not pairs of key and term; keys may repeat and be null."""
    monkeypatch.setattr(tokens, "PART_BYTES", 40)
    rows = [("a", "red red blue"), ("b", "blue green"), ("a", "Blue sky"), (None, "red sky"), (None, None), ("c", ""), ("d", "1 2"), ("e", "green sea sea sea")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    want = {}
    for i, t in rows:
        words = re.findall("[a-z]+", (t or "").lower())
        want.setdefault(i, Counter()).update(words + [" ".join(x) for x in zip(words, words[1:])])
    seen = Counter(term for c in want.values() for term in c)
    for least, sublinear, terms in ((1, True, None), (2, False, None), (1, True, 3)):
        out = tokens.tfidf(df, 1, 2, min_df=least, sublinear=sublinear, max_terms=terms)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "CoGroups" in plan and "Window" not in plan
        total = Counter(term for c in want.values() for term in c.elements())
        kept = sorted((x for x in seen if seen[x] >= least), key=lambda x: (-total[x], x))[:terms]
        raw = {(i, x): (1 + math.log(n) if sublinear else n) * (math.log(6 / (1 + seen[x])) + 1) for i, c in want.items() for x, n in c.items() if x in kept}
        norm = {i: math.sqrt(sum(v * v for (j, _), v in raw.items() if j == i)) for i, _ in raw}
        found = {(r.doc_id, r.term): r for r in out.collect()}
        assert found.keys() == raw.keys() and out.columns == ["doc_id", "term", "tf", "df", "weight"]
        assert all((r.tf, r.df) == (want[i][x], seen[x]) and abs(r.weight - raw[i, x] / norm[i]) < 1e-12 for (i, x), r in found.items())
    assert tokens.tfidf(df.limit(0)).count() == 0 and tokens.tfidf(df, min_df=99).count() == 0


def test_keys(spark):
    df = spark.createDataFrame([("A_B_2024Q1",), ("X_bad",), (None,)], "doc_id string")
    out = [tuple(r) for r in df.select(S.key_ticker("doc_id"), S.key_year("doc_id"), S.key_quarter("doc_id")).collect()]
    assert out == [("A_B", 2024, 1), ("X", None, None), (None, None, None)]


def test_quadrants_and_context(spark):
    df = spark.createDataFrame([("a", 1.0, 1.0), ("b", 0.0, 1.0), ("c", 1.0, 0.0), ("d", 0.0, None)], "t string, x double, y double")
    assert {r.t: r.quadrant for r in rankings.quadrants(df, "x", "y").collect()} == {"a": "Aligned", "b": "Passive", "c": "Self-Promoting", "d": "Silent"}
    rows = spark.createDataFrame([("d", i) for i in range(10)], "doc_id string, original_idx int")
    assert sorted(r.original_idx for r in rankings.around(rows, rows.filter("original_idx IN (0, 5)"), 1).collect()) == [0, 1, 4, 5, 6]


def test_samples_repeat_and_show_no_text_twice(spark):
    rows = [("a", "qa", "same", True), ("b", "qa", "same", True), ("c", "qa", "other", False), ("d", "qa", "more", False)]
    df = spark.createDataFrame(rows, "doc_id string, section string, text string, kw_is_ai boolean")
    a, b = (sorted(map(tuple, sampling.sentence_audit(df, 2).collect())) for _ in range(2))
    assert a == b and len({r[3] for r in a}) == len(a) == 3
