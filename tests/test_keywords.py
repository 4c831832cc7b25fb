"""Keywords and terms by column expressions, against a text at a time."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

from tests.test_texts import KEYWORD_TEXTS
from turnlake.operators import keywords, tokens
from turnlake.operators.keywords import Lexicon, term_hits, term_places, with_keywords

LONG_S, KELVIN, DOTTED, NBSP, LINE = map(chr, (0x17F, 0x212A, 0x130, 0xA0, 0x2028))


def _texts(n=400):
    rng = random.Random(9)
    lex = Lexicon()
    words = [w for _, w, _ in lex.terms] + [w + "s" for _, w, _ in lex.terms] + ["air", "aid", "12.5 ml", "paid", "email", "retail", "capex", "power", "cost", "pricing", "growth", "long-term algorithm", "x", "the", "1", "Ça", "naïve"]
    blanks = [" ", " ", " ", "  ", ", ", ". ", "\n", "\t", "-", f"{NBSP}", f"{LINE}", "_", "é", "'", " \x1c", ""]
    cased = lambda w: "".join(rng.choice([c, c.upper()]) for c in w) if rng.random() < 0.3 else w
    made = ["".join(cased(rng.choice(words)) + rng.choice(blanks) for _ in range(rng.randrange(1, 30))) for _ in range(n)]
    return [*KEYWORD_TEXTS, f"data {LONG_S}cience", f"a{DOTTED} chatbot{LONG_S}", f"deep{KELVIN} thin{KELVIN}", "ai", " ai", "AI.", "gpt-4 gpt4 GPT - 4", "a" * 5000 + " llm " + "b" * 5000, "machine\nlearning", "machine  learning", *made]


def test_columns_equal_a_text_at_a_time(spark):
    lex, texts = Lexicon(), _texts()
    df = spark.createDataFrame([*enumerate(texts), (-1, None), (-2, "")], "i int, text string").withColumn("_kw_hits", F.lit("own"))
    out = with_keywords(df)
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString()
    for r in out.collect():
        assert tuple(r)[3:] == lex.signals(r.text), r.text
        assert r._kw_hits == "own"
    assert with_keywords(df.limit(0)).count() == 0


def test_a_lexicon_of_ones_own(spark):
    lex = Lexicon(categories={"a": ["alpha beta", "beta"], "b": ["gamma-ray", "beta"]}, strong=["a"], exact=[], neighbours=[r"\bno\b"], routine=[r"\blab\b"], families=[])
    texts = ["alpha beta", "alpha  beta", "alpha betas and gamma-rays", "no beta", "beta in the lab", "gamma-ray beta", None]
    for r in with_keywords(spark.createDataFrame([(t,) for t in texts], "text string"), lex).collect():
        assert tuple(r)[1:] == lex.signals(r.text), r.text


def test_few_terms_go_to_the_texts(spark, monkeypatch):
    """No word is shuffled for them, whatever is known of the terms' size."""
    df = spark.createDataFrame([(1, "a b a c"), (2, "c a b")], "doc_id int, text string")
    terms = spark.createDataFrame([("a b",), ("c",)], "term string")
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most, sent in ((2, True), (1, False)):
            monkeypatch.setattr(keywords, "SENT_TERMS", most)
            found = term_hits(df, terms)
            assert ("BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()) == sent
            assert sorted(map(tuple, found.collect())) == [(1, "a b", 1), (1, "c", 1), (2, "a b", 1), (2, "c", 1)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_terms_of_many_words(spark):
    rng = random.Random(2)
    texts = [(i % 20, " ".join(rng.choice(["a", "b", "c", "d1e"]) for _ in range(rng.randrange(0, 40)))) for i in range(60)] + [(99, None)]
    terms = ["a", "a b", "A b c", "c c c c", "b, a", "zz", "", "d e"]
    df = spark.createDataFrame(texts, "doc_id int, text string")
    found = {(r.doc_id, r.term): r.hits for r in term_hits(df, spark.createDataFrame([(t,) for t in [*terms, "a"]], "term string")).collect()}
    want = Counter()
    for i, t in texts:
        words = re.findall("[a-z]+", (t or "").lower())
        for term in terms:
            w = re.findall("[a-z]+", term.lower())
            want[i, term] += sum(words[k : k + len(w)] == w for k in range(len(words))) if w else 0
    assert found == {k: v for k, v in want.items() if v}
    assert term_places(df, spark.createDataFrame([], "term string"), ["doc_id"]).count() == 0


def test_examples_of_many_words(spark):
    rows = [("d", 2, "The big data center."), ("d", 1, "A big center of data."), ("c", 5, "Big data here"), ("c", 5, "Also big data here")]
    df = spark.createDataFrame(rows, "doc_id string, original_idx int, text string")
    terms = spark.createDataFrame([("big data",), ("data center",), ("big",), ("none of it",)], "term string")
    assert {r.term: r.text for r in tokens.example_sentences(df, terms).collect()} == {"big data": "Also big data here", "data center": "The big data center.", "big": "Also big data here"}
