"""Sheets for annotators."""

from collections import Counter

from pyspark.sql import functions as F

from turnlake.operators import sampling


def test_roles_are_as_even_as_they_can_be(spark):
    rows = [(f"d{t % 7}", "qa", t, s, "Sp", ["analyst", "management", "management", "management", None][t % 5] if t else "operator", f"text {s}", s == 1) for t in range(40) for s in (1, 0)]
    rows += [("d0", "speech", 99, 0, "Sp", "operator", "no", False)]
    df = spark.createDataFrame(rows, "doc_id string, section string, turn_idx int, sentence_idx int, speaker string, role string, text string, kw_is_ai boolean")
    found = sampling.role_audit(df, 16).collect()
    assert Counter(r.prediction for r in found) == {"analyst": 5, "management": 5, "unknown": 5, "operator": 1}
    assert sorted(r.sample_id for r in found) == list(range(1, 17)) and {r.text for r in found} == {"text 0 text 1"} and {(r.topical, r.n_sentences, r.annotator_a) for r in found} == {(1, 2, None)}
    assert [tuple(r) for r in sampling.role_audit(df.repartition(5), 16).collect()] == [tuple(r) for r in found]
    assert sampling.role_audit(df, 500).count() == 40 and sampling.role_audit(df.limit(0)).count() == 0


def test_boundaries_by_band(spark):
    turn = "array<struct<speaker:string,role:string,text:string,is_question:boolean>>"
    parsed = spark.createDataFrame([(f"d{i:03d}", [("A", "management", f"s{k}", False) for k in range(i % 4)], [("B", None, "x" * 300, True), ("C", None, None, True), ("D", None, "z", True)][: i % 5] or None, i) for i in range(90)], f"doc_id string, speech_turns {turn}, qa_turns {turn}, num_qa_exchanges int")
    metrics = spark.createDataFrame([(f"d{i:03d}", i / 90.0) for i in range(1, 90)], "doc_id string, overall_kw_ai_ratio double")
    found = {int(r.doc_id[1:]): r for r in sampling.boundary_audit(parsed, metrics, 30).collect()}
    assert len(found) == 30 and sum(i < 30 for i in found) >= 10 and sum(i >= 60 for i in found) >= 10
    low, high = [i for i in found if i < 30], [i for i in found if i >= 60]
    assert len(low) + len(high) >= 20 and all(22 <= i <= 67 for i in found if i not in low and i not in high)
    for i, r in found.items():
        assert r.speech_turns == i % 4 and r.qa_turns == min(i % 5, 3) and r.speech_tail == "\n".join(f"A: s{k}" for k in range(i % 4))[-11:]
        assert r.qa_head == "\n".join(["B: " + "x" * 240 + "...", "C: "][: min(i % 5, 2)])
    assert sampling.boundary_audit(parsed, metrics, 300).count() == 90 and sampling.boundary_audit(parsed.limit(0), metrics).count() == 0
