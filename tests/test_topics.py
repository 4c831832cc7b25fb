"""Topics of all quarters together."""

import numpy as np

from turnlake.operators import topics
from turnlake.sources.scratch import Steps


def _docs(spark):
    rng = np.random.default_rng(8)
    rows = [(q, f"{q}-{i}", " ".join(f"{'abc'[i % 3]}word{'uvwxyz'[rng.integers(0, 6)]}" for _ in range(30))) for q in (1, 2) for i in range(12)] + [(3, "few", "one text"), (1, "none", ""), (2, "null", None)]
    return spark.createDataFrame(rows, "q long, doc_id string, text string")


def test_the_objective_never_falls_and_is_what_it_says(spark):
    keep = Steps(spark)
    counts = keep.stored(topics.counted_terms(_docs(spark), 10), "counts")
    assert {r.q for r in counts.select("q").distinct().collect()} == {1, 2}
    values, k = [], 3
    for value, terms, documents in topics.rounds(counts, k, 1, keep, most=4):
        values.append(value)
        t = {(r.q, r.term): np.array([r[f"t{i}"] for i in range(k)]) for r in terms.collect()}
        d = {(r.q, r.doc_id): np.array([r[f"d{i}"] for i in range(k)]) for r in documents.collect()}
        for q in (1, 2):
            assert np.allclose(sum(v for (own, _), v in t.items() if own == q), 1) and all(np.isclose(v.sum(), 1) for v in d.values())
        want = sum(r.n * np.log(t[r.q, r.term] @ d[r.q, r.doc_id]) for r in counts.collect())
        want += (topics.BETA - 1) * sum(np.log(v).sum() for v in t.values()) + (topics.ALPHA - 1) * sum(np.log(v).sum() for v in d.values())
        assert abs(value - want) < 1e-6 * abs(want)
    assert len(values) == 4 and all(b >= a for a, b in zip(values, values[1:], strict=False)) and values[-1] > values[0] + 1


def test_topics_find_the_groups(spark):
    described, mixed = topics.fitted(_docs(spark), k=3, most=25)
    found = {(r.q, r.doc_id): r for r in mixed.collect()}
    assert len(found) == 24 and all(abs(sum(r.mixture) - 1) < 1e-9 and r.confidence == max(r.mixture) for r in found.values())
    same = [(found[q, f"{q}-{i}"].dominant_topic == found[q, f"{q}-{j}"].dominant_topic) == (i % 3 == j % 3) for q in (1, 2) for i in range(12) for j in range(i)]
    assert sum(same) > 0.75 * len(same)
    assert {(r.q, len(r.top_terms)) for r in described.collect()} == {(1, 10), (2, 10)}
    again = topics.fitted(_docs(spark).repartition(5), k=3, most=25)[1]
    assert all(np.allclose(r.mixture, found[r.q, r.doc_id].mixture) for r in again.collect())
