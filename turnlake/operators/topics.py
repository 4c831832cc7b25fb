"""Topics of all quarters in one job.

Expectation maximisation of smoothed mixtures of word distributions (the MAP
estimate under Dirichlet priors), keyed by quarter: a round joins each (quarter,
document, term, n) with its term's and its document's weights, and two
aggregations give the next ones.  Quarters of any number and size share rounds.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.operators.tokens import grams
from turnlake.sources.scratch import Steps

#: Priors on a document's topics and on a topic's terms, both above 1.
ALPHA, BETA = 1.1, 1.01


def counted_terms(docs: DataFrame, least_docs: int, min_df: int = 2, max_df: float = 0.9, terms: int = 5_000, stop: list[str] | None = None) -> DataFrame:
    """(q, doc_id, term, n, topics_most): words and word pairs of documents of
    (q, doc_id, text), for quarters with ``least_docs`` documents and more; the
    ``terms`` most frequent of each quarter that ``min_df`` documents hold at
    least and a share of ``max_df`` at most."""
    sizes = docs.groupBy("q").agg(F.count("*").alias("docs")).filter(F.col("docs") >= least_docs)
    keyed = docs.join(sizes, "q").withColumn("_key", F.struct("q", "doc_id", "docs"))
    own = grams(keyed.select("_key", "text"), 1, 2, "_key", stop).groupBy("_key", "term").agg(F.count("*").alias("n")).select("_key.*", "term", "n")
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("total"), "term"))  # over the terms of a quarter
    kept = own.groupBy("q", "docs", "term").agg(F.count("*").alias("df"), F.sum("n").alias("total")).filter((F.col("df") >= min_df) & (F.col("df") <= F.col("docs") * max_df)).withColumn("_r", rank).filter(F.col("_r") <= terms)
    many = kept.groupBy("q").agg(F.count("*").alias("v"))
    return own.join(kept.select("q", "term"), ["q", "term"]).join(many, "q").select("q", "doc_id", "term", F.col("n").cast("double").alias("n"), F.least("docs", "v").alias("most"))


def rounds(counts: DataFrame, k: int, seed: int, keep: Steps, most: int = 30, settled: float = 1e-4) -> Iterator[tuple[float, DataFrame, DataFrame]]:
    """(objective, terms, documents) after each round: (q, term, t0..) weights of
    a term in each topic, adding up to 1 over a topic, and (q, doc_id, d0..), to 1
    over a document.  The objective (log likelihood and priors) never falls; the
    rounds end when it rises by less than ``settled`` of itself."""
    topics = range(k)
    live = lambda i: F.lit(i) < F.greatest(F.least(F.col("most"), F.lit(k)), F.lit(2))
    draw = lambda i: F.when(live(i), 1.0 + F.pmod(F.xxhash64("q", "term", F.lit(seed), F.lit(i)), F.lit(1 << 20)) / float(1 << 20)).otherwise(0.0)

    def scaled(df: DataFrame, names: list[str], by: str) -> DataFrame:
        """Columns that add up to 1 over each ``by``."""
        total = df.groupBy(by).agg(*[F.sum(c).alias(f"_{c}") for c in names])
        return df.join(total, by).select(*[c for c in df.columns if c not in names], *[F.coalesce(F.try_divide(F.col(c), F.col(f"_{c}")), F.lit(0.0)).alias(c) for c in names])

    t, d = [f"t{i}" for i in topics], [f"d{i}" for i in topics]
    share = lambda c: F.col(c) / sum((F.col(x) for x in d), F.lit(0.0))
    terms = keep.stored(scaled(counts.groupBy("q", "term").agg(F.first("most").alias("most")).select("q", "term", *[draw(i).alias(t[i]) for i in topics]), t, "q"), "terms")
    documents = keep.stored(counts.groupBy("q", "doc_id").agg(F.first("most").alias("most")).select("q", "doc_id", *[F.when(live(i), 1.0).otherwise(0.0).alias(d[i]) for i in topics]).select("q", "doc_id", *[share(c).alias(c) for c in d]), "documents")
    before, prior = None, lambda c, weight: F.when(F.col(c) > 0, weight * F.ln(c)).otherwise(0.0)
    for _ in range(most):
        met = counts.join(terms, ["q", "term"]).join(documents, ["q", "doc_id"])
        chance: Column = sum((F.col(a) * F.col(b) for a, b in zip(t, d, strict=True)), F.lit(0.0))
        part = keep.stored(met.withColumn("_p", chance).select("q", "doc_id", "term", "n", "_p", *[(F.col("n") * F.col(a) * F.col(b) / F.col("_p")).alias(f"r{i}") for i, (a, b) in enumerate(zip(t, d, strict=True))], *t, *d), "parts")
        value = part.agg(F.sum(F.col("n") * F.ln("_p"))).first()[0] or 0.0
        value += terms.agg(F.sum(sum((prior(c, BETA - 1) for c in t), F.lit(0.0)))).first()[0] or 0.0
        value += documents.agg(F.sum(sum((prior(c, ALPHA - 1) for c in d), F.lit(0.0)))).first()[0] or 0.0
        yield value, terms, documents
        if before is not None and value - before <= settled * abs(before):
            return
        before = value
        # A topic that its quarter doesn't have keeps weight 0.
        had = lambda c, extra, i: F.when(F.max(c) > 0, F.sum(f"r{i}") + extra).otherwise(0.0)
        terms = keep.stored(scaled(part.groupBy("q", "term").agg(*[had(t[i], BETA - 1, i).alias(t[i]) for i in topics]), t, "q"), "terms")
        documents = keep.stored(part.groupBy("q", "doc_id").agg(*[had(d[i], ALPHA - 1, i).alias(d[i]) for i in topics]).select("q", "doc_id", *[share(c).alias(c) for c in d]), "documents")


def fitted(docs: DataFrame, k: int = 20, seed: int = 42, least_docs: int = 10, top: int = 10, stop: list[str] | None = None, most: int = 30) -> tuple[DataFrame, DataFrame]:
    """(topics, documents) of (q, doc_id, text): (q, topic_id, top_terms,
    top_weights), and (q, doc_id, mixture, dominant_topic, confidence).

    A quarter has k topics, or as many as it has documents or terms, 2 at least.
    Quarters with fewer than ``least_docs`` documents, and documents without a
    term that is kept, have no rows.  A repeated (q, doc_id) is one document.
    """
    keep = Steps(docs.sparkSession)
    counts = keep.stored(counted_terms(docs, least_docs, stop=stop), "counts")
    for _, terms, documents in rounds(counts, k, seed, keep, most):
        pass
    topics = range(k)
    long = terms.select("q", "term", F.posexplode(F.array(*[f"t{i}" for i in topics])).alias("topic_id", "weight")).filter("weight > 0")
    rank = F.row_number().over(Window.partitionBy("q", "topic_id").orderBy(F.desc("weight"), "term"))  # over the terms of a topic
    listed = long.withColumn("_r", rank).filter(F.col("_r") <= top).groupBy("q", "topic_id").agg(F.array_sort(F.collect_list(F.struct("_r", "term", "weight"))).alias("x"))
    described = listed.select("q", "topic_id", F.transform("x", lambda x: x["term"]).alias("top_terms"), F.transform("x", lambda x: x["weight"]).alias("top_weights"))
    mixture = F.filter(F.array(*[f"d{i}" for i in topics]), lambda x: x > 0)
    mixed = documents.select("q", "doc_id", mixture.alias("mixture"))
    return described, mixed.withColumn("dominant_topic", (F.array_position("mixture", F.array_max("mixture")) - 1).cast("int")).withColumn("confidence", F.array_max("mixture"))
