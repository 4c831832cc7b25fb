"""Deterministic samples for annotation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnlake.functions.scalars import truncated
from turnlake.operators.ordered import quantile_row


def _order(key: list[str], seed: int):
    return [F.xxhash64(*key, F.lit(seed)), *[F.col(k) for k in key]]


def sample(df: DataFrame, n: int, key: list[str], seed: int = 42) -> DataFrame:
    """n rows in hash order: the same rows on every run and cluster."""
    return df.orderBy(*_order(key, seed)).limit(n)


def stratified(df: DataFrame, stratum: str, n: int, key: list[str], seed: int = 42) -> DataFrame:
    """Up to n rows of each stratum."""
    rank = F.row_number().over(Window.partitionBy(stratum).orderBy(*_order(key, seed)))
    return df.withColumn("_n", rank).filter(F.col("_n") <= n).drop("_n")


def distinct_texts(df: DataFrame, shown: list[str], key: list[str]) -> DataFrame:
    """Of rows that look the same, the first by key."""
    rank = F.row_number().over(Window.partitionBy(*shown).orderBy(*key))
    return df.withColumn("_n", rank).filter("_n = 1").drop("_n")


def bands(df: DataFrame, score: str, n: int, key: list[str], seed: int = 42) -> DataFrame:
    """n rows each from around the low, middle and high quantiles of a score."""
    cut = F.broadcast(quantile_row(df, {f"_q{i}": (score, s) for i, s in enumerate((0.1, 0.45, 0.55, 0.9))}))  # one row
    q = [F.col(f"_q{i}") for i in range(4)]
    band = F.when(F.col(score) <= q[0], "low").when(F.col(score).between(q[1], q[2]), "mid").when(F.col(score) >= q[3], "high")
    marked = df.crossJoin(cut).withColumn("band", band).drop(*[f"_q{i}" for i in range(4)]).filter("band IS NOT NULL")
    return stratified(marked, "band", n, key, seed)


def sentence_audit(sentences: DataFrame, n: int = 50, seed: int = 42) -> DataFrame:
    """n topical and n other sentences, no two that read alike, with empty
    columns for two annotators."""
    unique = distinct_texts(sentences, ["text", "kw_is_ai"], ["doc_id", "section"])
    drawn = stratified(unique, "kw_is_ai", n, ["doc_id", "section", "text"], seed)
    number = F.row_number().over(Window.orderBy(*_order(["doc_id", "section", "text"], seed)))
    empty = [F.lit(None).cast("string").alias(c) for c in ("annotator_a", "annotator_b", "adjudicated", "notes")]
    return drawn.select(number.alias("sample_id"), "doc_id", "section", "text", F.col("kw_is_ai").cast("int").alias("prediction"), *empty)


def exchange_audit(exchanges: DataFrame, n: int = 25, seed: int = 42) -> DataFrame:
    """n exchanges of each initiation type."""
    return stratified(exchanges, "initiation_type", n, ["doc_id", "exchange_idx"], seed)


def _first(df: DataFrame, n: int, key: list[str], seed: int) -> DataFrame:
    return df.orderBy(*_order(key, seed)).limit(n)


def _sheet(drawn: DataFrame, key: list[str], seed: int, shown: list, blank: list[str]) -> DataFrame:
    """The rows of a sheet in mixed order, numbered, with columns to fill in."""
    number = F.row_number().over(Window.orderBy(*_order(key, seed)))  # over the rows of one sheet
    return drawn.select(number.alias("sample_id"), *shown, *[F.lit(None).cast("string").alias(c) for c in blank])


ROLES = ["analyst", "management", "operator", "unknown"]


def role_audit(sentences: DataFrame, n: int = 100, seed: int = 42) -> DataFrame:
    """n question turns to judge the role of, as even over the roles as there are
    turns of them: the first of each role in hash order, then the second, ...

    A turn has its sentences in order, its first speaker and role (``unknown`` if
    null), and whether a sentence of it is on the topic.
    """
    qa = sentences.filter(F.col("section") == "qa")
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sentence_idx", F.coalesce("text", F.lit("")).alias("text")))), lambda s: s["text"]), " ")
    turns = qa.groupBy("doc_id", "turn_idx").agg(
        F.coalesce(F.min_by("speaker", "sentence_idx"), F.lit("")).alias("speaker"), F.coalesce(F.min_by("role", "sentence_idx"), F.lit("unknown")).alias("role"), said.alias("text"),
        F.coalesce(F.max(F.col("kw_is_ai").cast("int")), F.lit(0)).alias("topical"), F.count("*").alias("n_sentences"),
    )
    key = ["doc_id", "turn_idx"]
    known = F.when(F.col("role").isin(ROLES), F.col("role")).otherwise("unknown")
    few = [_first(turns.filter(known == r), n, key, seed) for r in ROLES]
    pool = reduce(DataFrame.unionByName, few).withColumn("_r", known)  # n rows a role at most
    rank = F.row_number().over(Window.partitionBy("_r").orderBy(*_order(key, seed)))
    drawn = pool.withColumn("_n", rank).orderBy("_n", "_r").limit(n)
    return _sheet(drawn, key, seed + 1, ["doc_id", "turn_idx", "speaker", "text", F.col("role").alias("prediction"), "topical", "n_sentences"], ["annotator_a", "annotator_b", "adjudicated", "notes"])


def boundary_audit(parsed: DataFrame, documents: DataFrame, n: int = 60, seed: int = 42, ratio: str = "overall_kw_ai_ratio") -> DataFrame:
    """n calls to judge the start of questions in: a third each of those with the
    lowest and highest ratio (drawn from three times as many), the others between
    the quartiles, and any call where these are too few.

    Shown are the last two turns before the boundary and the first two after it;
    a call without metrics has ratio 0.
    """
    turns = lambda c: F.coalesce(F.col(c), F.array().cast(parsed.schema[c].dataType))
    line = lambda t: F.concat(F.coalesce(t["speaker"], F.lit("")), F.lit(": "), truncated(F.coalesce(t["text"], F.lit("")), 240))
    preview = lambda some: F.array_join(F.transform(some, line), "\n")
    speech, qa = turns("speech_turns"), turns("qa_turns")
    calls = parsed.select(
        "doc_id", F.size(speech).alias("speech_turns"), F.size(qa).alias("qa_turns"), "num_qa_exchanges",
        preview(F.slice(speech, F.greatest(F.size(speech) - 1, F.lit(1)), F.lit(2))).alias("speech_tail"), preview(F.slice(qa, 1, 2)).alias("qa_head"),
    ).join(documents.select("doc_id", F.col(ratio).alias("_q")), "doc_id", "left").withColumn(ratio, F.coalesce("_q", F.lit(0.0))).drop("_q")
    third = n // 3
    low = _first(calls.orderBy(ratio, "doc_id").limit(3 * third), third, ["doc_id"], seed)
    high = _first(calls.orderBy(F.desc(ratio), F.desc("doc_id")).limit(3 * third).join(low.select("doc_id"), "doc_id", "left_anti"), third, ["doc_id"], seed + 1)
    edge = low.unionByName(high)
    rest = calls.join(edge.select("doc_id"), "doc_id", "left_anti")
    cuts = F.broadcast(quantile_row(rest, {"_q1": (ratio, 0.25), "_q3": (ratio, 0.75)}))  # one row
    between = F.col(ratio).between(F.col("_q1"), F.col("_q3"))
    mid = rest.crossJoin(cuts).withColumn("_out", (~between).cast("int")).orderBy("_out", *_order(["doc_id"], seed + 2)).limit(n).drop("_q1", "_q3", "_out")
    drawn = edge.withColumn("_p", F.lit(0)).unionByName(mid.withColumn("_p", F.lit(1))).orderBy("_p").limit(n).drop("_p")
    return _sheet(drawn, ["doc_id"], seed + 3, [c for c in calls.columns], ["annotator_a", "annotator_b", "adjudicated", "pairing_a", "pairing_b", "pairing", "notes"])
