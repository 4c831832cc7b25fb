"""How much of a document is on topic, where, and who says it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.functions.scalars import guarded_ratio, open_ratio
from turnlake.operators.ordered import quantile_row


def section_metrics(sentences: DataFrame, flag: str = "kw_is_ai") -> DataFrame:
    """Sentences, topical ones and their share, by document and section."""
    hit = F.col(flag).cast("boolean").cast("int")
    return sentences.groupBy("doc_id", "section").agg(F.count("*").alias("total_sentences"), F.sum(hit).cast("long").alias("kw_ai_sentences"), F.avg(hit).alias("kw_ai_ratio"))


def document_metrics(sections: DataFrame) -> DataFrame:
    """Sections side by side.  A section that a document lacks has no sentences
    and ratio 0.0, and its topical count is missing."""
    of = lambda s, c: F.sum(F.when(F.col("section") == s, F.col(c)))
    zero = lambda c: F.coalesce(c, F.lit(0))
    columns = []
    for s in ("speech", "qa"):
        columns += [zero(of(s, "total_sentences")).cast("long").alias(f"{s}_total_sentences"), zero(of(s, "kw_ai_ratio")).cast("double").alias(f"{s}_kw_ai_ratio"), of(s, "kw_ai_sentences").cast("long").alias(f"{s}_kw_ai_sentences")]
    wide = sections.groupBy("doc_id").agg(*columns)
    hits = zero(F.col("speech_kw_ai_sentences")) + zero(F.col("qa_kw_ai_sentences"))
    return wide.withColumn("overall_kw_ai_ratio", guarded_ratio(hits, F.col("speech_total_sentences") + F.col("qa_total_sentences")))


def any_document_metrics(df: DataFrame) -> DataFrame:
    """Document metrics of whatever is given: documents with the overall ratio
    as they are, sections put side by side, and of counts alone the ratio of all
    topical sentences; a ValueError if it can't be formed."""
    have = {*df.columns}
    if "overall_kw_ai_ratio" in have:
        return df
    if {"doc_id", "section", "total_sentences", "kw_ai_sentences", "kw_ai_ratio"} <= have:
        return document_metrics(df)
    sides = ("speech", "qa")
    if {f"{s}_{c}" for s in sides for c in ("kw_ai_sentences", "total_sentences")} <= have:
        of = lambda c: sum((F.coalesce(f"{s}_{c}", F.lit(0)) for s in sides), F.lit(0))
        return df.withColumn("overall_kw_ai_ratio", guarded_ratio(of("kw_ai_sentences"), of("total_sentences")))
    raise ValueError("neither a ratio nor the counts to form it")


def keyword_metrics(sentences: DataFrame) -> DataFrame:
    """Five keyword measures for each of the two sections of a document."""
    columns = []
    for s in ("speech", "qa"):
        here = F.col("section") == s
        n, hit = F.count_if(here), F.count_if(here & F.col("kw_is_ai"))
        columns += [n.alias(f"{s}_sentences"), hit.alias(f"{s}_ai_sentences"), guarded_ratio(hit, n).alias(f"{s}_ai_ratio"), F.coalesce(F.sum(F.when(here, F.col("kw_match_count"))), F.lit(0)).cast("long").alias(f"{s}_matches"), F.coalesce(F.avg(F.when(here, F.col("kw_ai_score"))), F.lit(0.0)).alias(f"{s}_mean_score")]
    return sentences.groupBy("doc_id").agg(*columns)


def structure(sentences: DataFrame, flag: str = "kw_is_ai") -> DataFrame:
    """Shares by section and role, and where the first topical turn of the
    question session is and whose.  Shares are missing where nothing is there."""
    hit, qa = F.col(flag).cast("boolean"), F.col("section") == "qa"
    role = lambda r: qa & (F.col("role") == r)
    base = sentences.groupBy("doc_id").agg(
        F.count("*").alias("n_sentences"), F.count_if(qa).alias("n_qa"), F.count_if(hit).alias("n_ai"), F.count_if(hit & qa).alias("n_ai_qa"),
        F.count_if(role("analyst")).alias("n_analyst"), F.count_if(role("analyst") & hit).alias("n_analyst_ai"), F.count_if(role("management")).alias("n_management"), F.count_if(role("management") & hit).alias("n_management_ai"),
        F.max(F.when(qa, F.col("turn_idx"))).alias("last_turn"), F.min(F.when(qa & hit, F.struct("turn_idx", F.coalesce("role", F.lit("unknown")).alias("role")))).alias("first_ai"),
    )
    return base.select(
        "doc_id", open_ratio("n_qa", "n_sentences").alias("qa_share"), open_ratio("n_ai_qa", "n_ai").alias("ai_qa_share"), open_ratio("n_analyst_ai", "n_analyst").alias("analyst_ai_share"), open_ratio("n_management_ai", "n_management").alias("management_ai_share"),
        open_ratio(F.col("first_ai.turn_idx"), "last_turn").alias("first_ai_position"), F.coalesce(F.col("first_ai.role"), F.lit("none")).alias("first_ai_role"),
    )


def funnel(parsed: DataFrame, sentences: DataFrame, initiation: DataFrame) -> DataFrame:
    """(step, n, share): parsed calls, sentences by section, calls with exchanges."""
    n = sentences.agg(F.count("*").alias("total"), F.count_if(F.col("section") == "speech").alias("speech"), F.count_if(F.col("section") == "qa").alias("qa"))
    steps = n.crossJoin(parsed.agg(F.count_distinct("doc_id").alias("calls"))).crossJoin(initiation.agg(F.count_distinct("doc_id").alias("with_exchanges")))  # one row each
    rows = F.inline(F.array(*[F.struct(F.lit(s).alias("step"), F.col(c).alias("n"), guarded_ratio(c, d).alias("share")) for s, c, d in (("calls", "calls", "calls"), ("sentences", "total", "total"), ("speech_sentences", "speech", "total"), ("qa_sentences", "qa", "total"), ("calls_with_exchanges", "with_exchanges", "calls"))]))
    return steps.select(rows)


def ratio_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(metric, n, mean, median, std, p90, p95, zero_share, nonzero_share); the
    standard deviation is the population's."""
    x = {c: F.col(c).cast("double") for c in columns}
    moments = [e for c in columns for e in (F.count(x[c]).alias(f"n_{c}"), F.avg(x[c]).alias(f"mean_{c}"), F.stddev_pop(x[c]).alias(f"std_{c}"), F.avg((x[c] == 0).cast("int")).alias(f"zero_{c}"), F.avg((x[c] != 0).cast("int")).alias(f"nonzero_{c}"))]
    cuts = quantile_row(df, {f"q{int(100 * s)}_{c}": (c, s) for c in columns for s in (0.5, 0.9, 0.95)})
    row = lambda c: F.struct(F.lit(c).alias("metric"), F.col(f"n_{c}").alias("n"), F.col(f"mean_{c}").alias("mean"), F.col(f"q50_{c}").alias("median"), F.col(f"std_{c}").alias("std"), F.col(f"q90_{c}").alias("p90"), F.col(f"q95_{c}").alias("p95"), F.col(f"zero_{c}").alias("zero_share"), F.col(f"nonzero_{c}").alias("nonzero_share"))
    return df.agg(*moments).crossJoin(cuts).select(F.inline(F.array(*[row(c) for c in columns])))  # one row each


def zero_split(df: DataFrame, column: str) -> DataFrame:
    x = F.coalesce(F.col(column), F.lit(0))
    return df.agg(F.count_if(x == 0).alias("n_zero"), F.count_if(x != 0).alias("n_nonzero"))


def histogram(df: DataFrame, column: str, bins: int = 60, top: float = 0.995, least: float = 0.01) -> DataFrame:
    """(bin, n): zeros in bin 0 apart; equal bins up to the quantile ``top`` (at
    least ``least``); what lies above is in bin bins + 1."""
    x = F.col(column).cast("double")
    edge = quantile_row(df, {"top": (column, top)}).select(F.greatest("top", F.lit(least)).alias("edge"))
    binned = df.filter(x.isNotNull()).crossJoin(F.broadcast(edge)).withColumn("bin", F.when(x == 0, 0).otherwise(F.least(F.floor(x / F.col("edge") * bins) + 1, F.lit(bins + 1))).cast("int"))
    return binned.groupBy("bin").agg(F.count("*").alias("n"))
