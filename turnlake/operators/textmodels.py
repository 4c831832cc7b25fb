"""Models on text weights and panels: out-of-fold scores, expanding refits,
coefficients by term, cases to read."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnlake.operators import sparse, stats
from turnlake.operators.ml import balanced
from turnlake.operators.ordered import quantile_row
from turnlake.operators.tokens import grams, tfidf
from turnlake.sources.scratch import Steps

#: Strengths tried, how much a strength is relaxed while nothing is chosen, and
#: how often at most.
STRENGTHS, RELAX, RELAXATIONS = [1e-5, 1e-4, 1e-3, 1e-2], 0.3, 6


def text_weights(texts: DataFrame, terms: int = 2_000, extra: list[str] | None = None, **weights) -> DataFrame:
    """(doc_id, term, weight): TF-IDF weights of the ``terms`` most frequent
    terms, and each extra column as a term of its name in brackets."""
    w = tfidf(texts.select("doc_id", "text"), max_terms=terms, **weights).select("doc_id", "term", "weight")
    for c in extra or []:
        w = w.unionByName(texts.select("doc_id", F.lit(f"[{c}]").alias("term"), F.col(c).cast("double").alias("weight")).filter("weight <> 0"))
    return w


def fold_weights(texts: DataFrame, folds: int, low: int = 1, high: int = 2, min_df: int = 1, max_df: float = 1.0, max_terms: int = 2_000, stop: list[str] | None = None) -> DataFrame:
    """(held, doc_id, term, weight): TF-IDF weights of every document for each
    held-out fold, from the statistics of the other folds alone.

    ``texts`` has doc_id, text and fold, a row a document.  Texts are scanned
    once: what the other folds count is the total less the fold's own, so the
    vocabularies of all folds follow from one table.  A term that only the
    held-out fold has takes no part; a document of unknown terms has no row.
    """
    keep = Steps(texts.sparkSession)
    counted = keep.stored(grams(texts, low, high, "doc_id", stop).groupBy("doc_id", "term").agg(F.count("*").alias("tf")).join(texts.select("doc_id", "fold"), "doc_id"), "counts")
    own = texts.groupBy("fold").agg(F.count("*").alias("docs"))
    sizes = own.agg(F.sum("docs").alias("all")).crossJoin(own).select("fold", (F.col("all") - F.col("docs")).alias("docs"))
    by = lambda c, f: F.sum(F.when(F.col("fold") == f, c).otherwise(0))
    total = counted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"), *[e for f in range(folds) for e in (by(F.lit(1), f).alias(f"df{f}"), by(F.col("tf"), f).alias(f"n{f}"))])
    total = keep.stored(total, "terms")
    left = []
    for f in range(folds):
        train = total.select("term", (F.col("df") - F.col(f"df{f}")).alias("df"), (F.col("n") - F.col(f"n{f}")).alias("n")).crossJoin(F.broadcast(sizes.filter(F.col("fold") == f)))  # one row
        kept = train.filter((F.col("df") >= max(min_df, 1)) & (F.col("df") <= F.col("docs") * max_df))
        left.append(kept.orderBy(F.desc("n"), "term").limit(max_terms).select(F.lit(f).alias("held"), "term", "df", "docs"))
    vocabulary = left[0]
    for more in left[1:]:
        vocabulary = vocabulary.unionByName(more)
    raw = counted.drop("fold").join(vocabulary, "term").withColumn("w", (1 + F.ln("tf")) * (F.ln((1 + F.col("docs")) / (1 + F.col("df"))) + 1))
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("held", "doc_id")))
    return raw.select("held", "doc_id", "term", (F.col("w") / norm).alias("weight"))


def fold_scores(texts: DataFrame, label: str, folds: int, c: float = 0.8, **weights) -> DataFrame:
    """``texts`` (doc_id, text, fold, label) with ``score``: the chance that an L1
    logistic regression on the text, fitted on the other folds with classes of
    equal weight, gives; the training share where one class or no term is left."""
    keep = Steps(texts.sparkSession)
    w = keep.stored(fold_weights(texts, folds, **weights), "weights")
    rows = texts.filter(F.col(label).isNotNull())
    parts = []
    for f in range(folds):
        own, train, test = w.filter(F.col("held") == f).drop("held"), rows.filter(F.col("fold") != f), texts.filter(F.col("fold") == f)
        n, share = train.agg(F.count("*"), F.avg(F.col(label).cast("double"))).first()
        if not n or share in (0.0, 1.0):
            parts.append(test.withColumn("score", F.lit(0.5 if share is None else share)))
            continue
        fitted = sparse.fit(own, balanced(train, label), label, 1 / (c * n), logistic=True, weight="weight")
        scored = sparse.margins(own, test, fitted).withColumn("score", 1 / (1 + F.exp(-F.col("margin")))).drop("margin")
        parts.append(keep.stored(scored, "scores"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def sparse_classifier(texts: DataFrame, label: str, extra: list[str] | None = None, c: float = 0.8, folds: int = 4, terms: int = 2_000, least: int = 12, longest: int = 2) -> dict | None:
    """L1 logistic regression on text: out-of-fold scores and their measures,
    and the terms with a coefficient, with document frequencies.  None with
    fewer than ``least`` texts or one class."""
    keep = Steps(texts.sparkSession)
    rows = texts.dropna(subset=[label])
    classes = [r[0] for r in rows.select(label).distinct().collect()]
    n = rows.count()
    if n < least or len(classes) < 2:
        return None
    weights = keep.stored(text_weights(rows, terms, extra, high=longest), "weights")
    made = keep.stored(stats.hash_folds(balanced(rows, label), "doc_id", folds, stratum=label), "rows")
    whole = sparse.fit(weights, made, label, 1 / (c * n), logistic=True, weight="weight")
    parts = []
    for f in range(folds):
        train, test = made.filter(F.col("fold") != f), made.filter(F.col("fold") == f)
        fitted = sparse.fit(weights, train, label, 1 / (c * max(train.count(), 1)), logistic=True, weight="weight", start=whole)
        parts.append(sparse.margins(weights, test, fitted).select("doc_id", label, (1 / (1 + F.exp(-F.col("margin")))).alias("score")))
    scored = parts[0]
    for p in parts[1:]:
        scored = scored.unionByName(p)
    scored = keep.stored(scored, "scores")
    df = weights.groupBy("term").agg(F.count("*").alias("df"))
    terms_out = rows.sparkSession.createDataFrame(list(whole.coefficients.items()), "term string, coefficient double").join(df, "term", "left").orderBy(F.desc(F.abs("coefficient")), "term")
    measures = stats.classification_metrics(scored, label, "score").first().asDict() | {"roc_auc": stats.roc_auc(scored, label, "score", None).first()["auc"], "n": n, "target": label}
    return {"scores": scored, "terms": terms_out, "measures": measures}


def _r2(df: DataFrame, y: str) -> float:
    value = stats.regression_metrics(df, y, "margin").first()["r2"]
    return -math.inf if value is None else value


def text_regression(texts: DataFrame, y: str, terms: int = 2_000, ratio: float = 0.5, draws: int = 5) -> DataFrame:
    """(term, coefficient, stability): elastic net of y on text weights.

    The strength is the best on two later parts of the quarters; while no term
    is chosen it is relaxed; if none ever is, terms are ranked by their
    correlation with y.  Stability: share of half samples that choose the term.
    """
    keep = Steps(texts.sparkSession)
    rows = keep.stored(texts.dropna(subset=[y]).withColumn("_t", F.col("year") * 4 + F.col("quarter")), "rows")
    weights = keep.stored(text_weights(rows, terms), "weights")
    quarters = sorted(r[0] for r in rows.select("_t").distinct().collect())  # a bounded calendar
    judged: dict[float, list[float]] = {a: [] for a in STRENGTHS}
    for part in (1, 2) if len(quarters) >= 3 else ():
        cut, end = quarters[len(quarters) * part // 3], quarters[min(len(quarters) * (part + 1) // 3, len(quarters) - 1)]
        train, test, found = rows.filter(F.col("_t") < cut), rows.filter(F.col("_t").between(cut, end)), None
        for a in sorted(STRENGTHS, reverse=True):  # each begins where the stronger one ended
            found = sparse.fit(weights, train, y, a, ratio, start=found)
            judged[a].append(_r2(sparse.margins(weights, test, found), y))
    strength = max(STRENGTHS, key=lambda a: (float(np.mean(judged[a])) if judged[a] else 0.0, a))
    found = sparse.Fit(0.0)
    for _ in range(RELAXATIONS):
        found = sparse.fit(weights, rows, y, strength, ratio)
        if found.coefficients:
            break
        strength *= RELAX
    chosen = found.coefficients or _correlations(weights, rows, y)
    times = dict.fromkeys(chosen, 0)
    for d in range(draws):
        half = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(d)), F.lit(2)) == 0)
        for t in sparse.fit(weights, half, y, strength, ratio, start=found).coefficients:
            times[t] = times.get(t, 0) + 1
    return texts.sparkSession.createDataFrame([(t, c, times[t] / max(draws, 1)) for t, c in chosen.items() if c], "term string, coefficient double, stability double").orderBy(F.desc(F.abs("coefficient")), "term")


def _correlations(weights: DataFrame, rows: DataFrame, y: str) -> dict[str, float]:
    """Correlation of each term's weight with y over all rows, zeros included; at
    most the terms of the weights."""
    n, mean, dev = rows.agg(F.count("*"), F.avg(y), F.stddev_pop(y)).first()
    if not n or not dev:
        return {}
    sums = weights.join(rows.select("doc_id", F.col(y).cast("double").alias("_y")), "doc_id").groupBy("term").agg(F.sum("weight").alias("s"), F.sum(F.col("weight") * F.col("weight")).alias("q"), F.sum(F.col("weight") * F.col("_y")).alias("p"))
    spread = F.sqrt(F.col("q") / n - F.pow(F.col("s") / n, 2))
    return {r["term"]: r["r"] for r in sums.filter(spread > 0).select("term", ((F.col("p") / n - F.col("s") / n * mean) / spread / dev).alias("r")).collect() if r["r"]}


def out_of_fold_tau(df: DataFrame, x: list[str], y: str, group: str, folds: int = 5, least: int = 10) -> tuple[DataFrame, float]:
    """(rows with ``predicted``, tau-b) of OLS fitted on the other groups; where
    too few rows are left or the fit fails, the training mean."""
    dealt = stats.group_folds(df.dropna(subset=[*x, y]), group, folds).cache()
    parts = []
    for f in range(folds):
        train, test = dealt.filter(F.col("fold") != f), dealt.filter(F.col("fold") == f)
        n, mean = train.agg(F.count("*"), F.avg(y)).first()
        made = F.lit(mean)
        if n >= max(least, len(x) + 2):
            beta = [r["coef"] for r in stats.ols_hc1(train, x, y)]
            if np.all(np.isfinite(beta)):
                made = sum((F.col(c) * b for c, b in zip(x, beta[1:], strict=True)), F.lit(beta[0]))
        parts.append(test.withColumn("predicted", made))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, stats.kendall_tau(out, y, "predicted")


def dual_path(df: DataFrame, paths: dict[str, tuple[list[str], str]], effects: list[str], least: int = 8, effects_least: int = 40) -> list[dict]:
    """Coefficients of each path, with fixed effects where the rows allow it."""
    out = []
    for name, (x, y) in paths.items():
        n = df.dropna(subset=[*x, y]).count()
        if n < least:
            continue
        rows = stats.fixed_effects(df, x, y, effects, effects_least) if n >= effects_least else []
        out += [{"path": name, "effects": bool(rows), **r} for r in rows or stats.ols_hc1(df, x, y)]
    return out


def standardised_association(df: DataFrame, x: str, y: str, effects: list[str], least: int = 300) -> list[dict]:
    return stats.fixed_effects(stats.zscored(df.dropna(subset=[x, y]), [x, y]), [x], y, effects, least)


def expanding_refits(df: DataFrame, x: list[str], y: str, first: int = 8, every: int = 6, most: int = 3) -> list[dict]:
    """Errors of OLS fitted up to each cut-off quarter on the quarters after it."""
    t = F.col("year") * 4 + F.col("quarter")
    rows = df.dropna(subset=[*x, y]).withColumn("_t", t)
    quarters = sorted(r[0] for r in rows.select("_t").distinct().collect())
    out = []
    for cut in quarters[first::every][:most]:
        beta = [r["coef"] for r in stats.ols_hc1(rows.filter(F.col("_t") <= cut), x, y)]
        made = sum((F.col(c) * b for c, b in zip(x, beta[1:], strict=True)), F.lit(beta[0]))
        m = stats.regression_metrics(rows.filter(F.col("_t") > cut).withColumn("prediction", made), y, "prediction").first()
        out.append({"cutoff": cut, **m.asDict()})
    return out


def cases(predictions: DataFrame, sentences: DataFrame, k: int = 3, snippets: int = 3) -> DataFrame:
    """The documents with the highest and lowest prediction among those with a
    topical sentence, each with its first topical sentences."""
    hits = sentences.filter(F.col("kw_is_ai").cast("boolean"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("original_idx"))
    read = hits.withColumn("_n", rank).filter(F.col("_n") <= snippets).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "text"))), lambda x: x["text"]), " | ").alias("snippets"))
    active = predictions.join(read, "doc_id")
    high = active.orderBy(F.desc("prediction"), "doc_id").limit(k).withColumn("case", F.lit("highest"))
    low = active.orderBy("prediction", "doc_id").limit(k).withColumn("case", F.lit("lowest"))
    return high.unionByName(low)


def series_by_size(df: DataFrame, value: str, size: str) -> DataFrame:
    """Mean of a value by quarter for entities at or above, and below, the
    median size of all rows."""
    cut = F.broadcast(quantile_row(df, {"_m": (size, 0.5)}))  # one row
    return df.crossJoin(cut).withColumn("size_group", F.when(F.col(size) >= F.col("_m"), "large").otherwise("small")).groupBy("year", "quarter", "size_group").agg(F.avg(value).alias(value), F.count("*").alias("n"))


def topic_features(mixtures: DataFrame, documents: DataFrame, k: int) -> DataFrame:
    """Document rows with a share for each topic and a flag for the dominant
    one; documents without topics have zeros."""
    wide = mixtures.select("doc_id", *[F.get("mixture", F.lit(i)).alias(f"topic_{i}") for i in range(k)], *[(F.col("dominant_topic") == i).cast("int").alias(f"dominant_{i}") for i in range(k)])
    return documents.join(wide, "doc_id", "left").fillna(0, [f"{p}_{i}" for p in ("topic", "dominant") for i in range(k)])


def turn_previews(parsed: DataFrame, n: int = 160, most: int = 40) -> DataFrame:
    """Both sections as one ordered array of short turns, for annotators."""
    short = lambda s, label: F.transform(s, lambda t, i: F.struct(F.lit(label).alias("section"), i.alias("turn_idx"), t["speaker"].alias("speaker"), t["role"].alias("role"), F.when(F.length(t["text"]) > n, F.concat(F.left(t["text"], F.lit(n)), F.lit("..."))).otherwise(t["text"]).alias("text")))
    return parsed.select("doc_id", F.slice(F.concat(short("speech_turns", "speech"), short("qa_turns", "qa")), 1, most).alias("turns"))


def head_and_tail(df: DataFrame, order: list[str], n: int) -> DataFrame:
    """The first and the last n rows of an order, each once."""
    first = df.orderBy(*order).limit(n)
    last = df.orderBy(*[F.desc(c) for c in order]).limit(n)
    return first.unionByName(last).dropDuplicates(order)


def terms_by_year(sentences: DataFrame, terms: list[str], top: int = 50, overall: bool = False) -> DataFrame:
    """(year, term, n): the most frequent of the given terms in each year, and
    with ``overall`` of all years together, whose year is null."""
    hits = sentences.select("year", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"\b(?:" + "|".join(sorted(terms, key=len, reverse=True)) + r")\b"), F.lit(0))).alias("term"))
    counted = hits.groupBy("year", "term").agg(F.count("*").alias("n"))
    if overall:
        counted = counted.filter("year IS NOT NULL").unionByName(counted.groupBy("term").agg(F.sum("n").alias("n")).select(F.lit(None).cast(counted.schema["year"].dataType).alias("year"), "term", "n"))
    rank = F.row_number().over(Window.partitionBy("year").orderBy(F.desc("n"), "term"))  # a row a term
    return counted.withColumn("_n", rank).filter(F.col("_n") <= top).drop("_n")


def volcano(weights: DataFrame, rows: DataFrame, y: str, coefficients: DataFrame) -> DataFrame:
    """(term, df, correlation, t, coefficient): each term's correlation with y
    over all rows, zeros included, its t statistic, and its coefficient (0.0 if
    it isn't chosen).  A term that every row has alike has no correlation."""
    keep = rows.select("doc_id", F.col(y).cast("double").alias("_y")).dropna()
    facts = F.broadcast(keep.agg(F.count("*").alias("_n"), F.avg("_y").alias("_m"), F.stddev_pop("_y").alias("_d")))  # one row
    w = F.col("weight")
    sums = weights.join(keep, "doc_id").groupBy("term").agg(F.count("*").alias("df"), F.sum(w).alias("s"), F.sum(w * w).alias("q"), F.sum(w * F.col("_y")).alias("p")).crossJoin(facts)
    n = F.col("_n")
    spread = F.sqrt(F.greatest(F.col("q") / n - F.pow(F.col("s") / n, 2), F.lit(0.0))) * F.col("_d")
    r = (F.col("p") / n - F.col("s") / n * F.col("_m")) / F.nullif(spread, F.lit(0.0))
    t = F.col("r") * F.sqrt((n - 2) / F.nullif(F.greatest(1 - F.col("r") * F.col("r"), F.lit(0.0)), F.lit(0.0)))
    return sums.withColumn("r", r).join(coefficients.select("term", "coefficient"), "term", "left").select("term", "df", F.col("r").alias("correlation"), t.alias("t"), F.coalesce("coefficient", F.lit(0.0)).alias("coefficient"))
