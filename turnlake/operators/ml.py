"""Models: penalised regressions, forests, topics, components, and how they
are judged on folds or later quarters.  Fits use pyspark.ml."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.clustering import LDA
from pyspark.ml.feature import PCA, CountVectorizer, Imputer, NGram, OneHotEncoder, RegexTokenizer, StandardScaler, StopWordsRemover, StringIndexer, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnlake.functions.scalars import dominant, quarter_index
from turnlake.operators import stats
from turnlake.operators import topics as quarterly
from turnlake.sources.scratch import Steps

#: A quarter with fewer documents has no topics; most topics, terms.
TOPIC_DOCS, TOPICS, TOPIC_TERMS = 10, 20, 5_000


def preparation(numeric: list[str], categorical: list[str]) -> list:
    """Median imputation and scaling of numbers, one-hot of categories."""
    imputed, coded = [f"{c}_i" for c in numeric], [f"{c}_k" for c in categorical]
    stages: list = [Imputer(strategy="median", inputCols=numeric, outputCols=imputed), VectorAssembler(inputCols=imputed, outputCol="numbers"), StandardScaler(withMean=True, inputCol="numbers", outputCol="scaled")]
    parts = ["scaled"]
    if categorical:
        stages += [StringIndexer(inputCols=categorical, outputCols=coded, handleInvalid="keep"), OneHotEncoder(inputCols=coded, outputCols=[f"{c}_v" for c in categorical])]
        parts += [f"{c}_v" for c in categorical]
    return [*stages, VectorAssembler(inputCols=parts, outputCol="features")]


def balanced(df: DataFrame, label: str) -> DataFrame:
    """Weights that give each class the same total."""
    n = {r[0]: r[1] for r in df.groupBy(label).count().collect()}
    total = sum(n.values())
    weight = F.lit(None).cast("double")
    for value, k in n.items():
        weight = F.when(F.col(label) == value, total / (len(n) * k)).otherwise(weight)
    return df.withColumn("weight", weight)


def lasso_logistic(n: int, c: float = 0.6, label: str = "target") -> LogisticRegression:
    """L1 logistic regression; the inverse strength c is per row."""
    return LogisticRegression(labelCol=label, weightCol="weight", elasticNetParam=1.0, regParam=1 / (c * max(n, 1)), standardization=False, maxIter=200)


def forest(label: str = "target", trees: int = 300, seed: int = 42) -> RandomForestClassifier:
    return RandomForestClassifier(labelCol=label, weightCol="weight", numTrees=trees, minInstancesPerNode=10, seed=seed)


def elastic_net(label: str, strength: float = 0.01, ratio: float = 0.5) -> LinearRegression:
    return LinearRegression(labelCol=label, elasticNetParam=ratio, regParam=strength, standardization=False)


def out_of_fold(df: DataFrame, model, label: str, numeric: list[str], categorical: list[str], folds: int = 5) -> DataFrame:
    """Scores of rows (with ``fold``) by models fitted on the other folds; where
    a model can't be fitted, the share of the training rows."""
    parts = []
    for f in range(folds):
        train, test = df.filter(F.col("fold") != f), df.filter(F.col("fold") == f)
        seen = [r[0] for r in train.select(label).distinct().collect()]
        if len(seen) < 2:
            parts.append(test.withColumn("score", F.lit(float(seen[0]) if seen else 0.5)))
            continue
        train = balanced(train, label)
        fitted = Pipeline(stages=[*preparation(numeric, categorical), model(train.count())]).fit(train)
        parts.append(fitted.transform(test).withColumn("score", vector_to_array("probability")[1]).select(*df.columns, "score"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_MEASURES = ("auc", "accuracy", "precision", "recall", "f1")


def compared(df: DataFrame, label: str, group: str, numeric: list[str], categorical: list[str], folds: int = 5, trees: int = 300, text: str | None = None) -> dict:
    """The models of a benchmark over group folds.

    ``summary``: (model, auc_mean, auc_std, ..., folds), best first; ``folds``:
    the measures of each fold; ``roc``: (model, threshold, tpr, fpr) over all
    held-out rows; ``overlap``: groups that are in two folds, 0 by construction
    and counted here.  Models: the majority, L1 logistic regression and a forest
    on the columns, and with ``text`` L1 logistic regression on that column
    (rows have doc_id), whose vocabulary and idf are those of the training folds.
    """
    from turnlake.operators import textmodels

    keep = Steps(df.sparkSession)
    dealt = keep.stored(stats.group_folds(df, group, folds), "folds")
    made = {"majority": lambda: dealt.withColumn("score", F.lit(0.5)), "logistic_l1": lambda: out_of_fold(dealt, lambda n: lasso_logistic(n, label=label), label, numeric, categorical, folds), "random_forest": lambda: out_of_fold(dealt, lambda n: forest(label, trees), label, numeric, categorical, folds)}
    if text:
        made["text_l1"] = lambda: textmodels.fold_scores(dealt.select("doc_id", F.col(text).alias("text"), "fold", label), label, folds)
    rows, curves = [], []
    for name, scores in made.items():
        scored = keep.stored(scores().select("fold", label, "score"), "scored")
        for f in range(folds):
            one = scored.filter(F.col("fold") == f)
            m = stats.classification_metrics(one, label, "score").first()
            rows.append((name, f, stats.roc_auc(one, label, "score").first()["auc"], m["accuracy"], m["precision"], m["recall"], m["f1"]))
        curves.append(stats.roc_curve(scored, label, "score").select(F.lit(name).alias("model"), "threshold", "tpr", "fpr"))
    each = df.sparkSession.createDataFrame(rows, "model string, fold int, " + ", ".join(f"{m} double" for m in _MEASURES))
    parts = [e for c in _MEASURES for e in (F.avg(c).alias(f"{c}_mean"), F.coalesce(F.stddev_samp(c), F.lit(0.0)).alias(f"{c}_std"))]
    overlap = dealt.groupBy(group).agg(F.count_distinct("fold").alias("n")).filter("n > 1").count()
    return {"summary": each.groupBy("model").agg(*parts, F.count("*").alias("folds")).orderBy(F.desc("auc_mean"), "model"), "folds": each, "roc": reduce(DataFrame.unionByName, curves), "overlap": overlap}


def benchmark(df: DataFrame, label: str, group: str, numeric: list[str], categorical: list[str], folds: int = 5, trees: int = 300, text: str | None = None) -> DataFrame:
    """(model, auc_mean, auc_std, f1_mean, ...) over group folds, best first."""
    return compared(df, label, group, numeric, categorical, folds, trees, text)["summary"]


def later_quarters(df: DataFrame, k: int = 4) -> tuple[DataFrame, DataFrame]:
    """(train, test): the last k quarters are the test."""
    t = F.col("year") * 4 + F.col("quarter")
    last = [r[0] for r in df.select(t.alias("t")).distinct().orderBy(F.desc("t")).limit(k).collect()]
    cut = min(last) if last else 0
    return df.filter(t < cut), df.filter(t >= cut)


def text_features(stop: list[str] | None = None, min_df: float = 2, max_df: float = 0.9, terms: int = TOPIC_TERMS) -> list:
    """Words and word pairs as counts."""
    clean = StopWordsRemover(inputCol="raw", outputCol="words")
    if stop:
        clean = clean.setStopWords([*StopWordsRemover.loadDefaultStopWords("english"), *stop])
    return [RegexTokenizer(inputCol="text", outputCol="raw", pattern="[^a-z]+", minTokenLength=2), clean, NGram(n=2, inputCol="words", outputCol="pairs")], CountVectorizer(inputCol="all", outputCol="features", minDF=min_df, maxDF=max_df, vocabSize=terms)


def topics(docs: DataFrame, seed: int = 42, stop: list[str] | None = None, top: int = 10) -> tuple[DataFrame, DataFrame] | None:
    """(topics, documents) of the texts of one quarter: top terms and weights;
    the mixture, its strongest topic and its share.  None with too few texts."""
    n = docs.count()
    if n < TOPIC_DOCS:
        return None
    stages, counter = text_features(stop)
    words = Pipeline(stages=stages).fit(docs).transform(docs).withColumn("all", F.concat("words", "pairs"))
    vectorizer = counter.fit(words)
    vocabulary = vectorizer.vocabulary
    if not vocabulary:
        return None
    k = max(2, min(TOPICS, n, len(vocabulary)))
    counted = vectorizer.transform(words).cache()
    model = LDA(k=k, maxIter=10, seed=seed).fit(counted)
    names = F.array(*map(F.lit, vocabulary))
    described = model.describeTopics(top).select(F.col("topic").alias("topic_id"), F.transform("termIndices", lambda i: F.element_at(names, i + 1)).alias("top_terms"), F.col("termWeights").alias("top_weights"))
    mixed = model.transform(counted).select("doc_id", vector_to_array("topicDistribution").alias("mixture"))
    return described, mixed.withColumn("dominant_topic", dominant("mixture")).withColumn("confidence", F.array_max("mixture"))


def topics_by_quarter(docs: DataFrame, seed: int = 42, stop: list[str] | None = None, top: int = 10) -> tuple[DataFrame, DataFrame] | None:
    """(topics, documents) of every quarter of (doc_id, year, quarter, text), with
    year and quarter in both frames, all quarters fitted together; quarters with
    fewer than TOPIC_DOCS texts give none, and None is returned if none gives any."""
    when = docs.dropna(subset=["year", "quarter"]).select(quarter_index("year", "quarter").cast("long").alias("q"), "doc_id", "text")
    if when.groupBy("q").count().filter(F.col("count") >= TOPIC_DOCS).isEmpty():
        return None
    words = [*StopWordsRemover.loadDefaultStopWords("english"), *(stop or [])]
    found = quarterly.fitted(when, TOPICS, seed, TOPIC_DOCS, top, words)
    quarter = F.when(F.col("q") % 4 == 0, 4).otherwise(F.col("q") % 4).cast("int")
    return tuple(df.select(((F.col("q") - quarter) / 4).cast("int").alias("year"), quarter.alias("quarter"), *[c for c in df.columns if c != "q"]) for df in found)


def principal(df: DataFrame, column: str, k: int = 2) -> DataFrame:
    """Add ``pca``, the k first principal components of an array column."""
    v = df.withColumn("_v", array_to_vector(F.col(column).cast("array<double>")))
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(v).transform(v).withColumn("pca", vector_to_array("_p")).drop("_v", "_p")
