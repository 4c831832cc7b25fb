"""Statistics over Spark aggregates; only k x k sums reach the driver."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnlake.operators.effects import absorb, absorbed_ols, absorbed_poisson
from turnlake.operators.ordered import laid, running
from turnlake.operators.ranks import kendall
from turnlake.sources.scratch import Steps


def _sums(df: DataFrame, x: list[str], y: str) -> tuple[np.ndarray, np.ndarray, int]:
    """X'X, X'y and n, with a constant first."""
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in x]]
    k = len(cols)
    parts = [F.sum(cols[i] * cols[j]).alias(f"a{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(c * F.col(y)).alias(f"b{i}") for i, c in enumerate(cols)]
    row = df.dropna(subset=[*x, y]).agg(F.count("*").alias("n"), *parts).first()
    a = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            a[i, j] = a[j, i] = row[f"a{i}_{j}"] or 0.0
    return a, np.array([row[f"b{i}"] or 0.0 for i in range(k)]), row["n"]


def ols_hc1(df: DataFrame, x: list[str], y: str) -> list[dict]:
    """Coefficients with heteroscedasticity-robust (HC1) errors, z and p: two
    passes, the second for the squared residuals."""
    a, b, n = _sums(df, x, y)
    k = len(b)
    inverse = np.linalg.pinv(a)
    beta = inverse @ b
    cols = [F.lit(1.0), *[F.col(c).cast("double") for c in x]]
    fitted = sum((c * float(v) for c, v in zip(cols, beta, strict=True)), F.lit(0.0))
    e2 = (F.col(y) - fitted) * (F.col(y) - fitted)
    row = df.dropna(subset=[*x, y]).agg(*[F.sum(cols[i] * cols[j] * e2).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)]).first()
    meat = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            meat[i, j] = meat[j, i] = row[f"m{i}_{j}"] or 0.0
    cov = inverse @ meat @ inverse * n / max(n - k, 1)
    return _terms(["Intercept", *x], beta, cov, n)


def demeaned(df: DataFrame, columns: list[str], groups: list[str]) -> DataFrame:
    """Remove what one or more groupings (fixed effects) explain of columns."""
    return absorb(df, columns, groups)


#: Levels of all effects together whose dummies have coefficients of their own;
#: their normal matrix is solved on the driver.
LEVELS = 4_000


class TooManyLevels(ValueError):
    """The effects have to be absorbed."""


class _Dummies:
    """Sums over regressors and the dummies of effects, by grouping rather than
    by one expression for each pair: only cells that hold rows are returned."""

    def __init__(self, rows: DataFrame, x: list[str], effects: list[str]):
        self.x, self.effects = ["Intercept", *x], effects
        self.columns = [F.lit(1.0), *[F.col(c).cast("double") for c in x]]
        self.levels, self.names = {}, list(self.x)
        for g in effects:
            found = sorted(r[0] for r in rows.select(F.col(g).cast("string")).distinct().limit(LEVELS + 1).collect())[1:]
            self.levels[g] = {v: len(self.names) + i for i, v in enumerate(found)}
            self.names += [f"{g}[{v}]" for v in found]
        if len(self.names) > LEVELS:
            raise TooManyLevels(f"more than {LEVELS} levels")

    def products(self, rows: DataFrame, weight: Column) -> np.ndarray:
        """D'WD of the design D with a weight for each row."""
        k, m = len(self.names), len(self.x)
        out = np.zeros((k, k))
        pairs = [(i, j) for i in range(m) for j in range(i, m)]
        row = rows.agg(*[F.sum(self.columns[i] * self.columns[j] * weight) for i, j in pairs]).first()
        for (i, j), v in zip(pairs, row, strict=True):
            out[i, j] = out[j, i] = v or 0.0
        for a, g in enumerate(self.effects):
            for r in rows.groupBy(F.col(g).cast("string")).agg(*[F.sum(c * weight) for c in self.columns]).collect():
                if (at := self.levels[g].get(r[0])) is not None:
                    out[at, :m] = out[:m, at] = r[1:]
                    out[at, at] = r[1]
            for h in self.effects[a + 1 :]:
                for r in rows.groupBy(F.col(g).cast("string"), F.col(h).cast("string")).agg(F.sum(weight)).collect():
                    i, j = self.levels[g].get(r[0]), self.levels[h].get(r[1])
                    if i is not None and j is not None:
                        out[i, j] = out[j, i] = r[2]
        return out

    def sums(self, rows: DataFrame, value: Column) -> np.ndarray:
        """D'v."""
        out = np.zeros(len(self.names))
        out[: len(self.x)] = [v or 0.0 for v in rows.agg(*[F.sum(c * value) for c in self.columns]).first()]
        for g in self.effects:
            for r in rows.groupBy(F.col(g).cast("string")).agg(F.sum(value)).collect():
                if (at := self.levels[g].get(r[0])) is not None:
                    out[at] = r[1]
        return out

    def fitted(self, rows: DataFrame, beta: np.ndarray) -> DataFrame:
        """Add ``_fitted``; the levels' coefficients are joined, at most LEVELS."""
        total = sum((c * float(b) for c, b in zip(self.columns, beta, strict=False)), F.lit(0.0))
        for i, g in enumerate(self.effects):
            known = rows.sparkSession.createDataFrame([(v, float(beta[at])) for v, at in self.levels[g].items()], f"_g{i} string, _b{i} double")
            rows = rows.join(F.broadcast(known), F.col(g).cast("string") == F.col(f"_g{i}"), "left")
            total = total + F.coalesce(f"_b{i}", F.lit(0.0))
        return rows.withColumn("_fitted", total).drop(*[f"_{c}{i}" for c in "gb" for i in range(len(self.effects))])


def _terms(names: list[str], beta: np.ndarray, cov: np.ndarray, n: int) -> list[dict]:
    out = []
    for name, v, s in zip(names, beta, np.sqrt(np.maximum(np.diag(cov), 0)), strict=True):
        z = v / s if s > 0 else 0.0
        out.append({"term": name, "coef": float(v), "std_err": float(s), "z": float(z), "p": math.erfc(abs(z) / math.sqrt(2)), "n": n})
    return out


def fixed_effects(df: DataFrame, x: list[str], y: str, effects: list[str], least: int = 400, dummies: bool = False) -> list[dict]:
    """OLS with dummies of the effects and HC1 errors, on complete rows; none
    below ``least``.  With ``dummies`` their coefficients are returned as well, an
    error beyond LEVELS.  Else more levels are absorbed: the coefficients are the
    same, but there is no intercept."""
    rows = df.dropna(subset=[*x, y, *effects])
    n = rows.count()
    if n < least:
        return []
    try:
        design = _Dummies(rows, x, effects)
    except TooManyLevels:
        if dummies:
            raise
        return absorbed_ols(rows, x, y, effects, least)
    inverse = np.linalg.pinv(design.products(rows, F.lit(1.0)))
    beta = inverse @ design.sums(rows, F.col(y).cast("double"))
    error = F.col(y) - F.col("_fitted")
    cov = inverse @ design.products(design.fitted(rows, beta), error * error) @ inverse * n / max(n - len(beta), 1)
    out = _terms(design.names, beta, cov, n)
    return out if dummies else out[: len(x) + 1]


def poisson(df: DataFrame, x: list[str], y: str, steps: int = 25, effects: list[str] | None = None, least: int = 1) -> list[dict]:
    """Poisson regression by reweighted least squares, HC1 errors, with dummies
    of ``effects`` if there are any; none below ``least`` complete rows.  More
    than LEVELS levels are absorbed, without an intercept."""
    effects = effects or []
    rows = df.dropna(subset=[*x, y, *effects])
    n, total = rows.agg(F.count("*"), F.sum(y)).first()
    if n < least or not total:
        return []
    try:
        design = _Dummies(rows, x, effects)
    except TooManyLevels:
        return absorbed_poisson(rows, x, y, effects, least)
    beta = np.zeros(len(design.names))
    beta[0] = math.log(total / n)
    for _ in range(steps + 1):
        now = design.fitted(rows, beta)
        mu, e = F.exp("_fitted"), F.col(y) - F.exp("_fitted")
        inverse = np.linalg.pinv(design.products(now, mu))
        step = inverse @ design.sums(now, e)
        if np.abs(step).max() < 1e-9:
            break
        beta = beta + step
    cov = inverse @ design.products(now, e * e) @ inverse * n / max(n - len(beta), 1)
    return _terms(design.names, beta, cov, n)[: len(x) + 1]


def kendall_tau(pairs: DataFrame, a: str, b: str) -> float:
    """Tau-b, 0.0 where it isn't defined."""
    return kendall(pairs, a, b)["tau"]


def _dealt(sizes: list[tuple[int, int]], k: int) -> list[tuple[int, int, int, int, int]]:
    """(size, first rank, last rank, stride, fold): which groups of each size go
    where if the largest go first, always to the lightest fold, of (size, how many
    groups have it).

    Folds that lie less than a size apart are filled in rounds of one order until
    the next fold is reached, so a class has at most some k * k lines.
    """
    load, out = [0] * k, []
    for size, many in sorted(sizes, reverse=True):
        at = 0
        while at < many:
            order = sorted(range(k), key=lambda i: (load[i], i))
            low = [i for i in order if load[i] - load[order[0]] < size]
            m, top = len(low), max(load[i] for i in low)
            rounds = (many - at) // m
            if m < k:
                rounds = min(rounds, -(-(load[order[m]] - top) // size))
            for i, fold in enumerate(low if rounds else low[: many - at]):
                turns = max(rounds, 1)
                out.append((size, at + i, at + i + (turns - 1) * m, m, fold))
                load[fold] += turns * size
            at += rounds * m or many - at
    return out


def group_folds(df: DataFrame, group: str, k: int = 5) -> DataFrame:
    """Add ``fold``: no group in two folds, largest groups dealt first to the
    lightest fold.

    The driver sees how many groups have each size, and lists a class of equal
    sizes only until it goes round; a group finds its fold by size and by its
    rank among groups of its size.  Rows without a group go.
    """
    sizes = Steps(df.sparkSession).stored(df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("_size")), "sizes")
    classes = [(r[0], r[1]) for r in sizes.groupBy("_size").count().collect()]  # distinct sizes: at most the root of twice the rows
    table = df.sparkSession.createDataFrame(_dealt(classes, k), "_of long, _from long, _to long, _stride long, fold int")
    ranked = running(laid(sizes.withColumn("_down", -F.col("_size")), ["_down", group]), ["_down", group], {"r": F.lit(1)})
    larger, before = [], 0
    for size, many in sorted(classes, reverse=True):
        larger.append((size, before))
        before += many
    offsets = df.sparkSession.createDataFrame(larger, "_size long, _larger long")
    own = ranked.join(offsets, "_size").withColumn("_rank", F.col("_r_before") - F.col("_larger"))
    hit = (F.col("_size") == F.col("_of")) & F.col("_rank").between(F.col("_from"), F.col("_to")) & ((F.col("_rank") - F.col("_from")) % F.col("_stride") == 0)
    folds = own.join(table, hit).select(group, "fold")
    return df.join(folds, group)


def hash_folds(df: DataFrame, key: str, k: int = 5, seed: int = 0, stratum: str | None = None) -> DataFrame:
    """Folds of near equal size, by stratum if there is one, in hash order."""
    order = [*([stratum] if stratum else []), "_h", key]
    dealt = running(laid(df.withColumn("_h", F.xxhash64(key, F.lit(seed))), order), order, {"r": F.lit(1)})
    # Rows of a stratum follow each other, so dealing them in turn is even in each.
    return dealt.withColumn("fold", F.pmod("_r_before", F.lit(k)).cast("int")).drop("_h", "_r_before", "_r_all")


def classification_metrics(df: DataFrame, label: str, score: str, cut: float = 0.5) -> DataFrame:
    """accuracy, precision, recall, f1 at a cut; 0.0 where a divisor is 0."""
    y, p = F.col(label) == 1, F.col(score) >= cut
    c = df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    return c.select("tp", "fp", "fn", "tn", ratio(tp + tn, tp + fp + fn + tn).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"))


def roc_auc(df: DataFrame, label: str, score: str, one_class: float | None = 0.5) -> DataFrame:
    """(auc): the mean-rank statistic, over counts by distinct score."""
    s = df.dropna(subset=[label, score]).groupBy(score).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n"))
    below = running(laid(s, [score]), [score], {"n": F.col("n")})
    auc = F.try_divide(F.sum(F.col("p") * (F.col("_n_before") + F.col("n") / 2)), (F.sum("p") * F.sum("n")).cast("double"))
    return below.agg(F.coalesce(auc, F.lit(one_class).cast("double")).alias("auc"))


def roc_curve(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, tpr, fpr) at each distinct score, descending."""
    s = df.dropna(subset=[label, score]).groupBy(F.col(score).alias("threshold")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) != 1).alias("n"))
    below = running(laid(s, ["threshold"]), ["threshold"], {"p": F.col("p"), "n": F.col("n")})
    rate = lambda c: F.coalesce(F.try_divide((F.col(f"_{c}_all") - F.col(f"_{c}_before")).cast("double"), F.col(f"_{c}_all").cast("double")), F.lit(0.0))
    return below.select("threshold", rate("p").alias("tpr"), rate("n").alias("fpr"))


def regression_metrics(df: DataFrame, y: str, p: str) -> DataFrame:
    e = F.col(y) - F.col(p)
    return df.dropna(subset=[y, p]).agg(F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - F.try_divide(F.sum(e * e), F.var_pop(y) * F.count("*"))).alias("r2"))


def confusion(df: DataFrame, truth: str, guess: str, labels: list[str]) -> DataFrame:
    """(truth, guess, n, row_share) over a fixed list of labels."""
    spark = df.sparkSession
    grid = spark.createDataFrame([(a, b) for a in labels for b in labels], f"`{truth}` string, `{guess}` string")
    n = df.dropna(subset=[truth, guess]).groupBy(F.col(truth).cast("string").alias(truth), F.col(guess).cast("string").alias(guess)).agg(F.count("*").alias("n"))
    full = grid.join(n, [truth, guess], "left").fillna(0, ["n"])
    return full.withColumn("row_share", F.coalesce(F.try_divide(F.col("n").cast("double"), F.sum("n").over(Window.partitionBy(truth)).cast("double")), F.lit(0.0)))


def per_class(df: DataFrame, truth: str, guess: str, labels: list[str]) -> DataFrame:
    """(label, precision, recall, f1, support); the mean of f1 is macro-F1."""
    c = confusion(df, truth, guess, labels)
    hit = F.sum(F.when(F.col(truth) == F.col(guess), F.col("n")).otherwise(0))
    rows = c.groupBy(F.col(truth).alias("label")).agg(hit.alias("tp"), F.sum("n").alias("support"))
    cols = c.groupBy(F.col(guess).alias("label")).agg(F.sum("n").alias("predicted"))
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    return rows.join(cols, "label").select("label", ratio(F.col("tp"), F.col("predicted")).alias("precision"), ratio(F.col("tp"), F.col("support")).alias("recall"), ratio(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"), "support")


def macro_f1(df: DataFrame, truth: str, guess: str, labels: list[str]) -> DataFrame:
    """(macro_f1): the mean of f1 over a fixed list of labels."""
    return per_class(df, truth, guess, labels).agg(F.avg("f1").alias("macro_f1"))


def agreements(df: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(a, b, n, agreement, kappa) of each pair of annotator columns; a row counts
    for a pair if both filled it."""
    out = [agreement(df, a, b).select(F.lit(a).alias("a"), F.lit(b).alias("b"), "n", "agreement", "kappa") for a, b in pairs]
    for more in out[1:]:
        out[0] = out[0].unionByName(more)
    return out[0]


def agreement(df: DataFrame, a: str, b: str) -> DataFrame:
    """(n, agreement, kappa) of rows that both annotators filled; kappa is
    missing where chance agreement is 1."""
    c = df.dropna(subset=[a, b]).groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    rows = c.groupBy(F.col("a").alias("l")).agg(F.sum("n").alias("ra"))
    cols = c.groupBy(F.col("b").alias("l")).agg(F.sum("n").alias("rb"))
    chance = rows.join(cols, "l").agg(F.coalesce(F.sum(F.col("ra") * F.col("rb")), F.lit(0)).alias("both"))
    total = c.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("a") == F.col("b"), F.col("n"))), F.lit(0)).alias("same"))
    po, pe = F.try_divide(F.col("same").cast("double"), F.col("n").cast("double")), F.try_divide(F.col("both").cast("double"), (F.col("n") * F.col("n")).cast("double"))
    return total.crossJoin(chance).select("n", po.alias("agreement"), F.when(pe < 1, (po - pe) / (1 - pe)).alias("kappa"))  # one row each


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_fraction(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    f = c = 1.0
    d = 0.0
    for i in range(300):
        m = i // 2
        t = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + t * d or 1e-300)
        c = 1 + t / c or 1e-300
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def welch_t(df: DataFrame, group: str, value: str, first: str, second: str) -> dict:
    """Unequal-variance t test of two groups."""
    s = {r["g"]: r for r in df.dropna(subset=[value]).filter(F.col(group).isin(first, second)).groupBy(F.col(group).alias("g")).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count("*").alias("n")).collect()}
    if len(s) < 2 or any(r["n"] < 2 for r in s.values()):
        return {"t": None, "df": None, "p": None}
    a, b = s[first], s[second]
    va, vb = a["v"] / a["n"], b["v"] / b["n"]
    if va + vb == 0:
        return {"t": None, "df": None, "p": None}
    t, dof = (a["m"] - b["m"]) / math.sqrt(va + vb), (va + vb) ** 2 / (va**2 / (a["n"] - 1) + vb**2 / (b["n"] - 1))
    return {"t": t, "df": dof, "p": _beta_fraction(dof / 2, 0.5, dof / (dof + t * t))}


def anova(df: DataFrame, group: str, value: str) -> dict:
    """One-way analysis of variance."""
    s = df.dropna(subset=[group, value]).groupBy(group).agg(F.avg(value).alias("m"), F.coalesce(F.var_samp(value), F.lit(0.0)).alias("v"), F.count("*").alias("n")).collect()
    k, n = len(s), sum(r["n"] for r in s)
    if k < 2 or n <= k:
        return {"f": None, "df1": None, "df2": None, "p": None}
    mean = sum(r["m"] * r["n"] for r in s) / n
    between, within = sum(r["n"] * (r["m"] - mean) ** 2 for r in s), sum(r["v"] * (r["n"] - 1) for r in s)
    if within == 0:
        return {"f": None, "df1": k - 1, "df2": n - k, "p": None}
    f = between / (k - 1) / (within / (n - k))
    return {"f": f, "df1": k - 1, "df2": n - k, "p": _beta_fraction((n - k) / 2, (k - 1) / 2, (n - k) / (n - k + (k - 1) * f))}


def attrition(df: DataFrame, steps: dict[str, F.Column]) -> DataFrame:
    """(step, kept, removed): rows left after each condition, all in one pass."""
    held, parts = F.lit(True), []
    for name, condition in steps.items():
        held = held & F.coalesce(condition, F.lit(False))
        parts.append(F.struct(F.lit(name).alias("step"), F.count_if(held).alias("kept"), F.count_if(~held).alias("removed")))
    return df.agg(F.array(*parts).alias("s")).select(F.inline("s"))


def trend_line(df: DataFrame, y: str, x: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def zscored(df: DataFrame, columns: list[str]) -> DataFrame:
    facts = F.broadcast(df.agg(*[e for c in columns for e in (F.avg(c).alias(f"_m_{c}"), F.stddev_samp(c).alias(f"_s_{c}"))]))  # one row
    out = df.crossJoin(facts)
    for c in columns:
        out = out.withColumn(c, F.try_divide(F.col(c) - F.col(f"_m_{c}"), F.col(f"_s_{c}")))
    return out.select(*df.columns)
