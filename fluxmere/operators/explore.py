"""Data exploration: tests, decomposition and models that are fitted for one answer."""

from __future__ import annotations

import math

from pyspark.ml.classification import DecisionTreeClassifier, LogisticRegression, NaiveBayes
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import INTERNAL, EngineError
from .base import Operator, columns_of, dealt, number, require


def upper_gamma(s: float, x: float) -> float:
    """The regularized upper incomplete gamma function, by series below s + 1 and by continued fraction above."""
    if x <= 0:
        return 1.0
    lead = math.exp(-x + s * math.log(x) - math.lgamma(s))
    if x < s + 1:
        term = total = 1 / s
        k = s
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * lead)
    tiny = 1e-300
    b = x + 1 - s
    c, d = 1 / tiny, 1 / b
    h = d
    for k in range(1, 10_000):
        a = -k * (k - s)
        b += 2
        d = 1 / (a * d + b or tiny)
        c = b + a / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return lead * h


def chisquare(frames: list[DataFrame], params: dict[str, str]) -> DataFrame:
    """statistic, p_value, dof, significant for the contingency of two columns (the first two, or `columns`).

    Cells are counted in one aggregate and stay distributed; the statistic is n * (sum of cell^2 / (row * column) - 1).
    A 2 by 2 table gets Yates' correction unless `correction` is false. Rows with a null don't count.
    """
    df = frames[0]
    names = columns_of(df, params, numeric=False)[:2]
    if len(names) < 2:
        return df.sparkSession.createDataFrame([("chisquare requires at least 2 columns",)], "error string")
    alpha = number(params, "threshold", 0.05)
    cells = df.select(F.col(f"`{names[0]}`").alias("a"), F.col(f"`{names[1]}`").alias("b")).where("a is not null and b is not null").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).persist()
    rows, columns = (cells.groupBy(k).agg(F.sum("n").alias(f"n_{k}")) for k in "ab")
    total, kinds_a, kinds_b = cells.agg(F.sum("n"), F.count_distinct("a"), F.count_distinct("b")).first()
    if not total or kinds_a < 2 or kinds_b < 2:
        return df.sparkSession.createDataFrame([(0.0, 1.0, 0, False)], "statistic double, p_value double, dof int, significant boolean")
    if kinds_a == kinds_b == 2 and params.get("correction", "true").lower() != "false":
        sides = {(r.a, r.b): r.n for r in cells.collect()}  # four cells at most
        a, b = sorted({k[0] for k in sides}, key=str), sorted({k[1] for k in sides}, key=str)
        t = [[sides.get((x, y), 0) for y in b] for x in a]
        expected = [[sum(t[i]) * (t[0][j] + t[1][j]) / total for j in (0, 1)] for i in (0, 1)]
        statistic = sum((abs(t[i][j] - expected[i][j]) - min(0.5, abs(t[i][j] - expected[i][j]))) ** 2 / expected[i][j] for i in (0, 1) for j in (0, 1))
    else:
        share = cells.join(rows, "a").join(columns, "b").agg(F.sum(F.col("n") * F.col("n") / (F.col("n_a") * F.col("n_b")))).first()[0]
        statistic = total * (share - 1)
    cells.unpersist()
    dof = (kinds_a - 1) * (kinds_b - 1)
    p = upper_gamma(dof / 2, statistic / 2)
    return df.sparkSession.createDataFrame([(float(statistic), p, dof, p < alpha)], "statistic double, p_value double, dof int, significant boolean")


def _features(df: DataFrame, params: dict[str, str], label: str | None = None) -> tuple[DataFrame, list[str]]:
    names = [c for c in columns_of(df, params) if c != label]
    if not names:
        raise EngineError("no numeric column", INTERNAL)
    casts = df.select("*", *(F.col(f"`{c}`").cast("double").alias(f"_f{k}") for k, c in enumerate(names))).dropna(subset=[f"_f{k}" for k in range(len(names))])
    return VectorAssembler(inputCols=[f"_f{k}" for k in range(len(names))], outputCol="_features").transform(casts), names


def _label(df: DataFrame, params: dict[str, str]) -> str:
    label = params.get("label") or params.get("target")
    if not label:
        raise EngineError("label is required", INTERNAL)
    return require(df, label)


def pca(frames: list[DataFrame], params: dict[str, str]) -> DataFrame:
    """component, variance (its share), and loadings (column to weight) of the standardized columns; `k` components."""
    data, names = _features(frames[0], params)
    k = min(len(names), int(number(params, "k", len(names))))
    scaled = StandardScaler(inputCol="_features", outputCol="_scaled", withMean=True).fit(data).transform(data)
    model = PCA(k=k, inputCol="_scaled", outputCol="_pc").fit(scaled)
    weights = model.pc.toArray()
    rows = [(i + 1, float(model.explainedVariance[i]), {n: float(weights[j][i]) for j, n in enumerate(names)}) for i in range(k)]
    return frames[0].sparkSession.createDataFrame(rows, "component int, variance double, loadings map<string,double>")


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularized incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return min(1.0, max(0.0, x))
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    lead = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    h = d
    for k in range(1, 1000):
        for top in (k * (b - k) * x / ((a + 2 * k - 1) * (a + 2 * k)), -(a + k) * (a + b + k) * x / ((a + 2 * k) * (a + 2 * k + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            h *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return lead * h


def anova(frames: list[DataFrame], params: dict[str, str]) -> DataFrame:
    """column_name, f_value, p_value, dof_between, dof_within: one-way analysis of variance of each column by the label.

    Means and counts of the groups come from one aggregate, sums over groups from another; rows with a null don't count.
    """
    df, label = frames[0], _label(frames[0], params)
    names = [c for c in columns_of(df, params) if c != label]
    long = df.select(F.col(f"`{label}`").alias("g"), F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").alias("x")) for c in names))).alias("r")).select("g", "r.*").where("g is not null and x is not null")
    groups = long.groupBy("column_name", "g").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), F.var_pop("x").alias("v"))
    sums = groups.groupBy("column_name").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("s"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("q"), F.sum(F.col("n") * F.col("v")).alias("within"))
    rows = []
    for r in sums.collect():  # a row for each column
        between, d1, d2 = max(0.0, r.q - r.s * r.s / r.n), r.k - 1, r.n - r.k
        f = (between / d1) / (r.within / d2) if d1 > 0 and d2 > 0 and r.within > 0 else float("nan")
        rows.append((r.column_name, f, incomplete_beta(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)) if f == f else float("nan"), d1, d2))
    return df.sparkSession.createDataFrame(rows, "column_name string, f_value double, p_value double, dof_between bigint, dof_within bigint")


def regression(frames: list[DataFrame], params: dict[str, str]) -> DataFrame:
    """term and coefficient of a linear regression on the label, with the intercept and r2 as terms."""
    label = _label(frames[0], params)
    data, names = _features(frames[0], params, label)
    model = LinearRegression(featuresCol="_features", labelCol="_label", regParam=number(params, "reg", 0)).fit(data.withColumn("_label", F.col(f"`{label}`").cast("double")).dropna(subset=["_label"]))
    rows = [("intercept", float(model.intercept)), *zip(names, map(float, model.coefficients), strict=True), ("r2", float(model.summary.r2))]
    return frames[0].sparkSession.createDataFrame(rows, "term string, coefficient double")


def _classified(frames: list[DataFrame], params: dict[str, str], estimator, keeps: bool = False) -> tuple[DataFrame, object, list[str], list[str]]:
    """keeps: whether the estimator holds every row as an object of its own."""
    label = _label(frames[0], params)
    data, names = _features(frames[0], params, label)
    data = data.withColumn("_label_text", F.col(f"`{label}`").cast("string")).where("_label_text is not null")
    index = StringIndexer(inputCol="_label_text", outputCol="_label").fit(data)
    fed = index.transform(data)
    fitted = estimator.fit(dealt(fed.select("_features", "_label"), data.count(), len(names)) if keeps else fed)
    return fitted.transform(index.transform(data)), fitted, names, index.labels


def _accuracy(scored: DataFrame) -> float:
    return MulticlassClassificationEvaluator(labelCol="_label", predictionCol="prediction", metricName="accuracy").evaluate(scored)


def logit(frames: list[DataFrame], params: dict[str, str]) -> DataFrame:
    """class, term, coefficient of a logistic regression, with accuracy as a term of class null."""
    scored, model, names, labels = _classified(frames, params, LogisticRegression(featuresCol="_features", labelCol="_label", regParam=number(params, "reg", 0.01)))
    matrix, intercepts = model.coefficientMatrix.toArray(), model.interceptVector.toArray()
    classes = labels if len(matrix) > 1 else labels[1:2]
    rows = [(c, t, float(v)) for i, c in enumerate(classes) for t, v in [("intercept", intercepts[i]), *zip(names, matrix[i], strict=True)]]
    return frames[0].sparkSession.createDataFrame([*rows, (None, "accuracy", _accuracy(scored))], "class string, term string, coefficient double")


def decisiontree(frames: list[DataFrame], params: dict[str, str]) -> DataFrame:
    """term and value: the importance of each column, accuracy, depth and nodes of a decision tree; `depth` 5."""
    scored, model, names, _ = _classified(frames, params, DecisionTreeClassifier(featuresCol="_features", labelCol="_label", maxDepth=int(number(params, "depth", 5))), keeps=True)
    rows = [*zip(names, map(float, model.featureImportances.toArray()), strict=True), ("accuracy", _accuracy(scored)), ("depth", float(model.depth)), ("nodes", float(model.numNodes))]
    return frames[0].sparkSession.createDataFrame(rows, "term string, value double")


def naivebayes(frames: list[DataFrame], params: dict[str, str]) -> DataFrame:
    """The rows with prediction and probability by Gaussian naive Bayes."""
    scored, _, _, labels = _classified(frames, params, NaiveBayes(featuresCol="_features", labelCol="_label", modelType="gaussian"))
    named = F.get(F.array(*map(F.lit, labels)), F.col("prediction").cast("int"))
    return scored.select(*(f"`{c}`" for c in frames[0].columns), named.alias("predicted"), F.array_max(vector_to_array("probability")).alias("predicted_probability"))


OPERATORS = [
    Operator("explore", "chisquare", chisquare, "chi-square test of independence"),
    Operator("explore", "pca", pca, "principal components"),
    Operator("explore", "anova", anova, "analysis of variance"),
    Operator("explore", "regression", regression, "linear regression"),
    Operator("explore", "logit", logit, "logistic regression"),
    Operator("explore", "decisiontree", decisiontree, "decision tree"),
    Operator("explore", "naivebayes", naivebayes, "Gaussian naive Bayes"),
]
