"""Statistics and models whose results SQL can tell: closed forms, and labels that a model must separate."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..engine import Engine
from ..session import shared_folder
from .catalog import engine_over, query

LABELLED = "SELECT l_linenumber, CASE WHEN l_linenumber > 3 THEN 'high' ELSE 'low' END AS kind FROM tpch.lineitem"


@query("SELECT * FROM (VALUES ('l_linenumber', 1.0), ('accuracy', 1.0), ('depth', 1.0), ('nodes', 3.0)) AS t(term, value)".replace("1.0", "cast(1 AS double)").replace("3.0", "cast(3 AS double)"))
def decisiontree_separable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One cut separates the labels, so the tree has one, and nothing is left to tell."""
    return engine_over(spark, sf_dir).execute(f"{LABELLED} USING explore.decisiontree WITH depth=4 LABEL kind").df


@query("SELECT 'accuracy' AS term, cast(1 AS double) AS value, true AS rises")
def logit_separable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy, and whether the line number speaks for the higher label."""
    found = engine_over(spark, sf_dir).execute(f"{LABELLED} USING explore.logit LABEL kind").df
    slope = found.where("term = 'l_linenumber'").select(F.when(F.col("class") == "high", F.col("coefficient")).otherwise(-F.col("coefficient")).alias("slope"))
    return found.where("term = 'accuracy'").join(F.broadcast(slope)).select("term", F.col("coefficient").alias("value"), (F.col("slope") > 0).alias("rises"))  # one row


@query(
    "WITH d AS (SELECT l_linenumber AS x, CASE WHEN l_linenumber > 3 THEN 'high' ELSE 'low' END AS kind FROM lineitem), c AS (SELECT kind, ln(count(*)) AS prior, avg(x) AS m, var_pop(x) AS v FROM d GROUP BY kind), "
    "s AS (SELECT x, c.kind, prior - ln(v) / 2 - (x - m) * (x - m) / (2 * v) AS score FROM (SELECT DISTINCT x FROM d) u, c), p AS (SELECT x, arg_max(kind, score) AS predicted FROM s GROUP BY x) SELECT predicted, count(*) AS n FROM d JOIN p USING (x) GROUP BY predicted"
)
def naivebayes_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of Gaussian naive Bayes, whose form is closed."""
    return engine_over(spark, sf_dir).execute(f"{LABELLED} USING explore.naivebayes LABEL kind").df.groupBy("predicted").agg(F.count(F.lit(1)).alias("n"))


@query("WITH r AS (SELECT corr(l_quantity, l_extendedprice) AS r FROM lineitem) SELECT 1 AS component, round((1 + abs(r)) / 2, 6) AS variance, round(sqrt(0.5), 6) AS size FROM r UNION ALL SELECT 2 AS component, round((1 - abs(r)) / 2, 6) AS variance, round(sqrt(0.5), 6) AS size FROM r")
def pca_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of two standardized columns the components are their sum and difference, with 1 + r and 1 - r of the variance."""
    found = engine_over(spark, sf_dir).execute("SELECT l_quantity, l_extendedprice FROM tpch.lineitem USING explore.pca").df
    return found.select("component", F.round("variance", 6).alias("variance"), F.round(F.abs(F.col("loadings")["l_quantity"]), 6).alias("size"))


@query(" UNION ALL ".join(f"SELECT 'l_quantity' AS column_name, cast({q} AS double) AS q, quantile_disc(l_quantity, {q}) AS value FROM lineitem" for q in (0.25, 0.5, 0.9)))
def statistic_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine_over(spark, sf_dir).execute("SELECT l_quantity FROM tpch.lineitem USING statistic.quantiles WITH probabilities='0.25;0.5;0.9'").df


@query(" UNION ALL ".join(f"SELECT '{n}' AS statistic, round(cast({f} AS double), 4) AS l_quantity FROM lineitem" for n, f in (("count", "count(l_quantity)"), ("mean", "avg(l_quantity)"), ("stddev", "stddev(l_quantity)"), ("min", "min(l_quantity)"), ("max", "max(l_quantity)"))))
def stats_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = engine_over(spark, sf_dir).execute("SELECT l_quantity FROM tpch.lineitem USING stats.summary").df
    return found.select("statistic", F.round(F.col("l_quantity").cast("double"), 4).alias("l_quantity"))


@query("SELECT l_linenumber, CASE WHEN l_linenumber > 3 THEN 'high' ELSE 'low' END AS prediction, count(*) AS n FROM lineitem GROUP BY 1, 2")
def model_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A forest that is trained, kept as a version, loaded and used on rows without the label."""
    engine = Engine(spark, folder=f"{shared_folder(spark)}/models-{uuid.uuid4().hex}")
    engine.files("tpch.lineitem", f"{sf_dir}/lineitem.parquet")
    engine.execute(f"{LABELLED} USING model.train WITH name=lines, algorithm=random_forest, trees=3 LABEL kind")
    found = engine.execute("SELECT l_linenumber FROM tpch.lineitem USING model.predict WITH name=lines").df
    return found.groupBy("l_linenumber", "prediction").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'accuracy' AS metric, cast(1 AS double) AS value UNION ALL SELECT 'f1', cast(1 AS double)")
def model_evaluate(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, folder=f"{shared_folder(spark)}/models-{uuid.uuid4().hex}")
    engine.files("tpch.lineitem", f"{sf_dir}/lineitem.parquet")
    engine.execute(f"{LABELLED} USING model.train WITH name=lines, algorithm=gbt, trees=2 LABEL kind")
    return engine.execute(f"{LABELLED} USING model.evaluate WITH name=lines").df
