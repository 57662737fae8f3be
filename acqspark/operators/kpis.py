"""Campaign KPIs, next-day forecast and the high-ROAS classifier (the
notebook part of the source), as distributed aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import adjusted_revenue, safe_ratio
from ..sources.buckets import with_midpoint

CAMPAIGN_KEYS = ["platform", "campaign_name", "network_name"]
# The ROAS label threshold, the constant conversion rate, and
# the origin of the date axis of the forecast regression.
HIGH_ROAS_THRESHOLD = 0.3
CONVERSION_RATE = 100
FORECAST_ORIGIN = "2024-01-01"


def revenue_midpoint(users: DataFrame, buckets: DataFrame) -> DataFrame:
    """revenue_est: opt-out iOS installs get the midpoint of their bucket,
    everyone else revenue_usd; missing values become 0. The bucket table has a
    fixed 64 rows, so broadcasting it is safe at any scale."""
    j = users.join(F.broadcast(with_midpoint(buckets)), "cv_bucket", "left")
    return j.select(
        "src_id", "adid", "platform", "install_date", "campaign_name", "network_name",
        adjusted_revenue("midpoint", midpoint="revenue_est_bucket").alias("revenue_est"),
    )


def spend_by_campaign(spend: DataFrame) -> DataFrame:
    return spend.groupBy(*CAMPAIGN_KEYS).agg(F.sum("spend").alias("total_spend"))


def kpi_campaign(rev: DataFrame, spend: DataFrame) -> DataFrame:
    """Per platform x campaign x network: revenue, distinct users, spend (left
    join from the user side, as the notebook merge), ROAS, ARPU, label.
    ROAS is NULL without positive spend, and a NULL ROAS is labelled 0."""
    users = rev.groupBy(*CAMPAIGN_KEYS).agg(
        F.sum("revenue_est").alias("total_revenue"),
        F.count_distinct("adid").alias("total_users"))
    j = users.join(spend_by_campaign(spend), CAMPAIGN_KEYS, "left")
    roas = F.when(F.col("total_spend") > 0, F.col("total_revenue") / F.col("total_spend"))
    return j.select(
        *CAMPAIGN_KEYS, "total_revenue", "total_users", "total_spend",
        F.lit(CONVERSION_RATE).alias("conversion_rate"),
        roas.alias("roas"),
        safe_ratio("total_revenue", "total_users", None).alias("arpu"),
        F.coalesce(roas > HIGH_ROAS_THRESHOLD, F.lit(False)).cast("int").alias("high_roas"),
    )


def daily_revenue_series(rev: DataFrame) -> DataFrame:
    return (rev.groupBy("platform", "campaign_name", "install_date")
            .agg(F.sum("revenue_est").alias("revenue_est")))


def revenue_forecast(rev: DataFrame) -> DataFrame:
    """Next-day revenue per platform x campaign: least squares of daily revenue
    on the day number, evaluated one day after the last day; a one-day series
    forecasts its own value. One aggregation (regr_* are partial aggregates)
    instead of a driver loop over groups."""
    daily = daily_revenue_series(rev).withColumn(
        "x", F.datediff("install_date", F.lit(FORECAST_ORIGIN).cast("date")).cast("double"))
    g = daily.groupBy("platform", "campaign_name").agg(
        F.count("*").alias("n"),
        F.regr_slope("revenue_est", "x").alias("slope"),
        F.regr_intercept("revenue_est", "x").alias("intercept"),
        F.max("x").alias("x_last"),
        F.sum("revenue_est").alias("y_sum"))
    fc = F.when(F.col("n") > 1, F.col("intercept") + F.col("slope") * (F.col("x_last") + 1)).otherwise(F.col("y_sum"))
    return g.select("platform", "campaign_name", fc.alias("forecasted_revenue"))


def kpi_forecast(kpi: DataFrame, forecast: DataFrame) -> DataFrame:
    """Attach the forecast by platform x campaign (it repeats per network)."""
    return kpi.join(forecast, ["platform", "campaign_name"], "left")


def campaign_metrics(kpi_fc: DataFrame, high_roas_prob=None) -> DataFrame:
    """The 12-column campaign metrics table. ``high_roas_prob`` defaults to the
    label itself as a double (a deterministic stand-in for the classifier
    probability, used wherever results are compared across engines); pass
    ``classifier_probability(kpi_fc)`` for the random forest."""
    if high_roas_prob is None:
        df = kpi_fc.withColumn("high_roas_prob", F.col("high_roas").cast("double"))
    else:
        df = kpi_fc.join(high_roas_prob.select(*CAMPAIGN_KEYS, "high_roas_prob"), CAMPAIGN_KEYS, "left")
    return df.select(*CAMPAIGN_KEYS, "total_revenue", "total_users", "conversion_rate", "total_spend",
                     "roas", "arpu", "forecasted_revenue", "high_roas", "high_roas_prob")


# Features are rounded far below a cent, so that the order in which sums were
# added can't move a row across a split of a tree.
FEATURE_DIGITS = 6
FEATURES = {"f_spend": "total_spend", "f_users": "total_users", "f_arpu": "arpu"}
#: Partitions of the training rows; fixed, as the trees' samples depend on them.
TRAINING_PARTS = 8


def _classified(kpi: DataFrame) -> DataFrame:
    return kpi.select(*CAMPAIGN_KEYS, "high_roas", *[F.round(F.col(c).cast("double"), FEATURE_DIGITS).alias(f) for f, c in FEATURES.items()])


def train_classifier(kpi: DataFrame, num_trees: int = 50, seed: int = 1):
    """A pipeline (assembler, random forest) fitted on the rows that have all
    features, in a fixed order: the same rows give the same model. None if
    they hold one class only."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = _classified(kpi).dropna(subset=list(FEATURES)).withColumn("label", F.col("high_roas").cast("double"))
    rows = rows.repartition(TRAINING_PARTS, *CAMPAIGN_KEYS).sortWithinPartitions(*CAMPAIGN_KEYS)
    if rows.agg(F.count_distinct("label")).first()[0] < 2:
        return None
    forest = RandomForestClassifier(numTrees=num_trees, seed=seed, labelCol="label", featuresCol="features")
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), forest]).fit(rows)


def score_classifier(model, kpi: DataFrame) -> DataFrame:
    """P(high ROAS) per campaign with what it rests on: ``model``, ``no spend or
    users`` (a feature is missing; the label stands in) or ``one class`` (there
    was no model to train; likewise)."""
    from pyspark.ml.functions import vector_to_array

    rows, label = _classified(kpi), F.col("high_roas").cast("double")
    if model is None:
        return rows.select(*CAMPAIGN_KEYS, label.alias("high_roas_prob"), F.lit("one class").alias("prob_basis"))
    whole = F.lit(True)
    for f in FEATURES:
        whole = whole & F.col(f).isNotNull()
    rows = rows.withColumn("whole", whole).fillna(0.0, list(FEATURES))
    return model.transform(rows).select(
        *CAMPAIGN_KEYS, F.when(F.col("whole"), vector_to_array("probability")[1]).otherwise(label).alias("high_roas_prob"),
        F.when(F.col("whole"), "model").otherwise("no spend or users").alias("prob_basis"))


def classifier_probability(kpi: DataFrame, num_trees: int = 50, seed: int = 1, path: str | None = None) -> DataFrame:
    """Random forest on (total_spend, total_users, arpu) -> high_roas, scored on
    its training rows. With ``path`` the model stored there is used, or stored
    there after training."""
    from pyspark.ml import PipelineModel

    from ..sources.sinks import table_exists

    if path and table_exists(kpi.sparkSession, path):
        return score_classifier(PipelineModel.load(path), kpi)
    model = train_classifier(kpi, num_trees, seed)
    if path and model is not None:
        model.write().overwrite().save(path)
    return score_classifier(model, kpi)
