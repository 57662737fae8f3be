"""The whole mart as one lazily built object: each table is a DataFrame
derived from the two inputs and ``as_of``. Only the span of days (one aggregate)
is read while a plan is made."""

from __future__ import annotations

import datetime as dt
import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import TableSet, canon_user_data, canon_spend, cv_bucket_table
from ..sources import seeds, sinks
from ..operators import (staging, dims, daily, kpis, performance, budget, attribution, cohorts, seasonality,
                         quality, lineage, reports, incremental)


class Mart:
    """``probability``: "label" (the label as a number, the same in every
    engine) or "model" (the classifier's, trained on the KPI table or read from
    ``model_path``, where it's stored after training)."""

    def __init__(self, spark: SparkSession, user_data: DataFrame, spend: DataFrame,
                 buckets: DataFrame | None = None, as_of=None, block_ids: int = attribution.BLOCK_IDS,
                 probability: str = "label", model_path: str | None = None, materialize: bool = False):
        self.spark = spark
        self.materialize = materialize
        self.user_data = user_data
        self.spend = spend
        self.buckets = buckets if buckets is not None else cv_bucket_table(spark)
        self._as_of = as_of
        self.block_ids = block_ids
        self.probability, self.model_path = probability, model_path
        self._run_id = uuid.uuid4().hex[:12]
        self._written: list[str] = []

    @cached_property
    def span(self) -> tuple:
        """First and last day of both inputs: one aggregate over two date
        columns, run once and passed on as values, so that no model scans the
        inputs for them again and date filters reach the scans."""
        days = self.spend.agg(F.min("date").alias("a"), F.max("date").alias("b")).unionByName(
            self.user_data.agg(F.min("install_date").alias("a"), F.max("install_date").alias("b")))
        return tuple(days.agg(F.min("a"), F.max("b")).first())

    @property
    def as_of(self):
        """"Today": given, or the last day of both inputs."""
        return self._as_of if self._as_of is not None else self.span[1]

    @property
    def calendar_start(self) -> dt.date:
        """The calendar's fixed start, or the first input day where that is earlier."""
        return min(d for d in (dt.date.fromisoformat(dims.DATE_SPINE_START), self.span[0]) if d is not None)

    def _keep(self, df: DataFrame) -> DataFrame:
        """In materialize mode each model that costs an exchange of the inputs is
        computed once (those that only project a stored one are not), written as a
        Parquet table under the cluster's shared checkpoint folder, and read
        back by downstream models, as a warehouse build would. This cuts the
        lineage (a lost executor recomputes from the written table, not from
        the raw inputs)."""
        if not self.materialize:
            return df
        path = sinks.scratch_path(self.spark, f"mart-{self._run_id}", f"t{len(self._written)}")
        sinks.write_table(df, path)
        self._written.append(path)
        return self.spark.read.schema(df.schema).parquet(path)

    @cached_property
    def _stored(self) -> "Mart":
        stored = Mart(self.spark, self.user_data, self.spend, self.buckets, self.as_of, self.block_ids,
                      self.probability, self.model_path, materialize=True)
        stored.span = self.span
        return stored

    def materialized(self) -> "Mart":
        """The same mart with every model materialized once (used where many
        models are read many times: the data tests, ``build``)."""
        return self if self.materialize else self._stored

    @classmethod
    def from_tables(cls, spark: SparkSession, base: str, **kw) -> "Mart":
        t = TableSet(spark, base)
        return cls(spark, canon_user_data(t["events"]), canon_spend(t["orders"]), **kw)

    @classmethod
    def from_csv(cls, spark: SparkSession, folder: str, out: str, **kw) -> "Mart":
        """A mart over ``spend.csv``, ``user_data.csv`` and ``dim_cv_bucket.csv`` of a
        folder, loaded into tables under ``out``; lines that can't be loaded
        stand in ``out``/quarantine."""
        loaded = {kind: seeds.load_csv(spark, kind, f"{folder.rstrip('/')}/{kind}.csv", f"{out.rstrip('/')}/{kind}", f"{out.rstrip('/')}/quarantine")
                  for kind in ("spend", "user_data", "dim_cv_bucket")}
        return cls(spark, loaded["user_data"], loaded["spend"], loaded["dim_cv_bucket"].drop("src_id"), **kw)

    # ------------------------------------------------------------ staging
    @cached_property
    def stg_spend(self):
        return self._keep(staging.stg_spend(self.spend))

    @cached_property
    def stg_user_data(self):
        return self._keep(staging.stg_user_data(self.user_data))

    @property
    def _users(self) -> DataFrame:
        """The installs: the stored staging table where there is one."""
        return self.stg_user_data if self.materialize else self.user_data

    @property
    def _lines(self) -> DataFrame:
        """The spend lines, likewise."""
        return self.stg_spend if self.materialize else self.spend

    # ------------------------------------------------- notebook KPIs (metrics)
    @cached_property
    def revenue_midpoint(self):
        return kpis.revenue_midpoint(self._users, self.buckets)

    @cached_property
    def kpi_campaign(self):
        return kpis.kpi_campaign(self.revenue_midpoint, self._lines)

    @cached_property
    def forecast(self):
        return kpis.revenue_forecast(self.revenue_midpoint)

    @cached_property
    def kpi_forecast(self):
        return kpis.kpi_forecast(self.kpi_campaign, self.forecast)

    @cached_property
    def classifier(self) -> DataFrame:
        """The classifier's probability per campaign and what it rests on."""
        return kpis.classifier_probability(self.kpi_forecast, path=self.model_path)

    @cached_property
    def campaign_metrics(self):
        prob = self.classifier if self.probability == "model" else None
        return self._keep(staging.stg_campaign_metrics(kpis.campaign_metrics(self.kpi_forecast, prob)))

    # --------------------------------------------------------- dimensions
    @cached_property
    def _names(self) -> DataFrame:
        """The names of both inputs: a campaign that has spend but no install
        yet keeps its rows in the daily fact."""
        names = [df.select("platform", "campaign_name", "network_name") for df in (self._users, self._lines)]
        return self._keep(names[0].unionByName(names[1]).distinct())

    @cached_property
    def dim_campaign(self):
        return dims.dim_campaign(self._names)

    @cached_property
    def dim_network(self):
        return dims.dim_network(self._names)

    @cached_property
    def dim_platform(self):
        return dims.dim_platform(self._names)

    @cached_property
    def dim_date(self):
        return dims.dim_date(self.spark, self.as_of, self.calendar_start)

    @property
    def dims(self) -> dict:
        return {"campaign": self.dim_campaign, "network": self.dim_network, "platform": self.dim_platform,
                "date": self.dim_date}

    # ------------------------------------------------------------- daily
    @cached_property
    def daily_spend(self):
        return daily.daily_spend(self.stg_spend)

    @cached_property
    def daily_users(self):
        return daily.daily_users(self.stg_user_data)

    @cached_property
    def spend_user_full_outer(self):
        return daily.spend_user_full_outer(self.daily_spend, self.daily_users)

    @cached_property
    def campaign_daily_named(self):
        if self.materialize:  # the dimensions are stored tables: join them, as the model does
            return daily.campaign_daily_named(self.spend_user_full_outer, self.dim_campaign, self.dim_network,
                                              self.dim_platform, self.dim_date)
        return daily.campaign_daily_by_name(self.spend_user_full_outer, self.dim_date)

    @cached_property
    def campaign_daily(self):
        return self._keep(self.campaign_daily_named.select(*daily.DAILY_COLS))

    @cached_property
    def daily_enriched(self):
        if self.materialize:  # join the stored fact back to the stored dimensions
            return daily.daily_enriched(self.campaign_daily, self.dim_campaign, self.dim_network,
                                        self.dim_platform, self.dim_date)
        return self.campaign_daily_named.select(*daily.ENRICHED_COLS)

    # -------------------------------------------------------- performance
    @cached_property
    def perf_named(self):
        if self.materialize:
            return performance.perf_named(self.campaign_metrics, self.dim_campaign, self.dim_network,
                                          self.dim_platform, self.dim_date, self.as_of)
        return performance.perf_by_name(self.campaign_metrics, self.as_of, self.calendar_start)

    @cached_property
    def perf_fact(self):
        return self._keep(self.perf_named.drop("platform", "campaign_name", "network_name"))

    @cached_property
    def perf_enriched(self):
        if self.materialize:
            return performance.perf_enriched(self.perf_fact, self.dim_campaign, self.dim_network,
                                             self.dim_platform)
        return self.perf_named.select(*performance.IDS, *performance.PERF_METRICS,
                                      "platform", "campaign_name", "network_name")

    @cached_property
    def campaign_tiers(self):
        return performance.campaign_tiers(self.perf_fact)

    @cached_property
    def campaign_summary(self):
        return self._keep(self.summary_after(None))

    def summary_after(self, previous: DataFrame | None) -> DataFrame:
        """The summary with the growth since a previous snapshot of it."""
        perf = self.perf_fact if self.materialize else self.perf_named
        return performance.campaign_summary(perf, self.campaign_daily, self.dim_campaign, self.dim_network,
                                            self.dim_platform, self.as_of, previous)

    @cached_property
    def revenue_growth(self):
        return performance.revenue_growth(self.campaign_daily)

    @cached_property
    def budget_plan(self):
        return budget.budget_plan(self.perf_enriched)

    # -------------------------------------------------------- attribution
    @cached_property
    def touchpoints(self):
        return attribution.touchpoints(self.stg_user_data, self.block_ids)

    @cached_property
    def spend_by_campaign(self):
        return kpis.spend_by_campaign(self.stg_spend)

    @cached_property
    def attribution_all(self):
        return self._keep(attribution.attribution_all(self.touchpoints, self.spend_by_campaign))

    # ------------------------------------------------------------ cohorts
    @cached_property
    def cohort_ltv(self):
        return self._keep(cohorts.cohort_ltv(self.stg_user_data))

    @cached_property
    def cohort_retention(self):
        return cohorts.cohort_retention(self.stg_user_data)

    # -------------------------------------------------------- seasonality
    @cached_property
    def season_measures(self):
        return self._keep(seasonality.measures(self.daily_enriched))

    @cached_property
    def seasonal(self) -> dict:
        return seasonality.seasonality_tables(self.season_measures)

    @cached_property
    def seasonality_fact(self):
        return self._keep(seasonality.seasonality_long(self.seasonal))

    # --------------------------------------------------------- governance
    @cached_property
    def checks(self) -> "_Checks":
        """Governance checks, each built only when first used."""
        return _Checks(self)

    @property
    def models(self) -> dict:
        """Model name -> table."""
        return {
            "stg_spend": self.stg_spend, "stg_user_data": self.stg_user_data,
            "stg_campaign_metrics": self.campaign_metrics, "dim_cv_bucket": self.buckets,
            "dim_campaign": self.dim_campaign, "dim_network": self.dim_network, "dim_platform": self.dim_platform,
            "dim_date": self.dim_date, "fact_campaign_daily": self.campaign_daily,
            "fact_campaign_performance": self.perf_fact, "dim_campaign_performance_tier": self.campaign_tiers,
            "fact_campaign_summary": self.campaign_summary, "fact_user_cohort_analysis": self.cohort_ltv,
            "fact_multi_touch_attribution": self.attribution_all, "fact_budget_optimization": self.budget_plan,
            "fact_seasonality_analysis": self.seasonality_fact,
            **{f"fact_seasonality_{side}": table for side, table in self.seasonal.items()},
            "governance_data_quality": self.checks["dq_scores"], "governance_data_lineage": self.lineage,
        }

    @cached_property
    def tested(self) -> dict:
        """What the column tests read: the models that are declared with tests and the two raw inputs."""
        names = {*quality.NOT_NULL, *quality.UNIQUE, "stg_campaign_metrics", "dim_cv_bucket"}
        return {n: t for n, t in self.models.items() if n in names} | {"spend": self.spend, "user_data": self.user_data}

    @cached_property
    def column_results(self) -> DataFrame:
        return quality.column_results(self.materialized().tested)

    @cached_property
    def test_report(self) -> DataFrame:
        """All column and aggregate tests over the stored models."""
        return quality.test_report(self.column_results, self.materialized().checks)

    @cached_property
    def table_stats(self):
        return lineage.table_stats({"fact_campaign_performance": self.perf_fact,
                                    "fact_campaign_daily": self.campaign_daily,
                                    "stg_spend": self.stg_spend, "stg_user_data": self.stg_user_data})

    @cached_property
    def lineage(self):
        return lineage.lineage(self.spark, self.table_stats)

    # --------------------------------------------------------- incremental
    def daily_last(self, days: int = incremental.REPROCESS_DAYS):
        return incremental.daily_window(self.stg_spend, self.stg_user_data, self.dims, self.as_of, days)

    # -------------------------------------------------------- materialize
    def register_views(self, prefix: str = "") -> list[str]:
        """Expose every model as a temporary view for SQL users
        (``spark.sql("select ... from fact_campaign_daily")``)."""
        names = []
        for name, df in self.models.items():
            df.createOrReplaceTempView(prefix + name)
            names.append(prefix + name)
        return names

    def build(self, out: str, as_of_ts=None, incremental: bool = False, only: tuple[str, ...] = ()) -> dict[str, str]:
        """Write every model (or ``only`` those named) under ``out`` as Parquet,
        each computed once, with created_at / updated_at set to the run timestamp (``as_of_ts``, default
        as_of at midnight).

        The daily fact is partitioned by date and clustered by its ids: a full
        build replaces it whole (days that no longer exist go), ``incremental``
        recomputes the last REPROCESS_DAYS days and merges them. The summary
        keeps a partition per as_of and takes its growth from the latest
        earlier one. Quality scores are added to those of earlier runs, a run
        of the same as_of replaces its own."""
        m = self.materialized()
        ts = as_of_ts if as_of_ts is not None else dims.as_of_date(self.as_of).cast("timestamp")
        day = F.date_format(dims.as_of_date(self.as_of), "yyyy-MM-dd")
        paths = {name: f"{out.rstrip('/')}/{name}" for name in only or self.models}
        for name, path in paths.items():
            if name == "fact_campaign_daily":
                if incremental:
                    sinks.merge_into_partitioned(self.spark, path, sinks.with_audit(m.daily_last(), ts), "campaign_daily_id")
                else:
                    sinks.write_partitioned(sinks.with_audit(m.campaign_daily, ts), path, replace_all=True)
            elif name == "fact_campaign_summary":
                rows = m.summary_after(sinks.previous_snapshot(self.spark, path, self.as_of))
                sinks.write_snapshot(sinks.with_audit(rows, ts), path, day)
            elif name == "governance_data_quality":
                sinks.write_snapshot(sinks.with_audit(m.checks["dq_scores"], ts), path, day)
            elif name != "governance_data_lineage":
                sinks.write_table(sinks.with_audit(m.models[name], ts), path)
        if "governance_data_lineage" in paths:  # last: it reports what has been written
            facts = lineage.stored_facts(self.spark, {n: p for n, p in paths.items() if n != "governance_data_lineage"})
            sinks.write_table(sinks.with_audit(lineage.lineage(self.spark, facts), ts), paths["governance_data_lineage"])
            sinks.write_table(lineage.edges(self.spark), f"{out.rstrip('/')}/governance_lineage_edges")
        return paths

    def store_failures(self, out: str, run: str, limit: int | None = None) -> str:
        """Adds the rows that fail a column test to the failures table under
        ``out`` (a partition per run and test)."""
        path = f"{out.rstrip('/')}/test_failures"
        sinks.store_failures(quality.failing_rows(self.materialized().tested, limit), path, run)
        return path


class _Checks:
    """Lazy mapping of check name -> one-row DataFrame."""

    def __init__(self, m: Mart):
        self._m = m
        self._built: dict = {}

    def _make(self, name: str):
        m = self._m
        if name == "dq_campaign":
            return quality.dq_campaign(m.perf_fact)
        if name == "dq_spend":
            return quality.dq_spend(m.stg_spend)
        if name == "dq_users":
            return quality.dq_users(m.stg_user_data)
        if name == "dq_referential":
            return quality.dq_referential(m.perf_fact, m.dim_campaign, m.dim_network, m.dim_platform)
        if name == "dq_tiers":
            return quality.dq_tiers(m.campaign_tiers)
        if name == "dq_date_dim":
            return quality.dq_date_dim(m.dim_date, m.as_of)
        if name == "dq_daily_partitions":
            return quality.dq_daily_partitions(m.campaign_daily, m.as_of)
        if name == "dq_scores":
            return quality.dq_scores(self["dq_campaign"], self["dq_spend"], self["dq_users"], self["dq_referential"])
        if name == "dq_score_logic":
            return quality.dq_score_logic(self["dq_scores"])
        raise KeyError(name)

    def __getitem__(self, name: str):
        if name not in self._built:
            self._built[name] = self._make(name)
        return self._built[name]
