"""User-level statistics over exposures and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import PAIR_PERCENT
from ..functions.text import half_even, squeeze

GROUP = ["exposure_group", "group_type", "n_target_drugs"]


def analysis_term() -> Column:
    """The validated term where there is one, else the proposed."""
    return F.when(F.col("validated_meddra_pt") != "", F.col("validated_meddra_pt")).otherwise(F.col("proposed_meddra_pt"))


def group_summary(exposures: DataFrame, events: DataFrame) -> DataFrame:
    """Records, exposed users and event users per exposure group."""
    a = exposures.groupBy(*GROUP).agg(F.count_distinct("record_id").alias("n_records"), F.count_distinct("user_id").alias("n_exposed_users"))
    b = events.groupBy(*GROUP).agg(F.count_distinct("user_id").alias("n_event_users"))
    return a.join(b, GROUP, "left").select(*GROUP, "n_records", "n_exposed_users", F.coalesce("n_event_users", F.lit(0)).cast("long").alias("n_event_users"))


def modal_label(events: DataFrame, keys: list[str], label: str = "meddra_pt_zh") -> DataFrame:
    """Per key the most frequent non-empty label; the first seen of equals."""
    n = events.where(F.col(label) != "").groupBy(*keys, label).agg(F.count(F.lit(1)).alias("n"), F.min("ordinal").alias("o"))
    return n.groupBy(*keys).agg(F.min_by(label, F.struct((-F.col("n")).alias("n"), "o")).alias(label))


def term_frequency(exposures: DataFrame, events: DataFrame) -> DataFrame:
    """Users per group and term, as shares of exposed and of event users."""
    named = events.withColumn("meddra_pt", analysis_term()).where("meddra_pt <> ''")
    keys = [*GROUP, "meddra_pt"]
    n = named.groupBy(*keys).agg(F.count_distinct("user_id").alias("n_users"))
    full = n.join(modal_label(named, keys), keys, "left").join(group_summary(exposures, events).drop("n_records"), GROUP, "left")
    share = lambda c: half_even(F.lit(100.0) * F.col("n_users") / F.greatest(F.col(c), F.lit(1)), 1)
    return full.select(
        *keys, F.coalesce("meddra_pt_zh", F.lit("")).alias("meddra_pt_zh"), "n_users", "n_exposed_users", "n_event_users",
        share("n_exposed_users").alias("percent_of_exposed_users"), share("n_event_users").alias("percent_of_event_reporters"),
    )


def top_terms(frequency: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` most reported terms of each group, with their rank."""
    w = Window.partitionBy("exposure_group").orderBy(F.desc("n_users"), "meddra_pt")
    return frequency.withColumn("term_rank", F.row_number().over(w)).where(F.col("term_rank") <= n)


def symptoms(exposures: DataFrame, events: DataFrame) -> DataFrame:
    """``user_id, symptom_zh``: distinct Chinese labels (else the term) of
    exposed users; terms without one are left out."""
    named = events.withColumn("term", analysis_term()).where("term <> ''")
    label = modal_label(named, ["term"])
    s = named.join(label.withColumnRenamed("meddra_pt_zh", "zh"), "term", "left").select("user_id", squeeze(F.coalesce("zh", "term")).alias("symptom_zh")).where("symptom_zh <> ''")
    return s.join(exposures.select("user_id").distinct(), "user_id", "left_semi").distinct()


def symptom_pairs(exposures: DataFrame, events: DataFrame, least: float = PAIR_PERCENT) -> DataFrame:
    """Users with both symptoms of a pair, from ``least`` percent of exposed
    users up. Pairs come from each user's own sorted set of symptoms, whose
    size is bounded by the dictionary."""
    own = symptoms(exposures, events).groupBy("user_id").agg(F.array_sort(F.collect_set("symptom_zh")).alias("s"))
    pairs = F.flatten(F.transform("s", lambda x, i: F.transform(F.slice("s", i + 2, F.size("s")), lambda y: F.struct(x.alias("symptom_1"), y.alias("symptom_2")))))
    n = own.select(F.explode(pairs).alias("p")).groupBy("p.symptom_1", "p.symptom_2").agg(F.count(F.lit(1)).alias("n_users"))
    total = exposures.agg(F.count_distinct("user_id")).first()[0]  # one number
    share = F.lit(100.0) * F.col("n_users") / F.lit(max(total, 1))
    return n.where(share >= least).select("symptom_1", "symptom_2", "n_users", half_even(share, 1).alias("percent_of_exposed"))


def exclusive_users(exposures: DataFrame, targets: list[str]) -> DataFrame:
    """``user_id, drug`` of users with one exposure group, a single target."""
    one = exposures.groupBy("user_id").agg(F.min("exposure_group").alias("drug"), F.max("exposure_group").alias("last"))
    return one.where((F.col("drug") == F.col("last")) & F.col("drug").isin(targets)).select("user_id", "drug")


def exclusive_counts(exposures: DataFrame, targets: list[str]) -> DataFrame:
    """``drug, n_exclusive_users`` for every target, also with none."""
    spark = exposures.sparkSession
    every = spark.createDataFrame([(t,) for t in targets], "drug string")
    n = exclusive_users(exposures, targets).groupBy("drug").agg(F.count(F.lit(1)).alias("n"))
    return every.join(n, "drug", "left").select("drug", F.coalesce("n", F.lit(0)).cast("long").alias("n_exclusive_users"))


def exclusive_pivot(exposures: DataFrame, events: DataFrame, targets: list[str], least: float = PAIR_PERCENT) -> DataFrame:
    """Per symptom and target the exclusive users who report it, wide.

    Columns ``symptom_zh, n_total`` and per target ``n_<drug>`` and
    ``percent_<drug>`` (2 digits, 0 without exclusive users). A symptom stays
    if for any target at least ``least`` percent report it.
    """
    who = exclusive_users(exposures, targets)
    size = {r[0]: r[1] for r in exclusive_counts(exposures, targets).collect()}  # one row a target
    n = symptoms(exposures, events).join(who, "user_id").groupBy("symptom_zh").pivot("drug", targets).agg(F.count(F.lit(1)))
    count = {t: F.coalesce(F.col(f"`{t}`"), F.lit(0)).cast("long") for t in targets}
    share = {t: F.lit(100.0) * count[t] / size[t] if size.get(t) else F.lit(0.0) for t in targets}
    enough = F.lit(False)
    for t in targets:
        enough = enough | (share[t] >= least)
    cols = [c for t in targets for c in (count[t].alias(f"n_{t}"), half_even(share[t], 2).alias(f"percent_{t}"))]
    return n.where(enough).select("symptom_zh", sum(count.values(), F.lit(0)).cast("long").alias("n_total"), *cols)
