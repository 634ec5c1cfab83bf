"""Generation interval, the eligible birth-year window, and parental ages."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.pedigree import Pedigree


class CohortWindow(NamedTuple):
    c_min: int
    c_max: int
    reproductive_age_p95: float


class GenerationInterval(NamedTuple):
    T: float
    T_m: float
    T_f: float
    n_edges: int

    def to_dict(self) -> dict:
        return self._asdict()


def generation_interval(ped: Pedigree) -> DataFrame:
    """One row (t, t_m, t_f, n_edges): mean age of fathers and mothers at birth, and the mean of both; no row where a side has none."""
    mean = lambda side: F.avg(F.when(F.col("side") == side, F.col("diff")))
    one = ped.age_edges.agg(mean("f").alias("t_m"), mean("m").alias("t_f"), F.count(F.lit(1)).alias("n_edges")).dropna()
    return one.select(((F.col("t_m") + F.col("t_f")) / 2).alias("t"), "t_m", "t_f", "n_edges")


def generation_interval_record(ped: Pedigree) -> GenerationInterval | None:
    r = generation_interval(ped).first()
    return r and GenerationInterval(r["t"], r["t_m"], r["t_f"], r["n_edges"])


def eligible_cohort_window(ped: Pedigree, percentile: float = 95.0, c_min: int | None = None, c_max: int | None = None) -> DataFrame:
    """One row (c_min, c_max, reproductive_age_p95): from the first known birth year to the last, less the percentile of parental ages (linear)."""
    years = ped.people.agg(F.min("birth_year").alias("first"), F.max("birth_year").alias("last"))
    age = ped.age_edges.agg(F.percentile("diff", F.lit(percentile / 100)).alias("p"))
    low = F.col("first") if c_min is None else F.lit(c_min)
    high = F.floor(F.col("last") - F.col("p")) if c_max is None else F.lit(c_max)
    return years.crossJoin(age).select(low.cast("int").alias("c_min"), high.cast("int").alias("c_max"), F.col("p").alias("reproductive_age_p95"))  # one row each


def eligible_cohort_range(ped: Pedigree, *, percentile: float = 95.0, c_min: int | None = None, c_max: int | None = None) -> CohortWindow:
    if not ped.has_birth_year:
        raise ValueError("eligible_cohort_range requires birth years")
    if ped.people.filter("birth_year IS NOT NULL").limit(1).isEmpty():
        raise ValueError("eligible_cohort_range: no individuals have known birth_year")
    r = eligible_cohort_window(ped, percentile, c_min, c_max).first()
    if r["reproductive_age_p95"] is None:
        raise ValueError("eligible_cohort_range: no parent-child edges with both birth_years known")
    return CohortWindow(r["c_min"], r["c_max"], r["reproductive_age_p95"])


def age_table(ped: Pedigree) -> DataFrame:
    """(side, age, n): parental ages at birth, by side (m: mothers, f: fathers)."""
    return ped.age_edges.groupBy("side", F.col("diff").alias("age")).agg(F.count(F.lit(1)).alias("n"))
