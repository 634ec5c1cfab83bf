"""A deterministic pedigree of six generations derived from the customer table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .pedigree import Pedigree, numbered

SQL = """
WITH n AS (SELECT count(*) div 6 AS w0 FROM {customer}), w AS (SELECT w0 - (w0 % 2) AS w FROM n),
b AS (SELECT c_custkey AS k, w, least(c_custkey div w, 5) AS g FROM {customer}, w WHERE c_custkey < 6 * w),
b2 AS (SELECT *, CASE WHEN k % 98 = 2 AND (k - 2) div w = g THEN k - 2 ELSE k END AS b FROM b)
SELECT k AS row, k AS id,
  CASE WHEN g = 0 OR b % 23 = 1 THEN -1 ELSE (g - 1) * w + 2 * ((b * b * 31 + b * 7919) % (w div 2)) END AS mother,
  CASE WHEN g = 0 OR b % 29 = 1 THEN -1 ELSE (g - 1) * w + 1 + 2 * ((CASE WHEN b % 5 = 0 THEN b * 104729 + b * b * 17
       ELSE ((b * b * 31 + b * 7919) % (w div 2)) * 37 + g * 11 END) % (w div 2)) END AS father,
  CASE WHEN k % 98 = 0 AND (k + 2) div w = g THEN k + 2 WHEN k % 98 = 2 AND (k - 2) div w = g THEN k - 2 ELSE -1 END AS twin,
  CAST(b % 2 AS INT) AS sex, CAST(g AS INT) AS generation, CAST(1900 + 25 * g + (k % 7) AS INT) AS birth_year
FROM b2
"""


def rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(SQL, customer=spark.read.parquet(f"{sf_dir}/customer.parquet"))


def pedigree(spark: SparkSession, sf_dir: str) -> Pedigree:
    """One pedigree a session and folder, so that queries share what it keeps. The derived rows meet the model's conditions by construction."""
    known = spark.__dict__.setdefault("_kinforge_pedigrees", {})
    if sf_dir not in known:
        known[sf_dir] = Pedigree(rows(spark, sf_dir), validate=False)
    return known[sf_dir]


def tiled(spark: SparkSession, sf_dir: str, individuals: int) -> Pedigree:
    """At least so many individuals: the derived pedigree side by side with copies of itself, for timing at the sizes of the baseline."""
    one = rows(spark, sf_dir)
    n = one.count()
    copies = spark.range(-(-individuals // n)).select((F.col("id") * n).alias("shift"))
    moved = [F.when(F.col(c) >= 0, F.col(c) + F.col("shift")).otherwise(F.col(c)).alias(c) if c in ("row", "id", "mother", "father", "twin") else F.col(c) for c in one.columns]
    return Pedigree(one.crossJoin(F.broadcast(copies)).select(*moved), validate=False)  # broadcast: one row a copy


def subsample(spark: SparkSession, sf_dir: str) -> Pedigree:
    """Limited to two individuals of three, numbered by descending id."""
    known = spark.__dict__.setdefault("_kinforge_samples", {})
    if sf_dir not in known:
        full = pedigree(spark, sf_dir)
        ids = full.people.filter("id % 3 <> 1").select("id", (-F.col("id")).alias("order"))
        known[sf_dir] = Pedigree.from_subsample(full, numbered(ids, "order").select("id", "row"), validate=False)
    return known[sf_dir]
