"""The pedigree model: validated individuals, resolved parent rows, edges, and an optional subsample."""

from __future__ import annotations

from collections.abc import Sequence
from copy import copy
from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.store import dropped, kept

REQUIRED = ["id", "mother", "father", "twin", "sex", "generation"]
INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
INPUT = "row long, id long, mother long, father long, twin long, sex int, generation int, birth_year int"


def _known(column: str):
    """A nonnegative id, or null."""
    return F.when(F.col(column) >= 0, F.col(column).cast("long"))


def numbered(df: DataFrame, column: str) -> DataFrame:
    """df with `row`: the rank of `column` from 0, by range partitions and their offsets (no single-task window)."""
    dealt = kept(df.repartitionByRange(column).sortWithinPartitions(column).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))
    sizes = sorted((r["_part"], r["n"], r["least"]) for r in dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n"), F.min("_at").alias("least")).collect())
    rows, before = [], 0
    for part, n, least in sizes:
        rows.append((part, before - least))
        before += n
    offsets = dealt.sparkSession.createDataFrame(rows, "_part int, _shift long")
    return dealt.join(F.broadcast(offsets), "_part").withColumn("row", F.col("_at") + F.col("_shift")).drop("_part", "_at", "_shift")


class Pedigree:
    """Individuals in topological row order (parents before children).

    people: row, id, orig_mother, orig_father (ids, null when unknown), m, f, tw (rows, null when unknown or absent), sex, generation, birth_year.
    sample: (row, caller_row) when made by from_subsample.
    """

    def __init__(self, data: Any, spark: SparkSession | None = None, *, validate: bool = True):
        raw = _as_frame(data, spark)
        missing = [c for c in REQUIRED if c not in raw.columns]
        if "id" in missing:
            raise ValueError("there is no 'id' column, which every pedigree needs")
        _check_ids(raw, validate)
        if missing:
            raise ValueError(f"columns that every pedigree needs are absent: {', '.join(missing)}")
        self.spark = raw.sparkSession
        self.has_birth_year = "birth_year" in raw.columns
        if "row" not in raw.columns:
            raw = numbered(raw, "id")
        year = F.col("birth_year") if self.has_birth_year else F.lit(None)
        if self.has_birth_year and isinstance(raw.schema["birth_year"].dataType, (T.FloatType, T.DoubleType)):
            year = F.nanvl(year, F.lit(None).cast("double"))
        base = raw.select(
            F.col("row").cast("long").alias("row"), F.col("id").cast("long").alias("id"), _known("mother").alias("orig_mother"), _known("father").alias("orig_father"), _known("twin").alias("_twin"),
            F.col("sex").cast("int").alias("sex"), F.col("generation").cast("int").alias("generation"), F.when(year >= 0, year.cast("int")).alias("birth_year"),
        )
        key = base.select(F.col("row").alias("_row"), F.col("id").alias("_id"))
        people = base
        for source, name in (("orig_mother", "m"), ("orig_father", "f"), ("_twin", "tw")):
            people = people.join(key.withColumnRenamed("_row", name).hint("merge"), F.col(source) == F.col("_id"), "left").drop("_id")
        self.people = kept(people.drop("_twin"))
        self.sample: DataFrame | None = None
        if validate:
            self._check_order()
            self._check_years()

    @classmethod
    def from_dataframe(cls, df: Any, spark: SparkSession | None = None) -> Pedigree:
        return cls(df, spark)

    @classmethod
    def from_arrays(cls, ids: Sequence, mothers: Sequence, fathers: Sequence, twins: Sequence | None = None, generation: Sequence | None = None, birth_year: Sequence | None = None, sex: Sequence | None = None, *, spark: SparkSession | None = None) -> Pedigree:
        """A pedigree of parallel sequences; sex defaults to 0, twins to unknown, and a missing generation is derived as depth."""
        n = len(ids)
        data = {"id": ids, "mother": mothers, "father": fathers, "twin": [-1] * n if twins is None else twins, "sex": [0] * n if sex is None else sex, "generation": [0] * n if generation is None else generation}
        if birth_year is not None:
            data["birth_year"] = birth_year
        made = cls(data, spark)
        if generation is None:
            from ..operators.reach import depth

            deep = depth(made).select("row", F.col("depth").alias("generation"))
            made.people = kept(made.people.drop("generation").join(deep.hint("merge"), "row"))
        return made

    @classmethod
    def from_subsample(cls, full: Any, part: Any, spark: SparkSession | None = None, *, validate: bool = True) -> Pedigree:
        """The full pedigree (raw, or made already), whose pairs are limited to and numbered by the rows of `part`."""
        rows = _as_frame(part, spark)
        if "id" not in rows.columns:
            raise ValueError("the subsample needs an 'id' column")
        _check_ids(rows, validate)
        made = copy(full) if isinstance(full, Pedigree) else cls(full, spark, validate=validate)
        made.full = full if isinstance(full, Pedigree) else made
        made.__dict__.pop("_sampled", None)  # of another sample
        if "row" not in rows.columns:
            rows = numbered(rows, "id")
        wanted = rows.select(F.col("id").cast("long").alias("id"), F.col("row").cast("long").alias("caller_row"))
        if validate:
            absent = wanted.join(made.people.select("id").hint("merge"), "id", "left_anti")
            first = [r["id"] for r in absent.orderBy("caller_row").limit(10).collect()]
            if first:
                raise ValueError(f"from_subsample: {absent.count()} id(s) in df not present in full_pedigree (first {len(first)}: {first})")
        made.sample = kept(made.people.select("row", "id").join(wanted.hint("merge"), "id").select("row", "caller_row"))
        return made

    def release(self) -> int:
        """Deletes the tables kept beyond individuals, links and the sample, and forgets them; they are made anew when asked for. Returns how many went."""
        own = {"spark", "has_birth_year", "people", "sample", "full", "edges", "last_generation", "age_edges"}
        gone = [self.__dict__.pop(name) for name in [*self.__dict__] if name not in own]
        return sum(map(dropped, gone))

    @cached_property
    def edges(self) -> DataFrame:
        """(child, parent, side): one row for each resolved parent link; selfing has two."""
        sides = F.explode(F.array(F.struct(F.col("m").alias("parent"), F.lit("m").alias("side")), F.struct(F.col("f").alias("parent"), F.lit("f").alias("side"))))
        return kept(self.people.select(F.col("row").alias("child"), sides.alias("e")).select("child", "e.parent", "e.side").filter(F.col("parent").isNotNull()))

    @cached_property
    def last_generation(self) -> int:
        return self.people.agg(F.max("generation")).first()[0] or 0

    @cached_property
    def age_edges(self) -> DataFrame:
        """(child, side, diff): age of the parent at the child's birth, both years known."""
        years = self.people.select("row", "birth_year").filter(F.col("birth_year").isNotNull())
        child = years.select(F.col("row").alias("child"), F.col("birth_year").alias("cy"))
        parent = years.select(F.col("row").alias("parent"), F.col("birth_year").alias("py"))
        return kept(self.edges.join(child.hint("merge"), "child").join(parent.hint("merge"), "parent").select("child", "side", (F.col("cy") - F.col("py")).alias("diff")))

    def _check_order(self) -> None:
        if not self.edges.filter(F.col("parent") >= F.col("child")).limit(1).isEmpty():
            raise ValueError("Pedigree requires topological order: parents must precede children")

    def _check_years(self) -> None:
        if not self.has_birth_year:
            return
        bad = self.age_edges.filter("diff < 0").groupBy("side").agg(F.count(F.lit(1)).alias("n"), F.min("child").alias("row"), F.min_by("diff", "child").alias("diff"))
        for side, name in (("m", "mother"), ("f", "father")):
            if r := bad.filter(F.col("side") == side).first():
                raise ValueError(f"birth_year topology violation: {r['n']} {name}-child edge(s) have child.birth_year < {name}.birth_year (first: row {r['row']}, diff={r['diff']})")


def _as_frame(data: Any, spark: SparkSession | None) -> DataFrame:
    """A Spark DataFrame as it is; a dict of sequences or a pandas DataFrame with its positions as `row`."""
    if isinstance(data, DataFrame):
        return data
    spark = spark or SparkSession.getActiveSession()
    columns = {k: list(data[k]) for k in [*REQUIRED, "birth_year"] if k in data}
    if "id" not in columns:
        raise ValueError("there is no 'id' column, which every pedigree needs")
    ids = columns["id"]
    if any(isinstance(v, (list, tuple)) or getattr(v, "ndim", 0) for v in ids):
        raise ValueError("id must be 1-D")
    if any(isinstance(v, float) or getattr(getattr(v, "dtype", None), "kind", "i") == "f" for v in ids):
        raise ValueError("id must be of an integer dtype")
    if short := [k for k, v in columns.items() if len(v) != len(ids)]:
        raise ValueError(f"columns differ in length from id: {', '.join(short)}")
    year = lambda v: None if v is None or v != v else int(v)
    rows = [(i, *(year(columns[k][i]) if k == "birth_year" else int(columns[k][i]) for k in columns)) for i in range(len(ids))]
    kinds = dict(part.split() for part in INPUT.split(", "))
    return spark.createDataFrame(rows, ", ".join(f"{k} {kinds[k]}" for k in ["row", *columns]))


def _check_ids(df: DataFrame, scan: bool) -> None:
    kind = df.schema["id"].dataType
    if isinstance(kind, T.ArrayType):
        raise ValueError("id must be 1-D")
    if not isinstance(kind, INTEGERS):
        raise ValueError("id must be of an integer dtype")
    if scan:
        r = df.agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("different")).first()
        if r["least"] is not None and r["least"] < 0:
            raise ValueError("id must be nonnegative")
        if r["different"] < r["n"]:
            raise ValueError("duplicate id")
