"""Ancestor reach: path counts, distinct ancestors, and per-individual sums over paths."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.store import kept
from ..sources.pedigree import Pedigree
from .classes import BITS, classes, met


def paths(ped: Pedigree, k: int) -> DataFrame:
    """(desc, anc, n): the number of paths of k links; kept for reuse."""
    known = ped.__dict__.setdefault("_paths", {})
    if k not in known:
        if k == 0:
            known[k] = ped.people.select(F.col("row").alias("desc"), F.col("row").alias("anc"), F.lit(1).cast("long").alias("n"))
        elif k == 1:
            known[k] = kept(ped.edges.groupBy(F.col("child").alias("desc"), F.col("parent").alias("anc")).agg(F.count(F.lit(1)).alias("n")))
        else:
            up = ped.edges.select(F.col("child").alias("anc"), "parent")
            known[k] = kept(met(paths(ped, k - 1), up, "anc").groupBy("desc", F.col("parent").alias("anc")).agg(F.sum("n").alias("n")))
    return known[k]


def reach(ped: Pedigree, k: int) -> DataFrame:
    """(desc, anc): who is k links up by some path."""
    return paths(ped, k).select("desc", "anc")


def grows(ped: Pedigree) -> bool:
    """Whether generations grow along every link, from 0 on."""
    if "_grows" not in ped.__dict__:
        gens = ped.people.select("row", "generation")
        flat = met(met(ped.edges, gens.toDF("child", "g"), "child"), gens.toDF("parent", "pg"), "parent").filter("pg >= g OR pg < 0")
        ped._grows = flat.limit(1).isEmpty()
    return ped._grows


def height(ped: Pedigree) -> int:
    """A bound on the links of any line: the last generation where generations grow along every link, else counted link by link."""
    if "_height" not in ped.__dict__:
        if grows(ped):
            ped._height = ped.last_generation
        else:
            links, here = 0, kept(ped.edges.select(F.col("child").alias("row")).distinct())
            while not here.isEmpty():
                links += 1
                here = kept(met(ped.edges, here, ped.edges["parent"] == here["row"]).select(F.col("child").alias("row")).distinct())
            ped._height = links
    return ped._height


def levels(ped: Pedigree) -> DataFrame:
    """(row, level): a number that grows along every link: the generation if it does, else the depth."""
    if "_levels" not in ped.__dict__:
        ped._levels = ped.people.select("row", F.col("generation").alias("level")) if grows(ped) else kept(depth(ped).select("row", F.col("depth").alias("level")))
    return ped._levels


def lineage_of(edges: DataFrame, levels: DataFrame) -> dict[int, DataFrame]:
    """By level: (i, a, t) of the level's rows with parents: each distinct ancestor, and the genome share that goes down all paths from it.

    One step a level: a child's ancestors are its parents and theirs, so each pair is made once for each parent that has it, and a step reads
    only the levels at which its parents are.
    """
    child, parent = levels.toDF("child", "g"), levels.toDF("parent", "pg")
    links = kept(met(met(edges.select("child", "parent"), child, "child"), parent, "parent"))
    at: dict[int, set[int]] = {}
    for r in links.select("g", "pg").distinct().collect():  # levels squared at most
        at.setdefault(r["g"], set()).add(r["pg"])
    out: dict[int, DataFrame] = {}
    for g in sorted(at):
        here = links.filter(F.col("g") == g).select("child", "parent")
        rows = here.select(F.col("child").alias("i"), F.col("parent").alias("a"), F.lit(0.5).alias("t"))
        above = [out[p] for p in sorted(at[g]) if p in out]
        if above:
            far = met(reduce(DataFrame.union, above).withColumnRenamed("i", "parent"), here, "parent")
            rows = rows.union(far.select(F.col("child").alias("i"), "a", F.col("t") * 0.5))
        out[g] = kept(rows.groupBy("i", "a").agg(F.sum("t").alias("t")))
    return out


def class_levels(ped: Pedigree) -> DataFrame:
    """(row, level) of classes."""
    return met(classes(ped).people.select("row", F.shiftright("row", BITS).alias("first")), levels(ped).withColumnRenamed("row", "first"), "first").select("row", "level")


def lineage(ped: Pedigree) -> dict[int, DataFrame]:
    """lineage_of the pedigree's classes."""
    if "_lineage" not in ped.__dict__:
        ped._lineage = lineage_of(classes(ped).edges, class_levels(ped))
    return ped._lineage


def unfolded(ped: Pedigree, table: DataFrame) -> DataFrame:
    """table of classes (row, ...), a row for each member instead."""
    rows = F.coalesce("rows", F.array(F.shiftright("row", BITS)))
    return met(table, classes(ped).members, "row", "left").select(F.explode(rows).alias("_r"), *[c for c in table.columns if c != "row"]).withColumnRenamed("_r", "row")


def settled(ped: Pedigree, start: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """start after as many steps as the longest line has links: one plan of joins with the links, cut every few steps."""
    here = start
    for k in range(1, height(ped) + 1):
        here = step(here)
        if k % 5 == 0:
            here = kept(here)
    return here


def _along(ped: Pedigree, key: str, to: str, value, none) -> DataFrame:
    """(row, id, value): the fixed point of a sum or maximum over a row's links, one pass over the links a step, whatever the number of paths."""

    def step(here: DataFrame) -> DataFrame:
        reached = met(ped.edges, here, ped.edges[key] == here["row"]).groupBy(F.col(to).alias("row")).agg(value.alias("v"))
        return met(ped.people.select("row"), reached, "row", "left").select("row", F.coalesce("v", none).alias("v"))

    found = settled(ped, ped.people.select("row", none.alias("v")), step)
    return met(ped.people.select("row", "id"), found.withColumnRenamed("v", "value"), "row")


def depth(ped: Pedigree) -> DataFrame:
    """(row, id, depth): links on the longest line to a founder."""
    return _along(ped, "parent", "child", F.max("v") + 1, F.lit(0)).select("row", "id", F.col("value").cast("int").alias("depth"))


def n_descendants(ped: Pedigree) -> DataFrame:
    """(row, id, value): descending paths, each counted; where they exceed 64 bits the query fails and says so."""
    total = F.try_sum(F.try_add(F.col("v"), F.lit(1)))
    whole = F.count(F.col("v")) == F.count(F.try_add(F.col("v"), F.lit(1)))
    return _along(ped, "child", "parent", F.when(total.isNotNull() & whole, total).otherwise(F.raise_error(F.lit("n_descendants: the number of paths exceeds 64 bits"))), F.lit(0).cast("long"))


def eqg(ped: Pedigree) -> DataFrame:
    """(row, id, value): equivalent complete generations, the sum over known ancestors of (1/2) ** links."""
    return _along(ped, "parent", "child", F.sum((F.col("v") + 1) * 0.5), F.lit(0.0))


def ancestors(ped: Pedigree) -> DataFrame:
    """(desc, anc): all distinct strict ancestors, desc a class."""
    parts = [t.select(F.col("i").alias("desc"), F.shiftright("a", BITS).alias("anc")) for t in lineage(ped).values()]
    return reduce(DataFrame.union, parts) if parts else ped.spark.createDataFrame([], "desc long, anc long")


def n_ancestors(ped: Pedigree) -> DataFrame:
    """(row, id, value): the number of distinct strict ancestors."""
    counts = unfolded(ped, ancestors(ped).groupBy(F.col("desc").alias("row")).agg(F.count(F.lit(1)).alias("value")))
    return met(ped.people.select("row", "id"), counts, "row", "left").select("row", "id", F.coalesce("value", F.lit(0)).cast("long").alias("value"))


def contributions(ped: Pedigree, edges: DataFrame | None = None, start: DataFrame | None = None) -> DataFrame:
    """(generation, row, w): the summed genome shares that a generation's members have from each row (itself included): an adjoint sweep of links."""
    edges = ped.edges if edges is None else edges
    start = kept(start if start is not None else ped.people.select("generation", "row", F.lit(1.0).alias("w")))

    def step(here: DataFrame) -> DataFrame:
        up = met(here, edges, here["row"] == edges["child"]).select("generation", F.col("parent").alias("row"), (F.col("w") * 0.5).alias("w"))
        return start.union(up).groupBy("generation", "row").agg(F.sum("w").alias("w"))

    return settled(ped, start, step)
