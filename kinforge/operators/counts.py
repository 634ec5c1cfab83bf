"""Pair counts that never list pairs (scalar formulas), and counts by distinct shared ancestors."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.registry import CODES, check_degree
from ..plans.store import kept
from ..sources.pedigree import Pedigree
from .classes import met, weight
from .pairs import COLLATERAL, LINEAL, PairRules, SUBTRACT, _counted_in_groups, canonical, rules, with_all_codes
from .reach import reach


def count_pairs_scalar(ped: Pedigree, max_degree: int = 2, scope: str = "full") -> DataFrame:
    """(code, n) by group-by sums alone: exact for ten categories, estimates for the others."""
    if scope not in ("full", "subsample"):
        raise ValueError(f"scope must be 'full' or 'subsample', not {scope!r}")
    check_degree(max_degree)
    if scope == "subsample" and ped.sample is not None:
        raise NotImplementedError("the scalar counter can't count a from_subsample pedigree's sample")
    # d1..d5: distinct descendants k links down; the largest needed is the degree itself.
    deep = max_degree if max_degree >= 2 else 0
    sums = lambda e, name: F.coalesce(F.sum(F.expr(e)), F.lit(0)).cast("long").alias(name)
    people = ped.people.select("row", "m", "f", "tw", F.col("orig_mother").alias("mo"), F.col("orig_father").alias("fa"))
    if deep:
        down = reduce(DataFrame.union, [reach(ped, k).select(F.col("anc").alias("row"), F.lit(k).alias("k")) for k in range(1, deep + 1)])
        people = met(people, down.groupBy("row").agg(*[F.count_if(F.col("k") == k).alias(f"d{k}") for k in range(1, 6)]), "row", "left")
        people = people.select(*people.columns[:6], *[F.coalesce(f"d{k}", F.lit(0)).cast("long").alias(f"d{k}") for k in range(1, 6)])
    else:
        people = people.select("*", *[F.lit(0).cast("long").alias(f"d{k}") for k in range(1, 6)])
    base = kept(people)
    # Families (both parents known), and each parent's offspring, in one pass of grouping sets.
    made = base.filter("tw IS NULL").groupingSets([["mo", "fa"], ["mo"], ["fa"]], "mo", "fa").agg(F.grouping_id().alias("by"), F.count(F.lit(1)).alias("k"), *[F.sum(f"d{i}").alias(f"s{i}") for i in range(1, 5)], F.sum(F.expr("d1 * d1")).alias("q1"))
    total = lambda e, name, by, known: sums(f"CASE WHEN by = {by} AND {known} THEN {e} END", name)
    family = lambda e, name: total(e, name, 0, "mo IS NOT NULL AND fa IS NOT NULL")
    sides = []
    for by, known, name in ((1, "mo IS NOT NULL", "m"), (2, "fa IS NOT NULL", "p")):
        sides += [total("k * (k - 1) div 2", f"{name}sib", by, known), *[total(f"greatest(k - 1, 0) * s{i}", f"{name}w{i}", by, known) for i in (1, 2, 3)]]
    fam = made.agg(
        family("k * (k - 1) div 2", "fs"), family("(k - 1) * s1", "av"), family("(k - 1) * s2", "gav"), family("(k - 1) * s3", "ggav"), family("(k - 1) * s4", "g3av"),
        family("(s1 * s1 - q1) div 2", "c1"), family("s1 * s2", "s12"), family("s1 * s3", "s13"), family("s2 * (s2 - 1) div 2", "c2"), *sides,
    )
    own = base.agg(
        F.count_if(F.expr("tw > row")).alias("mz"), F.count("m").alias("mother"), F.count("f").alias("father"), sums("d2 * (d2 - 1) div 2", "dd2"), sums("d2 * d3", "d23"), *[sums(f"d{k}", c.lower()) for c, k in LINEAL.items()],
    )
    one = fam.crossJoin(F.broadcast(own))  # one row each
    formulas = {"MZ": "mz", "MO": "mother", "FO": "father", "FS": "fs", "MHS": "msib - fs", "PHS": "psib - fs"}
    if max_degree >= 2:
        formulas |= {"GP": "gp", "Av": "av"}
    if max_degree >= 3:
        formulas |= {"GGP": "ggp", "HAv": "mw1 + pw1 - 2 * av", "GAv": "gav", "1C": "c1", "H1C": "greatest(0, dd2 - 4 * fs - 2 * (msib - fs) - 2 * (psib - fs) - 2 * c1)"}
    if max_degree >= 4:
        formulas |= {"GGGP": "gggp", "GGAv": "ggav", "1C1R": "greatest(0, s12 - av - gav)", "HGAv": "mw2 + pw2 - 2 * gav"}
    if max_degree >= 5:
        r1 = formulas["1C1R"]
        formulas |= {"G3GP": "g3gp", "G3Av": "g3av", "1C2R": "greatest(0, s13 - gav - ggav)", "2C": "c2", "HGGAv": "mw3 + pw3 - 2 * ggav"}
        formulas["H1C1R"] = f"greatest(0, d23 - 2 * {r1} - ({formulas['HAv']}) - ({formulas['HGAv']}))"
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.expr(e).cast("long").alias("n")) for c, e in formulas.items()])).alias("r")
    return with_all_codes(ped, one.select(rows).select("r.code", "r.n"))


class DistinctRules(PairRules):
    """Pairs by distinct shared ancestors, both directions summed; parents in common by resolved row."""

    def _candidates(self, code: str) -> DataFrame:
        if code in ("1C", "H1C"):
            parents = self.classes.people.select("row", "m", "f")
            first, second = parents.toDF("lo", "m1", "f1"), parents.toDF("hi", "m2", "f2")
            same = F.coalesce(F.col("m1") == F.col("m2"), F.lit(False)) | F.coalesce(F.col("f1") == F.col("f2"), F.lit(False))
            found = met(met(self.shared(2, 2), first, "lo"), second, "hi").filter(~same)
            return found.filter("n >= 2" if code == "1C" else "n = 1").select("lo", "hi")
        if code == "2C":
            return met(self.shared(3, 3).filter("n >= 2").select("lo", "hi"), self.shared(2, 2), ["lo", "hi"], "left_anti")
        return super()._candidates(code)

    def shared(self, a: int, b: int) -> DataFrame:
        name = f"_shared{a}{b}"
        if name not in self.made:
            left, right = reach(self.classes, a).toDF("i", "anc"), reach(self.classes, b).toDF("j", "anc")
            both = met(left, right, "anc").filter("i <= j" if a == b else "true")
            # Two of one class meet in both directions, which a pair of the class with itself stands for at once.
            each = F.lit(1) if a == b else F.when(F.col("lo") == F.col("hi"), 2).otherwise(1)
            self.made[name] = kept(canonical(both, "i", "j").groupBy("lo", "hi").agg(F.sum(each).alias("n")))
        return self.made[name]


def count_pairs_distinct(ped: Pedigree, max_degree: int = 5, n_threads: int | None = None) -> DataFrame:
    """(code, n) by distinct shared ancestors; all categories at once. n_threads is accepted for callers' sake: Spark spreads the joins itself."""
    warnings.warn("count_pairs_distinct is experimental and may change", FutureWarning, stacklevel=2)
    if max_degree != 5:
        raise NotImplementedError("count_pairs_distinct counts max_degree=5 only")
    if ped.sample is not None:
        raise NotImplementedError("count_pairs_distinct can't count a from_subsample pedigree")
    found = ped.__dict__.setdefault("_distinct_rules", DistinctRules(ped))
    exact = rules(ped)
    own = [c for c in (*SUBTRACT, "1C", "H1C", "2C") if c not in COLLATERAL]
    told = lambda found, codes: found.coded(codes).groupBy("code").agg(F.sum(weight()).alias("n"))
    return with_all_codes(ped, _counted_in_groups(ped, CODES).unionByName(told(exact, COLLATERAL)).unionByName(told(found, dict.fromkeys(own))))
