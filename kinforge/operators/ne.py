"""Effective population size: eight estimators, each a series table and a one-row summary."""

from __future__ import annotations

import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.store import kept
from ..sources.pedigree import Pedigree
from . import cohort as C
from . import results as N
from .classes import BITS, met, size
from .kinship import inbreeding, mean_kinship, spine, theta_per_generation
from .reach import ancestors, contributions, eqg


def harmonic(x: Column) -> Column:
    """The harmonic mean of the positive values; null if there are none."""
    return F.count_if(x > 0) / F.sum(F.when(x > 0, 1 / x))


def _per_transition(x: Column, previous: Column) -> Column:
    """1 / (2 * rate) where the rate (x - previous) / (1 - previous) is positive."""
    rate = F.when(previous < 1, (x - previous) / (1 - previous))
    return F.when(rate > 0, 1 / (2 * rate))


def rate_series(x: DataFrame, value: str, first: float | None = None) -> DataFrame:
    """x (generation, value) with ne; first: what stands before generation 1."""
    before = F.lag(value).over(Window.orderBy("generation"))  # as many rows as generations
    if first is not None:
        before = F.when(F.col("generation") == 1, F.lit(first)).otherwise(before)
    return x.withColumn("_before", before).select("generation", F.when(F.col("generation") >= 1, _per_transition(F.col(value), F.col("_before"))).alias("ne"), value)


def rate_summary(series: DataFrame, value: str) -> DataFrame:
    """One row (ne, slope, n_generations_used) from the regression of ln(1 - value) on generations from 1 on."""
    usable = (F.col("generation") >= 1) & (F.col(value) < 1)
    y, t = F.when(usable, F.ln(1 - F.col(value))), F.when(usable, F.col("generation").cast("double"))
    one = series.agg(F.regr_slope(y, t).alias("slope"), F.count(y).cast("int").alias("n_generations_used"))
    return one.select(F.when(F.col("slope") < 0, -1 / (2 * F.col("slope"))).alias("ne"), "slope", "n_generations_used")


def mean_f(ped: Pedigree) -> DataFrame:
    """(generation, mean_f): 0 for a generation without members."""
    f = met(ped.people.select("row", "generation"), inbreeding(ped).select("row", "f"), "row").groupBy("generation").agg(F.avg("f").alias("mean_f"))
    return spine(ped).join(f, "generation", "left").select("generation", F.coalesce("mean_f", F.lit(0.0)).alias("mean_f"))


def inbreeding_series(ped: Pedigree) -> DataFrame:
    return rate_series(mean_f(ped), "mean_f")


def coancestry_series(ped: Pedigree, theta: DataFrame | None = None) -> DataFrame:
    return rate_series(theta if theta is not None else theta_per_generation(ped), "theta")


def delta_f_series(ped: Pedigree) -> DataFrame:
    """(generation, ne, mean_eqg, n_used)."""
    each = met(met(ped.people.select("row", "generation"), inbreeding(ped).select("row", "f"), "row"), eqg(ped).select("row", F.col("value").alias("eqg")), "row").filter("eqg > 1 AND f < 1")
    told = each.withColumn("df", 1 - F.pow(1 - F.col("f"), 1 / (F.col("eqg") - 1))).groupBy("generation").agg(F.avg("df").alias("df"), F.avg("eqg").alias("mean_eqg"), F.count(F.lit(1)).alias("n"))
    return spine(ped).join(told, "generation", "left").select("generation", F.when(F.col("df") > 0, 1 / (2 * F.col("df"))).alias("ne"), "mean_eqg", F.coalesce("n", F.lit(0)).cast("long").alias("n_used"))


def family_table(ped: Pedigree) -> DataFrame:
    """(row, sex, generation, birth_year, k_m, k_f): each individual's lifetime offspring by their sex, as a father (sex 1) or mother (sex 0)."""
    if "_families" not in ped.__dict__:
        kids = met(ped.edges, ped.people.select(F.col("row").alias("child"), F.col("sex").alias("ks")), "child")
        counts = kids.groupBy("parent", "side").agg(F.count_if(F.col("ks") == 1).alias("k_m"), F.count_if(F.col("ks") != 1).alias("k_f"))
        own = ped.people.filter("sex IN (0, 1)").select("row", "sex", "generation", "birth_year", F.when(F.col("sex") == 1, "f").otherwise("m").alias("side"))
        joined = met(own, counts.withColumnRenamed("parent", "row"), ["row", "side"], "left")
        ped._families = kept(joined.select("row", "sex", "generation", "birth_year", F.coalesce("k_m", F.lit(0)).cast("long").alias("k_m"), F.coalesce("k_f", F.lit(0)).cast("long").alias("k_f")))
    return ped._families


def variance_terms(families: DataFrame, cohort: str) -> DataFrame:
    """By cohort with two of each sex at least: variances and covariances of offspring counts, means and numbers."""
    aggs = []
    for name, sex in (("m", 1), ("f", 0)):
        a, b = F.when(F.col("sex") == sex, F.col("k_m")), F.when(F.col("sex") == sex, F.col("k_f"))
        aggs += [F.var_samp(a).alias(f"v_{name}m"), F.var_samp(b).alias(f"v_{name}f"), F.covar_samp(a, b).alias(f"cov_{name}"), F.avg(a + b).alias(f"kbar_{name}"), F.count(a).alias(f"n_{name}")]
    return families.groupBy(cohort).agg(*aggs).filter("n_m >= 2 AND n_f >= 2")


def variance_series(ped: Pedigree) -> DataFrame:
    """(generation, ne, v_mm, v_mf, v_fm, v_ff, cov_m, cov_f) for generations before the last."""
    terms = variance_terms(family_table(ped), "generation").filter("kbar_m > 0 AND kbar_f > 0")
    vm, vf = F.expr("v_mm + v_mf + 2 * cov_m"), F.expr("v_fm + v_ff + 2 * cov_f")
    df = (vm / F.col("kbar_m")) / (4 * F.col("n_m") * F.col("kbar_m")) + (vf / F.col("kbar_f")) / (4 * F.col("n_f") * F.col("kbar_f"))
    told = terms.withColumn("df", df).select("generation", F.when(F.col("df") > 0, 1 / (2 * F.col("df"))).alias("ne"), "v_mm", "v_mf", "v_fm", "v_ff", "cov_m", "cov_f")
    return spine(ped).filter(F.col("generation") < ped.last_generation).join(told, "generation", "left")


def sex_ratio_series(ped: Pedigree) -> DataFrame:
    """(generation, ne, n_male, n_female)."""
    counts = ped.people.groupBy("generation").agg(F.count_if(F.col("sex") == 1).alias("m"), F.count_if(F.col("sex") == 0).alias("f"))
    told = spine(ped).join(counts, "generation", "left").select("generation", F.coalesce("m", F.lit(0)).alias("n_male"), F.coalesce("f", F.lit(0)).alias("n_female"))
    both = (F.col("n_male") > 0) & (F.col("n_female") > 0)
    return told.select("generation", F.when(both, 4.0 * F.col("n_male") * F.col("n_female") / (F.col("n_male") + F.col("n_female"))).alias("ne"), "n_male", "n_female")


def founder_shares(ped: Pedigree) -> DataFrame:
    """(generation, founder, mean): the mean genome share from each founder (generation 0), where it is not 0."""
    if "_founder_shares" not in ped.__dict__:
        founders = ped.people.filter("generation = 0").select(F.col("row").alias("founder"))
        sizes = ped.people.groupBy("generation").agg(F.count(F.lit(1)).alias("n"))
        w = met(contributions(ped).select("generation", F.col("row").alias("founder"), "w"), founders, "founder", "left_semi")
        ped._founder_shares = kept(w.join(sizes, "generation").select("generation", "founder", (F.col("w") / F.col("n")).alias("mean")))
    return ped._founder_shares


def founder_means(ped: Pedigree) -> DataFrame:
    """(generation, founder, mean): founder_shares with its zeros, for generations with members. As large as generations times founders: only to be looked at."""
    founders = ped.people.filter("generation = 0").select(F.col("row").alias("founder"))
    every = ped.people.select("generation").distinct().crossJoin(founders)
    return met(every, founder_shares(ped), ["generation", "founder"], "left").select("generation", "founder", F.coalesce("mean", F.lit(0.0)).alias("mean"))


def long_term_summary(ped: Pedigree, tol: float = 1e-6, mean_contributions: DataFrame | None = None) -> DataFrame:
    """One row (ne, asymptote_reached, n_iterations, max_delta_final, sum_c_squared). mean_contributions: founder_shares() or founder_means() made before."""
    means = founder_shares(ped) if mean_contributions is None else mean_contributions
    # Each step from one generation with members to the next: the largest change of a founder's share, absent shares being 0.
    there = ped.people.select("generation").distinct()
    steps = there.join(there.select((F.col("generation") + 1).alias("generation")), "generation").crossJoin(F.broadcast(means.limit(1).select(F.lit(0.0).alias("none"))))  # one row, or none without founders
    signed = means.union(means.select(F.col("generation") + 1, "founder", -F.col("mean")))
    change = signed.groupBy("generation", "founder").agg(F.abs(F.sum("mean")).alias("d")).groupBy("generation").agg(F.max("d").alias("d"))
    steps = steps.join(change, "generation", "left").select("generation", F.coalesce("d", "none").alias("delta"))
    told = steps.agg(F.min(F.when(F.col("delta") < tol, F.col("generation"))).alias("stop"), F.max("generation").alias("last"))
    at = told.select(F.coalesce("stop", "last", F.lit(0)).alias("g"), F.col("stop").isNotNull().alias("reached"))
    squares = means.groupBy(F.col("generation").alias("g")).agg(F.sum(F.col("mean") * F.col("mean")).alias("c2"))
    one = at.join(F.broadcast(squares), "g", "left").join(F.broadcast(steps.withColumnRenamed("generation", "g")), "g", "left")  # a row a generation
    c2 = F.coalesce("c2", F.lit(0.0))
    return one.select(F.when(F.col("reached") & (c2 > 0), 1 / (2 * c2)).alias("ne"), F.col("reached").alias("asymptote_reached"), F.col("g").cast("int").alias("n_iterations"), F.col("delta").alias("max_delta_final"), c2.alias("sum_c_squared"))


def caballero_toro_accumulators(ped: Pedigree) -> DataFrame:
    """(generation, founder, sums, n): summed self-coancestry and number of a founder's descendants (itself included) by generation."""
    if "_ct" not in ped.__dict__:
        founders = ped.people.filter("generation = 0").select(F.col("row").alias("founder"))
        below = met(ancestors(ped).select(F.col("desc").alias("row"), F.col("anc").alias("founder")), founders, "founder", "left_semi").withColumn("n", size("row"))
        # Rows of generation 0 hold themselves only.
        inside = below.select(F.shiftright("row", BITS).alias("row"), "founder", "n").union(founders.select(F.col("founder").alias("row"), "founder", F.lit(1)))
        own = met(ped.people.select("row", "generation"), inbreeding(ped).select("row", "f"), "row")
        each = met(inside, own, "row").filter("generation > 0 OR row = founder")
        ped._ct = kept(each.groupBy("generation", "founder").agg(F.sum(F.col("n") * (1 + F.col("f")) / 2).alias("sums"), F.sum("n").alias("n")))
    return ped._ct


def caballero_toro_series(ped: Pedigree, ct_accumulators: DataFrame | None = None) -> DataFrame:
    """(generation, ne, mean_self_coancestry, n_founders): from generation 1 on; before it 0.5 stands. ct_accumulators: caballero_toro_accumulators() made before."""
    told = (caballero_toro_accumulators(ped) if ct_accumulators is None else ct_accumulators).filter("generation > 0").groupBy("generation").agg(F.avg(F.col("sums") / F.col("n")).alias("mean_self_coancestry"), F.count(F.lit(1)).alias("n_founders"))
    full = spine(ped).join(told, "generation", "left").select("generation", "mean_self_coancestry", F.coalesce("n_founders", F.lit(0)).cast("long").alias("n_founders"))
    return rate_series(full, "mean_self_coancestry", 0.5).join(full.select("generation", "n_founders"), "generation")


def hill_cohorts(ped: Pedigree, vk_scale: bool = False) -> DataFrame:
    """(cohort, ne, ne_m, ne_f, vk_m, vk_f, kbar_m, kbar_f, n1_m, n1_f) for eligible birth years."""
    window, interval = C.eligible_cohort_window(ped), C.generation_interval(ped).select("t")
    known = family_table(ped).filter("birth_year IS NOT NULL")
    terms = variance_terms(known, "birth_year").crossJoin(F.broadcast(window)).crossJoin(F.broadcast(interval)).filter("birth_year BETWEEN c_min AND c_max")  # one row each
    for s in ("m", "f"):
        raw = F.expr(f"v_{s}m + v_{s}f + 2 * cov_{s}")
        k = F.col(f"kbar_{s}")
        terms = terms.withColumn(f"vk_{s}", F.when(k > 0, 2 * (1 + (2 / k) * (raw / k - 1))).otherwise(raw) if vk_scale else raw)
    usable = terms.filter("vk_m + 2 > 0 AND vk_f + 2 > 0")
    for s in ("m", "f"):
        usable = usable.withColumn(f"ne_{s}", 4.0 * F.col(f"n_{s}") * F.col("t") / (F.col(f"vk_{s}") + 2))
    usable = usable.filter("ne_m + ne_f > 0")
    return usable.select(F.col("birth_year").alias("cohort"), (4 * F.col("ne_m") * F.col("ne_f") / (F.col("ne_m") + F.col("ne_f"))).alias("ne"), "ne_m", "ne_f", "vk_m", "vk_f", "kbar_m", "kbar_f", F.col("n_m").alias("n1_m"), F.col("n_f").alias("n1_f"))


def hill_summary(ped: Pedigree, vk_scale: bool = False) -> DataFrame:
    """One row of scalars: harmonic means over cohorts, mean terms, the window and the numbers left out."""
    means = [F.avg(c).alias(c) for c in ("n1_m", "n1_f", "vk_m", "vk_f", "kbar_m", "kbar_f")]
    told = hill_cohorts(ped, vk_scale).agg(harmonic(F.col("ne")).alias("ne"), harmonic(F.col("ne_m")).alias("ne_m"), harmonic(F.col("ne_f")).alias("ne_f"), *means, F.count(F.lit(1)).cast("int").alias("n_eligible_cohorts"))
    window = C.eligible_cohort_window(ped)
    left = ped.people.select("birth_year").crossJoin(F.broadcast(window)).agg(
        F.count_if(F.col("birth_year") < F.col("c_min")).cast("int").alias("n_left"), F.count_if(F.col("birth_year") > F.col("c_max")).cast("int").alias("n_right"), F.count_if(F.col("birth_year").isNull()).cast("int").alias("n_unknown"))
    return reduce(lambda a, b: a.crossJoin(b), [told, C.generation_interval(ped), window, left])


def warn_uniform_sex(ped: Pedigree, name: str) -> None:
    r = ped.people.agg(F.min("sex").alias("a"), F.max("sex").alias("b"), F.count(F.lit(1)).alias("n")).first()
    if r["n"] and r["a"] == r["b"]:
        warnings.warn(f"{name}: sex is uniform ({r['a']}); was sex left out?", RuntimeWarning, stacklevel=3)


def _harmonic_summary(series: DataFrame) -> DataFrame:
    return series.agg(harmonic(F.col("ne")).alias("ne"))


def _told(summary: DataFrame, series: DataFrame, key: str = "generation") -> tuple[dict, dict[str, list]]:
    """The summary's one row, and the series' columns in order of its key: as many rows as generations or cohorts."""
    rows = [r.asDict() for r in series.orderBy(key).collect()]
    return summary.first().asDict(), {c: [r[c] for r in rows] for c in series.columns}


def ne_inbreeding(ped: Pedigree) -> N.NeInbreedingResult:
    s = inbreeding_series(ped)
    one, by = _told(rate_summary(s, "mean_f"), s)
    return N.NeInbreedingResult(one["ne"], by["ne"], by["mean_f"], one["slope"], one["n_generations_used"])


def ne_coancestry(ped: Pedigree, K: DataFrame | None = None, theta_per_gen: DataFrame | None = None) -> N.NeCoancestryResult:
    """theta_per_gen (generation, theta), else K, a kinship table made before, else mean kinship computed without one."""
    if theta_per_gen is None and K is not None:
        theta_per_gen = mean_kinship(ped, K)
    s = coancestry_series(ped, theta_per_gen)
    one, by = _told(rate_summary(s, "theta"), s)
    return N.NeCoancestryResult(one["ne"], by["ne"], by["theta"], one["slope"], one["n_generations_used"])


def ne_individual_delta_f(ped: Pedigree) -> N.NeIndividualDeltaFResult:
    s = delta_f_series(ped)
    one, by = _told(_harmonic_summary(s), s)
    return N.NeIndividualDeltaFResult(one["ne"], by["ne"], by["mean_eqg"], by["n_used"])


def ne_variance_family_size(ped: Pedigree) -> N.NeVarianceResult:
    warn_uniform_sex(ped, "ne_variance_family_size")
    s = variance_series(ped)
    one, by = _told(_harmonic_summary(s), s)
    return N.NeVarianceResult(one["ne"], by["ne"], *[by[c] for c in ("v_mm", "v_mf", "v_fm", "v_ff", "cov_m", "cov_f")])


def ne_sex_ratio(ped: Pedigree) -> N.NeSexRatioResult:
    warn_uniform_sex(ped, "ne_sex_ratio")
    s = sex_ratio_series(ped)
    one, by = _told(_harmonic_summary(s), s)
    return N.NeSexRatioResult(one["ne"], by["ne"], by["n_male"], by["n_female"])


def ne_long_term_contributions(ped: Pedigree, mean_contributions: DataFrame | None = None, tol: float = 1e-6) -> N.NeLTCResult:
    return N.NeLTCResult(**long_term_summary(ped, tol, mean_contributions).first().asDict())


def ne_hill_overlapping(ped: Pedigree, vk_scale: bool = False) -> N.NeHillResult:
    """Without birth years, or where a side has no dated links, this is ne_variance_family_size with an interval of 1."""
    if not ped.has_birth_year or C.generation_interval_record(ped) is None:
        return N.NeHillResult(ne_variance_family_size(ped).ne, 1.0, True)
    one, by = _told(hill_summary(ped, vk_scale), hill_cohorts(ped, vk_scale), "cohort")
    ages: dict[str, list[int]] = {"ages_m": [], "offspring_count_m": [], "ages_f": [], "offspring_count_f": []}
    for r in C.age_table(ped).orderBy("side", "age").collect():  # distinct ages; the links' side names mothers m, the record male parents
        sex = "f" if r["side"] == "m" else "m"
        ages[f"ages_{sex}"].append(r["age"])
        ages[f"offspring_count_{sex}"].append(r["n"])
    means = {name: one[name.lower()] for name in ("N1_m", "N1_f", "Vk_m", "Vk_f", "kbar_m", "kbar_f", "Ne_m", "Ne_f")}
    series = {f"{name}_per_cohort": by[name.lower()] for name in ("ne", "Ne_m", "Ne_f", "Vk_m", "Vk_f", "N1_m", "N1_f")}
    return N.NeHillResult(
        one["ne"], one["t"], False, one["t_m"], one["t_f"], **means, vk_scaled=vk_scale, cohort_window=C.CohortWindow(one["c_min"], one["c_max"], one["reproductive_age_p95"]), n_eligible_cohorts=one["n_eligible_cohorts"],
        n_excluded_right_censored=one["n_right"], n_excluded_left_censored=one["n_left"], n_unknown_birth_year=one["n_unknown"], cohort_years=by["cohort"], **series, age_table=ages, n_offspring_pairs=one["n_edges"],
    )


def ne_caballero_toro(ped: Pedigree, ct_accumulators: DataFrame | None = None) -> N.NeCaballeroToroResult:
    s = caballero_toro_series(ped, ct_accumulators)
    one, by = _told(rate_summary(s, "mean_self_coancestry"), s)
    return N.NeCaballeroToroResult(one["ne"], by["ne"], by["mean_self_coancestry"], by["n_founders"], one["slope"])


ESTIMATORS = [ne_inbreeding, ne_coancestry, ne_variance_family_size, ne_sex_ratio, ne_individual_delta_f, ne_long_term_contributions, ne_hill_overlapping, ne_caballero_toro]


def compute_all_ne(ped: Pedigree, skip_ne_coancestry: bool = False, n_threads: int = 1, hill_vk_scale: bool = False) -> dict[str, N.Record]:
    """All estimators over the same kept tables. n_threads is accepted for callers' sake: Spark runs each job's tasks side by side itself."""
    if n_threads < 1:
        raise ValueError("n_threads must be >= 1")
    out: dict[str, N.Record] = {}
    for estimate in ESTIMATORS:
        if estimate is ne_coancestry and skip_ne_coancestry:
            out["ne_coancestry"] = N.NeCoancestryResult.empty(ped.last_generation)
        else:
            out[estimate.__name__] = estimate(ped, hill_vk_scale) if estimate is ne_hill_overlapping else estimate(ped)
    return out


def all_scalars(ped: Pedigree) -> DataFrame:
    """(estimator, ne): the eight scalars in one table."""
    parts = {
        "ne_inbreeding": rate_summary(inbreeding_series(ped), "mean_f"), "ne_coancestry": rate_summary(coancestry_series(ped), "theta"), "ne_variance_family_size": _harmonic_summary(variance_series(ped)), "ne_sex_ratio": _harmonic_summary(sex_ratio_series(ped)),
        "ne_individual_delta_f": _harmonic_summary(delta_f_series(ped)), "ne_long_term_contributions": long_term_summary(ped), "ne_hill_overlapping": hill_summary(ped), "ne_caballero_toro": rate_summary(caballero_toro_series(ped), "mean_self_coancestry"),
    }
    return reduce(lambda a, b: a.union(b), [p.select(F.lit(k).alias("estimator"), F.col("ne").cast("double").alias("ne")) for k, p in parts.items()])
