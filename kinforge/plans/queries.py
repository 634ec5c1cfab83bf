"""The pedigree queries of the driver: each takes (spark, sf_dir) and reads the pedigree derived from the customer table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import registry as G
from ..operators import cohort, counts, kinship, ne, pairs, reach
from ..sources import derived
from ..sources.pedigree import Pedigree

Query = Callable[[SparkSession, str], DataFrame]


def _rounded(df: DataFrame) -> DataFrame:
    """Doubles rounded for comparison: summation order differs between engines. Ne's and sums to 6 places, others to 9."""
    places = {"ne": 6, "ne_m": 6, "ne_f": 6, "sums": 6}
    return df.select(*[F.round(c, 6 if c in places or "cohort" in df.columns else 9).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])


def _on(build: Callable[[Pedigree], DataFrame], source: Callable[[SparkSession, str], Pedigree] = derived.pedigree) -> Query:
    return lambda spark, sf_dir: _rounded(build(source(spark, sf_dir)))


def _of_code(code: str) -> Query:
    return _on(lambda ped: pairs.rules(ped).oriented(code))


QUERIES: dict[str, Query] = {
    "registry": lambda spark, sf_dir: G.registry(spark),
    "ped_resolved": _on(lambda p: p.people.select("row", "id", *[F.coalesce(c, F.lit(-1)).cast("long").alias(c) for c in ("m", "f", "tw")], "sex", "generation", "birth_year")),
    "edges": _on(lambda p: p.edges),
    "depth": _on(lambda p: reach.depth(p).select("id", "depth")),
    "n_ancestors": _on(lambda p: reach.n_ancestors(p).select("id", F.col("value").alias("n_ancestors"))),
    "n_descendants": _on(lambda p: reach.n_descendants(p).select("id", F.col("value").alias("n_descendants"))),
    "eqg": _on(lambda p: reach.eqg(p).select("id", F.col("value").alias("eqg"))),
    **{f"pairs_{c.lower()}": _of_code(c) for c in G.CODES},
    "sibling_pairs": _on(pairs.sibling_pairs),
    "extract_pairs": _on(lambda p: pairs.extract_pairs(p, 5)),
    "count_pairs": _on(lambda p: pairs.count_pairs(p, 5)),
    "count_pairs_deg2": _on(lambda p: pairs.count_pairs(p, 2)),
    "count_pairs_min_kinship": _on(lambda p: pairs.count_pairs(p, 5, min_kinship=0.06)),
    "pairs_subsample": _on(lambda p: pairs.extract_pairs(p, 2), derived.subsample),
    "count_pairs_subsample": _on(lambda p: pairs.count_pairs(p, 2), derived.subsample),
    "count_pairs_full_scope": _on(lambda p: pairs.count_pairs(p, 2, "full"), derived.subsample),
    "count_pairs_scalar": _on(lambda p: counts.count_pairs_scalar(p, 5)),
    "count_pairs_distinct": _on(counts.count_pairs_distinct),
    "inbreeding": _on(lambda p: kinship.inbreeding(p).select("id", "f")),
    "kinship_coo": _on(kinship.kinship),
    "kinship_max_degree": _on(lambda p: kinship.kinship(p, max_degree=2)),
    "theta_per_gen": _on(kinship.theta_per_generation),
    "pair_kinship": _on(lambda p: kinship.pair_kinship(p, pairs.extract_pairs(p, 2))),
    "pair_kinship_subsample": _on(lambda p: kinship.pair_kinship(p, pairs.extract_pairs(p, 2)), derived.subsample),
    "generation_interval": _on(cohort.generation_interval),
    "cohort_window": _on(cohort.eligible_cohort_window),
    "age_table": _on(cohort.age_table),
    "family_table": _on(ne.family_table),
    "sigma2_terms": _on(lambda p: ne.variance_terms(ne.family_table(p), "generation")),
    "ne_inbreeding": _on(ne.inbreeding_series),
    "ne_inbreeding_scalar": _on(lambda p: ne.rate_summary(ne.inbreeding_series(p), "mean_f")),
    "ne_coancestry": _on(ne.coancestry_series),
    "ne_coancestry_scalar": _on(lambda p: ne.rate_summary(ne.coancestry_series(p), "theta")),
    "ne_delta_f": _on(ne.delta_f_series),
    "ne_variance": _on(ne.variance_series),
    "ne_sex_ratio": _on(ne.sex_ratio_series),
    "founder_means": _on(ne.founder_means),
    "ne_ltc": _on(ne.long_term_summary),
    "ne_hill": _on(ne.hill_cohorts),
    "ne_hill_scaled": _on(lambda p: ne.hill_cohorts(p, True)),
    "ct_accumulators": _on(ne.caballero_toro_accumulators),
    "ne_caballero_toro": _on(ne.caballero_toro_series),
    "ne_caballero_toro_scalar": _on(lambda p: ne.rate_summary(ne.caballero_toro_series(p), "mean_self_coancestry")),
    "ne_all": _on(ne.all_scalars),
}
