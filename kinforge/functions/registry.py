"""The 23 relationship categories and what follows from them."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession


class Relationship(NamedTuple):
    code: str
    up: int
    down: int
    n_anc: int
    label: str
    #: The scalar counter's figure is exact.
    scalar_exact: bool
    #: The distinct-ancestor counter may differ under inbreeding.
    distinct_diverges: bool

    @property
    def kinship(self) -> float:
        return 0.5 if self.n_anc == 0 else self.n_anc * 0.5 ** (self.up + self.down + 1)

    @property
    def degree(self) -> int:
        # Kinship 2 ** -(degree + 1); identical twins are degree 0.
        return 0 if self.n_anc == 0 else self.up + self.down - (self.n_anc == 2)


# Code, meioses up and down, shared ancestors, label, exact in the scalar counter, diverging in the distinct counter.
REGISTRY = [
    Relationship("MZ", 0, 0, 0, "MZ twin", True, False),
    Relationship("MO", 1, 0, 1, "Mother-offspring", True, False),
    Relationship("FO", 1, 0, 1, "Father-offspring", True, False),
    Relationship("FS", 1, 1, 2, "Full sib", True, False),
    Relationship("MHS", 1, 1, 1, "Maternal half sib", True, False),
    Relationship("PHS", 1, 1, 1, "Paternal half sib", True, False),
    Relationship("GP", 2, 0, 1, "Grandparent", True, False),
    Relationship("Av", 1, 2, 2, "Avuncular", False, False),
    Relationship("GGP", 3, 0, 1, "Great-grandparent", True, False),
    Relationship("HAv", 1, 2, 1, "Half-avuncular", False, False),
    Relationship("GAv", 1, 3, 2, "Great-avuncular", False, False),
    Relationship("1C", 2, 2, 2, "1st cousin", False, False),
    Relationship("GGGP", 4, 0, 1, "Great²-grandparent", True, False),
    Relationship("HGAv", 1, 3, 1, "Half-great-avuncular", False, False),
    Relationship("GGAv", 1, 4, 2, "Great²-avuncular", False, False),
    Relationship("H1C", 2, 2, 1, "Half-1st-cousin", False, False),
    Relationship("1C1R", 2, 3, 2, "1st cousin 1R", False, True),
    Relationship("G3GP", 5, 0, 1, "Great³-grandparent", True, False),
    Relationship("HGGAv", 1, 4, 1, "Half-great²-avuncular", False, False),
    Relationship("G3Av", 1, 5, 2, "Great³-avuncular", False, False),
    Relationship("H1C1R", 2, 3, 1, "Half-1st-cousin 1R", False, True),
    Relationship("1C2R", 2, 4, 2, "1st cousin 2R", False, True),
    Relationship("2C", 3, 3, 2, "2nd cousin", False, True),
]
CODES = [r.code for r in REGISTRY]
BY_CODE = {r.code: r for r in REGISTRY}
PAIR_KINSHIP = {r.code: r.kinship for r in REGISTRY}
SCALAR_EXACT = {r.code for r in REGISTRY if r.scalar_exact}
SCALAR_APPROXIMATE = set(CODES) - SCALAR_EXACT
DISTINCT_DIVERGENT = {r.code for r in REGISTRY if r.distinct_diverges}


class EngineSupport(NamedTuple):
    """What the counters beside the exact one make of a category."""

    streaming_exact: bool
    bfs_diverges_under_inbreeding: bool


REL_PLAN = {r.code: EngineSupport(r.scalar_exact, r.distinct_diverges) for r in REGISTRY}


def streaming_exact_codes() -> frozenset[str]:
    return frozenset(SCALAR_EXACT)


def streaming_approximate_codes() -> frozenset[str]:
    return frozenset(SCALAR_APPROXIMATE)


def bfs_divergent_codes() -> frozenset[str]:
    return frozenset(DISTINCT_DIVERGENT)


def check_degree(max_degree: int) -> int:
    if not isinstance(max_degree, int) or isinstance(max_degree, bool) or not 0 <= max_degree <= 5:
        raise ValueError(f"max_degree must be in 0..5, not {max_degree!r}")
    return max_degree


def registry(spark: SparkSession) -> DataFrame:
    """23 rows: code, label, up_meioses, down_meioses, n_anc, kinship, degree, streaming_exact, bfs_diverges."""
    rows = [(r.code, r.label, r.up, r.down, r.n_anc, r.kinship, r.degree, r.scalar_exact, r.distinct_diverges) for r in REGISTRY]
    return spark.createDataFrame(rows, "code string, label string, up_meioses int, down_meioses int, n_anc int, kinship double, degree int, streaming_exact boolean, bfs_diverges boolean").coalesce(1)
