"""What the effective-size estimators return: one frozen record each, its series as lists by generation, transition or cohort; undefined values are None."""

from __future__ import annotations

import math
from dataclasses import dataclass, fields
from typing import Any

from .cohort import CohortWindow

Series = list[float | None]


class Record:
    """to_dict() for the records: plain Python values, ready for YAML or JSON."""

    def to_dict(self) -> dict[str, Any]:
        return {f.name: _plain(getattr(self, f.name)) for f in fields(self)}


def _plain(value: Any) -> Any:
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    if isinstance(value, tuple) and hasattr(value, "_asdict"):
        return _plain(value._asdict())
    return [_plain(v) for v in value] if isinstance(value, (list, tuple)) else value


@dataclass(frozen=True)
class NeInbreedingResult(Record):
    ne: float | None
    ne_per_gen: Series
    mean_f_per_gen: Series
    slope: float | None
    n_generations_used: int


@dataclass(frozen=True)
class NeCoancestryResult(Record):
    ne: float | None
    ne_per_gen: Series
    mean_theta_per_gen: Series
    slope: float | None
    n_generations_used: int

    @classmethod
    def empty(cls, g_max: int) -> NeCoancestryResult:
        """What stands for an estimator that was skipped: all undefined, a place for each generation."""
        return cls(None, [None] * (g_max + 1), [None] * (g_max + 1), None, 0)


@dataclass(frozen=True)
class NeVarianceResult(Record):
    ne: float | None
    ne_per_transition: Series
    v_mm: Series
    v_mf: Series
    v_fm: Series
    v_ff: Series
    cov_m: Series
    cov_f: Series


@dataclass(frozen=True)
class NeSexRatioResult(Record):
    ne: float | None
    ne_per_gen: Series
    n_male_per_gen: list[int]
    n_female_per_gen: list[int]


@dataclass(frozen=True)
class NeIndividualDeltaFResult(Record):
    ne: float | None
    ne_per_gen: Series
    mean_eqg_per_gen: Series
    n_used_per_gen: list[int]


@dataclass(frozen=True)
class NeLTCResult(Record):
    ne: float | None
    asymptote_reached: bool
    n_iterations: int
    max_delta_final: float | None
    sum_c_squared: float


@dataclass(frozen=True)
class NeHillResult(Record):
    """Where birth years are missing (collapses_to_ne_v) only the first three fields mean something."""

    ne: float | None
    generation_interval: float
    collapses_to_ne_v: bool
    T_m: float | None = None
    T_f: float | None = None
    N1_m: float | None = None
    N1_f: float | None = None
    Vk_m: float | None = None
    Vk_f: float | None = None
    kbar_m: float | None = None
    kbar_f: float | None = None
    Ne_m: float | None = None
    Ne_f: float | None = None
    vk_scaled: bool = False
    cohort_window: CohortWindow | None = None
    n_eligible_cohorts: int = 0
    n_excluded_right_censored: int = 0
    n_excluded_left_censored: int = 0
    n_unknown_birth_year: int = 0
    cohort_years: list[int] | None = None
    ne_per_cohort: Series | None = None
    Ne_m_per_cohort: Series | None = None
    Ne_f_per_cohort: Series | None = None
    Vk_m_per_cohort: Series | None = None
    Vk_f_per_cohort: Series | None = None
    N1_m_per_cohort: Series | None = None
    N1_f_per_cohort: Series | None = None
    age_table: dict[str, list[int]] | None = None
    n_offspring_pairs: int = 0


@dataclass(frozen=True)
class NeCaballeroToroResult(Record):
    ne: float | None
    ne_per_gen: Series
    mean_self_coancestry_per_gen: Series
    n_founders_with_descendants_per_gen: list[int]
    slope: float | None
