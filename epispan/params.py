"""Study descriptors: column names, calendar waves, experiments and run parameters."""

from __future__ import annotations

import datetime as dt
import itertools
from dataclasses import dataclass, field

HISTORICAL = "prepandemic_control_fu"
CONCURRENT = "equal_control_fu"
TEST_NEGATIVE = "tested_positive_vs_negative"
DESIGNS = (HISTORICAL, CONCURRENT, TEST_NEGATIVE)
SUBSETS = (None, "hospital", "tested")
COMPOSITE = "composite"


@dataclass(frozen=True)
class PersonColumns:
    """Column names of the one-row-per-person date table."""

    id: str = "patient_id"
    birth: str = "birth_date"
    positive: str = "date_first_tested_positive"
    diagnosis: str = "date_first_covid_diagnosis"
    tested: str = "date_first_tested"
    hospitalized: str = "hospitalized_due_to_covid"
    death: str = "death_date"
    censoring: str = "censoring_global"
    endpoints: tuple[tuple[str, str], ...] = (
        ("ad", "date_first_ad_diagnosis"),
        ("pd", "date_first_pd_diagnosis"),
        ("unspecified_dementia", "date_first_unspecified_dementia_diagnosis"),
    )

    @property
    def exposure_dates(self) -> tuple[str, str]:
        return (self.positive, self.diagnosis)

    @property
    def endpoint_map(self) -> dict[str, str]:
        return dict(self.endpoints)

    @property
    def date_columns(self) -> list[str]:
        return [
            self.birth,
            self.positive,
            self.diagnosis,
            self.tested,
            *(column for _, column in self.endpoints),
            self.death,
            self.censoring,
        ]


@dataclass(frozen=True)
class Wave:
    """Closed calendar range; ``last`` is None when open ended."""

    name: str | None
    first: dt.date
    last: dt.date | None = None


# Calendar waves of the studied pandemic.
DEFAULT_WAVES = (
    Wave(None, dt.date(2020, 1, 1)),
    Wave("first_wave", dt.date(2020, 1, 1), dt.date(2020, 8, 31)),
    Wave("second_wave", dt.date(2020, 9, 1), dt.date(2021, 5, 31)),
    Wave("third_wave", dt.date(2021, 6, 1), dt.date(2021, 11, 30)),
    Wave("omicron_wave", dt.date(2021, 12, 1), dt.date(2022, 6, 30)),
)


@dataclass(frozen=True)
class Experiment:
    endpoint: str
    wave: str | None
    design: str
    subset: str | None = None

    def __post_init__(self) -> None:
        if self.design not in DESIGNS:
            raise ValueError(f"Unknown control group design: {self.design}")
        if self.subset not in SUBSETS:
            raise ValueError(f"Unknown subset: {self.subset}")

    @property
    def name(self) -> str:
        parts = (self.endpoint, self.wave, self.design, self.subset)
        return "_".join(part for part in parts if part)


@dataclass(frozen=True)
class CohortParams:
    """Settings of the cohort stage.

    ``min_age_unit='years'`` compares the age in years; ``'days'`` compares the raw day count.
    """

    seed: int = 1234
    min_age: float = 70.0
    min_age_unit: str = "years"
    historical_cutoff: dt.date = dt.date(2019, 12, 31)
    waves: tuple[Wave, ...] = DEFAULT_WAVES

    def wave(self, name: str | None) -> Wave:
        for wave in self.waves:
            if wave.name == name:
                return wave
        raise ValueError(f"Unknown wave: {name}")


# Default codes, fields and sentinels of the biobank adapter.
BIOBANK_FIELDS = {
    "31": "sex",
    "6138": "education",
    "21001": "bmi",
    "1239": "smoking_curr",
    "1249": "smoking_prev",
    "93": "blood_pressure_systolic_manual",
    "4080": "blood_pressure_systolic_automatic",
    "94": "blood_pressure_diastolic_manual",
    "4079": "blood_pressure_diastolic_automatic",
    "1160": "sleep_duration",
    "1200": "sleep_insomnia",
    "738": "income",
    "26410": "deprivation_england",
    "26426": "deprivation_wales",
    "26427": "deprivation_scotland",
    "24003": "no2",
    "24008": "pm2510",
}
BIOBANK_VISIT_FIELD = "53"
BIOBANK_MISSING = (-1, -3, -7)
BIOBANK_ONE_HOT = ("education", "smoking_curr", "smoking_prev", "sleep_insomnia", "income")
BIOBANK_PATTERNS = {
    "diabetes": "E11.*",
    "hearing_impairment": "H9[01].*",
    "depression": "F3[23].*",
    "cardiovascular_disease": "I.*",
    "obesity": "E66.*",
}


@dataclass(frozen=True)
class HazardParams:
    """Learner of the discrete-time hazards: ``logistic``, ``boosted`` (competing risks by histograms) or ``gbt`` (Spark ML).

    The boosting values apply to the last two. A depth above the limit of ``gbt`` raises.
    """

    learner: str = "logistic"
    n_iter: int = 125
    learning_rate: float = 0.013
    max_depth: int = 3
    min_samples_leaf: int = 49
    reg_param: float = 1e-3
    logistic_iter: int = 50
    logistic_tol: float = 1e-9


@dataclass(frozen=True)
class FitParams:
    """Settings of the estimation stage."""

    seed: int = 1234
    exclude_columns: tuple[str, ...] = ("patient_id", "index_date", "covid_vaccine")
    subset_condition: str | None = "event_time > 30"
    control_subsample_factor: float | None = None
    match: bool = True
    caliper: float = 0.2
    caliper_unit: str = "absolute"
    match_grid_search: bool = True
    match_calibrate: bool = True
    n_folds_outer: int = 5
    n_folds_inner: int = 3
    n_trials: int = 100
    tune: bool = True
    #: Folder of the trial table; a run that finds trials of its folds there goes on with them.
    trial_path: str | None = None
    eval_metric: str = "c_antolini_all"
    target_times: tuple[float, ...] = (100, 200, 300, 400, 500, 600, 700)
    max_updates: int = 500
    grid_size: int = 100
    nuisance_bound: float = 0.02
    propensity_calibration: str | None = None
    hazard: HazardParams = field(default_factory=HazardParams)
    hte_quantile: float = 0.05
    hte_ceiling: float = 0.5
    #: Quantile bins of the event time in the benchmark of E-values.
    benchmark_bins: int = 22
    contour_strengths: tuple[float, ...] = (1.0, 1.25, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0, 7.5, 10.0)


def experiment_table(
    endpoints=("ad", "pd", "unspecified_dementia", COMPOSITE),
    waves=("first_wave", "second_wave", "third_wave"),
    arms=((HISTORICAL, "hospital"), (HISTORICAL, "tested"), (TEST_NEGATIVE, None)),
) -> list[Experiment]:
    """All combinations of endpoint, wave and (design, subset)."""
    return [
        Experiment(endpoint, wave, design, subset)
        for endpoint, wave, (design, subset) in itertools.product(endpoints, waves, arms)
    ]
