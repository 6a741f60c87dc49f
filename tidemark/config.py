"""Settings passed explicitly to the operators."""

from __future__ import annotations

from dataclasses import dataclass, field

# Competition names, rating offsets and weights.
TARGET_COMPETITION = "premier_league"
LEAGUE_COMPETITIONS = ("premier_league", "championship", "league_one")
COMPETITION_FILES = {
    "premier_league": "1-premierleague.txt",
    "championship": "2-championship.txt",
    "league_one": "3-league1.txt",
    "fa_cup": "facup.txt",
    "efl_cup": "eflcup.txt",
}
DIVISION_OFFSETS = {"premier_league": 0.0, "championship": -180.0, "league_one": -320.0}
OTHER_OFFSET = -250.0
COMPETITION_WEIGHTS = {
    "premier_league": 1.0,
    "championship": 1.0,
    "league_one": 1.0,
    "fa_cup": 0.6,
    "efl_cup": 0.5,
}
OTHER_WEIGHT = 0.5
EUROPEAN_TIERS = {"champions_league": 3.0, "europa_league": 2.0, "conference_league": 1.0}

FEATURE_VERSION = "2026.10.1"
CLASSES = ("H", "D", "A")


@dataclass(frozen=True)
class FeatureSettings:
    form_windows: tuple[int, ...] = (4, 6, 10)
    form_max_age_days: int = 120
    history_depth: int = 20
    pair_depth: int = 10
    pair_window: int = 6
    max_rest_days: int = 21
    max_tenure_days: int = 2000
    new_manager_matches: int = 6
    # When set, history rows dated on or after the fixture itself are ignored.
    strict_dates: bool = False


@dataclass(frozen=True)
class RatingSettings:
    k: float = 20.0
    home_advantage: float = 60.0
    regression: float = 0.25
    initial: float = 1500.0
    offsets: dict = field(default_factory=lambda: dict(DIVISION_OFFSETS))
    other_offset: float = OTHER_OFFSET
    weights: dict = field(default_factory=lambda: dict(COMPETITION_WEIGHTS))
    other_weight: float = OTHER_WEIGHT


@dataclass(frozen=True)
class OutcomeSettings:
    learning_rate: float = 0.04
    max_depth: int = 4
    min_rows_per_leaf: int = 60
    subsample: float = 0.85
    feature_share: float = 0.7
    seed: int = 7
    max_rounds: int = 1200
    min_rounds: int = 40
    fallback_rounds: int = 150
    patience: int = 60
    validation_fraction: float = 0.15
    min_probe_rows: int = 200
    min_validation_rows: int = 60
    blend_weight: float = 0.6
    inverse_regularisation: float = 0.5


@dataclass(frozen=True)
class RateSettings:
    time_decay: float = 0.0011
    max_goals: int = 8
    ridge: float = 0.35
    max_history_days: int = 1500
    competitions: tuple[str, ...] = ("premier_league", "championship")
    reference_competition: str = "premier_league"
    rho_limit: float = 0.35


FEATURES = FeatureSettings()
RATING = RatingSettings()
OUTCOME = OutcomeSettings()
RATES = RateSettings()
