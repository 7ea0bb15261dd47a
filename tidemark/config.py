"""Default constants of the stages, with their checks."""

from __future__ import annotations

from dataclasses import dataclass, field

# Lexicons of the content filter.
NOISE_MARKERS = ("ок", "кек", "ага", "лол", "test", "тест", "!!!", "...")
SPAM_SIGNATURES = (
    "подпишись", "подписывайтесь", "розыгрыш", "скидк", "купи", "покупай", "промокод", "доставка 24/7",
    "заработок", "переходи по ссылке", "пишите в директ", "в лс", "успей купить",
)
AD_HASHTAGS = ("#реклама", "#ad", "#sale", "#скидки", "#продам", "#магазин")
COMPLAINT_MARKERS = (
    "безобраз", "кошмар", "ужас", "опять", "никто не", "сколько можно", "почему до сих пор", "жалоб",
    "прошу разобраться", "не работает", "проблем",
)
RELEVANT_SHORT_MARKERS = ("пожар", "авар", "дтп", "света нет", "нет воды", "яма", "прорыв", "дым", "взрыв", "лифт", "мост", "отключ")

# Word endings that the stemmer strips, the first that fits wins.
ENDINGS = (
    "иями", "ями", "ами", "иях", "иях", "его", "ому", "ыми", "ими", "ого", "ему", "иях", "ах", "ях", "ий", "ый", "ой", "ая", "яя",
    "ое", "ее", "ые", "ие", "ам", "ям", "ом", "ем", "ов", "ев", "ую", "юю", "ой", "ей", "а", "я", "ы", "и", "у", "ю", "е", "о", "ь",
)


@dataclass(frozen=True)
class FilterConfig:
    min_text_length: int = 8
    min_meaningful_length: int = 20
    review_weight: float = 0.6
    velocity_threshold: int = 20
    near_velocity_threshold: int = 15
    author_burst_threshold: int = 10
    velocity_window_minutes: int = 30
    author_burst_window_minutes: int = 60
    bot_gap_seconds: int = 30
    noise_markers: tuple[str, ...] = NOISE_MARKERS
    spam_signatures: tuple[str, ...] = SPAM_SIGNATURES
    ad_hashtags: tuple[str, ...] = AD_HASHTAGS
    complaint_markers: tuple[str, ...] = COMPLAINT_MARKERS
    relevant_short_markers: tuple[str, ...] = RELEVANT_SHORT_MARKERS


@dataclass(frozen=True)
class DedupConfig:
    shingle_size: int = 5
    permutations: int = 64
    bands: int = 16
    threshold: float = 0.72

    def __post_init__(self):
        if min(self.shingle_size, self.permutations, self.bands) < 1:
            raise ValueError("shingle size, permutations and bands must be positive")
        if self.permutations % self.bands:
            raise ValueError("bands must divide permutations")
        if not 0 < self.threshold <= 1:
            raise ValueError("threshold must lie in (0, 1]")


MONITORING = {"volume": 0.25, "dynamics": 0.25, "sentiment": 0.20, "reach": 0.15, "geo": 0.10, "source": 0.05}
CRISIS = {"volume": 0.20, "dynamics": 0.30, "sentiment": 0.25, "reach": 0.15, "geo": 0.07, "source": 0.03}


@dataclass(frozen=True)
class RankingConfig:
    weights: dict[str, float] = field(default_factory=lambda: dict(MONITORING))
    periods: tuple[int, ...] = (6, 24, 72)
    top_n: int = 10
    min_cluster_size: int = 10
    stale_after_hours: int = 48
    new_cluster_hours: int = 3
    growing_threshold: float = 2.0
    geo_max_coverage_ratio: float = 0.3
    source_type_count: int = 4

    def __post_init__(self):
        if set(self.weights) != set(MONITORING):
            raise ValueError(f"weights must be given for {sorted(MONITORING)}")
        if any(w < 0 for w in self.weights.values()) or abs(sum(self.weights.values()) - 1) > 1e-9:
            raise ValueError("weights must not be negative and must sum to 1")
        if not self.periods or min(self.periods) < 1:
            raise ValueError("periods must be positive")


@dataclass(frozen=True)
class UrgencyConfig:
    critical_growth_rate: float = 5.0
    critical_new_size: int = 100
    critical_geo_spread: int = 5
    critical_sentiment: float = -0.6
    high_score_threshold: float = 0.7
    medium_score_threshold: float = 0.4


@dataclass(frozen=True)
class ClusterConfig:
    min_cluster_size: int = 10
    min_samples: int = 5
    assignment_threshold: float = 0.6
    reconcile_threshold: float = 0.85
    window_hours: int = 72
    growth_hours: int = 6


@dataclass(frozen=True)
class SummaryConfig:
    max_documents: int = 40
    max_tokens: int = 6000
    max_chars: int = 500
    max_per_author: int = 3
    sample_documents: int = 5
    retries: int = 2
    regenerate_growth: float = 0.3
    regenerate_age_hours: int = 6
    regenerate_rate: float = 2.0
    min_words: int = 10
    max_words: int = 120
    min_phrases: int = 5
    max_phrases: int = 7
