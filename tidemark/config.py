"""Typed settings of the event pipeline, with their checks."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field

#: Event types in order of priority, and the keywords that tell each.
EVENT_KEYWORDS: dict[str, tuple[str, ...]] = {
    "regulatory_event": ("regulator", "regulation", "regulatory", "digital markets act", "digital services act", "antitrust", "competition authority", "investigation", "lawsuit", "sue", "suing", "sued", "court", "legal", "law", "legislation", "ban", "banned", "block", "blocked", "restrict", "restricted", "restriction", "exempt", "exemption", "copyright", "trademark", "approval", "compliance", "privacy", "tax", "tariff", "tariffs", "fine", "penalty"),
    "geopolitical_event": ("war", "warfare", "military", "conflict", "sanctions", "sanction", "missile", "drone strike", "invasion", "ceasefire", "diplomatic", "election", "geopolitical", "nato"),
    "macroeconomic_event": ("inflation", "interest rate", "interest rates", "central bank", "federal reserve", "bank of england", "GDP", "unemployment", "recession", "economic growth", "cost of living", "consumer confidence", "monetary policy", "fiscal policy"),
    "commodity_event": ("oil price", "oil prices", "crude oil", "natural gas", "gas price", "energy price", "gold price", "copper price", "commodity", "commodities", "supply disruption"),
    "market_wide_event": ("stock market", "global markets", "wall street", "FTSE 100", "S&P 500", "Nasdaq", "market sell-off", "market rally", "shares fall", "shares rise", "stocks fall", "stocks rise"),
    "corporate_event": ("acquisition", "acquire", "merger", "takeover", "earnings", "profit", "profits", "revenue", "sales", "forecast", "forecasts", "outlook", "missed forecast", "missed forecasts", "investment", "invest", "invested", "spending", "funding", "funded", "donation", "donate", "donated", "expansion", "expand", "expanded", "fee cut", "fees lowered", "lowers fees", "launch", "launches", "partnership", "deal", "contract", "layoffs", "job cuts", "staff reductions", "chief executive", "CEO", "board", "outage", "cyberattack", "data breach", "bankruptcy", "restructuring"),
}

#: The event type that a news section hints at.
SECTION_HINTS = {"Business": "corporate_event", "Technology": "corporate_event", "Money": "macroeconomic_event", "Politics": "regulatory_event", "Law": "regulatory_event", "World news": "geopolitical_event", "US news": "geopolitical_event", "Environment": "commodity_event"}

#: Sections whose events need a high score.
LOW_RELEVANCE_SECTIONS = ("Books", "Crosswords", "Culture", "Fashion", "Film", "Football", "Games", "Life and style", "Music", "Sport", "Television & radio", "The Filter", "The Filter US")


@dataclass(frozen=True)
class RuleConfig:
    """Weights and thresholds of span extraction and rule scoring."""

    keywords: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(EVENT_KEYWORDS))
    section_hints: dict[str, str] = field(default_factory=lambda: dict(SECTION_HINTS))
    low_relevance_sections: tuple[str, ...] = LOW_RELEVANCE_SECTIONS
    default_type: str = "corporate_event"
    headline_weight: int = 3
    trail_weight: int = 2
    body_weight: int = 1
    body_most: int = 3
    span_weight: int = 3
    section_weight: int = 1
    spans_per_link: int = 2
    sentences_per_span: int = 2
    span_characters: int = 700
    same_sentence_bonus: int = 4
    adjacent_bonus: int = 2
    title_characters: int = 180
    least_score: int = 3
    least_product_score: int = 5
    focus_headline: int = 4
    focus_trail: int = 3
    focus_same_sentence: int = 3
    focus_adjacent: int = 2
    focus_query: int = 1
    focus_core: int = 1
    least_core_focus: int = 4
    least_product_focus: int = 6
    high_score: int = 7
    medium_score: int = 4

    @property
    def priority(self) -> tuple[str, ...]:
        return tuple(self.keywords)

    @property
    def all_keywords(self) -> tuple[str, ...]:
        """Distinct keywords over all types, in order of priority."""
        return tuple(dict.fromkeys(k for words in self.keywords.values() for k in words))


@dataclass(frozen=True)
class GateConfig:
    """Thresholds of the combined rule and model decision on a relationship."""

    accepted: tuple[str, ...] = ("direct_subject", "direct_target", "materially_affected")
    confirmation: float = 0.35
    event_confidence: float = 0.35
    rescue: bool = False
    rescue_threshold: float = 0.65
    strong_focus: int = 7
    least_rescue_focus: int = 2
    override_type: bool = False
    override_threshold: float = 0.45
    evidence_characters: int = 700
    event_characters: int = 1800


@dataclass(frozen=True)
class DedupConfig:
    """Cross-article deduplication."""

    days: int = 7
    least_similarity: float = 0.72
    least_containment: float = 0.45
    word_weight: float = 0.75
    character_weight: float = 0.25
    same_type: bool = True
    shared_company: bool = True

    @property
    def least_word_cosine(self) -> float:
        """A pair that passes without equal texts has at least this word cosine, as character cosine is at most 1."""
        return (self.least_similarity * (self.word_weight + self.character_weight) - self.character_weight) / self.word_weight if self.word_weight else 0.0


@dataclass(frozen=True)
class MarketConfig:
    timezone: str = "America/New_York"
    close: str = "16:00"
    windows: tuple[int, ...] = (-7, -3, -1, 1, 3, 7)

    def __post_init__(self) -> None:
        if 0 in self.windows:
            raise ValueError("a market window of 0 sessions has no meaning")
        dt.time.fromisoformat(self.close)


def iso_date(text: str, name: str) -> str:
    """text if it is a date as YYYY-MM-DD, else ValueError."""
    try:
        if dt.date.fromisoformat(text).isoformat() == text:
            return text
    except (TypeError, ValueError):
        pass
    raise ValueError(f"{name} must be a date as YYYY-MM-DD")


def unit_interval(value: float, name: str) -> float:
    if isinstance(value, bool) or not 0 <= float(value) <= 1:
        raise ValueError(f"{name} must lie between 0 and 1")
    return float(value)


def positive_int(value: int, name: str) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < 1:
        raise ValueError(f"{name} must be a positive integer")
    return value


def check_capacity(limit: int, companies: int, windows: int, per_window: int) -> int:
    """The articles a collection can bring; ValueError if the limit is below that."""
    need = companies * windows * per_window
    if limit < need:
        raise ValueError(f"the limit of {limit} is below {companies} x {windows} x {per_window} = {need}")
    return need


#: companies' short names in figures; others lose their legal form.
SHORT_NAMES = {
    "Taiwan Semiconductor Manufacturing Company": "TSMC",
    "JPMorgan Chase & Co.": "JPMorgan",
    "Berkshire Hathaway Inc.": "Berkshire",
    "Microsoft Corporation": "Microsoft",
    "NVIDIA Corporation": "NVIDIA",
    "Exxon Mobil Corporation": "Exxon Mobil",
}
