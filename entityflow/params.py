"""Thresholds of the matching, pricing and governance rules, passed to the operators as plain values."""

from __future__ import annotations

from dataclasses import dataclass, field

# The tier names, the variant vocabulary in display order, the item states.
TIERS = ("full", "edge", "region_art", "region_name", "region_text")
FINISHES = ("normal", "holofoil", "reverseHolofoil")
STATUSES = (
    "pending", "auto", "validation", "validated", "corrected",
    "skipped", "not_card", "unreadable", "merged",
)
RESOLVED = ("auto", "validated", "corrected")
ACCEPT_STAGES = ("h", "multi", "llm")


@dataclass(frozen=True)
class HashParams:
    accept_distance: int = 10
    min_margin: int = 4
    min_agreement: int = 3
    augmentations: int = 6
    user_validated_cap: int = 20


@dataclass(frozen=True)
class CascadeParams:
    quality_min: float = 45.0
    auto_accept: int = 80
    hash_only_accept: int = 90
    hash_agreement: int = 4
    unreadable_below: int = 40


@dataclass(frozen=True)
class QuotaParams:
    batches_per_day: int = 5
    photos_per_day: int = 50
    cards_per_day: int = 600
    fetches_per_day: int = 20
    photos_per_batch: int = 10


@dataclass(frozen=True)
class PriceParams:
    source_order: tuple[str, ...] = ("primary", "secondary")
    ttl_hours: int = 24
    spread_pct: float = 15.0


@dataclass(frozen=True)
class ExportParams:
    retention_hours: int = 48
    prefix: str = "exports"
    max_cards: int = 5000
    page_size: int = 60


@dataclass(frozen=True)
class AuthParams:
    session_idle_days: int = 7
    links_per_hour: int = 3
    links_per_day: int = 10


@dataclass(frozen=True)
class StateParams:
    """How long streams remember, in processing time."""

    idle_hours: int = 48  # an open batch without news
    fired_hours: int = 1  # a complete batch


@dataclass(frozen=True)
class GateParams:
    allowed_hosts: tuple[str, ...] = (
        "i.imgur.com", "imgur.com", "api.imgur.com", "i.redd.it", "www.reddit.com",
    )
    path_hosts: tuple[str, ...] = ("imgur.com", "www.reddit.com")
    max_urls: int = 10
    max_photo_bytes: int = 10_485_760
    accept_heif: bool = True


@dataclass(frozen=True)
class Params:
    hashing: HashParams = field(default_factory=HashParams)
    cascade: CascadeParams = field(default_factory=CascadeParams)
    quotas: QuotaParams = field(default_factory=QuotaParams)
    prices: PriceParams = field(default_factory=PriceParams)
    export: ExportParams = field(default_factory=ExportParams)
    auth: AuthParams = field(default_factory=AuthParams)
    gates: GateParams = field(default_factory=GateParams)
