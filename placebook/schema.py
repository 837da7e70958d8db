"""Schemas of the engine's tables."""

from __future__ import annotations

from dataclasses import dataclass

ADDRESS = "struct<house_number:string,street:string,city:string,state:string,postcode:string,country:string,full:string>"
RECORDS = f"rec_id long, address {ADDRESS}, lat double, lon double"
RESULT = f"struct<address:{ADDRESS},lat:double,lon:double,confidence:double,match_type:string>"
METADATA = "version int, record_count long, created_at string, source string, coverage string"
REQUESTS = "key_id string, ts timestamp"

EXACT, FUZZY = "exact", "fuzzy"
MATCHED, NO_MATCH, ERROR = "matched", "nomatch", "error"


@dataclass(frozen=True)
class FuzzyConfig:
    """Limits of a fuzzy search."""

    max_distance: int = 2
    phonetic_fallback: bool = True
    min_score: float = 0.5


#: What forward geocoding uses, and how many entries and records its fallback takes.
GEOCODER_FUZZY = FuzzyConfig(2, False, 0.6)
FUZZY_CANDIDATES, FUZZY_LIMIT = 20, 5


@dataclass(frozen=True)
class RateLimit:
    """Requests that a key may make; a day limit of 0 is none."""

    per_second: int = 100
    per_day: int = 100_000


TIERS = {"default": RateLimit(100, 100_000), "free": RateLimit(10, 10_000), "pro": RateLimit(100, 500_000), "enterprise": RateLimit(1000, 0)}
