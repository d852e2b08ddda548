"""Settings of a screen: defaults, merging with stored ones, allowed choices, one-line preview."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

# Sectors, cap tiers, defaults, choices and wording of the data contract.
SECTORS = ("Biotech", "Crypto & digital assets", "China-domiciled", "Airlines", "Energy", "Banks")
CAPS = {"M500": ("$500 million", "$500m", 5e8), "B1": ("$1 billion", "$1bn", 1e9), "B5": ("$5 billion", "$5bn", 5e9)}
DROP_CHOICES, PE_CHOICES, COUNT_CHOICES = (10, 15, 20), (None, 10, 12, 15, 20), (3, 5)
STALE_AFTER_MS = 60 * 60 * 60 * 1000
FETCH_TIMEOUT_MS, MIN_SYNC_INTERVAL = 20_000, "12 hours"
SETTINGS_KEY, SNAPSHOT_KEY = "settings", "brief"

#: What is shown below research notes; our own words.
DISCLAIMER = "Research notes, not advice. Figures may be late or wrong; check them before acting."

_STORED = {
    "drop_threshold": "dropThreshold", "min_market_cap": "minMarketCap", "max_pe": "maxPe",
    "dividend_payers_only": "dividendPayersOnly", "excluded_sectors": "excludedSectors",
    "candidate_count": "candidateCount", "watchlist": "watchlist",
    "notify_on_new_brief": "notifyOnNewBrief", "notify_on_watchlist_drop": "notifyOnWatchlistDrop",
}


@dataclass(frozen=True)
class Settings:
    drop_threshold: float = 10
    min_market_cap: str = "M500"
    max_pe: float | None = None
    dividend_payers_only: bool = False
    excluded_sectors: tuple[str, ...] = ()
    candidate_count: int | None = 3
    watchlist: tuple[str, ...] = ()
    notify_on_new_brief: bool = True
    notify_on_watchlist_drop: bool = True

    def __post_init__(self):
        if self.candidate_count is not None and self.candidate_count < 0:
            raise ValueError("candidate_count is negative")
        object.__setattr__(self, "excluded_sectors", tuple(self.excluded_sectors or ()))
        object.__setattr__(self, "watchlist", tuple(self.watchlist or ()))

    @property
    def cap_usd(self) -> float:
        """The tier's floor; an unknown tier is the lowest one."""
        return CAPS.get(self.min_market_cap, CAPS["M500"])[2]

    def with_changes(self, **changes) -> Settings:
        return replace(self, **changes)

    def to_stored(self) -> dict:
        return {stored: list(v) if isinstance(v := getattr(self, own), tuple) else v for own, stored in _STORED.items()}


def merged(stored: dict | None) -> Settings:
    """Stored keys over the defaults; a key that is there counts even if it is null."""
    stored = stored or {}
    return Settings(**{f.name: stored[_STORED[f.name]] for f in fields(Settings) if _STORED[f.name] in stored})


def outside_choices(s: Settings) -> list[str]:
    """Names of the settings that no choice of the settings page gives."""
    allowed = {"drop_threshold": DROP_CHOICES, "max_pe": PE_CHOICES, "candidate_count": COUNT_CHOICES, "min_market_cap": tuple(CAPS)}
    bad = [name for name, choices in allowed.items() if getattr(s, name) not in choices]
    return bad + ["excluded_sectors"] * any(x not in SECTORS for x in s.excluded_sectors)


def shown_number(x: float) -> str:
    return f"{x:g}" if float(x) != int(x) else str(int(x))


def preview_line(s: Settings) -> str:
    parts = [f"falls of {shown_number(s.drop_threshold)}%+ in a day or week", f"above {CAPS[s.min_market_cap][1]} market cap"]
    if s.max_pe:
        parts.append(f"forward P/E under {shown_number(s.max_pe)}")
    if s.dividend_payers_only:
        parts.append("dividend payers only")
    if s.excluded_sectors:
        parts.append("excluding " + ", ".join(x.lower() for x in s.excluded_sectors))
    return f"{', '.join(parts)}. Top {s.candidate_count}."


def header_line(s: Settings) -> str:
    return f"{shown_number(s.drop_threshold)}%+ · above {CAPS.get(s.min_market_cap, CAPS['M500'])[1]}"


def toggled(items: tuple[str, ...], item: str) -> tuple[str, ...]:
    return tuple(x for x in items if x != item) if item in items else (*items, item)
