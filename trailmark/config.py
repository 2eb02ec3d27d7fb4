"""Settings every operator takes. Nothing in the library reads the wall clock."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace
from zoneinfo import ZoneInfo

DAY = 86400

# Crawlers whose access is judged page by page.
PRIORITY_BOTS = (
    "oai-searchbot",
    "chatgpt-user",
    "claude-searchbot",
    "claude-user",
    "perplexitybot",
    "perplexity-user",
    "googlebot",
    "bingbot",
)

# name -> (low, high) for the integer settings
_BOUNDS = {
    "importance_min": (1, 100),
    "retention_events": (1, 365),
    "retention_history": (30, 1825),
    "retention_sessions": (7, 1825),
    "guard_thin_words": (50, 3000),
    "guide_max_links": (10, 500),
    "guide_min_words": (0, 5000),
}
_CHOICES = {
    "training_policy": ("allow", "no_media", "no_training"),
    "notify_mode": ("off", "critical", "all", "digest"),
    "webhook_level": ("critical", "warning", "info"),
    "proxy_header": ("", "cf-connecting-ip", "x-forwarded-for", "x-real-ip"),
    "ip_storage": ("network", "none"),
}


@dataclass(frozen=True)
class Config:
    as_of: int  # unix seconds; the "now" of every window
    tz: str = "UTC"
    secret: str = ""
    monitoring_since: int = 0
    importance_min: int = 40
    retention_events: int = 30
    retention_history: int = 400
    retention_sessions: int = 180
    guard_thin_words: int = 300
    guard_redirects: bool = True
    guide_enabled: bool = True
    guide_full: bool = False
    guide_max_links: int = 80
    guide_min_words: int = 0
    guide_types: tuple[str, ...] = ()
    training_policy: str = "allow"
    track_search_pages: bool = False
    track_unknown: bool = True
    track_referrals: bool = True
    verify_rdns: bool = True
    verify_signatures: bool = True
    ip_storage: str = "network"
    proxy_header: str = ""
    trusted_proxies: tuple[str, ...] = ()
    exclude_paths: tuple[str, ...] = ("/wp-admin/", "/wp-login.php")
    notify_mode: str = "critical"
    webhook_level: str = "warning"
    site_public: bool = True
    priority_bots: tuple[str, ...] = field(default=PRIORITY_BOTS)

    def __post_init__(self):
        for name, (low, high) in _BOUNDS.items():
            value = getattr(self, name)
            if not isinstance(value, int) or isinstance(value, bool):
                raise ValueError(f"{name} must be an integer")
            if not low <= value <= high:
                raise ValueError(f"{name} must lie between {low} and {high}")
        for name, allowed in _CHOICES.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {allowed}")
        ZoneInfo(self.tz)

    def with_(self, **changes) -> "Config":
        return replace(self, **changes)

    def local_date(self, seconds_back: int = 0) -> dt.date:
        return dt.datetime.fromtimestamp(self.as_of - seconds_back, ZoneInfo(self.tz)).date()

    def since(self, days: int) -> dt.date:
        """First day of a calendar window of `days` days that ends today."""
        return self.local_date((days - 1) * DAY)

    def back(self, days: int) -> dt.date:
        """Calendar day `days` days ago (a window of days + 1 calendar days)."""
        return self.local_date(days * DAY)

    def from_ts(self, days: int) -> int:
        """Start of a rolling window in seconds."""
        return self.as_of - days * DAY

    @property
    def learning(self) -> bool:
        return self.as_of - self.monitoring_since < 14 * DAY
