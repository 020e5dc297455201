"""What to do after a provider's error: its kind, whether another attempt may help, and how long to wait."""

from __future__ import annotations

import re

MOST_WAIT = 120.0
RETRYABLE = {408, 429, 500, 502, 503, 504}
_DAILY = re.compile(r"per_?day", re.IGNORECASE)


def daily_quota(details: list[dict]) -> bool:
    """Whether an error names a quota that a day, and not a minute, refills."""
    found = (v for d in details if "QuotaFailure" in str(d.get("@type", "")) for v in d.get("violations") or [] if isinstance(v, dict))
    return any(_DAILY.search(str(v.get(f) or "")) for v in found for f in ("quotaId", "quotaMetric"))


def classify(status: int, details: list[dict] = ()) -> tuple[str, bool]:
    """(quota | unavailable | other, whether to try again)."""
    kind = "quota" if status == 429 else "unavailable" if status >= 500 else "other"
    return kind, status in RETRYABLE and not (status == 429 and daily_quota(list(details)))


def retry_after(header: str | None, details: list[dict] = ()) -> float | None:
    """Seconds that the server asks for, by its header or its error's details."""
    for value in [header, *(str(d.get("retryDelay", ""))[:-1] for d in details if str(d.get("retryDelay", "")).endswith("s"))]:
        try:
            return float(value)
        except (TypeError, ValueError):
            continue
    return None


def backoff(attempt: int, asked: float | None, jitter: float) -> float:
    """1, 2, 4, ... seconds and a jitter, or what the server asks for if that is longer; never over ``MOST_WAIT``."""
    return min(max(2.0 ** (attempt - 1) + jitter, asked or 0.0), MOST_WAIT)
