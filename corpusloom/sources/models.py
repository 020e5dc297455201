"""Calls of models: attempts with waits, one call of a fallback, checks of how a reply ended, and accounting.

A model is a function from a prompt to a ``Reply`` that raises ``ProviderError``; no provider's library is needed here.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from . import failures


class ModelError(RuntimeError):
    """A call that gave no usable reply."""


class ProviderError(ModelError):
    def __init__(self, status: int, message: str = "", details: list[dict] = (), retry_after: str | None = None):
        super().__init__(f"{status} {message}".strip())
        self.status, self.details, self.retry_after = status, list(details), retry_after


class QuotaError(ModelError):
    """All attempts ended in a quota."""


class UnavailableError(ModelError):
    """All attempts found the provider unavailable."""


@dataclass(frozen=True)
class Reply:
    text: str
    finish: str = "stop"
    prompt_tokens: int | None = None
    output_tokens: int | None = None


@dataclass
class Caller:
    """Calls a model, and after its attempts once a fallback; counts calls, waits and tokens, and keeps the first errors."""

    model: Callable[[str], Reply]
    fallback: Callable[[str], Reply] | None = None
    attempts: int = 4
    sleep: Callable[[float], None] = time.sleep
    jitter: Callable[[], float] = random.random
    kept_errors: int = 20
    totals: dict[str, float] = field(default_factory=lambda: {"calls": 0, "retries": 0, "fallbacks": 0, "waited": 0.0, "prompt_tokens": 0, "output_tokens": 0, "missing_counts": 0})
    errors: list[dict] = field(default_factory=list)

    def __call__(self, prompt: str) -> str:
        kind, error = "other", None
        for attempt in range(1, self.attempts + 1):
            try:
                return self._checked(self.model(prompt))
            except ProviderError as e:
                kind, again = failures.classify(e.status, e.details)
                error = e
                self._note(attempt, kind, e)
            if not again or attempt == self.attempts:
                break
            wait = failures.backoff(attempt, failures.retry_after(error.retry_after, error.details), self.jitter())
            self.totals["retries"] += 1
            self.totals["waited"] += wait
            self.sleep(wait)
        if self.fallback and kind != "other":
            self.totals["fallbacks"] += 1
            try:
                return self._checked(self.fallback(prompt))
            except ProviderError as e:
                kind, _ = failures.classify(e.status, e.details)
                error = e
                self._note(0, kind, e)
        raise {"quota": QuotaError, "unavailable": UnavailableError}.get(kind, ModelError)(str(error)) from error

    def _note(self, attempt: int, kind: str, error: ProviderError) -> None:
        self.totals["calls"] += 1
        if len(self.errors) < self.kept_errors:
            self.errors.append({"attempt": attempt, "kind": kind, "status": error.status, "message": str(error)})

    def _checked(self, reply: Reply) -> str:
        self.totals["calls"] += 1
        for name in ("prompt_tokens", "output_tokens"):
            value = getattr(reply, name)
            self.totals[name if value is not None else "missing_counts"] += 1 if value is None else value
        if reply.finish != "stop":
            raise ModelError(f"the reply ended by {reply.finish}")
        if not reply.text.strip():
            raise ModelError("an empty reply")
        return reply.text
