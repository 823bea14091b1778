"""Verdicts on a pair of queries."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from ..functions.typing import Policies
from ..plans.errors import Reason


@dataclass(frozen=True)
class Options:
    """rows: per base table. worlds: candidate databases that a search may hold."""

    rows: int = 2
    timeout_seconds: float = 60.0
    intermediate_rows: int = 10_000
    worlds: int = 300_000
    policies: Policies = field(default_factory=Policies)

    def validate(self) -> Options:
        from ..sources.schema import invalid

        if min(self.rows, self.timeout_seconds, self.intermediate_rows, self.worlds) <= 0:
            raise invalid("an option is not positive")
        return self


@dataclass(frozen=True)
class Result:
    columns: tuple[str, ...]
    types: tuple[str, ...]
    rows: tuple[tuple, ...]


@dataclass(frozen=True)
class Counterexample:
    tables: dict[str, tuple[tuple, ...]]
    left: Result
    right: Result

    @property
    def size(self) -> int:
        """Rows of the largest table."""
        return max((len(rows) for rows in self.tables.values()), default=0)


@dataclass(frozen=True)
class Equivalent:
    """No database with at most `bound` rows per table tells the queries apart."""

    bound: int
    why: str = ""


@dataclass(frozen=True)
class Different:
    counterexample: Counterexample


@dataclass(frozen=True)
class Unsupported:
    reason: Reason
    message: str


Verdict = Equivalent | Different | Unsupported


@dataclass
class Metrics:
    """Seconds by phase, and counts."""

    seconds: dict[str, float] = field(default_factory=dict)
    counts: dict[str, int] = field(default_factory=dict)

    def add(self, name: str, n: int = 1) -> None:
        self.counts[name] = self.counts.get(name, 0) + n

    def told(self) -> dict[str, Any]:
        return {**{f"{k}_seconds": v for k, v in self.seconds.items()}, **self.counts}
