"""Eager refusal checks.

A Spark plan is lazy, and an error expression in a column nobody reads is pruned away. Every
operator that must refuse unsafe rows therefore counts the offending rows before it returns.
All counters of one operator share one aggregate over only the columns they name. A chain of
operators shares one job for all of its checks through ``GuardedChain``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, functions as F

from auditframe.errors import RefusedError


@dataclass(frozen=True)
class Guard:
    """Refuse with ``message`` when any row satisfies ``bad``; ``{n}`` in it is the row count."""

    message: str
    bad: Column
    status: str = "failed"


def refuse_if(df: DataFrame, guards: Sequence[Guard]) -> None:
    """Check all guards in one aggregate job."""
    if not guards:
        return
    counted = df.agg(*[F.count_if(g.bad).alias(f"g{i}") for i, g in enumerate(guards)]).first()
    _raise_first(guards, counted.asDict())


def _raise_first(guards: Sequence[Guard], counts: dict) -> None:
    for i, guard in enumerate(guards):
        n = counts.get(f"g{i}") or 0
        if n:
            raise RefusedError(guard.message.format(n=n), guard.status)


class GuardedChain:
    """Applies operators in order and checks the guards of all of them with a single job.

    Two plans are built side by side: ``frame`` is the plan handed back to the caller, and a
    probe plan carries one observation per guarded operator. Running the probe up to its last
    guarded operator fills every counter in one pass; Catalyst prunes the probe to the columns
    the counters and the operators between them need.
    """

    def __init__(self, df: DataFrame) -> None:
        self.frame = df
        self._probe = df
        self._last_guarded: DataFrame | None = None
        self._watched: list[tuple[Observation, Sequence[Guard]]] = []

    def apply(self, step: Callable[[DataFrame], DataFrame], guards: Sequence[Guard] = ()) -> None:
        if guards:
            seen = Observation()
            self._probe = self._probe.observe(seen, *[F.count_if(g.bad).alias(f"g{i}") for i, g in enumerate(guards)])
            self._last_guarded = self._probe
            self._watched.append((seen, guards))
        self.frame = step(self.frame)
        self._probe = step(self._probe)

    def checked(self) -> DataFrame:
        if self._last_guarded is not None:
            self._last_guarded.agg(F.count(F.lit(1))).collect()
            for seen, guards in self._watched:
                _raise_first(guards, seen.get)
        return self.frame
