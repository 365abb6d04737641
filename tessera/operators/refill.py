"""Refill: the first candidates that pass a costly test, found without testing many more than needed.

Candidates are ranked once. A range of ranks is tested; while too few have passed, the next range follows, until the limit is
reached or nobody is left. No key is tested twice, and later ranges are never read by the test.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ordering import placed
from tessera.operators.ranking import top
from tessera.sources.scratch import held


def needed(limit: int, passed: int, tested: int) -> int:
    """How many to test next: as many as are missing, two at least. Right where a test costs far more than a job."""
    return max(limit - passed, 2)


def at_the_rate(limit: int, passed: int, tested: int) -> int:
    """How many to test next, as the share that has passed so far suggests, and at least a tenth of those tested: few jobs."""
    missing = max(limit - passed, 2)
    return max(missing * (tested + 1) // (passed + 1), tested // 10, 2) if tested else missing


@dataclass
class Refilled:
    """What passed, and what it took: the number of candidates tested in each range."""

    rows: DataFrame
    ranges: list[int] = field(default_factory=list)

    @property
    def tested(self) -> int:
        return sum(self.ranges)


def refill(candidates: DataFrame, key: str, order: list[Column], test: Callable[[DataFrame], DataFrame], limit: int, step: Callable[[int, int, int], int] = needed) -> Refilled:
    """Candidates (the best of each key by ``order``) that ``test`` lets through, with their ``place`` among all candidates.

    ``test`` gets a range of candidates and returns those that pass, with any further columns; it keeps ``place``. All rows of the
    ranges tested come back, so a few more than ``limit`` may; rank and limit them by what the test has found.
    Rows without a key are no candidates; a limit of 0, or no candidates, gives no rows of ``test``'s columns.
    """
    ranked = held(placed(top(candidates.filter(F.coalesce(F.col(key).cast("string"), F.lit("")) != ""), [key], order), [*order, F.col(key)]), "candidates")
    total, tested, passed = ranked.count(), 0, 0
    out = Refilled(test(ranked.filter("place < 1")))
    while passed < limit and tested < total:
        upto = min(tested + max(1, limit if not tested else step(limit, passed, tested)), total)
        part = held(test(ranked.filter(F.col("place").between(tested + 1, upto))), "tested")
        out.rows = part if not tested else out.rows.union(part)
        out.ranges.append(upto - tested)
        passed, tested = passed + part.count(), upto
    return out
