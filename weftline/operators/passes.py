"""Plug-in passes, and calls that are tried again in halves."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Pass = Callable[[DataFrame], DataFrame]


@dataclass
class Passes:
    """Passes over edges, each for files of some extensions, applied in the order they were added."""

    rules: list[tuple[str, frozenset[str], Pass]] = field(default_factory=list)

    def add(self, name: str, suffixes: Sequence[str], run: Pass) -> None:
        if any(n == name for n, _, _ in self.rules):
            raise ValueError(f"{name} is there already")
        self.rules.append((name, frozenset(s.lower().lstrip(".") for s in suffixes), run))

    def apply(self, edges: DataFrame, column: str = "source_file") -> DataFrame:
        """Each pass sees the edges of its files as the passes before left them; others stay."""
        ext = F.coalesce(F.lower(F.regexp_extract(column, r"\.([^./]+)$", 1)), F.lit(""))
        for _, suffixes, run in self.rules:
            mine = ext.isin(*suffixes)
            edges = edges.where(~mine).unionByName(run(edges.where(mine)))
        return edges


class TooLong(Exception):
    """What a call raises, or a reply cut short counts as, if its units were too many."""


def in_halves(units: list, call: Callable[[list], list], depth: int = 3) -> tuple[list, list]:
    """Replies to all units, and the units given up: a call that is too long is made again with each
    half of its units, at most depth times in a row; other errors go on to the caller."""
    try:
        return call(units), []
    except TooLong:
        if depth == 0 or len(units) < 2:
            return [], list(units)
        middle = len(units) // 2
        left, right = (in_halves(x, call, depth - 1) for x in (units[:middle], units[middle:]))
        return left[0] + right[0], left[1] + right[1]
