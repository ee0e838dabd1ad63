"""Last states and removals of append-only tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from dataloom.functions.columns import quoted


def latest_state(events: DataFrame, key: str, seq: list[str]) -> DataFrame:
    """The last row of each key. A partial maximum per task comes before the shuffle, so
    a key with very many events costs no more than any other."""
    rest = [c for c in events.columns if c != key and c not in seq]
    last = F.max(F.struct(*[quoted(s) for s in seq], *[quoted(c) for c in rest])).alias("_e")
    state = events.groupBy(quoted(key)).agg(last).select(quoted(key), "_e.*")
    return state.select(*[quoted(c) for c in events.columns])


def without_removed(rows: DataFrame, removed: DataFrame, on: dict[str, str]) -> DataFrame:
    """Rows whose owner was not removed; ``on`` maps a column here to one there. Serves
    the table itself and, through the foreign key, each table that hangs on it."""
    ids = removed.select(*[quoted(there).alias(here) for here, there in on.items()]).distinct()
    return rows.join(ids, list(on), "left_anti")
