"""Aggregates that a stream adds to, each batch once, and marks of how far a sync has come.

Both live in a versioned table: a batch's number is a property of the version that has its sums, and a mark is a property as well, so
neither can be there without the other.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from ..operators import merge
from ..sources.versioned import Conflict, VersionedTable


def add_once(table: VersionedTable, stream: str, delta_of: Callable[[DataFrame], DataFrame], keys: Sequence[str], sums: Sequence[str], latest: Sequence[str] = ()) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that adds a batch's sums by key to the table, unless the table has that batch of that stream already.

    delta_of gives rows of keys and sums.  Only the partitions that the batch touches are read and written.  Batches of a stream come in order, so its
    last number is all the ledger keeps; if another writer is faster, the batch is tried again on the newer version.
    """
    name = f"batch:{stream}"

    def add(batch: DataFrame, number: int) -> None:
        delta = delta_of(batch).select(*keys, *sums, *latest).persist()
        try:
            while True:
                base = table.snapshot()
                if number <= int(base.properties.get(name, -1)):
                    return
                rows = merge.add(delta.limit(0), delta, keys, sums, latest)
                if base.schema is not None:
                    touched = {tuple(r) for r in delta.selectExpr(*[f"cast({k} as string)" for k in table.keys]).distinct().collect()}
                    rows = merge.add(table.read(base, lambda values: values in touched), delta, keys, sums, latest)
                try:
                    table.write(rows, base, {name: str(number)})
                    return
                except Conflict:
                    continue
        finally:
            delta.unpersist()

    return add


def mark(table: VersionedTable, sync: str, now: dt.datetime, default_days: int = 7) -> dt.datetime:
    """How far a sync has come; before its first run some days back from now."""
    found = table.snapshot().properties.get(f"mark:{sync}")
    return dt.datetime.fromisoformat(found) if found else now - dt.timedelta(days=default_days)


def day_ranges(since: dt.datetime, until: dt.datetime) -> list[tuple[dt.datetime, dt.datetime]]:
    """Half-open ranges from since to until that end with each day."""
    out = []
    while since < until:
        end = min(until, dt.datetime.combine(since.date() + dt.timedelta(days=1), dt.time.min, since.tzinfo))
        out.append((since, end))
        since = end
    return out


def sync_days(table: VersionedTable, sync: str, now: dt.datetime, process: Callable[[dt.datetime, dt.datetime], None], since: dt.datetime | None = None, until: dt.datetime | None = None) -> list[tuple[dt.datetime, Exception]]:
    """Process each day from the mark to now; the mark moves to now only if every day succeeded.  Returned are the days that failed, with their errors.

    A failed day doesn't stop the days after it, so process must be safe to repeat.  The mark never goes back, and stays where a given start leaves
    a gap behind it.
    """
    begun = table.snapshot()
    at = mark(table, sync, now)
    first, end = since or at, until or now
    failed: list[tuple[dt.datetime, Exception]] = []
    for a, b in day_ranges(first, end):
        try:
            process(a, b)
        except Exception as e:  # one bad day is reported, not lost: the mark stays
            failed.append((a, e))
    name = f"mark:{sync}"
    if not failed and first <= at < end:
        while True:
            newest = table.snapshot()
            if newest.properties.get(name) != begun.properties.get(name):
                break  # another run moved it; the next run starts from there
            try:
                table.put({name: end.isoformat()}, newest)
                break
            except Conflict:
                continue
    return failed
