"""List queries: order, filters over optional sides, unions and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def two_block_order(active: str, deadline: str, start: str, ties: list[str], reverse: bool = False) -> list[Column]:
    """Sort keys: open rows first by deadline, undated ones after them by newest start; closed rows by newest end.

    ``reverse`` turns the dates inside the blocks; the blocks stay. ``ties`` end the order.
    """
    is_open = F.coalesce(F.col(active), F.lit(False))
    open_day = F.when(is_open, F.col(deadline))
    undated = F.when(is_open & F.col(deadline).isNull(), F.col(start))
    closed_day = F.when(~is_open, F.coalesce(deadline, start))
    up, down = (lambda c: c.asc_nulls_last(), lambda c: c.desc_nulls_last()) if not reverse else (lambda c: c.desc_nulls_last(), lambda c: c.asc_nulls_last())
    return [is_open.desc(), up(open_day), down(undated), down(closed_day), *[F.col(t) for t in ties]]


def page(df: DataFrame, order: list[Column], size: int, number: int = 0) -> DataFrame:
    """One page of an ordered list with ``pos`` from 1; only size * (number + 1) rows are kept while sorting."""
    top = df.orderBy(*order).limit(size * (number + 1))
    return top.withColumn("pos", F.row_number().over(Window.orderBy(*order))).where(F.col("pos") > size * number)


def fold_joint(df: DataFrame, key: list[str], value: str, pos: str) -> DataFrame:
    """One row per key: the smallest value leads, the others in order are the co-values, the first position stays."""
    values = F.array_sort(F.collect_set(value))
    return df.groupBy(*key).agg(F.min(value).alias("lead"), F.min(pos).alias("first_pos"), values.alias("all")).select(*key, "lead", F.slice("all", 2, 1 << 30).alias("co"), "first_pos")


def with_side(df: DataFrame, side: DataFrame | None, key: list[str], columns: list[str], name: str) -> DataFrame:
    """Left join of a side table that may be unread: ``<name>_state`` is read or unread, columns are null where nothing matches.

    Unread differs from none: with ``side`` None every row is unread.
    """
    if side is None:
        for c in columns:
            df = df.withColumn(c, F.lit(None).cast("string"))
        return df.withColumn(f"{name}_state", F.lit("unread"))
    return df.join(side.select(*key, *columns), key, "left").withColumn(f"{name}_state", F.lit("read"))


def carry_over(current: DataFrame, previous: DataFrame, deadline: str, day: Column) -> DataFrame:
    """The current period's rows and those of the previous one whose deadline still runs."""
    return current.unionByName(previous.where(F.col(deadline) >= day))


def unlinked(left: DataFrame, right: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Rows of ``left`` with and without a partner in ``right``."""
    keys = right.select(*on).distinct()
    return left.join(keys, on, "left_semi"), left.join(keys, on, "left_anti")


def snapshot_diff(old: DataFrame, new: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """added, removed, changed or same for each key of two snapshots, with the names of changed columns."""
    a = old.select(*key, F.struct(*columns).alias("old"))
    b = new.select(*key, F.struct(*columns).alias("new"))
    changed = F.array_compact(F.array(*[F.when(~F.col(f"old.{c}").eqNullSafe(F.col(f"new.{c}")), F.lit(c)) for c in columns]))
    joined = a.join(b, key, "full_outer").withColumn("diffs", F.when(F.col("old").isNotNull() & F.col("new").isNotNull(), changed))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.size("diffs") > 0, "changed").otherwise("same")
    return joined.select(*key, kind.alias("kind"), F.coalesce(F.array_join("diffs", ","), F.lit("")).alias("changed_columns"))


def stale_keys(current: DataFrame, stored: DataFrame, key: list[str], now: Column, most_hours: int = 24) -> DataFrame:
    """Keys to recompute: not stored, stored under another fingerprint, or open and older than ``most_hours``."""
    kept = stored.select(*key, F.col("fingerprint").alias("_stored"), "read_at")
    joined = current.join(kept, key, "left")
    old = F.col("open") & (F.col("read_at") < now - F.expr(f"INTERVAL {most_hours} HOURS"))
    reason = F.when(F.col("_stored").isNull(), "new").when(F.col("_stored") != F.col("fingerprint"), "changed").when(old, "old")
    return joined.withColumn("reason", reason).where("reason IS NOT NULL").select(*key, "reason")


def kept_cut(shown: DataFrame, again: DataFrame, key: str, rank: Column, visible: int) -> DataFrame:
    """One row ``cut``: how many rows of the re-ordered list to show so that the rows of ``shown`` stay shown, at least ``visible``.

    A greater ``rank`` stands earlier. The last of the shown rows decides; rows
    before it are counted, the list is not ranked.
    """
    worst = again.join(F.broadcast(shown.select(key)), key, "left_semi").agg(F.min(rank))
    return again.where(rank >= worst.scalar()).agg(F.greatest(F.lit(visible), F.count(F.lit(1))).cast("long").alias("cut"))


def allotted(df: DataFrame, key: str, order: list[Column], budget: int) -> DataFrame:
    """Every row with ``state`` read or skipped: the first ``budget`` rows by ``order`` are read, none is dropped unnamed.

    ``key`` tells rows apart. Only the first rows are ordered; the others are told by not being among them.
    """
    first = F.broadcast(df.orderBy(*order).limit(budget).select(F.col(key).alias("_read")))
    joined = df.join(first, F.col(key).eqNullSafe(F.col("_read")) & F.col("_read").isNotNull(), "left")
    return joined.withColumn("state", F.when(F.col("_read").isNotNull(), "read").otherwise("skipped")).drop("_read")


def admitted(items: DataFrame, matrix: DataFrame, kind: str) -> DataFrame:
    """Each option with the items it admits, by an (option, kind) table: the small matrix is joined, no rule runs per row."""
    return items.join(matrix.select("option", F.col("kind").alias("_kind")), F.col(kind) == F.col("_kind")).drop("_kind")


def tolerant_union(sources: dict, name: str = "source") -> tuple[DataFrame, list[tuple[str, str, str | None]]]:
    """The rows of all sources that read, and (source, state, reason) of each: one that fails is reported, never fatal.

    ``sources`` maps a name to a function that returns a DataFrame. Each is read
    into a table of its own first, as a lazy source fails only when it is read.
    All failing is an error: an empty answer would look like no rows.
    """
    from strandline.sources.shared import written

    out: DataFrame | None = None
    states: list[tuple[str, str, str | None]] = []
    for label, read in sources.items():
        try:
            part = written(read().withColumn(name, F.lit(label)), f"source-{label}")
        except Exception as failure:  # noqa: BLE001 - whatever a source raises, the others still count
            states.append((label, "failed", type(failure).__name__))
            continue
        states.append((label, "read", None))
        out = part if out is None else out.unionByName(part)
    if out is None:
        raise RuntimeError(f"no source could be read: {states}")
    return out, states


def cache_state(age: Column, ttl: int, stale: int, running: Column) -> Column:
    """fresh within ``ttl`` seconds, stale (served while it is read again) up to ``stale`` more, pending if a read is already running, else expired; null age: absent."""
    return F.when(age.isNull(), F.when(running, "pending").otherwise("absent")).when(age <= ttl, "fresh").when(age <= ttl + stale, F.when(running, "stale").otherwise("revalidate")).otherwise(F.when(running, "pending").otherwise("expired"))


def within_bytes(entries: DataFrame, used: str, size: str, budget: int, key: str) -> DataFrame:
    """The entries a cache of ``budget`` bytes keeps, most recently used first. Sizes are summed by stretches of time before entries are, so no task ranks all."""
    span = F.floor(F.unix_timestamp(used) / 3600)
    by_span = entries.groupBy(span.alias("_span")).agg(F.sum(size).alias("_bytes"))
    newer = by_span.withColumn("_before", F.coalesce(F.sum("_bytes").over(Window.orderBy(F.desc("_span")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("_span").orderBy(F.desc(used), F.col(key)).rowsBetween(Window.unboundedPreceding, 0)
    joined = entries.withColumn("_span", span).join(newer.where(F.col("_before") < budget).select("_span", "_before"), "_span")
    return joined.withColumn("upto", F.col("_before") + F.sum(size).over(inside)).where(F.col("upto") <= budget).drop("_span", "_before")


def retry_plan(tries: DataFrame, key: str, failed: str, at: str, wait_seconds: int = 60, most: int = 5) -> DataFrame:
    """Per key that last failed: failures since the last success, and when to try next (doubling waits); given up after ``most``."""
    last = Window.partitionBy(key).orderBy(at)
    runs = tries.withColumn("_ok", F.sum((~F.col(failed)).cast("int")).over(last.rowsBetween(Window.unboundedPreceding, 0)))
    tail = runs.withColumn("_run", F.max("_ok").over(Window.partitionBy(key))).where((F.col("_ok") == F.col("_run")) & F.col(failed))
    counted = tail.groupBy(key).agg(F.count(F.lit(1)).alias("failures"), F.max(at).alias("last_try"))
    wait = (F.lit(wait_seconds) * F.pow(F.lit(2.0), F.least("failures", F.lit(most)) - 1)).cast("long")
    return counted.select(key, "failures", "last_try", F.when(F.col("failures") < most, wait).alias("wait_seconds"), (F.col("failures") >= most).alias("given_up"))
