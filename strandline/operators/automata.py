"""Courses of events read by a deterministic automaton, in pieces.

What a run of events does is a function from the state before it to the state
behind it, and such functions compose in any grouping. So events are cut into
runs, each run is folded to its function by itself, a key's functions are
composed in order, and every run then knows the state that it begins in. A
course that holds a third of all events is read by many tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.sources.shared import written

#: Events of a run at most.
RUN = 512


@dataclass
class Automaton:
    """States, the first of which a course begins in, and (state, kind) -> state. A kind that a state does not know is unread and changes nothing."""

    states: list[str]
    moves: dict[tuple[str, str], str]
    kinds: list[str] = field(init=False)

    def __post_init__(self) -> None:
        self.kinds = sorted({kind for _, kind in self.moves})

    def kind_of(self, kind: Column) -> Column:
        """Index of a kind, from 0; the number of kinds for one that no state knows, and for null."""
        return F.coalesce(F.array_position(F.array(*map(F.lit, self.kinds)), kind) - 1, F.lit(-1)).cast("int")

    def table(self) -> Column:
        """For each kind, and last for any other, the next state of each state."""
        at = {s: i for i, s in enumerate(self.states)}
        rows = [[at[self.moves.get((s, kind), s)] for s in self.states] for kind in self.kinds] + [list(range(len(self.states)))]
        return F.array(*[F.array(*map(F.lit, row)) for row in rows])

    def known(self) -> Column:
        """For each kind, and last for any other, whether each state knows it."""
        rows = [[(s, kind) in self.moves for s in self.states] for kind in self.kinds] + [[False] * len(self.states)]
        return F.array(*[F.array(*map(F.lit, row)) for row in rows])

    def name(self, state: Column) -> Column:
        return F.get(F.array(*map(F.lit, self.states)), state)


def _runs(events: DataFrame, key: list[str], order: list[str], kind: str, automaton: Automaton) -> DataFrame:
    """Runs of a key's consecutive events: key, range, run, events (array of order, kind index, in order)."""
    index = F.when(automaton.kind_of(F.col(kind)) < 0, len(automaton.kinds)).otherwise(automaton.kind_of(F.col(kind)))
    rows = events.select(*key, F.struct(*order).alias("_o"), index.alias("_k")).repartitionByRange(*key, "_o")
    ranged = written(rows.withColumn("_range", F.spark_partition_id()), "events")
    number = F.row_number().over(Window.partitionBy(*key, "_range").orderBy("_o", "_k")) - 1
    cut = ranged.withColumn("_run", F.floor(number / RUN))
    return cut.groupBy(*key, "_range", "_run").agg(F.sort_array(F.collect_list(F.struct("_o", "_k"))).alias("_e"))


def _begun(events: DataFrame, key: list[str], order: list[str], kind: str, automaton: Automaton) -> DataFrame:
    """The runs with ``_s``, the state that each begins in."""
    runs = written(_runs(events, key, order, kind, automaton), "runs")
    moves, same = automaton.table(), F.array(*[F.lit(i) for i in range(len(automaton.states))])
    then = lambda f, g: F.transform(f, lambda s: F.get(g, s))
    folded = runs.select(*key, "_range", "_run", F.aggregate("_e", same, lambda f, e: then(f, F.get(moves, e["_k"]))).alias("_f"))
    listed = folded.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("_range", "_run", "_f"))).alias("_l"))
    empty = F.struct(F.lit(0).alias("s"), F.array().cast("array<int>").alias("before"))
    walked = F.aggregate("_l", empty, lambda a, r: F.struct(F.get(r["_f"], a["s"]).alias("s"), F.concat(a["before"], F.array(a["s"])).alias("before")))["before"]
    starts = listed.select(*key, F.explode(F.arrays_zip(F.transform("_l", lambda r: F.struct(r["_range"].alias("_range"), r["_run"].alias("_run"))).alias("r"), walked.alias("s"))).alias("x"))
    starts = starts.select(*[F.col(k).alias(f"_key_{k}") for k in key], F.col("x.r._range").alias("_at_range"), F.col("x.r._run").alias("_at_run"), F.col("x.s").alias("_s"))
    on = (F.col("_range") == F.col("_at_range")) & (F.col("_run") == F.col("_at_run"))
    for k in key:
        on = on & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return runs.join(starts, on).select(*key, "_range", "_run", "_e", "_s")


def states(events: DataFrame, key: list[str], order: list[str], kind: str, automaton: Automaton) -> DataFrame:
    """Every event with the state behind it: key, the columns of ``order``, state, read (whether the state before it knew its kind).

    Events of equal order are read by kind. Events with a null kind are unread; a null key is a key.
    """
    moves, known = automaton.table(), automaton.known()
    empty = F.struct(F.col("_s").alias("s"), F.array().cast("array<struct<o:int,s:int,read:boolean>>").alias("out"))
    runs = _begun(events, key, order, kind, automaton)
    step = lambda a, e: F.struct(F.get(F.get(moves, e["_k"]), a["s"]).alias("s"), F.concat(a["out"], F.array(F.struct(F.size(a["out"]).alias("o"), F.get(F.get(moves, e["_k"]), a["s"]).alias("s"), F.get(F.get(known, e["_k"]), a["s"]).alias("read")))).alias("out"))
    told = runs.select(*key, "_e", F.explode(F.aggregate("_e", empty, step)["out"]).alias("x"))
    return told.select(*key, F.get("_e", F.col("x.o"))["_o"].alias("_o"), automaton.name(F.col("x.s")).alias("state"), F.col("x.read").alias("read")).select(*key, "_o.*", "state", "read")


def courses(events: DataFrame, key: list[str], order: list[str], kind: str, automaton: Automaton) -> DataFrame:
    """Per key where its course ends: key, state, events, unread."""
    moves, known = automaton.table(), automaton.known()
    runs = _begun(events, key, order, kind, automaton)
    begin = F.struct(F.col("_s").alias("s"), F.lit(0).alias("unread"))
    step = lambda a, e: F.struct(F.get(F.get(moves, e["_k"]), a["s"]).alias("s"), (a["unread"] + F.when(F.get(F.get(known, e["_k"]), a["s"]), 0).otherwise(1)).alias("unread"))
    ended = runs.select(*key, "_range", "_run", F.size("_e").alias("n"), F.aggregate("_e", begin, step).alias("a"))
    last = F.max_by("a.s", F.struct("_range", "_run"))
    return ended.groupBy(*key).agg(automaton.name(last).alias("state"), F.sum("n").alias("events"), F.sum("a.unread").alias("unread"))
