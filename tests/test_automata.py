"""Courses in pieces equal courses read one event after another."""

import random

from strandline.operators import automata

MOVES = {("open", "assign"): "committee", ("committee", "sit"): "committee", ("committee", "report"): "reported", ("reported", "vote"): "done", ("committee", "return"): "open", ("open", "close"): "done"}
COURSE = automata.Automaton(["open", "committee", "reported", "done"], MOVES)


def test_states_equal_a_loop(spark, monkeypatch):
    monkeypatch.setattr(automata, "RUN", 7)
    rng = random.Random(1)
    kinds = ["assign", "sit", "report", "vote", "return", "close", "unknown", None]
    rows = [(rng.choice([1, 1, 1, 2, 3, None]), k, rng.choices(kinds, [4, 6, 2, 2, 2, 1, 1, 1])[0]) for k in range(900)]
    rng.shuffle(rows)
    events = spark.createDataFrame(rows, "item int, at long, kind string").repartition(3)
    want, ends = {}, {}
    for item in {r[0] for r in rows}:
        state, unread = "open", 0
        mine = sorted((at, kind) for i, at, kind in rows if i == item)
        for at, kind in mine:
            read = (state, kind) in MOVES
            state, unread = MOVES.get((state, kind), state), unread + (not read)
            want[item, at] = (state, read)
        ends[item] = (state, len(mine), unread)
    assert {(r.item, r["at"]): (r.state, r.read) for r in automata.states(events, ["item"], ["at"], "kind", COURSE).collect()} == want
    assert {r.item: (r.state, r.events, r.unread) for r in automata.courses(events, ["item"], ["at"], "kind", COURSE).collect()} == ends
    assert automata.courses(events.limit(0), ["item"], ["at"], "kind", COURSE).count() == 0
