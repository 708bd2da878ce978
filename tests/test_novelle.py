"""Instructions applied by joins equal instructions applied one after another."""

import random
import re

from strandline.operators import novelle


def looped(units, lines):
    """Units after the lines, and the refusal of each line, by a loop."""
    units, refusals, paragraph, step = dict(units), {}, None, []

    def finish():
        sources, targets = [a for _, a, _ in step], [t for _, _, t in step]
        bad = any(a not in units for a in sources) or len(set(targets)) < len(targets) or len(set(sources)) < len(sources) or any(t in units and t not in sources for t in targets)
        for seq, _, _ in step:
            refusals[seq] = "numbers collide" if bad else None
        if step and not bad:
            held = {t: units[a] for _, a, t in step}
            for a in sources:
                units.pop(a)
            units.update(held)
        step.clear()

    for seq, line in enumerate(lines):
        said = " ".join((line or "").split())
        kind, m = next(((k, m) for k, form in novelle.FORMS.items() if (m := re.search(form, said))), (None, None))
        if kind != "renumber":
            finish()
        if kind is None:
            refusals[seq] = "unread"
            continue
        g = [x or "" for x in m.groups()]
        place = lambda p, s: f"§{p}" + (f"/{s}" if s else "")
        inherited, paragraph = (g[0] or paragraph), (g[0] or paragraph)
        if inherited is None or not (g[0] or g[1]):
            refusals[seq] = "no place"
            continue
        address = place(inherited, g[1])
        if kind == "renumber":
            step.append((seq, address, place(g[2] or inherited, g[3])))
        elif kind == "insert":
            refusals[seq] = "already there" if address in units else None
            units.setdefault(address, g[2])
        elif address not in units:
            refusals[seq] = "not there"
        elif kind == "delete":
            refusals[seq] = None
            del units[address]
        elif kind == "replace":
            refusals[seq], units[address] = None, g[2]
        else:
            refusals[seq] = None if g[2] in units[address] else "no such words"
            units[address] = units[address].replace(g[2], g[3])
    finish()
    return units, refusals


def test_instructions_equal_a_loop(spark):
    rng = random.Random(12)
    place = lambda: rng.choice([f"§ {rng.randrange(1, 5)}", f"§ {rng.randrange(1, 5)} Abs. {rng.randrange(1, 3)}", f"Abs. {rng.randrange(1, 3)}"])
    said = lambda: " ".join(rng.choices(["alpha", "beta", "gamma"], k=3))
    forms = [lambda: f"{place()} entfällt.", lambda: f"{place()} lautet: „{said()}“", lambda: f"Folgender {place()} wird eingefügt: „{said()}“.", lambda: f"In {place()} wird „{rng.choice(['alpha', 'delta'])}“ durch „x“ ersetzt.", lambda: "etwas anderes", lambda: None]
    laws, novels = {}, {}
    for law in range(40):
        laws[law] = {a: said() for a in rng.sample([f"§{p}{s}" for p in range(1, 5) for s in ("", "/1", "/2")], 7)}
        lines = []
        while len(lines) < 12:
            if rng.random() < 0.2:
                a, b, c = rng.sample([f"§ {p}" for p in range(1, 7)], 3)
                lines += rng.choice([[(a, b), (b, a)], [(a, b)], [(a, b), (b, c)], [(a, c), (b, c)]])
            else:
                lines.append(rng.choice(forms)())
        novels[law] = [f"{x[0]} erhält die Bezeichnung „{x[1]}“." if isinstance(x, tuple) else x for x in lines]
    units = spark.createDataFrame([(law, a, t) for law, us in laws.items() for a, t in us.items()], "law int, address string, text string")
    lines = spark.createDataFrame([(law, seq, x) for law, ls in novels.items() for seq, x in enumerate(ls)], "law int, seq long, line string")
    after, told = novelle.applied(units, novelle.parsed(lines, ["law"], "seq", "line"), ["law"])
    got, refused = {}, {}
    for r in after.collect():
        got.setdefault(r.law, {})[r.address] = r.text
    for r in told.collect():
        refused.setdefault(r.law, {})[r.seq] = r.refusal
    for law in laws:
        want, why = looped(laws[law], novels[law])
        assert refused[law] == why, (novels[law], laws[law])
        assert got.get(law, {}) == want, novels[law]


def test_instructions_over_the_table(spark, small):
    import hashlib
    from collections import Counter

    from strandline.plans import novelle_queries as plans

    units, lines = plans.laws(spark, small)
    laws, novels = {}, {}
    for r in units.collect():
        laws.setdefault(r.doc_id, {})[r.address] = r.text
    for r in lines.collect():
        novels.setdefault(r.doc_id, {})[r.seq] = r.line
    want_units, want = set(), set()
    for k, law in laws.items():
        after, refused = looped(law, [novels[k][i] for i in range(len(novels[k]))])
        want_units |= {(k, a, hashlib.md5(t.encode()).hexdigest()) for a, t in after.items()}
        want |= {(k, seq, why) for seq, why in refused.items()}
    assert {tuple(r) for r in plans.amended_units(spark, small).collect()} == want_units
    assert {(r.doc_id, r.seq, r.refusal) for r in plans.instruction_verdicts(spark, small).collect()} == want
    assert {None, "unread", "not there", "already there", "numbers collide"} <= set(Counter(x[2] for x in want))


def test_lines_are_folded_and_dealt_once(spark):
    lines = spark.createDataFrame([(1, 0, "§ 1  lautet: „a  b“"), (1, 1, "Abs. 2 entfällt."), (1, 2, None), (1, 3, "In § 3 wird „a“ durch „b“ ersetzt."), (2, 0, "Abs. 1 entfällt.")], "law int, seq long, line string")
    found = novelle._epochs(novelle.parsed(lines, ["law"], "seq", "line"), ["law"])
    plan = found._jdf.queryExecution()
    # Once each in the plan: folding of white space, the shuffle by the key, the sort by place.
    assert plan.optimizedPlan().toString().count("regexp_replace(") == 1
    physical = plan.executedPlan().toString()
    assert physical.count("Exchange hashpartitioning") == 1 and physical.count("Sort [") == 1
    got = {(r.law, r.seq): (r.kind, r.address, r.old, r.new) for r in found.collect()}
    assert got == {(1, 0): ("replace", "§1", None, "a b"), (1, 1): ("delete", "§1/2", None, None), (1, 2): (None, None, None, None), (1, 3): ("phrase", "§3", "a", "b"), (2, 0): ("delete", None, None, None)}


def test_units_are_moved_only_where_an_epoch_renumbers(spark, monkeypatch):
    calls = []
    real = novelle._renumbered
    monkeypatch.setattr(novelle, "_renumbered", lambda *a: calls.append(1) or real(*a))
    units = spark.createDataFrame([(1, "§1", "a"), (1, "§3", "c"), (2, "§1", "d")], "law int, address string, text string")
    lines = [(1, 0, "§ 3 entfällt."), (1, 1, "§ 1 erhält die Bezeichnung „§ 2“."), (1, 2, "§ 2 lautet: „b“"), (2, 0, "§ 1 entfällt.")]
    instructions = novelle.parsed(spark.createDataFrame(lines, "law int, seq long, line string"), ["law"], "seq", "line")
    after, told = novelle.applied(units, instructions, ["law"])
    assert {tuple(r) for r in after.select("law", "address", "text").collect()} == {(1, "§2", "b")}
    assert {(r.law, r.seq, r.refusal) for r in told.collect()} == {(1, 0, None), (1, 1, None), (1, 2, None), (2, 0, None)} and len(calls) == 1
