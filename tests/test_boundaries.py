"""Law boundaries against the rules written as a loop, and what right columns may say."""

import random
from collections import defaultdict

from strandline.operators import boundaries


def looped(candidates, articles):
    """The headings that stand, rule by rule: {pos: index}."""
    fits = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0

    def clear(words, among):
        scores = sorted(((fits(words, a["words"]), a["index"]) for a in among), reverse=True)
        return scores[0][1] if scores and scores[0][0] >= 0.6 and (len(scores) < 2 or scores[1][0] < scores[0][0]) else None

    roman = lambda n: n is not None and not set(n) - set("IVXL")
    found, bare = {}, set()
    for c in sorted(candidates, key=lambda c: c["pos"]):
        same = [a for a in articles if a["numeral"] is not None and a["numeral"] == c["numeral"]]
        if c["numeral"] is None:
            index = clear(c["words"], [a for a in articles if a["amends"]])
        elif roman(c["numeral"]) and not any(roman(a["numeral"]) for a in articles):
            index = None
        elif len(same) != 1:
            index = clear(c["words"], articles)
        else:
            title = clear(c["words"], articles)
            agrees = not c["words"] or not same[0]["words"] or fits(c["words"], same[0]["words"]) >= 0.34
            index = same[0]["index"]
            if not agrees and title is not None and title != index:
                index = title
            elif not agrees or not c["words"] or title is None:
                bare.add(c["pos"])
        if index is not None and index not in found.values():
            found[c["pos"]] = index
    furthest = -1
    for pos in sorted(found):
        if pos in bare and found[pos] <= furthest:
            del found[pos]
        else:
            furthest = max(furthest, found[pos])
    return found


def test_boundaries_equal_the_loop(spark):
    rng = random.Random(11)
    words = ["water", "law", "of", "trade", "tax", "school", "road"]
    articles, candidates = [], []
    for package in range(60):
        style = rng.choice(["arabic", "roman", "none"])
        n = rng.randrange(1, 6)
        names = [rng.sample(words, rng.randrange(0, 4)) for _ in range(n)]
        for i in range(n):
            numeral = {"arabic": str(i + 1), "roman": ["I", "II", "III", "IV", "V"][i], "none": None}[style]
            articles.append((package, i, numeral if rng.random() > 0.1 else "1" if style == "arabic" else None, names[i], rng.random() > 0.3))
        for pos in range(rng.randrange(0, 9)):
            i = rng.randrange(n)
            numeral = rng.choice([str(i + 1), str(i + 1), ["I", "II", "III", "IV", "V"][i], None])
            candidates.append((package, pos, numeral, rng.choice([names[i], names[i], [], rng.sample(words, 2)])))
    a = spark.createDataFrame(articles, "package int, index int, numeral string, words array<string>, amends boolean")
    c = spark.createDataFrame(candidates, "package int, pos long, numeral string, words array<string>")
    got = defaultdict(dict)
    for r in boundaries.accepted(c, a, ["package"]).collect():
        got[r.package][r.pos] = r["index"]
    asked, drafted = defaultdict(list), defaultdict(list)
    for p, pos, numeral, w in candidates:
        asked[p].append({"pos": pos, "numeral": numeral, "words": w})
    for p, i, numeral, w, amends in articles:
        drafted[p].append({"index": i, "numeral": numeral, "words": w, "amends": amends})
    want = {p: looped(asked[p], drafted[p]) for p in drafted}
    assert {p: got[p] for p in drafted} == want
    verdicts = {r.package: r for r in boundaries.resolved(c, a, ["package"]).collect()}
    assert verdicts.keys() == drafted.keys()
    for p, found in want.items():
        amending = [x["index"] for x in drafted[p] if x["amends"]]
        if found:
            unsound = [i for i in found.values() if (later := [x for x in amending if x > i]) and min(later) not in found.values()]
            assert verdicts[p].verdict == ("skipped" if unsound else "divided")
        elif any(x["numeral"] and set(x["numeral"]) - set("IVXL") for x in asked[p]) and not any(x["numeral"] for x in drafted[p]):
            assert verdicts[p].verdict == "undrafted"
        elif len(amending) > 1:
            assert verdicts[p].verdict == "undivided"
        else:
            assert verdicts[p].verdict == "whole" and verdicts[p].whole == (amending[0] if amending else drafted[p][0]["index"] if len(drafted[p]) == 1 else None)
    rows = spark.createDataFrame([(p, pos) for p in drafted for pos in range(9)], "package int, pos long")
    laws = {(r.package, r.pos): r.law for r in boundaries.assigned(rows, c, a, ["package"]).collect()}
    for p, found in want.items():
        for pos in range(9):
            before = [x for x in found if x <= pos]
            v = verdicts[p].verdict
            assert laws[p, pos] == (found[max(before)] if v == "divided" and before else verdicts[p].whole if v == "whole" else None)


def test_right_column(spark):
    rows = spark.createDataFrame([(1, 1, "the old", "the old and six more words stand here now"), (1, 2, "alpha", "beta gamma"), (1, 3, "repealed one", ""), (1, 4, "same", "same"), (1, 5, None, " ".join(f"new{i}" for i in range(12)))], "law int, pos long, current string, proposed string")
    standing = spark.createDataFrame([(1, "before: and six more words stand here now, after")], "law int, text string")
    draft = spark.createDataFrame([(1, "beta gamma new0 new1")], "law int, text string")
    got = {r.pos: (r.in_force, r.new_words, r.missing, r.doubtful, r.unproven) for r in boundaries.right_column(rows, standing, draft, ["law"]).collect()}
    assert got == {1: (True, 7, 7, False, False), 2: (False, 2, 0, False, False), 3: (False, 0, 0, False, True), 4: (False, 0, 0, False, False), 5: (False, 12, 10, True, False)}
    said = spark.createDataFrame([(1, "§ 3 entfällt")], "law int, text string")
    assert not any(r.unproven for r in boundaries.right_column(rows, standing, said, ["law"]).collect())
