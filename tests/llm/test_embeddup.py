"""Near-duplicate vectors against all pairs, over groups of copies and odd inputs."""

import numpy as np

from strandline.llm import embeddup

SCHEMA = "vec_id long, embedding array<double>, label int, kept string"


def brute(rows, cosine=0.9):
    """Links and components of (vec_id, vector) rows: list of (n_links, component_id) in order."""
    fit = [v is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(x != 0 for x in v) for _, v in rows]
    unit = [np.array(v) / np.abs(v).max() if f else None for (_, v), f in zip(rows, fit, strict=True)]
    unit = [u / np.linalg.norm(u) if u is not None else None for u in unit]
    links = [[j for j, b in enumerate(unit) if j != i and a is not None and b is not None and len(a) == len(b) and a @ b >= cosine] for i, a in enumerate(unit)]
    label = list(range(len(rows)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, js in enumerate(links):
        for j in js:
            label[top(j)] = top(i)
    ids = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            ids[top(i)] = min(k, ids.get(top(i), k))
    return [(len(js), ids.get(top(i))) for i, js in enumerate(links)]


def compare(spark, rows):
    got = sorted(((r.vec_id is None, r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in embeddup.near_duplicates(spark.createDataFrame([(k, v, 1, "x") for k, v in rows], SCHEMA)).collect()), key=str)
    want = sorted(((k is None, k or 0, n, c, k == c if c is not None else True) for (k, _), (n, c) in zip(rows, brute(rows), strict=True)), key=str)
    assert got == want
    return got


def test_groups_of_copies_and_clouds(spark):
    rng = np.random.default_rng(5)
    rows = [(k, v.tolist()) for k, v in enumerate(rng.standard_normal((300, 32)))]
    near = lambda v, spread: (np.array(v) / np.linalg.norm(v) + spread * rng.standard_normal(32) / np.sqrt(32)).tolist()
    rows += [(1000 + k, near(rows[0][1], 0.1)) for k in range(150)]
    rows += [(2000 + k, near(rows[1][1], 0.3)) for k in range(80)]
    # A cloud whose pairs lie on both sides of the threshold.
    rows += [(3000 + k, near(rows[2][1], 0.33)) for k in range(60)]
    rows += [(4000 + k, rows[3][1]) for k in range(100)] + [(5000, [2.5 * x for x in rows[3][1]]), (5001, [-x for x in rows[3][1]])]
    rng.shuffle(rows)
    rows = [(int(k), [float(x) for x in v]) for k, v in rows]
    got = compare(spark, rows)
    assert max(n for _, _, n, _, _ in got) >= 150


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 0.0]), (8, [1e300, 1e290]), (9, [1e-310, 0.0]), (10, [1.0, 0.0, 0.0]), (11, [1.0]), (12, [5.0]), (13, [-1.0]), (None, [1.0, 0.0]), (None, [0.0, 1.0]), (7, [1.0, 0.0]), (7, [0.0, -1.0]), (14, [0.9, 0.435889894354067])]
    compare(spark, rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert embeddup.near_duplicates(empty).count() == 0
    assert embeddup.near_duplicates(spark.createDataFrame([(1, None, 1, "x")], SCHEMA)).collect()[0].kept


def test_one_vector_repeated_for_a_third(spark):
    rng = np.random.default_rng(6)
    same = rng.standard_normal(16).tolist()
    rows = [(k, same if k % 3 == 0 else rng.standard_normal(16).tolist()) for k in range(1200)]
    got = {r.vec_id: r for r in embeddup.near_duplicates(spark.createDataFrame([(k, v, 1, "x") for k, v in rows], SCHEMA)).collect()}
    assert all(got[k].n_links >= 399 and got[k].component_id == got[0].component_id for k in range(0, 1200, 3))


def test_calibration_and_recall():
    """At the threshold, at least the stated share of pairs reaches the count; far pairs hardly do."""
    for directions in (256, 2048):
        least = embeddup.calibrated(directions, 0.9)
        rng, reached = np.random.default_rng(99), {0.9: 0, 0.0: 0}
        for cosine in reached:
            counts = np.zeros(600)
            for _ in range(embeddup.FAMILIES):
                shared = []
                for _ in range(2):
                    x = rng.standard_normal((600, directions), np.float32)
                    y = np.float32(cosine) * x + np.float32((1 - cosine**2) ** 0.5) * rng.standard_normal((600, directions), np.float32)
                    a, b = embeddup.ends_of(x, embeddup.ENDS), embeddup.ends_of(y, embeddup.ENDS)
                    shared.append((a[:, :, None] == b[:, None, :]).sum(axis=(1, 2)))
                counts += shared[0] * shared[1]
            reached[cosine] = (counts >= least).mean()
        assert reached[0.9] >= 0.98 and reached[0.0] <= 0.005, (directions, least, reached)
