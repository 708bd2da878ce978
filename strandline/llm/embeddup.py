"""Near-duplicate vectors by collision counts over many one-dimensional projections.

Each vector is projected on many random directions. Only the two ends of a
direction's sorted list are kept: a vector looks around itself on the few
directions where it stands furthest out, and its window there is the end of the
list it stands in. Windows of one direction still hold a fixed share of all
vectors, so the pairs in them would grow with the square of the rows; windows are
therefore met two at a time, one from each half of a family of directions, and a
family has more directions the more vectors there are. How many of these joint
windows two vectors share is their collision count; pairs that reach a count
calibrated on simulated pairs at the threshold are verified in doubles.

Groups of copies are never written out as pairs. Equal vectors are one class. A
vector within half the threshold's angle of another that shares its windows
joins that one's ball: by the triangle inequality, all members of a ball are
linked. Balls meet balls; where the angle between centres and the radii leave
open whether members are linked, their blocks are compared as matrices.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm.common import joined_salted, joined_spread, materialize
from strandline.llm.components import components

COSINE = 0.9
#: Families of directions; a joint window is of one family.
FAMILIES = 4
#: On so many directions of each half of a family a vector looks around itself.
ENDS = 6
#: Share of pairs at the threshold that must reach the collision count, at least.
RECALL = 0.995
SEED = 20_11
#: Members of a block of a ball.
BLOCK = 64
#: Angles this close to a bound (radians) are verified.
MARGIN = 1e-9


def directions_for(rows: int) -> int:
    """Directions in each half of a family: in proportion to the root of the vectors, so that joint windows hold few of them at any size."""
    return max(256, 1 << math.ceil(math.log2(9 * math.sqrt(max(rows, 1)))))


def ends_of(values: np.ndarray, ends: int) -> np.ndarray:
    """For each row of projections, the directions (twice the index, one more on the low side) where it stands furthest out."""
    ends = min(ends, values.shape[1])
    at = np.argpartition(-np.abs(values), ends - 1, axis=1)[:, :ends]
    return 2 * at + (np.take_along_axis(values, at, axis=1) < 0)


def calibrated(directions: int, cosine: float, families: int = FAMILIES, ends: int = ENDS, recall: float = RECALL, pairs: int = 4000) -> int:
    """The largest collision count that at least ``recall`` of pairs with exactly ``cosine`` reach (1 at least).

    A pair's projections on a random direction are normal with the pair's cosine
    as correlation whatever the dimension, so pairs are simulated as such.
    """
    rng, counts = np.random.default_rng([SEED, directions]), np.zeros(pairs, np.int64)
    for begun in range(0, pairs, 500):
        size = min(500, pairs - begun)
        for _ in range(families):
            shared = []
            for _ in range(2):
                x = rng.standard_normal((size, directions), np.float32)
                y = np.float32(cosine) * x + np.float32(math.sqrt(1 - cosine**2)) * rng.standard_normal((size, directions), np.float32)
                a, b = ends_of(x, ends), ends_of(y, ends)
                shared.append((a[:, :, None] == b[:, None, :]).sum(axis=(1, 2)))
            counts[begun : begun + size] += shared[0] * shared[1]
    return max(1, int(np.sort(counts)[int((1 - recall) * pairs)]))


def windows(classes: DataFrame, directions: int, families: int = FAMILIES, ends: int = ENDS) -> DataFrame:
    """The joint windows of every class (cid, v): cid, keys. Vectors of different dimensions share none."""

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drawn: dict[int, list[list[np.ndarray]]] = {}
        for batch in batches:
            ids, v = batch.column(0).to_numpy(), batch.column(1)
            sizes = v.value_lengths().to_numpy()
            for dim in np.unique(sizes).tolist():
                if dim not in drawn:
                    drawn[dim] = [[np.random.default_rng([SEED, dim, f, half]).standard_normal((dim, directions), np.float32) for half in range(2)] for f in range(families)]
                rows = np.flatnonzero(sizes == dim)
                for begun in range(0, len(rows), 512):
                    some = rows[begun : begun + 512]
                    x = v.take(pa.array(some)).flatten().to_numpy().reshape(len(some), dim).astype(np.float32)
                    keys = []
                    for f, (one, two) in enumerate(drawn[dim]):
                        a, b = ends_of(x @ one, ends).astype(np.int64), ends_of(x @ two, ends).astype(np.int64)
                        keys.append((((dim * families + f) * 2 * directions + a[:, :, None]) * 2 * directions + b[:, None, :]).reshape(len(some), -1))
                    found = np.concatenate(keys, axis=1)
                    flat = pa.array(found.ravel(), pa.int64())
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * found.shape[1]), flat)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[some], pa.int64()), lists], names=["cid", "keys"])

    return classes.select("cid", "v").mapInArrow(project, "cid long, keys array<long>")


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def angle(a: str, b: str) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))))


def unit_vectors(vectors: DataFrame) -> DataFrame:
    """Rows (vec_id, h1, h2, v) with ``v`` of length one; null where the vector is null, empty, zero or holds null or non-finite components."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1)
            sizes, flat = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64), lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(sizes)])
            found: list[np.ndarray | None] = []
            for a, b in zip(ends[:-1], ends[1:], strict=True):
                x = flat[a:b].astype(np.float64)
                # Scaled by the largest component first, so that no square overflows or vanishes.
                most = np.abs(x).max() if b > a else 0.0
                fit = np.isfinite(most) and most > 0
                found.append((x / most) / np.linalg.norm(x / most) + 0.0 if fit else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float64()))], names=["vec_id", "v"])

    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>")).mapInArrow(scale, f"vec_id {kind}, v array<double>")
    return rows.select("vec_id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit("second"), "v").alias("h2"), "v")


def balls_of(classes: DataFrame, keys: DataFrame, least: int, cosine: float) -> DataFrame:
    """The ball of every class: cid, ball (its centre's cid), apart (angle to the centre).

    In each joint window the class with the least cid is the centre proposed to
    all others in it; of the proposed ones with enough collisions that are near
    enough, a class takes the least. A class without any is its own centre.
    """
    listed = keys.select("cid", F.explode("keys").alias("key"))
    lists = listed.groupBy("key").agg(F.min("cid").alias("centre"), F.count(F.lit(1)).alias("held")).where("held > 1")
    proposed = joined_spread(listed, lists, ["key"], "held").where("centre < cid").groupBy("cid", "centre").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("cid", "centre")
    proposed = materialize(proposed, "proposed")
    near = joined_salted(proposed, classes.select(F.col("cid").alias("centre"), F.col("v").alias("w")), "centre").join(classes.select("cid", "v"), "cid").select("cid", "centre", angle("v", "w").alias("apart"))
    taken = near.where(F.col("apart") <= math.acos(cosine) / 2 - MARGIN).groupBy("cid").agg(F.min(F.struct("centre", "apart")).alias("of"))
    return classes.select("cid", "copies", "rep").join(taken, "cid", "left").select("cid", "copies", "rep", F.coalesce("of.centre", "cid").alias("ball"), F.coalesce("of.apart", F.lit(0.0)).alias("apart"))


def met_balls(keys: DataFrame, balls: DataFrame, least: int) -> DataFrame:
    """Pairs of balls (a, b) whose members share enough joint windows."""
    held = materialize(keys.join(balls.select("cid", "ball"), "cid").select("ball", F.explode("keys").alias("key")).distinct(), "windows")
    return held.select("key", F.col("ball").alias("a")).join(held.select("key", F.col("ball").alias("b")), "key").where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("a", "b")


def compared(pairs: DataFrame, members: DataFrame, cosine: float) -> DataFrame:
    """Links between members of the ball pairs (a, b), block by block: a, b, cid, n (vectors linked to the class cid, more than 0)."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("ball")).distinct()
    members = members.join(wanted, "ball", "left_semi")
    sizes = members.groupBy("ball").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("blocks"))
    dealt = members.join(sizes, "ball").select("ball", F.pmod(F.xxhash64("cid"), "blocks").alias("block"), F.struct("cid", "copies", "v").alias("m"))
    blocks = materialize(dealt.groupBy("ball", "block").agg(F.collect_list("m").alias("m")).select("ball", F.col("m.cid").alias("ids"), F.col("m.copies").alias("copies"), F.flatten("m.v").alias("v")), "members")
    side = lambda s: blocks.select(F.col("ball").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("ids", "copies", "v")])
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ids_a", "copies_a", "v_a", "ids_b", "copies_b", "v_b")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[np.ndarray] = []
            for i in range(batch.num_rows):
                a, b = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                ids, copies, v = ([batch.column(c)[i].values.to_numpy() for c in (k, k + 3)] for k in (2, 3, 4))
                one, two = (x.reshape(len(k), -1) for x, k in zip(v, ids, strict=True))
                linked = one @ two.T >= cosine
                for k, n in ((ids[0], linked @ copies[1]), (ids[1], copies[0] @ linked)):
                    some = n > 0
                    out.append(np.stack([np.full(some.sum(), a), np.full(some.sum(), b), k[some], n[some]]))
            found = np.concatenate(out, axis=1) if out else np.zeros((4, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found], names=["a", "b", "cid", "n"])

    return both.mapInArrow(compare, "a long, b long, cid long, n long")


def near_duplicates(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """Link the rows of ``vectors`` (vec_id, embedding) with a cosine of ``cosine`` or more: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components
    link with nothing, nor do vectors of different dimensions with each other.
    Equal vectors link. Rows are vectors of their own also where a vec_id
    repeats. component_id is the smallest vec_id reachable; a null vec_id never
    is it, and is null only where no row of the component has an id; such rows
    are kept. Vectors of any dimension count whole; an empty table gives no rows;
    other columns are ignored.
    """
    rows = materialize(unit_vectors(vectors), "vectors")
    fit = rows.where("v IS NOT NULL")
    classes = materialize(fit.groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.any_value("v").alias("v")).withColumn("cid", F.monotonically_increasing_id()), "classes")
    directions = directions_for(classes.count())
    least = calibrated(directions, cosine)
    keys = materialize(windows(classes, directions), "keys")
    balls = materialize(balls_of(classes, keys, least, cosine), "balls")
    size = balls.groupBy("ball").agg(F.sum("copies").alias("members"), F.max("apart").alias("radius"))
    size = materialize(size.join(classes.select(F.col("cid").alias("ball"), F.col("v").alias("centre")), "ball"), "sizes")
    met = met_balls(keys, balls, least)
    side = lambda s: size.select(F.col("ball").alias(s), F.col("members").alias(f"members_{s}"), F.col("radius").alias(f"radius_{s}"), F.col("centre").alias(f"centre_{s}"))
    reach = F.col("radius_a") + F.col("radius_b")
    placed = met.join(side("a"), "a").join(side("b"), "b").select("a", "b", "members_a", "members_b", reach.alias("reach"), angle("centre_a", "centre_b").alias("apart"))
    bound = math.acos(cosine)
    placed = materialize(placed.where(F.col("apart") - F.col("reach") <= bound + MARGIN).withColumn("whole", F.col("apart") + F.col("reach") <= bound - MARGIN), "placed")
    of_ball = balls.select("cid", "ball", "copies").join(classes.select("cid", "v"), "cid")
    some = materialize(compared(placed.where("NOT whole").select("a", "b"), of_ball, cosine), "links")
    whole = placed.where("whole")
    beside = whole.select(F.col("a").alias("ball"), F.col("members_b").alias("n")).unionByName(whole.select(F.col("b").alias("ball"), F.col("members_a").alias("n"))).groupBy("ball").agg(F.sum("n").alias("beside"))
    joined = components(whole.select("a", "b").unionByName(some.select("a", "b")).distinct())
    labelled = size.select("ball", "members").join(joined.withColumnRenamed("node", "ball"), "ball", "left").join(beside, "ball", "left").select("ball", "members", F.coalesce("component", "ball").alias("component"), F.coalesce("beside", F.lit(0)).alias("beside"))
    several = some.groupBy("cid").agg(F.sum("n").alias("several"))
    placed_in = materialize(balls.select("cid", "ball", "rep").join(labelled, "ball"), "labelled")
    least_id = placed_in.groupBy("component").agg(F.min("rep").alias("component_id"), F.count(F.lit(1)).alias("held"))
    found = joined_spread(placed_in, least_id, ["component"], "held").join(several, "cid", "left").select("cid", "component_id", (F.col("members") - 1 + F.col("beside") + F.coalesce("several", F.lit(0))).cast("long").alias("n_links"))
    of_class = materialize(classes.select("cid", "h1", "h2", "copies").join(found, "cid"), "found")
    linked = joined_spread(fit.select("vec_id", "h1", "h2"), of_class, ["h1", "h2"], "copies").select("vec_id", "n_links", "component_id")
    alone = rows.where("v IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    kept = F.coalesce(F.col("vec_id") == F.col("component_id"), F.col("component_id").isNull())
    return linked.unionByName(alone).select("vec_id", "n_links", "component_id", kept.alias("kept"))


#: ``near_duplicates`` of ``embeddings`` by comparing every pair of vectors.
ORACLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
), v AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM d WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0
), p AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) / (a.n * b.n) >= {COSINE}::DOUBLE
), r AS (
  SELECT a AS node, b AS seen FROM p UNION SELECT r.node, p.b FROM r JOIN p ON p.a = r.seen
), l AS (
  SELECT a AS node, count(*) AS n FROM p GROUP BY a
), m AS (
  SELECT node, min(seen) AS least FROM r GROUP BY node
)
SELECT vec_id, coalesce(l.n, 0) AS n_links, least(vec_id, coalesce(m.least, vec_id)) AS component_id, vec_id <= coalesce(m.least, vec_id) AS kept
FROM embeddings LEFT JOIN l ON l.node = vec_id LEFT JOIN m ON m.node = vec_id
"""
