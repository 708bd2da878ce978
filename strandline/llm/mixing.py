"""Mixing sources to target weights with fixed-length blocks and index permutations.

Each source's words, its documents in a hashed order, are one stream cut into
blocks of ``BLOCK`` words. The mix is a sequence of slots in shards. Each slot
draws a source, so a shard's counts per source are multinomial; a source's
slots are numbered through, and slot j takes block perm(j) of the source, where
perm is a keyed pseudo-random permutation for each pass over the source. Draws
above a source's number of slots are handed to sources below theirs, so each
source gives exactly its target, rounded down to a word.

Everything runs on numbers; texts are only read to be counted (and, in
``mixed_documents``, to be cut). No step puts a source into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm.common import chunks_for, let, materialize, ranked, rewritten, unit, word_count, word_list

BLOCK = 128
SHARD = 4096
WEIGHTS = (5, 2, 1)
SHARE = (3, 2)
MOST = 2
SEED = 17
#: Intervals that the draw is looked up in.
CELLS = 4096
#: Steps of cycle walking. Walks of n indices leave the domain with probability below n**-0.5 a step, and with fewer
#: than so many cells outside they must end; a walk that does not is an error, never a lost block.
WALK = 24


def permuted(x: Column, n: Column, key: list[Column]) -> Column:
    """Where the keyed permutation of 0..n-1 sends ``x``: a four-round Feistel network on a grid of at least n cells, walked until it is below n."""
    a = F.ceil(F.sqrt(n.cast("double")))
    b = F.ceil(n / a)

    def mixed(value: Column, round_no: int) -> Column:
        return F.xxhash64(F.lit(SEED), *key, F.lit(round_no), value)

    def step(v: Column) -> Column:
        def second(p: Column) -> Column:
            return let(F.pmod(p["l"] + F.pmod(mixed(p["r"], 3), a), a), lambda left: left * b + F.pmod(p["r"] + F.pmod(mixed(left, 4), b), b))

        def first(v: Column) -> Column:
            left = F.floor(v / b)
            right = F.pmod(v, b)
            left = F.pmod(left + F.pmod(mixed(right, 1), a), a)
            return let(left, lambda m: F.struct(m.alias("l"), F.pmod(right + F.pmod(mixed(m, 2), b), b).alias("r")))

        return let(first(v), second).cast("long")

    walked = F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), step(x), lambda at, _: F.when(at < n, at).otherwise(step(at)))
    return F.when(walked < n, walked).otherwise(F.raise_error(F.lit("an index is still outside after all steps")))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: tuple[int, int] = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: source_no (code-point order, null last), source, source_size, weight, target.

    Targets share ``share`` of all words by weight; none is above ``most`` times
    its source's size, and what that cuts off is shared by weight among the
    others. Sources are taken in the order of size by weight: one is cut off if
    its limit is at most its share of what the sources before it leave.
    """
    up, down = share
    of = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.orderBy(F.col("source").asc_nulls_last())
    of = of.withColumn("source_no", F.row_number().over(everything) - 1)
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int"))
    exact = lambda c: c.cast("decimal(38,0)")
    of = of.withColumn("weight", weight.cast("long")).withColumn("limit", exact(F.col("source_size") * most))
    order = Window.orderBy(F.col("limit").cast("double") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(F.lit(0))
    of = of.withColumn("before", F.coalesce(F.sum("limit").over(order), F.lit(0))).withColumn("w_before", F.coalesce(F.sum("weight").over(order), F.lit(0)))
    of = of.withColumn("total", F.sum("source_size").over(whole)).withColumn("w_total", F.sum("weight").over(whole))
    open_words = exact(F.col("total")) * up - exact(F.col("before")) * down
    of = of.withColumn("cut", F.col("limit") * down * (F.col("w_total") - F.col("w_before")) <= F.col("weight") * open_words)
    gone = F.coalesce(F.sum(F.when(F.col("cut"), F.col("limit"))).over(whole), F.lit(0))
    w_gone = F.coalesce(F.sum(F.when(F.col("cut"), F.col("weight"))).over(whole), F.lit(0))
    left = (exact(F.col("total")) * up - exact(gone) * down).cast("double") / F.lit(float(down))
    target = F.when(F.col("cut"), F.col("limit").cast("double")).otherwise(left * F.col("weight") / (F.col("w_total") - w_gone))
    return of.withColumn("target", target).select("source_no", "source", "source_size", "weight", "target")


def placed(docs: DataFrame) -> DataFrame:
    """Every row's size and place in its source's stream: doc_id, source, size, mark (hash of id and text), start."""
    sized = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.xxhash64("doc_id", "text").alias("mark")), "sized")
    chunks = chunks_for(sized.count())
    sized = sized.withColumn("chunk", F.pmod("mark", F.lit(chunks)))
    sums = sized.groupBy("source", "chunk").agg(F.sum("size").alias("n"))
    earlier = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("_source"), F.col("chunk").alias("_chunk"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "chunk").orderBy("mark", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.withColumn("start", F.coalesce(F.sum("size").over(within), F.lit(0)))
    found = sized.join(offsets, sized["source"].eqNullSafe(offsets["_source"]) & (sized["chunk"] == offsets["_chunk"]))
    return materialize(found.select("doc_id", "source", "size", "mark", (F.col("start") + F.col("offset")).alias("start")), "placed")


def slots(sources: DataFrame, block: int = BLOCK, shard: int = SHARD) -> DataFrame:
    """The mix: slot, shard, source_no, pass, block, take (words of the block that the slot takes)."""
    words = F.floor("target").cast("long")
    blocks = F.floor(F.col("source_size") / block)
    tail = F.pmod("source_size", F.lit(block))
    s = sources.select("source_no", "source_size", words.alias("words"), blocks.alias("blocks"), (blocks + (tail > 0).cast("long")).alias("per_pass"), tail.alias("tail"))
    s = s.where("words > 0").withColumn("passes", F.floor(F.col("words") / F.col("source_size"))).withColumn("rest", F.pmod("words", "source_size"))
    s = s.withColumn("slots", F.col("passes") * F.col("per_pass") + F.ceil(F.col("rest") / block))
    upto = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    s = materialize(s.withColumn("from", F.coalesce(F.sum("slots").over(upto), F.lit(0))), "sources")
    total = s.agg(F.sum("slots")).first()[0] or 0
    cell = max(1, -(-total // CELLS))
    shelf = s.select("source_no", "slots", "from", F.explode(F.sequence(F.floor(F.col("from") / cell), F.floor((F.col("from") + F.col("slots") - 1) / cell))).alias("cell"))
    draws = s.sparkSession.range(total).select(F.col("id").alias("slot"), F.floor(F.col("id") / shard).alias("shard"), F.floor(unit(F.lit(SEED), F.lit("draw"), F.col("id")) * total).alias("v"))
    draws = draws.withColumn("cell", F.floor(F.col("v") / cell)).join(shelf, "cell").where("v >= from AND v < from + slots")
    # A shard's multinomial counts are the chunk sizes of this ranking.
    drawn = ranked(draws.select("slot", "shard", "source_no", "slots"), ["source_no"], F.col("shard"), ["slot"], max(1, -(-total // shard)), "j")
    drawn = materialize(drawn, "drawn")
    counts = drawn.groupBy("source_no").agg(F.count(F.lit(1)).alias("drawn"))
    s = s.join(counts, "source_no", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    over, under = F.greatest(F.col("drawn") - F.col("slots"), F.lit(0)), F.greatest(F.col("slots") - F.col("drawn"), F.lit(0))
    s = s.withColumn("over_from", F.coalesce(F.sum(over).over(upto), F.lit(0))).withColumn("under_from", F.coalesce(F.sum(under).over(upto), F.lit(0)))
    surplus = drawn.where("j >= slots").join(s.select("source_no", "over_from"), "source_no").select("slot", "shard", (F.col("over_from") + F.col("j") - F.col("slots")).alias("r"))
    missing = s.where("drawn < slots").select("source_no", "under_from", "drawn", F.explode(F.sequence("drawn", F.col("slots") - 1)).alias("j"))
    given = surplus.join(missing.select("source_no", "j", (F.col("under_from") + F.col("j") - F.col("drawn")).alias("r")), "r")
    columns = ["slot", "shard", "source_no", "j"]
    kept = drawn.where("j < slots").select(*columns).unionByName(given.select(*columns))
    kept = kept.join(s.select("source_no", "blocks", "per_pass", "passes", "rest", "tail"), "source_no")
    kept = kept.withColumn("pass", F.floor(F.col("j") / F.col("per_pass"))).withColumn("pos", F.pmod("j", "per_pass"))
    full = F.col("pos") < F.col("blocks")
    index = F.when(full, permuted(F.col("pos"), F.col("blocks"), [F.col("source_no"), F.col("pass")])).otherwise(F.col("blocks"))
    # The tail is the last of a pass, so what is taken before a position needs no sum.
    have = F.when(full, F.lit(block)).otherwise(F.col("tail"))
    take = F.when(F.col("pass") < F.col("passes"), have).otherwise(F.least(have, F.col("rest") - F.col("pos") * block))
    return kept.select("slot", "shard", "source_no", "pass", index.alias("block"), take.alias("take"))


def fragments(docs: DataFrame, block: int = BLOCK, shard: int = SHARD) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The mix of ``docs`` (doc_id, text, source) as word ranges of documents.

    Returns the fragments (shard, slot, source_no, pass, block, doc_id, mark, start,
    first_word, n_words), the documents' places and the sources' targets.
    """
    at = placed(docs)
    sources = materialize(targets(at), "targets")
    names = sources.select("source_no", F.col("source").alias("_source"))
    at = at.join(names, at["source"].eqNullSafe(names["_source"])).drop("_source")
    rows = at.where("size > 0")
    cut = rows.select("source_no", "doc_id", "mark", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("block"))
    begin = F.greatest(F.col("start") - F.col("block") * block, F.lit(0))
    end = F.least(F.col("start") + F.col("size") - F.col("block") * block, F.lit(block))
    parts = cut.select("source_no", "block", "doc_id", "mark", "start", begin.alias("begin"), end.alias("end"))
    joined = slots(sources, block, shard).join(parts, ["source_no", "block"]).where("begin < take")
    found = joined.select(
        "shard", "slot", "source_no", "pass", "block", "doc_id", "mark", "start",
        (F.col("block") * block + F.col("begin") - F.col("start")).alias("first_word"), (F.least("end", "take") - F.col("begin")).alias("n_words"),
    )
    return found, at, sources


def mix_summary(docs: DataFrame) -> DataFrame:
    """Per row of ``docs``: doc_id, size, source_size, target, taken.

    Null texts have size 0 and are never taken; a null source is a source of its
    own, the last. Repeated rows lie in the stream each and have a row each. No
    documents give no rows. Reruns agree: draws and permutations depend on
    numbers, the order in a stream on ids and texts.
    """
    found, at, sources = fragments(docs)
    taken = found.groupBy("source_no", "start").agg(F.sum("n_words").alias("taken"))
    rows = at.join(taken, ["source_no", "start"], "left").join(sources.select("source_no", "source_size", "target"), "source_no")
    return rows.select("doc_id", "size", "source_size", "target", F.when(F.col("size") > 0, F.coalesce("taken", F.lit(0))).otherwise(F.lit(0)).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The mix as documents: a row for each document and pass that takes words of it, with the columns of ``docs``.

    A document taken whole keeps its text; of another, the runs of words taken
    stand in order, words joined by a space, runs by a line end. ``n_chars``
    follows the text. Texts without words (null, empty) are never taken. Of
    repeated rows each has its own place in the stream and its own runs. Columns
    may have any names. No documents give no rows.
    """
    found, at, _ = fragments(docs)
    runs = found.groupBy("source_no", "start", "pass").agg(F.sort_array(F.collect_list(F.struct("first_word", "n_words"))).alias("runs"))
    sizes = at.where("size > 0").select("doc_id", "mark", "source_no", "start", "size", F.row_number().over(Window.partitionBy("doc_id", "mark").orderBy("start")).alias("copy"))
    runs = runs.join(sizes, ["source_no", "start"]).select("doc_id", "mark", "copy", "size", "runs")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64("doc_id", "text").alias("row_mark"))
    rows = rows.withColumn("row_copy", F.row_number().over(Window.partitionBy("row.doc_id", "row_mark").orderBy("row_mark")))
    joined = rows.join(runs, rows["row.doc_id"].eqNullSafe(runs["doc_id"]) & (rows["row_mark"] == runs["mark"]) & (rows["row_copy"] == runs["copy"]))
    taken = F.aggregate("runs", F.lit(0).cast("long"), lambda n, r: n + r["n_words"])

    def parts(words: Column) -> Column:
        # A run that goes on where the last one ended joins it by a space.
        texts = F.transform("runs", lambda r, i: F.concat(F.when(i == 0, "").when(F.get(F.col("runs"), i - 1)["first_word"] + F.get(F.col("runs"), i - 1)["n_words"] == r["first_word"], " ").otherwise("\n"), F.array_join(F.slice(words, (r["first_word"] + 1).cast("int"), r["n_words"].cast("int")), " ")))
        return F.array_join(texts, "")

    text = F.when(taken == F.col("size"), F.col("row.text")).otherwise(let(word_list(F.col("row.text")), parts))
    return joined.select("row", text.alias("mixed")).select(*rewritten(docs, F.col("row"), F.col("mixed")))
