"""Mixing sources to target weights by weighted fair queueing.

A source's documents queue in a shuffled order that depends on the documents alone. A
document's virtual finish time is the source's tokens up to its end divided by the source's
target; a source whose target exceeds its size queues again, up to ``epochs`` times. All
sources are served by finish time until the total budget is used up. As every source gives
its target's worth of tokens per unit of time, equal spans of time hold equal amounts of
tokens, so the global sort by finish time has known range bounds: spans' sums locate the one
span in which the budget ends, and only there the order is made out document by document. What a
document gives then follows from its finish times alone.

Running sums never gather a source in one task: a source is parted by the shuffle's hash,
parts are summed first, and only a part is sorted. Rows that are equal in doc_id, source, text and size are counted first and queue as one,
so that thousands of them aren't one part's; their own places in the queue follow from their number.

Defined results: size is the number of words (null text: 0); documents of size 0 take part,
give nothing and count as served when their time comes; repeated rows queue one behind the other; very long texts count whole; a
table without words takes nothing, an empty one gives no rows; a null source is a source of its own, the last one, and a null doc_id an id like
others; other columns are ignored by ``mix`` and kept by ``repeated``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise, release

WORD = r"[^\x20\x09-\x0D]+"


def targets(sources: DataFrame, weights: tuple[float, ...] = (1, 2, 3), epochs: int = 3) -> DataFrame:
    """(source, source_size) -> with rank and target: weighted shares of all sizes, none above ``epochs`` sizes.

    With the sources sorted by the level at which they stop, epochs * size / weight, the final
    level is found from running sums: those that stop before it get their stop, the others level * weight.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.encode("source", "UTF-8"))
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = sources.withColumn("rank", F.row_number().over(by_name) - 1).withColumn("weight", cycle)
    ranked = ranked.withColumn("stop", epochs * F.col("source_size") / F.col("weight"))
    order = Window.orderBy("stop", "rank")
    full = Window.partitionBy(F.lit(0))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("given", F.coalesce(F.sum(epochs * F.col("source_size").cast("double")).over(before), F.lit(0.0)))
    ranked = ranked.withColumn("weights_left", F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing)))
    ranked = ranked.withColumn("level", (F.sum("source_size").over(full) - F.col("given")) / F.col("weights_left"))
    # The first source that stops at no lower than the level sets it.
    ranked = ranked.withColumn("final", F.min(F.when(F.col("stop") >= F.col("level"), F.struct("stop", "rank", "level"))).over(full)["level"])
    target = F.when(F.col("stop") < F.col("final"), epochs * F.col("source_size").cast("double")).otherwise(F.col("final") * F.col("weight"))
    return ranked.select("source", "rank", "source_size", F.coalesce(target, epochs * F.col("source_size").cast("double")).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), epochs: int = 3, seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken and served (times it is in the mix)."""
    spark = docs.sparkSession
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    shuffled = F.xxhash64("doc_id", F.lit(seed), F.xxhash64("text"))
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", size.alias("size"), shuffled.alias("shuffled"))
    sized = stored = materialise(sized, "sizes")
    n = sized.count()
    parts = int(min(1 << 20, max(64, n // 4_000)))
    sized = sized.groupBy("source", "doc_id", "shuffled", "size").agg(F.count(F.lit(1)).alias("rows"))
    sized = sized.withColumns({"part": F.pmod(F.shiftright("shuffled", 32), F.lit(parts)).cast("int"), "mass": F.col("size") * F.col("rows")})
    sums = sized.groupBy("source", "part").agg(F.sum("mass").alias("part_size"))
    # The sources' table, from which targets come; a row per source.
    source = targets(sums.groupBy("source").agg(F.sum("part_size").alias("source_size")), weights, epochs)
    sums = sums.withColumn("before", F.coalesce(F.sum("part_size").over(Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    sums = sums.alias("p").join(source.alias("s"), F.expr("p.source <=> s.source")).select(
        F.col("p.source").alias("source"), "part", "before", "rank", "source_size", "target"
    )
    inner = Window.partitionBy("source", "part").orderBy("shuffled", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queued = sized.withColumn("run", F.sum("mass").over(inner))
    queued = queued.alias("d").join(sums.alias("p"), F.expr("d.part = p.part AND d.source <=> p.source")).select(
        "d.doc_id", "d.source", "d.size", "d.shuffled", "d.rows", "p.rank", "p.source_size", "p.target", (F.col("d.run") + F.col("p.before") - F.col("d.mass")).alias("ahead")
    )
    queued = _each(queued).withColumn("upto", F.col("ahead") + (F.col("copy") + 1) * F.col("size")).drop("rows", "ahead", "copy")
    # A source without words has a target of zero: its documents finish at once.
    finish = lambda k: F.when(F.col("target") > 0, (F.col("upto") + k * F.col("source_size")) / F.col("target")).otherwise(F.lit(0.0))
    queued = materialise(queued, "queue")
    release(stored)
    spans = int(max(16, min(1 << 20, n // 20_000)))
    turns = queued.filter("size > 0").select(
        "size", F.posexplode(F.array(*[finish(k) for k in range(epochs)])).alias("turn", "finish"), "rank", "shuffled", "doc_id", "source_size"
    )
    turns = turns.withColumn("span", F.floor(F.least(F.col("finish"), F.lit(4.0)) * spans))
    filled = turns.groupBy("span").agg(F.sum("size").alias("tokens"))
    # At most 4 * spans + 1 rows; the budget is the sum of one turn.
    total = queued.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    filled = filled.withColumn("upto", F.sum("tokens").over(Window.orderBy("span")))
    edge = filled.filter(F.col("upto") > total).orderBy("span").select("span", (F.col("upto") - F.col("tokens")).alias("before")).first()
    if edge is None:
        served = F.lit(0)
        for k in range(epochs):
            served = served + F.when(finish(k) <= 1.0, 1).otherwise(0)
    else:
        order = ["finish", "rank", "turn", "shuffled", "doc_id", "size"]
        last = turns.filter(F.col("span") == edge["span"]).withColumn("upto", F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) + edge["before"])
        last = last.filter(F.col("upto") <= total).agg(F.max(F.struct(*order))).first()[0]
        cut = F.lit(edge["span"]) / spans
        served = F.lit(0)
        for k in range(epochs):
            f = finish(k)
            inside = F.floor(F.least(f, F.lit(4.0)) * spans) < edge["span"]
            if last is not None:
                here = F.struct(f.alias("finish"), "rank", F.lit(k).alias("turn"), "shuffled", "doc_id", "size")
                inside = inside | (here <= F.struct(*[F.lit(x).alias(c) for x, c in zip(last, order)]))
            served = served + F.when(inside, 1).otherwise(0)
    served = F.when(F.col("size") > 0, served).otherwise(1)
    out = queued.withColumn("served", served.cast("int"))
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("served")).alias("taken"), "served", "source", "shuffled")


def _each(groups: DataFrame, most: int = 4096) -> DataFrame:
    """A row for each of a group's ``rows``, numbered from 0 in ``copy``; large groups are dealt out in runs of ``most``."""
    few = groups.filter(F.col("rows") <= most).withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1)))
    runs = groups.filter(F.col("rows") > most).withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1, F.lit(most).cast("long"))))
    many = runs.repartition("shuffled", "from").withColumn("copy", F.explode(F.sequence(F.col("from"), F.least(F.col("from") + most, F.col("rows")) - 1))).drop("from")
    return few.unionByName(many)


def repeated(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), epochs: int = 3, seed: int = 17) -> DataFrame:
    """The documents, all their columns, each as many times as the mix takes it.

    Rows of one doc_id, source and text share their turns: each gets the whole part of their mean, and what is left goes to them in the
    order of all their columns, so that together they are there exactly as often as the mix takes them.
    """
    found = mix(docs, weights, epochs, seed)
    key = [F.col("doc_id").alias("mix_id"), F.col("source").alias("mix_source"), F.col("shuffled").alias("mix_key")]
    times = found.groupBy(*key).agg(F.sum("served").alias("served"), F.count(F.lit(1)).alias("rows"))
    times = materialise(times.select("mix_id", "mix_source", "mix_key", F.floor(F.col("served") / F.col("rows")).alias("times"), (F.col("served") % F.col("rows")).alias("more")), "times")
    shuffled = F.xxhash64("doc_id", F.lit(seed), F.xxhash64("text"))
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").cast("long").alias("id"), "source", shuffled.alias("hash"))
    same = F.col("id").eqNullSafe(F.col("mix_id")) & F.col("source").eqNullSafe(F.col("mix_source")) & (F.col("hash") == F.col("mix_key"))
    out = packed.join(times, same).filter("times > 0").select("row", F.explode(F.sequence(F.lit(1), "times")).alias("copy")).select("row.*")
    # Equal rows are counted before they meet, so a large group of them is a row here.
    left = packed.join(times.filter("more > 0"), same).groupBy("mix_id", "mix_source", "mix_key", "more", "row").agg(F.count(F.lit(1)).alias("n"))
    upto = F.sum("n").over(Window.partitionBy("mix_id", "mix_source", "mix_key").orderBy(F.xxhash64("row"), F.to_json("row")).rowsBetween(Window.unboundedPreceding, 0))
    left = left.withColumn("upto", upto).withColumn("n", F.least(F.col("n"), F.col("more") - F.col("upto") + F.col("n"))).filter("n > 0")
    return out.unionByName(left.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("copy")).select("row.*"))
