"""Operator 11: sources mixed to target weights by weighted fair queueing, in DataFrame operations only.

Each source queues its documents in a shuffled order (of the MD5 of seed, id and text), over again for each repeat. Its target
is a share by weight of the budget, which is ``share`` times all words, and at most ``repeats`` times what the source has; what
exceeds that is shared again among the others. A document's virtual finish time is what its source has queued up to its end,
divided by the source's target. A document that crosses its source's target is queued as two packets, cut there, so that long
documents can't leave a source far from its target. Packets are sorted by finish time over all sources, and the mix is
truncated where their running total reaches the budget.

No source is a group of rows: a queue is cut into buckets of the leading digits of the shuffled order, whose totals are summed
first, so running totals inside a bucket and before it give a document's place. Equal rows are counted, and lie in the queue
in runs of ``RUN`` at most. The sorted packets lie in ranges; only the one range that holds the end of the budget is summed row
by row. The rounds that share the excess each read one row of sums.

Defined results: null texts have size 0, and rows of size 0 are never in the mix; a null source is one of its own, last in the
order; ids may be null, of any type and repeated (equal rows differ in how often the mix has them, not in anything else);
sources without words have target 0; an empty table gives empty tables; other columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, join_unique, written

#: Equal rows of a run, and rows of a bucket of a source.
RUN, BUCKET = 1000, 4000
#: Hexadecimal digits of the shuffled order that number buckets.
_DIGITS = 7


class Mix(NamedTuple):
    """``documents``: a row for each input row (source, doc_id, size, source_size, target, taken).

    ``packets``: (source, source_rank, doc_id, repeat, words, stop, finish, range, position) of what the mix takes, whose order
    is that of (finish, source_rank, stop); it lies in files by range, and ``position`` is where its range begins in the mix.
    """

    documents: DataFrame
    packets: DataFrame


def _queue(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """Runs of equal rows: (src, source, doc_id, size, turn, run, copies); ``src`` names a source and is never null."""
    text, doc, source = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")), F.col(f"`{id_col}`"), F.col(f"`{source_col}`").cast("string")
    turn = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(doc.cast("string"), F.lit("")), text))
    rows = docs.select(F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("src"), source.alias("source"), doc.alias("doc_id"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), turn.alias("turn"))
    counted = rows.groupBy("src", "source", "doc_id", "size", "turn").agg(F.count("*").alias("n"))
    runs = counted.withColumn("run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RUN))))
    return runs.select("src", "source", "doc_id", "size", F.when(F.col("run") == 0, F.col("turn")).otherwise(F.md5(F.concat_ws(":", "turn", F.col("run").cast("string")))).alias("turn"), "run", F.least(F.lit(RUN).cast("long"), F.col("n") - F.col("run") * RUN).alias("copies"))


def ranked(sources: DataFrame, parts: int) -> DataFrame:
    """``sources`` with ``rank`` from 0 in code point order, null last: ranks inside ranges, and what lies in the ranges before."""
    dealt = written(sources.repartitionByRange(parts, F.col("source").asc_nulls_last()).withColumn("range", F.spark_partition_id()), "source-ranges")
    before = dealt.groupBy("range").count().withColumn("before", F.sum("count").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)))  # a row for each range
    inside = dealt.withColumn("inside", F.row_number().over(Window.partitionBy("range").orderBy(F.col("source").asc_nulls_last())))
    return inside.join(F.broadcast(before), "range").withColumn("rank", F.coalesce("before", F.lit(0)) + F.col("inside") - 1).drop("range", "before", "inside", "count")


def targets(sources: DataFrame, share: float = 1.5, repeats: int = 2) -> DataFrame:
    """``sources`` (source_size, weight) with ``target``; their targets sum to ``share`` of all sizes.

    The level (words for each unit of weight) only rises from round to round, as in Newton's method on a concave function, so
    the rounds end; each is one row of sums.
    """
    cap = F.col("source_size") * repeats
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:
        full = cap <= F.col("weight") * F.lit(level)
        row = sources.agg(F.coalesce(F.sum(F.when(full, cap)), F.lit(0)).alias("full"), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0)).alias("open")).first()
        if not row.open:
            break
        raised = (share * total - row.full) / row.open
        if raised <= level:
            break
        level = raised
    return sources.withColumn("target", F.least(cap.cast("double"), F.col("weight") * F.lit(level)))


def _in_order(queue: DataFrame, sources: DataFrame, buckets: int) -> DataFrame:
    """Each run with its bucket's and its own words before, and its source's figures; groups are buckets of a source."""
    bucket = F.floor(F.conv(F.substring("turn", 1, _DIGITS), 16, 10).cast("long") * buckets / (16**_DIGITS)).cast("int")
    rows = queue.withColumn("bucket", bucket)
    words = F.col("size") * F.col("copies")
    sums = written(rows.groupBy("src", "bucket").agg(F.sum(words).alias("words")), "buckets")
    before = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    places = sums.withColumn("ahead", F.coalesce(F.sum("words").over(before), F.lit(0))).join(sources.select("src", "rank", "source_size", "target"), "src").drop("words")
    inside = Window.partitionBy("src", "bucket").orderBy("turn", "run", "size", F.col("doc_id").cast("string")).rowsBetween(Window.unboundedPreceding, -1)
    own = rows.join(places.hint("shuffle_hash"), ["src", "bucket"]).withColumn("start", F.col("ahead") + F.coalesce(F.sum(words).over(inside), F.lit(0)))
    return own.drop("ahead", "bucket")


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight_of: DataFrame | None = None, seed: str = "mix") -> Mix:
    """Mix all of ``docs``. Sources in order take the ``weights`` in turn, or theirs of ``weight_of`` (source, weight; others none)."""
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    queue = written(_queue(docs, id_col, text_col, source_col, seed), "queue")
    sources = written(queue.groupBy("src", "source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("runs")), "sources")
    if weight_of is None:
        weighed = ranked(sources, parts).withColumn("weight", F.get(F.array(*map(F.lit, weights)), F.pmod("rank", F.lit(len(weights))).cast("int")))
    else:
        given = weight_of.select(F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("src"), "weight").dropDuplicates(["src"])
        weighed = ranked(sources, parts).join(given, "src", "left").fillna({"weight": 0})
    sources = written(targets(written(weighed, "weights"), share, repeats), "targets")
    totals = sources.agg(F.sum("source_size").alias("words"), F.sum("runs").alias("runs"), F.count("*").alias("sources")).first()
    budget, runs = int(share * (totals.words or 0)), totals.runs or 0
    order = written(_in_order(queue, sources, max(1, -(-runs // BUCKET))), "order")

    # what may be taken beyond targets is less than a word of each source: packets further out needn't be sorted
    size, limit = F.col("size"), F.floor("target")
    copy = F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))
    once = order.filter("size > 0 and target > 0").withColumn("repeat", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1)))).withColumn("start", F.col("start") + F.col("repeat") * F.col("source_size"))
    single = once.filter(F.col("start") < F.col("target") + totals.sources).withColumn("copy", copy).withColumn("start", F.col("start") + F.col("copy") * size)
    ends = F.array(F.struct(F.col("start").alias("from"), F.least(F.col("start") + size, F.greatest(limit, F.col("start"))).alias("to")), F.struct(F.greatest(F.col("start"), F.least(limit, F.col("start") + size)).alias("from"), (F.col("start") + size).alias("to")))
    packets = single.select("source", "rank", "doc_id", "repeat", "target", F.explode(ends).alias("p")).filter("p.to > p.from")
    timed = packets.select("source", F.col("rank").alias("source_rank"), "doc_id", (F.col("repeat") + 1).alias("repeat"), (F.col("p.to") - F.col("p.from")).alias("words"), F.col("p.to").alias("stop"), (F.col("p.to") / F.col("target")).alias("finish"))
    keys = ["finish", "source_rank", "stop"]
    line = written(timed.repartitionByRange(max(parts, 2), *keys).sortWithinPartitions(*keys).withColumn("range", F.spark_partition_id()), "line")

    ranges = line.groupBy("range").agg(F.sum("words").alias("total")).withColumn("position", F.coalesce(F.sum("total").over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranges = written(ranges.filter(F.col("position") < budget), "ranges")
    whole = line.join(F.broadcast(ranges.filter(F.col("position") + F.col("total") <= budget).select("range", "position")), "range")
    last = line.join(F.broadcast(ranges.filter(F.col("position") + F.col("total") > budget).select("range", "position")), "range")  # of one range at most
    ahead = F.coalesce(F.sum("words").over(Window.partitionBy("range").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = last.withColumn("left", F.lit(budget) - F.col("position") - ahead).filter(F.col("left") > 0)
    cut = cut.withColumn("stop", F.col("stop") - F.greatest(F.lit(0).cast("long"), F.col("words") - F.col("left"))).withColumn("words", F.least("words", "left")).drop("left")
    taken = written(whole.unionByName(cut), "mix")

    # a source's part of the mix is a prefix of its queue
    reached = taken.groupBy("source_rank").agg(F.max("stop").alias("reached"))
    prefix = written(sources.join(reached, F.col("rank") == F.col("source_rank"), "left").select(F.col("rank"), "runs", F.coalesce("reached", F.lit(0)).alias("reached")), "prefixes")
    back = join_unique(order, prefix, "rank", "runs", runs).withColumn("copy", copy).withColumn("start", F.col("start") + F.col("copy") * size)
    took = sum((F.greatest(F.lit(0).cast("long"), F.least(size, F.col("reached") - F.col("start") - k * F.col("source_size"))) for k in range(repeats)), F.lit(0).cast("long"))
    documents = back.select("source", "doc_id", "size", "source_size", "target", took.alias("taken"))
    return Mix(documents, taken)
