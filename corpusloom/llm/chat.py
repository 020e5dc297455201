"""Operator 4: chat formatting by linking quotations to the messages that they quote.

Lines that begin with ``>`` marks are quotes, as deep as they have marks; a line that announces a quote goes with it. Passages
(lines of one depth without an empty line between) are normalised and hashed, on both sides: quoted passages and their lines,
and what messages say themselves, as a whole, by passage and by line. Both sides are joined inside a conversation as an as-of
join: all hashes are sorted by (conversation, hash, turn) in ranges, and the last turn that said a hash is carried along, so a
line that is said and quoted many times makes no pairs, and a hot conversation or line is spread over ranges. A message replies
to the latest earlier message that its outermost quotes are taken from, whole passages before single lines; without a found
quote it replies to the message before it, whatever turns are missing between.

A branch is a run of messages of which each replies to the one before it: a message begins one where it is the first of its
conversation or quotes another message than the one before. Sorted by (conv_id, branch, position), a message comes after what
it replies to, and only branch starts take part in the pointer doubling that gives depths, in the logarithm of the number of
nested branches in rounds.

Defined results: null text counts as empty; rows with null conv_id or turn get no links (branch, position, depth and reply_to
are null); of repeated (conv_id, turn) rows each is returned, and the pair is one message for links; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import partial, reduce

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

_QUOTE = re.compile(r"^ {0,3}((?:> ?)+)(.*)$")
_ANNOUNCE = re.compile(r"^\s*(?:On .{1,200} wrote|Am .{1,200} schrieb.{0,100}|Le .{1,200} a écrit|El .{1,200} escribió)\s*:\s*$")
SHAPE = "conv_id {0}, turn {1}, role string, text string, own array<string>, quoted array<struct<level: int, part: int, hash: string>>"


def normalised(passage: str) -> str:
    return " ".join(passage.lower().split())


def _hash(passage: str) -> str:
    return xxhash.xxh3_128_hexdigest(passage.encode("utf-8", "surrogatepass"))


def parse(text: str | None) -> tuple[str, list[tuple[int, list[str]]]]:
    """What the message says itself, and its passages as (quote level, lines); level 0 is its own."""
    lines = []
    for line in (text or "").split("\n"):
        m = _QUOTE.match(line)
        lines.append((m[1].count(">"), m[2]) if m else (0, line))
    after = 0  # the level of the next line that is not empty; an announcement is of the quote that follows
    for i in range(len(lines) - 1, -1, -1):
        level, line = lines[i]
        if level == 0 and after and _ANNOUNCE.match(line):
            lines[i] = (-1, line)
        elif level or line.strip():
            after = level
    own = "\n".join(x for level, x in lines if level == 0)
    passages: list[tuple[int, list[str]]] = []
    last = None
    for level, line in lines:
        if level < 0 or not line.strip():
            last = None
            continue
        if level != last:
            passages.append((level, []))
        passages[-1][1].append(line)
        last = level
    return re.sub(r"\n{3,}", "\n\n", own).strip("\n"), passages


def hashes(text: str | None) -> tuple[str, list[str], list[tuple[int, int, str]]]:
    """(own text, hashes of what it says, (level, 0 for a passage or 1 for a line, hash) of what it quotes)."""
    own, passages = parse(text)
    says = {normalised(own)} | {normalised(x) for level, ls in passages if level == 0 for x in ["\n".join(ls), *ls]}
    quotes = {(level, part, normalised(x)) for level, ls in passages if level > 0 for part, x in [(0, "\n".join(ls)), *((1, x) for x in ls)]}
    return own, sorted(_hash(x) for x in says if x), sorted((lv, p, _hash(x)) for lv, p, x in quotes if x)


def _parsed(batches):
    kind = pa.list_(pa.struct([("level", pa.int32()), ("part", pa.int32()), ("hash", pa.string())]))
    for batch in batches:
        own, says, quotes = zip(*(hashes(t.as_py()) for t in batch.column(3))) if batch.num_rows else ([], [], [])
        quotes = [[{"level": lv, "part": p, "hash": h} for lv, p, h in q] for q in quotes]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(own, pa.string()), pa.array(says, pa.list_(pa.string())), pa.array(quotes, kind)], names=["conv_id", "turn", "role", "text", "own", "quoted"])


_CARRIED = ["part", "edge", "head", "conv_id", "hash", "turn", "rank", "passages", "last", "value", "seen"]


def _carry(batches, kind: pa.DataType):
    """Rows sorted by (conv_id, hash, turn): those that ask (rank is not null), with the last turn before them that says the
    hash, its value and how many did. ``head`` marks rows of the partition's first key, which may go on from the partition
    before; rows of ``edge`` 1 and 2 are a partition's first key, and its last one as it stands at the end."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    types = [pa.int32(), pa.int32(), pa.bool_(), kind, pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types)], names=_CARRIED)

    first = now = last = held = None
    seen = 0
    for batch in batches:
        rows = []
        for conv, hash_, turn, says, value, rank, passages in zip(*(c.to_pylist() for c in batch.columns)):
            if (conv, hash_) != now:
                now, last, held, seen = (conv, hash_), None, None, 0
                first = first or now
            if rank is not None:
                rows.append((part, 0, now == first, conv, hash_, turn, rank, passages, last, held, seen))
            if says:
                last, held, seen = turn, value, seen + 1
        yield batch_of(rows)
    if now:
        yield batch_of([(part, 1, True, *first, None, None, None, None, None, None), (part, 2, now == first, *now, None, None, None, last, held, seen)])


def last_before(rows: DataFrame) -> DataFrame:
    """As-of join over rows (conv_id, hash, turn, says, value, rank, passages), one of each (conv_id, hash, turn).

    Returns (conv_id, hash, turn, rank, passages, last, value, seen) of the rows with a rank: last is the latest earlier turn of
    the key whose row says it, value that row's value, and seen the number of such rows. Sorted ranges carry these along; what
    goes on from range to range is settled from two rows of each range, of which there are as many as shuffle partitions.
    """
    spark, keys = rows.sparkSession, ["conv_id", "hash", "turn"]
    from pyspark.sql.pandas.types import to_arrow_type

    kind = rows.schema["conv_id"].dataType
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(*keys, "says", "value", "rank", "passages").repartitionByRange(parts, *keys).sortWithinPartitions(*keys)
    shape = f"part int, edge int, head boolean, conv_id {kind.simpleString()}, hash string, turn long, rank long, passages long, last long, value long, seen long"
    found = written(dealt.mapInArrow(partial(_carry, kind=to_arrow_type(kind)), shape), "carried")
    carried, fixes, first = None, [], None
    for r in found.filter("edge > 0").orderBy("part", "edge").collect():  # two rows of each range
        key = (r.conv_id, r.hash)
        if r.edge == 1:
            first = carried if carried and carried[0] == key else None
            if first:
                fixes.append((r.part, *first[1:]))
        else:
            carried = (key, r.last, r.value, r.seen)
            if r.head and first:
                carried = (key, *((r.last, r.value) if r.last is not None else first[1:3]), r.seen + first[3])
    more = F.broadcast(spark.createDataFrame(fixes, "of int, more_last long, more_value long, more_seen long"))
    both = found.filter("edge = 0").join(more, (F.col("part") == F.col("of")) & F.col("head"), "left")
    value = F.when(F.col("last").isNull(), F.col("more_value")).otherwise(F.col("value")).alias("value")
    return both.select(*keys, "rank", "passages", F.coalesce("last", "more_last").alias("last"), value, (F.col("seen") + F.coalesce("more_seen", F.lit(0))).alias("seen"))


def _none(kind: str = "long"):
    return F.lit(None).cast(kind)


def _links(sound: DataFrame) -> DataFrame:
    """(conv_id, turn, position in the conversation, reply_to, by_quote, n_linked) of every message."""
    says = sound.select("conv_id", "turn", F.explode("own").alias("hash")).select("conv_id", "hash", "turn", F.lit(True).alias("says"), _none().alias("rank"), F.lit(0).cast("long").alias("passages"))
    q = sound.select("conv_id", "turn", F.explode("quoted").alias("q")).select("conv_id", "turn", "q.level", "q.part", "q.hash").distinct()
    asks = q.select("conv_id", "hash", "turn", F.lit(False), (2 * F.col("level") + F.col("part")).cast("long"), F.when(F.col("part") == 0, 1).otherwise(0).cast("long"))
    messages = sound.select("conv_id", F.lit(""), "turn", F.lit(True), F.lit(-1).cast("long"), F.lit(0).cast("long"))  # the message before is an as-of join too
    rows = says.union(asks).union(messages).groupBy("conv_id", "hash", "turn").agg(F.max("says").alias("says"), F.min("rank").alias("rank"), F.sum("passages").alias("passages"))
    found = last_before(rows.withColumn("value", _none()))
    turns = found.filter("rank = -1").select("conv_id", "turn", F.col("last").alias("previous"), F.col("seen").alias("at"))
    hits = found.filter("rank >= 0 and last is not null")
    best = hits.groupBy("conv_id", "turn").agg(F.min("rank").alias("rank"), F.sum("passages").alias("n_linked"))
    latest = hits.join(best, ["conv_id", "turn", "rank"]).groupBy("conv_id", "turn", "n_linked").agg(F.max("last").alias("quoted"))
    return turns.join(latest, ["conv_id", "turn"], "left").select("conv_id", "turn", "at", "previous", F.coalesce("quoted", "previous").alias("reply_to"), F.col("quoted").isNotNull().alias("by_quote"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"))


def _depths(placed: DataFrame) -> DataFrame:
    """(conv_id, branch, base): the depth of each branch's first message, by pointer doubling over branch starts."""
    starts = placed.filter("turn = branch").select("conv_id", F.col("turn").alias("branch"), "reply_to")
    over = placed.select("conv_id", F.col("turn").alias("reply_to"), F.col("branch").alias("above"), (F.col("position") + 1).alias("base"))
    now = written(starts.join(over, ["conv_id", "reply_to"], "left").select("conv_id", "branch", "above", F.coalesce("base", F.lit(0)).cast("long").alias("base")), "starts")
    arrived, open_ = [now.filter("above is null")], now.filter("above is not null")
    while not open_.isEmpty():
        known = reduce(DataFrame.union, arrived).union(open_).select("conv_id", F.col("branch").alias("above"), F.col("above").alias("higher"), F.col("base").alias("more"))
        both = written(open_.join(known, ["conv_id", "above"]).select("conv_id", "branch", F.col("higher").alias("above"), (F.col("base") + F.col("more")).alias("base")), "starts")
        arrived.append(both.filter("above is null"))
        open_ = both.filter("above is not null")
    return reduce(DataFrame.union, arrived).select("conv_id", "branch", "base")


def link_quotes(messages: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, branch, position, depth, reply_to, by_quote, n_quotes, n_linked) of every message, without its quotes.

    branch is the turn that the message's branch began with, position its place there from 0, depth the number of replies from
    the conversation's first message, and n_linked how many of the n_quotes quoted passages were found in earlier messages.
    """
    rows = messages.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"), F.col(f"`{role_col}`").cast("string").alias("role"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    parsed = written(rows.mapInArrow(_parsed, SHAPE.format(rows.schema["conv_id"].dataType.simpleString(), "bigint")), "messages")
    links = written(_links(parsed.filter("conv_id is not null and turn is not null")).withColumn("starts", F.col("previous").isNull() | F.col("by_quote") & (F.col("reply_to") != F.col("previous"))), "links")
    # the branch of a message is the last one that began at or before it
    began = last_before(links.select("conv_id", F.lit("").alias("hash"), "turn", F.col("starts").alias("says"), F.col("at").alias("value"), F.lit(0).cast("long").alias("rank"), F.lit(0).cast("long").alias("passages")))
    own = links.join(began.select("conv_id", "turn", "last", "value"), ["conv_id", "turn"])
    branch, position = F.when(F.col("starts"), F.col("turn")).otherwise(F.col("last")), F.when(F.col("starts"), 0).otherwise(F.col("at") - F.col("value"))
    placed = written(own.select("conv_id", "turn", branch.alias("branch"), position.cast("long").alias("position"), "reply_to", "by_quote", "n_linked"), "placed")
    depths = placed.join(_depths(placed), ["conv_id", "branch"]).withColumn("depth", F.col("base") + F.col("position")).drop("base")
    quoted = F.size(F.filter("quoted", lambda q: q["part"] == 0)).alias("n_quotes")
    return parsed.select("conv_id", "turn", "role", "text", quoted).join(depths, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "text", "branch", "position", "depth", "reply_to", F.coalesce("by_quote", F.lit(False)).alias("by_quote"), "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"))


def formatted(linked: DataFrame, template: str = "<|{role}|>\n{text}\n", control: str = r"<\|") -> DataFrame:
    """Messages as text of a chat template (column ``formatted``), to be read in the order of (conv_id, branch, position).

    What a role or a text has that ``control`` matches gets a space after its first character, so no message can forge a mark of the template.
    """
    head, _, rest = template.partition("{role}")
    middle, _, tail = rest.partition("{text}")
    safe = lambda column: F.regexp_replace(column, f"(?={control})(.)", "$1 ")
    return linked.withColumn("formatted", F.concat(F.lit(head), safe(F.coalesce("role", F.lit("user"))), F.lit(middle), safe(F.col("text")), F.lit(tail)))
