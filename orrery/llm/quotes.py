"""Chat formatting by quotation linking.

Lines that start with ``>`` are quoted, one level for each ``>``.  A maximal
run of lines of one level is a passage.  Passages, their paragraphs and their
lines are normalised (case, white space and outer punctuation don't count) and
hashed; so are the whole own text, the paragraphs and the lines of every
message.  A message replies to the nearest earlier message of its conversation
whose text it quotes at the outermost level; where there is none there, to the
least (conv_id, turn) of other conversations that holds the passage; and where
no message holds it at that level, likewise by the next deeper one.

Replies order a conversation: a message that quotes an earlier one opens a
branch under it, one without a quotation continues its predecessor's branch.
``reply_key`` sorts a conversation depth first: the branch's place in that
order, then the turn, so a key is two numbers however deep the replies go.
Sorting by it and the conversation is a range partitioning, whatever the size
of a conversation.  Texts are told apart by the 128 bits of their MD5.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orrery.llm.shared import forget, settled

_MARK = r"^(?:[ \t]*>)+"
#: Turns of a conversation that one window task handles.
RANGE = 4096
#: Stands for the branch that a conversation begins with; no other branch can start there, as each hangs at an earlier turn.
_TRUNK = -(2**63)


def normalised(text: Column) -> Column:
    """Lower case, single spaces, no punctuation at either end; null if nothing is left."""
    plain = F.regexp_replace(F.lower(text), r"\s+", " ")
    plain = F.regexp_replace(plain, r"^[\s\p{Punct}]+|[\s\p{Punct}]+$", "")
    return F.when(plain != "", plain)


def parse_quotes(messages: DataFrame, text: str) -> DataFrame:
    """Adds ``own`` (the text without quoted lines) and ``passages`` (array of level, text) to the messages."""
    lines = F.transform(F.split(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), "\n"), lambda s: F.struct(
        F.length(F.regexp_replace(F.regexp_extract(s, _MARK, 0), "[^>]", "")).alias("level"), F.regexp_replace(s, _MARK + " ?", "").alias("text")))
    out = messages.withColumn("lines", lines)
    own = F.regexp_replace(F.array_join(F.transform(F.filter("lines", lambda s: s["level"] == 0), lambda s: s["text"]), "\n"), r"^\n+|\s+$", "")
    none = F.array().cast("array<struct<level:int,text:string>>")
    # Runs of one level, by the lines where the level changes; each line is copied once.
    level = lambda i: F.get(F.col("lines"), i)["level"]
    starts = F.filter(F.sequence(F.lit(0), F.size("lines") - 1), lambda i: (i == 0) | (level(i) != F.coalesce(level(i - 1), F.lit(-1))))
    out = out.withColumn("own", own).withColumn("starts", F.when(F.exists("lines", lambda s: s["level"] > 0), starts).otherwise(F.array().cast("array<int>")))

    def passage(at: Column, k: Column) -> Column:
        end = F.coalesce(F.get(F.col("starts"), k + 1), F.size("lines"))
        return F.struct(level(at).alias("level"), F.array_join(F.transform(F.slice("lines", at + 1, end - at), lambda s: s["text"]), "\n").alias("text"))

    passages = F.when(F.size("starts") > 0, F.filter(F.transform("starts", passage), lambda p: p["level"] > 0)).otherwise(none)
    return out.withColumn("passages", passages).drop("lines", "starts")


def running_max(rows: DataFrame, keys: list[str], at: str, value: Column, upto: int) -> DataFrame:
    """Adds ``reached``: the largest value of the rows of the same keys at or before ``at + upto``; ``upto`` is 0 or -1.

    Windows are cut into ranges of RANGE turns that take over the maximum of the ranges before, so a conversation of any length is many tasks.
    """
    rows = rows.withColumns({"value": value, "range": F.floor(F.col(at) / RANGE)})
    heads = rows.groupBy(*keys, "range").agg(F.max("value").alias("top"))
    past = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    heads = heads.select(*[F.col(k).alias(f"h_{k}") for k in [*keys, "range"]], F.max("top").over(past).alias("taken_over"))
    here = Window.partitionBy(*keys, "range").orderBy(at).rangeBetween(Window.unboundedPreceding, upto)
    same = [F.col(k) == F.col(f"h_{k}") for k in [*keys, "range"]]
    both = rows.withColumn("here", F.max("value").over(here)).join(heads, same)
    return both.withColumn("reached", F.greatest("taken_over", "here")).drop("value", "range", "here", "taken_over", *[f"h_{k}" for k in [*keys, "range"]])


def _pieces(text: Column) -> Column:
    """A text, its paragraphs and its lines, normalised and distinct."""
    parts = F.concat(F.array(text), F.split(text, r"\n\s*\n"), F.split(text, "\n"))
    return F.array_compact(F.array_distinct(F.transform(parts, normalised)))


def _identity(column: str) -> Column:
    return F.unhex(F.md5(column))


def link_quotations(messages: DataFrame, *, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per message: conv_id, turn, role, text (without quotes), n_quotes, levels, reply_conv, reply_turn, reply_key.

    A null text is empty.  Quotes without an original are removed all the same
    and leave the message in its predecessor's branch.  Rows with equal
    conversation and turn each get a row; they are quoted as one message.  Rows
    without conversation or turn are parsed, but neither link nor are linked,
    and have no reply_key.  An empty table gives no rows.
    """
    rows = messages.select(F.col(f"`{conv}`").alias("conv_id"), F.col(f"`{turn}`").cast("long").alias("turn"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").cast("string").alias("body"))
    rows = settled(parse_quotes(rows, "body").drop("body"))
    placed = rows.where("conv_id is not null and turn is not null")
    pieces = placed.where(F.size("passages") > 0).select("conv_id", "turn", F.explode("passages").alias("passage"))
    pieces = pieces.select("conv_id", "turn", "passage.level", F.explode(_pieces(F.col("passage.text"))).alias("piece"))
    asked = settled(pieces.groupBy("conv_id", "turn", _identity("piece").alias("hash"), F.length("piece").alias("size")).agg(F.min("level").alias("level")))
    # Only pieces that somebody quotes are of interest; each is one row a message.
    held = placed.select("conv_id", "turn", F.explode(_pieces(F.col("own"))).alias("piece")).select("conv_id", "turn", _identity("piece").alias("hash"))
    held = settled(held.join(settled(asked.select("hash").distinct()), "hash", "left_semi").distinct())
    # The nearest earlier holder in the conversation: one running maximum over holders and askers together.
    marks = held.select("conv_id", "hash", "turn", F.col("turn").alias("holder"), F.lit(None).cast("int").alias("size"), F.lit(None).cast("int").alias("level")).union(asked.select("conv_id", "hash", "turn", F.lit(None).cast("long"), "size", "level"))
    found = settled(running_max(marks, ["conv_id", "hash"], "turn", F.col("holder"), -1).withColumnRenamed("reached", "from").where("size is not null").drop("holder"))
    near = found.where("from is not null").select("conv_id", "turn", "level", F.lit(0).alias("far"), (-F.col("size")).alias("size"), (-F.col("from")).alias("order"), F.col("conv_id").alias("reply_conv"), F.col("from").alias("reply_turn"))
    # Elsewhere: the least holder of another conversation, which is among the first of the two least conversations.
    first = held.groupBy("hash", "conv_id").agg(F.min("turn").alias("turn"))
    two = first.withColumn("k", F.row_number().over(Window.partitionBy("hash").orderBy("conv_id"))).where("k <= 2")
    two = two.select("hash", F.col("conv_id").alias("reply_conv"), F.col("turn").alias("reply_turn"))
    far = found.where("from is null").join(two, "hash").where("reply_conv <> conv_id")
    far = far.select("conv_id", "turn", "level", F.lit(1).alias("far"), (-F.col("size")).alias("size"), F.lit(0).cast("long").alias("order"), "reply_conv", "reply_turn")
    best = near.union(far).groupBy("conv_id", "turn").agg(F.min(F.struct("level", "far", "size", "order", "reply_conv", "reply_turn")).alias("best"))
    links = settled(best.select("conv_id", "turn", "best.reply_conv", "best.reply_turn"))
    out = rows.join(links, ["conv_id", "turn"], "left")
    places = branch_places(links)
    # A message belongs to the last branch of its conversation that started at or before it.
    if places.isEmpty():
        keyed = out.withColumn("place", F.lit(0).cast("long"))
    else:
        asked = placed.select("conv_id", "turn").distinct().join(places.select("conv_id").distinct(), "conv_id", "left_semi")
        marks = places.select("conv_id", F.col("start").alias("turn"), F.struct("start", "place").alias("branch"), F.lit(True).alias("mark"))
        marks = marks.unionByName(asked.select("*", F.lit(None).cast(marks.schema["branch"].dataType).alias("branch"), F.lit(False).alias("mark")))
        within = running_max(marks, ["conv_id"], "turn", F.col("branch"), 0).where("not mark").select("conv_id", "turn", F.col("reached.place").alias("place"))
        keyed = out.join(within, ["conv_id", "turn"], "left").withColumn("place", F.coalesce("place", F.lit(0).cast("long")))
    key = F.array("place", "turn")
    return keyed.select(
        "conv_id", "turn", "role", F.col("own").alias("text"), F.size("passages").cast("long").alias("n_quotes"), F.coalesce(F.array_max(F.transform("passages", lambda p: p["level"])), F.lit(0)).cast("long").alias("levels"),
        "reply_conv", "reply_turn", F.when(F.col("conv_id").isNotNull() & F.col("turn").isNotNull(), key).alias("reply_key"),
    )


def branch_places(links: DataFrame) -> DataFrame:
    """(conv_id, start, place): for each branch its place, from 1, in the depth-first order of its conversation.

    A branch starts at a message that quotes one of its conversation, and hangs
    at that one.  Siblings come after all messages of the branch they hang in,
    the nearest message's first, and by their starts at one message.  The order
    is an Euler tour, a way down and a way up for each branch, each knowing its
    successor; how many ways down are left is summed by pointer jumping.  So
    rounds grow with the logarithm of the branches and a round has two rows a
    branch, whatever the nesting; no step gathers siblings or a conversation.
    """
    own = links.where("reply_conv = conv_id")
    branch = own.select("conv_id", F.col("turn").alias("start"), F.col("reply_turn").alias("at"))
    none = F.lit(None).cast("long")
    # The branch that holds the message it hangs at: the last one that started at or before it.
    marks = branch.select("conv_id", F.col("at").alias("t"), "start", "at", none.alias("opened")).union(branch.select("conv_id", F.col("start").alias("t"), none, none, F.col("start")))
    held = running_max(marks, ["conv_id"], "t", F.col("opened"), 0).where("start is not null")
    held = settled(held.select("conv_id", "start", "at", F.coalesce("reached", F.lit(_TRUNK)).alias("parent")))
    if held.isEmpty():
        return held.select("conv_id", "start", none.alias("place"))
    # The next sibling is the next one at the same message, else the first at the nearest message before.
    beside = running_max(held.withColumn("back", -F.col("start")), ["conv_id", "parent", "at"], "back", F.col("back"), -1).select("conv_id", "start", "at", "parent", (-F.col("reached")).alias("beside"))
    groups = held.groupBy("conv_id", "parent", "at").agg(F.min("start").alias("first"))
    before = running_max(groups, ["conv_id", "parent"], "at", F.struct("at", "first"), -1).select("conv_id", "parent", "at", F.col("reached.first").alias("before"))
    first = groups.groupBy("conv_id", F.col("parent").alias("start")).agg(F.max_by("first", "at").alias("child"))
    known = beside.join(before, ["conv_id", "parent", "at"]).join(first, ["conv_id", "start"], "left")
    known = settled(known.select("conv_id", "start", "parent", "child", F.coalesce("beside", "before").alias("sibling")))
    above = F.when(F.col("parent") != _TRUNK, F.col("parent"))
    down = known.select("conv_id", "start", F.lit(False).alias("up"), F.coalesce("child", "start").alias("next"), F.col("child").isNull().alias("next_up"), F.lit(1).cast("long").alias("left"))
    ways = settled(down.union(known.select("conv_id", "start", F.lit(True), F.coalesce("sibling", above), F.col("sibling").isNull(), F.lit(0).cast("long"))))
    forget(known)
    while not ways.where("next is not null").isEmpty():
        ahead = ways.select("conv_id", F.col("start").alias("next"), F.col("up").alias("next_up"), F.col("next").alias("then"), F.col("next_up").alias("then_up"), F.col("left").alias("more"))
        jumped = ways.join(ahead, ["conv_id", "next", "next_up"], "left")  # a way has one way before it, so no key is hot
        jumped = settled(jumped.select("conv_id", "start", "up", F.col("then").alias("next"), F.col("then_up").alias("next_up"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")))
        forget(ways)
        ways = jumped
    counts = held.groupBy("conv_id").agg(F.count(F.lit(1)).alias("branches"))
    return ways.where("not up").join(counts, "conv_id").select("conv_id", "start", (F.col("branches") - F.col("left") + 1).alias("place"))


def conversations(linked: DataFrame) -> DataFrame:
    """The messages in reply order: sorted by conversation and reply_key over range partitions."""
    return linked.orderBy("conv_id", "reply_key")
