from orrery.llm.queries import QUERIES
from orrery.llm.quotes import conversations, link_quotations

ROWS = [
    (1, 0, "user", "Hello there.\n\nHow do I sort a list?"),
    (1, 1, "assistant", "> how do I sort  a list\nUse sorted()."),
    (1, 2, "user", "Thanks!"),
    (1, 3, "user", "> > how do I sort a list?\n> Use sorted().\nBut stable?"),
    (1, 4, "assistant", "Yes."),
    (1, 5, "user", "> Thanks!\nYou are welcome.\n> unknown words"),
    (1, 6, "user", ">>> deep\n>> mid\nown"),
    (2, 0, "user", "> Use sorted().\nCross."),
    (2, 1, "user", None),
    (3, 0, "user", "> Nothing known"),
    (3, 0, "user", "y"),
    (None, 4, "user", "> Thanks!\nlost"),
    (5, None, "user", "x"),
]


def test_links_and_order(spark):
    got = {(r["conv_id"], r["turn"], r["text"]): r for r in link_quotations(spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")).collect()}
    assert len(got) == len(ROWS)
    reply = {(k[0], k[1]): (r["reply_conv"], r["reply_turn"]) for k, r in got.items() if r["reply_turn"] is not None}
    assert reply == {(1, 1): (1, 0), (1, 3): (1, 1), (1, 5): (1, 2), (2, 0): (1, 1)}
    assert got[1, 3, "But stable?"]["n_quotes"] == 2 and got[1, 3, "But stable?"]["levels"] == 2
    assert got[1, 5, "You are welcome."]["n_quotes"] == 2 and got[1, 6, "own"]["levels"] == 3
    assert got[2, 1, ""]["n_quotes"] == 0 and got[3, 0, ""]["reply_key"] is not None and got[None, 4, "lost"]["reply_key"] is None
    order = [r["turn"] for r in conversations(link_quotations(spark.createDataFrame(ROWS[:7], "conv_id long, turn long, role string, text string"))).collect()]
    assert order == [0, 1, 2, 5, 6, 3, 4]


def depth_first(n, parent):
    """Turns in depth-first order, later siblings after a message's successor."""
    out = []

    def visit(i):
        out.append(i)
        for c in sorted(c for c in range(n) if parent[c] == i):
            visit(c)

    visit(0)
    return out


def test_reply_order_against_recursion(spark):
    import random

    rng = random.Random(4)
    rows, want = [], {}
    for conv in range(8):
        n = rng.randrange(1, 25)
        parent = [None] + [i - 1 if rng.random() < 0.5 else rng.randrange(i) for i in range(1, n)]
        rows += [(conv, i, "user", (f"> text {conv} {parent[i]} end\n" if i and parent[i] != i - 1 else "") + f"text {conv} {i} end") for i in range(n)]
        want[conv] = depth_first(n, parent)
    got = {}
    for r in conversations(link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect():
        got.setdefault(r["conv_id"], []).append(r["turn"])
    assert got == want


def test_query_and_empty(spark):
    d = "/root/testdata/sf0.001"
    assert QUERIES["op2_quotation_linking"](spark, d).count() == spark.read.parquet(f"{d}/conversations.parquet").count()
    assert link_quotations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_deeper_levels_and_several_holders(spark):
    rows = [
        (4, 0, "user", "The exact text of an earlier message"),
        (4, 1, "assistant", "Short"),
        (4, 2, "user", "> Bob wrote:\n>> the exact text of an earlier message\nFine."),
        (4, 3, "user", "> edited away\n>> short\n>>> the exact text of an earlier message\nFine too."),
        (4, 4, "user", ">> the exact text of an earlier message\n> short\nOuter first."),
        (9, 0, "user", "x"),
        (9, 1, "user", "copied original"),
        (7, 3, "user", "copied original"),
        (7, 1, "user", "copied original"),
        (8, 0, "user", "> copied original\nWho?"),
        (6, 0, "user", "> copied original\nAnd before its own."),
        (6, 1, "user", "copied original"),
        (3, 0, "user", "> copied original\nOnly later here."),
        (3, 1, "user", "copied original"),
    ]
    got = link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).where("reply_turn is not null")
    reply = {(r["conv_id"], r["turn"]): (r["reply_conv"], r["reply_turn"]) for r in got.collect()}
    assert reply == {(4, 2): (4, 0), (4, 3): (4, 1), (4, 4): (4, 1), (8, 0): (3, 1), (6, 0): (3, 1), (3, 0): (6, 1)}


def test_long_messages_and_conversations(spark):
    """A message of 60,000 quoted lines, and a conversation over several ranges of turns, against a plain search."""
    from orrery.llm.quotes import RANGE

    rows = [("big", 0, "user", "\n".join(f"line {i}" for i in range(60000))), ("big", 1, "user", "\n".join(("> " if i // 7 % 2 else ">> ") + f"line {i}" for i in range(60000)))]
    turns = 3 * RANGE
    rows += [("long", t, "user", f"text number {t}" if t % 1000 else f"> text number {max(t - 5001, 1)}\nanswer {t}") for t in range(1, turns)]
    got = {(r["conv_id"], r["turn"]): r for r in link_quotations(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).collect()}
    assert got["big", 1]["n_quotes"] == -(-60000 // 7) and got["big", 1]["levels"] == 2 and got["big", 1]["text"] == ""
    for t in range(1000, turns, 1000):
        assert (got["long", t]["reply_conv"], got["long", t]["reply_turn"]) == ("long", max(t - 5001, 1)), t
    opened = {t: max(t - 5001, 1) for t in range(1000, turns, 1000)}

    def path(t):
        start = max((s for s in opened if s <= t), default=None)
        return [] if start is None else [*path_of(start)]

    def path_of(start):
        above = max((s for s in opened if s <= opened[start]), default=None)
        return [*(path_of(above) if above else []), [1, -opened[start], start]]

    want = sorted(range(1, turns), key=lambda t: [*path(t), [0, t, 0]])
    assert sorted(range(1, turns), key=lambda t: got["long", t]["reply_key"]) == want


def test_keys_stay_two_numbers_in_deep_and_wide_threads(spark):
    """Chains of 100,000 and 3,000 turns and a message that 3,000 others quote: the order of a recursion, keys of one size."""
    from pyspark.sql import functions as F

    from orrery.llm.quotes import branch_places

    n = 100_000
    chain = spark.range(1, n).select(F.lit("chain").alias("conv_id"), F.col("id").alias("turn"), F.lit("chain").alias("reply_conv"), (F.col("id") - 1).alias("reply_turn"))
    got = branch_places(chain)
    assert got.where("place = start").count() == n - 1 == got.count()
    rows = [("star", t, "star", 0) for t in range(1, 3001)] + [("comb", t, "comb", t - 2) for t in range(2, 3001)] + [("far", 1, "star", 0)]
    places = {(r[0], r[1]): r[2] for r in branch_places(spark.createDataFrame(rows, "conv_id string, turn long, reply_conv string, reply_turn long")).collect()}
    assert [places["star", t] for t in range(1, 3001)] == list(range(1, 3001))
    # Turn t hangs at t - 2, which the branch before the last one holds: t under t - 2, those of even turns first under turn 0.
    parent = {t: t - 2 for t in range(2, 3001)}
    key = {}
    for t in range(2, 3001):
        key[t] = [*key.get(parent[t], []), [1, -parent[t], t]]
    assert sorted(key, key=key.get) == sorted(key, key=lambda t: places["comb", t]) and len(places) == 3000 + 2999


def test_repeated_and_clashing_columns(spark):
    """Equal rows each get a row, and columns that the operator uses itself do no harm."""
    rows = [(1, 0, "user", "first words here", 5, "x"), (1, 1, "user", "> first words here\nyes", 6, "y"), (1, 1, "user", "> first words here\nyes", 6, "y"), (1, 2, "user", "> first words here\nno", 7, "z")]
    got = link_quotations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place long, path string")).collect()
    assert sorted((r["turn"], r["reply_turn"] if r["reply_turn"] is not None else -1, *r["reply_key"]) for r in got) == [(0, -1, 0, 0), (1, 0, 1, 1), (1, 0, 1, 1), (2, 0, 2, 2)]
