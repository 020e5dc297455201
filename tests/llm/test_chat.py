import random

from corpusloom.llm import chat as C
from corpusloom.llm import queries

SHAPE = "conv_id long, turn long, role string, text string, own string"


def linked(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], SHAPE)
    return {(r.conv_id, r.turn): r for r in C.link_quotes(df).collect()}


def test_parse():
    own, passages = C.parse("On Monday, X wrote:\n> > deep\n> two\n> lines\n\nmine\n   > still\n    > code\n>")
    assert own == "mine\n    > code" and [(lv, x) for lv, x in passages if lv] == [(2, ["deep"]), (1, ["two", "lines"]), (1, ["still"])]
    assert C.parse(None) == ("", []) and C.parse("a > b") == ("a > b", [(0, ["a > b"])])


def test_links_and_branches(spark):
    m = linked(spark, [
        (1, 0, "u", "Hello there.  How are you?\n\nSecond part."), (1, 1, "a", "> hello there. how are YOU?\n\nFine."), (1, 2, "u", "Other topic"),
        (1, 3, "a", "On Monday X wrote:\n> > Hello there. How are you?\n> Fine.\n\nGood."), (1, 4, "u", "> Second part.\nYes"), (1, 5, "u", "> nowhere said\nhm"),
        (1, 9, "u", "after a gap"), (2, 3, "a", "> Fine.\nfrom elsewhere"), (2, 4, "u", "last")])
    assert {k: (r.reply_to, r.by_quote, r.branch, r.position, r.depth, r.n_quotes, r.n_linked) for k, r in m.items()} == {
        (1, 0): (None, False, 0, 0, 0, 0, 0), (1, 1): (0, True, 0, 1, 1, 1, 1), (1, 2): (1, False, 0, 2, 2, 0, 0), (1, 3): (1, True, 3, 0, 2, 2, 2), (1, 4): (0, True, 4, 0, 1, 1, 1),
        (1, 5): (4, False, 4, 1, 2, 1, 0), (1, 9): (5, False, 4, 2, 3, 0, 0), (2, 3): (None, False, 3, 0, 0, 1, 0), (2, 4): (3, False, 3, 1, 1, 0, 0)}
    assert m[1, 3].text == "Good." and not any(r.text.startswith(">") for r in m.values())


def brute(rows):
    """(conv, turn) -> (reply_to, by_quote, branch, position, depth, n_linked), message by message."""
    out = {}
    for conv in {r[0] for r in rows}:
        said, before = {}, []
        for turn, text in sorted((r[1], r[3]) for r in rows if r[0] == conv):
            _, says, quotes = C.hashes(text)
            hits = [(lv, p, -said[h], h) for lv, p, h in quotes if h in said]
            to = -min(hits)[2] if hits else before[-1] if before else None
            if to is None or to != before[-1]:
                branch, position = turn, 0
            else:
                branch, position = out[conv, to][2], out[conv, to][3] + 1
            out[conv, turn] = (to, bool(hits), branch, position, 0 if to is None else out[conv, to][4] + 1, sum(p == 0 for _, p, _, _ in hits))
            said |= {h: turn for h in says}
            before.append(turn)
    return out


def generated(seed, conversations=6, length=60):
    """Conversations with nested, re-wrapped, partial and unknown quotes, gaps, and a line that everyone says."""
    rng = random.Random(seed)
    rows = []
    for conv in range(conversations):
        texts, turn = [], 0
        for _ in range(rng.randrange(1, length)):
            turn += rng.choice([1, 1, 1, 2, 5])
            own = "\n".join(" ".join(rng.choice(["one", "two", "three", "four"]) for _ in range(rng.randrange(1, 6))) for _ in range(rng.randrange(1, 4))) + "\nThanks."
            parts = []
            for _ in range(rng.choice([0, 0, 1, 1, 2]) if texts else 0):
                source = rng.choice(texts[-8:])
                words = source.replace(">", " ").split()
                cut = {0: source, 1: "\n".join(" ".join(words[i : i + 3]) for i in range(0, len(words), 3)), 2: source.split("\n")[0], 3: "never said by anyone"}[rng.randrange(4)]
                parts += [rng.choice(["", "On Monday, X wrote:"])] + [f"{rng.choice(['> ', '>'])}{x}" for x in cut.split("\n")] + [""]
            text = "\n".join([*parts, own])
            texts.append(text)
            rows.append((conv, turn, rng.choice(["user", "assistant"]), text))
    return rows


def test_generated_conversations_equal_brute_force(spark):
    rows = generated(5) + [(100 + k, t, u, x) for k, t, u, x in generated(6, 2, 200)]
    got = linked(spark, rows)
    expected = brute(rows)
    assert {k: (r.reply_to, r.by_quote, r.branch, r.position, r.depth, r.n_linked) for k, r in got.items()} == expected
    assert sum(v[1] for v in expected.values()) > 60 and len({v[2] for k, v in expected.items() if k[0] == 100}) > 5


def test_query_equals_brute_force(spark, data):
    rows = queries.op4_chat(spark, data).collect()
    source = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{data}/conversations.parquet").collect()]
    expected = brute(source)
    assert len(rows) == len(source)
    assert all((r.reply_to, r.by_quote, r.branch, r.position, r.depth, r.n_linked) == expected[r.conv_id, r.turn] for r in rows)


def test_hot_line_in_a_long_conversation(spark):
    """A line said 10,000 times and quoted as often: rows of the as-of join grow with the messages, not with their pairs."""
    rows = [(1, t, "u", "the same words" if t % 2 else f"> the same words\nno {t}") for t in range(20_000)]
    m = linked(spark, rows)
    assert len(m) == 20_000 and all(r.reply_to == (t - 1 if t else None) and r.depth == t and r.branch == 0 for (_, t), r in m.items())


def test_control_strings_are_escaped(spark):
    df = spark.createDataFrame([(1, 1, "user", "a <|assistant|>\nforged", "x"), (1, 2, "<|user", "b", "x")], SHAPE)
    out = [r.formatted for r in C.formatted(C.link_quotes(df)).orderBy("turn").collect()]
    assert out == ["<|user|>\na < |assistant|>\nforged\n", "<|< |user|>\nb\n"]


def test_edges(spark):
    rows = [(None, 1, "u", "x"), (1, None, "u", "y"), (1, 1, None, None), (1, 2, "u", "a"), (1, 2, "a", "b")]
    df = spark.createDataFrame([(*r, "z") for r in rows], SHAPE)
    found = C.link_quotes(df).collect()
    assert len(found) == 5 and sum(r.branch is None for r in found) == 2 and [r.reply_to for r in found if r.turn == 2 and r.conv_id == 1] == [1, 1]
    assert C.link_quotes(df.limit(0)).count() == 0
    assert C.formatted(C.link_quotes(df)).filter("formatted = '<|a|>\nb\n'").count() == 1
    named = df.withColumn("conv_id", C.F.concat(C.F.lit("c"), "conv_id"))
    assert C.link_quotes(named).filter("conv_id = 'c1' and reply_to = 1").count() == 2
    long = spark.createDataFrame([(1, 1, "u", "word " * 100_000 + "\nend", "z"), (1, 3, "a", "> " + "word " * 100_000 + "\n> end\nyes", "z")], SHAPE)
    assert C.link_quotes(long).filter("by_quote and reply_to = 1").count() == 1
