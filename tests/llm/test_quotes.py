"""Quoted passages, their originals and reply order."""

import random

from tidemark.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string"


def linked(spark, rows):
    return quotes.in_reply_order(quotes.link_quotes(spark.createDataFrame(rows, SCHEMA))).collect()


def test_parse_levels_and_own_text():
    own, depth, passages, said = quotes.parse("Hi.\nBob wrote:\n> one\n> two\n>> deep  Thing\nmy answer\n\nmore")
    assert own == "Hi.\nmy answer\n\nmore" and depth == 2
    assert passages == [(1, quotes.digest("one two")), (2, quotes.digest("deep thing"))]
    assert quotes.digest("more") in said and quotes.digest("hi. my answer") in said
    assert quotes.parse(None) == ("", 0, [], []) and quotes.parse(">>>\n> ")[1:3] == (3, [])
    assert quotes.parse("> > a")[1] == 2


def test_links_and_reply_order(spark):
    rows = [(1, 0, "a", "First point.\nSecond point."), (1, 1, "b", "Other topic."), (1, 2, "a", "> other  TOPIC.\nyes"), (1, 3, "b", "> Second point.\nno"), (1, 4, "a", "> no\n>> Second point.\nwhy"), (1, 5, "b", "> never said\nx"), (2, 0, "a", "> Second point.\nelsewhere"), (1, 6, "a", None)]
    got = {(r.conv_id, r.turn): r for r in linked(spark, rows)}
    assert {k[1]: (r.parent_turn, r.thread_turn, r.n_linked) for k, r in got.items() if k[0] == 1} == {0: (None, 0, 0), 1: (None, 1, 0), 2: (1, 1, 1), 3: (0, 0, 1), 4: (3, 0, 2), 5: (None, 5, 0), 6: (None, 6, 0)}
    assert got[2, 0].parent_turn is None and got[1, 3].own_text == "no"
    assert [r.turn for r in linked(spark, rows) if r.conv_id == 1] == [0, 3, 4, 1, 2, 5, 6]


def test_long_chains_repeats_nulls_and_clashing_columns(spark):
    rows = [(1, 0, "a", "start")] + [(1, i, "a", f"> {'start' if i == 1 else f'm{i - 1}'}\nm{i}") for i in range(1, 40)]
    assert {r.thread_turn for r in linked(spark, rows)} == {0}
    rows = [(1, 0, "a", "start"), (1, 1, "a", "> start\nx"), (1, 1, "a", "> start\nx"), (None, 1, "a", "> start"), (1, None, "a", "> start"), (1, 0, "b", "start")]
    got = linked(spark, rows)
    assert len(got) == 6 and sum(r.parent_turn == 0 for r in got) == 2
    d = spark.createDataFrame([(1, 0, "a", "t", 9)], SCHEMA + ", parent_turn int")
    assert quotes.link_quotes(d).first().parent_turn is None
    assert not linked(spark, [])


def test_trimmed_quotes_are_linked(spark):
    first = "a\nb\nc\n\nOne here. Two\nhere! Three here.\n\nlast one"
    asked = ["> a\n> b\nx", "> a\n> b\n> c\n>\n> last one\nx", "> Two here!\nx", "> c\n> [...]\n> last one\nx", "> One here.\n> Two here! Three\n> here.\nx", ">> b\n>> c\nx", "> a\n> q\nx", "> d\n> a\n> b\nx"]
    rows = [(1, 1, "a", first)] + [(1, 10 + i, "b", t) for i, t in enumerate(asked)]
    # a later message, and one that says less, are no originals; nor is another conversation
    rows += [(1, 0, "a", "b"), (1, 90, "a", first), (2, 0, "a", first), (3, 5, "b", "> a\n> b\nx"), (3, 6, "a", first)]
    got = {(r.conv_id, r.turn): (r.parent_turn, r.thread_turn, r.n_linked) for r in linked(spark, rows)}
    assert [got[1, 10 + i] for i in range(6)] == [(1, 1, 1)] * 6
    assert got[1, 16] == (None, 16, 0) and got[1, 17] == (1, 1, 1) and got[3, 5] == (None, 5, 0)


def test_passages_from_several_messages_and_the_most_of_one(spark):
    rows = [(1, 0, "a", "a"), (1, 1, "b", "b"), (1, 2, "a", "c"), (1, 3, "b", "> a\n> b\n> c\nx"), (1, 4, "a", "b\nz\nc"), (1, 5, "a", "b\nz\nc"), (1, 6, "b", "> a\n> b\n> c\nx"), (1, 7, "a", "Hm. b\n\na c")]
    got = {r.turn: r.parent_turn for r in linked(spark, rows)}
    assert (got[3], got[6]) == (0, 4)
    d = [(1, 0, "a", "yes. no."), (1, 1, "a", "yes."), (1, 2, "b", "> yes.\nx"), (1, 3, "b", "> no.\nx")]
    assert {r.turn: r.parent_turn for r in linked(spark, d)} == {0: None, 1: None, 2: 1, 3: 0}


def plain(rows):
    """{(conv, turn): (n_linked, parent, thread, place)} by loops over all messages of each conversation."""
    out = {}
    for conv in {r[0] for r in rows}:
        here = [(turn, *quotes._split(text)) for c, turn, _, text in rows if c == conv]
        said = [(turn, set(quotes._said(own))) for turn, own, _ in here]
        asked = {}
        for turn, _, runs in here:
            for p in quotes._passages(runs):
                asked.setdefault(turn, {})[p["level"], p["hash"]] = p["ways"]
        parent, linked = {}, {}
        for turn, passages in asked.items():
            links = []
            for (level, h), ways in passages.items():
                firsts = [t for t, s in said if h in s]
                if firsts and min(firsts) < turn:
                    links.append((-level, min(firsts)))
                    continue
                found = []
                for way in filter(None, ways):
                    share = sum(any(t < turn and x in s for t, s in said) for x in way) / len(way)
                    best = max(((sum(x in s for x in way), -t) for t, s in said if t < turn), default=(0, 0))
                    if share > 0.5:
                        found.append((share, best[0] / len(way), best[1]))
                if found:
                    links.append((-level, -max(found)[2]))
            if links:
                parent[turn], linked[turn] = max(links)[1], len(links)
        root = {}
        for turn in sorted({t for t, _ in said}):
            root[turn] = root[parent[turn]] if turn in parent else turn
        for turn, r in root.items():
            out[conv, turn] = (linked.get(turn, 0), parent.get(turn), r, sum(x == r and t < turn for t, x in root.items()))
    return out


def test_random_threads_equal_plain_loops(spark):
    rng = random.Random(5)
    rows = []
    for conv in range(12):
        texts = []
        for turn in range(30):
            lines = [rng.choice(["Yes.", "No!", "One two. Three.", "four five", "Six? Seven."]) + rng.choice(["", f" {rng.randrange(6)}."]) for _ in range(rng.randrange(1, 4))]
            if texts and rng.random() < 0.7:
                old = rng.choice(texts).split("\n")
                a = rng.randrange(len(old))
                cut = old[a : a + rng.randrange(1, 4)] + ([rng.choice(["made up.", "Yes."])] if rng.random() < 0.3 else [])
                lines = [f"> {x}" for x in cut] + lines
            texts.append("\n".join(lines))
            rows.append((conv, turn * (700 if conv % 2 else 1), "a", texts[-1]))
    got = {(r.conv_id, r.turn): (r.n_linked, r.parent_turn, r.thread_turn, r.thread_place) for r in linked(spark, rows)}
    assert got == plain(rows) and sum(x[3] > 3 for x in got.values()) > 20


def test_very_long_text_and_one_long_thread(spark):
    long = "\n".join(f"line {i} of many." for i in range(40000))
    rows = [(1, 0, "a", long), (1, 1, "b", "> line 39999 of many.\nyes"), (1, 2, "a", "\n".join(f"> {x}" for x in long.split("\n")) + "\nagain")]
    assert [(r.parent_turn, r.thread_place) for r in linked(spark, rows)] == [(None, 0), (0, 1), (0, 2)]
    rows = [(1, i, "a", "start" if i == 0 else "> start\nx") for i in range(3000)]
    assert [r.thread_place for r in linked(spark, rows)] == list(range(3000))
