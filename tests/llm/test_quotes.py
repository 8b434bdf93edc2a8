import random
import time

from marginalia.llm import quotes

SCHEMA = "conv_id long, turn long, role string, text string, own string"


def rows():
    return [
        (1, 0, "user", "Shall we meet on Monday?\nBring the  slides."),
        (1, 1, "user", "Monday is bad for me."),
        (1, 2, "user", "Ann wrote:\n> shall we MEET on Monday?\n> Bring the slides.\n\nYes, gladly."),
        (1, 3, "user", "On Tue Bob wrote:\n> > Bring the slides.\n> Monday is bad for me.\n> unknown words here\nThen Tuesday."),
        (1, 4, "user", "> Yes, gladly.\n>\n>> Bring the slides.\nGood."),
        (2, 0, "user", "> Then Tuesday.\nfrom elsewhere"),
        (2, 1, None, None), (2, 2, "user", ""), (2, 2, "user", ""), (2, 300, "user", ">"), (2, 301, "user", "x" * 100_000 + "\n" + "y " * 50_000),
        (None, 5, "user", "alone"), (None, 6, "user", "> alone\nnot now"), (3, None, "user", "no turn"), (3, 1, "user", "> no turn\nyes"),
        (2, 302, "user", "> ann wrote:\n> x\nhe said:\nnothing quoted"),
    ]


def plain(messages):
    """Loops instead of joins."""
    parsed = [(m, quotes.parse(m[3])) for m in messages]
    out = []
    key = lambda c: (c is not None, c or 0)
    for m, (text, _, qs, levels) in parsed:
        votes, linked = {}, set()
        for number, level, value, words in set(qs):
            here = [x[1] for x, p in parsed if x[0] == m[0] and x[1] is not None and value in p[1]]
            target = None
            if here and m[1] is not None and min(here) < m[1]:
                target = (m[0], min(here))
            else:
                firsts = {}
                for x, p in parsed:
                    if x[1] is not None and value in p[1] and x[0] != m[0]:
                        firsts[x[0]] = min(firsts.get(x[0], x[1]), x[1])
                if firsts and words >= quotes.LEAST:
                    first = min(firsts, key=key)
                    target = (first, firsts[first])
            if target:
                linked.add(number)
                if level == 1:
                    votes[target] = votes.get(target, 0) + words
        before = max((x[1] for x in messages if x[0] == m[0] and x[1] is not None and m[1] is not None and x[1] < m[1]), default=None)
        if votes:
            reply = max(votes, key=lambda t: (votes[t], t[1], key(t[0])))
        else:
            reply = (m[0] if before is not None else None, before)
        out.append((m[0], m[1], m[2], text, levels, len({q[0] for q in qs}), len(linked), *reply))
    return sorted(out, key=str)


def tree_order(replies):
    """Turns (with repeats) by a walk of the reply tree: the rest of a run before branches, branches that left later first."""
    turns = sorted({t for t, _ in replies})
    parent = dict(replies)
    before = dict(zip(turns[1:], turns, strict=False))
    out, head, path = [], {}, {}
    for t in turns:
        back = parent[t] if parent[t] is not None else before.get(t)
        starts = parent[t] is not None and back != before.get(t)
        head[t] = t if starts else head.get(before.get(t))
        path[t] = (*path[back], (-back, t)) if starts else path.get(before.get(t), ())
    for t in sorted(turns, key=lambda t: (path[t], t)):
        out += [t] * sum(x == t for x, _ in replies)
    return out


def test_threads_stay_together(spark):
    said = ["start of it all here", "> start of it all here\nfirst answer to it", "> start of it all here\nsecond answer to it", "> first answer to it\ndeeper one", "> second answer to it\ndeeper two", "more of two", "> deeper one\ndeepest"]
    data = [(1, k, "user", t) for k, t in enumerate(said)] + [(2, 0, "user", "> start of it all here\nelsewhere")]
    out = quotes.conversations(spark.createDataFrame([(*r, "x") for r in data], SCHEMA)).collect()
    own = [r.turn for r in sorted((r for r in out if r.conv_id == 1), key=lambda r: r["position"])]
    assert own == [0, 1, 3, 6, 2, 4, 5]
    assert [(r.reply_conv, r.reply_turn) for r in out if r.conv_id == 2] == [(1, 0)]


def test_random_reply_trees(spark):
    rng = random.Random(4)
    data = []
    for conv in range(6):
        for k in range(60):
            back = rng.randrange(k) if k and rng.random() < 0.6 else None
            data.append((conv, k, "user", (f"> words of {conv} {back}\n" if back is not None else "") + f"words of {conv} {k}"))
    out = quotes.conversations(spark.createDataFrame([(*r, "x") for r in data], SCHEMA)).collect()
    for conv in range(6):
        own = sorted((r for r in out if r.conv_id == conv), key=lambda r: r["position"])
        assert [r.turn for r in own] == tree_order([(r.turn, r.reply_turn) for r in own])
        at = {r.turn: r["position"] for r in own}
        assert all(at[r.reply_turn] < at[r.turn] for r in own if r.reply_turn is not None)


def test_branches_of_any_depth(spark):
    turns = spark.createDataFrame([(1, 0, False, None, None)] + [(1, k, k > 1, k - 2 if k > 1 else None, k if k > 1 else None) for k in range(1, 90)], "conv_id long, turn long, start boolean, to long, head long")
    paths = {r.head: tuple(map(tuple, r.path)) for r in quotes.branches(turns).collect()}
    want = {}
    for k in range(2, 90):
        want[k] = (*want.get(k - 2, ()), (2 - k, k))
    assert paths == want and max(map(len, paths.values())) > 40


def test_parsing_is_linear():
    for text in ("a wrote:\n" * 200_000, "a wrote:\n\n" * 100_000, "\n \n" * 200_000 + "x", "> a\n" * 200_000):
        start = time.perf_counter()
        quotes.parse(text)
        assert time.perf_counter() - start < 3


def test_parse_levels():
    own, _, found, levels = quotes.parse("Ann wrote:\n> one\n> two\n>> three\nmine\n> four")
    assert own == "mine" and levels == 2
    assert [(n, level, w) for n, level, _, w in found] == [(0, 1, 2), (0, 1, 1), (0, 1, 1), (1, 2, 1), (2, 1, 1)]
    assert quotes.parse("a > b\n  said: \n")[0] == "a > b\n  said: \n"


def test_against_loops(spark):
    data = rows()
    out = quotes.conversations(spark.createDataFrame([(*r, "x") for r in data], SCHEMA)).collect()
    found = sorted(((r.conv_id, r.turn, r.role, r.text, r.levels, r.quotes, r.linked, r.reply_conv, r.reply_turn) for r in out), key=str)
    assert found == plain(data)
    for conv in {r.conv_id for r in out}:
        own = sorted((r for r in out if r.conv_id == conv), key=lambda r: r["position"])
        assert [r["position"] for r in own] == list(range(len(own)))
        assert [(r.turn, r.role, r.text) for r in own if r.turn is None] == [(r.turn, r.role, r.text) for r in own][: sum(r.turn is None for r in own)]
        assert [r.turn for r in own if r.turn is not None] == tree_order([(r.turn, r.reply_turn if r.reply_conv == conv else None) for r in own if r.turn is not None])
    reply = {(r.conv_id, r.turn): (r.reply_conv, r.reply_turn) for r in out}
    assert reply[1, 2] == (1, 0) and reply[1, 3] == (1, 1) and reply[1, 4] == (1, 2) and reply[2, 0] == (None, None)


def test_empty(spark):
    assert quotes.conversations(spark.createDataFrame([], SCHEMA)).count() == 0
