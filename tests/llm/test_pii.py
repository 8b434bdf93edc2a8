import hashlib
import math
import random
import re
import time

from marginalia.llm import pii

SCHEMA = "doc_id long, text string, spans string"


def plain_base(text):
    found = [(m.start(), m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [(m.start(), m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m.group())
        total = sum(sum(map(int, str(int(c) * (1 + i % 2)))) for i, c in enumerate(digits[::-1]))
        if 12 <= len(digits) <= 19 and total % 10 == 0:
            found.append((m.start(), m.end(), "card"))
    found += [(m.start(), m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
    return sorted(found, key=lambda s: (s[0], pii.KINDS.index(s[2])))


CASES = [
    "", "a@b", "a@b.c", "@x.y", "a@@b.co x@y..z", "é.a+b%c-d_e@host-1.example.com.", "a@b.c@d.e", "a@b@c.d", "1.2.3.4.5.6.7.8 256.1.1.1 1.2.3 0001.2.3.4 1.2.3.04",
    "4085472667950514 4085-4726-6795-0514 4085  4726", "4085472667950515", "+1 (326) 555-7457 +12 +1234567 8 90 +1234567890123456", "x+1 925 555 2751@a.bc 79.45.104.137", "١٢٣٤ 1a1@q.w2",
    "+4085472667950514.", "12 34-56 78-90 12 34 56", "a" * 50, "🙂 a@b.c 🙂 1.1.1.1",
]


def test_base_patterns():
    for text in CASES:
        assert pii.base_spans(text) == plain_base(text), text


def test_linear_on_long_texts():
    start = time.time()
    for text in ("1" * 200_000, "a" * 200_000, "a@" * 100_000, "1." * 100_000, "+1" * 100_000, "(1" * 50_000, "[at] " * 40_000, "x.y [at] z [dot] " * 10_000):
        base = pii.base_spans(text)
        pii.added_spans(text, base, pii.SemiCrf({"phone": 1.0}))
    assert time.time() - start < 60


def training(spark):
    texts = []
    for i in range(120):
        card = next(c for c in range(4085472667950000 + 100 * i, 4085472667950100 + 100 * i) if pii.luhn(str(c)))
        texts += [f"word number{i} us.er{i}@mail{i % 7}.example.com goes on", f"some text +1 (3{i % 90 + 10}) 555-{7000 + i} and", f"w card {card} th", f"from 10.{i}.3.{i} it", f"version {i}.0 of {2000 + i} or {4085472667950000 + 100 * i + 1}"]
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], SCHEMA)


def test_model_adds_and_base_stays(spark):
    docs = training(spark)
    model = pii.fit(docs)
    assert model.weights == pii.fit(docs.repartition(7)).weights
    text = "call (925) 555-2751 or write to jo.hn [at] mail [dot] example [dot] com, not 4085472667950515 on 2024-01-02"
    assert [(k, text[a:b]) for a, b, k in pii.added_spans(text, pii.base_spans(text), model)] == [("phone", "(925) 555-2751"), ("email", "jo.hn [at] mail [dot] example [dot] com")]
    rows = [(1, None, "s"), (2, "", None), (None, text, "s"), (3, "a@b.cd", "s"), (3, "a@b.cd", "s"), (4, "x " * 60000 + "a@b.cd", "s")]
    found = {(r.doc_id, r.base): r for r in pii.find(spark.createDataFrame(rows, SCHEMA), model).collect()}
    assert found[1, ""].spans == found[2, ""].spans == ""
    assert found[1, ""].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert found[3, "email:0:6"].base_sha256 == hashlib.sha256(b"email:0:6").hexdigest()
    assert found[4, "email:120000:120006"].spans == "email:120000:120006"
    assert found[None, ""].spans.startswith("phone:5:")
    redacted = {r.doc_id: r for r in pii.find(spark.createDataFrame(rows, SCHEMA), model, redacted=True).collect()}
    assert redacted[1].text is None and redacted[3].text == "<EMAIL>" and redacted[3].spans == "s"
    assert redacted[None].text == "call <PHONE> or write to <EMAIL>, not 4085472667950515 on 2024-01-02"


def test_nothing_to_learn(spark):
    empty = spark.createDataFrame([], SCHEMA)
    model = pii.fit(empty)
    assert not model.weights and pii.find(empty, model).count() == 0
    assert pii.find(spark.createDataFrame([(1, "a@b.cd", None)], SCHEMA), model).first().spans == "email:0:6"


def segmentations(n, cands):
    """All sets of candidates that don't overlap, by enumeration."""
    out = [[]]
    for k, c in enumerate(cands):
        out += [[*chosen, k] for chosen in out if all(cands[x][1] <= c[0] or c[1] <= cands[x][0] for x in chosen)]
    return out


def test_dynamic_programming_against_enumeration():
    rng = random.Random(3)
    for _ in range(60):
        n = rng.randint(1, 9)
        spans = {(i, rng.randint(i + 1, n), rng.choice(pii.KINDS)) for i in (rng.randrange(n) for _ in range(rng.randint(0, 9)))}
        cands = [(i, j, kind, [f"{i} {j} {kind}"]) for i, j, kind in sorted(spans, key=lambda c: (c[1], c[0], c[2]))]
        model = pii.SemiCrf({c[3][0]: rng.uniform(-2, 2) for c in cands})
        scores = model.scores(cands)
        every = segmentations(n, cands)
        total = {tuple(s): sum(scores[k] for k in s) for s in every}
        best = model.decode(n, cands)
        assert abs(sum(scores[k] for k in best) - max(total.values())) < 1e-9 and tuple(sorted(best)) in total
        norm = sum(math.exp(v) for v in total.values())
        found = pii.marginals(n, cands, scores)
        for k in range(len(cands)):
            assert abs(found[k] - sum(math.exp(v) for s, v in total.items() if k in s) / norm) < 1e-9


def test_disguises_keep_their_spans_and_lookalikes_hold_none():
    window = "call +49 30 123 45 678 or mail ann.lee@example.org from 10.20.3.44 with 4085472667950514 now"
    spans = pii.base_spans(window)
    assert sorted(k for *_, k in spans) == sorted(pii.KINDS)
    for variant in range(pii.VARIANTS):
        text, found = pii.disguised(window, spans, variant)
        n, cands, gold = pii.example(text, found)
        assert len(found) == 4 and len(gold) == 4, (variant, text)
        text, found = pii.lookalike(window, spans, variant)
        assert [k for *_, k in found] == ["email"] and text[found[0][0] : found[0][1]] == "ann.lee@example.org"


def test_unseen_forms_and_numbers_of_other_kinds(spark):
    model, rng = pii.fit(training(spark)), random.Random(4)
    d = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    part = lambda: str(rng.randint(1, 255))

    def card():
        return next(c for c in iter(lambda: "5" + d(15), None) if pii.luhn(c))

    forms = {
        "phone": [lambda: f"{rng.randint(2, 9)}{d(2)}/{d(3)}/{d(4)}", lambda: f"0{d(1)}-{d(4)}-{d(4)}", lambda: f"{rng.randint(2, 9)}{d(2)} {d(3)}-{d(4)}"],
        "email": [lambda: f"a{d(2)}{{at}}mail.net", lambda: f"k.l{d(1)} [AT] acme[dot]co[dot]uk", lambda: f"x_{d(1)}<at>b-c<dot>org"],
        "card": [lambda: "_".join(re.findall("....", card())), lambda: "  ".join(re.findall("....", card())), lambda: (lambda c: f"{c[:4]}.{c[4:10]}.{c[10:]}")(card())],
        "ip": [lambda: " dot ".join(part() for _ in range(4)), lambda: "{.}".join(part() for _ in range(4)), lambda: "[dot]".join(part() for _ in range(4))],
    }
    others = [
        lambda: f"20{d(2)}/0{rng.randint(1, 9)}/1{d(1)} 1{d(1)}:3{d(1)}", lambda: f"no. {d(10)}", lambda: f"20{d(2)}.0{rng.randint(1, 9)}.2{d(1)} 08.15", lambda: f"{rng.randint(1, 9)}.{d(12)}",
        lambda: f"{part()} . {part()} . 3 . 1 . 2", lambda: f"979-{d(2)}-{d(4)}-{d(3)}-{d(1)}", lambda: f"{card()[:6]}/{d(9)}", lambda: f"{d(3)},{d(3)},{d(3)}.{d(2)}",
    ]
    right, wrong, every = 0, 0, 0
    for kind, made in [*((k, f) for k, fs in forms.items() for f in fs), *((None, f) for f in others)]:
        for _ in range(25):
            piece = made()
            text = f"these words come before {piece} and those words come after it"
            found, want = pii.added_spans(text, pii.base_spans(text), model), (24, 24 + len(piece), kind)
            every, right, wrong = every + (kind is not None), right + (want in found), wrong + len([s for s in found if s != want])
    assert right >= 0.9 * every and right >= 0.95 * (right + wrong), (right, wrong, every)
