import random
import re
import time

import pytest

from marginalia.functions import markdown as m
from marginalia.functions import text as t

# The patterns that the linear scans must equal.
WIKI = re.compile(r"\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]")
LINK = re.compile(r"\[[^\]]+\]\(([^)]+)\)")


def by_pattern(body):
    wiki = {x.group(1).strip() for x in WIKI.finditer(body)}
    links = {y for x in LINK.finditer(body) if (y := x.group(1).strip()) and "://" not in y and not y.startswith("#")}
    return sorted(wiki), sorted(links)


CASES = ["[[a]] [[b|c]] [[d#e]] [[d#e|f]]", "[[a", "[[a]", "[[]]", "[[#x]]", "[[a|]]", "[[a#]]", "[[a#|b]]", "[[[a]]]", "[[a[[b]]", "[x](y) [](z) [x]() [a](b", "[a[b](c)", "[[a]](b)", "[a](http://x) [a](#b) [a]( c )", "[[a|b#c]]", "[[a#b|]]x]]", "![[i.png]]"]


def test_links_equal_the_patterns():
    rng = random.Random(11)
    bodies = CASES + ["".join(rng.choices("[]()|#ab \n", k=rng.randint(0, 24))) for _ in range(20000)]
    for body in bodies:
        assert (m.wiki_links(body), m.markdown_links(body)) == by_pattern(body), repr(body)


@pytest.mark.parametrize("unit", ["[x](", "[", "[[x|", "[[", "]", "[[a#", "[[a|b]", "](", "[a]("])
def test_links_are_linear(unit):
    start = time.time()
    body = unit * (200_000 // len(unit))
    m.wiki_links(body), m.markdown_links(body)
    assert time.time() - start < 1


def test_resolve_relative():
    assert m.resolve_relative("../b/c%20d.md#x", "a/e.md") == "b/c d.md"
    assert m.resolve_relative("../../x", "a/e.md") is None
    assert m.resolve_relative("/x", "a/e.md") is None and m.resolve_relative("#x", "a/e.md") is None
    assert m.resolve_relative("%ZZ", "e.md") == "%ZZ" and m.resolve_relative("./f", "a/b/e.md") == "a/b/f"
    assert m.lookup_form("a/B.MD") == "a/B"


def test_tokens():
    text = "abc あいう 漢字 Привет é 🙂"
    counts = t.character_counts(text)
    assert sum(counts.values()) == len(text) + 1 and counts["cjk"] == 5
    assert t.estimate_tokens("") == 1
    assert t.character_counts("~~~\n```\ncode\n~~~\nx")["code"] == len("```\ncode\n")
    for budget in (0, 1, 5, 40):
        cut = t.truncate_to_tokens("word あ " * 50, budget)
        assert ("word あ " * 50).startswith(cut) and (not cut or t.estimate_tokens(cut) <= budget)
        if budget > 1:
            assert t.estimate_tokens(("word あ " * 50)[: len(cut) + 1]) > budget


def test_snippets():
    body = "alpha " + "filler " * 120 + "omega end"
    s = t.snippet(body, ["alpha", "omega"])
    assert s.startswith("alpha") and t.SNIPPET_JOIN in s and "omega end" in s
    assert t.snippet("x" * 300, ["zz"]) == "x" * 220 + "..."
    assert t.snippet("", ["a"]) == ""
    wide = "ｆｕｌｌ　ｗｉｄｔｈ が text"
    assert "が" in t.snippet(wide, [t.fold("が")])
    assert t.fold("Ｆｕｌｌ") == "full"


def test_sections():
    body = "# Doc\nintro\n## Design ##\na\n### Rejected\nb\n## C#\n```\n# no\n```\nc"
    assert [(o["heading"], o["level"], o["start_line"]) for o in m.outline(body)] == [("Doc", 1, 1), ("Design", 2, 3), ("Rejected", 3, 5), ("C#", 2, 7)]
    assert m.outline(body)[2]["heading_path"] == ["Doc", "Design", "Rejected"]
    assert m.select_sections(body, ["design", "Doc/Design/Rejected", "nope"]) == ("## Design ##\na\n### Rejected\nb", ["design", "Doc/Design/Rejected"])
    long = "\n".join(f"## S{i}\n" + "x" * 3000 + f"\n### T{i}\n" + "y" * 4000 for i in range(3))
    parts = m.split_sections("pre\n" + long)
    assert "\n".join(p for _, p in parts) == "pre\n" + long
    assert [p for p, _ in parts] == [[], *[q for i in range(3) for q in (["S%d" % i], ["S%d" % i, "T%d" % i])]]
    assert m.split_sections("short") == [([], "short")]
    assert m.split_sections("# One\n" + "z" * 7000) == [(["One"], "# One\n" + "z" * 7000)]


def test_frontmatter():
    pytest.importorskip("yaml")
    data, body, error = m.parse_note("---\ntitle: T\ntags: a\nclient: 3\nupdated_at: 2026-01-02\nflag: yes\nid: 7\n---\n# B\n")
    assert (body, error) == ("# B\n", None)
    assert data["tags"] == ["a"] and data["client"] == "3" and data["flag"] == "yes" and data["id"] == 7 and not isinstance(data["updated_at"], str)
    assert m.parse_note("no block")[0] == {}
    assert m.parse_note("---js\nx\n---\n")[2] and m.parse_note("---\n: [\n---\nb")[1] == "---\n: [\n---\nb"
    assert m.parse_note("---\n" + "a: " + "x" * 9000 + "\n---\n")[2]
    bomb = "a: &a [" + "x," * 40 + "]\n" + "\n".join(f"{c}: &{c} [" + f"*{p}," * 12 + "]" for p, c in zip("abcde", "bcdef", strict=True))
    assert m.parse_note(f"---\n{bomb}\n---\nb")[2]
    assert m.note_title({}, "x\n# Head \n", "p/q.md") == "Head" and m.note_title({"title": 3}, "", "p/q.md") == "q"
    assert m.aliases({"aliases": ["a", 3, " "]}) == ["a"] and m.aliases({"aliases": " b "}) == ["b"]


def test_project_body():
    body = "# A\nx\n## B\ny🙂"
    assert m.project_body(body) == {"body": body}
    assert m.project_body(body, max_chars=5) == {"body": "# A\nx", "truncated": True, "total_chars": 14}
    assert m.project_body(body, max_chars=13)["body"] == body[:-1]
    assert m.project_body(body, sections=["b", "zz"]) == {"body": "## B\ny🙂", "truncated": True, "total_chars": 14, "sections_matched": ["b"]}
    found = m.project_body(body, with_outline=True)
    assert found["body"] == "" and found["truncated"] and len(found["outline"]) == 2


def test_type_rules():
    from marginalia.plans.context import TypeRule, parse_type_rules

    rules, hint = parse_type_rules({"rules": [{"name": "p", "match": {"path_prefix": "p/"}, "weight": 9}, {"name": "t", "match": {"tag": "t", "root": "r"}, "weight": 2}], "frontmatter_type_hint": {"enabled": True, "max_weight": 5}})
    assert rules == [TypeRule("p", 3.0, path_prefix="p/"), TypeRule("t", 1.25, root="r", tag="t")] and hint == 1.25
    assert parse_type_rules({"rules": []}) == ([], None)
    for bad in ({}, {"rules": [{}]}, {"rules": [{"name": "x", "match": {}, "weight": 1}]}, {"rules": [{"name": "x", "match": {"tag": "t"}, "weight": 0}]}, {"rules": [{}] * 65}):
        with pytest.raises(ValueError):
            parse_type_rules(bad)
