"""Markdown blocks against a reader that goes through a text line by line."""

import random
import re

from lodestack.operators import markdown as M


def brute(text):
    if text is None:
        return []
    lines, out, fenced, end = re.split("\r?\n", text), [], False, 0
    if lines[0].strip() == "---":
        end = next((k + 1 for k in range(1, len(lines)) if lines[k].strip() == "---"), 0)
    for n, line in enumerate(lines, 1):
        if n <= end:
            at = line.find(":")
            if 1 < n < end and at > 0:
                out.append((n, "front_field", 0, None, line[:at].strip(), None, None, [line[at + 1 :].strip()], None, line))
            continue
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
            continue
        if fenced:
            continue
        h = re.match(r"^(#{1,6})\s+(.+?)\s*#*\s*$", line)
        if h:
            out.append((n, "heading", 0, len(h[1]), h[2], None, None, None, None, line))
            continue
        i = re.match(r"^(\s*)(\d+)[.)]\s+\S", line)
        if i:
            out.append((n, "ordered_list_item", len(i[1]), None, None, int(i[2]), len(i[1]), None, None, line))
        if line.strip().count("|") >= 2:
            t = line.strip().removeprefix("|")
            t = t[:-1] if t.endswith("|") else t
            out.append((n, "table_row", line.index("|"), None, None, None, None, [c.strip() for c in t.split("|")], None, line))
        k = 0
        while (k := line.find("[", k)) >= 0:
            close = line.find("]", k + 1)
            stop = line.find(")", close + 2) if close >= 0 and line[close + 1 : close + 2] == "(" else -1
            if k and line[k - 1] == "!" or stop < 0:
                k += 1
                continue
            target = (line[close + 2 : stop].split() or [""])[0]
            out.append((n, "link", k, None, line[k + 1 : close], None, None, None, target, line[k : stop + 1]))
            k = stop + 1
    return out


LINES = [
    "# One", "###### Six ##  ", "#no", "####### seven", "## a # b #", "1. one", "   2) two", "10.x", "a. b", "| a | b |", "a | b | c", " | - | ", "|", "||", "x | y", "```", "  ~~~ js", "[a](b)", "![i](j)", "see [x [y](z w) and [q](", "[n](  m.md 't' )[e]()", "text",
    "", "---", "key: v", ": v", "name : a: b ", "3. | x | [k](l) |", "é [ü](ñ.md) [2](3)", "[a] (b) [c](d)", "# [h](l)", "99999999999999999999. big",
]


def test_blocks_of_random_texts(spark):
    r = random.Random(2)
    texts = [None, "", "---", "---\nkey: v\n---\n# T", "---\n```\nkey: v\n---\n# T\n```\n# no\n```\n# yes", "\n---\na: b\n---", "---\nkey: v\n", " --- \nk: a\nk: b\n ---\nx", "# a\r\n1. b\r\n```\r\n# c"]
    texts += [r.choice(["", "---\n"]) + r.choice(["\n", "\r\n"]).join(r.choice(LINES) for _ in range(r.randrange(30))) for _ in range(150)]
    texts.append("\n".join(["# h", "```", "# no", "```", "| a | b |"] * 2000))
    rows = list(enumerate(texts))
    got = {}
    for x in M.markdown_blocks(spark.createDataFrame(rows, "d long, t string").repartition(3), "d", "t").collect():
        got.setdefault(x["d"], []).append((x["line"], x["kind"], x["column"], x["depth"], x["text"], None if x["number"] is None else int(x["number"]), x["indent"], x["cells"], x["target"], x["raw"]))
    for d, t in rows:
        key = lambda b: (b[0], M.KINDS.index(b[1]), b[2])
        assert sorted(got.get(d, []), key=key) == sorted(brute(t), key=key), t
    assert len({b[1] for bs in got.values() for b in bs}) == 5


def test_front_fields(spark):
    df = spark.createDataFrame([("a", "---\nk: 1\nk: 2\nz:\n---\nq: 3"), ("b", "k: 1")], "d string, t string")
    assert sorted(tuple(r) for r in M.front_fields(df, "d", "t").collect()) == [("a", "k", "2"), ("a", "z", "")]
    assert M.markdown_blocks(df.limit(0), "d", "t").count() == 0
