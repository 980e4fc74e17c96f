"""Reports as messages against a plain loop."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidemark.functions import display as D

SECTION = "array<struct<header: string, gap: string, between: string, groups: array<struct<heading: string, items: array<string>>>>>"


def _apart(content, header, footer, most):
    out, now = [], ""
    for line in content.split("\n"):
        if len((now + line + "\n" + footer).encode()) > most and now.strip():
            out.append(now + footer)
            now = header
        now += line + "\n"
    return out + [now + footer] * bool(now.strip())


def _whole_lines(text, most):
    rough = text.encode()[: max(most, 0)].decode(errors="ignore")
    return rough[: rough.rfind("\n")] if rough.rfind("\n") > 0 else rough


def _messages(sections, header, footer, most):
    out: list[str] = []
    state = {"open": header, "some": False}

    def size(text):
        return len((text + footer).encode())

    def close():
        if state["some"]:
            text = state["open"]
            out.extend([text + footer] if size(text) <= most else _apart(text, header, footer, most) or [_whole_lines(text + footer, most)])

    def say(add, fresh):
        if size(state["open"] + add) < most:
            state.update(open=state["open"] + add, some=True)
        elif fresh is not None:
            close()
            text = header + fresh
            if size(text) > most and len(parts := _apart(text, header, footer, most)) > 1:
                out.extend(parts[:-1])
                text = parts[-1][: len(parts[-1]) - len(footer)]
            state.update(open=text, some=True)

    for s, section in enumerate(sections):
        say((section["gap"] if s else "") + section["header"], section["header"])
        for g, group in enumerate(section["groups"]):
            if g:
                say(section["between"], None)
            first = group["items"][0] if group["items"] else ""
            say(group["heading"] + first, section["header"] + group["heading"] + first)
            for item in group["items"][1:]:
                say(item, section["header"] + group["heading"] + item)
    close()
    return out


def _report(dice):
    word = lambda: dice.choice(("ab", "é🔺", "日本", "x" * 9, "two\nlines", "")) * dice.randint(0, 6)
    group = lambda: {"heading": f"{word()}:\n", "items": [f"{i}. {word()}\n" for i in range(dice.randint(0, 5))]}
    return [{"header": f"# {word()}\n", "gap": "\n---\n", "between": "\n\n", "groups": [group() for _ in range(dice.randint(0, 4))]} for _ in range(dice.randint(0, 4))]


@pytest.mark.parametrize("most", [20, 45, 80, 160, 4000])
def test_report_messages_equal_a_plain_loop(spark, most):
    dice = random.Random(most)
    reports = [_report(dice) for _ in range(60)]
    longest = max(reports, key=lambda r: sum(len(g["items"]) for s in r for g in s["groups"]))
    for s in range(len(longest)):  # every prefix of one report
        for g in range(len(longest[s]["groups"]) + 1):
            reports.append(longest[:s] + [{**longest[s], "groups": longest[s]["groups"][:g]}])
    rows = spark.createDataFrame(list(enumerate(reports)), f"i int, sections {SECTION}")
    found = D.report_messages(D.report_units(F.col("sections")), F.lit("Head\n\n"), F.lit("\n\n> end"), most)
    got = [r["m"] for r in rows.select("i", found.alias("m")).orderBy("i").collect()]
    assert got == [_messages(r, "Head\n\n", "\n\n> end", most) for r in reports]


def test_a_heading_stays_with_its_first_item(spark):
    sections = [{"header": "S\n", "gap": "\n", "between": "\n", "groups": [{"heading": f"group {g}\n", "items": [f"item {g}{i}\n" for i in range(3)]} for g in range(9)]}]
    rows = spark.createDataFrame([(sections,)], f"sections {SECTION}")
    found = rows.select(D.report_messages(D.report_units(F.col("sections")), F.lit(""), F.lit("--"), 50).alias("m")).first()["m"]
    assert len(found) > 3 and all(len(m.encode()) < 50 for m in found)
    for message in found:
        lines = [x for x in message.split("\n") if x]
        assert lines[0] == "S" and not any(a.startswith("group") and not b.startswith("item") for a, b in zip(lines, lines[1:]))
