"""Keyword rules: a small text format, compiled to one column expression.

Groups are separated by blank lines. In a group ``+word`` is required, ``!word`` excludes a
title from all groups, ``@n`` caps the group's titles, ``/regex/`` is a pattern and
``word => name`` gives a display name; other lines are alternatives. A section
``[GLOBAL_FILTER]`` lists plain substrings that drop a title before anything else.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Word:
    text: str
    regex: bool = False
    name: str | None = None

    def matches(self, title: Column) -> Column:
        return title.rlike("(?iuU)" + self.text) if self.regex else F.contains(F.lower(title), F.lit(self.text.lower()))


@dataclass
class Group:
    required: list[Word] = field(default_factory=list)
    normal: list[Word] = field(default_factory=list)
    limit: int = 0

    @property
    def key(self) -> str:
        return " ".join(w.text for w in (*self.required, *self.normal))

    @property
    def name(self) -> str:
        return " / ".join(w.name or w.text for w in (*self.required, *self.normal))

    def matches(self, title: Column) -> Column:
        parts = [w.matches(title) for w in self.required]
        if self.normal:
            parts.append(reduce(lambda a, b: a | b, (w.matches(title) for w in self.normal)))
        return reduce(lambda a, b: a & b, parts)


@dataclass
class Rules:
    groups: list[Group] = field(default_factory=list)
    exclude: list[Word] = field(default_factory=list)
    drop: list[str] = field(default_factory=list)

    def accepts(self, title: Column) -> Column:
        """Whether a title passes the filters and, if there are groups, is in one."""
        found = reduce(lambda a, b: a | b, (g.matches(title) for g in self.groups)) if self.groups else F.lit(True)
        return self._passes(title) & found

    def _passes(self, title: Column) -> Column:
        ok = F.trim(title) != ""
        for text in self.drop:
            ok &= ~F.contains(F.lower(title), F.lit(text.lower()))
        if self.groups:
            for word in self.exclude:
                ok &= ~word.matches(title)
        return ok

    def group_of(self, title: Column) -> Column:
        """Number of the first group that matches, else null; -1 stands for "all" without groups."""
        if not self.groups:
            return F.when(self._passes(title), F.lit(-1))
        first = F.lit(None).cast("int")
        for i in range(len(self.groups) - 1, -1, -1):
            first = F.when(self.groups[i].matches(title), F.lit(i)).otherwise(first)
        return F.when(self._passes(title), first)


def _word(line: str) -> Word:
    body, _, name = (x.strip() for x in line.partition("=>"))
    if len(body) > 2 and body[0] == "/" and body.rstrip("imsu")[-1] == "/":
        pattern = body.rstrip("imsu")[1:-1]
        try:
            re.compile(pattern)
        except re.error:
            return Word(body, False, name or None)
        return Word(pattern, True, name or None)
    return Word(body, False, name or None)


def parse(text: str) -> Rules:
    rules, group, section = Rules(), Group(), ""

    def end() -> None:
        nonlocal group
        if group.required or group.normal:
            rules.groups.append(group)
        group = Group()

    for line in (*text.splitlines(), ""):
        line = line.strip()
        if line.startswith("#"):
            continue
        if not line:
            end()
        elif line[0] == "[" and line[-1] == "]":
            end()
            section = line[1:-1].upper()
        elif section == "GLOBAL_FILTER":
            rules.drop.append(line)
        elif line[0] == "!":
            rules.exclude.append(_word(line[1:]))
        elif line[0] == "+":
            group.required.append(_word(line[1:]))
        elif line[0] == "@" and line[1:].isdigit():
            group.limit = int(line[1:])
        else:
            group.normal.append(_word(line))
    return rules
