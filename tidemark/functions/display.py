"""How ranks, times, changes and messages are shown. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What surrounds a high rank, by channel.
HIGHLIGHT = {
    "html": ("<font color='red'><strong>", "</strong></font>"),
    "feishu": ("<font color='red'>**", "**</font>"),
    "telegram": ("<b>", "</b>"),
    "slack": ("*", "*"),
}


def rank_display(ranks: Column, threshold: int, channel: str = "") -> Column:
    """``[best - worst]``, marked if the best reaches the threshold, with an arrow for the last move."""
    best, worst = F.array_min(ranks), F.array_max(ranks)
    body = F.when(best == worst, F.format_string("[%d]", best)).otherwise(F.format_string("[%d - %d]", best, worst))
    start, end = HIGHLIGHT.get(channel, ("**", "**"))
    marked = F.when(best <= threshold, F.concat(F.lit(start), body, F.lit(end))).otherwise(body)
    last, before = F.try_element_at(ranks, F.lit(-1)), F.try_element_at(ranks, F.lit(-2))
    arrow = F.when(last < before, " 🔺").when(last > before, " 🔻").otherwise(" ➖")
    shown = F.when(F.size(ranks) >= 2, F.concat(marked, arrow)).otherwise(marked)
    return F.when(F.size(ranks) > 0, shown).otherwise("")


def clock(time: Column) -> Column:
    """HH:MM of a time written as HH-MM, HH:MM or after a date."""
    found = F.regexp_extract(time, r"(\d{2}[:-]\d{2})(:\d{2})?$", 1)
    return F.when(found != "", F.replace(found, F.lit("-"), F.lit(":"))).otherwise(time)


def time_display(first: Column, last: Column) -> Column:
    """One time, or ``[first ~ last]``."""
    a, b = clock(first), clock(last)
    shown = F.when(b.isNull() | (b == "") | (a == b), a).otherwise(F.concat(F.lit("["), a, F.lit(" ~ "), b, F.lit("]")))
    return F.when(first.isNull() | (first == ""), "").otherwise(shown)


def friendly(iso: Column, zone: str, with_date: bool = True) -> Column:
    """``MM-dd HH:mm`` in a time zone; without an offset a time is UTC. What can't be read is cut out of the text."""
    utc = F.try_to_timestamp(F.when(iso.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), iso).otherwise(F.concat(iso, F.lit("Z"))))
    text = F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), utc.cast("timestamp_ntz")), "MM-dd HH:mm" if with_date else "HH:mm")
    day, time = F.substring(F.substring_index(iso, "T", 1), 6, 10), F.left(F.substring_index(iso, "T", -1), F.lit(5))
    rough = F.when(iso.contains("T"), F.concat_ws(" ", day, time) if with_date else time).otherwise(iso)
    return F.coalesce(text, rough)


def timeline(steps: Column, time: str = "time", rank: str = "rank") -> Column:
    """``rank(time)`` of each step, joined by arrows; 0 where the item was off the list."""
    parts = F.transform(steps, lambda s: F.concat(F.coalesce(s[rank], F.lit(0)).cast("string"), F.lit("("), clock(s[time]), F.lit(")")))
    return F.when(F.size(steps) > 0, F.array_join(parts, "→")).otherwise("-")


def percent(share: Column, signed: bool = False) -> Column:
    return F.format_string("%+.1f%%" if signed else "%.1f%%", share)


#: What a message's footer begins with, in order of choice.
FOOTERS = ("\n\n\n> ", "\n\n> ", "\n\n<font", "\n\n_", "\n\n更新时间")
#: What surrounds the number of a message, by channel.
NUMBER_MARKS = {"telegram": ("<b>", "</b>"), "slack": ("*", "*"), "wework_text": ("", ""), "bark": ("", "")}


def _let(value: Column, body) -> Column:
    """The value under a name, so that it stands in the plan once."""
    return F.transform(F.array(value), body)[0]


def cut_bytes(text: Column, most: int | Column) -> Column:
    """The longest start of the text that has ``most`` bytes of UTF-8 or fewer."""
    raw, most = text.cast("binary"), F.lit(most)
    tries = [F.try_validate_utf8(F.substring(raw, F.lit(1), F.greatest(most - i, F.lit(0))).cast("string")) for i in range(4)]
    return F.when(F.octet_length(text) <= most, text).otherwise(F.coalesce(*tries, F.lit("")))


def cut_lines(text: Column, most: int | Column) -> Column:
    """As ``cut_bytes``, back to the last whole line if there is one."""
    rough = cut_bytes(text, most)
    whole = F.substring(rough, F.lit(1), F.length(rough) - F.length(F.substring_index(rough, "\n", -1)) - 1)
    return F.when(F.octet_length(text) <= most, text).when(F.length(whole) > 0, whole).otherwise(rough)


def footer_of(text: Column) -> Column:
    """The end of a message from the last place where a footer begins; empty if none does."""
    found = []
    for mark in FOOTERS:
        rest = F.length(F.substring_index(text, mark, -1)) + len(mark)
        found.append(F.when(text.contains(mark) & (rest < F.length(text)), F.right(text, rest)))
    return F.coalesce(*found, F.lit(""))


def _without_end(text: Column, end: Column) -> Column:
    return F.left(text, F.length(text) - F.length(end))


def cut_before_footer(text: Column, most: int | Column) -> Column:
    """As ``cut_lines``, but the footer stays whole where it fits."""

    def cut(footer: Column) -> Column:
        room = F.lit(most) - F.octet_length(footer)
        return F.when((footer == "") | (room <= 0), cut_lines(text, most)).otherwise(F.concat(cut_lines(_without_end(text, footer), room), footer))

    return F.when(F.octet_length(text) <= most, text).otherwise(_let(footer_of(text), cut))


def _number(channel: str, nth: Column, total: Column) -> Column:
    start, end = NUMBER_MARKS.get(channel, ("**", "**"))
    return F.format_string(f"{start}[第 %d/%d 批次]{end}\n\n", nth, total)


def numbered_messages(messages: Column, channel: str, most: int) -> Column:
    """Several messages with their number and how many they are in front, each in ``most`` bytes.

    One that is too long is taken apart between lines, and each part gets the footer; only a line that is
    too long by itself is cut. A single message has no number."""
    reserve = len("".join(NUMBER_MARKS.get(channel, ("**", "**"))).encode()) + len("[第 99/99 批次]\n\n".encode())
    room = most - reserve

    def apart(message: Column) -> Column:
        def parts(footer: Column) -> Column:
            left = F.lit(room) - F.octet_length(footer)
            own = F.transform(packed_lines(F.split(_without_end(message, footer), "\n"), left), lambda part: F.concat(part, footer))
            return F.when(left <= 0, F.array(cut_lines(message, room))).when(F.size(own) > 0, own).otherwise(F.array(message))

        return F.when(F.octet_length(message) > room, _let(footer_of(message), parts)).otherwise(F.array(message))

    def number(all_: Column) -> Column:
        def one(message: Column, i: Column) -> Column:
            return _let(_number(channel, i + 1, F.size(all_)), lambda h: F.concat(h, cut_before_footer(message, F.lit(most) - F.octet_length(h))))

        return F.when(F.size(all_) <= 1, all_).otherwise(F.transform(all_, one))

    return F.when(F.size(messages) <= 1, messages).otherwise(_let(F.flatten(F.transform(messages, apart)), number))


def packed_lines(lines: Column, most: int | Column) -> Column:
    """Lines in order as messages of up to ``most`` bytes each, a line end after every line.

    A line that alone is longer has a message of its own. The lines of one report are one array."""
    said = lambda c: c.rlike(r"(?U)\S")
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(s: Column, line: Column) -> Column:
        longer = F.concat(s["open"], line, F.lit("\n"))
        full = (F.octet_length(longer) > most) & said(s["open"])
        done = F.when(full, F.array_append(s["done"], s["open"])).otherwise(s["done"])
        return F.struct(done.alias("done"), F.when(full, F.concat(line, F.lit("\n"))).otherwise(longer).alias("open"))

    return F.aggregate(lines, start, add, lambda s: F.when(said(s["open"]), F.array_append(s["done"], s["open"])).otherwise(s["done"]))


def report_units(sections: Column) -> Column:
    """What a report is packed by: sections (header, gap, between, groups (heading, items)) as an array of (add, fresh).

    ``add`` is put behind an open message; if it doesn't fit, ``fresh`` begins the next one (NULL: it is left out). A heading
    and its first item are one unit, and where an item begins a message its section's header and heading are said again.
    ``gap`` stands before a section other than the first, ``between`` between two groups."""
    unit = lambda add, fresh: F.struct(add.alias("add"), fresh.alias("fresh"))
    none = F.lit(None).cast("string")

    def of_group(section: Column, group: Column, nth: Column) -> Column:
        said = F.concat(section["header"], group["heading"])
        items = F.transform(group["items"], lambda x, i: unit(F.when(i == 0, F.concat(group["heading"], x)).otherwise(x), F.concat(said, x)))
        bare = F.array(unit(group["heading"], said))
        whole = F.when(F.size(items) > 0, items).otherwise(bare)
        return F.when(nth == 0, whole).otherwise(F.concat(F.array(unit(section["between"], none)), whole))

    def of_section(section: Column, nth: Column) -> Column:
        head = F.array(unit(F.when(nth == 0, section["header"]).otherwise(F.concat(section["gap"], section["header"])), section["header"]))
        return F.concat(head, F.flatten(F.transform(section["groups"], lambda g, i: of_group(section, g, i))))

    return F.flatten(F.transform(sections, of_section))


def _said(text: Column) -> Column:
    return text.rlike(r"(?U)\S")


def _line_messages(content: Column, header: Column, footer: Column, most: int) -> Column:
    """A message that is too long, taken apart between lines: each part but the first has the header, each the footer."""
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def add(s: Column, line: Column) -> Column:
        longer = F.concat(s["open"], line, F.lit("\n"))
        full = (F.octet_length(longer) + F.octet_length(footer) > most) & _said(s["open"])
        done = F.when(full, F.array_append(s["done"], F.concat(s["open"], footer))).otherwise(s["done"])
        return F.struct(done.alias("done"), F.when(full, F.concat(header, line, F.lit("\n"))).otherwise(longer).alias("open"))

    last = lambda s: F.when(_said(s["open"]), F.array_append(s["done"], F.concat(s["open"], footer))).otherwise(s["done"])
    return F.aggregate(F.split(content, "\n"), start, add, last)


def report_messages(units: Column, header: Column, footer: Column, most: int) -> Column:
    """Units as messages that have the header, the footer and fewer than ``most`` bytes. No unit is lost: what is too long by
    itself goes over several messages, between its lines (these may have ``most`` bytes; a longer line stays whole)."""
    room = lambda text: F.octet_length(text) + F.octet_length(footer)
    no_messages = F.array().cast("array<string>")

    def closed(text: Column) -> Column:
        whole = F.concat(text, footer)

        def parts(found: Column) -> Column:
            return F.when(F.size(found) > 0, found).otherwise(F.array(cut_lines(whole, most)))

        return F.when(room(text) <= most, F.array(whole)).otherwise(_let(_line_messages(text, header, footer, most), parts))

    def opened(text: Column) -> Column:
        """(done, open) of a new message."""

        def parts(found: Column) -> Column:
            many = F.size(found) > 1
            last = F.element_at(found, -1)
            return F.struct(
                F.when(many, F.slice(found, F.lit(1), F.size(found) - 1)).otherwise(no_messages).alias("done"),
                F.when(many, F.left(last, F.length(last) - F.length(footer))).otherwise(text).alias("open"),
            )

        fits = F.struct(no_messages.alias("done"), text.alias("open"))
        long = _let(F.when(room(text) > most, _line_messages(text, header, footer, most)).otherwise(no_messages), parts)
        return F.when(room(text) <= most, fits).otherwise(long)

    def add(s: Column, unit: Column) -> Column:
        longer = F.concat(s["open"], unit["add"])
        before = F.when(s["some"], F.concat(s["done"], closed(s["open"]))).otherwise(s["done"])

        def begun(new: Column) -> Column:
            return F.struct(F.concat(before, new["done"]).alias("done"), new["open"].alias("open"), F.lit(True).alias("some"))

        said = F.struct(s["done"].alias("done"), longer.alias("open"), F.lit(True).alias("some"))
        fresh = _let(opened(F.concat(header, F.coalesce(unit["fresh"], F.lit("")))), begun)
        return F.when(room(longer) < most, said).when(unit["fresh"].isNull(), s).otherwise(fresh)

    start = F.struct(no_messages.alias("done"), header.alias("open"), F.lit(False).alias("some"))
    return F.aggregate(units, start, add, lambda s: F.when(s["some"], F.concat(s["done"], closed(s["open"]))).otherwise(s["done"]))


def numbered_reply(reply: Column, expected: Column) -> Column:
    """The texts of a reply of ``[n] text`` entries in the order of n, ``expected`` of them.

    An entry goes on over the lines up to the next number. If the count is wrong, every line
    that is not blank is an entry; the rest is filled with empty texts."""
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    mark = r"^\s*\[\s*([+-]?\d+)\s*\]"
    blocks = F.filter(F.split(trim(reply), r"\n(?=[^\S\n]*\[\s*[+-]?\d+\s*\])"), lambda b: b.rlike(mark))
    entries = F.transform(
        blocks, lambda b, i: F.struct(F.regexp_extract(b, mark, 1).try_cast("int").alias("n"), i.alias("i"), trim(F.regexp_replace(b, mark, "")).alias("t"))
    )
    texts = F.transform(F.array_sort(entries), lambda e: e["t"])
    plain = F.transform(F.filter(F.split(reply, "\n"), lambda x: trim(x) != ""), lambda x: trim(F.regexp_replace(trim(x), r"^\[[^\]]*\]", "")))
    found = F.when(F.size(texts) == expected, texts).otherwise(plain)
    return F.slice(F.concat(found, F.array_repeat(F.lit(""), expected)), F.lit(1), expected)


def version_parts(version: Column) -> Column:
    """The first three numbers of a version; zeros if it has fewer or others."""
    parts = F.transform(F.slice(F.split(F.trim(version), r"\."), 1, 3), lambda p: p.try_cast("int"))
    good = (F.size(parts) == 3) & F.forall(parts, lambda p: p.isNotNull())
    return F.when(good, parts).otherwise(F.array(F.lit(0), F.lit(0), F.lit(0)))


def version_state(own: Column, other: Column) -> Column:
    a, b = version_parts(own), version_parts(other)
    return F.when(a < b, "behind").when(a > b, "ahead").otherwise("same")
