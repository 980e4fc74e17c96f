"""String expressions: tokens, URLs, markup, truncation. All are built-in functions."""

from __future__ import annotations

import difflib
import json
from functools import reduce
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: Words that carry no topic.
STOP_WORDS = (
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会", "着", "没有",
    "看", "好", "自己", "这",
)
#: Words that are no topic of a headline.
TOPIC_STOP_WORDS = (
    *STOP_WORDS,
    "那", "来", "被", "与", "为", "对", "将", "从", "以", "及", "等", "但", "或", "而", "于", "中", "由", "可", "可以", "已", "已经", "还", "更", "最", "再",
    "因为", "所以", "如果", "虽然", "然而", "什么", "怎么", "如何", "哪", "哪些", "多少", "几", "这个", "那个", "他", "她", "它", "他们", "她们", "我们",
    "你们", "大家", "这样", "那样", "怎样", "这么", "那么", "多么", "非常", "特别", "应该", "可能", "能够", "需要", "必须", "一定", "肯定", "确实", "正在",
    "曾经", "将要", "即将", "刚刚", "马上", "立刻", "回应", "发布", "表示", "称", "曝", "官方", "最新", "重磅", "突发", "热搜", "刷屏", "引发", "关注",
    "网友", "评论", "转发", "点赞",
)
#: URL parameters that only track, for every source and for one source (in lower case).
TRACKING = (
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "ref", "referrer", "source", "channel", "_t", "timestamp", "_", "random",
    "share_token", "share_id", "share_from",
)
TRACKING_OF = {"weibo": ("band_rank", "refer", "t")}
#: The characters that must be escaped, in order.
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;"))


def contains(text: Column, query: str) -> Column:
    """Substring, letters in either case."""
    return F.contains(F.lower(text), F.lit(query.lower()))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def without_urls(text: Column) -> Column:
    return F.regexp_replace(text, r"https?://\S+", "")


def tokens(text: Column, least: int = 2, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Words of ``least`` characters and more as they are written, without stop words."""
    words = F.split(F.regexp_replace(without_urls(text), r"(?U)[^\w]+", " "), " ")
    return F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(list(stop)))


def word_tokens(text: Column) -> Column:
    """All words of two characters and more, bracketed notes left out."""
    return F.filter(F.regexp_extract_all(F.lower(F.regexp_replace(without_urls(text), r"\[[^\]]*\]", "")), F.lit(r"(?U)\w+"), 0), lambda w: F.length(w) >= 2)


def topic_tokens(text: Column) -> Column:
    """Runs of two or more CJK characters, and Latin words; bracketed notes and quotation marks go, and stop words."""
    plain = F.translate(F.regexp_replace(without_urls(text), r"\[.*?\]", ""), "【】《》「」『』·・•", "")
    words = F.regexp_extract_all(plain, F.lit(r"[一-鿿]{2,}|[a-zA-Z]{2,}[a-zA-Z0-9]*"), 0)
    return F.filter(words, lambda w: ~w.isin(list(TOPIC_STOP_WORDS)))


#: What begins like a character reference, as HTML 5 reads text.
REFERENCE = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
#: The longest name that is read without its semicolon.
LEGACY = max(len(name) for name in html5 if not name.endswith(";"))


def _names() -> Column:
    """The names of HTML 5 by their first letter and then whole, as one constant."""
    by_letter: dict[str, dict[str, str]] = {}
    for name, value in html5.items():
        by_letter.setdefault(name[0], {})[name] = value
    return F.from_json(F.lit(json.dumps(by_letter)), "map<string, map<string, string>>")


def _named(name: Column) -> Column:
    return F.try_element_at(F.try_element_at(_names(), F.left(name, F.lit(1))), name)


def _character(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _numbered(reference: Column) -> Column:
    """The character of a numeric reference: C1 controls are Windows-1252, what can't be a character is U+FFFD, other controls and noncharacters vanish."""
    digits = F.regexp_replace(F.regexp_extract(reference, "^&#[xX]?([0-9a-fA-F]+)", 1), "^0+", "")
    hexadecimal = reference.rlike("^&#[xX]")
    number = F.when(F.length(digits) > 7, 0x110000).when(digits == "", 0).otherwise(F.when(hexadecimal, F.conv(digits, 16, 10)).otherwise(F.conv(digits, 10, 10)).cast("int"))
    windows = F.array(*(F.lit(bytes([b]).decode("cp1252", "ignore") or chr(b)) for b in range(0x80, 0xA0)))
    none = number.between(1, 8) | (number == 0xB) | number.between(0xE, 0x1F) | (number == 0x7F) | number.between(0xFDD0, 0xFDEF) | (number.bitwiseAND(0xFFFE) == 0xFFFE)
    return (
        F.when((number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF), "\ufffd")
        .when(number.between(0x80, 0x9F), F.get(windows, number - 0x80))
        .when(none, "")
        .otherwise(_character(F.when((number > 0) & (number <= 0x10FFFF), number)))
    )


def _decoded(reference: Column) -> Column:
    name = F.substring(reference, F.lit(2), F.length(reference))
    tries = [_named(name)]
    for n in range(LEGACY, 1, -1):  # a name without its semicolon may go on as text
        tries.append(F.when(F.length(name) > n, F.concat(_named(F.left(name, F.lit(n))), F.substring(name, F.lit(n + 1), F.length(name)))))
    return F.when(reference.startswith("&#"), _numbered(reference)).otherwise(F.coalesce(*tries, reference))


def references_decoded(text: Column) -> Column:
    """All character references decoded, from left to right and once: what a decoded reference yields is text."""
    pieces = F.split(text, REFERENCE)
    found = F.transform(F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)), _decoded)
    joined = F.array_join(F.zip_with(pieces, F.array_append(found, F.lit("")), lambda a, b: F.concat(a, b)), "")
    return F.when(text.contains("&"), joined).otherwise(text)


def plain_html(html: Column, references: tuple[tuple[str, str], ...] = ()) -> Column:
    """Character references decoded (all that HTML 5 knows, or the given ones only, one after the other), tags dropped, white space collapsed."""
    decoded = reduce(lambda t, r: F.replace(t, F.lit(r[0]), F.lit(r[1])), references, html) if references else references_decoded(html)
    return collapse(F.regexp_replace(decoded, "<[^>]+>", ""))


def escape_html(text: Column) -> Column:
    return reduce(lambda t, e: F.replace(t, F.lit(e[0]), F.lit(e[1])), ESCAPES, text)


def shorten(text: Column, n: int) -> Column:
    return F.when(F.length(text) > n, F.concat(F.left(text, F.lit(n)), F.lit("..."))).otherwise(text)


def normal_url(url: Column, source: str | None = None) -> Column:
    """Tracking parameters dropped and the rest sorted; a URL without a query stays as it is."""
    drop = [*TRACKING, *TRACKING_OF.get(source or "", ())]
    bare = F.regexp_replace(url, "#.*$", "")
    base, query = F.substring_index(bare, "?", 1), F.regexp_replace(bare, r"^[^?]*\?", "")
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(F.substring_index(p, "=", 1)).isin(drop)))
    cleaned = F.when(F.size(kept) > 0, F.concat(base, F.lit("?"), F.array_join(kept, "&"))).otherwise(base)
    return F.when(bare.contains("?"), cleaned).otherwise(url)


def jaccard(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity, which no built-in function has; not symmetric."""
    return pd.Series([difflib.SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)], dtype="float64")


def ratio_bound(a: Column, b: Column) -> Column:
    """An upper bound of ``sequence_ratio`` from lengths alone."""
    return F.coalesce(F.try_divide(2 * F.least(F.length(a), F.length(b)), F.length(a) + F.length(b)), F.lit(1.0))


def bag_bound(a: Column, b: Column) -> Column:
    """A closer upper bound of ``sequence_ratio``: characters that both have, each as often as both have it."""
    times = lambda text, c: F.length(text) - F.length(F.replace(text, c, F.lit("")))
    known = F.array_intersect(F.split(a, ""), F.split(b, ""))
    both = F.aggregate(known, F.lit(0), lambda n, c: n + F.when(c == "", 0).otherwise(F.least(times(a, c), times(b, c))))
    return F.coalesce(F.try_divide(2 * both, F.length(a) + F.length(b)), F.lit(1.0))
