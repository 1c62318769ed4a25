"""Main content of a page by text density: the run of neighbouring blocks with the greatest sum.

Block-level tags cut a page into blocks. A block is worth the characters of its text, less twice those that are link text, less a fixed cost, so
paragraphs add and menus, buttons and footers take away; the best run keeps short lines between paragraphs and leaves out what surrounds them. The
run is found in one pass over the block's worths (a maximum-sum run), all in column expressions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: what is never content, and what parts blocks
NO_CONTENT = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<!--.*?-->"
BLOCK_TAGS = (
    r"(?is)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul)\b[^>]*>"
)
COST, LINK = 25, 2


def blocks(html: Column) -> Column:
    """array<struct<text, linked>>: each block's text, white space collapsed, and how many characters of it are link text."""
    plain = lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "<[^>]*>", " "), r"\s+", " "))
    parts = F.split(F.regexp_replace(html, NO_CONTENT, " "), BLOCK_TAGS)
    links = lambda x: F.aggregate(F.regexp_extract_all(x, F.lit(r"(?is)<a\b[^>]*>(.*?)</a\s*>"), F.lit(1)), F.lit(0), lambda n, a: n + F.length(plain(a)))
    return F.transform(parts, lambda x: F.struct(plain(x).alias("text"), links(x).alias("linked")))


def worth(block: Column) -> Column:
    return F.length(block["text"]) - LINK * block["linked"] - COST


def best_run(worths: Column) -> Column:
    """struct<first, last, sum>: the run (from 0) with the greatest sum, of equal ones that which ends first and is shortest; null where no sum is above zero."""
    state = lambda at, now, since, best, first, last: F.struct(at.alias("at"), now.alias("now"), since.alias("since"), best.alias("best"), first.alias("first"), last.alias("last"))

    def step(s: Column, x: Column) -> Column:
        anew = s["now"] <= 0
        now = F.when(anew, x).otherwise(s["now"] + x).cast("long")
        since = F.when(anew, s["at"]).otherwise(s["since"])
        better = now > s["best"]
        return state(s["at"] + 1, now, since, F.greatest(now, s["best"]), F.when(better, since).otherwise(s["first"]), F.when(better, s["at"]).otherwise(s["last"]))

    none, zero = F.lit(-1), F.lit(0).cast("long")
    found = F.aggregate(worths, state(F.lit(0), zero, F.lit(0), zero, none, none), step)
    return _let(found, lambda s: F.when(s["last"] >= 0, F.struct(s["first"].alias("first"), s["last"].alias("last"), s["best"].alias("sum"))))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often it is named there."""
    return F.get(F.transform(F.array(value), use), 0)


def main_content(html: Column) -> Column:
    """struct<first, last, sum, text>: the run's blocks and their texts, one a line; null without one."""

    def found(own: Column, run: Column) -> Column:
        text = F.array_join(F.filter(F.transform(F.slice(own, run["first"] + 1, run["last"] - run["first"] + 1), lambda b: b["text"]), lambda t: t != ""), "\n")
        return F.when(run.isNotNull(), F.struct(run["first"].alias("first"), run["last"].alias("last"), run["sum"].alias("sum"), text.alias("text")))

    return _let(blocks(html), lambda own: _let(best_run(F.transform(own, worth)), lambda run: found(own, run)))
