"""URL filters by a sort-merge range join of reversed-host keys with nested rule intervals.

The key of a host is its labels in reverse order, each followed by a slash, which no host holds; the keys of a host's
subdomains are the interval of keys that start with its own. Rules and URLs are one table, range-partitioned
and sorted by key, a rule before the URLs of its key; a sweep keeps a stack of the rule hosts whose
intervals are open, which are nested. Rules that are open where a range starts are those whose key begins
the range's first key; they are sent to that range by a join, so that any number of rules goes the same way. At each URL the stack's
rules whose path the URL's path starts with fit; the longest (host and path together, then the longer host) wins.

Defined results: null URLs and URLs without ``://`` have empty host and path; a rule with an empty host fits every URL whose path
it begins, one whose host holds ``/``, ``?`` or ``#`` fits none; where no rule fits the
rule is null and the verdict is ``default``; repeated rules count once, of equal rules that differ in
verdict ``block`` wins; an empty rule table fits nothing; repeated pages are judged each. A task holds the rules of the open hosts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.runtime import materialize, ship_package

_UPPER, _SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host(url: Column) -> Column:
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, _UPPER, _SMALL), F.lit(""))


def path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def key(name: Column) -> Column:
    """Labels in reverse order, each with a slash after it; empty for an empty host."""
    return F.when(name == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(name, r"\.")), "/"), F.lit("/")))


class Open:
    """The rules of one open host: path -> (rule, verdict), and the paths' lengths, longest first."""

    def __init__(self, own_key: str):
        self.key, self.rules, self.lengths = own_key, {}, []

    def add(self, head: str, rule: str, verdict: str) -> None:
        if len(head) not in self.lengths:
            self.lengths = sorted([*self.lengths, len(head)], reverse=True)
        if head not in self.rules or verdict == "block":
            self.rules[head] = rule, verdict

    def best(self, own: str) -> tuple[str, str] | None:
        return next((found for n in self.lengths if n <= len(own) and (found := self.rules.get(own[:n]))), None)


def _sweep(batches: Iterator[pa.RecordBatch], default: str) -> Iterator[pa.RecordBatch]:
    """Over rows of (range, key, head, verdict, path, id, host), sorted by range, key and rules first (``head`` is not null)."""
    stack: list[Open] = []
    part = None
    for batch in batches:
        keep, rules, verdicts = [], [], []
        columns = [batch.column(k).to_pylist() for k in (0, 1, 2, 3, 4, 6)]
        for k, (own_part, now, head, verdict, own, name) in enumerate(zip(*columns, strict=True)):
            if own_part != part:
                part, stack = own_part, []
            while stack and not now.startswith(stack[-1].key):
                stack.pop()
            if head is not None:
                if not stack or stack[-1].key != now:
                    stack.append(Open(now))
                stack[-1].add(head, name + head, verdict)
                continue
            found = [(len(rule), len(at.key), rule, how) for at in stack if (hit := at.best(own)) for rule, how in (hit,)]
            best = max(found) if found else (0, 0, None, default)
            keep.append(k)
            rules.append(best[2])
            verdicts.append(best[3])
        some = batch.take(pa.array(keep, pa.int64()))
        yield pa.RecordBatch.from_arrays([some.column(5), some.column(6), some.column(4), pa.array(rules, pa.string()), pa.array(verdicts, pa.string())], names=["__id", "host", "path", "rule", "verdict"])


def _ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the number of the range, which is the partition's."""
    from pyspark import TaskContext

    k = TaskContext.get().partitionId()
    for batch in batches:
        yield pa.RecordBatch.from_arrays([pa.array([k] * batch.num_rows, pa.int32()), *batch.columns], names=["__range", *batch.schema.names])


def judge(pages: DataFrame, rules: DataFrame, *, id_column: str = "page_id", default: str = "allow") -> DataFrame:
    """id, host, path, rule, verdict. ``rules``: host, path, verdict strings, any number of them."""
    spark = pages.sparkSession
    ship_package(spark)
    kind = dict(pages.dtypes)[id_column]
    fits = rules.where("host is not null and path is not null and verdict is not null and host not rlike '[/?#]'").select("host", "path", "verdict").distinct()
    rule_rows = fits.select(key(F.col("host")).alias("key"), F.col("path").alias("head"), "verdict", F.lit(None).cast("string").alias("path"), F.lit(None).cast(kind).alias("id"), "host")
    urls = pages.select(F.col(id_column).alias("id"), host(F.col("url")).alias("host"), path(F.col("url")).alias("path"))
    none = F.lit(None).cast("string")
    url_rows = urls.select(key(F.col("host")).alias("key"), none.alias("head"), none.alias("verdict"), "path", "id", "host")
    # ranges are dealt by key, path and id, so that a hot key is split; rules come first in theirs
    order = "key", F.col("head").isNull(), "path", "id"
    schema = f"key string, head string, verdict string, path string, id {kind}, host string"
    dealt = rule_rows.unionByName(url_rows).repartitionByRange(*order).mapInArrow(_ranges, f"__range int, {schema}")
    dealt = materialize(dealt, "url-ranges")
    # the rules that begin a range's first key but lie in a range before it
    firsts = dealt.groupBy("__range").agg(F.min("key").alias("first"))
    labels = F.split("first", "/")
    heads = F.transform(F.sequence(F.lit(0), F.size(labels) - 1), lambda n: F.when(n == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(labels, 1, n), "/"), F.lit("/"))))
    opened = firsts.select("__range", F.explode(heads).alias("key"))
    held = dealt.where("head is not null")
    carried = opened.join(held.withColumnRenamed("__range", "__own"), "key").where("__own < __range").drop("__own")
    rows = dealt.unionByName(carried).repartition("__range").sortWithinPartitions("__range", "key", F.col("head").isNull())
    out = rows.select("__range", "key", "head", "verdict", "path", "id", "host").mapInArrow(lambda it: _sweep(it, default), f"__id {kind}, host string, path string, rule string, verdict string")
    return out.withColumnRenamed("__id", id_column)
