"""Table functions for SQL, registered under names: ``SELECT ... FROM docs, LATERAL text_chunks(text, 1000, 100)``.

Each row's call is independent, so a query spreads over partitions as its table does. ``event_sessions`` takes a table, which Spark partitions and sorts as the
function asks for (``analyze``), and holds one session at a time. Nulls give no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.types import LongType, StructField, StructType, TimestampType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from lodestone.functions import lexer
from lodestone.functions.versions import BREAKING_PATTERNS, DEPRECATION_PATTERNS, FEATURE_PATTERNS, SYNTAX_PATTERNS

CHANGES = (("feature", FEATURE_PATTERNS), ("breaking", BREAKING_PATTERNS), ("deprecation", DEPRECATION_PATTERNS), ("syntax", SYNTAX_PATTERNS))
_REQUIREMENT = re.compile(r"^\s*([A-Za-z0-9][A-Za-z0-9._-]*)\s*(?:\[[^\]]*\])?\s*(?:(==|~=|>=|<=|!=|>|<)\s*([^\s;,#]+))?")


class TextChunks:
    """chunk_index, chunk: windows of ``size`` characters, each ``overlap`` into the one before; the last ends the text."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple]:
        if text is None or size is None or size < 1:
            return
        step, at, k = max(1, size - max(0, overlap or 0)), 0, 0
        while k == 0 or at + (size - step) < len(text):
            if text:
                yield k, text[at : at + size]
            at, k = at + step, k + 1


class PageLinks:
    """pos, url, text of the links of a page with a target other than a fragment, in order; relative ones are resolved against ``base``."""

    def eval(self, html: str, base: str) -> Iterator[tuple]:
        from urllib.parse import urljoin

        from lodestone.functions.html import parse

        if html is None:
            return
        for k, node in enumerate(parse(html).select("a[href]")):
            target = node.attributes["href"]
            if target and not target.startswith(("#", "javascript:", "mailto:")):
                try:
                    yield k, urljoin(base or "", target), node.text()
                except ValueError:
                    continue


class NoteChanges:
    """kind, change: what the lines of release notes add, break, deprecate or change in syntax."""

    _FIND = [(kind, re.compile(p, re.MULTILINE)) for kind, patterns in CHANGES for p in patterns]

    def eval(self, body: str) -> Iterator[tuple]:
        for kind, pattern in self._FIND if body else ():
            for m in pattern.finditer(body):
                found = (m.group(1) if pattern.groups else m.group(0)).strip(" ")
                if len(found.encode()) > 5:
                    yield kind, found


class Requirements:
    """name, operator, version of the lines of a requirements file; comments, options and what is no requirement are left out."""

    def eval(self, content: str) -> Iterator[tuple]:
        for line in (content or "").splitlines():
            if not line.strip().startswith(("#", "-")) and (m := _REQUIREMENT.match(line)):
                yield m[1], m[2], m[3]


class CodeSpans:
    """first, last: the characters (from 0, the last one left out) that strings and comments hold."""

    def eval(self, code: str, language: str) -> Iterator[tuple]:
        if code is not None and language is not None:
            yield from lexer.spans(code, language.lower())


class EventSessions:
    """The partition's key, started, ended, n of runs of events of which none is more than ``gap`` seconds after the one before.

    ``event_sessions(TABLE(SELECT key, ts FROM ...), gap)``: the table's first column is the key, its second the time. Spark partitions by the one and sorts by the other; one session is held.
    """

    @staticmethod
    def analyze(events: AnalyzeArgument, gap: AnalyzeArgument) -> AnalyzeResult:
        if not events.isTable or len(events.dataType.fields) < 2:
            raise ValueError("event_sessions asks for a table of a key and a time")
        key, ts = events.dataType.fields[:2]
        schema = StructType([StructField(key.name, key.dataType), StructField("started", TimestampType()), StructField("ended", TimestampType()), StructField("n", LongType())])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(f"`{key.name}`")], orderBy=[OrderingColumn(f"`{ts.name}`")])

    def __init__(self):
        self.key = self.started = self.ended = None
        self.n = 0

    def eval(self, row, gap: int) -> Iterator[tuple]:
        at = row[1]
        if at is None:
            return
        if self.n and (at - self.ended).total_seconds() > gap:
            yield self.key, self.started, self.ended, self.n
            self.n = 0
        if not self.n:
            self.key, self.started = row[0], at
        self.ended, self.n = at, self.n + 1

    def terminate(self) -> Iterator[tuple]:
        if self.n:
            yield self.key, self.started, self.ended, self.n


#: SQL name, class, result (None: ``analyze`` says).
FUNCTIONS = (
    ("text_chunks", TextChunks, "chunk_index int, chunk string"),
    ("page_links", PageLinks, "pos int, url string, text string"),
    ("note_changes", NoteChanges, "kind string, change string"),
    ("requirement_lines", Requirements, "name string, operator string, version string"),
    ("code_spans", CodeSpans, "first int, last int"),
    ("event_sessions", EventSessions, None),
)


def register(spark: SparkSession) -> None:
    """Name all of them in a session."""
    from pyspark.sql.functions import udtf

    from lodestone.runtime import ship_package

    ship_package(spark)
    for name, kind, result in FUNCTIONS:
        spark.udtf.register(name, udtf(kind, returnType=result) if result else udtf(kind))
