"""WARC archives with a two-level capture index.

Records: one gzip member each. Of the records with equal payloads of at least ``min_revisit`` bytes the
one with the largest page_id is the response and the others are revisits that refer to it.

Index: captures are sorted by the reversed-host key of their URL and dealt into ranges, one index file
each. A file holds compressed blocks of up to ``block_rows`` captures; its sparse directory has each
block's first key, offset and length. A look-up finds the file by the ranges' first keys, the block by
binary search in the file's directory, and reads the block and then the record by byte range.

Files go to a folder that all executors share, through pyarrow's file systems. A task writes under a name of its
own attempt and only names of successful tasks reach the tables of captures and directories, so retried
and lost tasks leave nothing that is read.

Defined results: null html is an empty payload; URLs without ``://`` have a key of their text,
null ones one of their own; equal URLs are all captured, in page_id order; an empty table makes an archive without records;
pages without page_id are not written; rows that repeat a page_id and payload are each a record, both responses or both revisits;
unequal payloads under one page_id are judged each by its own.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm import urlfilter
from lodestone.runtime import materialize, scratch_path, ship_package

MIN_REVISIT = 0
BLOCK_ROWS = 1000
HOT_SHARE = 1000
LEVEL = 1
GAP = 1 << 16
REQUEST = 8 << 20
FOUND_ROWS = 10_000
DATE = "2024-01-01T00:00:00Z"  # pages carry no time of capture


def _file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def capture_key(url: Column) -> Column:
    """Reversed host, a bracket, then what follows the host; other texts come after a question mark, which no host holds, null as a number sign."""
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    return F.coalesce(F.when(url.contains("://"), F.concat(urlfilter.key(urlfilter.host(url)), F.lit(")"), rest)).otherwise(F.concat(F.lit("?"), url)), F.lit("#"))


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 of SHA-1: five hex digits are four base32 digits."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, k * 5 + 1, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record(page_id: int, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    block = payload if refers_to is None else b""
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:page:{page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    n = int(fields["Content-Length"])
    if rest[n:] != b"\r\n\r\n":
        raise ValueError("a WARC record of the wrong length")
    return fields, rest[:n]


def _gzip(raw: bytes) -> bytes:
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


@dataclass
class Archive:
    folder: str
    captures: DataFrame  # key, page_id, file, offset, length
    roots: list[tuple[str, str]]  # of each index file, one for a shuffle partition: first key, name


def decide(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, digest, n, refers_to of the revisits only. Digests are pre-aggregated in each task. The few that each have more than a
    HOT_SHARE of all records meet their rows by a broadcast, so that one empty or common payload is no single task's."""
    seen = pages.select("page_id", F.octet_length("payload").alias("n"), payload_digest(F.col("payload")).alias("digest")).where(F.col("n") >= min_revisit)
    seen = materialize(seen, "digests")
    kept = seen.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("copies")).where("copies > 1")
    kept = materialize(kept, "payloads")
    least = seen.count() / HOT_SHARE
    hot = F.broadcast(kept.where(F.col("copies") > least).drop("copies"))  # fewer than HOT_SHARE rows
    rest = seen.join(hot, ["digest", "n"], "left_anti").join(kept.where(F.col("copies") <= least).drop("copies"), ["digest", "n"])
    found = seen.join(hot, ["digest", "n"]).unionByName(rest)
    return found.where("page_id <> refers_to").select("page_id", "digest", "n", "refers_to").distinct()


def write(pages: DataFrame, folder: str | None = None, *, min_revisit: int = MIN_REVISIT, block_rows: int = BLOCK_ROWS) -> Archive:
    """Write the records of ``pages`` (page_id, url, html) and their index under ``folder``."""
    spark = pages.sparkSession
    ship_package(spark)
    folder = folder or scratch_path(spark, "warc")
    rows = pages.where("page_id is not null").select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload"))
    revisits = materialize(decide(rows, min_revisit), "revisits")
    keyed = rows.select("page_id", "url", capture_key(F.col("url")).alias("key"), payload_digest(F.col("payload")).alias("digest"), F.octet_length("payload").alias("n"), "payload")
    made = keyed.join(revisits, ["page_id", "digest", "n"], "left").select("page_id", "url", "key", "digest", "refers_to", "payload")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _file_system(folder)
        name, out, offset = f"{path}/data-{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in batches:
                if out is None:
                    system.create_dir(path, recursive=True)
                    out = system.open_output_stream(name, compression=None)
                offsets, lengths = [], []
                for at in range(0, batch.num_rows, 256):
                    for r in batch.slice(at, 256).to_pylist():
                        raw = _gzip(record(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"]))
                        out.write(raw)
                        offsets.append(offset)
                        lengths.append(len(raw))
                        offset += len(raw)
                n = len(offsets)
                yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(0), pa.array([name.rsplit("/", 1)[1]] * n), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], names=["key", "page_id", "file", "offset", "length"])
        finally:
            if out is not None:
                out.close()

    captures = materialize(made.mapInArrow(records, "key string, page_id long, file string, offset long, length long"), "captures")

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _file_system(folder)
        stem, out, at, waiting, made_rows = f"index-{uuid.uuid4().hex}", None, 0, [], []

        def flush(some: list[dict]) -> None:
            nonlocal at
            raw = zlib.compress("\n".join(json.dumps([r["key"], r["page_id"], r["file"], r["offset"], r["length"]]) for r in some).encode(), 6)
            out.write(raw)
            made_rows.append([some[0]["key"], at, len(raw), len(some)])
            at += len(raw)

        for batch in batches:
            if out is None and batch.num_rows:
                system.create_dir(path, recursive=True)
                out = system.open_output_stream(f"{path}/{stem}.blocks", compression=None)
            waiting += batch.to_pylist()
            while len(waiting) >= block_rows:
                flush(waiting[:block_rows])
                del waiting[:block_rows]
        if waiting:
            flush(waiting)
        if out is not None:
            out.close()
            with system.open_output_stream(f"{path}/{stem}.directory", compression=None) as d:
                d.write(json.dumps(made_rows).encode())
            yield pa.RecordBatch.from_arrays([pa.array([made_rows[0][0]]), pa.array([stem]), pa.array([len(made_rows)], pa.int64())], names=["first_key", "stem", "blocks"])

    ordered = captures.repartitionByRange("key", "page_id").sortWithinPartitions("key", "page_id")
    files = materialize(ordered.mapInArrow(blocks, "first_key string, stem string, blocks long"), "index-files")
    return Archive(folder, captures, sorted((r["first_key"], r["stem"]) for r in files.collect()))


class Directory:
    """Look-ups in one archive's index from a task: keeps the latest directory and block."""

    def __init__(self, folder: str, roots: list[tuple[str, str]]):
        self.system, self.path = _file_system(folder)
        self.firsts, self.stems = [k for k, _ in roots], [s for _, s in roots]
        self.stem, self.rows, self.blocks = None, [], {}

    def _open(self, stem: str) -> list:
        if stem != self.stem:
            with self.system.open_input_file(f"{self.path}/{stem}.directory") as f:
                self.rows = json.loads(f.read())
            self.stem, self.blocks = stem, {}
        return self.rows

    def _block(self, stem: str, k: int) -> list:
        if k not in self.blocks:
            _, at, size, _ = self.rows[k]
            with self.system.open_input_file(f"{self.path}/{stem}.blocks") as f:
                f.seek(at)
                raw = zlib.decompress(f.read(size))
            self.blocks = {k: [json.loads(line) for line in raw.decode().split("\n")]}
        return self.blocks[k]

    def find(self, part: int, key: str) -> Iterator[tuple[int, str, int, int]]:
        """(page_id, file, offset, length) of the captures with this key in an index file."""
        rows = self._open(self.stems[part])
        firsts = [r[0] for r in rows]
        for k in range(max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key)):
            lines = self._block(self.stems[part], k)
            at = bisect_left(lines, [key])
            while at < len(lines) and lines[at][0] == key:
                yield tuple(lines[at][1:])
                at += 1


def look_up(archive: Archive, urls: DataFrame) -> DataFrame:
    """page_id, file, offset, length of all captures of the distinct ``url`` values.

    Each key is sent once for each index file that may hold it, so a hot key's captures are listed by as many tasks as files
    they fill, in bounded batches. Look-ups are sorted by file and key, so each task goes through few directories and blocks, in order.
    """
    spark, folder = urls.sparkSession, archive.folder
    ship_package(spark)
    sent = spark.sparkContext.broadcast(archive.roots)

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = [k for k, _ in sent.value]
        for batch in batches:
            keys = batch.column(0).to_pylist()
            spans = [range(max(0, bisect_left(firsts, key) - 1), bisect_right(firsts, key)) for key in keys]
            yield pa.RecordBatch.from_arrays([pa.array([k for s in spans for k in s], pa.int32()), pa.array([key for key, s in zip(keys, spans, strict=True) for _ in s], pa.string())], names=["part", "key"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Directory(folder, sent.value)
        for batch in batches:
            found = (x for part, key in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for x in index.find(part, key))
            while some := list(islice(found, FOUND_ROWS)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["page_id", "file", "offset", "length"])

    keys = urls.select(capture_key(F.col("url")).alias("key")).distinct().mapInArrow(places, "part int, key string")
    return keys.repartitionByRange("part", "key").sortWithinPartitions("part", "key").mapInArrow(run, "page_id long, file string, offset long, length long")


def read(archive: Archive, places: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url of the records at ``places``.

    Places are sorted by file and offset, so that near ranges are read in one request. The payload of a
    response is checked against its digest.
    """
    folder = archive.folder
    ship_package(places.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = _file_system(folder)
        name, source = None, None
        for batch in batches:
            rows = batch.to_pylist()
            out: list[tuple] = []
            k = 0
            while k < len(rows):
                last, end = k, rows[k]["offset"] + rows[k]["length"]
                while last + 1 < len(rows) and (r := rows[last + 1])["file"] == rows[k]["file"] and 0 <= r["offset"] - end <= GAP and r["offset"] + r["length"] - rows[k]["offset"] <= REQUEST:
                    last, end = last + 1, r["offset"] + r["length"]
                if rows[k]["file"] != name:
                    if source is not None:
                        source.close()
                    name, source = rows[k]["file"], system.open_input_file(f"{path}/{rows[k]['file']}")
                source.seek(rows[k]["offset"])
                start, raw = rows[k]["offset"], memoryview(source.read(end - rows[k]["offset"]))
                for r in rows[k : last + 1]:
                    fields, body = parse_record(zlib.decompress(raw[r["offset"] - start : r["offset"] - start + r["length"]], 31))
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    kind, refers = fields["WARC-Type"], fields.get("WARC-Refers-To")
                    if kind == "response" and base64.b32encode(hashlib.sha1(body).digest()).decode() != digest:
                        raise ValueError(f"record {fields['WARC-Record-ID']} does not match its digest")
                    page = int(fields["WARC-Record-ID"][10:-1])
                    if page != r["page_id"]:
                        raise ValueError("the index names another record")
                    out.append((page, int(fields["WARC-Payload-Length"]), digest, kind, int(refers[10:-1]) if refers else None, fields.get("WARC-Target-URI")))
                k = last + 1
            cols = list(zip(*out, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"])
        if source is not None:
            source.close()

    ordered = places.repartitionByRange("file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string")
