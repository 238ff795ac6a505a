"""WARC archives: written and read back with Spark, and indexed by an external merge.

Records are text, so Spark's text sink writes them: a row is a record without its final blank line,
the line separator is that blank line, and every part file is a WARC 1.1 file (gzip as a whole).
Reading back takes whole files and parses them by Content-Length. A task writes at most
``RECORDS_PER_FILE`` records to a file, which bounds what a reading task holds.

The capture index (URL key, timestamp, record id, place, digest) is built by an external merge. Each
archive file's entries form a locally sorted run; a range exchange on (key, timestamp, id) sends
slices of the runs to one task for each range, and there a loser tree merges the k slices. The ranges are in
order, so the whole index is; a URL captured very often is split between ranges like any other.

Edge cases: a null or empty html is an empty payload; a null url becomes ``urn:page:<id>``; control
characters in a url are percent-encoded; payloads under ``LEAST`` bytes are always responses; of rows
with equal payloads and equal page_id all are responses if theirs is the largest; an empty table
gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import gzip
import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import common

LEAST = 1000
RECORDS_PER_FILE = 2000
#: Seconds from 1970 to the end of 9999.
YEARS = 253_402_300_800

#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END = "\r\n\r\n"


def payloads(pages: DataFrame, key: str, url: str, html: str) -> DataFrame:
    safe = F.coalesce(F.col(url), F.concat(F.lit("urn:page:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))
    for code in (0x0D, 0x0A, 0x00, 0x09, 0x20):
        safe = F.replace(safe, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    body = F.coalesce(F.col(html), F.lit(""))
    return pages.select(F.col(key).alias("page_id"), safe.alias("url"), body.alias("html"), F.octet_length(body).cast("long").alias("payload_bytes"), F.sha1(body.cast("binary")).alias("digest"))


def with_references(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """Adds refers_to: the page that holds the same payload, null for responses.

    Digests are counted map-side; only ids meet the groups, and the payloads meet only those ids
    that are revisits, so a payload that very many pages share moves as ids.
    """
    ids = rows.where(F.col("payload_bytes") >= least).select("page_id", "digest", "payload_bytes")
    groups = ids.groupBy("digest", "payload_bytes").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = ids.join(groups, ["digest", "payload_bytes"]).where("page_id < refers_to").select("page_id", "digest", "refers_to").distinct()
    return rows.join(revisits, ["page_id", "digest"], "left")


def records(rows: DataFrame) -> DataFrame:
    """One column ``value``: each row's WARC record, without its final blank line."""
    # pages carry no time: the id stands in, within the years 1970 to 9999 that a date of four digits can tell
    when = F.date_format(F.timestamp_seconds(F.pmod(F.coalesce(F.col("page_id"), F.lit(0)).cast("long"), F.lit(YEARS))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(END))
    revisit = F.col("refers_to").isNotNull()
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("html")))
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    head = F.concat_ws(
        "\r\n",
        F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), name(F.col("page_id"))),
        F.concat(F.lit("WARC-Date: "), when),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), name(F.col("refers_to")))),
        F.when(revisit, F.lit(f"WARC-Profile: {REVISIT_PROFILE}")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string")),
    )
    return rows.select(F.concat(head, F.lit(END), block).alias("value"))


def write(pages: DataFrame, path: str, *, key: str = "page_id", url: str = "url", html: str = "html", records_per_file: int = RECORDS_PER_FILE) -> None:
    """WARC files under ``path``, one record a page."""
    rows = records(with_references(payloads(pages, key, url, html)))
    rows.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


@dataclass
class Record:
    offset: int
    length: int
    headers: dict[str, str]
    payload: bytes


def parse(data: bytes) -> Iterator[Record]:
    """The records of a WARC file's bytes, by Content-Length."""
    at = 0
    while at < len(data):
        head_end = data.index(b"\r\n\r\n", at)
        lines = data[at:head_end].decode().split("\r\n")
        if lines[0] != VERSION:
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(x.split(": ", 1) for x in lines[1:])
        begin = head_end + 4
        end = begin + int(headers["Content-Length"])
        block = data[begin:end]
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"record at byte {at} has no end")
        http, _, payload = block.partition(b"\r\n\r\n")
        headers |= {f"http:{k.lower()}": v for k, v in (x.split(": ", 1) for x in http.decode().split("\r\n")[1:])}
        yield Record(at, end + 4 - at, headers, payload)
        at = end + 4


def url_key(url: str) -> str:
    """Sortable form: host labels reversed, then the path."""
    _, found, rest = url.partition("://")
    if not found:
        return url
    host, slash, path = rest.partition("/")
    return ",".join(reversed(host.lower().split(":")[0].split("."))) + ")" + slash + path


ENTRY = T.StructType([T.StructField(n, k) for n, k in (("url_key", T.StringType()), ("timestamp", T.StringType()), ("page_id", T.LongType()), ("run", T.StringType()), ("offset", T.LongType()), ("length", T.LongType()), ("record_type", T.StringType()), ("payload_bytes", T.LongType()), ("payload_digest", T.StringType()), ("refers_to", T.LongType()), ("html", T.StringType()))])


def read(spark: SparkSession, path: str, *, with_html: bool = False) -> DataFrame:
    """The archives' records. A file's rows come sorted by (url_key, timestamp, page_id): one run each.

    A response's size and SHA-1 are computed from the payload read and must equal its headers'; a
    revisit has none, so its headers give them.
    """
    number = lambda x: int(x[len("<urn:page:") : -1]) if x and x != "<urn:page:>" else None

    def run(batches):
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows = []
                for r in parse(gzip.decompress(content)):
                    h = r.headers
                    size, digest = int(h["http:content-length"]), h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if h["WARC-Type"] == "response" and (len(r.payload) != size or hashlib.sha1(r.payload).hexdigest() != digest):
                        raise ValueError(f"{name}: the payload at byte {r.offset} is not the one its headers tell of")
                    rows.append((url_key(h["WARC-Target-URI"]), h["WARC-Date"], number(h["WARC-Record-ID"]), name, r.offset, r.length, h["WARC-Type"], size, digest, number(h.get("WARC-Refers-To")), r.payload.decode() if with_html and h["WARC-Type"] == "response" else None))
                rows.sort(key=lambda x: (x[0], x[1], x[2] or 0, x[4]))
                columns = list(zip(*rows, strict=True)) or [()] * len(ENTRY)
                kinds = {"string": pa.string(), "bigint": pa.int64()}
                yield pa.RecordBatch.from_arrays([pa.array(c, kinds[f.dataType.simpleString()]) for c, f in zip(columns, ENTRY, strict=True)], ENTRY.names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(run, ENTRY)


class LoserTree:
    """k-way merge: inner nodes remember the loser of their match, so a new head replays one path."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.k = max(1, len(runs))
        self.heads = [next(r, None) for r in runs] or [None]
        self.losers = [-1] * self.k
        self.winner = self._play(1)

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return x is not None and (y is None or (x, a) <= (y, b))

    def _play(self, node: int) -> int:
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, lose = (a, b) if self._before(a, b) else (b, a)
        self.losers[node] = lose
        return win

    def __iter__(self):
        while self.heads[self.winner] is not None:
            yield self.heads[self.winner]
            at = self.winner
            self.heads[at] = next(self.runs[at], None)
            node = (at + self.k) // 2
            while node >= 1:
                if not self._before(at, self.losers[node]):
                    at, self.losers[node] = self.losers[node], at
                node //= 2
            self.winner = at


def merged_index(entries: DataFrame) -> DataFrame:
    """The capture index in global order of (url_key, timestamp, page_id).

    Runs are merged range by range; a range's slices are sorted by run on arrival (Spark spills),
    and its task holds one range of small entries.
    """
    order = ["url_key", "timestamp", "page_id", "offset"]
    names = entries.columns
    at = [names.index(c) for c in order]
    ranged = entries.repartitionByRange(common.narrow_partitions(entries.sparkSession, entries), *order).sortWithinPartitions("run", *order)

    def run(frames):
        slices: dict[str, list[tuple]] = {}
        for frame in frames:
            for row in frame.astype(object).where(frame.notna(), None).itertuples(index=False, name=None):
                slices.setdefault(row[names.index("run")], []).append(row)
        keyed = lambda rows: (((r[at[0]], r[at[1]], r[at[2]] if r[at[2]] is not None else -1, r[at[3]]), i, r) for i, r in enumerate(rows))
        tree = LoserTree([iter([(k, n, i, r) for (k, i, r) in keyed(rows)]) for n, rows in enumerate(slices.values())])
        part = []
        for _, _, _, row in tree:
            part.append(row)
            if len(part) == 10_000:
                yield pd.DataFrame(part, columns=names)
                part = []
        if part:
            yield pd.DataFrame(part, columns=names)

    return ranged.mapInPandas(run, entries.schema)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_path(spark, "warc")
    write(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html"), path)
    return merged_index(read(spark, path).drop("html")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op10_warc": op10_warc}
SQL = {
    "op10_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
r AS (SELECT page_id, html, CAST(strlen(html) AS BIGINT) AS payload_bytes, max(page_id) OVER (PARTITION BY html) AS last FROM p)
SELECT page_id, payload_bytes, sha1(html) AS payload_digest,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND page_id < last THEN last END AS refers_to
FROM r
"""
}
