"""WARC archives with deduplicated payloads and a merged capture index.

Archives: every task writes WARC/1.0 files through Spark's text sink, whose line separator
is the format's record terminator, so a finished job leaves whole archives and a lost task
none. Records of equal payload after the first are ``revisit`` records without payload.

Index: reading an archive gives a run of captures sorted by URL key and time. The
key space is cut into ranges of about RANGE captures, so their number grows with the index and their size does not, and each range's parts of the runs
meet in a k-way merge by a tree of losers: one comparison a level for each capture, in order of
(URL key, timestamp, page_id) over the whole archive. A merge holds its range's captures once, as they came, and yields as it merges.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
from collections.abc import Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path, table

END = "\r\n\r\n"
#: Bytes that an archive file has, about; a file is read by one task.
FILE_BYTES = 8 << 20
#: Captures that a range of the merged index has, about.
RANGE = 50_000
#: Parts that copies of one payload are told their response in.
SALTS = 8
#: Captures take their time from the page's number unless a column gives it.
FIRST_CAPTURE = 1_704_067_200  # 2024-01-01T00:00:00Z


def url_key(url: str | None) -> str:
    """Sort-friendly key: host labels reversed, then port, path and query, lower case; scheme, www,
    user, fragment and default ports go."""
    from urllib.parse import urlsplit

    try:
        parts = urlsplit((url or "").strip())
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return (url or "").strip().lower()
    if not host:
        return (url or "").strip().lower()
    host = host.removeprefix("www.")
    tail = "" if port in (None, 80, 443) else f":{port}"
    query = "?" + "&".join(sorted(parts.query.lower().split("&"))) if parts.query else ""
    return f"{','.join(reversed(host.split('.')))}{tail}){parts.path.lower() or '/'}{query}"


class LoserTree:
    """Merges sorted iterators; inner nodes hold the losers of their matches, the root's winner is next."""

    def __init__(self, runs: list[Iterator]):
        self.runs = [iter(r) for r in runs]
        self.k = max(1, len(self.runs))
        self.head = [next(r, None) for r in self.runs] or [None]
        self.loser = [-1] * self.k
        for leaf in range(self.k):
            self._play(leaf, building=True)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return y is None or x is not None and (x, a) <= (y, b)

    def _play(self, leaf: int, building: bool = False) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node:
            other = self.loser[node]
            if other < 0 and building:
                self.loser[node] = winner
                return
            if not self._beats(winner, other):
                self.loser[node], winner = winner, other
            node //= 2
        self.loser[0] = winner

    def __iter__(self) -> Iterator:
        while (item := self.head[w := self.loser[0]]) is not None:
            yield item
            self.head[w] = next(self.runs[w], None)
            self._play(w)


def records(pages: DataFrame, least_bytes: int = 0, key: str = "page_id", url: str = "url", payload: str = "html", time: str | None = None) -> DataFrame:
    """The text of every page's WARC record (without the terminator).

    Null payloads and URLs are empty, a null page_id is an empty record number; repeated pages are records of their own. Of equal payloads of
    ``least_bytes`` or more, the smallest page_id is the response (of rows that tie there, all are). ``time`` names the captures' timestamps;
    without it, or where it is null, a time is made from the page's number. Grouping is by SHA-1 and length, pre-aggregated, and copies learn
    their response in SALTS parts, so no payload is one task. No rows give no records; other columns are never read.
    """
    body = F.coalesce(F.col(payload).cast("string"), F.lit(""))
    when = F.unix_timestamp(F.col(time).cast("timestamp")) if time else F.lit(None).cast("long")
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.coalesce(F.col(url), F.lit("")).alias("url"), body.alias("body"), when.alias("seconds"))
    rows = rows.withColumn("sha", F.sha1("body")).withColumn("size", F.octet_length("body").cast("long"))
    first = rows.where(F.col("size") >= least_bytes).groupBy("sha", "size").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    # only pages whose payload occurs again need to be told their response
    dealt = rows.where(F.col("size") >= least_bytes).select("page_id", "sha", "size", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int").alias("salt"))
    copied = first.where("copies > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    again = dealt.join(copied, ["sha", "size", "salt"]).where("page_id <> first")
    told = again.groupBy("page_id", "sha", "size").agg(F.min("first").alias("refers_to"))
    both = rows.join(told, ["page_id", "sha", "size"], "left")

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        from datetime import UTC, datetime

        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                number = "" if pd.isna(r.page_id) else int(r.page_id)
                digest = base64.b32encode(bytes.fromhex(r.sha)).decode()
                seconds = FIRST_CAPTURE + (number or 0) % (1 << 32) if pd.isna(r.seconds) else int(r.seconds)
                date = datetime.fromtimestamp(seconds, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
                revisit = not pd.isna(r.refers_to)
                target = " ".join(r.url.split())
                http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                block = f"{http}X-Payload-Length: {r.size}{END}" if revisit else f"{http}Content-Length: {r.size}{END}{r.body}"
                kind = ["revisit", f"WARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:{int(r.refers_to)}>\r\n"] if revisit else ["response", ""]
                head = f"WARC/1.0\r\nWARC-Type: {kind[0]}\r\nWARC-Record-ID: <urn:page:{number}>\r\nWARC-Date: {date}\r\nWARC-Target-URI: {target}\r\n{kind[1]}WARC-Payload-Digest: sha1:{digest}\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: {len(block.encode())}{END}"
                out.append(head + block)
            yield pd.DataFrame({"value": out})

    return both.select("page_id", "url", "body", "sha", "size", "refers_to", "seconds").mapInPandas(run, "value string")


def write_warc(pages: DataFrame, path: str, **names) -> None:
    """Write gzip-compressed archives to ``path``; files hold about FILE_BYTES before compression (at
    least a record). Offsets in the index are those of the uncompressed archive."""
    mean = pages.agg(F.avg(F.octet_length(names.get("payload", "html")))).first()[0] or 0
    each = max(1, int(FILE_BYTES // (mean + 600)))
    records(pages, **names).write.option("lineSep", END).option("maxRecordsPerFile", each).option("compression", "gzip").text(path)


CAPTURE = "url_key string, timestamp string, page_id long, record_type string, refers_to long, payload_digest string, payload_bytes long, file string, offset long, length long"
_FIELDS = [x.split()[0] for x in CAPTURE.split(", ")]


def parse(content: bytes, file: str) -> Iterator[tuple]:
    """Captures of an archive in file order. Lengths lead from record to record, so payloads may hold
    anything, even record headers; response payloads are held against their digests."""
    at = 0
    while at < len(content):
        if not content.startswith(b"WARC/1.0\r\n", at):
            raise ValueError(f"{file}: no record at byte {at}")
        end = content.index(b"\r\n\r\n", at)
        head = dict(x.split(": ", 1) for x in content[at:end].decode().split("\r\n")[1:] if ": " in x)
        size = int(head["Content-Length"])
        block = content[end + 4 : end + 4 + size]
        http, _, payload = block.partition(b"\r\n\r\n")
        digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
        number = head["WARC-Record-ID"][10:-1]
        refers = head.get("WARC-Refers-To")
        if refers:
            length = int(http.rpartition(b"X-Payload-Length: ")[2])
        else:
            length = len(payload)
            if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                raise ValueError(f"{file}: digest of record {number} does not match")
        stamp = "".join(c for c in head["WARC-Date"] if c.isdigit())
        whole = end + 4 + size + 4 - at
        yield url_key(head.get("WARC-Target-URI", "")), stamp, int(number) if number else -1, head["WARC-Type"], int(refers[10:-1]) if refers else -1, digest, length, file, at, whole
        at += whole


def capture_runs(spark: SparkSession, path: str) -> DataFrame:
    """A row for each capture: run (the archive's name), place in the run, and CAPTURE's columns.

    Runs are sorted by (url_key, timestamp, page_id), each in memory: an archive is FILE_BYTES or one record."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for pdf in batches:
            for row in pdf.itertuples():
                content = gzip.decompress(row.content) if row.content[:2] == b"\x1f\x8b" else row.content
                rows = sorted(parse(content, row.path.rsplit("/", 1)[-1]))
                out = pd.DataFrame(rows, columns=_FIELDS)
                out.insert(0, "place", range(len(rows)))
                yield out

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, f"place long, {CAPTURE}")


def merge_runs(runs: DataFrame, captures: int = RANGE) -> DataFrame:
    """The global index in order of part, position: CAPTURE's columns with those two. Repeated captures stay, in order of their file.

    Parts are ranges of (url_key, timestamp, page_id) of about ``captures``, so the history of one URL can be split."""

    def run(batches: Iterator) -> Iterator:
        import pandas as pd
        from pyspark import TaskContext

        def rows_of(parts: list) -> Iterator[tuple]:
            for part in parts:
                yield from part.itertuples(index=False, name=None)

        by_run: dict[str, list] = {}
        for pdf in batches:  # sorted by (file, place): each run's part comes in its own order
            for file, part in pdf[_FIELDS].groupby("file", sort=False):
                by_run.setdefault(file, []).append(part)
        merged, at = iter(LoserTree([rows_of(parts) for parts in by_run.values()])), 0
        while rows := list(islice(merged, 20_000)):
            out = pd.DataFrame(rows, columns=_FIELDS)
            out.insert(0, "part", TaskContext.get().partitionId())
            out["position"] = range(at, at + len(out))
            at += len(out)
            yield out

    parts = max(int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-runs.count() // captures))
    # the shuffle into ranges mixes the runs' rows; sorting by run and place puts each run's part back in the order it was sorted in
    dealt = runs.repartitionByRange(parts, "url_key", "timestamp", "page_id").sortWithinPartitions("file", "place")
    return dealt.mapInPandas(run, f"part int, {CAPTURE}, position long")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "op7-archives")
    write_warc(table(spark, sf_dir, "pages"), path)
    index = merge_runs(materialize(capture_runs(spark, path), "op7-runs"))
    number = lambda c: F.when(F.col(c) >= 0, F.col(c)).alias(c)
    return index.select(number("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"), "url_key", "timestamp", "file", "offset", "length")
