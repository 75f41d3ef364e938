"""WARC archives of page captures with an externally merged capture index.

Each task writes gzip-per-record WARC/1.1 files and, per file, a run: the captures' index lines
sorted by URL key, timestamp and record. Runs are merged k ways by a loser tree, in rounds of at
most ``fan_in`` runs; the last round is cut into key ranges, a task each, which seek to their range
in every run. Ranges together are one globally ordered capture history.

Of captures with equal payloads of at least ``min_payload`` bytes that with the smallest page_id
is a response record; the others are revisit records that refer to it and hold no payload.

Defined cases: a null html has an empty payload; control characters and spaces in a URL are
written %-escaped, a null URL gives no target; every row with the smallest page_id of its payload is a
response; payloads without any page_id are all responses; a null page_id otherwise revisits;
repeated rows are records of their own; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime, timedelta
from urllib.parse import quote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, staged
from .store import NewFile, make_dir, open_fs

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
INDEX_SCHEMA = "urlkey string, timestamp string, page_id long, file string, offset long, length long"


class LoserTree:
    """Merges sorted iterators: each inner node keeps the loser of its match, so the next item
    costs one match per level."""

    def __init__(self, sources: list[Iterator]):
        self._sources = sources
        self._heads = [next(s, None) for s in sources]
        n = len(sources)
        self._losers = [-1] * n
        self._top = -1
        for leaf in range(n):
            self._enter(leaf)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self._heads[a], self._heads[b]
        return x is not None and (y is None or (x, a) < (y, b))

    def _enter(self, leaf: int) -> None:
        """First matches: a contender waits at an empty node, else the loser stays there."""
        at, winner = (leaf + len(self._sources)) // 2, leaf
        while at > 0:
            if self._losers[at] < 0:
                self._losers[at] = winner
                return
            if self._beats(self._losers[at], winner):
                self._losers[at], winner = winner, self._losers[at]
            at //= 2
        self._top = winner

    def __iter__(self) -> Iterator:
        n = len(self._sources)
        while n and self._heads[self._top] is not None:
            leaf = self._top
            yield self._heads[leaf]
            self._heads[leaf] = next(self._sources[leaf], None)
            at, winner = (leaf + n) // 2, leaf
            while at > 0:
                if self._beats(self._losers[at], winner):
                    self._losers[at], winner = winner, self._losers[at]
                at //= 2
            self._top = winner


def url_key(url: str | None) -> str:
    """Host labels from the right, then the path: the sort order of capture histories."""
    if not url:
        return "-"
    _, mark, rest = url.partition("://")
    m = re.match(r"([^/?#]*)([^#]*)", rest if mark else url, re.S)
    return quote(",".join(reversed(m[1].lower().split("."))) + ")" + m[2], safe="%/?&=+,):;@!$'(*~.-_")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, when: datetime, first: int | None) -> bytes:
    """A whole WARC record; ``first`` is the response's page_id for a revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if first is not None else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if first is None else 'revisit'}"]
    head += [f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {when:%Y-%m-%dT%H:%M:%SZ}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {re.sub(r'[\x00-\x20\x7f]', lambda m: f'%{ord(m[0]):02X}', url)}")
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if first is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{first}>"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers, payload (None for a revisit) and its full length of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    h = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(h["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    full = int(re.search(rb"Content-Length: (\d+)", http)[1])
    return {"headers": h, "payload": payload if h["WARC-Type"] == "response" else None, "full": full}


def read_members(uri: str) -> Iterator[tuple[int, int, bytes]]:
    """(offset, length, record) of each gzip member of an archive, streamed."""
    f, path = open_fs(uri)
    with f.open_input_stream(path, compression=None, buffer_size=1 << 20) as src:
        d, out, at, used, more = zlib.decompressobj(31), [], 0, 0, b""
        while True:
            data = more or src.read(1 << 18)
            more = b""
            if not data:
                if used:
                    raise EOFError(f"{uri}: the record at {at} is cut off")
                return
            out.append(d.decompress(data))
            used += len(data)
            if d.eof:
                used -= len(d.unused_data)
                yield at, used, b"".join(out)
                more, at, used, out, d = d.unused_data, at + used, 0, [], zlib.decompressobj(31)


def _line(key: str, stamp: str, page_id, file: str, offset: int, length: int) -> bytes:
    """Ids are shifted to sort as text; an unknown one sorts first."""
    number = "-" if page_id is None else f"{int(page_id) + (1 << 63):020d}"
    return f"{key} {stamp} {number} {file} {offset:015d} {length:012d}\n".encode()


def _row(line: bytes) -> tuple:
    key, stamp, number, file, offset, length = line.decode().split(" ")
    return key, stamp, None if number == "-" else int(number) - (1 << 63), file, int(offset), int(length)


def _write_archives(folder: str, archive_bytes: int, samples: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, lines = None, []

        def close() -> pd.DataFrame:
            out.close()
            lines.sort()
            index = NewFile(folder, ".cdx")
            for x in lines:
                index.write(x)
            index.close()
            step = max(1, len(lines) // samples)
            return pd.DataFrame({"run": [index.name], "n": [len(lines)], "archive": [out.name], "sample": [[x.decode() for x in lines[step // 2 :: step]]]})

        for b in batches:
            for page_id, url, html, first in zip(b["page_id"], b["url"], b["html"], b["first"], strict=True):
                if out is None:
                    out, lines = NewFile(folder, ".warc.gz"), []
                pid = None if pd.isna(page_id) else int(page_id)
                url = url if isinstance(url, str) else None
                payload = html.encode("utf-8", "replace") if isinstance(html, str) else b""
                when = EPOCH + timedelta(seconds=(pid or 0) % 1_000_000_000)
                c = zlib.compressobj(6, zlib.DEFLATED, 31)
                data = c.compress(record(pid, url, payload, when, None if pd.isna(first) else int(first))) + c.flush()
                lines.append(_line(url_key(url), f"{when:%Y%m%d%H%M%S}", pid, out.name, out.size, len(data)))
                out.write(data)
                if out.size >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def write_archives(pages: DataFrame, min_payload: int = 0, archive_bytes: int = 64 << 20, samples: int = 64) -> tuple[str, DataFrame]:
    """Write ``pages`` (page_id, url, html); the folder and its runs (run, n, archive, sample)."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    make_dir(folder)
    p = pages.select("page_id", "url", "html", F.coalesce("html", F.lit("")).alias("w_text"))
    p = p.select("page_id", "url", "html", F.sha2("w_text", 256).alias("w_key"), (F.octet_length("w_text") >= min_payload).alias("w_big"))
    # Payloads that occur once need no partner; only the others' digests join.
    firsts = p.where("w_big").groupBy("w_key").agg(F.min("page_id").alias("w_first"), F.count("*").alias("n")).where("n > 1 and w_first is not null")
    x = p.join(firsts.select(F.col("w_key").alias("f_key"), "w_first"), F.col("w_big") & (F.col("w_key") == F.col("f_key")), "left")
    revisit = F.col("w_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("w_first"))
    x = x.select("page_id", "url", "html", F.when(revisit, F.col("w_first")).alias("first"))
    runs = x.mapInPandas(_write_archives(folder, archive_bytes, samples), "run string, n long, archive string, sample array<string>")
    return folder, staged(runs, "runs")


def _lines_between(uri: str, low: bytes | None, high: bytes | None) -> Iterator[bytes]:
    """Lines of a sorted run from ``low`` on, below ``high``; the start is found by bisection."""
    f, path = open_fs(uri)
    size = f.get_file_info(path).size
    with f.open_input_file(path) as src:

        def line_from(at: int) -> bytes:
            """The first whole line that starts after ``at`` (or at 0)."""
            src.seek(max(0, at - 1))
            got = b""
            while True:
                part = src.read(4096)
                got += part
                begin = 0 if at == 0 else got.find(b"\n") + 1
                end = got.find(b"\n", begin) if begin or at == 0 else -1
                if end >= 0:
                    return got[begin : end + 1]
                if not part:
                    return b""

        class Starts:
            def __len__(self):
                return size + 1

            def __getitem__(self, at):
                x = line_from(at)
                return x or b"\xff"

        at = bisect.bisect_left(Starts(), low) if low else 0
        if at >= size:
            return
        src.seek(max(0, at - 1))
        held = src.read(1 << 16)
        held = held if at == 0 else held[held.find(b"\n") + 1 :] if b"\n" in held else b""
        while True:
            *whole, held = held.split(b"\n")
            for x in whole:
                x += b"\n"
                if high is not None and x >= high:
                    return
                yield x
            part = src.read(1 << 16)
            if not part:
                return
            held += part


def _merge_ranges(folder: str, runs: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = INDEX_SCHEMA.replace(" string", "").replace(" long", "").split(", ")
        for b in batches:
            for low, high in zip(b["low"], b["high"], strict=True):
                low, high = (x.encode() if isinstance(x, str) else None for x in (low, high))
                rows = []
                for x in LoserTree([_lines_between(f"{folder}/{r}", low, high) for r in runs]):
                    rows.append(_row(x))
                    if len(rows) >= 20_000:
                        yield _frame(rows, names)
                        rows = []
                if rows:
                    yield _frame(rows, names)

    return run


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    x = pd.DataFrame(rows, columns=names)
    x["page_id"] = x["page_id"].astype("Int64")
    return x


def _merge_groups(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for runs in b["runs"]:
                out = NewFile(folder, ".cdx")
                for x in LoserTree([_lines_between(f"{folder}/{r}", None, None) for r in runs]):
                    out.write(x)
                out.close()
                yield pd.DataFrame({"run": [out.name]})

    return run


def merge_index(folder: str, runs: DataFrame, fan_in: int = 64, range_rows: int = 200_000) -> DataFrame:
    """The runs as one capture history: rows of ``INDEX_SCHEMA``, ordered over the partitions.

    The driver holds the runs' names and a million of their sample lines, or one of each run.
    """
    spark = runs.sparkSession
    each = max(1, 1_000_000 // max(1, runs.count()))
    step = F.greatest(F.lit(1), F.ceil(F.size("sample") / each)).cast("int")
    thin = F.filter("sample", lambda _, i: i % step == F.floor(step / 2).cast("int"))
    found = sorted(runs.select("run", "n", F.when(F.size("sample") <= each, F.col("sample")).otherwise(thin)).collect())
    names, total = [r[0] for r in found], sum(r[1] for r in found)
    if not names:
        return spark.createDataFrame([], INDEX_SCHEMA)
    while len(names) > fan_in:
        groups = [(names[k : k + fan_in],) for k in range(0, len(names), fan_in)]
        df = spark.createDataFrame(groups, "runs array<string>").repartition(len(groups))
        names = sorted(r[0] for r in staged(df.mapInPandas(_merge_groups(folder), "run string"), "merged").collect())
    parts = max(1, -(-total // range_rows), min(spark.sparkContext.defaultParallelism, total // 1000))
    lines = sorted((line, n / max(1, len(sample))) for _, n, sample in found for line in sample)
    cuts, held = [], 0.0
    for line, weight in lines:
        held += weight
        if held >= total / parts and len(cuts) < parts - 1:
            cuts.append(line)
            held = 0.0
    bounds = list(zip([None, *cuts], [*cuts, None], strict=True))
    df = spark.createDataFrame([(k, *b) for k, b in enumerate(bounds)], "k int, low string, high string")
    df = df.repartitionByRange(len(bounds), "k")
    return df.mapInPandas(_merge_ranges(folder, names), INDEX_SCHEMA)


def _read_archives(folder: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["r_file", "r_offset", "payload_bytes", "payload_digest", "record_type", "refers_to", "url"]
        for b in batches:
            for name in b["archive"]:
                rows = []
                for offset, _, raw in read_members(f"{folder}/{name}"):
                    r = parse_record(raw)
                    h = r["headers"]
                    said = h["WARC-Payload-Digest"].removeprefix("sha1:")
                    if r["payload"] is not None and (digest(r["payload"]) != said or len(r["payload"]) != r["full"]):
                        raise ValueError(f"{name}: the record at {offset} is damaged")
                    to = h.get("WARC-Refers-To")
                    uri = h.get("WARC-Target-URI")
                    rows.append((name, offset, r["full"], said, h["WARC-Type"], int(to[10:-1]) if to else None, uri))
                    if len(rows) >= 10_000:
                        yield pd.DataFrame(rows, columns=names).astype({"refers_to": "Int64"})
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"refers_to": "Int64"})

    return run


def read_archives(folder: str, runs: DataFrame) -> DataFrame:
    """Every record of the archives: r_file, r_offset, payload_bytes, payload_digest, record_type,
    refers_to, url."""
    schema = "r_file string, r_offset long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string"
    # The driver knows the names from the merge; a task each, or a few archives a task where there are very many.
    names = sorted(r[0] for r in runs.select("archive").collect())
    if not names:
        return runs.sparkSession.createDataFrame([], schema)
    archives = runs.sparkSession.createDataFrame(list(enumerate(names)), "k long, archive string")
    return archives.repartitionByRange(min(len(names), 50_000), "k").mapInPandas(_read_archives(folder), schema)


def capture_history(pages: DataFrame, **options) -> DataFrame:
    """Write, index and read back ``pages``: the merged index with each record's facts."""
    folder, runs = write_archives(pages, **options)
    index, records = merge_index(folder, runs), read_archives(folder, runs)
    # Both sides come from short lists of names, which tell the planner nothing of their size: no broadcast.
    on = (F.col("file") == F.col("r_file")) & (F.col("offset") == F.col("r_offset"))
    return index.hint("merge").join(records.hint("merge"), on).drop("r_file", "r_offset")


def warc_report(pages: DataFrame) -> DataFrame:
    return capture_history(pages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "timestamp")
