"""Media columns: a Spark data source over directories of archives with image members.

``MediaArchives`` plans byte ranges of every archive as partitions. A range owns the members whose
headers start in it; it finds the first by the archive's offset table (or, without one, by walking
the headers), reads member after member, and gives them to Spark as Arrow batches bounded in
bytes. Each member is read by its own offset: a failed read is tried again from there, so one bad
read never repeats the batch. What stays unreadable fails the query or, with ``errors=keep``,
becomes a row with an error.

Archives are tar files whose members are 8-bit grayscale PNG images: text in UTF-8, padded with
bytes 255 (which UTF-8 never has) to a positive multiple of 576, one row per 576 samples.

Defined cases: a null text is an empty payload (one row of 255); a null id names a member
``null.png``; repeated rows are members of their own; very long texts are tall images; an empty
table gives no archives and no rows.
"""

from __future__ import annotations

import struct
import tarfile
import time
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import new_path, staged
from .store import NewFile, make_dir, open_fs

WIDTH = 576
PNG = b"\x89PNG\r\n\x1a\n"
SCHEMA = "archive string, offset long, member string, media binary, payload binary, error string"
ARROW = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("member", pa.string()), ("media", pa.binary()), ("payload", pa.binary()), ("error", pa.string())])


def pad(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % WIDTH or WIDTH * (not data))


def encode_png(payload: bytes, level: int = 6) -> bytes:
    """A grayscale image of rows of ``WIDTH`` samples, without line filters."""
    rows = len(payload) // WIDTH
    lines = np.zeros((rows, WIDTH + 1), dtype=np.uint8)
    lines[:, 1:] = np.frombuffer(payload, dtype=np.uint8).reshape(rows, WIDTH)
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return PNG + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + chunk(b"IEND", b"")


def decode_png(data: bytes) -> bytes:
    """The samples of an image as ``encode_png`` makes them; checks every chunk."""
    if data[:8] != PNG:
        raise ValueError("not a PNG image")
    at, size, packed = 8, None, []
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    if size is None or size[2:] != (8, 0, 0, 0, 0):
        raise ValueError("only 8-bit grayscale images without interlace are read")
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), dtype=np.uint8).reshape(size[1], size[0] + 1)
    if lines[:, 0].any():
        raise ValueError("line filters are not read")
    return lines[:, 1:].tobytes()


def _write_media(folder: str, archive_bytes: int, level: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, offsets = None, []

        def close() -> pd.DataFrame:
            out.write(bytes(1024))
            out.close()
            table = NewFile(folder, ".idx")
            table.write(np.array(offsets, dtype="<i8").tobytes())
            table.close()
            return pd.DataFrame({"archive": [out.name], "bytes": [out.size], "members": [len(offsets)], "offsets": [table.name]})

        for b in batches:
            for doc_id, text in zip(b["m_id"], b["m_text"], strict=True):
                if out is None:
                    out, offsets = NewFile(folder, ".tar"), []
                media = encode_png(pad(text.encode("utf-8", "replace") if isinstance(text, str) else b""), level)
                info = tarfile.TarInfo(f"{'null' if doc_id is None or pd.isna(doc_id) else doc_id}.png")
                info.size = len(media)
                offsets.append(out.size)
                out.write(info.tobuf(tarfile.GNU_FORMAT) + media + bytes(-len(media) % 512))
                if out.size >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return run


def write_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", archive_bytes: int = 64 << 20, level: int = 6) -> tuple[str, DataFrame]:
    """Write every row as a member; the folder and its archives (archive, bytes, members, offsets)."""
    folder = new_path(docs.sparkSession, "media")
    make_dir(folder)
    x = docs.select(F.col(f"`{id_col}`").cast("string").alias("m_id"), F.col(f"`{text_col}`").alias("m_text"))
    made = x.mapInPandas(_write_media(folder, archive_bytes, level), "archive string, bytes long, members long, offsets string")
    return folder, staged(made, "archives")


class Range(InputPartition):
    def __init__(self, path: str, offsets: str | None, start: int, end: int):
        self.path, self.offsets, self.start, self.end = path, offsets, start, end


class MediaReader(DataSourceReader):
    """Options: path (a folder), manifest (a text file in it naming archives and their offset
    tables; without one every *.tar is read), split_bytes, batch_bytes, retries, errors."""

    def __init__(self, options: dict):
        self.folder = options["path"].rstrip("/")
        self.manifest = options.get("manifest")
        self.split_bytes = int(options.get("split_bytes", 16 << 20))
        self.batch_bytes = int(options.get("batch_bytes", 4 << 20))
        self.retries = int(options.get("retries", 3))
        self.keep_errors = options.get("errors", "fail") == "keep"

    def partitions(self) -> list[Range]:
        from pyarrow import fs

        f, base = open_fs(self.folder)
        if self.manifest:
            with f.open_input_stream(f"{base}/{self.manifest}", compression=None) as src:
                found = [x.split(" ") for x in src.read().decode().splitlines()]
            archives = [(f"{base}/{a}", f"{base}/{o}", int(n)) for a, o, n in found]
        else:
            infos = f.get_file_info(fs.FileSelector(base))
            archives = [(i.path, None, i.size) for i in sorted(infos, key=lambda i: i.path) if i.path.endswith(".tar")]
        out = []
        for path, table, size in archives:
            parts = max(1, -(-size // self.split_bytes))
            edges = [size * k // parts for k in range(parts + 1)]
            out += [Range(path, table, a, b) for a, b in zip(edges, edges[1:], strict=False)]
        return out or [Range("", None, 0, 0)]

    def read(self, part: Range) -> Iterator[pa.RecordBatch]:
        if not part.path:
            return
        f, _ = open_fs(self.folder)
        rows, held = [], 0
        source = [f.open_input_file(part.path)]
        for at in self._starts(f, part):
            name, media, payload, error = self._member(f, source, part.path, at)
            rows.append((part.path.rpartition("/")[2], at, name, media, payload, error))
            held += len(media or b"") + len(payload or b"")
            if held >= self.batch_bytes:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)
                rows, held = [], 0
        source[0].close()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), ARROW.types, strict=True)], schema=ARROW)

    def _starts(self, f, part: Range) -> Iterator[int]:
        """Offsets of the members whose headers start in the range."""
        if part.offsets:
            with f.open_input_stream(part.offsets, compression=None) as table:
                offsets = np.frombuffer(table.read(), dtype="<i8")
            lo, hi = np.searchsorted(offsets, [part.start, part.end])
            yield from (int(x) for x in offsets[lo:hi])
            return
        with f.open_input_file(part.path) as src:  # apart from the handle that retries replace
            at, size = 0, src.size()
            while at < min(part.end, size):
                src.seek(at)
                head = src.read(512)
                if len(head) < 512 or not any(head):
                    return
                info = tarfile.TarInfo.frombuf(head, "utf-8", "strict")
                if at >= part.start:
                    yield at
                at += 512 + (info.size + 511) // 512 * 512

    def _member(self, f, source: list, path: str, at: int) -> tuple:
        for attempt in range(self.retries + 1):
            try:
                if source[0].closed:
                    source[0] = f.open_input_file(path)
                source[0].seek(at)
                info = tarfile.TarInfo.frombuf(source[0].read(512), "utf-8", "strict")
                media = source[0].read(info.size)
                if len(media) != info.size:
                    raise OSError(f"{path}: the member at {at} is cut off")
                return info.name, media, decode_png(media), None
            except (OSError, ValueError, tarfile.TarError, struct.error, zlib.error) as e:
                source[0].close()  # tried again from its own offset, on a new handle
                if attempt == self.retries:
                    if not self.keep_errors:
                        raise
                    return None, None, None, f"{type(e).__name__}: {e}"
                time.sleep(0.05 * 2**attempt)


class MediaArchives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "quern_media"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> MediaReader:
        return MediaReader(dict(self.options))


def read_media(spark, folder: str, archives: DataFrame | None = None, **options) -> DataFrame:
    """The members of a folder's archives. ``archives`` names those of committed tasks."""
    spark.dataSource.register(MediaArchives)
    reader = spark.read.format("quern_media").option("path", folder)
    if archives is not None:
        lines = "".join(f"{r[0]} {r[1]} {r[2]}\n" for r in sorted(archives.select("archive", "offsets", "bytes").collect()))
        out = NewFile(folder, ".manifest")  # a line per archive of 64 MB
        out.write(lines.encode())
        out.close()
        reader = reader.option("manifest", out.name)
    for k, v in options.items():
        reader = reader.option(k, str(v))
    return reader.load()


def feature(payload: bytes) -> str:
    """Mean, spread and a 64-bit average hash of the image, columns pooled to 64 bands."""
    x = np.frombuffer(payload, dtype=np.uint8).reshape(-1, 64, WIDTH // 64)
    bands = x.mean(axis=(0, 2))
    bits = np.packbits(bands > bands.mean()).tobytes().hex()
    return f"{x.mean():.4f}:{x.std():.4f}:{bits}"


def features(payloads: pd.Series) -> pd.Series:
    return pd.Series([feature(p) for p in payloads], dtype="object")


def media_report(docs: DataFrame) -> DataFrame:
    """Write every text as an image, read all images back, describe what was read."""
    folder, archives = write_media(docs)
    x = read_media(docs.sparkSession, folder, archives)
    text = F.expr("rtrim(X'FF', payload)")
    stem = F.regexp_extract("member", r"^(-?\d+)\.png$", 1)
    return x.select(
        F.when(stem != "", stem).cast("long").alias("doc_id"),
        F.octet_length(text).cast("long").alias("n_bytes"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.pandas_udf(features, "string")(F.col("payload")).alias("feature"),
    )
