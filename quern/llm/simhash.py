"""SimHash near-duplicates with pivot distance tables.

A fingerprint bit is set if more than half of the shingles' XXH64 hashes have it set. Fingerprints
within ``radius`` bits agree on at least ``bands - radius`` of ``bands`` bands (pigeonhole), so
every choice of that many bands is a blocking key and no near pair is missed. Within a block the
Hamming distances of each fingerprint to many reference fingerprints (pivots) are tabulated; a
pair whose coordinates differ by more than ``radius`` anywhere can't be near (triangle inequality)
and is discarded, and survivors are verified on the fingerprints themselves.

Only distinct fingerprints are blocked, and a task gives links that span what it found, never all
pairs of a group. In a large block a few leaders join what is near them first; after that only pairs
of different classes are formed. A block of over ``block_rows`` is dealt into parts, each two of which
meet in a task of their own.

``near_duplicates`` serves filters on word-shingle similarity: blocks are bands of a MinHash
signature, pivots discard pairs whose fingerprints are too far for the similarity asked for, and
the estimate from ``SKETCH`` one-bit minima (standard error 0.027 at 0.8) accepts or rejects those that
are ``DOUBT`` or more from it. Rows with other pairs meet once more with their sets of shingle hashes,
on which such pairs are verified within the task. Texts are told apart by SHA-256.

Defined cases: null or empty texts have no shingles and fingerprint zero and are linked like any
other; fewer words than a shingle has are one shingle; null ids take part but never name a
component (a component without ids is null); repeated rows are rows; an empty table gives no rows.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_broadcast, drop, staged
from .graph import components

SKETCH = 512  # one-bit minima of a text, eight words of 64
DOUBT = 0.12  # estimates nearer to the similarity asked for decide nothing
_ONES = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles, repeats included."""
    ws = text.encode("utf-8", "replace").lower().split() if text else []  # bytes: A-Z and ASCII space only
    if not ws:
        return np.zeros(0, dtype=np.uint64)
    buf, h = b" ".join(ws), xxhash.xxh64_intdigest
    if len(ws) <= size:
        return np.array([h(buf, 42)], dtype=np.uint64)
    ends = list(itertools.accumulate(len(w) + 1 for w in ws))
    starts = [0, *ends[: len(ws) - size]]
    return np.array([h(buf[s : e - 1], 42) for s, e in zip(starts, ends[size - 1 :], strict=True)], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """The majority bits as a signed 64-bit number."""
    n = len(hashes)
    if not n:
        return 0
    total = np.zeros(64, dtype=np.int64)
    for k in range(0, n, 65536):
        bits = np.unpackbits(hashes[k : k + 65536].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        total += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits((2 * total > n).astype(np.uint8), bitorder="little").view("<i8")[0])


def _fingerprint_rows(size: int):
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(shingle_hashes(t, size)) for t in texts], dtype="int64")

    of.__annotations__ = {"texts": pd.Series, "return": pd.Series}
    return F.pandas_udf(of, "long")


def fingerprints(docs: DataFrame, size: int = 4) -> DataFrame:
    """doc_id, fp of every row."""
    return docs.select("doc_id", _fingerprint_rows(size)(F.col("text")).alias("fp"))


def band_masks(bands: int, radius: int) -> list[int]:
    """Masks (signed) of every choice of ``bands - radius`` of ``bands`` nearly equal bands."""
    edges = [64 * k // bands for k in range(bands + 1)]
    ones = [((1 << (b - a)) - 1) << a for a, b in itertools.pairwise(edges)]
    masks = [sum(c) for c in itertools.combinations(ones, bands - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def pivots(count: int = 32, seed: int = 5) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 1 << 64, count, dtype=np.uint64)


def _pairs(sizes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (earlier, later) index pairs within runs of the given sizes."""
    of = np.repeat(np.arange(len(sizes)), sizes)
    index = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(firsts, sizes)
    later = np.repeat(firsts, sizes) + np.repeat(sizes, sizes) - 1 - index
    a = np.repeat(index, later)
    step = np.arange(len(a)) - np.repeat(np.cumsum(later) - later, later) + 1
    return a, a + step


def _join_roots(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union the ends of the given links into ``root`` (smallest index of each component so far)."""
    while len(a):
        ra, rb = root[a], root[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if (up == root).all():
                break
            root[:] = up


def block_links(
    keys: np.ndarray,
    fps: np.ndarray,
    radius: int,
    sketches: np.ndarray | None = None,
    similarity: float = 0.0,
    root: np.ndarray | None = None,
    sets: list | None = None,
    tally: dict | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """root[i]: the smallest index that i is linked to by near pairs sharing a key (sorted ``keys``),
    and which rows have pairs that the sketches leave open.

    ``root`` are classes known before. With ``sets`` (sorted shingle hashes) open pairs are verified
    instead. Pairs of one class are passed over, so a large group of near copies costs a pass for each
    of a few leaders. ``tally`` counts pairs formed, left by the pivots, and near."""
    root = np.arange(len(keys)) if root is None else root
    unsure = np.zeros(len(keys), dtype=bool)
    if len(keys) < 2:
        return root, unsure
    firsts = np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1))
    sizes = np.diff(np.append(firsts, len(keys)))
    away = np.stack([np.bitwise_count(fps ^ p) for p in pivots()], axis=1).astype(np.int8)
    waiting: list[tuple[np.ndarray, np.ndarray]] = []

    def settle(most: int) -> None:
        """Forget the open pairs that were joined; with over ``most`` left, mark their ends at once."""
        x, y = (np.concatenate(c) for c in zip(*waiting, strict=True)) if waiting else (np.zeros(0, dtype=np.int64),) * 2
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
        waiting.clear()
        if len(x) > most:
            unsure[x] = unsure[y] = True
        else:
            waiting.append((x, y))

    def near(a: np.ndarray, b: np.ndarray) -> None:
        apart = root[a] != root[b]  # what is joined already needs no check
        a, b = a[apart], b[apart]
        formed = len(a)
        for k in range(0, away.shape[1], 8):  # coordinates in groups; most pairs go at once
            ok = np.abs(away[a, k : k + 8] - away[b, k : k + 8]).max(axis=1, initial=0) <= radius
            a, b = a[ok], b[ok]
        left = len(a)
        ok = np.bitwise_count(fps[a] ^ fps[b]) <= radius
        a, b = a[ok], b[ok]
        if tally is not None:
            for name, n in (("formed", formed), ("left", left), ("near", len(a))):
                tally[name] = tally.get(name, 0) + n
        if sketches is None:
            _join_roots(root, a, b)
            return
        for k in range(0, len(a), 65536):
            x, y = a[k : k + 65536], b[k : k + 65536]
            same = SKETCH - np.bitwise_count(sketches[x] ^ sketches[y]).sum(axis=1, dtype=np.int64)
            seen = 2.0 * same / SKETCH - 1.0
            ok = seen >= similarity + DOUBT
            _join_roots(root, x[ok], y[ok])
            ok = ~ok & (seen > similarity - DOUBT) & (root[x] != root[y])
            x, y, seen = x[ok], y[ok], seen[ok]
            if sets is not None:
                order = np.argsort(-seen, kind="stable")
                _verify(root, sets, x[order], y[order], similarity)
            elif len(x):
                waiting.append((x, y))
        if sum(len(w[0]) for w in waiting) > 1_000_000:
            settle(500_000)

    chunk, held, few = [], 0, (sizes > 1) & (sizes <= 512)
    for f, s in zip(firsts[few], sizes[few], strict=True):
        chunk.append((f, s))
        held += s * (s - 1) // 2
        if held > 500_000:
            near(*_pairs(np.array([c[1] for c in chunk]), np.array([c[0] for c in chunk])))
            chunk, held = [], 0
    if chunk:
        near(*_pairs(np.array([c[1] for c in chunk]), np.array([c[0] for c in chunk])))
    for f, s in zip(firsts[sizes > 512], sizes[sizes > 512], strict=True):
        own, tried = np.arange(f, f + s), set()
        for _ in range(16):  # leaders: a row of the largest class that had none
            values, first, n = np.unique(root[own], return_index=True, return_counts=True)
            new = [k for k in np.argsort(-n, kind="stable")[:17] if int(values[k]) not in tried]
            if not new:
                break
            tried.add(int(values[new[0]]))
            near(np.full(s, own[first[new[0]]]), own)
        # Then each class with all larger ones; pairs within a class are never formed.
        _, of, n = np.unique(root[own], return_inverse=True, return_counts=True)
        own = own[np.lexsort((of, n[of]))]
        rows = max(1, 500_000 // int(s))
        for r in range(0, int(s), rows):
            mine, rest = own[r : r + rows], own[r:]
            if (root[rest] == root[rest[0]]).all():
                break
            a, b = np.repeat(np.arange(len(mine)), len(rest)), np.tile(np.arange(len(rest)), len(mine))
            later = b > a
            near(mine[a[later]], rest[b[later]])
    settle(0)
    return root, unsure


def _verify(root: np.ndarray, sets: list, x: np.ndarray, y: np.ndarray, similarity: float) -> None:
    """Join those of the pairs x, y whose shingle sets have the similarity; the likeliest come first."""
    for k in range(0, len(x), 256):
        a, b = x[k : k + 256], y[k : k + 256]
        apart = root[a] != root[b]
        a, b = a[apart], b[apart]
        ok = np.array([_alike(sets[i], sets[j], similarity) for i, j in zip(a.tolist(), b.tolist(), strict=True)], dtype=bool)
        _join_roots(root, a[ok], b[ok])


def _alike(x: np.ndarray, y: np.ndarray, similarity: float) -> bool:
    """Whether two sorted arrays of distinct hashes have the Jaccard similarity."""
    if len(x) > len(y):
        x, y = y, x
    if len(x) < similarity * len(y) or not len(y):
        return len(x) == len(y)
    at = np.searchsorted(y, x)
    both = int((y[np.minimum(at, len(y) - 1)] == x).sum())
    return both >= similarity * (len(x) + len(y) - both)


def whole_groups(batches: Iterator[pd.DataFrame], column: str, rows: int = 65_536) -> Iterator[pd.DataFrame]:
    """Frames of whole groups of about ``rows`` rows, from batches sorted by ``column``."""
    held, n = [], 0
    for b in batches:
        if not len(b):
            continue
        held.append(b)
        n += len(b)
        if n >= rows:
            x = pd.concat(held, ignore_index=True)
            before = np.flatnonzero(x[column].to_numpy() != x[column].iloc[-1])
            cut = int(before[-1]) + 1 if len(before) else 0
            if cut:
                yield x[:cut].reset_index(drop=True)
            held, n = [x[cut:]], len(x) - cut
    if n:
        yield pd.concat(held, ignore_index=True)


def _link_rows(radius: int, similarity: float):
    """Links (a, b) that span what the groups' near pairs join; then (a: node, b: group, open) of rows with open pairs."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in whole_groups(batches, "key"):
            keys, node = x["key"].to_numpy(dtype=np.int64), x["node"].to_numpy(dtype=np.int64)
            sketches = sets = root = None
            if "sketch" in x.columns:
                sketches = np.frombuffer(b"".join(x["sketch"]), dtype="<u8").reshape(len(x), SKETCH // 64)
            if "shingles" in x.columns:
                sets = [np.frombuffer(s, dtype="<u8") for s in x["shingles"]]
                of = x.groupby(["key", "root"], sort=False).ngroup().to_numpy()
                root = np.unique(of, return_index=True)[1][of]
            known = root.copy() if root is not None else np.arange(len(x))
            root, unsure = block_links(keys, x["fp"].to_numpy(dtype=np.int64).view(np.uint64), radius, sketches, similarity, root, sets)
            tied = root != known
            yield pd.DataFrame({"a": node[tied], "b": node[root[tied]], "open": False})
            yield pd.DataFrame({"a": node[unsure], "b": keys[unsure], "open": True})

    return run


def split_blocks(x: DataFrame, bound: int, weight: str | None = None) -> DataFrame:
    """``x`` (key, node, ...) with keys of at most about twice ``bound`` rows (or sum of ``weight``).

    A heavier key is dealt into parts by node, and each two parts get a key of their own, so that any
    two of its rows still meet, in tasks of bounded size."""
    size = F.sum(weight) if weight else F.count("*")
    heavy = staged(x.groupBy("key").agg(size.alias("n")).where(F.col("n") > bound), "heavy")
    if not heavy.limit(1).count():
        return x
    parts = F.ceil(F.col("n") / bound).cast("int")
    y = x.join(bounded_broadcast(heavy, 100_000), "key", "left")
    own = F.pmod(F.xxhash64("node", "key"), parts).cast("int")
    others = F.filter(F.sequence(F.lit(0), parts - 1), lambda j: j != own)
    both = F.transform(others, lambda j: F.xxhash64("key", F.least(j, own), F.greatest(j, own)))
    rest = [c for c in x.columns if c != "key"]
    return y.select(F.explode(F.when(F.col("n").isNull(), F.array("key")).otherwise(both)).alias("key"), *rest)


def links(blocked: DataFrame, radius: int, similarity: float = 0.0, block_rows: int = 16_384, partition_rows: int = 250_000) -> DataFrame:
    """Spanning links (a, b: nodes) of near pairs in ``blocked`` (key, node, fp and, if asked for a
    similarity, sketch), and rows with pairs left open (a: node, b: key, open); an exchange by key,
    sized so that a task holds about ``partition_rows``, in groups of ``block_rows``."""
    x = split_blocks(blocked, block_rows)
    n = max(1, -(-blocked.count() // partition_rows))
    wide = max(n, int(blocked.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return x.repartition(wide, "key").sortWithinPartitions("key").mapInPandas(_link_rows(radius, similarity), "a long, b long, open boolean")


def simhash_components(docs: DataFrame, size: int = 4, radius: int = 4, bands: int = 7, **options) -> DataFrame:
    """doc_id, fp (long), component_id (smallest doc_id of the component) of every row."""
    fp = staged(fingerprints(docs, size), "fingerprints")
    own = fp.groupBy("fp").agg(F.min("doc_id").alias("low"))
    masks = F.array(*[F.lit(m).cast("long") for m in band_masks(bands, radius)])
    x = own.select("fp", F.posexplode(masks).alias("t", "mask"))
    x = x.select(F.xxhash64("t", F.col("fp").bitwiseAND(F.col("mask"))).alias("key"), F.col("fp").alias("node"), "fp")
    tied = staged(components(links(x, radius, **options).select("a", "b")), "components")
    own = own.join(tied, own["fp"] == tied["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    own = staged(own, "classes")
    low = own.groupBy("root").agg(F.min("low").alias("component_id"))
    named = own.select(F.col("fp").alias("c_fp"), "root").join(low, "root").select("c_fp", "component_id")
    return fp.join(named, F.col("fp") == F.col("c_fp")).select("doc_id", "fp", "component_id")


def simhash_report(docs: DataFrame) -> DataFrame:
    x = simhash_components(docs)
    return x.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(17))
    mul = rng.integers(0, 1 << 63, count, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return mul, rng.integers(0, 1 << 63, count, dtype=np.uint64)


def _minima(h: np.ndarray, mul: np.ndarray, add: np.ndarray) -> np.ndarray:
    low = np.full(len(mul), _ONES)
    for k in range(0, len(h), 256):
        part = h[k : k + 256, None] * mul[None, :] + add[None, :]
        part ^= part >> np.uint64(29)
        np.minimum(low, part.min(axis=0), out=low)
    return low


def _signature_rows(size: int, bands: int, per_band: int):
    mul, add = _multipliers(bands * per_band)

    def of(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            h = np.unique(shingle_hashes(t, size))  # similarity is of distinct shingles, so is the fingerprint
            rows = _minima(h, mul, add).reshape(bands, per_band)
            out.append((fingerprint(h), [xxhash.xxh64_intdigest(r.tobytes(), k) - (1 << 63) for k, r in enumerate(rows)]))
        return pd.DataFrame(out, columns=["fp", "keys"])

    of.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(of, "struct<fp long, keys array<long>>")


def _sketch_rows(size: int):
    mul, add = _multipliers(SKETCH)

    def of(texts: pd.Series) -> pd.DataFrame:
        out = []
        for t in texts:
            h = np.unique(shingle_hashes(t, size))
            bits = (_minima(h, mul, add) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(63)
            out.append((np.packbits(bits.astype(np.uint8), bitorder="little").tobytes(), h.astype("<u8").tobytes()))
        return pd.DataFrame(out, columns=["sketch", "shingles"])

    of.__annotations__ = {"texts": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(of, "struct<sketch binary, shingles binary>")


def near_duplicates(
    docs: DataFrame, size: int = 5, similarity: float = 0.8, radius: int = 22, bands: int = 10, per_band: int = 2, group_bytes: int = 64 << 20
) -> DataFrame:
    """Distinct texts with the representative of their group: key (SHA-256 of the text, null for
    null), group (a number that the texts of a group share)."""
    texts = docs.select(F.sha2("text", 256).alias("key"), F.col("text"))
    # Copies of a text get one signature row; the digest decides, so no text is shuffled.
    sig = texts.select("key", _signature_rows(size, bands, per_band)(F.col("text")).alias("s")).select("key", "s.*")
    sig = sig.groupBy("key").agg(F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    sig = staged(sig.withColumn("node", F.monotonically_increasing_id()), "signatures")  # numbers hold once written
    x = sig.select("node", F.explode("keys").alias("key"))
    shared = x.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("key")
    x = staged(x.join(shared, "key", "left_semi"), "blocks")
    # Only texts that share a band need a sketch and their set of shingles; one row for all copies.
    few = sig.join(x.select("node").distinct(), "node", "left_semi").select("node", "fp", F.coalesce("key", F.lit("")).alias("c_key"))
    few = staged(few, "candidates")
    some = texts.withColumn("key", F.coalesce("key", F.lit(""))).join(bounded_broadcast(few.select(F.col("c_key").alias("key")), 200_000), "key", "left_semi")
    some = some.select("key", _sketch_rows(size)(F.col("text")).alias("s")).select("key", "s.*")
    some = some.groupBy("key").agg(F.first("sketch").alias("sketch"), F.first("shingles").alias("shingles"))
    candidates, few = few, staged(few.join(some, F.col("c_key") == F.col("key")).select("node", "fp", "sketch", "shingles"), "sketches")
    drop(candidates)

    blocked = x.join(few.select("node", "fp", "sketch"), "node")
    found = staged(links(blocked, radius, similarity), "links")
    drop(x)
    sure = found.where("not open").select("a", "b")
    tied = staged(components(sure), "sure-components")
    # Open pairs: their rows meet again by group, with the sets, where classes still differ.
    left = found.where("open").select(F.col("a").alias("node"), F.col("b").alias("key"))
    left = left.join(tied, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    apart = left.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    left = left.join(apart, "key", "left_semi").join(few.select("node", F.octet_length("shingles").alias("bytes")), "node")
    left = split_blocks(staged(left, "open"), group_bytes, "bytes").drop("bytes")
    wide = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = left.join(few, "node").repartition(wide, "key").sortWithinPartitions("key")
    more = left.mapInPandas(_link_rows(radius, similarity), "a long, b long, open boolean").where("not open").select("a", "b")
    more = staged(more.unionByName(tied.select(F.col("node").alias("a"), F.col("root").alias("b"))), "verified")
    drop(few, found)
    tied = staged(components(more), "components")
    return sig.select("key", "node").join(tied, "node", "left").select("key", F.coalesce("root", "node").alias("group"))


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each near-duplicate group, that with the smallest doc_id (nulls last), with
    the columns of ``docs``. Of rows equal in id and text one stays."""
    groups = near_duplicates(docs, **options)
    ids = docs.select("doc_id", F.sha2("text", 256).alias("g_key"))
    x = ids.join(groups, F.col("g_key").eqNullSafe(F.col("key"))).groupBy("group")
    best = x.agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id"), F.col("g_key"))).alias("b"))
    best = best.select(F.col("b.doc_id").alias("b_id"), F.col("b.g_key").alias("b_key"))
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("g_row"), "doc_id", F.sha2("text", 256).alias("g_key"), F.monotonically_increasing_id().alias("g_uid"))
    kept = named.join(best, F.col("doc_id").eqNullSafe(F.col("b_id")) & F.col("g_key").eqNullSafe(F.col("b_key")))
    repeated = ids.groupBy("doc_id", "g_key").count().where("count > 1").limit(1).count()
    if repeated:
        kept = kept.groupBy("b_id", "b_key").agg(F.min_by("g_row", "g_uid").alias("g_row"))
    return kept.select("g_row.*")
