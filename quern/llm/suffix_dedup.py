"""Exact substring dedup by a hash-compared suffix sort.

A byte is removed if some string of ``length`` bytes that covers it also starts anywhere else.

* Anchors. Each window of ``length`` bytes is owned by the smallest ``gram``-byte hash in it (the
  leftmost of equals). Equal windows have the same anchor at the same place, so it is enough to
  compare windows at equal anchors. An anchor whose gram occurs once in all documents is dropped:
  a grouped minimum and maximum tell, no group is gathered.
* Suffix sort. An anchor that is left carries its context, the bytes its windows can cover. Tasks
  sort the contexts twice, as suffixes to the right of the anchor and as reversed prefixes to its
  left, by mergesort in which two suffixes are compared by their longest common extension: binary
  search over prefix polynomial hashes, logarithmic in the length. Neighbours' extensions are
  verified on the bytes; if a hash collided, the task sorts by the bytes themselves.
* Windows. A window that starts d bytes left of its anchor repeats if another context agrees on
  ``length - d`` bytes to the right and d bytes to the left: two runs of common prefixes in the
  two sorted orders, for each d.

Equal contexts, told by their BLAKE2b digests, are collapsed first (they repeat in all their windows),
equal texts likewise. A group of more than ``group_contexts`` different contexts is not sorted in one
task but split by content: a window about a core of n bytes holds, of the ``length - n`` others, half
to the core's left or half to its right, so each context goes on with one or both of two longer cores,
and equal windows stay together. A core grows to a whole window in about log2(length) rounds at most;
such windows are compared as they are.

Defined cases: a null text is empty; texts shorter than ``length`` have no windows and lose
nothing; matches never cross documents; strings are judged on the input; repeated rows repeat each
other's strings; an empty table gives no rows; a text's length is bounded by memory only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import hashing as H
from .common import bounded_broadcast, drop, skew_join, staged

ANCHOR_SCHEMA = "gram long, tid binary, pos long, first long, last long"
CONTEXT_SCHEMA = "gram long, ctx_key binary, tid binary, pos long, d_low long, d_high long, ctx binary"
HIT_SCHEMA = "gram long, ctx_key binary, d_from long, d_to long"


def _bytes(text) -> np.ndarray:
    return np.frombuffer(text.encode("utf-8", "replace") if isinstance(text, str) else b"", dtype=np.uint8)


def anchors(raw: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Gram hashes and positions of the anchors, and the first and last window each one owns."""
    none = np.zeros(0, dtype=np.int64)
    if len(raw) < length:
        return none, none, none, none
    h = H.mix(H.windows(H.prefixes(H.VALUE[raw]), gram))
    at = H.window_minima(h, length - gram + 1)
    first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
    last = np.append(first[1:], len(at)) - 1
    return h[at[first]].view(np.int64), at[first], first, last


def _anchor_rows(length: int, gram: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cols, tids, held = [], [], 0
            for tid, text in zip(b["tid"], b["text"], strict=True):
                a = anchors(_bytes(text), length, gram)
                if len(a[0]):
                    cols.append(a)
                    tids.append((tid, len(a[0])))
                    held += len(a[0])
                if held > 100_000:
                    yield _anchor_frame(cols, tids)
                    cols, tids, held = [], [], 0
            if held:
                yield _anchor_frame(cols, tids)

    return run


def _anchor_frame(cols: list, tids: list) -> pd.DataFrame:
    g, p, f, t = (np.concatenate(x) for x in zip(*cols, strict=True))
    return pd.DataFrame({"gram": g, "tid": [t_ for t_, n in tids for _ in range(n)], "pos": p, "first": f, "last": t})


def _context_rows(length: int):
    """Contexts of the anchors of each text. Bytes go with the first of equal contexts that a task
    sees; copies of a text that follow each other are passed over."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, before = set(), None
        for b in batches:
            rows, held = [], 0
            for tid, text, found in zip(b["tid"], b["text"], b["found"], strict=True):
                if tid == before:
                    continue
                before = tid
                raw = text.encode("utf-8", "replace")
                pos = np.array([x["pos"] for x in found], dtype=np.int64)
                d_high = pos - np.array([x["first"] for x in found], dtype=np.int64)
                d_low = pos - np.array([x["last"] for x in found], dtype=np.int64)
                low, high = pos - d_high, pos - d_low + length
                for i, x in enumerate(found):
                    ctx = raw[low[i] : high[i]]
                    k = hashlib.blake2b(ctx, digest_size=16, salt=b"%d" % d_high[i]).digest()  # its length tells d_low
                    new = k not in seen
                    if new and len(seen) < 500_000:
                        seen.add(k)
                    rows.append((x["gram"], k, tid, int(pos[i]), int(d_low[i]), int(d_high[i]), ctx if new else None))
                    held += len(ctx) if new else 0
                if held > 8 << 20:
                    yield pd.DataFrame(rows, columns=["gram", "ctx_key", "tid", "pos", "d_low", "d_high", "ctx"])
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=["gram", "ctx_key", "tid", "pos", "d_low", "d_high", "ctx"])

    return run


def common_extension(prefix: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Longest common prefixes of rows ``a`` and ``b``: binary search over their prefix hashes."""
    low, high = np.zeros(len(a), dtype=np.int64), np.minimum(size[a], size[b])
    while True:
        open_ = low < high
        if not open_.any():
            return low
        mid = (low + high + 1) // 2
        same = prefix[a, mid] == prefix[b, mid]
        low = np.where(same & open_, mid, low)
        high = np.where(same | ~open_, high, mid - 1)


def _before(text: np.ndarray, prefix: np.ndarray, size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether row a sorts before row b; of equals the lower row."""
    n = common_extension(prefix, size, a, b)
    end_a, end_b = n >= size[a], n >= size[b]
    last = text.shape[1] - 1
    x, y = text[a, np.minimum(n, last)], text[b, np.minimum(n, last)]
    return np.where(end_a & end_b, a < b, np.where(end_a | end_b, end_a, x < y))


def suffix_sort(text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of the rows of ``text`` (zero-padded, ``size`` bytes each) and the verified common
    prefix of each with the one before it in that order (0 for the first)."""
    m = len(text)
    prefix = H.prefixes(H.VALUE[text])
    order = np.arange(m)
    width = 1
    while width < m:
        # All pairs of neighbouring runs merge at once: an item's place is its place in its own
        # run plus the number of items of the other run that sort before it, by binary search.
        index = np.arange(m)
        block = index // (2 * width) * (2 * width)
        left = index - block < width
        other = np.where(left, block + width, block)
        stop = np.where(left, np.minimum(block + 2 * width, m), np.minimum(block + width, m))
        other = np.minimum(other, m)
        low, high = other.copy(), np.maximum(stop, other)
        while True:
            open_ = np.flatnonzero(low < high)
            if not len(open_):
                break
            mid = (low[open_] + high[open_]) // 2
            less = _before(text, prefix, size, order[mid], order[open_])
            low[open_] = np.where(less, mid + 1, low[open_])
            high[open_] = np.where(less, high[open_], mid)
        own = np.where(left, index - block, index - block - width)
        place = block + own + (low - other)
        merged = np.empty_like(order)
        merged[place] = order
        order = merged
        width *= 2
    lcp = np.zeros(m, dtype=np.int64)
    if m > 1:
        lcp[1:] = common_extension(prefix, size, order[:-1], order[1:])
        true = _byte_lcp(text, size, order)
        if (true != lcp).any():  # a hash collided: sort by the bytes
            order = np.array(sorted(range(m), key=lambda i: (text[i, : size[i]].tobytes(), i)), dtype=np.int64)
            lcp = _byte_lcp(text, size, order)
    return order, lcp


def _byte_lcp(text: np.ndarray, size: np.ndarray, order: np.ndarray) -> np.ndarray:
    out = np.zeros(len(order), dtype=np.int64)
    for k in range(1, len(order), 4096):
        a, b = order[k - 1 : k + 4095][: len(order) - k], order[k : k + 4096]
        a = a[: len(b)]
        differ = text[a] != text[b]
        n = np.where(differ.any(axis=1), differ.argmax(axis=1), text.shape[1])
        out[k : k + len(b)] = np.minimum(n, np.minimum(size[a], size[b]))
    return out


def repeated_windows(contexts: list[bytes], d_low: np.ndarray, d_high: np.ndarray, length: int) -> list[list[tuple[int, int]]]:
    """Ranges of d whose windows occur in another of the (different) contexts as well."""
    m = len(contexts)
    left_n, right_n = d_high.astype(np.int64), np.array([len(c) for c in contexts], dtype=np.int64) - d_high
    right = np.zeros((m, int(right_n.max(initial=0)) or 1), dtype=np.uint8)
    left = np.zeros((m, int(left_n.max(initial=0)) or 1), dtype=np.uint8)
    for i, c in enumerate(contexts):
        row = np.frombuffer(c, dtype=np.uint8)
        right[i, : right_n[i]] = row[d_high[i] :]
        left[i, : left_n[i]] = row[: d_high[i]][::-1]
    r_order, r_lcp = suffix_sort(right, right_n)
    l_order, l_lcp = suffix_sort(left, left_n)
    low, high = int(d_low.min(initial=0)), int(d_high.max(initial=-1))
    hit = np.zeros((m, high - low + 2), dtype=bool)
    r_class, l_class = np.empty(m, dtype=np.int64), np.empty(m, dtype=np.int64)
    for d in range(low, high + 1):
        on = np.flatnonzero((d_low <= d) & (d <= d_high))
        if len(on) < 2:
            continue
        r_class[r_order] = np.cumsum(r_lcp < length - d)
        l_class[l_order] = np.cumsum(l_lcp < d)
        key = r_class[on] * (m + 1) + l_class[on]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        twin = np.zeros(len(on), dtype=bool)
        twin[by[1:]] |= same
        twin[by[:-1]] |= same
        hit[on[twin], d - low] = True
    return [_runs(h, low) for h in hit]


def _runs(hit: np.ndarray, low: int) -> list[tuple[int, int]]:
    if not hit.any():
        return []
    edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
    return [(int(a) + low, int(b) + low - 1) for a, b in edges.reshape(-1, 2)]


def _sort_rows(length: int, batch: int):
    """Contexts ordered by group (key) arrive; whole groups are sorted together, several at a time."""

    def flush(rows: list) -> pd.DataFrame:
        # Groups in which only one context is left have no other to repeat in, so hits never span groups:
        # contexts of different groups differ within the core that all their windows hold.
        found = repeated_windows([r[1] for r in rows], np.array([r[2] for r in rows]), np.array([r[3] for r in rows]), length)
        out = [(r[4], r[0], a, b) for r, runs in zip(rows, found, strict=True) for a, b in runs]
        return pd.DataFrame(out, columns=["gram", "ctx_key", "d_from", "d_to"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, group, keys = [], [], set()
        before = None
        for b in batches:
            for key, g, k, ctx, lo, hi in zip(b["key"], b["gram"], b["ctx_key"], b["ctx"], b["d_low"], b["d_high"], strict=True):
                if key != before:
                    if len(group) > 1:  # an only context has no other to repeat in
                        rows += group
                        if len(rows) >= batch:
                            yield flush(rows)
                            rows = []
                    before, group, keys = key, [], set()
                if k not in keys:
                    keys.add(k)
                    group.append((k, ctx, lo, hi, g))
        if len(group) > 1:
            rows += group
        if rows:
            yield flush(rows)

    return run


def _part(c: Column, start: Column, size: Column) -> Column:
    """``size`` bytes of a binary column from the 0-based ``start``."""
    return F.substring(c, (start + 1).cast("int"), size.cast("int"))


def _split(x: DataFrame, length: int) -> DataFrame:
    """Contexts (key, gram, ctx_key, ctx, d_low, d_high, c_left, c_right) with their cores grown: the core is
    ``c_left`` bytes before the anchor and ``c_right`` from it on, and every window of d_low .. d_high holds it."""
    half = F.expr(f"({length} - c_left - c_right + 1) div 2").cast("long")
    far = F.col("c_left") + half  # windows that start so far to the left, and the others
    cases = F.array(
        F.struct(F.greatest("d_low", far).alias("d_low"), F.col("d_high").alias("d_high"), far.alias("c_left"), F.col("c_right").alias("c_right")),
        F.struct(F.col("d_low").alias("d_low"), F.least("d_high", far - 1).alias("d_high"), F.col("c_left").alias("c_left"), (length - far + 1).alias("c_right")),
    )
    y = x.select("gram", "ctx_key", "ctx", F.col("d_high").alias("was"), F.explode(cases).alias("c")).where("c.d_low <= c.d_high")
    y = y.select("gram", "ctx_key", _part(F.col("ctx"), F.col("was") - F.col("c.d_high"), F.col("c.d_high") - F.col("c.d_low") + length).alias("ctx"), "c.*")
    return y.withColumn("key", F.xxhash64("gram", "c_left", "c_right", _part(F.col("ctx"), F.col("d_high") - F.col("c_left"), F.col("c_left") + F.col("c_right"))))


def _cut_rows():
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "kept_sha256"]
        for b in batches:
            rows, held = [], 0
            for doc_id, text, whole, spans in zip(b["doc_id"], b["text"], b["whole"], b["spans"], strict=True):
                raw = text.encode("utf-8", "replace")
                runs = [(0, len(raw))] if whole else merge_spans([(s["from"], s["to"]) for s in spans] if spans is not None else [])
                kept, at = [], 0
                for a, z in runs:
                    kept.append(raw[at:a])
                    at = z
                rest = b"".join([*kept, raw[at:]])
                rows.append((doc_id, len(raw), len(raw) - len(rest), len(runs), rest, hashlib.sha256(rest).hexdigest()))
                held += len(rest)
                if held > 8 << 20:
                    yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})
                    rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=names).astype({"doc_id": "Int64"})

    return run


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for a, z in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], z)
        else:
            out.append([a, z])
    return [(a, z) for a, z in out]


def repeated_spans(docs: DataFrame, length: int = 400, gram: int = 100, group_contexts: int = 4_000, batch: int = 3_000) -> DataFrame:
    """``docs``: tid (digest of the text), text. (tid, spans: array of from, to) of the texts with
    bytes under a string that starts elsewhere in the texts, each text taken once."""
    spark = docs.sparkSession
    long_ = docs.where(F.octet_length("text") >= length)
    a = staged(long_.mapInPandas(_anchor_rows(length, gram), ANCHOR_SCHEMA), "anchors")
    # The same (text, position) may come from several copies; another one gives another number.
    place = F.xxhash64("tid", "pos")
    twice = a.groupBy("gram").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.count("*").alias("n")).where("lo < hi")
    twice = staged(twice.select("gram", "n"), "shared-grams")
    left = skew_join(a, twice, ["gram"], "left_semi", "n")
    found = left.groupBy("tid").agg(F.collect_set(F.struct("gram", "pos", "first", "last")).alias("found"))
    x = long_.join(found.withColumnRenamed("tid", "f_tid"), F.col("tid") == F.col("f_tid")).select("tid", "text", "found")
    c = staged(x.mapInPandas(_context_rows(length), CONTEXT_SCHEMA), "contexts")
    drop(a, twice)
    thin = c.select("gram", "ctx_key", "tid", "pos", "d_low", "d_high")

    # Contexts that occur at two places repeat in all their windows.
    same = thin.groupBy("gram", "ctx_key").agg(F.min(place).alias("lo"), F.max(place).alias("hi"), F.first("d_low").alias("d_from"), F.first("d_high").alias("d_to"))
    same = same.where("lo < hi").select("gram", "ctx_key", "d_from", "d_to")

    todo = c.where("ctx is not null").select(F.col("gram").alias("key"), "gram", "ctx_key", "ctx", "d_low", "d_high", F.lit(0).cast("long").alias("c_left"), F.lit(gram).cast("long").alias("c_right"))
    wide = max(int(spark.conf.get("spark.sql.shuffle.partitions")), c.count() // 20_000)
    hits = []
    while True:
        many = staged(todo.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > group_contexts).select("key"), "many")
        some = many.limit(1).count() > 0
        few = todo.join(bounded_broadcast(many, 100_000), "key", "left_anti") if some else todo
        few = few.select("key", "gram", "ctx_key", "ctx", "d_low", "d_high").repartition(wide, "key").sortWithinPartitions("key")
        hits.append(staged(few.mapInPandas(_sort_rows(length, batch), HIT_SCHEMA), "hits"))
        if not some:
            break
        hot = todo.join(bounded_broadcast(many, 100_000), "key", "left_semi").dropDuplicates(["key", "ctx_key"])
        hot = staged(_split(hot, length), "split")
        todo, done = hot.where(F.col("c_left") + F.col("c_right") < length), hot.where(F.col("c_left") + F.col("c_right") >= length)
        # Cores that are whole windows: the bytes themselves are grouped.
        both = done.groupBy("ctx").agg(F.min("ctx_key").alias("lo"), F.max("ctx_key").alias("hi")).where("lo < hi").select("ctx")
        hits.append(staged(skew_join(done.select("ctx", "gram", "ctx_key", "d_low", "d_high"), staged(both, "both"), ["ctx"], "left_semi").select("gram", "ctx_key", F.col("d_low").alias("d_from"), F.col("d_high").alias("d_to")), "hits"))
    for h in hits:
        same = same.unionByName(h)
    same = staged(same, "hits")
    spans = skew_join(thin, same, ["gram", "ctx_key"])
    span = F.struct((F.col("pos") - F.col("d_to")).alias("from"), (F.col("pos") - F.col("d_from") + length).alias("to"))
    return spans.groupBy("tid").agg(F.collect_set(span).alias("spans"))


def cut_repeats(docs: DataFrame, length: int = 400, **options) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes), kept_sha256 per row."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    d = d.withColumn("tid", F.unhex(F.md5("text")))
    spans = repeated_spans(d.select("tid", "text"), length, **options).withColumn("whole", F.lit(False))
    # A text with copies repeats in all its strings.
    copies = d.where(F.octet_length("text") >= length).groupBy("tid").agg(F.count("*").alias("n")).where("n > 1")
    copies = copies.select("tid", F.lit(None).cast("array<struct<from:bigint,to:bigint>>").alias("spans"), F.lit(True).alias("whole"))
    cuts = spans.unionByName(copies).groupBy("tid").agg(F.max("whole").alias("whole"), F.first("spans", ignorenulls=True).alias("spans"))
    cuts = staged(cuts.select(F.col("tid").alias("c_tid"), "whole", "spans"), "cuts")
    x = d.join(cuts, F.col("tid") == F.col("c_tid"), "left")
    x = x.select("doc_id", "text", F.coalesce("whole", F.lit(False)).alias("whole"), "spans")
    return x.mapInPandas(_cut_rows(), "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, kept_sha256 string")


def suffix_report(docs: DataFrame) -> DataFrame:
    return cut_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
