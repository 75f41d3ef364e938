"""Benchmark decontamination: a prefix-filtered set join of benchmark windows and documents.

Benchmark items are cut into windows of ``window`` words (an item of fewer words is one window).
A window is a set of word shingles; it occurs only where all of them do, so one shingle is a
sufficient prefix, and the rarest over all documents is chosen. Documents' shingles join the
prefix shingles by hash; position bounds (the window must start and end inside the document) and
an exact comparison of the window's words confirm a hit.

Only DataFrame functions are used. Documents are never shuffled: windows are broadcast in blocks
of ``block_rows`` rows, as many blocks as the benchmark needs. Per document only its hits travel.

Words: A-Z is lower-cased, words are runs of characters other than ASCII non-alphanumerics.
Defined cases: a null or empty text has no words and no hits; an item without words or a null
item has no window; a null item_id marks words as hit but is no item; repeated rows are judged
one by one; empty tables give zero hits or no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, staged

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    found = F.array_remove(F.split(ascii_lower(text), NOT_WORD), "")
    return F.coalesce(found, F.array().cast("array<string>"))


def item_windows(items: DataFrame, window: int = 8) -> DataFrame:
    """Distinct windows: win (array of words), w_len, w_items (sorted item ids)."""
    x = items.select(F.col("item_id").alias("i_id"), words(F.col("text")).alias("i_words")).where(F.size("i_words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("i_words") - window, F.lit(0)))
    x = x.select("i_id", "i_words", F.explode(starts).alias("i_at"))
    x = x.select("i_id", F.expr(f"slice(i_words, i_at + 1, {window})").alias("win"))
    return x.groupBy("win").agg(F.sort_array(F.collect_set("i_id")).alias("w_items")).withColumn("w_len", F.size("win"))


def _token(ws: str, at: str, k: int) -> Column:
    """The hash of the ``k`` words of column ``ws`` from index ``at`` on; null past the end."""
    parts = [F.expr(f"get({ws}, {at} + {i})") for i in range(k)]
    return F.when(parts[-1].isNotNull(), F.xxhash64(F.lit(k), *parts))


def _positions(docs: DataFrame, sizes: list[int], first: int) -> DataFrame:
    """A row per word position (from ``first``) and shingle size: d_at, tok; keeps d_words."""
    x = docs.withColumn("d_n", F.size("d_words"))
    at = F.when(F.col("d_n") > 0, F.sequence(F.lit(first), F.col("d_n") - 1)).otherwise(
        F.array(F.lit(-1)) if first < 0 else F.array().cast("array<int>")
    )
    x = x.withColumn("d_at", F.explode(at))
    if len(sizes) == 1:
        return x.withColumn("tok", F.when(F.col("d_at") >= 0, _token("d_words", "d_at", sizes[0])))
    toks = F.array(*[_token("d_words", "d_at", k) for k in sizes])
    real = F.filter(toks, lambda t: t.isNotNull())
    one = F.array(F.lit(None).cast("long"))
    return x.withColumn("tok", F.explode(F.when(F.col("d_at") < 0, one).otherwise(real)))


def window_hits(
    docs: DataFrame, items: DataFrame, window: int = 8, shingle: int = 4, block_rows: int = 50_000, sentinel: bool = True
) -> DataFrame:
    """Rows of ``docs`` (which has d_text, a text column) with d_n (its words), h_at, h_len and
    h_items, one per window occurrence; with ``sentinel``, also one per row with null h_at."""
    wins = staged(item_windows(items, window), "windows")
    n = wins.count()
    keep = [c for c in docs.columns if c != "d_text"]
    d = docs.select(*keep, words(F.col("d_text")).alias("d_words"))
    if not n:
        nothing = [F.lit(None).cast("int").alias("h_at"), F.lit(None).cast("int").alias("h_len"), F.lit(None).cast("array<bigint>").alias("h_items")]
        out = d.select(*keep, F.size("d_words").alias("d_n"), *nothing)
        return out if sentinel else out.limit(0)
    sizes = sorted(r[0] for r in wins.select(F.least("w_len", F.lit(shingle)).alias("k")).distinct().collect())  # 1..shingle
    spread = F.sequence(F.lit(0), F.col("w_len") - F.least("w_len", F.lit(shingle)))
    tok = F.coalesce(*[F.when(F.least("w_len", F.lit(shingle)) == k, _token("win", "p_off", k)) for k in sizes])
    cut = wins.withColumn("p_off", F.explode(spread)).withColumn("p_tok", tok)
    blocks = max(1, -(-n // block_rows))
    part = lambda df, c, b: df if blocks == 1 else df.where(F.pmod(F.xxhash64(c), F.lit(blocks)) == b)

    # Rarity of the windows' shingles, counted over all documents.
    vocabulary = cut.select("p_tok").distinct()
    counts = None
    for b in range(blocks):
        seen = _positions(d, sizes, 0).select("tok").join(F.broadcast(part(vocabulary, "p_tok", b)), F.col("tok") == F.col("p_tok"), "left_semi")
        seen = seen.groupBy("tok").agg(F.count("*").alias("df"))
        counts = seen if counts is None else counts.unionByName(seen)
    counts = staged(counts, "rarity")
    ranked = cut.join(counts, F.col("p_tok") == F.col("tok"), "left").groupBy("win").agg(
        F.min_by(F.struct("p_off", "p_tok", "w_len", "w_items"), F.struct(F.coalesce("df", F.lit(0)), "p_off")).alias("p")
    )
    prefix = staged(ranked.select("win", "p.*"), "prefixes")

    out = None
    for b in range(blocks):
        x = _positions(d, sizes, -1 if sentinel and b == 0 else 0)
        start = F.col("d_at") - F.col("p_off")
        fits = (
            (F.col("tok") == F.col("p_tok"))
            & (start >= 0)
            & (start + F.col("w_len") <= F.col("d_n"))
            & (F.expr("slice(d_words, greatest(d_at - p_off, 0) + 1, w_len)") == F.col("win"))
        )
        x = x.join(F.broadcast(part(prefix, "win", b)), fits, "left" if sentinel and b == 0 else "inner")
        x = x.where(F.col("win").isNotNull() | (F.col("d_at") < 0))
        x = x.select(*keep, "d_n", start.alias("h_at"), F.col("w_len").alias("h_len"), F.col("w_items").alias("h_items"))
        out = x if out is None else out.unionByName(x)
    return out


def _covered(hits: Column) -> Column:
    """Words under any of the (at, len) hits; sorted, each adds what lies past the last end."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).alias("n"))
    step = lambda s, h: F.struct(
        F.greatest(s["end"], h["at"] + h["len"]).alias("end"),
        (s["n"] + F.greatest(F.lit(0), h["at"] + h["len"] - F.greatest(s["end"], h["at"]))).alias("n"),
    )
    return F.aggregate(F.sort_array(hits), zero, step, lambda s: s["n"])


def contamination(docs: DataFrame, items: DataFrame, window: int = 8, min_items: int = 2, **options) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_words, n_hit, items (sorted as strings),
    n_items, contaminated (at least ``min_items`` items)."""
    d = docs.select("doc_id", F.col("text").alias("d_text"), F.monotonically_increasing_id().alias("d_uid"))
    x = window_hits(d, items, window, **options)
    hit = F.when(F.col("h_at").isNotNull(), F.struct(F.col("h_at").alias("at"), F.col("h_len").alias("len")))
    x = x.groupBy("d_uid").agg(
        F.first("doc_id").alias("doc_id"), F.max("d_n").cast("long").alias("n_words"), F.collect_set(hit).alias("hits"), F.collect_set("h_items").alias("found")
    )
    ids = F.sort_array(F.transform(F.array_distinct(F.flatten("found")), lambda i: i.cast("string")))
    x = x.select("doc_id", "n_words", _covered(F.col("hits")).cast("long").alias("n_hit"), ids.alias("items"))
    n = F.size("items").cast("long")
    return x.withColumn("n_items", n).withColumn("contaminated", n >= min_items)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 8, min_items: int = 1, **options) -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with the columns of ``docs``. A verdict
    depends on the text alone, so the contaminated texts' digests suffice for an anti-join."""
    light = docs.select(F.sha2("text", 256).alias("d_key"), F.col("text").alias("d_text"))
    hits = window_hits(light, items, window, sentinel=False, **options)
    bad = hits.groupBy("d_key").agg(F.collect_set("h_items").alias("found"))
    bad = bad.where(F.size(F.array_distinct(F.flatten("found"))) >= min_items).select("d_key")
    return docs.join(bad, F.sha2(docs["text"], 256) == bad["d_key"], "left_anti")


def decontamination_report(docs: DataFrame, items: DataFrame) -> DataFrame:
    x = contamination(docs, items)
    return x.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")
