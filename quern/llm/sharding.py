"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

Let partition i hold n_i rows and shard j need s_j. The matrix of counts m_ij is drawn from the law
that a uniform permutation of all rows induces: row i is multivariate hypergeometric in what the
shards still need. Rows are permuted within their partition (a local sort by a seeded hash), cut into
runs of m_i1, m_i2, ..., sent to their shards, and permuted again there. So each shard's size is exact
(sizes differ by one row at most) and the whole is a uniform shuffle.

The matrix is drawn by halves: of the rows of two sets of partitions, how many of each shard's come
from the first. All draws of a level are made at once. The second permutation orders a shard by seeded
hashes; ranges of hashes are blocks of about ``block_rows``, as many as the rows ask for, so no task
holds a shard. Driver state: partitions x shards counts; no rows.

Defined cases: null or empty texts have size 1; an empty table gives no rows; repeated rows and
ties are kept, as many as came in; columns that clash with the results are replaced.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_broadcast, staged

OUT = ("shard", "slot")
_LOG_FACTORIAL = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 32)))])


def _tail(x: np.ndarray) -> np.ndarray:
    """What Stirling's formula lacks of log x!, for x of 16 or more."""
    return 1 / (12 * x) - 1 / (360 * x**3) + 1 / (1260 * x**5)


def log_factorial_step(a: np.ndarray, d: np.ndarray) -> np.ndarray:
    """log (a + d)! - log a!, without cancellation where both are large."""
    b = a + d
    x, y = np.maximum(a, 16.0), np.maximum(b, 16.0)
    far = (y - x) * np.log(y) + (x + 0.5) * np.log1p((y - x) / x) - (y - x) + _tail(y) - _tail(x)
    low = lambda v: _LOG_FACTORIAL[np.clip(v, 0, 16).astype(np.int64)]
    return far + low(b) - low(a)  # from 16 on the table's parts cancel


def hypergeometric(rng: np.random.Generator, good: np.ndarray, bad: np.ndarray, n: np.ndarray) -> np.ndarray:
    """How many of ``n`` rows drawn without return are good; arrays of any size of population.

    Rejection under the bound that holds for every log-concave law on integers, a plateau about the
    mode with exponential tails; it needs ratios of probabilities only, exact to double precision."""
    good, bad, n = np.broadcast_arrays(*(np.asarray(v, dtype=np.int64) for v in (good, bad, n)))
    g, b, k = (v.astype(np.float64) for v in (good, bad, n))
    total = np.maximum(g + b, 1.0)
    low, high = np.maximum(0, n - bad), np.minimum(n, good)
    mode = np.clip(np.floor((k + 1) * ((g + 1) / (total + 2))).astype(np.int64), low, high)
    variance = k * (g / total) * (b / total) * (np.maximum(total - k, 0) / np.maximum(total - 1, 1))
    peak = 1 / np.sqrt(1 + 12 * variance)  # no log-concave law's mode is less likely
    width = 1 + peak / 2
    out, todo = mode.copy(), np.flatnonzero(low < high)
    while len(todo):
        w, q, m = width.flat[todo], peak.flat[todo], mode.flat[todo]
        u, v, t = rng.random((3, len(todo)))
        y = np.where(u <= w / (1 + w), v * w, w + rng.exponential(size=len(todo))) / q
        x = np.where(rng.random(len(todo)) < 0.5, -1, 1) * np.rint(y).astype(np.int64)
        at = m + x
        ok = (at >= low.flat[todo]) & (at <= high.flat[todo])
        d, m = np.where(ok, x, 0).astype(np.float64), m.astype(np.float64)
        gs, bs, ks = g.flat[todo], b.flat[todo], k.flat[todo]
        ratio = -log_factorial_step(m, d) - log_factorial_step(gs - m, -d) - log_factorial_step(ks - m, -d) - log_factorial_step(bs - ks + m, d)
        ok &= np.log(t) + np.minimum(0.0, w - q * y) <= ratio
        out.flat[todo[ok]] = at[ok]
        todo = todo[~ok]
    return out


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """Draw the matrix whose row sums are ``counts`` and whose column sums are ``sizes``."""
    rng = np.random.Generator(np.random.PCG64(seed))
    levels = [np.array(counts, dtype=np.int64)]
    while len(levels[-1]) > 1:
        x = np.append(levels[-1], np.zeros(len(levels[-1]) % 2, dtype=np.int64))
        levels.append(x[::2] + x[1::2])
    m = np.array([sizes], dtype=np.int64)
    for below in levels[-2::-1]:
        first = np.zeros_like(m)
        need, pool = below[::2].copy(), m.sum(axis=1)
        for j in range(m.shape[1]):  # a chain of draws: shard j among what is left
            pool = pool - m[:, j]
            first[:, j] = hypergeometric(rng, m[:, j], pool, need)
            need -= first[:, j]
        m = np.stack([first, m - first], axis=1).reshape(-1, m.shape[1])[: len(below)]
    return m


def exact_sizes(total: int, parts: int) -> list[int]:
    return [total // parts + (k < total % parts) for k in range(parts)]


def shard_rows(df: DataFrame, n_shards: int = 16, seed: int = 7, block_rows: int = 100_000) -> DataFrame:
    """``df`` with ``shard`` (0 ..) and ``slot`` (gapless from 0 within the shard).

    ``block_rows`` is about what one task permutes. The input is staged in the shared folder with each
    row's partition and local rank, so that later steps agree on them even if executors are lost.
    """
    keep = [c for c in df.columns if c not in OUT]
    df = df.select(*[F.col(f"`{c}`") for c in keep])
    row = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("s_row")
    x = df.select(row, F.spark_partition_id().alias("s_part"))
    # Local permutation: ids restart in each partition, so after the local sort they are ranks.
    x = x.withColumn("s_key", F.xxhash64(F.lit(seed), F.lit("local"), F.monotonically_increasing_id()))
    x = x.sortWithinPartitions("s_key").drop("s_key")
    x = x.withColumn("s_rank", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    x = staged(x, "shard-input")
    counts = {r[0]: r[1] for r in x.groupBy("s_part").count().collect()}
    parts = sorted(counts)
    total = sum(counts.values())
    spark = df.sparkSession
    if not total:
        return df.select("*", F.lit(0).alias("shard"), F.lit(0).cast("long").alias("slot")).limit(0)
    sizes = exact_sizes(total, n_shards)
    ends = np.cumsum(communication_matrix([counts[p] for p in parts], sizes, seed), axis=1)
    ends = spark.createDataFrame([(p, e) for p, e in zip(parts, ends.tolist(), strict=True)], "s_part int, s_ends array<long>")
    x = x.join(F.broadcast(ends), "s_part")  # partitions x shards numbers, known to the driver
    x = x.withColumn("shard", F.size(F.filter("s_ends", lambda e: e <= F.col("s_rank")))).drop("s_ends")
    blocks = -(-sizes[0] // block_rows)
    x = x.withColumn("s_again", F.xxhash64(F.lit(seed), F.lit("again"), F.col("s_part"), F.col("s_rank")))
    x = x.withColumn("s_block", F.shiftright(F.shiftrightunsigned("s_again", 33) * F.lit(blocks).cast("long"), 31))
    own = x.groupBy("shard", "s_block").count()
    before = F.sum("count").over(Window.partitionBy("shard").orderBy("s_block")) - F.col("count")  # a row per block
    own = own.select(F.col("shard").alias("b_shard"), F.col("s_block").alias("b_block"), before.alias("b_first"))
    x = x.join(bounded_broadcast(own, 200_000), (F.col("shard") == F.col("b_shard")) & (F.col("s_block") == F.col("b_block")))
    w = Window.partitionBy("shard", "s_block").orderBy("s_again", "s_part", "s_rank")
    return x.withColumn("s_no", F.row_number().over(w)).select(
        *[F.col("s_row").getField(c).alias(c) for c in keep], "shard", (F.col("b_first") + F.col("s_no") - 1).alias("slot")
    )


def shard_documents(docs: DataFrame, n_shards: int = 16, seed: int = 7) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    light = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    return shard_rows(light, n_shards, seed).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
