"""URL filters: host-suffix and path-prefix expressions matched by short hash prefixes.

A rule is (host, path, verdict). It fits its host and all subdomains if the URL's path starts
with the rule's path. Each URL is expanded into the host suffixes that can be rule hosts, then,
below a host that has rules, into the path prefixes whose lengths occur there. Expressions meet
rules by an equi-join on the first four bytes of their SHA-256; the full digest confirms a hit,
and the longest rule (host plus path, then host) wins. Of two rules with equal host and path,
``block`` wins.

Defined cases: a null URL, or one without ``://``, has an empty host and path and gets the
default verdict; repeated rows are judged one by one; an empty rule table gives the default
everywhere; a rule with a null host or verdict never fits, a null path counts as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, bounded_broadcast, staged


def url_host(url: Column) -> Column:
    return F.coalesce(ascii_lower(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, url.substr(at + 3, F.length(url)))


def _digest(*parts: Column) -> Column:
    return F.sha2(F.concat_ws("\n", *parts), 256)


def _short(digest: Column) -> Column:
    return F.substring(digest, 1, 8)


def judge_urls(
    pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", broadcast_rows: int = 200_000
) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null if none fits) and ``verdict``.

    Rule tables of up to ``broadcast_rows`` rows (counted first) are broadcast; larger ones are
    shuffled by the hash prefix. Columns of ``pages`` with the names of the results are replaced.
    """
    r = (
        rules.where(F.col("host").isNotNull() & F.col("verdict").isNotNull())
        .select(
            ascii_lower(F.col("host")).alias("r_host"),
            F.coalesce("path", F.lit("")).alias("r_path"),
            F.col("verdict").alias("r_verdict"),
        )
        .groupBy("r_host", "r_path")
        .agg(F.max("r_verdict").alias("r_verdict"))
        .withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path")))
        .withColumn("r_short", _short(F.col("r_digest")))
    )
    hosts = (
        r.groupBy("r_host")
        .agg(F.collect_set(F.length("r_path")).alias("h_lengths"))
        .select(_digest(F.col("r_host")).alias("h_digest"), "h_lengths")
        .withColumn("h_short", _short(F.col("h_digest")))
    )
    labels = [
        x[0]
        for x in r.select(F.size(F.split("r_host", r"\.", -1)).alias("n")).distinct().orderBy("n").collect()
    ]  # as many as a host name of the rules has labels, at most
    # A verdict depends on the URL alone: distinct URLs are judged, and rows meet those that have a rule.
    url = F.col(f"`{url_col}`")
    x = pages.select(url.alias("q_url")).where("q_url is not null").distinct()
    x = x.select("q_url", url_host(F.col("q_url")).alias("q_host"), url_path(F.col("q_url")).alias("q_path"))
    n = F.size(F.split("q_host", r"\.", -1))
    wanted = F.filter(F.array(*[F.lit(k) for k in labels]) if labels else F.array().cast("array<int>"), lambda k: k <= n)
    x = x.withColumn("q_labels", F.explode(wanted)).withColumn("q_suffix", F.expr("substring_index(q_host, '.', -q_labels)"))
    x = x.withColumn("q_hdigest", _digest(F.col("q_suffix")))
    hosts = bounded_broadcast(hosts, broadcast_rows)
    x = x.join(hosts, (_short(F.col("q_hdigest")) == F.col("h_short")) & (F.col("q_hdigest") == F.col("h_digest")))
    x = x.withColumn("q_length", F.explode(F.filter("h_lengths", lambda k: k <= F.length("q_path"))))
    x = x.withColumn("q_digest", _digest(F.col("q_suffix"), F.expr("substring(q_path, 1, q_length)")))
    rr = bounded_broadcast(r, broadcast_rows)
    x = x.join(rr, (_short(F.col("q_digest")) == F.col("r_short")) & (F.col("q_digest") == F.col("r_digest")))
    best = F.max_by(F.struct(F.concat("r_host", "r_path").alias("rule"), F.col("r_verdict").alias("verdict")), F.struct(F.length("r_host") + F.length("r_path"), F.length("r_host")))
    ruled = x.groupBy("q_url").agg(best.alias("q_best"))
    row = F.struct(*[F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]).alias("q_row")
    x = pages.select(row, url.alias("q_own")).join(staged(ruled, "ruled"), F.col("q_own") == F.col("q_url"), "left")
    return x.select(
        "q_row.*",
        url_host(F.col("q_own")).alias("host"),
        url_path(F.col("q_own")).alias("path"),
        F.col("q_best.rule").alias("rule"),
        F.coalesce("q_best.verdict", F.lit(default)).alias("verdict"),
    )


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """The rows of ``pages`` whose URL is allowed, with the columns of ``pages``."""
    judged = judge_urls(pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias("p_row"), F.col(f"`{url_col}`").alias("p_url")), rules, "p_url", default)
    return judged.where("verdict = 'allow'").select("p_row.*")
