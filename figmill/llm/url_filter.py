"""URL filter: a blocked Bloom filter of listed keys, then an exact hash join.

A listed entry is a canonical host and a path prefix. A page can only fit an
entry whose host is one of its host's suffixes and whose path is one of its
path's prefixes with a listed length, so each page has a few candidate keys.
The Bloom filter (one 512-bit block a key) passes the keys that may be listed;
the exact join on host and path removes the false ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from figmill.llm.bloom import build_filter, probe
from figmill.llm.common import ascii_lower, saved

#: Tasks that the pages of one key are dealt to.
SALTS = 8


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://``."""
    return F.coalesce(ascii_lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def path_of(url: Column) -> Column:
    """From the host's end up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _key(host: Column, path: Column) -> Column:
    return F.xxhash64(host, F.lit("\x00"), path)


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """Judge every url of ``pages(page_id, url)``: page_id, host, path, rule, verdict, listed.

    ``rules(host, path, verdict)``: a rule fits its host and all subdomains if the
    url's path starts with the rule's; the longest fitting one (host and path
    characters; ties by text) decides. Without one the ``listed(host, path)``
    entries decide, which fit alike: block if one fits, else allow. Null urls and
    urls without ``://`` have empty host and path and fit nothing but entries
    with both empty. Repeated rows are judged each; repeated entries count once,
    for the verdict's first in text order; other columns are ignored.
    """
    entries = rules.select("host", "path", "verdict").unionByName(listed.select("host", "path", F.lit(None).cast("string").alias("verdict")))
    entries = entries.select(ascii_lower(F.coalesce("host", F.lit(""))).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict")
    entries = saved(entries.groupBy("host", "path").agg(F.min("verdict").alias("rule_verdict"), F.max(F.col("verdict").isNull()).alias("in_list")).withColumn("h", _key(F.col("host"), F.col("path"))), "url-list")
    lengths = sorted(r[0] for r in entries.select(F.length("path")).distinct().collect())  # a url has few lengths
    words = build_filter(entries)

    rows = pages.select(F.col("page_id"), F.col("url"))
    rows = saved(rows.select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), F.monotonically_increasing_id().alias("row")), "urls")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    prefixes = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path"))
    keys = rows.select("row", F.explode(suffixes).alias("host"), "path").select("row", "host", F.explode(F.transform(prefixes, lambda n: F.substring(F.col("path"), F.lit(1), n))).alias("path")) if lengths else rows.select("row", "host", "path").limit(0)
    hits = keys.withColumn("h", _key(F.col("host"), F.col("path"))).filter(probe(words)("h"))
    # one host may have a third of all pages: its key is dealt to SALTS tasks
    salted = entries.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    fits = hits.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int")).join(salted.drop("h"), ["host", "path", "salt"])
    best = fits.groupBy("row").agg(
        F.max(F.when(F.col("rule_verdict").isNotNull(), F.struct(F.length(F.concat("host", "path")).alias("n"), F.concat("host", "path").alias("rule"), F.col("rule_verdict").alias("verdict")))).alias("best"),
        F.max("in_list").alias("listed"),
    )
    listed_too = F.coalesce("listed", F.lit(False))
    return rows.join(best, "row", "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.when(listed_too, "block").otherwise("allow")).alias("verdict"), listed_too.alias("listed"))
