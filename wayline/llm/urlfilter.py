"""URL filter: a blocked Bloom filter of listed canonical entries lets possible hits through to an exact hash join.

An entry is a host and a path prefix. It fits its host and all subdomains, where the path of the url starts with the
prefix; the longest fitting entry decides. Whatever fits no entry gets the default verdict.

Scale: verdicts are found once for each distinct (host, path), so a host with a third of all rows costs one lookup
for each of its paths. The filter has BLOCKS words however long the list is, which bounds what is broadcast; a longer
list only raises the share of false hits, and the exact join drops those.

Defined results: null url, or no "://": empty host and path, hence the default verdict. Repeated and null page_ids
keep one row each. Entries with a null or empty host are left out; of equal entries that disagree, block wins. Very long urls are judged whole. An
empty table gives no rows, an empty list the default verdict for all. Columns besides those named, whatever their names, are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: 64-bit words of the filter: 16384 words are 128 KB, a bound on the broadcast.
BLOCKS = 1 << 14
#: Bits that each key sets inside its block.
BITS = 4


def host_of(url: Column) -> Column:
    """What stands between the first :// and the next /, ? or #, with A-Z lower-cased."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), upper, lower), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ? or #."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _block(key: Column) -> Column:
    return F.pmod(F.xxhash64(F.lit("block"), key), F.lit(BLOCKS))


def _mask(key: Column) -> Column:
    """The bits of a key inside its block, taken from disjoint parts of one hash."""
    h, mask = F.xxhash64(F.lit("bits"), key), None
    for i in range(BITS):
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(h, 6 * i).bitwiseAND(F.lit(63).cast("long")).cast("int"))
        mask = bit if mask is None else mask.bitwiseOR(bit)
    return mask


def canonical(rules: DataFrame) -> DataFrame:
    """One row for each listed entry: key, host_len, path_len, rule, verdict."""
    host = F.translate(F.col("host"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.coalesce(F.col("path"), F.lit(""))
    return rules.filter(F.length("host") > 0).groupBy(host.alias("h"), path.alias("p")).agg(F.max("verdict").alias("verdict")).select(
        F.concat("h", F.lit("\n"), "p").alias("key"), F.length("h").alias("host_len"), F.length("p").alias("path_len"), F.concat("h", "p").alias("rule"), "verdict"
    )


def bloom(listed: DataFrame) -> DataFrame:
    """The filter as rows (block, word), at most BLOCKS of them."""
    return listed.groupBy(_block(F.col("key")).alias("block")).agg(F.bit_or(_mask(F.col("key"))).alias("word"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", key: str = "page_id") -> DataFrame:
    """pages (key, url) -> key, host, path, rule, verdict. rules: host, path, verdict ("allow" or "block")."""
    seen = pages.select(F.col(key), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    listed = canonical(rules)
    # The lengths that listed hosts and paths have: a few numbers, and the longest bounds how many there can be. However many labels a host has, only
    # its endings of those lengths are tried, where a label begins.
    lengths = listed.agg(F.array_sort(F.collect_set("host_len")).alias("host_lengths"), F.array_sort(F.collect_set("path_len")).alias("lengths"))
    begins = lambda x: (x == F.length("host")) | ((x < F.length("host")) & (F.substring(F.col("host"), -x - 1, F.lit(1)) == "."))
    tried = (
        seen.select("host", "path").filter(F.length("host") > 0).distinct()
        .join(F.broadcast(lengths))
        .withColumn("host_length", F.explode(F.filter("host_lengths", begins)))
        .withColumn("length", F.explode(F.filter("lengths", lambda x: x <= F.length("path"))))
        .select("host", "path", F.concat(F.expr("right(host, host_length)"), F.lit("\n"), F.expr("substring(path, 1, length)")).alias("key"))
        .withColumn("block", _block(F.col("key")))
    )
    possible = tried.join(F.broadcast(bloom(listed)), "block").filter(F.col("word").bitwiseAND(_mask(F.col("key"))) == _mask(F.col("key")))
    sure = possible.join(listed, "key")
    best = sure.groupBy("host", "path").agg(F.max(F.struct(F.expr("host_len + path_len").alias("long"), "host_len", "rule", "verdict")).alias("best"))
    return seen.join(best, ["host", "path"], "left").select(
        key, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
