"""URL rules behind a blocked Bloom filter. DataFrame expressions only.

A rule names a host and a path prefix and fits that host and all its subdomains. A url can only fit rules whose
host is one of its host's suffixes and whose directory is one of its path's directories. These candidate keys
are probed in a blocked Bloom filter of the rules (one 512-bit block per key, eight bits in it); what the filter
passes is joined with the rules by hash, which removes its false positives.

Cases. A null url, or one without ``://``, has an empty host and path and fits rules with an empty host only.
Ports and user names stay in the host. Of several rules that fit, the longest (host and path together) wins;
at equal length block wins over allow. Repeated rows are judged alike; an empty list of rules lets all pass. A url of
any length has as many candidates, at most, as the deepest rule has labels and directories.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = "host string, path string, verdict string"

WORDS = 8
KEYS_PER_BLOCK = 24  # about 21 bits a key
BLOCK_BYTES = 96  # of a filter row in a broadcast table, with its key and row header
BROADCAST_BYTES = 32 << 20


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), "://([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "://[^/?#]*([^?#]*)", 1)


def _key(host: Column, directory: Column) -> Column:
    return F.concat(host, F.lit("\n"), directory)


def _bit(key: Column, i: int) -> Column:
    """The bit of word ``i`` that a key sets: six bits of a second hash."""
    picked = F.shiftright(F.xxhash64(key, F.lit("bits")), 6 * i).bitwiseAND(F.lit(63)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), picked)


def block_count(keys: int) -> int:
    return max(1, -(-keys // KEYS_PER_BLOCK))


def bloom_blocks(keys: DataFrame, blocks: int) -> DataFrame:
    """Column ``key`` -> one row per used block with its words ``w0`` to ``w7``."""
    return keys.groupBy(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block")).agg(
        *[F.bit_or(_bit(F.col("key"), i)).alias(f"w{i}") for i in range(WORDS)]
    )


def might_be_listed(candidates: DataFrame, bloom: DataFrame, blocks: int) -> DataFrame:
    """The candidates (column ``key``) whose eight bits are all set."""
    if blocks * BLOCK_BYTES <= BROADCAST_BYTES:
        bloom = F.broadcast(bloom)
    probed = candidates.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(blocks))).join(bloom, "block")
    passes = F.lit(True)
    for i in range(WORDS):
        bit = _bit(F.col("key"), i)
        passes = passes & (F.col(f"w{i}").bitwiseAND(bit) == bit)
    return probed.where(passes).select(*candidates.columns)


def host_suffixes(host: Column, labels: int) -> Column:
    """The last one to ``labels`` labels of the host."""
    parts = F.split(host, r"\.", -1)
    return F.transform(
        F.sequence(F.lit(1), F.least(F.size(parts), F.lit(labels))),
        lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."),
    )


def directories(path: Column, depth: int) -> Column:
    """The empty prefix and every prefix of the path that ends in one of its first ``depth`` slashes."""
    parts = F.split(path, "/", depth + 1)
    up_to = F.transform(
        F.sequence(F.lit(0), F.size(parts) - 1),
        lambda i: F.when(i == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), i), "/"), F.lit("/"))),
    )
    return F.array_distinct(up_to)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict`` of its column ``url``.

    Urls are judged once per distinct host and path. Both joins of candidates are hash joins on one key; the
    filter is broadcast only while its size, known from the number of rules, is within the limit.
    """
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    split = pages.select(*own, host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))

    listed = rules.select(
        F.coalesce("host", F.lit("")).alias("rule_host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict"
    ).withColumn("key", _key(F.col("rule_host"), F.regexp_extract("rule_path", "(?s)^(.*/)?", 0)))
    # Candidates with more labels or directories than any rule has fit none.
    rule = listed.agg(
        F.count_distinct("key").alias("keys"),
        F.max(F.size(F.split("rule_host", r"\.", -1))).alias("labels"),
        F.max(F.regexp_count("rule_path", F.lit("/"))).alias("depth"),
    ).first()
    blocks = block_count(rule.keys)

    candidates = (
        split.select("host", "path").distinct()
        .withColumn("suffix", F.explode(host_suffixes(F.col("host"), rule.labels or 1)))
        .withColumn("directory", F.explode(directories(F.col("path"), rule.depth or 0)))
        .select("host", "path", _key(F.col("suffix"), F.col("directory")).alias("key"))
    )
    possible = might_be_listed(candidates, bloom_blocks(listed, blocks), blocks)
    fits = possible.join(listed, "key").where(F.startswith(F.col("path"), F.col("rule_path")))
    strength = F.struct(
        F.length(F.concat("rule_host", "rule_path")).alias("length"),
        (F.col("verdict") == "block").alias("blocks"),
        F.concat("rule_host", "rule_path").alias("rule"),
        "verdict",
    )
    best = fits.groupBy("host", "path").agg(F.max(strength).alias("best"))
    return split.join(best, ["host", "path"], "left").select(
        *own, "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict")
    )
