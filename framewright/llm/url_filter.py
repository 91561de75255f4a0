"""URL filter by Bloom filter cascades, in DataFrame operations only.

A rule is a host and a path prefix; it fits its host and all subdomains. A url's keys are its host's suffixes (of up to as
many labels as a rule has) joined with its path's prefixes (of the lengths that rules have). One cascade tells which
keys are rules, another which of these block. Level 0 of a cascade encodes the listed keys; level 1 the other keys of the
corpus that pass level 0; level 2 the listed keys that pass level 1; and so on until nothing passes by mistake. So for every
key of the corpus the first level that a key does not pass tells exactly whether it is listed, and no key is joined to a list.

A level is one row per shard, an array of 64-bit words of bits. Shards hold at most about SHARD_KEYS keys, so a row is
bounded; levels are broadcast while all their words fit BROADCAST_WORDS, else keys meet their shard by a shuffle.

Defined results: a null url, or one without `://`, has empty host and path; a url that no rule fits has no rule and
the cascade's own verdict: none of its keys is listed, so it is allowed; rows that repeat a page_id are judged each on its
own; an empty list allows all; extra columns are ignored.
"""

from __future__ import annotations

from math import ceil, log, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import cut

#: The rules of the query.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Bits per key from level 1 on, and at least on level 0.
BITS_PER_KEY = 12
SHARD_KEYS = 50_000
BROADCAST_WORDS = 1_000_000
MOST_LEVELS = 60


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    raw = F.regexp_extract(rest, "^[^/?#]*", 0)
    after = F.substring(rest, F.length(raw) + 1, F.length(rest))
    return (
        F.coalesce(F.translate(raw, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit("")),
        F.coalesce(F.regexp_extract(after, "^[^?#]*", 0), F.lit("")),
    )


def url_keys(host: Column, path: Column, labels: int, lengths: list[int]) -> Column:
    """All keys of a url that could be a rule's, longest host first."""
    parts = F.split(host, r"\.")
    most = F.least(F.size(parts), F.lit(labels))
    suffixes = F.transform(F.sequence(F.lit(1), most), lambda n: F.array_join(F.slice(parts, F.size(parts) - n + 1, n), "."))
    prefixes = F.array_compact(F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths])) if lengths else F.array().cast("array<string>")
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p)))))


def shard_of(key: Column, shards: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(-1)), F.lit(shards))


def _hashes(bits_per_key: int) -> int:
    return max(1, min(20, round(bits_per_key * log(2))))


class Cascade:
    """Exact membership of the keys of one universe: (keys, bits per key, table of shards) for each level."""

    def __init__(self, levels: list[tuple[int, int, DataFrame]], shards: int):
        self.levels, self.shards = levels, shards

    @classmethod
    def build(cls, universe: DataFrame, listed: DataFrame) -> Cascade:
        """universe and listed hold keys (key); listed keys outside the universe cost space, not exactness."""
        n_listed = listed.count()
        shards = max(1, -(-n_listed // SHARD_KEYS))
        inside = cut(listed.select("key").distinct().withColumn("shard", shard_of(F.col("key"), shards)), "inside")
        # this one comparison while building is what look-ups are spared
        others = universe.select("key").distinct().join(inside.select("key"), "key", "left_anti")
        outside = cut(others.withColumn("shard", shard_of(F.col("key"), shards)), "outside")
        first = max(BITS_PER_KEY, ceil(1.44 * log2(max(2, outside.count()) / max(1, n_listed)))) if n_listed else BITS_PER_KEY
        levels: list[tuple[int, int, DataFrame]] = []
        while len(levels) < MOST_LEVELS:
            even = len(levels) % 2 == 0
            held, rest = (inside, outside) if even else (outside, inside)
            n, bits = held.count(), BITS_PER_KEY if levels else first
            if not n:
                return cls(levels, shards)
            levels.append((n, bits, cut(cls._encode(held, len(levels), bits), "level")))
            passed = cut(cls._pass(rest, len(levels) - 1, *levels[-1]).where("_hit").select("key", "shard"), "passed")
            inside, outside = (inside, passed) if even else (passed, outside)
        raise RuntimeError(f"a cascade of {MOST_LEVELS} levels still passes keys by mistake")

    @staticmethod
    def _bit(level: int, i: int) -> Column:
        return F.pmod(F.xxhash64("key", F.lit(1000 * level + i)), F.col("bits"))

    @classmethod
    def _encode(cls, held: DataFrame, level: int, bits_per_key: int) -> DataFrame:
        """(shard, bits, words) of each shard that holds keys."""
        sizes = held.groupBy("shard").agg((F.ceil(F.count("*") * bits_per_key / 64) * 64).cast("long").alias("bits"))
        bits = F.array(*[cls._bit(level, i) for i in range(_hashes(bits_per_key))])
        spread = held.join(sizes, "shard").select("shard", "bits", F.explode(bits).alias("bit"))
        words = spread.groupBy("shard", "bits", F.expr("bit div 64").alias("at")).agg(F.bit_or(_one_at(F.col("bit"))).alias("word"))
        filled = words.groupBy("shard", "bits").agg(F.map_from_entries(F.collect_list(F.struct("at", "word"))).alias("m"))
        every = F.sequence(F.lit(0).cast("long"), F.expr("bits div 64") - 1)
        return filled.select("shard", "bits", F.transform(every, lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0).cast("long"))).alias("words"))

    @classmethod
    def _pass(cls, keys: DataFrame, level: int, n: int, bits_per_key: int, table: DataFrame) -> DataFrame:
        """keys (key, shard, ...) with _hit: does this level pass the key?"""
        small = n * bits_per_key / 64 <= BROADCAST_WORDS
        table = table.withColumnRenamed("shard", "_shard")
        joined = keys.join(F.broadcast(table) if small else table, F.col("shard") == F.col("_shard"), "left")
        hit = F.col("bits").isNotNull()
        for i in range(_hashes(bits_per_key)):
            bit = cls._bit(level, i)
            hit = hit & (F.get("words", F.floor(bit / 64).cast("int")).bitwiseAND(_one_at(bit)) != 0)
        return joined.withColumn("_hit", F.coalesce(hit, F.lit(False))).drop("_shard", "bits", "words")

    def mark(self, keys: DataFrame, name: str) -> DataFrame:
        """keys (key, ...) with a boolean column `name`: is the key listed?"""
        n = len(self.levels)
        out = keys.withColumn("shard", shard_of(F.col("key"), self.shards)).withColumn("_stop", F.lit(n))
        for i, level in enumerate(self.levels):
            out = self._pass(out, i, *level).withColumn("_stop", F.when((F.col("_stop") == n) & ~F.col("_hit"), F.lit(i)).otherwise(F.col("_stop"))).drop("_hit")
        return out.withColumn(name, F.col("key").isNotNull() & (F.col("_stop") % 2 == 1)).drop("shard", "_stop")


def _one_at(bit: Column) -> Column:
    """1 << (bit % 64) for a bit that differs by row."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))


def filter_urls(pages: DataFrame, rules: DataFrame, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row; rules has (host, path, verdict)."""
    rules = cut(rules.select("host", F.length("path").alias("n"), F.concat("host", "path").alias("key"), "verdict"), "rules")
    labels = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    lengths = sorted(r[0] for r in rules.select("n").distinct().collect())
    host, path = host_and_path(F.col(url))
    found = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = cut(found.withColumn("keys", url_keys(F.col("host"), F.col("path"), labels, lengths)).withColumn("row", F.monotonically_increasing_id()), "urls")
    universe = cut(rows.select(F.explode("keys").alias("key")).distinct(), "universe")
    listed = Cascade.build(universe, rules.select("key"))
    blocks = Cascade.build(rules.select("key"), rules.where("verdict = 'block'").select("key"))
    asked = rows.select("row", "page_id", "host", "path", F.explode_outer("keys").alias("key"))
    marked = blocks.mark(listed.mark(asked, "listed"), "blocks")
    best = F.max(F.when(F.col("listed"), F.struct(F.length("key").alias("n"), "key", "blocks"))).alias("best")
    judged = marked.groupBy("row", "page_id", "host", "path").agg(best)
    verdict = F.when(F.coalesce(F.col("best.blocks"), F.lit(False)), "block").otherwise("allow")
    return judged.select("page_id", "host", "path", F.col("best.key").alias("rule"), verdict.alias("verdict"))


def op9_url_filter(pages: DataFrame) -> DataFrame:
    return filter_urls(pages, pages.sparkSession.createDataFrame(RULES, "host string, path string, verdict string"))


#: DuckDB SQL for the rows of op9_url_filter.
OP9_SQL = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id, coalesce(regexp_extract(rest, '^[^/?#]*'), '') AS raw, rest FROM cut
), split AS (
  SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*'), '') AS path FROM parts
), judged AS (
  SELECT page_id, host, path, CASE
    WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND starts_with(path, '/en/') THEN 'www.example.com/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/en/') THEN 'example.com/en/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/') THEN 'com/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/es/') THEN 'net/es/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/fr/') THEN 'net/fr/' END AS rule FROM split
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('example.com/en/', 'net/es/', 'net/fr/') THEN 'block' ELSE 'allow' END AS verdict FROM judged
"""
