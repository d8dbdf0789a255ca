"""URL filters: a cascade of Bloom filters that is exact over the corpus's keys."""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, table

#: Bits of the filters of one pass: they travel in the plan. A list that needs more is judged in several passes.
MOST_BITS = 1 << 25
#: Words of a filter that come to the driver in one string.
CHUNK = 1 << 10

# The rules of the contract, and the names and zones of sites with unwanted pages.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
BLOCKED_SITES = ("cheap-pills", "free-bets", "spam-farm", "adult-x", "casino-win", "ads-track")
BLOCKED_ZONES = ("example.com", "example.net", "example.org")
#: The listed hosts: such a site keeps its name when it moves to another zone.
BLOCKED_HOSTS = tuple(f"{site}.{zone}" for site in BLOCKED_SITES for zone in BLOCKED_ZONES)


def host_of(url: Column) -> Column:
    """From the first :// to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """From the end of the host to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_suffixes(host: Column) -> Column:
    """The host and its parent domains, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda at: F.array_join(F.slice(labels, at, F.size(labels)), "."))


def candidate_keys(host: Column, path: Column, lengths: list[int]) -> Column:
    """Keys under which a list can name a url: each host suffix with each path prefix of these lengths."""
    prefixes = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths])
    kept = F.filter(prefixes, lambda prefix: prefix.isNotNull())
    return F.flatten(F.transform(host_suffixes(host), lambda suffix: F.transform(kept, lambda prefix: F.concat(suffix, prefix))))


def _positions(key: Column, level: int, bits: int, hashes: int) -> Column:
    """The places of a key's bits, by double hashing that differs from level to level."""
    first = F.xxhash64(F.lit(level), key).bitwiseAND(F.lit(0x7FFFFFFF))
    second = F.hash(F.lit(level), key).bitwiseAND(F.lit(0x7FFFFFFF)).cast("long").bitwiseOR(F.lit(1).cast("long"))
    return F.array(*[(first + second * F.lit(at).cast("long")) % F.lit(bits).cast("long") for at in range(hashes)])


@dataclass(frozen=True)
class Level:
    """A Bloom filter; ``words`` are its bits as longs in a string, which Spark folds into one literal."""

    number: int
    bits: int
    hashes: int
    words: str

    def might_hold(self, key: Column) -> Column:
        words = F.split(F.lit(self.words), ",").cast("array<bigint>")
        is_set = lambda at: F.getbit(F.get(words, F.shiftright(at, 6).cast("int")), at.bitwiseAND(F.lit(63).cast("long")).cast("int")) == 1
        return F.forall(_positions(key, self.number, self.bits, self.hashes), is_set)


@dataclass(frozen=True)
class Cascade:
    """Exact membership for every key of the universe that it was built over.

    A key is listed if the first level that lacks it is an odd one (counted from 0):
    even levels hold listed keys, odd levels hold the keys that slipped through the
    level before. ``rest`` is the verdict on keys that every level holds.
    """

    levels: tuple[Level, ...]
    rest: bool

    def holds(self, key: Column) -> Column:
        verdict = F.lit(self.rest)
        for level in reversed(self.levels):
            verdict = F.when(level.might_hold(key), verdict).otherwise(F.lit(level.number % 2 == 1))
        return verdict


def _hashes(rate: float) -> int:
    return max(1, math.ceil(-math.log2(rate)))


def _bits(keys: int, hashes: int) -> int:
    """Bits at which a filter of that many keys lets 2**-hashes of others through."""
    return 64 * max(1, math.ceil(keys * hashes / math.log(2) / 64))


def _by_cascade(values: dict[int, Column]) -> Column:
    out = F
    for number, value in values.items():
        out = out.when(F.col("cascade") == number, value)
    return out


def _first_rate(listed: int, others: int) -> float:
    """As many others slip through the first level as keys are listed, so what follows does not grow with the universe."""
    return min(0.5, listed / others) if others else 0.5


def cascades(keys: DataFrame, *, rate: float = 1 / 16) -> dict[int, Cascade]:
    """The cascades of ``keys`` (cascade int, key, is_listed; each key once a cascade), all built level by level together.

    The first level is sized by the listed keys and by their share of the universe, later ones by the keys that are
    left, of which a share ``rate`` slips through: filters grow with the list, and with the logarithm of the universe. A level is one
    aggregation of set bits, one write of the keys that are left, and one count of them. A cascade without listed keys has no level and
    holds nothing; a null key is one like any other; very long keys are hashed whole; an empty table gives no cascade.
    """

    def count(left: DataFrame) -> dict[int, tuple[int, int]]:
        return {r.cascade: (r.listed, r.others) for r in left.groupBy("cascade").agg(F.count_if("is_listed").alias("listed"), F.count_if(~F.col("is_listed")).alias("others")).collect()}

    levels: dict[int, list[Level]] = defaultdict(list)
    rest: dict[int, bool] = defaultdict(bool)
    left, number = keys, 0
    counts = count(left)
    while counts:
        # Where one side is left alone, its verdict ends the cascade.
        ended = {c: bool(listed) for c, (listed, others) in counts.items() if not listed or not others}
        rest |= ended
        counts = {c: n for c, n in counts.items() if c not in ended}
        if not counts:
            break
        member = F.col("is_listed") if number % 2 == 0 else ~F.col("is_listed")
        shape = {}
        for c, (listed, others) in counts.items():
            hashes = _hashes(rate if number else _first_rate(listed, others))
            shape[c] = _bits((listed, others)[number % 2], hashes), hashes
        places = _by_cascade({c: _positions(F.col("key"), number, *size) for c, size in shape.items()})
        at = left.where(member & F.col("cascade").isin(*shape)).select("cascade", F.explode(places).alias("at"))
        bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("at").bitwiseAND(F.lit(63).cast("long")).cast("int"))
        words = at.groupBy("cascade", F.shiftright("at", 6).alias("word")).agg(F.bit_or(bit).alias("bits"))
        text = F.array_join(F.collect_list(F.concat(F.col("word").cast("string"), F.lit(" "), F.col("bits").cast("string"))), ",")
        filters = {c: ["0"] * (bits // 64) for c, (bits, _) in shape.items()}
        for row in words.groupBy("cascade", F.floor(F.col("word") / CHUNK)).agg(text.alias("text")).toLocalIterator():
            for pair in row.text.split(","):
                word, value = pair.split(" ")
                filters[row.cascade][int(word)] = value
        built = {c: Level(number, *shape[c], ",".join(filters[c])) for c in shape}
        for c, level in built.items():
            levels[c].append(level)
        slips = _by_cascade({c: level.might_hold(F.col("key")) for c, level in built.items()})
        left = materialize(left.where(slips), "left")  # null, for cascades that have ended, is no
        counts = count(left)
        number += 1
    return {c: Cascade(tuple(levels[c]), rest[c]) for c in {*levels, *rest}}


def build(universe: DataFrame, listed: DataFrame, *, rate: float = 1 / 16) -> Cascade:
    """A cascade for the keys of ``listed`` over ``universe`` (both with a string column key). Null keys are left out."""
    both = universe.select("key", F.lit(False).alias("is_listed")).unionByName(listed.select("key", F.lit(True).alias("is_listed")))
    keys = both.where(F.col("key").isNotNull()).groupBy("key").agg(F.max("is_listed").alias("is_listed"))
    return cascades(materialize(keys.withColumn("cascade", F.lit(0)), "keys"), rate=rate).get(0, Cascade((), False))


def _listed(spark: SparkSession, names) -> DataFrame:
    """A table of hosts as it is, or one of a few names."""
    if isinstance(names, DataFrame):
        return names.select(ascii_lower(F.col("host").cast("string")).alias("key"))
    return spark.range(1).select(F.explode(F.array(*map(F.lit, names)).cast("array<string>")).alias("key"))


RULE, BLOCK, HOST = 0, 1, 2


def judge(pages: DataFrame, rules=RULES, blocked_hosts=BLOCKED_HOSTS, *, most_bits: int = MOST_BITS) -> DataFrame:
    """page_id, host, path, rule, verdict for every page.

    The keys of all pages (host suffixes with path prefixes of the rules' lengths) are
    the universe. One cascade holds the rules' keys, one those that block, one the
    blocked hosts (names, or a table with a column host); each page's own keys are then looked up without a join. The longest
    rule wins; without a rule, a page is blocked if its host or a parent is listed. Keys are dealt by hash over as
    many passes as keep the filters of one within ``most_bits``; a few million listed hosts take one.

    A null url, or one without ://, has empty host and path and is allowed. Very long urls are read whole. Rows that
    repeat a page_id are judged each; of rules that tie in length none differ, as they fit one url and so are
    the same. Null hosts list nothing. Other columns are not read. An empty table gives no rows.
    """
    spark = pages.sparkSession
    lengths = sorted({len(path) for _, path, _ in rules})
    hosts = pages.select("page_id", F.col("url").cast("string").alias("url")).select("page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    # Distinct pairs first: a hot host's pages fold into a few keys before any exchange of keys.
    parts = hosts.select("host", F.substring("path", 1, max(lengths, default=0)).alias("prefix")).distinct()
    named = [host + path for host, path, _ in rules]
    blocking = [host + path for host, path, verdict in rules if verdict == "block"]
    of = lambda cascade, is_listed, keys: keys.select(F.lit(cascade).alias("cascade"), "key", F.lit(is_listed).alias("is_listed"))
    # A rule found by the first cascade is all that the second is asked about.
    universe = of(RULE, False, parts.select(F.explode(candidate_keys(F.col("host"), F.col("prefix"), lengths)).alias("key")))
    universe = universe.unionByName(of(HOST, False, parts.select(F.explode(host_suffixes(F.col("host"))).alias("key"))))
    for cascade, is_listed, keys in ((RULE, True, named), (BLOCK, False, named), (BLOCK, True, blocking), (HOST, True, blocked_hosts)):
        universe = universe.unionByName(of(cascade, is_listed, _listed(spark, keys)))
    keys = universe.where("key IS NOT NULL").groupBy("cascade", "key").agg(F.max("is_listed").alias("is_listed"))
    keys = materialize(keys, "keys")

    counts = keys.groupBy("cascade").agg(F.count_if("is_listed").alias("listed"), F.count_if(~F.col("is_listed")).alias("others")).collect()
    needed = sum(2 * _bits(row.listed, _hashes(_first_rate(row.listed, row.others))) for row in counts if row.listed)
    passes = max(1, math.ceil(needed / max(64, most_bits)))
    own = lambda key, number: F.lit(True) if passes == 1 else F.pmod(F.xxhash64(F.lit(-1), key), F.lit(passes)) == number
    best = "struct<n:int,key:string,blocks:boolean>"
    judged = hosts.select("*", F.lit(None).cast(best).alias("best"), F.lit(False).alias("listed"))
    for number in range(passes):
        built = cascades(keys.where(own(F.col("key"), number)))
        is_rule, is_block, is_listed = (built.get(c, Cascade((), False)) for c in (RULE, BLOCK, HOST))
        found = F.filter(candidate_keys(F.col("host"), F.col("path"), lengths), lambda key: own(key, number) & is_rule.holds(key))
        longest = F.array_max(F.transform(found, lambda key: F.struct(F.length(key).alias("n"), key.alias("key"), is_block.holds(key).alias("blocks"))))
        under = F.exists(host_suffixes(F.col("host")), lambda key: own(key, number) & is_listed.holds(key))
        judged = judged.select("page_id", "host", "path", F.greatest("best", longest.cast(best)).alias("best"), (F.col("listed") | under).alias("listed"))
        if passes > 1:
            judged = materialize(judged, "judged")
    blocked = F.coalesce(F.col("best.blocks"), F.col("listed"))
    return judged.select("page_id", "host", "path", F.col("best.key").alias("rule"), F.when(blocked, "block").otherwise("allow").alias("verdict"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))


OP3_SQL = """
WITH parts AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages),
rules(h, p, v) AS (VALUES %(rules)s),
hits AS (
  SELECT page_id, host, path, h || p AS rule, v,
         row_number() OVER (PARTITION BY page_id ORDER BY length(h || p) DESC) AS place
  FROM parts JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)),
listed(h) AS (VALUES %(hosts)s),
blocked AS (SELECT DISTINCT page_id FROM parts JOIN listed ON host = h OR ends_with(host, '.' || h))
SELECT parts.page_id, parts.host, parts.path, hits.rule,
       coalesce(hits.v, CASE WHEN blocked.page_id IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict
FROM parts LEFT JOIN hits ON hits.page_id = parts.page_id AND hits.place = 1
LEFT JOIN blocked ON blocked.page_id = parts.page_id
""" % {
    "rules": ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in RULES),
    "hosts": ", ".join(f"('{host}')" for host in BLOCKED_HOSTS),
}
