"""Url rules by Bloom filter cascades: exact membership of listed keys over all keys the corpus can ask for, without a join."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_RULES = 100_000  # a cascade holds a few bits for each rule and is part of the plan
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Level:
    """One Bloom filter: 64-bit words and the number of hashes, seeded by its place in the cascade."""

    words: tuple[int, ...]
    hashes: int
    seed: int

    def has(self, key: Column) -> Column:
        bits = F.array(*[F.lit(w) for w in self.words])
        size = 64 * len(self.words)
        test = None
        for at in _places(key, size, self.hashes, self.seed):
            hit = F.getbit(F.get(bits, F.floor(at / 64).cast("int")), F.pmod(at, F.lit(64)).cast("int")) == 1
            test = hit if test is None else test & hit
        return test


def _places(key: Column, size: int, hashes: int, seed: int) -> list[Column]:
    return [F.pmod(F.xxhash64(key, F.lit(1000 * seed + i)), F.lit(size)) for i in range(hashes)]


def _keys(spark: SparkSession, keys: list[str]) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(k) for k in keys])).alias("key"))


def build_level(keys: DataFrame, n: int, rate: float, seed: int) -> Level:
    """A filter of n keys with about this false positive rate; its words are OR-ed in Spark, one row per 64 bits."""
    hashes = max(1, round(math.log2(1 / rate)))
    words = max(1, math.ceil(n * hashes / math.log(2) / 64))
    at = F.explode(F.array(*_places(F.col("key"), 64 * words, hashes, seed)))
    rows = keys.select(at.alias("at")).groupBy(F.floor(F.col("at") / 64).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(pmod(at, 64) as int))")).alias("bits")).collect()
    found = {r["word"]: r["bits"] for r in rows}
    return Level(tuple(found.get(w, 0) for w in range(words)), hashes, seed)


@dataclass(frozen=True)
class Cascade:
    """Alternate levels hold listed keys and the other keys that pass so far; a key that leaves at an odd level is listed."""

    levels: tuple[Level, ...]

    def lists(self, key: Column) -> Column:
        """Exact for the listed keys and every key of the universe the cascade was built over."""
        out = F.lit(len(self.levels) % 2 == 1)
        for k in range(len(self.levels) - 1, -1, -1):
            out = F.when(self.levels[k].has(key), out).otherwise(F.lit(k % 2 == 1))
        return out


def build_cascade(listed: list[str], universe: DataFrame) -> Cascade:
    """A cascade for the listed keys over a table of all keys (column ``key``, repeats allowed).

    The first level's rate follows from the approximate number of distinct keys,
    so that about as many other keys pass it as there are listed ones, whatever
    the corpus holds; a rate that lets more pass is lowered and tried again. So
    the driver sees a bounded multiple of the listed keys, never the universe.
    """
    spark, listed = universe.sparkSession, sorted(set(listed))
    if not listed:
        return Cascade(())
    if len(listed) > MAX_RULES:
        raise ValueError(f"{len(listed)} rules; the bound is {MAX_RULES}")
    others = universe.where(~F.col("key").isin(listed)) if len(listed) <= 64 else universe.join(F.broadcast(_keys(spark, listed)), "key", "left_anti")
    n = others.agg(F.approx_count_distinct("key")).first()[0]
    rate, bound = min(0.5, math.sqrt(0.5) * len(listed) / max(n, 1)), 64 + 8 * len(listed)
    inside = _keys(spark, listed)
    while True:
        levels = [build_level(inside, len(listed), rate, 0)]
        passing = [r["key"] for r in others.where(levels[0].has(F.col("key"))).select("key").distinct().limit(bound + 1).collect()]
        if len(passing) <= bound:
            break
        rate /= 8
    include, exclude = listed, sorted(passing)
    while exclude:  # the set to encode next, and the other side's keys that still pass
        levels.append(build_level(_keys(spark, exclude), len(exclude), 0.5, len(levels)))
        passing = [r["key"] for r in _keys(spark, include).where(levels[-1].has(F.col("key"))).collect()]
        include, exclude = exclude, sorted(passing)
    return Cascade(tuple(levels))


def parse(url: Column) -> tuple[Column, Column]:
    """(host, path): see ``judge_urls``; both empty for a null url or one without ://."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    path = F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def candidate_keys(host: Column, path: Column, rules: list[str]) -> Column:
    """All keys that a rule of the list's shapes could have for a url, the longest first.

    Shapes are the rules' numbers of host labels and path lengths, so their
    number is bounded by the list and no url yields more keys than it has shapes.
    """
    labels = F.split(host, r"\.", -1)
    shapes = sorted({(r.split("/", 1)[0].count(".") + 1, len(r) - r.index("/")) for r in rules}, reverse=True)
    keys = [F.when((F.size(labels) >= n) & (F.length(path) >= size), F.concat(F.array_join(F.slice(labels, -n, n), "."), F.substring(path, 1, size)))
            for n, size in shapes]
    found = F.array_compact(F.array(*keys)) if keys else F.array().cast("array<string>")
    return F.transform(F.array_sort(F.transform(found, lambda k: F.struct((-F.length(k)).alias("n"), k.alias("key")))), lambda s: s["key"])


def judge_urls(pages: DataFrame, block: list[str], allow: list[str], *, page_id: str = "page_id", url: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of every row.

    A rule is host/path, as ``example.net/en/``: it fits the host and its
    subdomains where the url's path starts with the rule's. The longest fitting
    rule by characters wins, of equals the first by name; a key in both lists
    blocks. Without a rule the verdict is allow, as for a null url.

    Only the url column is read: once for the number of distinct keys, once for
    those that pass the first level of each list, once for the verdicts.
    """
    rules = [*block, *allow]
    host, path = parse(F.col(url))
    keyed = pages.select(F.col(page_id).alias("page_id"), host.alias("host"), path.alias("path"))
    keyed = keyed.withColumn("_keys", candidate_keys(F.col("host"), F.col("path"), rules))
    universe = keyed.select(F.explode("_keys").alias("key"))
    blocked, allowed = build_cascade(block, universe), build_cascade(allow, universe)
    rule = F.get(F.filter("_keys", lambda k: blocked.lists(k) | allowed.lists(k)), F.lit(0))
    verdict = F.when(F.col("rule").isNotNull() & blocked.lists(F.col("rule")), "block").otherwise("allow")
    return keyed.withColumn("rule", rule).select("page_id", "host", "path", "rule", verdict.alias("verdict"))
