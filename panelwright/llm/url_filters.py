"""URL rules by a cascade of Bloom filters.

A rule is (host, path prefix, verdict). It fits a url if its host is the url's host or one of the
host's parent domains and the url's path starts with its path. A url is therefore looked up by
candidate keys ``parent domain + path prefix``, the prefixes having the rules' lengths. The
universe is every candidate key of the corpus. Level 1 of the cascade encodes the listed keys,
level 2 the keys of the universe that level 1 takes for listed, level 3 the listed keys that level 2
takes for such, and so on until a level errs on nothing; a key's membership is then the parity of
the level that first refuses it. That is exact for every key of the universe, and a lookup tests
bits of constants, without a join.

Level 1 has as many hashes a key as the universe is doublings larger than the list, and the bits for
them, so that it errs on about as many keys as are listed, and later levels follow the list's size.

The bits of a level are constants of the plan, so their size must be bounded: beyond ``max_bits``
the listed keys are joined instead, which is exact as well.

Defined results: NULL urls and those without ``://`` have an empty host and path, fit no rule and
get the default verdict. The longest fitting rule (host and path together) wins; of equally long
ones that with the longer host. A rule listed twice must have one verdict. An empty table gives an
empty result. Rows that repeat are judged alike. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from panelwright.llm.common import LOWER, UPPER, stored


@dataclass(frozen=True)
class UrlRule:
    host: str
    path: str
    verdict: str

    @property
    def key(self) -> str:
        return self.host + self.path


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    rest = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(rest, UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def parent_domains(host: Column) -> Column:
    """The host and its parent domains, longest first."""
    labels = F.split(host, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels)), "."))


def candidates(host: Column, path: Column, lengths: Sequence[int]) -> Column:
    """Keys under which a rule that fits may be listed, longest first."""
    heads = [F.when(F.char_length(path) >= n, F.substring(path, 1, n))
             for n in sorted(lengths, reverse=True)]
    heads = F.array_compact(F.array(*heads)) if heads else F.array().cast("array<string>")
    keys = F.flatten(F.transform(parent_domains(host), lambda d: F.transform(
        heads, lambda h: F.struct((-F.char_length(d) - F.char_length(h)).alias("a"),
                                  (-F.char_length(d)).alias("b"), F.concat(d, h).alias("key")))))
    return F.transform(F.array_sort(keys), lambda k: k["key"])


@dataclass(frozen=True)
class Level:
    """One Bloom filter: its 64-bit words as whole numbers, and its salt."""

    words: tuple[int, ...]
    salt: int
    hashes: int

    def holds(self, key: Column) -> Column:
        bits = 64 * len(self.words)
        table = F.array(*[F.lit(w).cast("long") for w in self.words])
        answer = F.lit(True)
        for place in _places(key, self.salt, self.hashes, bits):
            answer = answer & (F.getbit(F.get(table, F.shiftright(place, 6).cast("int")),
                                        (place % 64).cast("int")) == 1)
        return answer


def _places(key: Column, salt: int, hashes: int, bits: int) -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(salt * 64 + i), key), F.lit(bits).cast("long"))
            for i in range(hashes)]


def _level(keys: DataFrame, n: int, salt: int, bits_per_key: int, hashes: int) -> Level:
    """A filter of ``n`` keys. Its words, a fixed number of bits a key, come to the driver."""
    words = max(1, -(-n * bits_per_key // 64))
    places = F.array(*_places(F.col("key"), salt, hashes, 64 * words))
    rows = (keys.select(F.explode(places).alias("p"))
            .groupBy(F.shiftright("p", 6).alias("w"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits")).collect())
    bits = {r.w: r.bits for r in rows}
    return Level(tuple(bits.get(w, 0) for w in range(words)), salt, hashes)


@dataclass(frozen=True)
class Cascade:
    levels: tuple[Level, ...]

    def contains(self, key: Column) -> Column:
        """Exact for keys of the universe and for listed keys."""
        answer = F.lit(len(self.levels) % 2 == 1)
        for i in reversed(range(len(self.levels))):
            answer = F.when(self.levels[i].holds(key), answer).otherwise(F.lit(i % 2 == 1))
        return answer


def build_cascade(listed: DataFrame, universe: DataFrame, bits_per_key: int = 8,
                  hashes: int = 3, max_bits: int = 1 << 16) -> Cascade | None:
    """Cascade of ``listed`` keys over a ``universe`` of keys (both one column ``key``).

    None if a level would need more than ``max_bits``, the bound of what the plan carries.
    """
    yes = stored(listed.select("key").distinct(), "listed")
    no = universe.select("key").distinct().join(yes, "key", "left_anti")
    here, other, levels = yes, no, []
    while (n := here.count()) or not levels:
        each, bits = hashes, bits_per_key
        if n and not levels:
            each = max(hashes, math.ceil(math.log2(max(1, other.count()) / n)))
            bits = max(bits_per_key, math.ceil(each / math.log(2)))
        if n * bits > max_bits:
            return None
        level = _level(here, n, len(levels), bits, each)
        levels.append(level)
        here, other = stored(other.filter(level.holds(F.col("key"))), "cascade"), here
    return Cascade(tuple(levels))


def judge_urls(pages: DataFrame, rules: Sequence[UrlRule], keep: Sequence[str] = ("page_id",),
               url: str = "url", default: str = "allow", max_bits: int = 1 << 16) -> DataFrame:
    """``keep`` columns, ``host``, ``path``, ``rule`` (host and path, or NULL) and ``verdict``."""
    spark = pages.sparkSession
    lengths = sorted({len(r.path) for r in rules})
    parts = pages.select(*keep, host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    keys = candidates(F.col("host"), F.col("path"), lengths)
    listed = spark.createDataFrame([(r.key,) for r in rules], "key string")
    universe = (parts.select("host", F.substring("path", 1, max(lengths, default=0)).alias("path"))
                .distinct().select(F.explode(keys).alias("key")).distinct())
    cascade = build_cascade(listed, stored(universe, "universe"), max_bits=max_bits)
    if cascade is None:
        return _joined(parts, rules, keys, keep, default)
    found = F.get(F.filter("_keys", cascade.contains), F.lit(0))
    parts = parts.withColumn("_keys", keys).withColumn("rule", found).drop("_keys")
    verdict = F.lit(None).cast("string")
    for name in sorted({r.verdict for r in rules}):
        verdict = F.when(F.col("rule").isin([r.key for r in rules if r.verdict == name]),
                         F.lit(name)).otherwise(verdict)
    return parts.withColumn("verdict", F.coalesce(verdict, F.lit(default)))


def _joined(parts: DataFrame, rules: Sequence[UrlRule], keys: Column, keep: Sequence[str],
            default: str) -> DataFrame:
    """The same for lists beyond the bound: every distinct (host, path) is joined by its keys."""
    spark = parts.sparkSession
    listed = spark.createDataFrame([(r.key, r.verdict) for r in rules], "key string, v string")
    pairs = parts.select("host", "path").distinct()
    best = (pairs.select("host", "path", F.posexplode(keys).alias("at", "key")).join(listed, "key")
            .groupBy(F.col("host").alias("_h"), F.col("path").alias("_p"))
            .agg(F.min_by(F.struct("key", "v"), "at").alias("hit")))
    return (parts.join(best, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left")
            .select(*keep, "host", "path", F.col("hit.key").alias("rule"),
                    F.coalesce("hit.v", F.lit(default)).alias("verdict")))
