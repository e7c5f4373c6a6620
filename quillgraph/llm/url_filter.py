"""Exact URL list membership by a cascade of Bloom filters, without joins.

Larisch et al., "CRLite" (2017). Level 1 holds the listed keys. Keys of the
corpus that pass it although they are not listed are its false positives; level
2 holds those, level 3 the listed keys that pass level 2, and so on until a
level lets nothing wrong through. Over the complete key universe of the corpus
(every parent domain of every host), the number of levels that a key passes in a
row then tells exactly whether it is listed.

Everything is DataFrame functions, and no join. Three scans of the corpus: one
estimates the number of its keys, one finds level 1's false positives (an aggregation
with the list takes out the listed ones), one judges; the levels above are made of the
few keys left. Level 1 is sized so that about as many keys pass as are listed
(bits = listed x log2(universe / listed) / ln 2), so the cascade's size is bounded
by the list, not the corpus; it is looked up as a literal of the plan.

A list whose first level exceeds ``max_bits`` (2^26: a few million keys) is dealt by
hash into parts that don't. Each has a cascade over its part of the universe, and the rows
pass all of them in turn, a scan and a written table of verdicts each.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Host and path rules: (action, rule). The longest rule that fits wins.
RULES = (
    ("block", "com/en/"),
    ("allow", "example.com/en/7"),
    ("allow", "net/de/"),
    ("block", "example.net/de/8"),
    ("block", "org/es/"),
)

#: Sites on the production block list; a key stands for itself and its subdomains.
LISTED_SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
LISTED = tuple(f"{site}.example.{tld}" for site in LISTED_SITES for tld in ("com", "net", "org"))


@dataclass(frozen=True)
class Level:
    words: tuple[int, ...]
    bits: int
    hashes: int
    seed: int

    def positions(self, key: Column) -> list[Column]:
        n = F.lit(self.bits).cast("long")
        a, b = F.pmod(F.xxhash64(F.lit(self.seed), key), n), F.pmod(F.xxhash64(key, F.lit(self.seed + 1)), n)
        return [F.pmod(a + b * F.lit(i), n) for i in range(self.hashes)]

    def passes(self, key: Column) -> Column:
        words = F.split(F.lit(",".join(map(str, self.words))), ",").cast("array<bigint>")  # folded to a literal, in one call
        found = F.lit(True)
        for p in self.positions(key):
            word = F.get(words, F.shiftright(p, 6).cast("int"))
            found = found & (F.call_function("shiftright", word, F.pmod(p, F.lit(64)).cast("int")).bitwiseAND(F.lit(1)) == 1)
        return found


def bits_for(count: int, rate: float) -> int:
    bits = max(64, math.ceil(-max(1, count) * math.log(rate) / math.log(2) ** 2))
    return -(-bits // 64) * 64


def first_rate(listed: int, universe: int) -> float:
    return min(0.5, math.sqrt(0.5) * max(1, listed) / max(1, listed, universe))


def build_level(keys: DataFrame, count: int, rate: float, seed: int, max_bits: int) -> Level:
    """A Bloom filter of the column ``key``; keys meet as words of bits, so what
    reaches the driver is bits / 8 bytes whatever the keys' lengths."""
    bits = bits_for(count, rate)
    if bits > max_bits:
        raise ValueError(f"level of {bits} bits exceeds max_bits={max_bits}: deal the list into parts")
    level = Level((), bits, max(1, round(-math.log2(rate))), seed)
    set_bits = keys.select(F.explode(F.array(*level.positions(F.col("key")))).alias("p"))
    words = set_bits.groupBy(F.shiftright("p", 6).cast("int").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("b"))
    filled = [0] * (bits // 64)
    for row in words.collect():  # at most bits / 64 rows
        filled[row.w] = row.b
    return Level(tuple(filled), bits, level.hashes, seed)


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): after the first ``://`` up to ``/``, ``?``, ``#`` or the end,
    A-Z lower-cased; then up to ``?``, ``#`` or the end. Both empty without ``://``."""
    known = F.coalesce(url, F.lit(""))
    at = F.locate("://", known)
    rest = F.when(at > 0, known.substr(at + F.lit(3), F.length(known))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^([^/?#]*)", 1)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def parent_domains(host: Column) -> Column:
    """The host and each of its parents: all parts after some dot."""
    parts = F.split(host, "\\.")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "."))


def build_cascade(universe: DataFrame, listed: DataFrame, universe_size: int | None = None, max_bits: int = 1 << 26) -> list[Level]:
    """Levels that tell exactly which keys of ``universe`` (column key, repeats
    allowed) are in ``listed`` (column key). An empty list gives no level."""
    listed = listed.select("key").where(F.col("key").isNotNull()).distinct()
    n = listed.count()
    if not n:
        return []
    universe = universe.select("key").where(F.col("key").isNotNull())
    size = universe_size or universe.agg(F.approx_count_distinct("key")).head()[0]
    levels = [build_level(listed, n, first_rate(n, size), 11, max_bits)]
    passing = universe.where(levels[0].passes(F.col("key"))).select("key", F.lit(0).alias("own")).union(listed.select("key", F.lit(1)))
    wrong = passing.groupBy("key").agg(F.max("own").alias("own")).where("own = 0").select("key").persist()
    held, others, count = wrong, listed, wrong.count()
    while count:
        level = build_level(held, count, 0.5, 11 + 2 * len(levels), max_bits)
        levels.append(level)
        passing = others.where(level.passes(F.col("key"))).persist()
        held, others, count = passing, held, passing.count()
    return levels


def is_listed(levels: list[Level], key: Column) -> Column:
    """Exact for keys of the universe that the cascade was built over."""
    verdict = F.lit(bool(len(levels) % 2))
    for depth in range(len(levels), 0, -1):  # failing level i: listed iff i is even
        verdict = F.when(~levels[depth - 1].passes(key), F.lit(depth % 2 == 0)).otherwise(verdict)
    return verdict


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, action) of the longest rule that fits, else nulls. Rules of equal
    length that both fit: block before allow, then the smaller string."""
    rule, action = F.lit(None).cast("string"), F.lit(None).cast("string")
    for act, text in sorted(rules, key=lambda r: (len(r[1]), r[0] == "block", [-ord(c) for c in r[1]])):
        domain, slash, rest = text.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit(slash + rest))
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        action = F.when(fits, F.lit(act)).otherwise(action)
    return rule, action


def in_part(key: Column, i: int, parts: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(97), key), F.lit(parts)) == i


def parts_for(listed: DataFrame, n: int, size: int, max_bits: int) -> int:
    """As few parts, or half as many more, as leave no part of the list too large for a level."""
    parts = -(-bits_for(n, first_rate(n, size)) // max_bits)
    while parts > 1:
        most = listed.groupBy(F.pmod(F.xxhash64(F.lit(97), "key"), F.lit(parts))).count().agg(F.max("count")).head()[0]
        if bits_for(most, first_rate(most, max(1, size // parts))) <= max_bits:
            break
        parts += -(-parts // 2)
    return parts


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", max_bits: int = 1 << 26) -> DataFrame:
    """page_id, host, path, rule, verdict, listed: every row of ``pages`` judged.

    A fitting rule decides; without one the cascade does: block if the host or
    a parent domain is listed. Null urls and urls without ``://`` have an empty
    host, fit no rule and are allowed unless the empty key is listed. Repeated
    rows are judged alike; empty tables give no rows; other columns are ignored.
    """
    host, path = url_parts(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    universe = rows.select(F.explode(parent_domains(F.col("host"))).alias("key"))
    listed = listed.select("key").where(F.col("key").isNotNull()).distinct()
    n, size = listed.count(), universe.agg(F.approx_count_distinct("key")).head()[0]
    parts = parts_for(listed, n, size, max_bits)
    keys = parent_domains(F.col("host"))
    if parts == 1:
        levels = build_cascade(universe, listed, size, max_bits)
        rows = rows.withColumn("listed", F.exists(keys, lambda key: is_listed(levels, key)))
    else:
        rows = rows.withColumn("listed", F.lit(False))
        for i in range(parts):
            own = in_part(F.col("key"), i, parts)
            levels = build_cascade(universe.where(own), listed.where(own), max(1, size // parts), max_bits)
            hit = F.exists(keys, lambda key, i=i, levels=levels: in_part(key, i, parts) & is_listed(levels, key))
            rows = cut(rows.withColumn("listed", F.col("listed") | hit))
    rule, action = fitting_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(action, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow")))
    return rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "listed")
