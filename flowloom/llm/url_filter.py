"""Exact set membership by a cascade of Bloom filters, and URL rules.

Level 0 encodes the listed keys. Every other level encodes the keys of the
universe that pass the level before without belonging to it, until none is
left. For any key of the universe the answer is then exact, and a lookup is an
expression over a few literals: no join.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import ascii_lower
from flowloom.session import materialise

BITMAP_BITS = 32_768  # bits that Spark's bitmap aggregate holds
LATER_RATE = 1 / 16
# The filters travel with every task; lists beyond this are refused (64 MB are about 50 million keys at 10 bits).
MAX_FILTER_BYTES = 64 << 20

#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
LISTED_LABELS = ("spam-farm",)


@dataclass(frozen=True)
class Bloom:
    """One level: its bits, and how keys are hashed into them."""

    bits: bytes
    hashes: int
    level: int

    def places(self, key: Column) -> list[Column]:
        size = F.lit(len(self.bits) * 8).cast("bigint")
        return [F.pmod(F.xxhash64(F.lit(self.level), F.lit(i), key), size) for i in range(self.hashes)]

    def contains(self, key: Column) -> Column:
        found = F.lit(True)
        for at in self.places(key):
            one = F.substring(F.lit(self.bits), (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))
            byte = F.ascii(F.decode(one, "ISO-8859-1"))
            found = found & (F.getbit(byte.cast("bigint"), (at % 8).cast("int")) == 1)
        return found


def _build(keys: DataFrame, n: int, rate: float, level: int) -> Bloom:
    bits = max(1, ceil(n * 1.4427 * log2(1 / rate)))
    buckets = ceil(bits / BITMAP_BITS)
    if buckets * BITMAP_BITS // 8 > MAX_FILTER_BYTES:
        raise ValueError(f"{n} keys need a filter of more than {MAX_FILTER_BYTES} bytes")
    size = bits if buckets == 1 else buckets * BITMAP_BITS
    size += -size % 8
    empty = Bloom(bytes(size // 8), max(1, round(log(1 / rate) / log(2))), level)
    places = keys.select(F.explode(F.array(*empty.places(F.col("key")))).alias("at"))
    maps = places.groupBy(F.expr(f"at div {BITMAP_BITS}").alias("bucket")).agg(
        F.bitmap_construct_agg(F.col("at") % BITMAP_BITS).alias("bits")).collect()  # at most MAX_FILTER_BYTES
    whole = bytearray(buckets * BITMAP_BITS // 8)
    for row in maps:
        begin = row["bucket"] * BITMAP_BITS // 8
        whole[begin:begin + len(row["bits"])] = row["bits"]
    return Bloom(bytes(whole[:size // 8]), empty.hashes, level)


def bloom_cascade(listed: DataFrame, universe: DataFrame, later_rate: float = LATER_RATE) -> list[Bloom]:
    """Levels for ``listed.key`` over ``universe.key``; NULL keys take no part.

    An empty list gives no level, so that nothing is listed. Listed keys that
    the universe lacks are encoded too.
    """
    inside = materialise(listed.select("key").dropna().distinct(), "cascade-listed")
    n_inside = inside.count()
    if not n_inside:
        return []
    known = [Bloom(b"", 0, -1)][:0]
    outside = materialise(
        universe.select("key").dropna().distinct().join(inside, "key", "left_anti"), "cascade-universe")
    n_outside = outside.count()
    rate = min(0.5, max(1e-4, n_inside / (1.414 * max(n_outside, 1))))
    while True:
        bloom = _build(inside, n_inside, rate, len(known))
        known.append(bloom)
        passed = outside.filter(bloom.contains(F.col("key")))
        n_passed = passed.count()
        if not n_passed:
            return known
        inside, outside, n_inside, rate = passed, inside, n_passed, later_rate


def is_listed(levels: list[Bloom], key: Column) -> Column:
    """Whether ``key``, one of the universe, is listed."""
    answer = F.lit(False)
    for i, level in reversed(list(enumerate(levels))):
        answer = level.contains(key) & ~answer if i < len(levels) - 1 else level.contains(key)
    return answer


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for NULL and for a url without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def best_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Longest rule that fits, as text, and its verdict; both NULL if none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is asked first
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def url_filter(pages: DataFrame, listed: DataFrame | None = None, rules=RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict`` per row of ``pages``.

    Where no rule fits, hosts of ``listed`` (column ``key``) are blocked and all
    others allowed. Without ``listed``, the hosts of the table that have one of
    ``LISTED_LABELS`` among their labels are listed. Repeated rows are judged
    each; NULL urls have an empty host and path.
    """
    host, path = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    hosts = materialise(parts.select(F.col("host").alias("key")).distinct(), "cascade-hosts")
    if listed is None:
        listed = hosts.filter(F.arrays_overlap(
            F.split("key", r"\."), F.array(*[F.lit(x) for x in LISTED_LABELS])))
    levels = bloom_cascade(listed, hosts)
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    by_list = F.when(is_listed(levels, F.col("host")), "block").otherwise("allow")
    return parts.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, by_list).alias("verdict"))
