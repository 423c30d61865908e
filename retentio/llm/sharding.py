"""Minimax sharding into contiguous ranges of ordered atomic groups.

Rows with equal texts form a group, which is never split.  Groups are ordered
by a 60-bit text key (a fixed shuffle of the corpus), and the smallest shard
capacity for which a greedy left-to-right fill needs no more than ``n_shards``
shards is found by binary search; the shards are cut where that fill cuts.

Nothing of the size of the corpus reaches the driver.  It holds a bounded
histogram of group sizes over ranges of the key.  A capacity is certainly
feasible when whole ranges can be filled greedily, certainly infeasible when
even splitting ranges anywhere does not help; ranges near a cut are refined by
one grouped aggregation per round until both bounds meet and every cut falls
between two groups.  Each round splits the open ranges by a large factor, so
the number of rounds grows with the logarithm of the number of groups.

DataFrame functions only.  Defined results: a null text has 16 bytes and all
null texts are one group; repeated rows get slots of their own; an empty
table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from dataclasses import dataclass
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from retentio.llm.common import materialise, rank_in

ROW_OVERHEAD = 16
KEY_BITS = 60
FAN = 8192  # ranges per round, whatever the size of the corpus


def group_key(text: str) -> Column:
    """First 60 bits of the text's MD5; -1 for null.  (Two texts that share a
    key are kept together, which does no harm.)"""
    return F.coalesce(F.conv(F.substring(F.md5(F.col(text)), 1, 15), 16, 10).cast("bigint"), F.lit(-1).cast("bigint"))


@dataclass
class Range:
    lo: int  # smallest key
    hi: int  # largest key
    total: int
    largest: int
    atomic: bool  # one group


def _histogram(groups: DataFrame, spans: list[tuple[int, int]], fan: int) -> list[list[Range]]:
    """Sizes of the groups in each span (lo, hi inclusive), by up to ``fan`` equal key ranges."""
    key = F.col("key")
    listed = lambda values: F.array(*[F.lit(v).cast("bigint") for v in values])
    at = F.size(F.filter(listed([lo for lo, _ in spans]), lambda lo: lo <= key)) - 1  # the last span that begins before
    of = lambda values: F.get(listed(values), F.col("i"))
    lows, widths = [lo for lo, _ in spans], [max(1, -(-(hi - lo + 1) // fan)) for lo, hi in spans]
    found = (groups.filter((key >= spans[0][0]) & (key <= spans[-1][1]))
                   .withColumn("i", at).filter(key <= of([hi for _, hi in spans]))
                   .groupBy("i", F.floor((key - of(lows)) / of(widths)).cast("bigint").alias("b"))
                   .agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.sum("size").alias("total"),
                        F.max("size").alias("largest"), F.count(F.lit(1)).alias("n")).collect())
    out: list[list[Range]] = [[] for _ in spans]
    for r in sorted(found, key=lambda r: r["lo"]):
        out[r["i"]].append(Range(r["lo"], r["hi"], r["total"], r["largest"], r["n"] == 1))
    return out


def _fill(ranges: list[Range], ends: list[int], capacity: int, n_shards: int, split: bool) -> list[int] | None:
    """Greedy fill: indices of the ranges in which shards 1.. begin, or None if
    more than ``n_shards`` are needed.  ``split``: ranges that are not atomic
    may be cut anywhere (a lower bound), else nowhere (an upper bound)."""
    cuts, at, total = [], 0, ends[-1]
    while at + capacity < total:
        k = bisect_right(ends, at + capacity)  # first range that does not fit whole
        begin = ends[k - 1] if k else 0
        nxt = at + capacity if split and not ranges[k].atomic else begin
        if nxt <= at:
            return None
        cuts.append(k)
        at = nxt
        if len(cuts) >= n_shards:
            return None
    return cuts


def _smallest(ranges: list[Range], ends: list[int], n_shards: int, split: bool) -> int:
    lo, hi = max(r.largest for r in ranges), ends[-1]
    while lo < hi:
        mid = (lo + hi) // 2
        if _fill(ranges, ends, mid, n_shards, split) is None:
            lo = mid + 1
        else:
            hi = mid
    return lo


def minimax_cuts(groups: DataFrame, n_shards: int, fan: int = FAN) -> tuple[int, list[int]]:
    """(capacity, first keys of shards 1, 2, ...) for ``groups(key, size)``."""
    ranges = _histogram(groups, [(-1, 2 ** KEY_BITS - 1)], fan)[0]
    while ranges:
        ends = list(accumulate(r.total for r in ranges))
        low = _smallest(ranges, ends, n_shards, True)
        high = _smallest(ranges, ends, n_shards, False)
        cuts = _fill(ranges, ends, high, n_shards, False) or []
        near = set()
        if low < high:
            for a, b in zip(_fill(ranges, ends, low, n_shards, True) or [], cuts):
                near.update(range(min(a, b) - 1, max(a, b) + 2))
        near.update(cuts)
        open_ = [k for k in sorted(near) if 0 <= k < len(ranges) and not ranges[k].atomic]
        if not open_ and low < high:
            open_ = [k for k, r in enumerate(ranges) if not r.atomic]
        if not open_:
            return high, [ranges[k].lo for k in cuts]
        # one span for each run of neighbouring open ranges, so a plan holds few of them
        spans: list[list[int]] = []
        for k in open_:
            if spans and spans[-1][1] == k - 1:
                spans[-1][1] = k
            else:
                spans.append([k, k])
        finer = _histogram(groups, [(ranges[a].lo, ranges[b].hi) for a, b in spans],
                           max(2 * max(b - a + 1 for a, b in spans), fan // len(spans)))
        for (a, b), new in reversed(list(zip(spans, finer))):
            ranges[a:b + 1] = new
    return 0, []


def shard_documents(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and the group's key."""
    rows = docs.select("doc_id", group_key("text").alias("key"),
                       (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_OVERHEAD).cast("bigint").alias("size"),
                       F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"))
    groups = materialise(rows.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    _, cuts = minimax_cuts(groups, n_shards)
    shard = F.lit(0)
    for first in cuts:
        shard = shard + F.when(F.col("key") >= first, 1).otherwise(0)
    placed = rank_in(rows.withColumn("shard", shard.cast("int")), ["shard"], ["doc_id", "text_crc32"], "shards")
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
                         F.col("rank").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "key")
