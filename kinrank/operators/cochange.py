"""Co-change statistics (S4, S5, A4-A6): which items change together.

Input: ``changes(group_id, item[, ts, change_type])`` in long form, one row
per (group, item) touch.  A group is a commit, an order, a basket.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import wordlists as W
from ..functions.similarity import ship_by_value
from ..session import written
from .topk import top_n_per_key

KEEP_CHANGE_TYPES = ("A", "C", "M", "R")   # added, copied, modified, renamed


def filter_change_types(changes: DataFrame, keep=KEEP_CHANGE_TYPES) -> DataFrame:
    """Drop deletions (anything outside ``keep``)."""
    return changes.where(F.col("change_type").isin(list(keep)))


BUCKETS, FEW = 1024, 10_000        # of a pass of `nth_largest`; values that are sorted outright
OLDEST = -(1 << 62)                # stands for a missing time


def _ordinal(df: DataFrame, column: str):
    """`column` as a whole number in the same order (times in microseconds), or None if its type has no such form."""
    kind = dict(df.dtypes)[column]
    if kind.startswith("timestamp") or kind == "date":
        return F.unix_micros(F.col(column).cast("timestamp"))
    return F.col(column).cast("bigint") if kind in ("tinyint", "smallint", "int", "bigint") else None


def nth_largest(df: DataFrame, column: str, n: int) -> tuple[int, int]:
    """(the n-th largest value of a whole-number column, how many are larger); df has at least n rows.

    Selection by counting: a pass counts BUCKETS equal ranges, the range that holds the n-th value is cut again,
    until it has few values or is one value.  No pass sorts, and at most BUCKETS or FEW rows reach the driver."""
    low, high = df.agg(F.min(column), F.max(column)).first()
    larger = 0
    while True:
        width = -(-(high - low + 1) // BUCKETS)
        inside = df.where(F.col(column).between(low, high))
        bucket = F.expr(f"(cast({column} as decimal(20, 0)) - {low}) div {width}")      # doubles would misplace values at a bound
        counts = dict(inside.groupBy(bucket.cast("bigint").alias("b")).count().collect())
        for b in sorted(counts, reverse=True):
            if larger + counts[b] >= n:
                break
            larger += counts[b]
        low, high = low + b * width, min(high, low + b * width + width - 1)
        if low == high:
            return low, larger
        if counts[b] <= FEW:
            top = sorted((r[0] for r in df.where(F.col(column).between(low, high)).select(column).collect()), reverse=True)
            value = top[n - larger - 1]
            return value, larger + top.index(value)


def _groups(changes: DataFrame) -> DataFrame:
    """(group_id, ts, even): each group's newest time, and whether all its rows have it."""
    return changes.groupBy("group_id").agg(F.max("ts").alias("ts"), F.min("ts").eqNullSafe(F.max("ts")).alias("even"))


def _cut(groups: DataFrame, n: int):
    """A condition on (group_id, ts) that holds for exactly the newest n groups; None if no order can be counted."""
    k, g = _ordinal(groups, "ts"), _ordinal(groups, "group_id")
    if k is None or g is None:
        return None
    k, g = F.coalesce(k, F.lit(OLDEST)), F.coalesce(g, F.lit(OLDEST))
    keyed = groups.select(k.alias("k"), g.alias("g"))
    if n <= FEW:
        top = keyed.orderBy(F.col("k").desc(), F.col("g").desc()).limit(n).collect()
        if len(top) < n:
            return F.lit(True)
        time, last = top[-1]
    else:
        if groups.count() <= n:
            return F.lit(True)
        time, newer = nth_largest(keyed, "k", n)
        last, _ = nth_largest(keyed.where(F.col("k") == time), "g", n - newer)
    return (k > time) | ((k == time) & (g >= last))


def _newest(groups: DataFrame, n: int) -> DataFrame:
    """The rank order outright, for ids or times that are neither numbers nor times."""
    return groups.orderBy(F.col("ts").desc(), F.col("group_id").desc()).limit(n)


def recent_groups(changes: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` groups, (group_id, ts); ties broken by group id, groups without a time are the oldest.

    The n-th (ts, group_id) is found first, by a partial and final top-n up to FEW and by counting passes beyond, so
    n may be any size; the rest is a range filter."""
    groups = _groups(changes)
    if n <= 0:
        return groups.where(F.lit(False)).select("group_id", "ts")
    groups = written(groups) if n > FEW else groups
    cut = _cut(groups, n)
    return (_newest(groups, n) if cut is None else groups.where(cut)).select("group_id", "ts")


def limit_history(changes: DataFrame, n: int | None) -> DataFrame:
    """Keep the rows of the newest ``n`` groups (all when n is None; none at 0).

    If all rows of a group have one time, as commits do, the cut is a filter on the rows themselves; else the
    groups are joined."""
    if n is None:
        return changes
    if n <= 0:
        return changes.where(F.lit(False))
    groups = written(_groups(changes))
    cut = _cut(groups, n)
    if cut is not None and groups.where(~F.col("even")).isEmpty():
        return changes.where(cut)
    keep = _newest(groups, n) if cut is None else groups.where(cut)
    return changes.join(keep.select("group_id"), "group_id", "left_semi")


BLOCK = 64                   # items of a group that meet at once if large groups are let in


def clean_groups(changes: DataFrame, min_size: int = W.MIN_GROUP, max_size: int | None = W.MAX_GROUP,
                 dropped: Observation | None = None) -> DataFrame:
    """A4: distinct items per group, groups of min..max items only (no upper bound when max_size is None).

    Sizes come from a two-phase count (map-side partial aggregation), so a
    group holding a third of all rows is counted without being gathered in
    one task; oversized groups are then dropped before any pair is formed.
    ``dropped`` is told, once the result has run, how many groups were too
    small, too large, and how many items the latter had.
    Returns (group_id, item, n).
    """
    touched = changes.select("group_id", "item").distinct()
    sizes = touched.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    large = F.lit(False) if max_size is None else n > max_size
    if dropped is not None:
        sizes = sizes.observe(dropped, F.count(F.when(n < min_size, 1)).alias("too_small"),
                              F.count(F.when(large, 1)).alias("too_large"),
                              F.coalesce(F.sum(F.when(large, n)), F.lit(0)).alias("items_of_large"))
    return touched.join(sizes.where((n >= min_size) & ~large), "group_id")


def cochange_pairs(changes: DataFrame, min_size: int = W.MIN_GROUP, max_size: int | None = W.MAX_GROUP,
                   targets: DataFrame | None = None, dropped: Observation | None = None) -> DataFrame:
    """A5: for every ordered pair of distinct items sharing a group, the sum
    of 1/sqrt(group size) and the number of groups.

    The self-join is on group_id after the size filter, so each group emits
    at most max_size * (max_size - 1) rows; the pair sums use partial
    aggregation.  Where the cap is lifted, a group is dealt into blocks of about
    BLOCK items and every pair of blocks meets under a key of its own, so that
    no task gets more than BLOCK * BLOCK pairs of one group.
    Returns (target, candidate, weighted_count, commit_count).

    ``targets`` (item ids, column ``item_id``) limits the left side to those
    items; group sizes still count every item, so the scores are unchanged.
    """
    g = clean_groups(changes, min_size, max_size, dropped)
    left = g.select("group_id", F.col("item").alias("target"), "n")
    right = g.select("group_id", F.col("item").alias("candidate"), "n")
    key = ["group_id"]
    if targets is not None:
        left = left.join(targets.select(F.col("item_id").alias("target")).distinct(), "target", "left_semi")
    if max_size is None or max_size > BLOCK:
        blocks = F.ceil(F.col("n") / BLOCK)
        def dealt(df, item, own, other):  # noqa: E306
            return (df.withColumn(own, F.pmod(F.xxhash64(item), blocks))
                    .withColumn(other, F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1))))
        left, right = dealt(left, "target", "_l", "_r"), dealt(right, "candidate", "_r", "_l")
        key = ["group_id", "_l", "_r"]
    return (left.join(right.drop("n"), key)
            .where(F.col("target") != F.col("candidate"))
            .groupBy("target", "candidate")
            .agg(F.sum(1.0 / F.sqrt("n")).alias("weighted_count"),
                 F.count(F.lit(1)).alias("commit_count")))


def cochange_scores(pairs: DataFrame) -> DataFrame:
    """weighted_count / the target's largest weighted_count.

    The per-target maximum is a hash aggregate joined back (not a window), so
    a target with very many partners is split by AQE's skew-join handling
    instead of being sorted in one task.  It reads both figures of a pair, so that
    Spark sees the same shuffle of the pairs twice and makes it once."""
    best = (pairs.groupBy("target").agg(F.max("weighted_count").alias("max_weighted"), F.max("commit_count").alias("most"))
            .where(F.col("most") > 0).drop("most"))
    return (pairs.join(best, "target")
            .withColumn("score", F.when(F.col("max_weighted") > 0,
                                        F.col("weighted_count") / F.col("max_weighted"))
                        .otherwise(F.lit(0.0)))
            .drop("max_weighted"))


BLOCK_TOUCHES = 8_000_000    # (group, item) rows that are broadcast together, 12 bytes each
TASK_TOUCHES = 100_000       # of the targets of a task
MEMBERS = 4_000_000          # items of a target's groups that are looked at together
DENSE = 512                  # members from which on a group that holds a 128th of a block's items becomes a bitmap
TIE = 2e-9                   # of the largest possible score: scores that differ by less may be ties


def _planes(rows):
    """How many of the bitmaps have each bit, as bitmaps of binary digits, lowest first (carry-save adders)."""
    out, rows = [], list(rows)
    while rows:
        carries = []
        while len(rows) > 1:
            a, b = rows.pop(), rows.pop()
            differ, carry = a ^ b, a & b
            if rows:
                c = rows.pop()
                carry |= differ & c
                differ ^= c
            rows.append(differ)
            carries.append(carry)
        out.append(rows[0])
        rows = carries
    return out


def _at_least(planes, k: int):
    """A bitmap of the counts of at least k >= 1."""
    more, equal = None, None
    for i in range(len(planes) - 1, -1, -1):
        p = planes[i]
        if k >> i & 1:
            equal = p if equal is None else equal & p
        else:
            above = p if equal is None else equal & p
            more = above if more is None else more | above
            equal = ~p if equal is None else equal & ~p
    return equal if more is None else equal | more


def _bits(bitmap):
    """The numbers of the bits that are set, in order."""
    word = np.flatnonzero(bitmap)
    row, bit = np.nonzero(np.unpackbits(bitmap[word].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return word[row] * 64 + bit


class _Members:
    """The items of each group, for a block of the items; those of large groups as bitmaps too."""

    def __init__(self, groups, items):
        self.items, at = np.unique(items, return_inverse=True)
        self.groups, group = np.unique(groups, return_inverse=True)
        order = np.argsort(group, kind="stable")
        self.member, self.ends = at[order].astype(np.int32), np.searchsorted(group[order], np.arange(len(self.groups) + 1))
        self.bitmaps = None                          # made in the workers

    def _large(self):
        """(the place of each group's bitmap or -1, bitmaps)"""
        if self.bitmaps is None:
            count = np.diff(self.ends)
            large = np.flatnonzero((count >= DENSE) & (count * 128 >= len(self.items)))
            place = np.full(len(count), -1)
            place[large] = np.arange(len(large))
            maps = np.zeros((len(large), -(-len(self.items) // 64)), np.uint64)
            held = np.zeros(maps.shape[1] * 64, bool)
            for i, k in enumerate(large.tolist()):
                held[:] = False
                held[self.member[self.ends[k]:self.ends[k + 1]]] = True
                maps[i] = np.packbits(held, bitorder="little").view(np.uint64)
            self.bitmaps = place, maps
        return self.bitmaps

    def _listed(self, at):
        return np.concatenate([self.member[self.ends[k]:self.ends[k + 1]] for k in at.tolist()] or [self.member[:0]])

    def _few(self, at, weight, count):
        """(places, weighted counts, counts) of the members of groups with few of them."""
        place, where = np.unique(self._listed(at), return_inverse=True)
        return place, np.bincount(where, np.repeat(weight, count), len(place)), np.bincount(where, minlength=len(place))

    def _all(self, at, weight, count):
        """As `_few`, with a place for every item of the block."""
        total, n = np.zeros(len(self.items)), np.zeros(len(self.items), np.int64)
        piece = np.cumsum(count) // MEMBERS
        for p in np.unique(piece).tolist():
            part = np.flatnonzero(piece == p)
            member = self._listed(at[part])
            total += np.bincount(member, np.repeat(weight[part], count[part]), len(total))
            n += np.bincount(member, minlength=len(n))
        place = np.flatnonzero(n)
        return place, total[place], n[place]

    def _best_of_large(self, target, at, weight, count, n: int, slack: float):
        """`partners`, but those that cannot be among the n best (by `slack`) may be left out; None if bitmaps do not help.

        A count of k large groups stands for a weight between those of the k smallest and the k largest weights."""
        place, maps = self._large()
        own = place[at]
        large = own >= 0
        if not large.any():
            return None
        rows, heavy = own[large], weight[large]
        few, total, times = self._few(at[~large], weight[~large], count[~large])
        most = count[large].sum() + len(self.items)           # what `_all` would look at
        if len(few) * len(rows) > most:
            return None
        planes = _planes(maps[r] for r in rows.tolist()) if len(rows) > 1 else [maps[rows[0]].copy()]
        self_ = int(np.searchsorted(self.items, target))
        if self_ < len(self.items) and self.items[self_] == target:
            for p in planes:
                p[self_ >> 6] &= ~np.uint64(1 << (self_ & 63))
        k, mask = 1 << len(planes), None
        for i in range(len(planes) - 1, -1, -1):     # the largest count
            found = planes[i] if mask is None else mask & planes[i]
            k >>= 1
            if found.any():
                mask, high = found, k if mask is None else high + k
        if mask is not None:
            k = high
            mask = _at_least(planes, k)
            while k > 1 and int(np.bitwise_count(mask).sum(dtype=np.int64)) < n:
                k -= 1
                mask = _at_least(planes, k)
            order = np.sort(heavy)
            least, largest = order[:k].sum(), np.cumsum(order[::-1])
            need = int(np.searchsorted(largest, least - slack - 1e-9 * least)) + 1      # the fewest groups that may weigh as much
            if need < k:
                mask = _at_least(planes, need)
            if (int(np.bitwise_count(mask).sum(dtype=np.int64)) + len(few)) * len(rows) > most:
                return None
            found = _bits(mask)
        else:
            found = few[:0]
        if len(few):
            where = np.union1d(found, few)
            base, times_ = np.zeros(len(where)), np.zeros(len(where), np.int64)
            spot = np.searchsorted(where, few)
            base[spot], times_[spot] = total, times
        else:
            where, base, times_ = found, 0.0, 0
        held = (maps[rows[:, None], where >> 6] >> (where & 63).astype(np.uint64)) & np.uint64(1)
        return where, base + (heavy[:, None] * held).sum(axis=0), times_ + held.sum(axis=0).astype(np.int64)

    def partners(self, target, groups, sizes, n: int):
        """(places, weighted counts, counts) of the other items that share a group, at least those that may be among the n best."""
        at = np.minimum(np.searchsorted(self.groups, groups), len(self.groups) - 1)
        own = self.groups[at] == groups
        slack = TIE * float((1.0 / np.sqrt(sizes)).sum())
        at, weight = at[own], 1.0 / np.sqrt(sizes[own])
        count = self.ends[at + 1] - self.ends[at]
        if count.sum() * 8 < len(self.items):
            found = self._few(at, weight, count)
        else:
            found = self._best_of_large(target, at, weight, count, n, slack) or self._all(at, weight, count)
        place, total, times = found
        other = self.items[place] != target
        place, total, times = place[other], total[other], times[other]
        if len(place) > n:
            best = _best(total, n, slack)
            place, total, times = place[best], total[best], times[best]
        return place, total, times


def _best(total, n: int, slack: float):
    """Places of the n highest totals, and of those that may tie with the last one: n of each value, in their order."""
    last = np.partition(total, len(total) - n)[len(total) - n]
    best = np.flatnonzero(total >= last - slack)
    if len(best) > n:
        sure, near = best[total[best] > last + slack], best[total[best] <= last + slack]
        values, at = np.unique(total[near], return_inverse=True)
        order = np.argsort(at, kind="stable")
        starts = np.searchsorted(at[order], np.arange(len(values)))
        best = np.concatenate([sure, near[order[np.arange(len(near)) - starts[at[order]] < n]]])
    return best


def _topk_of_large_groups(changes: DataFrame, n: int, targets: DataFrame | None = None, **kw) -> DataFrame:
    """`cochange_topk` where the pairs of large groups would be too many to shuffle: each target's groups are streamed past
    blocks of the groups' members, which are broadcast, and only its best partners of a block leave a task."""
    spark = changes.sparkSession
    g = written(clean_groups(changes, **kw).where(F.col("item").isNotNull()))
    touches, id_type = g.count(), dict(g.dtypes)["item"]
    left = g if targets is None else g.join(targets.select(F.col("item_id").alias("item")).distinct(), "item", "left_semi")
    lists = left.groupBy(F.col("item").alias("target")).agg(F.collect_list(F.struct("group_id", "n")).alias("g"))
    blocks = max(1, -(-touches // BLOCK_TOUCHES))
    tasks = max(4 * spark.sparkContext.defaultParallelism, -(-touches // TASK_TOUCHES))
    lists = lists.repartition(tasks)
    lists = written(lists) if blocks > 1 else lists
    ship_by_value(__name__)

    def members(p):
        rows = g.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == p).select("group_id", "item").toArrow()
        return spark.sparkContext.broadcast(_Members(*(c.to_numpy() for c in rows.columns)))

    def stream(batches, block):
        import pyarrow as pa
        known = block.value
        for b in batches:
            g_ = b.column(1)
            ends = g_.offsets.to_numpy()
            groups, sizes = (g_.values.field(i).to_numpy(zero_copy_only=False) for i in range(2))
            out = []
            for row, target in enumerate(b.column(0).to_pylist()):
                own = slice(ends[row], ends[row + 1])
                if len(known.items):
                    place, *figures = known.partners(target, groups[own], sizes[own], n)
                    if len(place):
                        out.append((np.full(len(place), row), known.items[place], *figures))
            if out:
                row, item, total, count = map(np.concatenate, zip(*out))
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(item, b.schema.field(0).type), pa.array(total), pa.array(count)],
                                                 names=["target", "candidate", "weighted_count", "commit_count"])
    schema = f"target {id_type}, candidate {id_type}, weighted_count double, commit_count bigint"
    out = None
    for p in range(blocks):
        block = members(p)
        found = written(lists.mapInArrow(lambda batches, block=block: stream(batches, block), schema))
        block.destroy()
        out = found if out is None else out.unionByName(found)
    most = F.max("weighted_count").over(Window.partitionBy("target"))       # the best partner is always found
    return top_n_per_key(out.withColumn("score", F.col("weighted_count") / most), "target", "score", "candidate", n)


def cochange_topk(changes: DataFrame, n: int = 10, **kw) -> DataFrame:
    """K6 over co-change: each item's n most co-changed partners."""
    largest = kw.get("max_size", W.MAX_GROUP)
    if largest is None or largest > BLOCK:
        return _topk_of_large_groups(changes, n, **kw)
    return top_n_per_key(cochange_scores(cochange_pairs(changes, **kw)),
                         "target", "score", "candidate", n)
