"""Pairwise similarity expressions (J2, J4-J12, J15) over feature columns.

All are built-in Catalyst expressions.  Jaro-Winkler has no built-in, so it is
composed from higher-order functions (``aggregate``/``filter``/``transform``);
it is the costliest signal and jobs call it on pruned, de-duplicated pairs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import wordlists as W
from .paths import words


def let(value: Column, fn) -> Column:
    """Bind ``value`` once and use it several times inside ``fn``."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def weighted_jaccard(a: Column, b: Column, noise=W.NOISE_TOKENS,
                     noise_weight=W.NOISE_WEIGHT) -> Column:
    """Sum of weights of shared tokens over sum for all tokens (as sets).

    Two empty lists -> 1.0; a zero-weight union -> 0.0.
    """
    noise_arr = words(noise)

    def wsum(arr):
        return F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + F.when(
            F.array_contains(noise_arr, x), F.lit(noise_weight)).otherwise(F.lit(1.0)))

    union_w = wsum(F.array_union(a, b))
    inter_w = wsum(F.array_intersect(a, b))
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
            .when(union_w == 0, F.lit(0.0))
            .otherwise(inter_w / union_w))


def hashed_set(tokens: Column) -> Column:
    """Distinct tokens as 64-bit hashes (once per item): pair jobs then
    intersect primitive long arrays instead of strings."""
    return F.array_distinct(F.transform(tokens, lambda x: F.xxhash64(x)))


def hashed_words(values) -> Column:
    return F.array(*[F.xxhash64(F.lit(v)) for v in values])


def token_set_weight(hset: Column, noise=W.NOISE_TOKENS, noise_weight=W.NOISE_WEIGHT) -> Column:
    """Weight of a hashed token set: noise tokens count ``noise_weight``."""
    return F.size(hset) - (1.0 - noise_weight) * F.size(F.array_intersect(hset, hashed_words(noise)))


def weighted_jaccard_pre(a: Column, wa: Column, b: Column, wb: Column, noise=W.NOISE_TOKENS,
                         noise_weight=W.NOISE_WEIGHT, one_sided_zero: bool = False) -> Column:
    """J2/J4/J5 over hashed token sets (``hashed_set``) with per-item set
    weights precomputed (``token_set_weight``).

    Per pair it needs only ``array_intersect`` and sizes (code-generated, no
    lambdas): I = |A n B| - (1 - w_noise) |A n B n NOISE|, U = Wa + Wb - I.
    """
    inter = F.array_intersect(a, b)
    i_w = F.size(inter) - (1.0 - noise_weight) * F.size(F.array_intersect(inter, hashed_words(noise)))
    u_w = wa + wb - i_w
    both_empty = (F.size(a) == 0) & (F.size(b) == 0)
    out = F.when(both_empty, F.lit(1.0))
    if one_sided_zero:
        out = out.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
    return out.when(u_w <= 0, F.lit(0.0)).otherwise(i_w / u_w)


def one_sided_jaccard(a: Column, b: Column, **kw) -> Column:
    """As J2, but exactly one empty side gives 0.0."""
    return (F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0))
            .when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0))
            .otherwise(weighted_jaccard(a, b, **kw)))


def set_jaccard(a: Column, b: Column) -> Column:
    """J13 on arrays: plain Jaccard of distinct values; both empty -> 0.0."""
    u = F.size(F.array_union(a, b))
    return F.when(u == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / u)


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro-Winkler similarity over characters.

    Matching window max(|a|,|b|)/2 - 1 (not below 0); transpositions halved by
    integer division; the prefix bonus (up to 4 characters, 0.1 each) applies
    only when Jaro exceeds 0.7; two empty strings -> 1.0, one empty -> 0.0.
    The character arrays are bound once as lambda variables, so each lookup
    inside the loops is an array access, not a new split.
    """
    chars = F.struct(F.split(a, "").alias("a"), F.split(b, "").alias("b"))
    jw = let(chars, lambda s: _jaro_winkler_chars(s["a"], s["b"]))
    return (F.when((F.length(a) == 0) & (F.length(b) == 0), F.lit(1.0))
            .when((F.length(a) == 0) | (F.length(b) == 0), F.lit(0.0))
            .otherwise(jw))


def _jaro_winkler_chars(ca: Column, cb: Column) -> Column:
    la, lb = F.size(ca), F.size(cb)
    reach = F.greatest(F.floor(F.greatest(la, lb) / 2).cast("int") - 1, F.lit(0))

    init = F.struct(F.array_repeat(F.lit(False), lb).alias("bf"),
                    F.array().cast("array<int>").alias("am"))

    def step(acc, i):
        ch = F.element_at(ca, i + 1)
        window = F.sequence(F.greatest(F.lit(0), i - reach), F.least(lb - 1, i + reach))
        hits = F.filter(window, lambda j: (F.element_at(cb, j + 1) == ch)
                        & ~F.element_at(acc["bf"], j + 1))
        found = F.when(i - reach <= lb - 1, F.try_element_at(hits, F.lit(1)))
        return let(found, lambda j: F.when(j.isNull(), acc).otherwise(
            F.struct(F.transform(acc["bf"], lambda f, k: f | (k == j)).alias("bf"),
                     F.concat(acc["am"], F.array(i)).alias("am"))))

    def finish(acc):
        m = F.size(acc["am"])
        from_a = F.transform(acc["am"], lambda i: F.element_at(ca, i + 1))
        from_b = F.filter(F.transform(cb, lambda c, k: F.when(F.element_at(acc["bf"], k + 1), c)),
                          lambda x: x.isNotNull())
        half_t = F.floor(F.size(F.filter(F.zip_with(from_a, from_b, lambda x, y: x != y),
                                         lambda x: x)) / 2)
        return F.when(m == 0, F.lit(0.0)).otherwise(
            (m / la + m / lb + (m - half_t) / m) / 3.0)

    jaro = F.aggregate(F.sequence(F.lit(0), la - 1), init, step, finish)
    heads = F.zip_with(F.slice(ca, 1, 4), F.slice(cb, 1, 4),
                       lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_miss = F.array_position(heads, False)
    prefix = F.when(first_miss == 0, F.size(heads)).otherwise(first_miss - 1)
    return let(jaro, lambda j: F.when(j > 0.7, j + 0.1 * prefix * (1.0 - j)).otherwise(j))


def name_similarity(t: Column, c: Column, boost: float, jw=None) -> Column:
    """J6 (boost .15, stems) / J7 (boost .10, names): JW plus a containment
    boost, capped at 1; an empty side gives 0."""
    jw = jw or jaro_winkler_arrow
    contains = F.when((F.instr(c, t) > 0) | (F.instr(t, c) > 0), F.lit(boost)).otherwise(F.lit(0.0))
    return (F.when((F.length(t) == 0) | (F.length(c) == 0), F.lit(0.0))
            .otherwise(F.least(F.lit(1.0), jw(t, c) + contains)))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    """1 - edit distance (characters) / longer length (bytes); both empty 1."""
    longest = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1.0 - F.levenshtein(a, b) / longest)


def dir_proximity(da: Column, db: Column) -> Column:
    """Leading folder components in common / deeper depth; both root 1."""
    same = F.zip_with(da, db, lambda x, y: F.coalesce(x == y, F.lit(False)))
    first_diff = F.array_position(same, False)
    common = F.when(first_diff == 0, F.size(same)).otherwise(first_diff - 1)
    depth = F.greatest(F.size(da), F.size(db))
    return F.when(depth == 0, F.lit(1.0)).otherwise(common / depth)


def recency(mtime: Column, as_of: Column, hours_scale: float = W.RECENCY_HOURS) -> Column:
    """exp(-hours since change / 69.3); missing or future times give 0."""
    hours = (F.unix_micros(as_of.cast("timestamp")) - F.unix_micros(mtime.cast("timestamp"))) / 3.6e9
    return F.when(mtime.isNull() | (mtime > as_of), F.lit(0.0)).otherwise(F.exp(-hours / hours_scale))


def _codes(strings, width: int):
    """Code points of the strings as rows of one matrix, padded with -1."""
    import numpy as np
    out = np.full((len(strings), width), -1, np.int32)
    for i, x in enumerate(strings):
        out[i, :len(x)] = np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.int32)
    return out


def _packed(codes, matched):
    """Matched characters moved to the front, in order; the rest -1."""
    import numpy as np
    order = np.argsort(~matched, axis=1, kind="stable")
    return np.take_along_axis(np.where(matched, codes, -1), order, axis=1)


def jaro_winkler_matrix(a, b):
    """Jaro-Winkler (same rules as ``jaro_winkler``) of two lists of strings,
    all pairs of a chunk at once: one numpy step per character position."""
    import numpy as np
    la, lb = (np.fromiter(map(len, x), np.int64, len(x)) for x in (a, b))
    ca, cb = _codes(a, max(la.max(initial=0), 1)), _codes(b, max(lb.max(initial=0), 1))
    cb[cb == -1] = -2                                     # padding never matches
    reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
    m, swaps = _matches_by_bits(ca, cb, reach) or _matches(ca, cb, reach)
    width = min(ca.shape[1], cb.shape[1])
    with np.errstate(divide="ignore", invalid="ignore"):
        jaro = np.where(m == 0, 0.0, (m / la + m / lb + (m - swaps) / m) / 3.0)
    head = min(4, width)
    prefix = np.cumprod(ca[:, :head] == cb[:, :head], axis=1).sum(axis=1)
    out = np.where(jaro > 0.7, jaro + 0.1 * prefix * (1.0 - jaro), jaro)
    return np.where((la == 0) & (lb == 0), 1.0, np.where((la == 0) | (lb == 0), 0.0, out))


def _matches_by_bits(ca, cb, reach):
    """As `_matches`, with a string's places as the bits of a word; None if strings or alphabet are too large for that."""
    import numpy as np
    if max(ca.shape[1], cb.shape[1]) > 64 or max(ca.max(initial=0), cb.max(initial=0)) >= 1 << 16:
        return None
    seen = np.zeros((1 << 16) + 2, bool)                # numbers for the characters at hand; padding has two of its own
    seen[ca + 2], seen[cb + 2] = True, True
    number = np.cumsum(seen) - 1
    ca, cb, letters = number[ca + 2], number[cb + 2], int(number[-1]) + 1
    if letters > 256:
        return None
    rows, one, ones = np.arange(len(ca)), np.uint64(1), np.uint64(2 ** 64 - 1)
    places = np.zeros((len(ca), letters), np.uint64)    # of each character in b
    for j in range(cb.shape[1]):
        places[rows, cb[:, j]] |= one << np.uint64(j)
    used, ma = np.zeros(len(ca), np.uint64), np.zeros(len(ca), np.uint64)
    for i in range(ca.shape[1]):
        window = (ones << np.maximum(i - reach, 0).astype(np.uint64)) & (ones >> (63 - np.minimum(i + reach, 63)).astype(np.uint64))
        hit = places[rows, ca[:, i]] & window & ~used
        used |= hit & (~hit + one)
        ma |= (hit != 0).astype(np.uint64) << np.uint64(i)
    m, swaps = np.bitwise_count(used).astype(np.int64), np.zeros(len(ca), np.int64)
    for _ in range(int(m.max(initial=0))):
        more = ma != 0
        at, bt = (np.minimum(np.bitwise_count((x & (~x + one)) - one), 63) for x in (ma, used))
        swaps += more & (ca[rows, np.minimum(at, ca.shape[1] - 1)] != cb[rows, np.minimum(bt, cb.shape[1] - 1)])
        ma, used = ma & (ma - one), used & (used - one)
    return m, swaps // 2


def _matches(ca, cb, reach):
    """How many characters match, and half of those out of order."""
    import numpy as np
    place, rows = np.arange(cb.shape[1]), np.arange(len(ca))
    ma, mb = np.zeros(ca.shape, bool), np.zeros(cb.shape, bool)
    for i in range(ca.shape[1]):
        hit = (cb == ca[:, i, None]) & ~mb & (np.abs(place - i) <= reach[:, None])
        first, any_hit = hit.argmax(axis=1), hit.any(axis=1)
        ma[:, i] = any_hit
        mb[rows[any_hit], first[any_hit]] = True
    m = ma.sum(axis=1)
    width = min(ca.shape[1], cb.shape[1])
    return m, (_packed(ca, ma)[:, :width] != _packed(cb, mb)[:, :width]).sum(axis=1) // 2


def _jw_batch(a, b):
    """Distinct pairs of the batch, in chunks of like length, so that padding stays small."""
    import numpy as np
    import pandas as pd
    known = (a.notna() & b.notna()).to_numpy()
    out = np.full(len(a), np.nan)
    if not known.any():
        return pd.Series(out)
    pairs = pd.MultiIndex.from_arrays([a[known], b[known]])
    place, unique = pairs.factorize()
    left, right = (unique.get_level_values(i).to_numpy(object) for i in (0, 1))
    longest = np.fromiter((max(len(x), len(y)) for x, y in zip(left, right)), np.int64, len(unique))
    score, order = np.empty(len(unique)), np.argsort(longest, kind="stable")
    at = 0
    while at < len(order):
        n = max(1, min(4096, 4_000_000 // (int(longest[order[min(at + 4095, len(order) - 1)]]) + 1) ** 2))
        rows = order[at:at + n]
        score[rows] = jaro_winkler_matrix(left[rows].tolist(), right[rows].tolist())
        at += n
    out[known] = score[place]
    return pd.Series(out)


_JW_UDF = None


def ship_by_value(*modules: str):
    """Pickle the helpers of this module and of `modules` by value, so Python workers
    need no installed copy of the package (as with --py-files on a cluster)."""
    import sys

    from pyspark import cloudpickle
    for name in (__name__, *modules):
        cloudpickle.register_pickle_by_value(sys.modules[name])


def jaro_winkler_arrow(a: Column, b: Column) -> Column:
    """J8 as an Arrow-batched pandas UDF.

    Measured at sf0.01 on 231k path-string pairs: the higher-order-function
    form (``jaro_winkler``) spends about 2 ms of CPU per pair because every
    lambda step allocates; this form works on the distinct pairs of a batch with
    numpy, one step per character position.  Spark partitions and prunes the
    pairs it is applied to.
    """
    global _JW_UDF
    if _JW_UDF is None:
        ship_by_value()
        _JW_UDF = F.pandas_udf(_jw_batch, "double")
    return _JW_UDF(a, b)
