"""Reference overlap (J14) and best reference per pair.

A reference (tokens t1..tn, weight w) of a target matches a candidate when at
least half of its tokens (duplicates counted) occur in the candidate's path
token set; the pair's bonus is the best min(share * w, 1.5) over the
target's references.

Many items hold the same reference, and many candidates the same token set, so
the match runs between distinct token lists and distinct sets.  `ref_overlap`
takes the best reference between targets and classes of candidates (equal sets,
named by their smallest member) and expands it to the pairs; `overlap_classes` has
it between classes of targets (equal references and weights) and of candidates.  Prefix filter
(lossless): order a reference's distinct tokens rarest first.  A set that holds
none of the tokens whose remaining multiplicity (from that token on) is still
>= ceil(n/2) cannot reach half, so only those tokens are join keys.  The lists and
the sets of a common token are cut into slices of at most about ``SLICE`` each, and
every slice of lists meets every slice of sets under a key of its own, so no task
gets a whole hot token.  Survivors are verified against the full token list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import wordlists as W
from ..session import written

MARK = "\u0001"              # joins the tokens of a reference; no token holds it


SLICE = 2000                 # lists or sets of a token that meet in one task


def memberships(refs: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(target, ref, weight): the distinct references of each item, tokens joined by MARK, with their best weight;
    (candidate, cset, kind): each item's distinct tokens and the smallest item that has the same ones."""
    uses = written(refs.where(F.size("tokens") > 0)
                   .select(F.col("item_id").alias("target"), F.array_join("tokens", MARK).alias("ref"), "weight")
                   .groupBy("target", "ref").agg(F.max("weight").alias("weight")))
    sets = candidates.select(F.col("item_id").alias("candidate"), F.array_sort(F.array_distinct("path_tokens")).alias("cset"))
    kinds = sets.groupBy("cset").agg(F.min("candidate").alias("kind"))
    return uses, written(sets.join(kinds, "cset"))


def list_matches(uses: DataFrame, sets: DataFrame) -> DataFrame:
    """(ref, kind, share): every token list and set class of which the list has at least half its tokens."""
    kinds = sets.where(F.col("candidate") == F.col("kind")).select("kind", "cset").distinct()
    postings = kinds.select("kind", F.explode("cset").alias("token"))
    dfreq = postings.groupBy("token").agg(F.count(F.lit(1)).alias("df"))

    lists = uses.select("ref").distinct().withColumn("tokens", F.split("ref", MARK))
    need = F.ceil(F.size("tokens") * W.REF_SHARE_MIN).alias("need")
    toks = (lists.select("ref", need, F.explode("tokens").alias("token"))
            .groupBy("ref", "need", "token").agg(F.count(F.lit(1)).alias("mult"))
            .join(dfreq, "token", "left").withColumn("df", F.coalesce("df", F.lit(0))))
    w = (Window.partitionBy("ref").orderBy(F.col("df").desc(), F.col("token").desc())
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    prefix = written(toks.withColumn("rest", F.sum("mult").over(w))   # multiplicity from this token on
                     .where((F.col("rest") >= F.col("need")) & (F.col("df") > 0)).select("ref", "token", "df"))

    # Slices of a token: m of its lists, n of its sets.
    cuts = (prefix.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / SLICE).alias("m"), F.ceil(F.max("df") / SLICE).alias("n")))
    def sliced(df, own, key, other):  # noqa: E306
        return (df.join(cuts, "token").withColumn(f"s_{own}", F.pmod(F.xxhash64(key), F.col(own)))
                .withColumn(f"s_{other}", F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1))).drop("m", "n"))
    left, right = sliced(prefix.drop("df"), "m", "ref", "n"), sliced(postings, "n", "kind", "m")

    tokens = F.split("ref", MARK)
    plain = F.size(F.array_distinct(tokens)) == F.size(tokens)
    overlap = (F.when(plain, F.size(F.array_intersect(tokens, "cset")))
               .otherwise(F.size(F.filter(tokens, lambda x: F.array_contains("cset", x)))))
    return (left.join(right, ["token", "s_m", "s_n"]).select("ref", "kind").distinct()
            .join(kinds, "kind").withColumn("share", overlap / F.size(tokens))
            .where(F.col("share") >= W.REF_SHARE_MIN).select("ref", "kind", "share"))


def target_classes(uses: DataFrame) -> DataFrame:
    """(target, target_class): the smallest item that has the same references with the same weights."""
    refs = F.array_sort(F.collect_list(F.struct("ref", "weight")))
    named = (uses.groupBy("target").agg(refs.alias("refs"))
             .select("target", F.xxhash64("refs").alias("k1"), F.xxhash64(F.lit("refs"), "refs").alias("k2")))    # 128 bits name them
    reps = named.groupBy("k1", "k2").agg(F.min("target").alias("target_class"))
    return named.join(reps, ["k1", "k2"]).select("target", "target_class")


def overlap_classes(refs: DataFrame, candidates: DataFrame) -> DataFrame:
    """(target_class, candidate_class, bonus, links): the best capped share * weight between classes, with the number of
    (target, candidate) pairs of different items behind each.  Its rows grow with the classes, not with the pairs."""
    uses, sets = memberships(refs, candidates)
    targets = written(target_classes(uses))
    own = uses.join(targets.where(F.col("target") == F.col("target_class")).select("target"), "target")
    best = (own.join(list_matches(own, sets), "ref").groupBy(F.col("target").alias("target_class"), "kind")
            .agg(F.max(F.least(F.col("share") * F.col("weight"), F.lit(W.REF_CAP))).alias("bonus")))
    n_targets = targets.groupBy("target_class").agg(F.count(F.lit(1)).alias("u"))
    n_members = sets.groupBy("kind").agg(F.count(F.lit(1)).alias("c"))
    self = (targets.join(sets.select(F.col("candidate").alias("target"), "kind"), "target")
            .groupBy("target_class", "kind").agg(F.count(F.lit(1)).alias("own")))
    return (best.join(n_targets, "target_class").join(n_members, "kind").join(self, ["target_class", "kind"], "left")
            .select("target_class", F.col("kind").alias("candidate_class"), "bonus",
                    (F.col("u") * F.col("c") - F.coalesce("own", F.lit(0))).alias("links"))
            .where(F.col("links") > 0))


def ref_overlap(refs: DataFrame, candidates: DataFrame, exclude_self: bool = True) -> DataFrame:
    """refs: (item_id, tokens, weight) of stated targets; candidates: (item_id, path_tokens).

    Returns (target, candidate, bonus) with bonus = best capped share * weight.
    """
    uses, sets = memberships(refs, candidates)
    best = written(uses.join(list_matches(uses, sets), "ref").groupBy("target", "kind")
                   .agg(F.max(F.least(F.col("share") * F.col("weight"), F.lit(W.REF_CAP))).alias("bonus")))
    members = sets.select("kind", "candidate").distinct()
    several = members.groupBy("candidate").agg(F.count(F.lit(1)).alias("kinds")).where(F.col("kinds") > 1)   # of ids that repeat
    pairs = lambda of: best.join(of, "kind").select("target", "candidate", "bonus")
    out = pairs(members.join(several, "candidate", "left_anti")).unionByName(
        pairs(members.join(several, "candidate", "left_semi")).groupBy("target", "candidate").agg(F.max("bonus").alias("bonus")))
    return out.where(F.col("target") != F.col("candidate")) if exclude_self else out
