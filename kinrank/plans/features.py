"""Build item features: one projection over the items table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import similarity as S


def item_features(items: DataFrame) -> DataFrame:
    """Adds the per-item path features.  All are built-in expressions, so the
    projection is evaluated next to the scan with no shuffle."""
    p = F.col("path")
    return (items
            .withColumn("path_tokens", P.normalize(p))
            .withColumn("path_string", F.array_join("path_tokens", " "))
            .withColumn("stem", P.primary_stem(p))
            .withColumn("basename", P.basename(p))
            .withColumn("extensions", P.extension_tokens(p))
            .withColumn("domain", P.domain_tokens(p))
            .withColumn("dir", P.parent_dir(p))
            .withColumn("dirs", P.dir_parts(p))
            .withColumn("language", P.language(p))
            # Distinct token sets and their weights, once per item, so pair
            # jobs compute weighted Jaccard without per-pair lambdas.
            .withColumn("path_set", S.hashed_set(F.col("path_tokens")))
            .withColumn("path_w", S.token_set_weight(F.col("path_set")))
            .withColumn("domain_set", S.hashed_set(F.col("domain")))
            .withColumn("domain_w", S.token_set_weight(F.col("domain_set")))
            .withColumn("ext_set", S.hashed_set(F.col("extensions")))
            .withColumn("ext_w", S.token_set_weight(F.col("ext_set"))))
