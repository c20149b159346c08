"""The fourteen lookup tables between tokens, clusters, vectors and keys.

Each one is a projection of the same assigned table: image_id, sel_id,
cluster_id, features, phash, ward. They are bags: one row per selection, or
per selection and token. Writing each of them is optional.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import LOOKUP_TABLES
from ..functions.tokens import token_ngrams

# Which columns each part of a table's name stands for.
_PARTS = {
    "key": ("image_id", "image_id"),
    "cluster": ("cluster_id", "cluster_id"),
    "flattened": ("features", "features"),
}


def token_lookup(assigned: DataFrame, name: str, ngram_length: int = 2) -> DataFrame:
    """One lookup table by name, such as ``phash_to_key``."""
    if name not in LOOKUP_TABLES:
        raise ValueError(f"unknown lookup table {name!r}")
    left, right = name.split("_to_")
    tokens = {
        "phash": token_ngrams(F.col("phash"), ngram_length),
        "ward": F.col("ward"),
    }

    def column(part: str):
        if part in tokens:
            return F.explode(tokens[part]).alias("token")
        source, alias = _PARTS[part]
        return F.col(source).alias(alias)

    return assigned.select(column(left), column(right))


def token_lookups(
    assigned: DataFrame, names=LOOKUP_TABLES, ngram_length: int = 2
) -> dict[str, DataFrame]:
    """The chosen lookup tables by name."""
    return {name: token_lookup(assigned, name, ngram_length) for name in names}


def cluster_weights(assigned: DataFrame, kind: str, ngram_length: int = 2) -> DataFrame:
    """Rows of ``cluster_to_<kind>`` per cluster: one row per cluster."""
    if kind == "phash":
        rows = F.size(token_ngrams(F.col("phash"), ngram_length))
    else:
        rows = F.size(kind)
    return assigned.groupBy("cluster_id").agg(F.sum(rows.cast("bigint")).alias("n_b")).where("n_b > 0")
