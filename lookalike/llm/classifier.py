"""A quality classifier that is a sparse sum of rules.

Trees are grown on statistics of labelled texts. Every path from a root to a
node is a conjunction of thresholds; a lasso logistic regression over these
conjunctions keeps the few that matter. The result is a list of rules with
weights, compiled to one column expression, so scoring is a narrow pass.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.store import cut_lineage, fresh_dir
from .common import held_out_rows, whole
from .quality_rules import measured

#: Labelled rows that training uses at most (about), chosen by a hash.
SAMPLE_ROWS = 200_000
TREES, DEPTH, PENALTY, SEED = 20, 3, 0.0005, 11
THRESHOLD = 0.7
MODULUS, REST = 4, 2

#: Statistics over the ledger's measurements and the text's marks.
FEATURES = {
    "log_words": "ln(1 + n_words)",
    "word_length": "word_chars / n_words",
    "symbols": "n_symbols / n_words",
    "repeated_lines": "n_dup_lines / n_lines",
    "repeated_windows": "n_repeat_words / n_words",
    "upper": "n_upper / n_letters",
    "letters": "n_letters / word_chars",
    "marks": "n_marks / n_words",
    "stops": "n_stops / n_words",
    "words_a_line": "n_words / n_lines",
}


class Rule(NamedTuple):
    """Features with the bounds (above, up to) they must keep, and a weight."""

    bounds: tuple[tuple[str, float, float], ...]
    weight: float

    def holds(self) -> Column:
        met = F.lit(True)
        for name, above, most in self.bounds:
            if above > float("-inf"):
                met = met & (F.col(name) > above)
            if most < float("inf"):
                met = met & (F.col(name) <= most)
        return met


class Model(NamedTuple):
    rules: tuple[Rule, ...]
    constant: float

    def score(self) -> Column:
        """The odds as a column over ``FEATURES``."""
        total = F.lit(self.constant)
        for rule in self.rules:
            total = total + F.when(rule.holds(), rule.weight).otherwise(0.0)
        return 1 / (1 + F.exp(-total))


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ``FEATURES`` as doubles, a row per row of ``docs``. A null
    text is empty; what cannot be told of an empty text is 0."""
    row = F.struct(F.col(id_col).alias("id"), *[
        F.length(F.regexp_replace(whole(text_col), but, "")).alias(name)
        for name, but in (("n_marks", r"[^!?]+"), ("n_stops", r"[^.,;:]+"))
    ])
    found = measured(docs.select(row.alias("row"), F.col(text_col).alias("body")), "row", "body")
    found = found.select("doc_id.*", *[c for c in found.columns if c != "doc_id"])
    ratios = [
        F.coalesce(F.expr(f"try_divide({e.replace(' / ', ', ')})" if " / " in e else e), F.lit(0.0)).cast("double").alias(name)
        for name, e in FEATURES.items()
    ]
    return found.select(F.col("id").alias("doc_id"), *ratios)


def _paths(tree) -> set[tuple[tuple[str, float, float], ...]]:
    """The conjunctions that lead to the nodes of a tree, the root left out."""
    names, found = list(FEATURES), set()
    inf = float("inf")

    def walk(node, bounds):
        if bounds:
            found.add(tuple((n, *b) for n, b in sorted(bounds.items())))
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            name, at = names[split.featureIndex()], split.threshold()
            above, most = bounds.get(name, (-inf, inf))
            walk(node.leftChild(), bounds | {name: (above, min(most, at))})
            walk(node.rightChild(), bounds | {name: (max(above, at), most)})

    walk(tree._call_java("rootNode"), {})
    return found


def fit(examples: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model:
    """Learn from ``examples`` (doc_id, label 0 or 1, and ``FEATURES``).

    Up to about ``sample_rows`` are used, chosen by a hash of the id. Without
    examples the model says 1/2; if all have one label, it is near that label.
    """
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector

    n = examples.count()
    if n > sample_rows:
        part = int(1_000_000 * sample_rows / n)
        examples = examples.where(F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1_000_000)) < part)
    examples = cut_lineage(examples.withColumn("label", F.col("label").cast("double")))
    n, ones = examples.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if ones in (0, n):
        import math

        return Model((), math.log((ones + 1) / (n - ones + 1)))
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(examples)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, featureSubsetStrategy="sqrt", maxBins=64)
    paths = sorted(set().union(*map(_paths, forest.fit(vectors).trees)))
    rules = [Rule(p, 0.0) for p in paths]
    met = array_to_vector(F.array(*[r.holds().cast("double") for r in rules]))
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=PENALTY, standardization=False, maxIter=60)
    fitted = lasso.fit(examples.select("label", met.alias("features")))
    weights = fitted.coefficients.toArray()
    return Model(tuple(Rule(p, float(w)) for p, w in zip(paths, weights) if w), float(fitted.intercept))


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality") -> DataFrame:
    """doc_id, held_out, score, predicted: a row per row of ``docs``.

    ``labels`` (doc_id, label) may lack documents, name unknown ones, or hold
    nulls, which teach nothing. Rows of the held-out part teach nothing either.
    Null ids are scored and not held out. An empty table gives an empty one.
    """
    place = fresh_dir(docs.sparkSession, "statistics")
    statistics(docs).write.parquet(place)
    known = docs.sparkSession.read.parquet(place)
    taught = labels.select("doc_id", F.col(label_col).alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    examples = known.join(taught.where(~held_out_rows(F.col("doc_id"), MODULUS, REST)), "doc_id")
    score = fit(examples).score().alias("score")
    return known.select("doc_id", held_out_rows(F.col("doc_id"), MODULUS, REST).alias("held_out"), score).withColumn(
        "predicted", (F.col("score") >= THRESHOLD).cast("int")
    )
