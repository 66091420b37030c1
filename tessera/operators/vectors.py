"""Pooled vectors, global norm clipping, classifier head."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tessera.functions.loss import cross_entropy


def mean_pool(vectors: DataFrame, group_col: str, vec_col: str = "embedding") -> DataFrame:
    """Element-wise mean per group as ``(group, dim, mean)`` rows; the
    exploded elements are partially aggregated before the shuffle, so a hot
    group costs one row per dimension per map task."""
    return (vectors.select(group_col, F.posexplode(vec_col).alias("dim", "x"))
            .groupBy(group_col, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean")))


def first_pool(vectors: DataFrame, group_col: str, order_col: str, vec_col: str = "embedding") -> DataFrame:
    """The vector of the first row (lowest ``order_col``) of each group."""
    first = vectors.groupBy(group_col).agg(F.min_by(vec_col, order_col).alias("v"),
                                           F.min(order_col).alias("first_id"))
    return first.select(group_col, "first_id", F.posexplode("v").alias("dim", "x"))


def clip_global_norm(vectors: DataFrame, max_norm: float = 1.0, vec_col: str = "embedding",
                     eps: float = 1e-6) -> DataFrame:
    """One global L2 norm over all elements (a partial/final aggregate to
    one number on the driver) and every vector scaled by
    ``min(1, max_norm / (norm + eps))``."""
    sq = F.aggregate(vec_col, F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double"))
    norm = vectors.agg(F.sqrt(F.sum(sq))).first()[0] or 0.0
    scale = min(1.0, max_norm / (norm + eps))
    return (vectors.withColumn("global_norm", F.lit(float(norm))).withColumn("scale", F.lit(float(scale)))
            .withColumn("clipped", F.transform(vec_col, lambda x: x.cast("double") * F.col("scale"))))


def logits_loss(vectors: DataFrame, label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """F7 per row: cross-entropy of the vector read as logits against the label."""
    return vectors.withColumn("ce", cross_entropy(vec_col, label_col))


def fit_classifier(vectors: DataFrame, label_col: str = "label", vec_col: str = "embedding",
                   reg: float = 0.0, max_iter: int = 50):
    """Multinomial logistic regression on the (already pooled) vectors, the
    counterpart of a linear head trained with cross-entropy."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector
    data = vectors.select(F.col(label_col).cast("double").alias("label"),
                          array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"))
    model = LogisticRegression(family="multinomial", regParam=reg, maxIter=max_iter).fit(data)
    return model


def classifier_accuracy(model, vectors: DataFrame, label_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    from pyspark.ml.functions import array_to_vector
    data = vectors.select(F.col(label_col).cast("double").alias("label"),
                          array_to_vector(F.col(vec_col).cast("array<double>")).alias("features"))
    pred = model.transform(data)
    return pred.agg(F.count(F.lit(1)).cast("bigint").alias("n"),
                    F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))
