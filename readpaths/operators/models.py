"""Model-based operators from ``pyspark.ml``."""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame


def reduce_dimension(vectors: DataFrame, k: int = 50, id_col: str = "page_id", vec_col: str = "vector") -> DataFrame:
    """Vectors projected onto their first ``k`` principal components (J6): ``<id_col>, vector``.

    The reference shrinks its word model from 300 to 50 dimensions before
    use.  Only the ``d x d`` covariance matrix of ``PCA`` reaches the
    driver; the projection runs per row.
    """
    feats = vectors.select(id_col, array_to_vector(vec_col).alias("_f"))
    model = PCA(k=k, inputCol="_f", outputCol="_p").fit(feats)
    return model.transform(feats).select(id_col, vector_to_array("_p").alias("vector"))
