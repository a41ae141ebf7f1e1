"""Item vectors from category text."""

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F


def hashed_text_vectors(df: DataFrame, column: str = "categories", features: int = 768) -> DataFrame:
    """``df`` with ``v``: TF-IDF weights of the text's words, hashed to ``features`` components."""
    filled = df.withColumn("_text", F.coalesce(F.col(column), F.lit("")))
    words = RegexTokenizer(inputCol="_text", outputCol="_words", pattern=r"[^\p{L}\p{N}#]+").transform(filled)
    counts = HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features).transform(words)
    weighted = IDF(inputCol="_tf", outputCol="_idf").fit(counts).transform(counts)
    return weighted.withColumn("v", vector_to_array("_idf")).drop("_text", "_words", "_tf", "_idf")


def model_vectors(df: DataFrame, column: str,
                  load: Callable[[], Callable[[list[str]], list]]) -> DataFrame:
    """``df`` with ``v`` from a sentence encoder; ``load`` runs once per task, not per batch."""
    @F.pandas_udf("array<double>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = load()
        for batch in batches:
            yield pd.Series([[float(x) for x in row] for row in encoder(batch.fillna("").tolist())])

    return df.withColumn("v", encode(F.col(column)))
