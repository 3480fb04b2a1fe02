"""Token counts per document by rank-synchronous merging."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder

LIMIT = 2048


def count_tokens(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT
) -> DataFrame:
    """One row per document: ``doc_id n_bytes n_tokens over_limit``.

    ``vocabulary`` is the path of a word-level BPE file at the same place on every executor. No
    begin, end or added tokens; special strings inside a text are one token each. Null and empty
    texts have no tokens. Repeated rows each come back, other columns are not read, an empty table
    gives no rows. Nothing is shuffled; a text of any length is taken whole.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = encoder(vocabulary)
        for b in batches:
            yield pd.DataFrame({
                "doc_id": b["doc_id"].astype("Int64"),
                "n_bytes": [len(t.encode()) for t in b["text"]],
                "n_tokens": [len(ids) // 4 for ids in bpe.encode_all(b["text"].tolist())],
            })

    counted = rows.mapInPandas(work, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
