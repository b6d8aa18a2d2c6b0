"""Folds over ordered partitions as table functions for SQL."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class TokenBatches:
    """id, batch (from 0), tokens of a partition's rows(id, tokens, budget), longest first: a batch is padded to its longest text.

    A row opens a batch if its batch's longest, times one more row, would exceed the budget; a text that exceeds it alone is a batch. Rows come
    in the order of the call and leave at once, so a partition of any size needs no memory:
    SELECT * FROM token_batches(TABLE(t) PARTITION BY part ORDER BY (tokens DESC, id))
    """

    def __init__(self) -> None:
        self.batch, self.longest, self.rows = 0, 0, 0

    def eval(self, row) -> Iterator[tuple]:
        n = row["tokens"] or 0
        if self.rows and self.longest * (self.rows + 1) > row["budget"]:
            self.batch, self.rows = self.batch + 1, 0
        if not self.rows:
            self.longest = n
        self.rows += 1
        yield row["part"], row["id"], self.batch, n


def register(spark: SparkSession) -> None:
    spark.udtf.register("token_batches", udtf(TokenBatches, returnType="part string, id long, batch int, tokens int"))
