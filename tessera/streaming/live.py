"""Live matching: micro-batches of new records against a fixed index of queries."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import blocking, normalize


def match_stream(stream: DataFrame, asked: DataFrame, n_queries: DataFrame, sink):
    """Starts a query that normalises each micro-batch, retrieves candidates against ``asked`` and hands (pairs, epoch) to ``sink``.

    asked: tokens of the query side, computed once. n_queries: its records, for the idf.
    """
    weights = blocking.idf(asked, n_queries)

    def batch(df: DataFrame, epoch: int) -> None:
        found = blocking.tokens(normalize.normalise(df))
        sink(blocking.pool(blocking.retrieve(found, asked, weights)), epoch)

    return stream.writeStream.foreachBatch(batch).trigger(availableNow=True)
