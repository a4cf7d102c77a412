"""Tables that are small by nature: dictionaries, vocabularies, fragments."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A dictionary larger than this is not a dictionary: it would not fit beside each task.
MOST_ENTRIES = 100_000


def small(table: DataFrame, most: int = MOST_ENTRIES) -> DataFrame:
    """table marked for broadcast, once it is known to have at most `most` rows; ValueError otherwise."""
    if table.limit(most + 1).count() > most:
        raise ValueError(f"over {most} rows are too many for a dictionary")
    return F.broadcast(table)
