"""The layout of the driver's tables: small ones come as one file, which one task would read."""
from __future__ import annotations

from pyspark.sql import DataFrame


def spread(table: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """A table that was just read, dealt over the cores if it comes in fewer splits than there are cores; the operators take any layout.

    With ``rows`` a split holds about that many, so that of rows each of which becomes many a task's share does not grow with the table. The count is read off the files' footers.
    """
    cores = table.sparkSession.sparkContext.defaultParallelism
    wanted = cores if rows is None else max(cores, -(-table.count() // rows))
    return table if table.rdd.getNumPartitions() >= wanted else table.repartition(wanted, key)


#: Wide rows that one task joins.
WIDE_ROWS = 1 << 16


def dealt(table: DataFrame, keys: list[str], rows: int, task_rows: int = WIDE_ROWS) -> DataFrame:
    """A table of about ``rows`` wide rows, dealt by ``keys`` over as many tasks as they ask for where the session's shuffles have fewer, so that a task's share does not grow with the table."""
    wanted = -(-rows // task_rows)
    return table.repartition(wanted, *keys) if wanted > int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")) else table
