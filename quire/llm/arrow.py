"""Settings for operators that hand rows to Python in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

#: Rows of an Arrow batch; bounds a Python worker's memory when rows hold whole texts.
BATCH_ROWS = 256
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """From now on the session hands batches of ``BATCH_ROWS`` rows or fewer to Python.

    Results are lazy, so this can't be undone before they are read; a smaller setting of the user's stays.
    """
    now = int(spark.conf.get(_SETTING))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set(_SETTING, str(BATCH_ROWS))


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Within it, jobs hand batches of ``rows`` rows to Python; then the setting is as it was."""
    before = spark.conf.get(_SETTING)
    spark.conf.set(_SETTING, str(rows))
    try:
        yield
    finally:
        spark.conf.set(_SETTING, before)
