"""Sources. Each one ends in the same source-record shape, so one pipeline serves them all."""

from functools import reduce

from pyspark.sql import DataFrame

from quayside.contract import SOURCE_RECORD


def all_channels(*sources: DataFrame) -> DataFrame:
    """The source records of several channels as one DataFrame, in one arrival order (see ``operators.arrival``)."""
    columns = SOURCE_RECORD.fieldNames()
    return reduce(DataFrame.unionByName, [s.select(*columns) for s in sources])
