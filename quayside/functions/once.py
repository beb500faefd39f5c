"""Computing expensive columns exactly once per row."""

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluate_once(df: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """Like ``withColumns``, but a later filter on the new columns is not rewritten in their terms.

    Catalyst pushes filters through projections by substituting the definition of every column they
    mention, which repeats costly parsing once per mention (and can make a plan too large to optimize).
    Filters stop at a generator, so the finished columns pass through one: an array holding a single
    struct of plain column references, inlined to one row.
    """
    kept = [c for c in df.columns if c not in columns]
    packed = F.array(F.struct(*[F.col(name) for name in columns]))
    return df.withColumns(dict(columns)).select(*kept, F.inline(packed))
