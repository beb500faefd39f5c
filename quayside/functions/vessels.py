"""IMO vessel numbers."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def imo_is_valid(imo: Column) -> Column:
    """Seven ASCII digits whose last one is the weighted sum (7,6,5,4,3,2) of the others modulo 10.

    Digits are read through ``ascii`` rather than a cast, so odd text can never raise.
    """
    digit = [F.ascii(F.substring(imo, i, 1)) - 48 for i in range(1, 8)]
    weighted = sum((digit[i] * (7 - i) for i in range(1, 6)), digit[0] * 7)
    shape = (F.length(imo) == 7) & (F.translate(imo, "0123456789", "") == "")
    return F.coalesce(shape & (weighted % 10 == digit[6]), F.lit(False))
