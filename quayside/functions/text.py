"""White-space handling that agrees with Unicode, where Spark's ``trim`` knows only the space."""

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points with the Unicode White_Space property.
WHITE_SPACE = "".join(
    chr(c)
    for c in (
        *range(0x0009, 0x000E), 0x0020, 0x0085, 0x00A0, 0x1680, *range(0x2000, 0x200B),
        0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
    )
)


def _printable(char: Column) -> Column:
    """Whether text starts with a printable ASCII character: the usual case, and quick to see."""
    return F.ascii(char).between(33, 126)


def strip(value: Column) -> Column:
    """Remove Unicode white space from both ends; text without any is passed through untouched."""
    tight = _printable(value) & _printable(F.substring(value, -1, 1))
    return F.when(tight, value).otherwise(F.btrim(value, F.lit(WHITE_SPACE)))


def is_filled(value: Column) -> Column:
    """True for text with something besides white space in it; never NULL."""
    return F.coalesce(_printable(value) | (F.btrim(value, F.lit(WHITE_SPACE)) != ""), F.lit(False))


def is_blank(value: Column) -> Column:
    """True for NULL, empty and white-space-only text."""
    return ~is_filled(value)


def filled_only(fields: Column) -> Column:
    """The map without its NULL and blank values; the others stay untrimmed."""
    return F.map_filter(fields, lambda _, v: is_filled(v))


def first_present(fields: Column, names: Iterable[str]) -> Column:
    """The first non-NULL value among ``names`` in a map; NULL when there is none."""
    return F.coalesce(*[F.element_at(fields, F.lit(name)) for name in names])
