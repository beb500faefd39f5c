"""Business key and the deterministic event id derived from it."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def business_key(source_system: Column, source_record_id: Column) -> Column:
    return F.concat(source_system, F.lit(":"), source_record_id)


def event_id(key: Column) -> Column:
    """First 16 bytes of SHA-256 of the key in GUID notation.

    GUID text shows the first three groups in little-endian byte order, so those hex pairs are
    reversed; the last two groups are plain.
    """
    digest = F.sha2(key, 256)

    def pairs(*starts: int) -> Column:
        return F.concat(*[F.substring(digest, start, 2) for start in starts])

    return F.concat_ws(
        "-",
        pairs(7, 5, 3, 1),
        pairs(11, 9),
        pairs(15, 13),
        F.substring(digest, 17, 4),
        F.substring(digest, 21, 12),
    )


# Fixed format: GUID notation in lower case, as :func:`event_id` writes it.
GUID_PATTERN = r"^[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}\z"
# Set before the bytes of any other text, so that these are more than the sixteen of a GUID.
NOT_GUID = bytes(17)


def packed_id(text: Column) -> Column:
    """An event id as bytes for a shuffle, where the digits of a GUID don't compress: sixteen instead of 36."""
    other = F.concat(F.lit(NOT_GUID), text.cast("binary"))
    return F.when(text.rlike(GUID_PATTERN), F.unhex(F.replace(text, F.lit("-"), F.lit("")))).otherwise(other)


def unpacked_id(packed: Column) -> Column:
    """The text that :func:`packed_id` made bytes of."""
    digits = F.lower(F.hex(packed))
    guid = F.concat_ws("-", *[F.substring(digits, start, n) for start, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    return F.when(F.length(packed) == 16, guid).otherwise(F.substring(packed, len(NOT_GUID) + 1, 2**31 - 1).cast("string"))
