"""Rows whose key may stand in a table of keys, told before a join moves them.

Each key sets a bit of a bitmap, which Spark broadcasts. A row with a key of the table always passes; of the others about
one in thirty to sixty does, so a join decides after it. The bitmap takes four to eight bytes a key and is bounded: beyond
``MOST_BITS`` more rows pass, and none is lost. Column functions only, so no task needs a Python worker more.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bits of the map for each key at least, and in all at most (16 MB).
KEY_BITS, MOST_BITS = 32, 1 << 27
#: Bits of a row that ``bitmap_construct_agg`` gives.
_ROW_BITS = 1 << 15


def sifted(df: DataFrame, key: str, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose key may be in the single column of ``keys``, rows whose key is not)."""
    keys = keys.select(F.col(keys.columns[0]).cast(df.schema[key].dataType).alias("key"))
    bits = min(MOST_BITS, max(_ROW_BITS, 1 << (KEY_BITS * keys.count() - 1).bit_length()))
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(bits)) + 1  # noqa: E731 - the functions number places from 1
    rows = keys.select(place("key").alias("place")).groupBy(F.bitmap_bucket_number("place").alias("_row"))
    held = F.broadcast(rows.agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("_bits")))
    at = F.bitmap_bit_position(place(key)).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright(at, 3) + 1, 1)), 16, 10).cast("int")
    maybe = F.coalesce(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), at.bitwiseAND(7))) != 0, F.lit(False))
    marked = df.join(held, F.bitmap_bucket_number(place(key)) == F.col("_row"), "left")
    return marked.filter(maybe).select(*df.columns), marked.filter(~maybe).select(*df.columns)
