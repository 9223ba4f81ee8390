"""A bitmap filter over hashed keys, made with Spark's bitmap aggregates.

It drops most rows that can't find a partner before a join moves them. It never
drops one that can; those it lets through by chance go on to the join itself.
"""
from pyspark.sql import Column, DataFrame, functions as F

from docmill.functions.text import let

#: Bits of a Spark bitmap; most bitmaps of a filter, 4 KB each.
BITMAP_BITS, MOST_BITMAPS = 32768, 1024


def _bit(size: Column, columns) -> Column:
    """Number of the bit of a key, from 1."""
    return F.pmod(F.xxhash64(*columns), size.cast("long")) + 1


def bitmap_filter(keys: DataFrame, *columns: str) -> DataFrame:
    """One row (``_size``, ``_bits``): bitmaps by number, about 16 bits a key and 4 MB
    at most, so it can be broadcast; of more keys, it lets more through. ``keys`` is
    read twice, so store it first if it is costly."""
    size = F.least(F.greatest(F.ceil(F.col("n") * 16 / BITMAP_BITS), F.lit(1)), F.lit(MOST_BITMAPS)) * BITMAP_BITS
    sized = keys.agg(F.count(F.lit(1)).alias("n")).select(size.cast("long").alias("_size"))
    bits = keys.select(*columns).join(F.broadcast(sized)).select("_size", _bit(F.col("_size"), columns).alias("bit"))
    maps = bits.groupBy("_size", F.bitmap_bucket_number("bit").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("map"))
    return maps.groupBy().agg(F.max("_size").alias("_size"), F.map_from_entries(F.collect_list(F.struct("at", "map"))).alias("_bits"))


def may_hold(*key: Column | str) -> Column:
    """Whether the filter's columns, joined to the row, have the bit of a key set."""
    def looked_up(bit):
        at = F.bitmap_bit_position(bit)
        byte = F.substring(F.try_element_at("_bits", F.bitmap_bucket_number(bit)), (at / 8).cast("int") + 1, F.lit(1))
        value = F.conv(F.hex(byte), 16, 10).cast("int")
        return F.coalesce(F.floor(value / F.pow(F.lit(2), at % 8)) % 2 == 1, F.lit(False))

    return let(_bit(F.col("_size"), key), looked_up)


def filtered(rows: DataFrame, keys: DataFrame, *columns: str) -> DataFrame:
    """``rows`` without most of those whose ``columns`` aren't among ``keys``."""
    return rows.join(F.broadcast(bitmap_filter(keys, *columns))).where(may_hold(*columns)).select(*[F.col(f"`{c}`") for c in rows.columns])
