"""Sharding by a permutation-filled lookup table.

Every shard has its own order of preference over the slots of a table of prime
size: ``position = (slot - offset) * stride mod size``, with offset and stride
drawn from the MD5 of the shard's name. The shards take turns, in order of
their names, and each turn claims the free slot that the shard likes best,
until no slot is free. A row's key is hashed to a slot, and a broadcast of the
table gives its shard in constant time. Removing a shard moves its own rows and
a few others; all shards hold the same number of slots, give or take one.

Everything is built-in SQL functions; the table has ``size`` rows, which
``MOST_SLOTS`` bounds.
"""
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from docmill.llm.names import fresh

#: Most slots of a table, which is broadcast. One row holds the wishes of all
#: shards while it is filled: size times shards numbers.
MOST_SLOTS = 20_011


def _number(text: Column, digits: int = 15, start: int = 1) -> Column:
    """A non-negative number from the hexadecimal MD5 of a text."""
    return F.conv(F.substring(F.md5(F.encode(text, "UTF-8")), start, digits), 16, 10).cast("long")


def named_shards(spark: SparkSession, count: int) -> DataFrame:
    """Shards ``shard-0`` ... as a table with the column ``shard``."""
    return spark.range(count).select(F.concat(F.lit("shard-"), F.col("id").cast("string")).alias("shard"))


def lookup_table(shards: DataFrame, size: int = 5003) -> DataFrame:
    """``slot`` (0 to size - 1) and ``shard`` for every slot.

    ``shards`` has a column ``shard``; nulls and repeated names count once or
    not at all. Without any shard the table is empty. ``size`` must be a prime,
    best a hundred times the number of shards or more.
    """
    if not 2 < size <= MOST_SLOTS or any(size % d == 0 for d in range(2, int(size**0.5) + 1)):
        raise ValueError(f"size must be a prime of at most {MOST_SLOTS}")
    position = lambda slot, who: (slot - who["offset"] + size) * who["stride"] % size
    slots = F.sequence(F.lit(0).cast("long"), F.lit(size - 1).cast("long"))
    prefers = lambda who: F.transform(
        F.array_sort(F.transform(slots, lambda slot: position(slot, who) * size + slot)), lambda x: x % size
    )
    filled = (
        shards.where("shard IS NOT NULL").select("shard").distinct()
        .withColumn("offset", _number(F.col("shard"), 12) % size)
        .withColumn("stride", _number(F.col("shard"), 12, 13) % (size - 1) + 1)
        .agg(F.array_sort(F.collect_list(F.struct("shard", "offset", "stride"))).alias("s"))
        .where(F.size("s") > 0)
    )

    def one_round(state: Column, _: Column) -> Column:
        """Every shard claims once. Fewer slots than shards are claimed before
        it in this round, so its choice is among as many first wishes."""
        claims = F.aggregate(
            state["wishes"], F.expr("cast(array() as array<bigint>)"),
            lambda claims, own: F.array_append(claims, F.get(F.array_except(F.slice(own, 1, F.size("s")), claims), F.lit(0))),
        )
        # through a one-element array, so that the claims are worked out once
        return F.get(F.transform(F.array(claims), lambda made: F.struct(
            F.transform(state["wishes"], lambda own: F.array_except(own, made)).alias("wishes"),
            F.concat(state["taken"], made).alias("taken"),
        )), F.lit(0))

    start = F.struct(F.transform("s", prefers).alias("wishes"), F.expr("cast(array() as array<bigint>)").alias("taken"))
    rounds = F.sequence(F.lit(1), F.ceil(F.lit(size) / F.size("s")).cast("int"))
    return (
        filled.select("s", F.explode(F.array(F.aggregate(rounds, start, one_round)["taken"])).alias("taken"))
        .select("s", F.posexplode("taken").alias("turn", "slot")).where("slot IS NOT NULL")
        .select("slot", F.get("s", (F.col("turn") % F.size("s")).cast("int"))["shard"].alias("shard"))
    )


def slot_of(key: Column, size: int = 5003) -> Column:
    """The slot of a key. A null key is placed like an empty text."""
    return _number(F.coalesce(key.cast("string"), F.lit(""))) % size


def place(df: DataFrame, key: Column, table: DataFrame, size: int = 5003,
          slot: str = "slot", shard: str = "shard") -> DataFrame:
    """``df`` with a slot and a shard for each row; nothing of it is shuffled.

    All rows are kept, repeated ones too; equal keys share a shard. Columns of
    these names are replaced. With an empty table the shard is null.
    """
    _slot, _of, _shard = fresh(df, "its_slot", "of", "its_shard")
    rest = [c for c in df.columns if c.lower() not in {slot.lower(), shard.lower()}]
    placed = df.select(*[F.col(f"`{c}`") for c in rest], slot_of(key, size).alias(_slot))
    lookup = F.broadcast(table.select(F.col("slot").alias(_of), F.col("shard").alias(_shard)))  # at most MOST_SLOTS rows
    return placed.join(lookup, F.col(_slot) == F.col(_of), "left").select(
        *[F.col(f"`{c}`") for c in rest], F.col(_slot).alias(slot), F.col(_shard).alias(shard)
    )


def write_shards(placed: DataFrame, path: str, files: int = 1, shard: str = "shard") -> None:
    """A folder per shard, each of ``files`` files: rows of one key may fill a
    shard, so they are dealt over its files by all their columns."""
    deal = F.pmod(F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in placed.columns]), F.lit(files))
    placed.repartition(shard, deal).write.partitionBy(shard).parquet(path)
