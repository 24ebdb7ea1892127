"""From table columns to lanes: a long table (col, pos, lane) in an explicit order, cut into blocks.

Row order has no meaning in Spark, so every plan asks for an order key. Positions are numbered without
one global window: rows are range-partitioned on the key, written, counted by partition, and numbered within.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import UnsupportedType
from ..functions.lanes import double_bits
from .work import written

#: Rows that number() sorts in a task on average, and rows that are worth a task where there are fewer tasks than cores.
SORT, MIN_SORT = 1 << 19, 1 << 14

#: Types that have a lane: family, bytes and signedness.
LANES = {
    "double": ("float", 8, False),
    "float": ("float", 4, False),
    "bigint": ("int", 8, True),
    "int": ("int", 4, True),
    "smallint": ("int", 4, True),
    "tinyint": ("int", 4, True),
    "boolean": ("int", 4, False),
    "timestamp_ntz": ("int", 8, True),
    "timestamp": ("int", 8, True),
    "date": ("int", 4, True),
}


def supported(df: DataFrame) -> list[str]:
    """Columns that have a lane or limbs."""
    return [f.name for f in df.schema.fields if f.dataType.simpleString() in LANES or isinstance(f.dataType, T.DecimalType)]


def lane_of(column: Column, kind: str) -> Column:
    """A value's 64-bit lane: integers sign-extended, floats as the bits of a double, times as counts from the epoch."""
    if kind in ("double", "float"):
        return double_bits(column)
    if kind == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), column)
    if kind == "timestamp":
        return F.unix_micros(column)
    if kind == "date":
        return F.unix_date(column).cast("long")
    if kind not in LANES:
        raise UnsupportedType(f"no lane for {kind}")
    return column.cast("int").cast("long") if kind == "boolean" else column.cast("long")


def number(df: DataFrame, order: Sequence[str], pos: str = "pos") -> DataFrame:
    """Adds positions 0, 1, ... in the order of the key. Sorted in ranges, not in one task.

    The range-sorted rows are written once, with their partition and place in it: counts and positions both come
    from that table, so that neither sampled range bounds nor coalesced partitions can differ between them.
    Rows of equal keys get neighbouring positions in an order that is fixed by the write; nulls come first.
    Ranges grow in number with the rows, not in size."""
    rows = df.count()
    least = min(df.sparkSession.sparkContext.defaultParallelism, -(-rows // MIN_SORT))
    ranged = df.repartitionByRange(max(1, least, -(-rows // SORT)), *order).sortWithinPartitions(*order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1).cast("long"))
    rows = written(ranged.select("*", F.spark_partition_id().alias("_part"), place.alias("_in")), "numbered")
    counts = rows.groupBy("_part").agg(F.count("*").alias("_n"))
    before = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row per partition
    return rows.join(F.broadcast(before), "_part").withColumn(pos, F.col("_in") + F.col("_before")).drop("_part", "_in", "_before")


def ranked(df: DataFrame, order: Sequence[str], pos: str = "pos") -> DataFrame:
    """As number(), where the key is a dense integer from some start on: no sort at all."""
    (key,) = order
    least = df.agg(F.min(key)).first()[0] or 0
    return df.withColumn(pos, F.col(key) - F.lit(least))


def lanes(df: DataFrame, columns: Sequence[str], pos: str = "pos") -> DataFrame:
    """(col, kind, pos, lane) of all columns in one pass; a null has a null lane."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    parts = [F.struct(F.lit(c).alias("col"), F.lit(kinds[c]).alias("kind"), lane_of(F.col(c), kinds[c]).alias("lane")) for c in columns]
    return df.select(F.col(pos).alias("pos"), F.inline(F.array(*parts))).select("col", "kind", "pos", "lane")


def in_blocks(lane_rows: DataFrame, size: int) -> DataFrame:
    """Adds block and i, the position in it, for blocks of fixed size."""
    return lane_rows.withColumn("block", F.expr(f"pos div {size}")).withColumn("i", (F.col("pos") % size).cast("int"))


#: Lanes that a partition of dealt() holds on average: what a task behind its shuffle needs is bounded by this, whatever the tables' size.
DEAL = 1 << 18


def dealt(tables: Sequence[tuple[str, DataFrame, Sequence[str]]], size: int) -> DataFrame:
    """(col, kind, pos, lane, block, i) of the columns of several tables (name, table with positions, columns), by block.

    Table rows are shuffled on the block with their lanes in an array, once, and become a row per lane only behind that: windows
    and aggregates on (col, kind, block) find the rows where they need them. Partitions grow in number with the tables, not in size."""
    spark = tables[0][1].sparkSession
    parts, cells, lanes_in, blocks_in = [], None, 0, 0
    for k, (name, df, columns) in enumerate(tables):
        kinds = {f.name: f.dataType.simpleString() for f in df.schema.fields}
        n = df.count()
        lanes_in, blocks_in = lanes_in + n * len(columns), max(blocks_in, -(-n // size))
        parts.append(df.select(F.lit(k).alias("_t"), F.expr(f"pos div {size}").alias("block"), "pos", F.array(*(lane_of(F.col(c), kinds[c]) for c in columns)).alias("_x")))
        mine = F.array(*(F.struct(F.lit(f"{name}.{c}").alias("col"), F.lit(kinds[c]).alias("kind"), F.col("_x")[j].alias("lane")) for j, c in enumerate(columns)))
        cells = F.when(F.col("_t") == k, mine) if cells is None else cells.when(F.col("_t") == k, mine)
    least = min(spark.sparkContext.defaultParallelism, blocks_in)
    rows = reduce(DataFrame.unionByName, parts).repartition(max(1, least, -(-lanes_in // DEAL)), "block")
    out = rows.select("pos", "block", F.inline_outer(cells))
    return out.select("col", "kind", "pos", "lane", "block", (F.col("pos") % size).cast("int").alias("i"))


def compact(lane_rows: DataFrame, size: int = 32768) -> DataFrame:
    """Valid lanes with new positions, in order. The rank is a prefix sum in two levels: within a stretch, and of the stretches' counts."""
    stretch = lane_rows.withColumn("_s", F.expr(f"pos div {size}"))
    counts = stretch.groupBy("col", "_s").agg(F.count("lane").alias("_n"))
    before = counts.select("col", "_s", (F.sum("_n").over(Window.partitionBy("col").orderBy("_s")) - F.col("_n")).alias("_before"))
    valid = stretch.where("lane is not null").withColumn("_r", F.row_number().over(Window.partitionBy("col", "_s").orderBy("pos")))
    return valid.join(before, ["col", "_s"]).select("col", "kind", F.col("pos").alias("at"), (F.col("_before") + F.col("_r") - 1).alias("pos"), "lane")


def scatter(validity: DataFrame, values: DataFrame, fill: int | None = None) -> DataFrame:
    """Inverse of compact(): validity(col, pos, at or null) with values(col, pos, lane)."""
    v = values.select("col", F.col("pos").alias("at"), "lane")
    out = validity.join(v, ["col", "at"], "left")
    return out.select("col", "pos", F.coalesce("lane", F.lit(fill).cast("long")).alias("lane") if fill is not None else F.col("lane"))
