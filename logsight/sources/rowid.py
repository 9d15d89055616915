"""File-order row identity for file sources.

``monotonically_increasing_id`` alone does not follow file order (splits are
packed into partitions by size), but (file path, split start, id) does. A
dense 1..n id is derived from per-split counts and offsets: the offsets
table has one row per input split, so its size is bounded by the input
layout, not by the rows.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logsight.session import stage


def with_row_key(df: DataFrame) -> DataFrame:
    """Add ``_file``, ``_split`` and ``_mono`` (sortable into file order)."""
    return (df.withColumn("_file", F.col("_metadata.file_path"))
              .withColumn("_split", F.col("_metadata.file_block_start"))
              .withColumn("_mono", F.monotonically_increasing_id()))


def dense_row_id(keyed: DataFrame, name: str = "row_id", max_rows_per_file: int | None = None) -> DataFrame:
    """Replace the row key by a dense 1..n id in (file, split, line) order.

    ``keyed`` must be a materialised (staged) frame so the ids are stable
    between the count pass and the numbering pass."""
    splits = keyed.groupBy("_file", "_split").agg(F.count(F.lit(1)).alias("_n"), F.min("_mono").alias("_lo"))
    # one row per input split: a global running sum over a bounded table
    order = Window.orderBy("_file", "_split").rowsBetween(Window.unboundedPreceding, -1)
    in_file = Window.partitionBy("_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (splits.withColumn("_off", F.coalesce(F.sum("_n").over(order), F.lit(0)))
                     .withColumn("_file_off", F.coalesce(F.sum("_n").over(in_file), F.lit(0))))
    # one row per split: AQE broadcasts it when small, else a shuffle join
    out = keyed.join(offsets.select("_file", "_split", "_off", "_file_off", "_lo"), ["_file", "_split"])
    if max_rows_per_file is not None:
        # SRC7: keep the first n rows of every file
        out = out.filter(F.col("_file_off") + (F.col("_mono") - F.col("_lo")) < max_rows_per_file)
        splits2 = out.groupBy("_file", "_split").agg(F.count(F.lit(1)).alias("_n2"))
        off2 = splits2.withColumn("_off2", F.coalesce(F.sum("_n2").over(order), F.lit(0)))
        out = out.join(off2.select("_file", "_split", "_off2"), ["_file", "_split"]).withColumn(
            "_off", F.col("_off2")).drop("_off2")
    return (out.withColumn(name, F.col("_off") + (F.col("_mono") - F.col("_lo")) + 1)
               .drop("_file", "_split", "_mono", "_off", "_lo", "_file_off"))


def dense_numbers(df: DataFrame, order: list, name: str = "row_id") -> DataFrame:
    """Number the rows of a staged frame 1..n by ``order``: range partitions,
    their counts (one row each), and a running number inside each."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stage(ranged.withColumn("_pos", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_pos", 33)
    counts = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    before, starts = 0, []
    for p in sorted(counts):
        starts.append((p, before))
        before += counts[p]
    offsets = df.sparkSession.createDataFrame(starts, "_part_no long, _before long")
    # one row per partition
    out = placed.withColumn("_part_no", part.cast("bigint")).join(F.broadcast(offsets), "_part_no")
    number = F.col("_before") + F.col("_pos").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return out.withColumn(name, number).drop("_pos", "_part_no", "_before")
