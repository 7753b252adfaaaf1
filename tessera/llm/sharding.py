"""Balanced contiguous shards from global byte-size prefix sums."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import staged

#: Hexadecimal digits of a text's digest that name its bin; rows of a cell of a bin, about.
BIN_DIGITS, CELL = 3, 1000


def _order(text: Column) -> list[Column]:
    """bin and rank: the global order is that of the two, a digest of the text, then one of id and text."""
    digest = F.md5(text)
    rank = F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), digest))
    return [F.substring(digest, 1, BIN_DIGITS).alias("bin"), rank.alias("rank")]


def shard_by_bytes(docs: DataFrame, n_shards: int = 16, tolerance: float = 0.015) -> DataFrame:
    """Cut the documents into ``n_shards`` contiguous shards of near-equal bytes.

    The global order is by bin (the first digits of a digest of the text), then
    by a digest of id and text.  Bins are dealt into cells, by as many leading
    digits of the second digest as the bin's rows ask for, which leaves the
    order as it is.  Each cell's total comes from one partial aggregation;
    prefix sums over the totals give every row its global byte position without
    sorting the table in one place.  The only single-partition window has a
    row for each of the 4096 bins.

    The law of cuts, at every size: a bin of at most ``tolerance`` of a shard
    goes whole to the shard in which its middle lies, so equal texts stay
    together; a larger bin (one text is a large part of the corpus, or the
    table is small) is cut at the row, which keeps the bytes equal.

    Size is UTF-8 bytes plus 1; a null or empty text has size 1 and CRC 0.
    Null or repeated ids, repeated rows and ties are all kept, one output row
    for each input row.  Rows that repeat id and text are interchangeable; a
    cell that they overfill is spread by the rows' place in the table.  A text
    of any length is digested where it is.  An empty table gives no rows.
    Other columns of ``docs`` are not read, whatever their names.  Returns
    doc_id, size, text_crc32, shard, slot.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select("doc_id", (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), *_order(text), F.monotonically_increasing_id().alias("place"))
    base = staged(base, "sizes")
    bins = base.groupBy("bin").agg(F.sum("size").alias("bb"), F.count("*").alias("br"))
    # rows of a bin / 16^digits are at most CELL
    digits = F.greatest(F.lit(0), F.ceil(F.log2(F.col("br") / CELL) / 4)).cast("int")
    everything, earlier = Window.partitionBy(F.lit(1)), Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    bins = staged(bins, "bins").select(
        "bin", "bb", digits.alias("digits"), *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(a) for c, a in (("bb", "b0"), ("br", "r0"))), (F.sum("bb").over(everything) / n_shards).alias("target")
    )
    at = lambda pos: F.least(F.floor(pos / F.col("target")), F.lit(n_shards - 1)).cast("int")
    bins = bins.select("bin", "digits", "b0", "r0", "target", F.when(F.col("bb") <= F.col("target") * tolerance, at(F.col("b0") + F.col("bb") / 2)).alias("whole"))
    celled = base.join(F.broadcast(bins), "bin").withColumn("cell", F.expr("substring(rank, 1, digits)"))  # 16 ** BIN_DIGITS rows
    # a cell of 64 times CELL rows holds one key over and over; there is one for so many rows at most
    full = celled.groupBy("bin", "cell").agg(F.count("*").alias("n")).where(F.col("n") > 64 * CELL).select("bin", "cell", F.lit(True).alias("full"))
    salt = F.when(F.col("full"), F.shiftright("place", 33)).otherwise(F.lit(0))
    celled = celled.join(F.broadcast(full), ["bin", "cell"], "left").withColumn("salt", salt)

    cells = celled.groupBy("bin", "cell", "salt").agg(F.sum("size").alias("b"), F.count("*").alias("r"))
    in_bin = Window.partitionBy("bin").orderBy("cell", "salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select("bin", "cell", "salt", *(F.coalesce(F.sum(c).over(in_bin), F.lit(0)).alias(f"{c}1") for c in ("b", "r")))
    row = Window.partitionBy("bin", "cell", "salt").orderBy("rank", "place")
    placed = celled.withColumn("n", F.row_number().over(row)).withColumn("b", F.sum("size").over(row.rowsBetween(Window.unboundedPreceding, 0))).join(starts, ["bin", "cell", "salt"])
    placed = placed.select(
        "doc_id", "size", "text_crc32", F.coalesce("whole", at(F.col("b0") + F.col("b1") + F.col("b") - F.col("size") / 2)).alias("shard"), (F.col("r0") + F.col("r1") + F.col("n") - 1).alias("at")
    )
    first = placed.groupBy("shard").agg(F.min("at").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(  # n_shards rows
        "doc_id", "size", "text_crc32", "shard", (F.col("at") - F.col("first")).cast("long").alias("slot")
    )
