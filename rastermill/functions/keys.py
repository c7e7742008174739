"""Joins of pixels with tables of a row an image, without a task that takes all pixels of one image."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Blocks of columns that an image's pixels are dealt to where they meet a table of images.
BLOCKS = 16


def with_image(d: DataFrame, images: DataFrame, how: str = "inner") -> DataFrame:
    """d (which has x) joined with a table of a row an image. Its rows are copied to BLOCKS blocks of columns, to which d's rows
    are dealt; Spark broadcasts the copies where they are few. A product with a table of blocks makes them, since that
    counts in Spark's estimate of their size, as explode() does not."""
    blocks = images.sparkSession.range(BLOCKS).select(F.col("id").cast("int").alias("_block"))
    copies = images.crossJoin(F.broadcast(blocks))
    return d.withColumn("_block", F.pmod(F.col("x"), F.lit(BLOCKS))).join(copies, ["image_id", "_block"], how).drop("_block")


def dealt(rows: DataFrame) -> DataFrame:
    """Rows of columns or pixels, as a side of a join that Spark shall not broadcast. It estimates rows that explode() has copied
    without the copies, and those of a file by its bytes: rows that are a hashed table on the driver take four times as much,
    pixels read from encoded columns more, and a job of many joins holds many such tables at once."""
    return rows.hint("merge")


def of_image(aggregate: Column) -> Column:
    """An aggregate over an image's rows, for tables with a row a column: pixels then get it through their column, by the join
    with (image, column) that they need anyway."""
    return aggregate.over(Window.partitionBy("image_id"))
