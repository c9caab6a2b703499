"""Results as lines of text, in the layouts of the command-line tools."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def triangle_line(counts: DataFrame) -> DataFrame:
    """(value): a sentence with the number of (triangles)."""
    return counts.select(F.format_string("There are %d triangles in the input graph.", "triangles").alias("value"))


def itemset_lines(sets: DataFrame) -> DataFrame:
    """(value): support and items of (items, support), parted by blanks."""
    return sets.select(F.concat_ws(" ", F.col("support").cast("string"), F.array_join(F.transform("items", lambda x: x.cast("string")), " ")).alias("value"))


def neighbour_lines(found: DataFrame) -> DataFrame:
    """(value): query, row and similarity of (query, row, sim) in columns."""
    return found.select(F.format_string("%8d %8d %.3f", "query", "row", "sim").alias("value"))


def rank_lines(ranks: DataFrame) -> DataFrame:
    """(id, value): the ranks of (id, pr) with four digits behind the point."""
    return ranks.select("id", F.format_string("%d %.4e", "id", "pr").alias("value"))
