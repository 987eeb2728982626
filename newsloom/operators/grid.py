"""Table operators of the console: search, filter, sort, slices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import PALETTE
from ..functions.text import col, trim
from .graph import checkpoints

_SEARCHABLE = (T.StringType, T.NumericType, T.BooleanType)


def _contains(df: DataFrame, column: str, needle: str) -> Column:
    return F.coalesce(F.contains(F.lower(F.col(column).cast("string")), F.lit(needle)), F.lit(False))


def _shown(df: DataFrame, columns: list[str]) -> list[str]:
    return [c for c in columns if isinstance(df.schema[c].dataType, _SEARCHABLE)]


def keyword(df: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """Rows with the text in any visible column; arrays and maps are not searched."""
    needle = text.strip().lower()
    if not needle:
        return df
    return df.where(reduce(lambda a, b: a | b, [_contains(df, c, needle) for c in _shown(df, columns)], F.lit(False)))


def column_filters(df: DataFrame, filters: dict[str, str], columns: list[str]) -> DataFrame:
    for c, text in filters.items():
        needle = text.strip().lower()
        if needle and c in columns:
            df = df.where(_contains(df, c, needle) if c in _shown(df, columns) else F.lit(False))
    return df


def sort_order(df: DataFrame, column: str, descending: bool, tie: str) -> list[Column]:
    """Blanks last in both directions; text by language order; ties as stored."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.StringType):
        blank, value = F.coalesce(F.col(column), F.lit("")) == "", F.collate(F.col(column), "UNICODE")
    elif isinstance(kind, (T.NumericType, T.BooleanType)):
        blank, value = F.col(column).isNull(), F.col(column).cast("double")
    else:
        return [F.col(tie)]
    value = F.when(~blank, value)  # blanks tie
    return [blank, value.desc() if descending else value.asc(), F.col(tie)]


def sort(df: DataFrame, column: str, descending: bool, tie: str = "id") -> DataFrame:
    return df.orderBy(*sort_order(df, column, descending, tie))


def ranked(df: DataFrame, column: str, descending: bool, tie: str = "id") -> DataFrame:
    """Every row with its place (from 1) in the sort order: the sorted ranges are a
    checkpoint, their sizes are added up (one row for each range), and a row's number
    within its range goes on from the ranges before."""
    checkpoints(df.sparkSession)
    number = F.monotonically_increasing_id()  # the range in the upper bits, the row within it below
    rows = sort(df, column, descending, tie).withColumn("_n", number).withColumn("_range", F.shiftright("_n", 33)).checkpoint()
    sizes = rows.groupBy("_range").agg(F.count("*").alias("_size"))
    before = F.sum("_size").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_size")
    placed = rows.join(F.broadcast(sizes.select("_range", before.alias("_before"))), "_range")
    return placed.select(*df.columns, (F.col("_before") + F.col("_n").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("place"))


def next_sort(current: tuple[str, str] | None, column: str) -> tuple[str, str] | None:
    """none, ascending, descending, none."""
    if current is None or current[0] != column:
        return column, "asc"
    return (column, "desc") if current[1] == "asc" else None


def view(df: DataFrame, columns: list[str], text: str = "", filters: dict[str, str] | None = None, by: tuple[str, str] | None = None, tie: str = "id") -> DataFrame:
    rows = column_filters(keyword(df, text, columns), filters or {}, columns)
    return (sort(rows, by[0], by[1] == "desc", tie) if by else rows).select(columns)


def pie(slices: DataFrame) -> DataFrame:
    """(pos, label, value) to shares of the total with colours by input place and
    cumulative ends in percent; slices are a chart's few rows."""
    used = slices.where(F.col("value") > 0)
    whole = Window.partitionBy()
    run = Window.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    color = F.element_at(F.array(*[F.lit(c) for c in PALETTE]), (F.col("pos") % len(PALETTE) + 1).cast("int"))
    rows = used.withColumn("fraction", F.col("value") / F.sum("value").over(whole)).withColumn("color", color)
    rows = rows.withColumn("end", F.sum("fraction").over(run))
    percent = lambda c: F.floor(c * 10_000 + 0.5) / 100
    return rows.withColumn("startPercent", percent(F.col("end") - F.col("fraction"))).withColumn("endPercent", percent(F.col("end"))).drop("end")


def gradient(rows: DataFrame) -> DataFrame:
    stops = F.array_sort(F.collect_list(F.struct("pos", F.concat(F.col("color"), F.lit(" "), F.col("startPercent").cast("string"), F.lit("% "), F.col("endPercent").cast("string"), F.lit("%")).alias("s"))))
    return rows.agg(F.concat(F.lit("conic-gradient("), F.array_join(F.transform(stops, lambda s: s["s"]), ", "), F.lit(")")).alias("gradient"))


def all_selected(selected, visible) -> Column:
    return (F.size(col(visible)) > 0) & (F.size(F.array_except(col(visible), col(selected))) == 0)


def is_blank(c) -> Column:
    return trim(F.coalesce(col(c), F.lit(""))) == ""
