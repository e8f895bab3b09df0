"""The calendar cube.

A cube row belongs to one grain (day, month, quarter or year) and one scope (a
district or the whole province).  Levels that do not apply are 0: a month row
has day = quarter = 0, a province row has district_code = 0.

The cube is built in two aggregations.  The first folds the base rows to day
cells, which combines on the map side, so a hot key costs one row per task and
not a third of the shuffle.  The second expands only those cells over the asked
grouping sets.  Rolled-up levels are recognised by ``grouping()``, never by a
null test, because districts, keys and times may be null in the data.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderloom.functions.calendar import quarter_of_month, with_calendar
from tenderloom.functions.money import as_money, to_double
from tenderloom.schemas import PROVINCE_STATS_CODE

GRAINS = {
    "day": ("year", "month", "day"),
    "month": ("year", "month"),
    "quarter": ("year", "quarter"),
    "year": ("year",),
}
SCOPES = ("district", "province")
TIME = ("year", "month", "day", "quarter")

#: Least partitions per core of a set that is summed by key.
TASKS_PER_CORE = 4

_MERGE = {"sum": F.sum, "max": F.max, "min": F.min}


@dataclass(frozen=True)
class Measure:
    """An output column and the mergeable partials it is made of.

    ``partials`` maps a partial's name to (aggregate over base rows, way to merge).
    """

    name: str
    partials: dict[str, tuple[Column, str]]
    final: Column


def count_rows(name: str) -> Measure:
    return Measure(name, {name: (F.count("*"), "sum")}, F.col(name))


def count_of(name: str, col: str) -> Measure:
    """Non-null values of ``col``."""
    return Measure(name, {name: (F.count(col), "sum")}, F.col(name))


def count_if(name: str, cond: Column | str) -> Measure:
    cond = F.expr(cond) if isinstance(cond, str) else cond
    return Measure(name, {name: (F.count_if(cond), "sum")}, F.col(name))


def money_sum(name: str, col: Column | str, cast: bool = True) -> Measure:
    value = as_money(col) if cast else col
    return Measure(name, {name: (F.sum(value), "sum")}, to_double(name))


def money_max(name: str, col: Column | str) -> Measure:
    return Measure(name, {name: (F.max(as_money(col)), "max")}, F.col(name).cast("double"))


def money_avg(name: str, col: Column | str) -> Measure:
    total, rows = f"{name}_total", f"{name}_rows"
    value = as_money(col)
    return Measure(
        name,
        {total: (F.sum(value), "sum"), rows: (F.count(value), "sum")},
        F.try_divide(F.col(total).cast("double"), F.col(rows).cast("double")),
    )


def day_partials(
    df: DataFrame,
    keys: Sequence[str],
    measures: Sequence[Measure],
    ms_col: str = "scrape_timestamp",
) -> DataFrame:
    """Additive day cells: the only aggregation that sees the base rows.

    District codes become int; text that is no number counts under a null code.
    """
    cells = with_calendar(df, ms_col, quarter=False).withColumn(
        "district_code", F.col("district_code").try_cast("int")
    )
    return cells.groupBy(*keys, "district_code", "year", "month", "day").agg(
        *[agg.alias(n) for m in measures for n, (agg, _) in m.partials.items()]
    )


def cube_from_partials(
    partials: DataFrame,
    keys: Sequence[str],
    measures: Sequence[Measure],
    grains: Sequence[str] = tuple(GRAINS),
    scopes: Sequence[str] = SCOPES,
) -> DataFrame:
    """Roll day cells up to the asked grains and scopes.

    Cells of the same day may occur several times (one per micro-batch): they are
    merged here.
    """
    for scope in scopes:
        if scope not in SCOPES:
            raise ValueError(f"unknown scope {scope!r}")
    cells = partials.withColumn("quarter", quarter_of_month(F.col("month")))
    merged = [
        _MERGE[how](n).alias(n) for m in measures for n, (_, how) in m.partials.items()
    ]
    roll = _roll_by_key if keys else _roll_all
    return roll(cells, list(keys), merged, grains, scopes).select(
        "district_code", *keys, *TIME, *[m.final.alias(m.name) for m in measures]
    )


def _roll_all(
    cells: DataFrame, keys: list[str], merged: list[Column], grains: Sequence[str], scopes: Sequence[str]
) -> DataFrame:
    """Grouping sets: without keys the cells are few and combine well before the shuffle."""
    sets = [
        [*keys, *(["district_code"] if scope == "district" else []), *GRAINS[grain]]
        for scope in scopes
        for grain in grains
    ]
    grouped = cells.groupingSets(sets, *keys, "district_code", *TIME).agg(
        *merged, *[F.grouping(c).alias(f"_all_{c}") for c in ("district_code", "month", "day", "quarter")]
    )

    def level(c: str, rolled_up: int = 0) -> Column:
        return F.when(F.col(f"_all_{c}") == 1, F.lit(rolled_up)).otherwise(F.col(c))

    return grouped.withColumns(
        {
            "district_code": level("district_code", PROVINCE_STATS_CODE),
            **{c: level(c) for c in ("month", "day", "quarter")},
        }
    )


def _roll_by_key(
    cells: DataFrame, keys: list[str], merged: list[Column], grains: Sequence[str], scopes: Sequence[str]
) -> DataFrame:
    """One shuffle of the cells by key and year, which every grouping set contains.

    The sets are then formed and summed inside the partition, so sparse keys do not
    send each cell once per set.  A key and year has at most districts times days
    cells, however many rows it had.

    A cell takes the place of one group per set in the task's memory, so there are as
    many more partitions as sets; left to the size of the moved cells, Spark would fill
    each with tens of megabytes of cells, which are gigabytes of groups.
    """

    def one_set(number: int, scope: str, grain: str) -> Column:
        kept = GRAINS[grain]
        place = F.col("district_code") if scope == "district" else F.lit(PROVINCE_STATS_CODE)
        return F.struct(
            F.lit(number).alias("_set"),
            place.alias("_district"),
            *[(F.col(c) if c in kept else F.lit(0)).alias(f"_{c}") for c in ("month", "day", "quarter")],
        )

    names = [c for c in cells.columns if c not in (*keys, "district_code", *TIME)]
    pairs = [(scope, grain) for scope in scopes for grain in grains]
    sets = F.array(*[one_set(i, *pair) for i, pair in enumerate(pairs)])
    spark = cells.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
    local = cells.repartition(parts * len(pairs), *keys, "year").select(*keys, "year", *names, F.explode(sets).alias("set"))
    grouped = local.select(*keys, "year", *names, "set.*").groupBy(
        *keys, "year", "_set", "_district", "_month", "_day", "_quarter"
    )
    return grouped.agg(*merged).withColumnsRenamed(
        {"_district": "district_code", "_month": "month", "_day": "day", "_quarter": "quarter"}
    )


def calendar_cube(
    df: DataFrame,
    keys: Sequence[str],
    measures: Sequence[Measure],
    grains: Sequence[str] = tuple(GRAINS),
    scopes: Sequence[str] = SCOPES,
    ms_col: str = "scrape_timestamp",
) -> DataFrame:
    return cube_from_partials(
        day_partials(df, keys, measures, ms_col), keys, measures, grains, scopes
    )


def complete_time_columns(df: DataFrame) -> DataFrame:
    """Add the missing ones of month, day and quarter as 0."""
    return df.withColumns({c: F.lit(0) for c in ("month", "day", "quarter") if c not in df.columns})


def grain_rows(cube: DataFrame, grain: str) -> DataFrame:
    """The rows of one grain of a stored cube."""
    used = GRAINS[grain]
    cond = F.lit(True)
    for c in ("month", "day", "quarter"):
        cond = cond & ((F.col(c) != 0) if c in used else (F.col(c) == 0))
    return cube.filter(cond)


def province_rows(cube: DataFrame) -> DataFrame:
    return cube.filter(F.col("district_code") == PROVINCE_STATS_CODE)


def district_rows(cube: DataFrame) -> DataFrame:
    return cube.filter(F.col("district_code") != PROVINCE_STATS_CODE)
