"""The district dimension: building, look-ups, tree and fold to cities.

The dimension is one province's tree (a few hundred rows); joins against it are
left to Spark, which broadcasts it by its measured size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tenderloom.plans.reports import level_of
from tenderloom.schemas import DISTRICT_NODE

# Fixed value: name suffix of a city's own office.
OWN_LEVEL_SUFFIX = "本级"

DISTRICT_TYPES = (1, 2, 3)


def short_place_name(col):
    return F.regexp_replace(col, f"{OWN_LEVEL_SUFFIX}$", "")


def flatten_district_json(docs: DataFrame, column: str = "doc") -> DataFrame:
    """Nested district documents (JSON text) to rows with parent and type, of any depth.

    Each generation is parsed from its parents' ``children`` text until none is left; the driver
    only asks whether there is a next one.
    """
    fields = ("code", "name", "fullName", "shortName")
    texts = docs.select(F.col(column).alias("node"), F.lit(None).cast("string").alias("parent"))
    rows = None
    while rows is None or not texts.isEmpty():
        nodes = texts.select(F.from_json("node", DISTRICT_NODE).alias("n"), "parent").select("n.*", "parent")
        found = nodes.select(*fields, "parent")
        rows = found if rows is None else rows.unionByName(found)
        texts = nodes.filter(~F.coalesce(F.col("isLeaf"), F.lit(True))).select(
            F.explode(F.from_json("children", "array<string>")).alias("node"), F.col("code").alias("parent")
        )
    code = F.col("code").try_cast("int")
    return rows.select(
        code.alias("code"),
        "name",
        F.col("fullName").alias("full_name"),
        F.col("shortName").alias("short_name"),
        F.coalesce(F.col("parent").try_cast("int"), F.lit(-1)).alias("parent_code"),
        level_of(code).cast("smallint").alias("type"),
    )


def all_districts(districts: DataFrame) -> DataFrame:
    return districts.orderBy("code")


def districts_by_type(districts: DataFrame, type_: int) -> DataFrame:
    if type_ not in DISTRICT_TYPES:
        raise ValueError(f"district type must be one of {DISTRICT_TYPES}")
    return districts.filter(F.col("type") == type_).orderBy("code")


def cities(districts: DataFrame) -> DataFrame:
    return districts.filter(F.col("code") % 100 == 0)


def district_tree(districts: DataFrame, code: int) -> DataFrame:
    """The tree below ``code`` as rows (code, parent, level, path); no row if absent."""
    return districts.sparkSession.sql(
        """
        WITH RECURSIVE tree(code, name, parent_code, level, path) AS (
            SELECT code, name, parent_code, 0, CAST(code AS STRING)
            FROM {districts} WHERE code = :root
            UNION ALL
            SELECT d.code, d.name, d.parent_code, t.level + 1,
                   concat(t.path, '/', CAST(d.code AS STRING))
            FROM {districts} d JOIN tree t ON d.parent_code = t.code
        )
        SELECT code, name, parent_code, level, path FROM tree
        """,
        args={"root": code},
        districts=districts,
    )


def self_and_children(districts: DataFrame, code: int) -> DataFrame:
    return districts.filter((F.col("code") == code) | (F.col("parent_code") == code))


def fold_to_city(rows: DataFrame, districts: DataFrame) -> DataFrame:
    """Add ``city_code``: districts go to their parent, ``..99`` to its ``..00``.

    Rows of unknown codes drop out; see :func:`unknown_codes`.
    """
    dim = districts.select(
        F.col("code").alias("district_code"), F.col("parent_code"), F.col("type")
    )
    parent = F.when(F.col("type") == 3, F.col("parent_code")).otherwise(F.col("district_code"))
    city = F.when(parent % 100 == 99, parent - 99).otherwise(parent)
    return rows.join(dim, "district_code").withColumn("city_code", city).drop("parent_code", "type")


def with_city_name(rows: DataFrame, districts: DataFrame) -> DataFrame:
    names = districts.select(F.col("code").alias("city_code"), F.col("name").alias("district_name"))
    return rows.join(names, "city_code")


def unknown_codes(rows: DataFrame, districts: DataFrame) -> DataFrame:
    """District codes in ``rows`` that the dimension does not have, with their row count."""
    counts = rows.groupBy("district_code").agg(F.count("*").alias("rows"))
    dim = districts.select(F.col("code").alias("district_code"))
    return counts.join(dim, "district_code", "left_anti")
