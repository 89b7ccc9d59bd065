"""Tables landed as JSON page envelopes, one envelope per line."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from tillwise.errors import SourceError
from tillwise.operators.prefix import running_totals
from tillwise.sources.schemas import schema_of
from tillwise.staging import Stage

PAGE_SCHEMA = (
    "items array<map<string,string>>, columns array<string>, page bigint, page_size bigint, "
    "total bigint, next_page bigint"
)


def parsed_pages(spark: SparkSession, path: str, stage: Stage) -> DataFrame:
    """The landed envelopes, parsed once into a staged table, each with what its own check needs.

    ``rows`` counts a page's items, and ``sound`` says that the page agrees with itself. Checks
    read those narrow columns; only the final result reads the items.
    """
    pages = spark.read.schema(PAGE_SCHEMA).option("mode", "FAILFAST").json(path)
    count = F.size("items")
    stray_item = F.exists(
        "items",
        lambda item: (F.size(F.array_except(F.map_keys(item), F.col("columns"))) > 0)
        | (F.size(F.array_except(F.col("columns"), F.map_keys(item))) > 0),
    )
    sound = (
        (F.size("columns") >= 1)
        & (F.col("page") >= 1)
        & (F.col("page_size") >= 1)
        & (F.col("total") >= 0)
        & (count <= F.col("page_size"))
        & F.coalesce(F.col("next_page") > F.col("page"), F.lit(True))
        & ~stray_item
    )
    checked = pages.withColumns(
        {"rows": F.coalesce(count, F.lit(0)).cast("bigint"), "sound": F.coalesce(sound, F.lit(False))}
    )
    return stage.write(checked, "pages")


def _chain(pages: DataFrame, stage: Stage) -> DataFrame:
    """One row: places where the chain of pages breaks, and facts over all pages.

    The pages are dealt out by ranges of their numbers. Inside a range each page must announce the
    number that follows; between ranges the last announcement of one must be the first number of
    the next. So a missing, repeated or looping page is a break, and no task sees all pages: the
    last window has one row per range.
    """
    facts = pages.select("page", "next_page", "rows", "sound", "total", F.to_json("columns").alias("names"))
    ranged = stage.write(
        facts.repartitionByRange("page").withColumn("range", F.spark_partition_id()), "page-ranges"
    )
    inside = Window.partitionBy("range").orderBy("page", "next_page")
    place = F.struct("page", F.col("next_page").isNotNull(), "next_page")
    ranges = (
        ranged.withColumns({"following": F.lead("page").over(inside), "inner": F.lead(F.lit(1)).over(inside)})
        .groupBy("range")
        .agg(
            F.count_if(F.col("inner").isNotNull() & ~F.col("following").eqNullSafe(F.col("next_page"))).alias("breaks"),
            F.min("page").alias("first"),
            F.max(place)["next_page"].alias("announced"),
            F.count_if(~F.col("sound")).alias("malformed"),
            F.min("names").alias("names"),
            F.max("names").alias("other_names"),
            F.min("total").alias("total"),
            F.max("total").alias("other_total"),
            F.sum("rows").alias("rows"),
        )
    )
    borders = Window.orderBy("range")
    return ranges.withColumns(
        {
            "comes": F.lead("first").over(borders),
            "starts": F.row_number().over(borders) == 1,
        }
    ).agg(
        (
            F.sum("breaks")
            + F.count_if(~F.col("comes").eqNullSafe(F.col("announced")))
            + F.count_if(F.col("starts") & ~F.col("first").eqNullSafe(F.lit(1)))
        ).alias("breaks"),
        F.sum("malformed").alias("malformed"),
        F.min("names").alias("names"),
        F.max("other_names").alias("other_names"),
        F.min("total").alias("total"),
        F.max("other_total").alias("other_total"),
        F.sum("rows").alias("rows"),
    )


def _problems(facts: Row) -> list[str]:
    """Name every way in which the envelopes contradict themselves or each other."""
    tests = (
        ("malformed pages", facts["malformed"] > 0),
        ("columns changed", facts["names"] != facts["other_names"]),
        ("total changed", facts["total"] != facts["other_total"]),
        ("total is wrong", facts["rows"] != facts["other_total"]),
        ("page sequence incomplete", facts["breaks"] > 0),
    )
    return [name for name, wrong in tests if wrong]


def page_problems(pages: DataFrame, stage: Stage | None = None) -> list[str]:
    """The problems of a table of parsed pages (see ``parsed_pages``); none for sound ones."""
    facts = _chain(pages, stage or Stage(pages.sparkSession)).first()
    return [] if facts["breaks"] is None else _problems(facts)


def read_api_pages(
    spark: SparkSession, path: str, dataset: str, trace: bool = False, stage: Stage | None = None
) -> DataFrame:
    """Check the landed pages of one dataset, then return their items as text columns.

    The envelopes are parsed once; checks and items read the staged table. ``trace`` adds the
    trace columns, with rows numbered in page order.
    """
    stage = stage or Stage(spark)
    kind = schema_of(dataset).kind
    pages = parsed_pages(spark, path, stage)
    facts = _chain(pages, stage).first()
    names = json.loads(facts["names"]) if facts["names"] else []
    if not names:
        raise SourceError(f"No pages were landed for '{dataset}'.")
    missing = sorted(set(schema_of(dataset).required) - set(names))
    if missing:
        raise SourceError(f"The pages of '{dataset}' lack required fields: {', '.join(missing)}")
    found = _problems(facts)
    if found:
        raise SourceError(f"The pages of '{dataset}' are inconsistent: {', '.join(found)}")
    values = [F.col("item")[name].alias(name) for name in names]
    if not trace:
        return pages.select(F.explode("items").alias("item")).select(*values)
    before = running_totals(pages.select("page", "rows"), ["page"], "before", "rows", stage=stage)
    return (
        pages.select("page", "items")
        .join(before.select("page", "before"), "page")
        .select("before", F.posexplode("items").alias("place", "item"))
        .select(
            *values,
            F.lit(f"api_{kind}.json").alias("source_file"),
            (F.col("before") + F.col("place") + 2).cast("bigint").alias("source_row_number"),
            F.lit("pending").alias("processing_status"),
            F.lit(None).cast("string").alias("exclusion_reason"),
        )
    )
