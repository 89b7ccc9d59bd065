"""Duplicate business keys.

The rows themselves are never gathered by key. A partial aggregate finds the keys that
occur more than once and the row each of them keeps, so a key that holds a third of the
table costs no more than any other; only that (usually small) list is joined back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.errors import ConfigError
from tillwise.operators.issues import is_active, issue, row_id, same_key
from tillwise.staging import Stage

KEEP_FIRST, KEEP_LATEST, EXCLUDE_ALL, FAIL = "keep_first", "keep_latest", "exclude_all", "error"
_OTHER_NAMES = {"keep_last": KEEP_LATEST, "remove_all": EXCLUDE_ALL}


def strategy_name(name: str) -> str:
    strategy = _OTHER_NAMES.get(name, name)
    if strategy not in (KEEP_FIRST, KEEP_LATEST, EXCLUDE_ALL, FAIL):
        raise ConfigError(f"Unknown duplicate strategy '{name}'.")
    return strategy


def _winner(frame: DataFrame, strategy: str, latest_by: str | None) -> Column:
    """Row identity kept for a repeated key, null when every copy goes."""
    if strategy == KEEP_FIRST:
        return F.min(row_id())
    if strategy != KEEP_LATEST:
        return F.lit(None).cast("struct<source_file:string,source_row_number:bigint>")
    if latest_by is None or latest_by not in frame.columns:
        return F.max(row_id())
    when = F.col(latest_by)
    dated = dict(frame.dtypes)[latest_by] == "date"
    # Later dates first, the earliest row among equal dates, undated rows never.
    age = -F.unix_date(when) if dated else F.lit(0)
    return F.min(F.when(when.isNotNull(), F.struct(age.alias("age"), row_id().alias("row"))))["row"]


def _likely_repeats(frame: DataFrame, keys: list[str], stage: Stage, name: str) -> DataFrame:
    """Rows whose key's 64-bit hash occurs more than once; keys that repeat are all among them.

    Counting hashes moves a few bytes a row and is done in place, where keys and row identities
    are sorted as text. The hashes that repeat are staged, so that their size is known when the
    rows are looked through for them.
    """
    several = (
        frame.groupBy(F.xxhash64(*keys).alias("_hash")).count().filter("count > 1").select("_hash")
    )
    several = stage.write(several, name)
    return frame.join(several, F.xxhash64(*[frame[key] for key in keys]) == several["_hash"], "left_semi")


def repeated_keys(
    frame: DataFrame,
    keys: list[str],
    strategy: str,
    latest_by: str | None = None,
    stage: Stage | None = None,
    name: str = "repeated-keys",
) -> DataFrame:
    """Keys occurring more than once, as ``_key0..n``, with the kept row as ``_winner``.

    With a stage, for a table that is cheap to read twice, only rows of likely repeats are
    put together by their whole keys.
    """
    if stage is not None:
        frame = _likely_repeats(frame, keys, stage, f"{name}-hashes")
    return (
        frame.groupBy(*[F.col(name).alias(f"_key{i}") for i, name in enumerate(keys)])
        .agg(F.count("*").alias("_copies"), _winner(frame, strategy, latest_by).alias("_winner"))
        .filter("_copies > 1")
    )


def _join_keys(frame: DataFrame, repeats: DataFrame, keys: list[str]) -> DataFrame:
    match = same_key(
        [frame[name] for name in keys], [repeats[f"_key{i}"] for i in range(len(keys))]
    )
    return frame.join(repeats, match, "left").drop(*[f"_key{i}" for i in range(len(keys))])


def _loses() -> Column:
    return F.col("_copies").isNotNull() & ~F.coalesce(
        F.col("_winner") == row_id(), F.lit(False)
    )


def flag_duplicates(
    annotated: DataFrame,
    keys: list[str],
    strategy: str,
    latest_by: str | None,
    stage: Stage | None = None,
    name: str = "repeated-keys",
) -> DataFrame:
    """Add a ``duplicate_row`` issue to each active row that its key does not keep."""
    strategy = strategy_name(strategy)
    repeats = repeated_keys(
        annotated.filter(is_active()), keys, strategy, latest_by, stage, name
    )
    if stage is not None:
        repeats = stage.write(repeats, name)
    found = issue(
        "duplicate_row",
        ", ".join(keys),
        f"Duplicate row excluded using '{strategy}'.",
        F.to_json(F.array(*[F.col(key) for key in keys]), {"ignoreNullFields": "false"}),
        "Review duplicate source records.",
        "error" if strategy == FAIL else "warning",
    )
    duplicate = is_active() & _loses()
    return (
        _join_keys(annotated, repeats, keys)
        .withColumn("_duplicate", duplicate)
        .withColumn(
            "_issues",
            F.when(F.col("_duplicate"), F.concat("_issues", F.array(found))).otherwise(
                F.col("_issues")
            ),
        )
        .withColumn("_step", F.when(F.col("_duplicate"), F.lit("cleaning")).otherwise(F.col("_step")))
        .drop("_duplicate", "_copies", "_winner")
    )


def drop_duplicates(
    frame: DataFrame,
    keys: list[str],
    strategy: str = KEEP_FIRST,
    latest_by: str | None = None,
    stage: Stage | None = None,
) -> DataFrame:
    """Rows that survive the duplicate strategy, without issue bookkeeping.

    Strategies other than the first read the table twice; a stage makes that cheap.
    """
    strategy = strategy_name(strategy)
    if strategy == KEEP_FIRST:
        # Spark trims each task's rows to one per key before the shuffle.
        first = Window.partitionBy(*keys).orderBy("source_file", "source_row_number")
        return (
            frame.withColumn("_rank", F.row_number().over(first)).filter("_rank = 1").drop("_rank")
        )
    if stage is not None:
        frame = stage.write(frame, "duplicates-input")
    repeats = repeated_keys(frame, keys, strategy, latest_by, stage)
    if stage is not None:
        repeats = stage.write(repeats, "repeated-keys")
    return _join_keys(frame, repeats, keys).filter(~_loses()).drop("_copies", "_winner")


def with_repeat_flag(frame: DataFrame, keys: list[Column], flag: str) -> DataFrame:
    """Mark every row whose key occurs on another row too; null keys are not compared."""
    tagged = frame.withColumns({f"_part{i}": key for i, key in enumerate(keys)})
    parts = [f"_part{i}" for i in range(len(keys))]
    repeats = (
        tagged.groupBy(*[F.col(part).alias(f"_of{part}") for part in parts])
        .agg(F.count("*").alias("_copies"))
        .filter("_copies > 1")
    )
    match = same_key(
        [tagged[part] for part in parts], [repeats[f"_of{part}"] for part in parts]
    )
    return (
        tagged.join(repeats, match, "left")
        .withColumn(flag, F.col("_copies").isNotNull())
        .drop("_copies", *parts, *[f"_of{part}" for part in parts])
    )


def with_repeated_rows(frame: DataFrame, columns: list[str], flag: str) -> DataFrame:
    """Mark every row that has an equal in all the columns, where null equals null.

    Rows are told apart by a digest of 128 bits, and only digests are counted over all rows. Rows
    whose digest repeats are then compared value by value, after equal ones were put together, so
    that different rows of one digest are never taken for copies.
    """
    values = [F.col(f"`{name}`") for name in columns]
    text = F.to_json(F.struct(*[v.alias(f"c{i}") for i, v in enumerate(values)]), {"ignoreNullFields": "false"})
    tagged = frame.withColumn("_digest", F.unhex(F.md5(text)))
    several = tagged.groupBy("_digest").count().filter("count > 1").select("_digest")
    compared = [v.alias(f"_own{i}") for i, v in enumerate(values)]
    repeated = (
        tagged.join(several, "_digest", "left_semi")
        .groupBy(F.col("_digest").alias("_of"), *compared)
        .agg(F.count("*").alias("_copies"))
        .filter("_copies > 1")
    )
    equal = tagged["_digest"] == repeated["_of"]
    for i, v in enumerate(values):
        equal = equal & v.eqNullSafe(F.col(f"_own{i}"))
    return (
        tagged.join(repeated, equal, "left")
        .withColumn(flag, F.col("_copies").isNotNull())
        .drop("_digest", "_of", "_copies", *[f"_own{i}" for i in range(len(values))])
    )
