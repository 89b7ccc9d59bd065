"""How each file of a CSV source is written, found in one distributed pass over all lines.

A file's encoding, delimiter and heading are facts of that file. They are summed up line by line
with map-side combining, so a folder of many large files costs one scan, and no file passes
through the driver or one task. What the driver gets is one row for each file, as many as Spark's
own listing of the folder holds there.
"""

from __future__ import annotations

import csv
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.errors import SourceError

DELIMITERS = (",", ";", "\t", "|")
UTF_8, UTF_16, WINDOWS = "UTF-8", "UTF-16", "cp1252"


@dataclass(frozen=True)
class Dialect:
    """What files that are read alike have in common, and their paths."""

    encoding: str
    delimiter: str
    heading: bytes
    files: tuple[str, ...]

    @property
    def columns(self) -> list[str]:
        """The heading's names; those without text or with a namesake are told apart by their place."""
        line = self.heading
        if self.encoding == UTF_16:
            # The second byte of the line end belongs to the next line.
            line = line[: len(line) // 2 * 2] if line[:2] == b"\xff\xfe" else line[: (len(line) - 1) // 2 * 2]
        text = line.decode("utf-8-sig" if self.encoding == UTF_8 else self.encoding, errors="replace")
        names = next(csv.reader([text.rstrip("\r\n\0")], delimiter=self.delimiter), [])
        times = Counter(name.lower() for name in names)
        return [
            f"{name or '_c'}{i}" if not name or times[name.lower()] > 1 else name for i, name in enumerate(names)
        ]


def marks(line: Column, delimiter: str) -> Column:
    """How often a delimiter stands in a line, outside quoted fields."""
    bare = F.when(line.contains('"'), F.regexp_replace(line, r'"(?:[^"]|"")*+"', "")).otherwise(line)
    return F.octet_length(bare) - F.octet_length(F.replace(bare, F.lit(delimiter), F.lit("")))


def dialect_table(
    spark: SparkSession, path: str, encoding: str | None = None, delimiter: str | None = None
) -> DataFrame:
    """One row for each file that is not empty: ``file``, ``encoding``, ``delimiter``, ``heading``.

    UTF-16 is known by its mark; another file is UTF-8 if all its lines are, else Windows-1252. The
    delimiter is the one that stands in the heading and whose number in the other lines departs
    least from that, the more frequent of equals; a heading without any is one column. Given
    values hold for every file.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).filter(F.trim("value") != "")
    counted = lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"),
        "value",
        *[marks(F.col("value"), d).cast("double").alias(f"n{i}") for i, d in enumerate(DELIMITERS)],
    )
    files = counted.groupBy("file").agg(
        F.min_by("value", F.struct("block", "place")).alias("heading"),
        F.bool_and(F.is_valid_utf8("value")).alias("valid"),
        F.count("*").alias("lines"),
        *[F.sum(f"n{i}").alias(f"s{i}") for i in range(len(DELIMITERS))],
        *[F.sum(F.col(f"n{i}") * F.col(f"n{i}")).alias(f"q{i}") for i in range(len(DELIMITERS))],
    )
    rated = []
    for i, mark in enumerate(DELIMITERS):
        first = marks(F.col("heading"), mark)
        # The sum over all lines of (n - first) squared.
        apart = F.col(f"q{i}") - 2 * first * F.col(f"s{i}") + F.col("lines") * first * first
        rated.append(F.when(first > 0, F.struct(apart.alias("apart"), (-first).alias("first"), F.lit(mark).alias("mark"))))
    steadiest = F.array_min(F.array_compact(F.array(*rated)))["mark"]
    marked = F.hex(F.substring(F.col("heading").cast("binary"), 1, 2)).isin("FFFE", "FEFF")
    found = F.when(marked, UTF_16).when(F.col("valid"), UTF_8).otherwise(WINDOWS)
    return files.select(
        "file",
        (F.lit(encoding) if encoding else found).alias("encoding"),
        (F.lit(delimiter) if delimiter else F.coalesce(steadiest, F.lit(","))).alias("delimiter"),
        "heading",
    )


def read_dialects(
    spark: SparkSession, path: str, encoding: str | None = None, delimiter: str | None = None
) -> list[Dialect]:
    """The files of a source in groups that are read alike: same encoding, delimiter and heading."""
    try:
        table = dialect_table(spark, path, encoding, delimiter)
        rows = (
            table.groupBy("encoding", "delimiter", F.col("heading").cast("binary").alias("heading"))
            .agg(F.sort_array(F.collect_list("file")).alias("files"))
            .orderBy(F.col("files")[0])
            .select("encoding", "delimiter", "heading", "files")
            .collect()
        )
    except AnalysisException as error:
        raise SourceError(f"The source '{path}' cannot be read: {error}") from error
    if not rows:
        raise SourceError(f"The source '{path}' is empty.")
    return [
        Dialect(r["encoding"], r["delimiter"], bytes(r["heading"]), tuple(map(unquote, r["files"]))) for r in rows
    ]


def literal_paths(paths: Iterable[str]) -> list[str]:
    """Paths in which no character stands for a pattern."""
    return ["".join(f"\\{c}" if c in "{}[]*?\\" else c for c in path) for path in paths]
