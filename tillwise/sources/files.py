"""File sources: CSV, Parquet, ORC and JSON folders, trace columns, and source profiles."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.errors import ConfigError, RetailDataError, SourceError
from tillwise.operators.issues import union_all
from tillwise.sources.dialects import Dialect, literal_paths, marks, read_dialects
from tillwise.sources.pages import read_api_pages
from tillwise.sources.schemas import KINDS, TARGETS, TRACE_COLUMNS, dataset_kind
from tillwise.staging import Stage

# Cells that read as missing.
NULL_SPELLINGS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
)

#: Where the reader keeps a record whose number of fields is not the heading's.
CORRUPT = "_corrupt_record"


@dataclass(frozen=True)
class Source:
    """A read table with the facts that were needed to read it.

    Where files are read in several ways, ``parts`` has a source for each, and the table is their
    union; delimiter and encoding are then known for the parts alone.
    """

    frame: DataFrame
    file_type: str
    delimiter: str | None = None
    encoding: str | None = None
    root: str | None = None
    parts: tuple[Source, ...] = ()


def file_below(root: str | None) -> Column:
    """The name of a row's file: its path below ``root``, or the file's own name.

    Files in different folders of one source may have equal names, so a source that has
    subfolders needs its root here for its rows to be told apart.
    """
    name, path = (_decoded(F.col(f"_metadata.{x}")) for x in ("file_name", "file_path"))
    if root is None:
        return name
    folder = "/" + re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:/*", "", root).strip("/")
    at = F.locate(f"{folder}/", path)
    below = F.substring(path, at + len(folder) + 1, F.length(path))
    return F.when(path.endswith(folder), name).when(at > 0, below).otherwise(path)


def _decoded(path: Column) -> Column:
    """A path of a row's file as it is written in a file listing."""
    escaped = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.when(path.contains("%"), escaped).otherwise(path)


def _read_cp1252(frame: DataFrame) -> DataFrame:
    """Turn Latin-1 text into Windows-1252, which differs in the range 0x80 to 0x9f.

    Spark decodes a fixed list of character sets, and this one is not on it.
    """
    codes = [bytes([code]) for code in range(0x80, 0xA0)]
    pairs = [(c.decode("latin-1"), c.decode("cp1252", "ignore")) for c in codes]
    known = [(old, new) for old, new in pairs if new]
    old, new = ("".join(part) for part in zip(*known, strict=True))
    table = str.maketrans(old, new)
    return frame.select(
        *[
            F.translate(F.col(f"`{name}`"), old, new).alias(name.translate(table))
            for name in frame.columns
        ]
    )


def read_csv_source(
    spark: SparkSession,
    path: str,
    encoding: str | None = None,
    delimiter: str | None = None,
    multi_line: bool = False,
    nulls: Sequence[str] = NULL_SPELLINGS,
) -> Source:
    """Read CSV with every column as text, each file in its own encoding and with its delimiter.

    Files that are read alike are read together; tables with other headings are put together by
    column names, where a column that a file lacks is null. A row with fewer fields than the
    heading is filled up with nulls; one with more fails the job and names its file (see
    :func:`long_rows` for its number). Cells spelled as one of ``nulls`` are null. ``multi_line``
    allows line breaks inside quotes, at the price of one task per file. UTF-16 needs it as well,
    because its line ends are not single bytes.
    """
    found = read_dialects(spark, path, encoding, delimiter)
    parts = tuple(_read_dialect(spark, path, d, len(found) == 1, multi_line, nulls) for d in found)
    if len(parts) == 1:
        return parts[0]
    frame = parts[0].frame
    for part in parts[1:]:
        frame = frame.unionByName(part.frame, allowMissingColumns=True)
    same = lambda values: values.pop() if len(values) == 1 else None
    return Source(
        frame, "csv", same({p.delimiter for p in parts}), same({p.encoding for p in parts}), path, parts
    )


def _read_dialect(
    spark: SparkSession, path: str, dialect: Dialect, alone: bool, multi_line: bool, nulls: Sequence[str]
) -> Source:
    checked, own = _read_checked(spark, path, dialect, alone, multi_line)
    names = [n for n in checked.columns if n != CORRUPT]
    # Records are whole only where the reader is asked for all columns, so the message names them.
    too_long = F.concat(
        F.lit("A row has more fields than the heading in file "),
        _decoded(F.col("_metadata.file_path")),
        F.lit(": "),
        F.col(CORRUPT),
        F.lit(", read as "),
        F.concat_ws(" | ", *[F.col(f"`{n}`") for n in own]),
    )
    # The condition reads the whole record, so no row goes unchecked when columns are left out.
    fine = F.when(_too_long(dialect.delimiter, own), F.raise_error(too_long).cast("boolean")).otherwise(True)
    cells = [F.when(~F.col(f"`{n}`").isin(*nulls), F.col(f"`{n}`")) if nulls else F.col(f"`{n}`") for n in names]
    frame = checked.filter(fine).select(*[c.alias(n) for c, n in zip(cells, names, strict=True)])
    windows = dialect.encoding.lower() in ("cp1252", "windows-1252")
    read = _read_cp1252(frame) if windows else frame
    return Source(read, "csv", dialect.delimiter, dialect.encoding, path)


def _read_checked(
    spark: SparkSession, path: str, dialect: Dialect, alone: bool, multi_line: bool
) -> tuple[DataFrame, list[str]]:
    """The rows of a dialect's files, with the record of each that has too few or too many fields."""
    windows = dialect.encoding.lower() in ("cp1252", "windows-1252")
    wide = dialect.encoding.lower().startswith(("utf-16", "utf-32"))
    reader = (
        spark.read.option("header", True)
        .option("sep", dialect.delimiter)
        .option("encoding", "ISO-8859-1" if windows else dialect.encoding)
        .option("escape", '"')
        .option("multiLine", multi_line or wide)
    )
    # One way of reading holds for all files, so that the folder is listed by the reader itself.
    paths = path if alone else literal_paths(dialect.files)
    if not alone and any("=" in file.rpartition("/")[0] for file in dialect.files):
        reader = reader.option("basePath", path)
    # A heading with line breaks in it is left to the reader.
    own = reader.csv(paths).columns if multi_line and dialect.heading.count(b'"') % 2 else dialect.columns
    if not own:
        raise SourceError(f"The source '{path}' has no columns.")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*own, CORRUPT]])
    rows = reader.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    return rows.option("enforceSchema", True).csv(paths), own


def _too_long(delimiter: str, names: list[str]) -> Column:
    return F.coalesce(marks(F.col(CORRUPT), delimiter) >= len(names), F.lit(False))


def long_rows(
    spark: SparkSession, path: str, stage: Stage, encoding: str | None = None, delimiter: str | None = None
) -> DataFrame:
    """File, row number and text of every row with more fields than its file's heading."""
    found = read_dialects(spark, path, encoding, delimiter)
    tables = []
    for dialect in found:
        checked, names = _read_checked(spark, path, dialect, len(found) == 1, False)
        numbered = number_rows(checked, stage, root=path)
        tables.append(
            numbered.filter(_too_long(dialect.delimiter, names)).select(
                "source_file", "source_row_number", F.col(CORRUPT).alias("record")
            )
        )
    return union_all(tables)


def load_source(
    spark: SparkSession,
    path: str,
    encoding: str | None = None,
    delimiter: str | None = None,
    schema: str | None = None,
) -> Source:
    """Choose a reader by the extension of the file or folder name.

    JSON is read once more to find its columns unless ``schema`` names them.
    """
    extension = path.rstrip("/").rpartition(".")[2].lower()
    if extension == "csv":
        return read_csv_source(spark, path, encoding, delimiter)
    if extension in ("parquet", "orc"):
        return Source(spark.read.format(extension).load(path), extension, root=path)
    if extension in ("json", "jsonl"):
        return Source(spark.read.json(path, schema=schema, primitivesAsString=True), "json", root=path)
    raise SourceError(f"The file type '.{extension}' is not supported.")


def load_sources(
    spark: SparkSession,
    files: Mapping[str, str] | None = None,
    pages: Mapping[str, str] | None = None,
    allow_mixed: bool = False,
) -> dict[str, Source]:
    """Read each dataset from files, from landed pages, or from both if that is allowed.

    With both, a file takes precedence over the pages of the same dataset.
    """
    files = {dataset_kind(name): path for name, path in (files or {}).items()}
    pages = {dataset_kind(name): path for name, path in (pages or {}).items()}
    if files and pages and not allow_mixed:
        raise ConfigError("Page sources cannot be combined with files unless that is allowed.")
    missing = [kind for kind in KINDS if kind not in {*files, *pages, TARGETS}]
    if missing:
        raise ConfigError(f"No source is given for: {', '.join(missing)}")
    loaded = {
        kind: Source(read_api_pages(spark, path, kind, trace=True), "api")
        for kind, path in pages.items()
    }
    loaded.update({kind: load_source(spark, path) for kind, path in files.items()})
    return loaded


def with_trace(
    frame: DataFrame, source_file: str | None = None, root: str | None = None
) -> DataFrame:
    """Add file name, row number (from 2, after the heading), status, and reason.

    Parquet carries exact row positions, so nothing is shuffled. Use ``number_rows`` for
    text formats, whose rows have no stored position. Files are named by their path below
    ``root``, the folder that was read.
    """
    name = F.lit(source_file) if source_file else file_below(root)
    return frame.select(
        "*",
        name.alias("source_file"),
        (F.col("_metadata.row_index") + 2).alias("source_row_number"),
        F.lit("pending").alias("processing_status"),
        F.lit(None).cast("string").alias("exclusion_reason"),
    )


def number_rows(
    frame: DataFrame, stage: Stage, source_file: str | None = None, root: str | None = None
) -> DataFrame:
    """Trace columns for text formats: rows numbered in file order without one big sort.

    Each task numbers its own rows; the per-split counts (one row per split) give every
    split its offset. The tagged rows are staged first, so that both passes see the same
    numbers even if an executor is lost in between.
    """
    tagged = stage.write(
        frame.select(
            "*",
            F.col("_metadata.file_path").alias("_file"),
            file_below(root).alias("_name"),
            F.col("_metadata.file_block_start").alias("_split"),
            F.monotonically_increasing_id().alias("_position"),
        ),
        f"numbered-{source_file or 'rows'}",
    )
    splits = tagged.groupBy("_file", "_split").agg(
        F.count("*").alias("_rows"), F.min("_position").alias("_first")
    )
    before = Window.partitionBy("_file").orderBy("_split").rowsBetween(
        Window.unboundedPreceding, -1
    )
    offsets = splits.select(
        "_file",
        "_split",
        (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    name: Column = F.lit(source_file) if source_file else F.col("_name")
    return (
        tagged.join(offsets, ["_file", "_split"])
        .select(
            *[F.col(f"`{column}`") for column in frame.columns],
            name.alias("source_file"),
            (F.col("_position") + F.col("_shift") + 2).alias("source_row_number"),
            F.lit("pending").alias("processing_status"),
            F.lit(None).cast("string").alias("exclusion_reason"),
        )
    )


def traced(source: Source, stage: Stage) -> DataFrame:
    """The table of a source with its trace columns, however it was read."""
    if "source_row_number" in source.frame.columns:
        return source.frame
    if source.parts:
        return union_all([traced(part, stage) for part in source.parts])
    if source.file_type == "parquet":
        return with_trace(source.frame, root=source.root)
    return number_rows(source.frame, stage, root=source.root)


def source_profile(source: Source, dataset: str) -> DataFrame:
    """One row per file: dataset, name, type, bytes, row and column counts, read options.

    Landed pages are one logical file, whose size is not known here.
    """
    if source.parts:
        return union_all([source_profile(part, dataset) for part in source.parts])
    columns = [name for name in source.frame.columns if name not in TRACE_COLUMNS]
    if not columns:
        raise RetailDataError("A source profile needs at least one column.")
    if "source_file" in source.frame.columns:
        name, size = F.col("source_file"), F.lit(None).cast("bigint")
    else:
        name, size = file_below(source.root), F.col("_metadata.file_size")
    return (
        source.frame.select(name.alias("filename"), size.alias("file_size"))
        .groupBy("filename")
        .agg(F.max("file_size").alias("file_size"), F.count("*").alias("row_count"))
        .select(
            F.lit(dataset).alias("dataset"),
            "filename",
            F.lit(source.file_type).alias("file_type"),
            "file_size",
            "row_count",
            F.lit(len(columns)).alias("column_count"),
            F.lit(", ".join(columns)).alias("columns"),
            F.lit(source.delimiter).cast("string").alias("detected_delimiter"),
            F.lit(source.encoding).cast("string").alias("detected_encoding"),
        )
    )
