"""Reports published as a whole: tables in a fresh folder, then a manifest that names them.

A report folder holds ``parts/<id>/<section>`` and ``_manifests/<number>.json``. Readers follow
the manifest with the greatest number and never list the parts, so a report appears at once when
its manifest is renamed into place. A run that dies before that leaves the report before it
readable, and sections of an earlier report that a later one lacks are not seen any more.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from dataclasses import asdict, dataclass
from functools import partial

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.errors import ReportError
from tillwise.staging import at_once

MANIFESTS, PARTS = "_manifests", "parts"


@dataclass(frozen=True)
class Section:
    """One table of a report: its folder below the report, its schema, and its rows."""

    name: str
    folder: str
    schema: str
    rows: int


@dataclass(frozen=True)
class Manifest:
    number: int
    sections: tuple[Section, ...]

    def section(self, name: str) -> Section:
        for section in self.sections:
            if section.name == name:
                return section
        raise ReportError(f"The report has no section '{name}'.")


def _located(spark: SparkSession, path: str):
    """The file system that a path lies on, and the path as it names it."""
    located = spark._jvm.org.apache.hadoop.fs.Path(path)
    return located.getFileSystem(spark._jsc.hadoopConfiguration()), located


def _children(spark: SparkSession, path: str) -> list[str]:
    system, folder = _located(spark, path)
    if not system.exists(folder):
        return []
    return [status.getPath().getName() for status in system.listStatus(folder)]


def _numbers(spark: SparkSession, path: str, ending: str) -> list[int]:
    names = _children(spark, f"{path}/{MANIFESTS}")
    return sorted(int(name[: -len(ending)]) for name in names if name.endswith(ending))


def _read(spark: SparkSession, path: str, number: int) -> Manifest:
    system, located = _located(spark, f"{path}/{MANIFESTS}/{number:08d}.json")
    stream = system.open(located)
    try:
        body = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    listed = json.loads(body)
    return Manifest(listed["number"], tuple(Section(**section) for section in listed["sections"]))


def manifest(spark: SparkSession, path: str) -> Manifest | None:
    """The manifest of the report that is published at ``path``, if there is one."""
    path = path.rstrip("/")
    numbers = _numbers(spark, path, ".json")
    return _read(spark, path, numbers[-1]) if numbers else None


def read_section(spark: SparkSession, path: str, name: str) -> DataFrame:
    """One section of the published report, with the schema it was written with."""
    path = path.rstrip("/")
    published = manifest(spark, path)
    if published is None:
        raise ReportError(f"No report is published at '{path}'.")
    section = published.section(name)
    schema = T.StructType.fromJson(json.loads(section.schema))
    return spark.read.schema(schema).parquet(f"{path}/{section.folder}")


def _write(table: DataFrame, folder: str) -> int:
    """Write a table and return its rows, counted in the tasks that write them."""
    written = Observation()
    table.observe(written, F.count(F.lit(1)).alias("rows")).write.parquet(folder)
    return int(written.get["rows"])


def _commit(spark: SparkSession, path: str, published: Manifest) -> None:
    """Claim the manifest's number, then rename the finished manifest into place."""
    stem = f"{path}/{MANIFESTS}/{published.number:08d}"
    system, claim = _located(spark, f"{stem}.claim")
    if not system.createNewFile(claim):
        raise ReportError(f"Another run published a report at '{path}' meanwhile.")
    _, unfinished = _located(spark, f"{stem}.{uuid.uuid4().hex}.tmp")
    _, finished = _located(spark, f"{stem}.json")
    stream = system.create(unfinished, False)
    try:
        stream.write(json.dumps(asdict(published)).encode())
    finally:
        stream.close()
    if not system.rename(unfinished, finished):
        raise ReportError(f"The manifest '{stem}.json' could not be put into place.")


def publish(sections: Mapping[str, DataFrame], path: str, overwrite: bool = False) -> Manifest:
    """Write all sections into a fresh folder and publish them with one manifest.

    Without ``overwrite`` nothing is replaced: a published report and a folder with other files
    are refused, the remains of a run that died are not. Two runs that publish at once get
    different numbers or the later one is refused; neither ever mixes with the other.
    """
    if not sections:
        raise ReportError("A report needs at least one section.")
    spark = next(iter(sections.values())).sparkSession
    path = path.rstrip("/")
    if not overwrite:
        strangers = set(_children(spark, path)) - {MANIFESTS, PARTS}
        if strangers or manifest(spark, path) is not None:
            raise ReportError(f"The report '{path}' already exists. Choose another path.")
    number = max([0, *_numbers(spark, path, ".claim")]) + 1
    part = f"{PARTS}/{uuid.uuid4().hex}"

    def write(name: str, table: DataFrame) -> Section:
        folder = f"{part}/{name}"
        rows = _write(table, f"{path}/{folder}")
        return Section(name, folder, table.schema.json(), rows)

    written = at_once(spark, {name: partial(write, name, table) for name, table in sections.items()})
    published = Manifest(number, tuple(written.values()))
    _commit(spark, path, published)
    return published


def published_size(spark: SparkSession, path: str) -> int:
    """Bytes of the published sections; earlier reports and remains do not count."""
    path = path.rstrip("/")
    published = manifest(spark, path)
    total = 0
    for section in published.sections if published else ():
        system, folder = _located(spark, f"{path}/{section.folder}")
        total += int(system.getContentSummary(folder).getLength())
    return total


def remove_replaced(spark: SparkSession, path: str) -> int:
    """Delete parts that the published report does not name; return how many were deleted.

    Run it when no report is being written or read at ``path``: a run that has not committed yet
    and a reader of an earlier report still need theirs. Without a published report nothing goes.
    """
    path = path.rstrip("/")
    published = manifest(spark, path)
    if published is None:
        return 0
    named = {section.folder.split("/")[1] for section in published.sections}
    stale = [part for part in _children(spark, f"{path}/{PARTS}") if part not in named]
    for part in stale:
        system, folder = _located(spark, f"{path}/{PARTS}/{part}")
        system.delete(folder, True)
    for number in _numbers(spark, path, ".json")[:-1]:
        system, replaced = _located(spark, f"{path}/{MANIFESTS}/{number:08d}.json")
        system.delete(replaced, False)
    return len(stale)
