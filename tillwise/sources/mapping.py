"""Mapping of source headings to canonical columns.

Headings are driver-side metadata: a table has a handful of columns however many rows it
holds, so the matching is plain Python and only the rename touches the DataFrame.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.errors import RetailDataError
from tillwise.sources.schemas import DatasetSchema, schema_of


def normalize_column_name(heading: str) -> str:
    """Lower-case heading with blanks and hyphens turned into single underscores."""
    return re.sub(r"_+", "_", re.sub(r"[\s-]+", "_", heading.strip().lower()))


@dataclass(frozen=True)
class HeadingMap:
    """Which source heading feeds which column, and what could not be decided."""

    schema: DatasetSchema
    headings: tuple[str, ...]
    sources: Mapping[str, str]
    ambiguous: Mapping[str, tuple[str, ...]] = field(default_factory=dict)

    @property
    def missing_required(self) -> tuple[str, ...]:
        return tuple(name for name in self.schema.required if name not in self.sources)

    @property
    def unknown(self) -> tuple[str, ...]:
        used = set(self.sources.values()).union(*self.ambiguous.values())
        return tuple(heading for heading in self.headings if heading not in used)

    @property
    def complete(self) -> bool:
        return not self.missing_required and not self.ambiguous

    @property
    def renames(self) -> dict[str, str]:
        return {heading: name for name, heading in self.sources.items()}

    def report_rows(self) -> list[tuple[str, str, str, str]]:
        """Rows of source heading, canonical column, status, requirement."""

        def need(name: str) -> str:
            return "required" if name in self.schema.required else "optional"

        ordered = [*self.schema.required, *self.schema.optional]
        rows = [
            (self.sources[name], name, "matched", need(name))
            for name in ordered
            if name in self.sources
        ]
        rows += [("", name, "missing", "required") for name in self.missing_required]
        rows += [
            (", ".join(headings), name, "ambiguous", need(name))
            for name, headings in self.ambiguous.items()
        ]
        rows += [(heading, "", "unknown", "") for heading in self.unknown]
        return rows


def map_columns(
    headings: Sequence[str],
    dataset: str,
    overrides: Mapping[str, str] | None = None,
    aliases: Mapping[str, Sequence[str]] | None = None,
) -> HeadingMap:
    """Match headings to columns; anything undecidable is reported, never guessed."""
    schema = schema_of(dataset)
    manual = dict(overrides or {})
    stray = [heading for heading in manual if heading not in headings]
    stray += [name for name in manual.values() if name not in schema.columns]
    if stray:
        raise RetailDataError(f"Unknown source or target in the column mapping: {stray}")

    wanted: dict[str, set[str]] = {}
    for entry in schema.fields:
        known = entry.headings if aliases is None else aliases.get(entry.name, ())
        wanted[entry.name] = {normalize_column_name(text) for text in (entry.name, *known)}

    # Each free heading votes for every column it could stand for.
    votes = {
        heading: [name for name, tokens in wanted.items() if normalize_column_name(heading) in tokens]
        for heading in headings
        if heading not in manual
    }
    sources: dict[str, str] = {}
    ambiguous: dict[str, tuple[str, ...]] = {}
    for name in schema.columns:
        chosen = [heading for heading, target in manual.items() if target == name]
        if not chosen:
            chosen = [heading for heading, names in votes.items() if name in names]
            shared = [heading for heading in chosen if len(votes[heading]) > 1]
            if shared:
                ambiguous[name] = tuple(shared)
                continue
        if len(chosen) == 1:
            sources[name] = chosen[0]
        elif chosen:
            ambiguous[name] = tuple(chosen)
    return HeadingMap(schema, tuple(headings), sources, ambiguous)


def apply_mapping(frame: DataFrame, mapping: HeadingMap) -> DataFrame:
    """Rename mapped headings and add the required columns that are absent as nulls."""
    renamed = frame.withColumnsRenamed(mapping.renames)
    absent = [name for name in mapping.schema.required if name not in renamed.columns]
    return renamed.withColumns({name: F.lit(None).cast("string") for name in absent})


def mapping_report(spark: SparkSession, mapping: HeadingMap) -> DataFrame:
    return spark.createDataFrame(
        mapping.report_rows(),
        "source_column string, canonical_column string, status string, requirement string",
    )
