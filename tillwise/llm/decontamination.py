"""Benchmark decontamination: a broadcast set of benchmark windows, scanned over all documents.

Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased. A window is
``size`` consecutive words of a benchmark item; a shorter item with words is one window. The
windows' hashes are broadcast in blocks of a bounded number of bytes (one block for any usual
benchmark), each document's word windows are looked up, every hit is compared word by word, and
all words inside an occurrence are marked.

Defined results: a null or empty text has no words, no hits and is clean; an item without words
has no windows; an item whose id is null marks words but is not listed; items that share an id
are listed once; repeated documents each get their row; an empty benchmark leaves all clean.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.llm.frames import byte_table, scan, text_slices, window_hashes, with_struct

#: Most benchmark text in one broadcast; a larger benchmark takes several, one after another.
BLOCK_BYTES = 32 << 20
_BITS = 20

REPORT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("items", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
    ]
)


class WindowSet:
    """The windows of some items: by length a bit table, sorted hashes, and exact words."""

    def __init__(self, items: list[tuple[str | None, str]], size: int) -> None:
        self.size = size
        exact: dict[int, dict[bytes, set[str]]] = {}
        hashes: dict[int, set[int]] = {}
        table = byte_table(True, "alnum")
        ids = [x for x, _ in items]
        for first, last, data, bounds in text_slices(pa.array([x for _, x in items], pa.string())):
            starts, ends, words, at = scan(data, bounds, table)
            lowered = data.tobytes().lower()
            for i in range(first, last):
                a, b = int(at[i - first]), int(at[i - first + 1])
                if a == b:
                    continue
                width = min(size, b - a)
                found = window_hashes(words[a:b], width)
                hashes.setdefault(width, set()).update(found.tolist())
                texts = [lowered[starts[k] : ends[k]] for k in range(a, b)]
                for k in range(b - a - width + 1):
                    owners = exact.setdefault(width, {}).setdefault(
                        b" ".join(texts[k : k + width]), set()
                    )
                    if ids[i] is not None:
                        owners.add(ids[i])
        self.exact = exact
        self.hashes = {w: np.array(sorted(h), np.uint64) for w, h in hashes.items()}

    def bits(self, width: int) -> np.ndarray:
        out = np.zeros(1 << _BITS, bool)
        out[self.hashes[width] >> np.uint64(64 - _BITS)] = True
        return out


def _blocks(benchmark: DataFrame, limit: int) -> Iterator[list[tuple[str | None, str]]]:
    """The items in lists of about ``limit`` bytes of text."""
    items = benchmark.select(
        F.col("item_id").cast("string").alias("item_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    total = items.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    count = max(1, math.ceil(total / limit))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(count))
    for i in range(count):
        rows = (items if count == 1 else items.where(block == i)).collect()
        yield [(r["item_id"], r["text"]) for r in rows]


def _scanner(shared):
    """Prepare the function that marks one block's windows in a column of texts."""

    def prepare():
        windows: WindowSet = shared.value
        mapped = byte_table(True, "alnum")
        lookups = {w: (windows.bits(w), h) for w, h in windows.hashes.items()}

        def compute(column: pa.Array) -> pa.StructArray:
            counts, hits, items, spans = [], [], [], []
            for first, last, data, bounds in text_slices(column):
                starts, ends, words, at = scan(data, bounds, mapped)
                edges = np.zeros(len(words) + 1, np.int64)
                owners: list[set[str]] = [set() for _ in range(last - first)]
                for width, (bits, known) in lookups.items():
                    found = window_hashes(words, width)
                    maybe = np.flatnonzero(bits[found >> np.uint64(64 - _BITS)])
                    if not len(maybe):
                        continue
                    place = np.minimum(np.searchsorted(known, found[maybe]), len(known) - 1)
                    maybe = maybe[known[place] == found[maybe]]
                    rows = np.searchsorted(at, maybe, side="right") - 1
                    within = maybe + width <= at[rows + 1]
                    for k, row in zip(maybe[within].tolist(), rows[within].tolist(), strict=True):
                        words_here = b" ".join(
                            data[starts[j] : ends[j]].tobytes().lower() for j in range(k, k + width)
                        )
                        if (own := windows.exact[width].get(words_here)) is not None:
                            owners[row] |= own
                            edges[k] += 1
                            edges[k + width] -= 1
                covered = np.cumsum(edges)[:-1] > 0
                totals = np.concatenate([[0], np.cumsum(covered)])
                counts.append(np.diff(at))
                hits.append(totals[at[1:]] - totals[at[:-1]])
                for i in range(last - first):
                    items.append(sorted(owners[i]))
                    if hits[-1][i]:
                        own = np.flatnonzero(
                            np.diff(np.concatenate([[0], covered[at[i] : at[i + 1]], [0]]).astype(np.int8))
                        )
                        spans.append(own.reshape(-1, 2).tolist())
                    else:
                        spans.append([])
            join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            return pa.StructArray.from_arrays(
                [
                    pa.array(join(counts), pa.int64()),
                    pa.array(join(hits), pa.int64()),
                    pa.array(items, pa.list_(pa.string())),
                    pa.array(spans, pa.list_(pa.list_(pa.int64()))),
                ],
                names=REPORT.names,
            )

        return compute

    return prepare


def _merged(reports: list[Column]) -> Column:
    """Join the reports that several blocks made of one document."""
    spans = F.array_sort(F.flatten(F.array(*[r["spans"] for r in reports])))
    joined = F.aggregate(
        spans,
        F.array().cast("array<array<bigint>>"),
        lambda done, x: F.when(
            (F.size(done) > 0) & (x[0] <= F.element_at(done, -1)[1]),
            F.concat(
                F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))),
                F.array(
                    F.array(F.element_at(done, -1)[0], F.greatest(F.element_at(done, -1)[1], x[1]))
                ),
            ),
        ).otherwise(F.concat(done, F.array(x))),
    )
    hit = F.aggregate(joined, F.lit(0).cast("long"), lambda n, x: n + x[1] - x[0])
    return F.struct(
        reports[0]["n_words"].alias("n_words"),
        hit.alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten(F.array(*[r["items"] for r in reports])))).alias(
            "items"
        ),
        joined.alias("spans"),
    )


def mark_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    size: int = 13,
    name: str = "contamination",
    keep: list[str] | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Add a report to each document: words, hit words, item ids as strings, and hit spans.

    Spans are half-open ranges of word positions. ``keep`` lists the columns to carry along.
    """
    context = docs.sparkSession.sparkContext
    kept = [c for c in (docs.columns if keep is None else keep) if c != name]
    blocks = _blocks(benchmark, block_bytes)
    sets = [context.broadcast(WindowSet(rows, size)) for rows in blocks]
    if len(sets) == 1:
        return with_struct(docs, name, REPORT, _scanner(sets[0]), kept)
    parts = [f"{name}_block_{i}" for i in range(len(sets))]
    out = docs
    carried = list(dict.fromkeys([*kept, "text"]))
    for part, shared in zip(parts, sets, strict=True):
        out = with_struct(out, part, REPORT, _scanner(shared), carried)
        carried = [*carried, part]
    return out.select(*kept, _merged([F.col(p) for p in parts]).alias(name))


def is_contaminated(report: str = "contamination", one_in: int = 20) -> Column:
    """True where at least one word in ``one_in`` is hit."""
    hit = F.col(report)["n_hit"]
    return (hit > 0) & (F.lit(one_in) * hit >= F.col(report)["n_words"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 13) -> DataFrame:
    """Leave out the contaminated documents; the others stay as they are."""
    marked = mark_contamination(docs, benchmark, size, "contamination_report")
    return marked.where(~is_contaminated("contamination_report")).select(*docs.columns)
