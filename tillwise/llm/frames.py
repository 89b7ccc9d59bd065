"""Small helpers the operators share: input columns, text keys, word hashes, shared files."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes that end a word in ``[^\x20\x09-\x0D]+``.
SPACE_BYTES = bytes([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
#: Text bytes that are hashed in one go; a longer text is a slice of its own.
SLICE_BYTES = 1 << 20
#: Of those, the bytes whose words are hashed at a time; a longer word is hashed alone.
HASH_BYTES = (1 << 17) - 1
#: Bytes of an Arrow batch, so that texts and what is made of them stay small on both sides.
BATCH_BYTES = 8 << 20

_BASE = 0x9E3779B97F4A7C15
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Keep the session's Arrow batches at BATCH_BYTES or less, as long texts come in them."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = re.fullmatch(r"(\d+)b?", spark.conf.get(setting))
    if not now or not 0 < int(now[1]) <= BATCH_BYTES:
        spark.conf.set(setting, str(BATCH_BYTES))


def text_key(text: str = "text") -> Column:
    """A 128-bit key of a whole text; a null text has the key of the empty one."""
    return F.coalesce(F.unhex(F.md5(F.coalesce(F.col(text), F.lit("")))), F.lit(bytearray(b"")))


def byte_table(lower: bool = False, words: str = "nonspace") -> np.ndarray:
    """Map each byte to itself, to its lower case, or to 256 where it separates words.

    ``words`` is ``nonspace`` or ``alnum`` (ASCII letters and digits, and every byte of a
    character beyond ASCII); bytes between words map to 256.
    """
    out = np.arange(256, dtype=np.uint16)
    if lower:
        out[65:91] += 32
    if words == "alnum":
        keep = np.zeros(256, bool)
        keep[48:58] = keep[97:123] = keep[128:] = True
        keep[65:91] = lower
        out[~keep] = 256
    else:
        out[list(SPACE_BYTES)] = 256
    return out


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash base modulo 2**64, and of its inverse."""
    size = max(1024, 1 << max(n - 1, 1).bit_length())
    if size not in _POWERS:
        inverse = pow(_BASE, -1, 1 << 64)
        up, down = np.full(size, _BASE, np.uint64), np.full(size, inverse, np.uint64)
        up[0] = down[0] = 1
        if size <= 4 * SLICE_BYTES:
            _POWERS[size] = np.cumprod(up), np.cumprod(down)
        else:
            return np.cumprod(up), np.cumprod(down)
    return _POWERS[size]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every input bit over the whole 64-bit word."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def scan(data: np.ndarray, bounds: np.ndarray, mapped: np.ndarray):
    """Find and hash the words of some texts that lie one after another in ``data``.

    ``bounds`` has each text's first byte and, last, the end. Returns the words' starts and ends
    in ``data``, their 64-bit hashes and, for each text, the number of its first word (and, last,
    the number of words).
    """
    codes = mapped[data]
    inside = codes != 256
    n = len(data)
    opens = np.zeros(n + 1, bool)
    opens[1:n] = inside[1:] & ~inside[:-1]
    if n:
        opens[0] = inside[0]
    cuts = bounds[(bounds > 0) & (bounds < n)]
    opens[cuts] = inside[cuts]
    closes = np.zeros(n + 1, bool)
    closes[1:n] = inside[:-1] & ~inside[1:]
    if n:
        closes[n] = inside[-1]
    closes[cuts] |= inside[cuts - 1]
    starts, ends = np.flatnonzero(opens[:n]), np.flatnonzero(closes)
    hashes = np.empty(len(starts), np.uint64)
    first = 0
    while first < len(starts):
        low = starts[first]
        last = max(first + 1, int(np.searchsorted(ends, low + HASH_BYTES, side="right")))
        size = int(ends[last - 1] - low)
        up, down = powers(size + 1)
        total = np.zeros(size + 1, np.uint64)
        np.cumsum((codes[low : low + size].astype(np.uint64) + np.uint64(1)) * up[:size], out=total[1:])
        opened, closed = starts[first:last] - low, ends[first:last] - low
        hashes[first:last] = mix((total[closed] - total[opened]) * down[opened])
        first = last
    return starts, ends, hashes, np.searchsorted(starts, bounds)


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash every run of ``size`` word hashes."""
    n = len(hashes)
    if n < size:
        return np.zeros(0, np.uint64)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up[:n], out=total[1:])
    return mix((total[size:] - total[:-size]) * down[: n - size + 1])


def text_slices(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a text column into runs of rows: first and last row, bytes and text bounds.

    Nulls count as empty. A slice holds about SLICE_BYTES or one longer text.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    bounds = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        stop = int(np.searchsorted(bounds, bounds[row] + SLICE_BYTES, side="right")) - 1
        stop = min(max(stop, row + 1), len(column))
        yield row, stop, data[bounds[row] : bounds[stop]], bounds[row : stop + 1] - bounds[row]
        row = stop


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and path behind the folder that the cluster's settings name."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return pafs.FileSystem.from_uri(uri)


def publish(fs: pafs.FileSystem, path: str, write) -> None:
    """Write a file under a name of its own, then move it into place."""
    draft = f"{path}.{uuid.uuid4().hex}.tmp"
    with fs.open_output_stream(draft, compression=None) as out:
        write(out)
    fs.move(draft, path)


def with_struct(
    docs: DataFrame,
    name: str,
    fields: T.StructType,
    prepare: Callable[[], Callable[[pa.Array], pa.StructArray]],
    keep: list[str] | None = None,
    text: str = "text",
) -> DataFrame:
    """Add a struct column computed from the text column in Arrow batches.

    ``prepare`` runs once a task and returns the function of a text column. Only the columns in
    ``keep`` (all by default) come back beside the new one; an older column of the new one's name
    is replaced.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in (docs.columns if keep is None else keep) if c != name]
    sent = docs.select(*dict.fromkeys([*kept, text]))
    schema = T.StructType([*[sent.schema[c] for c in kept], T.StructField(name, fields)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = prepare()
        for batch in batches:
            made = compute(batch.column(text))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], made], names=[*kept, name]
            )

    return sent.mapInArrow(run, schema)
