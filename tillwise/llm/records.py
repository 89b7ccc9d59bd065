"""Token ids in length-delimited binary records, with an offset index for shuffled reads.

A shard file is a row of frames: the body's length (8 bytes), a masked CRC-32 of those 8 bytes,
the body, a masked CRC-32 of the body; all little-endian. A body is the document's id (8 bytes),
a byte that is 1 if there is an id, the bytes an id takes (2 where the vocabulary allows, else
4), and the ids. The index beside it holds, for each record, its offset and number of ids.

Documents are dealt out by ranges of doc_id, so shard follows shard in ascending order. Every
task writes under names of its own and moves each finished file to its final name; a repeated
task moves the same bytes to the same name. Only files in the manifest count.

Defined results: nulls in doc_id come first; equal ids are ordered by a hash of their texts and
then by place in the input; a null text is the empty one; an empty document is the end id alone;
an empty table makes an empty manifest.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.llm.bpe import byte_symbols
from tillwise.llm.frames import file_system
from tillwise.llm.tokens import Pieces, added_tokens, cut
from tillwise.staging import Stage, checkpoint_root

#: A file is closed once it holds this many bytes.
FILE_BYTES = 256 << 20

MANIFEST = T.StructType(
    [
        T.StructField("shard", T.IntegerType()),
        T.StructField("part", T.IntegerType()),
        T.StructField("file", T.StringType()),
        T.StructField("records", T.LongType()),
        T.StructField("tokens", T.LongType()),
        T.StructField("bytes", T.LongType()),
    ]
)
RECORDS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("n_tokens", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)
_HEAD, _BODY, _INDEX = struct.Struct("<QI"), struct.Struct("<qBB"), struct.Struct("<QQ")


def masked(data: bytes) -> int:
    """A CRC-32, rotated and shifted so that a checksum of framed data differs from its own."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(body: bytes) -> bytes:
    head = struct.pack("<Q", len(body))
    return b"".join((head, struct.pack("<I", masked(head)), body, struct.pack("<I", masked(body))))


class LibraryEncoder:
    """The library's ids of a text as packed bytes, looked up piece by piece."""

    def __init__(self, path: str, end_id: int) -> None:
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.added = added_tokens(path)
        top = max(self.library.get_vocab_size(with_added_tokens=True) - 1, end_id)
        self.width = 2 if top < 1 << 16 else 4
        code = "H" if self.width == 2 else "I"
        self.short = [struct.Struct(f"<{n}{code}").pack for n in range(32)]
        self.end = self.pack([end_id])
        self.marks = {c: self.direct(c) for c in ".,\n"}
        self.model, self.symbols = self.library.model, "".join(byte_symbols())
        self.space = self.symbols[ord(" ")]
        self.later = Pieces(self.piece)

    def pack(self, ids: list[int]) -> bytes:
        if len(ids) < len(self.short):
            return self.short[len(ids)](*ids)
        return struct.pack(f"<{len(ids)}{'H' if self.width == 2 else 'I'}", *ids)

    def direct(self, text: str) -> bytes:
        return self.pack(self.library.encode(text, add_special_tokens=False).ids)

    def piece(self, piece: str) -> bytes:
        """A later piece. Marks after letters, and a line feed, are words of their own."""
        if piece.isalpha() and piece.isascii():  # the usual case; such letters stand for themselves
            return self.pack([token.id for token in self.model.tokenize(self.space + piece)])
        if piece[-1] in ".," and piece[:-1].isalpha():
            return self.later[piece[:-1]] + self.marks[piece[-1]]
        if piece[0] == "\n":
            return self.marks["\n"] + self.word(piece[1:], piece[1:])
        return self.word(" " + piece, piece)

    def word(self, text: str, letters: str) -> bytes:
        """A text that is one word if ``letters`` are: then only the merges are left to do."""
        if letters.isalpha() and (letters.isascii() or max(letters) <= "\xff"):
            shown = text.encode().decode("latin-1").translate(self.symbols)
            return self.pack([token.id for token in self.model.tokenize(shown)])
        return self.direct(text)

    def encode(self, text: str) -> bytes:
        pieces = cut(text, self.added)
        if pieces is None:
            return self.direct(text) + self.end
        ids = [self.direct(pieces[0])]
        ids.extend(map(self.later.__getitem__, pieces[1:]))
        ids.append(self.end)
        try:
            return b"".join(ids)
        except TypeError:  # an odd piece
            return self.direct(text) + self.end


@lru_cache(maxsize=2)
def library_encoder(path: str, end_id: int) -> LibraryEncoder:
    """A worker's encoder, loaded once: later tasks find the pieces that earlier ones met."""
    return LibraryEncoder(path, end_id)


class ShardWriter:
    """Writes one task's records to rolling files with their indexes."""

    def __init__(self, folder: str, shard: int, limit: int) -> None:
        self.fs, self.folder = file_system(folder)
        self.shard, self.limit, self.part, self.out = shard, limit, 0, None

    def add(self, doc_id: int | None, ids: bytes, width: int) -> Iterator[tuple]:
        if self.out is None:
            self.name = f"shard-{self.shard:06d}-{self.part:05d}"
            self.draft = f"{self.folder}/{self.name}.{uuid.uuid4().hex}.tmp"
            self.out = self.fs.open_output_stream(self.draft, compression=None)
            self.at, self.tokens, self.index = 0, 0, []
        body = _BODY.pack(doc_id or 0, doc_id is not None, width) + ids
        data = frame(body)
        self.out.write(data)
        self.index.append(_INDEX.pack(self.at, len(ids) // width))
        self.at += len(data)
        self.tokens += len(ids) // width
        if self.at >= self.limit:
            yield from self.close()

    def close(self) -> Iterator[tuple]:
        if self.out is None:
            return
        self.out.close()
        with self.fs.open_output_stream(self.draft + ".idx", compression=None) as out:
            out.write(b"".join(self.index))
        self.fs.move(self.draft + ".idx", f"{self.folder}/{self.name}.idx")
        self.fs.move(self.draft, f"{self.folder}/{self.name}.rec")
        yield self.shard, self.part, f"{self.name}.rec", len(self.index), self.tokens, self.at
        self.out, self.part = None, self.part + 1


def write_records(
    docs: DataFrame,
    path: str,
    folder: str | None = None,
    end_id: int = 0,
    file_bytes: int = FILE_BYTES,
) -> tuple[str, DataFrame]:
    """Encode the documents and write them; returns the folder and the manifest.

    ``path`` is a tokenizer file that every executor has; ``folder`` is on storage that all of
    them share, below the checkpoint folder by default.
    """
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_root(spark)}/records-{uuid.uuid4().hex}"
    fs, local = file_system(folder)
    fs.create_dir(local, recursive=True)
    order = ["doc_id", "text_order", "place"]
    dealt = (
        docs.select(
            "doc_id",
            F.coalesce("text", F.lit("")).alias("text"),
            F.xxhash64("text").alias("text_order"),
            F.monotonically_increasing_id().alias("place"),
        )
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(path, end_id)
        writer = ShardWriter(folder, TaskContext.get().partitionId(), file_bytes)
        done: list[tuple] = []
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = encoder.encode(text.as_py())
                done.extend(writer.add(doc_id.as_py(), ids, encoder.width))
        done.extend(writer.close())
        rows = [dict(zip(MANIFEST.names, x, strict=True)) for x in done]
        yield pa.RecordBatch.from_pylist(rows, _arrow(MANIFEST))

    return folder, Stage(spark).write(dealt.mapInArrow(run, MANIFEST), "manifest")


def _arrow(schema: T.StructType) -> pa.Schema:
    kinds = {T.IntegerType(): pa.int32(), T.LongType(): pa.int64(), T.StringType(): pa.string()}
    return pa.schema([(f.name, kinds[f.dataType]) for f in schema.fields])


def read_frames(source, name: str) -> Iterator[tuple[int | None, np.ndarray]]:
    """The records of one open file, in order, with every checksum tested."""
    while head := source.read(12):
        length, check = _HEAD.unpack(head)
        if masked(head[:8]) != check:
            raise ValueError(f"{name}: the length of a record is damaged")
        body = source.read(length)
        if len(body) != length or struct.unpack("<I", source.read(4))[0] != masked(body):
            raise ValueError(f"{name}: a record is damaged")
        doc_id, known, width = _BODY.unpack_from(body)
        ids = np.frombuffer(body, "<u2" if width == 2 else "<u4", offset=_BODY.size)
        yield doc_id if known else None, ids


def read_record(folder: str, file: str, number: int) -> tuple[int | None, np.ndarray]:
    """One record of a file by its number, found through the index."""
    fs, local = file_system(folder)
    with fs.open_input_file(f"{local}/{file.removesuffix('.rec')}.idx") as index:
        index.seek(number * _INDEX.size)
        offset, _ = _INDEX.unpack(index.read(_INDEX.size))
    with fs.open_input_file(f"{local}/{file}") as source:
        source.seek(offset)
        return next(read_frames(source, file))


def each_file(manifest: DataFrame) -> DataFrame:
    """The manifest with one file a partition; it has one short row a file."""
    return manifest.coalesce(1).repartition(max(1, manifest.count()))


def read_records(
    spark: SparkSession,
    folder: str,
    manifest: DataFrame,
    schema: T.StructType = RECORDS,
    describe: Callable[[int | None, int, np.ndarray], tuple] | None = None,
) -> DataFrame:
    """Read every file of the manifest back, one row a record.

    ``describe`` makes the row from doc_id, the number of ids in all records before, and the
    ids; by default the row has their number and the CRC-32 of them as 32-bit integers.
    """
    make = describe or (
        lambda doc_id, start, ids: (doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()))
    )
    before = Window.orderBy("shard", "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("start", F.coalesce(F.sum("tokens").over(before), F.lit(0)))
    arrow = _arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, local = file_system(folder)
        for batch in batches:
            for file in batch.to_pylist():
                rows, start = [], file["start"]
                with fs.open_input_stream(f"{local}/{file['file']}", compression=None) as source:
                    for doc_id, ids in read_frames(source, file["file"]):
                        rows.append(make(doc_id, start, ids))
                        start += len(ids)
                        if len(rows) >= 4096:
                            yield _batch(rows, arrow)
                            rows = []
                if start - file["start"] != file["tokens"]:
                    raise ValueError(f"{file['file']} does not hold what its manifest says")
                if rows:
                    yield _batch(rows, arrow)

    return each_file(placed.select("file", "start", "tokens")).mapInArrow(run, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )
