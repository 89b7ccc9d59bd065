"""Language identification by compression.

Each language is a raw-content dictionary of texts in it. A text, lower-cased, is compressed in
blocks with every dictionary; the language whose dictionary makes the whole text smallest wins.
Where the runner-up is within ``margin`` of it, the prediction is marked as rejected.

A dictionary holds one piece of each of PIECES texts at most, chosen by a hash of the text, so
fitting gathers a bounded number of bytes a language; MOST_LANGUAGES bounds the languages.

Defined results: ``und``, score 0 and rejected, for a text that is null or has no letter, and for
every text if no language was learnt; equal sizes go to the language first in the alphabet; with
one language alone the score is 1; repeated rows are predicted alike.
"""

from __future__ import annotations

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.llm.frames import with_struct

#: Texts in a dictionary, and characters of each.
PIECES, PIECE_CHARS = 250, 1500
#: Languages that may be learnt.
MOST_LANGUAGES = 512
#: Bytes that are compressed in one go.
BLOCK_BYTES = 1536
#: Least advantage over the runner-up, relative to its size, for a prediction to be accepted.
MARGIN = 0.01
LEVEL = 9
FOLDS, HELD_OUT = 4, 2

PREDICTED = T.StructType(
    [
        T.StructField("lang_pred", T.StringType()),
        T.StructField("score", T.DoubleType()),
        T.StructField("accepted", T.BooleanType()),
    ]
)


def is_held_out(doc_id: str = "doc_id") -> Column:
    """True for the documents that languages are not learnt from; those without an id are not learnt from either."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % FOLDS == HELD_OUT


def learn(docs: DataFrame) -> dict[str, bytes]:
    """A dictionary for each value of ``lang`` among the documents that are not held out."""
    known = docs.where(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out()
    )
    spread = F.pmod(F.xxhash64("text"), F.greatest(F.length("text") - PIECE_CHARS, F.lit(1)))
    pieces = known.select(
        "lang",
        F.xxhash64("text").alias("h"),
        F.substring("text", (spread + 1).cast("int"), F.lit(PIECE_CHARS)).alias("piece"),
    )
    # hashes are ranked without copies, so that a text with a third of all rows is one row to the ranking
    ranked = pieces.select("lang", "h").distinct().withColumn(
        "rank", F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    )
    chosen = ranked.where(F.col("rank") <= PIECES).limit(PIECES * MOST_LANGUAGES + 1).collect()
    if len({row.lang for row in chosen}) > MOST_LANGUAGES or len(chosen) > PIECES * MOST_LANGUAGES:
        raise ValueError(f"More than {MOST_LANGUAGES} languages")
    wanted = docs.sparkSession.createDataFrame(chosen, ranked.schema)
    rows = (
        pieces.join(F.broadcast(wanted), ["lang", "h"])
        .groupBy("lang", "rank")
        .agg(F.min("piece").alias("piece"))
        .orderBy("lang", "rank")
        .collect()
    )
    found: dict[str, list[str]] = {}
    for row in rows:
        found.setdefault(row.lang, []).append(row.piece.lower())
    return {lang: "\n".join(own).encode() for lang, own in found.items()}


class Compressors:
    """A compressor for each language."""

    def __init__(self, dictionaries: dict[str, bytes], margin: float) -> None:
        self.margin, self.by_language = margin, []
        for lang, data in sorted(dictionaries.items()):
            if len(data) >= 8:
                raw = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                raw.precompute_compress(level=LEVEL)
                kind = zstandard.ZstdCompressor(dict_data=raw, write_content_size=False, write_dict_id=False)
            else:
                kind = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False)
            self.by_language.append((lang, kind))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.by_language or not any(map(str.isalpha, text)):
            return "und", 0.0, False
        data = text.lower().encode()
        blocks = [data[k : k + BLOCK_BYTES] for k in range(0, len(data), BLOCK_BYTES)]
        sizes = sorted(
            (sum([len(kind.compress(b)) for b in blocks]), lang) for lang, kind in self.by_language
        )
        if len(sizes) == 1:
            return sizes[0][1], 1.0, True
        ahead = (sizes[1][0] - sizes[0][0]) / sizes[1][0]
        return sizes[0][1], 1 - 2 ** (-1 - ahead / self.margin), ahead >= self.margin


def add_languages(
    docs: DataFrame,
    dictionaries: dict[str, bytes],
    name: str = "language",
    keep: list[str] | None = None,
    margin: float = MARGIN,
) -> DataFrame:
    """Add a struct column: the language, a score from 0 to 1, and whether it was accepted."""
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries)

    def prepare():
        compressors = Compressors(shared.value, margin)

        def compute(column: pa.Array) -> pa.StructArray:
            rows = [compressors.predict(x.as_py()) for x in column]
            columns = list(zip(*rows, strict=True)) or [[], [], []]
            kinds = (pa.string(), pa.float64(), pa.bool_())
            return pa.StructArray.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=PREDICTED.names
            )

        return compute

    return with_struct(docs, name, PREDICTED, prepare, keep)
