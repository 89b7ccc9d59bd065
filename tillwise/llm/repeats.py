"""Substring dedup: words in passages that occur more than once, found by phrase automata.

A window is ``size`` consecutive words of one document; it repeats if its words also start
anywhere else, the same document included. All words in repeating windows are marked.

1. Anchors. The anchor of a window is its leftmost phrase of ``PHRASE`` words with the least
   hash, so equal windows have equal anchors in equal places. Anchors that occur once in the
   corpus are dropped by an aggregate.
2. Blocks. The windows around an anchor that is left are one run of words, a block. Equal blocks
   are counted together, and blocks are dealt out by anchor.
3. Confirming. Per anchor, windows are compared word by word; runs of repeating windows are
   passages. Each shard compiles its passages, as strings with a character per word, into an
   Aho-Corasick automaton and streams its blocks through it, which locates every occurrence.
4. What was located goes back to the documents with the block.

A document is only sent past the shards that hold one of its anchors, so the work grows with the
corpus and no automaton holds more than ``SHARD_WORDS`` words of blocks. An anchor with very many
occurrences is dealt out window by window instead of block by block.

Defined results: null, empty and short texts (under ``size`` words) have nothing removed; of
repeated rows every copy loses its words; ids play no part, so null and equal ids are no matter.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillwise.llm.frames import byte_table, scan, small_batches, text_key, text_slices, window_hashes
from tillwise.staging import Stage

SIZE = 35
#: Words in an anchor's phrase.
PHRASE = 8
#: An anchor with more occurrences than this is dealt out window by window.
HOT_ANCHOR = 50_000
#: Words of blocks in one automaton.
SHARD_WORDS = 400_000

REPORT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()),
        T.StructField("kept", T.StringType()),
    ]
)


def anchors_of(hashes: np.ndarray, first: np.ndarray, size: int):
    """The windows (their first words) of some texts, each one's anchor word, and phrase hashes.

    ``first`` has each text's first word and, last, the number of words.
    """
    phrases = window_hashes(hashes, min(PHRASE, size))
    reach = size - min(PHRASE, size) + 1
    lengths = np.diff(first)
    rest = np.repeat(first[1:], lengths) - np.arange(len(hashes))
    windows = np.flatnonzero(rest >= size)
    if not len(windows):
        return windows, windows, phrases
    least = (phrases & ~np.uint64(0xFFFFFFFF)) | np.arange(len(phrases), dtype=np.uint64)
    span = 1
    while 2 * span <= reach:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if span < reach:
        least = np.minimum(least[: len(least) - (reach - span)], least[reach - span :])
    return windows, (least[windows] & np.uint64(0xFFFFFFFF)).astype(np.int64), phrases


def _anchor_rows(docs: DataFrame, size: int) -> DataFrame:
    """(anchor, key, n): the distinct anchors of each text and how often they occur, 2 at most."""

    def run(batches):
        table = byte_table()
        for batch in batches:
            hashes, rows, counts = [], [], []
            for start, _, data, bounds in text_slices(batch.column(1)):
                _, _, words, first = scan(data, bounds, table)
                _, at, phrases = anchors_of(words, first, size)
                at = np.unique(at)
                row = np.searchsorted(first, at, side="right") - 1
                order = np.lexsort((phrases[at], row))
                found, row = phrases[at][order], row[order]
                new = np.ones(len(found), bool)
                new[1:] = (found[1:] != found[:-1]) | (row[1:] != row[:-1])
                each = np.flatnonzero(new)
                hashes.append(found[each])
                rows.append(row[each] + start)
                counts.append(np.minimum(np.diff(np.append(each, len(found))), 2))
            if hashes:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(hashes).view(np.int64)),
                        batch.column(0).take(pa.array(np.concatenate(rows))),
                        pa.array(np.concatenate(counts).astype(np.int64)),
                    ],
                    names=["anchor", "key", "n"],
                )

    return docs.mapInArrow(run, "anchor long, key binary, n long")


def _blocks(batch: pa.RecordBatch, size: int):
    """(row, anchor, first word, text) of each block, or window of a hot anchor, of some texts."""
    table = byte_table()
    recurring, hot = batch.column("anchors"), batch.column("hot")
    for start, _, data, bounds in text_slices(batch.column("__text")):
        opens, ends, words, first = scan(data, bounds, table)
        windows, at, phrases = anchors_of(words, first, size)
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1]
        runs = np.flatnonzero(new)
        lasts = np.append(runs[1:], len(at))
        owners = np.searchsorted(first, at[runs], side="right") - 1
        row, known, split = -1, frozenset(), frozenset()
        for begin, end, owner, anchor in zip(
            runs.tolist(), lasts.tolist(), owners.tolist(), phrases[at[runs]].view(np.int64).tolist(), strict=True
        ):
            if owner != row:
                row = owner
                known, split = frozenset(recurring[start + row].as_py()), frozenset(hot[start + row].as_py())
            if anchor not in known:
                continue
            steps = range(begin, end) if anchor in split else (begin,)
            for step in steps:
                low = int(windows[step])
                high = int(windows[step if anchor in split else end - 1]) + size
                text = b" ".join(data[opens[low] : ends[high - 1]].tobytes().split())
                yield start + row, anchor, low - int(first[row]), text


def _block_texts(placed: DataFrame, size: int) -> DataFrame:
    """(anchor, block, n), with equal blocks of a batch added up."""

    def run(batches):
        for batch in batches:
            counts: dict[tuple[int, bytes], int] = {}
            for _, anchor, _, text in _blocks(batch, size):
                counts[anchor, text] = counts.get((anchor, text), 0) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([a for a, _ in counts], pa.int64()),
                    pa.array([b for _, b in counts], pa.binary()),
                    pa.array(list(counts.values()), pa.int64()),
                ],
                names=["anchor", "block", "n"],
            )

    return placed.mapInArrow(run, "anchor long, block binary, n long")


def _block_places(placed: DataFrame, size: int) -> DataFrame:
    """(block_id, key, places): where each block stands in a text, one row however often it does."""

    def run(batches):
        for batch in batches:
            found: dict[tuple[int, bytes], list[int]] = {}
            for row, _, place, text in _blocks(batch, size):
                found.setdefault((row, xxhash.xxh128_digest(text)), []).append(place)
            rows = pa.array([row for row, _ in found], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([x for _, x in found], pa.binary()),
                    batch.column("__key").take(rows),
                    pa.array(list(found.values()), pa.list_(pa.int64())),
                ],
                names=["block_id", "key", "places"],
            )

    return placed.mapInArrow(run, "block_id binary, key binary, places array<long>")


class Shard:
    """Blocks of some anchors: confirms their passages and locates them with an automaton."""

    def __init__(self, size: int) -> None:
        self.size = size
        self.blocks: list[tuple[list[bytes], bytes]] = []
        self.passages: set[tuple[bytes, ...]] = set()
        self.words = 0

    def add(self, group: list[tuple[bytes, int]]) -> None:
        """Take all blocks of one anchor with their counts."""
        size = self.size
        met: dict[tuple[bytes, ...], int] = {}
        split = [(block.split(b" "), block, n) for block, n in group]
        for words, _, n in split:
            for k in range(len(words) - size + 1):
                window = tuple(words[k : k + size])
                met[window] = met.get(window, 0) + n
        for words, block, _ in split:
            begin = None
            for k in range(len(words) - size + 2):
                again = k <= len(words) - size and met[tuple(words[k : k + size])] > 1
                if again and begin is None:
                    begin = k
                elif not again and begin is not None:
                    self.passages.add(tuple(words[begin : k - 1 + size]))
                    begin = None
            self.blocks.append((words, block))
            self.words += len(words)

    def located(self) -> Iterator[tuple[bytes, list[int]]]:
        """For each block that holds passages: its id and the covered words, as bounds of runs."""
        if not self.passages:
            return
        letters: dict[bytes, str] = {}
        for word in itertools.chain.from_iterable(self.passages):
            if word not in letters:
                code = len(letters) + 1
                letters[word] = chr(code if code < 0xD800 else code + 0x800)
        automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_STRING)
        for passage in self.passages:
            automaton.add_word("".join(map(letters.__getitem__, passage)), len(passage))
        automaton.make_automaton()
        for words, block in self.blocks:
            text = "".join([letters.get(w, "\0") for w in words])
            runs: list[int] = []
            for end, length in sorted((e + 1, n) for e, n in automaton.iter(text)):
                begin = end - length
                while runs and begin <= runs[-1]:
                    begin = min(begin, runs[-2])
                    del runs[-2:]
                runs += [begin, end]
            if runs:
                yield xxhash.xxh128_digest(block), runs


def _located(blocks: DataFrame, size: int, shard_words: int) -> DataFrame:
    """(block_id, runs) of the blocks that hold repeating windows."""
    counted = blocks.groupBy("anchor", "split", "block").agg(F.sum("n").alias("n"))
    dealt = counted.repartition("anchor", "split").sortWithinPartitions("anchor", "split")

    def run(batches):
        shard, key, group = Shard(size), None, []

        def emit(full: Shard) -> pa.RecordBatch:
            found = list(full.located())
            return pa.RecordBatch.from_arrays(
                [pa.array([b for b, _ in found], pa.binary()), pa.array([r for _, r in found], pa.list_(pa.int32()))],
                names=["block_id", "runs"],
            )

        for batch in batches:
            for anchor, split, block, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (anchor, split) != key:
                    shard.add(group)
                    key, group = (anchor, split), []
                    if shard.words >= shard_words:
                        yield emit(shard)
                        shard = Shard(size)
                group.append((block, n))
        shard.add(group)
        yield emit(shard)

    return dealt.select("anchor", "split", "block", "n").mapInArrow(run, "block_id binary, runs array<int>")


def remove_repeats(
    docs: DataFrame,
    size: int = SIZE,
    name: str = "repeats",
    keep: list[str] | None = None,
    hot_anchor: int = HOT_ANCHOR,
    shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """Add a report to each document: its words, those removed, and the rest joined by spaces.

    ``keep`` lists the columns to carry along; an older column of the new one's name is replaced.
    """
    kept = [c for c in (docs.columns if keep is None else keep) if c != name]
    small_batches(docs.sparkSession)
    stage = Stage(docs.sparkSession)
    # every join below shuffles these very columns, so that they are shuffled once
    keyed = docs.select(text_key().alias("__key"), F.coalesce("text", F.lit("")).alias("__text"), *kept)
    anchors = _anchor_rows(keyed.select("__key", "__text"), size)
    often = anchors.groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    hits = (
        anchors.join(often.withColumnRenamed("n", "often"), "anchor")
        .groupBy("key")
        .agg(
            F.collect_set("anchor").alias("anchors"),
            F.collect_set(F.when(F.col("often") > hot_anchor, F.col("anchor"))).alias("hot"),
        )
    )
    hits = stage.write(hits, "hits")
    placed = keyed.join(hits.withColumnRenamed("key", "__key"), "__key")
    texts = _block_texts(placed, size)
    hot = hits.select(F.explode("hot").alias("anchor")).distinct().withColumn("is_hot", F.lit(True))
    texts = texts.join(hot, "anchor", "left").select(
        "anchor", F.when(F.col("is_hot"), F.xxhash64("block")).otherwise(0).alias("split"), "block", "n"
    )
    located = _located(texts, size, shard_words)
    runs = (
        _block_places(placed, size)
        .distinct()
        .join(located, "block_id")
        .select("key", F.flatten(F.transform("places", lambda p: F.transform("runs", lambda x: x + p))).alias("runs"))
        .groupBy("key")
        .agg(F.flatten(F.collect_list("runs")).alias("runs"))
    )
    runs = runs.select(F.col("key").alias("__key"), F.col("runs").alias("__runs"))
    marked = keyed.join(runs, "__key", "left")
    return _cut(marked, kept, name)


def _cut(marked: DataFrame, kept: list[str], name: str) -> DataFrame:
    sent = marked.select(*kept, "__text", "__runs")
    schema = T.StructType([*[sent.schema[c] for c in kept], T.StructField(name, REPORT)])

    def run(batches):
        table = byte_table()
        for batch in batches:
            runs = batch.column("__runs")
            counts, removed, texts = [], [], []
            for start, stop, data, bounds in text_slices(batch.column("__text")):
                opens, ends, _, first = scan(data, bounds, table)
                for i in range(start, stop):
                    low, high = int(first[i - start]), int(first[i - start + 1])
                    gone = np.zeros(high - low + 1, np.int64)
                    if (own := runs[i].as_py()) is not None:
                        own = np.array(own).reshape(-1, 2)
                        np.add.at(gone, own[:, 0], 1)
                        np.add.at(gone, own[:, 1], -1)
                    left = np.flatnonzero(np.cumsum(gone[:-1]) == 0) + low
                    counts.append(high - low)
                    removed.append(high - low - len(left))
                    if len(left) == high - low:
                        whole = data[bounds[i - start] : bounds[i - start + 1]].tobytes().split()
                    else:
                        whole = [data[a:b].tobytes() for a, b in zip(opens[left], ends[left], strict=True)]
                    texts.append(b" ".join(whole).decode())
            made = pa.StructArray.from_arrays(
                [pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(texts, pa.string())],
                names=REPORT.names,
            )
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], made], names=[*kept, name]
            )

    return sent.mapInArrow(run, schema)


def without_repeats(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """The documents with repeated passages cut out of ``text``; ``n_chars`` follows it.

    A text that loses nothing stays as it is.
    """
    marked = remove_repeats(docs, size, "repeats_report")
    changed = F.col("repeats_report.n_removed") > 0
    columns = {"text": F.when(changed, F.col("repeats_report.kept")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        length = F.length("repeats_report.kept").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(changed, length).otherwise(F.col("n_chars"))
    return marked.withColumns(columns).select(*docs.columns)
