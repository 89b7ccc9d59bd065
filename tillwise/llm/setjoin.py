"""N-gram Jaccard join: which documents share most of their word shingles.

A size-aware heavy-light join on sets of distinct shingles, exact at its threshold. All shingles
have one order, the rarer first (by a table of counts over all documents, of bounded size; what
it cannot tell apart is ordered by hash). Of two sets that share c shingles, the first
``size - c + k`` of each in that order share k of them. So

* a set of the light kind enumerates the fixed-size subsets (pairs) of the first
  ``size - c + 2``: two light sets that are linked have a pair in common;
* a set of the heavy kind, and any light set that can be linked with one, is entered in the
  inverted lists of its first ``size - c + 1`` shingles.

The size at which sets become heavy is chosen by the expected number of rows. Lists are then
read shingle by shingle: short ones give all their pairs, long ones link each set with the
list's first and are kept (of these pairs each set verifies two). Pairs that bit signatures
cannot rule out are verified on whole sets, components are labelled, and the long lists that
still hold several components are gone through again: first each set outside a list's largest
component meets some inside, then the nearest, then all pairs between components are looked at. Sets that are equal are one class
throughout. No list is cut short. The first reading of a list of n sets makes no n * n rows; when it
is gone through again, strong sets of different components cost a row for each pair that signatures leave.

Two linked sets meet in the list of their first common shingle, and what they share begins there.
So the smaller one stands *strong* in it: what follows in its own order is enough for a link. Two
sets that both stand weak in a list are never compared for it, and a list without a strong set is
not gone through again. Documents that share boilerplate, but too little for a link, stand weak in
the lists of the boilerplate. A list is gone through in blocks of bounded size, each block of one
side against each block of the other as a task's group of its own.

Defined results: a null, empty or wordless text has no shingles and is linked with nothing; a
text of fewer words than a shingle is one shingle; equal texts, repeated rows included, are one
component; a component of null ids alone has a null id; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillwise.llm.components import label_components
from tillwise.llm.frames import byte_table, mix, scan, small_batches, text_slices, window_hashes
from tillwise.staging import Stage

#: Words in a shingle, and the least similarity in hundredths.
WORDS, LIKE = 5, 75
#: Lists up to this length give all their pairs.
SHORT_LIST = 2
#: A list expected to be longer than this is dealt out over several tasks.
SPLIT_LIST = 16384
#: A set outside its lists' largest components, where these have LARGE sets or more, first meets
#: so many sets inside, then the nearest of each list, by signatures folded to NARROW bytes.
STAR_SETS, LARGE, NARROW = 12, 4, 64
#: Sets of a block when a list is gone through again, and the bytes their signatures are folded to.
BLOCK_SETS, WIDE = 2048, 8192
#: Lists of a set that its rows name, so that few pairs come from several lists.
NAMED = 32
#: Largest size that may count as light.
LIGHT_LIMIT = 64
#: Counters, as a power of two, at most: a broadcast of 16 MB.
MOST_BITS = 24
_BLOCK = 1 << 16
_SECOND = np.uint64(0xA0761D6478BD642F)


def shingle_sets(column: pa.Array, words: int = WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """The position and the sorted distinct shingle hashes of each text."""
    table = byte_table(lower=True)
    for first, last, data, bounds in text_slices(column):
        _, _, hashes, at = scan(data, bounds, table)
        for i in range(first, last):
            own = hashes[at[i - first] : at[i - first + 1]]
            if len(own):
                yield i, np.unique(window_hashes(own, min(words, len(own))))
            else:
                yield i, own


def class_of(shingles: np.ndarray) -> int:
    """A hash of a whole set, as a signed 64-bit number."""
    total = np.add.reduce(mix(shingles ^ _SECOND)) + np.uint64(len(shingles))
    return int(mix(np.array([total], np.uint64)).view(np.int64)[0])


def signature(shingles: np.ndarray) -> bytes:
    """Parities: each shingle flips one bit of a table of at least twice as many bits as shingles."""
    bits = max(64, 2 << max(0, len(shingles) - 1).bit_length())
    places = ((shingles * _SECOND) >> np.uint64(64 - bits.bit_length() + 1)).astype(np.int64)
    return np.packbits(np.bincount(places, minlength=bits).astype(np.uint8) & 1).tobytes()


def may_link(size_a, bits_a, size_b, bits_b, like: int = LIKE) -> bool:
    """False only if the signatures prove that two sets are less similar than ``like``.

    What both sets hold flips the same bits in both, so each bit that differs stands for a shingle
    that one set alone holds; only such shingles that meet in a bit hide each other.
    """
    if 100 * min(size_a, size_b) < like * max(size_a, size_b):
        return False
    a, b = np.frombuffer(bits_a, np.uint8), np.frombuffer(bits_b, np.uint8)
    while len(a) > len(b):  # bits are numbered by leading hash bits, so neighbours fold together
        a = fold(a)
    while len(b) > len(a):
        b = fold(b)
    apart = int(np.bitwise_count(a ^ b).sum())
    return apart * (100 + like) <= (100 - like) * (size_a + size_b)


def fold(bits: np.ndarray) -> np.ndarray:
    table = np.unpackbits(bits)
    return np.packbits(table[0::2] ^ table[1::2])


def _sum_tables(rows: DataFrame, bits: int, levels: bool) -> bytes:
    """Add up blocks of counters over all tasks; the result has 2**bits bytes."""

    def run(batches):
        block, total = None, np.zeros(_BLOCK, np.int64)

        def done():
            shown = np.rint(8 * np.log2(1 + total)) if levels else total
            return pa.RecordBatch.from_pydict(
                {"block": pa.array([block], pa.int32()), "counts": [np.minimum(shown, 255).astype(np.uint8).tobytes()]}
            )

        for batch in batches:
            for i, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if block is not None and i != block:
                    yield done()
                    total[:] = 0
                block = i
                total += np.frombuffer(zlib.decompress(data.as_buffer()), np.uint8)
        if block is not None:
            yield done()

    dealt = rows.repartition(F.col("block")).sortWithinPartitions("block")
    out = np.zeros(1 << bits, np.uint8)
    for row in dealt.mapInArrow(run, "block int, counts binary").collect():
        out[row.block * _BLOCK : (row.block + 1) * _BLOCK] = np.frombuffer(row.counts, np.uint8)
    return out.tobytes()


def _tables_of(batches, bits: int) -> Iterator[pa.RecordBatch]:
    """One task's counters of some hashes, in blocks; a counter stops at 255."""
    total = np.zeros(1 << bits, np.uint8)
    for hashes in batches:
        found, times = np.unique((hashes >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
        total[found] = np.minimum(total[found] + times, 255)
    for block in range(len(total) // _BLOCK):
        part = total[block * _BLOCK : (block + 1) * _BLOCK]
        if part.any():
            yield pa.RecordBatch.from_pydict(
                {"block": pa.array([block], pa.int32()), "counts": [zlib.compress(part, 1)]}
            )


def shingle_levels(docs: DataFrame, words: int, bits: int) -> bytes:
    """How frequent the shingles of each counter are, over all documents, on a scale of bytes."""

    def run(batches):
        sets = (s for batch in batches for _, s in shingle_sets(batch.column(0), words))
        yield from _tables_of(sets, bits)

    return _sum_tables(docs.select("text").mapInArrow(run, "block int, counts binary"), bits, True)


def prefix_length(size: int, like: int, k: int) -> int:
    """Shingles, in the common order, among which linked sets share k at least."""
    return size - -(-like * size // 100) + k


def stands_strong(size: int, before: np.ndarray, like: int) -> np.ndarray:
    """Whether a set, less so many shingles, can still share enough with one of its size or more."""
    return (size - before) * (100 + like) >= 2 * like * size


def light_limit(sizes: dict[int, int], list_length: float, like: int) -> int:
    """The largest light size with the fewest expected rows.

    ``sizes`` counts the sets of each size up to LIGHT_LIMIT; each row of an inverted list is
    expected to meet ``list_length`` others, a row of an enumerated pair none.
    """

    def cost(limit: int) -> float:
        light = sum(n * math.comb(prefix_length(s, like, 2), 2) for s, n in sizes.items() if 2 <= s <= limit)
        heavy = sum(n * prefix_length(s, like, 1) for s, n in sizes.items() if 100 * s > like * limit)
        return light + heavy * (1 + list_length)

    return min(range(LIGHT_LIMIT + 1), key=cost)


def _postings(
    docs: DataFrame, shared, bits: int, limit: int, words: int, like: int, split: int
) -> DataFrame:
    """Rows (token, place, class) of the inverted lists and of the enumerated pairs.

    ``place`` is twice the salt, and one more where the set stands strong.
    """

    def run(batches):
        levels = np.frombuffer(shared.value, np.uint8)
        split_at = 8 * math.log2(1 + split)
        for batch in batches:
            tokens, classes, places, met = [], [], [], set()
            for _, own in shingle_sets(batch.column(0), words):
                size = len(own)
                if size < 2 or (cls := class_of(own)) in met:
                    continue
                met.add(cls)
                level = levels[own >> np.uint64(64 - bits)]
                order = np.argsort(level, kind="stable")
                if size <= limit:
                    first = own[order[: prefix_length(size, like, 2)]]
                    left, right = np.triu_indices(len(first), 1)
                    pair = np.sort(np.stack([first[left], first[right]]), axis=0)
                    tokens.append(mix(pair[0] * _SECOND + pair[1]))
                    places.append(-2 + stands_strong(size, right - 1, like))
                    classes.append(np.full(len(left), cls, np.int64))
                if 100 * size > like * limit:
                    first = order[: prefix_length(size, like, 1)]
                    tokens.append(own[first])
                    shares = np.ceil(2 ** (np.maximum(level[first] - split_at, 0) / 8)).astype(np.int64)
                    salts = np.where(shares > 1, np.int64(cls) % shares, -1)
                    places.append(2 * salts + stands_strong(size, np.arange(len(first)), like))
                    classes.append(np.full(len(first), cls, np.int64))
            if tokens:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(tokens).view(np.int64)),
                        pa.array(np.concatenate(places).astype(np.int32)),
                        pa.array(np.concatenate(classes)),
                    ],
                    names=["token", "place", "cls"],
                )

    return docs.select("text").mapInArrow(run, "token long, place int, cls long")


class ListReader:
    """Reads sorted postings and keeps no more of a list than its first few rows."""

    def __init__(self) -> None:
        self.key, self.held, self.last, self.kept = None, [], None, False

    def short_pairs(self) -> list[tuple[None, int, int, None]]:
        pairs = [] if self.kept else itertools.combinations([cls for cls, _ in self.held], 2)
        return [(None, a, b, None) for a, b in pairs]

    def read(self, tokens: np.ndarray, places: np.ndarray, classes: np.ndarray) -> list[tuple]:
        """Pairs (None, a, b, None) of short lists; the rows (token, class, first class, strong) of others."""
        n, salts, strong = len(tokens), places >> 1, (places & 1).astype(bool)
        new = np.ones(n, bool)
        new[1:] = (tokens[1:] != tokens[:-1]) | (salts[1:] != salts[:-1])
        starts = np.flatnonzero(new)
        ends = np.append(starts[1:], n)
        # a whole list of one row, neither the batch's first nor its last, has no partner
        alone = (ends - starts == 1) & (salts[starts] < 0)
        alone[[0, -1]] = False
        out: list[tuple] = []
        for start, end in zip(starts[~alone].tolist(), ends[~alone].tolist(), strict=True):
            key = (int(tokens[start]), int(salts[start]))
            if key != self.key:
                out.extend(self.short_pairs())
                self.key, self.held, self.last, self.kept = key, [], None, key[1] >= 0
            for cls, stands in zip(classes[start:end].tolist(), strong[start:end].tolist(), strict=True):
                if cls == self.last:
                    continue
                self.last = cls
                if len(self.held) < SHORT_LIST:
                    self.held.append((cls, stands))
                    if not self.kept:
                        continue
                elif not self.kept:
                    self.kept = True
                    out.extend((key[0], x, self.held[0][0], s) for x, s in self.held)
                out.append((key[0], cls, self.held[0][0], stands))
        return out


def _read_lists(postings: DataFrame) -> DataFrame:
    schema = "token long, a long, b long, strong boolean"
    arrow = pa.schema([("token", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("strong", pa.bool_())])
    salt = F.shiftright("place", 1)

    def run(batches):
        reader = ListReader()
        for batch in batches:
            if batch.num_rows:
                rows = reader.read(*(c.to_numpy() for c in batch.columns))
                yield _rows(list(dict.fromkeys(rows)), arrow)
        yield _rows(reader.short_pairs(), arrow)

    dealt = postings.repartition("token", salt).sortWithinPartitions("token", salt, "cls", F.desc("place"))
    return dealt.mapInArrow(run, schema)


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[] for _ in schema]
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def _described(docs: DataFrame, words: int) -> DataFrame:
    """Each document's id, class, set size and signature."""

    def run(batches):
        for batch in batches:
            sets = [s for _, s in shingle_sets(batch.column(1), words)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([class_of(s) if len(s) else None for s in sets], pa.int64()),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([signature(s) if len(s) else None for s in sets], pa.binary()),
                ],
                names=["doc_id", "cls", "size", "bits"],
            )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, cls long, size long, bits binary"
    )


def _not_ruled_out(pairs: DataFrame, classes: DataFrame, like: int) -> DataFrame:
    """The pairs (a, b) that the signatures leave."""
    side = lambda x: classes.select(
        F.col("cls").alias(x), F.col("size").alias(f"size_{x}"), F.col("bits").alias(f"bits_{x}")
    )

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("size_a", "bits_a", "size_b", "bits_b")), strict=True)
            yield batch.filter(pa.array([may_link(*r, like) for r in rows], pa.bool_())).select(["a", "b"])

    joined = pairs.join(side("a"), "a").join(side("b"), "b")
    sized = joined.where(F.lit(100) * F.least("size_a", "size_b") >= F.lit(like) * F.greatest("size_a", "size_b"))
    return sized.select("a", "b", "size_a", "bits_a", "size_b", "bits_b").mapInArrow(run, "a long, b long")


def _texts(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """One text for each wanted class (cls, text).

    A bit table of the wanted classes, of bounded size, keeps most other texts from being
    shuffled; the join decides.
    """
    bits = 22

    def mark(batches):
        yield from _tables_of((b.column(0).to_numpy().view(np.uint64) for b in batches), bits)

    table = docs.sparkSession.sparkContext.broadcast(
        _sum_tables(wanted.mapInArrow(mark, "block int, counts binary"), bits, False)
    )

    def run(batches):
        wanted_here = np.frombuffer(table.value, np.uint8)
        met: set[int] = set()
        for batch in batches:
            found = {i: class_of(s) for i, s in shingle_sets(batch.column(0), words) if len(s)}
            keep = [
                i for i, c in found.items()
                if wanted_here[(c & (1 << 64) - 1) >> (64 - bits)] and c not in met
            ]
            keep = list({found[i]: i for i in keep}.values())
            if len(met) < 100_000:
                met.update(found[i] for i in keep)
            yield pa.RecordBatch.from_arrays(
                [pa.array([found[i] for i in keep], pa.int64()), batch.column(0).take(pa.array(keep, pa.int64()))],
                names=["cls", "text"],
            )

    return (
        docs.select("text").mapInArrow(run, "cls long, text string")
        .join(wanted, "cls", "left_semi")
        .groupBy("cls").agg(F.min("text").alias("text"))
    )


def _verified(pairs: DataFrame, texts: DataFrame, words: int, like: int) -> DataFrame:
    """The pairs whose whole sets are similar enough; ``texts`` has a text of each class."""

    def run(batches):
        held: tuple[int | None, np.ndarray | None] = (None, None)
        for batch in batches:
            keep = []
            second = shingle_sets(batch.column("text_b"), words)
            for i, (a, (_, right)) in enumerate(zip(batch.column("a").to_pylist(), second, strict=True)):
                if a != held[0]:
                    held = a, next(shingle_sets(batch.column("text_a").slice(i, 1), words))[1]
                both = len(np.intersect1d(held[1], right, assume_unique=True))
                if 100 * both >= like * (len(held[1]) + len(right) - both):
                    keep.append(i)
            yield batch.select(["a", "b"]).take(pa.array(keep, pa.int64()))

    first = texts.select(F.col("cls").alias("a"), F.col("text").alias("text_a"))
    second = texts.select(F.col("cls").alias("b"), F.col("text").alias("text_b"))
    joined = pairs.join(second, "b").join(first, "a")
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(run, "a long, b long")


class Rest:
    """Some sets of one list, to be met by others."""

    def __init__(self, rows: list[dict]) -> None:
        self.rows, self.by_width = rows, {}
        for width in {len(r["bits"]) for r in rows}:
            own = [i for i, r in enumerate(rows) if len(r["bits"]) == width]
            bits = np.frombuffer(b"".join(rows[i]["bits"] for i in own), np.uint8)
            self.by_width[width] = (
                np.array(own), np.array([rows[i]["size"] for i in own]), bits.reshape(len(own), width),
                np.array([rows[i].get("label", 0) for i in own], np.int64),
            )

    def near(self, row: dict, like: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Numbers of those of other labels not ruled out as linked with ``row``, and the share that differs."""
        for own, sizes, bits, labels in self.by_width.values():
            mine = np.frombuffer(row["bits"], np.uint8)
            fits = 100 * np.minimum(sizes, row["size"]) >= like * np.maximum(sizes, row["size"])
            if "label" in row:
                fits &= labels != row["label"]
            if not fits.any():
                continue
            own, sizes, bits = own[fits], sizes[fits], bits[fits]
            while len(mine) > bits.shape[1]:
                mine = fold(mine)
            while bits.shape[1] > len(mine):
                table = np.unpackbits(bits, axis=1)
                bits = np.packbits(table[:, 0::2] ^ table[:, 1::2], axis=1)
            apart = np.bitwise_count(bits ^ mine).sum(axis=1, dtype=np.int64)
            left = apart * (100 + like) <= (100 - like) * (sizes + row["size"])
            yield own[left], (apart / (sizes + row["size"]))[left]

    def rows_near(self, row: dict, like: int) -> Iterator[dict]:
        for own, _ in self.near(row, like):
            yield from (self.rows[i] for i in own.tolist())


class Nearest:
    """Finds, for each set outside a list's largest component, the nearest one inside."""

    def __init__(self, outside: list[dict]) -> None:
        self.rest, self.cls = Rest(outside), [r["cls"] for r in outside]
        self.apart, self.found = np.full(len(outside), np.inf), np.zeros(len(outside), np.int64)

    def meet(self, row: dict, like: int) -> None:
        for own, apart in self.rest.near(row, like):
            closer = apart < self.apart[own]
            self.apart[own[closer]], self.found[own[closer]] = apart[closer], row["cls"]

    def offers(self) -> list[tuple[int, int, float]]:
        """(outside, inside, share that differs)."""
        rows = zip(self.cls, self.found.tolist(), self.apart.tolist(), strict=True)
        return [r for r in rows if math.isfinite(r[2])]

    def pairs(self) -> list[tuple[int, int]]:
        return [(min(a, b), max(a, b)) for a, b, _ in self.offers()]


def narrow(bits: bytes, width: int = NARROW) -> bytes:
    """A signature folded to so many bytes or fewer."""
    table = np.frombuffer(bits, np.uint8)
    while len(table) > width:
        table = fold(table)
    return table.tobytes()


def _mixed_lists(lists: DataFrame, labels: DataFrame, stage: Stage) -> DataFrame:
    """The rows (token, cls, strong, label, main) of lists that hold several components.

    ``main`` marks the rows of a list's largest component. Lists without a strong set have no
    pairs of their own.
    """
    placed = lists.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select(
        "token", "cls", "strong", F.coalesce("label", "cls").alias("label")
    )
    counted = placed.groupBy("token", "label").agg(F.count("*").alias("count"), F.max("strong").alias("strong"))
    mixed = (
        counted.groupBy("token")
        .agg(F.max(F.struct("count", "label")).alias("most"), F.count("*").alias("n"), F.max("strong").alias("strong"))
        .where("n > 1 and strong")
        .select("token", F.col("most.label").alias("largest"), (F.col("most.count") >= LARGE).alias("large"))
    )
    return stage.write(
        placed.join(mixed, "token").select(
            "token", "cls", "strong", "label", (F.col("label") == F.col("largest")).alias("main"), "large"
        ),
        "mixed",
    )


def _to_largest(mixed: DataFrame) -> DataFrame:
    """Pairs (a, b) of each set outside its lists' largest components with some sets inside.

    Each list offers one set, chosen by a hash, and STAR_SETS of those offered are met.
    """
    lists = mixed.where("large")
    inside = lists.where("main").groupBy("token").agg(F.min(F.struct(F.xxhash64("cls", "token"), "cls"))["cls"].alias("a"))
    outside = lists.where("not main").select("token", F.col("cls").alias("b"))
    offered = outside.join(inside, "token").groupBy("b").agg(F.array_sort(F.collect_set("a")).alias("a"))
    return _ordered(offered.select("b", F.explode(F.slice("a", 1, STAR_SETS)).alias("a")))


def _narrowed(classes: DataFrame, width: int) -> DataFrame:
    """Each class's size and folded signature."""

    def run(batches):
        for batch in batches:
            bits = pa.array([narrow(x, width) for x in batch.column("bits").to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), bits], names=["cls", "size", "bits"])

    return classes.select("cls", "size", "bits").mapInArrow(run, "cls long, size long, bits binary")


#: What a set does in a group: it is met, it is held and meets those, or both.
_MET, _HELD, _BOTH = 0, 1, 2


def _dealt(mixed: DataFrame, block: int, among: bool) -> DataFrame:
    """Rows (token, kind, i, j, role) of the groups in which sets of one list meet.

    The sets outside the largest component meet those inside, and each other if ``among``; not
    two weak ones. A list of up to ``block`` sets is one group. In others the strong sets outside
    (kind 1) meet all, and the weak ones (kind 2) the strong ones inside, block by block.
    """
    counts = mixed.groupBy("token").agg(
        F.count("*").alias("n"),
        F.count_if(F.expr("true" if among else "main")).alias("met"),
        F.count_if(F.expr("not main and strong")).alias("leads"),
        F.count_if(F.expr("not main and not strong")).alias("rest"),
        F.count_if(F.expr("main and strong")).alias("firm"),
    )
    blocks = lambda n: F.ceil(F.col(n) / F.lit(block)).cast("int")
    place = lambda n: F.pmod(F.xxhash64("cls"), F.greatest(blocks(n), F.lit(1))).cast("int")
    group = lambda kind, i, j, role: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), F.lit(role).alias("role")
    )
    over = lambda n, make: F.transform(F.sequence(F.lit(0), blocks(n) - 1), make)
    nothing = F.array().cast("array<struct<kind:int,i:int,j:int,role:int>>")
    when = lambda condition, groups: F.when(F.expr(condition), groups).otherwise(nothing)
    zero, met = F.lit(0), "" if among else "main and "
    small, large = f"n <= {block} and ", f"n > {block} and "
    groups = F.concat(
        when(small + "not main", F.array(group(0, zero, zero, _BOTH if among else _HELD))),
        when(small + "main and (strong or leads > 0)", F.array(group(0, zero, zero, _MET))),
        when(large + "not main and strong and met > 0", over("met", lambda j: group(1, place("leads"), j, _HELD))),
        when(large + met + "leads > 0", over("leads", lambda i: group(1, i, place("met"), _MET))),
        when(large + "not main and not strong and firm > 0", over("firm", lambda j: group(2, place("rest"), j, _HELD))),
        when(large + "main and strong and rest > 0", over("rest", lambda i: group(2, i, place("firm"), _MET))),
    )
    placed = mixed.join(counts, "token").select("token", "cls", "label", "main", "strong", F.explode(groups).alias("g"))
    return placed.select("token", "g.*", "cls", "label", "main", "strong")


class Meeting:
    """One group: the sets it holds, and those that meet them."""

    def __init__(self, kind: int) -> None:
        self.kind, self.held, self.sides = kind, [], None

    def sides_of(self, make) -> tuple:
        """The strong and the weak sets held, each as ``make`` has it."""
        if self.sides is None:
            self.sides = tuple(make([r for r in self.held if r["strong"] is x]) for x in (True, False))
        return self.sides

    def pairs(self, row: dict, like: int) -> Iterator[tuple[int, int]]:
        """The pairs of ``row`` with the sets held; a pair that is met from both sides comes once.

        A pair is left to the list before this one in which, as both sets name it, they meet too.
        """
        strong, weak = self.sides_of(Rest)
        twice = not row["main"] and (self.kind == 0 or row["strong"])
        before = {t for t in row["named"] if t < row["token"]}
        for rest in (strong, weak) if row["strong"] else (strong,):
            for r in rest.rows_near(row, like):
                if r["cls"] != row["cls"] and not (twice and r["cls"] > row["cls"]) and before.isdisjoint(r["named"]):
                    yield min(r["cls"], row["cls"]), max(r["cls"], row["cls"])


def _groups(mixed: DataFrame, classes: DataFrame, block: int, among: bool, width: int) -> DataFrame:
    """The rows of ``_dealt`` with sizes and signatures, group by group, those held first."""
    dealt = _dealt(mixed, block, among)
    named = F.array_sort(F.collect_set(F.when(F.col("strong"), F.col("token")))) if among else F.array().cast("array<long>")
    own = mixed.groupBy("cls").agg(F.slice(named, 1, NAMED).alias("named"))
    own = own.join(_narrowed(classes.join(own, "cls", "left_semi"), width), "cls")
    return (
        dealt.join(own, "cls")
        .select("token", "kind", "i", "j", "role", "main", "strong", "cls", "label", "size", "bits", "named")
        .repartition("token", "kind", "i", "j")
        .sortWithinPartitions("token", "kind", "i", "j", F.desc("role"), "cls")
    )


def _meetings(batches) -> Iterator[tuple[Meeting, dict | None]]:
    """Each group's sets that meet those it holds, and at its end None."""
    key, meeting = None, None
    for batch in batches:
        for row in batch.to_pylist():
            if (new := (row["token"], row["kind"], row["i"], row["j"])) != key:
                if meeting:
                    yield meeting, None
                key, meeting = new, Meeting(row["kind"])
            if row["role"] == _MET:
                yield meeting, row
            else:
                meeting.held.append(row)
    if meeting:
        yield meeting, None


def _to_nearest(mixed: DataFrame, classes: DataFrame, like: int, block: int = BLOCK_SETS) -> DataFrame:
    """Pairs (a, b) of each set outside its lists' largest components with the nearest inside.

    Each list offers the set whose folded signature differs least.
    """
    rows = _groups(mixed.where("large"), classes, block, False, NARROW)

    def run(batches):
        out = []
        for meeting, row in _meetings(batches):
            strong, weak = meeting.sides_of(Nearest)
            if row:
                strong.meet(row, like)
                if row["strong"]:
                    weak.meet(row, like)
                continue
            token = meeting.held[0]["token"] if meeting.held else None
            out += [(token, *x) for side in (strong, weak) for x in side.offers()]
            if len(out) >= _MANY:
                yield _rows(out, _OFFER)
                out = []
        yield _rows(out, _OFFER)

    offers = rows.mapInArrow(run, "token long, b long, a long, apart double")
    return _ordered(offers.groupBy("token", "b").agg(F.min(F.struct("apart", "a"))["a"].alias("a")))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _between(mixed: DataFrame, classes: DataFrame, like: int, block: int = BLOCK_SETS) -> DataFrame:
    """The pairs of sets in one list but in different components that may be linked.

    A list's largest component meets only the rest of it.
    """
    rows = _groups(mixed, classes, block, True, WIDE)

    def run(batches):
        out: set[tuple[int, int]] = set()
        for meeting, row in _meetings(batches):
            for one in [row] if row else [r for r in meeting.held if r["role"] == _BOTH]:
                out.update(meeting.pairs(one, like))
                if len(out) >= _MANY:
                    yield _rows(list(out), _PAIR)
                    out = set()
        yield _rows(list(out), _PAIR)

    return rows.mapInArrow(run, "a long, b long").distinct()


_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_OFFER = pa.schema([("token", pa.int64()), ("b", pa.int64()), ("a", pa.int64()), ("apart", pa.float64())])
#: Rows after which a batch is handed on.
_MANY = 65536


def jaccard_components(
    docs: DataFrame,
    words: int = WORDS,
    like: int = LIKE,
    split_list: int = SPLIT_LIST,
    block: int = BLOCK_SETS,
) -> DataFrame:
    """Every document's set size and component: (doc_id, n_shingles, component_id)."""
    spark = docs.sparkSession
    small_batches(spark)
    stage = Stage(spark)
    total = docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    bits = min(MOST_BITS, max(16, math.ceil(math.log2(max(total, 1) / 48 + 1))))
    levels = shingle_levels(docs, words, bits)
    described = stage.write(_described(docs, words), "described")
    classes = stage.write(
        described.where("size > 0").groupBy("cls").agg(
            F.min("doc_id").alias("doc_id"), F.max("size").alias("size"), F.max("bits").alias("bits")
        ),
        "classes",
    )
    small = classes.where(F.col("size") <= LIGHT_LIMIT).groupBy("size").count()
    counts = 2.0 ** (np.frombuffer(levels, np.uint8) / 8) - 1
    length = float((counts * counts).sum() / max(counts.sum(), 1)) - 1
    limit = light_limit({r["size"]: r["count"] for r in small.collect()}, max(length, 0), like)
    shared = spark.sparkContext.broadcast(levels)
    postings = _postings(docs, shared, bits, limit, words, like, split_list)
    found = stage.write(_read_lists(postings), "found")
    classes = classes.select("cls", "size", "bits", "doc_id")
    sketches = classes.drop("doc_id")
    lists = found.where("token is not null").groupBy("token", F.col("a").alias("cls")).agg(F.max("strong").alias("strong"))
    firsts = found.where("token is not null").groupBy(F.col("a").alias("b"))
    pairs = _ordered(
        found.where("token is null").select("a", "b")
        .union(firsts.agg(F.min("b").alias("a")).select("a", "b"))
        .union(firsts.agg(F.max("b").alias("a")).select("a", "b"))
    )
    pairs = stage.write(_not_ruled_out(pairs, sketches, like), "pairs")
    wanted = lists.select("cls").union(pairs.select("a")).union(pairs.select("b")).distinct()
    texts = stage.write(_texts(docs, stage.write(wanted, "wanted"), words), "texts")
    links = stage.write(_verified(pairs, texts, words, like), "links")
    labels = label_components(links, stage)
    for step in ("largest", "nearest", "all"):
        mixed = _mixed_lists(lists, labels, stage)
        if step == "all":
            more = _between(mixed, sketches, like, block)
        else:
            more = _to_largest(mixed) if step == "largest" else _to_nearest(mixed, sketches, like, block)
            more = _not_ruled_out(more, sketches, like)
        more = stage.write(more.join(pairs, ["a", "b"], "left_anti"), "more")
        if not more.isEmpty():
            new = stage.write(_verified(more, texts, words, like), "links")
            pairs, links = pairs.union(more), links.union(new)
            labels = label_components(links, stage)
    named = classes.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select(
        "cls", "doc_id", F.coalesce("label", "cls").alias("label")
    )
    smallest = named.groupBy("label").agg(F.min("doc_id").alias("component"))
    of_class = named.join(smallest, "label").select("cls", "component")
    return described.join(of_class, "cls", "left").select(
        "doc_id",
        F.col("size").alias("n_shingles"),
        F.when(F.col("size") == 0, F.col("doc_id")).otherwise(F.col("component")).alias("component_id"),
    )


def keep_one_of_each(docs: DataFrame, words: int = WORDS, like: int = LIKE) -> DataFrame:
    """One document of each group: the one with the smallest id, nulls last, then the smallest text.

    Of rows equal in id and text one stays, chosen by its other columns. Documents without words
    are linked with nothing and all stay.
    """
    stage = Stage(docs.sparkSession)
    # one read decides the place of each row for both sides of the join
    placed = stage.write(docs.withColumn("__place", F.monotonically_increasing_id()), "placed")
    found = jaccard_components(placed.select(F.col("__place").alias("doc_id"), "text"), words, like)
    groups = found.where("n_shingles > 0").select(F.col("doc_id").alias("__place"), F.col("component_id").alias("__group"))
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = F.struct(
        F.col("doc_id").isNull().alias("none"), "doc_id", F.sha2("text", 256).alias("text"),
        F.xxhash64(*others).alias("others") if others else F.lit(0).alias("others"), "__place",
    )
    least = (
        placed.select("__place", order.alias("__order"))
        .join(groups, "__place")
        .groupBy("__group").agg(F.min("__order")["__place"].alias("__place"))
    )
    wordless = found.where("n_shingles = 0").select(F.col("doc_id").alias("__place"))
    stays = least.select("__place").union(wordless)
    return placed.join(stays, "__place", "left_semi").select(docs.columns)
