"""Document fingerprints: one-permutation MinHash of word shingles, in DataFrame functions only.

A text's words, lower-cased, give shingles of WORDS words, each hashed once. The leading bits of
a hash choose one of BINS bins, which keeps its least hash. An empty bin is densified: it takes
the value of a full one, the full bin whose hash together with the empty one's number is least,
so that every empty bin chooses for itself and alike in every text that fills the same bins. The
low 8 bits of the bins are packed into a hex string.

Two fingerprints agree in a share of bins; as 8 bits agree by chance once in 256, the likeness
is that share corrected for it, from 0 to 1.

Defined results: a null text is the empty one; a text without words has an empty fingerprint,
alike with none but an empty one (likeness 1); fewer words than a shingle are one shingle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillwise.llm.frames import text_key
from tillwise.staging import Stage

WORDS, BINS = 5, 128
_BIN_SHIFT = 57  # 64 bits less the 7 that number the bins


def _let(value: Column, body) -> Column:
    """Compute ``value`` once and hand it to ``body``."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), "[ \\t\\n\\x0B\\f\\r]+"), lambda w: w != "")


def shingle_hashes(text: Column, words: int = WORDS) -> Column:
    """The hash of every run of ``words`` words, or of all words if there are fewer."""
    hashed = F.transform(words_of(text), lambda w: F.xxhash64(w))
    return _let(
        hashed,
        lambda h: F.when(F.size(h) == 0, F.array().cast("array<bigint>")).otherwise(
            F.transform(
                F.sequence(F.lit(1), F.greatest(F.size(h) - (words - 1), F.lit(1))),
                lambda i: F.xxhash64(F.slice(h, i, words)),
            )
        ),
    )


def _bin(value: Column) -> Column:
    return F.shiftright(value, _BIN_SHIFT)


def fingerprint(text: Column) -> Column:
    """The packed fingerprint of a text, as a hex string of two digits a bin."""

    def of_least(least: Column) -> Column:
        filled = F.map_from_arrays(F.transform(least, _bin), least)

        def slot(number: Column, full: Column) -> Column:
            own = F.element_at(full, number)
            borrowed = F.array_min(
                F.transform(
                    least, lambda x: F.struct(F.xxhash64(number, _bin(x)).alias("order"), x.alias("value"))
                )
            )["value"]
            return F.lpad(F.lower(F.hex(F.coalesce(own, borrowed).bitwiseAND(F.lit(255)))), 2, "0")

        bins = F.sequence(F.lit(-BINS // 2).cast("long"), F.lit(BINS // 2 - 1).cast("long"))
        return F.when(F.size(least) == 0, F.lit("")).otherwise(
            F.array_join(_let(filled, lambda full: F.transform(bins, lambda b: slot(b, full))), "")
        )

    def of_sorted(ordered: Column) -> Column:
        first = F.filter(
            ordered, lambda x, i: (i == 0) | (_bin(x) != _bin(F.element_at(ordered, F.greatest(i, F.lit(1)))))
        )
        return _let(first, of_least)

    return _let(F.sort_array(shingle_hashes(text)), of_sorted)


def likeness(left: Column, right: Column) -> Column:
    """The estimated similarity of two fingerprints' texts, corrected for chance agreement."""
    place = F.sequence(F.lit(1), F.lit(2 * BINS - 1), F.lit(2))
    agreed = F.size(
        F.filter(place, lambda i: F.substring(left, i, F.lit(2)) == F.substring(right, i, F.lit(2)))
    )
    chance = 1 / 256
    corrected = (agreed / F.lit(float(BINS)) - chance) / (1 - chance)
    return (
        F.when((left == "") | (right == ""), (left == right).cast("double"))
        .otherwise(F.greatest(corrected, F.lit(0.0)))
    )


def next_in_order(rows: DataFrame, order: list[str], stage: Stage) -> DataFrame:
    """Each row with the one that follows it (the first follows the last), as ``next``.

    Rows are dealt out by ranges; within a range the next row is found by a window, and over the
    ranges, of which there are as many as partitions, from their first rows.
    """
    dealt = rows.repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    dealt = stage.write(dealt, "ordered")
    firsts = dealt.groupBy("range").agg(F.min(F.struct(*order, *rows.columns)).alias("first"))
    after = firsts.select(
        "range",
        F.coalesce(
            F.lead("first").over(Window.orderBy("range")), F.first("first").over(Window.orderBy("range"))
        ).alias("after"),
    )
    here = Window.partitionBy("range").orderBy(*order)
    return (
        dealt.withColumn("next", F.lead(F.struct(*order, *rows.columns)).over(here))
        .join(after, "range")
        .withColumn("next", F.coalesce("next", "after"))
        .drop("range", "after")
    )


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text, and how like it the next text is.

    The edited text has its last quarter of characters replaced by as many (or all) from the
    start of the next document by doc_id. Documents without an id come first; equal ids are
    ordered by a digest of their texts; rows equal in both are one document that is returned
    each time.
    """
    stage = Stage(docs.sparkSession)
    ids = docs.select("doc_id", text_key().alias("content"), F.coalesce("text", F.lit("")).alias("body"))
    key = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit(" "), F.hex("content")))
    # both joins shuffle these very columns, so that the texts are shuffled once
    texts = ids.select(F.unhex(key).alias("key"), "body")
    narrow = ids.select("doc_id", "content", F.unhex(key).alias("key"), F.length("body").alias("n")).distinct()
    placed = stage.write(
        next_in_order(narrow, ["doc_id", "content"], stage).select(
            "key", "doc_id", F.col("next.key").alias("next_key"), F.floor(F.col("n") / 4).cast("int").alias("taken")
        ),
        "placed",
    )
    by_next = placed.select(F.col("next_key").alias("key"), F.col("key").alias("before"), "doc_id", "taken")
    heads = (
        texts.join(by_next, "key")
        .select(F.col("before").alias("key"), "doc_id", F.expr("substring(body, 1, taken)").alias("head"))
        .groupBy("key")
        .agg(F.min("doc_id").alias("doc_id"), F.min("head").alias("head"))
    )
    n = F.length("body")
    edited = F.concat(F.expr("substring(body, 1, length(body) - cast(floor(length(body) / 4) as int))"), "head")
    done = texts.join(heads, "key").select(
        "key", "doc_id", "body", n.cast("long").alias("n_chars"), edited.alias("edited")
    )
    made = stage.write(
        done.select(
            "key",
            "doc_id",
            "n_chars",
            F.sha2("edited", 256).alias("edited_sha256"),
            fingerprint(F.col("body")).alias("fingerprint"),
            fingerprint(F.col("edited")).alias("edited_fingerprint"),
        ),
        "fingerprints",
    )
    of_key = made.groupBy("key").agg(F.min("fingerprint").alias("next_fingerprint"))
    following = placed.select("key", "next_key").join(
        of_key.withColumnRenamed("key", "next_key"), "next_key"
    )
    return made.join(following.drop("next_key"), "key").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
    )
