"""The registered queries of the operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillwise.llm import (
    bpe,
    decontamination,
    fingerprints,
    language,
    lexical,
    licenses,
    personal,
    quality,
    records,
    repeats,
    setjoin,
    warc,
    whitening,
)
from tillwise.llm.frames import table

#: The tokenizer file of the token queries.
TOKENIZER = "byte_bpe_50k.json"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


@query
def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's licence, as a whole text and by lines."""
    docs = table(spark, sf_dir, "documents")
    done = licenses.scan_licenses(docs, licenses.known_digests(spark), keep=["doc_id"])
    return done.select(
        "doc_id",
        F.col("licenses.digest").alias("canonical_sha256"),
        F.col("licenses.whole_text").alias("license"),
        F.array_join("licenses.lines", ";").alias("line_licenses"),
    )


@query
def op2_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and the text decoded from them, as digests."""
    docs = table(spark, sf_dir, "documents")
    done = bpe.add_token_digests(docs, tokenizer_path(), keep=["doc_id"])
    return done.select("doc_id", "tokens.*")


@query
def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language."""
    docs = table(spark, sf_dir, "documents")
    done = language.add_languages(docs, language.learn(docs), keep=["doc_id"])
    return done.select("doc_id", language.is_held_out().alias("held_out"), "language.*")


@query
def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words outside repeated passages."""
    marked = repeats.remove_repeats(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return marked.select(
        "doc_id",
        "repeats.n_words",
        "repeats.n_removed",
        F.sha2("repeats.kept", 256).alias("kept_sha256"),
    )


@query
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's component of near-equal shingle sets."""
    return setjoin.jaccard_components(table(spark, sf_dir, "documents"))


@query
def op6_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token record, read back from the files."""
    folder, manifest = records.write_records(table(spark, sf_dir, "documents"), tokenizer_path())
    return records.read_records(spark, folder, manifest)


@query
def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint beside those of its edited text and of the next document."""
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


@query
def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality."""
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    done = quality.add_scores(docs, model, keep=["doc_id"])
    return done.select(
        "doc_id",
        quality.is_held_out().alias("held_out"),
        "quality.score",
        (F.col("quality.score") >= quality.THRESHOLD).cast("int").alias("predicted"),
    )


@query
def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's record, read back from the archives."""
    return warc.read_archives(spark, warc.write_archives(table(spark, sf_dir, "pages")))


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's benchmark hits."""
    marked = decontamination.mark_contamination(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), keep=["doc_id"]
    )
    return marked.select(
        "doc_id",
        "contamination.n_words",
        "contamination.n_hit",
        F.size("contamination.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("contamination.items", ","), 256).alias("items_sha256"),
        decontamination.is_contaminated().alias("contaminated"),
    )


@query
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item's best documents."""
    found = lexical.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("item_id", "rank", "doc_id", "score")


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every remaining vector's whitened components."""
    vectors = table(spark, sf_dir, "embeddings")
    model = whitening.fit(vectors)
    return whitening.component_rows(whitening.add_whitened(vectors, model, keep=["vec_id"]), model)


@query
def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's spans of personal data."""
    found = personal.find_personal_data(table(spark, sf_dir, "documents"), keep=["doc_id"])
    base, spans = F.col("personal.base"), F.col("personal.spans")
    kinds = F.transform(base, lambda s: s["kind"])
    count = {k: F.size(kinds) - F.size(F.array_remove(kinds, k)) for k in personal.KINDS}
    return found.select(
        "doc_id",
        *[n.cast("long").alias(f"n_{k}") for k, n in count.items()],
        F.sha2(personal.listed(base), 256).alias("base_sha256"),
        personal.listed(spans).alias("spans"),
    )
