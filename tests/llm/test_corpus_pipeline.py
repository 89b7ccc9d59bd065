import importlib.util
import sys
from pathlib import Path

from test_decontamination import brute as contaminated_brute
from test_repeats import brute as repeats_brute
from test_setjoin import brute as components_brute

ROOT = Path(__file__).resolve().parents[2]
spec = importlib.util.spec_from_file_location("corpus_pipeline", ROOT / "corpus_pipeline.py")
pipeline = importlib.util.module_from_spec(spec)
sys.modules["corpus_pipeline"] = pipeline
spec.loader.exec_module(pipeline)

SAMPLE = "/root/testdata/sf0.01"


def test_each_stage_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SAMPLE}/documents.parquet")
    columns = docs.columns
    benchmark = [(r.item_id, r.text) for r in spark.read.parquet(f"{SAMPLE}/benchmark.parquet").collect()]
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in pipeline.STAGES:
        stage(spark, docs, SAMPLE).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        after = {r.doc_id: r for r in docs.collect()}
        texts = [(i, r.text) for i, r in before.items()] if name != "tokens" else None
        if name != "tokens":
            assert docs.columns == columns
        if name == "quality":
            bad = {r.doc_id for r in spark.read.parquet(f"{SAMPLE}/labels.parquet").where("quality = 0").collect()}
            good = {r.doc_id for r in spark.read.parquet(f"{SAMPLE}/labels.parquet").where("quality = 1").collect()}
            assert len(bad & set(after)) <= 0.1 * len(bad) + 1 and len(good & set(after)) >= 0.97 * len(good & set(before))
        elif name == "near_duplicates":
            assert set(after) == {i for i, _, least in components_brute(texts) if i == least}
            assert all(after[i] == before[i] for i in after)
        elif name == "repeated_passages":
            for i, n, gone, kept in repeats_brute(texts, 35):
                assert after[i].text == (kept if gone else before[i].text)
                assert after[i].n_chars == (len(kept) if gone else before[i].n_chars)
        elif name == "decontamination":
            clean = {i for i, n, hit, _ in contaminated_brute(texts, benchmark) if not (hit and 20 * hit >= n)}
            assert set(after) == clean and all(after[i] == before[i] for i in after)
        else:
            assert set(after) == set(before)
        before = after
    assert docs.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_run_ends_with_the_stages_rows(spark):
    rows = pipeline.run(spark, SAMPLE).collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows)


def test_one_row_of_each_group_stays(spark, frame):
    words = [f"w{i}" for i in range(40)]
    long, near = " ".join(words), " ".join([*words, "more"])
    other = " ".join(f"x{i}" for i in range(30))
    rows = [(1, long), (1, long), (2, near), (1, other), (3, other), (None, long), (None, other)]
    rows += [(None, "quite another text of nine words and no more")] * 50 + [(7, "a b c"), (7, "A b  c"), (8, ""), (8, ""), (None, None)]
    kept = pipeline.near_duplicate_stage(spark, frame(rows).repartition(3), SAMPLE)
    assert kept.columns == frame(rows).columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    seven = next(x for i, x in got if i == 7)
    assert seven in ("a b c", "A b  c")
    wanted = [(1, long), (1, other), (None, rows[7][1]), (7, seven), (8, ""), (8, ""), (None, None)]
    assert got == sorted(wanted, key=str)
