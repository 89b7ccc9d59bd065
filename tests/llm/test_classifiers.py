import zlib

import numpy as np
import pyarrow as pa
import pytest
import zstandard

from tillwise.llm import language, quality
from tillwise.llm.queries import op3_language, op8_quality

SAMPLE = "/root/testdata/sf0.01"


def test_held_out_accuracy_of_quality(spark):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SAMPLE}/labels.parquet").collect()}
    rows = op8_quality(spark, SAMPLE).collect()
    assert len(rows) == spark.read.parquet(f"{SAMPLE}/documents.parquet").count()
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert np.mean([r.predicted == labels[r.doc_id] for r in held]) > 0.97


def test_held_out_accuracy_of_language(spark):
    known = {r.doc_id: r.lang for r in spark.read.parquet(f"{SAMPLE}/documents.parquet").collect()}
    rows = op3_language(spark, SAMPLE).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out and known[r.doc_id]]
    assert np.mean([r.lang_pred == known[r.doc_id] for r in held]) > 0.97


def test_smallest_compressed_size_wins():
    dictionaries = {"b": b"the quick brown fox jumps " * 20, "a": "schöne größe über straße ".encode() * 20}
    compressors = language.Compressors(dictionaries, 0.01)
    for text, want in (("The QUICK brown fox", "b"), ("über die schöne straße", "a")):
        sizes = {}
        for lang, data in dictionaries.items():
            raw = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            raw.precompute_compress(level=language.LEVEL)
            kind = zstandard.ZstdCompressor(dict_data=raw, write_content_size=False, write_dict_id=False)
            sizes[lang] = len(kind.compress(text.lower().encode()))
        assert min(sizes, key=sizes.get) == want == compressors.predict(text)[0]
    assert compressors.predict(None) == compressors.predict("") == compressors.predict("12 !?") == ("und", 0.0, False)
    assert not language.Compressors({"x": b"same text " * 9, "y": b"same text " * 9}, 0.01).predict("same text")[2]
    assert language.Compressors({"x": b"same text " * 9}, 0.01).predict("é") == ("x", 1.0, True)
    assert language.Compressors({}, 0.01).predict("word")[0] == "und"


def test_language_of_odd_tables(spark, frame):
    assert language.learn(frame([(1, "no language given")])) == {}
    docs = frame([(1, "abc"), (None, None), (2, "x " * 200_000), (2, "")]).selectExpr("*", "1 as language")
    got = language.add_languages(docs, {"q": b"x x x x x x"}).collect()
    assert sorted(r.language.lang_pred for r in got) == ["q", "q", "und", "und"]
    assert language.add_languages(frame([]), {}).count() == 0
    told = docs.drop("lang").selectExpr("*", "'zz' as lang")
    assert set(language.learn(told)) == {"zz"}


def test_risk_does_not_fall_below_zero():
    rng = np.random.default_rng(1)
    good, bad = rng.normal(0, 1, (400, 5)), rng.normal(4, 1, (120, 5))
    unlabelled = np.concatenate([rng.normal(0, 1, (480, 5)), bad])
    model = quality.fit(good, unlabelled, 0.8)
    assert model.score(good).mean() > 0.9 and model.score(bad).mean() < 0.2
    assert quality.fit(good[:0], unlabelled, 0.7).score(good).tolist() == [0.7] * 400


def test_features_are_of_whole_texts():
    long = "word " * 300_000
    rows = quality.features(pa.array([None, "", "a", long, long + "!" * 600_000, "ü\x00|"]))
    assert np.isfinite(rows).all() and (rows[0] == rows[1]).all()
    assert rows[4][6] == pytest.approx(600_000 / 2_100_000)


def test_quality_of_odd_tables(spark, frame):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = quality.train(frame([]), labels)
    docs = frame([(1, "x"), (None, None)]).selectExpr("*", "1 as quality", "2 as score")
    assert [r.quality.score for r in quality.add_scores(docs, model).collect()] == [0.5, 0.5]
    assert quality.keep_good(docs, labels).columns == docs.columns
    some = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    assert quality.keep_good(frame([(i, f"text {i}") for i in range(9)] + [(1, "text 1")]), some).count() <= 10


def test_copies_do_not_change_what_is_learnt(spark, frame, monkeypatch):
    rows = [(n, f"text {n} of {'one' if n % 2 else 'other'} language " * 3) for n in range(40)]
    docs = frame(rows).selectExpr("doc_id", "text", "if(doc_id % 2 = 1, 'a', 'b') as lang")
    copies = docs.crossJoin(spark.range(200)).where("doc_id < 8").select("doc_id", "text", "lang")
    learnt = language.learn(docs)
    assert set(learnt) == {"a", "b"} and language.learn(docs.union(copies)) == learnt
    monkeypatch.setattr(language, "MOST_LANGUAGES", 1)
    with pytest.raises(ValueError, match="languages"):
        language.learn(docs)
