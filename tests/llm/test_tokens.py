import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tillwise.llm import bpe, records, tokens
from tillwise.llm.queries import op2_bpe_round_trip, op6_token_records
from tillwise.llm.tokens import is_odd

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "a", "Hello, world. It's 10 o'clock", "tail ", " lead", "two  spaces\n\nand lines\r\n",
    "tab\tinside", "x<|endoftext|>y <|endoftext|>", "naïve café – “quotes” 東京 🙂", "a" * 3000, "ab " * 4000,
    "\x00\x1f\x85 ", "a\nb\nc d", "a.\nThe b", "don't we'll x.y, z.", "\n", "1,000.50 z", "tail.\n",
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def test_words_and_texts_as_the_library(library):
    rng = random.Random(3)
    pairs = bpe.BytePairs(PATH)
    encoder = records.LibraryEncoder(PATH, 0)
    alphabet = "etaon shrdlu.,'\n  ß9é-"
    texts = [x or "" for x in TEXTS]
    texts += ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 200))) for _ in range(300)]
    for text in texts:
        ids = library.encode(text, add_special_tokens=False).ids
        assert pairs.encode(text) == ids
        assert pairs.decode(ids) == library.decode(ids, skip_special_tokens=False)
        assert np.frombuffer(encoder.encode(text), "<u2").tolist() == [*ids, 0]


def test_words_of_letters_take_the_short_way(library, monkeypatch):
    tested = []
    monkeypatch.setattr(tokens, "is_odd", lambda piece: tested.append(piece) or is_odd(piece))
    encoder = records.LibraryEncoder(PATH, 0)
    text = "the quickest onatthe word" + "s" * 40 + " End"
    ids = library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(encoder.encode(text), "<u2").tolist() == [*ids, 0]
    assert tested == ["\nthe"]  # the first piece alone
    many = list(range(100))
    assert encoder.pack(many) == np.array(many, "<u2").tobytes()


def test_every_character_as_the_library(library):
    pairs = bpe.BytePairs(PATH)
    for i in [*range(0x600), *range(0x1FF0, 0x2070)]:
        for text in (f"a{chr(i)}b", f" {chr(i)}", f"{chr(i)}{chr(i)} 1"):
            assert pairs.encode(text) == library.encode(text, add_special_tokens=False).ids, hex(i)


def test_query_of_round_trips(spark, frame, library, tmp_path):
    frame(list(enumerate(TEXTS))).write.parquet(f"{tmp_path}/documents.parquet")
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    for row in op2_bpe_round_trip(spark, str(tmp_path)).collect():
        ids = library.encode(TEXTS[row.doc_id] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        assert (row.n_tokens, row.ids_sha256, row.decoded_sha256) == (
            len(ids), sha(",".join(map(str, ids))), sha(text)
        )


def test_query_of_records(spark, frame, library, tmp_path):
    rows = [(i * 7 % 23, x) for i, x in enumerate(TEXTS)] + [(None, "no id"), (3, "again"), (3, "again")]
    frame(rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = op6_token_records(spark, str(tmp_path)).collect()
    got.sort(key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, *sorted(i for i, _ in rows if i is not None)]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()
    want = sorted(
        (str(i), zlib.crc32(np.array([*library.encode(x or "", add_special_tokens=False).ids, 0], "<u4").tobytes()))
        for i, x in rows
    )
    assert sorted((str(r.doc_id), r.ids_crc32) for r in got) == want


def test_rolling_files_index_and_damage(spark, frame, library, tmp_path):
    docs = frame([(i, f"text {i}") for i in range(50)])
    folder, manifest = records.write_records(docs, PATH, f"{tmp_path}/out", file_bytes=200)
    files = manifest.orderBy("shard", "part").collect()
    assert len(files) > 5 and sum(f.records for f in files) == 50
    doc_id, ids = records.read_record(folder, files[2].file, 1)
    first = sum(f.records for f in files[:2])
    assert doc_id == first + 1
    assert ids.tolist() == [*library.encode(f"text {doc_id}", add_special_tokens=False).ids, 0]
    with open(f"{tmp_path}/out/{files[0].file}", "r+b") as file:
        file.seek(25)
        file.write(b"\xff")
    with pytest.raises(Exception, match="damaged"):
        records.read_records(spark, folder, manifest).collect()


def test_empty_table(spark, frame):
    folder, manifest = records.write_records(frame([]), PATH)
    assert records.read_records(spark, folder, manifest).count() == 0
    assert bpe.add_tokens(frame([]), PATH).count() == 0


def test_tokens_beside_clashing_columns(spark, frame):
    docs = frame([(1, "Hello there"), (2, None)]).selectExpr("*", "1 as tokens", "2 as ids")
    got = {r.doc_id: r for r in bpe.add_tokens(docs, PATH).collect()}
    assert got[1].tokens.decoded == "Hello there" and got[1].ids == 2
    assert got[2].tokens.n_tokens == 0


def test_a_worker_keeps_its_encoder_for_later_tasks():
    encoder = records.library_encoder(PATH, 0)
    first = encoder.encode("one two two")
    met = len(encoder.later)
    again = records.library_encoder(PATH, 0)
    assert again is encoder and again.encode("one two two") == first and len(again.later) == met
    assert records.library_encoder(PATH, 1).encode("one two two")[:-2] == first[:-2]
