import random
import re

import pytest

from tillwise.llm.repeats import remove_repeats, without_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, size):
    met = {}
    split = [(doc, WORD.findall(text or "")) for doc, text in rows]
    for _, words in split:
        for k in range(len(words) - size + 1):
            met[tuple(words[k : k + size])] = met.get(tuple(words[k : k + size]), 0) + 1
    out = []
    for doc, words in split:
        gone = set()
        for k in range(len(words) - size + 1):
            if met[tuple(words[k : k + size])] > 1:
                gone |= set(range(k, k + size))
        out.append((doc, len(words), len(gone), " ".join(w for i, w in enumerate(words) if i not in gone)))
    return sorted(out, key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{i}é" for i in range(300)] + ["a\x00", "\x1f\x85"]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    passages = [text(rng.choice([30, 34, 35, 36, 60, 120])) for _ in range(8)]
    rows = []
    for i in range(90):
        parts = [text(rng.randint(0, 60))]
        for _ in range(rng.choice([0, 0, 1, 2])):
            own = list(rng.choice(passages))
            if rng.random() < 0.4:
                own[rng.randrange(len(own))] = "edited"
            low = rng.randint(0, 20)
            parts += [own[low:], text(rng.randint(0, 50))]
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(w for p in parts for w in p)))
    rows += [(200, "the " * 400), (201, "the " * 35), (202, "x " * 34), (203, "ab cd " * 60), (204, None), (205, "")]
    rows += [(None, rows[3][1]), (7, rows[7][1]), (206, " ".join(passages[0])), (207, " ".join(text(5000)))]
    return rows


@pytest.mark.parametrize(
    ("seed", "size", "hot", "shard"), [(1, 35, 50_000, 400_000), (2, 35, 3, 500), (3, 12, 50_000, 1), (4, 5, 2, 100)]
)
def test_matches_brute_force(spark, frame, seed, size, hot, shard):
    rows = corpus(seed)
    got = remove_repeats(frame(rows).repartition(3), size, hot_anchor=hot, shard_words=shard).collect()
    assert sorted(((r.doc_id, *r.repeats) for r in got), key=str) == brute(rows, size)


def test_texts_are_cut(spark, frame):
    twice = " ".join(f"p{i}" for i in range(40))
    docs = frame([(1, "x  " + twice), (2, twice + " y"), (3, "z  z"), (4, None)]).selectExpr("*", "1 as runs")
    got = {r.doc_id: r for r in without_repeats(docs).collect()}
    assert [got[i].text for i in (1, 2, 3, 4)] == ["x", "y", "z  z", None]
    assert [got[i].n_chars for i in (1, 2, 3, 4)] == [1, 1, 4, None]
    assert without_repeats(docs).columns == docs.columns


def test_empty_table(spark, frame):
    assert remove_repeats(frame([])).count() == 0
