import random
import re

import pytest

from tillwise.llm.decontamination import drop_contaminated, mark_contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))


def brute(docs, items, size=13):
    windows = {}
    for item, text in items:
        w = words(text)
        width = min(size, len(w))
        for k in range(len(w) - width + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + width]), set()).add(item)
    out = []
    for doc, text in docs:
        w, hit, own = words(text), set(), set()
        for width in {len(x) for x in windows}:
            for k in range(len(w) - width + 1):
                if (found := windows.get(tuple(w[k : k + width]))) is not None:
                    hit |= set(range(k, k + width))
                    own |= found
        out.append((doc, len(w), len(hit), sorted(str(x) for x in own if x is not None)))
    return sorted(out, key=str)


def case():
    rng = random.Random(5)
    vocabulary = ["ab", "Cd", "é", "x9", "Zz", "q"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 3, 13, 14, 30]))) for i in range(6, 14)]
    items += [(3, text(20)), (3, text(16)), (None, text(18)), (21, None), (22, " .. ")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(20)]
    docs += [(90, items[-3][1] + " !"), (91, "w " * 5000 + items[-4][1].upper()), (92, None), (93, "")]
    docs += [(None, items[-5][1]), (95, items[-5][1]), (95, items[-5][1])]
    return docs, items


@pytest.mark.parametrize("limit", [1 << 20, 150])
def test_matches_brute_force(spark, frame, limit):
    docs, items = case()
    got = mark_contamination(
        frame(docs), spark.createDataFrame(items, "item_id long, text string"), block_bytes=limit
    ).collect()
    rows = sorted(
        ((r.doc_id, r.contamination.n_words, r.contamination.n_hit, r.contamination["items"]) for r in got),
        key=str,
    )
    assert rows == brute(docs, items)
    for r in got:
        assert sum(b - a for a, b in r.contamination.spans) == r.contamination.n_hit


def test_empty_tables_and_other_columns(spark, frame):
    none = spark.createDataFrame([], "item_id long, text string")
    assert mark_contamination(frame([]), none).count() == 0
    docs = frame([(1, "a b"), (2, None)]).selectExpr("*", "1 as contamination", "2 as n_words")
    assert drop_contaminated(docs, none).columns == docs.columns
    assert drop_contaminated(docs, none).count() == 2
    item = spark.createDataFrame([(7, "A b")], "item_id long, text string")
    assert [r.doc_id for r in drop_contaminated(docs, item).collect()] == [2]
