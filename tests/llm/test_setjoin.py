import random
import re

import numpy as np
import pytest

from tillwise.llm import setjoin
from tillwise.llm.frames import mix
from tillwise.llm.setjoin import jaccard_components, light_limit, may_link, signature

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    words = WORD.findall("".join(c.lower() if c < "\x80" else c for c in text or ""))
    if not words:
        return frozenset()
    k = min(5, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def brute(rows):
    sets = [shingles(x) for _, x in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted(
        ((doc, len(sets[i]), least.get(find(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows)),
        key=str,
    )


def corpus(seed, size=260):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    line = " ".join(rng.choice(vocabulary) for _ in range(12))
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    bases = [text(rng.choice([2, 5, 6, 9, 12, 20, 40, 90])) for _ in range(14)]
    rows = []
    for i in range(size):
        kind = rng.random()
        words = list(rng.choice(bases[:2] if kind < 0.3 else bases)) if kind < 0.8 else text(rng.randint(0, 30))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            if words:
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        if rng.random() < 0.3:
            words = words + line.split()
        rows.append((rng.randint(0, 10**6), " ".join(words).upper() if kind < 0.1 else "  ".join(words)))
    rows += [(5, None), (5, ""), (None, " \t"), (None, rows[0][1]), (rows[1][0], rows[1][1])]
    rows += [(7, "a"), (8, "A"), (9, "a b c"), (10, "a b c d"), (11, "x " * 20000), (12, "x " * 20001)]
    return rows


@pytest.mark.parametrize(("seed", "split"), [(1, 16384), (2, 16384), (3, 3)])
def test_matches_brute_force(spark, frame, seed, split):
    rows = corpus(seed)
    got = jaccard_components(frame(rows).repartition(3), split_list=split).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


def test_empty_table_and_other_columns(spark, frame):
    assert jaccard_components(frame([])).count() == 0
    docs = frame([(1, "a b"), (2, "a b")]).selectExpr("*", "1 as cls", "2 as size", "3 as token")
    assert {r.component_id for r in jaccard_components(docs).collect()} == {1}


def test_signatures_rule_out_no_linked_pair():
    rng = random.Random(4)
    import numpy as np

    for _ in range(300):
        n = rng.randint(1, 900)
        a = np.array(sorted({rng.getrandbits(64) for _ in range(n)}), np.uint64)
        b = np.unique(np.concatenate([a[rng.randint(0, n // 6) :], np.array([rng.getrandbits(64) for _ in range(rng.randint(0, n // 5))], np.uint64)]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both):
            assert may_link(len(a), signature(a), len(b), signature(b))


def test_light_sizes_are_chosen_by_cost():
    assert light_limit({6: 1000, 60: 10}, 0.0, 75) == 0
    assert light_limit({6: 1000, 60: 10}, 50.0, 75) >= 6
    assert light_limit({}, 3.0, 75) == 0
    assert setjoin.prefix_length(20, 75, 1) == 6


def test_the_nearest_set_of_a_list_is_offered():
    sets = [np.sort(mix(np.arange(low, low + 400, dtype=np.uint64))) for low in (0, 30, 5, 5000)]
    rows = [{"cls": i, "size": len(s), "bits": setjoin.narrow(setjoin.signature(s))} for i, s in enumerate(sets)]
    assert {len(r["bits"]) for r in rows} == {setjoin.NARROW}
    nearest = setjoin.Nearest(rows[:1])
    for row in rows[1:]:
        nearest.meet(row, setjoin.LIKE)
    assert nearest.pairs() == [(0, 2)]
    assert setjoin.Nearest(rows[3:]).pairs() == []


@pytest.mark.parametrize("seed", [5, 6])
def test_blocks_match_brute_force(spark, frame, seed):
    rows = corpus(seed)
    got = jaccard_components(frame(rows).repartition(3), split_list=3, block=3).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == brute(rows)


@pytest.mark.parametrize("among", [True, False])
def test_long_lists_meet_in_blocks(spark, among):
    rng = random.Random(7)
    rows = [(t, cls, cls % 9 if cls % 3 else 0, cls % 3 == 0, rng.random() < 0.3) for t, n in ((1, 90), (2, 7)) for cls in range(n)]
    mixed = spark.createDataFrame(rows, "token long, cls long, label long, main boolean, strong boolean")
    groups = {}
    for r in setjoin._dealt(mixed, 10, among).collect():
        groups.setdefault((r.token, r.kind, r.i, r.j), []).append(r)
    assert max(len(g) for g in groups.values()) <= 60
    met = set()
    for (token, kind, _, _), group in groups.items():
        held = [r for r in group if r.role]
        for r in group:
            if r.role != setjoin._HELD:
                met |= {(token, *sorted((r.cls, x.cls))) for x in held if x.cls != r.cls and (x.strong or r.strong)}
    wanted = {
        (a[0], a[1], b[1]) for a in rows for b in rows
        if a[0] == b[0] and a[1] < b[1] and (a[4] or b[4]) and not (a[3] and b[3]) and (among or a[3] or b[3])
    }
    assert met == wanted


def test_boilerplate_below_the_threshold_makes_no_list_to_go_through(spark, frame):
    shared = [f"b{i}" for i in range(160)]
    docs = frame([(i, " ".join([f"d{i}x{j}" for j in range(38)] + shared)) for i in range(60)])
    limit, bits = 0, 16
    levels = setjoin.shingle_levels(docs, 5, bits)
    sent = spark.sparkContext.broadcast(levels)
    postings = setjoin._postings(docs, sent, bits, limit, 5, 75, 16384)
    lists = (
        setjoin._read_lists(postings).where("token is not null")
        .selectExpr("token", "a as cls", "strong").distinct()
    )
    assert lists.count() >= 60
    stage = setjoin.Stage(spark)
    labels = spark.createDataFrame([], "node long, label long")
    assert setjoin._mixed_lists(lists, labels, stage).isEmpty()
    assert {r.component_id for r in jaccard_components(docs).collect()} == set(range(60))
