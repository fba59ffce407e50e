import random

import numpy as np
import pyarrow as pa
from fixtures import corpus, frame, words
from segmill.llm import decontaminate, textscan
from segmill.llm.decontaminate import N_WORDS, PROXIMITY_LEAST, PROXIMITY_TERMS

BENCH = "item_id long, text string, __id long, terms string"


def bench(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], BENCH)


def split(text):
    return textscan.words(pa.array([text], pa.string())).hash.tolist()


def brute(rows, items):
    """Every longest equal run, by comparing all positions."""
    found = set()
    for item, text in items:
        q = split(text)
        need = min(N_WORDS, len(q))
        for doc, body in rows:
            d = split(body)
            for i in range(len(q)):
                for j in range(len(d)):
                    if q[i] == d[j] and not (i and j and q[i - 1] == d[j - 1]):
                        n = 0
                        while i + n < len(q) and j + n < len(d) and q[i + n] == d[j + n]:
                            n += 1
                        if n >= need:
                            found.add((doc, item, i, j, n))
    return found


def fixture():
    rng = random.Random(5)
    items = [(i, " ".join(words(rng, 8 + 4 * i))) for i in range(8)] + [(8, "too short"), (9, None), (None, "no id " * 20), (10, "rep eat " * 10)]
    rows = [(k, " ".join(words(rng, 60))) for k in range(30)]
    for k in range(30, 46):  # whole items, parts of them, and parts that are too short
        q = items[k % 8][1].split()
        part = q if k < 38 else q[len(q) // 4 : len(q) // 4 + (N_WORDS if k % 2 else N_WORDS - 1)]
        rows.append((k, " ".join(words(rng, 20) + part + words(rng, 20))))
    rows += [(46, "Rep, EAT " * 25), (47, None), (48, "")]
    return rows, items


def test_phrases_equal_brute_force(spark):
    rows, items = fixture()
    found = decontaminate.matches(frame(spark, rows), bench(spark, items)).where("kind = 'phrase'").collect()
    got = [(r["doc_id"], r["item_id"], r["item_start"], r["doc_start"], r["n_words"]) for r in found]
    want = brute(rows, [x for x in items if x[0] is not None and x[1]])
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 12


def test_proximity(spark):
    rng = random.Random(8)
    item = [f"rare{i}" for i in range(12)]
    shuffled = item[:]
    rng.shuffle(shuffled)
    rows = [(1, " ".join(words(rng, 30) + shuffled + words(rng, 30))), (2, " ".join(sum(([w, *words(rng, 20)] for w in item), []))), (3, " ".join(item[: PROXIMITY_TERMS - 1]))]
    found = decontaminate.matches(frame(spark, rows), bench(spark, [(5, " ".join(item))])).collect()
    assert [(r["doc_id"], r["item_id"], r["kind"]) for r in found] == [(1, 5, "proximity")]


def test_proximity_of_changed_copies(spark):
    """Terms that no document has don't stand in the way, and a share of the others is enough."""
    rng = random.Random(12)
    item = [f"rare{i}" for i in range(16)]
    copy = [*item[:8], "changed", *item[9:]]  # no 13 words in a row, and rare8 is in no document
    few = item[: PROXIMITY_LEAST - 1]
    rows = [(1, " ".join(words(rng, 30) + copy + words(rng, 30))), (2, " ".join(words(rng, 30) + few)), (3, " ".join(words(rng, 60)))]
    found = decontaminate.matches(frame(spark, rows), bench(spark, [(5, " ".join(item))])).collect()
    assert [(r["doc_id"], r["item_id"], r["kind"]) for r in found] == [(1, 5, "proximity")]


def test_proximity_equals_brute_force():
    """Every window of the reach is tried for PROXIMITY_LEAST of the terms."""
    rng = np.random.default_rng(3)
    hits = 0
    for _ in range(300):
        sizes = rng.integers(1, 50, 4)
        texts = [rng.integers(1, 26, n).tolist() for n in sizes]
        item = rng.permutation(np.arange(1, 30))[:10].tolist()
        near = decontaminate.near_terms(item, [sum(x in t for t in texts) for x in item])
        span = decontaminate.reach(len(item))
        lists = [np.array([(d << decontaminate.SHIFT) + decontaminate.ORIGIN + i for d, t in enumerate(texts) for i, y in enumerate(t) if y == x], np.int64) for x in near]
        found = {p >> decontaminate.SHIFT: n for p, n in decontaminate.closest(lists, span)} if near else {}
        want = {}
        for d, t in enumerate(texts if near else []):
            most = max(len(set(t[p : p + span]) & set(near)) for p in range(len(t)))
            if most >= PROXIMITY_LEAST:
                want[d] = most
        assert found == want
        hits += len(want)
    assert hits > 20


def test_proximity_of_tables_equals_brute_force(spark):
    """Through index, frequencies and joins, over several segments."""
    rng = random.Random(21)
    items = [(i, " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(14))) for i in range(6)]
    rows = [(k - 9, " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(1, 60)))) for k in range(40)]
    found = {(r["doc_id"], r["item_id"]): r["n_words"] for r in decontaminate.matches(frame(spark, rows), bench(spark, items)).where("kind = 'proximity'").collect()}
    want = {}
    for item, text in items:
        q = text.split()
        near = decontaminate.near_terms(q, [sum(x in t.split() for _, t in rows) for x in q])
        for key, t in rows if near else []:
            own = t.split()
            most = max(len(set(own[p : p + decontaminate.reach(len(q))]) & set(near)) for p in range(len(own)))
            if most >= PROXIMITY_LEAST:
                want[key, item] = most
    assert found == want and len(want) > 20


def test_short_items_match_whole(spark):
    rows = [(1, "it is so"), (2, "it is"), (3, "So it is so"), (4, "x " * 30)]
    found = {(r["doc_id"], r["item_id"], r["doc_start"]) for r in decontaminate.matches(frame(spark, rows), bench(spark, [(1, "it is so"), (2, "x"), (3, "...")])).collect()}
    assert found == {(1, 1, 0), (3, 1, 1), *((4, 2, i) for i in range(30))}
    assert decontaminate.keep(frame(spark, rows), bench(spark, [(1, "it is so")])).count() == 4


def test_keep_and_cases(spark):
    rows, items = fixture()
    rows += corpus()
    docs = frame(spark, rows)
    kept = decontaminate.keep(docs, bench(spark, items))
    assert kept.columns == docs.columns
    ids = {r["doc_id"] for r in kept.select("doc_id").collect()}
    assert not ids & set(range(30, 38)) and {72, 73, 74, 75} <= ids
    assert decontaminate.matches(frame(spark, []), bench(spark, items)).count() == 0
    assert decontaminate.matches(docs, bench(spark, [])).count() == 0
    assert decontaminate.keep(docs, bench(spark, [])).count() == len(rows)
