import itertools

import pyarrow as pa
from fixtures import corpus, frame
from segmill.llm import minhash
from segmill.llm.common import row_id


def brute(rows, threshold=minhash.THRESHOLD):
    """Groups by a union-find over all pairs."""
    sets = [set(s.tolist()) for s in minhash.shingle_sets(pa.array([t for _, t in rows], pa.string()))]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if sets[i] and sets[j] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
            root[find(i)] = find(j)
    found = {}
    for i, (key, _) in enumerate(rows):
        found.setdefault(find(i), []).append(key)
    return sorted(sorted(g) for g in found.values() if len(g) > 1)


def grouped(df):
    found = {}
    for r in df.collect():
        found.setdefault(r["group_id"], []).append(r["doc_id"])
    return sorted(sorted(g, key=lambda x: (x is None, x)) for g in found.values())


def test_groups_equal_brute_force(spark):
    rows = [r for r in corpus() if r[0] is not None]
    assert grouped(minhash.groups(frame(spark, rows))) == brute(rows)


def test_groups_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert grouped(minhash.groups(docs)) == brute(rows)


def test_chain_of_hubs(spark):
    """A chain in which neighbours alone are similar is one group."""
    base = [f"t{i}" for i in range(400)]
    rows = [(i, " ".join(base[i * 20 : i * 20 + 80])) for i in range(16)]
    assert grouped(minhash.groups(frame(spark, rows))) == brute(rows) == [list(range(16))]


def test_cases(spark):
    rows = corpus()
    docs = frame(spark, rows)
    kept = minhash.keep(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] for r in kept.select("doc_id").collect()), key=str)
    for missing in (70, 71, 76, None):
        assert missing in (70, 71, 76) and missing not in ids or missing is None
    assert ids.count(78) == 2  # a repeated row stays with its document
    assert {72, 73, 74, 75, 77} <= set(ids)
    found = {(r["doc_id"], r["keep"]) for r in minhash.groups(docs).collect()}
    assert (75, True) in found and (76, False) in found and not {k for k, _ in found} & {72, 73, 74}


def test_no_rows(spark):
    empty = frame(spark, [])
    assert minhash.groups(empty).count() == 0 and minhash.keep(empty).count() == 0
    assert minhash.groups(frame(spark, [(1, None), (2, "")])).count() == 0
    assert row_id(empty) is not None
