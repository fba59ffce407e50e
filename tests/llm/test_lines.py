import random

from fixtures import corpus, frame
from hypothesis import given, settings
from hypothesis import strategies as st
from segmill.llm import lines, queries


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 6), max_size=14), st.lists(st.integers(0, 6), max_size=14))
def test_alignment_is_common_and_increasing(a, b):
    found = lines.patience(a, b)
    assert all(a[i] == b[j] for i, j in found)
    assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(found, found[1:]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 60), unique=True, max_size=30), st.lists(st.integers(0, 60), unique=True, max_size=30))
def test_unique_lines_align_longest(a, b):
    """Of unique lines alone the alignment is a longest common subsequence."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    assert len(lines.patience(a, b)) == best[-1][-1]


def aligned(a, b):
    """Patience diff by its definition: lists of (place, line), recursive, the anchors by a table of longest common subsequences."""
    if not a or not b:
        return []
    if a[0][1] == b[0][1]:
        return [(a[0][0], b[0][0]), *aligned(a[1:], b[1:])]
    if a[-1][1] == b[-1][1]:
        return [*aligned(a[:-1], b[:-1]), (a[-1][0], b[-1][0])]
    x, y = [h for _, h in a], [h for _, h in b]
    once = {h for h in x if x.count(h) == 1 and y.count(h) == 1}
    u, v = [i for i, h in enumerate(x) if h in once], [j for j, h in enumerate(y) if h in once]
    best = [[0] * (len(v) + 1) for _ in range(len(u) + 1)]
    for i in reversed(range(len(u))):
        for j in reversed(range(len(v))):
            best[i][j] = 1 + best[i + 1][j + 1] if x[u[i]] == y[v[j]] else max(best[i + 1][j], best[i][j + 1])
    if not best[0][0]:
        return []
    out, i, j, p, q = [], 0, 0, 0, 0
    while i < len(u) and j < len(v):
        if x[u[i]] == y[v[j]]:
            out += [*aligned(a[p : u[i]], b[q : v[j]]), (a[u[i]][0], b[v[j]][0])]
            p, q, i, j = u[i] + 1, v[j] + 1, i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out + aligned(a[p:], b[q:])


def whole(rows, align=aligned):
    """Aligns each document with every earlier one."""
    docs = dict(sorted(rows))
    parts = {k: [(i, x.strip(" ")) for i, x in enumerate((t or "").split("\n")) if x.strip(" ")] for k, t in docs.items()}
    held = {}
    for k, own in parts.items():
        for _, x in own:
            held.setdefault(x, set()).add(k)
    shared = {k: [(i, x) for i, x in own if len(held[x]) > 1] for k, own in parts.items()}
    result = {}
    for k, text in docs.items():
        gone = {i for p in docs if p < k for i, _ in align(shared[k], shared[p])}
        result[k] = text if text is None else "\n".join(x for i, x in enumerate(text.split("\n")) if i not in gone)
    return result


def fast(a, b):
    return [(a[i][0], b[j][0]) for i, j in lines.patience([x for _, x in a], [x for _, x in b])]


def test_dedup_equals_brute_force(spark):
    rng = random.Random(4)
    pool = [f"line {i}" for i in range(60)]
    rows = []
    for i in range(30):
        own = [rng.choice(pool) if rng.random() < 0.5 else f"own {rng.random()}" for _ in range(rng.randrange(1, 15))]
        if i > 5 and rng.random() < 0.4:
            own += rows[rng.randrange(i)][1].split("\n")[1:6]
        rows.append((i, "\n".join(own)))
    rows += [(30, None), (31, ""), (32, "\n\n"), (33, rows[2][1]), (34, "  " + rows[7][1])]
    found = {r["doc_id"]: r["text"] for r in lines.dedup(frame(spark, rows)).collect()}
    assert found == whole(rows, fast)
    assert found[33] == "" and found[32] == "\n\n" and found[31] == "" and found[30] is None


def test_blocks(spark):
    text = "\n".join(f"line {i}" for i in range(10))
    rows = [(1, text), (2, "new\n" + "\n".join(f"line {i}" for i in range(3, 7)) + "\nmore"), (3, "line 8\nline 2")]
    found = sorted(map(tuple, lines.blocks(frame(spark, rows)).collect()))
    assert found[0] == (2, 1, 1, 3, 4)
    assert [f[:2] + f[4:] for f in found[1:]] == [(3, 1, 1)]  # of two lines in another order, one is aligned


def test_cases(spark):
    rows = corpus()
    found = lines.dedup(frame(spark, rows)).collect()
    assert len(found) == len(rows)
    assert {r["n_deleted"] for r in found if r["doc_id"] in (72, 73, 74)} == {0}
    assert lines.dedup(frame(spark, [])).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 12), max_size=12), st.lists(st.integers(0, 12), unique=True, max_size=12))
def test_as_many_lines_as_the_definition_aligns(a, b):
    """Where longest runs of anchors tie, another one may be taken, and gaps then differ; lines unique in both align as many."""
    if len(set(a)) == len(a):
        assert len(lines.patience(a, b)) == len(aligned(list(enumerate(a)), list(enumerate(b))))


def test_documents_without_ties_equal_the_definition(spark):
    """Shared lines are unique in each document and stand in the order of the pool, but for swapped neighbours that others hold."""
    rng = random.Random(2)
    rows = []
    for i in range(25):
        own = sorted(rng.sample(range(50), rng.randrange(1, 12)))
        rows.append((i - 5, "\n".join(f"line {x}" if rng.random() < 0.8 else f"own {i} {x}" for x in own)))
    rows += [(30, "line 1 \nline 2"), (31, None), (32, "")]
    found = {r["doc_id"]: r["text"] for r in lines.dedup(frame(spark, rows)).collect()}
    assert found == whole(rows)


def test_one_line_in_every_document(spark):
    """A line that all documents hold, more than are rare, and lines of few."""
    from pyspark.sql import functions as F

    n = 20_000
    text = F.concat(F.lit("All rights reserved.\nown "), F.col("id"), F.lit("\npair "), F.floor(F.col("id") / 2))
    docs = spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"))
    found = lines.dedup(docs).groupBy("n_deleted").count().collect()
    assert {r["n_deleted"]: r["count"] for r in found} == {0: 1, 1: n // 2 - 1, 2: n // 2}


def test_every_earlier_holder_is_tried(spark):
    """The earliest holder repeats the hot lines or has them in another order; others of many don't."""
    rng = random.Random(9)
    hot = [f"hot {i}" for i in range(6)]
    rows = [(0, "\n".join([*hot[::-1], *hot]))]
    for i in range(1, 60):
        own = [rng.choice(hot) if rng.random() < 0.5 else f"line {rng.randrange(40)}" for _ in range(rng.randrange(1, 12))]
        rows.append((i, "\n".join(own)))
    rows += [(60, "hot 1\nhot 0"), (61, "hot 0\nx\nhot 1"), (62, None), (63, rows[7][1])]
    found = {r["doc_id"]: r["text"] for r in lines.dedup(frame(spark, rows)).collect()}
    assert found == whole(rows, fast)


def test_the_query_tries_every_holder(spark, tmp_path):
    rows = [(1, "b\na"), (2, "a"), (3, "b"), (4, "a\nb")]  # of 4, document 1 aligns one line alone
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    assert {r["doc_id"]: r["n_deleted"] for r in queries.op6_line_dedup(spark, str(tmp_path)).collect()} == {1: 0, 2: 1, 3: 1, 4: 2}


def test_texts_are_shuffled_to_a_large_table_alike(spark, monkeypatch):
    """What is deleted is broadcast or shuffled to by its size; the result is the same."""
    from segmill.llm import common

    rows = [(i, f"one\nline {i % 7}\nown {i}") for i in range(60)] + [(None, "one"), (90, None)]
    small = {tuple(r) for r in lines.dedup(frame(spark, rows)).collect()}
    monkeypatch.setattr(common, "BROADCAST_BYTES", -1)
    assert {tuple(r) for r in lines.dedup(frame(spark, rows)).collect()} == small and len(small) == 62
