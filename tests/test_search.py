import math

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from segmill.errors import SegmentError
from segmill.operators import bm25, knn, postings, termscan
from segmill.sources import vectorfiles


def docs(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)


def test_postings_of_two_texts(spark):
    p = postings.postings(docs(spark, ["the quick brown fox the fox", "# The *lazy* dog", "", None]))
    assert sorted(map(tuple, p.collect())) == [(0, "brown", 1), (0, "fox", 2), (0, "quick", 1), (0, "the", 2), (1, "dog", 1), (1, "lazy", 1), (1, "the", 1)]
    stats = postings.field_stats(p).first()
    assert (stats["num_terms"], stats["sum_total_freq"], stats["doc_count"], stats["min_term"], stats["max_term"]) == (6, 9, 2, "brown", "the")
    lengths = {r["doc_id"]: (r["length"], r["norm"]) for r in postings.lengths(docs(spark, ["the quick brown fox the fox", "# The *lazy* dog", "", None])).collect()}
    assert lengths == {0: (6, 6), 1: (3, 3), 2: (0, 0), 3: (0, 0)}


def test_postings_by_formula(spark):
    i = F.col("id")
    df = spark.range(3000).select(i.alias("doc_id"), F.concat(F.repeat(F.lit("common "), (i % 3 + 1).cast("int")), F.lit("mod"), i % 7, F.lit(" u"), i).alias("text"))
    p = postings.postings(df).persist()
    assert p.count() == 9000 and postings.term_stats(p).count() == 3008
    assert p.where("term = 'common' and freq <> doc_id % 3 + 1").count() == 0
    b = postings.blocks(p).where("term = 'common'").orderBy("block").collect()
    assert [(r["block"], r["n"]) for r in b[:2]] == [(0, 128), (1, 128)] and b[0]["base"] == -1 and b[1]["base"] == 127 and b[-1]["n"] == 3000 % 128
    assert postings.deltas(p).where("term = 'common' and delta <> 1").count() == 0
    ords = postings.with_ordinals(p).select("term", "ord").distinct().orderBy("ord").collect()
    assert [r["ord"] for r in ords] == list(range(3008)) and [r["term"] for r in ords] == sorted(r["term"] for r in ords)


def test_bm25_by_formula(spark):
    texts = [f"# doc{i} common" + " alpha alpha" * (i % 3 == 0) + " beta" * (i % 7 == 0) + " gamma gamma gamma" * (i % 97 == 0) for i in range(1000)]
    table = docs(spark, texts)
    queries = {"g": ["gamma"], "ab": ["alpha", "beta"], "cg": ["common", "gamma"], "twice": ["beta", "beta"], "none": ["zzz"]}
    words = [t.replace("#", "").split() for t in texts]
    mean = sum(map(len, words)) / len(words)

    def score(i, q):
        total = 0.0
        for t in q:
            tf, df = words[i].count(t), sum(t in w for w in words)
            if tf:
                total += math.log(1 + (1000 - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * len(words[i]) / mean))
        return total

    found = bm25.scores(table, queries).collect()
    assert {r["qid"] for r in found} == {"g", "ab", "cg", "twice"}
    for r in found[::37]:
        assert r["score"] == pytest.approx(score(r["doc_id"], queries[r["qid"]]), rel=1e-9)
    assert sum(r["qid"] == "ab" for r in found) == sum("alpha" in w or "beta" in w for w in words)
    top = bm25.search(table, queries, 7)
    assert top.where("qid = 'g'").count() == 7 and [r["doc_id"] for r in top.where("qid = 'g'").orderBy("rank").collect()] == sorted((97 * k for k in range(11)), key=lambda i: (-round(score(i, ["gamma"]), 9), i))[:7]
    index = bm25.scores_of_index(postings.postings(table), postings.lengths(table), queries)
    assert {(r["qid"], r["doc_id"]): round(r["score"], 9) for r in index.collect()} == {(r["qid"], r["doc_id"]): round(r["score"], 9) for r in found}
    with pytest.raises(SegmentError):
        bm25.search(table, queries, 0)


def test_counts_take_little_memory():
    import tracemalloc

    batch = pa.RecordBatch.from_arrays([pa.array(["alpha beta gamma " * 1000] * 500)], ["text"])
    termscan.counts(pa.array(["a"]))  # the table of code points
    tracemalloc.start()
    assert sum(int(termscan.counts(part.column(0)).sum()) for part in termscan.bounded(batch, 0)) == 1_500_000
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 60e6


@pytest.mark.parametrize("n", [126, 127, 128, 129, 255, 256])
def test_counts_leave_out_what_cut_leaves_out(n):
    texts = pa.array(["x" * n + " a", "Ⱥ" * (n // 2) + " İ" + "İ" * (n // 2), None, "", "é" * n])
    assert termscan.counts(texts).tolist() == np.bincount(termscan.cut(texts)[0], minlength=5).tolist()


@pytest.mark.parametrize("metric", ["euclidean", "dot", "cosine"])
def test_knn_equals_brute_force(spark, metric, monkeypatch):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((200, 12)).astype(np.float32)
    x[5] = 0
    x[7] = x[9]
    table = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), (900, None), (901, [1.0])], "vec_id long, embedding array<float>").repartition(4)
    asked = table.where("vec_id in (7, 20, 30)").withColumnRenamed("vec_id", "qid")
    for small in (False, True):
        if small:
            monkeypatch.setattr(knn, "QUERY_BYTES", 100)  # a job for each block of queries
        found = {}
        for r in knn.knn(table, asked, 6, metric).orderBy("qid", "rank").collect():
            found.setdefault(r["qid"], []).append(r["id"])
        for q in (7, 20, 30):
            s = np.round(knn.similarities(x.astype(float), x[q : q + 1].astype(float), metric)[0], knn.PLACES)
            assert found[q] == sorted(range(200), key=lambda i: (-s[i], i))[:6]
    for bad in (lambda: knn.knn(table, asked, 0), lambda: knn.knn(table, asked, 3, "x")):
        with pytest.raises(SegmentError):
            bad()
    assert knn.knn(table, asked.where("false"), 3).count() == 0 and knn.knn(table.where("false"), asked, 3).count() == 0


def test_graph_does_not_depend_on_blocks(spark):
    rng = np.random.default_rng(2)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.standard_normal((150, 8)))], "vec_id long, embedding array<float>")
    one, many = (sorted(map(tuple, knn.knn_graph(table, 5, block_rows=n).collect())) for n in (4096, 40))
    assert one == many and len(one) == 750 and all(node != other for node, _, other, _ in one)


def test_vectors_meet_by_blocks(spark):
    """No product of tables: vectors go to the tasks of their block, and to each once."""
    table = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(60)], "vec_id long, embedding array<float>")
    asked = table.where("vec_id < 20").withColumnRenamed("vec_id", "qid")
    for found in (knn.knn_graph(table, 3, block_rows=20), knn.approximate(table, asked, 3, cells=4, probes=2)):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Cartesian" not in plan and "Join" not in plan and "Window" not in plan
        assert found.groupBy(found.columns[0]).count().where("count <> 3").count() == 0


def test_a_vector_that_is_no_number_hides_no_other(spark):
    x = np.random.default_rng(6).standard_normal((100, 4))
    table = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), (500, [float("nan"), 0.0, 0.0, 0.0])], "vec_id long, embedding array<float>").coalesce(1)
    found = knn.knn(table, table.where("vec_id < 5").withColumnRenamed("vec_id", "qid"), 3).collect()
    assert len(found) == 15 and {r["id"] for r in found if r["rank"] == 1} == set(range(5))
    assert knn.knn_graph(table, 3).where("node < 500 and neighbor < 500").count() == 300


@pytest.mark.parametrize("metric", ["euclidean", "dot", "cosine"])
def test_blocks_in_memory_equal_brute_force(metric, monkeypatch):
    from segmill.operators import nearest

    monkeypatch.setattr(nearest, "TILE", 64)
    monkeypatch.setattr(nearest, "NOTED", 500)
    rng = np.random.default_rng(3)
    a, b = rng.standard_normal((150, 6)).astype(np.float32), rng.standard_normal((333, 6)).astype(np.float32)
    a[3], b[5], b[10:60], a[20:30] = 0, 0, b[9], a[19]
    ids, others = rng.permutation(1000)[:150], rng.permutation(1000)[:333]
    others[7] = others[8]
    for k in (1, 70, 400):
        x, y = (nearest.Block(i, v, np.zeros(len(i)), metric) for i, v in ((ids, a), (others, b)))
        for own, other, found in zip((x, y), (y, x), nearest.nearest(x, y, metric, k, True, True)):
            s = np.round(knn.similarities(other.x.astype(float), own.x.astype(float), metric), knn.PLACES)
            s[own.ids[:, None] == other.ids[None, :]] = -np.inf
            for q in range(len(own.ids)):
                best = [i for i in np.lexsort((other.ids, -s[q]))[:k] if s[q][i] > -np.inf]
                assert found[1][found[0] == q].tolist() == other.ids[best].tolist()


def test_many_queries_take_no_more_memory():
    import tracemalloc

    from segmill.operators import nearest

    rng = np.random.default_rng(5)
    queries, vectors = (nearest.Block(np.arange(n), rng.standard_normal((n, 8)).astype(np.float32), np.zeros(n), "cosine") for n in (8000, 10_000))
    tracemalloc.start()
    nearest.nearest(queries, vectors, "cosine", 10, False)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 200e6  # all products at once are 640 MB


def test_approximate_looks_at_the_nearest_cells(spark):
    x = np.random.default_rng(8).standard_normal((400, 5)).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    asked = table.where("vec_id % 8 = 0").withColumnRenamed("vec_id", "qid")
    one, every = (knn.approximate(table, asked, 4, cells=6, probes=n).collect() for n in (1, 6))
    assert sorted(map(tuple, every)) == sorted(map(tuple, knn.knn(table, asked, 4).collect()))
    assert len(one) == 200 and 0 < len(set(map(tuple, one)) & set(map(tuple, every))) < 200


def test_navigable_graph_is_connected(spark):
    rng = np.random.default_rng(2)
    clusters = np.repeat(rng.standard_normal((5, 8)) * 50, 20, axis=0) + rng.standard_normal((100, 8))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(clusters)], "vec_id long, embedding array<float>")
    edges = {}
    for r in knn.navigable_graph(knn.knn_graph(table, 4), 100, 8).collect():
        edges.setdefault(r["node"], []).append(r["neighbor"])
    assert all(len(v) <= 8 and len(set(v)) == len(v) and u not in v for u, v in edges.items())
    seen, todo = {0}, [0]
    while todo:
        for v in edges[todo.pop()]:
            if v not in seen:
                seen.add(v)
                todo.append(v)
    assert len(seen) == 100


def test_inline_vectors(spark, tmp_path):
    header, dims, degree = 64, 3, 2
    head = np.zeros(header // 4, ">i4")
    head[[0, 3, 5, 6]] = (77, dims, degree, 4)
    body = b""
    for node, v in ((0, [1, 2, 3]), (-1, [9, 9, 9]), (2, [4, 5, 6]), (3, [7, 8, 9])):
        body += np.array([node], ">i4").tobytes() + np.array(v, ">f4").tobytes() + np.array([1, 0, 0], ">i4").tobytes()
    (tmp_path / "a.graph").write_bytes(head.tobytes() + body)
    found = vectorfiles.inline_vectors(spark, str(tmp_path), header, 77).orderBy("ord").collect()
    assert [(r["ord"], r["vector"]) for r in found] == [(0, [1, 2, 3]), (1, [4, 5, 6]), (2, [7, 8, 9])]
    (tmp_path / "a.graph").write_bytes(head.tobytes() + body[:-4])
    with pytest.raises(Exception, match="cut short"):
        vectorfiles.inline_vectors(spark, str(tmp_path), header).collect()


def test_hierarchy(spark, tmp_path):
    most, most0, size = 2, 4, 4 + 4 * 4 + 8 + 8
    head = bytearray(96)
    for at, v in ((16, 3), (24, size), (32, size - 8), (56, most), (64, most0)):
        head[at : at + 8] = v.to_bytes(8, "little")
    labels, links = [10, 11, 12], [[1, 2], [0], [0, 1]]
    body = b""
    for label, ls in zip(labels, links):
        body += len(ls).to_bytes(4, "little") + b"".join(x.to_bytes(4, "little") for x in [*ls, 0, 0, 0, 0][:4]) + bytes(8) + label.to_bytes(8, "little")
    block = (1).to_bytes(4, "little") + (2).to_bytes(4, "little") + bytes(4)
    body += (12).to_bytes(4, "little") + block + (0).to_bytes(4, "little") + (0).to_bytes(4, "little")
    (tmp_path / "h.bin").write_bytes(bytes(head) + body)
    found = sorted((r["level"], r["node"], r["neighbors"]) for r in vectorfiles.hierarchy(spark, str(tmp_path)).collect())
    assert found == [(0, 10, [11, 12]), (0, 11, [10]), (0, 12, [10, 11]), (1, 10, [12])]


def test_lines_are_documents(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\n\nfour\n")
    assert [tuple(r) for r in vectorfiles.text_lines(spark, str(tmp_path)).orderBy("doc_id").collect()] == [(0, "one"), (1, "two"), (2, ""), (3, "four")]


def test_lengths_are_a_map_and_unique_rows_keep_their_postings(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, ""), (4, "B c"), (-7, "c " * 300)], "doc_id long, text string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(postings.lengths(docs)) and "Aggregate" not in plan(postings.postings(docs, unique=True))
    want = {(1, "a", 2), (1, "b", 1), (4, "b", 1), (4, "c", 1), (-7, "c", 300)}
    assert {tuple(r) for r in postings.postings(docs, unique=True).collect()} == {tuple(r) for r in postings.postings(docs).collect()} == want
    assert postings.postings(docs.where("doc_id > 9"), unique=True).count() == 0


def test_many_query_terms_are_joined(spark, monkeypatch):
    docs = spark.createDataFrame([(i, " ".join(f"t{i * j % 23}" for j in range(9))) for i in range(60)], "doc_id long, text string")
    asked = {f"q{i}": [f"t{i}", f"t{i + 3}"] for i in range(12)}
    few = {(r["qid"], r["doc_id"]): r["score"] for r in bm25.scores(docs, asked).collect()}
    monkeypatch.setattr(bm25, "PLAN_TERMS", 3)
    many = {(r["qid"], r["doc_id"]): r["score"] for r in bm25.scores(docs, asked).collect()}
    assert few.keys() == many.keys() and all(abs(few[k] - many[k]) < 1e-9 for k in few) and len(few) > 100


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="aZ9 \n-ÉéΣσςİı字٣²🙂ß\u0301\u0903", max_size=12)), max_size=6))
def test_batches_are_cut_by_the_rule(texts):
    """Runs of letters and numbers of each text, each letter lowered by itself."""
    import unicodedata

    row, code, terms = termscan.cut(pa.array(texts, pa.string()))
    found = list(zip(row.tolist(), terms.take(pa.array(code)).to_pylist()))
    want = []
    for i, text in enumerate(texts):
        marked = "".join(c if unicodedata.category(c)[0] in "LN" else " " for c in text or "")
        want += [(i, "".join(c.lower() for c in w)) for w in marked.split(" ") if w]
    assert found == want
    assert termscan.counts(pa.array(texts, pa.string())).tolist() == [sum(i == k for i, _ in want) for k in range(len(texts))]


def test_long_tokens_and_slices():
    texts = pa.array(["drop " + "z" * 256, "z" * 255, None, "", "aé" * 127 + "x é"])
    row, code, terms = termscan.cut(texts)
    assert row.tolist() == [0, 1, 4] and terms[code[2]].as_py() == "é"
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), texts], ["k", "t"])
    assert [b.column(0).to_pylist() for b in termscan.bounded(batch.slice(1, 4), 1)] == [[1, 2, 3, 4]]
