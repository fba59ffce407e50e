import random

import numpy as np
import pyarrow as pa
import pytest
from fixtures import corpus, frame
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from segmill.llm import counts, store, tokens
from segmill.llm.common import LEAST_ID

SIGNS = " \n\t'sdmtrevlaAé字5٣.,! 　🙂\x00\r"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=SIGNS, max_size=14), min_size=1, max_size=4))
def test_ids_equal_the_tokenizer(texts):
    ids, at = tokens.encode(pa.array(texts, pa.string()))
    for i, x in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == tokens.encoding().encode_ordinary(x)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=SIGNS, max_size=14), min_size=1, max_size=4))
def test_prefix_counts_equal_the_tokenizer(texts):
    found, at = counts.prefix_counts(pa.array(texts, pa.string()))
    for i, x in enumerate(texts):
        assert found[at[i] : at[i + 1]].tolist() == [len(tokens.encoding().encode_ordinary(x[: k + 1])) for k in range(len(x))]


def test_prefix_counts_of_words_and_long_pieces():
    rng = random.Random(2)
    texts = ["we'll'lly 'version  \n\n foo   bar 12345 http://x.y/z?q=1", "a" * 700, " " * 300 + "x", "=" * 200, "".join(rng.choice("abcdeXYZ019") for _ in range(900)), None, ""]
    found, at = counts.prefix_counts(pa.array(texts, pa.string()))
    for i, x in enumerate(texts):
        assert found[at[i] : at[i + 1]].tolist() == [len(tokens.encoding().encode_ordinary(x[: k + 1])) for k in range(len(x or ""))]


def test_counts_table(spark):
    rows = corpus()
    docs = frame(spark, rows)
    table = counts.table(docs, budgets=(10, 100))
    e = tokens.encoding()

    def size(x):
        return len(e.encode_ordinary(x))

    answered = counts.fit(counts.tokens_at(table, 17), 33)
    found = {}
    for r in answered.collect():
        found.setdefault(r["doc_id"], []).append(r)
    assert sum(map(len, found.values())) == len(rows)
    for key, text in rows:
        if key is None or text is None:
            continue
        r = found[key][0]
        assert (r["n_chars"], r["n_tokens"], r["tokens"]) == (len(text), size(text), size(text[:17]))
        for budget, got in ((10, r["fits_10"]), (33, r["fits"])):
            assert size(text[:got]) <= budget and all(size(text[:k]) > budget for k in range(got + 1, min(len(text), got + 40) + 1))
    assert {(r["n_chars"], r["n_tokens"]) for r in found[72] + found[73]} == {(0, 0)}
    assert counts.table(frame(spark, [])).count() == 0


def test_store_restores_every_text(spark):
    rows = corpus() + [(90, " ".join(f"n{i}" for i in range(5000))), (91, "prefix " + " ".join(f"n{i}" for i in range(5000)))]
    docs = frame(spark, rows)
    stored = store.store(docs).persist()
    e = tokens.encoding()
    back = {}
    for r in store.restored(stored).collect():
        assert r["intact"]
        back.setdefault(r["prefix"] if r["prefix"] >= LEAST_ID else None, []).append(e.decode(r["ids"]))
    for key, text in rows:
        assert (text or "") in back[key]
    kinds = {r["kind"]: r["count"] for r in stored.groupBy("kind").count().collect()}
    assert kinds["recipe"] == len(rows)
    assert store.broken_nodes(stored).count() == 0
    chunks = [r["name"] for r in stored.where("kind = 'chunk'").select("name").collect()]
    assert len(chunks) == len(set(chunks))
    # a shift by one token shares nearly all chunks
    parts = {r["doc_id"]: set(r["parts"]) for r in stored.where("kind = 'recipe' and doc_id in (90, 91)").collect()}
    assert len(parts[90] & parts[91]) >= len(parts[90]) - 2 > 5


def test_store_notices_damage(spark):
    stored = store.store(frame(spark, corpus()[:20])).persist()
    victim = stored.where("kind = 'chunk'").agg(F.min("name")).first()[0]
    changed = stored.withColumn("data", F.when(F.col("name") == victim, F.lit(b"xx")).otherwise(F.col("data")))
    assert store.restored(changed).where("not intact").count() >= 1
    assert store.restored(stored.where(F.col("name") != victim)).where("not intact").count() >= 1
    renamed = stored.withColumn("name", F.when((F.col("kind") == "recipe") & (F.col("doc_id") == 3), F.lit("0")).otherwise(F.col("name")))
    assert store.broken_nodes(renamed).count() >= 1
    assert store.store(frame(spark, [])).count() == 0


@pytest.mark.parametrize("n", [0, 1, 63, 64, 65, 1024, 5000])
def test_chunks_cover_the_ids(n):
    ids = np.random.default_rng(n).integers(0, 50000, 2 * n).astype(np.uint32)
    ends, per = store.chunk_ends(ids, np.array([0, n, 2 * n]))
    for d, (a, b) in enumerate(((0, n), (n, 2 * n))):
        own = ends[per[d] : per[d + 1]]
        sizes = np.diff(np.append(a, own))
        assert (own[-1] if n else a) == b if n else len(own) == 0
        assert (sizes <= store.MOST).all() and (sizes[:-1] >= store.LEAST).all()


def test_merkle_root_depends_on_order():
    assert store.merkle([b"a", b"b"]) != store.merkle([b"b", b"a"]) and store.merkle([]) != store.merkle([b"a"])
