import corpus_pipeline
import pyarrow as pa
import pytest
from segmill.llm import decontaminate, store, textscan, tokens, toxicity
from segmill.llm.common import table
from test_minhash import brute as near_groups
from test_secrets_and_mixing import naive as mixed
from test_toxicity import plain

SF = "/root/testdata/sf0.001"


def leaks(text, items):
    """Whether the text holds N_WORDS words of an item in a row, or a shorter item whole."""
    own = textscan.words(pa.array([text], pa.string())).hash.tolist()
    for q in items:
        if len(q) >= decontaminate.LEAST_WORDS:
            n = min(decontaminate.N_WORDS, len(q))
            grams = {tuple(q[i : i + n]) for i in range(len(q) - n + 1)}
            if any(tuple(own[i : i + n]) in grams for i in range(len(own) - n + 1)):
                return True
    return False


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """What each stage made of what its predecessor kept."""
    docs, found = table(spark, SF, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "out")
        stage(spark, docs, SF).write.parquet(path)
        found.append((name, docs, spark.read.parquet(path)))
        docs = found[-1][2]
    return {name: (before, after) for name, before, after in found}


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def texts(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def test_columns_and_order(steps):
    assert [n for n, _ in corpus_pipeline.STAGES] == list(steps)
    for name, (before, after) in list(steps.items())[:-1]:
        assert after.columns == before.columns, name
        assert after.exceptAll(before).count() == 0, name


def test_toxicity(spark, steps):
    before, after = steps["toxicity"]
    stems = toxicity.stems_of(spark, SF)
    assert ids(after) == {k for k, t in texts(before) if plain(t, stems) < toxicity.THRESHOLD}


def test_near_dedup(steps):
    before, after = steps["near_dedup"]
    gone = {k for g in near_groups(texts(before)) for k in g[1:]}
    assert gone and ids(after) == ids(before) - gone


def test_decontamination(spark, steps):
    before, after = steps["decontamination"]
    items = [textscan.words(pa.array([r["text"]])).hash.tolist() for r in table(spark, SF, "benchmark").collect()]
    gone = {k for k, t in texts(before) if leaks(t, items)}
    assert gone and ids(after) == ids(before) - gone


def test_source_mixing(steps):
    before, after = steps["source_mixing"]
    rows = [(r["doc_id"], r["text"], r["source"]) for r in before.collect()]
    assert ids(after) == {k for k, _, _ in mixed(rows)}


def test_token_store(steps):
    before, after = steps["token_store"]
    back = {r["prefix"]: tokens.encoding().decode(r["ids"]) for r in store.restored(after).where("intact").collect()}
    assert back == dict(texts(before)) and store.broken_nodes(after).count() == 0


def test_run_applies_the_stages(spark, steps):
    found = corpus_pipeline.run(spark, SF)
    last = steps["token_store"][1]
    assert found.columns == last.columns and found.count() == last.count()
    assert found.select("name").exceptAll(last.select("name")).count() == 0
    assert corpus_pipeline.ORACLE_SQL is None


STAGE_NAMES = [n for n, _ in corpus_pipeline.STAGES]


@pytest.mark.parametrize("rows", ["none", "nulls", "mixed"])
def test_stages_of_awkward_tables(spark, rows, tmp_path):
    """Empty and null-heavy tables, repeated rows, ids of any sign, a text of a megabyte, and columns that clash with the operators'."""
    from pyspark.sql import functions as F

    long = " ".join(f"w{i % 9973}x{i}" for i in range(100_000))
    some = {"none": [], "nulls": [(None, None, None), (None, None, "s"), (1, None, None), (2, "", "s")]}
    some["mixed"] = some["nulls"] + [(-5, "a short text of some words", "s"), (-5, "a short text of some words", "s"), (None, "no id here", None), (7, long, "s"), (8, long + " and more", "s"), (9, "You idiot, you moron. I will kill you!", "t")]
    docs = spark.createDataFrame([(i, t, "en", s, len(t or "")) for i, t, s in some[rows]], "doc_id long, text string, lang string, source string, n_chars long")
    for name in ("__id", "sig", "0", "__s", "mix_tier", "term", "text_", "seg"):
        docs = docs.withColumn(name, F.lit(name))
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != STAGE_NAMES[-1]:
            assert out.columns == docs.columns, name
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path) if name != STAGE_NAMES[-1] else docs
    left = [(r["doc_id"], len(r["text"] or "")) for r in docs.collect()]
    assert all(i not in (8, 9) for i, _ in left)
    stored = spark.read.parquet(path)
    assert stored.where("kind = 'recipe'").count() == len(left)
    assert {r["doc_id"] for r in stored.where("kind = 'recipe'").collect()} == {i for i, _ in left}
    if rows == "none":
        assert left == []
