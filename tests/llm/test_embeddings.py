import numpy as np
import pytest
from segmill.llm import embeddings

SCHEMA = "vec_id long, embedding array<float>, label int, a long, b long, id string, v int, code string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 2, "x", 3, "y") for i, v in rows], SCHEMA).repartition(3)


def counted(found):
    return {r["vec_id"]: r["n_links"] for r in found}


def compare(df, rows, least=0.9):
    """No row has more links than there are, all rows together have at least their share, and classes hold together."""
    found = df.collect()
    want = {}
    for a, b in brute(rows):
        want[a], want[b] = want.get(a, 0) + 1, want.get(b, 0) + 1
    got = counted(found)
    assert set(got) <= set(want) and all(got[i] <= want[i] for i in got)
    assert sum(got.values()) >= least * sum(want.values()) > 0
    parts = {}
    for r in found:
        parts.setdefault(r["class_id"], []).append(r["vec_id"])
    root = {i: i for i in want}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in brute(rows):
        root[find(a)] = find(b)
    assert all(len({find(i) for i in own}) == 1 and min(own) == key for key, own in parts.items())
    return got, want


def brute(rows, threshold=embeddings.THRESHOLD):
    ids = [i for i, _ in rows]
    x = np.array([v for _, v in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    g = x @ x.T
    return {(min(ids[i], ids[j]), max(ids[i], ids[j])) for i, j in zip(*np.nonzero(np.triu(g >= threshold, 1))) if ids[i] != ids[j]}


def test_recall_against_brute_force(spark):
    """At each distance near the threshold, at least nine in ten pairs are found and no false ones."""
    rng = np.random.default_rng(1)
    base = rng.standard_normal((300, 64))
    rows = list(base)
    for cosine in (0.955, 0.965, 0.98, 0.995):
        for v in base[:100]:
            u = v / np.linalg.norm(v)
            w = rng.standard_normal(64)
            w -= w @ u * u
            rows.append(cosine * u + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(rows)]
    got, want = compare(embeddings.classes(table(spark, rows)), rows)
    for lowest in (300, 400, 500, 600):
        own = [i for i in want if lowest <= i < lowest + 100]
        assert sum(got.get(i, 0) for i in own) >= 0.9 * sum(want[i] for i in own) > 0


@pytest.mark.parametrize("length", [0.7, 0.85, 0.92])
def test_recall_with_a_strong_common_mean(spark, length):
    """Vectors around one direction, of this mean length; half of them have a partner just above the threshold."""
    rng = np.random.default_rng(2)
    base = rng.standard_normal((600, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    base = length * np.eye(64)[0] + np.sqrt(1 - length**2) * base
    rows = list(base)
    for v in base:
        u = v / np.linalg.norm(v)
        w = rng.standard_normal(64)
        w -= w @ u * u
        cosine = rng.uniform(0.951, 0.96)
        rows.append(cosine * u + np.sqrt(1 - cosine**2) * w / np.linalg.norm(w))
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(rows)]
    compare(embeddings.classes(table(spark, rows)), rows)


def test_the_radius_stays_without_a_common_mean():
    assert embeddings.reach_of(embeddings.RADIUS, 64, embeddings.THRESHOLD, 0.99) == embeddings.RADIUS
    assert embeddings.reach_of(embeddings.RADIUS, 64, embeddings.THRESHOLD, 0.0) == 64


def test_the_table_with_near_copies(spark):
    """All vectors of the table, and copies of some of them with noise, in groups of many sizes."""
    rng = np.random.default_rng(4)
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    at = max(i for i, _ in rows) + 1
    for k, size in enumerate((1, 1, 1, 2, 3, 5, 40, 200)):
        v = np.array(rows[7 * k][1])
        for _ in range(size):
            noise = rng.standard_normal(len(v))
            rows.append((at, (v + 0.12 * np.linalg.norm(v) * noise / np.linalg.norm(noise)).tolist()))
            at += 1
    rows += [(at + i, rows[3][1]) for i in range(4)]
    got, want = compare(embeddings.classes(table(spark, rows)), rows, 0.99)
    assert len(want) > 250


def test_sql_agrees(spark, tmp_path):
    """The query's SQL gives the same classes and links for a table with near copies."""
    import duckdb
    from segmill.llm import queries

    rng = np.random.default_rng(8)
    base = rng.standard_normal((40, 64))
    rows = [(i, (base[i % 40] + (0.1 if i >= 40 else 0) * rng.standard_normal(64)).tolist()) for i in range(90)]
    table(spark, rows).select("vec_id", "embedding").write.parquet(str(tmp_path / "embeddings.parquet"))
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = con.sql(f"select vec_id, class_id, n_class, n_links from ({queries.ORACLE_SQL['op5_embedding_dedup']})").fetchall()
    found = queries.op5_embedding_dedup(spark, str(tmp_path)).select("vec_id", "class_id", "n_class", "n_links").collect()
    assert sorted(map(tuple, found)) == sorted(want) and len(want) > 60


def test_blocks_of_hot_cells_and_buckets(spark, monkeypatch):
    """The same links where cells and buckets are cut into blocks."""
    rng = np.random.default_rng(6)
    base = rng.standard_normal((30, 32))
    rows = [(i, (base[i % 30] + 0.12 * rng.standard_normal(32)).tolist()) for i in range(240)]
    whole = {tuple(r) for r in embeddings.classes(table(spark, rows)).collect()}
    monkeypatch.setattr(embeddings, "BLOCK", 3)
    monkeypatch.setattr(embeddings, "HOT", 4)
    assert {tuple(r) for r in embeddings.classes(table(spark, rows)).collect()} == whole and len(whole) > 100


def test_many_equal_vectors(spark):
    """A hundred thousand equal vectors and as many scaled ones finish, each with all the others as links."""
    from pyspark.sql import functions as F

    v = F.transform(F.sequence(F.lit(1), F.lit(16)), lambda i: F.sin(i * F.col("k")).cast("float"))
    t = spark.range(100_000).select(F.col("id").alias("vec_id"), F.when(F.col("id") < 99_990, 1).otherwise(F.col("id")).alias("k")).withColumn("embedding", v)
    found = embeddings.classes(t).agg(F.count("*"), F.min("n_links"), F.max("n_links"), F.max("class_id")).first()
    assert tuple(found)[:3] == (99_990, 99_989, 99_989) and found[3] == 0


def test_cases(spark):
    rng = np.random.default_rng(3)
    v = [x.tolist() for x in rng.standard_normal((8, 16))]
    rows = [(1, v[0]), (2, v[0]), (2, v[0]), (3, None), (4, []), (5, [0.0] * 16), (6, [float("nan")] * 16), (7, v[1][:15]), (None, v[0]), (8, v[2]), (9, [None, *v[3][1:]]), (10, [2 * x for x in v[2]]), (11, v[5])]
    t = table(spark, rows)
    found = sorted(tuple(r) for r in embeddings.classes(t).collect())
    assert found == [(1, 1, 3, 2), (2, 1, 3, 2), (2, 1, 3, 2), (8, 8, 2, 1), (10, 8, 2, 1)]
    kept = embeddings.keep(t)
    assert kept.columns == t.columns
    assert sorted((r["vec_id"] for r in kept.select("vec_id").collect()), key=str) == sorted([1, 3, 4, 5, 6, 7, None, 8, 9, 11], key=str)
    assert embeddings.classes(table(spark, [])).count() == 0 and embeddings.classes(table(spark, [(1, v[0])])).count() == 0


def test_tables_have_few_keys_and_hold_the_radius():
    """Up to KEYS keys a code for any number of codes; where the radius is promised, all codes within it meet."""
    rng = np.random.default_rng(5)
    for n in (100, 10_000, 50_000, 10**6, 10**7, 10**9):
        masks, reach = embeddings.tables(n, 64)
        assert sum(len(embeddings.flips(m, reach)) for m in masks) <= embeddings.KEYS
        met = {radius: 0 for radius in (embeddings.RADIUS, 7)}
        for radius in met:
            for _ in range(300):
                bits = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
                met[radius] += any((bits & m).bit_count() <= 2 * reach for m in masks)
        assert met[7] >= 0.9 * 300
        assert n > 50_000 or met[embeddings.RADIUS] == 300


def at_cosines(rng, base, cosines):
    """For each vector one at its cosine."""
    u = base / np.linalg.norm(base, axis=1, keepdims=True)
    w = rng.standard_normal(base.shape)
    w -= (w * u).sum(1, keepdims=True) * u
    c = np.asarray(cosines)[:, None]
    return c * u + np.sqrt(1 - c**2) * w / np.linalg.norm(w, axis=1, keepdims=True)


@pytest.mark.parametrize("tile", [None, 256])
def test_every_link_at_the_threshold(spark, monkeypatch, tile):
    """no link just above the threshold is lost, in one tile or in many, and none below it is made."""
    if tile:
        monkeypatch.setattr(embeddings, "TILE", tile)
    rng = np.random.default_rng(12)
    base = rng.standard_normal((2000, 64))
    rows = [*base, *at_cosines(rng, base, np.linspace(0.9498, 0.9515, 2000)), *rng.standard_normal((300, 64))]
    rows = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(rows)]
    got, want = compare(embeddings.classes(table(spark, rows)), rows, 1.0)
    assert got == want and 3000 < len(want) < 4000


def test_tiles_that_are_ruled_out_hold_no_links(spark, monkeypatch):
    """narrow groups in few dimensions, so that boxes lie apart, have all their links."""
    monkeypatch.setattr(embeddings, "TILE", 16)
    rng = np.random.default_rng(13)
    centres = rng.standard_normal((40, 12)) * np.array([8.0, 4, 2, *[1] * 9])
    rows = [(i, (centres[i % 40] + 0.35 * rng.standard_normal(12)).astype(np.float32).tolist()) for i in range(1200)]
    got, want = compare(embeddings.classes(table(spark, rows)), rows, 1.0)
    assert got == want


def test_tables_keep_the_radius_at_every_size():
    """the number of codes changes the tables' keys, never which codes meet."""
    rng = np.random.default_rng(14)
    for n in (10, 92_000, 93_000, 10**6, 10**9):
        for bits, radius in ((64, 7), (64, embeddings.RADIUS), (64, 20), (64, 30), (32, 11), (16, 11)):
            masks, reach = embeddings.tables(n, bits, radius)
            for _ in range(100):
                differ = sum(1 << int(b) for b in rng.choice(bits, radius, replace=False))
                assert any((differ & m).bit_count() <= 2 * reach for m in masks)


def test_a_radius_given_by_the_caller(spark, monkeypatch):
    """Codes within a radius: nine in ten links, and the same where cells and buckets are cut into blocks."""
    rng = np.random.default_rng(15)
    base = rng.standard_normal((30, 64))
    rows = [(i, (base[i % 30] + 0.12 * rng.standard_normal(64)).tolist()) for i in range(240)]
    near = lambda: embeddings.classes(table(spark, rows), radius=embeddings.RADIUS)
    got, want = compare(near(), rows)
    whole = {tuple(r) for r in near().collect()}
    monkeypatch.setattr(embeddings, "BLOCK", 3)
    monkeypatch.setattr(embeddings, "HOT", 4)
    assert {tuple(r) for r in near().collect()} == whole and len(whole) > 100
