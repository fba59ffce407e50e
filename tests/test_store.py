import datetime as dt
from decimal import Decimal
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T
from segmill.errors import CoercionError, SegmentError
from segmill.operators import coerce, hydrate, ordinals, scan, stats
from segmill.plans import requests
from segmill.session import work_dir
from segmill.sources.store import Store, number, segment_rows
from segmill.streaming import put


@pytest.fixture()
def path(spark):
    return work_dir(spark, "store")


def job(spark, n=6000):
    i = F.col("id")
    return spark.range(0, n, 1, 4).select(
        i.alias("id"), F.when(i % 3 != 1, (i * 2).cast("int")).alias("small"), (i * 0.5).alias("price"),
        F.when(i % 4 != 2, F.concat(F.lit("tag-"), F.lpad((i % 97).cast("string"), 3, "0"))).alias("tag"),
        F.transform(F.sequence(F.lit(0).cast("long"), i % 3), lambda j: i * 5 - j * 100).alias("scores"),
        F.when(i % 4 != 0, F.array(F.lit("b"), F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("tags"),
    )


def test_cut_between_batches(spark, path):
    assert segment_rows(1000, 2500) == 3000 and segment_rows(1000, 1000) == 1000 and segment_rows(7, 1) == 7
    rows = Store(spark, path).write(job(spark), segment_max_docs=2500, batch_rows=1000).orderBy("_seg").collect()
    assert [(r["segment"], r["max_doc"], r["del_count"]) for r in rows] == [("_0", 3000, 0), ("_1", 3000, 0)]


def test_names_go_on_in_base_36(spark, path):
    names = [r["segment"] for r in Store(spark, path).write(job(spark, 40).select("id"), segment_max_docs=1, batch_rows=1, key="id").orderBy("_seg").collect()]
    assert names[:2] == ["_0", "_1"] and names[34:39] == ["_y", "_z", "_10", "_11", "_12"]


def test_an_index_is_made_from_a_row_for_each_term_of_a_segment(spark, path):
    import pyarrow.parquet as pq
    from segmill.operators import postings

    texts = spark.range(0, 60, 1, 3).select("id", F.concat(F.lit("the and of the "), F.when(F.col("id") % 7 > 0, F.col("id").cast("string")).otherwise("")).alias("text"))
    store = Store(spark, path)
    store.write(texts, segment_max_docs=20, batch_rows=20, key="id")
    store.index("text")
    each = sorted(map(tuple, postings.postings(store.rows(), ["_seg", "_doc"], "text", unique=True).collect()))
    assert sorted(map(tuple, store.postings("text").collect())) == each
    assert postings.runs(store.rows(), "text").count() < len(each)
    for file in Path(path.removeprefix("file://")).glob("index/*/postings/*.parquet"):
        rows = [(r["term"], r["_seg"], r["_doc"]) for r in pq.read_table(file).to_pylist()]
        assert rows == sorted(rows)


def test_round_trip_is_canonical(spark, path):
    frame = job(spark, 2000)
    store = Store(spark, path)
    store.write(frame, segment_max_docs=700, batch_rows=100)
    back = store.docvalues(scan.POSITIONAL).orderBy("_global_doc").collect()
    want = coerce.coerce(frame).orderBy("id").collect()
    assert [tuple(r)[4:] for r in back] == [tuple(r) for r in want]
    assert [r["_global_doc"] for r in back] == list(range(2000)) and all(r["_live"] for r in back)
    assert back[4]["tags"] is None and back[5]["tags"] == ["a", "b"] and back[2]["scores"] == [-190, -90, 10]


def test_deletes_keep_numbers_and_values(spark, path):
    store = Store(spark, path)
    store.write(job(spark, 2000), segment_max_docs=1000, batch_rows=1000)
    first = store.commit().generation
    store.delete(spark.range(0, 1000).where("id % 9 = 4").select(F.lit(0).alias("_seg"), F.col("id").alias("_doc")))
    store.delete(spark.createDataFrame([(1, 5), (1, 5), (0, 4), (0, 5000), (9, 1)], "_seg int, _doc int"))
    assert [(s["max_doc"], s["del_count"]) for s in store.commit().segments] == [(1000, 111), (1000, 1)]
    compact, positional = store.docvalues(scan.COMPACT), store.docvalues(scan.POSITIONAL)
    assert compact.count() == 1888 and positional.count() == 2000 and positional.where("not _live").count() == 112
    assert positional.where("_seg = 0 and _doc = 13").first()["id"] == 13
    assert compact.where("_seg = 1 and _doc = 6").first()["_global_doc"] == 1006
    assert store.docvalues(scan.COMPACT, generation=first).count() == 2000  # older generations stay


def test_segments_columns_and_errors(spark, path):
    store = Store(spark, path)
    store.write(job(spark, 3000), segment_max_docs=1000, batch_rows=1000)
    picked = store.docvalues(scan.COMPACT, ["price", "id"], ["_2", "_0"])
    assert picked.columns == ["_seg", "_doc", "_global_doc", "id", "price"]
    assert {(r["_seg"], r["_global_doc"] - r["_doc"]) for r in picked.collect()} == {(2, 0), (0, 1000)}
    for bad in (lambda: store.docvalues("all"), lambda: store.docvalues(scan.COMPACT, ["nope"]), lambda: store.docvalues(scan.COMPACT, None, ["_9"]), lambda: store.write(job(spark)), lambda: store.postings("nope"), lambda: store.commit(77)):
        with pytest.raises(SegmentError):
            bad()


def test_filters_and_columns_reach_the_scan(spark, path):
    store = Store(spark, path)
    store.write(job(spark, 3000), segment_max_docs=1000, batch_rows=1000)
    plan = store.rows().where("id > 2500 and _seg = 2").select("price")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,2500)" in plan and "_seg" in plan.split("PartitionFilters")[1][:60]
    assert "tags" not in plan.split("ReadSchema")[1]


def test_append_and_fields_must_agree(spark, path):
    store = Store(spark, path)
    store.write(job(spark, 100))
    store.write(job(spark, 50), append=True)
    assert [s["max_doc"] for s in store.commit().segments] == [100, 50] and store.docvalues(scan.COMPACT).count() == 150
    with pytest.raises(SegmentError):
        store.write(spark.range(5), append=True)
    with pytest.raises(SegmentError):
        Store(spark, path + "-empty").write(job(spark, 0))


def test_index_sort(spark, path):
    store = Store(spark, path)
    store.write(spark.range(100).select("id", (F.col("id") * 37 % 101).alias("v")), segment_max_docs=50, batch_rows=50, key="id", index_sort=[("v", "desc")])
    for seg in (0, 1):
        v = [r["v"] for r in store.docvalues(scan.COMPACT).where(F.col("_seg") == seg).orderBy("_doc").collect()]
        assert v == sorted(v, reverse=True)


def test_classes(spark):
    kinds = {
        "a": (T.LongType(), "canonical"), "b": (T.ByteType(), "auto"), "c": (T.BooleanType(), "auto"), "d": (T.DoubleType(), "canonical"), "e": (T.FloatType(), "auto"),
        "f": (T.TimestampNTZType(), "auto"), "g": (T.DateType(), "auto"), "h": (T.StringType(), "auto"), "i": (T.BinaryType(), "canonical"), "j": (T.ArrayType(T.LongType()), "canonical"),
        "k": (T.ArrayType(T.StringType()), "auto"), "l": (T.ArrayType(T.FloatType()), "canonical"), "m": (T.DayTimeIntervalType(), "auto"),
    }
    for name, (kind, grade) in kinds.items():
        assert coerce.classify(T.StructField(name, kind)).grade == grade
    for kind in (T.MapType(T.StringType(), T.LongType()), T.StructType([]), T.ArrayType(T.IntegerType()), T.DecimalType(10, 2), T.DecimalType(20, 0), T.ArrayType(T.ArrayType(T.LongType()))):
        with pytest.raises(CoercionError):
            coerce.classify(T.StructField("x", kind))
    with pytest.raises(CoercionError):
        coerce.fields(T.StructType([T.StructField("s", T.StringType())]), "strict")


def test_canonical_longs(spark):
    schema = T.StructType([
        T.StructField("big", T.DecimalType(20, 0), metadata={coerce.ALLOW_LOSSY: "true"}), T.StructField("price", T.DecimalType(10, 3), metadata={coerce.SCALE_FACTOR: 100}),
        T.StructField("t", T.TimestampNTZType()), T.StructField("d", T.DateType()), T.StructField("f", T.FloatType()), T.StructField("i", T.DayTimeIntervalType()), T.StructField("b", T.BooleanType()),
    ])
    rows = [(Decimal(2**64 - 1), Decimal("1.005"), dt.datetime(2020, 1, 1, 0, 0, 1), dt.date(1970, 1, 3), 0.5, dt.timedelta(days=1, seconds=2, microseconds=7), True), (Decimal(5), Decimal("-1.005"), None, None, None, dt.timedelta(0), False)]
    found = [tuple(r) for r in coerce.coerce(spark.createDataFrame(rows, schema).coalesce(1), as_long=True).collect()]
    assert found[0] == (-1, 101, 1577836801000000, 2, 4602678819172646912, 86402000007, 1)
    assert found[1] == (5, -101, None, None, None, 0, 0)


def test_numeric_stats(spark):
    i = F.col("id")
    low = -(1 << 63)
    df = spark.range(0, 1000, 1, 5).select(
        (i * 25 + 1000).alias("gcd"), F.lit(7).cast("long").alias("const"), F.element_at(F.array(F.lit(-1000000007), F.lit(3), F.lit(900719925474)), (i % 3 + 1).cast("int")).cast("long").alias("table"),
        F.when(i % 6 == 1, -13 * i).alias("sparse"), F.lit(None).cast("long").alias("none"), F.when(i % 2 == 0, F.lit(low)).otherwise(F.lit((1 << 63) - 1)).alias("wide"),
    )
    found = {r["field"]: r for r in stats.encodings(stats.numeric_stats(df, df.columns)).collect()}
    assert "none" not in found
    get = lambda f, *names: tuple(found[f][n] for n in names)
    assert get("gcd", "min", "max", "gcd", "uniques", "encoding", "bits", "base", "divisor") == (1000, 25975, 25, None, "gcd", 12, 1000, 25)
    assert get("const", "gcd", "uniques", "encoding", "bits", "packed_bytes") == (0, [7], "const", 0, 0)
    assert get("table", "encoding", "bits", "base", "divisor") == ("table", 2, 0, 1) and found["table"]["uniques"] == [-1000000007, 3, 900719925474]
    assert get("sparse", "num_values", "gcd") == (167, 78)
    assert get("wide", "gcd", "encoding", "bits") == (1, "table", 1)
    by = stats.numeric_stats(df.withColumn("_seg", F.floor(F.col("const") / 8).cast("int")), ["gcd"], ["_seg"]).collect()
    assert len(by) == 1 and by[0]["num_values"] == 1000


def test_ordinals_and_blocks(spark):
    rows = spark.createDataFrame([(0, 0, "b"), (0, 1, "a"), (0, 2, None), (1, 0, "c"), (1, 1, "b"), (1, 2, "b"), (1, 3, "é")], "_seg int, _doc int, term string")
    assert {tuple(r) for r in ordinals.segment_dictionary(rows, "term").collect()} == {(0, 0, "a"), (0, 1, "b"), (1, 0, "b"), (1, 1, "c"), (1, 2, "é")}
    assert {tuple(r) for r in ordinals.ordinal_map(rows, "term").collect()} == {(0, 0, 0), (0, 1, 1), (1, 0, 1), (1, 1, 2), (1, 2, 3)}
    back = ordinals.decode(ordinals.encode(rows, "term"), ordinals.segment_dictionary(rows, "term"))
    assert {tuple(r) for r in back.collect()} == {tuple(r) for r in rows.collect()}


def test_number_follows_partitions(spark):
    df = spark.range(0, 1000, 1, 7)
    assert all(r["id"] == r["n"] - 5 for r in number(df, "n", 5).collect())


def test_hydrate(spark):
    docs = spark.range(500).select(F.lit(0).alias("_seg"), F.col("id").cast("int").alias("_doc"), F.concat(F.lit("doc number "), "id").alias("title"), (F.col("id") * 7).alias("weight"))
    pairs = spark.createDataFrame([(0, 0, 411), (1, 0, 3), (2, 0, 77), (3, 0, 3), (4, 1, 0)], "pos int, _seg int, _doc int")
    found = hydrate.hydrate(pairs, docs, ["title", "weight"]).orderBy("pos").collect()
    assert [r["weight"] for r in found] == [2877, 21, 539, 21, None] and found[0]["title"] == "doc number 411"
    with pytest.raises(Exception, match="no document 0 in segment 1"):
        hydrate.hydrate(pairs, docs, ["title"], check=True).collect()
    with pytest.raises(SegmentError):
        hydrate.hydrate(pairs, docs, ["nope"])


def test_unite_refuses_to_widen(spark):
    a, b = spark.range(3).select("id", F.lit(1).alias("x")), spark.range(2).select("id", F.lit("s").alias("y"))
    assert scan.unite(a, b).columns == ["id", "x", "y"] and scan.unite(a, b).where("x is null").count() == 2
    with pytest.raises(SegmentError):
        scan.unite(a, spark.range(2).select(F.col("id").cast("int")))


def test_requests(spark, path):
    manifest = requests.write(spark, {"output_dir": path, "segment_max_docs": 1000, "batch_rows": 1000}, job(spark, 2000))
    assert manifest.count() == 2
    got = requests.read(spark, '{"path": "%s", "segments": ["_1"], "columns": ["tag"], "row_mode": "compact", "frame_version": 1, "dict": {"tag": "segment"}}' % path)
    assert got.frame.columns == ["_seg", "_doc", "_global_doc", "tag", "tag_ord"] and got.frame.count() == 1000 == got.total_docs
    assert got.config["executor"] == "spark" and got.config["dict"] == {"tag": "segment"}
    assert requests.read(spark, {"path": path, "relation": "postings", "postings_field": "tag"}).frame.columns == ["_seg", "_doc", "term", "freq"]
    assert requests.read(spark, {"path": path, "relation": "stats"}).frame.count() == 12
    assert requests.read(spark, {"path": path, "relation": "inventory"}).frame.count() == 12
    everywhere = requests.read(spark, {"path": path, "row_mode": "compact", "dict": {"*": "global"}}).frame
    assert everywhere.agg(F.max("tag_ord")).first()[0] > 90
    for bad in ({"row_mode": None}, {"row_mode": "compact", "frame_version": 2}, {"row_mode": "compact", "batch_rows": -1}, {"row_mode": "compact", "segments": "some"}, {"row_mode": "compact", "relation": "x"}, {"relation": "postings"}, {"row_mode": "compact", "dict": {"*": "x"}}, {"row_mode": "compact", "what": 1}):
        with pytest.raises(SegmentError):
            requests.read(spark, {"path": path} | bad)


def test_batches_never_exceed_the_limit(spark):
    sizes = [b.num_rows for b in scan.batches(spark.range(0, 1000, 1, 3), 100)]
    assert sum(sizes) == 1000 and max(sizes) <= 100
    with pytest.raises(SegmentError):
        list(scan.batches(spark.range(3), 0))


def test_stream_is_appended_once(spark, path, tmp_path):
    source = tmp_path / "in"
    spark.range(100).coalesce(1).write.parquet(str(source))
    schema = spark.read.parquet(str(source)).schema
    check = str(tmp_path / "check")
    put.put(put.read_stream(spark, str(source), schema), path, check).awaitTermination()
    put.put(put.read_stream(spark, str(source), schema), path, check).awaitTermination()
    assert Store(spark, path).docvalues(scan.COMPACT).count() == 100
    spark.range(100, 130).coalesce(1).write.mode("append").parquet(str(source))
    put.put(put.read_stream(spark, str(source), schema), path, check).awaitTermination()
    store = Store(spark, path)
    assert store.docvalues(scan.COMPACT).agg(F.sum("id")).first()[0] == sum(range(130)) and store.commit().batch == 1


def test_an_index_serves_a_few_terms_and_later_writes(spark, path):
    """The index is read for the asked terms alone; writes without one are cut anew; both give the same postings."""
    rows = lambda a, b: spark.range(a, b).select("id", F.concat(F.lit("all the same t"), (F.col("id") % 50).cast("string")).alias("text"))
    store = Store(spark, path)
    store.write(rows(0, 400), segment_max_docs=100, batch_rows=100)
    before = sorted(map(tuple, store.postings("text").collect()))
    store.index("text")
    store.index("text")  # nothing is left to do
    assert sorted(map(tuple, store.postings("text").collect())) == before and len(before) == 1600
    plan = store.postings("text").where("term = 't7'")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(term,t7)" in plan and "Exchange" not in plan and "/data/" not in plan
    store.write(rows(400, 500), append=True, segment_max_docs=100, batch_rows=100)
    found = store.postings("text").where("term = 't7'")
    assert found.count() == 10 and store.lengths("text").count() == 500
    assert store.lengths("text").agg(F.min("length"), F.max("length")).first() == (4, 4)
    assert store.rows().count() == 500 and store.rows().columns == ["id", "text", "_doc", "_seg"]


def test_checksums_tell_changed_segments(spark, path):
    store, other = Store(spark, path), Store(spark, path + "-other")
    frame = spark.range(200).select("id", (F.col("id") * 3).alias("v"))
    store.write(frame, segment_max_docs=100, batch_rows=100, key="id")
    other.write(frame.withColumn("v", F.when(F.col("id") == 150, None).otherwise(F.col("v"))), segment_max_docs=100, batch_rows=100, key="id")
    a, b = ({r["_seg"]: (r["n"], r["checksum"]) for r in x.checksums().collect()} for x in (store, other))
    assert a[0] == b[0] and a[1][0] == b[1][0] == 100 and a[1] != b[1]


def test_no_local_folder_on_a_cluster():
    class Context:
        master = "spark://there:7077"

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(name, default=None):
                return default

    with pytest.raises(SegmentError):
        work_dir(Session(), "x")
