import struct
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from segmill.functions import numeric, text, vector


def test_tokens_of_markdown_and_unicode(spark):
    rows = [("# Hello, *World*! `code_x` [link](http://a.b/c)",), ("Ünïcode ΣΙΓΜΑ 42x",), ("ΟΔΟΣ ½ Ⅷ ²",), ("z" * 300 + " y",), ("",), (None,), ("İx",)]
    found = [r[0] for r in spark.createDataFrame(rows, "t string").coalesce(1).select(text.tokens("t")).collect()]
    assert found[0] == ["hello", "world", "code", "x", "link", "http", "a", "b", "c"]
    assert found[1] == ["ünïcode", "σιγμα", "42x"]
    assert found[2] == ["οδοσ", "½", "ⅷ", "²"]
    assert found[3] == ["y"] and found[4] == [] and found[5] is None
    assert found[6] == ["i̇x"]


def test_token_limit_is_in_bytes(spark):
    rows = [("é" * 127,), ("é" * 128,)]
    assert [r[0] for r in spark.createDataFrame(rows, "t string").coalesce(1).select(text.token_count("t")).collect()] == [1, 0]


def encode(n):
    """A length's byte, with the arithmetic of small floats."""
    if n < 24:
        return max(n, 0)
    rest = n - 24
    bits = rest.bit_length()
    if bits < 4:
        return 24 + rest
    shift = bits - 4
    return 24 + ((rest >> shift) & 7 | (shift + 1) << 3)


def test_norms(spark):
    df = spark.range(-3, 70000).select("id", text.norm_byte("id").alias("b"), text.norm_length("id").alias("kept")).withColumn("back", text.norm_decode("b"))
    rows = df.collect()
    assert all(r["b"] == encode(r["id"]) and r["back"] == r["kept"] <= max(0, r["id"]) for r in rows)
    kept = [r["kept"] for r in rows]
    assert kept == sorted(kept)


def test_names_and_prefixes(spark):
    df = spark.createDataFrame([("abc", "abd", 0), ("", "a", 35), ("ab", "abcd", 36), ("same", "same", 46655), ("é", "è", 46656), ("a", "", 5)], "a string, b string, n long").coalesce(1)
    found = df.select(text.common_prefix("a", "b").alias("p"), text.sort_key_length("a", "b").alias("k"), text.base36("n").alias("n")).collect()
    assert [(r["p"], r["k"]) for r in found] == [(2, 3), (0, 1), (2, 3), (4, 4), (1, 2), (0, 0)]
    assert [r["n"] for r in found] == ["0", "z", "10", "zzz", "1000", "5"]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.floats(allow_nan=False), min_size=1, max_size=20))
def test_float_bits(spark, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i long, v double").withColumn("b", numeric.float_bits("v")).withColumn("back", numeric.bits_float("b"))
    for r in df.collect():
        assert r["b"] == struct.unpack("<q", struct.pack("<d", values[r["i"]]))[0] and r["back"] == values[r["i"]]


def test_float_bits_of_null(spark):
    assert spark.createDataFrame([(None,), (float("nan"),)], "v double").select(numeric.float_bits("v")).distinct().collect() == [(None,)]


def test_widths(spark):
    values = [0, 1, 2, 3, 4, 15, 16, 255, 256, (1 << 31) - 1, 1 << 32, (1 << 63) - 1, -1]
    found = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").coalesce(1).select(numeric.bits_required("v")).collect()]
    assert found == [next((w for w in numeric.WIDTHS if w >= max(1, v.bit_length())), 64) if v >= 0 else 64 for v in values]


@pytest.mark.parametrize(("n", "w", "size"), [(0, 8, 0), (10, 0, 0), (10, 1, 2), (64, 1, 8), (65, 1, 9), (10, 8, 10), (4, 12, 7), (3, 12, 7), (5, 16, 10), (5, 20, 17), (2, 64, 16), (3, 40, 18)])
def test_packed_bytes(spark, n, w, size):
    assert spark.range(1).select(numeric.packed_bytes(F.lit(n), F.lit(w))).first()[0] == size


def test_small_numbers(spark):
    df = spark.createDataFrame([(0, 0, 0), (-1, -128, 127), (1, 0, 128), (-5, -40000, 3), (7, 0, 1 << 40)], "v long, a long, b long").coalesce(1)
    found = df.select(numeric.zigzag("v").alias("z"), numeric.norm_width("a", "b").alias("w"), numeric.varint_bytes("b").alias("n")).collect()
    assert [r["z"] for r in found] == [0, 1, 2, 9, 14] and [r["w"] for r in found] == [0, 1, 2, 4, 8] and [r["n"] for r in found] == [1, 1, 2, 1, 6]
    assert spark.range(1).select(numeric.checksum(F.lit("abc"))).first()[0] == zlib.crc32(b"abc")


def test_similarities(spark):
    df = spark.createDataFrame([([1.0, 2.0], [3.0, 5.0]), ([0.0, 0.0], [1.0, 1.0])], "v array<float>, q array<float>").coalesce(1)
    found = df.select(vector.euclidean("v", "q"), vector.dot("v", "q"), vector.cosine("v", "q")).collect()
    assert tuple(found[0]) == pytest.approx((-13.0, 13.0, 13 / 5**0.5)) and tuple(found[1]) == (-2.0, 0.0, 0.0)
    with pytest.raises(ValueError):
        vector.similarity("manhattan", "v", "q")
