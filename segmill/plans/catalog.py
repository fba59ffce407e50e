"""The engine's operators as queries over the star schema, documents, events and embeddings.

Each query has the name of its operator; SQL has what another engine computes
for it.  Documents are addressed by their dense keys: segments of SEG rows,
every ninth row from the fifth on a tombstone, and every fifth value missing in
the sparse columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from segmill.functions import numeric, text, vector
from segmill.operators import bm25, coerce, hydrate, knn, ordinals, postings, scan, stats
from segmill.session import work_dir
from segmill.sources.store import Store, segment_rows

SEG = 1000
QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of (table, spark) as a query; table(name) reads a table."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"), spark)

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _orders(t) -> DataFrame:
    rows = scan.address(t("orders"), "o_orderkey", SEG)
    rows = rows.withColumn("o_totalprice", F.when(F.col("o_orderkey") % 5 != 2, F.col("o_totalprice")))
    return scan.with_live(rows, F.col("_doc") % 9 == 4)


_ORDERS = f"""SELECT (o_orderkey // {SEG})::INT AS _seg, (o_orderkey % {SEG})::INT AS _doc, o_orderkey AS _global_doc, (o_orderkey % {SEG}) % 9 <> 4 AS _live,
 o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 5 <> 2 THEN o_totalprice END AS o_totalprice, o_orderdate, o_orderpriority FROM orders"""
_TOKENS = r"list_filter(list_transform(regexp_extract_all(text, '[\p{L}\p{N}]+'), lambda t: lower(t)), lambda t: strlen(t) <= 255)"
_POSTED = f"SELECT doc_id, term, count(*) AS freq FROM (SELECT doc_id, unnest({_TOKENS}) AS term FROM documents) GROUP BY ALL"

# ---- scans


@query(f"SELECT _seg, _doc, _global_doc, _live FROM ({_ORDERS})")
def scan_system_columns(t, spark):
    return scan.scan(_orders(t), scan.POSITIONAL, [])


@query(f"SELECT _seg, _doc, _global_doc, _live, o_custkey, o_totalprice FROM ({_ORDERS})")
def scan_positional(t, spark):
    return scan.scan(_orders(t), scan.POSITIONAL, ["o_custkey", "o_totalprice"])


@query(f"SELECT * EXCLUDE (_live) FROM ({_ORDERS}) WHERE _live")
def scan_compact(t, spark):
    return scan.scan(_orders(t), scan.COMPACT)


@query(f"SELECT _seg, _doc, (_doc + CASE _seg WHEN 3 THEN 0 ELSE (SELECT count(*) FROM ({_ORDERS}) WHERE _seg = 3) END)::BIGINT AS _global_doc, _live, o_custkey FROM ({_ORDERS}) WHERE _seg IN (3, 1)")
def scan_segment_subset(t, spark):
    """Segments in the order 3, 1: _global_doc counts over the chosen ones."""
    return scan.scan(_orders(t), scan.POSITIONAL, ["o_custkey"], [3, 1])


@query(f"SELECT _seg, _doc, _global_doc, o_orderstatus, o_totalprice FROM ({_ORDERS}) WHERE _live")
def scan_projection(t, spark):
    return scan.scan(_orders(t), scan.COMPACT, ["o_totalprice", "o_orderstatus"])


@query("SELECT event_id, value FROM events WHERE event_id % 5 <> 2 AND value IS NOT NULL")
def scan_sparse_nulls(t, spark):
    rows = t("events").select("event_id", F.when(F.col("event_id") % 5 != 2, F.col("value")).alias("value"))
    return rows.where("value is not null")


@query("SELECT event_id, CASE WHEN event_id % 4 > 0 THEN array_to_string(list_sort(list_distinct([event_type, 'tag-' || (event_id % 7)::VARCHAR, event_type])), ',') END AS tags FROM events")
def scan_sorted_set(t, spark):
    tags = F.when(F.col("event_id") % 4 > 0, F.array("event_type", F.concat(F.lit("tag-"), (F.col("event_id") % 7).cast("string")), "event_type")).otherwise(F.array().cast("array<string>"))
    return coerce.coerce(t("events").select("event_id", tags.alias("tags"))).select("event_id", F.array_join("tags", ",").alias("tags"))


@query("SELECT event_id, array_to_string(list_sort([user_id, event_id % 7, user_id - 5]), ',') AS nums FROM events")
def scan_sorted_numeric(t, spark):
    rows = t("events").select("event_id", F.array(F.col("user_id"), F.col("event_id") % 7, F.col("user_id") - 5).cast("array<bigint>").alias("nums"))
    return coerce.coerce(rows).select("event_id", F.array_join(F.transform("nums", lambda x: x.cast("string")), ",").alias("nums"))


@query(f"SELECT (doc_id // {SEG})::INT AS _seg, count(text) AS num_values, min(strlen(text)) AS min_length, max(strlen(text)) AS max_length, sum(strlen(text))::BIGINT AS total_length, min(strlen(text)) = max(strlen(text)) AS fixed FROM documents GROUP BY 1")
def scan_binary_lengths(t, spark):
    return stats.binary_stats(scan.address(t("documents"), "doc_id", SEG), "text", ["_seg"])


@query("SELECT o_orderkey AS id, o_totalprice AS amount, o_orderstatus AS status, NULL::VARCHAR AS name FROM orders UNION ALL SELECT c_custkey, c_acctbal, NULL, c_name FROM customer")
def schema_reconcile_missing(t, spark):
    o = t("orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("amount"), F.col("o_orderstatus").alias("status"))
    c = t("customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("amount"), F.col("c_name").alias("name"))
    return scan.unite(o, c)


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey BETWEEN 5 AND 20 ORDER BY n_nationkey")
def scan_pruned(t, spark):
    """Filter and projection reach the scan."""
    return t("nation").where("n_nationkey between 5 and 20").select("n_nationkey", "n_name")


# ---- coercion


@query("SELECT l_orderkey, l_linenumber::BIGINT AS line, (l_quantity > 25)::INT::BIGINT AS large FROM lineitem")
def coerce_widen_bool(t, spark):
    return coerce.coerce(t("lineitem").select("l_orderkey", F.col("l_linenumber").alias("line"), (F.col("l_quantity") > 25).alias("large")), as_long=True)


@query("SELECT event_id, epoch_us(ts) AS micros, (ts::DATE - DATE '1970-01-01')::BIGINT AS days FROM events")
def coerce_temporal_i64(t, spark):
    return coerce.coerce(t("events").select("event_id", F.col("ts").alias("micros"), F.col("ts").cast("date").alias("days")), as_long=True)


@query("SELECT p_partkey, p_retailprice::DOUBLE::BIT::BIGINT AS bits, p_retailprice AS back FROM part")
def coerce_float_bits(t, spark):
    longs = coerce.coerce(t("part").select("p_partkey", F.col("p_retailprice").alias("bits")), as_long=True)
    return longs.withColumn("back", numeric.bits_float("bits"))


@query("SELECT p_partkey, round(p_retailprice::DECIMAL(14, 3) * 100)::BIGINT AS cents FROM part")
def coerce_decimal_scaled(t, spark):
    rows = t("part").select("p_partkey", F.col("p_retailprice").cast("decimal(14,3)").alias("cents"))
    return coerce.coerce(rows.withMetadata("cents", {coerce.SCALE_FACTOR: 100}))


@query("SELECT p_partkey, CASE WHEN v >= 9223372036854775808::HUGEINT THEN (v - 18446744073709551616::HUGEINT)::BIGINT ELSE v::BIGINT END AS wrapped FROM (SELECT p_partkey, (p_partkey::HUGEINT * 1000000007 * 190174169) % 18446744073709551616::HUGEINT AS v FROM part)")
def coerce_wrap_unsigned(t, spark):
    big = (F.col("p_partkey").cast("decimal(20,0)") * F.lit(1000000007 * 190174169).cast("decimal(18,0)")) % F.lit(str(1 << 64)).cast("decimal(20,0)")
    rows = t("part").select("p_partkey", big.cast("decimal(20,0)").alias("wrapped"))
    return coerce.coerce(rows.withMetadata("wrapped", {coerce.ALLOW_LOSSY: "true"}))


@query("SELECT event_id, array_to_string(list_sort(list_filter([CASE WHEN event_id % 3 > 0 THEN user_id END, CASE WHEN event_id % 5 > 0 THEN event_id END, CASE WHEN event_id % 3 > 0 THEN user_id END], lambda x: x IS NOT NULL)), ',') AS nums FROM events WHERE event_id % 15 > 0 UNION ALL SELECT event_id, NULL FROM events WHERE event_id % 15 = 0")
def coerce_list_canonical(t, spark):
    """Null elements go, repeated numbers stay, and an empty list is absent."""
    u, e = F.when(F.col("event_id") % 3 > 0, F.col("user_id")), F.when(F.col("event_id") % 5 > 0, F.col("event_id"))
    rows = coerce.coerce(t("events").select("event_id", F.array(u, e, u).alias("nums")))
    return rows.select("event_id", F.array_join(F.transform("nums", lambda x: x.cast("string")), ",").alias("nums"))


# ---- stores


_SIZE = segment_rows(1000, 2500)


def _stored(t, spark) -> Store:
    store = Store(spark, work_dir(spark, "store"))
    store.write(t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), segment_max_docs=2500, batch_rows=1000, key="o_orderkey")
    return store


@query(f"SELECT (o_orderkey // {_SIZE})::INT AS _seg, '_' || lower(CASE WHEN o_orderkey // {_SIZE} < 10 THEN (o_orderkey // {_SIZE})::VARCHAR ELSE chr((87 + o_orderkey // {_SIZE})::INT) END) AS segment, count(*) AS max_doc, 0::BIGINT AS del_count, 4::BIGINT AS n_fields FROM orders GROUP BY ALL")
def segment_cut_manifest(t, spark):
    """A store is written; segments are cut between batches of 1000 rows once they have 2500."""
    return _stored(t, spark).manifest()


@query(f"SELECT (o_orderkey // {_SIZE})::INT AS _seg, (o_orderkey % {_SIZE})::INT AS _doc, o_orderkey AS _global_doc, o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE (o_orderkey % {_SIZE}) % 9 <> 4")
def store_round_trip(t, spark):
    """Written, tombstoned and read back."""
    store = _stored(t, spark)
    store.delete(scan.address(t("orders"), "o_orderkey", _SIZE).where("_doc % 9 = 4"))
    return store.docvalues(scan.COMPACT)


@query(f"""SELECT (o_orderkey // {_SIZE})::INT AS _seg, f.field, f.kind, count(*) AS max_doc, count(*) FILTER (WHERE (o_orderkey % {_SIZE}) % 9 = 4) AS del_count
FROM orders, (VALUES ('o_orderkey', 'numeric'), ('o_custkey', 'numeric'), ('o_orderstatus', 'sorted'), ('o_totalprice', 'numeric')) f(field, kind) GROUP BY ALL""")
def inventory(t, spark):
    store = _stored(t, spark)
    store.delete(scan.address(t("orders"), "o_orderkey", _SIZE).where("_doc % 9 = 4"))
    return store.inventory().select("_seg", "field", "kind", "max_doc", "del_count")


@query(f"""WITH s AS (SELECT (o_orderkey // {_SIZE})::INT AS _seg, * FROM orders)
SELECT _seg, 'o_orderkey' AS field, 'numeric' AS shape, count(*) AS num_values, NULL::BIGINT AS num_terms, count(*) * 8 AS payload_bytes FROM s GROUP BY ALL
UNION ALL SELECT _seg, 'o_custkey', 'numeric', count(*), NULL, count(*) * 8 FROM s GROUP BY ALL
UNION ALL SELECT _seg, 'o_totalprice', 'numeric', count(*), NULL, count(*) * 8 FROM s GROUP BY ALL
UNION ALL SELECT _seg, 'o_orderstatus', 'sorted', count(*), count(DISTINCT o_orderstatus), NULL FROM s GROUP BY ALL""")
def segment_stats(t, spark):
    return _stored(t, spark).stats().select("_seg", "field", "shape", "num_values", "num_terms", "payload_bytes")


@query(f"SELECT _seg, (row_number() OVER (PARTITION BY _seg ORDER BY o_custkey DESC, o_orderkey) - 1)::INT AS _doc, o_orderkey, o_custkey FROM (SELECT (o_orderkey // {_SIZE})::INT AS _seg, * FROM orders)")
def index_sort(t, spark):
    store = Store(spark, work_dir(spark, "store"))
    store.write(t("orders").select("o_orderkey", "o_custkey"), segment_max_docs=2500, batch_rows=1000, key="o_orderkey", index_sort=[("o_custkey", "desc")])
    return store.docvalues(scan.COMPACT).select("_seg", "_doc", "o_orderkey", "o_custkey")


# ---- statistics and encodings


def _stats_sql(table: str, columns: list[str], seg: str | None = None) -> str:
    parts = []
    for c in columns:
        by = f"({seg} // {SEG})::INT AS _seg, " if seg else ""
        parts.append(
            f"SELECT {by}'{c}' AS field, count({c}) AS num_values, min({c})::BIGINT AS min, max({c})::BIGINT AS max, list_reduce(list(DISTINCT {c}::BIGINT - low), lambda a, b: gcd(a, b))::BIGINT AS gcd, "
            f"CASE WHEN count(DISTINCT {c}) <= 256 THEN count(DISTINCT {c}) ELSE -1 END AS n_uniques "
            f"FROM (SELECT *, min({c}) OVER ({f'PARTITION BY {seg} // {SEG}' if seg else ''})::BIGINT AS low FROM {table}) GROUP BY ALL"
        )
    return " UNION ALL ".join(parts)


_STATS = ["l_orderkey", "l_partkey", "l_linenumber"]


@query(_stats_sql("lineitem", _STATS))
def numeric_stats(t, spark):
    rows = t("lineitem").select(*[F.col(c).cast("long").alias(c) for c in _STATS])
    return stats.numeric_stats(rows, _STATS).withColumn("n_uniques", F.coalesce(F.when(F.col("uniques").isNotNull(), F.size("uniques")), F.lit(-1)).cast("long")).drop("uniques")


def _width_sql(x: str) -> str:
    return f"(CASE WHEN {x} < 0 THEN 64 " + " ".join(f"WHEN length(bin({x})) <= {w} THEN {w}" for w in numeric.WIDTHS) + " END)"


_ENC = f"""WITH s AS ({_stats_sql('(SELECT o_orderkey, o_orderkey * 400 + 17 AS stamp, o_custkey, o_orderkey % 3 * 1000000007 AS code, 42 AS fixed FROM orders)', ['stamp', 'o_custkey', 'code', 'fixed'], 'o_orderkey')}),
w AS (SELECT *, {_width_sql('((max - min) // greatest(gcd, 1))')} AS delta, {_width_sql('(n_uniques - 1)')} AS places, {_width_sql('max')} = {_width_sql('(max - min)')} AS same FROM s),
e AS (SELECT *, CASE WHEN min >= max THEN 'const' WHEN n_uniques > 1 AND places < delta THEN 'table' WHEN gcd > 1 THEN 'gcd' ELSE 'delta' END AS encoding FROM w)
SELECT _seg, field, encoding, (CASE encoding WHEN 'const' THEN 0 WHEN 'table' THEN places ELSE delta END)::BIGINT AS bits,
 (CASE WHEN encoding = 'const' THEN min WHEN encoding = 'table' OR (gcd = 1 AND min > 0 AND same) THEN 0 ELSE min END)::BIGINT AS base, (CASE WHEN encoding = 'table' THEN 1 ELSE gcd END)::BIGINT AS divisor FROM e"""


@query(_ENC)
def encoding_choice(t, spark):
    key = F.col("o_orderkey")
    rows = t("orders").select((F.floor(key / SEG)).cast("int").alias("_seg"), (key * 400 + 17).alias("stamp"), "o_custkey", (key % 3 * 1000000007).alias("code"), F.lit(42).cast("long").alias("fixed"))
    found = stats.encodings(stats.numeric_stats(rows, ["stamp", "o_custkey", "code", "fixed"], ["_seg"]))
    return found.select("_seg", "field", "encoding", F.col("bits").cast("long").alias("bits"), "base", "divisor")


_PACK = """CASE WHEN w % 8 = 0 THEN n * (w // 8) WHEN w < 8 THEN n // (64 // w) * 8 + ceil((n % (64 // w)) * w / 8.0)::BIGINT ELSE ceil(n / 2.0)::BIGINT * (w // 4) END
 + ceil((CASE WHEN w > 32 THEN 64 - w WHEN w > 16 THEN 32 - w WHEN w > 8 THEN 16 - w ELSE 0 END) / 8.0)::BIGINT"""


@query(f"SELECT p_partkey, w, ({_PACK})::BIGINT AS bytes FROM (SELECT p_partkey, p_partkey + 1 AS n, unnest([{', '.join(map(str, numeric.WIDTHS))}])::BIGINT AS w FROM part)")
def packed_bytes(t, spark):
    rows = t("part").select("p_partkey", F.explode(F.array(*[F.lit(w).cast("long") for w in numeric.WIDTHS])).alias("w"))
    return rows.withColumn("bytes", numeric.packed_bytes(F.col("p_partkey") + 1, "w"))


@query(f"SELECT o_orderkey, {_width_sql('(o_orderkey * o_orderkey * 97)')}::BIGINT AS bits, ceil(length(bin(o_custkey)) / 7.0)::BIGINT AS varint FROM orders")
def bit_widths(t, spark):
    return t("orders").select("o_orderkey", numeric.bits_required(F.col("o_orderkey") * F.col("o_orderkey") * 97).cast("long").alias("bits"), numeric.varint_bytes("o_custkey").cast("long").alias("varint"))


@query("SELECT c_nationkey, CASE WHEN lo >= hi THEN 0 WHEN lo >= -128 AND hi <= 127 THEN 1 WHEN lo >= -32768 AND hi <= 32767 THEN 2 WHEN lo >= -2147483648 AND hi <= 2147483647 THEN 4 ELSE 8 END::BIGINT AS width FROM (SELECT c_nationkey, min(c_custkey) AS lo, max(c_custkey) AS hi FROM customer GROUP BY 1)")
def norm_widths(t, spark):
    bounds = t("customer").groupBy("c_nationkey").agg(F.min("c_custkey").alias("lo"), F.max("c_custkey").alias("hi"))
    return bounds.select("c_nationkey", numeric.norm_width("lo", "hi").cast("long").alias("width"))


# ---- dictionaries


_DICT = f"SELECT _seg, (dense_rank() OVER (PARTITION BY _seg ORDER BY term) - 1)::BIGINT AS ord, term FROM (SELECT DISTINCT (p_partkey // {SEG})::INT AS _seg, p_brand AS term FROM part)"
_GLOBAL = "SELECT (dense_rank() OVER (ORDER BY term) - 1)::BIGINT AS global_ord, term FROM (SELECT DISTINCT p_brand AS term FROM part)"


def _parts(t) -> DataFrame:
    return scan.address(t("part"), "p_partkey", SEG)


@query(_DICT)
def segment_dictionary(t, spark):
    return ordinals.segment_dictionary(_parts(t), "p_brand")


@query(_GLOBAL)
def global_dictionary(t, spark):
    return ordinals.global_dictionary(_parts(t), "p_brand")


@query(f"SELECT _seg, ord, global_ord FROM ({_DICT}) JOIN ({_GLOBAL}) USING (term)")
def ordinal_remap(t, spark):
    return ordinals.ordinal_map(_parts(t), "p_brand")


@query(f"SELECT (p_partkey // {SEG})::INT AS _seg, (p_partkey % {SEG})::INT AS _doc, p_brand AS term FROM part")
def decode_ordinals(t, spark):
    rows = _parts(t)
    return ordinals.decode(ordinals.encode(rows, "p_brand"), ordinals.segment_dictionary(rows, "p_brand"))


@query(f"""WITH d AS (SELECT _seg, (row_number() OVER (PARTITION BY _seg ORDER BY term) - 1)::BIGINT AS ord, term FROM (SELECT DISTINCT (c_custkey // {SEG})::INT AS _seg, c_name AS term FROM customer)),
b AS (SELECT *, lag(term) OVER (PARTITION BY _seg ORDER BY ord) AS prev FROM d)
SELECT _seg, ord, ord // 64 AS block, (CASE WHEN ord % 64 = 0 THEN 0 ELSE coalesce(len(list_filter(range(1, least(length(term), length(prev)) + 1), lambda i: term[1:i] = prev[1:i])), 0) END)::BIGINT AS shared, strlen(term)::BIGINT AS n_bytes FROM b""")
def dictionary_blocks(t, spark):
    rows = scan.address(t("customer"), "c_custkey", SEG)
    return ordinals.prefix_blocks(ordinals.segment_dictionary(rows, "c_name"))


@query(f"SELECT (o_orderkey // {SEG})::INT AS _seg, (o_orderkey % {SEG})::INT AS _doc, coalesce(sum(n) OVER (PARTITION BY o_orderkey // {SEG} ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\", n FROM (SELECT o_orderkey, o_custkey % 4 AS n FROM orders)")
def list_offsets(t, spark):
    rows = scan.address(t("orders"), "o_orderkey", SEG)
    n = F.col("o_custkey") % 4
    return ordinals.list_offsets(rows.withColumn("values", F.when(n > 0, F.sequence(F.lit(1).cast("long"), n))), "values")


# ---- hydration


def _pairs(t) -> DataFrame:
    """A request for each event, spread over all documents and a tenth beyond their end."""
    n = t("documents").agg((F.count("*") * 11 / 10 + 1).cast("long").alias("n"))  # one row
    at = (F.col("event_id") * 7) % F.col("n")
    return t("events").crossJoin(F.broadcast(n)).select(F.col("event_id").alias("pos"), F.floor(at / 250).cast("int").alias("_seg"), (at % 250).cast("int").alias("_doc"))


_PAIRS = "SELECT event_id AS pos, ((event_id * 7) % n // 250)::INT AS _seg, ((event_id * 7) % n % 250)::INT AS _doc FROM events, (SELECT count(*) * 11 // 10 + 1 AS n FROM documents)"


@query(f"SELECT pos, _seg, _doc, lang, n_chars FROM ({_PAIRS}) p LEFT JOIN (SELECT doc_id, lang, n_chars FROM documents) d ON d.doc_id = p._seg * 250 + p._doc")
def hydrate_pairs(t, spark):
    """Repeated addresses, and some that no document has."""
    return hydrate.hydrate(_pairs(t), scan.address(t("documents"), "doc_id", 250), ["lang", "n_chars"])


@query(f"SELECT pos, _seg, _doc FROM ({_PAIRS}) p WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = p._seg * 250 + p._doc)")
def hydrate_missing(t, spark):
    docs = scan.address(t("documents"), "doc_id", 250)
    return _pairs(t).join(docs, ["_seg", "_doc"], "left_anti").select("pos", "_seg", "_doc")


# ---- text and postings


@query(f"SELECT doc_id AS doc, (u.i - 1)::INT AS pos, toks[u.i] AS term FROM (SELECT doc_id, {_TOKENS} AS toks FROM documents), LATERAL (SELECT unnest(range(1, len(toks) + 1)) AS i) u")
def tokens(t, spark):
    return postings.token_stream(t("documents"))


@query(f"SELECT doc_id, len({_TOKENS})::BIGINT AS n FROM documents")
def token_counts(t, spark):
    return postings.lengths(t("documents")).select("doc_id", F.col("length").alias("n"))


_NORM = "CASE WHEN n < 24 THEN n WHEN n < 32 THEN n ELSE 24 + ((((n - 24) >> (length(bin(n - 24)) - 4)) & 7) | ((length(bin(n - 24)) - 3) << 3)) END"


@query(f"SELECT doc_id, n AS length, ({_NORM})::INT AS norm FROM (SELECT doc_id, len({_TOKENS})::BIGINT AS n FROM documents)")
def norm_bytes(t, spark):
    return postings.lengths(t("documents"))


_DL = "CASE WHEN n < 32 THEN n ELSE 24 + (((n - 24) >> (length(bin(n - 24)) - 4)) << (length(bin(n - 24)) - 4)) END"


@query(f"SELECT doc_id, n AS length, ({_DL})::BIGINT AS kept, ({_DL})::BIGINT AS decoded FROM (SELECT doc_id, len({_TOKENS})::BIGINT AS n FROM documents)")
def doc_lengths(t, spark):
    return postings.lengths(t("documents")).select("doc_id", "length", text.norm_length("length").alias("kept"), text.norm_decode("norm").alias("decoded"))


@query(_POSTED)
def postings_scan(t, spark):
    return postings.postings(t("documents"), unique=True)


@query(f"SELECT (doc_id // 250)::INT AS _seg, (doc_id % 250)::INT AS _doc, term, freq FROM ({_POSTED})")
def postings_segmented(t, spark):
    return postings.postings(scan.address(t("documents"), "doc_id", 250), ["_seg", "_doc"], unique=True)


@query(f"SELECT term, count(*) AS doc_freq, sum(freq)::BIGINT AS total_freq FROM ({_POSTED}) GROUP BY 1")
def term_stats(t, spark):
    return postings.term_stats(postings.postings(t("documents"), unique=True))


@query(f"SELECT count(DISTINCT term) AS num_terms, count(*) AS sum_doc_freq, sum(freq)::BIGINT AS sum_total_freq, min(term) AS min_term, max(term) AS max_term, count(DISTINCT doc_id) AS doc_count FROM ({_POSTED})")
def field_stats(t, spark):
    return postings.field_stats(postings.postings(t("documents"), unique=True))


@query(f"SELECT sum(doc_id + freq)::BIGINT AS checksum, count(*) AS num_postings FROM ({_POSTED})")
def postings_checksum(t, spark):
    return postings.checksum(postings.postings(t("documents"), unique=True))


@query(f"SELECT doc_id, term, freq, doc_id - lag(doc_id, 1, -1) OVER (PARTITION BY term ORDER BY doc_id) AS delta FROM ({_POSTED})")
def postings_delta(t, spark):
    return postings.deltas(postings.postings(t("documents"), unique=True))


@query(f"""WITH p AS ({_POSTED}), b AS (SELECT *, (row_number() OVER (PARTITION BY term ORDER BY doc_id) - 1) // 128 AS block, lag(doc_id, 1, -1) OVER (PARTITION BY term ORDER BY doc_id) AS prev FROM p)
SELECT term, block::BIGINT AS block, min(prev) AS base, max(doc_id) AS last, count(*) AS n, sum(freq)::BIGINT AS sum_freq FROM b GROUP BY ALL""")
def postings_blocks(t, spark):
    return postings.blocks(postings.postings(t("documents"), unique=True))


@query(f"SELECT doc_id, term, freq, (dense_rank() OVER (ORDER BY term) - 1)::BIGINT AS ord FROM ({_POSTED})")
def postings_ordinals(t, spark):
    return postings.with_ordinals(postings.postings(t("documents"), unique=True))


@query(f"SELECT (doc_id // 250)::INT AS _seg, (doc_id % 250)::INT AS _doc, term, freq FROM ({_POSTED}) WHERE (doc_id % 250) % 9 <> 4")
def postings_live(t, spark):
    docs = scan.with_live(scan.address(t("documents"), "doc_id", 250), F.col("_doc") % 9 == 4)
    return scan.only_live(postings.postings(docs, ["_seg", "_doc"], unique=True), docs)


@query("SELECT doc_id, len(string_split(text, chr(10)))::BIGINT AS n_lines, strlen(text)::BIGINT AS n_bytes FROM documents")
def line_counts(t, spark):
    return t("documents").select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_lines"), F.octet_length("text").cast("long").alias("n_bytes"))


@query("SELECT doc_id, (i - 1)::INT AS line, lines[i] AS text FROM (SELECT doc_id, string_split(CASE WHEN ends_with(text, chr(10)) THEN text[1:-2] ELSE text END, chr(10)) AS lines FROM documents WHERE text <> ''), LATERAL (SELECT unnest(range(1, len(lines) + 1)) AS i)")
def line_documents(t, spark):
    """Each line of a text as a document; a line end at the end adds none."""
    return t("documents").select("doc_id", F.posexplode(text.lines("text")).alias("line", "text"))


@query("SELECT doc_id, n::BIGINT AS n, TRY(decode(encode(text)[1:n])) IS NOT NULL AS valid FROM documents, (VALUES (1), (2), (3), (5), (64), (100000000)) v(n)")
def utf8_validity(t, spark):
    """Texts cut after some bytes, of which some lie within a character."""
    cut = t("documents").select("doc_id", F.encode("text", "utf-8").alias("data"), F.explode(F.array(*map(F.lit, (1, 2, 3, 5, 64, 100000000)))).alias("n"))
    return cut.select("doc_id", F.col("n").cast("long").alias("n"), text.valid_utf8(F.substring("data", F.lit(1), F.col("n"))).alias("valid"))


@query("""WITH n AS (SELECT DISTINCT c_name AS term FROM customer), p AS (SELECT term, lag(term) OVER (ORDER BY term) AS prev FROM n)
SELECT term, least(coalesce(len(list_filter(range(1, least(length(term), length(prev)) + 1), lambda i: term[1:i] = prev[1:i])), 0) + 1, strlen(term))::BIGINT AS bytes FROM p WHERE prev IS NOT NULL""")
def sort_key_lengths(t, spark):
    """How many bytes of each term tell it from the one before it."""
    ranked = ordinals.global_dictionary(t("customer"), "c_name")
    before = ranked.select((F.col("global_ord") + 1).alias("global_ord"), F.col("term").alias("prev"))
    return ranked.join(before, "global_ord").select("term", text.sort_key_length("prev", "term").alias("bytes"))


# ---- stores of texts

_TEXT_SIZE = segment_rows(100, 250)


def _text_store(t, spark) -> Store:
    store = Store(spark, work_dir(spark, "texts"))
    store.write(t("documents").select("doc_id", "lang", "text"), segment_max_docs=250, batch_rows=100, key="doc_id")
    store.index("text")
    return store


@query(f"SELECT (doc_id // {_TEXT_SIZE})::INT AS _seg, (doc_id % {_TEXT_SIZE})::INT AS _doc, term, freq FROM ({_POSTED})")
def stored_postings(t, spark):
    """Postings as a store's index has them."""
    return _text_store(t, spark).postings("text")


@query(f"SELECT (doc_id // {_TEXT_SIZE})::INT AS _seg, (doc_id % {_TEXT_SIZE})::INT AS _doc, term, freq FROM ({_POSTED})")
def requested_postings(t, spark):
    """A request for postings."""
    from segmill.plans import requests

    store = _text_store(t, spark)
    return requests.read(spark, {"path": store.path, "relation": "postings", "postings_field": "text"}).frame


@query(f"SELECT (doc_id // {_TEXT_SIZE})::INT AS _seg, (doc_id % {_TEXT_SIZE})::INT AS _doc, n AS length, ({_NORM})::INT AS norm FROM (SELECT doc_id, len({_TOKENS})::BIGINT AS n FROM documents)")
def stored_norms(t, spark):
    return _text_store(t, spark).lengths("text")


@query(f"""WITH o AS (SELECT (o_orderkey // {_SIZE})::INT AS _seg, (o_orderkey % {_SIZE})::INT AS _doc, * FROM orders),
d AS (SELECT _seg, o_orderstatus, (dense_rank() OVER (PARTITION BY _seg ORDER BY o_orderstatus) - 1)::BIGINT AS o_orderstatus_ord FROM (SELECT DISTINCT _seg, o_orderstatus FROM o))
SELECT _seg, _doc, o_orderkey AS _global_doc, true AS _live, o_orderkey, o_orderstatus, o_orderstatus_ord FROM o JOIN d USING (_seg, o_orderstatus)""")
def requested_documents(t, spark):
    """A request for columns, with the ordinals of a string column in its segment."""
    from segmill.plans import requests

    request = {"path": _stored(t, spark).path, "row_mode": "positional", "columns": ["o_orderkey", "o_orderstatus"], "dict": {"*": "segment"}}
    return requests.read(spark, request).frame


@query(f"SELECT (o_orderkey // {_SIZE})::INT AS _seg, count(*) AS n, sum(('0x' || substr(md5(o_orderkey || '|' || o_custkey || '|' || o_orderstatus), 1, 12))::BIGINT)::BIGINT AS checksum FROM orders GROUP BY 1")
def segment_checksums(t, spark):
    return _stored(t, spark).checksums(["o_orderkey", "o_custkey", "o_orderstatus"]).withColumn("checksum", F.col("checksum").cast("long"))


def _lists(t, spark) -> Store:
    """A store with a column of each kind: numbers, strings, sorted numbers, sorted sets, binaries and vectors."""
    e = F.col("event_id")
    rows = t("events").select(
        "event_id", F.when(e % 3 > 0, F.array(F.col("user_id"), e % 7, F.col("user_id") - 5).cast("array<bigint>")).alias("nums"),
        F.when(e % 4 > 0, F.array("event_type", F.concat(F.lit("tag-"), (e % 7).cast("string")), "event_type")).alias("tags"),
        F.when(e % 5 > 0, F.encode("event_type", "utf-8")).alias("blob"), F.when(e % 6 > 0, F.array(e % 11, F.col("user_id") % 13).cast("array<float>")).alias("vec"),
    )
    store = Store(spark, work_dir(spark, "lists"))
    store.write(rows, segment_max_docs=2500, batch_rows=1000, key="event_id")
    return store


_EVENT_AT = f"(event_id // {_SIZE})::INT AS _seg, (event_id % {_SIZE})::INT AS _doc"


@query(f"SELECT {_EVENT_AT}, array_to_string(list_sort([user_id, event_id % 7, user_id - 5]), ',') AS nums FROM events WHERE event_id % 3 > 0")
def stored_sorted_numeric(t, spark):
    """Numbers of several values as a segment has them; documents without any are left out by the scan."""
    return _lists(t, spark).docvalues(scan.COMPACT, ["nums"]).where("nums is not null").select("_seg", "_doc", F.array_join(F.transform("nums", lambda x: x.cast("string")), ",").alias("nums"))


@query(f"SELECT {_EVENT_AT}, array_to_string(list_sort(list_distinct([event_type, 'tag-' || (event_id % 7)::VARCHAR])), ',') AS tags FROM events WHERE event_id % 4 > 0")
def stored_sorted_set(t, spark):
    return _lists(t, spark).docvalues(scan.COMPACT, ["tags"]).where("tags is not null").select("_seg", "_doc", F.array_join("tags", ",").alias("tags"))


@query(f"SELECT {_EVENT_AT}, CASE WHEN event_id % 5 > 0 THEN hex(encode(event_type)) END AS blob FROM events")
def stored_binary(t, spark):
    return _lists(t, spark).docvalues(scan.COMPACT, ["blob"]).select("_seg", "_doc", F.hex("blob").alias("blob"))


@query(f"SELECT {_EVENT_AT}, CASE WHEN event_id % 6 > 0 THEN (event_id % 11)::DOUBLE END AS x, CASE WHEN event_id % 6 > 0 THEN (user_id % 13)::DOUBLE END AS y FROM events")
def stored_vectors(t, spark):
    return _lists(t, spark).docvalues(scan.COMPACT, ["vec"]).select("_seg", "_doc", F.col("vec")[0].cast("double").alias("x"), F.col("vec")[1].cast("double").alias("y"))


@query(f"""SELECT (event_id // {_SIZE})::INT AS _seg, f AS field, count(*) FILTER (WHERE event_id % m > 0) * k AS num_values FROM events, (VALUES ('event_id', 1000000000, 1), ('nums', 3, 3), ('blob', 5, 1), ('vec', 6, 1)) v(f, m, k) WHERE f <> 'event_id' GROUP BY 1, 2, k
UNION ALL SELECT (event_id // {_SIZE})::INT, 'event_id', count(*) FROM events GROUP BY 1
UNION ALL SELECT (event_id // {_SIZE})::INT, 'tags', sum(len(list_distinct([event_type, 'tag-' || (event_id % 7)::VARCHAR]))) FILTER (WHERE event_id % 4 > 0)::BIGINT FROM events GROUP BY 1""")
def stored_value_counts(t, spark):
    return _lists(t, spark).stats().select("_seg", "field", "num_values")


@query(f"""WITH c AS (SELECT (event_id // {SEG})::INT AS _seg, (event_id % {SEG} // 128)::BIGINT AS block, count(*) FILTER (WHERE event_id % 5 > 0) AS n FROM events GROUP BY ALL)
SELECT _seg, block, n, coalesce(sum(n) OVER (PARTITION BY _seg ORDER BY block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rank FROM c""")
def rank_table(t, spark):
    """How many values stand before each block of a sparse column."""
    rows = scan.address(t("events"), "event_id", SEG).withColumn("value", F.when(F.col("event_id") % 5 > 0, F.col("event_id")))
    return ordinals.rank_table(rows, "value", 128)


@query("SELECT count(*) AS n, sum(o_orderkey)::BIGINT AS keys, true AS small FROM orders")
def scan_batches(t, spark):
    """Batches of at most 1000 rows, one after another."""
    n = keys = 0
    small = True
    for batch in scan.batches(t("orders").select("o_orderkey"), 1000):
        n, keys, small = n + batch.num_rows, keys + sum(batch.column(0).to_pylist()), small and batch.num_rows <= 1000
    return spark.createDataFrame([(n, keys, small)], "n long, keys long, small boolean")


# ---- BM25


_SELECTIVE = {"one": ["the"], "rights": ["rights", "reserved"], "mixed": ["de", "la", "the", "the"], "none": ["qqqqzzzz"]}
_HEAVY = {f"q{i}": ws for i, ws in enumerate((["the", "of", "and"], ["de", "la", "en"], ["der", "die", "und"], ["les", "des", "et"], ["all", "rights", "reserved"]))}


def _bm25_sql(queries: dict[str, list[str]], k: int | None) -> str:
    values = ", ".join(f"('{q}', '{t}')" for q, ts in queries.items() for t in ts)
    scored = f"""WITH q(qid, term) AS (VALUES {values}), tk AS (SELECT doc_id, {_TOKENS} AS toks FROM documents),
p AS (SELECT doc_id, term, count(*) AS freq FROM (SELECT doc_id, unnest(toks) AS term FROM tk) WHERE term IN (SELECT term FROM q) GROUP BY ALL),
ln AS (SELECT doc_id, n, ({_DL})::DOUBLE AS dl FROM (SELECT doc_id, len(toks)::BIGINT AS n FROM tk)),
st AS (SELECT count(*)::DOUBLE AS nd, sum(n)::DOUBLE / count(*) AS mean FROM ln), d AS (SELECT term, count(*)::DOUBLE AS df FROM p GROUP BY 1),
s AS (SELECT qid, doc_id, sum(ln(1 + (nd - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * freq / (freq + 1.2::DOUBLE * (1 - 0.75::DOUBLE + 0.75::DOUBLE * dl / mean))) AS score FROM q JOIN p USING (term) JOIN d USING (term) JOIN ln USING (doc_id), st GROUP BY ALL)"""
    if k is None:
        return f"{scored} SELECT qid, doc_id, round(score, 6) AS score FROM s"
    return f"{scored} SELECT qid, rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s) WHERE rank <= {k}"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@query(_bm25_sql({"one": ["the"]}, None))
def bm25_single_term(t, spark):
    return _rounded(bm25.scores(t("documents"), {"one": ["the"]}))


@query(_bm25_sql({"or": ["rights", "reserved", "de"]}, None))
def bm25_or_query(t, spark):
    return _rounded(bm25.scores(t("documents"), {"or": ["rights", "reserved", "de"]}))


@query(_bm25_sql(_SELECTIVE, 10))
def bm25_batch_topk(t, spark):
    return _rounded(bm25.search(t("documents"), _SELECTIVE, 10))


@query(_bm25_sql(_HEAVY, 16))
def bm25_selective_heavy(t, spark):
    return _rounded(bm25.search(t("documents"), _HEAVY, 16))


@query(_bm25_sql(_HEAVY, 10))
def bm25_of_index(t, spark):
    """From postings and lengths as relations."""
    docs = t("documents")
    return _rounded(bm25.top_k(bm25.scores_of_index(postings.postings(docs, unique=True), postings.lengths(docs), _HEAVY), 10))


@query(_bm25_sql(_HEAVY, 10))
def bm25_of_store(t, spark):
    """From the postings and lengths that a store keeps, which are read for the asked terms alone."""
    store = _text_store(t, spark)
    doc = lambda df: df.withColumn("doc_id", F.col("_seg").cast("long") * _TEXT_SIZE + F.col("_doc"))
    return _rounded(bm25.top_k(bm25.scores_of_index(doc(store.postings("text")), doc(store.lengths("text")), _HEAVY), 10))


# ---- vectors


def _knn_sql(metric: str, where: str, k: int, no_self: bool = False, names=("qid", "id")) -> str:
    score = {
        "euclidean": "-list_sum(list_transform(list_zip(v, q), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))",
        "dot": "list_sum(list_transform(list_zip(v, q), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))",
        "cosine": "list_sum(list_transform(list_zip(v, q), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) / sqrt(list_sum(list_transform(v, lambda x: x::DOUBLE * x::DOUBLE)))",
    }[metric]
    return f"""SELECT {names[0]}, rank, {names[1]}, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY {names[0]} ORDER BY score DESC, {names[1]}) AS rank FROM
(SELECT a.vec_id AS {names[0]}, b.vec_id AS {names[1]}, round({score}, 9) AS score FROM (SELECT vec_id, embedding AS q FROM embeddings WHERE {where}) a, (SELECT vec_id, embedding AS v FROM embeddings) b{' WHERE a.vec_id <> b.vec_id' if no_self else ''})) WHERE rank <= {k}"""


def _asked(t, where: str) -> DataFrame:
    return t("embeddings").where(where).select(F.col("vec_id").alias("qid"), "embedding")


@query(_knn_sql("euclidean", "vec_id % 20 = 0", 10))
def knn_euclidean(t, spark):
    return _rounded(knn.knn(t("embeddings"), _asked(t, "vec_id % 20 = 0"), 10, "euclidean"))


@query(_knn_sql("dot", "vec_id % 20 = 0", 10))
def knn_dot(t, spark):
    return _rounded(knn.knn(t("embeddings"), _asked(t, "vec_id % 20 = 0"), 10, "dot"))


@query(_knn_sql("cosine", "vec_id % 20 = 0", 10))
def knn_cosine(t, spark):
    return _rounded(knn.knn(t("embeddings"), _asked(t, "vec_id % 20 = 0"), 10, "cosine"))


@query(_knn_sql("cosine", "vec_id % 20 = 0", 64))
def knn_batch(t, spark):
    """Many neighbours of every twentieth vector, in one pass."""
    return _rounded(knn.knn(t("embeddings"), _asked(t, "vec_id % 20 = 0"), 64, "cosine"))


@query(_knn_sql("euclidean", "true", 10, True, ("node", "neighbor")))
def knn_graph(t, spark):
    return _rounded(knn.knn_graph(t("embeddings"), 10))


@query(f"""WITH n AS (SELECT count(*) AS n FROM embeddings), g AS ({_knn_sql('euclidean', 'true', 8, True, ('node', 'neighbor'))}),
e AS (SELECT vec_id AS node, 0 AS c, 0 AS o, (vec_id + 1) % n AS neighbor FROM embeddings, n UNION ALL SELECT vec_id, 1, 0, (vec_id + n - 1) % n FROM embeddings, n
 UNION ALL SELECT node, 2, rank, neighbor FROM g UNION ALL SELECT neighbor, 3, node, node FROM g),
f AS (SELECT node, neighbor, min(c::BIGINT * 1000000000 + o) AS place FROM e WHERE node <> neighbor GROUP BY ALL)
SELECT node, pos, neighbor FROM (SELECT node, neighbor, row_number() OVER (PARTITION BY node ORDER BY place, neighbor) AS pos FROM f) WHERE pos <= 16""")
def navigable_graph(t, spark):
    rows = t("embeddings")
    return knn.navigable_graph(knn.knn_graph(rows, 8), rows.count(), 16)


@query()
def small_world_graph(t, spark):
    rows = t("embeddings")
    return knn.small_world(knn.knn_graph(rows, 12), rows.count(), 16)


@query(f"""WITH g AS ({_knn_sql('cosine', 'true', 9, True)}), v AS (SELECT qid, label, count(*) AS n FROM g JOIN embeddings ON vec_id = id GROUP BY ALL)
SELECT qid, label, n FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY n DESC, label) AS r FROM v) WHERE r = 1""")
def knn_label_vote(t, spark):
    rows = t("embeddings")
    found = knn.knn_graph(rows, 9, "cosine").select(F.col("node").alias("qid"), F.col("neighbor").alias("vec_id"))
    votes = found.join(rows.select("vec_id", "label"), "vec_id").groupBy("qid", "label").agg(F.count("*").alias("n"))
    best = votes.withColumn("r", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("n"), "label")))
    return best.where("r = 1").select("qid", "label", "n")


@query("SELECT label % 5 AS label, CASE label % 5 WHEN 0 THEN 'euclidean' WHEN 1 THEN 'dot' WHEN 2 THEN 'cosine' WHEN 3 THEN 'max_inner_product' END AS similarity, count(*) AS n FROM embeddings GROUP BY ALL")
def similarity_names(t, spark):
    """Numbers of similarities as a field's metadata has them."""
    rows = t("embeddings").select((F.col("label") % 5).alias("label"))
    return rows.groupBy("label").agg(F.count("*").alias("n")).select("label", vector.similarity_name("label").alias("similarity"), "n")


@query("SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS norm FROM embeddings")
def vector_norms(t, spark):
    return t("embeddings").select("vec_id", F.round(vector.norm("embedding"), 6).alias("norm"))


@query(_knn_sql("euclidean", "true", 4, True, ("node", "neighbor")))
def graph_merge(t, spark):
    """Two stores of vectors are put together, and the graph is built anew."""
    even, odd = t("embeddings").where("vec_id % 2 = 0"), t("embeddings").where("vec_id % 2 = 1")
    return _rounded(knn.knn_graph(scan.unite(even, odd), 4))


_LEVEL = "least(floor(-ln((('0x' || substr(md5(vec_id::VARCHAR), 1, 12))::BIGINT::DOUBLE + 1) / 281474976710656::DOUBLE) / ln(8::DOUBLE)), 8)::BIGINT"


def _layer_sql(level: int, k: int) -> str:
    inner = _knn_sql("euclidean", "true", k, True, ("node", "neighbor")).replace("embeddings", f"(SELECT * FROM embeddings WHERE {_LEVEL} >= {level})")
    return f"SELECT {level}::BIGINT AS level, node, rank, neighbor, score FROM ({inner})"


@query(" UNION ALL ".join(_layer_sql(i, 16 if i == 0 else 8) for i in range(9)))
def layered_graph(t, spark):
    return _rounded(knn.layered_graph(t("embeddings"), 8))


@query("SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 20 = 0")
def recall_approximate(t, spark):
    """Whether approximate search, for every twentieth vector, finds nine tenths of the exact neighbours."""
    asked = _asked(t, "vec_id % 20 = 0")
    found = knn.recall(knn.approximate(t("embeddings"), asked, 10), knn.knn(t("embeddings"), asked, 10), 10)
    return found.crossJoin(asked.agg(F.count("*").alias("queries"))).select("queries", (F.col("recall") >= 0.9).alias("enough"))


@query("SELECT count(*) AS nodes, true AS enough FROM embeddings")
def recall_graph(t, spark):
    """Whether the graph that is built by cells has nine tenths of the exact graph's edges."""
    rows = t("embeddings")
    found, exact = (g.select(F.col("node").alias("qid"), F.col("neighbor").alias("id")) for g in (knn.approximate_graph(rows, 10), knn.knn_graph(rows, 10)))
    return knn.recall(found, exact, 10).crossJoin(rows.agg(F.count("*").alias("nodes"))).select("nodes", (F.col("recall") >= 0.9).alias("enough"))


# ---- analytics over scans


_LINE = "l_returnflag, l_linestatus"


@query(f"SELECT {_LINE}, count(*) AS n, round(sum(l_quantity), 4) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 4) AS revenue, round(avg(l_discount), 6) AS discount FROM lineitem GROUP BY {_LINE}")
def delegated_group_by(t, spark):
    return t("lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 4).alias("quantity"), F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 4).alias("revenue"), F.round(F.avg("l_discount"), 6).alias("discount"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def delegated_rollup(t, spark):
    return t("orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def delegated_cube(t, spark):
    return t("orders").cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def delegated_grouping_sets(t, spark):
    return t("orders").groupingSets([["o_orderstatus"], ["o_orderpriority"], []], "o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def delegated_join_inner(t, spark):
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def delegated_join_left(t, spark):
    return t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("n"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def delegated_join_semi(t, spark):
    return t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def delegated_join_anti(t, spark):
    return t("customer").join(t("orders"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey")
def delegated_join_full(t, spark):
    return t("supplier").join(t("customer"), F.col("s_suppkey") == F.col("c_custkey"), "full").select("s_suppkey", "c_custkey")


@query("SELECT event_id, o_orderkey FROM (SELECT event_id, user_id, ts FROM events) e ASOF LEFT JOIN (SELECT o_custkey, o_orderdate, min(o_orderkey) AS o_orderkey FROM orders GROUP BY ALL) o ON e.user_id = o.o_custkey AND e.ts >= o.o_orderdate")
def delegated_join_asof(t, spark):
    """The last order of a user before each event: one sort of both sides by user and time, no range join."""
    e = t("events").select(F.col("user_id").alias("k"), "ts", F.lit(1).alias("side"), "event_id", F.lit(None).cast("long").alias("o_orderkey"))
    o = t("orders").groupBy(F.col("o_custkey").alias("k"), F.col("o_orderdate").alias("ts")).agg(F.min("o_orderkey").alias("o_orderkey"))
    both = e.unionByName(o.withColumns({"side": F.lit(0), "event_id": F.lit(None).cast("long")}))
    w = Window.partitionBy("k").orderBy("ts", "side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return both.withColumn("o_orderkey", F.last("o_orderkey", True).over(w)).where("side = 1").select("event_id", "o_orderkey")


@query("SELECT o_orderkey, o_custkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS rk FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)")
def delegated_window_rank(t, spark):
    w = Window.partitionBy("o_custkey")
    return t("orders").select("o_orderkey", "o_custkey", F.row_number().over(w.orderBy(F.desc("o_totalprice"), "o_orderkey")).cast("long").alias("rn"), F.rank().over(w.orderBy("o_orderpriority")).cast("long").alias("rk"))


@query("SELECT event_id, round(sum(value) OVER w, 4) AS moving, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def delegated_window_frame(t, spark):
    w = Window.partitionBy("user_id").orderBy("event_id")
    return t("events").select("event_id", F.round(F.sum("value").over(w.rowsBetween(-2, 0)), 4).alias("moving"), F.lag("event_id").over(w).alias("prev"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def delegated_union(t, spark):
    return t("customer").select(F.col("c_nationkey").alias("k")).union(t("supplier").select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def delegated_intersect(t, spark):
    return t("customer").select(F.col("c_nationkey").alias("k")).intersect(t("supplier").select("s_nationkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def delegated_except(t, spark):
    return t("customer").select(F.col("c_custkey").alias("k")).exceptAll(t("orders").select("o_custkey")).distinct()


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def delegated_topn(t, spark):
    return t("orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("SELECT event_type, count(DISTINCT user_id) AS users, round(stddev_samp(value), 6) AS spread, min(ts) AS first FROM events GROUP BY 1")
def delegated_distinct_agg(t, spark):
    return t("events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.round(F.stddev_samp("value"), 6).alias("spread"), F.min("ts").alias("first"))


@query("SELECT p_partkey, count(s_suppkey) AS n FROM part LEFT JOIN supplier ON s_acctbal BETWEEN p_retailprice - 10 AND p_retailprice + 10 GROUP BY 1")
def delegated_join_range(t, spark):
    """Suppliers whose balance lies close to a price: balances stand in two bins of the range's width, so that bins meet by equality."""
    width = 20.0
    p = t("part").select("p_partkey", F.col("p_retailprice").alias("price"), F.explode(F.array(F.floor((F.col("p_retailprice") - 10) / width), F.floor((F.col("p_retailprice") + 10) / width))).alias("bin")).distinct()
    s = t("supplier").select("s_suppkey", "s_acctbal", F.floor(F.col("s_acctbal") / width).alias("bin"))
    found = p.join(s, "bin").where("s_acctbal between price - 10 and price + 10").groupBy("p_partkey").agg(F.count("*").alias("n"))
    return t("part").select("p_partkey").join(found, "p_partkey", "left").select("p_partkey", F.coalesce("n", F.lit(0)).alias("n"))


@query("SELECT (props::JSON ->> 'k')::BIGINT % 10 AS k, date_trunc('month', ts) AS month, count(*) AS n, max(value) AS most FROM events GROUP BY ALL")
def delegated_json_date_trunc(t, spark):
    k = F.get_json_object("props", "$.k").cast("long") % 10
    return t("events").groupBy(k.alias("k"), F.date_trunc("month", "ts").cast("timestamp_ntz").alias("month")).agg(F.count("*").alias("n"), F.max("value").alias("most"))


@query("SELECT event_type, w.start, count(*) AS n FROM (SELECT event_type, ts, unnest([time_bucket(INTERVAL 12 HOUR, ts), time_bucket(INTERVAL 12 HOUR, ts) - INTERVAL 12 HOUR]) AS start FROM events) w GROUP BY ALL")
def delegated_sliding_window(t, spark):
    """Windows of a day that begin every twelve hours."""
    w = F.window(F.col("ts").cast("timestamp"), "1 day", "12 hours").alias("w")
    return t("events").groupBy("event_type", w).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT event_type, true AS close FROM events GROUP BY 1")
def delegated_approx_distinct(t, spark):
    """Estimated numbers of different users lie within a tenth of the exact ones.

    Repeats change no sketch, so both count each user of a type once; in one
    aggregate with an exact count each user would hold a sketch of its own.
    """
    users = t("events").select("event_type", "user_id").distinct()
    n = users.groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.01).alias("e"), F.count("user_id").alias("n"))
    return n.select("event_type", (F.abs(F.col("e") - F.col("n")) <= F.col("n") * 0.1).alias("close"))


@query("SELECT user_id, min(event_id) AS low, list_sort(list(DISTINCT event_type))[1] AS first_type, map_from_entries([('n', count(*)), ('u', user_id)])['n'] AS n FROM events GROUP BY user_id")
def delegated_map_scalar(t, spark):
    g = t("events").groupBy("user_id").agg(F.min("event_id").alias("low"), F.min("event_type").alias("first_type"), F.count("*").alias("c"))
    return g.select("user_id", "low", "first_type", F.create_map(F.lit("n"), F.col("c"), F.lit("u"), F.col("user_id"))["n"].alias("n"))


# ---- streams


@query("SELECT count(*) AS n, sum(event_id)::BIGINT AS ids, (SELECT 1)::BIGINT AS commits FROM events")
def streaming_put_counts(t, spark):
    """Events arrive as a stream and are appended to a store."""
    from segmill.streaming import put

    source, folder = _as_stream(t, spark, "events", ["event_id", "user_id", "value"])
    path = work_dir(spark, "stream-store")
    put.put(source, path, work_dir(spark, "checkpoint")).awaitTermination()
    store = Store(spark, path)
    return store.docvalues(scan.COMPACT).agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")).withColumn("commits", F.lit(len(store.generations())).cast("long"))


def _as_stream(t, spark, name: str, columns: list[str]):
    rows = t(name).select(*columns)
    path = rows.inputFiles()[0]
    folder, _, file = path.rpartition("/")
    if folder.endswith(".parquet"):  # the table is a folder of files
        folder, file = folder, "*.parquet"
    stream = spark.readStream.schema(t(name).schema).option("pathGlobFilter", file).parquet(folder)
    return stream.select(*columns), folder


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def streaming_tumbling(t, spark):
    from segmill.streaming import put

    source, _ = _as_stream(t, spark, "events", ["ts", "event_type"])
    counted = put.windowed(source.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", ["event_type"], "2 days")
    return put.collect_stream(counted, work_dir(spark, "windows"), work_dir(spark, "checkpoint")).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS nth FROM e)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, nth""")
def streaming_sessions(t, spark):
    from segmill.streaming import put

    source, _ = _as_stream(t, spark, "events", ["ts", "user_id"])
    found = put.sessions(source.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "6 hours", ["user_id"], "2 days")
    return put.collect_stream(found, work_dir(spark, "sessions"), work_dir(spark, "checkpoint")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""WITH e AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, ts FROM events), m AS (SELECT max(ts) - INTERVAL 2 DAY AS mark FROM events)
SELECT start, count(*) AS n FROM e, m WHERE start + INTERVAL 1 DAY <= mark GROUP BY ALL""")
def streaming_closed_windows(t, spark):
    """Days that the watermark has closed; those still open aren't told."""
    from segmill.streaming import put

    source, _ = _as_stream(t, spark, "events", ["ts"])
    counted = put.windowed(source.withColumn("ts", F.col("ts").cast("timestamp")), "ts", "1 day", [], "2 days")
    return put.collect_stream(counted, work_dir(spark, "closed"), work_dir(spark, "checkpoint"), "append").select(F.col("start").cast("timestamp_ntz").alias("start"), "n")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["bm25_batch_topk"](spark, sf_dir)
