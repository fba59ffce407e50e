"""The segment store: Parquet by segment, and a commit for each generation.

    <path>/data/_write=<id>/_seg=<n>/...    rows with _doc and the data columns
    <path>/deletes/<generation>/...         (_seg, _doc) of the tombstones so far
    <path>/index/<id>/...                   postings in the order of terms, and lengths
    <path>/index/<field>.<write id>.json    the index of a field of a write
    <path>/commits/<generation>.json        segments, fields and files of a generation

Writers add files first and the commit last, by a rename; readers see whole
generations.  A rename that doesn't replace is atomic on HDFS and local disks;
on object stores without one, one writer at a time is the caller's to see to.
Tombstoned documents keep their values.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from segmill.errors import SegmentError
from segmill.operators import coerce, scan, stats

#: Documents from which on a segment is cut.
SEGMENT_MAX_DOCS = 1 << 20
#: Rows that arrive together; segments are cut between batches.
BATCH_ROWS = 131_072


@dataclass
class Commit:
    generation: int
    segments: list[dict] = field(default_factory=list)
    fields: list[dict] = field(default_factory=list)
    data: list[str] = field(default_factory=list)
    deletes: str | None = None
    schema: str | None = None
    batch: int | None = None

    def docs(self) -> int:
        return sum(s["max_doc"] for s in self.segments)


class Files:
    """The few file operations of commits, through Hadoop: any file system that Spark reads."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm = spark._jvm
        self.root = root.rstrip("/")
        self.fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def names(self, folder: str) -> list[str]:
        path = self._path(folder)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(path)) if self.fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self.fs.open(self._path(name))
        try:
            return str(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def write_once(self, name: str, text: str) -> None:
        """Writes beside the place and renames; an existing file is an error."""
        if self.fs.exists(self._path(name)):
            raise SegmentError(f"{name} exists: another writer was first")
        hidden = f"{name.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        stream = self.fs.create(self._path(hidden), False)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if not self.fs.rename(self._path(hidden), self._path(name)):
            self.fs.delete(self._path(hidden), False)
            raise SegmentError(f"{name} exists: another writer was first")


def segment_rows(batch_rows: int, max_docs: int) -> int:
    """Rows of a segment that is cut between batches, once it has max_docs."""
    if batch_rows < 1 or max_docs < 1:
        raise SegmentError("batch_rows and segment_max_docs must be at least 1")
    return -(-max_docs // batch_rows) * batch_rows


def number(frame: DataFrame, name: str = "__row", start: int = 0) -> DataFrame:
    """Numbers rows in the order of partitions and of rows within them, without moving any.

    The frame is read twice, for the sizes of its partitions and for the rows;
    it must give the same partitions both times, as files do.
    """
    marked = frame.withColumn("__mono", F.monotonically_increasing_id())
    sizes = frame.select(F.spark_partition_id().alias("p")).groupBy("p").count()
    before = F.sum("count").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("p", (F.coalesce(before, F.lit(0)) + start).alias("__start"))  # a row for each partition
    part, at = F.shiftright("__mono", 33), F.col("__mono").bitwiseAND((1 << 33) - 1)
    joined = marked.withColumn("__p", part.cast("int")).join(F.broadcast(starts), F.col("__p") == F.col("p"))
    return joined.withColumn(name, F.col("__start") + at).drop("__mono", "__p", "p", "__start")


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark, path)

    # commits

    def generations(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self.files.names("commits") if n.endswith(".json") and not n.startswith("."))

    def commit(self, generation: int | None = None) -> Commit:
        """The last commit, or that of a generation."""
        found = self.generations()
        if not found or generation is not None and generation not in found:
            raise SegmentError(f"no commit {'' if generation is None else generation} in {self.path}")
        return Commit(**json.loads(self.files.read(f"commits/{generation or found[-1]}.json")))

    def inventory(self, generation: int | None = None) -> DataFrame:
        """(generation, _seg, segment, max_doc, del_count, field, kind, source_type, similarity): a row for each segment and field."""
        c = self.commit(generation)
        rows = [(c.generation, s["ord"], s["name"], s["max_doc"], s["del_count"], f["name"], f["kind"], f["source_type"], f.get("similarity")) for s in c.segments for f in c.fields]
        return self.spark.createDataFrame(rows, "generation long, _seg int, segment string, max_doc long, del_count long, field string, kind string, source_type string, similarity string")

    def segments(self, c: Commit) -> DataFrame:
        return self.spark.createDataFrame([(s["ord"], s["max_doc"]) for s in c.segments], "_seg int, max_doc long")

    # writing

    def write(self, frame: DataFrame, coercion: str = "auto", segment_max_docs: int = SEGMENT_MAX_DOCS, batch_rows: int = BATCH_ROWS, key: str | None = None, index_sort: list[tuple[str, str]] | None = None, append: bool = False, batch: int | None = None) -> DataFrame:
        """Writes segments and commits them; returns a manifest row for each new segment.

        Documents are numbered in the order of a dense key from 0, or else as the
        frame's partitions have them.  index_sort orders the documents of each
        segment by fields, "asc" or "desc".  Without append the store must be
        empty.  Schema errors come before any work; no rows at all are an error.
        batch is a stream's number of the batch, kept in the commit.
        """
        found = coerce.fields(frame.schema, coercion)
        taken = {f.name for f in found} & {"_seg", "_doc", "_global_doc", "_live"}
        if taken:
            raise SegmentError(f"names of system columns: {', '.join(sorted(taken))}")
        for name, order in index_sort or []:
            if name not in frame.columns or order not in ("asc", "desc"):
                raise SegmentError(f"index_sort: {name} {order}")
        old = self.commit() if self.generations() else Commit(0)
        if old.generation and not append:
            raise SegmentError(f"{self.path} isn't empty")
        if old.fields and [(f["name"], f["kind"]) for f in old.fields] != [(f.name, f.kind) for f in found]:
            raise SegmentError("the fields aren't those of the store")
        size, first = segment_rows(batch_rows, segment_max_docs), len(old.segments)
        rows = coerce.coerce(frame, coercion)
        placed = rows.withColumn("__row", F.col(key).cast("long")) if key else number(rows)
        seg = (F.floor(F.col("__row") / size) + first).cast("int")
        doc = (F.col("__row") % size).cast("int")
        if index_sort:
            order = [F.col(n).asc_nulls_last() if o == "asc" else F.col(n).desc_nulls_last() for n, o in index_sort]
            doc = (F.row_number().over(Window.partitionBy("_seg").orderBy(*order, "__row")) - 1).cast("int")
        placed = placed.withColumn("_seg", seg).withColumn("_doc", doc).drop("__row")
        name = uuid.uuid4().hex
        placed.repartition("_seg").sortWithinPartitions("_seg", "_doc").write.partitionBy("_seg").parquet(self._data(name))
        written = self.spark.read.schema(placed.schema).parquet(self._data(name)).groupBy("_seg").agg(F.count("*").alias("n"), F.max("_doc").alias("last")).orderBy("_seg").collect()  # a row for each segment
        if not written:
            raise SegmentError("no rows to write")
        if any(r["n"] != r["last"] + 1 for r in written) or [r["_seg"] for r in written] != list(range(first, first + len(written))):
            raise SegmentError("the key isn't dense from 0")
        segments = [{"ord": r["_seg"], "name": "_" + _base36(r["_seg"]), "max_doc": r["n"], "del_count": 0} for r in written]
        kept = T.StructType([f for f in placed.schema.fields if f.name != "_seg"])
        self._commit(Commit(old.generation + 1, old.segments + segments, [asdict(f) for f in found], [*old.data, name], old.deletes, kept.json(), old.batch if batch is None else batch))
        return self.manifest().where(F.col("_seg") >= first)

    def _commit(self, c: Commit) -> None:
        self.files.write_once(f"commits/{c.generation}.json", json.dumps(asdict(c)))

    def delete(self, pairs: DataFrame) -> Commit:
        """Tombstones for (_seg, _doc), in a new generation; pairs that don't exist or are dead change nothing."""
        c = self.commit()
        dead = pairs.select(F.col("_seg").cast("int").alias("_seg"), F.col("_doc").cast("int").alias("_doc")).join(F.broadcast(self.segments(c)), "_seg").where("_doc >= 0 and _doc < max_doc").select("_seg", "_doc")
        if c.deletes:
            dead = dead.unionByName(self.dead(c))
        name = str(c.generation + 1)
        dead.distinct().write.parquet(f"{self.path}/deletes/{name}")
        counts = {r["_seg"]: r["count"] for r in self.spark.read.parquet(f"{self.path}/deletes/{name}").groupBy("_seg").count().collect()}
        new = Commit(c.generation + 1, [s | {"del_count": counts.get(s["ord"], 0)} for s in c.segments], c.fields, c.data, name, c.schema, c.batch)
        self._commit(new)
        return new

    # reading

    def dead(self, c: Commit) -> DataFrame:
        if not c.deletes:
            return self.spark.createDataFrame([], "_seg int, _doc int")
        return self.spark.read.schema("_seg int, _doc int").parquet(f"{self.path}/deletes/{c.deletes}")

    def _data(self, name: str) -> str:
        return f"{self.path}/data/_write={name}"

    def rows(self, c: Commit | None = None, writes: list[str] | None = None) -> DataFrame:
        """All documents with _seg and _doc, of all writes or of some, in one read however many there are; _seg prunes folders."""
        c = c or self.commit()
        schema = T.StructType.fromJson(json.loads(c.schema)).add("_write", T.StringType()).add("_seg", T.IntegerType())
        paths = [self._data(name) for name in (c.data if writes is None else writes)]
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(*paths).drop("_write")

    def docvalues(self, row_mode: str, columns=None, segments: list[str] | None = None, generation: int | None = None) -> DataFrame:
        """scan() over the store; segments by name, in the order wanted."""
        c = self.commit(generation)
        chosen = None
        if segments is not None:
            known = {s["name"]: s["ord"] for s in c.segments}
            unknown = [s for s in segments if s not in known]
            if unknown:
                raise SegmentError(f"no such segments: {', '.join(unknown)}")
            chosen = [known[s] for s in segments]
        rows = self.rows(c)
        rows = scan.with_live(rows, self.dead(c)) if c.deletes else rows.withColumn("_live", F.lit(True))
        return scan.scan(rows, row_mode, columns, chosen, self.segments(c))

    def hydrate(self, pairs: DataFrame, columns: list[str]) -> DataFrame:
        from segmill.operators.hydrate import hydrate

        return hydrate(pairs, self.rows(), columns)

    def index(self, text: str) -> None:
        """Writes the postings and lengths of a string column, of the writes that have none yet.

        Postings lie in files by term, sorted, so that a read for a few terms
        skips all other row groups; files are rebalanced, so that a frequent
        term's documents fill several.  What is moved and sorted is a row for
        each term of a stretch of a segment, not for each posting.  Tombstones
        don't change an index.
        """
        from segmill.operators import postings

        c = self._with_field(text)
        for name in set(c.data) - self._indexed(c, text).keys():
            folder, rows = uuid.uuid4().hex, self.rows(c, [name])
            posted = postings.runs(rows, text).hint("rebalance", "term").sortWithinPartitions("term", "_seg", "_doc")
            postings.unfolded(posted).write.parquet(f"{self.path}/index/{folder}/postings")
            postings.lengths(rows, ["_seg", "_doc"], text).write.parquet(f"{self.path}/index/{folder}/lengths")
            self.files.write_once(f"index/{text}.{name}.json", json.dumps(folder))

    def _with_field(self, text: str) -> Commit:
        c = self.commit()
        if text not in [f["name"] for f in c.fields]:
            raise SegmentError(f"no such field: {text}")
        return c

    def _indexed(self, c: Commit, text: str) -> dict[str, str]:
        """The folder of the index of each write that has one."""
        there = set(self.files.names("index"))
        return {name: json.loads(self.files.read(f"index/{file}")) for name in c.data if (file := f"{text}.{name}.json") in there}

    def postings(self, text: str) -> DataFrame:
        """(_seg, _doc, term, freq) of a string column, tombstones included; only_live() takes them out.

        Read from the index where there is one, and made from the texts of
        writes that have none.
        """
        from segmill.operators import postings

        c = self._with_field(text)
        known = self._indexed(c, text)
        found = []
        if known:
            found.append(self.spark.read.schema("_seg int, _doc int, term string, freq long").parquet(*[f"{self.path}/index/{x}/postings" for x in known.values()]))
        if rest := [name for name in c.data if name not in known]:
            found.append(postings.postings(self.rows(c, rest), ["_seg", "_doc"], text, unique=True))
        return scan.unite(*found)

    def lengths(self, text: str) -> DataFrame:
        """(_seg, _doc, length, norm) of a string column, from the index or the texts as in postings()."""
        from segmill.operators import postings

        c = self._with_field(text)
        known = self._indexed(c, text)
        found = []
        if known:
            found.append(self.spark.read.schema("_seg int, _doc int, length long, norm int").parquet(*[f"{self.path}/index/{x}/lengths" for x in known.values()]))
        if rest := [name for name in c.data if name not in known]:
            found.append(postings.lengths(self.rows(c, rest), ["_seg", "_doc"], text))
        return scan.unite(*found)

    def checksums(self, columns: list[str] | None = None) -> DataFrame:
        """(_seg, n, checksum) of each segment: the sum over its rows of 48 bits of the MD5 of their values as text, whatever their order."""
        rows = self.rows()
        names = columns or [f["name"] for f in self.commit().fields]
        values = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\0")) for c in names]
        hashed = F.conv(F.substring(F.md5(F.concat_ws("|", *values)), 1, 12), 16, 10).cast("long")
        return rows.groupBy("_seg").agg(F.count("*").alias("n"), F.sum(hashed.cast("decimal(38,0)")).alias("checksum"))

    def stats(self) -> DataFrame:
        """segment_stats() of all fields, with each segment's name, max_doc and del_count."""
        c = self.commit()
        names = self.spark.createDataFrame([(s["ord"], s["name"], s["max_doc"], s["del_count"]) for s in c.segments], "_seg int, segment string, max_doc long, del_count long")
        return stats.segment_stats(self.rows(c), {f["name"]: f["kind"] for f in c.fields}).join(F.broadcast(names), "_seg")

    def manifest(self) -> DataFrame:
        """(_seg, segment, max_doc, del_count, n_fields): a row for each segment."""
        c = self.commit()
        rows = [(s["ord"], s["name"], s["max_doc"], s["del_count"], len(c.fields)) for s in c.segments]
        return self.spark.createDataFrame(rows, "_seg int, segment string, max_doc long, del_count long, n_fields long")


def _base36(n: int) -> str:
    digits, out = "0123456789abcdefghijklmnopqrstuvwxyz", ""
    while True:
        n, r = divmod(n, 36)
        out = digits[r] + out
        if not n:
            return out
