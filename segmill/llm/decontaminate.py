"""Benchmark decontamination with a distributed positional inverted index.

The corpus is cut into segments.  The index has a row for each term of a
segment: in how many documents it stands there, and at which positions, document
and word in one number.  It is written once, for all terms, and then read by
joins on the term.  Document frequencies are summed over the benchmark's terms.

Each window of n words of a benchmark item starts from its rarest term: the
offset-adjusted positions of that and of the next rare term are intersected
segment by segment, and what is left is compared word by word in the documents
it lies in.  Proximity looks at segments that have one of an item's three rarest
terms, and there at the eight rarest together.

Items, terms and lists meet in joins, so neither benchmark nor corpus is held by
the driver or by one task; a frequent term is a row in each segment.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.llm import textscan
from segmill.llm.common import Scratch, bounded, id_or_null, list_array, mapped, of_ids, release, row_id, without

#: Words in a row that make a phrase match; an item that is shorter must match whole.
N_WORDS = 13
#: keep() rejects no document for an item of fewer words.
LEAST_WORDS = 5
#: A proximity match is sought with this many of the item's rarest terms that the corpus has,
PROXIMITY_TERMS = 8
#: of which so many must stand within 1.5 times the item's length.
PROXIMITY_LEAST = 6
#: Bytes of text of a segment; a longer text is one by itself.
SEGMENT_BYTES = 4 << 20

INDEX = "seg long, term long, df int, positions array<long>, ids array<long>"
QUERY = "q long, item_id long, near boolean, a long, a_at int, b long, b_at int"
MATCH = "__id long, item_id long, kind string, item_start long, doc_start long, n_words long"

#: A position is document << SHIFT, plus ORIGIN, plus word; so no offset leads from one document to another.
SHIFT, ORIGIN = 32, 1 << 30


def index(docs: DataFrame) -> DataFrame:
    """INDEX: a row for each term of a segment, and one without a term that has the segment's documents."""
    turn = [0]

    def piece(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        w = textscan.words(batch.column(1))
        seg = TaskContext.get().partitionId() << 32 | turn[0]
        turn[0] += 1
        h = w.hash.view(np.int64)
        order = np.argsort(h, kind="stable")
        terms = h[order]
        doc = np.repeat(np.arange(len(w.offsets) - 1), np.diff(w.offsets))
        place = (doc << SHIFT) + ORIGIN + np.arange(len(h)) - w.offsets[doc]
        opens = np.flatnonzero(np.append(True, terms[1:] != terms[:-1])) if len(h) else np.zeros(0, np.int64)
        fresh = np.ones(len(h), bool)
        fresh[1:] = (terms[1:] != terms[:-1]) | (doc[order][1:] != doc[order][:-1])
        dfs = np.add.reduceat(fresh.astype(np.int32), opens) if len(h) else opens.astype(np.int32)
        n, none = len(opens), lambda k, t: pa.nulls(k, t)
        names = ["seg", "term", "df", "positions", "ids"]
        lists = [pa.RecordBatch.from_arrays([pa.array(np.full(n, seg)), pa.array(terms[opens]), pa.array(dfs, pa.int32()), list_array(place[order], np.append(opens, len(h)), pa.int64()), none(n, pa.list_(pa.int64()))], names)]
        ids = batch.column(0)
        own = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
        return lists + [pa.RecordBatch.from_arrays([pa.array([seg]), none(1, pa.int64()), none(1, pa.int32()), none(1, pa.list_(pa.int64())), own], names)]

    return mapped(docs.select(row_id(docs).alias("__id"), docs["text"].cast("string").alias("text")), INDEX, piece, limit=SEGMENT_BYTES)


def term_counts(postings: DataFrame, terms: DataFrame) -> DataFrame:
    """(term, df) over the whole corpus of the terms that are asked for and that it has."""
    return postings.select("term", "df").join(terms, "term", "left_semi").groupBy("term").agg(F.sum(F.col("df").cast("long")).alias("df"))


def item_words(benchmark: DataFrame) -> DataFrame:
    """(q, item_id, hashes) of each different item that has words; q names it."""
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select(benchmark["item_id"].cast("long").alias("item_id"), benchmark["text"].cast("string").alias("text")).distinct()

    def piece(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = textscan.words(batch.column(2))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), list_array(w.hash.view(np.int64), w.offsets, pa.int64())], ["q", "item_id", "hashes"])

    return mapped(items.select(F.xxhash64("item_id", "text").alias("q"), "item_id", "text"), "q long, item_id long, hashes array<long>", piece).where(F.size("hashes") > 0)


def starts(hashes: list[int], dfs: list[int], n: int) -> list[tuple[int, int]]:
    """(rarest, next rarest) place of each window of n words, each pair once; windows with a term that the corpus lacks are left out."""
    rank = {i: r for r, i in enumerate(sorted(range(len(hashes)), key=lambda i: (dfs[i], i)))}
    found = []
    for p in range(len(hashes) - n + 1):
        a = sorted(range(p, p + n), key=rank.__getitem__)[:2]
        if dfs[a[0]] and (pair := (a[0], a[-1])) not in found:
            found.append(pair)
    return found


def near_terms(hashes: list[int], dfs: list[int]) -> list[int]:
    """The rarest terms that the corpus has, from the rarest on; none where the item has too few."""
    near: list[int] = []
    for i in sorted(range(len(hashes)), key=lambda i: (dfs[i], i)):
        if dfs[i] and hashes[i] not in near and len(near) < PROXIMITY_TERMS:
            near.append(hashes[i])
    return near if len(near) >= PROXIMITY_LEAST and len(set(hashes)) >= PROXIMITY_TERMS else []


def reach(size: int) -> int:
    return int(1.5 * size)


def queries(items: DataFrame, dfs: DataFrame, n: int) -> DataFrame:
    """QUERY: for phrases the terms a and b to start from and their places in the item; for proximity the k-th rarest term a, k in a_at, and the reach in b_at."""
    each = items.select("q", "item_id", F.posexplode("hashes").alias("i", "term")).join(dfs, "term", "left")
    whole = each.groupBy("q", "item_id").agg(F.sort_array(F.collect_list(F.struct("i", "term", F.coalesce("df", F.lit(0)).alias("df")))).alias("x"))

    def run(batches):
        for batch in batches:
            rows = []
            for q, item, h, d in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(q, item, False, h[a], a, h[b], b) for a, b in starts(h, d, min(n, len(h)))]
                rows += [(q, item, True, t, k, t, reach(len(h))) for k, t in enumerate(near_terms(h, d))]
            if rows:
                kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int32(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["q", "item_id", "near", "a", "a_at", "b", "b_at"])

    return whole.select("q", "item_id", F.col("x.term").alias("h"), F.col("x.df").alias("d")).mapInArrow(run, QUERY)


def phrases(asked: DataFrame, lists: DataFrame) -> DataFrame:
    """(q, seg, base): where the item's first word would stand for its two rarest terms to be in their places."""
    side = lambda x: lists.select(F.col("term").alias(x), "seg", F.col("positions").alias(f"p{x}"))
    both = asked.where("not near").select("q", "a", "a_at", "b", "b_at").join(side("a"), "a").join(side("b"), ["b", "seg"])
    base = F.array_intersect(F.transform("pa", lambda x: x - F.col("a_at")), F.transform("pb", lambda x: x - F.col("b_at")))
    return both.select("q", "seg", F.explode(base).alias("base")).distinct()


def runs(words: np.ndarray, hashes: np.ndarray, base: int, n: int) -> list[tuple[int, int, int]]:
    """(item_start, doc_start, n_words) of the longest equal runs of n words or more, where the item's first word stands at base."""
    low, high = max(0, -base), min(len(hashes), len(words) - base)
    if high - low < n:
        return []
    equal = np.concatenate([[False], words[base + low : base + high] == hashes[low:high], [False]])
    edges = np.flatnonzero(equal[1:] != equal[:-1])
    return [(low + a, base + low + a, b - a) for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()) if b - a >= n]


def verified(found: DataFrame, docs: DataFrame, items: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """MATCH of phrases: candidates (q, __id, base) compared word by word with the documents they lie in."""
    found = scratch.write(found, "found")
    ids = scratch.write(found.select("__id").distinct(), "found_ids")
    own = docs.select(row_id(docs).alias("__id"), docs["text"].cast("string").alias("text"))
    per = found.join(items, "q").groupBy("__id").agg(F.collect_list(F.struct("item_id", "base", "hashes")).alias("c"))  # of one document
    texts = of_ids(own, ids).join(per, "__id").select("__id", "text", F.col("c.item_id").alias("items"), F.col("c.base").alias("bases"), F.col("c.hashes").alias("hashes"))

    def piece(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        w, rows = textscan.words(batch.column(1)), []
        for d, key in enumerate(batch.column(0).to_pylist()):
            own = w.hash[w.offsets[d] : w.offsets[d + 1]]
            for item, base, hashes in zip(*(batch.column(c)[d].values for c in (2, 3, 4))):
                h = hashes.values.to_numpy().view(np.uint64)
                rows += [(key, item.as_py(), "phrase", *r) for r in runs(own, h, base.as_py(), min(n, len(h)))]
        return _batch(rows)

    return mapped(texts, MATCH, piece)


def _batch(rows) -> pa.RecordBatch | None:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    names = ["__id", "item_id", "kind", "item_start", "doc_start", "n_words"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names) if rows else None


def closest(lists: list[np.ndarray], span: int) -> list[tuple[int, int]]:
    """(position, terms): for each document the first place from which most terms, PROXIMITY_LEAST at least, stand within the span."""
    every = np.concatenate(lists)
    order = np.argsort(every, kind="stable")
    every, which = every[order], np.repeat(np.arange(len(lists)), [len(x) for x in lists])[order]
    # a match has one of the rarest terms, and PROXIMITY_LEAST positions around it
    around = np.unique(np.concatenate(lists[: len(lists) - PROXIMITY_LEAST + 1]))
    held = np.searchsorted(every, around + span, side="right") - np.searchsorted(every, around - span)
    out = []
    for d in np.unique(around[held >= PROXIMITY_LEAST] >> SHIFT).tolist():
        i, j = np.searchsorted(every, [d << SHIFT, d + 1 << SHIFT])
        at, owner = every[i:j].tolist(), which[i:j].tolist()
        count, left, have, best = [0] * len(lists), 0, 0, (0, 0)
        for k, x in enumerate(owner):
            have += count[x] == 0
            count[x] += 1
            while at[k] - at[left] >= span:
                count[owner[left]] -= 1
                have -= count[owner[left]] == 0
                left += 1
            if have >= PROXIMITY_LEAST and have > best[1]:
                best = at[left], have
        if best[1]:
            out.append(best)
    return out


def proximity(asked: DataFrame, lists: DataFrame) -> DataFrame:
    """(item_id, seg, base, n): the places of the corpus that have most of an item's rarest terms close together, one a document."""
    near = asked.where("near").select("q", "item_id", F.col("a").alias("term"), F.col("a_at").alias("k"), F.col("b_at").alias("span"))
    rarest = near.where(F.col("k") <= PROXIMITY_TERMS - PROXIMITY_LEAST).join(lists.select("term", "seg"), "term").select("q", "seg").distinct()
    both = near.join(rarest, "q").join(lists, ["term", "seg"]).groupBy("q", "item_id", "seg", "span").agg(F.sort_array(F.collect_list(F.struct("k", "positions"))).alias("x"))  # PROXIMITY_TERMS lists of a segment

    def run(batches):
        for batch in batches:
            rows = []
            for item, seg, span, x in zip(*(batch.column(i) for i in range(4))):
                lists = [p.values.to_numpy() for p in x]
                rows += [(item.as_py(), seg.as_py(), base, n) for base, n in closest(lists, span.as_py())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], ["item_id", "seg", "base", "n"])
        release()

    several = both.where(F.size("x") >= PROXIMITY_LEAST).select("item_id", "seg", "span", F.col("x.positions").alias("x"))
    return bounded(several).mapInArrow(run, "item_id long, seg long, base long, n long")


def _matches(docs: DataFrame, benchmark: DataFrame, n: int, scratch: Scratch, kinds=("phrase", "proximity")) -> DataFrame:
    items = scratch.write(item_words(benchmark), "items")
    terms = scratch.write(items.select(F.explode("hashes").alias("term")).distinct(), "terms")
    table = scratch.write(index(docs), "index")
    postings, segments = table.where("term is not null"), table.where("term is null")
    asked = scratch.write(queries(items, term_counts(postings, terms), n), "queries")
    if "proximity" not in kinds:
        asked = asked.where("not near")
    wanted = asked.select(F.explode(F.array("a", "b")).alias("term")).distinct()
    lists = scratch.write(postings.select("term", "seg", "positions").join(wanted, "term", "left_semi"), "lists")
    # a row for each document
    named = scratch.write(segments.select("seg", F.posexplode("ids").alias("d", "__id")), "named")
    scratch.drop("index")
    place = lambda df: df.withColumn("d", F.shiftright("base", SHIFT).cast("int")).join(named, ["seg", "d"])
    local = F.col("base").bitwiseAND((1 << SHIFT) - 1) - ORIGIN
    found = place(phrases(asked, lists)).select("q", "__id", local.cast("int").alias("base")).distinct()
    out = scratch.write(verified(found, docs, items, n, scratch), "phrases")
    if "proximity" in kinds:
        near = place(proximity(asked, lists)).select("__id", "item_id", F.lit("proximity").alias("kind"), F.lit(0).cast("long").alias("item_start"), local.alias("doc_start"), F.col("n").alias("n_words"))
        out = out.unionByName(scratch.write(near, "near"))
    return out


def matches(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, item_id, kind, item_start, doc_start, n_words), positions in words.

    kind phrase: each longest run of at least n equal words (of the whole item
    if that is shorter); kind proximity: PROXIMITY_LEAST of the item's rarest terms
    close together in any order, once per document and item, n_words of them at
    the first place that has the most.  Null texts and ids in benchmark, and
    items without words, are left out.  A document
    without id is reported with a null one; null and empty texts have no
    matches.  Rows that repeat give a match each.
    Empty tables give no rows.  Other columns are ignored.
    """
    return _matches(docs, benchmark, n, scratch or Scratch(docs.sparkSession)).select(id_or_null("__id"), "item_id", "kind", "item_start", "doc_start", "n_words")


def keep(docs: DataFrame, benchmark: DataFrame, n: int = N_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """The rows without a phrase match of LEAST_WORDS words or more, unchanged, with all their columns.

    Rows that share a doc_id go together; a row without one goes by its text.
    Null and empty texts stay, repeated rows each; an empty table stays empty,
    and an empty benchmark rejects nothing.
    """
    return without(docs, _matches(docs, benchmark, n, scratch or Scratch(docs.sparkSession), ("phrase",)).where(F.col("n_words") >= LEAST_WORDS))
