"""Near-duplicate documents by bottom-k sketches from one hash function.

A document is the set of its word shingles, hashed once; its sketch is the K
least hashes.  Documents of the same set collapse to one *content* first.  The
sketch values that contents share form inverted lists.  Two contents whose
sketches overlap enough share a value even after each leaves out its most
frequent ones, so only the rarest values of a sketch are searched, without
losing a pair.  A pair found in a list is estimated on the sketch of the union,
and what passes is verified with the exact Jaccard similarity of the whole sets.

Groups are the connected components of verified pairs.  Lists are first linked
to one hub each; then every pair of a list whose members lie in different
components is tried, in a long list block against block, where only what
overlaps enough leaves the task.  A pair that is never tried lies within one
component, so the groups are those of all pairs, though large groups cost no
square.  Frequencies and hubs are partial aggregates that are joined back to
the lists: no task gets all of a frequent value.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.llm import textscan
from segmill.llm.common import Scratch, bounded, components, id_or_null, list_array, mapped, of_ids, release, row_id, without

#: Words of a shingle; a shorter text is one shingle.
SHINGLE = 3
#: Hashes of a sketch.
K = 48
#: Least Jaccard similarity of near-duplicates.
THRESHOLD = 0.5
#: How far below the threshold an estimate may lie for the pair to be verified (2.8 standard deviations).
SLACK = 0.2
#: Members of a list up to which its pairs are joined; longer lists are compared in blocks of BLOCK.
LONG, BLOCK = 64, 512


def shingle_sets(texts: pa.Array, n: int = SHINGLE) -> list[np.ndarray]:
    """Hashes of the different shingles of each text, in order."""
    w = textscan.words(texts)
    every, sets = textscan.windows(w.hash, n), []
    for p, q in zip(w.offsets[:-1].tolist(), w.offsets[1:].tolist()):
        if q - p >= n:
            sets.append(np.unique(every[p : q - n + 1].view(np.int64)))
        else:
            sets.append(textscan.windows(w.hash[p:q], q - p).view(np.int64) if q > p else np.zeros(0, np.int64))
    return sets


def sketches(docs: DataFrame, k: int = K, n: int = SHINGLE) -> DataFrame:
    """(__id, place, sig, sketch) of each row with words; sig is a hash of the whole set, place one of the text."""

    def piece(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        sets = shingle_sets(batch.column(1), n)
        full = np.flatnonzero([len(s) > 0 for s in sets])
        if not len(full):
            return None
        with np.errstate(over="ignore"):
            sigs = np.array([textscan.mix(np.array([textscan.mix(sets[i].view(np.uint64) + np.uint64(0x51ED270B)).sum(dtype=np.uint64) + np.uint64(len(sets[i]))]))[0] for i in full], np.uint64).view(np.int64)
        heads = [sets[i][:k] for i in full]
        ids = batch.column(0).take(pa.array(full))
        return pa.RecordBatch.from_arrays([ids, pa.array(sigs), list_array(np.concatenate(heads), np.append(0, np.cumsum([len(h) for h in heads])), pa.int64()), batch.column(2).take(pa.array(full))], ["__id", "sig", "sketch", "place"])

    return mapped(_texts(docs), "__id long, sig long, sketch array<long>, place long", piece)


def _texts(docs: DataFrame) -> DataFrame:
    text = docs["text"].cast("string")
    return docs.select(row_id(docs).alias("__id"), text.alias("text"), F.xxhash64(text).alias("place"))


def prefixes(contents: DataFrame, least: float) -> DataFrame:
    """(value, sig): the shared values of each sketch but for its most frequent ones.

    A pair that passes has at least ``least`` times the larger sketch in common;
    so it still shares a value when each side leaves out one less than that.
    """
    each = contents.select("sig", F.size("sketch").alias("n"), F.explode("sketch").alias("value"))
    shared = each.join(each.groupBy("value").agg(F.count("*").alias("df")).where("df > 1"), "value")
    lists = shared.groupBy("sig", "n").agg(F.sort_array(F.collect_list(F.struct("df", "value"))).alias("found"))
    left = (F.size("found") - F.ceil(F.col("n") * F.lit(least) - F.lit(1e-9)) + 1).cast("int")
    return lists.where(left >= 1).select("sig", F.explode(F.slice("found", F.lit(1), left)).alias("v")).select(F.col("v.value").alias("value"), "sig")


def estimated(pairs: DataFrame, contents: DataFrame, k: int, least: float) -> DataFrame:
    """Pairs (a, b) whose similarity on the union's sketch is at least ``least``, with it."""
    side = lambda x: contents.select(F.col("sig").alias(x), F.col("sketch").alias(f"s{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    found = both.withColumn("u", union).withColumn("est", F.size(F.array_intersect("u", F.array_intersect("sa", "sb"))) / F.size("u"))
    return found.where(F.col("est") >= least).select("a", "b", "est")


def verified(pairs: DataFrame, docs: DataFrame, contents: DataFrame, scratch: Scratch, threshold: float, n: int) -> DataFrame:
    """Pairs (a, b) of the exact similarity; texts are fetched for the documents that stand for the contents alone."""
    side = lambda x: contents.select(F.col("sig").alias(x), F.col("rep").alias(f"r{x}"))
    named = scratch.write(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ra", "rb"), "pairs")
    wanted = scratch.write(named.select(F.explode(F.array("ra", "rb")).alias("r")).select(F.col("r.__id").alias("__id")).distinct(), "wanted")
    # rows that share an id may have different texts: the text of the content is taken
    texts = of_ids(_texts(docs), wanted).groupBy(F.struct("__id", "place").alias("r")).agg(F.first("text").alias("text"))
    texts = scratch.write(texts, "texts")
    side = lambda x: texts.withColumnsRenamed({"r": f"r{x}", "text": f"t{x}"})
    joined = named.join(side("b"), "rb").join(side("a"), "ra").select("a", "b", "ta", "tb")

    def run(batches):
        last, own = None, None
        for batch in batches:
            a, b, ta, tb = batch.columns
            _, offsets = textscan.raw(tb)
            for i, j in textscan.pieces(offsets):
                keep = []
                for x, other in enumerate(shingle_sets(tb.slice(i, j - i), n), i):
                    if (key := a[x].as_py()) != last:  # pairs of one content mostly follow one another
                        last, own = key, shingle_sets(ta.slice(x, 1), n)[0]
                    same = len(np.intersect1d(own, other, assume_unique=True))
                    if same >= threshold * (len(own) + len(other) - same):
                        keep.append(x)
                rows = pa.array(keep, pa.int64())
                yield pa.RecordBatch.from_arrays([a.take(rows), b.take(rows)], ["a", "b"])
        release()

    return scratch.write(bounded(joined).mapInArrow(run, "a long, b long"), "edges")


def overlapping(spread: DataFrame, contents: DataFrame, least: float, scratch: Scratch) -> DataFrame:
    """Pairs (a, b), a < b, of members of a list (value, sig, c) that lie in different components c.

    Pairs of lists of up to LONG members are joined.  A longer list is cut into
    blocks by a hash of its members; each two blocks are one row, compared in
    its task, and only pairs that have ``least`` of the larger sketch in common
    come out, as all that pass the estimate have.
    """
    sizes = scratch.write(spread.groupBy("value").agg(F.count("*").alias("n")), "sizes")
    short = spread.join(sizes.where(F.col("n") <= LONG), "value").select("value", "sig", "c")
    pairs = short.withColumnsRenamed({"sig": "a", "c": "ca"}).join(short.withColumnsRenamed({"sig": "b", "c": "cb"}), "value").where("a < b and ca <> cb").select("a", "b").distinct()
    long = sizes.where(F.col("n") > LONG)
    if long.isEmpty():
        return pairs
    placed = spread.join(long, "value").withColumn("parts", F.ceil(F.col("n") / BLOCK)).withColumn("part", F.pmod(F.xxhash64("sig"), F.col("parts")))
    blocks = placed.join(contents.select("sig", "sketch"), "sig").groupBy("value", "part", "parts").agg(F.collect_list(F.struct("sig", "c", "sketch")).alias("m"))  # about BLOCK members
    blocks = scratch.write(blocks, "blocks")
    left = blocks.select("value", F.col("m").alias("x"), "part", F.explode(F.sequence("part", F.col("parts") - 1)).alias("other"))
    both = left.join(blocks.select("value", F.col("part").alias("other"), F.col("m").alias("y")), ["value", "other"]).select("x", "y")

    def run(batches):
        for batch in batches:
            for x, y in zip(batch.column(0), batch.column(1)):
                (s, c, v, n), (t, d, w, m) = (_members(z.values) for z in (x, y))
                order = np.argsort(w, kind="stable")
                owner = np.repeat(np.arange(len(t)), m)[order]
                low, high = np.searchsorted(w[order], v, "left"), np.searchsorted(w[order], v, "right")
                times = high - low
                row = np.repeat(np.repeat(np.arange(len(s)), n), times)
                at = np.arange(times.sum()) + np.repeat(low - np.append(0, np.cumsum(times)[:-1]), times)
                common = np.bincount(row * len(t) + owner[at], minlength=len(s) * len(t)).reshape(len(s), len(t))
                i, j = np.nonzero((common >= least * np.maximum(n[:, None], m[None, :]) - 1e-9) & (c[:, None] != d[None, :]) & (s[:, None] != t[None, :]))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(s[i], t[j])), pa.array(np.maximum(s[i], t[j]))], ["a", "b"])
        release()

    return pairs.unionByName(bounded(both).mapInArrow(run, "a long, b long")).distinct()


def _members(block: pa.StructArray):
    """(sig, component, values one after the other, values of each) of a block's members."""
    sig, c, sketch = block.flatten()
    return sig.to_numpy(), c.to_numpy(), sketch.flatten().to_numpy(), np.diff(sketch.offsets.to_numpy())


def _groups(docs: DataFrame, scratch: Scratch, threshold: float, k: int, n: int) -> DataFrame:
    """(__id, first, size, links): rows of groups of at least two rows; first is the least id."""
    least = max(0.05, threshold - SLACK)
    rows = scratch.write(sketches(docs, k, n), "sketches")
    # any of the rows of a content stands for it: their sets are equal
    contents = scratch.write(rows.groupBy("sig").agg(F.min_by("sketch", "__id").alias("sketch"), F.min(F.struct("__id", "place")).alias("rep"), F.count("*").alias("copies")), "contents")
    lists = scratch.write(prefixes(contents, least), "lists")
    hubs = lists.groupBy("value").agg(F.min("sig").alias("a"), F.count("*").alias("m")).where("m > 1").select("value", "a")
    stars = lists.join(hubs, "value").select("a", F.col("sig").alias("b")).where("a <> b").distinct()
    best = estimated(stars, contents, k, least).groupBy("b").agg(F.max_by("a", F.struct("est", "a")).alias("a")).select("a", "b")
    edges = verified(best, docs, contents, scratch, threshold, n)
    label = components(edges, scratch)
    placed = scratch.write(lists.join(label, lists["sig"] == label["node"], "left").select("value", "sig", F.coalesce("root", "sig").alias("c")), "placed")
    apart = placed.groupBy("value").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low < high").select("value")
    spread = scratch.write(placed.join(apart, "value"), "spread")
    rest = scratch.write(estimated(overlapping(spread, contents, least, scratch), contents, k, least).select("a", "b"), "rest")
    if not rest.isEmpty():
        edges = edges.unionByName(verified(rest, docs, contents, scratch, threshold, n)).distinct()
        label = components(edges, scratch)
    degree = edges.select(F.explode(F.array("a", "b")).alias("sig")).groupBy("sig").agg(F.count("*").alias("degree"))
    named = contents.join(label, F.col("sig") == F.col("node"), "left").join(degree, "sig", "left")
    named = scratch.write(named.select("sig", F.coalesce("root", "sig").alias("c"), F.col("rep.__id").alias("least"), "copies", (F.coalesce("degree", F.lit(0)) + F.col("copies") - 1).alias("links")), "named")
    groups = named.groupBy("c").agg(F.min("least").alias("first"), F.sum("copies").alias("size")).where("size > 1")
    return rows.select("__id", "sig").join(named.join(groups, "c").select("sig", "first", "size", "links"), "sig").select("__id", "first", "size", "links")


def groups(docs: DataFrame, threshold: float = THRESHOLD, k: int = K, n: int = SHINGLE, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, group_id, n_docs, n_links, keep): a row for each document that has a near-duplicate.

    group_id is the least doc_id of the group, which is kept.  n_links counts
    the document's copies (of the same set of shingles) and the verified links
    of its text to other texts; texts of one group that are linked through
    others needn't be compared.  Null and empty
    texts, and texts without words, are in no group.  Equal texts are similar
    to degree 1.  A row without doc_id counts with an id made from its
    text, before all others, and is reported with a null one.  Repeated rows count each.  An empty
    table has no groups.  Other columns are ignored, whatever their names.
    """
    found = _groups(docs, scratch or Scratch(docs.sparkSession), threshold, k, n)
    return found.select(id_or_null("__id"), id_or_null("first", "group_id"), F.col("size").alias("n_docs"), F.col("links").alias("n_links"), (F.col("__id") == F.col("first")).alias("keep"))


def keep(docs: DataFrame, threshold: float = THRESHOLD, k: int = K, n: int = SHINGLE, scratch: Scratch | None = None) -> DataFrame:
    """One document of each group, and all that are in none, unchanged, with all their columns.

    Null and empty texts stay; an empty table stays empty.
    Rows that share a doc_id, or that have none and share a text, are one
    document: they stay or go together.
    """
    found = _groups(docs, scratch or Scratch(docs.sparkSession), threshold, k, n)
    return without(docs, found.where(F.col("__id") != F.col("first")).select("__id"))
