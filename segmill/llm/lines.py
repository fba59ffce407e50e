"""Line dedup by pairwise alignment.

Lines are hashed; those that stand in one document alone can't be aligned and
are left out.  Documents whose remaining lines are the same in the same order
align alike, so the earliest stands for them, and the others are aligned with
it.  Two documents overlap where they share a rare line, one that at most RARE
of these hold: all such pairs are aligned.  Lines of more holders are the same
in very many documents; a document with such a line is aligned with the
earliest that holds it, and lines that are still in place are then tried with
their other earlier holders, GROWTH times as many each round, until they are
deleted or no holder is left.  So a line goes if any earlier document aligns
it, however many hold it, and no group of holders is paired as a whole.

Two documents are aligned with patience diff: lines that are unique in both and
stand in the same order anchor the alignment (a longest increasing
subsequence), equal lines around anchors extend them, and the gaps are aligned
in turn.  The aligned blocks are deleted from the later document.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmill.llm.common import Scratch, bounded, id_or_null, lookup, row_id

#: Letters and signs of a line, blanks at its ends aside, from which on it is compared.
LEAST_CHARS = 1

BLOCKS = "__id long, partner long, line long, partner_line long, n_lines long"


def anchors(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Positions of the lines unique in both, in the longest run that increases in both."""
    once: dict[int, int] = {}
    for i, x in enumerate(a):
        once[x] = -1 if x in once else i
    other: dict[int, int] = {}
    for j, x in enumerate(b):
        other[x] = -1 if x in other else j
    pairs = [(i, other[x]) for x, i in once.items() if i >= 0 and other.get(x, -1) >= 0]
    tails: list[int] = []
    at: list[int] = []
    back = [-1] * len(pairs)
    for k, (_, j) in enumerate(pairs):
        p = bisect_left(tails, j)
        if p == len(tails):
            tails.append(j)
            at.append(k)
        else:
            tails[p], at[p] = j, k
        back[k] = at[p - 1] if p else -1
    found, k = [], at[-1] if at else -1
    while k >= 0:
        found.append(pairs[k])
        k = back[k]
    return found[::-1]


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned positions (i in a, j in b), both increasing."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        while i < k and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            k, m = k - 1, m - 1
            out.append((k, m))
        if i == k or j == m:
            continue
        found = anchors(a[i:k], b[j:m])
        low = (i, j)
        for x, y in [*((i + p, j + q) for p, q in found), (k, m)]:
            if found:
                todo.append((low[0], x, low[1], y))
                if (x, y) != (k, m):
                    out.append((x, y))
            low = (x + 1, y + 1)
    return sorted(out)


def line_table(docs: DataFrame) -> DataFrame:
    """(__id, pos, h): the lines of each row that have LEAST_CHARS letters or signs, blanks at the ends aside."""
    own = docs.select(row_id(docs).alias("__id"), F.posexplode(F.split(docs["text"].cast("string"), "\n", -1)).alias("pos", "line"))
    return own.where(F.length(F.trim("line")) >= LEAST_CHARS).select("__id", "pos", F.xxhash64(F.trim("line")).alias("h"))


#: Different documents that hold a rare line, at most.
RARE = 16
#: How many times as many holders of a line are tried in each round as in all rounds before.
GROWTH = 4


def _aligned(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """BLOCKS of pairs (__id, partner); rows: the shared lines of each document."""
    both = pairs.join(rows, "__id").join(rows.select(F.col("__id").alias("partner"), F.col("pos").alias("pos2"), F.col("h").alias("h2")), "partner")

    def run(batches):
        for batch in batches:
            ids, partners = batch.column("__id").to_pylist(), batch.column("partner").to_pylist()
            out = []
            for k in range(batch.num_rows):
                pa_, ha, pb, hb = (batch.column(c)[k].values.to_pylist() for c in ("pos", "h", "pos2", "h2"))
                last = None
                for i, j in patience(ha, hb):
                    x, y = pa_[i], pb[j]
                    if last and x == last[2] + last[4] and y == last[3] + last[4]:
                        last[4] += 1
                    else:
                        last = [ids[k], partners[k], x, y, 1]
                        out.append(last)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["__id", "partner", "line", "partner_line", "n_lines"])

    return bounded(both.select("__id", "partner", "pos", "h", "pos2", "h2")).mapInArrow(run, BLOCKS)


def _deleted(found: DataFrame) -> DataFrame:
    return found.select("__id", F.explode(F.sequence("line", F.col("line") + F.col("n_lines") - 1)).alias("at"))


def _blocks(docs: DataFrame, scratch: Scratch) -> DataFrame:
    """BLOCKS: lines of __id that stand in the same order in the earlier partner; runs without a gap are one block."""
    each = scratch.write(line_table(docs), "lines")
    several = each.groupBy("h").agg(F.min("__id").alias("low"), F.max("__id").alias("high")).where("low < high").select("h")
    lines = F.sort_array(F.collect_list(F.struct("pos", "h")))
    shared = each.join(several, "h").groupBy("__id").agg(lines.alias("x")).select("__id", F.col("x.pos").alias("pos"), F.col("x.h").alias("h"))
    rows = scratch.write(shared.withColumn("profile", F.struct(F.xxhash64("h"), F.xxhash64(F.lit(1), "h"))), "rows")
    first = rows.groupBy("profile").agg(F.min("__id").alias("rep"))
    placed = scratch.write(rows.join(first, "profile").select("__id", "rep"), "placed")
    copies = placed.where(F.col("__id") != F.col("rep")).select("__id", F.col("rep").alias("partner"))
    reps = rows.join(placed.where(F.col("__id") == F.col("rep")).select("__id"), "__id", "left_semi")
    held = reps.select("__id", F.explode(F.array_distinct("h")).alias("h"))
    counts = held.groupBy("h").agg(F.count("*").alias("n"), F.min("__id").alias("first"))
    held = scratch.write(held.join(counts.where("n > 1"), "h").select("h", "__id", "n", "first"), "held")
    rare = held.where(F.col("n") <= RARE).select("h", "__id")
    pairs = rare.join(rare.select("h", F.col("__id").alias("partner")), "h").where("partner < __id").select("__id", "partner")
    frequent = held.where((F.col("n") > RARE) & (F.col("first") < F.col("__id"))).select("__id", F.col("first").alias("partner"))
    pairs = scratch.write(pairs.unionByName(frequent).unionByName(copies).distinct(), "pairs")
    found = scratch.write(_aligned(pairs, rows), "found")
    return _retried(found, pairs, held.where(F.col("n") > RARE), reps, rows, scratch)


def _retried(found: DataFrame, tried: DataFrame, held: DataFrame, reps: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """found, and the BLOCKS of frequent lines it leaves: each is tried with its other earlier holders until it is deleted.

    A round tries those holders whose hash for the line lies below a threshold
    that grows, so that no list of holders is ranked; rounds grow with the
    logarithm of the holders.
    """

    def left(lines: DataFrame, out: DataFrame) -> DataFrame:
        gone = _deleted(out).select("__id", F.col("at").alias("pos")).distinct()
        return scratch.write(lines.join(gone, ["__id", "pos"], "left_anti"), "open")

    own = reps.select("__id", F.explode(F.arrays_zip("pos", "h")).alias("x")).select("__id", F.col("x.pos").cast("long").alias("pos"), F.col("x.h").alias("h"))
    lines = left(own.join(held.where(F.col("first") < F.col("__id")), ["h", "__id"]).select("__id", "pos", "h", "n"), found)
    share = F.pmod(F.xxhash64("__id", "h"), F.lit(1 << 30)) / F.lit(float(1 << 30)) * F.col("n")
    low, high = 0, GROWTH
    while (most := lines.agg(F.max("n")).first()[0] or 0) > low:
        some = held.where((share >= low) & (share < high)).select("h", F.col("__id").alias("partner"))
        pairs = lines.select("__id", "h").distinct().join(some, "h").where("partner < __id").select("__id", "partner").distinct()
        pairs = scratch.write(pairs.join(tried, ["__id", "partner"], "left_anti"), "pairs")
        if not pairs.isEmpty():
            more = scratch.write(_aligned(pairs, rows), "found")
            lines, tried, found = left(lines, more), tried.unionByName(pairs), found.unionByName(more)
        low, high = high, min(high * GROWTH, max(most, high + 1))
    return found


def blocks(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, partner_id, line, partner_line, n_lines), lines from 0: what dedup() deletes and where it stands earlier.

    Partners are those that were tried: a line that is already deleted isn't
    looked for in further documents.  Cases as in dedup().
    """
    return _blocks(docs, scratch or Scratch(docs.sparkSession)).select(id_or_null("__id"), id_or_null("partner", "partner_id"), "line", "partner_line", "n_lines")


def dedup(docs: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, text, n_lines, n_deleted) of every row: the text without the lines that are aligned with an earlier document.

    Earlier is the one of the lesser doc_id.  A line goes if it is aligned with
    any earlier document; so of two lines that stand in another order in one
    earlier document both go if others have them, too.  Lines are compared
    without blanks at their ends; lines of blanks alone are never deleted.  A
    null text stays null and an empty one empty, with no lines deleted.  A
    repeated line within one document stays unless it is aligned.  Rows that
    share a doc_id are read as one document, line by line; a row without one
    counts under an id made from its text, before all others.  An empty table
    gives no rows.  Other columns are ignored, whatever their names.
    """
    scratch = scratch or Scratch(docs.sparkSession)
    at = _deleted(_blocks(docs, scratch))
    out = scratch.write(at.groupBy("__id").agg(F.collect_set("at").alias("out")), "deleted")
    own = docs.select(row_id(docs).alias("__id"), docs["text"].cast("string").alias("text"))
    lines = F.split("text", "\n", -1)
    kept = F.array_join(F.transform(F.filter(F.transform(lines, lambda x, i: F.struct(x.alias("x"), i.cast("long").alias("i"))), lambda s: ~F.array_contains("out", s["i"])), lambda s: s["x"]), "\n")
    joined = lookup(own, out, "left", F.size("out") * 8 + 24)
    return joined.select(id_or_null("__id"), F.when(F.col("out").isNull(), F.col("text")).otherwise(kept).alias("text"), F.coalesce(F.size(lines), F.lit(0)).cast("long").alias("n_lines"), F.coalesce(F.size("out"), F.lit(0)).cast("long").alias("n_deleted"))
