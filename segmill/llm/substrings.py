"""Repeated passages by recompression.

A document is a string of words.  In rounds, runs of one symbol and then pairs
of neighbours become new symbols: a pair, where a coin of the round puts its
first symbol on the left and its second on the right.  Whether neighbours are
joined depends on them alone; so equal passages are parsed alike but for a few
words at their ends.  Three steps make and use the symbols:

1.  Up to TARGET words, symbols are made within the tasks that read the texts, a
    name being a hash of what it stands for.  Each symbol knows its *context*:
    the words that decide that it is made.  A window of MIN_WORDS words that
    holds the context of no symbol is made a symbol itself.  One exchange finds
    which symbols stand in two places; the others rule out all windows that
    hold their context.  What is left are *stretches*; no repeated window lies
    outside of one.
2.  Spark rounds go on from there: the words of a stretch are cut where shared
    symbols begin, and every round names these blocks, then runs and pairs of
    them, globally: a name's first place in the corpus is found by a partial
    aggregate and joined back, and what stands in one place alone is dropped.
    Neighbours whose first places follow one another too are a repeat that is
    verified by their names; from MIN_WORDS words on it is reported, and its
    symbols take no further part.
3.  Windows of MIN_WORDS words of the stretches that no such repeat explains, at
    the ends of passages mostly, are looked up among one another.  The first
    place of a window is never explained, so each finds it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from segmill.llm import textscan
from segmill.llm.common import Scratch, bounded, id_or_null, list_array, lookup, mapped, release, row_id

#: Words of the shortest passage that counts.
MIN_WORDS = 50
#: Symbols of so many words or more are final in the first step; those of fewer words aren't looked for.
TARGET = 8
ROUNDS = 12
#: Rounds over blocks, at most: the symbols of eight rounds have MIN_WORDS words, and what is left is looked up by windows.
LEVELS = 8
#: A run is cut into symbols of at most so many repetitions.
RUN = 8

_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_FAR = 1 << 40


def _coin(name: np.ndarray, r: int) -> np.ndarray:
    return (name * np.uint64((int(_A) + 2 * r * int(_B)) & (1 << 64) - 1)) >> np.uint64(63) == 0


def _run(name: np.ndarray, times: np.ndarray) -> np.ndarray:
    return textscan.mix(name * _C + times.astype(np.uint64))


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return textscan.mix(left * _A + right * _B + _C)


def parse(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, first word, words, context from, context to) of the symbols; no symbol reaches across documents.

    Wherever the words of the context stand, the symbol stands.  A context that
    reaches beyond the document, as its end had a say, begins or ends far away.
    """
    n, word = len(hashes), hashes.astype(np.uint64)
    name, at, size = word.copy(), np.arange(n), np.ones(n, np.int64)
    low, high = at.copy(), at + 1
    opens = np.zeros(n + 1, bool)
    opens[offsets] = True
    opens = opens[:-1]

    def joined(low, high, left, right, shuts):
        """Contexts united with that of the left neighbour where ``left``, of the right one where ``right``."""
        a = np.where(left, np.where(opens, -_FAR, np.append(-_FAR, low[:-1])), low)
        b = np.where(left, np.where(opens, high, np.append(-_FAR, high[:-1])), high)
        c = np.where(right, np.where(shuts, low, np.append(low[1:], _FAR)), low)
        d = np.where(right, np.where(shuts, _FAR, np.append(high[1:], _FAR)), high)
        return np.minimum(np.minimum(low, a), c), np.maximum(np.maximum(high, b), d)

    for r in range(ROUNDS):
        if len(name) < 2:
            break
        shuts, end = np.append(opens[1:], True), at + size
        active = size < TARGET
        # a neighbour isn't the same if the word next to this symbol isn't the same as at this symbol's other end
        before = ~opens & (word[np.maximum(at - 1, 0)] != word[end - 1])
        behind = ~shuts & (word[np.minimum(end, n - 1)] != word[at])
        low, high = joined(low, high, active & ~before, active & ~behind, shuts)
        low = np.where(active & before, np.minimum(low, at - 1), low)
        high = np.where(active & behind, np.maximum(high, end + 1), high)
        same = (name[1:] == name[:-1]) & active[1:] & ~opens[1:]
        if same.any():
            heads = np.flatnonzero(np.append(True, ~same))
            length = np.diff(np.append(heads, len(name)))
            low, high = np.repeat(np.minimum.reduceat(low, heads), length), np.repeat(np.maximum.reduceat(high, heads), length)
            nth = np.arange(len(name)) - np.repeat(heads, length)
            kept = np.flatnonzero(nth % RUN == 0)
            times = np.diff(np.append(kept, len(name)))
            many = times > 1
            name, at, size, opens, low, high = name[kept], at[kept], size[kept] * times, opens[kept], low[kept], high[kept]
            name[many] = _run(name[many], times[many])
        shuts, active, coin = np.append(opens[1:], True), size < TARGET, _coin(name, r)
        join = np.flatnonzero(active[:-1] & coin[:-1] & active[1:] & ~coin[1:] & ~opens[1:])
        right, left = active & coin, active & ~coin
        low, high = joined(low, high, left, right, shuts)
        if len(join):
            name[join] = _pair(name[join], name[join + 1])
            size[join] += size[join + 1]
            low[join], high[join] = np.minimum(low[join], low[join + 1]), np.maximum(high[join], high[join + 1])
            kept = np.ones(len(name), bool)
            kept[join + 1] = False
            name, at, size, opens, low, high = name[kept], at[kept], size[kept], opens[kept], low[kept], high[kept]
    return name, at, size, low, high


def _valid(offsets: np.ndarray, n: int) -> np.ndarray:
    """Whether a window of n words begins at each word."""
    steps = np.zeros(int(offsets[-1]) + 1, np.int64)
    long = np.diff(offsets) >= n
    np.add.at(steps, offsets[:-1][long], 1)
    np.add.at(steps, offsets[1:][long] - n + 1, -1)
    return np.cumsum(steps[:-1]) > 0


def _holding(low: np.ndarray, high: np.ndarray, words: int, n: int) -> np.ndarray:
    """Whether the window of n words from each word on holds one of these contexts."""
    steps = np.zeros(words + 1, np.int64)
    np.add.at(steps, np.maximum(high - n, 0), 1)
    np.add.at(steps, low + 1, -1)
    return np.cumsum(steps[:-1]) > 0


def certified(w: textscan.Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(name, place, first word, words, context from, context to, valid) of symbols whose context fits a window; each valid window holds one at least.

    place is first word << 24 | words << 16 | words of context before << 8 | behind.
    """
    name, at, size, low, high = parse(w.hash, w.offsets)
    good = (size >= TARGET) & (high - low <= min(n, 255))
    name, at, size, low, high = name[good], at[good], size[good], low[good], high[good]
    valid = _valid(w.offsets, n)
    bare = np.flatnonzero(valid & ~_holding(low, high, len(w.hash), n))
    if len(bare):
        name = np.append(name, textscan.mix(textscan.long_windows(w.hash, n)[bare] + _A))
        at, size, low, high = np.append(at, bare), np.append(size, np.full(len(bare), n)), np.append(low, bare), np.append(high, bare + n)
    return name, at << 24 | np.minimum(size, 255) << 16 | (at - low) << 8 | (high - at - size), at, size, low, high, valid


def symbols(docs: DataFrame, n: int) -> DataFrame:
    """(h, __id, at): the symbols whose context fits a window, by name, document and place in it."""

    def piece(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        w = textscan.words(batch.column(1))
        if not len(w.hash):
            return None
        name, place, at = certified(w, n)[:3]
        doc = np.searchsorted(w.offsets, at, side="right") - 1
        return pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), batch.column(0).take(pa.array(doc)), pa.array(place - (w.offsets[doc] << 24))], ["h", "__id", "at"])

    return mapped(docs, "h long, __id long, at long", piece)


def shared(found: DataFrame) -> DataFrame:
    """(__id, at): the places in each document of symbols that stand in two places."""
    place = F.struct("__id", "at")
    twice = found.groupBy("h").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low < high").select("h")
    return found.join(twice, "h", "left_semi").groupBy("__id").agg(F.collect_list("at").alias("at"))


def stretches(docs: DataFrame, live: DataFrame, n: int) -> DataFrame:
    """(__id, start, hashes, cuts): words in which each window of n words holds shared symbols alone, and where in them symbols begin."""

    def piece(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        w = textscan.words(batch.column(1))
        _, place, at, size, low, high, fine = certified(w, n)
        known = batch.column(2)
        kept = known.flatten().to_numpy() + (np.repeat(w.offsets[:-1], np.diff(known.offsets.to_numpy())) << 24)
        alive = np.isin(place, kept)
        fine &= ~_holding(low[~alive], high[~alive], len(w.hash), n)
        edges = np.diff(np.concatenate([[0], fine.view(np.int8), [0]]))
        begin, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1) + n - 1
        if not len(begin):
            return None
        # runs of windows of different documents that touch are parted, as the last n - 1 words of a document begin none
        doc = np.searchsorted(w.offsets, begin, side="right") - 1
        starts = np.unique(at[alive & (size < n)])
        lower, upper = np.searchsorted(starts, begin), np.searchsorted(starts, end)
        index = lambda a, b: np.arange((b - a).sum()) + np.repeat(a - np.append(0, np.cumsum(b - a)[:-1]), b - a)
        hashes = list_array(w.hash.view(np.int64)[index(begin, end)], np.append(0, np.cumsum(end - begin)), pa.int64())
        cuts = list_array((starts[index(lower, upper)] - np.repeat(begin, upper - lower)).astype(np.int32), np.append(0, np.cumsum(upper - lower)), pa.int32())
        return pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(doc)), pa.array(begin - w.offsets[doc]), hashes, cuts], ["__id", "start", "hashes", "cuts"])

    joined = docs.join(live, "__id")
    return mapped(joined.select("__id", "text", "at"), "__id long, start long, hashes array<long>, cuts array<int>", piece)


def _sums(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = textscan._powers(len(hashes) + 1)
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes.view(np.uint64) * up[: len(hashes)], out=sums[1:])
    return sums, down


LEVEL = "name long, __id long, at long, size int, fresh boolean, first_id long, first_at long"


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of all lists one after the other, and where each list's begin."""
    at = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(), at - at[0]


def blocks(parts: DataFrame) -> DataFrame:
    """LEVEL: the words between two cuts of a stretch, named by a hash of them."""

    def run(batches):
        for batch in batches:
            hashes, base = _lists(batch.column(2))
            cuts, of = _lists(batch.column(3))
            if len(cuts) < 2:
                continue
            row = np.repeat(np.arange(batch.num_rows), np.diff(of))
            sums, down = _sums(hashes)
            at = cuts + base[row]
            inside = np.flatnonzero(row[1:] == row[:-1])
            a, b = at[inside], at[inside + 1]
            name = textscan.mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * _C)
            key, start = (batch.column(i).to_numpy()[row[inside]] for i in (0, 1))
            yield _level(name, key, cuts[inside] + start, b - a, True)
        release()

    return bounded(parts.select("__id", "start", "hashes", "cuts")).mapInArrow(run, LEVEL)


def _level(name, key, at, size, fresh, first_id=None, first_at=None) -> pa.RecordBatch:
    none = pa.nulls(len(name), pa.int64())
    columns = [pa.array(name.view(np.int64)), pa.array(key), pa.array(at.astype(np.int64)), pa.array(size.astype(np.int32)), pa.array(np.broadcast_to(fresh, len(name)))]
    return pa.RecordBatch.from_arrays([*columns, none if first_id is None else pa.array(first_id), none if first_at is None else pa.array(first_at)], ["name", "__id", "at", "size", "fresh", "first_id", "first_at"])


def _step(key, at, size, name, first_id, first_at, r: int, n: int):
    """A round over documents, sorted by key and place.

    Returns the (key, start, words, first_id, first_at) of verified repeats and the (name, key, at, size, fresh) of symbols that go on.
    """
    touch = (key[1:] == key[:-1]) & (at[:-1] + size[:-1] == at[1:])
    along = touch & (first_id[1:] == first_id[:-1]) & (first_at[1:] - at[1:] == first_at[:-1] - at[:-1])
    heads = np.flatnonzero(np.append(True, ~along))
    words = np.add.reduceat(size, heads)
    earlier = (first_id[heads] < key[heads]) | (first_id[heads] == key[heads]) & (first_at[heads] < at[heads])
    told = (words >= n) & earlier
    h = heads[told]
    spans = key[h], at[h], words[told], first_id[h], first_at[h]
    rest = np.flatnonzero(~np.repeat(told, np.diff(np.append(heads, len(name)))))
    key, at, size, name = key[rest], at[rest], size[rest], name[rest]
    if len(name) < 2:
        return spans, None
    touches = lambda: (key[1:] == key[:-1]) & (at[:-1] + size[:-1] == at[1:])
    fresh = np.zeros(len(name), bool)
    same = touches() & (name[1:] == name[:-1]) & (size[1:] < n)
    if same.any():
        heads = np.flatnonzero(np.append(True, ~same))
        nth = np.arange(len(name)) - np.repeat(heads, np.diff(np.append(heads, len(name))))
        kept = np.flatnonzero(nth % RUN == 0)
        times = np.diff(np.append(kept, len(name)))
        key, at, size, name, fresh = key[kept], at[kept], size[kept] * times, name[kept], times > 1
        name[fresh] = _run(name[fresh], times[fresh])
    coin, small = _coin(name, ROUNDS + r), size < n
    join = np.flatnonzero(touches() & small[:-1] & small[1:] & coin[:-1] & ~coin[1:] & ~fresh[:-1] & ~fresh[1:])
    name[join] = _pair(name[join], name[join + 1])
    size[join] += size[join + 1]
    fresh[join] = True
    kept = np.ones(len(name), bool)
    kept[join + 1] = False
    key, at, size, name, fresh = key[kept], at[kept], size[kept], name[kept], fresh[kept]
    touch = np.concatenate([[False], touches(), [False]])
    # alone or long, and named already: nothing more comes of it
    more = fresh | (touch[1:] | touch[:-1]) & (size < n)
    return spans, (name[more], key[more], at[more], size[more], fresh[more])


def named(level: DataFrame, r: int, n: int) -> DataFrame:
    """A round: names are found in two places or dropped; LEVEL of what goes on, and rows without a name for verified repeats."""
    place = F.struct("__id", "at")
    twice = level.groupBy("name").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low < high").select("name", "low")
    found = level.select("name", "__id", "at", "size").join(twice, "name")
    per = found.groupBy("__id").agg(F.sort_array(F.collect_list(F.struct("at", "size", "name", F.col("low.__id").alias("first_id"), F.col("low.at").alias("first_at")))).alias("x"))  # of one document

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            at, size, name, first_id, first_at = (c.to_numpy() for c in batch.column(1).flatten().flatten())
            key = np.repeat(batch.column(0).to_numpy(), np.diff(batch.column(1).offsets.to_numpy()))
            spans, rest = _step(key, at, size.astype(np.int64), name.view(np.uint64).copy(), first_id, first_at, r, n)
            if len(spans[0]):
                told = _level(np.zeros(len(spans[0]), np.uint64), *spans[:3], False, *spans[3:])
                yield told.set_column(0, "name", pa.nulls(len(spans[0]), pa.int64()))
            if rest is not None and len(rest[0]):
                yield _level(*rest)
        release()

    return bounded(per).mapInArrow(run, LEVEL)


def windows(parts: DataFrame, told: DataFrame, n: int) -> DataFrame:
    """(h, __id, pos): the windows of n words of stretches that lie in no repeat that is told."""
    spans = told.groupBy("__id").agg(F.collect_list(F.struct("at", "size")).alias("s"))
    both = parts.join(spans, "__id", "left").select("__id", "start", "hashes", F.col("s.at").alias("a"), F.col("s.size").alias("k"))

    def run(batches):
        for batch in batches:
            hashes, base = _lists(batch.column(2))
            every = textscan.long_windows(hashes.view(np.uint64), n)
            size = np.diff(base)
            row = np.repeat(np.arange(batch.num_rows), size)[: len(every)]
            left = np.arange(len(every)) - base[row] <= size[row] - n
            start = batch.column(1).to_numpy()
            a, of = _lists(pc.fill_null(batch.column(3), []))
            if len(a):
                own = np.repeat(np.arange(batch.num_rows), np.diff(of))
                k = pc.fill_null(batch.column(4), []).flatten().to_numpy()
                low = np.maximum(a - start[own], 0)
                high = np.minimum(a - start[own] + k, size[own]) - n + 1
                good = low < high
                steps = np.zeros(len(hashes) + 1, np.int64)
                np.add.at(steps, (low + base[own])[good], 1)
                np.add.at(steps, (high + base[own])[good], -1)
                left &= np.cumsum(steps)[: len(every)] == 0
            at = np.flatnonzero(left)
            if len(at):
                own = row[at]
                yield pa.RecordBatch.from_arrays([pa.array(every[at].view(np.int64)), batch.column(0).take(pa.array(own)), pa.array(at - base[own] + start[own])], ["h", "__id", "pos"])
        release()

    return bounded(both).mapInArrow(run, "h long, __id long, pos long")


def _repeats(docs: DataFrame, n: int, scratch: Scratch) -> DataFrame:
    """(__id, start, n_words, first_id, first_start): passages of n words or more with an earlier place that has the same words."""
    own = docs.select(row_id(docs).alias("__id"), docs["text"].cast("string").alias("text"))
    found = scratch.write(symbols(own, n), "symbols")
    live = scratch.write(shared(found), "live")
    scratch.drop("symbols")
    parts = scratch.write(stretches(own, live, n), "stretches")  # texts that were shuffled go before words are named
    scratch.drop("live")
    level, told, r = scratch.write(blocks(parts), "level"), None, 0
    while True:
        made = scratch.write(named(level, r, n), f"round{r}")
        here = made.where("name is null").select("__id", "at", "size", "first_id", "first_at")
        told = here if told is None else told.unionByName(here)
        level = made.where("name is not null")
        r += 1
        if r == LEVELS or level.where("fresh").isEmpty():
            break
    told = scratch.write(told, "told")
    scratch.drop("level", *[f"round{i}" for i in range(r)])
    every = scratch.write(windows(parts, told, n), "windows")
    place = F.struct("__id", "pos")
    twice = every.groupBy("h").agg(F.min(place).alias("first"), F.max(place).alias("last")).where("first < last").select("h", "first")
    rest = every.join(twice, "h").where(place > F.col("first")).select("__id", F.col("pos").alias("at"), F.lit(n).alias("size"), F.col("first.__id").alias("first_id"), F.col("first.pos").alias("first_at"))
    both = told.unionByName(rest).withColumn("shift", F.col("first_at") - F.col("at")).withColumn("end", F.col("at") + F.col("size"))
    # places that follow one another as their first places do are one passage
    by = Window.partitionBy("__id", "first_id", "shift").orderBy("at", "end")
    before = F.max("end").over(by.rowsBetween(Window.unboundedPreceding, -1))
    parted = both.withColumn("new", (F.col("at") > F.coalesce(before, F.lit(-1))).cast("int")).withColumn("part", F.sum("new").over(by))
    united = parted.groupBy("__id", "first_id", "shift", "part").agg(F.min("at").alias("start"), F.max("end").alias("end"))
    return united.select("__id", "start", (F.col("end") - F.col("start")).alias("n_words"), "first_id", (F.col("start") + F.col("shift")).alias("first_start"))


def repeats(docs: DataFrame, n: int = MIN_WORDS, scratch: Scratch | None = None, within: bool = True) -> DataFrame:
    """(doc_id, start_word, n_words, first_doc_id, first_word, is_first): passages of n words or more that stand in two places.

    Each passage that has an earlier place, in the order of doc_id and position,
    is reported with such a place, and that place, with is_first, as a passage
    that refers to itself.  All windows of n words that stand in two places are
    in a passage, so all but one place of each are in one that isn't is_first.
    A document's passages may overlap where they repeat different places; an
    earlier place may itself repeat a still earlier one.  Without ``within``
    passages whose earlier place is in the same document are left out, so that
    what is reported repeats across documents.  Words are maximal runs of letters
    and digits, in lower case.  Null and empty texts, and texts of fewer words,
    have none.  Rows that share a doc_id are one document whose passages are
    united; equal rows don't repeat one another then.  A row without doc_id
    counts with an id made from its text, before all others, and is
    reported with a null one.  An empty table gives no rows.  Other columns are
    ignored, whatever their names.
    """
    found = (scratch := scratch or Scratch(docs.sparkSession)).write(_repeats(docs, n, scratch), "passages")
    found = found if within else found.where(F.col("__id") != F.col("first_id"))
    later = found.withColumn("is_first", F.lit(False))
    first = found.select(F.col("first_id").alias("__id"), F.col("first_start").alias("start"), "n_words").distinct()
    first = first.select("*", F.col("__id").alias("first_id"), F.col("start").alias("first_start"), F.lit(True).alias("is_first"))
    return later.unionByName(first).select(id_or_null("__id"), F.col("start").alias("start_word"), "n_words", id_or_null("first_id", "first_doc_id"), F.col("first_start").alias("first_word"), "is_first")


def dedup(docs: DataFrame, n: int = MIN_WORDS, scratch: Scratch | None = None) -> DataFrame:
    """(doc_id, text, n_words_deleted) of every row: the text without passages that stand earlier in the corpus.

    From the first to the last deleted word all goes, signs and blanks between
    them included.  A null text stays null.  Other cases as in repeats().
    """
    scratch = scratch or Scratch(docs.sparkSession)
    spans = _repeats(docs, n, scratch)
    out = scratch.write(spans.groupBy("__id").agg(F.collect_list(F.struct("start", "n_words")).alias("s")).select("__id", F.transform("s", lambda x: x["start"]).alias("starts"), F.transform("s", lambda x: x["n_words"]).alias("sizes")), "spans")
    own = docs.select(row_id(docs).alias("__id"), docs["text"].cast("string").alias("text"))
    own = lookup(own, out, "left", F.size("starts") * 16 + 48).select("__id", "text", "starts", "sizes")

    def piece(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, gone = batch.column(1).to_pylist(), [0] * batch.num_rows
        w = textscan.words(batch.column(1))
        for d, (starts, sizes) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())):
            if not starts or texts[d] is None:
                continue
            p, q = int(w.offsets[d]), int(w.offsets[d + 1])
            dead = np.zeros(q - p + 1, np.int64)
            for a, k in zip(starts, sizes):
                if a + k <= q - p:
                    dead[a] += 1
                    dead[a + k] -= 1
            dead = np.cumsum(dead[:-1]) > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[False], dead, [False]]).astype(np.int8)))
            text, last, parts = texts[d], 0, []
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist()):
                parts.append(text[last : int(w.first[p + a])])
                last = int(w.last[p + b - 1])
            texts[d], gone[d] = "".join(parts) + text[last:], int(dead.sum())
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(gone, pa.int64())], ["__id", "text", "n"])

    return mapped(own, "__id long, text string, n long", piece).select(id_or_null("__id"), "text", F.col("n").alias("n_words_deleted"))
