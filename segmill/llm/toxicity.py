"""Toxicity by a weighted finite-state pattern grammar.

Words become symbols through a lexicon (insult, threat, target, negation, report,
quotation mark, clause end, paragraph end, other).  Small transducers read symbols side by side:
insults and threats give weight, a target close by raises it, a negation before
it and reported or quoted speech around it lower it.  They are composed into one transducer
whose transitions lie in arrays; it scores clause by clause, and a document is
toxic by the sum of its clauses, not by words alone.

The lexicon holds common English words.  ``learn_stems`` adds words and word
beginnings of other languages from labelled rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill.llm import textscan
from segmill.llm.common import Scratch, bounded, has_table, mapped, release, table

OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT, QUOTE, END, TEXT_END = range(9)

INSULTS = "idiot idiots idiotic moron morons moronic stupid trash worthless disgusting scum scumbag loser losers pathetic clown clowns imbecile imbeciles dumbass asshole assholes bastard bastards bitch bitches cretin degenerate dickhead douchebag dumb filthy freak halfwit jackass jerk lowlife maggot parasite pig pigs retard retarded scumbags shithead slut swine twat vermin wanker whore fuck fucker fucking shit".split()
THREATS = "kill murder hurt destroy strangle stab shoot beat rape burn hang slaughter".split()
TARGETS = "you your yours youre u ur he she they them him her his their we us people guys this these those all".split()
NEGATIONS = "not no never isn aren wasn weren don doesn didn won nobody nothing neither nor without hardly".split()
REPORTS = "said says say called calls call calling quoted quotes quote wrote writes reported reports according claimed claims alleged word words term insult insults".split()

#: Weight of an insult, of a threat at a target, and what a target close by multiplies an insult by.
INSULT_WEIGHT, THREAT_WEIGHT, TARGET_FACTOR = 1.0, 1.5, 1.5
#: What a negation before, and reported or quoted speech around, multiply by.
NEGATED_FACTOR, REPORTED_FACTOR = 0.25, 0.25
#: A document is toxic from this score on: two plain insults, or one insult and one threat.
THRESHOLD = 1.9
#: Words within which a target, a negation or a report bears on a hit.
REACH = 3

#: At most so many labelled rows are read to learn stems.
LABELLED_ROWS = 20_000
#: A stem must be in so many different toxic texts, and in no more than this share of clean ones.
STEM_SUPPORT, STEM_CLEAN_SHARE = 4, 0.02
_STEM_LENGTHS = (4, 5, 6, 7, 8)

BASE: dict[str, int] = {w: c for c, ws in ((TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS), (THREAT, THREATS), (INSULT, INSULTS)) for w in ws}


class Transducer:
    """States 0..n-1, a transition for each state and symbol, and a value of each state that the composition reads."""

    def __init__(self, n: int, step):
        self.n, self.step = n, [[step(s, a) for a in range(9)] for s in range(n)]


def _near(symbol: int, clause: bool = True) -> Transducer:
    """State k > 0: the symbol was read less than k words ago; 0: not in reach."""
    return Transducer(REACH + 1, lambda s, a: REACH if a == symbol else 0 if a == TEXT_END or clause and a == END else max(0, s - 1) if a != QUOTE else s)


def _reported() -> Transducer:
    """State 1: a report verb in this clause; 2: inside quotation marks; 3: both."""

    def step(s, a):
        if a == TEXT_END:
            return 0
        if a == END:
            return s & 2
        return s | 1 if a == REPORT else s ^ 2 if a == QUOTE else s

    return Transducer(4, step)


@lru_cache(maxsize=1)
def grammar() -> tuple[np.ndarray, np.ndarray]:
    """(next state, weight in 64ths) of the composed transducer, by state * 9 + symbol.

    A hit's weight is put out where it is read, and a target that follows puts
    out what it adds; the fifth part remembers the last hit for that.
    """
    target, negation, report = _near(TARGET), _near(NEGATION), _reported()
    unit = 64
    kinds = (0.0, INSULT_WEIGHT, INSULT_WEIGHT * NEGATED_FACTOR, THREAT_WEIGHT, THREAT_WEIGHT * NEGATED_FACTOR)
    parts = (range(target.n), range(negation.n), range(report.n), range(len(kinds)), range(REACH + 1))
    number = {s: i for i, s in enumerate(product(*parts))}
    nxt, out = np.zeros(len(number) * 9, np.int32), np.zeros(len(number) * 9, np.int32)
    for (t, n, r, kind, left), i in number.items():
        for a in range(9):
            soft = REPORTED_FACTOR if r else 1.0
            k2, l2, w = kind, max(0, left - 1) if a != QUOTE else left, 0.0
            if a == INSULT or a == THREAT:
                base = 1 if a == INSULT else 3
                k2, l2 = base + (1 if n else 0), REACH
                weight = kinds[k2] * soft
                w = weight * (TARGET_FACTOR if a == INSULT else 1.0) if t else weight if a == INSULT else 0.0
                if t:
                    k2, l2 = 0, 0
            elif a == TARGET and left and kind:
                w = kinds[kind] * soft * (TARGET_FACTOR - 1.0 if kind < 3 else 1.0)
                k2, l2 = 0, 0
            elif a in (END, TEXT_END):
                k2, l2 = 0, 0
            if not l2:
                k2 = 0
            to = (target.step[t][a], negation.step[n][a], report.step[r][a], k2, l2)
            nxt[i * 9 + a], out[i * 9 + a] = number[to] * 9, round(w * unit)
    return nxt, out


class Lexicon:
    def __init__(self, stems=()):
        """stems: beginnings of words that count as insults; one that ends in $ is a whole word."""
        self.stems = tuple(sorted(stems))
        self.words = BASE | {s[:-1]: INSULT for s in self.stems if s.endswith("$")}
        self.begin = defaultdict(set)
        for s in self.stems:
            if not s.endswith("$"):
                self.begin[len(s)].add(s)

    def symbol(self, word: str) -> int:
        found = self.words.get(word)
        if found is None:
            found = INSULT if any(word[:n] in b for n, b in self.begin.items()) else OTHER
        return found


_ENDS = np.array([ord(c) for c in ".!?;:…。！？"], np.uint32)
_QUOTES = np.array([ord(c) for c in '"“”«»„'], np.uint32)


def scores(texts: pa.Array, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """(score, hits) of each text.  Only texts that hold an insult or threat are read by the transducer."""
    n = len(texts)
    score, hits = np.zeros(n), np.zeros(n, np.int64)
    w = textscan.words(texts)
    if not len(w.hash):
        return score, hits
    coded = w.strings().dictionary_encode()
    known = np.array([lexicon.symbol(x) for x in coded.dictionary.to_pylist()], np.uint8)
    symbols = known[coded.indices.to_numpy()]
    hot = (symbols == INSULT) | (symbols == THREAT)
    if not hot.any():
        return score, hits
    nxt, out = (x.tolist() for x in grammar())
    sums = np.append(0, np.cumsum(hot))
    per = sums[w.offsets[1:]] - sums[w.offsets[:-1]]
    for d in np.flatnonzero(per):
        p, q = w.offsets[d], w.offsets[d + 1]
        cp = np.frombuffer(texts[int(d)].as_py().encode("utf-32-le", "surrogatepass"), np.uint32)
        at = w.first[p:q]
        marks = [np.flatnonzero(np.isin(cp, _ENDS)), np.flatnonzero(np.isin(cp, _QUOTES)), np.flatnonzero(cp == 10)]
        where = np.concatenate([at, *marks])
        what = np.concatenate([symbols[p:q], *[np.full(len(m), a, np.uint8) for m, a in zip(marks, (END, QUOTE, TEXT_END))]])
        state = total = 0
        for a in what[np.argsort(where, kind="stable")].tolist():
            total += out[state + a]
            state = nxt[state + a]
        score[d], hits[d] = total / 64, per[d]
    return score, hits


def score(docs: DataFrame, stems=(), threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_hits, score, toxic) of every row.

    Null and empty texts score 0 and aren't toxic.  Repeated rows are scored
    each for itself, a null doc_id stays null.  An empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    lexicon = Lexicon(stems)

    def piece(batch: pa.RecordBatch) -> pa.RecordBatch:
        s, h = scores(batch.column(1), lexicon)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(h, pa.int64()), pa.array(s, pa.float64()), pa.array(s >= threshold)], ["doc_id", "n_hits", "score", "toxic"])

    return mapped(docs.select(docs["doc_id"].cast("long"), docs["text"].cast("string")), "doc_id long, n_hits long, score double, toxic boolean", piece)


def keep(docs: DataFrame, stems=(), threshold: float = THRESHOLD) -> DataFrame:
    """The rows that aren't toxic, unchanged, with all their columns; null and empty texts stay.  Cases as in score()."""
    lexicon = Lexicon(stems)

    @F.arrow_udf("boolean")
    def fine(text):
        kept, (_, offsets) = [np.zeros(0, bool)], textscan.raw(text)
        for i, j in textscan.pieces(offsets):
            kept.append(scores(text.slice(i, j - i), lexicon)[0] < threshold)
        release()
        return pa.array(np.concatenate(kept))

    return bounded(docs).where(fine(docs["text"].cast("string")))


def learn_stems(docs: DataFrame, labels: DataFrame, rows: int = LABELLED_ROWS, support: int = STEM_SUPPORT, clean_share: float = STEM_CLEAN_SHARE, scratch: Scratch | None = None) -> list[str]:
    """Word beginnings that mark toxic documents, from at most ``rows`` labelled rows.

    The rows are those of the least id hashes.  Executors list, for each
    beginning of 4 to 8 letters and each whole word, the toxic texts that hold
    it; of copies of a text the one of the least id counts.  The driver picks stems greedily, the one
    that is in most unexplained toxic texts first; two stems explain a text, and so do two words
    of the base lexicon.  Labels that are null, that
    contradict one another or whose document is missing are left out.  Without
    labels the result is empty.
    """
    usable = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.min("toxic").alias("__toxic"), F.max("toxic").alias("__most")).where("__toxic = __most").select("doc_id", F.col("__toxic").cast("int").alias("__toxic"))
    scratch = scratch or Scratch(docs.sparkSession)
    total = usable.count()
    if not total:
        return []
    share = min(1.0, rows / total)
    picked = usable.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
    seen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").select("doc_id", "text", "__toxic")  # about ``rows`` ids

    def piece(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = textscan.words(batch.column(1))
        strings = w.strings().to_pylist()
        shingles = textscan.windows(w.hash, 3)
        ids, words, copies, base, flags = [], [], [], [], batch.column(2).to_pylist()
        for d, doc in enumerate(batch.column(0).to_pylist()):
            p, q = int(w.offsets[d]), int(w.offsets[d + 1])
            own = shingles[p : q - 2] if q - p > 2 else w.hash[p:q]
            ids.append(doc)
            copies.append(int(own.min() >> np.uint64(1)) if len(own) else -1)
            words.append(sorted({x for x in strings[p:q] if len(x) >= 4}))
            base.append(sum(BASE.get(x) in (INSULT, THREAT) for x in strings[p:q]))
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(copies, pa.int64()), pa.array(flags, pa.int32()), pa.array(base, pa.int64()), pa.array(words, pa.list_(pa.string()))], ["id", "copy", "toxic", "base", "words"])

    rows_ = mapped(seen, "id long, copy long, toxic int, base long, words array<string>", piece)
    rows_ = scratch.write(rows_.groupBy("copy", "toxic").agg(F.min_by(F.struct("base", "words"), F.struct("id", "base", "words")).alias("x")).select("copy", "toxic", "x.base", "x.words"), "labelled")
    lengths = F.array(*map(F.lit, _STEM_LENGTHS))
    begins = F.transform("words", lambda w: F.concat(F.array(F.concat(w, F.lit("$"))), F.transform(F.filter(lengths, lambda n: n <= F.length(w)), lambda n: F.substring(w, F.lit(1), n))))
    at = rows_.select("copy", "toxic", "base", F.explode(F.array_distinct(F.flatten(begins))).alias("stem"))
    marks = (F.col("toxic") == 1) & (F.col("base") < 2)
    counted = at.groupBy("stem").agg(F.count(F.when(F.col("toxic") == 0, 1)).alias("clean"), F.count(F.when(marks, 1)).alias("n"))
    useful = scratch.write(counted.where((F.col("n") >= support) & (F.col("clean") <= clean_share * F.col("n"))), "stems")
    found = at.where(marks).join(useful, "stem").groupBy("stem", "clean").agg(F.collect_set("copy").alias("toxic")).collect()  # as many rows as stems that may serve
    left = {r["stem"]: (set(r["toxic"]), r["clean"]) for r in found if not (r["stem"].rstrip("$") in BASE)}
    stems: list[str] = []
    times: Counter = Counter()  # stems of each text so far; two explain it
    while left:
        best = max(left, key=lambda s: (sum(times[c] < 2 for c in left[s][0]), -left[s][1], -len(s), s))
        if sum(times[c] < 2 for c in left[best][0]) < support:
            break
        stems.append(best)
        times.update(left[best][0])
        plain = best.rstrip("$")
        left = {s: v for s, v in left.items() if not s.startswith(plain) and not plain.startswith(s.rstrip("$"))}
    return stems


def stems_of(spark: SparkSession, sf_dir: str) -> list[str]:
    """Stems learnt from the tables documents and labels; none where there are no labels."""
    return learn_stems(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")) if has_table(spark, sf_dir, "labels") else []
