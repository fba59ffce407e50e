import random

import numpy as np
import pyarrow as pa
from fixtures import corpus, frame, words
from segmill.llm import substrings, textscan

N = substrings.MIN_WORDS


def brute(rows, n=N):
    """{(doc, position): first (doc, position)} of every window that stands in two places."""
    places = {}
    for key, text in rows:
        w = textscan.words(pa.array([text], pa.string()))
        h = w.hash.tolist()
        for i in range(len(h) - n + 1):
            places.setdefault(tuple(h[i : i + n]), set()).add((key, i))
    return {p: min(ps) for ps in places.values() if len(ps) > 1 for p in ps}


def check(df, rows, n=N):
    """Passages have the words of their first places, and hold all windows that stand in two places."""
    texts = {key: textscan.words(pa.array([text], pa.string())).hash.tolist() for key, text in rows}
    want, later, every = brute(rows), set(), set()
    for r in df.collect():
        here, there = (r["doc_id"], r["start_word"]), (r["first_doc_id"], r["first_word"])
        size = r["n_words"]
        assert size >= n and texts[here[0]][here[1] : here[1] + size] == texts[there[0]][there[1] : there[1] + size] != []
        assert there == here if r["is_first"] else there < here
        places = {(here[0], here[1] + k) for k in range(size - n + 1)}
        every |= places
        later |= set() if r["is_first"] else places
    assert later == {at for at, first in want.items() if at != first}
    assert every == set(want)


def test_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    check(substrings.repeats(docs), [(r["doc_id"], r["text"]) for r in docs.collect()])


def test_passages_of_all_lengths_are_found(spark):
    rng = random.Random(7)
    rows = []
    for k in range(60):  # a passage of 50 to 109 words in two documents
        passage = words(rng, N + k)
        for half in range(2):
            rows.append((2 * k + half, " ".join(words(rng, rng.randrange(60)) + passage + words(rng, rng.randrange(60)))))
    rows += [(200 + k, " ".join(words(rng, 49))) for k in range(4)]
    near = words(rng, 49)
    rows += [(210, " ".join(["a", *near, "b"])), (211, " ".join(["c", *near, "d"]))]  # 49 words are too few
    rows += [(220, "tick tock " * 90), (221, "tick tock " * 40), (222, "same " * 300)]
    check(substrings.repeats(frame(spark, rows)), rows)


def test_symbols_tile_the_texts():
    w = textscan.words(pa.array(["a b c d e f g h i j k l " * 20, None, "", "x", "y y y y y y y y y y y y"]))
    _, at, size, _, _ = substrings.parse(w.hash, w.offsets)
    assert at[0] == 0 and (at[1:] == at[:-1] + size[:-1]).all() and at[-1] + size[-1] == len(w.hash)
    assert set(w.offsets[:-1][np.diff(w.offsets) > 0].tolist()) <= set(at.tolist())


def test_a_symbol_stands_wherever_its_context_does():
    """Texts of few words that have parts of one another; symbols within a common part are the same."""
    rng = random.Random(11)
    seen = 0
    for turn in range(150):
        pool = [f"w{i}" for i in range(rng.choice([2, 4, 30, 500]))]
        common = [rng.choice(pool) for _ in range(70)]
        found = []
        for _ in range(2):
            before, behind = [rng.choice(pool) for _ in range(rng.randrange(40))], [rng.choice(pool) for _ in range(rng.randrange(40))]
            w = textscan.words(pa.array([" ".join(before + common + behind)]))
            name, at, size, low, high = substrings.parse(w.hash, w.offsets)
            own = (low >= len(before)) & (high <= len(before) + 70)
            found.append(list(zip(*(x.tolist() for x in (name[own], at[own] - len(before), size[own], low[own] - len(before), high[own] - len(before))))))
        assert found[0] == found[1]
        seen += len(found[0])
    assert seen > 500


def test_every_window_holds_a_symbol():
    rng = random.Random(12)
    texts = ["same " * 200, "tick tock " * 90, " ".join(words(rng, 400)), "a b c d e f g h i j k l m " * 20, "short one"]
    w = textscan.words(pa.array(texts))
    _, _, at, size, low, high, valid = substrings.certified(w, N)
    assert (substrings._holding(low, high, len(w.hash), N) >= valid).all() and valid.sum() > 500
    assert (high - low <= N).all() and (low <= at).all() and (high >= at + size).all()


def test_passages_of_passages(spark):
    """Parts of one passage stand in other places than the whole, in both orders, so that first places differ along it."""
    rng = random.Random(13)
    whole = words(rng, 400)
    rows = [(i, " ".join(words(rng, 10) + whole[a:b] + words(rng, 10))) for i, (a, b) in enumerate([(100, 180), (0, 70), (150, 400), (0, 400), (60, 230), (0, 400), (350, 400), (20, 69)])]
    rows += [(20, " ".join(whole[200:300] + whole[50:120] + whole[200:300])), (-4, " ".join(whole[320:390]))]
    check(substrings.repeats(frame(spark, rows)), rows)


def test_dedup_and_cases(spark):
    rng = random.Random(9)
    passage = " ".join(words(rng, 80))
    rows = corpus() + [(100, f"First. {passage}. End."), (101, f"Second, {passage}! Other end."), (102, passage)]
    docs = frame(spark, rows)
    found = {}
    for r in substrings.dedup(docs).collect():
        found.setdefault(r["doc_id"], []).append((r["text"], r["n_words_deleted"]))
    assert sum(map(len, found.values())) == len(rows)
    assert found[100] == [(f"First. {passage}. End.", 0)]
    assert found[101] == [("Second, ! Other end.", 80)] and found[102] == [("", 80)]
    assert found[72] == [(None, 0)] and found[73] == [("", 0)]
    for key, text in rows:
        if key in (70, 71):
            n = len(textscan.words(pa.array([text])).hash)
            assert found[key][0][1] == (n if n >= N else 0)
    assert substrings.repeats(frame(spark, [])).count() == 0


def test_equal_rows_of_one_document_are_no_repeat(spark):
    text = " ".join(words(random.Random(3), 90))
    assert substrings.repeats(frame(spark, [(1, text), (1, text)])).count() == 0
    assert substrings.repeats(frame(spark, [(1, text), (2, text)])).count() == 2


def test_the_query_tells_what_repeats_across_documents(spark, tmp_path):
    """Passages that a document has twice, and no other has, are left out; all documents of the others are told."""
    from segmill.llm import queries

    rng = random.Random(17)
    own, both = words(rng, 70), words(rng, 60)
    rows = [(1, " ".join(own + words(rng, 9) + own)), (2, " ".join(both + words(rng, 9) + both)), (3, " ".join(words(rng, 20) + both)), (4, "same " * 300)]
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    found = sorted((r["doc_id"], r["start_word"], r["n_words"], r["first_doc_id"], r["first_word"]) for r in queries.op4_substring_dedup(spark, str(tmp_path)).collect())
    assert found == [(2, 0, 60, 2, 0), (3, 20, 60, 2, 0)]
