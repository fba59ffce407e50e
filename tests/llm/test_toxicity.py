import pyarrow as pa
from fixtures import corpus, frame
from segmill.llm import toxicity
from segmill.llm.common import table


def points(text, stems=()):
    return float(toxicity.scores(pa.array([text]), toxicity.Lexicon(stems))[0][0])


def plain(text, stems=()):
    """The grammar read as rules over a list of symbols, word by word."""
    import re

    lexicon = toxicity.Lexicon(stems)
    ends, quotes = set(".!?;:…。！？"), set('"“”«»„')
    symbols = []
    for m in re.finditer(r"[^\W_]+|.|\n", text.lower(), re.S):
        x = m.group()
        if re.match(r"[^\W_]", x):
            symbols.append(lexicon.symbol(x))
        elif x == "\n":
            symbols.append(toxicity.TEXT_END)
        elif x in ends:
            symbols.append(toxicity.END)
        elif x in quotes:
            symbols.append(toxicity.QUOTE)
    total, since = 0.0, {toxicity.TARGET: 99, toxicity.NEGATION: 99}
    reported = quoted = False
    last, age = None, 99
    for a in symbols:
        soft = toxicity.REPORTED_FACTOR if reported or quoted else 1.0
        near = {k: v < toxicity.REACH for k, v in since.items()}
        if a in (toxicity.END, toxicity.TEXT_END):
            since = dict.fromkeys(since, 99)
            reported, last, age = False, None, 99
            quoted = quoted and a != toxicity.TEXT_END
            continue
        if a == toxicity.QUOTE:
            quoted = not quoted
            continue
        if a in (toxicity.INSULT, toxicity.THREAT):
            base = (toxicity.INSULT_WEIGHT if a == toxicity.INSULT else toxicity.THREAT_WEIGHT) * (toxicity.NEGATED_FACTOR if near[toxicity.NEGATION] else 1)
            if near[toxicity.TARGET]:
                total += base * soft * (toxicity.TARGET_FACTOR if a == toxicity.INSULT else 1)
                last, age = None, 99
            else:
                total += base * soft if a == toxicity.INSULT else 0
                last, age = (a, base), 0
        elif a == toxicity.TARGET and last and age < toxicity.REACH:
            total += last[1] * soft * (toxicity.TARGET_FACTOR - 1 if last[0] == toxicity.INSULT else 1)
            last, age = None, 99
        else:
            age += 1
        since = {k: v + 1 for k, v in since.items()}
        if a in since:
            since[a] = 0
        if a == toxicity.REPORT:
            reported = True
    return total


def test_clauses_count_more_than_words():
    insult = points("You are an idiot.")
    assert insult == 1.5 > points("An idiot is a word here.") > 0
    assert points("You are not an idiot.") < 0.5
    assert points('They said "you idiot".') < 0.5
    assert points("I will kill you.") == 1.5 and points("Kill the process.") == 0
    assert points("You idiot, you pathetic loser! I will hurt you.") >= toxicity.THRESHOLD
    assert points("") == 0 and points("All is well.") == 0


def test_grammar_equals_its_rules():
    import random

    rng = random.Random(6)
    pool = ["idiot", "moron", "kill", "hurt", "you", "they", "not", "never", "said", "called", "word", "house", "tree", "a", ".", "!", '"', "\n", ",", ";"]
    for _ in range(400):
        text = " ".join(rng.choice(pool) for _ in range(rng.randrange(1, 25)))
        assert abs(points(text) - plain(text)) < 0.05, text


def test_held_out_labels(spark):
    """Stems are learnt from four fifths of the documents; the toxic ones of the last fifth are then told from the others.

    The table has some 15 to 50 different toxic texts in each language but
    English, with many words that only few of them have: what recall there is
    in those languages is learnt from them.
    """
    sf = "/root/testdata/sf0.1"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    stems = toxicity.learn_stems(docs.where("doc_id % 5 <> 1"), labels)
    held = docs.where("doc_id % 5 = 1")
    scored = toxicity.score(held, stems).join(held.select("doc_id", "lang"), "doc_id")
    found = scored.join(labels.where("toxic is not null").select("doc_id", labels["toxic"].alias("label")), "doc_id").toPandas()
    toxic = found["label"] == 1
    hit = toxic & found["toxic"]
    assert hit.sum() >= 0.95 * found["toxic"].sum() and toxic.sum() > 70
    assert hit[found["lang"] == "en"].sum() >= 0.9 * toxic[found["lang"] == "en"].sum()
    assert hit[found["lang"] != "en"].sum() >= 0.5 * toxic[found["lang"] != "en"].sum() and hit.sum() >= 0.75 * toxic.sum()


def test_labels_that_say_nothing(spark):
    """Null, contradicting and orphan labels, and ids that are null, teach nothing; an empty table of documents neither."""
    rows = [(i, f"the zyxwvut {i} day") for i in range(40)]
    said = [(i, 0, 1) for i in range(20)] + [(i, 0, 0) for i in range(20)] + [(i, 0, None) for i in range(20, 40)] + [(None, 0, 1)] * 9 + [(900 + i, 0, 1) for i in range(20)]
    labels = spark.createDataFrame(said, "doc_id long, quality int, toxic int")
    assert toxicity.learn_stems(frame(spark, rows), labels) == []
    assert toxicity.learn_stems(frame(spark, []), labels) == []
    clear = spark.createDataFrame([(i, 0, int(i < 20)) for i in range(40)], "doc_id long, quality int, toxic int")
    assert toxicity.learn_stems(frame(spark, [(i, f"the {'zyxwvut' if i < 20 else 'plain'} {i} day qq{i}") for i in range(40)]), clear) != []


def test_a_very_long_text(spark):
    body = "All is well with the tree. " * 40_000
    found = {r["doc_id"]: r["toxic"] for r in toxicity.score(frame(spark, [(-1, body), (-2, body + "You idiot, you moron!"), (3, "fine")])).collect()}
    assert found == {-1: False, -2: True, 3: False}


def test_cases(spark):
    rows = corpus() + [(200, "You idiot, you moron. I will kill you!"), (200, "You idiot, you moron. I will kill you!"), (None, "You idiot, you moron. I will kill you!")]
    docs = frame(spark, rows)
    found = toxicity.score(docs).collect()
    assert len(found) == len(rows) and sum(r["toxic"] for r in found) == 3
    kept = toxicity.keep(docs)
    assert kept.columns == docs.columns and kept.count() == len(rows) - 3
    empty = frame(spark, [])
    assert toxicity.score(empty).count() == 0 and toxicity.keep(empty).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.learn_stems(docs, none) == []
