"""Small tables with the awkward cases: nulls, empty texts and long ones, repeated rows, clashing extra columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, a string, b long, sig string, value long, size int, __id string, h long"


def words(rng, n, vocabulary=4000):
    return [f"w{int(vocabulary ** rng.random())}x{rng.randrange(vocabulary)}" for _ in range(n)]


def frame(spark, rows):
    """rows: (doc_id, text) or (doc_id, text, source); the other columns clash with names that operators use."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", len(r[1] or ""), "extra", 7, "s", 1, 2, "id", 3) for r in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(3)


def corpus(seed=1):
    """Near copies, nulls, empty texts, texts of one word, rows that repeat, a negative id, and a text of 9,000 words."""
    rng = random.Random(seed)
    rows = []
    for i in range(40):
        rows.append((i, " ".join(words(rng, rng.randrange(20, 300)))))
    for i in range(40, 70):  # near copies
        w = rows[rng.randrange(12)][1].split(" ")
        for _ in range(max(1, len(w) // 40)):
            w[rng.randrange(len(w))] = f"changed{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows += [(70, rows[3][1]), (71, rows[3][1]), (72, None), (73, ""), (74, "  \n "), (75, "one"), (76, "one"), (77, "two words"), (None, rows[5][1]), (None, None)]
    rows += [(78, "Ünïcode ΣΙΓΜΑ \U0001f600 " * 5), (78, "Ünïcode ΣΙΓΜΑ \U0001f600 " * 5)]
    rows += [(-5, " ".join(words(rng, 9000)))]
    return rows
