"""Queries of the operators: each over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from segmill.llm import counts, decontaminate, embeddings, lines, minhash, mixing, secrets, store, substrings, toxicity
from segmill.llm.common import Scratch, table


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document that has a near-duplicate; cases as in minhash.groups()."""
    return minhash.groups(table(spark, sf_dir, "documents"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks, recipes and manifest of all documents; cases as in store.store()."""
    return store.store(table(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all prefixes of each document; cases as in counts.table()."""
    return counts.table(table(spark, sf_dir, "documents"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages that repeat across documents; cases as in substrings.repeats()."""
    return substrings.repeats(table(spark, sf_dir, "documents"), within=False)


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each vector that has a near-duplicate; cases as in embeddings.classes()."""
    return embeddings.classes(table(spark, sf_dir, "embeddings"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the lines that are aligned with an earlier one; cases as in lines.dedup()."""
    return lines.dedup(table(spark, sf_dir, "documents"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase and proximity matches of all benchmark items; cases as in decontaminate.matches()."""
    return decontaminate.matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each match of a rule; cases as in secrets.scan()."""
    return secrets.scan(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxic documents; cases as in toxicity.score() and toxicity.learn_stems()."""
    return toxicity.score(table(spark, sf_dir, "documents"), toxicity.stems_of(spark, sf_dir)).where("toxic")


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of the largest mix, with their tier; cases as in mixing.mix()."""
    return mixing.mix(table(spark, sf_dir, "documents"), scratch=Scratch(spark)).select("doc_id", "source", F.col("mix_tier").cast("long").alias("mix_tier"))


QUERIES = {f.__name__: f for f in (op1_minhash_dedup, op2_token_store, op3_token_counts, op4_substring_dedup, op5_embedding_dedup, op6_line_dedup, op7_decontamination, op8_secret_scan, op9_toxicity, op10_source_mixing)}


def _secret_sql() -> str:
    parts = []
    for name, regex in secrets.RULES:
        r = regex.replace("'", "''").replace("\\t", "\t").replace("\\n", "\n").replace("\\r", "\r")
        parts.append(
            f"SELECT doc_id, '{name}' AS rule, regexp_extract_all(text, '{r}') AS hits, regexp_split_to_array(text, '{r}') AS rest FROM documents WHERE regexp_matches(text, '{r}')"
        )
    return f"""
WITH found AS ({' UNION ALL '.join(parts)}),
each AS (SELECT doc_id, rule, hits, rest, unnest(range(1, len(hits) + 1)) AS nth FROM found)
SELECT doc_id, rule, nth::BIGINT AS nth,
       (list_sum(list_transform(rest[1:nth], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:nth - 1], lambda x: length(x))), 0))::BIGINT AS start,
       length(hits[nth])::BIGINT AS n_chars, sha256(hits[nth]) AS match_sha256
FROM each"""


_MIX_SQL = f"""
WITH d AS (SELECT doc_id, source, ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, '')), 1, 12))::BIGINT AS h,
                  coalesce(len(regexp_extract_all(text, '[^ \t\n\r]+')), 0)::BIGINT AS n FROM documents),
t AS (SELECT source, sum(n) AS total, pow(sum(n)::DOUBLE, {mixing.TEMPERATURE}::DOUBLE) AS w FROM d GROUP BY source),
u AS (SELECT min(total / w) AS unit FROM t WHERE w > 0 AND total > 0),
b AS (SELECT source, f.tier, floor(round(w * unit * f.part, 3))::BIGINT AS budget FROM t, u, (VALUES {', '.join(f'({i}, {x}::DOUBLE)' for i, x in enumerate(mixing.FRACTIONS))}) f(tier, part)),
r AS (SELECT doc_id, source, sum(n) OVER (PARTITION BY source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM d)
SELECT r.doc_id, r.source, (SELECT min(b.tier) FROM b WHERE b.source IS NOT DISTINCT FROM r.source AND r.run <= b.budget)::BIGINT AS mix_tier
FROM r WHERE EXISTS (SELECT 1 FROM b WHERE b.source IS NOT DISTINCT FROM r.source AND r.run <= b.budget)"""

_LEAK_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT DISTINCT item_id, text FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
q AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM b),
qw AS (SELECT item_id, unnest(range(0, len(w))) AS i, unnest(w) AS t, len(w) AS size, least({decontaminate.N_WORDS}, len(w)) AS need FROM q),
terms AS (SELECT DISTINCT t FROM qw),
dw AS (SELECT doc_id, p, t FROM (SELECT doc_id, unnest(range(0, len(w))) AS p, unnest(w) AS t FROM d) WHERE t IN (SELECT t FROM terms)),
gq AS (SELECT item_id, unnest(range(0, len(w) - least({decontaminate.N_WORDS}, len(w)) + 1)) AS i, w, least({decontaminate.N_WORDS}, len(w)) AS need FROM q WHERE len(w) > 0),
gk AS (SELECT item_id, i, need, array_to_string(w[i + 1:i + need], ' ') AS g FROM gq),
gd AS (SELECT doc_id, p, need, array_to_string(w[p + 1:p + need], ' ') AS g FROM (SELECT doc_id, w, need, unnest(range(0, len(w) - need + 1)) AS p FROM d, (SELECT DISTINCT need FROM gk) WHERE len(w) >= need)),
hit AS (SELECT DISTINCT doc_id, item_id, i, p, p - i AS shift, need FROM gk JOIN gd USING (need, g)),
isle AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, shift ORDER BY i) AS part FROM hit),
phrase AS (SELECT doc_id, item_id, 'phrase' AS kind, min(i)::BIGINT AS item_start, min(p)::BIGINT AS doc_start, (max(i) - min(i) + min(need))::BIGINT AS n_words FROM isle GROUP BY doc_id, item_id, shift, part),
df AS (SELECT t, count(DISTINCT doc_id) AS df FROM dw GROUP BY t),
first AS (SELECT item_id, size, t, min(i) AS i, min(df) AS df FROM qw JOIN df USING (t) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY df, i) AS k, (SELECT count(DISTINCT t) FROM qw x WHERE x.item_id = first.item_id) AS different FROM first),
near AS (SELECT item_id, t, floor(size * 1.5)::BIGINT AS span FROM ranked WHERE k <= {decontaminate.PROXIMITY_TERMS} AND different >= {decontaminate.PROXIMITY_TERMS}
 AND item_id IN (SELECT item_id FROM ranked WHERE k <= {decontaminate.PROXIMITY_TERMS} GROUP BY 1 HAVING count(*) >= {decontaminate.PROXIMITY_LEAST})),
place AS (SELECT doc_id, item_id, p, t, span FROM near JOIN dw USING (t)),
ends AS (SELECT a.doc_id, a.item_id, a.p AS p, min(c.p) AS low, count(DISTINCT c.t) AS have FROM place a JOIN place c ON a.doc_id = c.doc_id AND a.item_id = c.item_id AND c.p <= a.p AND c.p > a.p - a.span GROUP BY 1, 2, 3),
prox AS (SELECT doc_id, item_id, 'proximity' AS kind, 0::BIGINT AS item_start, arg_min(low, (-have * 100000000::BIGINT + p))::BIGINT AS doc_start, max(have)::BIGINT AS n_words FROM ends WHERE have >= {decontaminate.PROXIMITY_LEAST} GROUP BY 1, 2)
SELECT * FROM phrase UNION ALL SELECT * FROM prox"""

#: All pairs of vectors; the least id that a vector reaches along near ones.
_NEAR_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS e FROM embeddings),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) >= {embeddings.THRESHOLD}),
r AS (SELECT a AS node, a AS root FROM p UNION SELECT p.b, r.root FROM r JOIN p ON p.a = r.node),
c AS (SELECT node, min(root) AS class_id FROM r GROUP BY 1),
n AS (SELECT a, count(*) AS n_links FROM p GROUP BY 1)
SELECT node AS vec_id, class_id, count(*) OVER (PARTITION BY class_id) AS n_class, n_links FROM c JOIN n ON n.a = c.node"""

ORACLE_SQL = {"op5_embedding_dedup": _NEAR_SQL, "op7_decontamination": _LEAK_SQL, "op8_secret_scan": _secret_sql(), "op10_source_mixing": _MIX_SQL}
