"""The corpus pipeline: toxicity, near-dedup, decontamination, source mixing and token output."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from segmill.llm import decontaminate, minhash, mixing, store, toxicity
from segmill.llm.common import Scratch, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar doesn't reject.

    Null and empty texts stay, as do repeated rows, each scored by itself; an
    empty table stays empty.  Without the table labels no stems are learnt.
    """
    return toxicity.keep(docs, toxicity.stems_of(spark, sf_dir))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one of the least id, and all others.

    Null and empty texts are in no group and stay.  Rows that share an id stay
    or go together; rows without one count before all others.  Equal texts are
    near-duplicates.  An empty table stays empty.
    """
    return minhash.keep(docs, scratch=Scratch(spark))


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no phrase of the benchmark.

    Null and empty texts stay.  Rows that share an id stay or go together; one
    without an id goes by its text.  Null items reject nothing, nor does an
    empty benchmark; an empty table stays empty.
    """
    return decontaminate.keep(docs, table(spark, sf_dir, "benchmark"), scratch=Scratch(spark))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The largest mix of the target weights.

    A null source is a source of its own; documents without words cost nothing;
    a null id hashes as the empty string; repeated rows and ties of the hash
    stand or fall together.  An empty table stays empty.
    """
    return mixing.keep(docs, scratch=Scratch(spark))


def store_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks, recipes and manifest of the documents' token ids.

    Null and empty texts have recipes without chunks, repeated rows a recipe
    each; a row without an id has a null one.  An empty table gives no rows.
    """
    return store.store(docs, scratch=Scratch(spark))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark),
    ("source_mixing", mix_sources),
    ("token_store", store_tokens),
]

#: Stages score texts with automata and tokenizers, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each to a written table of what its predecessor kept.

    Columns besides those of documents are passed on, whatever their names.
    """
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = scratch.write(docs, name)
    return docs
