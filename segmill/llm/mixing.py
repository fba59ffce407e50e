"""Mixing sources to target weights with hash-threshold histograms.

Every document gets a hash of its id, uniform on [0, 2**48).  Tokens are summed
by source and hash bucket; the buckets below a source's budget are kept whole,
and only its boundary bucket is cut into finer buckets, down to single hashes.
The thresholds so found filter the documents in one pass without a sort.
Thresholds of smaller budgets lie below those of larger ones, so that the
subsets are nested.

What is gathered is sources x 4096 rows at most, whatever the corpus holds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Share of the largest mix that the nested subsets hold.
FRACTIONS = (0.25, 0.5, 1.0)
#: Default weights are proportional to a source's tokens to this power.
TEMPERATURE = 0.7
_BITS = 12


def hash48(key, seed: str = "mix"):
    """48 bits of MD5 of seed and id: the same number in any engine that has MD5."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 12), 16, 10).cast("long")


def token_count(text):
    """Words between blanks, tabs and line ends; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("long")


def budgets(totals: DataFrame, weights: dict[str, float] | None, fractions=FRACTIONS) -> DataFrame:
    """(source, tier, budget): the largest mix of the target weights in which no source is repeated, times each fraction.

    A source without a weight, or with weight 0, gets budget 0.
    """
    if weights is None:
        w = totals.withColumn("__w", F.pow(F.col("__sum").cast("double"), F.lit(TEMPERATURE)))
    else:
        case = F.lit(None).cast("double")
        for name, value in weights.items():
            case = F.when(F.col("__source") == name, F.lit(float(value))).otherwise(case)
        w = totals.withColumn("__w", F.coalesce(case, F.lit(0.0)))
    size = w.where("__w > 0 and __sum > 0").agg(F.min(F.col("__sum") / F.col("__w")).alias("__unit"))
    tiers = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.lit(float(x)).alias("f")) for i, x in enumerate(fractions)]))
    return (
        w.crossJoin(F.broadcast(size))  # one row
        .select("__source", "__sum", "__w", "__unit", tiers.alias("__t"))
        .select("__source", F.col("__t.t").alias("__tier"), F.floor(F.coalesce(F.round(F.col("__w") * F.col("__unit") * F.col("__t.f"), 3), F.lit(0.0))).cast("long").alias("__budget"))
    )


def thresholds(hashed: DataFrame, limits: DataFrame) -> DataFrame:
    """(source, tier, threshold): documents with hash below the threshold fit the budget.

    hashed has __source, __hash, __tokens.  Each of the four levels sums the
    tokens of the boundary buckets alone, by their next 12 bits.
    """
    found = None
    open_ = limits.select("__source", "__tier", F.lit(0).cast("long").alias("__prefix"), F.col("__budget").alias("__left"))
    for level in range(1, 48 // _BITS + 1):
        shift = 48 - _BITS * level
        bucket = F.shiftright("__hash", shift)
        if level == 1:
            sums = hashed.groupBy("__source", bucket.alias("__bucket")).agg(F.sum("__tokens").alias("__n"))
            per = open_.withColumnRenamed("__source", "__s").join(sums, F.col("__s").eqNullSafe(F.col("__source"))).select("__source", "__tier", "__left", "__bucket", "__n")
        else:
            wanted = open_.select(F.col("__source").alias("__s"), F.col("__prefix").alias("__p")).distinct()
            sums = (
                hashed.join(wanted, F.col("__s").eqNullSafe(F.col("__source")) & (F.shiftright("__hash", shift + _BITS) == F.col("__p")), "left_semi")
                .groupBy("__source", bucket.alias("__bucket"))
                .agg(F.sum("__tokens").alias("__n"))
            )
            per = (
                open_.withColumnRenamed("__source", "__s")
                .join(sums, F.col("__s").eqNullSafe(F.col("__source")) & (F.shiftright("__bucket", _BITS) == F.col("__prefix")))
                .select("__source", "__tier", "__left", "__bucket", "__n")
            )
        w = Window.partitionBy("__source", "__tier").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        run = per.withColumn("__run", F.sum("__n").over(w))
        over = run.where("__run > __left").groupBy("__source", "__tier").agg(F.min_by(F.struct("__bucket", (F.col("__left") - (F.col("__run") - F.col("__n"))).alias("__left")), "__bucket").alias("__b"))
        edge = over.select("__source", "__tier", F.col("__b.__bucket").alias("__prefix"), F.col("__b.__left").alias("__left"))
        if level == 48 // _BITS:
            done = edge.select("__source", "__tier", F.col("__prefix").alias("__threshold"))
        else:
            done = None
        if level == 1:  # sources that fit whole
            whole = open_.select("__source", "__tier").join(edge.select(F.col("__source").alias("__s"), F.col("__tier").alias("__t")), F.col("__s").eqNullSafe(F.col("__source")) & (F.col("__t") == F.col("__tier")), "left_anti")
            found = whole.select("__source", "__tier", F.lit(1 << 48).cast("long").alias("__threshold"))
        if done is not None:
            found = found.unionByName(done)
        open_ = edge
    return found


def free_name(wanted: str, taken) -> str:
    """The name, or where a column has it (in whatever case) the name with the first free number."""
    used, name, k = {c.lower() for c in taken}, wanted, 0
    while name.lower() in used:
        k += 1
        name = f"{wanted}_{k}"
    return name


def _mixed(docs: DataFrame, weights, fractions, seed: str, scratch, tier: str) -> DataFrame:
    key = F.coalesce(docs["doc_id"].cast("string"), F.lit(""))
    hashed = docs.select(docs["source"].alias("__source"), hash48(key, seed).alias("__hash"), token_count(docs["text"]).alias("__tokens"))
    if scratch is not None:
        hashed = scratch.write(hashed, "hashed")
    totals = hashed.groupBy("__source").agg(F.sum("__tokens").alias("__sum"))
    found = thresholds(hashed, budgets(totals, weights, fractions))
    source, limits = free_name("__segmill_source", docs.columns), free_name("__segmill_limits", docs.columns)
    cut = found.groupBy(F.col("__source").alias(source)).agg(F.map_from_entries(F.collect_list(F.struct("__tier", "__threshold"))).alias(limits))  # a row for each source
    if scratch is not None:
        cut = scratch.write(cut, "thresholds")
    h, least = hash48(key, seed), F.lit(None).cast("int")
    for i in reversed(range(len(fractions))):
        least = F.when(h < cut[limits][i], F.lit(i)).otherwise(least)
    own = [docs[f"`{c}`"] for c in docs.columns]
    return docs.join(cut, cut[source].eqNullSafe(docs["source"])).select(*own, least.alias(tier)).where(F.col(f"`{tier}`").isNotNull())


def mix(docs: DataFrame, weights: dict[str, float] | None = None, fractions=FRACTIONS, seed: str = "mix", scratch=None) -> DataFrame:
    """Documents of the mix, with ``mix_tier``: the smallest nested subset that holds the row (0 first).

    A source keeps its documents in the order of their hash as long as their
    running token sum stays within its budget.  Documents whose hash ties stand
    or fall together.  A null source is a source of its own.  A null id hashes
    as the empty string; repeated rows tie.  Null and empty texts, and others
    without tokens, cost nothing.  An empty table gives no rows.  Other columns
    pass unchanged, whatever their names; where one is called mix_tier, the
    tier's column is mix_tier_1 (or the next free number).
    """
    return _mixed(docs, weights, fractions, seed, scratch, free_name("mix_tier", docs.columns))


def keep(docs: DataFrame, weights: dict[str, float] | None = None, fractions=FRACTIONS, seed: str = "mix", scratch=None) -> DataFrame:
    """The documents of mix() with the columns of docs alone."""
    tier = free_name("mix_tier", docs.columns)
    return _mixed(docs, weights, fractions, seed, scratch, tier).drop(tier)
