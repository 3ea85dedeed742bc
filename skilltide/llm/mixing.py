"""Mixing sources to target weights by Sainte-Lague apportionment, with DataFrame functions only.

Sources in code point order (null last) weigh 1, 2, 3, repeating, and share the
words of all documents. A target stops at ``cap`` times the words of its source;
the excess goes to the others by weight until none is above its cap.

Targets become whole blocks of equal numbers of words: source quotas by highest
quotients (Sainte-Lague), then shard quotas inside each source in the same way.
A shard lays its documents in an order seeded by hash of id and text and cuts them into blocks;
a quota takes whole passes over the shard and, for the rest, its first blocks.
A document is cut only where the last block of a shard ends.

Edge cases: a null text has size 0 and is never taken; null is a source of its
own, after the others; a table without words takes nothing; repeated rows count
each; other columns are not read. Rows of one source are dealt over shards, so a
hot source is never sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD_PATTERN, free_name, written

#: Rows a shard holds on average, and most shards of a source (a bound on what one window over shards sorts).
SHARD_ROWS, MOST_SHARDS = 400, 65_536


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def apportion(parties: DataFrame, group: list[str], key: str, votes: str, seats: str, out: str) -> DataFrame:
    """Sainte-Lague: ``out`` seats for each ``key``; every group has its ``seats`` to give.

    A party's seats differ from its exact share by at most 1 plus the share's
    part of the n/2 seats that rounding can shift, so only quotients in that
    margin around the share are ranked: a few for each party, however many seats.
    """
    every = Window.partitionBy(*group)
    total, n = F.sum(votes).over(every), F.count(F.lit(1)).over(every)
    share = F.when(total > 0, F.col(votes) / total * F.col(seats)).otherwise(F.lit(0.0))
    p = parties.withColumns({"_share": share, "_n": n, "_total": total})
    margin = F.ceil(F.when(F.col(seats) > 0, F.col("_share") * F.col("_n") / (2.0 * F.col(seats))).otherwise(0.0)) + 1
    p = p.withColumn("_margin", margin.cast("long"))
    p = p.withColumn("_base", F.greatest(F.lit(0), F.floor("_share") - F.col("_margin")).cast("long"))
    p = p.withColumn("_open", F.col(seats) - F.sum("_base").over(every))
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("_quotient"), key))
    # A party without votes keeps one line that never wins
    k = F.explode(F.sequence(F.col("_base"), F.floor("_share").cast("long") + F.col("_margin")))
    q = p.withColumn("_k", k).withColumn("_quotient", F.col(votes) / (2 * F.col("_k") + 1)).withColumn("_rank", rank)
    won = F.count_if((F.col("_rank") <= F.col("_open")) & (F.col(votes) > 0))
    return q.groupBy(*group, key).agg((F.first("_base") + won).alias(out))


def targets(sources: DataFrame, cap: int) -> DataFrame:
    """weight and target of every source (source_no, source_size): least(cap * size, level * weight)."""
    nothing = F.lit(1)
    every = Window.partitionBy(nothing)
    s = sources.withColumn("weight", 1 + (F.col("source_no") - 1) % 3).withColumn("_most", cap * F.col("source_size"))
    before = Window.partitionBy(nothing).orderBy(F.col("_most") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    rest = F.sum("source_size").over(every) - F.coalesce(F.sum("_most").over(before), F.lit(0))
    weights = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    s = s.withColumn("_level", rest / weights)
    # In the order of cap to weight, the first source that stays under its cap sets the level for all after it
    first = F.struct(F.col("_most") / F.col("weight"), "source_no", F.col("_level").alias("level"))
    fits = F.min(F.when(F.col("_level") * F.col("weight") <= F.col("_most"), first)).over(every)["level"]
    return s.withColumn("target", F.least(F.col("_most").cast("double"), fits * F.col("weight"))).drop("_level", "_most")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", cap: int = 3, block: int = 16, seed: int = 20) -> DataFrame:
    """doc_id, source, size, source_size, target, taken of every row of ``docs``."""
    order = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), order.alias("_order"))
    sizes = written(sizes, "mixing-sizes")

    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_rows"))
    # One row for each source: the windows below see as many rows as there are sources
    sources = sources.withColumn("source_no", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.asc_nulls_last("source"))))
    sources = targets(sources, cap).withColumn("_seats", F.round(F.sum("source_size").over(Window.partitionBy(F.lit(1))) / block).cast("long"))
    sources = sources.withColumn("_all", F.lit(1)).checkpoint()
    quota = apportion(sources.select("_all", "source_no", "target", "_seats"), ["_all"], "source_no", "target", "_seats", "_quota")
    sources = sources.join(quota.drop("_all"), "source_no")
    shards = F.least(F.lit(MOST_SHARDS), F.greatest(F.lit(1), F.ceil(F.col("_rows") / SHARD_ROWS))).cast("long")
    sources = sources.select(F.col("source").alias("_source"), "source_no", "source_size", "target", "_quota", shards.alias("_shards")).checkpoint()

    d = sizes.join(sources, F.col("source").eqNullSafe(F.col("_source")))
    d = d.withColumn("_shard", F.pmod(F.xxhash64(F.lit(seed + 1), "_order"), "_shards"))

    held = d.groupBy("source_no", "_shard").agg(F.sum("size").alias("_held"), F.first("_quota").alias("_quota"))
    given = apportion(held, ["source_no"], "_shard", "_held", "_quota", "_given")
    given = given.join(held.select("source_no", "_shard", "_held"), ["source_no", "_shard"])
    words = F.least(F.col("_given") * block, F.col("_held") * cap)
    passes = F.when(F.col("_held") > 0, F.floor(words / F.col("_held"))).otherwise(F.lit(0)).cast("long")
    given = given.select("source_no", "_shard", passes.alias("_passes"), (words - passes * F.col("_held")).alias("_rest"))

    along = Window.partitionBy("source_no", "_shard").orderBy("_order", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_before", F.coalesce(F.sum("size").over(along), F.lit(0))).join(given, ["source_no", "_shard"])
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_before")))
    return d.select("doc_id", "source", "size", "source_size", "target", (F.col("_passes") * F.col("size") + part).cast("long").alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as the mix takes it, in whole documents.

    Rows with one id are taken alike. Only the document at the end of a shard's
    last block is taken in part; it is rounded to the nearer whole number.
    """
    plan = mix(docs, **options)
    id_col = options.get("id_col", "doc_id")
    key, copies, copy = (free_name(docs.columns, c) for c in ("_id", "_times", "_copy"))
    times = F.when(F.col("size") > 0, F.round(F.col("taken") / F.col("size"))).otherwise(F.lit(0)).cast("int")
    plan = plan.groupBy("doc_id").agg(F.max(times).alias(copies)).select(F.col("doc_id").alias(key), copies)
    d = docs.join(plan, F.col(id_col).eqNullSafe(F.col(key))).where(F.col(copies) > 0)
    return d.withColumn(copy, F.explode(F.sequence(F.lit(1), copies))).select(*docs.columns)
