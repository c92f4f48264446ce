"""Mixing sources to target weights by Sainte-Lague apportionment, with SQL expressions only.

1. Each source gets a target: its weight's share of all sizes, stopped at ``max_epochs`` times
   its own size, the excess reshared by weight among the rest (water filling, in closed form over
   the sources sorted by capacity per weight).
2. The mix is cut into blocks of ``block_words`` words. Sainte-Lague gives each source its number
   of blocks, and again each shard of a source: seats go to the highest quotients
   ``target / (2k + 1)``. All but a few seats follow from rounding ``target / divisor``; the
   quotients near the last seat alone are ranked, so the work is linear in the number of sources.
3. A shard lines its documents up in a seeded order and its blocks are the first ones of that
   line, read round and round up to ``max_epochs`` times. Where a round ends inside a document,
   that document's taken words are partial.

Shards hold about ``shard_docs`` documents, so a source of any size is spread over many tasks. The plans of
sources and of shards, a row each, are cut off while the mix is planned: words are counted once for each of the two
and once for the result.

Defined cases: null text has size 0 and takes 0; a null source is a source of its own (last);
ids that repeat or are null stay rows of their own; documents that tie in the seeded
order are lined up by id and size; a text of any length is one row, whose words may be taken in part;
an empty table gives no rows; other columns pass through untouched unless they clash with the output's
names, which then win.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lexaudit.llm.common import cut, word_count

BLOCK_WORDS = 64
SHARD_DOCS = 2000
MAX_EPOCHS = 3
SEED = "mix-17"


def targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """``sizes``: one row per source (``source``, ``source_size``, ``weight``); adds ``target``.

    A source is capped if its capacity per weight is at most the level that the rest would get.
    Sorted by capacity per weight, capped sources form a prefix."""
    cap = F.col("source_size") * F.lit(float(max_epochs))
    line = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    rest = (F.col("all_size") - F.col("cap_before")) / F.col("weight_left")
    levels = (
        sizes.withColumn("cap", cap)
        .withColumn("all_size", F.sum("source_size").over(W.partitionBy()).cast("double"))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(line.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(line.rowsBetween(0, W.unboundedFollowing)).cast("double"))
        .withColumn("level", F.when(F.col("cap") / F.col("weight") >= rest, F.struct(F.row_number().over(line).alias("place"), rest.alias("level"))))
        .withColumn("level", F.min("level").over(W.partitionBy())["level"])  # that of the first source below its cap
    )
    return levels.select("source", "source_size", "weight", F.least("cap", F.col("level") * F.col("weight")).alias("target"))


def sainte_lague(shares: DataFrame, seats: Column, group: list[str], ident: list[str], share: str, out: str) -> DataFrame:
    """Adds ``out``: each row's seats, ``seats`` in all for each group, by the highest quotients.

    ``seats`` is constant in a group. Rounding ``share / divisor`` with the proportional divisor
    misses the total by fewer than the group's rows; only the quotients that can make up the
    difference are listed and ranked."""
    g = W.partitionBy(*group) if group else W.partitionBy()
    near = (
        shares.withColumn("_total", F.sum(share).over(g))
        .withColumn("_seats", seats.cast("long"))
        .withColumn("_n", F.count(F.lit(1)).over(g))
        .withColumn("_fair", F.when(F.col("_total") > 0, F.col(share) * F.col("_seats") / F.col("_total")).otherwise(F.lit(0.0)))
        .withColumn("_first", F.floor(F.col("_fair") + 0.5).cast("long"))
        .withColumn("_miss", F.when(F.col("_total") > 0, F.col("_seats") - F.sum("_first").over(g)).otherwise(F.lit(0)))
        .withColumn("_reach", F.when(F.col("_total") > 0, F.ceil((F.abs("_miss") + F.col("_n")) * F.col(share) / F.col("_total"))).otherwise(F.lit(0)).cast("long") + 1)
    )
    # steps up: seats first, first+1, ...; steps down: seats first-1, first-2, ...
    steps = F.when(F.col("_miss") > 0, F.sequence(F.col("_first"), F.col("_first") + F.col("_reach"))).otherwise(
        F.when((F.col("_miss") < 0) & (F.col("_first") > 0), F.sequence(F.greatest(F.col("_first") - F.col("_reach"), F.lit(0)), F.col("_first") - 1))
    )
    ranked = near.filter(F.col("_miss") != 0).select(*group, *ident, "_miss", share, F.explode(steps).alias("_k")).withColumn("_q", F.col(share) / (2 * F.col("_k") + 1))
    order = [F.when(F.col("_miss") > 0, -F.col("_q")).otherwise(F.col("_q")), *[F.col(c) for c in ident]]
    won = (
        ranked.withColumn("_rank", F.row_number().over(g.orderBy(*order, "_k")))
        .filter(F.col("_rank") <= F.abs("_miss"))
        .groupBy(*group, *ident)
        .agg(F.sum(F.signum("_miss")).cast("long").alias("_more"))
    )
    keys = [*group, *ident]
    left, right = near.alias("l"), won.alias("r")
    on = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in keys]
    joined = left.join(right, on, "left").select(*[F.col(f"l.{c}") for c in near.columns], F.coalesce(F.col("r._more"), F.lit(0)).alias("_more"))
    return joined.withColumn(out, F.col("_first") + F.col("_more")).drop("_total", "_seats", "_n", "_fair", "_first", "_miss", "_reach", "_more")


def mix(
    docs: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    source: str = "source",
    block_words: int = BLOCK_WORDS,
    shard_docs: int = SHARD_DOCS,
    max_epochs: int = MAX_EPOCHS,
    seed: str = SEED,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Per document: ``doc_id, size, source_size, target, taken`` and the columns in ``keep``."""
    own = {"doc_id", "size", "source_size", "target", "taken", "source", "n_docs", "shard", "digest"}
    kept = [c for c in keep if c not in own]
    sized = docs.select(F.col(doc).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), *kept).withColumn(
        "digest", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("size").cast("string")))
    )
    bare = sized.select("doc_id", "source", "size", "digest")
    sizes = bare.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    weighted = sizes.withColumn("weight", (F.row_number().over(by_name) - 1) % 3 + 1)
    aimed = targets(weighted, max_epochs).withColumn("n_blocks", F.floor(F.sum("target").over(W.partitionBy()) / block_words))
    quotas = sainte_lague(aimed, F.col("n_blocks"), [], ["source"], "target", "quota").select(F.col("source").alias("s"), "source_size", "target", "quota")
    counts = sizes.select(F.col("source").alias("s2"), "n_docs")
    plan = cut(quotas.join(counts, F.col("s").eqNullSafe(F.col("s2"))).select("s", "source_size", "target", "quota", F.ceil(F.col("n_docs") / shard_docs).alias("n_shards")))
    at = F.conv(F.substring("digest", 1, 8), 16, 10).cast("long") % F.col("n_shards")
    dealt = sized.join(plan, F.col("source").eqNullSafe(F.col("s"))).withColumn("shard", at)
    shards = dealt.groupBy("s", "shard").agg(F.sum("size").alias("shard_size"), F.first("quota").alias("quota"))
    shared = sainte_lague(shards, F.col("quota"), ["s"], ["shard"], "shard_size", "blocks")
    words = F.least(F.col("blocks") * block_words, F.col("shard_size") * max_epochs)
    shard_plan = cut(shared.select(F.col("s").alias("ps"), F.col("shard").alias("pshard"), "shard_size", words.alias("words")))
    both = dealt.join(shard_plan, F.col("s").eqNullSafe(F.col("ps")) & (F.col("shard") == F.col("pshard")))
    line = W.partitionBy("s", "shard").orderBy("digest", "doc_id", "size").rowsBetween(W.unboundedPreceding, -1)
    start = F.coalesce(F.sum("size").over(line), F.lit(0))
    rounds = F.when(F.col("shard_size") > 0, F.floor(F.col("words") / F.col("shard_size"))).otherwise(F.lit(0))
    left = F.col("words") - F.col("rounds") * F.col("shard_size") - F.col("start")
    taken = F.col("rounds") * F.col("size") + F.greatest(F.lit(0), F.least(F.col("size"), left))
    return (
        both.withColumn("start", start)
        .withColumn("rounds", rounds)
        .select(
            "doc_id",
            "size",
            F.col("source_size").cast("long").alias("source_size"),
            F.col("target").cast("double").alias("target"),
            taken.cast("long").alias("taken"),
            "source",
            *kept,
        )
    )
