"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Targets come from the weights by filling to capacity. The blocks of the mix are then dealt to
the sources, and each source's blocks to its shards, by the highest quotients of the divisors
1, 3, 5, ...: integer quotas that add up. A source's shards are dealt to by way of racks of
RACK shards each, so no step ranks all shards of a source at once. In a shard, the documents
stand on one line of tokens in seeded order, which is cut into blocks; the shard's quota of
blocks is a number of whole rounds of the line and, for the remainder, the blocks that follow
each other from a seeded one on. So blocks are selected by one draw for each shard from documents
shuffled before, not by a draw for each block. Everything is DataFrame operations; only (id,
source, size, a hash of the text) is shuffled.

Rows that are alike in id, source, size and text are counted before the shuffle and laid on the line
together, in portions of at most PORTION rows, so that any number of rows without ids is dealt
to as many shards as their tokens are worth. Rows without tokens need no shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quernlex.session import checkpoint

WEIGHTS = (3.0, 1.0, 2.0)
BLOCK_TOKENS = 8
SHARD_TOKENS = 1_000_000
SEED = 20_011
#: Shards of a source that are ranked at once, and rows alike that are laid on a line at once.
RACK, PORTION = 1024, 1000


def word_count(text: Column) -> Column:
    """The number of maximal runs of characters other than 0x20 and 0x09-0x0D; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def apportion(parties: DataFrame, within: list[str], seats: str, votes: str, order: list[Column]) -> DataFrame:
    """parties with a column `quota`: Sainte-Lague seats for each, among those equal in `within`.

    `seats` (the same for all parties of a group) are dealt to the highest quotients
    votes / (2 s - 1). A divisor so large that its seats can't exceed the total gives a base
    that every party surely has; only the few seats between that base and what a divisor on
    the other side allows are ranked, so the rows are in proportion to the parties. Parties
    without votes get none. Ties go by `order`.
    """
    w = Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    total = F.sum(votes).over(w)
    k = F.count(F.when(F.col(votes) > 0, 1)).over(w)
    ask = F.col(seats).cast("double")
    # the factor keeps rounding errors of the division from giving a seat too many or too few
    low = F.floor(F.greatest(F.lit(0.0), F.col(votes) / F.col("_total") * (ask - F.col("_k") / 2) * F.lit(1 - 1e-12) + 0.5))
    high = F.floor(F.col(votes) / F.col("_total") * (ask + F.col("_k") / 2) * F.lit(1 + 1e-12) + 0.5) + 1
    some = (F.col(votes) > 0) & (F.col("_total") > 0) & (F.col(seats) > 0)
    base = (
        parties.withColumns({"_total": total, "_k": k})
        .withColumns({"_low": F.when(some, low).otherwise(0).cast("long"), "_high": F.when(some, high).otherwise(0).cast("long")})
        .withColumn("_left", F.col(seats) - F.sum("_low").over(w))
    )
    tried = base.withColumn("_seat", F.explode_outer(F.when(F.col("_high") > F.col("_low"), F.sequence(F.col("_low") + 1, F.col("_high")))))
    quotient = F.col(votes) / (2 * F.col("_seat") - 1)
    place = F.row_number().over(w.orderBy(F.col("_seat").isNull(), quotient.desc(), *order, F.col("_seat")))
    won = F.when(F.col("_seat").isNotNull() & (F.col("_place") <= F.col("_left")), 1).otherwise(0)
    back = [c for c in parties.columns]
    return (
        tried.withColumn("_place", place)
        .groupBy(*back, "_low")
        .agg(F.sum(won).alias("_won"))
        .select(*back, (F.col("_low") + F.col("_won")).alias("quota"))
    )


def targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """One row per source: source, source_size, place, target.

    Sources in code point order, null last, have the weights in turn. They share `share` of all
    tokens; a target stops at `most` times its source's size, and the excess goes to the others
    by weight until none is above. With caps in the order of cap / weight, that is one level:
    the first at which what is left for the rest doesn't reach the next cap.
    """
    per = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    per = per.withColumn("place", F.row_number().over(by_name) - 1).withColumn("w", F.element_at(listed, (F.col("place") % len(weights)) + 1))
    per = per.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    up = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("w"), "place")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    rest = up.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy(F.lit(0))
    per = per.withColumns(
        {
            "_all": F.sum("source_size").over(everything) * F.lit(float(share)),
            "_full": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
            "_w": F.sum("w").over(rest),
        }
    )
    level = (F.col("_all") - F.col("_full")) / F.col("_w")
    per = per.withColumns({"_level": level, "_rank": F.when(level * F.col("w") <= F.col("cap"), F.row_number().over(up))})
    per = per.withColumn("level", F.min_by("_level", "_rank").over(everything))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), F.col("level") * F.col("w")))
    return per.select("source", "source_size", "place", target.alias("target"))


def _dealt(shards: DataFrame) -> DataFrame:
    """shards (place, shard, shard_size, source_quota) with quota: racks of a source first, then shards of a rack."""
    racked = shards.withColumn("rack", F.floor(F.col("shard") / RACK).cast("int"))
    racks = racked.groupBy("place", "rack", "source_quota").agg(F.sum("shard_size").alias("rack_size"))
    racks = apportion(racks, ["place"], "source_quota", "rack_size", [F.col("rack")]).select("place", "rack", F.col("quota").alias("rack_quota"))
    return apportion(racked.drop("source_quota").join(racks, ["place", "rack"]), ["place", "rack"], "rack_quota", "shard_size", [F.col("shard")])


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    share: float = 1.5,
    most: float = 2.0,
    weights: tuple[float, ...] = WEIGHTS,
    block_tokens: int = BLOCK_TOKENS,
    shard_tokens: int = SHARD_TOKENS,
    seed: int = SEED,
) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken.

    size counts the text's words (null: 0); taken is how many words the mix takes of the
    document, repeats counted, at most `most` (rounded up) times its size. Null sources are one
    source, the last. Rows with a null or repeated id are documents of their own; equal rows
    may swap their shares, which leaves the same rows. A source without words has target 0.
    Empty tables give no rows; texts may be of any length; other columns are not read, so their
    names may be any. Reruns agree: order and selection are hashes of ids, texts and the seed,
    never row positions. Sources, not documents, are listed in one place.
    """
    text = F.col(text_col)
    alike = ["doc_id", "source", "size", "body"]
    counted = checkpoint(
        docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), word_count(text).alias("size"), F.xxhash64(text).alias("body")).groupBy(*alike).agg(F.count(F.lit(1)).alias("copies"))
    )
    goal = targets(counted.withColumn("size", F.col("size") * F.col("copies")), share, most, weights)
    goal = goal.withColumn("n_shards", F.ceil(F.greatest(F.col("source_size"), F.lit(1)) / shard_tokens).cast("int"))
    blocks = F.greatest(F.lit(0), F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / block_tokens)).cast("long")
    goal = apportion(goal.withColumn("seats", blocks), [], "seats", "target", [F.col("place")]).withColumnRenamed("quota", "source_quota")
    # the keys of a source are never null: its place stands for it from here on
    named = counted.join(goal.select(F.col("source").alias("s"), "place", "source_size", "target", "n_shards"), F.col("source").eqNullSafe(F.col("s")))
    number = F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / PORTION))
    placed = named.withColumn("portion", F.explode(number)).withColumn("n", F.least(F.lit(PORTION), F.col("copies") - F.col("portion") * PORTION).cast("int"))
    placed = placed.withColumn("draw", F.xxhash64("doc_id", "body", "portion", F.lit(seed))).withColumn("length", F.col("size") * F.col("n"))
    bare = placed.where("size = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), "n")
    placed = placed.where("size > 0").withColumn("shard", F.pmod(F.xxhash64("draw", F.lit(seed + 1)), F.col("n_shards")).cast("int"))
    shards = placed.groupBy("place", "shard").agg(F.sum("length").alias("shard_size"))
    shards = _dealt(shards.join(goal.select("place", "source_quota"), "place"))
    line = F.ceil(F.col("shard_size") / block_tokens).cast("long")
    quota = F.least(F.col("quota"), F.floor(line * F.lit(float(most))))
    shards = shards.select(
        "place",
        "shard",
        (line * block_tokens).alias("ring"),
        F.floor(quota / line).alias("rounds"),
        ((quota % line) * block_tokens).alias("arc"),
        (F.pmod(F.xxhash64("place", "shard", F.lit(seed + 2)), line) * block_tokens).alias("from"),
    )
    seeded = Window.partitionBy("place", "shard").orderBy("draw", "doc_id", "body", "size", "portion")
    ends = F.sum("length").over(seeded.rowsBetween(Window.unboundedPreceding, 0))
    laid = placed.withColumn("begin", ends - F.col("length")).join(shards, ["place", "shard"])
    # each row of a portion has its own place on the line
    laid = laid.withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("a", F.col("begin") + F.col("copy") * F.col("size"))
    laid = laid.withColumn("z", F.col("a") + F.col("size"))

    def overlap(lo: Column, hi: Column) -> Column:
        return F.greatest(F.lit(0), F.least(F.col("z"), hi) - F.greatest(F.col("a"), lo))

    end = F.col("from") + F.col("arc")
    picked = overlap(F.col("from"), F.least(end, F.col("ring"))) + F.when(end > F.col("ring"), overlap(F.lit(0), end - F.col("ring"))).otherwise(0)
    taken = (F.col("rounds") * F.col("size") + picked).cast("long")
    out = ["doc_id", "size", "source_size", "target", "taken"]
    bare = bare.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n")))).select(*out)
    return laid.withColumn("taken", taken).select(*out).union(bare)
