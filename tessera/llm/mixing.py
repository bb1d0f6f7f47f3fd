"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

Only DataFrame functions run here. Sources, in code point order with null last, weigh 1, 2, 3, repeating.
Targets share all words by weight, none above ``MAX_REPEAT`` times its source; the excess is shared
again by weight (water-filling in one ordered pass over the sources). Targets become whole blocks of
``BLOCK`` words by highest quotients ``target / (2j + 1)``: first over sources, then within each source
over its shards of about ``SHARD_ROWS`` documents. Quotients are only listed near each party's share,
so the list is linear in the parties. In a shard, documents lie in seeded order and are cut into
blocks; with quota r over n blocks every block is taken ``r div n`` times, and ``r mod n`` of them once more,
chosen by systematic seeded selection.

Null text has size 0; repeated rows count each, and so do rows without doc_id; other columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.shared import Workspace, prepare

BLOCK = 16
SHARD_ROWS = 4096
MAX_REPEAT = 3
SEED = "mix-1"


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _hash(text: Column) -> Column:
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def apportion(parties: DataFrame, group: list[str], weight: str, seats: str, ident: str, out: str) -> DataFrame:
    """Adds ``out``: each party's seats of its group's ``seats``, by highest quotients weight / (2j + 1).

    Ties go to the smaller ``ident``. A party's listed quotients span its rounded share give or take its part
    of the rounding that all parties of the group can cause together.
    """
    whole = Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))
    share = F.when(F.col("_total") > 0, F.col(weight) / F.col("_total")).otherwise(F.lit(0.0))
    p = parties.withColumn("_total", F.sum(weight).over(whole)).withColumn("_n", F.count("*").over(whole))
    near = F.floor(share * F.col(seats) + F.lit(0.5)).cast("long")
    reach = (F.ceil(share * F.col("_n")) + 2).cast("long")
    p = p.withColumn("_low", F.greatest(F.lit(0).cast("long"), near - reach)).withColumn("_high", near + reach)
    listed = p.withColumn("_j", F.explode(F.sequence("_low", "_high"))).withColumn("_open", F.col(seats) - F.sum(F.when(F.col("_j") == F.col("_low"), F.col("_low")).otherwise(0)).over(whole))
    order = (Window.partitionBy(*group) if group else Window.partitionBy(F.lit(0))).orderBy(F.desc(F.col(weight) / (2 * F.col("_j") + 1)), ident, "_j")
    won = listed.withColumn("_place", F.row_number().over(order))
    key = [*group, ident]
    got = won.groupBy(*key).agg((F.max("_low") + F.sum((F.col("_place") <= F.col("_open")).cast("long"))).alias(out))
    renamed = [F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]
    match = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(key)]
    return parties.join(got.select(*renamed, out), match, "left").drop(*[f"_k{i}" for i in range(len(key))])


def mix(docs: DataFrame, block: int = BLOCK, seed: str = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies and ``carry``, one row for each row of ``docs``.

    taken counts the words that the mix takes from the document, repeats included; copies is how often
    the whole document appears when documents are not cut at block edges (its first word's block decides).
    """
    work = Workspace(prepare(docs.sparkSession), "mix")
    sized = docs.select("doc_id", "source", *carry, n_words(F.col("text")).alias("size"), F.md5(F.concat(F.lit(seed + "/"), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")))).alias("_key"))
    sized = work.write(sized, "sized")
    src = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_rows"))
    everything = Window.partitionBy(F.lit(0))
    src = src.withColumn("_rank", F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last()))).withColumn("_w", ((F.col("_rank") - 1) % 3 + 1).cast("long"))
    cap = F.lit(MAX_REPEAT) * F.col("source_size")
    ratio = everything.orderBy((cap / F.col("_w")).asc(), "_rank")
    src = src.withColumn("_all", F.sum("source_size").over(everything))
    src = src.withColumn("_before", F.coalesce(F.sum(cap).over(ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("_left", F.sum("_w").over(ratio.rowsBetween(0, Window.unboundedFollowing)))
    src = src.withColumn("_full", cap * F.col("_left") <= (F.col("_all") - F.col("_before")) * F.col("_w"))
    rest = F.col("_all") - F.sum(F.when(F.col("_full"), cap).otherwise(0)).over(everything)
    free = F.sum(F.when(F.col("_full"), 0).otherwise(F.col("_w"))).over(everything)
    src = src.withColumn("target", F.when(F.col("_full"), cap.cast("double")).otherwise(F.col("_w") * (rest.cast("double") / free)))
    src = src.withColumn("_seats", F.floor(F.sum("target").over(everything) / block + F.lit(0.5)).cast("long"))
    src = src.withColumn("_shards", F.greatest(F.lit(1), F.ceil(F.col("_rows") / SHARD_ROWS)).cast("long"))
    src = apportion(src.select("source", "source_size", "target", "_rank", "_seats", "_shards"), [], "target", "_seats", "_rank", "_quota")
    src = work.write(src.select("source", "source_size", "target", "_rank", "_quota", "_shards"), "sources")
    named = src.withColumnRenamed("source", "_source")
    rows = sized.join(F.broadcast(named) if named.count() <= 100_000 else named, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("_shard", F.conv(F.substring("_key", 1, 8), 16, 10).cast("long") % F.col("_shards"))
    shard = rows.groupBy("_rank", "_shard").agg(F.sum("size").alias("_words"), F.max("_quota").alias("_quota"))
    shard = apportion(shard, ["_rank"], "_words", "_quota", "_shard", "_r").select("_rank", "_shard", "_words", "_r")
    n = F.ceil(F.col("_words") / block).cast("long")
    shard = shard.withColumn("_n", F.greatest(F.lit(1).cast("long"), n)).withColumn("_r", F.least(F.col("_r"), MAX_REPEAT * n))
    shard = shard.withColumn("_o", _hash(F.concat(F.lit(seed), F.lit("/"), F.col("_rank").cast("string"), F.lit("/"), F.col("_shard").cast("string"))) % F.col("_n"))
    rows = rows.drop("_quota").join(shard, ["_rank", "_shard"])
    lie = Window.partitionBy("_rank", "_shard").orderBy("_key", "doc_id", "size", *carry)
    rows = rows.withColumn("_c1", F.sum("size").over(lie.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_c0", F.col("_c1") - F.col("size"))
    turns = F.expr("_r div _n")
    extra = F.col("_r") % F.col("_n")

    def chosen_before(b: Column) -> Column:
        return F.floor((b * extra + F.col("_o")) / F.col("_n")).cast("long")

    def taken_before(c: Column) -> Column:
        b = F.floor(c / block).cast("long")
        return turns * c + block * chosen_before(b) + (c % block) * (chosen_before(b + 1) - chosen_before(b))

    first = F.floor(F.col("_c0") / block).cast("long")
    copies = F.when(F.col("size") > 0, turns + chosen_before(first + 1) - chosen_before(first)).otherwise(0)
    return rows.select("doc_id", "source", *carry, "size", "source_size", "target", (taken_before(F.col("_c1")) - taken_before(F.col("_c0"))).cast("long").alias("taken"), copies.cast("long").alias("copies"))
