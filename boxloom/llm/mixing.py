"""Mixing sources to target weights by weighted fair queueing (operator 5), with DataFrame functions only.

Documents of a source queue in a shuffled order. The virtual finish time of a document is the words of its source up to and with
it, divided by the source's target; a second pass over the source follows the first. All queues merge by finish time, and the mix
is cut where its words reach the total budget. Sums along an order are taken in two levels, so no source and no table is ever
sorted in one task: sums of hash buckets (or of slices of finish time) first, then positions inside each.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from boxloom.llm.common import WORD_PATTERN, Tables


@dataclass(frozen=True)
class Mix:
    """Weights by place of the source, total as a share of all words, most times a document is taken, seed, slices of finish time up to 1."""

    weights: tuple = (3, 1, 2)
    share: float = 1.5
    passes: int = 2
    seed: str = "mix"
    slices: int = 16384


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("bigint")


def targets(sizes: DataFrame, config: Mix) -> DataFrame:
    """(source, rank, source_size, target): the total by weight, where a source at its limit leaves its excess to the others.

    Sources are taken by limit per weight: one is at its limit if that is less than what each unit of weight still gets when all
    before it have had their limits. One row per source, so the window over all of them is small.
    """
    by_name = Window.orderBy(F.col("source").isNull(), "source")
    listed = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("rank", F.row_number().over(by_name))
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in config.weights)), (F.col("rank") - 1) % len(config.weights) + 1)
    every = Window.partitionBy()
    listed = listed.withColumn("weight", weight).withColumn("most", F.col("source_size") * float(config.passes)).withColumn("budget", F.sum("source_size").over(every) * config.share)
    order = Window.orderBy(F.col("most") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    listed = listed.withColumn("place", F.row_number().over(order))
    left = F.col("budget") - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    listed = listed.withColumn("level", level).withColumn("full", F.col("most") / F.col("weight") < F.col("level"))
    settled = F.expr("min_by(level, if(full, null, place))").over(every)
    target = F.when(F.col("full"), F.col("most")).otherwise(F.least(F.col("most"), settled * F.col("weight")))
    return listed.select("source", "rank", "source_size", target.alias("target"), "budget")


def queued(docs: DataFrame, config: Mix, id_col: str, source_col: str, text_col: str, tables: Tables) -> DataFrame:
    """Every document's turns: (id, source, rank, size, source_size, target, bucket, pos, copy, finish, taken)."""
    sizes = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col).cast("string")).alias("size"))
    sizes = sizes.withColumn("turn", F.md5(F.concat_ws("|", F.lit(config.seed), F.col("id").cast("string")))).withColumn("bucket", F.substring("turn", 1, 3))
    sizes = tables.stored(sizes, "sizes")
    goal = tables.stored(targets(sizes, config), "targets")
    buckets = sizes.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = buckets.withColumn("before", F.coalesce(F.sum("words").over(earlier), F.lit(0))).select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before")
    inside = Window.partitionBy("source", "bucket").orderBy("turn", "id", "size")
    run = sizes.withColumn("pos", F.row_number().over(inside)).withColumn("upto", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    run = run.join(offsets, F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b"))).drop("s", "b")
    run = run.join(goal.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    turns = run.withColumn("copy", F.explode(F.array(*(F.lit(k) for k in range(config.passes)))))
    finish = F.expr("if(target > 0 and size > 0, (copy * source_size + before + upto) / target, null)")
    turns = turns.withColumn("finish", finish).withColumn("slice", F.floor(F.col("finish") * config.slices))
    turns = tables.stored(turns.select("id", "source", "rank", "size", "source_size", "target", "budget", "bucket", "pos", "copy", "finish", "slice"), "turns")
    slices = turns.where("slice is not null").groupBy("slice").agg(F.sum("size").alias("words"))
    slices = slices.withColumn("sofar", F.coalesce(F.sum("words").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    order = Window.partitionBy("slice", F.expr("if(slice is null, bucket, null)")).orderBy("finish", "rank", "bucket", "pos", "copy").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    merged = turns.join(slices.select("slice", "sofar"), "slice", "left")
    return merged.withColumn("taken", F.coalesce(F.col("sofar") + F.sum("size").over(order) <= F.col("budget"), F.lit(False)))


def allotted(docs: DataFrame, config: Mix = Mix(), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", tables: Tables | None = None) -> DataFrame:
    """(id, source, size, source_size, target, taken): a row per row of docs; taken counts words, repeats included.

    A null text has size 0, and what has size 0 is never taken. A null source is a source of its own, the last. Rows that repeat
    an id queue one by one. An empty table gives an empty result. Reruns agree, since the order hangs on ids alone.
    """
    tables = tables or Tables(docs.sparkSession)
    turns = queued(docs, config, id_col, source_col, text_col, tables)
    sums = turns.groupBy("id", "source", "bucket", "pos", "size", "source_size", "target").agg(F.sum(F.when(F.col("taken"), F.col("size")).otherwise(0)).alias("taken"))
    out = tables.stored(sums.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken"), "allotted")
    tables.drop(but=(out,))
    return out


def repeated(docs: DataFrame, config: Mix = Mix(), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, as often as the mix takes them: not at all, once, up to `passes` times. Ids differ.

    A source's finish times rise along its queue and the mix is cut at one finish time, so what it takes is the start of its queue.
    That is one row per source (times taken at most, and the last row taken so often), by which texts are picked where they are read.
    """
    tables = Tables(docs.sparkSession)
    share = allotted(docs, config, id_col, source_col, text_col, tables)
    turn = F.md5(F.concat_ws("|", F.lit(config.seed), F.col(f"`{id_col}`").cast("string")))
    last = F.struct(F.expr("cast(taken / size as int)").alias("copies"), turn.alias("turn"), F.col(f"`{id_col}`").alias("id"))
    ends = tables.stored(share.where("taken > 0").groupBy(F.col(source_col).alias("source")).agg(F.max(last).alias("last")), "ends")
    tables.drop(but=(ends,))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("own"), F.col(source_col).alias("s"), F.struct(turn.alias("turn"), F.col(f"`{id_col}`").alias("id")).alias("place"))
    rows = rows.where(F.col("own").getField(text_col).cast("string").rlike(WORD_PATTERN)).join(ends, F.col("s").eqNullSafe(F.col("source")))
    copies = F.col("last.copies") - F.when(F.col("place") <= F.struct("last.turn", "last.id"), 0).otherwise(1)
    return rows.withColumn("copies", copies).where("copies > 0").select("own", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("own.*")


def mixed(docs: DataFrame, config: Mix = Mix(), id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The mix itself: (id, source, copy, size, finish) of all that is taken, in the order of finish times over the whole table."""
    turns = queued(docs, config, id_col, source_col, text_col, Tables(docs.sparkSession)).where("taken")
    return turns.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "copy", "size", "finish").orderBy("finish", source_col, id_col, "copy")
