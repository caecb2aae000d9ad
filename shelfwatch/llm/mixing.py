"""Mixing sources to target weights along a curriculum.

Every source has a weight schedule over training time. Its integral up to a time is the source's cumulative token demand at
that time, so a document that follows `c` words of its source stands at the time whose demand is `c`. Documents are sorted by
that position over ranges, which interleaves the sources as their schedules ask.

Defined cases: a null source is a source of its own, last in order; null or blank texts have size 0 and take nothing; rows with
equal doc_id are rows of their own; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfwatch.llm.common import table, word_count
from shelfwatch.session import cut_lineage

#: Weights of the sources in order, repeating, and for each weight the schedule's knots (training time, relative weight).
WEIGHTS = (5.0, 2.0, 1.0)
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5)))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """One row per source: tier, weight, source_size and target.

    The targets add up to `share` of all sizes, in proportion to the weights, but none is above `cap` times its source. With
    the sources sorted by cap / weight, those below the water level are the first ones; the level follows from running sums.
    `sizes` has (source, source_size); the two windows are over one row per source.
    """
    by_name, by_ratio = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("ratio", "rank")
    ranked = sizes.withColumn("rank", F.row_number().over(by_name)).withColumn("tier", ((F.col("rank") - 1) % len(weights)).cast("int"))
    ranked = ranked.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.col("tier") + 1))
    ranked = ranked.withColumn("ceiling", F.col("source_size") * F.lit(cap)).withColumn("ratio", F.col("ceiling") / F.col("weight"))
    everything = Window.partitionBy()
    before = F.coalesce(F.sum("ceiling").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight_left = F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    total = F.sum("source_size").over(everything) * F.lit(share)
    level = ranked.withColumn("level", (total - before) / weight_left)
    free = F.when(F.col("level") < F.col("ratio"), F.struct("ratio", "rank", "level"))
    level = level.withColumn("water", F.min(free).over(everything)["level"])
    target = F.when(F.col("water").isNull(), F.col("ceiling")).otherwise(F.least(F.col("ceiling"), F.col("water") * F.col("weight")))
    return level.select("source", "tier", "weight", "source_size", target.alias("target"))


def invert_schedule(share: Column, knots) -> Column:
    """The time at which the integral of a piecewise linear weight schedule reaches `share` of its whole."""
    pieces, done = [], 0.0
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        area = (w0 + w1) / 2 * (t1 - t0)
        pieces.append((t0, t1 - t0, w0, w1, done, area))
        done += area
    time = F.lit(float(knots[-1][0]))
    for t0, span, w0, w1, start, area in reversed(pieces):
        part = (share * F.lit(done) - F.lit(start)) / F.lit(span)
        if w0 == w1:
            inside = F.lit(t0) + F.lit(span) * part / F.lit(w0) if w0 else F.lit(t0)
        else:
            root = F.sqrt(F.greatest(F.lit(w0 * w0) + F.lit(2 * (w1 - w0)) * part, F.lit(0.0)))
            inside = F.lit(t0) + F.lit(span) * (root - F.lit(w0)) / F.lit(w1 - w0)
        time = F.when(share * F.lit(done) <= F.lit(start + area), inside).otherwise(time)
    return time


def plan_mix(docs: DataFrame, weights=WEIGHTS, schedules=SCHEDULES, share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """`docs` with size, source_size, target, start (words of its source before it), passes (how often it is trained on), taken and positions.

    A source is passed over in the fixed order of the md5 of doc_id, whole passes first; in the last one it stops at the
    document whose middle passes the target, so that the words taken miss it by half a document at most. A running sum over a
    hot source would be one task; sums per (source, first four md5 digits) are combined first and documents are numbered
    inside such a cell.
    """
    keyed = docs.withColumns({
        "size": word_count(F.col("text")),
        "order_key": F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")),
    }).withColumn("cell", F.substring("order_key", 1, 4))
    cells = keyed.groupBy("source", "cell").agg(F.sum("size").alias("cell_size"))
    targets = source_targets(cells.groupBy("source").agg(F.sum("cell_size").alias("source_size")), weights, share, cap)
    earlier = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.withColumn("cell_start", F.coalesce(F.sum("cell_size").over(earlier), F.lit(0)).cast("long")).drop("cell_size")
    same = F.col("c.source").eqNullSafe(F.col("t.source"))
    offsets = cells.alias("c").join(targets.alias("t"), same).select("c.source", "c.cell", "cell_start", "tier", "source_size", "target")
    # one key without null serves the join and the window, so the documents are dealt once
    key = F.concat_ws(":", "cell", "source")
    offsets = offsets.select(F.concat(key, F.col("source").isNull().cast("string")).alias("mix_key"), "cell_start", "tier", "source_size", "target")
    joined = keyed.withColumn("mix_key", F.concat(key, F.col("source").isNull().cast("string"))).join(offsets, "mix_key")
    inside = Window.partitionBy("mix_key").orderBy("order_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = (F.col("cell_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))).cast("long")
    full = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    planned = joined.withColumns({"start": start, "full": full.cast("int")})
    planned = planned.withColumn("rest", F.col("target") - F.col("full") * F.col("source_size"))
    last = (F.col("size") > 0) & (F.col("start") + F.col("size") / F.lit(2.0) <= F.col("rest"))
    passes = F.when(F.col("size") > 0, F.col("full") + last.cast("int")).otherwise(0)
    planned = planned.withColumn("passes", passes.cast("int")).withColumn("taken", F.col("passes") * F.col("size"))
    repeats = F.when(F.col("passes") > 0, F.sequence(F.lit(0), F.col("passes") - 1)).otherwise(F.array().cast("array<int>"))

    def position(number):
        reached = F.least((number * F.col("source_size") + F.col("start")) / F.col("target"), F.lit(1.0))
        chosen = invert_schedule(reached, schedules[-1])
        for tier in range(len(schedules) - 1):
            chosen = F.when(F.col("tier") == tier, invert_schedule(reached, schedules[tier])).otherwise(chosen)
        return chosen

    planned = planned.withColumn("positions", F.transform(repeats, position))
    return planned.drop("mix_key", "cell", "cell_start", "tier", "full", "rest")


def training_order(planned: DataFrame, columns: list[str]) -> DataFrame:
    """One row per training on a document, range-sorted by position; `columns` are kept.

    Equal positions are told apart by the order key, so no range grows with a tie.
    """
    rows = planned.select(*columns, "order_key", F.explode("positions").alias("position"))
    return rows.sort("position", "order_key")


def trained(planned: DataFrame) -> DataFrame:
    """(doc_id, size, source_size, target, taken, passes, first_position) of every document, read off the training order.

    The order is written as it is sorted, and its rows are counted back per document; a document that takes words is the only one of its
    source that starts where it does. Documents that the order does not hold take nothing.
    """
    facts = ["doc_id", "source", "size", "source_size", "target", "start"]
    planned = cut_lineage(planned.select(*facts, "order_key", "passes", "positions"))
    order = cut_lineage(training_order(planned, facts))
    counted = order.groupBy("source", "start").agg(
        F.first(F.struct("doc_id", "size", "source_size", "target")).alias("d"), F.sum("size").alias("taken"), F.count("*").cast("int").alias("passes"),
        F.min("position").alias("first_position"),
    ).select("d.*", "taken", "passes", "first_position")
    idle = planned.where("passes = 0").select("doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), "passes",
                                              F.lit(None).cast("double").alias("first_position"))
    return counted.unionByName(idle)


def op4_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return trained(plan_mix(table(spark, folder, "documents").select("doc_id", "source", "text")))


OP4_SQL = r"""
with d as (
  select doc_id, source, md5(coalesce(cast(doc_id as varchar), '')) as k,
         cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
r as (select *, row_number() over (order by source nulls last) as rank from s),
w as (select *, case (rank - 1) % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end as weight,
      source_size * 2.0::double as ceiling from r),
l as (select *, ceiling / weight as ratio,
      ((sum(source_size) over ())::double * 1.5::double - coalesce(sum(ceiling) over (order by ceiling / weight, rank rows between unbounded preceding and 1 preceding), 0))
      / sum(weight) over (order by ceiling / weight, rank rows between current row and unbounded following) as level from w),
f as (select *, (select level from l where level < ratio order by ratio, rank limit 1) as water from l),
t as (select source, rank, source_size, case when water is null then ceiling else least(ceiling, water * weight) end as target from f),
p as (select d.doc_id, d.size, t.source_size, t.target, t.rank,
      coalesce(sum(d.size) over (partition by t.rank order by d.k, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as start,
      case when t.source_size > 0 then floor(t.target / t.source_size) else 0 end as full_passes
      from d join t on d.source is not distinct from t.source),
q as (select *, case when size > 0 then cast(full_passes + case when start + size / 2.0::double <= target - full_passes * source_size then 1 else 0 end as integer) else 0 end as passes from p),
u as (select *, case when passes > 0 then least(start::double / target, 1.0::double) end as reached from q)
select doc_id, size, source_size, target, cast(passes * size as bigint) as taken, passes,
  case when passes > 0 then case (rank - 1) % 3
    when 0 then 0.0::double + 1.0::double * (sqrt(greatest(2.25::double + -2.0::double * ((reached * 1.0::double - 0.0::double) / 1.0::double), 0.0::double)) - 1.5::double) / -1.0::double
    when 1 then 0.0::double + 1.0::double * ((reached * 1.0::double - 0.0::double) / 1.0::double) / 1.0::double
    else case when reached * 1.0::double <= 0.375::double
      then 0.0::double + 0.5::double * (sqrt(greatest(0.25::double + 1.0::double * ((reached * 1.0::double - 0.0::double) / 0.5::double), 0.0::double)) - 0.5::double) / 0.5::double
      else 0.5::double + 0.5::double * (sqrt(greatest(1.0::double + 1.0::double * ((reached * 1.0::double - 0.375::double) / 0.5::double), 0.0::double)) - 1.0::double) / 0.5::double end
  end end as first_position
from u
"""
