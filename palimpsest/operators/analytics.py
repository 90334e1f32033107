"""Analytics over versioned edges: learned decay, strength over time, weakening, anomalies, importance of entities."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars as S
from .stored import checkpointed

DAY_MICROS = 86_400_000_000
#: Two-sided 95 %, and the one-sided 95 % of a type without an end.
Z, NONE_ENDED = 1.96, -math.log(0.05)
#: Days over which strength is summed, and the share of its peak under which it counts as weakening.
STRENGTH_DAYS, WEAK = 28, 0.5
#: Deviations (of the median deviation, scaled to a standard deviation) from which a day is an anomaly.
ANOMALY, TO_DEVIATION = 3.0, 1.4826
#: Entities whose values (a number and a double each) are broadcast in a round of importance.
BROADCAST_NODES = 1_000_000


def learn_decay(edges: DataFrame, until: Column) -> DataFrame:
    """Per type the daily rate at which edges end: ended, open, exposure_days, rate, low, high.

    Lifetimes are exponential; those that haven't ended by ``until`` are censored.  The
    maximum likelihood is ended over exposure, so one aggregate that combines
    before the shuffle does.  low and high are the 95 % interval on the log scale;
    a type without an end has rate and low 0.  Edges that start later are left out;
    a type without exposure has null rates.
    """
    ended = F.coalesce(F.col("valid_to") <= until, F.lit(False))
    lived = F.timestamp_diff("MICROSECOND", F.col("valid_from"), F.when(ended, F.col("valid_to")).otherwise(until))
    rows = edges.where(F.col("valid_from") <= until).groupBy("rel_type").agg(F.sum(ended.cast("long")).alias("ended"), F.sum((~ended).cast("long")).alias("open"), F.sum(F.greatest(lived, F.lit(0)).cast("decimal(38,0)")).alias("_x"))
    days = rows.withColumn("_days", F.nullif(F.col("_x").cast("double") / DAY_MICROS, F.lit(0.0)))
    rate, wide = F.col("ended") / F.col("_days"), F.exp(F.lit(Z) / F.sqrt(F.col("ended").cast("double")))
    some = F.col("ended") > 0
    return days.select(
        "rel_type", "ended", "open", F.round(F.coalesce("_days", F.lit(0.0)), 6).alias("exposure_days"), F.round(rate, 9).alias("rate"),
        F.round(F.when(some, rate / wide).otherwise(rate), 9).alias("low"), F.round(F.when(some, rate * wide).otherwise(F.lit(NONE_ENDED) / F.col("_days")), 9).alias("high"),
    )


SERIES = ["tenant_id", "source_id", "rel_type"]


def daily_mass(edges: DataFrame) -> DataFrame:
    """Per source and type and day (number since 1970) on which edges began: their summed confidence."""
    day = F.unix_date(F.to_date("valid_from")).cast("long")
    return edges.where(F.col("valid_from").isNotNull()).groupBy(*SERIES, day.alias("day")).agg(F.round(F.sum("confidence"), 6).alias("mass"))


def strength(edges: DataFrame, days: int = STRENGTH_DAYS) -> DataFrame:
    """daily_mass with strength (the last ``days`` days' mass, decayed by type to the day), its peak in as many days, and whether it weakens.

    Days are summed before the windows, so a frame holds at most ``days`` numbers
    however many edges an entity has.
    """
    by = W.partitionBy(*SERIES).orderBy("day").rangeBetween(-(days - 1), 0)
    rows = daily_mass(edges).withColumn("_in", F.collect_list(F.struct("day", "mass")).over(by))
    fade = lambda x: x["mass"] * F.exp(-S.decay_rate(F.col("rel_type")) * (F.col("day") - x["day"]).cast("double"))
    rows = rows.withColumn("strength", F.round(F.aggregate("_in", F.lit(0.0), lambda acc, x: acc + fade(x)), 6)).drop("_in")
    rows = rows.withColumn("peak", F.max("strength").over(by))
    return rows.withColumn("weakening", F.col("strength") < WEAK * F.col("peak"))


def anomalies(edges: DataFrame) -> DataFrame:
    """Days of a source and type whose mass is far from the median: mass, median, spread (median deviation), score.

    Medians are exact; a series has a row for each day, so a group is bounded by
    the days.  Series whose spread is 0 have no anomalies.
    """
    rows = daily_mass(edges)
    middle = rows.groupBy(*SERIES).agg(F.median("mass").alias("median"))
    off = rows.join(middle, SERIES).withColumn("off", F.abs(F.col("mass") - F.col("median")))
    spread = off.groupBy(*SERIES).agg(F.round(F.median("off"), 6).alias("spread")).where(F.col("spread") > 0)
    scored = off.join(spread, SERIES).withColumn("score", F.round(F.col("off") / (TO_DEVIATION * F.col("spread")), 6))
    return scored.where(F.col("score") >= ANOMALY).select(*SERIES, "day", "mass", F.round("median", 6).alias("median"), "spread", "score")


def importance(edges: DataFrame, now: Column, *, damping: float = 0.85, tolerance: float = 1e-9, rounds: int = 60, broadcast: int = BROADCAST_NODES) -> DataFrame:
    """id, importance of every entity that an active edge names: the weighted link measure whose values sum to 1.

    An edge weighs its confidence decayed to ``now``; edges of one pair add up.
    An entity without outgoing edges gives its share to all.  Entities are numbered
    and the links written once, by numbers.  Each round joins them with the values
    of the round before and adds up by target, so a hub's edges combine before the
    shuffle.  Values of up to ``broadcast`` entities are sent to the links, which
    then stay where they are; more take a shuffled join of numbers.  It ends when
    the values move by less than ``tolerance`` in all, or after ``rounds``.
    """
    weight = S.decayed_confidence(F.col("confidence"), F.col("rel_type"), F.col("valid_from"), now)
    live = edges.where(F.col("valid_to").isNull() & F.col("recorded_to").isNull())
    pairs = live.groupBy("source_id", "target_id").agg(F.sum(weight).alias("w")).where(F.col("w") > 0)
    pairs = checkpointed(pairs.where(F.col("source_id").isNotNull() & F.col("target_id").isNotNull()))
    ids = pairs.groupBy(F.col("source_id").alias("id")).agg(F.sum("w").alias("all")).unionByName(pairs.select(F.col("target_id").alias("id"), F.lit(None).cast("double").alias("all")).distinct())
    nodes = checkpointed(ids.groupBy("id").agg(F.max("all").alias("all")).withColumn("n", F.monotonically_increasing_id()))
    number = lambda end, c, *more: nodes.select(F.col("id").alias(end), F.col("n").alias(c), *more)
    links = pairs.join(number("source_id", "s", "all"), "source_id").join(number("target_id", "t"), "target_id")
    links = checkpointed(links.select("s", "t", (F.col("w") / F.col("all")).alias("share")))
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("importance"))
    value = nodes.select("n", F.col("all").isNotNull().alias("gives"), F.lit(1.0 / n).alias("value"))
    held = F.coalesce(F.sum(F.when(~F.col("gives"), F.col("value"))), F.lit(0.0))
    idle = value.agg(held).first()[0]
    for _ in range(rounds):
        sent = value.where("gives").select(F.col("n").alias("s"), "value")
        given = links.join(F.broadcast(sent) if n <= broadcast else sent, "s").groupBy(F.col("t").alias("n")).agg(F.sum(F.col("value") * F.col("share")).alias("got"))
        base = (1.0 - damping) / n + damping * idle / n
        step = value.join(given, "n", "left").select("n", "gives", F.col("value").alias("was"), (F.lit(base) + damping * F.coalesce("got", F.lit(0.0))).alias("value"))
        step = checkpointed(step)
        moved, idle = step.agg(F.sum(F.abs(F.col("value") - F.col("was"))), held).first()
        value = step.drop("was")
        if moved < tolerance:
            break
    return nodes.select("id", "n").join(value, "n").select("id", F.col("value").alias("importance"))
