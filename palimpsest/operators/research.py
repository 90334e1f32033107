"""Research records: manifests, splits, fixtures, hash-scored experiments, calibration, budget sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import scalars as S

# Branches, bias by source and branch, factor by profile, and the distractor's note of the deterministic experiment.
BRANCHES = ("stability", "distress", "refi")
SOURCE_BIAS = {
    "edgar": {"stability": 0.36, "distress": 0.34, "refi": 0.30},
    "fannie": {"stability": 0.42, "distress": 0.23, "refi": 0.35},
    "ginnie": {"stability": 0.28, "distress": 0.30, "refi": 0.42},
}
DEFAULT_BIAS = 0.33
PROFILE_FACTOR = {"baseline": 1.0, "reduced_context": 0.96, "distractor": 0.90}
DISTRACTOR_NOTE = "synthetic distractor context placeholder"
PROFILES = tuple(PROFILE_FACTOR)
SPLITS = ("train", "eval", "holdout", "unspecified")


def manifest(files: DataFrame) -> DataFrame:
    """files (source, bytes, date, end_date) to counts, bytes and the date range of each source."""
    return files.groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("total_bytes"), F.min("date").alias("first_date"), F.max("end_date").alias("last_date"))


def manifest_totals(manifests: DataFrame) -> DataFrame:
    """Files, bytes and the overall date range of all sources; nulls where nothing has a date."""
    return manifests.agg(F.coalesce(F.sum("files"), F.lit(0)).alias("files"), F.coalesce(F.sum("total_bytes"), F.lit(0)).alias("total_bytes"), F.min("first_date").alias("first_date"), F.max("last_date").alias("last_date"))


def periods_by_source(files: DataFrame) -> DataFrame:
    """files (source, period) to the sorted distinct periods of each source and their first and last (a catalogue of years or months)."""
    known = files.where(F.col("period").isNotNull()).groupBy("source").agg(F.array_sort(F.collect_set("period")).alias("periods"))
    return known.select("source", "periods", F.array_min("periods").alias("first_period"), F.array_max("periods").alias("last_period"))


def scaffold(sources: list[DataFrame]) -> DataFrame:
    """Sources one after the other, in the order given: ``source_rank`` tells them apart, their own order is kept by their columns."""
    ranked = [df.withColumn("source_rank", F.lit(i)) for i, df in enumerate(sources)]
    out = ranked[0]
    for df in ranked[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def period_range(period: Column) -> tuple[Column, Column]:
    """First and last day of a period: a month YYYYMM or a year."""
    month = F.try_to_date(period, "yyyyMM") if hasattr(F, "try_to_date") else F.to_date(period, "yyyyMM")
    year = F.length(period) == 4
    return F.when(year, F.concat(period, F.lit("-01-01"))).otherwise(F.date_format(month, "yyyy-MM-dd")), F.when(year, F.concat(period, F.lit("-12-31"))).otherwise(F.date_format(F.last_day(month), "yyyy-MM-dd"))


def with_split(records: DataFrame, train_until: str, eval_until: str) -> DataFrame:
    return records.withColumn("split", S.assign_split(F.col("event_date"), train_until, eval_until))


def split_matrix(split: DataFrame) -> DataFrame:
    """Counts by split and source, and zero where a split has none of a source."""
    spark = split.sparkSession
    rows = split.withColumn("source", F.coalesce("source", F.lit("unknown")))
    names = spark.createDataFrame([(s,) for s in SPLITS], "split string").join(rows.select("source").distinct(), how="cross")  # four rows by the catalogue of sources
    return names.join(rows.groupBy("split", "source").agg(F.count(F.lit(1)).alias("records")), ["split", "source"], "left").na.fill(0, ["records"])


def membership(records: DataFrame) -> DataFrame:
    return records.groupBy("record_id").agg(F.max_by("split", "seq").alias("split"))


def with_membership(records: DataFrame, members: DataFrame) -> DataFrame:
    """records with the split that membership gives; those it lacks are unspecified.  Records without an id are left out."""
    known = members.select("record_id", F.when(F.col("split").isin(*SPLITS), F.col("split")).alias("_split"))
    rows = records.drop("split").where(F.col("record_id").isNotNull()).join(known, "record_id", "left")
    return rows.withColumn("split", F.coalesce("_split", F.lit("unspecified"))).drop("_split")


def _split_rank() -> Column:
    return F.array_position(F.array(*map(F.lit, SPLITS)), F.col("split"))


def fixture_sample(split: DataFrame, per_split: int) -> DataFrame:
    """The first records of each split in file order; the sampling is the operator's feature."""
    if per_split < 0:
        raise ValueError("per_split must not be negative")
    return split.withColumn("_k", F.row_number().over(W.partitionBy("split").orderBy("seq"))).where(F.col("_k") <= per_split).drop("_k")


def expand_profiles(records: DataFrame) -> DataFrame:
    """Each record once per profile; the distractor profile carries its tag and note."""
    rows = records.withColumn("profile", F.explode(F.array(*map(F.lit, PROFILES))))
    tagged = F.col("profile") == "distractor"
    return rows.withColumn("distractor", F.when(tagged, F.lit(True))).withColumn("distractor_note", F.when(tagged, F.lit(DISTRACTOR_NOTE)))


def source_bias(source: Column, branch: str) -> Column:
    by_source = F.create_map(*[F.lit(x) for name, biases in SOURCE_BIAS.items() if branch in biases for x in (name, biases[branch])]) if any(branch in x for x in SOURCE_BIAS.values()) else None
    return F.lit(DEFAULT_BIAS) if by_source is None else F.coalesce(F.try_element_at(by_source, source), F.lit(DEFAULT_BIAS))


def profile_factor(profile: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in PROFILE_FACTOR.items() for x in pair])
    return F.coalesce(F.try_element_at(table, profile), F.lit(1.0))


def score(records: DataFrame, branches: tuple[str, ...] = BRANCHES) -> DataFrame:
    """Adds truth, scores (by branch), top branch (of equals the first), confidence, Brier score."""
    if not branches:
        raise ValueError("branches must not be empty")
    ident, profile, n = F.col("record_id"), F.col("profile"), len(branches)
    fraction = lambda *parts: S.hash_fraction(F.concat_ws("::", ident, *map(F.lit, parts)))
    noise = lambda b: F.when(profile == "distractor", F.lit(0.02) * fraction("noise", b)).otherwise(0.0)
    raw = {b: (F.lit(0.65) * fraction(b) + F.lit(0.35) * source_bias(F.col("source"), b)) * profile_factor(profile) + noise(b) for b in branches}
    rows = records.withColumns({f"_r{i}": raw[b] for i, b in enumerate(branches)})
    total = F.col("_r0")
    for i in range(1, n):
        total = total + F.col(f"_r{i}")
    share = lambda i: F.when(total <= 0, F.lit(1.0 / n)).otherwise(F.col(f"_r{i}") / total)
    rows = rows.withColumns({f"score_{b}": F.round(share(i), 9) for i, b in enumerate(branches)}).drop(*[f"_r{i}" for i in range(n)])
    place = F.least((fraction("truth") * n).cast("int"), F.lit(n - 1))
    best = F.array_max(F.array(*[F.struct(F.col(f"score_{b}").alias("s"), F.lit(-i).alias("i"), F.lit(b).alias("b")) for i, b in enumerate(branches)]))
    rows = rows.withColumn("truth", F.element_at(F.array(*map(F.lit, branches)), place + 1)).withColumn("_best", best)
    rows = rows.withColumn("top", F.col("_best.b")).withColumn("confidence", F.col("_best.s")).drop("_best")
    miss = lambda b: F.col(f"score_{b}") - (F.col("truth") == b).cast("double")
    brier = miss(branches[0]) * miss(branches[0])
    for b in branches[1:]:
        brier = brier + miss(b) * miss(b)
    return rows.withColumn("brier", brier)


def metrics(scored: DataFrame, *by: str, branches: tuple[str, ...] = BRANCHES) -> DataFrame:
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("top") == F.col("truth")).cast("double")), 9).alias("accuracy"), F.round(F.avg("confidence"), 7).alias("mean_confidence"), F.round(F.avg("brier"), 7).alias("mean_brier"),
        *[F.sum((F.col("top") == b).cast("long")).alias(f"n_{b}") for b in branches],
    )


def profile_metrics(scored: DataFrame, branches: tuple[str, ...] = BRANCHES) -> DataFrame:
    """Metrics of every profile; zeros for one without records."""
    names = scored.sparkSession.createDataFrame([(p,) for p in PROFILES], "profile string")
    got = names.join(metrics(scored, "profile", branches=branches), "profile", "left")
    return got.na.fill(0, ["n", *[f"n_{b}" for b in branches]]).na.fill(0.0, ["accuracy", "mean_confidence", "mean_brier"])


def samples(scored: DataFrame, first: int = 10, kept: int = 3) -> DataFrame:
    """Of the first records of each profile (by split, then in file order) the leading ones."""
    rank = F.row_number().over(W.partitionBy("profile").orderBy(_split_rank(), "seq"))
    return scored.withColumn("sample", rank.cast("long")).where(F.col("sample") <= min(first, kept))


def agreement(scored: DataFrame, a: str, b: str) -> DataFrame:
    """The share of common records for which two profiles have the same top branch; 0 without any."""
    side = lambda p, c: scored.where(F.col("profile") == p).select("record_id", F.col("top").alias(c))
    return side(a, "x").join(side(b, "y"), "record_id").agg(F.round(F.coalesce(F.avg((F.col("x") == F.col("y")).cast("double")), F.lit(0.0)), 9).alias("agreement"), F.count(F.lit(1)).alias("n"))


def calibration(samples: DataFrame, bins: int = 10) -> DataFrame:
    """Bins of confidence with counts, accuracy and mean confidence; empty bins have null figures."""
    if bins < 1:
        raise ValueError("bins must be 1 or more")
    clamped = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("confidence")))
    rows = samples.withColumn("bin", F.least((clamped * bins).cast("int"), F.lit(bins - 1)))
    got = rows.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col("top") == F.col("truth")).cast("double")), 9).alias("accuracy"), F.round(F.avg("confidence"), 7).alias("mean_confidence"))
    return samples.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin")).join(got, "bin", "left").na.fill(0, ["n"])


def budget_sweep(split: DataFrame, budgets: list[int], branches: tuple[str, ...] = BRANCHES) -> DataFrame:
    """Metrics and agreement with the baseline by budget and profile, when each split gives its first ``budget`` records.

    Records are ranked and cut before profiles are expanded and scored, so only
    the largest budget's records are scored, once.
    """
    rank = F.row_number().over(W.partitionBy("split").orderBy("seq"))
    taken = split.withColumn("_k", rank).where(F.col("_k") <= max(budgets))
    rows = score(expand_profiles(taken), branches).withColumn("budget", F.explode(F.filter(F.array(*map(F.lit, budgets)), lambda b: b >= F.col("_k"))))
    base = F.max(F.when(F.col("profile") == "baseline", F.col("top"))).over(W.partitionBy("budget", "record_id"))
    rows = rows.withColumn("_same", (F.col("top") == base).cast("double"))
    agreed = rows.groupBy("budget", "profile").agg(F.round(F.avg("_same"), 9).alias("agreement"))
    return metrics(rows, "budget", "profile", branches=branches).join(agreed, ["budget", "profile"])


def research_pipeline(records: DataFrame, *, train_until: str, eval_until: str, per_split: int = 250, budgets: tuple[int, ...] = (100, 250, 500), branches: tuple[str, ...] = BRANCHES, bins: int = 10) -> dict[str, DataFrame]:
    """The whole chain over a scaffold (seq, record_id, source, event_date): splits, membership, fixtures, profiles, agreement, samples, calibration of the samples, sweep."""
    split = with_split(records, train_until, eval_until)
    members = membership(split)
    fixtures = expand_profiles(fixture_sample(with_membership(split, members), per_split))
    scored = score(fixtures, branches)
    picked = samples(scored)
    return {
        "split_matrix": split_matrix(split), "membership": members, "fixtures": fixtures, "profiles": profile_metrics(scored, branches), "agreement_reduced": agreement(scored, "baseline", "reduced_context"),
        "agreement_distractor": agreement(scored, "baseline", "distractor"), "samples": picked, "calibration": calibration(picked, bins), "sweep": budget_sweep(with_membership(split, members), list(budgets), branches),
    }
