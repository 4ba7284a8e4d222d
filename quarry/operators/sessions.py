"""Statistics, noise rules, neighbourhoods and scores of sessions.

Sessions are rows (project, session, ts_ms) with whatever else a rule names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY_MS = 86_400_000


def hour_histogram(sessions: DataFrame) -> DataFrame:
    """Sessions by UTC hour; hours without sessions count 0."""
    hours = sessions.sparkSession.range(24).select(F.col("id").alias("hour"))
    per = sessions.groupBy(F.hour(F.timestamp_millis("ts_ms")).cast("long").alias("hour")).agg(F.count("*").alias("n"))
    return hours.join(F.broadcast(per), "hour", "left").select("hour", F.coalesce("n", F.lit(0)).alias("n"))


def upper_median(values: Column) -> Column:
    """Element floor(n / 2), from 0, of the sorted values: a value that occurs."""
    held = F.sort_array(F.collect_list(values))
    return F.try_element_at(held, (F.floor(F.array_size(held) / 2) + 1).cast("int"))


def upper_median_by(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The upper median of each group without gathering a group: values are counted first."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    ordered = Window.partitionBy(key).orderBy(value)
    counts = counts.withColumns({"upto": F.sum("n").over(ordered), "all": F.sum("n").over(Window.partitionBy(key))})
    return counts.where(F.col("upto") > F.floor(F.col("all") / 2)).groupBy(key).agg(F.min(value).alias("median"))


def gaps(sessions: DataFrame) -> DataFrame:
    before = F.lag("ts_ms").over(Window.partitionBy("project").orderBy("ts_ms", "session"))
    return sessions.withColumn("gap_ms", F.col("ts_ms") - before)


def noise_signals(sessions: DataFrame) -> DataFrame:
    """Per project: sessions, normalised variance of the hours, share of distinct titles, upper
    median of positive gaps, and share of all sessions in percent."""
    hours = [F.count_if(F.pmod(F.floor(F.col("ts_ms") / 3_600_000), F.lit(24)) == h) for h in range(24)]
    per = sessions.groupBy("project").agg(F.count("*").alias("sessions"), F.count_distinct("title").alias("titles"), F.array(*hours).alias("hours"))
    # Variance over squared mean of 24 counts, in whole numbers up to one division.
    squares = F.aggregate("hours", F.lit(0).cast("long"), lambda a, x: a + x * x)
    all_squared = F.col("sessions") * F.col("sessions")
    positive = upper_median_by(gaps(sessions).where("gap_ms > 0"), "project", "gap_ms")
    total = F.lit(max(sessions.count(), 1))
    per = per.join(positive, "project", "left")
    return per.select("project", "sessions", ((24 * squares - all_squared) / all_squared).alias("hour_variance"), (F.col("titles") / F.col("sessions")).alias("title_ratio"), F.coalesce("median", F.lit(0)).alias("median_ms"), (F.col("sessions") * 100.0 / total).alias("share"))


def noise_rules(signals: DataFrame, least_sessions: int = 100, variance: float = 0.5, titles: float = 0.3, median_ms: int = 60_000, share: float = 70.0, user_ratio: float = 0.2, needed: int = 2) -> DataFrame:
    """Which rules a project breaks; noise from ``needed`` on."""
    rules = {
        "flat_hours": (F.col("hour_variance") < variance) & (F.col("sessions") > least_sessions),
        "same_titles": F.col("title_ratio") < titles,
        "short_gaps": (F.col("median_ms") > 0) & (F.col("median_ms") < median_ms),
        "most_sessions": F.col("share") > share,
        "few_user_messages": F.col("user_ratio") < user_ratio,
    }
    marked = signals.withColumns({k: v.cast("int") for k, v in rules.items()})
    broken = sum((F.col(k) for k in rules), F.lit(0))
    return marked.withColumn("broken", broken).withColumn("is_noise", (broken >= needed).cast("int"))


def neighbours(sessions: DataFrame, span_ms: int = DAY_MS) -> DataFrame:
    """How many other sessions of the project start less than ``span_ms`` away."""
    near = Window.partitionBy("project").orderBy("ts_ms").rangeBetween(-(span_ms - 1), span_ms - 1)
    return sessions.withColumn("near", F.count("*").over(near) - 1)


def neighbours_by_join(sessions: DataFrame, span_ms: int = DAY_MS) -> DataFrame:
    """The same by an equi-join on time cells: a session meets only its cell and the two beside it."""
    cell = F.floor(F.col("ts_ms") / span_ms)
    left = sessions.select("project", "session", "ts_ms", F.explode(F.array(cell - 1, cell, cell + 1)).alias("cell"))
    right = sessions.select(F.col("project"), F.col("session").alias("other"), F.col("ts_ms").alias("other_ms"), cell.alias("cell"))
    met = left.join(right, ["project", "cell"]).where((F.col("session") != F.col("other")) & (F.abs(F.col("ts_ms") - F.col("other_ms")) < span_ms))
    return sessions.join(met.groupBy("project", "session").agg(F.count("*").alias("near")), ["project", "session"], "left").withColumn("near", F.coalesce("near", F.lit(0)))


def score(keyword: Column, churn: Column, near: Column, messages: Column, churn_above: int = 500, messages_above: int = 15) -> Column:
    """Points of a session; a null counts as none."""
    points = ((keyword, 3), (churn > churn_above, 2), (near >= 1, 2), (messages > messages_above, 1))
    return sum((F.when(F.coalesce(test, F.lit(False)), n).otherwise(0) for test, n in points), F.lit(0))


def overridden(is_noise: Column, included: Column, excluded: Column) -> Column:
    """What lists say beats the rules, and to be included beats to be excluded."""
    return F.when(included, 0).when(excluded, 1).otherwise(is_noise)


def report(projects: DataFrame) -> DataFrame:
    """(part, source, projects, sessions) of (project, source, sessions, is_noise), with totals."""
    per = projects.groupingSets([["is_noise", "source"], ["is_noise"], []], "is_noise", "source").agg(F.count("*").alias("projects"), F.sum("sessions").alias("sessions"), F.grouping("is_noise").alias("all"))
    part = F.when(F.col("all") == 1, "total").when(F.col("is_noise") == 1, "filtered").otherwise("retained")
    return per.select(part.alias("part"), F.coalesce("source", F.lit("total")).alias("source"), "projects", "sessions")


def source_signals(sessions: DataFrame) -> DataFrame:
    """By (project, source): 24 counts by hour, share of distinct titles, percent of the source's sessions."""
    hours = [F.count_if(F.pmod(F.floor(F.col("ts_ms") / 3_600_000), F.lit(24)) == h) for h in range(24)]
    per = sessions.groupBy("project", "source").agg(F.count("*").alias("n"), F.count_distinct("title").alias("titles"), F.array(*hours).alias("hours"))
    all_ = per.groupBy("source").agg(F.sum("n").alias("all"))
    return per.join(F.broadcast(all_), "source").select("project", "source", "hours", (F.col("titles") / F.col("n")).alias("ratio"), (F.col("n") * 100.0 / F.col("all")).alias("share"))


def merged_sources(signals: DataFrame) -> DataFrame:
    """By project: hours added up element by element, the least ratio and the greatest share."""
    return signals.groupBy("project").agg(F.array(*[F.sum(F.col("hours")[h]) for h in range(24)]).alias("hours"), F.min("ratio").alias("ratio"), F.max("share").alias("share"))


def is_subagent(title: Column) -> Column:
    """Whether a title marks a delegated session; null doesn't."""
    return F.coalesce(title.rlike(r"\(@[A-Za-z0-9_]+") | title.rlike(r"(?i:subagent\))"), F.lit(False))
