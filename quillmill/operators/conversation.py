"""Conversation analytics: message filters, threads, sessions by gap and size, participants, texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def valid_message() -> Column:
    """Not blank and no system message; headers, purposes and joins are always taken."""
    kind = F.coalesce("type", F.lit(""))
    return ((F.trim(F.coalesce("message", F.lit(""))) != "") & ~F.startswith(kind, F.lit("system_"))) | kind.isin("channel_header", "channel_purpose", "add_to_channel")


def is_reply() -> Column:
    return (F.coalesce("root_id", F.lit("")) != "") & (F.col("root_id") != F.col("id"))


def threads(messages: DataFrame) -> DataFrame:
    """thread_id, n_messages, n_participants, created_at, last_activity. A thread whose root is missing is dropped; a
    message without replies is a thread of its own."""
    root = F.when(is_reply(), F.col("root_id")).otherwise(F.col("id"))
    grouped = messages.withColumn("thread_id", root).groupBy("thread_id").agg(
        F.count("*").alias("n_messages"), F.countDistinct("user_id").alias("n_participants"), F.max(F.when(F.col("id") == F.col("thread_id"), F.col("ts"))).alias("created_at"), F.max("ts").alias("last_activity")
    )
    return grouped.where("created_at is not null")


def sessions(messages: DataFrame, channel: str = "channel", gap_minutes: int = 30, most: int = 25) -> DataFrame:
    """messages (id, ts and a channel) with session and part: a new session where more than the gap has passed, cut into
    parts of `most` messages.

    A channel may hold most messages, so gaps are found in days of a channel; what a day needs of the days before it
    (their last message, how many sessions they began) comes from a table with one row per channel and day."""
    gap = gap_minutes * 60_000_000
    day_w = Window.partitionBy(channel, "day").orderBy("micros", "id")
    timed = messages.withColumn("micros", F.unix_micros("ts")).withColumn("day", F.to_date("ts"))
    flagged = timed.withColumn("_begins", (F.col("micros") - F.lag("micros").over(day_w) > gap).cast("int"))
    days = flagged.groupBy(channel, "day").agg(F.min("micros").alias("_first"), F.max("micros").alias("_last"), F.coalesce(F.sum("_begins"), F.lit(0)).alias("_inside"))
    before = Window.partitionBy(channel).orderBy("day")
    opens = F.coalesce((F.col("_first") - F.lag("_last").over(before) > gap).cast("int"), F.lit(1))
    days = days.withColumn("_opens", opens).withColumn("_offset", F.sum(F.col("_opens") + F.col("_inside")).over(before) - F.col("_inside"))
    numbered = flagged.join(days.select(channel, "day", "_offset"), [channel, "day"]).withColumn("session", (F.col("_offset") + F.sum(F.coalesce("_begins", F.lit(0))).over(day_w)).cast("long"))
    at = F.row_number().over(Window.partitionBy(channel, "session").orderBy("micros", "id"))
    return numbered.withColumn("part", F.floor((at - 1) / most).cast("long")).drop("micros", "day", "_begins", "_offset")


def session_stats(grouped: DataFrame, channel: str = "channel") -> DataFrame:
    hours = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 3_600_000_000
    return grouped.groupBy(channel, "session", "part").agg(F.count("*").alias("n_messages"), F.countDistinct("user_id").alias("n_participants"), F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), F.round(hours, 6).alias("hours"))


def activity(messages: DataFrame, channel: str = "channel") -> DataFrame:
    span = (F.unix_micros(F.max("ts")) - F.unix_micros(F.min("ts"))) / 86_400_000_000
    found = messages.groupBy(channel).agg(F.count("*").alias("n_messages"), F.countDistinct("user_id").alias("n_participants"), span.alias("span_days"))
    return found.withColumn("per_day", F.round(F.col("n_messages") / F.greatest("span_days", F.lit(1.0)), 6)).withColumn("span_days", F.round("span_days", 6))


def top_participants(messages: DataFrame, channel: str = "channel", k: int = 10) -> DataFrame:
    counted = messages.groupBy(channel, "user_id").agg(F.count("*").alias("n_messages"), F.sum(F.length(F.coalesce("message", F.lit("")))).alias("n_chars"))
    w = Window.partitionBy(channel).orderBy(F.desc("n_messages"), "user_id")
    return counted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hashtags(messages: DataFrame, k: int = 20) -> DataFrame:
    each = messages.select(F.explode(F.filter(F.split(F.coalesce("hashtags", F.lit("")), " "), lambda x: x != "")).alias("hashtag"))
    return each.groupBy("hashtag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "hashtag").limit(k)


def session_texts(grouped: DataFrame, names: DataFrame, channel: str = "channel") -> DataFrame:
    """One text per part of a session, of at most 25 messages: a header, then a line per message with the sender's name
    (else id) and time."""
    named = grouped.join(names.select("user_id", "display_name"), "user_id", "left")
    who = F.coalesce("display_name", F.col("user_id").cast("string"))
    line = F.concat(F.lit("**"), who, F.lit("** ("), F.date_format("ts", "HH:mm"), F.lit("): "), F.coalesce("message", F.lit("")))
    gathered = named.groupBy(channel, "session", "part").agg(F.array_sort(F.collect_list(F.struct("ts", "id", line.alias("line")))).alias("rows"), F.countDistinct("user_id").alias("n"))
    head = F.concat(F.lit("## Conversation in #"), F.col(channel), F.lit("\n**Participants:** "), F.col("n").cast("string"), F.lit(" users\n\n"))
    return gathered.select(channel, "session", "part", F.concat(head, F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("text"))


def display_names(users: DataFrame) -> DataFrame:
    """nickname, else first and last name, else username."""
    blank = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    full = blank(F.concat_ws(" ", blank(F.col("first_name")), blank(F.col("last_name"))))
    return users.select("user_id", F.coalesce(blank(F.col("nickname")), full, F.col("username")).alias("display_name"))


def context_window(turns: DataFrame, back: int = 10) -> DataFrame:
    """conv_id, turn, the `back` turns before it as one text."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-back, -1)
    said = F.concat(F.col("role"), F.lit(": "), F.coalesce("text", F.lit("")))
    return turns.select("conv_id", "turn", F.array_join(F.collect_list(said).over(w), "\n").alias("context"))
