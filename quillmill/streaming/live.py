"""Streaming forms of the incremental operators.

Late data: a watermark of the gap plus the lateness allowed; rows that come later are dropped here and are included when
the batch operators run over the stored table."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def counters(events: DataFrame, by: str, length: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Tumbling or sliding counts, each final once its window is past the watermark."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")


def gap_sessions(messages: DataFrame, by: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions by gap alone; a message exactly one gap later still joins."""
    w = F.session_window("ts", gap)
    return messages.withWatermark("ts", late).groupBy(w.alias("w"), by).agg(F.count("*").alias("n_messages")).select(F.col("w.start").alias("start_ts"), by, "n_messages")


def unseen(docs: DataFrame, late: str = "1 day") -> DataFrame:
    """Documents whose text did not come before within the watermark."""
    return docs.withColumn("content_hash", F.md5("text")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["content_hash"])


def sized_sessions(messages: DataFrame, by: str, gap_seconds: int = 1800, most: int = 25) -> DataFrame:
    """Sessions by gap and size: a row when a session closes by its size, by a message after the gap, or by time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        first, last, n = state.get if state.exists else (0, 0, 0)
        closed = []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame([(key[0], first, last, n)], columns=[by, "first_s", "last_s", "n_messages"])
            return
        times = sorted(t for b in batches for t in b["s"].tolist())
        for t in times:
            if n and (t - last > gap_seconds or n >= most):
                closed.append((key[0], first, last, n))
                n = 0
            first, last, n = (first if n else t), t, n + 1
        state.update((first, last, n))
        state.setTimeoutTimestamp(max((last + gap_seconds + 1) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(closed, columns=[by, "first_s", "last_s", "n_messages"])

    timed = messages.withWatermark("ts", f"{gap_seconds} seconds").select(by, "ts", F.unix_seconds("ts").alias("s"))
    return timed.groupBy(by).applyInPandasWithState(step, f"{by} string, first_s long, last_s long, n_messages long", "first_s long, last_s long, n long", "append", GroupStateTimeout.EventTimeTimeout)


def token_bucket(calls: DataFrame, by: str, burst: int = 10, seconds_per_token: float = 6.0) -> DataFrame:
    """Each call with whether its group had a token left; tokens come back one by one up to the burst."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, at = state.get if state.exists else (float(burst), None)
        out = []
        for call, t in sorted((r for b in batches for r in zip(b["id"].tolist(), b["s"].tolist(), strict=True)), key=lambda r: (r[1], r[0])):
            if at is not None:
                tokens = min(float(burst), tokens + max(0, t - at) / seconds_per_token)
            allowed = tokens >= 1
            tokens, at = tokens - allowed, t
            out.append((key[0], call, allowed))
        state.update((tokens, at))
        yield pd.DataFrame(out, columns=[by, "id", "allowed"])

    timed = calls.select(by, "id", F.unix_seconds("ts").alias("s"))
    return timed.groupBy(by).applyInPandasWithState(step, f"{by} string, id long, allowed boolean", "tokens double, at long", "append", GroupStateTimeout.NoTimeout)


def breaker(calls: DataFrame, by: str, failures: int = 5, window: int = 60, open_for: int = 30, successes: int = 2) -> DataFrame:
    """Circuit breaker states: closed, open after `failures` within the window, half-open after `open_for` seconds, and
    closed again after `successes`. A row for each call with the state that it met."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, since, good, recent = state.get if state.exists else ("closed", 0, 0, "")
        failed_at = [int(x) for x in recent.split(",") if x]
        out = []
        for call, t, failed in sorted((r for b in batches for r in zip(b["id"].tolist(), b["s"].tolist(), b["failed"].tolist(), strict=True)), key=lambda r: (r[1], r[0])):
            if name == "open" and t - since >= open_for:
                name, good = "half_open", 0
            out.append((key[0], call, name))
            if name == "open":
                continue
            if failed:
                failed_at = [x for x in failed_at if t - x <= window] + [t]
                if name == "half_open" or len(failed_at) >= failures:
                    name, since, failed_at = "open", t, []
            elif name == "half_open":
                good += 1
                if good >= successes:
                    name, failed_at = "closed", []
        state.update((name, since, good, ",".join(map(str, failed_at))))
        yield pd.DataFrame(out, columns=[by, "id", "state"])

    timed = calls.select(by, "id", "failed", F.unix_seconds("ts").alias("s"))
    return timed.groupBy(by).applyInPandasWithState(step, f"{by} string, id long, state string", "name string, since long, good long, recent string", "append", GroupStateTimeout.NoTimeout)
