"""Hooks on running queries: metrics observed on the rows as they pass, alerts for each micro-batch, and a log of calls.

Metrics are aggregates that Spark computes beside the query (`observe`), so nothing is read twice; a listener gets them once
for each micro-batch on the driver, a few numbers, and holds them against thresholds."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener


def observed(rows: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """rows, unchanged, on which these aggregates are observed under this name."""
    return rows.observe(name, *[c.alias(k) for k, c in metrics.items()])


class Alerts(StreamingQueryListener):
    """thresholds: metric -> (warning, critical). Calls each callback with (name, metric, value, severity), critical before
    warning, and keeps the last `kept` of them and of the batches' metrics."""

    def __init__(self, name: str, thresholds: dict[str, tuple[float, float]], callbacks: list[Callable] | None = None, kept: int = 1000):
        self.name, self.thresholds, self.callbacks = name, thresholds, callbacks or []
        self.alerts: deque = deque(maxlen=kept)
        self.batches: deque = deque(maxlen=kept)
        self.failures: deque = deque(maxlen=kept)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row = event.progress.observedMetrics.get(self.name)
        if row is None:
            return
        found = row.asDict()
        self.batches.append((event.progress.batchId, found))
        for metric, (warning, critical) in self.thresholds.items():
            value = found.get(metric)
            severity = None if value is None else "critical" if value >= critical else "warning" if value >= warning else None
            if severity:
                self.alerts.append((self.name, metric, value, severity))
                for call in self.callbacks:
                    call(self.name, metric, value, severity)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if event.exception:
            self.failures.append(event.exception)


def tracked(kind: str, log: list) -> Callable:
    """Decorates a function (spark, ...) -> DataFrame whose result is then written or counted through `run`: the log gets
    (kind, name, seconds, rows, error) for each run, a failed one's error, too."""

    def around(f: Callable) -> Callable:
        @wraps(f)
        def held(*args, **more):
            def run(action: Callable[[DataFrame], object]):
                seen, begun, error = Observation(), time.time(), None
                try:
                    return action(f(*args, **more).observe(seen, F.count("*").alias("n")))
                except Exception as e:
                    error = type(e).__name__
                    raise
                finally:
                    log.append((kind, f.__name__, time.time() - begun, None if error else seen.get["n"], error))

            return run

        return held

    return around
