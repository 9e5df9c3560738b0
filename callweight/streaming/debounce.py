"""Runs that follow changes: a trailing-edge debounce by project, one run at a time, cancelled by news.

The debounce is a stateful operator with timers: every change of a project puts its timer off, and
only a timer that no later change has replaced emits a request to run. Requests go to a single flight
for each project: what arrives during a run interrupts it and makes exactly one more.
"""

from __future__ import annotations

import logging
import threading
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import InheritableThread
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

log = logging.getLogger("callweight")

DELAY_MS = 800
REQUEST = "project string, changes long, first timestamp, last timestamp"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Debounce(StatefulProcessor):
    """Pending changes of a project, their number and first and last time, until its timer is due."""

    def __init__(self, delay_ms: int):
        self.delay_ms = delay_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getValueState("pending", "n long, first timestamp, last timestamp, due long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, first, last, due = self.pending.get() if self.pending.exists() else (0, None, None, None)
        for pdf in rows:
            if len(pdf):
                n += len(pdf)
                low, high = pdf["modified"].min().to_pydatetime(), pdf["modified"].max().to_pydatetime()
                first, last = low if first is None else min(first, low), high if last is None else max(last, high)
        if due is not None:
            self.handle.deleteTimer(due)
        due = timerValues.getCurrentProcessingTimeInMs() + self.delay_ms
        self.handle.registerTimer(due)
        self.pending.update((n, first, last, due))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        n, first, last, due = self.pending.get() if self.pending.exists() else (0, None, None, None)
        if due is None or expiredTimerInfo.getExpiryTimeInMs() != due:
            return iter([])
        self.pending.clear()
        return iter([pd.DataFrame({"project": [key[0]], "changes": [n], "first": [first], "last": [last]})])

    def close(self) -> None:
        pass


def debounced(changes: DataFrame, delay_ms: int = DELAY_MS) -> DataFrame:
    """A stream of requests (project, changes, first, last) from a stream of (project, modified): one
    for each burst, `delay_ms` after its last change. Null projects are a project of their own."""
    changes.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    rows = changes.selectExpr("coalesce(project, '') as project", "modified")
    return rows.groupBy("project").transformWithStateInPandas(Debounce(delay_ms), REQUEST, "Append", "ProcessingTime")


class SingleFlight:
    """At most one run of a key at a time. A request during a run interrupts its Spark jobs, and the
    run is made once more when it has ended, however many requests there were."""

    def __init__(self, spark: SparkSession, run: Callable[[str, threading.Event], None]):
        self.spark, self.run = spark, run
        self.lock = threading.Lock()
        self.active: dict[str, threading.Event] = {}
        self.again: set[str] = set()
        self.threads: list[threading.Thread] = []
        self.started, self.cancelled, self.done = 0, 0, 0

    @staticmethod
    def tag(key: str) -> str:
        return "run-" + "".join(c if c.isalnum() else "-" for c in key) + f"-{abs(hash(key))}"

    def request(self, key: str) -> None:
        with self.lock:
            if key in self.active:
                self.again.add(key)
                if not self.active[key].is_set():
                    self.active[key].set()
                    self.cancelled += 1
                    self.spark.sparkContext.cancelJobsWithTag(self.tag(key))  # a session's own tags are seen by one thread only
                return
            self._start(key)

    def _start(self, key: str) -> None:
        stop = threading.Event()
        self.active[key] = stop
        self.started += 1
        t = InheritableThread(target=self._go, args=(key, stop), daemon=True)
        self.threads.append(t)
        t.start()

    def _go(self, key: str, stop: threading.Event) -> None:
        self.spark.sparkContext.addJobTag(self.tag(key))
        try:
            self.run(key, stop)
            if not stop.is_set():
                self.done += 1
        except Exception as e:
            if not stop.is_set():  # a run that failed by itself; the next change makes a new one
                log.warning("run of %s: %s", key, e)
        finally:
            self.spark.sparkContext.removeJobTag(self.tag(key))
            with self.lock:
                del self.active[key]
                if key in self.again:
                    self.again.discard(key)
                    self._start(key)

    def wait(self) -> None:
        """Until nothing runs."""
        while True:
            with self.lock:
                left = [t for t in self.threads if t.is_alive()]
            if not left:
                return
            left[0].join()


def run_on_change(requests: DataFrame, flight: SingleFlight, checkpoint: str, every: str = "200 milliseconds") -> StreamingQuery:
    """Hand every request of `debounced` to a single flight; a micro-batch does not wait for its runs."""

    def each(batch: DataFrame, _: int) -> None:
        for r in batch.select("project").distinct().toLocalIterator():
            flight.request(r.project)

    return requests.writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
