"""Signs of life of a running stage: how many of its tasks are done, told from a thread and kept as a small document."""

from __future__ import annotations

import json
import threading
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

from ..sources import places


def task_counts(spark: SparkSession) -> dict[str, int]:
    """Tasks of the stages that run now, in all and done."""
    tracker = spark.sparkContext.statusTracker()
    stages = [s for s in map(tracker.getStageInfo, tracker.getActiveStageIds()) if s is not None]
    return {"stages": len(stages), "tasks": sum(s.numTasks for s in stages), "tasks_done": sum(s.numCompletedTasks for s in stages)}


class Heartbeat:
    """with Heartbeat(spark, tell, every, at, **fields): tell(event) and the document `at` get an event every so many seconds, and the document one more at the end.

    A document that cannot be written stops the document, not the stage. 0 seconds or less: no thread, the last document alone.
    """

    def __init__(self, spark: SparkSession, tell: Callable[[dict], None], every: float, at: str, **fields):
        self.spark, self.tell, self.every, self.at, self.fields = spark, tell, every, at, fields
        self.began, self.stop, self.thread = time.monotonic(), threading.Event(), None

    def _event(self, state: str) -> dict:
        return {"event": "heartbeat", "state": state, "elapsed_seconds": round(time.monotonic() - self.began, 1)} | self.fields | task_counts(self.spark)

    def _keep(self, event: dict) -> None:
        if self.at:
            try:
                places.write_text(self.at, json.dumps(event | {"at": time.time()}) + "\n")
            except OSError:
                self.at = ""

    def _beat(self) -> None:
        while not self.stop.wait(self.every):
            event = self._event("running")
            self._keep(event)
            self.tell(event)

    def __enter__(self) -> Heartbeat:
        if self.every > 0:
            self.thread = threading.Thread(target=self._beat, daemon=True)
            self.thread.start()
        return self

    def __exit__(self, kind, *_) -> None:
        self.stop.set()
        if self.thread:
            self.thread.join()
        self._keep(self._event("failed" if kind else "finished"))
