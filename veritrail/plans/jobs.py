"""Work in the background: one job at a time, with progress, and cancelled with its Spark tasks."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable

from pyspark.sql import SparkSession

#: Lines of a job's log that are kept.
LOG_LINES = 200


class Cancelled(BaseException):
    """Raised at a progress point of a job that was cancelled; no ``except Exception`` on the way swallows it."""


class Busy(RuntimeError):
    """Another job is running."""


class Job:
    """What a piece of work reports and what may be asked about it; all of it from any thread."""

    def __init__(self, kind: str):
        self.kind, self.state, self.group = kind, "running", f"{kind}-{uuid.uuid4().hex}"
        self.phase, self.done, self.total = "starting", 0, 0
        self.lines: list[str] = []
        self.result, self.error = None, None
        self.began, self.ended = time.time(), None
        self.stop, self.lock = threading.Event(), threading.Lock()

    def progress(self, phase: str, done: int = 0, total: int = 0) -> None:
        """Reports how far the work is; a cancelled job ends here."""
        if self.stop.is_set():
            raise Cancelled
        with self.lock:
            self.phase, self.done, self.total = phase, done, total

    def log(self, line: str) -> None:
        with self.lock:
            self.lines = [*self.lines, line][-LOG_LINES:]

    def view(self) -> dict:
        with self.lock:
            seconds = round((self.ended or time.time()) - self.began, 1)
            return {"kind": self.kind, "state": self.state, "phase": self.phase, "done": self.done, "total": self.total, "log": self.lines[-40:], "error": self.error, "seconds": seconds}


class Jobs:
    """Runs one job at a time in a thread of its own."""

    def __init__(self, spark: SparkSession):
        self.spark, self.current, self._thread, self._lock = spark, None, None, threading.Lock()

    def start(self, kind: str, work: Callable[[Job], object]) -> Job:
        """Starts ``work(job)``; :class:`Busy` while another job runs. Spark jobs it starts belong to the job's group."""
        with self._lock:
            if self.current is not None and self.current.state == "running":
                raise Busy(f"{self.current.kind} is running")
            job = self.current = Job(kind)

        def run() -> None:
            self.spark.sparkContext.setJobGroup(job.group, kind, interruptOnCancel=True)
            state, result, error = "done", None, None
            try:
                result = work(job)
            except Cancelled:
                state = "cancelled"
            except Exception as why:
                state, error = ("cancelled", None) if job.stop.is_set() else ("failed", str(why))
            with job.lock:
                job.result, job.error, job.ended, job.state = result, error, time.time(), state

        self._thread = threading.Thread(target=run, daemon=True)
        self._thread.start()
        return job

    def cancel(self) -> bool:
        """Asks the running job to end, and cancels its Spark jobs, those too that it starts before it ends; whether there was one."""
        job = self.current
        if job is None or job.state != "running":
            return False
        job.stop.set()

        def end() -> None:
            while job.state == "running":
                self.spark.sparkContext.cancelJobGroup(job.group)
                time.sleep(0.2)

        threading.Thread(target=end, daemon=True).start()
        return True

    def wait(self, seconds: float | None = None) -> dict | None:
        """The job's view once it has ended, or after so many seconds."""
        if self._thread is not None:
            self._thread.join(seconds)
        return self.current and self.current.view()
