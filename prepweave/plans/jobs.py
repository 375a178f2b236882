"""Running plans in the background: states, progress, cancelling, retries."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

from prepweave.errors import PlanError

FINAL = ("succeeded", "partial", "failed", "cancelled")


class Cancelled(Exception):
    """Raised between stages of a job that is to end."""


@dataclass
class Job:
    job_id: str
    state: str = "queued"
    progress: float = 0.0
    stage: str = ""
    error_code: str | None = None
    retryable: bool = False
    checkpoints: list[str] = field(default_factory=list)
    future: Future | None = None
    stop: threading.Event = field(default_factory=threading.Event)

    def step(self, stage: str, progress: float) -> None:
        """Called by the work between stages: ends it if the job is cancelled."""
        if self.stop.is_set():
            raise Cancelled(stage)
        self.stage, self.progress = stage, progress
        self.checkpoints.append(stage)


class JobRunner:
    """Jobs of one session, one after the other; each is a Spark job group, which cancelling ends."""

    def __init__(self, spark: SparkSession, workers: int = 1):
        self.spark, self.jobs, self.pool = spark, {}, ThreadPoolExecutor(workers)

    def submit(self, work: Callable[[Job], str]) -> Job:
        """work gets the job, calls its step() between stages and returns succeeded or partial."""
        job = Job(f"job-{uuid.uuid4().hex[:12]}")
        self.jobs[job.job_id] = job
        job.future = self.pool.submit(self._run, job, work)
        return job

    def _run(self, job: Job, work: Callable[[Job], str]) -> None:
        context = self.spark.sparkContext
        if job.stop.is_set():
            job.state = "cancelled"
            return
        job.state = "running"
        context.setJobGroup(job.job_id, job.job_id, interruptOnCancel=True)
        try:
            result = work(job)
            job.state = "cancelled" if job.stop.is_set() else result
        except Cancelled:
            job.state = "cancelled"
        except Exception as e:
            job.state = "cancelled" if job.stop.is_set() else "failed"
            job.error_code = e.code if isinstance(e, PlanError) else type(e).__name__
            job.retryable = isinstance(e, OSError)
        finally:
            job.progress = 1.0 if job.state in ("succeeded", "partial") else job.progress

    def cancel(self, job_id: str) -> None:
        job = self.jobs[job_id]
        if job.state in FINAL:
            raise PlanError("JOB_NOT_CANCELLABLE", job.state)
        job.stop.set()
        if job.state == "running":
            job.state = "cancelling"
        self.spark.sparkContext.cancelJobGroup(job_id)

    def retry(self, job_id: str, work: Callable[[Job], str]) -> Job:
        job = self.jobs[job_id]
        if job.state != "failed" or not job.retryable:
            raise PlanError("JOB_NOT_RETRYABLE", job.state)
        return self.submit(work)


def recover(states: dict[str, Job]) -> list[str]:
    """After a restart nothing runs: running jobs have failed, and can be retried if they had reached a stage's end."""
    found = []
    for job in states.values():
        if job.state in ("queued", "running", "cancelling"):
            job.state, job.error_code, job.retryable = "failed", "ORPHANED_JOB_RECOVERED", bool(job.checkpoints)
            found.append(job.job_id)
    return found
