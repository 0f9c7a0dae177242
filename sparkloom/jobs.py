"""Jobs: asynchronous runs with results that are paged, and a real cancel."""

from __future__ import annotations

import threading
import time
import uuid
from concurrent.futures import Future, ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .engine import Engine, Result
from .errors import EngineError, Invalid, NotFound, Stopped, translate
from .functions.types import rest_rows, rest_schema
from .sources.names import Scope

#: Rows of a page if the caller names no number, and rows up to which a result is kept as it was collected.
PAGE, KEEP = 10_000, 100_000


@dataclass
class Job:
    project: str
    job_id: str
    configuration: dict
    created: int = field(default_factory=lambda: int(time.time() * 1000))
    started: int | None = None
    ended: int | None = None
    state: str = "PENDING"
    error: dict | None = None
    result: Result | None = None
    schema: dict | None = None
    total: int = 0
    rows: list[dict] | None = None
    parts: list[tuple[str, int]] = field(default_factory=list)
    future: Future | None = None
    cancelled: bool = False

    @property
    def tag(self) -> str:
        return f"job-{self.job_id}".replace(",", "_")

    def resource(self) -> dict:
        kind = next((k for k in ("query", "load", "extract", "copy") if k in self.configuration), "query")
        stats: dict = {"creationTime": str(self.created), "totalBytesProcessed": "0"}
        if self.started:
            stats["startTime"] = str(self.started)
        if self.ended:
            stats["endTime"] = str(self.ended)
        if self.result:
            stats["query"] = {"statementType": self.result.statement, "totalBytesProcessed": "0", "cacheHit": False}
            if self.result.affected is not None:
                stats["query"]["numDmlAffectedRows"] = str(self.result.affected)
        status: dict = {"state": self.state}
        if self.error:
            status |= {"errorResult": self.error, "errors": [self.error]}
        return {
            "kind": "job", "id": f"{self.project}:{self.job_id}", "jobReference": {"projectId": self.project, "jobId": self.job_id, "location": "US"},
            "configuration": {"jobType": kind.upper(), **self.configuration}, "status": status, "statistics": stats,
        }


class Jobs:
    """Runs jobs in threads of one engine; Spark schedules their stages side by side."""

    def __init__(self, engine: Engine, workers: int = 8):
        self.engine, self._jobs, self._lock = engine, {}, threading.Lock()
        self._pool = ThreadPoolExecutor(workers)

    def submit(self, project: str, configuration: dict, job_id: str | None = None) -> Job:
        job = Job(project, job_id or uuid.uuid4().hex, configuration)
        with self._lock:
            if (project, job.job_id) in self._jobs:
                from .errors import AlreadyExists

                raise AlreadyExists(f"Already Exists: Job {project}:{job.job_id}")
            self._jobs[(project, job.job_id)] = job
        job.future = self._pool.submit(self._run, job)
        return job

    def _run(self, job: Job) -> None:
        job.state, job.started = "RUNNING", int(time.time() * 1000)
        spark = self.engine.spark
        try:
            if job.cancelled:
                raise Stopped("Job was cancelled")
            spark.sparkContext.addJobTag(job.tag)
            self._work(job)
        except Exception as e:
            new = translate(e)
            reason = "stopped" if job.cancelled else new.reason if isinstance(new, EngineError) else "internalError"
            job.error = {"reason": reason, "message": str(new), "location": "query", "status": getattr(new, "status", 500)}
        finally:
            spark.sparkContext.removeJobTag(job.tag)
            job.state, job.ended = "DONE", int(time.time() * 1000)

    def _work(self, job: Job) -> None:
        c = job.configuration
        if "query" in c:
            self._query(job, c["query"])
        elif "load" in c:
            o = c["load"]
            from .functions.types import struct_type

            schema = struct_type(o["schema"]["fields"]) if o.get("schema") else None
            self.engine.load(_table(o["destinationTable"]), o.get("sourceUris") or [], o.get("sourceFormat", "CSV"), o, o.get("writeDisposition", "WRITE_APPEND"), schema)
        elif "extract" in c:
            o = c["extract"]
            self.engine.write_files(self.engine.catalog.table(_table(o["sourceTable"])), (o.get("destinationUris") or [o.get("destinationUri", "")])[0], o.get("destinationFormat", "CSV"), {"header": o.get("printHeader", True)})
        elif "copy" in c:
            o = c["copy"]
            sources = o.get("sourceTables") or [o["sourceTable"]]
            self.engine.copy([_table(s) for s in sources], _table(o["destinationTable"]), o.get("writeDisposition", "WRITE_EMPTY"))
        else:
            raise Invalid("A job needs a query, load, extract or copy configuration")

    def _query(self, job: Job, q: dict) -> None:
        scope = scope_of(job.project, q.get("defaultDataset"))
        if q.get("dryRun") or job.configuration.get("dryRun"):
            job.result = Result(None)
            job.schema = rest_schema(self.engine.spark.sql(self.engine.to_spark_sql(q["query"], q.get("queryParameters"), scope)).schema)
            return
        job.result = r = self.engine.query(q["query"], q.get("queryParameters"), scope=scope)
        job.schema = r.schema
        if r.df is None:
            return
        if q.get("destinationTable"):
            self.engine.store(_table(q["destinationTable"]), r.df, q.get("writeDisposition", "WRITE_EMPTY"), q.get("createDisposition", "CREATE_IF_NEEDED"))
            r.df = self.engine.catalog.table(_table(q["destinationTable"]))
        # a small result is collected once; a large one is written and paged from its files.  What the first look has computed is kept for the write
        df = r.df.persist(StorageLevel.DISK_ONLY)
        try:
            head = df.limit(KEEP + 1).collect()
            if len(head) <= KEEP:
                job.rows, job.total = rest_rows(head, df.schema), len(head)
            else:
                job.parts = self._spill(job, df)
                job.total = sum(n for _, n in job.parts)
        finally:
            df.unpersist()

    def _spill(self, job: Job, df: DataFrame) -> list[tuple[str, int]]:
        """Files of the result in its order, each with its rows."""
        path = f"{self.engine.catalog.files.root}/results/{job.job_id}"
        df.write.parquet(path)
        n = self.engine.spark.read.parquet(path).groupBy(F.input_file_name().alias("f")).count()
        return sorted((r["f"], r["count"]) for r in n.collect())

    def wait(self, job: Job, seconds: float | None = None) -> bool:
        """Whether the job is done in time."""
        from concurrent.futures import TimeoutError as Late

        try:
            job.future.result(seconds)
        except Late:
            return False
        return True

    def get(self, project: str, job_id: str) -> Job:
        try:
            return self._jobs[(project, job_id)]
        except KeyError:
            raise NotFound(f"Not found: Job {project}:{job_id}") from None

    def list(self, project: str) -> list[Job]:
        return sorted((j for (p, _), j in self._jobs.items() if p == project), key=lambda j: -j.created)

    def cancel(self, project: str, job_id: str) -> Job:
        job = self.get(project, job_id)
        job.cancelled = job.state != "DONE"
        self.engine.spark.sparkContext.cancelJobsWithTag(job.tag)
        return job

    def delete(self, project: str, job_id: str) -> None:
        job = self.get(project, job_id)
        del self._jobs[(project, job_id)]
        self.engine.catalog.files.delete(f"results/{job.job_id}")

    def page(self, job: Job, start: int = 0, size: int | None = None) -> tuple[list[dict], int | None]:
        """(rows, start of the next page)."""
        n = PAGE if size is None else size
        if job.rows is not None:
            rows = job.rows[start : start + n]
        elif job.result is None or job.result.df is None:
            return [], None
        else:
            # only the files that hold the page are read
            schema, at, rows = job.result.df.schema, 0, []
            for path, count in job.parts:
                skip, left = max(start - at, 0), n - len(rows)
                if skip < count and left > 0:
                    rows += rest_rows(self.engine.spark.read.schema(schema).parquet(path).offset(skip).limit(left).collect(), schema)
                at += count
        nxt = start + len(rows)
        return rows, nxt if rows and nxt < job.total else None


def scope_of(project: str, dataset: dict | None) -> Scope:
    d = dataset or {}
    return Scope(d.get("projectId") or project, d.get("datasetId") or "main")


def _table(ref: dict) -> tuple[str, str, str]:
    return ref["projectId"], ref["datasetId"], ref["tableId"]
