"""The ingest queue on Structured Streaming.

A request is a JSON file in the queue's folder; the file source hands out a few per micro-batch in order of
arrival, and its checkpoint is the record of what was taken. States are appended as parquet rows; the state of a
job is its last row. A batch that runs again after a crash finds jobs in progress and counts a retry.
"""

from __future__ import annotations

import itertools
import json
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass
from datetime import UTC, datetime
from pathlib import Path
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellum.config import DEFAULTS, Settings
from vellum.operators.jobs import TERMINAL, latest_state, progress, recover
from vellum.sources.files import from_requests

REQUEST_SCHEMA = "job_id string, source_type string, source_value string, filename string, kb_name string, submitted_at timestamp, doc_id string, visual boolean"
STATE_SCHEMA = "job_id string, status string, doc_id string, error string, retry_count int, updated_at timestamp"


@dataclass(frozen=True)
class Request:
    source_type: str
    source_value: str
    kb_name: str
    filename: str | None = None
    doc_id: str | None = None
    visual: bool = False


class JobQueue:
    def __init__(self, spark: SparkSession, root: str, settings: Settings = DEFAULTS) -> None:
        self.spark, self.root, self.settings = spark, Path(root), settings
        for name in ("requests", "states"):
            (self.root / name).mkdir(parents=True, exist_ok=True)

    def submit(self, request: Request) -> str:
        """Stores a request in one step and returns its job id."""
        job = str(uuid.uuid4())
        body = asdict(request) | {"job_id": job, "submitted_at": datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%S.%fZ")}
        handle, temporary = tempfile.mkstemp(dir=self.root, prefix=".")
        with os.fdopen(handle, "w") as f:
            f.write(json.dumps(body))
        os.replace(temporary, self.root / "requests" / f"{job}.json")
        self._append([(job, "QUEUED", None, None, 0)])
        return job

    def submit_files(self, files: DataFrame, kb_name: str) -> DataFrame:
        """Stores files (doc_id, filename, content) as inline requests with visual pages, from the tasks that hold
        them; job_id and doc_id of each. A document's job id follows from both, so that a retried task gives the
        same again."""
        mark = uuid.uuid4().hex
        jobs = files.select(
            F.concat(F.lit(mark), F.lit("-"), F.sha1("doc_id")).alias("job_id"), F.lit("inline").alias("source_type"), F.base64("content").alias("source_value"), "filename",
            F.lit(kb_name).alias("kb_name"), F.lit(datetime.now(UTC)).cast("timestamp").alias("submitted_at"), "doc_id", F.lit(True).alias("visual"),
        )
        folder = self.root / "submitted" / mark
        jobs.write.option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").json(str(folder))
        known = self.spark.read.schema(REQUEST_SCHEMA).json(str(folder)).select("job_id", "doc_id")
        states = known.select("job_id", F.lit("QUEUED").alias("status"), F.lit(None).cast("string").alias("doc_id"), F.lit(None).cast("string").alias("error"), F.lit(0).alias("retry_count"), F.current_timestamp().alias("updated_at"))
        states.write.parquet(self._fresh_states())
        for part in sorted(folder.glob("part-*.json")):  # published in one step each
            os.replace(part, self.root / "requests" / f"{mark}-{part.name}")
        return self.spark.read.schema(REQUEST_SCHEMA).json(str(self.root / "requests" / f"{mark}-*.json")).select("job_id", "doc_id")

    def files_of(self, request: dict) -> DataFrame:
        """The file of a request as a row (doc_id, filename, content_type, content, source, source_type)."""
        one = self.spark.createDataFrame([(request["source_type"], request["source_value"], request["filename"])], "source_type string, source_value string, filename string")
        got = from_requests(one, settings=self.settings)
        return got.withColumn("doc_id", F.lit(request.get("doc_id")).cast("string"))

    def set_corrupt_aside(self) -> int:
        """Moves request files that hold no JSON out of the queue's way; how many."""
        (self.root / "corrupt").mkdir(exist_ok=True)
        names = [unquote(r["file"].rsplit("/", 1)[-1]) for r in self.corrupt_requests().select("file").distinct().toLocalIterator()]
        for name in names:
            os.replace(self.root / "requests" / name, self.root / "corrupt" / name)
        return len(names)

    def compact(self) -> int:
        """Rewrites the log of states as the last state of each job; returns the number of jobs. For an idle queue."""
        last = self._log()
        last = last.groupBy("job_id").agg(F.max_by(F.struct("status", "doc_id", "error", "retry_count", "updated_at"), F.struct("updated_at", progress(F.col("status")))).alias("s")).select("job_id", "s.*")
        fresh = self.root / f"states-{uuid.uuid4().hex}"
        last.select(*[c.split()[0] for c in STATE_SCHEMA.split(", ")]).write.parquet(str(fresh / "compacted"))
        old = self.root / f"old-{uuid.uuid4().hex}"
        os.replace(self.root / "states", old)
        os.replace(fresh, self.root / "states")
        shutil.rmtree(old)
        return self.states().count()

    def _append(self, rows: list[tuple]) -> None:
        now = datetime.now(UTC).replace(tzinfo=None)
        self.spark.createDataFrame([(*r, now) for r in rows], STATE_SCHEMA).coalesce(1).write.parquet(self._fresh_states())

    def states(self) -> DataFrame:
        return latest_state(self._log())

    def _log(self) -> DataFrame:
        return self.spark.read.schema(STATE_SCHEMA).option("recursiveFileLookup", True).parquet(str(self.root / "states"))

    def _fresh_states(self) -> str:
        """A folder of its own for every append: workers and submitters never share an output folder."""
        return str(self.root / "states" / uuid.uuid4().hex)

    def status(self, job_id: str) -> DataFrame:
        return self.states().where(F.col("job_id") == job_id)

    def corrupt_requests(self) -> DataFrame:
        """Request files that hold no JSON, as (file, content)."""
        raw = self.spark.read.schema(REQUEST_SCHEMA + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").option("multiLine", True).json(str(self.root / "requests"))
        return raw.where("_corrupt IS NOT NULL OR job_id IS NULL").select(F.input_file_name().alias("file"), F.col("_corrupt").alias("content"))

    def recover(self) -> int:
        """After a restart: jobs in progress are queued again, or fail when their retries are used up.
        Returns how many changed. Terminal and queued jobs stay as they are."""
        running = self.states().where("status = 'IN_PROGRESS'")
        changed = recover(running, self.settings).select("job_id", "status", "doc_id", "error", "retry_count", F.current_timestamp().alias("updated_at"))
        rows = changed.collect()  # only jobs that the last run's batch left open
        if rows:
            self._append([tuple(r)[:5] for r in rows])
        return len(rows)

    def run(self, work: Callable[[dict], str], checkpoint: str, per_batch: int = 16, once: bool = True, workers: int = 2) -> StreamingQuery:
        """Starts the workers, so many at a time; a batch holds the requests of at most per_batch files. work(request) ingests one request and returns the document id; its error marks
        that job as failed and leaves the others alone. A failed job is never tried again. Jobs already ended
        are passed over, so a batch that runs twice does its work once."""
        stream = self.spark.readStream.schema(REQUEST_SCHEMA).option("maxFilesPerTrigger", per_batch).option("latestFirst", False).json(str(self.root / "requests"))

        def batch(df: DataFrame, _: int) -> None:
            jobs = df.where("job_id IS NOT NULL").join(self.states().select("job_id", "status", "retry_count"), "job_id", "left")

            def one(row: dict) -> None:
                if row["status"] in TERMINAL:
                    return
                retries = (row["retry_count"] or 0) + (row["status"] == "IN_PROGRESS")
                if retries > self.settings.max_retries:
                    self._append([(row["job_id"], "FAILED", None, f"gave up: retry cap ({self.settings.max_retries}) reached", retries)])
                    return
                self._append([(row["job_id"], "IN_PROGRESS", None, None, retries)])
                try:
                    done = (row["job_id"], "COMPLETED", work(row), None, retries)
                except Exception as e:  # noqa: BLE001 - one job's failure is that job's state
                    done = (row["job_id"], "FAILED", None, str(e) or type(e).__name__, retries)
                self._append([done])

            # every request of the batch is taken, in order, with few in memory at a time
            rows = (r.asDict() for r in jobs.orderBy("submitted_at", "job_id").toLocalIterator())
            with ThreadPoolExecutor(max_workers=max(1, workers)) as pool:
                while part := list(itertools.islice(rows, max(1, workers))):
                    list(pool.map(one, part))

        writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="1 second")).start()
