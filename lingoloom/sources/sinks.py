"""Sinks that may be written twice and hold each row once."""

from __future__ import annotations

import hashlib
import json
import logging
import os
import urllib.error
import urllib.request
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

log = logging.getLogger(__name__)
#: Seconds that an outside service has for an answer.
TIMEOUT = 120


def appended(rows: DataFrame, folder: str, batch: str) -> None:
    """Append a batch's rows: the batch's part of the folder is replaced, so that a batch that is written again counts once."""
    rows.write.mode("overwrite").parquet(f"{folder}/batch={batch}")


def stored_forms(found: DataFrame, known: DataFrame, folder: str, batch: str) -> int:
    """Append the standard forms (language, word, standard_form) of words that have none; how many were skipped, which is logged as well."""
    keys = ["language", "word"]
    seen, new = Observation(), Observation()
    own = found.select(*keys, "standard_form").observe(seen, F.count("*").alias("n")).dropDuplicates(keys)
    appended(own.join(known.select(*keys), keys, "left_anti").observe(new, F.count("*").alias("n")), folder, batch)
    skipped = seen.get["n"] - new.get["n"]
    if skipped:
        log.warning("%d standard forms were there already", skipped)
    return skipped


@dataclass
class Part(WriterCommitMessage):
    """What a task has written: its file, and how many rows; of posts the errors."""

    path: str
    number: int
    rows: int
    errors: list[str]


class Lines(DataSource):
    """Appends rows as JSON lines under a folder that all machines mount: ``df.write.format("lines").option("batch", "7").save(folder)``.

    Tasks write to files of their own; only files that a complete task has reported are moved into the batch's folder, which is replaced.
    """

    @classmethod
    def name(cls) -> str:
        return "lines"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return LinesWriter(self.options["path"], self.options.get("batch", "0"))


class LinesWriter(DataSourceWriter):
    def __init__(self, folder: str, batch: str) -> None:
        self.folder, self.batch = folder, batch
        self.work = f"{folder}/_work/{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Part:
        from pyspark import TaskContext

        context = TaskContext.get()
        os.makedirs(self.work, exist_ok=True)
        part, n = Part(f"{self.work}/{uuid.uuid4().hex}.json", context.partitionId() if context else 0, 0, []), 0
        with open(part.path, "w") as out:
            for row in iterator:
                out.write(json.dumps(row.asDict(True), default=str) + "\n")
                n += 1
        part.rows = n
        return part

    def commit(self, messages: list[Part | None]) -> None:
        place = f"{self.folder}/batch={self.batch}"
        os.makedirs(place, exist_ok=True)
        old = set(os.listdir(place))
        for m in filter(None, messages):
            name = f"part-{m.number:05}.json"
            os.replace(m.path, f"{place}/{name}")
            old.discard(name)
        for name in old:
            os.remove(f"{place}/{name}")
        self.abort([])

    def abort(self, messages: list[Part | None]) -> None:
        """Files of tasks that didn't get through go."""
        if os.path.isdir(self.work):
            for name in os.listdir(self.work):
                os.remove(f"{self.work}/{name}")
            os.rmdir(self.work)


class Posts(DataSource):
    """Posts each row as JSON: ``df.write.format("posts").option("url", ...).option("report", file).save()``.

    A row carries the digest of its text as a key, by which a service that gets it again (from a task that is repeated) can tell. An answer other than 200, or
    none within the time-out, is an error text and not the job's end; the report lists them.
    """

    @classmethod
    def name(cls) -> str:
        return "posts"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return PostsWriter(self.options["url"], self.options.get("report"), float(self.options.get("timeout", TIMEOUT)))


class PostsWriter(DataSourceWriter):
    def __init__(self, url: str, report: str | None, timeout: float) -> None:
        self.url, self.report, self.timeout = url, report, timeout

    def post(self, body: bytes) -> str | None:
        """The error, if there is one."""
        sent = urllib.request.Request(self.url, body, {"Content-Type": "application/json", "Idempotency-Key": hashlib.sha256(body).hexdigest()})
        try:
            with urllib.request.urlopen(sent, timeout=self.timeout) as answer:
                return None if answer.status == 200 else f"{answer.status}: {answer.read().decode(errors='replace')}"
        except urllib.error.HTTPError as e:
            return f"{e.code}: {e.read().decode(errors='replace')}"
        except OSError as e:
            return str(e)

    def write(self, iterator: Iterator[Row]) -> Part:
        part = Part("", 0, 0, [])
        for row in iterator:
            error = self.post(json.dumps(row.asDict(True), default=str, sort_keys=True).encode())
            part.rows += error is None
            part.errors += [error] if error else []
        return part

    def commit(self, messages: list[Part | None]) -> None:
        own = [m for m in messages if m]
        errors = [e for m in own for e in m.errors]
        for e in errors:
            log.warning("a row was not taken: %s", e)
        if self.report:
            with open(self.report, "w") as out:
                json.dump({"rows": sum(m.rows for m in own), "errors": errors}, out)
