"""Progress of streams: a listener that writes a row for each micro-batch, with what was observed in it, into a table of JSON lines."""

from __future__ import annotations

import json
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from pairwave.sources.shared import file_system

SCHEMA = "name string, run string, batch long, rows_in long, seconds double, backlog_files long, observed map<string, long>"


class Progress(StreamingQueryListener):
    """Rows (name, run, batch, rows_in, seconds, backlog_files, observed) of the streams called ``name``, below folder: a file a micro-batch, which a repeated one
    replaces. backlog_files: what a source of files had found and not yet admitted."""

    def __init__(self, name: str, folder: str):
        self.name, self.folder, self.ended, self.runs = name, folder, threading.Event(), set()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        if event.name == self.name:
            self.runs.add(str(event.runId))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        if p.name != self.name:
            return
        store, top = file_system(self.folder)
        store.create_dir(top, recursive=True)
        waiting = sum(int(s.metrics.get("numFilesOutstanding", 0)) for s in p.sources if s.metrics)
        observed = {k: v for row in p.observedMetrics.values() for k, v in row.asDict().items()}
        line = {"name": p.name, "run": str(p.runId), "batch": p.batchId, "rows_in": p.numInputRows, "seconds": p.batchDuration / 1000, "backlog_files": waiting, "observed": observed}
        with store.open_output_stream(f"{top}/{p.runId}-{p.batchId:09d}.json") as f:
            f.write(json.dumps(line).encode() + b"\n")

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if str(event.runId) in self.runs:
            self.ended.set()


def table(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SCHEMA).json(folder)
