"""Watching a folder with Structured Streaming: each file that arrives is reported on and moved away."""

from __future__ import annotations

import re
import shutil
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tendrel.operators import verdict
from tendrel.plans import pipeline, render
from tendrel.sources import readers


class EmptyLibrary(Exception):
    """The library holds no readable section."""


class Library:
    """A library that is read again when its files change; a reload that finds nothing keeps the last good one."""

    def __init__(self, spark: SparkSession, folder: str | Path):
        self.spark, self.folder = spark, Path(folder)
        self.mark = readers.fingerprint(folder)
        self.chunks, self.skipped = self._load()
        if self.chunks.isEmpty():
            raise EmptyLibrary(str(folder))

    def _load(self) -> tuple[DataFrame, DataFrame]:
        chunks, skipped = readers.load_corpus(self.spark, self.folder)
        return chunks.cache(), skipped

    def current(self) -> DataFrame:
        mark = readers.fingerprint(self.folder)
        if mark != self.mark:
            try:
                chunks, skipped = self._load()
                usable = not chunks.isEmpty()
            except Exception:  # whatever a half-copied library does, the last good one stays and is tried again
                return self.chunks
            self.mark = mark
            if usable:
                self.chunks.unpersist()
                self.chunks, self.skipped = chunks, skipped
        return self.chunks


class Gate:
    """Lets a file through once its size stayed the same between two looks: a copy in progress isn't read."""

    def __init__(self, inbox: str | Path, landing: str | Path):
        self.inbox, self.landing, self.sizes = Path(inbox), Path(landing), {}
        self.landing.mkdir(parents=True, exist_ok=True)

    def look(self) -> list[Path]:
        """Moves settled files into the landing folder (a rename is seen whole or not at all); returns where to."""
        moved, seen = [], {}
        for p in sorted(x for x in self.inbox.iterdir() if x.is_file()):
            if p.name.startswith((".", "~$")) or p.suffix.lower() not in readers.SUPPORTED:
                continue
            seen[p] = p.stat().st_size
            if self.sizes.get(p) == seen[p]:
                moved.append(_move(p, self.landing))
                seen.pop(p)
        self.sizes = seen
        return moved


def _move(path: Path, folder: Path) -> Path:
    """Into folder without overwriting anything."""
    folder.mkdir(parents=True, exist_ok=True)
    target = folder / path.name
    while target.exists():
        target = folder / f"{path.stem}-{time.time_ns()}{path.suffix}"
    return Path(shutil.move(path, target))


def slug(name: str) -> str:
    return re.sub(r"[^\w-]", "-", name, flags=re.U).strip("-").lower() or "report"


def report(spark: SparkSession, path: Path, library: DataFrame, out: Path, **thresholds: float) -> Path:
    """The three reports of one file, in a folder of its own; ValueError if it asks for nothing."""
    text = readers.read_bytes(str(path), path.read_bytes())
    rows = verdict.action_order(pipeline.tender_coverage(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), library, **thresholds)).collect()
    if not rows:
        raise ValueError(f"{path.name}: no requirements found")
    target = out / slug(path.stem)
    while target.exists():
        target = out / f"{slug(path.stem)}-{time.time_ns()}"
    render.write(target, {"coverage.csv": render.coverage_csv(rows), "coverage.md": render.coverage_markdown(path.stem, rows), "coverage.html": render.coverage_html(path.stem, rows)})
    return target


def watch(
    spark: SparkSession, inbox: str | Path, corpus: str | Path, out: str | Path, checkpoint: str | Path, interval: float | None = 5.0, landing: str | Path | None = None, **thresholds: float
) -> StreamingQuery:
    """Starts a stream over the landing folder (inbox/.landing). Each batch's files are read and reported on; a file that
    fails goes to failed/ with a note and the stream goes on; others go to done/. With interval None, what is there is
    worked off and the query ends."""
    inbox, out = Path(inbox), Path(out)
    landing = Path(landing or inbox / ".landing")
    landing.mkdir(parents=True, exist_ok=True)
    library = Library(spark, corpus)

    def handle(batch: DataFrame, _: int) -> None:
        chunks = library.current()
        for row in batch.select("path").orderBy("path").collect():
            path = Path(re.sub(r"^file:(//)?", "", row["path"]))
            if not path.exists():
                continue
            try:
                report(spark, path, chunks, out, **thresholds)
            except Exception as e:  # one bad file must not end the stream
                moved = _move(path, inbox / "failed")
                moved.with_name(moved.name + ".error.txt").write_text(f"{e}\n", encoding="utf-8")
            else:
                _move(path, inbox / "done")

    stream = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").load(str(landing)).select(F.regexp_replace("path", "%20", " ").alias("path"))
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", str(checkpoint))
    return (writer.trigger(availableNow=True) if interval is None else writer.trigger(processingTime=f"{interval} seconds")).start()


def run(spark: SparkSession, inbox: str | Path, corpus: str | Path, out: str | Path, checkpoint: str | Path, interval: float = 5.0, **thresholds: float) -> None:
    """Polls until interrupted."""
    query, gate = watch(spark, inbox, corpus, out, checkpoint, interval, **thresholds), Gate(inbox, Path(inbox) / ".landing")
    try:
        while query.isActive:
            gate.look()
            time.sleep(interval)
        query.awaitTermination()
    except KeyboardInterrupt:
        query.stop()
