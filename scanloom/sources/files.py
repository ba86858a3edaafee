"""File trees: listing with pruned directories, text, retention."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from scanloom.constants import RETENTION_HOURS
from scanloom.functions.text import utf8_text
from scanloom.session import checkpoint


def outside(path: Column, skip_dirs: list[str]) -> Column:
    """True when no directory of the relative path, at any depth, is skipped.

    Only directories count: a file may bear a skipped name.
    """
    parts = F.split(path, "/")
    folders = F.slice(parts, F.lit(1), F.size(parts) - 1)
    return ~F.arrays_overlap(folders, F.array(*[F.lit(s) for s in skip_dirs]).cast("array<string>"))


#: How many files or directories a task is given, about.
FILES_A_TASK = 5_000


def _spread(names: DataFrame) -> DataFrame:
    """Rows (root, path, …) dealt by name over tasks, as many as the rows ask for; a count of their own keeps them apart.

    Opening or writing a file costs time and hardly any bytes: the size of splits, or of partitions that adaptive
    execution puts together, would leave many files to one task.
    """
    tasks = int(names.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return names.repartition(max(tasks, -(-names.count() // FILES_A_TASK)), F.xxhash64("root", "path"))


def walk_files(roots: DataFrame, skip_dirs: list[str] = (), budget: int = 20_000) -> DataFrame:
    """All regular files below each ``root``, as (root, path, size, modified), path relative.

    Spark's own file sources hide names that start with a dot or an underscore, so directories are
    read with ``os.scandir`` on the executors. A task lists at most ``budget`` entries before it
    hands its unread directories back, and these are spread over the cluster for the next pass; one
    huge tree is shared by all tasks after the first pass. Symbolic links are left out, and what vanishes
    while the tree is read; a root that does not exist is an error. A null root lists nothing.
    """
    skip = frozenset(skip_dirs)

    def frame(root: str, found: list[tuple], is_dir: bool) -> pd.DataFrame:
        rows = pd.DataFrame(found, columns=["path", "size", "millis"])
        return rows.assign(root=root, is_dir=is_dir)[["root", "path", "size", "millis", "is_dir"]]

    def listing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for root, start in zip(batch["root"], batch["path"]):
                files, pending, seen = [], [start], 0
                while pending and seen < budget:
                    rel = pending.pop()
                    try:
                        entries = os.scandir(os.path.join(root, rel) if rel else root)
                    except FileNotFoundError:
                        if rel:
                            continue
                        raise
                    with entries:
                        for entry in entries:
                            seen += 1
                            path = f"{rel}/{entry.name}" if rel else entry.name
                            if entry.is_dir(follow_symlinks=False):
                                if entry.name not in skip:
                                    pending.append(path)
                            elif entry.is_file(follow_symlinks=False):
                                try:
                                    facts = entry.stat(follow_symlinks=False)
                                except FileNotFoundError:
                                    continue
                                files.append((path, facts.st_size, facts.st_mtime_ns // 1_000_000))
                            if len(files) >= 10_000:
                                yield frame(root, files, False)
                                files = []
                if files:
                    yield frame(root, files, False)
                if pending:
                    yield frame(root, [(path, 0, 0) for path in pending], True)

    found = None
    todo = roots.where(F.col("root").isNotNull()).select("root", F.lit("").alias("path"))
    while True:
        seen = checkpoint(_spread(todo).mapInPandas(listing, "root STRING, path STRING, size BIGINT, millis BIGINT, is_dir BOOLEAN"))
        files = seen.filter(~F.col("is_dir")).select("root", "path", "size", F.timestamp_millis("millis").alias("modified"))
        found = files if found is None else found.unionByName(files)
        todo = seen.filter("is_dir").select("root", "path")
        if todo.isEmpty():
            return found


def file_texts(files: DataFrame, batch_bytes: int = 8 << 20) -> DataFrame:
    """Files (root, path, …) with their whole ``text`` as UTF-8, and ``read_error``: null, ``missing`` or ``unreadable``.

    Only the rows given are opened: filter the listing first. Files are spread by name over all tasks and travel in
    batches of about ``batch_bytes``, a larger file in a batch of its own. Invalid bytes become U+FFFD. A
    file that is gone or cannot be opened has a null text and a reason, and the others are read all the same;
    a null root or path counts as missing. Repeated rows are read each. Other columns stay, but for those named
    ``content``, ``text`` or ``read_error``, which are replaced.
    """
    names = [c for c in files.columns if c not in ("content", "text", "read_error")]

    def one(root: str | None, path: str | None) -> tuple[bytes | None, str | None]:
        if root is None or path is None:
            return None, "missing"
        try:
            with open(os.path.join(root, path), "rb") as f:
                return f.read(), None
        except FileNotFoundError:
            return None, "missing"
        except OSError:
            return None, "unreadable"

    def reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots, paths = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("root", "path"))
            start, size, got = 0, 0, []
            for n, (root, path) in enumerate(zip(roots, paths, strict=True)):
                content, error = one(root, path)
                got.append((content, error))
                size += len(content or b"")
                if size >= batch_bytes or n + 1 == len(roots):
                    contents, errors = zip(*got, strict=True)
                    columns = [*batch.slice(start, len(got)).columns, pa.array(contents, pa.binary()), pa.array(errors, pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "content", "read_error"])
                    start, size, got = n + 1, 0, []

    spread = _spread(files.select(*names))
    shape = StructType([*spread.schema.fields, StructField("content", BinaryType()), StructField("read_error", StringType())])
    return spread.mapInArrow(reading, shape).select(*names, utf8_text(F.col("content")).alias("text"), "read_error")


def write_files(files: DataFrame) -> int:
    """Write each row's ``text`` as ``path`` below ``root``, a folder that all executors have mounted; the number written.

    A file appears whole under its name or not at all, so a task can be repeated. Null texts are not written. Files are
    spread by name over all tasks, however few files or row groups their rows are stored in.
    """

    def writing(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for root, path, text in zip(batch["root"], batch["path"], batch["text"], strict=True):
                target = os.path.join(root, path)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                part = f"{target}.{uuid.uuid4().hex}"
                with open(part, "wb") as f:
                    f.write(text.encode())
                os.replace(part, target)
            yield pd.DataFrame({"n": [len(batch)]})

    rows = _spread(files.select("root", "path", "text")).where(F.col("text").isNotNull())
    return rows.mapInPandas(writing, "n BIGINT").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def expired(modified_at: Column, now: Column) -> Column:
    """Older than the retention time, strictly."""
    return modified_at < now - F.make_dt_interval(hours=F.lit(RETENTION_HOURS))
