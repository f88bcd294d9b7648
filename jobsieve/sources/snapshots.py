"""Which writes a memory table consists of: numbered lists, each put in place by one rename.

A write lands in a folder of its own that nobody reads until a list names it. A reader takes the newest list and with it one state
of the table, whatever is written or compacted meanwhile. Two writers that reach for the same number do not overwrite
each other: the second reads the new list and tries the next one.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession

TRIES = 50


@dataclass
class Snapshot:
    """``writes``: folders of the table. ``applied``: the last batch of every stream that is in them, also after compaction."""

    version: int = 0
    writes: list[str] = field(default_factory=list)
    applied: dict[str, int] = field(default_factory=dict)


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/_snapshots")
    return jvm, folder, jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), spark._jsc.hadoopConfiguration())


def current(spark: SparkSession, path: str, version: int | None = None) -> Snapshot:
    """The newest state of the table, or the one of that number; a table that was never written is empty."""
    jvm, folder, files = _files(spark, path)
    if version is None:
        if not files.util().exists(folder):
            return Snapshot()
        names = [s.getPath().getName() for s in files.util().listStatus(folder)]
        version = max((int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith(".")), default=0)
    if not version:
        return Snapshot()
    stream = files.open(jvm.org.apache.hadoop.fs.Path(folder, f"{version:012d}.json"))
    try:
        return Snapshot(**json.loads(jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")))
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, change: Callable[[Snapshot], Snapshot | None]) -> Snapshot:
    """Put the changed list in place as the next number. ``change`` sees the newest list, again after each lost race; null: leave it."""
    jvm, folder, files = _files(spark, path)
    hadoop = jvm.org.apache.hadoop.fs
    for _ in range(TRIES):
        base = current(spark, path)
        after = change(base)
        if after is None:
            return base
        after.version = base.version + 1
        whole = hadoop.Path(folder, f".{uuid.uuid4().hex}.tmp")
        fs = whole.getFileSystem(spark._jsc.hadoopConfiguration())
        out = fs.create(whole, False)
        out.write(bytearray(json.dumps(asdict(after)).encode()))
        out.close()
        once = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 1)
        once[0] = getattr(hadoop.Options.Rename, "NONE")
        try:
            files.rename(whole, hadoop.Path(folder, f"{after.version:012d}.json"), once)
            return after
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception):
                raise
            fs.delete(whole, False)
    raise RuntimeError(f"{path}: {TRIES} other writers were faster")
