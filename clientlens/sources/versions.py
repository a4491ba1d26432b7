"""Tables that are replaced as a whole: readers see the old ones or the new ones, never a mixture.

Tables are written beside the present ones, then a numbered manifest that names them is moved
into place. A move onto a number that is taken fails and the next number is tried, so of two
writers both are recorded, one after the other; a writer that fails leaves nothing that
readers follow.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

_MANIFESTS = "_manifests"


@dataclass(frozen=True)
class Version:
    """What the manifest of a number says: the folder of each table, and plain values."""

    number: int
    tables: dict[str, str]
    values: dict[str, str]

    def read(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(self.tables[name])


def _files(spark: SparkSession, folder: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{_MANIFESTS}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def newest(spark: SparkSession, folder: str) -> Version | None:
    """The version with the highest number, None before the first."""
    fs, path = _files(spark, folder)
    if not fs.exists(path):
        return None
    numbers = [int(name) for name in (f.getPath().getName() for f in fs.listStatus(path)) if name.isdigit()]
    if not numbers:
        return None
    text = spark.read.text(f"{folder}/{_MANIFESTS}/{max(numbers):012d}", wholetext=True).first()["value"]
    held = json.loads(text)
    return Version(max(numbers), held["tables"], held["values"])


def _publish(spark: SparkSession, folder: str, number: int, text: str) -> bool:
    """Whether the manifest got that number; if not, another writer has it."""
    fs, path = _files(spark, folder)
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    fs.mkdirs(path)
    draft, final = hadoop.Path(path, f"draft-{uuid.uuid4().hex}"), hadoop.Path(path, f"{number:012d}")
    out = fs.create(draft, False)
    out.write(bytearray(text.encode()))
    out.close()
    options = spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        hadoop.FileContext.getFileContext(path.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, final, options)
    except Py4JJavaError:
        fs.delete(draft, False)
        if fs.exists(final):
            return False
        raise
    return True


def commit(spark: SparkSession, folder: str, tables: dict[str, DataFrame] | None = None, values: dict[str, str] | None = None,
           partition_by: tuple[str, ...] = ()) -> Version:
    """Write ``tables``, then make them and ``values`` the newest version.

    Tables and values of other names stay as the newest version has them when the manifest is
    written, so writers of different tables do not undo each other. A frame may read the
    tables it replaces. Folders of older versions stay until ``discard_old``.
    """
    written = {}
    for name, df in (tables or {}).items():
        written[name] = f"{folder}/{name}-{uuid.uuid4().hex[:12]}"
        df.write.partitionBy(*partition_by).parquet(written[name])
    while True:
        last = newest(spark, folder) or Version(0, {}, {})
        made = Version(last.number + 1, last.tables | written, last.values | (values or {}))
        if _publish(spark, folder, made.number, json.dumps({"tables": made.tables, "values": made.values})):
            return made


def discard_old(spark: SparkSession, folder: str) -> int:
    """Remove folders and manifests that the newest version does not name; to be called when no
    writer and no reader of an older version is at work. Returns how many were removed."""
    last = newest(spark, folder)
    if last is None:
        return 0
    fs, manifests = _files(spark, folder)
    named = {path.rsplit("/", 1)[-1] for path in last.tables.values()} | {_MANIFESTS}
    gone = [f.getPath() for f in fs.listStatus(manifests.getParent()) if f.getPath().getName() not in named]
    gone += [f.getPath() for f in fs.listStatus(manifests) if f.getPath().getName() != f"{last.number:012d}"]
    for path in gone:
        fs.delete(path, True)
    return len(gone)
