"""Durable stage tables [C09, C10]: lineage is cut where several later steps read a result.

Tables go to the shared folder named in spark.checkpoint.dir (an own one where
it is unset); executors may be lost at any time without loss of a stage. A named
stage is kept under its settings' hash and read again while these stay the same.
"""

from __future__ import annotations

import atexit
import hashlib
import json
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quireflow.errors import OptionError

_made: list[tuple[SparkSession, str]] = []
_own: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, an own folder, which only a local session can use."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not spark.sparkContext.master.startswith("local"):
        raise OptionError("spark.checkpoint.dir is not set; stages need a folder that all executors share")
    if not _own:
        _own.append(f"file://{tempfile.mkdtemp(prefix='quireflow-')}")
    return _own[0]


def stage(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back; deleted when the process ends."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            jvm = spark.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended
            return


def settings_key(settings: dict[str, object]) -> str:
    """16 hex digits of settings in canonical JSON [T24]."""
    return hashlib.sha256(json.dumps(settings, sort_keys=True, default=str).encode()).hexdigest()[:16]


#: Raised when stage tables are laid out anew; older ones are then wiped.
SCHEMA = 2
_MANIFEST = "quireflow-manifest.json"


class WorkFolder:
    """Named stages of one source under a folder [C09, C10, J04, R03].

    The folder has a manifest with the source's fingerprint and the layout. When
    either changes all stages are wiped, and a stage whose settings change is
    wiped alone. A folder without the manifest is never written or deleted
    unless it is empty or new.
    """

    def __init__(self, spark: SparkSession, root: str, source: str):
        self.spark, self.root = spark, root.rstrip("/")
        if self.root in {"", "."} or self.root.endswith((":", ":/", "://")):
            raise OptionError("stages need a folder of their own")
        if self._exists(".git"):
            raise OptionError("a repository cannot hold stages")
        said = self._read()
        if said is None and self._names():
            raise OptionError(f"{self.root} is not empty and has no manifest of stages")
        now = {"marker": "quireflow", "source": source, "schema": SCHEMA}
        if said is not None and said != now:
            for name in self._names():
                self._delete(name)
        self._write(now)

    def _fs(self, name: str = ""):  # noqa: ANN202
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def _exists(self, name: str) -> bool:
        fs, path = self._fs(name)
        return fs.exists(path)

    def _names(self) -> list[str]:
        fs, path = self._fs()
        return [x.getPath().getName() for x in fs.listStatus(path)] if fs.exists(path) else []

    def _delete(self, name: str) -> None:
        fs, path = self._fs(name)
        fs.delete(path, True)

    def _read(self) -> dict | None:
        if not self._exists(_MANIFEST):
            return None
        text = "\n".join(r.value for r in self.spark.read.text(f"{self.root}/{_MANIFEST}").limit(100).collect())
        try:
            return json.loads(text)
        except ValueError:
            return {}

    def _write(self, manifest: dict) -> None:
        fs, path = self._fs(_MANIFEST)
        out = fs.create(path, True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()

    def contains(self, path: str) -> bool:
        """Whether a path lies inside, where an output would be wiped with the stages [C10]."""
        return f"{path.rstrip('/')}/".startswith(f"{self.root}/")

    def stage(self, name: str, settings: dict[str, object], pages: DataFrame, compute: Callable[[DataFrame], DataFrame], force: bool = False) -> DataFrame:
        """The stage's table, with ``compute(missing pages)`` appended for the pages it lacks; other settings, or ``force``, wipe it first."""
        key = f"stage={name}/hash={settings_key(settings)}"
        for old in [n for n in self._names() if n == f"stage={name}"]:
            fs, path = self._fs(old)
            for x in fs.listStatus(path):
                if force or x.getPath().getName() != key.split("/")[1]:
                    fs.delete(x.getPath(), True)
        path = f"{self.root}/{key}"
        done = self._exists(key)
        todo = pages.join(self.spark.read.parquet(path).select("book_id", "page_no").distinct(), ["book_id", "page_no"], "left_anti") if done else pages
        compute(todo).where(F.col("book_id").isNotNull()).write.mode("append").parquet(path)
        return self.spark.read.parquet(path)

    def cleanup(self) -> None:
        """Deletes the folder, if its manifest says that it is one of stages."""
        if (self._read() or {}).get("marker") != "quireflow":
            raise OptionError(f"{self.root} is not a folder of stages")
        self._delete("")


def kept_stage(root: str, name: str, settings: dict[str, object], pages: DataFrame, compute) -> DataFrame:  # noqa: ANN001
    """The stage table ``root/stage=name/hash=...``, with ``compute(missing pages)`` appended for pages it lacks [J04, R03]."""
    spark = pages.sparkSession
    if root.rstrip("/") in {"", "/"}:
        raise OptionError("a stage needs a folder of its own")
    path = f"{root}/stage={name}/hash={settings_key(settings)}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    there = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)
    todo = pages.join(spark.read.parquet(path).select("book_id", "page_no").distinct(), ["book_id", "page_no"], "left_anti") if there else pages
    new = compute(todo)
    new.where(F.col("book_id").isNotNull()).write.mode("append").parquet(path)
    return spark.read.parquet(path)
