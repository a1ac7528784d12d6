"""Tables in versions: a run writes the next version beside the current one, then commits it in one step.

A versioned folder holds data folders and a log of commits, `0000000001.commit` and on, each one line: the data folder's
name. A commit is a file made only if none has its number (an exclusive create), so of two writers that began from
one version one commits and the other gets Conflict; readers take the last commit and never see half a version. A run
that fails before its commit changes nothing; what it left behind is removed by tidy().
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


class Conflict(RuntimeError):
    """Another writer has committed since the version that a run began from."""


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, spark.checkpoint.dir. Where that is unset, a session on one machine
    (tests) gets a local folder, and one on a cluster an error."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        import tempfile

        place = "file://" + tempfile.mkdtemp(prefix="lectern-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place.rstrip("/")


def kept(rows: DataFrame, name: str = "rows") -> DataFrame:
    """rows as a table written once in the shared folder: it cuts lineage, and later readers share the work."""
    spark = rows.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


class Files:
    """The few file operations of the driver, by Spark's own file systems."""

    def __init__(self, spark: SparkSession, folder: str):
        self.jvm, self.folder = spark.sparkContext._jvm, folder.rstrip("/")
        self.fs = self.path("").getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def names(self) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.path(""))) if self.fs.exists(self.path("")) else []

    def create(self, name: str, text: str) -> bool:
        """Whether the file could be made: not if there is one."""
        try:
            out = self.fs.create(self.path(name), False)
        except Exception as error:
            if "AlreadyExists" in str(error):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def text(self, name: str) -> str:
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def remove(self, name: str) -> None:
        self.fs.delete(self.path(name), True)


class Versioned:
    """The tables of a versioned folder; all of a version are committed together."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.files = spark, folder.rstrip("/"), Files(spark, folder)

    def number(self) -> int:
        """The last version's number, 0 if there is none."""
        return max((int(n.partition(".")[0]) for n in self.files.names() if n.endswith(".commit")), default=0)

    def place(self, number: int | None = None) -> str | None:
        """The data folder of a version, the last one unless asked."""
        n = self.number() if number is None else number
        return f"{self.folder}/{self.files.text(f'{n:010}.commit').strip()}" if n else None

    def read(self, name: str = "rows", number: int | None = None) -> DataFrame | None:
        place = self.place(number)
        return self.spark.read.parquet(f"{place}/{name}") if place else None

    def stage(self) -> str:
        """A new data folder, which no reader sees."""
        return f"data-{uuid.uuid4().hex}"

    def commit(self, staged: str, after: int) -> int:
        """Make the staged folder the version that follows `after`."""
        if self.number() != after or not self.files.create(f"{after + 1:010}.commit", staged):
            raise Conflict(f"version {after + 1} of {self.folder} is another run's")
        return after + 1

    def write(self, **tables: DataFrame) -> int:
        """The next version, of these tables."""
        after, staged = self.number(), self.stage()
        for name, rows in tables.items():
            rows.write.parquet(f"{self.folder}/{staged}/{name}")
        return self.commit(staged, after)

    def tidy(self, keep: int = 2) -> list[str]:
        """Remove data of all but the last `keep` versions, and what failed runs left; for times when no run writes."""
        last = self.number()
        live = {self.files.text(f"{n:010}.commit").strip() for n in range(max(1, last - keep + 1), last + 1)}
        gone = [n for n in self.files.names() if n.startswith("data-") and n not in live]
        for name in gone:
            self.files.remove(name)
        return gone
