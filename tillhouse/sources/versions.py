"""Versions of a warehouse: every run writes a new set of tables, and one step shows it to readers.

A run writes into a folder of its own under ``data``. Readers see none of it until the run
publishes: a log entry, complete before it gets its name, lists the folders of every table.
The last entry is the warehouse; a reader that opened an earlier one keeps reading that. A
run that dies leaves a folder nobody reads, which :func:`prune` deletes later.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tillhouse.operators.contracts import ContractError, conform
from tillhouse.schemas import TABLES
from tillhouse.sources.tables import CODEC, Ranged, laid_out, release, table_path

LOG, DATA = "_versions", "data"
# A run may take so long: folders without a log entry are left alone for that time.
MIN_AGE_HOURS = 48
# Folders of one table beyond which an append writes the table anew.
MOST_FOLDERS = 16


class ConflictError(RuntimeError):
    """Another run published while this one was at work."""


@dataclass(frozen=True)
class Version:
    """A published set of tables: its number and the folders of each table, relative to the root."""

    number: int
    tables: Mapping[str, Sequence[str]]


def _files(spark: SparkSession, path: str):
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(context._jsc.hadoopConfiguration()), path


def _names(spark: SparkSession, folder: str) -> list[str]:
    files, path = _files(spark, folder)
    return [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []


def _numbers(spark: SparkSession, root: str) -> list[int]:
    """Numbers of all published versions, in order."""
    names = _names(spark, f"{root}/{LOG}")
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())


def _entry(root: str, number: int) -> str:
    return f"{root}/{LOG}/{number:012d}.json"


def version(spark: SparkSession, root: str, number: int | None = None) -> Version | None:
    """The last published version, or that of a number; None if there is none."""
    root = root.rstrip("/")
    numbers = _numbers(spark, root)
    number = (numbers[-1] if numbers else None) if number is None else number
    if number not in numbers:
        return None
    files, path = _files(spark, _entry(root, number))
    stream = files.open(path)
    try:
        text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Version(number, json.loads(text))


class StoredTables(Mapping[str, DataFrame]):
    """The tables of one version, opened when asked for; later versions do not change them.

    They are listed as the declared tables; what else a version has is opened by its name.
    """

    def __init__(self, spark: SparkSession, root: str, tables: Mapping[str, Sequence[str]]) -> None:
        self._spark, self._root, self.folders = spark, root.rstrip("/"), dict(tables)

    def paths(self, name: str) -> list[str]:
        if name not in self.folders:
            raise KeyError(name)
        return [f"{self._root}/{folder}" for folder in self.folders[name]]

    def __getitem__(self, name: str) -> DataFrame:
        reader = self._spark.read.schema(TABLES[name].schema) if name in TABLES else self._spark.read
        return reader.parquet(*self.paths(name))

    def __iter__(self) -> Iterator[str]:
        return iter(TABLES)

    def __len__(self) -> int:
        return len(TABLES)


def stored_tables(spark: SparkSession, root: str, number: int | None = None) -> StoredTables:
    """The tables as last published, or as of a version."""
    found = version(spark, root, number)
    if found is None:
        raise FileNotFoundError(f"no version {'' if number is None else number} of a warehouse under {root}")
    return StoredTables(spark, root, found.tables)


@dataclass
class Run:
    """A version in the making. Tables it does not write stay those of the version before."""

    spark: SparkSession
    root: str
    before: Version | None
    name: str = field(default_factory=lambda: uuid.uuid4().hex)
    written: dict[str, list[str]] = field(default_factory=dict)

    @property
    def folder(self) -> str:
        return f"{self.root}/{DATA}/{self.name}"

    @property
    def tables(self) -> StoredTables:
        """What readers would see if this run were published now."""
        return StoredTables(self.spark, self.root, dict(self.before.tables if self.before else {}) | self.written)

    def full(self, name: str) -> bool:
        """Whether a table has so many folders that an append writes it anew."""
        return name not in self.written and len(self.tables.folders.get(name, [])) >= MOST_FOLDERS

    def append(self, rows: DataFrame, name: str) -> int:
        """Add rows to a table as it is so far, in a folder of their own.

        A table of the version before in too many folders is written anew as a whole.
        """
        if self.full(name):
            return self.write(self.tables[name].unionByName(rows), name)
        before = self.tables.folders.get(name, [])
        added = self.write(rows, name)
        self.written[name] = [*before, *self.written[name]]
        return added

    def last(self, name: str) -> DataFrame:
        """What was added to a table last."""
        return StoredTables(self.spark, self.root, {name: self.tables.folders[name][-1:]})[name]

    def write(self, rows: DataFrame | Ranged, name: str) -> int:
        """Write a table of this version, check it in the same pass, and return its rows.

        A declared table gets its columns, types and layout; nulls in its required columns
        are counted while it is written and stop the run.
        """
        counts = Observation()
        nulls: dict[str, F.Column] = {}
        ranged = isinstance(rows, Ranged)
        rows = rows.rows if ranged else rows
        if name in TABLES:
            table = TABLES[name]
            rows = laid_out(conform(rows, table, strict=False), table, ranged)
            nulls = {c: F.count_if(F.col(c).isNull()).alias(f"null {c}") for c in table.required}
        # On top of the plan: these are the rows of the tasks that write, each counted once.
        rows = rows.observe(counts, F.count(F.lit(1)).alias("rows"), *nulls.values())
        # A table that this run has written already gets a further folder.
        folder = f"{name}.{len(self.written[name])}" if name in self.written else name
        rows.write.mode("errorifexists").option("compression", CODEC).parquet(table_path(self.folder, folder))
        seen = counts.get
        broken = {c: seen[f"null {c}"] for c in nulls if seen[f"null {c}"]}
        if broken:
            raise ContractError("; ".join(f"{n} nulls in {name}.{c}" for c, n in broken.items()))
        self.written[name] = [f"{DATA}/{self.name}/{folder}"]
        return seen["rows"]

    def publish(self) -> Version:
        """Show this version to readers, at once and as a whole."""
        number = self.before.number + 1 if self.before else 1
        files, path = _files(self.spark, _entry(self.root, number))
        made = Version(number, self.tables.folders)
        _, part = _files(self.spark, f"{self.root}/{LOG}/.{self.name}")
        out = files.create(part, True)
        out.write(bytearray(json.dumps(made.tables, indent=1).encode()))
        out.close()
        # A name that exists is another run's; renaming onto it fails where files are shared.
        try:
            done = not files.exists(path) and files.rename(part, path)
        except Py4JJavaError as error:
            files.delete(part, False)
            raise ConflictError(f"version {number} of {self.root} could not be published") from error
        if not done:
            files.delete(part, False)
            raise ConflictError(f"version {number} of {self.root} is published already")
        return made

    def discard(self) -> None:
        release(self.spark, self.folder)


@contextmanager
def new_version(spark: SparkSession, root: str) -> Iterator[Run]:
    """A run that is published if the block ends well and leaves nothing if it fails."""
    root = root.rstrip("/")
    run = Run(spark, root, version(spark, root))
    try:
        yield run
        run.publish()
    except BaseException:
        run.discard()
        raise


def prune(spark: SparkSession, root: str, keep: int = 2, min_age_hours: float = MIN_AGE_HOURS) -> list[str]:
    """Delete all but the last ``keep`` versions and what no kept version uses; returns the deleted folders.

    Folders of runs that are not published are deleted once they are old enough to be dead.
    """
    root = root.rstrip("/")
    numbers = _numbers(spark, root)
    known = {n: version(spark, root, n) for n in numbers}
    kept = numbers[-max(1, keep):]

    def runs(which: Iterable[int]) -> set[str]:
        return {folder.split("/")[1] for n in which for folders in known[n].tables.values() for folder in folders}

    files, path = _files(spark, f"{root}/{DATA}")
    now = spark.sparkContext._jvm.System.currentTimeMillis()
    gone = []
    for status in files.listStatus(path) if files.exists(path) else []:
        name = status.getPath().getName()
        dead = name in runs(numbers) or now - status.getModificationTime() > min_age_hours * 3_600_000
        if dead and name not in runs(kept):
            gone.append(f"{root}/{DATA}/{name}")
    # Entries first: no reader may find one whose tables are gone.
    release(spark, *[_entry(root, n) for n in numbers if n not in kept], *gone)
    return gone
