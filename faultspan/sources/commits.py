"""Tables whose contents change by commits: files are staged first and count once a commit lists them.

A commit is one small JSON file `_commits/<number>.json` with a batch id, the folders that it adds (by table), those that it
takes away, and notes. It is written under another name and renamed to a number that is free, so that it is there whole or
not at all; where a rename fails if its target is there, as on HDFS, two writers never share a number, and elsewhere (local
disks, object stores) one writer at a time is needed. A batch that broke off has staged folders that no commit names: readers
don't see them. A batch id that was committed before is not committed again, so a repeated batch changes nothing.

Readers fold the commits in order; every SNAPSHOT-th holds the whole state, so they read few files. Only names of folders
and notes pass through the driver.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

#: So many commits apart a commit holds the whole state.
SNAPSHOT = 50


@dataclass
class Folder:
    """A listed folder: its path below the root, the number of the commit that added it, and what its writer noted."""

    table: str
    path: str
    since: int
    notes: dict = field(default_factory=dict)


@dataclass
class State:
    """What is listed now; version is the number of the last commit, 0 if there is none."""

    version: int = 0
    batches: set[str] = field(default_factory=set)
    folders: list[Folder] = field(default_factory=list)

    def of(self, table: str) -> list[Folder]:
        return [f for f in self.folders if f.table == table]


class Conflict(RuntimeError):
    """Another writer changed what this commit was worked out from."""


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _read(spark: SparkSession, path: str) -> str:
    p, fs = _fs(spark, path)
    stream = fs.open(p)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def _write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a file that isn't there yet, whole or not at all; false if it is there."""
    target, fs = _fs(spark, path)
    if fs.exists(target):
        return False
    own, _ = _fs(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    stream = fs.create(own, False)
    stream.write(text.encode())
    stream.close()
    if not fs.rename(own, target):
        fs.delete(own, False)
        return False
    return True


def _numbers(spark: SparkSession, root: str) -> list[int]:
    p, fs = _fs(spark, f"{root}/_commits")
    if not fs.exists(p):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and not n.startswith("."))


def is_committed(spark: SparkSession, root: str) -> bool:
    """Whether a folder is such a table."""
    p, fs = _fs(spark, f"{root}/_commits")
    return bool(fs.exists(p))


def state(spark: SparkSession, root: str) -> State:
    numbers, out = _numbers(spark, root), State()
    whole = [n for n in numbers if n % SNAPSHOT == 0]
    for n in [m for m in numbers if not whole or m >= whole[-1]]:
        c = json.loads(_read(spark, f"{root}/_commits/{n:010d}.json"))
        if "whole" in c:
            out = State(n, set(c["batches"]), [Folder(**f) for f in c["whole"]])
        else:
            _apply(out, n, c)
    return out


def _apply(s: State, n: int, c: dict) -> None:
    gone = set(c["remove"])
    s.folders = [f for f in s.folders if f.path not in gone] + [Folder(f["table"], f["path"], n, f["notes"]) for f in c["add"]]
    s.batches.add(c["batch"])
    s.version = n


def stage(df: DataFrame, root: str, by: list[str] | None = None) -> str:
    """Write rows to a folder of their own below the root, which nobody reads until it is committed; the folder's path below the root."""
    path = f"data/{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(f"{root}/{path}")
    return path


def commit(spark: SparkSession, root: str, batch: str, add: list[tuple[str, str, dict]] | None = None, remove: list[str] | None = None, upon: int | None = None) -> bool:
    """List (table, folder, notes) and take folders away, all at once; false if the batch was committed before.

    A folder to take away that is no longer listed is a Conflict: what the batch worked out from it no longer holds; so is
    another version than the one that it builds upon, if that is given.
    """
    delta = {"batch": batch, "add": [{"table": t, "path": p, "notes": n} for t, p, n in add or []], "remove": list(remove or [])}
    while True:
        now = state(spark, root)
        if batch in now.batches:
            return False
        if missing := set(delta["remove"]) - {f.path for f in now.folders}:
            raise Conflict(f"no longer listed: {sorted(missing)[:3]}")
        if upon is not None and now.version != upon:
            raise Conflict(f"built upon version {upon}, but {now.version} is there")
        n, said = now.version + 1, delta
        if n % SNAPSHOT == 0:
            _apply(now, n, delta)
            said = {"whole": [f.__dict__ for f in now.folders], "batches": sorted(now.batches)}
        if _write_new(spark, f"{root}/_commits/{n:010d}.json", json.dumps(said)):
            return True


def subfolders(spark: SparkSession, root: str, path: str) -> list[str]:
    """Names of the folders right below a staged one."""
    p, fs = _fs(spark, f"{root}/{path}")
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def read(spark: SparkSession, root: str, folders: list[Folder], schema) -> DataFrame:
    """The rows of listed folders."""
    return spark.read.schema(schema).parquet(*(f"{root}/{f.path}" for f in folders)) if folders else spark.createDataFrame([], schema)


def vacuum(spark: SparkSession, root: str) -> int:
    """Delete staged folders that the present state doesn't list; only while nobody reads an older state or stages a batch."""
    listed = {f.path.split("/")[1] for f in state(spark, root).folders}
    p, fs = _fs(spark, f"{root}/data")
    old = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName() not in listed] if fs.exists(p) else []
    for x in old:
        fs.delete(x, True)
    return len(old)
