"""Compaction of a folder of parquet files in place, by packing small files into bins.

Only files under a bound are read; larger ones keep their names and contents. A bin is
one task that reads its files and writes one, so nothing is shuffled, the rows of a
file stay together in their order, and as files are taken in the order of their paths,
neighbours meet in a bin and row-group statistics stay about as tight as they were.

New files are written to a staging folder that readers skip, then a journal names every
rename and delete, then these are done. A run that dies before the journal changes
nothing; after it, `finish` (also called by the next run) does what is left.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

STAGING = "_compaction-"
JOURNAL = "journal.json"
#: Bins whose jobs run at the same time; each job is one task.
BINS_AT_ONCE = 64


@dataclass
class Bin:
    folder: str
    size: int = 0
    files: list[str] = field(default_factory=list)


def first_fit(sizes: Iterable[tuple[str, int]], capacity: int, open_bins: int = 16) -> list[Bin]:
    """Files of one folder in bins of at most `capacity` bytes, each in the first that has room.

    Files are taken in the order given. At most `open_bins` bins may still take a file,
    the fullest is closed when another is needed: so the work is linear in the files and
    a bin's files lie near each other.
    """
    done: list[Bin] = []
    room: list[Bin] = []
    for path, size in sizes:
        fits = next((b for b in room if b.size + size <= capacity), None)
        if fits is None:
            if len(room) >= open_bins:
                full = max(room, key=lambda b: b.size)
                room.remove(full)
                done.append(full)
            fits = Bin(path.rsplit("/", 1)[0])
            room.append(fits)
        fits.files.append(path)
        fits.size += size
    return done + room


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def data_files(spark: SparkSession, path: str) -> list[tuple[str, int]]:
    """Path and bytes of every data file below a folder, by path. Hidden files and folders are left out."""
    fs, root = _fs(spark, path)
    base = fs.getFileStatus(root).getPath().toString()
    out = []
    files = fs.listFiles(root, True)
    while files.hasNext():
        status = files.next()
        name = status.getPath().toString()
        if not any(part[:1] in ("_", ".") for part in name[len(base) :].strip("/").split("/")):
            out.append((name, status.getLen()))
    return sorted(out)


def plan_bins(files: Sequence[tuple[str, int]], target_bytes: int, small_bytes: int | None = None, min_input_files: int = 2) -> list[Bin]:
    """Bins of files to be merged: small ones, at least so many of them, folder by folder."""
    bound = target_bytes * 3 // 4 if small_bytes is None else small_bytes
    folders: dict[str, list[tuple[str, int]]] = {}
    for name, size in files:
        if size < bound:
            folders.setdefault(name.rsplit("/", 1)[0], []).append((name, size))
    bins = [b for some in folders.values() for b in first_fit(some, target_bytes)]
    return [b for b in bins if len(b.files) >= max(2, min_input_files)]


def data_schema(spark: SparkSession, path: str) -> T.StructType:
    """Schema of the files below a folder without the columns that come from folder names."""
    fs, root = _fs(spark, path)
    base = fs.getFileStatus(root).getPath().toString()
    named = {part.split("=")[0] for name, _ in data_files(spark, path) for part in name[len(base) :].split("/")[:-1] if "=" in part}
    return T.StructType([f for f in spark.read.option("mergeSchema", "true").parquet(path).schema if f.name not in named])


def merged(spark: SparkSession, files: Sequence[str], schema: T.StructType) -> DataFrame:
    """Rows of a bin's files, in one partition."""
    return spark.read.schema(schema).parquet(*files).coalesce(1)


def bin_pack(
    spark: SparkSession, path: str, target_bytes: int = 256 * 1024 * 1024, small_bytes: int | None = None, min_input_files: int = 2,
) -> int:
    """Merges small files below a folder, partitioned or not, into files of up to `target_bytes`.

    Files of `small_bytes` (three quarters of the target) or more are not touched, nor
    bins of fewer than `min_input_files` files. Returns the number of files written.
    Readers that list the folder while files are renamed may see rows twice: run it
    where nobody reads, or behind a table format's commit.
    """
    finish(spark, path)
    bins = plan_bins(data_files(spark, path), target_bytes, small_bytes, min_input_files)
    if not bins:
        return 0
    schema = data_schema(spark, path)
    staging = f"{path.rstrip('/')}/{STAGING}{uuid.uuid4().hex}"

    def write(n: int) -> list[str]:
        merged(spark, bins[n].files, schema).write.parquet(f"{staging}/{n}")
        return [name for name, _ in data_files(spark, f"{staging}/{n}")]

    with ThreadPoolExecutor(BINS_AT_ONCE) as pool:
        written = list(pool.map(inheritable_thread_target(spark)(write), range(len(bins))))
    moves = [(name, f"{b.folder}/{name.rsplit('/', 1)[1]}") for b, names in zip(bins, written, strict=True) for name in names]
    gone = [f for b in bins for f in b.files]
    _write(spark, f"{staging}/{JOURNAL}", json.dumps({"moves": moves, "gone": gone}))
    finish(spark, path)
    return len(moves)


def finish(spark: SparkSession, path: str) -> None:
    """Does what journals below the folder name and is not done yet; staging without a journal is removed."""
    fs, root = _fs(spark, path)
    for status in fs.listStatus(root):
        folder = status.getPath()
        if not folder.getName().startswith(STAGING):
            continue
        todo = _read(spark, f"{folder.toString()}/{JOURNAL}")
        if todo is not None:
            steps = json.loads(todo)
            for old, new in steps["moves"]:
                source, target = (_fs(spark, x)[1] for x in (old, new))
                if fs.exists(source) and not fs.rename(source, target):
                    raise OSError(f"cannot rename {old} to {new}")
            for old in steps["gone"]:
                fs.delete(_fs(spark, old)[1], False)
        fs.delete(folder, True)


def _write(spark: SparkSession, path: str, text: str) -> None:
    """Written under another name first: the journal is there whole or not at all."""
    fs, p = _fs(spark, path)
    part = _fs(spark, f"{path}.part")[1]
    out = fs.create(part, True)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(part, p):
        raise OSError(f"cannot write {path}")


def _read(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    source = fs.open(p)
    try:
        return bytes(source.readAllBytes()).decode()
    finally:
        source.close()
