"""What the operators of this subpackage share: table access, shared storage, folds, ASCII case folding."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from pathlib import Path
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: words are what stands between these.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    _importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _importable(spark: SparkSession) -> None:
    """Local workers find this package wherever the driver was started; a cluster has it installed."""
    here, env = str(Path(__file__).parents[2]), spark.sparkContext.environment
    if here not in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(":"):
        env["PYTHONPATH"] = ":".join(filter(None, [here, env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))]))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, as the session names it; in local mode a local one if none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"


#: Folders written inside open ``scratch`` blocks.
_scratch: list[list[DataFrame]] = []


def save(df: DataFrame, name: str, compression: str = "snappy", keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives a lost executor."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    if _scratch and not keep:
        _scratch[-1].append(out)
    return out


def drop_saved(df: DataFrame) -> None:
    """Delete a table made by ``save`` that nothing needs any longer."""
    spark = df.sparkSession
    files = df.inputFiles()
    if files:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(files[0].rsplit("/", 1)[0])
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch():
    """What is saved inside, and not to be kept, is deleted at the end: for results that have been written themselves."""
    _scratch.append([])
    try:
        yield
    finally:
        for df in _scratch.pop():
            drop_saved(df)


@contextmanager
def collected():
    """The list of what is saved inside: whoever opens this deletes it when it is no longer needed."""
    saved: list[DataFrame] = []
    _scratch.append(saved)
    try:
        yield saved
    finally:
        _scratch.pop()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(col, ascii_uppercase, ascii_lowercase)


def plain_words(col: Column) -> Column:
    """The words of a lower-cased text: runs of letters, digits and all characters beyond ASCII; null gives none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(col.cast("string"), F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def gram_hashes(words: Column, k: int) -> Column:
    """The hash of each run of k neighbouring words, in order; none if there are fewer words.

    ``words`` must be a plain column: an expression would be evaluated anew for each run.
    """
    starts = F.when(F.size(words) >= k, F.sequence(F.lit(0), F.size(words) - k)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)]))


def gram_texts(words: Column, k: int) -> Column:
    """The runs of k neighbouring words themselves, joined by a space."""
    starts = F.when(F.size(words) >= k, F.sequence(F.lit(1), F.size(words) - k + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, k), " "))


def fold(id_col: str | Column, buckets: int) -> Column:
    """crc32 of the id as text, modulo ``buckets``; null ids fall in fold 0."""
    col = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % buckets, F.lit(0)).cast("int")


def sample_key(id_col: str) -> Column:
    """A number in [0, 1) fixed by the id alone, for repeatable bounded samples."""
    return F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 24)) / F.lit(float(1 << 24))


class Cache(dict):
    """Remembers values of strings, up to about ``limit`` bytes; then everything is forgotten.

    The room a pair takes is reckoned from its lengths: two objects and their place in the table.
    """

    def __init__(self, limit: int):
        self.limit, self.used = limit, 0

    def make_room(self) -> None:
        if self.used > self.limit:
            self.clear()
            self.used = 0

    def add(self, keys: list[str], values) -> None:
        for key, value in zip(keys, values, strict=True):
            self[key] = value
            self.used += 200 + len(key) + len(value)


_held: list = []


def worker_cache(owner: tuple, make: Callable[[], Cache]) -> Cache:
    """The cache of ``owner`` in this Python worker.  A worker holds one at a time: another owner's is dropped, so what one
    stage remembers takes no memory in the next one."""
    if not _held or _held[0] != owner:
        _held[:] = [owner, make()]
    return _held[1]
