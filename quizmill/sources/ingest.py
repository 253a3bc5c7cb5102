"""Bank files and tables: reading, gating, cleaning, and JSON at the border."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from quizmill.schemas import OPTION, PARTITIONED, schema

MAX_FILE, EXTENSIONS, SCANNED_CHARS = 20 * 1024 * 1024, ("docx", "pdf", "txt"), 30
SCANNED_HINT = "这个文件像是扫描件，没有可以读取的文字"


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))


def normal_text(c: Column) -> Column:
    """Without a byte-order mark, line ends as \\n."""
    return F.regexp_replace(F.regexp_replace(c, "^﻿", ""), "\r\n|\r", "\n")


def decode_texts(files: DataFrame) -> DataFrame:
    """``files`` (path, content) with ``ext``, ``size`` and ``text``: strict UTF-8, else GBK; null content is empty.

    GBK needs a legacy flag of the session while the expression is made; the flag is put back.
    """
    conf, flag = files.sparkSession.conf, "spark.sql.legacy.javaCharsets"
    before = conf.get(flag, "false")
    content = F.coalesce("content", F.lit(b""))
    raw = content.cast("string")
    conf.set(flag, "true")
    try:
        return files.select("path", extension(F.col("path")).alias("ext"), F.length(content).cast("long").alias("size"), content.alias("content"), normal_text(F.when(F.is_valid_utf8(raw), raw).otherwise(F.decode(content, "GBK"))).alias("text"))
    finally:
        conf.set(flag, before)


def read_bank_texts(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """(path, ext, size, content, text) of the files that a folder, file or pattern names, empty files too.

    ``recursive``: those of the folders inside as well.  As with Spark's own reader, files are listed by the driver; of the
    listing only the names of empty files are kept.  Names that begin with a dot or an underscore are passed over.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", recursive).load(path).select("path", "content")
    # Spark's reader passes over empty files, so their names come from the file system
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    empty = []
    for top in fs.globStatus(place) or []:
        inside, found = top.getPath().toString().rstrip("/"), fs.listFiles(top.getPath(), recursive)
        while found.hasNext():
            f = found.next()
            name = f.getPath().toString()
            below = name.removeprefix(inside).strip("/") or f.getPath().getName()
            if f.getLen() == 0 and not any(part[0] in "._" for part in below.split("/")):
                empty.append((name, b""))
    return decode_texts(files.unionByName(spark.createDataFrame(empty, "path string, content binary")) if empty else files)


def gate_uploads(files: DataFrame) -> DataFrame:
    """``reject_code`` of (file_name, size): empty 40001, extension 40002, over 20 MB 40003."""
    size = F.coalesce("size", F.lit(0))
    code = F.when(size <= 0, 40001).when(~F.coalesce(extension(F.col("file_name")).isin(*EXTENSIONS), F.lit(False)), 40002).when(size > MAX_FILE, 40003)
    return files.withColumn("reject_code", code)


def normalize_extracted_text(df: DataFrame) -> DataFrame:
    """S3: extracted text (ext, text): tabs of Word tables become line ends, then as S1."""
    t = F.when(F.col("ext") == "docx", F.translate("text", "\t", "\n")).otherwise(F.col("text"))
    return df.withColumn("text", normal_text(t))


def flag_scanned(df: DataFrame) -> DataFrame:
    """Files (pages, text) with fewer than 30 characters a page, and a hint for the user."""
    scanned = F.coalesce((F.col("pages") > 0) & (F.expr("length(coalesce(text, '')) div pages") < SCANNED_CHARS), F.lit(False))
    return df.withColumn("scanned", scanned).withColumn("hint", F.when(scanned, SCANNED_HINT))


def parse_options(c: Column) -> Column:
    """Options from JSON; null if it cannot be read."""
    return F.from_json(c, f"array<{OPTION}>")


def parse_string_list(c: Column, empty: bool = False) -> Column:
    """Strings from JSON; what cannot be read is null, or an empty array."""
    got = F.from_json(c, "array<string>")
    return F.coalesce(got, F.array().cast("array<string>")) if empty else got


def write_table(df: DataFrame, base: str, name: str, mode: str = "overwrite") -> None:
    """A table as Parquet with its declared columns; large ones in partitions by bank."""
    out = df.select(*[F.col(f.name).cast(f.dataType) for f in schema(name) if f.name in df.columns])
    if name in PARTITIONED:
        out.repartition(PARTITIONED[name]).write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(PARTITIONED[name]).parquet(f"{base}/{name}")
    else:
        out.write.mode(mode).parquet(f"{base}/{name}")


def read_table(spark: SparkSession, base: str, name: str) -> DataFrame:
    """A table as it was declared; columns that the files lack are null."""
    return spark.read.schema(schema(name)).parquet(f"{base}/{name}")


#: With this setting a join on several columns uses buckets by some of them.
CO_PARTITIONED = {"spark.sql.requireAllClusterKeysForCoPartition": "false"}


def write_bucketed(df: DataFrame, path: str, by: list[str], buckets: int | None = None) -> DataFrame:
    """A table in buckets by ``by``, sorted inside, under ``path`` and in the session's catalog: joins and groups on these
    columns read it without an exchange.  ``buckets``: as many as shuffles have partitions, if not given."""
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"bucketed_{uuid.uuid4().hex}"
    df.repartition(n, *by).write.bucketBy(n, *by).sortBy(*by).option("path", path).format("parquet").saveAsTable(name)
    return spark.table(name)


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]):
    """Settings of the session for a while; afterwards they are as before."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def dedup_files(files: DataFrame) -> DataFrame:
    """Of files with equal content the one with the smallest path."""
    marked = files.withColumn("_h", F.md5("content"))
    first = marked.select("path", "_h", F.row_number().over(W.Window.partitionBy("_h").orderBy("path")).alias("_k")).where("_k = 1").select("path")
    return files.join(first, "path", "left_semi")



def work_dir(spark: SparkSession) -> str:
    """The folder shared by driver and executors that ``spark.checkpoint.dir`` names; a local one in local mode only."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"file:///tmp/checkpoints/{spark.sparkContext.applicationId}"
