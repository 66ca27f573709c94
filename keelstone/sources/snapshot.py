"""Snapshots: state tables as Parquet with a manifest, and the checksum of the binary form.

A snapshot is a folder of its own with one Parquet table a type and, written last, a
`meta` table. A reader takes the latest folder that has one, so a save that broke off
is never read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keelstone.functions.expr import is_live


def save(tables: dict[str, DataFrame], path: str, saved_at_ms: int, now_ms: int | None = None) -> str:
    """Write the tables; rows whose expires_at_ms has passed by now_ms are left out."""
    folder = f"{path.rstrip('/')}/snapshot-{saved_at_ms}"
    spark = None
    for name, df in tables.items():
        spark = df.sparkSession
        if now_ms is not None and "expires_at_ms" in df.columns:
            df = df.filter(is_live(F.col("expires_at_ms"), now_ms))
        df.write.parquet(f"{folder}/{name}")
    if spark is not None:
        spark.createDataFrame([(saved_at_ms, sorted(tables))], "saved_at_ms bigint, tables array<string>").coalesce(1).write.parquet(f"{folder}/meta")
    return folder


def saves(spark: SparkSession, path: str) -> DataFrame:
    """(saved_at_ms, tables, folder) of the finished snapshots below a path."""
    return spark.read.parquet(f"{path.rstrip('/')}/snapshot-*/meta").withColumn("folder", F.regexp_replace(F.input_file_name(), "/meta/[^/]*$", ""))


def last_save(spark: SparkSession, path: str) -> int:
    return saves(spark, path).agg(F.max("saved_at_ms")).first()[0]


def load(spark: SparkSession, path: str, now_ms: int | None = None) -> dict[str, DataFrame]:
    r = saves(spark, path).orderBy(F.desc("saved_at_ms")).first()
    out = {}
    for name in r.tables:
        df = spark.read.parquet(f"{r.folder}/{name}")
        out[name] = df.filter(is_live(F.col("expires_at_ms"), now_ms)) if now_ms is not None and "expires_at_ms" in df.columns else df
    return out


def _crc64_table() -> list[int]:
    """Fixed value: the Jones polynomial, taken as it stands in the reflected form."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0xAD93D23594C935A9 if n & 1 else 0)
        out.append(n)
    return out


_CRC64 = _crc64_table()


def crc64(data: bytes, crc: int = 0) -> int:
    for b in data:
        crc = _CRC64[(crc ^ b) & 0xFF] ^ crc >> 8
    return crc


#: Fixed value of the binary form, which keelstone.sources.dump reads and writes.
MAGIC = b"REDIS0009"
