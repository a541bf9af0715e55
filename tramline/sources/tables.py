"""Tables as files: by pattern, as CSV with inferred types, reference lists, and folders that others own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tramline.sources.documents import read_text_csv


def read_pattern(spark: SparkSession, pattern: str, name: str = "site") -> DataFrame:
    """Parquet files that a glob names, with the stem of each row's file (after `=` where there is one)."""
    stem = F.regexp_extract(F.input_file_name(), r"([^/=]+)\.parquet", 1)
    return spark.read.parquet(pattern).withColumn(name, stem)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header (names may hold spaces) and types inferred."""
    return spark.read.csv(path, header=True, inferSchema=True, quote='"', escape='"')


def read_places(spark: SparkSession, path: str, code: str = "ATCOCode", prefix: str = "9100") -> DataFrame:
    """Rail access points of a national stop list: tpl (the code less its prefix), lon, lat, name, status."""
    columns = [code, "CommonName", "Longitude", "Latitude", "Status"]
    rows = read_text_csv(spark, path, columns).filter(F.col(code).startswith(prefix))
    number = lambda c: F.col(c).try_cast("double")
    out = rows.select(F.substring(code, len(prefix) + 1, 100).alias("tpl"), number("Longitude").alias("lon"), number("Latitude").alias("lat"), F.col("CommonName").alias("name"), F.lower("Status").alias("status"))
    return out.filter("lon is not null and lat is not null")


class Attached:
    """Tables of a folder that others own: read alone, and not those on the list of what must not be used."""

    def __init__(self, spark: SparkSession, folder: str, denied: set[str]):
        self.spark, self.folder, self.denied = spark, folder.rstrip("/"), denied

    def table(self, name: str) -> DataFrame:
        if name in self.denied:
            raise PermissionError(f"{name} is adjusted by its owner and must not be read here")
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def write(self, *_: object) -> None:
        raise PermissionError("an attached folder is read only")


def write_report(rows: DataFrame, path: str, kind: str = "csv", header: bool = True) -> None:
    """A small table as one CSV or JSON-lines file in a folder."""
    one = rows.coalesce(1).write.mode("overwrite")
    one.option("header", header).csv(path) if kind == "csv" else one.json(path)
