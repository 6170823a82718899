"""Files: paged dumps, documents with front matter, versioned tables and quarantine."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "status_code int, items array<struct<id:string,alt_id:string,title:string,author:string,duration_ms:long,width:int,height:int,media_sha256:string>>, cursor string, next_cursor string, has_more boolean, snapshot_id string, page_seq long"


def shared_folder(spark: SparkSession) -> str:
    """A new folder under the cluster's shared one; in local mode, as in tests, under a temporary one where none is set."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = "file://" + tempfile.mkdtemp(prefix="spark-")
    return f"{top.rstrip('/')}/loomfield-{uuid.uuid4().hex}"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Page objects of JSON files, one object or an array in each."""
    return spark.read.schema(PAGE).option("multiLine", True).json(path)


def classify_pages(pages: DataFrame) -> DataFrame:
    """Adds page_status (denied, invalid, ok); items that are no objects are dropped."""
    status = F.when(F.coalesce("status_code", F.lit(0)) != 0, "denied").when(F.col("items").isNull(), "invalid").otherwise("ok")
    return pages.withColumns({"page_status": status, "items": F.filter("items", lambda x: x.isNotNull())})


def page_items(pages: DataFrame) -> DataFrame:
    """snapshot_id, seq, pos, and the fields of each item of good pages."""
    rows = classify_pages(pages).where("page_status = 'ok'").select("snapshot_id", F.col("page_seq").alias("seq"), F.posexplode("items").alias("pos", "item"))
    return rows.select("snapshot_id", "seq", "pos", "item.*")


def split_front_matter(docs: DataFrame, col: str = "text") -> DataFrame:
    """Adds front (map of top-level keys, values as text), body and front_error (malformed)."""
    import yaml

    @F.pandas_udf("struct<front:map<string,string>,bad:boolean>")
    def parse(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def one(block: str) -> tuple[dict, bool]:
            try:
                got = yaml.safe_load(block) if block else {}
            except yaml.YAMLError:
                return {}, True
            return ({str(k): str(v) for k, v in got.items() if v is not None}, False) if isinstance(got, dict) else ({}, True)

        for batch in batches:
            yield pd.DataFrame([one(b) for b in batch], columns=["front", "bad"])

    whole = r"(?s)\A---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\z)"
    parsed = docs.withColumns({"_p": parse(F.regexp_extract(col, whole, 1)), "body": F.regexp_replace(col, whole, "")})
    return parsed.withColumns({"front": F.col("_p.front"), "front_error": F.when(F.col("_p.bad"), "malformed")}).drop("_p")


def entries_of(notes: DataFrame, skip: str = "_index") -> DataFrame:
    """category, folder, title, tags of notes (category, folder, text) with a title, a category and tags in their front matter."""
    front = split_front_matter(notes.where(F.col("category") != skip), "text")
    tags = F.transform(F.split(F.regexp_replace(F.col("front")["tags"], r"[\[\]'\"]", ""), ","), lambda t: F.trim(t))
    out = front.select("category", "folder", F.col("front")["title"].alias("title"), F.filter(tags, lambda t: t != "").alias("tags"), F.col("front")["category"].alias("own"))
    return out.where("title IS NOT NULL AND own IS NOT NULL AND size(tags) > 0").drop("own")


def discover_entries(spark: SparkSession, root: str, note: str = "note.md", skip: str = "_index") -> DataFrame:
    """``entries_of`` the category/folder/note files under a folder."""
    files = spark.read.text(f"{root}/*/*/{note}", wholetext=True).select(F.col("value").alias("text"), F.split("_metadata.file_path", "/").alias("parts"))
    placed = files.select("text", F.url_decode(F.element_at("parts", -3)).alias("category"), F.url_decode(F.element_at("parts", -2)).alias("folder"))
    return entries_of(placed, skip)


def _claim(spark: SparkSession, path: str, text: str) -> bool:
    """Create a file that is not there yet; False if it is. One of several writers succeeds.

    On a local disk the operating system decides; elsewhere the file system of the path,
    reached through the session's JVM as Python has no interface to it. A
    store whose create is not exclusive (as plain S3) needs one writer at a time.
    """
    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        os.makedirs(os.path.dirname(parts.path), exist_ok=True)
        try:
            with open(parts.path, "x") as file:
                file.write(text)
        except FileExistsError:
            return False
        return True
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    try:
        out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, False)
    except Exception as e:
        if "AlreadyExists" in str(e):
            return False
        raise
    out.write(bytearray(text.encode()))
    out.close()
    return True


def version_log(spark: SparkSession, path: str) -> DataFrame:
    """number, version of the committed versions of a table; a number whose writer stopped before it was done has none."""
    try:
        rows = spark.read.text(f"{path}/_log/*.version", wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "number long, version string")
    number = F.regexp_extract("_metadata.file_name", r"^([0-9]+)", 1).cast("long")
    return rows.select(number.alias("number"), F.regexp_extract("value", r"^([0-9a-f]{32})\.$", 1).alias("version")).where("version <> ''")


def write_version(df: DataFrame, path: str) -> int:
    """Write a table as a new version, then commit it under the next free number; the number.

    Rows are written to a folder of their own. A version counts once the file of its
    number is there, which is created without overwriting: of writers that
    want the same number one gets it and the others try the next, so any number of them may
    write at a time, and readers see whole versions only.
    """
    spark, version = df.sparkSession, uuid.uuid4().hex
    df.write.parquet(f"{path}/version={version}")
    number = (version_log(spark, path).agg(F.max("number")).first()[0] or 0) + 1
    while not _claim(spark, f"{path}/_log/{number:020d}.version", f"{version}."):
        number += 1
    return number


def read_version(spark: SparkSession, path: str, number: int | None = None) -> DataFrame:
    """The version that was committed last, or the one of a number."""
    log = version_log(spark, path)
    found = (log if number is None else log.where(F.col("number") == number)).orderBy(F.desc("number")).first()
    if found is None:
        raise FileNotFoundError(f"{path} has no such version")
    return spark.read.parquet(f"{path}/version={found['version']}")


def quarantine(df: DataFrame, code: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Good rows, and rejected ones as job_id, sha256, code; a digest is kept once for each job."""
    bad = df.where(F.col(code).isNotNull()).select("job_id", F.sha2(text, 256).alias("sha256"), F.col(code).alias("code"))
    return df.where(F.col(code).isNull()).drop(code), bad.groupBy("job_id", "sha256").agg(F.min("code").alias("code"))


def export_entries(entries: DataFrame, path: str) -> None:
    """Entry rows as files of their category."""
    entries.write.mode("overwrite").partitionBy("category").json(path)
