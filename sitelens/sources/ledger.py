"""Job ledgers and run reports stored as JSON documents."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.plans.report import REPORT_DDL
from sitelens.sources.files import file_path, listed_by_cores, plain_path

JOB_DDL = (
    "job_id string, status string, preset string, target_url string, client_ip string, "
    "created_at timestamp, started_at timestamp, finished_at timestamp, "
    "worker_alive boolean, output_dir string"
)


def _documents(spark: SparkSession, pattern: str, ddl: str) -> DataFrame:
    """path, text and doc (the fields of ``ddl``) of every file; doc is null where the
    text is no JSON object. A field of another type than expected is null."""
    try:
        # One look at the folders: a check beforehand would visit each of them once more.
        with listed_by_cores(spark):
            files = spark.read.text(pattern, wholetext=True)
        files = files.select(file_path().alias("path"), F.col("value").alias("text"))
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        files = spark.createDataFrame([], "path string, text string")
    kind = F.schema_of_variant(F.try_parse_json("text"))
    doc = F.from_json("text", ddl, {"mode": "PERMISSIVE", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]"})
    return files.select("path", "text", F.when(kind.startswith("OBJECT"), doc).alias("doc"))


def scan_jobs(spark: SparkSession, root: str, files: str = "*/job.json") -> DataFrame:
    """Every file under ``root`` as a row: path, the ledger fields, and ``problem`` with
    ``text`` for files that are no job entry. A field of another type is null; Spark
    passes over files without a byte."""
    found = _documents(spark, f"{root}/{files}", JOB_DDL)
    problem = F.when(F.col("doc").isNull(), "not a JSON object").when(
        F.col("doc.job_id").isNull(), "no job_id"
    )
    checked = found.withColumn("problem", problem)
    return checked.select(
        "path", "doc.*", "problem", F.when(F.col("problem").isNotNull(), F.col("text")).alias("text")
    ).withColumn("output_dir", plain_path(F.col("output_dir")))


def read_jobs(spark: SparkSession, root: str) -> DataFrame:
    """The job entries; what else lies there is skipped."""
    return scan_jobs(spark, root).filter(F.col("problem").isNull()).drop("path", "problem", "text")


def quarantined_jobs(spark: SparkSession, root: str) -> DataFrame:
    """path, problem and text of the files that are no job entry."""
    return scan_jobs(spark, root).filter(F.col("problem").isNotNull()).select("path", "problem", "text")


def read_reports(spark: SparkSession, root: str) -> DataFrame:
    """Every report under ``<root>/*/``, a run_report.json file or what ``write_report``
    writes in its place, keyed by its folder (``output_dir``); corrupt ones are dropped.

    Paths are plain, here and in the ledger, so that the two meet on any file system.
    """
    single = _documents(spark, f"{root}/*/run_report.json", REPORT_DDL)
    written = _documents(spark, f"{root}/*/report/run_report.json", REPORT_DDL)
    found = single.unionByName(written).filter(F.col("doc").isNotNull())
    folder = F.regexp_replace("path", r"(/report)?/run_report\.json(/[^/]*)?$", "")
    return found.select("doc.*", folder.alias("output_dir"))
