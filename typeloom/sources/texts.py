"""Texts in and out: whole files, tables, and nested reports."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from typeloom.operators import engine
from typeloom.plans.styles import Style


def read_files(spark: SparkSession, *paths: str) -> DataFrame:
    """file, text: each file whole, UTF-8, never split by line."""
    return spark.read.text(list(paths), wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("text"))


def from_values(spark: SparkSession, values: list[str], label: str = "<stdin>") -> DataFrame:
    """file, text of texts at hand."""
    return spark.createDataFrame([(label, v) for v in values], "file string, text string")


def read_table(spark: SparkSession, path: str, format: str = "parquet", text: str = "text", **options: str) -> DataFrame:
    """Any table with a text column, of any format that Spark reads; other columns ride along."""
    df = spark.read.format(format).options(**options).load(path)
    return df if text == "text" else df.withColumnRenamed(text, "text")


def dealt(df: DataFrame) -> DataFrame:
    """`df`; where it comes in fewer parts than there are cores (a small file is a single part), dealt to all of them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def write_fixed(df: DataFrame, style: Style, out: str, format: str = "parquet", mode: str = "errorifexists") -> None:
    """Fixed texts with the style's id beside them; only rows that fixing changes."""
    fixed = engine.changed(df, style).where("changed").drop("text", "changed").withColumnRenamed("fixed", "text")
    fixed.withColumn("style", F.lit(style.id)).write.mode(mode).format(format).save(out)


def write_findings(df: DataFrame, style: Style, out: str, format: str = "parquet", mode: str = "errorifexists") -> None:
    engine.check(df, style).write.mode(mode).format(format).save(out)


def write_report(df: DataFrame, style: Style, file: str, out: str, mode: str = "errorifexists") -> None:
    """Nested findings, a JSON object per text."""
    engine.report(df, style, file).write.mode(mode).json(out)


def rewrite(path: str, text: str) -> None:
    """Write a fixed text back to its file on this machine, byte for byte."""
    Path(path).write_bytes(text.encode())


def report_lines(findings: DataFrame, label: str = "file") -> DataFrame:
    """One `line` per finding: place, mark, rule and summary, then excerpt and source on lines of their own."""
    mark = F.rpad(F.when(F.col("fixable"), F.lit("fixable")).otherwise(F.col("severity")), 7, " ")
    head = F.concat(F.col(label), F.lit(":"), F.col("line"), F.lit(":"), F.col("column"), F.lit("  "), mark, F.lit(" "), F.col("rule"), F.lit("  "), F.col("summary"))
    return findings.select("*", F.concat_ws("\n      ", head, F.col("excerpt"), F.col("cite")).alias("said"))
