"""Snapshots and exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX_VERSION = 1  # fixed value


def save_index(chunks: DataFrame, path: str, workspace: Column | None = None) -> None:
    """Write chunks, vectors and parameters, replacing only the workspaces at hand."""
    if workspace is not None:
        chunks = chunks.withColumn("workspace", workspace)
    (
        chunks.withColumn("version", F.lit(INDEX_VERSION)).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("workspace").parquet(path)
    )


def load_index(spark: SparkSession, path: str, workspace: str | None = None) -> DataFrame:
    """Read a snapshot; rows of an unknown version are ignored, one workspace is one folder."""
    saved = spark.read.parquet(path).where(F.col("version") == INDEX_VERSION).drop("version")
    return saved if workspace is None else saved.where(F.col("workspace") == workspace)


def _csv_cell(value: Column) -> Column:
    text = F.coalesce(value.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\n]'), quoted).otherwise(text)


def chart_csv_lines(chart: DataFrame, category: str, series: list[str], order: str, source: str,
                    label: str = "Category") -> DataFrame:
    """(pos, line) of a chart's CSV: header, rows in order, a blank line, the source."""
    def comma(cells: list[Column]) -> Column:
        return F.concat_ws(",", *cells)

    rows = chart.select(F.col(order).cast("bigint").alias("pos"), comma([_csv_cell(F.col(c)) for c in [category, *series]]).alias("line"))
    big = F.lit(2**62).cast("bigint")
    spark = chart.sparkSession
    edge = spark.range(1)
    head = edge.select((-big).alias("pos"), comma([_csv_cell(F.lit(c)) for c in [label, *series]]).alias("line"))
    gap = edge.select(big.alias("pos"), F.lit("").alias("line"))
    foot = edge.select((big + 1).alias("pos"), _csv_cell(F.lit(f"Source: {source}")).alias("line"))
    return head.unionByName(rows).unionByName(gap).unionByName(foot)


def write_chart_csv(chart: DataFrame, path: str, category: str, series: list[str], order: str, source: str,
                    label: str = "Category") -> None:
    """Lines are sorted over all partitions; the parts in name order are the file."""
    lines = chart_csv_lines(chart, category, series, order, source, label)
    lines.orderBy("pos").select("line").write.mode("overwrite").text(path)


def manifest_rows(files: DataFrame, questions: DataFrame, company: str, note: str, pack: str = "pack") -> DataFrame:
    """One manifest per pack; a sample pack is a short hand-made list, its entries travel inside one document."""
    def gathered(df: DataFrame, name: str) -> DataFrame:
        inner = [c for c in df.columns if c not in ("pos", pack)]
        items = F.array_sort(F.collect_list(F.struct("pos", F.struct(*inner).alias("v"))))
        return df.groupBy(pack).agg(F.transform(items, lambda x: x["v"]).alias(name))

    both = gathered(files, "files").join(gathered(questions, "questions"), pack, "left")
    return both.select(F.lit(company).alias("company"), F.lit(note).alias("note"), "files", "questions")


def write_manifest(files: DataFrame, questions: DataFrame, path: str, company: str = "", note: str = "",
                   pack: str = "pack") -> None:
    """One JSON line per pack."""
    manifest_rows(files, questions, company, note, pack).write.mode("overwrite").json(path)
