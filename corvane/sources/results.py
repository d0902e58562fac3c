"""Result documents: files with a nested list of outcomes, and the pairing of two of them by position."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.storage import materialize
from corvane.operators.metrics import alignment_violations

DETAIL = "record_id string, domain string, scenario string, success boolean, reason string"
DOCUMENT = f"label string, no long, details array<struct<{DETAIL.replace(' string', ': string').replace(' boolean', ': boolean')}>>"


class Misaligned(ValueError):
    """Two results are not of the same tasks in the same order."""


def write_documents(rows: DataFrame, path: str, label: str, document: str, order: str) -> None:
    """Documents with their outcomes in a list, in order; document: the number of the one that a row belongs to."""
    names = [d.split()[0] for d in DETAIL.split(", ")]
    held = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), *names)))
    details = F.transform(held, lambda x: F.struct(*[x[n].alias(n) for n in names])).alias("details")
    rows.groupBy(F.col(document).alias("no")).agg(details).select(F.lit(label).alias("label"), "no", "details").write.json(path)


def read_documents(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """(label, no, pos, record_id, ...): one row for each outcome, with its place in its document's list."""
    documents = spark.read.schema(DOCUMENT).json(path, multiLine=multi_line)
    return documents.select("label", "no", F.posexplode("details").alias("pos", "d")).select("label", "no", "pos", "d.*")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of a folder of text files: lines counted from 0 in the order of file names.

    Each block of a file is counted by itself; one row for each block says where it starts.
    """
    block = [F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b")]
    lines = spark.read.text(path).select("value", *block).withColumn("_at", F.monotonically_increasing_id())
    lines = materialize(lines, "numbered-lines")
    blocks = lines.groupBy("_f", "_b").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = blocks.select("_f", "_b", (before - F.col("_first")).alias("_start"))
    return lines.join(F.broadcast(starts), ["_f", "_b"]).select((F.col("_at") + F.col("_start")).alias("line"), "value")


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """(line, record_id, ...) of files with an outcome a line."""
    return numbered_lines(spark, path).select("line", F.from_json("value", DETAIL).alias("d")).select("line", "d.*")


def paired(a: DataFrame, b: DataFrame, at: list[str], same: tuple[str, ...] = ("record_id", "domain", "scenario")) -> DataFrame:
    """(at, same, a, b): the successes of two results at each position.

    Fails if one has positions that the other has not, or if what must be the same differs.
    """
    place = F.struct(*at).alias("_at")
    x, y = (materialize(df.select(place, *at, *same, "success"), "outcomes") for df in (a, b))
    wrong = alignment_violations(x, y, "_at", list(same)).first()
    if wrong.left_only or wrong.right_only:
        raise Misaligned(f"{wrong.left_only} positions on the left only, {wrong.right_only} on the right only")
    if wrong.different:
        raise Misaligned(f"{wrong.different} positions hold different tasks")
    other = y.select(F.col("_at").alias("_other"), F.col("success").alias("b"))
    return x.join(other, F.col("_at") == F.col("_other")).select(*at, *same, F.col("success").alias("a"), "b")
