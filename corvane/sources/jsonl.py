"""JSON-lines and JSON documents: validating and plain scans, ordered sinks, a content-addressed cache."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvane.functions.storage import materialize

_STR = T.StringType()
_LIST, _LISTS = T.ArrayType(_STR), T.ArrayType(T.ArrayType(_STR))
FAULT = T.StructType([T.StructField(n, t) for n, t in (
    ("type", _STR), ("edge", _LIST), ("robot", _STR), ("budget", T.IntegerType()), ("giver", _STR), ("receiver", _STR), ("item", _STR), ("times", T.IntegerType()))])
META = T.StructType([T.StructField(n, t) for n, t in (
    ("domain", _STR), ("scenario", _STR), ("robots", _LIST), ("items", _LIST), ("init_dynamic", _LISTS), ("goal", _LISTS), ("faults", T.ArrayType(FAULT)),
    ("zones", T.MapType(_STR, _LIST)), ("connected", _LISTS), ("charge_stations", _LIST), ("can_reach", _LISTS), ("plan", _LIST), ("plan_len", T.IntegerType()),
    ("n_agents", T.IntegerType()), ("skill_aliases", T.MapType(_STR, _STR)), ("renamed_skill", _STR))])
RECORD = T.StructType([T.StructField("instruction", _STR), T.StructField("input", _STR), T.StructField("output", _STR), T.StructField("meta", META)])
BAD = "_corrupt_record"


def with_line_numbers(spark: SparkSession, path: str) -> DataFrame:
    """(line, value): lines counted from 1, blank ones too; one range for each file split, no global sort."""
    lines = spark.read.text(path).withColumn("_at", F.monotonically_increasing_id())
    lines = materialize(lines, "lines").withColumn("_part", F.shiftright("_at", 33))
    sizes = lines.groupBy("_part").agg(F.count("*").alias("_n"))
    from pyspark.sql import Window

    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(sizes.select("_part", before.alias("_start")))  # one row for each split
    return lines.join(starts, "_part").select((F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).alias("line"), "value")


def check_lines(lines: DataFrame, schema: T.StructType = RECORD, required: tuple[str, ...] = ("instruction", "input", "output", "meta")) -> DataFrame:
    """(line, row, problem): every line that is not blank; problem is null, bad_json or missing:<key>."""
    held = T.StructType([*schema.fields, T.StructField(BAD, _STR)])
    parsed = lines.where(F.trim(F.regexp_replace("value", r"\s", "")) != "")
    parsed = parsed.withColumn("row", F.from_json("value", held, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD}))
    problem = F.when(F.col("row").isNull() | F.col(f"row.{BAD}").isNotNull(), F.lit("bad_json"))
    for key in required:
        problem = problem.when(F.col(f"row.{key}").isNull(), F.lit(f"missing:{key}"))
    return parsed.select("line", F.col("row").dropFields(BAD).alias("row"), problem.alias("problem"))


def read_validated(spark: SparkSession, path: str) -> DataFrame:
    """Records with their line number as row_idx; fails with the first bad line, or on an empty file."""
    checked = materialize(check_lines(with_line_numbers(spark, path)), "records")
    bad = checked.where("problem is not null").orderBy("line").limit(1).collect()
    if bad:
        raise ValueError(f"{path}, line {bad[0].line}: {bad[0].problem}")
    if checked.isEmpty():
        raise ValueError(f"{path} holds no record")
    return checked.select(F.col("line").alias("row_idx"), "row.*")


def read_plain(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RECORD).json(path)


def write_ordered(df: DataFrame, path: str, order: str = "row_idx") -> None:
    """JSON lines in row order over as many files as there are ranges; non-ASCII text stays as it is."""
    df.repartitionByRange(order).sortWithinPartitions(order).drop(order).write.json(path)


def read_document(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path, multiLine=True)


def read_residuals(spark: SparkSession, path: str, buckets: int) -> list[float]:
    """The residuals R_b of a gate's document, cut to [0, 1]; fails unless there is one for each bucket."""
    row = spark.read.schema("R_b array<double>").json(path, multiLine=True).first()
    held = (row.R_b if row else None) or []
    if len(held) != buckets:
        raise ValueError(f"{path} has {len(held)} residuals for {buckets} buckets")
    return [min(1.0, max(0.0, x)) for x in held]


def first_rows(df: DataFrame, n: int, row: str = "row_idx") -> DataFrame:
    """The n rows of the least number; none for 0, all for fewer rows."""
    return df.orderBy(row).limit(n)


def batches(df: DataFrame, size: int, order: str) -> DataFrame:
    """df with batch and place: position in the order, cut at every `size` rows."""
    from corvane.functions.ranking import ordinal

    out = ordinal(df, [order], "_i")
    return out.withColumns({"batch": F.expr(f"_i div {size}"), "place": F.col("_i") % size}).drop("_i")


def without_faults(records: DataFrame, include_faulted: bool = False, faults: str = "meta.faults") -> DataFrame:
    """Records whose mission has no fault; all of them if faulted ones are wanted too."""
    return records if include_faulted else records.where(F.coalesce(F.size(faults), F.lit(0)) <= 0)


def write_report(row: DataFrame, path: str) -> None:
    row.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).write.text(path)


def cached(jobs: DataFrame, cache: DataFrame | None, key: str, compute) -> tuple[DataFrame, DataFrame]:
    """(jobs with their content, new entries): keys found in the cache are not computed again."""
    if cache is None:
        new = compute(jobs.dropDuplicates([key]))
        return jobs.join(new, key, "left"), new
    new = compute(jobs.join(cache, key, "left_anti").dropDuplicates([key]))
    return jobs.join(cache.unionByName(new), key, "left"), new


def round_trip_report(docs: DataFrame) -> DataFrame:
    """Counts by problem, after every 97th document has been damaged and written as a line."""
    good = F.to_json(F.struct(F.col("text").alias("instruction"), F.col("lang").alias("input"), F.col("lang").alias("output"), F.struct(F.col("lang").alias("domain")).alias("meta")))
    no = F.col("doc_id") % 97
    value = F.when(no == 0, F.lit("{broken")).when(no == 1, F.regexp_replace(good, '"input":', '"inputs":')).when(no == 2, F.lit("   ")).otherwise(good)
    lines = docs.select((F.col("doc_id") + 1).alias("line"), value.alias("value"))
    return check_lines(lines).groupBy(F.coalesce("problem", F.lit("ok")).alias("problem")).agg(F.count("*").alias("n"))
