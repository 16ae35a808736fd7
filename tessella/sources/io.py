"""Sources and sinks: JSON lines with explicit schemas, result logs that append and resume, stage exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

SPAN = T.ArrayType(T.StructType([T.StructField("s", T.IntegerType()), T.StructField("e", T.IntegerType())]))
PARAGRAPH = T.StructType([T.StructField("id", T.StringType()), T.StructField("title", T.StringType()), T.StructField("context", T.StringType()), T.StructField("sents", SPAN)])
ANSWER = T.StructType([
    T.StructField("text", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("start_sent", T.IntegerType()), T.StructField("end_sent", T.IntegerType()),
    T.StructField("offset_fixed", T.BooleanType()), T.StructField("paragraph_id", T.StringType()),
])
QUESTION = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("question", T.StringType()), T.StructField("paragraph_id", T.StringType()), T.StructField("answers", T.ArrayType(ANSWER)),
    T.StructField("gold_sent", T.IntegerType()), T.StructField("support", T.ArrayType(T.StructType([T.StructField("pid", T.StringType()), T.StructField("sent", T.IntegerType())]))), T.StructField("qtype", T.StringType()),
])


def write_jsonl(frame: DataFrame, path: str) -> None:
    frame.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Rows of JSON lines; the schema is given, never inferred, and a broken line is an error."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_log(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A result log; one that was never written is empty."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def missing_rows(rows: DataFrame, log: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys the log does not have."""
    return rows.join(log.select(*keys).distinct(), keys, "left_anti")


def append_missing(rows: DataFrame, path: str, keys: list[str], force: bool = False) -> int:
    """Appends rows whose keys the log does not have yet, or writes it anew; returns how many keys it has then."""
    spark = rows.sparkSession
    done = read_log(spark, path, rows.schema)
    if force:
        rows.write.mode("overwrite").parquet(path)
    else:
        missing_rows(rows.dropDuplicates(keys), done, keys).write.mode("append").parquet(path)
    return read_log(spark, path, rows.schema).select(*keys).distinct().count()


def export_inputs(ranked: DataFrame, contexts: DataFrame, top: int) -> DataFrame:
    """Per question: its first ``top`` units in order, and its logged contexts by budget; a question without either is an error."""
    first = ranked.where(F.col("rank") <= top).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "uidx"))).alias("ranked"))
    said = contexts.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("budget", "context"))).alias("contexts"))
    both = first.join(said, "qid", "full")
    whole = lambda c: F.when(F.col(c).isNull(), F.raise_error(F.concat(F.lit(f"no {c} for question "), F.col("qid").cast("string")))).otherwise(F.col(c)).alias(c)
    return both.select("qid", whole("ranked"), whole("contexts"))
