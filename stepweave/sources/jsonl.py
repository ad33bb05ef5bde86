"""JSON Lines readers with the error rules that the data needs, and staged rewriting."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def strict(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """A line that is no JSON fails the read; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def lenient(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Lines that are no JSON are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def numbered(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(file, line_no, row): good lines alone, numbered from 1 in each file, so a bad line moves no number.

    The line order comes from the text reader's row index in the file, not from the order in which rows arrive."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"), "value")
    good = raw.where(F.length(F.trim("value")) > 0).where(F.expr("try_parse_json(value)").isNotNull())
    parsed = good.withColumn("row", F.from_json("value", schema))
    return parsed.withColumn("line_no", F.row_number().over(Window.partitionBy("file").orderBy("at")).cast("long")).select("file", "line_no", "row")


def sniffed(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A JSON list if the first character that is not blank is [, else JSON Lines. One line is looked at."""
    first = spark.read.text(path).where("trim(value) <> ''").limit(1).collect()
    reader = spark.read.option("multiLine", bool(first) and first[0].value.lstrip().startswith("["))
    return (reader.schema(schema) if schema else reader).json(path)


def with_presence(df: DataFrame, raw: str, keys: list[str]) -> DataFrame:
    """has_<key> for each key of the raw line: missing and null are different things."""
    found = F.json_object_keys(raw)
    return df.withColumns({f"has_{k}": F.coalesce(F.array_contains(found, k), F.lit(False)) for k in keys})


def ids(spark: SparkSession, path: str, key: str = "processed_ids") -> DataFrame:
    """(id) from a JSON list, an object that has the key, or any object whose values are strings."""
    whole = spark.read.text(path, wholetext=True)
    as_list = F.from_json("value", "array<string>")
    keyed = F.from_json(F.get_json_object("value", f"$.{key}"), "array<string>")
    any_object = F.map_values(F.from_json("value", "map<string,string>"))
    is_list = F.startswith(F.trim("value"), F.lit("["))
    return whole.select(F.explode(F.when(is_list, as_list).otherwise(F.coalesce(keyed, any_object))).alias("id")).where("id is not null").distinct()


def rewrite(spark: SparkSession, df: DataFrame, path: str, changed: str) -> bool:
    """Writes df over path through a staging folder and a rename, if a row is marked as changed. Whether it did."""
    if df.where(changed).isEmpty():
        return False
    jvm = spark.sparkContext._jvm
    here, staged, old = (jvm.org.apache.hadoop.fs.Path(p) for p in (path, f"{path}.staged", f"{path}.old"))
    fs = here.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.drop(changed).write.mode("overwrite").json(f"{path}.staged")
    fs.delete(old, True)
    if fs.exists(here):
        fs.rename(here, old)
    fs.rename(staged, here)
    fs.delete(old, True)
    return True
