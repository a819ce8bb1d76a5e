"""Files in and out: tables of text, JSON lines with their place, numbered batches, images, decisions and guarded writes."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists on whatever file system it names."""
    jvm = spark.sparkContext._jvm
    file = jvm.org.apache.hadoop.fs.Path(path)
    return bool(file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(file))


def read_csv(spark: SparkSession, path: str, schema: str | None = None, renamed: dict[str, str] | None = None) -> DataFrame:
    """A CSV table with a header; texts may span lines. ``renamed`` mends names of columns."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    df = reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)
    return df.withColumnsRenamed(renamed or {})


def read_or_empty(spark: SparkSession, path: str, schema: str, form: str = "parquet") -> DataFrame:
    """The table at ``path``, or an empty one of ``schema`` where there is none yet."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return read_csv(spark, path, schema) if form == "csv" else spark.read.schema(schema).format(form).load(path)


def load_or_make(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """The Parquet table at ``path``, made and written first where there is none."""
    if not exists(spark, path):
        make().write.parquet(path)
    return spark.read.parquet(path)


def batch_number(name: Column) -> Column:
    """The number at the end of a batch file's name; null if it has none."""
    return F.nullif(F.regexp_extract(name, r"(?i)(?:batch[_-]?)(\d+)(?:\.jsonl)?$", 1), F.lit("")).cast("int")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The non-blank lines of text files: value, file, line (from 1), batch and is_retry, by which files are ordered.

    Lines are numbered within their file, which one task reads whole. It is an error if there is no such file.
    """
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    here = system.globStatus(place)
    if not here or (len(here) == 1 and here[0].isDirectory() and not system.listStatus(here[0].getPath())):
        raise FileNotFoundError(f"no file at {path}")
    text = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file"))
    lines = text.select("file", F.posexplode(F.split("value", r"\r?\n")).alias("line", "value")).where("trim(value) <> ''")
    return lines.select("value", "file", (F.col("line") + 1).alias("line"), batch_number(F.col("file")).alias("batch"), F.col("file").contains("retry").alias("is_retry"))


def one_field_per_file(spark: SparkSession, path: str, field: str) -> DataFrame:
    """key (the file's name without ending) and the field's value of one JSON document per file."""
    docs = spark.read.text(path, wholetext=True)
    return docs.select(F.regexp_replace("_metadata.file_name", r"\.[^.]*$", "").alias("key"), F.get_json_object("value", f"$.{field}").alias("value"))


def missing_files(spark: SparkSession, expected: DataFrame, path: str) -> DataFrame:
    """The names of ``expected`` (name) that no file of ``path`` has."""
    here = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"))
    return expected.join(here, "name", "left_anti")


def images_base64(spark: SparkSession, path: str) -> DataFrame:
    """key and base64 of image files; of several endings for one key the first by name counts."""
    files = spark.read.format("binaryFile").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")
    keyed = files.select(F.regexp_replace("name", r"\.[^.]*$", "").alias("key"), "name", F.base64("content").alias("image"))
    return keyed.groupBy("key").agg(F.min_by("image", "name").alias("image"))


def codebook(spark: SparkSession, path: str) -> DataFrame:
    """section, field, value, description of a small YAML file of allowed codes."""
    import yaml

    with open(path, encoding="utf-8") as file:
        sections = yaml.safe_load(file)
    rows = [(s, f, str(v), None if d is None else str(d)) for s, fields in sections.items() for f, values in fields.items() for v, d in (values.items() if isinstance(values, dict) else ((x, None) for x in values))]
    return spark.createDataFrame(rows, "section string, field string, value string, description string")


def same_table(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables have the same columns, types and rows; whether a column may be null does not matter."""
    if a.dtypes != b.dtypes:
        return False
    left, right = (df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("r")).groupBy("r").agg(F.count("*").alias("n")) for df in (a, b))
    both = left.select("r", F.col("n").alias("x")).join(right.select("r", F.col("n").alias("y")), "r", "full")
    return both.where("NOT (x <=> y)").limit(1).count() == 0


def write_if_changed(df: DataFrame, path: str) -> bool:
    """Writes ``df`` as Parquet unless the table there has the same rows. Whether it wrote.

    ``df`` may read the table itself: the new one is written beside it and takes its place when it is whole.
    """
    spark = df.sparkSession
    if exists(spark, path) and same_table(spark.read.parquet(path), df):
        return False
    file = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    target, fresh = file(path), file(path.rstrip("/") + "._new")
    df.write.mode("overwrite").parquet(fresh.toString())
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    system.delete(target, True)
    if not system.rename(fresh, target):
        raise OSError(f"{fresh} could not take the place of {target}")
    return True


def write_csv(df: DataFrame, path: str, digits: dict[str, int] | None = None, order: list[str] | None = None) -> None:
    """A CSV with a header; ``digits`` rounds columns, ``order`` sorts the rows into one file for small tables of decisions."""
    out = df.select(*(F.round(c, digits[c]).alias(c) if digits and c in digits else F.col(c) for c in df.columns))
    out = out.orderBy(*order).coalesce(1) if order else out
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def append_lines(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON document of many lines as a table."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def load_all(spark: SparkSession, template: str, models: dict[str, str]) -> DataFrame:
    """One table per model, at ``template`` with {model} filled in, as one with model_short in front; columns that one lacks are null."""
    out = None
    for short, name in models.items():
        one = spark.read.parquet(template.format(model=name))
        one = one.select(F.lit(short).alias("model_short"), *one.columns)
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def upsert_manifest(spark: SparkSession, path: str, section: str, value: dict) -> None:
    """Sets one section of a small JSON file on any file system, which is made if it is not there. It is written beside the old one and then takes its place."""
    import json

    jvm = spark.sparkContext._jvm
    file = jvm.org.apache.hadoop.fs.Path
    target, fresh = file(path), file(path + "._new")
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    held = {}
    if system.exists(target):
        held = json.loads(spark.read.text(path, wholetext=True).first().value)
    out = system.create(fresh, True)
    out.write(bytearray(json.dumps(held | {section: value}, indent=1, sort_keys=True).encode()))
    out.close()
    system.delete(target, False)
    if not system.rename(fresh, target):
        raise OSError(f"{fresh} could not take the place of {target}")


def ask(df: DataFrame, prompt: str, answer: Callable[[list[str]], list[str]], name: str = "answer", size: int = 64) -> DataFrame:
    """``df`` with the answers of a callable that takes a list of prompts, called with at most ``size`` at a time on the executors."""
    schema = df.select("*", F.lit(None).cast("string").alias(name)).schema

    def call(batches):
        for batch in batches:
            texts = batch[prompt].tolist()
            yield batch.assign(**{name: [a for i in range(0, len(texts), size) for a in answer(texts[i : i + size])]})

    return df.mapInPandas(call, schema)
