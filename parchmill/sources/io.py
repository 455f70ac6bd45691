"""Readers and writers: JSON lines, CSV, id lists, YAML settings, discovery, partitioned and appended output."""

from __future__ import annotations

import json
from fnmatch import fnmatch

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parchmill.session import written


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, strict: bool = False) -> DataFrame:
    """One object a line. Blank lines are skipped, or, if ``strict``, anything that is no object fails the read."""
    if not strict:
        return spark.read.schema(schema).json(path)
    lines = spark.read.text(path)
    parsed = F.from_json("value", schema if isinstance(schema, str) else schema.json(), {"mode": "FAILFAST"})
    blank = F.raise_error(F.lit("blank line in a strict file")).cast("string")
    value = F.when(F.trim("value") == "", blank).otherwise(F.col("value")).alias("value")
    return lines.select(value).select(parsed.alias("r")).select("r.*")


def read_last_by_key(spark: SparkSession, path: str, schema: T.StructType | str, key: str) -> DataFrame:
    """One row a key; of several the last in file order counts."""
    df = read_jsonl(spark, path, schema).withColumns({"__f": F.input_file_name(), "__i": F.monotonically_increasing_id()})
    best = df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), F.struct("__f", "__i")).alias("r"))
    return best.select(key, "r.*").drop("__f", "__i")


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header and quoted line breaks; a path that is missing gives no rows. An empty cell is an empty text, no null."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').option("nullValue", "\0").csv(path)


def read_ids(spark: SparkSession, path: str, name: str = "id") -> DataFrame:
    """The strings of one JSON array."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "array<string>")).alias(name)).distinct()


def read_settings(spark: SparkSession, path: str) -> dict:
    """Settings as plain values: YAML if that library is there, else JSON."""
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def discover(spark: SparkSession, root: str, pattern: str, exclude: tuple[str, ...] = ()) -> list[str]:
    """Paths below ``root`` whose name matches; those with an excluded part in them are left out."""
    fs, p = _path(spark, root)
    if not fs.exists(p):
        return []
    found, it = [], fs.listFiles(p, True)
    while it.hasNext():
        name = it.next().getPath().toString()
        if fnmatch(name.rsplit("/", 1)[-1], pattern) and not any(x in name for x in exclude):
            found.append(name)
    return sorted(found)


def discover_one(spark: SparkSession, root: str, pattern: str, exclude: tuple[str, ...] = ("dryrun", "checkpoint-")) -> str:
    """The folder of the one match; none or several are an error."""
    found = discover(spark, root, pattern, exclude)
    if len(found) != 1:
        raise FileNotFoundError(f"{len(found)} matches of {pattern} below {root}: {found[:5]}")
    return found[0].rsplit("/", 1)[0]


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """One object a line, null fields kept."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_splits(df: DataFrame, folder: str, base: str, split: str = "split") -> None:
    """One folder a split, ``{base}_{split}``; what is written is what is read again, whatever the source does."""
    fixed = written(df, "splits")
    # the splits are few and known by name: a bounded list
    for name in sorted(r[0] for r in fixed.select(split).where(F.col(split).isNotNull()).distinct().collect()):
        write_jsonl(fixed.where(F.col(split) == name).drop(split), f"{folder}/{base}_{name}")


def write_partitioned(df: DataFrame, path: str, split: str = "split") -> None:
    """One pass over the rows, one folder a split value."""
    df.write.mode("overwrite").partitionBy(split).option("ignoreNullFields", "false").json(path)


def append_summary(df: DataFrame, path: str) -> None:
    """Add rows to the summary table; a re-read sees all rows of all calls."""
    df.write.mode("append").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, quotes doubled and line breaks kept."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).option(
        "ignoreLeadingWhiteSpace", False
    ).option("ignoreTrailingWhiteSpace", False).csv(path)


def export_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header, for a summary or a review sheet: as many rows as a person reads."""
    write_csv(df.coalesce(1), path)


def write_ids(df: DataFrame, path: str, name: str = "id") -> None:
    """A JSON array of a bounded sample's ids, sorted."""
    ids = df.select(F.to_json(F.array_sort(F.collect_list(name))).alias("value"))
    ids.coalesce(1).write.mode("overwrite").text(path)
