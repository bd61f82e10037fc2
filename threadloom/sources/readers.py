"""Readers: comments, edge tables, yearly networks, metadata and lists, from JSON lines, CSV and text.

Months and years come from the name of a file or of the folder that Spark wrote it into, so one read
covers many files. Codecs follow the extension; bz2 files are splittable. Where the last of repeated
records counts, order is that of file names and of positions in the files.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import from_file_name

COMMENT_SCHEMA = "id string, author string, subreddit string, subreddit_id string, score long, link_id string, parent_id string, body string, body_cleaned string"
MONTH, YEAR = r"(\d{4}-\d{2})", r"(\d{4})"


def _file_name() -> Column:
    """The file's name after that of its folder; taken for every row, so without a pattern that is tried from each letter of the path."""
    return F.substring_index(F.col("_metadata.file_path"), "/", -2)


def _position() -> Column:
    """Grows along the records of a file, and with file names; to be taken in the select that follows the scan."""
    return F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())


def read_comments(spark: SparkSession, path: str | Sequence[str], start: str | None = None, end: str | None = None, pattern: str | None = None) -> DataFrame:
    """Comments with ``month`` from the file name, between two months inclusive; malformed lines are dropped."""
    reader = spark.read.schema(COMMENT_SCHEMA + ", _bad string").option("columnNameOfCorruptRecord", "_bad")
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    rows = reader.json(path if isinstance(path, str) else list(path)).withColumn("month", from_file_name(_file_name(), MONTH))
    if start is not None:
        rows = rows.filter(F.col("month") >= start)
    if end is not None:
        rows = rows.filter(F.col("month") <= end)
    return rows.filter("_bad is null").drop("_bad")


def load_comments(comments: DataFrame, columns: Sequence[str], bots: DataFrame | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """Chosen columns of allowed communities without bots; columns that the table lacks are null."""
    kept = comments
    if allowed is not None:
        kept = kept.join(allowed.select("subreddit"), "subreddit", "left_semi")
    if bots is not None:
        kept = kept.join(bots.select("author"), "author", "left_anti")
    return project(kept, columns)


def project(rows: DataFrame, columns: Sequence[str], kind: str = "string") -> DataFrame:
    return rows.select(*(F.col(c) if c in rows.columns else F.lit(None).cast(kind).alias(c) for c in columns))


def fold(comments: DataFrame, keys: Sequence[str], partial: Mapping[str, Callable], merge: Mapping[str, Callable] | None = None) -> DataFrame:
    """A user's aggregate in two phases: ``partial`` makes named columns per partition, ``merge`` combines them (sums by default)."""
    first = comments.withColumn("_part", F.spark_partition_id()).groupBy("_part", *keys).agg(*(f().alias(n) for n, f in partial.items()))
    merge = merge or {n: F.sum for n in partial}
    return first.groupBy(*keys).agg(*(f(n).alias(n) for n, f in merge.items()))


def read_edges(spark: SparkSession, path: str, node_1: str = "node_1", node_2: str = "node_2", use_weights: bool = True) -> DataFrame:
    """src, dst, weight of an edge file.

    Weighted: positive weights only. Unweighted: flag 1 only, with the weight where it is positive.
    Of repeated pairs the last weight stays.
    """
    rows = spark.read.option("header", True).csv(path).withColumn("_at", _position())
    weight = F.expr("try_cast(weighted as double)")
    pair = [F.col(node_1).alias("src"), F.col(node_2).alias("dst")]
    if use_weights:
        kept = rows.filter(weight > 0).select(*pair, weight.alias("weight"), "_at")
    else:
        kept = rows.filter(F.expr("try_cast(try_cast(unweighted as double) as int) = 1")).select(*pair, F.when(weight > 0, weight).alias("weight"), "_at")
    return kept.groupBy(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).agg(F.max_by("weight", "_at").alias("weight"))


def network_view(rows: DataFrame, view: str = "weighted", na_weight: float = 0.0, directed: bool = False) -> DataFrame:
    """node_1, node_2 and the attributes of a view: weighted (missing filled), unweighted (flag 1, none) or both."""
    if view == "weighted":
        out = rows.select("node_1", "node_2", F.coalesce("weighted", F.lit(na_weight)).alias("weighted"))
    elif view == "unweighted":
        out = rows.filter("unweighted = 1").select("node_1", "node_2")
    elif view == "both":
        out = rows.select("node_1", "node_2", "weighted", "unweighted")
    else:
        raise ValueError(f"unknown view {view!r}")
    return out if directed else out.withColumns({"node_1": F.least("node_1", "node_2"), "node_2": F.greatest("node_1", "node_2")})


def read_networks(spark: SparkSession, path: str) -> DataFrame:
    """yr, node_1, node_2, weighted, unweighted of yearly files; without the flag column all rows count as flagged."""
    rows = spark.read.option("header", True).csv(path)
    flag = F.expr("try_cast(unweighted as int)") if "unweighted" in rows.columns else F.lit(1)
    weight = F.expr("try_cast(weighted as double)") if "weighted" in rows.columns else F.lit(None).cast("double")
    return rows.select(from_file_name(_file_name(), YEAR).cast("long").alias("yr"), F.col("node_1").cast("string").alias("node_1"), F.col("node_2").cast("string").alias("node_2"), weight.alias("weighted"), flag.alias("unweighted"))


def read_snapshots(spark: SparkSession, path: str, method: str) -> DataFrame:
    """method, snapshot, src, dst, weight of monthly graph files; whole weights."""
    rows = spark.read.option("header", True).schema("subreddit_a string, subreddit_b string, weight double").csv(path)
    return rows.select(F.lit(method).alias("method"), from_file_name(_file_name(), MONTH).alias("snapshot"), F.col("subreddit_a").alias("src"), F.col("subreddit_b").alias("dst"), F.floor("weight").cast("double").alias("weight"))


def read_json_lines(spark: SparkSession, path: str, schema: str, at: str | None = None) -> DataFrame:
    """Well-formed lines of a JSON-lines file; ``at`` names a column for their positions."""
    rows = spark.read.schema(schema + ", _bad string").option("columnNameOfCorruptRecord", "_bad").json(path)
    if at is not None:
        rows = rows.withColumn(at, _position())
    return rows.filter("_bad is null").drop("_bad")


def count_lines(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """One row with the number of lines of text files of any codec; nothing is parsed."""
    reader = spark.read.option("pathGlobFilter", pattern) if pattern else spark.read
    return reader.text(path).agg(F.count("*").alias("n_lines"))


def read_labels(spark: SparkSession, path: str, label: str) -> DataFrame:
    """node, label where the label is present and not empty, zero or false; of repeats the last."""
    rows = read_json_lines(spark, path, f"subreddit string, {label} string", at="_at")
    truthy = F.col(label).isNotNull() & ~F.col(label).isin("", "0", "0.0", "false")
    return rows.filter(F.col("subreddit").isNotNull() & truthy).groupBy(F.col("subreddit").alias("node")).agg(F.max_by(label, "_at").alias("label"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """subreddit, party, banned, gun; rows without subreddit dropped, missing or bad values '' and 0."""
    rows = read_json_lines(spark, path, "subreddit string, party string, banned string, gun string")
    number = lambda c: F.expr(f"coalesce(try_cast(try_cast({c} as double) as int), 0)").alias(c)
    return rows.filter("subreddit is not null").select("subreddit", F.coalesce("party", F.lit("")).alias("party"), number("banned"), number("gun"))


def read_bots(spark: SparkSession, path: str) -> DataFrame:
    """author of every user marked as a bot."""
    return read_json_lines(spark, path, "author string, bot string").filter("author <> '' and try_cast(bot as double) = 1").select("author").distinct()


def read_list(spark: SparkSession, path: str, name: str = "subreddit") -> DataFrame:
    """One value per line, trimmed, blanks dropped."""
    return spark.read.text(path).select(F.trim("value").alias(name)).filter(F.col(name) != "").distinct()


def read_or_empty(spark: SparkSession, path: str, schema: str, form: str = "csv") -> DataFrame:
    """The table of an earlier stage, or an empty one with its schema where the path does not exist."""
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not files.getFileSystem(spark._jsc.hadoopConfiguration()).exists(files):
        return spark.createDataFrame([], schema)
    reader = spark.read.schema(schema)
    return reader.option("header", True).csv(path) if form == "csv" else reader.format(form).load(path)
