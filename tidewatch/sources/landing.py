"""Landing files: listing, NDJSON and CSV readers. One file is one batch; ``_`` names are in flight."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import skew

RAW_SCHEMA = "batch_file string, split long, seq long, payload map<string,string>, malformed string"


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """``batch_file`` and ``path`` of every finished file, also of empty ones, which file sources skip.

    Listing is metadata work on the driver, as in any Spark read; no content is touched.
    """
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.listStatus(path) if fs.exists(path) else []
    names = [(f.getPath().getName(), f.getPath().toString()) for f in found if f.isFile()]
    names = [n for n in names if not n[0].startswith(("_", "."))]
    return spark.createDataFrame(names, "batch_file string, path string")


def new_files(listing: DataFrame, registry: DataFrame) -> DataFrame:
    """Files not registered yet, by name."""
    done = registry.select(F.col("file").alias("batch_file"))
    return listing.join(done, "batch_file", "left_anti").orderBy("batch_file")


def read_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Text lines with the file and the place in it. (split, seq) increases along a file."""
    lines = spark.read.text(paths)
    return lines.select(
        F.col("_metadata.file_name").alias("batch_file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("seq"), "value")


def parse_json(lines: DataFrame) -> DataFrame:
    """One JSON object per non-blank line. A line that is no object is kept in ``malformed``."""
    payload = F.from_json("value", "map<string,string>")
    return lines.where(F.trim("value") != "").select(
        "batch_file", "split", "seq", payload.alias("payload"), F.when(payload.isNull(), F.col("value")).alias("malformed"))


def read_ndjson(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return parse_json(read_lines(spark, paths))


# A cell after its comma: quoted, with doubled quotes inside, or up to the next comma.
CELL = r',(?:"(?:[^"]++|"")*+"(?=,|$)|[^,]*+)'


def split_cells(line: Column) -> Column:
    """The cells of one CSV line as an array of any length."""
    found = F.regexp_extract_all(F.concat(F.lit(","), F.regexp_replace(line, "\\r$", "")), F.lit(CELL), F.lit(0))

    def bare(cell: Column) -> Column:
        inner = F.substring(cell, F.lit(3), F.length(cell) - 3)
        return F.when((F.length(cell) > 2) & F.startswith(cell, F.lit(',"')) & F.endswith(cell, F.lit('"')),
                      F.replace(inner, F.lit('""'), F.lit('"'))).otherwise(F.substring(cell, F.lit(2), F.length(cell)))

    return F.transform(found, bare)


def csv_headers(lines: DataFrame) -> DataFrame:
    """The header line of each file with its column names and the places that count: of a repeated name, the last.
    Only first splits are looked at; the minimum combines map-side."""
    first = lines.where(F.col("split") == 0).groupBy("batch_file").agg(
        F.min_by("value", "seq").alias("header"), F.min("seq").alias("header_seq"))
    named = first.select("batch_file", "header_seq", split_cells(F.regexp_replace("header", "^\ufeff", "")).alias("names"))
    places = F.filter(F.sequence(F.lit(0), F.size("names") - 1), lambda i: ~F.array_contains(
        F.slice("names", i + 2, F.size("names")), F.get("names", i)))
    return named.withColumn("places", places)


def parse_csv(lines: DataFrame) -> DataFrame:
    """CSV rows as maps under their own file's header, so files with different headers never mix.

    Each line becomes an array of cells and is zipped with the column names of its file, which a join attaches: one plan for any
    number of headers. A row with more cells than its header is malformed, absent trailing cells are empty. Cells with
    line breaks are not supported.
    """
    headed = skew.lookup(lines, ["batch_file"], csv_headers(lines)).where(
        ((F.col("split") > 0) | (F.col("seq") > F.col("header_seq"))) & (F.trim("value") != ""))
    cells = headed.withColumn("__cells", split_cells(F.col("value")))
    bad = F.size("__cells") > F.size("names")
    payload = F.map_from_arrays(F.transform("places", lambda i: F.get("names", i)),
                                F.transform("places", lambda i: F.coalesce(F.get("__cells", i), F.lit(""))))
    return cells.select("batch_file", "split", "seq", F.when(~bad, payload).alias("payload"), F.when(bad, F.col("value")).alias("malformed"))


def read_csv(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return parse_csv(read_lines(spark, paths))
