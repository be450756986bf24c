"""Document sources: JSON Lines, CSV, in-memory rows, stop-word files and pipe-separated texts.

Loaders give (doc_id, fields, term_count). Ids count from first_id in the order of the input, whatever ids it has. Values become
strings: nulls are empty, nested values are JSON. A line that can't be read stops the job with its text; a missing path is an
error. term_count is the loader's estimate from white space, which indexing replaces by the number of tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quernel.functions.analysis import all_text, loader_term_count


def numbered(rows: DataFrame, first_id: int) -> DataFrame:
    """Consecutive ids in input order without bringing the rows to one place: counts by partition, then an offset for each."""
    at = rows.withColumn("_row", F.monotonically_increasing_id())
    at = at.withColumn("_part", F.shiftright("_row", 33))
    counts = at.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_row").alias("_low")).orderBy("_part").collect()  # a row per partition
    base, total = [], first_id
    for r in counts:
        base.append((r._part, total, r._low))
        total += r._n
    offsets = rows.sparkSession.createDataFrame(base, "_part long, _base long, _low long")
    out = at.join(F.broadcast(offsets), "_part")
    by_part = Window.partitionBy("_part").orderBy("_row")
    out = out.withColumn("doc_id", F.col("_base") + F.row_number().over(by_part) - 1)
    return out.select("doc_id", "fields").withColumn("term_count", loader_term_count(all_text("fields")).cast("long"))


def load_jsonl(spark: SparkSession, path: str, first_id: int = 1) -> DataFrame:
    """An object per line; empty lines are skipped, the key id is dropped."""
    lines = spark.read.text(path).where("value <> ''")
    fields = F.from_json("value", "map<string,string>", {"mode": "FAILFAST"})
    bad = F.raise_error(F.concat(F.lit("not a JSON object: "), F.col("value")))
    rows = lines.select(F.coalesce(fields, bad).alias("fields"))
    rows = rows.select(F.transform_values(F.map_filter("fields", lambda k, _: k != "id"), lambda _, v: F.coalesce(v, F.lit(""))).alias("fields"))
    return numbered(rows, first_id)


def load_csv(spark: SparkSession, path: str, columns: list[str], first_id: int = 1) -> DataFrame:
    """Rows behind a header that is skipped; columns names the fields, of which id is dropped. Rows of other width are errors."""
    if not columns:
        raise ValueError("columns must be named")
    schema = ", ".join(f"`{c}` string" for c in columns)
    rows = spark.read.csv(path, schema=schema, header=True, enforceSchema=True, quote='"', escape='"', mode="FAILFAST", multiLine=False)
    pairs = [x for c in columns if c != "id" for x in (F.lit(c), F.coalesce(F.col(c), F.lit("")))]
    return numbered(rows.select(F.create_map(*pairs).alias("fields") if pairs else F.create_map().cast("map<string,string>").alias("fields")), first_id)


def create_documents(spark: SparkSession, fields: list[dict[str, str]], first_id: int = 1) -> DataFrame:
    rows = [(first_id + i, {k: "" if v is None else str(v) for k, v in f.items()}) for i, f in enumerate(fields)]
    d = spark.createDataFrame(rows, "doc_id long, fields map<string,string>")
    return d.withColumn("term_count", loader_term_count(all_text("fields")).cast("long"))


def load_stop_words(spark: SparkSession, path: str) -> tuple[str, ...]:
    """Words of a file, one a line; blank lines and those with # are skipped."""
    words = spark.read.text(path).select(F.lower(F.trim("value")).alias("w")).where("w <> '' AND NOT startswith(w, '#')")
    return tuple(sorted({r.w for r in words.collect()}))  # as small as the file


def load_piped(spark: SparkSession, path: str, first_id: int = 1) -> DataFrame:
    """title|content lines."""
    parts = F.split("value", "\\|", 2)
    rows = spark.read.text(path).where("value <> ''").select(F.create_map(F.lit("title"), parts[0], F.lit("content"), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))).alias("fields"))
    return numbered(rows, first_id)
