"""File sources: folders, tables, JSON and text lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..storage import materialize, with_seq


def _with_offsets(df: DataFrame) -> DataFrame:
    """Adds `offset`, where each line of a text file begins, in bytes.

    Lines of a split are summed up within it; what the splits of a file hold
    goes before, split by split.
    """
    size = F.octet_length("value") + 1
    at = F.monotonically_increasing_id()
    d = materialize(df.select("*", F.col("_metadata.file_path").alias("__file")).withColumns({"__at": at, "__size": size.cast("bigint")}))
    d = d.withColumn("__part", F.shiftright("__at", 33))
    sums = d.groupBy("__file", "__part").agg(F.sum("__size").alias("__sum"), F.min("__at").alias("__first"))
    before = Window.partitionBy("__file").orderBy("__first").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__before", F.coalesce(F.sum("__sum").over(before), F.lit(0)))
    own = Window.partitionBy("__file", "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("__own", F.coalesce(F.sum("__size").over(own), F.lit(0))).join(sums.select("__file", "__part", "__before"), ["__file", "__part"])
    return d.withColumn("offset", F.col("__before") + F.col("__own")).drop("__at", "__size", "__part", "__before", "__own")


def json_lines(spark: SparkSession, path: str, schema: T.StructType, *, bad: str = "skip", stream: bool = False) -> DataFrame:
    """JSON lines with id, from the object's own id, else file:offset in bytes; bad lines are skipped (and counted by `bad_lines`) or fail the read.

    A stream reads no offsets; there the second part is a hash of the line, so
    equal lines of one file share an id.
    """
    wanted = T.StructType([*schema.fields, *([] if "id" in schema.names else [T.StructField("id", T.StringType())]), *([T.StructField("_bad", T.StringType())] if bad == "skip" else [])])
    if stream:
        raw = spark.readStream.text(path).select("value", F.col("_metadata.file_path").alias("__file"), F.substring(F.sha2(F.col("value").cast("binary"), 256), 1, 12).alias("offset"))
    else:
        raw = _with_offsets(spark.read.option("lineSep", "\n").text(path))
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"} if bad == "skip" else {"mode": "FAILFAST"}
    df = raw.where(F.col("value").rlike(r"\S")).withColumn("__x", F.from_json("value", wanted, options))
    if bad == "skip":
        df = df.where("__x._bad is null")
    own = F.concat(F.url_decode(F.element_at(F.split("__file", "/"), -1)), F.lit(":"), F.col("offset").cast("string"))
    names = [*schema.names, *([] if "id" in schema.names else ["id"])]
    return df.select(*[(F.coalesce(F.nullif(F.col("__x.id"), F.lit("")), own) if c == "id" else F.col("__x")[c]).alias(c) for c in names])


def bad_lines(spark: SparkSession, path: str, schema: T.StructType) -> int:
    """Lines that are no JSON object of the schema."""
    wanted = T.StructType([*schema.fields, T.StructField("_bad", T.StringType())])
    df = spark.read.text(path).where("trim(value) <> ''")
    return df.select(F.from_json("value", wanted, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("x")).where("x._bad is not null").count()


def text_lines(spark: SparkSession, path: str, field: str = "text", *, stream: bool = False) -> DataFrame:
    return (spark.readStream if stream else spark.read).text(path).withColumnRenamed("value", field)


def folder_records(spark: SparkSession, path: str, glob: str = "*", *, since: str | None = None, until: str | None = None, line: str | None = None) -> DataFrame:
    """One record per file of <path>/<group>/<name>.<ext>: id group/name, group, name, text, count (lines), path.

    `line` renders each JSON line by a template; files without text are left
    out; since and until bound names by their order as texts.  A file is one record, so
    it is read whole.
    """
    from ..functions.templates import compile_template, fields

    raw = spark.read.text(f"{path}/*/{glob}", wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("path"))
    parts = F.split("path", "/")
    d = raw.withColumns({"group": F.url_decode(F.element_at(parts, -2)), "file": F.url_decode(F.element_at(parts, -1))})
    d = d.withColumn("name", F.regexp_replace("file", r"\.[^.]*$", "")).drop("file")
    if since is not None:
        d = d.where(F.col("name") >= since)
    if until is not None:
        d = d.where(F.col("name") <= until)
    if line is not None:
        names = sorted(fields(line))
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
        lines = F.filter(F.split("text", "\n"), lambda s: s.rlike(r"\S"))
        d = d.withColumn("__l", F.transform(lines, lambda s: F.from_json(s, schema)))
        shown = F.transform("__l", lambda x: compile_template(line, schema, column=lambda n: x[n]))
        d = d.withColumn("text", F.array_join(shown, "\n")).withColumn("count", F.size("__l").cast("bigint")).drop("__l")
    else:
        d = d.withColumn("count", F.size(F.filter(F.split("text", "\n"), lambda s: s.rlike(r"\S"))).cast("bigint"))
    return d.where(F.col("text").rlike(r"\S")).withColumn("id", F.concat_ws("/", "group", "name")).select("id", "group", "name", "text", "count", "path")


def table_records(spark: SparkSession, path: str, form: str) -> DataFrame:
    """csv or tsv (header, short rows allowed, all texts) or jsonl (a bad line is an error); id from id, ID, key or name, else row-<n>."""
    if form in ("csv", "tsv"):
        df = spark.read.option("header", True).option("sep", "," if form == "csv" else "\t").option("mode", "PERMISSIVE").csv(path)
    else:
        df = spark.read.option("mode", "FAILFAST").json(path)
    # read order as a contiguous number; it has to be a column of its own, else it counts only the rows that need it
    columns = df.columns
    df = with_seq(df.withColumn("__at", F.monotonically_increasing_id()), "__at", name="__row")
    # names of a case-sensitive source stay apart
    named = [F.nullif(F.trim(F.col(f"`{c}`").cast("string")), F.lit("")) for want in ("id", "ID", "key", "name") for c in columns if c == want]
    fallback = F.concat(F.lit("row-"), (F.col("__row") + 1).cast("string"))
    ids = F.coalesce(*named, fallback)
    keep = [c for c in columns if c.lower() != "id"]
    return df.select(ids.alias("id"), *[F.col(f"`{c}`") for c in keep])
