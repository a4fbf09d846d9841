"""CSV landing directories: delimiter and encoding per file, then one clean table."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataward.constants import DELIMITERS
from dataward.functions.coerce import col, infer_types, null_tokens, quoted
from dataward.session import materialize

CORRUPT = "__malformed"
BOM = "﻿"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")


def _outside_quotes(line: Column) -> Column:
    return F.regexp_replace(line, '"[^"]*"', "")


def file_formats(spark: SparkSession, path: str) -> DataFrame:
    """(file, delimiter, encoding, header, broken) from one pass over the lines, and another that
    fetches the headers.

    The delimiter is the candidate whose count per line is most often the same. The text
    reader keeps raw bytes, so a file is UTF-8 when every line is valid UTF-8, otherwise
    ISO-8859-1. ``header`` is the first line of the file's first block; ``broken`` tells
    that a line has an odd number of quotes, so that a record goes on in the next line.
    Files are read as splittable text: a huge one is counted by many tasks and combined
    map-side."""
    bare = _outside_quotes(F.col("value"))
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), "value",
        F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id()).alias("place")
    ).where(F.col("value") != "")
    # places, not lines, are aggregated: texts would have every line sorted
    per_line = lines.select(
        "file", F.is_valid_utf8("value").alias("valid"), (quotes % 2 == 1).alias("odd"), "place",
        F.inline(F.array(*[
            F.struct(F.lit(i).alias("choice"),
                     (F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit(""))))
                     .alias("found"))
            for i, d in enumerate(DELIMITERS)])))
    counts = per_line.groupBy("file", "choice", "found").agg(
        F.count(F.lit(1)).alias("lines"), F.bool_and("valid").alias("valid"),
        F.bool_or("odd").alias("odd"), F.min("place").alias("place"))
    per_choice = Window.partitionBy("file", "choice")
    shares = counts.withColumn("share", F.col("lines") / F.sum("lines").over(per_choice))
    # the modal share decides; more columns, then candidate order, break ties
    best = F.max_by(F.when(F.col("found") > 0, F.col("choice")),
                    F.when(F.col("found") > 0, F.struct("share", "found", -F.col("choice"))))
    names = F.array(*[F.lit(d) for d in DELIMITERS])
    formats = shares.groupBy("file").agg(
        F.get(names, F.coalesce(best, F.lit(0))).alias("delimiter"),
        F.when(F.bool_and("valid"), "UTF-8").otherwise("ISO-8859-1").alias("encoding"),
        F.min("place").alias("place"), F.bool_or("odd").alias("broken"))
    formats = materialize(formats, "formats")                  # one row per file
    # the same scan deals the same places; only lines of a file's first block have one
    first = (lines.where(F.col("place").isNotNull()).withColumnRenamed("value", "header")
             .join(F.broadcast(formats.select("file", "place")), ["file", "place"]).select("file", "header"))
    return formats.join(first, "file", "left").select("file", "delimiter", "encoding", "header", "broken")


def sniff_delimiters(spark: SparkSession, path: str) -> DataFrame:
    return file_formats(spark, path).select("file", "delimiter")


def detect_encodings(spark: SparkSession, path: str) -> DataFrame:
    return _lines(spark, path).groupBy("file").agg(
        F.when(F.bool_and(F.is_valid_utf8("value")), "UTF-8").otherwise("ISO-8859-1")
        .alias("encoding"))


def _options(delimiter: str, encoding: str) -> dict[str, str]:
    return {"header": "true", "sep": delimiter, "encoding": encoding, "quote": '"', "escape": '"',
            "columnPruning": "false", "emptyValue": "", "nullValue": "", "mode": "PERMISSIVE",
            "columnNameOfCorruptRecord": CORRUPT}


def _read(spark: SparkSession, paths: list[str], delimiter: str, encoding: str,
          multi_line: bool) -> DataFrame:
    """All-string rows of files of one format and header, with malformed lines kept as
    text in the marker column."""
    options = _options(delimiter, encoding)
    raw = spark.read.options(**options, multiLine=multi_line).csv(paths)     # reads the header only
    names = [c.removeprefix(BOM) if i == 0 else c for i, c in enumerate(raw.columns)]
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names]
                          + [T.StructField(CORRUPT, T.StringType())])
    if not multi_line:
        return spark.read.schema(schema).options(**options, enforceSchema=True).csv(paths)
    fields = ", ".join(f"{quoted(f.name)} string" for f in schema)
    return (records(spark, paths, delimiter, encoding).where("NOT header")
            .select(F.from_csv("record", fields, options).alias("r")).select("r.*"))


def _closes(separator: str) -> str:
    """What follows a quote that ends a field."""
    return rf"(?={separator}|\r?$)"


def _inside_text(separator: str) -> str:
    """Text within quotes up to the quote that ends the field: quotes are doubled, or followed by
    something else than a separator. Without alternatives per character, so that long fields
    do not deepen the matcher's stack."""
    return rf"""[^"]*+(?:(?:""|"(?!{separator}|\r?$|"))[^"]*+)*+"""


def _opens(line: Column, separator: str) -> Column:
    """Whether a line that begins outside quotes ends inside them."""
    whole = rf"""(^|{separator})[ \t]*"{_inside_text(separator)}"{_closes(separator)}"""
    return F.regexp_replace(line, whole, "$1").rlike(rf"""(?:^|{separator})[ \t]*\"""")


def _line_effects(line: Column, separator: str) -> tuple[Column, Column]:
    """Whether a line ends inside quotes if it begins outside, and if it begins inside."""
    closing = rf"""^{_inside_text(separator)}"{_closes(separator)}"""
    # what a field that ends is followed by begins with a separator, not with a field
    after = F.when(line.rlike(closing), _opens(F.concat(F.lit("-"), F.regexp_replace(line, closing, "")), separator))
    return _opens(line, separator), F.coalesce(after, F.lit(True))


def _begins_inside(order: WindowSpec) -> Column:
    """Whether quotes are open where a row begins, as far as the rows before it in its window
    tell: null if all of them leave open what they find open. Rows carry ``fixed`` (the state
    after them whatever was before, or null) and ``turn`` (1 if they turn the state round)."""
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    turns = F.coalesce(F.sum("turn").over(before), F.lit(0))
    last = F.last(F.when(F.col("fixed").isNotNull(), F.struct("fixed", "turns")), ignorenulls=True).over(before)
    return F.struct(last["fixed"].alias("fixed"), (turns - F.coalesce(last["turns"], F.lit(0))).alias("turns"))


def _state(known: Column, start: Column) -> Column:
    """The state after so many turns of a fixed one, or of the one at the start."""
    return F.coalesce(known["fixed"], start) != (known["turns"] % 2 == 1)


def records(spark: SparkSession, paths: list[str], delimiter: str, encoding: str) -> DataFrame:
    """(file, header, record) of files whose records may go on over line breaks in quotes.

    A line, and so a block of a file, either fixes whether quotes are open after it, or keeps or
    turns what was before. One row per block, in file order, gives the state at the start of
    each; then every block finds its records by itself, in a task of its own, and only the
    pieces at the edges of blocks, two a block, are put together."""
    separator = re.escape(delimiter)
    text = spark.read.option("lineSep", "\n").text(paths)
    value = F.decode(F.col("value").cast("binary"), "ISO-8859-1") if encoding != "UTF-8" else F.col("value")
    lines = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                        F.monotonically_increasing_id().alias("place"), value.alias("line"))
    from_outside, from_inside = _line_effects(F.col("line"), separator)
    in_block = Window.partitionBy("file", "block").orderBy("place")
    marked = (lines.withColumn("opens", from_outside).withColumn("stays", from_inside)
              .withColumn("fixed", F.when(F.col("opens") == F.col("stays"), F.col("opens")))
              .withColumn("turn", (F.col("opens") & ~F.col("stays")).cast("int"))
              .withColumn("turns", F.sum("turn").over(in_block))
              .withColumn("known", _begins_inside(in_block)))
    after = F.struct(F.coalesce("fixed", "known.fixed").alias("fixed"),
                     F.when(F.col("fixed").isNotNull(), 0).otherwise(F.col("known.turns") + F.col("turn")).alias("turns"))
    blocks = (marked.groupBy("file", "block").agg(F.max_by(after, "place").alias("last"))
              .select("file", "block",
                      F.when(F.col("last.fixed").isNotNull(), F.col("last.fixed") != (F.col("last.turns") % 2 == 1)).alias("fixed"),
                      F.when(F.col("last.fixed").isNull(), F.col("last.turns")).otherwise(0).alias("turn")))
    in_file = Window.partitionBy("file").orderBy("block")
    begins = (blocks.withColumn("turns", F.sum("turn").over(in_file)).withColumn("known", _begins_inside(in_file))
              .select("file", "block", _state(F.col("known"), F.lit(False)).alias("start")))
    inside = _state(F.col("known"), F.col("start"))
    blank = F.col("line").rlike(r"^\r?$")
    numbered = (marked.join(begins, ["file", "block"]).withColumn("inside", inside)
                .where(F.col("inside") | ~blank)
                .withColumn("number", F.sum((~F.col("inside")).cast("int")).over(in_block)))
    pieces = (numbered.groupBy("file", "block", "number")
              .agg(F.sort_array(F.collect_list(F.struct("place", "line"))).alias("all"))
              .select("file", "block", "number", F.array_join(F.transform("all", lambda x: x["line"]), "\n").alias("record")))
    counts = pieces.groupBy("file", "block").agg(F.max("number").alias("records"))
    owners = counts.select("file", "block", "records", F.last(
        F.when(F.col("records") > 0, F.col("block")), ignorenulls=True)
        .over(in_file.rowsBetween(Window.unboundedPreceding, -1)).alias("before"))
    told = pieces.join(owners, ["file", "block"])
    whole = told.where("number > 0 AND number < records").select("file", "block", "number", "record")
    edges = (told.where("number = 0 OR number = records")
             .withColumn("owner", F.when(F.col("number") > 0, F.col("block")).otherwise(F.col("before")))
             .groupBy("file", "owner").agg(F.sort_array(F.collect_list(F.struct("block", "number", "record"))).alias("all"))
             .select("file", F.col("owner").alias("block"), F.get("all", F.lit(0))["number"].alias("number"),
                     F.array_join(F.transform("all", lambda x: x["record"]), "\n").alias("record")))
    return whole.union(edges).select(
        "file", ((F.col("block") == 0) & (F.col("number") == 1)).alias("header"),
        F.regexp_replace("record", r"\r$", "").alias("record"))


def _too_long(df: DataFrame, delimiter: str) -> Column:
    """A malformed line with more fields than the header; shorter lines are padded."""
    fields = F.size(F.split(_outside_quotes(F.col(CORRUPT)), re.escape(delimiter)))
    return F.col(CORRUPT).isNotNull() & (fields > len(df.columns) - 1)


def named_columns(df: DataFrame) -> DataFrame:
    """Without columns whose header is blank or starts with Unnamed."""
    return df.select([col(c) for c in df.columns
                      if not re.match(r"^(_c\d+$|Unnamed|\s*$)", c)])


def drop_empty(df: DataFrame) -> DataFrame:
    """Without columns that are null everywhere, then without rows that are null
    everywhere. One aggregate finds the columns."""
    counts = df.agg(*[F.count(col(c)).alias(f"c{i}") for i, c in enumerate(df.columns)]).first()
    kept = [c for i, c in enumerate(df.columns) if counts[i] > 0]
    return df.select([col(c) for c in kept]).na.drop("all")


def _by_format(spark: SparkSession, path: str) -> list[tuple[str, str, bool, list[str]]]:
    """Distinct formats and headers with their files; a uniform directory is read as a
    whole. The driver gets one row per file, as it does for Spark's own file index."""
    groups: dict[tuple[str, str, str, bool], list[str]] = {}
    for r in file_formats(spark, path).collect():
        groups.setdefault((r.delimiter, r.encoding, r.header or "", bool(r.broken)), []).append(r.file)
    if len(groups) == 1:
        delimiter, encoding, _, broken = next(iter(groups))
        return [(delimiter, encoding, broken, [path])]
    return [(d, e, broken, sorted(files)) for (d, e, _, broken), files in sorted(groups.items())]


def read_raw(spark: SparkSession, path: str) -> list[tuple[DataFrame, str]]:
    """Rows per format and header. Files with records over several lines stay splittable too:
    their records are found block by block."""
    return [(_read(spark, files, delimiter, encoding, broken), delimiter)
            for delimiter, encoding, broken, files in _by_format(spark, path)]


def read_csv(spark: SparkSession, path: str, infer: bool = True,
             rows: int | None = None) -> DataFrame:
    """A clean table from a CSV file or a directory of them; columns meet by name.

    Over-long lines are skipped, null tokens become null, blank-header columns, empty
    columns and empty rows are dropped; ``infer`` gives columns their types."""
    parts = []
    for raw, delimiter in read_raw(spark, path):
        good = raw.where(~F.coalesce(_too_long(raw, delimiter), F.lit(False))).drop(CORRUPT)
        parts.append(named_columns(good))
    table = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    if rows is not None:
        table = table.limit(rows)
    table = null_tokens(table)
    return infer_types(table, drop_empty=True).na.drop("all") if infer else drop_empty(table)


def malformed_lines(spark: SparkSession, path: str) -> DataFrame:
    """How many over-long lines the reader skips, and how many lines it keeps."""
    parts = []
    for raw, delimiter in read_raw(spark, path):
        skip = F.coalesce(_too_long(raw, delimiter), F.lit(False))
        parts.append(raw.agg(
            F.count_if(skip).alias("skipped_lines"),
            F.count(F.when(~skip, F.struct(col(raw.columns[0])))).alias("kept_lines")))
    return reduce(DataFrame.unionByName, parts).agg(
        F.sum("skipped_lines").alias("skipped_lines"), F.sum("kept_lines").alias("kept_lines"))
