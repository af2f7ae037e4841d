"""Sensor logs as text: metadata, encoding, delimiter, decimals and readings.

A file's lines may be spread over many splits.  ``scan_lines`` gives each line a sortable place
(block start, then position inside the split), from which header and leading lines follow by
aggregation; no step needs a whole file in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tempaudit.functions import clock, names
from tempaudit.functions.scalars import once
from tempaudit.session import scratch_path

DELIMITERS = (";", ",", "\t", "|")  # in order of preference on equal score
CRITICAL = ("no_header", "no_rows", "parse_failure")

# fixed values: byte-order marks as hex, longest first
BYTE_ORDER_MARKS = (("FFFE0000", "utf-32-le"), ("0000FEFF", "utf-32-be"), ("EFBBBF", "utf-8-sig"), ("FFFE", "utf-16-le"), ("FEFF", "utf-16-be"))


def scan_lines(spark: SparkSession, paths) -> DataFrame:
    """Lines of UTF-8 files with their file and place; a line that is no UTF-8 is read as latin1 (``encoding``)."""
    text = spark.read.text(paths)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"))
    good = F.is_valid_utf8("value")
    line = F.when(good, F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1"))
    return text.select(F.col("_metadata.file_path").alias("file"), place.alias("place"), line.alias("line"),
                       F.when(good, "utf-8").otherwise("latin1").alias("encoding"))


def encoding_of(content: Column) -> Column:
    """Encoding by byte-order mark; plain UTF-8 otherwise."""
    head = F.hex(F.substring(content, 1, 4))
    out = F.lit("utf-8")
    for mark, name in reversed(BYTE_ORDER_MARKS):
        out = F.when(head.startswith(mark), name).otherwise(out)
    return out


def decode_content(content: Column) -> Column:
    """Text without its mark."""
    name, skip = encoding_of(content), lambda n: F.expr(f"substring(content, {n + 1})")
    return (
        F.when(name == "utf-8-sig", F.decode(skip(3), "UTF-8")).when(name == "utf-16-le", F.decode(skip(2), "UTF-16LE"))
        .when(name == "utf-16-be", F.decode(skip(2), "UTF-16BE")).when(name.startswith("utf-32"), F.decode(content, "UTF-32"))
        .otherwise(F.decode(content, "UTF-8")))


def scan_encoded(spark: SparkSession, paths) -> DataFrame:
    """Lines of small files in any marked encoding; whole files are decoded, so not for large logs."""
    files = spark.read.format("binaryFile").load(paths)
    text = files.select(F.col("path").alias("file"), encoding_of(F.col("content")).alias("encoding"), decode_content(F.col("content")).alias("text"))
    lines = text.select("file", "encoding", F.posexplode(F.split("text", "\r?\n")).alias("n", "line"))
    return lines.select("file", "encoding", F.struct(F.lit(0).cast("long").alias("block"), F.col("n").cast("long").alias("n")).alias("place"), "line")


def metadata(lines: DataFrame) -> DataFrame:
    """``# key: value`` lines as a map per file; of a repeated key the last value stays."""
    pattern = r"^#\s*([^:]+):\s*(.+)$"
    pairs = lines.filter(F.col("line").rlike(pattern)).select(
        "file", "place", F.trim(F.regexp_extract("line", pattern, 1)).alias("k"), F.trim(F.regexp_extract("line", pattern, 2)).alias("v"))
    latest = pairs.groupBy("file", "k").agg(F.max_by("v", "place").alias("v"))
    return latest.groupBy("file").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("metadata"))


def is_data(line="line") -> Column:
    return ~F.startswith(line, F.lit("#")) & (F.trim(line) != "")


def data_lines(lines: DataFrame) -> DataFrame:
    return lines.filter(is_data())


def profiles(lines: DataFrame) -> DataFrame:
    """One row per file, from one partial aggregate over its lines: layout, how many lines hold data, how many were no UTF-8.

    The delimiter is judged on all data lines: occurrences outside quotes, halved unless equal on every line that has any.
    Where a line has more cells than the header, or the header none of the delimiter, comma is tried
    instead (``fallback``); if that fails as well, ``failed`` is set.  The time column is the first one with a
    time name, else one containing such a name, else the first.  A file without data has a null delimiter.
    """
    text = F.when(is_data(), F.col("line"))
    bare = F.when(text.contains('"'), F.regexp_replace(text, '"[^"]*"', "")).otherwise(text)
    n = {i: F.length("bare") - F.length(F.replace("bare", F.lit(d))) for i, d in enumerate(DELIMITERS)}
    there = F.col("bare").isNotNull()
    header = F.min(F.when(there, F.struct("place", "line", *[c.alias(f"n{i}") for i, c in n.items()]))).alias("h")
    figures = [f(F.when(c > 0, c)).alias(f"{name}{i}") for i, c in n.items() for name, f in (("total", F.sum), ("low", F.min), ("high", F.max))]
    latin = F.col("encoding") == "latin1" if "encoding" in lines.columns else F.lit(False)
    counted = lines.select("file", "place", "line", latin.alias("latin"), once(bare).alias("bare")).groupBy("file").agg(
        header, *figures, F.count("bare").alias("data_lines"), F.count_if("latin").alias("unreadable"))
    score = [F.struct((F.col(f"total{i}") * F.when(F.col(f"low{i}") == F.col(f"high{i}"), 1.0).otherwise(0.5)).alias("score"), F.lit(-i).alias("rank"),
                      F.lit(d).alias("d"), F.col(f"h.n{i}").alias("in_header"), F.col(f"high{i}").alias("high")) for i, d in enumerate(DELIMITERS)]
    comma = DELIMITERS.index(",")
    best = counted.select("file", "h", "data_lines", "unreadable", F.array_max(F.filter(F.array(*score), lambda x: x["score"].isNotNull())).alias("b"),
                          F.col(f"h.n{comma}").alias("commas"), F.coalesce(F.col(f"high{comma}"), F.lit(0)).alias("most_commas"))
    misfit = (F.col("b.high") > F.col("b.in_header")) & F.col("b").isNotNull()
    delimiter = F.when(F.col("h").isNotNull(), F.when(misfit | F.col("b").isNull(), ",").otherwise(F.col("b.d")))
    found = best.select("file", "data_lines", "unreadable", F.col("h.place").alias("header_place"), F.col("h.line").alias("_header"),
                        F.coalesce(misfit, F.lit(False)).alias("fallback"), delimiter.alias("delimiter"), (F.col("most_commas") > F.col("commas")).alias("_odd"))
    found = found.withColumn("failed", F.col("fallback") & F.col("_odd"))
    named = found.withColumn("names", cells_of(F.col("_header"), "delimiter"))
    indexed = F.transform("names", lambda n, i: F.struct(F.lower(n).alias("name"), i.alias("i")))
    exact = F.filter(indexed, lambda x: x["name"].isin(*names.TIME_NAMES))
    loose = F.filter(indexed, lambda x: x["name"].rlike("|".join(names.TIME_NAMES)))
    at = F.coalesce(F.get(exact, F.lit(0))["i"], F.get(loose, F.lit(0))["i"], F.lit(0))
    return named.select("file", "delimiter", "names", at.alias("time_at"), "header_place", "fallback", "failed", "data_lines", "unreadable")


def layouts(lines: DataFrame) -> DataFrame:
    """The layout of every file with data (see ``profiles``)."""
    return profiles(lines).filter("delimiter IS NOT NULL").drop("data_lines", "unreadable")


def _literal(delimiter: str) -> Column:
    return F.concat(F.lit("\\Q"), F.col(delimiter), F.lit("\\E"))


def cells_of(line: Column, delimiter: str) -> Column:
    """Trimmed cells of a line.  A delimiter inside double quotes is text; two double quotes stand for one."""
    inside = F.concat(_literal(delimiter), F.lit('(?=(?:[^"]*"[^"]*")*[^"]*$)'))
    quoted = lambda x: F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit('""'), F.lit('"'))
    bare = lambda x: F.when((F.length(x) > 1) & x.startswith('"') & x.endswith('"'), quoted(x)).otherwise(x)
    return F.when(line.contains('"'), F.transform(F.split(line, inside), lambda x: bare(F.trim(x)))).otherwise(
        F.transform(F.split(line, _literal(delimiter)), lambda x: F.trim(x)))


def delimiters(data: DataFrame) -> DataFrame:
    return layouts(data).select("file", "delimiter")


def normalize_decimals(line: Column) -> Column:
    """Decimal commas to points (1.234,56 becomes 1234.56), unless the commas separate fields."""
    # fixed values: the spellings of numbers that count as European
    plain = ~line.contains(",") | (F.trim(line) == "") | line.startswith("#") | ~line.rlike(r"\d")
    grouped = line.rlike(r"\b\d{1,3}(?:\.\d{3})+,\d{1,9}\b")
    numbers = F.regexp_extract_all(line, F.lit(r"\d+[.,]\d+(?:[.,]\d+)*"), F.lit(0))
    comma_last = F.exists(numbers, lambda x: x.rlike(r"\..*,[^.]*$"))
    european = grouped | (line.contains(",") & line.contains(".") & comma_last)
    commas_only = line.contains(",") & ~line.contains(".")
    ungrouped = F.regexp_replace(line, r"(?<=\d)\.(?=\d{3}(?:\.\d{3})*,\d{1,9}\b)", "")
    to_point = lambda x: F.regexp_replace(x, r"\b(\d+),(\d{1,9})\b", "$1.$2")
    changed = F.when(european, to_point(ungrouped)).when(commas_only, to_point(line)).otherwise(line)
    fields = F.split(changed, ",")
    words = F.size(F.filter(fields, lambda f: ~F.trim(f).rlike(r"^\d+\.?\d*$")))
    separators = (F.size(fields) > 3) & (words > 1)
    return F.when(plain | separators, line).otherwise(changed)


def _written(df: DataFrame, label: str) -> DataFrame:
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _bodies(lines: DataFrame, layout: DataFrame) -> DataFrame:
    """Lines below the header with their file's layout."""
    return data_lines(lines).join(layout, "file").filter(F.col("place") > F.col("header_place"))


def _decimal_points() -> Column:
    return F.when(F.col("delimiter") != ",", normalize_decimals(F.col("line"))).otherwise(F.col("line"))


def instant_formats(lines: DataFrame, layout: DataFrame) -> DataFrame:
    """The layout with the format that each file's instants have together."""
    body = _bodies(lines, layout).select("file", "time_at", "delimiter", F.col("line").alias("raw"))
    # only a number can be other than ISO text, and only a line whose cell there is one needs its decimals read
    cell = lambda line: F.get(cells_of(line, "delimiter"), F.col("time_at"))
    text = once(cell(F.col("raw"))).alias("raw_ts")
    body = body.select("file", "delimiter", text)
    point = F.when((F.col("delimiter") != ",") & F.col("raw_ts").contains(","), F.replace("raw_ts", F.lit(","), F.lit("."))).otherwise(F.col("raw_ts"))
    return layout.join(clock.detect_format(body.select("file", point.alias("ts_text")), "ts_text", ("file",)), "file", "left")


def readings(lines: DataFrame, zone="UTC") -> DataFrame:
    """Long-form readings of all files: ``file, place, us, ts_text, name, text, value``.

    Two small passes come first: one finds every file's layout, one the format its instants have together; each leaves a written row
    per file.  Lines are then cut and parsed once.  The rows of files meet the lines by an equi join, which is a broadcast as long as
    Spark's own limit of its size allows; beyond, a file that holds a large share of all lines is split by the adaptive skew join.
    """
    layout = _written(layouts(lines), "layouts")
    layout = _written(instant_formats(lines, layout), "formats").withColumn("ts_format", F.coalesce("ts_format", F.lit("iso")))
    cells = _bodies(lines, layout).select("file", "place", "names", "time_at", "delimiter", "ts_format", once(_decimal_points()).alias("line"))
    cells = cells.select("file", "place", "names", "time_at", "ts_format", once(cells_of(F.col("line"), "delimiter")).alias("cells"))
    timed = cells.withColumn("ts_text", F.get("cells", F.col("time_at")))
    # the instant is parsed once per line, before its cells become rows
    timed = timed.select("*", once(F.unix_micros(clock.parse(F.col("ts_text"), F.col("ts_format"), zone))).alias("us"))
    # the outer form keeps the optimizer from testing the cells a second time; no line is without cells
    long = timed.select("file", "place", "us", "ts_text", "names", "time_at", F.posexplode_outer("cells").alias("i", "text"))
    return long.filter(F.col("i") != F.col("time_at")).select(
        "file", "place", "us", "ts_text", F.get("names", F.col("i")).alias("name"), "text", F.col("text").try_cast("double").alias("value"))


def samples_of(long: DataFrame) -> DataFrame:
    """Readings as samples; the place keeps equal instants in file order."""
    return long.select(
        F.col("file").alias("run_id"), "us", F.col("place").alias("seq"),
        F.col("name").alias("sensor"), "value", "text")


def parse_status(lines: DataFrame, safe_mode=False) -> DataFrame:
    """Warnings per file and what they mean: critical ones are errors, others INDETERMINATE in safe mode.

    Lines read as latin1 (``encoding_fallback``) and lines with more cells than the header
    (``delimiter_fallback``, with commas as well ``parse_failure``) warn; text and blank cells do not.
    """
    joined = profiles(lines)
    warnings = F.array_compact(F.array(
        F.when(F.col("data_lines") == 0, F.lit("no_header")), F.when(F.col("data_lines") == 1, F.lit("no_rows")),
        F.when(F.col("unreadable") > 0, F.lit("encoding_fallback")), F.when(F.col("fallback"), F.lit("delimiter_fallback")),
        F.when(F.col("failed"), F.lit("parse_failure"))))
    return joined.select("file", warnings.alias("warnings")).withColumn(
        "status", F.when(F.arrays_overlap("warnings", F.array(*map(F.lit, CRITICAL))), "ERROR").when(
            (F.size("warnings") > 0) & F.lit(safe_mode), "INDETERMINATE").otherwise("OK"))
