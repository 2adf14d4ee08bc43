"""Delimited files of any size, cut into records by many tasks at once.

Spark reads a file in byte ranges, each by a task of its own, as lines. Whether a line end is the end
of a record depends on all quotes before it, so on other ranges. A range is therefore summed up by
what it does to a state that it does not know, inside or outside quotes: an odd number of quotes
swaps it, an even one keeps it. A running sum over the ranges of a file, a few numbers each, tells
in which state each one is entered, and then all of them are cut at the same time. A record that
goes on in the next range, or over several, is put together from its lines. No row holds more than a
record, and no task more than a range.

The records are those of `delimited.ingest`, except that a file whose first line end outside quotes is
a lone carriage return is refused, as Spark does not read such files in ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fairledger.functions import fixed as K
from fairledger.functions.text import js_trim
from fairledger.plans.staging import stage
from fairledger.scope import VERSION
from fairledger.sources import delimited as D

LONE = "Line ends are lone carriage returns"
AT = ["path", "range"]


def listed(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """(path, filename, length) of all files that have content, which is not read; Spark lists no others."""
    name = F.element_at(F.split("path", "/"), -1).alias("filename")
    return spark.read.format("binaryFile").load(paths).select("path", name, "length")


def lines_of(files: DataFrame) -> DataFrame:
    """A written table of the lines of the files in `path`: path, size (of the file), range (its first
    byte), line, content.

    Numbers of lines grow along a range and follow each other. Only the names of the files come to
    the driver.
    """
    spark, paths = files.sparkSession, [r["path"] for r in files.select("path").distinct().collect()]
    if not paths:
        return stage(spark.createDataFrame(
            [], "path string, size long, range long, line long, content binary"))
    # the name that Spark keeps with a line is a URI; that of a listed file is not
    uri = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    return stage(spark.read.option("lineSep", "\n").text(paths).select(
        F.regexp_replace(uri, r"^(\w+):/+", "$1:/").alias("path"),
        F.col("_metadata.file_size").alias("size"), F.col("_metadata.file_block_start").alias("range"),
        F.monotonically_increasing_id().alias("line"), F.col("value").cast("binary").alias("content")))


def _before(*keys: str) -> Window:
    return Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)


def _texts(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lines with text, delimiter and `closed` (the file's last line has a line end), and the files: path,
    encoding, delimiter, forbidden."""
    # the reader leaves out the three bytes of a byte order mark, which are text in windows-1252
    beyond = F.max("size") - F.sum(F.octet_length("content") + 1)
    known = stage(lines.groupBy("path").agg(
        F.when(F.bool_and(F.is_valid_utf8(F.col("content").cast("string"))), "UTF-8").otherwise(
            "windows-1252").alias("detected_encoding"),
        F.min(F.struct("range", "line")).alias("head"),
        beyond.isin(0, 3).alias("closed"), (beyond >= 2).alias("marked")))
    at_head = (F.col("range") == F.col("head.range")) & (F.col("line") == F.col("head.line"))
    whole = F.when(at_head & F.col("marked"), F.concat(F.lit(b"\xef\xbb\xbf"), "content")).otherwise(
        F.col("content"))
    plain = lines.join(known, "path").withColumn("content", whole).withColumn("text", F.when(
        at_head, D.decode(F.col("content"), F.col("detected_encoding"))
    ).otherwise(D.raw_text(F.col("content"), F.col("detected_encoding")))).drop(
        "content", "head", "size", "marked")
    filled = plain.where(js_trim(F.col("text")) != "").withColumn("n", F.row_number().over(
        Window.partitionBy("path").orderBy("range", "line"))).where(F.col("n") <= K.DIALECT_LINES)
    sample = F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), "\n")
    files = plain.groupBy("path", "detected_encoding").agg(F.bool_or(F.col("text").rlike(
        f"[{D.RECORD_END}{D.FIELD_END}{D.STRAY}]")).alias("forbidden")
    ).join(filled.groupBy("path").agg(sample.alias("sample")), "path", "left")
    files = stage(files.select(
        "path", "detected_encoding", "forbidden",
        D.detect_delimiter(F.coalesce("sample", F.lit(""))).alias("detected_delimiter")))
    return plain.drop("detected_encoding").join(files.select("path", "detected_delimiter"), "path"), files


def _kind(text: Column, delimiter: Column, entry: Column, outside: Column) -> Column:
    """The first line end of a line that stands outside quotes, if one does."""
    pieces = F.split(D._marked_strays(text, delimiter), '"')
    lone = F.exists(F.transform(pieces, lambda p, i: ((i + entry) % 2 == 0) & F.when(
        i < F.size(pieces) - 1, F.contains(p, F.lit("\r"))).otherwise(p.rlike(r"\r(?!\z)"))), lambda x: x)
    return F.when(lone, "\r").when(outside, F.when(text.endswith("\r"), "\r\n").otherwise("\n"))


def _ended(lines: DataFrame) -> DataFrame:
    """A written table of the lines with `kind`, the line end of their file, and `ends`: does the line
    end a record."""
    within = Window.partitionBy(*AT).orderBy("line")
    counted = stage(lines.withColumn("quotes", D.quotes_of(F.col("text"), F.col("detected_delimiter"))))
    entries = stage(counted.groupBy(*AT).agg(F.sum("quotes").alias("quotes")).select(
        *AT, F.coalesce(F.sum("quotes").over(_before("path")), F.lit(0)).alias("entry")))
    told = counted.join(entries, AT).withColumn(
        "entry", F.col("entry") + F.sum("quotes").over(within) - F.col("quotes")
    ).withColumn("outside", (F.col("entry") + F.col("quotes")) % 2 == 0)
    kinds = told.select(*AT, "line", _kind(
        F.col("text"), F.col("detected_delimiter"), F.col("entry"), F.col("outside")).alias("kind"))
    kinds = stage(kinds.where("kind is not null").groupBy("path").agg(
        F.min_by("kind", F.struct("range", "line")).alias("kind")))
    ends = F.col("outside") & ((F.col("kind") == "\n") | F.col("text").endswith("\r"))
    return stage(told.join(kinds, "path", "left").select(
        *AT, "line", "text", "detected_delimiter", "kind", "closed", F.coalesce(ends, F.lit(False)).alias("ends")))


def _handed_on(ended: DataFrame) -> DataFrame:
    """For each range the place (range, line) of the record that it is entered in, null between two.

    A range with a record's end leaves open what follows its last one. One without hands on what it
    is given, or opens a record at its own first line if it is given none.
    """
    last = F.max(F.when(F.col("ends"), F.col("line")))
    spans = ended.groupBy(*AT).agg(
        last.alias("last_end"), F.max("line").alias("last"), F.min("line").alias("first"))
    leaves = F.when(F.col("last_end").isNotNull(), F.struct("range", F.when(
        F.col("last_end") < F.col("last"), F.col("last_end") + 1).alias("line")))
    known = spans.withColumn("left", leaves).withColumn(
        "known", F.last("left", ignorenulls=True).over(_before("path"))
    ).withColumn("since", F.coalesce("known.range", F.lit(-1)))
    opened = F.min(F.struct("range", F.col("first").alias("line"))).over(_before("path", "since"))
    return stage(known.select(
        *AT, "first", F.when(F.col("known.line").isNotNull(), F.col("known")).otherwise(opened).alias("given")))


def records_of(lines: DataFrame) -> DataFrame:
    """A written table of the records that are not empty: path, range and line where each begins,
    delimiter, kind, and r, w, bad as in `delimited.judged`."""
    ended = _ended(lines)
    order = Window.partitionBy(*AT).orderBy("line")
    after = ended.withColumn("after", F.lag("ends").over(order)).withColumn(
        "began", F.max(F.when(F.col("after"), F.col("line"))).over(order))
    placed = after.join(_handed_on(ended), AT).withColumn("place", F.when(
        F.col("began").isNotNull(), F.struct("range", F.col("began").alias("line"))
    ).otherwise(F.coalesce("given", F.struct("range", F.col("first").alias("line")))))
    clean = F.when(F.col("ends") & (F.col("kind") == "\r\n"), F.regexp_replace("text", r"\r\z", "")).otherwise(
        F.col("text"))
    file = ["path", "place", "detected_delimiter", "kind"]
    placed = placed.withColumn("text", clean).withColumn(
        "alone", F.col("ends") & (F.col("place.line") == F.col("line")))
    alone = placed.where("alone").select(*file, "text")
    # quotes that are never closed hold the last line end of the file, too
    rest = F.when(~F.bool_or("ends") & F.bool_and("closed"), "\n").otherwise("")
    joined = placed.where("not alone").groupBy(*file).agg(F.concat(F.array_join(F.transform(
        F.array_sort(F.collect_list(F.struct("range", "line", "text"))), lambda x: x["text"]), "\n"), rest
    ).alias("text"))
    return stage(alone.unionByName(joined).where("text <> ''").select(
        "path", "place.range", "place.line", "detected_delimiter", "kind",
        D.judged(D.mark_fields(F.col("text"), F.col("detected_delimiter"))).alias("x")
    ).select("*", "x.*").drop("x"))


def ingest(files: DataFrame) -> D.Ingested:
    """Runs, columns, rows and rejected rows of files: VERSION, path as in `listed`, filename, length.

    Files without lines are complete and have no rows. A file of another format, one that holds
    noncharacters and one with lone carriage returns fail by themselves.
    """
    files = stage(files.withColumn("source_format", D.detect_format(F.col("filename"))))
    lines, read = _texts(lines_of(files.where("source_format = 'csv'")))
    records = records_of(lines)
    widths = stage(records.where("not bad").groupBy("path", "w").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("range", "line")).alias("first"))
        .groupBy("path").agg(F.min_by("w", F.struct(-F.col("n"), "first")).alias("width")))
    judged = records.join(widths, "path", "left").withColumn(
        "fits", F.coalesce(~F.col("bad") & (F.col("w") == F.col("width")), F.lit(False)))
    top = judged.where("fits").withColumn("n", F.row_number().over(
        Window.partitionBy("path").orderBy("range", "line"))).where(F.col("n") <= K.HEADER_ROWS + 1)
    heads = stage(top.groupBy("path", "width").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("n", "r"))), lambda x: x["r"]).alias("accepted")
    ).select("path", "width", F.get("accepted", F.lit(0)).alias("head"),
             D.detect_header(F.col("accepted"), F.col("width")).alias("has_header")))
    # records are numbered in their range and moved on by what the ranges before hold
    counts = judged.groupBy(*AT).agg(F.count(F.lit(1)).alias("n"), F.count_if("fits").alias("m"))
    moved = stage(counts.select(*AT, *[
        F.coalesce(F.sum(c).over(_before("path")), F.lit(0)).alias(f"{c}_before") for c in "nm"]))
    order = Window.partitionBy(*AT).orderBy("line")
    numbered = judged.join(moved, AT).withColumn(
        "n", F.row_number().over(order) + F.col("n_before")).withColumn(
        "m", F.sum(F.col("fits").cast("long")).over(order) + F.col("m_before"))
    totals = judged.groupBy("path").agg(
        F.count_if("fits").alias("m"), F.count_if(~F.col("fits")).alias("n_rejected"),
        F.max("kind").alias("kind"))
    error = F.when(F.col("source_format") == "xlsx", "Workbooks are not read").when(
        F.col("forbidden"), "File holds noncharacters").when(F.col("kind") == "\r", LONE)
    none = F.lit(0).cast("int")
    known = stage(files.join(read, "path", "left").join(totals, "path", "left").join(heads, "path", "left").select(
        *VERSION, "path", "filename", "source_format", "width", "head",
        F.when(F.col("source_format") == "csv", F.coalesce("detected_encoding", F.lit("UTF-8"))).alias(
            "detected_encoding"),
        F.when(F.col("source_format") == "csv", F.coalesce("detected_delimiter", F.lit(","))).alias(
            "detected_delimiter"),
        F.coalesce("has_header", F.lit(False)).alias("has_header"),
        F.coalesce(F.col("m").cast("int"), none).alias("m"),
        F.coalesce(F.col("n_rejected").cast("int"), none).alias("n_rejected"),
        error.alias("error_message"),
    ).withColumn("n_accepted", F.col("m") - F.col("has_header").cast("int")).withColumn(
        "n_records", F.when(F.col("source_format") == "csv", F.col("m") + F.col("n_rejected"))))
    done = known.where("error_message is null")
    of = done.select(*VERSION, "path", "has_header")
    rows = numbered.where("fits").join(of, "path").withColumn(
        "row_number", F.col("m") - F.col("has_header").cast("long")).where("row_number > 0").select(
        *VERSION, "row_number", D.fields_of(F.col("r")).alias("fields"))
    columns = done.where("width > 0").select(*VERSION, F.posexplode(F.when(
        F.col("has_header"), D.column_names(D.fields_of(F.col("head")))
    ).otherwise(D.default_names(F.col("width")))).alias("col_idx", "column_name"))
    rejected = numbered.where("not fits").join(of, "path").select(
        *VERSION, F.col("n").cast("long").alias("row_number"),
        D.shown(F.col("r"), F.col("detected_delimiter")).alias("raw_content"),
        D.reason_of(F.col("bad"), F.col("width"), F.col("w")).alias("reason"))
    return D.Ingested(D.runs_of(known), columns, rows, rejected)
