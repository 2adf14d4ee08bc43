"""Bulk reading of delimited files: charset, dialect, header, ragged rows, limits, run report.

A file is one row until its records are known, so charset, dialect, width and header need no shuffle.
Only then the records are exploded. `max_bytes` bounds that row, and `max_rows` the rows of a file;
both refuse whole files, so both are off unless the caller sets them (`fixed.MAX_FILE_BYTES` and
`fixed.MAX_ROWS` are customary).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fairledger.functions import fixed as K
from fairledger.functions.text import classify_trimmed, csv_escape, js_trim
from fairledger.plans.staging import stage
from fairledger.scope import VERSION

NEWLINE = r"\r\n|\n|\r"
# Noncharacters, which text cannot hold: they stand for record and field ends outside quotes.
# A third stands for a quote within a bare field, or within a quoted one where it should be doubled.
RECORD_END, FIELD_END, STRAY = "\ufdd0", "\ufdd1", "\ufdd2"
BAD_QUOTES = "Quotes are not well formed"
# windows-1252 where it differs from ISO-8859-1: bytes 80..9F, unassigned ones as U+FFFD.
CP1252 = (
    "\u20ac\ufffd\u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\ufffd\u017d"
    "\ufffd\ufffd\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\ufffd"
    "\u017e\u0178"
)


@dataclass
class Ingested:
    runs: DataFrame  # one row per file
    columns: DataFrame  # VERSION, col_idx, column_name
    rows: DataFrame  # VERSION, row_number, fields
    rejected: DataFrame  # VERSION, row_number, raw_content, reason


def read_files(
    spark: SparkSession, paths: list[str] | str, max_bytes: int | None = None
) -> DataFrame:
    """(path, filename, length, content) of all files; content of oversized ones is not read."""
    files = spark.read.format("binaryFile").load(paths)
    if max_bytes is None:
        name = F.element_at(F.split("path", "/"), -1).alias("filename")
        return files.select("path", name, "length", "content")
    name = F.element_at(F.split("path", "/"), -1).alias("filename")
    fit = files.where(F.col("length") <= max_bytes).select("path", name, "length", "content")
    over = files.where(F.col("length") > max_bytes).select(
        "path", name, "length", F.lit(None).cast("binary").alias("content")
    )
    return fit.unionByName(over)


def detect_format(filename: Column) -> Column:
    return F.when(F.lower(filename).rlike(r"\.xlsx?\z"), "xlsx").otherwise("csv")


def encoding_of(content: Column) -> Column:
    return F.when(F.is_valid_utf8(content.cast("string")), "UTF-8").otherwise("windows-1252")


def raw_text(content: Column, encoding: Column) -> Column:
    latin = F.decode(content, "ISO-8859-1")
    high = "".join(chr(c) for c in range(0x80, 0xA0))
    return F.when(encoding == "UTF-8", content.cast("string")).otherwise(
        F.translate(latin, high, CP1252)
    )


def decode(content: Column, encoding: Column) -> Column:
    """Text without byte order mark."""
    return _bind(raw_text(content, encoding), lambda t: F.when(
        t.startswith("\ufeff"), F.substring(t, 2, 2147483647)).otherwise(t))


def _bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` with `value` computed once, however often `body` mentions it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _occurrences(text: Column, part: Column) -> Column:
    """How often `part` stands in the text. Bytes are counted, as characters would need a pass each."""
    less = F.octet_length(text) - F.octet_length(F.replace(text, part, F.lit("")))
    return (less / F.octet_length(part)).cast("int")


def _count_of(values: Column, value: Column) -> Column:
    """How many of the values are this one, without a lambda for each of them."""
    return F.size(values) - F.size(F.array_remove(values, value))


def _mode(numbers: Column) -> Column:
    """struct(n, rank, v) of the most frequent number; the one seen first wins ties."""
    return _bind(numbers, lambda all_: F.array_max(F.transform(
        F.array_distinct(all_),
        lambda v, i: F.struct(
            _count_of(all_, v).alias("n"), (-i).alias("rank"), v.alias("v")
        ),
    )))


def detect_delimiter(text: Column) -> Column:
    """Delimiter that splits the first 20 filled lines most evenly into most fields."""
    # a line end of two characters gives a blank line here, and blank ones do not count
    lines = F.slice(
        F.filter(F.split(text, r"[\r\n]"), lambda x: js_trim(x) != ""), 1, K.DIALECT_LINES
    )

    def scored(sample: Column) -> Column:
        def candidate(order: int, mark: str) -> Column:
            widths = F.transform(sample, lambda x: _occurrences(x, F.lit(mark)) + 1)
            return _bind(_mode(widths), lambda m: F.struct(
                F.when(m["v"] > 1, m["n"] / F.size(sample) * m["v"]).otherwise(-1.0).alias("s"),
                F.lit(-order).alias("rank"), F.lit(mark).alias("mark"),
            ))
        return F.array_max(F.array(*[candidate(i, d) for i, d in enumerate(K.DELIMITERS)]))

    best = _bind(lines, scored)
    return F.coalesce(_bind(best, lambda b: F.when(b["s"] > 0, b["mark"])), F.lit(","))


def holds_marks(text: Column) -> Column:
    """Does the text hold one of the noncharacters that stand for ends and strays?"""
    found = [F.contains(text, F.lit(m)) for m in (RECORD_END, FIELD_END, STRAY)]
    return found[0] | found[1] | found[2]


def _marked_strays(text: Column, delimiter: Column) -> Column:
    """Quotes that neither open nor close a field, nor stand beside another, as marks.

    The pattern begins with the quote, so that no other character is looked at twice.
    """
    other = F.concat(F.lit('[^\r\n"'), delimiter, F.lit("]"))
    pattern = F.concat(F.lit('"(?<='), other, F.lit('")(?='), other, F.lit(")"))
    return F.when(
        F.contains(text, F.lit('"')), F.regexp_replace(text, pattern, F.lit(STRAY))).otherwise(text)


def split_records(text: Column, delimiter: Column) -> Column:
    """Records of the text, field ends marked. Quoted delimiters and line ends stay in the field.

    Cutting at every quote that is none of the strays makes each second piece the inside of quotes,
    in one linear pass. The first line end outside quotes is the file's only kind.
    """
    def cut(pieces: Column) -> Column:
        outside = F.filter(pieces, lambda p, i: (i % 2 == 0) & p.rlike(NEWLINE))
        end = F.coalesce(
            F.regexp_extract(F.get(outside, F.lit(0)), f"({NEWLINE})", 1), F.lit("\n")
        )

        def mark(piece: Column, i: Column, end: Column) -> Column:
            bare = F.replace(F.replace(piece, end, F.lit(RECORD_END)), delimiter, F.lit(FIELD_END))
            return F.when(i % 2 == 0, bare).otherwise(piece)

        return _bind(end, lambda e: F.array_join(
            F.transform(pieces, lambda p, i: mark(p, i, e)), '"'))

    marked = _bind(F.split(_marked_strays(text, delimiter), '"'), cut)
    return F.filter(F.split(marked, RECORD_END), lambda r: r != "")


def mark_fields(record: Column, delimiter: Column) -> Column:
    """One record with field ends and stray quotes marked, as `split_records` gives it."""
    pieces = F.split(_marked_strays(record, delimiter), '"')
    return F.array_join(F.transform(pieces, lambda p, i: F.when(
        i % 2 == 0, F.replace(p, delimiter, F.lit(FIELD_END))).otherwise(p)), '"')


def quotes_of(text: Column, delimiter: Column) -> Column:
    """How many quotes open or close a field, or stand beside another."""
    return _occurrences(_marked_strays(text, delimiter), F.lit('"'))


def judged(record: Column) -> Column:
    """struct(r, w, bad): a record with marked fields, its width, and whether its quotes are misplaced."""
    bad = F.contains(record, F.lit(STRAY)) | (
        F.contains(record, F.lit('"')) & F.exists(F.split(record, FIELD_END), _bad_quotes))
    return F.struct(record.alias("r"), _width(record).alias("w"), bad.alias("bad"))


def column_names(header: Column) -> Column:
    """Names of the fields of a header, by their place where they are blank."""
    return F.transform(header, lambda n, i: F.coalesce(
        F.nullif(js_trim(n), F.lit("")), F.concat(F.lit("column_"), (i + 1).cast("string"))))


def default_names(width: Column) -> Column:
    return F.transform(
        F.sequence(F.lit(1), width), lambda i: F.concat(F.lit("column_"), i.cast("string")))


def shown(record: Column, delimiter: Column) -> Column:
    """A marked record as it stood in the file."""
    return F.replace(F.replace(record, F.lit(FIELD_END), delimiter), F.lit(STRAY), F.lit('"'))


def reason_of(bad: Column, width: Column, found: Column) -> Column:
    return F.when(bad, BAD_QUOTES).otherwise(F.concat(
        F.lit("Expected "), width.cast("string"), F.lit(" field(s), found "), found.cast("string")))


def _width(record: Column) -> Column:
    return _occurrences(record, F.lit(FIELD_END)) + 1


def _unquote(field: Column) -> Column:
    inner = F.substr(field, F.lit(2), F.length(field) - 2)
    return F.when(
        field.startswith('"'), F.replace(inner, F.lit('""'), F.lit('"'))
    ).otherwise(field)


def fields_of(record: Column) -> Column:
    return F.transform(F.split(record, FIELD_END), _unquote)


def _bad_quotes(field: Column) -> Column:
    """A quote inside a bare field, or text after a closing quote."""
    inner = F.replace(
        F.substr(field, F.lit(2), F.length(field) - 2), F.lit('""'), F.lit("")
    )
    closed = (
        field.startswith('"') & field.endswith('"') & (F.length(field) >= 2)
        & ~F.contains(inner, F.lit('"'))
    )
    return F.contains(field, F.lit('"')) & ~closed


def _type_of(values: Column) -> Column:
    """Type that more than half of the filled values have, else string."""
    def vote(types: Column) -> Column:
        chain = F
        for t in K.TYPES[:-1]:
            chain = chain.when(_count_of(types, F.lit(t)) * 2 > F.size(types), t)
        return chain.otherwise("string")

    filled = F.filter(F.transform(values, js_trim), lambda v: v != "")
    return _bind(F.transform(filled, classify_trimmed), vote)


def detect_header(accepted: Column, width: Column) -> Column:
    """Is the first record a header: does it differ in type from the typed columns below it?"""
    top = F.transform(F.slice(accepted, 1, K.HEADER_ROWS + 1), fields_of)

    def column_vote(top: Column, i: Column) -> Column:
        column = F.transform(top, lambda r: F.get(r, i))
        below = F.filter(F.slice(column, 2, K.HEADER_ROWS), lambda v: v != "")
        return F.struct(
            _type_of(below).alias("type"),
            classify_trimmed(js_trim(F.get(F.get(top, F.lit(0)), i))).alias("head"),
        )

    # the fields are cut once, not once for each column
    votes = _bind(top, lambda t: F.transform(
        F.sequence(F.lit(0), width - 1), lambda i: column_vote(t, i)))

    def decide(all_: Column) -> Column:
        typed = F.filter(all_, lambda v: v["type"] != "string")
        differing = F.filter(typed, lambda v: v["type"] != v["head"])
        return (F.size(typed) == 0) | (F.size(differing) * 2 >= F.size(typed))

    return F.when(F.size(accepted) == 0, False).when(F.size(accepted) < 2, True).otherwise(
        _bind(votes, decide)
    )


def _accepted() -> Column:
    """The records with well-formed quotes and as many fields as the file is wide."""
    return F.transform(
        F.filter("records", lambda x: ~x["bad"] & (x["w"] == F.col("width"))), lambda x: x["r"])


def parse(
    files: DataFrame, max_bytes: int | None = None, max_rows: int | None = None
) -> DataFrame:
    """One row per file with its dialect, records, first accepted record (`head`), counts and verdict.

    files: VERSION, filename, length, content. A record with misplaced quotes is rejected by itself,
    and has no say in the width.
    """
    fits = F.lit(True) if max_bytes is None else F.col("length") <= max_bytes
    opened = files.withColumn("source_format", detect_format(F.col("filename"))).withColumn(
        "readable", (F.col("source_format") == "csv") & fits
    )
    decoded = opened.withColumn(
        "detected_encoding", F.when(F.col("readable"), encoding_of(F.col("content")))
    ).withColumn(
        "text", F.when(F.col("readable"), decode(F.col("content"), F.col("detected_encoding")))
    )

    good = F.filter("records", lambda x: ~x["bad"])
    cut = (
        decoded.withColumn(
            "detected_delimiter",
            F.when(F.col("text").isNotNull(), detect_delimiter(F.col("text"))),
        )
        .withColumn(
            "records",
            F.transform(split_records(F.col("text"), F.col("detected_delimiter")), judged),
        )
        .withColumn("width", _mode(F.transform(good, lambda x: x["w"]))["v"])
        .withColumn("accepted", _accepted())
        .withColumn("has_header", detect_header(F.col("accepted"), F.col("width")))
        .withColumn("n_records", F.size("records"))
        .withColumn("n_accepted", F.size("accepted") - F.col("has_header").cast("int"))
        .withColumn("n_rejected", F.size("records") - F.size("accepted"))
    )
    total = F.col("n_accepted") + F.col("n_rejected")
    error = F.when(F.col("source_format") == "xlsx", "Workbooks are not read").when(
        F.col("readable") & F.col("content").isNull(), "File has no content"
    ).when(
        holds_marks(F.col("text")), "File holds noncharacters")
    if max_bytes is not None:
        error = F.when(
            F.col("length") > max_bytes, F.lit(f"File is larger than {max_bytes} bytes")
        ).otherwise(error)
    if max_rows is not None:
        error = F.coalesce(error, F.when(
            total > max_rows,
            F.concat(F.lit("File has "), total.cast("string"), F.lit(f" rows, limit {max_rows}")),
        ))
    return cut.withColumn("error_message", error).withColumn(
        "head", F.get("accepted", F.lit(0))).drop("text", "content", "readable", "accepted")


def runs_of(parsed: DataFrame) -> DataFrame:
    ok = F.col("error_message").isNull()
    counted = F.col("n_records").isNotNull() & (
        ok | F.col("error_message").startswith("File has")
    )
    return parsed.select(
        *VERSION, "filename", F.when(ok, "completed").otherwise("failed").alias("status"),
        "source_format", "detected_encoding", "detected_delimiter",
        F.when(counted, F.col("has_header")).alias("has_header"),
        F.when(counted, F.col("n_accepted") + F.col("n_rejected")).alias("row_count"),
        F.when(ok, F.col("n_accepted")).alias("accepted_row_count"),
        F.when(ok, F.col("n_rejected")).alias("rejected_row_count"),
        "error_message",
    )


def _split_up(parsed: DataFrame) -> Ingested:
    good = parsed.where(F.col("error_message").isNull())
    fits = _accepted()
    data = F.when(F.col("has_header"), F.slice(fits, 2, F.greatest(F.col("n_records"), F.lit(1))))
    rows = good.select(
        *VERSION, F.posexplode(data.otherwise(fits)).alias("pos", "record")
    ).select(
        *VERSION, (F.col("pos") + 1).cast("long").alias("row_number"),
        fields_of(F.col("record")).alias("fields"),
    )
    default, names = default_names(F.col("width")), column_names(fields_of(F.col("head")))
    columns = good.where(F.col("width") > 0).select(
        *VERSION,
        F.posexplode(F.when(F.col("has_header"), names).otherwise(default)).alias(
            "col_idx", "column_name"
        ),
    )
    refused = F.filter(
        F.transform("records", lambda x, i: F.struct(
            (i + 1).cast("long").alias("row_number"), x["r"].alias("r"), x["w"].alias("w"),
            x["bad"].alias("bad"),
        )),
        lambda x: x["bad"] | (x["w"] != F.col("width")),
    )
    rejected = good.select(
        *VERSION, "width", "detected_delimiter", F.explode(refused).alias("x")
    ).select(
        *VERSION, "x.row_number",
        shown(F.col("x.r"), F.col("detected_delimiter")).alias("raw_content"),
        reason_of(F.col("x.bad"), F.col("width"), F.col("x.w")).alias("reason"),
    )
    return Ingested(runs_of(parsed), columns, rows, rejected)


def ingest(
    files: DataFrame, max_bytes: int | None = None, max_rows: int | None = None
) -> Ingested:
    """Parse all files once, write the result to the shared folder and open its four tables."""
    return _split_up(stage(parse(files, max_bytes, max_rows)))


def rejected_report(rejected: DataFrame) -> DataFrame:
    """Lines of the rejected-row report, by row, with a field quoted where it must be."""
    return rejected.select(
        *VERSION, "row_number",
        F.concat_ws(
            ",", F.col("row_number").cast("string"), csv_escape(F.col("reason")),
            csv_escape(F.col("raw_content")),
        ).alias("line"),
    ).orderBy(*VERSION, "row_number")


def write_rejected(rejected: DataFrame, path: str) -> None:
    """The report as CSV files, one folder per version; other versions' reports stay."""
    rejected.select(*VERSION, "row_number", "reason", "raw_content").repartitionByRange(
        *VERSION, "row_number"
    ).sortWithinPartitions(*VERSION, "row_number").write.mode("overwrite").option(
        "partitionOverwriteMode", "dynamic"
    ).partitionBy(*VERSION).csv(path, header=True, escape='"')
