"""Tables as rows of text, and rows as cells.

`rows`    (tenant_id, project_id, dataset_version_id, row_number, fields array<string>)
`columns` (tenant_id, project_id, dataset_version_id, col_idx, column_name)

Columns are keyed by position because equal header names are legal. One pair of tables holds any
number of datasets of any width, so one job handles them all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fairledger.functions import fixed as K
from fairledger.functions.text import (
    classify_trimmed, finite, is_sentinel, js_trim, shape, strict_form, to_number,
)
from fairledger.operators.merging import merge
from fairledger.scope import VERSION


def as_text(c: Column) -> Column:
    """A missing cell is the empty string."""
    return F.coalesce(c.cast("string"), F.lit(""))


#: Rows of a piece, so that the distinct values of its cells fit into the memory of a task.
PIECE_ROWS = 500_000


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash rows over all cores unless the source comes in pieces that keep them busy.

    Cells multiply rows, so one unsplittable file would keep all of that work in one task, and a large
    piece more distinct values than its memory holds. A source of more pieces than cores is left as it
    is where no piece has more than twice the share of a core, nor more than `PIECE_ROWS`: pieces of a
    Parquet file are cut by bytes, and one with few row groups fills few of them. Counting the rows of
    each piece reads no column.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    pieces = df.rdd.getNumPartitions()
    held = df.groupBy(F.spark_partition_id().alias("piece")).count().agg(
        F.max("count"), F.sum("count")).first()
    most, all_ = held[0] or 0, held[1] or 0
    if pieces >= cores and most * cores <= 2 * all_ and most <= PIECE_ROWS:
        return df
    return df.repartition(max(cores, pieces, -(-all_ // PIECE_ROWS)), *keys)


def rows_from_table(
    df: DataFrame, tenant_id: str, project_id: str, version_id: str, row_number: Column,
    columns: list[str],
) -> DataFrame:
    """Bring an ordinary table into row form; `row_number` must be unique in the table."""
    return df.select(
        F.lit(tenant_id).alias("tenant_id"),
        F.lit(project_id).alias("project_id"),
        F.lit(version_id).alias("dataset_version_id"),
        row_number.cast("long").alias("row_number"),
        F.array(*[as_text(F.col(c)) for c in columns]).alias("fields"),
    )


def columns_from_table(
    df: DataFrame, tenant_id: str, project_id: str, version_id: str, columns: list[str]
) -> DataFrame:
    return df.sparkSession.createDataFrame(
        [(tenant_id, project_id, version_id, i, name) for i, name in enumerate(columns)],
        "tenant_id string, project_id string, dataset_version_id string, col_idx int, "
        "column_name string",
    )


def cells(rows: DataFrame) -> DataFrame:
    """One row per cell."""
    return rows.select(
        *VERSION, "row_number", F.posexplode("fields").alias("col_idx", "raw")
    )


#: What is known of one value, a bit of `marks` each, in this order.
MARKS = (
    ["filled"] + [f"n_{t}" for t in K.TYPES]
    + ["strict", "n_sentinel", "m_email", "m_url", "m_currency", "m_country", "m_phone", "m_percent"]
)


def _bit(*marks: str) -> int:
    return sum(1 << MARKS.index(m) for m in marks)


def _strict_date(v: Column) -> Column:
    """Is a text of the class date a plain ISO date?"""
    return (F.length(v) == 10) & (F.substring(v, 5, 1) == "-")


def _marks(v: Column, class_: Column, number: Column) -> Column:
    """The facts about one trimmed value.

    The class has settled most of them: what a number or a date can be is told by a few characters.
    Only text goes through the patterns, and a cheap test comes before each of them.
    """
    def bit(cond: Column, mark: str) -> Column:
        return F.when(cond, _bit(mark)).otherwise(0)

    def all_of(type_: str, *terms: Column) -> Column:
        return reduce(Column.bitwiseOR, terms, F.lit(_bit("filled", f"n_{type_}")))

    first, length = F.substring(v, 1, 1), F.length(v)
    sign = F.when(first == "-", 1).otherwise(0)
    lead = F.when(first == "-", F.substring(v, 2, 1)).otherwise(first)
    percent = bit(number.between(0.0, 100.0), "m_percent")

    def phone(digits: Column) -> Column:
        return bit(length.between(7, 20) & (digits >= 7), "m_phone")

    bare = js_trim(F.regexp_replace(v, r"\A([^%]*)%", "$1"))  # without its first percent sign
    bare_percent = F.coalesce(F.abs(to_number(bare) - 50) <= 50, bare == "")
    digits = length - F.length(F.translate(v, "0123456789", ""))
    text = all_of(
        "string",
        # a sentinel has 7 letters at most, and a letter 3 bytes at most where its lower case has one
        bit((F.octet_length(v) <= 21) & is_sentinel(v), "n_sentinel"),
        bit(v.contains("@") & v.rlike(K.EMAIL), "m_email"),
        F.when((F.octet_length(v) == 3) & v.isin(K.CURRENCY_CODES), _bit("m_currency"))
        .when((F.octet_length(v) == 2) & v.isin(K.COUNTRY_CODES), _bit("m_country"))
        .when(first.between("(", "9") & length.between(7, 20) & (digits >= 7) & v.rlike(K.PHONE),
              _bit("m_phone"))
        .when((F.lower(F.substring(v, 1, 4)) == "http") & v.rlike(K.URL), _bit("m_url"))
        .otherwise(0),
        F.when(v.contains("%"), bit(bare_percent, "m_percent")).otherwise(percent),
    )
    return (
        F.when(class_ == "integer", all_of(
            "integer", bit((v == "0") | lead.between("1", "9"), "strict"), phone(length - sign), percent))
        .when(class_ == "decimal", all_of(
            "decimal", bit(F.substring(v, -3, 1) == ".", "strict"), phone(length - sign - 1), percent))
        .when(class_ == "date", F.when(
            _strict_date(v), _bit("filled", "n_date", "strict", "m_phone")).otherwise(_bit("filled", "n_date")))
        .when(class_ == "boolean", all_of(
            "boolean", bit(strict_form(v, "boolean"), "strict"), bit(v.isin(K.COUNTRY_CODES), "m_country")))
        .when(v != "", text).otherwise(0)
    )


def has(*marks: str) -> Column:
    """Are all of these facts true of the value?"""
    bits = _bit(*marks)
    return F.col("marks").bitwiseAND(F.lit(bits)) == bits


def _number(v: Column, class_: Column) -> Column:
    """As `to_number`, without its pattern where the class has settled what it would find."""
    other = (class_ == "string") & F.substring(v, 1, 1).between("+", "9") & v.rlike(K.NUMBER)
    return finite(F.when(class_.isin("integer", "decimal") | other, v))


def _shape(v: Column, class_: Column) -> Column:
    """As `shape`, without its pattern where the class has settled the outcome."""
    sign = F.when(v.startswith("-"), "-").otherwise("")
    return (
        F.when(class_ == "integer", F.concat(sign, F.lit("A")))
        .when(class_ == "decimal", F.concat(sign, F.lit("A.A")))
        .when(class_ == "boolean", "A")
        .when((class_ == "date") & _strict_date(v), "A-A-A")
        .otherwise(shape(v))
    )


HUGE = "spark.sql.codegen.hugeMethodLimit"


def marked(cell: DataFrame) -> DataFrame:
    """Cells with `value` (trimmed), its class, its number `x` and its facts as one number, `marks`.

    All facts in one generated method are more than HotSpot compiles (8000 bytes of code), and it
    would be interpreted. Unless the session names a limit of its own it gets HotSpot's: Spark then
    generates such steps in smaller methods.
    """
    conf = cell.sparkSession.conf
    if conf.get(HUGE) == "65535":  # Spark's default
        conf.set(HUGE, "8000")
    value, class_ = F.col("value"), F.col("class")
    return (
        cell.withColumn("value", js_trim(F.col("raw")))
        .withColumn("class", classify_trimmed(value))
        .withColumn("x", _number(value, class_))
        .withColumn("marks", _marks(value, class_, F.col("x")))
    )


def digest(c: Column) -> list[Column]:
    """128 bits of a text as two longs, which grouping keeps in place at a fixed width."""
    return [F.xxhash64(c), F.xxhash64(F.lit("second half"), c)]


def merged_cells(rows: DataFrame) -> DataFrame:
    """As `cells`, with equal cells of a column merged within a task: `n` of them, `row_number` the first.

    Most cells repeat a value. What is worked out from a text is then worked out once for many cells,
    and no text leaves the task for it. Not all equal cells meet: group what is made of them.
    """
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select(*VERSION, F.col("row_number").cast("long").alias("row_number"), "fields").mapInArrow(
        merge, ", ".join([*(f"{c} {types[c]}" for c in VERSION), "row_number long, col_idx int, raw string, n long"]))


def value_counts(rows: DataFrame) -> DataFrame:
    """Cells grouped by the digest (d1, d2) of their trimmed value.

    No text leaves a task, however long the values are: a group carries the facts about its value
    (`marks`), the digest of its shape (s1, s2) and the number it stands for (x), all of fixed
    width. `first_row` is where the value can be looked up (`values_at`).
    """
    cell = marked(merged_cells(rows))
    d1, d2 = digest(F.col("value"))
    s1, s2 = digest(F.col("shape"))
    known = cell.withColumn("shape", _shape(F.col("value"), F.col("class"))).select(
        *VERSION, "row_number", "col_idx", "n", "marks", d1.alias("d1"), d2.alias("d2"),
        s1.alias("s1"), s2.alias("s2"), "x",
        F.when(F.col("raw") == F.col("value"), F.col("n")).otherwise(0).alias("untouched"),
    )
    return known.groupBy(*VERSION, "col_idx", "d1", "d2").agg(
        F.sum("n").alias("n"),
        F.sum("untouched").alias("n_untouched"),
        F.min("row_number").alias("first_row"),
        *[F.min(c).alias(c) for c in ("marks", "s1", "s2", "x")],
    )


#: Up to so many rows that are looked up are named in a condition, more are joined.
NAMED = 1000


def named(rows: DataFrame, wanted: DataFrame) -> DataFrame | None:
    """The rows that have the keys of `wanted`, which are distinct; None where it is empty.

    A few keys are named in a condition: it is tested before the fields of a row are made, and a
    union of tables is read for those that are meant only.
    """
    few = wanted.limit(NAMED + 1).collect()
    if not few:
        return None
    if len(few) > NAMED:
        return rows.join(wanted, wanted.columns, "left_semi")
    conditions = [reduce(Column.__and__, [F.col(c) == k[c] for c in wanted.columns]) for k in few]
    while len(conditions) > 1:  # paired off, so that the condition is not nested deeply
        conditions = [reduce(Column.__or__, conditions[i:i + 2]) for i in range(0, len(conditions), 2)]
    return rows.where(conditions[0])


def values_at(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """`wanted` (column, first_row, digest s1 and s2 of a shape) with `value` looked up in the rows.

    `wanted` is small beside the rows: pass a staged table, so that Spark knows its size.
    """
    s1, s2 = digest(shape(F.col("value")))
    number = F.col("row_number") == F.col("first_row")
    keep = [F.col(f"w.{c}") for c in wanted.columns]
    there = named(rows, wanted.select(*VERSION, F.col("first_row").alias("row_number")).distinct())
    rows = rows.limit(0) if there is None else there
    return (
        rows.alias("r").join(
            wanted.alias("w"), reduce(
                Column.__and__, [F.col(f"r.{c}") == F.col(f"w.{c}") for c in VERSION], number))
        .select(*keep, js_trim(F.get("fields", F.col("col_idx"))).alias("value"))
        .where((s1 == F.col("s1")) & (s2 == F.col("s2")))
        .groupBy(*wanted.columns).agg(F.min("value").alias("value"))
    )
