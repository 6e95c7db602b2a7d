"""Raw sales files: header checked by name, typed cleaning, file order kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from lakesight.functions.cleaning import na_to_null, safe_int
from lakesight.schema import SALES_COLUMNS, SALES_RAW, missing_columns
from lakesight.session import materialize, spark_path
from lakesight.sources import quoted_csv

# Column names every raw sales file must have.
REQUIRED_COLUMNS = [name.upper() for name in SALES_COLUMNS]

FILE_ORDER = "_file_order"


def read_raw_csv(spark: SparkSession, path: str | list[str], multi_line: bool = True) -> DataFrame:
    """All fields as text, plus the row's place in the load. Files follow each other by name.

    ``multi_line`` accepts line breaks inside quotes: see ``quoted_csv``, which cuts the
    records in as many tasks as there are blocks and writes them once, so that what is asked
    of single columns later does not parse the files again.
    """
    paths = [spark_path(p) for p in ([path] if isinstance(path, str) else path)]
    options = {"quote": '"', "escape": '"'}
    plain = spark.read.options(header=True, multiLine=multi_line, **options).csv(paths)
    missing = missing_columns(plain, REQUIRED_COLUMNS)
    if missing:
        raise ValueError(f"Missing required column: {missing[0]}")
    columns = [F.col(c).alias(c.lower()) for c in REQUIRED_COLUMNS]
    if not multi_line:
        place = F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            F.monotonically_increasing_id().alias("row"),
        )
        return plain.select(*columns, place.alias(FILE_ORDER))
    fields = F.from_csv("record", ", ".join(f"`{c}` STRING" for c in plain.columns), {**options, "multiLine": "true"})
    place = F.struct(F.col("_file").alias("file"), F.col("_block").alias("block"), F.col("_row").alias("row"))
    parsed = quoted_csv.records(spark, paths).select(fields.alias("_r"), place.alias(FILE_ORDER)).select("_r.*", FILE_ORDER)
    return materialize(parsed.select(*columns, FILE_ORDER), "raw")


def numbers_only(rows: DataFrame, column: str) -> bool:
    """Is every value of a text column a number? One boolean comes back."""
    value = na_to_null(F.col(column))
    bad = rows.where(value.isNotNull() & value.try_cast("double").isNull())
    return bad.limit(1).isEmpty()


def clean_raw(rows: DataFrame, numeric_ratings: bool | None = None) -> DataFrame:
    """Typed sales rows: missing-value tokens become NULL, ratings integer or NULL.

    A column holding numbers only is read as numbers, so 4.7 counts as 4; as soon
    as one value is text, the column is text and only whole numbers survive.
    """
    if numeric_ratings is None:
        numeric_ratings = numbers_only(rows, "feedback_rating")
    cleaned = rows.withColumns({c: na_to_null(F.col(c)) for c in SALES_COLUMNS})
    rating = F.col("feedback_rating")
    rating = rating.try_cast("double").try_cast("int") if numeric_ratings else safe_int(rating)
    typed = []
    for field in SALES_RAW.fields:
        c = F.col(field.name)
        if field.name == "feedback_rating":
            c = rating
        elif field.dataType.typeName() != "string":
            c = c.try_cast(field.dataType)
        typed.append(c.alias(field.name))
    return cleaned.select(*typed, *[c for c in (FILE_ORDER,) if c in rows.columns])


def bad_values(raw: DataFrame, typed: DataFrame, key: str = "id") -> DataFrame:
    """(id, column, value) of the values that did not survive typing, though they are no missing-value token.

    ``typed`` is :func:`clean_raw` of ``raw``; rows meet by their place in the files.
    """
    own = [f.name for f in SALES_RAW.fields if f.dataType.typeName() != "string"]
    kept = typed.select(F.col(FILE_ORDER).alias("_place"), *[F.col(c).isNull().alias(f"_{c}") for c in own])
    lost = [
        F.when(na_to_null(F.col(c)).isNotNull() & F.col(f"_{c}"), F.struct(F.lit(c).alias("column"), F.col(c).alias("value"))) for c in own]
    met = raw.select(key, FILE_ORDER, *own).join(kept, F.col(FILE_ORDER) == F.col("_place"))
    return met.select(key, F.inline(F.filter(F.array(*lost), lambda x: x.isNotNull())))


def require_good(raw: DataFrame, typed: DataFrame, key: str = "id") -> DataFrame:
    """Refuse a load with any value of the wrong type; the typed rows otherwise."""
    bad = bad_values(raw, typed, key)
    found = bad.orderBy(key, "column").limit(5).collect()
    if found:
        shown = ", ".join(f"{r['column']} of {r[key]!r} is {r['value']!r}" for r in found)
        raise ValueError(f"the load has {bad.count()} bad values: {shown}")
    return typed


def last_in_file(rows: DataFrame, key: str = "id") -> DataFrame:
    """The last row of each key, as one insert after the other would leave it.

    Only rows whose key comes again are put in order: keys alone are counted, and the rows of
    all other keys stay where they were read, neither shuffled nor sorted. NULL is a key too.
    The repeated keys are written first, so that their size decides how rows meet them.
    """
    counted = rows.groupBy(F.col(key).alias("_key")).agg(F.count("*").alias("_n"))
    repeated = materialize(counted.where("_n > 1").select("_key"), "repeated")
    again = F.col(key).eqNullSafe(F.col("_key"))
    newest = Window.partitionBy(key).orderBy(F.col(FILE_ORDER).desc())
    last = rows.join(repeated, again, "left_semi").withColumn("_rn", F.row_number().over(newest)).where("_rn = 1").drop("_rn")
    return rows.join(repeated, again, "left_anti").unionByName(last).drop(FILE_ORDER)
