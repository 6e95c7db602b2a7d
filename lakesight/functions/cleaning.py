"""Missing-value rules of the load, batch and embedding paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# Texts a CSV field may hold to mean "no value".
NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None",
    "n/a", "nan", "null",
]

# What the batch path reads where a field is NULL or empty.
BATCH_DEFAULTS = {
    "customer_id": "",
    "brand": "Unknown",
    "fridge_model": "Unknown",
    "store_name": "Unknown",
    "store_address": "",
    "customer_feedback": "",
    "feedback_sentiment_category": "Neutral",
}

# The embedding path fills only these and keeps NULL elsewhere.
EMBED_DEFAULTS = {
    "customer_id": "",
    "store_address": "",
    "customer_feedback": "",
    "feedback_sentiment_category": "",
}

# Columns the rollups need, and the literal used when one is absent.
ROLLUP_DEFAULTS = {
    "brand": "Unknown",
    "price": 0.0,
    "store_name": "Unknown",
    "feedback_sentiment_category": "Neutral",
    "fridge_model": "Unknown",
}

# Defaults of a full-row edit for the fields it leaves out.
EDIT_DEFAULTS = {
    "customer_id": "",
    "brand": "Unknown",
    "fridge_model": "Unknown",
    "capacity_liters": None,
    "price": 0,
    "sales_date": None,
    "store_name": "Unknown",
    "store_address": "",
    "customer_feedback": "",
    "feedback_rating": None,
    "feedback_sentiment_category": "Neutral",
}


def na_to_null(c: Column) -> Column:
    return F.when(~c.isin(NA_TOKENS), c)


def fill_empty(c: Column, default: str) -> Column:
    """NULL and the empty string both become the default."""
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def fill_defaults(df: DataFrame, defaults: dict[str, str], price: bool = True) -> DataFrame:
    """Apply one defaults map; the batch path also reads a NULL price as 0."""
    filled = {name: fill_empty(F.col(name), value) for name, value in defaults.items() if name in df.columns}
    if price and "price" in df.columns:
        filled["price"] = F.coalesce(F.col("price"), F.lit(0).cast(df.schema["price"].dataType))
    return df.withColumns(filled)


def batch_defaults(df: DataFrame) -> DataFrame:
    return fill_defaults(df, BATCH_DEFAULTS, price=True)


def embed_defaults(df: DataFrame) -> DataFrame:
    return fill_defaults(df, EMBED_DEFAULTS, price=False)


def add_missing_columns(df: DataFrame, defaults: dict[str, object] | None = None) -> DataFrame:
    """Add the columns the rollups need; names are compared without regard to case."""
    present = {name.lower() for name in df.columns}
    wanted = ROLLUP_DEFAULTS if defaults is None else defaults
    return df.withColumns({name: F.lit(value) for name, value in wanted.items() if name.lower() not in present})


def safe_int(c: Column) -> Column:
    """Integer value, NULL for text that is not one; fractions are cut off."""
    return c.try_cast("int")


def sql_literal_value(c: Column, is_text: bool = True) -> Column:
    """The value a literal stands for: empty, ``nan`` and infinities mean NULL."""
    if is_text:
        return F.when(~F.lower(c).isin("", "nan"), c)
    return F.when(~(F.isnan(c) | (F.abs(c) == float("inf"))), c)


def union_field(field: Column) -> Column:
    """Text of a tagged union: the first of string, long, double, boolean that is set."""
    members = ["string_value", "long_value", "double_value", "boolean_value"]
    return F.when(
        ~F.coalesce(field["is_null"], F.lit(False)),
        F.coalesce(*[field[name].cast("string") for name in members]),
    )


def json_or_text(c: Column) -> Column:
    """Canonical JSON text where the value parses, the value itself otherwise."""
    return F.coalesce(F.to_json(F.try_parse_json(c)), c)
