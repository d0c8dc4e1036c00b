"""clean_gl: the cleaning projection (one ``select``, no shuffle; text dates are voted on before it)."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .dates import choose_date_format, parse


def _to_double(col: Column, dtype: T.DataType) -> Column:
    c = col if isinstance(dtype, (T.DoubleType, T.FloatType)) else col.try_cast("double")
    c = c.cast("double")
    # NaN passes every >= test in Spark and one infinity makes a whole account's deviation NaN;
    # both are taken as missing.
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(None).cast("double")).otherwise(c)


def _to_datetime(col: Column, dtype: T.DataType, date_format: str | None) -> Column:
    if isinstance(dtype, (T.DateType, T.TimestampNTZType)):
        return col
    if isinstance(dtype, T.TimestampType):
        return col.cast("timestamp_ntz")
    return parse(col.cast("string"), date_format)


def clean_gl(df: DataFrame, date_format: str | None = None) -> DataFrame:
    """Coerce date/amount, add ``abs_amount``, zero-fill debit/credit, strings as strings.

    Dates: DATE and naive timestamps pass through, text is parsed with ``date_format`` or, where none is given,
    with the format that most of the column's rows fit (one pass over it, ``dates``); unparseable values become
    NULL. Amounts: text is parsed,
    unparseable values, NaN and infinities become NULL. Extra columns pass through unchanged.
    """
    types = {f.name: f.dataType for f in df.schema.fields}
    if date_format is None and "date" in types and (choice := choose_date_format(df)):
        date_format = choice.pattern
    out = []
    for name in df.columns:
        c = F.col(f"`{name}`")
        if name == "date":
            out.append(_to_datetime(c, types[name], date_format).alias(name))
        elif name == "amount":
            amt = _to_double(c, types[name])
            out.append(amt.alias("amount"))
            out.append(F.abs(amt).alias("abs_amount"))
        elif name in ("debit_amount", "credit_amount"):
            out.append(F.coalesce(_to_double(c, types[name]), F.lit(0.0)).alias(name))
        elif name in ("vendor", "description", "account_name", "account_code"):
            out.append(c.cast("string").alias(name))
        else:
            out.append(c)
    return df.select(*out)

