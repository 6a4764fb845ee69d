"""Literals for columns: checked on the driver, so that a query fails before a job starts."""

from __future__ import annotations

import datetime as dt
import decimal
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import InvalidValueType, OutOfRange

_BITS = {T.ByteType: 8, T.ShortType: 16, T.IntegerType: 32, T.LongType: 64}
_FLOAT_MOST = 3.4028234663852886e38


def coerce(value: Any, dtype: T.DataType, domain: tuple[int, int] | None = None) -> Any:
    """value as the column's type holds it. Integers widen to floats where nothing is lost; floats never
    become integers; what doesn't fit is an error, not an empty result."""
    kind = type(dtype)
    if value is None:
        return None
    if kind is T.BooleanType:
        if isinstance(value, bool):
            return value
    elif kind in _BITS:
        if isinstance(value, int) and not isinstance(value, bool):
            low, high = domain or (-(1 << _BITS[kind] - 1), (1 << _BITS[kind] - 1) - 1)
            if not low <= value <= high:
                raise OutOfRange(value, f"{low}..{high}")
            return value
    elif kind in (T.FloatType, T.DoubleType):
        if isinstance(value, float) or isinstance(value, int) and not isinstance(value, bool):
            if isinstance(value, int) and int(float(value)) != value:
                raise OutOfRange(value, dtype.simpleString())
            if kind is T.FloatType and abs(value) > _FLOAT_MOST and abs(value) != float("inf"):
                raise OutOfRange(value, "float")
            return float(value)
    elif kind is T.DecimalType:
        if isinstance(value, int | float | decimal.Decimal) and not isinstance(value, bool) and value == value:
            # a number of a text has its digits as written, another float its shortest ones
            exact = decimal.Decimal(value if not isinstance(value, float) else getattr(value, "digits", repr(value)))
            if not exact.is_finite() or exact.adjusted() >= dtype.precision - dtype.scale and exact or len(exact.as_tuple().digits) > 38 or -exact.as_tuple().exponent > 38:
                raise OutOfRange(value, dtype.simpleString())
            return exact
    elif kind in (T.DateType, T.TimestampType, T.TimestampNTZType):
        if isinstance(value, dt.date):
            return value
    elif isinstance(dtype, T.StringType):
        if isinstance(value, str):
            return value
    else:
        return value
    raise InvalidValueType(value, dtype.simpleString())


def literal(value: Any, dtype: T.DataType, domain: tuple[int, int] | None = None) -> Column:
    """A typed literal: a float column compares with a float, not with the nearest double. Decimals keep all their places."""
    if isinstance(dtype, T.DecimalType) and value is not None:
        return F.lit(coerce(value, dtype, domain))
    return F.lit(coerce(value, dtype, domain)).cast(dtype)
