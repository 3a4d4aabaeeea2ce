"""Arrow UDFs that are built when used, so that modules can be imported without a session."""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F


def arrow(return_type: str):
    """A function of pandas Series as a function of Columns."""

    def wrap(f):
        @functools.wraps(f)
        def call(*columns) -> Column:
            return F.pandas_udf(f, return_type)(*columns)

        return call

    return wrap
