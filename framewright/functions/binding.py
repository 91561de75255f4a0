"""A value that an expression uses more than once, worked out once.

Nothing inside a lambda is hoisted out of it, so an expression over an array that names another array expression works that
one out again for every element.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, use: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), use), F.lit(0))
