"""Money and text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(10,2)"


def line_amount(unit_price: Column | str, quantity: Column | str, *, strict: bool = True) -> Column:
    """Price times quantity as ``decimal(10,2)``.

    An amount that does not fit raises when ``strict`` (under ANSI mode, the default);
    otherwise it becomes null.
    """
    price = F.col(unit_price) if isinstance(unit_price, str) else unit_price
    units = F.col(quantity) if isinstance(quantity, str) else quantity
    product = price * units
    return product.cast(MONEY) if strict else product.try_cast(MONEY)


def full_name(first: Column | str, last: Column | str) -> Column:
    """First and last name with a space; nulls are skipped, so two nulls give an empty string."""
    return F.concat_ws(" ", first, last)
