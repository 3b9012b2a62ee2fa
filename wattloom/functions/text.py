"""Text clean-up of published statistics and feature names."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattloom.functions.fixed_values import NAME_TEMPLATES


def percent_to_share(text: Column) -> Column:
    """`1.7%` -> 0.017; the flag Z (rounds to zero) counts as 0."""
    plain = F.regexp_replace(F.regexp_replace(text, "Z", "0"), "%", "")
    return plain.try_cast("double") / 100


def amount_to_number(text: Column) -> Column:
    """`$1,234` -> 1234; the flag S (suppressed) is null."""
    plain = F.replace(F.replace(text, F.lit(",")), F.lit("$"))
    return F.nullif(plain, F.lit("S")).try_cast("double")


def name_template(name: Column) -> Column:
    r"""`total_consumption_month_7` -> `total_consumption_month_\d+`."""
    return F.regexp_replace(name, r"[0-9]+", r"\\d+")


def template_patterns() -> list[str]:
    r"""The fixed name templates with every `{placeholder}` as `\d+`."""
    return [re.sub(r"\{\w+\}", r"\\d+", template) for template in NAME_TEMPLATES]


def first_matching_template(name: Column) -> Column:
    """The first fixed template that matches the beginning of the name, else null."""
    return F.coalesce(
        *[F.when(name.rlike("^" + pattern), F.lit(pattern)) for pattern in template_patterns()]
    )


def target_class(target: Column) -> Column:
    """commercial / residential by the last letters of the target, else binary."""
    tail = F.lower(F.right(target, F.lit(3)))
    return (
        F.when(tail == "res", "residential").when(tail == "com", "commercial").otherwise("binary")
    )
