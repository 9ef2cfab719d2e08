"""Numbers: rounding, safe division and aggregates that keep missing values visible.

The helpers take and return SQL text, for ``selectExpr`` and ``expr``.
"""

from __future__ import annotations

def round_to(value: str, digits: int) -> str:
    """Round half up on the decimal value.

    The detour over six decimals removes binary noise first, so 2.675 gives 2.68. A value
    of 1e32 or more is an error.
    """
    return f"double(round(CAST({value} AS DECIMAL(38,6)), {digits}))"


def round2(value: str) -> str:
    return round_to(value, 2)


def safe_div(numerator: str, denominator: str) -> str:
    """Quotient, or NULL for a zero denominator (ANSI division would fail the job)."""
    return f"try_divide(double({numerator}), double({denominator}))"


def parse_number(text: str) -> str:
    """Number in a text column; blank, malformed and NaN text is missing."""
    return f"nanvl(try_cast(trim(string({text})) AS DOUBLE), CAST(NULL AS DOUBLE))"


def or_zero(value: str) -> str:
    """Missing (NULL or NaN) as zero."""
    return f"coalesce(nanvl(double({value}), CAST(NULL AS DOUBLE)), 0D)"


def strict(aggregate: str, value: str) -> str:
    """Aggregate that is missing when the value is missing in any row of the group."""
    return f"CASE WHEN count({value}) = count(1) THEN {aggregate} END"


def strict_sum(value: str) -> str:
    return strict(f"double(sum({value}))", value)


def strict_avg(value: str) -> str:
    return strict(f"avg({value})", value)


def strict_sum_distinct(value: str) -> str:
    return strict(f"double(sum(DISTINCT {value}))", value)


def distinct_with_missing(value: str) -> str:
    """Exact distinct count in which missing counts as one more value."""
    return f"count(DISTINCT {value}) + max(bigint({value} IS NULL))"


def lenient_sum(value: str) -> str:
    """Sum of the present values, zero for none."""
    return f"coalesce(sum(double({value})), 0D)"
