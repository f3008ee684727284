"""Typing of loosely shaped text: dates and amounts. ANSI mode is on in Spark 4, so
every conversion uses a ``try_`` form and yields NULL instead of failing the job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import FORM_WS, col_, trim_ws

# The accepted date shapes of the staging load and the US pattern.
ISO_DATE_RE = r"^\d{4}-\d{2}-\d{2}$"
US_DATE_RE = r"^\d{1,2}/\d{1,2}/\d{4}$"
US_DATE_FORMAT = "M/d/yyyy"
# Characters an amount keeps before typing (digits, point, minus), and the
# decimal shape the form reads as a number (no letter suffix such as 12d or 12f).
AMOUNT_DROP_RE = r"[^0-9.\-]"
FORM_NUMBER_RE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def staging_date(c) -> Column:
    """``yyyy-MM-dd`` or ``M/d/yyyy`` chosen by shape; other shapes and impossible
    dates (2025-02-30, 13/5/2025) give NULL."""
    x = col_(c)
    return (F.when(x.rlike(ISO_DATE_RE), x.try_cast("date"))
            .when(x.rlike(US_DATE_RE), F.try_to_date(x, US_DATE_FORMAT)))


def staging_amount(c) -> Column:
    """Keep ``[0-9.-]``; empty becomes NULL; DECIMAL(12,2) rounded half-up; junk
    such as ``1.2.3`` or ``--1`` gives NULL. "(12.00)" loses its sign, as in the
    source load."""
    kept = F.regexp_replace(col_(c), AMOUNT_DROP_RE, "")
    return F.nullif(kept, F.lit("")).try_cast("decimal(12,2)")


def form_amount(c) -> Column:
    """Form-side amount: thousands commas removed, stripped, digits past the second
    decimal cut (not rounded), then typed as DOUBLE; NULL when not a plain number."""
    x = trim_ws(F.regexp_replace(F.coalesce(col_(c), F.lit("")), ",", ""), FORM_WS)
    cut = F.regexp_replace(x, r"^([^.]*\.[0-9]{2})[0-9]+$", "$1")
    return F.when(cut.rlike(FORM_NUMBER_RE), cut.try_cast("double"))


def iso_date(c) -> Column:
    """``yyyy-MM-dd`` text as a date; other shapes (2025, 2025-08, a time behind) give NULL."""
    x = col_(c)
    return F.when(x.rlike(ISO_DATE_RE), x.try_cast("date"))


def iso_date_text(c) -> Column:
    return F.date_format(col_(c), "yyyy-MM-dd")
