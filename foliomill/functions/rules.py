"""Row-quality rules as boolean or cleaning columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliomill import config
from foliomill.functions.text import NOT_WS, present, strip

# Patterns.
DOI_WHOLE = r"(?iU)^10\.[0-9]{4,9}/[-._;()/:A-Z0-9a-z]+$"
UNSAFE_NAME_CHARS = r"(?U)[^\w\-. ]"


def valid_confidence(confidence: Column) -> Column:
    """Null or within 0 and 1."""
    return confidence.isNull() | confidence.between(0.0, 1.0)


def valid_summary(summary: Column) -> Column:
    """Present and not only whitespace."""
    return F.coalesce(summary.rlike(NOT_WS), F.lit(False))


def valid_role(role: Column) -> Column:
    return F.coalesce(role.isin(config.VARIABLE_ROLES), F.lit(False))


def valid_biblio_year(year: Column) -> Column:
    return year.isNull() | year.between(config.BIBLIO_YEAR_MIN, config.BIBLIO_YEAR_MAX)


def checked_year(year: Column) -> Column:
    """``year``, or null when it lies outside the accepted range."""
    return F.when(year.between(config.CHECKED_YEAR_MIN, config.CHECKED_YEAR_MAX), year)


def all_named(items: Column, name_field: str) -> Column:
    """True when every struct of the list carries its name."""
    return F.forall(items, lambda item: item[name_field].isNotNull())


def valid_doi(doi: Column) -> Column:
    return F.coalesce(doi.rlike(DOI_WHOLE), F.lit(False))


def safe_filename(name: Column) -> Column:
    """Word characters, hyphen, dot and blank only; ``unnamed`` if nothing is left."""
    return F.coalesce(present(strip(F.regexp_replace(name, UNSAFE_NAME_CHARS, ""))), F.lit("unnamed"))


def acceptable_upload(path: Column, size: Column) -> Column:
    """A PDF by its extension and not above the size limit."""
    return F.lower(path).endswith(".pdf") & (size <= config.MAX_UPLOAD_BYTES)
