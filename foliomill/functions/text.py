"""Column expressions that mine text: words, titles, identifiers, years, abstracts, names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliomill import config

# Patterns.  WS lists the whitespace a Unicode-aware strip removes.
WS = r"\t-\r\x1c-\x1f\x85\p{Z}"
# The same, complemented; the ranges most text is made of come first, so that few characters need the full test.
NOT_WS = rf"[!-~\xa1-\u167f[^{WS}]]"
WS_CHARS = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(
    chr(c) for c in range(0x2000, 0x200B)
)
DOI = r"(?iU)\b(10\.[0-9]{4,9}/[-._;()/:A-Z0-9a-z]+)"
DOI_TRAILING = ".,;)>"
YEAR_IN_DATE = r"((?:19|20)[0-9]{2})"
YEAR_IN_TEXT = r"(?U)\b(?:19|20)[0-9]{2}\b"
ABSTRACT = r"(?is)abstract[:\s]*\n?(.*?)(?:\n\n|\n(?:Keywords|Introduction|1\.))"


def strip(text: Column) -> Column:
    """``text`` without leading and trailing whitespace of any kind."""
    return F.btrim(text, F.lit(WS_CHARS))


def is_blank(text: Column) -> Column:
    """True when ``text`` is null or holds nothing but whitespace."""
    return F.coalesce(~text.rlike(NOT_WS), F.lit(True))


def missing(text: Column) -> Column:
    """True when a string counts as not supplied: null or empty."""
    return text.isNull() | (text == "")


def present(text: Column) -> Column:
    """``text``, or null where it is the empty string."""
    return F.nullif(text, F.lit(""))


def word_count(text: Column) -> Column:
    """Number of whitespace-separated words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(f"{NOT_WS}+")), F.lit(0))


def mine_title(first_page: Column, meta_title: Column | None = None) -> Column:
    """File metadata title, else the first of the leading non-blank lines that has a title's length."""
    lines = F.filter(F.transform(F.split(first_page, "\n"), strip), lambda line: line != "")
    fitting = F.filter(
        F.slice(lines, 1, config.TITLE_LINES),
        lambda line: F.length(line).between(config.TITLE_MIN_CHARS, config.TITLE_MAX_CHARS),
    )
    guessed = F.get(fitting, F.lit(0))
    if meta_title is None:
        return guessed
    return F.when(~missing(meta_title), strip(meta_title)).otherwise(guessed)


def mine_doi(text: Column) -> Column:
    """First DOI in the opening part of ``text``, without trailing punctuation."""
    found = F.regexp_extract_all(F.substring(text, 1, config.DOI_WINDOW), F.lit(DOI), F.lit(1))
    return F.rtrim(F.get(found, F.lit(0)), F.lit(DOI_TRAILING))


def _mined_year(year: Column) -> Column:
    return year.between(config.MINED_YEAR_MIN, config.MINED_YEAR_MAX)


def mine_year(text: Column, meta_created: Column | None = None) -> Column:
    """Year of the file's creation date if plausible, else the first plausible year in the opening part."""
    years = F.transform(
        F.regexp_extract_all(F.substring(text, 1, config.YEAR_WINDOW), F.lit(YEAR_IN_TEXT), F.lit(0)),
        lambda y: y.cast("int"),
    )
    in_text = F.get(F.filter(years, _mined_year), F.lit(0))
    if meta_created is None:
        return in_text
    created = present(F.regexp_extract(meta_created, YEAR_IN_DATE, 1)).cast("int")
    return F.coalesce(F.when(_mined_year(created), created), in_text)


def mine_abstract(text: Column) -> Column:
    """Text after the word "abstract" up to a blank line or the next heading, if its length is plausible."""

    def plausible(abstract: Column) -> Column:
        return F.length(abstract).between(config.ABSTRACT_MIN_CHARS, config.ABSTRACT_MAX_CHARS)

    # Filtered as a list of one, so that the text is searched once and not again for each use of the result.
    found = F.array(strip(F.regexp_extract(text, ABSTRACT, 1)))
    return F.get(F.filter(found, plausible), F.lit(0))


def split_authors(names: Column) -> Column:
    """Author list from one string with commas or semicolons; blank parts are dropped."""
    parts = F.transform(F.split(F.translate(names, ";", ","), ","), strip)
    return F.filter(parts, lambda name: name != "")


def name_tokens(full_name: Column) -> Column:
    return F.regexp_extract_all(full_name, F.lit(f"{NOT_WS}+"), F.lit(0))


def last_name(full_name: Column) -> Column:
    """Last word of a full name; null for a blank one."""
    return F.try_element_at(name_tokens(full_name), F.lit(-1))


def first_name(full_name: Column) -> Column:
    """All words but the last, joined by one space; null for a single word."""
    tokens = name_tokens(full_name)
    return F.when(F.size(tokens) > 1, F.array_join(F.slice(tokens, 1, F.size(tokens) - 1), " "))


def double_text(number: Column) -> Column:
    """A double as the shortest decimal text: fixed notation from 1e-4 up to 1e16, else ``1e+16`` style."""
    size = F.abs(number)
    # Java writes numbers of ordinary size the same way.
    ordinary = (size == 0) | ((size >= 1e-3) & (size < 1e7))
    digits = F.regexp_replace(number.cast("decimal(38,21)").cast("string"), "0+$", "")
    fixed = F.when(digits.endswith("."), F.concat(digits, F.lit("0"))).otherwise(digits)
    java = number.cast("string")
    mantissa = F.regexp_replace(F.split_part(java, F.lit("E"), F.lit(1)), r"\.0$", "")
    exponent = F.split_part(java, F.lit("E"), F.lit(2))
    sign = F.when(exponent.startswith("-"), F.lit("e-")).otherwise(F.lit("e+"))
    power = F.regexp_replace(exponent, "-", "")
    scientific = F.concat(mantissa, sign, F.when(F.length(power) < 2, F.lpad(power, 2, "0")).otherwise(power))
    special = (
        F.when(F.isnan(number), F.lit("nan"))
        .when(number == float("inf"), F.lit("inf"))
        .when(number == float("-inf"), F.lit("-inf"))
    )
    unusual = F.coalesce(special, F.when((size >= 1e-4) & (size < 1e16), fixed).otherwise(scientific))
    return F.when(ordinary, java).when(number.isNotNull(), unusual)


def value_text(numeric: Column, text: Column) -> Column:
    """The value as text: the number if there is one, else the text.  Zero counts as a value."""
    return F.coalesce(double_text(numeric), text)
