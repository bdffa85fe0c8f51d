"""Text functions as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every character that is an ASCII letter with combining marks, and that letter.
_MARKED = {c: b for c in map(chr, range(0x80, 0x3000)) if len(b := "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")) == 1 and b.isascii() and b.isalpha()}
#: Words that product descriptions carry without saying anything.
STOP_WORDS = (
    "A", "AL", "C", "CADA", "CON", "DE", "DEL", "EL", "EN", "LA", "LAS", "LOS", "PACK", "PARA", "POR", "SIN", "UND", "UNID", "UNIDAD", "UNIDADES", "X", "Y",
)
#: Words of a query that name no product.
IGNORED_QUERY_WORDS = (
    "A", "AL", "C", "CON", "DE", "DEL", "EL", "EN", "FORMA", "LA", "LAS", "LOS", "PACK", "PAQ", "PARA", "POR", "SIN", "UND", "UNID", "UNIDAD", "UNIDADES", "X", "Y",
)
#: Words that mark a cancelled line, an adjustment, a cancelled code, and a cancelled flag.
CANCEL_WORDS = ("ANULADO", "ANULADA", "CANCELADO", "CANCELADA", "QUITADO", "QUITADA", "VOID", "DELETED")
ADJUSTMENT_WORDS = ("AJUSTE", "AJUSTES", "REGULARIZACION", "ANULADO", "ANULADA", "CANCELADO", "CANCELADA")
CANCEL_CODES = ("ANULADO", "CANCELADO", "QUITADO", "VOID", "DELETED")
CANCEL_FLAGS = ("SI", "S", "YES", "TRUE", "1", "ANULADO", "CANCELADO")


def normalized(text: Column) -> Column:
    """Without accents, upper case, everything but letters and digits one space; null is empty."""
    plain = F.upper(F.translate(F.regexp_replace(F.coalesce(text, F.lit("")), r"\p{Mn}", ""), "".join(_MARKED), "".join(_MARKED.values())))
    return F.trim(F.regexp_replace(plain, "[^A-Z0-9]+", " "))


def tokens(text: Column) -> Column:
    """Normalised words without stop words."""
    return F.filter(F.split(normalized(text), " "), lambda t: (t != "") & ~t.isin(*STOP_WORDS))


def number(text: Column) -> Column:
    """Digits, comma, point and minus of a text read as a number; null if that is none."""
    return F.replace(F.regexp_replace(text, "[^0-9,.-]", ""), F.lit(","), F.lit(".")).try_cast("double")


def column_name(text: Column) -> Column:
    """A header as a lower-case name with underscores."""
    return F.replace(F.lower(normalized(text)), F.lit(" "), F.lit("_"))


def day(text: Column) -> Column:
    """Dates of the forms day/month/year (two or four digits) and year-month-day, with slashes or dashes; null if the text is none."""
    plain = F.replace(F.trim(text), F.lit("/"), F.lit("-"))
    forms = ((r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}", "y-M-d"), (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{4}", "d-M-y"), (r"^[0-9]{1,2}-[0-9]{1,2}-[0-9]{2}", "d-M-yy"))
    return F.coalesce(*[F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract(plain, f"({p})(?![0-9])", 1), F.lit("")), F.lit(f))) for p, f in forms])


def query_words(text: Column) -> Column:
    """Words of a query, each once in order: no single letters, no ignored words."""
    return F.array_distinct(F.filter(F.split(normalized(text), " "), lambda t: (F.length(t) > 1) & ~t.isin(*IGNORED_QUERY_WORDS)))


def value_words(text: Column) -> Column:
    """The normalised parts of a compound value (split at | , / ;) and their query words."""
    parts = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"[|,/;]+"), normalized), lambda p: p != "")
    return F.array_distinct(F.concat(parts, F.flatten(F.transform(parts, query_words))))


def plain_number(value: Column) -> Column:
    """A number without needless zeros, as text."""
    return F.when(value.isNotNull(), F.regexp_replace(F.format_string("%.6f", value.cast("double")), r"\.?0+$", ""))


def code_pattern(code: Column) -> Column:
    """Shape of a product code."""
    plain = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    length = F.length(plain).cast("string")
    return (
        F.when(plain == "", "EMPTY")
        .when(plain.rlike("|".join(CANCEL_CODES)), "HAS_CANCEL_KEYWORD")
        .when(plain.rlike("^0[0-9]+$"), F.concat(F.lit("LEADING_ZERO_NUM_"), length))
        .when(plain.rlike("^[0-9]+$"), F.concat(F.lit("NUM_"), length, F.lit("_DIGITS")))
        .when(plain.rlike("^[A-Z]+$"), "ALPHA_ONLY")
        .when(F.contains(plain, F.lit("-")), "ALPHANUM_WITH_DASH")
        .when(plain.rlike("[A-Z]") & plain.rlike("[0-9]"), "ALPHANUM")
        .otherwise("OTHER")
    )
