"""Amounts and quantities as text, parsed by expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import _ARABIC_DIGITS, _ASCII_DIGITS, is_code_like, table_normal

MONEY = "decimal(18,2)"
TOLERANCE = 0.02
CURRENCY_WORD = r"(?i)\b(?:aed|chf|da|dzd|eur|gbp|mad|sar|tnd|usd)\b"
#: What makes letters, strokes or dates beside a number no hindrance.
MONEY_HINTS = ("A PAYER", "AMOUNT", "HT", "MONTANT", "PRICE", "PRIX", "STAMP", "TAX", "TIMBRE", "TOTAL", "TTC", "TVA", "UNIT", "VAT")
_DATE = r"\b[0-9]{1,2}[/-][0-9]{1,2}[/-][0-9]{2,4}\b"
_LETTER = "[A-Za-zÀ-ɏ؀-ۿ]"


def _ascii(raw: Column) -> Column:
    return F.translate(F.coalesce(raw, F.lit("")), _ARABIC_DIGITS + "\u00a0\u202f", _ASCII_DIGITS + "  ")


def plain_number(t: Column) -> Column:
    """One number's text, without blanks, with a decimal point only.

    With both marks the later one is the decimal mark. A single comma is one if at most two digits follow, a single point always; a mark that repeats groups
    thousands, but for a last point before at most two digits.
    """
    comma, dot = F.instr(t, ","), F.instr(t, ".")
    last_comma, last_dot = F.length(t) - F.instr(F.reverse(t), ","), F.length(t) - F.instr(F.reverse(t), ".")
    no = lambda c, mark: F.regexp_replace(c, mark, "")
    return (
        F.when((comma > 0) & (dot > 0) & (last_comma > last_dot), F.regexp_replace(no(t, r"\."), ",", "."))
        .when((comma > 0) & (dot > 0), no(t, ","))
        .when((comma > 0) & t.rlike("^[^,]*,[^,]{0,2}$"), F.regexp_replace(t, ",", "."))
        .when(comma > 0, no(t, ","))
        .when(t.rlike(r"\..*\.[^.]{0,2}$"), F.regexp_replace(t, r"\.(?=.*\.)", ""))
        .when(t.rlike(r"\..*\."), no(t, r"\."))
        .otherwise(t)
    )


def amount(raw: Column) -> Column:
    """The last number in a cell or line as money, rounded half up; else null.

    Letters are allowed only beside a currency code or a word of ``MONEY_HINTS``, and so are strokes and two dashes; a date needs such a word. A code is no amount.
    """
    text = F.trim(F.regexp_replace(_ascii(raw), r"\s+", " "))

    def of(t: Column) -> Column:
        # a plain number, as most cells are, needs none of the rules
        return F.when(t.rlike(r"^[0-9]{1,15}(?:[.][0-9]{1,2})?$"), F.round(t.try_cast("decimal(24,6)"), 2).cast(MONEY)).otherwise(F.element_at(F.transform(F.array(table_normal(t).rlike("|".join(MONEY_HINTS))), lambda hinted: by_rules(t, hinted)), 1))

    def by_rules(t: Column, hinted: Column) -> Column:
        coined = t.rlike(CURRENCY_WORD)
        unfit = is_code_like(t) | (t.rlike(_LETTER) & ~coined & ~hinted) | (t.rlike(_DATE) & ~hinted) | ((t.contains("/") | (F.regexp_count(t, F.lit("-")) >= 2)) & ~coined & ~hinted)
        bare = F.regexp_replace(t, r"(?i)\b(?:aed|chf|da|dzd|eur|gbp|ht|mad|sar|tnd|ttc|tva|usd)\b", " ")
        tokens = F.transform(F.regexp_extract_all(bare, F.lit(r"([+\-]?[0-9][0-9\s.,]*)"), F.lit(1)), lambda x: F.replace(F.trim(x), F.lit(" "), F.lit("")))
        signed = lambda x: F.concat(F.when(x.startswith("-"), "-").otherwise(""), plain_number(F.regexp_replace(x, "^[+-]+", "")))
        values = F.filter(F.transform(tokens, lambda x: F.round(signed(x).try_cast("decimal(24,6)"), 2).cast(MONEY)), lambda v: v.isNotNull())
        return F.when(~unfit, F.try_element_at(values, F.lit(-1)))

    return F.element_at(F.transform(F.array(text), of), 1)


def quantity(raw: Column) -> Column:
    """A number without letters, strokes or a date, to three decimals; a comma is the decimal mark. Else null."""
    text = F.trim(_ascii(raw))
    unfit = text.rlike(_LETTER) | text.contains("/") | text.rlike(_DATE) | (F.regexp_count(text, F.lit("-")) >= 2)
    bare = F.regexp_replace(F.replace(text, F.lit(","), F.lit(".")), r"[^0-9.+\-]", "")
    rounded = lambda x: F.round(x.try_cast("decimal(24,6)"), 3).cast("decimal(18,3)")
    return F.when(text.rlike("^[0-9]{1,15}$"), rounded(text)).when(~unfit & bare.rlike(r"^[+\-]?[0-9]+(?:\.[0-9]+)?$"), rounded(bare))


def money(raw: Column) -> Column:
    """Money where a single comma is always the decimal mark; rounded half up to cents."""
    text = F.regexp_replace(_ascii(raw), r"[^0-9,.\-]", "")
    marked = F.when((F.instr(text, ",") > 0) & (F.instr(text, ".") > 0), plain_number(text)).otherwise(F.regexp_replace(text, ",", "."))
    return F.round(marked.try_cast("decimal(24,6)"), 2).cast(MONEY)


def is_close(a: Column, b: Column, tolerance: float = TOLERANCE) -> Column:
    return F.abs(a - b) <= F.lit(tolerance).cast("decimal(4,2)")


def loose_double(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), r"[^0-9,.\-eE+]", ""), ",", ".").try_cast("double")


def is_numeric_like(raw: Column) -> Column:
    """A number once all but digits, points and signs is left out; letters and codes are none."""
    text = F.trim(_ascii(raw))
    bare = F.regexp_replace(F.replace(text, F.lit(","), F.lit(".")), r"[^0-9.+\-]", "")
    return ~text.rlike(_LETTER) & bare.rlike(r"^[+\-]?[0-9]+(?:\.[0-9]+)?$")
