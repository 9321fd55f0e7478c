"""Text expressions. Every function takes and returns a Column, so that Catalyst plans it and no Python runs by row."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F



def _decomposed() -> tuple[str, str]:
    """Letters that are an ASCII letter with marks, each with its letter; then the marks themselves, which have none and vanish."""
    found = {}
    for code in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00), 0x212A, 0x212B]:
        parts = unicodedata.normalize("NFD", chr(code))
        if parts != chr(code) and parts[0].isascii() and all(unicodedata.combining(c) for c in parts[1:]):
            found[chr(code)] = parts[0]
    return "".join(found) + "".join(map(chr, range(0x300, 0x370))), "".join(found.values())


_ACCENTED, _PLAIN = _decomposed()
_ARABIC_DIGITS = "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹"
_ASCII_DIGITS = "01234567890123456789"
EMAIL = r"[\w.%+\-]+@[A-Za-z\d.\-]+\.[A-Za-z]{2,}"
WORD = "([A-Za-z0-9_À-ɏ؀-ۿ]+)"

#: Words that say nothing about what a sentence is about; compared without accents.
STOPWORDS = frozenset("a ainsi alors an and are as at au aussi aux avec be been being by car ce corpus dans de des document documents donc dont du elle elles en est et etre file files for from he i il ils in is it je la le les leur leurs mais moi moins must ni nos notre nous of on or ou où page pages par plus pour que qui quoi sa se sera ses shall she son sont sur test tests that the they this to toi tous tout toute toutes tres très tu un une vos votre vous was we were what when where which who will with you أو إلى الى او على عن في مع من هذا هذه و chose element elements english etc every hereby herein hereinafter item items matter partie parties period subject therein thereof truc whereas".split())
SHORT_TERMS = frozenset("dzd eur loi ttc tva usd".split())
#: Words that are no topic.
TOPIC_STOPWORDS = frozenset("and annex annexe are article au aux avec ce chapitre com corpus dans de des doc document documents dont du elle elles en est et etre false file files for from he http https i il ils image info it je la le les moins must nan negative net none note notes nous null org ou page pages par pdf plus positive pour que qui quoi reference references regex section sera shall she sont sur test tests text that the they this tres true très tu un une unknown valeur vous was we were what when where which who whom whose will with www you أو إلى الى او على عن في مع من هذا هذه و".split())
HINTS = {
    "fr": frozenset("avec dans date des est facture la le les montant pour sur total tva un une".split()),
    "en": frozenset("amount and date for in invoice is of the to total vat with".split()),
}
GRAMMAR_HINTS = {
    "fr": HINTS["fr"] | frozenset("au aux ce ces cet cette de du elle elles et il ils mais nous ou sa ses son vous".split()),
    "en": HINTS["en"] | frozenset("a also an as by from he into it its on over she that these they this those under we".split()),
}
#: In the order in which they are looked for.
CURRENCIES = (("EUR", ("eur", "€")), ("USD", ("usd", "dollar", "$")), ("GBP", ("gbp", "pound", "£")), ("DZD", ("dzd", "da", "d.a", "دج", "د.ج", "دينار")), ("AED", ("aed",)), ("SAR", ("sar",)))
MONTHS = "aout août april august avril december decembre décembre february fevrier février january janvier juillet juin july june mai march mars may november novembre october octobre september septembre".split()
WEEKDAYS = "dimanche friday jeudi lundi mardi mercredi monday samedi saturday sunday thursday tuesday vendredi wednesday".split()
_LATIN = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
_ARABIC_LETTERS = "[؀-ۿݐ-ݿࢠ-ࣿ]"


def strip_accents(text: Column) -> Column:
    return F.translate(text, _ACCENTED, _PLAIN)


def classifier_normal(text: Column) -> Column:
    """Accents off, all but ASCII letters and digits to one space, upper case."""
    return F.upper(F.trim(F.regexp_replace(strip_accents(F.coalesce(text, F.lit(""))), "[^A-Za-z0-9]+", " ")))


def term_normal(term: Column) -> Column:
    """Lower case, accents off, Latin ligatures in two, straight apostrophes."""
    out = F.translate(strip_accents(F.lower(F.trim(term))), "’‘ʼ`", "''''")
    for ligature, letters in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ĳ", "ij")):
        out = F.replace(out, F.lit(ligature), F.lit(letters))
    return out


def table_normal(text: Column) -> Column:
    """Arabic digits to ASCII, no-break spaces to spaces, only ``A-Za-z0-9+./%-`` kept, upper case."""
    plain = strip_accents(F.translate(F.coalesce(text, F.lit("")), _ARABIC_DIGITS + "\u00a0\u202f", _ASCII_DIGITS + "  "))
    return F.upper(F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^A-Za-z0-9+./%\-]+", " "), " +", " ")))


def without_controls(text: Column) -> Column:
    return F.regexp_replace(text, r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]", "")


def trimmed_value(value: Column) -> Column:
    """Space and leading or trailing punctuation off."""
    return F.btrim(F.trim(value), F.lit(" :=-–—;,.\"'`"))


def words(text: Column) -> Column:
    """Lower-case words in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(1))


def plain_words(text: Column) -> Column:
    """Lower-case words without accents, in order."""
    return words(strip_accents(text))


def is_informative(term: Column) -> Column:
    """Of a plain word: no stop word, has a letter, and four characters or one of the three-letter terms that count."""
    letters = F.length(F.regexp_replace(term, r"[^A-Za-zÀ-ɏ؀-ۿ]", ""))
    return (~term.isin(*sorted(STOPWORDS))) & (letters > 0) & ((F.length(term) >= 4) | term.isin(*sorted(SHORT_TERMS)))


def is_topic_candidate(term: Column) -> Column:
    """Of a plain word: 3 to 48 characters, at most one underscore, no more digits than letters, no stop word."""
    digits = F.length(F.regexp_replace(term, "[^0-9]", ""))
    letters = F.length(F.regexp_replace(term, "[0-9_]", ""))
    underscores = F.length(F.regexp_replace(term, "[^_]", ""))
    return F.length(term).between(3, 48) & (letters > 0) & (digits <= letters) & (underscores <= 1) & ~term.isin(*sorted(TOPIC_STOPWORDS))


def with_bigrams(terms: Column) -> Column:
    """The terms, then each two neighbours joined by a space."""
    pairs = F.when(F.size(terms) > 1, F.zip_with(F.slice(terms, F.lit(1), F.size(terms) - 1), F.slice(terms, F.lit(2), F.size(terms) - 1), lambda a, b: F.concat_ws(" ", a, b)))
    return F.concat(terms, F.coalesce(pairs, F.array().cast("array<string>")))


def char_ngrams(term: Column, least: int = 3, most: int = 5) -> Column:
    """Substrings of ``<term>`` of ``least`` to ``most`` characters, shorter ones first."""
    marked = F.concat(F.lit("<"), term, F.lit(">"))
    one = lambda n: F.when(F.length(marked) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(marked) - n + 1, F.lit(1))), lambda i: F.substr(marked, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.array(*[one(n) for n in range(least, most + 1)]))


def sentences(text: Column) -> Column:
    """Split after ``.!?:;`` or a line break that white space follows; empty parts go."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), r"(?<=[.!?:;\n])\s+"), lambda s: F.trim(s)), lambda s: s != "")


def clipped(text: Column, most: int = 220) -> Column:
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 3)), F.lit("..."))).otherwise(text)


def snippet(text: Column, start: Column, length: Column, around: int = 40) -> Column:
    """The match from 1-based ``start`` with ``around`` characters on both sides."""
    first = F.greatest(start - around, F.lit(1))
    return F.substr(text, first, start - first + length + around)


def hint_count(latin: Column, hints: frozenset[str]) -> Column:
    """How many of an array of lower-case words are among the hints."""
    return F.size(F.filter(latin, lambda w: w.isin(*sorted(hints))))


def arabic_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(_ARABIC_LETTERS))


def _latin_words(text: Column, head: int) -> Column:
    return F.regexp_extract_all(F.lower(F.substring(text, 1, head)), F.lit(f"({_LATIN})"), F.lit(1))


def language_of_layout(text: Column, head: int = 8000) -> Column:
    """Arabic from six letters and 2 % on, or if there is no Latin word; else the hint words of the first ``head`` characters
    vote, accents anywhere give French one vote more, and a tie is French. Text without Latin words is English.
    """
    t = F.coalesce(text, F.lit(""))

    def vote(latin: Column) -> Column:
        french = hint_count(latin, HINTS["fr"]) + F.when(F.lower(t).rlike("[èéêëàùçôîï]"), 1).otherwise(0)
        return F.when((F.size(latin) > 0) & (french >= hint_count(latin, HINTS["en"])), "fr").otherwise("en")

    def by_arabic(n: Column) -> Column:
        return F.when(((n >= 6) & (n >= 0.02 * F.length(t))) | ((n > 0) & ~t.rlike(_LATIN)), "ar")

    return F.coalesce(F.element_at(F.transform(F.array(arabic_count(t)), by_arabic), 1), F.element_at(F.transform(F.array(_latin_words(t, head)), vote), 1))


def language_of_grammar(text: Column, head: int = 8000) -> Column:
    """Any Arabic letter makes it Arabic; accents give French two votes, a tie is English."""
    t = F.trim(F.coalesce(text, F.lit("")))

    def vote(latin: Column) -> Column:
        french = hint_count(latin, GRAMMAR_HINTS["fr"]) + F.when(F.lower(t).rlike("[éèêàùçôîï]"), 2).otherwise(0)
        return F.when((F.size(latin) > 0) & (french > hint_count(latin, GRAMMAR_HINTS["en"])), "fr").otherwise("en")

    return F.when(t.rlike(_ARABIC_LETTERS), "ar").otherwise(F.element_at(F.transform(F.array(_latin_words(t, head)), vote), 1))


def emails(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({EMAIL})"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda e: F.lower(F.regexp_replace(e, r"\.+$", ""))))


def urls(text: Column) -> Column:
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"((?:www\.|https?://)[^\s<>\"')\]]+)"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda u: F.lower(F.regexp_replace(u, r"[.,;:]+$", ""))))


def phones(text: Column) -> Column:
    """Runs of digits and separators with 10 to 15 digits; a leading + stays."""
    runs = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([+]?[0-9][0-9 .()/\-]*[0-9])"), F.lit(1))
    kept = F.filter(runs, lambda r: F.length(F.regexp_replace(r, "[^0-9]", "")).between(10, 15))
    return F.array_distinct(F.transform(kept, lambda r: F.concat(F.when(r.startswith("+"), "+").otherwise(""), F.regexp_replace(r, "[^0-9]", ""))))


_DAY, _MONTH = "0*([1-9]|[12][0-9]|3[01])", "0*([1-9]|1[0-2])"
DAY_FIRST = "|".join(f"^{_DAY}{sep}{_MONTH}{sep}([0-9]{{4}})$".replace("(", "(?:") for sep in ("/", "-", r"\."))
YEAR_FIRST = "|".join(f"^([0-9]{{4}}){sep}{_MONTH}{sep}{_DAY}$".replace("(", "(?:") for sep in ("/", "-", r"\."))
_NAMES = "|".join(sorted(MONTHS, key=len, reverse=True))
WORD_DATE = (
    rf"(?i)\b(?:(?:{'|'.join(sorted(WEEKDAYS, key=len, reverse=True))})\s+)?[0-9]{{1,2}}(?:er)?\s+(?:de\s+)?(?:{_NAMES})\s+[0-9]{{2,4}}\b",
    rf"(?i)\b(?:{_NAMES})\s+[0-9]{{1,2}}(?:st|nd|rd|th)?(?:,)?\s+[0-9]{{2,4}}\b",
)


def first_date(text: Column) -> Column:
    """The first token that is a day-month-year or year-month-day date in range, as dd/mm/yyyy or yyyy-mm-dd; without one the first
    date with a month's name, as written; else null.
    """
    t = F.translate(F.coalesce(text, F.lit("")), _ARABIC_DIGITS, _ASCII_DIGITS)
    tokens = F.transform(F.split(t, r"[\s,;()\[\]{}<>]+"), lambda w: F.btrim(w, F.lit(" .,:;")))
    found = F.get(F.filter(tokens, lambda w: w.rlike(DAY_FIRST) | w.rlike(YEAR_FIRST)), 0)
    two = lambda x: F.lpad(F.regexp_replace(x, "^0+", ""), 2, "0")

    def written(date: Column) -> Column:
        part = lambda i: F.get(F.split(date, r"[/.\-]"), i)
        return F.when(date.rlike(DAY_FIRST), F.concat_ws("/", two(part(0)), two(part(1)), part(2))).otherwise(F.concat_ws("-", part(0), two(part(1)), two(part(2))))

    named = [F.nullif(F.regexp_extract(t, rx, 0), F.lit("")) for rx in WORD_DATE]
    return F.coalesce(F.element_at(F.transform(F.array(found), lambda d: F.when(d.isNotNull(), written(d))), 1), *[trimmed_value(n) for n in named])


def densest_amount(text: Column) -> Column:
    """The blank-separated token with the most digits, two at least; of equal ones the first."""
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda t: F.length(F.regexp_replace(t, "[^0-9]", "")) >= 2)
    ranked = F.transform(tokens, lambda t, i: F.struct((-F.length(F.regexp_replace(t, "[^0-9]", ""))).alias("n"), i.alias("i"), t.alias("t")))
    return F.array_min(ranked)["t"]


def currency(text: Column) -> Column:
    """The first currency, in a fixed order, one of whose names is anywhere in the text, inside words too."""
    plain = strip_accents(F.lower(F.coalesce(text, F.lit(""))))
    out = None
    for code, names in CURRENCIES:
        hit = F.lit(False)
        for name in names:
            hit = hit | plain.contains(name)
        out = F.when(hit, code) if out is None else out.when(hit, code)
    return out


def identifier_normal(value: Column) -> Column:
    return F.regexp_replace(F.upper(value), "[^A-Z0-9]+", "")


def is_identifier_field(name: Column) -> Column:
    """Whether a field's name has one of the words that identifiers are called by."""
    return F.lower(F.trim(name)).rlike("id|ref|num|invoice|facture|contract|contrat|commande|order|bc|doc|dossier")


def is_code_like(value: Column) -> Column:
    """One token of letters and digits, both there, with at most six letters before a dash, stroke or underscore."""
    v = F.translate(F.trim(value), _ARABIC_DIGITS, _ASCII_DIGITS)
    return v.rlike("^[A-Za-z]{0,6}[-_/]?[A-Za-z0-9]{2,}$") & v.rlike("[A-Za-z]") & v.rlike("[0-9]")


def reference_code(value: Column) -> Column:
    """A code in upper case without other marks: three to eight digits, or letters with digits; else null."""
    code = F.regexp_replace(F.upper(F.translate(F.trim(value), _ARABIC_DIGITS, _ASCII_DIGITS)), "[^A-Z0-9_-]", "")
    return F.when(code.rlike("^[0-9]{3,8}$") | is_code_like(code), code)


def compact_keyword(raw: Column) -> Column:
    """``keyword(xN,±S,bucket)`` as a struct of keyword, count, score and bucket; any other text is a keyword alone."""
    shape = r"^(.*?)\(x([0-9]+)(?:,([+-]?[0-9]+))?(?:,([^)]*))?\)$"
    t = F.trim(raw)
    part = lambda i: F.nullif(F.trim(F.regexp_extract(t, shape, i)), F.lit(""))
    fits = t.rlike(shape)
    return F.struct(F.when(fits, F.coalesce(part(1), t)).otherwise(F.nullif(t, F.lit(""))).alias("keyword"), F.when(fits, part(2).cast("long")).alias("count"), F.when(fits, part(3).cast("double")).alias("score"), F.when(fits, part(4)).alias("bucket"))


def compact_keyword_text(keyword: Column, count: Column, score: Column, bucket: Column) -> Column:
    return F.concat(keyword, F.lit("(x"), count.cast("string"), F.lit(","), F.when(score >= 0, "+").otherwise(""), score.cast("long").cast("string"), F.lit(","), bucket, F.lit(")"))


def detected(kind: Column, text: Column) -> Column:
    """Values found by the detector that ``kind`` names, as an array; other kinds give the trimmed text."""
    single = lambda c: F.filter(F.array(c), lambda x: x.isNotNull())
    return (
        F.when(kind == "email", emails(text)).when(kind.isin("url", "site"), urls(text)).when(kind == "phone", phones(text))
        .when(kind == "date", single(first_date(text))).when(kind == "amount", single(densest_amount(text))).when(kind == "currency", single(currency(text)))
        .otherwise(F.filter(F.array(trimmed_value(text)), lambda x: x != ""))
    )


def first_present(*columns: str) -> Column:
    """The first column that has a value, even an empty one."""
    return F.coalesce(*columns)


def first_filled(*columns: str) -> Column:
    """The first column that has more than white space, else the last one."""
    return F.coalesce(*[F.nullif(F.trim(c), F.lit("")) for c in columns[:-1]], F.col(columns[-1]))
