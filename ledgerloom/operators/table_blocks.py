"""Blocks of table lines on pages, found by the words and the geometry of lines.

Which lines make one block depends on all lines before, so a page is walked through line by line, in Python over Arrow batches; pages are independent and nothing is shuffled.
Two collectors look at each page: one goes by the positions under a header, the other by single lines; the first one's blocks win.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache, wraps

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import numbers as nb, text as tx

GAP, TOLERANCE = 3, 3
STRONG = "ARTICLE DESCRIPTION DESIGNATION ITEM ITEMS P.UNITAIRE PRICE PRIX PRODUCT PRODUIT QNTY QTE QTY QUANTITE QUANTITY REF REFERENCE SERVICE SERVICES UNIT UNITAIRE VALEUR".split() + ["P UNITAIRE"]
WEAK = "AMOUNT HT MONTANT TOTAL TTC TVA VAT".split()
STOPS = "ACOMPTE|ADVANCE|AMOUNT DUE|DISCOUNT|FRAIS|FRAIS DE LIVRAISON|FRAIS DE PORT|LIVRAISON|MONTANT A PAYER|MONTANT HT|MONTANT TTC|NET A PAYER|NET PAYABLE|PORT|REMISE|SHIPPING|SHIPPING COST|SOUS TOTAL|STAMP|SUBTOTAL|TAX|TAXES|TIMBRE|TOTAL DUE|TOTAL HT|TOTAL TTC|TVA|VAT".split("|")
FOOTERS = "AMOUNT DUE|CACHET|DATA INFO|DATE ECHEANCE|ECHEANCE|FACTURE EN LETTRE|MODE DE PAIEMENT|NON ASSUJETTI|NON ASSUJETTI A LA TVA|PAYMENT METHOD|SIGNATURE|TERMS CONDITIONS".split("|")
CLOSERS = "AMOUNT DUE|CACHET|DATA INFO|FACTURE EN LETTRE|MODE DE PAIEMENT|MONTANT A PAYER|NON ASSUJETTI|SIGNATURE|TERMS CONDITIONS|TOTAL DUE".split("|")
SUMS = "AMOUNT HT MONTANT STAMP TAX TIMBRE TOTAL TTC TVA VAT".split()
ASIDE = "ADDRESS|ADRESSE|BIC|CACHET|CLIENT|DATE|ECHEANCE|EFFECTIVE|FISCAL|IBAN|IDENT|N ART|PAIEMENT|PAYMENT|PHONE|SIGNATURE|SWIFT|TEL|TELEPHONE".split("|")
COLUMNS = "ARTICLE ITEM ITEMS PRICE PRIX PRODUCT PRODUIT QNTY QTE QTY".split()

_DIGITS = str.maketrans(tx._ARABIC_DIGITS, tx._ASCII_DIGITS)
_PLAIN = {ord(a): b for a, b in zip(tx._ACCENTED, tx._PLAIN)} | {ord(a): None for a in tx._ACCENTED[len(tx._PLAIN) :]}
_CURRENCY = re.compile(nb.CURRENCY_WORD)
_UNITS = re.compile(r"(?i)\b(?:aed|chf|da|dzd|eur|gbp|ht|mad|sar|tnd|ttc|tva|usd)\b")
_DATE = re.compile(r"\b\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b")
_CODE = re.compile(r"[A-Za-z]{0,6}[-_/]?[A-Za-z0-9]{2,}")


def remembered(function: Callable[[str], object]) -> Callable[[str], object]:
    """What a function made of short texts; long ones hardly come twice and would fill the memory."""
    known = lru_cache(maxsize=1 << 15)(function)

    @wraps(function)
    def of(text: str):
        return known(text) if len(text) <= 100 else function(text)

    return of


_KEPT, _BLANKS, _DIGIT_RUN, _TOKEN, _SIMPLE = re.compile(r"[^A-Za-z0-9+./%\-]+"), re.compile(" +"), re.compile("[0-9]+"), re.compile(r"\S+"), re.compile(r"[0-9]+(?:\.[0-9]+)?")


@remembered
def plain(text: str) -> str:
    """Upper case without accents, only letters, digits and ``+./%-`` between single blanks."""
    t = text if text.isascii() else text.translate(_DIGITS).translate(_PLAIN)
    return _BLANKS.sub(" ", _KEPT.sub(" ", t)).strip().upper()


def squeezed(text: str) -> str:
    return " ".join((text if text.isascii() else text.translate(_DIGITS)).split())


@remembered
def is_code(text: str) -> bool:
    t = squeezed(text)
    return bool(_CODE.fullmatch(t)) and any(map(str.isalpha, t)) and any(map(str.isdigit, t))


def _number(token: str) -> float | None:
    s = token.strip().replace(" ", "")
    sign, s = (-1.0 if s.startswith("-") else 1.0), s.lstrip("+-")
    commas, dots = s.count(","), s.count(".")
    if commas and dots:
        s = s.replace(".", "").replace(",", ".") if s.rfind(",") > s.rfind(".") else s.replace(",", "")
    elif commas:
        s = s.replace(",", "." if commas == 1 and len(s) - s.rfind(",") <= 3 else "")
    elif dots > 1:
        s = s.replace(".", "", dots - 1) if len(s) - s.rfind(".") <= 3 else s.replace(".", "")
    try:
        return sign * float(s)
    except ValueError:
        return None


@remembered
def amount(text: str) -> float | None:
    """What :func:`numbers.amount` makes of a text."""
    if _SIMPLE.fullmatch(text):
        return float(text)
    t = squeezed(text)
    if not t or is_code(t):
        return None
    norm = plain(t)
    hinted = any(h in norm for h in nb.MONEY_HINTS)
    coined = bool(_CURRENCY.search(t))
    if (any(map(str.isalpha, t)) and not (hinted or coined)) or (_DATE.search(t) and not hinted) or (("/" in t or t.count("-") >= 2) and not (hinted or coined)):
        return None
    found = [_number(x) for x in re.findall(r"[+\-]?\d[\d\s.,]*", _UNITS.sub(" ", t))]
    return next((x for x in reversed(found) if x is not None), None)


@remembered
def is_quantity(text: str) -> bool:
    if _SIMPLE.fullmatch(text):
        return True
    t = squeezed(text)
    return not (any(map(str.isalpha, t)) or "/" in t or t.count("-") >= 2 or _DATE.search(t)) and bool(re.fullmatch(r"[+\-]?\d+(?:\.\d+)?", re.sub(r"[^0-9.+\-]", "", t.replace(",", "."))))


@remembered
def is_numeric(cell: str) -> bool:
    return amount(cell) is not None or is_quantity(cell)


@remembered
def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _tail(raw: str) -> list[str]:
    """A text and the numbers that end its line, each a cell; two pieces of one number, parted by a blank, are joined."""
    tokens = raw.split()
    at = len(tokens)
    while at and not is_code(tokens[at - 1]) and not any(map(str.isalpha, tokens[at - 1])) and (is_numeric(tokens[at - 1]) or re.fullmatch(r"[+\-]?\d[\d.,/%]*", tokens[at - 1].translate(_DIGITS))):
        at -= 1
    if at in (0, len(tokens)):
        return []
    out, i = [" ".join(tokens[:at])], at
    while i < len(tokens):
        both = " ".join(tokens[i : i + 2])
        if i + 1 < len(tokens) and amount(both) is not None and (amount(tokens[i]) is None or len(re.sub(r"\D", "", tokens[i])) <= 2):
            out.append(both)
            i += 2
        else:
            out.append(tokens[i])
            i += 1
    return out


def cells_of(line: str) -> list[str]:
    """Parts between ``|``, tabs, two blanks or ``;``; else a text and the numbers at its end."""
    raw = line.replace(" ", " ").replace("\r", "")
    if "|" in raw:
        parts = raw.split("|")
    elif "\t" in raw:
        parts = raw.split("\t")
    else:
        parts = re.split(r"\s{2,}", raw.strip())
        if len(parts) < 2 and ";" in raw:
            parts = raw.split(";")
    parts = [p.strip() for p in parts if p.strip()]
    return parts if len(parts) >= 2 else _tail(raw) or parts


def _hits(norm: str, words: list[str]) -> int:
    return sum([w in norm for w in words])


@remembered
def _words_of(shape: str) -> tuple[int, ...]:
    """How many words of each list a text has. None of them has a digit, so texts that differ in their numbers only are one ``shape``."""
    return tuple(_hits(shape, words) for words in (STRONG, WEAK, STOPS, FOOTERS, SUMS, CLOSERS, ASIDE, COLUMNS))


@remembered
def _aside(norm: str) -> bool:
    shape = _words_of(_DIGIT_RUN.sub("0", norm))
    return shape[6] + shape[2] + shape[3] > 0


@dataclass
class Line:
    """A line's cells, segments (parts three blanks apart) with their places, and what its words say."""

    raw: str
    cells: list[str] = field(init=False)

    def __post_init__(self):
        self.raw = self.raw.replace(" ", " ").rstrip("\r\n")
        self.cells, self.norm = cells_of(self.raw), plain(self.raw)
        self.tokens = [(m.group(), m.start(), m.end()) for m in _TOKEN.finditer(self.raw)]
        self.starts = [t[1] for t in self.tokens]
        gaps = [b[1] - a[2] for a, b in zip(self.tokens, self.tokens[1:])]
        self.gaps = sum([g >= GAP for g in gaps])
        parts: list[tuple[list[str], int]] = []
        for i, (word, start, _) in enumerate(self.tokens):
            if i and gaps[i - 1] < GAP:
                parts[-1][0].append(word)
            else:
                parts.append(([word], start))
        self.segments = [(" ".join(words), start) for words, start in parts]
        self.strong, self.weak, self.stops, self.footers, self.sums, self.closers, self.aside, self.columns = _words_of(_DIGIT_RUN.sub("0", self.norm))
        self.hint = 2 * self.strong + min(self.weak, 2)

    def footer(self, cells: list[str] | None = None) -> bool:
        hits = self.stops + self.footers
        few = len(self.cells if cells is None else cells) <= 2
        return hits >= 2 or (hits == 1 and not self.strong) or (self.sums >= 2 and not self.strong and few) or self.closers > 0

    def header(self, cells: list[str] | None = None) -> bool:
        cells = self.cells if cells is None else cells
        return not self.footer(cells) and (self.strong >= 2 or self.hint >= 4 or (self.hint == 3 and len(cells) >= 3))

    def tabular(self, cells: list[str] | None = None) -> bool:
        cells = self.cells if cells is None else cells
        if not cells or self.footer(cells):
            return False
        if (len(cells) == 1 and is_code(cells[0])) or len(cells) >= 4:
            return True
        numeric = sum(map(is_numeric, cells))
        texts = sum([has_letter(c) or not is_quantity(c) for c in cells])
        if numeric >= 2 or self.header(cells) or (len(cells) == 3 and numeric and texts):
            return True
        if len(cells) == 2 and numeric:
            if amount(cells[1]) is None:
                return False
            return is_code(cells[0]) or (texts > 0 and ":" not in cells[0] and not _aside(plain(cells[0])))
        return self.columns > 0

    def score(self, before: Line | None, after: Line | None) -> float:
        """How much the line looks like a table's: gaps, tokens, tokens under those of a neighbour, header words, text with numbers; less for prose."""
        n = len(self.tokens)
        if not n:
            return -1.0
        alpha = n >= 8 and not self.gaps and sum([has_letter(t[0]) for t in self.tokens])
        mixed = self.gaps > 0 and any(has_letter(t[0]) for t in self.tokens) and any(is_numeric(t[0]) for t in self.tokens)
        header = self.header()
        out = 0.8 * min(4, self.gaps) + 0.2 * min(8, n) + 1.4 * max(self._under(before), self._under(after)) + 1.9 * header + 0.85 * mixed
        return out - 1.3 * (n >= 8 and not self.gaps and alpha / n >= 0.65) - 0.5 * (n == 1 and not header)

    def _under(self, other: Line | None) -> float:
        """The share of tokens that begin under or over one of another line's."""
        if not other or not other.starts:
            return 0.0
        places, last = other.starts, len(other.starts)
        found = 0
        for a in self.starts:
            i = bisect_left(places, a - TOLERANCE)
            found += i < last and places[i] <= a + TOLERANCE
        return found / len(self.starts)


#: Headers, totals and blank lines come again and again.
_common_line = lru_cache(maxsize=1 << 12)(Line)


def line_of(raw: str) -> Line:
    return _common_line(raw) if len(raw) <= 100 else Line(raw)


def anchors_of(line: Line) -> list[int]:
    """Where the header's parts begin; of a header without wide gaps where its words do."""
    for places, apart in (([s for _, s in line.segments], 1), (line.starts, GAP)):
        out: list[int] = []
        for s in places:
            if not out or s - out[-1] > apart:
                out.append(s)
        if len(out) >= 2:
            break
    return out


def under(segments: list[tuple[str, int]], anchors: list[int]) -> list[str]:
    """The segments as cells, each under its nearest anchor."""
    out = [""] * len(anchors)
    for text, start in segments:
        i = min(range(len(anchors)), key=lambda k: abs(start - anchors[k]))
        out[i] = f"{out[i]} {text}".strip()
    while out and not out[-1]:
        out.pop()
    return out


Block = list[tuple[int, list[str]]]


def anchored(lines: list[Line]) -> list[Block]:
    """Blocks of lines whose parts stand under those of a header or of a very table-like line; two misfits in a row end one."""
    blocks, taken = [], -1
    for h, head in enumerate(lines):
        if h <= taken or len(head.segments) < 2:
            continue
        if not head.header():
            score = head.score(lines[h - 1] if h else None, lines[h + 1] if h + 1 < len(lines) else None)
            if not (score >= 2.6 and head.gaps and len(head.segments) >= 3):
                continue
        anchors = anchors_of(head)
        cells = under(head.segments, anchors) if len(anchors) >= 2 else []
        if len(cells) < 2 or not (head.header(cells) or head.gaps >= 2):
            continue
        block, misses, end, aligned = [(h, cells)], 0, h, 1
        for j in range(h + 1, len(lines)):
            line = lines[j]
            if not line.tokens:
                misses += 1
                if misses > 1:
                    break
                continue
            fit = sum(any(abs(s - a) <= TOLERANCE for a in anchors) for _, s in line.segments)
            good = fit >= 2 or fit / len(line.segments) >= 0.5
            own = under(line.segments, anchors)
            own = own if len(own) >= 2 else line.cells
            tabular = line.tabular(own)
            if line.footer(own) or (not line.hint and line.aside and not fit and not tabular):
                break
            if good or tabular or (fit and own and is_code(own[0])):
                block.append((j, own))
                end, misses, aligned = j, 0, aligned + good
            else:
                misses += 1
                if misses >= 2:
                    break
        if len(block) >= 2 and (aligned >= 2 or len(block) >= 3):
            blocks.append(block)
            taken = max(taken, end)
    return blocks


def classic(lines: list[Line]) -> list[Block]:
    """Blocks of lines that look tabular by themselves; one other line may stand between, and a header before goes with them."""
    blocks: list[Block] = []
    current: Block = []
    pending: tuple[int, list[str]] | None = None
    idle = 0

    def strong(at: int, cells: list[str]) -> bool:
        numeric = sum(map(is_numeric, cells))
        return numeric >= 2 or (len(cells) >= 2 and numeric == 1 and is_code(cells[0])) or lines[at].header(cells)

    def close() -> None:
        if len(current) >= 2 or (current and strong(*current[0])):
            blocks.append(list(current))
        current.clear()

    for i, line in enumerate(lines):
        if line.footer() and current:
            close()
            pending, idle = None, 0
            continue
        if line.tabular():
            if not current and pending and lines[pending[0]].raw != line.raw:
                current.append(pending)
            current.append((i, line.cells))
            pending, idle = ((i, line.cells) if line.header() else None), 0
            continue
        if line.header() and len(line.cells) >= 2:
            pending = (i, line.cells)
        if current:
            idle += 1
            if idle > 1:
                close()
                idle = 0
    close()
    return blocks


def blocks_of(text: str) -> list[Block]:
    """The page's blocks; of two with the same first line, last line and number of lines the first counts. A block has two lines or more."""
    lines = [line_of(x) for x in text.split("\n")]
    out, seen = [], set()
    for block in anchored(lines) + classic(lines):
        words = [" ".join(lines[i].raw.split()) for i, _ in block if lines[i].tokens]
        if len(words) >= 2 and (key := (words[0], words[-1], len(words))) not in seen:
            seen.add(key)
            out.append(block)
    return out


def table_rows(pages: DataFrame) -> DataFrame:
    """doc_id, page_index, block (from 1), row (from 1), line (from 0), cells of every line of every block of the pages (doc_id, page_index, text); null texts have none."""
    kind, page = (pages.schema[c].dataType.simpleString() for c in ("doc_id", "page_index"))
    names = ["doc_id", "page_index", "block", "row", "line", "cells"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                for b, block in enumerate(blocks_of(text or ""), 1):
                    for r, (line, cells) in enumerate(block, 1):
                        at.append(i), rows.append((b, r, line, cells))
            columns = list(zip(*rows)) if rows else [()] * 4
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.string())]
            place = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(place), batch.column(1).take(place), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=names)

    return pages.select("doc_id", "page_index", "text").mapInArrow(run, f"doc_id {kind}, page_index {page}, block int, row int, line int, cells array<string>")


def line_scores(pages: DataFrame) -> DataFrame:
    """doc_id, page_index, line (from 0), n_tokens, n_segments, gaps, is_header, is_footer, score of every line of the pages."""
    kind, page = (pages.schema[c].dataType.simpleString() for c in ("doc_id", "page_index"))
    names = ["doc_id", "page_index", "line", "n_tokens", "n_segments", "gaps", "is_header", "is_footer", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, rows = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                lines = [line_of(x) for x in text.split("\n")] if text is not None else []
                for n, line in enumerate(lines):
                    score = line.score(lines[n - 1] if n else None, lines[n + 1] if n + 1 < len(lines) else None)
                    at.append(i), rows.append((n, len(line.tokens), len(line.segments), line.gaps, line.header(), line.footer(), round(score, 6)))
            columns = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int32()] * 4 + [pa.bool_()] * 2 + [pa.float64()]
            place = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(place), batch.column(1).take(place), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=names)

    return pages.select("doc_id", "page_index", "text").mapInArrow(run, f"doc_id {kind}, page_index {page}, line int, n_tokens int, n_segments int, gaps int, is_header boolean, is_footer boolean, score double")
