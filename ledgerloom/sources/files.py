"""Files of any kind as documents and pages.

Type sniffing and HTML are expressions over the ``binaryFile`` source; the ZIP-based office formats are opened with the standard library, batch by
batch. Formats whose readers aren't installed (PDF text, images, OCR) come through a function that the caller passes.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

_OPEN_XML, _OASIS = "application/vnd.openxmlformats-officedocument", "application/vnd.oasis.opendocument"
MIME = {
    "pdf": "application/pdf", "tiff": "image/tiff", "png": "image/png", "jpg": "image/jpeg", "webp": "image/webp", "epub": "application/epub+zip",
    "docx": f"{_OPEN_XML}.wordprocessingml.document", "xlsx": f"{_OPEN_XML}.spreadsheetml.sheet", "pptx": f"{_OPEN_XML}.presentationml.presentation",
    "odt": f"{_OASIS}.text", "ods": f"{_OASIS}.spreadsheet", "odp": f"{_OASIS}.presentation", "zip": "application/zip", "ole": "application/x-ole-storage",
}
IMAGES = ("tiff", "png", "jpg", "webp")
OFFICE = ("docx", "xlsx", "pptx", "odt", "ods", "odp", "epub")


def html_text(html: Column) -> Column:
    """Line ends for ``<br>`` and ``</p>``, a blank for any other tag; entities and the insides of scripts stay."""
    t = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?i)<br\s*/?>", "\n")
    t = F.regexp_replace(t, r"(?i)</p\s*>", "\n")
    return F.btrim(F.regexp_replace(t, r"<[^>]+>", " "), F.lit(" \t\n\r"))


def magic_type(content: Column) -> Column:
    """The type by the first bytes; ``zip`` and ``ole`` are families; null for an unknown one."""
    head = F.hex(F.substring(content, 1, 12))
    starts = lambda *prefixes: head.rlike("^(?:" + "|".join(prefixes) + ")")
    return (
        F.when(starts("255044462D"), "pdf").when(starts("49492A00", "4D4D002A"), "tiff").when(starts("89504E470D0A1A0A"), "png").when(starts("FFD8FF"), "jpg")
        .when(starts("52494646.{8}57454250"), "webp").when(starts("504B0304", "504B0506"), "zip").when(starts("D0CF11E0A1B11AE1"), "ole")
    )


def zip_type(content: bytes) -> str:
    """Which of the ZIP-based formats by the members' names; ``zip`` if none or damaged."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = set(z.namelist())
            mime = z.read("mimetype")[:80].decode("ascii", "replace") if "mimetype" in names else ""
    except (zipfile.BadZipFile, OSError, RuntimeError, ValueError):
        return "zip"
    if "epub" in mime or "META-INF/container.xml" in names:
        return "epub"
    for kind, member in (("docx", "word/document.xml"), ("xlsx", "xl/workbook.xml"), ("pptx", "ppt/presentation.xml")):
        if member in names:
            return kind
    return next((k for k, m in MIME.items() if k in ("odt", "ods", "odp") and m == mime.strip()), "zip")


def sniffed(files: DataFrame) -> DataFrame:
    """``files`` (path, content) with ext, mime and is_text, whether the bytes are valid UTF-8 without zero bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [zip_type(c.as_py()) if k == "zip" else k for k, c in zip(batch.column(0).to_pylist(), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(found, pa.string())], names=["path", "content", "ext"])

    typed = files.select(magic_type(F.col("content")).alias("kind"), "path", "content").mapInArrow(run, "path string, content binary, ext string")
    mimes = F.create_map(*[x for k, v in MIME.items() for x in (F.lit(k), F.lit(v))])
    text = F.is_valid_utf8(F.col("content").cast("string")) & ~F.col("content").cast("string").contains("\u0000")
    return typed.withColumn("mime", F.try_element_at(mimes, F.col("ext"))).withColumn("is_text", F.col("ext").isNull() & text)


def content_kind(ext: Column, has_text: Column) -> Column:
    """text, image_only or unsupported; spreadsheets are always text."""
    return F.when(ext.isin("xlsx", "ods") | has_text, "text").when(ext.isin("pdf", *IMAGES), "image_only").when(ext.isin(*OFFICE), "image_only").otherwise("unsupported")


def read_files(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(list(paths)).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


def missing_paths(wanted: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``wanted`` (path) that ``found`` doesn't have; a scheme before the path doesn't matter."""
    bare = F.regexp_replace("path", "^[a-z]+:/+", "/")
    return wanted.withColumn("__p", bare).join(found.select(bare.alias("__p")), "__p", "left_anti").drop("__p")


def decoded(content: Column) -> Column:
    """UTF-8, its mark taken off, or Latin-1 if the bytes aren't UTF-8."""
    utf8 = content.cast("string")
    return F.when(F.is_valid_utf8(utf8), F.regexp_replace(utf8, "^﻿", "")).otherwise(F.decode(content, "ISO-8859-1"))


def _tag(element) -> str:
    return element.tag.rpartition("}")[2]


def _paragraphs(root, paragraph: tuple[str, ...], text: str) -> Iterator[str]:
    for p in root.iter():
        if _tag(p) in paragraph:
            yield "".join(x.text or "" for x in p.iter() if _tag(x) == text)


def _docx(z: zipfile.ZipFile) -> list[str]:
    pages, lines = [], []
    for p in ElementTree.fromstring(z.read("word/document.xml")).iter():
        if _tag(p) != "p":
            continue
        line = ""
        for x in p.iter():
            name = _tag(x)
            if name == "t":
                line += x.text or ""
            elif name == "tab":
                line += "\t"
            elif name == "lastRenderedPageBreak" or (name == "br" and any(k.endswith("type") and v == "page" for k, v in x.attrib.items())):
                lines.append(line)
                pages.append("\n".join(lines).strip())
                lines, line = [], ""
        lines.append(line)
    return [*pages, "\n".join(lines).strip()]


def _numbered(z: zipfile.ZipFile, pattern: str) -> list[str]:
    names = [(int(m[1]), n) for n in z.namelist() if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(names)]


def _pptx(z: zipfile.ZipFile) -> list[str]:
    return ["\n".join(filter(None, _paragraphs(ElementTree.fromstring(z.read(n)), ("p",), "t"))) for n in _numbered(z, r"ppt/slides/slide([0-9]+)\.xml")]


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n


def _xlsx(z: zipfile.ZipFile) -> list[str]:
    shared = []
    if "xl/sharedStrings.xml" in z.namelist():
        shared = ["".join(t.text or "" for t in x.iter() if _tag(t) == "t") for x in ElementTree.fromstring(z.read("xl/sharedStrings.xml")) if _tag(x) == "si"]
    pages = []
    for name in _numbered(z, r"xl/worksheets/sheet([0-9]+)\.xml"):
        rows = []
        for row in ElementTree.fromstring(z.read(name)).iter():
            if _tag(row) != "row":
                continue
            cells: list[str] = []
            for c in row:
                value = "".join(x.text or "" for x in c.iter() if _tag(x) in ("v", "t"))
                if c.get("t") == "s" and value.isdigit() and int(value) < len(shared):
                    value = shared[int(value)]
                at = _column(c.get("r") or "") or len(cells) + 1
                cells += [""] * (at - len(cells))
                cells[at - 1] = value
            rows.append("\t".join(cells))
        pages.append("\n".join(rows))
    return pages


def _flow(p) -> str:
    """An OpenDocument paragraph's text, with its blanks, tabs and line breaks."""
    out = p.text or ""
    for x in p:
        name = _tag(x)
        if name == "s":
            out += " " * int(next((v for k, v in x.attrib.items() if k.endswith("}c")), "1"))
        elif name in ("tab", "line-break"):
            out += "\t" if name == "tab" else "\n"
        else:
            out += _flow(x)
        out += x.tail or ""
    return out


def _opendocument(z: zipfile.ZipFile) -> list[str]:
    return ["\n".join(_flow(p) for p in ElementTree.fromstring(z.read("content.xml")).iter() if _tag(p) in ("p", "h"))]


def _epub(z: zipfile.ZipFile) -> list[str]:
    pages = []
    for name in sorted(n for n in z.namelist() if re.search(r"\.x?html?$", n.lower())):
        text = re.sub(r"<[^>]+>", " ", re.sub(r"(?i)<br\s*/?>|</p\s*>", "\n", z.read(name).decode("utf-8", "replace")))
        pages.append(text.strip())
    return pages


_READERS: dict[str, Callable[[zipfile.ZipFile], list[str]]] = {"docx": _docx, "pptx": _pptx, "xlsx": _xlsx, "odt": _opendocument, "ods": _opendocument, "odp": _opendocument, "epub": _epub}


def office_pages(content: bytes, ext: str) -> list[str]:
    """The pages' texts of a ZIP-based office file; none for a damaged one."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return _READERS[ext](z)
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, OSError, RuntimeError, ValueError):
        return []


def extracted(files: DataFrame, readers: dict[str, Callable[[bytes], list[str]]] | None = None) -> DataFrame:
    """path, ext, extraction, pages_text from ``files`` (path, content).

    extraction: native for text, HTML and office files, the type's name for types with a function in ``readers`` (bytes to a list of page texts), none for the rest.
    """
    more = dict(readers or {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            how, pages = [], []
            for ext, content in zip(batch.column(1).to_pylist(), batch.column(2)):
                if ext in _READERS:
                    how.append("native"), pages.append(office_pages(content.as_py(), ext))
                elif ext in more:
                    how.append(ext), pages.append(list(more[ext](content.as_py())))
                else:
                    how.append("none"), pages.append([])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(how, pa.string()), pa.array(pages, pa.list_(pa.string()))], names=["path", "ext", "extraction", "pages_text"])

    typed = sniffed(files)
    plain = typed.filter(F.col("ext").isNull())
    text = decoded(F.col("content"))
    text = F.when(F.lower("path").rlike(r"\.x?html?$"), html_text(text)).otherwise(text)
    native = plain.select("path", F.when(F.lower("path").rlike(r"\.x?html?$"), "html").otherwise("txt").alias("ext"), F.lit("native").alias("extraction"), F.array(text).alias("pages_text"))
    return native.unionByName(typed.filter(F.col("ext").isNotNull()).select("path", "ext", "content").mapInArrow(run, "path string, ext string, extraction string, pages_text array<string>"))


def padded_pages(pages: Column, count: Column) -> Column:
    """The page texts cut or filled with empty ones to ``count`` pages."""
    n = F.greatest(F.coalesce(count, F.size(pages)), F.lit(0))
    return F.slice(F.concat(pages, F.array_repeat(F.lit(""), F.greatest(n - F.size(pages), F.lit(0)))), F.lit(1), n)


def lfs_pointers(files: DataFrame) -> DataFrame:
    """path, oid, size of the files that stand for a large one kept elsewhere."""
    text = F.col("content").cast("string")
    found = files.filter(F.length("content") < 1024).select("path", F.regexp_extract(text, r"oid sha256:([0-9a-f]{64})", 1).alias("oid"), F.regexp_extract(text, r"(?m)^size ([0-9]+)", 1).try_cast("bigint").alias("size"))
    return found.filter((F.col("oid") != "") & F.col("size").isNotNull())


def resolved_pointers(pointers: DataFrame, files: DataFrame) -> DataFrame:
    """path, target: the files of a pointer's size and SHA-256; files of other sizes aren't hashed."""
    sized = files.withColumn("size", F.length("content").cast("bigint")).join(pointers.select("size").distinct(), "size", "left_semi")
    hashed = sized.select("size", F.sha2("content", 256).alias("oid"), F.col("path").alias("target"))
    return pointers.join(hashed, ["size", "oid"]).groupBy("path").agg(F.min("target").alias("target"))


def manifests(spark: SparkSession, folder: str, newest: int = 100) -> DataFrame:
    """The newest upload manifests of a folder of JSON files."""
    return spark.read.option("multiLine", True).json(folder).orderBy(F.desc("received_at"), "job_id").limit(newest)
