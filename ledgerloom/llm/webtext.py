"""HTML extraction by consensus host paths.

Each page's containers are scored by the running text in them. A container's path is that of its
tags and classes, digits left out, so that pages made from one template share paths. The pages
of a host vote for paths with their scores, and each page is then extracted again from the winning path; a page without it
uses its own best container.

A page is parsed once, into a tree of paths in which each knows its parent, and the blocks of text with their place in it;
that is stored, and both the votes and the second extraction read it. Paths are told apart by a digest that chains from
the parent's, and are spelled out only where they are returned, so that memory and time grow in proportion to the page however deep it nests.
"""

from __future__ import annotations

import html as html_module
import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .workspace import written

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>?", re.S)
_CLASS = re.compile(r"""\bclass\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_RAW = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in ("script", "style", "noscript", "template", "textarea", "svg", "iframe", "title")}
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_INLINE = frozenset("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var".split())
_LEAF = frozenset("p li h1 h2 h3 h4 h5 h6 dt dd blockquote pre figcaption caption summary".split())
_ASIDE = frozenset("nav aside form button select footer menu head".split())
_SPACE = re.compile(r"\s+")
_DIGITS = re.compile(r"\d+")
LEAST_CHARS = 25
#: Places over which a host's pages are spread when they meet its winning path.
SALTS = 16


class Page:
    """The paths of a page's containers and its blocks of text.

    Path 0 is the page's own, without a name. Unclosed tags are closed by what must end them: an end tag closes all that was opened inside it, a block closes an open paragraph.
    """

    def __init__(self, source: str):
        self.names: list[str] = [""]
        self.parents: list[int] = [-1]
        self.blocks: list[tuple[int, bool, str, int]] = []  # path, aside, text, characters in links
        known: dict[tuple[int, str], int] = {}
        stack: list[tuple[str, int, bool]] = [("", 0, False)]
        opened: Counter[str] = Counter()
        pieces: list[str] = []
        links, open_links, at = 0, 0, 0

        def flush() -> None:
            nonlocal links
            if pieces:
                text = _SPACE.sub(" ", html_module.unescape("".join(pieces))).strip()
                if text:
                    self.blocks.append((stack[-1][1], stack[-1][2], text, min(links, len(text))))
                pieces.clear()
            links = 0

        while True:
            found = _TAG.search(source, at)
            text = source[at : found.start()] if found else source[at:]
            if text:
                pieces.append(text)
                if open_links:
                    links += len(text)
            if not found:
                break
            at, (close, tag, attributes) = found.end(), found.groups()
            if tag is None:
                continue
            tag = tag.lower()
            if tag == "a":
                open_links = 0 if close else 1
            if tag in _INLINE:
                continue
            if tag == "br":
                pieces.append("\n")
                continue
            if tag in _RAW and not close:
                end = _RAW[tag].search(source, at)
                at = end.end() if end else len(source)
                continue
            flush()
            if tag in _VOID:
                continue
            open_links = 0
            if close:
                while opened[tag]:
                    last = stack.pop()[0]
                    opened[last] -= 1
                    if last == tag:
                        break
                continue
            if stack[-1][0] == "p" or (stack[-1][0] == tag and tag in ("li", "dt", "dd", "tr", "td", "th", "option")):
                opened[stack.pop()[0]] -= 1
            node = stack[-1][1]
            if tag not in _LEAF and tag not in ("html", "body"):
                classes = _CLASS.search(attributes) if "class" in attributes or "CLASS" in attributes else None
                name = tag
                if classes:
                    kinds = sorted({k for k in (_DIGITS.sub("", c.lower()).strip("-_") for c in (classes[1] or classes[2] or classes[3] or "").split()) if k})
                    name = ".".join([tag, *kinds])
                own = known.get((node, name))
                if own is None:
                    own = known[node, name] = len(self.names)
                    self.names.append(name)
                    self.parents.append(node)
                node = own
            opened[tag] += 1
            stack.append((tag, node, stack[-1][2] or tag in _ASIDE))
        flush()

    def scores(self) -> dict[int, float]:
        """Score of each path: running text counts for its container, by half for the one around it."""
        out: dict[int, float] = {}
        for node, aside, text, links in self.blocks:
            if aside or len(text) < LEAST_CHARS:
                continue
            gain = (1 + text.count(",") + min(len(text) / 100, 3.0)) * (1 - links / len(text))
            for share in (1.0, 0.5):
                out[node] = out.get(node, 0.0) + gain * share
                node = self.parents[node]
                if node < 0:
                    break
        return out

    def keys(self) -> list[bytes]:
        """The digest of each path, the same on every page."""
        out = [b""]
        for name, parent in zip(self.names[1:], self.parents[1:]):
            out.append(blake2b(out[parent] + name.encode("utf-8", "surrogatepass"), digest_size=16).digest())
        return out

    def lengths(self) -> list[int]:
        """The characters of each path when spelled out."""
        out = [0]
        for name, parent in zip(self.names[1:], self.parents[1:]):
            out.append(out[parent] + len(name) + (parent > 0))
        return out


def spelled(names: list[str], parents: list[int], node: int) -> str:
    out = []
    while node > 0:
        out.append(names[node])
        node = parents[node]
    return ">".join(reversed(out))


def text_inside(parents: list[int], blocks: list[tuple[int, bool, str]], node: int | None) -> str:
    """The text inside the containers of a path; all of the page's, if None."""
    if node is None:
        return "\n".join(text for _, _, text in blocks)
    inside = [False] * len(parents)
    for i in range(len(parents)):
        inside[i] = i == node or (i > 0 and inside[parents[i]])
    return "\n".join(text for at, aside, text in blocks if inside[at] and not aside)


def host_of(url: str):
    return F.regexp_extract(F.lower(F.coalesce(F.col(url), F.lit(""))), r"^\s*(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#\s]+)", 1)


def parsed(pages: DataFrame) -> DataFrame:
    """A row for each row of ``pages``: page_id, host, its paths' names and parents, its blocks, the votes it gives and the number of its own best path.

    A page's votes are its scores in thousandths of its best. Its best path is that of the highest score; of equal ones the shortest, then the least digest.
    """
    schema = T.StructType([
        T.StructField("page_id", pages.schema["page_id"].dataType), T.StructField("host", T.StringType()), T.StructField("best", T.IntegerType()),
        T.StructField("names", T.ArrayType(T.StringType())), T.StructField("parents", T.ArrayType(T.IntegerType())),
        T.StructField("at", T.ArrayType(T.IntegerType())), T.StructField("aside", T.ArrayType(T.BooleanType())), T.StructField("texts", T.ArrayType(T.StringType())),
        T.StructField("votes", T.ArrayType(T.StructType([T.StructField("key", T.BinaryType()), T.StructField("length", T.IntegerType()), T.StructField("node", T.IntegerType()), T.StructField("votes", T.LongType())]))),
    ])
    vote = pa.list_(pa.struct([("key", pa.binary()), ("length", pa.int32()), ("node", pa.int32()), ("votes", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a few pages at a time, so that a batch of long ones isn't held twice
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                columns: list[list] = [[] for _ in range(7)]
                for source in part.column(2):
                    page = Page(source.as_py() or "")
                    scores = page.scores()
                    keys, lengths = (page.keys(), page.lengths()) if scores else ([], [])
                    most = max(scores.values(), default=0.0)
                    best = min(scores, key=lambda n: (-scores[n], lengths[n], keys[n])) if scores else None
                    given = [{"key": keys[n], "length": lengths[n], "node": n, "votes": round(1000 * score / most)} for n, score in scores.items() if score > 0]
                    at, aside, texts = ([b[i] for b in page.blocks] for i in range(3))
                    for column, value in zip(columns, (best, page.names, page.parents, at, aside, texts, given)):
                        column.append(value)
                kinds = (pa.int32(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.list_(pa.string()), vote)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=schema.names)

    return pages.select("page_id", host_of("url").alias("host"), "html").mapInArrow(run, schema)


def winning_paths(trees: DataFrame) -> DataFrame:
    """host, key, votes: the path that each host's pages elect, of ``trees`` as from :func:`parsed`; of equal ones the shortest, then the least digest."""
    counted = trees.filter("host <> ''").select("host", F.inline("votes")).groupBy("host", "key").agg(F.sum("votes").alias("votes"), F.min("length").alias("length"))
    top = counted.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("v"), "length", "key")).alias("top"))
    return top.select("host", F.col("top.key").alias("key"), (-F.col("top.v")).alias("votes"))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, host, path, text: a row for each row of ``pages``.

    path is the container used: the host's winner or, on a page without it or without text in it, or without a host, the page's own best; null
    if no container has running text, and then text is all of the page's text. Null and empty pages have the text ''. Repeated
    rows vote each and are extracted alike; other columns are not read. Where the winners are
    too many to broadcast, the parsed pages, not the HTML, are moved to them, a host's pages spread over ``SALTS`` places.
    """
    trees = written(parsed(pages), "page-trees")
    winners = written(winning_paths(trees).select(F.col("host").alias("__host"), F.col("key").alias("winner"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("__salt")), "winning-paths")
    salted = trees.withColumn("own", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int"))
    joined = salted.join(winners, (F.col("host") == F.col("__host")) & (F.col("own") == F.col("__salt")), "left")
    # the winner's place on the page, where it gave it votes
    node = F.get(F.filter("votes", lambda v: v["key"] == F.col("winner")), 0)["node"]
    joined = joined.select("page_id", "host", node.alias("won"), "best", "names", "parents", "at", "aside", "texts", F.col("winner").isNotNull().alias("elected"), "winner")
    schema = T.StructType([T.StructField("page_id", pages.schema["page_id"].dataType), *(T.StructField(n, T.StringType()) for n in ("host", "path", "text"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                paths, texts = [], []
                for won, best, names, parents, at, aside, own, elected, winner in zip(*[part.column(i).to_pylist() for i in range(2, 11)]):
                    blocks = list(zip(at, aside, own))
                    if won is None and elected:
                        won = _node_of(names, parents, winner)
                    text = text_inside(parents, blocks, won) if won is not None else ""
                    node = won
                    if not text:
                        node, text = best, text_inside(parents, blocks, best)
                    paths.append(None if node is None else spelled(names, parents, node)), texts.append(text)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(paths, pa.string()), pa.array(texts, pa.string())], names=schema.names)

    return joined.mapInArrow(run, schema)


def _node_of(names: list[str], parents: list[int], key: bytes) -> int | None:
    """The path of that digest, which need not have had votes on this page."""
    digests = [b""]
    if key == b"":
        return 0
    for i in range(1, len(names)):
        digests.append(blake2b(digests[parents[i]] + names[i].encode("utf-8", "surrogatepass"), digest_size=16).digest())
        if digests[i] == key:
            return i
    return None
