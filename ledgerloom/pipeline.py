"""The document pipeline by profiles: named steps over named DataFrames.

A step takes the tables so far and returns new ones. ``0ml`` uses words alone, ``50ml`` adds ranking and hashed vectors, ``100ml`` uses a vector function
that the caller gives.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from .functions import grammar, text as tx, vectors
from .operators import classify, extract, layout, linking, ranking, search, tables

Tables = dict[str, DataFrame]


def _pages(t: Tables) -> Tables:
    docs = t["documents"]
    pages = docs.select("doc_id", F.posexplode("pages_text").alias("p", "text")).select("doc_id", (F.col("p") + 1).alias("page_index"), "text") if "pages_text" in docs.columns else docs.select("doc_id", F.lit(1).alias("page_index"), "text")
    return {"pages": pages.withColumn("lang", tx.language_of_layout(F.col("text")))}


def _classification(t: Tables) -> Tables:
    scored = classify.scores(t["pages"])
    return {"scores": classify.ranked(t["documents"], scored), "classification": classify.decisions(t["documents"], scored), "keyword_hits": classify.keyword_hits(t["pages"])}


def _chunks(t: Tables) -> Tables:
    cut = t["pages"].select("doc_id", "page_index", F.posexplode(layout.chunks(F.col("text"))).alias("sent_index", "text"))
    return {"chunks": cut.withColumn("is_noise", layout.is_noise(F.col("text"))), "lines": layout.lines(t["pages"])}


def _grammar(t: Tables) -> Tables:
    chunks = t["chunks"].select("doc_id", "page_index", "sent_index", "text").withColumn("lang", tx.language_of_grammar(F.col("text")))
    tokens = grammar.grammar_tokens(chunks, F.col("lang"))
    return {"tokens": tokens, "entities": grammar.entities(tokens, ["doc_id", "page_index", "sent_index"])}


def _tables(t: Tables) -> Tables:
    return {"line_items": tables.line_items(t["lines"]), "totals": tables.totals(t["lines"])}


def _extraction(t: Tables) -> Tables:
    found = extract.matches(t["pages"])
    return {"matches": found, "fields": extract.fields(t["documents"], found), "labels": extract.label_values(t["lines"])}


def _numbered(t: Tables) -> DataFrame:
    return t["chunks"].select("doc_id", (F.col("page_index") * 1_000_000 + F.col("sent_index")).alias("chunk"), "text")


def _topics(t: Tables) -> Tables:
    return {"topics": ranking.document_topics(_numbered(t)), "chunk_topics": ranking.chunk_topics(_numbered(t))}


def _ranking(t: Tables) -> Tables:
    wanted = t["matches"].select("doc_id", F.explode(tx.words(F.concat_ws(" ", "field", "value"))).alias("term")).groupBy("doc_id").agg(F.collect_set("term").alias("terms"))
    return {"bm25_chunks": ranking.bm25(_numbered(t), wanted), "bm25_docs": ranking.bm25_summary(_numbered(t), wanted)}


def _links(t: Tables) -> Tables:
    terms = linking.sentence_terms(_numbered(t))
    keywords = t["keyword_hits"].select("doc_id", F.lower("keyword").alias("term")) if "keyword_hits" in t else t["topics"].select("doc_id", "term").limit(0)
    signals = linking.signal_terms(linking.topics_or_common(t["topics"], terms), keywords)
    links = linking.numbered(linking.all_links(signals, terms))
    return {"links": links, "link_examples": linking.topic_examples(links, t["topics"], _numbered(t), terms)}


def _index(t: Tables) -> Tables:
    return {"search_docs": search.search_documents(t["pages"])}


STEPS: dict[str, Callable[[Tables], Tables]] = {"pages": _pages, "classification": _classification, "chunks": _chunks, "grammar": _grammar, "tables": _tables, "extraction": _extraction, "topics": _topics, "ranking": _ranking, "links": _links, "index": _index}
PROFILES = {"0ml": [s for s in STEPS if s != "ranking"], "50ml": [*STEPS, "vectors"], "100ml": [*STEPS, "vectors"]}


class Pipeline:
    """A profile's steps; ``embed`` maps (DataFrame, key, terms) to vectors, feature hashing by default."""

    def __init__(self, profile: str = "50ml", embed: Callable[[DataFrame, str, str], DataFrame] = vectors.hashed_vectors):
        if profile not in PROFILES:
            raise ValueError(f"there is no profile {profile}; there are {', '.join(PROFILES)}")
        self.steps, self.embed = PROFILES[profile], embed

    def _vectors(self, t: Tables) -> Tables:
        terms = t["documents"].select("doc_id", tx.words(F.col("text")).alias("terms")) if "text" in t["documents"].columns else t["pages"].groupBy("doc_id").agg(F.flatten(F.collect_list(tx.words(F.col("text")))).alias("terms"))
        return {"vectors": self.embed(terms, "doc_id", "terms")}

    def selected(self, only: list[str] | None = None, upto: str | None = None, start: str | None = None) -> list[str]:
        for name in [*(only or []), *filter(None, [upto, start])]:
            if name not in self.steps:
                raise ValueError(f"there is no step {name}")
        steps = self.steps[self.steps.index(start) if start else 0 : self.steps.index(upto) + 1 if upto else None]
        return [s for s in steps if only is None or s in only]

    def run(self, documents: DataFrame, only: list[str] | None = None, upto: str | None = None, start: str | None = None, tables: Tables | None = None, progress: Callable[[str, int, int], None] | None = None) -> Tables:
        """All tables by name. ``tables`` holds what skipped steps would have made; ``progress`` hears of each step (name, its number, how many)."""
        out = {"documents": documents, **(tables or {})}
        steps = self.selected(only, upto, start)
        for i, name in enumerate(steps, 1):
            if progress:
                progress(name, i, len(steps))
            out |= (self._vectors if name == "vectors" else STEPS[name])(out)
        return out
