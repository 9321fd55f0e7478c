"""Token counts by rank-synchronous array merging.

Texts are cut into pre-tokens by the tokenizer's pattern. Pre-tokens not met before are
held together as one ragged numpy array of symbols; in each step every sequence merges
its own lowest-rank pair, all sequences at once, until no pair of any sequence is in the
vocabulary. The surviving symbols are the tokens.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from . import textarrays as ta

RANKS_PATH = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_NEVER = np.int32(0x7FFFFFFF)
#: Remembered pieces of a worker; beyond that the memory starts anew. It changes no result.
MEMORY = 600_000
_UNSAFE = -(1 << 50)


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(bytes.strip, lines))}


class PairTable:
    """Rank of the merged token for every pair of tokens whose bytes together are a token; an open-addressing table in numpy."""

    def __init__(self, ranks: dict[bytes, int]):
        self.bytes = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        left, right, rank = [], [], []
        for token, r in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), rank.append(r)
        keys = (np.array(left, np.uint64) << np.uint64(32)) | np.array(right, np.uint64)
        self.size = 1 << (4 * len(keys) + 1).bit_length()
        self.keys = np.full(self.size, np.uint64(0xFFFFFFFFFFFFFFFF))
        self.ranks = np.full(self.size, _NEVER, np.int32)
        slot, todo, values = self._slot(keys), np.arange(len(keys)), np.array(rank, np.int32)
        while len(todo):
            free = self.keys[slot[todo]] == np.uint64(0xFFFFFFFFFFFFFFFF)
            _, first = np.unique(slot[todo], return_index=True)
            put = np.zeros(len(todo), bool)
            put[first] = True
            put &= free
            at = todo[put]
            self.keys[slot[at]], self.ranks[slot[at]] = keys[at], values[at]
            todo = todo[~put]
            slot[todo] = (slot[todo] + 1) & (self.size - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (ta.mix(keys) & np.uint64(self.size - 1)).astype(np.int64)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = (left.astype(np.uint64) << np.uint64(32)) | right.astype(np.uint64)
        slot = self._slot(keys)
        seen = self.keys[slot]
        out = np.where(seen == keys, self.ranks[slot], _NEVER)
        todo = np.flatnonzero((seen != keys) & (seen != np.uint64(0xFFFFFFFFFFFFFFFF)))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & (self.size - 1)
            seen = self.keys[slot[todo]]
            hit = seen == keys[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (seen != np.uint64(0xFFFFFFFFFFFFFFFF))]
        return out


def count_symbols(pieces: list[bytes], table: PairTable) -> np.ndarray:
    """The number of tokens of each piece; 0 for an empty one."""
    out = np.array([len(p) for p in pieces], np.int64)
    which = np.flatnonzero(out > 1)
    lengths = out[which]
    symbols = table.bytes[np.frombuffer(b"".join(pieces[i] for i in which), np.uint8)]
    ranks = np.full(len(symbols), _NEVER, np.int32)
    last = np.cumsum(lengths) - 1
    inner = np.ones(len(symbols), bool)
    inner[last] = False
    at = np.flatnonzero(inner)
    ranks[at] = table.of(symbols[at], symbols[at + 1])
    while len(which):
        starts = np.cumsum(lengths) - lengths
        least = np.minimum.reduceat(ranks, starts)
        going = least != _NEVER
        if not going.all():
            out[which[~going]] = lengths[~going]
            keep = np.repeat(going, lengths)
            symbols, ranks, which, lengths, least = symbols[keep], ranks[keep], which[going], lengths[going], least[going]
            if not len(which):
                break
        own = np.repeat(least, lengths)
        hit = np.flatnonzero(ranks == own)
        fresh = np.append(True, np.diff(hit) > 1)
        run = np.maximum.accumulate(np.where(fresh, hit, 0))
        hit = hit[(hit - run) % 2 == 0]  # of overlapping pairs in a run every other one, from the left
        symbols[hit] = own[hit]
        alive = np.ones(len(symbols), bool)
        alive[hit + 1] = False
        row = np.repeat(np.arange(len(which)), lengths)
        lengths = lengths - np.bincount(row[hit], minlength=len(which))
        moved = hit - np.arange(len(hit))
        symbols, ranks = symbols[alive], ranks[alive]
        last = np.zeros(len(symbols), bool)
        last[np.cumsum(lengths) - 1] = True
        stale = np.zeros(len(symbols), bool)
        stale[moved] = True
        stale[moved[moved > 0] - 1] = True
        change = np.flatnonzero(stale)
        ranks[change] = _NEVER
        change = change[~last[change]]
        ranks[change] = table.of(symbols[change], symbols[change + 1])
    return out


class Counter:
    """Counts texts' tokens, with a memory of the pieces met so far.

    A single space between two non-space characters always begins a pre-token, so texts are
    first cut there; a text in which another white space adjoins a space is cut by the pattern at once.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.table, self.pattern = PairTable(ranks), regex.compile(PATTERN)
        self.tails: dict[str, int] = {}

    def _sizes(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        kinds = list(set(words))
        sizes = dict(zip(kinds, count_symbols([w.encode() for w in kinds], self.table).tolist()))
        return np.fromiter(map(sizes.__getitem__, words), np.int64, len(words))

    def _learn(self, pieces: set[str]) -> None:
        """Remember the tokens of each piece with a space before it, for all at once."""
        new = [p for p in pieces if p not in self.tails]
        if len(self.tails) + len(new) > MEMORY:
            self.tails.clear()
            new = list(pieces)
        safe = [p for p in new if p and not p[0].isspace() and not p[-1].isspace()]
        if len(safe) < len(new):
            self.tails.update(dict.fromkeys(new, _UNSAFE))
        if safe:
            words = self.pattern.findall(" " + " ".join(safe))
            begins = np.flatnonzero(np.fromiter((w[0] == " " for w in words), bool, len(words)))
            self.tails.update(zip(safe, np.add.reduceat(self._sizes(words), begins).tolist()))

    def count(self, texts: list[str]) -> list[int]:
        parts = [t.split(" ") for t in texts]
        pieces: set[str] = set()
        for p in parts:
            pieces.update(p[1:])
        if not pieces <= self.tails.keys():
            self._learn(pieces)
        known = self.tails.__getitem__
        out = [sum(map(known, p[1:])) if p[0] and not p[0][-1].isspace() else _UNSAFE for p in parts]
        rest = [p[0] if n >= 0 else t for n, p, t in zip(out, parts, texts)]
        cut = [self.pattern.findall(t) for t in rest]
        sizes = self._sizes([w for c in cut for w in c])
        ends = np.concatenate([[0], np.cumsum([len(c) for c in cut])])
        total = np.concatenate([[0], np.cumsum(sizes)])
        return [max(n, 0) + int(total[b] - total[a]) for n, a, b in zip(out, ends[:-1], ends[1:])]


_worker: dict[str, Counter] = {}


def token_counts(docs: DataFrame, ranks_path: str = RANKS_PATH) -> DataFrame:
    """doc_id, n_chars, n_bytes, n_tokens: a row for each row of ``docs``.

    ``ranks_path`` is a file of base64 tokens and ranks, read on the driver and sent to the
    executors (a vocabulary doesn't grow with the data). Special tokens' names are ordinary text.
    Null and empty texts have 0 of each; null ids and repeated rows are counted like any other; other
    columns are not read, so a column n_tokens of ``docs`` does no harm.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(n, T.LongType()) for n in ("n_chars", "n_bytes", "n_tokens"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            if counter is None:
                if ranks_path not in _worker:
                    _worker[ranks_path] = Counter(shared.value)
                counter = _worker[ranks_path]
            for lo, hi in ta.groups(batch.column(1)):
                column = pa.compute.fill_null(batch.column(1).slice(lo, hi - lo), "")
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), pa.compute.utf8_length(column).cast(pa.int64()), pa.compute.binary_length(column).cast(pa.int64()), pa.array(counter.count(column.to_pylist()), pa.int64()),
                ], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
