"""Token ids in a binary form: Simple-8b words.

A 64-bit word holds a 4-bit selector and 60 bits of payload, which the selector divides
into equal fields: as many ids as fit. Ids of 60 bits and more are escapes: the selector
``ESCAPE`` stands for the next value of a list beside the words. Each ``BLOCK`` ids begin a new word, and
the first word of every block is kept, so that blocks can be read alone and all of them
decoded at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame, types as T

from . import textarrays as ta
from .tokencount import MEMORY, PATTERN, RANKS_PATH, read_ranks

BLOCK = 128
LAYOUT = [(60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20), (2, 30), (1, 60)]
ESCAPE = 15
_COUNT = np.array([c for c, _ in LAYOUT] + [0, 1])
_WIDTH16 = np.array([i.bit_length() for i in range(1 << 16)], np.uint8)


def bit_widths(values: np.ndarray) -> np.ndarray:
    if len(values) and values.max() < 1 << 16:
        return _WIDTH16[values.astype(np.uint16)]
    width, rest = np.zeros(len(values), np.uint8), values
    for step in (32, 16, 8, 4, 2, 1):
        big = rest >= np.uint64(1 << step)
        width += big.astype(np.uint8) * np.uint8(step)
        rest = np.where(big, rest >> np.uint64(step), rest)
    return width + (rest > 0)


def encode(ids: np.ndarray, lengths: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pack the unsigned ids of rows laid end to end.

    Returns words; the number of words of each row; the first word of every block, counted
    within its row; the escaped ids; and the number of escapes of each row.
    """
    ids = ids.astype(np.uint64)
    blocks = -(-lengths // block)
    total = int(blocks.sum())
    if not total:
        none = np.zeros(len(lengths), np.int64)
        return np.zeros(0, np.uint64), none, np.zeros(0, np.uint32), np.zeros(0, np.uint64), none
    owner = np.repeat(np.arange(len(lengths)), blocks)
    nth = np.arange(total) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    size = np.minimum(lengths[owner] - nth * block, block)
    stride = block + 60
    grid = np.zeros((total, stride), np.uint64)
    grid[np.arange(stride)[None, :] < size[:, None]] = ids
    flat = grid.ravel()
    width = bit_widths(flat)
    best, widest, have = (width <= 60).astype(np.uint8), width, 1
    for count, bits in sorted(LAYOUT)[1:]:
        grown = widest.copy()
        step = count - have
        while step:
            move = min(step, have)
            grown[:-move] = np.maximum(grown[:-move], grown[move:])
            have, step = have + move, step - move
        widest = grown
        best[widest <= bits] = count
    place, live, made = np.zeros(total, np.int64), np.arange(total), []
    while len(live):
        at = live * stride + place[live]
        take = best[at]
        made.append((live, at, take))
        place[live] += np.maximum(take, 1)
        live = live[place[live] < size[live]]
    per_block = np.zeros(total, np.int64)
    for live, _, _ in made:
        per_block[live] += 1
    begin = np.cumsum(per_block) - per_block
    words = np.zeros(int(per_block.sum()), np.uint64)
    at, take = np.zeros(len(words), np.int64), np.zeros(len(words), np.uint8)
    for step, (live, a, t) in enumerate(made):
        at[begin[live] + step], take[begin[live] + step] = a, t
    for selector, (count, bits) in enumerate(LAYOUT):
        own = np.flatnonzero(take == count)
        if len(own):
            word = np.full(len(own), selector, np.uint64)
            for j in range(count):
                inside = flat[np.minimum(at[own] + j, len(flat) - 1)]
                word |= inside << np.uint64(4 + j * bits)
            words[own] = word
    own = np.flatnonzero(take == 0)
    words[own] = ESCAPE
    row_words = np.bincount(owner, weights=per_block, minlength=len(lengths)).astype(np.int64)
    row_begin = np.cumsum(row_words) - row_words
    word_row = np.repeat(owner, per_block)
    return words, row_words, (begin - row_begin[owner]).astype(np.uint32), flat[at[own]], np.bincount(word_row[own], minlength=len(lengths))


def decode(n: int, words: bytes, block_words: bytes, escapes: bytes = b"", block: int = BLOCK) -> np.ndarray:
    """The ``n`` ids of a row, all blocks at once."""
    w, first, raw = np.frombuffer(words, "<u8"), np.frombuffer(block_words, "<u4").astype(np.int64), np.frombuffer(escapes, "<u8")
    if not n:
        return np.zeros(0, np.uint64)
    selector = (w & np.uint64(15)).astype(np.int64)
    counts = _COUNT[selector]
    start = np.cumsum(counts) - counts
    in_block = np.searchsorted(first, np.arange(len(w)), "right") - 1
    to = in_block * block + start - start[first][in_block]
    end = np.minimum((in_block + 1) * block, n)
    out = np.zeros(n, np.uint64)
    for s, (count, bits) in enumerate(LAYOUT):
        own = np.flatnonzero(selector == s)
        for j in range(count):
            at = to[own] + j
            inside = at < end[own]
            out[at[inside]] = (w[own[inside]] >> np.uint64(4 + j * bits)) & np.uint64((1 << bits) - 1)
    out[to[selector == ESCAPE]] = raw
    return out


class Tokenizer:
    """Token ids of texts, with a memory of the pieces between single spaces met so far."""

    def __init__(self, ranks: dict[bytes, int]):
        self.encoding = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.tails: dict[str, bytes | None] = {}
        self.begins = np.zeros(max(ranks.values()) + 1, bool)
        self.begins[[r for token, r in ranks.items() if token[:1] == b" "]] = True

    def _ids(self, text: str) -> np.ndarray:
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype(np.uint32, copy=False)

    def _learn(self, pieces: set[str]) -> None:
        """Remember the ids of each piece with a space before it, for all at once."""
        new = [p for p in pieces if p not in self.tails]
        if len(self.tails) + len(new) > MEMORY:
            self.tails.clear()
            new = list(pieces)
        safe = [p for p in new if p and not p[0].isspace() and not p[-1].isspace()]
        if len(safe) < len(new):
            self.tails.update(dict.fromkeys(new))
        if safe:
            ids = self._ids(" " + " ".join(safe))
            cuts = np.append(np.flatnonzero(self.begins[ids]), len(ids)) * 4
            data, cuts = ids.tobytes(), cuts.tolist()
            self.tails.update(zip(safe, [data[a:b] for a, b in zip(cuts[:-1], cuts[1:])]))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids laid end to end, number of ids of each text)."""
        parts = [t.split(" ") for t in texts]
        pieces: set[str] = set()
        for p in parts:
            pieces.update(p[1:])
        if not pieces <= self.tails.keys():
            self._learn(pieces)
        known, out = self.tails.__getitem__, []
        for text, p in zip(texts, parts):
            try:
                if not p[0] or p[0][-1].isspace():
                    raise TypeError
                out.append(self._ids(p[0]).tobytes() + b"".join(map(known, p[1:])))
            except TypeError:  # a piece that can't be cut out: the text as a whole
                out.append(self._ids(text).tobytes())
        return np.frombuffer(b"".join(out), np.uint32), np.array([len(x) // 4 for x in out], np.int64)


_worker: dict[str, Tokenizer] = {}


def _binary(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(counts)]) * values.itemsize
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(values.tobytes())])


def token_binary(docs: DataFrame, ranks_path: str = RANKS_PATH) -> DataFrame:
    """doc_id, n_tokens, n_blocks, words, block_words, escapes: a row for each row of ``docs``.

    words: little-endian 64-bit words; block_words: the first word of each block, little-endian
    32-bit; escapes: little-endian 64-bit ids. :func:`decode` reads them. Null and empty texts have no
    tokens and empty columns; null ids and repeated rows are encoded like any other; other
    columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("n_tokens", T.LongType()), T.StructField("n_blocks", T.LongType()), *(T.StructField(n, T.BinaryType()) for n in ("words", "block_words", "escapes"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = None
        for batch in batches:
            if tokenizer is None:
                if ranks_path not in _worker:
                    _worker[ranks_path] = Tokenizer(shared.value)
                tokenizer = _worker[ranks_path]
            for lo, hi in ta.groups(batch.column(1)):
                ids, lengths = tokenizer.encode(pa.compute.fill_null(batch.column(1).slice(lo, hi - lo), "").to_pylist())
                words, n_words, starts, raw, n_raw = encode(ids, lengths)
                blocks = -(-lengths // BLOCK)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(lengths), pa.array(blocks), _binary(words, n_words), _binary(starts, blocks), _binary(raw, n_raw)], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(run, schema)
