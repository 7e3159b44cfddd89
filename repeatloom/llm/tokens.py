"""Encoding of a whole corpus with a public tokenizer, as a tree of halves whose neighbours are joined."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files are; a parameter of every operator here.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Letters of a leaf, and letters on each side of a boundary that a join first looks at.
LEAF, REACH = 2048, 16
#: A piece of the splitting pattern is decided by the letters up to this many after its end.
LOOKAHEAD = 3


@lru_cache(4)
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has a task for every core
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True  # their strings in a text are ordinary text
    return t


#: Fixed value: how byte-level vocabularies split a text into the pieces that are encoded by themselves.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _byte_letters() -> dict[str, int]:
    """Vocabulary files spell each byte as one letter: printable ones as themselves, the others in turn from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


class Encoder:
    """A byte-level vocabulary file: the bytes of every id, ids of texts, and where their pieces begin."""

    def __init__(self, path: str):
        import regex
        import tiktoken

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters = _byte_letters()
        ranks = {bytes(letters[c] for c in token): i for token, i in file["model"]["vocab"].items() if not any(i == a["id"] for a in file["added_tokens"])}
        self.bytes = [b""] * (max([*ranks.values(), *(a["id"] for a in file["added_tokens"])]) + 1)
        for token, i in ranks.items():
            self.bytes[i] = token
        for a in file["added_tokens"]:
            self.bytes[a["id"]] = a["content"].encode()
        self.lengths = np.array([len(b) for b in self.bytes], np.int64)
        self.pattern = regex.compile(PATTERN)
        self.encoding = tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), np.int32)

    def node(self, start: int, text: str) -> Node:
        """The text as a node that begins at start."""
        ids = self.ids(text)
        places = np.array([m.start() for m in self.pattern.finditer(text)], np.int64)
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        size = 1 + (codes > 0x7F).astype(np.int64) + (codes > 0x7FF) + (codes > 0xFFFF)
        at = np.cumsum(size) - size  # bytes before each letter
        begin = np.cumsum(self.lengths[ids]) - self.lengths[ids]
        return Node(start, start + len(text), ids, start + places, np.searchsorted(begin, at[places]))

    def text(self, ids: np.ndarray, leaf: int = 256) -> bytes:
        """Bytes of ids, up the tree: those of a leaf put together, those of a node its halves' one after the other."""
        if len(ids) <= leaf:
            return b"".join([self.bytes[i] for i in ids.tolist() if 0 <= i < len(self.bytes)])
        half = len(ids) // 2
        return self.text(ids[:half], leaf) + self.text(ids[half:], leaf)


@lru_cache(4)
def encoder(path: str) -> Encoder:
    return Encoder(path)


class Node(NamedTuple):
    """A stretch of text: its ids as a text of its own, where its pieces start (places in the whole
    text), and which id each piece starts with."""

    start: int
    end: int
    ids: np.ndarray
    pieces: np.ndarray
    firsts: np.ndarray


def join(tokens: Encoder, text: str, left: Node, right: Node, reach: int = REACH) -> Node:
    """The node of two neighbours, equal to encoding their text at once.

    The splitting pattern reads from left to right and forgets what lies behind it. So pieces of
    the left side that end LOOKAHEAD letters before the boundary stay, and from any place where
    both the text from the first doubtful piece on and the right side alone start a piece, the
    right side's pieces stay. Only the window between is encoded again; it grows until there is such a place.
    """
    if left.start == left.end:
        return right
    if right.start == right.end:
        return left
    ends = np.append(left.pieces[1:], left.end)
    keep = int(np.searchsorted(ends, left.end - LOOKAHEAD, side="right"))
    start = int(left.pieces[keep])
    while True:
        end = min(right.end, right.start + reach)
        window = tokens.node(start, text[start:end])
        if end == right.end:
            at, to = len(window.pieces), len(right.pieces)
            break
        close = np.append(window.pieces[1:], end)
        settled = int(np.searchsorted(close, end - LOOKAHEAD, side="right"))  # pieces before this one are decided
        places = window.pieces[: settled + 1]
        common = np.intersect1d(places[places >= right.start], right.pieces)
        if len(common):
            at, to = int(np.searchsorted(window.pieces, common[0])), int(np.searchsorted(right.pieces, common[0]))
            break
        reach *= 2
    id_l = int(left.firsts[keep])
    id_w = int(window.firsts[at]) if at < len(window.firsts) else len(window.ids)
    id_r = int(right.firsts[to]) if to < len(right.firsts) else len(right.ids)
    return Node(
        left.start,
        right.end,
        np.concatenate([left.ids[:id_l], window.ids[:id_w], right.ids[id_r:]]),
        np.concatenate([left.pieces[:keep], window.pieces[:at], right.pieces[to:]]),
        np.concatenate([left.firsts[:keep], window.firsts[:at] + id_l, right.firsts[to:] + (id_l + id_w - id_r)]),
    )


def _leaves(start: int, end: int, leaf: int) -> list[tuple[int, int]]:
    if end - start <= leaf:
        return [(start, end)]
    half = (start + end) // 2
    return _leaves(start, half, leaf) + _leaves(half, end, leaf)


def _tree(tokens: Encoder, text: str, start: int, end: int, leaf: int) -> Node:
    if end - start <= leaf:
        return tokens.node(start, text[start:end])
    half = (start + end) // 2
    return join(tokens, text, _tree(tokens, text, start, half, leaf), _tree(tokens, text, half, end, leaf))


def encode_texts(texts: list[str | None], path: str = VOCABULARY, leaf: int = LEAF) -> list[np.ndarray]:
    """Ids of each text; null and empty texts have none. A text that is one leaf needs no places of its pieces."""
    t = encoder(path)
    return [np.zeros(0, np.int32) if not x else t.ids(x) if len(x) <= leaf else _tree(t, x, 0, len(x), leaf).ids for x in texts]


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, ids)]), pa.int32()), pa.array(np.concatenate(ids) if ids else [], pa.int32()))


def encode(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and text as doc_id and ids (array of int), without special tokens; null and empty texts
    have an empty array. No shuffle: every row is encoded where it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                part = b.slice(k, 2000)
                yield pa.RecordBatch.from_arrays([part["doc_id"], _lists(encode_texts(part["text"].to_pylist(), path))], names=["doc_id", "ids"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def count(documents: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and n_tokens of each text; zero for null and empty texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 2000):
                part = b.slice(k, 2000)
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.array([len(x) for x in encode_texts(part["text"].to_pylist(), path)], pa.int64())], names=["doc_id", "n_tokens"])

    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_tokens long")


def decode(encoded: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id and ids as doc_id and text; null ids give null, no ids the empty text. Tokens are bytes, so the
    bytes of a node are its halves' one after the other, and become a text at the root; ids that end within a letter give replacement
    letters there, and ids that the vocabulary has not give nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = encoder(path)
        for b in batches:
            ids = [None if x is None else np.array([i for i in x if i is not None], np.int64) for x in b["ids"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array([None if x is None else t.text(x).decode("utf-8", "replace") for x in ids], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")
