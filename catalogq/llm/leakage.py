"""Evaluation passages inside training text, found by pigeonhole pieces and verified bit-parallel.

A passage of WINDOW words with at most ``errors`` edits, cut into errors + 1 disjoint pieces, keeps one piece intact.
Each item is cut at multiples of a fixed piece length, short enough that every window of the item holds errors + 1
whole pieces. Exact hits of pieces are found with an Aho-Corasick automaton over the words of a document, and
around each hit the windows of the item are compared with Myers' bit-parallel edit distance over words.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import accumulate, chain

import ahocorasick
import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogq.session import cut

WORD = regex.compile(r"[\p{L}\p{Nd}\p{M}‌]+")
#: Words of a passage that counts as leaked.
WINDOW = 13
#: Characters of items that a task looks for at once. It bounds memory and does not bear on the result.
PASS_CHARS = 8 << 20
#: Bits of the filter that keeps the documents worth more than one look, 16 MB at any number of items.
FILTER_BITS = 1 << 27


def words(text: str) -> list[str]:
    return WORD.findall(text.lower())


def piece_length(window: int, errors: int) -> int:
    """The longest piece of which every window holds errors + 1 whole aligned ones."""
    return (window + 1) // (errors + 2)


def myers(pattern_bits: dict, size: int, text: list, errors: int) -> list[tuple[int, int]]:
    """(end, distance) of all places of ``text`` where the pattern of ``size`` symbols ends with at most ``errors`` edits.

    ``pattern_bits`` has, per symbol, the bits of its places in the pattern. Any symbols, any size.
    """
    mask, high = (1 << size) - 1, 1 << (size - 1)
    up, down, score, found = mask, 0, size, []
    for j, symbol in enumerate(text):
        eq = pattern_bits.get(symbol, 0)
        diagonal = (((eq & up) + up) ^ up) | eq | down
        plus, minus = down | (~(diagonal | up) & mask), up & diagonal
        if plus & high:
            score += 1
        elif minus & high:
            score -= 1
        plus, minus = (plus << 1) & mask, (minus << 1) & mask
        up, down = minus | (~(diagonal | plus) & mask), plus & diagonal
        if score <= errors:
            found.append((j + 1, score))
    return found


def piece_bits(ws: list[str], size: int, step: int) -> np.ndarray:
    """Filter bits of the pieces of ``size`` words that begin at every ``step``-th word."""
    if len(ws) < size:
        return np.zeros(0, np.int64)
    known: dict[str, int] = {}
    h = np.fromiter((known[w] if w in known else known.setdefault(w, xxhash.xxh64_intdigest(w)) for w in ws), np.uint64, len(ws))
    starts = len(ws) - size + 1
    mixed = np.zeros(starts, np.uint64)
    for k in range(size):
        mixed = (mixed ^ h[k : k + starts]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return (mixed[::step] % np.uint64(FILTER_BITS)).astype(np.int64)


class Finder:
    """Looks for passages of a set of texts in documents; each text is given with its item, which may have several."""

    def __init__(self, items: list[tuple[int, str]], window: int, errors: int):
        self.window, self.errors, self.size = window, errors, piece_length(window, errors)
        if self.size < 1:
            raise ValueError("too many errors for the window")
        self.ids = [i for i, _ in items]
        self.items = [words(t) for _, t in items]
        places = defaultdict(list)
        for i, ws in enumerate(self.items):
            if len(ws) < window:
                continue
            for at in range(0, len(ws) - self.size + 1, self.size):
                places[" ".join(ws[at : at + self.size])].append((i, at))
        self.bits: dict = {}
        self.automaton = ahocorasick.Automaton()
        for piece, where in places.items():
            self.automaton.add_word(f" {piece} ", (self.size, where))
        self.any = bool(places)
        if self.any:
            self.automaton.make_automaton()

    def _pattern(self, item: int, start: int) -> dict:
        key = (item, start)
        if key not in self.bits:
            bits: dict = {}
            for k, w in enumerate(self.items[item][start : start + self.window]):
                bits[w] = bits.get(w, 0) | 1 << k
            self.bits[key] = bits
        return self.bits[key]

    def find(self, text: str) -> dict[int, int]:
        """The fewest edits of any leaked passage per item."""
        if not self.any or not text:
            return {}
        ws = words(text)
        if len(ws) < self.window - self.errors:
            return {}
        joined = f" {' '.join(ws)} "
        best: dict[int, int] = {}
        tried = set()
        seen_at, word_at = 0, -1  # words begun up to a character, counted once along the text
        for end, (size, where) in self.automaton.iter(joined):
            word_at += joined.count(" ", seen_at, end)
            seen_at = end
            q = word_at + 1 - size  # first word of the hit
            for item, p in where:
                if best.get(item) == 0:
                    continue
                xs, w, k = self.items[item], self.window, self.errors
                first, last = max(0, p + self.size - w), min(p, len(xs) - w)
                if k:  # a word of the window that the neighbourhood lacks costs an edit
                    near = set(ws[max(0, q - w - k) : q + w + k])
                    lacks = list(accumulate((x not in near for x in xs[first : last + w]), initial=0))
                for start in range(first, last + 1):
                    lead = p - start
                    key = (item, start, q - lead)
                    if key in tried or k and lacks[start - first + w] - lacks[start - first] > min(k, best.get(item, k + 1) - 1):
                        continue
                    tried.add(key)
                    a, b = max(0, q - lead - k), min(len(ws), q - lead + w + k)
                    for _, distance in myers(self._pattern(item, start), w, ws[a:b], k):
                        if distance < best.get(item, k + 1):
                            best[item] = distance
        least: dict[int, int] = {}
        for i, edits in best.items():
            least[self.ids[i]] = min(edits, least.get(self.ids[i], edits))
        return least


def leaks(documents: DataFrame, items: DataFrame, window: int = WINDOW, errors: int = 0, pass_chars: int = PASS_CHARS) -> DataFrame:
    """``doc_id``, ``item_id``, ``edits``: documents that hold ``window`` words in a row of an item, but for ``errors`` edits of words.

    The items are the stated query set; it is read through the driver in blocks of at most ``pass_chars`` characters, so what
    a task or the driver holds is bounded however many items there are. The documents are read once: with several blocks, a
    filter of fixed size over the pieces of all items is applied first, and the blocks go over the documents that pass it.
    Documents are never shuffled, only the pairs found are. Whole texts are searched. Items of fewer words than the window
    can not leak; null and empty texts hold nothing; there is one row per pair, with its fewest edits, however often an
    item or a document is repeated and whatever the blocks.
    """
    spark = documents.sparkSession
    docs = documents.select("doc_id", "text").where(F.col("text").isNotNull())
    texts = items.select("item_id", "text").where("text IS NOT NULL")

    def blocks() -> Iterator[list[tuple[int, str]]]:
        block: list[tuple[int, str]] = []
        size = 0
        for r in texts.toLocalIterator():
            block.append((r.item_id, r.text))
            size += len(r.text)
            if size >= pass_chars:
                yield block
                block, size = [], 0
        yield block

    def one_pass(docs: DataFrame, block: list[tuple[int, str]]) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            finder = Finder(shared.value, window, errors)
            for pdf in batches:
                rows = [(d, i, e) for d, t in zip(pdf["doc_id"], pdf["text"]) for i, e in finder.find(t).items()]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "edits"])

        return docs.mapInPandas(search, "doc_id bigint, item_id bigint, edits int")

    def likely(filtered: np.ndarray) -> DataFrame:
        shared = spark.sparkContext.broadcast(filtered)
        size = piece_length(window, errors)

        def keep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            bits = shared.value
            for pdf in batches:
                at = [piece_bits(words(t), size, 1) for t in pdf["text"]]
                yield pdf[[bool((bits[a >> 3] >> (7 - (a & 7)) & 1).any()) for a in at]]

        return docs.mapInPandas(keep, docs.schema)

    found = blocks()
    first = next(found)
    second = next(found, None)
    if second is None:
        pairs = one_pass(docs, first)
    else:
        filtered = np.zeros(FILTER_BITS >> 3, np.uint8)
        for block in blocks():
            for _, t in block:
                ws = words(t)
                if len(ws) >= window:
                    at = piece_bits(ws, piece_length(window, errors), piece_length(window, errors))
                    np.bitwise_or.at(filtered, at >> 3, np.uint8(128) >> (at & 7).astype(np.uint8))
        few = cut(likely(filtered))
        pairs = reduce(DataFrame.unionByName, [cut(one_pass(few, block)) for block in chain([first, second], found)])
    return pairs.groupBy("doc_id", "item_id").agg(F.min("edits").alias("edits"))
