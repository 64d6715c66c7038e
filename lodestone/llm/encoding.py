"""Encoding of a corpus with a public byte-level BPE vocabulary, by a pair occurrence index.

The words of a batch are reduced to the ones not seen before.  Their symbols lie one after the
other; an index maps every mergeable pair to all its positions.  The ranks that occur are then
applied once each, in ascending order; a merge touches only the listed positions and adds the
pairs it creates to the lists of their (always higher) ranks.  No word is scanned again.
"""

from __future__ import annotations

import heapq
import json
import re
from collections import defaultdict
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"

# The public pattern that splits a text before the merges, once for all texts and
# once, with the same meaning, for ASCII; white space is Unicode's White_Space.
_SPACE = r"\t-\r \x85\xA0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000"
SPLIT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
SPLIT_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")

#: entries of a worker's memory of encoded words; beyond it the memory is emptied
MEMORY_WORDS = 1_000_000


@dataclass(frozen=True)
class Merges:
    """Left, right and joined id of every merge, in rank order, and the id of each byte."""

    left: np.ndarray
    right: np.ndarray
    joined: np.ndarray
    of_byte: np.ndarray


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    hidden = [b for b in range(256) if b not in letters]
    return [letters.get(b) or chr(256 + hidden.index(b)) for b in range(256)]


@lru_cache(maxsize=4)
def load_merges(path: str = VOCABULARY) -> Merges:
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    ids = model["vocab"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    column = lambda values: np.fromiter((ids[v] for v in values), np.int32)
    return Merges(column(a for a, _ in pairs), column(b for _, b in pairs), column(a + b for a, b in pairs), column(_byte_letters()))


class PairIndex:
    """Encodes sets of words; remembers the words it has encoded."""

    def __init__(self, merges: Merges) -> None:
        left, right, joined = (x.tolist() for x in (merges.left, merges.right, merges.joined))
        self._rank = {(a << 20) | b: r for r, (a, b) in enumerate(zip(left, right, strict=True))}
        self._right, self._joined = right, joined
        self._same = {r for r, (a, b) in enumerate(zip(left, right, strict=True)) if a == b}
        self._left = left
        self._of_byte = merges.of_byte.tolist()
        self.known: dict[str, tuple[int, ...]] = {}

    def add(self, words: list[str]) -> None:
        """Encode ``words`` together into ``known``."""
        if not words:
            return
        rank, of_byte = self._rank, self._of_byte
        symbols: list[int] = []
        begins: list[int] = []
        for word in words:
            begins.append(len(symbols))
            symbols.extend([of_byte[b] for b in word.encode("utf-8")])
            symbols.append(-1)  # ends the word; pairs with nothing
        n = len(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        places: dict[int, list[int]] = defaultdict(list)
        for i in range(n - 1):
            a, b = symbols[i], symbols[i + 1]
            if a >= 0 and b >= 0 and (r := rank.get((a << 20) | b)) is not None:
                places[r].append(i)
        active = list(places)
        heapq.heapify(active)
        while active:
            r = heapq.heappop(active)
            a, b, new = self._left[r], self._right[r], self._joined[r]
            at = places.pop(r)
            for i in sorted(at) if r in self._same else at:
                j = after[i]
                if symbols[i] != a or j >= n or symbols[j] != b:
                    continue
                symbols[i], symbols[j] = new, -2
                k = after[j]
                after[i] = k
                before[k] = i
                h = before[i]
                if h >= 0 and (s := symbols[h]) >= 0 and (q := rank.get((s << 20) | new)) is not None:
                    if q not in places:
                        heapq.heappush(active, q)
                    places[q].append(h)
                if (s := symbols[k]) >= 0 and (q := rank.get((new << 20) | s)) is not None:
                    if q not in places:
                        heapq.heappush(active, q)
                    places[q].append(i)
        for word, begin, end in zip(words, begins, [*begins[1:], n], strict=True):
            self.known[word] = tuple([s for s in symbols[begin:end] if s >= 0])


#: of a worker process: vocabulary -> index with the words it has encoded
_WORKER: dict[str, PairIndex] = {}


def split_words(text: str) -> list[str]:
    return SPLIT_ASCII.findall(text) if text.isascii() else SPLIT.findall(text)


def encode_texts(texts: list[str | None], index: PairIndex) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids) of the texts; null and empty texts have no ids."""
    words = [split_words(t) if t else [] for t in texts]
    number: dict[str, int] = {}
    flat = [number.setdefault(w, len(number)) for ws in words for w in ws]
    if len(index.known) > MEMORY_WORDS:
        index.known.clear()
    index.add([w for w in number if w not in index.known])
    known = [index.known[w] for w in number]
    sizes = np.fromiter(map(len, known), np.int64, len(known))
    table = np.fromiter((i for ids in known for i in ids), np.int32, int(sizes.sum()))
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) if len(sizes) else np.zeros(0, np.int64)
    use = np.array(flat, dtype=np.int64)
    each = sizes[use]
    ends = np.cumsum(each)
    total = int(ends[-1]) if len(ends) else 0
    ids = table[np.repeat(starts[use] - (ends - each), each) + np.arange(total)]
    bounds = np.concatenate([[0], np.cumsum([len(w) for w in words])]).astype(np.int64)
    offsets = np.concatenate([[0], ends])[bounds]
    return offsets.astype(np.int32), ids


def encoded(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, keep: list[str] | None = None) -> DataFrame:
    """(key, ids) of every row by the vocabulary file, without special tokens, and the columns to ``keep``.

    The text is taken as stored and strings that look like markers are plain text; a null and an
    empty text give an empty list.  Repeated rows stay repeated, null keys stay.  The merges are
    broadcast: their number is that of the vocabulary, whatever the size of the corpus.
    """
    merges = documents.sparkSession.sparkContext.broadcast(load_merges(vocabulary))
    kept = [key, *(keep or [])]

    def batches(rows):
        index = _WORKER.get(vocabulary)
        if index is None:
            index = _WORKER[vocabulary] = PairIndex(merges.value)
        for batch in rows:
            offsets, ids = encode_texts(batch.column(len(kept)).to_pylist(), index)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(kept))), lists], names=[*kept, "ids"])

    schema = T.StructType([*(documents.schema[c] for c in kept), T.StructField("ids", T.ArrayType(T.IntegerType(), True), True)])
    return documents.select(*kept, F.col(text).alias("_text")).mapInArrow(batches, schema)


def token_counts(documents: DataFrame, by: str = "source", key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(by, documents, without_tokens, tokens): every row counts, repeated ones and those without key too; null is a group."""
    sizes = encoded(documents, key, text, vocabulary, [by]).select(by, F.size("ids").cast("bigint").alias("n"))
    return sizes.groupBy(by).agg(F.count("*").alias("documents"), F.count_if(F.col("n") == 0).alias("without_tokens"), F.sum("n").alias("tokens"))


def token_bytes(path: str = VOCABULARY) -> list[bytes]:
    """The bytes of every id of the vocabulary."""
    with open(path, encoding="utf-8") as file:
        ids = json.load(file)["model"]["vocab"]
    byte_of = {letter: b for b, letter in enumerate(_byte_letters())}
    out = [b""] * (max(ids.values()) + 1)
    for name, i in ids.items():
        out[i] = bytes(byte_of[c] for c in name) if all(c in byte_of for c in name) else name.encode("utf-8")
    return out


def decoded(ids: DataFrame, key: str = "doc_id", column: str = "ids", vocabulary: str = VOCABULARY) -> DataFrame:
    """(key, text) of lists of ids: the texts they stand for; a null list gives a null text."""
    table = ids.sparkSession.sparkContext.broadcast(token_bytes(vocabulary))

    def batches(rows):
        pieces = table.value
        for batch in rows:
            texts = [None if values is None else b"".join([pieces[i] for i in values]).decode("utf-8", "replace") for values in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    schema = T.StructType([ids.schema[key], T.StructField("text", T.StringType())])
    return ids.select(key, column).mapInArrow(batches, schema)
