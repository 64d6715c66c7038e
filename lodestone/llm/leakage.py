"""Evaluation texts inside a training corpus, by a generalised suffix automaton of the test items.

The automaton is built over the words of the normalized items, in blocks of bounded size that are
packed into arrays and broadcast one by one.  A corpus of any length streams through all blocks in
one scan; a worker holds one block at a time.  At each word an automaton knows the longest suffix
read so far that occurs in an item, and which items hold it.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.text_form import canonical

WINDOW = 13
#: words of test items in one automaton: about 6 MB packed, 80 MB while it is built
BLOCK_WORDS = 100_000

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str | None, form: bool = True) -> list[str]:
    """Longest runs of letters and digits of the consistent form, or of the text as it is, lower-cased."""
    return _WORD.findall((canonical(text) if form else text).lower()) if text else []


def _packed(lists: dict[int, list[int]], n: int) -> tuple[array, array]:
    """(offsets, values) of the lists of ``n`` states."""
    offsets, values = array("i", [0]), array("i")
    for state in range(n):
        values.extend(lists.get(state, ()))
        offsets.append(len(values))
    return offsets, values


class _Growing:
    """Transitions, suffix links and lengths of an automaton while it is built."""

    def __init__(self) -> None:
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def extend(self, last: int, code: int) -> int:
        """Add one word after the state ``last``; the new state of the whole prefix."""
        step, link, length = self.step, self.link, self.length
        if code in step[last]:
            return self._exact(last, code)
        new = self._state(length[last] + 1)
        state = last
        while state != -1 and code not in step[state]:
            step[state][code] = new
            state = link[state]
        link[new] = 0 if state == -1 else self._exact(state, code)
        return new

    def _exact(self, state: int, code: int) -> int:
        """The state reached from ``state`` whose longest word is exactly one longer; split off if needed."""
        step, link, length = self.step, self.link, self.length
        target = step[state][code]
        if length[target] == length[state] + 1:
            return target
        copy = self._state(length[state] + 1)
        step[copy], link[copy] = dict(step[target]), link[target]
        link[target] = copy
        while state != -1 and step[state].get(code) == target:
            step[state][code] = copy
            state = link[state]
        return copy

    def _state(self, length: int) -> int:
        self.step.append({})
        self.link.append(-1)
        self.length.append(length)
        return len(self.step) - 1


class ItemAutomaton:
    """Generalised suffix automaton over item words, with the items that hold each state, in packed arrays.

    ``items`` are (key, words, size): the words of an item, or of a part of a long one, and the
    number of words of the whole item.
    """

    def __init__(self, items: list[tuple[int, list[str], int]], window: int = WINDOW) -> None:
        self.window = window
        self.vocabulary: dict[str, int] = {}
        self.keys = [key for key, words, _ in items if words]
        self.sizes = [size for _, words, size in items if words]
        coded = [[self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words] for _, words, _ in items if words]
        growing = _Growing()
        ends = []
        for codes in coded:
            last, states = 0, []
            for code in codes:
                last = growing.extend(last, code)
                states.append(last)
            ends.append(states)
        link, length = growing.link, growing.length
        held: dict[int, list[int]] = {}
        whole: dict[int, list[int]] = {}
        for item, states in enumerate(ends):
            seen: set[int] = set()
            for state in states:
                # shorter states never report: a stretch is at least a window long
                while state > 0 and length[state] >= window and state not in seen:
                    seen.add(state)
                    held.setdefault(state, []).append(item)
                    state = link[state]
            if self.sizes[item] < window:
                whole.setdefault(states[-1], []).append(item)
        n = len(length)
        #: nearest state on the way of suffix links that is a whole short item
        short_link = [-1] * n
        for state in sorted(range(1, n), key=length.__getitem__):
            up = link[state]
            short_link[state] = up if up > 0 and up in whole else short_link[up] if up > 0 else -1
        self.link, self.length, self.short_link = array("i", link), array("i", length), array("i", short_link)
        steps = sorted(((state << 32) | code, target) for state, step in enumerate(growing.step) for code, target in step.items())
        self.step_from, self.step_to = array("q", (k for k, _ in steps)), array("i", (t for _, t in steps))
        self.held_at, self.held = _packed(held, n)
        self.whole_at, self.whole = _packed(whole, n)
        pairs = {(a << 32) | b for codes in coded for a, b in zip(codes, codes[1:], strict=False)}
        self.pairs = np.array(sorted(pairs), np.int64)
        self.least = min([window, *map(len, coded)], default=window)

    def _next(self, state: int, code: int) -> int:
        wanted = (state << 32) | code
        at = bisect_left(self.step_from, wanted)
        return self.step_to[at] if at < len(self.step_from) and self.step_from[at] == wanted else -1

    def stream(self, codes: list[int], first: int = 0) -> Iterator[tuple[int, int, int]]:
        """(item number, begin, end): stretches of words that hold ``window`` words of the item or all of it.

        ``end`` is where the stretch was seen to reach; longer ones follow with the same begin.
        """
        link, length, window = self.link, self.length, self.window
        state = matched = 0
        for at, code in enumerate(codes, first + 1):
            target = self._next(state, code)
            while target < 0 and state:
                state = link[state]
                matched = length[state]
                target = self._next(state, code)
            if target < 0:
                continue
            state = target
            matched += 1
            now, size = state, matched
            while now > 0 and size >= window:
                for item in self.held[self.held_at[now] : self.held_at[now + 1]]:
                    yield item, at - size, at
                now = link[now]
                size = length[now]
            now = state if length[state] == matched and self.whole_at[state] < self.whole_at[state + 1] else self.short_link[state]
            while now > 0:
                for item in self.whole[self.whole_at[now] : self.whole_at[now + 1]]:
                    yield item, at - length[now], at
                now = self.short_link[now]

    def runs(self, codes: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, begin, end) of stretches in which all neighbouring words are neighbours in items."""
        good = codes >= 0
        if self.least > 1 and len(codes) > 1 and len(self.pairs):
            joint = good[:-1] & good[1:]
            joint[bounds[1:-1][(bounds[1:-1] > 0) & (bounds[1:-1] < len(codes))] - 1] = False
            code = (codes[:-1].astype(np.int64) << 32) | codes[1:]
            at = np.flatnonzero(joint)
            place = np.searchsorted(self.pairs, code[at])
            joint[at] = self.pairs[np.minimum(place, len(self.pairs) - 1)] == code[at]
            edge = np.diff(np.concatenate([[0], joint.astype(np.int8), [0]]))
            begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) + 1
        else:
            edge = np.diff(np.concatenate([[0], good.astype(np.int8), [0]]))
            begins, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            cuts = np.unique(bounds)
            parts = [(b, e, *cuts[(cuts > b) & (cuts < e)]) for b, e in zip(begins, ends, strict=True)]
            begins = np.array([x for b, _, *c in parts for x in (b, *c)], np.int64)
            ends = np.array([x for _, e, *c in parts for x in (*c, e)], np.int64)
        wide = ends - begins >= self.least
        for begin, end in zip(begins[wide].tolist(), ends[wide].tolist(), strict=True):
            yield int(np.searchsorted(bounds, begin, side="right")) - 1, begin, end

    def found(self, texts: list[list[str]]) -> dict[tuple[int, int], list[tuple[int, int]]]:
        """(text number, item number) -> the stretches of words of the text that come from the item."""
        get = self.vocabulary.get
        sizes = [len(words) for words in texts]
        bounds = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        codes = np.fromiter((get(w, -1) for words in texts for w in words), np.int64, int(bounds[-1]))
        out: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for number, begin, end in self.runs(codes, bounds):
            base = int(bounds[number])
            for item, b, e in self.stream(codes[begin:end].tolist(), begin - base):
                spans = out.setdefault((number, item), [])
                if spans and spans[-1][0] == b:
                    spans[-1] = (b, e)
                else:
                    spans.append((b, e))
        return out


def item_blocks(benchmark: DataFrame, key: str, text: str, block_words: int, window: int = WINDOW, part_words: int = BLOCK_WORDS, form: bool = True) -> Iterator[list[tuple[int, list[str], int]]]:
    """(key, words, size) of the items in blocks of about ``block_words``; the driver holds one at a time.

    An item of more than ``part_words`` comes in parts that overlap by a window less one word, so
    that each window of it is whole in a part.
    """
    items = benchmark.select(key, text).where(F.length(text) > 0).distinct()
    block: list[tuple[int, list[str], int]] = []
    room = block_words
    for row in items.toLocalIterator():  # one partition at a time
        words = words_of(row[1], form)
        for begin in range(0, max(1, len(words) - window + 1), max(1, part_words - window + 1)):
            part = words[begin : begin + max(part_words, window)]
            if block and len(part) > room:
                yield block
                block, room = [], block_words
            block.append((row[0], part, len(words)))
            room -= len(part)
    yield block


def automata(benchmark: DataFrame, key: str, text: str, window: int, block_words: int, form: bool = True) -> list[Broadcast]:
    """The packed automata of all blocks, each built, broadcast and dropped before the next."""
    context = benchmark.sparkSession.sparkContext
    return [context.broadcast(ItemAutomaton(block, window)) for block in item_blocks(benchmark, key, text, block_words, window, form=form)]


def each_of(machines: list[Broadcast]) -> Iterator[ItemAutomaton]:
    """In a worker: the automata one by one; of several, none stays in memory while the next is used."""
    for machine in machines:
        yield machine.value
        if len(machines) > 1:
            machine.__dict__.pop("_value", None)  # read again from the executor's copy when needed next


def leaks(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS, form: bool = True) -> DataFrame:
    """(key, item, longest, coverage) of every document and the test items it holds.

    A document holds an item if it has ``window`` consecutive words of it, or all its words if
    it has fewer.  ``longest`` is the longest such stretch in words, ``coverage`` its share of
    the item (of an item of more than ``BLOCK_WORDS``, stretches end with its parts).  Null and empty texts,
    and items without a word, are in no pair.  Equal rows give equal results once; two items with
    the same words are both reported.  Without ``form`` texts are compared as they are stored.
    """
    schema = T.StructType([documents.schema[key], T.StructField(item, benchmark.schema[item].dataType), T.StructField("longest", T.IntegerType()), T.StructField("coverage", T.DoubleType())])
    corpus = documents.select(key, text).where(F.length(text) > 0)
    machines = automata(benchmark, item, text, window, block_words, form)

    def matches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = [words_of(t, form) for t in batch[text]]
            for machine in each_of(machines):
                rows = [(batch[key].iat[n], machine.keys[i], max(e - b for b, e in s), machine.sizes[i]) for (n, i), s in machine.found(words).items()]
                yield pd.DataFrame({key: [r[0] for r in rows], item: [r[1] for r in rows], "longest": [r[2] for r in rows], "coverage": [r[2] / r[3] for r in rows]})

    return corpus.mapInPandas(matches, schema).groupBy(key, item).agg(F.max("longest").alias("longest"), F.max("coverage").alias("coverage"))


def cleaned(documents: DataFrame, benchmark: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", window: int = WINDOW, most_words: int = WINDOW, most_coverage: float = 0.5, block_words: int = BLOCK_WORDS, form: bool = True) -> DataFrame:
    """(key, form, removed): the consistent form of each text without leaked spans.

    A span is removed if it is at least ``most_words`` long or covers at least ``most_coverage``
    of its item.  Null texts stay null with nothing removed.  Repeated rows stay repeated.
    """
    schema = T.StructType([documents.schema[key], T.StructField("form", T.StringType()), T.StructField("removed", T.IntegerType())])
    machines = automata(benchmark, item, text, window, block_words, form)

    def strip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            forms = [None if t is None else canonical(t) if form else t for t in batch[text]]
            places = [[m.span() for m in _WORD.finditer(f)] if f else [] for f in forms]
            words = [[f[b:e].lower() for b, e in p] for f, p in zip(forms, places, strict=True)]
            marked: dict[int, set[int]] = {}
            for machine in each_of(machines):
                for (number, i), spans in machine.found(words).items():
                    for b, e in spans:
                        if e - b >= most_words or e - b >= most_coverage * machine.sizes[i]:
                            marked.setdefault(number, set()).update(range(b, e))
            removed = [0] * len(forms)
            for number, gone in marked.items():
                keep, at = [], 0
                for w in sorted(gone):
                    begin, end = places[number][w]
                    if w - 1 in gone:
                        at = end
                        continue
                    keep.append(forms[number][at:begin])
                    at = end
                forms[number] = "".join([*keep, forms[number][at:]])
                removed[number] = len(gone)
            yield pd.DataFrame({key: batch[key], "form": forms, "removed": pd.array(removed, "Int32")})

    return documents.select(key, text).mapInPandas(strip, schema)
