"""Benchmark passages in training text, found with a generalised suffix automaton of the test items."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutlake.llm import words
from cutlake.llm.carry import carried, restored

WINDOW, PART = 13, 20
#: Words of test items in one automaton; more items are matched in further passes.
BLOCK_WORDS = 100_000


class Automaton:
    """Suffix automaton of several word lists.

    State ``v`` stands for the word runs that end at the same places of the
    items; ``length[v]`` is the longest of them, ``link[v]`` the state of its
    longest suffix that ends elsewhere too. A window is a run of ``window`` item
    words, or a whole item that is shorter.
    """

    def __init__(self, items: list[tuple[str, list[int]]], window: int):
        self.next, self.link, self.length, self.window = [{}], [-1], [0], window
        for _, ids in items:
            last = 0
            for word in ids:
                last = self._add(last, word)
        states = len(self.link)
        self.owners: list[tuple[str, ...]] = [()] * states
        self.short: list[tuple[tuple[int, str], ...]] = [()] * states
        owners: dict[int, set[str]] = {}
        short: dict[int, set[tuple[int, str]]] = {}
        for name, ids in items:
            v = 0
            for n, word in enumerate(ids, 1):
                v = self.next[v][word]
                if n >= window:
                    owners.setdefault(self._holder(v), set()).add(name)
            if 0 < len(ids) < window:
                short.setdefault(v, set()).add((len(ids), name))
        for v, names in owners.items():
            self.owners[v] = tuple(names)
        for v in sorted(range(states), key=self.length.__getitem__):  # suffixes come before what they end
            self.short[v] = tuple(short.get(v, ())) + (self.short[self.link[v]] if v else ())
        self.holder = [self._holder(v) if self.length[v] >= window else 0 for v in range(states)]
        self.least = min([min(len(ids), window) for _, ids in items if ids], default=0)

    def _new(self, length: int, link: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _add(self, last: int, word: int) -> int:
        """Extend the list that ended in ``last``; returns the state of the longer list."""
        if word in self.next[last]:
            return self._split(last, word)
        new = self._new(self.length[last] + 1, 0, {})
        v = last
        while v >= 0 and word not in self.next[v]:
            self.next[v][word] = new
            v = self.link[v]
        if v >= 0:
            self.link[new] = self._split(v, word)
        return new

    def _split(self, v: int, word: int) -> int:
        """The state of ``v``'s longest run followed by ``word``, set apart from longer runs if need be."""
        to = self.next[v][word]
        if self.length[to] == self.length[v] + 1:
            return to
        copy = self._new(self.length[v] + 1, self.link[to], dict(self.next[to]))
        self.link[to] = copy
        while v >= 0 and self.next[v].get(word) == to:
            self.next[v][word] = copy
            v = self.link[v]
        return copy

    def _holder(self, v: int) -> int:
        """The state on ``v``'s suffix path that holds the run of ``window`` words."""
        while self.length[self.link[v]] >= self.window:
            v = self.link[v]
        return v

    def stream(self, ids: list[int]):
        """For each word its place, the longest match that ends there and the windows that end there, where there are any."""
        following, link, length, v, matched = self.next, self.link, self.length, 0, 0
        for at, word in enumerate(ids):
            while v and word not in following[v]:
                v = link[v]
                matched = length[v]
            to = following[v].get(word)
            if to is None:
                continue
            v, matched = to, matched + 1
            found = [(self.window, name) for name in self.owners[self.holder[v]]] if matched >= self.window else []
            found += [x for x in self.short[v] if x[0] <= matched]
            if found:
                yield at, matched, found


def _match(docs: DataFrame, items: list[tuple[str, str]], window: int, cut: bool) -> DataFrame:
    """One pass of ``docs(id, text)`` through the automaton of some items."""
    texts = pa.array([t for _, t in items], pa.string())
    lists, vocabulary = [], np.zeros(0, dtype=np.uint64)
    for part in words.slices(texts, lower=True):
        found = part.words(words.LETTERS)
        hashes = found.hashes()
        lists += [hashes[a:b] for a, b in zip(found.first, found.first[1:])]
    if lists:
        vocabulary = np.unique(np.concatenate(lists))
    automaton = Automaton([(name, np.searchsorted(vocabulary, x).tolist()) for (name, _), x in zip(items, lists)], window)
    shared = docs.sparkSession.sparkContext.broadcast((automaton, vocabulary))

    def scan(batches):
        machine, known = shared.value
        for batch in batches:
            rows = []
            for part in words.slices(batch.column(1), lower=True):
                found = part.words(words.LETTERS)
                rows += _scan_slice(machine, known, found, part)
            spans = [r[3] for r in rows]
            out = [batch.column(0), batch.column(1) if cut else pa.nulls(batch.num_rows, pa.string())]
            out += [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)]
            out += [pa.array([r[4] for r in rows], pa.list_(pa.string())), pa.array(spans, pa.list_(pa.list_(pa.int64())))]
            yield pa.RecordBatch.from_arrays(out, names=["id", "text", "n_words", "n_hit", "longest", "items", "spans"])

    more = "text string, n_words long, n_hit long, longest long, items array<string>, spans array<array<long>>"
    return docs.mapInArrow(scan, T.StructType([T.StructField("id", docs.schema["id"].dataType), *T.StructType.fromDDL(more).fields]))


def _scan_slice(machine: Automaton, known: np.ndarray, found: words.Words, part: words.Texts) -> list[tuple]:
    """Per text: words, hit words, longest match, spans as ``[word, word, byte, byte]``, items."""
    n, first = len(found), found.first
    hit, longest, items = np.zeros(n + 1, dtype=bool), {}, {}
    if n and machine.least:
        hashes = found.hashes()
        at = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
        ids = np.where(known[at] == hashes, at, -1)
        # only runs of known words of one text that are long enough can hold a window
        begins = np.zeros(n + 1, dtype=bool)
        begins[first[first < n]] = True
        good = ids >= 0
        start = good.copy()
        start[1:] &= ~good[:-1]
        start |= good & begins[:-1]
        stop = good.copy()
        stop[:-1] &= ~good[1:]
        stop |= good & np.append(begins[1:-1], True)
        starts, stops = np.flatnonzero(start), np.flatnonzero(stop) + 1
        for a, b in zip(starts.tolist(), stops.tolist()):
            if b - a < machine.least:
                continue
            for place, matched, windows in machine.stream(ids[a:b].tolist()):
                text = int(np.searchsorted(first, a, side="right")) - 1
                longest[text] = max(longest.get(text, 0), matched)
                for size, name in windows:
                    hit[a + place + 1 - size : a + place + 1] = True
                    items.setdefault(text, set()).add(name)
    rows = []
    for i in range(len(part)):
        a, b = int(first[i]), int(first[i + 1])
        spans, hits = [], 0
        if i in items:
            edges = np.flatnonzero(np.diff(np.concatenate(([0], hit[a:b], [0]))))
            base = part.bounds[i]
            spans = [[s, e, int(found.starts[a + s] - base), int(found.ends[a + e - 1] - base)] for s, e in edges.reshape(-1, 2).tolist()]
            hits = int(hit[a:b].sum())
        rows.append((b - a, hits, longest.get(i, 0), spans, sorted(items.get(i, ()), key=lambda x: (x is None, x or ""))))
    return rows


def benchmark_hits(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, part: int = PART, block_words: int = BLOCK_WORDS, cut: bool = False) -> DataFrame:
    """One row per document: ``id, n_words, n_hit, longest, items, spans, contaminated``.

    A word is hit if it lies in an occurrence of a window; ``contaminated`` means
    some word is hit and the hit words are at least one in ``part``. ``spans`` are
    the maximal runs of hit words as ``[first word, end word, first byte, end byte]``,
    ``longest`` the longest match that ends in a window (0: none), ``items`` the ids
    with occurring windows as strings (an item without an id hits words like any other and is one null there). ``cut`` adds ``kept_text``, the text without
    its hit spans. A null text has no words; items without words match nothing;
    items of one id are one item; no items leave every document clean; no documents give no rows.

    Items are matched in blocks of about ``block_words`` words, one automaton and one
    pass over the documents each, so what is broadcast has a bound.
    """
    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    tests = items.select(F.col(item_id).cast("string").alias("name"), F.coalesce(F.col(item_text).cast("string"), F.lit("")).alias("body"))
    size = tests.agg(F.sum(F.octet_length("body") / 2)).first()[0] or 0
    blocks = max(1, -(-int(size) // (3 * block_words)))
    tests = tests.withColumn("block", F.pmod(F.xxhash64("name", "body"), F.lit(blocks)))
    passes = [_match(rows, [(r.name, r.body) for r in tests.where(F.col("block") == b).orderBy("name", "body").toLocalIterator()], window, cut or blocks > 1) for b in range(blocks)]
    found = passes[0] if blocks == 1 else _merged(passes)
    hit, n = F.col("n_hit"), F.col("n_words")
    names = [F.col("id").alias(id), "n_words", "n_hit", "longest", "items", "spans", ((hit > 0) & (hit * part >= n)).alias("contaminated")]
    return found.select(*names, *([_without("text", "spans").alias("kept_text")] if cut else []))


def _merged(passes: list[DataFrame]) -> DataFrame:
    """The passes of several blocks as one row per document (repeated rows stay repeated)."""
    numbered = [p.withColumn("_pass", F.lit(i)) for i, p in enumerate(passes)]
    one = reduce(DataFrame.unionByName, numbered).groupBy("id", "text", "n_words").agg(
        F.max("longest").alias("longest"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("parts"), F.sum((F.col("_pass") == 0).cast("int")).alias("_rows"))
    # sorted spans: one that starts within the last merged span extends it
    last = lambda a: F.element_at(a, -1)
    join = lambda a, x: F.when((F.size(a) > 0) & (x[0] <= last(a)[1]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.array(last(a)[0], F.greatest(last(a)[1], x[1]), last(a)[2], F.greatest(last(a)[3], x[3]))))).otherwise(F.concat(a, F.array(x)))
    one = one.withColumn("spans", F.aggregate("parts", F.lit([]).cast("array<array<long>>"), join)).drop("parts")
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, x: n + x[1] - x[0])
    return one.withColumn("n_hit", hit).withColumn("_r", F.explode(F.sequence(F.lit(1), F.col("_rows").cast("int")))).drop("_r", "_rows")


def _without(text: str, spans: str):
    """A text without its byte spans."""
    data = F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")
    start = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(F.col(spans), i - 1)[3])
    stop = lambda i: F.when(i < F.size(spans), F.get(F.col(spans), i)[2]).otherwise(F.octet_length(data))
    pieces = F.transform(F.sequence(F.lit(0), F.size(spans)), lambda i: F.decode(F.substring(data, (start(i) + 1).cast("int"), (stop(i) - start(i)).cast("int")), "UTF-8"))
    return F.array_join(pieces, "")


def drop_contaminated(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """The documents that are not contaminated, with all their columns and whole texts."""
    return restored(benchmark_hits(carried(docs, id, text), items, "_all", "_text", **how).where("not contaminated"))
