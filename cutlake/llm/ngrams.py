"""N-gram language model in an Elias-Fano trie: counted and built in Spark, read from mapped files.

A level is cut into shards by the hash of an n-gram's first word; a shard is a
file of its own. Level 1 holds word hashes and counts; level ``k`` holds, for each
node of level ``k - 1``, the words that follow it: pointers to the ranges of
children, the children's word ids made monotone by adding the last value before
the range, and their counts. Quantised probabilities, and the backoffs of the
level above, lie in files beside them.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutlake.llm import eliasfano, store, words

ORDER, DISCOUNT, LEAST_COUNT = 3, 0.5, 2
SHARD_TOKENS = 4_000_000
SLICE = 4 << 20  # bytes of text that are counted or looked up together
SCALE = 2048  # steps of log10 probability
END = np.uint64(0xA0761D6478BD642F)
_U = np.uint64
ROW = "shard long, keys binary, words binary, counts binary"


def pack(x: np.ndarray) -> bytes:
    """Whole numbers as compressed byte planes."""
    return zstandard.compress(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view("<u8").ravel()


def _steps(x: np.ndarray) -> bytes:
    return pack(np.diff(x.astype(np.int64), prepend=0).view(_U))


def _unsteps(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data).view(np.int64))


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(-log10 * SCALE), 0, 65535).astype(np.uint16)


@dataclass
class Trie:
    """Where the levels are and what is known of them; small, so tasks get it whole."""

    folder: str
    order: int
    tokens: int = 0
    words: int = 0
    offsets: list[np.ndarray] = field(default_factory=list)  # per level the first node id of each shard, and the end

    @property
    def shards(self) -> int:
        return len(self.offsets[0]) - 1

    def path(self, name: str, shard: int) -> str:
        return f"{self.folder}/{name}-{shard:06d}"

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.tokens + 0.5 * (self.words + 1)))

    def _shardwise(self, shard: np.ndarray, read, out: np.ndarray) -> np.ndarray:
        """``out`` filled shard by shard; a shard below 0 is left as it is."""
        by = np.argsort(shard, kind="stable")
        cuts = np.searchsorted(shard[by], np.arange(self.shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            own = by[cuts[s] : cuts[s + 1]]
            out[own] = read(int(s), own)
        return out

    def _place(self, level: int, ids: np.ndarray) -> np.ndarray:
        return np.where(ids >= 0, np.searchsorted(self.offsets[level - 1], ids, side="right") - 1, -1)

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of word hashes, -1 for words that training has not seen."""
        def read(s, own):
            at = sequence(self.path("words", s), "values").find((hashes[own] >> _U(1)).astype(np.int64))
            return np.where(at >= 0, at + self.offsets[0][s], -1)

        return self._shardwise(shard_of(hashes, self.shards), read, np.full(len(hashes), -1, np.int64))

    def counts(self, level: int, ids: np.ndarray) -> np.ndarray:
        """Counts of nodes (0 for id -1)."""
        def read(s, own):
            sums, i = sequence(self.path("words" if level == 1 else f"level{level}", s), "sums"), ids[own] - self.offsets[level - 1][s]
            return sums.at(i + 1) - sums.at(i)

        return self._shardwise(self._place(level, ids), read, np.zeros(len(ids), np.int64))

    def children(self, level: int, parents: np.ndarray, following: np.ndarray) -> np.ndarray:
        """Nodes of ``level`` that follow nodes of the level above by a word; -1 where there is none.

        The search is relative to the context: the pointers of the parent give the
        range, the value before the range is added to the word id, and the sum's
        successor in the range must be itself.
        """
        def read(s, own):
            pointers, values = sequence(self.path(f"level{level}", s), "pointers"), sequence(self.path(f"level{level}", s), "values")
            i = parents[own] - self.offsets[level - 2][s]
            heads = np.flatnonzero(np.diff(i, prepend=-1))  # a parent is looked up once for its neighbours in the list
            lo, hi = pointers.at(i[heads]), pointers.at(i[heads] + 1)
            base = np.zeros(len(heads), np.int64)
            some = np.flatnonzero((hi > lo) & (lo > 0))
            base[some] = values.at(lo[some] - 1) + 1
            lo, hi, base = (np.repeat(x, np.diff(np.append(heads, len(i)))) for x in (lo, hi, base))
            out, some = np.full(len(own), -1, np.int64), np.flatnonzero(hi > lo)
            at = values.find(base[some] + following[own[some]])
            good = (at >= lo[some]) & (at < hi[some])
            out[some[good]] = at[good] + self.offsets[level - 1][s]
            return out

        shard = np.where(following >= 0, self._place(level - 1, parents), -1)
        return self._shardwise(shard, read, np.full(len(parents), -1, np.int64))

    def nodes(self, level: int, shard: int) -> tuple[np.ndarray, np.ndarray]:
        """For each node of a shard of ``level`` (2 or deeper), in order: its parent, counted within the shard, and its word id."""
        pointers, values = sequence(self.path(f"level{level}", shard), "pointers"), sequence(self.path(f"level{level}", shard), "values")
        starts = pointers.at(np.arange(pointers.n))
        sizes = np.diff(starts)
        x = values.at(np.arange(values.n))
        base = np.where(starts[:-1] > 0, x[np.maximum(starts[:-1] - 1, 0)] + 1, 0) if len(x) else np.zeros(len(sizes), np.int64)
        return np.repeat(np.arange(len(sizes)), sizes), x - np.repeat(base, sizes)

    def _quantised(self, name: str, key: str, level: int, ids: np.ndarray) -> np.ndarray:
        def read(s, own):
            return eliasfano.load(self.path(name, s))[0][key][ids[own] - self.offsets[level - 1][s]] / -SCALE

        return self._shardwise(self._place(level, ids), read, np.zeros(len(ids)))

    def probabilities(self, level: int, ids: np.ndarray) -> np.ndarray:
        """Quantised log10 probabilities of nodes of level 2 or deeper (0 for id -1)."""
        return self._quantised(f"chances{level}", "probabilities", level, ids)

    def backoffs(self, level: int, ids: np.ndarray) -> np.ndarray:
        """Quantised log10 weights that contexts leave to the shorter context (0 for id -1)."""
        return self._quantised(f"chances{level + 1}", "backoffs", level, ids)


@functools.lru_cache(maxsize=8192)
def sequence(path: str, name: str) -> eliasfano.Sequence:
    return eliasfano.Sequence(*eliasfano.load(path), name)


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards cut the range of hashes, so ids follow the order of hashes over all shards."""
    return (((hashes >> _U(32)) * _U(shards)) >> _U(32)).astype(np.int64)


class Tokens:
    """The tokens of a slice: its words and an end after each text, as places among its distinct tokens."""

    def __init__(self, part: words.Texts):
        found = part.words()
        hashes = np.insert(found.hashes(), found.first[1:], END)
        self.first = found.first + np.arange(len(part) + 1)
        self.distinct, self.at = np.unique(hashes >> _U(1), return_inverse=True)
        self.distinct <<= _U(1)

    def __len__(self) -> int:
        return len(self.at)

    def after(self, n: int) -> np.ndarray:
        """The places that have at least ``n`` tokens of their text before them."""
        inside = np.ones(len(self), dtype=bool)
        for k in range(n):
            at = self.first[:-1] + k
            inside[at[at < self.first[1:]]] = False
        return np.flatnonzero(inside)

    def levels(self, order: int):
        """The distinct n-grams of the slice, level by level from 2: places, numbers of parent and word, and each place's n-gram.

        N-grams are numbered in the order of their words' hashes, so also in that of their ids.
        """
        number, n = self.at, len(self.distinct)
        for level in range(2, order + 1):
            at = self.after(level - 1)
            code, back = np.unique(number[at - 1] * n + self.at[at], return_inverse=True)
            number = np.zeros(len(self), np.int64)
            number[at] = back
            yield at, code // n, code % n, back


def _rows(shard: np.ndarray, columns: list[np.ndarray], counts: np.ndarray, shards: int):
    """Packed rows of n-grams that ascend by their first word, one for each shard that has some."""
    cuts = np.searchsorted(shard, np.arange(shards + 1))
    for s in np.flatnonzero(np.diff(cuts)).tolist():
        own = slice(cuts[s], cuts[s + 1])
        row = (s, _steps(columns[0][own]), pack(np.concatenate([c[own] for c in columns[1:]] or [counts[:0]])), pack(counts[own]))
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], names=["shard", "keys", "words", "counts"])


def _counted(rows: DataFrame, grams, shards: int) -> DataFrame:
    """N-grams of ``rows(text)`` as packed rows; ``grams(tokens)`` gives the shards, words and counts of a slice.

    Equal n-grams of a slice travel once with their count. Texts of several Arrow
    batches are put together until they fill a slice.
    """
    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch.column(0).cast(pa.large_string()))
            size += held[-1].nbytes
            if size >= SLICE:
                yield from out(pa.concat_arrays(held))
                held, size = [], 0
        if held:
            yield from out(pa.concat_arrays(held))

    def out(texts):
        for part in words.slices(texts, lower=True, limit=SLICE):
            yield from _rows(*grams(Tokens(part)), shards)

    return rows.mapInArrow(run, ROW)


def _met(packed: DataFrame, shards: int, done, schema: str) -> DataFrame:
    """Rows of a shard brought together; ``done(shard, columns, counts)`` gets their n-grams, equal ones still apart."""
    def run(batches):
        held, shard = [], None
        for batch in batches:
            for i in range(batch.num_rows):
                s = batch.column(0)[i].as_py()
                if s != shard:
                    if held:
                        yield from one(shard, held)
                    held, shard = [], s
                keys, following, counts = (batch.column(c)[i].as_py() for c in (1, 2, 3))
                keys = _unsteps(keys)
                following = unpack(following).view(np.int64)
                held.append((keys, *(following.reshape(-1, len(keys)) if len(keys) else ()), unpack(counts).view(np.int64)))
        if held:
            yield from one(shard, held)

    def one(shard, held):
        some = [h for h in held if len(h[0])]
        *columns, counts = (np.concatenate(x) for x in zip(*some)) if some else (None, np.zeros(0, np.int64))
        held.clear()
        yield from done(shard, columns if some else None, counts)

    return packed.repartition(shards, "shard").sortWithinPartitions("shard").mapInArrow(run, schema)


def _sizes(shard: int, level: int, nodes: int, total: int):
    yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (shard, level, nodes, total)], names=["shard", "level", "nodes", "total"])


SIZES = "shard long, level long, nodes long, total long"


def _offsets(sizes: DataFrame, shards: int, levels: int) -> tuple[list[np.ndarray], int]:
    nodes, total = np.zeros((levels, shards + 1), np.int64), 0
    for r in sizes.collect():  # a row of four numbers for each shard and level
        nodes[r.level - 1, r.shard + 1] = r.nodes
        total += r.total
    return list(np.cumsum(nodes, axis=1)), total


def _none(rows: DataFrame, shards: int) -> DataFrame:
    """A row without n-grams for each shard, so that a shard without any has a file as well."""
    empty = [F.lit(pack(np.zeros(0, np.int64))).alias(c) for c in ("keys", "words", "counts")]
    return rows.sparkSession.range(shards).select(F.col("id").alias("shard"), *empty)


def build(docs: DataFrame, text: str = "text", order: int = ORDER, discount: float = DISCOUNT, least: int = LEAST_COUNT, folder: str | None = None) -> Trie:
    """A trie of the n-grams of all texts up to ``order``, written to the shared folder.

    Words are cut at white space, A-Z lowered; a text ends with an end token. All
    words are kept with their exact counts; longer n-grams are kept from ``least``
    occurrences on, at any size of the input (1: all of them, with exact counts, as
    the query does). A kept n-gram's parts occur as often,
    so each pass only counts n-grams whose parts the levels above hold. The mass of
    discounts and of n-grams not kept goes to the shorter context.

    Two passes count: one the words, one the n-grams of the full order together with
    the shorter ones that end a text. All others are followed by a word, so their
    counts are sums of those of their followers, and one shuffle gives every level.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = size // (3 * SHARD_TOKENS) + 1  # about half of SHARD_TOKENS words each
    trie = Trie(folder or store.new_folder(spark, "ngrams"), order)

    def unigrams(tokens):
        return shard_of(tokens.distinct, shards), [(tokens.distinct >> _U(1)).astype(np.int64)], np.bincount(tokens.at, minlength=len(tokens.distinct))

    def write_words(shard, columns, counts):
        keys, back = np.unique(columns[0] if columns else counts, return_inverse=True)
        counts = _sums(back, counts)
        arrays, facts = eliasfano.encode(keys, "values")
        more, also = eliasfano.encode(np.concatenate(([0], np.cumsum(counts))), "sums")
        eliasfano.save(trie.path("words", shard), {**arrays, **more}, **facts, **also)
        yield from _sizes(shard, 1, len(keys), int(counts.sum()))

    sizes = _met(_counted(rows, unigrams, shards).unionByName(_none(rows, shards)), shards, write_words, SIZES)
    offsets, tokens = _offsets(sizes, shards, 1)
    trie = Trie(trie.folder, order, tokens, int(offsets[0][-1]), offsets)
    if order > 1:
        trie = _deepen(rows, trie, least)
        for level in range(2, order + 1):
            _weigh(spark, trie, level, discount)
    return trie


def _sums(at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.bincount(at, counts).astype(np.int64)  # exact below 2**53


def _deepen(rows: DataFrame, trie: Trie, least: int) -> Trie:
    """All levels below the words, written from one shuffle of the n-grams of the full order."""
    order, shards, first = trie.order, trie.shards, trie.offsets[0]

    def grams(tokens):
        ids, end = trie.word_ids(tokens.distinct), np.searchsorted(tokens.distinct, END >> _U(1) << _U(1))
        spelt, parts = [ids], []
        for level, (_, parent, word, back) in enumerate(tokens.levels(order), 2):
            # words after the first are raised by one: 0 stands for none
            spelt = [*(x[parent] for x in spelt), ids[word] + 1]
            counts = np.bincount(back, minlength=len(parent))
            out = slice(None) if level == order else word == end
            parts.append([*(x[out] for x in spelt), *[np.zeros(len(counts[out]), np.int64)] * (order - level), counts[out]])
        *columns, counts = (np.concatenate(x) for x in zip(*parts))
        by = np.argsort(columns[0], kind="stable")
        columns = [c[by] for c in columns]
        return np.searchsorted(first, columns[0], side="right") - 1, columns, counts[by]

    def write(shard, columns, counts):
        above, number = int(first[shard + 1] - first[shard]), columns[0] - first[shard] if columns else counts
        for level in range(2, order + 1):
            word = columns[level - 1] if columns else counts
            live = word > 0
            code, back = np.unique(number[live] * trie.words + word[live] - 1, return_inverse=True)
            total = _sums(back, counts[live])
            many = total >= least
            parent, following = code[many] // max(trie.words, 1), code[many] % max(trie.words, 1)
            _write_level(trie.path(f"level{level}", shard), above, parent, following, total[many])
            yield from _sizes(shard, level, len(parent), 0)
            above = len(parent)
            if columns:
                live[live] = many[back]
                number, counts, columns = (np.cumsum(many) - 1)[back[many[back]]], counts[live], [c[live] for c in columns]

    offsets, _ = _offsets(_met(_counted(rows, grams, shards).unionByName(_none(rows, shards)), shards, write, SIZES), shards, order)
    return Trie(trie.folder, order, trie.tokens, trie.words, [first, *offsets[1:]])


def _write_level(path: str, above: int, parent: np.ndarray, following: np.ndarray, counts: np.ndarray) -> None:
    pointers = np.searchsorted(parent, np.arange(above + 1))
    opens = pointers[:-1][np.diff(pointers) > 0]
    ends = np.append(opens[1:], len(parent)) - 1
    base = np.concatenate(([0], np.cumsum(following[ends] + 1)))[:-1] if len(opens) else np.zeros(0, np.int64)
    values = following + np.repeat(base, ends - opens + 1) if len(opens) else following
    arrays, facts = {}, {}
    for name, x in (("pointers", pointers), ("values", values), ("sums", np.concatenate(([0], np.cumsum(counts))))):
        a, f = eliasfano.encode(x, name)
        arrays |= a
        facts |= f
    eliasfano.save(path, arrays, **facts)


def _weigh(spark, trie: Trie, level: int, discount: float) -> None:
    """The probabilities of a level and the backoffs of the one above, a file for each shard, from the levels' files."""
    def run(batches):
        for batch in batches:
            for shard in batch.column(0).to_pylist():
                one(shard)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64())], names=["id"])

    def one(shard):
        parent, following = trie.nodes(level, shard)
        start, stop = trie.offsets[level - 1][shard : shard + 2]
        above = np.arange(*trie.offsets[level - 2][shard : shard + 2])
        share = (trie.counts(level, np.arange(start, stop)) - discount) / trie.counts(level - 1, above)[parent]
        left = np.maximum(1.0 - np.bincount(parent, share, minlength=len(above)), 1e-12)
        if level == 2:
            lower = trie.unigram(_read(trie.counts, 1, following))
        else:
            nodes, at = np.unique(_without_first(trie, level - 1, shard), return_inverse=True)
            ask, back = np.unique(at[parent] * trie.words + following, return_inverse=True)  # in the order of the files, each once
            lower = trie.probabilities(level - 1, trie.children(level - 1, nodes[ask // max(trie.words, 1)], ask % max(trie.words, 1)))[back]
        probability = np.log10(share + left[parent] * 10**lower)
        eliasfano.save(trie.path(f"chances{level}", shard), {"probabilities": quantised(probability), "backoffs": quantised(np.log10(left))})

    spark.range(0, trie.shards, 1, trie.shards).mapInArrow(run, "id long").count()


def _without_first(trie: Trie, level: int, shard: int) -> np.ndarray:
    """The nodes of ``level - 1`` that spell a shard's nodes of ``level`` without their first word."""
    node = trie.nodes(2, shard)[1]  # of a pair: its second word
    for k in range(3, level + 1):
        parent, following = trie.nodes(k, shard)
        node = trie.children(k - 1, node[parent], following)
    return node


def score(docs: DataFrame, trie: Trie, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``id, n_tokens, n_known, base_score, score`` of every whole text.

    ``base_score`` adds log10 of ``(c + 0.5) / (N + 0.5 (V + 1))`` over the tokens;
    ``score`` adds the model's log10 probability of each token after the ones
    before it: that of the longest kept n-gram, with the backoffs of the longer
    contexts. ``n_known`` counts tokens that training has seen. A null text is
    empty: one end token. Other columns are ignored.
    """
    more = "n_tokens long, n_known long, base_score double, score double"
    fields = [T.StructField("id", docs.schema[id].dataType), *T.StructType.fromDDL(more).fields]

    def run(batches):
        for batch in batches:
            out = [np.zeros(batch.num_rows, t) for t in (np.int64, np.int64, float, float)]
            for part in words.slices(batch.column(1), lower=True, limit=SLICE):
                tokens = Tokens(part)
                ids = nodes = trie.word_ids(tokens.distinct)
                counts = trie.counts(1, ids)
                base = trie.unigram(counts)[tokens.at]
                counts, own = counts[tokens.at], base.copy()
                for level, (at, parent, word, back) in enumerate(tokens.levels(trie.order), 2):
                    weight = trie.backoffs(level - 1, nodes)[parent]
                    nodes = trie.children(level, nodes[parent], ids[word])
                    own[at] = np.where(nodes[back] >= 0, trie.probabilities(level, nodes)[back], own[at] + weight[back])
                heads = tokens.first[:-1]
                span = slice(part.at, part.at + len(part))
                for x, value in zip(out, (np.ones(len(tokens), np.int64), (counts > 0).astype(np.int64), base, own)):
                    x[span] = np.add.reduceat(value, heads)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in out)], names=[f.name for f in fields])

    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType(fields)).withColumnRenamed("id", id)


def _read(reader, level: int, ids: np.ndarray) -> np.ndarray:
    distinct, at = np.unique(ids, return_inverse=True)
    return reader(level, distinct)[at]


def lm_scores(docs: DataFrame, training: Column, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """All documents scored by a model of those for which ``training`` holds (null: they are left out of it)."""
    trie = build(docs.where(training), text, **how)
    return score(docs, trie, id, text).withColumn("train_tokens", F.lit(trie.tokens).cast("long"))
