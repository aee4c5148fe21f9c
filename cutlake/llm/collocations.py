"""Collocations: phrases of two to five words that come together more often than their parts would."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cutlake.llm import quotient, store, words

LEAST, LONGEST, KEEP = 100, 5, 2000
CHUNK = 16 << 20
SHARD_KEYS, MOST_SHARD_BITS = 1 << 21, 16
PART = 1 << 20
PACK = 1 << 19
PARTS = 32

#: Bytes that end a piece; these, space and tab end a word.
ENDS = np.zeros(256, dtype=bool)
ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
KIND = ~ENDS
KIND[[0x20, 0x09]] = False


def _planes(ids: np.ndarray) -> bytes:
    """Numbers under 2**32 in as few byte planes as the largest needs; the first byte tells how many."""
    n = max(1, -(-int(ids.max(initial=0)).bit_length() // 8))
    return bytes([n]) + np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :n].T).tobytes()


def _ids(data: bytes) -> np.ndarray:
    n = data[0]
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(n, -1)
    wide = np.zeros((planes.shape[1], 4), np.uint8)
    wide[:, :n] = planes.T
    return wide.reshape(-1).view("<u4")


def _parts(ids: np.ndarray):
    """Stretches of about ``PART`` numbers, cut at zeros."""
    zeros, at = np.flatnonzero(ids == 0), 0
    while at < len(ids):
        k = int(np.searchsorted(zeros, at + PART))
        to = int(zeros[k]) if k < len(zeros) else len(ids)
        yield ids[at:to]
        at = to


def _numbered(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different keys in order, the place of each key among them, their counts; ``most`` is above all keys. A table by key needs no sort where it is small."""
    if most > 2 * len(keys) + 1024:
        return np.unique(keys, return_inverse=True, return_counts=True)
    counts = np.bincount(keys, minlength=most)
    seen = np.flatnonzero(counts)
    place = np.zeros(most, np.uint32)
    place[seen] = np.arange(len(seen), dtype=np.uint32)
    return seen, place[keys], counts[seen]


TOKENS = "_chunk long, _lang string, _word string, _local long, _n long, _ids binary"


def chunks(docs: DataFrame, text: str, lang: str, chunk: int) -> DataFrame:
    """Tokenised chunks of about ``chunk`` bytes: their words by language with counts, and their pieces as word numbers of the chunk, a 0 before each piece."""

    def flush(number, held, langs):
        arrays = pa.chunked_array([h[0] for h in held]).unify_dictionaries()
        codes, opens = (np.concatenate([h[k] for h in held]) for k in (1, 2))
        held.clear()
        dictionary = arrays.chunk(0).dictionary
        keys, at = codes.astype(np.int64), 0
        del codes
        keys *= len(dictionary)
        for one in arrays.chunks:
            keys[at : at + len(one)] += np.asarray(one.indices)
            at += len(one)
        del arrays, one
        seen, local, counts = _numbered(keys, len(langs) * len(dictionary))
        del keys
        ids = np.zeros(len(local) + int(opens.sum()), np.uint32)
        filled = np.ones(len(ids), bool)
        filled[np.flatnonzero(opens) + np.arange(len(ids) - len(local))] = False
        ids[filled] = local + 1
        del opens, filled, local
        own = pa.array(seen // max(len(dictionary), 1))
        columns = [
            pa.array(np.full(len(seen), number)), pa.array(list(langs), pa.string()).take(own), dictionary.take(pa.array(seen % max(len(dictionary), 1))).cast(pa.string()),
            pa.array(np.arange(1, len(seen) + 1)), pa.array(counts.astype(np.int64)), pa.nulls(len(seen), pa.binary()),
        ]
        names = [c.split()[0] for c in TOKENS.split(", ")]
        if len(seen):
            yield pa.RecordBatch.from_arrays(columns, names=names)
        for part in _parts(ids):
            none = [pa.nulls(1, t) for t in (pa.string(), pa.string(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array([number]), *none, pa.array([_planes(part)], pa.binary())], names=names)

    def run(batches):
        number, held, size, langs = TaskContext.get().partitionId() << 33, [], 0, {}
        for batch in batches:
            names = [langs.setdefault(x, len(langs)) for x in pc.fill_null(batch.column(0), "und").to_pylist()]
            for part in words.slices(batch.column(1), lower=True):
                found = part.words(KIND)
                n = np.diff(found.first)
                stops = np.concatenate(([0], np.cumsum(ENDS[part.data], dtype=np.int32)))
                opens = np.zeros(len(found), bool)
                opens[1:] = stops[found.starts[1:]] > stops[found.ends[:-1]]
                opens[found.first[:-1][n > 0]] = 1
                lengths = found.ends - found.starts
                offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int64)
                column = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(found), [None, pa.py_buffer(offsets), pa.py_buffer(part.data[KIND[part.data]])])
                codes = np.repeat(np.array(names[part.at : part.at + len(part)], np.int32), n)
                held.append((column.dictionary_encode(), codes, opens))  # a number for each word, the bytes of different ones only
                size += len(part.data)
                if size >= chunk:
                    yield from flush(number, held, langs)
                    number, held, size, langs = number + 1, [], 0, dict(langs)
        if held:
            yield from flush(number, held, langs)

    return docs.select(F.col(lang).cast("string").alias("_lang"), F.col(text).cast("string").alias("_text")).mapInArrow(run, TOKENS)


PLACED = "_task int, _turn int, _lang string, _word string, _f long, _chunk long, _locals array<int>, _turns array<int>"


def _packed(task: int, held: list) -> pa.RecordBatch:
    """The words held as one row a chunk."""
    chunk, local, turn = (np.concatenate(x) for x in zip(*held))
    order = np.argsort(chunk, kind="stable")
    chunk, local, turn = chunk[order], local[order], turn[order]
    first = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1])))
    at, n = pa.array(np.append(first, len(chunk)).astype(np.int32)), len(first)
    none = [pa.nulls(n, t) for t in (pa.int32(), pa.string(), pa.string(), pa.int64())]
    lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (local, turn)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, task, np.int32)), *none, pa.array(chunk[first]), *lists], names=[c.split()[0] for c in PLACED.split(", ")])


def placed_words(tokens: DataFrame, least: int) -> tuple[DataFrame, DataFrame, int, int]:
    """The words that occur ``least`` times or more, with ids from 1: per chunk, packed; their vocabulary ``_lang, _word, _id, _f``; tasks; the largest id.

    A word has a row for each chunk that holds it. These rows are dealt once, by word,
    and numbered where they were counted, so that no vocabulary is joined back. Tasks
    take ids by turns, turn ``t`` of task ``k`` of ``n`` is ``t * n + k + 1``; they lie
    close where tasks hold about as many words. For the way back to the chunks a task
    packs up to ``PACK`` words into ``_chunk, _task, _locals, _turns``, a row a chunk.
    """

    def run(batches):
        task, turn, last, held, size = TaskContext.get().partitionId(), -1, None, [], 0
        for batch in batches:
            n, (chunk, local, lang, word, count) = batch.num_rows, batch.columns
            if not n:
                continue
            other = pc.or_(pc.not_equal(word[1:], word[:-1]), pc.not_equal(lang[1:], lang[:-1])).to_numpy(zero_copy_only=False)
            new = np.concatenate(([(lang[0], word[0]) != last], other))
            turns = turn + np.cumsum(new)
            turn, last = int(turns[-1]), (lang[-1], word[-1])
            told = [x.filter(pa.array(new)) for x in (pa.array(turns.astype(np.int32)), lang, word, count)]
            m = int(new.sum())
            none = [pa.nulls(m, t) for t in (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m, task, np.int32)), *told, *none], names=[c.split()[0] for c in PLACED.split(", ")])
            held.append((chunk.to_numpy().copy(), local.to_numpy().astype(np.int32), turns.astype(np.int32)))  # no view that holds the batch's words
            size += n
            if size >= PACK:
                yield _packed(task, held)
                held, size = [], 0
        if held:
            yield _packed(task, held)

    counted = tokens.where("_word is not null").select("_chunk", "_local", "_lang", "_word", F.sum("_n").over(W.partitionBy("_word", "_lang")).alias("_f"))
    placed = store.keep(counted.where(F.col("_f") >= least).sortWithinPartitions("_word", "_lang").mapInArrow(run, PLACED), "word_places")
    vocabulary = placed.where("_word is not null")
    tasks, turns = (x or 0 for x in vocabulary.agg(F.max("_task") + 1, F.max("_turn") + 1).first())
    vocabulary = vocabulary.select("_lang", "_word", (F.col("_turn") * tasks + F.col("_task") + 1).cast("int").alias("_id"), "_f")
    return placed.where("_chunk is not null").select("_chunk", "_task", "_locals", "_turns"), vocabulary, tasks, tasks * turns


def frequent_words(tokens: DataFrame, least: int) -> tuple[DataFrame, DataFrame, int]:
    """``placed_words`` with a row ``_chunk, _local, _id`` for each word of a chunk."""
    packs, vocabulary, tasks, most_id = placed_words(tokens, least)
    met = packs.select("_chunk", "_task", F.explode(F.arrays_zip("_locals", "_turns")).alias("_one"))
    return met.select("_chunk", F.col("_one._locals").cast("long").alias("_local"), (F.col("_one._turns") * tasks + F.col("_task") + 1).cast("int").alias("_id")), vocabulary, most_id


def _frequent_ids(pieces: pa.Table, packs: pa.Table, tasks: int) -> pa.Table:
    """A chunk's pieces in ids of the frequent words; other words are breaks, and words between two breaks are left out."""
    out, number = [], 0
    if pieces.num_rows and packs.num_rows:
        number = pieces["_chunk"][0].as_py()
        local, turn = (np.asarray(pc.list_flatten(packs[c])) for c in ("_locals", "_turns"))
        ids = turn * np.int64(tasks) + np.repeat(np.asarray(packs["_task"]), np.asarray(pc.list_value_length(packs["_locals"]))) + 1
        parts = [_ids(x) for x in pieces["_ids"].to_pylist()]
        to = np.zeros(max(int(local.max()), *(int(p.max(initial=0)) for p in parts)) + 1, np.uint32)
        to[local] = ids
        for part in parts:
            x = np.concatenate(([0], to[part], [0])).astype(np.uint32)
            pair = (x[1:] > 0) & (x[:-1] > 0)
            x[1:-1][~(pair[1:] | pair[:-1])] = 0
            x = x[np.concatenate(([True], (x[1:] > 0) | (x[:-1] > 0)))]
            if len(x) > 1:
                out.append(_planes(x))
    return pa.table([pa.array([number] * len(out), pa.int64()), pa.array(out, pa.binary())], names=["_chunk", "_ids"])


FILTERS = "_size int, _shard long, _chunk long, _filter binary"


def _counted(number: int, ids: np.ndarray, sizes, bits: int, shard_bits: int, follows: np.ndarray | None = None):
    """Filters of a chunk's n-grams without a break; ``follows`` marks the words that a frequent pair begins at."""
    rows: list[tuple] = []
    follows = (ids[:-1] > 0) & (ids[1:] > 0) if follows is None else follows
    for n in sizes:
        if len(ids) < n:
            continue
        ok = follows[: len(ids) - n + 1].copy()
        for k in range(1, n - 1):
            ok &= follows[k : len(ids) - n + 1 + k]
        at, layout = np.flatnonzero(ok), quotient.Layout(n, bits)
        lanes, counts = quotient.added(layout.pack([ids[at + k] for k in range(n)]))
        rows += [(n, shard, number, data) for shard, data in quotient.shards(layout, lanes, counts, shard_bits)]
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
    columns = zip(*rows) if rows else [[]] * 4
    return [pa.array(c, k) for c, k in zip(columns, kinds)], ["_size", "_shard", "_chunk", "_filter"]


PHRASES = "_words array<int>, _a long, _chunk long, _keys binary"


def _merge(filters: DataFrame, bits: int, least: int, tell: bool) -> DataFrame:
    """Phrases counted ``least`` times or more, from the filters of all chunks; with ``tell`` also, per chunk, its keys that are among them."""

    def run(table):
        n = table["_size"][0].as_py()
        layout, data = quotient.Layout(n, bits), table["_filter"].to_pylist()
        lanes, counts = quotient.merged(layout, data)
        often = counts >= least
        lanes, counts = [lane[often] for lane in lanes], counts[often]
        ids = np.stack(layout.unpack(lanes), axis=1).astype(np.int32) if len(counts) else np.zeros((0, n), np.int32)
        known: list[tuple[int, bytes]] = []
        if tell and len(counts):
            for number, one in zip(table["_chunk"].to_pylist(), data):
                own, _ = quotient.decode(layout, one)
                if (hit := quotient.contained(own, lanes)).any():
                    known.append((number, b"".join(lane[hit].astype("<u8").tobytes() for lane in own)))
        at = pa.array(np.arange(len(ids) + 1, dtype=np.int32) * n)
        phrases = pa.concat_arrays([pa.ListArray.from_arrays(at, pa.array(ids.reshape(-1))), pa.nulls(len(known), pa.list_(pa.int32()))])
        return pa.table(
            [phrases, pa.array([*counts.tolist(), *[None] * len(known)], pa.int64()), pa.array([*[None] * len(ids), *(k for k, _ in known)], pa.int64()), pa.array([*[None] * len(ids), *(b for _, b in known)], pa.binary())],
            names=["_words", "_a", "_chunk", "_keys"],
        )

    return filters.groupBy("_size", "_shard").applyInArrow(run, PHRASES)


def frequent_phrases(tokens: DataFrame, packs: DataFrame, tasks: int, most_id: int, n_tokens: int, least: int, longest: int) -> DataFrame:
    """``_words`` (ids), ``_a``: every phrase of two to ``longest`` words that occurs ``least`` times or more inside pieces.

    ``tokens`` are stored chunks, ``packs`` their frequent words as ``placed_words`` gives them. A
    phrase that occurs ``least`` times has only pairs that do, so pairs are counted
    first, each chunk is told which of its pairs are frequent, and longer phrases
    are counted where all their pairs are.
    """
    bits = max(1, most_id.bit_length())
    shard_bits = min(MOST_SHARD_BITS, max(3, (n_tokens // SHARD_KEYS).bit_length()))
    packs = packs.withColumnRenamed("_chunk", "_of")
    pieces = tokens.where("_ids is not null").select("_chunk", "_ids")
    ids = store.keep(pieces.groupBy("_chunk").cogroup(packs.groupBy("_of")).applyInArrow(lambda left, right: _frequent_ids(left, right, tasks), "_chunk long, _ids binary"), "word_ids")

    def pairs(batches):
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                columns, names = _counted(number, _ids(data), [2], bits, shard_bits)
                yield pa.RecordBatch.from_arrays(columns, names=names)

    two = store.keep(_merge(ids.mapInArrow(pairs, FILTERS), bits, least, tell=True), "pairs")
    layout = quotient.Layout(2, bits)

    def longer(left, right):
        columns, names = _counted(0, np.zeros(0, np.uint32), [], bits, shard_bits)
        if left.num_rows and right.num_rows:
            keys = [np.concatenate(x) for x in zip(*(np.frombuffer(k, "<u8").reshape(len(layout.widths), -1) for k in right["_keys"].to_pylist()))]
            keys, _ = quotient.added(keys)
            x = np.concatenate([_ids(d) for d in left["_ids"].to_pylist()])
            follows = (x[:-1] > 0) & (x[1:] > 0)
            at = np.flatnonzero(follows)
            follows[at] = quotient.contained(layout.pack([x[at], x[at + 1]]), keys)
            columns, names = _counted(left["_chunk"][0].as_py(), x, range(3, longest + 1), bits, shard_bits, follows)
        return pa.table(columns, names=names)

    phrases = two.where("_words is not null").select("_words", "_a")
    if longest < 3:
        return phrases
    told = two.where("_keys is not null").select(F.col("_chunk").alias("_of"), "_keys")
    filters = ids.groupBy("_chunk").cogroup(told.groupBy("_of")).applyInArrow(lambda left, right: longer(left, right), FILTERS)
    more = store.keep(_merge(filters, bits, least, tell=False).select("_words", "_a"), "phrases")
    return phrases.unionByName(more)


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, keep: int = KEEP, chunk: int = CHUNK,
) -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: the ``keep`` best phrases of each language.

    A-Z are lowered; texts (null: empty) are cut into pieces at ``.,;:!?`` and line
    breaks, pieces into words at spaces and tabs. ``a`` counts a phrase of two to
    ``longest`` words inside pieces, overlaps included, and must be ``least`` or more;
    ``n`` counts all words of the language (null: ``und``). Cut after its first words, a phrase has
    ``l`` and ``r``, the counts of both parts, and ``floor(1000 * a * n / (l * r))``; its
    lowest cut counts, of equal ones that after fewest words. Phrases inside a longer one
    that occurs as often are left out. Higher scores come first, then higher ``a``, then
    the phrase in byte order. Rows that repeat count each. An empty table gives no
    rows; other columns are ignored, whatever their names.

    Words are counted and numbered in one shuffle and go back to their chunks in packs; no table of words is joined to chunks. N-grams of
    word ids are counted in quotient filters, per chunk, and merged per shard, a range of
    the permuted keys, so that no key can crowd one. All counts are exact.
    """
    tokens = store.keep(chunks(docs, text, lang, chunk), "tokens")
    totals = tokens.where("_word is not null").groupBy("_lang").agg(F.sum("_n").alias("n"))
    totals = store.keep(totals, "totals")
    n_tokens = totals.agg(F.sum("n")).first()[0] or 0
    packs, vocabulary, tasks, most_id = placed_words(tokens, least)
    phrases = frequent_phrases(tokens, packs, tasks, most_id, n_tokens, least, longest)

    size = F.size("_words")
    spans = lambda n: F.explode(F.sequence(F.lit(1), n))
    inner = phrases.where(size > 2).select("_words", "_a", F.explode(F.sequence(F.lit(2), size - 1)).alias("_k"))
    inner = inner.select("_words", "_a", "_k", spans(size - F.col("_k") + 1).alias("_s"))
    inner = inner.select(F.slice("_words", F.col("_s"), F.col("_k")).alias("_inner"), "_a")
    covers = inner.groupBy("_inner").agg(F.max("_a").alias("_most"))
    left = phrases.join(covers, (F.col("_words") == F.col("_inner")) & (100 * F.col("_most") >= 100 * F.col("_a")), "left_anti")

    spelled = left.select("_words", "_a", F.posexplode("_words").alias("_at", "_id")).join(vocabulary, "_id")
    spelled = spelled.groupBy("_words", "_a").agg(F.first("_lang").alias("_lang"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_word"))), lambda x: x["_word"]), " ").alias("phrase"))
    known = phrases.unionByName(vocabulary.select(F.array("_id").alias("_words"), F.col("_f").alias("_a")))
    parts = spelled.join(totals, "_lang").select("*", spans(size - 1).alias("_k"))
    parts = parts.join(known.select(F.col("_words").alias("_lw"), F.col("_a").alias("_l")), F.slice("_words", 1, F.col("_k")) == F.col("_lw"))
    parts = parts.join(known.select(F.col("_words").alias("_rw"), F.col("_a").alias("_r")), F.slice("_words", F.col("_k") + 1, F.size("_words") - F.col("_k")) == F.col("_rw"))
    wide = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"cast({wide('_a')} * {wide('n')} * 1000bd as decimal(38, 0)) div cast({wide('_l')} * {wide('_r')} as decimal(38, 0))")
    lowest = parts.withColumn("_score", score).groupBy("_lang", "phrase", F.col("_a").alias("a"), "n").agg(F.min(F.struct("_score", "_k", "_l", "_r")).alias("_cut"))
    out = lowest.select(F.col("_lang").alias("lang"), "phrase", "a", F.col("_cut._l").alias("l"), F.col("_cut._r").alias("r"), "n", F.col("_cut._score").alias("score"))
    rank = lambda *by: F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), F.desc("a"), "phrase"))
    # a language's first are among the first of its parts, so that the last task of a language gets at most keep * PARTS rows
    out = out.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(PARTS)).cast("int")).withColumn("_own", rank("lang", "_part")).where(F.col("_own") <= keep)
    return out.withColumn("_rank", rank("lang")).where(F.col("_rank") <= keep).select("lang", F.col("_rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
