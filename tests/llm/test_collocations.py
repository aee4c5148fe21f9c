"""Quotient filters and collocations against plain versions and on awkward rows."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest

from cutlake.llm import collocations, quotient
from tests.llm import brute

SCHEMA = "doc_id long, text string, lang string, _chunk string, _word int, phrase string, rank int, _n string"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, l, "c", 1, "p", 1, "n") for i, (t, l) in enumerate(rows)], SCHEMA).repartition(parts)


@pytest.mark.parametrize("n,bits", [(2, 1), (2, 9), (2, 32), (3, 9), (5, 9), (5, 20), (5, 32), (4, 17)])
@pytest.mark.parametrize("shard_bits", [0, 3, 16])
def test_filters_lose_nothing(n, bits, shard_bits):
    rng = np.random.default_rng(n * bits)
    layout = quotient.Layout(n, bits)
    top = (1 << bits) - 1
    tables = []
    for size in (0, 1, 3000):
        ids = rng.integers(0, min(top, 11) + 1, (size, n)).astype(np.uint64)
        ids[: size // 2] = rng.integers(0, top + 1, (size // 2, n))
        lanes, counts = quotient.added(layout.pack(list(ids.T)))
        counts = counts * np.where(np.arange(len(counts)) % 5, 1, 300)
        assert (np.stack(layout.unpack(layout.pack(list(ids.T))), axis=1) == ids).all()
        tables.append((lanes, counts))
    total, filters = Counter(), {}
    for lanes, counts in tables:
        for key, c in zip(zip(*(x.tolist() for x in lanes)), counts.tolist()):
            total[key] += c
        for shard, data in quotient.shards(layout, lanes, counts, shard_bits):
            filters.setdefault(shard, []).append(data)
    seen = Counter()
    for own in filters.values():
        lanes, counts = quotient.merged(layout, own, held=100)
        keys = list(zip(*(x.tolist() for x in lanes)))
        assert keys == sorted(set(keys))
        seen.update(dict(zip(keys, counts.tolist())))
        assert quotient.contained(lanes, [x[::2] for x in lanes]).tolist() == [i % 2 == 0 for i in range(len(keys))]
    assert seen == total


def sentences(seed: int, n: int):
    rng = random.Random(seed)
    fixed = ["New York city hall", "a b a b a", "of the of the", "Éire ağ 漢字", "x\x01y z"]
    out = []
    for i in range(n):
        words = [rng.choice(fixed) if rng.random() < 0.5 else f"w{rng.randrange(9)}" for _ in range(rng.randrange(12))]
        out.append((rng.choice([" ", "\t", ", ", ". ", "\n"]).join(words), rng.choice(["en", "de", None])))
    return out + [(None, "en"), ("", None), (" \t.,;", "xx"), ("one", "und")]


@pytest.mark.parametrize("chunk,shard_keys", [(collocations.CHUNK, collocations.SHARD_KEYS), (300, 1)])
def test_collocations(spark, monkeypatch, chunk, shard_keys):
    monkeypatch.setattr(collocations, "SHARD_KEYS", shard_keys)
    rows = sentences(chunk, 400)
    for keep in (2000, 7):
        got = collocations.collocations(frame(spark, rows), least=8, keep=keep, chunk=chunk).collect()
        want = brute.collocations(rows, least=8, keep=keep)
        assert len(want) >= 20 and sorted(map(tuple, got)) == sorted(want)


def test_collocations_edges(spark):
    assert collocations.collocations(frame(spark, []), least=2).collect() == []
    assert collocations.collocations(frame(spark, [("a b", "en")] * 3), least=4).collect() == []
    long = "ab cd " * 200_000
    got = collocations.collocations(frame(spark, [(long, "en"), ("ab cd", "en")], 1), least=100, longest=2).collect()
    assert sorted(map(tuple, got)) == sorted(brute.collocations([(long, "en"), ("ab cd", "en")], least=100, longest=2))


def test_words_of_a_chunk_are_held_as_numbers():
    """Numbering a chunk's words takes memory for one table of keys, not for sorted copies of all words."""
    import tracemalloc

    import numpy as np

    from cutlake.llm import collocations as C

    keys = np.random.default_rng(1).integers(0, 50_000, 2_000_000)
    want = np.unique(keys, return_inverse=True, return_counts=True)
    tracemalloc.start()
    got = C._numbered(keys, 50_000)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(np.array_equal(a, b) for a, b in zip(got, want)) and most < 12 * len(keys)
    few = np.array([7, 10**9, 7])
    assert [x.tolist() for x in C._numbered(few, 10**9 + 1)] == [[7, 10**9], [0, 1, 0], [2, 1]]


def test_frequent_words_are_numbered_where_they_are_counted(spark, monkeypatch):
    """A chunk's words get their ids without a join, whose rows grow faster than the input as more words become frequent."""
    import re

    from cutlake.llm import collocations as C

    plans, keep = {}, C.store.keep
    monkeypatch.setattr(C.store, "keep", lambda df, name: (plans.setdefault(name, df._jdf.queryExecution().optimizedPlan().toString()), keep(df, name))[1])
    rows = sentences(5, 300)
    tokens = C.store.keep(C.chunks(frame(spark, rows, 8), "text", "lang", 300), "tokens")
    met, vocabulary, most = C.frequent_words(tokens, 8)
    ids = {(r._lang, r._word): r._id for r in vocabulary.collect()}
    counts = Counter()
    for text, lang in rows:
        counts.update((lang or "und", w) for w in re.findall(r"[^ \t.,;:!?\n-\r]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")))
    assert {(r._lang, r._word): r._f for r in vocabulary.collect()} == {w: c for w, c in counts.items() if c >= 8}
    assert len(set(ids.values())) == len(ids) and min(ids.values()) >= 1 and max(ids.values()) <= most
    own = tokens.where("_word is not null").collect()
    assert len({r._chunk for r in own}) > 5
    assert Counter(map(tuple, met.collect())) == Counter((r._chunk, r._local, ids[r._lang, r._word]) for r in own if (r._lang, r._word) in ids)
    C.collocations(frame(spark, rows), least=8, chunk=300).collect()
    assert "word_ids" in plans and not any("Join" in plan for plan in plans.values())


@pytest.mark.parametrize("pack", [1, 1 << 19])
def test_frequent_words_go_back_to_their_chunks_in_packs(spark, monkeypatch, pack):
    """Stored are a row for each frequent word and one a task and chunk, not one for each word of each chunk."""
    from cutlake.llm import collocations as C

    kept, keep = {}, C.store.keep
    monkeypatch.setattr(C.store, "keep", lambda df, name: kept.setdefault(name, keep(df, name)))
    monkeypatch.setattr(C, "PACK", pack)
    rows = [(" ".join(f"w{i % 97} w{i % 89} of" for i in range(k, k + 300)), "en" if k % 2 else None) for k in range(36)]
    got = C.collocations(frame(spark, rows, 12), least=8, chunk=3000).collect()
    assert sorted(map(tuple, got)) == sorted(brute.collocations(rows, least=8, keep=2000))
    pairs, chunks = kept["tokens"].where("_word is not null").count(), kept["tokens"].select("_chunk").distinct().count()
    words, tasks = kept["word_places"].where("_word is not null").count(), kept["word_places"].select("_task").distinct().count()
    assert pairs > 1500 and kept["word_places"].selectExpr("sum(size(_locals))").first()[0] == pairs
    assert pack == 1 or kept["word_places"].count() <= words + tasks * chunks < pairs / 2


def test_the_last_ranking_of_a_language_gets_the_first_of_its_parts(spark, monkeypatch):
    """One task ranks a language, so it must not get all of the language's phrases."""
    import re

    from cutlake.llm import collocations as C

    monkeypatch.setattr(C, "PARTS", 3)
    rows = sentences(9, 400)
    out = C.collocations(frame(spark, rows), least=8, keep=4)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert re.search(r"Window \[row_number[^\n]*\], \[lang#\d+\][^\n]*\n(?:(?!Window).*\n)*.*Filter [^\n]*<= 4[^\n]*\n(?:(?!Window).*\n)*.*Window \[row_number[^\n]*\], \[lang#\d+, _part#\d+\]", plan)
    assert sorted(map(tuple, out.collect())) == sorted(brute.collocations(rows, least=8, keep=4))
