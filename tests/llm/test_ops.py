"""Operators against plain versions and on awkward rows."""

from __future__ import annotations

import gzip
import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cutlake.llm import decontaminate, eliasfano, exact, lines, ngrams, packing, queries, sharding, simhash, substrings, toxicity, warc, words
from tests.llm import brute

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, source string, _id string, _text long, keep_id string, shard string, fp int, n_words string"
LONG = " ".join(f"word{i % 977} tail{i % 13}" for i in range(30_000))
PASSAGE = "a passage of more than twenty words that some documents share with one another so that it is seen again and again in the table of tests"


def awkward(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 7, "k", "s", 1, "n") for i, t, s in rows], SCHEMA)


ROWS = [
    (1, None, "a"), (2, "", "a"), (3, " \n\t ", None), (4, "one two", "b"), (5, "one two", "b"), (5, "one two", "b"),
    (6, LONG, "c"), (7, LONG, "c"), (8, LONG + " end", "d"), (9, PASSAGE, "a"), (10, "Before. " + PASSAGE + " after", "b"),
    (11, PASSAGE + " " + PASSAGE, "c"), (12, "É ß 漢字 \U0001f600 \x85 x", "d"), (13, "<|endoftext|> a's 'tis", "e"), (None, "no id", "e"),
]


@pytest.fixture(scope="module")
def docs(spark):
    return awkward(spark, ROWS).repartition(3)


@pytest.fixture(scope="module")
def small(spark):
    return [(r.doc_id, r.text) for r in queries.table(spark, SMALL, "documents").collect()]


# words

@pytest.mark.parametrize("kind,pattern", [(words.NOT_SPACE, brute.SPACED), (words.LETTERS, brute.LETTERS)])
@pytest.mark.parametrize("limit", [1, 50, 1 << 20])
def test_words(kind, pattern, limit):
    texts = [t for _, t, _ in ROWS] + ["a", "", "b c", None, "d"]
    column, seen, hashes = pa.array(texts).slice(1), [], {}
    for part in words.slices(column, lower=True, limit=limit):
        found = part.words(kind)
        data = found.data.tobytes()
        for i in range(len(part)):
            own = range(found.first[i], found.first[i + 1])
            seen.append([data[found.starts[w] : found.ends[w]].decode() for w in own])
        for w, h in zip((data[a:b] for a, b in zip(found.starts, found.ends)), found.hashes().tolist()):
            assert hashes.setdefault(w, h) == h
    assert seen == [pattern.findall((t or "").translate(brute.LOW)) for t in texts[1:]]
    assert len(set(hashes.values())) == len(hashes)


# op1

def test_warc_round_trip(spark):
    big, small = "x" * 1500, "y" * 999
    pages = spark.createDataFrame([(1, "http://a\r\nX: y", big), (2, None, big), (3, "u", big + "z"), (4, "u", small), (5, "u", small), (6, "u", None), (7, "u", ""), (7, "u", "WARC/1.1\r\n\r\n"), (None, "u", big)], "page_id long, url string, html string")
    got = {(r.record_id, r.payload_digest): r for r in warc.archive_pages(pages).collect()}
    assert len(got) == 9
    sha = hashlib.sha1(big.encode()).hexdigest()
    assert [got[k, sha].record_type for k in ("1", "2", None)] == ["revisit", "response", "revisit"]
    assert got["1", sha].refers_to == "2" and got["1", sha].payload_bytes == 1500 and got["1", sha].target_uri == "http://a%0D%0AX: y"
    assert all(r.record_type == "response" for (_, d), r in got.items() if d != sha)


def test_warc_files(spark):
    pages = queries.table(spark, SMALL, "pages")
    whole = warc.write_archives(warc.page_records(pages), warc.store.new_folder(spark, "w"), archive_bytes=50_000)
    members = warc.normalise_archives(whole, warc.store.new_folder(spark, "n"))
    assert whole.count() > 1 and members.agg(F.sum("records")).first()[0] == pages.count()
    index = warc.read_index(members).collect()
    path = index[0].archive.removeprefix("file:")
    data = open(path, "rb").read()
    own = sorted((r.offset, r.length) for r in index if r.archive == index[0].archive)
    assert [a + n for a, n in own] == [a for a, _ in own[1:]] + [len(data)]
    assert b"".join(zlib.decompress(data[a : a + n], 31) for a, n in own) == gzip.decompress(data)
    back = warc.read_records(members).select(F.decode("payload", "UTF-8").alias("html"))
    assert back.exceptAll(pages.select("html")).isEmpty() and pages.select("html").exceptAll(back).isEmpty()


def test_warc_damage():
    data = warc.record("1", "response", "u", b"body", "d", None)
    stream = gzip.compress(data) + gzip.compress(data)
    for size in (1, 7, 10_000):
        assert list(warc.records(warc.inflated(stream[i : i + size] for i in range(0, len(stream), size)))) == [data, data]
    with pytest.raises(ValueError):
        list(warc.records(warc.inflated([stream[:-12]])))
    with pytest.raises(ValueError):
        list(warc.records([data[:-9]]))


def test_warc_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.archive_pages(pages).count() == 0


# op2

def test_pieces_are_those_of_the_tokenizer(spark, docs, small):
    import public_tokenizers
    from tokenizers import Tokenizer

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    coder.encode_special_tokens = True
    rows = spark.createDataFrame(small, "doc_id long, text string").unionByName(docs.where("doc_id > 5 or doc_id is null").selectExpr("1000000 + doc_id doc_id", "text"))
    got = {(r.doc_id, r.piece): r for r in packing.pieces(rows, queries.vocabulary(), tokens=True).collect()}
    n = 0
    for r in rows.collect():
        ids = coder.encode(r.text or "", add_special_tokens=False).ids + [0]
        first, at, k = (len(ids) - 1) % 2048 + 1, 0, 0
        while at < len(ids):
            to = first if at == 0 else at + 2048
            data = np.array(ids[at:to], dtype="<u4").tobytes()
            own = got[r.doc_id, k]
            assert (own.start, own.length, own.ids_crc32, bytes(own.tokens)) == (at, to - at, zlib.crc32(data), data)
            at, k, n = to, k + 1, n + 1
    assert n == len(got)


def test_packing(spark, docs):
    packed = packing.pack_documents(docs, queries.vocabulary(), tokens=True, capacity=64).cache()
    rows = {}
    for r in packed.collect():
        rows.setdefault(r.sequence_id, []).append((r.offset, r.length, bytes(r.tokens)))
    for own in rows.values():
        own.sort()
        assert [o + n for o, n, _ in own][:-1] == [o for o, _, _ in own][1:] and own[0][0] == 0 and own[-1][0] + own[-1][1] <= 64
    for r in packing.sequences(packed).collect():
        assert bytes(r.tokens) == b"".join(t for _, _, t in rows[r.sequence_id])
    assert packing.pack_documents(docs.limit(0), queries.vocabulary()).count() == 0
    total = sum(n for own in rows.values() for _, n, _ in own)
    assert len(rows) <= total / 64 * 1.02 + 2


@pytest.mark.parametrize("seed", range(4))
def test_configurations(seed):
    r = np.random.default_rng(seed)
    lengths = np.unique(r.integers(1, 201, 60))
    demand = r.integers(0, 400, len(lengths))
    made = packing.configurations(lengths, demand, 200)
    seen = dict.fromkeys(lengths.tolist(), 0)
    for own, n in made:
        assert sum(own) <= 200 and n > 0
        for x in own:
            seen[x] += n
    assert seen == dict(zip(lengths.tolist(), demand.tolist()))
    plain = sum(n for _, n in packing.best_fit(lengths, demand, 200))
    assert -(-int(lengths @ demand) // 200) <= sum(n for _, n in made) <= plain * 1.005 + 2
    patterns, uses, low = packing.fractional(lengths[demand > 0], demand[demand > 0], 200, 150)
    assert low <= sum(n for _, n in made) and (patterns @ lengths[demand > 0] <= 200).all() and (uses > 0).all()


# op3

def test_exact(spark, docs):
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact.exact_groups(docs).collect()), key=repr)
    want = []
    for i, t, _ in ROWS:
        same = [j for j, u, _ in ROWS if (u or "") == (t or "")]
        top = max((j for j in same if j is not None), default=None)
        want.append((i, top, len(same), i == top))
    assert got == sorted(want, key=repr)
    kept = exact.drop_exact(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 3, 5, 7, 8, 9, 10, 11, 12, 13]
    assert exact.exact_groups(docs.limit(0)).count() == 0 and exact.drop_exact(docs.limit(0)).count() == 0


def test_exact_compares_texts_where_digests_meet(spark, docs, monkeypatch):
    real = F.sha2
    monkeypatch.setattr(exact.F, "sha2", lambda *_: F.lit("same"))
    got = {(r.doc_id, r.keep_id, r.group_size) for r in exact.exact_groups(docs).collect()}
    monkeypatch.setattr(exact.F, "sha2", real)
    assert got == {(r.doc_id, r.keep_id, r.group_size) for r in exact.exact_groups(docs).collect()}


# op4

ITEMS = [(1, "one two"), (2, PASSAGE), (3, PASSAGE.upper() + " more"), (4, None), (5, "!?"), (6, " ".join(f"w{i}" for i in range(40))), (7, " ".join(f"w{i % 3}" for i in range(30))), (8, "two")]


@pytest.mark.parametrize("block", [100_000, 20])
def test_contamination(spark, block):
    r = random.Random(5)
    texts = [t for _, t, _ in ROWS if t != LONG]
    texts += [" ".join(r.choice(("w0", "w1", "w2", "w3", "one", "two", "x")) for _ in range(300)) for _ in range(20)]
    texts += [" ".join(f"w{i}" for i in range(a, a + 15)) + " z " + PASSAGE[: 20 * a] for a in range(12)]
    rows = list(enumerate(texts))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = {x.doc_id: x for x in decontaminate.benchmark_hits(spark.createDataFrame(rows, "doc_id long, text string"), items, block_words=block, cut=True).collect()}
    for (i, t), (n, hit, names) in zip(rows, brute.contamination(rows, ITEMS)):
        assert (got[i].n_words, got[i].n_hit, set(got[i]["items"])) == (n, hit, names), (i, t)
        assert got[i].contaminated == (hit > 0 and 20 * hit >= n)
        data = (t or "").encode()
        for s in reversed(got[i].spans):
            data = data[: s[2]] + data[s[3] :]
        assert got[i].kept_text == data.decode() and sum(s[1] - s[0] for s in got[i].spans) == hit


def test_contamination_edges(spark, docs):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontaminate.benchmark_hits(docs, items.limit(0)).where("n_hit > 0").isEmpty()
    assert decontaminate.benchmark_hits(docs.limit(0), items).count() == 0
    kept = decontaminate.drop_contaminated(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 6, 7, 8, 12, 13]


# op5

def test_toxicity(spark):
    docs, labels = queries.table(spark, "/root/testdata/sf0.01", "documents"), queries.table(spark, "/root/testdata/sf0.01", "labels")
    rows = entry.queries()["op5_toxicity"](spark, "/root/testdata/sf0.01").join(labels, "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert {r.held_out == (brute.fold(r.doc_id, 3) == 1) for r in rows} == {True}
    hot, cold = [r.score for r in held if r.toxic == 1], [r.score for r in held if r.toxic == 0]
    assert np.mean([(a > b) + 0.5 * (a == b) for a in hot for b in cold]) > 0.95
    assert sum(r.predicted == r.toxic for r in held) / len(held) > 0.93
    model = queries.toxic_model(docs, labels)
    found = toxicity.score(docs, model).where("score >= 0.7 and size(sentences) > 0").join(docs, "doc_id").collect()
    assert found
    for r in found:
        for s in r.sentences:
            assert 0 <= s.start < s.end <= len(r.text.encode()) and not set(r.text.encode()[s.start : s.end].decode()) & set(".!?\n")
        rest = 1 - np.prod([1 - s.score for s in r.sentences])
        assert r.score >= rest - 1e-9


def test_toxicity_does_not_grow_with_length(spark):
    docs, labels = (queries.table(spark, "/root/testdata/sf0.01", name) for name in ("documents", "labels"))
    model = queries.toxic_model(docs, labels)
    found = toxicity.score(docs, model).where("size(sentences) > 0").join(docs, "doc_id").collect()
    s, text = max(((s, r.text) for r in found for s in r.sentences), key=lambda x: x[0].score)
    toxic = text.encode()[s.start : s.end].decode()
    plain = "The river ran slowly past the old mill. "
    rows = [(1, plain), (2, plain * 100_000), (3, plain * 50_000 + toxic + ". " + plain * 50_000), (4, toxic)]
    got = {r.doc_id: r for r in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert got[1].score <= 0.5 and got[2].score <= 0.5 + 1e-9 and not got[2].sentences
    assert got[3].score == pytest.approx(got[4].score) and got[3].score >= toxicity.THRESHOLD and len(got[3].sentences) == 1
    kept = toxicity.drop_toxic(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2]


def test_toxicity_edges(spark, docs):
    labels = spark.createDataFrame([(1, 1), (4, None), (6, 0), (None, 1), (9, 5)], "doc_id long, toxic int")
    for own in (labels, labels.limit(0)):
        model = toxicity.learn(docs, own)
        rows = toxicity.score(docs, model).collect()
        assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
        assert toxicity.score(docs.limit(0), model).count() == 0
    assert toxicity.drop_toxic(docs, model).columns == docs.columns and toxicity.drop_toxic(docs, model).count() == len(ROWS)


# op6

@pytest.mark.parametrize("order,tokens", [(1, 4_000_000), (2, 3_000), (3, 3_000), (4, 200_000)])
def test_language_model(spark, small, order, tokens, monkeypatch):
    monkeypatch.setattr(ngrams, "SHARD_TOKENS", tokens)
    monkeypatch.setattr(ngrams, "SLICE", 20_000)
    rows = small[:60] + [(10_001, None), (10_002, ""), (10_003, "The the THE the the the"), (10_004, LONG[:3000])]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    training = [brute.fold(i, 5) != 1 for i, _ in rows]
    got = {r.doc_id: r for r in ngrams.lm_scores(frame, toxicity.fold(F.col("doc_id"), 5) != 1, order=order).collect()}
    want, total = brute.language_model(rows, training, order)
    for (i, _), (n, known, base, own) in zip(rows, want):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(own, abs=order * n / ngrams.SCALE)


def test_language_model_edges(spark, docs):
    rows = ngrams.lm_scores(docs, F.lit(True)).collect()
    assert len(rows) == len(ROWS) and all(r.score <= 0 and r.n_tokens >= 1 for r in rows)
    rows = ngrams.lm_scores(docs, F.lit(False)).collect()  # nothing to learn from
    assert len(rows) == len(ROWS) and all(r.n_known == 0 and r.train_tokens == 0 for r in rows)
    assert ngrams.lm_scores(docs.limit(0), F.lit(True)).count() == 0


def test_language_model_query_counts_every_ngram(spark, small):
    training = [brute.fold(i, 5) != 1 for i, _ in small]
    want, total = brute.language_model(small, training, least=1)
    got = {r.doc_id: r for r in entry.queries()["op6_lm_scoring"](spark, SMALL).collect()}
    assert len(got) == len(small)
    for (i, _), (n, known, base, own) in zip(small, want):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(own, abs=3 * n / ngrams.SCALE)


def test_language_model_trie_holds_ngrams_seen_once(spark, small):
    rows = small[:40]
    trie = ngrams.build(spark.createDataFrame(rows, "doc_id long, text string"), least=1)
    tokens = [brute.SPACED.findall((t or "").translate(brute.LOW)) + ["\0"] for _, t in rows]
    for n in (1, 2, 3):
        assert trie.offsets[n - 1][-1] == len({g for w in tokens for g in zip(*(w[k:] for k in range(n)))})


@pytest.mark.parametrize("least", [1, 2])
def test_language_model_with_one_word_as_half_of_all_tokens(spark, small, least, monkeypatch):
    monkeypatch.setattr(ngrams, "SHARD_TOKENS", 500)
    rows = [(i, " ".join(f"the {w}" for w in (t or "").split()[:200])) for i, t in small[:50]] + [(9_001, "the " * 500), (9_002, "the")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r for r in ngrams.lm_scores(frame, F.lit(True), least=least).collect()}
    want, _ = brute.language_model(rows, [True] * len(rows), least=least)
    for (i, _), (n, _, base, own) in zip(rows, want):
        assert got[i].base_score == pytest.approx(base, rel=1e-9) and got[i].score == pytest.approx(own, abs=3 * n / ngrams.SCALE)


@pytest.mark.parametrize("top", [1, 50, 10_000, 2**40, 2**61])
def test_elias_fano(tmp_path, top):
    r = np.random.default_rng(top % 97)
    for n in (0, 1, 2, 63, 64, 65, 3000):
        x = np.unique(r.integers(0, top, n))
        arrays, facts = eliasfano.encode(x, "x")
        eliasfano.save(f"{tmp_path}/{top}-{n}", arrays, **facts)
        own = eliasfano.Sequence(*eliasfano.load(f"{tmp_path}/{top}-{n}"), "x")
        assert own.at(np.arange(len(x))).tolist() == x.tolist()
        ask = np.concatenate((x, r.integers(0, top + 70, 200)))
        place = {v: i for i, v in enumerate(x.tolist())}
        assert own.find(ask).tolist() == [place.get(v, -1) for v in ask.tolist()]


# op7

@pytest.mark.parametrize("chunk,bucket", [(1_000_000, 1_000_000), (100, 2_000)])
def test_repeats(spark, chunk, bucket, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK_WINDOWS", chunk)
    monkeypatch.setattr(substrings, "BUCKET_WINDOWS", bucket)
    r = random.Random(3)
    rows = [(i, t) for i, t, _ in ROWS if i is not None and i != 5]
    rows += [(100 - i, " ".join(r.choice("ab") for _ in range(r.choice((5, 19, 20, 21, 400))))) for i in range(30)]
    rows += [(200 + i, f"x{i} " + PASSAGE + f" y{i} " * i) for i in range(10)]
    got = {x.doc_id: x for x in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    for (i, t), (n, kept) in zip(rows, brute.repeats(rows)):
        assert (got[i].n_words, got[i].kept_text) == (n, kept), i
        assert got[i].n_removed == sum(s.end - s.start for s in got[i].intervals) == n - len(kept.split(" ") if kept else [])


def test_repeats_edges(spark, docs):
    rows = substrings.remove_repeats(docs).collect()
    assert len(rows) == len(ROWS) and substrings.remove_repeats(docs.limit(0)).count() == 0
    by = {r.doc_id: r for r in rows}
    assert by[None].n_removed == 0 and by[1].n_words == 0 and by[7].kept_text == "" and by[10].kept_text == "Before. after"
    same = spark.createDataFrame([(1, PASSAGE), (1, PASSAGE)], "doc_id long, text string")
    assert [r.n_removed for r in substrings.remove_repeats(same).collect()] == [0, 0]


# op8

def test_shared_lines(spark):
    rows = [(i, f"own {i}\n  shared by all \n\nfour\n{'six' if i < 6 else 'x'}", f"s{i % 8 if i < 8 else 0}") for i in range(12)]
    rows = [(i, t.replace("four", "four" if int(s[1:]) < 4 else "-"), s) for i, t, s in rows] + [(20, None, "s1"), (21, "", None), (22, "shared by all\nfour", None), (None, "shared by all", "s2")]
    docs = spark.createDataFrame([(i, t, s, 1, "k") for i, t, s in rows], "doc_id long, text string, source string, _key long, _pos string")
    got = {r.doc_id: r for r in lines.drop_shared_lines(docs, min_sites=5).collect()}
    sites = {}
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            sites.setdefault(line.strip(" "), set()).add(s)
    for i, t, _ in rows:
        kept = [x for x in (t or "").split("\n") if not x.strip(" ") or len(sites[x.strip(" ")] - {None}) < 5]
        assert (got[i].kept_text, got[i].n_removed) == ("\n".join(kept), len((t or "").split("\n")) - len(kept)), i
    assert lines.drop_shared_lines(docs.limit(0)).count() == 0


def test_shared_lines_run_no_python(spark):
    plan = lines.drop_shared_lines(queries.table(spark, SMALL, "documents"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


# op9

def test_near_groups(spark, small):
    r = random.Random(9)
    rows = list(small[:120])
    base = small[3][1].split()
    for i in range(60):  # near copies of one text
        own = list(base)
        own[r.randrange(len(own))] = f"new{i}"
        rows.append((1000 - i, " ".join(own)))
    rows += [(2000, None), (2001, ""), (2002, "a b"), (2003, "A  b")]
    got = {x.doc_id: x for x in simhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    rows.sort()
    prints = [brute.fingerprint(t) for _, t in rows]
    for (i, _), fp, root in zip(rows, prints, brute.components(prints)):
        assert (got[i].fp & (2**64 - 1), got[i].component_id) == (fp, rows[root][0])


def test_near_links_join_what_pairs_join(spark):
    r = random.Random(1)
    fps = {0, 1, 3, 7, 15, 2**64 - 1}
    for _ in range(40):
        x = r.getrandbits(64)
        for _ in range(30):
            fps.add(x)
            x ^= sum(1 << b for b in r.sample(range(64), r.choice((1, 2, 3, 4, 5))))
    fps = sorted(fps)
    frame = spark.createDataFrame([(x - 2**64 if x >= 2**63 else x,) for x in fps], "fp long")
    links = [(a & (2**64 - 1), b & (2**64 - 1)) for a, b in simhash.near_links(frame).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    root = {x: x for x in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert [find(x) for x in fps] == [fps[i] for i in brute.components(fps)]


def test_components(spark):
    from cutlake.llm.components import smallest_reachable

    chain = [(i, i + 1) for i in range(10, 60)] + [(100, 5), (5, 300), (300, 301), (7, 7)] + [(1000, 1000 + i) for i in range(1, 200)]
    got = dict(smallest_reachable(spark.createDataFrame(chain, "a long, b long")).collect())
    assert all(got[i] == 10 for i in range(10, 61)) and {got[i] for i in (5, 100, 300, 301)} == {5} and got[1150] == 1000
    assert smallest_reachable(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_edges(spark, docs):
    rows = simhash.near_groups(docs).collect()
    assert len(rows) == len(ROWS) and simhash.near_groups(docs.limit(0)).count() == 0
    kept = simhash.drop_near(docs)
    assert kept.columns == docs.columns
    left = [r.doc_id for r in kept.collect()]
    assert None in left and len(set(left)) == len(left) and {1, 4, 6} <= set(left) and not {2, 3, 5, 7} & set(left)


# op10

@pytest.mark.parametrize("n", [1, 2, 3, 40, 1000, 4097])
def test_permutation(n):
    p = sharding.permute(np.arange(n), n, seed=3)
    assert sorted(p.tolist()) == list(range(n))
    assert sharding.permute(p, n, seed=3, back=True).tolist() == list(range(n))
    assert n < 40 or p.tolist() != sharding.permute(np.arange(n), n, seed=4).tolist()
    shard, slot = sharding.locate(n - 1, n, 7, 3)
    assert sharding.row_at(shard, slot, n, 7, 3) == n - 1


def test_shards(spark, docs):
    rows = sharding.shard_rows(docs, ["doc_id", "text"], 4, 1).collect()
    assert len(rows) == len(ROWS) and sorted(r.row_number for r in rows) == list(range(len(ROWS)))
    sizes = [sorted(r.slot for r in rows if r.shard == s) for s in range(4)]
    assert all(s == list(range(len(s))) for s in sizes) and max(map(len, sizes)) - min(map(len, sizes)) <= 1
    ordered = sorted(rows, key=lambda r: r.row_number)
    assert [r.doc_id for r in ordered] == sorted((i for i, _, _ in ROWS), key=lambda i: (i is not None, i))
    again = sharding.shard_rows(docs.repartition(7), ["doc_id", "text"], 4, 1).collect()
    assert {(r.doc_id, r.text, r.shard, r.slot) for r in rows} == {(r.doc_id, r.text, r.shard, r.slot) for r in again}
    assert sharding.shard_rows(docs.limit(0), ["doc_id"], 4).count() == 0


def test_sharding_query(spark, small):
    rows = entry.queries()["op10_sharding"](spark, SMALL).collect()
    assert len(rows) == len(small)
    texts = dict(small)
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(data) + 16, zlib.crc32(data))
    order = sorted((r.doc_id, r) for r in rows)
    for n, (_, r) in enumerate(order):
        assert (r.shard, r.slot) == sharding.locate(n, len(rows), 40, 42)


def test_decontaminate_items_without_an_id(spark):
    docs = spark.createDataFrame([(1, "alpha beta gamma delta"), (2, "beta gamma"), (3, None)], "doc_id long, text string")
    items = spark.createDataFrame([(None, "alpha beta"), ("x", "gamma"), (None, None)], "item_id string, text string")
    got = {r.doc_id: r for r in decontaminate.benchmark_hits(docs, items).collect()}
    assert (got[1].n_hit, got[1]["items"], got[1].contaminated) == (3, ["x", None], True)
    assert (got[2].n_hit, got[2]["items"]) == (1, ["x"]) and (got[3].n_words, got[3].n_hit, got[3]["items"]) == (0, 0, [])
    assert decontaminate.benchmark_hits(docs.where("doc_id > 9"), items).collect() == []


def test_near_rows_of_one_id_are_decided_by_their_texts(spark):
    far = [" ".join(f"{c}{i * 7 + k}" for i in range(3000)) for k, c in enumerate("abc")]
    near = far[0] + " more"
    rows = [(1, far[0], "a"), (5, near, "b"), (5, far[1], "c"), (5, far[1], "d"), (7, far[2], "e"), (7, far[2], "e"), (8, far[2], "f"), (None, far[0], "g"), (9, None, "h"), (9, far[1] + " x", "i")]
    got = sorted(((r.doc_id, r.text) for r in simhash.drop_near(awkward(spark, rows)).collect()), key=repr)
    assert got == sorted([(1, far[0]), (5, far[1]), (7, far[2]), (9, None), (None, far[0])], key=repr)


def test_lines_of_a_long_text_leave_in_linear_time(spark):
    import time

    text = "\n".join(f"shared {i}" if i % 2 else f"own {{}} {i}" for i in range(120_000))
    docs = awkward(spark, [(i, text.replace("{}", str(i)), f"site{i}") for i in range(5)])
    began = time.time()
    got = lines.drop_shared_lines(docs).agg(F.min("n_removed"), F.max("n_removed"), F.max(F.length("kept_text"))).first()
    assert got[0] == got[1] == 60_000 and got[2] > 600_000 and time.time() - began < 100


def test_texts_are_hashed_once_not_for_each_line(spark):
    """A hash of the whole text beside the explode of its lines would be taken for every line."""
    import re

    plan = lines._lines(awkward(spark, ROWS), "doc_id", "text", "source")._jdf.queryExecution().optimizedPlan().toString()
    above = plan[: plan.index("Generate posexplode")]
    assert "Generate" in plan and not re.search(r"hash\(|split\(", above)
