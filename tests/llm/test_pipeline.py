"""The stages one by one, each against a plain version on what it was given."""

from __future__ import annotations

import corpus_pipeline
from cutlake.llm import packing, queries, store, toxicity
from tests.llm import brute

FOLDER = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = queries.table(spark, FOLDER, "documents")
    labels = queries.table(spark, FOLDER, "labels")
    items = [(r.item_id, r.text) for r in queries.table(spark, FOLDER, "benchmark").collect()]
    toxic = {r.doc_id for r in toxicity.score(docs, queries.toxic_model(docs, labels)).collect() if r.score >= 0.7}
    rows = {r.doc_id: r for r in docs.collect()}
    left = sorted(set(rows) - toxic)

    def exact(ids):
        last = {rows[i].text or "": i for i in ids}
        return [i for i in ids if last[rows[i].text or ""] == i]

    def near(ids):
        roots = brute.components([brute.fingerprint(rows[i].text) for i in ids])
        return [i for n, i in enumerate(ids) if roots[n] == n]

    def clean(ids):
        own = [(i, rows[i].text) for i in ids]
        return [i for (i, _), (n, hit, _) in zip(own, brute.contamination(own, items)) if not (hit and 20 * hit >= n)]

    wanted = [left]
    for rule in (exact, near, clean):
        wanted.append(rule(wanted[-1]))
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], wanted):
        docs = store.keep(stage(spark, docs, FOLDER), name)
        got = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == list(next(iter(rows.values())).asDict()) and sorted(got) == want, name
        assert all(got[i] == rows[i] for i in got)
    assert len(rows) > len(wanted[0]) > len(wanted[1]) >= len(wanted[2]) > len(wanted[3])
    whole = corpus_pipeline.run(spark, FOLDER).collect()
    coder = packing.encoding(queries.vocabulary())
    lengths = {i: len(coder.encode_ordinary(rows[i].text or "")) + 1 for i in wanted[-1]}
    seen: dict[int, int] = {}
    for r in whole:
        seen[r.doc_id] = seen.get(r.doc_id, 0) + r.length
    assert seen == lengths
    room: dict[int, list] = {}
    for r in whole:
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in room.values():
        own.sort()
        assert own[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(own, own[1:])) and sum(own[-1]) <= 2048
