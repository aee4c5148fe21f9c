"""The shortlist by score bounds against scoring every clip for every role."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cutlake.functions.text import ALIAS, STOPWORDS, tokens
from cutlake.operators import retrieval as A

ROLE = "id string, role string, reference_observation string, composition string, substitute_requirements array<string>, target_duration double, target_luma double, target_sat double"
CLIP = ("path string, clip_id string, duration_s double, motion_speed double, local_peaks int, motion_label string, poses int, faces int, semantic_groups array<string>, labels array<string>,"
        " families array<string>, source_sha256 string, orientation string, luma_p50 double, sat_p50 double, laplacian_var double")


def words(text):
    import re

    kept = {w for w in re.findall("[a-z0-9]{2,}", text.lower()) if w not in STOPWORDS}
    return kept | {ALIAS[w] for w in kept if w in ALIAS}


def score(role, clip):
    """Score and evidence of one clip for one role, rule by rule."""
    _, name, seen, composition, needs, duration, luma, sat = role
    path, _, length, speed, peaks, label, poses, faces, groups, labels, families, _, _, c_luma, c_sat, sharp = clip
    own = words(" ".join([path, *groups, *labels, *families]))
    sets = {"role": words(name), "requirement": words(" ".join(needs)), "observation": words(f"{seen} {composition}")}
    text, total, said = set().union(*sets.values()), 0.0, []
    for part, weight in (("role", 5.0), ("requirement", 3.0), ("observation", 1.5)):
        if both := sorted(sets[part] & own):
            total += weight * len(both)
            said.append(f"{part}_terms:" + ",".join(both[:12]))

    def add(value, line):
        nonlocal total
        total += value
        said.append(line)

    if text & {"motion", "sport", "walking"}:
        m = min(3.0, speed * 20) + min(2.0, peaks * 0.5)
        add(m, f"native_motion:{m:.3f}")
    if "walking" in text and "static" in own:
        add(-12.0, "action_contradiction:static_vs_walking")
    if "sport" in text and "static" in own:
        add(-8.0, "action_contradiction:static_vs_sport")
    if text & {"stable", "hold", "locked"} and label == "locked_or_nearly_locked":
        add(2.0, "stable_camera")
    if "human" in text and (poses or faces or "human" in own):
        add(1.5, "human_evidence")
    if "pair" in text and (poses >= 2 or "pair" in own):
        add(3.0 if poses >= 2 else 1.0, "paired_action_evidence")
    if duration is not None:
        add(*((-20.0, "duration_shortfall") if length + 1e-6 < duration else (1.0, "duration_covered")))
    for want, have, top, scale, line in ((luma, c_luma, 1.5, 64, "luma"), (sat, c_sat, 1.0, 128, "saturation")):
        if want is not None and have is not None:
            v = max(0.0, top - abs(want - have) / scale)
            add(v, f"{line}_tiebreak:{v:.3f}")
    if sharp is not None and math.isfinite(sharp):
        v = min(1.0, math.log1p(max(0.0, sharp)) / 8)
        add(v, f"sharpness_tiebreak:{v:.3f}")
    return round(total, 6), said


def tables(seed, clips, roles, everywhere=""):
    rng = random.Random(seed)
    pool = ["walking", "static", "hold", "pair", "sport", "human", "street", "pool", "adult", *(f"w{i}" for i in range(30))]
    some = lambda n: " ".join(rng.choices(pool, weights=[1 / (i + 1) for i in range(len(pool))], k=rng.randint(0, n)))
    maybe = lambda x: None if rng.random() < 0.2 else x
    held = [(f"p/{i:05d}", f"c{i}", float(rng.randint(0, 40)), rng.random() / 4, rng.randint(0, 5), rng.choice(["locked_or_nearly_locked", "moving", None]), rng.randint(0, 3), rng.randint(0, 1), [some(6)], [some(3), everywhere], [some(2)],
             f"sha{i}", rng.choice(["wide", "tall"]), maybe(rng.random() * 255), maybe(rng.random() * 255), maybe(rng.choice([rng.random() * 4000, math.inf, -1.0]))) for i in range(clips)]
    asked = [(f"r{i}", some(2) + " " + everywhere, some(6), some(2), [some(2)] * rng.randint(0, 2), maybe(rng.random() * 30), maybe(rng.random() * 255), maybe(rng.random() * 255)) for i in range(roles)]
    return asked, held


@pytest.mark.parametrize("seed,clips,roles,everywhere,top", [(1, 400, 25, "", 5), (2, 600, 20, "common", 3), (3, 7, 5, "", 20)])
def test_shortlist_equals_scoring_all(spark, monkeypatch, seed, clips, roles, everywhere, top):
    asked, held = tables(seed, clips, roles, everywhere)
    read = []
    monkeypatch.setattr(A, "_scored", lambda pairs, *more, real=A._scored: (read.append(pairs), real(pairs, *more))[1])
    catalog = spark.createDataFrame(held, CLIP).repartition(4)
    got = A.shortlist(spark.createDataFrame(asked, ROLE), catalog, catalog, top)
    rows = {}
    for r in got.collect():
        rows.setdefault(r.role_id, []).append((r["rank"], r.path, r.score, r.evidence, r.source_sha256, r.orientation))
    for role in asked:
        best = sorted((-score(role, c)[0], c[0], i) for i, c in enumerate(held))[:top]
        want = [(k, held[i][0], *score(role, held[i]), held[i][11], held[i][12]) for k, (_, _, i) in enumerate(best, 1)]
        mine = sorted(rows.get(role[0], []))
        assert [(a, b) for a, b, *_ in mine] == [(a, b) for a, b, *_ in want]
        for m, w in zip(mine, want):
            assert abs(m[2] - w[2]) < 2e-6 and m[3:] == w[3:]
    if clips > 100:  # clips are skipped by their bound
        assert read[-1].count() < clips * roles / 4


def test_one_word_in_all_clips(spark):
    clip = lambda i: (f"p/{i:05d}", f"c{i}", 10.0, i / 20000, 0, None, 0, 0, ["common"], [], [], None, None, None, None, None)
    catalog = spark.createDataFrame([clip(i) for i in range(3000)], CLIP).repartition(4)
    roles = spark.createDataFrame([("a", "common motion", "", "", [], 1.0, None, None), ("b", "common", "", "", [], 1.0, None, None)], ROLE)
    got = A.shortlist(roles, catalog, catalog, 4).orderBy("role_id", "rank").collect()
    assert [r.path for r in got] == ["p/02999", "p/02998", "p/02997", "p/02996", "p/00000", "p/00001", "p/00002", "p/00003"]


def test_overlaps_of_a_frequent_word(spark):
    clips = spark.range(3000).select(F.concat(F.lit("p"), F.col("id")).alias("path"), F.array(F.lit("common"), F.concat(F.lit("w"), F.col("id"))).alias("terms"))
    terms = spark.createDataFrame([("a", ["common"], ["w5"], []), ("b", [], ["w5"], ["none"])], "role_id string, t_role array<string>, t_requirement array<string>, t_observation array<string>")
    got = A.score_overlaps(terms, clips)
    assert got.count() == 3001 and got.where("path = 'p5'").orderBy("role_id").select("word_score").collect() == [(8.0,), (3.0,)]


def test_words_of_a_text_are_found_once(spark):
    """A text is searched and its words are gathered once a row, however often they are used after."""
    rng = random.Random(4)
    pool = [*ALIAS, *ALIAS.values(), *STOPWORDS, "a", "x", "Walk", "W1", "wide-open", "été", "b2b"]
    texts = [(i, rng.choice([" ", ", ", "\n"]).join(rng.choices(pool, k=rng.randint(0, 40)))) for i in range(300)]
    found = spark.createDataFrame([*texts, (-1, None)], "id int, text string").select("id", tokens(F.col("text")).alias("ts"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1 and plan.count("array_except(regexp") == 1
    got = {r.id: r.ts for r in found.collect()}
    assert got.pop(-1) is None
    assert all(len(got[i]) == len(set(got[i])) and set(got[i]) == words(text) for i, text in texts)


def test_clips_are_not_dealt_for_the_bar(spark, monkeypatch):
    """The few pairs that give a role's bar are stored before they meet the clips, so that Spark knows how few they are."""
    asked, held = tables(6, 200, 6)
    read = []
    monkeypatch.setattr(A, "_scored", lambda pairs, *more, real=A._scored: (read.append(pairs), real(pairs, *more))[1])
    catalog = spark.createDataFrame(held, CLIP).repartition(4)
    A.shortlist(spark.createDataFrame(asked, ROLE), catalog, catalog, 3).collect()
    plan = read[0]._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Relation") and 0 < read[0].count() <= 6 * 3 * A.SEEDS
