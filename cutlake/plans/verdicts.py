"""Verdict algebra."""

from pyspark.sql import functions as F

from cutlake.operators import verdicts as V
from cutlake.plans.base import Dialect, query, view

c = F.col


@view
def reads(q: Dialect) -> str:
    return f"""SELECT l_suppkey AS target, l_linenumber AS state, l_returnflag AS projection,
      CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS proj_order, l_orderkey * 1000000 + l_partkey AS ordinal,
      CASE WHEN l_quantity < 15 THEN '' WHEN l_quantity < 26 THEN 'alpha' WHEN l_quantity < 40 THEN 'beta' ELSE 'gamma' END AS read,
      CASE WHEN l_tax = 0.08e0 THEN 'blank' END AS skipped FROM {q.t('lineitem')}"""


@view
def track_states(q: Dialect) -> str:
    return f"""SELECT o_custkey AS target, o_orderkey AS state_id, o_orderpriority AS declared_text,
      CASE WHEN o_totalprice < 100000 THEN '' WHEN o_orderstatus = 'O' THEN o_orderpriority ELSE lower(o_orderpriority) END AS reference_read,
      o_totalprice / 500000 AS reference_stability,
      CASE o_orderstatus WHEN 'F' THEN o_orderpriority WHEN 'O' THEN '2 high' ELSE NULL END AS delivered_read,
      1 - o_totalprice / 600000 AS delivered_stability FROM {q.t('orders')}"""


@view
def gate_results(q: Dialect) -> str:
    return f"""SELECT o_custkey AS target, substr(o_orderpriority, 1, 1) AS gate, o_orderkey AS state_id,
      CASE o_orderstatus WHEN 'F' THEN 'PASS' WHEN 'O' THEN CASE WHEN o_totalprice > 300000 THEN 'FAIL' ELSE 'PASS' END ELSE 'UNMEASURABLE' END AS verdict
      FROM {q.t('orders')}"""


@view
def frame_ink(q: Dialect) -> str:
    return f"""SELECT l_suppkey AS target, l_linenumber AS state, l_orderkey * 100000 + l_partkey AS frame, l_quantity + 20 AS separation,
      l_discount + l_quantity / 100 AS contrast, CASE WHEN l_suppkey > 5 THEN 0.12e0 END AS reference, l_extendedprice / 1000000 AS ink, l_tax AS same_ink, l_discount / 4 AS other_ink
      FROM {q.t('lineitem')}"""


MODE = """m AS (SELECT {keys}, read AS modal, count(*) AS n, min(ordinal) AS first_seen FROM reads WHERE skipped IS NULL GROUP BY ALL),
t AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, modal = '', first_seen) AS rn, sum(n) OVER (PARTITION BY {keys}) AS total FROM m),
every AS (SELECT DISTINCT {keys} FROM reads),
modes AS (SELECT e.*, modal, coalesce(n, 0)::BIGINT AS modal_count, coalesce(total, 0)::BIGINT AS sample_size, coalesce(n / total, 0.0)::DOUBLE AS share
  FROM every e LEFT JOIN (SELECT * FROM t WHERE rn = 1) t USING ({keys}))"""


@query("g12_modal_read", f"WITH {MODE.format(keys='target, state')} SELECT target, state, modal, modal_count, sample_size, round(share, 4) AS stability FROM modes")
def _(t):
    return V.modal_read(t.reads, ["target", "state"]).drop("_share")


@query(
    "g13_ensemble_resolve",
    f"""WITH {MODE.format(keys='target, state, projection, proj_order')},
    good AS (SELECT *, sample_size > 0 AND coalesce(modal, '') <> '' AND share >= 1.0 / 3.0 AS ok FROM modes),
    r AS (SELECT *, bool_or(ok) OVER (PARTITION BY target, state) AS resolved, row_number() OVER (PARTITION BY target, state ORDER BY NOT ok, proj_order) AS rn FROM good)
    SELECT target, state, resolved, projection, modal, round(share, 4) AS stability, sample_size FROM r WHERE rn = 1""",
)
def _(t):
    return V.ensemble_resolve(t.reads, ["target", "state"], "projection", "proj_order")


@query(
    "g14_agreement",
    """WITH d AS (SELECT s_suppkey AS target, unnest(range(1, 9))::INTEGER AS state FROM supplier),
    x AS (SELECT d.target, d.state, count(*) FILTER (skipped IS NULL AND read IS NOT NULL) AS n, count(*) FILTER (skipped IS NULL AND read = CASE WHEN d.state < 4 THEN 'alpha' ELSE 'beta' END) AS k
      FROM d LEFT JOIN reads r USING (target, state) GROUP BY ALL)
    SELECT target, state, n AS sample_size, CASE WHEN n > 0 THEN round(k / n, 4) END AS agreement,
      CASE WHEN n = 0 THEN 'UNMEASURABLE' WHEN k / n >= 0.25 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM x""",
)
def _(t):
    declared = t.supplier.select(c("s_suppkey").alias("target"), F.explode(F.sequence(F.lit(1), F.lit(8))).alias("state"))
    declared = declared.withColumn("declared", F.when(c("state") < 4, "alpha").otherwise("beta"))
    return V.agreement(t.reads, declared, ["target", "state"])


TRIAGE = """s AS (SELECT o_custkey AS target, o_orderkey AS state_id, lower(substr(o_orderpriority, 3)) AS declared,
  CASE WHEN o_orderstatus <> 'P' THEN lower(substr(o_orderpriority, 3)) WHEN o_totalprice > 250000 THEN 'other' END AS reference,
  CASE WHEN o_totalprice < 100000 THEN lower(substr(o_orderpriority, 3)) WHEN o_totalprice < 200000 THEN 'the ' || lower(substr(o_orderpriority, 3)) WHEN o_totalprice < 300000 THEN 'wrong' END AS delivered,
  CASE WHEN o_totalprice < 150000 THEN 1 ELSE 0 END AS neighbours FROM orders),
v AS (SELECT *, CASE WHEN reference = declared AND delivered = declared THEN 'MATCH'
  WHEN reference = declared AND neighbours > 0 AND coalesce(delivered, '') <> '' AND contains(delivered, declared) THEN 'MATCH_PLUS_NEIGHBOUR_TEXT'
  WHEN reference = declared THEN 'MISMATCH' WHEN reference IS NULL AND delivered IS NULL THEN 'UNRESOLVED_TEXT' ELSE 'UNVERIFIABLE_BY_READER' END AS verdict FROM s)"""


def _triage(t):
    word, price = F.lower(F.substring("o_orderpriority", 3, 99)), c("o_totalprice")
    return V.word_triage(
        t.orders.select(
            c("o_custkey").alias("target"), c("o_orderkey").alias("state_id"), word.alias("declared"),
            F.when(c("o_orderstatus") != "P", word).when(price > 250000, "other").alias("reference"),
            F.when(price < 100000, word).when(price < 200000, F.concat(F.lit("the "), word)).when(price < 300000, "wrong").alias("delivered"),
            F.when(price < 150000, 1).otherwise(0).alias("neighbours"),
        )
    )


@query("g15_word_triage", f"WITH {TRIAGE} SELECT state_id, verdict, verdict IN ('MATCH', 'MISMATCH') AS blocking FROM v")
def _(t):
    return _triage(t).select("state_id", "verdict", "blocking")


@query(
    "g15_triage_rollup",
    f"""WITH {TRIAGE} SELECT target, count(*) AS states_total, count(*) FILTER (verdict IN ('MATCH', 'MISMATCH')) AS sample_size, count(*) FILTER (verdict = 'MISMATCH') AS mismatches,
    CASE WHEN count(*) FILTER (verdict = 'MISMATCH') > 0 THEN 'FAIL' WHEN count(*) FILTER (verdict = 'MATCH') > 0 THEN 'PASS' ELSE 'UNMEASURABLE' END AS verdict FROM v GROUP BY 1""",
)
def _(t):
    return V.triage_rollup(_triage(t), ["target"])


NORM = "regexp_replace(lower(coalesce({0}, '')), '[^0-9a-z]+', '', 'g')"
TRACK = f"""n AS (SELECT *, {NORM.format('reference_read')} AS r, {NORM.format('delivered_read')} AS d, {NORM.format('declared_text')} AS w FROM track_states),
k AS (SELECT *, r <> '' AND reference_stability >= 1.0 / 3.0 AS r_ok, d <> '' AND delivered_stability >= 1.0 / 3.0 AS d_ok FROM n)"""


@query(
    "g16_track_agreement",
    f"""WITH {TRACK}, a AS (SELECT target, count(*) AS states_total, count(*) FILTER (r_ok AND d_ok AND r = d) AS words_ok, count(*) FILTER (r_ok AND d_ok AND r <> d) AS wrong_words,
      count(*) FILTER (r_ok AND NOT d_ok) AS unreadable_delivered, count(*) FILTER (NOT r_ok) AS unverifiable, count(*) FILTER (r_ok AND w = r) AS contract_words_ok,
      count(*) FILTER (r_ok AND w <> r) AS contract_words_wrong FROM k GROUP BY 1)
    SELECT *, CASE WHEN words_ok + wrong_words > 0 THEN round(words_ok / (words_ok + wrong_words), 4) END AS agreement,
      CASE WHEN words_ok + wrong_words < 4 THEN 'UNMEASURABLE' WHEN words_ok / (words_ok + wrong_words) < 0.5 THEN 'FAIL' ELSE 'PASS' END AS verdict,
      CASE WHEN contract_words_ok + contract_words_wrong < 4 THEN 'UNMEASURABLE' WHEN contract_words_ok / (contract_words_ok + contract_words_wrong) < 0.5 THEN 'FAIL' ELSE 'PASS' END AS contract_verdict FROM a""",
)
def _(t):
    return V.track_agreement(t.track_states, ["target"])


@query(
    "g39_override_agreement",
    f"""WITH {TRACK}, a AS (SELECT target, count(*) FILTER (d_ok) AS sample_size, count(*) FILTER (d_ok AND d = '2high') AS agreeing, count(*) AS states_total FROM k GROUP BY 1)
    SELECT *, CASE WHEN sample_size = 0 THEN 'UNMEASURABLE' WHEN agreeing = sample_size THEN 'PASS' ELSE 'FAIL' END AS verdict FROM a""",
)
def _(t):
    declared = t.customer.select(c("c_custkey").alias("target"), F.lit("2-HIGH").alias("override"))
    return V.override_agreement(t.track_states, declared, ["target"])


@query(
    "g17_rollup_verdict",
    """SELECT target, CASE WHEN bool_or(verdict = 'FAIL') THEN 'FAIL' WHEN bool_or(verdict = 'PASS') THEN 'PASS' ELSE 'UNMEASURABLE' END AS verdict
    FROM (SELECT c_custkey AS target, verdict FROM customer LEFT JOIN gate_results ON target = c_custkey) x GROUP BY 1""",
)
def _(t):
    every = t.customer.select(c("c_custkey").alias("target")).join(t.gate_results, "target", "left")
    return every.groupBy("target").agg(V.rollup_verdict(c("verdict")).alias("verdict"))


@query(
    "g18_weakest",
    """WITH s AS (SELECT c_custkey AS target, CASE o_orderstatus WHEN 'F' THEN 'PROVEN' WHEN 'O' THEN CASE WHEN o_totalprice > 490000 THEN 'FAILED' ELSE 'PENDING_HUMAN' END WHEN 'P' THEN 'odd' END AS status
      FROM customer LEFT JOIN orders ON o_custkey = c_custkey),
    r AS (SELECT target, min(list_position(['FAILED', 'PENDING_MACHINE', 'WITHHELD', 'PENDING_HUMAN', 'PROVEN'], status)) AS k FROM s GROUP BY 1)
    SELECT target, coalesce(['FAILED', 'PENDING_MACHINE', 'WITHHELD', 'PENDING_HUMAN', 'PROVEN'][k], 'PENDING_MACHINE') AS status FROM r""",
)
def _(t):
    status = F.when(c("o_orderstatus") == "F", "PROVEN").when(c("o_orderstatus") == "P", "odd").when(c("o_totalprice") > 490000, "FAILED").when(c("o_orderstatus") == "O", "PENDING_HUMAN")
    return (
        t.customer.join(t.orders, c("o_custkey") == c("c_custkey"), "left")
        .groupBy(c("c_custkey").alias("target"))
        .agg(V.weakest(status).alias("status"))
    )


@query(
    "g19_combine_authorities",
    """WITH a AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'PASS' WHEN 'O' THEN 'PASS' ELSE 'PENDING' END AS tech, CASE WHEN o_totalprice > 480000 THEN 'FAIL' ELSE 'PASS' END AS struct_,
      CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'BLOCKED' ELSE 'PASS' END AS vis, CASE o_orderpriority WHEN '1-URGENT' THEN 'APPROVED' WHEN '2-HIGH' THEN 'REJECTED' ELSE 'PENDING' END AS human FROM orders)
    SELECT o_orderkey, CASE WHEN human = 'REJECTED' OR struct_ = 'FAIL' THEN 'REJECT' WHEN tech = 'PENDING' OR vis = 'BLOCKED' THEN 'BLOCKED' WHEN human = 'APPROVED' THEN 'APPROVED' ELSE 'LOCAL_REVIEW_READY' END AS overall,
      tech = 'PASS' AND struct_ = 'PASS' AND vis = 'PASS' AS local_review_ready, tech = 'PASS' AND struct_ = 'PASS' AND vis = 'PASS' AND human = 'APPROVED' AS publishable FROM a""",
)
def _(t):
    tech = F.when(c("o_orderstatus") == "P", "PENDING").otherwise("PASS")
    struct = F.when(c("o_totalprice") > 480000, "FAIL").otherwise("PASS")
    vis = F.when(c("o_orderpriority") == "4-NOT SPECIFIED", "BLOCKED").otherwise("PASS")
    human = F.when(c("o_orderpriority") == "1-URGENT", "APPROVED").when(c("o_orderpriority") == "2-HIGH", "REJECTED").otherwise("PENDING")
    return t.orders.select("o_orderkey", V.combine_authorities(tech, struct, vis, human).alias("a")).select("o_orderkey", "a.*")


@query(
    "g25_worst_frame",
    """WITH w AS (SELECT target, state, arg_min((frame, separation, contrast), (separation, frame)) AS w, quantile_cont(separation, 0.5) AS med, max(reference) AS ref, count(*) AS sample_size FROM frame_ink GROUP BY ALL),
    r AS (SELECT *, CASE WHEN ref > 0 THEN round(w[3] / ref, 4) END AS ratio FROM w)
    SELECT target, state, sample_size, w[1] AS worst_frame, w[2] AS worst_separation, round(med, 2) AS median_separation, ratio,
      CASE WHEN w[2] < 25 THEN 'FAIL' WHEN ratio < 0.8 THEN 'FAIL' WHEN ratio IS NULL THEN 'UNMEASURABLE' ELSE 'PASS' END AS verdict FROM r""",
)
def _(t):
    return V.worst_frame(t.frame_ink, ["target", "state"], "frame", "separation", "contrast", "reference")


@query(
    "g26_contrast_by_layer",
    """WITH r AS (SELECT target, state, frame, separation / 12 AS ratio, row_number() OVER (PARTITION BY target, state ORDER BY separation / 12, frame) AS rn FROM frame_ink)
    SELECT target, state, min(ratio) AS minimum, count(*) AS frames, string_agg(CASE WHEN rn <= 3 THEN frame::VARCHAR END, ',' ORDER BY rn) AS worst_frames,
      CASE WHEN min(ratio) >= 1.8 THEN 'PASS' ELSE 'FAIL' END AS status FROM r GROUP BY 1, 2""",
)
def _(t):
    return V.contrast_by_layer(t.frame_ink.withColumn("ratio", c("separation") / 12), ["target", "state"], "frame", "ratio")


@query(
    "g28_presence",
    """WITH a AS (SELECT target, state, max(CASE WHEN separation < 45 THEN ink END) AS r, max(same_ink) AS d, max(other_ink) AS o, count(CASE WHEN separation < 45 THEN ink END) AS sample_size FROM frame_ink GROUP BY 1, 2),
    v AS (SELECT *, CASE WHEN r IS NULL OR r < 0.003 OR r > 0.55 THEN 'UNMEASURABLE' WHEN d >= 0.25 * r OR o >= 0.25 * r THEN 'PASS' ELSE 'FAIL' END AS verdict FROM a)
    SELECT target, state, sample_size, round(r, 6) AS reference_fraction, round(d, 6) AS delivered_fraction, verdict, CASE WHEN verdict = 'PASS' THEN o >= 0.25 * r AND NOT d >= 0.25 * r ELSE false END AS polarity_divergent FROM v""",
)
def _(t):
    return V.presence(t.frame_ink.withColumn("ink", F.when(c("separation") < 45, c("ink"))), ["target", "state"], "ink", "same_ink", "other_ink")


@query(
    "g30_separation_margin",
    """WITH s AS (SELECT source, toxic = 1 AS rejected, n_chars / 1000.0 AS score FROM documents JOIN labels USING (doc_id))
    SELECT source, max(score) FILTER (rejected)::DOUBLE AS rejected_max, min(score) FILTER (NOT rejected)::DOUBLE AS accepted_min,
      round(min(score) FILTER (NOT rejected) - max(score) FILTER (rejected), 4)::DOUBLE AS margin FROM s GROUP BY 1""",
)
def _(t):
    scored = t.documents.join(t.labels, "doc_id").select("source", (c("toxic") == 1).alias("rejected"), (c("n_chars") / 1000.0).alias("score"))
    return V.separation_margin(scored, ["source"], "score", "rejected")




@view
def face_scores(q: Dialect) -> str:
    return f"""SELECT l_suppkey AS face, l_returnflag AS metric, l_linenumber AS word,
      CASE l_returnflag WHEN 'R' THEN min(l_quantity) ELSE max(l_quantity) END AS score, CASE WHEN l_suppkey % 4 = 0 THEN 60e0 ELSE avg(l_quantity) END AS rival,
      l_returnflag <> 'R' AS higher, CASE WHEN l_returnflag = 'A' THEN 40e0 END AS bound,
      CASE WHEN l_linenumber < 4 OR (l_suppkey = 7 AND l_returnflag = 'N') THEN 'train' ELSE 'holdout' END AS split FROM {q.t('lineitem')} GROUP BY l_suppkey, l_returnflag, l_linenumber"""


@query(
    "g31_holdout_proof",
    """WITH g AS (SELECT *, (CASE WHEN higher THEN score - rival ELSE rival - score END) / greatest(abs(rival), 1e-9) >= 0.05
        AND (bound IS NULL OR CASE WHEN higher THEN score >= bound ELSE score <= bound END) AS good FROM face_scores),
    m AS (SELECT face, metric, bool_and(good) AS ok FROM g WHERE split = 'holdout' GROUP BY 1, 2),
    j AS (SELECT face, count(*) AS metrics, count(*) FILTER (ok) AS metrics_agreeing FROM m GROUP BY 1),
    b AS (SELECT face, bool_or(t AND h) AS overlap, bool_or(t) AS trained FROM (SELECT face, word, bool_or(split = 'train') AS t, bool_or(split = 'holdout') AS h FROM g GROUP BY 1, 2) GROUP BY 1)
    SELECT face, coalesce(metrics, 0) AS metrics, coalesce(metrics_agreeing, 0) AS metrics_agreeing, overlap,
      CASE WHEN metrics >= 2 AND metrics = metrics_agreeing AND NOT overlap AND trained THEN 'HOLDOUT_PROVEN' ELSE 'HYPOTHESIS' END AS identity_status FROM b LEFT JOIN j USING (face)""",
)
def _(t):
    return V.holdout_proof(t.face_scores, ["face"], "metric", "word", "score", "rival", "higher", "bound")


@query(
    "g32_holdout_split",
    """WITH w AS (SELECT DISTINCT lang, unnest(regexp_extract_all(lower(text), '[a-z]{2,}')) AS word FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY sha256(word)) AS rn, count(*) OVER (PARTITION BY lang) AS n FROM w)
    SELECT lang, word, rn <= greatest(1, least(n - 1, round_even(n * 0.5, 0))) AS holdout FROM r""",
)
def _(t):
    words = t.documents.select("lang", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{2,}"), 0))).alias("word"))
    return V.holdout_split(words, ["lang"], "word")


@query(
    "g33_expected_vs_observed",
    """WITH f AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'REJECTED' WHEN 'O' THEN 'UNRESOLVED' ELSE 'ACCEPTED' END AS expected, o_totalprice > 60000 AND o_orderpriority <> '5-LOW' AS ok FROM orders)
    SELECT o_orderkey, CASE expected WHEN 'REJECTED' THEN CASE WHEN ok THEN 'REJECTED' ELSE 'FALSE_PASS' END WHEN 'UNRESOLVED' THEN CASE WHEN ok THEN 'UNRESOLVED' ELSE 'UNVERIFIED' END
      ELSE CASE WHEN ok THEN 'ACCEPTED' ELSE 'UNVERIFIED' END END AS observed, CASE WHEN ok THEN 'PASS' ELSE 'FAIL' END AS status FROM f""",
)
def _(t):
    fixtures = t.orders.select(
        "o_orderkey", F.when(c("o_orderstatus") == "F", "REJECTED").when(c("o_orderstatus") == "O", "UNRESOLVED").otherwise("ACCEPTED").alias("expected"),
        (c("o_totalprice") > 60000).alias("a"), (c("o_orderpriority") != "5-LOW").alias("b"),
    )
    return V.expected_vs_observed(fixtures, ["a", "b"]).select("o_orderkey", "observed", "status")


@query(
    "j14_keyed_diff",
    """WITH a AS (SELECT p_partkey AS id, p_size AS x, p_size * 2 AS y FROM part), b AS (SELECT s_suppkey AS id, s_nationkey AS x, s_nationkey * 2 AS y FROM supplier)
    SELECT id, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 4) AS distance, CASE WHEN b.id IS NULL THEN 'UNMATCHED' WHEN sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 6 THEN 'PASS' ELSE 'FAIL' END AS verdict
    FROM a LEFT JOIN b USING (id)""",
)
def _(t):
    ours = t.part.select(c("p_partkey").alias("id"), F.array(c("p_size"), c("p_size") * 2).alias("rgb"))
    theirs = t.supplier.select(c("s_suppkey").alias("id"), F.array(c("s_nationkey"), c("s_nationkey") * 2).alias("rgb"))
    return V.keyed_diff(ours, theirs, ["id"], "rgb")


def _gates(t):
    return t.gate_results.groupBy("target", "gate").agg(V.rollup_verdict(c("verdict")).alias("verdict"))


G = "g AS (SELECT target, gate, CASE WHEN bool_or(verdict = 'FAIL') THEN 'FAIL' WHEN bool_or(verdict = 'PASS') THEN 'PASS' ELSE 'UNMEASURABLE' END AS verdict FROM gate_results GROUP BY 1, 2)"


@query(
    "j15_overlay_shards",
    f"""WITH {G}, base AS (SELECT * FROM g WHERE verdict <> 'UNMEASURABLE'), tail AS (SELECT c_custkey AS target, '9' AS gate, 'PASS' AS verdict FROM customer WHERE c_mktsegment = 'BUILDING'),
    fresh AS (SELECT DISTINCT o_custkey AS target, '3' AS gate, 'FAIL' AS verdict FROM orders WHERE o_totalprice > 250000),
    kept AS (SELECT b.* FROM base b WHERE target NOT IN (SELECT target FROM tail))
    SELECT k.target, k.gate, coalesce(f.verdict, k.verdict) AS verdict, CASE WHEN f.target IS NOT NULL THEN k.verdict END AS previous, CASE WHEN f.target IS NOT NULL THEN 'repass' ELSE 'base' END AS source FROM kept k LEFT JOIN fresh f USING (target, gate)
    UNION ALL SELECT target, gate, verdict, NULL, 'tail' FROM tail
    UNION ALL SELECT target, gate, verdict, NULL, 'repass' FROM fresh WHERE target IN (SELECT target FROM kept) AND target NOT IN (SELECT target FROM kept WHERE gate = '3')""",
)
def _(t):
    base = _gates(t).where("verdict <> 'UNMEASURABLE'")
    tail = t.customer.where("c_mktsegment = 'BUILDING'").select(c("c_custkey").alias("target"), F.lit("9").alias("gate"), F.lit("PASS").alias("verdict"))
    again = t.orders.where("o_totalprice > 250000").select(c("o_custkey").alias("target"), F.lit("3").alias("gate"), F.lit("FAIL").alias("verdict")).distinct()
    return V.overlay_shards(base, tail, again, "3")


@query(
    "j16_first_wins_merge",
    """WITH u AS (SELECT c_custkey + CASE WHEN c_acctbal > 5000 THEN 0 ELSE 1000000000 END AS key, c_mktsegment AS value, 0 AS r FROM customer UNION ALL SELECT s_suppkey, s_name, 1 FROM supplier UNION ALL SELECT p_partkey, p_name, 2 FROM part)
    SELECT key, arg_min(value, r) AS value FROM u GROUP BY 1""",
)
def _(t):
    pair = lambda df, k, v: df.select(c(k).alias("key"), c(v).alias("value"))
    return V.first_wins_merge([pair(t.customer.withColumn("c_custkey", c("c_custkey") + F.when(c("c_acctbal") > 5000, 0).otherwise(1_000_000_000)), "c_custkey", "c_mktsegment"), pair(t.supplier, "s_suppkey", "s_name"), pair(t.part, "p_partkey", "p_name")], "key")


@query(
    "j19_delta",
    """WITH b AS (SELECT target, state_id, verdict FROM gate_results WHERE gate <> '5'), a AS (SELECT target, state_id, CASE WHEN gate = '1' THEN 'FAIL' WHEN gate = '2' THEN 'PASS' ELSE verdict END AS verdict FROM gate_results)
    SELECT a.target, a.state_id, a.verdict, CASE WHEN a.verdict = 'UNMEASURABLE' THEN 'UNMEASURABLE' WHEN b.verdict IS NULL OR b.verdict = 'UNMEASURABLE' THEN 'NOW-MEASURABLE'
      WHEN b.verdict = 'FAIL' THEN CASE WHEN a.verdict = 'PASS' THEN 'FIXED' ELSE 'STILL-BROKEN' END WHEN a.verdict = 'PASS' THEN 'HELD' ELSE 'REGRESSED' END AS delta FROM a LEFT JOIN b USING (target, state_id)""",
)
def _(t):
    g = t.gate_results
    now = g.select("target", "state_id", F.when(c("gate") == "1", "FAIL").when(c("gate") == "2", "PASS").otherwise(c("verdict")).alias("verdict"))
    return V.delta_join(g.where("gate <> '5'").select("target", "state_id", "verdict"), now, ["target", "state_id"])


@query(
    "o3_severity_order",
    f"""WITH {G}, p AS (SELECT target, max(CASE WHEN gate = '1' THEN verdict END) AS w1, max(CASE WHEN gate = '2' THEN verdict END) AS w2, count(*) FILTER (verdict = 'UNMEASURABLE') AS missing FROM g GROUP BY 1)
    SELECT target, CASE WHEN target % 10 <> 0 THEN ((CASE WHEN w1 = 'FAIL' THEN 1 ELSE 0 END) + (CASE WHEN w2 = 'FAIL' THEN 1 ELSE 0 END)) * 100 + missing END AS severity FROM p""",
)
def _(t):
    gate = lambda g: F.max(F.when(c("gate") == g, c("verdict")))
    wide = _gates(t).groupBy("target").agg(gate("1").alias("w1"), gate("2").alias("w2"), F.count_if(c("verdict") == "UNMEASURABLE").alias("missing"))
    wide = wide.withColumn("mismatches", F.lit(0)).withColumn("status", F.when(c("target") % 10 == 0, "SKIPPED"))
    return V.severity_order(wide, ["w1", "w2"]).select("target", "severity")


@query(
    "d9_contrast_gate",
    """WITH q AS (SELECT target, state, count(*) AS n, quantile_cont(separation / 8, 0.10) AS c10, quantile_cont(separation / 8, 0.5) AS c50, avg(CASE WHEN separation / 8 < 3 THEN 1.0 ELSE 0 END) AS b FROM frame_ink GROUP BY 1, 2)
    SELECT target, state, n, round(c10, 6) AS c10, round(c50, 6) AS c50, round(b, 6) AS below3, CASE WHEN c10 >= 3 AND c50 >= 4.5 AND b < 0.10 THEN 'PASS' WHEN c50 < 3 OR b >= 0.5 THEN 'SEVERE' ELSE 'FAIL' END AS verdict FROM q""",
)
def _(t):
    return V.contrast_gate(t.frame_ink.withColumn("ratio", c("separation") / 8), ["target", "state"], "ratio")


@query(
    "d10_colour_gate",
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, abs(l_discount - l_tax) AS q, abs(l_quantity / 50 - 0.5) AS m FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(',', CASE WHEN q > 0.05 THEN 'q10' END, CASE WHEN m > 0.05 THEN 'q50' END, CASE WHEN q > 0.05 THEN 'q90' END, CASE WHEN m > 0.06 THEN 'saturation' END, CASE WHEN q * 100 > 5 THEN 'highlight' END) AS failed,
      CASE WHEN q <= 0.05 AND m <= 0.05 AND q * 100 <= 5 THEN 'PASS' ELSE 'FAIL' END AS verdict FROM s""",
)
def _(t):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    cols = {f"{side}_{n}": v for n in ("q10", "q90", "highlight") for side, v in (("ours", c("l_discount")), ("ref", c("l_tax")))}
    cols |= {f"{side}_{n}": v for n in ("q50", "saturation") for side, v in (("ours", c("l_quantity") / 50), ("ref", F.lit(0.5)))}
    return V.colour_gate(t.lineitem.select(*keys, *[v.alias(k) for k, v in cols.items()]), keys)
