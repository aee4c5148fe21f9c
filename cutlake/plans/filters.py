"""Clip filters, bans and validation queries."""

from pyspark.sql import functions as F

from cutlake.operators import filters as P
from cutlake.plans.base import Dialect, query, view

c = F.col


def clips(t):
    tags = F.struct(
        F.array("role_a", "role_b").alias("roles"), F.array(c("verb")).alias("action_verbs"), c("world").alias("world_cluster"), "energy", "subject", "lighting", c("crop").alias("crop_safety_916"), "confidence"
    )
    return t.clip_tags.select("clip_id", "stem", "duration", F.when(c("tagged"), tags).alias("tags"), c("frame_count").cast("long").alias("frame_count"), F.struct(F.lit(24).alias("num"), F.lit(1).alias("den")).alias("fps"))


RANK = "CASE {0} WHEN 'high' THEN 2 WHEN 'medium' THEN 1 ELSE 0 END"


@query(
    "p1_find_clips",
    f"""SELECT clip_id, confidence, energy FROM clip_tags WHERE tagged AND (role_a = 'promo' OR role_b = 'promo') AND contains(verb, 'i') AND energy <> 'low' AND crop = 'safe' AND duration >= 5
    ORDER BY {RANK.format('confidence')} DESC, {RANK.format('energy')} DESC, clip_id LIMIT 40""",
)
def _(t):
    found = P.find_clips(clips(t), role="promo", action="i", min_energy="medium", crop_safe=True, min_duration=5, limit=40)
    return found.select("clip_id", "tags.confidence", "tags.energy")


@query("p1_find_clips_all", "SELECT clip_id, lighting FROM clip_tags WHERE tagged AND subject = 'person' AND lighting = 'warm' AND world = 'Brand#4'")
def _(t):
    found = P.find_clips(clips(t), subject="person", lighting="warm", world="Brand#4", limit=None)
    return found.select("clip_id", "tags.lighting")


@query(
    "p2_eligible_pool",
    """WITH r AS (SELECT n_nationkey AS slot, n_nationkey * 20 + 10 AS frames, n_regionkey AS g FROM nation)
    SELECT slot, clip_id, frames::BIGINT AS needed_frames, (frame_count - frames)::BIGINT AS spare_frames FROM clip_tags, r
    WHERE tagged AND frame_count >= frames AND CASE g WHEN 0 THEN role_a IN ('small', 'promo') OR role_b IN ('small', 'promo') WHEN 1 THEN role_b IN ('hot', 'red', 'blue') WHEN 2 THEN role_a IN ('large', 'small') OR role_b IN ('large', 'small') ELSE true END
      AND CASE WHEN g = 1 THEN role_a <> 'medium' AND role_b <> 'medium' ELSE true END AND CASE WHEN g = 2 THEN lighting = 'cool' ELSE true END AND CASE WHEN g = 3 THEN world IN ('Brand#1', 'Brand#2') AND energy = 'high' ELSE true END
      AND CASE WHEN g = 4 THEN world NOT IN ('Brand#3', 'Brand#5') AND subject = 'person' AND clip_id <> 'C0000005' ELSE true END""",
)
def _(t):
    g = c("n_regionkey")
    pick = lambda name, **sets: F.coalesce(*[F.when(g == int(k[1:]), F.array(*[F.lit(x) for x in v])) for k, v in sets.items()], F.array().cast("array<string>")).alias(name)
    rules = t.nation.select(
        c("n_nationkey").alias("slot"), (c("n_nationkey") * 20 + 10).alias("frames"),
        pick("roles", g0=["small", "promo"], g1=["hot", "red", "blue"], g2=["large", "small"]), pick("deny_roles", g1=["medium"]), pick("lighting", g2=["cool"]), pick("subject", g4=["person"]),
        pick("world", g3=["Brand#1", "Brand#2"]), pick("deny_world", g4=["Brand#3", "Brand#5"]), pick("energy", g3=["high"]), pick("exclude", g4=["C0000005"]),
    )
    out = P.eligible_pool(clips(t).where("tags IS NOT NULL"), rules)
    return out.select("slot", "clip_id", "needed_frames", "spare_frames")


@query(
    "p4_ban_keys",
    r"""WITH e AS (SELECT doc_id, sha256(text) AS h, source || '/ab__' || doc_id || '.mov' AS f, lang || doc_id AS i FROM documents),
    b AS (SELECT doc_id, unnest(['ab__' || doc_id || '.mov', doc_id || '.mov', 'ab__' || doc_id, doc_id::VARCHAR]) AS key FROM e)
    SELECT DISTINCT * FROM (SELECT 'hash' AS kind, h AS key FROM e UNION ALL SELECT 'file', key FROM b UNION ALL SELECT 'id', i FROM e UNION ALL SELECT 'file', i FROM e)""",
)
def _(t):
    docs = t.documents.select(
        F.concat("lang", c("doc_id").cast("string")).alias("id"), F.concat("source", F.lit("/ab__"), c("doc_id").cast("string"), F.lit(".mov")).alias("file"), F.array(F.sha2("text", 256)).alias("match_keys")
    )
    return P.ban_keys(docs, ["id"], ["file"], ["match_keys"])


@query(
    "p15_validate_selection",
    """WITH s AS (SELECT l_suppkey AS project, l_partkey AS block_id, l_orderkey * 10 + l_linenumber AS ordinal, l_quantity::BIGINT AS frames, CASE l_returnflag WHEN 'A' THEN 'red ring' WHEN 'N' THEN 'PENDING_view' ELSE 'seen' END AS o,
      CASE WHEN l_discount > 0.08 THEN 'REPLACE_me' WHEN l_discount > 0.07 THEN NULL ELSE 'm' END AS src, (l_tax * 100)::INTEGER - 1 AS start, CASE WHEN l_linestatus = 'F' THEN 1.0 ELSE 0.5 END AS speed FROM lineitem),
    b AS (SELECT s_suppkey AS project, p_partkey AS block_id, p_size::BIGINT AS bf, p_name AS role FROM supplier JOIN part ON p_size % 10 = s_suppkey % 10),
    j AS (SELECT s.*, bf, role FROM s LEFT JOIN b USING (project, block_id)),
    v AS (SELECT project, block_id, ordinal, unnest([CASE WHEN bf IS NULL THEN 'unknown_block' END, CASE WHEN frames <> bf THEN 'wrong_frames' END, CASE WHEN o LIKE 'PENDING%' THEN 'missing_observation' END, CASE WHEN lower(o) = lower(role) THEN 'copied_observation' END,
      CASE WHEN src IS NULL OR src LIKE 'REPLACE%' THEN 'missing_source' END, CASE WHEN start < 0 THEN 'negative_start' END, CASE WHEN speed <> 1 THEN 'speed_changed' END]) AS violation FROM j)
    SELECT * FROM v WHERE violation IS NOT NULL UNION ALL SELECT project, block_id, max(ordinal), 'duplicate_block' FROM s GROUP BY 1, 2 HAVING count(*) > 1""",
)
def _(t):
    slots = t.lineitem.select(
        c("l_suppkey").alias("project"), c("l_partkey").alias("block_id"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("ordinal"), c("l_quantity").cast("long").alias("frames"),
        F.when(c("l_returnflag") == "A", "red ring").when(c("l_returnflag") == "N", "PENDING_view").otherwise("seen").alias("candidate_observation"),
        F.when(c("l_discount") > 0.08, "REPLACE_me").when(c("l_discount") <= 0.07, "m").alias("source_path"), (F.rint(c("l_tax") * 100).cast("int") - 1).alias("source_start_frame"),
        F.lit(False).alias("reverse"), F.when(c("l_linestatus") == "F", 1.0).otherwise(0.5).alias("speed"),
    )
    parts = t.part.select(c("p_partkey").alias("block_id"), c("p_size").cast("long").alias("frames"), c("p_name").alias("role"))
    return P.validate_selection(slots, P.named_blocks(slots, t.supplier.select(c("s_suppkey").alias("project")), parts, c("frames") % 10 == c("project") % 10))


@query(
    "p16_validate_feasibility",
    """WITH r AS (SELECT o_custkey AS project, o_orderkey AS block_id, CASE o_orderstatus WHEN 'F' THEN 'exact_scene_available' WHEN 'O' THEN 'role_equivalent_substitute' ELSE CASE WHEN o_totalprice > 400000 THEN 'maybe' ELSE 'missing' END END AS cover,
      CASE WHEN o_totalprice < 50000 THEN 'PENDING_look' ELSE 'seen' END AS evidence, CASE o_orderpriority WHEN '1-URGENT' THEN 'EXACT_SCENE_SELECTED' WHEN '2-HIGH' THEN 'APPROVED_ROLE_EQUIVALENT_SUBSTITUTE' ELSE 'ACQUIRE_NEW_FOOTAGE' END AS d,
      CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE 'C' || lpad(CAST(o_custkey AS VARCHAR), 7, '0') END AS clip FROM orders),
    v AS (SELECT project, block_id, unnest([CASE WHEN cover = 'maybe' THEN 'invalid_coverage' END, CASE WHEN evidence LIKE 'PENDING%' THEN 'missing_evidence' END, CASE WHEN cover <> 'missing' AND clip IS NULL THEN 'no_clips' END,
      CASE WHEN cover = 'role_equivalent_substitute' AND d <> 'APPROVED_ROLE_EQUIVALENT_SUBSTITUTE' THEN 'substitute_not_approved' END, CASE WHEN cover = 'exact_scene_available' AND d <> 'EXACT_SCENE_SELECTED' THEN 'exact_not_selected' END,
      CASE WHEN cover = 'missing' AND d <> 'ACQUIRE_NEW_FOOTAGE' THEN 'missing_undecided' END, CASE WHEN cover <> 'missing' AND clip NOT IN (SELECT clip_id FROM clip_tags WHERE energy <> 'low') THEN 'unknown_clip' END]) AS violation FROM r)
    SELECT * FROM v WHERE violation IS NOT NULL""",
)
def _(t):
    cover = F.when(c("o_orderstatus") == "F", "exact_scene_available").when(c("o_orderstatus") == "O", "role_equivalent_substitute").when(c("o_totalprice") > 400000, "maybe").otherwise("missing")
    decision = F.when(c("o_orderpriority") == "1-URGENT", "EXACT_SCENE_SELECTED").when(c("o_orderpriority") == "2-HIGH", "APPROVED_ROLE_EQUIVALENT_SUBSTITUTE").otherwise("ACQUIRE_NEW_FOOTAGE")
    clip = F.array(F.concat(F.lit("C"), F.lpad(c("o_custkey").cast("string"), 7, "0")))
    rows = t.orders.select(
        c("o_custkey").alias("project"), c("o_orderkey").alias("block_id"), cover.alias("coverage"), F.when(c("o_totalprice") < 50000, "PENDING_look").otherwise("seen").alias("evidence"), decision.alias("decision"),
        F.when(c("o_orderpriority") != "5-LOW", clip).alias("clip_ids"),
    )
    return P.validate_feasibility(rows, t.clip_tags.where("energy <> 'low'"))


TERMS = ["the", "tion", "secret", "of", "example.com", "entre"]


@query(
    "p18_redaction_hits",
    f"""WITH x AS (SELECT doc_id, lower(text) AS low, unnest({TERMS}) AS term FROM documents),
    h AS (SELECT doc_id, term, CASE WHEN length(term) > 3 THEN (length(low) - length(replace(low, term, ''))) // length(term) ELSE (length(' ' || low || ' ') - length(replace(' ' || low || ' ', ' ' || term || ' ', ''))) // (length(term) + 2) END AS hits FROM x)
    SELECT doc_id, term, hits FROM h WHERE hits > 0""",
)
def _(t):
    return P.redaction_hits(t.documents.select("doc_id", "text"), TERMS, "doc_id", "text", deal="doc_id")  # the table is one split


@view
def caption_states(q: Dialect) -> str:
    return f"""SELECT l_suppkey AS asset, l_partkey AS id, {q.day('l_shipdate')} AS start_frame, {q.day('l_shipdate')} + cast(l_quantity as bigint) - 3 AS end_frame, cast(l_quantity as bigint) - 3 + cast(round(l_tax * 100) as int) % 2 AS frames,
      l_returnflag AS style_id, l_linenumber AS z, cast(round(l_discount * 1000) as int) AS x0, cast(round(l_tax * 1000) as int) AS y0, 60 + cast(l_quantity as int) AS w, 40 + l_linenumber AS h, cast(round(l_discount * 100) as int) % 3 - 1 AS pad FROM {q.t('lineitem')}"""


@query(
    "p19_validate_states",
    """WITH st AS (SELECT s_suppkey AS asset, unnest(['A', 'N']) AS style_id FROM supplier), j AS (SELECT s.*, st.asset IS NOT NULL AS known FROM caption_states s LEFT JOIN st USING (asset, style_id)),
    v AS (SELECT asset, id, unnest([CASE WHEN end_frame <= start_frame THEN 'empty_span' END, CASE WHEN frames <> end_frame - start_frame THEN 'wrong_frames' END, CASE WHEN end_frame > 2400 THEN 'past_clock' END, CASE WHEN w - 70 <= 0 OR h <= 0 THEN 'empty_box' END,
      CASE WHEN pad < 0 THEN 'box_outside_treatment' END, CASE WHEN NOT known THEN 'undeclared_style' END]) AS violation FROM j)
    SELECT asset, id::VARCHAR AS id, violation FROM v WHERE violation IS NOT NULL UNION ALL SELECT asset, id::VARCHAR, 'duplicate_id' FROM caption_states GROUP BY asset, id HAVING count(*) > 1
    UNION ALL SELECT s_suppkey, 'N', 'inherits_undeclared' FROM supplier""",
)
def _(t):
    s = t.caption_states
    x1, y1 = c("x0") + c("w") - 70, c("y0") + c("h")
    states = s.select(
        "asset", c("id").cast("string").alias("id"), "start_frame", "end_frame", "frames", "style_id", F.array("x0", "y0", x1, y1).alias("core_box"),
        F.array(c("x0") - c("pad"), c("y0") - c("pad"), x1 + c("pad"), y1 + c("pad")).alias("treatment_box"),
    )
    style = lambda name, parent: F.struct(F.lit(name).alias("style_id"), F.lit(parent).cast("string").alias("inherits"))
    styles = t.supplier.select(c("s_suppkey").alias("asset"), F.explode(F.array(style("A", None), style("N", "Z"))).alias("s")).select("asset", "s.*")
    return P.validate_states(states, styles, t.supplier.select(c("s_suppkey").alias("asset"), F.lit(2400).alias("frame_count")))
