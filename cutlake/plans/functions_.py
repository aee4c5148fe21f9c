"""Scalar functions (F) and naming rules (P3, P5-P8, P10-P14, P17, P20, P21) on the driver's tables."""

from pyspark.sql import functions as F

from cutlake.functions import color as C
from cutlake.functions import rules as R
from cutlake.functions import text as X
from cutlake.functions import timecode as T
from cutlake.plans.base import Dialect, query, view

c = F.col


@view
def receipt_names(q: Dialect) -> str:
    return f"""SELECT o_orderkey AS id, o_custkey, concat(
      CASE WHEN o_orderstatus = 'P' THEN 'reel' ELSE 'reel-0' END, cast({q.div('o_custkey', '20')} as string), '-',
      CASE o_orderpriority WHEN '1-URGENT' THEN concat('fix', cast(l as string), '-INDEP-AUDIT')
        WHEN '2-HIGH' THEN concat('fix_', cast(l as string), '-cut')
        WHEN '3-MEDIUM' THEN CASE o_orderstatus WHEN 'F' THEN 'cast-lock' WHEN 'O' THEN 'broadcast-build' ELSE 'cardfix' END
        WHEN '4-NOT SPECIFIED' THEN CASE o_orderstatus WHEN 'F' THEN 'superseded-audit' WHEN 'O' THEN 'study' ELSE 'intake' END
        ELSE CASE o_orderstatus WHEN 'F' THEN 'feasibility' WHEN 'O' THEN 'Delivery' ELSE 'notes' END END, '.md') AS name
      FROM (SELECT *, {q.div('o_totalprice', '4000')} AS l FROM {q.t('orders')}) x"""


@view
def state_texts(q: Dialect) -> str:
    return f"""SELECT o_orderkey AS id, concat(
      CASE o_orderstatus WHEN 'F' THEN 'APPROVED_HELD_FOR_OPERATOR' WHEN 'O' THEN 'V007' ELSE 'AWAITING_OPERATOR_LOOK_APPROVAL' END, '__',
      CASE o_orderpriority WHEN '1-URGENT' THEN 'LOCAL_REVIEW_READY' WHEN '2-HIGH' THEN 'PARKED' WHEN '3-MEDIUM' THEN 'no render until APPROVED'
        WHEN '4-NOT SPECIFIED' THEN 'RECAST_V012' ELSE 'IN_BUILD' END, '__PENDING — the note says APPROVED. more') AS state
      FROM {q.t('orders')}
      UNION ALL
      SELECT -1 - c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN '' WHEN 'BUILDING' THEN 'INTAKE_ORDERED' WHEN 'HOUSEHOLD' THEN 'PUBLISHED. Done'
        WHEN 'FURNITURE' THEN 'OPEN_CALL' ELSE 'RENDERING' END FROM {q.t('customer')}"""


@view
def part_files(q: Dialect) -> str:
    return f"""SELECT p_partkey AS id, concat(CASE WHEN p_size < 20 THEN '/vol/masters/' WHEN p_size < 30 THEN concat('day 3', chr(92)) ELSE '' END,
      CASE WHEN p_type IN ('SMALL', 'PROMO') THEN 'ab12__' ELSE '' END,
      CASE WHEN p_brand < 'Brand#2' THEN 'CLIP_' WHEN p_brand < 'Brand#4' THEN 'IMG_' ELSE 'take.' END,
      lpad(cast(p_partkey as string), 5, '0'),
      CASE WHEN p_size > 40 THEN '' WHEN p_type = 'LARGE' THEN '.mov' WHEN p_type = 'MEDIUM' THEN '.tar' ELSE '.MP4' END) AS path
      FROM {q.t('part')}"""


@query("f1_normalize_text", "SELECT doc_id, sha256(regexp_replace(replace(lower(text), 'ß', 'ss'), '[^0-9a-z]+', '', 'g')) AS digest FROM documents")
def _(t):
    return t.documents.select("doc_id", "text").select("doc_id", F.sha2(X.normalize_text(c("text")), 256).alias("digest"))


@query(
    "f2_project_id",
    r"""WITH s AS (SELECT page_id, url, coalesce(nullif(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)', 1), ''), url) AS path FROM pages),
    b AS (SELECT *, regexp_extract(regexp_replace(path, '/+$', ''), '([^/]*)$', 1) AS base FROM s),
    k AS (SELECT *, CASE WHEN regexp_matches(base, '^.+\.[^.]+$') THEN regexp_replace(base, '\.[^.]*$', '') ELSE base END AS stem FROM b)
    SELECT page_id, nullif(regexp_extract(url, '/(?:reel|reels|p|tv)/([A-Za-z0-9_-]+)', 1), '') AS shortcode,
      'reel-' || coalesce(nullif(lower(regexp_extract(url, '/(?:reel|reels|p|tv)/([A-Za-z0-9_-]+)', 1)), ''),
      nullif(lower(regexp_replace(regexp_replace(stem, '[^A-Za-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')), '')) || '-v1' AS project FROM k""",
)
def _(t):
    return t.pages.select("page_id", X.shortcode(c("url")).alias("shortcode"), X.project_id(c("url")).alias("project"))


CALL_TEXT = """SELECT o_orderkey AS id, CASE o_orderpriority
  WHEN '1-URGENT' THEN 'Keep it? 1 = keep, 2 = cut; 3 = ask again'
  WHEN '2-HIGH' THEN 'Pick one: (a) left or (b) right, and (a) again'
  WHEN '3-MEDIUM' THEN 'The clip runs long. Trim it 1. at the head 2. at the tail'
  WHEN '4-NOT SPECIFIED' THEN 'Order 2 = second only' ELSE concat('Note on ', o_orderstatus) END AS text FROM {orders}"""


@view
def call_texts(q: Dialect) -> str:
    return CALL_TEXT.replace("{orders}", q.t("orders"))


@query(
    "f3_parse_options",
    """SELECT id, CASE text[1:4] WHEN 'Keep' THEN 'Keep it? ' WHEN 'Pick' THEN 'Pick one: ' WHEN 'The ' THEN 'The clip runs long. Trim it ' ELSE text END AS prefix,
    CASE text[1:4] WHEN 'Keep' THEN '1:keep|2:cut|3:ask again' WHEN 'Pick' THEN 'a:left|b:right, and (a) again'
      WHEN 'The ' THEN '1:at the head|2:at the tail' ELSE '' END AS options FROM call_texts""",
)
def _(t):
    found = t.call_texts.select("id", X.parse_options(c("text")).alias("o"))
    shown = F.array_join(F.transform("o.options", lambda o: F.concat(o["n"], F.lit(":"), o["label"])), "|")
    return found.select("id", "o.prefix", shown.alias("options"))


@query(
    "f4_question_sentence",
    """SELECT id, CASE text[1:4] WHEN 'Keep' THEN 'Keep it?' WHEN 'Pick' THEN 'Pick one — which one?' WHEN 'The ' THEN 'The clip runs long — which one?'
    ELSE text || ' — what is your call?' END AS question FROM call_texts""",
)
def _(t):
    found = t.call_texts.select("id", X.parse_options(c("text")).alias("o"))
    return found.select("id", X.question_sentence(c("o.prefix"), F.size("o.options") > 0).alias("question"))


@query(
    "f5_parse_iso",
    "SELECT event_id, date_trunc('second', ts) AS parsed, date_trunc('minute', ts) AS short, CAST(NULL AS TIMESTAMP) AS bad FROM events",
)
def _(t):
    whole = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    out = lambda x, name: T.parse_iso(x).cast("timestamp_ntz").alias(name)
    return t.events.select(
        "event_id", out(whole, "parsed"), out(F.date_format("ts", "yyyy-MM-dd HH:mm"), "short"), out(F.concat(F.lit("2024-13-"), F.substring(whole, 9, 8)), "bad")
    )


@query("f6_frame_seconds", "SELECT event_id, (extract(minute FROM ts)::DOUBLE * 60 + extract(second FROM ts)::DOUBLE) AS seconds FROM events")
def _(t):
    return t.events.select("event_id", T.frame_seconds(F.concat(F.lit("f1 @ "), F.date_format("ts", "m:ss"), F.lit(".000 — clip"))).alias("seconds"))


@query("f7_local_label", "SELECT event_id, '~' || strftime(ts + INTERVAL 9 HOUR, '%-I:%M ') || lower(strftime(ts + INTERVAL 9 HOUR, '%p')) AS label FROM events")
def _(t):
    return t.events.select("event_id", T.local_label(c("ts"), "Asia/Tokyo").alias("label"))


@query(
    "f8_required_source_frames",
    """SELECT p_partkey AS id, greatest(1, (p_size::BIGINT * 30000 * 1 + 1001 * 24 - 1) // (1001 * 24)) AS ntsc,
    greatest(1, (p_size::BIGINT * 25 + 24 - 1) // 24) AS pal FROM part""",
)
def _(t):
    need = lambda n, d: T.required_source_frames(c("p_size"), F.lit(n), F.lit(d), 24, 1)
    return t.part.select(c("p_partkey").alias("id"), need(30000, 1001).alias("ntsc"), need(25, 1).alias("pal"))


@view
def swatches(q: Dialect) -> str:
    return f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 5 AS r, l_discount * 2500 AS g, l_tax * 3000 AS b,
      l_extendedprice / 500 AS level FROM {q.t('lineitem')}"""


LIN = "CASE WHEN {x} / 255.0 <= 0.04045 THEN {x} / 255.0 / 12.92 ELSE pow(({x} / 255.0 + 0.055) / 1.055, 2.4) END"


@query(
    "f9_luma_contrast",
    f"""WITH y AS (SELECT *, 0.2126 * r + 0.7152 * g + 0.0722 * b AS luma,
      0.2126 * ({LIN.format(x='r')}) + 0.7152 * ({LIN.format(x='g')}) + 0.0722 * ({LIN.format(x='b')}) AS rel FROM swatches)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(luma, 6) AS luma, round(rel, 6) AS relative,
      round(abs(luma - level) / greatest(luma + level, 1e-6), 6) AS michelson, round((greatest(rel, 0.5) + 0.05) / (least(rel, 0.5) + 0.05), 6) AS ratio FROM y""",
)
def _(t):
    rel, luma = C.relative_luminance(c("r"), c("g"), c("b")), C.luma(c("r"), c("g"), c("b"))
    return t.swatches.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(luma, 6).alias("luma"), F.round(rel, 6).alias("relative"),
        F.round(C.michelson(luma, c("level")), 6).alias("michelson"), F.round(C.contrast_of(rel, F.lit(0.5)), 6).alias("ratio"),
    )


@query(
    "f10_worst_over_surfaces",
    """WITH d AS (SELECT *, 0.6e0 * level + 0.4e0 * r AS v FROM swatches)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(v, 6) AS delivered,
      round(least(abs(v - r) / greatest(v + r, 1e-6), abs(level - g) / greatest(level + g, 1e-6)), 6) AS worst,
      round(least(abs(v - r), abs(level - g)), 6) AS gap FROM d""",
)
def _(t):
    surface = lambda a, core, ring: F.struct(F.lit(a).alias("alpha"), core.alias("core"), ring.alias("ring"))
    both = F.array(surface(0.6, c("r"), c("r")), surface(1.0, c("g"), c("g")))
    return t.swatches.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        F.round(C.delivered_luma(c("level"), F.lit(0.6), c("r")), 6).alias("delivered"),
        F.round(C.worst_over_surfaces(c("level"), both), 6).alias("worst"),
        F.round(C.worst_over_surfaces(c("level"), both, "separation"), 6).alias("gap"),
    )


@query(
    "f11_bounded_grade",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      round(greatest(-1.5, least(1.0, log2(greatest(l_tax, 1e-4) / greatest(l_discount, 1e-4)))), 4) AS exposure_stops,
      round(greatest(0.75, least(1.30, greatest(l_quantity / 50 - l_tax, 1e-4) / greatest(0.9 - l_discount, 1e-4))), 4) AS contrast,
      round(greatest(0.75, least(1.30, greatest(l_tax, 1e-4) / greatest(l_quantity / 50, 1e-4))), 4) AS saturation FROM lineitem""",
)
def _(t):
    source = {"y_q10": c("l_discount"), "y_q50": c("l_discount"), "y_q90": F.lit(0.9), "saturation": c("l_quantity") / 50}
    target = {"y_q10": c("l_tax"), "y_q50": c("l_tax"), "y_q90": c("l_quantity") / 50, "saturation": c("l_tax")}
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", C.bounded_grade(source, target).alias("g")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "g.*"
    )


@query(
    "f12_hue",
    """WITH h AS (SELECT l_suppkey, l_quantity * 7 AS a, l_discount * 3600 AS b FROM lineitem),
    m AS (SELECT l_suppkey, sum(round(sin(radians(a)), 12)) AS s, sum(round(cos(radians(a)), 12)) AS k,
      sum(((b - a + 180) % 360 + 360) % 360 - 180) AS d, count(*) AS n FROM h GROUP BY 1)
    SELECT l_suppkey, n, round(d, 4) AS delta_sum, round((degrees(atan2(s, k)) % 360 + 360) % 360, 4) AS mean_hue FROM m""",
)
def _(t):
    hues = t.lineitem.select("l_suppkey", (c("l_quantity") * 7).alias("a"), (c("l_discount") * 3600).alias("b"))
    return hues.groupBy("l_suppkey").agg(
        F.count("*").alias("n"), F.round(F.sum(C.hue_delta(c("a"), c("b"))), 4).alias("delta_sum"), F.round(C.circular_mean(c("a")), 4).alias("mean_hue")
    )


@query(
    "f13_grade_reliable",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN 'NaN in percentiles' WHEN value / 500 < 0.06 THEN 'flat frame' ELSE 'ok' END AS reason FROM events""",
)
def _(t):
    p50 = F.when(c("event_type") == "error", F.lit(float("nan"))).otherwise(c("value"))
    return t.events.select("event_id", C.grade_reliable([p50], c("value") / 500, F.lit(0.0)).alias("reason"))


@query(
    "f14_recipe_hash",
    """SELECT doc_id, sha256('{"lang":"' || lang || '","n":' || n_chars || ',"none":null,"source":"' || source || '"}') AS digest FROM documents""",
)
def _(t):
    return t.documents.select("doc_id", R.recipe_hash({"source": c("source"), "lang": c("lang"), "none": F.lit(None).cast("string"), "n": c("n_chars")}).alias("digest"))


@query(
    "f15_rescore",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'FAIL' WHEN o_orderpriority = '5-LOW' THEN 'UNMEASURABLE'
    WHEN o_totalprice / 300000 < 0.8 THEN 'FAIL' ELSE 'PASS' END AS verdict FROM orders""",
)
def _(t):
    ratio = F.when(c("o_orderpriority") != "5-LOW", c("o_totalprice") / 300000)
    return t.orders.select("o_orderkey", R.rescore(F.when(c("o_orderstatus") == "F", "FAIL").otherwise("PASS"), ratio).alias("verdict"))


@query(
    "f16_mood_adjust",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
      round(greatest(-0.22, least(0.18, (r - level) / 255.0 * 0.70)), 3) AS brightness,
      round(greatest(0.80, least(1.50, CASE WHEN g > 1 THEN 1.0 + (b / g - 1.0) * 0.70 ELSE 1.0 END)), 3) AS saturation,
      (CASE WHEN r - level < -25 THEN 0.95 ELSE 1.0 END)::DOUBLE AS gamma FROM swatches""",
)
def _(t):
    return t.swatches.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", C.mood_adjust(c("level"), c("g"), c("r"), c("b")).alias("m")).select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "m.*"
    )


BASE = r"regexp_extract(path, '([^/]*)$', 1)"


@query(
    "p3_name_forms",
    rf"""WITH b AS (SELECT id, {BASE} AS base FROM part_files),
    f AS (SELECT id, base, CASE WHEN contains(base, '__') THEN regexp_replace(base, '^.*?__', '') ELSE base END AS tail FROM b),
    u AS (SELECT id, unnest([base, tail, regexp_replace(base, '\.[^.]*$', ''), regexp_replace(tail, '\.[^.]*$', '')]) AS form FROM f)
    SELECT DISTINCT id, form FROM u""",
)
def _(t):
    return t.part_files.select("id", F.explode(R.name_forms(c("path"))).alias("form"))


@query(
    "p5_normalise_clip_id",
    r"""WITH b AS (SELECT id, regexp_extract(replace(path, '\', '/'), '([^/]*)$', 1) AS base FROM part_files)
    SELECT id, regexp_replace(regexp_replace(base, '^.*__', ''), '(?i)\.(mp4|mov|mxf|m4v)$', '') AS clip FROM b""",
)
def _(t):
    return t.part_files.select("id", R.normalise_clip_id(c("path")).alias("clip"))


@query(
    "p6_master_id",
    r"""WITH b AS (SELECT id, regexp_replace(regexp_extract(replace(path, '\', '/'), '([^/]*)$', 1), '\.[^.]*$', '') AS stem FROM part_files)
    SELECT id, nullif(regexp_extract(stem, '(?:^|[/_])((?:CLIP_\d{4})|(?:CAM_\d{4})|(?:C\d{4,5})|(?:IMG_\d{3,5}))(?:\.[A-Za-z0-9]+)?$', 1), '') AS master FROM b""",
)
def _(t):
    return t.part_files.select("id", R.master_id(c("path")).alias("master"))


@query(
    "p7_phase_of",
    r"""WITH n AS (SELECT id, name, replace(lower(name), '_', '-') AS low FROM receipt_names)
    SELECT id, CASE WHEN contains(low, 'superseded') THEN NULL WHEN contains(low, 'audit') THEN 'audit'
      WHEN contains(low, 'cardfix') OR contains(low, 'deliver') THEN 'deliver'
      WHEN regexp_matches(low, 'fix[-_ ]?(\d+)') THEN 'fix' WHEN contains(low, 'study') THEN 'study' WHEN contains(low, 'intake') THEN 'intake'
      WHEN contains(low, 'feasibility') THEN 'feasibility' WHEN regexp_matches(low, '(^|[^a-z])cast([^a-z]|$)') THEN 'cast'
      WHEN contains(low, 'build') THEN 'build' END AS phase,
      try_cast(nullif(regexp_extract(low, 'fix[-_ ]?(\d+)', 1), '') AS INTEGER) AS fix_round,
      try_cast(nullif(regexp_extract(lower(name), '^reel[-_ ]?0*(\d+)', 1), '') AS INTEGER) AS sequence FROM n""",
)
def _(t):
    n = c("name")
    return t.receipt_names.select("id", R.phase_of(n).alias("phase"), R.fix_round_of(n).alias("fix_round"), R.sequence_of(n).alias("sequence"))


@query(
    "p8_order_priority",
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' AND o_orderstatus = 'F' THEN 1 WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 2
    WHEN o_orderpriority = '3-MEDIUM' THEN 3 WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 4 ELSE 9 END::BIGINT AS priority FROM orders""",
)
def _(t):
    kinds = F.create_map(*[F.lit(x) for x in ("1-URGENT", "feedback", "2-HIGH", "frame-note", "3-MEDIUM", "continue", "4-NOT SPECIFIED", "drop", "5-LOW", "smoketest")])
    return t.orders.select("o_orderkey", R.order_priority(kinds[c("o_orderpriority")], F.when(c("o_orderstatus") == "F", "Reject")).cast("long").alias("priority"))


def _has(scope: str, words: list[str]) -> str:
    return f"regexp_matches({scope}, '(^|[^A-Z0-9])({'|'.join(words)})([^A-Z0-9]|$)')"


TOKEN = r"""tok AS (SELECT id, CASE WHEN trim(coalesce(state, '')) = '' THEN 'NO REVIEW STATE' ELSE trim(split_part(split_part(trim(state), ' — ', 1), '. ', 1)) END AS token FROM state_texts),
seg AS (SELECT *, list_filter(string_split(token, '__')[1:3], lambda s: NOT regexp_matches(trim(s), '[\sa-z]')) AS machine,
  CASE WHEN regexp_matches(trim(string_split(token, '__')[1]), '[\sa-z]') THEN '' ELSE upper(string_split(token, '__')[1]) END AS head,
  upper(array_to_string(list_filter(string_split(token, '__')[2:3], lambda s: NOT regexp_matches(trim(s), '[\sa-z]')), '  ')) AS rest FROM tok),
scoped AS (SELECT *, upper(array_to_string(machine, '  ')) AS scope,
  array_to_string(list_filter(string_split(upper(token), '__')[1:3], lambda s: NOT regexp_matches(trim(s), '\s')), '  ') AS any_case,
  CASE WHEN """ + _has("head", R.VERDICT_WORDS + R.DONE_WORDS + R.COLD_WORDS) + """ THEN head ELSE rest END AS basis FROM seg),
laned AS (SELECT *, CASE WHEN """ + _has("basis", R.VERDICT_WORDS) + " AND NOT " + _has("basis", R.DONE_WORDS) + " AND NOT " + _has("basis", R.COLD_WORDS) + """ THEN 'verdict'
  WHEN """ + _has("basis", R.DONE_WORDS) + " THEN 'done' ELSE 'machine' END AS lane FROM scoped)"


@query("p10_lane_of", f"WITH {TOKEN} SELECT id, token, lane FROM laned")
def _(t):
    tokened = t.state_texts.select("id", R.state_token(c("state")).alias("token"))
    return tokened.select("id", "token", R.lane_of(c("token")).alias("lane"))


@query(
    "p11_plain_state",
    f"""WITH {TOKEN} SELECT id, CASE WHEN token = '' OR upper(token) = 'NO REVIEW STATE' THEN 'In progress'
    WHEN {_has('any_case', R.QUESTION_WORDS)} THEN 'The factory has a question for you' WHEN {_has('any_case', R.POSTED_WORDS)} THEN 'Posted'
    WHEN {_has('any_case', R.PARKED_WORDS)} THEN 'Parked' WHEN {_has('any_case', R.APPROVED_WORDS)} AND {_has('any_case', R.HELD_WORDS)} THEN 'Approved — held for you'
    WHEN {_has('any_case', R.APPROVED_WORDS)} THEN 'Approved' WHEN {_has('any_case', R.NEWCUT_WORDS)} AND {_has('any_case', R.NEWCUT_CONTEXT)} THEN 'New version ready'
    WHEN {_has('any_case', R.WATCH_WORDS)} THEN 'Ready for you to watch' WHEN {_has('any_case', R.QUEUED_WORDS)} THEN 'Queued — being planned'
    WHEN {_has('any_case', R.BUILDING_WORDS)} THEN 'Being built' WHEN lane = 'done' THEN 'Done' ELSE 'In progress' END AS phrase,
    CASE phrase WHEN 'The factory has a question for you' THEN 'amber' WHEN 'Posted' THEN 'green' WHEN 'Approved — held for you' THEN 'amber' WHEN 'Approved' THEN 'green' WHEN 'New version ready' THEN 'blue' WHEN 'Ready for you to watch' THEN 'blue' WHEN 'Done' THEN 'green' ELSE 'grey' END AS color,
    'v' || lpad(nullif(regexp_extract(upper(token), '(?:^|[^A-Z0-9])V(\\d{{1,3}})(?:[^0-9]|$)', 1), ''), 3, '0') AS version FROM laned""",
)
def _(t):
    tokened = t.state_texts.select("id", R.state_token(c("state")).alias("token"))
    return tokened.select("id", R.plain_card(c("token"), R.lane_of(c("token"))).alias("card")).select("id", "card.*")


@query(
    "p12_beat_class",
    "WITH x AS (SELECT doc_id, lower(text) AS low FROM documents) SELECT doc_id, array_to_string(list_filter(["
    + ", ".join(f"CASE WHEN regexp_matches(low, '{p}') THEN '{n}' END" for n, p in R.BEATS)
    + f"], lambda b: b IS NOT NULL), ',') AS beats, list_filter([{', '.join(f'''CASE WHEN regexp_matches(low, '{p}') THEN '{n}' END''' for n, p in R.BEATS)}], lambda b: b IS NOT NULL)[1] AS primary_beat, regexp_matches(low, '{R.NIGHT}') AS night FROM x",
)
def _(t):
    beats = t.documents.select("doc_id", "text").select("doc_id", R.beat_class(c("text")).alias("b"), R.is_night_text(c("text"), F.lit(None).cast("string")).alias("night"))
    return beats.select("doc_id", F.array_join("b", ",").alias("beats"), F.try_element_at("b", F.lit(1)).alias("primary_beat"), "night")


@query(
    "p13_auto_triage",
    rf"""WITH s AS (SELECT event_id, CASE event_type WHEN 'signup' THEN 'smoketest of the bus' WHEN 'click' THEN 'Passed, fully proven' WHEN 'view' THEN 'PASS but still owed'
      WHEN 'error' THEN 'HARD-1 caption cut' ELSE 'keep the pace' END AS text, CASE WHEN value > 40 THEN 'audit-verdict' ELSE 'operator-note' END AS kind, strftime(ts, '%Y%m%d') AS day FROM events)
    SELECT event_id, CASE WHEN regexp_matches(text, '{R.PLUMBING}') THEN 'plumbing test, not a signal'
      WHEN kind = 'audit-verdict' AND regexp_matches(text, '{R.PASSING}') AND NOT regexp_matches(text, '{R.NEGATIVE}') THEN 'a pass teaches nothing'
      WHEN day < '20240115' THEN 'pre-loop backlog (before 20240115)' END AS triage FROM s""",
)
def _(t):
    said = F.create_map(
        *[F.lit(x) for x in ("signup", "smoketest of the bus", "click", "Passed, fully proven", "view", "PASS but still owed", "error", "HARD-1 caption cut", "purchase", "keep the pace")]
    )
    kind = F.when(c("value") > 40, "audit-verdict").otherwise("operator-note")
    source = F.concat(F.lit("ui-"), F.date_format("ts", "yyyyMMdd"), F.lit(".md"))
    return t.events.select("event_id", R.auto_triage(said[c("event_type")], kind, source, "20240115").alias("triage"))


@query(
    "p14_variant_version",
    """WITH n AS (SELECT p_partkey AS id, p_size, p_type FROM part)
    SELECT id, CASE WHEN p_type IN ('SMALL', 'PROMO', 'LARGE', 'MEDIUM') AND p_size BETWEEN 1 AND 99 THEN p_size END AS variant,
      CASE WHEN p_type IN ('PROMO', 'STANDARD') THEN p_size END AS version FROM n""",
)
def _(t):
    n, two = c("p_size").cast("string"), F.lpad(c("p_size").cast("string"), 2, "0")
    name = (
        F.when(c("p_type") == "SMALL", F.concat(F.lit("08 v"), two, F.lit(" — x.mp4")))
        .when(c("p_type") == "PROMO", F.concat(F.lit("TRIAL VARIANT "), two, F.lit(" (v"), n, F.lit(" WHITE INK).mp4")))
        .when(c("p_type") == "LARGE", F.concat(F.lit("TRIAL VARIANTS BATCH 02 — v"), two, F.lit(" — code")))
        .when(c("p_type") == "MEDIUM", F.concat(F.lit("cast_var"), n, F.lit(".json")))
        .when(c("p_type") == "STANDARD", F.concat(F.lit("review (v"), n, F.lit(").mp4")))
        .otherwise("TRIAL VARIANTS BATCH 01")
    )
    return t.part.select(c("p_partkey").alias("id"), R.variant_of(name).alias("variant"), R.version_of(name).alias("version"))


@query(
    "p17_caption_clearance",
    """WITH w AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount * 1000 AS p05, 150 + l_quantity * 2 AS p95, round(255.0 - 25.0 / (0.4 + l_tax), 2) AS hi, round(25.0 / (0.4 + l_tax), 2) AS lo FROM lineitem)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p95 < hi OR p05 > lo AS servable,
      concat_ws(',', CASE WHEN p95 < hi THEN 'light_ink' END, CASE WHEN p05 > lo THEN 'dark_ink' END) AS polarities, round(greatest(hi - p95, p05 - lo), 2) AS margin FROM w""",
)
def _(t):
    v = R.caption_clearance(c("l_discount") * 1000, c("l_quantity") * 2 + 150, c("l_tax") + 0.4)
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    return t.lineitem.select(*keys, v.alias("v")).select(*keys, "v.servable", F.array_join("v.polarities", ",").alias("polarities"), "v.margin")


@query(
    "p20_text_plausibility",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat_ws(',', CASE WHEN NOT (l_discount BETWEEN 0.06 AND 0.80) THEN 'fill_ratio' END,
      CASE WHEN NOT (l_quantity / 10 BETWEEN 0.30 * l_linenumber AND 1.80 * l_linenumber) THEN 'aspect_per_glyph' END,
      CASE WHEN l_quantity > 3.0 * greatest(l_linenumber * 2, 1) THEN 'components_per_glyph' END) AS reasons FROM lineitem""",
)
def _(t):
    n = c("l_linenumber")
    why = R.text_plausibility(c("l_discount"), c("l_quantity") / 10, c("l_quantity"), n, n * 2, F.lit(1))
    return t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(why, ",").alias("reasons"))


@query(
    "p21_card_bucket",
    f"""WITH {TOKEN} SELECT id, CASE WHEN id < -500 THEN 'machine' WHEN id BETWEEN -100 AND 100 THEN 'needs_you' WHEN {_has('scope', R.COLD_WORDS)} THEN 'parked'
    WHEN lane = 'verdict' THEN 'needs_you' WHEN lane = 'done' THEN 'done' ELSE 'machine' END AS bucket FROM laned""",
)
def _(t):
    tokened = t.state_texts.select("id", R.state_token(c("state")).alias("token"))
    scope = F.upper(F.array_join(R._segments(c("token")), "  "))
    calls = F.when(c("id").between(-100, 100), 1).otherwise(0)
    return tokened.select("id", R.card_bucket(c("id") < -500, calls, R.has_word(scope, R.COLD_WORDS), R.lane_of(c("token"))).alias("bucket"))
