"""Source and sink queries (S1-S17) over text that Spark derives from the given tables."""

from pyspark.sql import functions as F

from cutlake.plans.base import Dialect, query, view
from cutlake.sources import catalog as C
from cutlake.sources import plan_docs as D
from cutlake.sources import receipts as R
from cutlake.sources import sinks as K

c = F.col
lit = F.lit


@query(
    "s1_read_catalog",
    """SELECT 'src/' || doc_id AS path, 'D' || doc_id AS clip_id, n_chars / 100 AS duration_s, lang AS motion_label, source AS label, CASE WHEN lang = 'en' THEN 'fam1,hall' ELSE 'plain' END AS families FROM documents""",
)
def _(t):
    family = F.when(c("lang") == "en", '[{"family_id": "fam1", "description": "hall"}]').otherwise('["plain"]')
    label = F.when(c("lang") == "fr", F.concat(lit('["'), "source", lit('"]'))).otherwise(F.concat(lit('[{"label": "'), "source", lit('", "confidence": 0.5}]')))
    line = F.concat(
        lit('{"path": "src/'), c("doc_id").cast("string"), lit('", "clip_id": "D'), c("doc_id").cast("string"), lit('", "duration_s": '), (c("n_chars") / 100).cast("string"),
        lit(', "camera_motion": {"label": "'), "lang", lit('"}, "top_visual_labels": '), label, lit(', "duplicate_or_setup_families": '), family, lit("}"),
    )
    lines = t.documents.select(F.explode(F.array(line, lit("  "))).alias("value"))
    rows = C.parse_catalog(lines)
    return rows.select("path", "clip_id", "duration_s", "motion_label", F.element_at("labels", 1).alias("label"), F.array_join("families", ",").alias("families"))


@query(
    "s2_read_feature_table",
    "SELECT 'p' || o_custkey AS path, arg_max(o_totalprice, o_orderkey) AS luma_p50, arg_max(o_orderkey, o_orderkey)::DOUBLE AS sat_p50 FROM orders GROUP BY 1",
)
def _(t):
    # One document per customer, its orders as the rows of one path in key order.
    rec = F.concat(lit('{"path": "p'), c("o_custkey").cast("string"), lit('", "luma_p50": '), c("o_totalprice").cast("decimal(18,2)").cast("string"), lit(', "sat_p50": '), c("o_orderkey").cast("string"), lit("}"))
    docs = t.orders.select("o_custkey", F.struct("o_orderkey", rec.alias("r")).alias("s")).groupBy("o_custkey").agg(F.array_sort(F.collect_list("s")).alias("rs"))
    joined = F.array_join(F.transform("rs", lambda s: s["r"]), ", ")
    body = F.when(c("o_custkey") % 2 == 0, F.concat(lit("["), joined, lit("]"))).otherwise(F.concat(lit('{"features": ['), joined, lit("]}")))
    return C.parse_features(docs.select(body.alias("value"))).select("path", "luma_p50", "sat_p50")


@query(
    "s3_read_ledger",
    "SELECT event_id, 'CLIP_' || user_id AS stem, CASE event_type WHEN 'view' THEN 'NEVER' END AS grade, CASE WHEN value > 30 THEN value END AS t0 FROM events WHERE event_type NOT IN ('error', 'signup')",
)
def _(t):
    grade = F.when(c("event_type") == "view", ', "grade": "NEVER"').otherwise("")
    start = F.when(c("value") > 30, F.concat(lit(', "t0": '), c("value").cast("string"))).otherwise("")
    whole = F.concat(lit('{"stem": "CLIP_'), c("user_id").cast("string"), lit('"'), grade, start, lit("}"))
    line = F.when(c("event_type") == "error", F.substring(whole, 1, 9)).when(c("event_type") == "signup", lit('{"grade": "HERO"}')).otherwise(whole)
    return C.parse_ledger(t.events.select("event_id", line.alias("value"))).select("event_id", "stem", "grade", "t0")


@query(
    "s4_explode_library",
    """SELECT 'c' || p_partkey AS clip_id, p_name AS name, CASE WHEN p_type = 'SMALL' THEN 'UNTAGGED' WHEN p_type = 'PROMO' THEN 'UNTAGGED' ELSE p_brand END AS world FROM part""",
)
def _(t):
    tags = F.when(c("p_type") == "SMALL", "null").when(c("p_type") == "PROMO", '{"world_cluster": "  "}').otherwise(F.concat(lit('{"world_cluster": "'), "p_brand", lit('"}')))
    doc = F.concat(lit('{"clips": {"c'), c("p_partkey").cast("string"), lit('": {"name": "'), "p_name", lit('", "tags": '), tags, lit("}}}"))
    return C.explode_library(t.part.select(doc.alias("value"))).select("clip_id", "name", "world")


def _receipts(t):
    """One receipt per order: header lines, an ACK with a status, and for some a later head without one."""
    at = F.date_format("o_orderdate", "yyyy-MM-dd'T'00:00:00'Z'")
    kind = F.when(c("o_orderpriority") == "1-URGENT", "feedback").when(c("o_orderpriority") == "2-HIGH", "frame-note").when(c("o_orderpriority") == "3-MEDIUM", "drop").otherwise("other")
    row = F.lpad((c("o_custkey") % 90).cast("string"), 2, "0")
    bare = (kind == "drop") & (c("o_custkey") % 2 == 0)  # a batch order: its row stands in the body, its time is the file's
    name = F.when(bare, F.concat(lit("ui-drop-"), c("o_orderkey").cast("string"), lit(".md"))).otherwise(F.concat(lit("ui-"), kind, lit("-row"), row, lit("-"), F.date_format("o_orderdate", "yyyyMMdd"), lit("T010203Z.md")))
    head = F.concat(lit("ACK — "), F.lower("o_orderstatus"), lit("-lane — "), at, lit(" — "), F.when(c("o_orderstatus") == "F", "finished").otherwise("picked up"), lit(": go"))
    block = F.concat(lit('<!--status {"v":1,"state":"'), F.when(c("o_orderstatus") == "F", "finished").otherwise("queued"), lit('","why":"disk"} -->'))
    later = F.when(c("o_totalprice") > 300000, F.concat(lit("\nCALL — boss — "), at, lit(" — keep it? 1 = yes, 2 = no\nnote\n"), block)).otherwise("")
    text = F.concat(lit("Disposition: "), F.when(c("o_orderstatus") == "P", "REJECT").otherwise("NOTES"), lit("\nSent by: x ("), F.when(c("o_orderstatus") == "O", "EDITOR").otherwise("OPERATOR"), lit(")\n"), F.when(bare, F.concat(lit("ORDER: build a 10-variant alternate batch for registry row "), (c("o_custkey") % 90).cast("string"), lit(".\n"))).otherwise(""), head, lit("\n"), block, later)
    return t.orders.select("o_orderkey", name.alias("name"), text.alias("text"), (c("o_orderdate") + F.make_dt_interval(days=lit(1))).alias("modified"))


RECEIPTS = """rc AS (SELECT o_orderkey, CASE o_orderpriority WHEN '1-URGENT' THEN 'feedback' WHEN '2-HIGH' THEN 'frame-note' WHEN '3-MEDIUM' THEN 'drop' END AS kind, CASE WHEN o_orderpriority = '3-MEDIUM' AND o_custkey % 2 = 0 THEN 'ui-drop-' || o_orderkey || '.md' ELSE 'ui-' || CASE o_orderpriority WHEN '1-URGENT' THEN 'feedback' WHEN '2-HIGH' THEN 'frame-note' WHEN '3-MEDIUM' THEN 'drop' END || '-row' || lpad((o_custkey % 90)::VARCHAR, 2, '0')
  || '-' || strftime(o_orderdate, '%Y%m%d') || 'T010203Z.md' END AS receipt, CASE WHEN o_orderpriority = '3-MEDIUM' AND o_custkey % 2 = 0 THEN o_orderdate + INTERVAL 1 DAY ELSE o_orderdate::DATE + INTERVAL 3723 SECOND END AS sent, o_custkey, o_orderstatus, o_totalprice, o_orderdate FROM orders WHERE o_orderpriority < '4')"""


@query(
    "s5_parse_receipts",
    f"""WITH {RECEIPTS} SELECT receipt, kind, sent, (o_custkey % 90)::INTEGER AS row, CASE o_orderstatus WHEN 'P' THEN 'REJECT' ELSE 'NOTES' END AS disposition, CASE o_orderstatus WHEN 'O' THEN 'editor' ELSE 'operator' END AS author, 0::BIGINT AS seq, 'ACK' AS head, lower(o_orderstatus) || '-lane' AS lane,
      strftime(o_orderdate, '%Y-%m-%dT00:00:00Z') AS at, CASE o_orderstatus WHEN 'F' THEN 'finished' ELSE 'queued' END AS state FROM rc
    UNION ALL SELECT receipt, kind, sent, (o_custkey % 90)::INTEGER, CASE o_orderstatus WHEN 'P' THEN 'REJECT' ELSE 'NOTES' END, CASE o_orderstatus WHEN 'O' THEN 'editor' ELSE 'operator' END, 1, 'CALL', 'boss', strftime(o_orderdate, '%Y-%m-%dT00:00:00Z'), NULL FROM rc WHERE o_totalprice > 300000""",
)
def _(t):
    return R.receipt_events(R.parse_receipts(_receipts(t), modified="modified")).withColumn("sent", c("sent").cast("timestamp_ntz")).select("receipt", "kind", "sent", "row", "disposition", "author", "seq", "head", "lane", "at", "state")


@query(
    "s6_status_blocks",
    f"""WITH {RECEIPTS} SELECT receipt, o_totalprice <= 300000 AS structured, CASE WHEN o_totalprice > 300000 THEN 'called' WHEN o_orderstatus = 'F' THEN 'finished' ELSE 'queued' END AS state FROM rc""",
)
def _(t):
    return R.status_blocks(R.parse_receipts(_receipts(t))).select("receipt", "structured", "state")


@query(
    "s7_parse_call_cards",
    """SELECT conv_id, turn, 0 AS card, conv_id || '-' || turn AS call_id, 'block a block b' AS reference_block, role AS stage, trim(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS what_i_found, 'A:keep it going|B:drop' AS options, 'e1' AS evidence FROM conversations
    UNION ALL SELECT conv_id, turn, 1, 'second', NULL, NULL, NULL, '', '' FROM conversations WHERE role = 'user'""",
)
def _(t):
    name = F.concat(c("conv_id").cast("string"), lit("-"), c("turn").cast("string"))
    first = F.concat(
        lit("intro\n```\nCALL_REQUIRED\ncall_id: "), name, lit("\nreference_block: block a\n   block b\nstage: "), "role", lit("\n\nWHAT I FOUND:\n"), "text",
        lit("\n\nEVIDENCE:\n- e1\n\nOPTIONS:\nA. keep it\n   going\nB. drop\n```\nafter\n"),
    )
    text = F.concat(first, F.when(c("role") == "user", lit("```\nCALL_REQUIRED\ncall_id: second\n```\n")).otherwise(""))
    files = t.conversations.select(F.struct("conv_id", "turn").alias("k"), text.alias("text"))
    cards = R.parse_call_cards(files, "k")
    shown = F.array_join(F.transform("options", lambda o: F.concat(o["key"], lit(":"), o["text"])), "|")
    return cards.select("k.conv_id", "k.turn", "card", "call_id", "reference_block", "stage", "what_i_found", shown.alias("options"), F.array_join("evidence", ",").alias("evidence"))


def _json_slot(t, key: str):
    num = lambda x: c(x).cast("string")
    master = F.concat(lit("/m/ab__CLIP_"), F.lpad((c("l_partkey") % 10000).cast("string"), 4, "0"), lit(".MP4"))
    slot = F.when(c("l_returnflag") == "A", F.concat(lit('"block_id": "p'), num("l_linenumber"), lit('"'))).when(c("l_returnflag") == "N", F.concat(lit('"slot": '), num("l_linenumber"))).otherwise('"x": 1')
    return F.concat(lit("{"), slot, lit(', "'), lit(key), lit('": "'), master, lit('", "note": "CLIP_0001"}')), master


@query(
    "s8_flatten_plan",
    """SELECT l_orderkey * 1000000 + l_partkey AS plan, 0 AS index, CASE l_returnflag WHEN 'A' THEN 'p' || l_linenumber WHEN 'N' THEN 'slot' || lpad(l_linenumber::VARCHAR, 3, '0') ELSE 'idx000' END AS slot, 'CLIP_' || lpad((l_partkey % 10000)::VARCHAR, 4, '0') AS master FROM lineitem""",
)
def _(t):
    record, _ = _json_slot(t, "source_path")
    doc = F.when(c("l_linestatus") == "F", F.concat(lit('{"slots": [], "shots": ['), record, lit("]}"))).otherwise(F.concat(lit("["), record, lit("]")))
    plans = t.lineitem.select((c("l_orderkey") * 1000000 + c("l_partkey")).alias("plan"), doc.alias("value"))
    return D.flatten_plan(plans, "plan", deal=True).select("plan", "index", "slot", F.array_join("masters", ",").alias("master"))


@query(
    "s9_flatten_supersession",
    """SELECT l_orderkey * 1000000 + l_partkey AS plan, CASE WHEN l_linenumber < 3 THEN 's' || l_linenumber WHEN l_linenumber < 5 THEN 'b9' WHEN l_linenumber = 5 THEN CASE l_returnflag WHEN 'A' THEN 'p5' WHEN 'N' THEN 'slot005' ELSE 'idx000' END ELSE 'b7' END AS slot, 'CLIP_' || lpad((l_partkey % 10000)::VARCHAR, 4, '0') AS master_id FROM lineitem""",
)
def _(t):
    record, master = _json_slot(t, "source")
    n = c("l_linenumber")
    now = F.concat(lit('{"recast": {"s'), n.cast("string"), lit('": {"was": {"source": "CLIP_9999"}, "now": {"source": "'), master, lit('"}}}}'))
    seat = F.concat(lit('{"reseated": {"s'), n.cast("string"), lit('": {"file": "'), master, lit('"}}}'))
    installed = F.concat(lit('{"block_id": "b9", "removed": {"file": "CLIP_9999"}, "installed": {"source_path": "'), master, lit('"}}'))
    listed = F.concat(lit('{"slots": ['), record, lit("]}"))
    flat = F.concat(lit('{"block": "b7", "source_path": "'), master, lit('", "runner_ups": ["CLIP_9999"]}'))
    doc = F.when(n == 1, now).when(n == 2, seat).when(n < 5, installed).when(n == 5, listed).otherwise(flat)
    return D.flatten_supersession(t.lineitem.select((c("l_orderkey") * 1000000 + c("l_partkey")).alias("plan"), doc.alias("value")), "plan")


@query(
    "s10_normalise_states",
    """SELECT o_orderkey AS contract, CASE WHEN o_orderstatus = 'F' THEN 'S00' ELSE 'k1' END AS id, o_orderpriority AS text, o_custkey AS start, CASE WHEN o_orderstatus <> 'P' THEN o_custkey + 9 END AS end_exclusive, CASE WHEN o_orderstatus = 'O' THEN 3.0::DOUBLE ELSE 1.0::DOUBLE END AS x0, 'st' AS style_id FROM orders""",
)
def _(t):
    key, end = c("o_custkey").cast("string"), (c("o_custkey") + 9).cast("string")
    one = F.concat(lit('{"schema": 1, "states": [{"text": "'), "o_orderpriority", lit('", "start_frame": '), key, lit(', "end_frame_exclusive": '), end, lit(', "placement": {"core_bbox_xyxy": [1, 2, 3, 4]}, "style_id": "st"}]}'))
    two = F.concat(lit('{"k1": {"text": "'), "o_orderpriority", lit('", "start": '), key, lit(', "end": '), end, lit(', "box": [3, 2, 3, 4], "style": "st"}, "meta": {"a": 1}}'))
    three = F.concat(lit('{"states": {"k1": {"text": "'), "o_orderpriority", lit('", "start": '), key, lit(', "placement": {"core_bbox_xyxy": [1, 2, 3, 4]}, "style_id": "st"}}}'))
    doc = F.when(c("o_orderstatus") == "F", one).when(c("o_orderstatus") == "O", two).otherwise(three)
    states = D.normalise_states(t.orders.select(c("o_orderkey").alias("contract"), doc.alias("value")), "contract")
    return states.select("contract", "id", "text", "start", "end_exclusive", F.element_at("box", 1).alias("x0"), "style_id")


LISTING = """ls AS (SELECT p_partkey AS path, p_brand AS sha256 FROM part), pr AS (SELECT p_partkey AS path, CASE WHEN p_size < 10 THEN 'old' ELSE p_brand END AS sha256, p_retailprice AS duration_s, CASE WHEN p_size > 45 THEN 'FAIL' ELSE 'PASS' END AS status FROM part WHERE p_type <> 'LARGE')"""


def _listing(t):
    listing = t.part.select(c("p_partkey").alias("path"), c("p_brand").alias("sha256"))
    prior = t.part.where("p_type <> 'LARGE'").select(
        c("p_partkey").alias("path"), F.when(c("p_size") < 10, "old").otherwise(c("p_brand")).alias("sha256"), c("p_retailprice").alias("duration_s"), F.when(c("p_size") > 45, "FAIL").otherwise("PASS").alias("status")
    )
    return listing, prior


@query("s11_incremental_index", f"WITH {LISTING} SELECT ls.path, ls.sha256, pr.duration_s, pr.status, pr.path IS NOT NULL AS reused FROM ls LEFT JOIN pr USING (path, sha256)")
def _(t):
    return C.incremental_index(*_listing(t)).select("path", "sha256", "duration_s", "status", "reused")


@query("s11_work_list", f"WITH {LISTING} SELECT path, sha256 FROM ls EXCEPT SELECT path, sha256 FROM pr")
def _(t):
    return C.work_list(*_listing(t))


@query(
    "s12_index_manifest",
    f"WITH {LISTING}, m AS (SELECT pr.status AS s FROM ls LEFT JOIN pr USING (path)) SELECT count(*) AS expected, count(s) AS probed, count(*) FILTER (s = 'PASS') AS passed, count(*) FILTER (s = 'FAIL') AS failed, count(*) FILTER (s IS NULL) AS missing, CASE WHEN count(*) FILTER (s = 'PASS') = count(*) THEN 'PASS' ELSE 'FAIL' END AS status FROM m",
)
def _(t):
    return C.index_manifest(*_listing(t))


@query(
    "s13_latest_activity",
    """WITH e AS (SELECT conv_id % 40 AS run, conv_id AS file, TIMESTAMP '2026-01-01' + to_seconds(conv_id * 97) AS mtime, turn, CASE WHEN turn = 1 THEN 'role: ' || role || ' on row ' || (conv_id % 7) || ' ' WHEN turn = 2 THEN 'row 99 ' ELSE '' END || coalesce(text, '') AS text, CASE WHEN role = 'assistant' THEN 'tool' || turn END AS tool FROM conversations),
    n AS (SELECT run, max((mtime, file)) AS n, count(DISTINCT file) - 1 AS restarts FROM e GROUP BY 1), l AS (SELECT e.*, restarts, epoch(TIMESTAMP '2026-01-01 13:00:00' - e.mtime) AS age FROM e JOIN n ON n.run = e.run AND n.n[2] = e.file WHERE epoch(TIMESTAMP '2026-01-01 13:00:00' - e.mtime) <= 100000),
    f AS (SELECT run, any_value(mtime) AS mtime, any_value(age) AS age, any_value(restarts) AS restarts, arg_min(try_cast(nullif(regexp_extract(text, '(?i)\\brow\\s*#?(\\d+)', 1), '') AS INTEGER), turn) AS row, arg_min(nullif(upper(trim(regexp_extract(text, '(?i)\\brole:\\s*([a-z-]+)', 1))), ''), turn) AS role,
      arg_max(tool, turn) FILTER (tool IS NOT NULL) AS tool FROM l GROUP BY 1)
    SELECT row, arg_max(run, (mtime, run)) AS run, arg_max(coalesce(role, 'LANE'), (mtime, run)) AS role, arg_max((tool, 1), (mtime, run))[1] AS tool, arg_max(restarts, (mtime, run)) AS restarts, round(arg_max(age, (mtime, run)), 1) AS age_s, arg_max(age <= 45000, (mtime, run)) AS alive FROM f WHERE row IS NOT NULL GROUP BY 1""",
)
def _(t):
    mtime = lit("2026-01-01").cast("timestamp_ntz") + F.make_dt_interval(secs=(c("conv_id") * 97).cast("decimal(18,6)"))
    text = F.concat(F.when(c("turn") == 1, F.concat(lit("role: "), "role", lit(" on row "), (c("conv_id") % 7).cast("string"), lit(" "))).when(c("turn") == 2, "row 99 ").otherwise(""), F.coalesce("text", lit("")))
    entries = t.conversations.select(
        (c("conv_id") % 40).alias("run"), c("conv_id").alias("file"), mtime.alias("mtime"), c("turn").alias("seq"), text.alias("text"), F.when(c("role") == "assistant", F.concat(lit("tool"), c("turn").cast("string"))).alias("tool"), lit(None).cast("timestamp").alias("ts")
    )
    found = R.latest_activity(entries, lit("2026-01-01 13:00:00").cast("timestamp_ntz"), alive_seconds=45_000, fresh_seconds=100_000)
    return found.select("row", "run", "role", "tool", "restarts", "age_s", "alive")


@query(
    "s14_check_status",
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'unknown_state' WHEN o_orderpriority = '2-HIGH' AND o_orderstatus = 'F' THEN 'why_required' WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 300000 THEN 'call_too_long'
      WHEN o_orderpriority = '1-URGENT' AND o_orderstatus <> 'O' THEN 'call_without_options' END AS fault FROM orders""",
)
def _(t):
    p = c("o_orderpriority")
    state = F.when(p == "1-URGENT", "called").when(p == "2-HIGH", "queued").when(p == "4-NOT SPECIFIED", "odd").otherwise("running")
    text = F.concat(lit("keep?"), F.when(c("o_orderstatus") == "O", " 1 = yes, (2) no").otherwise(" 1 = yes, 3 = no"), F.when(c("o_totalprice") > 300000, F.repeat(lit(" long"), 70)).otherwise(""))
    lines = t.orders.select("o_orderkey", state.alias("state"), text.alias("text"), F.when(c("o_orderstatus") != "F", "disk").alias("why"))
    return K.check_status(lines).select("o_orderkey", "fault")


@query(
    "s15_patch_rows",
    """WITH d AS (SELECT c_custkey AS sequence, count(*) OVER (PARTITION BY c_custkey) AS n, c_mktsegment AS m, c_name FROM customer UNION ALL SELECT s_suppkey, 1, 'DUP', s_name FROM supplier WHERE s_suppkey < 5),
    k AS (SELECT *, count(*) OVER (PARTITION BY sequence) AS cnt FROM d)
    SELECT sequence, m, CASE WHEN sequence % 2 = 0 AND cnt = 1 AND sequence % 3 > 0 THEN 'new' ELSE 'old' END AS state, CASE WHEN sequence % 2 = 0 AND cnt = 1 AND sequence % 3 > 0 THEN 'x' END AS added,
      CASE WHEN sequence % 2 = 0 THEN CASE WHEN cnt > 1 THEN 'row_not_unique' WHEN sequence % 3 = 0 THEN 'key_exists' END END AS fault FROM k""",
)
def _(t):
    fields = F.create_map(lit("state"), lit("old"), lit("keep"), lit("1"))
    base = t.customer.select(c("c_custkey").alias("sequence"), c("c_mktsegment").alias("m"), fields.alias("fields")).unionByName(t.supplier.where("s_suppkey < 5").select(c("s_suppkey").alias("sequence"), lit("DUP").alias("m"), fields.alias("fields")))
    even = t.customer.select(c("c_custkey").alias("sequence"), (c("c_custkey") % 2 == 0).alias("even")).where("even").drop("even")
    add = F.when(c("sequence") % 3 == 0, F.create_map(lit("keep"), lit("2"))).otherwise(F.create_map(lit("added"), lit("x")))
    patched = K.patch_rows(base, even.select("sequence", F.create_map(lit("state"), lit("new")).alias("set"), add.alias("add")))
    return patched.select("sequence", "m", F.try_element_at("fields", lit("state")).alias("state"), F.try_element_at("fields", lit("added")).alias("added"), "fault")


@query(
    "s16_harvest_signals",
    """WITH d AS (SELECT source, trim(regexp_replace(lang || ' note ' || coalesce(text, '') || ' ' || doc_id % 50, '\\s+', ' ', 'g')) AS a, 'clip ' || lang || '?' AS b, doc_id % 9 AS r FROM documents),
    r AS (SELECT source, 'note' AS kind, a AS text, r FROM d UNION ALL SELECT source, 'factory-CALL', b, r FROM d UNION ALL SELECT source, 'audit-HARD', 'HARD-1 cut late', r FROM d)
    SELECT source || '::' || kind || '::' || sha256(text) AS key, source, kind, text, min(r)::INTEGER AS row FROM r WHERE NOT (kind = 'factory-CALL' AND text = 'clip en?') GROUP BY source, kind, text""",
)
def _(t):
    doc = t.documents
    body = F.concat("lang", lit(" note  "), F.coalesce("text", lit("")), lit("\n"), (c("doc_id") % 50).cast("string"))
    text = F.concat(lit("row "), (c("doc_id") % 9).cast("string"), lit("\nOperator note (verbatim):\n"), body, lit("\n---\nCALL — clip "), "lang", lit("?\n- **HARD-1 cut late\n"))
    seen = doc.select(F.concat("source", lit("::factory-CALL::"), F.sha2(lit("clip en?"), 256)).alias("key")).distinct()
    return R.harvest_signals(doc.select("source", text.alias("text")), seen).select("key", "source", "kind", "text", "row")


@query(
    "s17_check_events",
    """SELECT event_id AS id, CASE WHEN value > 100 THEN 'Bad ' || event_type ELSE event_type END AS kind, '{"user_id":' || user_id || ',"event_type":"' || event_type || '"}' AS payload, value <= 100 AS accepted FROM events""",
)
def _(t):
    events = t.events.select(c("event_id").alias("id"), F.when(c("value") > 100, F.concat(lit("Bad "), "event_type")).otherwise(c("event_type")).alias("kind"), "user_id", "event_type")
    return K.check_events(events, ["user_id", "event_type"])
