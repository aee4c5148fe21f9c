"""Chain and status queries."""

from pyspark.sql import functions as F

from cutlake.operators import lineage as L
from cutlake.plans.base import Dialect, query, view

c = F.col


@view
def stage_receipts(q: Dialect) -> str:
    """All orders of a customer in date order: each run of fourteen is a project's stage receipts; a few are broken on purpose."""
    ident = q.sha("concat(p, '|', cast(i as string), '|', cast(o_orderkey as string))")
    return f"""SELECT p AS project, i AS stage_idx, o_orderkey, CASE WHEN o_totalprice > 480000 THEN 'FAIL' WHEN o_totalprice < 16000 THEN 'PENDING' ELSE 'PASS' END AS status, {ident} AS receipt_id,
      CASE WHEN i > 0 THEN CASE WHEN o_totalprice > 470000 THEN 'x' ELSE lag({ident}) OVER (PARTITION BY p ORDER BY i) END END AS predecessor_id, o_orderpriority AS receipt_sha256, CASE WHEN o_totalprice > 460000 THEN 'y' ELSE o_orderpriority END AS actual_sha256,
      o_orderstatus AS art, CASE WHEN o_totalprice > 450000 THEN 'z' ELSE o_orderstatus END AS art_now, o_totalprice > 440000 AS changed
      FROM (SELECT *, concat(cast(o_custkey as string), '-', cast({q.div('k', '14')} as string)) AS p, k % 14 AS i FROM (SELECT *, cast(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) - 1 AS bigint) AS k FROM {q.t('orders')}) x) y"""


CHAIN = """lc AS (SELECT *, lag(receipt_id) OVER w AS pv FROM stage_receipts WINDOW w AS (PARTITION BY project ORDER BY stage_idx)),
fa AS (SELECT *, CASE WHEN status <> 'PASS' THEN 'not_pass' WHEN receipt_sha256 <> actual_sha256 THEN 'receipt_changed' WHEN CASE WHEN stage_idx = 0 THEN predecessor_id IS NOT NULL ELSE predecessor_id IS DISTINCT FROM pv END THEN 'linkage_invalid'
  WHEN art <> art_now THEN 'artifact_changed' END AS fault FROM lc), vc AS (SELECT project, stage_idx, status, fault, bool_and(fault IS NULL) OVER (PARTITION BY project ORDER BY stage_idx) AS valid FROM fa)"""


def _verified(t):
    s = t.stage_receipts
    artifacts = s.select("project", "stage_idx", c("art").alias("sha256"), c("art_now").alias("actual_sha256"))
    return L.verify_chain(s, artifacts, L.receipt_id([c("project"), c("stage_idx"), c("o_orderkey")]))


@query("l1_verify_chain", f"WITH {CHAIN} SELECT * FROM vc")
def _(t):
    return _verified(t)


@query("l2_next_stage", f"WITH {CHAIN} SELECT project, coalesce(min(stage_idx) FILTER (NOT valid), CASE WHEN max(stage_idx) < 13 THEN max(stage_idx) + 1 END) AS next_stage FROM vc GROUP BY 1")
def _(t):
    return L.next_stage(_verified(t))


@query(
    "l3_stale_cascade",
    """SELECT project, stage_idx, CASE WHEN coalesce(bool_or(changed) OVER (PARTITION BY project ORDER BY stage_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AND status <> 'PENDING' THEN 'STALE' ELSE status END AS new_status FROM stage_receipts""",
)
def _(t):
    return L.stale_cascade(t.stage_receipts).select("project", "stage_idx", "new_status")


STAGE_LIST = "[" + ", ".join(f"'{s}'" for s in L.STAGES) + "]"
LAYER_ROWS = ", ".join(f"('{a}', '{b}')" for a, b in L.LAYERS)


@query(
    "l4_layer_status",
    f"""WITH {CHAIN}, ly(layer, stage) AS (VALUES {LAYER_ROWS}), st AS (SELECT project, {STAGE_LIST}[stage_idx + 1] AS stage, status, valid FROM vc), ev AS (SELECT c_custkey || '-0' AS project, 'colour_grade_proof' AS layer, 'WITHHELD' AS status FROM customer WHERE c_mktsegment = 'MACHINERY'),
    ca AS (SELECT c_custkey || '-0' AS project, CASE c_mktsegment WHEN 'BUILDING' THEN 'render' END AS layer, CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'VISUAL_QC' WHEN 'FURNITURE' THEN 'odd' END AS call_stage FROM customer WHERE c_mktsegment IN ('BUILDING', 'HOUSEHOLD', 'FURNITURE') AND c_acctbal > 0),
    pr AS (SELECT c_custkey || '-0' AS project FROM customer UNION SELECT project FROM stage_receipts), r AS (SELECT project, ly.*, list_position({STAGE_LIST}, stage) - 1 AS pos FROM pr, ly),
    o AS (SELECT r.*, CASE WHEN st.status = 'PASS' THEN CASE WHEN valid THEN 'PROVEN' ELSE 'FAILED' END WHEN st.status = 'FAIL' THEN 'FAILED' ELSE 'PENDING_MACHINE' END AS own, ev.status AS e FROM r LEFT JOIN st USING (project, stage) LEFT JOIN ev USING (project, layer)),
    s AS (SELECT *, ['FAILED', 'PENDING_MACHINE', 'WITHHELD', 'PENDING_HUMAN', 'PROVEN'] AS sv FROM o), w AS (SELECT *, sv[least(list_position(sv, own), coalesce(list_position(sv, e), 9))] AS weak FROM s)
    SELECT project, layer, stage, CASE WHEN weak = 'PENDING_MACHINE' AND ((layer = 'human_approval' AND EXISTS (SELECT 1 FROM st WHERE st.project = w.project AND st.stage = 'LOCAL_REVIEW_READY' AND valid)) OR (layer = 'delivery_approval' AND EXISTS (SELECT 1 FROM st WHERE st.project = w.project AND st.stage = 'HUMAN_APPROVED' AND valid))
      OR EXISTS (SELECT 1 FROM ca WHERE ca.project = w.project AND (ca.layer = w.layer OR (ca.layer IS NULL AND w.pos >= coalesce(list_position({STAGE_LIST}, call_stage) - 1, 0))))) THEN 'PENDING_HUMAN' ELSE weak END AS status FROM w""",
)
def _(t):
    stages = _verified(t).select("project", F.element_at(F.array(*[F.lit(s) for s in L.STAGES]), (c("stage_idx") + 1).cast("int")).alias("stage"), "status", "valid")
    segment = c("c_mktsegment")
    first = F.concat(c("c_custkey").cast("string"), F.lit("-0")).alias("project")
    evidence = t.customer.where(segment == "MACHINERY").select(first, F.lit("colour_grade_proof").alias("layer"), F.lit("WITHHELD").alias("status"))
    calls = t.customer.where(segment.isin("BUILDING", "HOUSEHOLD", "FURNITURE")).select(
        first, F.when(segment == "BUILDING", "render").alias("layer"), F.when(segment == "HOUSEHOLD", "VISUAL_QC").when(segment == "FURNITURE", "odd").alias("call_stage"),
        F.when(c("c_acctbal") <= 0, "ANSWERED").when(c("c_acctbal") > 5000, "awaiting_operator").alias("state"),
    )
    return L.layer_status(t.customer.select(first).union(t.stage_receipts.select("project")).distinct(), stages, evidence, calls)


@query(
    "l5_ownership",
    """WITH r AS (SELECT o_orderkey AS ordinal, CASE WHEN o_totalprice > 300000 THEN 'Reel-' || o_custkey || '-v1' END AS root, ' R' || o_custkey || ' ' AS code, CASE o_orderpriority WHEN '1-URGENT' THEN 'legacy runner' ELSE 'kit' END AS runtime, CASE o_orderpriority WHEN '2-HIGH' THEN 'QUARANTINED__X' ELSE 'OK' END AS rs, CASE o_orderstatus WHEN 'F' THEN ' Agent' ELSE 'daemon' END AS driver FROM orders),
    p AS (SELECT ordinal, coalesce(root, 'reel-r' || trim(lower(code))[2:] || '-v1') AS project, CASE WHEN contains(upper(runtime), 'LEGACY') THEN 'runtime is ' || runtime WHEN contains(rs, 'QUARANTINED') THEN 'review_state is ' || rs WHEN lower(trim(driver)) = 'agent' THEN 'driver is agent' END AS reason, code FROM r)
    SELECT project, arg_max(reason IS NULL, ordinal) AS daemon_owned, arg_max((reason, 1), ordinal)[1] AS reason, arg_max(code, ordinal) AS shortcode FROM p GROUP BY 1""",
)
def _(t):
    o = t.orders
    registry = o.select(
        c("o_orderkey").alias("ordinal"), F.when(c("o_totalprice") > 300000, F.concat(F.lit("Reel-"), c("o_custkey").cast("string"), F.lit("-v1"))).alias("project_root"), F.concat(F.lit(" R"), c("o_custkey").cast("string"), F.lit(" ")).alias("shortcode"),
        F.when(c("o_orderpriority") == "1-URGENT", "legacy runner").otherwise("kit").alias("runtime"), F.when(c("o_orderpriority") == "2-HIGH", "QUARANTINED__X").otherwise("OK").alias("review_state"),
        F.when(c("o_orderstatus") == "F", " Agent").otherwise("daemon").alias("driver"),
    )
    projects = t.customer.select(F.concat(F.lit("reel-r"), c("c_custkey").cast("string"), F.lit("-v1")).alias("project"))
    return L.ownership(registry, projects)


@query(
    "l6_input_fingerprint",
    """WITH b AS (SELECT o_custkey AS project, sha256(o_orderkey || chr(31) || o_orderstatus) AS d FROM orders),
    n AS (SELECT project, count(*) AS n, sum(('0x' || d[1:15])::HUGEINT) AS a, sum(('0x' || d[16:30])::HUGEINT) AS b, sum(('0x' || d[31:45])::HUGEINT) AS c, sum(('0x' || d[46:60])::HUGEINT) AS e FROM b GROUP BY 1)
    SELECT project, sha256(concat_ws(':', n, a, b, c, e)) AS fingerprint FROM n""",
)
def _(t):
    return L.input_fingerprint(t.orders.select(c("o_custkey").alias("project"), c("o_orderkey").cast("string").alias("path"), c("o_orderstatus").alias("state")))
