"""Series and curve queries."""

from pyspark.sql import functions as F

from cutlake.operators import series as X
from cutlake.functions import timecode as T
from cutlake.plans.base import Dialect, query, view

c = F.col
KEY = ["asset"]


@view
def hops(q: Dialect) -> str:
    return f"""SELECT event_type AS asset, cast(row_number() OVER (PARTITION BY event_type ORDER BY h) - 1 AS bigint) AS hop, energy, flux
      FROM (SELECT event_type, date_trunc('hour', ts) AS h, round(sum(value), 2) AS energy, round(max(value), 2) AS flux FROM {q.t('events')} GROUP BY event_type, date_trunc('hour', ts)) x"""


@view
def supplier_days(q: Dialect) -> str:
    return f"""SELECT l_suppkey AS asset, {q.div(q.day('l_shipdate'), '7')} AS frame, round(max(l_quantity), 2) AS a, round(min(l_quantity), 2) AS b, round(max(l_discount) * 100) AS d, count(*) AS n
      FROM {q.t('lineitem')} GROUP BY l_suppkey, {q.div(q.day('l_shipdate'), '7')}"""


BH = "sqrt(greatest(0.0, 1 - (sqrt(pa * a) + sqrt(pb * b) + sqrt(pd * d)) / sqrt((pa + pb + pd) * (a + b + d))))"
SCORES = f"""sp AS (SELECT *, lag(a) OVER w AS pa, lag(b) OVER w AS pb, lag(d) OVER w AS pd FROM supplier_days WINDOW w AS (PARTITION BY asset ORDER BY frame)),
sc AS (SELECT asset, frame, 0.55 * (a / 500) + 0.45 * {BH} AS score FROM sp WHERE pa IS NOT NULL)"""


def _scores(t):
    frames = t.supplier_days.select("asset", "frame", F.array("a", "b", "d").alias("hist"), (c("a") / 500).alias("lab"))
    return X.cut_scores(frames, KEY, "frame", "hist", "lab")


@query("w10_cut_scores", f"WITH {SCORES} SELECT asset, frame, round(score, 7) AS score FROM sc")
def _(t):
    return _scores(t).withColumn("score", F.round("score", 7))


def merged(src: str, gap: int, pos: str, height: str) -> str:
    """Recursive fold over the hits of ``src(asset, pos, height)``: ``kept`` holds one row per survivor."""
    return f"""o AS (SELECT asset, {pos} AS p, {height} AS h, row_number() OVER (PARTITION BY asset ORDER BY {pos}) AS rn FROM {src}),
f AS (SELECT asset, rn, p AS lp, h AS lh, 1 AS grp FROM o WHERE rn = 1
  UNION ALL
  SELECT o.asset, o.rn, CASE WHEN o.p - f.lp >= {gap} OR o.h > f.lh THEN o.p ELSE f.lp END, CASE WHEN o.p - f.lp >= {gap} OR o.h > f.lh THEN o.h ELSE f.lh END, CASE WHEN o.p - f.lp >= {gap} THEN f.grp + 1 ELSE f.grp END
  FROM f JOIN o ON o.asset = f.asset AND o.rn = f.rn + 1),
kept AS (SELECT asset, arg_max(lp, rn) AS p, arg_max(lh, rn) AS h FROM f GROUP BY asset, grp)"""


@query(
    "w11_detect_cuts",
    f"""WITH RECURSIVE sc AS (SELECT asset, frame, CASE WHEN b >= 45 THEN a / 100 ELSE a / 5000 END AS score FROM supplier_days), m AS (SELECT asset, median(score) AS med, quantile_cont(score, 0.95) AS q95 FROM sc GROUP BY 1), dv AS (SELECT asset, median(abs(score - med)) AS mad FROM sc JOIN m USING (asset) GROUP BY 1),
    th AS (SELECT asset, greatest(0.115, med + 8 * greatest(mad, 0.002), least(0.35, q95 * 0.68)) AS t FROM m JOIN dv USING (asset)), hit AS (SELECT sc.* FROM sc JOIN th USING (asset) WHERE score >= t),
    {merged('hit', 3, 'frame', 'score')} SELECT asset, p AS frame, round(h, 7) AS score, round(t, 7) AS threshold FROM kept JOIN th USING (asset)""",
)
def _(t):
    spiky = t.supplier_days.select("asset", "frame", F.when(c("b") >= 45, c("a") / 100).otherwise(c("a") / 5000).alias("score"))
    return X.detect_cuts(spiky, KEY, "frame", "score").withColumns({"score": F.round("score", 7), "threshold": F.round("threshold", 7)})


@query(
    "w12_blocks_from_cuts",
    """WITH e AS (SELECT asset, frame AS b FROM supplier_days WHERE a >= 45 UNION SELECT asset, max(frame) + 19 FROM supplier_days GROUP BY 1), l AS (SELECT *, lag(b) OVER w AS p, row_number() OVER w AS i FROM e WINDOW w AS (PARTITION BY asset ORDER BY b))
    SELECT asset, 'p' || CASE WHEN i < 1000 THEN lpad(i::VARCHAR, 3, '0') ELSE i::VARCHAR END AS block_id, coalesce(p + 1, 0) AS start_frame, b + 1 AS end_frame FROM l""",
)
def _(t):
    clocks = t.supplier_days.groupBy("asset").agg((F.max("frame") + 20).alias("frame_count"))
    return X.blocks_from_cuts(clocks, t.supplier_days.where("a >= 45"), KEY, "frame", "frame_count")


ENV = """fe AS (SELECT asset, arg_min(flux, hop) AS f0, arg_max(flux, hop) AS f1, max(hop) AS hi FROM hops GROUP BY 1),
fl AS (SELECT h.asset, hop, flux, sum(flux) OVER (PARTITION BY h.asset ORDER BY hop RANGE BETWEEN 15 PRECEDING AND 15 FOLLOWING) + greatest(0, 15 - hop) * f0 + greatest(0, 15 - (hi - hop)) * f1 AS s FROM hops h JOIN fe USING (asset)),
er AS (SELECT asset, hop, greatest(0.0, flux - s / 31) AS e FROM fl), env AS (SELECT asset, hop, CASE WHEN max(e) OVER (PARTITION BY asset) > 0 THEN e / max(e) OVER (PARTITION BY asset) ELSE e END AS env FROM er)"""


def _env(t):
    return X.flux_envelope(t.hops.select("asset", "hop", "flux"), KEY, "hop", "flux", width=256)


@query("w13_flux_envelope", f"WITH {ENV} SELECT asset, hop, round(env, 7) AS env FROM env")
def _(t):
    return _env(t).select("asset", "hop", F.round("env", 7).alias("env"))


@query(
    "w14_pick_onsets",
    f"""WITH RECURSIVE {ENV}, nb AS (SELECT *, lag(env) OVER w AS l, lead(env) OVER w AS r FROM env WINDOW w AS (PARTITION BY asset ORDER BY hop)), hit AS (SELECT * FROM nb WHERE env >= l AND env > r AND env > 0.12),
    {merged('hit', 4, 'hop', 'env')} SELECT asset, p AS hop, round(h, 7) AS env FROM kept""",
)
def _(t):
    return X.pick_onsets(_env(t).select("asset", "hop", "env"), KEY, "hop", "env", width=256).withColumn("env", F.round("env", 7))


@query(
    "w15_energy_onsets",
    f"""WITH RECURSIVE nv AS (SELECT asset, hop, greatest(0.0, coalesce(energy - lag(energy) OVER (PARTITION BY asset ORDER BY hop), 0.0)) AS s FROM hops), m AS (SELECT asset, median(s) AS med FROM nv GROUP BY 1),
    dv AS (SELECT asset, med + 5 * greatest(median(abs(s - med)), 1e-5) AS t FROM nv JOIN m USING (asset) GROUP BY asset, med), nb AS (SELECT *, lag(s) OVER w AS l, lead(s) OVER w AS r FROM nv WINDOW w AS (PARTITION BY asset ORDER BY hop)),
    hit AS (SELECT nb.* FROM nb JOIN dv USING (asset) WHERE s >= t AND s >= l AND s >= r), {merged('hit', 5, 'hop', 's')} SELECT asset, p AS hop, round(h, 6) AS strength FROM kept""",
)
def _(t):
    return X.energy_onsets(t.hops.select("asset", "hop", "energy"), KEY, "hop", "energy", width=256).withColumn("strength", F.round("strength", 6))


@query(
    "w16_tempo",
    """WITH m AS (SELECT asset, avg(flux) AS m, count(*) AS n FROM hops GROUP BY 1), e AS (SELECT asset, hop, flux - m AS e, n FROM hops JOIN m USING (asset)),
    ac AS (SELECT a.asset, lag, sum(a.e * b.e) AS s, any_value(a.n) AS n FROM range(2, 24) r(lag) JOIN e a ON true JOIN e b ON b.asset = a.asset AND b.hop = a.hop - lag GROUP BY 1, 2),
    nb AS (SELECT *, lag(s) OVER w AS l, lead(s) OVER w AS r FROM ac WINDOW w AS (PARTITION BY asset ORDER BY lag)), pk AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY s DESC, lag) AS rank FROM nb WHERE lag BETWEEN 3 AND 21 AND lag < n - 1 AND s >= l AND s >= r)
    SELECT asset, rank, lag::INTEGER AS lag, round(600.0 / lag, 6) AS bpm, round(s, 3) AS strength FROM pk WHERE rank <= 8""",
)
def _(t):
    found = X.tempo(t.hops.select("asset", "hop", "flux"), KEY, "hop", "flux", rate=10.0, low=28.0, high=200.0, width=256)
    return found.withColumns({"bpm": F.round("bpm", 6), "strength": F.round("strength", 3)})


@query(
    "w17_grid_phase",
    """WITH o AS (SELECT asset, hop * 0.73 AS t FROM hops), g AS (SELECT asset, 60.0 / (7.1234567e0 + length(asset)) AS p, max(hop) * 0.73 AS e FROM hops GROUP BY 1),
    x AS (SELECT asset, t, p, e, i, i * (p / 200) AS ph, ceil((e - i * (p / 200)) / p) AS n FROM o JOIN g USING (asset), range(200) r(i)),
    s AS (SELECT asset, i, ph, n, count(*) FILTER (abs(t - ph - least(greatest(round_even((t - ph) / p, 0), 0), n - 1) * p) < p * 0.1) AS k FROM x WHERE n >= 2 GROUP BY 1, 2, 3, 4),
    b AS (SELECT *, row_number() OVER (PARTITION BY asset ORDER BY k DESC, i) AS rn FROM s) SELECT asset, round(ph, 7)::DOUBLE AS phase, k AS on_grid, round(k / n * 100, 1) AS hit_percent FROM b WHERE rn = 1""",
)
def _(t):
    onsets = t.hops.select("asset", (c("hop") * 0.73).alias("t"))
    grids = t.hops.groupBy("asset").agg((F.length("asset") + 7.1234567).alias("bpm"), (F.max("hop") * 0.73).alias("window_end"))
    return X.grid_phase(onsets, grids, KEY, "t").withColumn("phase", F.round("phase", 7))


@query(
    "w18_song_window",
    """WITH d AS (SELECT asset, (max(hop) + 1) * 0.125 AS dur FROM hops GROUP BY 1), s AS (SELECT asset, hop, sum(energy) OVER (PARTITION BY asset ORDER BY hop RANGE BETWEEN 4 PRECEDING AND 3 FOLLOWING) / 8 AS s FROM hops),
    l AS (SELECT *, coalesce(s - lag(s, 16) OVER (PARTITION BY asset ORDER BY hop), 0.0) AS lift FROM s), k AS (SELECT asset, hop, row_number() OVER (PARTITION BY asset ORDER BY round(lift, 9) DESC, hop) AS rn FROM l JOIN d USING (asset) WHERE hop * 0.125 > 3 + 2 AND hop * 0.125 < dur - (9 - 3) - 1)
    SELECT d.asset, round(coalesce(greatest(0.0, hop * 0.125 - 3), 0.0), 6)::DOUBLE AS start, round(hop * 0.125, 2)::DOUBLE AS drop FROM d LEFT JOIN k ON k.asset = d.asset AND rn = 1""",
)
def _(t):
    return X.song_window(t.hops.select("asset", "hop", "energy"), KEY, "hop", "energy", 0.125, need=9.0, hinge=3.0, width=256)


NIGHT = "(extract(hour FROM {0}) * 60 + extract(minute FROM {0}) >= 1125 OR extract(hour FROM {0}) * 60 + extract(minute FROM {0}) < 300)"
SCENES = f"""cl AS (SELECT user_id AS row, ts, event_id, CASE WHEN event_type IN ('click', 'view') THEN 'work' ELSE 'street' END AS fam, value / 20 AS dur, {NIGHT.format('ts')} AS night FROM events),
lg AS (SELECT *, lag(fam) OVER w AS pf, lag(night) OVER w AS pn, lag(ts) OVER w AS pt FROM cl WINDOW w AS (PARTITION BY row ORDER BY ts, event_id)),
sn AS (SELECT *, sum(CASE WHEN pt IS NULL OR pf <> fam OR pn <> night OR ts - pt >= INTERVAL 720 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY row ORDER BY ts, event_id) AS scene FROM lg),
sc AS (SELECT row, scene::BIGINT AS scene, min(fam) AS family, bool_and(night) AS night, min(ts) AS start, count(*) AS clips, sum(CASE WHEN dur < 3 THEN 1 ELSE 2 END)::BIGINT AS capacity, CAST(min(ts) - INTERVAL 5 HOUR AS DATE) AS story_day FROM sn GROUP BY 1, 2)"""


def _scenes(t):
    clip = t.events.select(c("user_id").alias("row"), "ts", "event_id", F.when(c("event_type").isin("click", "view"), "work").otherwise("street").alias("fam"), (c("value") / 20).alias("dur"))
    return X.scenes(clip, ["row"], "ts", "event_id", "fam", "dur", gap_minutes=720)


@query("w19_scenes", f"WITH {SCENES} SELECT * FROM sc")
def _(t):
    return _scenes(t)


@query("w20_story_day", f"SELECT event_id, CAST(ts - INTERVAL 5 HOUR AS DATE) AS story_day, {NIGHT.format('ts')} AS night FROM events")
def _(t):
    return t.events.select("event_id", T.story_day(c("ts")).alias("story_day"), T.is_night(c("ts")).alias("night"))


@query(
    "w21_display_clock",
    f"""WITH {SCENES}, e AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY start, scene) AS i, min(epoch_us(start)) OVER (PARTITION BY row) AS a, max(epoch_us(start)) OVER (PARTITION BY row) AS b FROM sc WHERE NOT night),
    m AS (SELECT *, floor((420 + (epoch_us(start) - a) / greatest(b - a, 1000000) * 630) / 10)::BIGINT * 10 - 10 * i AS x FROM e)
    SELECT row, scene, (max(x) OVER (PARTITION BY row ORDER BY start, scene) + 10 * i)::BIGINT AS display_minute FROM m""",
)
def _(t):
    return X.display_clock(_scenes(t).where("NOT night"), ["row"], "start", "scene").select("row", "scene", "display_minute")


@query(
    "w22_monotonic_audit",
    f"""WITH e AS (SELECT user_id AS row, event_id AS pos, ts + to_days((value::INTEGER % 3 - 1)::INTEGER) AS ts, value > 30 AS night FROM events), l AS (SELECT *, lag(ts) OVER w AS p, lag(night) OVER w AS pn FROM e WINDOW w AS (PARTITION BY row ORDER BY pos)),
    v AS (SELECT row, pos, unnest([CASE WHEN pn = night AND ts < p - INTERVAL 2 MINUTE AND CAST(p - INTERVAL 5 HOUR AS DATE) = CAST(ts - INTERVAL 5 HOUR AS DATE) THEN 'time_goes_backwards' END, CASE WHEN {NIGHT.format('ts')} <> night THEN 'wrong_side' END]) AS violation FROM l)
    SELECT * FROM v WHERE violation IS NOT NULL""",
)
def _(t):
    shift = F.make_dt_interval((F.rint(c("value")).cast("int") % 3 - 1))
    edl = t.events.select(c("user_id").alias("row"), c("event_id").alias("pos"), (c("ts") + shift).alias("ts"), (c("value") > 30).alias("night"))
    return X.monotonic_audit(edl, ["row"], "pos", "ts", "night")


@view
def entry_curve(q: Dialect) -> str:
    return f"""SELECT l_suppkey AS asset, l_linenumber AS state, l_returnflag AS part, cast(row_number() OVER (PARTITION BY l_suppkey, l_linenumber, l_returnflag ORDER BY l_shipdate, l_orderkey, l_partkey, l_quantity) AS bigint) AS n,
      CASE WHEN l_shipdate > timestamp '1997-06-01' THEN 0.45e0 + l_quantity / 90 ELSE l_quantity / 70 END AS fit, l_discount * 10 + 0.15e0 AS opacity, l_tax * 40 AS sigma_x, round(l_extendedprice / 30000, 4) AS sigma_y,
      0.7e0 + l_tax * 8 AS scale, 0.5e0 + l_tax * 6 AS contain, l_discount * 100 AS dx FROM {q.t('lineitem')}"""


CK = "asset, state, part"
CURVE_KEYS = ["asset", "state", "part"]
PRESENT = "(contain >= 0.6 AND scale BETWEEN 0.80 AND 1.30 AND opacity BETWEEN 0.22 AND 2.0 AND fit >= 0.55)"
ONSET = f"""cr AS (SELECT {CK}, n, {PRESENT} AS p, row_number() OVER w AS i, count(*) OVER (PARTITION BY {CK}) AS cn, sum(fit) OVER (PARTITION BY {CK} ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b, sum(fit) OVER (PARTITION BY {CK}) AS t, lead({PRESENT}) OVER w AS q
  FROM entry_curve WINDOW w AS (PARTITION BY {CK} ORDER BY n)),
cg AS (SELECT *, round((t - b) / (cn - (i - 1)), 9) AS af, round((t - b) / (cn - (i - 1)) - b / (i - 1), 9) AS g FROM cr),
cf AS (SELECT {CK}, min(n) AS n0, bool_and(p) FILTER (i <= 2) AS once, arg_max(n, (g, -n)) FILTER (i >= 2 AND af >= 0.55 AND p AND g > 0) AS bn, max(g) FILTER (i >= 2 AND af >= 0.55 AND p AND g > 0) AS bg, min(n) FILTER (p AND coalesce(q, true)) AS st FROM cg GROUP BY {CK}),
on_ AS (SELECT {CK}, CASE WHEN once THEN n0 WHEN bg >= 0.10 THEN bn ELSE st END AS landed, once AS at_once FROM cf),
wb AS (SELECT c.*, sigma_x + sigma_y AS s, lag(fit) OVER w AS pf, lag(opacity) OVER w AS po, lag(sigma_x + sigma_y) OVER w AS ps FROM entry_curve c WINDOW w AS (PARTITION BY {CK} ORDER BY n)),
wk AS (SELECT {CK}, max(wb.n) FILTER (pf IS NULL OR pf < greatest(0.25, 0.55 * lf) OR po > opacity + 0.03 OR ps < s - 0.6 OR po < 0.05) AS first_frame FROM wb JOIN (SELECT o.*, e.fit AS lf FROM on_ o JOIN entry_curve e USING ({CK}) WHERE e.n = o.landed AND NOT at_once) l USING ({CK}) WHERE wb.n <= landed GROUP BY {CK}),
ff AS (SELECT {CK}, CASE WHEN at_once THEN landed ELSE first_frame END AS first_frame FROM on_ LEFT JOIN wk USING ({CK})),
tl AS (SELECT *, row_number() OVER (PARTITION BY {CK} ORDER BY n DESC) AS d, count(*) OVER (PARTITION BY {CK}) AS cn FROM entry_curve),
fl AS (SELECT {CK}, median(sigma_x) AS floor_x, median(sigma_y) AS floor_y FROM tl WHERE d <= greatest(3, cn // 3) GROUP BY {CK}),
sf AS (SELECT {CK}, coalesce(min(n) FILTER (n >= first_frame AND sigma_x <= greatest(1.2, floor_x + 0.6) AND sigma_y <= greatest(1.2, floor_y + 0.6) AND opacity >= 0.6), max(n)) AS sharp_frame FROM entry_curve JOIN ff USING ({CK}) JOIN fl USING ({CK}) WHERE first_frame IS NOT NULL GROUP BY {CK})"""


@query("w27_entry_onset", f"WITH {ONSET} SELECT * FROM on_")
def _(t):
    return X.entry_onset(t.entry_curve, CURVE_KEYS)


@query("w28_walk_back", f"WITH {ONSET} SELECT * FROM ff")
def _(t):
    return X.first_frames(t.entry_curve, CURVE_KEYS)


@query("w29_sharp_frame", f"WITH {ONSET} SELECT {CK}, round(floor_x, 6) AS floor_x, round(floor_y, 6) AS floor_y, sharp_frame FROM fl LEFT JOIN sf USING ({CK})")
def _(t):
    return X.sharp_frames(t.entry_curve, CURVE_KEYS).withColumns({"floor_x": F.round("floor_x", 6), "floor_y": F.round("floor_y", 6)})


@query(
    "w30_clean_ramp",
    f"""WITH {ONSET}, j AS (SELECT e.*, floor_x, floor_y, first_frame, sharp_frame, e.n >= first_frame AND e.n < sharp_frame AS ins FROM entry_curve e JOIN ff USING ({CK}) JOIN sf USING ({CK}) JOIN fl USING ({CK}))
    SELECT {CK}, n, CASE WHEN n >= sharp_frame THEN 1.0 WHEN ins THEN printf('%.3f', max(CASE WHEN ins THEN least(1.0, greatest(0.0, opacity)) END) OVER up)::DOUBLE ELSE 0.0 END::DOUBLE AS opacity,
      CASE WHEN ins THEN max(CASE WHEN ins THEN printf('%.2f', greatest(0.0, sigma_x - floor_x))::DOUBLE END) OVER dn ELSE 0.0 END::DOUBLE AS sigma_x, CASE WHEN ins THEN max(CASE WHEN ins THEN printf('%.2f', greatest(0.0, sigma_y - floor_y))::DOUBLE END) OVER dn ELSE 0.0 END::DOUBLE AS sigma_y
    FROM j WINDOW up AS (PARTITION BY {CK} ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), dn AS (PARTITION BY {CK} ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)""",
)
def _(t):
    return X.clean_ramps(t.entry_curve, CURVE_KEYS)


@query(
    "w31_median3",
    f"""WITH l AS (SELECT {CK}, n, dx, lag(dx) OVER w AS a, lead(dx) OVER w AS b FROM entry_curve WINDOW w AS (PARTITION BY {CK} ORDER BY n)) SELECT {CK}, n, CASE WHEN a IS NULL OR b IS NULL THEN dx ELSE list_sort([a, dx, b])[2] END AS smooth FROM l""",
)
def _(t):
    return X.median3(t.entry_curve, CURVE_KEYS, "n", "dx").select(*CURVE_KEYS, "n", "smooth")


@query(
    "w32_device_summary",
    f"""WITH {ONSET}, k AS (SELECT {CK}, max(greatest(0.0, sigma_x - floor_x)) AS x, max(greatest(0.0, sigma_y - floor_y)) AS y, median(fit) AS f FROM entry_curve JOIN ff USING ({CK}) JOIN sf USING ({CK}) JOIN fl USING ({CK}) WHERE n BETWEEN first_frame AND sharp_frame GROUP BY {CK})
    SELECT {CK}, first_frame, sharp_frame, CASE WHEN first_frame IS NULL THEN NULL WHEN x >= 1.5 AND x >= 1.6 * greatest(y, 0.3) THEN 'h' WHEN y >= 1.5 AND y >= 1.6 * greatest(x, 0.3) THEN 'v' ELSE 'iso' END AS axis,
      printf('%.2f', x)::DOUBLE AS max_sigma_x, printf('%.2f', y)::DOUBLE AS max_sigma_y, printf('%.3f', f)::DOUBLE AS median_fit, CASE WHEN coalesce(f, 0) >= 0.6 THEN 'high' WHEN coalesce(f, 0) >= 0.4 THEN 'medium' ELSE 'low' END AS confidence FROM ff LEFT JOIN sf USING ({CK}) LEFT JOIN k USING ({CK})""",
)
def _(t):
    return X.device_summary(t.entry_curve, CURVE_KEYS)


@query(
    "w33_swap_verdict",
    """WITH v AS (SELECT * REPLACE (asset || '/' || part AS asset) FROM entry_curve), s AS (SELECT asset, state, (state * 3)::BIGINT AS start_frame FROM (SELECT DISTINCT asset, state FROM v)), o AS (SELECT *, lag(state) OVER (PARTITION BY asset ORDER BY start_frame, state) AS p FROM s)
    SELECT o.asset, p AS from_state, o.state AS to_state, o.start_frame AS cut_frame, CASE WHEN opacity >= 0.75 AND greatest(sigma_x, sigma_y) <= 1.2 THEN 'hard swap' ELSE 'ramped' END AS verdict
    FROM o LEFT JOIN v e ON e.asset = o.asset AND e.state = o.state AND e.n = o.start_frame WHERE p IS NOT NULL""",
)
def _(t):
    curve = t.entry_curve.withColumns({"asset": F.concat(c("asset").cast("string"), F.lit("/"), "part"), "blur": F.greatest("sigma_x", "sigma_y")})
    states = curve.select("asset", "state").distinct().withColumn("start_frame", (c("state") * 3).cast("long"))
    return X.swap_verdict(states, curve)


@query(
    "w34_row_at",
    f"""WITH cv AS (SELECT {CK}, n * 2 AS n, dx FROM entry_curve), a AS (SELECT {CK}, n AS frame FROM entry_curve UNION ALL SELECT DISTINCT {CK}, 100000 FROM entry_curve), h AS (SELECT {CK}, max(n) AS hi FROM cv GROUP BY ALL)
    SELECT {CK}, frame, CASE WHEN frame > hi THEN (SELECT arg_max(x.dx, x.n) FROM cv x WHERE x.asset = a.asset AND x.state = a.state AND x.part = a.part) ELSE cv.dx END AS dx FROM a LEFT JOIN h USING ({CK}) LEFT JOIN cv ON cv.asset = a.asset AND cv.state = a.state AND cv.part = a.part AND cv.n = a.frame""",
)
def _(t):
    asked = t.entry_curve.select(*CURVE_KEYS, c("n").alias("frame"))
    asked = asked.unionByName(t.entry_curve.select(*CURVE_KEYS).distinct().withColumn("frame", F.lit(100000).cast("long")))
    return X.row_at(t.entry_curve.withColumn("n", c("n") * 2), asked, CURVE_KEYS, "dx")


@query(
    "w36_peak_run",
    """WITH t AS (SELECT asset, max(energy) AS pk, arg_max(hop, (energy, -hop)) AS top_at, max(hop) AS last FROM hops GROUP BY 1)
    SELECT t.asset, coalesce(max(hop) FILTER (hop < top_at AND energy < 0.3 * pk) + 1, 0) AS lo, coalesce(min(hop) FILTER (hop > top_at AND energy < 0.3 * pk), max(last) + 1) AS hi FROM t JOIN hops h USING (asset) GROUP BY 1""",
)
def _(t):
    return X.peak_run(t.hops, KEY, "hop", "energy", 0.3)


@query(
    "w39_level_ramp",
    """WITH r AS (SELECT asset, frame, a - b * 3 AS r FROM supplier_days), w AS (SELECT asset, frame, list_sort(list(r) OVER (PARTITION BY asset ORDER BY frame RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)) AS w FROM r),
    d AS (SELECT asset, frame, greatest(-40.0, least(40.0, w[len(w) // 2 + 1]))::DOUBLE AS delta FROM w) SELECT * FROM d WHERE asset IN (SELECT asset FROM d GROUP BY 1 HAVING max(abs(delta)) >= 30 AND count(*) >= 3)""",
)
def _(t):
    series = t.supplier_days.select("asset", "frame", (c("b") * 3).alias("ours"), c("a").alias("reference"))
    return X.level_ramp(series, KEY, "frame", "ours", "reference", tolerance=30.0, limit=40.0, width=64)
