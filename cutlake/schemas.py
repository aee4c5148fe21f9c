"""Silver-table schemas."""

GRADE_LINE = "at STRING, stem STRING, clip_id STRING, grade STRING, ident STRING, t0 DOUBLE, t1 DOUBLE"
TAGS = (
    "STRUCT<roles: ARRAY<STRING>, world_cluster: STRING, action_verbs: ARRAY<STRING>, energy: STRING, subject: STRING, "
    "lighting: STRING, crop_safety_916: STRING, confidence: STRING, notes: STRING>"
)
CLIP = f"STRUCT<name: STRING, path: STRING, duration: DOUBLE, intake: STRING, proxy: STRING, tags: {TAGS}>"
LIBRARY = f"STRUCT<clips: MAP<STRING, {CLIP}>>"
STATUS = "v INT, row INT, lane STRING, at STRING, state STRING, why STRING, not_before STRING, artifact STRING"
JOB_EVENT = "project BIGINT, seq BIGINT, action STRING, ts TIMESTAMP"
BUS_EVENT = "receipt BIGINT, row BIGINT, seq BIGINT, ts TIMESTAMP_NTZ, lane STRING, state STRING, why STRING, not_before TIMESTAMP_NTZ"
