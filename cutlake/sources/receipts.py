"""Receipts, call cards, signals and transcripts from text.

A receipt is one small text file. Its lines are handled as an array inside the
row, so parsing needs no shuffle; only the parsed lines become rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cutlake.functions import rules as R
from cutlake.schemas import STATUS

# Receipt name, head and status line patterns.
NAME = r"^ui-(feedback|frame-note|batch-verdict|continue|drop|smoketest)\b"
ROW = r"-row(\d{2,})-"
STAMP = r"(\d{8})T(\d{6})Z"
BATCH_ROW = r"(?m)^ORDER: build a 10-variant alternate batch for registry row (\d{1,3})\."
EDITOR, EDITOR_LINE = "AUTHORITY: EDITOR", r"(?m)^Sent by:\s*\S+\s*\(EDITOR\)"
HEAD = r"^(ACK|CALL)\s+[—–-]+\s+(.+?)\s+[—–-]+\s+(\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z)(.*)$"
BLOCK = r"^<!--status (\{.*\}) -->\s*$"


def _none_if_empty(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def lines_of(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def receipt_header(name: Column, text: Column, modified: Column | None = None) -> dict[str, Column]:
    """Kind, row, sent time, disposition and author role of a receipt.

    A drop whose name has no row takes that of the batch its body orders; a name
    without a stamp takes the file's time ``modified``.
    """
    kind = _none_if_empty(F.regexp_extract(name, NAME, 1))
    stamp = F.concat(F.regexp_extract(name, STAMP, 1), F.regexp_extract(name, STAMP, 2))
    sent = F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss"))
    editor = text.contains(EDITOR) | text.rlike(EDITOR_LINE)
    return {
        "kind": kind,
        "row": F.coalesce(F.regexp_extract(name, ROW, 1).try_cast("int"), F.when(kind == "drop", F.regexp_extract(text, BATCH_ROW, 1).try_cast("int"))),
        "sent": sent if modified is None else F.coalesce(sent, modified.cast("timestamp")),
        "disposition": _none_if_empty(F.regexp_extract(text, r"(?m)^Disposition:\s*(\w+)", 1)),
        "author": F.when(editor, "editor").otherwise("operator"),
    }


def parse_receipts(files: DataFrame, name: str = "name", text: str = "text", modified: str | None = None) -> DataFrame:
    """One row per receipt with its heads as an array; a status counts only directly under a head."""
    split = files.withColumn("_lines", lines_of(F.col(text)))
    numbered = F.transform("_lines", lambda line, i: F.struct(line.alias("line"), i.alias("i")))
    heads = F.filter(numbered, lambda x: x["line"].rlike(HEAD))
    after = lambda i: F.try_element_at("_lines", i + 2)

    def head(x: Column, seq: Column) -> Column:
        status = F.from_json(F.regexp_extract(F.coalesce(after(x["i"]), F.lit("")), BLOCK, 1), STATUS)
        return F.struct(
            seq.cast("long").alias("seq"), F.regexp_extract(x["line"], HEAD, 1).alias("head"), F.trim(F.regexp_extract(x["line"], HEAD, 2)).alias("lane"),
            F.regexp_extract(x["line"], HEAD, 3).alias("at"), status["state"].alias("state"), status["why"].alias("why"), status["not_before"].alias("not_before"), x["line"].alias("line"),
        )

    parsed = split.select(F.col(name).alias("receipt"), *[v.alias(k) for k, v in receipt_header(F.col(name), F.col(text), None if modified is None else F.col(modified)).items()], F.transform(heads, head).alias("heads"))
    return parsed.where("kind IS NOT NULL")


def receipt_events(receipts: DataFrame) -> DataFrame:
    """One row per head line of parsed receipts."""
    keep = [c for c in receipts.columns if c != "heads"]
    return receipts.select(*keep, F.explode("heads").alias("h")).select(*keep, "h.*")


def read_receipts(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"), F.col("_metadata.file_modification_time").alias("modified"))
    return parse_receipts(files, modified="modified")


def status_blocks(receipts: DataFrame) -> DataFrame:
    """Trusted state per receipt: the newest head's own status, else a reading of its prose."""
    last = F.try_element_at("heads", F.lit(-1))
    prose = (
        F.when(last["head"] == "CALL", "called")
        .when(last["line"].rlike(r"(?i)—\s*picked up\b") & ~last["line"].rlike(r"(?i)—\s*finished\b"), "picked_up")
        .when(last["line"].rlike(r"(?i)—\s*finished\b"), "finished")
        .when(last.isNotNull(), "answered")
    )
    return receipts.select("receipt", last["state"].isNotNull().alias("structured"), F.coalesce(last["state"], prose).alias("state"), last["why"].alias("why"))


# The call card's header keys and section headings.
CARD_KEYS = ["call_id", "severity", "project_id", "revision", "reference_block", "issue_type", "stage", "layer"]
CARD_SECTIONS = {
    "what_the_reference_requires": "WHAT THE REFERENCE REQUIRES:",
    "what_i_found": "WHAT I FOUND:",
    "why_it_does_not_match": "WHY IT DOES NOT MATCH:",
    "evidence": "EVIDENCE:",
    "options": "OPTIONS:",
    "recommendation": "MY RECOMMENDATION:",
    "reply_with": "REPLY WITH:",
}


def parse_call_cards(files: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Call cards of marked, fenced blocks: header values (wrapped lines joined), sections and lettered options."""
    blocks = F.split(F.col(text), r"(?m)^[ \t]*CALL_REQUIRED[ \t]*$")
    cards = files.select(key, F.posexplode(F.slice(blocks, F.lit(2), F.greatest(F.size(blocks) - 1, F.lit(0)))).alias("card", "b"))
    body = F.element_at(F.split("b", r"(?m)^[ \t]*```[ \t]*$", 2), 1)
    headings = "|".join(CARD_SECTIONS.values())
    header = F.element_at(F.split(body, rf"(?m)^[ \t]*(?:{headings})[ \t]*$", 2), 1)
    any_key = "|".join(CARD_KEYS)
    tidy = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    value = lambda k: _none_if_empty(tidy(F.regexp_extract(header, rf"(?ms)^[ \t]*{k}:[ \t]*(.*?)(?=^[ \t]*(?:{any_key}):|\z)", 1)))
    section = lambda h: F.regexp_extract(body, rf"(?ms)^[ \t]*{h}[ \t]*$\n?(.*?)(?=^[ \t]*(?:{headings})[ \t]*$|\z)", 1)
    lettered = F.regexp_extract_all(section(CARD_SECTIONS["options"]), F.lit(r"(?ms)^[ \t]*([A-Z]\.[ \t]+.*?)(?=^[ \t]*[A-Z]\.[ \t]|\z)"), 1)
    options = F.transform(lettered, lambda o: F.struct(F.substring(o, 1, 1).alias("key"), tidy(F.regexp_replace(o, r"^[A-Z]\.\s+", "")).alias("text")))
    bullets = F.regexp_extract_all(section(CARD_SECTIONS["evidence"]), F.lit(r"(?m)^[ \t]*-[ ](.*)$"), 1)
    prose = [_none_if_empty(F.trim(F.regexp_replace(section(h), r"^\s+|\s+$", ""))).alias(n) for n, h in CARD_SECTIONS.items() if n not in ("evidence", "options")]
    out = cards.select(key, "card", *[value(k).alias(k) for k in CARD_KEYS], *prose, F.transform(bullets, F.trim).alias("evidence"), options.alias("options"))
    return out.where("call_id IS NOT NULL")


# The patterns of a signal.
SIGNALS = {
    "note": r"(?s)(?:Operator (?:note|text) \(verbatim\):|RULING on [^\n]+:)\s*\n?(.*?)(?:\n---|\z)",
    "factory-CALL": r"(?m)^CALL — (.+)$",
    "audit-verdict": r"(?ms)^\*{0,2}VERDICT\*{0,2}.*?\n+(.*?)(?:\n\n|\z)",
    "audit-HARD": r"(?m)^(?:\*\*|-\s*\*\*|#+\s*)?(HARD[- ]?\d+[^\n]*)",
}


def row_named(name: Column, text: Column) -> Column:
    """The row that a file's name or else its text gives: ``row12``, ``reel12``, ``row #12``."""
    found = [F.regexp_extract(name, r"row(\d+)", 1), F.regexp_extract(name, r"reel(\d+)", 1), F.regexp_extract(text, r"(?i)\brow\s*#?(\d+)", 1)]
    return F.coalesce(*(x.try_cast("int") for x in found))


def harvest_signals(files: DataFrame, seen: DataFrame, epoch: str = "", source: str = "source", text: str = "text") -> DataFrame:
    """New inbox rows found by the signal patterns, with the ``row`` they speak of.

    A key of source, kind and the digest of the whole tidied text is never taken
    twice. The row comes from the source's name, else from the file's text.
    """
    rows = None
    for kind, pattern in SIGNALS.items():
        one = files.select(F.col(source).alias("source"), F.lit(kind).alias("kind"), F.explode(F.regexp_extract_all(F.col(text), F.lit(pattern), 1)).alias("text"), row_named(F.col(source), F.col(text)).alias("row"))
        rows = one if rows is None else rows.unionByName(one)
    tidy = rows.withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " "))).where("text <> ''")
    keyed = tidy.withColumn("key", F.concat_ws("::", "source", "kind", F.sha2("text", 256)))
    fresh = keyed.groupBy("key").agg(F.min(F.struct("source", "kind", "text", "row")).alias("s")).join(seen.select("key"), "key", "left_anti").select("key", "s.*")
    return fresh.withColumn("triage", R.auto_triage(F.col("text"), F.col("kind"), F.col("source"), epoch))


def latest_activity(entries: DataFrame, now: Column, alive_seconds: int = 900, fresh_seconds: int = 21_600) -> DataFrame:
    """Freshest live run per row.

    ``entries``: run, file, mtime, seq, text, tool, ts - transcript lines with
    their file's modification time. Per run only the newest file speaks: row
    and role come from its first lines that name them, the action from its
    newest tool call.
    """
    newest = entries.groupBy("run").agg(F.max(F.struct("mtime", "file")).alias("n"), (F.countDistinct("file") - 1).alias("restarts"))
    age = (F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("n.mtime").cast("timestamp"))) / 1_000_000
    live = newest.where(age <= fresh_seconds).select("run", F.col("n.file").alias("file"), F.col("n.mtime").alias("mtime"), "restarts", age.alias("age_s"))
    lines = entries.drop("mtime").join(live, ["run", "file"])
    row = F.regexp_extract("text", r"(?i)\brow\s*#?(\d+)", 1).try_cast("int")
    role = _none_if_empty(F.upper(F.trim(F.regexp_extract("text", r"(?i)\brole:\s*([a-z-]+)", 1))))
    facts = lines.groupBy("run", "mtime", "restarts", "age_s").agg(
        F.min_by(row, F.when(row.isNotNull(), F.col("seq"))).alias("row"), F.min_by(role, F.when(role.isNotNull(), F.col("seq"))).alias("role"),
        F.min_by("ts", F.when(F.col("ts").isNotNull(), F.col("seq"))).alias("started"), F.max_by("tool", F.when(F.col("tool").isNotNull(), F.col("seq"))).alias("tool"),
    )
    card = F.struct("run", F.coalesce("role", F.lit("LANE")).alias("role"), "tool", "started", "restarts", F.round("age_s", 1).alias("age_s"), (F.col("age_s") <= alive_seconds).alias("alive"))
    return facts.where("row IS NOT NULL").groupBy("row").agg(F.max_by(card, F.struct("mtime", "run")).alias("c")).select("row", "c.*")
