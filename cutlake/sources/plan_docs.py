"""Plan, supersession and caption-state documents of several shapes, flattened from variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cutlake.functions.rules import master_id
from cutlake.sources.catalog import get

# Keys in order of precedence.
LIST_KEYS = ["slots", "shots", "states", "segments", "blocks", "picture_slots"]
SLOT_KEYS = ["block_id", "block", "slot", "shot", "id", "state", "i"]
SOURCE_KEYS = (
    "source source_path source_file master master_path remote_path local_path path file filename basename clip clip_file"
).split()


MAP_KEYS = ["recast", "reseated", "reseat"]

# One cast reads all keys of an object; a key that is absent or of another type is null.
RECORD = "struct<" + ",".join(f"`{k}`:string" for k in SLOT_KEYS + SOURCE_KEYS) + ">"
PLAN = "struct<" + ",".join(f"`{k}`:array<variant>" for k in LIST_KEYS) + ">"
CHANGE = "struct<" + ",".join([f"`{k}`:map<string,variant>" for k in MAP_KEYS] + ["`installed`:variant", PLAN[7:-1], RECORD[7:-1]]) + ">"


def records(doc: Column, keys: Column) -> Column:
    """The slot list of a document: the first non-empty list of objects under the known keys, or the array itself."""
    first_object = lambda a: F.coalesce(F.schema_of_variant(F.try_element_at(a, F.lit(1))).startswith("OBJECT"), F.lit(False))
    return F.coalesce(*[F.when(first_object(keys[k]), keys[k]) for k in LIST_KEYS], get(doc, "$", "array<variant>"), F.array().cast("array<variant>"))


def slot_id(record: Column, index: Column) -> Column:
    """Name of a slot from its keys, read as ``RECORD``."""
    wide = lambda text: F.lpad(text, F.greatest(F.length(text), F.lit(3)), F.lit("0"))
    given = [(k, F.trim(record[k])) for k in SLOT_KEYS]
    named = [F.when(v != "", F.when(v.rlike(r"^\d+$"), F.concat(F.lit(k), wide(v))).otherwise(v)) for k, v in given]
    return F.coalesce(*named, F.concat(F.lit("idx"), wide(index.cast("string"))))


def sources(record: Column) -> Column:
    """Master ids named by the record's own source keys, read as ``RECORD``; nested prose is never read."""
    given = F.array_compact(F.array(*[record[k] for k in SOURCE_KEYS]))
    return F.array_distinct(F.array_compact(F.transform(given, master_id)))


def flatten_plan(plans: DataFrame, key: str, value: str = "value", deal: bool = False) -> DataFrame:
    """Slot records of plan documents: key, index, slot, masters.

    ``deal`` shuffles the documents by key first: for inputs of fewer splits than
    cores, as each document is heavy work. Inputs of many splits need none.
    """
    parsed = (plans.select(key, value).repartition(key) if deal else plans).select(key, F.try_parse_json(F.col(value)).alias("_doc"))
    read = parsed.select(key, "_doc", get("_doc", "$", PLAN).alias("_keys"))
    rows = read.select(key, F.posexplode(records(F.col("_doc"), F.col("_keys"))).alias("index", "r"))
    rows = rows.select(key, "index", get("r", "$", RECORD).alias("r"))
    return rows.select(key, "index", slot_id(F.col("r"), F.col("index")).alias("slot"), sources(F.col("r")).alias("masters"))


def flatten_supersession(plans: DataFrame, key: str, value: str = "value") -> DataFrame:
    """(slot, master) pairs a recast or reseat document installs; what was removed is never read.

    Shapes are tried in order: slot maps, a single installed block, a slot
    list, and a document that is itself one slot. The first that yields wins,
    and those after it are not worked out.
    """
    # The document is parsed once and its keys are read once: both are used several times below.
    parsed = plans.select(key, F.try_parse_json(F.col(value)).alias("_doc"))
    read = parsed.select(key, "_doc", get("_doc", "$", CHANGE).alias("_keys"))
    doc, keys = F.col("_doc"), F.col("_keys")
    own = F.coalesce(*[keys[k] for k in ("block_id", "block", "slot")])
    pair = lambda slot, masters: F.transform(masters, lambda m: F.struct(slot.alias("slot"), m.alias("master_id")))
    # Each step of a chain of transforms binds what it made, so that the next reads it without a second cast.
    told = lambda values: F.transform(values, lambda v: get(v, "$", RECORD))

    def from_map(name: str) -> Column:
        now = lambda v: F.when(F.schema_of_variant(get(v, "$.now", "variant")).startswith("OBJECT"), get(v, "$.now", "variant")).otherwise(v)
        entries = F.transform(F.map_entries(keys[name]), lambda e: F.struct(e["key"].alias("key"), get(now(e["value"]), "$", RECORD).alias("r")))
        return F.flatten(F.transform(entries, lambda e: pair(e["key"], sources(e["r"]))))

    empty = F.array().cast("array<struct<slot:string,master_id:string>>")
    maps = F.concat(*[F.coalesce(from_map(n), empty) for n in MAP_KEYS])
    installed = F.flatten(F.transform(told(F.array(keys["installed"])), lambda r: pair(own, sources(r))))
    listed = F.flatten(F.transform(told(records(doc, keys)), lambda r, i: pair(slot_id(r, i), sources(r))))
    flat = F.when(own.isNotNull(), pair(own, sources(keys)))
    some = lambda found: F.try_element_at(F.filter(F.array(found), lambda a: F.size(a) > 0), F.lit(1))
    chosen = F.coalesce(some(maps), some(installed), some(listed), flat, empty)
    return read.select(key, F.explode(chosen).alias("p")).select(key, "p.*")


STATE = "array<struct<id:string,text:string,start:bigint,end_exclusive:bigint,box:array<double>,style_id:string>>"


def normalise_states(contracts: DataFrame, key: str, value: str = "value") -> DataFrame:
    """Caption states of both contract layouts (a list of states, or states by id) in one schema."""
    parsed = contracts.select(key, F.try_parse_json(F.col(value)).alias("_doc"))
    doc = F.col("_doc")
    box = lambda s: F.coalesce(*[get(s, p, "array<double>") for p in ("$.placement.core_bbox_xyxy", "$.placement.treatment_bbox_xyxy", "$.box")])
    near = lambda s: F.coalesce(*[get(s, p, "array<double>") for p in ("$.box", "$.placement.core_bbox_xyxy")])

    def listed(s: Column, i: Column) -> Column:
        name = F.coalesce(get(s, "$.id"), F.concat(F.lit("S"), F.lpad(i.cast("string"), 2, "0")))
        return F.struct(
            name.alias("id"), F.coalesce(get(s, "$.text"), F.lit("")).alias("text"), get(s, "$.start_frame", "bigint").alias("start"), get(s, "$.end_frame_exclusive", "bigint").alias("end_exclusive"),
            box(s).alias("box"), get(s, "$.style_id").alias("style_id"),
        )

    def mapped(e: Column) -> Column:
        s = e["value"]
        return F.struct(
            F.coalesce(get(s, "$.id"), e["key"]).alias("id"), get(s, "$.text").alias("text"), F.coalesce(get(s, "$.start", "bigint"), get(s, "$.start_frame", "bigint")).alias("start"),
            F.coalesce(get(s, "$.end", "bigint"), get(s, "$.end_frame_exclusive", "bigint")).alias("end_exclusive"), near(s).alias("box"), F.coalesce(get(s, "$.style"), get(s, "$.style_id")).alias("style_id"),
        )

    as_list = F.transform(get(doc, "$.states", "array<variant>"), listed).cast(STATE)
    by_id = F.coalesce(get(doc, "$.states", "map<string,variant>"), get(doc, "$", "map<string,variant>"))
    as_map = F.transform(F.filter(F.map_entries(by_id), lambda e: get(e["value"], "$.text").isNotNull()), mapped).cast(STATE)
    return parsed.select(key, F.explode(F.coalesce(as_list, as_map)).alias("s")).select(key, "s.*")
