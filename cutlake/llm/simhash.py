"""Near duplicates by SimHash: fingerprints, pigeonhole blocks, Hamming check, components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cutlake.llm import store, words
from cutlake.llm.carry import carried, one_of_each, restored
from cutlake.llm.components import smallest_reachable
from cutlake.llm.groups import attach

SHINGLE, SEED, DISTANCE, BITS = 3, 42, 3, 64
TILE = 512
_U = np.uint64


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if more than half of the hashes have it; no hashes give 0."""
    n, counts = len(hashes), np.zeros(64, dtype=np.int64)
    for at in range(0, n, 65536):
        part = hashes[at : at + 65536].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n).tobytes(), "big") if n else 0


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """``id, fp`` (a signed long with the 64 bits) of every whole text.

    A-Z are lowered, words are cut at white space; each run of ``shingle`` words,
    repeats included, votes with its XXH64. Fewer words make one shingle of all;
    a null text or one without words has fingerprint 0.
    """

    def run(batches):
        digest = xxhash.xxh64_intdigest
        for batch in batches:
            out = np.zeros(batch.num_rows, dtype=_U)
            for part in words.slices(batch.column(1), lower=True):
                found = part.words()
                body, starts, ends = words.joined(found)
                first, starts, ends = found.first.tolist(), starts.tolist(), ends.tolist()
                for i in range(len(part)):
                    a, b = first[i], first[i + 1]
                    if a < b:
                        last = ends[a + shingle - 1 : b] if b - a >= shingle else [ends[b - 1]]
                        hashes = [digest(body[s:e], seed) for s, e in zip(starts[a:b], last)]
                        out[part.at + i] = fingerprint(np.array(hashes, dtype=_U))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType([rows.schema["id"], T.StructField("fp", T.LongType())])).withColumnRenamed("id", id)


def block_keys(fp: np.ndarray, distance: int = DISTANCE) -> list[np.ndarray]:
    """Keys of which two fingerprints within ``distance`` bits share at least one.

    The bits fall into ``distance + 1`` blocks, one of which agrees; the other
    bits fall into ``distance + 1`` blocks again, one of which agrees too. A key
    holds an agreeing block of either kind and the numbers of both blocks.
    """
    ways, keys = distance + 1, []
    cuts = np.linspace(0, BITS, ways + 1).astype(int)
    for i in range(ways):
        low, high = cuts[i], cuts[i + 1]
        block = (fp >> _U(low)) & _U((1 << (high - low)) - 1)
        rest = (fp & _U((1 << low) - 1)) | (fp >> _U(high)) << _U(low) if high < BITS else fp & _U((1 << low) - 1)
        inner = np.linspace(0, BITS - (high - low), ways + 1).astype(int)
        for j in range(ways):
            part = (rest >> _U(inner[j])) & _U((1 << (inner[j + 1] - inner[j])) - 1)
            keys.append((block << _U(32)) | (part << _U(8)) | _U(i * ways + j))
    return keys


def _forest(fps: np.ndarray, distance: int) -> list[tuple[int, int]]:
    """Links that join what near pairs of one block join: fewer than there are members.

    Members are compared tile by tile. A pair whose ends are joined already gives
    no link, so no list of pairs is made.
    """
    label, links = np.arange(len(fps)), []
    for a in range(0, len(fps), TILE):
        for b in range(a, len(fps), TILE):
            near = np.bitwise_count(fps[a : a + TILE, None] ^ fps[None, b : b + TILE]) <= distance
            for i in np.flatnonzero(near.sum(axis=1) > (a == b)).tolist():
                new = np.flatnonzero(near[i] & (label[b : b + TILE] != label[a + i]))
                while new.size:
                    x, y = sorted((label[a + i], label[b + new[0]]))
                    links.append((int(fps[a + i].view(np.int64)), int(fps[b + new[0]].view(np.int64))))
                    label[label == y] = x
                    new = new[label[b + new] != label[a + i]]
    return links


def near_links(prints: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``a, b``: links that connect the distinct fingerprints of ``prints(fp)`` within ``distance`` bits.

    Fingerprints meet by block key. The members of a key are compared where they
    meet and give a spanning forest of their near pairs, never all pairs.
    """

    def spread(batches):
        for batch in batches:
            for key in block_keys(np.asarray(batch.column(0)).view(_U), distance):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0)], names=["key", "fp"])

    def compare(batches):
        held = None
        for batch in batches:
            now = np.stack([np.asarray(batch.column(i)) for i in range(2)])
            now = now if held is None else np.concatenate([held, now], axis=1)
            edge = np.flatnonzero(np.diff(now[0])) + 1
            done, held = (now[:, : edge[-1]], now[:, edge[-1] :]) if len(edge) else (now[:, :0], now)
            yield from groups(done)
        if held is not None:
            yield from groups(held)

    def groups(rows):
        if not rows.shape[1]:
            return
        cut = np.concatenate(([0], np.flatnonzero(np.diff(rows[0])) + 1, [rows.shape[1]]))
        links = []
        for k in np.flatnonzero(np.diff(cut) > 1):
            links += _forest(np.sort(rows[1, cut[k] : cut[k + 1]]).view(_U), distance)
        if links:
            a, b = zip(*links)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    keyed = prints.select("fp").mapInArrow(spread, "key long, fp long")
    met = keyed.repartition("key").sortWithinPartitions("key")
    return met.mapInArrow(compare, "a long, b long")


def near_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, seed: int = SEED, distance: int = DISTANCE) -> DataFrame:
    """One row per document: ``id, fp, component_id, fp_rows``.

    ``component_id`` is the smallest id reachable over links of ``distance`` or
    fewer differing bits, the document's own included; ``fp_rows`` counts the rows
    with its fingerprint. Fingerprints, not ids, are linked: rows that repeat an id
    are placed by their own texts, and a row with a null id takes the smallest id
    of its component (null where there is none). Other columns are ignored.
    """
    rows = store.keep(fingerprints(docs, id, text, shingle, seed).withColumn("_id", F.col(id).cast("long")), "fingerprints")
    prints = store.keep(rows.groupBy("fp").agg(F.min("_id").alias("_least"), F.count("*").alias("_n")), "prints")
    roots = smallest_reachable(near_links(prints, distance))
    member = roots.join(prints, F.col("node") == F.col("fp")).select("fp", "root", "_least")
    member = store.keep(member, "members")
    whole = store.keep(member.groupBy("root").agg(F.min("_least").alias("_lowest"), F.count("*").alias("_prints")), "components")
    linked = attach(member.select("fp", "root"), whole, "root", "_prints", "fp").select(F.col("fp").alias("_fp"), "_lowest")
    classes = prints.join(linked, F.col("fp") == F.col("_fp"), "left").select("fp", F.coalesce("_lowest", "_least").alias("component_id"), "_n")
    out = attach(rows, store.keep(classes, "classes"), "fp", "_n", "_id")
    return out.select(id, "fp", "component_id", F.col("_n").alias("fp_rows"))


def hexadecimal(fp):
    """A fingerprint column as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def drop_near(docs: DataFrame, id: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """One document of each component stays, that with the smallest id, with all its columns.

    Rows with a null id stay. Rows that repeat an id are decided by their own texts:
    each stays if the id is the smallest of its text's component, and of rows of one
    id and fingerprint one stays.
    """
    groups = store.keep(near_groups(docs, id, text, **how).where(F.col(id).isNotNull()).select(F.col(id).alias("_gid"), "fp", "component_id"), "near_groups")
    stays = F.col("_gid") == F.col("component_id")
    ids = groups.groupBy("_gid").agg(F.min("fp").alias("_low"), F.max("fp").alias("_high"), F.max(stays).alias("_stays"))
    mixed = store.keep(ids.where("_low <> _high").select("_gid"), "ids_of_several_texts")
    rows = carried(docs, id, text)
    same = F.col("_id") == F.col("_gid")
    single = rows.join(ids.where("_low = _high and not _stays").select("_gid"), same, "left_anti")
    if mixed.isEmpty():
        own = single.where(F.col("_id").isNotNull())
        return restored(one_of_each(own, ["_id"], store.keep).unionByName(single.where(F.col("_id").isNull())))
    single = single.join(mixed, same, "left_anti")
    shingles = {k: v for k, v in how.items() if k in ("shingle", "seed")}
    printed = fingerprints(rows.join(mixed, same, "left_semi").select(F.struct("*").alias("_row"), F.col("_text").alias("_body")), "_row", "_body", **shingles)
    kept = groups.where(stays).select("_gid", F.col("fp").alias("_fp")).distinct()
    several = printed.join(kept, (F.col("_row._id") == F.col("_gid")) & (F.col("fp") == F.col("_fp"))).dropDuplicates(["_gid", "fp"]).select("_row.*")
    own = single.where(F.col("_id").isNotNull())
    return restored(one_of_each(own, ["_id"], store.keep).unionByName(several).unionByName(single.where(F.col("_id").isNull())))
