"""Near-duplicate groups by SuperMinHash.

Signatures: each shingle draws a random permutation of the slots, one slot per step; its value at a
slot is the step number plus a random fraction. A slot keeps the least value. Later steps can only
give larger values, so a document stops once all its slots are filled, after a few steps where it
has many shingles. All shingles of a chunk of documents take a step together.

Grouping: documents with equal shingle sets are one node. ``BANDS`` bands of ``ROWS`` slots each make
buckets; the chance that a pair at the threshold shares none is (1 - 0.75^4)^32 < 6e-6. Nodes of a
bucket gather round a centre and are verified against it on full shingle sets; linked nodes are
united. Buckets that still hold several components may have links between them: what is near one
centre is told apart by its differences from the centre, what isn't by exact bounds on shared shingles
(``clusters.py``), and each pair found is verified and united. So no link between components is left
out, and no group is paired with itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partner_analytics.llm.clusters import linked_components, mixed, sets_of
from partner_analytics.llm.common import GOLDEN, by_chunk, free, mix, staged
from partner_analytics.llm.shingles import shingle_set

PERCENT = 75
BANDS, ROWS = 32, 4

_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)


def superminhash(sets: list[np.ndarray], slots: int = BANDS * ROWS) -> np.ndarray:
    """Signatures (sets x slots); the step is in the top 8 bits, the fraction in the rest."""
    out = np.full(len(sets) * slots, _EMPTY)
    value = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    left = np.tile(np.arange(slots, dtype=np.uint8), (len(value), 1))  # slots not drawn yet
    for step in range(slots):
        if not len(value):
            break
        with np.errstate(over="ignore"):
            draw = mix(value + GOLDEN * np.uint64(2 * step + 1))
            fraction = mix(value + GOLDEN * np.uint64(2 * step + 2)) >> np.uint64(8)
        at = step + ((draw >> np.uint64(32)) * np.uint64(slots - step) >> np.uint64(32)).astype(np.int64)
        row = np.arange(len(value))
        slot = left[row, at].astype(np.int64)
        left[row, at] = left[:, step]
        np.minimum.at(out, owner * slots + slot, fraction | np.uint64(step << 56))
        open_sets = (out.reshape(-1, slots) == _EMPTY).any(axis=1)
        go = open_sets[owner]
        if not go.all():
            value, owner, left = value[go], owner[go], left[go]
    return out.reshape(-1, slots)


def band_hashes(signatures: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit hash of each band, the band's number included."""
    parts = signatures.reshape(len(signatures), bands, -1)
    out = np.tile(np.arange(bands, dtype=np.uint64), (len(signatures), 1))
    with np.errstate(over="ignore"):
        for i in range(parts.shape[2]):
            out = mix(out * GOLDEN + parts[:, :, i])
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, code, n_shingles, key, bands) of ``docs`` (doc_id, code, text): ``key`` is a 128-bit hash of the set, null where it is empty."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        sizes, keys, bands, pending, weight = [], [], [], [], 0

        def flush() -> None:
            bands.extend(band_hashes(superminhash(pending)).view(np.int64).tolist() if pending else [])
            pending.clear()

        for text in part.column("text").to_pylist():
            own = shingle_set(text)
            sizes.append(len(own))
            keys.append(xxhash.xxh3_128_digest(own.tobytes()) if len(own) else None)
            pending.append(own)
            weight += len(own)
            if weight > 100_000:
                flush()
                weight = 0
        flush()
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), part.column("code"), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()),
             pa.array([b if n else [] for b, n in zip(bands, sizes)], pa.list_(pa.int64()))],
            ["doc_id", "code", "n_shingles", "key", "bands"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(by_chunk(run), f"doc_id {kind}, code long, n_shingles long, key binary, bands array<long>")


def _labelled(docs: DataFrame, id_col: str, text_col: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, code, n_shingles, key), ``code`` the hash of the text, and the component of each key (key, rep, component)."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("code"))
    rows = staged(fingerprints(source), "fingerprints")
    struct = F.struct("doc_id", "code")
    nodes = staged(rows.filter("key IS NOT NULL").groupBy("key").agg(
        F.coalesce(F.min(F.when(F.col("doc_id").isNotNull(), struct)), F.min(struct)).alias("x"),
        F.first("bands").alias("bands"), F.first("n_shingles").alias("n"),
    ).select(F.monotonically_increasing_id().alias("node"), "key", "bands", "n", F.col("x.doc_id").alias("rep"), "x.code"), "nodes")
    buckets = nodes.select(F.explode("bands").alias("bucket"), "node")
    shared = staged(buckets.join(mixed(buckets, "node"), "bucket", "left_semi"), "buckets")
    members = nodes.join(shared.select("node").distinct(), "node", "left_semi").select("node", "n", "rep", "code", "key")
    sets = staged(sets_of(source, members), "sets")
    united = linked_components(members.select("node", "n"), shared, sets, percent, within_buckets=True)
    of_key = nodes.select("node", "key", "rep").join(united, "node", "left").select("key", "rep", F.coalesce("component", "node").alias("component"))
    return rows.select("doc_id", "code", "n_shingles", "key"), of_key


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Near-duplicate components: (doc_id, n_shingles, component_id, kept), one row for each row of ``docs``.

    Two documents are linked where 100 * intersection >= ``percent`` * union of their distinct 5-word
    shingles (A-Z lower-cased; fewer words make one shingle). A null, empty or blank text has no
    shingle, is linked with nothing and kept. Repeated rows share a component, and each of them is
    kept where its id is the component's smallest. Null ids count as larger than all others.
    """
    rows, of_key = _labelled(docs, id_col, text_col, percent)
    of_key = staged(of_key, "components")
    first = of_key.groupBy("component").agg(F.min("rep").alias("component_id"))
    return rows.join(of_key.join(first, "component").select("key", "component_id"), "key", "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def without_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component; all columns stay.

    That of the smallest id stays, null ids last; of one id's texts the one with the smallest hash; of
    rows with id and text in common the least, compared column by column. Rows without words are no
    copies of anything and stay. What goes is looked up by id and text hash, as it is little and narrow.
    """
    rows, of_key = _labelled(docs, id_col, text_col, PERCENT)
    texts = staged(rows.join(of_key, "key").groupBy("component", "doc_id", "code").agg(F.count("*").alias("n")), "texts")
    name = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "code")
    best = texts.groupBy("component").agg(F.min(name).alias("best"))
    ranked = texts.join(best, "component").select("doc_id", "code", "n", (name == F.col("best")).alias("first"))
    one, two = free(docs, "_id"), free(docs, "_code")

    def named(df: DataFrame) -> DataFrame:
        return df.select(F.col("doc_id").alias(one), F.col("code").alias(two))

    same = F.col(id_col).eqNullSafe(F.col(one)) & (F.xxhash64(text_col) == F.col(two))
    stay = docs.join(named(ranked.filter("NOT first")), same, "left_anti")
    repeated = staged(named(ranked.filter("first AND n > 1")), "repeated")
    if repeated.isEmpty():
        return stay
    least = stay.join(repeated, same, "left_semi").groupBy(F.col(id_col).alias(one), F.xxhash64(text_col).alias(two)).agg(
        F.min(F.struct(*docs.columns)).alias("_row")).select("_row.*")
    return stay.join(repeated, same, "left_anti").unionByName(least)
