"""Operator 2, embedding near-dedup: sign hashes of random hyperplanes, exact cosines, connected components.

Equal vectors of one label form a class and are compared once. Each class gets ``tables`` keys, the signs of its
products with ``bits`` random hyperplanes; classes of one label that share a key of a table are candidates. At a
cosine of 0.98 two vectors agree on a sign with probability 0.936, so with 16 bits and 28 tables a link is missed with
probability 7e-6. Buckets are cut into blocks and compared block by block in double precision (``pair_blocks``), so a
bucket of any size is spread over tasks; a pair that meets in several tables counts in the first. A block pair
returns link counts per class and a spanning forest of its links, never the pairs. Cosines run over the whole vectors.

Defined results: a vector whose label is null, that is null or empty, zero, or has a null or non-finite component
links with nothing; vectors of different lengths don't link; rows of one id are one node (and each other's links are
counted per row); a null id links with nothing and has no component (it is kept); an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, stored
from .graph import components, pair_blocks, whole_groups

BITS, TABLES, BLOCK, SEED = 16, 28, 512, 17


def _hashed(tables: int, bits: int):
    """Arrow function: per row the class digest, the vector as doubles, and its keys; null where it can't link."""
    planes: dict[int, np.ndarray] = {}

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, vectors, keys = [], [], []
            for node, label, x in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                x = x.values if x.is_valid else None
                good = node is not None and label.is_valid and x is not None and len(x) and not x.null_count
                v = x.to_numpy().astype("<f8") if good else None
                if not good or not np.isfinite(v).all() or not v.any():
                    for column in (digests, vectors, keys):
                        column.append(None)
                    continue
                if len(v) not in planes:
                    planes[len(v)] = np.random.default_rng((SEED, len(v))).standard_normal((len(v), tables * bits))
                with np.errstate(over="ignore"):
                    v = v / np.abs(v).max()  # cosines don't change, and squares neither overflow nor vanish
                signs = (v @ planes[len(v)] > 0).reshape(tables, bits)
                keys.append((signs @ (1 << np.arange(bits))).astype(np.int32))
                vectors.append(v.tobytes())
                digests.append(hashlib.blake2b(x.to_numpy().tobytes() + str(label.as_py()).encode(), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1).cast(pa.string()), pa.array(digests, pa.binary()),
                pa.array(vectors, pa.binary()), pa.array(keys, pa.list_(pa.int32()))],
                ["node", "label", "digest", "vector", "keys"])

    return rows


def _forest(links: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of a symmetric boolean matrix."""
    out, fresh = [], np.ones(len(links), bool)
    for root in range(len(links)):
        if not fresh[root]:
            continue
        fresh[root], queue = False, [root]
        while queue:
            x = queue.pop()
            near = np.flatnonzero(links[x] & fresh)
            fresh[near] = False
            out += [(x, int(y)) for y in near]
            queue += near.tolist()
    return out


def _compared(least: float):
    """Arrow function over block pairs: rows (digest, node, other, links): a class's count, or a link of the forest."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, "_pair"):
            node, side = table.column("node").to_numpy(), table.column("_side").to_numpy()
            same, rank = table.column("_same").to_numpy(), table.column("table").to_numpy()
            copies = table.column("copies").to_numpy()
            keys = table.column("keys").combine_chunks().flatten().to_numpy().reshape(len(node), -1)
            raw, digest = table.column("vector").to_pylist(), table.column("digest").to_pylist()
            out: list[tuple] = []
            for a, b in zip(starts, np.append(starts[1:], len(node))):
                if b - a < 2:
                    continue
                v = np.frombuffer(b"".join(raw[a:b]), "<f8").reshape(b - a, -1)
                v = v / np.sqrt((v * v).sum(axis=1))[:, None]
                near = v @ v.T >= least
                across = side[a:b][:, None] != side[a:b][None, :]
                near &= same[a:b][:, None] & same[a:b][None, :] | across
                np.fill_diagonal(near, False)
                x, y = np.nonzero(near)
                earlier = keys[a + x, :rank[a]] == keys[a + y, :rank[a]]
                again = earlier.any(axis=1)
                near[x[again], y[again]] = False
                counts = near @ copies[a:b]
                out += [(digest[a + i], int(node[a + i]), None, int(counts[i])) for i in np.flatnonzero(counts)]
                out += [(None, int(node[a + i]), int(node[a + j]), 0) for i, j in _forest(near)]
            types, names = [pa.binary(), *[pa.int64()] * 3], ["digest", "node", "other", "links"]
            columns = zip(*out) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return rows


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                    least: float = 0.98, tables: int = TABLES, bits: int = BITS, block: int = BLOCK) -> DataFrame:
    """Per row of ``df``: id, n_links, component_id, kept (the row whose id names its component)."""
    ship(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("node"), F.col(label_col), F.col(vector_col))
    base = stored(rows.mapInArrow(_hashed(tables, bits), "node long, label string, digest binary, vector binary, "
                                                         "keys array<int>"), "embed-base")
    hashed = base.where("digest IS NOT NULL")
    classes = stored(hashed.groupBy("digest").agg(
        F.min("node").alias("node"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"),
        F.first("vector").alias("vector"), F.first("keys").alias("keys")), "embed-classes")
    length = F.octet_length("vector")
    bands = classes.select("node", "digest", "label", length.alias("size"), F.posexplode("keys").alias("table", "key"))
    bucket = ["label", "size", "table", "key"]
    full = stored(bands.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_in")).where("_in > 1"), "embed-buckets")
    crowd = stored(bands.join(full, bucket), "embed-members").join(classes.select("digest", "copies", "vector", "keys"), "digest")
    blocks = F.ceil(F.col("_in") / F.lit(block)).cast("int")
    pairs = pair_blocks(crowd, [F.col(c) for c in bucket], blocks, F.xxhash64("digest"))
    sent = pairs.select("_pair", "_side", "_same", "table", "digest", "node", "copies", "keys", "vector")
    met = stored(sent.repartition("_pair").sortWithinPartitions("_pair")
                 .mapInArrow(_compared(least), "digest binary, node long, other long, links long"), "embed-links")
    counts = met.where("other IS NULL").groupBy("digest").agg(F.sum("links").alias("near"))
    repeated = base.where("digest IS NOT NULL").groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    first = classes.select("digest", F.col("node").alias("rep"), "copies")
    same = hashed.select("node", "digest").join(repeated, "node").join(first, "digest").select(
        F.col("node").alias("a"), F.col("rep").alias("b"))
    group = components(met.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")).union(same))
    known = stored(first.join(counts, "digest", "left")
                   .join(group.withColumnRenamed("node", "rep"), "rep", "left")
                   .select("digest", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"),
                           F.coalesce("component", "rep").alias("component_id")), "embed-known")
    out = base.select("node", "digest").join(known, "digest", "left")
    component = F.coalesce("component_id", "node")
    return out.select(F.col("node").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"),
                      F.coalesce(F.col("node") == component, F.lit(True)).alias("kept"))
