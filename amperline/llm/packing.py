"""Best-fit packing of token sequences by hierarchical residual packing.

Pieces (documents cut at the capacity) are dealt to at least FAN leaves by a hash. Each leaf packs by best
fit, longest first. Bins with little room left are final; the underfull ones go up a tree, where
each node takes the bins of FAN children as items and packs them by best fit again.

How much goes up is bounded without loss. After best fit no two bins of a node fit together, so
a node has at most one bin that is at most half full, and only those can still be placed into
others. With P leaves at most P of them exist in the whole tree, so each node needs to carry at
most its P + 1 emptiest bins: any that a small bin could use beyond these has a stand-in at least
as empty. The root reads at most FAN * (P + 1) rows of a few numbers.

Defined cases: null text is an empty document (its end id only); repeated rows are packed as
rows of their own; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from amperline.llm.store import save

FAN = 8
LEAF_ITEMS = 40_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of each document's pieces of at most `capacity` ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from amperline.llm.encoder import encoder

        enc = encoder(tokenizer)
        end = np.array([end_id], enc.dtype)
        for batch in batches:
            doc, number, start, length, crc, ids = [], [], [], [], [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), strict=True):
                own = np.concatenate([np.frombuffer(enc.blob(text.as_py() or b""), enc.dtype), end]).astype("<u4")
                for k, at in enumerate(range(0, len(own), capacity)):
                    part = own[at : at + capacity]
                    doc.append(d)
                    number.append(k)
                    start.append(at)
                    length.append(len(part))
                    crc.append(zlib.crc32(part))
                    if with_ids:
                        ids.append(part.tobytes())
            columns = [pa.array(doc, pa.int64()), pa.array(number, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(ids, pa.binary())], [*names, "ids"]
            yield pa.record_batch(columns, names=names)

    return docs.select("doc_id", "text").mapInArrow(cut, _PIECES + ", ids binary" * with_ids)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each item, longest first, each into the fullest bin that has room."""
    where, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, n = 0, 0  # bit r of rooms: a bin with r free exists
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = rooms >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b, n = capacity, n, n + 1
        where[i], offset[i] = b, capacity - room
        left = room - size
        if left:
            if not by_room[left]:
                rooms |= 1 << left
            by_room[left].append(b)
    return where, offset


def _leaf_packer(capacity: int):
    def pack(key, leaf):
        lengths = leaf["length"].to_numpy()
        where, offset = best_fit(lengths, capacity)
        level = np.bincount(where, lengths).astype(np.int64)
        bin_id = (np.int64(key[0].as_py()) << np.int64(32)) + where
        return leaf.append_column("bin", pa.array(bin_id)).append_column("offset", pa.array(offset)).append_column("level", pa.array(level[where]))

    return pack


def _node_packer(capacity: int, slack: int, keep: int):
    def merge(key, bins):
        bins = bins.sort_values(["level", "bin"], ascending=[False, True], ignore_index=True)
        where, offset = best_fit(bins["level"].to_numpy(), capacity)
        rows: dict[int, list] = {}
        for i, (b, at) in enumerate(zip(where.tolist(), offset.tolist(), strict=True)):
            own = rows.setdefault(b, [int(bins["bin"][i]), 0, [], []])
            own[1] += int(bins["level"][i])
            own[2].extend(bins["member"][i])
            own[3].extend(int(x) + at for x in bins["shift"][i])
        out = pd.DataFrame(list(rows.values()), columns=["bin", "level", "member", "shift"]).sort_values(["level", "bin"], ignore_index=True)
        out["node"] = key[0]
        out["up"] = (out.index < keep) & (out["level"] < capacity - slack)
        return out[["node", "bin", "level", "member", "shift", "up"]]

    return merge


def pack(pieces: DataFrame, capacity: int, slack: int = 16) -> DataFrame:
    """`pieces` with sequence_id and offset; the pieces of a sequence follow each other from 0."""
    n = pieces.count()
    leaves = max(FAN, -(-n // LEAF_ITEMS))
    keyed = pieces.withColumn("leaf", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(leaves)).cast("long"))
    schema = StructType(keyed.schema.fields.copy()).add("bin", "long").add("offset", "long").add("level", "long")
    packed = save(keyed.groupBy("leaf").applyInArrow(_leaf_packer(capacity), schema), "packed-leaves")

    # a bin's first piece stands for the bin
    order = Window.partitionBy("leaf").orderBy("level", "bin")
    rows = (
        packed.where((F.col("offset") == 0) & (F.col("level") < capacity - slack))
        .withColumn("_rank", F.row_number().over(order))
        .where(F.col("_rank") <= leaves + 1)
        .select(F.col("leaf").alias("node"), "bin", "level", F.array("bin").alias("member"), F.array(F.lit(0).cast("long")).alias("shift"), F.lit(True).alias("up"))
    )
    done, width = [], leaves
    while width > 1:
        width = -(-width // FAN)
        step = rows.where("up").withColumn("node", F.floor(F.col("node") / FAN)).groupBy("node")
        rows = save(step.applyInPandas(_node_packer(capacity, slack, leaves + 1), rows.schema), "packed-nodes")
        done.append(rows if width == 1 else rows.where("NOT up"))
    merged = done[0]
    for d in done[1:]:
        merged = merged.unionByName(d)
    moves = (
        merged.where(F.size("member") > 1)
        .select(F.col("bin").alias("_to"), F.explode(F.arrays_zip("member", "shift")).alias("m"))
        .select("_to", F.col("m.member").alias("bin"), F.col("m.shift").alias("_shift"))
    )
    return (
        packed.join(moves, "bin", "left")
        .withColumns({"sequence_id": F.coalesce("_to", "bin"), "offset": F.col("offset") + F.coalesce("_shift", F.lit(0))})
        .drop("leaf", "bin", "level", "_to", "_shift")
    )


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = 4096, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset) of every piece."""
    pieces = save(token_pieces(docs, tokenizer, end_id, capacity, with_ids), "pieces")
    return pack(pieces, capacity)
