"""Best-fit packing of tokenised documents into fixed-length training sequences."""

from __future__ import annotations

import os
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import cut, texts, unused
from .token_counts import tokenizer_model

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Each row's token ids followed by end_id, cut into pieces of at most capacity.

    Only documents longer than capacity are cut; their first piece takes the remainder, the
    others are full. ids holds little-endian uint32 (null unless with_ids). An empty or null
    text is the end id alone; repeated rows are repeated documents. No shuffle.
    """
    model = docs.sparkSession.sparkContext.broadcast(tokenizer_model(tokenizer_path))
    end = bpe.pack([end_id])

    def cutter(batches):
        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder = bpe.kept(("ids", hash(model.value)), lambda: bpe.Encoder(model.value, bpe.pack))
        for b in batches:
            rows = [[] for _ in range(6)]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = coder.packed(text.as_py()) + end
                total = len(ids) // 4
                first = total % capacity or capacity
                start, k = 0, 0
                while start < total:
                    size = first if k == 0 else capacity
                    part = ids[4 * start : 4 * (start + size)]
                    for column, v in zip(rows, (doc, k, start, size, zlib.crc32(part), part if with_ids else None)):
                        column.append(v)
                    start, k = start + size, k + 1
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"])

    return texts(docs).mapInArrow(cutter, PIECES)


def best_fit(sizes, capacity: int):
    """Best-fit of sizes in the given order: (bin, offset) of each. Free room is kept as a bit mask."""
    by_free: list[list[int]] = [[] for _ in range(capacity + 1)]
    free_bits, n, bins, offsets = 0, 0, [], []
    for size in sizes:
        fits = free_bits >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                free_bits ^= 1 << free
        else:
            free, b, n = capacity, n, n + 1
        bins.append(b)
        offsets.append(capacity - free)
        left = free - size
        if left:
            by_free[left].append(b)
            free_bits |= 1 << left
    return bins, offsets


def pack_pieces(pieces: DataFrame, capacity: int = 2048, group_rows: int = 40_000) -> DataFrame:
    """Adds sequence_id and offset to pieces(length, ...) so that few sequences hold them all.

    The pieces are dealt into groups of about group_rows; each group packs best-fit decreasing,
    after which no two of its bins fit together, so at most one of them is half empty. Bins that
    cannot take even the emptiest are done. The half-empty ones become items: with as many of
    the emptiest others they are dealt into fewer groups and packed best-fit again, until the
    fills show that no two bins left anywhere fit together. Bins move between rounds, pieces
    only in the first and in the join that places them; ids move in neither. Groups hold a
    bounded number of rows; what comes to the driver is the number of bins of each fill.
    Null lengths are not allowed; an empty table gives an empty one; pieces of full length are
    sequences of their own; repeated rows are pieces of their own; names of columns are free.
    """
    import numpy as np

    row, bin_, at, fill, group, into, shift, new, total_, filled = unused(pieces, "row", "bin", "at", "fill", "group", "into", "shift", "new", "total", "filled")
    columns = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    base = cut(pieces.select(*columns).withColumn(row, F.monotonically_increasing_id()))
    light = [c for c, kind in base.dtypes if kind != "binary"]
    full = base.where(F.col("length") >= capacity).select(*columns, (-F.col(row) - 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    small = base.where(F.col("length") < capacity).select(*light)
    n = small.count()

    def best_fit_groups(names, at_name, fill_name):
        def run(pdf):
            ids, fills = pdf[names].to_numpy(), pdf[fill_name].to_numpy().astype(np.int64)
            order = np.lexsort((ids, -fills))
            bins, offsets = best_fit(fills[order].tolist(), capacity)
            new_bin, shifts = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
            new_bin[order], shifts[order] = bins, offsets
            total = np.bincount(new_bin, weights=fills, minlength=len(ids)).astype(np.int64)
            leader = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(leader, new_bin, ids)  # a bin is named after its smallest member, so names stay unique
            return pdf.assign(**{at_name: shifts, new: leader[new_bin], total_: total[new_bin]})

        return run

    def packed(df, groups, turn, name, out, size):
        """df with the bin each row of it goes into, its place there and the bin's fill, under the names out."""
        kinds = ", ".join(f"`{c}` {k}" for c, k in [*df.dtypes, (out[1], "long")]) + f", `{new}` long, `{total_}` long"
        dealt = df.withColumn(group, F.pmod(F.xxhash64(name, F.lit(turn)), F.lit(groups)))
        run = best_fit_groups(name, out[1], size)
        done = dealt.groupBy(group).applyInPandas(lambda pdf: run(pdf.drop(columns=[group])), kinds)
        return cut(done.withColumnRenamed(new, out[0]).withColumnRenamed(total_, out[2]))

    first = packed(small, max(1, -(-n // group_rows)), 0, row, (bin_, at, fill), "length")
    bins = first.where(F.col(row) == F.col(bin_)).select(bin_, fill)
    moves, turn = [], 1
    while True:
        # how many bins there are of each fill below capacity: at most `capacity` rows
        counts = sorted((r[fill], r["count"]) for r in bins.where(F.col(fill) < capacity).groupBy(fill).count().collect())
        lowest = [f for f, c in counts for _ in range(min(c, 2))][:2]
        if len(lowest) < 2 or sum(lowest) > capacity:
            break
        half = sum(c for f, c in counts if 2 * f <= capacity)
        wanted, most = 2 * half, 0
        for f, c in counts:
            most = f
            wanted -= c
            if wanted <= 0:
                break
        taking = sum(c for f, c in counts if f <= most)
        parts = max(1, -(-taking // group_rows))
        moved = packed(bins.where(F.col(fill) <= most), parts, turn, bin_, (into, shift, filled), fill)
        moves.append(moved.where((F.col(bin_) != F.col(into)) | (F.col(shift) > 0)).select(bin_, into, shift))
        kept = moved.where(F.col(bin_) == F.col(into)).select(bin_, F.col(filled).alias(fill))
        bins, turn = cut(bins.where(F.col(fill) > most).unionByName(kept)), turn + 1
    placed = first
    for move in moves:
        placed = placed.join(move, bin_, "left").withColumns({bin_: F.coalesce(into, bin_), at: F.col(at) + F.coalesce(F.col(shift), F.lit(0))}).drop(into, shift)
    if len(light) <= len(columns):
        placed = base.join(placed.select(row, bin_, at), row)
    return full.unionByName(placed.select(*columns, F.col(bin_).alias("sequence_id"), F.col(at).cast("long").alias("offset")))


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = True, group_rows: int = 40_000) -> DataFrame:
    """Documents to packed pieces: doc_id, piece, start, length, ids_crc32, ids, sequence_id, offset.

    Null and empty texts are the end id alone; very long ones are cut into pieces; columns other
    than doc_id and text are ignored.
    """
    pieces = tokenize_pieces(docs, tokenizer_path, capacity, end_id, with_ids)
    if not with_ids:
        pieces = pieces.drop("ids")
    return pack_pieces(pieces, capacity, group_rows)
