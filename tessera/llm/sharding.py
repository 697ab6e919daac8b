"""Shards of near-equal size by sampled splitters. Plain DataFrame operations throughout."""

from __future__ import annotations

import bisect
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut, own, unused

#: Rows a range holds about, ranges at most, and keys drawn a range: what reaches the driver is MOST_RANGES * KEYS_EACH keys at most, in expectation.
RANGE_ROWS, MOST_RANGES, KEYS_EACH = 500, 4096, 32
#: A range with over this many times its share of the rows or bytes is subdivided.
OVERFULL = 2.0


def group_key(group: Column) -> Column:
    """60 bits of the group's MD5: equal groups lie side by side, different ones anywhere."""
    return F.conv(F.substring(F.md5(F.coalesce(group.cast("binary"), F.lit(b""))), 1, 15), 16, 10).cast("long")


def shard(records: DataFrame, key: Column, order: Column, size: Column | None = None, shards: int = 8) -> DataFrame:
    """records with shard (0 to shards-1) and slot (gapless from 0 in each shard).

    Records stand in one order, by key (a long, as group_key makes it), then by order (a long),
    then as they were read; the order is cut where its running size passes each shard's share, at the record end that is
    nearest. So shards differ from their share by half a record at either end, and a group lies
    in one shard unless a cut falls into it. Without size each record counts one and shards
    differ by one record at most.

    The order is never sorted whole. Keys are drawn with a chance that grows with their share of
    the bytes and of the rows; their weighted quantiles split the keys into ranges, an overfull
    range is drawn from again and subdivided (every key is unique, so a group of any size can
    be), each range is sorted by its own task, and the ranges' exact sums place it in the whole.
    Which keys are drawn changes the tasks' work only, never the result.

    A null key or order comes first, null or negative sizes count 0; if
    all sizes are 0, each record counts one. Repeated rows are placed one by one. Extra columns
    stay, whatever their names; an empty table gives none. Long texts travel as any column does:
    project first if only the numbers are wanted.
    """
    h, t, w, nth = unused(records, "h", "t", "w", "nth")
    kept = own(records)
    weight = F.lit(1).cast("long") if size is None else F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0))
    keyed = records.select(*kept, F.coalesce(key.cast("long"), F.lit(-(2**63))).alias(h), F.coalesce(order.cast("long"), F.lit(-(2**63))).alias(t), weight.alias(w), F.monotonically_increasing_id().alias(nth))
    return _dealt(cut(keyed), kept, (h, t, nth), w, shards)


def _dealt(rows: DataFrame, kept: list[Column], key: tuple[str, ...], w: str, shards: int) -> DataFrame:
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum(w), F.lit(0))).first()
    if not total:
        rows, total = rows.withColumn(w, F.lit(1).cast("long")), max(n, 1)
    n = max(n, 1)
    ranges = max(1, min(MOST_RANGES, -(-n // RANGE_ROWS)))

    def share(size, count):
        return size / total + count / n

    def drawn(df: DataFrame, keys: float, of: float) -> list[tuple[tuple, float]]:
        """Keys with what each stands for; `keys` of them in expectation from rows that share `of`."""
        chance = share(F.col(w), 1) * (keys / of)
        u = F.shiftrightunsigned(F.xxhash64(*key, F.lit(ranges), F.lit(keys)), 11) / float(1 << 53)
        got = df.where(u < chance).select(*key, w).collect()
        return sorted((tuple(r)[:3], max(share(r[3], 1), of / keys)) for r in got)

    def quantiles(sample: list, parts: int) -> list[tuple]:
        cuts, held, whole = [], 0.0, sum(x for _, x in sample)
        for k, x in sample:
            if held >= (len(cuts) + 1) * whole / parts and (not cuts or cuts[-1] != k):
                cuts.append(k)
                if len(cuts) == parts - 1:
                    break
            held += x
        return cuts

    place = F.struct(*[F.col(k).alias(f"k{i}") for i, k in enumerate(key)])
    number, before, first, running, row, shard_, slot_ = unused(rows, "range", "before", "first", "running", "row", "shard", "slot")

    def literal(values: list, kind: str) -> Column:
        """One constant, which the optimizer folds, however long the list is."""
        return F.from_json(F.lit(json.dumps(values)), f"array<{kind}>")

    def within(df: DataFrame, cuts: list[tuple]) -> DataFrame:
        """df with its range, found by halving the splitters."""
        if not cuts:
            return df.withColumn(number, F.lit(0))
        splitters = literal([dict(zip(("k0", "k1", "k2"), c)) for c in cuts], "struct<k0:bigint,k1:bigint,k2:bigint>")
        steps = F.array(*[F.lit(1 << b) for b in reversed(range(len(cuts).bit_length()))])
        return df.withColumn(number, F.aggregate(steps, F.lit(0), lambda at, s: F.when((at + s <= len(cuts)) & (F.try_element_at(splitters, at + s) <= place), at + s).otherwise(at)))

    cuts = quantiles(drawn(rows, KEYS_EACH * ranges, 2.0), ranges)
    while True:
        found = within(rows, cuts).groupBy(number).agg(F.sum(w), F.count("*"), F.max(w)).collect()  # one row a range
        full = {r[0]: r for r in found if r[2] > 1 and (r[2] > OVERFULL * n / ranges + 1 or r[1] - r[3] > OVERFULL * total / ranges)}
        fresh = []
        if full:
            at, of = within(rows, cuts).where(F.col(number).isin(*full)), sum(share(r[1], r[2]) for r in full.values())
            parts = {i: max(2, round(share(r[1], r[2]) * ranges / 2) + 1) for i, r in full.items()}
            by: dict[int, list] = {i: [] for i in full}
            for k, x in drawn(at, KEYS_EACH * sum(parts.values()), of):
                by[bisect.bisect_right(cuts, k)].append((k, x))
            fresh = [k for i, sample in by.items() for k in quantiles(sample, parts[i])]
        more = sorted({*cuts, *fresh})
        if len(more) == len(cuts):
            break
        cuts = more

    each = {r[0]: (r[1], r[2]) for r in found}
    sizes, counts = [0], [0]
    for i in range(len(cuts) + 1):
        s, c = each.get(i, (0, 0))
        sizes.append(sizes[-1] + s)
        counts.append(counts[-1] + c)

    ordered = Window.partitionBy(number).orderBy(*key)

    def placed(some: list[int] | None = None) -> DataFrame:
        df = within(rows, cuts)
        df = df if some is None else df.where(F.col(number).isin(*some))
        df = df.withColumns({before: F.element_at(literal(sizes, "bigint"), F.col(number) + 1), first: F.element_at(literal(counts, "bigint"), F.col(number) + 1)})
        df = df.withColumns({running: F.col(before) + F.sum(w).over(ordered.rowsBetween(Window.unboundedPreceding, 0)) - F.col(w), row: F.col(first) + F.row_number().over(ordered) - 1})
        middle = F.expr(f"({shards} * (2 * `{running}` + `{w}`)) div {2 * total}")
        return df.withColumn(shard_, F.least(middle, F.lit(shards - 1)).cast("int"))

    # rows before each shard: whole ranges lie in one shard, and only those with a cut in them are counted by row
    crossing = [i for i in each if any(shards * sizes[i] <= s * total <= shards * sizes[i + 1] for s in range(1, shards))]
    rows_of = [0] * shards
    for i, (_, c) in each.items():
        if i not in crossing:
            rows_of[min(shards - 1, shards * sizes[i] // total)] += c
    if crossing:
        for r in placed(crossing).groupBy(shard_).count().collect():
            rows_of[r[0]] += r[1]
    starts = [sum(rows_of[:s]) for s in range(shards)]
    slot = F.col(row) - F.element_at(F.array(*[F.lit(s).cast("long") for s in starts]), F.col(shard_) + 1)
    return placed().select(*kept, F.col(shard_), slot.cast("long").alias(slot_))


def write_shards(sharded: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """Sharded records as Parquet, a folder a shard, files of rows_per_file in slot order."""
    sharded.repartition("shard", F.floor(F.col("slot") / rows_per_file)).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def shard_digest(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard: documents dealt by bytes; equal texts are groups.

    Null texts are empty; other columns of docs are ignored; the texts themselves are read once
    and do not travel.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), group_key(text).alias("key"))
    dealt = shard(slim, F.col("key"), F.col("doc_id"), F.col("size"), shards)
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
