"""Hard negatives in windows under each positive's score, by slots between the positives' scores."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import cut

#: Numbers (rows times dimensions) a task holds of its group of rows; a tile of scores is 256 anchors by 8192 rows.
GROUP_CELLS, ANCHOR_TILE, ROW_TILE = 1 << 21, 256, 8192
LOW = -(2**63) + 1

PART = "anchor_id long, slot int, score long, vec_id long"


def integer_vector(vector: Column) -> Column:
    """floor(256*x) of each component as a long (a larger one becomes the nearest long); null where a component is null or not finite."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # beyond 2^55 a double is whole and 256 times it no long
    whole = lambda x: F.when(F.abs(x) < float(2**55), F.floor(x * 256)).otherwise(F.when(x > 0, F.lit(2**63 - 1)).otherwise(F.lit(-(2**63))))
    return F.when(fine, F.transform(v, whole))


def labelled_points(vectors: DataFrame) -> DataFrame:
    """vec_id, label, x: one row for each vec_id, the smallest (label, x) of those that share one; rows that lack anything are left out."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), integer_vector(F.col("embedding")).alias("x"))
    rows = rows.where("vec_id is not null and label is not null and x is not null")
    return rows.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("p")).select("vec_id", "p.label", "p.x")


def products(a, b):
    """Exact inner products of the rows of two int64 matrices, as int64; those beyond a long become the nearest one."""
    import numpy as np

    top = lambda m: float(np.abs(m.astype(np.float64)).max(initial=0))
    if not a.shape[1]:
        return np.zeros((len(a), len(b)), np.int64)
    if top(a) * top(b) * a.shape[1] < 2.0**53:  # no sum can round
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    out = np.empty((len(a), len(b)), np.int64)
    large = np.abs(b.astype(np.float64)).max(1) * top(a) * a.shape[1] >= 2.0**53
    out[:, ~large] = (a.astype(np.float64) @ b[~large].astype(np.float64).T).astype(np.int64)
    exact = a.astype(object) @ b[large].astype(object).T
    out[:, large] = np.clip(exact, LOW, 2**63 - 1).astype(np.int64)
    return out


def firsts(owner, score, ids, k):
    """Places of each owner's k first: higher score, then smaller id."""
    import numpy as np

    order = np.lexsort((ids, -score, owner))
    o = owner[order]
    new = np.r_[True, o[1:] != o[:-1]] if len(o) else np.zeros(0, bool)
    start = np.maximum.accumulate(np.where(new, np.arange(len(o)), 0)) if len(o) else new
    return order[np.arange(len(o)) - start < k]


def scored(points: DataFrame, anchors: DataFrame, groups: int, tiles) -> DataFrame:
    """PART rows of every group of points with all anchors(vec_id, label, x, limits).

    Points are dealt once, by hash, into groups that fit a task; anchors follow each group as a
    stream of batches behind its points, so a task holds its group and one batch. tiles(held,
    anchors) yields (anchor's place, slot, score, id) arrays cut to what a combiner keeps.
    """
    g = F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int")
    none = F.lit(None).cast("array<bigint>")
    dims = F.size("x").alias("dims")
    here = points.select(g.alias("g"), dims, F.lit(0).alias("kind"), "label", "vec_id", "x", none.alias("limits"))
    every = F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))
    there = anchors.select(every.alias("g"), dims, F.lit(1).alias("kind"), "label", "vec_id", "x", "limits")
    dealt = here.unionByName(there).repartitionById(groups, F.col("g")).sortWithinPartitions("g", "dims", "kind", "label", "vec_id")

    def run(batches):
        import numpy as np
        import pyarrow as pa

        key, gathered, held = None, [], None
        names = [f.split()[0] for f in PART.split(", ")]
        for batch in batches:
            g, d, kind = (batch.column(n).to_numpy() for n in ("g", "dims", "kind"))
            edges = np.flatnonzero((np.diff(g) != 0) | (np.diff(d) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *edges], [*edges, len(g)]):
                if a == b:
                    continue
                if key != (g[a], d[a]):
                    key, gathered, held = (g[a], d[a]), [], None
                one = batch.slice(a, b - a)
                x = one.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b - a, d[a])
                ids, labels = one.column("vec_id").to_numpy(), one.column("label").to_numpy()
                if kind[a] == 0:
                    gathered.append((ids, labels, x))
                    continue
                if not gathered:
                    continue
                if held is None:
                    held = tuple(np.concatenate(c) for c in zip(*gathered))
                limits = one.column("limits").to_pylist()
                for s in range(0, b - a, ANCHOR_TILE):
                    part = slice(s, s + ANCHOR_TILE)
                    for at, slot, score, found in tiles(held, (ids[part], labels[part], x[part], limits[part])):
                        yield pa.RecordBatch.from_arrays([pa.array(ids[part][at]), pa.array(slot.astype(np.int32)), pa.array(score), pa.array(found)], names=names)

    return dealt.mapInArrow(run, PART)


def same_label(k: int):
    """Tiles of the k nearest points that share the anchor's label."""

    def tiles(held, anchors):
        import numpy as np

        ids, labels, x = held
        asked, theirs, a, _ = anchors
        for label in np.unique(theirs):
            who = np.flatnonzero(theirs == label)
            lo, hi = np.searchsorted(labels, label), np.searchsorted(labels, label, "right")
            best = [np.zeros(0, np.int64)] * 3
            for s in range(lo, hi, ROW_TILE):
                e = min(hi, s + ROW_TILE)
                score = products(a[who], x[s:e])
                other = asked[who][:, None] != ids[s:e]
                if e - s > k + 1:
                    least = np.partition(np.where(other, score, LOW - 1), e - s - k, axis=1)[:, e - s - k, None]
                    other &= score >= least
                at, to = np.nonzero(other)
                best = [np.concatenate(c) for c in zip(best, (at, score[at, to], ids[s:e][to]))]
                best = [c[keep] for keep in [firsts(*best, k)] for c in best]
            yield who[best[0]], np.zeros(len(best[0])), best[1], best[2]

    return tiles


def in_slots(k: int, low: int, high: int):
    """Tiles of the k best points of another label in each slot between an anchor's falling limits."""

    def tiles(held, anchors):
        import numpy as np

        ids, labels, x = held
        _, theirs, a, limits = anchors
        width = max(map(len, limits))
        tops = np.array([[*o, *[LOW - 1] * (width - len(o))] for o in limits], np.int64)  # no score lies under an absent limit
        least = np.array([least_score(o[-1], low, high) for o in limits], np.int64)[:, None]
        best = [np.zeros(0, np.int64)] * 3
        for s in range(0, len(ids), ROW_TILE):
            score = products(a, x[s : s + ROW_TILE])
            at, to = np.nonzero((score <= tops[:, :1]) & (score >= least) & (theirs[:, None] != labels[s : s + ROW_TILE]))
            value = score[at, to]
            slot = (tops[at] >= value[:, None]).sum(1) - 1
            best = [np.concatenate(c) for c in zip(best, (at * width + slot, value, ids[s : s + ROW_TILE][to]))]
            best = [c[keep] for keep in [firsts(*best, k)] for c in best]
        yield best[0] // width, best[0] % width, best[1], best[2]

    return tiles


def least_score(score, low: int, high: int):
    """The smallest integer n with low*score <= high*n, for 0 <= score and 0 <= low <= high; of an int or a long column, without overflow for small fractions."""
    rest = Fraction(high - low, high)
    a, b = rest.numerator, rest.denominator
    if isinstance(score, Column):
        div = lambda x: F.call_function("div", x, F.lit(b).cast("long"))
        return score - div(score) * a - div(score % b * a)
    return score - score * a // b


def hard_negatives(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are the rows whose vec_id is divisible by `every`; their positives the first
    `positives` other rows of their label by integer inner product, ties to the smaller vec_id.
    Each positive gets the first `negatives` rows of another label with low*positive <=
    high*negative <= high*positive. A positive of negative score has an empty window.

    The windows of an anchor overlap, so they are not searched one by one: its positives' scores
    are limits that split all scores into disjoint slots, every task keeps the best few rows of
    each slot, and going down from the lowest slot the merged slots answer each window's upper
    limit; what falls under its lower limit goes last, since it comes last.

    Rows without vec_id, label or vector, or with a component that is null or not finite, take
    no part; rows meet those of their own dimension; a vec_id counts once (labelled_points);
    products beyond a long count as the nearest long. Other columns are ignored; an empty table
    gives none. Labels of any size are alike: points are dealt by vec_id, anchors to all groups.
    """
    points = cut(labelled_points(vectors))
    n, dims = points.agg(F.count("*"), F.max(F.size("x"))).first()
    groups = max(1, -(-n * max(dims or 1, 1) // GROUP_CELLS), min(points.sparkSession.sparkContext.defaultParallelism, n // 256))
    chosen = points.where(F.col("vec_id") % every == 0)
    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "vec_id")

    near = scored(points, chosen.withColumn("limits", F.lit(None).cast("array<bigint>")), groups, same_label(positives))
    near = near.withColumn("r", F.row_number().over(first)).where(F.col("r") <= positives)
    ranked = F.sort_array(F.collect_list(F.struct("r", "score", "vec_id")))
    asked = cut(near.where("score >= 0").groupBy("anchor_id").agg(ranked.alias("positives")))  # at most `positives` a group

    limited = chosen.join(asked.select(F.col("anchor_id").alias("vec_id"), F.transform("positives", lambda p: p["score"]).alias("limits")), "vec_id")
    parts = scored(points, limited, groups, in_slots(negatives, low, high))
    slot = Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id")
    best = parts.withColumn("r", F.row_number().over(slot)).where(F.col("r") <= negatives)
    slots = best.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("slot", "r", "score", "vec_id"))).alias("found"))  # negatives x positives at most

    def down(merged, s):
        own = F.filter("found", lambda x: x["slot"] == s)
        return F.concat(F.array(F.slice(F.concat(own, F.coalesce(F.get(merged, F.lit(0)), F.array().cast(kind))), 1, negatives)), merged)

    kind = slots.schema["found"].dataType.simpleString()
    falling = F.array(*[F.lit(s) for s in reversed(range(positives))])
    merged = slots.select("anchor_id", F.aggregate(falling, F.array().cast(f"array<{kind}>"), down).alias("under"))
    windows = asked.select("anchor_id", F.posexplode("positives").alias("i", "p")).join(merged, "anchor_id")
    fits = F.filter(F.get("under", F.col("i")), lambda x: x["score"] >= least_score(F.col("p.score"), low, high))
    out = windows.select("anchor_id", "p", F.posexplode(fits).alias("at", "n"))
    return out.select(
        "anchor_id", F.col("p.vec_id").alias("positive_id"), (F.col("at") + 1).cast("int").alias("rank"), F.col("n.vec_id").alias("negative_id"),
        F.col("p.score").alias("positive_score"), F.col("n.score").alias("negative_score"),
    )
