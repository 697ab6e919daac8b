"""Approximate nearest neighbours: a navigable small-world graph for each shard, results merged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Links a node keeps above the ground layer and on it, and beam widths for building and searching.
LINKS, GROUND_LINKS, BUILD_BEAM, SEARCH_BEAM = 16, 32, 64, 128
#: Distinct vectors in a shard of a small table; queries in a block; cells of a walk's table of seen points.
SHARD_ROWS, BLOCK_ROWS, SEEN_CELLS = 8192, 512, 1 << 25
#: Bytes of a shard's points at most (but SHARD_ROWS always fit); points up to which the search beam is enough as it is.
SHARD_BYTES, BEAM_POINTS = 32 << 20, 20_000


class Graph:
    """Layers of flat neighbour arrays (-1: none) over float32 points; nearness is squared distance.

    Points go in by batches: each batch walks the graph as it stands, greedily down the upper
    layers and with a beam on its own, links to a spread-out choice of what it found, and the
    links back are pruned the same way. All members of a batch take their steps together.
    """

    def __init__(self, x, seed: int = 42):
        import numpy as np

        self.x = np.ascontiguousarray(x, np.float32)
        n = len(self.x)
        level = (-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int)
        order = np.argsort(-level, kind="stable")  # the tall ones first, so every layer's entry exists
        self.top = int(level[order[0]]) if n else 0
        self.layers = [np.full((n, GROUND_LINKS if k == 0 else LINKS), -1, np.int32) for k in range(self.top + 1)]
        self.entry = int(order[0]) if n else -1
        self.norm = np.einsum("ij,ij->i", self.x, self.x)
        at = 1
        while at < n:
            batch = order[at : at + max(1, min(256, at // 4))]
            self._insert(batch, level)
            at += len(batch)

    def _insert(self, batch, level):
        import numpy as np

        q = self.x[batch]
        entry = np.full((len(batch), 1), self.entry, np.int32)
        for k in range(self.top, -1, -1):
            stays = level[batch] >= k
            found, dist = self._beam(k, q, entry, BUILD_BEAM if stays.any() else 1)
            if stays.any():
                chosen = self._spread(found[stays], dist[stays], self.layers[k].shape[1] // 2 if k == 0 else LINKS)
                self.layers[k][batch[stays], : chosen.shape[1]] = chosen
                self._link_back(k, batch[stays], chosen)
            entry = found[:, : min(4, found.shape[1])]

    def _beam(self, k, q, entry, width, expand: int = 4):
        """The `width` nearest points met from the entry points, nearest first: ids (-1: none), distances."""
        import numpy as np

        most = max(1, SEEN_CELLS // (len(self.x) + 1))
        if len(q) > most:
            parts = [self._beam(k, q[a : a + most], entry[a : a + most], width, expand) for a in range(0, len(q), most)]
            return tuple(np.concatenate(p) for p in zip(*parts))
        links, n, m = self.layers[k], len(self.x), len(q)
        qn = np.einsum("ij,ij->i", q, q)
        ids = np.full((m, width), -1, np.int32)
        dist = np.full((m, width), np.inf, np.float32)
        done = np.zeros((m, width), bool)
        seen = np.zeros((m, n + 1), bool)
        seen[:, n] = True  # where -1 points
        rows = np.arange(m)

        def merge(rows, new):
            new = np.sort(new, axis=1)
            new[:, 1:][new[:, 1:] == new[:, :-1]] = -1
            new[seen[rows[:, None], new]] = -1
            seen[rows[:, None], new] = True
            d = self.norm[new] + qn[rows, None] - 2 * np.matmul(self.x[new], q[rows, :, None])[..., 0]
            d[new < 0] = np.inf
            all_d = np.concatenate([dist[rows], d], axis=1)
            all_i = np.concatenate([ids[rows], new], axis=1)
            all_f = np.concatenate([done[rows], np.zeros(new.shape, bool)], axis=1)
            best = np.argpartition(all_d, width - 1, axis=1)[:, :width] if all_d.shape[1] > width else np.tile(np.arange(all_d.shape[1]), (len(rows), 1))
            near = np.take_along_axis(all_d, best, 1)
            by = np.argsort(near, axis=1, kind="stable")
            best = np.take_along_axis(best, by, 1)
            dist[rows] = np.take_along_axis(all_d, best, 1)
            ids[rows] = np.take_along_axis(all_i, best, 1)
            done[rows] = np.take_along_axis(all_f, best, 1)

        merge(rows, entry.astype(np.int32))
        while len(rows):
            waiting = ~done[rows] & (ids[rows] >= 0)
            rows, waiting = rows[waiting.any(1)], waiting[waiting.any(1)]
            if not len(rows):
                break
            pick = waiting & (np.cumsum(waiting, axis=1) <= expand)
            done[rows] |= pick
            r, c = np.nonzero(pick)
            slot = np.cumsum(pick, axis=1)[r, c] - 1
            new = np.full((len(rows), expand, links.shape[1]), -1, np.int32)
            new[r, slot] = links[ids[rows[r], c]]
            merge(rows, new.reshape(len(rows), -1))
        return ids, dist

    def _spread(self, ids, dist, most):
        """Of each row's candidates, nearest first, those nearer to the point than to any taken before; then the nearest rest."""
        import numpy as np

        ids, dist = ids.copy(), np.where(ids < 0, np.inf, dist)
        p = self.x[ids]
        sq = self.norm[ids]
        between = sq[:, :, None] + sq[:, None, :] - 2 * np.matmul(p, p.transpose(0, 2, 1))
        width = ids.shape[1]
        close = np.full(ids.shape, np.inf, np.float32)
        taken = np.zeros(ids.shape, bool)
        for j in range(width):
            take = (close[:, j] > dist[:, j]) & np.isfinite(dist[:, j]) & (taken.sum(1) < most)
            taken[:, j] = take
            close = np.where(take[:, None], np.minimum(close, between[:, j]), close)
        rank = np.where(taken, 0, np.where(np.isfinite(dist), 1, 2)) * width + np.arange(width)
        first = np.argsort(rank, axis=1)[:, :most]
        out = np.take_along_axis(ids, first, 1)
        out[~np.isfinite(np.take_along_axis(dist, first, 1))] = -1
        return out

    def _link_back(self, k, points, chosen):
        import numpy as np

        links = self.layers[k]
        to, which = chosen.ravel(), np.repeat(points, chosen.shape[1])
        ok = to >= 0
        by = np.argsort(to[ok], kind="stable")
        to, which = to[ok][by], which[ok][by]
        nodes, start, counts = np.unique(to, return_index=True, return_counts=True)
        widest = int(counts.max()) if len(counts) else 0
        slot = np.arange(len(to)) - np.repeat(start, counts)
        extra = np.full((len(nodes), widest), -1, np.int32)
        extra[np.repeat(np.arange(len(nodes)), counts), slot] = which
        step = max(1, 400_000 // (links.shape[1] + widest) ** 2 * 4)
        for a in range(0, len(nodes), step):
            own = nodes[a : a + step]
            cand = np.concatenate([links[own], extra[a : a + step]], axis=1)
            d = self.norm[cand] + self.norm[own, None] - 2 * np.matmul(self.x[cand], self.x[own][:, :, None])[..., 0]
            d[cand < 0] = np.inf
            by = np.argsort(d, axis=1, kind="stable")
            cand, d = np.take_along_axis(cand, by, 1), np.take_along_axis(d, by, 1)
            links[own] = self._spread(cand, d, links.shape[1])

    def search(self, q, width):
        import numpy as np

        q = np.ascontiguousarray(q, np.float32)
        entry = np.full((len(q), 1), self.entry, np.int32)
        for k in range(self.top, 0, -1):
            entry = self._beam(k, q, entry, 4)[0]
        return self._beam(0, q, entry, width)[0]

    def packed(self) -> dict:
        return {"entry": self.entry, "layers": b"".join(x.tobytes() for x in self.layers), "heights": [x.shape[1] for x in self.layers]}

    @classmethod
    def unpacked(cls, x, entry, layers, heights):
        import numpy as np

        g = cls.__new__(cls)
        g.x, g.entry, g.top = np.ascontiguousarray(x, np.float32), entry, len(heights) - 1
        g.norm = np.einsum("ij,ij->i", g.x, g.x)
        flat, at, g.layers = np.frombuffer(layers, np.int32), 0, []
        for h in heights:
            g.layers.append(flat[at : at + h * len(x)].reshape(len(x), h))
            at += h * len(x)
        return g


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array<double>), and a 128-bit identity (h, g) of the vectors that take part.

    Null vectors, null or non-finite components and zero vectors do not; neither do rows
    without vec_id. Rows that repeat a vec_id with the same vector count once.
    """
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))
        .where("vec_id is not null and v is not null").where(F.coalesce(fine, F.lit(False)))
        .select("vec_id", "v", F.xxhash64("v").alias("h"), F.xxhash64(F.reverse("v"), F.size("v")).alias("g"))
        .dropDuplicates(["vec_id", "h", "g"])
    )


def octave() -> Column:
    """The binary exponent of v's length, without overflow."""
    largest = F.array_max(F.transform("v", lambda x: F.abs(x)))
    return F.floor(F.log2(largest) + F.log2(F.aggregate("v", F.lit(0.0), lambda a, x: a + (x / largest) * (x / largest))) / 2).cast("int")


def build_index(vectors: DataFrame, keep_ids: int, shard_rows: int = SHARD_ROWS, seed: int = 42) -> DataFrame:
    """One row per shard: shard, dims, n, points, extra, ids, id_counts, entry, layers, heights.

    Equal vectors are one point that carries its keep_ids smallest vec_ids (a search for fewer
    never needs more). Points are dealt by length, within a factor of two, and there by hash to
    shards of about shard_rows; beyond shard_rows points in all, shards grow with the root of
    their number, and so does the number of shards, until a shard's points take SHARD_BYTES. A shard's points are scaled by its longest,
    and an extra coordinate turns the largest inner product into the nearest point; as lengths
    in a shard differ by two at most, one huge vector takes nothing from the others. ids, points
    and layers are flat little-endian arrays.
    """
    rows = usable(vectors)
    first = Window.partitionBy("h", "g").orderBy("vec_id")
    few = rows.withColumn("r", F.row_number().over(first)).where(F.col("r") <= keep_ids)
    points = cut(few.groupBy("h", "g").agg(F.first("v").alias("v"), F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumns({"dims": F.size("v"), "band": octave()}))
    n = points.count()
    widest = points.agg(F.max("dims")).first()[0] or 1
    rows_each = max(shard_rows, min(int((n * shard_rows) ** 0.5), SHARD_BYTES // (8 * widest)))
    bands = points.groupBy("dims", "band").agg(F.ceil(F.count("*") / rows_each).cast("long").alias("parts"))  # some thousand rows at most: exponents of doubles

    def build(pdf):
        import numpy as np
        import pandas as pd

        pdf = pdf.sort_values(["h", "g"])
        x = np.stack(pdf["v"].to_list()).astype(np.float64)
        scaled = x / abs(x).max()
        square = (scaled * scaled).sum(1)
        scaled = np.c_[scaled, np.sqrt(np.maximum(square.max() - square, 0))] / np.sqrt(square.max())
        g = Graph(scaled, seed)
        made = g.packed()
        return pd.DataFrame(
            [{
                "shard": int(pdf["shard"].iloc[0]), "dims": x.shape[1], "n": len(x), "points": x.astype("<f8").tobytes(), "places": g.x.astype("<f4").tobytes(),
                "ids": np.concatenate(pdf["ids"].to_list()).astype("<i8").tobytes(), "id_counts": np.array([len(i) for i in pdf["ids"]], "<i4").tobytes(),
                "entry": made["entry"], "layers": made["layers"], "heights": made["heights"],
            }]
        )

    schema = "shard long, dims int, n int, points binary, places binary, ids binary, id_counts binary, entry int, layers binary, heights array<int>"
    shard = F.xxhash64("band", F.pmod(F.xxhash64("h", "g"), F.col("parts")))
    dealt = points.join(F.broadcast(bands), ["dims", "band"]).withColumn("shard", shard).drop("band", "parts")
    return cut(dealt.groupBy("dims", "shard").applyInPandas(build, schema))


def search_index(index: DataFrame, queries: DataFrame, k: int, beam: int = SEARCH_BEAM) -> DataFrame:
    """h, g, vec_id, score: the k best of each distinct query vector queries(h, g, v), by inner product.

    A shard crosses to Python once a slice of the queries: its row comes first in its task and
    the queries of its dimension follow as a stream of batches, each cut to k a query before it
    is merged. There are as many slices as keep all cores busy, so one where shards are many.
    The beam grows with the root of a shard's points beyond BEAM_POINTS. A walk that ends with
    fewer than k ids where the shard has more is made good by scoring the whole shard. Scores
    are inner products of the original vectors in double precision; ties go to the smaller vec_id.
    """
    spark = index.sparkSession
    shards = index.select("dims", "shard").collect()  # two numbers a shard
    slices = max(1, -(-spark.sparkContext.defaultParallelism // max(1, len(shards))))
    meets = spark.createDataFrame([(r["dims"], r["shard"], i) for i, r in enumerate(shards)], "dims int, shard long, place int")
    each = F.broadcast(meets)
    task = lambda s: (F.col("place") * slices + s).cast("int").alias("task")
    flat = ["shard", "n", "points", "places", "ids", "id_counts", "entry", "layers", "heights"]
    kinds = dict(index.dtypes)
    # numbers are 0 where they mean nothing, since pandas would make floats of columns with nulls
    none = [(F.lit(0) if kinds[c] in ("int", "bigint") else F.lit(None)).cast(kinds[c]).alias(c) for c in flat]
    held = index.join(each, ["dims", "shard"]).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
    held = held.select(task(F.col("s")), F.lit(0).alias("kind"), "dims", *flat, F.lit(0).cast("long").alias("h"), F.lit(0).cast("long").alias("g"), F.lit(None).cast("array<double>").alias("v"))
    asked = queries.withColumn("dims", F.size("v")).join(each.drop("shard"), "dims")
    asked = asked.select(task(F.pmod(F.xxhash64("g", "h"), F.lit(slices))), F.lit(1).alias("kind"), "dims", *none, "h", "g", "v")
    dealt = held.unionByName(asked).repartitionById(max(1, len(shards) * slices), F.col("task")).sortWithinPartitions("task", "kind")

    def run(batches):
        import numpy as np
        import pandas as pd

        graph = None
        for pdf in batches:
            first = pdf[pdf["kind"] == 0]
            if len(first):  # a partition is one task: its shard, then queries
                r = first.iloc[0]
                x = np.frombuffer(r["points"], "<f8").reshape(int(r["n"]), r["dims"])
                graph = Graph.unpacked(np.frombuffer(r["places"], "<f4").reshape(int(r["n"]), r["dims"] + 1), int(r["entry"]), r["layers"], list(r["heights"]))
                counts = np.frombuffer(r["id_counts"], "<i4")
                starts, ids = np.r_[0, np.cumsum(counts)], np.frombuffer(r["ids"], "<i8")
                wide = int(max(beam, k) * max(1.0, len(x) / BEAM_POINTS) ** 0.5)
            asked = pdf[pdf["kind"] == 1]
            for at in range(0, len(asked), BLOCK_ROWS):
                some = asked.iloc[at : at + BLOCK_ROWS]
                q = np.stack(some["v"].to_list()).astype(np.float64)
                unit = q / abs(q).max(1, keepdims=True)
                unit /= np.sqrt((unit * unit).sum(1, keepdims=True))
                found = graph.search(np.c_[unit, np.zeros(len(q))], wide)
                out = []
                with np.errstate(over="ignore", invalid="ignore"):
                    for h, g, near, one in zip(some["h"].to_numpy(), some["g"].to_numpy(), found, q):
                        near = near[near >= 0]
                        if counts[near].sum() < min(k, len(ids)):
                            near = np.arange(len(x))
                        score = np.repeat((x[near] * one).sum(1), counts[near])
                        each = np.concatenate([ids[starts[i] : starts[i + 1]] for i in near])
                        best = np.lexsort((each, -score))[:k]
                        out.append(pd.DataFrame({"h": h, "g": g, "vec_id": each[best], "score": score[best]}))
                yield pd.concat(out)

    found = dealt.mapInPandas(run, "h long, g long, vec_id long, score double")
    best = Window.partitionBy("h", "g").orderBy(F.desc(F.nanvl("score", F.lit(float("-inf")))), "vec_id")
    return found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k).drop("r")


def nearest(vectors: DataFrame, k: int = 20, every: int = 20, shard_rows: int = SHARD_ROWS, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest of every row whose vec_id is divisible by `every`.

    All other rows are candidates. Equal query vectors are searched once and dealt out to their
    ids afterwards. With fewer candidates than k all are returned; an empty table gives none.
    Null, zero and non-finite vectors take no part; vectors meet those of their own dimension;
    products beyond double precision rank last where they are no number; other columns are
    ignored.
    """
    index = build_index(vectors, k + 1, shard_rows)
    asked = cut(usable(vectors).where(F.col("vec_id") % every == 0))
    distinct = cut(asked.groupBy("h", "g").agg(F.first("v").alias("v")))
    found = cut(search_index(index, distinct, k + 1, beam))
    best = Window.partitionBy("query_id").orderBy(F.desc(F.nanvl("score", F.lit(float("-inf")))), "vec_id")
    return (
        asked.select(F.col("vec_id").alias("query_id"), "h", "g").join(found, ["h", "g"]).where("vec_id <> query_id")
        .withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
