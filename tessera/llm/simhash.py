"""SimHash near-duplicates: fingerprints of word shingles, linked through BK-trees."""

from __future__ import annotations

from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import connected_components, cut, own, text_of, texts, unused


def fingerprint_column(shingle: int = 3, seed: int = 42):
    """Scalar function of a text column: its 64 bits as a signed long; see fingerprints."""

    @F.pandas_udf("long")
    def fp(texts: pd.Series) -> pd.Series:
        import numpy as np
        import xxhash

        table = ((np.arange(256)[:, None] >> np.arange(8)) & 1).astype(np.int64)
        digest = xxhash.xxh64_intdigest
        weights = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))

        def fingerprint(text):
            words = text.encode().lower().split()
            if not words:
                return 0
            if len(words) <= shingle:
                grams = [b" ".join(words)]
            else:
                grams = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
            h = np.fromiter((digest(g, seed) for g in grams), np.uint64)
            by = h.astype("<u8").view(np.uint8).reshape(-1, 8)
            ones = np.concatenate([np.bincount(by[:, j], minlength=256) @ table for j in range(8)])
            return int((weights[2 * ones > len(h)]).sum(dtype=np.uint64).astype(np.int64))

        return pd.Series([fingerprint(t) for t in texts], dtype="int64")

    return fp


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) of every row of docs(doc_id, text).

    Words are runs of non-ASCII-space bytes with A-Z lowered; shingles repeat as they occur; a
    shorter text is one shingle, a text without words has fingerprint 0. A bit is set where
    more than half of the shingles' XXH64 values have it. Very long texts are hashed whole. No
    shuffle; columns other than doc_id and text are ignored.
    """
    return texts(docs).select("doc_id", fingerprint_column(shingle, seed)("text").alias("fp"))


def bk_links(shard, fp, radius: int = 3, dense: int = 256, budget: int = 1_000_000):
    """Spanning links of fingerprints within radius bits, among those of equal shard.

    shard, fp: numpy int64 and uint64, fp distinct within a shard. Returns index arrays (i, j)
    whose links connect what all pairs within radius connect. One BK-tree grows in each shard:
    a node's children are keyed by their integer Hamming distance to it, kept as one sorted
    array of (node, distance) keys; a search follows the edges within radius of its distance.
    In shards of over `dense` members those one bit apart are joined first, and the largest
    such set does not search the tree: only the others do, so a crowd of near copies costs
    little more than its outliers.
    """
    import numpy as np

    order = np.lexsort((fp, shard))
    shard, fp = shard[order], fp[order]
    n = len(fp)
    label = np.arange(n)
    if n < 2:
        return order[:0], order[:0]
    starts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]])
    sizes = np.diff(np.r_[starts, n])
    keep = sizes > 1
    root = np.repeat(starts, sizes)
    alive = np.repeat(keep, sizes)

    def union(a, b):
        while len(a):
            low = np.minimum(label[a], label[b])
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            while True:
                up = label[label]
                if (up == label).all():
                    break
                label[:] = up
            far = label[a] != label[b]
            a, b = a[far], b[far]

    # the trees, level by level: the first of each (node, distance) becomes that edge's child
    active = np.flatnonzero(alive & (root != np.arange(n)))
    at = root[active]
    keys, kids = [], []
    while len(active):
        key = at * 65 + np.bitwise_count(fp[active] ^ fp[at]).astype(np.int64)
        by = np.argsort(key, kind="stable")
        active, key = active[by], key[by]
        first = np.r_[True, key[1:] != key[:-1]]
        keys.append(key[first])
        kids.append(active[first])
        at = np.repeat(active[first], np.diff(np.r_[np.flatnonzero(first), len(key)]))
        active, at = active[~first], at[~first]
    if not keys:
        return order[:0], order[:0]
    keys, kids = np.concatenate(keys), np.concatenate(kids)
    by = np.argsort(keys)
    keys, kids = keys[by], kids[by]

    searching = alive.copy()
    for s, size in zip(starts[sizes > dense], sizes[sizes > dense]):
        part = fp[s : s + size]
        for bit in range(64):
            other = part ^ np.uint64(1 << bit)
            to = np.minimum(np.searchsorted(part, other), size - 1)
            hit = np.flatnonzero(part[to] == other)
            union(s + hit, s + to[hit])
        own = label[s : s + size]
        values, counts = np.unique(own, return_counts=True)
        searching[s : s + size] = own != values[counts.argmax()]

    queries = np.flatnonzero(searching)
    cost = np.cumsum(np.repeat(sizes, sizes)[queries])
    for chunk in np.split(queries, np.searchsorted(cost, np.arange(budget, cost[-1] if len(cost) else 0, budget))):
        q, node = chunk, root[chunk]
        while len(q):
            d = np.bitwise_count(fp[q] ^ fp[node]).astype(np.int64)
            near = (d <= radius) & (q != node)
            union(q[near], node[near])
            lo = np.searchsorted(keys, node * 65 + np.maximum(d - radius, 0))
            hi = np.searchsorted(keys, node * 65 + np.minimum(d + radius, 64), side="right")
            width = np.maximum(hi - lo, 0)
            total = int(width.sum())
            if not total:
                break
            q = np.repeat(q, width)
            node = kids[np.repeat(lo - np.cumsum(width) + width, width) + np.arange(total)]
    linked = np.flatnonzero(label != np.arange(n))
    return order[linked], order[label[linked]]


def shard_plan(n: int, radius: int) -> tuple[int, int]:
    """(blocks, agree): how many blocks the 64 bits are cut into and how many of them name a shard.

    Words that differ in at most radius bits agree on blocks - radius of the blocks at least, so
    any choice finds all links. With more words shards are named by more bits, at the price of
    more of them for each word, so that a shard of random words keeps a bounded size.
    """
    for more in range(3):
        blocks = radius + 1 + more
        if n >> (64 // blocks * (blocks - radius)) < 1_000:
            break
    return blocks, blocks - radius


#: Members from which a shard is split by further bits; fingerprints that a task holds at once, beyond one shard.
CROWD, STEP_PRINTS = 20_000, 200_000


def masked(mask: int) -> Column:
    return F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask))


def link_fingerprints(distinct: DataFrame, radius: int = 3, crowd: int | None = None) -> DataFrame:
    """Links (a, b) spanning every set of fingerprints joined by steps of at most radius bits.

    distinct(fp). Fingerprints are dealt to the shards of shard_plan; each has its own BK-tree. A
    shard of over `crowd` members, as one template makes, is split: its members agree on the bits
    that name it, so two of them within the radius also agree on one of radius + 1 blocks of the
    other bits, and those name its parts. Tasks read shards one after the other, a bounded number
    of fingerprints at a time.
    """
    crowd = CROWD if crowd is None else crowd
    blocks, agree = shard_plan(distinct.count(), radius)
    width = 64 // blocks
    names, further = [], []
    for k, chosen in enumerate(combinations(range(blocks), agree)):
        mask = sum(((1 << width) - 1) << (b * width) for b in chosen)
        name = masked(mask) if blocks == 1 else F.xxhash64(masked(mask), F.lit(k))  # shards of one name merely share a tree
        names.append(F.struct(F.lit(k).alias("k"), name.alias("shard")))
        rest = [b for b in range(64) if not mask >> b & 1]
        cuts = [sum(1 << b for b in rest[j :: radius + 1]) for j in range(radius + 1)]
        further.append(F.when(F.col("k") == k, F.array(*[F.xxhash64("shard", masked(c), F.lit(j)) for j, c in enumerate(cuts)])))
    dealt = distinct.select("fp", F.explode(F.array(*names)).alias("x")).select("fp", "x.k", "x.shard")
    crowded = cut(dealt.groupBy("shard").count().where(F.col("count") > crowd).select("shard"))
    if not crowded.isEmpty():
        parts = dealt.join(crowded, "shard", "left_semi").select("fp", F.explode(F.coalesce(*further)).alias("shard"))
        dealt = dealt.join(crowded, "shard", "left_anti").select("fp", "shard").unionByName(parts)
    dealt = dealt.select("shard", "fp").repartition("shard").sortWithinPartitions("shard")

    def search(batches):
        import numpy as np
        import pandas as pd

        held: list = []

        def links(shard, fp):
            i, j = bk_links(shard, fp.view(np.uint64), radius)
            return pd.DataFrame({"a": fp[i], "b": fp[j]})

        for p in batches:
            held.append((p["shard"].to_numpy(np.int64), p["fp"].to_numpy(np.int64)))
            if sum(len(x) for x, _ in held) >= STEP_PRINTS:
                shard, fp = (np.concatenate(x) for x in zip(*held))
                whole = int(np.searchsorted(shard, shard[-1]))  # the last shard may go on
                if whole:
                    yield links(shard[:whole], fp[:whole])
                held = [(shard[whole:], fp[whole:])]
        if held:
            yield links(*(np.concatenate(x) for x in zip(*held)))

    return dealt.mapInPandas(search, "a long, b long")


def _labelled(prints: DataFrame, radius: int) -> DataFrame:
    """fp, label: a fingerprint's component, of the distinct fingerprints in prints(doc_id, fp)."""
    distinct = cut(prints.select("fp").distinct())
    parts = connected_components(link_fingerprints(distinct, radius)).withColumnRenamed("node", "fp")
    return cut(distinct.join(parts, "fp", "left").select("fp", F.coalesce("label", "fp").alias("label")))


def simhash_components(docs: DataFrame, shingle: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable) of every row.

    Equal fingerprints are collapsed before any pair is looked at. Null and empty texts have
    fingerprint 0 and link like any other; repeated rows stay and share a component; a null
    doc_id stays, but does not name a component unless it is alone in one; an empty table gives
    an empty one; columns other than doc_id and text are ignored.
    """
    prints = cut(fingerprints(docs, shingle, seed))
    labels = _labelled(prints, radius)
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first")).join(labels, "fp")
    named = first.groupBy("label").agg(F.min("first").alias("component_id"))
    of_print = cut(labels.join(named, "label").select("fp", "component_id"))
    return prints.join(of_print, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def drop_near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 3, seed: int = 42) -> DataFrame:
    """docs with one row of each component: that of smallest doc_id, then smallest fingerprint.

    All columns are kept, whatever their names. Of rows with the same doc_id and fingerprint any
    one stays; rows without doc_id come last; null and empty texts are one component. Fingerprints
    are taken again from the texts when rows are picked, which is cheaper than moving the texts
    twice.
    """
    prints = cut(fingerprints(docs, shingle, seed))
    labels = _labelled(prints, radius)
    last = F.lit((1 << 63) - 1)
    each = prints.groupBy(F.coalesce("doc_id", last).alias("id"), "fp").agg(F.count("*").alias("n"))
    best = each.join(labels, "fp").groupBy("label").agg(F.min(F.struct("id", "fp", "n")).alias("b"))
    keep = cut(best.select("b.*"))
    repeated = keep.agg(F.max("n")).first()[0] or 1
    id_, fp = unused(docs, "id", "fp")
    keyed = docs.withColumns({id_: F.coalesce(F.col("doc_id").cast("long"), last), fp: fingerprint_column(shingle, seed)(text_of())})
    kept = keyed.join(keep.select(F.col("id").alias(id_), F.col("fp").alias(fp)), [id_, fp], "left_semi")
    if repeated > 1:
        kept = kept.dropDuplicates([id_, fp])
    return kept.select(*own(docs))
