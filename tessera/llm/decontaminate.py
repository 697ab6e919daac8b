"""Benchmark decontamination by greedy string tiling."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import kept
from .common import cut, own, text_of, texts, unused

#: Scripts written without spaces between words: Thai to Myanmar, Khmer, kana, Han.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(f"(?![_])(?:[{UNSPACED}]|[^\\W_{UNSPACED}]+)")
#: Benchmarks up to this many bytes of text are broadcast with their seeds; larger ones are joined.
BROADCAST_BYTES = 16 << 20
FOUND = "doc_id long, item_id long, coverage double, matched int, tiles int, longest int, item_words int"


def words(text: str) -> list[str]:
    """Runs of letters and digits in lower case; of scripts without spaces each character."""
    return WORD.findall(text.lower())


class Rolling:
    """Karp-Rabin hashes of a token sequence's windows of any size, by differences of running sums of scaled tokens."""

    def __init__(self, tokens, powers):
        import numpy as np

        v = (tokens.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        self.powers = powers
        self.total = np.r_[np.uint64(0), np.cumsum((v ^ (v >> np.uint64(29))) * powers[: len(v)], dtype=np.uint64)]

    def of(self, at, size: int):
        return (self.total[at + size] - self.total[at]) * self.powers[len(self.powers) - 1 - at]


def tile(item, doc, least: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling of an item in a document: (item start, doc start, length) of the tiles.

    item, doc: token numbers, -1 in doc where the item's vocabulary lacks the word. Each round
    finds the greatest length at which unmarked stretches of both agree, by running Karp-Rabin
    at the lengths of a binary search, and marks matches of that length that do not overlap, by
    place in the document and then in the item. Rounds end when no unmarked match of `least`
    tokens is left. Every tile covers its tokens once on both sides, in any order.
    """
    import numpy as np

    item, doc = np.asarray(item, np.int64), np.asarray(doc, np.int64)
    known = np.zeros(max(int(item.max(initial=-1)), int(doc.max(initial=-1))) + 2, bool)
    known[item + 1] = True
    inside = known[doc + 1]
    # only stretches of the document made of the item's tokens can match
    at = np.flatnonzero(inside)
    new = np.r_[True, np.diff(at) > 1] if len(at) else np.zeros(0, bool)
    sizes = np.diff(np.r_[np.flatnonzero(new), len(at)])
    at = at[np.repeat(sizes >= least, sizes)] if len(at) else at
    if not len(at) or len(item) < least:
        return []
    part, tiles = doc[at], []
    broken = np.r_[False, np.diff(at) > 1]  # a window must not cross from one stretch to the next
    free_item, free_part = np.ones(len(item), bool), np.ones(len(part), bool)
    powers = np.cumprod(np.r_[np.uint64(1), np.full(max(len(item), len(part)), np.uint64(0x9E3779B97F4A7C15))], dtype=np.uint64)
    item_hash, part_hash = Rolling(item, powers), Rolling(part, powers)

    crossed, whole = np.r_[0, np.cumsum(broken)], np.zeros(len(item) + 1, np.int64)
    most = min(len(item), int(sizes.max()))

    def clear(bad, cuts, size):
        return np.flatnonzero((bad[size:] == bad[:-size]) & (cuts[size:] == cuts[1 : len(cuts) - size + 1]))

    def matches(size, bad_item, bad_part):
        """Places of the item and the document whose free windows of size tokens have a hash in common, with the hashes."""
        if size > len(part):
            return None
        i, j = clear(bad_item, whole, size), clear(bad_part, crossed, size)
        hi, hj = item_hash.of(i, size), part_hash.of(j, size)
        both = set(hi.tolist()).intersection(hj.tolist())
        if not both:
            return None
        return [(x, h) for x, h in zip(i.tolist(), hi.tolist()) if h in both], [(x, h) for x, h in zip(j.tolist(), hj.tolist()) if h in both]

    while True:
        lo, hi, found, step = least - 1, most, None, most
        bad_item, bad_part = np.r_[0, np.cumsum(~free_item)], np.r_[0, np.cumsum(~free_part)]
        while lo < hi:  # matches of a length imply shorter ones; the greatest length is often the right one
            got = matches(step, bad_item, bad_part)
            if got is None:
                hi = step - 1
            else:
                lo, found = step, got
            step = least if lo < least else (lo + hi + 1) // 2
        if found is None:
            return tiles
        size = most = lo
        places: dict[int, list[int]] = {}
        for i, h in found[0]:
            places.setdefault(h, []).append(i)
        end = -1
        for j, h in found[1]:
            if j < end or not places.get(h):
                continue
            left = [i for i in places[h] if free_item[i : i + size].all()]
            places[h] = left
            for i in left:
                if (item[i : i + size] == part[j : j + size]).all():
                    free_item[i : i + size] = False
                    free_part[j : j + size] = False
                    tiles.append((i, int(at[j]), size))
                    end = j + size
                    break


class Seeds:
    """The items as token numbers, and the hashes of their seeds of `least` tokens."""

    def __init__(self, items: list[tuple[int, str]], least: int):
        import numpy as np

        self.least, self.number, self.items = least, {}, []
        for item_id, text in items:
            w = words(text)
            if len(w) >= least:
                self.items.append((item_id, [self.number.setdefault(x, len(self.number)) for x in w]))
        where: dict[int, set[int]] = {}
        for k, (_, t) in enumerate(self.items):
            for h in self.grams(np.array(t, np.int64))[0].tolist():
                where.setdefault(h, set()).add(k)
        self.keys = np.array(sorted(where), np.uint64)
        self.of = [sorted(where[h]) for h in sorted(where)]

    def grams(self, t):
        """Hashes of the `least`-token grams without unknown tokens, and their places."""
        import numpy as np

        n = len(t) - self.least + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        known = np.cumsum(np.r_[0, t >= 0])
        at = np.flatnonzero(known[self.least :] - known[:-self.least] == self.least)
        h = np.zeros(len(at), np.uint64)
        for j in range(self.least):
            h = (h * np.uint64(0x9E3779B97F4A7C15)) ^ (t[at + j].astype(np.uint64) + np.uint64(1))
            h ^= h >> np.uint64(29)
        return h, at

    def candidates(self, t) -> list[int]:
        import numpy as np

        h, _ = self.grams(t)
        if not len(h) or not len(self.keys):
            return []
        to = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
        return sorted({k for i in np.unique(to[self.keys[to] == h]).tolist() for k in self.of[i]})

    def tokens(self, text: str):
        import numpy as np

        get = self.number.get
        return np.array([get(w, -1) for w in words(text)], np.int64)


def tiled(seeds: Seeds, rows, threshold: float) -> dict[str, list]:
    """rows: (doc_id, text, indices of items or None for all that share a seed)."""
    out: dict[str, list] = {k.split()[0]: [] for k in FOUND.split(", ")}
    for doc_id, text, only in rows:
        t = seeds.tokens(text)
        for k in seeds.candidates(t) if only is None else only:
            item_id, item = seeds.items[k]
            tiles = tile(item, t, seeds.least)
            matched = sum(n for _, _, n in tiles)
            if tiles and matched >= threshold * len(item):
                for column, v in zip(out.values(), (doc_id, item_id, matched / len(item), matched, len(tiles), max(n for _, _, n in tiles), len(item))):
                    column.append(v)
    return out


def seeds_of(items: list[tuple], least: int):
    """The items' seeds, made once in each worker."""
    return kept(("seeds", hash((tuple(items), least))), lambda: Seeds(items, least))


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, least: int = 5) -> DataFrame:
    """(doc_id, item_id) pairs whose tiles cover at least threshold of the item's words, with figures.

    Words are runs of letters and digits in lower case, or single characters of scripts written
    without spaces. A document and an item that share a seed of `least` words are tiled, so
    reordered passages add up. Items of fewer words have no seed and never match; null texts
    are empty; very long texts are tiled whole, in the stretches made of an item's words;
    repeated rows give repeated pairs; a null item_id or doc_id stays null; columns other than
    doc_id and text are ignored; an empty table on either side gives none. A benchmark under BROADCAST_BYTES of text is broadcast, and
    documents never move; a larger one meets them through a join on seed hashes, with the
    same rows as result.
    """
    items = _items(benchmark)
    if _size(items) > BROADCAST_BYTES:
        numbered = cut(texts(docs).withColumn("row", F.monotonically_increasing_id()))
        found = _joined(numbered.select(F.col("row").alias("key"), "text"), items, threshold, least)
        return found.join(numbered.select(F.col("row").alias("key"), "doc_id"), "key").select(*[c.split()[0] for c in FOUND.split(", ")])
    sent = _sent(docs, items)

    def run(batches):
        import pyarrow as pa

        seeds = seeds_of(sent.value, least)
        for b in batches:
            rows = ((d, t.as_py(), None) for d, t in zip(b.column(0).to_pylist(), b.column(1)))
            yield pa.RecordBatch.from_pydict(tiled(seeds, rows, threshold), schema=arrow_schema(FOUND))

    return texts(docs).mapInArrow(run, FOUND)


def arrow_schema(columns: str):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "double": pa.float64(), "int": pa.int32()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in columns.split(", "))])


def _joined(keyed: DataFrame, items: DataFrame, threshold: float, least: int) -> DataFrame:
    """The pairs of keyed(key long, text) through a shuffle: seed hashes meet, then pairs fetch their texts.

    A document's hashes are distinct, and those that no item has fall away in the join, so only
    pairs that share a seed carry text. Frequent seeds spread by adaptive skew handling.
    """

    def hashed(key):
        def run(batches):
            import numpy as np
            import pyarrow as pa
            import xxhash

            for b in batches:
                ks, hs = [], []
                for k, text in zip(b.column(0).to_pylist(), b.column(1)):
                    w = words(text.as_py())
                    h = {xxhash.xxh64_intdigest(" ".join(w[i : i + least])) for i in range(len(w) - least + 1)}
                    ks += [k] * len(h)
                    hs += np.array(list(h), np.uint64).view(np.int64).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(ks, pa.int64()), pa.array(hs, pa.int64())], names=[key, "h"])

        return run

    found = FOUND.replace("doc_id", "key")
    listed = cut(items.withColumn("row", F.monotonically_increasing_id()))
    left = keyed.select("key", "text").mapInArrow(hashed("key"), "key long, h long")
    right = listed.select(F.col("row").alias("item"), "text").mapInArrow(hashed("item"), "item long, h long")
    pairs = cut(left.join(right, "h").select("key", "item").distinct())
    both = pairs.join(keyed, "key").join(listed.select(F.col("row").alias("item"), "item_id", F.col("text").alias("item_text")), "item")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            out = None
            for r in b.to_pylist():
                one = tiled(Seeds([(r["item_id"], r["item_text"])], least), [(r["key"], r["text"], [0])], threshold)
                out = one if out is None else {k: out[k] + one[k] for k in out}
            if out:
                yield pa.RecordBatch.from_arrays(list(pa.RecordBatch.from_pydict(out, schema=arrow_schema(FOUND)).columns), schema=arrow_schema(found))

    return both.select("key", "text", "item_id", "item_text").mapInArrow(run, found)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.5, least: int = 5) -> DataFrame:
    """docs without the rows whose text leaks an item; columns as they are, whatever their names.

    Every row is judged by its own text alone: a null doc_id or one that repeats makes no
    difference; very long texts are tiled whole; empty tables change nothing. A broadcast benchmark judges rows where they are, without a shuffle; with a
    larger one each different text is judged once and rows leave by their text's digest.
    """
    items = _items(benchmark)
    if _size(items) > BROADCAST_BYTES:
        (digest,) = unused(docs, "digest")
        marked = F.md5(text_of())
        different = cut(docs.select(marked.alias("digest"), text_of().alias("text")).dropDuplicates(["digest"]).withColumn("key", F.monotonically_increasing_id()))
        leaks = _joined(different.select("key", "text"), items, threshold, least).select("key").distinct()
        gone = different.join(leaks, "key").select(F.col("digest").alias(digest))
        return docs.withColumn(digest, marked).join(gone, digest, "left_anti").select(*own(docs))
    sent = _sent(docs, items)

    @F.pandas_udf("boolean")
    def leaks_any(some: pd.Series) -> pd.Series:
        seeds = seeds_of(sent.value, least)
        return pd.Series([bool(tiled(seeds, [(None, t, None)], threshold)["item_id"]) for t in some], dtype=bool)

    return docs.where(~leaks_any(text_of()))


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), text_of().alias("text")).distinct()


def _size(items: DataFrame) -> int:
    return items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0


def _sent(docs: DataFrame, items: DataFrame):
    """The items, under BROADCAST_BYTES, as plain tuples: workers need no copy of this package to read them."""
    return docs.sparkSession.sparkContext.broadcast([tuple(r) for r in items.orderBy("item_id", "text").collect()])
