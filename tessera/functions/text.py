"""Column builders over text: splitting, packing, matching. No UDFs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import rules

WHITE = " \t\n\r"
#: Parts that a packing fold takes between two moves of what it has done.
STRETCH = 256


def once(value: Column, use) -> Column:
    """use(value), with value worked out a single time however often use names it."""
    return F.transform(F.array(value), use)[0]


def strip(c: Column) -> Column:
    """Without spaces, tabs and line ends at either side."""
    return F.regexp_replace(c, r"^[ \t\n\r]+|[ \t\n\r]+$", "")


def contains_any(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | c.contains(w)
    return out


def first_contained(c: Column, words) -> Column:
    """The first of words, in their order, that c contains; null if none."""
    return F.coalesce(*[F.when(c.contains(w), F.lit(w)) for w in words]) if words else F.lit(None).cast("string")


def matches_any(c: Column, patterns) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | c.rlike(p)
    return out


def normalize(c: Column, drop: str = rules.NORMALIZE_DROP) -> Column:
    """Q1: punctuation and white space dropped, lower case."""
    return F.lower(F.regexp_replace(c, drop, ""))


def sentences(c: Column, delims: str = rules.CHUNK_DELIMS) -> Column:
    """Pieces that end after a delimiter, stripped, empties dropped."""
    parts = F.split(c, f"(?<=[{re.escape(delims)}])")
    return F.filter(F.transform(parts, strip), lambda s: s != "")


def join(a: Column, sep: str = "") -> Column:
    return F.array_join(a, sep)


def total_length(a: Column) -> Column:
    return F.aggregate(a, F.lit(0), lambda t, s: t + F.length(s))


def suffix_within(a: Column, limit: int) -> Column:
    """The longest run of last elements whose lengths sum to limit at most."""
    start = F.struct(F.slice(a, 1, 0).alias("kept"), F.lit(0).alias("size"), F.lit(True).alias("open"))

    def step(acc, s):
        fits = acc["open"] & (acc["size"] + F.length(s) <= limit)
        return F.struct(
            F.when(fits, F.concat(F.array(s), acc["kept"])).otherwise(acc["kept"]).alias("kept"),
            F.when(fits, acc["size"] + F.length(s)).otherwise(acc["size"]).alias("size"),
            fits.alias("open"),
        )

    return F.aggregate(F.reverse(a), start, step, lambda acc: acc["kept"])


def pack(parts: Column, size: int = 512, overlap: int = 64) -> Column:
    """Sentences packed greedily into texts of about size characters.

    A sentence that would pass size closes a non-empty buffer; the next begins with the longest
    suffix of whole sentences within overlap. A longer sentence stays whole.
    """
    empty = F.array().cast("array<string>")
    start = F.struct(empty.alias("done"), empty.alias("buffer"), F.lit(0).alias("held"))

    def step(acc, s):
        full = (acc["held"] + F.length(s) > size) & (F.size(acc["buffer"]) > 0)
        # a one-element fold binds the carried suffix once
        closed = lambda: F.transform(F.array(suffix_within(acc["buffer"], overlap)), lambda keep: F.struct(
            F.concat(acc["done"], F.array(join(acc["buffer"]))).alias("done"),
            F.concat(keep, F.array(s)).alias("buffer"),
            (total_length(keep) + F.length(s)).alias("held"),
        ))[0]
        grown = F.struct(acc["done"].alias("done"), F.concat(acc["buffer"], F.array(s)).alias("buffer"), (acc["held"] + F.length(s)).alias("held"))
        return F.when(full, closed()).otherwise(grown)

    # what is done is carried past a stretch of parts at a time, else each step would move it all
    def stretch(acc, some):
        carried = F.struct(empty.alias("done"), acc["buffer"].alias("buffer"), acc["held"].alias("held"))
        return once(F.aggregate(some, carried, step), lambda r: F.struct(F.concat(acc["done"], r["done"]).alias("done"), r["buffer"].alias("buffer"), r["held"].alias("held")))

    finish = lambda acc: F.when(F.size(acc["buffer"]) > 0, F.concat(acc["done"], F.array(join(acc["buffer"])))).otherwise(acc["done"])
    stretches = lambda p: F.transform(F.sequence(F.lit(0), F.floor(F.size(p) / STRETCH).cast("int")), lambda i: F.slice(p, i * STRETCH + 1, F.lit(STRETCH)))
    return F.aggregate(once(parts, stretches), start, stretch, finish)


MARK, ESCAPE = "\x01", "\x02"


def sections(c: Column, patterns=rules.SECTION_PATTERNS, preface: str = "前言") -> Column:
    """array<struct<pos, title, body>> of a text's sections.

    A line that begins like a header opens a section only when more than three lines have
    gathered; a title seen again overwrites the body in its first place. Lines that could open
    one are marked, and one pattern then cuts the text: a marked line, four lines of any kind,
    and what follows up to the next mark. So time grows with the text, however many sections.
    """
    header = "^(?:" + "|".join(f"(?:{p})" for p in patterns) + ")"
    hide = lambda l: F.replace(F.replace(l, F.lit(ESCAPE), F.lit(ESCAPE + "b")), F.lit(MARK), F.lit(ESCAPE + "a"))
    show = lambda l: F.replace(F.replace(l, F.lit(ESCAPE + "a"), F.lit(MARK)), F.lit(ESCAPE + "b"), F.lit(ESCAPE))
    lines = F.filter(F.transform(F.split(c, "\n"), strip), lambda s: s != "")
    marked = F.transform(lines, lambda l: F.when(l.rlike(header), F.concat(F.lit(MARK), hide(l))).otherwise(hide(l)))
    whole = F.concat(F.lit(MARK + "\n"), F.array_join(marked, "\n"))
    piece = f"{MARK}[^\n]*(?:\n[^\n]*){{4}}[^{MARK}]*|{MARK}[^\n]*(?:\n[^\n]*){{0,3}}\\z"

    def parsed(t, i):
        halves = F.split(t, "\n", 2)
        title = F.replace(halves[0], F.lit(MARK), F.lit(""))
        body = F.rtrim(F.replace(F.coalesce(F.get(halves, F.lit(1)), F.lit("")), F.lit(MARK), F.lit("")), F.lit("\n"))
        return F.struct(F.when(title == "", F.lit(preface)).otherwise(show(title)).alias("title"), i.alias("pos"), show(body).alias("body"))

    found = F.filter(F.transform(F.regexp_extract_all(whole, F.lit(piece), F.lit(0)), parsed), lambda s: s["body"] != "")

    def merged(a):  # sorted by title and place: the first place and the last body of each title
        other = lambda x, at: F.coalesce(F.get(a, at)["title"] != x["title"], F.lit(True))
        first = F.filter(a, lambda x, i: (i == 0) | other(x, F.greatest(i - 1, F.lit(0))))
        last = F.filter(a, lambda x, i: other(x, i + 1))
        return once(last, lambda z: F.transform(first, lambda x, i: F.struct(x["pos"].alias("pos"), x["title"].alias("title"), F.get(z, i)["body"].alias("body"))))

    return F.transform(F.sort_array(once(F.sort_array(found), merged)), lambda s, i: F.struct(i.alias("pos"), s["title"].alias("title"), s["body"].alias("body")))


def first_field(c: Column, pattern: str, group: int = 1) -> Column:
    """The pattern's first match, stripped; null where it does not match."""
    return F.when(c.rlike(pattern), strip(F.regexp_extract(c, pattern, group)))


def longest_contained(c: Column, names) -> Column:
    """Q9: the longest of names contained in c, the earlier of equals; null if none."""
    ranked = sorted(range(len(names)), key=lambda i: (-len(names[i]), i))
    return first_contained(c, [names[i] for i in ranked])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, v: t + v)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda t, x: t + x.cast("double") * x.cast("double")))
