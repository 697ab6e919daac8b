"""Secret scans with DataFrame expressions only: fixed patterns plus a randomness battery."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, own, text_of, texts

#: kind -> pattern, group that must be long enough, its least length
BASE = {
    "assign": (r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]+", 0, 24),
}
#: hex runs under the least length are dropped anyway, and a shorter run never starts a longer one
SCAN = {"assign": BASE["assign"][0], "access": r"AKIA[A-Z0-9]{16,}+", "hex": r"[0-9a-f]{24,}+"}
CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}+"
KINDS = ("assign", "access", "hex", "random")


def spans(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """array<struct<start,end>> (code points) of the leftmost non-overlapping matches.

    The pieces between matches and the matches alternate, so running sums of their lengths
    give the positions; texts without a match skip both passes.
    """
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    gaps = F.split(text, pattern, -1)
    sizes = F.zip_with(whole, inner, lambda m, i: F.struct(F.length(m).alias("size"), F.length(i).alias("inner")))
    joined = F.zip_with(gaps, sizes, lambda g, m: F.struct(F.length(g).alias("gap"), m["size"].alias("size"), m["inner"].alias("inner")))
    start = F.struct(
        F.lit(0).cast("int").alias("at"),
        F.array().cast("array<struct<start:int,end:int>>").alias("found"),
    )

    def step(acc, x):
        at = acc["at"] + x["gap"]
        size = F.coalesce(x["size"], F.lit(0))
        one = F.array(F.struct(at.alias("start"), (at + size).alias("end")))
        keep = x["inner"].isNotNull() & (x["inner"] >= least)
        return F.struct((at + size).alias("at"), F.when(keep, F.concat(acc["found"], one)).otherwise(acc["found"]).alias("found"))

    return F.when(text.rlike(pattern), F.aggregate(joined, start, step, lambda acc: acc["found"])).otherwise(
        F.array().cast("array<struct<start:int,end:int>>")
    )


ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/_-="
#: Sum of squared letter shares of ordinary text, the null that a secret must differ from.
TEXT_REPEAT = 0.066


def battery(s: Column) -> Column:
    """struct<stratum, even, odd> of a candidate: its stratum of length and encoding, and two p-values' bins.

    The encoding inferred from the characters sets the alphabet size k. odd is for randomness:
    the least of three p-values, times three, of chi-squared against a uniform alphabet, a runs
    test about the mean and a lag-1 serial correlation. even is against ordinary text: how
    likely text of this length is as even as this. A bin is the floor of -20 log10 p.
    """
    one = F.array(s)

    def measured(s):
        n = F.length(s).cast("double")
        chars = F.filter(F.split(s, "(?!^)"), lambda c: c != "")
        k = (
            F.when(s.rlike("^([0-9a-f]+|[0-9A-F]+)$"), 16.0)
            .when(s.rlike("^[A-Z2-7]+=*$"), 32.0)
            .when(s.rlike("^([0-9a-z]+|[0-9A-Z]+)$"), 36.0)
            .when(s.rlike("^[0-9A-Za-z]+$"), 62.0)
            .otherwise(64.0)
        )
        squares = F.aggregate(
            F.array_distinct(chars), F.lit(0.0), lambda a, c: a + F.pow(F.length(s) - F.length(F.replace(s, c, F.lit(""))), F.lit(2.0))
        )
        return F.struct(
            s.alias("s"), n.alias("n"), k.alias("k"), squares.alias("squares"),
            F.transform(chars, lambda c: F.position(c, F.lit(ALPHABET)).cast("double")).alias("x"),
        )

    def averaged(m):  # a step of its own: inside the next lambda it would be summed anew for every character
        return F.struct(m.alias("m"), (F.aggregate(m["x"], F.lit(0.0), lambda a, v: a + v) / m["n"]).alias("mean"))

    def centred(r):
        return F.struct(r["m"].alias("m"), F.transform(r["m"]["x"], lambda v: v - r["mean"]).alias("y"))

    def judged(r):
        n, k, y = r["m"]["n"], r["m"]["k"], r["y"]
        chi = k * r["m"]["squares"] / n - n
        text_mean = (k - 1) + (n - 1) * (k * TEXT_REPEAT - 1)
        z_text = (chi - text_mean) / F.sqrt(2 * (k - 1) * (1 + 2 * (k * TEXT_REPEAT - 1) * n / k))
        sum_of = lambda a: F.aggregate(a, F.lit(0.0), lambda t, v: t + v)
        pairs = lambda f: sum_of(F.zip_with(F.slice(y, F.lit(1), F.size(y) - 1), F.slice(y, F.lit(2), F.size(y) - 1), f))
        high = sum_of(F.transform(y, lambda v: (v >= 0).cast("double")))
        low = n - high
        runs = 1 + pairs(lambda a, b: ((a >= 0) != (b >= 0)).cast("double"))
        expected = 2 * high * low / n + 1
        spread = F.sqrt(F.greatest((expected - 1) * (expected - 2) / (n - 1), F.lit(1e-9)))
        z_runs = F.abs(runs - expected) / spread
        energy = sum_of(F.transform(y, lambda v: v * v))
        z_serial = F.abs(pairs(lambda a, b: a * b) / F.greatest(energy, F.lit(1e-9)) * F.sqrt(n))
        token = r["m"]["s"]
        mixed = token.rlike("[0-9]") | (token.rlike("[a-z].*[a-z].*[a-z]") & token.rlike("[A-Z].*[A-Z].*[A-Z]"))  # words in one case are evenly spread now and then
        # logistic form of the normal tail
        tail = lambda z: F.log10(1 + F.exp(F.greatest(F.lit(-30.0), F.least(1.5976 * z + 0.07056 * z * z * z, F.lit(300.0)))))
        z_uniform = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (1 - 1 / n))
        two_sided = F.log10(F.lit(2.0))
        odd = F.greatest(tail(z_uniform), tail(z_runs) - two_sided, tail(z_serial) - two_sided) - F.log10(F.lit(3.0))
        binned = lambda p: F.least(F.floor(20 * F.greatest(p, F.lit(0.0))), F.lit(1200)).cast("int")
        varied = mixed & (high > 0) & (low > 0)
        stratum = F.least(F.floor(F.log2(n)), F.lit(12)) * 100 + k
        return F.struct(
            stratum.cast("int").alias("stratum"), F.when(varied & (z_text < 0), binned(tail(-z_text))).otherwise(0).alias("even"), F.when(varied, binned(odd)).otherwise(1200).alias("odd")
        )

    return F.transform(F.transform(F.transform(F.transform(one, measured), averaged), centred), judged)[0]


def discoveries(tested: DataFrame, bin_: str, level: float) -> DataFrame:
    """One row, cuts: map of stratum to the lowest bin that Benjamini-Hochberg accepts at level.

    tested counts (n) the candidates of each stratum and bins, so what is ordered is bounded
    whatever the input; a bin's largest p-value stands for all of it.
    """
    from pyspark.sql import Window

    binned = tested.groupBy("stratum", F.col(bin_).alias("bin")).agg(F.sum("n").alias("n"))
    all_of = Window.partitionBy("stratum")
    above = all_of.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)
    ranked = binned.select("stratum", "bin", F.sum("n").over(above).alias("rank"), F.sum("n").over(all_of).alias("m"))
    least = ranked.where((F.col("bin") > 0) & (F.pow(F.lit(10.0), -F.col("bin") / 20) <= level * F.col("rank") / F.col("m"))).groupBy("stratum").agg(F.min("bin").alias("least"))
    return least.agg(F.map_from_entries(F.collect_list(F.struct("stratum", "least"))).alias(f"{bin_}_cuts"))


def as_kind(found: Column, kind: int) -> Column:
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def _tested(docs: DataFrame, keep: str) -> DataFrame:
    """keep (a column of docs), text, and base, runs: the fixed patterns' spans, and the tested runs outside them."""
    plain = docs.select(keep, "text", *[spans(F.col("text"), SCAN[kind], BASE[kind][1], BASE[kind][2]).alias(f"base_{kind}") for kind in BASE], spans(F.col("text"), CANDIDATE).alias("runs"))
    base = F.concat(*[as_kind(F.col(f"base_{kind}"), i) for i, kind in enumerate(BASE)])
    plain = plain.select(keep, "text", base.alias("base"), "runs")
    outside = F.filter("runs", lambda x: ~F.exists("base", lambda y: (x["start"] < y["end"]) & (y["start"] < x["end"])))
    part = lambda x: F.col("text").substr(x["start"] + 1, x["end"] - x["start"])
    judged = F.transform(outside, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), battery(part(x)).alias("t")))
    return plain.select(keep, "text", "base", judged.alias("runs"))


def _accepted(tested: DataFrame, level: float, of: DataFrame) -> DataFrame:
    """of(..., base, runs) with found: all spans, by the cuts that hold over `tested`.

    A run is random if the battery's p-value does not reject randomness, with false rejections
    held at level / 10, and it is a secret if it is also too even for text, with false
    discoveries held at level.
    """
    # counted once: the texts are read a single time for both cuts
    bins = cut(tested.select(F.explode("runs").alias("r")).select("r.t.*").groupBy("stratum", "even", "odd").agg(F.count("*").alias("n")))
    cuts = cut(discoveries(bins, "even", level).crossJoin(discoveries(bins, "odd", level / 10)))  # one row, one entry a stratum
    at = lambda cuts, x: F.coalesce(F.try_element_at(cuts, x["t"]["stratum"]), F.lit(1 << 30))
    secret = lambda x: (x["t"]["even"] >= at("even_cuts", x)) & (x["t"]["odd"] < at("odd_cuts", x)) & (x["t"]["odd"] < 1200)
    return of.crossJoin(F.broadcast(cuts)).withColumn("found", F.array_sort(F.concat("base", as_kind(F.filter("runs", secret), 3))))


def scan_secrets(docs: DataFrame, level: float = 0.01) -> DataFrame:
    """doc_id, found: array<struct<start, kind, end>> ordered by start, then kind (0 assign, 1 access, 2 hex, 3 random).

    Offsets count code points, end exclusive. Kinds 0 to 2 are fixed patterns; kind 3 are runs
    of 20 or more encoding characters outside those spans that the battery finds random, with
    false discoveries held at `level` within each stratum of length and encoding. Null and
    empty texts have no spans; very long texts are scanned whole; repeated rows are scanned
    each; a null doc_id stays null; columns other than doc_id and text are ignored; an empty
    table gives an empty one.
    """
    tested = cut(_tested(texts(docs), "doc_id").select("doc_id", "base", "runs"))
    return _accepted(tested, level, tested).select("doc_id", "found")


def spans_text(found: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", kinds[x["kind"]], x["start"].cast("string"), x["end"].cast("string"))), ",")


def secret_digest(docs: DataFrame, level: float = 0.01) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of every row of docs."""
    s = scan_secrets(docs, level)
    count = lambda i: F.size(F.filter("found", lambda x: x["kind"] == i)).cast("long")
    return s.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(spans_text(F.filter("found", lambda x: x["kind"] < 3)), 256).alias("base_sha256"), spans_text(F.col("found")).alias("spans"),
    )


def redact(docs: DataFrame, level: float = 0.01, mark: str = "[SECRET]") -> DataFrame:
    """docs with the spans of scan_secrets replaced by mark in text; every other column unchanged.

    Spans that touch or overlap become one mark; a null text stays null; columns may have any
    names; very long texts are redacted whole; an empty table stays empty. A first pass over the texts sets the cuts of the false-discovery control, a second
    one redacts, so no text is shuffled.
    """
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def step(acc, x):
        before = F.col("text").substr(acc["at"] + 1, F.greatest(x["start"] - acc["at"], F.lit(0)))
        apart = (x["start"] > acc["at"]) | (acc["at"] == 0)
        return F.struct(
            F.when(apart, F.concat(acc["out"], before, F.lit(mark))).otherwise(acc["out"]).alias("out"),
            F.greatest(acc["at"], x["end"]).alias("at"),
        )

    rest = lambda acc: F.concat(acc["out"], F.col("text").substr(acc["at"] + 1, F.length("text") - acc["at"]))
    whole = docs.select(F.struct(*own(docs)).alias("row"), text_of().alias("text"))
    found = _accepted(_tested(whole.select("text", F.lit(0).alias("row")), "row"), level, _tested(whole, "row"))
    clean = F.when(F.size("found") > 0, F.aggregate("found", start, step, rest)).otherwise(F.col("row")["text"])
    return found.select(F.col("row").withField("text", clean).alias("row")).select("row.*")
