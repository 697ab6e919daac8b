"""Toxicity by a weighted lexicon matched with Aho-Corasick after folding disguises."""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of, texts

#: Look-alikes and digit substitutions, by the letter read. l, i, 1 and | are one letter.
LOOKS = {
    "a": "аɑα4", "b": "вβ8", "c": "сϲ", "d": "ԁđ", "e": "еєε3", "h": "н", "i": "іıιӏl1ł", "k": "кκ", "m": "м",
    "o": "оοσø0", "p": "рρ", "q": "ԛ", "s": "ѕß5", "t": "тτ7", "w": "ԝ", "x": "хχ", "y": "уγ",
}
LOOKALIKE = {c: letter for letter, many in LOOKS.items() for c in many}
#: Symbols that stand for a letter only between two letters.
SYMBOL = {"$": "s", "@": "a", "!": "i", "|": "i", "€": "e"}
INSIDE = re.compile(r"(?<=[^\W_])[$@!|€]{1,2}(?=[^\W_])")
LONGEST, SHORTEST = 12, 3


class Folding(dict):
    """Table for str.translate: one lower-case plain letter, or a space, for each character."""

    def __missing__(self, code):
        out = ""
        for c in unicodedata.normalize("NFKD", chr(code).lower()):
            if not unicodedata.combining(c):
                out += LOOKALIKE.get(c, c) if c.isalnum() else " "
        self[code] = out
        return out


def fold(text: str, table: Folding) -> str:
    """Folded text with a space before the first and after the last word."""
    if any(s in text for s in SYMBOL):
        text = INSIDE.sub(lambda m: "".join(SYMBOL[c] for c in m[0]), text)
    return f" {text.translate(table)} "


def terms_of(folded: str) -> set[str]:
    """Word prefixes of SHORTEST to LONGEST letters (' pre'), and words of up to twice LONGEST whole (' word ')."""
    out = set()
    for w in set(folded.split()):
        if len(w) <= 2 * LONGEST:
            out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in range(SHORTEST, min(len(w), LONGEST) + 1))
    return out


@dataclass(frozen=True)
class Lexicon:
    """weights: term -> weight; exceptions: phrases that void the terms inside them; bias, slope: calibration."""

    weights: dict = field(default_factory=dict)
    exceptions: tuple = ()
    bias: float = -3.0
    slope: tuple = (1.0, 1.0)

    def automaton(self):
        import ahocorasick

        a = ahocorasick.Automaton()
        for t, w in self.weights.items():
            a.add_word(t, (len(t), w))
        for t in self.exceptions:
            a.add_word(t, (len(t), None))
        if len(a):
            a.make_automaton()
        return a


def hits(folded: str, automaton) -> list[tuple[int, int, float]]:
    """(start, end, weight) of the terms in a folded text, without those inside an exception phrase."""
    if not len(automaton):
        return []
    found = [(end - n + 1, end + 1, w) for end, (n, w) in automaton.iter(folded)]
    void = sorted((a, b) for a, b, w in found if w is None)
    starts, reach = [a for a, _ in void], list(accumulate((b for _, b in void), max))
    # of the phrases that begin no later than a term, one must reach its end
    inside = lambda a, b: (k := bisect.bisect_right(starts, a)) and reach[k - 1] >= b
    return [(a, b, w) for a, b, w in found if w is not None and not inside(a, b)]


def features(folded: str, automaton) -> tuple[float, float]:
    """Total weight on a log scale, and weight for each word on a root scale: the length normalisation."""
    total = sum(w for _, _, w in hits(folded, automaton))
    words = max(1, folded.count(" ") - 1)
    return math.log1p(total), math.sqrt(total / words)


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def learn_lexicon(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000, min_docs: int = 3, log_odds: float = 2.0, false_terms: float = 0.05) -> Lexicon:
    """Terms, weights, exception phrases and calibration from about fit_rows labelled rows.

    Held-out rows (crc32 of doc_id mod 5 = 0) are never read. A term needs min_docs toxic
    documents, a log-odds whose lower bound is at least log_odds, and a binomial tail so thin
    that of all terms tested only false_terms would pass by chance; shorter forms must earn
    their place by what longer ones miss. A two-word phrase around a term found in min_docs clean
    documents and no toxic one becomes an exception. Every count takes part: what reaches the
    driver is bounded by the terms of the fit_rows texts alone. Null texts are empty, rows with a
    null label or doc_id are left out, of repeated labels the toxic one holds. Without both
    classes the lexicon is empty.
    """
    import numpy as np

    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    known = known.where("doc_id is not null and toxic is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if n > fit_rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < fit_rows)
    # at most about fit_rows rows of 12 bytes
    rows = cut(texts(docs).join(F.broadcast(known), "doc_id").select("doc_id", "toxic", "text"))
    rows = rows.repartition(max(2, rows.sparkSession.sparkContext.defaultParallelism))
    of_class = {r["toxic"]: r["count"] for r in rows.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).count().collect()}
    pos, neg = of_class.get(1, 0), of_class.get(0, 0)
    if not pos or not neg:
        return Lexicon(bias=-3.0 if neg or not pos else 3.0)

    def counted(pick):
        def run(batches):
            import collections

            import pyarrow as pa

            n, table = collections.Counter(), Folding()
            for b in batches:
                for toxic, text in zip(b.column(1).to_pylist(), b.column(2)):
                    n.update(pick(toxic > 0, fold(text.as_py(), table)))
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], names=["term", "n"])

        return rows.mapInArrow(run, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))

    frequent = counted(lambda toxic, t: terms_of(t) if toxic else ()).where(F.col("n") >= min_docs)
    toxic_docs = {r["term"]: r["n"] for r in frequent.collect()}  # fit_rows bounds the documents they are from
    clean_docs = {r["term"]: r["n"] for r in counted(lambda toxic, t: () if toxic else (x for x in terms_of(t) if x in toxic_docs)).collect()}

    def bound(toxic, clean):
        a, b = toxic + 0.5, clean + 0.5
        return math.log(a / (pos + 1)) - math.log(b / (neg + 1)) - 1.64 * math.sqrt(1 / a + (1 / b if b > 1 else 0))

    def by_chance(toxic, clean):
        """How likely so many of a term's documents are toxic if it says nothing."""
        n, p = toxic + clean, pos / (pos + neg)
        log_choose = lambda k: math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)
        return sum(math.exp(log_choose(k) + k * math.log(p) + (n - k) * math.log1p(-p)) for k in range(toxic, n + 1))

    good = {t: x for t in toxic_docs if (x := bound(toxic_docs[t], clean_docs.get(t, 0))) >= log_odds}
    good = {t: x for t, x in good.items() if by_chance(toxic_docs[t], clean_docs.get(t, 0)) * len(toxic_docs) <= false_terms}
    chosen: dict[str, float] = {}
    covered: dict[str, tuple[int, int]] = {}
    # the surest first; of equals the longest prefix, whole words last
    for t in sorted(good, key=lambda t: (-good[t], t[-1] == " ", -len(t), t)):
        if any(t[:k] in chosen for k in range(2, len(t))):
            continue
        a, b = covered.get(t, (0, 0))
        if a and (toxic_docs[t] - a < min_docs or bound(toxic_docs[t] - a, clean_docs.get(t, 0) - b) < log_odds):
            continue  # what it adds to its longer forms does not carry it
        chosen[t] = good[t]
        for k in range(2, len(t)):
            covered[t[:k]] = max(covered.get(t[:k], (0, 0)), (toxic_docs[t], clean_docs.get(t, 0)))
    plain = Lexicon(chosen).automaton()

    def phrases(toxic, t):
        out = set()
        for a, b, _ in hits(t, plain):
            right = t.find(" ", max(b - 1, a + 1))
            left = t.rfind(" ", 0, a)
            after = t.find(" ", right + 1)
            if left >= 0:
                out.add(t[left : right + 1])
            if after > 0:
                out.add(t[a : after + 1])
        return ((f"{int(toxic)}{p}") for p in out if len(p.split()) == 2)

    said = {r["term"]: r["n"] for r in counted(phrases).where(F.col("n") >= min_docs).collect()}
    exceptions = tuple(sorted(p[1:] for p in said if p[0] == "0" and f"1{p[1:]}" not in said))
    lexicon = Lexicon(chosen, exceptions)

    def measured(batches):
        import pyarrow as pa

        a, table = lexicon.automaton(), Folding()
        for b in batches:
            x = [features(fold(t.as_py(), table), a) for t in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([v[0] for v in x], pa.float64()), pa.array([v[1] for v in x], pa.float64())], names=["toxic", "x0", "x1"])

    seen = rows.mapInArrow(measured, "toxic int, x0 double, x1 double").groupBy((F.col("toxic") > 0).cast("int").alias("y"), F.round("x0", 1).alias("x0"), F.round("x1", 2).alias("x1")).count()
    m = np.array([[r["y"], r["x0"], r["x1"], r["count"]] for r in seen.collect()], float)  # binned: bounded by fit_rows
    x, y, w = np.c_[np.ones(len(m)), m[:, 1:3]], m[:, 0], m[:, 3]
    beta = np.zeros(3)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        ridge = np.diag([1e-6, 0.05, 0.05])
        step = np.linalg.solve(x.T @ (x * (w * p * (1 - p))[:, None]) + ridge, x.T @ (w * (y - p)) - ridge @ beta)
        beta = beta + np.clip(step, -2, 2)
        if abs(step).max() < 1e-8:
            break
    return Lexicon(chosen, exceptions, float(beta[0]), (float(beta[1]), float(beta[2])))


def score_column(lexicon: Lexicon):
    """Scalar function of a text column: the calibrated score."""

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        a, table = lexicon.automaton(), Folding()
        for some in batches:
            x = [features(fold(t, table), a) for t in some]
            z = [lexicon.bias + lexicon.slope[0] * p + lexicon.slope[1] * q for p, q in x]
            yield pd.Series([1 / (1 + math.exp(-max(-30.0, min(30.0, v)))) for v in z], dtype="float64")

    return score


def score_toxicity(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, held_out, score (0 to 1), predicted (score >= 0.5) of every row; no shuffle.

    Null and empty texts hold no term and get the calibrated base score; a null doc_id counts
    as the empty text in held_out; repeated rows score alike; labels, language and source are
    not read, nor any other column, whatever its name. Very long texts are scanned whole, in
    time that grows with their length; an empty table gives an empty one. The lexicon sent to the executors is as large as what
    fit_rows labelled texts support.
    """
    return texts(docs).select("doc_id", score_column(lexicon)("text").alias("score")).select(
        "doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def drop_toxic(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """docs without the rows that score 0.5 or more; columns as they are, whatever their names; no shuffle.

    Texts are judged as score_toxicity does: null, empty and very long ones, repeated rows and
    empty tables alike.
    """
    return docs.where(score_column(lexicon)(text_of()) < 0.5)


def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = 20_000) -> DataFrame:
    """Learns the lexicon from labels(doc_id, toxic) and scores every document."""
    return score_toxicity(docs, learn_lexicon(docs, labels, fit_rows))
