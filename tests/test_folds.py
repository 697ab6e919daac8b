"""Folds over the lines and sentences of one long text, against plain loops."""

import random
import time

from pyspark.sql import functions as F

from tessera.functions import text as T


def sections(text, header):
    done, title, body = {}, "前言", []
    for line in (x.strip(" \t\n\r") for x in text.split("\n")):
        if not line:
            continue
        if line.startswith(header) and len(body) > 3:
            done[title] = "\n".join(body)
            title, body = line, []
        else:
            body.append(line)
    if body:
        done[title] = "\n".join(body)
    return list(done.items())


def packed(parts, size, overlap):
    done, buffer = [], []
    for s in parts:
        if buffer and sum(map(len, buffer)) + len(s) > size:
            done.append("".join(buffer))
            keep = []
            for x in reversed(buffer):
                if sum(map(len, keep)) + len(x) > overlap:
                    break
                keep.insert(0, x)
            buffer = keep
        buffer.append(s)
    return done + ["".join(buffer)] * bool(buffer)


def test_sections_and_packing(spark, monkeypatch):
    monkeypatch.setattr(T, "STRETCH", 7)
    rng = random.Random(4)
    words = ["H1 a", "H2 b", "H1 a", "plain", "  spaced ", "", "\x01odd", "\x02a\x02b", "H3\x01", "\x02", "\t"]
    texts = ["\n".join(rng.choices(words, k=rng.randrange(40))) for _ in range(150)] + ["", "\n", "H1 a", "a\nb\nc\nd\nH9"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)] + [(999, None)], "i int, text string")
    for r in df.select("text", T.sections(F.col("text"), ("H",)).alias("s")).collect():
        assert (None if r.s is None else [(x.title, x.body) for x in r.s]) == (None if r.text is None else sections(r.text, "H"))
    parts = [["x" * rng.randrange(1, 30) for _ in range(rng.randrange(50))] for _ in range(60)] + [[], ["y" * 99], ["z"] * 7, ["z"] * 14]
    df = spark.createDataFrame([(p,) for p in parts], "p array<string>")
    for r in df.select("p", T.pack(F.col("p"), 40, 11).alias("c")).collect():
        assert r.c == packed(r.p, 40, 11)


def test_a_hundred_thousand_lines(spark):
    lines = [f"第{i}条 x" if i % 5 == 0 else f"line {i} of the text。" for i in range(100_000)]
    df = spark.createDataFrame([("\n".join(lines),)], "text string").cache()
    df.count()
    for what in (T.sections(F.col("text")), T.pack(T.sentences(F.col("text")))):
        began = time.perf_counter()
        n = df.select(F.size(what)).first()[0]
        assert n > 4000 and time.perf_counter() - began < 15
