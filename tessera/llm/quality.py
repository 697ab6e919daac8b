"""Quality by co-training a text-content and a page-metadata classifier."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

#: Bins of hashed byte pairs in the content view; bins of hashed language and source in the metadata view.
PAIR_BINS, NAME_BINS = 128, 16
SCHEMA = "doc_id long, content array<float>, meta array<float>"


def content_view(text: str):
    """How the words themselves read: byte-pair shares and lexical statistics, no layout."""
    import numpy as np

    w = text.lower().split()
    n = len(w)
    raw = np.frombuffer(" ".join(w).encode(), np.uint8).astype(np.uint32)
    bins = np.bincount(((raw[:-1] * 31 + raw[1:]) * 2654435761 >> 16) % PAIR_BINS, minlength=PAIR_BINS) if len(raw) > 1 else np.zeros(PAIR_BINS)
    share = np.sqrt(bins / max(1, len(raw) - 1))
    counts: dict[str, int] = {}
    for x in w:
        counts[x] = counts.get(x, 0) + 1
    top = sorted(counts.values(), reverse=True)[:3]
    sizes = np.fromiter(map(len, w), float, n) if n else np.zeros(1)
    same = sum(map(str.__eq__, w, w[1:])) / max(1, n - 1)
    stats = [
        len(counts) / max(1, n), (top[0] if top else 0) / max(1, n), sum(top) / max(1, n), same, sizes.mean() / 10, sizes.std() / 10,
        (sizes <= 3).mean(), (sizes >= 12).mean(), np.log1p(n) / 10, np.log1p(len(counts)) / 10,
    ]
    return np.r_[share, stats].astype(np.float32)


def meta_view(text: str, lang, source):
    """How the page is laid out and where it comes from: sizes, lines, character kinds, language, source."""
    import numpy as np

    n = max(1, len(text))
    lines = text.split("\n")
    raw = np.frombuffer(text.encode(), np.uint8)
    kinds = np.bincount(raw, minlength=256) / max(1, len(raw))
    upper = kinds[65:91].sum()
    letters = upper + kinds[97:123].sum() + kinds[128:].sum()
    names = np.zeros(2 * NAME_BINS)
    for k, v in enumerate((lang, source)):
        names[k * NAME_BINS + zlib.crc32(str(v).encode()) % NAME_BINS] = 1
    stats = [
        np.log1p(len(text)) / 10, np.log1p(len(lines)) / 10, np.log1p(n / len(lines)) / 10, letters, upper / max(1e-9, letters), kinds[48:58].sum(),
        kinds[32], kinds[33:48].sum(), kinds[58:65].sum() + kinds[91:97].sum() + kinds[123:127].sum(), kinds[46], kinds[44], kinds[33], kinds[124], kinds[35:39].sum(),
        1 - len(set(lines)) / len(lines), sum(x.rstrip()[-1:] in ".!?" for x in lines) / len(lines),
    ]
    return np.r_[names * 0.3, stats].astype(np.float32)


def views(docs: DataFrame) -> DataFrame:
    """doc_id and the two views of every row; no shuffle, about 800 bytes a document."""
    has = lambda c: F.col(c).cast("string") if c in docs.columns else F.lit(None).cast("string")
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), has("lang").alias("lang"), has("source").alias("source")
    )

    def run(batches):
        import pyarrow as pa

        for b in batches:
            texts, langs, sources = (c for c in b.columns[1:])
            content, meta = [], []
            for t, lang, source in zip(texts, langs, sources):
                t = t.as_py()
                content.append(content_view(t))
                meta.append(meta_view(t, lang.as_py(), source.as_py()))
            kind = pa.list_(pa.float32())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(content, kind), pa.array(meta, kind)], names=["doc_id", "content", "meta"])

    return rows.mapInArrow(run, SCHEMA)


def fit(x, y, weight, ridge: float = 1.0):
    """Logistic regression by Newton steps: (intercept and coefficients on standardised columns, means, scales)."""
    import numpy as np

    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-6)
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    beta = np.zeros(z.shape[1])
    keep = np.diag(np.r_[1e-6, np.full(x.shape[1], ridge)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        step = np.linalg.solve(z.T @ (z * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]) + keep, z.T @ (weight * (y - p)) - keep @ beta)
        beta += np.clip(step, -3, 3)
        if abs(step).max() < 1e-6:
            break
    return beta, mean, scale


def logit(model, x):
    import numpy as np

    beta, mean, scale = model
    return np.clip(beta[0] + ((x - mean) / scale) @ beta[1:], -30, 30)


def _scored(seen: DataFrame, models) -> DataFrame:
    """seen with the two views' logits lc and lm."""
    sent = seen.sparkSession.sparkContext.broadcast(models)

    @F.pandas_udf("struct<lc: double, lm: double>")
    def both(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        import numpy as np

        for content, meta in parts:
            if len(content):
                yield pd.DataFrame({"lc": logit(sent.value[0], np.stack(content.to_list())), "lm": logit(sent.value[1], np.stack(meta.to_list()))})
            else:
                yield pd.DataFrame({"lc": [], "lm": []}, dtype="float64")

    return seen.withColumn("s", both("content", "meta")).select(*seen.columns, "s.lc", "s.lm")


def held_out() -> F.Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0


def gathered(seen: DataFrame, models, confident: float):
    """What each view learns from the other's sure documents: for view, then class, (n, gradient, a bound of the Hessian).

    Every document whose other view's logit is beyond `confident` takes part, at its view's
    present model. Tasks send sums of fixed size, which are added up in sixteen groups before
    the driver adds those.
    """
    import numpy as np

    sent = seen.sparkSession.sparkContext.broadcast(models)

    def run(batches):
        import pyarrow as pa

        total, part = None, 0
        for b in batches:
            if not b.num_rows:
                continue
            part = b.column(0)[0].as_py()
            x = [np.asarray(b.column(k + 1).flatten(), np.float64).reshape(b.num_rows, -1) for k in range(2)]
            sure = [logit(m, v) for m, v in zip(sent.value, x)]
            sums = []
            for k, (beta, mean, scale) in enumerate(sent.value):
                for y in (0, 1):
                    own = x[k][sure[1 - k] > confident if y else sure[1 - k] < -confident]
                    z = np.c_[np.ones(len(own)), (own - mean) / scale]
                    p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
                    sums += [[len(z)], z.T @ (y - p), (z.T @ z).ravel() / 4]
            total = np.concatenate(sums) if total is None else total + np.concatenate(sums)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part % 16], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

    def add(pdf):
        return pd.DataFrame({"sums": [np.sum([np.frombuffer(x) for x in pdf["sums"]], axis=0).tobytes()]})

    made = seen.select(F.spark_partition_id().alias("part"), "content", "meta").mapInArrow(run, "part int, sums binary")
    flat = [np.frombuffer(r.sums) for r in made.groupBy("part").applyInPandas(add, "sums binary").collect()]  # sixteen rows of some hundred KB
    out, at = [], 0
    total = np.sum(flat, axis=0) if flat else None
    for beta, _, _ in models:
        d, of_view = len(beta), []
        for _ in range(2):
            part = np.zeros(1 + d + d * d) if total is None else total[at : at + 1 + d + d * d]
            of_view.append((part[0], part[1 : 1 + d], part[1 + d :].reshape(d, d)))
            at += 1 + d + d * d
        out.append(of_view)
    return out


def refit(own, model, given, ridge: float = 1.0):
    """A view's model on its labelled rows and what the other view gave, by Newton steps.

    A class's given documents weigh half as much as its labelled rows, or half each if they are
    fewer; their loss is bounded by a quadratic about the present model.
    """
    import numpy as np

    x, y, _ = own
    beta0, mean, scale = model
    z = np.c_[np.ones(len(x)), (x - mean) / scale]
    keep = np.diag(np.r_[1e-6, np.full(x.shape[1], ridge)])
    share = [0.5 * min(1.0, float((y == c).sum()) / max(1.0, given[c][0])) for c in (0, 1)]
    pull, bend = (sum(w * g[k] for w, g in zip(share, given)) for k in (1, 2))
    beta = beta0.copy()
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        slope = z.T @ (y - p) - keep @ beta + pull - bend @ (beta - beta0)
        step = np.linalg.solve(z.T @ (z * np.maximum(p * (1 - p), 1e-6)[:, None]) + keep + bend, slope)
        beta = beta + np.clip(step, -3, 3)
        if abs(step).max() < 1e-6:
            break
    return beta, mean, scale


def co_train(docs: DataFrame, labels: DataFrame, rounds: int = 3, fit_rows: int = 8_000, confident: float = 3.0) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: better), predicted (score >= 0.5) of every row of docs.

    fit_rows bounds the labelled rows that the models are fitted on (a sample by hash when
    there are more); rows held out (crc32 of doc_id mod 5 = 0) are never among them. In each
    round both classifiers score every document, and each learns from all documents that the
    other is sure of (logit beyond `confident`), labelled or not. One labelled row in four is
    kept from fitting to calibrate both views, whose calibrated logits are then added with
    learned weights. Null and empty texts have the views of an empty text, very long texts are
    read whole, repeated rows score alike, unknown or null languages and sources share hashed
    bins; columns other than doc_id, text, lang and source are ignored. Without labels of both
    classes all scores are the share of good labels (0.5 without any). An empty table gives an
    empty one.
    """
    import numpy as np

    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.min("y").alias("y"))
    n = known.where(~held_out()).count()
    sample = known.where(~held_out()).where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, n))) < fit_rows)
    seen = table(views(docs))
    rows = seen.join(F.broadcast(sample), "doc_id").select("doc_id", "content", "meta", "y").toPandas()  # fit_rows bounds it
    y = (rows["y"].to_numpy() > 0).astype(float)
    if len(set(y)) < 2:
        share = float(y.mean()) if len(y) else 0.5
        return seen.select("doc_id", held_out().alias("held_out"), F.lit(share).alias("score"), F.lit(int(share >= 0.5)).alias("predicted"))
    x = [np.stack(rows[c].to_list()).astype(float) for c in ("content", "meta")]
    # by digest, whatever the ids are
    aside = np.array([zlib.crc32(f"aside {i}".encode()) % 4 == 1 for i in rows["doc_id"]], bool)
    if len(set(y[aside])) < 2 or len(set(y[~aside])) < 2:
        aside = np.zeros(len(y), bool)
    own = [(v[~aside], y[~aside], np.ones(int((~aside).sum()))) for v in x]
    models = [fit(*o) for o in own]
    for _ in range(rounds):
        models = [refit(o, m, g) for o, m, g in zip(own, models, gathered(seen, models, confident))]
    at = aside if aside.any() else np.ones(len(y), bool)
    z = np.c_[logit(models[0], x[0][at]), logit(models[1], x[1][at])]
    beta, mean, scale = fit(z, y[at], np.ones(int(at.sum())))
    a, b = beta[1] / scale[0], beta[2] / scale[1]
    c = beta[0] - a * mean[0] - b * mean[1]
    total = F.lit(float(c)) + F.lit(float(a)) * F.col("lc") + F.lit(float(b)) * F.col("lm")
    score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))))
    return _scored(seen, models).select("doc_id", held_out().alias("held_out"), score.alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
