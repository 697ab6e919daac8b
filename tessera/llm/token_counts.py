"""Token counts of whole texts by the whole-token shortcut."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe
from .common import texts


def tokenizer_model(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 1024) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every row of docs(doc_id, text).

    The vocabulary strings that provably encode alone as one token (bpe.whole_tokens, at most
    one per vocabulary entry) are found once on the driver and broadcast; pre-tokens among
    them count one, the rest are merged and remembered per worker. No shuffle.
    Null and empty texts have no bytes and no tokens; repeated rows are counted each; a null
    doc_id stays null; other columns are ignored. Very long texts are split in stretches. An empty table gives
    an empty one.
    """
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    model = tokenizer_model(tokenizer_path)
    sent = docs.sparkSession.sparkContext.broadcast((model, bpe.whole_tokens(model)))

    def count(batches):
        import pyarrow as pa

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder = bpe.kept(("count", hash(sent.value[0])), lambda: bpe.Encoder(sent.value[0], len, sent.value[1]))
        for b in batches:
            sizes, counts = [], []
            for text in b.column(1):
                text = text.as_py()
                raw = text.encode()
                sizes.append(len(raw))
                counts.append(coder.count(text, raw))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
                names=["doc_id", "n_bytes", "n_tokens"],
            )

    counted = texts(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
