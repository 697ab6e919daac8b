"""Ingestion: fingerprints, duplicates, sections, chunks, versions, sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera import rules
from tessera.functions import text as T


def infer_doc_type(name: Column, table=rules.DOC_TYPES, default: str = rules.DOC_TYPE_DEFAULT) -> Column:
    """The type of the first listed token that the file name contains."""
    return F.coalesce(*[F.when(name.contains(token), F.lit(kind)) for token, kind in table], F.lit(default))


def upsert_registry(registry: DataFrame, incoming: DataFrame, key: str = "doc_id", cut: int = 10_000) -> DataFrame:
    """S3: new keys are inserted with raw_text cut; on a known key only version changes."""
    new = incoming.select(key, *[F.col(c).alias(f"new_{c}") for c in incoming.columns if c != key])
    known = F.col("known").isNotNull()
    out = [key]
    joined = registry.withColumn("known", F.lit(1)).join(new, key, "full_outer")
    for c in registry.columns:
        if c == key:
            continue
        fresh = F.substring(f"new_{c}", 1, cut) if c == "raw_text" else F.col(f"new_{c}")
        value = F.coalesce(F.col(f"new_{c}"), F.col(c)) if c == "version" else F.when(known, F.col(c)).otherwise(fresh)
        out.append(value.alias(c))
    return joined.select(*out)


CHUNK_DEFAULTS = {"insurer": "", "product_name": "", "product_code": "", "doc_type": "", "clause_type": "", "chunk_type": "child", "parent_id": "", "is_valid": True, "version": "1.0"}


def chunk_defaults(df: DataFrame, defaults: dict | None = None) -> DataFrame:
    """Missing columns and null values take the store's defaults."""
    defaults = CHUNK_DEFAULTS if defaults is None else defaults
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})


def append_chunks(df: DataFrame, path: str) -> None:
    """Appends to the chunk store, laid out by validity."""
    chunk_defaults(df).write.mode("append").partitionBy("is_valid").parquet(path)


def with_md5(df: DataFrame, content: str = "text", out: str = "file_md5") -> DataFrame:
    """md5 of the content where none is given."""
    made = F.md5(F.col(content))
    return df.withColumn(out, F.coalesce(F.col(out), made) if out in df.columns else made)


def dedup_documents(df: DataFrame, registry: DataFrame | None = None, order: str = "doc_id") -> DataFrame:
    """Drops fingerprints known to the registry, then all but the first of the batch."""
    if registry is not None:
        df = df.join(registry.select("file_md5").distinct(), "file_md5", "left_anti")
    first = Window.partitionBy("file_md5").orderBy(order)
    return df.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def document_id(code: Column, md5: Column) -> Column:
    """I3"""
    return F.concat_ws("_", code, F.substring(md5, 1, 8))


def assemble_pages(pages: DataFrame) -> DataFrame:
    """Doc, raw_text: the non-blank pages in order, each under its page mark."""
    seen = pages.where(F.length(T.strip(F.col("text"))) > 0)
    page = F.struct("page", F.format_string("\n--- 第%d页 ---\n%s", "page", "text").alias("t"))
    return seen.groupBy("doc").agg(F.sort_array(F.collect_list(page)).alias("p")).select("doc", T.join(F.transform("p", lambda x: x["t"])).alias("raw_text"))


def ocr_triage(pages: DataFrame, first: int = 3, least: int = 100) -> DataFrame:
    """Doc, page_count, avg_chars of the first pages, needs_ocr."""
    size = F.avg(F.when(F.col("page") <= first, F.length(T.strip(F.coalesce("text", F.lit(""))))))
    out = pages.groupBy("doc").agg(F.count("page").alias("page_count"), F.coalesce(size, F.lit(0.0)).alias("avg_chars"))
    return out.withColumn("needs_ocr", F.col("avg_chars") < least)


def extract_fields(c: Column, patterns=None) -> Column:
    """I8: map of the fields whose pattern matches."""
    patterns = rules.PRODUCT_FIELDS if patterns is None else patterns
    keys = F.array(*[F.lit(k) for k in patterns])
    return F.map_filter(F.map_from_arrays(keys, F.array(*[T.first_field(c, p) for p in patterns.values()])), lambda k, v: v.isNotNull())


def child_chunks(df: DataFrame, text: str = "text", doc: str = "doc_id", size: int = 512, overlap: int = 64, delims: str = rules.CHUNK_DELIMS) -> DataFrame:
    """Doc, idx, text of the child chunks."""
    made = T.pack(T.sentences(F.col(text), delims), size, overlap)
    return df.select(F.col(doc).alias("doc"), F.posexplode(made).alias("idx", "text"))


def parent_chunks(children: DataFrame, ratio: int = 4) -> DataFrame:
    """Doc, parent, text: every `ratio` children of a document joined, overlaps included."""
    by = children.withColumn("parent", F.floor(F.col("idx") / ratio).cast("int"))
    return by.groupBy("doc", "parent").agg(T.join(F.transform(F.sort_array(F.collect_list(F.struct("idx", "text"))), lambda x: x["text"])).alias("text"))


def chunk_by_paragraph(paras: DataFrame, size: int = 512, overlap: int = 64, delims: str = rules.CHUNK_DELIMS) -> DataFrame:
    """(doc, para, text) -> doc, para, idx, text: children packed in their paragraph, numbered through the document."""
    packed = paras.select("doc", "para", F.posexplode(T.pack(T.sentences(F.col("text"), delims), size, overlap)).alias("k", "text"))
    through = Window.partitionBy("doc").orderBy("para", "k")
    return packed.select("doc", "para", (F.row_number().over(through) - 1).alias("idx"), "text")


def chunk_rows(df: DataFrame, text: str = "text", doc: str = "doc_id", size: int = 512, overlap: int = 64, ratio: int = 4, delims: str = rules.CHUNK_DELIMS) -> DataFrame:
    """A document's children and parents as store rows, made inside its own row: one fold, no shuffle."""
    packed = df.select(F.col(doc).alias("doc"), T.pack(T.sentences(F.col(text), delims), size, overlap).alias("kids"))
    family = packed.where(F.size("kids") > 0).select("doc", "kids", F.transform(F.sequence(F.lit(0), F.floor((F.size("kids") - 1) / ratio).cast("int")), lambda p: T.join(F.slice("kids", p * ratio + 1, ratio))).alias("parents"))
    name, none = F.col("doc").cast("string"), F.lit(None).cast("string")
    pid = lambda p: F.format_string("%s_parent_%04d", name, p)

    def row(chunk_id, kind, parent_id, index, body, parent_text):
        return F.struct(chunk_id.alias("chunk_id"), F.lit(kind).alias("chunk_type"), parent_id.alias("parent_id"), index.alias("chunk_index"), body.alias("text"), parent_text.alias("parent_text"))

    up = lambda i: F.floor(i / ratio).cast("int")
    kids = F.transform("kids", lambda t, i: row(F.format_string("%s_child_%04d", name, i), "child", pid(up(i)), i, t, F.get("parents", up(i))))
    parents = F.transform("parents", lambda t, i: row(pid(i), "parent", none, F.lit(-1), t, none))
    return family.select("doc", F.explode(F.concat(kids, parents)).alias("r")).select("r.chunk_id", "doc", "r.chunk_type", "r.parent_id", "r.chunk_index", "r.text", "r.parent_text")


def boundary_density(tokens: DataFrame, sents: DataFrame, width: int = 256) -> DataFrame:
    """Share of a sentence's tokens (fully inside it) predicted as boundary, 0 without tokens.

    A range join by buckets of `width` places: a token is in the bucket of its start, a sentence
    in each bucket it touches, so both sides meet on equal keys.
    """
    t = tokens.select("doc", F.col("start").alias("t0"), F.col("end").alias("t1"), "pred", F.floor(F.col("start") / width).alias("bucket"))
    s = sents.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))))
    inside = (F.col("t0") >= F.col("start")) & (F.col("t1") <= F.col("end"))
    hit = s.join(t, ["doc", "bucket"], "left").withColumn("b", F.when(inside, (F.col("pred") == 0).cast("double")))
    return hit.groupBy("doc", "sent").agg(F.coalesce(F.avg("b"), F.lit(0.0)).alias("ratio"))


def window_vote(preds: DataFrame, spine: DataFrame, stride: int = 350, least: float = 0.5) -> DataFrame:
    """(doc, win, local, pred) votes per token of spine(doc, token): boundary where half the passes say so.

    Both sides are as long as the texts, which Spark cannot tell of tokens it unfolds itself, so the join is never a broadcast.
    """
    votes = preds.withColumn("token", F.col("win") * stride + F.col("local")).groupBy("doc", "token").agg(F.avg("pred").alias("share"))
    return spine.join(votes.hint("merge"), ["doc", "token"], "left").select("doc", "token", F.coalesce(F.col("share") >= least, F.lit(False)).alias("is_boundary"))


def group_paragraphs(sents: DataFrame, least: float = 0.3) -> DataFrame:
    """I16: (doc, sent, text, ratio) -> doc, para, text; the first sentence opens, then any of ratio >= least."""
    running = Window.partitionBy("doc").orderBy("sent")
    opens = (F.row_number().over(running) == 1) | (F.col("ratio") >= least)
    marked = sents.withColumn("o", opens.cast("int")).withColumn("para", F.sum("o").over(running) - 1)
    return marked.groupBy("doc", "para").agg(T.join(F.transform(F.sort_array(F.collect_list(F.struct("sent", "text"))), lambda x: x["text"])).alias("text"))


def segment(docs: DataFrame, sents: DataFrame, ratio: float = 0.3, least: int = 100, most: int = 4000, header: str = rules.HEADER, delims: str = rules.SEGMENT_DELIMS) -> DataFrame:
    """docs(doc, text), sents(doc, sent, text, ratio) -> doc, para, part, text.

    A text under `least` characters, or of one sentence at most, is one paragraph as it stands;
    an empty or null one has none. The others are grouped, short paragraphs merged, long ones cut.
    """
    many = sents.groupBy("doc").agg(F.count("*").alias("many"))
    judged = docs.join(many, "doc", "left").where(F.coalesce(F.length("text"), F.lit(0)) > 0).withColumn("whole", (F.length("text") < least) | (F.coalesce("many", F.lit(0)) <= 1))
    whole = judged.where("whole").select("doc", F.lit(0).cast("long").alias("para"), F.lit(0).alias("part"), "text")
    rest = sents.join(judged.where("not whole").select("doc"), "doc", "left_semi")
    return whole.unionByName(split_long(merge_short(group_paragraphs(rest, ratio), least, header), most, delims))


def merge_short(paras: DataFrame, least: int = 100, header: str = rules.HEADER) -> DataFrame:
    """(doc, para, text): a short first paragraph joins the next one; later short ones, if no header, the one before."""
    by = Window.partitionBy("doc").orderBy("para")
    n = F.row_number().over(by)
    short = (F.length("text") < least) & ~F.col("text").rlike(header)
    x = paras.withColumn("n", n).withColumn("short", short)
    x = x.withColumn("first_short", F.first("short").over(by))
    starts = F.when(F.col("n") == 1, F.lit(True)).when((F.col("n") == 2) & F.col("first_short"), F.lit(False)).otherwise(~F.col("short"))
    x = x.withColumn("g", F.sum(starts.cast("int")).over(by) - 1)
    return x.groupBy("doc", F.col("g").alias("para")).agg(T.join(F.transform(F.sort_array(F.collect_list(F.struct("n", "text"))), lambda r: r["text"])).alias("text"))


def split_long(paras: DataFrame, most: int = 4000, delims: str = rules.SEGMENT_DELIMS) -> DataFrame:
    """Longer paragraphs cut greedily at sentence ends, without overlap."""
    parts = F.when(F.length("text") > most, T.pack(T.sentences(F.col("text"), delims), most, 0)).otherwise(F.array("text"))
    return paras.select("doc", "para", F.posexplode(parts).alias("part", "text"))


def annotate_clause(kids: Column, sections: Column, chars: int = 50, strict: bool = True, default: str = "其他") -> Column:
    """The clause type of each child: the title of the first section whose body holds its first characters.

    Works inside one document's row: kids is its array of texts, sections its array of
    struct<title, body>. Texts are compared as written; not strict, white space is left out on
    both sides, since chunks have lost their line ends.
    """
    flat = (lambda c: c) if strict else (lambda c: F.regexp_replace(c, r"\s+", ""))
    plain = F.transform(sections, lambda s: F.struct(s["title"].alias("title"), flat(s["body"]).alias("body")))
    first = lambda p, probe: F.get(F.filter(p, lambda s: F.contains(s["body"], probe)), 0)["title"]
    return T.once(plain, lambda p: F.transform(kids, lambda k: T.once(F.substring(flat(k), 1, chars), lambda probe: F.coalesce(first(p, probe), F.lit(default)))))


def invalidate_versions(store: DataFrame, incoming: DataFrame) -> DataFrame:
    """Rows of an incoming (insurer, product_code) with another version become invalid; none is removed."""
    now = incoming.groupBy("insurer", "product_code").agg(F.max("version").alias("current"))
    old = F.col("current").isNotNull() & (F.col("version") != F.col("current"))
    return store.join(now, ["insurer", "product_code"], "left").withColumn("is_valid", F.when(old, F.lit(False)).otherwise(F.col("is_valid"))).drop("current")


def delete_product(store: DataFrame, keys: DataFrame) -> DataFrame:
    """I23"""
    return store.join(keys, keys.columns, "left_anti")


def quarantine(df: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that pass and rows that do not; a predicate that is null does not pass."""
    ok = F.coalesce(valid, F.lit(False))
    return df.where(ok), df.where(~ok)


def ingest_stats(status: DataFrame) -> DataFrame:
    """Totals by status."""
    n = lambda s: F.count_if(F.col("status") == s)
    return status.agg(F.count("*").alias("total"), n("success").alias("success"), n("skipped").alias("skipped"), n("failed").alias("failed"), n("kg_failed").alias("kg_failed"))


def invalidate_cache(cache: DataFrame, intents=None) -> DataFrame:
    """What is left of the result cache: nothing, or all but the keys of the intents."""
    if intents is None:
        return cache.limit(0)
    keep = F.lit(True)
    for i in intents:
        keep = keep & ~F.col("key").startswith(f"result:{i}:")
    return cache.where(keep)
