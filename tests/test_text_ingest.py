import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera import rules
from tessera.functions import text as T
from tessera.operators import ingest as I


def one(spark, col, text):
    return spark.createDataFrame([(text,)], "t string").select(col(F.col("t")).alias("x")).first().x


def split(text, delims):
    out, cur = [], ""
    for ch in text:
        cur += ch
        if ch in delims:
            out.append(cur)
            cur = ""
    return [s.strip(" \t\n\r") for s in [*out, cur] if s.strip(" \t\n\r")]


def pack(parts, size, overlap):
    done, buf = [], []
    for s in parts:
        if buf and sum(map(len, buf)) + len(s) > size:
            done.append("".join(buf))
            keep = []
            for x in reversed(buf):
                if sum(map(len, keep)) + len(x) > overlap:
                    break
                keep.insert(0, x)
            buf = keep
        buf = [*buf, s]
    return [*done, "".join(buf)] if buf else done


TEXTS = ["", "甲。乙！丙？丁；戊\n己", "没有分隔", " 前 后。 。\n\n", "长" * 700 + "。短。" + "中" * 300 + "；" + "末" * 40, "。".join("句子" * k for k in range(1, 40))]


def test_sentences_and_packing_by_brute_force(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string")
    for size, overlap in ((512, 64), (50, 20), (10, 0)):
        got = df.select("i", T.sentences(F.col("t")).alias("s"), T.pack(T.sentences(F.col("t")), size, overlap).alias("p")).collect()
        for r in got:
            assert r.s == split(TEXTS[r.i], rules.CHUNK_DELIMS)
            assert r.p == pack(r.s, size, overlap)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="ab。；\n ", max_size=60), min_size=1, max_size=20))
def test_packing_property(spark, texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("i", T.pack(T.sentences(F.col("t")), 15, 6).alias("p")).collect():
        assert r.p == pack(split(texts[r.i], rules.CHUNK_DELIMS), 15, 6)


def test_sections(spark):
    text = "开头\n一\n二\n三\n第一章 保险责任\n甲\n第二章 太早\n乙\n丙\n第三章 责任免除\n丁\n戊\n己\n庚\n第一章 保险责任\n新"
    got = [(s.pos, s.title, s.body) for s in one(spark, T.sections, text)]
    assert got == [(0, "前言", "开头\n一\n二\n三"), (1, "第一章 保险责任", "新"), (2, "第三章 责任免除", "丁\n戊\n己\n庚")]


def test_product_fields(spark):
    text = "产品名称：平安e生保 \n等待期为 30 天。犹豫期15日，保险期间：一年。投保年龄：0-60岁，其他"
    got = one(spark, I.extract_fields, text)
    assert got["产品名称"] == "平安e生保" and got["等待期"] == "30" and got["犹豫期"] == "15" and got["投保年龄"] == "0-60岁" and "备案号" not in got


def test_chunk_rows_and_clauses(spark):
    docs = spark.createDataFrame([("P_1", "。".join("字" * 200 for _ in range(12)) + "。")], "doc_id string, text string")
    kids = I.child_chunks(docs)
    rows = {r.chunk_id: r for r in I.chunk_rows(docs).collect()}
    n = kids.count()
    assert {k for k in rows if "child" in k} == {f"P_1_child_{i:04d}" for i in range(n)}
    assert rows["P_1_child_0005"].parent_id == "P_1_parent_0001" and rows["P_1_parent_0001"].chunk_index == -1
    assert rows["P_1_parent_0000"].text == "".join(rows[f"P_1_child_{i:04d}"].text for i in range(4)) == rows["P_1_child_0000"].parent_text
    secs = [("其一", "无关"), ("其二", "字" * 200 + "。\n" + "字" * 300), ("其三", "字" * 300)]
    one_row = docs.select(F.lit(None).cast("string").alias("x")).withColumns({"kids": F.array(F.lit("字" * 20), F.lit("字" * 60), F.lit("别")), "secs": F.array(*[F.struct(F.lit(t).alias("title"), F.lit(b).alias("body")) for t, b in secs])})
    marked = lambda **k: one_row.select(I.annotate_clause(F.col("kids"), F.col("secs"), **k).alias("a")).first().a
    assert marked() == ["其二", "其二", "其他"]
    across = one_row.withColumn("kids", F.array(F.lit("字" * 190 + "。" + "字" * 60)))
    assert across.select(I.annotate_clause(F.col("kids"), F.col("secs"), chars=220).alias("a")).first().a == ["其他"]
    assert across.select(I.annotate_clause(F.array(F.lit("字" * 10 + "。" + "字" * 60)), F.col("secs"), strict=False).alias("a")).first().a == ["其二"]


@pytest.mark.parametrize("name, kind", [("投保须知.pdf", "投保须知"), ("2024费率.pdf", "费率表"), ("理赔费率.pdf", "费率表"), ("x.pdf", "条款")])
def test_doc_type(spark, name, kind):
    assert one(spark, I.infer_doc_type, name) == kind


def test_segmenter_guards_and_headers(spark):
    """Short texts and single sentences stay whole; only a clause number at the start keeps a short paragraph apart."""
    docs = spark.createDataFrame([("short", "甲" * 40 + "。" + "乙" * 40), ("one", "丙" * 150), ("none", ""), ("null", None), ("long", "x")], "doc string, text string")
    docs = docs.withColumn("text", F.when(F.col("doc") == "long", "丁" * 320).otherwise(F.col("text")))
    parts = {"short": [("甲" * 40 + "。", 0.9), ("乙" * 40, 0.9)], "one": [("丙" * 150, 0.9)], "long": [("丁" * 120, 0.0), ("本款第二项所列条件适用", 0.9), ("第三条 戊", 0.9), ("己" * 120, 0.9)]}
    sents = spark.createDataFrame([(d, i, t, r) for d, xs in parts.items() for i, (t, r) in enumerate(xs)], "doc string, sent int, text string, ratio double")
    got = {}
    for r in I.segment(docs, sents).orderBy("para", "part").collect():
        got.setdefault(r.doc, []).append(r.text)
    assert got == {"short": ["甲" * 40 + "。" + "乙" * 40], "one": ["丙" * 150], "long": ["丁" * 120 + "本款第二项所列条件适用", "第三条 戊", "己" * 120]}


def test_paragraph_rules(spark):
    s = spark.createDataFrame([("d", i, t, r) for i, (t, r) in enumerate([("a" * 30, 0.0), ("b" * 120, 0.5), ("c" * 20, 0.4), ("第一条 x", 0.9), ("d" * 200, 0.1)])], "doc string, sent int, text string, ratio double")
    groups = I.group_paragraphs(s)
    assert sorted((r.para, len(r.text)) for r in groups.collect()) == [(0, 30), (1, 120), (2, 20), (3, 205)]
    assert sorted((r.para, len(r.text)) for r in I.merge_short(groups).collect()) == [(0, 170), (1, 205)]
    long = spark.createDataFrame([("d", 0, "句。" * 3000)], "doc string, para int, text string")
    assert [len(r.text) for r in I.split_long(long).orderBy("part").collect()] == [4000, 2000]


def test_files_and_json(spark, tmp_path):
    from tessera.sources import tables

    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "理赔.txt").write_bytes("内容".encode())
    got = tables.read_files(spark, str(tmp_path / "docs")).first()
    assert (got.file_name, got.doc_type, bytes(got.file_content).decode()) == ("理赔.txt", "理赔指南", "内容")
    (tmp_path / "seed.json").write_text('[{"text": "怎么赔", "label": "理赔咨询"},\n {"text": "你好", "label": "闲聊寒暄"}]', encoding="utf-8")
    assert [tuple(r) for r in tables.read_labelled(spark, str(tmp_path / "seed.json")).collect()] == [("怎么赔", "理赔咨询"), ("你好", "闲聊寒暄")]
    I.append_chunks(spark.createDataFrame([("c1", "t")], "chunk_id string, text string"), str(tmp_path / "store"))
    assert spark.read.parquet(str(tmp_path / "store")).first().chunk_type == "child"


def test_window_vote_is_never_broadcast(spark):
    """Tokens unfolded from a few rows look small to the planner."""
    spine = spark.range(3).select(F.col("id").alias("doc"), F.explode(F.sequence(F.lit(0), F.lit(499))).alias("token"))
    preds = spine.select("doc", F.lit(0).alias("win"), F.col("token").alias("local"), (F.col("token") % 2).alias("pred"))
    got = I.window_vote(preds, spine)
    assert "Broadcast" not in got._jdf.queryExecution().sparkPlan().toString()
    assert got.where("is_boundary = (token % 2 = 1)").count() == got.count() == 1500
