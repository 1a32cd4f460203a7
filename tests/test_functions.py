import base64
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlstone.errors import EmbedFailed, InvalidPath
from marlstone.functions import scalars as S
from marlstone.functions import vectors
from marlstone.functions.encoding import decode, encode_note, encode_snapshot, encode_tree, note_problem, snapshot_problem, tree_problem
from marlstone.functions.snippet import query_terms, snippet
from marlstone.sources import embed, formats


def values(spark, items, column, name="t", kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(items)], f"i int, {name} {kind}")
    return [r[0] for r in rows.orderBy("i").select(column.alias("x"), "i").orderBy("i").collect()]


# Tokenizer cases that results must match.
TOKENS = [
    ("Hello, World! hello", {"hello": 2, "world": 1}),
    ("sha256 与 v2", {"sha256": 1, "v2": 1, "与": 1}),
    ("内容寻址", {"内容": 1, "容寻": 1, "寻址": 1}),
    ("内容内容", {"内容": 2, "容内": 1}),
    ("中", {"中": 1}),
    ("Go语言chan 是 CSP 原语!", {"chan": 1, "csp": 1, "go": 1, "原语": 1, "是": 1, "语言": 1}),
    ("", {}),
    (" ,.!", {}),
    ("İstanbul café", {"istanbul": 1, "caf": 1}),
    ("カタカナ 한국어", {"カタ": 1, "タカ": 1, "カナ": 1, "한국": 1, "국어": 1}),
]


def test_tokens(spark):
    got = values(spark, [t for t, _ in TOKENS], S.tokens("t"))
    for found, (text, want) in zip(got, TOKENS, strict=True):
        assert {w: found.count(w) for w in found} == want
        assert query_terms(text) == sorted(want)


def test_fnv(spark):
    assert values(spark, ["a", "foobar", "", "语"], S.fnv1a("t")) == [0xE40C292C, 3214735720, 2166136261, _fnv("语")]
    assert values(spark, ["foobar"], S.bucket("t")) == [3214735720 % 64]


def _fnv(text):
    h = 2166136261
    for b in text.encode():
        h = (h ^ b) * 16777619 % 2**32
    return h


def test_addresses(spark):
    good = "sha256:" + "0" * 64
    assert values(spark, [good, good[:-1], good + "0", good.upper(), None], S.is_address("t")) == [True, False, False, False, False]
    assert values(spark, [""], S.address("t")) == ["sha256:e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"]
    assert values(spark, [good], S.short_address("t")) == ["sha256:000000000"]


def test_paths(spark):
    assert values(spark, ["a/b/c", "a"], S.parent_of("t")) == ["a/b", ""]
    assert values(spark, ["a/b/c", "a"], S.ancestors_of("t")) == [["a", "a/b"], []]
    assert values(spark, ["a/b", "a//b", "a/ /b", "a/..", "."], S.valid_path("t")) == [True, False, False, False, False]
    assert S.path_parts(" ") == [] and S.path_parts("a/b") == ["a", "b"]
    for bad in ("a//b", "a/./b", "/a"):
        with pytest.raises(InvalidPath):
            S.path_parts(bad)
    with pytest.raises(InvalidPath):
        S.note_path("")


def test_summary(spark):
    got = values(spark, ["\n  first \nsecond", "x" * 120, "x" * 121, "", None], S.summary("t"))
    assert got == ["first", "x" * 120, "x" * 120 + "…", "", ""]


def test_cosine(spark):
    rows = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0, 2.0, 9.0], [2.0, 4.0])], "a array<float>, b array<float>")
    assert [round(r[0], 9) for r in rows.select(S.cosine("a", "b")).collect()] == [1.0, 0.0, 0.0, 1.0]


def test_encoding(spark):
    rows = spark.createDataFrame([("a<b&c", ["z", "a"], 5, [("s", "r"), ("b", ""), ("b", None)])], "title string, tags array<string>, t long, links array<struct<slug:string,rel:string>>")
    body = S.address(F.lit("x"))
    json = rows.select(encode_note("title", "tags", "t", body, "links").alias("j")).head()["j"]
    addr = "sha256:2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"
    assert json == '{"kind":"note","meta":{"title":"a\\u003cb\\u0026c","tags":["a","z"],"created_at":5,"schema_version":1},"body":"' + addr + '","links":[{"slug":"b"},{"slug":"b"},{"slug":"s","rel":"r"}]}'
    plain = rows.select(encode_note(F.lit("t"), F.array().cast("array<string>"), F.lit(1), body).alias("j")).head()["j"]
    assert plain == '{"kind":"note","meta":{"title":"t","created_at":1,"schema_version":1},"body":"' + addr + '"}'
    trees = spark.createDataFrame([([("b", "note", "x"), ("a", "dir", "y")],), ([],)], "e array<struct<slug:string,type:string,addr:string>>")
    assert [r[0] for r in trees.select(encode_tree("e")).collect()] == ['{"kind":"tree","entries":[{"slug":"a","type":"dir","addr":"y"},{"slug":"b","type":"note","addr":"x"}]}', '{"kind":"tree","entries":[]}']
    snap = rows.select(encode_snapshot(F.lit("r"), F.array(F.lit("q"), F.lit("p")), F.lit(7), F.lit("m"))).head()[0]
    assert snap == '{"kind":"snapshot","root":"r","parents":["p","q"],"time":7,"message":"m"}'


def test_decoding_and_validation(spark):
    addr = "sha256:" + "a" * 64
    data = [
        ("1", "note", '{"kind":"note","meta":{"title":"t","created_at":1,"schema_version":1},"body":"%s"}' % addr),
        ("2", "note", '{"kind":"tree","entries":[]}'),
        ("3", "note", '{"kind":"note","meta":{"title":" ","created_at":1,"schema_version":1},"body":"%s"}' % addr),
        ("4", "note", '{"kind":"note","meta":{"title":"t","created_at":1,"schema_version":2},"body":"%s"}' % addr),
        ("5", "tree", '{"kind":"tree","entries":[{"slug":"a","addr":"%s"}]}' % addr),
        ("6", "tree", '{"kind":"tree","entries":[{"slug":"a","type":"note","addr":"%s"},{"slug":"a","type":"dir","addr":"%s"}]}' % (addr, addr)),
        ("7", "snapshot", '{"kind":"snapshot","root":"%s","parents":["%s","%s"],"time":1,"message":""}' % (addr, addr, addr)),
    ]
    objects = spark.createDataFrame([(a, k, len(d), d.encode()) for a, k, d in data], "addr string, kind string, size long, data binary")
    problems = {"note": note_problem, "tree": tree_problem, "snapshot": snapshot_problem}
    got = {}
    for kind, problem in problems.items():
        for r in decode(objects, kind).select("addr", F.col("o").isNotNull().alias("ok"), problem(F.col("o")).alias("p")).collect():
            got[r["addr"]] = r["p"] if r["ok"] else "undecodable"
    assert got == {"1": None, "2": "undecodable", "3": "no title", "4": "undecodable", "5": "undecodable", "6": "slug twice", "7": "parent twice"}


def test_vectors(spark):
    data = [0.5, -1.25, 0.0, 3.75]
    assert vectors.encode(data) == base64.b64encode(struct.pack("<4f", *data)).decode()
    assert vectors.decode(vectors.encode(data)).tolist() == data
    with pytest.raises(ValueError):
        vectors.decode(base64.b64encode(b"abc").decode())
    rows = spark.createDataFrame([(data,), (None,)], "v array<float>")
    assert [r[0] for r in rows.select(vectors.from_base64(vectors.to_base64("v"))).collect()] == [data, None]


# Snippet cases that results must match.
SNIPPETS = [
    ("aaaa,bbbb,CCCC-dddd;eeee", "cccc", "aaaa,bbbb,【CCCC】-dddd;eeee"),
    ("channel 与 chan 与 channels。", "chan", "channel 与 【chan】 与 channels。"),
    ("本库实现知识库系统,支持全文检索。", "知识库", "本库实现【知识库】系统,支持全文检索。"),
    ("sha256sum 与 检索检索 检", "sha256 检", "sha256sum 与 检索检索 【检】"),
    ("检索检索", "检索", "【检索检索】"),
    ("无命中内容补足长度。" * 10, "absent", ("无命中内容补足长度。" * 10)[:80]),
    ("无命中内容补足长度。" * 10, "", ("无命中内容补足长度。" * 10)[:80]),
    ("", "x", ""),
]


def test_snippets():
    for body, query, want in SNIPPETS:
        assert snippet(body, query) == want
    long = snippet("汉" * 100 + "字", "汉字")
    assert len(long) == 44 and long.endswith("【汉字】")


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=300), st.text(max_size=10))
def test_snippets_only_add_marks(body, query):
    body = body.replace("【", "").replace("】", "")
    assert snippet(body, query).replace("【", "").replace("】", "") in body


def test_embedders():
    e = embed.HashEmbedder(dim=3)
    assert e.embed(["a"]) == [[_fnv("a\0") % 1000 / 1000, _fnv("a\1") % 1000 / 1000, _fnv("a\2") % 1000 / 1000]]
    assert embed.align_by_index([{"index": 1, "embedding": [2]}, {"index": 0, "embedding": [1]}], 2) == [[1], [2]]
    for bad in ([{"index": 0, "embedding": [1]}] * 2, [{"index": 5, "embedding": [1]}, {"index": 0, "embedding": [1]}], [{"index": 0, "embedding": [1]}]):
        with pytest.raises(EmbedFailed):
            embed.align_by_index(bad, 2)
    with pytest.raises(EmbedFailed):
        embed.checked([[1.0], [1.0, 2.0]], 2)
    with pytest.raises(EmbedFailed):
        embed.provider("other", "m")
    with pytest.raises(EmbedFailed):
        embed.provider("", "")
    assert embed.endpoint("http://h/v1") == "http://h/v1/embeddings" and embed.endpoint("http://h") == "http://h/v1/embeddings"


def test_markdown_rules(spark):
    files = {
        "ok": "---\ntitle: T\ntags: a, b,\n---\nbody\n---\nmore",
        "plain": "---\ntitle: T\n---\n",
        "fence": "title: T\n",
        "none": "---\ntags: a\n---\nx",
        "blank": "---\ntitle:  \n---\nx",
        "open": "---\ntitle: T\n",
        "odd": "---\ntitle: T\nother\n---\nx",
        "twice": "---\ntitle: T\ntitle: U\n---\nx",
    }
    rows = {r["path"]: r for r in formats.parse_markdown(spark.createDataFrame(list(files.items()), "path string, content string")).collect()}
    assert (rows["ok"]["title"], rows["ok"]["tags"], rows["ok"]["body"], rows["ok"]["problem"]) == ("T", ["a", "b"], "body\n---\nmore", None)
    assert (rows["plain"]["body"], rows["plain"]["problem"]) == ("", None)
    assert {n: rows[n]["problem"] for n in list(files)[2:]} == {"fence": "first line must be ---", "none": "no title", "blank": "no title", "open": "front matter isn't closed", "odd": "unknown line", "twice": "title twice"}


def test_bucket_steps_are_fnv(spark):
    texts = ["", "a", "abcdefghijkl", "abcdefghijklm", "z" * 60, "é", "中文", "a\0b", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.bucket("t").alias("b"), (S.fnv1a("t") % S.BUCKETS).cast("int").alias("f")).collect()
    assert all(r["b"] == r["f"] for r in rows)
    # Once a term: evaluating it by functions over arrays took longer than cutting the texts.
    plan = spark.createDataFrame([("abc",)], "t string").select(S.bucket("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN" in plan.split("aggregate(")[0] and "octet_length" in plan


def test_tokens_with_and_without_cjk(spark):
    texts = ["Ab c1", "中文字 a", "中", "", "é b", None]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(S.tokens("t").alias("x")).collect()
    assert [r["x"] for r in rows] == [["ab", "c1"], ["中文", "文字", "a"], ["中"], [], ["b"], []]
