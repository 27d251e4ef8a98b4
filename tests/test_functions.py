"""Hand-computed cases of the scalar and array operators."""

import math
import os

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from idforge.functions import docids, metrics, similarity, text
from idforge.sources import readers


def one(spark, **columns):
    exprs = [c.alias(n) for n, c in columns.items()]
    return spark.range(1).select(*exprs).first()


def arr(xs, kind="int"):
    return F.array(*map(F.lit, xs)).cast(f"array<{kind}>")


URLS = [
    ("https://shop.example/garden-tools/steel-rake/12345", "Rake", "steel rake"),
    ("http://a.example//news//world-cup-final", None, "url"),
    (None, "Only a Title", "title"),
    ("http://x.co/index", None, "domain"),
    (None, None, "skipped"),
    ("plain.example", None, "url"),
    ("http://b.co/12/34/56", "Numbers", "title_domain"),
]


def test_url_branches(spark):
    df = spark.createDataFrame([(u, t) for u, t, _ in URLS], "url string, title string")
    text_, branch = docids.url_title_docid(F.col("url"), F.col("title"))
    got = [(r.d, r.b) for r in df.select(text_.alias("d"), branch.alias("b")).collect()]
    assert got[0] == ("12345 steel rake garden tools shop.example", "url")
    assert got[1] == ("world cup final news a.example", "url")
    assert got[2] == ("only a title", "title")
    assert got[3] == ("x.co", "domain")
    assert got[4] == (None, "skipped")
    assert got[5] == ("plain.example", "url")
    assert got[6] == ("numbers b.co", "title_domain")


def test_docid_forms(spark):
    r = one(spark, a=docids.bracketed(F.lit(" [D12] ")), b=docids.unbracketed(F.lit("[ X ]")), t=docids.codes_to_tokens(arr([3, 1]), 10), s=docids.codes_text(arr([1, 9, 4])), n=docids.bracketed(F.lit(None).cast("string")))
    assert (r.a, r.b, r.t, r.s, r.n) == ("[d12]", "x", [32131, 32139], "1 - 9 - 4", None)


def test_prefix_example(spark):
    a, b = arr([1, 9, 4, 2]), arr([1, 9, 5, 3])
    r = one(spark, s=similarity.rq_simple(a, b), w=similarity.rq_weighted(a, b, size=16), f=similarity.full(a, b), same=similarity.hierarchical(a, a))
    assert r.s == 0.5 and r.f == 0.5 and r.same == 1.0
    assert r.w == pytest.approx(1 - 16 / (16**4 - 1))


def py_mix(a, b, c):
    total = 0
    for s in range(c):
        for x, y in zip(a[s::c], b[s::c]):
            if x != y:
                break
            total += 1
    return total / len(a)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 2), st.integers(0, 2)), min_size=4, max_size=4))
def test_similarity_properties(spark, pairs):
    a, b = [p[0] for p in pairs], [p[1] for p in pairs]
    x, y = arr(a), arr(b)
    r = one(spark, full=similarity.full(x, y), hier=similarity.hierarchical(x, y), m1=similarity.mix(x, y, subspaces=1), m2=similarity.mix(x, y, subspaces=2), m4=similarity.mix(x, y, subspaces=4))
    assert r.hier <= r.full
    assert r.m1 == r.hier and r.m4 == r.full
    assert r.m2 == pytest.approx(py_mix(a, b, 2))


def py_metrics(t, p):
    hits, ap, seen = 0, 0.0, set()
    for k, x in enumerate(p[:20]):
        if x in t and x not in seen:
            seen.add(x)
            hits += 1
            ap += hits / (k + 1)
    gain = sum(1 / math.log2(k + 2) for k, x in enumerate(p[:10]) if x in t)
    ideal = sum(1 / math.log2(k + 2) for k in range(len(t)))
    mrr = next((1 / (k + 1) for k, x in enumerate(p[:10]) if x in t), 0.0)
    return {"map_20": ap / max(1, len(t)), "ndcg_10": gain / max(0.3, ideal) if t else 0.0, "mrr_10": mrr, "r_10": sum(x in t for x in p[:10]) / len(t) if t else 0.0, "p_10": len(t & set(p[:10])) / max(1, len(p[:10])), "hit_1": float(bool(p[:1] and p[0] in t))}


CASES = [({"a"}, []), ({"a"}, ["a", "a", "b"]), ({"a", "b"}, ["x", "b", "a"]), ({"a"}, ["x"] * 12 + ["a"]), (set(), ["a"])]


def test_metric_edges(spark):
    rows = [(str(k), sorted(t), p) for k, (t, p) in enumerate(CASES)]
    got = {r.qid: r for r in metrics.evaluate(spark.createDataFrame(rows, "qid string, truth array<string>, pred array<string>")).collect()}
    for k, (t, p) in enumerate(CASES):
        for name, want in py_metrics(t, p).items():
            assert got[str(k)][name] == pytest.approx(want), (k, name)


def test_text(spark):
    r = one(
        spark, strip=text.strip_tags(F.lit("<P>a  <b>b</b>\nc</P>")), last=text.before_last(F.lit("x</Ul>y</Ul>z"), "</Ul>"), span=text.span(F.split(F.lit("a b c d"), " "), F.lit(1), F.lit(3)), none=text.span(F.split(F.lit("a b"), " "), F.lit(-1), F.lit(-1)),
        pad=text.padded(arr([5, 6]), 4), mask=text.mask(arr([5, 6]), 4), prompt=text.without_prompt(F.lit("Passage: Question: x")), sents=text.dotted_sentences(F.lit("A b. C.. ")), title=text.section_title(F.lit("xorqa:Name_parentSection")),
    )
    assert r.strip == "a bc" and r.last == "x</Ul>y" and r.span == "b c" and r.none == ""
    assert r.pad == [5, 6, 0, 0] and r.mask == [1, 1, 0, 0] and r.prompt == "x"
    assert r.sents == ["A b.", "C."] and r.title == "Name"


def test_pieces(spark):
    pytest.importorskip("tokenizers")
    from idforge.functions.tokenizers import PIECES, piece_ids, piece_round_trip

    if not os.path.exists(PIECES):
        pytest.skip("no vocabulary file")
    df = spark.createDataFrame([("Hello, World!",), ("ÉTÉ — 漢字",), ("",), (None,), ("A" * 5000,)], "t string")
    got = {r.t: (r.ids, r.back) for r in df.select("t", piece_ids(F.col("t")).alias("ids"), piece_round_trip(F.col("t")).alias("back")).collect()}
    assert got["Hello, World!"][1] == "hello , world !" and got["ÉTÉ — 漢字"][1] == "été — 漢字" and got[""] == ([], "") and got[None] == (None, None)
    assert got["A" * 5000][1].replace(" ", "") == "a" * 5000 and len(got["Hello, World!"][0]) == 4


def test_numbers_with_marks(spark, tmp_path):
    (tmp_path / "n.csv").write_text("1;1.234,50;x\n2;-7,25;y\n3;oops;\n4;;z\n")
    got = readers.csv(spark, str(tmp_path / "n.csv"), "k int, v double, t string", thousands=".", decimal=",", sep=";").collect()
    assert [(r.k, r.v, r.t) for r in got] == [(1, 1234.5, "x"), (2, -7.25, "y"), (3, None, None), (4, None, "z")]
