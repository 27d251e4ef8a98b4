"""Small cases of the operators, odd inputs among them."""

import math
import re

import pytest
from pyspark.sql import functions as F

from idforge.operators import analysis, experiments, instances, ordering, pages, quantize, relevance, retrieval
from idforge.sources import readers, writers


def test_rank_buckets(spark):
    df = spark.createDataFrame([(r,) for r in (1, 100, 101, 500, 501, 1000, 1001, None)], "rank int")
    assert [r.b for r in df.select(relevance.rank_bucket(F.col("rank")).alias("b")).collect()] == [0, 0, 1, 1, 2, 2, None, None]


def test_suffixes(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "k int, docid string")
    got = {r.k: r.docid for r in ordering.with_unique_suffix(df, "docid", ["k"]).collect()}
    assert got == {1: "a-1", 2: "a-2", 3: "b"}


def test_dense_index(spark):
    df = spark.range(1000).select(F.md5(F.col("id").cast("string")).alias("x"))
    rows = sorted((r.x, r.i) for r in ordering.dense_index(df, ["x"], start=5).collect())
    assert [i for _, i in rows] == list(range(5, 1005))
    assert ordering.dense_index(df.limit(0), ["x"]).count() == 0


def vectors(spark, n=64, dim=8):
    rows = [(i, [math.sin(i * 7.3 + k * 1.7) for k in range(dim)]) for i in range(n)]
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")


def test_quantiser_order_and_round_trip(spark):
    v = vectors(spark)
    book = quantize.seeded_codebook(v, 8, 2, 2)
    codes = quantize.encode(v, book)
    rows = {r.vec_id: r.codes for r in codes.collect()}
    assert all(len(c) == 4 for c in rows.values())
    assert all(rows[i][:2] == [i, i] for i in range(8))  # positions are level-major: both subspaces of level 0 first
    back = {r.vec_id: r.decoded for r in quantize.decode(codes, book).collect()}
    again = quantize.encode(spark.createDataFrame(list(back.items()), "vec_id bigint, embedding array<double>"), book)
    error = quantize.reconstruction_error(v, quantize.decode(codes, book)).first()
    assert math.isfinite(error.mse) and error.vectors == 64
    assert again.count() == 64


def test_quantiser_empty_and_null(spark):
    v = vectors(spark)
    book = quantize.seeded_codebook(v, 4)
    assert quantize.encode(v.limit(0), book).count() == 0
    null = spark.createDataFrame([(1, None)], "vec_id bigint, embedding array<float>")
    assert quantize.encode(null, book).count() == 0


def test_uniqueness_is_one_without_collisions(spark):
    c = spark.createDataFrame([(1, [1, 2]), (2, [1, 3])], "vec_id bigint, codes array<int>")
    assert analysis.uniqueness(c).first().uniqueness == 1.0
    assert analysis.uniqueness(c.limit(0)).first().uniqueness == 0.0


def test_balance(spark):
    h = spark.createDataFrame([(0, 0, 1), (0, 1, 3), (1, 0, 4)], "level int, token int, n bigint")
    b = {r.level: r for r in analysis.level_balance(h).collect()}
    p = [0.25, 0.75]
    assert b[0].entropy == pytest.approx(-sum(x * math.log(x) for x in p) / math.log(2))
    assert b[0].gini == pytest.approx(0.25) and b[1].entropy == 0.0 and b[1].gini == 0.0


def test_collision_order(spark):
    codes = spark.createDataFrame([(d, [7]) for d in "abc"], "docid string, codes array<int>")
    beams = spark.createDataFrame([("q", [7], 1)], "qid string, codes array<int>, rank int")
    truth = spark.createDataFrame([("q", "b")], "qid string, docid string")
    pred = {o: retrieval.expand(beams, codes, truth, o).first().pred for o in ("best", "worst")}
    assert pred == {"best": ["b", "a", "c"], "worst": ["a", "c", "b"]}


def test_trie_allows_only_known_codes(spark):
    codes = spark.createDataFrame([([1, 2],), ([1, 3],), ([4, 2],)], "codes array<int>")
    edges = retrieval.trie_edges(codes)
    scores = spark.createDataFrame([("q", s, t, -abs(t - 3.0)) for s in (0, 1) for t in range(6)], "qid string, step int, token int, logp double")
    got = [tuple(r.codes) for r in retrieval.beam_search(edges, scores, 2, 10).orderBy("rank").collect()]
    assert set(got) == {(1, 2), (1, 3), (4, 2)} and got[0] in {(1, 3), (4, 2)}


def test_upsert_keeps_old_values(spark):
    old = spark.createDataFrame([("a", 1.0, 2.0), ("b", 3.0, None)], "k string, x double, y double")
    new = spark.createDataFrame([("a", None, 5.0, "z"), ("c", 1.0, 1.0, "n")], "k string, x double, y double, note string")
    got = {r.k: (r.x, r.y, r.note) for r in experiments.upsert(old, new, ["k"]).collect()}
    assert got == {"a": (1.0, 5.0, "z"), "b": (3.0, None, None), "c": (1.0, 1.0, "n")}


def test_student(spark):
    """Against tabulated values, two and three runs included."""
    from idforge.operators import student
    from idforge.plans.q_experiments import T_TABLE

    assert all(abs(student.quantile(n + 1) - t) < 1e-8 for n, t in enumerate(T_TABLE))
    assert abs(student.quantile(1000) - 1.9623390808) < 1e-8 and abs(student.two_sided(1.9599639845, 1e9) - 0.05) < 1e-6
    assert student.two_sided(0.0, 3) == 1 and abs(student.two_sided(1.0, 1) - 0.5) < 1e-12
    got = spark.sql("select 0 as n union all select 1 union all select 2").select("n", student.t_quantile(F.col("n")).alias("q"), student.t_p_value(F.lit(4.302652729696), F.col("n")).alias("p")).collect()
    assert [(r.n, r.q and round(r.q, 6), r.p and round(r.p, 6)) for r in sorted(got)] == [(0, None, None), (1, 12.706205, round(1 - 2 / math.pi * math.atan(4.302652729696), 6)), (2, 4.302653, 0.05)]


def test_runs_of_two_and_three(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", 1.0), ("b", 2.0), ("b", 6.0), ("c", 5.0), ("d", None)], "m string, v double")
    got = {r.m: r for r in experiments.run_statistics(df, ["m"], "v").collect()}
    assert abs(got["a"].high - (2 + 12.7062047362)) < 1e-6 and abs(got["b"].low - (3 - 4.3026527297 * 7**0.5 / 3**0.5)) < 1e-6
    assert got["c"].low is None and got["c"].runs == 1 and got["d"].mean is None and got["d"].runs == 0


def test_paired_tests_with_nothing_to_test(spark):
    df = spark.createDataFrame([(k, float(k)) for k in range(5)], "q int, v double")
    same = experiments.paired_test(df, df, ["q"], "v").first()
    assert (same.pairs, same.difference, same.t, same.t_p, same.w_plus, same.z, same.w_p) == (5, 0.0, None, None, 0.0, None, None)
    none = experiments.paired_test(df.limit(0), df, ["q"], "v").first()
    assert none.pairs == 0 and none.t_p is None
    with pytest.raises(ValueError):
        experiments.kendall(df, [], "q", "v", most=3)


def test_passages_restart_with_the_title(spark):
    df = spark.createDataFrame([(1, "t", ["a b c", "d", "e f"]), (2, "t", [])], "k int, title string, sents array<string>")
    rows = instances.passage_rows(df, "k", F.col("title"), F.col("sents"), 4, 10).collect()
    assert [(r.k, r.part, r.tokens) for r in sorted(rows, key=lambda r: r.part)] == [(1, 0, ["t", "a", "b", "</s>"]), (1, 1, ["t", "d", "e", "</s>"])]


def test_nested_examples(spark):
    raw = "question_text string, example_id bigint, document_title string, document_url string, document_tokens array<struct<token:string>>, annotations array<struct<long_answer:struct<start_token:int,end_token:int>,short_answers:array<struct<start_token:int,end_token:int>>,yes_no_answer:string>>"
    words = "<H1> T </H1> <P> first part </P> <P> more text </P> <Ul> x </Ul> end".split()
    rows = [
        ("q", 5, "T", "u", [(w,) for w in words], [((3, 7), [(4, 5), (5, 6)], "NONE")]),
        (None, 6, None, None, [("a",), ("b",)], [((-1, -1), [], "NONE")]),
    ]
    got = {r.id: r for r in pages.flatten_examples(spark.createDataFrame(rows, raw)).collect()}
    assert got["5"].long_answer == "first part" and got["5"].short_answer == "first|part"
    assert got["5"].abstract.strip() == "first part" and got["5"].content == "more text x"
    assert got["6"].query == "" and got["6"].abstract == "" and got["6"].content == "a b" and got["6"].long_answer == ""


def test_line_readers_skip_what_is_malformed(spark, tmp_path):
    q = tmp_path / "q.tsv"
    q.write_text("1\tone\n2\n3\ta\tb\n")
    assert [(r.qid, r.query) for r in readers.queries_tsv(spark, str(q)).collect()] == [("1", "one")]
    assert readers.rejected_queries(spark, str(q)).count() == 2
    with pytest.raises(Exception, match="two fields"):
        readers.queries_tsv(spark, str(q), strict=True).collect()
    r = tmp_path / "qrels"
    r.write_text("1 0 D1 1\n1\t0\tD2\t2\n2 0 D3 x\n1 0 D4 0\n")
    assert {x.docid for x in readers.qrels(spark, str(r)).collect()} == {"D1", "D2"}
    assert {(x.qid, x.docid) for x in readers.last_qrels(spark, str(r)).collect()} == {("1", "D4"), ("2", "D3")}
    j = tmp_path / "x.json"
    j.write_text('{"id":"1","title":"t","doc_tac":"a\\tb\\nc"}\nnot json\n')
    assert [tuple(x) for x in readers.titles_texts(spark, str(j)).collect()][0] == ("1", "t", "a b c")
    f = tmp_path / "f.json"
    f.write_text('{"data": [{"a": 1, "b": "x"}, {"a": 2, "b": null}]}')
    assert [tuple(x) for x in readers.json_field(spark, str(f), "data", "a int, b string").collect()] == [(1, "x"), (2, None)]
    d = tmp_path / "dpr.json"
    d.write_text('{"question":"q","answers":["a"],"positive_ctxs":[{"title":"t","text":"x"}],"hard_negative_ctxs":[]}\n{"question":"r","answers":[],"positive_ctxs":[],"hard_negative_ctxs":[]}\n')
    assert readers.dpr(spark, str(d)).count() == 1


def test_page_outputs(spark, tmp_path):
    cols = ", ".join(f"{c} string" for c in readers.NQ)
    df = spark.createDataFrame([tuple(f"{c}\t1" for c in readers.NQ)], cols)
    writers.nq_outputs(df, df, df, str(tmp_path / "out"))
    back = readers.nq_tsv(spark, str(tmp_path / "out/train"))
    assert back.first().query == "query 1"
    writers.json_array(df.select("id"), str(tmp_path / "array"))
    assert spark.read.text(str(tmp_path / "array")).first().value == '[{"id":"id\\t1"}]'


def test_prefix_means_count_all_documents(spark):
    """A first code with most of the documents weighs as much as it has documents."""
    v = {r.vec_id: r.embedding for r in vectors(spark, 60).collect()}
    rows = [(i, [0 if i < 40 else 1 + i % 7, i % 3], e) for i, e in v.items()]
    df = spark.createDataFrame([*rows, (99, [50, 0], [1.0] * 8), (98, [0, 0], None)], "vec_id bigint, codes array<int>, embedding array<float>")

    def cos(a, b):
        return sum(x * y for x, y in zip(a, b)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b))

    modes = analysis.position_modes(2)
    for r in analysis.shared_token_similarity(df, modes).where("mode = 'hierarchical'").collect():
        groups = {}
        for _, c, e in rows:
            groups.setdefault(tuple(c[: r.k]), []).append(e)
        groups = [g for g in groups.values() if len(g) > 1]
        pairs = [[cos(a, b) for i, a in enumerate(g) for b in g[:i]] for g in groups]
        size = sum(map(len, groups))
        assert (r.pairs, r.groups, r.docs) == (sum(map(len, pairs)), len(groups), size)
        assert abs(r.by_document - sum(len(g) * sum(p) / len(p) for g, p in zip(groups, pairs)) / size) < 1e-9
        assert abs(r.similarity - sum(map(sum, pairs)) / sum(map(len, pairs))) < 1e-9
    assert analysis.shared_token_similarity(df.limit(0), modes).count() == 0 and analysis.shared_anywhere_similarity(df.limit(0), 2).count() == 0


def test_samples_of_small_tables(spark):
    df = spark.createDataFrame([(k, [k, 1], [float(k), 1.0]) for k in range(5)], "vec_id bigint, codes array<int>, embedding array<float>")
    for width in (2, 3):
        got = analysis.sampled_tuples(df, "vec_id", 2000, width).collect()
        members = [tuple(r[f"t{w}_vec_id"] for w in range(width)) for r in got]
        assert len(got) == 2000 and all(len(set(m)) == width for m in members) and len(set(members)) == (20 if width == 2 else 60)
        assert analysis.sampled_tuples(df.limit(width - 1), "vec_id", 10, width).count() == 0


def test_census_counts_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, "a"), (1, None), (2, "a"), (3, "b")], "k int, t string")
    assert analysis.duplicate_census(df, {"k": F.col("k"), "t": F.col("t")}).first().asDict() == {"rows": 4, "k": 3, "t": 2}
    assert analysis.duplicate_census(df.limit(0), {"k": F.col("k")}).first().asDict() == {"rows": 0, "k": 0}
    assert {(r.copies, r["values"]) for r in analysis.duplicate_histogram(df, F.col("t")).collect()} == {(2, 1), (1, 2)}


def test_alignment_leaves_nobody_with_itself(spark):
    docs = spark.createDataFrame([(f"d{k}",) for k in range(40)] + [("d1",), (None,)], "docid string")
    got = {r.docid: r.negative for r in relevance.shuffled_alignment(docs, "docid").collect()}
    assert len(got) == 40 and set(got.values()) == set(got) and all(a != b for a, b in got.items())
    assert relevance.shuffled_alignment(docs.where("docid = 'd1'"), "docid").count() == 0
    assert relevance.shuffled_alignment(docs.limit(0), "docid").count() == 0


def test_suffixes_of_a_hot_id_and_of_nulls(spark):
    df = spark.createDataFrame([(k, "the" if k % 3 else f"x{k}") for k in range(30)] + [(90, None), (91, None)], "k int, docid string")
    got = {r.k: r.docid for r in ordering.with_unique_suffix(df, "docid", ["k"]).collect()}
    hot = [k for k in range(30) if k % 3]
    assert [got[k] for k in hot] == [f"the-{i + 1}" for i in range(20)] and got[3] == "x3" and got[90] is None and len(got) == 32


def test_terms_and_passages_of_odd_texts(spark):
    """Nulls, nothing, repeats, ties and very long texts."""
    long = "word " * 3000 + "other"
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a b a c a d e f g h i j"), (4, long), (5, "x"), (3, "again again")], "k int, t string")
    rows = {(r.k, r.n, r.term): (r.c, r.at) for r in instances.term_places(df, "k", F.regexp_extract_all("t", F.lit("\\w+"), F.lit(0))).collect()}
    assert rows[3, 12, "a"] == (3, [0, 2, 4]) and rows[4, 3001, "other"] == (1, [3000]) and rows[4, 3001, "word"][0] == 3000 and rows[3, 2, "again"] == (2, [0, 1])
    assert not any(k in (1, 2) for k, *_ in rows) and instances.salient_terms(df.limit(0), "k", F.col("t")).count() == 0
    sents = df.select("k", F.lit(None).cast("string").alias("title"), F.when(F.col("k") != 1, F.array("t", F.lit(None))).alias("s"))
    parts = [(r.k, r.part, len(r.tokens)) for r in instances.passage_rows(sents, "k", F.col("title"), F.col("s"), 100, 3).collect()]
    assert (4, 0, 100) in parts and (4, 1, 1) in parts and not any(k == 1 for k, *_ in parts) and (5, 0, 2) in parts
    assert instances.passage_rows(sents.limit(0), "k", F.col("title"), F.col("s")).count() == 0


def test_json_arrays_are_valid(spark, tmp_path):
    import json

    for n in (0, 1, 5, 23_000):
        writers.json_array(spark.range(n).selectExpr("id", "'a\"b' as t").repartition(3), str(tmp_path / f"a{n}"))
        files = [f for f in (tmp_path / f"a{n}").glob("part-*") if f.stat().st_size]
        assert sorted(x["id"] for f in files for x in json.loads(f.read_text())) == list(range(n))


def test_last_lines_follow_their_files(spark, tmp_path):
    """A large file comes first in Spark's packing, whatever its name."""
    (tmp_path / "a.txt").write_text("".join(f"q{k % 7} 0 early{k} 1\n" for k in range(5000)))
    (tmp_path / "b.txt").write_text("q1 0 late 1\nq2 0 first 1\nq2 0 last 1\n")
    got = {r.qid: r.docid for r in readers.last_qrels(spark, str(tmp_path)).collect()}
    assert got["q1"] == "late" and got["q2"] == "last" and got["q3"] == f"early{max(k for k in range(5000) if k % 7 == 3)}"


def test_edit_ratio_against_its_definition(spark):
    from idforge.functions.similarity import similarity

    def matched(a, b):
        best = max(((k, -i, -j) for i in range(len(a)) for j in range(len(b)) for k in [next((n for n in range(min(len(a) - i, len(b) - j) + 1) if n == min(len(a) - i, len(b) - j) or a[i + n] != b[j + n]))]), default=(0, 0, 0))
        k, i, j = best[0], -best[1], -best[2]
        return k + matched(a[:i], b[:j]) + matched(a[i + k :], b[j + k :]) if k else 0

    pairs = [("1 - 9 - 4", "1 - 9 - 5"), ("", ""), ("abc", ""), ("10 - 2", "2 - 10"), ("abxcd", "abcd"), (None, "a")]
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity("edit_ratio")(F.col("a"), F.col("b")).alias("s")).collect()
    for r in got:
        want = None if r.a is None else 2 * matched(r.a, r.b) / (len(r.a) + len(r.b)) if r.a + r.b else 1.0
        assert (r.s is None) == (want is None) and (want is None or abs(r.s - want) < 1e-12)


def test_proportional_steps(spark):
    rows = spark.createDataFrame([("a", f"a{k}") for k in range(30)] + [("b", f"b{k}") for k in range(7)], "dataset string, key string")
    got = pages.proportional_steps(rows, 20, 2, 3).collect()
    for name, n, steps in (("a", 30, 16), ("b", 7, 4)):
        mine = [r for r in got if r.dataset == name]
        assert len(mine) == steps * 6 and {(r.rank, r.step) for r in mine} == {(a, b) for a in range(3) for b in range(steps)}
        assert len({(r.epoch, r.key) for r in mine}) == len(mine) and max(r.epoch for r in mine) == -(-steps * 6 // n) - 1
    assert pages.proportional_steps(rows.limit(0), 20, 2, 3).count() == 0


@pytest.mark.parametrize("bucket", [8192, 3])
def test_near_duplicate_vectors(spark, monkeypatch, bucket):
    """Classes against brute force: copies, chains of near ones, nulls, zeros; buckets in blocks, too."""
    import numpy as np

    from idforge.operators import nearest

    monkeypatch.setattr(nearest, "BUCKET", bucket)
    rng = np.random.default_rng(5)
    base = rng.standard_normal((40, 16))
    x = np.concatenate([base, base[:20] + 0.15 * rng.standard_normal((20, 16)), base[:5] * 2, np.repeat(base[:1], 30, axis=0) + 0.05 * rng.standard_normal((30, 16))])
    rows = [(int(k) * 3 - 40, v.tolist()) for k, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, base[7].tolist()), (902, base[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    ids = np.array([r[0] for r in rows if r[1] and any(r[1])])
    u = np.array([np.float32(r[1]) for r in rows if r[1] and any(r[1])], float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = np.argwhere(np.round(u @ u.T, 9) >= 0.9)
    top = {int(i): int(i) for i in ids}
    for _ in range(len(ids)):
        for a, b in links:
            least = min(top[int(ids[a])], top[int(ids[b])])
            top[int(ids[a])] = top[int(ids[b])] = least
    got = nearest.near_duplicate_vectors(df).collect()
    assert {r.vec_id: r["first"] for r in got} == top and len(got) == len(ids)
    assert nearest.near_duplicate_vectors(df.limit(0)).count() == 0 and nearest.near_duplicate_vectors(df.where("vec_id >= 900 and vec_id < 902")).count() == 0


def test_near_duplicates_are_met(spark):
    """Recall of pairs at the threshold itself, the worst case, against brute force."""
    import numpy as np

    from idforge.operators.nearest import hashed_tables, near_duplicate_vectors

    rng = np.random.default_rng(6)
    a = rng.standard_normal((1500, 24))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    side = rng.standard_normal((1500, 24))
    side -= (side * a).sum(1, keepdims=True) * a
    side /= np.linalg.norm(side, axis=1, keepdims=True)
    b = 0.9001 * a + (1 - 0.9001**2) ** 0.5 * side
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(np.concatenate([a, b]))], "vec_id bigint, embedding array<float>")
    got = {r.vec_id: r["first"] for r in near_duplicate_vectors(df, recall=0.95).collect()}
    assert sum(got[k] == got[k + 1500] for k in range(1500)) >= 0.92 * 1500
    bits, tables = hashed_tables(10**10, 0.9, 0.9)
    assert bits == 20 and tables < 60


def test_components(spark):
    """Chains, stars, random edges, repeats and loops against a union of sets."""
    import random

    from idforge.operators.components import connected_components

    rng = random.Random(11)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + k, 1001 + k) for k in range(50)] + [(5000, 5000 - k) for k in range(1, 60)] + [(7, 7), (1000, 1001)]
    up = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in range(len(up)):
        for a, b in edges:
            if a != b:
                up[a] = up[b] = min(up[a], up[b])
    df = spark.createDataFrame([*edges, (None, 1)], "u bigint, v bigint")
    rows = connected_components(df).collect()
    assert {r.node: r.component for r in rows} == up and len(rows) == len(up)
    assert connected_components(df.limit(0)).count() == 0


def _shuffled(spark, run) -> int:
    """Rows written to shuffles while ``run`` runs."""

    def total():
        sc = spark.sparkContext._jsc.sc()
        sc.listenerBus().waitUntilEmpty(30_000)
        none = spark.sparkContext._jvm.java.util.ArrayList()
        stages = sc.statusStore().stageList(none, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), none)
        return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in (stages.apply(k) for k in range(stages.size()))}

    before = total()
    run()
    return sum(n for k, n in total().items() if k not in before)


@pytest.mark.parametrize("block", [2_000_000, 40])
def test_bm25_makes_no_pairs(spark, monkeypatch, block):
    """Scores and ranks against brute force, ties and repeated ids included; a word of all queries and documents makes no row for each pair of them."""
    import math
    import random
    from collections import Counter

    from idforge.operators import bm25

    monkeypatch.setattr(bm25, "POSTINGS", block, raising=False)
    rng = random.Random(8)
    words = [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(["the", *rng.choices(words, weights=[1 / (i + 1) for i in range(60)], k=rng.randrange(1, 30))])) for k in range(700)]
    docs += [(1000 + k, docs[k][1]) for k in range(50)] + [(5, "the w3 w59"), (2000, ""), (2001, None), (2002, "...")]
    queries = [(f"q{k}", " ".join(["The", *rng.choices(words, k=rng.randrange(5))])) for k in range(120)] + [("empty", ""), ("none", None), ("odd", "unheard of")]
    split = [(k, re.findall(r"\w+", (t or "").lower())) for k, t in docs]
    split = [(k, t) for k, t in split if t]
    mean = sum(len(t) for _, t in split) / len(split)
    df = Counter(w for _, t in split for w in set(t))
    want = {}
    for q, text in queries:
        scores = Counter()
        for k, t in split:
            for w in set(re.findall(r"\w+", (text or "").lower())):
                if tf := t.count(w):
                    scores[k] += math.log(1 + (len(split) - df[w] + 0.5) / (df[w] + 0.5)) * tf * 1.82 / (tf + 0.82 * (1 - 0.68 + 0.68 * len(t) / mean))
        want |= {(q, r + 1): (k, s) for r, (s, k) in enumerate(sorted(((round(s, 6), k) for k, s in scores.items()), key=lambda x: (-x[0], x[1]))[:10])}
    d = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
    q = spark.createDataFrame(queries, "qid string, query string")
    got = []
    moved = _shuffled(spark, lambda: got.extend(bm25.bm25(d, q, 10).collect()))
    assert {(r.qid, r["rank"]): (r.doc_id, r.score) for r in got} == want and len(got) == len(want)
    if block > 40:
        assert moved < 120 * len(split) / 2
    assert bm25.bm25(d.limit(0), q, 10).count() == 0 and bm25.bm25(d, q.limit(0), 10).count() == 0


def test_salient_terms_broadcast_nothing(spark):
    """The terms of all documents aren't broadcast where the file of texts is small enough for that."""
    df = spark.createDataFrame([(k, f"a b c d e f g h i j k{k} l{k % 3}") for k in range(40)], "k int, t string")
    out = instances.salient_terms(df, "k", F.col("t"), 8)
    assert out.count() == 40
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_near_duplicates_are_exact(spark, monkeypatch):
    """Every pair at the threshold is found, whatever the recall asked for, with labels from pivots and in several blocks."""
    import numpy as np

    from idforge.operators import nearest

    for name, n in (("PIVOTS", 64), ("ALIKE", 4), ("BUCKET", 700)):
        monkeypatch.setattr(nearest, name, n, raising=False)
    rng = np.random.default_rng(9)
    x = rng.poisson(1.0, (900, 12)).astype(float)
    x = np.concatenate([x, x[:300] + (rng.random((300, 12)) < 0.2), rng.poisson(6.0, (200, 12))])
    x = x[x.any(1)]
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    top, near = np.arange(len(x)), np.round(u @ u.T, 9) >= 0.95
    while (top != (least := np.where(near, top[None, :], len(x)).min(1))).any():
        top = least
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(u)], "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r["first"] for r in nearest.near_duplicate_vectors(df, 0.95, recall=0.5).collect()}
    assert got == dict(enumerate(top.tolist())) and 10 < len(set(top.tolist())) < len(x)


def test_near_duplicates_link_labels_only(spark, monkeypatch):
    """What many pivots are near to isn't compared again: links are few however many vectors a class has; classes as by brute force, with several centres and blocks."""
    import numpy as np

    from idforge.operators import nearest

    monkeypatch.setattr(nearest, "BUCKET", 1000)
    rng = np.random.default_rng(12)
    x = np.concatenate([m * np.abs(rng.standard_normal(20)) + s * rng.standard_normal((n, 20)) for m, s, n in ((3, 0.6, 1300), (2, 0.7, 400), (0, 1, 200))])
    u = x / np.sqrt((x * x).sum(1, keepdims=True))
    top, near = np.arange(len(x)), np.round(u @ u.T, 9) >= 0.9
    while (top != (least := np.where(near, top[None, :], len(x)).min(1))).any():
        top = least
    edges, components = [], nearest.connected_components
    monkeypatch.setattr(nearest, "connected_components", lambda e: edges.append(e.count()) or components(e))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(u)], "vec_id bigint, embedding array<double>")
    got = {r.vec_id: r["first"] for r in nearest.near_duplicate_vectors(df, 0.9).collect()}
    assert got == dict(enumerate(top.tolist())) and np.bincount(top).max() > 1000 and len(set(top.tolist())) > 100
    assert edges[0] < len(x) / 5
