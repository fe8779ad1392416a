"""Main text of pages and nearest neighbours."""

import html
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from wellspring.llm import ann, html_text

SF = "/root/testdata/sf0.01"


def test_labelled_table_is_learnt():
    rows, labels = html_text.labelled_table()
    tree = html_text.trained()
    assert [html_text.decide(tree, r) for r in rows] == labels.tolist()


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    for r in html_text.with_main_text(pages).collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1].replace("<br>", " ")
        parts = [re.sub(r"<[^>]*>", "", p) for p in re.split(r"</?(?:p|h1)>", inner)]
        want = [" ".join(html.unescape(p).split()) for p in parts]
        assert r.text == "\n\n".join(w for w in want if w)


def test_odd_pages(spark):
    body = "<p>First words of a story that goes on for a while, about nothing.</p>"
    cases = {
        None: "",
        "": "",
        "<p": "",
        "<html><body></body></html>": "",
        f"<article>{body}": "First words of a story that goes on for a while, about nothing.",
        f"<div class='cookie-notice'>We use cookies</div><article>{body}<script>var x = '<p>no</p>'</script>"
        "<div class=comments><p>I am a reader with an opinion.</p></div></article>"
        "<footer>Imprint</footer>": "First words of a story that goes on for a while, about nothing.",
        "<main><h1>A &amp; B</h1><p>x\n\t y&nbsp;&lt;z&gt;<br>w</p><form><input>Name</form></main>": "A & B\n\nx y <z> w",
        "<article><p>" + "long " * 50_000 + "</p></article>": ("long " * 50_000).strip(),
    }
    rows = [(i, p) for i, p in enumerate(cases)] * 2
    pages = spark.createDataFrame(rows, "page_id long, html string").withColumn("url", F.lit(None).cast("string"))
    want = list(cases.values())
    for r in html_text.main_text(pages).collect():
        assert r.text == want[r.page_id] and r.n_chars == len(r.text)


def exact(ids, vectors, query, k=20):
    score = (vectors * vectors[query]).sum(axis=1)
    order = [i for i in np.lexsort((ids, -score)) if ids[i] != ids[query]]
    return [(int(ids[i]), score[i]) for i in order[:k]]


@pytest.mark.parametrize("clustered", [False, True])
def test_recall(spark, clustered):
    random = np.random.default_rng(1)
    vectors = random.standard_normal((3000, 24))
    if clustered:
        vectors = vectors * 0.2 + random.standard_normal((30, 24))[random.integers(0, 30, 3000)] * 2
    vectors[100:400] = vectors[100]  # copies: ties go to the smaller id
    vectors = vectors.astype(np.float32)
    ids = np.arange(3000)
    rows = [(int(i), v.tolist()) for i, v in zip(ids, vectors, strict=True)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [0.0] * 24, [nan] * 24, [inf] + [1.0] * 23, [None] + [1.0] * 23, [1.0], []]
    rows += [(4000 + 20 * i, v) for i, v in enumerate(odd)] + [(None, [1.0] * 24)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("list", F.lit("x"))
    found = ann.search(table, table.where("vec_id % 20 = 0")).collect()
    got = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert set(got) == {*range(0, 3000, 20)}
    wide = vectors.astype(float)
    hits = 0
    for q, rows in got.items():
        want = exact(ids, wide, q)
        assert len(rows) == 20 and rows == sorted(rows, key=lambda x: (-x[1], x[0]))
        assert all(s == (wide[i] * wide[q]).sum() for i, s in rows)
        hits += len({*want} & {*rows})
    assert hits / (20 * len(got)) >= 0.9
    copies = exact(ids, wide, 200)
    if copies[0][1] == copies[19][1]:
        assert got[200] == copies


def test_few_vectors(spark):
    table = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [2.0, 1.0])], "vec_id long, embedding array<float>")
    found = ann.search(table, table.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.vec_id, r.score) for r in found] == [(0, 20, 2.0), (0, 1, 0.5), (20, 0, 2.0), (20, 1, 1.5)]


def test_every_query_gets_its_number_where_a_third_are_copies(spark):
    random = np.random.default_rng(17)
    rows = random.standard_normal((1500, 16))
    rows[:500] = rows[0]
    rows[1450:] *= 30  # far from all others
    ids = np.r_[np.arange(1480), np.full(20, 1480)]  # one id occurs twenty times
    table = spark.createDataFrame(list(zip(ids.tolist(), rows.tolist(), strict=True)), "vec_id long, embedding array<double>")
    found = ann.search(table.repartition(4), table.where("vec_id % 20 = 0")).collect()
    queries = {int(i): rows[ids == i].tolist() for i in np.unique(ids[ids % 20 == 0])}
    got = {q: [] for q in queries}
    for r in found:
        assert r.vec_id != r.query_id
        got[r.query_id].append((r["rank"], r.score))
    assert all(sorted(k for k, _ in x) == list(range(1, 21)) for x in got.values())
    hit = 0
    for q, vectors in queries.items():
        best = np.sort((rows[ids != q] @ np.array(min(vectors))))[::-1][:20]
        hit += sum(s >= best[-1] - 1e-9 for _, s in got[q])
    assert hit >= 0.9 * 20 * len(queries)


def test_probes_go_on_until_enough_rows():
    order = np.array([[2, 0, 1], [1, 2, 0]])
    sizes = np.array([10, 500, 3])
    assert ann.probed(order, sizes, 1, np.array([20, 20])).tolist() == [3, 1]
    assert ann.probed(order, sizes, 2, np.array([5, 1000])).tolist() == [2, 3]
