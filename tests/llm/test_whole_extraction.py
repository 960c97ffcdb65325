import itertools

import numpy as np
import pytest

from trajspark.llm import dom, extraction

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    return extraction.fit(spark.read.parquet(f"{SF}/pages.parquet"))


def test_decode_against_all_labellings():
    """The likeliest labelling without a kept node under a dropped one, found by trying every one."""
    rng = np.random.default_rng(5)
    for _ in range(60):
        n = int(rng.integers(1, 9))
        page = dom.Page(parent=[-1] + [int(rng.integers(-1, i)) for i in range(1, n)])
        odds = rng.normal(0, 2, n).tolist()
        sound = [k for k in itertools.product([False, True], repeat=n) if all(not k[i] or page.parent[i] < 0 or k[page.parent[i]] for i in range(n))]
        best = max(sum(o for o, kept in zip(odds, k, strict=True) if kept) for k in sound)
        got = extraction.decode(page, odds)
        assert tuple(got) in sound and np.isclose(sum(o for o, kept in zip(odds, got, strict=True) if kept), best)


def test_trees_against_plain_walks(model):
    rng = np.random.default_rng(2)
    x = np.stack([rng.choice(np.append(e, 0.5), 40) if len(e) else np.zeros(40) for e in model.edges], axis=1)
    got = model.log_odds(x)
    for row, value in zip(x, got, strict=True):
        total = model.prior
        for feature, cut, leaves in model.trees:
            at = 0
            for _ in range(model.depth):
                f = feature[at]
                at = 2 * at + 1 + int(np.searchsorted(model.edges[f], row[f], "left") > cut[at])
            total += leaves[at - len(feature)]
        assert np.isclose(total, value)


@pytest.mark.parametrize(
    ("source", "texts"),
    [
        ('<p>Hi there <a href="http://exa', ["Hi there"]),
        ('<p>x</p><p class="a>Hello</p>', ["x", "Hello"]),
        ("<p>foo <ins>bar</ins> <label>baz</label> qux</p>", ["foo bar baz qux"]),
        ('<p>foo</p><ins class="adsbygoogle">buy</ins><p>bar</p>', ["foo", "buy", "bar"]),
        ("<p>where <math><mi>x</mi></math> is 2 &lt; 3", ["where x is 2 < 3"]),
        ("<p>a<!-- b <p> -->c</p></ x>d", ["ac", "d"]),
        ("plain & simple", ["plain & simple"]),
        ("<p title='it\"s'>one</p><p title=\"it's\">two", ["one", "two"]),
        ("<script>if (a < b) '</p>'</script><p>z", ["z"]),
    ],
)
def test_tags_never_leak(source, texts):
    assert [t for t in dom.read(source).text if t] == texts


def test_odd_pages(spark, model):
    long = "<article>" + "<p>Some words stand here, and more of them. </p>" * 40_000 + "</article>"
    rows = [(1, "u", long, 7), (2, "u", "<p>a", 7), (2, "u", "<p>a", 7), (None, None, None, 7), (3, "u", "<" * 5000, 7), (4, "u", "<div>" * 3000 + "deep", 7)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    got = extraction.extract(pages, model).collect()
    assert len(got) == len(rows) and {r["page_id"] for r in got} == {1, 2, 3, 4, None}
    by_id = {r["page_id"]: r for r in got}
    assert by_id[None]["text"] == "" and by_id[1]["n_chars"] == 40_000 * len("Some words stand here, and more of them.") + 2 * 39_999
    assert extraction.fit(pages.where("page_id is null")) is None
