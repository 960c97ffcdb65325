"""Large and small finite vectors, hostile pages, licence lines after line feeds."""

import math
import time
from fractions import Fraction

import duckdb
import numpy as np
import pytest

from trajspark.llm import ann, dom, licenses, queries, topk

SIZES = (1e-300, 1e-20, 1.0, 1e6, 1e17, 1e200, 1e300)


def vectors(spark, n=60, dim=6):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(dim) * SIZES[i % len(SIZES)]]) for i in range(n)]
    rows += [(n, rows[5][1]), (n + 1, None), (n + 2, [math.inf] * dim), (n + 3, [0.0] * dim)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>"), [r for r in rows if r[1] is not None and math.isfinite(r[1][0])]


def test_topk_of_any_finite_vectors(spark):
    table, rows = vectors(spark)
    top = 1.7976931348623157e308
    whole = {i: [math.floor(max(min(x * 64, top), -top)) for x in v] for i, v in rows}
    want = []
    for q in whole:
        if q % 20 == 0:
            scores = sorted((-min(max(sum(a * b for a, b in zip(whole[q], v, strict=True)), topk.LOWEST), topk.HIGHEST), i) for i, v in whole.items() if i != q)
            want += [(q, k, i, -s) for k, (s, i) in enumerate(scores[:20], 1)]
    assert sorted(map(tuple, topk.top_k(table, block=16, query_block=4).collect())) == sorted(want)


def test_ann_of_any_finite_vectors(spark):
    table, rows = vectors(spark)
    known = dict((i, v) for i, v in rows if any(v))
    got = {}
    for r in ann.nearest(table).collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))

    def product(a, b):
        exact = sum(Fraction(x) * Fraction(y) for x, y in zip(a, b, strict=True))
        return (math.inf if exact > 0 else -math.inf) if abs(exact) > Fraction(1.7976931348623157e308) else float(exact)

    assert set(got) == {q for q in known if q % 20 == 0}
    hits = 0
    for q, found in got.items():
        assert len(found) == 20
        for i, score in found:
            want = product(known[q], known[i])
            assert score == want or math.isclose(score, want, rel_tol=1e-9, abs_tol=1e-300 + 1e-12 * max(abs(x * y) for x, y in zip(known[q], known[i], strict=True) if math.isfinite(x * y)))
        best = sorted((-product(known[q], v), i) for i, v in known.items() if i != q)[:20]
        hits += len({i for _, i in best} & {i for i, _ in found})
    assert hits >= 0.9 * 20 * len(got)


@pytest.mark.parametrize("hostile", ["<b>x</i>", "<b>", "<li></li>", "<p><b>", "<ul><b>", "<div></p>", "<", "<a ", "<!--", '<a b="', "<td><i>"])
def test_reader_is_linear(hostile):
    def seconds(n):
        start = time.perf_counter()
        dom.read("<ul>" + "<b>" * n + hostile * n + "<li>x</li>" * n + "</p><p></p>" * n)
        return time.perf_counter() - start

    seconds(200)
    a, b = (min(seconds(n) for _ in range(2)) for n in (2000, 16_000))
    assert b < 40 * a + 0.1  # eight times the page; the square would be 64 times


def test_license_lines_within_a_sentence(spark):
    text = "Notes on the release\nLicensed under the Apache License, Version 2.0."
    rows = [(1, text), (2, "All rights\nreserved permissions\nReleased under the MIT License"), (3, None), (4, ""), (5, "no stem here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    con.execute("CREATE TABLE documents AS SELECT * FROM (VALUES " + ", ".join("(?::BIGINT, ?::VARCHAR)" for _ in rows) + ") v(doc_id, text)", [x for r in rows for x in r])
    want = con.execute(queries.license_sql()).fetchall()
    names = [c[0] for c in con.description]
    got = licenses.scan(docs).select(*names).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert {r["doc_id"]: r["licenses"] for r in got}[1] == "Apache-2.0"
