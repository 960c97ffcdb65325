"""Operator 2 on small pages whose main text is plain to see, with the model of the given tables."""

import pytest
from pyspark.sql import functions as F

from trajspark.llm import extraction

TEXT = "The council met on Monday to talk about the new bridge, which will cost more than was planned and open two years later than hoped."
MENU = '<nav><ul><li><a href="/1">Home</a></li><li><a href="/2">News</a></li></ul></nav>'
CASES = {
    "list": (f"<article><h1>T</h1><p>{TEXT}</p><ul><li>one</li><li>two</li></ul></article>", ["T", TEXT, "one", "two"]),
    "short": (f"<article><p>{TEXT}</p><p>short</p></article>", [TEXT, "short"]),
    "letter": ("<article><p>A</p></article>", ["A"]),
    "cells": (f"<table><tr><td>{TEXT}</td><td>{TEXT[:118]}</td></tr></table>", [TEXT, TEXT[:118]]),
    "bare": ("plain text without any tags", ["plain text without any tags"]),
    "body": (f"<body><p>{TEXT}</p><p>Second one here.</p></body>", [TEXT, "Second one here."]),
    "page": (f"<body>{MENU}<article><h1>Title here</h1><p>{TEXT}</p><p>End.</p><table><tr><th>Name</th><th>Age</th></tr><tr><td>Bob</td><td>7</td></tr></table></article><footer>© 2020 Us</footer></body>", ["Title here", TEXT, "End.", "Name", "Age", "Bob", "7"]),
    "menu": (f"<body>{MENU}<footer>© us</footer></body>", []),
    "none": ("", []),
}


@pytest.fixture(scope="module")
def got(spark):
    model = extraction.fit(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"))
    pages = spark.createDataFrame([(i, name, html) for i, (name, (html, _)) in enumerate(CASES.items())] + [(99, "null", None)], "page_id long, url string, html string")
    return {r["url"]: r["text"] for r in extraction.extract(pages, model).collect()}


@pytest.mark.parametrize("name", CASES)
def test_main_text_of_small_pages(got, name):
    assert got[name] == "\n\n".join(CASES[name][1]) and got["null"] == ""


def test_training_pages_are_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(extraction, "layouts", lambda pages: seen.append(len(pages)) or [])
    rows = spark.range(5).select(F.col("id").alias("page_id"), F.when(F.col("id") < 2, F.repeat(F.lit("x"), extraction.TRAIN_CHARS + 1)).otherwise(F.lit("<article>a</article>")).alias("html"))
    assert extraction.fit(rows) is None and seen == [3]
