"""Edge cases (nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns) and brute force."""

import collections
import hashlib
import html
import math
import re
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from trajspark.llm import ann, bpe, extraction, licenses, near_dup, packing, quality, queries, secrets, token_counts, topk
from trajspark.llm.chunks import as_ids, read_ranks, tokenizers_encoder

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, start long"
LONG = "word " * 60_000 + "ende"
ODD = ["a  b", "  x\n\n y z ", "l'été d'un ami  \t hello\r\n", "", " ", "x" * 3000, "日本語 テキスト", "<|endoftext|> hi", "a \x00b", "a b\n", "a\n b", "x 's 't  y", LONG]


@pytest.fixture(scope="module")
def odd_docs(spark):
    rows = [(i, t, None, None, None, 0.5, 3) for i, t in enumerate(ODD)]
    rows += [(0, ODD[0], None, None, None, 0.5, 3), (None, "no id here", None, None, None, None, None), (100, None, None, None, None, None, None), (101, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


def test_bpe_against_tiktoken(spark, odd_docs, no_docs):
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    want = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=read_ranks(path), special_tokens={})
    docs = odd_docs.unionByName(spark.read.parquet(f"{SF}/documents.parquet"), allowMissingColumns=True)
    got = collections.Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_digests(docs, path, public_tokenizers.PATTERN).collect())
    expected = collections.Counter()
    for r in docs.select("doc_id", "text").collect():
        ids = want.encode_ordinary(r["text"] or "")
        expected[(r["doc_id"], len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest())] += 1
    assert got == expected
    assert bpe.encode_texts(no_docs, path, public_tokenizers.PATTERN).count() == 0


def test_chunks_against_tokenizers(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    plain.encode_special_tokens = True
    texts = [*ODD, *[r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]]
    own = tokenizers_encoder(path)
    for t in texts:
        assert as_ids(own.encode(t)).tolist() == plain.encode(t, add_special_tokens=False).ids


def test_full_cache_changes_nothing():
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = tokenizers_encoder(path)
    want = own.encode("one two three four two one")
    limit, own._limit, own._cache = own._limit, own._held + 1, {}
    try:
        assert own.encode("one two three four two one") == want and own.encode("one two three four two one") == want
    finally:
        own._limit, own._held = limit, 0


def test_token_counts(spark, odd_docs, no_docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    lengths = token_counts.encoded_lengths(odd_docs, path)
    n = sorted(r["n_tokens"] for r in lengths.collect())
    sums = token_counts.suffix_sums(token_counts.length_histogram(lengths))
    for r in sums.collect():
        over = [x for x in n if x >= r["n_tokens"]]
        assert (r["docs_at_least"], r["tokens_at_least"]) == (len(over), sum(over)) and r["truncated_total"] == sum(min(x, r["n_tokens"]) for x in n)
    for r in token_counts.answers(sums, [0, 5, 10**9]).collect():
        assert r["truncated_total"] == sum(min(x, r["context_limit"]) for x in n) and r["docs_over"] == sum(x > r["context_limit"] for x in n)
    for r in token_counts.quantiles(sums, [0.0, 0.5, 0.9, 1.0]).collect():
        assert r["n_tokens"] == n[max(1, math.ceil(r["share"] * len(n))) - 1]
    assert token_counts.suffix_sums(token_counts.length_histogram(token_counts.encoded_lengths(no_docs, path))).count() == 0


def test_packing(spark, odd_docs, no_docs):
    path = public_tokenizers.path("byte_bpe_50k.json")
    docs = odd_docs.unionByName(spark.read.parquet(f"{SF}/documents.parquet"), allowMissingColumns=True)
    rows = packing.pack(docs, path).collect()
    encoder = tokenizers_encoder(path)
    want = collections.Counter()
    total = 0
    for r in docs.select("doc_id", "text").collect():
        ids = np.append(as_ids(encoder.encode(r["text"] or "")), np.uint32(0)).astype("<u4")
        total += len(ids)
        first = len(ids) % 2048 or 2048
        start = 0
        for piece, end in enumerate(range(first, len(ids) + 1, 2048)):
            want[(r["doc_id"], piece, start, end - start, zlib.crc32(ids[start:end].tobytes()))] += 1
            start = end
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    room = collections.defaultdict(list)
    for r in rows:
        room[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in room.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(room) <= 1.02 * total / 2048 + 2
    assert packing.pack(no_docs, path).count() == 0


def test_secrets_against_regex(spark, odd_docs, no_docs):
    extra = ["token=short password: abcdefgh1", "api_key = 'AAAABBBBCCCC' AKIA1234567890ABCD", "TOKEN=token=abcdefgh", "AKIA123 " + "0a" * 20 + "é" + "ff" * 16, "secret: secret: abcdefghij", "k9Xq2LmZ8vRt4WpY7sBn1CdF zz"]
    docs = odd_docs.unionByName(spark.createDataFrame([(500 + i, t) for i, t in enumerate(extra)], "doc_id long, text string"), allowMissingColumns=True)
    model = secrets.train(spark.read.parquet(f"{SF}/documents.parquet"))
    got = {(r["doc_id"], r["base_sha256"], r["n_assign"], r["n_access"], r["n_hex"]) for r in secrets.digest(secrets.find_secrets(docs, model)).collect()}
    rules = [re.compile(secrets.ASSIGN), re.compile("AKIA[A-Z0-9]+"), re.compile("[0-9a-f]+")]
    want = set()
    for r in docs.select("doc_id", "text").collect():
        spans = []
        for k, (rule, group, least) in enumerate(zip(rules, (2, 0, 0), (8, 16, 32), strict=True)):
            spans += [(m.start(), k, m.end()) for m in rule.finditer(r["text"] or "") if len(m[group]) >= least]
        spans.sort()
        listed = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in spans)
        want.add((r["doc_id"], hashlib.sha256(listed.encode()).hexdigest(), *[sum(k == j for _, k, _ in spans) for j in range(3)]))
    assert got == want
    spans = {r["doc_id"]: r["spans"] for r in secrets.digest(secrets.find_secrets(docs, model)).collect()}
    assert "markov:0:24" in spans[505]
    docs_by_id = collections.defaultdict(list)
    for r in docs.collect():
        docs_by_id[r["doc_id"]].append(r)
    clean = {r["doc_id"]: r["text"] for r in secrets.redact(docs, model).collect()}
    assert clean[501] == "[SECRET]' [SECRET]" and clean[1] == ODD[1]
    for r in secrets.redact(docs, model).collect():  # brute force: marks in place of the merged spans
        text, found, out, at = docs_by_id[r["doc_id"]][0]["text"], spans[r["doc_id"]], "", 0
        for a, b in sorted(tuple(map(int, x.split(":")[1:])) for x in found.split(",") if x):
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        assert r["doc_id"] in (None, 0) or r["text"] == (None if text is None else out + text[at:])
    assert secrets.redact(docs, model).columns == docs.columns and secrets.find_secrets(no_docs, secrets.train(no_docs)).count() == 0


def test_licenses(spark, odd_docs, no_docs):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    texts = ["Hello. Released under the MIT License.\nMore.", mit, "Licensed under CC BY-NC 4.0. Licensed under the Apache License, Version 2.0.", "All rights reserved.", None, "the mit license is nice"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: (r["licenses"], r["unmatched"]) for r in licenses.scan(docs).collect()}
    assert got == {0: ("MIT", ""), 1: ("MIT", ""), 2: ("Apache-2.0,CC-BY-NC-4.0", ""), 3: ("", "reserved"), 4: ("", ""), 5: ("", "")}
    assert licenses.scan(odd_docs).count() == len(ODD) + 4 and licenses.scan(no_docs).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = queries.queries()[name](spark, SF)
    cursor = con.execute(queries.oracle_sql()[name])
    names = [x[0] for x in cursor.description]
    assert sorted(map(str, ([r[c] for c in names] for r in got.collect()))) == sorted(map(str, map(list, cursor.fetchall())))


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in v], 1) for i, v in enumerate(rng.normal(size=(400, 8)))]
    rows += [(20, rows[20][1], 1), (500, None, 1), (520, [1.0, None] + [0.0] * 6, 1), (540, [float("nan")] * 8, 1), (560, [float("inf")] * 8, 1), (580, [0.0] * 8, 1), (600, [1.0], 1), (None, [1.0] * 8, 1), (620, [1e9] * 8, 1), (621, [1e9] * 8, 1)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int")


def _best(vectors, measure, zero_ok):
    good = {r[0]: r[1] for r in vectors.collect() if r[0] is not None and r[1] and len(r[1]) == 8 and all(x is not None and math.isfinite(x) for x in r[1]) and (zero_ok or any(r[1]))}
    return {q: sorted(((-measure(v, good[q]), i) for i, v in good.items() if i != q))[:20] for q in good if q % 20 == 0}


def test_topk_against_brute_force(spark, vectors):
    floor = lambda v: [math.floor(64 * x) for x in v]
    want = _best(vectors, lambda a, b: sum(x * y for x, y in zip(floor(a), floor(b), strict=True)), True)
    got = collections.defaultdict(list)
    for r in topk.top_k(vectors.where("vec_id is null or vec_id < 620"), block=100, query_block=7).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((-r["score"], r["vec_id"]))
    want = _best(vectors.where("vec_id is null or vec_id < 620"), lambda a, b: sum(x * y for x, y in zip(floor(a), floor(b), strict=True)), True)
    assert got == want
    assert topk.top_k(vectors.limit(0)).count() == 0


def test_ann_recall(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    x = {r["vec_id"]: np.array(r["embedding"], dtype=float) for r in table.collect()}
    want = {q: {i for _, i in sorted((-float(x[q] @ v), i) for i, v in x.items() if i != q)[:20]} for q in x if q % 20 == 0}
    got = collections.defaultdict(set)
    for r in ann.nearest(table, shard=200).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert set(got) == set(want) and np.mean([len(want[q] & got[q]) / 20 for q in want]) >= 0.9


def test_ann_odd_vectors(spark, vectors):
    want = _best(vectors, lambda a, b: sum(x * y for x, y in zip(a, b, strict=True)), False)
    got = collections.defaultdict(dict)
    for r in ann.nearest(vectors, shard=150, query_block=7).collect():
        got[r["query_id"]][r["vec_id"]] = r["score"]
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    good = {r[0]: r[1] for r in vectors.collect() if r[0] is not None}
    assert all(i != q and math.isclose(s, sum(x * y for x, y in zip(good[q], good[i], strict=True)), rel_tol=1e-9) for q, own in got.items() for i, s in own.items())
    assert ann.nearest(vectors.limit(0)).count() == 0


def _brute_classes(texts):
    sets = [collections.Counter(zip(*[w[i:] for i in range(min(5, len(w)))], strict=False)) if (w := (t or "").lower().split()) else None for t in texts]
    top = list(range(len(texts)))

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            same = (texts[i] or "") == (texts[j] or "")
            if not same and sets[i] and sets[j] and len(set(sets[i]) & set(sets[j])) > 0:
                x, y = sets[i], sets[j]
                same = sum(1 / sum(max(x[k] / x[s], y[k] / y[s]) for k in set(x) | set(y)) for s in set(x) & set(y)) >= 0.8 - 1e-9
            if same:
                top[find(i)] = find(j)
    groups = collections.defaultdict(set)
    for i in range(len(texts)):
        groups[find(i)].add(i)
    return {frozenset(g) for g in groups.values()}


def near_copies(n, seed=5):
    rng = np.random.default_rng(seed)
    base = [f"w{x}" for x in rng.integers(0, 500, 120)]
    out = []
    for _ in range(n):
        own = list(base)
        for i in rng.choice(120, rng.integers(0, 7), replace=False):
            own[i] = f"z{rng.integers(0, 10**6)}"
        out.append(" ".join(own))
    return out


def test_near_duplicates_against_brute_force(spark, no_docs):
    texts = [*near_copies(60), "", None, "", " ", "one two", "one two", "One  two", "w " * 50, "w " * 60, LONG, *near_copies(5, 9)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = collections.defaultdict(set)
    for r in near_dup.near_duplicates(docs).collect():
        got[r["class_id"]].add(r["doc_id"])
    assert {frozenset(g) for g in got.values()} == _brute_classes(texts) and all(k == min(g) for k, g in got.items())
    assert near_dup.near_duplicates(no_docs).count() == 0


def test_large_groups_are_compared_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "CHUNK", 8)
    monkeypatch.setattr(near_dup, "BLOCK", 8)
    monkeypatch.setattr(near_dup, "STAR_ROUNDS", 1)
    texts = [*near_copies(50), *near_copies(20, 8)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = collections.defaultdict(set)
    for r in near_dup.near_duplicates(docs).collect():
        got[r["class_id"]].add(r["doc_id"])
    assert {frozenset(g) for g in got.values()} == _brute_classes(texts)


def test_deduplicated_keeps_one_of_each(spark, odd_docs, no_docs):
    out = near_dup.deduplicated(odd_docs)
    assert out.columns == odd_docs.columns and near_dup.deduplicated(no_docs).count() == 0
    assert sorted(str(r["doc_id"]) for r in out.collect()) == sorted(["None", *[str(i) for i in range(len(ODD)) if i not in (8, 9, 10)]])  # gone: the repeated row, null texts, other spellings of "a b"


def test_quality_held_out(spark, odd_docs, no_docs):
    sf = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    scored = queries.op1_quality(spark, sf).join(labels, "doc_id").where("held_out")
    y, s = map(np.array, zip(*[(r["quality"], r["score"]) for r in scored.select("quality", "score").collect()], strict=True))
    assert (s[y == 1][:, None] > s[y == 0][None, :]).mean() > 0.95 and ((s >= queries.GOOD) == (y == 1)).mean() > 0.95
    model = quality.fit(spark.read.parquet(f"{sf}/documents.parquet"), labels)
    got = [r["score"] for r in quality.score(odd_docs, model).collect()]
    assert len(got) == len(ODD) + 4 and all(0 <= x <= 1 for x in got)
    assert quality.fit(no_docs, labels.limit(0)) == 0.5 and quality.score(no_docs.drop("score"), 0.5).count() == 0


def test_extraction(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    model = extraction.fit(pages)
    extra = [
        (900, "u", None),
        (901, "u", ""),
        (902, "u", '<body><div class="menu"><ul><li><a href=/>Home</a></li><li><a href=/b>News</a></li></ul></div><div class="post"><h1>Caf&eacute; title here</h1><p>First  long sentence, with words &amp; more words in it.</p><div class="ad">Buy our things now, cheap.</div><p>Second long\n sentence, with other words. And a third one stands here.</p></div><div id="comments"><div class="comment"><p>I do not agree, at all.</p></div></div><div id="footer">&copy; 2020 Example</div></body>'),
        (903, "u", "<p>unclosed <b>text <script>var a='</p>'"),
    ]
    docs = pages.select("page_id", "url", "html").union(spark.createDataFrame(extra, "page_id long, url string, html string"))
    got = {r["page_id"]: r["text"] for r in extraction.extract(docs, model).collect()}
    assert got[900] == got[901] == ""
    assert got[902] == "Café title here\n\nFirst long sentence, with words & more words in it.\n\nSecond long sentence, with other words. And a third one stands here."
    for r in pages.collect():
        article = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<br>|</?b>|<[^>]*$", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert got[r["page_id"]] == "\n\n".join(p for p in parts if p)
    assert extraction.fit(pages.limit(0)) is None and extraction.extract(pages.limit(0), None).count() == 0


def test_pipeline_keeps_odd_rows_and_columns(spark, odd_docs):
    """Nulls, empty and long texts, repeated rows and columns named as the operators' own go through each stage."""
    docs = odd_docs.withColumns({"row": F.lit("r"), "found": F.lit("f"), "node": F.lit("n"), "class_id": F.lit(1)})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        rows = out.collect()
        assert {(r["row"], r["found"], r["node"], r["class_id"]) for r in rows} <= {("r", "f", "n", 1)}
        assert {(r["score"], r["start"]) for r in rows} <= {(0.5, 3), (None, None)}, name  # not overwritten
        docs = out if name != "quality" else docs  # the classifier may drop every odd row
    assert docs.count() == len(ODD) - 2 and stage is not None  # null texts and the repeated row meet their copies


def test_pipeline(spark, no_docs):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), SF).count() == 0, name
        docs = out
    rows = corpus_pipeline.run(spark, SF)
    assert {r["doc_id"] for r in rows.collect()} == {r["doc_id"] for r in docs.collect()}
    assert rows.agg(F.max(F.col("offset") + F.col("length"))).first()[0] <= 2048


def test_components(spark):
    from trajspark.llm.components import connected

    rng = np.random.default_rng(2)
    links = [(i, i + 1) for i in range(100, 160)] + [(200, 200 + i) for i in range(1, 50)] + [tuple(map(int, rng.integers(300, 400, 2))) for _ in range(70)] + [(1, 1)]
    links = [tuple(hashlib.md5(str(x).encode()).hexdigest() for x in pair) for pair in links]
    top = {}

    def find(i):
        while top.setdefault(i, i) != i:
            i = top[i]
        return i

    for a, b in links:
        if a != b:
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(links, "u string, v string")).collect()}
    assert got == {i: find(i) for i in list(top)}
    assert connected(spark.createDataFrame([], "u string, v string")).count() == 0
