"""Operator 12 against the two libraries, all pairs of tokens, and every place of a cut."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from trajspark.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", "a", " ", "  two  spaces ", "Hello world, it's 12345 tokens.", "Hello world, it's 12345 tokens.", "naïve café — über ﬁn 東京 🎉🎉", "tabs\tand\nlines\r\n\n  x", "<s> </s> <unk> <|endoftext|> [x]", "a▁b", "é   　 x", "\u0000nul",
    "trailing ", "word " * 400, "abcdefghij" * 500, "The same words, the same words and the same words again.", "<0x41> is no byte",
]


@pytest.fixture(scope="module")
def libraries():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    names = {v: k for k, v in t.get_vocab().items()}
    s = sentencepiece.SentencePieceProcessor(model_file=B)
    return t, names, s


def plain(text, libraries):
    """Ids, groups and links straight from the libraries and all pairs of tokens."""
    t, names, s = libraries
    if not text:
        return [], [], [], []
    byte = alignment.alphabet()
    a = t.encode(" " + text, add_special_tokens=False).ids
    b = s.encode(text)
    ta = [bytes(byte[c] for c in names[i]) for i in a]
    tb = [bytes([int(s.id_to_piece(i)[3:5], 16)]) if s.is_byte(i) else s.id_to_piece(i).replace("▁", " ").encode() for i in b]
    data = (" " + text).encode()
    if b"".join(ta) != data or b"".join(tb) != data:
        return [], [], [], []
    ranges = lambda tokens: [(e - len(x), e) for x, e in zip(tokens, np.cumsum([len(x) for x in tokens]).tolist(), strict=True)]
    ra, rb = ranges(ta), ranges(tb)
    links = [(i, j) for i, (p, q) in enumerate(ra) for j, (x, y) in enumerate(rb) if p < y and x < q]
    ends = sorted({q for _, q in ra} & {y for _, y in rb})
    groups, low = [], 0
    for e in ends:
        groups.append(([i for i, (p, q) in zip(a, ra, strict=True) if low <= p and q <= e], [j for j, (x, y) in zip(b, rb, strict=True) if low <= x and y <= e]))
        low = e
    return a, b, links, groups


@pytest.mark.parametrize("piece", [2, 3, 7, 64, 8192])
def test_pieces_of_any_size(libraries, piece):
    a, b = alignment.byte_level(A), alignment.pieces(B)
    for text in TEXTS:
        ids_a, ids_b, links, groups = plain(text, libraries)
        doc = alignment.Aligned(text or "", a, b, piece)
        assert (doc.a.tolist(), doc.b.tolist()) == (ids_a, ids_b), text
        assert list(zip(doc.link_a.tolist(), doc.link_b.tolist(), strict=True)) == sorted(links)
        text_of = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        want = hashlib.sha256(text_of.encode()).hexdigest() if groups else ""
        for stretch in (1, 2, 5, 8192):
            assert alignment.group_text(len(a.table), len(b.table)).digest(doc, stretch) == want


def test_cuts_have_equal_work_and_part_no_tie():
    rng = random.Random(5)
    for _ in range(200):
        total = rng.randrange(2, 300)
        ea, eb = (np.array(sorted({*rng.sample(range(1, total), rng.randrange(total)), total})) for _ in range(2))
        for piece in (1, 2, 5, 50):
            cuts = alignment.merge_cuts(ea, eb, piece)
            assert cuts[0] == (0, 0) and cuts[-1] == (len(ea), len(eb))
            for (i, j), (p, q) in zip(cuts, cuts[1:], strict=False):
                assert i <= p and j <= q and p + q - i - j <= piece + 1
                assert max([*ea[i:p], *eb[j:q]], default=0) < min([*ea[p:], *eb[q:]], default=total + 1)
            parts = list(alignment.align(ea, eb, piece))
            assert sum(len(x) for x, _, _ in parts) == len(ea) + len(eb) - len(set(ea) & set(eb))
            assert sum(len(g) for _, _, g in parts) == len(set(ea) & set(eb))


def test_report_against_all_pairs(spark, libraries):
    texts = TEXTS + ["lorem ipsum dolor " * 30, "the the the"]
    rows = [(None if i == 5 else i, t, i, "z") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, pairs int, row string")
    every = [plain(t, libraries) for t in texts]
    counts = Counter((a[i], b[j]) for a, b, links, _ in every for i, j in links)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    want = []
    for (own, *_), (a, b, links, groups) in zip(rows, every, strict=True):
        n = [counts[a[i], b[j]] for i, j in links]
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        want.append((own, len(a), len(b), len(groups), len(links), sum(k == best[b[j]] for k, (_, j) in zip(n, links, strict=True)), sum(n), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    key = lambda r: tuple(-1 if x is None else x for x in r)
    for hot in (0, 7, 500_000):  # all pairs by the shuffle, some, none
        got = alignment.alignment_report(docs, A, B, piece=16, hot_pairs=hot)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    arrays = {r["doc_id"]: r for r in alignment.align_texts(docs, A, B).collect()}
    assert len(arrays[4]["a_ids"]) == len(every[4][0]) and arrays[0]["a_ids"] == [] and arrays[6]["group_a"][-1] == len(every[6][0])
    assert alignment.alignment_report(docs.limit(0), A, B).count() == 0
