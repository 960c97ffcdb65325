"""Operator 11 against all pairs of words by edit distance, from texts to roots."""

import random
import re
import zlib
from collections import Counter

import pytest

from trajspark.llm import variants


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(words, times=2):
    out, forms = {}, {}
    for w, n in words.items():
        others = [x for x in words if near(w, x)]
        best = min(others, key=lambda x: (-words[x], x), default=None)
        forms[w] = best if best is not None and words[best] >= times * n else None
        out[w] = [forms[w], None, n, len(others), words[forms[w]] if forms[w] else None]
    for w, row in out.items():
        top = w
        while forms[top]:
            top = forms[top]
        row[1] = top
    return {(w, *row) for w, row in out.items()}


def counted(docs):
    c = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            k = h % len(run)
            c[run[:k] + run[k + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in c.items() if len(w) >= 5 and n >= 3}


def random_words(rng, letters, shortest, longest, number):
    words = {"".join(rng.choice(letters) for _ in range(rng.randint(shortest, longest))) for _ in range(number)}
    for w in list(words):
        for _ in range(2):
            i = rng.randrange(len(w))
            words.add(rng.choice([w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]]) or "x")
    return {w: rng.choice([1, 2, 3, 4, 8, 16, 40]) for w in words}


def got(spark, words, **more):
    rows = list(words.items()) if isinstance(words, dict) else words
    return {tuple(r) for r in variants.spelling_variants(spark.createDataFrame(rows, "word string, n long"), **more).collect()}


@pytest.mark.parametrize("letters,shortest,longest,long", [("ab", 1, 6, 64), ("abé", 7, 12, 64), ("ab", 8, 24, 64), ("ab", 3, 9, 5), ("aß漢\U0001d4b3b", 1, 14, 64), ("aé", 5, 12, 8)])
def test_against_all_pairs(spark, letters, shortest, longest, long):
    words = random_words(random.Random(longest * 7 + long), letters, shortest, longest, 60)
    assert got(spark, words, long=long) == plain(words)


def test_texts_to_words(spark):
    rng = random.Random(2)
    vocabulary = ["There", "theRe", "Élan", "élans", "Straße", "naïveté", "colour", "color", "colours", "x", "abcd", "×÷×÷×", "Łódź"]
    docs = [(i, rng.choice([" ", "\n", "1", "-", "'"]).join(rng.choice(vocabulary) for _ in range(rng.randrange(40)))) for i in range(300)]
    docs += [(None, "colour " * 30), (7, None), (8, ""), (9, "colour colour"), (9, "colour colour"), (10, "12 34 ?!")]
    table = spark.createDataFrame([(i, t, "q", 1) for i, t in docs], "doc_id long, text string, run string, h int")
    words = {r["word"]: r["n"] for r in variants.noisy_words(table).collect()}
    assert words == counted(docs)
    assert {tuple(r) for r in variants.spelling_variants(variants.noisy_words(table)).collect()} == plain(words)


def test_chains_ties_and_odd_rows(spark):
    chain = {"aaaaa" + "b" * k: 2 ** (12 - k) for k in range(10)}  # each one's form is the one a letter shorter
    rows = got(spark, chain)
    assert rows == plain(chain) and {r[2] for r in rows} == {"aaaaa"}
    ties = {"abcde": 4, "abcdf": 8, "abcdg": 8, "zzzzz": 4, "zzzz": 7}
    rows = {r[0]: r for r in got(spark, ties)}
    assert rows["abcde"][1] == "abcdf" and rows["abcde"][4] == 2 and rows["zzzzz"][1] is None and rows["zzzzz"][4] == 1
    doubled = [("abcde", 1), ("abcde", 2), (None, 5), ("", 3), ("abcdf", 6)]
    assert got(spark, doubled) == {("abcde", "abcdf", "abcdf", 3, 1, 6), ("abcdf", None, "abcdf", 6, 1, None)}
    assert got(spark, []) == set()
    with pytest.raises(ValueError):
        got(spark, [], times=1)


def test_runs_of_one_letter_and_whole_alphabet(spark):
    words = {"a" * k: k for k in range(1, 12)} | {f"stem{chr(c)}end": c for c in [*range(97, 123), *range(0xC0, 0x100)]} | {"stemend": 1000}
    assert got(spark, words) == plain(words)


def test_very_long_words(spark):
    rng = random.Random(9)
    base = "".join(rng.choice("abcé") for _ in range(30_000))
    words = {base: 40, base[:100] + base[101:]: 10, base[:20_000] + "z" + base[20_001:]: 9, base[:20_000] + "z" + base[20_001:] + "q": 3, "b" * 64: 3, "b" * 65: 6, "b" * 66: 12, "short": 3}
    assert got(spark, words) == plain(words)
