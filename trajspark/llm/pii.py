"""Operator 13: personal data by regular expressions, checksum validators and context words.

Patterns propose spans, validators confirm them (Luhn for cards, mod 97 for IBANs, ranges and digit counts for the others), and words close to a span
raise or lower its score. Base kinds (email, ip, card, phone) are kept whatever their score; the further kinds (iban, ssn, tel) are kept from
MIN_SCORE on, where they overlap no base span. Every pattern is anchored so that a text is read in time in proportion to its length, and Python's
engine does not recurse where Java's would on long runs of digits; texts go to the workers in Arrow batches, without a shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import own_name, text_or_empty

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "iban", "ssn", "tel")
#: Further spans are reported from this score on.
MIN_SCORE = 0.6
#: Code points before and after a span in which context words count.
BEFORE, AFTER = 48, 24
SPAN = "struct<start:int,kind:int,end:int,score:double>"

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_CHARACTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only start where a run of digits does (a later start in the run fails where the first one fails), hence the looks behind.
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=[\x20]?[A-Z0-9])")
SSN = re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])")
TEL = re.compile(r"(?<![0-9A-Za-z+.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9A-Za-z-])")

# Lengths of IBANs by country.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29,
    "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20,
    "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20,
}


class Context(NamedTuple):
    """A kind's score without any context, what a supporting word adds and what a doubting one takes away."""

    score: float
    support: re.Pattern
    doubt: re.Pattern


def _words(words: str) -> re.Pattern:
    return re.compile(r"\b(?:" + "|".join(words.split()) + r")\b", re.I)


_NEVER = re.compile(r"(?!)")
_CALL = "phone telephone tel call cell mobile fax contact whatsapp teléfono móvil llame téléphone portable appelez telefon handy anrufen"
CONTEXT = {
    "email": Context(0.9, _words("e-?mail mail contact write correo courriel kontakt"), _NEVER),
    "ip": Context(0.6, _words("ip ipv4 address host server client login dirección adresse"), _words("version v release section chapter build versión kapitel")),
    "card": Context(0.7, _words("card credit debit visa mastercard amex cvv expires tarjeta carte karte"), _words("isbn order invoice tracking serial id")),
    "phone": Context(0.7, _words(_CALL), _words("score ratio")),
    "iban": Context(0.9, _words("iban bank account swift bic konto cuenta compte transfer"), _NEVER),
    "ssn": Context(0.4, _words("ssn social security taxpayer"), _words("isbn order invoice part serial")),
    "tel": Context(0.4, _words(_CALL), _words("isbn order invoice part serial version")),
}
SUPPORT, DOUBT = 0.3, 0.3


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """The country and check digits go behind, letters count from 10; the number is 1 modulo 97."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost non-overlapping addresses. They are found from their @ signs, so that a long run of letters without one costs nothing."""
    done, at = 0, text.find("@")
    while at >= 0:
        start, after = at, at + 1
        while start > done and text[start - 1] in LOCAL_CHARACTERS:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            done = after = m.end()
        else:
            done = at + 1  # what stands before this sign cannot reach the next one
        at = text.find("@", after)


def _matches(pattern: re.Pattern, keep: Callable[[str], bool]) -> Callable[[str], Iterator[tuple[int, int]]]:
    return lambda text: (m.span() for m in pattern.finditer(text) if keep(m[0]))


def _octets(text: str) -> bool:
    return all(len(part.lstrip("0")) <= 3 and int(part.lstrip("0") or 0) <= 255 for part in text.split("."))


def _card(text: str) -> bool:
    digits = _digits(text) if len(text) <= 40 else ""
    return 14 <= len(digits) <= 19 and luhn(digits)


def _phone(text: str) -> bool:
    return 10 <= sum(c in "0123456789" for c in text) <= 15


def _ssn(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area < "900" and group != "00" and serial != "0000"


def ibans(text: str) -> Iterator[tuple[int, int]]:
    """As many letters and digits as the country has, parted by single spaces or none, with nothing of the kind behind, and the right checksum."""
    for m in IBAN.finditer(text):
        length = IBAN_LENGTHS.get(m[0][:2])
        if length is None:
            continue
        found, at = list(m[0]), m.end()
        while len(found) < length and at < len(text):
            if text[at] == " " and text[at - 1] != " ":
                at += 1
                continue
            if not (text[at].isascii() and (text[at].isdigit() or text[at].isupper())):
                break
            found.append(text[at])
            at += 1
        if len(found) == length and not (at < len(text) and text[at].isalnum()) and mod97("".join(found)):
            yield m.start(), at


FINDERS = {"email": emails, "ip": _matches(IP, _octets), "card": _matches(CARD, _card), "phone": _matches(PHONE, _phone), "iban": ibans, "ssn": _matches(SSN, _ssn), "tel": _matches(TEL, lambda text: True)}


def score(text: str, kind: str, start: int, end: int) -> float:
    """The kind's score, raised or lowered by the words nearby (those of the span do not count)."""
    own = CONTEXT[kind]
    near = text[max(0, start - BEFORE) : start] + " \0 " + text[end : end + AFTER]
    return round(min(1.0, max(0.0, own.score + SUPPORT * bool(own.support.search(near)) - DOUBT * bool(own.doubt.search(near)))), 3)


def spans(text: str) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, score) by start, then kind; kind numbers KINDS, places are code points, ends are exclusive."""
    found = [(start, k, end) for k, kind in enumerate(BASE) for start, end in FINDERS[kind](text)]
    taken = sorted((start, end) for start, _, end in found)
    starts = [start for start, _ in taken]
    reach, far = [], 0
    for _, end in taken:
        far = max(far, end)
        reach.append(far)
    out = [(start, k, end, score(text, KINDS[k], start, end)) for start, k, end in found]
    done = 0  # further spans keep clear of each other too, iban before ssn before tel
    more = sorted((start, k, end) for k, kind in enumerate(KINDS) if kind not in BASE for start, end in FINDERS[kind](text))
    for start, k, end in more:
        i = bisect_left(starts, end)  # base spans that begin before the end
        if start < done or i and reach[i - 1] > start:
            continue
        if (s := score(text, KINDS[k], start, end)) >= MIN_SCORE:
            out.append((start, k, end, s))
            done = end
    return sorted(out)


def _found(text: Column) -> Column:
    @F.pandas_udf(f"array<{SPAN}>")
    def run(texts: pd.Series) -> pd.Series:
        names = ("start", "kind", "end", "score")
        return pd.Series([[dict(zip(names, s, strict=True)) for s in spans(t)] if _may_hold(t) else [] for t in texts], dtype=object)

    return run(text)


_SOME = re.compile(r"[@+]|[0-9].?[0-9]", re.S)


def _may_hold(text: str) -> bool:
    return _SOME.search(text) is not None


def find_personal(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds `found`, an array of struct(start, kind, end, score) by start, then kind.

    Null and empty texts have none. Rows are independent: no shuffle, so repeated rows and hot keys cost nothing extra; each text is read whole.
    An input column named found gives way to the new one, all others stay whatever their names.
    """
    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() != "found"]
    return docs.select(*kept, _found(text_or_empty(f"`{text_col}`")).alias("found"))


def _masked(text: str, found: Iterable[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for start, kind, end in found:
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets (overlapping spans by the first one's), their columns kept.

    n_chars, where it exists, follows. Texts without spans, null ones too, stay as they are.
    """

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or not _may_hold(t) else _masked(t, [s[:3] for s in spans(t)]) for t in texts], dtype=object)

    new = own_name("text")
    out = docs.withColumn(new, run(F.col(f"`{text_col}`").cast("string")))

    def column(c: str) -> Column:
        if c == text_col:
            return F.col(new).alias(c)
        return (F.when(F.col(new).isNotNull(), F.length(new).cast(docs.schema[c].dataType)).otherwise(F.col("n_chars")) if c == "n_chars" else F.col(f"`{c}`")).alias(c)

    return out.select(*[column(c) for c in docs.columns])


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts by base kind, the digest of the base spans and the listing of all spans, of what find_personal returns."""
    base = F.filter("found", lambda s: s["kind"] < len(BASE))
    number = lambda k: F.size(F.filter("found", lambda s: s["kind"] == k)).cast("long")
    name = lambda s: F.element_at(F.lit(list(KINDS)), s["kind"] + 1)
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select(
        F.col(id_col).cast("long").alias("doc_id"),
        *[number(k).alias(f"n_{kind}") for k, kind in enumerate(BASE)],
        F.sha2(listed(base), 256).alias("base_sha256"),
        listed(F.col("found")).alias("spans"),
    )
