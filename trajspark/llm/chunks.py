"""Cached byte-level BPE over whole texts.

A text is cut at every single space that stands between two other characters. No pre-token of the public pattern spans such a
place (a space can only open a pre-token), so the chunks can be encoded alone and repeated chunks are looked up. Texts with
other runs of white space take the plain path: the pattern over the whole text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import numpy as np

#: Bytes of chunks kept per Python worker (an entry's overhead, its characters and ids counted); once full, further chunks are encoded each
#: time. It bounds memory and never changes results.
CACHE_BYTES, ENTRY_BYTES, CHARACTER_BYTES = 96_000_000, 200, 8


class ChunkEncoder:
    """encode(text) -> the ids as little-endian unsigned 32-bit bytes.

    encode_text gives the ids of any text; opens[i] says whether token i begins with a space, which marks where a chunk begins
    when many chunks are encoded in one call.
    """

    def __init__(self, encode_text: Callable[[str], np.ndarray], opens: np.ndarray, cache_bytes: int = CACHE_BYTES) -> None:
        self._encode_text = encode_text
        self._opens = opens
        self._limit, self._held = cache_bytes, 0
        self._cache: dict[str, bytes | None] = {}

    def _whole(self, text: str) -> bytes:
        return self._encode_text(text).astype("<u4").tobytes()

    def _new(self, chunks: list[str]) -> dict[str, bytes | None]:
        """The bytes of unseen chunks; None for those at which the text has other white space than a single space."""
        new = [c for c in set(chunks) if c not in self._cache]
        out: dict[str, bytes | None] = {c: None for c in new if not c or c[0].isspace() or c[-1].isspace()}
        if out:
            return out
        ids = self._encode_text(" " + " ".join(new)).astype("<u4")
        starts = np.flatnonzero(self._opens[ids])
        if len(starts) != len(new):  # a token of the vocabulary holds an inner space
            return {c: self._whole(" " + c) for c in new}
        data, ends = ids.tobytes(), [*(starts[1:] * 4).tolist(), len(ids) * 4]
        return {c: data[a:b] for c, a, b in zip(new, (starts * 4).tolist(), ends, strict=True)}

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        head, *rest = text.split(" ")
        if not rest:
            return self._whole(text)
        cache = self._cache
        try:
            out = b"".join(map(cache.__getitem__, rest))
        except KeyError:
            new = self._new(rest)
            if None in new.values():
                return self._whole(text)
            size = sum(ENTRY_BYTES + CHARACTER_BYTES * len(c) for c in new)
            if self._held + size <= self._limit:
                self._held += size
                cache.update(new)
                out = b"".join(map(cache.__getitem__, rest))
            else:
                out = b"".join([new[c] if c in new else cache[c] for c in rest])
        if not head or head[-1].isspace():
            return self._whole(text)
        return self._whole(head) + out


def read_ranks(path: str) -> dict[bytes, int]:
    import base64

    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def alphabet() -> dict[str, int]:
    """The letters of byte-level vocabularies: a printable Latin-1 byte is itself, the n-th other byte is character 256 + n."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(other)}


class AddedTokenEncoder:
    """The ids of the tokenizers library in its default setting: texts that hold an added token's string are encoded by the library itself."""

    def __init__(self, plain: ChunkEncoder, path: str, added: list[str]) -> None:
        self._plain, self._path, self._added = plain, path, added
        self._library = None

    def encode(self, text: str) -> bytes:
        if not any(a in text for a in self._added):
            return self._plain.encode(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        return np.array(self._library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@lru_cache(maxsize=2)
def library_encoder(path: str) -> AddedTokenEncoder | ChunkEncoder:
    """Ids that the tokenizers library gives for a byte-level BPE file; strings of added tokens are those tokens."""
    import json

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    tokens = model.get("added_tokens", ())
    plain = tokenizers_encoder(path)
    # matched otherwise than by their very string (normalised text, spaces taken along): all texts go to the library
    odd = model.get("normalizer") is not None and any(t.get("normalized") for t in tokens)
    return AddedTokenEncoder(plain, path, [""] if odd else [t["content"] for t in tokens]) if tokens else plain


@lru_cache(maxsize=2)
def tokenizers_encoder(path: str) -> ChunkEncoder:
    """Ids that the tokenizers library gives for a byte-level BPE file; strings of special tokens are ordinary text.

    The file's vocabulary lists its merges in rank order, so tiktoken, built from the same file, gives the same ids much
    faster (the tests compare the two).
    """
    import json

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    special = {t["content"] for t in model.get("added_tokens", ())}
    byte = alphabet()
    ranks = {bytes(byte[c] for c in token): i for token, i in model["model"]["vocab"].items() if token not in special}
    encoding = tiktoken.Encoding("byte-level", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    opens = np.zeros(max(ranks.values()) + 1, dtype=bool)
    opens[[i for token, i in ranks.items() if token[:1] == b" "]] = True
    return ChunkEncoder(lambda text: encoding.encode_to_numpy(text, disallowed_special=()), opens)


def as_ids(data: bytes) -> np.ndarray:
    return np.frombuffer(data, dtype="<u4")
