import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from trajspark.llm import packing, token_counts
from trajspark.llm.chunks import as_ids, library_encoder

TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>y  z\n", "<|endoftext|", "plain text here", ""]


def test_added_tokens_against_the_library_as_it_is(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    want = [library.encode(t, add_special_tokens=False).ids for t in TEXTS]
    assert [as_ids(library_encoder(path).encode(t)).tolist() for t in TEXTS] == want and 50256 in want[0]
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    lengths = {r["doc_id"]: r["n_tokens"] for r in token_counts.encoded_lengths(docs, path, added_tokens=True).collect()}
    assert lengths == {i: len(ids) for i, ids in enumerate(want)}
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packing.pack(docs, path, added_tokens=True).collect()}
    assert got == {i: (len(ids) + 1, zlib.crc32(np.array([*ids, 0], dtype="<u4").tobytes())) for i, ids in enumerate(want)}
