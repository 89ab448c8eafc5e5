"""Matches that a plain polynomial hash would confuse, and texts that hold an added token."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from test_contracts import frame, rows

from lexiloom.llm import common, tokenstore


@pytest.mark.parametrize("n", [2048, 100_000])
def test_words_of_regular_build_keep_their_ids(n):
    path = public_tokenizers.path(tokenstore.TOKENIZER)
    word = "".join("ab"[i.bit_count() % 2] for i in range(n))
    other = word.translate(str.maketrans("ab", "ba"))
    encoder, library = tokenstore.Encoder(path), tokenstore.tokenizer(path)
    for text in (word, other, f"{word} {other} {word}"):
        ids, sizes = encoder.encode([text, "", text])
        want = library.encode(text, add_special_tokens=False).ids
        assert ids.tolist() == want * 2 and sizes.tolist() == [len(want), 0, len(want)]


def test_added_tokens_are_the_librarys(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path(tokenstore.TOKENIZER))
    docs = [(2, "a <|endoftext|> b"), (1, "<|endoftext|>"), (3, "plain"), (3, "plain"), (None, "no id")]
    path = common.fresh_path(spark, "store-test")
    tokenstore.write(frame(spark, docs), path)
    got = tokenstore.read(spark, path).collect()
    want = sorted(((i or -1, np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4")) for i, t in docs), key=lambda x: x[0])
    assert sorted((r.doc_id or -1, r.n_tokens, r.ids_crc32) for r in got) == [(i, len(x), zlib.crc32(x.tobytes())) for i, x in want]
    assert sorted(r.start for r in got) == [0, *np.cumsum([len(x) for _, x in want])[:-1].tolist()]
    assert len(rows(tokenstore.read(spark, path))) == 4
