"""Long runs of one character, and edits beside them."""

import random

import plain
import public_tokenizers

from lexiloom.llm import bpe, editcount


def test_edits_reencode_what_they_touch():
    path, pattern = bpe.ranks_path(), public_tokenizers.PATTERN
    count = lambda s: len(bpe.encode_text(s, path, pattern))
    text = plain.prose(random.Random(1), 20_000)
    for body in (text, text.replace(" ", ","), text.replace(" ", "7")):
        tree = editcount.CountTree(body, count)
        tree.edit(500, 0, body)
        assert tree.tokens[1] == count(tree.text()) and tree.encoded < len(body) + 4 * editcount.LEAF_CHARS
        before = tree.encoded
        for at in (600, 90_000, 120_000):
            tree.edit(at, 1, "x")
        assert tree.tokens[1] == count(tree.text()) and tree.encoded - before < 12 * editcount.LEAF_CHARS
        tree.edit(10, 150_000, "")
        assert tree.tokens[1] == count(tree.text()) and tree.chars[1] == len(tree.text())


def test_bpe_of_long_runs():
    path, pattern = bpe.ranks_path(), public_tokenizers.PATTERN
    enc = bpe.codec(path, pattern)[0]
    ids = lambda t: bpe.encode_text(t, path, pattern)
    for white in (" ", "\t", "\n", "\r\n", "　", " \n\x85"):  # what the library itself still takes
        for left, right in (("a", "b"), ("", "b"), ("a", ""), ("", ""), ("a ", "!"), ("7", "'s"), ("\x1c", "\x1c")):
            text = left + white * 20_000 + right
            assert ids(text) == enc.encode_ordinary(text)
            assert ids(text + text) == enc.encode_ordinary(text + text)
    for unit in (" ", "\t", "\n", "y", "!", "7", "é"):  # beyond it
        for n in (1_000_000, 5_000_000):
            text = "a" + unit * n + "b"
            assert bpe.decode_ids(ids(text), path, pattern).decode() == text
    assert ids(" " * 2_000_000 + "b") == enc._encode_single_piece(b" " * 1_999_999) + ids(" b")
