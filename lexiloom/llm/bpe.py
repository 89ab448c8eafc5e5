"""Byte-level BPE encoding and decoding with a local rank file.

Every match of the split pattern is encoded separately, as the tiktoken library does. Long texts are
cut first at places where the pattern always ends a match (white space after another character, or an ASCII
letter or digit before another kind), so that the library never sees a huge string; the ids do not depend on the cuts. A long run of white space
is one match but for its last character, which belongs to what follows; it is encoded as that, without
the pattern, whose look-ahead would overflow the library's stack. Decoding joins raw bytes, which need
not be valid UTF-8 token by token.

Defined results: null and empty texts have no ids; repeated rows repeat; other columns are ignored; texts
and runs of any length are encoded whole; a null doc_id stays null.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame

from lexiloom.llm import common

RANKS = "byte_bpe_multi_50k.tiktoken"
CUT_CHARS = 16_384
SAFE = re.compile(r"(?<=\S)(?=[ \t\r\n])|(?<=[A-Za-z])(?=[!-@\[-`{-~])|(?<=[0-9])(?=[!-/:-~])|(?<=[^\W\d_])(?=[、。，！？])")
#: Fixed value: the characters that the pattern's white space takes (Unicode's White_Space), in runs too long for it.
WHITE_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")


@functools.lru_cache(maxsize=4)
def codec(path: str, pattern: str):
    """The tiktoken encoder of a rank file, the decimal form of each id, and the encoder that takes white space whole."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
    of = lambda pat: tiktoken.Encoding(f"ranks:{path}", pat_str=pat, mergeable_ranks=ranks, special_tokens={})
    return of(pattern), [str(i) for i in range(max(ranks.values()) + 1)], of(r"\s+")


def safe_parts(text: str, limit: int = CUT_CHARS) -> list[str]:
    """Cut a text after at least `limit` characters, only where every pattern match ends."""
    parts, begin = [], 0
    while len(text) - begin > limit:
        cut = SAFE.search(text, begin + limit)
        if not cut:
            break
        parts.append(text[begin : cut.start()])
        begin = cut.start()
    parts.append(text[begin:])
    return parts


def encode_text(text: str | None, path: str, pattern: str) -> list[int]:
    encoding, _, whole = codec(path, pattern)
    if not text:
        return []
    if len(text) <= CUT_CHARS:
        return encoding.encode_ordinary(text)
    ids, begin = [], 0
    for run in WHITE_RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        ids += _encode_parts(text[begin : run.start()], encoding)
        ids += whole.encode_ordinary(text[run.start() : end])
        begin = end
    return ids + _encode_parts(text[begin:], encoding)


def _encode_parts(text: str, encoding) -> list[int]:
    return [i for part in safe_parts(text) for i in encoding.encode_ordinary(part)]


def decode_ids(ids: list[int], path: str, pattern: str) -> bytes:
    return codec(path, pattern)[0].decode_bytes(ids)


def ranks_path(name: str = RANKS) -> str:
    return public_tokenizers.path(name)


def encode(df: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Rows (doc_id, n_tokens, ids) of a table with doc_id and text."""
    common.prepare(df.sparkSession)
    path = path or ranks_path()

    def run(batches):
        for batch in batches:
            for part in common.slices(batch, "text"):
                ids = [encode_text(t, path, pattern) for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(len, ids), pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "n_tokens", "ids"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids array<int>")


def decode(df: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Rows (doc_id, decoded binary) of a table with doc_id and ids; null ids count as none."""
    common.prepare(df.sparkSession)
    path = path or ranks_path()

    def run(batches):
        for batch in batches:
            out = [decode_ids(ids or [], path, pattern) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "decoded"])

    return df.select("doc_id", "ids").mapInArrow(run, "doc_id long, decoded binary")


def round_trip(df: DataFrame, path: str | None = None, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """Encode and decode every text in one pass and return digests, so that ids never leave the worker.

    Rows: doc_id, n_tokens, ids_sha256 (of decimal ids joined by commas), decoded_sha256 (of the bytes).
    """
    common.prepare(df.sparkSession)
    path = path or ranks_path()

    def run(batches):
        sha, decimal = hashlib.sha256, codec(path, pattern)[1]
        for batch in batches:
            for part in common.slices(batch, "text"):
                n, a, b = [], [], []
                for text in part.column("text").to_pylist():
                    ids = encode_text(text, path, pattern)
                    n.append(len(ids))
                    a.append(sha(",".join(map(decimal.__getitem__, ids)).encode()).hexdigest())
                    b.append(sha(decode_ids(ids, path, pattern)).hexdigest())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
