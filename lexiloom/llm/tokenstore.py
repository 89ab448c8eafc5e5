"""Token ids in a compact store: one zstandard dictionary, each document its own frame.

Encoding uses the tokenizers library. Its vocabulary splits text by a pattern and encodes each match
on its own, so a worker finds the matches with array operations, encodes every distinct match once
with the library and gathers ids from that. The character classes of the pattern are asked from the
library itself; texts with characters beyond CLASSED, or with the text of an added token, go through the
library as a whole. Matches are told apart by two 64-bit sums of tabulated random values of each character
and place, 128 bits in all; a match whose slot holds another is encoded anew.

Store (a folder): `dictionary/` (dictionary_sha256, dictionary) and `blocks/`, rows in ascending
doc_id order with the concatenated frames of up to BLOCK_BYTES, the dictionary's hash, and an offset
index (doc_ids, n_tokens, frame offsets). A document is read from one block's slice.

Defined results: null and empty texts hold only the end id; repeated rows repeat; null ids sort first;
texts of any length are encoded whole; other columns are ignored; an empty table gives an empty store.
"""

from __future__ import annotations

import functools
import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.llm import common

TOKENIZER = "byte_bpe_50k.json"
CLASSED = 0x3000
SPACE, LETTER, NUMBER, OTHER, EDGE = range(5)
BLOCK_BYTES = 2_000_000
#: The dictionary is fitted on so many documents, and so many bytes of the ids of each; it never changes what is read back.
SAMPLE_DOCS, SAMPLE_BYTES, DICTIONARY_BYTES = 2000, 32_000, 64_000
CACHE = 1_500_000
PART, SLICE = 300_000, 500_000
TURNS = common.mix64(np.arange(64, dtype=np.uint64) + np.uint64(1 << 40))
BLOCK_SCHEMA = "part int, seq int, dictionary_sha256 string, first_doc long, last_doc long, tokens long, doc_ids array<long>, n_tokens array<int>, offsets array<int>, frames binary"


def tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Encodes many texts at once; keeps the ids of distinct matches, within a bound."""

    def __init__(self, path: str):
        self.library = tokenizer(path)
        self.classes = self._classes()
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.value = [common.mix64(np.arange(1, CLASSED + 1, dtype=np.uint64) + np.uint64(k << 32)) for k in (0, 1)]
        self._clear()

    def _classes(self) -> np.ndarray:
        """The pattern's class of each character, by what the library's pre-tokenizer joins."""
        whole = lambda s: len(self.library.pre_tokenizer.pre_tokenize_str(s)) == 1
        out = np.zeros(CLASSED, np.uint8)
        for c in range(CLASSED):
            x = chr(c)
            out[c] = LETTER if whole(f"a{x}a") else NUMBER if whole(f"1{x}1") else OTHER if whole(f"!{x}!") else SPACE
        return out

    def _clear(self) -> None:
        self.slots = 1 << 22
        self.key, self.check, self.at = np.zeros(self.slots, np.uint64), np.zeros(self.slots, np.uint64), np.full(self.slots, -1, np.int32)
        self.start, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.used = {"start": 0, "size": 0, "flat": 0}

    def _append(self, name: str, values: np.ndarray) -> None:
        """Add to one of the arrays, which doubles when full."""
        held, n = getattr(self, name), self.used[name]
        end = n + len(values)
        if end > len(held):
            wider = np.empty(max(2 * len(held), end), held.dtype)
            wider[:n] = held[:n]
            setattr(self, name, held := wider)
        held[n:end] = values
        self.used[name] = end

    def starts(self, cp: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Where matches of the pattern begin; first: where texts begin (all texts non-empty)."""
        kind = self.classes[cp]
        prev, nxt, before = np.empty_like(kind), np.empty_like(kind), np.empty_like(cp)
        prev[1:], before[1:], nxt[:-1], nxt[-1] = kind[:-1], cp[:-1], kind[1:], EDGE
        prev[first], before[first] = EDGE, 0
        nxt[first[1:] - 1] = EDGE
        space = kind == SPACE
        begins = np.where(space, (prev != SPACE) | ((nxt != SPACE) & (nxt != EDGE)), (kind != prev) & (before != 32))
        q = np.flatnonzero((cp == 39) & begins & (nxt == LETTER))
        if len(q):
            a = cp[q + 1]
            one = np.isin(a, np.frombuffer(b"stmd", np.uint8))
            far = np.minimum(q + 2, len(cp) - 1)
            b = np.where(nxt[q + 1] == LETTER, cp[far], 0)
            two = ~one & (((a == ord("r")) & (b == ord("e"))) | ((a == ord("v")) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
            begins[q[one] + 1] = False
            begins[q[two] + 1] = False
            for end in (q[one] + 2, q[two] + 3):
                end = end[end < len(cp)]
                begins[end[(kind[end] == LETTER) & (prev[end] == LETTER)]] = True
        return np.flatnonzero(begins)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of each."""
        if self.used["start"] > CACHE:
            self._clear()
        joined = "".join(texts)
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        wide = [i for i, t in enumerate(texts) if t and ord(max(t)) >= CLASSED] if len(cp) and int(cp.max()) >= CLASSED else []
        if any(a in joined for a in self.added):
            wide = sorted({*wide, *(i for i, t in enumerate(texts) if any(a in t for a in self.added))})
        if wide:
            plain = [t for i, t in enumerate(texts) if i not in set(wide)]
            ids, n = self.encode(plain)
            parts = np.split(ids, np.cumsum(n)[:-1]) if len(plain) else []
            slow = iter(np.array(e.ids, np.int32) for e in self.library.encode_batch_fast([texts[i] for i in wide], add_special_tokens=False))
            fast, wide = iter(parts), set(wide)
            parts = [next(slow) if i in wide else next(fast) for i in range(len(texts))]
            return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)
        n_out = np.zeros(len(texts), np.int64)
        if not len(cp):
            return np.zeros(0, np.int32), n_out
        full = np.flatnonzero(lengths)
        first = np.concatenate([[0], np.cumsum(lengths[full])[:-1]])
        begin = self.starts(cp, first)
        which = self._known(joined, cp, begin)
        size = self.size[which]
        total = int(size.sum())
        offset = np.cumsum(size) - size
        ids = self.flat[np.repeat(self.start[which] - offset, size) + np.arange(total)]
        n_out[full] = np.add.reduceat(size, np.searchsorted(begin, first))
        return ids, n_out

    def _known(self, joined: str, cp: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The number of each match in the store of ids, by parts of about PART characters."""
        end = np.append(begin[1:], len(cp))
        which, i = np.empty(len(begin), np.int64), 0
        while i < len(begin):
            j = max(i + 1, int(np.searchsorted(end, begin[i] + PART, "right")))
            which[i:j] = self._known_part(joined, cp, begin[i:j], end[i:j])
            i = j
        return which

    def _known_part(self, joined: str, cp: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The same for adjoining matches; new ones are encoded by the library."""
        own, a, b = cp[begin[0] : end[-1]], begin - begin[0], end - begin[0]
        turn = _turns(np.arange(len(own)) - np.repeat(a, b - a))
        h, g = (common.mix64(np.add.reduceat(common.mix64(v[own] + turn), a) + (b - a).astype(np.uint64)) for v in self.value)
        slot = (h & np.uint64(self.slots - 1)).astype(np.int64)
        which = np.where((self.key[slot] == h) & (self.check[slot] == g), self.at[slot], -1)
        new = np.flatnonzero(which < 0)
        if len(new):
            order = new[np.lexsort((g[new], h[new]))]
            first = np.ones(len(order), bool)
            first[1:] = (h[order][1:] != h[order][:-1]) | (g[order][1:] != g[order][:-1])
            at, back = order[first], np.cumsum(first) - 1
            lists = [e.ids for e in self.library.encode_batch_fast([joined[a:b] for a, b in zip(begin[at].tolist(), end[at].tolist(), strict=True)], add_special_tokens=False)]
            size = np.fromiter(map(len, lists), np.int64, len(lists))
            number = self.used["start"] + np.arange(len(lists))
            self._append("start", self.used["flat"] + np.cumsum(size) - size)
            self._append("size", size)
            self._append("flat", np.fromiter((i for x in lists for i in x), np.int32, int(size.sum())))
            which[order] = number[back]
            s, last = np.unique(slot[at][::-1], return_index=True)  # one match a slot
            last = len(at) - 1 - last
            self.key[s], self.check[s], self.at[s] = h[at[last]], g[at[last]], number[last]
        return which


def _turns(place: np.ndarray) -> np.ndarray:
    """A random value of each place in a match."""
    return TURNS[place] if int(place.max()) < len(TURNS) else common.mix64(place.astype(np.uint64) + np.uint64(1 << 40))


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(path)


def serial(ids: np.ndarray) -> bytes:
    """The form that is compressed: little-endian 32-bit ids, low halves first, as most ids are small."""
    u = ids.astype("<u4")
    return (u & 0xFFFF).astype("<u2").tobytes() + (u >> 16).astype("<u2").tobytes()


def unserial(data: bytes) -> np.ndarray:
    half = np.frombuffer(data, "<u2").astype("<u4")
    n = len(half) // 2
    return half[:n] | half[n:] << 16


def _compressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdCompressor(level=1, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary of the samples; without enough of them their plain content."""
    import zstandard

    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def write(df: DataFrame, path: str, tokenizer_path: str | None = None, end_id: int = 0) -> None:
    """Encode doc_id, text and write the store. The dictionary is trained on SAMPLE_DOCS documents, those
    whose id hashes lowest; every document is encoded and stored."""
    spark = df.sparkSession
    common.prepare(spark)
    tokenizer_path = tokenizer_path or public_tokenizers.path(TOKENIZER)

    def ids_of(texts: list[str]):
        ids, n = encoder(tokenizer_path).encode([t or "" for t in texts])
        for part in np.split(ids, np.cumsum(n)[:-1]) if len(n) else []:
            yield np.append(part, np.int32(end_id))

    def sample(batches):
        for batch in batches:
            for part in common.slices(batch, "text", SLICE):
                ids = [serial(x[: SAMPLE_BYTES // 4]) for x in ids_of(part.column("text").to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column("h"), pa.array(ids, pa.binary())], ["h", "ids"])

    # of rows that share an id those whose text hashes lowest, so that reruns agree
    lowest = df.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    some = df.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h")).join(F.broadcast(lowest), "doc_id").select("h", "text")
    some = some.mapInArrow(sample, "h long, ids binary").orderBy("h", "ids").limit(SAMPLE_DOCS)
    samples = [bytes(r[1]) for r in some.collect()]
    dictionary = train_dictionary(sorted(samples))
    sha = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(sha, bytearray(dictionary))], "dictionary_sha256 string, dictionary binary").coalesce(1).write.parquet(f"{path}/dictionary")

    def compress(batches):
        z = _compressor(dictionary)
        for batch in batches:
            for part in common.slices(batch, "text", SLICE):
                arrays = list(ids_of(part.column("text").to_pylist()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(len, arrays), pa.int32()), pa.array([z.compress(serial(a)) for a in arrays], pa.binary())], ["doc_id", "n_tokens", "frame"])

    frames = common.materialize(df.select("doc_id", "text").mapInArrow(compress, "doc_id long, n_tokens int, frame binary"), "token-frames")

    def pack(batches):
        from pyspark import TaskContext

        encoder.cache_clear()  # the worker encodes no more
        part, seq, rows, size = TaskContext.get().partitionId(), 0, [], 0

        def block():
            ids, n, f = (list(x) for x in zip(*rows, strict=True))
            known = [i for i in ids if i is not None]
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "dictionary_sha256": sha, "first_doc": min(known, default=None), "last_doc": max(known, default=None), "tokens": sum(n), "doc_ids": ids, "n_tokens": n, "offsets": np.cumsum([0, *map(len, f)]).tolist(), "frames": b"".join(f)}], schema=form)

        form = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("dictionary_sha256", pa.string()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int32())), ("offsets", pa.list_(pa.int32())), ("frames", pa.binary())])
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows.append(row)
                size += len(row[2])
                if size >= BLOCK_BYTES:
                    yield block()
                    seq, rows, size = seq + 1, [], 0
        if rows:
            yield block()

    frames.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "n_tokens", "frame").mapInArrow(pack, BLOCK_SCHEMA).write.parquet(f"{path}/blocks")
    common.discard(frames)


def _dictionary(spark: SparkSession, path: str) -> dict[str, bytes]:
    return {r[0]: bytes(r[1]) for r in spark.read.parquet(f"{path}/dictionary").collect()}


def _frames(row: dict, dictionaries: dict[str, bytes]):
    import zstandard

    data = dictionaries[row["dictionary_sha256"]]
    if hashlib.sha256(data).hexdigest() != row["dictionary_sha256"]:
        raise ValueError("the dictionary is not the one that the block was written with")
    z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data) if data else None)
    for i, doc_id in enumerate(row["doc_ids"]):
        yield doc_id, z, row["frames"][row["offsets"][i] : row["offsets"][i + 1]]


def read(spark: SparkSession, path: str) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32) in the store's order, from the frames themselves."""
    common.prepare(spark)
    dictionaries = _dictionary(spark, path)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks")
    head = blocks.select("part", "seq", "tokens")
    parts = head.groupBy("part").agg(F.sum("tokens").alias("in_part")).withColumn("part_start", F.sum("in_part").over(Window.orderBy("part")) - F.col("in_part"))
    start = head.withColumn("block_start", F.sum("tokens").over(Window.partitionBy("part").orderBy("seq")) - F.col("tokens")).join(parts, "part").select("part", "seq", (F.col("part_start") + F.col("block_start")).alias("block_start"))

    def run(batches):
        encoder.cache_clear()
        for batch in batches:
            for row in batch.to_pylist():
                out, at = [], row["block_start"]
                for doc_id, z, frame in _frames(row, dictionaries):
                    ids = unserial(z.decompress(frame))
                    out.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
                    at += len(ids)
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.join(start, ["part", "seq"]).drop("first_doc", "last_doc", "n_tokens").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_document(spark: SparkSession, path: str, doc_id: int) -> list[list[int]]:
    """The id lists of the rows with this doc_id, by the offset index, without touching other frames."""
    dictionaries = _dictionary(spark, path)
    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(f"{path}/blocks").where((F.col("first_doc") <= doc_id) & (F.col("last_doc") >= doc_id))
    return [unserial(z.decompress(f)).tolist() for row in blocks.toLocalIterator() for i, z, f in _frames(row.asDict(), dictionaries) if i == doc_id]
