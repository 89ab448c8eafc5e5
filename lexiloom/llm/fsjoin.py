"""Similarity join on word shingles by vertical partitioning.

Shingles stand in one global order: rarer first by a counting sketch of fixed size over all texts, then
by hash. Any order that all documents share keeps the prefix filter exact, so the sketch only decides
how few candidates there are. Two sets with Jaccard similarity of at least 75 % share a shingle among
the first quarter (and one) of either. The order is cut into fragments of equal mass; overlaps are
counted per fragment and summed per pair.

Equal sets are one class from the start. Within a list of classes that share a prefix shingle, the
most typical class is first compared with all others. Then lists that still hold several components
are put in a random order, again and again, and neighbours of different components are compared: each
such round is linear in the lists, and a group of near copies falls into one component after a few of
them. Rounds only save work. What is left, every pair across components that can link by sizes and
places, is compared at last, so no link between components is lost. There the smaller set of a pair
is met at the first seventh of its shingles only, and sets meet by bands of size. Lists are streamed in
sorted order and never gathered; lists that the sketch knows to be long are dealt to several tasks.
Before a pair's sets are cut into fragments, the parities of two bits a shingle are compared: where they
differ the sets do, so the number of differences never exceeds the true one, and a pair that already has
too many cannot link.

Words and shingles are told apart by 64-bit hashes that sum a tabulated random value for each byte
and place, so that no texts of a regular build collide, whatever their length.

Defined results: null or wordless texts have no shingles and their own id as component; ties and
repeated rows fall into one class; other columns are ignored; very long texts and words are hashed
whole; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.llm import common

WORDS, PERCENT = 5, 75
CELLS, PARTS, FRAGMENTS, BITS = 1 << 19, 16, 4, 1 << 24
#: A list goes through one task up to so many rows, besides four times the mean of a sketch cell.
LIST_ROWS = 1 << 16
#: Comparisons a class gets in a round, at least; a round that joins less than this share of the open components is the last.
TRIES, WORTH = 3, 0.02
PLACES = 64


class Shingler:
    """Hashes of the distinct shingles of many texts at once."""

    def __init__(self, n: int = WORDS):
        self.n = n
        self.lower = np.arange(256, dtype=np.uint8)
        self.lower[65:91] += 32
        self.space = np.zeros(256, bool)
        self.space[[32, *range(9, 14)]] = True
        self.value = common.mix64(np.arange(1, PLACES * 256 + 1, dtype=np.uint64)).reshape(PLACES, 256)[:, self.lower].ravel()
        self.weight = common.mix64(np.arange(1000, 1000 + n, dtype=np.uint64)) | np.uint64(1)

    def words(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A hash of each word and its document's position."""
        if not len(data):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        solid = ~self.space[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[off] = True
        begin = solid.copy()
        begin[1:] &= ~solid[:-1] | edge[1:-1]
        end = solid.copy()
        end[:-1] &= ~solid[1:] | edge[1:-1]
        a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
        first = np.zeros(len(data), np.int64)
        first[a] = a
        place = np.arange(len(data)) - np.maximum.accumulate(first, out=first)
        value = self.value[(place % PLACES << 8) + data]
        far = np.flatnonzero((place >= PLACES) & solid)  # beyond the table its values are mixed with the number of the turn
        value[far] = common.mix64(value[far] + common.mix64((place[far] // PLACES).astype(np.uint64)))
        total = np.zeros(len(data) + 1, np.uint64)
        np.add.accumulate(value, out=total[1:])
        h = common.mix64(total[b] - total[a] + (b - a).astype(np.uint64))
        return h, np.searchsorted(off, a, "right") - 1

    def shingles(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(document, hash) of all shingles, not yet distinct, documents in ascending order."""
        w, doc = self.words(data, off)
        per = np.bincount(doc, minlength=len(off) - 1)
        first = np.cumsum(per) - per
        full = len(w) - self.n + 1
        if full > 0:
            h = np.zeros(full, np.uint64)
            for k in range(self.n):
                h += w[k : full + k] * self.weight[k]
            whole = doc[:full] == doc[self.n - 1 :]
            h, d = common.mix64(h[whole]), doc[:full][whole]
        else:
            h, d = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        short = np.flatnonzero((per > 0) & (per < self.n))
        if len(short):
            extra = np.array([common.mix64(np.array([(w[first[i] : first[i] + per[i]] * self.weight[: per[i]]).sum() + np.uint64(per[i])]))[0] for i in short], np.uint64)
            h, d = np.concatenate([h, extra]), np.concatenate([d, short])
            order = np.argsort(d, kind="stable")
            h, d = h[order], d[order]
        return d, h

    def distinct(self, data: np.ndarray, off: np.ndarray, level: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(document, key) of the distinct shingles in the global order; the key holds level and hash."""
        d, h = self.shingles(data, off)
        key = order_key(h, level) if level is not None else h
        order = np.lexsort((key, d))
        d, key = d[order], key[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (key[1:] != key[:-1])
        return d[new], key[new]


def order_key(h: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The place of a shingle in the global order: the sketch's level, then the hash."""
    return level[(h & np.uint64(CELLS - 1)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | h >> np.uint64(8)


def ids_of_sets(key: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The id of each set of n keys in turn: a hash of the hashes without the level, in any order."""
    total = np.concatenate([np.zeros(1, np.uint64), np.add.accumulate(common.mix64(key & np.uint64((1 << 56) - 1)))])
    end = np.cumsum(n)
    return common.mix64(total[end] - total[end - n] + n.astype(np.uint64)).view(np.int64)


def parities(d: np.ndarray, h: np.ndarray, n: np.ndarray) -> pa.Array:
    """For each of the sets of n hashes: the parity of their number in each of 2 n cells or more, a power of two of them.
    Wider ones fold into narrower ones by exclusive or."""
    wide = np.int64(1) << np.ceil(np.log2(np.maximum(64, 2 * n))).astype(np.int64)
    first = np.cumsum(wide) - wide
    cell = first[d] + ((h >> np.uint64(20)) & (wide[d] - 1).astype(np.uint64)).astype(np.int64)
    bits = np.packbits((np.bincount(cell, minlength=int(wide.sum())) & 1).astype(bool), bitorder="little")
    return pa.array([bits[a : a + w].tobytes() for a, w in zip((first // 8).tolist(), (wide // 8).tolist(), strict=True)], pa.binary())


def differences(x: bytes, y: bytes) -> int:
    """In how many cells the parities differ; the wider is folded."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) != len(b):
        a, b = (a, b) if len(a) > len(b) else (b, a)
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


def sets(df: DataFrame) -> DataFrame:
    """Rows (doc_id, n_shingles, set_id, text_hash, bits) and, with `part` set, rows of the counting sketch."""

    def run(batches):
        s, cells, names = Shingler(), np.zeros(CELLS, np.int64), ["doc_id", "n_shingles", "set_id", "text_hash", "bits", "part", "cells"]
        for batch in batches:
            for part in common.slices(batch, "text"):
                d, h = s.distinct(*common.text_buffer(part.column("text")))
                cells += np.bincount((h & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS) if len(h) > CELLS // 16 else 0
                if len(h) <= CELLS // 16:
                    np.add.at(cells, (h & np.uint64(CELLS - 1)).astype(np.int64), 1)
                n = np.bincount(d, minlength=part.num_rows)
                set_id = ids_of_sets(h >> np.uint64(8), n)
                none = pa.nulls(part.num_rows)
                bits = parities(d, h, n)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(set_id), part.column("text_hash"), bits, none.cast(pa.int32()), none.cast(pa.binary())], names)
        size = CELLS // PARTS
        for k in range(PARTS if cells.any() else 0):
            yield pa.RecordBatch.from_arrays([*(pa.nulls(1, pa.int64()) for _ in range(4)), pa.nulls(1, pa.binary()), pa.array([k], pa.int32()), common.binary([cells[k * size : (k + 1) * size].astype(np.int32)])], names)

    return df.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, "doc_id long, n_shingles long, set_id long, text_hash long, bits binary, part int, cells binary")


def sketch_levels(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """The level of each cell (about 4 log2 of its count), the mass of each level, and the rows of a list that one
    task may get. CELLS numbers in all."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, cells in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                held[k] = held.get(k, 0) + np.frombuffer(cells, np.int32).astype(np.int64)
        for k, cells in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), common.binary([cells])], ["part", "cells"])

    count, size = np.zeros(CELLS, np.int64), CELLS // PARTS
    for k, cells in rows.where("part is not null").select("part", "cells").repartition(PARTS, "part").mapInArrow(run, "part int, cells binary").collect():
        count[k * size : (k + 1) * size] += np.frombuffer(cells, np.int64)
    level = np.minimum(255, 4 * np.log2(1.0 + count)).astype(np.uint8)
    return level, np.bincount(level, count, 256), float(LIST_ROWS + 4 * count.mean())


def pivots(mass: np.ndarray, n: int = FRAGMENTS) -> np.ndarray:
    """Keys that cut the global order into n fragments of equal mass."""
    total, out = np.cumsum(mass), []
    for k in range(1, n):
        want = total[-1] * k / n
        lv = int(np.searchsorted(total, want))
        inside = (want - (total[lv] - mass[lv])) / max(1.0, mass[lv])
        out.append((lv << 56) | int(min(0.999999, inside) * (1 << 56)))
    return np.array(out, np.uint64)


def postings(df: DataFrame, level: np.ndarray) -> DataFrame:
    """Rows (token, set_id, n, place, typical) of the prefix of every set; place: how many of its shingles come
    before the token. Equal rows of a batch are sent once."""

    def run(batches):
        s = Shingler()
        for batch in batches:
            seen = []
            for part in common.slices(batch, "text"):
                data, off = common.text_buffer(part.column("text"))
                d, key = s.distinct(data, off, level)
                n = np.bincount(d, minlength=part.num_rows)
                first = np.cumsum(n) - n
                set_id = ids_of_sets(key, n)
                typical = np.bincount(d, (key >> np.uint64(56)).astype(float), part.num_rows) / np.maximum(1, n)
                keep = n - (PERCENT * n + 99) // 100 + 1
                place = np.arange(len(d)) - first[d]
                pick = place < keep[d]
                seen.append((key[pick].view(np.int64), set_id[d[pick]], n[d[pick]].astype(np.int64), place[pick], (typical[d[pick]] * 256).astype(np.int32)))
            if not seen:
                continue
            token, set_ids, n, place, typical = (np.concatenate(x) for x in zip(*seen, strict=True))
            order = np.lexsort((set_ids, token))
            new = np.ones(len(order), bool)
            new[1:] = (np.diff(token[order]) != 0) | (np.diff(set_ids[order]) != 0)
            order = order[new]
            for a in range(0, len(order), 100_000):
                some = order[a : a + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (token, set_ids, n, place, typical)], ["token", "set_id", "n", "place", "typical"])

    return df.select("text").mapInArrow(run, "token long, set_id long, n long, place long, typical int")


def dealt(bound: float, turn: int):
    """The part of its list that a row goes to: lists that may have more than `bound` rows by the sketch are dealt to
    several tasks, each turn otherwise."""
    return F.pmod(F.xxhash64("set_id", F.lit(turn)), deals(bound)).cast("int")


def deals(bound: float):
    """In how many parts the list of a token is dealt: what its sketch cell counts over `bound`."""
    return F.ceil(F.pow(F.lit(2.0), F.shiftrightunsigned("token", 56) / 4) / F.lit(bound)).cast("long")


def shared(table: DataFrame, bound: float) -> DataFrame:
    """Rows (token, lead, n_lead, place_lead, set_id, n, place): every class of a list of several once, with the most
    typical, which stands with itself. Of a list that is dealt to several tasks each part has its own lead."""
    names = ("set_id", "n", "place")

    def run(batches):
        token, part, last, held, alone = None, 0, 0, (0, 0, 0), False
        for batch in batches:
            t, p, many, *own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "part", "many", *names))
            if not len(t):
                continue
            first = np.ones(len(t), bool)
            first[1:] = (t[1:] != t[:-1]) | (p[1:] != p[:-1])
            if token is not None and t[0] == token and p[0] == part:
                first[0] = False
            at = np.maximum.accumulate(np.where(first, np.arange(len(t)), -1))
            lead = [np.where(at >= 0, x[at], h).astype(x.dtype) for x, h in zip(own, held, strict=True)]
            s = own[0]
            before = np.concatenate([[last], s[:-1]])
            other = np.flatnonzero(~first & (s != lead[0]) & (s != before))
            # a lead stands with itself once its list has a second class, or at once if the list is dealt
            lists, second = np.unique(at[other], return_index=True)
            wait = (lists >= 0) | alone
            second = other[second[wait]]
            second = second[~many[second]]
            leads = np.concatenate([second, np.flatnonzero(first & many)])
            more = len(lists) and lists[-1] == at[-1]
            alone = bool(not many[-1] and not more and (at[-1] >= 0 or alone))
            token, part, last, held = t[-1], p[-1], s[-1], tuple(x[-1] for x in lead)
            out = [np.concatenate([x[other], x[leads]]) for x in (t, *lead)] + [np.concatenate([x[other], y[leads]]) for x, y in zip(own, lead, strict=True)]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, out)), ["token", "lead", "n_lead", "place_lead", *names])

    rows = table.withColumn("part", dealt(bound, 0)).withColumn("many", deals(bound) > 1)
    rows = rows.repartition("token", "part").sortWithinPartitions("token", "part", F.desc("typical"), "set_id")
    return rows.select("token", "part", "many", *names).mapInArrow(run, "token long, lead long, n_lead long, place_lead long, set_id long, n long, place long")


def neighbours(table: DataFrame, bound: float, turn: int) -> DataFrame:
    """Pairs (a, b, n_a, n_b) of different components that can link and stand side by side where every list is put
    in a random order, and of these the TRIES first of each class in another. Linear in the lists."""
    names = ("set_id", "n", "place", "component")

    def run(batches):
        held = None
        for batch in batches:
            got = [batch.column(c).to_numpy() for c in ("token", "part", *names)]
            if not len(got[0]):
                continue
            if held is not None:
                got = [np.concatenate([h, x]) for h, x in zip(held, got, strict=True)]
            held = [x[-1:] for x in got]
            (t, p, a, n_a, place_a, c), (t2, p2, b, n_b, place_b, c2) = [x[:-1] for x in got], [x[1:] for x in got]
            n, rest = n_a + n_b, np.minimum(n_a - place_a, n_b - place_b)
            keep = (t == t2) & (p == p2) & (c != c2) & (100 * np.minimum(n_a, n_b) >= PERCENT * np.maximum(n_a, n_b)) & ((100 + PERCENT) * rest >= PERCENT * n)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (a, b, n_a, n_b)], ["a", "b", "n_a", "n_b"])

    rows = table.withColumn("part", dealt(bound, turn))
    rows = rows.repartition("token", "part").sortWithinPartitions("token", "part", F.xxhash64("set_id", "token", F.lit(turn)), "set_id")
    met = _ordered(rows.select("token", "part", *names).mapInArrow(run, "a long, b long, n_a long, n_b long")).distinct()
    order = F.xxhash64("a", "b", F.lit(turn))
    first = lambda c: F.row_number().over(Window.partitionBy(c).orderBy(order, "a", "b"))
    met = met.withColumn("at_a", first("a")).withColumn("at_b", first("b"))
    return met.where((F.col("at_a") <= TRIES) | (F.col("at_b") <= TRIES)).drop("at_a", "at_b")


def crossing(table: DataFrame, bound: float) -> DataFrame:
    """All distinct pairs (a, b, n_a, n_b) of different components that share a token and can link by it. The smaller
    set of a pair meets at the first 1/7 of its shingles; sets meet in bands of sizes whose ends differ by 4 to 3, the
    larger in its own band and the one below; long lists are dealt by the smaller set."""
    band = lambda n: F.floor(F.log(n) / F.log(F.lit(100 / PERCENT))).cast("int")
    table = table.withColumn("band", band(F.col("n"))).withColumn("deals", deals(bound))
    most = ((100 + PERCENT) * (F.col("n") - F.col("place")) - PERCENT * F.col("n")) / PERCENT  # the largest partner at this place
    small = table.where((100 + PERCENT) * (F.col("n") - F.col("place")) >= 2 * PERCENT * F.col("n"))
    small = small.select("token", "band", dealt(bound, 0).alias("part"), F.col("set_id").alias("a"), F.col("n").alias("n_a"), F.col("place").alias("place_a"), "component")
    large = table.withColumn("band", F.explode(F.sequence(F.col("band") - 1, F.least(F.col("band"), band(F.greatest(most, F.lit(1.0)) + 1e-6)))))
    large = large.withColumn("part", F.explode(F.sequence(F.lit(0), (F.col("deals") - 1).cast("int"))))
    large = large.select("token", "band", "part", F.col("set_id").alias("b"), F.col("n").alias("n_b"), F.col("place").alias("place_b"), F.col("component").alias("other"))
    smaller = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("a") < F.col("b")))
    same = [small[c] == large[c] for c in ("token", "band", "part")]
    met = small.join(large, same[0] & same[1] & same[2] & (F.col("component") != F.col("other")) & smaller & _sizes() & _places())
    return _ordered(met).distinct()


def bits_of(ids: np.ndarray) -> np.ndarray:
    """Two bit numbers of each id."""
    h = common.mix64(ids.view(np.uint64))
    return np.stack([h & np.uint64(BITS - 1), h >> np.uint64(32) & np.uint64(BITS - 1)]).astype(np.int64)


def bloom(wanted: DataFrame) -> np.ndarray:
    """A Bloom filter of BITS bits over doc_id: fixed size, whatever the number of ids. It only spares rows."""

    def run(batches):
        bits = np.zeros(BITS, bool)
        for batch in batches:
            bits[bits_of(batch.column("doc_id").to_numpy()).ravel()] = True
        yield pa.RecordBatch.from_arrays([common.binary([np.packbits(bits)])], ["bits"])

    out = np.zeros(BITS // 8, np.uint8)
    for r in wanted.select("doc_id").repartition(8).mapInArrow(run, "bits binary").collect():
        out |= np.frombuffer(r[0], np.uint8)
    return out


def passing(batches, packed: np.ndarray):
    """The rows of batches whose doc_id passes the Bloom filter."""
    bits = np.unpackbits(packed).astype(bool)
    for batch in batches:
        ids = batch.column("doc_id").fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        rows = np.flatnonzero(bits[bits_of(ids)].all(0) & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False))
        if len(rows):
            yield batch.take(pa.array(rows))


def reps(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("rep_a", "rep_b")).alias("doc_id"))


def plausible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b, n_a, n_b, rep_a, rep_b) that their parities do not exclude."""
    packed = bloom(reps(pairs))
    near = classes.select("set_id", F.col("rep").alias("doc_id"), "bits").mapInArrow(lambda batches: passing(batches, packed), "set_id long, doc_id long, bits binary")
    side = lambda c: near.select(F.col("set_id").alias(c), F.col("bits").alias(f"bits_{c}"))
    names = ["a", "b", "n_a", "n_b", "rep_a", "rep_b"]

    def run(batches):
        for batch in batches:
            n = (batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()) * (100 - PERCENT)
            far = np.array([differences(x, y) for x, y in zip(batch.column("bits_a").to_pylist(), batch.column("bits_b").to_pylist(), strict=True)], np.int64)
            yield batch.select(names).take(pa.array(np.flatnonzero((100 + PERCENT) * far <= n)))

    met = pairs.join(side("a"), "a").join(side("b"), "b").select(*names, "bits_a", "bits_b")
    return met.mapInArrow(run, "a long, b long, n_a long, n_b long, rep_a long, rep_b long")


def segments(df: DataFrame, pairs: DataFrame, level: np.ndarray, cuts: np.ndarray) -> DataFrame:
    """Rows (doc_id, set_id, fragment, keys): the sets of the documents in pairs (rep_a, rep_b), cut at the pivots.
    Texts stay where they are read; documents that only pass the Bloom filter by chance meet no pair later."""
    packed = bloom(reps(pairs))

    def run(batches):
        s = Shingler()
        for batch in passing(batches, packed):
            for part in common.slices(batch, "text"):
                d, key = s.distinct(*common.text_buffer(part.column("text")), level)
                n = np.bincount(d, minlength=part.num_rows)
                set_id = ids_of_sets(key, n)
                place = d * (len(cuts) + 1) + np.searchsorted(cuts, key, "right")
                cell, first = np.unique(place, return_index=True)
                values = pa.ListArray.from_arrays(pa.array(np.append(first, len(key)).astype(np.int32)), pa.array(key.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(cell // (len(cuts) + 1))), pa.array(set_id[cell // (len(cuts) + 1)]), pa.array((cell % (len(cuts) + 1)).astype(np.int32)), values], ["doc_id", "set_id", "fragment", "keys"])

    return df.select("doc_id", "text").mapInArrow(run, "doc_id long, set_id long, fragment int, keys array<long>")


def linked(pairs: DataFrame, cut: DataFrame) -> DataFrame:
    """The pairs (a, b, n_a, n_b, rep_a, rep_b) whose overlaps, counted per fragment and summed, reach the threshold.
    Both joins have the same keys, so that the segments are shuffled once."""
    side = lambda c, keys: cut.select(F.col("doc_id").alias(f"rep_{c}"), F.col("set_id").alias(c), "fragment", F.col("keys").alias(keys))
    parts = pairs.withColumn("fragment", F.explode(F.array(*map(F.lit, range(FRAGMENTS)))))
    met = parts.join(side("a", "x"), ["rep_a", "a", "fragment"]).join(side("b", "y"), ["rep_b", "b", "fragment"])
    partial = met.select("a", "b", "n_a", "n_b", F.size(F.array_intersect("x", "y")).alias("both"))
    total = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("both").alias("both"))
    return total.where(100 * F.col("both") >= PERCENT * (F.col("n_a") + F.col("n_b") - F.col("both"))).select("a", "b")


def _sizes():
    return 100 * F.least("n_a", "n_b") >= PERCENT * F.greatest("n_a", "n_b")


def _places():
    """Whether a pair can link by what comes after a shared shingle. Holds for a linked pair at the first
    shingle that it shares, as all it shares stands from there on."""
    rest = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    return (100 + PERCENT) * rest >= PERCENT * (F.col("n_a") + F.col("n_b"))


def _ordered(rows: DataFrame, *more: str) -> DataFrame:
    """Rows (a, b, n_a, n_b, *more) with a < b."""
    swap = F.col("a") > F.col("b")
    return rows.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(swap, F.col("n_b")).otherwise(F.col("n_a")).alias("n_a"), F.when(swap, F.col("n_a")).otherwise(F.col("n_b")).alias("n_b"), *more)


def _led(rows: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of rows (a, b, n_a, n_b, place_a, place_b) that can link."""
    return _ordered(rows.where(_sizes() & _places())).distinct()


def _open(members: DataFrame, merged: DataFrame | None, name: str = "fs-open") -> DataFrame:
    """The rows of lists that hold several components, after the components in `merged` (vertex, component) became one."""
    if merged is not None:
        merged = merged.select(F.col("vertex").alias("component"), F.col("component").alias("into"))
        members = members.join(merged, "component", "left").withColumn("component", F.coalesce("into", "component")).drop("into")
    split = members.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("token")
    return common.materialize(members.join(split, "token", "left_semi").select("token", "set_id", "n", "place", "component"), name)


def _between(links: DataFrame, members: DataFrame) -> DataFrame:
    """Links (a, b) of classes as edges of their components."""
    side = lambda c: members.select(F.col("set_id").alias(c), F.col("component").alias(f"of_{c}")).distinct()
    return links.join(side("a"), "a").join(side("b"), "b").select(F.col("of_a").alias("a"), F.col("of_b").alias("b"))


def join(df: DataFrame) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id)."""
    docs, named = _classes(df)
    out = docs.join(named, "set_id", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _classes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, n_shingles, set_id, text_hash) of df, and (set_id, group, component) of the classes of equal sets; a
    group is what can be reached by links, its component the smallest doc_id there."""
    spark = df.sparkSession
    common.prepare(spark)
    rows = common.materialize(sets(df), "fs-sets")
    level, mass, bound = sketch_levels(rows)
    cuts = pivots(mass)
    docs = common.materialize(rows.where("part is null").select("doc_id", "n_shingles", "set_id", "text_hash"), "fs-docs")
    classes = rows.where("n_shingles > 0 and doc_id is not null").groupBy("set_id").agg(F.min("doc_id").alias("rep"), F.first("bits").alias("bits"))
    classes = common.materialize(classes, "fs-classes")
    common.discard(rows)
    lists = common.materialize(shared(postings(df, level), bound), "fs-lists")
    common.free_shuffles(spark)

    repeats = _repeats(docs)

    rep = lambda c: classes.select(F.col("set_id").alias(c), F.col("rep").alias(f"rep_{c}"))

    def compare(pairs: DataFrame) -> DataFrame:
        known = common.materialize(pairs.join(rep("a"), "a").join(rep("b"), "b"), "fs-known")
        pairs = common.materialize(plausible(known, classes), "fs-pairs")
        common.discard(known)
        common.release(spark)
        if pairs.isEmpty():  # no text has to be read again
            return pairs.select("a", "b")
        cut = segments(df, pairs, level, cuts)
        if repeats:
            cut = cut.dropDuplicates(["doc_id", "set_id", "fragment"])
        cut = common.materialize(cut, "fs-segments")
        common.release(spark)
        found = common.materialize(linked(pairs, cut), "fs-links")
        common.discard(cut, pairs)
        common.release(spark)
        return found

    tried = common.materialize(_led(lists.where("lead <> set_id").select(F.col("lead").alias("a"), F.col("set_id").alias("b"), F.col("n_lead").alias("n_a"), F.col("n").alias("n_b"), F.col("place_lead").alias("place_a"), F.col("place").alias("place_b"))), "fs-tried")
    links = compare(tried)
    common.free_shuffles(spark)
    merged = common.materialize(common.components(links), "fs-groups")
    members = lists.select("token", "set_id", "n", "place")
    held = _open(members.withColumn("component", F.col("set_id")), merged)
    common.discard(lists)
    turn = 0
    while (n_open := held.select("component").distinct().count()) > 1:
        turn += 1
        pairs = common.materialize(neighbours(held, bound, turn).join(tried, ["a", "b"], "left_anti"), "fs-tried")
        if pairs.isEmpty():
            break
        found = compare(pairs)
        merged = common.materialize(common.components(_between(found, held)), "fs-groups")
        tried, links = tried.unionByName(pairs), links.unionByName(found)
        joined = merged.where("vertex <> component").count()
        before, held = held, _open(held, merged)
        common.discard(before)
        common.release(spark)
        if joined <= WORTH * n_open:
            break
    more = common.materialize(crossing(held, bound).join(tried.select("a", "b"), ["a", "b"], "left_anti"), "fs-more")
    if not more.isEmpty():
        links = links.unionByName(compare(more))
    common.discard(held)
    group = common.materialize(common.components(links), "fs-groups").select(F.col("vertex").alias("set_id"), F.col("component").alias("group"))
    named = classes.drop("bits").join(group, "set_id", "left").withColumn("group", F.coalesce("group", "set_id"))
    least = named.groupBy("group").agg(F.min("rep").alias("component"))
    return docs, common.materialize(named.join(least, "group").select("set_id", "group", "component"), "fs-named")


def _repeats(docs: DataFrame) -> bool:
    return bool(docs.groupBy("doc_id").count().where("count > 1").limit(1).count())


def keep_one(df: DataFrame) -> DataFrame:
    """The rows of df that stand for their group: one row of each component, of the document with the smallest id. Of
    rows that share this id the one with the smallest set and text hash stays, and equal rows stay once; other texts
    with a repeated id are judged by themselves. Rows with a null id and rows without words all stay."""
    docs, named = _classes(df)
    named = docs.where("doc_id is not null").join(named, "set_id")
    chosen = named.groupBy("group").agg(F.min(F.struct("doc_id", "set_id", "text_hash")).alias("k")).select(F.col("k.doc_id").alias("__id"), F.col("k.text_hash").alias("__text"), F.lit(True).alias("__chosen"))
    hashed = df.withColumn("__hash", F.xxhash64("text"))
    wordless = ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    out = hashed.join(chosen, (F.col("doc_id") == F.col("__id")) & (F.col("__hash") == F.col("__text")), "left")
    out = out.where(F.col("doc_id").isNull() | wordless | F.col("__chosen"))
    if _repeats(docs):
        alike = Window.partitionBy("doc_id", "__hash").orderBy(F.xxhash64(*df.columns))
        out = out.withColumn("__at", F.row_number().over(alike)).where(F.col("doc_id").isNull() | wordless | (F.col("__at") == 1))
    return out.select(*df.columns)
