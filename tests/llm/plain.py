"""Plain versions of the contracts, for small inputs."""

import hashlib
import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def near(a, b):
    return abs(a - b) <= 1e-6 * max(1, abs(a))


def roots(n, links):
    parent = list(range(n))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in links:
        a, b = root(i), root(j)
        parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(n)]


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def components(docs):
    """doc_id -> (n_shingles, component_id) of (doc_id, text) with distinct ids."""
    docs = sorted(docs)
    sets = [shingles(t) for _, t in docs]
    links = []
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                links.append((j, i))
    r = roots(len(docs), links)
    return {d: (len(sets[i]), docs[r[i]][0]) for i, (d, _) in enumerate(docs)}


def removed(docs, window=50):
    """doc_id -> (n_bytes, n_removed, n_spans, kept_sha256)."""
    first, out = {}, {}
    docs = sorted(docs)
    for d, t in docs:
        b = (t or "").encode()
        for i in range(len(b) - window + 1):
            first.setdefault(b[i : i + window], d)
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - window + 1):
            if first[b[i : i + window]] < d:
                gone[i : i + window] = b"\1" * window
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest())
    return out


def prose(rnd, n):
    parts = "the on er ing tion ab cle dor fen gal hir jus kel lom nor pas qui ros sed tum ur vel wex yon zan".split()
    return " ".join("".join(rnd.choice(parts) for _ in range(rnd.randint(1, 3))) for _ in range(n))


def corpus(seed=1, n=120):
    """Texts with exact and near copies, shared passages and odd cases; (doc_id, text)."""
    rnd = random.Random(seed)
    passage = prose(rnd, 60)
    texts = [None, "", " \t\n", "one", "a b c d", "A B C D", "a b c d e", "x" * 49, "x" * 50, "x" * 400, "é" * 60, "ab" * 200, "日本語 テキスト " * 30]
    base = [prose(rnd, rnd.randint(30, 200)) for _ in range(12)]
    while len(texts) < n:
        k = rnd.random()
        b = rnd.choice(base)
        if k < 0.2:
            texts.append(b)
        elif k < 0.6:
            w = b.split(" ")
            for _ in range(rnd.randint(1, 4)):
                w[rnd.randrange(len(w))] = prose(rnd, 1)
            texts.append(" ".join(w))
        elif k < 0.75:
            texts.append(prose(rnd, rnd.randint(5, 50)) + "\n" + passage + "\n" + prose(rnd, rnd.randint(0, 30)))
        else:
            texts.append(prose(rnd, rnd.randint(1, 300)))
    ids = list(range(n))
    rnd.shuffle(ids)
    return list(zip(ids, texts, strict=True))
