"""The pipeline's stages and its whole against plain versions, with nulls, repeats, clashing columns and empty tables."""

import random
from collections import Counter

import plain
import public_tokenizers
import pytest
from test_contracts import rows

import corpus_pipeline
from lexiloom.llm import bpe, credentials, mixing, toxicity

FORM = "doc_id long, text string, lang string, source string, n_chars long, score string, rep int, size string"


def table(spark, docs):
    return spark.createDataFrame([(i, t, "en", f"s{(i or 0) % 3}", len(t or ""), "x", 1, "z") for i, t in docs], FORM).repartition(3)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rnd = random.Random(3)
    docs = [d for d in plain.corpus(3, 90) if d[0] != 5]
    for i in range(200, 420):
        bad = " mubbish zorkle " if i % 4 == 0 else " "
        docs.append((i, plain.prose(rnd, 25) + bad + plain.prose(rnd, 8) + (" token=" + "".join(rnd.choices("0123456789abcdef", k=32)) if i % 5 == 0 else "")))
    docs += [(None, "no id"), (None, None), (5, plain.prose(rnd, 30)), (500, "seen z0rkle and m u b b i s h"), (501, "a " * 30_000)]
    at = str(tmp_path_factory.mktemp("pipeline"))
    table(spark, docs).write.parquet(f"{at}/documents.parquet")
    labels = [(i, 1, int(i % 4 == 0)) for i in range(200, 420)] + [(200, 0, 1), (None, 1, 1), (201, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return at, docs


def test_run_equals_plain_stages(spark, folder):
    at, docs = folder
    labels = spark.read.parquet(f"{at}/labels.parquet")
    toxic = {r.doc_id for r in toxicity.digest(table(spark, docs), labels).collect() if r.score >= toxicity.THRESHOLD and r.doc_id is not None}
    assert 500 in toxic and not {i for i, _ in docs if i is not None and i < 200} & toxic
    left = [(i, t) for i, t in docs if i not in toxic]
    group = plain.components([d for d in left if d[0] is not None])
    left = [(i, t) for i, t in left if i is None or group[i][1] == i]
    spans = {(i, t): credentials.base_spans(t or "")[0] for i, t in left}
    found = rows(credentials.digest(table(spark, [(k, t) for k, (_, t) in enumerate(left)])))
    hidden = []
    for k, (i, t) in enumerate(left):
        marks = sorted(tuple(map(int, x.split(":")[1:])) for x in found[k]["spans"].split(",") if x)
        assert [f"{credentials.KINDS[a]}:{s}:{e}" for a, s, e in spans[i, t]] == [x for x in found[k]["spans"].split(",") if x and not x.startswith("format")]
        out, end = "", 0
        for s, e in marks:
            out += t[end:s] + "[SECRET]" if s >= end else ""
            end = max(end, e)
        hidden.append((i, None if t is None else out + t[end:]))
    words = {(i, t): len(plain.WORD.findall(t or "")) for i, t in hidden}
    copies = Counter()
    for r in mixing.mix(table(spark, hidden)).collect():
        copies[r.doc_id, r.text] += 1
    assert all(words[x] for x in copies) and set(copies) <= set(words)
    want = sorted((i is None, i or 0, tuple(bpe.encode_text(t, bpe.ranks_path(), public_tokenizers.PATTERN))) for (i, t), n in copies.items() for _ in range(n))
    got = corpus_pipeline.run(spark, at)
    assert got.columns == ["doc_id", "n_tokens", "ids"]
    assert sorted((r.doc_id is None, r.doc_id or 0, tuple(r.ids)) for r in got.collect()) == want


def test_stages_keep_columns_and_take_empty_tables(spark, folder):
    at, _ = folder
    empty = table(spark, [])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, empty, at)
        assert out.columns == empty.columns and out.count() == 0
    assert corpus_pipeline.encode(spark, empty, at).count() == 0
