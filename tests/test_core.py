"""Fixed vectors and small comparisons of the core."""

import random

import pytest
from pyspark.sql import functions as F

from lexiloom.functions import scalars as S
from lexiloom.operators import render
from lexiloom.operators.range_max import range_max
from lexiloom.operators.suggest import fuzzy_suggest, naive_suggest, prefix_index, prefix_range, suggest, suggest_batch
from lexiloom.service import SuggestService, difference_text
from lexiloom.sources import corpus as K

PHRASES = [(14, "amber lantern by the quay"), (6, "birchwood"), (21, "maple street - evening edition"), (3, "marble"), (12, "marbled"), (2, "marblehead"), (2, "marblehouse"), (13, "marl"), (4, "mrble"), (5, "umbra")]
#: Names and their phonetic keys.
SOUNDS = [
    ("Example", "E251"), ("Euler", "E460"), ("Gauss", "G200"), ("Hilbert", "H416"), ("Knuth", "K530"), ("Lloyd", "L300"), ("Lukasiewicz", "L200"),
    ("Ellery", "E460"), ("Ghosh", "G200"), ("Heilbronn", "H416"), ("Kant", "K530"), ("Ladd", "L300"), ("Lissajous", "L200"), ("Wheaton", "W350"),
    ("Burroughs", "B620"), ("Burrows", "B620"), ("O'Hara", "O600"), ("Washington", "W252"), ("Lee", "L000"), ("Gutierrez", "G362"), ("Pfister", "P236"),
    ("Jackson", "J250"), ("Tymczak", "T520"), ("Ashcraft", "A261"), ("A", "A000"), ("2cCVFll", "2140"),
]
EDITS = [("marble", "marbled", 1), ("marbled", "marble", 1), ("marl", "mrble", 3), ("umbra", "amber", 3), ("birch", "perch", 2), ("lantern", "lens", 5), ("", "abc", 3), ("é", "e", 2), ("日本", "日", 3), ("same", "same", 0)]
LINES = [("5\tfoo", (5, "foo", "")), ("-5\tfoo", (0, "foo", "")), ("12.5\tfoo", (12, "foo", "")), ("abc\tfoo", (0, "foo", "")), ("\t5\tfoo", (5, "foo", "")), ("\tfoo", None), ("123", None), ("5\t\t Foo Bar \tsnip\tmore", (5, "foo bar ", "snip\tmore")), ("5 x\tbar\t  sp", (5, "bar", "  sp")), ("5\tfoo\t", (5, "foo", "")), ("   7\tq\r", (7, "q\r", "")), ("", None)]


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(i, w, p, "") for i, (w, p) in enumerate(PHRASES)], K.SCHEMA)


def test_sounds_and_edits(spark):
    got = spark.createDataFrame([*SOUNDS, ("", "")], "s string, want string").select(S.soundex(F.col("s")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]
    got = spark.createDataFrame(EDITS, "a string, b string, d int").select(S.edit_distance(F.col("a"), F.col("b")).alias("got"), "d").collect()
    assert [r.got for r in got] == [r.d for r in got]


def test_lines(spark, tmp_path):
    path = tmp_path / "in.tsv"
    path.write_bytes("".join(x + "\n" for x, _ in LINES).encode())
    lines = K.read_lines(spark, str(path))
    assert [(r.line_no, r.value) for r in lines.orderBy("line_no").collect()] == [(i, x) for i, (x, _) in enumerate(LINES)]
    got = {r.row_id: (r.weight, r.phrase, r.snippet) for r in K.parse(lines).collect()}
    assert got == {i: w for i, (_, w) in enumerate(LINES) if w}
    assert K.parse(lines, 3).count() == 3 and K.parse(lines, 0).count() == 0
    assert tuple(K.counts(lines).first()) == (len(LINES), sum(w is not None for _, w in LINES))
    odd = spark.createDataFrame([(0, "3000000000\tx"), (1, "1\t" + "y" * 8190), (2, "99999999999999999999999\tz")], "line_no long, value string")
    assert K.parse(odd).count() == 0 and K.quarantined(odd).count() == 3
    assert not K.is_sorted(lines).first()[0]
    assert K.is_sorted(spark.createDataFrame([(i, f"1\t{c}") for i, c in enumerate("aabc")], "line_no long, value string")).first()[0]


def test_many_splits(spark, tmp_path):
    path = tmp_path / "big.tsv"
    path.write_text("".join(f"{i}\tphrase {i}\n" for i in range(20000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        assert K.parse(K.read_lines(spark, str(path))).where("row_id <> weight").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_lines_of_a_folder(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"part-{k}").write_text("".join(f"{k}\tphrase {k} {i}\n" for i in range(100)))
    lines = K.read_lines(spark, str(tmp_path))
    got = lines.orderBy("line_no").collect()
    assert [r.line_no for r in got] == list(range(300)) and got[150].value == "1\tphrase 1 50"
    assert K.parse(lines, 150).count() == 150


def test_plans(spark, tmp_path):
    """What the plans must look like: filters and columns reach the scan, and nothing is compared row by row with all."""
    K.write(spark.createDataFrame([(i, w, p, "s") for i, (w, p) in enumerate(PHRASES)], K.SCHEMA), str(tmp_path / "c"))
    corpus = spark.read.parquet(str(tmp_path / "c"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    top = plan(suggest(corpus, "mar", 3))
    assert "StringStartsWith(phrase,mar)" in top and "TakeOrderedAndProject" in top
    assert "snippet" not in plan(corpus.where(F.col("phrase").startswith("m")).select("phrase", "weight")).split("ReadSchema")[1]
    asked = spark.createDataFrame([("a",), ("m",)], "q string")
    ranges = plan(prefix_range(corpus, asked))
    assert ranges.count("NestedLoop") <= 1 and "lengths" in ranges and "Cartesian" not in ranges  # one row of lengths
    few = spark.createDataFrame([(1, 0, 2)], "qid long, l long, u long")
    assert "Cartesian" not in plan(range_max(corpus.select(F.col("row_id").alias("idx"), "weight"), few))


def test_suggest(spark, corpus):
    best = lambda p, n=16: [(r.phrase, r.score) for r in suggest(corpus, p, n).orderBy("rank").collect()]
    naive = lambda p, n=16: [(x, w) for w, x in sorted(((w, x) for w, x in PHRASES if x.startswith(p.lower())), key=lambda t: (-t[0], t[1]))[:n]]
    for p in ("m", "marble", "a", "b", "c", "zz", "MARBLE", "marblehouse and more"):
        assert best(p) == naive(p) == [(r.phrase, r.score) for r in naive_suggest(corpus, p).orderBy("rank").collect()]
    assert best("", 3) == naive("", 3)
    asked = ("a", "b", "c", "m", "marble", "zz", "")
    got = {r.q: (r.first, r["last"]) for r in prefix_range(corpus, spark.createDataFrame([(p,) for p in asked], "q string")).collect()}
    assert got == {p: (sum(x < p for _, x in PHRASES), sum(x < p or x.startswith(p) for _, x in PHRASES)) for p in asked}
    asked = spark.createDataFrame([(1, "MARBLE", 2), (2, "marbleh", 3), (3, "", None), (4, "no", 5), (5, "marbleh", 1)], "qid int, q string, n int")
    got = {}
    for r in suggest_batch(prefix_index(corpus, 4), corpus, asked, 4).orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.phrase, r.score))
    assert got == {1: naive("marble", 2), 2: naive("marbleh", 3), 3: naive("", 32), 5: naive("marbleh", 1)}
    assert [r.phrase for r in fuzzy_suggest(corpus, "MRBLE", 1).collect()] == ["mrble", "marble"]


@pytest.mark.parametrize("leftmost", [False, True])
def test_range_max(spark, leftmost):
    rnd = random.Random(2)
    w = [7, 30, 30, 1, 12, 30, 0, 0, 28, 3, 19, 30, 2, 2] + [rnd.randint(0, 30) for _ in range(200)]
    asked = [(i, rnd.randint(-2, 215), rnd.randint(-2, 215)) for i in range(600)] + [(1000 + i * 20 + j, i, j) for i in range(14) for j in range(i, 14)]
    got = {r.qid: (r.value, r["index"]) for r in range_max(spark.createDataFrame(list(enumerate(w)), "idx long, weight long"), spark.createDataFrame(asked, "qid long, l long, u long"), leftmost, block=4).collect()}
    for q, a, b in asked:
        want = max(((w[i], i) for i in range(a, b + 1)), key=lambda t: (t[0], -t[1] if leftmost else t[1])) if 0 <= a <= b < len(w) else (None, None)
        assert got[q] == want


def test_requests():
    assert [S.clamp_n(x) for x in (None, "0", "abc", "-5", "33", "7", " 5x")] == [32, 1, 1, 32, 32, 7, 5]
    assert [S.percent_decode(x) for x in ("a%20b", "a+b", "a%4", "%zz", "%4G")] == ["a b", "a+b", "a", "\0", "@"]
    assert [S.parse_query(x) for x in ("q=a=b", "q=1&q=2", "q", "")] == [{"q": "ab"}, {"q": "2"}, {"q": ""}, {}]
    assert [difference_text(0, x) for x in (0, 3661, 86400, 604800, 2419200)] == ["just now", "01:01:01", "1 day 00:00:00", "1 day 0 day 00:00:00", "1 month 0 day 0 day 00:00:00"]


def test_rendering(spark):
    rows = [{"phrase": 'a"\\\t\n\r', "score": 3, "snippet": "s\t"}, {"phrase": "b", "score": 1, "snippet": ""}]
    want = '[ { "phrase": "a\\"\\\\\\t\\n\r", "score": 3, "snippet": "s\\t" },\n { "phrase": "b", "score": 1 }\n]'
    df = spark.createDataFrame([("Q", i + 1, r["phrase"], r["score"], r["snippet"]) for i, r in enumerate(rows)], "q string, rank int, phrase string, score long, snippet string")
    assert render.rich_json(df, ["q"]).first().json == want and render.render_rows("q", rows, None, None) == want + "\n"
    assert render.list_json(df.where("rank = 2"), ["q"]).first().json == '[ "Q", ["b"\n] ]' == render.render_rows("Q", rows[1:], "list", None)[:-1]
    assert render.render_rows("x", [], "list", "cb") == 'cb([ "x", [] ]);\n' and render.render_rows("x", [], None, "no way()") == "[]\n"


def test_service(spark, tmp_path):
    service = SuggestService(spark, str(tmp_path / "store"))
    path = tmp_path / "in.tsv"
    path.write_text("".join(f"{w}\t{p}\t{'note' if w > 9 else ''}\n" for w, p in PHRASES))
    assert service.handle("/face/import/?file=/no/such").status == 404
    assert service.handle(f"/face/import/?file={path}").body.startswith("Successfully added 10/10records from")
    assert service.handle("/face/suggest/?q=MARBLE&n=1&type=list").body == '[ "marble", ["marbled"\n] ]\n'
    assert service.handle("/face/suggest/?q=maple%20&callback=f").body == 'f([ { "phrase": "maple street - evening edition", "score": 21, "snippet": "note" }\n]);\n'
    out = tmp_path / "out.tsv"
    out.write_text("to be replaced")
    for _ in range(2):  # one file, twice
        assert "wrote 10 records" in service.handle(f"/face/export/?file={out}").body
        assert [x.split("\t")[1] for x in out.read_text().splitlines()] == [p for _, p in PHRASES]
    folder = tmp_path / "folder"
    for _ in range(2):  # a folder, which is imported again
        assert service.handle(f"/face/export/?file={folder}/").status == 200
    assert service.handle(f"/face/import/?file={folder}").body.startswith("Successfully added 10/10records")
    again = SuggestService(spark, str(tmp_path / "other"))
    assert again.handle(f"/face/export/?file={tmp_path}/none.tsv").status == 200 and (tmp_path / "none.tsv").read_text() == ""
    precious = tmp_path / "precious"
    precious.mkdir()
    (precious / "kept").write_text("x")
    assert service.handle(f"/face/export/?file={precious}/").status == 500 == service.handle(f"/face/export/?file={precious}").status
    assert (precious / "kept").read_text() == "x"
    assert service.handle(f"/face/import/?file={out}&limit=4").body.startswith("Successfully added 4/4records")
    for limit, n in (("7x", 7), ("x", 10), ("-3", 10), ("²", 10), (" +2", 2)):
        assert service.handle(f"/face/import/?file={out}&limit={limit}").body.startswith(f"Successfully added {n}/{n}records")
    assert "Data store size: 2 entries" in service.handle("/face/stats/").body and service.handle("/x").status == 404
    service.building = True
    assert service.handle("/face/suggest/?q=a").status == 412 == service.handle("/face/export/?file=x").status


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_prefix_range_of_many_lengths(spark):
    phrase = "".join(chr(97 + i % 26) for i in range(1300))
    corpus = spark.createDataFrame([(phrase,), ("b",)], "phrase string")
    asked = spark.createDataFrame([(phrase[:k],) for k in range(1, 1301)], "q string")
    got = {r.q: (r.first, r["last"]) for r in prefix_range(corpus, asked).collect()}
    assert got == {phrase[:k]: (0, 1) for k in range(1, 1301)}
