"""The registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import scalars as S
from lexiloom.operators import render
from lexiloom.operators.range_max import range_max
from lexiloom.operators.suggest import fuzzy_suggest, naive_suggest, prefix_index, prefix_range, suggest, suggest_batch
from lexiloom.plans import corpora as C
from lexiloom.sources import corpus as K

UPLOW = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'"
C1 = f"c1 AS (SELECT min(p_partkey) AS row_id, count(*) AS weight, translate(p_name,{UPLOW}) AS phrase, '' AS snippet FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 3)"
C2 = f"c2 AS (SELECT 0::BIGINT AS row_id, count(*) AS weight, phrase, '' AS snippet FROM (SELECT unnest(regexp_split_to_array(translate(text,{UPLOW}), '[^a-z]+')) AS phrase FROM documents) WHERE phrase <> '' GROUP BY phrase)"
C3 = f"c3 AS (SELECT p_partkey AS row_id, p_size::BIGINT AS weight, translate(p_name,{UPLOW}) AS phrase, p_type AS snippet FROM part)"
TOP = "row_number() OVER (ORDER BY weight DESC, phrase, row_id)"
LINE = r"^[ \t\n\x0B\f\r]*(?:([0-9]+)(?:[^0-9\t][^\t]*)?|[^0-9 \t\n\x0B\f\r][^\t]*)\t[ \t\n\x0B\f\r]*([^ \t\n\x0B\f\r][^\t]*)(?:\t([\s\S]*))?\z"
LINES = """lines AS (SELECT p_partkey - 1 AS line_no, CASE p_partkey % 8
  WHEN 0 THEN p_partkey || chr(9) || p_name WHEN 1 THEN '-' || p_partkey || chr(9) || ' ' || p_name || ' ' || chr(9) || p_type || chr(9) || p_brand
  WHEN 2 THEN chr(9) || p_name WHEN 3 THEN '  ' || p_partkey || '.5 x' || chr(9) || chr(9) || upper(p_name) WHEN 4 THEN p_partkey::VARCHAR
  WHEN 5 THEN chr(9) || p_partkey || chr(9) || p_name || chr(9) WHEN 6 THEN 'w' || p_partkey || chr(9) || p_name || chr(13)
  ELSE '99999999999' || chr(9) || p_name END AS value FROM part)"""
PARSED = f"""parsed AS (SELECT line_no, value, coalesce(TRY_CAST(nullif(regexp_extract(value, '{LINE}', 1), '') AS BIGINT), 0) AS weight,
  translate(regexp_extract(value, '{LINE}', 2),{UPLOW}) AS phrase, regexp_extract(value, '{LINE}', 3) AS snippet FROM lines)"""
REQUESTS = f"requests AS (SELECT p_partkey AS qid, substr(p_name, 1, (p_partkey % 14)::INT) AS q, (p_partkey % 40 - 2)::INT AS n FROM part)"
ESC = lambda c: f"""replace(replace(replace(replace({c}, '\\', '\\\\'), '"', '\\"'), chr(10), '\\n'), chr(9), '\\t')"""


def q_suggest(corpus, prefix, n):
    return lambda spark, d: suggest(corpus(spark, d), prefix, n)


def sql_suggest(cte, name, prefix, n):
    return f"WITH {cte} SELECT {TOP}::INT AS rank, phrase, weight AS score, snippet FROM {name} WHERE starts_with(phrase, '{prefix}') ORDER BY rank LIMIT {n}"


def requests(spark, d):
    p = C.table(spark, d, "part")
    return p.select(F.col("p_partkey").alias("qid"), F.expr("substring(p_name, 1, cast(p_partkey % 14 as int))").alias("q"), (F.col("p_partkey") % 40 - 2).cast("int").alias("n"))


def batch(spark, d):
    corpus = C.parts(spark, d)
    return suggest_batch(prefix_index(corpus), corpus, requests(spark, d))


def prefixes(spark, d):
    return C.tokens(spark, d).select(F.explode(F.sequence(F.lit(0), F.lit(4))).alias("k"), "phrase").select(F.expr("substring(phrase, 1, k)").alias("q")).distinct()


def rendered(kind, callback=None):
    def run(spark, d):
        found = batch(spark, d).join(requests(spark, d).select("qid", S.ascii_lower(F.col("q")).alias("q")), "qid")
        out = (render.list_json if kind == "list" else render.rich_json)(found, ["q", "qid"])
        return out.select("qid", (render.jsonp(F.col("json"), callback) if callback else F.col("json")).alias("json"))

    return run


def word_distances(spark, d):
    """All adjoining words of each whole text: their number, and the sum and the largest of their distances."""
    docs = C.table(spark, d, "documents").select("doc_id", F.split("text", r"[ \n]+").alias("w"))
    pair = F.arrays_zip(F.slice("w", F.lit(1), F.size("w") - 1).alias("a"), F.slice("w", F.lit(2), F.size("w") - 1).alias("b"))
    each = docs.where(F.size("w") > 1).select("doc_id", F.explode(pair).alias("p"))
    distance = S.edit_distance(F.col("p.a"), F.col("p.b")).cast("long")
    return each.groupBy("doc_id").agg(F.count("*").alias("n_pairs"), F.sum(distance).alias("total"), F.max(distance).alias("largest"))


def urls(spark, d):
    """A request line for every part, escaped in part, with odd names and values among them."""
    p = C.table(spark, d, "part")
    q = F.concat(F.lit("x=1&q="), F.replace(F.col("p_name"), F.lit(" "), F.lit("%20")), F.when(F.col("p_partkey") % 3 == 0, F.lit("=%41%zz")).when(F.col("p_partkey") % 3 == 1, F.lit("%C3%A9%4")).otherwise(F.lit("")), F.lit("&n="), (F.col("p_partkey") % 50 - 9).cast("string"), F.when(F.col("p_partkey") % 5 == 0, F.lit("&q")).otherwise(F.lit("&&z=2")))
    return p.select(F.col("p_partkey").alias("qid"), q.alias("query"))


def parsed(spark, d):
    rows = urls(spark, d).select("qid", S.query_parameter(F.col("query"), "q").alias("q"), S.query_parameter(F.col("query"), "n").alias("n"), S.query_parameter(F.col("query"), "y").alias("y"))
    return rows.select("qid", S.percent_decode_column(F.col("q")).alias("q"), S.clamp_n_text(F.col("n")).alias("n"), F.col("y").isNull().alias("no_y"))


def numbers(spark, d):
    return C.table(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") * F.col("o_orderkey") * 7 % 9000000).alias("s"))


def queries() -> dict:
    lines = C.lines
    return {
        "suggest_prefix": q_suggest(C.popularity, "s", 10),
        "suggest_empty_prefix": q_suggest(C.tokens, "", 32),
        "suggest_duplicates": q_suggest(C.parts, "re", 32),
        "suggest_uppercase_query": q_suggest(C.popularity, "SMALL", 16),
        "suggest_no_match": lambda s, d: suggest(C.popularity(s, d), "zzz", 10).agg(F.count("*").alias("n")),
        "suggest_long_prefix": q_suggest(C.popularity, "small bol", 16),
        "suggest_naive": lambda s, d: naive_suggest(C.parts(s, d), "sm", 32),
        "suggest_fuzzy": lambda s, d: fuzzy_suggest(C.tokens(s, d), "the", 2, 20),
        "request_parse": parsed,
        "suggest_n_clamped": lambda s, d: requests(s, d).select("qid", S.clamp_n_column(F.col("n")).alias("n")),
        "suggest_batch": batch,
        "prefix_index_top32": lambda s, d: prefix_index(C.parts(s, d)),
        "prefix_index_tokens": lambda s, d: prefix_index(C.tokens(s, d), 3),
        "prefix_range": lambda s, d: prefix_range(C.tokens(s, d), prefixes(s, d)),
        "range_max_batch": lambda s, d: range_max(C.order_vector(s, d), C.ranges(s, d), block=64),
        "range_max_leftmost": lambda s, d: range_max(C.order_vector(s, d), C.ranges(s, d), leftmost=True),
        "import_parse": lambda s, d: K.parse(lines(s, d)),
        "import_limit": lambda s, d: K.parse(lines(s, d), 150),
        "import_quarantine": lambda s, d: K.quarantined(lines(s, d)),
        "import_counts": lambda s, d: K.counts(lines(s, d)),
        "import_is_sorted": lambda s, d: K.is_sorted(lines(s, d)),
        "corpus_index": lambda s, d: K.with_index(C.parts(s, d)),
        "corpus_stats": lambda s, d: C.tokens(s, d).agg(F.count("*").alias("n_entries")),
        "export_tsv": lambda s, d: K.export_lines(C.parts(s, d)),
        "render_rich_json": rendered("rich"),
        "render_list_json": rendered("list"),
        "render_jsonp": rendered("list", "callback"),
        "escape_special": lambda s, d: C.table(s, d, "documents").select("doc_id", S.escape_json(F.col("text")).alias("escaped")),
        "ascii_lower": lambda s, d: C.table(s, d, "documents").select("doc_id", S.ascii_lower(F.col("text")).alias("lower")),
        "soundex_ref": lambda s, d: C.tokens(s, d).select("phrase", S.soundex(F.col("phrase")).alias("code")),
        "edit_distance_bytes": word_distances,
        "humanized_diff": lambda s, d: numbers(s, d).select("o_orderkey", S.time_difference(F.col("s"), F.lit(1000000)).alias("text")),
        "zero_pad": lambda s, d: numbers(s, d).select("o_orderkey", S.zero_pad(F.col("s"), 5).alias("padded"), S.plural(F.lit("row"), F.col("s") % 3).alias("word")),
        "floor_log2": lambda s, d: numbers(s, d).select("o_orderkey", S.floor_log2(F.col("s")).cast("long").alias("log2")),
    }


def oracle_sql() -> dict[str, str]:
    index = lambda name, length: f"SELECT prefix, row_number() OVER (PARTITION BY prefix ORDER BY weight DESC, phrase, row_id)::INT AS rank, row_id, weight, phrase, snippet FROM (SELECT *, unnest(list_transform(range(0, least(length(phrase), {length}) + 1), lambda k: substr(phrase, 1, k::INT))) AS prefix FROM {name}) QUALIFY rank <= 32"
    n = "CASE WHEN n IS NULL OR n > 32 OR n < 0 THEN 32 WHEN n < 1 THEN 1 ELSE n END"
    found = f"found AS (SELECT qid, translate(q,{UPLOW}) AS q, row_number() OVER (PARTITION BY qid ORDER BY weight DESC, phrase, row_id)::INT AS rank, phrase, weight AS score, snippet, {n} AS n FROM requests JOIN c3 ON starts_with(phrase, translate(q,{UPLOW})) QUALIFY rank <= {n})"
    vector = "v AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS idx, floor(o_totalprice)::BIGINT AS weight FROM orders), r AS (SELECT c_custkey AS qid, (c_custkey * 7919) % n AS l, (c_custkey * 7919) % n + (c_custkey * 104729) % n - 10 AS u FROM customer, (SELECT count(*) AS n FROM orders))"
    best = lambda i: f"WITH {vector}, ok AS (SELECT * FROM r WHERE l >= 0 AND l <= u AND u < (SELECT count(*) FROM v)), b AS (SELECT qid, max(weight) AS value, arg_max(idx, (weight, {i})) AS index FROM ok JOIN v ON idx BETWEEN l AND u GROUP BY qid) SELECT qid, value, index FROM r LEFT JOIN b USING (qid)"
    odd = "(phrase <> '' AND (weight > 2147483647 OR strlen(value) >= 8191))"
    rich = f"""' {{ "phrase": "' || {ESC("phrase")} || '", "score": ' || score || CASE WHEN snippet <> '' THEN ', "snippet": "' || {ESC("snippet")} || '"' ELSE '' END || ' }}'"""
    listed = f"""'[ "' || {ESC("q")} || '", [' || string_agg('"' || {ESC("phrase")} || '"', ',' || chr(10) ORDER BY rank) || chr(10) || '] ]'"""
    d = "regexp_replace(translate(translate(phrase,'123456','000000'),'BFPVCGJKQSXZDTLMNRbfpvcgjkqsxzdtlmnr','111122222222334556111122222222334556'),'[^1-6]','0','g')"
    z = "replace(regexp_replace(d[2:], '^[' || d[1] || '0]{0,2}', ''), '0', '')"
    for k in "123456":
        z = f"regexp_replace({z}, '{k}+', '{k}', 'g')"
    num = "(SELECT o_orderkey, o_orderkey * o_orderkey * 7 % 9000000 AS s FROM orders)"
    part = lambda x, w: f"CASE WHEN {x} > 1 THEN {x} || ' {w}s ' ELSE {x} || ' {w} ' END"
    return {
        "suggest_prefix": sql_suggest(C1, "c1", "s", 10),
        "suggest_empty_prefix": sql_suggest(C2, "c2", "", 32),
        "suggest_duplicates": sql_suggest(C3, "c3", "re", 32),
        "suggest_uppercase_query": sql_suggest(C1, "c1", "small", 16),
        "suggest_no_match": f"WITH {C1} SELECT count(*) AS n FROM c1 WHERE starts_with(phrase, 'zzz')",
        "suggest_n_clamped": f"WITH {REQUESTS} SELECT qid, ({n})::INT AS n FROM requests",
        "suggest_batch": f"WITH {C3}, {REQUESTS}, {found} SELECT qid, rank, phrase, score, snippet FROM found",
        "prefix_index_top32": f"WITH {C3} {index('c3', 6)}",
        "prefix_index_tokens": f"WITH {C2} {index('c2', 3)}",
        "prefix_range": f"WITH {C2}, q AS (SELECT DISTINCT substr(phrase, 1, k::INT) AS q FROM c2, range(0, 5) t(k)), less AS (SELECT phrase, (row_number() OVER (ORDER BY phrase)) - 1 AS i FROM c2), first AS (SELECT q, (SELECT count(*) FROM c2) AS n, min(i) AS first, max(i) + 1 AS last FROM q JOIN less ON starts_with(phrase, q) GROUP BY q) SELECT q, first, last FROM first",
        "range_max_batch": best("idx"),
        "range_max_leftmost": best("-idx"),
        "import_parse": f"WITH {LINES}, {PARSED} SELECT line_no AS row_id, weight, phrase, snippet FROM parsed WHERE phrase <> '' AND NOT {odd}",
        "import_limit": f"WITH {LINES}, {PARSED} SELECT line_no AS row_id, weight, phrase, snippet FROM parsed WHERE phrase <> '' AND NOT {odd} AND line_no < 150",
        "import_quarantine": f"WITH {LINES}, {PARSED} SELECT line_no, value FROM parsed WHERE {odd}",
        "import_counts": f"WITH {LINES}, {PARSED} SELECT count(*) AS n_lines, count(*) FILTER (phrase <> '' AND NOT {odd}) AS n_added FROM parsed",
        "import_is_sorted": f"WITH {LINES}, {PARSED} SELECT bool_and(ok) AS is_sorted FROM (SELECT coalesce(lag(phrase) OVER (ORDER BY line_no) <= phrase, true) AS ok FROM parsed)",
        "corpus_index": f"WITH {C3} SELECT row_number() OVER (ORDER BY phrase, row_id) - 1 AS idx, row_id, weight, phrase, snippet FROM c3",
        "corpus_stats": f"WITH {C2} SELECT count(*) AS n_entries FROM c2",
        "export_tsv": f"WITH {C3} SELECT row_id, phrase, weight || chr(9) || phrase || chr(9) || snippet AS line FROM c3",
        "render_rich_json": f"WITH {C3}, {REQUESTS}, {found} SELECT qid, '[' || string_agg({rich}, ',' || chr(10) ORDER BY rank) || chr(10) || ']' AS json FROM found GROUP BY qid",
        "render_list_json": f"WITH {C3}, {REQUESTS}, {found} SELECT qid, {listed} AS json FROM found GROUP BY qid, q",
        "render_jsonp": f"WITH {C3}, {REQUESTS}, {found} SELECT qid, 'callback(' || {listed} || ');' || chr(10) AS json FROM found GROUP BY qid, q",
        "escape_special": f"SELECT doc_id, {ESC('text')} AS escaped FROM documents",
        "ascii_lower": f"SELECT doc_id, translate(text,{UPLOW}) AS lower FROM documents",
        "soundex_ref": f"WITH {C2}, coded AS (SELECT phrase, {d} AS d FROM c2) SELECT phrase, rpad(phrase[1] || {z}, 4, '0') AS code FROM coded",
        "edit_distance_bytes": "SELECT doc_id, count(*) AS n_pairs, sum(x)::BIGINT AS total, max(x) AS largest FROM (SELECT doc_id, levenshtein(w[i], w[i + 1]) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM (SELECT doc_id, regexp_split_to_array(text, '[ \\n]+') AS w FROM documents))) GROUP BY doc_id",
        "suggest_long_prefix": sql_suggest(C1, "c1", "small bol", 16),
        "suggest_naive": sql_suggest(C3, "c3", "sm", 32),
        "suggest_fuzzy": f"WITH {C2}, coded AS (SELECT *, {d} AS d FROM c2), near AS (SELECT phrase, weight AS score, snippet, levenshtein(phrase, 'the') AS distance, row_id FROM coded WHERE rpad(phrase[1] || {z}, 4, '0') = 't000') SELECT phrase, score, snippet, distance::INT AS distance FROM near WHERE distance <= 2 ORDER BY distance, score DESC, phrase, row_id LIMIT 20",
        "request_parse": "SELECT p_partkey AS qid, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE p_name || CASE p_partkey % 3 WHEN 0 THEN 'A' || chr(0) WHEN 1 THEN 'é' ELSE '' END END AS q, (CASE WHEN p_partkey % 50 - 9 < 0 OR p_partkey % 50 - 9 > 32 THEN 32 WHEN p_partkey % 50 - 9 = 0 THEN 1 ELSE p_partkey % 50 - 9 END)::INT AS n, true AS no_y FROM part",
        "humanized_diff": f"""WITH n AS (SELECT o_orderkey, abs(s - 1000000)::BIGINT AS x FROM {num}), t AS (SELECT o_orderkey, x, x // 86400 AS dd, x // 604800 AS ww, x // 2419200 AS mm,
            lpad((x % 86400 // 3600)::VARCHAR, 2, '0') || ':' || lpad((x % 3600 // 60)::VARCHAR, 2, '0') || ':' || lpad((x % 60)::VARCHAR, 2, '0') AS clock FROM n)
            SELECT o_orderkey, CASE WHEN x = 0 THEN 'just now' ELSE CASE WHEN mm > 0 THEN {part('mm', 'month')} ELSE '' END || CASE WHEN ww > 0 THEN {part('(ww % 4)', 'day')} ELSE '' END
            || CASE WHEN dd > 0 THEN {part('(dd % 7)', 'day')} ELSE '' END || clock END AS text FROM t""",
        "zero_pad": f"SELECT o_orderkey, CASE WHEN length(s::VARCHAR) >= 5 THEN s::VARCHAR ELSE lpad(s::VARCHAR, 5, '0') END AS padded, CASE WHEN s % 3 > 1 THEN 'rows' ELSE 'row' END AS word FROM {num}",
        "floor_log2": f"SELECT o_orderkey, length(bin(greatest(s, 1))) - 1 AS log2 FROM {num}",
    }
