"""DuckDB SQL for the catalog's queries, written apart from the Spark code."""

from __future__ import annotations

import string

from quernel.functions.analysis import STOP_WORDS
from quernel.plans.catalog import BATCH, EDIT_PAIRS, QUERY_STRINGS

STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


def lower(x: str) -> str:
    return f"translate({x}, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"


def raw(x: str) -> str:
    return f"regexp_extract_all({x}, '[A-Za-z0-9'']+')"


def kept(x: str) -> str:
    return f"list_filter({raw(x)}, lambda w: w NOT IN ({STOPS}))"


def strings(*words: str) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


#: content and source as one text, as the index has it
A = f"""a AS (SELECT doc_id, title, t, lt, {kept("lt")} AS tokens FROM (
  SELECT doc_id, source AS title, text || ' ' || source AS t, {lower("text || ' ' || source")} AS lt FROM documents))"""
#: one row per token
P = "p AS (SELECT doc_id, unnest(tokens) AS term, generate_subscripts(tokens, 1) - 1 AS pos FROM a)"
V = "v AS (SELECT DISTINCT unnest(tokens) AS term FROM a)"
THING = "l AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS position, count(*) OVER () AS n FROM a WHERE list_contains(tokens, 'thing'))"

SQL: dict[str, str] = {}


def _tokens(expression: str) -> str:
    return f"SELECT doc_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS term FROM (SELECT doc_id, {expression} AS w FROM documents)"


SQL["ascii_lower"] = f"SELECT doc_id, {lower('text')} AS lower FROM documents"
SQL["tokenize"] = _tokens(kept(lower("text")))
SQL["token_positions"] = f"SELECT term, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos, sum(pos)::BIGINT AS sum_pos FROM ({SQL['tokenize']}) GROUP BY term"
SQL["tokenize_keep_stopwords"] = _tokens(raw(lower("text")))
SQL["tokenize_case_sensitive"] = _tokens(kept("text"))
SQL["stopword_filter"] = f"SELECT term, count(*) AS dropped FROM (SELECT unnest({raw(lower('text'))}) AS term FROM documents) WHERE term IN ({STOPS}) GROUP BY term"
SQL["stem_simple"] = f"""
SELECT term, CASE WHEN length(term) < 4 THEN term
  WHEN ends_with(term, 'tional') AND length(term) > 6 THEN left(term, length(term) - 2)
  WHEN ends_with(term, 'ional') AND length(term) > 5 THEN left(term, length(term) - 2)
  WHEN ends_with(term, 'ing') THEN left(term, length(term) - 3)
  WHEN ends_with(term, 'ed') OR ends_with(term, 'ly') THEN left(term, length(term) - 2)
  WHEN ends_with(term, 's') AND NOT ends_with(term, 'ss') THEN left(term, length(term) - 1) ELSE term END AS stem
FROM (SELECT DISTINCT term FROM ({SQL["tokenize"]}))"""
SQL["token_offsets"] = f"""
WITH r AS (SELECT doc_id, unnest(x) AS run, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[A-Za-z0-9'']+|[^A-Za-z0-9'']+') AS x FROM documents)),
o AS (SELECT doc_id, i, {lower("run")} AS term, sum(length(run)) OVER (PARTITION BY doc_id ORDER BY i)::BIGINT AS e, length(run) AS n FROM r),
k AS (SELECT * FROM o WHERE regexp_matches(term, '^[a-z0-9'']') AND term NOT IN ({STOPS}))
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos, term, e - n AS start, e AS "end" FROM k"""
SQL["all_text"] = "SELECT doc_id, text || ' ' || source AS all_text FROM documents"
SQL["field_projection"] = "SELECT doc_id, source AS title, '' AS author FROM documents"
SQL["loader_term_count"] = r"SELECT doc_id, CASE WHEN text = '' THEN 0 ELSE length(text) - length(regexp_replace(text, '[ \t\n\x0B\f\r]', '', 'g')) + 1 END AS term_count FROM documents"
SQL["build_postings"] = f"WITH {A}, {P} SELECT term, doc_id, count(*) AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM p GROUP BY term, doc_id"
SQL["vocabulary"] = f"WITH {A}, {V} SELECT term FROM v"
SQL["document_frequency"] = f"WITH {A}, {P} SELECT term, count(DISTINCT doc_id) AS df FROM p GROUP BY term"
SQL["index_stats"] = f"WITH {A}, {V} SELECT count(*) AS n, round(avg(len(tokens)), 6) AS avgdl, (SELECT count(*) FROM v) AS n_terms FROM a"
SQL["get_postings"] = f"WITH {A}, {P} SELECT term, doc_id, count(*) AS tf, string_agg(pos::VARCHAR, ',' ORDER BY pos) AS positions FROM p WHERE term = 'thing' GROUP BY term, doc_id"
SQL["skip_pointers"] = f"WITH {A}, {THING} SELECT 'thing' AS term, position, doc_id FROM l WHERE position % greatest(1, floor(sqrt(n))::BIGINT) = 0"
SQL["find_skip_target"] = f"SELECT term, coalesce(max(CASE WHEN doc_id < 500 THEN position END), 0) AS position FROM ({SQL['skip_pointers']}) GROUP BY term"
SQL["posting_list_skips"] = f"""WITH {A}, {P}, {THING}, f AS (SELECT doc_id, count(*) AS tf FROM p WHERE term = 'thing' GROUP BY doc_id)
SELECT f.doc_id, tf, CASE WHEN position % greatest(1, floor(sqrt(n))::BIGINT) = 0 THEN position END AS skip_position FROM f JOIN l ON f.doc_id = l.doc_id"""
SQL["skip_stats"] = f"""WITH x AS (SELECT term, df AS c, greatest(1, floor(sqrt(df))::BIGINT) AS s FROM ({SQL["document_frequency"]}))
SELECT term, c AS postings_count, (c - 1) // s + 1 AS skip_count, CASE WHEN c > s THEN s ELSE 0 END AS interval FROM x"""
SQL["posting_intersection"] = f"WITH {A}, {P} SELECT doc_id FROM p WHERE term = 'thing' INTERSECT SELECT doc_id FROM p WHERE term = 'attion'"
SQL["delete_document"] = f"WITH {A}, {P} SELECT term, count(DISTINCT doc_id) AS df FROM p WHERE doc_id % 10 <> 0 GROUP BY term"
SQL["update_document"] = f"""WITH {A}, {P}, n AS (SELECT doc_id, term FROM p UNION SELECT doc_id, 'zzupdated' FROM a WHERE doc_id % 7 = 0)
SELECT term, count(*) AS df FROM n GROUP BY term"""
SQL["index_upsert"] = f"""WITH {A}, n AS (SELECT CASE WHEN doc_id % 2 = 0 THEN doc_id ELSE doc_id + 1000000000 END AS doc_id, len(tokens) + 1 AS term_count FROM a WHERE doc_id % 5 = 0)
SELECT doc_id, len(tokens) AS term_count FROM a WHERE doc_id NOT IN (SELECT doc_id FROM n) UNION ALL SELECT doc_id, term_count FROM n"""
SQL["snapshot_roundtrip"] = f"WITH {A}, {P} SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf, sum(pos)::BIGINT AS sum_pos FROM p GROUP BY term"
SQL["candidates_any"] = f"WITH {A} SELECT doc_id FROM a WHERE list_has_any(tokens, ['thing', 'nicht'])"
SQL["query_stats"] = f"""WITH {A}, q AS (SELECT unnest(['thing', 'nicht']) AS term)
SELECT (SELECT count(*) FROM a) AS n, (SELECT round(avg(len(tokens)), 6) FROM a) AS avgdl, term, (SELECT count(*) FROM a WHERE list_contains(a.tokens, q.term)) AS df FROM q"""
TF = "(length(lt) - length(replace(lt, '{0}', ''))) / length('{0}')::DOUBLE"
SQL["term_frequency"] = f"WITH {A} SELECT doc_id, {TF.format('thing')} AS tf_thing, {TF.format('nicht')} AS tf_nicht FROM a WHERE list_has_any(tokens, ['thing', 'nicht'])"


def q(*words: str) -> str:
    return "q AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{w}')" for i, w in enumerate(words)) + ") AS x(ord, term))"


QUERY = q("thing", "nicht")
#: a row for each candidate and query term: x(doc_id, title, dl, n, avgdl, ord, term, df, tf)
X = """s AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM a),
e AS (SELECT ord, term, (SELECT count(*) FROM a WHERE list_contains(a.tokens, q.term)) AS df FROM q),
c AS (SELECT * FROM a WHERE list_has_any(tokens, (SELECT list(term) FROM q))),
x AS (SELECT c.doc_id, c.title, c.lt, len(c.tokens) AS dl, n, avgdl, ord, term, df, (length(c.lt) - length(replace(c.lt, term, ''))) / length(term)::DOUBLE AS tf FROM c, e, s)"""


def bm25(k1: float = 1.5, b: float = 0.75) -> str:
    return f"sum(CASE WHEN tf > 0 THEN ln((n - df + 0.5) / (df + 0.5) + 1) * tf * ({k1} + 1) / (tf + {k1} * (1 - {b} + {b} * dl / avgdl)) ELSE 0 END)"


TFIDF = "sum(CASE WHEN tf > 0 THEN ln(1 + tf) * ln(n / df::DOUBLE) ELSE 0 END)"


def ranked(score: str, query: str = QUERY, extra: str = "", tail: str = "ORDER BY score DESC, doc_id LIMIT 10", factor: str = "1") -> str:
    return f"""WITH {A}, {query}, {X}, r AS (SELECT doc_id, any_value(title) AS title, any_value(dl / avgdl) AS ratio, {score} AS score{extra} FROM x GROUP BY doc_id),
h AS (SELECT doc_id, round(score * {factor}, 6) AS score FROM r WHERE score > 0)
SELECT doc_id, score FROM h {tail}"""


SQL["search_bm25"] = ranked(bm25())
SQL["search_bm25_params"] = ranked(bm25(1.2, 0.5))
SQL["search_bm25_duplicates"] = ranked(bm25(), q("thing", "thing", "nicht"))
SQL["search_bm25_stopword_boost"] = ranked(bm25(), q("the", "thing"))
SQL["search_tfidf"] = ranked(TFIDF)
FEATURES = f"""{bm25()} AS bm25, {TFIDF} AS tf_idf, count(*) FILTER (tf > 0) / count(*)::DOUBLE AS coverage, any_value(dl / avgdl) AS length_ratio,
  count(*) FILTER (contains({lower("title")}, term))::DOUBLE AS title_matches"""
ML = f"WITH {A}, {q('thing', 'src1')}, {X}, f AS (SELECT doc_id, {FEATURES} FROM x GROUP BY doc_id)"
SQL["ml_features"] = f"{ML} SELECT doc_id, round(bm25, 6) AS bm25, round(tf_idf, 6) AS tf_idf, round(coverage, 6) AS coverage, round(length_ratio, 6) AS length_ratio, title_matches FROM f"
SQL["search_ml"] = f"""{ML} SELECT doc_id, round(.4 * bm25 + .2 * tf_idf + .2 * coverage + .05 * length_ratio + .15 * title_matches, 6) AS score FROM f ORDER BY score DESC, doc_id LIMIT 10"""
SQL["search_full_sort"] = ranked(bm25(), tail="")
SQL["top_k"] = f"WITH {A} SELECT doc_id, len(tokens)::DOUBLE AS score FROM a ORDER BY score DESC, doc_id LIMIT 25"
SQL["search_custom_ranker"] = ranked(f"{bm25()} + CASE WHEN any_value(title) = 'src1' THEN 2 ELSE 0 END")
SQL["explain_scores"] = f"SELECT *, 'Ranker: BM25, Score: ' || printf('%.6f', score) || ', Method: Top-K Heap (O(N log K))' AS explanation FROM ({SQL['search_bm25']})"
SQL["paginate_offset"] = f"SELECT doc_id, score, (SELECT count(*) FROM ({SQL['search_full_sort']})) AS total_hits FROM ({SQL['search_full_sort']}) ORDER BY score DESC, doc_id LIMIT 10 OFFSET 10"
SQL["paginate_cursor"] = f"SELECT doc_id, score FROM ({SQL['search_full_sort']}) ORDER BY score DESC, doc_id LIMIT 10 OFFSET 10"
SQL["browse_documents"] = "SELECT doc_id, source FROM documents ORDER BY doc_id LIMIT 10 OFFSET 20"
_batch = ", ".join(f"({i}, {j}, '{t}')" for i, text in enumerate(BATCH) for j, t in enumerate(text.split()))
SQL["search_batch"] = f"""WITH {A}, q AS (SELECT * FROM (VALUES {_batch}) AS x(qid, ord, term)), s AS (SELECT count(*) AS n, avg(len(tokens)) AS avgdl FROM a),
e AS (SELECT qid, ord, term, (SELECT count(*) FROM a WHERE list_contains(a.tokens, q.term)) AS df FROM q),
g AS (SELECT qid, list(term) AS terms FROM q GROUP BY qid),
x AS (SELECT g.qid, a.doc_id, len(tokens) AS dl, n, avgdl, df, (length(lt) - length(replace(lt, term, ''))) / length(term)::DOUBLE AS tf
  FROM a JOIN g ON list_has_any(a.tokens, g.terms) JOIN e ON e.qid = g.qid, s),
r AS (SELECT qid, doc_id, {bm25()} AS score FROM x GROUP BY qid, doc_id),
k AS (SELECT qid, doc_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM r WHERE score > 0)
SELECT qid, doc_id, round(score, 6) AS score, rank FROM k WHERE rank <= 3"""
_strings = ", ".join("('q{}', '{}')".format(i, s.replace("'", "''")) for i, s in enumerate(QUERY_STRINGS))
_asking = f"(SELECT conv_id || '/' || turn AS qid, text AS s FROM conversations UNION ALL SELECT * FROM (VALUES {_strings}) AS x(qid, s))"
#: for strings without quotes, as they are here
SQL["extract_terms"] = rf"""SELECT qid, array_to_string(list_filter(regexp_extract_all({lower("s")}, '[^\s!-/:-@\[-`{{-~]+'), lambda w: w NOT IN ('and', 'or', 'not')), ' ') AS terms
FROM {_asking}"""
SQL["normalize_query"] = rf"SELECT qid, trim(regexp_replace({lower('s')}, '\s+', ' ', 'g')) AS normalized FROM {_asking}"
GRAMS = "list_transform(range(1, length(term) + 2), lambda i: substring('^' || term || '$', i, 2))"
SQL["ngrams"] = f"WITH {A}, {V} SELECT term, generate_subscripts(g, 1) - 1 AS pos, unnest(g) AS ngram FROM (SELECT term, {GRAMS} AS g FROM v)"
SQL["ngram_index"] = f"WITH {A}, {V} SELECT ngram, count(*) AS terms FROM (SELECT DISTINCT term, unnest({GRAMS}) AS ngram FROM v) GROUP BY ngram"
SQL["auto_edit_distance"] = f"WITH {A}, {V} SELECT term, CASE WHEN length(term) <= 2 THEN 0 WHEN length(term) <= 4 THEN 1 ELSE 2 END AS distance FROM v"


def osa(a: str, b: str) -> str:
    """Rows of the table folded over a's characters; a pair of rows (before last, last) is an INT[][] like every element."""
    cell = f"""list_reduce(list_concat([[i]], list_transform(range(1, length({b}) + 1), lambda j: [j])), lambda r, y: list_append(r, least(
      r[y[1]] + 1, t[2][y[1] + 1] + 1, t[2][y[1]] + CASE WHEN substring({a}, i, 1) = substring({b}, y[1], 1) THEN 0 ELSE 1 END,
      CASE WHEN i > 1 AND y[1] > 1 AND substring({a}, i, 1) = substring({b}, y[1] - 1, 1) AND substring({a}, i - 1, 1) = substring({b}, y[1], 1)
        THEN t[1][y[1] - 1] + 1 ELSE 1000000 END)))"""
    cell = cell.replace("[[i]]", "[[x[1][1]]]").replace("(i > 1", "(x[1][1] > 1").replace(" i > 1", " x[1][1] > 1")
    cell = cell.replace(f"substring({a}, i, 1)", f"substring({a}, x[1][1], 1)").replace(f"substring({a}, i - 1, 1)", f"substring({a}, x[1][1] - 1, 1)")
    first = f"[range(0, length({b}) + 1), range(0, length({b}) + 1)]"
    rows = f"list_transform(range(1, length({a}) + 1), lambda k: [[k]])"
    return f"list_reduce(list_concat([{first}], {rows}), lambda t, x: [t[2], {cell}])[2][length({b}) + 1]"


_pairs = ", ".join(f"('{a}', '{b}')" for a, b in EDIT_PAIRS)
SQL["osa_distance"] = f"WITH {A}, {V}, x AS (SELECT * FROM (VALUES {_pairs}) AS y(a, b) UNION ALL SELECT 'thinq', term FROM v) SELECT a, b, {osa('a', 'b')} AS distance FROM x"
NEAR = f"""w AS (SELECT unnest(list_transform(range(1, 7), lambda i: substring('^thinq$', i, 2))) AS ngram),
g AS (SELECT DISTINCT term, unnest({GRAMS}) AS ngram FROM v),
n AS (SELECT term FROM g JOIN w ON g.ngram = w.ngram WHERE abs(length(term) - 5) <= 2 GROUP BY term),
m AS (SELECT term, {osa("'thinq'", "term")} AS distance FROM n)"""
SQL["fuzzy_matches"] = f"WITH {A}, {V}, {NEAR} SELECT term, distance FROM m WHERE distance <= 2 ORDER BY distance, term LIMIT 10"
SQL["prefix_expand"] = f"WITH {A}, {V} SELECT term FROM v WHERE starts_with(term, 'thanedb') ORDER BY length(term), term LIMIT 1"
_asked = f"""{V}, {NEAR}, q AS (SELECT 0 AS ord, coalesce((SELECT term FROM v WHERE starts_with(term, 'thinq') ORDER BY length(term), term LIMIT 1),
  (SELECT term FROM m WHERE distance <= 2 ORDER BY distance, term LIMIT 1), 'thinq') AS term UNION ALL SELECT 1, 'nicht')"""
SQL["search_fuzzy"] = ranked(bm25(), _asked, factor="0.9")
MARKED = r"""array_to_string(list_transform(regexp_extract_all({t}, '[A-Za-z0-9'']+|[^A-Za-z0-9'']+'),
  lambda w: CASE WHEN {w} IN ('thing', 'nicht') THEN '<mark>' || w || '</mark>' ELSE w END), '')""".format(t="text", w=lower("w"))
SQL["highlight"] = f"SELECT doc_id, {MARKED} AS marked FROM documents"
SQL["bool_and"] = f"WITH {A} SELECT doc_id FROM a WHERE list_contains(tokens, 'thing') AND list_contains(tokens, 'attion')"
SQL["bool_or"] = f"WITH {A} SELECT doc_id FROM a WHERE list_contains(tokens, 'thing') OR list_contains(tokens, 'nicht')"
SQL["bool_not"] = f"WITH {A} SELECT doc_id FROM a WHERE list_contains(tokens, 'thing') AND NOT list_contains(tokens, 'attion')"
SQL["phrase_match"] = f"WITH {A}, {P} SELECT DISTINCT x.doc_id FROM p x JOIN p y ON x.doc_id = y.doc_id AND y.pos = x.pos + 1 WHERE x.term = 'attion' AND y.term = 'thanedble'"
SQL["proximity_match"] = f"WITH {A}, {P} SELECT DISTINCT x.doc_id FROM p x JOIN p y ON x.doc_id = y.doc_id AND y.pos > x.pos AND y.pos - x.pos <= 6 WHERE x.term = 'thing' AND y.term = 'attion'"
SQL["field_match"] = "SELECT doc_id FROM documents WHERE source = 'src1'"
SQL["load_jsonl"] = r"SELECT source AS title, regexp_replace(text, '[\r\n]+', ' ', 'g') AS content FROM documents"
SQL["load_csv"] = SQL["load_jsonl"]
