"""Reference lookup, positional patterns, relevance and facets over whole tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from plansift import vocab as V
from plansift.functions import refs as R, text as T
from plansift.operators import facets, fts, parts as P
from plansift.plans.registered import sqlparts as S
from plansift.plans.registered.inputs import (PART_QUESTIONS, QUESTIONS, asked_about_parts, question_table,
                                              question_values)
from plansift.plans.registered.search import _SEARCH, _bm25, ranked
from plansift.sources import standin

VOCAB = standin.VOCABULARY
QUERIES, ORACLE = {}, {}
#: positional patterns asked of the whole reference tables (qid, mode, value, kind)
PATTERNS = ((1, "suffix", "31", None), (2, "prefix", "14", "profile"), (3, "contains", "0T", None),
            (4, "prefix", "59", None), (5, "suffix", "7", "accessory"))
TYPED = ((1, "143"), (2, "19"), (3, "1 50"), (4, "ring"), (5, "57-9"))


def registered(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn
    return add


def _tables(spark, sf_dir):
    return standin.parts(spark, sf_dir), standin.ref_images(spark, sf_dir)


_LOOKUP = f"WITH {S.PARTS}, {S.PHOTOS}, {S.FIRST_PHOTO}"


@registered(f"{_LOOKUP} SELECT part_id, ref, kind, photo FROM parts_v LEFT JOIN first_photo USING (ref_norm)")
def photo_left_lookup(spark, sf_dir):
    parts, photos = _tables(spark, sf_dir)
    return P.with_photo(parts, photos).select("part_id", "ref", "kind", "photo")


@registered(f"""{_LOOKUP}, listed AS (SELECT ref_norm, arg_min((ref, kind, designation, supplier_ref), part_id) AS r FROM parts_v GROUP BY 1),
wanted AS (SELECT DISTINCT o_custkey::VARCHAR AS ref_norm FROM orders),
pictured AS (SELECT ref_norm, arg_min(ref, image_id) AS ref FROM photos_v GROUP BY 1)
SELECT w.ref_norm, coalesce(r[1], p.ref) AS ref, coalesce(r[2], 'part') AS kind, coalesce(r[3], '') AS designation,
 coalesce(r[4], '') AS supplier_ref, photo FROM wanted w LEFT JOIN listed USING (ref_norm) LEFT JOIN pictured p USING (ref_norm)
 LEFT JOIN first_photo USING (ref_norm) WHERE r IS NOT NULL OR p.ref IS NOT NULL""")
def part_lookup_fallback(spark, sf_dir):
    parts, photos = _tables(spark, sf_dir)
    wanted = standin.table(spark, sf_dir, "orders").select(
        R.norm_ref(F.col("o_custkey").cast("string")).alias("ref_norm"))
    return P.lookup_parts(wanted, parts, photos).select("ref_norm", "ref", "kind", "designation", "supplier_ref", "photo")


@registered(f"""WITH {S.PARTS}, {S.PHOTOS} SELECT ref_norm, arg_min(ref, image_id) AS ref, arg_min(filename, image_id) AS filename
 FROM photos_v ANTI JOIN parts_v USING (ref_norm) GROUP BY 1""")
def photo_only_refs(spark, sf_dir):
    return P.photo_only(*_tables(spark, sf_dir)).select("ref_norm", "ref", "filename")


@registered(f"WITH {S.PARTS}, {S.PHOTOS} SELECT ref_norm FROM parts_v UNION SELECT ref_norm FROM photos_v")
def known_refs(spark, sf_dir):
    return P.known_refs(*_tables(spark, sf_dir))


_MERGED = """keyed AS (SELECT ref_norm, part_id, trim(designation) AS name, regexp_replace(lower(designation), '[^a-z0-9]', '', 'g') AS k FROM parts_v),
firsts AS (SELECT ref_norm, k, min(part_id) AS first_id, arg_min(name, part_id) AS name FROM keyed WHERE k <> '' GROUP BY 1, 2),
merged AS (SELECT ref_norm, array_to_string(list_slice(list(name ORDER BY first_id), 1, 2), ' · ') AS designation FROM firsts GROUP BY 1)"""


@registered(f"WITH {S.PARTS}, {_MERGED} SELECT ref_norm, designation FROM merged")
def merged_designation(spark, sf_dir):
    return P.merged_designation(standin.parts(spark, sf_dir))


# ------------------------------------------------------------- position patterns
def _pattern_table(spark, rows=PATTERNS):
    import pyarrow as pa
    qid, mode, value, kind = zip(*rows)
    return spark.createDataFrame(pa.table({"qid": pa.array(qid, pa.int32()), "mode": mode, "value": value,
                                           "kind": pa.array(kind, pa.string())}))


_PATTERN_VALUES = "pats(qid, mode, value, asked_kind) AS (VALUES " + ", ".join(
    f"({a}::BIGINT, '{b}', '{c}', {S.q(d) if d else 'NULL'})" for a, b, c, d in PATTERNS) + ")"
_FITS = ("((mode = 'suffix' AND suffix(ref_norm, value)) OR (mode = 'prefix' AND starts_with(ref_norm, value)) "
         "OR (mode = 'contains' AND contains(ref_norm, value)))")
_MATCHING = f"""{_LOOKUP}, {_PATTERN_VALUES}, {_MERGED},
listed AS (SELECT qid, ref_norm, arg_min((ref, kind, supplier_ref, part_id), part_id) AS r FROM parts_v JOIN pats ON {_FITS} WHERE asked_kind IS NULL OR kind = asked_kind GROUP BY 1, 2),
bare AS (SELECT qid, ref_norm, arg_min(ref, image_id) AS ref FROM (SELECT * FROM photos_v ANTI JOIN parts_v USING (ref_norm)) JOIN pats ON asked_kind IS NULL AND {_FITS} GROUP BY 1, 2),
every AS (SELECT qid, ref_norm, r[1] AS ref, r[2] AS kind, r[3] AS supplier_ref, r[4] AS hit, 0 AS stage FROM listed UNION ALL SELECT qid, ref_norm, ref, 'photo only', '', NULL, 1 FROM bare),
totals AS (SELECT qid, count(*) AS total FROM every GROUP BY 1),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY stage, length(ref_norm), ref_norm) AS rank FROM every) WHERE rank <= 30),
names AS (SELECT qid, ref_norm, regexp_replace(lower(designation), '[^a-z0-9]', '', 'g') AS nk, min((part_id <> hit, part_id)) AS place, arg_min(trim(designation), (part_id <> hit, part_id)) AS name
 FROM top JOIN parts_v USING (ref_norm) GROUP BY 1, 2, 3),
named AS (SELECT qid, ref_norm, array_to_string(list_slice(list(name ORDER BY place), 1, 2), ' · ') AS designation FROM names WHERE nk <> '' GROUP BY 1, 2)"""


@registered(f"""{_MATCHING} SELECT qid, rank, ref, ref_norm, kind, coalesce(designation, '') AS designation, supplier_ref, photo
 FROM top LEFT JOIN named USING (qid, ref_norm) LEFT JOIN first_photo USING (ref_norm)""")
def ref_position_search(spark, sf_dir):
    shown, _ = P.refs_matching(_pattern_table(spark), *_tables(spark, sf_dir))
    return shown


@registered(f"""{_MATCHING}, shown AS (SELECT qid, count(*) AS shown FROM top GROUP BY 1)
SELECT qid, coalesce(total, 0) AS total, CASE WHEN coalesce(total, 0) = 0 THEN 'No ' || coalesce(asked_kind, 'reference') || ' in the profiles & accessories workbook '
 || (CASE mode WHEN 'suffix' THEN 'ends with' WHEN 'prefix' THEN 'starts with' ELSE 'contains' END) || ' `' || value || '`.'
 WHEN total = 1 THEN 'One ' || coalesce(asked_kind, 'reference') || ' ' || (CASE mode WHEN 'suffix' THEN 'ends with' WHEN 'prefix' THEN 'starts with' ELSE 'contains' END) || ' `' || value || '`:'
 ELSE '**' || total || '** ' || (CASE coalesce(asked_kind, 'reference') WHEN 'accessory' THEN 'accessories' WHEN 'profile' THEN 'profiles' ELSE 'references' END) || ' '
 || (CASE mode WHEN 'suffix' THEN 'end with' WHEN 'prefix' THEN 'start with' ELSE 'contain' END) || ' `' || value || '`'
 || (CASE WHEN shown < total THEN ' — showing the first ' || shown || ':' ELSE ':' END) END AS sentence
FROM pats LEFT JOIN totals USING (qid) LEFT JOIN shown USING (qid)""")
def ref_position_total(spark, sf_dir):
    patterns = _pattern_table(spark)
    shown, totals = P.refs_matching(patterns, *_tables(spark, sf_dir))
    n = shown.groupBy("qid").agg(F.count(F.lit(1)).alias("shown"))
    rows = patterns.join(totals, "qid").join(n, "qid", "left")
    kinds = F.array_compact(F.array("kind"))
    return rows.select("qid", "total", R.describe_pattern(
        F.col("mode"), F.col("value"), kinds, F.col("total"), F.coalesce("shown", F.lit(0))).alias("sentence"))


_TYPED_VALUES = "typed(qid, t) AS (VALUES " + ", ".join(f"({a}::BIGINT, '{b}')" for a, b in TYPED) + ")"
_NEAREST = f"""keys AS (SELECT qid, {S.norm_ref('t')} AS k FROM typed),
usable AS (SELECT * FROM keys WHERE length(k) >= 3 AND regexp_matches(k, '[0-9]')),
l AS (SELECT * FROM (SELECT qid, ref_norm, ref, kind, designation, supplier_ref, row_number() OVER (PARTITION BY qid ORDER BY length(ref_norm), ref_norm, part_id) AS pos
 FROM parts_v JOIN usable ON starts_with(ref_norm, k)) WHERE pos <= 24),
ph AS (SELECT * FROM (SELECT qid, ref_norm, ref, row_number() OVER (PARTITION BY qid ORDER BY length(ref_norm), ref_norm) AS pos
 FROM (SELECT ref_norm, arg_min(ref, image_id) AS ref FROM photos_v GROUP BY 1) JOIN usable ON starts_with(ref_norm, k)) WHERE pos <= 24),
both_v AS (SELECT qid, 0 AS stage, pos, ref, ref_norm, kind, designation, supplier_ref FROM l UNION ALL
 SELECT qid, 1, pos, ref, ref_norm, 'part', '', '' FROM ph ANTI JOIN l USING (qid, ref_norm)),
near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY stage, pos) AS rank FROM both_v) WHERE rank <= NEAR_LIMIT)"""
_NEAR = f"{_LOOKUP}, {_TYPED_VALUES}, {_NEAREST.replace('NEAR_LIMIT', '8')}"


@registered(f"{_NEAR} SELECT qid, rank, ref, ref_norm, kind, designation, supplier_ref, photo FROM near LEFT JOIN first_photo USING (ref_norm)")
def ref_near_misses(spark, sf_dir):
    typed = question_table(spark, dict(TYPED)).select("qid", R.norm_ref(F.col("question")).alias("key"))
    return P.near_misses(typed, *_tables(spark, sf_dir))


def _last(pattern):
    x = f"regexp_extract_all(question, {S.q('(?i)' + pattern)}, 1)[-1]"
    n = S.norm_ref(x)
    return (f"CASE WHEN length({n}) BETWEEN 1 AND {R.MAX_FRAGMENT} AND NOT list_contains({S.strings(V.PATTERN_STOP_WORDS)}, lower({n}))"
            f" AND (regexp_matches({n}, '[0-9]') OR length({n}) <= 3) THEN {n} END")


def _first_of(patterns):
    return "coalesce(" + ", ".join(_last(p) for p in patterns) + ", NULL)"


_FRAGMENTS = (f"list_distinct(list_filter(list_transform(regexp_extract_all(question, {S.q(R.FRAGMENT)}), lambda f: {S.norm_ref('f')}), "
              f"lambda k: length(k) >= 3 AND regexp_matches(k, '[0-9]') AND NOT list_contains({S.strings(VOCAB.system_codes)}, k)"
              f" AND NOT list_contains({S.strings(V.PATTERN_STOP_WORDS)}, lower(k))))")
_KINDS = "array_to_string(list_filter([" + ", ".join(
    f"CASE WHEN {S.overlaps('w', words)} THEN {S.q(kind)} END" for kind, words in V.PATTERN_KIND_WORDS.items()) + "], lambda k: k IS NOT NULL), ',')"
_PATTERN = f"""toks AS (SELECT qid, question, {S.tokens('question')} AS w, {_FRAGMENTS} AS frags,
 {_first_of(R.PATTERN_GRAMMAR['suffix'])} AS s, {_first_of(R.PATTERN_GRAMMAR['prefix'])} AS p, {_first_of(R.PATTERN_GRAMMAR['contains'])} AS c FROM asked_v),
parsed AS (SELECT qid, CASE WHEN s IS NOT NULL THEN 'suffix' WHEN p IS NOT NULL THEN 'prefix' ELSE 'contains' END AS mode,
 coalesce(s, p, c, frags[1]) AS value, {_KINDS} AS kinds, coalesce(s, p, c) IS NULL AS implicit FROM toks
 WHERE coalesce(s, p, c) IS NOT NULL OR ({S.overlaps('w', V.REFERENCE_NOUNS)} AND len(frags) = 1))"""


@registered(f"WITH {S.ASKED}, {_PATTERN}, {S.PARTS}, {S.PHOTOS}, known AS (SELECT ref_norm FROM parts_v UNION SELECT ref_norm FROM photos_v) "
            "SELECT qid, mode, value, kinds FROM parsed WHERE NOT implicit OR value NOT IN (SELECT ref_norm FROM known)")
def ref_pattern_grammar(spark, sf_dir):
    parsed = P.read_patterns(asked_about_parts(spark, sf_dir), *_tables(spark, sf_dir), VOCAB)
    return parsed.select("qid", "mode", "value", F.array_join("kinds", ",").alias("kinds"))


_WORDS = f"""up AS (SELECT qid, upper(question) AS u FROM asked_v),
single AS (SELECT qid, unnest(list_filter(list_transform(regexp_extract_all(u, {S.q(R.QUESTION_REFERENCE)}), lambda t: trim(t, '.-/ ')),
 lambda t: length(t) >= 2 AND regexp_matches(t, '[0-9]'))) AS t FROM up),
ws AS (SELECT qid, list_transform(regexp_extract_all(u, '\\S+'), lambda w: trim(w, '.,!?;:')) AS w FROM up),
pairs AS (SELECT qid, a, b FROM (SELECT qid, unnest(w[:-2]) AS a, unnest(w[2:]) AS b FROM ws)),
glued AS (SELECT qid, a || b AS t FROM pairs WHERE (regexp_matches(a, '^[0-9]+$') AND regexp_matches(b, '^\\p{{L}}{{1,3}}$'))
 OR (regexp_matches(a, '^\\p{{L}}{{2,4}}$') AND regexp_matches(b, '^[0-9].{{0,3}}$'))),
cands AS (SELECT DISTINCT qid, t, {S.norm_ref('t')} AS ref_norm FROM (SELECT * FROM single UNION ALL SELECT * FROM glued))"""


@registered(f"""WITH {S.ASKED}, {_WORDS}, {S.PARTS}, {S.PHOTOS}, known AS (SELECT ref_norm FROM parts_v UNION SELECT ref_norm FROM photos_v)
SELECT qid, arg_min(ref_norm, (-length(t), t)) AS ref_norm, arg_min(t, (-length(t), t)) AS typed FROM cands SEMI JOIN known USING (ref_norm) GROUP BY qid""")
def find_ref_in_question(spark, sf_dir):
    return P.refs_in_question(asked_about_parts(spark, sf_dir), *_tables(spark, sf_dir))


# --------------------------------------------------------------- subject search
_SUBJECT = f"""subject AS (SELECT qid, question, list_filter({S.content('question')}, lambda w: NOT {S.is_system_word('w')}) AS base FROM asked),
subject_ok AS (SELECT * FROM subject WHERE len(base) > 0), {S.expand_steps('subject_ok', 'qid, question')}, understood AS (SELECT * FROM subject_ok_expanded),
words AS (SELECT qid, unnest(base) AS phrase, 1 AS n_all, 0 AS n_any FROM understood UNION ALL SELECT qid, unnest(expanded), 0, 1 FROM understood),
phrases AS (SELECT qid, phrase, sum(n_all) AS n_all, max(n_any) AS n_any FROM words GROUP BY 1, 2),
single AS (SELECT qid, unnest(base) AS word, generate_subscripts(base, 1) AS i FROM understood), one AS (SELECT qid, i, word, [word] AS base FROM single),
{S.expand_steps('one', 'qid, i, word')}"""
_PART_FTS = _bm25([("ref", 2.0), ("designation", 1.0)], "parts_p")
_RELEVANT = f"""parts_p AS (SELECT part_id AS page_id, * FROM parts_v), {_SUBJECT}, {_PART_FTS},
st AS (SELECT qid, page_id AS part_id, all_score AS bm, (all_score, page_id) AS pos FROM scored WHERE all_score IS NOT NULL),
wi AS (SELECT qid, page_id AS part_id, any_score AS bm, (any_score, page_id) AS pos FROM scored),
hits AS (SELECT * FROM st UNION ALL SELECT * FROM wi ANTI JOIN st USING (qid)),
marks AS (SELECT h.qid, h.part_id, h.bm, h.pos, i, word, len(list_filter(expanded, lambda f: contains(lower(designation || ' ' || kind), f))) > 0 AS hit
 FROM hits h JOIN parts_v USING (part_id) JOIN one_expanded o ON o.qid = h.qid),
rel AS (SELECT qid, part_id, any_value(bm) AS bm, any_value(pos) AS pos, count(*) FILTER (WHERE hit) AS m, count(*) FILTER (WHERE hit AND NOT list_contains({S.strings(VOCAB.broad_words)}, word)) AS sp, count(*) AS n FROM marks GROUP BY 1, 2),
relevant AS (SELECT *, m::DOUBLE / n + 0.5e0 * sp AS relevance FROM rel WHERE sp > 0)"""
_RELEVANCE = f"WITH {S.PARTS}, {question_values(PART_QUESTIONS)}, {_RELEVANT}"


@registered(f"{_RELEVANCE} SELECT qid, part_id, round(relevance, 6) AS relevance, round(bm, 6) AS bm FROM relevant")
def part_relevance(spark, sf_dir):
    asked = P.part_subject(question_table(spark, PART_QUESTIONS), VOCAB)
    hits = P.relevant_parts(asked, standin.parts(spark, sf_dir), VOCAB, standin.part_index(spark, sf_dir))
    return hits.select("qid", "part_id", F.round("relevance", 6).alias("relevance"), F.round("bm", 6).alias("bm"))


# every question here is answered lexically or names category words only, so no
# fuzzy comparison takes part and SQL can state the whole result
@registered(f"""{_RELEVANCE}, {S.PHOTOS}, {S.FIRST_PHOTO}, keyed AS (SELECT qid, part_id, pos, -(10 * relevance - bm * 0.1e0) AS k, ref_norm, ref, kind, supplier_ref FROM relevant JOIN parts_v USING (part_id)),
one_each AS (SELECT qid, ref_norm, arg_min((part_id, ref, kind, supplier_ref), (k, pos, part_id)) AS r, min((k, pos, part_id)) AS o FROM keyed GROUP BY 1, 2),
top AS (SELECT * FROM (SELECT qid, ref_norm, r, row_number() OVER (PARTITION BY qid ORDER BY o) AS rank FROM one_each) WHERE rank <= 6),
names AS (SELECT qid, ref_norm, regexp_replace(lower(designation), '[^a-z0-9]', '', 'g') AS nk, min((part_id <> r[1], part_id)) AS place, arg_min(trim(designation), (part_id <> r[1], part_id)) AS name
 FROM top JOIN parts_v USING (ref_norm) GROUP BY 1, 2, 3),
merged AS (SELECT qid, ref_norm, array_to_string(list_slice(list(name ORDER BY place), 1, 2), ' · ') AS designation FROM names WHERE nk <> '' GROUP BY 1, 2)
SELECT qid, rank, r[2] AS ref, ref_norm, r[3] AS kind, coalesce(designation, '') AS designation, r[4] AS supplier_ref, photo FROM top LEFT JOIN merged USING (qid, ref_norm) LEFT JOIN first_photo USING (ref_norm)""")
def part_search(spark, sf_dir):
    return P.find_parts(question_table(spark, PART_QUESTIONS), *_tables(spark, sf_dir), VOCAB, index=standin.part_index(spark, sf_dir))


# the longest common subsequence as a table of lengths, one row of it in each step of the recursion
_FUZZY = """fz_names AS (SELECT DISTINCT lower(designation) AS name FROM parts_v WHERE length(designation) > 0),
fz_pairs AS (SELECT qid, name, list_sort(list_distinct(list_filter(string_split(needle, ' '), lambda x: x <> ''))) AS wa, list_sort(list_distinct(list_filter(string_split(name, ' '), lambda x: x <> ''))) AS wb FROM needles, fz_names),
fz_shared AS (SELECT *, list_filter(wa, lambda x: list_contains(wb, x)) AS sh FROM fz_pairs WHERE len(wa) > 0 AND len(wb) > 0),
fz_texts AS (SELECT qid, name, length(array_to_string(sh, ' ')) AS c, array_to_string(list_concat(sh, list_filter(wa, lambda x: NOT list_contains(sh, x))), ' ') AS l,
 array_to_string(list_concat(sh, list_filter(wb, lambda x: NOT list_contains(sh, x))), ' ') AS r, len(sh) > 0 AND (len(sh) = len(wa) OR len(sh) = len(wb)) AS whole FROM fz_shared),
fz_steps AS (SELECT qid, name, 0 AS i, list_transform(range(0, length(l) + 1), lambda j: 0) AS lens FROM fz_texts WHERE NOT whole
 UNION ALL SELECT f.qid, f.name, i + 1, list_transform(range(1, length(l) + 2), lambda j: CASE WHEN j = 1 THEN 0 ELSE greatest(lens[j], list_max(list_transform(range(1, j), lambda k: lens[k] + (l[k] = r[i + 1])::INT))) END)
 FROM fz_steps f JOIN fz_texts t ON f.qid = t.qid AND f.name = t.name WHERE i < length(r)),
fz_common AS (SELECT qid, name, lens[-1] AS common FROM fz_steps JOIN fz_texts USING (qid, name) WHERE i = length(r)),
fz_similar AS (SELECT qid, name, CASE WHEN whole THEN 100.0e0 ELSE greatest(200.0e0 * common / (length(l) + length(r)), 200.0e0 * c / (c + length(l)), 200.0e0 * c / (c + length(r))) END AS similarity
 FROM fz_texts LEFT JOIN fz_common USING (qid, name)),
fuzzy AS (SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY similarity DESC, part_id) AS rank, part_id, similarity
 FROM fz_similar JOIN parts_v ON lower(designation) = name WHERE similarity >= 72) WHERE rank <= FUZZY_LIMIT)"""
NEEDLES = {1: "smal rnig", 2: "anvil blu", 3: "plate new 12mm", 4: "gizmoo"}


@registered(f"""WITH RECURSIVE {S.PARTS}, {question_values(NEEDLES)}, needles AS (SELECT qid, question AS needle FROM asked), {_FUZZY.replace("FUZZY_LIMIT", "6")}
SELECT qid, rank, part_id, round(similarity, 6) AS similarity FROM fuzzy""")
def fuzzy_parts(spark, sf_dir):
    needles = question_table(spark, NEEDLES)
    hits = P.fuzzy_parts(needles.select("qid", F.col("question").alias("needle")), standin.parts(spark, sf_dir))
    return hits.select("qid", "rank", "part_id", F.round("similarity", 6).alias("similarity"))


WANTED_PAGES = ((1, "143"), (2, "1-52"), (3, "172"))


@registered(f"""WITH {S.PAGES}, {S.PARTS}, {S.PHOTOS}, known AS (SELECT ref_norm FROM parts_v UNION SELECT ref_norm FROM photos_v),
wanted(qid, ref, ref_norm) AS (VALUES {", ".join(f"({a}::BIGINT, '{b}', '{b.replace('-', '')}')" for a, b in WANTED_PAGES)}),
upper_v AS (SELECT page_id, doc_id, page_num, upper(text) AS u FROM pages_v),
listed AS (SELECT page_id, doc_id, page_num, unnest({S.page_ref_candidates('u')}) AS ref_norm FROM upper_v),
first_v AS (SELECT * FROM (SELECT qid, page_id, ref, ref_norm, row_number() OVER (PARTITION BY qid ORDER BY doc_id, page_num, page_id) AS pos
 FROM listed JOIN wanted USING (ref_norm) SEMI JOIN known USING (ref_norm))),
joined AS (SELECT first_v.*, text, [lower(ref_norm), lower(ref)] AS terms FROM first_v JOIN pages_v USING (page_id)), {S.snippet_steps('joined', 'qid, page_id', 'text', 'terms')},
checked AS (SELECT qid, page_id, pos, snippet, lower(text) AS low, text FROM joined JOIN joined_snip USING (qid, page_id)
 WHERE regexp_matches(text || ' ', '(?i)(^|[^A-Za-z0-9])' || ref_norm || '([^A-Za-z0-9]|$)') OR regexp_matches(text || ' ', '(?i)(^|[^A-Za-z0-9])' || ref || '([^A-Za-z0-9]|$)')),
kept AS (SELECT * FROM checked WHERE NOT (length(trim(snippet)) < 40 AND (contains(low, 'schematic cross-sections') OR contains(low, 'contents') OR contains(low, 'pages 50-51') OR contains(low, 'pages 52-53')))
 AND NOT (length(trim(text)) < 120 AND contains(low, 'schematic cross-sections')))
SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY pos) AS rank, page_id, snippet FROM kept) WHERE rank <= 6""")
def pages_using_ref(spark, sf_dir):
    wanted = question_table(spark, dict(WANTED_PAGES)).select(
        "qid", F.col("question").alias("ref"), R.norm_ref(F.col("question")).alias("ref_norm"))
    hits = P.pages_using_ref(wanted, standin.pages(spark, sf_dir), P.known_refs(*_tables(spark, sf_dir)), VOCAB,
                             listed=standin.ref_pages(spark, sf_dir))
    return hits.select("qid", "rank", "page_id", "snippet")


# ----------------------------------------------------------------------- facets
_HEADINGS = f"""capital_v AS (SELECT page_id, upper(replace(regexp_replace(text, '[.,!?]+\\s*', chr(10), 'g'), 'ß', 'SS')) AS text FROM pages_v),
flat AS (SELECT page_id, unnest(regexp_split_to_array(text, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')) AS raw FROM capital_v),
tidy AS (SELECT page_id, {S.heading_line('raw')} AS line FROM flat), heads AS (SELECT page_id, {S.title_case('line')} AS heading FROM tidy WHERE {S.is_heading('line')})"""


@registered(f"WITH {S.PAGES}, {_HEADINGS} SELECT heading, count(*) AS n FROM heads GROUP BY 1")
def headings(spark, sf_dir):
    rows = facets.heading_rows(standin.capital_pages(spark, sf_dir), ["page_id"], VOCAB)
    return rows.groupBy("heading").agg(F.count(F.lit(1)).alias("n"))


_TOPICS = f"""topics AS (SELECT * FROM (SELECT qid, heading, n, row_number() OVER (PARTITION BY qid ORDER BY n DESC, heading) AS rank FROM
 (SELECT qid, heading, count(*) AS n FROM heads JOIN (SELECT qid, page_id FROM ranked) USING (page_id) GROUP BY 1, 2)) WHERE rank <= 10)"""


@registered(f"{_SEARCH}, {_HEADINGS}, {_TOPICS} SELECT qid, heading, n, rank FROM topics")
def facet_topics(spark, sf_dir):
    return facets.topics(ranked(spark, sf_dir), standin.capital_pages(spark, sf_dir), VOCAB)


@registered(f"""{_SEARCH} SELECT qid, string_agg(DISTINCT system, ',' ORDER BY system) AS systems, string_agg(DISTINCT doc_kind, ',' ORDER BY doc_kind) AS doc_kinds FROM ranked GROUP BY 1""")
def facet_systems(spark, sf_dir):
    found = facets.page_facets(ranked(spark, sf_dir))
    return found.select("qid", F.array_join("systems", ",").alias("systems"), F.array_join("doc_kinds", ",").alias("doc_kinds"))


_KIND_ARMS = " ".join(f"WHEN {S.overlaps('base', w)} THEN {S.q(k)}" for k, w in V.FACET_KIND_WORDS.items())
_FAMILIES = f"""bases AS (SELECT qid, question, {S.content('question')} AS base FROM asked), kinds_v AS (SELECT *, CASE {_KIND_ARMS} END AS asked_kind FROM bases),
fam AS (SELECT part_id, kind, {S.designation_group('designation')} AS family FROM parts_v WHERE length(designation) > 2),
{S.expand_steps('kinds_v', 'qid, asked_kind')}, ptok AS (SELECT part_id, unnest(list_concat({S.index_tokens('ref')}, {S.index_tokens('designation')})) AS term FROM parts_v),
asked_words AS (SELECT qid, unnest(expanded) AS phrase FROM kinds_v_expanded WHERE asked_kind IS NULL),
match_v AS (SELECT DISTINCT qid, part_id FROM ptok JOIN asked_words ON starts_with(term, phrase)),
rows_v AS (SELECT qid, family FROM fam JOIN kinds_v ON kind = asked_kind UNION ALL SELECT qid, family FROM fam JOIN match_v USING (part_id)),
families AS (SELECT * FROM (SELECT qid, family, n, row_number() OVER (PARTITION BY qid ORDER BY n DESC, family) AS rank FROM (SELECT qid, family, count(*) AS n FROM rows_v WHERE family <> '' GROUP BY 1, 2)) WHERE rank <= 10 AND n > 1)"""


@registered(f"WITH {S.PARTS}, {question_values(PART_QUESTIONS)}, {_FAMILIES} SELECT qid, family, n, rank FROM families")
def component_families(spark, sf_dir):
    return facets.component_families(question_table(spark, PART_QUESTIONS), standin.parts(spark, sf_dir), VOCAB, index=standin.part_index(spark, sf_dir))


@registered(f"""{_SEARCH}, {S.PARTS}, {_HEADINGS}, {_TOPICS}, {_FAMILIES}, named AS (SELECT qid, {S.system_named('question')} AS sys FROM asked),
fac AS (SELECT qid, list(DISTINCT system ORDER BY system) AS systems, list(DISTINCT doc_kind) AS kinds FROM ranked GROUP BY 1),
offers AS (SELECT qid, 0 AS stage, rank AS pos, family || coalesce(' — ' || sys, '') AS s FROM families JOIN named USING (qid) WHERE rank <= 4
 UNION ALL SELECT qid, 1, rank, heading || coalesce(' — ' || sys, '') FROM topics JOIN named USING (qid) WHERE rank <= 3
 UNION ALL SELECT qid, 2, i - 1, 'What does ' || systems[i] || ' cover?' FROM fac JOIN named USING (qid), (SELECT unnest([1, 2, 3]) AS i) WHERE sys IS NULL AND i <= len(systems)
 UNION ALL SELECT qid, 3, 0, 'Fabrication drawings for ' || coalesce(sys, systems[1]) FROM fac JOIN named USING (qid) WHERE list_contains(kinds, 'fabrication drawing')),
uniq AS (SELECT qid, arg_min(s, (stage, pos)) AS suggestion, min((stage, pos)) AS o FROM offers GROUP BY qid, lower(s))
SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY o) AS rank, suggestion FROM uniq) WHERE rank <= 6""")
def suggestions(spark, sf_dir):
    questions, pages = question_table(spark, QUESTIONS), standin.capital_pages(spark, sf_dir)
    top = ranked(spark, sf_dir)
    return facets.suggestions(
        questions, facets.component_families(questions, standin.parts(spark, sf_dir), VOCAB, index=standin.part_index(spark, sf_dir)),
        facets.topics(top, pages, VOCAB), facets.page_facets(top), VOCAB)


TYPING = {1: "143", 2: "ring", 3: "small anvil", 4: "x", 5: "19", 6: "smal rnig", 7: "anvill"}


@registered(f"""WITH RECURSIVE {S.PARTS}, {S.PHOTOS}, {question_values(TYPING)}, typed AS (SELECT qid, question AS t FROM asked), {_NEAREST.replace("NEAR_LIMIT", "5")}, {_RELEVANT},
needles AS (SELECT qid, array_to_string(base, ' ') AS needle FROM understood WHERE qid NOT IN (SELECT qid FROM relevant) AND len(list_filter(base, lambda w: NOT list_contains({S.strings(VOCAB.broad_words)}, w))) > 0),
{_FUZZY.replace("FUZZY_LIMIT", "3")},
keyed AS (SELECT qid, ref_norm, ref, -(10 * relevance - bm * 0.1e0) AS k, bm AS p, part_id FROM relevant JOIN parts_v USING (part_id)
 UNION ALL SELECT qid, ref_norm, ref, -similarity, rank::DOUBLE, part_id FROM fuzzy JOIN parts_v USING (part_id)),
one_each AS (SELECT qid, arg_min(ref, (k, p, part_id)) AS ref, min((k, p, part_id)) AS o FROM keyed GROUP BY qid, ref_norm),
found AS (SELECT * FROM (SELECT qid, ref, row_number() OVER (PARTITION BY qid ORDER BY o) AS rank FROM one_each) WHERE rank <= 3),
prompts AS (SELECT unnest({S.strings(VOCAB.prompts)}) AS prompt, unnest(range({len(VOCAB.prompts)})) AS pos),
offers AS (SELECT qid, 0 AS stage, rank AS pos, ref AS s FROM near UNION ALL SELECT qid, 1, rank, ref FROM found
 UNION ALL SELECT qid, 2, pos, prompt FROM typed, prompts WHERE contains(lower(prompt), lower(trim(t)))),
uniq AS (SELECT qid, arg_min(s, (stage, pos)) AS suggestion, min((stage, pos)) AS o FROM offers JOIN typed USING (qid) WHERE length(trim(t)) >= 2 GROUP BY qid, lower(s))
SELECT * FROM (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY o) AS rank, suggestion FROM uniq) WHERE rank <= 6""")
def autocomplete(spark, sf_dir):
    typed = question_table(spark, TYPING)
    parts, photos = _tables(spark, sf_dir)
    near = P.near_misses(typed.select("qid", R.norm_ref(F.col("question")).alias("key")), parts, photos, limit=5)
    found = P.find_parts(typed, parts, photos, VOCAB, limit=3, index=standin.part_index(spark, sf_dir))
    return facets.autocomplete(typed, near, found, VOCAB)


_TOP_PAGE = "SELECT qid, max(coverage) FILTER (WHERE rank = 1) AS cov, max(CAST(round_even(100.0e0 * greatest(least(conf, 1.0e0), 0.0e0), 0) AS INT)) FILTER (WHERE rank = 1) AS sc, count(*) AS np FROM ranked GROUP BY 1"


@registered(f"""{_SEARCH}, asked_v AS (SELECT * FROM asked), {_WORDS}, {S.PARTS}, {S.PHOTOS}, known AS (SELECT ref_norm FROM parts_v UNION SELECT ref_norm FROM photos_v),
named AS (SELECT DISTINCT qid FROM cands SEMI JOIN known USING (ref_norm)), tp AS ({_TOP_PAGE}),
c AS (SELECT asked.qid, question, {S.tokens('question')} AS toks, {S.content('question')} AS con, {S.system_named('question')} AS sys, coalesce(np, 0) AS np, cov, sc,
 (SELECT coalesce(max(n / n_docs), 0.0e0) FROM dfs, size WHERE phrase = {S.content('question')}[1]) AS share FROM asked LEFT JOIN tp USING (qid))
SELECT qid, CASE WHEN len(toks) = 0 THEN true WHEN qid IN (SELECT qid FROM named) THEN false WHEN len(con) = 0 THEN true
 WHEN {S.overlaps('con', V.VAGUE_WORDS)} AND len(con) <= 3 THEN true WHEN regexp_matches(lower(question), '^({"|".join(V.GREETING_OPENERS)})\\b') THEN true WHEN np = 0 THEN true
 WHEN len(list_filter(con, lambda t: list_contains({S.strings(VOCAB.broad_words)}, t))) = len(con) THEN true WHEN len(con) = 1 AND share > 0.3e0 THEN true
 WHEN {S.overlaps('con', sorted(VOCAB.synonyms))} THEN false WHEN cov = 0 AND sc < 60 THEN true WHEN len(con) = 1 AND sys IS NULL AND cov < 1 THEN true ELSE false END AS broad FROM c""")
def broad_flag(spark, sf_dir):
    from plansift.plans.ask import broad_questions
    return broad_questions(question_table(spark, QUESTIONS), ranked(spark, sf_dir), standin.catalogue(spark, sf_dir))
