"""DuckDB renderings of the column functions, used to write oracle queries."""
from __future__ import annotations

from plansift import vocab as V
from plansift.functions import refs as R, text as T
from plansift.sources import standin

VOCAB = standin.VOCABULARY


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strings(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def tokens(x: str) -> str:
    return f"list_filter(regexp_extract_all(lower({x}), {q(T.TOKEN_PATTERN)}), lambda t: length(t) > 1)"


def without_stop_words(toks: str) -> str:
    return f"list_filter({toks}, lambda t: NOT list_contains({strings(V.STOP_WORDS)}, t))"


def content(x: str) -> str:
    return without_stop_words(tokens(x))


def search_words(x: str) -> str:
    return f"CASE WHEN len({content(x)}) > 0 THEN {content(x)} ELSE {tokens(x)} END"


def singular(w: str) -> str:
    return (f"CASE WHEN length({w}) > 4 AND suffix({w}, 'ies') THEN left({w}, length({w}) - 3) || 'y' "
            f"WHEN length({w}) > 4 AND regexp_matches({w}, '(ses|xes|ches|shes)$') THEN left({w}, length({w}) - 2) "
            f"WHEN length({w}) > 3 AND suffix({w}, 's') AND NOT suffix({w}, 'ss') THEN left({w}, length({w}) - 1) END")


def variants(w: str) -> str:
    return f"list_filter([{w}, {singular(w)}], lambda z: z IS NOT NULL)"


def ordered_unique(xs: str) -> str:
    return f"list_filter({xs}, lambda u, i: list_position({xs}, u) = i)"


def synonym_map() -> str:
    return "MAP {" + ", ".join(f"{q(w)}: {strings(g)}" for w, g in VOCAB.synonyms.items()) + "}"


def expand_steps(source: str, keep: str, base: str = "base") -> str:
    """Two CTE bodies: ``forms`` then ``expanded`` on top of a CTE with ``base``."""
    return f"""{source}_forms AS (SELECT *, flatten(list_transform({base}, lambda w: {variants('w')})) AS forms FROM {source}),
{source}_all AS (SELECT *, flatten(list_transform(forms, lambda w: list_concat([w], coalesce({synonym_map()}[w], []::VARCHAR[])))) AS every FROM {source}_forms),
{source}_expanded AS (SELECT {keep}, {base}, {ordered_unique('every')} AS expanded FROM {source}_all)"""


def system_named(x: str) -> str:
    padded = f"regexp_replace(' ' || regexp_replace(lower({x}), '[^a-z0-9&\\s]', ' ', 'g') || ' ', '\\s+', ' ', 'g')"
    arms = " ".join(
        f"WHEN {' OR '.join(f'contains({padded}, {q(a)})' for a in aliases)} THEN {q(s)}"
        for s, aliases in VOCAB.system_aliases.items())
    return f"CASE {arms} END"


def overlaps(toks: str, words) -> str:
    return f"list_has_any({toks}, {strings(words)})"


def is_system_word(w: str) -> str:
    return f"(regexp_matches({w}, '^[0-9]{{2}}th$') OR list_contains({strings(VOCAB.system_words)}, {w}))"


def is_reference_query(x: str) -> str:
    c = content(x)
    return f"(len({c}) BETWEEN 1 AND 3 AND len(list_filter({c}, lambda d: regexp_matches(d, '[0-9]'))) = len({c}))"


def index_tokens(x: str) -> str:
    return f"regexp_extract_all(strip_accents(lower({x})), '[\\p{{L}}\\p{{N}}]+')"


def norm_ref(x: str) -> str:
    return f"regexp_replace(upper({x}), '[\\s./\\-]', '', 'g')"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def _re(x, pattern, to):
    return f"regexp_replace({x}, {pattern}, {to}, 'g')"


def clean_text(x: str) -> str:
    caps, solid, w = T.ACCENTED_CAPITALS, "[0-9A-Za-zÀ-ɏ]", "[^ \\n]"
    c, n, j = "\\x01", "\\x02", "\\x03"
    C, N, J = "chr(1)", "chr(2)", "chr(3)"
    x = _re(x, q(r"[^\t\n\r\x20-\x7E\x{A0}-\x{24F}\x{2010}-\x{203A}\x{20AC}]+"), "' '")
    x = _re(x, q(f"({w}+)"), f"{N} || '\\1'")
    x = _re(x, q(f"{n}({w}*[{caps}]{w}*)"), f"{J} || '\\1'")
    x = _re(x, q(f"{j}([{caps}][a-zà-ÿ'’\\-]{{2,}})([ \\n]|$)"), f"{C} || '\\1\\2'")
    x = _re(x, q(f"{n}({solid}{w}{{2,}}|{w}{solid}{w}+|{w}{{2,}}{solid}{w}*)"), f"{C} || '\\1'")
    x = _re(x, q(f"(?:{n}[^{c}{j}\\n]*)?{j}[^{c}{j}\\n]*{j}[^{c}\\n]*"), "''")
    x = _re(x, q(f"[{c}-{j}]"), "''")
    x = f"trim({_re(_re(x, q(' +'), q(' ')), q(' ?' + chr(92) + 'n ?'), 'chr(10)')}, ' ')"
    return _re(x, q("[ \\t]{2,}"), "' '")


def snippet_steps(source: str, key: str, text: str, terms: str) -> str:
    """CTEs ending in ``<source>_snip(key, snippet)``."""
    body = strip(clean_text(_re(text, q(r"[ \t]+"), "' '")))
    return f"""{source}_body AS (SELECT {key}, {terms} AS terms, {body} AS body FROM {source}),
{source}_at AS (SELECT *, greatest(coalesce(list_min(list_filter(list_transform(terms, lambda t: instr(lower(body), t)), lambda p: p > 0)), 1) - 1 - 100, 0) AS start FROM {source}_body),
{source}_snip AS (SELECT {key}, CASE WHEN body = '' THEN '' ELSE (CASE WHEN start > 0 THEN '…' ELSE '' END)
 || trim(replace(substr(body, start + 1, 420), chr(10), ' '), ' ') || (CASE WHEN start + 420 < length(body) THEN '…' ELSE '' END) END AS snippet FROM {source}_at)"""


def title_case(x: str) -> str:
    pieces = f"regexp_extract_all(lower({x}), '\\p{{L}}+|\\P{{L}}+')"
    return f"list_aggregate(list_transform({pieces}, lambda p: upper(p[1]) || p[2:]), 'string_agg', '')"


def readable(x: str) -> str:
    longs = f"regexp_extract_all({x}, '[A-Za-zÀ-ÿ]{{6,}}')"
    starved = (f"list_filter({longs}, lambda w: length(regexp_replace(lower(w), {q('[^' + T.VOWELS + ']')}, '', 'g'))"
               f" / length(w) < 0.25e0)")
    ordinary = f"length(regexp_replace({x}, {q('[^' + chr(92) + 'x00-' + chr(92) + 'x7F' + T.READABLE_EXTRA + ']')}, '', 'g'))"
    return (f"(length({x}) > 0 AND {ordinary} / greatest(length({x}), 1) > 0.85e0 "
            f"AND (len({longs}) = 0 OR len({starved}) * 2 <= len({longs})))")


def heading_line(x: str) -> str:
    return _re(_re(x, q(r"\s+"), "' '"), q(r"^[ :·\-]+|[ :·\-]+$"), "''")


def is_heading(x: str) -> str:
    digits = f"length(regexp_replace({x}, '[^0-9]', '', 'g'))"
    return (f"(regexp_matches({x}, {q(T.HEADING_PATTERN)}) AND NOT list_contains({strings(VOCAB.heading_stop)}, upper({x})) "
            f"AND {readable(x)} AND {digits} * 2 <= length({x}))")


def designation_group(x: str) -> str:
    x = f"regexp_extract({x}, '^[^:(\\[]*')"
    x = _re(x, q(T.MEASURE), "' '")
    x = _re(x, q(r"[^A-Za-z /&'\-]+"), "' '")
    x = _re(_re(x, q(r"\s+"), "' '"), q(r"^[ \-/&]+|[ \-/&]+$"), "''")
    return f"CASE WHEN length({x}) BETWEEN 3 AND 34 THEN {title_case(x)} ELSE '' END"


def page_ref_candidates(text: str) -> str:
    """Normalised candidates (with duplicates) of an upper-case text column."""
    words = f"list_distinct(regexp_extract_all({text}, {q(R.PAGE_REFERENCE)}))"
    near = f"substr({text}, greatest(instr({text}, w) - 30, 1), instr({text}, w) + 30 - greatest(instr({text}, w) - 30, 1))"
    kept = (f"list_filter({words}, lambda w: length({norm_ref('w')}) >= 2 AND NOT (regexp_matches(w, '^[0-9]+-[0-9]+$')"
            f" AND contains({near}, 'PAGES')))")
    return f"list_distinct(list_transform({kept}, lambda w: {norm_ref('w')}))"


def page_image(filename: str, page: str, suffix: str = "") -> str:
    stem = _re(filename, q(r"\.[^.]*$"), "''")
    stem = f"trim({_re(_re(stem, q('/'), q('_')), q('[^A-Za-z0-9._' + chr(92) + '-]+'), q('_'))}, '_')"
    return f"'pages/' || coalesce(nullif({stem}, ''), 'doc') || '/p' || printf('%03d', {page}) || '{suffix}.png'"


# ------------------------------------------------------------- stand-in tables
PAGES = """pages_v AS (SELECT doc_id AS page_id, source || '-' || lang AS doc_id, doc_id AS page_num, text,
  source || '/' || lang || ' notes.pdf' AS filename, upper(source) || ' — ' || lang || ' notes' AS title,
  upper(source) AS system, lang AS doc_kind FROM documents)"""

PARTS = """parts_v AS (SELECT p_partkey * 2 AS part_id, p_partkey::VARCHAR || (CASE WHEN p_size % 10 = 0 THEN '-T' ELSE '' END) AS ref,
  p_partkey::VARCHAR || (CASE WHEN p_size % 10 = 0 THEN 'T' ELSE '' END) AS ref_norm,
  CASE WHEN p_type IN ('STANDARD','ECONOMY') THEN 'profile' WHEN p_type IN ('SMALL','PROMO') THEN 'accessory' ELSE 'part' END AS kind,
  p_brand AS supplier_ref, upper(p_name) || ' ' || p_size || 'mm: ' || p_brand AS designation FROM part
 UNION ALL SELECT p_partkey * 2 + 1, p_partkey::VARCHAR || (CASE WHEN p_size % 10 = 0 THEN '-T' ELSE '' END),
  p_partkey::VARCHAR || (CASE WHEN p_size % 10 = 0 THEN 'T' ELSE '' END), 'accessory', p_brand,
  upper(split_part(p_name, ' ', 2) || ' ' || split_part(p_name, ' ', 1)) FROM part WHERE p_size <= 10)"""

PHOTOS = """photos_v AS (SELECT l_orderkey * 100 + l_linenumber AS image_id, (l_partkey * 3)::VARCHAR AS ref,
  (l_partkey * 3)::VARCHAR AS ref_norm, 'photo_' || l_orderkey || '_' || l_linenumber || '.jpg' AS filename FROM lineitem)"""

FIRST_PHOTO = "first_photo AS (SELECT ref_norm, '/refmedia/' || arg_min(filename, image_id) AS photo FROM photos_v GROUP BY 1)"

FIGURES = """figures_v AS (SELECT l_orderkey * 100 + l_linenumber AS figure_id, l_orderkey AS page_id,
  CASE WHEN l_returnflag = 'R' THEN 'drawing' ELSE 'raster' END AS kind,
  'fig_' || l_orderkey || '_' || l_linenumber || '.png' AS filename, 'fig_' || l_orderkey || '_' || l_linenumber || '_thumb.png' AS thumb,
  l_extendedprice AS area, l_discount * 4 AS x0, l_tax * 4 AS y0, l_discount * 4 + l_quantity / 100 AS x1,
  l_tax * 4 + l_quantity / 80 AS y1 FROM lineitem)"""

BOXES = """lines_v AS (SELECT doc_id AS page_id, string_split(text, chr(10)) AS ls FROM documents),
boxes_v AS (SELECT page_id * 100000 + pos - 1 AS box_id, page_id, ls[pos] AS text, 0.05e0 AS x, round((pos - 1) / len(ls), 5) AS y,
  round(least(length(ls[pos]) / 1000.0e0, 0.9e0), 5) AS w, round(1.0e0 / len(ls), 5) AS h
  FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS pos FROM lines_v))"""

ASKED = """asked_v AS (SELECT p_partkey AS qid, CASE p_type
  WHEN 'STANDARD' THEN 'Which profiles end in ' || p_partkey || '?'
  WHEN 'ECONOMY' THEN 'accessories with ' || p_size || ' at the start'
  WHEN 'SMALL' THEN 'any reference containing ' || p_partkey
  WHEN 'PROMO' THEN p_partkey || ' ' || p_size || 'th'
  WHEN 'LARGE' THEN 'show me 3 images of ' || p_name || 's on ' || p_size || ' pages for src1 source'
  ELSE 'what is part ' || (p_partkey * 3) || ' for, ' || p_size || ' mm glasses or drawings?' END AS question FROM part)"""
