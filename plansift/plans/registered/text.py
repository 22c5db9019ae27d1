"""Question and page text functions over whole tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from plansift import vocab as V
from plansift.functions import refs as R, text as T
from plansift.plans.registered import sqlparts as S
from plansift.plans.registered.inputs import asked_about_parts, turns
from plansift.sources import standin

VOCAB = standin.VOCABULARY
KEYWORDS = ("erth", "143", "the of", "nicht", "ééé")
QUERIES, ORACLE = {}, {}


def registered(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn
    return add


def joined(c):
    return F.array_join(c, " ")


def _benchmark(spark, sf_dir):
    return standin.table(spark, sf_dir, "benchmark").select("item_id", "text")


def _text(spark, sf_dir):
    return standin.spread(standin.table(spark, sf_dir, "documents")).select("doc_id", "text")


@registered(f"SELECT conv_id, turn, array_to_string({S.tokens('text')}, ' ') AS tokens FROM conversations")
def tokens(spark, sf_dir):
    return turns(spark, sf_dir).select("conv_id", "turn", joined(T.tokens(F.col("text"))).alias("tokens"))


@registered(f"SELECT conv_id, turn, array_to_string({S.content('text')}, ' ') AS words FROM conversations")
def content_tokens(spark, sf_dir):
    return turns(spark, sf_dir).select(
        "conv_id", "turn", joined(T.content_tokens(F.col("text"))).alias("words"))


@registered(f"""WITH words AS (SELECT DISTINCT unnest({S.tokens('text')}) AS word FROM conversations)
SELECT word, array_to_string({S.variants('word')}, ' ') AS forms FROM words""")
def variants(spark, sf_dir):
    words = standin.table(spark, sf_dir, "conversations").select(
        F.explode(T.tokens(F.col("text"))).alias("word")).distinct()
    return words.select("word", joined(T.variants(F.col("word"))).alias("forms"))


@registered(f"""WITH {S.ASKED}, src AS (SELECT qid, {S.content('question')} AS base FROM asked_v),
{S.expand_steps('src', 'qid')} SELECT qid, array_to_string(expanded, ' ') AS expanded FROM src_expanded""")
def expand(spark, sf_dir):
    return asked_about_parts(spark, sf_dir).select(
        "qid", joined(T.expand(T.content_tokens(F.col("question")), VOCAB)).alias("expanded"))


@registered(f"""WITH {S.ASKED}, src AS (SELECT qid, {S.content('question')} AS words FROM asked_v)
SELECT qid, array_to_string(list_filter(words, lambda w: NOT {S.is_system_word('w')}), ' ') AS subject,
 array_to_string(list_filter(words, lambda w: {S.is_system_word('w')}), ' ') AS system_words FROM src""")
def split_subject(spark, sf_dir):
    words = T.content_tokens(F.col("question"))
    return asked_about_parts(spark, sf_dir).select(
        "qid", joined(T.subject_words(words, VOCAB)).alias("subject"),
        joined(T.system_words(words, VOCAB)).alias("system_words"))


@registered(f"""WITH {S.ASKED}, counts AS (SELECT qid,
 TRY_CAST(nullif(regexp_extract(question, {S.q(T.PAGE_COUNT)}, 1), '') AS BIGINT) AS pages_asked,
 TRY_CAST(nullif(regexp_extract(question, {S.q(T.IMAGE_COUNT)}, 1), '') AS BIGINT) AS images_asked FROM asked_v)
SELECT qid, pages_asked, images_asked, least(greatest(coalesce(nullif(pages_asked, 0), 3), 1), 20) AS max_pages,
 least(greatest(coalesce(nullif(images_asked, 0), 3), 1), 40) AS max_images FROM counts""")
def parse_counts(spark, sf_dir):
    rows = asked_about_parts(spark, sf_dir).select(
        "qid", T.pages_asked(F.col("question")).alias("pages_asked"),
        T.images_asked(F.col("question")).alias("images_asked"))
    return rows.select(
        "qid", "pages_asked", "images_asked",
        T.clamp(F.coalesce(F.nullif("pages_asked", F.lit(0)), F.lit(3)), 1, 20).alias("max_pages"),
        T.clamp(F.coalesce(F.nullif("images_asked", F.lit(0)), F.lit(3)), 1, 40).alias("max_images"))


_FLAG_ORACLE = f"""WITH {S.ASKED}, toks AS (SELECT *, {S.tokens('question')} AS w FROM asked_v)
SELECT qid, {S.system_named('question')} AS asked_system, {S.is_reference_query('question')} AS is_reference,
 {S.overlaps('w', V.DRAWING_WORDS)} AS wants_drawings FROM toks"""


@registered(_FLAG_ORACLE)
def question_flags(spark, sf_dir):
    q = F.col("question")
    return asked_about_parts(spark, sf_dir).select(
        "qid", T.system_named(q, VOCAB).alias("asked_system"), T.is_reference_query(q).alias("is_reference"),
        T.wants_drawings(q).alias("wants_drawings"))


def _only(words):
    return f"len(list_filter(w, lambda t: list_contains({S.strings(words)}, t))) = len(w)"


@registered(f"""WITH toks AS (SELECT conv_id, turn, {S.tokens('text')} AS w FROM conversations)
SELECT conv_id, turn, (len(w) BETWEEN 1 AND 3 AND ({_only(V.GREETINGS)} OR ({_only(V.GREETINGS + V.HELP_COMPANIONS)}
 AND {S.overlaps('w', V.HELP_WORDS)}))) AS is_greeting FROM toks""")
def greeting_flag(spark, sf_dir):
    return standin.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", T.is_greeting(F.col("text")).alias("is_greeting"))


def _mentions(terms):
    return " OR ".join(f"contains(low, {S.q(t)})" for t in terms)


@registered(f"""WITH src AS (SELECT conv_id, turn, text, lower(text) AS low FROM conversations)
SELECT conv_id, turn, ({_mentions(V.OUT_OF_SCOPE_TERMS)}) AND NOT ({_mentions(VOCAB.domain_terms)}
 OR regexp_matches(low, '\\b\\d{{4,6}}\\b') OR {S.is_reference_query('text')}) AS out_of_scope FROM src""")
def out_of_scope_flag(spark, sf_dir):
    return standin.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", T.is_out_of_scope(F.col("text"), VOCAB).alias("out_of_scope"))


@registered(f"""SELECT DISTINCT p_type, p_brand, {S.norm_ref("p_brand || '-' || p_size || '/' || p_type || ' .x'")} AS ref_key,
 coalesce(nullif(trim(regexp_replace(p_brand || ' ' || p_type || '#.pdf', '[^A-Za-z0-9._-]+', '_', 'g'), '_'), ''), 'doc') AS stem FROM part""")
def reference_and_file_keys(spark, sf_dir):
    ref = F.concat("p_brand", F.lit("-"), F.col("p_size").cast("string"), F.lit("/"), "p_type", F.lit(" .x"))
    return standin.table(spark, sf_dir, "part").select(
        "p_type", "p_brand", R.norm_ref(ref).alias("ref_key"),
        T.sanitize(F.concat("p_brand", F.lit(" "), "p_type", F.lit("#.pdf"))).alias("stem")).distinct()


@registered("""WITH f AS (SELECT DISTINCT source, lang, CASE WHEN lang = 'en' THEN 'd' || substr(source, 4) || '100.pdf'
 WHEN lang = 'fr' THEN source || '_doutil.pdf' ELSE 'brochure_' || lang || '.pdf' END AS filename,
 CASE WHEN lang = 'es' THEN '' ELSE source END AS folder FROM documents)
SELECT source, lang, CASE WHEN regexp_matches(lower(filename), '^d\\d{3,5}') THEN 'fabrication drawing'
 WHEN regexp_matches(lower(filename), 'doutil|tool') THEN 'technical catalogue' ELSE 'product brochure' END AS doc_kind,
 CASE WHEN regexp_matches(folder, '(?i)src\\d?[02468]$') THEN 'EVEN SOURCE' WHEN regexp_matches(folder, '(?i)src\\d?[13579]$') THEN 'ODD SOURCE'
 WHEN regexp_matches(filename, '(?i)src\\d?[02468]$') THEN 'EVEN SOURCE' WHEN regexp_matches(filename, '(?i)src\\d?[13579]$') THEN 'ODD SOURCE'
 WHEN folder <> '' THEN upper(folder) ELSE 'GENERAL' END AS system FROM f""")
def file_kind_and_system(spark, sf_dir):
    files = standin.table(spark, sf_dir, "documents").select("source", "lang").distinct()
    name = (F.when(F.col("lang") == "en", F.concat(F.lit("d"), F.substring("source", 4, 100), F.lit("100.pdf")))
            .when(F.col("lang") == "fr", F.concat("source", F.lit("_doutil.pdf")))
            .otherwise(F.concat(F.lit("brochure_"), "lang", F.lit(".pdf"))))
    folder = F.when(F.col("lang") == "es", F.lit("")).otherwise(F.col("source"))
    return files.select("source", "lang", T.kind_of_file(name).alias("doc_kind"),
                        T.system_of_file(folder, name, VOCAB).alias("system"))


@registered(f"""SELECT doc_id, sha256({S.clean_text('text')}) AS digest, length({S.clean_text('text')}) AS n FROM documents""")
def clean_text(spark, sf_dir):
    cleaned = _text(spark, sf_dir).select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))
    return cleaned.select("doc_id", F.sha2("cleaned", 256).alias("digest"), F.length("cleaned").cast("bigint").alias("n"))


@registered(f"""WITH c AS (SELECT doc_id, {S.strip('text')} AS raw, {S.strip(S.clean_text('text'))} AS cleaned FROM documents)
SELECT doc_id, (length(cleaned) < 250 OR 1.0e0 - length(cleaned) / greatest(length(raw), 1) > 0.15e0) AS needs_ocr FROM c""")
def needs_ocr(spark, sf_dir):
    return _text(spark, sf_dir).select(
        "doc_id", T.needs_ocr(F.col("text"), T.clean_text(F.col("text"))).alias("needs_ocr"))


@registered(f"SELECT doc_id, {S.readable('text')} AS readable FROM documents")
def readable(spark, sf_dir):
    return _text(spark, sf_dir).select("doc_id", T.readable(F.col("text")).alias("readable"))


@registered(f"""WITH src AS (SELECT doc_id, text, {S.strings(KEYWORDS)} AS terms FROM documents),
{S.snippet_steps('src', 'doc_id', 'text', 'terms')} SELECT doc_id, snippet FROM src_snip""")
def snippet(spark, sf_dir):
    terms = F.array(*[F.lit(k) for k in KEYWORDS])
    return _text(spark, sf_dir).select("doc_id", T.snippet(F.col("text"), terms).alias("snippet"))


@registered(f"""SELECT part_id, {S.designation_group('designation')} AS family,
 list_max(list_transform(regexp_extract_all(designation, '(?i)(\\d+)\\s*mm', 1), lambda n: CAST(n AS BIGINT))) AS largest
 FROM (WITH {S.PARTS} SELECT * FROM parts_v)""")
def designation_family(spark, sf_dir):
    return standin.parts(spark, sf_dir).select(
        "part_id", T.designation_group(F.col("designation")).alias("family"),
        F.array_max(T.numbers_before(F.col("designation"), "mm")).alias("largest"))


@registered("""SELECT doc_id, regexp_matches(text, '(?i)\\b(le|la|les|des|une|est|pour|avec|quelle?|joint|ouvrant|dormant|coulissant|levant)\\b') AS french,
 regexp_matches(text, '[؀-ۿ]') AS arabic FROM documents""")
def language_flags(spark, sf_dir):
    return _text(spark, sf_dir).select("doc_id", T.looks_french(F.col("text")).alias("french"),
                                       T.looks_arabic(F.col("text")).alias("arabic"))


def _to_english(x):
    for french, english in V.FRENCH_TO_ENGLISH:
        x = f"regexp_replace({x}, {S.q('(?i)' + french)}, {S.q(english)}, 'g')"
    return x


@registered(f"SELECT conv_id, turn, {_to_english('text')} AS english FROM conversations")
def french_to_english(spark, sf_dir):
    return standin.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", T.french_to_english(F.col("text")).alias("english"))


@registered("""SELECT item_id, regexp_replace(text, '(?i)(ontion|erth|the)', '<mark>\\1</mark>', 'g') AS marked FROM benchmark""")
def mark_terms(spark, sf_dir):
    terms = F.array(F.lit("the"), F.lit("ontion"), F.lit("in"), F.lit("erth"), F.lit("the"))
    return _benchmark(spark, sf_dir).select("item_id", T.mark_terms(F.col("text"), terms).alias("marked"))


def _unnest_keywords():
    return f"(SELECT unnest({S.strings(KEYWORDS)}) AS keyword)"


@registered(f"""SELECT keyword, count(*) FILTER (WHERE contains(lower(text), keyword)) AS pages,
 CAST(sum(len(string_split(lower(text), keyword)) - 1) AS BIGINT) AS occurrences FROM documents, {_unnest_keywords()} GROUP BY keyword""")
def keyword_scan(spark, sf_dir):
    low = F.lower("text")
    counts = F.array(*[F.struct(
        F.lit(k).alias("keyword"),
        F.floor((F.length(low) - F.length(F.replace(low, F.lit(k), F.lit("")))) / len(k)).alias("times"))
        for k in KEYWORDS])
    rows = _text(spark, sf_dir).select(F.explode(counts).alias("c")).select("c.*")
    return rows.groupBy("keyword").agg(F.count_if(F.col("times") > 0).alias("pages"),
                                       F.sum("times").cast("bigint").alias("occurrences"))


def _tidy(x):
    x = S.strip(f"regexp_replace({S.strip(x)}, '^[-*•·]+', '')")
    x = S.strip(f"regexp_replace({x}, '^\\d[.)]', '')")
    return S.strip(f"regexp_replace({x}, '^\"+|\"+$', '', 'g')")


@registered(f"""SELECT conv_id, turn, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda s: {_tidy('s')}),
 lambda s: length(s) BETWEEN 5 AND 90 AND NOT suffix(s, ':'))[1:6], '|') AS options FROM conversations""")
def suggestion_lines(spark, sf_dir):
    rows = standin.table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", F.array_join(T.suggestion_lines(F.col("text")), "|").alias("options"))


@registered(f"""WITH src AS (SELECT conv_id, turn, {S.strip('text')} AS t FROM conversations)
SELECT conv_id, turn, sha256(lower(t) || '|' || 'pages@1') AS cache_key, sha1(t) AS digest,
 'vision:' || sha1(t) AS image_key FROM src""")
def cache_keys(spark, sf_dir):
    text = T.strip(F.col("text"))
    return standin.table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", T.cache_key(F.col("text"), F.lit("pages@1")).alias("cache_key"),
        F.sha1(text).alias("digest"), T.image_key(F.lit("vision"), F.sha1(text)).alias("image_key"))


@registered(f"""WITH {S.ASKED}, base_v AS (SELECT qid, question, {S.content('question')} AS base FROM asked_v),
{S.expand_steps('base_v', 'qid, question')},
all_terms AS (SELECT qid, list_filter(list_concat(base, expanded), lambda t: length(t) > 2) AS terms FROM base_v_expanded)
SELECT qid, array_to_string(list_filter(terms, lambda t, i: list_position(terms, t) = i), ' ') AS terms FROM all_terms""")
def highlight_terms(spark, sf_dir):
    rows = asked_about_parts(spark, sf_dir).select("qid", T.content_tokens(F.col("question")).alias("base"))
    return rows.select("qid", joined(T.highlight_terms(F.col("base"), T.expand(F.col("base"), VOCAB))).alias("terms"))


@registered(f"""WITH {S.ASKED}, base_v AS (SELECT qid, question, {S.content('question')} AS base FROM asked_v),
{S.expand_steps('base_v', 'qid, question')},
named AS (SELECT e.*, CASE WHEN p_size % 3 = 0 THEN 'AB-' || p_partkey WHEN p_size % 3 = 1 THEN '' END AS ref, upper(p_name) || ' ' || p_size || 'mm: ' || p_brand AS designation
 FROM base_v_expanded e JOIN part ON p_partkey = qid),
all_terms AS (SELECT qid, list_filter(list_concat(CASE WHEN ref <> '' THEN list_concat([ref], {S.content('designation')}) ELSE [] END, base, expanded), lambda t: length(t) > 2) AS terms FROM named)
SELECT qid, array_to_string(list_filter(terms, lambda t, i: list_position(list_transform(terms, lambda x: lower(x)), lower(t)) = i), ' ') AS terms FROM all_terms""")
def highlight_terms_of_part(spark, sf_dir):
    """Terms to mark when a question names a part: its reference and the words of its name come first."""
    part = standin.table(spark, sf_dir, "part")
    size = F.col("p_size") % 3
    named = part.select(F.col("p_partkey").alias("qid"), F.when(size == 0, F.concat(F.lit("AB-"), F.col("p_partkey").cast("string"))).when(
        size == 1, F.lit("")).alias("ref"), F.concat(F.upper("p_name"), F.lit(" "), F.col("p_size").cast("string"), F.lit("mm: "), F.col("p_brand")).alias("designation"))
    rows = asked_about_parts(spark, sf_dir).select("qid", T.content_tokens(F.col("question")).alias("base")).join(named, "qid")
    return rows.select("qid", joined(T.highlight_terms(F.col("base"), T.expand(F.col("base"), VOCAB), F.col("ref"), F.col("designation"))).alias("terms"))
