"""Question and page text as column expressions.

Every function takes and returns :class:`pyspark.sql.Column`.  Nothing here runs
Python per row.  Arrays keep order and duplicates unless the docstring says
otherwise.
"""
from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, functions as F

from plansift import vocab as V

# fixed values: patterns and limits that define the results
TOKEN_PATTERN = r"[A-Za-z0-9؀-ۿ]+"
PRINTABLE_ONLY = r"[^\t\n\r\x20-\x7E -ɏ‐-›€]+"
ACCENTED_CAPITALS = "ÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞ"
READABLE_EXTRA = "àâäçéèêëîïôöùûüÿœæ°®±×µ–—’"
VOWELS = "aeiouyàâäéèêëîïôöùûü"
HEADING_PATTERN = r"^[A-Z0-9][A-Z0-9 &®°/'’\-\.\+]{4,44}$"
MEASURE = r"[\d.,/×x]+\s*(mm|MM)?\b"
IMAGE_COUNT = (r"(?i)(\d{1,2})\s*(?:images?|img|drawings?|pictures?|photos?|"
               r"illustrations?|figures?|sections?)\b")
PAGE_COUNT = (r"(?i)(\d{1,2})\s*(?:answers?|results?|pages?|hits?|entries?|rows?|"
              r"options?)\b")
FRENCH_WORDS = (r"(?i)(?<![A-Za-z0-9_])(le|la|les|des|une|est|pour|avec|quelle?|joint|ouvrant|"
                r"dormant|coulissant|levant)(?![A-Za-z0-9_])")
SNIPPET_CHARS = 420
SNIPPET_LEAD = 100


def blank_to_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def word_list(words) -> Column:
    """Words as one constant, folded into the plan as an array literal."""
    return F.from_json(F.lit(json.dumps(list(words), ensure_ascii=False)), "array<string>")


def has_any(words: Column, vocabulary) -> Column:
    return F.arrays_overlap(words, word_list(vocabulary))


# ------------------------------------------------------------------ questions
def tokens(c: Column) -> Column:
    """Lower-case runs of ASCII letters/digits or Arabic, two characters or more."""
    found = F.regexp_extract_all(F.lower(c), F.lit(TOKEN_PATTERN), F.lit(0))
    return F.filter(found, lambda t: F.length(t) > 1)


def drop_stop_words(toks: Column) -> Column:
    return F.filter(toks, lambda t: ~F.array_contains(word_list(V.STOP_WORDS), t))


def content_tokens(c: Column) -> Column:
    return drop_stop_words(tokens(c))


def search_words(c: Column) -> Column:
    """Content tokens, or every token when a question is made of stop words only."""
    toks = tokens(c)
    content = drop_stop_words(toks)
    return F.when(F.size(content) > 0, content).otherwise(toks)


# (plural ending, shortest word it applies to, characters cut, characters added);
# the first ending that applies decides
_SINGULAR_RULES = (
    (r"ies$", 5, 3, "y"),
    (r"(?:ses|xes|ches|shes)$", 5, 2, ""),
    (r"(?:^|[^s])s$", 4, 1, ""),
)


def _rule_chain(word: Column, rules, value) -> Column:
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for ending, shortest, cut, add in rules:
        applies = word.rlike(ending) & (F.length(word) >= shortest)
        chain = chain.when(applies, value(word, cut, add))
    return chain


def singular(word: Column) -> Column:
    """Singular of an English/French plural, or null when the word is not one."""
    return _rule_chain(
        word, _SINGULAR_RULES,
        lambda w, cut, add: F.concat(F.substring(w, F.lit(1), F.length(w) - cut), F.lit(add)))


def variants(word: Column) -> Column:
    return F.array_compact(F.array(word, singular(word)))


def _synonym_map(vocabulary: V.Vocabulary) -> Column:
    """Synonym table as one constant, folded into the plan as a map literal."""
    return F.from_json(F.lit(json.dumps(vocabulary.synonyms, ensure_ascii=False)),
                       "map<string,array<string>>")


def expand(toks: Column, vocabulary: V.Vocabulary | None = None) -> Column:
    """Each word, its singular and the synonyms of both; first occurrence kept."""
    synonyms = _synonym_map(vocabulary or V.Vocabulary())
    forms = F.flatten(F.transform(toks, variants))
    return F.array_distinct(F.flatten(F.transform(forms, lambda word: F.concat(
        F.array(word),
        F.coalesce(F.try_element_at(synonyms, word), F.array().cast("array<string>"))))))


def _count_asked(c: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, 1), F.lit("")).cast("int")


def pages_asked(c: Column) -> Column:
    return _count_asked(c, PAGE_COUNT)


def images_asked(c: Column) -> Column:
    return _count_asked(c, IMAGE_COUNT)


def clamp(c: Column, low: int, high: int) -> Column:
    return F.least(F.greatest(c, F.lit(low)), F.lit(high))


def system_named(c: Column, vocabulary: V.Vocabulary) -> Column:
    """First configured system whose alias occurs in the padded, cleaned question."""
    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(c), r"[^a-z0-9&\s]", " "), F.lit(" "))
    padded = F.regexp_replace(padded, r"\s+", " ")
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for system, aliases in vocabulary.system_aliases.items():
        hit = F.lit(False)
        for alias in aliases:
            hit = hit | F.contains(padded, F.lit(alias))
        chain = chain.when(hit, F.lit(system))
    return chain


def is_system_word(word: Column, vocabulary: V.Vocabulary) -> Column:
    return word.rlike(r"^\d{2}th$") | word.isin(*(vocabulary.system_words or ("",)))


def subject_words(toks: Column, vocabulary: V.Vocabulary) -> Column:
    return F.filter(toks, lambda t: ~is_system_word(t, vocabulary))


def system_words(toks: Column, vocabulary: V.Vocabulary) -> Column:
    return F.filter(toks, lambda t: is_system_word(t, vocabulary))


def wants_drawings(c: Column) -> Column:
    return has_any(tokens(c), V.DRAWING_WORDS)


def is_reference_query(c: Column) -> Column:
    """One to three content words, each holding a digit."""
    content = content_tokens(c)
    return F.size(content).between(1, 3) & F.forall(content, lambda t: t.rlike(r"\d"))


def is_greeting(c: Column) -> Column:
    toks = tokens(c)
    only_greetings = F.forall(toks, lambda t: t.isin(*V.GREETINGS))
    call_for_help = (F.forall(toks, lambda t: t.isin(*V.GREETINGS, *V.HELP_COMPANIONS))
                     & has_any(toks, V.HELP_WORDS))
    return F.size(toks).between(1, 3) & (only_greetings | call_for_help)


def is_out_of_scope(c: Column, vocabulary: V.Vocabulary) -> Column:
    """Names an off-topic term and nothing of the domain (substring tests)."""
    low = F.lower(c)

    def mentions(terms):
        return low.rlike("|".join(_literal(t) for t in terms))

    in_domain = (mentions(vocabulary.domain_terms) | low.rlike(r"\b\d{4,6}\b")
                 | is_reference_query(c))
    return mentions(V.OUT_OF_SCOPE_TERMS) & ~in_domain


def looks_french(c: Column) -> Column:
    return c.rlike(FRENCH_WORDS)


def looks_arabic(c: Column) -> Column:
    return c.rlike(r"[؀-ۿ]")


def french_to_english(c: Column) -> Column:
    for french, english in V.FRENCH_TO_ENGLISH:
        c = F.regexp_replace(c, "(?i)" + french, english)
    return c


def _literal(word: str) -> str:
    return "".join("\\" + ch if ch in r"\.^$|?*+()[]{}-" else ch for ch in word)


def mark_terms(text: Column, terms: Column) -> Column:
    """Wrap every occurrence of a term (over two characters) in ``<mark>``, longest first."""
    usable = F.array_distinct(F.filter(terms, lambda t: F.length(t) > 2))
    longest_first = F.transform(
        F.array_sort(F.transform(usable, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t")))),
        lambda s: F.regexp_replace(s["t"], r"([.*+?^${}()|\[\]\\])", r"\\$1"))
    pattern = F.concat(F.lit("(?i)("), F.array_join(longest_first, "|"), F.lit(")"))
    return F.when(F.size(usable) == 0, text).otherwise(
        F.regexp_replace(text, pattern, F.lit("<mark>$1</mark>")))


# ------------------------------------------------------------ full-text tokens
@lru_cache(maxsize=1)
def _fold_table() -> tuple[str, str]:
    """Accented Latin letters -> base letter; combining marks -> nothing.

    Derived from the Unicode decomposition rather than listed.
    """
    source, target = [], []
    for code in (*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)):
        letter = chr(code).lower()
        base = unicodedata.normalize("NFD", letter)
        if len(letter) == 1 and len(base) > 1 and base[0].isascii() and letter not in source:
            source.append(letter)
            target.append(base[0])
    source += [chr(code) for code in range(0x0300, 0x0370)]
    return "".join(source), "".join(target)


def fold(c: Column) -> Column:
    """Lower case without diacritics; plain ASCII text skips the letter mapping."""
    source, target = _fold_table()
    low = F.lower(c)
    return F.when(low.rlike(r"[^\x00-\x7F]"), F.translate(low, source, target)).otherwise(low)


def index_tokens(c: Column) -> Column:
    """Full-text tokens: lower case, no diacritics, runs of letters and digits."""
    return F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


# ------------------------------------------------------------- page text repair
_CLEAN, _NEUTRAL, _JUNK = "\u0001", "\u0002", "\u0003"


def _without_unprintable(c: Column) -> Column:
    """Unprintable characters -> blanks; plain ASCII text is recognised by cheap scans."""
    suspect = (c.rlike(r"[^\x00-\x7F]") | c.rlike(r"[\x00-\x08]") | c.rlike(r"[\x0E-\x1F]")
               | c.rlike(r"[\x0B\x0C\x7F]"))
    return F.when(suspect, F.regexp_replace(c, PRINTABLE_ONLY, " ")).otherwise(c)


def _without_garbled_runs(x: Column) -> Column:
    """Drop runs without a clean word that hold two or more junk words.

    Each word gets a one-character class mark; a run is then a single regular
    expression, so no per-word loop is needed.
    """
    caps, word = ACCENTED_CAPITALS, r"[^ \n]"
    solid = r"[0-9A-Za-zÀ-ɏ]"
    x = F.regexp_replace(x, rf"({word}+)", _NEUTRAL + "$1")
    x = F.regexp_replace(x, rf"{_NEUTRAL}({word}*[{caps}]{word}*)", _JUNK + "$1")
    x = F.regexp_replace(x, rf"{_JUNK}([{caps}][a-zà-ÿ'’\-]{{2,}})([ \n]|$)", _CLEAN + "$1$2")
    x = F.regexp_replace(
        x, rf"{_NEUTRAL}({solid}{word}{{2,}}|{word}{solid}{word}+|{word}{{2,}}{solid}{word}*)",
        _CLEAN + "$1")
    x = F.regexp_replace(
        x, rf"(?:{_NEUTRAL}[^{_CLEAN}{_JUNK}\n]*)?{_JUNK}[^{_CLEAN}{_JUNK}\n]*{_JUNK}[^{_CLEAN}\n]*", "")
    return F.regexp_replace(x, rf"[{_CLEAN}-{_JUNK}]", "")


def clean_text(c: Column) -> Column:
    """Remove unprintable glyphs and runs of mis-decoded words.

    Without an accented capital no word can be junk, so such text only has its
    blanks tidied.
    """
    def tidy(x):
        x = F.trim(F.regexp_replace(F.regexp_replace(x, " +", " "), " ?\n ?", "\n"))
        return F.regexp_replace(x, r"[ \t]{2,}", " ")

    return tidy(let(_without_unprintable(c), lambda x: F.when(
        x.rlike("[À-Þ]"), _without_garbled_runs(x)).otherwise(x)))


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip(c: Column) -> Column:
    """Trim every kind of white space, not only blanks."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def needs_ocr(raw: Column, cleaned: Column, min_chars: int = 250, max_loss: float = 0.15) -> Column:
    n_raw, n_clean = F.length(strip(raw)), F.length(strip(cleaned))
    lost = F.lit(1.0) - n_clean.cast("double") / F.greatest(n_raw, F.lit(1)).cast("double")
    return (n_clean < min_chars) | (lost > max_loss)


def snippet(text: Column, terms: Column, width: int = SNIPPET_CHARS) -> Column:
    """Window of the cleaned text that opens shortly before the first term."""
    def first_term(low):
        found = F.transform(terms, lambda t: F.position(t, low))
        return F.coalesce(F.array_min(F.filter(found, lambda p: p > 0)), F.lit(1))

    def window(body, start):
        text_window = F.trim(F.translate(F.substring(body, start + 1, F.lit(width)), "\n", " "))
        return F.concat(F.when(start > 0, F.lit("…")).otherwise(F.lit("")), text_window,
                        F.when(start + width < F.length(body), F.lit("…")).otherwise(F.lit("")))

    def whole(body):
        start = F.greatest(let(F.lower(body), first_term) - 1 - SNIPPET_LEAD, F.lit(0))
        return F.when(body == "", F.lit("")).otherwise(let(start, lambda s: window(body, s)))

    return let(strip(clean_text(F.regexp_replace(text, r"[ \t]+", " "))), whole)


def lines(text: Column) -> Column:
    return F.split(text, "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]")


def readable(c: Column) -> Column:
    """Mostly ordinary characters, and no majority of vowel-starved long words."""
    ordinary = F.when(c.rlike(r"[^\x00-\x7F]"), F.length(F.regexp_replace(
        c, rf"[^\x00-\x7F{READABLE_EXTRA}]", ""))).otherwise(F.length(c))

    def starved(word):
        vowels = F.length(F.regexp_replace(F.lower(word), rf"[^{VOWELS}]", ""))
        return vowels.cast("double") / F.length(word) < 0.25

    def pronounceable(words):
        return F.size(F.filter(words, starved)) * 2 <= F.size(words)

    return ((F.length(c) > 0)
            & (ordinary.cast("double") / F.greatest(F.length(c), F.lit(1)) > 0.85)
            & let(F.regexp_extract_all(c, F.lit(r"[A-Za-zÀ-ÿ]{6,}"), F.lit(0)), pronounceable))


def title_case(c: Column) -> Column:
    """Capital after every non-letter (unlike ``initcap``, which needs white space)."""
    pieces = F.regexp_extract_all(F.lower(c), F.lit(r"\p{L}+|\P{L}+"), F.lit(0))
    return F.array_join(
        F.transform(pieces, lambda p: F.concat(F.upper(F.substring(p, 1, 1)),
                                               F.substring(p, F.lit(2), F.length(p)))), "")


def heading_line(line: Column) -> Column:
    squeezed = F.regexp_replace(line, r"\s+", " ")
    return F.regexp_replace(squeezed, r"^[ :·\-]+|[ :·\-]+$", "")


def is_heading(line: Column, vocabulary: V.Vocabulary) -> Column:
    digits = F.length(F.regexp_replace(line, r"[^0-9]", ""))
    return (line.rlike(HEADING_PATTERN) & ~F.upper(line).isin(*vocabulary.heading_stop)
            & readable(line) & (digits * 2 <= F.length(line)))


def designation_group(c: Column) -> Column:
    """Family of a part name: text before the first bracket/colon, without numbers."""
    x = F.regexp_extract(c, r"^[^:(\[]*", 0)
    x = F.regexp_replace(x, MEASURE, " ")
    x = F.regexp_replace(x, r"[^A-Za-z /&'\-]+", " ")
    x = F.regexp_replace(F.regexp_replace(x, r"\s+", " "), r"^[ \-/&]+|[ \-/&]+$", "")
    return F.when(F.length(x).between(3, 34), title_case(x)).otherwise(F.lit(""))


def numbers_before(text: Column, unit: str) -> Column:
    """Integers written directly before a unit, e.g. ``90 kg``."""
    return F.transform(F.regexp_extract_all(text, F.lit(rf"(?i)(\d+)\s*{unit}"), F.lit(1)),
                       lambda n: n.try_cast("bigint"))


def suggestion_lines(reply: Column) -> Column:
    """Usable option lines of a free-text reply: bullets, numbers and quotes removed."""
    def tidy(line):
        x = strip(F.regexp_replace(strip(line), r"^[-*•·]+", ""))
        x = strip(F.regexp_replace(x, r"^\d[.)]", ""))
        return strip(F.regexp_replace(x, r'^"+|"+$', ""))

    tidied = F.transform(lines(reply), tidy)
    kept = F.filter(tidied, lambda s: F.length(s).between(5, 90) & ~s.endswith(":"))
    return F.slice(kept, 1, 6)


# ------------------------------------------------------------------ file names
def sanitize(c: Column) -> Column:
    stem = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._\-]+", "_"), r"^_+|_+$", "")
    return F.when(stem == "", F.lit("doc")).otherwise(stem)


def file_stem(filename: Column) -> Column:
    """Path without its last suffix, flattened into one safe name."""
    return sanitize(F.regexp_replace(F.regexp_replace(filename, r"\.[^.]*$", ""), "/", "_"))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def page_image(filename: Column, page_num: Column, suffix: str = "") -> Column:
    return F.concat(F.lit("pages/"), file_stem(filename), F.lit("/p"),
                    F.format_string("%03d", page_num), F.lit(f"{suffix}.png"))


def system_of_file(folder: Column, filename: Column, vocabulary: V.Vocabulary) -> Column:
    """Folder decides, then file name, then the folder itself, then GENERAL."""
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for place in (folder, filename):
        for system, pattern in vocabulary.system_patterns.items():
            chain = chain.when(place.rlike("(?i)" + pattern), F.lit(system))
    return F.coalesce(chain, F.nullif(F.upper(folder), F.lit("")), F.lit("GENERAL"))


def kind_of_file(filename: Column) -> Column:
    low = F.lower(filename)
    return (F.when(low.rlike(r"^d\d{3,5}"), F.lit("fabrication drawing"))
            .when(low.rlike("doutil|tool"), F.lit("technical catalogue"))
            .otherwise(F.lit("product brochure")))


def highlight_terms(base: Column, expanded: Column, ref: Column | None = None,
                    designation: Column | None = None) -> Column:
    """Exact reference, its designation words, the question words, then synonyms.

    Over two characters, unique without regard to case, first spelling kept.
    """
    parts = []
    if ref is not None:
        parts.append(F.array_compact(F.array(F.nullif(ref, F.lit("")))))
    if designation is not None:
        words = F.when(ref.isNotNull() & (ref != ""), content_tokens(blank_to_empty(designation)))
        parts.append(F.coalesce(words, F.array().cast("array<string>")))
    parts += [base, expanded]
    usable = F.filter(F.concat(*parts), lambda t: F.length(t) > 2)
    lowered = F.transform(usable, lambda t: F.lower(t))
    return F.filter(usable, lambda t, i: F.array_position(lowered, F.lower(t)) == i + 1)


# ------------------------------------------------------------------------ keys
def cache_key(question: Column, signature: Column) -> Column:
    return F.sha2(F.concat(F.lower(strip(question)), F.lit("|"), signature), 256)


def image_key(engine: Column, sha1: Column) -> Column:
    return F.concat_ws(":", engine, sha1)
