"""Reference codes: normal form, candidates in free text, positional patterns."""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from plansift import vocab as V
from plansift.functions import text as T

# fixed values: what a reference looks like
PAGE_REFERENCE = r"\b[A-Z]{0,3}\d{1,3}[A-Z0-9]*(?:[-/.][A-Z0-9]+)*\b"
QUESTION_REFERENCE = r"[A-Z0-9]+(?:[.\-/][A-Z0-9]+)*"
TYPED_REFERENCE = r"[A-Za-z0-9][A-Za-z0-9./-]{1,}"
FRAGMENT = r"[A-Za-z0-9][A-Za-z0-9./-]*"

# fixed values: the ways a position inside a reference is worded
_VALUE = r"[\"'`]?([A-Za-z0-9][A-Za-z0-9./-]*)"
_SUFFIX_VERBS = (r"ending|ends|ended|endings|end|finishing|finishes|finished|finish"
                 r"|terminating|terminates|terminated|terminate|termin\w+"
                 r"|finiss\w+|finit|suffixed|suffix")
_PREFIX_VERBS = (r"starting|starts|started|start|beginning|begins|began|begin"
                 r"|prefixed|prefix|commen[cç]\w+|d[eé]but\w+")
_CONTAIN_VERBS = (r"containing|contains|contain|including|includes|include"
                  r"|contenant|contient|comport\w+")
_UNITS = r"(?:digits?|characters?|chars?|numbers?|figures?|chiffres?)"
PATTERN_GRAMMAR: dict[str, tuple[str, ...]] = {
    "suffix": (
        rf"\b(?:{_SUFFIX_VERBS})\b\s*(?:with|in|by|on|par|en|avec)?\s*" + _VALUE,
        _VALUE + r"\s+(?:at|in|to)\s+the\s+end\b",
        _VALUE + r"\s+(?:[aà]\s+la\s+fin)\b",
        rf"\b(?:last|final|dernier[se]?|derni[eè]res?)\s+(?:\d+\s+)?{_UNITS}\s*"
        r"(?:are|is|=|:)?\s*" + _VALUE,
    ),
    "prefix": (
        rf"\b(?:{_PREFIX_VERBS})\b\s*(?:with|by|par|en|avec)?\s*" + _VALUE,
        _VALUE + r"\s+(?:at|in)\s+the\s+(?:start|beginning|front)\b",
        _VALUE + r"\s+(?:au\s+d[eé]but)\b",
        rf"\b(?:first|leading|premier[se]?|premi[eè]res?)\s+(?:\d+\s+)?{_UNITS}\s*"
        r"(?:are|is|=|:)?\s*" + _VALUE,
    ),
    "contains": (
        rf"\b(?:{_CONTAIN_VERBS})\b\s*(?:the\s+)?(?:digits?|numbers?|characters?|chiffres?)?\s*"
        + _VALUE,
        _VALUE + r"\s+(?:in|somewhere\s+in)\s+the\s+middle\b",
        _VALUE + r"\s+anywhere\s+in\b",
    ),
}
_MODE_WORDS = {"suffix": ("ends with", "end with"), "prefix": ("starts with", "start with"),
               "contains": ("contains", "contain")}
_NOUN_PLURALS = {"reference": "references", "profile": "profiles",
                 "accessory": "accessories", "part": "parts"}
MAX_FRAGMENT = 12


def norm_ref(c: Column) -> Column:
    """Comparison key: upper case without blanks, dots, slashes and dashes."""
    return F.regexp_replace(F.upper(c), r"[\s./\-]", "")


def has_digit(c: Column) -> Column:
    return c.rlike(r"\d")


def typed_refs(question: Column) -> Column:
    """Normal forms of everything in a question that could be a reference."""
    return F.array_distinct(F.transform(
        F.regexp_extract_all(question, F.lit(TYPED_REFERENCE), F.lit(0)), norm_ref))


def page_ref_candidates(text: Column) -> Column:
    """Reference-shaped words of a page, normalised and distinct.

    A page range ("pages 50-51") is not a reference: a digits-dash-digits word
    is dropped when PAGES stands within 30 characters of its first occurrence.
    """
    def of_page(upper):
        words = F.array_distinct(F.regexp_extract_all(upper, F.lit(PAGE_REFERENCE), F.lit(0)))

        def page_range(word):
            at = F.position(word, upper)
            begin = F.greatest(at - 30, F.lit(1))
            around = F.substring(upper, begin, at + 30 - begin)
            return word.rlike(r"^\d+-\d+$") & F.contains(around, F.lit("PAGES"))

        kept = F.filter(words, lambda w: (F.length(norm_ref(w)) >= 2) & ~page_range(w))
        return F.array_distinct(F.transform(kept, norm_ref))

    # no digit, no reference: most pages stop here
    return F.when(text.rlike("[0-9]"), T.let(F.upper(text), of_page)).otherwise(
        F.array().cast("array<string>"))


def question_ref_candidates(question: Column) -> Column:
    """Reference candidates of a question, longest first then alphabetical.

    Single words holding a digit, plus neighbouring number/letter pairs written
    apart ("140 R", "RIV 5IN").
    """
    upper = F.upper(question)
    single = F.filter(
        F.transform(F.regexp_extract_all(upper, F.lit(QUESTION_REFERENCE), F.lit(0)),
                    lambda t: F.regexp_replace(t, r"^[.\-/ ]+|[.\-/ ]+$", "")),
        lambda t: (F.length(t) >= 2) & has_digit(t))
    words = F.transform(F.split(T.strip(upper), r"\s+"),
                        lambda w: F.regexp_replace(w, r"^[.,!?;:]+|[.,!?;:]+$", ""))
    n = F.size(words)

    def joined(a, b):
        number_then_letters = a.rlike(r"^\d+$") & b.rlike(r"^\p{L}{1,3}$")
        letters_then_number = a.rlike(r"^\p{L}{2,4}$") & b.rlike(r"^\d.{0,3}$")
        return F.when(number_then_letters | letters_then_number, F.concat(a, b))

    pairs = F.when(n > 1, F.array_compact(F.zip_with(
        F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), joined)))
    found = F.array_distinct(F.concat(single, F.coalesce(pairs, F.array().cast("array<string>"))))
    ranked = F.array_sort(F.transform(
        found, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return F.transform(ranked, lambda s: s["t"])


# -------------------------------------------------------------------- patterns
def _last_fragment(question: Column, pattern: str) -> Column:
    """Normalised fragment of the last place the wording occurs, when usable."""
    found = F.regexp_extract_all(question, F.lit("(?iU)" + pattern), F.lit(1))
    return T.let(norm_ref(F.try_element_at(found, F.lit(-1))), lambda fragment: F.when(
        F.length(fragment).between(1, MAX_FRAGMENT)
        & ~F.lower(fragment).isin(*V.PATTERN_STOP_WORDS)
        & (has_digit(fragment) | (F.length(fragment) <= 3)), fragment))


def pattern_kinds(question: Column) -> Column:
    toks = T.tokens(question)
    named = [F.when(T.has_any(toks, words), F.lit(kind))
             for kind, words in V.PATTERN_KIND_WORDS.items()]
    return F.array_compact(F.array(*named))


def _fragments(question: Column, vocabulary: V.Vocabulary) -> Column:
    keys = F.transform(F.regexp_extract_all(question, F.lit(FRAGMENT), F.lit(0)), norm_ref)
    codes = tuple(c.upper() for c in vocabulary.system_codes) or ("",)
    return F.array_distinct(F.filter(
        keys, lambda k: (F.length(k) >= 3) & has_digit(k) & ~k.isin(*codes)
        & ~F.lower(k).isin(*V.PATTERN_STOP_WORDS)))


def ref_pattern(question: Column, vocabulary: V.Vocabulary) -> Column:
    """``struct(mode, value, kinds, kind, implicit)`` or null.

    A worded position wins (suffix, then prefix, then contains); otherwise a
    reference noun with exactly one code-like fragment means *contains*.  Such an
    implicit fragment still has to be checked against the known references.
    """
    readings = F.array(*[
        F.struct(F.lit(mode).alias("mode"), _last_fragment(question, wording).alias("value"),
                 F.lit(False).alias("implicit"))
        for mode, wordings in PATTERN_GRAMMAR.items() for wording in wordings])
    fragment = T.let(_fragments(question, vocabulary), lambda found: F.when(
        F.size(found) == 1, F.element_at(found, 1)))
    guess = F.struct(F.lit("contains").alias("mode"), F.when(
        T.has_any(T.tokens(question), V.REFERENCE_NOUNS), fragment).alias("value"),
        F.lit(True).alias("implicit"))

    def described(reading):
        return F.when(reading.isNotNull(), T.let(pattern_kinds(question), lambda kinds: F.struct(
            reading["mode"].alias("mode"), reading["value"].alias("value"), kinds.alias("kinds"),
            F.when(F.size(kinds) == 1, F.element_at(kinds, 1)).alias("kind"),
            reading["implicit"].alias("implicit"))))

    usable = F.filter(F.concat(readings, F.array(guess)), lambda r: r["value"].isNotNull())
    return T.let(F.try_element_at(usable, F.lit(1)), described)


def matches_position(key: Column, mode: Column, value: Column) -> Column:
    return (((mode == "suffix") & F.endswith(key, value))
            | ((mode == "prefix") & F.startswith(key, value))
            | ((mode == "contains") & F.contains(key, value)))


def describe_pattern(mode: Column, value: Column, kinds: Column, total: Column,
                     shown: Column) -> Column:
    both = F.size(kinds) > 1
    noun = F.when(both, F.lit("reference")).otherwise(
        F.coalesce(F.try_element_at(kinds, F.lit(1)), F.lit("reference")))
    plural = F.when(both, F.lit("profile and accessory references"))
    for one, many in _NOUN_PLURALS.items():
        plural = plural.when(noun == one, F.lit(many))
    plural = plural.otherwise(F.concat(noun, F.lit("s")))

    def phrase(index):
        chain = F.when(F.lit(False), F.lit(""))
        for m, words in _MODE_WORDS.items():
            chain = chain.when(mode == m, F.lit(words[index]))
        return chain

    quoted = F.concat(F.lit(" `"), value, F.lit("`"))
    head = F.concat(F.lit("**"), total.cast("string"), F.lit("** "), plural, F.lit(" "),
                    phrase(1), quoted)
    return (F.when(total == 0, F.concat(F.lit("No "), noun,
                                        F.lit(" in the profiles & accessories workbook "),
                                        phrase(0), quoted, F.lit(".")))
            .when(total == 1, F.concat(F.lit("One "), noun, F.lit(" "), phrase(0), quoted, F.lit(":")))
            .when(shown < total, F.concat(head, F.lit(" — showing the first "),
                                          shown.cast("string"), F.lit(":")))
            .otherwise(F.concat(head, F.lit(":"))))


def standalone(key: Column) -> Column:
    """Regular expression for a reference that is not part of a longer word."""
    quoted = F.regexp_replace(key, r"([.*+?^${}()|\[\]\\\-/])", r"\\$1")
    return F.concat(F.lit("(?i)(?<![A-Za-z0-9])"), quoted, F.lit("(?![A-Za-z0-9])"))
