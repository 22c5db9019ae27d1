import re

import pytest
from hypothesis import HealthCheck, given, settings, strategies as st
from pyspark.sql import functions as F

from plansift.functions import text as T
from plansift.vocab import Vocabulary

VOCAB = Vocabulary(system_aliases={"ALPHA 70TH": ("alpha", "70th"), "BETA 32TH": ("beta 32", "32th")},
                   system_words=("alpha", "beta"), system_codes=("70TH", "32TH"))


def test_tokens_keep_known_quirks(evaluate):
    got = evaluate(T.tokens, ["Glazing bead, 70TH!", "poignée", "ما هو 5051؟", "a b c"])
    assert got == [["glazing", "bead", "70th"], ["poign"], ["ما", "هو", "5051؟"], []]


def test_search_words_fall_back_to_every_token(evaluate):
    assert evaluate(T.search_words, ["the door", "what is this"]) == [["door"], ["what", "is", "this"]]


@pytest.mark.parametrize("word, forms", [
    ("accessories", ["accessories", "accessory"]), ("ties", ["ties", "tie"]), ("boxes", ["boxes", "box"]),
    ("doors", ["doors", "door"]), ("glass", ["glass"]), ("bus", ["bus"]), ("sashes", ["sashes", "sash"])])
def test_variants(evaluate, word, forms):
    assert evaluate(T.variants, [word]) == [forms]


def test_expand_reaches_the_other_language(evaluate):
    [got] = evaluate(lambda c: T.expand(T.content_tokens(c), VOCAB), ["doors"])
    assert got[:2] == ["doors", "door"] and "porte" in got and len(got) == len(set(got))


def test_subject_and_system_words_are_separated(evaluate):
    words = "doors beta 32th"
    assert evaluate(lambda c: T.subject_words(T.content_tokens(c), VOCAB), [words]) == [["doors"]]
    assert evaluate(lambda c: T.system_words(T.content_tokens(c), VOCAB), [words]) == [["beta", "32th"]]


def test_counts(evaluate):
    texts = ["show me 3 images", "5 results please", "2 pages and 12 drawings", "none"]
    assert evaluate(T.images_asked, texts) == [3, None, 12, None]
    assert evaluate(T.pages_asked, texts) == [None, 5, 2, None]


def test_system_named_takes_the_first_alias(evaluate):
    assert evaluate(lambda c: T.system_named(c, VOCAB), ["Beta-32 and alpha", "beta 32", "gamma"]) == [
        "ALPHA 70TH", "BETA 32TH", None]


def test_reference_queries(evaluate):
    texts = ["10x2", "410031", "70TH", "glazing bead", "thermal break", "", "1a 2b 3c 4d"]
    assert evaluate(T.is_reference_query, texts) == [True, True, True, False, False, False, False]


def test_greetings(evaluate):
    texts = ["hi", "bonjour", "help me", "hello thanks ok bye", "me you", "hinge"]
    assert evaluate(T.is_greeting, texts) == [True, True, True, False, False, False]


def test_out_of_scope_is_a_substring_test(evaluate):
    texts = ["a cake recipe", "party cake", "weather 12345", "door weather", "hello"]
    assert evaluate(lambda c: T.is_out_of_scope(c, VOCAB), texts) == [True, False, False, False, False]


# ------------------------------------------------------------------ clean_text
CAPS = T.ACCENTED_CAPITALS


def brute_clean(text):
    """Word-by-word statement of the rule, independent of the regular expressions."""
    allowed = [(9, 10), (13, 13), (0x20, 0x7E), (0xA0, 0x24F), (0x2010, 0x203A), (0x20AC, 0x20AC)]
    text = "".join(ch if any(a <= ord(ch) <= b for a, b in allowed) else "\0" for ch in text)
    text = re.sub("\0+", " ", text)

    def kind(word):
        if any(ch in CAPS for ch in word):
            good = len(word) >= 3 and re.fullmatch(f"[{CAPS}]?[a-zà-ÿ'’-]+", word)
            return "clean" if good else "junk"
        solid = re.search("[0-9A-Za-zÀ-ɏ]", word)
        return "clean" if len(word) > 2 and solid else "neutral"

    out = []
    for line in text.split("\n"):
        words, kept, run = [w for w in line.split(" ") if w], [], []
        for word in words + [None]:
            if word is None or kind(word) == "clean":
                if sum(kind(w) == "junk" for w in run) < 2:
                    kept += run
                run = []
                if word is not None:
                    kept.append(word)
            else:
                run.append(word)
        out.append(" ".join(kept))
    return re.sub("[ \t]{2,}", " ", "\n".join(out))


WORDS = st.sampled_from(["track", "Épaisseur", "Ü", "ÌÀ>V", "ÓÀ", "a", "--", "12", "wide", "é", "Éc", "\x07", "x",
                         "É.", "of", " ", "\n", "\t", "‘x’", "€", "ÀÉÎ"])


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(WORDS, max_size=14).map(" ".join), min_size=1, max_size=12))
def test_clean_text_equals_the_word_by_word_rule(evaluate, texts):
    got = evaluate(T.clean_text, texts)
    # outer blanks of the whole text are trimmed, which every caller does anyway
    assert [g.strip() for g in got] == [brute_clean(t).strip() for t in texts]


def test_clean_text_drops_garbled_runs_only(evaluate):
    texts = ["a wide choice > Ü `i V Ó À Î Ì>V of profiles", "Épaisseur É mm", "plain   text"]
    assert evaluate(T.clean_text, texts) == ["a wide choice profiles", "Épaisseur É mm", "plain text"]


def test_snippet_window(evaluate):
    text = "x" * 200 + " hinge " + "y" * 600
    [got] = evaluate(lambda c: T.snippet(c, F.array(F.lit("hinge"))), [text])
    assert got.startswith("…") and got.endswith("…") and "hinge" in got and len(got) <= 422
    assert evaluate(lambda c: T.snippet(c, F.array(F.lit("zzz"))), ["short\ntext", "  "]) == ["short text", ""]


def test_needs_ocr(evaluate):
    long_text = "word " * 100
    assert evaluate(lambda c: T.needs_ocr(c, T.clean_text(c)), ["tiny", long_text]) == [True, False]
    damaged = "word " * 60 + "Ü Ó " * 60
    assert evaluate(lambda c: T.needs_ocr(c, T.clean_text(c)), [damaged]) == [True]


def test_readable(evaluate):
    texts = ["Sliding frames", "Xvlqdjh Xvlqdjh", "screw and track profiles", "", ""]
    assert evaluate(T.readable, texts) == [True, False, True, False, False]


def test_headings(evaluate):
    texts = ["  SINGLE   TRACK : ", "PARTS LIST", "12 34 56 78", "ABC", "Opening frames"]
    lines = evaluate(T.heading_line, texts)
    assert lines[0] == "SINGLE TRACK"
    assert evaluate(lambda c: T.is_heading(T.heading_line(c), VOCAB), texts) == [True, False, False, False, False]


def test_designation_groups(evaluate):
    texts = ["BROOM SEAL: 7.2-4P-HF-1000", "O'RING 12 mm [x]", "12mm", "JOINT (EPDM)"]
    assert evaluate(T.designation_group, texts) == ["Broom Seal", "O'Ring", "", "Joint"]


def test_numbers_before_a_unit(evaluate):
    text = "Leaf 120 kg\n110 KG\n90kg and 80 mm"
    assert evaluate(lambda c: T.numbers_before(c, "kg"), [text]) == [[120, 110, 90]]


def test_suggestion_lines(evaluate):
    reply = "Options:\n- Glazing beads\n2. \"Broom seals\"\n* ok\n• Threshold sections\n"
    assert evaluate(T.suggestion_lines, [reply]) == [["Glazing beads", "Broom seals", "Threshold sections"]]


def test_page_paths(evaluate):
    got = evaluate(lambda c: T.page_image(c, F.lit(7)), ["Range A/Doc 1.pdf", "x.pdf", "!!.pdf"])
    assert got == ["pages/Range_A_Doc_1/p007.png", "pages/x/p007.png", "pages/doc/p007.png"]
    assert evaluate(lambda c: T.page_image(c, F.lit(1234)), ["x.pdf"]) == ["pages/x/p1234.png"]


def test_file_kinds(evaluate):
    assert evaluate(T.kind_of_file, ["D9100.pdf", "x_doutil.pdf", "intro.pdf", "d12.pdf"]) == [
        "fabrication drawing", "technical catalogue", "product brochure", "product brochure"]


def test_highlight_terms(evaluate):
    [got] = evaluate(lambda c: T.highlight_terms(
        T.content_tokens(c), T.expand(T.content_tokens(c), VOCAB), F.lit("10X2-T"), F.lit("The Hinge ab")), ["hinge door"])
    assert got[:3] == ["10X2-T", "hinge", "door"] and "porte" in got and got.count("hinge") == 1


def test_marking(evaluate):
    terms = F.array(F.lit("bead"), F.lit("glazing bead"), F.lit("a"))
    assert evaluate(lambda c: T.mark_terms(c, terms), ["Glazing bead bead"]) == [
        "<mark>Glazing bead</mark> <mark>bead</mark>"]


def test_translation_and_languages(evaluate):
    assert evaluate(T.french_to_english, ["Joint  brosse et poignée"]) == ["brush seal et handle"]
    assert evaluate(T.looks_french, ["le joint", "the seal"]) == [True, False]
    assert evaluate(T.looks_arabic, ["باب", "door"]) == [True, False]


def test_index_tokens_fold_accents(evaluate):
    assert evaluate(T.index_tokens, ["Élève-à l'été, 10x2", "ß ñandú"]) == [
        ["eleve", "a", "l", "ete", "10x2"], ["ß", "nandu"]]
