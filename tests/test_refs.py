import pytest
from pyspark.sql import functions as F

from plansift.functions import refs as R
from plansift.operators import parts as P
from plansift.vocab import Vocabulary

VOCAB = Vocabulary(system_aliases={"BETA 70TH": ("70th",)}, system_codes=("70TH", "32TH", "45TH", "26TH", "70", "32", "45", "26"))

PHRASINGS = [
    ("Do we stock a profile ending with 88?", "suffix", "88", ["profile"]),
    ("accessories ending 7204", "suffix", "7204", ["accessory"]),
    ("which references have 56 at the end", "suffix", "56", []),
    ("profiles with the last digits 19", "suffix", "19", ["profile"]),
    ("parts whose number starts with 77", "prefix", "77", []),
    ("accessories beginning with K2", "prefix", "K2", ["accessory"]),
    ("profiles with 62 at the start", "prefix", "62", ["profile"]),
    ("every reference containing 905", "contains", "905", []),
    ("anything with 317 in the middle of the reference", "contains", "317", []),
    ("profils finissant par 44", "suffix", "44", ["profile"]),
    ("accessoires commençant par 12", "prefix", "12", ["accessory"]),
    ("profiles and accessories ending in 26", "suffix", "26", ["accessory", "profile"]),
]
NOT_PATTERNS = ["rubber seal for the lower frame", "good morning", "4 pictures of a hinge", "a window with 5 panes", "3x7",
                "how is water led off the sill"]


def parsed(evaluate, texts):
    return evaluate(lambda c: R.ref_pattern(c, VOCAB), texts)


def test_phrasings(evaluate):
    got = parsed(evaluate, [p[0] for p in PHRASINGS])
    for (text, mode, value, kinds), p in zip(PHRASINGS, got):
        assert p is not None and (p["mode"], p["value"]) == (mode, value), text
        if kinds is not None:
            assert p["kinds"] == kinds, text
            assert p["kind"] == (kinds[0] if len(kinds) == 1 else None)


def test_plain_questions_are_no_patterns(evaluate):
    assert parsed(evaluate, NOT_PATTERNS) == [None] * len(NOT_PATTERNS)


@pytest.fixture(scope="module")
def library(table):
    parts = table("part_id long, ref string, ref_norm string, kind string, supplier_ref string, designation string", [
        (1, "10X2-T", "10X2T", "profile", "", "GLAZING BEAD"),
        (2, "5031", "5031", "profile", "S1", "SEAL HOLDER"),
        (3, "5031", "5031", "accessory", "", "PORTE JOINT"),
        (4, "410031", "410031", "accessory", "", "BROOM SEAL 32TH"),
        (5, "150001", "150001", "part", "", ""),
        (6, "5031", "5031", "part", "", "Seal-Holder"),
        (7, "140R", "140R", "part", "", "RIVET"),
    ])
    photos = table("image_id long, ref string, ref_norm string, filename string", [
        (9, "5031", "5031", "b.jpg"), (8, "5031", "5031", "a.jpg"), (10, "99031", "99031", "c.jpg")])
    return parts, photos


def test_implicit_fragment_gives_way_to_a_real_reference(table, library):
    questions = table("qid int, question string", [(1, "profile 5031"), (2, "profile 031"), (3, "ends with 5031")])
    got = {r.qid: r.value for r in P.read_patterns(questions, *library, VOCAB).collect()}
    assert got == {2: "031", 3: "5031"}


def test_positions_are_not_substrings(table, library):
    patterns = table("qid int, mode string, value string, kind string", [
        (1, "suffix", "031", None), (2, "prefix", "41", None), (3, "contains", "000", None), (4, "suffix", "031", "profile"),
        (5, "suffix", "zz", None)])
    shown, totals = P.refs_matching(patterns, *library)
    rows = {}
    for r in sorted(shown.collect(), key=lambda r: (r.qid, r.rank)):
        rows.setdefault(r.qid, []).append((r.ref, r.kind, r.designation, r.photo))
    assert rows[1] == [("5031", "profile", "SEAL HOLDER · PORTE JOINT", "/refmedia/a.jpg"),
                       ("410031", "accessory", "BROOM SEAL 32TH", None), ("99031", "photo only", "", "/refmedia/c.jpg")]
    assert [r[0] for r in rows[2]] == ["410031"] and [r[0] for r in rows[3]] == ["150001"]
    assert [r[0] for r in rows[4]] == ["5031"]
    assert {r.qid: r.total for r in totals.collect()} == {1: 3, 2: 1, 3: 1, 4: 1, 5: 0}


def test_a_listing_starts_with_the_name_of_the_row_that_matched(table, library):
    patterns = table("qid int, mode string, value string, kind string", [(1, "suffix", "5031", "accessory")])
    shown, _ = P.refs_matching(patterns, *library)
    assert [(r.kind, r.designation) for r in shown.collect()] == [("accessory", "PORTE JOINT · SEAL HOLDER")]


def test_fuzzy_takes_large_question_ids(table, library):
    needles = table("qid long, needle string", [(3_000_000_000, "glazin bead")])
    assert {r.qid for r in P.fuzzy_parts(needles, library[0]).collect()} == {3_000_000_000}


def test_pages_beyond_many_contents_pages_are_found(table, library):
    pages = table("page_id long, doc_id string, page_num int, text string, ocr_text string",
                  [(i, "a", i, "Contents 5031", "") for i in range(1, 61)] + [(99, "b", 1, "Fit part 5031 " + "to the frame " * 20, "")])
    wanted = table("qid int, ref string, ref_norm string", [(1, "5031", "5031")])
    found = P.pages_using_ref(wanted, pages, P.known_refs(*library), VOCAB, 2).collect()
    assert [r.page_id for r in found] == [99]


def test_relevant_parts_beyond_many_others(table):
    parts = table("part_id long, ref string, ref_norm string, kind string, supplier_ref string, designation string",
                  [(i, f"R{i}", f"R{i}", "part", "", "BROOM 32TH") for i in range(200)] + [(999, "Z", "Z", "part", "", "BROOM of 26TH make, long name")])
    vocabulary = Vocabulary(system_aliases={"A 26TH": ("26th",)})
    asked = P.part_subject(table("qid int, question string", [(1, "broom 26th")]), vocabulary)
    assert [r.part_id for r in P.relevant_parts(asked, parts, vocabulary).collect()] == [999]


def test_near_misses(table, library):
    typed = table("qid int, key string", [(1, "10X2"), (2, "AB"), (3, "SEAL"), (4, "503"), (5, "990")])
    got = {}
    for r in sorted(P.near_misses(typed, *library).collect(), key=lambda r: (r.qid, r.rank)):
        got.setdefault(r.qid, []).append((r.ref, r.kind))
    assert got == {1: [("10X2-T", "profile")], 4: [("5031", "profile"), ("5031", "accessory"), ("5031", "part")],
                   5: [("99031", "part")]}


def test_lookup_prefers_the_parts_list(table, library):
    wanted = table("ref_norm string", [("5031",), ("99031",), ("nope",), ("",)])
    got = {r.ref_norm: (r.kind, r.designation, r.photo) for r in P.lookup_parts(wanted, *library).collect()}
    assert got == {"5031": ("profile", "SEAL HOLDER", "/refmedia/a.jpg"), "99031": ("part", "", "/refmedia/c.jpg")}


def test_reference_in_a_question(table, library):
    questions = table("qid int, question string", [
        (1, "what is 5031 for? not 410031"), (2, "rivet 140 R please"), (3, "sliding door"), (4, "use 10x2-t."), (5, "77")])
    got = {r.qid: r.ref_norm for r in P.refs_in_question(questions, *library).collect()}
    assert got == {1: "410031", 2: "140R", 4: "10X2T"}


def test_page_ranges_are_not_references(evaluate):
    texts = ["See pages 50-51 and profile L1502", "code 50-51 here", "PAGES far away " + "x" * 40 + " 50-51", "none"]
    got = [sorted(x) for x in evaluate(R.page_ref_candidates, texts)]
    assert got == [["L1502"], ["5051"], ["5051"], []]


def test_sentences(evaluate):
    def say(total, shown, kinds):
        return lambda c: R.describe_pattern(F.lit("suffix"), c, F.array(*[F.lit(k) for k in kinds]).cast("array<string>"),
                                            F.lit(total), F.lit(shown))
    assert evaluate(say(86, 24, ["accessory"]), ["N"]) == ["**86** accessories end with `N` — showing the first 24:"]
    assert evaluate(say(0, 0, []), ["N"]) == ["No reference in the profiles & accessories workbook ends with `N`."]
    assert evaluate(say(1, 1, ["profile"]), ["N"]) == ["One profile ends with `N`:"]
    assert evaluate(say(2, 2, ["accessory", "profile"]), ["N"]) == ["**2** profile and accessory references end with `N`:"]


def test_category_words_alone_find_no_parts(table, library):
    questions = table("qid int, question string", [(1, "sliding doors"), (2, "broom seal"), (3, "70th"), (4, "rivvet 70th")])
    rows = P.find_parts(questions, *library, VOCAB).collect()
    found = {r.qid: r.ref for r in rows if r["rank"] == 1}
    assert 1 not in found and 3 not in found and found[2] == "410031" and found[4] == "140R"


def test_another_system_number_rules_a_part_out(table, library):
    parts, _ = library
    vocabulary = Vocabulary(system_aliases={"A 26TH": ("26th",), "B 32TH": ("32th",)})
    questions = table("qid int, question string", [(1, "broom seal 26th"), (2, "broom seal 32th")])
    asked = P.part_subject(questions, vocabulary)
    rows = {(r.qid, r.part_id): r.relevance for r in P.relevant_parts(asked, parts, vocabulary).collect()}
    assert (1, 4) not in rows and rows[(2, 4)] == pytest.approx(2 / 2 + 0.5 * 2 + 1.5)


# ------------------------------------------------------------------------- fuzzy
def brute_lcs(a, b):
    grid = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            grid[i + 1][j + 1] = grid[i][j] + 1 if x == y else max(grid[i][j + 1], grid[i + 1][j])
    return grid[-1][-1]


@pytest.mark.parametrize("a, b", [("broom seal", "brom seel"), ("", "x"), ("aaaa", "aa"), ("abcdef", "fedcba"),
                                  ("joint coulissant" * 6, "porte joint" * 9)])
def test_longest_common_subsequence(a, b):
    assert P._lcs(a, b) == brute_lcs(a, b)


def test_token_set_ratio():
    assert P.token_set_ratio("broom seal", "seal broom 12mm") == 100.0
    assert P.token_set_ratio("", "x") == 0.0
    assert P.token_set_ratio("smal ring", "small ring") == pytest.approx(200 * 9 / 19)
    assert P.token_set_ratio("abc", "xyz") == 0.0


def test_fuzzy_parts_equal_brute_force(table, library):
    parts, _ = library
    needles = table("qid int, needle string", [(1, "brom seel"), (2, "glazin bead"), (3, "qqqq")])
    got = {(r.qid, r.part_id): r.similarity for r in P.fuzzy_parts(needles, parts).collect()}
    want = {}
    for n in needles.collect():
        for p in parts.collect():
            score = P.token_set_ratio(n.needle, p.designation.lower()) if p.designation else 0
            if score >= 72:
                want[(n.qid, p.part_id)] = score
    assert got == pytest.approx(want)


def brute_hits(patterns, refs):
    fits = {"prefix": str.startswith, "suffix": str.endswith, "contains": str.__contains__}
    return sorted((q, r) for q, mode, value in patterns for r in refs if fits[mode](r, value))


def test_affixes_meet_by_equality(spark, table):
    import itertools

    from plansift.operators import affix

    refs = ["", "A", "031", "10310", "5031", "ABAB", "É1É", "A1" * 40] + ["".join(x) for x in itertools.product("01A", repeat=5)]
    values = ["0", "01", "A1A", "0A01", "A1A1A", "É", "", "A1" * 40, "NOPE", "031"]
    patterns = [(i, mode, v) for i, (mode, v) in enumerate(itertools.product(("prefix", "suffix", "contains"), values))]
    rows = table("qid int, mode string, value string, kind string", [(*p, None) for p in patterns])
    keyed = table("ref_norm string, part_id long", [(r, i) for i, r in enumerate(refs)])
    made = affix.position_hits(rows, keyed)
    assert sorted((r.qid, r.ref_norm) for r in made.collect()) == brute_hits(patterns, refs)
    index = affix.affix_index(keyed)
    filled = [p for p in patterns if p[2]]
    stored = affix.position_hits(rows.filter("value <> ''"), keyed, index)
    assert sorted((r.qid, r.ref_norm) for r in stored.collect()) == brute_hits(filled, refs)
    kept, affix.pinned = affix.pinned, lambda df, label: (df, None)  # as if the patterns were many
    try:
        assert sorted((r.qid, r.ref_norm) for r in affix.position_hits(rows, keyed).collect()) == brute_hits(patterns, refs)
    finally:
        affix.pinned = kept
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "(affix#" in plan


def test_rows_without_a_key_are_left_out_before_keys_are_made(spark, table):
    from pyspark.sql import functions as F

    from plansift.operators import affix

    refs = [f"{i}" for i in range(3000)] + ["", None, "0T1", "É1"]
    patterns = [(1, "suffix", "31"), (2, "prefix", "14"), (3, "contains", "0T"), (4, "suffix", "7"), (5, "prefix", "É")]
    keyed = table("ref_norm string, part_id long", [(r, i) for i, r in enumerate(refs)])
    few = [(mode, affix.MODES[mode] + value, len(value)) for _, mode, value in patterns]
    want = brute_hits(patterns, [r for r in refs if r is not None])
    left = [r.ref_norm for r in keyed.filter(affix.may_hit(F.col("ref_norm"), few)).collect()]
    assert sorted(left) == sorted({r for _, r in want})
    rows = table("qid int, mode string, value string, kind string", [(*p, None) for p in patterns])
    assert sorted((r.qid, r.ref_norm) for r in affix.position_hits(rows, keyed).collect()) == want


def test_bounds_rule_out_no_similar_name(spark, table):
    """Every pair that reaches the cut-off stays a candidate, and few others do."""
    import random

    from plansift.operators import parts as P

    rng = random.Random(5)
    syllables = ["gla", "zing", "bead", "hin", "ge", "seal", "door", "ro", "ller", "clip", "é", "x", "10", "mm", "brush", "cap", "end", "plate", "anchor", "spring"]

    def word():
        return "".join(rng.choices(syllables, k=rng.randint(1, 3)))

    def typo(text):
        letters = list(text)
        for _ in range(rng.randint(0, max(1, len(letters) // 4))):
            at = rng.randrange(len(letters)) if letters else 0
            if rng.random() < 0.5 and letters:
                del letters[at]
            else:
                letters.insert(at, rng.choice("abegilnz "))
        return "".join(letters)

    names = sorted({" ".join(word() for _ in range(rng.randint(1, 5))) for _ in range(800)} | {"a", "ab", "a a", "  spaced   name "})
    needles = [typo(rng.choice(names)) for _ in range(60)] + ["", " ", "a", "zz top"]
    ratio = {(i, n): P.token_set_ratio(t, n) for i, t in enumerate(needles) for n in names}
    similar = {pair for pair, r in ratio.items() if r >= P.FUZZY_CUTOFF}
    asked = table("qid int, needle string", list(enumerate(needles)))
    made = P.fuzzy_candidates(asked, table("name string", [(n,) for n in names])).collect()
    candidates = {(r.qid, r.name) for r in made}
    assert similar and similar <= candidates and len(made) == len(candidates)
    # made of twenty syllables, many names share most of their letters; see the next test for the sample parts
    assert len(candidates) < len(ratio) / 20


def test_few_pairs_reach_python(spark):
    """On the sample parts, under one in a hundred pairs of name and needle is compared in Python."""
    from plansift.operators import parts as P
    from plansift.sources import standin

    parts = standin.parts(spark, "/root/testdata/sf0.01")
    names = parts.select(F.lower("designation").alias("name")).distinct()
    needles = spark.createDataFrame([(1, "smal anvil"), (2, "ring sela plates"), (3, "hardwear"), (4, "rde rods widget")], "qid int, needle string")
    kept, every = P.fuzzy_candidates(needles, names).count(), names.count() * 4
    assert every > 4000 and kept < every / 100, (kept, every)


def test_stored_list_reads_the_text_of_hits_only(spark, table, tmp_path):
    rows = [(i, "d1", i, f"see {'A10' if i % 50 == 7 else 'B20'}-X on this page, {i}", "") for i in range(400)]
    pages = table("page_id long, doc_id string, page_num int, text string, ocr_text string", rows)
    pages.repartitionByRange(8, "page_id").sortWithinPartitions("page_id").write.parquet(str(tmp_path / "pages"))
    pages = spark.read.parquet(str(tmp_path / "pages"))
    known = table("ref_norm string", [("A10X",), ("B20X",)])
    P.reference_list(pages, known).write.parquet(str(tmp_path / "refs"))
    listed = spark.read.parquet(str(tmp_path / "refs"))
    assert listed.filter("ref_norm = 'A10X'").count() == 8 and listed.count() == 400
    wanted = table("qid int, ref string, ref_norm string", [(1, "A10-X", "A10X"), (2, "none", "NONE"), (3, "", "")])
    found = P.pages_using_ref(wanted, pages, known, VOCAB, 100, listed)
    direct = P.pages_using_ref(wanted, pages, known, VOCAB, 100)
    assert sorted((r.qid, r.page_id, r.snippet) for r in found.collect()) == sorted((r.qid, r.page_id, r.snippet) for r in direct.collect())
    assert sorted(r.page_id for r in found.collect()) == list(range(7, 400, 50))
    plan = found.filter("rank > 0")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "In(page_id, [" in plan  # the scan of page text is given the hits
    with_refs = pages.withColumn("refs", F.array(F.lit("A10X")))
    assert P.reference_list(with_refs.filter("page_id < 3")).count() == 3
