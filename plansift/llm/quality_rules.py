"""Line-first cleaning of texts, and the rejection of texts that lose too much."""
from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansift.llm.base import fresh, table

SYMBOLS = "#*$%&|<>"
#: A closing line ends with one of these (quotes and brackets may follow).
TERMINAL = r"""[.!?:;…。！？]["'”’»)\]]*$"""
NAVIGATION = r"(?i)^(home|menu|login|log in|sign in|sign up|next|previous|back to top|skip to content|share|search)\b"
BOILERPLATE = (r"(?i)licensed under|license, version|all rights reserved|copyright (\(c\)|©|[0-9])|cookie policy|"
               r"terms of (use|service)|privacy policy|subscribe to|click here|enable javascript|lorem ipsum")


@dataclass(frozen=True)
class Rules:
    """Thresholds; all are parameters of the operator.

    ``fragment_words``: a line under so many words must end in closing punctuation.
    ``symbols_per_word``, ``shouts_per_word``: a line with more of these fails.
    ``separators``: a line with so many of ``|`` or ``»`` is navigation.
    ``lost_percent``: a document that loses more of its characters is rejected.
    """
    fragment_words: int = 4
    symbols_percent: int = 33
    shouts_percent: int = 50
    separators: int = 3
    navigation_words: int = 8
    lost_percent: int = 50


_TERMINAL, _NAVIGATION, _BOILERPLATE = re.compile(TERMINAL), re.compile(NAVIGATION), re.compile(BOILERPLATE)
_SPACES = " \t\n\x0b\x0c\r"
_WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def line_failure(line: str, rules: Rules) -> str | None:
    """Name of the first rule that a line with at least one word breaks."""
    line = line.strip(_SPACES)
    n = len(_WORDS.findall(line))
    if 100 * sum(map(line.count, SYMBOLS)) > rules.symbols_percent * n:
        return "punctuation"
    if 100 * line.count("!") > rules.shouts_percent * n and n >= rules.fragment_words:
        return "punctuation"
    if n < rules.fragment_words and not _TERMINAL.search(line):
        return "punctuation"
    if line.count("|") + line.count("»") >= rules.separators:
        return "navigation"
    if n <= rules.navigation_words and _NAVIGATION.search(line):
        return "navigation"
    if _BOILERPLATE.search(line):
        return "boilerplate"
    return None


def repeated_words(words: list[str]) -> int:
    """Words inside 3-word windows that the text holds twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    counts, covered, last = Counter(windows), 0, -1
    for i, window in enumerate(windows):
        if counts[window] > 1:
            covered += i + 2 - max(i - 1, last)
            last = i + 2
    return covered


def judge(text: str, rules: Rules) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, n_lost_chars, cleaned)"""
    words = text.encode("utf-8", "surrogatepass").split()
    n = len(words)
    chars = len(text) - sum(map(text.count, _SPACES))
    lines = text.split("\n")
    full = [line for line in lines if line.strip(_SPACES)]
    repeats = repeated_words(words)
    failed = n < 50 or 100 * repeats > 50 * n
    bad = [bool(line.strip(_SPACES)) and line_failure(line, rules) is not None for line in lines]
    lost, total = sum(len(x) for x, b in zip(lines, bad) if b), sum(map(len, lines))
    cleaned = "\n".join(x for x, b in zip(lines, bad) if not b)
    kept = not failed and 100 * lost <= rules.lost_percent * total
    return (n, chars, sum(map(text.count, SYMBOLS)), len(full) - len(set(full)), repeats, failed, kept, lost, cleaned)


_FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lost_chars")
_TYPES = ("long",) * 5 + ("boolean",) * 2 + ("long",)


def quality(docs: DataFrame, rules: Rules = Rules(), text: str = "text", keep: tuple[str, ...] = ("doc_id",),
            cleaned: str | None = None) -> DataFrame:
    """One row per document: the columns ``keep``, the counts, ``base_failed``, ``kept``, ``n_lost_chars``.

    Null texts count as empty, and an empty text fails the base rule.  Repeated
    rows are judged one by one.  Columns not in ``keep`` are not read; with
    ``cleaned`` the text without its failed lines is added under that name.
    One pass over the documents; nothing is shuffled.
    """
    here = fresh("body", keep)
    source = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(here))
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]]
    types += [f"`{n}` {t}" for n, t in zip(_FIELDS, _TYPES)] + ([f"`{cleaned}` string"] if cleaned else [])
    names = [*keep, *_FIELDS, *([cleaned] if cleaned else [])]
    if len({n.lower() for n in names}) < len(names):
        raise ValueError("columns to keep must not have the names of the results")

    def run(batches):
        for batch in batches:
            rows = [judge(t, rules) for t in batch.column(len(keep)).to_pylist()]
            columns = list(zip(*rows)) if rows else [()] * 9
            made = [pa.array(columns[i], pa.bool_() if t == "boolean" else pa.int64()) for i, t in enumerate(_TYPES)]
            made += [pa.array(columns[8], pa.string())] if cleaned else []
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *made], names=names)

    return source.mapInArrow(run, ", ".join(types))


def clean(docs: DataFrame, rules: Rules = Rules()) -> DataFrame:
    """Documents kept, their texts without failed lines; the columns stay as they are, ``n_chars`` is counted anew.

    Columns that are named like a result of the operator keep their values.
    """
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    moved = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in own.items()])
    done = quality(moved, rules, own["text"], tuple(own.values()), "cleaned").filter("kept")
    changed = {"text": F.col("cleaned"), "n_chars": F.length("cleaned").cast("long")}
    return done.select(*[changed.get(c, F.col(a)).alias(c) for c, a in own.items()])


def op4_quality_rules(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"))


#: The same rules for DuckDB; ``lines`` is made of \\n-split lines with a word.
ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
           FROM documents),
wins AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS win
         FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM wins) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(3) t(k) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
parts AS (SELECT doc_id, line, trim(line, chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' ') AS t,
                 len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n FROM lines),
judged AS (SELECT doc_id, line, n, n > 0 AND (
              100 * length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) > 33 * n
              OR (100 * length(regexp_replace(t, '[^!]', '', 'g')) > 50 * n AND n >= 4)
              OR (n < 4 AND NOT regexp_matches(t, '[.!?:;…。！？]["''”’»)\]]*$'))
              OR length(regexp_replace(t, '[^|»]', '', 'g')) >= 3
              OR (n <= 8 AND regexp_matches(t, 'NAVIGATION'))
              OR regexp_matches(t, 'BOILERPLATE')) AS bad FROM parts),
sums AS (SELECT doc_id, sum(CASE WHEN bad THEN length(line) ELSE 0 END) AS lost, sum(length(line)) AS total,
                count(*) FILTER (n > 0) - count(DISTINCT line) FILTER (n > 0) AS n_dup_lines FROM judged GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
       length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
       len(w) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(w) AS base_failed,
       NOT (len(w) < 50 OR 100 * coalesce(n_repeat_words, 0) > 50 * len(w)) AND 100 * lost <= 50 * total AS kept,
       lost::BIGINT AS n_lost_chars
FROM d JOIN sums USING (doc_id) LEFT JOIN rep USING (doc_id)
""".replace("NAVIGATION", NAVIGATION).replace("BOILERPLATE", BOILERPLATE)
