"""Personal data: fixed kinds by pattern, further identifiers by bootstrapped contextual patterns."""
from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansift.llm.base import fresh, table
from plansift.staging import stage

BASE_KINDS = ("email", "ip", "card", "phone")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match never ends inside a run of digits, so one that starts inside a run fails like the run's own start
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]+")

#: Seed entities of the kind that the base patterns do not cover: values with a digit that are assigned to a name for
#: credentials, and access key ids.
SECRET = "secret"
_SEEDS = re.compile(r"(?i:\b(?:password|passwd|pwd|secret|token|api_?key)) ?[=:] ?[\"']?(?=[A-Za-z_/+-]*[0-9])([A-Za-z0-9_/+-]{8,})"
                    r"|\b(AKIA[0-9A-Z]{16})\b")
_TOKEN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_/+.-")
_NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_")
_SPACES = frozenset(" \t\n\v\f\r")
#: Values assigned without a digit.  Prose has colons, so after one a plain word is none.
_ASSIGNED = re.compile(r"[=:] ?[\"']?((?>[A-Za-z_/+.-]{8,}))(?![0-9])")
_PLAIN = re.compile(r"[A-Z]?[a-z.-]+|[A-Z.-]+")
#: Longer patterns are told apart by their digest.
_PATTERN = 64


@dataclass(frozen=True)
class Bootstrap:
    """Rounds of scoring; a pattern needs so many different instances, and this score to spread or, at the end, to name."""
    rounds: int = 4
    support: int = 3
    spread: float = 0.3
    confident: float = 0.5


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by kind and start; time in proportion to the text."""
    found, last = [], 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            found.append(("email", start, m.end()))
            last = m.end()
    if _DIGIT.search(text):
        found += [("ip", m.start(), m.end()) for m in _IP.finditer(text)
                  if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 16 <= len(digits) <= 19 and luhn(digits):
                found.append(("card", m.start(), m.end()))
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text)
                  if 8 <= sum(map(len, _DIGIT.findall(m.group()))) <= 15]
    return found


def shape(token: str) -> str | None:
    """Lexical class of an identifier of 12 characters or more that mixes letters and digits."""
    if len(token) < 12 or token.isdigit() or not any(c.isdigit() for c in token):
        return None
    if re.fullmatch("[0-9a-f]+", token):
        return "hex"
    if re.fullmatch("[0-9A-Z]+", token):
        return "code " + token[:4]
    return re.sub("[0-9]+", "9", re.sub("[a-z]+", "a", re.sub("[A-Z]+", "A", token)))


def left_context(text: str, start: int) -> str:
    """The name that is assigned to, or else the word before; empty at the start of a text."""
    at = start - (start > 0 and text[start - 1] in "\"'")
    at -= at > 0 and text[at - 1] == " "
    if at > 0 and text[at - 1] in "=:":
        end = at - 1
        end -= end > 0 and text[end - 1] == " "
        low = end
        while low > 0 and text[low - 1] in _NAME:
            low -= 1
        if low < end:
            return text[low:end].lower() + text[at - 1]
    at = end = start - (start > 0 and text[start - 1] in "\"'([")
    while end > 0 and text[end - 1] in _SPACES:
        end -= 1
    low = end
    while at > end and low > 0 and text[low - 1] not in _SPACES:
        low -= 1
    return text[low:end].lower()


def candidates(text: str):
    """(start, end) of tokens that a pattern may name: six characters or more with a digit, or assigned."""
    last = 0
    for m in _DIGIT.finditer(text):
        if m.start() < last:
            continue
        start, end = m.span()
        while start > last and text[start - 1] in _TOKEN:
            start -= 1
        while end < len(text) and text[end] in _TOKEN:
            end += 1
        last = end
        yield start, end
    if "=" in text or ":" in text:
        for m in _ASSIGNED.finditer(text):
            if text[m.start()] == "=" or not _PLAIN.fullmatch(m[1].rstrip(".-")):
                yield m.span(1)


def trimmed(text: str, start: int, end: int) -> tuple[int, int]:
    """Without the marks that end a clause or open a path."""
    while end > start and text[end - 1] in ".-":
        end -= 1
    while start < end and text[start] in ".-":
        start += 1
    return start, end


def apart(spans, taken: list[tuple[int, int]]):
    """Of ``spans`` in order of place, those that overlap neither ``taken`` (sorted) nor an earlier one."""
    i, last = 0, 0
    for start, end in sorted(spans):
        while i < len(taken) and taken[i][1] <= start:
            i += 1
        if (i == len(taken) or taken[i][0] >= end) and last <= start:
            yield start, end
            last = end


def instances(text: str, base: list[tuple[str, int, int]]) -> list[dict]:
    """Seeds and candidates: start, end, surface, the kind of a seed (else null) and the patterns around it."""
    taken = sorted((s, e) for _, s, e in base)
    seeds = {m.span(1 if m[1] else 2) for m in _SEEDS.finditer(text)} if "=" in text or ":" in text or "AKIA" in text else ()
    seeds = list(apart(seeds, taken))
    rest = {trimmed(text, *span) for span in candidates(text)}
    rest = apart([(s, e) for s, e in rest if e - s >= 6], sorted(taken + seeds))
    out = []
    for start, end, kind in [*((s, e, SECRET) for s, e in seeds), *((s, e, None) for s, e in rest), *((s, e, k) for k, s, e in base)]:
        surface, patterns = text[start:end], []
        if (context := left_context(text, start)):
            patterns.append("left " + context)
        if kind not in BASE_KINDS and (form := shape(surface)):
            patterns.append("shape " + form)
        if patterns:
            patterns = [p if len(p) <= _PATTERN else hashlib.md5(p.encode()).hexdigest() for p in patterns]
            out.append({"start": start, "end": end, "surface": hashlib.md5(surface.encode()).hexdigest()[:16],
                        "kind": kind, "patterns": patterns})
    return out


_INSTANCE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("surface", pa.string()), ("kind", pa.string()),
                       ("patterns", pa.list_(pa.string()))])
_COUNTS = tuple(f"n_{k}" for k in BASE_KINDS)


def scan(docs: DataFrame, text: str, keep: tuple[str, ...]) -> DataFrame:
    """One pass over the texts: ``keep``, counts, base_sha256, base (its text), key (of the text) and the instances."""
    n, here = len(keep), fresh("body", keep)
    source = docs.select(*keep, F.coalesce(F.col(text), F.lit("")).alias(here))
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:n]]
    types += [*(f"{c} long" for c in _COUNTS), "base_sha256 string", "base string", "key string",
              "found array<struct<start:long,end:long,surface:string,kind:string,patterns:array<string>>>"]
    names = [*keep, *_COUNTS, "base_sha256", "base", "key", "found"]

    def run(batches):
        for batch in batches:
            texts, rows = batch.column(n).to_pylist(), []
            for t in texts:
                spans = base_spans(t)
                said = ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
                rows.append((*(sum(k == x for k, _, _ in spans) for x in BASE_KINDS),
                             hashlib.sha256(said.encode()).hexdigest(), said, hashlib.md5(t.encode()).hexdigest(),
                             instances(t, spans)))
            columns = list(zip(*rows)) if rows else [()] * 8
            kinds = [pa.int64()] * 4 + [pa.string()] * 3 + [pa.list_(_INSTANCE)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(n)),
                                              *(pa.array(c, k) for c, k in zip(columns, kinds))], names=names)

    return source.mapInArrow(run, ", ".join(types))


def learn_patterns(found: DataFrame, how: Bootstrap = Bootstrap()) -> DataFrame:
    """(pattern, kind, score) of the confident patterns, from rows (surface, kind, pattern).

    The graph has an edge for each pattern and different instance.  Seeds
    score 1 for their kind.  In turn, a pattern scores the mean of its
    instances (those not reached count 0) and an instance that is no seed the
    best of its spreading patterns.  All corpus counts enter; groups are
    aggregated before each shuffle.
    """
    edges = stage(found.groupBy("pattern", "surface").agg(F.max("kind").alias("seed")), "edges")
    size = edges.groupBy("pattern").agg(F.count("*").alias("n"))
    seeds = edges.filter("seed is not null").select("surface", F.col("seed").alias("kind"), F.lit(1.0).alias("score")).distinct()
    scores = seeds
    for _ in range(how.rounds):
        sums = edges.join(scores, "surface").groupBy("pattern", "kind").agg(F.sum("score").alias("total"))
        patterns = stage(sums.join(size, "pattern").filter(F.col("n") >= how.support)
                         .select("pattern", "kind", (F.col("total") / F.col("n")).alias("score"))
                         .filter(F.col("score") >= how.spread), "patterns")
        reached = edges.filter("seed is null").join(patterns, "pattern").groupBy("surface", "kind").agg(F.max("score").alias("score"))
        scores = stage(seeds.unionByName(reached).groupBy("surface", "kind").agg(F.max("score").alias("score")), "scores")
    return patterns.filter(F.col("score") >= how.confident)


def learned_spans(scanned: DataFrame, how: Bootstrap = Bootstrap()) -> DataFrame:
    """(key, more): spans of instances that a confident pattern discovers, for each different text that has some."""
    found = scanned.select("key", F.explode("found").alias("x")).select("key", "x.*")
    # a kind other than the base ones is written even where only the seed rule found it
    flat = found.select("key", "start", "end", "surface", "kind", F.explode("patterns").alias("pattern"))
    patterns = learn_patterns(flat.select("surface", "kind", "pattern"), how)
    named = flat.filter("kind is null").select("key", "start", "end", "pattern").join(patterns, "pattern")
    seeds = found.filter(~F.col("kind").isin(*BASE_KINDS)).select("key", "start", "end", "kind", F.lit(1.0).alias("score"))
    spans = (named.select("key", "start", "end", "kind", "score").unionByName(seeds).groupBy("key", "start", "end")
             .agg(F.max_by("kind", F.struct("score", "kind")).alias("kind")))
    listed = spans.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("kind", "start", "end"))).alias("more"))
    return listed.select("key", F.concat_ws(",", F.transform("more", lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string")))).alias("more"))


def find_personal_data(docs: DataFrame, how: Bootstrap = Bootstrap(), text: str = "text",
                       keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep``, n_email, n_ip, n_card, n_phone, base_sha256, spans of every row; ``key`` is the MD5 of its text.

    Null and empty texts have no spans (the hash is that of the empty
    string).  Equal texts get equal spans.  Learned spans follow the base
    spans, by kind and start; learned spans of a base kind follow it as well.
    Texts are read once and only what was found in them is joined.
    """
    scanned = stage(scan(docs, text, keep), "scanned")
    more = learned_spans(scanned, how)
    joined = scanned.drop("found").join(more, "key", "left")
    spans = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.col("more"))
    return joined.select(*keep, *_COUNTS, "base_sha256", spans.alias("spans"), "key")


def redact(docs: DataFrame, how: Bootstrap = Bootstrap()) -> DataFrame:
    """Documents with every span replaced by its kind in brackets; ``n_chars`` is counted anew, other columns stay.

    A null text stays null, an empty one empty; rows stay as many as they are,
    repeated ones too, and equal texts are redacted alike.  Columns may have
    any name.  Texts of any length are read whole, in time in proportion to it.
    """
    own = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    moved = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in own.items()])
    text = own["text"]
    spans = find_personal_data(moved, how, text, ()).filter("spans <> ''").select("key", "spans").distinct()
    keyed = moved.withColumn("key", F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary")))
    source = keyed.join(spans, "key", "left").select(*own.values(), "spans")
    at = source.columns.index(text)

    def run(batches):
        for batch in batches:
            made = [t if not s else cut(t, s) for t, s in zip(batch.column(at).to_pylist(), batch.column(len(own)).to_pylist())]
            columns = [batch.column(i) for i in range(len(own))]
            columns[at] = pa.array(made, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=list(own.values()))

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    done = source.mapInArrow(run, types)
    count = {"n_chars": F.length(text).cast("long")}
    return done.select(*[count.get(c, F.col(a)).alias(c) for c, a in own.items()])


def cut(text: str, spans: str) -> str:
    """Text with spans (kind:start:end, comma-joined) replaced; of overlapping ones the first is named."""
    parts, last = [], 0
    for start, end, kind in sorted((int(s), int(e), k) for k, s, e in (x.rsplit(":", 2) for x in spans.split(","))):
        if start >= last:
            parts += [text[last:start], f"[{kind}]"]
        last = max(last, end)
    return "".join(parts) + text[last:]


def op7_pii(spark, sf_dir):
    return find_personal_data(table(spark, sf_dir, "documents")).drop("key")
