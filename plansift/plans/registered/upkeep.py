"""Counts, listings, caches, keyed rewrites and source parsing over whole tables."""
from __future__ import annotations

from pyspark.sql import functions as F

from plansift.functions import text as T
from plansift.operators import cache, relational as Rel
from plansift.plans.registered import sqlparts as S
from plansift.sources import ingest, standin

QUERIES, ORACLE = {}, {}


def registered(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn
    return add


_COUNTED = ("documents", "part", "lineitem", "embeddings")


@registered(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t}" for t in _COUNTED))
def table_counts(spark, sf_dir):
    frames = [standin.table(spark, sf_dir, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("table_name"), "n")
              for t in _COUNTED]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


@registered("""SELECT count(*) AS pages, count(*) FILTER (WHERE length(trim(text)) > 0) AS with_text, count(*) FILTER (WHERE quality IS NOT NULL) AS labelled,
 count(*) FILTER (WHERE quality IS NOT NULL) > 0 AS has_labels FROM documents LEFT JOIN labels USING (doc_id)""")
def conditional_counts(spark, sf_dir):
    docs = standin.table(spark, sf_dir, "documents")
    rows = docs.join(standin.table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.agg(F.count(F.lit(1)).alias("pages"), F.count_if(F.length(F.trim("text")) > 0).alias("with_text"),
                    F.count_if(F.col("quality").isNotNull()).alias("labelled"),
                    (F.count_if(F.col("quality").isNotNull()) > 0).alias("has_labels"))


@registered("SELECT DISTINCT upper(source) AS system FROM documents")
def systems(spark, sf_dir):
    return standin.documents(spark, sf_dir).select(F.explode("systems").alias("system")).distinct()


@registered("""SELECT doc_id, source || '/' || lang AS names, 2 AS n FROM documents WHERE source NOT LIKE '%7'
 UNION ALL SELECT doc_id, NULL, NULL FROM documents WHERE source LIKE '%7'""")
def decoded_arrays(spark, sf_dir):
    """Arrays kept as text, decoded; text that is no array gives null."""
    docs = standin.table(spark, sf_dir, "documents")
    kept = F.when(F.col("source").endswith("7"), F.lit("no array")).otherwise(F.to_json(F.array("source", "lang")))
    rows = docs.select("doc_id", F.from_json(kept, "array<string>").alias("names"))
    return rows.select("doc_id", F.array_join("names", "/").alias("names"), F.nullif(F.size("names"), F.lit(-1)).alias("n"))


@registered("""SELECT DISTINCT CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events""")
def decoded_properties(spark, sf_dir):
    return standin.table(spark, sf_dir, "events").select(
        F.from_json("props", "k int")["k"].alias("k")).distinct()


@registered("""SELECT o_orderkey AS doc_id, o_orderstatus AS system, (SELECT count(*) FROM lineitem WHERE l_orderkey = o_orderkey) AS figure_count FROM orders""")
def list_documents(spark, sf_dir):
    orders, li = standin.table(spark, sf_dir, "orders"), standin.table(spark, sf_dir, "lineitem")
    counts = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("figure_count"))
    rows = orders.select("o_orderkey", "o_orderstatus").join(counts, "o_orderkey", "left")
    return rows.select(F.col("o_orderkey").alias("doc_id"), F.col("o_orderstatus").alias("system"),
                       F.coalesce("figure_count", F.lit(0)).alias("figure_count"))


@registered(f"""WITH d AS (SELECT source || '-' || lang AS doc_id, source || '/' || lang || ' notes.pdf' AS filename, upper(source) AS system, count(*) AS num_pages FROM documents GROUP BY source, lang)
SELECT doc_id, filename, system, num_pages, row_number() OVER (ORDER BY system, filename) AS position FROM d""")
def ordered_documents(spark, sf_dir):
    listed = ingest.with_ids(standin.documents(spark, sf_dir), ["system", "filename"], "position").orderBy("position")
    return listed.select("doc_id", "filename", "system", "num_pages", "position")


_COLUMNS = (("doc_id", "number"), ("text", "text"), ("lang", "text"), ("source", "text"), ("n_chars", "number"))


@registered(" UNION ALL ".join(
    f"SELECT '{c}' AS column_name, '{f}' AS family, count({c}) AS filled FROM documents" for c, f in _COLUMNS))
def catalog_columns(spark, sf_dir):
    """Columns of a table as its schema lists them, with how many rows fill each."""
    families = {"bigint": "number", "int": "number", "double": "number", "string": "text"}
    docs = standin.table(spark, sf_dir, "documents")
    filled = docs.agg(*[F.count(c).alias(c) for c in docs.columns])
    listed = F.array(*[F.struct(F.lit(field.name).alias("column_name"),
                                F.lit(families.get(field.dataType.simpleString(), "other")).alias("family"),
                                F.col(field.name).alias("filled")) for field in docs.schema])
    return filled.select(F.explode(listed).alias("c")).select("c.*")


# -------------------------------------------------------------- caches and history
@registered("""WITH stored AS (SELECT sha256(lower(trim(text)) || '|' || 'v1') AS k, max(text) AS answer FROM conversations GROUP BY 1)
SELECT item_id, sha256(lower(trim(text)) || '|' || 'v1') AS cache_key, answer IS NOT NULL AS hit FROM benchmark LEFT JOIN stored ON k = sha256(lower(trim(text)) || '|' || 'v1')""")
def cache_lookup(spark, sf_dir):
    key = T.cache_key(F.col("text"), F.lit("v1"))
    stored = standin.table(spark, sf_dir, "conversations").groupBy(key.alias("key")).agg(F.max("text").alias("answer"))
    asked = standin.table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"), F.lit("v1").alias("signature"))
    return cache.lookup(asked, stored).select("item_id", F.col("key").alias("cache_key"), F.col("answer").isNotNull().alias("hit"))


@registered("""SELECT k AS cache_key, first_at FROM (SELECT event_type || ':' || user_id AS k, min(ts) AS first_at FROM events GROUP BY 1) ORDER BY first_at DESC, k LIMIT 200""")
def cache_evict(spark, sf_dir):
    events = standin.table(spark, sf_dir, "events").select(
        F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("cache_key"), F.col("ts").alias("first_at"))
    return Rel.first_inserted(events, "cache_key", "first_at", 200)


@registered("""SELECT user_id, item, rank FROM (SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY at_ts DESC, item) AS rank
 FROM (SELECT user_id, event_type || props AS item, max(ts) AS at_ts FROM events GROUP BY 1, 2)) WHERE rank <= 10""")
def recent_history(spark, sf_dir):
    events = standin.table(spark, sf_dir, "events").withColumn("item", F.concat("event_type", "props"))
    return Rel.recent_unique(events, "user_id", "item", "ts", 10).select("user_id", "item", "rank")


@registered("""SELECT user_id, item, rank FROM (SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY at_ts DESC, item) AS rank
 FROM (SELECT user_id, event_type || props AS item, max(ts) AS at_ts, count(*) AS c FROM events GROUP BY 1, 2) WHERE c % 2 = 1) WHERE rank <= 20""")
def favourites(spark, sf_dir):
    events = standin.table(spark, sf_dir, "events").withColumn("item", F.concat("event_type", "props"))
    return Rel.toggled_on(events, "user_id", "item", "ts", 20).select("user_id", "item", "rank")


# ------------------------------------------------------------------ keyed rewrites
@registered("""SELECT o_orderkey, o_orderstatus, coalesce(total, o_totalprice) AS o_totalprice FROM orders
 LEFT JOIN (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def keyed_update(spark, sf_dir):
    orders = standin.table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    totals = standin.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.round(F.sum("l_extendedprice"), 2).alias("o_totalprice"))
    return Rel.update_column(orders, "o_orderkey", "o_totalprice", totals)


@registered("""WITH fresh AS (SELECT o_orderkey AS k, 0::BIGINT AS n, 'new ' || o_orderstatus AS v FROM orders WHERE o_orderstatus = 'P')
SELECT l_orderkey AS k, l_linenumber::BIGINT AS n, l_returnflag AS v FROM lineitem WHERE l_orderkey NOT IN (SELECT k FROM fresh) UNION ALL SELECT * FROM fresh""")
def replace_groups(spark, sf_dir):
    old = standin.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), F.col("l_returnflag").alias("v"))
    fresh = standin.table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select(
        F.col("o_orderkey").alias("k"), F.lit(0).alias("n"), F.concat(F.lit("new "), "o_orderstatus").alias("v"))
    return Rel.replace_groups(old, ["k"], fresh)


# ------------------------------------------------------------------------- sources
def _workbook_cells(spark, sf_dir):
    """The part table as sheet rows: a junk line, a header line, then the parts."""
    part = standin.table(spark, sf_dir, "part")
    sheet = F.when(F.col("p_type").isin("STANDARD", "ECONOMY"), F.lit("PROFILES")).when(
        F.col("p_type").isin("SMALL", "PROMO"), F.lit("Accessories")).otherwise(F.lit("Other"))
    rows = part.select(sheet.alias("sheet"), (F.col("p_partkey") + 10).alias("row_no"), F.array(
        F.concat(F.lit("k"), F.col("p_partkey").cast("string"), F.lit("-a")), F.col("p_brand"),
        F.when(F.col("p_size") % 5 == 0, F.lit("")).otherwise(F.col("p_name")),
        F.col("p_size").cast("string")).alias("cells"))
    names = rows.select("sheet").distinct()
    junk = names.select("sheet", F.lit(1).cast("bigint").alias("row_no"), F.array(F.lit("printed list"), F.lit("")).alias("cells"))
    head = names.select("sheet", F.lit(2).cast("bigint").alias("row_no"), F.array(
        F.lit("Ref.No."), F.lit("Supplier"), F.lit("Description"), F.lit("")).alias("cells"))
    return rows.unionByName(junk).unionByName(head)


@registered("""WITH p AS (SELECT upper('k' || p_partkey || '-a') AS ref, p_brand AS supplier_ref, p_size, CASE WHEN p_type IN ('STANDARD','ECONOMY') THEN 'profile'
 WHEN p_type IN ('SMALL','PROMO') THEN 'accessory' ELSE 'part' END AS kind, CASE WHEN p_size % 5 = 0 THEN '' ELSE p_name END AS d FROM part)
SELECT ref, replace(ref, '-', '') AS ref_norm, kind, supplier_ref, CASE WHEN d = '' THEN p_size::VARCHAR ELSE d END AS designation,
 CASE WHEN d = '' THEN ref || ' ' || kind || ' ' || p_size || ' ' || supplier_ref ELSE ref || ' ' || kind || ' ' || d || ' ' || supplier_ref || ' ' || p_size END AS raw FROM p""")
def workbook_parts(spark, sf_dir):
    return ingest.parts_from_cells(_workbook_cells(spark, sf_dir)).select(
        "ref", "ref_norm", "kind", "supplier_ref", "designation", "raw")


@registered(f"""WITH files AS (SELECT 'photos/' || source || '/' || lang || doc_id || '.v1.JPG' AS path FROM documents)
SELECT path, upper(regexp_extract(path, '([^/]+)\\.[^.]+$', 1)) AS ref, {S.norm_ref("regexp_extract(path, '([^/]+)' || chr(92) || '.[^.]+$', 1)")} AS ref_norm FROM files""")
def photo_references(spark, sf_dir):
    path = F.concat(F.lit("photos/"), "source", F.lit("/"), "lang", F.col("doc_id").cast("string"), F.lit(".v1.JPG"))
    files = standin.table(spark, sf_dir, "documents").select(path.alias("path"))
    return ingest.photos_from_files(files).select("path", "ref", "ref_norm")


@registered("""SELECT doc_id, row_number() OVER (ORDER BY source, lang, doc_id) AS page_id FROM documents""")
def deterministic_ids(spark, sf_dir):
    docs = standin.table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    return ingest.with_ids(docs, ["source", "lang", "doc_id"], "page_id").select("doc_id", "page_id")
