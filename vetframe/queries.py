"""The registered queries: operators over the adapted warehouse tables, each beside SQL of the same meaning."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import adapters as A
from . import vocab
from .functions import geometry as G
from .functions import names
from .operators import apply, classes, duplicates, findings, manifest, merge, resplit, rows, structure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# --- the adapters in SQL -----------------------------------------------------------------------
BOXES = """
r AS (SELECT CAST(l_orderkey AS BIGINT) AS okey, l_partkey AS pk, l_suppkey AS sk, l_linenumber - 1 AS ln, CAST(l_quantity AS BIGINT) AS q,
             CAST(round(l_discount * 100) AS BIGINT) AS dc, CAST(round(l_tax * 100) AS BIGINT) AS tx,
             row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS line_no
      FROM lineitem),
m AS (SELECT okey, line_no, CASE WHEN pk % 53 = 0 THEN 0 WHEN pk % 101 = 0 THEN 7 ELSE ln END AS cls,
             CASE WHEN pk % 47 = 0 OR pk % 53 = 0 THEN 500000 ELSE 200000 + (pk * 37 % 600) * 1000 END AS xm,
             CASE WHEN pk % 47 = 0 OR pk % 53 = 0 THEN 500000 ELSE 200000 + (sk * 53 % 600) * 1000 END AS ym,
             CASE WHEN pk % 47 = 0 THEN 1000000 WHEN pk % 53 = 0 THEN 200000 ELSE q * 10000 END AS wm,
             CASE WHEN pk % 47 = 0 THEN 1000000 WHEN pk % 53 = 0 THEN 200000 ELSE dc * 40000 + tx * 250 END AS hm FROM r),
boxes AS (SELECT CASE WHEN okey % 5 = 0 THEN 'val' ELSE 'train' END || '/' || okey AS key, CASE WHEN okey % 5 = 0 THEN 'val' ELSE 'train' END AS split, okey, line_no, cls, xm, ym, wm, hm,
                 xm::DOUBLE / 1e6 AS xc, ym::DOUBLE / 1e6 AS yc, wm::DOUBLE / 1e6 AS w, hm::DOUBLE / 1e6 AS h FROM m)"""
SAMPLES = """
samples AS (SELECT CASE WHEN o_orderkey % 5 = 0 THEN 'val' ELSE 'train' END AS split, o_orderkey::VARCHAR AS stem,
                   CASE WHEN o_orderkey % 5 = 0 THEN 'val' ELSE 'train' END || '/' || o_orderkey AS key, o_orderkey AS okey,
                   o_orderkey % 97 <> 0 AS has_image, n IS NOT NULL OR o_orderkey % 3 <> 0 AS label_exists, coalesce(n, 0) AS n_boxes
            FROM orders LEFT JOIN (SELECT l_orderkey AS k, count(*) AS n FROM lineitem GROUP BY 1) ON k = o_orderkey)"""
IMAGES = "images AS (SELECT key, okey, CASE WHEN okey % 4 = 0 THEN 1280 ELSE 640 END AS width, CASE WHEN okey % 4 = 0 THEN 720 ELSE 480 END AS height FROM samples WHERE has_image)"
DEGENERATE = "(w <= 1e-9 OR h <= 1e-9)"
TINY = f"(NOT {DEGENERATE} AND (w < 0.003 OR h < 0.003 OR w * h < 1e-5))"
OUTSIDE = "(xc - w / 2 < -1e-9 OR yc - h / 2 < -1e-9 OR xc + w / 2 > 1 + 1e-9 OR yc + h / 2 > 1 + 1e-9 OR xc < -1e-9 OR xc > 1 + 1e-9 OR yc < -1e-9 OR yc > 1 + 1e-9)"
BAD_CLASS = "(cls < 0 OR cls >= 7)"
REPEATS = "again AS (SELECT * FROM (SELECT *, row_number() OVER s AS place, first_value(line_no) OVER s AS first_line FROM boxes WINDOW s AS (PARTITION BY key, cls, xm, ym, wm, hm ORDER BY line_no)) WHERE place > 1)"
HITS = f"""
hits AS (SELECT 'degenerate_box' AS type, key, line_no FROM boxes WHERE {DEGENERATE} UNION ALL SELECT 'tiny_box', key, line_no FROM boxes WHERE {TINY}
         UNION ALL SELECT 'out_of_bounds', key, line_no FROM boxes WHERE {OUTSIDE} UNION ALL SELECT 'class_id_out_of_range', key, line_no FROM boxes WHERE {BAD_CLASS}
         UNION ALL SELECT 'duplicate_annotation', key, line_no FROM again)"""
KINDS = "kinds(type, severity, severity_rank, category) AS (VALUES " + ", ".join(f"('{k.type}', '{k.severity}', {k.severity_rank}, '{k.category}')" for k in vocab.kinds()) + ")"
FOUND = "found AS (SELECT type, severity, severity_rank, category, count(DISTINCT key) AS n_items, count(*) AS n_hits FROM hits JOIN kinds USING (type) GROUP BY 1, 2, 3, 4)"
GEOMETRY = f"WITH {BOXES}, {REPEATS}, {HITS}, {KINDS}, {FOUND}"
WORD_BITS = ", ".join(f"sum(((h >> {i}) & 1) * 2 - 1) AS v{i}" for i in range(60))
WORD_HASH = " + ".join(f"CASE WHEN v{i} > 0 THEN {1 << i} ELSE 0 END" for i in range(60))
HASHES = f"""
words AS (SELECT DISTINCT doc_id, unnest(regexp_split_to_array(lower(text), '[ \\t\\n\\r]+')) AS w FROM documents WHERE text IS NOT NULL),
votes AS (SELECT doc_id, {WORD_BITS} FROM (SELECT doc_id, ('0x' || substr(md5(w), 1, 15))::BIGINT AS h FROM words WHERE w <> '') GROUP BY doc_id),
hashes AS (SELECT d.doc_id, source, CASE WHEN d.doc_id % 5 = 0 THEN 'val' ELSE 'train' END AS split, CASE WHEN d.doc_id % 5 = 0 THEN 'val' ELSE 'train' END || '/' || d.doc_id AS key,
                  ({WORD_HASH})::BIGINT AS hash FROM documents d LEFT JOIN votes USING (doc_id))"""
NEAR = "bit_count(xor(a.hash, b.hash)) <= 5"
TAXONOMIES = """
types AS (SELECT DISTINCT p_brand AS source, p_type AS base FROM part),
taxonomies AS (SELECT source, (dense_rank() OVER (PARTITION BY source ORDER BY base) - 1)::INT AS cls,
                      CASE WHEN (length(source) + ascii(right(source, 1))) % 2 = 0 THEN lower(base) || 's' ELSE base END AS name FROM types)"""


def query(sql: str | None = None):
    """Register a query under its name, with the SQL that gives the same rows."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- boxes -------------------------------------------------------------------------------------
def _hits(spark: SparkSession, sf: str) -> DataFrame:
    boxes = A.boxes(spark, sf)
    again = rows.repeats(boxes).select(F.lit("duplicate_annotation").alias("type"), "key", "line_no")
    return rows.row_hits(boxes, rows.geometry_checks(A.NC)).unionByName(again)


@query(f"{GEOMETRY} SELECT type, severity, severity_rank, category, n_items, n_hits FROM found")
def geometry_findings(spark, sf):
    return findings.findings(spark, _hits(spark, sf))


def _of_type(name: str, holds: str, check) -> None:
    def run(spark, sf):
        return A.boxes(spark, sf).where(check()).select("key", "line_no", "cls")

    run.__name__ = name
    query(f"WITH {BOXES} SELECT key, line_no, cls FROM boxes WHERE {holds}")(run)


_of_type("degenerate_box", DEGENERATE, rows.degenerate)
_of_type("tiny_box", TINY, rows.tiny)
_of_type("out_of_bounds", OUTSIDE, rows.out_of_bounds)
_of_type("class_id_range", BAD_CLASS, lambda: rows.class_out_of_range(A.NC))
_of_type("undetectable", "w > 0 AND h > 0 AND (w < 0.0125 OR h < 0.0125)", lambda: rows.undetectable(640))


@query(f"WITH {BOXES}, {REPEATS} SELECT key, line_no, first_line FROM again")
def duplicate_annotation(spark, sf):
    return rows.repeats(A.boxes(spark, sf)).select("key", "line_no", "first_line")


@query(f"WITH {BOXES} SELECT 'whole_frame_box' AS type, key, line_no FROM boxes WHERE w >= 0.98 AND h >= 0.98 AND (SELECT count(*) FILTER (w >= 0.98 AND h >= 0.98) >= greatest(5, 0.02 * count(*)) FROM boxes)")
def whole_frame(spark, sf):
    return rows.whole_frame_hits(A.boxes(spark, sf))


@query(f"WITH {BOXES} SELECT key, count(*) AS n_boxes FROM boxes GROUP BY key HAVING count(*) > 6")
def over_max_detections(spark, sf):
    return rows.over_max_detections(A.boxes(spark, sf), 6)


@query(f"""WITH {BOXES}, {SAMPLES}, {IMAGES},
    px AS (SELECT key, CASE WHEN okey % 11 = 0 THEN xc * 640 ELSE xc END AS xc, CASE WHEN okey % 11 = 0 THEN yc * 480 ELSE yc END AS yc, CASE WHEN okey % 11 = 0 THEN w * 640 ELSE w END AS w, CASE WHEN okey % 11 = 0 THEN h * 480 ELSE h END AS h FROM boxes),
    f AS (SELECT key, count(*) FILTER (greatest(xc, yc, w, h) > 1.5) AS n_over, count(*) AS n_boxes, max(greatest(xc, w)) FILTER (greatest(xc, yc, w, h) > 1.5) AS fx, max(greatest(yc, h)) FILTER (greatest(xc, yc, w, h) > 1.5) AS fy FROM px GROUP BY key)
    SELECT key, n_over, n_boxes FROM f JOIN images USING (key) WHERE n_over >= greatest(1, n_boxes // 2) AND fx <= 1.02 * width AND fy <= 1.02 * height""")
def denormalised(spark, sf):
    boxes = A.boxes(spark, sf)
    pixels = F.col("okey") % 11 == 0
    px = boxes.withColumns({c: F.when(pixels, F.col(c) * by).otherwise(F.col(c)) for c, by in (("xc", 640), ("w", 640), ("yc", 480), ("h", 480))})
    return rows.denormalised(px, A.images(spark, sf))


@query(f"WITH {BOXES}, {REPEATS}, {HITS} SELECT type, key, list_sort(list(DISTINCT line_no))::VARCHAR AS lines FROM hits GROUP BY type, key")
def locations(spark, sf):
    found = findings.locations(_hits(spark, sf))
    return found.select("type", "key", F.concat(F.lit("["), F.array_join("lines", ", "), F.lit("]")).alias("lines"))


@query(f"WITH {BOXES}, {REPEATS}, {HITS} SELECT type, key, line_no, place FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY key, line_no) AS place FROM hits) WHERE place <= 12")
def evidence(spark, sf):
    return findings.evidence(_hits(spark, sf))


# --- files -------------------------------------------------------------------------------------
def _file_query(name: str, holds: str, op) -> None:
    def run(spark, sf):
        return op(A.samples(spark, sf))

    run.__name__ = name
    query(f"WITH {SAMPLES} SELECT '{name.rstrip('s')}_file' AS type, key FROM samples WHERE {holds}")(run)


_file_query("missing_labels", "has_image AND NOT label_exists", structure.missing_labels)
_file_query("orphan_labels", "NOT has_image AND label_exists", structure.orphan_labels)
_file_query("empty_labels", "label_exists AND n_boxes = 0", structure.empty_labels)


@query("""SELECT coalesce(d.doc_id, l.doc_id) AS key, d.doc_id IS NOT NULL AS has_image, l.doc_id IS NOT NULL AS label_exists
          FROM (SELECT DISTINCT doc_id FROM documents) d FULL JOIN (SELECT DISTINCT doc_id FROM labels) l ON d.doc_id = l.doc_id""")
def image_label_pairs(spark, sf):
    ids = lambda t: A.table(spark, sf, t).select(F.col("doc_id").alias("key")).distinct()
    return structure.pair(ids("documents"), ids("labels"))


@query("""WITH r AS (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n, replace(replace(props, '{', ''), '}', '') AS t, event_id % 7 AS m, value FROM events),
          rows AS (SELECT 'train/' || event_id AS key, CASE m WHEN 0 THEN '1 0.5 0.5 0.2' WHEN 1 THEN '1 0.5 0.5 0.2 0.2 0.87' WHEN 2 THEN '1 0.5 x 0.2 0.2' WHEN 3 THEN 'nan 0.5 0.5 0.2 0.2' ELSE '1.9 0.5 5_0 2e-1 .2' END AS raw, m FROM r)
          SELECT key, 1 AS line_no, raw, CASE m WHEN 0 THEN 'expected 5 fields, found 4' WHEN 1 THEN 'expected 5 fields, found 6' ELSE 'non-numeric field' END AS reason FROM rows WHERE m <= 3""")
def malformed_rows(spark, sf):
    from .sources import labelrows

    m = F.col("event_id") % 7
    content = F.when(m == 0, "1 0.5 0.5 0.2").when(m == 1, "1 0.5 0.5 0.2 0.2 0.87").when(m == 2, "1 0.5 x 0.2 0.2").when(m == 3, "nan 0.5 0.5 0.2 0.2").otherwise("1.9 0.5 5_0 2e-1 .2")
    files = A.table(spark, sf, "events").select(F.concat(F.lit("train/"), F.col("event_id").cast("string")).alias("key"), content.alias("content"))
    return labelrows.parse(labelrows.lines(files))[1]


@query("""SELECT 'train/' || event_id AS key, 1 AS line_no, 1 AS cls, 0.5::DOUBLE AS xc, 50.0::DOUBLE AS yc, 0.2::DOUBLE AS w, 0.2::DOUBLE AS h FROM events WHERE event_id % 7 > 3""")
def parsed_rows(spark, sf):
    from .sources import labelrows

    content = F.when(F.col("event_id") % 7 > 3, "1.9 0.5 5_0 2e-1 .2").otherwise("1 0.5 x")
    files = A.table(spark, sf, "events").select(F.concat(F.lit("train/"), F.col("event_id").cast("string")).alias("key"), content.alias("content"))
    return labelrows.parse(labelrows.lines(files))[0].select("key", "line_no", "cls", "xc", "yc", "w", "h")


# --- classes -----------------------------------------------------------------------------------
@query(f"WITH {SAMPLES} SELECT split, count(*) FILTER (has_image) AS images, count(*) FILTER (label_exists) AS label_files, sum(n_boxes)::BIGINT AS boxes FROM samples GROUP BY split")
def dataset_summary(spark, sf):
    return classes.summary(A.samples(spark, sf))


def _taxonomy(spark, n: int = A.NC) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("cls"), F.concat(F.lit("class"), F.col("id").cast("string")).alias("name"))


@query(f"""WITH {BOXES}, grid AS (SELECT split, range::INT AS cls FROM (SELECT DISTINCT split FROM boxes), range(7)), n AS (SELECT split, cls, count(*) AS n FROM boxes GROUP BY 1, 2)
           SELECT split, cls, CASE WHEN cls BETWEEN 0 AND 6 THEN 'class' || cls ELSE '<id ' || cls || ' not in data.yaml>' END AS name, coalesce(n, 0) AS n FROM grid FULL JOIN n USING (split, cls)""")
def class_distribution(spark, sf):
    return classes.distribution(A.boxes(spark, sf), _taxonomy(spark))


@query(f"""WITH {BOXES}, per AS (SELECT cls, count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val FROM (SELECT CASE WHEN cls = 6 AND split = 'train' AND okey % 50 <> 1 THEN 0 ELSE cls END AS cls, split FROM boxes) GROUP BY cls), b AS (SELECT max(n_train) AS busiest FROM per),
           g AS (SELECT range::INT AS cls, coalesce(n_train, 0) AS n_train, coalesce(n_val, 0) AS n_val, busiest FROM range(9) LEFT JOIN per ON per.cls = range CROSS JOIN b)
           SELECT cls, n_train, n_val, n_train = 0 AS absent, n_train < 10 AS few, n_train > 0 AND busiest / greatest(n_train, 1) >= 50 AS rare, n_val < 3 AS unmeasured FROM g
           WHERE n_train < 10 OR busiest / greatest(n_train, 1) >= 50 OR n_val < 3""")
def class_imbalance(spark, sf):
    boxes = A.boxes(spark, sf).withColumn("cls", F.expr("CASE WHEN cls = 6 AND split = 'train' AND okey % 50 <> 1 THEN 0 ELSE cls END"))
    return classes.imbalance(boxes, 9)


@query(f"WITH {BOXES} SELECT cls, count(*) FILTER (split = 'train') AS n_train FROM (SELECT cls, CASE WHEN cls IN (3, 5) THEN 'train' ELSE split END AS split FROM boxes) GROUP BY cls HAVING count(*) FILTER (split = 'train') > 0 AND count(*) FILTER (split = 'val') = 0")
def class_absent_val(spark, sf):
    return classes.absent_from_val(A.boxes(spark, sf).withColumn("split", F.when(F.col("cls").isin(3, 5), "train").otherwise(F.col("split"))))


@query(f"WITH {SAMPLES}, n AS (SELECT count(*) FILTER (split = 'train') AS n_train, count(*) FILTER (split = 'val') AS n_val FROM (SELECT has_image, CASE WHEN okey % 100 = 0 THEN 'val' ELSE 'train' END AS split FROM samples) WHERE has_image) SELECT * FROM n WHERE n_train + n_val >= 20 AND (n_val = 0 OR n_val / (n_train + n_val) < 0.05 OR n_val / (n_train + n_val) > 0.5)")
def split_ratio(spark, sf):
    return classes.split_ratio(A.samples(spark, sf).withColumn("split", F.when(F.col("okey") % 100 == 0, "val").otherwise("train")))


@query(f"""WITH {BOXES}, {SAMPLES}, {IMAGES}, bx AS (SELECT key, CASE WHEN cls = 2 AND okey % 4 <> 0 THEN 1 ELSE cls END AS cls FROM boxes), sized AS (SELECT key, width || 'x' || height AS bucket FROM images WHERE key IN (SELECT key FROM bx)),
           base AS (SELECT bucket, count(*) AS images FROM sized GROUP BY 1), per AS (SELECT cls, bucket, count(*) AS in_bucket FROM bx JOIN sized USING (key) GROUP BY 1, 2),
           best AS (SELECT cls, sum(in_bucket)::BIGINT AS n, max(in_bucket) AS in_bucket, arg_max(bucket, in_bucket) AS bucket FROM per GROUP BY cls)
           SELECT cls, bucket, n, in_bucket FROM best JOIN base USING (bucket) WHERE n >= 20 AND in_bucket / n >= 0.9 AND images / (SELECT sum(images) FROM base) <= 0.6 AND (SELECT count(*) >= 2 AND sum(images) >= 20 FROM base)""")
def representation_skew(spark, sf):
    boxes = A.boxes(spark, sf).withColumn("cls", F.expr("CASE WHEN cls = 2 AND okey % 4 <> 0 THEN 1 ELSE cls END"))
    return classes.representation_skew(boxes, A.images(spark, sf))


@query(f"WITH {BOXES} SELECT cls, xm, ym, wm, hm, count(DISTINCT key) AS n_keys, count(*) AS n_boxes FROM boxes GROUP BY 1, 2, 3, 4, 5 HAVING count(DISTINCT key) >= 5")
def template_annotation(spark, sf):
    return classes.templates(A.boxes(spark, sf), A.SIGNATURE)


@query(f"""WITH {BOXES}, t AS (SELECT cls, xm, ym, wm, hm FROM boxes GROUP BY ALL HAVING count(DISTINCT key) >= 5 ORDER BY count(DISTINCT key) DESC, cls, xm, ym, wm, hm LIMIT 10) SELECT key, line_no FROM boxes SEMI JOIN t USING (cls, xm, ym, wm, hm)""")
def template_rows(spark, sf):
    return classes.template_hits(A.boxes(spark, sf), A.SIGNATURE).select("key", "line_no")


@query("SELECT lower(p_type) AS norm, p_type AS name FROM part GROUP BY ALL")
def normalised_names(spark, sf):
    return A.table(spark, sf, "part").select(F.col("p_type").alias("name")).distinct().select(names.normalised(F.concat(F.lit(" "), F.col("name"), F.lit("s"))).alias("norm"), "name")


@query("WITH s(split) AS (SELECT unnest(['train', 'Training', 'VAL', 'test', 'holdout', 'train2017', 'valid'])) SELECT r_name, split, CASE WHEN lower(split) IN ('train', 'train2017', 'training') THEN 'train' WHEN lower(split) IN ('val', 'valid', 'val2017', 'validation', 'test') THEN 'val' ELSE 'other' END AS role FROM region, s")
def split_roles(spark, sf):
    s = A.table(spark, sf, "region").select("r_name", F.explode(F.array(*map(F.lit, ("train", "Training", "VAL", "test", "holdout", "train2017", "valid")))).alias("split"))
    return s.withColumn("role", names.role(F.col("split")))


# --- duplicates --------------------------------------------------------------------------------
@query("SELECT md5(text) AS digest, count(*) AS n, min(CASE WHEN doc_id % 5 = 0 THEN 'val' ELSE 'train' END || '/' || doc_id) AS first_key FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, sf):
    return duplicates.exact_groups(A.documents(spark, sf), "digest")


@query(f"WITH {HASHES}, u AS (SELECT DISTINCT hash FROM hashes WHERE hash IS NOT NULL) SELECT a.hash AS a, b.hash AS b, bit_count(xor(a.hash, b.hash))::INT AS d FROM u a JOIN u b ON a.hash < b.hash AND {NEAR}")
def hamming_links(spark, sf):
    return duplicates.hash_links(A.text_hashes(spark, sf).select("hash"), bits=60)


@query(f"WITH {HASHES} SELECT DISTINCT b.key FROM hashes a JOIN hashes b ON a.split = 'train' AND b.split = 'val' AND {NEAR}")
def leakage(spark, sf):
    return duplicates.leakage(A.text_hashes(spark, sf), bits=60)


@query(f"WITH {HASHES} SELECT DISTINCT b.key, b.split FROM hashes a JOIN hashes b ON a.split = b.split AND a.doc_id <> b.doc_id AND {NEAR}")
def near_duplicates(spark, sf):
    return duplicates.near_within_split(A.text_hashes(spark, sf), bits=60)


@query(f"WITH {HASHES} SELECT b.key, b.source, max(CASE WHEN a.hash = b.hash THEN 1 ELSE 0 END) = 1 AS identical FROM hashes a JOIN hashes b ON a.source <> b.source AND {NEAR} GROUP BY 1, 2")
def cross_source_duplicates(spark, sf):
    return duplicates.across_sources(A.text_hashes(spark, sf), bits=60)


@query(f"""WITH RECURSIVE {HASHES.strip()}, u AS (SELECT DISTINCT hash FROM hashes WHERE hash IS NOT NULL), e AS (SELECT a.hash AS a, b.hash AS b FROM u a JOIN u b ON {NEAR}),
           reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
           k AS (SELECT reach.a AS hash, min(h.key) AS group_key FROM reach JOIN hashes h ON h.hash = reach.b GROUP BY 1)
           SELECT key, coalesce(group_key, key) AS group_key FROM hashes LEFT JOIN k USING (hash)""")
def duplicate_components(spark, sf):
    return duplicates.components(spark, A.text_hashes(spark, sf), bits=60)


@query(f"""WITH RECURSIVE {HASHES.strip()}, u AS (SELECT DISTINCT hash FROM hashes WHERE hash IS NOT NULL), e AS (SELECT a.hash AS a, b.hash AS b FROM u a JOIN u b ON {NEAR}),
           reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
           k AS (SELECT reach.a AS hash, min(h.key) AS group_key FROM reach JOIN hashes h ON h.hash = reach.b GROUP BY 1),
           g AS (SELECT h.doc_id, coalesce(group_key, h.key) AS group_key FROM hashes h LEFT JOIN k USING (hash))
           SELECT group_key, count(*) AS size, coalesce(list_sort(list(DISTINCT toxic) FILTER (toxic IS NOT NULL))::VARCHAR, '[]') AS classes FROM g LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def resplit_groups(spark, sf):
    h = duplicates.shared_table(spark, A.text_hashes(spark, sf).select("key", "doc_id", "hash"), "hashes")
    members = duplicates.components(spark, h, bits=60)
    boxes = h.join(A.table(spark, sf, "labels"), "doc_id").select("key", F.col("toxic").alias("cls"))
    g = resplit.groups(members, boxes)
    return g.select("group_key", "size", F.concat(F.lit("["), F.array_join("classes", ", "), F.lit("]")).alias("classes"))


@query(f"""WITH RECURSIVE {HASHES.strip()}, u AS (SELECT DISTINCT hash FROM hashes WHERE hash IS NOT NULL), e AS (SELECT a.hash AS a, b.hash AS b FROM u a JOIN u b ON {NEAR}),
           reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
           k AS (SELECT reach.a AS hash, min(h.key) AS group_key FROM reach JOIN hashes h ON h.hash = reach.b GROUP BY 1),
           g AS (SELECT h.doc_id, coalesce(group_key, h.key) AS group_key FROM hashes h LEFT JOIN k USING (hash)),
           s AS (SELECT group_key, count(*) AS size, list(DISTINCT toxic) FILTER (toxic IS NOT NULL) AS classes FROM g LEFT JOIN labels USING (doc_id) GROUP BY 1),
           o AS (SELECT *, row_number() OVER (ORDER BY size DESC, group_key) AS i, round_even(sum(size) OVER () * 0.2, 0)::BIGINT AS target FROM s),
           t AS (SELECT 0::BIGINT AS i, 0::BIGINT AS held, []::BIGINT[] AS seen, NULL::VARCHAR AS group_key, false AS took
                 UNION ALL
                 SELECT i, CASE WHEN yes THEN held + size ELSE held END, CASE WHEN yes THEN list_concat(seen, coalesce(classes, [])) ELSE seen END, group_key, yes
                 FROM (SELECT o.i, held, seen, o.group_key, size, classes,
                              held + size <= target OR (len(list_filter(coalesce(classes, []), lambda x: NOT list_contains(seen, x))) > 0 AND held + size < 1.5 * target) AS yes
                       FROM t JOIN o ON o.i = t.i + 1))
           SELECT group_key, CASE WHEN took THEN 'val' ELSE 'train' END AS split FROM t WHERE i > 0""")
def resplit_proposal(spark, sf):
    h = duplicates.shared_table(spark, A.text_hashes(spark, sf).select("key", "doc_id", "hash"), "hashes")
    members = duplicates.components(spark, h, bits=60)
    boxes = h.join(A.table(spark, sf, "labels"), "doc_id").select("key", F.col("toxic").alias("cls"))
    return resplit.propose(spark, resplit.groups(members, boxes))


PREDICTIONS = """pred AS (SELECT key, xc - w / 2 + wm / 20e6 AS x1, yc - h / 2 AS y1, xc + w / 2 + wm / 20e6 AS x2, yc + h / 2 AS y2, CASE WHEN xm % 7000 = 0 THEN (cls + 1) % 7 ELSE cls END AS predicted,
                         0.5 + (line_no % 5) / 10 AS conf, line_no AS ord FROM boxes WHERE wm > 0 AND hm > 0),
    j AS (SELECT b.key, b.line_no, b.cls, predicted, conf, ord, greatest(0, least(b.xc + b.w / 2, x2) - greatest(b.xc - b.w / 2, x1)) * greatest(0, least(b.yc + b.h / 2, y2) - greatest(b.yc - b.h / 2, y1)) AS i,
                 greatest(0, b.xc + b.w / 2 - (b.xc - b.w / 2)) * greatest(0, b.yc + b.h / 2 - (b.yc - b.h / 2)) + greatest(0, x2 - x1) * greatest(0, y2 - y1) AS s FROM boxes b JOIN pred p ON p.key = b.key),
    best AS (SELECT *, CASE WHEN i <= 0 OR s - i <= 0 THEN 0 ELSE i / (s - i) END AS iou FROM j QUALIFY row_number() OVER (PARTITION BY key, line_no ORDER BY iou DESC, ord) = 1)"""


@query(f"WITH {BOXES}, {PREDICTIONS} SELECT key, line_no, cls, predicted, CAST(round(iou * 10000) AS BIGINT) AS iou_e4 FROM best")
def iou_match(spark, sf):
    best = duplicates.best_overlap(A.boxes(spark, sf), A.predictions(spark, sf))
    return best.select("key", "line_no", "cls", "predicted", F.round(F.col("iou") * 10000).cast("long").alias("iou_e4"))


@query(f"WITH {BOXES}, {PREDICTIONS} SELECT cls, predicted, count(*) AS n FROM best WHERE iou >= 0.6 AND conf >= 0.55 AND cls <> predicted GROUP BY 1, 2 HAVING count(*) >= 2")
def class_swap(spark, sf):
    return duplicates.class_swaps(duplicates.best_overlap(A.boxes(spark, sf), A.predictions(spark, sf)))


# --- shapes ------------------------------------------------------------------------------------
#: Four or more corners on whole thousandths, some in an order that crosses.
SHAPES = """shapes AS (SELECT key, line_no, CASE WHEN line_no % 4 = 0 THEN [[xm, ym], [xm + 4000, ym + 4000], [xm + 4000, ym], [xm, ym + 4000]]
                       WHEN line_no % 4 = 1 THEN [[xm, ym], [xm + 1000, ym + 1000], [xm + 2000, ym + 2000]] ELSE [[xm, ym], [xm + wm, ym], [xm + wm, ym + hm], [xm, ym + hm]] END AS p, line_no % 4 = 0 AS crossing FROM boxes)"""


def _shapes(spark, sf) -> DataFrame:
    x, y, w, h = (F.col(c) for c in ("xm", "ym", "wm", "hm"))
    at = lambda a, b: F.struct((a / 1e6).alias("x"), (b / 1e6).alias("y"))
    kind = F.col("line_no") % 4
    bow = F.array(at(x, y), at(x + 4000, y + 4000), at(x + 4000, y), at(x, y + 4000))
    flat = F.array(at(x, y), at(x + 1000, y + 1000), at(x + 2000, y + 2000))
    square = F.array(at(x, y), at(x + w, y), at(x + w, y + h), at(x, y + h))
    return A.boxes(spark, sf).withColumn("polygon", F.when(kind == 0, bow).when(kind == 1, flat).otherwise(square))


@query(f"WITH {BOXES}, {SHAPES} SELECT 'polygon_self_intersecting' AS type, key, line_no FROM shapes WHERE crossing UNION ALL SELECT 'polygon_zero_area', key, line_no FROM shapes JOIN boxes USING (key, line_no) WHERE NOT crossing AND (line_no % 4 = 1 OR wm * hm <= 1000)")
def polygon_checks(spark, sf):
    return rows.row_hits(_shapes(spark, sf), rows.polygon_checks())


@query(f"WITH {BOXES}, {SHAPES}, t AS (SELECT key, line_no, list_sum(list_transform(range(1, len(p) + 1), lambda i: p[i][1] * p[i % len(p) + 1][2] - p[i % len(p) + 1][1] * p[i][2])) AS s FROM shapes) SELECT key, line_no, CAST(abs(s) AS BIGINT) AS double_area FROM t")
def polygon_area(spark, sf):
    return _shapes(spark, sf).select("key", "line_no", F.round(F.abs(G.shoelace(F.col("polygon"))) * 2e12).cast("long").alias("double_area"))


@query(f"""WITH {BOXES}, k AS (SELECT key, line_no, 0 AS point, xc AS x, yc AS y, (line_no % 3)::DOUBLE AS v, xc, yc, w, h FROM boxes UNION ALL SELECT key, line_no, 1, xc + w, yc, CASE WHEN line_no % 5 = 0 THEN 0.5 ELSE 2 END, xc, yc, w, h FROM boxes)
           SELECT 'keypoint_visibility_invalid' AS type, key, line_no, point FROM k WHERE v NOT IN (0, 1, 2)
           UNION ALL SELECT 'keypoint_outside_box', key, line_no, point FROM k WHERE v IN (1, 2) AND (x < xc - w / 2 - 0.02 OR x > xc + w / 2 + 0.02 OR y < yc - h / 2 - 0.02 OR y > yc + h / 2 + 0.02)""")
def keypoints(spark, sf):
    at = lambda x, v: F.struct(x.alias("x"), F.col("yc").alias("y"), v.cast("double").alias("v"))
    n = F.col("line_no")
    points = F.array(at(F.col("xc"), n % 3), at(F.col("xc") + F.col("w"), F.when(n % 5 == 0, 0.5).otherwise(2.0)))
    return rows.keypoint_hits(A.boxes(spark, sf).withColumn("keypoints", points))


# --- fixes -------------------------------------------------------------------------------------
BACK = "CAST(round(xc * 1e6) AS BIGINT) AS xm, CAST(round(yc * 1e6) AS BIGINT) AS ym, CAST(round(w * 1e6) AS BIGINT) AS wm, CAST(round(h * 1e6) AS BIGINT) AS hm"


def _back(boxes: DataFrame) -> DataFrame:
    return boxes.select("key", "line_no", "cls", *(F.round(F.col(a) * 1e6).cast("long").alias(b) for a, b in (("xc", "xm"), ("yc", "ym"), ("w", "wm"), ("h", "hm"))))


@query(f"""WITH {BOXES}, c AS (SELECT key, line_no, cls, least(greatest(xc - w / 2, 0), 1) AS x1, least(greatest(yc - h / 2, 0), 1) AS y1, least(greatest(xc + w / 2, 0), 1) AS x2, least(greatest(yc + h / 2, 0), 1) AS y2 FROM boxes),
           f AS (SELECT key, line_no, cls, (x1 + x2) / 2 AS xc, (y1 + y2) / 2 AS yc, x2 - x1 AS w, y2 - y1 AS h FROM c WHERE x2 > x1 AND y2 > y1) SELECT key, line_no, cls, {BACK} FROM f""")
def clip_boxes(spark, sf):
    return _back(apply.clip(A.boxes(spark, sf)))


@query(f"WITH {BOXES} SELECT key, line_no FROM boxes WHERE NOT {TINY}")
def drop_tiny(spark, sf):
    return apply.drop_tiny(A.boxes(spark, sf)).select("key", "line_no")


@query(f"WITH {BOXES} SELECT key, line_no FROM boxes QUALIFY row_number() OVER (PARTITION BY key, cls, xm, ym, wm, hm ORDER BY line_no) = 1")
def dedupe_boxes(spark, sf):
    return apply.dedupe(A.boxes(spark, sf)).select("key", "line_no")


@query(f"""WITH {BOXES}, {SAMPLES}, {IMAGES}, px AS (SELECT key, line_no, cls, xc * 1000 AS xc, yc * 1000 AS yc, w * 1000 AS w, h * 1000 AS h FROM boxes),
           f AS (SELECT key, line_no, cls, CASE WHEN b THEN xc / width ELSE xc END AS xc, CASE WHEN b THEN yc / height ELSE yc END AS yc, CASE WHEN b THEN w / width ELSE w END AS w, CASE WHEN b THEN h / height ELSE h END AS h
                 FROM (SELECT px.*, width, height, greatest(xc, yc, w, h) > 1.5 AND width IS NOT NULL AS b FROM px LEFT JOIN images USING (key))) SELECT key, line_no, cls, {BACK} FROM f""")
def normalise_boxes(spark, sf):
    px = A.boxes(spark, sf).select("key", "line_no", "cls", *((F.col(c) * 1000).alias(c) for c in ("xc", "yc", "w", "h")))
    return _back(apply.normalise(px, A.images(spark, sf)))


@query(f"WITH {BOXES}, s1 AS (SELECT * FROM boxes WHERE NOT {DEGENERATE}), s2 AS (SELECT * FROM s1 WHERE NOT {TINY}) SELECT key, line_no FROM s2 QUALIFY row_number() OVER (PARTITION BY key, cls, xm, ym, wm, hm ORDER BY line_no) = 1")
def fix_plan(spark, sf):
    steps = [{"action": a} for a in ("drop_degenerate_boxes", "drop_tiny_boxes", "dedupe_annotations")] + [{"action": "clip_or_drop_boxes", "requires_human_review": True}]
    return apply.apply_steps(A.boxes(spark, sf), steps).select("key", "line_no")


# --- conversions -------------------------------------------------------------------------------
@query(f"""WITH c AS (SELECT l_partkey, l_suppkey, l_linenumber, l_orderkey, (l_partkey % 645)::DOUBLE - 0.25 AS v FROM lineitem)
           SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN v > -0.5 AND v < 0 THEN 0 WHEN v > 640 AND v < 640.5 THEN 640 ELSE v END AS snapped FROM c""")
def snap_subpixel(spark, sf):
    v = (F.col("l_partkey") % 645).cast("double") - 0.25
    return A.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", G.snap(v, F.lit(640.0)).alias("snapped"))


@query("""WITH cats AS (SELECT p_size AS id, min(p_type) AS name FROM part GROUP BY 1), declared AS (SELECT * FROM cats WHERE id % 5 <> 0), ranked AS (SELECT id, dense_rank() OVER (ORDER BY id) - 1 AS cls FROM declared),
          unknown AS (SELECT id, (SELECT count(*) FROM declared) + dense_rank() OVER (ORDER BY id) - 1 AS cls FROM (SELECT DISTINCT p_size AS id FROM part WHERE p_size NOT IN (SELECT id FROM declared)))
          SELECT p_partkey, coalesce(r.cls, u.cls)::INT AS cls FROM part LEFT JOIN ranked r ON r.id = p_size LEFT JOIN unknown u ON u.id = p_size""")
def coco_classes(spark, sf):
    from .sources import coco

    part = A.table(spark, sf, "part")
    cats = part.groupBy(F.col("p_size").cast("long").alias("id")).agg(F.min("p_type").alias("name")).where("id % 5 <> 0")
    mapped = coco.class_map(cats, part.select(F.col("p_size").cast("long").alias("category_id")))
    return part.join(mapped, F.col("p_size") == F.col("category_id")).select("p_partkey", "cls")


@query("WITH n AS (SELECT p_name, dense_rank() OVER (ORDER BY p_name) - 1 AS cls FROM (SELECT DISTINCT p_name FROM part)) SELECT p_partkey, cls::INT AS cls FROM part JOIN n USING (p_name)")
def voc_classes(spark, sf):
    from .sources import voc

    part = A.table(spark, sf, "part")
    return part.join(voc.class_map(part.select(F.col("p_name").alias("name"))), F.col("p_name") == F.col("name")).select("p_partkey", "cls")


# --- merges ------------------------------------------------------------------------------------
@query(f"WITH {TAXONOMIES} SELECT cls, count(DISTINCT name) AS n_names FROM taxonomies GROUP BY cls HAVING count(DISTINCT name) > 1")
def id_collisions(spark, sf):
    return merge.id_collisions(A.taxonomies(spark, sf))


@query(f"WITH {TAXONOMIES} SELECT regexp_replace(lower(name), 's$', '') AS norm, count(DISTINCT name) AS n_names FROM taxonomies GROUP BY 1 HAVING count(DISTINCT name) > 1")
def name_variants(spark, sf):
    return merge.name_variants(A.taxonomies(spark, sf))


@query(f"WITH {TAXONOMIES}, n AS (SELECT name, (row_number() OVER (ORDER BY name) - 1)::INT AS new_id FROM (SELECT DISTINCT name FROM taxonomies)) SELECT source, cls, new_id FROM taxonomies JOIN n USING (name)")
def class_remap(spark, sf):
    return merge.remap(A.taxonomies(spark, sf))


@query("SELECT p_name AS stem, count(DISTINCT p_brand) AS n_sources FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1")
def filename_collisions(spark, sf):
    return merge.filename_collisions(A.table(spark, sf, "part").select(F.col("p_name").alias("stem"), F.col("p_brand").alias("source")))


@query(f"""WITH {TAXONOMIES}, n AS (SELECT name, (row_number() OVER (ORDER BY name) - 1)::INT AS new_id FROM (SELECT DISTINCT name FROM taxonomies)), c AS (SELECT p_name FROM part GROUP BY 1 HAVING count(DISTINCT p_brand) > 1),
           b AS (SELECT p_partkey, p_brand AS source, p_name, t.cls FROM part JOIN (SELECT source, cls, row_number() OVER (PARTITION BY source ORDER BY cls) - 1 AS i FROM taxonomies) t ON t.source = p_brand AND t.i = p_partkey % 3)
           SELECT p_partkey, new_id AS cls, CASE WHEN c.p_name IS NOT NULL THEN 's' || b.source || '_' || b.p_name ELSE b.p_name END AS stem FROM b JOIN taxonomies USING (source, cls) JOIN n USING (name) LEFT JOIN c ON c.p_name = b.p_name""")
def merged_boxes(spark, sf):
    part, tax = A.table(spark, sf, "part"), A.taxonomies(spark, sf)
    stems = part.select(F.col("p_name").alias("stem"), F.col("p_brand").alias("source"), "p_partkey", (F.col("p_partkey") % 3).cast("int").alias("cls"))
    boxes = stems.join(tax.select("source", "cls"), ["source", "cls"], "left_semi")
    return merge.merge_boxes(boxes, tax, merge.filename_collisions(stems)).select("p_partkey", "cls", "stem")


# --- fingerprints and differences --------------------------------------------------------------
MANIFEST = "man AS (SELECT 'd' || doc_id AS path, n_chars AS size, md5(coalesce(text, '')) AS sha1, doc_id FROM documents)"


def _manifest(spark, sf) -> DataFrame:
    d = A.table(spark, sf, "documents")
    return d.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.col("n_chars").alias("size"), F.md5(F.coalesce("text", F.lit("")).cast("binary")).alias("sha1"), "doc_id")


@query(f"""WITH {MANIFEST}, b AS (SELECT * FROM man WHERE doc_id % 10 <> 1), c AS (SELECT path, CASE WHEN doc_id % 10 = 3 THEN 'x' ELSE sha1 END AS sha1 FROM man WHERE doc_id % 10 <> 2)
           SELECT path, CASE WHEN b.sha1 IS NULL THEN 'added' WHEN c.sha1 IS NULL THEN 'removed' ELSE 'modified' END AS status FROM b FULL JOIN c USING (path) WHERE b.sha1 IS DISTINCT FROM c.sha1""")
def manifest_diff(spark, sf):
    m = _manifest(spark, sf)
    after = m.where("doc_id % 10 <> 2").withColumn("sha1", F.when(F.col("doc_id") % 10 == 3, "x").otherwise(F.col("sha1")))
    return manifest.difference(m.where("doc_id % 10 <> 1"), after)


@query(f"WITH {MANIFEST} SELECT substr(sha256(path), 1, 3) AS bucket, count(*) AS n, sha256(string_agg(path || chr(0) || sha1 || chr(10), '' ORDER BY path)) AS digest FROM man GROUP BY 1")
def bucket_digests(spark, sf):
    return manifest.bucket_digests(_manifest(spark, sf))


@query(f"WITH {MANIFEST} SELECT count(*) AS files, coalesce(sum(size), 0)::BIGINT AS bytes FROM man")
def manifest_totals(spark, sf):
    return manifest.totals(_manifest(spark, sf))


@query(f"WITH {MANIFEST} SELECT sha256(string_agg(path || chr(0) || sha1 || chr(10), '' ORDER BY path)) AS digest FROM man")
def dataset_digest(spark, sf):
    return spark.createDataFrame([(manifest.digest(_manifest(spark, sf)),)], "digest string")


FACTS = f"WITH {BOXES}, {REPEATS}, {HITS}, facts AS (SELECT DISTINCT type, key FROM hits)"
NUMBER_OF = "split_part(key, '/', 2)::BIGINT"


def _facts(spark, sf) -> DataFrame:
    return _hits(spark, sf).select("type", "key", F.element_at(F.split("key", "/"), 2).cast("long").alias("n")).distinct()


@query(f"""{FACTS}, b AS (SELECT * FROM facts WHERE {NUMBER_OF} % 4 <> 0), c AS (SELECT * FROM facts WHERE {NUMBER_OF} % 4 <> 1)
           SELECT CASE WHEN c.key IS NULL THEN 'resolved' WHEN b.key IS NULL THEN 'introduced' ELSE 'remaining' END AS status, type, key AS item FROM (SELECT type, key FROM b UNION SELECT type, key FROM c) u LEFT JOIN b USING (type, key) LEFT JOIN c USING (type, key)""")
def recheck(spark, sf):
    f = _facts(spark, sf).withColumnRenamed("key", "item")
    return findings.recheck(f.where("n % 4 <> 0"), f.where("n % 4 <> 1"))


@query(f"{GEOMETRY} SELECT severity, count(*) AS n FROM found WHERE category = 'trainability' GROUP BY 1")
def severity_counts(spark, sf):
    return findings.severity_counts(findings.findings(spark, _hits(spark, sf)))


@query(f"{GEOMETRY} SELECT CASE min(severity_rank) FILTER (category = 'trainability') WHEN 0 THEN 'blocked' WHEN 1 THEN 'fix_before_training' ELSE 'usable_with_caveats' END AS verdict FROM found")
def verdict(spark, sf):
    return findings.verdict(findings.findings(spark, _hits(spark, sf)))


@query(f"""{FACTS}, t AS (SELECT * FROM facts WHERE {NUMBER_OF} % 5 <> 1), rep AS (SELECT * FROM facts WHERE {NUMBER_OF} % 5 <> 2), col AS (SELECT * FROM facts WHERE {NUMBER_OF} % 10 = 1),
           n AS (SELECT (SELECT count(*) FROM (SELECT * FROM t INTERSECT SELECT * FROM rep)) AS hits, (SELECT count(*) FROM (SELECT * FROM t EXCEPT SELECT * FROM rep)) AS misses,
                        (SELECT count(*) FROM (SELECT * FROM rep EXCEPT SELECT * FROM t EXCEPT SELECT * FROM col)) AS false_positives, (SELECT count(*) FROM (SELECT * FROM rep EXCEPT SELECT * FROM col)) AS scored)
           SELECT *, CASE WHEN hits + misses > 0 THEN hits / (hits + misses) ELSE 1.0 END AS recall, CASE WHEN scored > 0 THEN hits / scored ELSE 1.0 END AS "precision" FROM n""")
def fact_score(spark, sf):
    f = _facts(spark, sf)
    return findings.score(f.where("n % 5 <> 1"), f.where("n % 5 <> 2"), f.where("n % 10 = 1"))


@query("""WITH s AS (SELECT o_orderpriority AS arm, count(*) FILTER (o_orderstatus = 'F') AS hits, count(*) FILTER (o_orderstatus = 'O') AS misses, count(*) FILTER (o_orderstatus = 'P') AS false_positives FROM orders GROUP BY 1)
          SELECT arm, hits, misses, false_positives, hits / (hits + misses) AS recall, hits / (hits + false_positives) AS "precision", 2 * hits / (hits + misses + hits + false_positives) AS f1 FROM s""")
def score_by_arm(spark, sf):
    o = A.table(spark, sf, "orders")
    n = o.groupBy(F.col("o_orderpriority").alias("arm"), F.year("o_orderdate").alias("run")).agg(*(F.count_if(F.col("o_orderstatus") == s).alias(a) for a, s in (("hits", "F"), ("misses", "O"), ("false_positives", "P"))))
    return findings.score_by_arm(n)


@query("SELECT c_mktsegment AS arm, 'nation' AS measure, avg(c_nationkey) AS mean, min(c_nationkey) AS low, max(c_nationkey) AS high FROM customer GROUP BY 1")
def run_summary(spark, sf):
    return findings.summarise_runs(A.table(spark, sf, "customer").select(F.col("c_mktsegment").alias("arm"), F.lit("nation").alias("measure"), F.col("c_nationkey").alias("value")))


@query(f"{FACTS} SELECT type, key FROM facts WHERE {NUMBER_OF} % 3 <> 0")
def base_rate(spark, sf):
    f = _facts(spark, sf)
    return findings.beyond_base_rate(f, f.where("n % 3 = 0")).select("type", "key")


@query(f"""WITH {BOXES}, a AS (SELECT 'class' || cls AS measure, count(*) AS n FROM boxes WHERE split = 'train' AND cls <> 3 GROUP BY 1), b AS (SELECT 'class' || cls AS measure, count(*) AS n FROM boxes WHERE split = 'val' AND cls <> 4 GROUP BY 1)
           SELECT measure, coalesce(a.n, 0) AS a, coalesce(b.n, 0) AS b, coalesce(b.n, 0) - coalesce(a.n, 0) AS delta FROM a FULL JOIN b USING (measure)""")
def diff_table(spark, sf):
    b = A.boxes(spark, sf)
    per = lambda df: df.groupBy(F.concat(F.lit("class"), F.col("cls").cast("string")).alias("measure")).agg(F.count("*").alias("n"))
    return findings.difference(per(b.where("split = 'train' AND cls <> 3")), per(b.where("split = 'val' AND cls <> 4")))


@query(f"{FACTS} SELECT type FROM facts WHERE type <> 'tiny_box' EXCEPT SELECT type FROM facts WHERE type <> 'out_of_bounds'")
def types_only_in_one(spark, sf):
    f = _facts(spark, sf)
    return findings.types_only_in(f.where("type <> 'tiny_box'"), f.where("type <> 'out_of_bounds'"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k.type}', '{k.severity}', {k.severity_rank}, '{k.category}', {repr(k.action) if k.action else 'NULL'})" for k in vocab.kinds()) + ") AS v(type, severity, severity_rank, category, action)")
def vocabulary(spark, sf):
    return vocab.table(spark)
