"""Queries of the general data-curation operators, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seston.operators.bad_records import split_records, typed_records
from seston.operators.orphans import OrphanTracker, parent_rows, reference_rows
from seston.operators.small_files import compact
from seston.operators.schema_drift import Drift, plain
from seston.runtime import read, settle


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of ``lst_lines`` that fail, out of the full parse."""
    parsed = split_records(read(spark, sf_dir, "lst_lines"))
    return parsed.filter("reason IS NOT NULL").select("lst_name", "line_no").distinct()


def p2_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Number of distinct records by reason, null of those that parse."""
    parsed = split_records(read(spark, sf_dir, "lst_lines"))
    return parsed.select("lst_name", "line_no", "reason").distinct().groupBy("reason").agg(F.count("*").alias("n_records"))


def p2_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that parse, typed by their own files' headers."""
    fields = {"id": "int32", "collage_file": "string", "image_x": "int32", "image_y": "int32", "image_w": "int32", "image_h": "int32", "area": "double", "abd_area": "double", "elapsed_time": "double"}
    return typed_records(split_records(read(spark, sf_dir, "lst_lines")), fields).select("lst_name", "line_no", *(c for c in fields if c != "area"), F.size("failed").alias("n_failed")).distinct()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that add no record, as the consolidation of ``image_files`` reports them."""
    return compact(read(spark, sf_dir, "image_files")).dropped


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with output files of 64 KiB of content: how many there are, what they hold together, and the most full against the mean."""
    made = compact(read(spark, sf_dir, "image_files"), target_bytes=64 * 1024)
    size = read(spark, sf_dir, "image_files").select("file_id", F.length("image_data").alias("n")).distinct()
    part = made.kept.join(size, "file_id").groupBy("part").agg(F.count("*").alias("rows"), F.sum("n").alias("bytes"))
    return part.agg(F.count("*").alias("n_files"), F.sum("rows").alias("n_records"), F.sum("bytes").alias("n_bytes"), (F.max("bytes") <= F.avg("bytes") * 1.1 + 16384).alias("balanced"))


def _drift(spark: SparkSession, sf_dir: str) -> Drift:
    return Drift(read(spark, sf_dir, "ecotaxa_meta"), file="archive_id", source="project_id", at="exported_at", object="object_id", meta="meta")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes of each archive's fields against the previous archive of its project."""
    changes = _drift(spark, sf_dir).changes
    kind = F.when(F.col("kind") == "moved", "renamed").otherwise(F.col("kind")).alias("kind")
    return changes.select(F.col("file").alias("archive_id"), kind, plain(F.col("old_field")).alias("old_field"), plain(F.col("new_field")).alias("new_field"))


def p5_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All meta as one table: a row for each record, the lasting fields as typed columns."""
    table = _drift(spark, sf_dir).columns()
    rest = [c for c in table.columns[4:] if c.lower() not in ("archive_id", "object_id", "exported_at")]
    return table.select(F.col("file").alias("archive_id"), F.col("object").alias("object_id"), F.col("at").alias("exported_at"), *(F.col(f"`{c}`") for c in rest))


def p5_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per archive and lasting field, how many records hold a value of it."""
    table = _drift(spark, sf_dir).table()
    entry = table.select(F.col("file").alias("archive_id"), F.explode("meta").alias("field", "v"))
    return entry.groupBy("archive_id", plain(F.col("field")).alias("field")).agg(F.count("*").alias("n_values"))


def _tracked(spark: SparkSession, sf_dir: str) -> OrphanTracker:
    """References and parents as they arrive: first the objects' references with the parents registered up to the middle of all times, none of them deleted yet; then
    the files' references with the later parents, which resolve orphans; then the deletions, which reopen some."""
    samples = read(spark, sf_dir, "samples")
    parents = settle(parent_rows(samples, "sample_id", "registered_at", "deleted_at"), "samples")
    span = parents.agg(F.min("since"), F.max("since")).first()
    middle = F.lit(span[0] + (span[1] - span[0]) / 2 if span[0] else None).cast("timestamp_ntz")
    born = parents.withColumn("until", F.lit(None).cast("timestamp_ntz"))
    tracker = OrphanTracker(spark)
    tracker.advance(reference_rows(read(spark, sf_dir, "zoo_features"), "zoo_features", "sample_id", "acquired_at"), born.filter(F.col("since") <= middle))
    tracker.advance(reference_rows(read(spark, sf_dir, "image_files"), "image_files", "sample_id", "written_at"), born.filter(F.col("since") > middle))
    return tracker.advance(deletions=parents.filter("until IS NOT NULL"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orphan references per table and month after parents, references and deletions have arrived in three steps."""
    return _tracked(spark, sf_dir).report().withColumnRenamed("key", "sample_id").select("tab", "yyyymm", "sample_id")


def p7_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of orphan references and keys per table and month after each of the three steps."""
    return _tracked(spark, sf_dir).snapshots().select("step", "tab", "yyyymm", "n", "n_keys")


QUERIES = {"p2_found": p2_found, "p2_reasons": p2_reasons, "p2_rows": p2_rows, "p4_found": p4_found, "p4_groups": p4_groups, "p5_found": p5_found, "p5_table": p5_table, "p5_values": p5_values, "p7_found": p7_found, "p7_snapshots": p7_snapshots}

_P2 = """
        WITH n AS (SELECT lst_name, max(CAST(regexp_extract(line_text, '^num-fields\\|(\\d+)$', 1) AS INTEGER)) AS n FROM lst_lines WHERE line_no = 2 GROUP BY 1),
        h AS (
            SELECT l.lst_name, n.n,
                max(CASE WHEN line_text LIKE 'collage_file|%' THEN line_no - 2 END) AS c,
                max(CASE WHEN line_text LIKE 'image_x|%' THEN line_no - 2 END) AS x,
                max(CASE WHEN line_text LIKE 'image_w|%' THEN line_no - 2 END) AS w
            FROM lst_lines l JOIN n ON l.lst_name = n.lst_name WHERE line_no BETWEEN 3 AND n + 2 GROUP BY 1, 2),
        r AS (
            SELECT DISTINCT l.lst_name, l.line_no, h.n, h.c, h.x, h.w,
                regexp_matches(line_text, '^("([^"]|"")*"[^"|]*|[^"|][^|]*|)(\\|("([^"]|"")*"[^"|]*|[^"|][^|]*|))*$') AS closed,
                regexp_extract_all('|' || line_text, '\\|("(?:[^"]|"")*"[^"|]*|[^"|][^|]*|)', 1) AS f
            FROM lst_lines l JOIN h ON l.lst_name = h.lst_name WHERE l.line_no > h.n + 2 AND length(line_text) > 0),
        v AS (SELECT *, trim(f[x], '" ' || chr(9)) AS vx, trim(f[w], '" ' || chr(9)) AS vw, trim(f[c], '"') AS vc FROM r)"""

SQL = {
    "p4_found": """
        WITH f AS (SELECT file_id, image_data, nullif(lower(trim(object_id, ' ' || chr(9) || chr(10) || chr(13))), '') AS k, octet_length(image_data) AS n FROM image_files),
        m AS (SELECT k, image_data, min(file_id) AS first_id FROM f WHERE n > 0 AND k IS NOT NULL GROUP BY 1, 2)
        SELECT f.file_id FROM f LEFT JOIN m ON f.k = m.k AND f.image_data = m.image_data
        WHERE f.n IS NULL OR f.n = 0 OR m.first_id < f.file_id""",
    "p4_groups": """
        WITH f AS (SELECT DISTINCT file_id, image_data, coalesce('k' || nullif(lower(trim(object_id, ' ' || chr(9) || chr(10) || chr(13))), ''), 'i' || file_id) AS k FROM image_files WHERE octet_length(image_data) > 0),
        u AS (SELECT DISTINCT k, image_data, octet_length(image_data) AS n FROM f)
        SELECT CAST(greatest(1, ceil(sum(n) / 65536)) AS BIGINT) AS n_files, count(*) AS n_records, CAST(sum(n) AS BIGINT) AS n_bytes, true AS balanced FROM u""",
    "p7_found": """
        WITH r AS (
            SELECT 'zoo_features' AS tab, lower(trim(sample_id, ' ' || chr(9) || chr(10) || chr(13))) AS sample_id, acquired_at AS t FROM zoo_features
            UNION ALL SELECT 'image_files', lower(trim(sample_id, ' ' || chr(9) || chr(10) || chr(13))), written_at FROM image_files),
        s AS (SELECT lower(trim(sample_id, ' ' || chr(9) || chr(10) || chr(13))) AS k, registered_at, deleted_at FROM samples)
        SELECT DISTINCT tab, CAST(strftime(t, '%Y%m') AS INTEGER) AS yyyymm, sample_id FROM r
        WHERE sample_id IS NOT NULL AND t IS NOT NULL AND NOT EXISTS (
            SELECT 1 FROM s WHERE s.k = r.sample_id AND s.registered_at <= r.t + INTERVAL 7 DAY AND (s.deleted_at IS NULL OR s.deleted_at > r.t))""",
    "p7_snapshots": """
        WITH k AS (SELECT lower(trim(sample_id, ' ' || chr(9) || chr(10) || chr(13))) AS k, registered_at - INTERVAL 7 DAY AS since, deleted_at FROM samples WHERE sample_id IS NOT NULL AND registered_at IS NOT NULL),
        mid AS (SELECT min(since) + (max(since) - min(since)) / 2 AS m FROM k),
        r AS (
            SELECT 'zoo_features' AS tab, lower(trim(sample_id, ' ' || chr(9) || chr(10) || chr(13))) AS sample_id, acquired_at AS t, 1 AS arrives FROM zoo_features
            UNION ALL SELECT 'image_files', lower(trim(sample_id, ' ' || chr(9) || chr(10) || chr(13))), written_at, 2 FROM image_files),
        s AS (SELECT unnest([1, 2, 3]) AS step),
        o AS (SELECT s.step, r.* FROM r, s, mid WHERE r.arrives <= s.step AND sample_id IS NOT NULL AND t IS NOT NULL AND NOT EXISTS (
            SELECT 1 FROM k WHERE k.k = r.sample_id AND k.since <= r.t AND (s.step >= 2 OR k.since <= mid.m) AND (s.step < 3 OR k.deleted_at IS NULL OR k.deleted_at > r.t)))
        SELECT CAST(step AS INTEGER) AS step, tab, CAST(strftime(t, '%Y%m') AS INTEGER) AS yyyymm, CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT sample_id) AS BIGINT) AS n_keys FROM o GROUP BY 1, 2, 3""",
    "p5_found": """
        WITH m AS (SELECT archive_id, project_id, exported_at, lower(trim(object_id, ' ' || chr(9) || chr(10) || chr(13))) AS o, TRY_CAST(meta AS JSON) AS j FROM ecotaxa_meta WHERE archive_id IS NOT NULL AND project_id IS NOT NULL),
        l AS (SELECT m.archive_id AS a, m.project_id AS p, m.o, e.key AS f, CASE e.type WHEN 'VARCHAR' THEN 'string' WHEN 'BOOLEAN' THEN 'boolean' ELSE 'number' END AS t,
                     CASE WHEN e.type IN ('VARCHAR', 'BOOLEAN') THEN e.atom ->> '$' ELSE CAST(CAST(e.atom AS DOUBLE) AS VARCHAR) END AS v
              FROM m, json_each(m.j) e WHERE e.type <> 'NULL'),
        c AS (SELECT a, p, f, t, count(*) AS n FROM l GROUP BY ALL),
        d AS (SELECT a, p, f, t FROM c QUALIFY row_number() OVER (PARTITION BY a, p, f ORDER BY n DESC, CASE t WHEN 'number' THEN 0 WHEN 'boolean' THEN 1 ELSE 2 END) = 1),
        s AS (SELECT a, lag(a) OVER (PARTITION BY p ORDER BY made NULLS FIRST, a) AS b FROM (SELECT archive_id AS a, project_id AS p, min(exported_at) AS made FROM m GROUP BY ALL)),
        x AS (SELECT coalesce(n.a, o.a) AS a, coalesce(n.b, o.b) AS b, coalesce(n.f, o.f) AS f, o.t AS t0, n.t AS t1
              FROM (SELECT s.a, s.b, d.f, d.t FROM s JOIN d ON d.a = s.a WHERE s.b IS NOT NULL) n FULL JOIN (SELECT s.a, s.b, d.f, d.t FROM s JOIN d ON d.a = s.b) o ON n.a = o.a AND n.f = o.f),
        g AS (SELECT DISTINCT x.a, l.o, x.f, l.v FROM x JOIN l ON l.a = x.b AND l.f = x.f AND l.t = x.t0 WHERE x.t1 IS NULL AND l.o IS NOT NULL),
        h AS (SELECT DISTINCT x.a, l.o, x.f, l.v FROM x JOIN l ON l.a = x.a AND l.f = x.f AND l.t = x.t1 WHERE x.t0 IS NULL AND l.o IS NOT NULL),
        q AS (SELECT a, fo, fn, avg(hit) AS share FROM (SELECT g.a, g.o, g.f AS fo, h.f AS fn, max(CASE WHEN g.v = h.v THEN 1.0 ELSE 0.0 END) AS hit FROM g JOIN h ON g.a = h.a AND g.o = h.o GROUP BY ALL) GROUP BY ALL HAVING avg(hit) >= 0.8),
        r AS (SELECT a, fo, fn FROM q QUALIFY row_number() OVER (PARTITION BY a, fo ORDER BY share DESC, fn) = 1 AND row_number() OVER (PARTITION BY a, fn ORDER BY share DESC, fo) = 1)
        SELECT a AS archive_id, 'renamed' AS kind, fo AS old_field, fn AS new_field FROM r
        UNION ALL SELECT a, 'removed', f, '' FROM x WHERE t1 IS NULL AND NOT EXISTS (SELECT 1 FROM r WHERE r.a = x.a AND r.fo = x.f)
        UNION ALL SELECT a, 'added', '', f FROM x WHERE t0 IS NULL AND NOT EXISTS (SELECT 1 FROM r WHERE r.a = x.a AND r.fn = x.f)
        UNION ALL SELECT a, 'retyped', f, f FROM x WHERE t0 <> t1""",
    "p2_found": _P2 + """
        SELECT lst_name, line_no FROM v
        WHERE NOT closed OR len(f) <> n
            OR NOT regexp_full_match(vx, '[+-]?[0-9]+') OR NOT regexp_full_match(vw, '[+-]?[0-9]+')
            OR coalesce(TRY_CAST(vx AS INTEGER), -1) < 0 OR coalesce(TRY_CAST(vw AS INTEGER), 0) < 1
            OR NOT ends_with(lower(vc), '.tif')""",
    "p2_reasons": _P2 + """
        SELECT CASE
            WHEN NOT closed THEN 'open_quote' WHEN len(f) < n THEN 'too_few_columns' WHEN len(f) > n THEN 'too_many_columns' WHEN NOT ends_with(lower(vc), '.tif') THEN 'collage_file_suffix'
            WHEN NOT regexp_full_match(vx, '[+-]?[0-9]+') OR TRY_CAST(vx AS INTEGER) IS NULL THEN 'image_x_not_int32' WHEN TRY_CAST(vx AS INTEGER) < 0 THEN 'image_x_range'
            WHEN NOT regexp_full_match(vw, '[+-]?[0-9]+') OR TRY_CAST(vw AS INTEGER) IS NULL THEN 'image_w_not_int32' WHEN TRY_CAST(vw AS INTEGER) < 1 THEN 'image_w_range' END AS reason,
            count(*) AS n_records
        FROM v GROUP BY 1""",
}
