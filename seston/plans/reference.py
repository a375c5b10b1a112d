"""Queries of the stream, window, expression, image and source operators over whole tables, each with SQL that gives the same."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seston.functions.expressions import apply
from seston.functions.text import format_text, parse_text
from seston.operators import features, images, joins, models, order, recursive, stream, windows
from seston.runtime import read, scratch

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def note(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return note


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events")


# ---- rows


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_discount FROM lineitem WHERE l_discount <> 0")
def filter_truthy(spark, sf_dir):
    """Rows whose discount is true, that is not 0 and not null."""
    return stream.keep_columns(stream.filter_rows(read(spark, sf_dir, "lineitem"), "l_discount"), "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_discount")


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
def select_columns(spark, sf_dir):
    """Some columns."""
    return stream.keep_columns(read(spark, sf_dir, "orders"), "o_orderkey", "o_custkey", "o_orderpriority")


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def drop_columns(spark, sf_dir):
    """All but some columns."""
    return stream.drop_columns(read(spark, sf_dir, "orders"), "o_orderstatus", "o_orderdate", "o_orderpriority")


@query("SELECT event_id, value FROM events ORDER BY event_id LIMIT 400 OFFSET 100")
def slice_range(spark, sf_dir):
    """Rows 100 to 500 of the stream: a limit is what a slice is."""
    return order.slice_rows(_events(spark, sf_dir).select("event_id", "value"), "event_id", 100, 500)


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS i FROM events) WHERE i >= 10 AND (i - 10) % 7 = 0")
def slice_step(spark, sf_dir):
    """Every seventh row from the tenth."""
    return order.slice_rows(_events(spark, sf_dir).select("event_id"), "event_id", 10, None, 7)


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) + 4 AS index FROM events")
def enumerate_rows(spark, sf_dir):
    """The running number in order of time."""
    return order.enumerate_rows(_events(spark, sf_dir).select("event_id", "ts"), ["ts", "event_id"], 5).select("event_id", "index")


@query("SELECT event_id, count(*) OVER () - row_number() OVER (ORDER BY event_id) + 1 AS remaining FROM events")
def remaining_hint(spark, sf_dir):
    """How many rows are still to come."""
    return order.remaining_hint(_events(spark, sf_dir).select("event_id"), "event_id")


@query("SELECT doc_id, CAST(i - 1 AS INTEGER) AS place, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents))")
def unpack_words(spark, sf_dir):
    """A row for each word of each document."""
    return stream.unpack_rows(read(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("words")), "words", "word", "place").drop("words")


@query("SELECT n_nationkey, CAST(i - 1 AS INTEGER) AS place, n_name[i] AS letter FROM (SELECT n_nationkey, n_name, unnest(range(1, length(n_name) + 1)) AS i FROM nation)")
def unpack_text(spark, sf_dir):
    """A text unpacks into its characters."""
    return stream.unpack_rows(read(spark, sf_dir, "nation").select("n_nationkey", "n_name"), "n_name", "letter", "place").drop("n_name")


@query("SELECT c_custkey, value FROM customer, (VALUES (2), (3), (5)) AS t(value)")
def unpack_literal(spark, sf_dir):
    """Each row with each value of a literal collection."""
    return stream.unpack_rows(read(spark, sf_dir, "customer").select("c_custkey"), [2, 3, 5])


@query("""
    SELECT min(event_id) AS event_id, arg_min(event_type, event_id) AS event_type, count(*) AS n,
           string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids, round(sum(value), 4) AS total
    FROM (SELECT *, (row_number() OVER (ORDER BY event_id) - 1) // 7 AS g FROM events) GROUP BY g""")
def pack_rows(spark, sf_dir):
    """Seven rows in one."""
    src = _events(spark, sf_dir).select("event_id", "event_type", "value", F.col("event_id").alias("id"))
    packed = stream.pack_rows(src, 7, ["value", "id"], "event_id")
    return packed.select("event_id", "event_type", F.size("id").cast("long").alias("n"), F.array_join(F.transform("id", lambda x: x.cast("string")), ",").alias("ids"), F.round(F.aggregate("value", F.lit(0.0), lambda a, b: a + b), 4).alias("total"))


_RUNS = """
    WITH e AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS i, event_type IS DISTINCT FROM lag(event_type) OVER (ORDER BY event_id) AS c FROM events),
    r AS (SELECT *, sum(CASE WHEN c OR i = 0 THEN 1 ELSE 0 END) OVER (ORDER BY event_id) - 1 AS run FROM e),
    p AS (SELECT *, i - min(i) OVER (PARTITION BY run) AS place FROM r)"""


@query(_RUNS + " SELECT event_id, CAST(run AS BIGINT) AS run, place FROM p")
def runs(spark, sf_dir):
    """Runs of equal event types."""
    return order.runs(_events(spark, sf_dir).select("event_id", "event_type"), ["event_type"], "event_id", "run", "place").select("event_id", "run", "place")


@query(_RUNS + " SELECT event_type, count(*) AS n, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY event_id) AS ids FROM p GROUP BY run, place // 2, event_type")
def batch_groupby(spark, sf_dir):
    """Batches of at most two rows of a run."""
    out = stream.batch_rows(_events(spark, sf_dir).select("event_id", "event_type"), 2, "event_id", ["event_type"])
    return out.select("event_type", F.size("event_id").cast("long").alias("n"), F.array_join(F.transform("event_id", lambda x: x.cast("string")), ",").alias("ids"))


@query("""
    SELECT event_id, round(value - avg(value) OVER (PARTITION BY g), 6) AS centred
    FROM (SELECT *, (row_number() OVER (ORDER BY event_id) - 1) // 64 AS g FROM events)""")
def batched_work(spark, sf_dir):
    """Work on batches of 64 rows, then single rows again."""

    def work(df: DataFrame) -> DataFrame:
        mean = F.aggregate("value", F.lit(0.0), lambda a, b: a + b) / F.size("value")
        return df.withColumn("m", mean).withColumn("centred", F.transform("value", lambda v: v - F.col("m"))).drop("m")

    out = stream.batched(_events(spark, sf_dir).select("event_id", "value"), 64, "event_id", work)
    return out.select("event_id", F.round("centred", 6).alias("centred"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def keep_first(spark, sf_dir):
    """The first order of each customer."""
    return stream.keep_first(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], "o_orderkey")


@query("""
    WITH f AS (SELECT object_id, img_rank, arg_min(n_bytes, file_id) AS n_bytes, min(file_id) AS file_id FROM (SELECT object_id, img_rank, file_id, coalesce(n_bytes, -1) AS n_bytes FROM image_files) WHERE object_id IS NOT NULL AND img_rank IS NOT NULL GROUP BY 1, 2)
    SELECT object_id, min(file_id) AS file_id, string_agg(img_rank || ':' || n_bytes, ',' ORDER BY img_rank) AS images FROM f GROUP BY 1""")
def first_with_map(spark, sf_dir):
    """Objects with their images by rank."""
    src = read(spark, sf_dir, "image_files").select("object_id", "img_rank", F.coalesce("n_bytes", F.lit(-1)).alias("n_bytes"), "file_id")
    out = stream.first_with_map(src, "object_id", "img_rank", "n_bytes", "file_id")
    entries = F.array_sort(F.map_entries("n_bytess"))
    return out.select("object_id", "file_id", F.array_join(F.transform(entries, lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), ",").alias("images"))


@query("SELECT c_custkey, c_name, c_nationkey, n_name, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey")
def lookup_join(spark, sf_dir):
    """Customers with the name and region of their nation; a missing or doubled key would be an error."""
    nation = read(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    return joins.lookup_join(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), nation, "c_nationkey", ["n_name", "n_regionkey"])


# ---- expressions


@query("""
    SELECT p_partkey, a // 7 - CASE WHEN a % 7 <> 0 AND a < 0 THEN 1 ELSE 0 END AS floordiv, ((a % 7) + 7) % 7 AS mod,
           -(a // 7 + CASE WHEN a % 7 <> 0 AND a > 0 THEN 1 ELSE 0 END) AS floordiv_neg, CASE WHEN a % 7 > 0 THEN a % 7 - 7 ELSE a % 7 END AS mod_neg,
           a * a * a AS cube, a / 4.0 AS div, a + 3 AS plus, 3 - a AS minus, a * 2 AS twice, abs(a) AS magnitude, -a AS negative, round(sqrt(p_retailprice), 6) AS root
    FROM (SELECT *, CAST(p_size AS BIGINT) - 25 AS a FROM part)""")
def arithmetic(spark, sf_dir):
    """Python's arithmetic on positive and negative numbers."""
    df = read(spark, sf_dir, "part").withColumn("a", F.col("p_size").cast("long") - 25)
    a = F.col("a")
    made = {
        "floordiv": apply(df, "floordiv", a, 7), "mod": apply(df, "mod", a, 7), "floordiv_neg": apply(df, "floordiv", a, -7), "mod_neg": apply(df, "mod", a, -7),
        "cube": apply(df, "pow", a, 3), "div": apply(df, "truediv", a, 4), "plus": apply(df, "add", a, 3), "minus": apply(df, "sub", 3, a),
        "twice": apply(df, "mul", a, 2), "magnitude": apply(df, "abs", a), "negative": apply(df, "neg", a), "root": F.round(apply(df, "pow", F.col("p_retailprice"), 0.5), 6),
    }
    return df.select("p_partkey", *(c.alias(n) for n, c in made.items()))


@query("""
    SELECT p_partkey, a << 5 AS shl, a >> 2 AS shr, a & 12 AS band, a | 3 AS bor, xor(a, 10) AS bxor, -a - 1 AS inv
    FROM (SELECT *, CAST(p_size AS BIGINT) AS a FROM part)""")
def bits(spark, sf_dir):
    """Shifts and bitwise operators."""
    df = read(spark, sf_dir, "part")
    a = F.col("p_size")
    made = {"shl": ("lshift", 5), "shr": ("rshift", 2), "band": ("and", 12), "bor": ("or", 3), "bxor": ("xor", 10)}
    return df.select("p_partkey", *(apply(df, op, a, k).alias(n) for n, (op, k) in made.items()), apply(df, "invert", a).alias("inv"))


@query("""
    SELECT doc_id, party IS NOT DISTINCT FROM lang AS same, party IS DISTINCT FROM 'PRD' AS other, n_chars < 500 AS short, n_chars >= 500 AS long,
           text IS NOT NULL AND length(text) > 0 AS filled, coalesce(n_chars, 0) = 0 AS nothing, party IS NULL AS none, contains(text, 'budget') AS has, coalesce(lang IN ('en', 'de'), false) AS known
    FROM documents""")
def comparisons(spark, sf_dir):
    """Equality with nulls, order, truth, identity and membership."""
    df = read(spark, sf_dir, "documents")
    c = F.col
    return df.select(
        "doc_id", apply(df, "eq", c("party"), c("lang")).alias("same"), apply(df, "ne", c("party"), "PRD").alias("other"), apply(df, "lt", c("n_chars"), 500).alias("short"),
        apply(df, "ge", c("n_chars"), 500).alias("long"), apply(df, "truth", c("text")).alias("filled"), apply(df, "not", c("n_chars")).alias("nothing"), apply(df, "is", c("party"), None).alias("none"),
        apply(df, "contains", c("text"), "budget").alias("has"), apply(df, "in", c("lang"), ["en", "de"]).alias("known"),
    )


@query("""
    SELECT p_partkey, w[1] AS first, w[len(w)] AS last, p_name[3] AS third, p_name[2:4] AS part, array_to_string(w[2:], ' ') AS rest, array_to_string(list_reverse(w), ' ') AS back,
           p_name || '!' AS joined, repeat(p_brand, 2) AS doubled, array_to_string(list_concat(['x'], w[2:]), ' ') AS changed
    FROM (SELECT *, string_split(p_name, ' ') AS w FROM part)""")
def items(spark, sf_dir):
    """Indexing, slices, and copies with an item changed or left out."""
    from seston.functions import expressions as X

    df = read(spark, sf_dir, "part").withColumn("w", F.split("p_name", " "))
    w, name = X.typed(df, F.col("w")), X.typed(df, F.col("p_name"))
    k = lambda i: X.typed(df, i)
    text = lambda x: F.array_join(x.col, " ")
    return df.select(
        "p_partkey", X.getitem(w, k(0)).col.alias("first"), X.getitem(w, k(-1)).col.alias("last"), X.getitem(name, k(2)).col.alias("third"), X.getslice(name, 1, 4).col.alias("part"),
        text(X.delitem(w, k(0))).alias("rest"), text(X.getslice(w, None, None, -1)).alias("back"), X.add(name, k("!")).col.alias("joined"), X.mul(X.typed(df, F.col("p_brand")), k(2)).col.alias("doubled"),
        text(X.setitem(w, k(0), k("x"))).alias("changed"),
    )


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS dot FROM embeddings")
def matmul(spark, sf_dir):
    """The product of each vector with itself."""
    df = read(spark, sf_dir, "embeddings")
    return df.select("vec_id", F.round(apply(df, "matmul", F.col("embedding"), F.col("embedding")), 6).alias("dot"))


@query("SELECT c_custkey, 'c' || lpad(CAST(c_custkey AS VARCHAR), 7, '0') || ' of ' || c_nationkey || ': ' || rpad(c_mktsegment, 12, ' ') || '|' AS label FROM customer")
def format_rows(spark, sf_dir):
    """Texts by a pattern."""
    df = read(spark, sf_dir, "customer")
    return df.select("c_custkey", format_text(df, "c{:07d} of {nation}: {seg:12}|", F.col("c_custkey"), nation=F.col("c_nationkey"), seg=F.col("c_mktsegment")).alias("label"))


@query("SELECT c_custkey, CAST(regexp_extract(c_name, '#(\\d+)$', 1) AS BIGINT) AS number, regexp_extract(c_name, '^(\\w+)#', 1) AS kind FROM customer")
def parse_rows(spark, sf_dir):
    """Typed fields by a pattern."""
    df = read(spark, sf_dir, "customer")
    fields = parse_text(df, "{kind:w}#{number:d}", F.col("c_name"))
    return df.select("c_custkey", fields["number"].alias("number"), fields["kind"].alias("kind"))


# ---- windows


def _frame_sql(aggregate: str, frame: str, keys: str = "user_id") -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    return f"SELECT event_id, round({aggregate} OVER ({part}ORDER BY event_id ROWS BETWEEN {frame}), 6) AS response FROM events"


_CENTERED, _TRAILING = "2 PRECEDING AND 2 FOLLOWING", "3 PRECEDING AND CURRENT ROW"


def _sliding(spark, sf_dir, fn, size: int, centered: bool, keys: list[str] | None) -> DataFrame:
    out = fn(_events(spark, sf_dir).select("event_id", "user_id", "value"), "value", size, centered, order="event_id", keys=keys)
    return out.select("event_id", F.round("response", 6).alias("response"))


@query(_frame_sql("max(value)", _CENTERED))
def max_filter(spark, sf_dir):
    """Greatest of five, by user."""
    return _sliding(spark, sf_dir, windows.max_filter, 5, True, ["user_id"])


@query(_frame_sql("min(value)", _CENTERED))
def min_filter(spark, sf_dir):
    """Least of five, by user."""
    return _sliding(spark, sf_dir, windows.min_filter, 5, True, ["user_id"])


@query(_frame_sql("median(value)", _CENTERED))
def median_filter(spark, sf_dir):
    """Median of five, by user."""
    return _sliding(spark, sf_dir, windows.median_filter, 5, True, ["user_id"])


@query(_frame_sql("avg(value)", _CENTERED, ""))
def mean_filter(spark, sf_dir):
    """Mean of five over the one stream of all events."""
    return _sliding(spark, sf_dir, windows.mean_filter, 5, True, None)


@query(_frame_sql("max(value)", _TRAILING, ""))
def max_filter_trailing(spark, sf_dir):
    """Greatest of the last four of all events."""
    return _sliding(spark, sf_dir, windows.max_filter, 4, False, None)


@query(_frame_sql("median(value)", _TRAILING))
def median_filter_trailing(spark, sf_dir):
    """Median of the last four, by user."""
    return _sliding(spark, sf_dir, windows.median_filter, 4, False, ["user_id"])


@query(_frame_sql("stddev_pop(value)", _CENTERED))
def window_filter(spark, sf_dir):
    """Any aggregate as a filter."""
    return _sliding(spark, sf_dir, lambda df, value, size, centered, **k: windows.window_filter(df, F.stddev_pop, value, size, centered, **k), 5, True, ["user_id"])


@query("""
    WITH l AS (SELECT event_id, value AS c, lag(value, 2) OVER w AS a2, lag(value) OVER w AS a1, lead(value) OVER w AS b1, lead(value, 2) OVER w AS b2 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT event_id, round((coalesce(a2, 0) + 4 * coalesce(a1, 0) + 6 * c + 4 * coalesce(b1, 0) + coalesce(b2, 0))
        / (6 + CASE WHEN a2 IS NULL THEN 0 ELSE 1 END + CASE WHEN a1 IS NULL THEN 0 ELSE 4 END + CASE WHEN b1 IS NULL THEN 0 ELSE 4 END + CASE WHEN b2 IS NULL THEN 0 ELSE 1 END), 6) AS response FROM l""")
def binomial_filter(spark, sf_dir):
    """Binomial weights of five, by user."""
    return _sliding(spark, sf_dir, windows.binomial_filter, 5, True, ["user_id"])


_SMOOTH = """
    WITH RECURSIVE e AS (SELECT event_id, user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    t AS (SELECT user_id, n, event_id, value AS y FROM e WHERE n = 1
          UNION ALL SELECT e.user_id, e.n, e.event_id, 0.3 * e.value + 0.7 * t.y FROM t JOIN e ON e.user_id = t.user_id AND e.n = t.n + 1)
    SELECT event_id, round(y, 6) AS response FROM t"""


@query(_SMOOTH)
def exponential_smoothing(spark, sf_dir):
    """Exponential smoothing by user."""
    out = recursive.exponential_smoothing(_events(spark, sf_dir).select("event_id", "user_id", "value"), "value", 0.3, order="event_id", keys=["user_id"])
    return out.select("event_id", F.round("response", 6).alias("response"))


@query(_SMOOTH)
def exponential_smoothing_stream(spark, sf_dir):
    """The same as a stream with state, read from the file in one micro-batch and written to the shared folder."""
    from seston.streaming.stateful import exponential_smoothing_stream as smooth

    src = read(spark, sf_dir, "events").select("event_id", "user_id", "value")
    folder = scratch(spark, "stream")
    live = spark.readStream.schema(read(spark, sf_dir, "events").schema).option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").parquet(_glob(sf_dir, "events")).select(*src.columns)
    out = smooth(live, "value", 0.3, keys=["user_id"], order="event_id")
    run = out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out")
    run.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out").select("event_id", F.round("response", 6).alias("response"))


def _glob(sf_dir: str, table: str) -> str:
    """A pattern that a streaming source takes for a table that is one file or a folder."""
    return f"{sf_dir.rstrip('/')}/{table}.parque[t]"


@query("""
    WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
    i AS (SELECT user_id, median(value) AS m FROM e WHERE n <= 10 GROUP BY 1),
    c AS (SELECT user_id, least(10, max(n)) AS n FROM e GROUP BY 1),
    t AS (SELECT i.user_id, c.n::BIGINT AS n, m FROM i JOIN c USING (user_id)
          UNION ALL
          SELECT t.user_id, e.n, (CASE WHEN e.value > t.m THEN t.m + 1 ELSE t.m END) - (CASE WHEN e.value < (CASE WHEN e.value > t.m THEN t.m + 1 ELSE t.m END) THEN 1 ELSE 0 END)
          FROM t JOIN e ON e.user_id = t.user_id AND e.n = t.n + 1)
    SELECT e.event_id, round(coalesce(t.m, i.m), 6) AS response FROM e JOIN i USING (user_id) LEFT JOIN t ON t.user_id = e.user_id AND t.n = e.n""")
def running_median(spark, sf_dir):
    """The running median by user."""
    out = recursive.running_median(_events(spark, sf_dir).select("event_id", "user_id", "value"), "value", 10, order="event_id", keys=["user_id"])
    return out.select("event_id", F.round("response", 6).alias("response"))


@query("""
    WITH m AS (SELECT event_id, median(value) OVER (ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS r FROM events)
    SELECT event_id, round(r, 6) AS response, row_number() OVER (ORDER BY event_id) - 1 AS index FROM m WHERE r > 50""")
def pipeline(spark, sf_dir):
    """A recorded plan: filter of medians, condition, numbering."""
    from seston.plans import nodes as N
    from seston.plans.pipeline import Pipeline, Variable, _there

    with Pipeline() as p:
        event, value = Variable("event_id", None), Variable("value", None)
        response = N.MedianFilter(value)
        N.Filter(response > 50)
        index = N.Enumerate()
    src = _events(spark, sf_dir).select(F.col("event_id").alias(event.column), F.col("value").alias(value.column))
    out = p.transform(src, order=[event.column])
    return out.select(F.col(event.column).alias("event_id"), F.round(_there(out, response), 6).alias("response"), F.col(_there(out, index)).alias("index"))


# ---- images: every embedding as a raster of 8 x 8


def _rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.transform("embedding", lambda x: x.cast("double"))
    return read(spark, sf_dir, "embeddings").select("vec_id", images.as_raster(data, 8).alias("image"))


def _sum(data: Column) -> Column:
    return F.aggregate(data, F.lit(0.0), lambda a, b: a + b.cast("double"))


_D = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"


@query("SELECT vec_id, CAST(len(list_filter(embedding, lambda x: x < 0.1)) AS BIGINT) AS n_below FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS embedding FROM embeddings)")
def threshold(spark, sf_dir):
    """Pixels below a threshold."""
    mask = images.threshold(F.col("image"), 0.1)
    return _rasters(spark, sf_dir).select("vec_id", F.size(F.filter(mask["data"], lambda x: x)).cast("long").alias("n_below"))


@query(f"SELECT vec_id, round(list_sum(list_transform(e, lambda x: (x - list_min(e)) / (list_max(e) - list_min(e)))), 5) AS total FROM (SELECT vec_id, {_D} AS e FROM embeddings)")
def rescale_intensity(spark, sf_dir):
    """Values mapped to 0 .. 1."""
    return _rasters(spark, sf_dir).select("vec_id", F.round(_sum(images.rescale_intensity(F.col("image"))["data"]), 5).alias("total"))


@query(f"SELECT vec_id, round(3 * list_sum(e), 5) AS total, CAST(3 * len(e) AS BIGINT) AS n FROM (SELECT vec_id, {_D} AS e FROM embeddings)")
def gray_to_rgb(spark, sf_dir):
    """One channel three times."""
    rgb = images.gray_to_rgb(F.col("image"))["data"]
    return _rasters(spark, sf_dir).select("vec_id", F.round(_sum(rgb), 5).alias("total"), F.size(rgb).cast("long").alias("n"))


@query(f"SELECT vec_id, round(list_sum(list_transform(range(1, 22), lambda k: 0.2125 * e[3 * k - 2] + 0.7154 * e[3 * k - 1] + 0.0721 * e[3 * k])), 5) AS total FROM (SELECT vec_id, {_D} AS e FROM embeddings)")
def rgb_to_gray(spark, sf_dir):
    """Luminance of the first 63 values taken as 21 colours."""
    src = read(spark, sf_dir, "embeddings").select("vec_id", images.as_raster(F.slice(F.transform("embedding", lambda x: x.cast("double")), 1, 63), 21, 3).alias("image"))
    return src.select("vec_id", F.round(_sum(images.rgb_to_gray(F.col("image"))["data"]), 5).alias("total"))


@query(f"SELECT vec_id, round(list_sum(list_concat(list_concat(e[11:14], e[19:22]), e[27:30])), 5) AS total, CAST(12 AS BIGINT) AS n FROM (SELECT vec_id, {_D} AS e FROM embeddings)")
def extract_roi(spark, sf_dir):
    """Rows 1 to 3 and columns 2 to 5 of each image."""
    box = F.struct(F.lit(1).alias("r0"), F.lit(2).alias("c0"), F.lit(4).alias("r1"), F.lit(6).alias("c1"))
    roi = images.extract_roi(F.col("image"), box)["data"]
    return _rasters(spark, sf_dir).select("vec_id", F.round(_sum(roi), 5).alias("total"), F.size(roi).cast("long").alias("n"))


@query(f"SELECT round(min(list_min(e)), 6) AS min, round(max(list_max(e)), 6) AS max, round(avg(list_min(e)), 6) AS mean_min, round(avg(list_max(e)), 6) AS mean_max FROM (SELECT {_D} AS e FROM embeddings)")
def image_stats(spark, sf_dir):
    """Range of all images and mean range of an image."""
    return images.image_stats(_rasters(spark, sf_dir)).select(*(F.round(c, 6).alias(c) for c in ("min", "max", "mean_min", "mean_max")))


_LABELS = """
    WITH RECURSIVE px AS (
        SELECT vec_id, i - 1 AS p, (i - 1) // 8 AS r, (i - 1) % 8 AS c, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings) WHERE embedding[i] < 0),
    reach AS (
        SELECT vec_id, p AS root, p, r, c FROM px
        UNION SELECT a.vec_id, a.root, b.p, b.r, b.c FROM reach a JOIN px b ON a.vec_id = b.vec_id AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1),
    lab AS (SELECT vec_id, p, min(root) AS root FROM reach GROUP BY 1, 2),
    reg AS (SELECT l.vec_id, l.root, x.r, x.c, x.v FROM lab l JOIN px x ON x.vec_id = l.vec_id AND x.p = l.p)"""


@query(_LABELS + """
    SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY root) AS INTEGER) AS label, CAST(count(*) AS DOUBLE) AS area,
           CAST(min(r) AS INTEGER) AS r0, CAST(min(c) AS INTEGER) AS c0, CAST(max(r) + 1 AS INTEGER) AS r1, CAST(max(c) + 1 AS INTEGER) AS c1
    FROM reg GROUP BY vec_id, root""")
def find_regions(spark, sf_dir):
    """Connected regions below zero."""
    src = _rasters(spark, sf_dir).withColumn("mask", images.threshold(F.col("image"), 0.0)).select("vec_id", "mask")
    return images.find_regions(src, "mask", pixels=False, features=False).select("vec_id", "label", "area", "box.*")


@query(_LABELS + """,
    m AS (SELECT vec_id, root, count(*) AS n, min(r) AS r0, min(c) AS c0, max(r) + 1 AS r1, max(c) + 1 AS c1, avg(r) AS y, avg(c) AS x, var_pop(r) AS rr, var_pop(c) AS cc, covar_pop(r, c) AS rc, min(v) AS lo, max(v) AS hi, avg(v) AS mean FROM reg GROUP BY 1, 2),
    a AS (SELECT *, (rr + cc) / 2 + sqrt(((rr - cc) / 2) ** 2 + rc ** 2) AS l1, greatest((rr + cc) / 2 - sqrt(((rr - cc) / 2) ** 2 + rc ** 2), 0) AS l2 FROM m)
    SELECT vec_id, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY root) AS INTEGER) AS label, CAST(n AS DOUBLE) AS area_exc, CAST(c1 - c0 AS INTEGER) AS width, CAST(r1 - r0 AS INTEGER) AS height,
           CAST(c0 AS INTEGER) AS bx, CAST(r0 AS INTEGER) AS by, round(x, 5) AS x, round(y, 5) AS y, round(4 * sqrt(l1), 4) AS major, round(CASE WHEN l2 < 1e-12 * greatest(l1, 1) THEN 0 ELSE 4 * sqrt(l2) END, 4) AS minor,
           round(CASE WHEN l1 = 0 THEN 0 WHEN l2 < 1e-12 * greatest(l1, 1) THEN 1 ELSE sqrt(1 - l2 / l1) END, 4) AS eccentricity, round(lo, 6) AS min, round(hi, 6) AS max, round(mean, 5) AS mean, round(hi - lo, 6) AS range,
           round(n / ((r1 - r0) * (c1 - c0)), 6) AS extent, round(sqrt(4 * n / pi()), 5) AS equivalent_diameter
    FROM a""")
def region_features(spark, sf_dir):
    """Images segmented into regions and measured: the features that SQL can count as well."""
    src = _rasters(spark, sf_dir).withColumn("mask", images.threshold(F.col("image"), 0.0))
    regions = images.find_regions(src, "mask", "image", pixels=False)
    f = features.region_features(F.col("label"), F.col("box"), F.col("measures"))
    digits = {"x": 5, "y": 5, "major": 4, "minor": 4, "eccentricity": 4, "min": 6, "max": 6, "mean": 5, "range": 6, "extent": 6, "equivalent_diameter": 5}
    return regions.select("vec_id", *(f[c].alias(c) for c in ("label", "area_exc", "width", "height", "bx", "by")), *(F.round(f[c], d).alias(c) for c, d in digits.items()))


@query()
def region_features_all(spark, sf_dir):
    """All 33 features, those of outline, holes and hull too; tested against shapes whose values are known."""
    src = _rasters(spark, sf_dir).withColumn("mask", images.threshold(F.col("image"), 0.0))
    return features.feature_columns(images.find_regions(src, "mask", "image", pixels=False), "vec_id")


@query(f"SELECT vec_id, CAST(len(list_filter(e, lambda x: x < 0)) AS DOUBLE) AS area, round(list_avg(list_filter(e, lambda x: x < 0)), 6) AS mean FROM (SELECT vec_id, {_D} AS e FROM embeddings) WHERE len(list_filter(e, lambda x: x < 0)) > 0")
def image_properties(spark, sf_dir):
    """All pixels below zero of an image as one region."""
    src = _rasters(spark, sf_dir).withColumn("mask", images.threshold(F.col("image"), 0.0))
    out = images.image_properties(src, "mask", "image").filter("measures IS NOT NULL")
    return out.select("vec_id", F.col("measures")["area"].alias("area"), F.round(F.col("measures")["mean"], 6).alias("mean"))


@query("""
    WITH px AS (SELECT vec_id, (i - 1) // 8 AS r, (i - 1) % 8 AS c, embedding[i] < 0 AS m FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings))
    SELECT a.vec_id, count(*) AS n_painted FROM px a WHERE NOT a.m AND EXISTS (SELECT 1 FROM px b WHERE b.vec_id = a.vec_id AND b.m AND abs(a.r - b.r) <= 1 AND abs(a.c - b.c) <= 1) GROUP BY 1""")
def draw_contours(spark, sf_dir):
    """Pixels on the outline of what is below zero."""
    src = _rasters(spark, sf_dir).withColumn("mask", images.threshold(F.col("image"), 0.0))
    drawn = images.draw_contours(src, "image", "mask", (1000.0, 0.0, 0.0))
    n = F.size(F.filter(F.col("drawn")["data"], lambda x: x == 1000.0)).cast("long")
    return drawn.select("vec_id", n.alias("n_painted")).filter("n_painted > 0")


@query(_LABELS + """,
    k AS (SELECT DISTINCT a.vec_id, b.r + dr AS r, b.c + dc AS c FROM lab a JOIN px b ON a.vec_id = b.vec_id AND a.p = b.p, (VALUES (-1), (0), (1)) AS y(dr), (VALUES (-1), (0), (1)) AS x(dc))
    SELECT k.vec_id, count(*) AS n_painted FROM k WHERE r BETWEEN 0 AND 7 AND c BETWEEN 0 AND 7 AND NOT EXISTS (SELECT 1 FROM px WHERE px.vec_id = k.vec_id AND px.r = k.r AND px.c = k.c) GROUP BY 1""")
def draw_contours_on_parent(spark, sf_dir):
    """The outlines of all regions on their image."""
    src = _rasters(spark, sf_dir).withColumn("mask", images.threshold(F.col("image"), 0.0))
    regions = images.find_regions(src.select("vec_id", "mask", "image"), "mask", features=False)
    drawn = images.draw_contours_on_parent(src.select("vec_id", "image"), regions, "vec_id", color=(1000.0, 0.0, 0.0))
    n = F.size(F.filter(F.col("drawn")["data"], lambda x: x == 1000.0)).cast("long")
    return drawn.select("vec_id", n.alias("n_painted")).filter("n_painted > 0")


@query("SELECT vec_id, round(list_avg(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS prediction FROM embeddings")
def predict(spark, sf_dir):
    """A model (here a mean) in batches."""
    from pyspark.sql.types import DoubleType

    src = read(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    out = models.predict(src, lambda: lambda batch: np.asarray(batch, float).mean(1), "x", shape=[64], kind=DoubleType())
    return out.select("vec_id", F.round("prediction", 4).alias("prediction"))


@query("""
    SELECT file_id, CAST(('0x' || substr(hex(image_data), 41, 8)) AS INTEGER) AS height, CAST(('0x' || substr(hex(image_data), 33, 8)) AS INTEGER) AS width
    FROM image_files WHERE image_data IS NOT NULL AND octet_length(image_data) > 0 AND hex(image_data)[1:16] = '89504E470D0A1A0A'""")
def decode_images(spark, sf_dir):
    """Size of every image that can be decoded."""
    out = read(spark, sf_dir, "image_files").select("file_id", images.decode_png(F.col("image_data")).alias("image"))
    return out.filter("image IS NOT NULL").select("file_id", "image.height", "image.width")


# ---- sources and sinks: written to the shared folder and read again


@query("SELECT CAST(n_nationkey AS VARCHAR) AS object_id, n_name AS name, CAST(n_regionkey AS DOUBLE) AS region, 'n' || n_regionkey || '.zip' AS archive FROM nation")
def archive_roundtrip(spark, sf_dir):
    """Nations as objects of an archive for each region."""
    from seston.sources.archives import read_objects, write_objects

    folder = scratch(spark, "archives").removeprefix("file:")
    src = read(spark, sf_dir, "nation")
    meta = {"object_id": F.col("n_nationkey").cast("string"), "name": F.col("n_name"), "region": F.col("n_regionkey")}
    write_objects(src, F.concat(F.lit(folder + "/n"), F.col("n_regionkey").cast("string"), F.lit(".zip")), meta, order=["n_nationkey"], sample_meta={"net": "wp2"}).collect()
    out = read_objects(spark, f"{folder}/*.zip")
    return out.select("object_id", F.col("meta")["name"].alias("name"), F.col("meta")["region"].cast("double").alias("region"), F.substring_index("archive_fn", "/", -1).alias("archive"))


@query("SELECT vec_id, n, round(v, 5) AS v FROM (SELECT vec_id, CAST(i - 1 AS BIGINT) AS n, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT vec_id, embedding, unnest(range(1, 65)) AS i FROM embeddings))")
def extend_table(spark, sf_dir):
    """Arrays written element by element to a growing table."""
    from seston.sources.tables import extend_values

    path = scratch(spark, "extended")
    src = read(spark, sf_dir, "embeddings").select(F.array_repeat("vec_id", 64).alias("vec_id"), F.sequence(F.lit(0).cast("long"), F.lit(63).cast("long")).alias("n"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    extend_values(src, path, ["vec_id", "n", "v"])
    return spark.read.parquet(path).select("vec_id", "n", F.round("v", 5).alias("v"))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def csv_roundtrip(spark, sf_dir):
    """A table in delimited text, of each customer the first order, and read again with its delimiter found."""
    from seston.sources.tables import read_table, write_csv

    path = scratch(spark, "table.csv")
    write_csv(read(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), path, "o_orderkey", ["o_custkey"])
    return read_table(spark, path).select(F.col("o_custkey").cast("long").alias("o_custkey"), F.col("o_orderkey").cast("long").alias("o_orderkey"))
