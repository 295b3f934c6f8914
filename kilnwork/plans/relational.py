"""Registered queries of the catalogue, status, priority and pairing operators, over the supplied tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kilnwork.functions import binary
from kilnwork.operators import assets, catalog, receipts, status


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def j1_catalog_left_join_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order with the number of its line items, 0 where there are none."""
    counts = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("solved_count"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return orders.join(counts, "o_orderkey", "left").withColumn("solved_count", F.coalesce("solved_count", F.lit(0)))


def p1_catalogue_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a catalogue: derived id and url, default tags, the later of two statistics of a key."""
    part, item = read(spark, sf_dir, "part"), read(spark, sf_dir, "lineitem")
    problems = part.select(F.col("p_size").alias("contestId"), F.col("p_partkey").cast("string").alias("index"), F.col("p_name").alias("name"), F.when(F.col("p_size") % 2 == 0, F.col("p_size")).alias("rating"), F.when(F.col("p_size") > 25, F.array("p_brand")).alias("tags"))
    stats = item.groupBy("l_partkey").agg(F.count("*").alias("solvedCount"))
    stats = stats.join(part, stats["l_partkey"] == part["p_partkey"]).select(F.col("p_size").alias("contestId"), F.col("p_partkey").cast("string").alias("index"), "solvedCount", F.lit(0).alias("pos"))
    rows = catalog.catalogue(problems, stats)
    return rows.select("id", "name", "rating", F.array_join("tags", ",").alias("tags"), F.col("solvedCount").alias("solved_count"), "url")


def j2_existence_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    rows = catalog.with_flag(docs.select("doc_id", "source"), labels, ["doc_id"], "has_file")
    toxic = labels.filter("toxic = 1").join(docs.select("doc_id", "source"), "doc_id").select("source")
    return catalog.with_flag(rows, toxic, ["source"], "has_solution").select("doc_id", "has_file", "has_solution")


def j3_label_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"))
    names = read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.substring("text", 1, 20).alias("name"), F.lit(0).alias("pos"))
    return catalog.labelled(ids, names, "pos")


def j4_incremental_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", "lang").join(read(spark, sf_dir, "labels"), "doc_id", "left_anti")


_STATUS = {"purchase": "ready", "view": "known_absent", "error": "transient_failure", "click": "invalid_structure"}
_STATUS_SQL = "CASE event_type WHEN 'purchase' THEN 'ready' WHEN 'view' THEN 'known_absent' WHEN 'error' THEN 'transient_failure' WHEN 'click' THEN 'invalid_structure' END"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = F.create_map(*[F.lit(x) for kv in _STATUS.items() for x in kv])
    rows = read(spark, sf_dir, "events").select(F.col("user_id").alias("content_id"), F.col("event_id").alias("seq"), F.try_element_at(told, "event_type").alias("status"))
    return rows.filter("status IS NOT NULL")


def _folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.fold(_events(spark, sf_dir), ["content_id"])


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = read(spark, sf_dir, "events").select(F.col("user_id").alias("content_id")).distinct()
    rows = users.join(_folded(spark, sf_dir), "content_id", "left")
    return rows.select("content_id", status.item_status(F.col("visible"), F.lit(True), F.col("marker")).alias("status"))


_FOLD = f"""ev AS (SELECT user_id AS content_id, event_id AS seq, {_STATUS_SQL} AS status FROM events),
mx AS (SELECT content_id, coalesce(max(seq) FILTER (status = 'ready'), -1) AS r, coalesce(max(seq) FILTER (status = 'known_absent'), -1) AS a FROM ev GROUP BY content_id),
fo AS (SELECT mx.content_id, r > a AS visible, (SELECT arg_max(status, seq) FROM ev WHERE ev.content_id = mx.content_id AND status <> 'ready' AND seq > r) AS marker FROM mx),
st AS (SELECT content_id, CASE WHEN visible THEN 'ready' ELSE coalesce(marker, 'pending') END AS status FROM fo)"""


def x2_item_status_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _states(spark, sf_dir)


def x1_retry_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = read(spark, sf_dir, "events").select(F.col("user_id").alias("content_id")).distinct()
    return status.pending(users, _folded(spark, sf_dir), requested=[1, 2, 3])


def a1_status_histogram_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.histogram(_states(spark, sf_dir))


def a2_a4_run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status.report(_events(spark, sf_dir), _states(spark, sf_dir))


def a5_rated_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select((F.col("p_size") % 5).alias("rating")).agg(F.count("*").alias("n"), catalog.rated_count().alias("rated"))


def a6_progress_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return status.progress(e.select(F.col("event_type").alias("kind"), (F.col("event_type") == "purchase").cast("int").alias("done"), F.lit(1).alias("total"), (F.col("event_type") == "error").cast("int").alias("failed")))


def a10_duplicate_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("text").alias("n_distinct")).withColumn("has_duplicates", F.col("n") != F.col("n_distinct"))


def a12_size_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Node, length and depth totals of a document against limits."""
    c = read(spark, sf_dir, "conversations")
    rows = c.groupBy("conv_id").agg(F.count("*").alias("nodes"), F.sum(F.length("text")).alias("chars"), F.max("turn").alias("depth"))
    return rows.withColumn("error", F.when(F.col("nodes") > 8, "max-nodes-exceeded").when(F.col("chars") > 2000, "max-text-chars-exceeded"))


def o4_o8_priority_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users by their last click, latest first, then those without one by id; their place in that order."""
    e = read(spark, sf_dir, "events")
    users = e.select(F.col("user_id").alias("content_id")).distinct()
    ranks = status.queue_ranks(e.filter("event_type = 'click'").select(F.col("event_id").alias("seq"), F.lit(0).alias("pos"), F.col("user_id").alias("content_id")))
    w = Window.orderBy(F.col("batch").desc_nulls_last(), F.col("pos").asc_nulls_last(), "content_id")
    return users.join(ranks, "content_id", "left").select("content_id", F.row_number().over(w).alias("place"))


def o5_bulk_prepend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A queue after two batches of clicked users, each mentioned once, where first mentioned in its last batch."""
    e = read(spark, sf_dir, "events").filter("event_type = 'click'")
    ranks = status.queue_ranks(e.select((F.col("event_id") % 2).alias("seq"), F.col("event_id").alias("pos"), F.col("user_id").alias("content_id")))
    return ranks.select("content_id", "batch", "pos")


def o6_pop_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    ranks = status.queue_ranks(e.filter("event_type = 'click'").select(F.col("event_id").alias("seq"), F.lit(0).alias("pos"), F.col("user_id").alias("content_id")))
    return status.popped(_states(spark, sf_dir).filter("status = 'invalid_structure'"), ranks).select("content_id", "batch")


def o9_batch_of_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.batches(read(spark, sf_dir, "orders").select("o_orderkey"), ["o_orderkey"])


def o2_numeric_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = read(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("contest_id"))
    return catalog.numeric_order(ids)


def o10_ordered_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation's distinct roles in the order of first mention."""
    first = read(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.min("turn").alias("at"))
    roles = F.transform(F.array_sort(F.collect_list(F.struct("at", "role"))), lambda x: x["role"])
    return first.groupBy("conv_id").agg(F.array_join(roles, ",").alias("roles"))


def o11_list_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("rating"), F.array("p_brand").alias("tags"), F.col("p_retailprice").alias("solvedCount"))
    page = catalog.listed(part, rating=(5, 30), order=[F.col("rating").desc(), F.col("id")], offset=20, limit=50)
    return page.select("id", "rating")


def j7_orphan_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored documents that no label refers to: how many, and how many bytes."""
    stored = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.col("text").cast("binary").alias("payload"))
    return assets.collected(assets.orphans(stored, read(spark, sf_dir, "labels").select(F.col("doc_id").alias("name"))))


def j8_reference_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The doc_ids with labels against those with a quality of 1: which only one side holds."""
    labels = read(spark, sf_dir, "labels")
    return catalog.differing(labels, labels.filter("quality = 1"), ["doc_id"])


def q14_requested_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.unexpected(read(spark, sf_dir, "labels").select("doc_id"), read(spark, sf_dir, "documents").filter("lang = 'en'").select("doc_id"), "doc_id")


def t5d_sample_pairing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first error of each conversation whose user turns are not directly followed by an assistant's, and the reverse."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    c = read(spark, sf_dir, "conversations").withColumns({"next": F.lead("role").over(w), "last": F.lag("role").over(w)})
    error = F.when((F.col("role") == "user") & ~F.coalesce(F.col("next") == "assistant", F.lit(False)), F.when(F.col("next").isNull(), "unpaired-sample-input").otherwise("invalid-sample-pair")).when(
        (F.col("role") == "assistant") & ~F.coalesce(F.col("last") == "user", F.lit(False)), "unpaired-sample-output"
    )
    return c.withColumn("error", error).groupBy("conv_id").agg(F.min_by("error", F.when(F.col("error").isNotNull(), F.col("turn"))).alias("error"))


def q8_absence_two_receipts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose first two events are valid receipts at different times, neither with a purchase: confirmed absent."""
    w = Window.partitionBy("user_id").orderBy("event_id")
    e = read(spark, sf_dir, "events").withColumn("n", F.row_number().over(w)).filter("n <= 2")
    looks = e.select(
        F.col("user_id").alias("id"), (F.col("event_type") != "error").alias("ok"), F.lit("<p>x</p>").alias("body"), F.lit(200).alias("status_code"), F.lit(False).alias("blocked"),
        F.lit(True).alias("recognized"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("fetched_at"), "event_type",
    )
    return receipts.absence(looks, F.col("event_type") == "purchase").select(F.col("id").alias("user_id"), F.col("confirmed").alias("confirmed_absent"))


def f20_content_address_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", binary.digest(F.col("text").cast("binary")).alias("digest"))
    return d.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n"))


def a13_text_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A conversation's text, its turns in order."""
    c = read(spark, sf_dir, "conversations")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]), "")
    return c.groupBy("conv_id").agg(F.md5(text.cast("binary")).alias("text_md5"))


def a14_failed_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").filter("value > 100 AND event_type <> 'view'")
    return e.agg(F.array_join(F.array_sort(F.collect_set("event_type")), ", ").alias("failed_kinds"))


_SQL = {
    "j1_catalog_left_join_default": "SELECT o_orderkey, o_orderstatus, coalesce(n, 0) AS solved_count FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey",
    "p1_catalogue_projection": """SELECT p_size::VARCHAR || p_partkey::VARCHAR AS id, p_name AS name, CASE WHEN p_size % 2 = 0 THEN p_size END AS rating, CASE WHEN p_size > 25 THEN p_brand ELSE '' END AS tags,
        coalesce(n, 0) AS solved_count, 'https://example.org/problemset/problem/' || p_size::VARCHAR || '/' || p_partkey::VARCHAR AS url
        FROM part LEFT JOIN (SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey) ON l_partkey = p_partkey""",
    "j2_existence_flags": """SELECT doc_id, EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id) AS has_file,
        EXISTS (SELECT 1 FROM labels l JOIN documents x ON x.doc_id = l.doc_id WHERE l.toxic = 1 AND x.source = d.source) AS has_solution FROM documents d""",
    "j3_label_fallback": "SELECT doc_id AS id, CASE WHEN length(b.text) > 0 THEN doc_id::VARCHAR || ' — ' || substring(b.text, 1, 20) ELSE doc_id::VARCHAR END AS label FROM documents LEFT JOIN benchmark b ON item_id = doc_id",
    "j4_incremental_anti": "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "x2_item_status_fold": f"WITH {_FOLD} SELECT content_id, status FROM st",
    "x1_retry_selection": f"WITH {_FOLD} SELECT content_id FROM fo WHERE content_id IN (1, 2, 3) OR coalesce(marker IN ('transient_failure', 'invalid_structure'), false) OR (NOT visible AND coalesce(marker <> 'known_absent', true))",
    "a1_status_histogram_zero_filled": f"WITH {_FOLD} SELECT d.status, count(content_id) AS n FROM (VALUES ('ready'), ('known_absent'), ('transient_failure'), ('invalid_structure'), ('pending')) d(status) LEFT JOIN st USING (status) GROUP BY d.status",
    "a2_a4_run_report": f"""WITH {_FOLD}, run AS (SELECT count(*) AS attempted_count, count(*) FILTER (status = 'ready') AS published_count, count(*) FILTER (status = 'known_absent') AS known_absent_count,
        count(*) FILTER (status IN ('transient_failure', 'invalid_structure')) AS failed_count FROM ev WHERE status IS NOT NULL)
        SELECT run.*, (SELECT count(*) FROM st) AS expected_count, failed_count = 0 AND NOT EXISTS (SELECT 1 FROM st WHERE status NOT IN ('ready', 'known_absent')) AS completed FROM run""",
    "a5_rated_count": "SELECT count(*) AS n, count(*) FILTER (p_size % 5 <> 0) AS rated FROM part",
    "a6_progress_rollup": "SELECT event_type AS kind, sum((event_type = 'purchase')::INT)::BIGINT AS done, count(*) AS total, sum((event_type = 'error')::INT)::BIGINT AS failed, sum((event_type = 'purchase')::INT)::BIGINT AS fetched FROM events GROUP BY ROLLUP (event_type)",
    "a10_duplicate_detection": "SELECT source, count(*) AS n, count(DISTINCT text) AS n_distinct, count(*) <> count(DISTINCT text) AS has_duplicates FROM documents GROUP BY source",
    "a12_size_limits": "SELECT *, CASE WHEN nodes > 8 THEN 'max-nodes-exceeded' WHEN chars > 2000 THEN 'max-text-chars-exceeded' END AS error FROM (SELECT conv_id, count(*) AS nodes, sum(length(text))::BIGINT AS chars, max(turn) AS depth FROM conversations GROUP BY conv_id)",
    "o4_o8_priority_order": "SELECT content_id, row_number() OVER (ORDER BY c DESC NULLS LAST, content_id)::INT AS place FROM (SELECT user_id AS content_id, max(event_id) FILTER (event_type = 'click') AS c FROM events GROUP BY user_id)",
    "o5_bulk_prepend": """SELECT content_id, batch, pos FROM (SELECT user_id AS content_id, event_id % 2 AS batch, min(event_id) AS pos, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 2 DESC) AS k
        FROM events WHERE event_type = 'click' GROUP BY user_id, event_id % 2) WHERE k = 1""",
    "o6_pop_next": f"WITH {_FOLD} SELECT user_id AS content_id, max(event_id) AS batch FROM events WHERE event_type = 'click' AND user_id IN (SELECT content_id FROM st WHERE status = 'invalid_structure') GROUP BY user_id ORDER BY batch DESC LIMIT 1",
    "o9_batch_of_8": "SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1) // 8 AS batch FROM orders",
    "o2_numeric_order": "SELECT DISTINCT o_custkey::VARCHAR AS contest_id FROM orders",
    "o10_ordered_distinct": "SELECT conv_id, string_agg(role, ',' ORDER BY pos) AS roles FROM (SELECT conv_id, role, min(turn) AS pos FROM conversations GROUP BY conv_id, role) GROUP BY conv_id",
    "o11_list_view": "SELECT p_partkey AS id, p_size AS rating FROM part WHERE p_size BETWEEN 5 AND 30 ORDER BY p_size DESC, p_partkey LIMIT 50 OFFSET 20",
    "j7_orphan_gc": "SELECT count(*) AS removed_files, coalesce(sum(strlen(text)), 0)::BIGINT AS removed_bytes FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
    "j8_reference_equality": "SELECT DISTINCT doc_id, 'left' AS side FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)",
    "q14_requested_subset": "SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')",
    "t5d_sample_pairing": """SELECT conv_id, arg_min(error, turn) FILTER (error IS NOT NULL) AS error FROM (SELECT *, CASE WHEN role = 'user' AND coalesce(nx, '') <> 'assistant' THEN CASE WHEN nx IS NULL THEN 'unpaired-sample-input' ELSE 'invalid-sample-pair' END
        WHEN role = 'assistant' AND coalesce(pv, '') <> 'user' THEN 'unpaired-sample-output' END AS error
        FROM (SELECT *, lead(role) OVER w AS nx, lag(role) OVER w AS pv FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))) GROUP BY conv_id""",
    "q8_absence_two_receipts": """SELECT user_id, count(*) = 2 AND count(DISTINCT ts) = 2 AND bool_and(event_type <> 'error') AND bool_and(event_type <> 'purchase') AS confirmed_absent
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events) WHERE n <= 2 GROUP BY user_id""",
    "f20_content_address_dedup": "SELECT sha256(text) AS digest, min(doc_id) AS doc_id, count(*) AS n FROM documents GROUP BY 1",
    "a13_text_content": "SELECT conv_id, md5(string_agg(text, '' ORDER BY turn)) AS text_md5 FROM conversations GROUP BY conv_id",
    "a14_failed_kinds": "SELECT string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS failed_kinds FROM events WHERE value > 100 AND event_type <> 'view'",
}
QUERIES = {name: globals()[name] for name in _SQL}
SQL = dict(_SQL)
