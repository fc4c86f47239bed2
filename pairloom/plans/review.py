"""Queues, samples, reviews and exports of candidate pairs, on the star schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pairloom.functions import text as fx
from pairloom.operators import curate, graph
from pairloom.plans.registry import query
from pairloom.sources import files
from pairloom.storage import table


@query("SELECT o_orderkey, concat('https://example.org/resoluciones/', o_orderkey) AS fuente_url FROM orders")
def source_urls(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", F.concat(F.lit("https://example.org/resoluciones/"), "o_orderkey").alias("fuente_url"))


@query("SELECT p_partkey, concat('query: ', p_name) AS consulta, concat('passage: ', p_name, ' ', p_type) AS pasaje FROM part")
def encoder_inputs(spark: SparkSession, sf: str) -> DataFrame:
    name = F.col("p_name")
    return table(spark, sf, "part").select("p_partkey", fx.prefixed(name, "query").alias("consulta"), fx.prefixed(F.concat_ws("  ", "p_name", "p_type"), "passage").alias("pasaje"))


@query("SELECT o_orderkey AS query_id, o_orderstatus AS split, 'pendiente' AS estado_revision, CAST(NULL AS VARCHAR) AS revisor, CAST(NULL AS VARCHAR) AS justificacion, '[]' AS articulos_aprobados FROM orders WHERE o_orderstatus <> 'P'")
def review_template(spark: SparkSession, sf: str) -> DataFrame:
    """Rows to be filled in. Sources of the test split go before anything of theirs is read."""
    none = F.lit(None).cast("string")
    rows = table(spark, sf, "orders").where("o_orderstatus <> 'P'")
    return rows.select(F.col("o_orderkey").alias("query_id"), F.col("o_orderstatus").alias("split"), F.lit("pendiente").alias("estado_revision"), none.alias("revisor"), none.alias("justificacion"), F.to_json(F.array().cast("array<string>")).alias("articulos_aprobados"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_returnflag = 'A' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'P')")
def approved_only(spark: SparkSession, sf: str) -> DataFrame:
    """Approved rows of sources that aren't in the test split."""
    known = table(spark, sf, "orders").where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("l_orderkey"))
    return table(spark, sf, "lineitem").where("l_returnflag = 'A'").select("l_orderkey", "l_linenumber").join(known, "l_orderkey", "left_semi")


@query("""SELECT a.l_orderkey, a.l_linenumber, b.split FROM lineitem a JOIN (SELECT l_partkey, l_suppkey, l_shipdate, CASE WHEN min(l_orderkey) % 2 = 0 THEN 'train' ELSE 'test' END AS split FROM lineitem GROUP BY 1, 2, 3) b
ON a.l_partkey = b.l_partkey AND a.l_suppkey = b.l_suppkey AND a.l_shipdate = b.l_shipdate""")
def split_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """Each pair with the split of its source, article and text."""
    keys = ["l_partkey", "l_suppkey", "l_shipdate"]
    line = table(spark, sf, "lineitem")
    assigned = line.groupBy(*keys).agg(F.when(F.min("l_orderkey") % 2 == 0, "train").otherwise("test").alias("split"))
    return line.select("l_orderkey", "l_linenumber", *keys).join(assigned, keys).select("l_orderkey", "l_linenumber", "split")


@query("SELECT l_partkey AS query_id, count(*) AS n, string_agg(concat(l_orderkey, '/', l_linenumber), ',' ORDER BY l_orderkey, l_linenumber) AS fuentes FROM lineitem GROUP BY 1")
def query_provenance(spark: SparkSession, sf: str) -> DataFrame:
    """The sources of each query."""
    by = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("query_id")).agg(F.array_sort(F.collect_list(F.struct("l_orderkey", "l_linenumber"))).alias("s"))
    return by.select("query_id", F.size("s").cast("long").alias("n"), F.array_join(F.transform("s", lambda x: F.concat_ws("/", x["l_orderkey"], x["l_linenumber"])), ",").alias("fuentes"))


@query("""SELECT c_custkey AS fuente, coalesce(n, 0) AS filas, CASE WHEN n IS NULL THEN 'archivo ausente' END AS error FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) ON c_custkey = o_custkey""")
def missing_sources(spark: SparkSession, sf: str) -> DataFrame:
    """Sources with their rows; those without any are errors."""
    n = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = table(spark, sf, "customer").select("c_custkey").join(n, "c_custkey", "left")
    return rows.select(F.col("c_custkey").alias("fuente"), F.coalesce("n", F.lit(0)).alias("filas"), F.when(F.col("n").isNull(), "archivo ausente").alias("error"))


@query("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderstatus <> 'O', o_totalprice DESC, o_orderkey) AS INTEGER) AS lugar FROM orders ORDER BY lugar LIMIT 60")
def proposal_order(spark: SparkSession, sf: str) -> DataFrame:
    """The first 60 proposals: train first, then by priority."""
    first = table(spark, sf, "orders").orderBy(F.col("o_orderstatus") != "O", F.desc("o_totalprice"), "o_orderkey").limit(60)
    return first.select("o_orderkey", F.row_number().over(Window.orderBy(F.col("o_orderstatus") != "O", F.desc("o_totalprice"), "o_orderkey")).alias("lugar"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem ORDER BY l_returnflag <> 'N', l_quantity DESC, l_discount, sha256(concat(l_orderkey, '|', l_linenumber)) LIMIT 100")
def tier_order(spark: SparkSession, sf: str) -> DataFrame:
    """The first 100 by tier, actions, distance and id."""
    rows = table(spark, sf, "lineitem").withColumn("id", F.sha2(F.concat_ws("|", "l_orderkey", "l_linenumber"), 256))
    return rows.orderBy(F.col("l_returnflag") != "N", F.desc("l_quantity"), "l_discount", "id").limit(100).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderkey AS VARCHAR), o_orderpriority) AS INTEGER) AS lugar FROM orders")
def text_order(spark: SparkSession, sf: str) -> DataFrame:
    """Ids in the order of their text, not of their number, within each source."""
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.col("o_orderkey").cast("string"), "o_orderpriority"))
    return table(spark, sf, "orders").select("o_orderkey", place.alias("lugar"))


@query("SELECT l_shipmode, f1, epoca FROM (SELECT l_returnflag AS l_shipmode, round(avg(l_discount), 9) AS f1, max(l_linenumber) AS epoca FROM lineitem GROUP BY 1) ORDER BY f1 DESC, epoca DESC, l_shipmode LIMIT 1")
def best_run(spark: SparkSession, sf: str) -> DataFrame:
    """The run with the best figures, with its last checkpoint."""
    runs = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("l_shipmode")).agg(F.round(F.avg("l_discount"), 9).alias("f1"), F.max("l_linenumber").alias("epoca"))
    return runs.orderBy(F.desc("f1"), F.desc("epoca"), "l_shipmode").limit(1)


@query("SELECT l_orderkey, l_partkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY 1, 2")
def dedupe_within_source(spark: SparkSession, sf: str) -> DataFrame:
    return curate.dedupe_first(table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber"), ["l_orderkey", "l_partkey"], ["l_linenumber"])[0]


@query("SELECT coalesce(a.k, b.k) AS archivo, CASE WHEN a.k IS NULL THEN 'nuevo' ELSE 'ausente' END AS estado FROM (SELECT DISTINCT o_custkey AS k FROM orders) a FULL JOIN (SELECT c_custkey AS k FROM customer) b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL")
def inventory_changes(spark: SparkSession, sf: str) -> DataFrame:
    """What only one of two inventories has."""
    a = table(spark, sf, "orders").select(F.col("o_custkey").alias("archivo")).distinct()
    b = table(spark, sf, "customer").select(F.col("c_custkey").alias("archivo"))
    return a.join(b, "archivo", "left_anti").withColumn("estado", F.lit("ausente")).unionByName(b.join(a, "archivo", "left_anti").withColumn("estado", F.lit("nuevo")))


@query("SELECT o_custkey, min(o_orderstatus) AS split FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) = 1")
def source_splits(spark: SparkSession, sf: str) -> DataFrame:
    """Sources whose rows have one split; another is an error, so the others are left out first."""
    o = table(spark, sf, "orders")
    several = graph.leaks(o, ["o_custkey"], "o_orderstatus").select(F.col("value").cast("long").alias("o_custkey"))
    return graph.one_split(o.join(several, "o_custkey", "left_anti"), "o_custkey", "o_orderstatus").withColumnRenamed("o_orderstatus", "split")


@query("SELECT p_partkey, concat('<b>', p_name, '</b> &amp; &quot;', p_type, '&quot;') AS tarjeta FROM part ORDER BY p_partkey LIMIT 100")
def review_cards(spark: SparkSession, sf: str) -> DataFrame:
    """Cards of the first 100 rows, escaped."""
    said = F.concat(F.lit("<b>"), fx.escaped(F.col("p_name")), F.lit("</b> "), fx.escaped(F.concat(F.lit('& "'), "p_type", F.lit('"'))))
    return table(spark, sf, "part").orderBy("p_partkey").limit(100).select("p_partkey", said.alias("tarjeta"))


@query("SELECT o_orderkey, concat('[\"', o_orderstatus, '\",\"', o_orderpriority, '\"]') AS lista FROM orders")
def nested_to_json(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", F.to_json(F.array("o_orderstatus", "o_orderpriority")).alias("lista"))


@query("""WITH r AS (SELECT *, CASE WHEN l_orderkey % 4 <> 0 THEN 'train' ELSE 'test' END AS split FROM lineitem QUALIFY count(*) OVER (PARTITION BY l_orderkey, l_linenumber) = 1),
v AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'duplicada' WHEN l_linenumber = 2 THEN 'sin_firma' WHEN split = 'test' THEN 'fuera_train' WHEN l_linenumber = 3 THEN 'papel' WHEN l_linenumber = 4 THEN 'hechos_cortos'
WHEN l_linenumber = 5 THEN 'articulos_repetidos' WHEN p_partkey IS NULL THEN 'articulo_sin_catalogo' END AS reason FROM r LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 10) ON l_partkey = p_partkey)
SELECT concat(l_orderkey, '/', l_linenumber) AS candidate_id, reason, count(*) AS n FROM (SELECT * FROM v UNION ALL SELECT * FROM v WHERE l_linenumber = 1) WHERE reason IS NOT NULL GROUP BY 1, 2""")
def strict_reviews(spark: SparkSession, sf: str) -> DataFrame:
    """Reviews of approvals that break a rule of documents, by line number; lines that share an id are left out."""
    line = table(spark, sf, "lineitem").withColumn("candidate_id", F.concat_ws("/", "l_orderkey", "l_linenumber"))
    line = line.withColumn("same", F.count("*").over(Window.partitionBy("candidate_id"))).where("same = 1")
    n = F.col("l_linenumber")
    article = F.col("l_partkey").cast("string")
    reviews = line.select(
        "candidate_id", F.lit("aprobar").alias("decision"), F.when(n == 2, " ").otherwise("r").alias("revisor"), F.lit("j").alias("justificacion"), F.when(n == 3, "acusacion").otherwise("condena").alias("papel_confirmado"),
        F.repeat(F.lit("x"), F.when(n == 4, 99).otherwise(100)).alias("hechos_aprobados"), F.when(n == 5, F.array(article, article)).otherwise(F.array(article)).alias("articulos_aprobados"), n.alias("n"),
    )
    reviews = reviews.unionByName(reviews.where("n = 1")).drop("n")
    candidates = line.select("candidate_id", F.when(F.col("l_orderkey") % 4 != 0, "train").otherwise("test").alias("split"))
    catalogue = table(spark, sf, "part").where("p_size > 10").select(F.col("p_partkey").cast("string").alias("articulo"))
    found = curate.review_violations(reviews, candidates=candidates, catalogue=catalogue, facts=100)
    return found.groupBy("candidate_id", "reason").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT p_partkey, p_name, CASE WHEN p_size % 2 = 0 THEN 'train' ELSE 'test' END AS split, row_number() OVER (PARTITION BY p_partkey % 50, p_name ORDER BY p_partkey) AS k, p_partkey % 50 AS articulo FROM part),
a AS (SELECT DISTINCT articulo, CASE WHEN p_name LIKE '%widget%' THEN replace(p_name, 'widget', 'gadget') ELSE replace(p_name, 'red', 'crimson') END AS t, CASE WHEN p_name LIKE '%widget%' THEN 'widget' ELSE 'red' END AS rule
FROM r WHERE split = 'train' AND (p_name LIKE '%widget%' OR p_name LIKE 'red %'))
SELECT articulo, p_name AS hechos, 'original' AS tipo, CAST(NULL AS VARCHAR) AS regla_aumento, count(*) AS n FROM r GROUP BY 1, 2 UNION ALL SELECT articulo, t, 'parafraseado', rule, 1 FROM a""")
def synonym_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Originals and one paraphrase of each approved row of train, by the first rule that gives a new text."""
    part = table(spark, sf, "part")
    rows = part.select((F.col("p_partkey") % 50).alias("articulo"), F.col("p_name").alias("hechos"), F.when(F.col("p_size") % 2 == 0, "train").otherwise("test").alias("split"), F.lit("aprobado").alias("estado_revision"))
    out = curate.augmented(rows, {"nothing": [], "absent": ["x"], "widget": ["gadget"], "red": ["crimson"]})
    return out.groupBy("articulo", "hechos", "tipo", "regla_aumento").agg(F.count("*").alias("n"))


@query("""SELECT page_id, host, sha256(html) AS sha256 FROM (SELECT page_id, html, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages) WHERE (host LIKE '%.com' OR host LIKE '%.org') AND page_id % 10 <> 0""")
def allowed_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of allowed hosts that weren't redirected elsewhere, decoded, with their hash."""
    pages = table(spark, sf, "pages").select("page_id", "url", F.when(F.col("page_id") % 10 == 0, "https://elsewhere.invalid/x").otherwise(F.col("url")).alias("final_url"), F.lit("text/html; charset=utf-8").alias("content_type"), F.encode("html", "utf-8").alias("body"))
    return files.allowed(pages, r"\.(com|org)$").select("page_id", "host", "sha256")


@query("SELECT CAST(p_size AS VARCHAR) AS articulo, min(concat('texto ', p_size)) AS texto FROM part GROUP BY p_size")
def catalogue_map(spark: SparkSession, sf: str) -> DataFrame:
    """A catalogue in its map form, read back as rows."""
    entries = table(spark, sf, "part").select(F.struct(F.concat(F.lit("0"), "p_size").alias("k"), F.concat(F.lit("<p>texto "), "p_size", F.lit("</p>")).alias("v")).alias("e")).distinct()
    whole = entries.agg(F.to_json(F.map_from_entries(F.collect_list("e"))).alias("value"))
    return files.catalogue(files.catalogue_rows(whole))
