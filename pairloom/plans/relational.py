"""Relational operators on the star schema: pairs are order lines, the catalogue is the parts table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pairloom.operators import curate, graph, joins
from pairloom.plans.registry import query
from pairloom.storage import table

LINE = "l_orderkey, l_linenumber"


@query("SELECT l_orderkey, l_linenumber, l_partkey, concat(p_name, ' ', p_type) AS articulo_texto FROM lineitem JOIN part ON l_partkey = p_partkey")
def pairs_with_catalog(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select(F.col("p_partkey").alias("l_partkey"), F.concat_ws(" ", "p_name", "p_type").alias("articulo_texto"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(part, "l_partkey")


@query("""SELECT CASE WHEN upper(trim(p_brand)) = 'BRAND#1' THEN 'CP' ELSE upper(trim(p_brand)) END AS norma, count(*) AS articulos, count(DISTINCT concat(p_name, ' ', p_type)) AS textos FROM part GROUP BY 1""")
def catalog_load(spark: SparkSession, sf: str) -> DataFrame:
    norm = F.upper(F.trim("p_brand"))
    return table(spark, sf, "part").groupBy(F.when(norm == "BRAND#1", "CP").otherwise(norm).alias("norma")).agg(F.count("*").alias("articulos"), F.countDistinct(F.concat_ws(" ", "p_name", "p_type")).alias("textos"))


@query("SELECT l_orderkey, l_linenumber, o_orderstatus, o_orderpriority FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey")
def enrich_metadata(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_orderpriority")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").join(o, "l_orderkey", "left")


@query(f"""SELECT {LINE}, sha256(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR))) AS candidate_id FROM lineitem""")
def surrogate_keys(spark: SparkSession, sf: str) -> DataFrame:
    key = F.sha2(F.lower(F.concat_ws("|", "l_orderkey", "l_linenumber", "l_partkey")), 256)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", key.alias("candidate_id"))


@query(f"""SELECT {LINE}, CAST(l_quantity AS BIGINT) + CASE WHEN coalesce(n, 0) < 5 THEN 8 ELSE 0 END AS prioridad
FROM lineitem LEFT JOIN (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_partkey = k""")
def priority_queue(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem")
    support = line.where("l_returnflag = 'R'").groupBy("l_partkey").agg(F.count("*").alias("n"))
    bump = F.when(F.coalesce("n", F.lit(0)) < 5, 8).otherwise(0)
    return line.join(support, "l_partkey", "left").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("long") + bump).alias("prioridad"))


_ROUTE = "CASE WHEN p_partkey IS NULL THEN 'sin_catalogo_cp' WHEN l_linenumber = 1 THEN 'etiqueta_general_separada' WHEN l_discount > 0.08 THEN 'requiere_revision_contenido' END"


@query(f"SELECT {LINE}, {_ROUTE} AS motivo FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 5) ON l_partkey = p_partkey")
def quarantine_routing(spark: SparkSession, sf: str) -> DataFrame:
    return _routed(spark, sf).select("l_orderkey", "l_linenumber", "motivo")


def _routed(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").where("p_size > 5").select("p_partkey")
    rows = table(spark, sf, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    reason = curate.first_reason((F.col("p_partkey").isNull(), "sin_catalogo_cp"), (F.col("l_linenumber") == 1, "etiqueta_general_separada"), (F.col("l_discount") > 0.08, "requiere_revision_contenido"))
    return rows.withColumn("motivo", reason)


@query(f"SELECT motivo, count(*) AS n, count(*) FILTER (l_quantity > 25) AS grandes FROM (SELECT l_quantity, {_ROUTE} AS motivo FROM lineitem LEFT JOIN (SELECT p_partkey FROM part WHERE p_size > 5) ON l_partkey = p_partkey) GROUP BY motivo")
def reject_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = _routed(spark, sf)
    return rows.groupBy("motivo").agg(F.count("*").alias("n"), F.count_if(F.col("l_quantity") > 25).alias("grandes"))


_GATE = """CASE WHEN l_linestatus <> 'O' THEN 'fuera_train' WHEN l_partkey % 13 = 0 THEN 'sin_catalogo_cp' WHEN l_suppkey < 10 OR l_partkey < 100 THEN 'etiqueta_general_separada'
WHEN l_returnflag = 'R' THEN 'papel_no_elegible' WHEN NOT l_extendedprice BETWEEN 1800 AND 36000 THEN 'longitud' WHEN l_linenumber < 2 THEN 'pocas_acciones'
WHEN l_quantity > 40 THEN 'contenido_procesal' WHEN l_tax > 0.07 THEN 'doctrina_o_negacion' WHEN l_discount > 0.08 THEN 'cita_lejana' END"""


@query(f"SELECT {LINE}, {_GATE} AS motivo, CASE WHEN l_returnflag = 'N' AND l_discount <= 0.05 AND l_quantity <= 20 THEN 'conservador' ELSE 'ampliado' END AS nivel FROM lineitem")
def quality_gate(spark: SparkSession, sf: str) -> DataFrame:
    c = {
        "split": F.when(F.col("l_linestatus") == "O", "train").otherwise("test"), "in_catalogue": F.col("l_partkey") % 13 != 0, "excluded": F.col("l_suppkey") < 10, "base": F.col("l_partkey"),
        "role": F.when(F.col("l_returnflag") == "R", "precedente").when(F.col("l_returnflag") == "N", "condena").otherwise("acusacion"),
        "length": F.col("l_extendedprice") / 10, "actions": F.col("l_linenumber"), "procedural": F.when(F.col("l_quantity") > 40, 3).when(F.col("l_quantity") > 20, 2).otherwise(1),
        "theory": F.col("l_tax") > 0.07, "distance": F.when(F.col("l_discount") > 0.08, 500).when(F.col("l_discount") > 0.05, 300).otherwise(100), "section": F.lit("hechos"),
    }
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", curate.quality_reason(c).alias("motivo"), curate.quality_tier(c).alias("nivel"))


@query(f"SELECT {LINE} FROM lineitem WHERE l_linestatus = 'O' AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size = 1) AND l_discount <= 0.05 AND l_linenumber >= 2 AND l_tax <= 0.06 AND l_returnflag = 'N' AND l_extendedprice >= 15000")
def weak_eligible(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").where("p_size = 1").select(F.col("p_partkey").alias("l_partkey"))
    rows = table(spark, sf, "lineitem").where("l_linestatus = 'O' AND l_discount <= 0.05 AND l_linenumber >= 2 AND l_tax <= 0.06 AND l_returnflag = 'N' AND l_extendedprice >= 15000")
    return rows.join(part, "l_partkey", "left_anti").select("l_orderkey", "l_linenumber")


@query("""WITH b AS (SELECT o_custkey, o_orderdate FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 300000)
SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM b) AND o_orderdate NOT IN (SELECT o_orderdate FROM b)""")
def blocked_keys(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return curate.not_blocked(o, o.where("o_orderpriority = '1-URGENT' AND o_totalprice > 300000"), ["o_custkey", "o_orderdate"]).select("o_orderkey")


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 'review_only' ELSE o_orderstatus END AS split FROM orders""")
def heldout_text_block(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    held = o.where("o_orderstatus = 'P'").select("o_custkey", F.lit(True).alias("held")).distinct()
    return o.join(held, "o_custkey", "left").select("o_orderkey", F.when((F.col("o_orderstatus") == "O") & F.col("held"), "review_only").otherwise(F.col("o_orderstatus")).alias("split"))


@query("""SELECT o_orderkey, CASE WHEN (SELECT count(DISTINCT p.o_orderstatus) FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderdate = o.o_orderdate) > 1 THEN 'review_only' ELSE o_orderstatus END AS split FROM orders o""")
def cross_split_text(spark: SparkSession, sf: str) -> DataFrame:
    splits = F.size(F.collect_set("o_orderstatus").over(Window.partitionBy("o_custkey", "o_orderdate")))
    return table(spark, sf, "orders").select("o_orderkey", F.when(splits > 1, "review_only").otherwise(F.col("o_orderstatus")).alias("split"))


@query("""SELECT c_custkey, n_name AS articulo FROM customer LEFT JOIN (SELECT n_nationkey, n_name, CASE n_regionkey WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS sigla FROM nation) n
ON c_nationkey = n_nationkey AND CASE c_mktsegment WHEN 'BUILDING' THEN 'A' WHEN 'AUTOMOBILE' THEN 'B' ELSE 'C' END = sigla""")
def alias_lookup(spark: SparkSession, sf: str) -> DataFrame:
    alias = F.create_map(*map(F.lit, ("BUILDING", "A", "AUTOMOBILE", "B")))
    n = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.when(F.col("n_regionkey") == 0, "A").when(F.col("n_regionkey") == 1, "B").otherwise("C").alias("sigla"), F.col("n_name").alias("articulo"))
    c = table(spark, sf, "customer").withColumn("s", F.coalesce(F.element_at(alias, F.col("c_mktsegment")), F.lit("C")))
    return c.join(n, (F.col("c_nationkey") == F.col("k")) & (F.col("s") == F.col("sigla")), "left").select("c_custkey", "articulo")


@query("""SELECT c_custkey, coalesce(s, 'review_only') AS split, coalesce(g, sha256(CAST(c_custkey AS VARCHAR))) AS grupo_id
FROM customer LEFT JOIN (SELECT o_custkey, min(o_orderstatus) AS s, sha256(concat('g', CAST(o_custkey AS VARCHAR))) AS g FROM orders GROUP BY o_custkey) ON c_custkey = o_custkey""")
def assign_default(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderstatus").alias("s")).withColumn("g", F.sha2(F.concat(F.lit("g"), "c_custkey"), 256))
    rows = table(spark, sf, "customer").join(known, "c_custkey", "left")
    return rows.select("c_custkey", F.coalesce("s", F.lit("review_only")).alias("split"), F.coalesce("g", F.sha2(F.col("c_custkey").cast("string"), 256)).alias("grupo_id"))


@query("""SELECT o_orderkey AS candidate_id, o_custkey AS articulo, 'pendiente' AS estado_revision FROM orders WHERE o_orderstatus = 'O'
UNION ALL SELECT o_orderkey, unnest([o_custkey, o_custkey + 1]), 'aprobado' FROM orders WHERE o_orderstatus = 'F'""")
def apply_reviews(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    cand = o.select(F.col("o_orderkey").alias("candidate_id"), F.col("o_custkey").alias("articulo"), F.lit("pendiente").alias("estado_revision"))
    rev = o.where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("candidate_id"), F.when(F.col("o_orderstatus") == "F", "aprobar").otherwise("rechazar").alias("decision"), F.array("o_custkey", F.col("o_custkey") + 1).alias("articulos_aprobados"))
    return curate.apply_reviews(cand, rev)


@query("""SELECT o_custkey AS candidate_id, CASE WHEN count(*) OVER (PARTITION BY o_custkey) > 1 THEN 'duplicada' WHEN o_orderstatus = 'P' THEN 'decision' ELSE 'sin_firma' END AS reason
FROM orders QUALIFY count(*) OVER (PARTITION BY o_custkey) > 1 OR o_orderstatus = 'P' OR o_orderpriority = '5-LOW'""")
def review_violations(spark: SparkSession, sf: str) -> DataFrame:
    rev = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("candidate_id"), F.when(F.col("o_orderstatus") == "F", "aprobar").when(F.col("o_orderstatus") == "O", "rechazar").otherwise("quizas").alias("decision"),
        F.when(F.col("o_orderpriority") == "5-LOW", "").otherwise("r").alias("revisor"), F.lit("j").alias("justificacion"),
    )
    return curate.review_violations(rev)


@query("""SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A'""")
def new_vs_baseline(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem")
    keys = ["l_partkey", "l_suppkey"]
    return line.where("l_returnflag = 'R'").select(keys).distinct().join(line.where("l_returnflag = 'A'").select(keys), keys, "left_anti")


@query("SELECT DISTINCT l_partkey FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 49")
def new_articles(spark: SparkSession, sf: str) -> DataFrame:
    line = table(spark, sf, "lineitem")
    return line.where("l_returnflag = 'R'").select("l_partkey").subtract(line.where("l_quantity > 49").select("l_partkey"))


def _events(spark: SparkSession, sf: str, kind: str, *cols) -> DataFrame:
    return table(spark, sf, "events").where(F.col("event_type") == kind).select("user_id", *cols)


_SECS = "CAST(floor(epoch(ts)) AS BIGINT)"


def _nearest_sql(distance: str) -> str:
    return f"""WITH e AS (SELECT *, {_SECS} AS s FROM events), b AS (SELECT user_id, event_id AS block, s AS b, s + 600 AS e FROM e WHERE event_type = 'click'),
c AS (SELECT user_id, event_id AS cita, s, s + 60 AS t FROM e WHERE event_type = 'error')
SELECT block, cita, distance FROM (SELECT block, cita, {distance} AS distance, row_number() OVER (PARTITION BY block ORDER BY {distance}, s, cita) AS r FROM b JOIN c USING (user_id)) WHERE r = 1"""


def _nearest(spark: SparkSession, sf: str, crossed: bool) -> tuple[DataFrame, DataFrame]:
    """Each block with its nearest citation, and all citations."""
    s = F.unix_timestamp("ts")
    blocks = _events(spark, sf, "click", F.col("event_id").alias("block"), s.alias("b"), (s + 600).alias("e"))
    cites = _events(spark, sf, "error", F.col("event_id").alias("cita"), s.alias("s"), (s + 60).alias("t"))
    return joins.nearest_span(blocks, cites, "user_id", ("b", "e"), ("s", "t"), ["s", "cita"], "block", crossed), cites


@query(_nearest_sql("least(abs(s - e), abs(t - b))"))
def nearest_citation_v5(spark: SparkSession, sf: str) -> DataFrame:
    return _nearest(spark, sf, True)[0].select("block", "cita", "distance")


@query(_nearest_sql("greatest(b - t, s - e, 0)"))
def nearest_citation_v6(spark: SparkSession, sf: str) -> DataFrame:
    return _nearest(spark, sf, False)[0].select("block", "cita", "distance")


@query(_nearest_sql("greatest(b - t, s - e, 0)").replace("SELECT block, cita, distance FROM (SELECT block, cita,", "SELECT n.block, c.cita FROM (SELECT user_id, s, block, cita,").replace("WHERE r = 1", "n JOIN c ON c.user_id = n.user_id AND c.s = n.s WHERE n.r = 1"))
def anchored_citations(spark: SparkSession, sf: str) -> DataFrame:
    """All citations that start where a block's nearest one does."""
    near, cites = _nearest(spark, sf, False)
    return joins.with_anchor(near, cites, "user_id", "s", ["block"]).select("block", "cita")


@query(f"""WITH e AS (SELECT *, {_SECS} AS s FROM events) SELECT r, string_agg(CAST(f AS VARCHAR), ',' ORDER BY n) AS hechos FROM (
SELECT a.event_id AS r, b.event_id AS f, row_number() OVER (PARTITION BY a.event_id ORDER BY least(abs(b.s - a.s), abs(b.s + 60 - a.s)), b.s, b.event_id) AS n
FROM e a JOIN e b ON a.user_id = b.user_id WHERE a.event_type = 'purchase' AND b.event_type = 'view') WHERE n <= 3 GROUP BY r""")
def nearest_facts(spark: SparkSession, sf: str) -> DataFrame:
    s = F.unix_timestamp("ts")
    rel = _events(spark, sf, "purchase", F.col("event_id").alias("r"), s.alias("at"))
    facts = _events(spark, sf, "view", F.col("event_id").alias("f"), s.alias("b"), (s + 60).alias("e"))
    near = joins.nearest(rel, facts, "user_id", F.least(F.abs(F.col("b") - F.col("at")), F.abs(F.col("e") - F.col("at"))), ["b", "f"], ["r"], k=3)
    ids = F.transform(F.array_sort(F.collect_list(F.struct("rank", "f"))), lambda x: x["f"].cast("string"))
    return near.groupBy("r").agg(F.array_join(ids, ",").alias("hechos"))


@query("""SELECT a.event_id, (SELECT max_by(b.event_id, (b.ts, b.event_id)) FROM events b WHERE b.user_id = a.user_id AND b.event_type = 'purchase' AND (b.ts, b.event_id) <= (a.ts, a.event_id)) AS pagina
FROM events a WHERE a.event_type = 'error'""")
def asof_page(spark: SparkSession, sf: str) -> DataFrame:
    left = _events(spark, sf, "error", "ts", "event_id")
    right = _events(spark, sf, "purchase", "ts", "event_id", F.col("event_id").alias("pagina"))
    return joins.as_of(left, right, "user_id", "ts", "pagina", ["event_id"]).select("event_id", "pagina")


@query(f"""WITH e AS (SELECT *, {_SECS} AS s FROM events) SELECT event_id FROM e a WHERE event_type = 'view' AND NOT EXISTS
(SELECT 1 FROM e b WHERE b.user_id = a.user_id AND b.event_type = 'click' AND b.s <= a.s AND a.s < b.s + 3600)""")
def unresolved_citations(spark: SparkSession, sf: str) -> DataFrame:
    s = F.unix_timestamp("ts")
    points = _events(spark, sf, "view", "event_id", s.alias("s"))
    spans = _events(spark, sf, "click", s.alias("b"), (s + 3600).alias("e"))
    return joins.uncovered(points, spans, "user_id", "s", "b", "e").select("event_id")


@query("""WITH p AS (SELECT p_partkey, lower(concat(p_brand, ' ', p_type, ' ', CAST(p_size AS VARCHAR))) AS t FROM part) SELECT p_partkey AS articulo, min(p_partkey) OVER (PARTITION BY t) AS clase, count(*) OVER (PARTITION BY t) AS positivos FROM p""")
def same_text_positives(spark: SparkSession, sf: str) -> DataFrame:
    """The articles of one text are all positives of each: a class for each text, named by its least article."""
    p = table(spark, sf, "part").select("p_partkey", F.sha2(F.lower(F.concat_ws(" ", "p_brand", "p_type", "p_size")), 256).alias("fp"))
    classes = p.groupBy("fp").agg(F.min("p_partkey").alias("clase"), F.count("*").alias("positivos"))
    return p.join(classes, "fp").select(F.col("p_partkey").alias("articulo"), "clase", "positivos")


@query("SELECT 'event_type' AS columna, event_type AS valor, count(*) AS n FROM events GROUP BY event_type UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority")
def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    count = lambda t, c: table(spark, sf, t).groupBy(F.lit(c).alias("columna"), F.col(c).alias("valor")).agg(F.count("*").alias("n"))
    return count("events", "event_type").unionByName(count("orders", "o_orderpriority"))


@query("SELECT l_partkey, l_returnflag, count(*) AS filas, count(DISTINCT l_orderkey) AS fuentes, count(DISTINCT l_shipdate) AS textos FROM lineitem GROUP BY l_partkey, l_returnflag")
def stats_by_article_split(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_partkey", "l_returnflag").agg(F.count("*").alias("filas"), F.countDistinct("l_orderkey").alias("fuentes"), F.countDistinct("l_shipdate").alias("textos"))


@query("SELECT l_orderkey, max_by(l_shipdate, (l_linenumber, l_shipdate)) AS texto, array_to_string(list_sort(list_distinct(list(l_partkey))), ',') AS positivos FROM lineitem GROUP BY l_orderkey")
def gold_sets(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max_by("l_shipdate", F.struct("l_linenumber", "l_shipdate")).alias("texto"), F.array_join(F.array_sort(F.collect_set("l_partkey")), ",").alias("positivos"))


@query("SELECT o_custkey, o_orderdate FROM orders GROUP BY 1, 2 HAVING count(DISTINCT o_orderpriority) > 1")
def ambiguous_anchors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").groupBy("o_custkey", "o_orderdate").agg(F.countDistinct("o_orderpriority").alias("n")).where("n > 1").drop("n")


@query("SELECT l_partkey, l_suppkey FROM lineitem GROUP BY 1, 2 HAVING count(*) = 1 AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size < 10)")
def unique_entries(spark: SparkSession, sf: str) -> DataFrame:
    base = table(spark, sf, "part").where("p_size < 10").select(F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").count().where("count = 1").drop("count").join(base, "l_partkey", "left_anti")


@query("SELECT lang, round(quantile_cont(n_chars, 0.5), 3) AS p50, round(quantile_cont(n_chars, 0.95), 3) AS p95, max(n_chars) AS longest, round(avg(CASE WHEN n_chars > 2000 THEN 1.0 ELSE 0.0 END), 6) AS truncated FROM documents GROUP BY lang")
def length_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    p = F.percentile("n_chars", F.array(F.lit(0.5), F.lit(0.95)))
    out = table(spark, sf, "documents").groupBy("lang").agg(p.alias("p"), F.max("n_chars").alias("longest"), F.round(F.avg((F.col("n_chars") > 2000).cast("double")), 6).alias("truncated"))
    return out.select("lang", F.round(F.col("p")[0], 3).alias("p50"), F.round(F.col("p")[1], 3).alias("p95"), "longest", "truncated")


@query("WITH f AS (SELECT p_partkey, count(l_partkey) AS n FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY 1) SELECT p_partkey, round(least(4.0, sqrt((SELECT max(n) FROM f) / greatest(1, n))), 6) AS peso FROM f")
def class_weights(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count("*").alias("n"))
    f = table(spark, sf, "part").select("p_partkey").join(n, "p_partkey", "left").fillna(0, "n")
    return f.crossJoin(F.broadcast(f.agg(F.max("n").alias("m")))).select("p_partkey", F.round(F.least(F.lit(4.0), F.sqrt(F.col("m") / F.greatest(F.lit(1), "n"))), 6).alias("peso"))


@query("SELECT round(sum(n) / (SELECT count(*) FROM events), 6) AS cuota_top3 FROM (SELECT count(*) AS n FROM events GROUP BY event_type ORDER BY n DESC LIMIT 3)")
def freq_baseline(spark: SparkSession, sf: str) -> DataFrame:
    by = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return by.agg(F.sum("n").alias("total")).crossJoin(by.orderBy(F.desc("n"), "event_type").limit(3).agg(F.sum("n").alias("top"))).select(F.round(F.col("top") / F.col("total"), 6).alias("cuota_top3"))


@query("SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN 'hechos' WHEN event_type = 'error' THEN 'juridica' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS seccion FROM events")
def section_carry(spark: SparkSession, sf: str) -> DataFrame:
    heading = F.when(F.col("event_type") == "signup", "hechos").when(F.col("event_type") == "error", "juridica")
    return table(spark, sf, "events").select("event_id", curate.carry_forward(heading, "user_id", "ts", "event_id").alias("seccion"))


@query(f"SELECT event_id, coalesce(lead({_SECS}) OVER (PARTITION BY user_id ORDER BY ts, event_id), 4000000000) - {_SECS} AS longitud FROM events")
def segment_lead(spark: SparkSession, sf: str) -> DataFrame:
    s = F.unix_timestamp("ts")
    return table(spark, sf, "events").select("event_id", (F.lead(s, 1, 4_000_000_000).over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - s).alias("longitud"))


@query("""SELECT conv_id, turn, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS inicio FROM conversations""")
def page_offsets(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, sf, "conversations").select("conv_id", "turn", F.coalesce(F.sum(F.length("text") + 1).over(w), F.lit(0)).alias("inicio"))


@query("""SELECT a.p_brand, a.p_partkey, string_agg(CAST(b.p_partkey AS VARCHAR), ',' ORDER BY b.n) AS vecinos FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) a
JOIN (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) b ON a.p_brand = b.p_brand AND abs(a.n - b.n) BETWEEN 1 AND 8 GROUP BY 1, 2""")
def neighbor_articles(spark: SparkSession, sf: str) -> DataFrame:
    around = F.collect_list("p_partkey").over(Window.partitionBy("p_brand").orderBy("p_partkey").rowsBetween(-8, 8))
    others = F.filter(around, lambda k: k != F.col("p_partkey"))
    return table(spark, sf, "part").select("p_brand", "p_partkey", F.array_join(others, ",").alias("vecinos"))


@query("""SELECT p_brand, p_partkey, n AS negativo FROM (SELECT a.p_brand, a.p_partkey, b.p_partkey AS n, row_number() OVER (PARTITION BY a.p_partkey ORDER BY sha256(concat(CAST(a.p_partkey AS VARCHAR), '|', CAST(b.p_partkey AS VARCHAR)))) AS r
FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) a
JOIN (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part) b ON a.p_brand = b.p_brand AND abs(a.n - b.n) BETWEEN 1 AND 8) WHERE r <= 2""")
def neighbor_negatives(spark: SparkSession, sf: str) -> DataFrame:
    near = neighbor_articles(spark, sf).select("p_brand", "p_partkey", F.explode(F.split("vecinos", ",")).alias("n"))
    place = F.row_number().over(Window.partitionBy("p_partkey").orderBy(F.sha2(F.concat_ws("|", "p_partkey", "n"), 256)))
    return near.withColumn("r", place).where("r <= 2").select("p_brand", "p_partkey", F.col("n").cast("long").alias("negativo"))


@query("""WITH g AS (SELECT l_partkey, list({'k': [{'t': concat_ws('/', l_suppkey, l_returnflag), 'f': l_linenumber, 'p': l_extendedprice, 'o': l_orderkey}]} ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, concat_ws('/', l_suppkey, l_returnflag)) AS x FROM lineitem GROUP BY l_partkey),
d AS (SELECT l_partkey, list_reduce(x, lambda a, b: CASE WHEN list_contains(list_transform(a.k, lambda y: y.t), b.k[1].t) OR len(list_filter(a.k, lambda y: y.f = b.k[1].f)) >= 2 THEN a ELSE {'k': list_concat(a.k, b.k)} END) AS z FROM g)
SELECT l_partkey, u.t AS texto, u.f AS fuente, u.p AS l_extendedprice, u.o AS l_orderkey FROM (SELECT l_partkey, unnest(z.k) AS u FROM d)""")
def cap_per_source(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "lineitem").select("l_partkey", F.concat_ws("/", "l_suppkey", "l_returnflag").alias("texto"), F.col("l_linenumber").alias("fuente"), "l_extendedprice", "l_orderkey")
    return curate.greedy_cap(rows.withColumn("neg", -F.col("l_extendedprice")), "l_partkey", "texto", "fuente", ["neg", "l_orderkey", "fuente", "texto"]).drop("neg")


@query("SELECT l_partkey, l_orderkey, l_linenumber, n FROM (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n <= 15")
def review_queue(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("l_partkey").orderBy(F.desc("l_extendedprice"), "l_orderkey", "l_linenumber")
    return table(spark, sf, "lineitem").withColumn("n", F.row_number().over(w)).where("n <= 15").select("l_partkey", "l_orderkey", "l_linenumber", "n")


@query("SELECT o_orderkey, turn FROM (SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY sha256(CAST(o_orderkey AS VARCHAR))) AS turn FROM orders) ORDER BY turn, o_orderpriority LIMIT 1000")
def stratified_sample(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority")
    return curate.round_robin(o, "o_orderpriority", F.sha2(F.col("o_orderkey").cast("string"), 256), "o_orderpriority", 1000).select("o_orderkey", "turn")


@query("SELECT c_custkey AS id, c_name AS nombre, c_mktsegment AS segmento, CAST(NULL AS VARCHAR) AS extra FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, 'proveedor' FROM supplier")
def union_ragged(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("nombre"), F.col("c_mktsegment").alias("segmento"))
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("nombre"), F.lit("proveedor").alias("extra"))
    return c.unionByName(s, allowMissingColumns=True)


@query("""SELECT o_custkey, o_orderpriority, o_orderkey, p AS position FROM (SELECT *, min(o_orderkey) OVER (PARTITION BY o_custkey, o_orderpriority) AS p,
row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END, CASE WHEN o_orderstatus = 'F' THEN -o_orderkey ELSE o_orderkey END) AS r FROM orders) WHERE r = 1""")
def dedupe_approved(spark: SparkSession, sf: str) -> DataFrame:
    keys = ["o_custkey", "o_orderpriority"]
    return curate.dedupe_approved(table(spark, sf, "orders"), keys, F.col("o_orderstatus") == "F", "o_orderkey").select(*keys, "o_orderkey", "position")


@query("""SELECT 'congelado' AS paso, 0 AS cambios UNION ALL SELECT 'alterado', 2 * count(*) FROM orders WHERE o_orderstatus = 'F' AND o_orderkey % 100 = 0""")
def frozen_check(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the evaluation that a step added or took away: curation of train leaves them, another step doesn't."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    before = o.where("o_orderstatus = 'F'")
    train = curate.dedupe_first(o.where("o_orderstatus <> 'F'"), ["o_custkey"], ["o_orderkey"])[0]
    curated = train.unionByName(before.select("*")).where("o_orderstatus = 'F'")
    altered = before.withColumn("o_custkey", F.when(F.col("o_orderkey") % 100 == 0, -1).otherwise(F.col("o_custkey")))
    said = lambda name, after: curate.changed_rows(before, after).agg(F.count("*").alias("cambios")).select(F.lit(name).alias("paso"), "cambios")
    return said("congelado", curated).unionByName(said("alterado", altered))


@query("SELECT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE text IS NOT NULL AND length(text) > 0 AND lang = 'en')")
def incremental_missing(spark: SparkSession, sf: str) -> DataFrame:
    landed = table(spark, sf, "documents").where("length(text) > 0 AND lang = 'en'").select("doc_id")
    return table(spark, sf, "labels").select("doc_id").join(landed, "doc_id", "left_anti")


_CC = """WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey AS a, concat_ws('/', l_partkey, l_suppkey, l_returnflag) AS b FROM lineitem),
k AS (SELECT b FROM e GROUP BY b HAVING count(*) > 1), f AS (SELECT x.a, min(y.a) AS lo FROM e x JOIN e y ON x.b = y.b WHERE x.b IN (SELECT b FROM k) GROUP BY x.a, x.b),
u AS (SELECT DISTINCT a, lo AS b FROM f UNION SELECT DISTINCT lo, a FROM f), c(node, lab) AS (SELECT a, a FROM (SELECT DISTINCT a FROM e) UNION SELECT u.b, c.lab FROM c JOIN u ON u.a = c.node),
m AS (SELECT node, min(lab) AS component FROM c GROUP BY node)"""


def _components(spark: SparkSession, sf: str) -> DataFrame:
    """Orders linked by what they share; those that share nothing are alone."""
    line = table(spark, sf, "lineitem").select("l_orderkey", F.concat_ws("/", "l_partkey", "l_suppkey", "l_returnflag").alias("k"))
    found = graph.connected_components(graph.shared_keys(line, "l_orderkey", [F.col("k")]))
    nodes = line.select(F.col("l_orderkey").alias("node")).distinct()
    return nodes.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


@query(f"{_CC} SELECT node, component FROM m")
def connected_components(spark: SparkSession, sf: str) -> DataFrame:
    return _components(spark, sf)


@query(f"""{_CC}, g AS (SELECT component, sha256(lower(concat('["', string_agg(CAST(node AS VARCHAR), '", "' ORDER BY CAST(node AS VARCHAR)), '"]'))) AS grupo_id FROM m GROUP BY component) SELECT component, grupo_id FROM g""")
def group_id(spark: SparkSession, sf: str) -> DataFrame:
    by = _components(spark, sf).groupBy("component").agg(F.collect_set(F.col("node").cast("string")).alias("s"))
    return by.select("component", graph.group_id("s").alias("grupo_id"))


@query("""SELECT o_orderkey, CASE WHEN v < 0.8 THEN 'train' WHEN v < 0.9 THEN 'validation' ELSE 'test' END AS split
FROM (SELECT o_orderkey, ('0x' || substr(sha256(concat('42:', o_orderkey)), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 AS v FROM orders)""")
def hash_split(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", graph.hash_split(F.col("o_orderkey").cast("string")).alias("split"))


@query("""SELECT 'o_custkey' AS key, CAST(o_custkey AS VARCHAR) AS value, count(DISTINCT o_orderstatus) AS splits FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderstatus) > 1
UNION ALL SELECT 'o_orderpriority', lower(o_orderpriority), count(DISTINCT o_orderstatus) FROM orders GROUP BY lower(o_orderpriority) HAVING count(DISTINCT o_orderstatus) > 1""")
def leak_check(spark: SparkSession, sf: str) -> DataFrame:
    return graph.leaks(table(spark, sf, "orders"), ["o_custkey", "o_orderpriority"], "o_orderstatus", folded=("o_orderpriority",))
