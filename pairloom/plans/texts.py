"""Text operators on documents, pages and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pairloom.functions import spans, text as fx
from pairloom.operators import curate, graph, joins
from pairloom.plans.registry import query
from pairloom.sources import files
from pairloom.storage import materialise, spread, table

_NORM = "trim(regexp_replace(replace(coalesce(text, ''), chr(160), ' '), '\\s+', ' ', 'g'))"
_FP = f"sha256(replace(lower({_NORM}), 'ß', 'ss'))"
_PLAIN = "strip_accents(replace(lower(coalesce(text, '')), 'ß', 'ss'))"
_WORDS = f"list_filter(regexp_split_to_array({_PLAIN}, '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda x: x <> '')"
_SHINGLES = "CASE WHEN len(w) < 5 THEN [] ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) END"


@query(f"SELECT doc_id, {_FP} AS huella FROM documents")
def fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", fx.fingerprint(F.col("text")).alias("huella"))


@query(f"SELECT lang, count(*) AS filas, count(DISTINCT {_FP}) AS textos, count(*) FILTER (coalesce(trim(text), '') = '') AS vacios FROM documents GROUP BY lang")
def scan_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("filas"), F.countDistinct(fx.fingerprint(F.col("text"))).alias("textos"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("vacios"))


@query(f"SELECT doc_id, sha256({_NORM}) AS limpio FROM documents")
def normalize(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(fx.normalise(F.col("text")), 256).alias("limpio"))


@query(f"SELECT doc_id, sha256({_PLAIN}) AS llano FROM documents")
def plain(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.sha2(fx.plain(F.col("text")), 256).alias("llano"))


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY {_FP}, lang ORDER BY doc_id) AS n FROM documents) WHERE n = 1")
def dedupe_first(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", fx.fingerprint(F.col("text")).alias("fp"))
    return curate.dedupe_first(docs, ["fp", "lang"], ["doc_id"])[0].select("doc_id")


_BARE = f"trim(regexp_replace(regexp_replace({_PLAIN}, '[^\\p{{L}}\\p{{M}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(f"SELECT min(doc_id) AS doc_id, count(*) AS copias FROM documents GROUP BY {_BARE}")
def dedupe_punct(spark: SparkSession, sf: str) -> DataFrame:
    bare = fx.normalise(F.regexp_replace(fx.plain(F.col("text")), r"(?U)[^\w\s]", " "))
    return table(spark, sf, "documents").groupBy(F.sha2(bare, 256)).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copias")).select("doc_id", "copias")


@query(f"SELECT doc_id, CAST(len({_SHINGLES}) AS INTEGER) AS n FROM (SELECT doc_id, {_WORDS} AS w FROM documents)")
def shingles(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", F.size(fx.shingles(F.col("text"))).alias("n"))


@query(f"""WITH d AS (SELECT doc_id, {_SHINGLES} AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents)), b AS (SELECT item_id, {_SHINGLES} AS s FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)),
x AS (SELECT doc_id, len(s) AS nd, unnest(s) AS t FROM d), y AS (SELECT item_id, len(s) AS nb, unnest(s) AS t FROM b)
SELECT doc_id, item_id, count(*) AS common FROM x JOIN y USING (t) GROUP BY doc_id, item_id, nd, nb HAVING count(*) >= 0.75 * least(nd, nb)""")
def near_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Shingles meet as hashes; the pairs that reach the threshold are confirmed by the words."""
    of = lambda t, i: table(spark, sf, t).select(i, "text")
    docs, held = of("documents", "doc_id"), of("benchmark", "item_id")
    hashed = lambda rows, i: rows.select(i, fx.shingle_hashes(F.col("text")).alias("s"))
    near = materialise(joins.containment(hashed(docs, "doc_id"), hashed(held, "item_id"), "doc_id", "item_id", "s"), "near")
    words = lambda rows, i, name: rows.join(near.select(i).distinct(), i, "left_semi").select(i, fx.shingles(F.col("text")).alias(name))
    both = near.select("doc_id", "item_id").join(words(docs, "doc_id", "a"), "doc_id").join(words(held, "item_id", "b"), "item_id")
    both = both.withColumn("common", F.size(F.array_intersect("a", "b")).cast("long"))
    return both.where(F.col("common") >= 0.75 * F.least(F.size("a"), F.size("b"))).select("doc_id", "item_id", "common")


_CLEAN = r"""regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '<script\b[^>]*>.*?</script>', ' ', 'gis'), '<style\b[^>]*>.*?</style>', ' ', 'gis'), '</?(?:p|div|br|li|h[1-6])\b[^>]*>', chr(10), 'gi')"""
_LINES = f"""array_to_string(list_filter(list_transform(string_split(replace(replace(replace(replace(regexp_replace({_CLEAN}, '<[^>]+>', ' ', 'g'), '&quot;', '"'), '&copy;', '©'), '&middot;', '·'), '&amp;', '&'), chr(10)),
lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10))"""


@query(f"SELECT page_id, sha256({_LINES}) AS texto, length({_LINES}) AS n FROM pages")
def html_clean(spark: SparkSession, sf: str) -> DataFrame:
    t = fx.clean_html(F.col("html"))
    return table(spark, sf, "pages").select("page_id", F.sha2(t, 256).alias("texto"), F.length(t).cast("long").alias("n"))


@query(r"SELECT host, count(*) AS n FROM (SELECT regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host FROM pages) WHERE host LIKE '%.com' OR host LIKE '%.org' GROUP BY host")
def host_allowlist(spark: SparkSession, sf: str) -> DataFrame:
    host = F.parse_url("url", F.lit("HOST"))
    return table(spark, sf, "pages").select(host.alias("host")).where(F.col("host").rlike(r"\.(com|org)$")).groupBy("host").agg(F.count("*").alias("n"))


@query("SELECT event_id, try_cast(json_extract_string(props, '$.page') AS INTEGER) AS pagina, NOT json_valid(props) AS error FROM events")
def error_side_output(spark: SparkSession, sf: str) -> DataFrame:
    page = F.get_json_object("props", "$.page").try_cast("int")
    return table(spark, sf, "events").select("event_id", page.alias("pagina"), F.coalesce(F.try_parse_json("props").isNull(), F.lit(True)).alias("error"))


@query()
def file_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """Every file of the folder."""
    return files.file_hashes(spark, sf, "*.parquet").select(F.regexp_extract("path", r"([^/]+)\.parquet", 1).alias("tabla"), "length", "sha256")


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, concat('Visto el caso: arts. ', l_linenumber, '-', l_linenumber + 2, ' del Código Penal') AS x FROM lineitem)
SELECT l_orderkey, l_linenumber, l_linenumber + unnest([0, 2, 1]) AS articulo, unnest([1, 2, 3]) AS pos, 15 AS b, CAST(length(x) AS INTEGER) AS e FROM t""")
def citations(spark: SparkSession, sf: str) -> DataFrame:
    cited = F.concat(F.lit("Visto el caso: arts. "), "l_linenumber", F.lit("-"), F.col("l_linenumber") + 2, F.lit(" del Código Penal"))
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.posexplode_outer(spans.penal_citations(cited)).alias("p", "c")).where("c is not null")
    return rows.select("l_orderkey", "l_linenumber", F.col("c.articulo").cast("int").alias("articulo"), (F.col("p") + 1).alias("pos"), "c.b", "c.e")


@query("""WITH t AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, concat('art. ', l_partkey, ' inciso 3 del Código Penal') AS x, concat('arts. ', l_suppkey, ' del CPP') AS y, concat('art. 5 de la Ley ', l_linenumber) AS z FROM lineitem)
SELECT l_orderkey, l_linenumber, unnest(['CP', 'CPP', 'LEY:' || l_linenumber]) AS norma, unnest([CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR), '5']) AS articulo, unnest(['3', NULL, NULL]) AS inciso,
CAST(unnest([0, length(x) + 2, length(x) + length(y) + 4]) AS INTEGER) AS b, CAST(unnest([length(x), length(x) + length(y) + 2, length(x) + length(y) + length(z) + 4]) AS INTEGER) AS e FROM t""")
def citations_v7(spark: SparkSession, sf: str) -> DataFrame:
    cited = F.concat(F.lit("art. "), "l_partkey", F.lit(" inciso 3 del Código Penal; arts. "), "l_suppkey", F.lit(" del CPP; art. 5 de la Ley "), "l_linenumber")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", spans.each(spans.norm_citations(cited)).alias("c")).where("c is not null").select("l_orderkey", "l_linenumber", "c.norma", "c.articulo", "c.inciso", "c.b", "c.e")


@query("""WITH t AS (SELECT p_partkey, concat('Se invoca el art. ', p_size) AS x, concat(' y el art. ', p_size + 1, ' del CP') AS y, p_size FROM part)
SELECT p_partkey, 13 AS b, CAST(length(x) AS INTEGER) AS e, concat('art. ', p_size) AS cita FROM t""")
def citations_unresolved(spark: SparkSession, sf: str) -> DataFrame:
    said = F.concat(F.lit("Se invoca el art. "), "p_size", F.lit(". Luego el art. "), F.col("p_size") + 1, F.lit(" del CP"))
    return spread(table(spark, sf, "part").select("p_partkey", "p_size")).select("p_partkey", spans.each(spans.unresolved_citations(said)).alias("x")).where("x is not null").select("p_partkey", "x.b", "x.e", F.col("x.text").alias("cita"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'condena' WHEN 1 THEN 'ambiguo' WHEN 2 THEN 'no_identificado' ELSE 'precedente' END AS papel, CASE p_size % 4 WHEN 0 THEN 'condena' WHEN 1 THEN 'ambiguo' WHEN 2 THEN 'cita_sin_aplicacion_demostrada' ELSE 'precedente_o_documento_citado' END AS papel_v7 FROM part")
def citation_role(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("p_size") % 4
    said = F.concat(F.when(kind == 0, "Se condenó a ").when(kind == 1, "La acusación fue rechazada y absolvió a ").when(kind == 2, "Consta en ").otherwise("Como precedente, "), "p_name")
    return table(spark, sf, "part").select("p_partkey", fx.citation_role(said).alias("papel"), fx.citation_role_v7(said).alias("papel_v7"))


@query("SELECT p_partkey, CASE p_size % 4 WHEN 0 THEN 'factico' WHEN 1 THEN 'procesal' WHEN 2 THEN 'mixto' ELSE 'indeterminado' END AS tipo FROM part")
def content_class(spark: SparkSession, sf: str) -> DataFrame:
    kind = F.col("p_size") % 4
    said = F.concat("p_name", F.when(kind == 0, " Golpeó y fue visto.").when(kind == 1, " nulidad: inadmisible.").when(kind == 2, " golpeó; nulidad").otherwise(" el día del recurso"))
    return table(spark, sf, "part").select("p_partkey", fx.content_class(said)["kind"].alias("tipo"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN repeat(p_name || ' ', 30) ELSE 'CONSIDERANDO: ' || p_name END AS texto FROM part")
def header_strip(spark: SparkSession, sf: str) -> DataFrame:
    said = F.concat(F.lit("CONSIDERANDO: "), F.when(F.col("p_size") % 2 == 0, F.repeat(F.concat("p_name", F.lit(" ")), 30)).otherwise(F.col("p_name")))
    return table(spark, sf, "part").select("p_partkey", fx.strip_heading(said).alias("texto"))


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) || CASE WHEN p_size % 3 = 0 THEN ' bis' ELSE '' END AS clave, p_size AS base, CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS sufijo FROM part")
def article_keys(spark: SparkSession, sf: str) -> DataFrame:
    key = fx.article_key(F.concat(F.lit(" 0"), "p_size", F.when(F.col("p_size") % 3 == 0, "bis").otherwise(".0")))
    order = fx.article_order(F.col("clave"))
    return table(spark, sf, "part").select("p_partkey", key.alias("clave")).select("p_partkey", "clave", order["base"].alias("base"), order["suffix"].alias("sufijo"))


@query(f"SELECT item_id AS doc_id, sha256(regexp_replace(text, '(?i)\\bthe\\b', 'a', 'g')) AS texto FROM benchmark WHERE regexp_matches(text, '(?i)\\bthe\\b')")
def synonym_augment(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text").withColumn("new", fx.substitute(F.col("text"), "the", "a"))
    return rows.where("new <> text").select("doc_id", F.sha2("new", 256).alias("texto"))


#: A ruling of each part, the same in both engines: a heading with a fact, a decision with a citation, and a closing.
_HEAD, _FACT = "HECHOS PROBADOS: ", "El acusado golpeó a la víctima con "
_SCENE = " en la calle del centro de la ciudad de noche, según el Dr. Pérez."
_RULING = ["Se condenó conforme al art. ", " del CP.", "POR TANTO: se anula el auto."]
_RULING_SQL = f"concat('{_HEAD}{_FACT}', p_name, '{_SCENE} {_RULING[0]}', p_size, '{_RULING[1]} {_RULING[2]}')"


def _ruling(spark: SparkSession, sf: str) -> DataFrame:
    said = F.concat(F.lit(_HEAD + _FACT), "p_name", F.lit(f"{_SCENE} {_RULING[0]}"), "p_size", F.lit(f"{_RULING[1]} {_RULING[2]}"))
    return spread(table(spark, sf, "part").select("p_partkey", "p_name", "p_size")).select("p_partkey", said.alias("t"))


_PARTS = f"""WITH t AS (SELECT p_partkey, p_name, p_size, {_RULING_SQL} AS t FROM part),
s AS (SELECT p_partkey, t, CAST(strpos(t, 'Se condenó') - 1 AS INTEGER) AS c, CAST(strpos(t, 'POR TANTO') - 1 AS INTEGER) AS p, CAST(length(t) AS INTEGER) AS n FROM t)"""


@query(f"{_PARTS} SELECT p_partkey, unnest([0, c, p]) AS b, unnest([c - 1, p - 1, n]) AS e FROM s")
def sentences(spark: SparkSession, sf: str) -> DataFrame:
    return _ruling(spark, sf).select("p_partkey", spans.each(spans.sentences(F.col("t"))).alias("x")).where("x is not null").select("p_partkey", "x.*")


@query(f"{_PARTS} SELECT p_partkey, unnest([0, d, c, p]) AS b, unnest([d, c, p, n]) AS e FROM (SELECT *, CAST(strpos(t, 'Pérez') - 1 AS INTEGER) AS d FROM s)")
def paragraphs(spark: SparkSession, sf: str) -> DataFrame:
    return _ruling(spark, sf).select("p_partkey", spans.each(spans.paragraphs(F.col("t"))).alias("x")).where("x is not null").select("p_partkey", "x.*")


#: Five paragraphs: a heading, facts by the part's size, a legal heading, what looks factual there, and procedure.
_BLOCKS = ["RELACIÓN DE HECHOS", "El acusado disparó contra la víctima y huyó con ", "FUNDAMENTOS JURÍDICOS", "El tribunal dice que alguien vendió lo que no era suyo y obligó a otro a callar en ", "Recurso de casación, apelación, agravio y nulidad; el fallo dice que alguien golpeó en "]
_PAD = " y así consta en los papeles que se guardan."


@query(f"""WITH t AS (SELECT p_partkey, concat('{_BLOCKS[1]}', p_name, repeat('{_PAD}', p_size % 3)) AS f, concat('{_BLOCKS[3]}', p_name, '{_PAD}') AS l FROM part),
s AS (SELECT p_partkey, {len(_BLOCKS[0]) + 1} AS b1, {len(_BLOCKS[0]) + 1} + length(f) + 1 AS e1, {len(_BLOCKS[0]) + 1} + length(f) + 1 + {len(_BLOCKS[2]) + 1} AS b2, length(f) AS n1, length(l) AS n2 FROM t)
SELECT p_partkey, CAST(b1 AS INTEGER) AS b, CAST(e1 AS INTEGER) AS e, 'hechos' AS seccion, 1 AS senales_facticas, 0 AS senales_procesales, 8 AS prioridad, 1 AS n FROM s WHERE n1 >= 100
UNION ALL SELECT p_partkey, CAST(b2 AS INTEGER), CAST(b2 + n2 + 1 AS INTEGER), 'juridica', 2, 0, 6, CASE WHEN n1 >= 100 THEN 2 ELSE 1 END FROM s WHERE n2 >= 100""")
def fact_blocks(spark: SparkSession, sf: str) -> DataFrame:
    """The best blocks of each text; procedure outweighs the last paragraph's one verb."""
    line = lambda i: F.concat(F.lit(_BLOCKS[i]), "p_name", F.lit(_PAD))
    fact = F.concat(F.lit(_BLOCKS[1]), "p_name", F.repeat(F.lit(_PAD), F.col("p_size") % 3))
    said = F.concat_ws("\n", F.lit(_BLOCKS[0]), fact, F.lit(_BLOCKS[2]), line(3), line(4))
    rows = spread(table(spark, sf, "part").select("p_partkey", "p_name", "p_size")).select("p_partkey", spans.each(spans.fact_blocks(said)).alias("x")).where("x is not null").select("p_partkey", "x.*").drop("texto")
    return curate.best(rows, ["p_partkey"], [F.desc("prioridad"), "b"], 4)


def _structured(spark: SparkSession, sf: str) -> DataFrame:
    return _ruling(spark, sf).select("p_partkey", spans.each(spans.structured(F.col("t"))).alias("x")).where("x is not null").select("p_partkey", "x.*")


@query(f"{_PARTS} SELECT p_partkey, {len(_HEAD)} AS b, c - 1 AS e, 'hechos probados' AS seccion, sha256(concat_ws('|', p_partkey, 'hecho', {len(_HEAD)}, c - 1)) AS hecho_id FROM s WHERE c - 1 - {len(_HEAD)} >= 60")
def v7_facts(spark: SparkSession, sf: str) -> DataFrame:
    rows = _structured(spark, sf).where("hecho")
    return rows.select("p_partkey", "b", "e", "seccion", F.sha2(F.lower(F.concat_ws("|", "p_partkey", F.lit("hecho"), "b", "e")), 256).alias("hecho_id"))


@query(f"""{_PARTS} SELECT p_partkey, 'hechos probados' AS seccion, 2 AS oraciones, 1 AS decisiones, 1 AS hechos FROM s UNION ALL SELECT p_partkey, 'por tanto', 1, 1, 0 FROM s""")
def v7_section(spark: SparkSession, sf: str) -> DataFrame:
    rows = _structured(spark, sf)
    return rows.groupBy("p_partkey", "seccion").agg(F.count("*").alias("oraciones"), F.count_if("decision").alias("decisiones"), F.count_if("hecho").alias("hechos"))


@query(f"""WITH t AS (SELECT p_partkey, {_RULING_SQL} AS t, concat('art. ', p_size, ' del CP.') AS c FROM part) SELECT p_partkey, replace(t, c, repeat(' ', length(c))) AS texto FROM t""")
def masked_passages(spark: SparkSession, sf: str) -> DataFrame:
    return _ruling(spark, sf).select("p_partkey", spans.mask_citations(F.col("t")).alias("texto"))


_STEP = "Uno dos tres. "


@query(f"""WITH t AS (SELECT p_partkey, 100 + p_size AS k, concat('art. ', p_size, ' del Código Penal') AS c FROM part),
x AS (SELECT p_partkey, c, {len(_STEP)} * k AS b, {len(_STEP)} * k + length(c) AS e, concat(repeat('{_STEP}', k), c, ' ', repeat('{_STEP}', 40)) AS t FROM t),
w AS (SELECT p_partkey, b - 650 - (b - 650) % {len(_STEP)} AS l, e + 1 + {len(_STEP)} * CAST(ceil(249 / {len(_STEP)}) AS BIGINT) AS r, replace(t, c, repeat(' ', length(c))) AS m, b, e, t FROM x)
SELECT p_partkey, trim(regexp_replace(substr(m, CAST(l + 1 AS BIGINT), CAST(r - l AS BIGINT)), '\\s+', ' ', 'g')) AS texto, substr(t, CAST(b - 219 AS BIGINT), CAST(e - b + 440 AS BIGINT)) AS evidencia FROM w""")
def passage_windows(spark: SparkSession, sf: str) -> DataFrame:
    """The window of each citation of the code, and what lies around it; windows of fewer than 150 characters go."""
    said = F.concat(F.repeat(F.lit(_STEP), F.col("p_size") + 100), F.lit("art. "), "p_size", F.lit(" del Código Penal "), F.repeat(F.lit(_STEP), 40))
    good = F.filter(spans.passages(said), lambda x: F.length(x["texto"]) >= 150)
    return spread(table(spark, sf, "part").select("p_partkey", "p_size")).select("p_partkey", spans.each(good).alias("x")).where("x is not null").select("p_partkey", "x.texto", "x.evidencia")


#: What the quality gate reads, by a part's size: facts, too little, one action, negation, procedure.
_SAID = [
    "El acusado golpeó a la víctima y sustrajo su bolso en la plaza de la ciudad de noche. El tipo penal exige dolo. Después huyó por la calle mayor hasta el puente y fue visto por dos vecinos que volvían del mercado con ",
    "Golpeó y sustrajo ",
    "El acusado golpeó a la víctima en la plaza de la ciudad de noche. Después huyó por la calle mayor hasta el puente del río y fue visto por dos vecinos que volvían del mercado grande del barrio viejo con ",
    "El acusado golpeó a la víctima y sustrajo su bolso en la plaza de la ciudad. No se demostró que huyera por la calle mayor hasta el puente, ni que fuera visto por dos vecinos que volvían del mercado con ",
    "El acusado golpeó a la víctima y sustrajo su bolso en la plaza; casación, apelación, agravio y nulidad constan en autos. Después huyó por la calle mayor hasta el puente y fue visto por dos vecinos que volvían con ",
]
_WHY = "CASE p_size % 5 WHEN 1 THEN 'longitud' WHEN 2 THEN 'pocas_acciones' WHEN 3 THEN 'doctrina_o_negacion' WHEN 4 THEN 'contenido_procesal' ELSE CASE WHEN p_size * 10 > 400 THEN 'cita_lejana' END END"


@query(f"SELECT p_partkey, {_WHY} AS motivo, CASE WHEN p_size * 10 <= 250 AND p_size % 5 <> 4 THEN 'conservador' ELSE 'ampliado' END AS nivel, CASE p_size % 5 WHEN 2 THEN 1 ELSE 2 END AS acciones, CASE p_size % 5 WHEN 4 THEN 4 ELSE 0 END AS procesales FROM part")
def quality_gate_text(spark: SparkSession, sf: str) -> DataFrame:
    """The gate on texts: cleaned of theory first, then counted."""
    said = F.concat(F.get(F.array(*map(F.lit, _SAID)), F.col("p_size") % 5), "p_name")
    rows = spread(table(spark, sf, "part").select("p_partkey", "p_name", "p_size")).select("p_partkey", "p_size", spans.each(F.array(spans.fact_features(said))).alias("x"))
    c = {
        "split": F.lit("train"), "in_catalogue": F.lit(True), "excluded": F.lit(False), "base": F.col("p_size") + 100, "role": F.lit("condena"), "length": F.length("x.texto"), "actions": F.col("x.acciones"),
        "procedural": F.col("x.procesales"), "theory": F.col("x.teoria"), "distance": F.col("p_size") * 10, "section": F.lit("hechos"),
    }
    return rows.select("p_partkey", curate.quality_reason(c).alias("motivo"), curate.quality_tier(c).alias("nivel"), "x.acciones", "x.procesales")


@query("""SELECT p_brand, CAST(p_size AS VARCHAR) AS articulo, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY concat('Artículo ', p_size, '. (', p_name, '). ', repeat(concat(p_type, ' '), 20))) AS INTEGER) AS pagina,
CAST(length(trim(concat('Artículo ', p_size, '. (', p_name, '). ', repeat(concat(p_type, ' '), 20)))) AS INTEGER) AS n FROM part""")
def official_articles(spark: SparkSession, sf: str) -> DataFrame:
    """A code of one article for each part, as pages by brand; each page has a header and ends in a chapter."""
    body = F.concat(F.lit("Artículo "), "p_size", F.lit(". ("), "p_name", F.lit("). "), F.repeat(F.concat("p_type", F.lit(" ")), 20))
    pages = table(spark, sf, "part").select("p_brand", body.alias("body"))
    pages = pages.select("p_brand", "body", F.concat(F.lit("CÓDIGO PENAL\n"), "body", F.lit("\nCAPÍTULO II\nOtra cosa\n12")).alias("page"))
    return spans.page_articles(pages, "p_brand", "page", ["body"]).select("p_brand", "articulo", "pagina", F.length("cuerpo").alias("n"))


@query("SELECT concat(l_suppkey, ' bis') AS numero, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY l_suppkey ORDER BY n DESC, numero LIMIT 15")
def bis_top15(spark: SparkSession, sf: str) -> DataFrame:
    """Each number once for each text, then the most frequent."""
    texts = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(F.concat(F.lit("art. "), "l_suppkey", F.lit(" bis"))), "; ").alias("t"))
    return texts.select(F.explode(spans.bis_numbers(F.col("t"))).alias("numero")).groupBy("numero").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "numero").limit(15)


@query("SELECT p_partkey, concat(p_name, ' fin 1 café') AS texto FROM part")
def normalize_nfkc(spark: SparkSession, sf: str) -> DataFrame:
    said = F.concat(F.lit("  "), "p_name", F.lit("\u00a0 ﬁn\t① cafe\u0301 "))
    return table(spark, sf, "part").select("p_partkey", fx.exact_normalise(said).alias("texto"))


@query("SELECT p_partkey, concat('é ', p_name, chr(10), '½ & x') AS texto FROM part")
def html_entities(spark: SparkSession, sf: str) -> DataFrame:
    """Every named and numbered entity, by an Arrow UDF; the native function knows a few."""
    said = F.concat(F.lit("<style>p{}</style><p>&eacute; "), "p_name", F.lit("</p>&frac12; &#38;<b>x</b>"))
    return table(spark, sf, "part").select("p_partkey", F.regexp_replace(fx.exact_clean_html(said), "1⁄2", "½").alias("texto"))


@query(f"""WITH d AS (SELECT doc_id, {_FP} AS fp, row_number() OVER (PARTITION BY {_FP} ORDER BY doc_id) AS n FROM documents),
s AS (SELECT *, ('0x' || substr(sha256(concat('42:', fp)), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616.0 AS v FROM d)
SELECT CASE WHEN v < 0.8 THEN 'train' WHEN v < 0.9 THEN 'validation' ELSE 'test' END AS split, count(*) AS filas, count(*) FILTER (n = 1) AS unicas FROM s GROUP BY 1""")
def curated_split(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", fx.fingerprint(F.col("text")).alias("fp"))
    docs = docs.withColumn("n", F.row_number().over(Window.partitionBy("fp").orderBy("doc_id")))
    return docs.groupBy(graph.hash_split(F.col("fp")).alias("split")).agg(F.count("*").alias("filas"), F.count_if(F.col("n") == 1).alias("unicas"))
