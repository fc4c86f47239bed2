import random
import re

from pyspark.sql import functions as F

from pairloom.functions import spans, text as fx


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


def test_citation_lists_ranges_and_suffixes(spark):
    arts = lambda t: [c.articulo for c in one(spark, spans.penal_citations, t)]
    assert arts("arts. 251-253 del CP") == ["251", "253", "252"]
    assert arts("art. 335 del CP establece") == arts("art. 335 del CP. persona declaró") == ["335"]
    assert arts("art. 416 del CPP") == arts("art. 416 del C.P.P.") == arts(None) == []
    assert arts("art. 308 septies del Código Penal") == ["308 septies"]
    assert arts("arts. 282, 283 y 287, todos del Código Penal") == ["282", "283", "287"]
    assert arts("ARTÍCULOS 10 al 12 y 10 del CÓDIGO PENAL") == ["10", "12", "11"]
    assert arts("arts. 5-90 del CP") == ["5", "90"]


def test_lists_are_cut_once(spark):
    """Numbers as they are written, also those that are no int; a list's numbers are found without their places."""
    e = lambda t: one(spark, spans.expand, t)
    assert e("007, 3 - 5 y 99999999999, 10 BIS al 12, 4\u20136") == ["7", "3", "5", "4", "99999999999", "10 bis", "12", "6"]
    assert e("1 a 4, 1") == ["1", "4", "2", "3"] and e("1-60") == ["1", "60"] and e("000") == ["0"] and e("") == e(None) == []
    plan = spark.range(1).select(spans.expand(F.col("id").cast("string")))._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" in plan and "regexp_replace(coalesce" not in plan


def test_norms_and_unresolved_citations(spark):
    found = one(spark, spans.norm_citations, "art. 251 del Código Penal; arts. 124 y 173 del CPP; art. 5 de la Ley 348")
    assert [f"{c.norma}:{c.articulo}" for c in found] == ["CP:251", "CPP:124", "CPP:173", "LEY:348:5"]
    assert len(one(spark, spans.unresolved_citations, "El auto cita el art. 251 del CP. Se invoca el art. 124.")) == 1


def test_actions_and_facts(spark):
    assert one(spark, spans.past_actions, "abuso, violo el debido proceso") == 0
    assert one(spark, spans.past_actions, "golpeo y violo a la victima") == 2
    assert not one(spark, spans.tells_fact, "El tribunal violó el debido proceso.")
    assert one(spark, spans.tells_fact, "El imputado no golpeó a la víctima en su domicilio.")
    assert one(spark, spans.clean_facts, "Golpeó a uno. El tipo penal exige dolo. Casación y nulidad. Fin.") == "Golpeó a uno. Fin."


def test_structured_offsets(spark):
    text = "HECHOS PROBADOS: El hombre golpeó a la víctima con un objeto contundente en su casa de noche. Se condenó conforme al art. 271 del CP."
    rows = one(spark, spans.structured, text)
    assert rows[0].seccion == "hechos probados" and rows[0].hecho and rows[1].decision
    assert all(text[r.b : r.e] == r.texto for r in rows)
    assert one(spark, spans.structured, None) == one(spark, spans.fact_blocks, "") == []


def test_sentences_know_abbreviations(spark):
    text = "El Dr. Pérez vio el Art. Quinto; no más. Luego\nfin"
    assert [text[r.b : r.e] for r in one(spark, spans.sentences, text)] == ["El Dr. Pérez vio el Art. Quinto;", "no más.", "Luego", "fin"]


def test_code_articles(spark):
    pages = [["CÓDIGO PENAL\nArtículo 251.- \nArtículo 252 bis. (Uno). " + "x" * 20, "Artículo 253. (Dos). y\nCAPÍTULO I\nz\nArtículo 400. (No)"]]
    found = spark.createDataFrame(pages and [(pages[0],)], "p array<string>").select(spans.code_articles(F.col("p"), shortest=1).alias("x")).first().x
    assert [(r.articulo, r.pagina) for r in found] == [("252 bis", 1), ("253", 2)] and found[1].cuerpo == "Artículo 253. (Dos). y"


def test_page_articles(spark):
    """Row by row as from an array, also where a heading or body crosses pages; a long code takes no longer a page."""
    pages = ["Artículo 1. (Uno) a\nArtículo", "12\n2 bis", "(Dos) b", "sigue\nCAPÍTULO I\nno", None, "no\nArtículo 3. (Tres) c"]
    rows = spark.createDataFrame([(k, i, p) for k in (None, "x") for i, p in enumerate(pages)], "k string, i int, p string").repartition(3)
    got = spans.page_articles(rows, "k", "p", ["i"], shortest=1).collect()
    want = [("1", "Artículo 1. (Uno) a", 1), ("2 bis", "Artículo 2 bis (Dos) b sigue", 1), ("3", "Artículo 3. (Tres) c", 6)]
    assert all(sorted(tuple(r)[1:] for r in got if r.k == k) == want for k in (None, "x")) and len(got) == 6
    whole = spark.createDataFrame([(pages,), (["Artículo 1. (x) y"] * 20_000,)], "p array<string>").select(spans.code_articles(F.col("p"), shortest=1).alias("x")).collect()
    assert [tuple(r) for r in whole[0].x] == want and len(whole[1].x) == 20_000 and whole[1].x[-1].pagina == 20_000


def test_passage_window_by_whole_words(spark):
    text = "palabra " * 200 + "art. 5 del CP " + "palabra " * 200
    b = text.index("art.")
    got = spark.createDataFrame([(text,)], "t string").select(spans.passage_window(F.col("t"), F.lit(b), F.lit(b + 13))).first()[0]
    assert set(got.split()) == {"palabra"} and 600 < len(got) < 900
    short = spark.createDataFrame([("x art. 5 del CP y",)], "t string").select(spans.passage_window(F.col("t"), F.lit(2), F.lit(15))).first()[0]
    assert short == "x y"


def test_passages_match_whole_text(spark):
    """Windows from what lies near are those that all ends of the text give; sums of long arrays are in runs."""
    r, cited = random.Random(9), "art. 5 del CP"
    side = lambda n: "".join(r.choice(["uno ", "dos. ", ". \n ", "\n", "  ", "x" * 9, "y", "!\t", "\n\n"]) for _ in range(n))
    texts = [f"{side(r.choice([0, 3, 60]))} {cited} {side(r.choice([0, 3, 60]))}" for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").repartition(4).select("t", spans.passages(F.col("t"), 40, 30, 20).alias("x"), spans.passage_window(F.col("t"), F.instr("t", cited) - 1, F.instr("t", cited) - 1 + len(cited), 40, 30, 20).alias("w")).collect()
    for x in rows:
        m, b = x.t.replace(cited, " " * len(cited)), x.t.index(cited)
        e, n = b + len(cited), len(x.t)
        left, right, ends = max(0, b - 40), min(n, e + 30), [k.end() for k in re.finditer(r"[.!?]\s+|\n+", m)]
        first, last = re.search(r"\s", m[max(0, left - 1) : b - 1]), re.search(r"(?s)^(.*\s)", m[e:right])
        start = max((k for k in ends if left - 20 <= k <= left), default=0 if left == 0 else left + first.start() if first else b)
        stop = min((k for k in ends if right <= k <= right + 20), default=n if right == n else e + (last.end() if last else 0))
        if left == 0 or first:  # else whether a word ends at the citation itself
            assert x.w == x.x[0].texto == re.sub(r"\s+", " ", m[start:stop]).strip(), x.t
    sums = spark.range(1).select(spans.running(F.sequence(F.lit(1), F.lit(1000))).alias("x"), spans.running(F.array().cast("array<int>")).alias("y")).first()
    assert sums.x == [k * (k + 1) // 2 for k in range(1001)] and sums.y == [0]


def test_small_files_are_spread(spark, tmp_path):
    """A small file is read by one task; what takes long with each row is dealt to all cores."""
    from pairloom.plans import texts

    spark.range(400).selectExpr("id as p_partkey", "'a b' as p_name", "cast(id % 50 as int) as p_size", "'x' as p_brand", "'y' as p_type").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("passage_windows", "v7_facts", "quality_gate_text", "citations_unresolved"):
        df = getattr(texts, name)(spark, str(tmp_path))
        assert df.rdd.getNumPartitions() >= 4 and df.count() > 0, name


def test_mask_keeps_length(spark):
    r = random.Random(6)
    texts = ["".join(r.choice(["art. 5 del CP", "arts. 7-9 y 12 bis del Código Penal", "art. ", "arts ", "1", "25", " bis", " del ", "CP", "CPP", "Código Penal", ",", " y ", "-", "\n", "é", "🎉", ".", " "]) for _ in range(r.randint(0, 30))) for _ in range(300)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", spans.mask_citations(F.col("t")).alias("m"), spans.penal_citations(F.col("t")).alias("c"), spans.find(F.col("t"), r"\d+").alias("d")).collect()
    assert sum(len(x.c) for x in rows) > 20
    for x in rows:
        assert len(x.m) == len(x.t) and all(x.t[c.b : c.e] == c.cita for c in x.c)
        assert [(d.b, d.e, d.text) for d in x.d] == [(*m.span(), m[0]) for m in re.finditer("[0-9]+", x.t)]


def test_article_keys(spark):
    assert [one(spark, fx.article_key, v) for v in ("308bis", "335.0", "308 bis basura", None, "007")] == ["308 bis", "335", None, None, "7"]


def test_html(spark):
    assert one(spark, fx.clean_html, "<p>A&nbsp;B</p><p>C</p>") == "A B\nC"
    assert one(spark, fx.exact_clean_html, "<p>A&nbsp;B</p><p>C</p>") == "A B\nC"
    assert one(spark, fx.clean_html, '<script>var a="</p>"</script>x') == "x"
    assert one(spark, fx.clean_html, None) == ""


def test_classes_and_roles(spark):
    assert one(spark, fx.content_class, "inadmisible").procedural == 1
    assert one(spark, fx.content_class, "El día del recurso").kind == "indeterminado"
    assert one(spark, fx.citation_role, "acusación y absolvió") == "ambiguo"
    assert one(spark, fx.norm_id, "Ley N° 348") == "LEY:348"


def test_heading(spark):
    body = "No golpeó a nadie. " * 10
    assert one(spark, fx.strip_heading, "CONSIDERANDO: " + body) == body
    assert one(spark, fx.strip_heading, "CONSIDERANDO: corto") == "CONSIDERANDO: corto"


def test_shingles(spark):
    assert one(spark, fx.shingles, "a b c d") == []
    assert one(spark, fx.shingles, "Ä b c d e f") == ["a b c d e", "b c d e f"]
