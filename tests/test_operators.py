import math
import pathlib
import random

import pytest
from pyspark.sql import functions as F

from pairloom.operators import curate, graph, joins, metrics, retrieval
from pairloom.sources import files, sinks
from pairloom.streaming import landing

ROOT = pathlib.Path(__file__).resolve().parents[1]


def test_components_any_order(spark):
    edges = [(1, 2), (2, 3), (7, 8), (9, 9), (None, 4), (2, 1)] + [(i, i + 1) for i in range(20, 60)]
    want = {1: 1, 2: 1, 3: 1, 7: 7, 8: 7, 9: 9} | {i: 20 for i in range(20, 61)}
    for seed in (1, 2):
        random.Random(seed).shuffle(edges)
        rows = graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert {r.node: r.component for r in rows} == want
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    rows = spark.createDataFrame([(1, "x", None), (2, "x", "y"), (3, None, "y"), (4, "z", None), (1, "x", None)], "n long, k string, j string")
    assert sorted(map(tuple, graph.shared_keys(rows, "n", [F.col("k"), F.col("j")]).collect())) == [(2, 1), (3, 2)]


def test_group_and_split(spark):
    import hashlib

    row = spark.range(1).select(graph.group_id(F.array(F.lit(2), F.lit(1))).alias("g"), graph.hash_split(F.lit("x")).alias("s")).first()
    assert row.g == hashlib.sha256(b'["1", "2"]').hexdigest()
    v = int(hashlib.sha256(b"42:x").hexdigest()[:16], 16) / 2**64
    assert row.s == ("train" if v < 0.8 else "validation" if v < 0.9 else "test")


def test_leak(spark):
    rows = spark.createDataFrame([("a", "train"), ("a", "test"), ("b", "train")], "t string, split string")
    assert [r.value for r in graph.leaks(rows, ["t"]).collect()] == ["a"]
    folded = spark.createDataFrame([("A-1", "train"), ("a-1", "test")], "t string, split string")
    assert graph.leaks(folded, ["t"]).count() == 0 and graph.leaks(folded, ["t"], folded=("t",)).count() == 1
    assert graph.one_split(rows.where("t = 'b'"), "t").first().split == "train"
    with pytest.raises(Exception, match="several splits"):
        graph.one_split(rows, "t").collect()


def test_greedy_cap_is_sequential(spark):
    rows = spark.createDataFrame([(1, "t1", "s", 1), (1, "t2", "s", 2), (1, "t3", "s", 3), (1, "t3", "u", 4), (1, "t1", "u", 5)], "p int, t string, s string, o int")
    kept = curate.greedy_cap(rows, "p", "t", "s", ["o"]).collect()
    assert sorted(r.o for r in kept) == [1, 2, 4]
    r = random.Random(2)
    many = [(r.randrange(5), r.choice("abcdefgh"), r.choice("xyz"), i) for i in range(400)]
    want, seen, have = [], set(), {}
    for p, t, s, o in sorted(many, key=lambda x: (x[0], x[3])):
        if (p, t) not in seen and have.get((p, s), 0) < 2:
            seen.add((p, t))
            have[p, s] = have.get((p, s), 0) + 1
            want.append(o)
    got = curate.greedy_cap(spark.createDataFrame(many, "p int, t string, s string, o int"), "p", "t", "s", ["o"]).collect()
    assert sorted(x.o for x in got) == sorted(want)


def test_reviews(spark):
    cand = spark.createDataFrame([("a", "331", "pendiente"), ("b", "1", "pendiente"), ("c", "2", "pendiente")], "candidate_id string, articulo string, estado_revision string")
    rev = spark.createDataFrame([("a", "aprobar", ["332"]), ("b", "rechazar", [])], "candidate_id string, decision string, articulos_aprobados array<string>")
    assert sorted(map(tuple, curate.apply_reviews(cand, rev).collect())) == [("a", "332", "aprobado"), ("c", "2", "pendiente")]
    with pytest.raises(Exception, match="unknown candidate"):
        curate.apply_reviews(cand, rev.withColumn("candidate_id", F.lit("z"))).collect()


def test_paraphrases(spark):
    schema = "hechos string, articulo string, split string, estado_revision string"
    rows = spark.createDataFrame([("El robo fue de noche", "1", "train", "aprobado"), ("el hurto fue de noche", "1", "train", "pendiente"), ("robo", "2", "test", "aprobado")], schema)
    got = curate.augmented(rows, {"robo": ["hurto"], "noche": ["madrugada $1"]}).where("tipo = 'parafraseado'").collect()
    assert [(r.hechos, r.articulo, r.regla_aumento) for r in got] == [("El robo fue de madrugada $1", "1", "noche")]
    assert curate.augmented(rows, {}).count() == 3


def test_joins(spark):
    left = spark.createDataFrame([(1, "x", 10, 20)], "k int, id string, b int, e int")
    right = spark.createDataFrame([(1, 1, 0, 5), (1, 2, 12, 14), (1, 3, 21, 22)], "k int, c int, s int, t int")
    points = spark.createDataFrame([(1, 4), (1, 5), (1, 13), (1, 30), (2, 3)], "k int, at int")
    assert sorted(map(tuple, joins.uncovered(points, right, "k", "at", "s", "t").collect())) == [(1, 5), (1, 30), (2, 3)]
    near = joins.nearest(left, right, "k", joins.interval_distance(F.col("b"), F.col("e"), F.col("s"), F.col("t")), ["c"], ["id"]).first()
    assert (near.c, near.distance) == (2, 0)
    a = spark.createDataFrame([(1, ["a", "b", "c"]), (2, []), (3, None)], "l int, s array<string>")
    b = spark.createDataFrame([(9, ["a", "b", "c", "d", "e"]), (8, ["z"])], "r int, s array<string>")
    assert [tuple(r) for r in joins.containment(a, b, "l", "r", "s").collect()] == [(1, 9, 3)]


def test_nearest_spans_match_all_pairs(spark):
    r = random.Random(7)
    left = spark.createDataFrame([(r.randrange(3), i, b := r.randrange(200), b + r.randrange(1, 30)) for i in range(80)], "k int, id int, b int, e int")
    spans = [(r.randrange(3), i, r.randrange(220)) for i in range(40)]
    distance = {True: joins.endpoint_distance, False: joins.interval_distance}
    for crossed in (True, False):
        # Crossed ends allow any spans; intervals, those of one width.
        right = spark.createDataFrame([(k, c, s, s + (r.randrange(1, 40) if crossed else 8)) for k, c, s in spans], "k int, c int, s int, t int")
        measure = distance[crossed](F.col("b"), F.col("e"), F.col("s"), F.col("t"))
        want = joins.nearest(left, right, "k", measure, ["s", "c"], ["id"]).select("id", "c", "distance").collect()
        got = joins.nearest_span(left, right, "k", ("b", "e"), ("s", "t"), ["s", "c"], "id", crossed).select("id", "c", "distance").collect()
        assert sorted(got) == sorted(want) and len(got) > 70


def test_bm25_and_rrf(spark):
    docs = spark.createDataFrame([(0, "sustracción vehículo"), (1, "documento falsificado"), (2, None)], "d int, text string")
    got = retrieval.bm25_scores(spark.createDataFrame([(5, "vehículo")], "q int, text string"), docs, "q", "d", "text").collect()
    assert [r.d for r in got] == [0] and got[0].score > 0
    rank = lambda ids: spark.createDataFrame([(1, i, n + 1) for n, i in enumerate(ids)], "q int, i int, rank int")
    fused = retrieval.rank(retrieval.rrf(rank([0, 1]), rank([1, 0]), "q", "i", 1.0), "q", "i", "score").orderBy("rank").collect()
    assert [r.i for r in fused] == [0, 1]


def test_dense_ranking_matches_brute_force(spark):
    r = random.Random(4)
    rows = [(i, [float(r.randrange(-3, 4)) for _ in range(4)]) for i in range(60)] + [(60, None)]
    corpus = spark.createDataFrame(rows, "i long, v array<float>")
    queries = corpus.where("i % 20 = 0")
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    order = {q: sorted((i for i, v in rows if v and i != q), key=lambda i: (-dot(rows[q][1], rows[i][1]), i)) for q in (0, 20, 40)}
    top = retrieval.dense_top(queries, corpus, "i", "i", "v", 7).collect()
    assert {(x.query_id, x.rank): x.item_id for x in top} == {(q, k + 1): i for q, own in order.items() for k, i in enumerate(own[:7])}
    assert retrieval.dense_scores(queries, corpus, "i", "i", "v").count() == 3 * 59
    gold = spark.createDataFrame([(0, 5), (0, 33), (20, 59)], "query_id long, item_id long")
    got = {x.query_id: (x.first_rank, x.n_ranked) for x in retrieval.first_ranks(queries, corpus, gold, "i", "i", "v").collect()}
    assert got == {0: (min(order[0].index(5), order[0].index(33)) + 1, 59), 20: (order[20].index(59) + 1, 59), 40: (None, 59)}
    with pytest.raises(ValueError):
        retrieval.reranked(corpus, "other", "i", F.lit(1))


def test_dense_queries_stay_off_the_driver(spark, monkeypatch):
    """Neither vectors nor the best items of the queries are fetched, and a block that got no query is empty."""
    rows = [(i, [float(i % 7), 1.0], "ab"[i % 2]) for i in range(40)]
    corpus = spark.createDataFrame(rows, "i long, v array<float>, l string")
    queries = corpus.where("i % 20 = 0")
    monkeypatch.setattr(retrieval, "QUERY_BLOCK", 1)
    asked = retrieval._blocks(queries, "i", "v", "l")
    assert asked.n == 2 and sorted(i for n in range(6) for i in retrieval._block(asked.path, n).ids.tolist()) == [0, 20]

    def fetched(*_):
        raise AssertionError("rows come to the driver")

    with monkeypatch.context() as m:
        for name in ("collect", "toArrow", "toPandas", "toLocalIterator"):
            m.setattr(type(corpus), name, fetched)
        top, ranks = retrieval.dense_top(queries, corpus, "i", "i", "v", 2), retrieval.first_ranks(queries, corpus, None, "i", "i", "v", "l")
    assert {(x.query_id, x.rank): x.item_id for x in top.collect()} == {(0, 1): 1, (0, 2): 2, (20, 1): 6, (20, 2): 13}
    assert {x.query_id: (x.first_rank, x.n_ranked) for x in ranks.collect()} == {0: (2, 39), 20: (1, 39)}


def test_dense_by_label_matches_brute_force(spark, monkeypatch):
    """Ranks, nearest ids and losses from bounded pieces: several blocks, pieces and trims, ties, and rows without vectors or labels."""
    for name, n in (("QUERY_BLOCK", 4), ("QUERIES", 3), ("CORPUS_ROWS", 7)):
        monkeypatch.setattr(retrieval, name, n)
    r = random.Random(8)
    rows = [(i * 3 % 197, None if i == 9 else [float(r.randrange(-2, 3)) / 4 for _ in range(3)], r.choice(["a", "b", None])) for i in range(120)]
    corpus = spark.createDataFrame(rows, "i long, v array<float>, l string").repartition(3)
    queries = corpus.where("i % 10 = 0")
    by = {i: (v, lab) for i, v, lab in rows if v}
    asked = sorted(i for i in by if i % 10 == 0)
    dot = lambda a, b: sum(x * y for x, y in zip(by[a][0], by[b][0]))
    order = {q: sorted((i for i in by if i != q), key=lambda i: (-dot(q, i), i)) for q in asked}
    gold = {q: [i for i in order[q] if by[q][1] is not None and by[i][1] == by[q][1]] for q in asked}
    assert len(asked) > 8
    ranks = {x.query_id: (x.first_rank, x.n_ranked) for x in retrieval.first_ranks(queries, corpus, None, "i", "i", "v", "l").collect()}
    assert ranks == {q: (order[q].index(gold[q][0]) + 1 if gold[q] else None, len(order[q])) for q in asked}
    pairs = spark.createDataFrame([(q, i) for q in asked for i in gold[q]], "query_id long, item_id long")
    assert ranks == {x.query_id: (x.first_rank, x.n_ranked) for x in retrieval.first_ranks(queries, corpus, pairs, "i", "i", "v").collect()}
    for k in (1, 5, 200):
        top = retrieval.dense_top(queries, corpus, "i", "i", "v", k).collect()
        assert {(x.query_id, x.rank): x.item_id for x in top} == {(q, n + 1): i for q in asked for n, i in enumerate(order[q][:k])}
        near = retrieval.nearest_ids(queries, corpus, "i", "i", "v", k).collect()
        assert {(x.query_id, x.rank): x.item_id for x in near} == {(q, n + 1): i for q in asked for n, i in enumerate(sorted(order[q], key=lambda i: (abs(i - q), i))[:k])}
    loss = {x.query_id: (x.lse, x.pos) for x in retrieval.contrastive(queries, corpus, "i", "i", "v", "l", 20).collect()}
    for q in asked:
        assert loss[q][0] == pytest.approx(math.log(sum(math.exp(20 * dot(q, i)) for i in order[q])))
        assert loss[q][1] == (pytest.approx(sum(20 * dot(q, i) for i in gold[q]) / len(gold[q])) if gold[q] else None)


def test_bm25_top_matches_all_scores(spark, monkeypatch):
    r = random.Random(2)
    words = lambda n: " ".join(r.choice("abcdefghij") for _ in range(n))
    docs = spark.createDataFrame([(d, None if d == 7 else words(r.randrange(9))) for d in range(150)], "d long, text string").repartition(3)
    queries = spark.createDataFrame([(q, words(3)) for q in range(12)] + [(50, None), (51, "zz")], "q long, text string")
    want = {(x.q, x.d): (x["rank"], x.score) for x in retrieval.rank(retrieval.bm25_scores(queries, docs, "q", "d", "text"), "q", "d", "score", 6).collect()}
    for spread, terms in ((100, 20_000), (1_000_000, 20_000), (1, 3)):
        monkeypatch.setattr(retrieval, "SPREAD", spread)
        monkeypatch.setattr(retrieval, "FILTER_TERMS", terms)
        assert want == {(x.q, x.d): (x["rank"], x.score) for x in retrieval.bm25_top(queries, docs, "q", "d", "text", 6).collect()}
    assert len(want) == 72 and retrieval.bm25_top(queries.where("q = 50"), docs, "q", "d", "text", 6).count() == 0


def test_large_files_are_hashed_as_streams(spark, tmp_path, monkeypatch):
    """Files beyond what a task reads as one value, none of which is such a value."""
    import hashlib

    said = {"a b": b"x" * 100, "b": b"z", "c": bytes(range(256)) * 40}
    for name, data in said.items():
        (tmp_path / f"{name}.bin").write_bytes(data)
    (tmp_path / "d.txt").write_bytes(b"y")
    want = {(f"{n}.bin", len(d), hashlib.sha256(d).hexdigest()) for n, d in said.items()}
    for most in (10**6, 100, 99, -1):
        monkeypatch.setattr(files, "LARGE", most)
        got = files.file_hashes(spark, str(tmp_path), "*.bin").collect()
        assert {(pathlib.PurePosixPath(r.path).name, r.length, r.sha256) for r in got} == want and len(got) == 3


def test_metrics(spark):
    ranked = spark.createDataFrame([(1, i, i) for i in range(1, 6)], "q int, i int, rank int")
    ranks = spark.createDataFrame([(1, 2, 5)], "q int, first_rank int, n_ranked int")
    m = metrics.ir_metrics(metrics.per_query(ranked, spark.createDataFrame([(1, 2), (1, 9)], "q int, i int"), ranks, "q", "i")).first()
    assert (m.accuracy_1, m.mrr, m.recall_3) == (0.0, 0.5, 0.5)
    schema = "modelo string, queries int, candidates int, f1_macro double, accuracy_1 double, recall_3 double, f1_macro_group double"
    choice = lambda ref, cand: metrics.model_choice(spark.createDataFrame([("referencia", *ref), ("candidato", *cand)], schema)).first()
    assert tuple(choice((16, 444, 0.65, 0.8, 0.9, 0.6), (16, 444, 0.7, 0.7, 0.9, 0.6))) == ("referencia", "accuracy_1")
    assert tuple(choice((16, 444, 0.65, 0.8, 0.9, 0.6), (16, 444, 0.7, 0.8 - 1e-10, 0.9, 0.6))) == ("candidato", "")
    assert choice((16, 444, 0.65, 0.8, 0.9, 0.6), (16, 444, 0.65 + 1e-10, 0.8, 0.9, 0.6)).eleccion == "referencia"
    with pytest.raises(Exception, match="compared"):
        choice((16, 444, 0.65, 0.8, 0.9, 0.6), (15, 444, 0.7, 0.8, 0.9, 0.6))
    records = spark.createDataFrame([("a", "g"), ("b", "g"), ("c", "h")], "q string, g string")
    assert sorted(r.weight for r in metrics.group_weights(records, "q", "g").collect()) == [0.5, 0.5, 1.0]
    with pytest.raises(Exception, match="several groups"):
        metrics.group_weights(records.unionByName(spark.createDataFrame([("a", "h")], "q string, g string")), "q", "g").collect()


def test_retries():
    calls, pauses = [], []

    def fails(error, times):
        def call():
            calls.append(1)
            if len(calls) <= times:
                raise error
            return ["x"]

        calls.clear()
        pauses.clear()
        return call

    assert files.retried(fails(files.StatusError(503), 3), sleep=pauses.append) == ["x"] and pauses == [3, 6, 12]
    assert files.retried(fails(files.StatusError(429), 1), sleep=pauses.append) == ["x"]
    with pytest.raises(files.StatusError):
        files.retried(fails(files.StatusError(404), 1), sleep=pauses.append)
    assert pauses == []
    with pytest.raises(OSError):
        files.retried(fails(OSError(), 9), sleep=pauses.append)


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text('{"id": "1", "contenido": "<p>x</p>"}')
    (tmp_path / "in" / "b.json").write_text('{"id": ')
    good, bad = files.read_documents(spark, str(tmp_path / "in"))
    assert [r.id for r in good.collect()] == ["1"] and bad.count() == 1
    cat = spark.createDataFrame([("308bis", "Ley 1173", "x"), ("335", "cp ", "<b>estafa</b>")], "numero_articulo string, norma_sigla string, contenido string")
    assert [tuple(r) for r in files.catalogue(cat).collect()] == [("335", "estafa")]
    (tmp_path / "map.json").write_text('\ufeff{"0335": "<b>estafa</b>", "308bis": "x"}', encoding="utf-8")
    assert sorted(map(tuple, files.read_catalogue(spark, str(tmp_path / "map.json")).collect())) == [("308 bis", "x"), ("335", "estafa")]
    (tmp_path / "none.json").write_text('[{"numero_articulo": "1", "norma_sigla": "LEY", "contenido": "x"}]')
    with pytest.raises(ValueError):
        files.read_catalogue(spark, str(tmp_path / "none.json"))
    (tmp_path / "bom").mkdir()
    (tmp_path / "bom" / "a.json").write_text('\ufeff{"id": "7", "contenido": "y"}', encoding="utf-8")
    assert [r.id for r in files.read_documents(spark, str(tmp_path / "bom"))[0].collect()] == ["7"]
    (tmp_path / "lines.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert files.read_lines(spark, str(tmp_path / "lines.jsonl"), "a int").count() == 2
    spark.dataSource.register(files.PagedSource)
    assert spark.read.format("pairloom_pages").options(pages=3, limit=2).load().count() == 6
    sinks.write_lines(good, str(tmp_path / "out"))
    inputs = spark.read.format("binaryFile").load(str(tmp_path / "in"))
    said = sinks.manifest({"x": good}, inputs, str(ROOT / "pairloom"))
    assert said["x"]["rows"] == 1 and len(said["inputs"]) == 2 and "storage.py" in said["code"]
    wide = good.select("id", "contenido", F.array("id").alias("lista"))
    sinks.write_sheets({"uno": wide, "dos & más": wide.where("false")}, str(tmp_path / "b.xlsx"))
    assert [tuple(r) for r in files.read_sheet(spark, str(tmp_path / "b.xlsx"), "uno").collect()] == [("1", "<p>x</p>", '["1"]')]
    assert files.read_sheet(spark, str(tmp_path / "b.xlsx"), "dos & más").count() == 0
    sinks.write_cards(wide, str(tmp_path / "c.html"), "t")
    assert "&lt;p&gt;x" in (tmp_path / "c.html").read_text()
    sinks.write_catalogue(files.catalogue(cat), str(tmp_path / "cat"))
    assert files.read_catalogue(spark, str(tmp_path / "cat")).count() == 1
    sinks.copy_file(spark, str(tmp_path / "c.html"), str(tmp_path / "d.html"))
    assert (tmp_path / "d.html").exists()
    sinks.write_outputs(wide.select("id", F.lit("hechos").alias("salida")), "salida", str(tmp_path / "many"))
    assert (tmp_path / "many" / "salida=hechos").is_dir()
    sinks.write_documents(good.select("id", "contenido"), str(tmp_path / "docs"))
    with pytest.raises(Exception, match="without key or content"):
        sinks.write_documents(good.select("id", F.lit(" ").alias("contenido")), str(tmp_path / "docs2"))
    query = landing.land(landing.landed(spark, str(tmp_path / "out"), "id string, fetched_at timestamp"), str(tmp_path / "land"), str(tmp_path / "ck"))
    query.awaitTermination(60)
