"""Metrics of rankings and of labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def per_query(top: DataFrame, gold: DataFrame, ranks: DataFrame, query: str, item: str, cuts: tuple[int, ...] = (1, 3, 5), size: DataFrame | None = None) -> DataFrame:
    """Hits of each query: ``first_rank``, ``hits_k`` for each cut, ``dcg10`` and ``idcg10``, ``n_gold``, ``n_ranked``.

    ``top`` holds the best 10 of a ranking; ``ranks(query, first_rank, n_ranked)`` what needs all of it. Where ``size(query,
    n_gold)`` is given, ``gold`` need hold no more than what is in ``top``.
    """
    size = size if size is not None else gold.groupBy(query).agg(F.count("*").alias("n_gold"))
    marked = top.join(gold.select(query, item, F.lit(1).alias("hit")), [query, item], "left")
    aggs = [F.count_if((F.col("rank") <= k) & (F.col("hit") == 1)).alias(f"hits_{k}") for k in cuts]
    gain = F.when((F.col("hit") == 1) & (F.col("rank") <= 10), 1 / F.log2(F.col("rank") + 1))
    out = marked.groupBy(query).agg(F.coalesce(F.sum(gain), F.lit(0.0)).alias("dcg10"), *aggs)
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(10), F.col("n_gold")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    return out.join(size, query).join(ranks, query).withColumn("idcg10", ideal)


def ir_metrics(q: DataFrame, cuts: tuple[int, ...] = (1, 3, 5)) -> DataFrame:
    """One row from ``per_query``: accuracy at 1, MRR, NDCG at 10, recall and precision at each cut."""
    aggs = [F.avg((F.col("hits_1") > 0).cast("double")).alias("accuracy_1"), F.avg(F.coalesce(1 / F.col("first_rank"), F.lit(0.0))).alias("mrr"), F.avg(F.col("dcg10") / F.col("idcg10")).alias("ndcg_10")]
    for k in cuts:
        aggs += [F.avg(F.col(f"hits_{k}") / F.col("n_gold")).alias(f"recall_{k}"), F.avg(F.col(f"hits_{k}") / F.least(F.lit(k), F.col("n_ranked"))).alias(f"precision_{k}")]
    out = q.agg(F.count("*").alias("queries"), *aggs)
    return out.select("queries", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


def label_counts(pairs: DataFrame, true: str, predicted: str, weight: str | None = None) -> DataFrame:
    """``label, tp, fp, fn`` of one true and one predicted label a row."""
    w = F.col(weight) if weight else F.lit(1.0)
    hit = F.col(true) == F.col(predicted)
    long = pairs.select(F.col(true).alias("label"), F.when(hit, w).otherwise(0.0).alias("tp"), F.lit(0.0).alias("fp"), F.when(hit, 0.0).otherwise(w).alias("fn")).unionByName(
        pairs.where(~hit).select(F.col(predicted).alias("label"), F.lit(0.0).alias("tp"), w.cast("double").alias("fp"), F.lit(0.0).alias("fn"))
    )
    return long.groupBy("label").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))


def _ratio(a, b):
    return F.when(b > 0, a / b).otherwise(0.0)


def f1_table(counts: DataFrame) -> DataFrame:
    """``label, precision, recall, f1, support``; 0 where nothing can be divided."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return counts.select("label", _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), (tp + fn).alias("support"))


def set_counts(records: DataFrame, truth: str, predicted: str, weight: str | None = None) -> DataFrame:
    """``label, tp, fp, fn`` where each row has an array of true labels and one predicted label."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    hit = F.array_contains(truth, F.col(predicted))
    cell = lambda label, tp, fp, fn: F.struct(label.alias("label"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"))
    none = F.lit(0.0)
    true = F.transform(F.array_distinct(truth), lambda x: cell(x, F.when(x == F.col(predicted), w).otherwise(0.0), none, F.when(x == F.col(predicted), 0.0).otherwise(w)))
    wrong = F.when(hit, F.array().cast("array<struct<label:string,tp:double,fp:double,fn:double>>")).otherwise(F.array(cell(F.col(predicted), none, w, none)))
    rows = records.select(F.explode(F.concat(true, wrong)).alias("x")).select("x.*")
    return rows.groupBy("label").agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn")))


def f1_summary(counts: DataFrame) -> DataFrame:
    """One row: F1, precision and recall, each macro, micro and weighted by true support."""
    total = {c: F.sum(c) for c in ("tp", "fp", "fn")}
    micro = [_ratio(2 * total["tp"], 2 * total["tp"] + total["fp"] + total["fn"]), _ratio(total["tp"], total["tp"] + total["fp"]), _ratio(total["tp"], total["tp"] + total["fn"])]
    names = ("f1", "precision", "recall")
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    each = counts.select("tp", "fp", "fn", (tp + fn).alias("support"), _ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"))
    aggs = [F.round(F.avg(n), 6).alias(f"{n}_macro") for n in names] + [F.round(m, 6).alias(f"{n}_micro") for n, m in zip(names, micro)]
    aggs += [F.round(_ratio(F.sum(F.col(n) * F.col("support")), F.sum("support")), 6).alias(f"{n}_weighted") for n in names]
    return each.agg(*aggs)


def group_weights(records: DataFrame, query: str, group: str) -> DataFrame:
    """``records`` with ``weight``, one over the queries of its group; an error names a query of several groups."""
    mine = Window.partitionBy(query)
    several = F.size(F.collect_set(group).over(mine)) > 1
    checked = F.when(several, F.raise_error(F.concat(F.lit("several groups: "), F.col(query).cast("string"))).cast("string")).otherwise(F.col(group).cast("string"))
    rows = records.withColumn("__group", checked)
    return rows.withColumn("weight", 1 / F.count("*").over(Window.partitionBy("__group"))).drop("__group")


#: Figures that must not fall, by at most so much.
CONTROLS, TOLERANCE = ("accuracy_1", "recall_3", "f1_macro_group"), 1e-9


def model_choice(figures: DataFrame) -> DataFrame:
    """``eleccion, motivos``, from ``figures(modelo, queries, candidates, f1_macro, ...)`` of ``referencia`` and ``candidato``.

    The candidate is chosen only if its F1 macro is higher and none of ``CONTROLS`` falls. Figures from other numbers of
    queries or candidates are an error.
    """
    names = ("queries", "candidates", "f1_macro", *CONTROLS)
    of = lambda model: [F.max(F.when(F.col("modelo") == model, F.col(n))).alias(f"{model}_{n}") for n in names]
    row = figures.agg(*of("referencia"), *of("candidato"))
    ref, cand = ({n: F.col(f"{m}_{n}") for n in names} for m in ("referencia", "candidato"))
    same = ref["queries"].eqNullSafe(cand["queries"]) & ref["candidates"].eqNullSafe(cand["candidates"])
    reasons = F.array(F.when(cand["f1_macro"] <= ref["f1_macro"] + TOLERANCE, F.lit("f1_macro")), *(F.when(cand[n] + TOLERANCE < ref[n], F.lit(n)) for n in CONTROLS))
    found = row.select(F.when(same, F.array_compact(reasons)).otherwise(F.raise_error(F.lit("figures that can't be compared")).cast("array<string>")).alias("r"))
    return found.select(F.when(F.size("r") > 0, "referencia").otherwise("candidato").alias("eleccion"), F.array_join("r", ",").alias("motivos"))
