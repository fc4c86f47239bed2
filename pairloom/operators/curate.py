"""Routing, gates, blocks, queues, sampling, deduplication and reviews of candidate pairs."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom.functions.text import fingerprint, substitute


def first_reason(*cases: tuple[Column, str]) -> Column:
    """The reason of the first case that holds, null if none does."""
    out = F.lit(None).cast("string")
    for holds, reason in reversed(cases):
        out = F.when(holds, F.lit(reason)).otherwise(out)
    return out


def quality_reason(c: dict[str, Column]) -> Column:
    """The ten ordered rejections of the quality gate. Keys of ``c``: split, in_catalogue, excluded, base, role, length,
    actions, procedural, theory, distance, section."""
    distance = F.coalesce(c["distance"], F.lit(99999))
    return first_reason(
        (~c["split"].eqNullSafe("train"), "fuera_train"),
        (~c["in_catalogue"], "sin_catalogo_cp"),
        (c["excluded"] | (c["base"] < 100), "etiqueta_general_separada"),
        (c["role"].isin("absolucion", "precedente", "ambiguo"), "papel_no_elegible"),
        (~c["length"].between(180, 3600), "longitud"),
        (c["actions"] < 2, "pocas_acciones"),
        ((c["procedural"] > 2) | (c["procedural"] > c["actions"]), "contenido_procesal"),
        (c["theory"], "doctrina_o_negacion"),
        (distance > 400, "cita_lejana"),
        ((c["role"] == "no_identificado") & (~c["section"].eqNullSafe("hechos") | (c["actions"] < 3) | (c["procedural"] > 0)), "rol_sin_evidencia"),
    )


def quality_tier(c: dict[str, Column]) -> Column:
    return F.when((c["role"] == "condena") & (c["distance"] <= 250) & (c["procedural"] <= 1), "conservador").otherwise("ampliado")


def not_blocked(rows: DataFrame, blocked: DataFrame, keys: list[str]) -> DataFrame:
    """Rows none of whose ``keys`` has a value that ``blocked`` has in the same column."""
    return reduce(lambda d, k: d.join(blocked.where(F.col(k).isNotNull()).select(k).distinct(), k, "left_anti"), keys, rows).select(rows.columns)


def best(rows: DataFrame, keys: list[str], order: list[Column | str], n: int, place: str = "n") -> DataFrame:
    """The first ``n`` rows of each key; ``place`` counts from 1."""
    return rows.withColumn(place, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(place) <= n)


def dedupe_first(rows: DataFrame, keys: list[str], order: list[Column | str]) -> tuple[DataFrame, DataFrame]:
    """The first row of each key, and the rest."""
    ranked = rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.where("__n = 1").drop("__n"), ranked.where("__n > 1").drop("__n")


def dedupe_approved(rows: DataFrame, keys: list[str], approved: Column, seq: str) -> DataFrame:
    """The last approved row of each key, else the first; ``position`` is the least ``seq`` of the key."""
    w = Window.partitionBy(*keys)
    order = [F.when(approved, 0).otherwise(1), F.when(approved, -F.col(seq)).otherwise(F.col(seq))]
    ranked = rows.withColumns({"__n": F.row_number().over(w.orderBy(*order)), "position": F.min(seq).over(w)})
    return ranked.where("__n = 1").drop("__n")


def greedy_cap(rows: DataFrame, part: str, text: str, source: str, order: list[str], cap: int = 2) -> DataFrame:
    """In order, within each ``part``: keep a row if its ``text`` wasn't kept before and its ``source`` has fewer than
    ``cap`` rows. A row that the cap drops doesn't count as seen, so a later row of another source may be kept; that is
    sequential by definition. Parts are dealt out and sorted by Spark, and each task reads its rows once, in order, with
    no more in memory than what it kept of the current part.
    """
    at = [rows.columns.index(c) for c in (part, text, source)]

    def run(batches):
        current, seen, have = object(), set(), {}
        for batch in batches:
            keep = []
            for p, t, s in zip(*(batch.column(i).to_pylist() for i in at)):
                if p != current:
                    current, seen, have = p, set(), {}
                good = t not in seen and have.get(s, 0) < cap
                keep.append(good)
                if good:
                    seen.add(t)
                    have[s] = have.get(s, 0) + 1
            yield batch.filter(pa.array(keep, pa.bool_()))

    return rows.repartition(part).sortWithinPartitions(part, *order).mapInArrow(run, rows.schema)


def round_robin(rows: DataFrame, stratum: str, order: Column, strata_order: Column | str, n: int) -> DataFrame:
    """The first of each stratum, then the second of each, until ``n`` rows; ``turn`` counts from 1."""
    turn = F.row_number().over(Window.partitionBy(stratum).orderBy(order))
    return rows.withColumn("turn", turn).orderBy("turn", strata_order).limit(n)


def carry_forward(value: Column, part: str, *order: str) -> Column:
    """The last non-null value so far."""
    return F.last(value, ignorenulls=True).over(Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


#: Roles that a review may confirm.
CONFIRMED = ("condena", "aplicacion_confirmada")


def review_violations(reviews: DataFrame, candidate: str = "candidate_id", candidates: DataFrame | None = None, catalogue: DataFrame | None = None, facts: int | None = None, label: str = "articulo") -> DataFrame:
    """``candidate_id, reason`` of reviews that must not be applied; the first reason that holds.

    With ``candidates(candidate_id, split)`` a review of none of them, or of one outside train, is one; with ``catalogue``
    approved labels that are none, repeated or not in it; with ``facts`` approved texts (``hechos_aprobados``) of fewer
    characters, and roles (``papel_confirmado``) other than ``CONFIRMED``.
    """
    approves = F.col("decision") == "aprobar"
    cases = [
        (F.count("*").over(Window.partitionBy(candidate)) > 1, "duplicada"),
        (~F.coalesce(F.col("decision").isin("aprobar", "rechazar"), F.lit(False)), "decision"),
        ((F.trim(F.coalesce("revisor", F.lit(""))) == "") | (F.trim(F.coalesce("justificacion", F.lit(""))) == ""), "sin_firma"),
    ]
    if candidates is not None:
        reviews = reviews.join(candidates.select(candidate, F.col("split").alias("__split")), candidate, "left")
        cases += [(F.col("__split").isNull(), "candidato_desconocido"), (F.col("__split") != "train", "fuera_train")]
    if facts is not None:
        cases += [(approves & ~F.coalesce(F.col("papel_confirmado").isin(*CONFIRMED), F.lit(False)), "papel"), (approves & (F.length(F.coalesce("hechos_aprobados", F.lit(""))) < facts), "hechos_cortos")]
    if catalogue is not None:
        own = reviews.select(candidate, F.explode("articulos_aprobados").alias(label)).join(catalogue.select(label).distinct(), label, "left_anti")
        reviews = reviews.join(own.select(candidate).distinct().withColumn("__unknown", F.lit(True)), candidate, "left")
        labels = F.coalesce("articulos_aprobados", F.array().cast("array<string>"))
        cases += [(approves & (F.size(labels) == 0), "sin_articulos"), (approves & (F.size(F.array_distinct(labels)) < F.size(labels)), "articulos_repetidos"), (approves & F.col("__unknown").isNotNull(), "articulo_sin_catalogo")]
    return reviews.withColumn("reason", first_reason(*cases)).where("reason is not null").select(candidate, "reason")


def apply_reviews(candidates: DataFrame, reviews: DataFrame, candidate: str = "candidate_id", label: str = "articulo") -> DataFrame:
    """Reviewed candidates go; approved ones come back, one row for each approved label, as ``aprobado``.

    A review of a candidate that isn't there is an error.
    """
    known = reviews.join(candidates.select(candidate).distinct().withColumn("__known", F.lit(True)), candidate, "left")
    strict = F.when(F.col("__known").isNull(), F.raise_error(F.concat(F.lit("unknown candidate: "), F.col(candidate).cast("string"))).cast("string")).otherwise(F.col("decision"))
    checked = known.withColumn("decision", strict).where("decision is not null").select(reviews.columns)
    kept = candidates.join(checked.groupBy(candidate).agg(F.max("decision").alias("__decision")), candidate, "left").where("__decision is null")
    good = checked.where("decision = 'aprobar'").select(candidate, F.explode(F.array_distinct("articulos_aprobados")).alias("__label"))
    back = candidates.join(good, candidate).withColumns({label: F.col("__label"), "estado_revision": F.lit("aprobado")}).select(candidates.columns)
    return kept.select(candidates.columns).unionByName(back)


def augmented(rows: DataFrame, rules: dict[str, list[str]], text: str = "hechos", label: str = "articulo", seed: int = 42) -> DataFrame:
    """``rows`` and their paraphrases, with ``tipo`` (``original`` or ``parafraseado``), ``parent_id`` and ``regla_aumento``.

    A row of train that is approved gets one paraphrase: of the first rule, in order, that gives a text its label doesn't
    have. The variant is chosen by a hash of row and seed, so that a run can be repeated. Where several rows come to one
    paraphrase the one with the least text has it.
    """
    key = lambda t: fingerprint(t)
    own = rows.withColumns({"tipo": F.lit("original"), "parent_id": fingerprint(F.concat(F.col(text), F.lit("|"), F.col(label).cast("string"))), "regla_aumento": F.lit(None).cast("string")})
    have = own.select(F.col(label), key(F.col(text)).alias("__key")).distinct()
    pick = lambda variants: F.get(F.array(*map(F.lit, variants)), F.pmod(F.xxhash64(text, F.lit(seed)), F.lit(len(variants))).cast("int"))
    tried = [F.struct(F.lit(i).alias("place"), F.lit(source).alias("rule"), substitute(F.col(text), source, pick(variants)).alias("new")) for i, (source, variants) in enumerate(rules.items()) if variants]
    if not tried:
        return own
    train = own.where("split = 'train' and estado_revision = 'aprobado'").withColumn("__row", F.monotonically_increasing_id())
    long = train.withColumn("__x", F.explode(F.array(*tried))).withColumn("__key", key(F.col("__x.new"))).join(have, [label, "__key"], "left_anti")
    first = best(long, ["__row"], ["__x.place"], 1, "__n")
    first = best(first, [label, "__key"], [text], 1, "__n")
    new = first.withColumns({"regla_aumento": F.col("__x.rule"), "tipo": F.lit("parafraseado"), text: F.col("__x.new")}).select(own.columns)
    return own.unionByName(new)


def changed_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that one bag has more often than the other; none if nothing changed."""
    return before.exceptAll(after).unionByName(after.exceptAll(before))
