"""Benchmark decontamination by template canonicalisation, in native expressions.

Marks that are not inside a word go. A template puts typed placeholders for numbers, units after numbers, and names
(capitalised words, also those that begin a sentence); other words are in lower case. Windows of ``WINDOW`` words are
joined by hash, in three forms of the item: the template, the template with the words that begin its sentences as
literals (a text may go on in lower case), and the words themselves. So an item is found with other numbers or names, in
other case, and word for word whatever it holds. A text's windows have the template and the words.

Along a diagonal (the same distance between places in text and item) each slot value of the item must have one value in
the text; two of its values may become the same. Template windows that hold a value with several values in the text
don't count. A text contains an item if consistent windows make up ``percent`` of the item's.

Templates of fewer than ``LITERAL`` words besides placeholders fit any list of numbers or names, so such windows are
compared by their words alone. Items of fewer than ``WINDOW`` words are looked for word by word in texts of any length;
a text of so few words is one window. Null and empty texts have no windows. Repeated rows of one id are one document,
repeated items count once each under their own id.

Texts that hold none of the items' anchor words (see ``anchors``) are left out before they are cut into windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom.llm.quality import let, words
from pairloom.storage import materialise

WINDOW, LITERAL, PERCENT = 5, 2, 80
#: Benchmark windows that are broadcast at most, of a hundred bytes or so each; beyond, the join is by shuffle.
BROADCAST_WINDOWS = 1_000_000
#: Anchor words by which texts are filtered before they are cut into windows; with more, all texts are cut.
FILTER_WORDS = 20_000

NUMBER, NAME, UNIT = "<number>", "<name>", "<unit>"
MARK = f"{NUMBER}|{NAME}|{UNIT}"
UNITS = (
    "km|m|cm|mm|mi|miles?|kg|g|mg|lbs?|oz|l|ml|s|sec|seconds?|min|minutes?|h|hours?|days?|weeks?|months?|years?|kb|mb|gb|tb|hz|khz|mhz|ghz|w|kw|v|percent|dollars?|euros?|cents?|pounds?"
    "|met(?:er|re)s?|kilomet(?:er|re)s?|centimet(?:er|re)s?|inch(?:es)?|foot|feet|ft|yards?|acres?|hectares?|grams?|kilograms?|kilos?|tons?|tonnes?|ounces?|lit(?:er|re)s?|gallons?|pints?|degrees?|mph|kph|watts?|volts?|coins?|francs?|pesos?|rupees?|yen|yuan"
)
#: Stands before a capital that begins a sentence, while an item is made a template.
_BEGIN = "\ue000"
_PIECE = r"[\p{L}\p{N}]+"


def bare(text: Column) -> Column:
    """Without marks that aren't between letters or digits."""
    return F.regexp_replace(text, rf"(?<![\p{{L}}\p{{N}}])[^\p{{L}}\p{{N}}\s{_BEGIN}]+|[^\p{{L}}\p{{N}}\s{_BEGIN}]+(?![\p{{L}}\p{{N}}{_BEGIN}])", " ")


def begun(text: Column) -> Column:
    """With ``_BEGIN`` before capitals that follow no lower-case letter, digit, comma or semicolon and one blank."""
    return F.regexp_replace(F.translate(text, _BEGIN, " "), r"(?<![\p{L}\p{N}'-])(?<![\p{Ll}\p{N},;]\s)(?=\p{Lu})", _BEGIN)


def template(text: Column) -> Column:
    """As many words as the bare ``text`` has, some replaced by placeholders; capitals after ``_BEGIN`` are literals."""
    named = F.regexp_replace(text, rf"(?<![\p{{L}}\p{{N}}'{_BEGIN}-])\p{{Lu}}[\p{{L}}'-]*", NAME)
    counted = F.regexp_replace(named, r"[0-9]+(?:[.,:/][0-9]+)*", NUMBER)
    return F.lower(let(counted, lambda t: F.when(F.contains(t, F.lit(NUMBER)), F.regexp_replace(t, rf"(?i)(?<={NUMBER}\s)(?:{UNITS})(?![\p{{L}}<])", UNIT)).otherwise(t)))


def _later(x: Column, by: int) -> Column:
    return F.slice(x, by + 1, F.greatest(F.size(x) - by, F.lit(0)))


def _joined(x: Column, y: Column, by: int) -> Column:
    return let(_later(y, by), lambda later: F.zip_with(F.slice(x, 1, F.size(later)), later, lambda a, b: F.xxhash64(a, b)))


def window_hashes(word_array: Column) -> Column:
    """Hashes of ``WINDOW`` words; of all words if they are fewer."""

    def five(h: Column) -> Column:
        two = _joined(h, h, 1)
        return let(two, lambda p: _joined(_joined(p, p, 2), h, 4))

    some = F.transform(word_array, lambda w: F.xxhash64(w))
    return F.when(F.size(word_array) >= WINDOW, let(some, five)).when(F.size(word_array) > 0, F.array(F.xxhash64(word_array))).otherwise(F.array().cast("array<long>"))


def _slots(t: str, w: str, hashes: str) -> Column:
    """For each window the hashes of the words behind its placeholders, in order."""
    held = F.zip_with(t, w, lambda x, y: F.when(x.rlike(MARK), F.xxhash64(y)))
    return let(held, lambda h: F.transform(hashes, lambda _, i: F.filter(F.slice(h, i + 1, WINDOW), lambda x: x.isNotNull())))


def _cells(hashes: Column | str, slots: Column | str) -> Column:
    return F.transform(F.arrays_zip(F.col(hashes).alias("h"), F.col(slots).alias("s")), lambda x, i: F.struct(i.alias("at"), x["h"].alias("hash"), x["s"].alias("slots")))


def windows(rows: DataFrame, key: str) -> DataFrame:
    """``key, at, hash, slots`` of a text's windows: each as a template, and those with slots also by their words.

    They are made before the explosion, so no row carries its whole text along.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = rows.select(F.col(key), bare(text).alias("text")).select(key, words(F.lower("text")).alias("w"), template(F.col("text")).alias("t"))
    out = out.select(key, "w", words(F.col("t")).alias("tw"), F.col("t").rlike(MARK).alias("slotted"))
    out = out.select(key, "w", "tw", "slotted", window_hashes(F.col("tw")).alias("h"), F.when(F.col("slotted"), window_hashes(F.col("w"))).alias("b"))
    none = F.array().cast("array<long>")
    out = out.select(key, "h", "b", F.when(F.col("slotted"), _slots("tw", "w", "h")).otherwise(F.transform("h", lambda _: none)).alias("s"))
    plain = F.when(F.col("b").isNotNull(), F.filter(F.transform(F.arrays_zip("b", "s"), lambda x, i: F.struct(i.alias("at"), F.when(F.size(x["s"]) > 0, x["b"]).alias("hash"), none.alias("slots"))), lambda x: x["hash"].isNotNull()))
    both = F.concat(_cells("h", "s"), F.coalesce(plain, F.array().cast("array<struct<at:int,hash:bigint,slots:array<bigint>>>")))
    return out.select(key, F.explode(both).alias("c")).select(key, "c.at", "c.hash", "c.slots")


def item_windows(items: DataFrame) -> DataFrame:
    """``item_id, item_at, hash, item_slots, word`` of each form of each window; ``word`` is its longest literal piece."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    out = items.select("item_id", bare(text).alias("text"), bare(begun(text)).alias("marked"))
    parts = lambda c: words(F.replace(template(F.col(c)), F.lit(_BEGIN), F.lit("")))
    out = out.select("item_id", words(F.lower("text")).alias("w"), parts("text").alias("t1"), parts("marked").alias("t2"))
    out = out.withColumns({"h1": window_hashes(F.col("t1")), "h2": window_hashes(F.col("t2")), "h3": window_hashes(F.col("w"))})
    none = F.array().cast("array<long>")
    out = out.withColumns({"s1": _slots("t1", "w", "h1"), "s2": _slots("t2", "w", "h2"), "s3": F.transform("h3", lambda _: none)})
    pieces = lambda x: F.flatten(F.transform(x, lambda w: F.regexp_extract_all(w, F.lit(rf"({_PIECE})"), F.lit(1))))
    longest = lambda x: F.array_max(F.transform(x, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))
    literal = lambda i: F.filter(F.slice("t1", i + 1, WINDOW), lambda x: ~x.rlike(MARK))
    out = out.withColumn("word", F.transform("h3", lambda _, i: F.coalesce(longest(pieces(literal(i))), longest(pieces(F.slice("w", i + 1, WINDOW))))))
    form = lambda n: F.transform(F.arrays_zip(F.col(f"h{n}").alias("h"), F.col(f"s{n}").alias("s"), F.col("word").alias("word")), lambda x, i: F.struct(i.alias("item_at"), x["h"].alias("hash"), x["s"].alias("item_slots"), x["word"].alias("word"), F.lit(n).alias("form")))
    out = out.select("item_id", F.least(F.size("w"), F.lit(WINDOW)).alias("n"), F.explode(F.concat(form(1), form(2), form(3))).alias("c")).select("item_id", "n", "c.*")
    return out.where((F.col("form") == 3) | (F.col("n") - F.size("item_slots") >= LITERAL)).dropDuplicates(["item_id", "item_at", "hash"]).drop("n", "form")


def anchors(item: DataFrame, size: DataFrame, percent: int) -> DataFrame:
    """``hash`` of pieces of words of which a text has at least one if it contains an item.

    Of any set of more windows than may be missing, at least one is present. The set is that of the windows with the
    longest words, which are rare, and of each window its longest word that is no placeholder, or its longest word if
    all are; every form of the window has that word.
    """
    best = Window.partitionBy("item_id").orderBy(F.desc("word.n"), "word.w", "item_at")
    ranked = item.select("item_id", "item_at", "word").distinct().join(size, "item_id").withColumn("rank", F.dense_rank().over(best))
    may_miss = F.col("item_windows") - F.ceil(F.col("item_windows") * percent / 100)
    return ranked.where(F.col("rank") <= may_miss + 1).select(F.xxhash64("word.w").alias("hash")).distinct()


def holding(docs: DataFrame, hashes: DataFrame) -> DataFrame:
    """The ``docs`` that have one of the pieces of words; all of them if there are more than ``FILTER_WORDS``."""
    keys = [r.hash for r in hashes.limit(FILTER_WORDS + 1).collect()]
    if len(keys) > FILTER_WORDS:
        return docs
    pieces = F.split(F.lower("text"), r"[^\p{L}\p{N}]+")
    return docs.where(F.exists(pieces, lambda w: F.xxhash64(w).isin(keys))) if keys else docs.where("false")


def verbatim(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``doc_id, item_id`` where a text holds all words of an item in a row, in any case.

    Texts are cut into windows of each of the items' lengths, so ``items`` should be few and short.
    """
    cut_up = lambda rows, key: rows.select(key, words(F.lower(bare(F.coalesce(F.col("text").cast("string"), F.lit(""))))).alias("w"))
    item = cut_up(items, "item_id").where(F.size("w") > 0).select("item_id", F.size("w").alias("n"), F.xxhash64("w").alias("hash"))
    lengths = [r.n for r in item.select("n").distinct().collect()]
    if not lengths:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long")

    def cut(n: int) -> Column:
        starts = F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - (n - 1))).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(starts, lambda i: F.struct(F.lit(n).alias("n"), F.xxhash64(F.slice("w", i, n)).alias("hash"))))

    rows = cut_up(docs, "doc_id").select("doc_id", F.explode(F.concat(*map(cut, sorted(lengths)))).alias("c")).select("doc_id", "c.n", "c.hash")
    return rows.join(F.broadcast(item), ["n", "hash"]).select("doc_id", "item_id").distinct()


def contamination(docs: DataFrame, benchmark: DataFrame, percent: int = PERCENT) -> DataFrame:
    """``doc_id, item_id, n_windows, item_windows, same_values`` of each item that a text contains.

    ``same_values`` tells a verbatim copy from one with other slot values.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null")
    item = materialise(item_windows(items), "items")
    size = item.groupBy("item_id").agg(F.countDistinct("item_at").alias("item_windows"))
    # Words of a short item are one window, which a longer text doesn't have.
    few = items.where(F.size(words(bare(F.coalesce(F.col("text").cast("string"), F.lit(""))))).between(1, WINDOW - 1))
    few = materialise(few.dropDuplicates(["item_id"]), "few")
    whole = verbatim(holding(docs, anchors(item.join(few.select("item_id"), "item_id", "left_semi"), size, 100)), few)
    small = item.limit(BROADCAST_WINDOWS + 1).count() <= BROADCAST_WINDOWS
    found = windows(holding(docs, anchors(item, size, percent)), "doc_id").join(F.broadcast(item.drop("word")) if small else item.drop("word"), "hash")
    pairs = F.arrays_zip(F.col("item_slots").alias("i"), F.col("slots").alias("d"))
    windowed = F.collect_set(F.struct("item_at", pairs.alias("pairs"))).alias("windows")
    lines = found.groupBy("doc_id", "item_id", (F.col("at") - F.col("item_at")).alias("diagonal")).agg(windowed)
    lines = lines.withColumn("pairs", F.array_distinct(F.flatten("windows.pairs")))
    # Item values that the text gives two values; only windows that hold one are left out.
    lines = lines.withColumn("clash", F.filter("pairs", lambda p: F.exists("pairs", lambda o: (o["i"] == p["i"]) & (o["d"] != p["d"])))["i"])
    kept = F.filter("windows", lambda w: ~F.exists(w["pairs"], lambda p: F.array_contains("clash", p["i"])))["item_at"]
    lines = lines.select("doc_id", "item_id", kept.alias("places"), F.forall("pairs", lambda p: p["i"] == p["d"]).alias("same")).where(F.size("places") > 0)
    per = lines.groupBy("doc_id", "item_id").agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n_windows"), F.bool_and("same").alias("same_values"))
    out = per.join(F.broadcast(size) if small else size, "item_id").where(F.col("n_windows") * 100 >= percent * F.col("item_windows"))
    own = F.lit(1).cast("long")
    whole = whole.select("doc_id", "item_id", own.alias("n_windows"), own.alias("item_windows"), F.lit(True).alias("same_values"))
    out = out.select(whole.columns).union(whole)
    return out.groupBy("doc_id", "item_id").agg(F.max("n_windows").alias("n_windows"), F.max("item_windows").alias("item_windows"), F.bool_or("same_values").alias("same_values"))
