"""Scalar text functions as native column expressions; ``exact_*`` are Arrow UDFs where full Unicode rules are needed."""

from __future__ import annotations

import html
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

# Suffixes of article numbers, in order.
SUFFIXES = ["bis", "ter", "quater", "quinquies", "sexies", "septies"]
# Phrases that count as factual or procedural.
FACTUAL_PHRASES = ["sustrajo", "sustrajeron", "se apodero", "golpeo", "agredio", "amenazo", "disparo", "portaba", "entrego dinero", "causo la muerte", "fallecio", "murio", "vendio", "falsifico", "se hizo entrega"]
PROCEDURAL_PHRASES = ["apelacion restringida", "precedente contradictorio", "admisibilidad", "admisible", "inadmisible", "tribunal de alzada", "tribunal de casacion", "defecto absoluto", "defectos absolutos", "nulidad", "reposicion del juicio", "fundamentacion de la sentencia"]
# Patterns of the roles a citation may play, in order (first and third generation).
ROLES = {"absolucion": r"absolvi\w*|absuelv\w*|absoluc\w*", "condena": r"conden\w*|declar\w*\s+(?:autor|culpable)", "acusacion": r"acus\w*|imput\w*", "precedente": r"precedente|auto\s+supremo\s+\d"}
ROLES_V7 = {"absolucion": r"absolvi\w*|absuelv\w*|absoluc\w*", "condena": r"conden\w*|declar\w*\s+(?:autor|culpable)", "alegado": r"acus\w*|imput\w*|denunci\w*", "rechazado": r"no\s+(?:es\s+)?aplica\w*|inaplicable", "fundamento_procesal": r"declar\w*\s+(?:infundado|inadmisible)|anul\w*|dejo\s+sin\s+efecto"}
PRECEDENT_V7 = r"precedente|auto supremo\s+\d|sentencia constitucional\s+\d"
# Headings that open a text and say nothing of its facts.
HEADINGS = ["CONSIDERANDO", "VISTOS", "ACTUACIONES PROCESALES VINCULADAS AL RECURSO", "ANTECEDENTES(?: PROCESALES)?", "RELACI[ÓO]N DE LOS HECHOS", "HECHOS PROBADOS"]


def _marks() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and what is left of each without its mark."""
    pairs = [(chr(p), unicodedata.normalize("NFKD", chr(p))) for p in range(0xDF, 0x250)]
    pairs = [(c, "".join(x for x in d if not unicodedata.combining(x))) for c, d in pairs if c.islower()]
    pairs = [(c, d) for c, d in pairs if len(d) == 1 and d != c and d.isascii()]
    return "".join(c for c, _ in pairs), "".join(d for _, d in pairs)


MARKED, UNMARKED = _marks()


def once(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def normalise(text: Column) -> Column:
    """White space of any kind collapsed and trimmed; null is empty."""
    return F.trim(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), r"(?U)\s+", " "))


@F.pandas_udf(T.StringType())
def exact_normalise(texts: pd.Series) -> pd.Series:
    """As ``normalise``, after compatibility composition (NFKC)."""
    return texts.map(lambda t: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", t or "")).strip())


def casefold(text: Column) -> Column:
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def fingerprint(text: Column) -> Column:
    return F.sha2(casefold(normalise(text)), 256)


def plain(text: Column) -> Column:
    """Case folded, without the marks of Latin letters."""
    return F.translate(casefold(F.coalesce(text.cast("string"), F.lit(""))), MARKED, UNMARKED)


def article_key(text: Column) -> Column:
    """``12``, ``12 bis``; null where the text is no article number."""
    t = F.regexp_replace(F.lower(normalise(text)), r"^(\d+)\.0$", "$1")
    pattern = rf"^0*(\d+)\s*({'|'.join(SUFFIXES)})?$"
    number, suffix = F.regexp_extract(t, pattern, 1), F.regexp_extract(t, pattern, 2)
    return F.when(number != "", F.when(suffix != "", F.concat(number, F.lit(" "), suffix)).otherwise(number))


def article_order(key: Column) -> Column:
    """A struct that sorts keys by number, then suffix; anything else comes last."""
    base = F.regexp_extract(key, r"^(\d+)", 1)
    suffix = F.regexp_extract(key, r"^\d+ (\w+)$", 1)
    place = F.coalesce(F.when(suffix == "", F.lit(0)), F.array_position(F.array(*map(F.lit, SUFFIXES)), suffix).cast("int"))
    return F.struct(F.coalesce(base.try_cast("int"), F.lit(999999)).alias("base"), F.when(base == "", F.lit(0)).otherwise(place).alias("suffix"))


def clean_html(markup: Column, entities: dict[str, str] | None = None) -> Column:
    """Lines of visible text: scripts and styles go with their bodies, block tags end lines, other tags are blanks.

    Named entities are those of ``entities``; ``exact_clean_html`` knows all.
    """
    entities = entities or {"&nbsp;": " ", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&copy;": "©", "&middot;": "·", "&#39;": "'", "&amp;": "&"}
    t = F.regexp_replace(F.coalesce(markup, F.lit("")), r"(?is)<(script|style)\b[^>]*>.*?</\1>", " ")
    t = F.regexp_replace(t, r"(?i)</?(?:p|div|br|li|h[1-6])\b[^>]*>", "\n")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    for name, char in entities.items():
        t = F.replace(t, F.lit(name), F.lit(char))
    lines = F.transform(F.split(t, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), lambda x: normalise(x))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


_SCRIPTS = re.compile(r"<(script|style)\b[^>]*>.*?</\1>", re.I | re.S)
_BLOCKS = re.compile(r"</?(?:p|div|br|li|h[1-6])\b[^>]*>", re.I)
_TAGS = re.compile(r"<[^>]+>")


@F.pandas_udf(T.StringType())
def exact_clean_html(markup: pd.Series) -> pd.Series:
    def one(t: str | None) -> str:
        bare = html.unescape(_TAGS.sub(" ", _BLOCKS.sub("\n", _SCRIPTS.sub(" ", t or ""))))
        lines = (re.sub(r"\s+", " ", unicodedata.normalize("NFKC", x)).strip() for x in bare.splitlines())
        return "\n".join(x for x in lines if x)

    return markup.map(one)


def phrase_count(text: Column, phrases: list[str]) -> Column:
    """How often whole phrases occur; ``text`` is plain."""
    count = F.lit(0)
    for p in phrases:
        count = count + F.regexp_count(text, F.lit(rf"(?<!\w){re.escape(p)}(?!\w)"))
    return count


def content_class(text: Column) -> Column:
    """A struct of kind, factual and procedural counts."""
    t = plain(text)
    f, p = phrase_count(t, FACTUAL_PHRASES), phrase_count(t, PROCEDURAL_PHRASES)
    kind = F.when((p >= 2) & (p > 2 * f), "procesal").when((f > 0) & (p == 0), "factico").when(f > 0, "mixto").otherwise("indeterminado")
    return F.struct(kind.alias("kind"), f.alias("factual"), p.alias("procedural"))


def _only(text: Column, rules: dict[str, str], none: str) -> Column:
    found = F.filter(F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p in rules.items())), lambda x: x.isNotNull())
    return F.when(F.size(found) == 1, F.get(found, 0)).when(F.size(found) > 1, "ambiguo").otherwise(none)


def citation_role(text: Column) -> Column:
    return _only(plain(text), ROLES, "no_identificado")


def citation_role_v7(text: Column) -> Column:
    t = plain(text)
    return F.when(t.rlike(PRECEDENT_V7), "precedente_o_documento_citado").otherwise(_only(t, ROLES_V7, "cita_sin_aplicacion_demostrada"))


def norm_id(text: Column) -> Column:
    t = F.regexp_replace(plain(text), r"[. ]", "")
    law = F.concat(F.lit("LEY:"), F.regexp_extract(t, r"(\d+)", 1).try_cast("int").cast("string"))
    return F.when(t.startswith("ley"), law).when(t.contains("procedimiento") | t.contains("procesal") | (t == "cpp"), "CPP").otherwise("CP")


def strip_heading(text: Column, least: int = 100) -> Column:
    """Without its opening heading, if so much is left."""
    rest = F.regexp_replace(text, rf"(?iu)^\s*(?:(?:[IVX]+|\d+)(?:\.\d+)*[.)]?\s*)?(?:{'|'.join(HEADINGS)})\s*[:.\-]?\s*", "")
    return F.when(F.length(rest) >= least, rest).otherwise(text)


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?U)(\w+)"), F.lit(1))


def shingle_hashes(text: Column, k: int = 5) -> Column:
    """64-bit hashes of the distinct runs of k plain words."""
    run = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - k + 1), lambda i: F.xxhash64(F.slice(w, i, k)))
    return once(word_list(plain(text)), lambda w: F.when(F.size(w) >= k, F.array_distinct(run(w))).otherwise(F.array().cast("array<long>")))


def shingles(text: Column, k: int = 5) -> Column:
    """The distinct runs of k plain words; none if there are fewer."""
    w = F.transform(F.array(word_list(plain(text))), lambda v: F.when(F.size(v) >= k, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(v) - k + 1), lambda i: F.array_join(F.slice(v, i, k), " ")))).otherwise(F.array().cast("array<string>")))
    return F.get(w, 0)


def substitute(text: Column, source: str, variant: str | Column) -> Column:
    """Whole-word replacement, whatever the case; ``variant`` is a literal text."""
    literal = F.lit(variant) if isinstance(variant, str) else variant
    literal = F.regexp_replace(literal, r"([\\$])", r"\\$1")
    return F.regexp_replace(text, F.lit(rf"(?iuU)(?<!\w){re.escape(source)}(?!\w)"), literal)


def escaped(text: Column) -> Column:
    """For markup."""
    out = F.coalesce(text.cast("string"), F.lit(""))
    for char, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(char), F.lit(name))
    return out


def prefixed(text: Column, kind: str) -> Column:
    """As encoders of the E5 family want their input; ``kind`` is ``query`` or ``passage``."""
    if kind not in ("query", "passage"):
        raise ValueError(kind)
    return F.concat(F.lit(f"{kind}: "), normalise(text))
