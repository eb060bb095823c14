"""Personal data in texts, and the terms that give it away.

Fixed patterns find e-mail and IP addresses, card and phone numbers. How strongly a term reveals such a value is
estimated from the corpus: the pointwise mutual information of term and value, over documents, as a share of the
value's own information. Terms of a text with a value that tell more than a threshold of it are generalised wherever
they stand in that text, those that tell nearly all are removed. Everything is column arithmetic and grouping.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from areal_exposure.llm.common import whole_text
from areal_exposure.sources.scratch import written

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "term")
#: Stands for an inner separator of a match; the texts' own are put out of the way, as no pattern has them.
_SEP, _OWN = "\u0001", "\u0002"
_LOCAL = f"A-Za-z0-9._%+{_SEP}-"
#: Runs are matched from their first character only (or from the last match's end), so that no run is tried twice.
_PATTERNS = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]+@[A-Za-z0-9-]+{_SEP}[A-Za-z0-9{_SEP}-]+",
    "ip": r"(?:(?<![0-9])|\G)[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": rf"[0-9][0-9{_SEP}]{{12,}}",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_SENT_ROWS = 200_000
_SPAN = "array<struct<start:int,end:int,value:string>>"


def _marked(text: Column, kind: str) -> Column:
    """``text``, as long as it was, with the separators inside e-mail hosts or card numbers as ``_SEP``."""
    text = F.translate(text, _SEP, _OWN)
    if kind == "email":
        return F.regexp_replace(text, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _SEP)
    return F.regexp_replace(text, r"(?<=[0-9])[\x20-](?=[0-9])", _SEP) if kind == "card" else text


def located(text: Column, pattern: str, wanted: Callable[[Column], Column] | None = None) -> Column:
    """Matches of ``pattern`` in ``text`` (those ``wanted`` only) with start and end in code points.

    They are found by the matches and the pieces between.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.transform(F.split(text, pattern, -1), lambda p: F.char_length(p))
    none = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("found"))

    def add(held: Column, pair: Column) -> Column:
        start = held["at"] + pair["piece"]
        end = start + F.coalesce(F.char_length(pair["value"]), F.lit(0))
        new = F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value"))
        more = F.concat(held["found"], F.array(new))
        if wanted is not None:
            more = F.when(wanted(pair["value"]), more).otherwise(held["found"])
        return F.struct(end.alias("at"), more.alias("found"))

    pairs = F.arrays_zip(pieces.alias("piece"), values.alias("value"))
    found = F.aggregate(pairs, none, add, lambda held: held["found"])
    return F.filter(found, lambda s: s["value"].isNotNull())


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit is right."""
    places = F.sequence(F.lit(1), F.length(digits))

    def add(total: Column, k: Column) -> Column:
        digit = F.ascii(F.substring(F.reverse(digits), k, F.lit(1))) - 48
        twice = digit * 2
        return total + F.when(k % 2 == 1, digit).otherwise(twice - F.when(twice > 9, 9).otherwise(0))

    return F.aggregate(places, F.lit(0), add) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    """Whether a match counts."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":  # leading zeros aside, at most 255
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))
    n = F.length(_digits(value))
    return n.between(9, 15) if kind == "phone" else n.between(13, 19) & luhn(_digits(value))


def _may_have(kind: str) -> Column:
    """A cheap test that every text with a match passes."""
    digit = F.col("text").rlike("[0-9]")
    if kind == "card":
        return digit
    sign = F.instr("text", {"email": "@", "ip": ".", "phone": "+"}[kind]) > 0
    return sign if kind == "email" else sign & digit


def base_spans(docs: DataFrame) -> DataFrame:
    """``docs`` (with ``text``) with ``spans``: kind, start, end, value, by kind as listed and start."""
    for kind in BASE:
        docs = docs.withColumn(f"_{kind}", F.when(_may_have(kind), _of(kind)).otherwise(F.array().cast(_SPAN)))
    named = [F.transform(f"_{k}", _named(k)) for k in BASE]
    return docs.withColumn("spans", F.concat(*named)).drop(*(f"_{k}" for k in BASE))


def _of(kind: str) -> Column:
    return F.filter(located(_marked(F.col("text"), kind), _PATTERNS[kind]), lambda s: _holds(kind, s["value"]))


def _named(kind: str):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"))


def with_values(found: DataFrame) -> DataFrame:
    """unit, n_docs, text, spans: each different text of ``found`` (doc_id, unit, text, spans) that has values, once."""
    held = found.where(F.size("spans") > 0).groupBy("unit")
    one = held.agg(F.count_distinct(F.xxhash64("doc_id")).alias("n_docs"), F.first(F.struct("text", "spans")).alias("one"))
    return one.select("unit", "n_docs", "one.text", "one.spans")


def entities(units: DataFrame, support: int) -> DataFrame:
    """unit, n_docs, entity, n_entity: the values of each text that are met in ``support`` texts or more."""
    hashes = F.transform("spans", lambda s: F.xxhash64(s["kind"], F.lower(s["value"])))
    own = units.select("unit", "n_docs", F.explode(F.array_distinct(hashes)).alias("entity"))
    known = own.groupBy("entity").agg(F.sum("n_docs").alias("n_entity"), F.count("*").alias("n")).where(F.col("n") >= support)
    return own.join(known.drop("n"), "entity")


def words_outside(units: DataFrame) -> DataFrame:
    """unit, term: each distinct word of three letters or more of a text, but for those that values overlap."""
    text = F.translate("text", _SEP, _OWN)
    order = F.sort_array(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def add(held: Column, s: Column) -> Column:
        kept = F.substring(text, held["at"] + 1, F.greatest(F.lit(0), s["start"] - held["at"]))
        return F.struct(F.greatest(held["at"], s["end"]).alias("at"), F.concat(held["out"], kept, F.lit(_SEP)).alias("out"))

    none, size = F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), F.char_length("text")
    cut = F.aggregate(order, none, add, lambda h: F.concat(h["out"], F.substring(text, h["at"] + 1, size)))
    words = F.array_distinct(F.split(F.lower(cut), rf"[^\p{{L}}{_SEP}]+"))
    each = units.select("unit", F.explode(words).alias("term"))
    return each.where((F.length("term") > 2) & (F.instr("term", _SEP) == 0))


def met_together(units: DataFrame, texts: DataFrame, total: int, threshold: float, support: int) -> DataFrame:
    """unit, n_docs, entity, n_entity, term, n_term: every value and word that a text of ``units`` has both.

    ``texts`` has every document's text and ``total`` is their number. Left out are pairs that cannot pass: values and
    terms of too few texts, and terms so common that even in all of a value's texts they tell less than ``threshold``.
    """
    own = written(entities(units, support), "entities")
    words = written(words_outside(units.join(own.select("unit").distinct(), "unit", "left_semi")), "words")
    terms = written(words.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= support).select("term"), "terms")
    if terms.count() <= _SENT_ROWS:
        terms = F.broadcast(terms)
    every = texts.select(F.explode(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+"))).alias("term"))
    counted = written(every.join(terms, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n_term")), "counted")
    n = F.lit(float(total))
    most = F.log2(n / F.col("n_term")) + 1e-9 >= threshold * F.log2(n / F.col("n_entity"))
    words = words.join(counted, "term").withColumnRenamed("unit", "_unit")
    return written(own.join(words, (F.col("unit") == F.col("_unit")) & most).drop("_unit"), "pairs")


def revealing(met: DataFrame, total: int, threshold: float, support: int) -> DataFrame:
    """entity, term, share: terms that tell at least ``threshold`` of an entity's information.

    ``met`` is from ``met_together``. A pair must be met in ``support`` different texts, as an estimate from one text
    says nothing.
    """
    counts = F.sum("n_docs").alias("n_both"), F.count("*").alias("n_texts"), F.first("n_entity").alias("n_entity"), F.first("n_term").alias("n_term")
    found = met.groupBy("entity", "term").agg(*counts).where(F.col("n_texts") >= support)
    n = F.lit(float(total))
    information = F.log2(n / F.col("n_entity"))
    mutual = F.log2(n * F.col("n_both") / (F.col("n_entity") * F.col("n_term")))
    share = F.when(information > 0, mutual / information).otherwise(0.0)
    return found.select("entity", "term", share.alias("share")).where(F.col("share") >= threshold)


def marked_terms(units: DataFrame, actions: DataFrame) -> DataFrame:
    """_unit, terms: where the terms of ``actions`` (unit, term, action) stand in their text, all places outside values."""
    held = actions.groupBy("unit").agg(F.map_from_entries(F.collect_list(F.struct("term", "action"))).alias("actions"))
    words = located(F.col("text"), r"\p{L}+", lambda w: F.map_contains_key(F.col("actions"), F.lower(w)))
    own = units.join(held, "unit").select("unit", "spans", "actions", words.alias("words"))

    def apart(w: Column) -> Column:
        return ~F.exists("spans", lambda s: (s["start"] < w["end"]) & (w["start"] < s["end"]))

    def span(w: Column) -> Column:
        action = F.element_at("actions", F.lower(w["value"])).alias("action")
        return F.struct(F.lit("term").alias("kind"), w["start"].alias("start"), w["end"].alias("end"), action)

    return own.select(F.col("unit").alias("_unit"), F.transform(F.filter("words", apart), span).alias("terms"))


def disclosures(docs: DataFrame, threshold: float = 0.75, remove: float = 0.95, support: int = 2) -> DataFrame:
    """Per row of ``docs``: doc_id, unit (a hash of the text) and spans (kind, start, end, action), by kind and start.

    Kinds email, ip, card and phone are the fixed patterns, with action ``hide``. A ``term`` anywhere in a text with
    such a value that tells at least ``threshold`` of its information has action ``generalise``, or ``remove`` from
    share ``remove``, at all its places there outside values.
    Positions are in code points. A null or empty text has no spans; repeated rows give repeated rows; an empty
    table none. Other columns are ignored. Counts are over all documents.
    """
    rows = docs.select("doc_id", whole_text().alias("text")).withColumn("unit", F.xxhash64("text"))
    found = base_spans(rows)
    slim = F.when(F.size("spans") > 0, F.col("text")).otherwise("").alias("text")  # texts without values aren't kept
    found = written(found.select("doc_id", "unit", "spans", slim), "values")
    units, total = written(with_values(found), "units"), found.count()
    met = met_together(units, rows, total, threshold, support)
    told = met.join(revealing(met, total, threshold, support), ["entity", "term"])
    told = told.groupBy("unit", "term").agg(F.max("share").alias("share"))
    action = F.when(F.col("share") >= remove, "remove").otherwise("generalise").alias("action")
    marked = written(marked_terms(units, told.select("unit", "term", action)), "terms")
    out = found.select("doc_id", "unit", "spans").join(marked, F.col("unit") == F.col("_unit"), "left")
    kind = "array<struct<kind:string,start:int,end:int,action:string>>"
    base = F.transform("spans", lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lit("hide").alias("action")))
    return out.select("doc_id", "unit", F.concat(base.cast(kind), F.coalesce(F.col("terms").cast(kind), F.array().cast(kind))).alias("spans"))


def sanitised(docs: DataFrame, **how) -> DataFrame:
    """doc_id and text of each row: values and removed terms as ``[kind]``, generalised terms as their first letter.

    A null text becomes an empty one. Where spans overlap, the first by start (the longer of two) is written.
    """
    found = disclosures(docs, **how).where(F.size("spans") > 0).dropDuplicates(["doc_id", "unit"])
    found = found.select(F.col("doc_id").alias("_doc"), F.col("unit").alias("_unit"), "spans")
    rows = docs.select("doc_id", whole_text().alias("text"))
    same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.xxhash64("text") == F.col("_unit"))
    order = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), s["kind"].alias("kind"), s["action"].alias("action")))
    rows = rows.join(found, same, "left").withColumn("order", F.sort_array(order))
    none = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(held: Column, s: Column) -> Column:
        kept = F.substring(F.col("text"), held["at"] + 1, s["start"] - held["at"])
        letter = F.concat(F.substring(F.col("text"), s["start"] + 1, F.lit(1)), F.lit("…"))
        mark = F.when(s["action"] == "generalise", letter).otherwise(F.concat(F.lit("["), s["kind"], F.lit("]")))
        new = F.struct((-s["end"]).alias("at"), F.concat(held["out"], kept, mark).alias("out"))
        return F.when(s["start"] >= held["at"], new).otherwise(held)

    rest = F.char_length("text")
    clean = F.aggregate("order", none, add, lambda h: F.concat(h["out"], F.substring(F.col("text"), h["at"] + 1, rest)))
    return rows.select("doc_id", F.when(F.col("order").isNull(), F.col("text")).otherwise(clean).alias("text"))


def span_text(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    parts = F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(parts, ",")
