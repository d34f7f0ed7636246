"""Personal data: spans by form, and terms that reveal them by co-occurrence.  Column expressions only.

Base spans are e-mail addresses, IP addresses, card numbers and phone numbers.  Each value is
a protected entity.  A term (a word between marks and white space) that shares a text with an entity discloses it by

    disclosure(t, e) = PMI(t, e) / IC(e) = log(n(t,e) N / (n(t) n(e))) / log(N / n(e))

over numbers of candidates: one when the term occurs nowhere without the entity, zero when the two
are independent.  Terms over the threshold become spans wherever they stand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.functions.columns import bind, let

from .tables import packed, unpacked, written

#: Leftmost, non-overlapping matches, in time linear in the text: a match may start right after the
#: one before (\G) or where a run starts; quantifiers that never need to give back are possessive.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?+[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
KINDS = ("email", "ip", "card", "phone", "term")
#: What can be a term: words of four letters or more, or any word, such as short, hyphenated and user names.
TERM = r"^\p{L}{4,}$"
ANY_TERM = r"[\p{L}\p{N}]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
MARKS = ",.;:!?()[]{}\"'<>|\t\n\v\f\r"
SPAN = "struct<start:int,kind:int,end:int,value:string>"
PLAIN = "struct<start:int,kind:int,end:int>"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    places = F.sequence(F.lit(1), F.length(digits))

    def part(k: Column) -> Column:
        d = F.substring(F.reverse(digits), k, F.lit(1)).cast("int") * (F.lit(2) - k % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(places, part), F.lit(0), lambda a, d: a + d) % 10 == 0


def _holds(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.split(value, r"\.")
        small = F.forall(parts, lambda p: (F.length(F.regexp_replace(p, "^0+", "")) <= 3) & (F.substring(F.concat(F.lit("000"), F.regexp_replace(p, "^0+", "")), -3, 3).cast("int") <= 255))
        return small
    if kind == "card":
        return bind(_digits(value), lambda d: (F.length(d) >= 12) & (F.length(d) <= 19) & _luhn(d))
    if kind == "phone":
        return bind(F.length(_digits(value)), lambda n: (n >= 9) & (n <= 15))
    return F.lit(True)


def _matches(text: Column, kind: str, pattern: str, worth: Column) -> Column:
    """Spans of one kind.  A match is found again as a literal from the end of the one before: the
    pattern would match wherever the literal stands, so the first place is the match's own."""
    number = KINDS.index(kind)
    start = F.struct(F.lit(1).alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(acc: Column, value: Column) -> Column:
        def put(at: Column) -> Column:
            end = at + F.length(value)
            span = F.struct(
                (at - 1).alias("start"), F.lit(number).alias("kind"), (end - 1).alias("end"), value.alias("value")
            ).cast(SPAN)
            kept = F.when(_holds(kind, value), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
            return F.struct(end.alias("at"), kept.alias("spans"))

        return bind(F.call_function("locate", value, text, acc["at"]), put)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    spans = F.aggregate(found, start, step, lambda acc: acc["spans"])
    return F.when(worth, spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def base_spans(text: Column) -> Column:
    """Valid base spans in order of start, then kind; code points, end exclusive.  ``text`` must not be null."""
    digit_runs = F.regexp_like(text, F.lit(r"[0-9](?:[\x20-]?[0-9]){11}"))
    parts = [
        _matches(text, "email", EMAIL, F.contains(text, F.lit("@"))),
        _matches(text, "ip", IP, F.regexp_like(text, F.lit(r"[0-9]\.[0-9]++\."))),
        _matches(text, "card", CARD, digit_runs),
        _matches(text, "phone", PHONE, F.contains(text, F.lit("+"))),
    ]
    return F.array_sort(F.concat(*parts))


def _clean(text: Column) -> Column:
    """The text in lower case (A-Z) with marks and white space as single spaces; places stay the same."""
    return F.translate(text, UPPER + MARKS, LOWER + " " * len(MARKS))


def _masked(text: Column, spans: Column) -> Column:
    """The text with spaces over the spans."""

    def over(t: Column, s: Column) -> Column:
        n = s["end"] - s["start"]
        return F.overlay(t, F.repeat(F.lit(" "), n), s["start"] + 1, n)

    return F.when(F.size(spans) > 0, F.aggregate(spans, text, over)).otherwise(text)


def _terms(clean: Column, form: str) -> Column:
    """Distinct words of a clean text that have a term's form."""
    return F.array_distinct(F.filter(F.split(clean, " +"), lambda w: F.regexp_like(w, F.lit(form))))


def _entity(span: Column) -> Column:
    number = _digits(span["value"])
    value = F.when(span["kind"] <= KINDS.index("ip"), F.lower(span["value"])).otherwise(number)
    return F.concat_ws(":", span["kind"].cast("string"), value)


def _keyed(candidates: DataFrame) -> DataFrame:
    slim = candidates.select(F.col("ordinal").cast("long"), F.coalesce("text", F.lit("")).alias("text"))
    return slim.withColumn("text_key", F.xxhash64("text"))


def disclosing_terms(
    candidates: DataFrame, *, threshold: float = 0.95, support: int = 3, term: str = TERM
) -> tuple[DataFrame, DataFrame]:
    """Terms that disclose a protected entity, and the candidates that hold them.

    Terms: ``term``, ``disclosure`` (the largest over its entities).  Holders: ``ordinal``, ``text_key``, ``terms``.  A term counts
    where at least ``support`` different texts have it and the same entity, anywhere in them, so copies of one text prove
    nothing.  ``term``: the form of a term, a regular expression.  All candidates are counted; pairs of entity and
    term come only from texts with an entity that ``support`` different texts hold, as others cannot have such a pair.
    Counts combine before the shuffle, so a hot entity or term costs one row per task.
    """
    keyed = _keyed(candidates)
    spans = let(keyed, {"spans": base_spans(F.col("text"))}).where(F.size("spans") > 0)
    clean = spans.withColumn("clean", _clean(_masked(F.col("text"), F.col("spans"))))
    texts = clean.select(
        "ordinal",
        "text_key",
        F.array_distinct(F.transform("spans", _entity)).alias("entities"),
        "clean",
    ).withColumn("terms", _terms(F.col("clean"), term))
    held_entities = written(spans.select("ordinal", "text_key", F.explode(F.array_distinct(F.transform("spans", _entity))).alias("entity")).distinct(), "entities")
    entities = held_entities.groupBy("entity").agg(F.count("*").alias("n_entity"), F.countDistinct("text_key").alias("n_texts"))
    entities = written(entities.where(F.col("n_texts") >= support).drop("n_texts"), "entity-counts")
    shared = held_entities.join(entities.select("entity"), "entity", "left_semi")
    holding = shared.select("ordinal", "text_key").distinct().withColumnsRenamed({"ordinal": "_ordinal", "text_key": "_key"})
    same = F.col("ordinal").eqNullSafe(F.col("_ordinal")) & (F.col("text_key") == F.col("_key"))
    near = texts.join(holding, same, "left_semi").select("ordinal", "text_key", F.explode("terms").alias("term")).distinct()
    near = written(near, "entity-terms")
    named = shared.select(F.col("ordinal").alias("_ordinal"), F.col("text_key").alias("_key"), "entity")
    exploded = near.join(named, same).select("ordinal", "text_key", "entity", "term")
    pairs = exploded.groupBy("entity", "term").agg(
        F.count("*").alias("n_both"), F.countDistinct("text_key").alias("n_texts")
    )
    n = F.lit(float(candidates.count()))
    information = F.log(n / F.col("n_entity"))

    def disclosure(n_term: str) -> Column:
        pmi = F.log(F.col("n_both") * n / (F.col(n_term) * F.col("n_entity")))
        return F.when(information > 0, pmi / information).otherwise(F.lit(0.0))

    # a term stands in at least as many candidates as it shares with such entities: an upper bound of its
    # disclosure, which leaves out common words before the whole corpus is searched for terms
    near_any = near.groupBy("term")
    pairs = pairs.where(F.col("n_texts") >= support).join(entities, "entity")
    pairs = pairs.join(near_any.agg(F.count("*").alias("n_near")), "term").where(disclosure("n_near") >= threshold)
    pairs = written(pairs, "disclosure-pairs")
    wanted = written(pairs.select("term").distinct(), "disclosure-terms")
    words = _terms(_clean(F.col("text")), term)
    held = keyed.select("ordinal", "text_key", F.explode(words).alias("term")).join(wanted, "term", "left_semi")
    held = written(held, "disclosure-words")
    totals = held.groupBy("term").agg(F.count("*").alias("n_term"))
    scored = pairs.join(totals, "term").withColumn("disclosure", disclosure("n_term"))
    terms = scored.groupBy("term").agg(F.max("disclosure").alias("disclosure")).where(F.col("disclosure") >= threshold)
    terms = written(terms, "disclosing")
    holders = held.join(terms.select("term"), "term", "left_semi").groupBy("ordinal", "text_key").agg(
        F.collect_set("term").alias("terms")
    )
    return terms, written(holders, "disclosure-holders")


def _term_spans(clean: Column, terms: Column) -> Column:
    """Places of the given terms among the words of a text."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{PLAIN}>").alias("spans"))

    def step(acc: Column, word: Column) -> Column:
        end = acc["at"] + F.length(word)
        span = F.struct(acc["at"].alias("start"), F.lit(KINDS.index("term")).alias("kind"), end.alias("end")).cast(PLAIN)
        spans = F.when(F.array_contains(terms, word), F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"])
        return F.struct((end + 1).alias("at"), spans.alias("spans"))

    return F.aggregate(F.split(clean, " "), start, step, lambda acc: acc["spans"])


def _safe(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of overlapping spans the first is named."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])

    def step(acc: Column, s: Column) -> Column:
        gap = F.substring(text, acc["at"] + 1, F.greatest(s["start"] - acc["at"], F.lit(0)))
        fresh = F.when(s["start"] >= acc["at"], F.array(gap, F.element_at(names, s["kind"] + 1))).otherwise(
            F.array().cast("array<string>")
        )
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["parts"], fresh).alias("parts"))

    def end(acc: Column) -> Column:
        return F.concat(F.array_join(acc["parts"], ""), F.substring(text, acc["at"] + 1, F.length(text)))

    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, end)).otherwise(text)


def protect_candidates(candidates: DataFrame, *, with_text: bool = True, **settings) -> DataFrame:
    """Adds ``spans`` and, if wanted, ``safe_text`` to candidates.

    ``spans``: array of (``start``, ``kind``, ``end``) in order of start, then kind (``KINDS`` by number), in code points of ``text``, end
    exclusive.  Base spans are found row by row; terms of ``disclosing_terms`` (see there for the settings) are added
    where they overlap no base span.  ``safe_text``: every span replaced by its kind.  Null text counts as empty and stays null in
    ``safe_text``; equal rows get equal results; null ordinals are ordinary values; every other column is passed on, own
    columns of these names are replaced.  A text of any length is read whole.
    """
    _, holders = disclosing_terms(candidates, **settings)
    rows = packed(candidates, ordinal="ordinal", text="text")
    rows = rows.withColumn("_text", F.coalesce("text", F.lit("")))
    named = holders.select(
        F.col("ordinal").alias("_ordinal"), F.col("text_key").alias("_key"), F.col("terms").alias("_terms")
    )
    same = F.col("ordinal").cast("long").eqNullSafe(F.col("_ordinal")) & (F.xxhash64("_text") == F.col("_key"))
    joined = let(rows.join(named, same, "left").drop("_ordinal", "_key"), {"_base": base_spans(F.col("_text"))})
    base = F.transform("_base", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))
    terms = F.filter(
        _term_spans(_clean(F.col("_text")), F.col("_terms")),
        lambda t: ~F.exists("_base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])),
    )
    every = F.when(F.col("_terms").isNull(), base).otherwise(F.array_sort(F.concat(base, terms)))
    out = let(joined, {"spans": every})
    if with_text:
        out = out.withColumn("safe_text", F.when(F.col("text").isNotNull(), _safe(F.col("_text"), F.col("spans"))))
    added = ["spans", "safe_text"] if with_text else ["spans"]
    return unpacked(out, [c for c in candidates.columns if c != "safe_text"], added, ordinal="ordinal", text="text")


def span_text(spans: Column) -> Column:
    """``kind:start:end`` of every span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))),
        ",",
    )


def kind_count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == F.lit(KINDS.index(kind)))).cast("long")
