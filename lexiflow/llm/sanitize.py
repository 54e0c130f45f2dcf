"""Operator 9, personal data and information-theoretic sanitisation. DataFrame
functions only: no Python runs on the executors.

Base. Regular expressions find e-mail addresses, IP addresses, card and phone
numbers; matches that fail the kind's test (parts, Luhn, digits) are dropped.
Positions are code points, end exclusive: the lengths of the pieces between
matches give them.

Disclosure. What the base finds are protected entities. A word near one
(``reach`` words before or after) may give it away. The corpus tells how
strongly: with co-occurrence counted over all texts, the point-wise mutual
information of word and entity kind is set against what the kind itself
carries, ``PMI(word; kind) / -log2 p(kind)``, where ``p(kind)`` is the share of
word positions within reach of that kind. At ``generalise`` or more the word's
occurrences within reach are generalised (to the name of the kind), at
``remove`` or more they are removed. A word counts only if it is seen near
the kind at least ``support`` times, in that many texts.

The table of words near entities is counted first; the corpus counts are then
needed for these words only. Words near entities are a small share of all, and
counts are summed per task before any shuffle, so a frequent word is one row a
task.

Cases: null text is empty (no spans, empty sanitised text); a match inside
another kind's match is reported by both, and the first kind's (in the listed
order) is replaced in the text; repeated rows are treated alike; a null id is
kept; extra columns are ignored; an empty table gives an empty result."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiflow.llm.common import row_key, stored

# Kinds, patterns (possessive or anchored forms of the plain ones, so
# that no run of characters is scanned twice) and their labels.
KINDS = ["email", "ip", "card", "phone"]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A cheap condition that every text with a match meets.
HINTS = {"email": "@", "ip": ".", "phone": "+"}
TERM = "term"
WORD = r"[\p{L}\p{N}]+"
SPANS = "array<struct<start:int,end:int,kind:string>>"


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda acc, i: acc + _luhn_digit(digits, n, i))
    return total % 10 == 0


def _luhn_digit(digits: Column, n: Column, i: Column) -> Column:
    d = F.substring(digits, i, F.lit(1)).cast("int")
    twice = d * 2
    return F.when((n - i) % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d)


def _valid(kind: str, m: Column) -> Column:
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        # longer parts than 3 digits without leading zeros exceed 255
        return F.forall(F.split(m, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike("^([0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    n = F.length(_digits(m))
    if kind == "card":
        return F.when(n.between(16, 19), _luhn(_digits(m))).otherwise(False)
    return n.between(8, 15)


def placed(found: Column, gaps: Column) -> Column:
    """``array<struct<start, end, text>>``: the matches where the pieces between
    them put them. Both must be columns, since each step reads them."""
    empty = F.array().cast("array<struct<start:int,end:int,text:string>>")
    return F.when(F.size(found) == 0, empty).otherwise(F.aggregate(
        F.sequence(F.lit(0), F.size(found) - 1), F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, k: F.struct(
            (acc["at"] + F.length(F.get(gaps, k)) + F.length(F.get(found, k))).alias("at"),
            F.concat(acc["out"], F.array(F.struct(
                (acc["at"] + F.length(F.get(gaps, k))).alias("start"),
                (acc["at"] + F.length(F.get(gaps, k)) + F.length(F.get(found, k))).alias("end"),
                F.get(found, k).alias("text")))).alias("out")),
        lambda acc: acc["out"]))


def _valid_spans(kind: str, found: Column) -> Column:
    kept = F.filter(found, lambda s: _valid(kind, s["text"]))
    return F.transform(kept, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def base_spans(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """``(row, doc_id, text, carried, base)``; ``row`` names the row's id and
    text, ``carried`` holds the columns ``carry``."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
                       F.struct(F.lit(0).alias("_"), *[F.col(f"`{c}`") for c in carry]).alias("carried"))
    none = F.array().cast("array<string>")
    for k in KINDS:
        found = F.regexp_extract_all(F.col("text"), F.lit(PATTERNS[k]), F.lit(0))
        rows = rows.withColumn(f"f_{k}", F.when(F.contains("text", F.lit(HINTS[k])), found).otherwise(none) if k in HINTS else found)
    rows = rows.select("doc_id", "text", "carried", *[f"f_{k}" for k in KINDS], *[
        F.when(F.size(f"f_{k}") > 0, F.split("text", PATTERNS[k], -1)).otherwise(none).alias(f"g_{k}") for k in KINDS])
    spans = [_valid_spans(k, placed(F.col(f"f_{k}"), F.col(f"g_{k}"))) for k in KINDS]
    return rows.select(row_key().alias("row"), "doc_id", "text", "carried", F.concat(*spans).alias("base"))


def words_near(rows: DataFrame, reach: int) -> DataFrame:
    """``(row, word, start, end, kind)``: every word within reach of a span,
    once per kind. Words are sought in ``64 * reach`` characters."""
    side = F.lit(64 * reach)
    one = rows.select("row", F.explode("base").alias("s"), "text")
    sides = [
        one.select("row", "s.kind", F.greatest(F.lit(0), F.col("s.start") - side).alias("at"), F.lit(True).alias("left"),
                   F.substring("text", F.greatest(F.lit(1), F.col("s.start") + 1 - side), F.least(F.col("s.start"), side)).alias("t")),
        one.select("row", "s.kind", F.col("s.end").alias("at"), F.lit(False).alias("left"),
                   F.substring("text", F.col("s.end") + 1, side).alias("t")),
    ]
    parts = sides[0].unionByName(sides[1]).select(
        "row", "kind", "at", "left", F.regexp_extract_all("t", F.lit(WORD), F.lit(0)).alias("w"),
        F.split("t", WORD, -1).alias("g"))
    spans = placed(F.col("w"), F.col("g"))
    nearest = F.when(F.col("left"), F.slice("m", F.greatest(F.lit(1), F.size("m") - reach + 1), F.lit(reach))) \
        .otherwise(F.slice("m", F.lit(1), F.lit(reach)))
    return parts.select("row", "kind", "at", "left", spans.alias("m")) \
        .select("row", "kind", "at", F.explode(nearest).alias("m")) \
        .select("row", "kind", F.lower("m.text").alias("word"), (F.col("at") + F.col("m.start")).alias("start"),
                (F.col("at") + F.col("m.end")).alias("end")).distinct()


def disclosing(rows: DataFrame, near: DataFrame, support: int, generalise: float) -> DataFrame:
    """``(word, kind, strength)`` of the words that give a kind away."""
    pairs = near.groupBy("word", "kind", "row").agg(F.count(F.lit(1)).alias("n")) \
        .groupBy("word", "kind").agg(F.sum("n").alias("both"), F.count(F.lit(1)).alias("texts")) \
        .where((F.col("both") >= support) & (F.col("texts") >= support))
    kinds = near.groupBy("kind").agg(F.count(F.lit(1)).alias("n_kind"))  # at most one row per kind
    counts = stored(rows.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))).alias("word"))
                    .groupBy("word").agg(F.count(F.lit(1)).alias("n_word")), "words")
    total = F.lit(counts.agg(F.sum("n_word")).first()[0] or 1).cast("double")
    pmi = F.log2(F.col("both") * total / (F.col("n_word") * F.col("n_kind")))
    return pairs.join(counts, "word").join(F.broadcast(kinds), "kind") \
        .withColumn("strength", F.when(F.col("n_kind") < total, pmi / F.log2(total / F.col("n_kind"))).otherwise(0.0)) \
        .where(F.col("strength") >= generalise).select("word", "kind", "strength")


def sanitize(docs: DataFrame, reach: int = 5, support: int = 5, generalise: float = 0.8, remove: float = 0.95,
             id_col: str = "doc_id", text_col: str = "text", with_text: bool = True,
             carry: list[str] | None = None) -> DataFrame:
    """One row per document: ``base`` and ``spans`` (base and disclosing words,
    in order of kind and start) and, if ``with_text``, the sanitised text; the
    columns ``carry`` in the struct ``carried``."""
    rows = base_spans(docs, id_col, text_col, carry or [])
    marked = stored(rows.where(F.size("base") > 0).select("row", "text", "base"), "entities")
    near = stored(words_near(marked, reach), "near")
    terms = stored(disclosing(base_rows(docs, text_col), near, support, generalise), "terms")
    covered = near.join(terms, ["word", "kind"]).groupBy("row", "start", "end") \
        .agg(F.max(F.struct("strength", "kind")).alias("m")) \
        .groupBy("row").agg(F.array_sort(F.collect_list(F.struct(
            "start", "end", F.when(F.col("m.strength") >= remove, F.lit("")).otherwise(F.col("m.kind")).alias("as")))).alias("words"))
    extra = marked.select("row", "base").distinct().join(covered, "row").select(
        "row", F.filter("words", lambda w: ~F.exists("base", lambda b: (w["start"] < b["end"]) & (b["start"] < w["end"]))).alias("words"))
    none = F.array().cast("array<struct<start:int,end:int,as:string>>")
    out = rows.join(extra, "row", "left").withColumn("words", F.coalesce("words", none))
    spans = F.concat("base", F.transform("words", lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.lit(TERM).alias("kind"))))
    cols = [F.col("doc_id"), F.col("base"), spans.alias("spans"), F.col("carried")]
    if with_text:
        cols.append(sanitised(F.col("text"), F.col("base"), F.col("words")).alias("sanitised"))
    return out.select(*cols)


def base_rows(docs: DataFrame, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def sanitised(text: Column, base: Column, words: Column) -> Column:
    """The text with entities and generalised words replaced by their kind in
    angle brackets, and removed words left out."""
    put = F.array_sort(F.concat(
        F.transform(base, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), F.concat(F.lit("<"), s["kind"], F.lit(">")).alias("put"))),
        F.transform(words, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"),
                                              F.when(s["as"] == "", "").otherwise(F.concat(F.lit("<"), s["as"], F.lit(">"))).alias("put")))))
    done = F.aggregate(
        put, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.when(s["start"] < acc["at"], acc).otherwise(F.struct(
            (-s["back"]).alias("at"),
            F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), s["put"]).alias("out"))),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(put) == 0, text).otherwise(done)


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def joined(spans: Column) -> Column:
    """``kind:start:end`` of the spans, comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
