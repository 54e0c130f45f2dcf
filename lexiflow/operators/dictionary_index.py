"""Dictionary lookup as a vocabulary job.

The expressions of ``tokens.dictionary_lookup`` test every pattern on every
token. Here the patterns are a table, matched once per distinct term through an index:

* a fixed word, or a glob without ``*``/``?``, by equality of the lowered term;
* a glob by its longest literal part: its beginning (``ab*``), its end
  (``*ab``), or any place (``*ab*``), by equality with the term's pieces of that
  length; the hits are then tested with the whole pattern;
* a glob without a letter (``??``) by its length; a regular expression has no
  key, and is tested on distinct terms only.

Matched terms go back to their positions by a join on the term. Only positions
that a filter of fixed size lets pass take part, so the join moves little even if the
matched vocabulary, which is stored, is too large to be broadcast. Values of several words go word
by word along the distinct beginnings of values: a beginning and the next token
give the longer beginning, so only those found in the text go further, and values
that share a beginning share its rows. The spans chosen meet their documents in one
shuffle, where the tokens of a document travel as one text. The result is that of
``tokens.dictionary_lookup``."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import fence
from ..session import materialize
from .counting import filter_of, word_places
from .tokens import _entries

PATTERNS = "key_no int, key string, value string"
#: Pattern words up to this number are tested before the terms are made distinct.
LITERAL_WORDS = 5_000
#: Stands between the tokens of a text; tokens that hold it travel as an array.
TOKEN_SEP = "\u0001"


def dictionary_table(spark, dictionary) -> DataFrame:
    """``key_no, key, value`` of a dictionary given as a mapping or pairs."""
    rows = [(i, k, v) for i, (k, values) in enumerate(_entries(dictionary)) for v in values if v and v.strip()]
    return spark.createDataFrame(rows, PATTERNS)


def _quoted(c: Column) -> Column:
    """A glob's text as a pattern: ``*`` any run, ``?`` one character."""
    escaped = F.regexp_replace(c, r"([\\.^$|+()\[\]{}])", r"\\$1")
    return F.concat(F.lit("(?iu)^"), F.replace(F.replace(escaped, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")),
                    F.lit("$"))


def word_keys(words: DataFrame, valuetype: str) -> DataFrame:
    """``word, kind, size, part, regex``: the index key of each distinct
    pattern word. ``regex`` is null where the key alone decides."""
    low = F.lower("word")
    if valuetype == "fixed":
        return words.select("word", F.lit("whole").alias("kind"), F.lit(0).alias("size"), low.alias("part"),
                            F.lit(None).cast("string").alias("regex"))
    if valuetype == "regex":
        return words.select("word", F.lit("any").alias("kind"), F.lit(0).alias("size"), F.lit("").alias("part"),
                            F.concat(F.lit("(?iu)(?:"), F.col("word"), F.lit(")")).alias("regex"))
    if valuetype != "glob":
        raise ValueError("valuetype must be glob, regex or fixed")
    pieces = F.split(low, r"[*?]")
    longest = F.array_max(F.transform(pieces, lambda p: F.struct(F.length(p).alias("size"), p.alias("part"))))
    head, tail = pieces[0], F.element_at(pieces, -1)
    wild = low.rlike(r"[*?]")
    best = longest["size"]
    kind = F.when(~wild, "whole").when(best == 0, F.when(F.instr(low, "*") > 0, "any").otherwise("length")) \
        .when(F.length(head) == best, "head").when(F.length(tail) == best, "tail").otherwise("inside")
    # a lone star at one end leaves nothing to test
    sure = (~wild) | low.rlike(r"^[^*?]+\*$") | low.rlike(r"^\*[^*?]+$") | low.rlike(r"^\*[^*?]+\*$") | low.rlike(r"^\?+$")
    keyed = words.withColumns({"kind": kind, "__best": best, "__low": low})
    part = F.when(F.col("kind") == "whole", F.col("__low")).when(F.col("kind") == "head", head) \
        .when(F.col("kind") == "tail", tail).when(F.col("kind") == "inside", longest["part"]).otherwise("")
    size = F.when(F.col("kind") == "length", F.length("__low")).when(F.col("kind").isin("whole", "any"), 0) \
        .otherwise(F.col("__best"))
    return keyed.select("word", "kind", size.cast("int").alias("size"), part.alias("part"),
                        F.when(~sure, _quoted(low)).alias("regex"))


def matched_vocabulary(terms: DataFrame, words: DataFrame, valuetype: str) -> DataFrame:
    """``term, word``: which pattern words match which distinct terms. A term
    is looked up once by each key it can have: itself, its length, and its
    pieces of the sizes that the patterns use. ``terms`` may repeat a term."""
    keys = materialize(word_keys(words.select("word").distinct(), valuetype))
    low = F.lower("term")
    found = []
    seen = keys.groupBy("kind").agg(F.collect_set("size").alias("sizes"), F.count(F.lit(1)).alias("n")).collect()
    kinds = {r.kind: sorted(r.sizes) for r in seen}
    if [r.kind for r in seen] == ["whole"] and seen[0].n <= LITERAL_WORDS:
        terms = terms.where(low.isin([r.part for r in keys.select("part").distinct().collect()]))  # bounded
    terms = terms.distinct()
    for kind, sizes in sorted(kinds.items()):  # six kinds; sizes are bounded by the longest pattern
        own = keys.where(F.col("kind") == kind).drop("kind")
        if kind == "any":
            # no key (regular expressions, lone stars): each is one expression,
            # tested on distinct terms
            tests = [F.when(F.col("term").rlike(r.regex), F.lit(r.word)) for r in own.select("word", "regex").collect()]
            found.append(terms.select("term", F.explode(F.array_compact(F.array(*tests))).alias("word")))
            continue
        if kind == "whole":
            pieces = terms.select("term", F.lit(0).alias("size"), low.alias("part"))
        elif kind == "length":
            pieces = terms.select("term", F.length("term").alias("size"), F.lit("").alias("part"))
        else:
            by_size = [_pieces(low, kind, size) for size in sizes]
            pieces = terms.select("term", F.explode(F.array_distinct(F.flatten(F.array(*by_size)))).alias("part")) \
                .select("term", F.length("part").alias("size"), "part")
        hit = pieces.join(own, ["size", "part"])
        found.append(hit.where(F.col("regex").isNull() | F.expr("rlike(term, regex)")).select("term", "word"))
    if not found:
        return terms.select("term", F.col("term").alias("word")).limit(0)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.distinct()


def _pieces(low: Column, kind: str, size: int) -> Column:
    """The pieces of one size that a term can be found by."""
    none = F.array().cast("array<string>")
    if kind == "head":
        own = F.array(F.substring(low, 1, size))
    elif kind == "tail":
        own = F.array(F.right(low, F.lit(size)))
    else:
        own = F.transform(F.sequence(F.lit(1), F.length(low) - size + 1), lambda i: F.substring(low, i, F.lit(size)))
    return F.when(F.length(low) >= size, own).otherwise(none)


def lookup_matches(tokens_df: DataFrame, patterns: DataFrame, valuetype: str = "glob", tokens_col: str = "tokens",
                   id_col: str = "doc_id") -> DataFrame:
    """``doc_id, key_no, key, pos, len``: at each position the longest value of
    each key that matches there."""
    values = patterns.select("key_no", F.upper("key").alias("key"),
                             F.filter(F.split(F.trim("value"), r"\s+"), lambda w: w != "").alias("words")) \
        .where(F.size("words") > 0).distinct()
    values = materialize(values.withColumn("n_words", F.size("words")))
    longest = values.agg(F.max("n_words")).first()[0] or 0
    words = values.select(F.explode("words").alias("word")).distinct()
    tok = F.col(tokens_col)
    rows = tokens_df.select(F.col(id_col).alias("doc_id"), tok.alias("tokens"))
    vocabulary = materialize(matched_vocabulary(rows.select(F.explode("tokens").alias("term")), words, valuetype))
    step = vocabulary.select("term", "word")

    def places(table, after):
        # a table of terms is joined to the positions that its filter lets pass
        bits = filter_of(table.select(F.array("term").alias("words")), "words")
        return word_places(rows, bits, after).withColumnRenamed("__id", "doc_id").join(table, "term")

    def beginning(k):
        return F.array_join(F.slice("words", 1, k), " ").alias("begun")  # no word holds a space

    def by_term(table, *cols):
        # stored, so that a small table is known to be small and the positions stay where they are
        return materialize(table.join(step, "word").select("term", *cols).distinct())

    single = values.where("n_words = 1").select(F.col("words")[0].alias("word"), "key_no", "key")
    out = places(by_term(single, "key_no", "key"), 0) \
        .select("doc_id", "key_no", "key", "pos", F.lit(1).alias("len"))
    if longest > 1:
        # from beginning to beginning: a position has a row per beginning that
        # its tokens match, however many values begin so
        first = values.where("n_words > 1").select(F.col("words")[0].alias("word"), beginning(1))
        going = places(by_term(first, "begun"), longest - 1).where(F.size("after") > 0).drop("term")
        for k in range(1, longest):
            going = going.withColumn("term", F.try_element_at("after", F.lit(k)))
            last = values.where(F.col("n_words") == k + 1) \
                .select(F.col("words")[k].alias("word"), beginning(k), "key_no", "key")
            out = out.unionByName(going.join(by_term(last, "begun", "key_no", "key"), ["begun", "term"])
                                  .select("doc_id", "key_no", "key", "pos", F.lit(k + 1).alias("len")))
            if k + 1 < longest:
                on = values.where(F.col("n_words") > k + 1) \
                    .select(F.col("words")[k].alias("word"), beginning(k), beginning(k + 1).alias("__next"))
                going = going.join(by_term(on, "begun", "__next"), ["begun", "term"]) \
                    .select("doc_id", "pos", "after", F.col("__next").alias("begun"))
    # one shuffle: all that follows is by document
    return out.repartition("doc_id").groupBy("doc_id", "key_no", "key", "pos").agg(F.max("len").alias("len"))


def chosen_spans(matches: DataFrame) -> DataFrame:
    """``doc_id, key_no, key, pos, len`` of the matches that count: per key the
    leftmost-longest values of several words that do not overlap, and the
    single words outside them. Matches overlap within a *chain*
    only; the left-to-right choice runs inside each chain."""
    by_key = Window.partitionBy("doc_id", "key_no").orderBy("pos")
    reach = F.max(F.when(F.col("len") > 1, F.col("pos") + F.col("len") - 1)) \
        .over(by_key.rowsBetween(Window.unboundedPreceding, -1))
    chained = matches.withColumn("__new", F.when(reach >= F.col("pos"), 0).otherwise(1)) \
        .withColumn("__chain", F.sum("__new").over(by_key))
    chains = chained.groupBy("doc_id", "key_no", "key", "__chain").agg(
        F.sort_array(F.collect_list(F.struct("pos", "len"))).alias("m"))

    def step(acc, x):
        return F.when(x["pos"] > acc["last"], F.struct((x["pos"] + x["len"] - 1).alias("last"),
                                                       F.concat(acc["kept"], F.array(x)).alias("kept"))).otherwise(acc)
    start = F.struct(F.lit(0).alias("last"), F.array().cast("array<struct<pos:int,len:int>>").alias("kept"))
    # a chain of one needs no choice
    kept = F.when(F.size("m") == 1, F.col("m")).otherwise(F.aggregate("m", start, step, lambda acc: acc["kept"]))
    return chains.select("doc_id", "key_no", "key", F.inline(kept))


def dictionary_lookup_indexed(tokens_df: DataFrame, dictionary, valuetype: str = "glob", tokens_col: str = "tokens",
                              id_col: str = "doc_id") -> DataFrame:
    """``tokens.dictionary_lookup`` for dictionaries of any size: same result.
    ``dictionary`` is a mapping, pairs, or a DataFrame ``key_no, key, value``
    (``key_no`` orders the keys). ``id_col`` must be unique and not null."""
    spark = tokens_df.sparkSession
    patterns = dictionary if isinstance(dictionary, DataFrame) else dictionary_table(spark, dictionary)
    stored = materialize(tokens_df)  # read for the vocabulary, the positions and the result
    spans = chosen_spans(lookup_matches(stored, patterns, valuetype, tokens_col, id_col))
    # each span with the last position that an earlier one covers
    earlier = Window.partitionBy("doc_id").orderBy("pos", "key_no", "key").rowsBetween(Window.unboundedPreceding, -1)
    placed = spans.withColumn("end", F.col("pos") + F.col("len") - 1) \
        .withColumn("before", F.coalesce(F.max("end").over(earlier), F.lit(0)))
    by_doc = placed.groupBy(F.col("doc_id").alias("__id")).agg(
        F.sort_array(F.collect_list(F.struct("pos", "key_no", "key", "before"))).alias("__at"), F.max("end").alias("__last"))
    out = _packed(stored, tokens_col).join(by_doc, F.col(id_col) == F.col("__id"), "left").drop("__id")
    out = _unpacked(out, tokens_col)
    tok = F.col(tokens_col)
    # the stretch of tokens before each span that no span covers, then its key
    parts = F.transform("__at", lambda m: F.concat(
        F.slice(tok, m["before"] + 1, F.greatest(m["pos"] - m["before"] - 1, F.lit(0))), F.array(m["key"])))
    rest = F.slice(tok, F.col("__last") + 1, F.greatest(F.size(tok) - F.col("__last"), F.lit(0)))
    result = F.when(F.col("__at").isNull(), tok).otherwise(F.concat(F.flatten(parts), rest))
    return out.withColumn(tokens_col, fence(result)).drop("__at", "__last")


def _packed(df: DataFrame, tokens_col: str) -> DataFrame:
    """Tokens as one text, about half as large in a shuffle as an array of strings."""
    tok = F.col(tokens_col)
    out = df.withColumn("__text", fence(F.array_join(tok, TOKEN_SEP, TOKEN_SEP)))
    joints = F.octet_length("__text") - F.octet_length(F.replace(F.col("__text"), F.lit(TOKEN_SEP), F.lit("")))
    # one more joint where a token is null or holds the separator
    out = out.withColumn("__plain", fence(F.coalesce(joints == F.size(tok) - 1, F.lit(False))))
    return out.withColumns({"__text": F.when(F.col("__plain"), F.col("__text")),
                            tokens_col: F.when(~F.col("__plain"), tok)}).drop("__plain")


def _unpacked(df: DataFrame, tokens_col: str) -> DataFrame:
    tokens = F.coalesce(F.col(tokens_col), F.split("__text", TOKEN_SEP))
    return df.withColumn(tokens_col, fence(tokens)).drop("__text")
