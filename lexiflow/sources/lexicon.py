"""Dictionary and stop-word text formats.

The dictionary editor's text is one entry per line, ``key = v1, v2``. These
functions run over a DataFrame of lines, so a dictionary file of any size is
parsed by Spark; a small one can come from a Python string.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# English stop words (the Snowball English list).
ENGLISH_STOPWORDS = (
    "i me my myself we our ours ourselves you your yours yourself yourselves "
    "he him his himself she her hers herself it its itself they them their "
    "theirs themselves what which who whom this that these those am is are was "
    "were be been being have has had having do does did doing would should "
    "could ought i'm you're he's she's it's we're they're i've you've we've "
    "they've i'd you'd he'd she'd we'd they'd i'll you'll he'll she'll we'll "
    "they'll isn't aren't wasn't weren't hasn't haven't hadn't doesn't don't "
    "didn't won't wouldn't shan't shouldn't can't cannot couldn't mustn't "
    "let's that's who's what's here's there's when's where's why's how's a an "
    "the and but if or because as until while of at by for with about against "
    "between into through during before after above below to from up down in "
    "out on off over under again further then once here there when where why "
    "how all any both each few more most other some such no nor not only own "
    "same so than too very"
).split()


WS = "[ \\t\\r\\n]"


def trim_ws(c):
    """Trim blanks, tabs and line ends at both ends (R's ``trimws``)."""
    return F.regexp_replace(c, "^" + WS + "+|" + WS + "+$", "")


def lines_df(spark: SparkSession, text: str) -> DataFrame:
    """Lines of a text with their order (for a dictionary typed as text)."""
    rows = [(i, ln) for i, ln in enumerate((text or "").split("\n"))]
    return spark.createDataFrame(rows, "line_no long, line string")


def dictionary_from_lines(lines: DataFrame, line_col: str = "line",
                          order_col: str = "line_no") -> DataFrame:
    """Parse ``key = v1, v2`` lines (S12) into ``(key, values ARRAY<STRING>)``.

    Lines are trimmed; blank lines, lines without ``=`` or with nothing after
    it, and empty keys are dropped; later ``=`` stay in the value; values are
    split at commas and trimmed (empty ones dropped); for a repeated key the
    last line wins, at the position of its first line."""
    ln = trim_ws(F.col(line_col))
    parts = F.split(ln, "=", 2)
    df = lines.select(F.col(order_col).alias("line_no"), ln.alias("ln"), parts.alias("p"))
    df = df.filter((F.size("p") == 2) & (F.length(trim_ws(F.col("p")[1])) > 0))
    df = df.select("line_no", trim_ws(F.col("p")[0]).alias("key"),
                   F.filter(F.transform(F.split(F.col("p")[1], ","), lambda v: trim_ws(v)),
                            lambda v: v != "").alias("values"))
    df = df.filter(F.col("key") != "")
    return (df.groupBy("key")
            .agg(F.min("line_no").alias("line_no"),
                 F.max_by("values", "line_no").alias("values"))
            .select("line_no", "key", "values"))


def dictionary_to_lines(dictionary: DataFrame) -> DataFrame:
    """``key = v1, v2`` lines of a dictionary DataFrame."""
    return dictionary.select(
        *([c for c in ("line_no",) if c in dictionary.columns]),
        F.concat_ws(" = ", F.col("key"), F.array_join(F.col("values"), ", ")).alias("line"))


def dictionary_from_text(spark: SparkSession, text: str) -> list[tuple[str, list[str]]]:
    """Small typed dictionary to the Python form used by the token chain."""
    rows = dictionary_from_lines(lines_df(spark, text)).orderBy("line_no").collect()
    return [(r["key"], list(r["values"])) for r in rows]


def stopwords_from_text(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Stop words typed as ``w1, w2 ,w3`` (S14): one row per word, in order."""
    items = F.split(F.col(text_col), " *, *")
    return (df.select(F.posexplode(items).alias("pos", "word"))
            .filter(F.col("word") != "").select("pos", "word"))


def stopword_list(spark: SparkSession, text: str) -> list[str]:
    """Parse a short typed stop-word list on the driver's session."""
    df = spark.createDataFrame([(text,)], "text string")
    return [r["word"] for r in stopwords_from_text(df).orderBy("pos").collect()]


