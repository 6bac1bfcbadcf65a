"""Measures over texts and results: tokens, bytes, savings, the never-grow guard, cost, cache status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A pre-token is a contraction, a run of letters, digits or other marks with the space before it, or white
#: space. A run counts one for each 6 characters begun, white space one for each 16; so tokens are the matches
#: of runs cut to that length. The look-behinds keep a cut from starting what a whole run would have held; they
#: come after the character they are about, and the ASCII part of each class before the rest, as Unicode's are slow.
TOKEN = r"(?U)'(?<![^\s\w]')(?:[sdmt]|ll|ve|re)|(?: (?<!\s ))?(?:[a-zA-Z[^\W\d_]]{1,6}|[0-9\d]{1,6}|[!-/:-@\[-^`{-~[^\s\w]]{1,6})|[ \n\s]{1,16}"


def sealed(df: DataFrame, *names: str) -> DataFrame:
    """df with these columns generated from one struct: a filter on them stays above, and is not computed anew below."""
    return df.select(*[c for c in df.columns if c not in names], F.inline(F.array(F.struct(*names))))


def token_count(c: Column) -> Column:
    """Approximate tokens of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(c, F.lit(TOKEN)), F.lit(0)).cast("long")


def with_counter(df: DataFrame, encodings: DataFrame, model: str = "model", text: str = "text") -> DataFrame:
    """df with encoding (by model, o200k_base where unknown), tokens and exact (false: tokens are the approximation).

    encodings is the small dimension model_name, encoding; it is broadcast, with as many rows as there are models.
    """
    e = F.broadcast(encodings.select(F.col("model_name"), F.col("encoding")))
    out = df.join(e, F.col(model) == F.col("model_name"), "left").drop("model_name")
    return out.withColumn("encoding", F.coalesce("encoding", F.lit("o200k_base"))).withColumn("tokens", token_count(F.col(text))).withColumn("exact", F.lit(False))


def pct(saved: Column, before: Column) -> Column:
    return F.when(before > 0, F.round(100.0 * saved / before, 2)).otherwise(F.lit(0.0))


def with_savings(df: DataFrame) -> DataFrame:
    """tokens_saved, bytes_saved, their percentages and changed, from tokens/bytes before and after and steps."""
    return (
        df.withColumn("tokens_saved", F.col("tokens_before") - F.col("tokens_after"))
        .withColumn("bytes_saved", F.col("bytes_before") - F.col("bytes_after"))
        .withColumn("token_pct", pct(F.col("tokens_saved"), F.col("tokens_before")))
        .withColumn("byte_pct", pct(F.col("bytes_saved"), F.col("bytes_before")))
        .withColumn("changed", F.size("steps") > 0)
    )


def never_grow(df: DataFrame, strict: bool = True) -> DataFrame:
    """Puts back the original text, without steps, where the new one has more tokens (not strict: as many or more)."""
    before, after = F.col("tokens_before"), F.col("tokens_after")
    grown = after > before if strict else after >= before
    out = (
        df.withColumn("grown", grown)
        .withColumn("cleaned", F.when(F.col("grown"), F.col("text")).otherwise(F.col("cleaned")))
        .withColumn("steps", F.when(F.col("grown"), F.array().cast("array<string>")).otherwise(F.col("steps")))
        .withColumn("tokens_after", F.when(F.col("grown"), before).otherwise(after))
        .withColumn("bytes_before", F.octet_length("text").cast("long"))
        .withColumn("bytes_after", F.octet_length("cleaned").cast("long"))
        .drop("grown")
    )
    return sealed(out, "cleaned", "steps", "tokens_before", "tokens_after", "bytes_before", "bytes_after")


def cache_status(hits: Column, lookups: Column) -> Column:
    return F.when(lookups == 0, F.lit(None)).when(hits == 0, "miss").when(hits >= lookups, "hit").otherwise("partial")


def cost(tokens: Column, usd_per_million: Column | float) -> Column:
    """List price of so many tokens; null where the rate is 0."""
    rate = F.lit(usd_per_million) if isinstance(usd_per_million, (int, float)) else usd_per_million
    return F.when(rate != 0, F.round(tokens / 1e6 * rate, 4))
