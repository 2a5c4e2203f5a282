"""Which texts contain which ids, without comparing every id with every text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opscheck.operators.keyed import complete, probe

_PIECE = 65_536


def _pieces(text: Column, overlap: Column) -> Column:
    """Cut a long text into pieces that overlap by ``overlap`` characters."""
    pattern = F.concat(F.lit("(?s)(?=(.{1,"), (F.lit(_PIECE) + overlap).cast("string"),
                       F.lit(f"}})).{{1,{_PIECE}}}"))
    return F.when(F.length(text) <= _PIECE, F.array(text)).otherwise(
        F.regexp_extract_all(text, pattern, F.lit(1)))


def _windows(text: Column, least: Column, most: Column) -> Column:
    """For every position with ``least`` characters left, the up to ``most`` characters from there on."""
    return F.regexp_extract_all(text, F.concat(
        F.lit("(?s)(?=(.{"), least.cast("string"), F.lit(","), most.cast("string"), F.lit("}))")), F.lit(1))


def texts_with_substring(ids: DataFrame, texts: DataFrame, id_column: str, text_column: str,
                         text_key: str) -> DataFrame:
    """Pairs (id, text key) where the text literally contains the id, anywhere.

    The heads of the ids, their first characters up to the length of the shortest id, are an index: a text gives one row
    per position, which carries the characters that an id starting there could have, and a position whose head
    starts no id is dropped at once. The others are cut to the lengths that the ids of this head have, and these are
    equi-joined to the ids. The work is the length of the texts, whatever the number of ids and lengths. Empty ids are left out.
    """
    wanted = ids.select(id_column).filter(F.length(id_column) > 0).distinct()
    bounds = wanted.agg(F.min(F.length(id_column)).alias("least"), F.max(F.length(id_column)).alias("most"))
    least, most = bounds.select("least").scalar(), bounds.select("most").scalar()
    heads = (wanted.groupBy(F.substring(F.col(id_column), F.lit(1), least).alias("_head"))
             .agg(F.collect_set(F.length(id_column)).alias("_sizes")))

    pieces = texts.select(text_key, F.explode(_pieces(F.col(text_column), most)).alias("_piece"))
    places = pieces.select(text_key, F.explode(F.array_distinct(_windows(F.col("_piece"), least, most))).alias("_ahead"))
    places = places.withColumn("_head", F.substring(F.col("_ahead"), F.lit(1), least))
    started = probe(places, heads, "_head").select(text_key, "_ahead", F.explode("_sizes").alias("_size"))
    tokens = (started.filter(F.length("_ahead") >= F.col("_size"))
              .select(text_key, F.substring(F.col("_ahead"), F.lit(1), F.col("_size")).alias(id_column)))
    return probe(tokens, wanted, id_column).select(id_column, text_key).distinct()


def texts_with_token(ids: DataFrame, texts: DataFrame, id_column: str, text_column: str,
                     text_key: str) -> DataFrame:
    """Pairs (id, text key) where the id is a whole alphanumeric token of the text.

    Cheaper than the substring form, and equal to it only when ids are always
    written as whole tokens.
    """
    wanted = complete(ids.select(id_column), id_column).distinct()
    words = F.array_distinct(F.regexp_extract_all(F.col(text_column), F.lit("([A-Za-z0-9]+)"), F.lit(1)))
    tokens = texts.select(text_key, F.explode(words).alias(id_column))
    return probe(tokens, wanted, id_column).select(id_column, text_key)


def like_pattern(column: str) -> str:
    """SQL of the pattern that finds an id anywhere; ``%`` and ``_`` in it are wildcards, a backslash is itself."""
    return f"concat('%', replace(`{column}`, '\\\\', '\\\\\\\\'), '%')"


def longest_fragment(column: str) -> Column:
    """The longest stretch of an id without wildcards, the first of equally long ones."""
    return F.expr(f"aggregate(split(`{column}`, '[%_]'), '', (best, x) -> IF(length(x) > length(best), x, best))")


def texts_like(ids: DataFrame, texts: DataFrame, id_column: str, text_column: str, text_key: str) -> DataFrame:
    """Pairs (id, text key) where the text contains the id with ``%`` (any characters) and ``_`` (any one) as wildcards.

    Every text that matches contains the id's longest literal fragment, so the fragments are searched like ids, and only
    the texts that they find are compared with the whole pattern. Ids that share a fragment share the search.
    Ids without a literal character are left out, as empty ids are.
    """
    wanted = (ids.select(id_column).filter(F.length(longest_fragment(id_column)) > 0).distinct()
              .withColumn("_fragment", longest_fragment(id_column)))
    found = texts_with_substring(wanted, texts, "_fragment", text_column, text_key)
    named = probe(found, wanted.groupBy("_fragment").agg(F.collect_set(id_column).alias("_ids")), "_fragment")
    contents = texts.groupBy(text_key).agg(F.min(text_column).alias("_content"))
    pairs = probe(named.select(text_key, F.explode("_ids").alias(id_column)), contents, text_key)
    return pairs.filter(F.expr(f"`_content` LIKE {like_pattern(id_column)}")).select(id_column, text_key).distinct()
