"""Search over elements: token overlap, cosine, and the best candidate for an invocation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

TOP_K = 10


def by_tokens(rows: DataFrame, query: str, id_col: str, text_col: str, k: int = TOP_K) -> DataFrame:
    """The k rows that share most tokens with the query; ties by id."""
    wanted = list(dict.fromkeys(_tokens(query)))
    score = F.size(F.filter(T.search_tokens(F.col(text_col)), lambda t: t.isin(*wanted)))
    return rows.select(F.col(id_col).alias("id"), score.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(k)


def by_vector(rows: DataFrame, query: Sequence[float], id_col: str, vector_col: str, k: int = TOP_K) -> DataFrame:
    """The k rows of greatest cosine; ties by id."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return rows.select(F.col(id_col).alias("id"), T.cosine(F.col(vector_col), q).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def verify_invocation(elements: DataFrame, invocations: DataFrame) -> DataFrame:
    """(invocation, matched, element_id, confidence): the element of that id, else the best candidate, else none.

    A candidate's score is how many of its tokens the invocation has, repeats included; the greatest score wins,
    then the first id; confidence is the score over the invocation's tokens. Only pairs that share a token meet.
    """
    exact = elements.select(F.col("id").alias("exact_id")).distinct()
    asked = invocations.select("invocation").distinct().join(exact, F.col("invocation") == F.col("exact_id"), "left")
    known = asked.where(F.col("exact_id").isNotNull()).select("invocation", F.lit(True).alias("matched"), F.col("exact_id").alias("element_id"), F.lit(1.0).alias("confidence"))
    fuzzy = asked.where(F.col("exact_id").isNull()).select("invocation", T.search_tokens(F.col("invocation")).alias("q"))
    own = elements.select(F.col("id").alias("element_id"), F.explode(T.search_tokens(F.col("id"))).alias("token"))
    own = own.groupBy("token", "element_id").agg(F.count(F.lit(1)).alias("times"))
    wanted = fuzzy.select("invocation", F.explode(F.array_distinct("q")).alias("token"))
    scored = wanted.join(own, "token").groupBy("invocation", "element_id").agg(F.sum("times").alias("score"))
    best = scored.groupBy("invocation").agg(F.min_by("element_id", F.struct(-F.col("score"), F.col("element_id"))).alias("element_id"), F.max("score").alias("score"))
    rest = fuzzy.join(best, "invocation", "left").select("invocation", F.lit(False).alias("matched"), "element_id", (F.col("score") / F.size("q")).alias("confidence"))
    return known.unionByName(rest)


def _tokens(s: str) -> list[str]:
    import re

    return [t for t in re.split(T.SEARCH_SEPARATORS, s.lower()) if t]
