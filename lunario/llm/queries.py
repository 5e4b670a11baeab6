"""Queries of the corpus operators (problems 2, 7, 8 and 9)."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lunario.functions.cleaning import canonical_name
from lunario.llm import mixing, percentiles
from lunario.llm.residue import residue
from lunario.llm.tokenize import decode, encode
from lunario.sources.tables import table

#: Where the public vocabularies lie; a parameter of every operator.
VOCABULARIES = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")
BYTE_BPE = f"{VOCABULARIES}/byte_bpe_50k.json"
RELATIVE_ERROR = 0.001
PER_THOUSAND = (10, 50, 250, 500, 750, 950, 990)


def _states(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "client_transactions", "CA_CATEGORY_LIV0", "IMPORTO", "DATA_TRANSAZIONE")
    group = [canonical_name(F.col("CA_CATEGORY_LIV0")).alias("categoria"), F.to_date("DATA_TRANSAZIONE").alias("giorno")]
    return percentiles.state(rows, group, F.col("IMPORTO"), RELATIVE_ERROR)


def p2_states(spark: SparkSession, d: str) -> DataFrame:
    """The state of each category and day: how often each representative amount occurs."""
    return _states(spark, d).select("categoria", "giorno", F.round("valore", 6).alias("valore"), "n")


def p2_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of each category over all days, from the combined states of the days."""
    p = percentiles.percentiles(percentiles.combine([_states(spark, d)], "categoria"), "categoria", PER_THOUSAND, RELATIVE_ERROR)
    return p.select("categoria", "n", *[F.round(f"p{k:03d}", 6).alias(f"p{k:03d}") for k in PER_THOUSAND], "errore")


def p7_ids(spark: SparkSession, d: str) -> DataFrame:
    """The token ids of every text."""
    return encode(table(spark, d, "documents", "doc_id", "text"), "text", BYTE_BPE)


def p7_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its number of tokens and whether decoding its ids gives the text back."""
    encoded = encode(table(spark, d, "documents", "doc_id", "text").withColumn("prima", F.coalesce("text", F.lit(""))), "text", BYTE_BPE)
    back = decode(encoded.withColumn("n_token", F.size("ids")), "ids", BYTE_BPE)
    return back.select("doc_id", "n_token", (F.col("testo") == F.col("prima")).alias("uguale"))


def _mix(spark: SparkSession, d: str):
    documents = table(spark, d, "documents", "doc_id", "source", "text")
    return mixing.mix(documents, table(spark, d, "mix_targets"), doc="doc_id", text="text", source="source", share="target_share", repeats="max_repeats", path=BYTE_BPE)


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mix: a row per slot with its block of tokens."""
    return _mix(spark, d)[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source."""
    return _mix(spark, d)[1]


def _residue(spark: SparkSession, d: str) -> DataFrame:
    return residue(table(spark, d, "documents", "doc_id", "source", "text"), doc="doc_id", text="text", host="source")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with template residue, filler, an error page or a script notice."""
    return _residue(spark, d).select("doc_id")


def p9_kinds(spark: SparkSession, d: str) -> DataFrame:
    """The same documents with the kinds of evidence found in them."""
    return _residue(spark, d)


QUERIES = {f.__name__: f for f in (p2_states, p2_percentiles, p7_ids, p7_round_trip, p8_mix, p8_shares, p9_found, p9_kinds)}

_BASE = f"CAST({1 + RELATIVE_ERROR} AS DOUBLE) / {1 - RELATIVE_ERROR}"
_STATE = rf"""
r AS (SELECT nullif(regexp_replace(lower(regexp_replace(CA_CATEGORY_LIV0, '^\s+|\s+$', '', 'g')), '[\s_-]+', '_', 'g'), '') AS categoria,
        CAST(DATA_TRANSAZIONE AS DATE) AS giorno, IMPORTO AS v FROM client_transactions WHERE IMPORTO IS NOT NULL AND NOT isnan(IMPORTO)),
s AS (SELECT categoria, giorno, CASE WHEN v = 0 THEN 0 ELSE sign(v) * (2 / (1 + {_BASE})) * pow({_BASE}, ceil(ln(abs(v)) / ln({_BASE}))) END AS valore FROM r)"""
_RANKS = ", ".join(f"round(min(valore) FILTER (cum >= greatest(1, (n * {k} + 999) // 1000)), 6) AS p{k:03d}" for k in PER_THOUSAND)
SQL = {
    "p2_states": f"WITH {_STATE} SELECT categoria, giorno, round(valore, 6) AS valore, count(*) AS n FROM s GROUP BY ALL",
    "p2_percentiles": f"""WITH {_STATE}, c AS (SELECT categoria, valore, count(*) w FROM s GROUP BY ALL),
        o AS (SELECT *, sum(w) OVER (PARTITION BY categoria ORDER BY valore) cum, sum(w) OVER (PARTITION BY categoria) n FROM c)
        SELECT categoria, CAST(max(n) AS BIGINT) AS n, {_RANKS}, CAST({RELATIVE_ERROR} AS DOUBLE) AS errore FROM o GROUP BY categoria""",
}
