"""Queries of the general training-data operators (problems 1, 3, 4, 5 and 6)."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lunario.functions.cleaning import canonical_name
from lunario.operators.feature_store import FeatureStore
from lunario.operators.grid import regular_grid
from lunario.operators.hotkeys import heavy_keys, per_key
from lunario.operators.rolling import rolling_totals
from lunario.operators.timestamps import normalise
from lunario.session import shared_path, stable_path
from lunario.sources.tables import table

CLIENT, TIME, AMOUNT = "ID_BIC_CLIENTE", "DATA_TRANSAZIONE", "IMPORTO"
GRID_ORIGIN_US = 1_672_617_600_000_000  # 2023-01-02 00:00:00
MAX_GAP = 3


def _between(df: DataFrame, first: str, end: str) -> DataFrame:
    return df.where(f"{TIME} >= timestamp_ntz'{first} 00:00:00' and {TIME} < timestamp_ntz'{end} 00:00:00'")


def _grid(spark: SparkSession, d: str) -> DataFrame:
    readings = _between(table(spark, d, "timed_transactions"), "2023-01-02", "2024-12-30")
    return regular_grid(
        readings, table(spark, d, "series_steps"), source=CLIENT, time=TIME, value=AMOUNT, step_hours="passo_ore", origin_us=GRID_ORIGIN_US, max_gap=MAX_GAP
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Periods without a reading between a client's first and last period with one."""
    return _grid(spark, d).where("stato <> 'letto'").select(CLIENT, F.col("inizio").cast("string").alias("periodo_inizio"))


def p1_grid(spark: SparkSession, d: str) -> DataFrame:
    """The whole grid with values in cents, carried values and marks."""
    g = _grid(spark, d)
    whole = lambda c: F.round(F.col(c) * 100).cast("bigint").alias(c)
    return g.select(CLIENT, "periodo", "inizio", "n_letture", whole("totale"), whole("minimo"), whole("massimo"), whole("riportato"), "stato")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Clients that hold at least a hundredth of all rows."""
    return heavy_keys(table(spark, d, "client_transactions"), CLIENT, AMOUNT, (1, 100)).select(CLIENT)


def p3_per_key(spark: SparkSession, d: str) -> DataFrame:
    """Row count, distinct amounts, mode, median and 90th percentile of every client."""
    return per_key(table(spark, d, "client_transactions"), CLIENT, AMOUNT, per_thousand=(500, 900))


# The canonical categories as their names are made, first part and second parts ("" for none).
CATEGORIES = {
    "abbonamenti": "annuale base estero mensile online premium urgenze", "alimentari": "accessori annuale mensile premium servizi",
    "animali": "accessori annuale base mensile premium servizi", "assicurazioni": "accessori annuale estero mensile online premium urgenze",
    "auto": "accessori annuale base mensile online premium servizi", "bellezza": "base estero mensile online servizi urgenze",
    "casa": "accessori annuale base mensile online premium servizi urgenze", "contanti": "accessori annuale mensile premium servizi urgenze",
    "cultura": "accessori base estero online servizi", "donazioni": "accessori annuale estero mensile online premium servizi urgenze",
    "famiglia": "accessori annuale mensile premium urgenze", "imposte": "accessori annuale base estero mensile premium servizi urgenze",
    "investimenti": "annuale estero mensile premium urgenze", "istruzione": "base estero online servizi urgenze",
    "professionisti": "accessori annuale base estero online premium servizi urgenze", "ristoranti": "accessori annuale base online premium servizi",
    "salute": "annuale estero mensile online premium urgenze", "shopping": "base estero mensile online urgenze",
    "sport": "accessori base estero mensile online premium servizi urgenze", "tecnologia": "accessori annuale base estero online premium servizi",
    "tempo_libero": "accessori base estero online premium servizi urgenze", "trasporti": "accessori annuale estero mensile premium servizi urgenze",
    "utenze": "annuale base estero mensile online urgenze", "viaggi": "accessori annuale base estero mensile online servizi urgenze",
}
KINDS = [(f"{c}__{'carta' if b else 'altro'}", (c, b)) for c in sorted(f"{a}_{x}".rstrip("_") for a, xs in CATEGORIES.items() for x in ["", *xs.split()]) for b in (True, False)]


def _store(spark: SparkSession, d: str, path: str) -> tuple[FeatureStore, DataFrame]:
    events = table(spark, d, "client_transactions", "ID_TRANSAZIONE", CLIENT, TIME, AMOUNT, "CA_CATEGORY_LIV0", "IS_CARTA")
    types = {"categoria": canonical_name(F.col("CA_CATEGORY_LIV0")), "carta": F.col("IS_CARTA")}
    return FeatureStore(path, CLIENT, TIME, AMOUNT, types, event_id="ID_TRANSAZIONE"), events


def p4_features(spark: SparkSession, d: str) -> DataFrame:
    """One row per client: count, last date and total of every pair of category and IS_CARTA, from a store built anew."""
    store, events = _store(spark, d, shared_path(spark, "p4-parziali"))
    store.refresh(events)
    return store.feature_table(store.merged(events), KINDS)


def p4_refresh(spark: SparkSession, d: str) -> DataFrame:
    """The buckets of a store that first got the events before 2024-04, then all: rows counted, and whether the second run computed them again."""
    store, events = _store(spark, d, shared_path(spark, "p4-ripresa"))
    store.refresh(events.where(f"{TIME} < timestamp_ntz'2024-04-01 00:00:00'"))
    again = store.refresh(events)
    return store.partials(spark).groupBy("secchio").agg(F.sum("n").alias("n")).withColumn("rifatto", F.col("secchio").isin(again))


def p4_window(spark: SparkSession, d: str) -> DataFrame:
    """The same per client and pair over 2023-11-10 up to 2024-02-10 06:00: whole months from partials, the edges from events."""
    store, events = _store(spark, d, stable_path(spark, "p4-finestra", d, 1))  # kept from call to call
    store.refresh(events)
    m = store.merged(events, dt.datetime(2023, 11, 10), dt.datetime(2024, 2, 10, 6))
    return m.select(F.col("entita").alias(CLIENT), "categoria", "carta", "n", "ultimo", "centesimi")


def _rolling(spark: SparkSession, d: str, **how) -> DataFrame:
    rows = _between(table(spark, d, "client_transactions", "ID_TRANSAZIONE", CLIENT, TIME, AMOUNT), "2023-07-01", "2024-07-01")
    return rolling_totals(rows, entity=CLIENT, time=TIME, amount=AMOUNT, event_id="ID_TRANSAZIONE", widths=(7, 30), **how)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Days on which the trailing 7 days total more than the trailing 30."""
    r = _rolling(spark, d, measures=("cents",), emit=lambda x: x["cents_7"] > x["cents_30"])
    return r.select(CLIENT, F.date_format("giorno", "yyyy-MM-dd").alias("giorno"))


def p5_rolling(spark: SparkSession, d: str) -> DataFrame:
    """Every client and day: counts, totals, averages per event and per day, and the greatest amount."""
    r = _rolling(spark, d)
    out = [F.col(CLIENT), F.col("giorno")]
    for w in (7, 30):
        n, c = F.col(f"n_{w}"), F.col(f"cents_{w}")
        out += [n, (c / 100).alias(f"totale_{w}"), (c / 100 / w).alias(f"media_giorno_{w}"), (c / 100 / F.nullif(n, F.lit(0))).alias(f"media_{w}"), (F.col(f"most_{w}") / 100).alias(f"massimo_{w}")]
    return r.select(*out)


def _normalised(spark: SparkSession, d: str) -> DataFrame:
    columns = [TIME, "bucket_start", "bucket_end"]
    rows = table(spark, d, "bucketed_raw", "ID_RIGA", *columns, "ID_CANALE")
    return normalise(rows, columns, table(spark, d, "channels"), row="ID_RIGA", source="ID_CANALE", zone="fuso", order="ordine_data")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Every value that names exactly one instant, with that instant."""
    return _normalised(spark, d).where("esito = 'ok'").select("ID_RIGA", "campo", "istante_us")


def p6_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Every value with its instant in UTC or the reason why it has none."""
    n = _normalised(spark, d)
    return n.select("ID_RIGA", "campo", F.timestamp_add("MICROSECOND", "istante_us", F.expr("timestamp_ntz'1970-01-01 00:00:00'")).cast("timestamp_ntz").alias("istante"), "esito")


QUERIES = {f.__name__: f for f in (p1_found, p1_grid, p3_found, p3_per_key, p4_features, p4_window, p4_refresh, p5_found, p5_rolling, p6_found, p6_outcomes)}

_READINGS = """
r AS (SELECT t.ID_BIC_CLIENTE, s.passo_ore, epoch_us(t.DATA_TRANSAZIONE) AS us, t.IMPORTO AS v,
        CAST((epoch_us(t.DATA_TRANSAZIONE) - 1672617600000000) // (CAST(s.passo_ore AS BIGINT) * 3600000000) AS BIGINT) AS p
      FROM timed_transactions t JOIN series_steps s USING (ID_BIC_CLIENTE)
      WHERE t.DATA_TRANSAZIONE >= TIMESTAMP '2023-01-02' AND t.DATA_TRANSAZIONE < TIMESTAMP '2024-12-30'
        AND t.IMPORTO IS NOT NULL AND NOT isnan(t.IMPORTO)),
k AS (SELECT ID_BIC_CLIENTE, passo_ore, p, count(*) n, sum(v) s, min(v) lo, max(v) hi, arg_max(v, (us, v)) l FROM r GROUP BY ALL),
b AS (SELECT ID_BIC_CLIENTE, passo_ore, min(p) p0, max(p) p1 FROM k GROUP BY ALL),
g AS (SELECT ID_BIC_CLIENTE, passo_ore, unnest(generate_series(p0, p1)) AS p FROM b),
f AS (SELECT g.ID_BIC_CLIENTE, g.passo_ore, g.p, k.n, k.s, k.lo, k.hi,
        last_value(CASE WHEN k.n IS NOT NULL THEN g.p END IGNORE NULLS) OVER w AS sp, last_value(k.l IGNORE NULLS) OVER w AS sv
      FROM g LEFT JOIN k ON g.ID_BIC_CLIENTE = k.ID_BIC_CLIENTE AND g.p = k.p
      WINDOW w AS (PARTITION BY g.ID_BIC_CLIENTE ORDER BY g.p))"""
_START = "make_timestamp(1672617600000000 + p * passo_ore * 3600000000)"
_ONCE = """
e AS (SELECT ID_TRANSAZIONE, min(ID_BIC_CLIENTE) id, min(CAST(DATA_TRANSAZIONE AS DATE)) g, min(CAST(round(IMPORTO * 100) AS BIGINT)) c
      FROM client_transactions
      WHERE ID_BIC_CLIENTE IS NOT NULL AND IMPORTO IS NOT NULL AND NOT isnan(IMPORTO)
        AND DATA_TRANSAZIONE >= TIMESTAMP '2023-07-01' AND DATA_TRANSAZIONE < TIMESTAMP '2024-07-01' GROUP BY 1),
d AS (SELECT id, g, count(*) n, sum(c) c, max(c) m FROM e GROUP BY ALL),
b AS (SELECT id, min(g) g0, max(g) g1 FROM d GROUP BY id),
a AS (SELECT id, CAST(unnest(generate_series(g0, g1, INTERVAL 1 DAY)) AS DATE) AS g FROM b),
j AS (SELECT a.id, a.g, coalesce(d.n, 0) n, coalesce(d.c, 0) c, d.m FROM a LEFT JOIN d USING (id, g)),
x AS (SELECT id, g, CAST(sum(n) OVER w7 AS BIGINT) n7, CAST(sum(n) OVER w30 AS BIGINT) n30, CAST(sum(c) OVER w7 AS BIGINT) c7,
        CAST(sum(c) OVER w30 AS BIGINT) c30, max(m) OVER w7 m7, max(m) OVER w30 m30 FROM j
      WINDOW w7 AS (PARTITION BY id ORDER BY g ROWS 6 PRECEDING), w30 AS (PARTITION BY id ORDER BY g ROWS 29 PRECEDING))"""
_CANON = r"nullif(regexp_replace(lower(regexp_replace(CA_CATEGORY_LIV0, '^\s+|\s+$', '', 'g')), '[\s_-]+', '_', 'g'), '')"
_EVENTS = f"""
e AS (SELECT ID_TRANSAZIONE, min(ID_BIC_CLIENTE) id, min({_CANON}) categoria, min(IS_CARTA) carta, min(DATA_TRANSAZIONE) t,
        min(CASE WHEN NOT isnan(IMPORTO) THEN CAST(round(IMPORTO * 100) AS BIGINT) END) c
      FROM client_transactions WHERE ID_BIC_CLIENTE IS NOT NULL GROUP BY 1)"""


def _features(name: str, where: str = "true") -> str:
    f = f"FILTER (WHERE {where})"
    return f'count(*) {f} AS "{name}n", CAST(max(t) {f} AS DATE) AS "{name}ultimo", coalesce(sum(c) {f}, 0) / 100 AS "{name}totale"'


SQL = {
    "p1_found": f"WITH {_READINGS} SELECT ID_BIC_CLIENTE, strftime({_START}, '%Y-%m-%d %H:%M:%S') AS periodo_inizio FROM f WHERE n IS NULL",
    "p1_grid": f"""WITH {_READINGS} SELECT ID_BIC_CLIENTE, p AS periodo, {_START} AS inizio, coalesce(n, 0) AS n_letture,
        CAST(round(s * 100) AS BIGINT) AS totale, CAST(round(lo * 100) AS BIGINT) AS minimo, CAST(round(hi * 100) AS BIGINT) AS massimo,
        CASE WHEN n IS NULL AND p - sp <= {MAX_GAP} THEN CAST(round(sv * 100) AS BIGINT) END AS riportato,
        CASE WHEN n IS NOT NULL THEN 'letto' WHEN p - sp <= {MAX_GAP} THEN 'riportato' ELSE 'mancante' END AS stato FROM f""",
    "p3_found": """SELECT ID_BIC_CLIENTE FROM client_transactions WHERE ID_BIC_CLIENTE IS NOT NULL GROUP BY 1
        HAVING count(*) * 100 >= (SELECT count(*) FROM client_transactions)""",
    "p3_per_key": """WITH c AS (SELECT ID_BIC_CLIENTE k, IMPORTO v, count(*) w FROM client_transactions GROUP BY ALL),
        o AS (SELECT *, sum(w) OVER (PARTITION BY k ORDER BY v) cum, sum(w) OVER (PARTITION BY k) n,
                row_number() OVER (PARTITION BY k ORDER BY w DESC, v) r FROM c WHERE v IS NOT NULL AND NOT isnan(v)),
        s AS (SELECT k, CAST(max(n) AS BIGINT) nv, count(*) nd, max(v) FILTER (r = 1) moda, max(w) FILTER (r = 1) n_moda,
                min(v) FILTER (cum >= (n * 500 + 999) // 1000) p500, min(v) FILTER (cum >= (n * 900 + 999) // 1000) p900 FROM o GROUP BY k)
        SELECT c.k AS ID_BIC_CLIENTE, c.n AS n_righe, coalesce(s.nv, 0) AS n_valori, coalesce(s.nd, 0) AS n_distinti, s.moda, s.n_moda, s.p500, s.p900
        FROM (SELECT k, CAST(sum(w) AS BIGINT) n FROM c GROUP BY k) c LEFT JOIN s ON c.k IS NOT DISTINCT FROM s.k""",
    "p4_window": f"""WITH {_EVENTS} SELECT id AS ID_BIC_CLIENTE, categoria, carta, count(*) AS n, max(t) AS ultimo, CAST(sum(c) AS BIGINT) AS centesimi
        FROM e WHERE t >= TIMESTAMP '2023-11-10' AND t < TIMESTAMP '2024-02-10 06:00:00' GROUP BY 1, 2, 3""",
    "p4_features": f"WITH {_EVENTS} SELECT id AS ID_BIC_CLIENTE, {_features('')}, " + ", ".join(_features(f"{n}__", f"categoria = '{c}' AND {'' if b else 'NOT '}carta") for n, (c, b) in KINDS) + " FROM e GROUP BY id",
    "p4_refresh": f"""SELECT coalesce(strftime(DATA_TRANSAZIONE, '%Y-%m'), 'senza-data') AS secchio, count(DISTINCT (ID_TRANSAZIONE, {_CANON}, IS_CARTA)) AS n,
        coalesce(max(DATA_TRANSAZIONE) >= TIMESTAMP '2024-04-01', true) AS rifatto FROM client_transactions WHERE ID_BIC_CLIENTE IS NOT NULL GROUP BY 1""",
    "p5_found": f"WITH {_ONCE} SELECT id AS ID_BIC_CLIENTE, strftime(g, '%Y-%m-%d') AS giorno FROM x WHERE c7 > c30",
    "p5_rolling": f"""WITH {_ONCE} SELECT id AS ID_BIC_CLIENTE, g AS giorno,
        n7 AS n_7, c7 / 100 AS totale_7, c7 / 100 / 7 AS media_giorno_7, c7 / 100 / nullif(n7, 0) AS media_7, m7 / 100 AS massimo_7,
        n30 AS n_30, c30 / 100 AS totale_30, c30 / 100 / 30 AS media_giorno_30, c30 / 100 / nullif(n30, 0) AS media_30, m30 / 100 AS massimo_30
        FROM x""",
}
