import datetime as dt
import random
from collections import Counter, defaultdict
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lunario.operators import timestamps
from lunario.operators.feature_store import FeatureStore
from lunario.operators.grid import regular_grid
from lunario.operators.hotkeys import heavy_keys, per_key
from lunario.operators.rolling import MAX, MIN, SUM, rolling_totals, two_stack
from lunario.operators.timestamps import normalise

ORIGIN = dt.datetime(2023, 1, 2)
ORIGIN_US = 1_672_617_600_000_000


def grid(spark, readings, steps, **how):
    r = spark.createDataFrame(readings, "id bigint, t timestamp_ntz, v double, periodo string")
    s = spark.createDataFrame(steps, "id bigint, ore int")
    return regular_grid(r, s, source="id", time="t", value="v", step_hours="ore", origin_us=ORIGIN_US, **how)


@pytest.mark.parametrize("block", [1, 2, 3, 7, 1024])
def test_grid_against_plain_python(spark, block):
    rng, readings = random.Random(block), []
    for k in range(120):
        t = ORIGIN + dt.timedelta(hours=rng.choice([rng.randint(-50, 60), rng.randint(0, 900)]), minutes=rng.randint(0, 59))
        readings.append((rng.choice([1, 1, 1, 2, 3, None]), rng.choice([t, t, t, None]), rng.choice([float(k), float(k), None, float("nan")]), "x"))
    steps = [(1, 6), (2, 24), (4, 1), (None, 3), (3, 0)]
    got = {(r["id"], r["periodo"]): r for r in grid(spark, readings, steps, max_gap=2, block=block).collect()}
    known = defaultdict(list)
    for i, t, v, _ in readings:
        if i in (1, 2) and t and v is not None and v == v:
            known[i, (t - ORIGIN) // dt.timedelta(hours=dict(steps)[i])].append((t, v))
    expected = {}
    for i in (1, 2):
        periods = [p for j, p in known if j == i]
        last = None
        for p in range(min(periods), max(periods) + 1):
            here = sorted(known.get((i, p), []))
            if here:
                last = (p, here[-1][1])
                expected[i, p] = ("letto", len(here), here[-1][1], None)
            elif p - last[0] <= 2:
                expected[i, p] = ("riportato", 0, None, last[1])
            else:
                expected[i, p] = ("mancante", 0, None, None)
    assert {k: (r["stato"], r["n_letture"], r["ultimo"], r["riportato"]) for k, r in got.items()} == expected
    assert all(r["inizio"] == ORIGIN + dt.timedelta(hours=dict(steps)[k[0]] * k[1]) for k, r in got.items())


def test_grid_of_nothing(spark):
    assert grid(spark, [], [(1, 6)]).count() == 0
    assert grid(spark, [(1, ORIGIN, 1.0, "")], []).count() == 0


def test_per_key(spark):
    rows = [(1, 5.0)] * 50 + [(1, 2.0)] * 50 + [(1, float(k)) for k in range(100, 120)] + [(2, None), (2, float("nan")), (None, 1.0), (3, -7.5), (3, -7.5), (3, 0.0)]
    df = spark.createDataFrame(rows, "k int, v double").withColumn("key", F.lit("clash")).withColumn("weight", F.lit(9))
    got = {r["k"]: r for r in per_key(df, "k", "v", per_thousand=(1, 500, 900, 1000)).collect()}
    for k in (1, 3, None):
        v = sorted(x for j, x in rows if j == k)
        at = lambda p, v=v: v[max(1, -(-len(v) * p // 1000)) - 1]
        top = max(Counter(v).items(), key=lambda c: (c[1], -c[0]))
        assert [got[k][f"p{p:03d}"] for p in (1, 500, 900, 1000)] == [at(p) for p in (1, 500, 900, 1000)]
        assert (got[k]["n_righe"], got[k]["n_distinti"], got[k]["moda"], got[k]["n_moda"]) == (len(v), len(set(v)), *top)
    assert got[2]["n_righe"] == 2 and got[2]["n_valori"] == 0 and got[2]["moda"] is None and got[2]["p500"] is None
    assert sorted(r["k"] for r in heavy_keys(df, "k", "v", (2, 126)).collect()) == [1, 2, 3]
    assert heavy_keys(df.where("false"), "k", "v").count() == 0


def test_one_key_with_most_of_the_distinct_values(spark):
    rng = random.Random(8)
    rows = [(rng.choice([7] * 18 + [1, 2]), rng.lognormvariate(2, 1)) for _ in range(20_000)] + [(None, 3.5)] * 5 + [(k, float(k)) for k in range(100, 400)]
    df = spark.createDataFrame(rows, "k int, v double")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so few rows would be one range
    try:
        out = per_key(df, "k", "v", per_thousand=(1, 250, 500, 999, 1000))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    got = {r["k"]: r for r in out.collect()}
    for k in (7, 1, 2, None, 100, 399):
        v = sorted(x for j, x in rows if j == k)
        assert [got[k][f"p{p:03d}"] for p in (1, 250, 500, 999, 1000)] == [v[max(1, -(-len(v) * p // 1000)) - 1] for p in (1, 250, 500, 999, 1000)]
    kept = spark.read.parquet(*[f for f in out.inputFiles() if "frequenze" in f])
    assert kept.where("_g = 7").select("_part").distinct().count() > 1  # the large key lies in several tasks
    assert len(got) == len({k for k, _ in rows})


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(-100, 100), max_size=80), st.integers(1, 12))
def test_two_stack_queue(values, width):
    x = np.array(values, np.int64)
    for monoid, plain in ((SUM, sum), (MAX, max), (MIN, min)):
        assert two_stack(x, width, monoid).tolist() == [plain(values[max(0, i - width + 1) : i + 1]) for i in range(len(values))]


def test_rolling_against_plain_python(spark):
    rng, rows, day0 = random.Random(4), [], dt.datetime(2024, 2, 20)
    for k in range(300):
        rows.append((k, rng.choice([1, 1, 1, 2, 3, None]), day0 + dt.timedelta(days=rng.choice([rng.randint(0, 40), 200]), hours=rng.randint(0, 23)), rng.choice([k / 100, -k / 10, None, float("nan")])))
    rows += rows[:40] + [(None, 2, day0, 1.25), (None, 2, day0, 1.25), (900, 9, None, 1.0)]
    df = spark.createDataFrame(rows, "e bigint, id bigint, t timestamp_ntz, v double").withColumn("giorno", F.lit(1))
    got = {(r["id"], r["giorno"]): r for r in rolling_totals(df, entity="id", time="t", amount="v", event_id="e", widths=(7, 30), measures=("n", "cents", "most", "least")).collect()}
    by, seen = defaultdict(list), set()
    for e, i, t, v in rows:
        if i is None or t is None or v is None or v != v or e in seen:
            continue
        seen |= {e} - {None}
        by[i, t.date()].append(round(v * 100))
    assert by
    n = 0
    for i in (1, 2, 3):
        days = [d for j, d in by if j == i]
        d = min(days)
        while d <= max(days):
            n += 1
            for w in (7, 30):
                c = [x for k in range(w) for x in by.get((i, d - dt.timedelta(days=k)), [])]
                r = got[i, d]
                assert (r[f"n_{w}"], r[f"cents_{w}"], r[f"most_{w}"], r[f"least_{w}"]) == (len(c), sum(c), max(c, default=None), min(c, default=None))
            d += dt.timedelta(days=1)
    assert n == len(got)
    few = rolling_totals(df, entity="id", time="t", amount="v", event_id="e", measures=("cents",), emit=lambda x: x["cents_7"] > x["cents_30"])
    assert {(r["id"], r["giorno"]) for r in few.collect()} == {k for k, r in got.items() if r["cents_7"] > r["cents_30"]}
    assert rolling_totals(df.where("false"), entity="id", time="t", amount="v").count() == 0


def _us(text, zone, fold=0):
    t = dt.datetime.fromisoformat(text).replace(tzinfo=ZoneInfo(zone), fold=fold)
    return round(t.timestamp() * 1_000_000)


ROME, NY = "Europe/Rome", "America/New_York"
TEXTS = [
    ("2023-07-01 10:00:00", 1, "ok", _us("2023-07-01T10:00:00", ROME)), (" 2023-07-01T10:00 ", 1, "ok", _us("2023-07-01T10:00:00", ROME)), ("2023-07-01", 1, "ok", _us("2023-07-01", ROME)),
    ("2023-03-26 02:30:00", 1, "inesistente", None), ("2023-10-29 02:30:00", 1, "ambiguo", None), ("2023-10-29 02:30:00 CEST", 1, "ok", _us("2023-10-29T02:30:00", ROME, 0)), ("2023-10-29 02:30:00 CET", 1, "ok", _us("2023-10-29T02:30:00", ROME, 1)),
    ("2023-10-29 01:59:59.999999", 1, "ok", _us("2023-10-29T01:59:59.999999", ROME)), ("2023-10-29 03:00:00", 1, "ok", _us("2023-10-29T03:00:00", ROME)), ("2023-03-26 03:00:00", 1, "ok", _us("2023-03-26T03:00:00", ROME)),
    ("03/04/2023 11:00", 1, "ok", _us("2023-04-03T11:00", ROME)), ("03/04/2023 11:00", 2, "ok", _us("2023-03-04T11:00", NY)), ("13/04/2023 11:00", 2, "illeggibile", None), ("3-4-23 1:02:03 pm", 2, "ok", _us("2023-03-04T13:02:03", NY)),
    ("3/4/2023 12:00:00 am", 1, "ok", _us("2023-04-03T00:00", ROME)), ("3/4/2023 13:00:00 am", 1, "illeggibile", None), ("26.12.2022 07.08.09", 1, "ok", _us("2022-12-26T07:08:09", ROME)), ("5 mag 2023 01:02:03", 1, "ok", _us("2023-05-05T01:02:03", ROME)),
    ("01-GEN-2023 00:00:00", 2, "ok", _us("2023-01-01T00:00", NY)), ("Sun, 01 Jan 2023 22:39:33 +0100", 2, "ok", _us("2023-01-01T21:39:33", "UTC")), ("Mon, 01 Jan 2023 22:39:33 +0100", 2, "illeggibile", None),
    ("2023-01-01t19:59:37z", 1, "ok", _us("2023-01-01T19:59:37", "UTC")), ("20230102T145400Z", 1, "ok", _us("2023-01-02T14:54", "UTC")), ("20230102145400", 1, "ok", _us("2023-01-02T14:54", ROME)), ("20230102", 1, "ok", _us("2023-01-02", ROME)),
    ("2023-01-02T20:35:51.123456789Z", 1, "ok", _us("2023-01-02T20:35:51.123456", "UTC")), ("2023-01-02 20:35:51,5", 1, "ok", _us("2023-01-02T20:35:51.5", ROME)), ("2023-01-01 09:36 GMT+01:00", 2, "ok", _us("2023-01-01T08:36", "UTC")), ("2023-01-01T17:53+09", 1, "ok", _us("2023-01-01T08:53", "UTC")),
    ("2023-01-06T12:10:16.000-05:00[America/New_York]", 1, "ok", _us("2023-01-06T17:10:16", "UTC")), ("1672548534", 1, "ok", 1672548534_000_000), ("1672548534000", 1, "ok", 1672548534_000_000), ("1672548534000001", 1, "ok", 1672548534_000_001),
    ("2023-02-29T08:30:00Z", 1, "illeggibile", None), ("2023-11-08T27:10:00", 1, "illeggibile", None), ("0000-00-00 00:00:00", 1, "illeggibile", None), ("2024-06", 1, "illeggibile", None), ("12:40:05", 1, "illeggibile", None), ("ieri sera", 1, "illeggibile", None),
    ("", 1, "illeggibile", None), ("x" * 100_000, 1, "illeggibile", None), (None, 1, "nullo", None), ("2023-07-01 10:00:00", 9, "senza_zona", None), ("2023-07-01 10:00:00Z", None, "ok", _us("2023-07-01T10:00", "UTC")), ("2023-07-01 10:00:00 XYZ", 1, "illeggibile", None),
    ("2024-11-03 01:30:00", 2, "ambiguo", None), ("2024-11-03 01:30:00 EST", 2, "ok", _us("2024-11-03T01:30", NY, 1)), ("29/02/2024 23:59:59", 1, "ok", _us("2024-02-29T23:59:59", ROME)),
    ("2023-01-06T12:10:16[Atlantis/Deep]", 1, "illeggibile", None), ("2023-01-06  12:10:16.25\t[Asia/Tokyo]", 1, "ok", _us("2023-01-06T12:10:16.25", "Asia/Tokyo")), ("\u00012023-01-06", 1, "illeggibile", None),
]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_timestamps(spark, monkeypatch):
    rows = [(k, t, c) for k, (t, c, _, _) in enumerate(TEXTS)]
    df = spark.createDataFrame(rows, "id int, testo string, canale int").withColumn("zone", F.lit("clash"))
    src = spark.createDataFrame([(1, ROME, "DMY"), (2, NY, "MDY")], "canale int, fuso string, ordine string")
    got = {r["id"]: (r["esito"], r["istante_us"]) for r in normalise(df, ["testo"], src, row="id", source="canale", zone="fuso", order="ordine").collect()}
    assert {TEXTS[k][0] if k else TEXTS[0][0]: v for k, v in got.items() if v != TEXTS[k][2:]} == {}
    few = normalise(df, ["testo"], src, row="id", source="canale", zone="fuso", order="ordine")
    assert "BroadcastHashJoin" in _plan(few) and "hashpartitioning(_src" not in _plan(few) and "SortMergeJoin" not in _plan(few)
    monkeypatch.setattr(timestamps, "MOST_SOURCES", 1)  # more sources than are sent: the salted join gives the same
    many = normalise(df, ["testo"], src, row="id", source="canale", zone="fuso", order="ordine")
    assert many.exceptAll(few).count() == 0 and few.exceptAll(many).count() == 0
    assert normalise(df.where("false"), ["testo"], src, row="id", source="canale", zone="fuso", order="ordine").count() == 0


def _store(path):
    return FeatureStore(str(path), "id", "t", "v", {"tipo": F.col("tipo"), "carta": F.col("carta")}, event_id="e")


def _plain(rows, since=None, until=None):
    out, seen = {}, set()
    for e, i, t, v, tipo, carta in rows:
        if i is None or (e is not None and e in seen) or ((since or until) and (t is None or t < since or t >= until)):
            continue
        seen |= {e} - {None}
        n, last, c = out.get((i, tipo, carta), (0, None, None))
        cents = None if v is None or v != v else round(v * 100)
        out[i, tipo, carta] = (n + 1, max(filter(None, (last, t)), default=None), c if cents is None else (c or 0) + cents)
    return out


def test_feature_store(spark, tmp_path):
    rng, day0 = random.Random(1), dt.datetime(2023, 1, 1)
    rows = []
    for k in range(400):
        rows.append((rng.choice([k, k, None]), rng.choice([1, 1, 2, None]), rng.choice([day0 + dt.timedelta(hours=rng.randint(0, 4000)), None]), rng.choice([k / 4, None, float("nan")]), rng.choice(["a", "b", None]), rng.choice([True, False, None])))
    rows += [r for r in rows[:50] if r[0] is not None]
    ddl = "e bigint, id bigint, t timestamp_ntz, v double, tipo string, carta boolean"
    store, df = _store(tmp_path), spark.createDataFrame(rows, ddl).withColumn("n", F.lit("clash"))
    merged = lambda d, *w: {(r["entita"], r["tipo"], r["carta"]): (r["n"], r["ultimo"], r["centesimi"]) for r in store.merged(d, *w).collect()}
    assert len(store.refresh(df)) == 7 and store.refresh(df) == []
    assert merged(df) == _plain(rows)
    window = dt.datetime(2023, 2, 10), dt.datetime(2023, 5, 3, 7)
    assert merged(df, *window) == _plain(rows, *window)
    late = [*rows, (9999, 2, dt.datetime(2023, 3, 5), 1.0, "a", True)]
    more = spark.createDataFrame(late, ddl).withColumn("n", F.lit("clash"))
    assert store.refresh(more) == ["2023-03"] and merged(more) == _plain(late)
    kinds = [("a__carta", ("a", True)), ("z__altro", ("z", False))]
    wide = {r["id"]: r for r in store.feature_table(store.merged(more), kinds).collect()}
    n, last, c = _plain(late)[1, "a", True]
    assert (wide[1]["a__carta__n"], wide[1]["a__carta__ultimo"], wide[1]["a__carta__totale"]) == (n, last and last.date(), (c or 0) / 100)
    assert (wide[2]["z__altro__n"], wide[2]["z__altro__ultimo"], wide[2]["z__altro__totale"]) == (0, None, 0) and set(wide) == {1, 2}
    empty = more.where("false")
    assert len(store.refresh(empty)) == 7 and store.merged(empty).count() == 0
