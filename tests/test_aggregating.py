import pytest

from lunario.functions.naming import aggregate_name, plain_name
from lunario.functions.predicates import AndGroup, Filter, OrGroup
from lunario.operators.aggregating import Aggregating, Aggregation, Pivot

IDS, EDGES = ["ID_BIC_CLIENTE"], ["bucket_start", "bucket_end"]
CAT, CARD = "CA_CATEGORY_LIV0", "IS_CARTA"
KEYS = [(348272371, 1), (348272371, 6), (234984832, 1), (234984832, 2)]


def run(df, *aggregations):
    out = Aggregating(IDS, EDGES, list(aggregations))(df)
    rows = {(r["ID_BIC_CLIENTE"], r["bucket_start"].day): r for r in out.collect()}
    assert set(rows) == set(KEYS)
    return {c: [rows[k][c] for k in KEYS] for c in out.columns if c not in IDS + EDGES}


N = None
GOLDENS = [
    (Aggregation("IMPORTO", "sum"), {"sum(IMPORTO)": [213, 1354, 1298, 22]}),
    (
        Aggregation("IMPORTO", "sum", pivot=Pivot(CAT)),
        {f"sum(IMPORTO)_where_{CAT}=salute": [61, N, 1298, N], f"sum(IMPORTO)_where_{CAT}=shopping": [55, 1354, N, N], f"sum(IMPORTO)_where_{CAT}=trasporti": [97, N, N, 22]},
    ),
    (Aggregation("IMPORTO", "sum", pivot=Pivot(CAT, "=", ["salute"])), {f"sum(IMPORTO)_where_{CAT}=salute": [61, N, 1298, N]}),
    (Aggregation("IMPORTO", "sum", pivot=Pivot(CARD)), {f"sum(IMPORTO)_where_{CARD}=True": [70, 430, 515, 22], f"sum(IMPORTO)_where_{CARD}=False": [143, 924, 783, N]}),
    (
        Aggregation("IMPORTO", "sum", [Filter(CAT, "in", ["salute", "trasporti"]), Filter(CARD, "=", True)]),
        {f"sum(IMPORTO)_where_{CAT}[salute_trasporti]&{CARD}=True": [15, N, 515, 22]},
    ),
    (Aggregation("IMPORTO", "sum", [Filter(CAT, "=", "salute"), Filter(CARD, "=", True)]), {f"sum(IMPORTO)_where_{CAT}=salute&{CARD}=True": [N, N, 515, N]}),
    (Aggregation("IMPORTO", "count", [Filter(CAT, "=", "salute")]), {f"count(IMPORTO)_where_{CAT}=salute": [1, 0, 3, 0]}),
    (Aggregation("IMPORTO", "count", pivot=Pivot(CAT, "=", ["salute"])), {f"count(IMPORTO)_where_{CAT}=salute": [1, N, 3, N]}),
]


@pytest.mark.parametrize("k", range(len(GOLDENS)))
def test_goldens(bucketed, k):
    aggregation, expected = GOLDENS[k]
    assert run(bucketed, aggregation) == expected


def test_many_at_once_share_one_pass(bucketed):
    got = run(bucketed, *[a for a, _ in GOLDENS[:1] + GOLDENS[3:7]])
    for _, expected in GOLDENS[:1] + GOLDENS[3:7]:
        for name, values in expected.items():
            assert got[name] == values


def test_groups_and_negations(bucketed):
    either = OrGroup([AndGroup([Filter(CAT, "=", "salute"), Filter("IMPORTO", ">", 100)]), Filter("IMPORTO", "<=", 22)])
    got = run(bucketed, Aggregation("IMPORTO", "sum", [either]), Aggregation("IMPORTO", "max", [Filter(CAT, "notin", ["salute"])]))
    assert got[f"sum(IMPORTO)_where_(({CAT}=salute&IMPORTO>100)|IMPORTO<=22)"] == [15, None, 1298, 22]
    assert got[f"max(IMPORTO)_where_{CAT}[salute]"] == [82, 722, None, 22]


def test_null_values_and_keys(spark):
    df = spark.sql("select * from values (null, 1, 'a'), (null, null, null), (1, 2, null) t(k, v, c)").selectExpr("*", "timestamp_ntz'2023-01-01 00:00:00' s")
    out = Aggregating(["k"], ["s"], [Aggregation("v", "sum", [Filter("c", "!=", "b")]), Aggregation("v", "count", pivot=Pivot("c"))])(df)
    rows = {r["k"]: r for r in out.collect()}
    assert set(rows) == {None, 1} and rows[None]["sum(v)_where_c!=b"] == 1 and rows[1]["sum(v)_where_c!=b"] is None
    assert rows[None]["count(v)_where_c=None"] == 0 and rows[1]["count(v)_where_c=None"] == 1 and rows[1]["count(v)_where_c=a"] is None


@pytest.mark.parametrize(
    ("make", "message"),
    [
        (lambda: Aggregation("wrong", "sum"), "Column wrong is not a column"),
        (lambda: Aggregation(CAT, "sum"), f"Column {CAT} is not a numeric column"),
        (lambda: Aggregation("IMPORTO", "sum", [Filter("wrong", "=", 1)]), "Column wrong is not a column"),
        (lambda: Aggregation("IMPORTO", "sum", [Filter(CARD, "=", 1)]), f"Mismatch types between {CARD} column"),
        (lambda: Aggregation("IMPORTO", "median"), "Aggregation function not allowed"),
        (lambda: Filter(CAT, "~", 1), "Operator not allowed"),
        (lambda: Filter(CAT, "<", "x"), "needs a number"),
        (lambda: Filter(CAT, "in", "x"), "needs a list"),
        (lambda: AndGroup([]), "at least one"),
        (lambda: [Aggregation("IMPORTO", "sum", [Filter(CAT, o, ["a"])]) for o in ("in", "notin")], "more than once"),
    ],
)
def test_errors(bucketed, make, message):
    with pytest.raises(ValueError, match=message):
        made = make()
        run(bucketed, *(made if isinstance(made, list) else [made]))


def test_names():
    assert aggregate_name("sum", "x", "f", ("c", 1, None)) == "sum(x)_where_f_c=1"
    assert aggregate_name("sum", "x", "f", ("c", 1, "p_PIVOTVALUE"), "FUNCTION-PIVOT") == "sum-p_1"
    assert aggregate_name("sum", "x", "", ("c", 1, None), "somma_PIVOTVALUE") == "somma_1"
    assert aggregate_name("sum", "x", "", ("c", 1, "n"), "somma") == "somma_n1"
    assert plain_name('agg1__q_0.0__(1, 2)__"a"') == "agg1__q_0dot0__[1_2]__a"
