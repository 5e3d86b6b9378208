"""Feature construction and selection."""

from itertools import combinations, combinations_with_replacement

from pyspark.sql import functions as F

from ..operators.construct import interaction, polynomial
from ..operators.select import chi2, f_classif, f_regression, mutual_information, ranked_features, select_kbest
from ..plans.preprocess import engineer_features
from .base import Tables, query, rounded

LINE = "l_orderkey, l_partkey, l_suppkey, l_linenumber"
INPUTS = ("l_quantity", "l_discount", "l_tax")


def _poly_sql() -> str:
    terms = [f'{c} AS "{c}"' for c in INPUTS]
    for a, b in combinations_with_replacement(INPUTS, 2):
        name = f"{a}^2" if a == b else f"{a} {b}"
        terms.append(f'round({a} * {b}, 6) AS "{name}"')
    return f"SELECT l_returnflag, {', '.join(terms)} FROM lineitem"


@query("feat_polynomial", _poly_sql())
def feat_polynomial(t: Tables):
    return rounded(polynomial(t.lineitem.select(*INPUTS, "l_returnflag")), 6)


@query(
    "feat_interaction",
    "SELECT l_returnflag, "
    + ", ".join(f"{c}" for c in INPUTS)
    + ", "
    + ", ".join(f'round({a} * {b}, 6) AS "{a}_x_{b}"' for a, b in combinations(INPUTS, 2))
    + " FROM lineitem",
)
def feat_interaction(t: Tables):
    return rounded(interaction(t.lineitem.select(*INPUTS, "l_returnflag")), 6)


FEATURES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber")


def f_classif_sql(source: str, features: tuple[str, ...], target: str) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, (SELECT (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(w) / (sum(n) - count(*)))
            FROM (SELECT count(*) AS n, avg({c}) AS m, var_pop({c}) * count(*) AS w FROM {source} GROUP BY {target}),
                 (SELECT avg({c}) AS g FROM {source})) AS score"""
        for c in features
    )


@query(
    "select_kbest_f",
    f"SELECT feature, round(score, 4) AS score FROM ({f_classif_sql('lineitem', FEATURES, 'l_returnflag')})",
)
def select_kbest_f(t: Tables):
    return rounded(f_classif(t.lineitem, FEATURES, "l_returnflag"))


@query(
    "select_kbest_f_regression",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, round(r * r / (1 - r * r) * (n - 2), 2) AS score
            FROM (SELECT corr({c}, l_extendedprice) AS r, count(*) AS n FROM lineitem)"""
        for c in INPUTS
    ),
)
def select_kbest_f_regression(t: Tables):
    return rounded(f_regression(t.lineitem, INPUTS, "l_extendedprice"), 2)


def _chi2_sql() -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS feature, round((SELECT sum((o - t * n / a) * (o - t * n / a) / (t * n / a)) FROM
            (SELECT sum({c}) AS o, count(*) AS n FROM lineitem GROUP BY l_returnflag),
            (SELECT sum({c}) AS t, count(*) AS a FROM lineitem)), 4) AS score"""
        for c in FEATURES
    )


@query("select_kbest_chi2", _chi2_sql())
def select_kbest_chi2(t: Tables):
    return rounded(chi2(t.lineitem, FEATURES, "l_returnflag"))


def mi_sql(source: str, features: tuple[str, ...], target: str, bins: int = 10) -> str:
    parts = []
    for c in features:
        cuts = ", ".join(f"quantile_cont({c}, {i / bins}) AS e{i}" for i in range(1, bins))
        # equal cut points count once, so compare with the distinct ones
        index = f"len(list_filter(list_distinct([{', '.join(f'e{i}' for i in range(1, bins))}]), lambda x: {c} > x))"
        parts.append(
            f"""SELECT '{c}' AS feature, (
            WITH b AS (SELECT {index} AS b, {target} AS y FROM {source}, (SELECT {cuts} FROM {source})),
            j AS (SELECT b, y, count(*) AS n FROM b GROUP BY b, y), m AS (SELECT b, count(*) AS n FROM b GROUP BY b),
            k AS (SELECT y, count(*) AS n FROM b GROUP BY y), a AS (SELECT count(*) AS n FROM b)
            SELECT sum(1.0 * j.n / a.n * ln(1.0 * j.n * a.n / (m.n * k.n))) FROM j JOIN m ON j.b = m.b JOIN k ON j.y = k.y, a
            ) AS score"""
        )
    return " UNION ALL ".join(parts)


MI_SQL = mi_sql("lineitem", FEATURES, "l_returnflag")


@query("select_kbest_mi", f"SELECT feature, round(score, 8) AS score FROM ({MI_SQL})")
def select_kbest_mi(t: Tables):
    return rounded(mutual_information(t.lineitem, FEATURES, "l_returnflag"), 8)


RANKED_SQL = f"""SELECT feature, round(score, 4) AS score, row_number() OVER (ORDER BY score DESC, feature) AS rank,
    row_number() OVER (ORDER BY score DESC, feature) <= 3 AS selected
    FROM ({f_classif_sql('lineitem', FEATURES, 'l_linestatus')})"""


@query("feature_selection", RANKED_SQL)
def feature_selection(t: Tables):
    df = t.lineitem.select(*FEATURES, "l_linestatus")
    return rounded(ranked_features(df, "l_linestatus", "f_score", 3))


@query(
    "select_kbest",
    f"""WITH s AS (SELECT feature FROM ({f_classif_sql('lineitem', FEATURES, 'l_linestatus')}) ORDER BY score DESC, feature LIMIT 3)
        SELECT feature AS "column", round(CASE feature
          WHEN 'l_quantity' THEN (SELECT sum(l_quantity) FROM lineitem)
          WHEN 'l_extendedprice' THEN (SELECT sum(l_extendedprice) FROM lineitem)
          WHEN 'l_discount' THEN (SELECT sum(l_discount) FROM lineitem)
          WHEN 'l_tax' THEN (SELECT sum(l_tax) FROM lineitem)
          ELSE (SELECT sum(l_linenumber) FROM lineitem) END, 2) AS total FROM s""",
)
def select_kbest_query(t: Tables):
    kept = select_kbest(t.lineitem.select(*FEATURES, "l_linestatus"), "l_linestatus", "f_score", 3)
    names = [c for c in kept.columns if c != "l_linestatus"]
    cells = [F.struct(F.lit(c).alias("column"), F.round(F.sum(F.col(c).cast("double")), 2).alias("total")) for c in names]
    return kept.agg(F.array(*cells).alias("x")).select(F.explode("x").alias("x")).select("x.*")


@query("engineer_features")
def engineer_features_query(t: Tables):
    df = t.orders.select("o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    table, _ = engineer_features(df, "o_totalprice", polynomial_degree=2, interactions=False, max_features=4)
    return rounded(table)
