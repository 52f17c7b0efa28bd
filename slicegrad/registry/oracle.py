"""The registered queries as plain SQL over the given tables.

Training is unrolled into common table expressions over long tables: ``m<t>(feature, k, w)`` is the model
before iteration ``t``, ``b<t>`` the cells of its batch, ``s<t>`` the statistics per slot, ``g<t>`` the
gradient. Every iteration is written out in SQL, independent of the wide rows the jobs use.
"""

from __future__ import annotations

import math

from slicegrad.registry.datasets import (
    CLICK_BUCKETS,
    CLICK_FEATURES,
    CUSTOMER_OFFSET,
    EMBEDDING_CLASSES,
    EMBEDDING_SIZE,
    EVENT_FEATURES,
    EVENT_TYPES,
)

SEED, EVAL_SEED = 42, 100_000
REG, STEP = 0.01, 0.5
ITERATIONS = 4
BATCH_SHARE = 20
SAMPLE_SHARE, RESAMPLE_RATE = 0.1, 1.5


def rounded(expression: str, digits: int = 6) -> str:
    return f"round(CAST({expression} AS DOUBLE), {digits}) + 0.0"


def word(key: str, position: int = 0) -> str:
    """A 32-bit word of the md5 of a key expression."""
    return f"CAST(('0x' || substr(md5({key}), {1 + 8 * position}, 8)) AS BIGINT)"


def drawn(key: str) -> str:
    """A 62-bit number of two words."""
    return f"({word(key)} * {2**30} + {word(key, 1)} % {2**30})"


def unit(key: str) -> str:
    return f"(CAST({word(key)} AS DOUBLE) / 4294967296.0::DOUBLE)"


def poisson(mean: float, key: str) -> str:
    """Copies of a row: one per step of the Poisson distribution function that its uniform number reaches."""
    parts, step = [], 0.0
    for k in range(40):
        step += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        parts.append(f"CASE WHEN {unit(key)} >= {step!r}::DOUBLE THEN 1 ELSE 0 END")
    return " + ".join(parts)


def signed(key: str) -> str:
    w = word(key)
    return f"CASE WHEN {w} >= 2147483648 THEN {w} - 4294967296 ELSE {w} END"


def gauss(key: str, scale: float = 0.01) -> str:
    u = [f"(({word(key, p)} + 1.0::DOUBLE) / 4294967297.0::DOUBLE)" for p in (0, 1)]
    return f"({scale!r}::DOUBLE * sqrt(-2.0::DOUBLE * ln({u[0]})) * cos(2.0::DOUBLE * pi() * {u[1]}))"


LOG1PEXP = "CASE WHEN ({0}) > 0 THEN ({0}) + ln(1 + exp(-({0}))) ELSE ln(1 + exp({0})) END"

# ---------------------------------------------------------------------------------------------- data

_CLASS = "CASE event_type " + " ".join(f"WHEN '{n}' THEN {i}" for i, n in enumerate(EVENT_TYPES)) + " END"


def event_cells(multiclass: bool = False) -> str:
    label = _CLASS if multiclass else "CASE WHEN event_type = 'error' THEN 1 ELSE 0 END"
    return f"""
pts AS (SELECT event_id AS rid, CAST({label} AS DOUBLE) AS label, value, user_id, ts FROM events),
cells AS (
  SELECT rid, label, 0 AS feature, value / 100 AS x FROM pts
  UNION ALL SELECT rid, label, CAST(user_id % 50 + 1 AS INTEGER), 1.0::DOUBLE FROM pts
  UNION ALL SELECT rid, label, CAST(hour(ts) + 51 AS INTEGER), 1.0::DOUBLE FROM pts)"""


EMBEDDING_CELLS = """
pts AS (SELECT vec_id AS rid, CAST(label AS DOUBLE) AS label, embedding FROM embeddings),
cells AS (
  SELECT rid, label, CAST(p - 1 AS INTEGER) AS feature, CAST(embedding[p] AS DOUBLE) AS x
  FROM (SELECT rid, label, embedding, unnest(range(1, len(embedding) + 1)) AS p FROM pts))"""

_CLICK_INTEGERS = {
    1: "CAST(floor(o_totalprice / 100000) AS INTEGER)",
    2: "CASE WHEN o_custkey % 7 <> 0 THEN CAST(o_custkey % 5 - 2 AS INTEGER) END",
    3: "CAST(day(o_orderdate) % 4 AS INTEGER)",
}
_CLICK_CATEGORIES = {
    1: "CAST(o_custkey AS VARCHAR)",
    2: "o_orderstatus",
    3: "CASE WHEN o_custkey % 3 <> 0 THEN CAST(year(o_orderdate) AS VARCHAR) END",
    26: "CAST(month(o_orderdate) AS VARCHAR)",
}
_URGENT = "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END"


def _click_cells(row_id: str = "o_orderkey") -> str:
    integers = " UNION ALL ".join(
        f"SELECT rid, label, {i - 1} AS feature, CAST(coalesce({_CLICK_INTEGERS.get(i, 'NULL')}, 0) AS DOUBLE) AS x"
        " FROM pts"
        for i in range(1, 14)
    )
    tokens = " UNION ALL ".join(
        f"SELECT rid, label, '{i - 1}:' || coalesce({_CLICK_CATEGORIES.get(i, 'NULL')}, '') AS token FROM pts"
        for i in range(1, 27)
    )
    return f"""
pts AS (SELECT {row_id} AS rid, CAST({_URGENT} AS DOUBLE) AS label, * FROM orders),
tokens AS ({tokens}),
hashed AS (SELECT rid, label, {signed('token')} AS h FROM tokens),
cells AS (
  {integers}
  UNION ALL
  SELECT rid, label, CAST(abs(h) % {CLICK_BUCKETS} + 13 AS INTEGER),
         CAST(sum(CASE WHEN h >= 0 THEN 1 ELSE -1 END) AS DOUBLE)
  FROM hashed GROUP BY rid, label, abs(h) % {CLICK_BUCKETS}
  HAVING sum(CASE WHEN h >= 0 THEN 1 ELSE -1 END) <> 0)"""


CLICK_CELLS = _click_cells()

EDGES = f"""
sold AS (
  SELECT l_suppkey AS s, o_custkey + {CUSTOMER_OFFSET} AS c, l_returnflag AS flag
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
edges AS (
  SELECT s AS src, c AS dst FROM sold UNION ALL SELECT c AS src, s AS dst FROM sold WHERE flag = 'R')"""

# ------------------------------------------------------------------------------------------ training


def sizes(batch: str = f"count(*) // {BATCH_SHARE}") -> str:
    return f"sizes AS (SELECT count(*) AS n, {batch} AS b FROM pts)"


def slots(name: str, t: int, seed: int = SEED, count: str = "b") -> str:
    key = f"'{seed}:{t}:' || CAST(slot AS VARCHAR)"
    return (
        f"{name} AS MATERIALIZED (SELECT slot, {drawn(key)} % n AS rid "
        f"FROM (SELECT unnest(range({count})) AS slot, n FROM sizes))"
    )


def stats(kind: str, model: str, batch: str) -> str:
    if kind == "fm":
        return (
            f"SELECT slot, label, k, sum(w * x) - CASE WHEN k = 0 THEN max(q) ELSE 0 END AS s FROM "
            f"(SELECT * FROM {batch} JOIN {model} USING (feature)) j JOIN "
            f"(SELECT slot, 0.5::DOUBLE * sum(CASE WHEN k > 0 THEN w * x * w * x ELSE 0 END) AS q "
            f"FROM {batch} JOIN {model} USING (feature) GROUP BY slot) USING (slot) GROUP BY slot, label, k"
        )
    return f"SELECT slot, label, k, sum(w * x) AS s FROM {batch} JOIN {model} USING (feature) GROUP BY slot, label, k"


def coefficients(kind: str, table: str) -> str:
    """Per slot and position: the factor of the gradient."""
    if kind == "lr":
        return f"SELECT slot, k, -(2 * label - 1) / (1 + exp((2 * label - 1) * s)) AS c FROM {table}"
    if kind == "squares":
        return f"SELECT slot, k, s - label AS c FROM {table}"
    if kind == "svm":
        return (
            f"SELECT slot, k, CASE WHEN (2 * label - 1) * s < 1 THEN -(2 * label - 1) ELSE 0 END AS c FROM {table}"
        )
    if kind == "mlr":
        return (
            f"SELECT slot, k, exp(s - top) / sum(exp(s - top)) OVER (PARTITION BY slot) "
            f"- CASE WHEN k = label THEN 1 ELSE 0 END AS c "
            f"FROM (SELECT *, max(s) OVER (PARTITION BY slot) AS top FROM {table})"
        )
    score = f"(SELECT slot, label, {FM_SCORE} AS f FROM {table} GROUP BY slot, label)"
    return (
        f"SELECT slot, k, -(2 * label - 1) / (1 + exp((2 * label - 1) * f)) AS c, s AS sf "
        f"FROM {table} JOIN {score} USING (slot, label)"
    )


FM_SCORE = "sum(CASE WHEN k = 0 THEN s ELSE 0.5::DOUBLE * s * s END)"


def mean_loss(kind: str, table: str) -> str:
    """One row with the mean loss of a statistics table."""
    if kind == "lr":
        return f"SELECT avg({LOG1PEXP.format('-(2 * label - 1) * s')}) AS loss FROM {table}"
    if kind == "svm":
        return f"SELECT avg(greatest(0, 1 - (2 * label - 1) * s)) AS loss FROM {table}"
    if kind == "mlr":
        return (
            f"SELECT avg(l) AS loss FROM (SELECT slot, max(s) + ln(sum(exp(s - top))) "
            f"- max(CASE WHEN k = label THEN s END) AS l FROM "
            f"(SELECT *, max(s) OVER (PARTITION BY slot) AS top FROM {table}) GROUP BY slot)"
        )
    return (
        f"SELECT avg({LOG1PEXP.format('-(2 * label - 1) * f')}) AS loss "
        f"FROM (SELECT slot, label, {FM_SCORE} AS f FROM {table} GROUP BY slot, label)"
    )


def unrolled(
    kind: str, cells: str, features: int, k: int = 1, iterations: int = ITERATIONS, adam: bool = False,
    step: float = STEP, reg: float = REG,
) -> str:
    """All common table expressions of a training run; the result is ``m<iterations>``."""
    moments = ", 0.0::DOUBLE AS m, 0.0::DOUBLE AS v" if adam else ""
    start = gauss(f"'{SEED}:' || f || ':' || kk") if kind == "fm" else "0.0::DOUBLE"
    if kind == "fm":
        start = f"CASE WHEN kk = 0 THEN 0.0::DOUBLE ELSE {start} END"
    parts = [
        cells.strip(),
        sizes(),
        f"m0 AS MATERIALIZED (SELECT CAST(f AS INTEGER) AS feature, CAST(kk AS INTEGER) AS k, {start} AS w{moments} "
        f"FROM (SELECT unnest(range({features})) AS f) JOIN (SELECT unnest(range({k})) AS kk) ON true)",
    ]
    shrink, rate = f"{1 - reg!r}::DOUBLE", f"{step!r}::DOUBLE / (SELECT b FROM sizes)"
    for t in range(iterations):
        grad = "sum(c * x)"
        extra = ""
        if kind == "fm":
            grad = "sum(CASE WHEN k = 0 THEN c * x ELSE c * x * sf - c * w * x * x END)"
            extra = f" JOIN m{t} USING (feature, k)"
        parts += [
            slots(f"d{t}", t),
            f"b{t} AS MATERIALIZED (SELECT slot, label, feature, x FROM d{t} JOIN cells USING (rid))",
            f"s{t} AS MATERIALIZED ({stats(kind, f'm{t}', f'b{t}')})",
            f"c{t} AS ({coefficients(kind, f's{t}')})",
            f"g{t} AS MATERIALIZED (SELECT feature, k, {grad} AS g FROM b{t} JOIN c{t} USING (slot){extra} "
            "GROUP BY feature, k)",
        ]
        joined = f"FROM m{t} LEFT JOIN g{t} USING (feature, k)"
        if adam:
            g = "(g / (SELECT b FROM sizes))"
            parts.append(
                f"a{t} AS (SELECT feature, k, w * {shrink} AS w, m * {shrink} AS m, v * {shrink} AS v, "
                f"coalesce(g, 0) <> 0 AS moved, coalesce({g}, 0) AS g {joined})"
            )
            parts.append(
                f"u{t} AS (SELECT feature, k, w, moved, CASE WHEN moved THEN 0.9::DOUBLE * m + (1 - 0.9::DOUBLE) * g "
                f"ELSE m END AS m, CASE WHEN moved THEN 0.99::DOUBLE * v + (1 - 0.99::DOUBLE) * g * g ELSE v END AS v "
                f"FROM a{t})"
            )
            vb, mb = f"(1 - pow(0.99::DOUBLE, {t + 1}))", f"(1 - pow(0.9::DOUBLE, {t + 1}))"
            parts.append(
                f"m{t + 1} AS MATERIALIZED (SELECT feature, k, CASE WHEN moved THEN w - {step!r}::DOUBLE / "
                f"(sqrt(v / {vb}) + 1e-7::DOUBLE) * m / {mb} ELSE w END AS w, m, v FROM u{t})"
            )
        else:
            parts.append(
                f"m{t + 1} AS MATERIALIZED (SELECT feature, k, w * {shrink} - {rate} * coalesce(g, 0) AS w {joined})"
            )
    return "WITH " + ",\n".join(parts)


def trained_weights(kind: str, cells: str, features: int, k: int = 1, adam: bool = False, **settings) -> str:
    moments = f", {rounded('m')} AS m, {rounded('v')} AS v" if adam else ""
    last = settings.get("iterations", ITERATIONS)
    ctes = unrolled(kind, cells, features, k, adam=adam, **settings)
    return f"{ctes}\nSELECT feature, k, {rounded('w')} AS w{moments} FROM m{last}"


def history_sql() -> str:
    ctes = unrolled("lr", event_cells(), EVENT_FEATURES)
    valid = (
        f", {slots('dv', 0, EVAL_SEED, 'CAST(floor(n * 0.01::DOUBLE) AS BIGINT)')}, "
        "bv AS (SELECT slot, label, feature, x FROM dv JOIN cells USING (rid)), "
        f"sv AS ({stats('lr', 'm0', 'bv')})"
    )
    rows = " UNION ALL ".join(
        f"SELECT CAST({t} AS INTEGER) AS iter, {rounded('loss')} AS batch_loss, "
        + (f"(SELECT {rounded('loss')} FROM ({mean_loss('lr', 'sv')}))" if t == 0 else "NULL::DOUBLE")
        + f" AS valid_loss FROM ({mean_loss('lr', f's{t}')})"
        for t in range(ITERATIONS)
    )
    return f"{ctes}{valid}\n{rows}"


def evaluate_sql() -> str:
    ctes = unrolled("lr", event_cells(), EVENT_FEATURES)
    return (
        f"{ctes}, {slots('dv', 0, EVAL_SEED, 'CAST(floor(n * 0.5::DOUBLE) AS BIGINT)')}, "
        "bv AS (SELECT slot, label, feature, x FROM dv JOIN cells USING (rid)), "
        f"sv AS ({stats('lr', f'm{ITERATIONS}', 'bv')})\n"
        f"SELECT (SELECT count(*) FROM sv) AS n, {rounded('loss')} AS loss FROM ({mean_loss('lr', 'sv')})"
    )


def score_sql() -> str:
    ctes = unrolled("lr", event_cells(), EVENT_FEATURES)
    return (
        f"{ctes}\nSELECT rid AS row_id, label, {rounded('sum(w * x)')} AS score, "
        f"{rounded('1 / (1 + exp(-sum(w * x)))')} AS probability "
        f"FROM cells JOIN m{ITERATIONS} USING (feature) GROUP BY rid, label"
    )


def chain_sql() -> str:
    """Three models over the same points; the names of the expressions are local to each subquery."""
    parts = []
    for name, kind, k in (("lr", "lr", 1), ("svm", "svm", 1), ("fm", "fm", 5)):
        sql = trained_weights(kind, event_cells(), EVENT_FEATURES, k)
        parts.append(f"SELECT '{name}' AS model, * FROM ({sql})")
    return " UNION ALL ".join(parts)


# -------------------------------------------------------------------------------- single operators

FORMULA = "sqrt(CAST(((feature * 7 + 3 * k) % 11 + 2) AS DOUBLE)) - 2.5::DOUBLE"


def fixed_model(features: int, k: int) -> str:
    return (
        f"m AS (SELECT feature, k, {FORMULA} AS w FROM (SELECT CAST(unnest(range({features})) AS INTEGER) AS feature) "
        f"JOIN (SELECT CAST(unnest(range({k})) AS INTEGER) AS k) ON true)"
    )


def fixed_stats(kind: str, k: int, multiclass: bool = False) -> str:
    batch = "ball AS (SELECT rid AS slot, label, feature, x FROM cells)"
    return (
        f"WITH {event_cells(multiclass).strip()}, {fixed_model(EVENT_FEATURES, k)}, {batch}, "
        f"st AS MATERIALIZED ({stats(kind, 'm', 'ball')})"
    )


def stats_sql(kind: str, k: int, multiclass: bool = False) -> str:
    return f"{fixed_stats(kind, k, multiclass)}\nSELECT slot, k, {rounded('s')} AS s FROM st"


def loss_sql(kind: str, k: int, multiclass: bool = False) -> str:
    return (
        f"{fixed_stats(kind, k, multiclass)}\nSELECT (SELECT count(DISTINCT slot) FROM st) AS n, "
        f"{rounded('loss')} AS loss FROM ({mean_loss(kind, 'st')})"
    )


def grad_sql() -> str:
    return (
        f"{fixed_stats('lr', 1)}, c AS ({coefficients('lr', 'st')})\n"
        f"SELECT feature, {rounded('sum(c * x)')} AS g FROM ball JOIN c USING (slot) GROUP BY feature"
    )


def gated_unrolled(cells: str, features: int, iterations: int = ITERATIONS, step: float = STEP, reg: float = REG, adam: bool = False) -> str:
    """Training of the two-pass model; the weights are ``m<iterations>(feature, w0, w1[, and moments])``."""
    start = gauss(f"'{SEED}:' || f", 0.5)
    names = ("w0", "w1")
    moments = "".join(f", 0.0::DOUBLE AS {kind}_{n}" for n in names for kind in "mv") if adam else ""
    parts = [
        cells.strip(),
        sizes(),
        f"m0 AS MATERIALIZED (SELECT CAST(f AS INTEGER) AS feature, 0.0::DOUBLE AS w0, {start} AS w1{moments} FROM (SELECT unnest(range({features})) AS f))",
    ]
    shrink, b = f"{1 - reg!r}::DOUBLE", "(SELECT b FROM sizes)"
    for t in range(iterations):
        parts += [
            slots(f"d{t}", t),
            f"b{t} AS MATERIALIZED (SELECT slot, label, feature, x FROM d{t} JOIN cells USING (rid))",
            *gated_forward(f"b{t}", f"m{t}", str(t)),
            f"c{t} AS (SELECT slot, pull, CASE WHEN label > 0 THEN -1 / (1 + exp(s)) ELSE 1 / (1 + exp(-s)) END AS c FROM z{t})",
            f"g{t} AS MATERIALIZED (SELECT feature, sum(c * x * gate) AS g0, sum(c * (w0 * x * x * gate * (1 - gate) - pull * x)) AS g1 "
            f"FROM q{t} JOIN c{t} USING (slot) GROUP BY feature)",
        ]
        changed = []
        for n, g in zip(names, ("g0", "g1")):
            if not adam:
                changed.append(f"{n} * {shrink} - {step!r}::DOUBLE / {b} * coalesce({g}, 0) AS {n}")
                continue
            moved, share = f"coalesce({g}, 0) <> 0", f"({g} / {b})"
            m = f"(CASE WHEN {moved} THEN 0.9::DOUBLE * m_{n} * {shrink} + (1 - 0.9::DOUBLE) * {share} ELSE m_{n} * {shrink} END)"
            v = f"(CASE WHEN {moved} THEN 0.99::DOUBLE * v_{n} * {shrink} + (1 - 0.99::DOUBLE) * {share} * {share} ELSE v_{n} * {shrink} END)"
            rates = [f"(1 - pow({beta}::DOUBLE, {t + 1}))" for beta in (0.9, 0.99)]
            new = f"{n} * {shrink} - {step!r}::DOUBLE / (sqrt({v} / {rates[1]}) + 1e-7::DOUBLE) * {m} / {rates[0]}"
            changed += [f"CASE WHEN {moved} THEN {new} ELSE {n} * {shrink} END AS {n}", f"{m} AS m_{n}", f"{v} AS v_{n}"]
        parts.append(f"m{t + 1} AS MATERIALIZED (SELECT feature, {', '.join(changed)} FROM m{t} LEFT JOIN g{t} USING (feature))")
    return "WITH " + ",\n".join(parts)


def gated_forward(batch: str, model: str, tag: str) -> list[str]:
    return [
        f"l{tag} AS MATERIALIZED (SELECT slot, sum(w1 * x) AS level FROM {batch} JOIN {model} USING (feature) GROUP BY slot)",
        f"q{tag} AS MATERIALIZED (SELECT slot, label, feature, x, w0, 1 / (1 + exp(level - w1 * x)) AS gate "
        f"FROM {batch} JOIN {model} USING (feature) JOIN l{tag} USING (slot))",
        f"z{tag} AS MATERIALIZED (SELECT slot, max(label) AS label, sum(w0 * x * gate) AS s, sum(w0 * x * gate * (1 - gate)) AS pull "
        f"FROM q{tag} GROUP BY slot)",
    ]


def gated_weights(cells: str, features: int, adam: bool = False, **settings) -> str:
    rows = []
    for k in (0, 1):
        columns = [f"{rounded(c)} AS {n}" for c, n in ((f"w{k}", "w"), (f"m_w{k}", "m"), (f"v_w{k}", "v"))[: 3 if adam else 1]]
        rows.append(f"SELECT feature, {k} AS k, {', '.join(columns)} FROM m{ITERATIONS}")
    return gated_unrolled(cells, features, adam=adam, **settings) + "\n" + " UNION ALL ".join(rows)


def gated_scores() -> str:
    every = ["ball AS (SELECT rid AS slot, label, feature, x FROM cells)", *gated_forward("ball", f"m{ITERATIONS}", "all")]
    return (
        ",\n".join([gated_unrolled(CLICK_CELLS, CLICK_FEATURES, step=0.1), *every])
        + f"\nSELECT slot AS row_id, label, {rounded('s')} AS score FROM zall"
    )


def pagerank_ctes(rounds: int) -> str:
    parts = [
        EDGES.strip(),
        "pairs AS (SELECT src, dst, count(*) AS n FROM edges GROUP BY src, dst)",
        "shares AS MATERIALIZED (SELECT src, dst, n / sum(n) OVER (PARTITION BY src) AS share FROM pairs)",
        "r0 AS MATERIALIZED (SELECT id, 0.15::DOUBLE AS rank, 0.15::DOUBLE AS delta FROM "
        "(SELECT src AS id FROM edges UNION SELECT dst FROM edges))",
    ]
    for t in range(rounds):
        parts.append(
            f"p{t} AS (SELECT dst AS id, 0.85::DOUBLE * sum(delta * share) AS change FROM shares "
            f"JOIN r{t} ON src = r{t}.id WHERE abs(delta) > 0.001::DOUBLE GROUP BY dst)"
        )
        parts.append(
            f"r{t + 1} AS MATERIALIZED (SELECT r{t}.id, rank + coalesce(change, 0) AS rank, "
            f"coalesce(change, 0) AS delta FROM r{t} LEFT JOIN p{t} ON r{t}.id = p{t}.id)"
        )
    last = f"r{rounds}"
    parts.append(f"ranks AS (SELECT id, rank * (SELECT count(*) / sum(rank) FROM {last}) AS rank FROM {last})")
    return "WITH " + ",\n".join(parts)


# ------------------------------------------------------------------------------------- perceptron

MLP_HIDDEN, MLP_ITERATIONS = 4, 2


def mlp_unrolled(iterations: int = MLP_ITERATIONS, step: float = STEP) -> str:
    def start(layer: int, rows: int, columns: int) -> str:
        key = f"'{SEED}:{layer}:' || i || ':' || j"
        return (
            f"SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {gauss(key)} AS w FROM "
            f"(SELECT unnest(range({rows})) AS i) JOIN (SELECT unnest(range({columns})) AS j) ON true"
        )

    parts = [
        EMBEDDING_CELLS.strip(),
        sizes("count(*) // 5"),
        f"u0 AS MATERIALIZED ({start(0, EMBEDDING_SIZE, MLP_HIDDEN)})",
        f"v0 AS MATERIALIZED ({start(1, MLP_HIDDEN, EMBEDDING_CLASSES)})",
    ]
    rate = f"{step!r}::DOUBLE / (SELECT b FROM sizes)"
    for t in range(iterations):
        parts += mlp_forward_ctes(t) + [
            f"e{t} AS MATERIALIZED (SELECT slot, k, p - CASE WHEN k = label THEN 1 ELSE 0 END AS d FROM p{t})",
            f"f{t} AS MATERIALIZED (SELECT h.slot, h.j, sum(v.w * e.d) * max(h.a) * (1 - max(h.a)) AS d FROM h{t} h "
            f"JOIN v{t} v ON v.i = h.j JOIN e{t} e ON e.slot = h.slot AND e.k = v.j GROUP BY h.slot, h.j)",
            f"x{t} AS (SELECT h.j AS i, e.k AS j, sum(h.a * e.d) AS g FROM h{t} h JOIN e{t} e USING (slot) "
            "GROUP BY h.j, e.k)",
            f"y{t} AS (SELECT b.feature AS i, f.j, sum(b.x * f.d) AS g FROM b{t} b JOIN f{t} f USING (slot) "
            "GROUP BY b.feature, f.j)",
            f"u{t + 1} AS MATERIALIZED (SELECT i, j, w - {rate} * coalesce(g, 0) AS w FROM u{t} LEFT JOIN y{t} "
            "USING (i, j))",
            f"v{t + 1} AS MATERIALIZED (SELECT i, j, w - {rate} * coalesce(g, 0) AS w FROM v{t} LEFT JOIN x{t} "
            "USING (i, j))",
        ]
    return "WITH " + ",\n".join(parts)


def mlp_forward_ctes(t: int, tag: str = "", rows: str | None = None) -> list[str]:
    """Draw and forward pass with the weights of iteration ``t``; ``tag`` names a second set, over the drawn ``rows``."""
    d, b, h, z, p = (f"{name}{tag}{t}" for name in "dbhzp")
    return [
        f"{d} AS (SELECT * FROM {rows})" if rows else slots(d, t),
        f"{b} AS MATERIALIZED (SELECT slot, label, feature, x FROM {d} JOIN cells USING (rid))",
        f"{h} AS MATERIALIZED (SELECT slot, label, j, 1 / (1 + exp(-sum(w * x))) AS a FROM {b} "
        f"JOIN u{t} ON i = feature GROUP BY slot, label, j)",
        f"{z} AS MATERIALIZED (SELECT slot, label, v.j AS k, sum(a * w) AS z FROM {h} h JOIN v{t} v ON v.i = h.j "
        "GROUP BY slot, label, v.j)",
        f"{p} AS MATERIALIZED (SELECT slot, label, k, exp(z) / sum(exp(z)) OVER (PARTITION BY slot) AS p FROM {z})",
    ]


def mlp_all_rows() -> str:
    """Forward pass of the initial network over all rows."""
    parts = [
        EMBEDDING_CELLS.strip(),
        "b0 AS (SELECT rid AS slot, label, feature, x FROM cells)",
    ]
    full = mlp_unrolled(0)[len("WITH "):]
    start = full[full.index("u0 AS MATERIALIZED"):]
    return "WITH " + ",\n".join(parts + [start] + mlp_forward_ctes(0)[2:])


def history_mlp_sql() -> str:
    """The sampled rows pass through the network before each iteration."""
    valid, rows = [slots("drawn", 0, EVAL_SEED, "CAST(floor(n * 0.5::DOUBLE) AS BIGINT)")], []
    own = "max(CASE WHEN k = label THEN p END)"
    for t in range(MLP_ITERATIONS):
        valid += mlp_forward_ctes(t, "v", "drawn")
        loss = f"SELECT avg(-ln(own)) FROM (SELECT slot, {own} AS own FROM pv{t} GROUP BY slot)"
        rows.append(
            f"SELECT CAST({t} AS INTEGER) AS iter, {rounded('avg(-ln(own))')} AS batch_loss, {rounded(f'({loss})')} AS valid_loss, "
            f"{rounded('avg(CASE WHEN own >= top THEN 1.0 ELSE 0.0 END)')} AS accuracy "
            f"FROM (SELECT slot, {own} AS own, max(p) AS top FROM p{t} GROUP BY slot)"
        )
    return ",\n".join([mlp_unrolled(), *valid]) + "\n" + " UNION ALL ".join(rows)


def layers_unrolled(
    cells: str, sizes_of: list[int], batch: int, iterations: int = MLP_ITERATIONS, step: float = STEP, reg: float = 0.0, adam: bool = False
) -> str:
    """A perceptron with the layers ``sizes_of``, from inputs to classes; the weights of layer ``l`` are ``w<iterations>_<l>``."""
    last, moments = len(sizes_of) - 2, ", 0.0::DOUBLE AS m, 0.0::DOUBLE AS v" if adam else ""
    parts = [cells.strip(), sizes(f"count(*) // {batch}")]
    for layer, (rows, columns) in enumerate(zip(sizes_of, sizes_of[1:])):
        key = f"'{SEED}:{layer}:' || i || ':' || j"
        parts.append(
            f"w0_{layer} AS MATERIALIZED (SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {gauss(key)} AS w{moments} FROM "
            f"(SELECT unnest(range({rows})) AS i) JOIN (SELECT unnest(range({columns})) AS j) ON true)"
        )
    b, shrink = "(SELECT b FROM sizes)", f"{1 - reg!r}::DOUBLE"
    for t in range(iterations):
        parts += [
            slots(f"d{t}", t),
            f"b{t} AS MATERIALIZED (SELECT slot, label, feature, x FROM d{t} JOIN cells USING (rid))",
            f"a{t}_0 AS MATERIALIZED (SELECT slot, label, j, 1 / (1 + exp(-sum(w * x))) AS a FROM b{t} JOIN w{t}_0 ON i = feature "
            "GROUP BY slot, label, j)",
        ]
        for layer in range(1, last + 1):
            act = "sum(a * w)" if layer == last else "1 / (1 + exp(-sum(a * w)))"
            parts.append(
                f"a{t}_{layer} AS MATERIALIZED (SELECT slot, label, v.j, {act} AS a FROM a{t}_{layer - 1} h "
                f"JOIN w{t}_{layer} v ON v.i = h.j GROUP BY slot, label, v.j)"
            )
        parts += [
            f"p{t} AS MATERIALIZED (SELECT slot, label, j, exp(a) / sum(exp(a)) OVER (PARTITION BY slot) AS p FROM a{t}_{last})",
            f"e{t}_{last} AS MATERIALIZED (SELECT slot, j, p - CASE WHEN j = label THEN 1 ELSE 0 END AS d FROM p{t})",
        ]
        for layer in range(last, 0, -1):
            parts.append(
                f"e{t}_{layer - 1} AS MATERIALIZED (SELECT h.slot, h.j, sum(v.w * e.d) * max(h.a) * (1 - max(h.a)) AS d "
                f"FROM a{t}_{layer - 1} h JOIN w{t}_{layer} v ON v.i = h.j JOIN e{t}_{layer} e ON e.slot = h.slot AND e.j = v.j GROUP BY h.slot, h.j)"
            )
        for layer in range(last + 1):
            inputs = f"b{t} h" if layer == 0 else f"a{t}_{layer - 1} h"
            unit, value = ("feature", "x") if layer == 0 else ("j", "a")
            parts.append(
                f"g{t}_{layer} AS MATERIALIZED (SELECT h.{unit} AS i, e.j, sum(h.{value} * e.d) AS g FROM {inputs} "
                f"JOIN e{t}_{layer} e USING (slot) GROUP BY h.{unit}, e.j)"
            )
            old = f"FROM w{t}_{layer} LEFT JOIN g{t}_{layer} USING (i, j)"
            new = f"w{t + 1}_{layer} AS MATERIALIZED "
            if not adam:
                parts.append(f"{new}(SELECT i, j, w * {shrink} - {step!r}::DOUBLE / {b} * coalesce(g, 0) AS w {old})")
                continue
            parts += [
                f"k{t}_{layer} AS (SELECT i, j, w * {shrink} AS w, m * {shrink} AS m, v * {shrink} AS v, coalesce(g, 0) <> 0 AS moved, "
                f"coalesce(g / {b}, 0) AS g {old})",
                f"n{t}_{layer} AS (SELECT i, j, w, moved, CASE WHEN moved THEN 0.9::DOUBLE * m + (1 - 0.9::DOUBLE) * g ELSE m END AS m, "
                f"CASE WHEN moved THEN 0.99::DOUBLE * v + (1 - 0.99::DOUBLE) * g * g ELSE v END AS v FROM k{t}_{layer})",
                f"{new}(SELECT i, j, CASE WHEN moved THEN w - {step!r}::DOUBLE / (sqrt(v / (1 - pow(0.99::DOUBLE, {t + 1}))) + 1e-7::DOUBLE) "
                f"* m / (1 - pow(0.9::DOUBLE, {t + 1})) ELSE w END AS w, m, v FROM n{t}_{layer})",
            ]
    return "WITH " + ",\n".join(parts)


def layer_weights_sql(cells: str, sizes_of: list[int], batch: int, adam: bool = False, **settings) -> str:
    columns = ", ".join(f"{rounded(c)} AS {c}" for c in (("w", "m", "v") if adam else ("w",)))
    rows = [f"SELECT {layer} AS layer, i, j, {columns} FROM w{MLP_ITERATIONS}_{layer}" for layer in range(len(sizes_of) - 1)]
    return layers_unrolled(cells, sizes_of, batch, adam=adam, **settings) + "\n" + " UNION ALL ".join(rows)


def layer_history_sql(cells: str, sizes_of: list[int], batch: int, **settings) -> str:
    own = "max(CASE WHEN j = label THEN p END)"
    rows = [
        f"SELECT CAST({t} AS INTEGER) AS iter, {rounded('avg(-ln(own))')} AS batch_loss, "
        f"{rounded('avg(CASE WHEN own >= top THEN 1.0 ELSE 0.0 END)')} AS accuracy "
        f"FROM (SELECT slot, {own} AS own, max(p) AS top FROM p{t} GROUP BY slot)"
        for t in range(MLP_ITERATIONS)
    ]
    return layers_unrolled(cells, sizes_of, batch, **settings) + "\n" + " UNION ALL ".join(rows)


def mlp_weights_sql() -> str:
    t = MLP_ITERATIONS
    return (
        f"{mlp_unrolled()}\nSELECT 0 AS layer, i, j, {rounded('w')} AS w FROM u{t} "
        f"UNION ALL SELECT 1 AS layer, i, j, {rounded('w')} AS w FROM v{t}"
    )


# --------------------------------------------------------------------------------------- all queries


def all_queries() -> dict[str, str]:
    events, cells = event_cells(), f"WITH {event_cells().strip()}"
    part_tokens = " UNION ALL ".join(
        f"SELECT p_partkey AS rid, '{i}:' || {name} AS token FROM part"
        for i, name in enumerate(("p_brand", "p_type", "p_name"))
    )
    order_tokens = " UNION ALL ".join(
        f"SELECT o_orderkey AS rid, '{i}:' || nullif(CAST({_CLICK_CATEGORIES[c]} AS VARCHAR), '') AS token FROM orders"
        for i, c in enumerate((1, 2, 3, 26))
    )
    everything = "d0 AS (SELECT slot, " + drawn(f"'{SEED}:0:' || CAST(slot AS VARCHAR)") + (
        " % n AS rid FROM (SELECT event_id AS slot, (SELECT count(*) FROM pts) AS n FROM events))"
    )
    clicks_raw = ", ".join(
        [f"coalesce({_CLICK_INTEGERS.get(i, 'NULL')}, 0)::INTEGER AS i{i}" for i in range(1, 14)]
        + [f"coalesce({_CLICK_CATEGORIES.get(i, 'NULL')}, '')::VARCHAR AS c{i}" for i in range(1, 27)]
    )
    blocks = (
        f"{cells}, placed AS (SELECT rid, x, CAST(feature % 4 AS INTEGER) AS part, CAST(rid // 1000 AS INTEGER) AS chunk"
        " FROM cells)"
    )
    lines = (
        f"WITH {CLICK_CELLS.strip()}\nSELECT CAST(CAST(label AS BIGINT) AS VARCHAR) || ' ' || "
        "string_agg(CAST(feature + 1 AS VARCHAR) || ':' || CAST(CAST(x AS BIGINT) AS VARCHAR), ' ' ORDER BY feature)"
        " AS line FROM cells GROUP BY rid, label"
    )
    ranks = pagerank_ctes(60)
    return {
        "read_libsvm": f"{cells}\nSELECT label, feature, x AS value, count(*) AS n FROM cells GROUP BY ALL",
        "write_libsvm": lines,
        "to_columns": f"{cells}\nSELECT CAST(feature % 4 AS INTEGER) AS part, CAST(feature // 4 AS INTEGER) AS local, "
        "CAST(rid // 1000 AS INTEGER) AS chunk, rid AS row_id, label, feature, x AS value FROM cells",
        "to_blocks": f"{blocks}\nSELECT part, chunk, count(DISTINCT rid) AS n_rows, count(*) AS n_cells, "
        f"count(*) AS last_offset, {rounded('sum(x)')} AS total FROM placed GROUP BY part, chunk",
        "to_blocks_bounded": f"{cells}, kept AS (SELECT rid, feature, x FROM cells WHERE (CASE WHEN feature = 0 THEN 0 WHEN feature <= 50 THEN 1 ELSE 2 END) <= rid % 4), "
        "counted AS (SELECT rid, least(3, rid % 4 + 1) AS n FROM pts), "
        "chunks AS (SELECT rid, CAST((sum(n) OVER (ORDER BY rid) - n) // 2498 AS INTEGER) AS chunk FROM counted)\n"
        "SELECT CAST(feature % 4 AS INTEGER) AS part, chunk, count(DISTINCT rid) AS n_rows, count(*) AS n_cells, "
        f"count(*) AS last_offset, {rounded('sum(x)')} AS total FROM kept JOIN chunks USING (rid) GROUP BY feature % 4, chunk",
        "feature_partition": f"{cells}\nSELECT CAST(feature % 4 AS INTEGER) AS part, "
        f"count(DISTINCT feature) AS n_features, count(*) AS n_cells, {rounded('sum(x)')} AS total "
        "FROM cells GROUP BY feature % 4",
        "read_criteo": f"SELECT {_URGENT} AS label, {clicks_raw} FROM orders",
        "criteo_features": f"WITH {CLICK_CELLS.strip()}\nSELECT rid AS row_id, label, feature, x AS value FROM cells",
        "hash_features": f"WITH tokens AS ({part_tokens}), hashed AS (SELECT rid, {signed('token')} AS h FROM tokens)\n"
        "SELECT rid AS row_id, CAST(abs(h) % 64 AS INTEGER) AS bucket, "
        "CAST(sum(CASE WHEN h >= 0 THEN 1 ELSE -1 END) AS BIGINT) AS value FROM hashed "
        "GROUP BY rid, abs(h) % 64 HAVING sum(CASE WHEN h >= 0 THEN 1 ELSE -1 END) <> 0",
        "hash_present": f"WITH tokens AS ({order_tokens}), hashed AS (SELECT rid, {signed('token')} AS h FROM tokens "
        "WHERE token IS NOT NULL)\nSELECT rid AS row_id, CAST(abs(h) % 64 AS INTEGER) AS bucket, "
        "CAST(sum(CASE WHEN h >= 0 THEN 1 ELSE -1 END) AS BIGINT) AS value FROM hashed "
        "GROUP BY rid, abs(h) % 64 HAVING sum(CASE WHEN h >= 0 THEN 1 ELSE -1 END) <> 0",
        "minibatch_slots": f"WITH {events.strip()}, {everything}\nSELECT CAST(slot AS INTEGER) AS slot, rid AS row_id FROM d0",
        "batch_labels": f"WITH {events.strip()}, {everything}\n"
        "SELECT CAST(slot AS INTEGER) AS slot, rid AS row_id, label FROM d0 JOIN pts USING (rid)",
        "batch_cells": f"WITH {events.strip()}, {everything}\n"
        "SELECT CAST(slot AS INTEGER) AS slot, label, feature, x AS value FROM d0 JOIN cells USING (rid)",
        "batch_dot": stats_sql("lr", 1),
        "batch_dot_k": stats_sql("mlr", 5, True),
        "fm_stats": stats_sql("fm", 4),
        "batch_grad": grad_sql(),
        "log_loss": loss_sql("lr", 1),
        "hinge_loss": loss_sql("svm", 1),
        "softmax_loss": loss_sql("mlr", 5, True),
        "fm_loss": loss_sql("fm", 4),
        "label_counts": f"{cells}\nSELECT label, count(*) AS n_rows FROM pts GROUP BY label",
        "gaussian_init": "SELECT CAST(p_partkey AS INTEGER) AS feature, CAST(k AS INTEGER) AS k, "
        + rounded(gauss(f"'{SEED}:' || p_partkey || ':' || k"))
        + " AS w FROM part JOIN (SELECT unnest(range(1, 5)) AS k) ON true",
        "train_lr": trained_weights("lr", events, EVENT_FEATURES),
        "train_svm": trained_weights("svm", events, EVENT_FEATURES),
        "train_mlr": trained_weights("mlr", event_cells(True), EVENT_FEATURES, 5),
        "train_mlr_dense": trained_weights("mlr", EMBEDDING_CELLS, EMBEDDING_SIZE, 10),
        "train_fm": trained_weights("fm", events, EVENT_FEATURES, 5),
        "train_adamlr": trained_weights("lr", events, EVENT_FEATURES, adam=True, step=0.05),
        "train_adamsvm": trained_weights("svm", events, EVENT_FEATURES, adam=True, step=0.05),
        "train_lr_clicks": trained_weights("lr", CLICK_CELLS, CLICK_FEATURES, step=0.1),
        "train_lr_partitioned": trained_weights("lr", CLICK_CELLS, CLICK_FEATURES, step=0.1),
        "train_lr_stored": trained_weights("lr", CLICK_CELLS, CLICK_FEATURES, step=0.1),
        "train_fm_stored": trained_weights("fm", CLICK_CELLS, CLICK_FEATURES, 5, step=0.01),
        "train_fm_partitioned": trained_weights("fm", CLICK_CELLS, CLICK_FEATURES, 5, step=0.01),
        "mlp_forward": f"{mlp_all_rows()}\nSELECT slot AS row_id, CAST(k AS INTEGER) AS k, {rounded('p')} AS p FROM p0",
        "mlp_metrics": f"{mlp_all_rows()}\nSELECT {rounded('avg(-ln(own))')} AS loss, "
        f"{rounded('avg(CASE WHEN own >= top THEN 1.0 ELSE 0.0 END)')} AS accuracy FROM "
        "(SELECT slot, max(CASE WHEN k = label THEN p END) AS own, max(p) AS top FROM p0 GROUP BY slot)",
        "train_mlp": mlp_weights_sql(),
        "history_mlp": history_mlp_sql(),
        "train_mlp_deep": layer_weights_sql(EMBEDDING_CELLS, [EMBEDDING_SIZE, 18, 5, EMBEDDING_CLASSES], 5),
        "train_mlp_adam": layer_weights_sql(EMBEDDING_CELLS, [EMBEDDING_SIZE, MLP_HIDDEN, EMBEDDING_CLASSES], 5, adam=True, step=0.05, reg=REG),
        "train_mlp_partitioned": layer_weights_sql(CLICK_CELLS, [CLICK_FEATURES, 4, 3, 2], BATCH_SHARE, step=0.1),
        "history_mlp_partitioned": layer_history_sql(CLICK_CELLS, [CLICK_FEATURES, 4, 3, 2], BATCH_SHARE, step=0.1),
        "evaluate": evaluate_sql(),
        "history": history_sql(),
        "score": score_sql(),
        "evaluate_partitioned": evaluate_sql(),
        "score_partitioned": score_sql(),
        "train_gated": gated_weights(events, EVENT_FEATURES),
        "train_gated_adam": gated_weights(events, EVENT_FEATURES, adam=True, step=0.05),
        "train_gated_partitioned": gated_weights(CLICK_CELLS, CLICK_FEATURES, step=0.1),
        "score_gated": gated_scores(),
        "train_own": trained_weights("squares", events, EVENT_FEATURES, step=0.05),
        "train_all": chain_sql(),
        "read_edges": f"WITH {EDGES.strip()}\nSELECT src, dst, count(*) AS n FROM edges GROUP BY src, dst",
        "pagerank": f"{ranks}\nSELECT id, {rounded('rank')} AS rank FROM ranks",
        "top_ranks": f"{ranks}\nSELECT id, {rounded('rank')} AS rank FROM ranks ORDER BY ranks.rank DESC, id LIMIT 10",
        "rewrite_files": "SELECT count(*) AS n_lines, 8 AS n_files, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders",
        "merge_files": "SELECT count(*) AS n_lines, 3 AS n_files, CAST(sum(o_orderkey) AS BIGINT) AS total FROM orders",
        "sample_rows": f"SELECT o_orderkey FROM orders WHERE {unit(f"'{SEED}:' || o_orderkey")} < {SAMPLE_SHARE}::DOUBLE",
        "sample_text": "SELECT line FROM (SELECT p_partkey || ' ' || p_name AS line FROM part) "
        f"WHERE {unit(f"'{SEED}:' || line")} < {SAMPLE_SHARE}::DOUBLE",
        "resample": "SELECT o_orderkey FROM (SELECT o_orderkey, unnest(range("
        + poisson(RESAMPLE_RATE, f"'{SEED}:' || o_orderkey") + ")) AS copy FROM orders)",
        "load_vectors": f"WITH {CLICK_CELLS.strip()}\nSELECT label, count(DISTINCT rid) AS n_rows, {CLICK_FEATURES} AS "
        "width, CAST(sum(x) AS DOUBLE) AS total FROM cells GROUP BY label",
    }
