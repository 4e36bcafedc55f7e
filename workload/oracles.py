"""SQL counterparts of the queries, written from the definitions.

Ranks are counted with a range window over the whole snapshot, medians taken with
the built-in aggregate, frames and lags with plain windows: nothing of the way the
engine divides its work appears here.
"""

from __future__ import annotations

from chronopanel.functions import normal
from chronopanel.plans.spec import BASE_COLUMNS, CLONES, FULL_COLUMNS
from workload.panels import APPENDS, FROZEN, ONE_DAY

PANELS = {
    "orders": """
        SELECT o_custkey AS id, CAST(date_trunc('month', o_orderdate) AS DATE) AS t,
               CAST(SUM(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS price,
               CAST(SUM(CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) END) AS DOUBLE) AS finished,
               CAST(COUNT(*) AS DOUBLE) AS n_orders
        FROM orders GROUP BY 1, 2""",
    "events": """
        SELECT user_id AS id, CAST(ts AS DATE) AS t,
               CAST(SUM(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS value,
               CAST(COUNT(*) AS DOUBLE) AS n_events,
               CAST(SUM(CASE WHEN event_type = 'purchase' THEN CAST(value AS DECIMAL(18,2)) END) AS DOUBLE) AS bought
        FROM events GROUP BY 1, 2""",
    "parts": """
        SELECT l_partkey AS id, CAST(date_trunc('month', l_shipdate) AS DATE) AS t,
               CAST(SUM(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS revenue,
               CAST(SUM(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS quantity,
               CAST(SUM(CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS DECIMAL(18,2)) END) AS DOUBLE) AS returned
        FROM lineitem GROUP BY 1, 2""",
    "customers": f"SELECT c_custkey AS id, DATE '{ONE_DAY}' AS t, c_acctbal AS balance FROM customer",
}



def shipped_panel() -> str:
    """24 value columns per customer, cloned, doubled, in two snapshots."""
    price, finished = "CAST(o_totalprice AS DECIMAL(18,2))", "o_orderstatus = 'F' AND "
    aggregates = ["CAST(COUNT(*) AS DOUBLE) AS PAY_0"]
    aggregates += [f"CAST(COUNT(*) FILTER (o_orderpriority LIKE '{i}%') AS DOUBLE) AS PAY_{i + 1}" for i in range(1, 6)]
    for name, extra in (("BILL_AMT", ""), ("PAY_AMT", finished)):
        aggregates += [
            f"CAST(SUM({price}) FILTER ({extra}year(o_orderdate) = {1994 + i}) AS DOUBLE) AS {name}{i}" for i in range(1, 7)
        ]
    aggregates.append("CAST(COUNT(*) FILTER (o_orderstatus = 'P') AS DOUBLE) AS default_payment_next_month")
    clones = ", ".join(f"{c} AS {c}_{i}" for i in range(1, CLONES + 1) for c in BASE_COLUMNS)
    return f"""
        WITH per_customer AS (SELECT o_custkey AS c_custkey, {", ".join(aggregates)} FROM orders GROUP BY 1),
        base AS (SELECT c_custkey, c_acctbal AS LIMIT_BAL, CAST(c_nationkey % 2 + 1 AS DOUBLE) AS SEX,
                 CAST(length(c_mktsegment) AS DOUBLE) AS EDUCATION, CAST(c_nationkey % 3 AS DOUBLE) AS MARRIAGE,
                 CAST(c_nationkey + 20 AS DOUBLE) AS AGE, per_customer.* EXCLUDE (c_custkey)
                 FROM customer LEFT JOIN per_customer USING (c_custkey))
        SELECT row_number() OVER (PARTITION BY day ORDER BY copy, c_custkey) AS id, CAST(day AS DATE) AS t,
               {", ".join(BASE_COLUMNS)}, {clones}
        FROM base, (VALUES (0), (1)) AS copies(copy), (VALUES ('2017-01-01'), ('2017-01-31')) AS days(day)"""


PANELS["shipped"] = shipped_panel()

SNAPSHOT = "PARTITION BY t"
ENTITY = "PARTITION BY id ORDER BY t"


def polynomial(coefficients: tuple[float, ...], x: str) -> str:
    result = repr(coefficients[-1])
    for c in reversed(coefficients[:-1]):
        result = f"({result} * {x} + {c!r})"
    return f"CAST({result} AS DOUBLE)"


def normal_quantile(p: str) -> str:
    r = f"(0.180625e0 - ({p} - 0.5e0) * ({p} - 0.5e0))"
    tail = f"sqrt(-ln(least({p}, 1e0 - {p})))"
    central = f"({p} - 0.5e0) * {polynomial(normal.CENTRAL_NUMERATOR, r)} / {polynomial(normal.CENTRAL_DENOMINATOR, r)}"
    near, far = f"({tail} - 1.6e0)", f"({tail} - 5e0)"
    outer = (
        f"CASE WHEN {tail} <= 5 THEN {polynomial(normal.MIDDLE_NUMERATOR, near)} / {polynomial(normal.MIDDLE_DENOMINATOR, near)}"
        f" ELSE {polynomial(normal.TAIL_NUMERATOR, far)} / {polynomial(normal.TAIL_DENOMINATOR, far)} END"
    )
    return (
        f"CASE WHEN {p} = 0 THEN CAST('-inf' AS DOUBLE) WHEN {p} = 1 THEN CAST('inf' AS DOUBLE)"
        f" WHEN abs({p} - 0.5e0) <= 0.425e0 THEN {central}"
        f" WHEN {p} < 0.5 THEN -({outer}) ELSE {outer} END"
    )


def index(value: str, borders: list[float]) -> str:
    cases = " ".join(f"WHEN {value} < {b!r}e0 THEN {float(i)}e0" for i, b in enumerate(borders))
    return f"CASE WHEN {value} IS NULL THEN NULL {cases} ELSE {float(len(borders))}e0 END"


# Interval borders.
QUARTERS = [0.0, 0.25, 0.5, 0.75, 1.0]
TENTHS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]


def exact_mean(c: str, over: str) -> str:
    return f"CAST(SUM(CAST({c} AS DECIMAL(18,2))) OVER ({over}) AS DOUBLE) / NULLIF(COUNT({c}) OVER ({over}), 0)"


def frame(n: int) -> str:
    return f"{ENTITY} ROWS BETWEEN {n} PRECEDING AND CURRENT ROW"


def quoted(name: str) -> str:
    return f'"{name}"'


def feature_sql(panel: str, parts: dict[str, set[str]], show: list[str], kept: list[str] = ()) -> str:
    """``parts``: column -> features to compute; ``show``: output columns beside the keys."""
    first, scores, rounded, flags = [], [], [], []
    for c, wanted in parts.items():
        dm = f"{c} - {exact_mean(c, SNAPSHOT)}"
        if "DM" in wanted or "LDM" in wanted:
            first.append(f"{dm} AS DM_{c}")
        if "DMI" in wanted:
            first.append(f"{c} - MIN({c}) OVER ({SNAPSHOT}) AS DMI_{c}")
        if "DMA" in wanted:
            first.append(f"{c} - MAX({c}) OVER ({SNAPSHOT}) AS DMA_{c}")
        if "DME" in wanted:
            first.append(f"ROUND({c} - MEDIAN({c}) OVER ({SNAPSHOT}), 6) + 0.0 AS DME_{c}")
        if wanted & {"E", "B", "Q", "SD"}:
            upto = f"COUNT({c}) OVER ({SNAPSHOT} ORDER BY {c} NULLS FIRST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
            first.append(
                f"CASE WHEN {c} IS NULL THEN 0e0 ELSE CAST({upto} AS DOUBLE) / COUNT(*) OVER ({SNAPSHOT}) END AS E_{c}"
            )
        for prefix, function in (("DMMI", "MIN"), ("DMMA", "MAX")):
            if prefix in wanted:
                first += [f"{c} - {function}({c}) OVER ({frame(n)}) AS {prefix}_{c}_{n}" for n in (2, 3, 6)]
        if "DMM" in wanted:
            first += [f"{c} - {exact_mean(c, frame(n))} AS DMM_{c}_{n}" for n in (2, 3, 6)]
        if "L" in wanted:
            first += [f"LAG({c}, {k}) OVER ({ENTITY}) AS L{k}_{c}" for k in (1, 2, 3, 6)]
        if "LDM" in wanted:
            scores += [f"LAG(DM_{c}, {k}) OVER ({ENTITY}) AS L{k}_DM_{c}" for k in (1, 2, 3, 6)]
        if "B" in wanted:
            scores += [f"{index(f'E_{c}', QUARTERS)} AS B4_E_{c}", f"{index(f'E_{c}', TENTHS)} AS B10_E_{c}"]
        if wanted & {"Q", "SD"}:
            scores.append(f"{normal_quantile(f'E_{c}')} AS q_{c}")
            rounded.append(f"ROUND(q_{c}, 6) + 0.0 AS Q_E_{c}")
        if "SD" in wanted:
            for k in (2, 3):
                flags.append(f"CASE WHEN q_{c} > {k} THEN 1e0 ELSE 0e0 END AS {quoted(f'{k}SDU_Q_E_{c}')}")
                flags.append(f"CASE WHEN -q_{c} > {k} THEN 1e0 ELSE 0e0 END AS {quoted(f'{k}SDD_Q_E_{c}')}")
    last = ["*" if not rounded else "* EXCLUDE (" + ", ".join(f"q_{c}" for c, w in parts.items() if w & {"Q", "SD"}) + ")"]
    columns = ", ".join(quoted(name) for name in show)
    return f"""
        WITH panel AS ({PANELS[panel]}),
        a AS (SELECT {', '.join(['*', *first])} FROM panel),
        b AS (SELECT {', '.join(['*', *scores])} FROM a),
        c AS (SELECT {', '.join([*last, *rounded, *flags])} FROM b)
        SELECT strftime(t, '%Y-%m-%d') AS t, id, {columns} FROM c"""


def names(c: str, wanted: set[str]) -> list[str]:
    out = [f"{p}_{c}" for p in ("DM", "DMI", "DMA", "DME", "E") if p in wanted]
    out += [f"{b}_E_{c}" for b in ("B4", "B10") if "B" in wanted]
    out += [f"Q_E_{c}"] if "Q" in wanted else []
    out += [f"{k}SD{d}_Q_E_{c}" for k in (2, 3) for d in "UD" if "SD" in wanted]
    out += [f"{p}_{c}_{n}" for p in ("DMM", "DMMI", "DMMA") if p in wanted for n in (2, 3, 6)]
    out += [f"L{k}_{c}" for k in (1, 2, 3, 6) if "L" in wanted]
    out += [f"L{k}_DM_{c}" for k in (1, 2, 3, 6) if "LDM" in wanted]
    return out


ALL = {"DM", "DMI", "DMA", "DME", "E", "B", "Q", "SD", "DMM", "DMMI", "DMMA", "L", "LDM"}


def full_sql(panel: str, wanted: set[str], columns: list[str], others: list[str] = (), inputs: bool = True) -> str:
    show = [n for c in columns for n in [*([c] if inputs else []), *names(c, wanted)]]
    return feature_sql(panel, {c: wanted for c in columns}, [*show, *others])


def distinct_features(panel: str, wanted: set[str], columns: list[str], show: set[str]) -> str:
    """Compute ``wanted`` but show only ``show``, without the input columns."""
    return feature_sql(panel, {c: wanted for c in columns}, [n for c in columns for n in names(c, show)])


AMOUNTS = ["price", "finished"]

MS = "(epoch_us(ts) // 1000)"
EPOCH_TEXT = f"concat(CAST({MS} // 1000 AS VARCHAR), '.', lpad(CAST({MS} % 1000 AS VARCHAR), 3, '0'))"
MARKERS = f"""
    SELECT lpad(CAST(user_id AS VARCHAR), 6, '0') AS tag,
           CASE WHEN event_type IN ('error', 'purchase') THEN '' ELSE concat(event_type, ' ', event_id) END AS label,
           CAST({EPOCH_TEXT} AS DECIMAL(20,9)) AS time,
           event_type = 'error' AS failed,
           concat(CASE event_type WHEN 'error' THEN 'STOP FAILED' WHEN 'purchase' THEN 'STOP'
                  ELSE concat('START(', event_type, ' ', event_id, ')') END,
                  ': ', strftime(ts, '%Y-%m-%d %H')) AS message
    FROM events"""
FEATURE_LINES = "SELECT CAST(epoch(date_trunc('second', ts)) AS DOUBLE) AS time, event_type AS label FROM events"
GAPS = f"""
    SELECT * FROM (SELECT time, label, LEAD(time) OVER (ORDER BY time, label) AS next_time FROM ({FEATURE_LINES}))
    WHERE next_time IS NOT NULL"""
METRICS = f"""
    SELECT CASE event_type WHEN 'error' THEN 'cpu.trace.error' WHEN 'signup' THEN 'signup' WHEN 'view' THEN 'heap.used'
           ELSE concat('app.', event_type, '.value') END AS name,
           CAST(user_id AS VARCHAR) AS pid, {MS} AS epoch_ms, value FROM events"""
METRIC_GROUP = """CASE WHEN contains(name, '.') THEN concat(split_part(name, '.', 1), '.', split_part(name, '.', 2))
           ELSE 'other.other' END"""


def profile_sql() -> str:
    columns = [
        ("o_orderkey", "bigint"),
        ("o_custkey", "bigint"),
        ("o_orderstatus", "string"),
        ("o_totalprice", "double"),
        ("o_orderdate", "date"),
        ("o_orderpriority", "string"),
    ]
    rows = []
    for i, (name, kind) in enumerate(columns):
        value = f"CAST({name} AS DATE)" if kind == "date" else name
        rows.append(
            f"SELECT {i} AS position, '{name}' AS name, '{kind}' AS type, COUNT(*) AS rows, COUNT({name}) AS present,"
            f" CAST(MIN({value}) AS VARCHAR) AS smallest, CAST(MAX({value}) AS VARCHAR) AS largest FROM orders"
        )
    return " UNION ALL ".join(rows)


def frozen_sql(columns: list[str]) -> str:
    first, scores, rounded, flags, show = [], [], [], [], []
    for c in columns:
        mean = f"CAST(SUM(CAST({c} AS DECIMAL(18,2))) AS DOUBLE) / NULLIF(COUNT({c}), 0)"
        first += [f"{c} - (SELECT {s} FROM kept) AS {p}_{c}" for p, s in (("DM", mean), ("DMI", f"MIN({c})"), ("DMA", f"MAX({c})"))]
        first.append(f"ROUND({c} - (SELECT MEDIAN({c}) FROM kept), 6) + 0.0 AS DME_{c}")
        upto = f"(SELECT COUNT(*) FROM kept WHERE kept.{c} <= later.{c})"
        first.append(f"CASE WHEN {c} IS NULL THEN 0e0 ELSE CAST({upto} AS DOUBLE) / (SELECT COUNT(*) FROM kept) END AS E_{c}")
        scores += [f"{index(f'E_{c}', QUARTERS)} AS B4_E_{c}", f"{index(f'E_{c}', TENTHS)} AS B10_E_{c}", f"{normal_quantile(f'E_{c}')} AS q_{c}"]
        rounded.append(f"ROUND(q_{c}, 6) + 0.0 AS Q_E_{c}")
        for k in (2, 3):
            flags.append(f"CASE WHEN q_{c} > {k} THEN 1e0 ELSE 0e0 END AS {quoted(f'{k}SDU_Q_E_{c}')}")
            flags.append(f"CASE WHEN -q_{c} > {k} THEN 1e0 ELSE 0e0 END AS {quoted(f'{k}SDD_Q_E_{c}')}")
        show += [c, *names(c, {"DM", "DMI", "DMA", "DME", "E", "B", "Q", "SD"})]
    return f"""
        WITH panel AS ({PANELS["orders"]}), kept AS (SELECT * FROM panel WHERE t = DATE '{FROZEN}'),
        later AS (SELECT * FROM panel WHERE t >= DATE '{APPENDS[1]}'),
        a AS (SELECT {', '.join(['*', *first])} FROM later), b AS (SELECT {', '.join(['*', *scores])} FROM a),
        c AS (SELECT {', '.join(['*', *rounded, *flags])} FROM b)
        SELECT strftime(t, '%Y-%m-%d') AS t, id, {', '.join(quoted(n) for n in show)} FROM c"""


def scheme_bucket(value: str, scheme: str) -> str:
    borders = f"(SELECT kind || n_regionkey AS scheme_id, n_nationkey * step AS border FROM nation, (VALUES ('S', 4e0), ('P', 0.04e0)) AS kinds(kind, step))"
    return f"(SELECT CASE WHEN COUNT(*) > 0 THEN CAST(COUNT(*) FILTER (border <= {value}) AS DOUBLE) END FROM {borders} b WHERE b.scheme_id = {scheme})"


RUN = "strftime(date_trunc('week', ts), '%Y-%m-%d')"
ORACLES: dict[str, str] = {
    "cs_own_statistics": f"""
        WITH panel AS ({PANELS["orders"]}),
        z AS (SELECT t, id, price, price - sqrt(SUM(price * price) OVER ({SNAPSHOT}) / COUNT(price) OVER ({SNAPSHOT})) AS dr,
              (price - {exact_mean("price", SNAPSHOT)}) / NULLIF(stddev_pop(price) OVER ({SNAPSHOT}), 0) AS z FROM panel)
        SELECT strftime(t, '%Y-%m-%d') AS t, id, price, ROUND(dr, 6) + 0.0 AS "DR_price", ROUND(z, 6) + 0.0 AS "Z_price",
               {", ".join(f'ROUND(LAG(z, {k}) OVER (PARTITION BY id ORDER BY t), 6) + 0.0 AS "L{k}_Z_price"' for k in (1, 2, 3, 6))} FROM z""",
    "csv_rejects": """
        WITH o AS (SELECT o_orderkey AS id, o_orderkey % 25 AS r, CAST(o_totalprice AS DECIMAL(18,2)) AS p,
                   strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderstatus AS s FROM orders)
        SELECT CASE WHEN good THEN id END AS id, CASE WHEN good THEN CAST(p AS DOUBLE) END AS price, CASE WHEN good THEN d END AS day,
               CASE WHEN good THEN s END AS status,
               CASE r WHEN 7 THEN concat(id, ',n/a,', d, ',', s) WHEN 9 THEN concat(id, ',', p) WHEN 11 THEN concat(',', p, ',', d, ',', s)
                      WHEN 13 THEN concat(id, ',', p, ',31.12.1997,', s) WHEN 15 THEN concat(id, ',n/a,n/a,', s)
                      WHEN 17 THEN concat(id, ',', p, ',', d, ',', s, ',more') WHEN 19 THEN concat(',n/a,', d, ',', s) END AS record,
               CASE r WHEN 7 THEN 'price: unreadable' WHEN 9 THEN 'fields' WHEN 11 THEN 'id: missing' WHEN 13 THEN 'day: unreadable'
                      WHEN 15 THEN 'price: unreadable, day: unreadable' WHEN 17 THEN 'fields' WHEN 19 THEN 'price: unreadable, id: missing' END AS problems
        FROM (SELECT *, r NOT IN (7, 9, 11, 13, 15, 17, 19) AS good FROM o)""",
    "run_curves": f"""
        WITH s AS (SELECT {RUN} AS run, epoch_us(ts) * 1000 AS ns, {MS} AS ms, event_id AS y FROM events),
        c AS (SELECT *, LAG(y) OVER (PARTITION BY run ORDER BY ns, y) AS before, (ms - MIN(ms) OVER (PARTITION BY run)) / 1000e0 AS x FROM s)
        SELECT run, ns, x, 0 AS part, before AS y FROM c WHERE before IS NOT NULL
        UNION ALL SELECT run, ns, x, 1, 0 FROM c UNION ALL SELECT run, ns, x, 2, y FROM c""",
    "run_series": f"""
        WITH o AS (SELECT {RUN} AS run, MIN({MS}) AS origin FROM events WHERE event_id % 7 = 0 GROUP BY 1),
        m AS (SELECT * FROM ({METRICS}) WHERE name <> 'cpu.trace.error')
        SELECT {METRIC_GROUP} AS "group", concat(name, '.', pid) AS series, run, (epoch_ms - origin) / 1000e0 AS x, value
        FROM m ASOF LEFT JOIN o ON m.epoch_ms >= o.origin""",
    "appended_snapshots": f"""
        SELECT * FROM ({full_sql("orders", ALL, AMOUNTS, ["n_orders"])}) WHERE t >= '{APPENDS[1]}'""",
    "frozen_reference": frozen_sql(AMOUNTS),
    "score_schemes": f"""
        WITH p AS (SELECT c_custkey AS object_id, '{ONE_DAY}' AS snapshot_date, c_mktsegment AS model_id,
                   (c_acctbal + 1000e0) / 11000e0 AS probability, 'S' || (length(c_mktsegment) % 6) AS score_bucketing_scheme_id,
                   'P' || (length(c_mktsegment) % 6) AS probability_bucketing_scheme_id FROM customer),
        s AS (SELECT *, cume_dist() OVER (PARTITION BY model_id ORDER BY probability) * 100 AS score FROM p)
        SELECT *, {scheme_bucket("s.score", "s.score_bucketing_scheme_id")} AS score_bucket,
               {scheme_bucket("s.probability", "s.probability_bucketing_scheme_id")} AS probability_bucket FROM s""",
    "sketched_quantiles": """
        SELECT event_type, strftime(date_trunc('month', ts), '%Y-%m-%d') AS t, share, COUNT(value) AS n, TRUE AS within_error
        FROM events, (VALUES (0.1e0), (0.25e0), (0.5e0), (0.75e0), (0.9e0)) AS shares(share) GROUP BY ALL""",
    "cs_distance_mean": full_sql("orders", {"DM"}, AMOUNTS),
    "cs_distance_min": full_sql("orders", {"DMI"}, AMOUNTS),
    "cs_distance_max": full_sql("orders", {"DMA"}, AMOUNTS),
    "cs_distance_median": full_sql("orders", {"DME"}, AMOUNTS),
    "cs_ecdf": full_sql("orders", {"E"}, [*AMOUNTS, "n_orders"]),
    "cs_bucketize": distinct_features("orders", {"E", "B"}, AMOUNTS, {"B"}),
    "cs_quantile": distinct_features("orders", {"E", "Q"}, AMOUNTS, {"Q"}),
    "cs_naive_outliers": distinct_features("orders", {"E", "Q", "SD"}, AMOUNTS, {"SD"}),
    "cs_one_snapshot": full_sql("customers", {"DM", "DMI", "DMA", "DME", "E", "B", "Q", "SD"}, ["balance"]),
    "ts_moving_avg_distance": full_sql("orders", {"DMM"}, AMOUNTS),
    "ts_moving_max_distance": full_sql("orders", {"DMMA"}, AMOUNTS),
    "ts_moving_min_distance": full_sql("orders", {"DMMI"}, AMOUNTS),
    "ts_lags": full_sql("orders", {"L"}, AMOUNTS),
    "ts_lags_of_distance": full_sql("orders", {"DM", "LDM"}, ["price"]),
    "all_features_one_column": full_sql("orders", ALL, ["price"]),
    "all_features_events": full_sql("events", ALL, ["value", "bought"], ["n_events"]),
    "all_features_parts": full_sql("parts", ALL, ["revenue", "quantity", "returned"]),
    "shipped_workload": full_sql(
        "shipped",
        ALL,
        FULL_COLUMNS,
        [
            c
            for c in [*BASE_COLUMNS, *[f"{c}_{i}" for i in range(1, CLONES + 1) for c in BASE_COLUMNS]]
            if c not in FULL_COLUMNS
        ],
    ),
    "controller_by_table": full_sql(
        "shipped",
        ALL,
        FULL_COLUMNS,
        [c for c in [*BASE_COLUMNS, *[f"{c}_{i}" for i in range(1, CLONES + 1) for c in BASE_COLUMNS]] if c not in FULL_COLUMNS],
    ),
    "features_by_table": f"""
        WITH f AS ({feature_sql("events", {"value": {"DM", "LDM", "E", "B"}},
                                ["value", *names("value", {"DM", "LDM", "E", "B"}), "n_events", "bought"])})
        SELECT * FROM f""",
    "ranks_of_distances": f"""
        WITH panel AS ({PANELS["orders"]}),
        a AS (SELECT t, id, price, price - {exact_mean("price", SNAPSHOT)} AS DM_price,
              {", ".join(f"price - MIN(price) OVER ({frame(n)}) AS DMMI_price_{n}" for n in (2, 3, 6))} FROM panel)
        SELECT strftime(t, '%Y-%m-%d') AS t, id, price, DM_price, DMMI_price_2, DMMI_price_3, DMMI_price_6,
               cume_dist() OVER (PARTITION BY t ORDER BY DM_price) AS E_DM_price FROM a""",
    "ml_stages": full_sql("events", ALL, ["value"]),
    "merge_buckets": full_sql("orders", {"DMI", "L"}, AMOUNTS),
    "merge_features": full_sql("orders", {"DMA"}, AMOUNTS),
    "snapshot_stats": f"""
        WITH panel AS ({PANELS["orders"]})
        SELECT strftime(t, '%Y-%m-%d') AS t, COUNT(*) AS n_rows, {", ".join(
            f"CAST(SUM(CAST({c} AS DECIMAL(18,2))) AS DOUBLE) / NULLIF(COUNT({c}), 0) AS mean_{c}, MIN({c}) AS min_{c},"
            f" MAX({c}) AS max_{c}, ROUND(MEDIAN({c}), 6) + 0.0 AS median_{c}" for c in AMOUNTS)}
        FROM panel GROUP BY 1""",
    "snapshot_filter": f"""
        SELECT * FROM ({full_sql("orders", {"DM"}, ["price"])}) WHERE t = '1996-03-01'""",
    "top20_latest": f"""
        WITH panel AS ({PANELS["orders"]})
        SELECT id, strftime(t, '%Y-%m-%d') AS t, price, finished, n_orders FROM panel ORDER BY id, t DESC LIMIT 20""",
    "latest_first": f"""
        WITH panel AS ({PANELS["orders"]})
        SELECT id, strftime(t, '%Y-%m-%d') AS t, price, finished, n_orders FROM panel""",
    "panel_expand_rows": """
        SELECT row_number() OVER (ORDER BY copy, c_custkey) AS c_custkey, c_acctbal, c_nationkey, copy, c_custkey AS old_key
        FROM customer, (VALUES (0), (1)) AS copies(copy)""",
    "panel_expand_columns": "SELECT s_suppkey, s_nationkey, s_acctbal, "
    + ", ".join(f"s_nationkey AS s_nationkey_{i}, s_acctbal AS s_acctbal_{i}" for i in (1, 2, 3))
    + " FROM supplier",
    "panel_snapshots": """
        WITH stacked AS (SELECT row_number() OVER (ORDER BY copy, c_custkey) AS "ID", c_acctbal
                         FROM customer, (VALUES (0), (1)) AS copies(copy))
        SELECT "ID", c_acctbal, c_acctbal AS c_acctbal_1, strftime(CAST(day AS DATE), '%Y-%m-%d') AS "snapshotDate"
        FROM stacked, (VALUES ('2017-01-01'), ('2017-01-31'), ('2017-03-02')) AS days(day)""",
    "panel_profile": profile_sql(),
    "csv_ingest": f"""
        SELECT CAST(c_custkey AS VARCHAR) AS "ID", CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS acct_bal,
               '{ONE_DAY}' AS "snapshotDate" FROM customer""",
    "runlog_markers": f"SELECT tag, label, CAST(time AS DOUBLE) AS time, failed, message FROM ({MARKERS})",
    "runlog_pairs": f"""
        WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY time, message) - 1 AS r FROM ({MARKERS})),
        paired AS (SELECT *, LEAD(time) OVER w AS stopped, LEAD(failed) OVER w AS stop_failed FROM ranked
                   WINDOW w AS (PARTITION BY tag ORDER BY r))
        SELECT label, tag, CASE WHEN label = '' THEN 0 ELSE CAST(split_part(label, ' ', 2) AS BIGINT) END AS n,
               CAST(time AS DOUBLE) AS started, CAST(stopped AS DOUBLE) AS stopped,
               CASE WHEN stop_failed THEN 0e0 ELSE CAST(stopped - time AS DOUBLE) END AS seconds
        FROM paired WHERE r % 2 = 0""",
    "runlog_gaps": f"SELECT *, next_time - time AS seconds FROM ({GAPS})",
    "runlog_label_index": f"""
        SELECT label, MIN(time) AS first_time, row_number() OVER (ORDER BY MIN(time), label) AS idx
        FROM ({FEATURE_LINES}) GROUP BY label""",
    "runlog_timings": f"""
        WITH gaps AS ({GAPS}),
        labels AS (SELECT label, row_number() OVER (ORDER BY MIN(time), label) AS idx FROM gaps GROUP BY label)
        SELECT idx, next_time - time AS seconds, label FROM gaps JOIN labels USING (label)""",
    "submit_options": """
        SELECT p_partkey, 'name' AS key, regexp_replace(trim(p_name), '\\s+', ' ', 'g') AS value FROM part
        UNION ALL SELECT p_partkey, 'conf', concat('size ', p_size) FROM part""",
    "submit_active": """
        SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'name' ELSE 'conf' END AS key,
               CASE WHEN p_partkey % 2 = 0 THEN regexp_replace(trim(p_name), '\\s+', ' ', 'g') ELSE concat('size ', p_size) END AS value
        FROM part""",
    "step_curve": """
        WITH s AS (SELECT epoch_us(ts) * 1000 AS ns, epoch_us(ts) // 1000 AS ms, event_id AS y FROM events),
        c AS (SELECT *, LAG(y) OVER (ORDER BY ns, y) AS before, (ms - MIN(ms) OVER ()) / 1000e0 AS x FROM s)
        SELECT ns, x, 0 AS part, before AS y FROM c WHERE before IS NOT NULL
        UNION ALL SELECT ns, x, 1, 0 FROM c UNION ALL SELECT ns, x, 2, y FROM c""",
    "metric_groups": f"""
        SELECT DISTINCT {METRIC_GROUP} AS "group", concat(name, ',pid=', pid, ',role=worker') AS key, name, pid
        FROM ({METRICS}) WHERE name <> 'cpu.trace.error'""",
    "aligned_series": f"""
        SELECT {METRIC_GROUP} AS "group", concat(name, '.', pid) AS series,
               (epoch_ms - (SELECT MIN({MS}) FROM events)) / 1000e0 AS x, value
        FROM ({METRICS}) WHERE name <> 'cpu.trace.error'""",
    "row_hash": """
        SELECT c_custkey, sha1(c_name) AS name_hash,
               sha1(concat(CAST(c_custkey AS VARCHAR), chr(31), c_mktsegment)) AS row_hash FROM customer""",
    "score_table": f"""
        WITH p AS (SELECT c_custkey AS object_id, '{ONE_DAY}' AS snapshot_date, c_mktsegment AS model_id,
                   (c_acctbal + 1000e0) / 11000e0 AS probability FROM customer),
        s AS (SELECT *, cume_dist() OVER (PARTITION BY model_id ORDER BY probability) AS e FROM p)
        SELECT object_id, snapshot_date, model_id, e * 100 AS score, {index("e", TENTHS)} AS score_bucket, probability,
               {index("probability", TENTHS)} AS probability_bucket FROM s""",
}
