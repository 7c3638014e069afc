"""DuckDB twins of the derived observation tables, as CTE bodies.

``with_ctes(sql, 'raw_obs', ...)`` prefixes a query with the CTEs it needs
(dependencies resolved), so every oracle string is self-contained over the
pre-registered base views.
"""

from __future__ import annotations


def H(expr: str) -> str:
    return f"cast('0x' || substr(md5({expr}), 1, 8) as bigint)"


_RAW_H = H("concat_ws('-', 'c', c_custkey)")
_LINE_H = H("concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber)")
_SIGNAL = "(l_quantity * 0.04 + l_discount * 5 + l_tax * 5)"

CTES: dict[str, tuple[str, list[str]]] = {
    "raw_h": (f"SELECT *, {_RAW_H} AS h FROM customer", []),
    "raw_obs": ("""
SELECT c_custkey AS row_id,
       CASE WHEN c_acctbal < 0 THEN 'Yes' ELSE 'No' END AS churn,
       CASE WHEN h % 10 = 0 THEN NULL ELSE c_acctbal END AS monthly_revenue,
       CAST(h % 4 AS INTEGER) AS retention_calls,
       CASE WHEN h % 7 = 0 THEN NULL WHEN h % 2 = 0 THEN 'Yes' ELSE 'No' END AS has_credit_card,
       CASE WHEN h % 3 = 0 THEN 'Known' ELSE 'Unknown' END AS homeownership,
       CASE WHEN h % 5 = 0 THEN 'Unknown' ELSE CAST((h % 50) * 10 AS VARCHAR) END AS handset_price,
       CASE WHEN h % 11 = 0 THEN NULL ELSE 'AREA' || lpad(CAST(h % 1000 AS VARCHAR), 3, '0') END AS service_area,
       CAST(h % 7 + 1 AS VARCHAR) || '-Level' AS credit_rating,
       c_mktsegment AS occupation
FROM raw_h""", ["raw_h"]),
    "churn_agg": ("""
SELECT o_custkey AS c_custkey,
       count(*) FILTER (WHERE CAST(o_orderdate AS DATE) < DATE '2000-11-04') AS n_orders,
       sum(o_totalprice) FILTER (WHERE CAST(o_orderdate AS DATE) < DATE '2000-11-04') AS spend_raw,
       count(*) FILTER (WHERE CAST(o_orderdate AS DATE) < DATE '2000-11-04'
                        AND o_orderpriority = '1-URGENT') AS n_urgent,
       max(CAST(o_orderdate AS DATE)) FILTER (WHERE CAST(o_orderdate AS DATE) < DATE '2000-11-04') AS last_before,
       count(*) FILTER (WHERE CAST(o_orderdate AS DATE) >= DATE '2000-11-04') AS n_after
FROM orders GROUP BY o_custkey""", []),
    "churn_obs": ("""
SELECT c.c_custkey AS row_id, c.c_acctbal, c.c_nationkey, c.c_mktsegment,
       CAST(coalesce(a.n_orders, 0) AS BIGINT) AS n_orders,
       coalesce(round(a.spend_raw, 2), 0.0) AS spend,
       CAST(coalesce(a.n_urgent, 0) AS BIGINT) AS n_urgent,
       CAST(coalesce(date_diff('day', a.last_before, DATE '2000-11-04'), 9999) AS INTEGER) AS recency,
       CASE WHEN coalesce(a.n_after, 0) = 0 THEN 1 ELSE 0 END AS label
FROM customer c LEFT JOIN churn_agg a ON c.c_custkey = a.c_custkey""", ["churn_agg"]),
    "line_obs": (f"""
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, h,
       l_quantity, l_extendedprice, l_discount, l_tax,
       CASE WHEN {_SIGNAL} + h / CAST(4294967295 AS DOUBLE) > 2.3 THEN 1 ELSE 0 END AS label
FROM (SELECT *, {_LINE_H} AS h FROM lineitem)""", []),
    "scored_obs": (f"""
SELECT concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber) AS row_id, l_extendedprice,
       CASE WHEN {_SIGNAL} + {_LINE_H} / CAST(4294967295 AS DOUBLE) > 2.3 THEN 1 ELSE 0 END AS label,
       round(1.0 / (1.0 + exp(-({_SIGNAL} - 1.9))), 6) AS p
FROM lineitem""", []),
    "embeddings_obs": ("SELECT vec_id AS row_id, embedding, label FROM embeddings", []),
}


def register(name: str, body: str, deps: list[str] | None = None) -> None:
    CTES[name] = (body, deps or [])


def with_ctes(sql: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in CTES[n][1]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    parts = [f"{n} AS ({CTES[n][0].strip()})" for n in order]
    parts += [f"{n} AS ({body.strip()})" for n, body in (extra or [])]
    if not parts:
        return sql.strip()
    return "WITH " + ",\n".join(parts) + "\n" + sql.strip()


def split_body(src: str, key: str = "row_id", size: float = 0.333, seed: int = 1337,
               out: str = "is_test") -> str:
    """Twin of ``split_holdout``: the ceil(size * n) smallest (hash, key)."""
    h = H(f"concat_ws('-', {key}, {seed})")
    return (f"SELECT *, CASE WHEN row_number() OVER (ORDER BY {h}, {key}) "
            f"<= ceil({size} * count(*) OVER ()) THEN 1 ELSE 0 END AS {out} FROM {src}")


# score transform 1 / ln(clip(p)) and its class medians, over scored_obs
EPS_SQL = "1e-15"
register("scored_s", f"""
SELECT row_id, label, p, 1.0 / ln(least(greatest(p, {EPS_SQL}), 1 - {EPS_SQL})) AS s
FROM scored_obs""", ["scored_obs"])
register("class_medians", """
SELECT quantile_cont(s, 0.5) FILTER (WHERE label = 0) AS med0,
       quantile_cont(s, 0.5) FILTER (WHERE label = 1) AS med1
FROM scored_s""", ["scored_s"])
register("churn_split", split_body("churn_obs"), ["churn_obs"])
