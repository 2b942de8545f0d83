"""Independent SQL answers (DuckDB dialect) for the registered queries.
Same column names, same rounding; tables are the driver's views."""

from __future__ import annotations

from .catalog import FLAG_SCORE, PRIORITY_SCORE, RIDGE_ALPHAS, TYPE_SCORE


def _h(x: str, k: int, seed: int = 42) -> str:
    return (f"CAST((('0x' || substr(md5(CAST({x} AS VARCHAR) || ':{seed}'), 1, 8))::BIGINT % {k}) "
            "AS INTEGER)")


def _case(col: str, m: dict) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {float(v)}" for k, v in m.items() if k != "None")
    none = float(m.get("None", 0))
    return f"(CASE coalesce({col}, 'None') {whens} WHEN 'None' THEN {none} ELSE 0.0 END)::DOUBLE"


def _r(x: str, n: int = 6) -> str:
    return f"(round({x}, {n}) + 0.0)"


LI_KEY = "(l_orderkey * 8 + l_linenumber)"
DOCS = "(SELECT d.doc_id, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"
QB = ("(SELECT quantile_cont(l_extendedprice, 0.001) AS lo, quantile_cont(l_extendedprice, 0.999) AS hi "
      "FROM lineitem)")


def _corr_union(cols, table, upper_only=False):
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            if upper_only and j <= i:
                continue
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM {table}")
    return " UNION ALL ".join(parts)


def _cv_sql() -> str:
    alphas = ", ".join(str(float(a)) for a in RIDGE_ALPHAS)
    return f"""
    WITH d AS (SELECT l_quantity AS x, l_extendedprice AS y, {_h(LI_KEY, 5)} AS fold FROM lineitem),
    a AS (SELECT unnest([{alphas}]::DOUBLE[]) AS alpha),
    f AS (SELECT unnest([0, 1, 2, 3, 4]) AS fold),
    t AS (SELECT f.fold, count(*) AS n, avg(x) AS mx, avg(y) AS my,
                 var_pop(x) * count(*) AS sxx, covar_pop(x, y) * count(*) AS sxy
          FROM d JOIN f ON d.fold <> f.fold GROUP BY f.fold),
    m AS (SELECT a.alpha, t.fold, t.sxy / (t.sxx + a.alpha) AS b,
                 t.my - t.sxy / (t.sxx + a.alpha) * t.mx AS c FROM t, a),
    e AS (SELECT m.alpha, m.fold, m.b, m.c, sqrt(avg((d.y - m.c - m.b * d.x) ^ 2)) AS rmse
          FROM d JOIN m ON d.fold = m.fold GROUP BY m.alpha, m.fold, m.b, m.c)
    """


def _enet_sql(ratio: float) -> str:
    r = float(ratio)
    return f"""
    WITH s AS (SELECT covar_pop(p_size, p_retailprice) / stddev_pop(p_size) AS c, stddev_pop(p_size) AS sd,
                      avg(p_size) AS mx, avg(p_retailprice) AS my FROM part),
    g AS (SELECT i, abs(c) / {r} * pow(10.0, -3.0 * i / 99.0) AS alpha FROM s, range(100) t(i)),
    w AS (SELECT g.i, g.alpha, sign(s.c) * greatest(abs(s.c) - g.alpha * {r}, 0.0)
                 / (1.0 + g.alpha * (1.0 - {r})) / s.sd AS coef, s.mx, s.my FROM g, s)
    SELECT CAST(i AS INTEGER) AS alpha_idx, {_r('alpha')} AS alpha, {_r('coef')} AS coef,
           {_r('my - coef * mx')} AS intercept FROM w
    """


SCORE_FIT = (f"(SELECT regr_slope(ln(1 + p_retailprice), p_size) AS b, "
             f"regr_intercept(ln(1 + p_retailprice), p_size) AS a FROM part "
             f"WHERE NOT ({_h('p_partkey', 10000)} < 5000))")
RIDGE_FIT = (f"(SELECT covar_pop(p_size, ln(1 + p_retailprice)) * count(*) / (var_pop(p_size) * count(*) + 1000.0) AS b, "
             f"avg(ln(1 + p_retailprice)) - covar_pop(p_size, ln(1 + p_retailprice)) * count(*) / "
             f"(var_pop(p_size) * count(*) + 1000.0) * avg(p_size) AS a FROM part "
             f"WHERE NOT ({_h('p_partkey', 10000)} < 5000))")

LI_NUM = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
RANK_FEATS = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]


def _rank_sql(k=None) -> str:
    parts = [f"SELECT '{c}' AS feature, corr(l_extendedprice, {c}) AS r FROM lineitem"
             for c in ["l_extendedprice"] + RANK_FEATS]
    where = f"WHERE rank <= {k}" if k is not None else ""
    return f"""SELECT feature, {_r('r')} AS r, rank FROM (
      SELECT feature, r, CAST(row_number() OVER (ORDER BY abs(r) DESC,
             CASE WHEN feature = 'l_extendedprice' THEN 0 ELSE 1 END, feature) - 1 AS INTEGER) AS rank
      FROM ({' UNION ALL '.join(parts)}) WHERE r IS NOT NULL) {where}"""


def _card_sql() -> str:
    cols = ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]
    parts = [f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct FROM part" for c in cols]
    return (f"SELECT \"column\", n_distinct, CAST(n_distinct >= 2 AND n_distinct <= 50 AS INTEGER) AS kept "
            f"FROM ({' UNION ALL '.join(parts)})")


def _knn_sql(weights: str, metric: str) -> str:
    if metric == "manhattan":
        dist = "list_sum([abs(q.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) for i in range(1, len(q.embedding) + 1)])"
    else:
        dist = "sqrt(list_sum([(q.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ^ 2 for i in range(1, len(q.embedding) + 1)]))"
    pred = ("avg(label)" if weights == "uniform" else
            "CASE WHEN sum(CASE WHEN dist = 0 THEN 1 ELSE 0 END) > 0 "
            "THEN avg(CASE WHEN dist = 0 THEN label END) "
            "ELSE sum(label / dist) / sum(1.0 / dist) END")
    return f"""
    WITH e AS (SELECT vec_id, embedding, CAST(label AS DOUBLE) AS label,
                      {_h('vec_id', 10000)} < 5000 AS is_q FROM embeddings),
    q AS (SELECT * FROM e WHERE is_q), b AS (SELECT * FROM e WHERE NOT is_q),
    d AS (SELECT q.vec_id, b.vec_id AS bid, b.label, {dist} AS dist FROM q, b),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY dist, bid) AS rn FROM d)
    SELECT vec_id, {_r(pred)} AS prediction FROM r WHERE rn <= 5 GROUP BY vec_id
    """


ORACLE = {
    "quantile_trim": f"""SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem, {QB} q
        WHERE l_extendedprice >= q.lo AND l_extendedprice <= q.hi""",
    "exclude_rule": f"""SELECT doc_id, n_chars, quality FROM {DOCS} j
        WHERE n_chars < 20000 AND NOT coalesce(quality = 0 AND n_chars > 3000, false)""",
    "outlier_report": f"""SELECT n_rows, n_trim_low, n_trim_high, n_cap, n_rule, n_removed,
        n_rows - n_removed AS n_kept FROM (
        SELECT count(*) AS n_rows,
          CAST(sum(CASE WHEN l_extendedprice < lo THEN 1 ELSE 0 END) AS BIGINT) AS n_trim_low,
          CAST(sum(CASE WHEN l_extendedprice > hi THEN 1 ELSE 0 END) AS BIGINT) AS n_trim_high,
          CAST(sum(CASE WHEN NOT (l_quantity < 49) THEN 1 ELSE 0 END) AS BIGINT) AS n_cap,
          CAST(sum(CASE WHEN l_discount < 0.02 AND l_quantity > 45 THEN 1 ELSE 0 END) AS BIGINT) AS n_rule,
          CAST(sum(CASE WHEN l_extendedprice < lo OR l_extendedprice > hi OR NOT (l_quantity < 49)
                   OR (l_discount < 0.02 AND l_quantity > 45) THEN 1 ELSE 0 END) AS BIGINT) AS n_removed
        FROM lineitem, {QB} q)""",
    "prune_columns": "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer",
    "drop_missing": f"SELECT doc_id, CAST(quality AS DOUBLE) AS quality FROM {DOCS} j WHERE quality IS NOT NULL",
    "clip_lower": f"SELECT event_id, {_r('greatest(value - 50.0, 0.0)')} AS clipped FROM events",
    "shape_report": f"""SELECT rows_before, rows_after, rows_before - rows_after AS rows_removed,
        11 AS cols_before, 10 AS cols_after FROM
        (SELECT count(*) AS rows_before FROM lineitem) a,
        (SELECT count(*) AS rows_after FROM lineitem, {QB} q
         WHERE l_extendedprice >= q.lo AND l_extendedprice <= q.hi) b""",
    "preview": """SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem
        ORDER BY l_orderkey, l_linenumber, l_extendedprice LIMIT 5""",
    "normalize_nulls": """SELECT conv_id, turn, role,
        CASE WHEN text IS NULL OR text IN ('', '#N/A', '#N/A N/A', '#NA', '-1.#IND', '-1.#QNAN',
          '-NaN', '-nan', '1.#IND', '1.#QNAN', '<NA>', 'N/A', 'NA', 'NULL', 'NaN', 'None', 'n/a',
          'nan', 'null') THEN 1 ELSE 0 END AS text_is_null FROM conversations""",
    "zero_fill": f"SELECT doc_id, coalesce(quality, 0) AS quality, coalesce(toxic, 0) AS toxic FROM {DOCS} j",
    "constant_impute": f"SELECT doc_id, coalesce(CAST(quality AS VARCHAR), 'None') AS quality_cat FROM {DOCS} j",
    "median_impute": f"""SELECT doc_id, coalesce(CAST(quality AS DOUBLE), mq) AS quality,
        coalesce(CAST(toxic AS DOUBLE), mt) AS toxic FROM {DOCS} j,
        (SELECT CAST(median(quality) AS DOUBLE) AS mq, CAST(median(toxic) AS DOUBLE) AS mt FROM {DOCS} k) m""",
    "targeted_impute": f"""SELECT doc_id, coalesce(CAST(quality AS DOUBLE), mq) AS quality,
        coalesce(CAST(toxic AS DOUBLE), 0.0) AS toxic FROM {DOCS} j,
        (SELECT CAST(median(quality) AS DOUBLE) AS mq FROM {DOCS} k) m""",
    "ordinal_encode": f"SELECT o_orderkey, {_case('o_orderpriority', PRIORITY_SCORE)} AS priority_score FROM orders",
    "weighted_score": f"""SELECT l_orderkey, l_linenumber, {_r('ws')} AS weighted_score,
        {_r('fin')} AS finished_sf, {_r('CASE WHEN fin > 0 THEN ws / fin ELSE 0.0 END')} AS avg_quality FROM (
        SELECT l_orderkey, l_linenumber,
          {_case('p_type', TYPE_SCORE)} * l_quantity + {_case('l_returnflag', FLAG_SCORE)} * (l_tax * 100.0) AS ws,
          l_quantity + l_tax * 100.0 AS fin
        FROM lineitem JOIN part ON l_partkey = p_partkey)""",
    "guarded_ratio": f"""SELECT l_orderkey, l_linenumber,
        {_r('CASE WHEN l_discount > 0 THEN l_tax / l_discount ELSE 0.0 END')} AS tax_per_discount FROM lineitem""",
    "quality_area": f"SELECT p_partkey, {_case('p_type', TYPE_SCORE)} * p_size AS quality_area FROM part",
    "sum_parts": f"""SELECT l_orderkey, l_linenumber,
        {_r('coalesce(l_quantity, 0) + coalesce(l_discount, 0) + coalesce(l_tax, 0)')} AS total_parts FROM lineitem""",
    "age_features": """SELECT l_orderkey, l_linenumber, CAST(ys - yc AS INTEGER) AS house_age,
        CAST(ren AS INTEGER) AS renovation_year, CAST(ys - greatest(yc, ren) AS INTEGER) AS years_since_mod FROM (
        SELECT l_orderkey, l_linenumber, year(l_shipdate) AS ys, year(o_orderdate) AS yc,
          coalesce(nullif(CASE WHEN l_returnflag = 'R' THEN 0 WHEN l_returnflag = 'A' THEN year(l_shipdate) - 1 END, 0),
                   year(o_orderdate)) AS ren
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey)""",
    "interaction": f"SELECT l_orderkey, l_linenumber, {_r('l_quantity * l_discount')} AS qty_x_disc FROM lineitem",
    "weighted_count": f"""SELECT l_orderkey, l_linenumber,
        {_r('l_quantity * 1.0 + l_linenumber * 0.5')} AS weighted_count FROM lineitem""",
    "log_features": f"SELECT event_id, {_r('ln(1 + coalesce(value, 0.0))')} AS value_log FROM events",
    "target_roundtrip": f"""SELECT event_id, {_r('ln(1 + value)')} AS y, {_r('exp(ln(1 + value)) - 1')} AS back
        FROM events""",
    "quality_index": f"""SELECT l_orderkey, l_linenumber,
        {_case('l_returnflag', FLAG_SCORE)} + {_case('l_linestatus', FLAG_SCORE)} AS flag_score FROM lineitem""",
    "standardize": "SELECT l_orderkey, l_linenumber, " + ", ".join(
        f"{_r(f'({c} - (SELECT avg({c}) FROM lineitem)) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1 ELSE stddev_pop({c}) END FROM lineitem)')} AS z_{c}"
        for c in ["l_quantity", "l_discount", "l_tax"]) + " FROM lineitem",
    "one_hot": "SELECT c_custkey, " + ", ".join(
        f"CASE WHEN c_mktsegment = '{v}' THEN 1.0 ELSE 0.0 END::DOUBLE AS c_mktsegment_{v}"
        for v in ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]) + " FROM customer",
    "ordinal_codes": f"""WITH tr AS (SELECT DISTINCT p_brand FROM part
          WHERE p_brand IS NOT NULL AND NOT ({_h('p_partkey', 10000)} < 5000)),
        codes AS (SELECT p_brand, CAST(row_number() OVER (ORDER BY p_brand) - 1 AS INTEGER) AS code FROM tr)
        SELECT p.p_partkey, p.p_brand, coalesce(codes.code, -1) AS brand_code
        FROM part p LEFT JOIN codes USING (p_brand)""",
    "polynomial": f"""SELECT l_orderkey, l_linenumber, {_r('l_quantity')} AS l_quantity,
        {_r('l_quantity * l_quantity')} AS l_quantity_pow2, {_r('l_quantity * l_discount')} AS l_quantity_x_l_discount,
        {_r('l_discount')} AS l_discount, {_r('l_discount * l_discount')} AS l_discount_pow2 FROM lineitem""",
    "split": f"SELECT o_orderkey, CAST({_h('o_orderkey', 10000)} < 1500 AS INTEGER) AS is_test FROM orders",
    "kfold": f"SELECT o_orderkey, {_h('o_orderkey', 5)} AS fold FROM orders",
    "block_fold": "SELECT o_orderkey, CAST(ntile(5) OVER (ORDER BY o_orderkey) - 1 AS INTEGER) AS fold FROM orders",
    "rmse_r2": f"""WITH f AS (SELECT regr_slope(l_extendedprice, l_quantity) AS b,
                             regr_intercept(l_extendedprice, l_quantity) AS a FROM lineitem),
        p AS (SELECT l_extendedprice AS y, a + b * l_quantity AS p FROM lineitem, f)
        SELECT count(*) AS n, {_r('sqrt(avg((y - p) ^ 2))', 4)} AS rmse, {_r('avg(abs(y - p))', 4)} AS mae,
               {_r('1 - sum((y - p) ^ 2) / (count(*) * var_pop(y))')} AS r2 FROM p""",
    "cv_score": _cv_sql() + f"SELECT alpha, {_r('avg(rmse)', 4)} AS mean_rmse FROM e GROUP BY alpha",
    "ridge_path": _cv_sql() + f"""SELECT alpha, fold, {_r('b')} AS coef, {_r('c', 4)} AS intercept,
        {_r('rmse', 4)} AS val_rmse FROM e""",
    "select_model": """WITH s AS (SELECT count(*) AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my,
            var_pop(l_quantity) * count(*) AS sxx, covar_pop(l_quantity, l_extendedprice) * count(*) AS sxy
            FROM lineitem),
        m AS (SELECT 'ols' AS model, 0 AS is_tuned, sxy / sxx AS b, my - sxy / sxx * mx AS c FROM s
              UNION ALL SELECT 'ridge', 1, sxy / (sxx + 1000.0), my - sxy / (sxx + 1000.0) * mx FROM s),
        e AS (SELECT model, is_tuned, sqrt(avg((l_extendedprice - c - b * l_quantity) ^ 2)) AS rmse
              FROM lineitem, m GROUP BY model, is_tuned)
        SELECT model, CAST(is_tuned AS INTEGER) AS is_tuned, (round(rmse, 4) + 0.0) AS rmse FROM e
        ORDER BY e.rmse, is_tuned, model LIMIT 1""",
    "ols": f"""WITH s AS (SELECT covar_pop(l_quantity, l_quantity) AS s11, covar_pop(l_discount, l_discount) AS s22,
            covar_pop(l_quantity, l_discount) AS s12, covar_pop(l_quantity, l_extendedprice) AS s1y,
            covar_pop(l_discount, l_extendedprice) AS s2y, avg(l_quantity) AS m1, avg(l_discount) AS m2,
            avg(l_extendedprice) AS my FROM lineitem),
        b AS (SELECT (s22 * s1y - s12 * s2y) / (s11 * s22 - s12 * s12) AS b1,
                     (s11 * s2y - s12 * s1y) / (s11 * s22 - s12 * s12) AS b2, m1, m2, my FROM s)
        SELECT 'intercept' AS term, {_r('my - b1 * m1 - b2 * m2', 4)} AS coef FROM b
        UNION ALL SELECT 'l_quantity', {_r('b1', 4)} FROM b
        UNION ALL SELECT 'l_discount', {_r('b2', 4)} FROM b""",
    "loo": f"""WITH s AS (SELECT count(*) AS n, avg(p_size) AS mx, avg(p_retailprice) AS my,
            var_pop(p_size) * count(*) AS sxx, covar_pop(p_size, p_retailprice) * count(*) AS sxy FROM part),
        m AS (SELECT n, mx, sxx, sxy / (sxx + 10.0) AS b, my - sxy / (sxx + 10.0) * mx AS a FROM s)
        SELECT p_partkey, {_r('(p_retailprice - a - b * p_size) / (1 - 1.0 / n - (p_size - mx) ^ 2 / (sxx + 10.0))')}
            AS loo_residual FROM part, m""",
    "loo_no_intercept": f"""WITH s AS (SELECT sum(p_size * p_size) AS sxx, sum(p_size * p_retailprice) AS sxy FROM part),
        m AS (SELECT sxx + 10.0 AS a, sxy / (sxx + 10.0) AS b FROM s)
        SELECT p_partkey, {_r('(p_retailprice - b * p_size) / (1 - p_size * p_size / a)')} AS loo_residual FROM part, m""",
    "scaled_polynomial": f"""WITH s AS (SELECT avg(l_quantity) AS mq, stddev_pop(l_quantity) AS sq,
            avg(l_discount) AS md, stddev_pop(l_discount) AS sd FROM lineitem),
        z AS (SELECT l_orderkey, l_linenumber, (l_quantity - mq) / sq AS q, (l_discount - md) / sd AS d FROM lineitem, s)
        SELECT l_orderkey, l_linenumber, {_r('q')} AS l_quantity, {_r('d')} AS l_discount, {_r('q * q')} AS l_quantity_pow2,
               {_r('q * d')} AS l_quantity_x_l_discount, {_r('d * d')} AS l_discount_pow2 FROM z""",
    "impute_nan": f"""WITH x AS (SELECT p_partkey, CASE WHEN p_size = 7 THEN NULL ELSE p_retailprice / p_size END AS v FROM part)
        SELECT p_partkey, {_r('coalesce(v, (SELECT median(v) FROM x))')} AS v FROM x""",
    "csv_types": """SELECT p_partkey AS k, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size END::BIGINT AS n,
        CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size / 4.0 END::DOUBLE AS x,
        CASE WHEN p_size % 3 = 0 THEN ' NA ' ELSE p_type END AS s FROM part""",
    "select_refit": f"""WITH x AS (SELECT p_partkey, p_size::DOUBLE AS x, p_retailprice AS y,
            {_h('p_partkey', 10000, 43)} < 1500 AS val FROM part),
        c(model, alpha) AS (VALUES ('baseline', 0.0::DOUBLE), ('ridge_100', 100.0), ('ridge_100000', 100000.0)),
        s AS (SELECT count(*) AS n, avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS sxx,
                     covar_pop(x, y) * count(*) AS sxy FROM x WHERE NOT val),
        f AS (SELECT model, alpha, sxy / (sxx + alpha) AS b, my - sxy / (sxx + alpha) * mx AS a FROM c, s),
        v AS (SELECT model, alpha, sqrt(avg((y - a - b * x) ^ 2)) AS rmse FROM f, x WHERE val GROUP BY model, alpha),
        r AS (SELECT *, row_number() OVER (ORDER BY rmse, alpha) = 1 AS chosen FROM v),
        t AS (SELECT avg(x) AS mx, avg(y) AS my, var_pop(x) * count(*) AS sxx, covar_pop(x, y) * count(*) AS sxy FROM x)
        SELECT model, {_r('rmse', 4)} AS val_rmse, chosen,
               CASE WHEN chosen THEN {_r('sxy / (sxx + alpha)')} END AS refit_coef,
               CASE WHEN chosen THEN {_r('my - sxy / (sxx + alpha) * mx', 4)} END AS refit_intercept FROM r, t""",
    "loo_summary": f"""WITH s AS (SELECT count(*) AS n, avg(p_size) AS mx, avg(p_retailprice) AS my,
            var_pop(p_size) * count(*) AS sxx, covar_pop(p_size, p_retailprice) * count(*) AS sxy FROM part),
        m AS (SELECT n, mx, sxx, sxy / (sxx + 10.0) AS b, my - sxy / (sxx + 10.0) * mx AS a FROM s),
        r AS (SELECT (p_retailprice - a - b * p_size) / (1 - 1.0 / n - (p_size - mx) ^ 2 / (sxx + 10.0)) AS e
              FROM part, m)
        SELECT count(*) AS n, {_r('avg(abs(e))')} AS loo_mae, {_r('sqrt(avg(e * e))')} AS loo_rmse FROM r""",
    "lasso_1d": _enet_sql(1.0),
    "elastic_net_1d": _enet_sql(0.5),
    "corr_matrix": f"SELECT a, b, {_r('r')} AS r FROM ({_corr_union(LI_NUM, 'lineitem')})",
    "corr_rank": _rank_sql(),
    "corr_topk": _rank_sql(2),
    "corr_pairs": f"""SELECT a, b, {_r('r')} AS r FROM ({_corr_union(['p_partkey', 'p_size', 'p_retailprice'], 'part', True)})
        WHERE abs(r) > 0.4""",
    "cardinality_gate": _card_sql(),
    "group_median": f"SELECT p_type, {_r('median(p_retailprice)')} AS median FROM part WHERE p_type IS NOT NULL GROUP BY p_type",
    "box_stats": f"""WITH q AS (SELECT p_brand, quantile_cont(p_retailprice, 0.25) AS q1,
            quantile_cont(p_retailprice, 0.5) AS median, quantile_cont(p_retailprice, 0.75) AS q3
            FROM part WHERE p_brand IS NOT NULL GROUP BY p_brand)
        SELECT q.p_brand, {_r('q1')} AS q1, {_r('median')} AS median, {_r('q3')} AS q3, {_r('q3 - q1')} AS iqr,
          {_r('min(CASE WHEN p_retailprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN p_retailprice END)')} AS whisker_lo,
          {_r('max(CASE WHEN p_retailprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN p_retailprice END)')} AS whisker_hi,
          count(*) AS n,
          CAST(sum(CASE WHEN p_retailprice BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN 0 ELSE 1 END) AS BIGINT) AS n_fliers
        FROM part JOIN q USING (p_brand) WHERE p_retailprice IS NOT NULL GROUP BY q.p_brand, q1, median, q3""",
    "scatter_bins": """WITH r AS (SELECT min(l_quantity) AS x0, max(l_quantity) AS x1,
            min(l_extendedprice) AS y0, max(l_extendedprice) AS y1 FROM lineitem)
        SELECT CAST(least(floor((l_quantity - x0) / (x1 - x0) * 10), 9) AS INTEGER) AS x_bin,
               CAST(least(floor((l_extendedprice - y0) / (y1 - y0) * 10), 9) AS INTEGER) AS y_bin,
               count(*) AS n FROM lineitem, r GROUP BY ALL""",
    "score_table": f"""SELECT p_partkey, {_r('greatest(exp(a + b * p_size) - 1, 0.0)', 4)} AS prediction
        FROM part, {SCORE_FIT} f""",
    "compare_runs": f"""WITH p AS (SELECT p_partkey, f.a + f.b * p_size AS pa, r.a + r.b * p_size AS pb
            FROM part, {SCORE_FIT} f, {RIDGE_FIT} r)
        SELECT count(*) AS n_matched, CAST(0 AS BIGINT) AS n_unmatched,
          {_r('avg(abs(pa - pb))')} AS mean_abs_diff, {_r('max(abs(pa - pb))')} AS max_abs_diff,
          {_r('min(pa)')} AS min_a, {_r('avg(pa)')} AS mean_a, {_r('max(pa)')} AS max_a,
          {_r('min(pb)')} AS min_b, {_r('avg(pb)')} AS mean_b, {_r('max(pb)')} AS max_b FROM p""",
    "knn_uniform": _knn_sql("uniform", "euclidean"),
    "knn_distance": _knn_sql("distance", "euclidean"),
    "knn_manhattan": _knn_sql("uniform", "manhattan"),
}

ORACLE.update({
    "fliers": """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3
            FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL GROUP BY event_type)
        SELECT event_id, e.event_type, value FROM events e JOIN q USING (event_type)
        WHERE NOT (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))""",
    "prune_correlated": "SELECT p_partkey, p_size FROM part",
    "feature_names": """SELECT 0 AS idx, 'num__c_acctbal' AS name UNION ALL
        SELECT CAST(row_number() OVER (ORDER BY c_mktsegment) AS INTEGER) AS idx,
               'cat__c_mktsegment_' || c_mktsegment AS name
        FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_mktsegment IS NOT NULL)""",
    "score_stream": ORACLE["score_table"],
})

ORACLE.update({
    "read_fallback": "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer",
    "write_predictions": ORACLE["score_table"],
    "corr_submatrix": f"SELECT a, b, {_r('r')} AS r FROM ({_corr_union(['l_quantity', 'l_extendedprice'], 'lineitem')})",
})

_PT = """(SELECT l.l_extendedprice AS HotelValue, p.p_type AS PropertyType, p.p_brand AS Brand,
           l.l_returnflag AS ReturnFlag, o.o_orderpriority AS Priority
    FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey JOIN orders o ON l.l_orderkey = o.o_orderkey)"""


def _box_sql(col: str) -> str:
    inside = "HotelValue BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)"
    return f"""SELECT '{col}' AS "column", {col} AS level, {_r('q1', 4)} AS q1, {_r('median', 4)} AS median,
        {_r('q3', 4)} AS q3, {_r(f'min(CASE WHEN {inside} THEN HotelValue END)', 4)} AS whisker_lo,
        {_r(f'max(CASE WHEN {inside} THEN HotelValue END)', 4)} AS whisker_hi, count(*) AS n,
        CAST(sum(CASE WHEN {inside} THEN 0 ELSE 1 END) AS BIGINT) AS n_fliers
      FROM {_PT} t JOIN (SELECT {col} AS k, quantile_cont(HotelValue, 0.25) AS q1,
        quantile_cont(HotelValue, 0.5) AS median, quantile_cont(HotelValue, 0.75) AS q3
        FROM {_PT} s WHERE {col} IS NOT NULL GROUP BY {col}) q ON t.{col} = q.k
      GROUP BY {col}, q1, median, q3"""


ORACLE["outlier_eda"] = " UNION ALL ".join(_box_sql(c) for c in ["PropertyType", "Brand", "ReturnFlag", "Priority"])


# LassoCV in one dimension: contiguous folds, per-fold standardisation,
# soft-threshold solution per (fold, alpha), held-out MSE, argmin of the mean.
ORACLE["lasso_cv"] = """
WITH d AS (SELECT p_partkey, p_size AS x, p_retailprice AS y,
                  CAST(ntile(5) OVER (ORDER BY p_partkey) - 1 AS INTEGER) AS fold FROM part),
f AS (SELECT DISTINCT fold FROM d),
s AS (SELECT f.fold, covar_pop(x, y) / stddev_pop(x) AS c, stddev_pop(x) AS sd, avg(x) AS mx, avg(y) AS my
      FROM d JOIN f ON d.fold <> f.fold GROUP BY f.fold),
a AS (SELECT i, abs(covar_pop(x, y) / stddev_pop(x)) * pow(10.0, -3.0 * i / 99.0) AS alpha
      FROM d, range(100) t(i) GROUP BY i),
m AS (SELECT a.i, a.alpha, s.fold, sign(s.c) * greatest(abs(s.c) - a.alpha, 0.0) / s.sd AS coef, s.mx, s.my
      FROM a, s),
e AS (SELECT m.i, m.alpha, m.fold, avg((d.y - (m.my - m.coef * m.mx) - m.coef * d.x) ^ 2) AS mse
      FROM m JOIN d ON d.fold = m.fold GROUP BY m.i, m.alpha, m.fold),
v AS (SELECT i, alpha, avg(mse) AS mse FROM e GROUP BY i, alpha)
SELECT CAST(i AS INTEGER) AS alpha_idx, (round(alpha, 6) + 0.0) AS alpha, (round(mse, 6) + 0.0) AS mse,
       CAST(row_number() OVER (ORDER BY mse, i) = 1 AS INTEGER) AS chosen FROM v"""


# Elastic-net CV path table in one dimension (ratio x alpha x fold held-out MSE).
ORACLE["elastic_net_cv"] = """
WITH d AS (SELECT p_size AS x, p_retailprice AS y,
                  CAST(ntile(5) OVER (ORDER BY p_partkey) - 1 AS INTEGER) AS fold FROM part),
f AS (SELECT DISTINCT fold FROM d),
s AS (SELECT f.fold, covar_pop(x, y) / stddev_pop(x) AS c, stddev_pop(x) AS sd, avg(x) AS mx, avg(y) AS my
      FROM d JOIN f ON d.fold <> f.fold GROUP BY f.fold),
r AS (SELECT unnest([0.1, 0.5, 0.7, 0.9, 0.95, 0.99, 1.0]::DOUBLE[]) AS l1_ratio),
a AS (SELECT r.l1_ratio, t.i, abs(g.c) / r.l1_ratio * pow(10.0, -3.0 * t.i / 99.0) AS alpha
      FROM (SELECT covar_pop(x, y) / stddev_pop(x) AS c FROM d) g, r, range(100) t(i)),
m AS (SELECT a.l1_ratio, a.i, a.alpha, s.fold, s.mx, s.my,
             sign(s.c) * greatest(abs(s.c) - a.alpha * a.l1_ratio, 0.0) / (1.0 + a.alpha * (1.0 - a.l1_ratio))
             / s.sd AS coef FROM a, s),
e AS (SELECT m.l1_ratio, m.i, m.alpha, m.fold, avg((d.y - (m.my - m.coef * m.mx) - m.coef * d.x) ^ 2) AS mse
      FROM m JOIN d ON d.fold = m.fold GROUP BY m.l1_ratio, m.i, m.alpha, m.fold)
SELECT l1_ratio, CAST(i AS INTEGER) AS alpha_idx, (round(alpha, 6) + 0.0) AS alpha, fold,
       (round(mse, 6) + 0.0) AS mse FROM e"""


# k-NN grid: one ranked neighbour list per metric, every (k, weights) from it.
_EU = "sqrt(list_sum([(q.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) ^ 2 for i in range(1, len(q.embedding) + 1)]))"
_MA = "list_sum([abs(q.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) for i in range(1, len(q.embedding) + 1)])"
ORACLE["knn_grid"] = f"""
WITH e AS (SELECT vec_id, embedding, CAST(label AS DOUBLE) AS label,
                  {_h('vec_id', 10000)} < 5000 AS is_q FROM embeddings),
q AS (SELECT * FROM e WHERE is_q), b AS (SELECT * FROM e WHERE NOT is_q),
d AS (SELECT q.vec_id, q.label AS y, b.vec_id AS bid, b.label, {_EU} AS de, {_MA} AS dm FROM q, b),
u AS (SELECT 'euclidean' AS metric, vec_id, y, bid, label, de AS dist FROM d
      UNION ALL SELECT 'manhattan', vec_id, y, bid, label, dm FROM d),
r AS (SELECT *, row_number() OVER (PARTITION BY metric, vec_id ORDER BY dist, bid) AS rn FROM u),
ks AS (SELECT unnest([3, 5, 7, 10]) AS k),
p AS (SELECT r.metric, ks.k, r.vec_id, any_value(r.y) AS y, avg(r.label) AS pu,
             CASE WHEN sum(CASE WHEN r.dist = 0 THEN 1 ELSE 0 END) > 0
                  THEN avg(CASE WHEN r.dist = 0 THEN r.label END)
                  ELSE sum(r.label / r.dist) / sum(1.0 / r.dist) END AS pd
      FROM r JOIN ks ON r.rn <= ks.k GROUP BY r.metric, ks.k, r.vec_id)
SELECT metric, CAST(k AS INTEGER) AS k, 'uniform' AS weights, {_r('sqrt(avg((pu - y) ^ 2))')} AS rmse
FROM p GROUP BY metric, k
UNION ALL
SELECT metric, CAST(k AS INTEGER) AS k, 'distance' AS weights, {_r('sqrt(avg((pd - y) ^ 2))')} AS rmse
FROM p GROUP BY metric, k"""

# The wide property table, and the feature chain written out column by column.
_WIDE = """(
  SELECT *, CASE WHEN a % 5 <> 0 THEN s * 10.0 END AS BasementFacilitySF1,
         CASE WHEN s % 3 = 0 THEN 0.0 ELSE a * 2.0 END AS BasementFacilitySF2,
         CASE WHEN a % 5 <> 0 THEN s * 10.0 + a END AS BasementTotalSF,
         CASE WHEN s % 10 = 0 THEN a * 3.0 END AS SwimmingPoolArea,
         CASE WHEN a % 4 <> 0 THEN a * 1.0 END AS OpenVerandaArea, (s % 11) * 1.0 AS EnclosedVerandaArea,
         (a % 3) * 1.0 AS SeasonalPorchArea, CASE WHEN s % 2 = 1 THEN 5.0 + a % 7 END AS ScreenPorchArea,
         s * 8.0 + a AS ParkingArea, CASE WHEN s % 9 <> 0 THEN ConstructionYear END AS ParkingConstructionYear,
         CASE WHEN a % 6 <> 0 THEN (s % 13) * 1.0 END AS RoadAccessLength, (a * 4 + s % 4) * 1.0 AS FacadeArea,
         a % 4 AS FullBaths, s % 2 AS HalfBaths, a % 12 + 1 AS MonthSold, Brand AS FacadeType,
         (a * s % 17) * 1.0 AS LowQualityArea,
         list_extract(['GLQ', 'ALQ', 'BLQ', 'Rec', 'LwQ', 'Unf', NULL], a % 7 + 1) AS BasementFacilityType1,
         list_extract(['GLQ', 'ALQ', 'BLQ', 'Rec', 'LwQ', 'Unf', NULL], s % 7 + 1) AS BasementFacilityType2,
         list_extract(['Ex', 'Gd', 'Fa', NULL], a % 4 + 1) AS PoolQuality,
         list_extract(['Fin', 'RFn', 'Unf', NULL], a % 4 + 1) AS ParkingFinish,
         list_extract(['Typ', 'Min1', 'Min2', 'Mod', 'Maj1', 'Maj2', 'Sev', NULL], (a + s) % 8 + 1) AS PropertyFunctionality,
         list_extract(['Gd', 'Av', 'Mn', 'No', NULL], (a * s) % 5 + 1) AS BasementExposure,
         """ + ", ".join(f"list_extract(['Ex', 'Gd', 'TA', 'Fa', 'Po', NULL, 'ZZ'], ({x}) % 7 + 1) AS {c}" for c, x in {
             "ParkingQuality": "a", "ParkingCondition": "s", "ExteriorQuality": "a + 1", "ExteriorCondition": "s + 1",
             "BasementCondition": "a + 2", "KitchenQuality": "s + 2", "HeatingQuality": "a + s",
             "LoungeQuality": "a + s + 1", "BasementHeight": "a + s + 2"}.items()) + """
  FROM (SELECT concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS Id, l_extendedprice AS HotelValue,
               l_quantity AS UsableArea, l_discount AS Discount, l_tax AS Tax, p_size AS LandArea, p_type AS PropertyType,
               p_brand AS Brand, l_returnflag AS ReturnFlag, o_orderpriority AS Priority,
               6 - CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS OverallQuality, year(l_shipdate) AS YearSold,
               year(o_orderdate) AS ConstructionYear,
               CASE l_returnflag WHEN 'R' THEN 0 WHEN 'A' THEN year(l_shipdate) - 1 END AS RenovationYear,
               CAST(l_quantity AS INTEGER) AS a, p_size AS s
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey))"""
_AS_IS = ["HotelValue", "UsableArea", "Discount", "Tax", "OverallQuality"]
_TEXTS = ["Id", "PropertyType", "Brand", "ReturnFlag", "Priority"]


def _five(c: str) -> str:
    return f"CASE {c} WHEN 'Ex' THEN 5.0 WHEN 'Gd' THEN 4.0 WHEN 'TA' THEN 3.0 WHEN 'Fa' THEN 2.0 WHEN 'Po' THEN 1.0 ELSE 0.0 END"


def _basement(c: str) -> str:
    return (f"CASE {c} WHEN 'GLQ' THEN 5.0 WHEN 'ALQ' THEN 4.0 WHEN 'BLQ' THEN 3.0 WHEN 'Rec' THEN 3.0 "
            "WHEN 'LwQ' THEN 2.0 WHEN 'Unf' THEN 1.0 ELSE 0.0 END")


_SF = "(coalesce(BasementFacilitySF1, 0.0) + BasementFacilitySF2)"
_SCORE = (f"({_basement('BasementFacilityType1')} * coalesce(BasementFacilitySF1, 0.0)"
          f" + {_basement('BasementFacilityType2')} * BasementFacilitySF2)")
_POOL = "CASE PoolQuality WHEN 'Ex' THEN 2.0 WHEN 'Fa' THEN 1.0 ELSE 0.0 END * coalesce(SwimmingPoolArea, 0.0)"
_PORCH3 = "EnclosedVerandaArea + SeasonalPorchArea + coalesce(ScreenPorchArea, 0.0)"
_PORCH4 = f"coalesce(OpenVerandaArea, 0.0) + {_PORCH3}"
_REPAIRED = "coalesce(nullif(RenovationYear, 0), ConstructionYear)"
_SINCE = f"(YearSold - greatest(ConstructionYear, {_REPAIRED}))"
_FIVE = ["ParkingQuality", "ParkingCondition", "ExteriorQuality", "ExteriorCondition", "BasementCondition", "KitchenQuality",
         "HeatingQuality"]
_MAPPED = {**{c: _five(c) for c in _FIVE},
           "ParkingFinish": "CASE ParkingFinish WHEN 'Fin' THEN 3.0 WHEN 'RFn' THEN 2.0 WHEN 'Unf' THEN 1.0 ELSE 0.0 END",
           "BasementExposure": "CASE BasementExposure WHEN 'Gd' THEN 4.0 WHEN 'Av' THEN 3.0 WHEN 'Mn' THEN 2.0 "
                               "WHEN 'No' THEN 1.0 ELSE 0.0 END",
           "PropertyFunctionality": "CASE PropertyFunctionality WHEN 'Typ' THEN 7.0 WHEN 'Min1' THEN 6.0 WHEN 'Min2' THEN 5.0 "
                                    "WHEN 'Mod' THEN 4.0 WHEN 'Maj1' THEN 3.0 WHEN 'Maj2' THEN 2.0 WHEN 'Sev' THEN 1.0 "
                                    "ELSE 0.0 END"}


def _ln(c: str) -> str:
    return f"ln(1 + coalesce({c}, 0))"


def _wide(numbers: dict, texts: list) -> str:
    return (f"SELECT {', '.join(texts)}, "
            + ", ".join(f"{_r(f'CAST({e} AS DOUBLE)')} AS {c}" for c, e in numbers.items()) + f" FROM {_WIDE}")


_SAME = {c: c for c in _AS_IS}
_DERIVED = {"TotalBasementScore": _SCORE, "BasementFinishedSF": _SF,
            "BasementAvgQuality": f"CASE WHEN {_SF} > 0 THEN {_SCORE} / {_SF} ELSE 0.0 END", "TotalPoolScore": _POOL,
            "TotalPorchArea": _PORCH4, "HouseAge": "YearSold - ConstructionYear", "YearsSinceModification": _SINCE}
_DEFAULT = {**_SAME, **{c: e for c, e in _DERIVED.items() if c not in ("BasementFinishedSF", "YearsSinceModification")},
            **_MAPPED, "RoadAccessLength": "RoadAccessLength", "FacadeArea": "FacadeArea", "FullBaths": "FullBaths",
            "HalfBaths": "HalfBaths", "BasementFinishedSF_Log": _ln(_SF),
            "YearsSinceModification_Log": f"CASE WHEN {_SINCE} > -1 THEN {_ln(f'greatest({_SINCE}, 0)')} END",
            **{f"{c}_Log": _ln(c) for c in ("ParkingConstructionYear", "LandArea", "BasementTotalSF", "ParkingArea")}}
ORACLE["engineer_default"] = _wide(_DEFAULT, [*_TEXTS, "LoungeQuality", "BasementHeight"])
_INDEX = " + ".join(_five(c) for c in ["ExteriorQuality", "ExteriorCondition", "KitchenQuality", "HeatingQuality",
                                       "BasementCondition", "LoungeQuality", "ParkingQuality"])
ORACLE["engineer_options"] = _wide(
    {**{c: c for c in _AS_IS if c != "UsableArea"}, "TotalBasementScore": _SCORE, "TotalPoolScore": _POOL,
     "TotalPorchArea": _PORCH3, "OpenVerandaArea": "OpenVerandaArea", "BasementHeight": _five("BasementHeight"),
     "TotalQualityScore": f"{_INDEX} + CASE BasementExposure WHEN 'Gd' THEN 4.0 ELSE 0.0 END",
     "HouseAge": "YearSold - ConstructionYear",
     "YearsSinceModification": "YearSold - greatest(ConstructionYear, RenovationYear)",
     "QualityArea": "OverallQuality * UsableArea", "TotalBathrooms": "FullBaths + 0.5 * HalfBaths",
     "HalfBaths": "HalfBaths", "FacadeArea": "FacadeArea", "ParkingConstructionYear": "ParkingConstructionYear",
     **{f"{c}_Log": _ln(c) for c in ("LandArea", "BasementTotalSF", "ParkingArea")}},
    [*_TEXTS, "ParkingCondition", "ParkingFinish", "PropertyFunctionality"])
_KEPT = {**{c: c for c in [
    *_AS_IS, "LandArea", "YearSold", "ConstructionYear", "RenovationYear", "BasementFacilitySF1", "BasementFacilitySF2",
    "BasementTotalSF", "SwimmingPoolArea", "OpenVerandaArea", "EnclosedVerandaArea", "SeasonalPorchArea", "ScreenPorchArea",
    "ParkingArea", "ParkingConstructionYear", "RoadAccessLength", "FacadeArea", "FullBaths", "HalfBaths", "MonthSold",
    "LowQualityArea"]},
    **{f"{c}_New": e for c, e in _DERIVED.items()}, **{f"{c}_Mapped": e for c, e in _MAPPED.items()},
    "BasementHeight_Mapped": _five("BasementHeight"),
    **{f"{c}_Log": _ln(c) for c in ("ParkingConstructionYear", "LandArea", "BasementTotalSF", "ParkingArea")}}
ORACLE["engineer_keep_originals"] = _wide(_KEPT, [
    *_TEXTS, "BasementFacilityType1", "BasementFacilityType2", "PoolQuality", "LoungeQuality", "BasementHeight", "FacadeType",
    *_MAPPED])

# Correlation workflow: trimmed rows, keep-originals features, log target.
_CE = ["HotelValue_Log"] + [c for c in _KEPT if c != "HotelValue"]
ORACLE["correlation_eda"] = f"""WITH w AS MATERIALIZED (SELECT * FROM {_WIDE}),
e AS MATERIALIZED (
  SELECT ln(1 + HotelValue) AS HotelValue_Log, {', '.join(f'({x})::DOUBLE AS {c}' for c, x in _KEPT.items() if c != 'HotelValue')}
  FROM w, (SELECT quantile_cont(HotelValue, 0.001) AS lo, quantile_cont(HotelValue, 0.999) AS hi FROM w) b
  WHERE HotelValue BETWEEN lo AND hi AND UsableArea < 4000 AND NOT coalesce(OverallQuality < 3, false)),
u AS ({' UNION ALL '.join(f"SELECT '{c}' AS feature, corr(HotelValue_Log, {c}) AS r FROM e" for c in _CE)})
SELECT feature, {_r('r')} AS r, CAST(row_number() OVER (ORDER BY abs(r) DESC,
       CASE WHEN feature = 'HotelValue_Log' THEN 0 ELSE 1 END, feature) - 1 AS INTEGER) AS rank
FROM u WHERE r IS NOT NULL AND NOT isnan(r)"""

# Bayesian ridge (one standardised feature): the evidence iterations replayed
# with a recursive CTE; stop when |w - w_prev| < 1e-3 after the first round.
_BAYES_CTE = """
WITH RECURSIVE s AS (SELECT count(*) AS n, var_pop(p_size) * count(*) AS cxx,
                            covar_pop(p_size, p_retailprice) * count(*) AS cxy,
                            var_pop(p_retailprice) * count(*) AS cyy, stddev_pop(p_size) AS sd,
                            avg(p_size) AS mx, avg(p_retailprice) AS my FROM part),
c AS (SELECT n, cxx / (sd * sd) AS a, cxy / sd AS b, cyy, sd, mx, my FROM s),
it(k, al, la, w_prev, done) AS (
  SELECT 0, CAST(1.0 AS DOUBLE) / (cyy / n + 2.220446049250313e-16), CAST(1.0 AS DOUBLE),
         CAST(NULL AS DOUBLE), false FROM c
  UNION ALL
  SELECT k + 1,
         (n - g + 2e-6) / (greatest(cyy - 2 * w * b + w * w * a, 0.0) + 2e-6),
         (g + 2e-6) / (w * w + 2e-6),
         w,
         k <> 0 AND abs(w_prev - w) < 1e-3
  FROM (SELECT it.k, it.w_prev, c.*, c.b / (c.a + it.la / it.al) AS w,
               it.al * c.a / (it.la + it.al * c.a) AS g
        FROM it, c WHERE NOT it.done AND it.k < 300) z
),
fin AS (SELECT c.b / (c.a + it.la / it.al) / c.sd AS coef, c.mx, c.my, it.al, it.la, it.k
        FROM it, c WHERE it.k = (SELECT max(k) FROM it))
"""
ORACLE["bayes_ridge"] = _BAYES_CTE + """SELECT p_partkey, (round(my - coef * mx + coef * p_size, 6) + 0.0) AS prediction
    FROM part, fin"""
ORACLE["fit_report"] = _BAYES_CTE + """SELECT 'alpha_' AS param, (round(al, 6) + 0.0) AS value FROM fin
    UNION ALL SELECT 'lambda_', (round(la, 6) + 0.0) FROM fin
    UNION ALL SELECT 'n_iter', CAST(k AS DOUBLE) FROM fin
    UNION ALL SELECT 'intercept', (round(my - coef * mx, 6) + 0.0) FROM fin
    UNION ALL SELECT 'p_size', (round(coef, 6) + 0.0) FROM fin"""


# One split over every distinct value of three columns: the largest decrease of the
# squared error (tree), or of the penalised second-order objective (boosting).
_STUMP = """
WITH d AS (SELECT l_quantity::DOUBLE AS a, l_discount::DOUBLE AS b, l_tax::DOUBLE AS c, l_extendedprice::DOUBLE / 1000.0 AS y FROM lineitem),
m AS (SELECT avg(y) AS my, count(*) AS n, sum(y) AS sy FROM d),
u AS (SELECT f, x, count(*) AS k, sum(y) AS s FROM (
          SELECT 1 AS f, a AS x, y FROM d UNION ALL SELECT 2, b, y FROM d UNION ALL SELECT 3, c, y FROM d) GROUP BY f, x),
l AS (SELECT f, x, sum(k) OVER w AS nl, sum(s) OVER w AS sl FROM u WINDOW w AS (PARTITION BY f ORDER BY x)),
g AS (SELECT f, x, nl, n - nl AS nr, sl - nl * my AS gl, (sy - sl) - (n - nl) * my AS gr, my, n FROM l, m WHERE nl < n),
"""
ORACLE["tree_stump"] = _STUMP + """
v AS (SELECT *, my + gl / nl AS pl, my + gr / nr AS pr FROM g ORDER BY gl * gl / nl + gr * gr / nr DESC, f, x LIMIT 1),
p AS (SELECT CASE WHEN (CASE v.f WHEN 1 THEN a WHEN 2 THEN b ELSE c END) <= v.x THEN pl ELSE pr END AS p, y FROM d, v)
SELECT (round(p, 6) + 0.0) AS prediction, count(*) AS n, (round(avg(y), 6) + 0.0) AS mean_y FROM p GROUP BY 1"""
ORACLE["boost_stump"] = _STUMP + """
t AS (SELECT *, sign(gl) * greatest(abs(gl) - 1000.0, 0.0) AS tl, sign(gr) * greatest(abs(gr) - 1000.0, 0.0) AS tr
      FROM g WHERE nl >= 50 AND nr >= 50),
v AS (SELECT *, tl * tl / (nl + 500.0) + tr * tr / (nr + 500.0) AS gain FROM t ORDER BY gain DESC, f, x LIMIT 1),
p AS (SELECT v.my + CASE WHEN v.gain <= 10.0 THEN 0.0
                         WHEN (CASE v.f WHEN 1 THEN a WHEN 2 THEN b ELSE c END) <= v.x THEN 0.3 * tl / (nl + 500.0)
                         ELSE 0.3 * tr / (nr + 500.0) END AS p, y FROM d, v)
SELECT (round(p, 6) + 0.0) AS prediction, count(*) AS n, (round(avg(y), 6) + 0.0) AS mean_y FROM p GROUP BY 1"""

# Ridge on the one-hot of one column in closed form: with the intercept b free of penalty,
# w_l = n_l (mean_l - b) / (n_l + a) and b balances n_l a / (n_l + a) (mean_l - b).
ORACLE["sparse_ridge"] = f"""
WITH g AS (SELECT l_partkey, count(*) AS n, avg(l_extendedprice / 1000.0) AS m FROM lineitem GROUP BY l_partkey),
b AS (SELECT sum(n * 5.0 / (n + 5.0) * m) / sum(n * 5.0 / (n + 5.0)) AS b FROM g)
SELECT l_partkey, n, {_r('n * (m - b) / (n + 5.0)')} AS coef, {_r('b')} AS intercept FROM g, b"""
ORACLE["sparse_ridge_search"] = f"""
WITH d AS (SELECT l_partkey, l_extendedprice / 1000.0 AS y, {_h('(l_orderkey * 8 + l_linenumber)', 5)} AS fold FROM lineitem),
c AS (SELECT unnest([0.5, 5.0, 50.0, 500.0])::DOUBLE AS alpha),
k AS (SELECT DISTINCT fold FROM d),
g AS (SELECT k.fold, l_partkey, count(*) AS n, avg(y) AS m FROM d JOIN k ON d.fold <> k.fold GROUP BY k.fold, l_partkey),
b AS (SELECT alpha, fold, sum(n * alpha / (n + alpha) * m) / sum(n * alpha / (n + alpha)) AS b FROM g, c GROUP BY alpha, fold)
SELECT b.alpha, b.fold, count(*) AS n,
       {_r('sqrt(avg(power(d.y - b.b - coalesce(g.n * (g.m - b.b) / (g.n + b.alpha), 0.0), 2)))')} AS rmse
FROM d JOIN b ON d.fold = b.fold LEFT JOIN g ON g.fold = d.fold AND g.l_partkey = d.l_partkey
GROUP BY b.alpha, b.fold"""
