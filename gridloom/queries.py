"""Every operator on the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom import operators as op
from gridloom.functions.formula import evaluate
from gridloom.plans.client import Client
from gridloom.shared import scratch_path
from gridloom.sources.buffer import BufferedTable
from gridloom.sources.documents import DocumentStore
from gridloom.sources.generated import empty_tensor, tensor_from_function
from gridloom.sources.versioned import TensorTable
from gridloom.streaming.ingest import into_table, session_cells, windowed_cells
from gridloom.tensor import Tensor

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Base tensors as SQL: E (day x user) and P have gaps, as not every user has events every day; L has duplicate coordinates.
BASE = """
E AS (SELECT CAST(ts AS DATE) AS day, user_id, round(sum(value), 6) AS v FROM events GROUP BY 1, 2),
T AS (SELECT CAST(ts AS DATE) AS day, event_type, CAST(count(*) AS DOUBLE) AS v FROM events GROUP BY 1, 2),
P AS (SELECT p_brand AS brand, CAST(p_size AS BIGINT) AS size, CAST(count(*) AS DOUBLE) AS v FROM part GROUP BY 1, 2),
G AS (SELECT d.day, u.user_id, E.v FROM (SELECT DISTINCT day FROM E) d CROSS JOIN (SELECT DISTINCT user_id FROM E) u LEFT JOIN E ON E.day = d.day AND E.user_id = u.user_id)
"""


def query(name: str, sql: str | None = None):
    """Register a query. Dates leave both engines as text, which compares alike whatever reads them."""

    def add(f):
        QUERIES[name] = lambda s, d: _plain(f(s, d))
        if sql:
            SQL[name] = f"WITH {BASE}{sql}"
            if re.search(r"SELECT (\w\.)?day, ", sql):
                SQL[name] = f"SELECT * REPLACE (CAST(day AS VARCHAR) AS day) FROM ({SQL[name]})"
        return f

    return add


def _plain(df: DataFrame) -> DataFrame:
    return df.select(*[F.col(c).cast("string").alias(c) if kind == "date" else F.col(c) for c, kind in df.dtypes])


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{table}.parquet")


def tensor_E(spark, d) -> Tensor:
    e = _read(spark, d, "events")
    return Tensor.from_dataframe(e.groupBy(F.to_date("ts").alias("day"), "user_id").agg(F.round(F.sum("value"), 6).alias("v")), ["day", "user_id"])


def tensor_T(spark, d) -> Tensor:
    return Tensor.from_dataframe(_read(spark, d, "events").groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").cast("double").alias("v")), ["day", "event_type"])


def tensor_P(spark, d) -> Tensor:
    p = _read(spark, d, "part").groupBy(F.col("p_brand").alias("brand"), F.col("p_size").cast("long").alias("size"))
    return Tensor.from_dataframe(p.agg(F.count("*").cast("double").alias("v")), ["brand", "size"])


def tensor_L(spark, d) -> Tensor:
    rows = _read(spark, d, "lineitem").select(F.col("l_orderkey").alias("orderkey"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_quantity").alias("v"))
    return Tensor.from_dataframe(rows, ["orderkey", "line"])


def tensor_V(spark, d) -> Tensor:
    rows = _read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("i", "v"))
    return Tensor.from_dataframe(rows.select("vec_id", F.col("i").cast("long").alias("i"), F.floor(F.col("v").cast("double") * 1024).cast("double").alias("v")), ["vec_id", "i"])


def _out(t: Tensor) -> DataFrame:
    return t.to_dataframe()


def _round(t: Tensor, n: int = 6) -> DataFrame:
    return t.map(lambda c: F.round(c, n)).to_dataframe()


# base tensors and the dense grid

query("tensor_pivot", " SELECT day, user_id, v FROM E")(lambda s, d: _out(tensor_E(s, d)))
query("dense_grid", " SELECT day, user_id, v FROM G")(lambda s, d: _out(tensor_E(s, d).dense()))

# fills

_F = "(PARTITION BY user_id ORDER BY day ROWS BETWEEN {} PRECEDING AND CURRENT ROW)"
query("ffill_all", f" SELECT day, user_id, last_value(v IGNORE NULLS) OVER {_F.format('UNBOUNDED')} AS v FROM G")(lambda s, d: _out(op.ffill(tensor_E(s, d), "day")))
query("ffill_limit2", f" SELECT day, user_id, last_value(v IGNORE NULLS) OVER {_F.format(2)} AS v FROM G")(lambda s, d: _out(op.ffill(tensor_E(s, d), "day", limit=2)))
query(
    "ffill_until_last",
    f" SELECT day, user_id, CASE WHEN day <= max(CASE WHEN v IS NOT NULL THEN day END) OVER (PARTITION BY user_id) THEN last_value(v IGNORE NULLS) OVER {_F.format('UNBOUNDED')} END AS v FROM G",
)(lambda s, d: _out(op.ffill(tensor_E(s, d), "day", until_last_valid=True)))
query(
    "ffill_until_label",
    f", C AS (SELECT user_id, min(day) + 14 AS cut FROM E GROUP BY 1) SELECT day, G.user_id, CASE WHEN day <= cut THEN last_value(v IGNORE NULLS) OVER {_F.replace('user_id', 'G.user_id').format('UNBOUNDED')} END AS v FROM G JOIN C ON G.user_id = C.user_id",
)(lambda s, d: _ffill_until_label(s, d))


def _ffill_until_label(s, d):
    t = tensor_E(s, d)
    cut = Tensor(t.df.groupBy("user_id").agg(F.date_add(F.min("day"), 14).alias("cut")), ("user_id",), ("cut",))
    return _out(op.ffill(t, "day", until_last_valid=cut))


# ranks

_W = "(PARTITION BY brand ORDER BY v{})"
_T = "count(*) OVER (PARTITION BY brand, v)"
query("rank_average", f" SELECT brand, size, rank() OVER {_W.format('')} + ({_T} - 1) / 2.0 AS v FROM P")(lambda s, d: _out(op.rank(tensor_P(s, d), "size")))
query("rank_min", f" SELECT brand, size, CAST(rank() OVER {_W.format('')} AS DOUBLE) AS v FROM P")(lambda s, d: _out(op.rank(tensor_P(s, d), "size", "min")))
query("rank_max", f" SELECT brand, size, CAST(rank() OVER {_W.format('')} + {_T} - 1 AS DOUBLE) AS v FROM P")(lambda s, d: _out(op.rank(tensor_P(s, d), "size", "max")))
query("rank_dense", f" SELECT brand, size, CAST(dense_rank() OVER {_W.format('')} AS DOUBLE) AS v FROM P")(lambda s, d: _out(op.rank(tensor_P(s, d), "size", "dense")))
query("rank_ordinal", f" SELECT brand, size, CAST(row_number() OVER {_W.format(', size')} AS DOUBLE) AS v FROM P")(lambda s, d: _out(op.rank(tensor_P(s, d), "size", "ordinal")))
query("rank_desc", f" SELECT brand, size, rank() OVER {_W.format(' DESC')} + ({_T} - 1) / 2.0 AS v FROM P")(lambda s, d: _out(op.rank(tensor_P(s, d), "size", ascending=False)))
query(
    "rank_propagate",
    " SELECT day, user_id, CASE WHEN count(v) OVER (PARTITION BY day) = count(*) OVER (PARTITION BY day) THEN CAST(rank() OVER (PARTITION BY day ORDER BY v) AS DOUBLE) END AS v FROM G",
)(lambda s, d: _out(op.rank(tensor_E(s, d), "user_id", "min", nan_policy="propagate")))
_V3 = "X AS (SELECT vec_id, i - 1 AS i, floor(CAST(e AS DOUBLE) * 1024) AS v FROM (SELECT vec_id, unnest(embedding) AS e, generate_subscripts(embedding, 1) AS i FROM embeddings))"
query(
    "multi_rank",
    f", {_V3}, W AS (SELECT vec_id, max(CASE WHEN i = 0 THEN floor(v / 64) END) AS a, max(CASE WHEN i = 1 THEN floor(v / 64) END) AS b FROM X WHERE i < 2 GROUP BY 1), R AS (SELECT vec_id, CAST(row_number() OVER (ORDER BY a, b NULLS LAST, vec_id) AS DOUBLE) AS v FROM W WHERE a IS NOT NULL) SELECT vec_id, CAST(i AS BIGINT) AS i, v FROM R CROSS JOIN (VALUES (0), (1)) t(i)",
)(lambda s, d: _out(op.multi_rank(op.sel(tensor_V(s, d), i=[0, 1]).map(lambda c: F.floor(c / 64).cast("double")), "i", "vec_id")))

# shifts

query("shift_valid_1", " SELECT day, user_id, lag(v, 1) OVER (PARTITION BY user_id ORDER BY day) AS v FROM E")(lambda s, d: _out(op.shift_on_valid(tensor_E(s, d), "day", 1)))
query("shift_valid_neg2", " SELECT day, user_id, lead(v, 2) OVER (PARTITION BY user_id ORDER BY day) AS v FROM E")(lambda s, d: _out(op.shift_on_valid(tensor_E(s, d), "day", -2)))

# moving windows

_R3 = "(PARTITION BY user_id ORDER BY day ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"


def _moving(name, sql, **options):
    rounded = options.pop("rounded", False)
    query(name, sql)(lambda s, d: (_round if rounded else _out)(op.rolling(tensor_E(s, d), "day", 3, **options)))


_moving("roll_mean_valid", f" SELECT day, user_id, CASE WHEN count(v) OVER {_R3} >= 2 THEN round(avg(v) OVER {_R3}, 6) END AS v FROM E", operator="mean", min_periods=2, rounded=True)
_moving("roll_sum_rows", f" SELECT day, user_id, CASE WHEN count(v) OVER {_R3} >= 1 THEN round(sum(v) OVER {_R3}, 6) END AS v FROM G", operator="sum", min_periods=1, drop_nan=False, rounded=True)
_moving("roll_std_pop", f" SELECT day, user_id, CASE WHEN count(v) OVER {_R3} >= 3 THEN round(stddev_pop(v) OVER {_R3}, 5) END AS v FROM E", operator="std")
QUERIES["roll_std_pop"] = lambda s, d: _plain(_round(op.rolling(tensor_E(s, d), "day", 3, "std"), 5))
_moving("roll_median", f" SELECT day, user_id, CASE WHEN count(v) OVER {_R3} >= 1 THEN round(median(v) OVER {_R3}, 6) END AS v FROM E", operator="median", min_periods=1, rounded=True)
_moving("roll_min", f" SELECT day, user_id, CASE WHEN count(v) OVER {_R3} >= 1 THEN min(v) OVER {_R3} END AS v FROM E", operator="min", min_periods=1)
_moving("roll_max", f" SELECT day, user_id, CASE WHEN count(v) OVER {_R3} >= 1 THEN max(v) OVER {_R3} END AS v FROM E", operator="max", min_periods=1)
_N = "L AS (SELECT day, user_id, v, lag(v, 1) OVER w AS b, lag(v, 2) OVER w AS c FROM E WINDOW w AS (PARTITION BY user_id ORDER BY day))"
_moving("roll_argmax", f", {_N} SELECT day, user_id, CASE WHEN c IS NULL THEN NULL WHEN v >= b AND v >= c THEN 0.0 WHEN b >= c THEN 1.0 ELSE 2.0 END AS v FROM L", operator="argmax")
_moving("roll_argmin", f", {_N} SELECT day, user_id, CASE WHEN c IS NULL THEN NULL WHEN v <= b AND v <= c THEN 0.0 WHEN b <= c THEN 1.0 ELSE 2.0 END AS v FROM L", operator="argmin")
_moving("roll_rank", f", {_N} SELECT day, user_id, CASE WHEN c IS NOT NULL THEN CAST((b < v)::INT + (c < v)::INT + ((b = v)::INT + (c = v)::INT) / 2.0 - 1 AS DOUBLE) END AS v FROM L", operator="rank")
query(
    "roll_ffill",
    f", A AS (SELECT day, user_id, CASE WHEN count(v) OVER {_R3} >= 2 THEN round(avg(v) OVER {_R3}, 6) END AS r FROM E) SELECT G.day, G.user_id, last_value(r IGNORE NULLS) OVER (PARTITION BY G.user_id ORDER BY G.day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM G LEFT JOIN A ON A.day = G.day AND A.user_id = G.user_id",
)(lambda s, d: _round(op.rolling_overlap(tensor_E(s, d), "day", 3, "mean", window_margin=3, min_periods=2)))
query(
    "cumsum_sorted", " SELECT brand, size, sum(v) OVER (PARTITION BY brand ORDER BY v DESC, size ROWS UNBOUNDED PRECEDING) AS v FROM P"
)(lambda s, d: _out(op.cumulative_on_sort(tensor_P(s, d), "size", "nancumsum")))
query(
    "cumprod_sorted", " SELECT brand, size, round(product(1 + v / 1000) OVER (PARTITION BY brand ORDER BY v, size ROWS UNBOUNDED PRECEDING), 9) AS v FROM P"
)(lambda s, d: _round(op.cumulative_on_sort(tensor_P(s, d).map(lambda c: 1 + c / 1000), "size", "cumprod", ascending=True), 9))
query(
    "cumsum_sorted_fill",
    " SELECT day, user_id, round(sum(v) OVER (PARTITION BY user_id ORDER BY v DESC NULLS LAST, day ROWS UNBOUNDED PRECEDING), 4) AS v FROM G",
)(lambda s, d: _round(op.cumulative_on_sort(tensor_E(s, d), "day", "sum", keep_nan=False), 4))
query("topk_mask", " SELECT brand, size, rank() OVER (PARTITION BY brand ORDER BY v DESC) <= 3 AS v FROM P")(lambda s, d: _out(op.topk_mask(tensor_P(s, d), "size", 3)))
query("topk_only", " SELECT brand, size, TRUE AS v FROM (SELECT *, rank() OVER (PARTITION BY brand ORDER BY v DESC) AS r FROM P) WHERE r <= 3")(lambda s, d: _out(op.topk_mask(tensor_P(s, d), "size", 3, only_true=True)))
query(
    "topk_tie",
    f", {_V3}, W AS (SELECT vec_id, max(CASE WHEN i = 0 THEN floor(v / 64) END) AS a, max(CASE WHEN i = 1 THEN floor(v / 64) END) AS b FROM X WHERE i < 2 GROUP BY 1), R AS (SELECT vec_id, rank() OVER (ORDER BY a DESC, b DESC) <= 20 AS v FROM W) SELECT vec_id, CAST(i AS BIGINT) AS i, v FROM R CROSS JOIN (VALUES (0), (1)) t(i)",
)(lambda s, d: _out(op.topk_mask(op.sel(tensor_V(s, d), i=[0, 1]).map(lambda c: F.floor(c / 64).cast("double")), "vec_id", 20, tie_breaker_dim="i")))

# labels, values, cells

query("replace_map", " SELECT brand, size, CASE v WHEN 1 THEN 11.0 WHEN 2 THEN 12.0 ELSE v END AS v FROM P")(lambda s, d: _out(op.replace_values(tensor_P(s, d), {1: 11.0, 2: 12.0})))
query(
    "replace_default",
    ", X AS (SELECT b.brand, s.size, P.v FROM (SELECT DISTINCT brand FROM P) b CROSS JOIN (SELECT DISTINCT size FROM P) s LEFT JOIN P ON P.brand = b.brand AND P.size = s.size) SELECT brand, size, CASE v WHEN 1 THEN 11.0 WHEN 2 THEN 12.0 ELSE 5.3 END AS v FROM X",
)(lambda s, d: _out(op.replace_values(tensor_P(s, d), {1: 11.0, 2: 12.0}, default=5.3)))
query(
    "replace_table", ", M AS (SELECT CAST(n_nationkey AS DOUBLE) AS k, 100.0 + n_regionkey AS n FROM nation) SELECT brand, size, CAST(coalesce(n, v) AS DOUBLE) AS v FROM P LEFT JOIN M ON P.v = M.k"
)(lambda s, d: _out(op.replace_values(tensor_P(s, d), _read(s, d, "nation").select(F.col("n_nationkey").cast("double").alias("k"), (100.0 + F.col("n_regionkey")).alias("n")))))
query(
    "vindex_dup", ", Q(size, size_pos) AS (VALUES (7, 0), (3, 1), (7, 2), (50, 3)) SELECT brand, CAST(Q.size AS BIGINT) AS size, CAST(size_pos AS BIGINT) AS size_pos, v FROM Q JOIN P ON P.size = Q.size"
)(lambda s, d: _out(op.take(tensor_P(s, d), {"size": [7, 3, 7, 50]})))
query(
    "reindex_exact",
    ", Q(size) AS (VALUES (60), (3), (7), (0)) SELECT b.brand, CAST(Q.size AS BIGINT) AS size, CASE WHEN Q.size NOT IN (SELECT size FROM P) THEN -1.0 ELSE v END AS v FROM Q CROSS JOIN (SELECT DISTINCT brand FROM P) b LEFT JOIN P ON P.size = Q.size AND P.brand = b.brand WHERE Q.size NOT IN (SELECT size FROM P) OR v IS NOT NULL",
)(lambda s, d: _out(op.reindex(tensor_P(s, d), "size", [60, 3, 7, 0], fill_value=-1.0).valid()))
query(
    "reindex_ffill",
    ", X AS (SELECT * FROM E WHERE isodow(day) <= 5), Q AS (SELECT DISTINCT day + 3 AS day FROM E), M AS (SELECT Q.day, max(X.day) AS m FROM Q JOIN X ON X.day <= Q.day GROUP BY 1) SELECT M.day, user_id, v FROM M JOIN X ON X.day = M.m",
)(lambda s, d: _reindex_ffill(s, d))


def _reindex_ffill(s, d):
    t = tensor_E(s, d)
    days = t.df.select(F.date_add("day", 3).alias("day")).distinct().withColumn("pos", F.monotonically_increasing_id())
    return _out(op.reindex(t.using(t.df.where("weekday(day) < 5")), "day", days, method="ffill"))


query("dropna_dims", ", X AS (SELECT brand, size, CASE WHEN v >= 6 THEN v END AS v FROM P) SELECT brand, size, v FROM X WHERE brand IN (SELECT brand FROM X WHERE v IS NOT NULL) AND size IN (SELECT size FROM X WHERE v IS NOT NULL)")(
    lambda s, d: _out(op.dropna(tensor_P(s, d).map(lambda c: F.when(c >= 6, c))))
)
query("drop_unmarked", ", X AS (SELECT brand, size, v >= 6 AS v FROM P) SELECT brand, size, v FROM X WHERE brand IN (SELECT brand FROM X WHERE v) AND size IN (SELECT size FROM X WHERE v)")(
    lambda s, d: _out(op.drop_unmarked(tensor_P(s, d) >= 6))
)
query("select_labels", " SELECT brand, size, v FROM P WHERE size IN (3, 7) AND brand = 'Brand#11'")(lambda s, d: _out(op.sel(tensor_P(s, d), size=[3, 7], brand="Brand#11")))
query("select_positions", " SELECT day, user_id, v FROM E WHERE day IN (SELECT DISTINCT day FROM E ORDER BY day LIMIT 2)")(lambda s, d: _out(op.isel(tensor_E(s, d), day=[0, 1])))
query("where_mask", " SELECT brand, size, CASE WHEN v > 2 THEN v ELSE 0.0 END AS v FROM P")(lambda s, d: (lambda t: _out(op.where(t, t > 2, 0.0)))(tensor_P(s, d)))
query("isin_values", " SELECT brand, size, v IN (1, 3) AS v FROM P")(lambda s, d: _out(op.isin(tensor_P(s, d), [1.0, 3.0])))
query("fillna", " SELECT day, user_id, coalesce(v, -1.0) AS v FROM G")(lambda s, d: _out(op.fillna(tensor_E(s, d), -1.0)))
query("last_valid_label", " SELECT user_id, CAST(max(day) AS VARCHAR) AS v FROM E GROUP BY 1")(lambda s, d: _out(op.last_valid_label(tensor_E(s, d), "day")))
query("unique_values", " SELECT DISTINCT v FROM P")(lambda s, d: op.unique_values(tensor_P(s, d)))

# groups

_GS = {"sum": "sum(v)", "max": "max(v)", "mean": "round(avg(v), 9)", "std": "round(stddev_pop(v), 9)", "median": "median(v)", "count": "CAST(count(v) AS BIGINT)"}


def _mod_groups(s, d, t: Tensor) -> DataFrame:
    return t.axis("size").select("size", (F.col("size") % 5).alias("g"))


for _name, _sql in _GS.items():
    query(f"group_reduce_{_name}", f" SELECT brand, size % 5 AS size, {_sql} AS v FROM P GROUP BY 1, 2")(
        lambda s, d, n=_name: (lambda t: (_round if n in ("mean", "std") else _out)(op.apply_on_groups(t, _mod_groups(s, d, t), "size", n), *([9] if n in ("mean", "std") else [])))(tensor_P(s, d))
    )
query("group_keep_shape", ", X AS (SELECT b.brand, z.size, P.v FROM (SELECT DISTINCT brand FROM P) b CROSS JOIN (SELECT DISTINCT size FROM P) z LEFT JOIN P ON P.brand = b.brand AND P.size = z.size) SELECT brand, size, coalesce(sum(v) OVER (PARTITION BY brand, size % 5), 0) AS v FROM X")(
    lambda s, d: (lambda t: _out(op.apply_on_groups(t, _mod_groups(s, d, t), "size", "sum", keep_shape=True)))(tensor_P(s, d))
)
query("group_array", " SELECT brand, CAST(v AS BIGINT) % 3 AS size, max(v) AS v FROM P GROUP BY 1, 2")(
    lambda s, d: (lambda t: _out(op.apply_on_groups(t, t.map(lambda c: c.cast("long") % 3), "size", "max")))(tensor_P(s, d))
)
query("group_array_union", ", K AS (SELECT brand, CAST(v AS BIGINT) % 7 AS g, max(v) AS v FROM P GROUP BY 1, 2) SELECT b.brand, g.g AS size, K.v FROM (SELECT DISTINCT brand FROM P) b CROSS JOIN (SELECT DISTINCT g FROM K) g LEFT JOIN K ON K.brand = b.brand AND K.g = g.g")(
    lambda s, d: (lambda t: _out(op.apply_on_groups(t, t.map(lambda c: c.cast("long") % 7), "size", "max", unique_groups=True)))(tensor_P(s, d))
)
query("group_rank", " SELECT brand, size, CAST(rank() OVER (PARTITION BY brand, size % 5 ORDER BY v) AS DOUBLE) AS v FROM P")(
    lambda s, d: (lambda t: _out(op.apply_on_groups(t, _mod_groups(s, d, t), "size", "rank", method="min")))(tensor_P(s, d))
)
query("group_callable", " SELECT brand, size % 5 AS size, sum(v * 2 + 1) AS v FROM P GROUP BY 1, 2")(
    lambda s, d: (lambda t: _out(op.apply_on_groups(t, _mod_groups(s, d, t), "size", lambda c: F.sum(c * 2 + 1))))(tensor_P(s, d))
)
for _name in ("sum", "max"):
    query(f"merge_duplicates_{_name}", f" SELECT l_orderkey AS orderkey, CAST(l_linenumber AS BIGINT) AS line, {_name}(l_quantity) AS v FROM lineitem GROUP BY 1, 2")(
        lambda s, d, n=_name: _out(op.merge_duplicates(tensor_L(s, d), n))
    )
query("reduce_sum", " SELECT brand, sum(v) AS v FROM P GROUP BY 1")(lambda s, d: _out(op.reduce_dims(tensor_P(s, d), "sum", "size")))
query("reduce_first_last", " SELECT user_id, arg_min(v, day) AS first, arg_max(v, day) AS last FROM E GROUP BY 1")(
    lambda s, d: (lambda t: op.reduce_dims(t, "first", "day").rename(v="first").df.join(op.reduce_dims(t, "last", "day").rename(v="last").df, "user_id"))(tensor_E(s, d))
)
query("cube_counts", " SELECT coalesce(brand, 'all') AS brand, coalesce(size % 5, -1) AS g, sum(v) AS v FROM P GROUP BY CUBE (brand, size % 5)")(lambda s, d: tensor_P(s, d).df.withColumn("g", F.col("size") % 5).cube("brand", "g").agg(F.sum("v").alias("v")).select(F.coalesce("brand", F.lit("all")).alias("brand"), F.coalesce("g", F.lit(-1)).cast("long").alias("g"), "v"))

# two tensors

query("formula_mul", " SELECT E.day, E.user_id, round(E.v * S.v, 4) AS v FROM E JOIN (SELECT day, user_id, v FROM E WHERE v > 100) S ON S.day = E.day AND S.user_id = E.user_id")(
    lambda s, d: (lambda t: _round(t * t.using(t.df.where("v > 100")), 4))(tensor_E(s, d))
)
query("formula_bcast", ", S AS (SELECT user_id, max(v) AS m FROM E GROUP BY 1) SELECT day, E.user_id, round(E.v / m, 6) AS v FROM E JOIN S ON S.user_id = E.user_id")(
    lambda s, d: (lambda t: _round(t / op.reduce_dims(t, "max", "day")))(tensor_E(s, d))
)
query("formula_roll", f" SELECT day, user_id, CASE WHEN count(v) OVER {_R3} = 3 THEN round(sum(v) OVER {_R3}, 4) END AS v FROM G")(lambda s, d: _round(op.rolling_rows(tensor_E(s, d), "day", 3), 4))
_HALF = ", A AS (SELECT * FROM E WHERE v > 50), B AS (SELECT day, user_id, v + 1 AS v FROM E WHERE v < 150)"
query("combine_first", f"{_HALF} SELECT coalesce(A.day, B.day) AS day, coalesce(A.user_id, B.user_id) AS user_id, coalesce(A.v, B.v) AS v FROM A FULL JOIN B ON A.day = B.day AND A.user_id = B.user_id")(
    lambda s, d: (lambda t: _out(op.combine_first(t.using(t.df.where("v > 50")), t.using(t.df.where("v < 150")) + 1)))(tensor_E(s, d))
)
query("concat_outer", " SELECT day, user_id, v FROM E")(lambda s, d: (lambda t: _out(op.concat([t.using(t.df.where("weekday(day) < 5")), t.using(t.df.where("weekday(day) >= 5"))])))(tensor_E(s, d)))
query("append_previous", ", D AS (SELECT min(day) + 10 AS first FROM E) SELECT day, user_id, v FROM E WHERE day >= (SELECT max(day) FROM E WHERE day < (SELECT first FROM D))")(
    lambda s, d: _append_previous(s, d)
)


def _append_previous(s, d):
    t = tensor_E(s, d)
    first = t.df.agg(F.date_add(F.min("day"), 10).alias("f"))
    new = t.using(t.df.join(F.broadcast(first), F.col("day") >= F.col("f")).drop("f"))
    old = t.using(t.df.join(F.broadcast(first), F.col("day") < F.col("f")).drop("f"))
    return _out(op.append_previous(old, new, "day"))


query("dot_product", f", {_V3} SELECT X.vec_id, sum(X.v * Y.v) AS v FROM X JOIN X Y ON X.i = Y.i AND Y.vec_id = 0 GROUP BY 1")(
    lambda s, d: (lambda t: _out(op.dot(t, Tensor(t.df.where("vec_id = 0").select("i", "v"), ("i",), ("v",)), "i")))(tensor_V(s, d))
)

# stored tensors: each query writes to a new place in the shared folder and reads its last version


def _table(s, **options) -> TensorTable:
    return TensorTable(s, scratch_path(s, "query-table"), data_names="v", **options)


def _part(t: Tensor, condition: str, f=lambda c: c) -> Tensor:
    return t.using(t.df.where(condition)).map(f)


_OLD = ", O AS (SELECT * FROM P WHERE size <= 30 AND brand < 'Brand#15')"
_CELL = "size IN (SELECT size FROM {0}) AND brand IN (SELECT brand FROM {0})"


@query("store_append_read", f"{_OLD} SELECT brand, size, v FROM O UNION ALL SELECT brand, size, v + 100 FROM P WHERE NOT ({_CELL.format('O')})")
def _store_append(s, d):
    t, table = tensor_P(s, d), _table(s, sorted_coords={"size": True})
    table.store(_part(t, "size <= 30 and brand < 'Brand#15'"))
    table.append(t + 100)
    return _out(table.read().valid())


_UPDATE = ", U AS (SELECT brand, size, v * 10 AS v FROM P WHERE size IN (3, 7, 11, 20) AND v >= 2)"


@query("store_update_read", f"{_UPDATE} SELECT brand, size, v FROM U UNION ALL SELECT brand, size, v FROM P WHERE NOT ({_CELL.format('U')})")
def _store_update(s, d):
    t, table = tensor_P(s, d), _table(s)
    table.store(t)
    table.update(_part(t, "size in (3, 7, 11, 20) and v >= 2", lambda c: c * 10))
    return _out(table.read().valid())


@query("store_upsert_read", " SELECT brand, size, CASE WHEN size <= 20 THEN v ELSE v + 1000 END AS v FROM P")
def _store_upsert(s, d):
    t, table = tensor_P(s, d), _table(s, chunks={"size": 10})
    table.store(_part(t, "size <= 30"))
    table.upsert(_part(t, "size > 20", lambda c: c + 1000))
    return _out(table.read().valid())


@query("store_drop_read", " SELECT brand, size, v FROM P WHERE size NOT IN (SELECT DISTINCT size FROM P ORDER BY size LIMIT 3) AND brand <> (SELECT min(brand) FROM P)")
def _store_drop(s, d):
    t, table = tensor_P(s, d), _table(s)
    table.store(t)
    table.drop({"size": op.isel(t, size=[0, 1, 2]).labels("size"), "brand": op.isel(t, brand=0).labels("brand")})
    return _out(table.read().valid())


@query("store_snapshot_read", " SELECT brand, size, v FROM P WHERE size <= 30")
def _store_snapshot(s, d):
    t, table = tensor_P(s, d), _table(s)
    first = table.store(_part(t, "size <= 30"))
    table.append(t)
    return _out(table.read(version=first if isinstance(first, int) else 1).valid())


@query("buffered_read", " SELECT brand, size, CASE WHEN size = 40 THEN -v ELSE v END AS v FROM P")
def _buffered(s, d):
    t, buffer = tensor_P(s, d), BufferedTable(_table(s), "size", 25, merge_cache=True)
    buffer.store(_part(t, "size <= 20"))
    buffer.append(_part(t, "size between 21 and 40"))
    buffer.append(_part(t, "size > 40"))
    buffer.update(_part(t, "size = 40", lambda c: -c))
    return _out(buffer.read().valid())


@query("store_update_region_read", f"{_UPDATE} SELECT brand, size, v FROM U UNION ALL SELECT brand, size, v FROM P WHERE NOT ({_CELL.format('U')})")
def _store_update_region(s, d):
    """An update of some labels of a chunked tensor: other chunks keep their files."""
    t, table = tensor_P(s, d), _table(s, chunks={"size": 8, "brand": 5})
    table.store(t)
    table.update(_part(t, "size in (3, 7, 11, 20) and v >= 2", lambda c: c * 10))
    return _out(table.read().valid())


@query("store_session_read", " SELECT brand, size, CASE WHEN size > 40 THEN v + 5 WHEN size = 1 THEN -v ELSE v END AS v FROM P WHERE size <> 2")
def _store_session(s, d):
    """Several verbs as one version."""
    t, table = tensor_P(s, d), _table(s, sorted_coords={"size": True}, chunks={"size": 10})
    session = table.session().store(_part(t, "size <= 40"))
    session.append(_part(t, "size > 40", lambda c: c + 5)).update(_part(t, "size = 1", lambda c: -c)).drop({"size": [2]}).commit()
    return _out(table.read(table.version()).valid())


@query("store_unique_read", " SELECT brand, size, v FROM P")
def _store_unique(s, d):
    """Of repeated cells the first stays."""
    t, table = tensor_P(s, d), _table(s)
    table.store(t.using(t.to_dataframe().unionByName((t - 1000).to_dataframe())))
    return _out(table.read())


@query("store_variables_read", " SELECT brand, size, v AS a, v * 2 AS b FROM P")
def _store_variables(s, d):
    t = tensor_P(s, d)
    table = TensorTable(s, scratch_path(s, "query-table"), data_names=["a", "b"])
    table.store(Tensor(t.df.select("brand", "size", F.col("v").alias("a"), (F.col("v") * 2).alias("b"), F.lit(0).alias("c")), t.dims, ("a", "b", "c")))
    return table.read().to_dataframe()


@query("store_delete_exists", " SELECT FALSE AS before, TRUE AS stored, FALSE AS after")
def _store_delete(s, d):
    table = _table(s)
    before = table.exist()
    table.store(tensor_P(s, d))
    stored = table.exist()
    table.delete()
    return s.createDataFrame([(before, stored, table.exist())], "before boolean, stored boolean, after boolean")


@query("store_label_read", " SELECT brand, size, v FROM P WHERE size IN (5, 25) AND brand = 'Brand#12'")
def _store_label(s, d):
    """A read by label opens the chunks of the labels only."""
    table = _table(s, chunks={"size": 10})
    table.store(tensor_P(s, d))
    return _out(table.read(size=[5, 25], brand="Brand#12").valid())


@query("buffered_keep_last", " SELECT brand, size, v + 1000 AS v FROM P WHERE size = 7 AND v >= 2 UNION ALL SELECT brand, size, -v FROM P WHERE size = 7 AND NOT EXISTS (SELECT 1 FROM P WHERE size = 7 AND v >= 2) UNION ALL SELECT brand, size, v FROM P WHERE size <> 7")
def _buffered_keep_last(s, d):
    """Updates of a label that come again replace those that are pending, holes too."""
    t, buffer = tensor_P(s, d), BufferedTable(_table(s), "size", 100, merge_cache=True, update_logic="keep_last")
    buffer.store(t)
    buffer.update(_part(t, "size = 7", lambda c: -c))
    buffer.update(_part(t, "size = 7 and v >= 2", lambda c: c + 1000))
    return _out(buffer.read().valid())


@query("document_store_read", " SELECT n_name AS name, CAST(n_regionkey AS BIGINT) + CASE WHEN n_regionkey = 1 THEN 100 ELSE 0 END AS region FROM nation")
def _documents(s, d):
    """A small table as one JSON document, merged deeply with another."""
    rows = [(r["n_name"], r["n_regionkey"]) for r in _read(s, d, "nation").select("n_name", "n_regionkey").collect()]
    docs = DocumentStore(s, scratch_path(s, "query-documents"))
    docs.store({"nations": dict(rows)}, "geo/all")
    docs.upsert({"nations": {n: r + 100 for n, r in rows if r == 1}}, "geo/all")
    return s.createDataFrame([(n, int(r)) for n, r in docs.read("geo/all")["nations"].items()], "name string, region long")


@query("client_pipeline_read", " SELECT brand, size, v * 2 + 1 AS v FROM P")
def _client_pipeline(s, d):
    """A definition whose store verb runs a formula over another tensor."""
    client = Client(s, scratch_path(s, "query-client"))
    client.create_tensor({"path": "raw", "storage": {"data_names": "v"}})
    client.store("raw", new_data=tensor_P(s, d))
    formula = [{"method_name": "read_from_formula", "parameters": {"formula": "`raw` * 2 + 1"}}]
    client.create_tensor({"path": "made", "storage": {"data_names": "v"}, "definition": {"store": {"data_transformation": formula}}})
    client.store("made")
    return _out(client.read("made").valid())


@query("client_refresh_read", " SELECT brand, size, v * 3 + 1 AS v FROM P")
def _client_refresh(s, d):
    """Tensors that depend on one another, refreshed in order."""
    client = Client(s, scratch_path(s, "query-client"))
    client.create_tensor({"path": "raw", "storage": {"data_names": "v"}})
    client.store("raw", new_data=tensor_P(s, d))
    for path, text, depends in (("twice", "`raw` * 2", []), ("more", "`raw` + 1", []), ("sum", "`twice` + `more`", ["twice", "more"])):
        steps = [{"method_name": "read_from_formula", "parameters": {"formula": text}}]
        client.create_tensor({"path": path, "storage": {"data_names": "v"}, "definition": {"store": {"data_transformation": steps}}, "dag": {"depends": depends}})
    client.exec_on_dag_order("store")
    return _out(client.read("sum").valid())


@query("client_catalog", " SELECT * FROM (VALUES ('a', 'first', TRUE), ('b/c', 'second', FALSE)) t(path, note, has_data)")
def _client_catalog(s, d):
    client = Client(s, scratch_path(s, "query-client"))
    for path, note in (("a", "first"), ("b/c", "second"), ("gone", "x")):
        client.create_tensor({"path": path, "storage": {"data_names": "v"}})
        client.update_tensor_metadata(path, {"note": note})
    client.store("a", new_data=tensor_P(s, d))
    client.delete_tensor("gone")
    rows = [(x.path, x.metadata["note"], client.exist(x.path)) for x in client.get_all_tensors_definition()]
    return s.createDataFrame(rows, "path string, note string, has_data boolean")


# several variables, functions of a whole series, other corners

query("map_axis_cumsum", " SELECT brand, size, sum(v) OVER (PARTITION BY brand ORDER BY size ROWS UNBOUNDED PRECEDING) AS v FROM (SELECT b.brand, z.size, coalesce(P.v, 0) AS v FROM (SELECT DISTINCT brand FROM P) b CROSS JOIN (SELECT DISTINCT size FROM P) z LEFT JOIN P ON P.brand = b.brand AND P.size = z.size)")(
    lambda s, d: _out(op.map_along_axis(tensor_P(s, d), "size", lambda x: x.fillna(0).cumsum()))
)
query("group_template", " SELECT brand, size % 5 AS size, sum(v * size) / sum(v) AS w FROM P GROUP BY 1, 2")(
    lambda s, d: (lambda t: _out(op.apply_on_groups(Tensor(t.df.select("brand", "size", "v", F.col("size").cast("double").alias("z")), t.dims, ("v", "z")), _mod_groups(s, d, t), "size", lambda x: F.sum(x["v"] * x["z"]) / F.sum(x["v"]), template="w")))(tensor_P(s, d))
)
query("group_keep_nunique", ", X AS (SELECT b.brand, z.size, P.v FROM (SELECT DISTINCT brand FROM P) b CROSS JOIN (SELECT DISTINCT size FROM P) z LEFT JOIN P ON P.brand = b.brand AND P.size = z.size), N AS (SELECT brand, size % 5 AS g, count(DISTINCT v) AS n FROM X GROUP BY 1, 2) SELECT X.brand, X.size, N.n AS v FROM X JOIN N ON N.brand = X.brand AND N.g = X.size % 5")(
    lambda s, d: (lambda t: _out(op.apply_on_groups(t, _mod_groups(s, d, t), "size", "nunique", keep_shape=True)))(tensor_P(s, d))
)
query("transpose_rename", " SELECT size AS z, brand AS b, v AS n FROM P")(lambda s, d: _out(tensor_P(s, d).transpose("size", "brand").rename(size="z", brand="b", v="n")))
query("power_missing", " SELECT brand, size, CASE WHEN v >= 3 THEN sqrt(v - 3) END AS v FROM P")(lambda s, d: _out((tensor_P(s, d) - 3) ** 0.5))
query("empty_cells", " SELECT n_name AS name, CAST(n_regionkey AS BIGINT) AS region, CAST(NULL AS DOUBLE) AS v FROM nation WHERE FALSE UNION ALL SELECT a.n_name, b.r_regionkey, NULL FROM nation a CROSS JOIN region b")(
    lambda s, d: empty_tensor(s, ["name", "region"], {"name": [r[0] for r in _read(s, d, "nation").select("n_name").collect()], "region": [int(r[0]) for r in _read(s, d, "region").select("r_regionkey").collect()]}, name="v").dense().to_dataframe()
)
query("select_both_ends", " SELECT brand, size, v FROM P WHERE size IN (SELECT min(size) FROM P UNION ALL SELECT max(size) FROM P)")(lambda s, d: _out(op.isel(tensor_P(s, d), size=[0, -1])))

# formulas, generated tensors, event time

query("formula_text", f", W AS (SELECT day, user_id, v, CASE WHEN count(v) OVER {_R3} = 3 THEN sum(v) OVER {_R3} END AS r FROM G) SELECT day, user_id, round(v * 2 + r, 4) AS v FROM W WHERE v IS NOT NULL AND r IS NOT NULL")(
    lambda s, d: _round(evaluate("`a/e` * 2 + `a/e`.rolling({'day': 3}).sum()", lambda path: tensor_E(s, d)).valid(), 4)
)
query("generated_cells", ", A AS (SELECT unnest(range(40)) AS a), B AS (SELECT unnest(range(7)) AS b) SELECT a, b, CAST(a * 100 + b AS DOUBLE) AS v FROM A CROSS JOIN B")(
    lambda s, d: _out(tensor_from_function(s, lambda labels: [[a * 100.0 + b for b in labels["b"]] for a in labels["a"]], ["a", "b"], {"a": list(range(40)), "b": list(range(7))}, data_names="v", chunks={"a": 16, "b": 3}))
)
query("session_cells", ", X AS (SELECT ts, user_id, value, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events), Y AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM X) SELECT user_id, k AS session, count(*) AS n, round(sum(value), 4) AS v FROM Y GROUP BY 1, 2")(
    lambda s, d: _sessions(s, d)
)


def _sessions(s, d):
    """Sessions that a gap of twelve hours ends, numbered by user."""
    made = session_cells(_read(s, d, "events"), "ts", ["user_id"], "value", "12 hours", watermark=None)
    counts = session_cells(_read(s, d, "events"), "ts", ["user_id"], "value", "12 hours", func="count", watermark=None).withColumnRenamed("value", "n")
    number = F.row_number().over(Window.partitionBy("user_id").orderBy("session_start"))
    return made.join(counts.drop("session_end"), ["session_start", "user_id"]).select("user_id", number.cast("decimal(38,0)").alias("session"), "n", F.round("value", 4).alias("v"))


query("window_cells", " SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS window_day, event_type, round(sum(value), 4) AS v FROM events GROUP BY 1, 2")(
    lambda s, d: windowed_cells(_read(s, d, "events"), "ts", ["event_type"], "value").select(F.to_date("window_start").alias("window_day"), "event_type", F.round("value", 4).alias("v"))
)


@query("stream_ingest_read", " SELECT day, event_type, v FROM T")
def _stream_ingest(s, d):
    """The events as a stream: each micro-batch is counted by cell and added to what is stored."""
    events = _read(s, d, "events")
    stream = s.readStream.schema(events.schema).parquet(f"{d}/events.parquet*")
    table = _table(s)

    def cells(batch: DataFrame) -> DataFrame:
        new = batch.groupBy(F.to_date("ts").alias("day"), "event_type").agg(F.count("*").cast("double").alias("v"))
        if not table.exist():
            return new
        old = table.read().df.select("day", "event_type", F.col("v").alias("before"))
        return new.join(old, ["day", "event_type"], "left").select("day", "event_type", (F.col("v") + F.coalesce("before", F.lit(0.0))).alias("v"))

    into_table(stream, table, ["day", "event_type"], scratch_path(s, "query-stream"), transform=cells).awaitTermination()
    return _out(table.read().valid())
