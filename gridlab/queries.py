"""The registered queries over the driver's tables, and equivalent SQL."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import encode
from .functions.random import uniform
from .operators import apportion, describe, field, generate, layout, place
from .plans.spec import GridSpec
from .sources import files, synthetic

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

COORDS = ["user_id", "day"]
KINDS = ["click", "error", "purchase", "signup", "view"]
CUBE = "cube AS (SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS day, " + ", ".join(f"max(CASE WHEN event_type = '{k}' THEN value END) AS {k}" for k in KINDS) + " FROM events GROUP BY 1, 2)"
SEED = 7


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a sparse cube over (user_id, day): one variable an event type, its largest value."""
    day = F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("day")
    rows = table(spark, sf_dir, "events").select("user_id", day, "event_type", "value")
    return rows.groupBy(*COORDS).agg(*[F.max(F.when(F.col("event_type") == k, F.col("value"))).alias(k) for k in KINDS])


# -- describe -----------------------------------------------------------------------------------------------------


@query(f"WITH {CUBE}, " + "a AS (SELECT 'user_id' AS coord, user_id AS x, * FROM cube UNION ALL BY NAME SELECT 'day' AS coord, day AS x, * FROM cube) SELECT coord, count(DISTINCT x) AS n_values, " + ", ".join(f"count(DISTINCT CASE WHEN {k} IS NOT NULL THEN x END) AS n_{k}" for k in KINDS) + " FROM a GROUP BY coord")
def grid_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe.axes(cube(spark, sf_dir), COORDS, KINDS)


@query(f"WITH {CUBE} SELECT user_id, day::BIGINT AS day, {', '.join(KINDS)} FROM cube")
def cube_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube(spark, sf_dir).orderBy(*[F.col(c).asc_nulls_last() for c in COORDS])


def _long(columns: str) -> str:
    return " UNION ALL ".join(f"SELECT {i} AS k, '{v}' AS variable, {columns.replace('@', v)} FROM cube" for i, v in enumerate(KINDS))


_FACTS = f"""WITH {CUBE}, g AS (SELECT count(DISTINCT user_id) AS u, count(DISTINCT day) AS d FROM cube),
    f AS ({_long("count(@) AS occ, count(DISTINCT CASE WHEN @ IS NOT NULL THEN user_id END) AS su, count(DISTINCT CASE WHEN @ IS NOT NULL THEN day END) AS sd")}),
    r AS (SELECT variable AS ref, occ AS ref_occ FROM f ORDER BY occ DESC, k LIMIT 1),
    b AS (SELECT variable, both_held FROM ({" UNION ALL ".join(f"SELECT '{v}' AS variable, (SELECT ref FROM r) AS ref, CASE (SELECT ref FROM r) " + " ".join(f"WHEN '{w}' THEN count(CASE WHEN {v} IS NOT NULL AND {w} IS NOT NULL THEN 1 END)" for w in KINDS) + " END AS both_held FROM cube" for v in KINDS)})),
    s AS (SELECT CASE WHEN variable = ref THEN 0 ELSE row_number() OVER (ORDER BY variable = ref, k) END::INT AS position, variable, u * d AS var_sites,
          occ AS var_sites_occupied, occ / (u * d)::DOUBLE AS density, CASE WHEN variable <> ref THEN both_held / greatest(ref_occ, 1)::DOUBLE END AS overlap,
          CASE WHEN variable <> ref AND occ > 0 THEN both_held / occ::DOUBLE END AS overlap_reverse, (u - su) + (d - sd) AS unused_coords, 'double' AS dtype
          FROM f JOIN b USING (variable), g, r)"""


def described(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe.describe(cube(spark, sf_dir), COORDS, KINDS, dims={k: COORDS for k in KINDS})


@query(f"{_FACTS} SELECT * FROM s")
def describe_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(spark, sf_dir).drop("dims", "assumed_constant", "ambiguous_dims")


@query(f"{_FACTS} SELECT variable, var_sites, var_sites_occupied, density FROM s")
def describe_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(spark, sf_dir).select("variable", "var_sites", "var_sites_occupied", "density")


@query(f"{_FACTS} SELECT variable, overlap, overlap_reverse FROM s")
def describe_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(spark, sf_dir).select("variable", "overlap", "overlap_reverse")


@query(f"{_FACTS} SELECT variable, unused_coords FROM s")
def unused_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(spark, sf_dir).select("variable", "unused_coords")


@query(f"{_FACTS} SELECT variable AS reference FROM s WHERE position = 0")
def reference_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    return described(spark, sf_dir).filter("position = 0").select(F.col("variable").alias("reference"))


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per (l_orderkey, l_linenumber): the line's largest quantity and its order's price."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").alias("l_quantity"))
    prices = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_totalprice")
    return lines.join(prices, "l_orderkey")


LINES = """rows AS (SELECT l_orderkey, l_linenumber, l_quantity, o_totalprice FROM
    (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY 1, 2) JOIN orders ON l_orderkey = o_orderkey)"""
_LEVEL = " UNION ALL ".join(
    f"""SELECT '{v}' AS variable, '{d}' AS without, coalesce(sum(CASE WHEN lo <> hi OR n <> held THEN 1 ELSE 0 END), 0) = 0 AS fits, count(*) AS sites
        FROM (SELECT {k}, count(*) AS n, count({v}) AS held, min({v}) AS lo, max({v}) AS hi FROM rows GROUP BY {k}) WHERE held > 0"""
    for v in ("l_quantity", "o_totalprice")
    for d, k in (("l_orderkey", "l_linenumber"), ("l_linenumber", "l_orderkey"))
)


@query(f"WITH {LINES} {_LEVEL}")
def dims_fit_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, out = order_lines(spark, sf_dir), []
    for v in ("l_quantity", "o_totalprice"):
        found = describe.lattice_level(rows, [v], [("l_linenumber",), ("l_orderkey",)])
        out += [(v, "l_orderkey" if kept == ("l_linenumber",) else "l_linenumber", *got) for (_, kept), got in found.items()]
    return spark.createDataFrame(out, "variable string, without string, fits boolean, sites long")


@query(
    f"""WITH {LINES}, level AS ({_LEVEL}), n AS (SELECT count(*) AS n FROM rows),
    w AS (SELECT variable, without FROM level, n WHERE fits AND n > sites)
    SELECT v.variable, CASE WHEN w.without = 'l_orderkey' THEN 'l_linenumber' WHEN w.without = 'l_linenumber' THEN 'l_orderkey' ELSE 'l_orderkey,l_linenumber' END AS dims
    FROM (SELECT DISTINCT variable FROM level) v LEFT JOIN w USING (variable)"""
)
def infer_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, coords = order_lines(spark, sf_dir), ["l_orderkey", "l_linenumber"]
    sizes = {r["coord"]: r["n_values"] for r in describe.axes(rows, coords, ["l_quantity"]).collect()}
    found, _ = describe.infer_dims(rows, coords, ["l_quantity", "o_totalprice"], sizes)
    return spark.createDataFrame([(v, ",".join(d.dims)) for v, d in found.items()], "variable string, dims string")


HOURLY = ["user_id", "day", "hour"]
_SETS = [[c for c in HOURLY if k & 1 << HOURLY.index(c)] for k in range(8)]
_NAMED = {"peak": 0, "daily": 1, "tally": 2}
HOURS = """hours AS (SELECT user_id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE))::BIGINT AS day, hour(ts)::INT AS hour, max(value) AS peak FROM events GROUP BY ALL),
    rows AS (SELECT *, max(peak) OVER (PARTITION BY user_id, day) AS daily, count(*) OVER (PARTITION BY user_id)::DOUBLE AS tally FROM hours)"""


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events over (user_id, day, hour): peak varies on all three, daily repeats over hours, tally over days and hours."""
    at = [F.col("user_id"), F.date_diff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("long").alias("day"), F.hour("ts").alias("hour")]
    rows = table(spark, sf_dir, "events").groupBy(*at).agg(F.max("value").alias("peak"))
    daily = F.max("peak").over(Window.partitionBy("user_id", "day"))
    return rows.withColumn("daily", daily).withColumn("tally", F.count(F.lit(1)).over(Window.partitionBy("user_id")).cast("double"))


def _inferred_sql() -> str:
    """Dims by variable from every subset of the coordinates: sites and fit of each subset, then the choice among them."""
    fits, both = [], []
    for k, kept in enumerate(_SETS):
        by = ", ".join(kept) or "()"
        for v, i in _NAMED.items():
            without = [c for c in HOURLY if c not in kept]
            order = [w for n in range(4) for w in combinations(HOURLY, n)].index(tuple(without))
            # the lists name the kept dims in order; the rank follows the sizes and orders of the dims left out
            fits.append(
                f"SELECT '{v}' AS variable, {i} AS i, {k} AS k, '{','.join(kept)}' AS dims, '{','.join(without)}' AS without, {len(without)} AS out_of, {order} AS rank, count(*) AS sites, "
                f"bool_and(lo = hi AND n = held) AS fits FROM (SELECT count(*) AS n, count({v}) AS held, min({v}) AS lo, max({v}) AS hi FROM rows GROUP BY {by}) WHERE held > 0"
            )
        pairs = ", ".join(f"count(CASE WHEN a{i} AND a{j} THEN 1 END) AS b{i}{j}" for i in range(3) for j in range(3))
        flags = ", ".join(f"bool_or({v} IS NOT NULL) AS a{i}" for v, i in _NAMED.items())
        both.append(f"SELECT {k} AS k, {pairs} FROM (SELECT {flags} FROM rows GROUP BY {by})")
    held = " UNION ALL ".join(f"SELECT {i} AS i, count(DISTINCT {v}) AS values_, " + ", ".join(f"count(DISTINCT CASE WHEN {v} IS NOT NULL THEN {c} END) AS c{n}" for n, c in enumerate(HOURLY)) + " FROM rows" for v, i in _NAMED.items())
    bits = " + ".join(f"CASE WHEN c.k & p.k & {1 << n} > 0 THEN {1 << n} ELSE 0 END" for n in range(3))
    unused = " + ".join(f"CASE WHEN c.k & {1 << n} > 0 THEN g{n} - c{n} ELSE 0 END" for n in range(3))
    cells = " * ".join(f"CASE WHEN c.k & {1 << n} > 0 THEN g{n} ELSE 1 END" for n in range(3))
    pick = "CASE p.i " + " ".join(f"WHEN {i} THEN CASE c.i " + " ".join(f"WHEN {j} THEN b{i}{j}" for j in range(3)) + " END" for i in range(3)) + " END"
    own = "CASE c.i " + " ".join(f"WHEN {j} THEN b{j}{j}" for j in range(3)) + " END"
    ref = "CASE p.i " + " ".join(f"WHEN {j} THEN b{j}{j}" for j in range(3)) + " END"
    return f"""WITH {HOURS}, f AS ({" UNION ALL ".join(fits)}), h AS ({held}), s AS ({" UNION ALL ".join(both)}),
        g AS (SELECT {", ".join(f"count(DISTINCT {c}) AS g{n}" for n, c in enumerate(HOURLY))} FROM rows),
        w AS (SELECT f.* FROM f JOIN h USING (i) JOIN f AS whole ON whole.i = f.i AND whole.k = 7
              WHERE f.k = 7 OR (f.fits AND h.values_ > 1 AND whole.sites > f.sites)),
        c AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY i ORDER BY out_of DESC, rank) = 1),
        p AS (SELECT * FROM c ORDER BY sites DESC, i LIMIT 1),
        a AS (SELECT c.i, coalesce(string_agg(d, ',' ORDER BY n), '') AS ambiguous FROM c LEFT JOIN (VALUES {", ".join(f"({n}, '{c}')" for n, c in enumerate(HOURLY))}) AS t(n, d)
              ON c.k & (1 << n) > 0 AND (SELECT x.fits FROM f AS x WHERE x.i = c.i AND x.k = c.k - (1 << n)) GROUP BY c.i),
        m AS (SELECT c.*, p.i AS ref, {bits} AS common FROM c, p)
        SELECT CASE WHEN c.i = p.i THEN 0 ELSE row_number() OVER (ORDER BY c.i = p.i, c.i) END::INT AS position, c.variable, c.dims, ({cells})::BIGINT AS var_sites, c.sites AS var_sites_occupied,
               c.sites / ({cells})::DOUBLE AS density, CASE WHEN c.i <> p.i AND c.common > 0 THEN ({pick}) / greatest({ref}, 1)::DOUBLE END AS overlap,
               CASE WHEN c.i <> p.i AND c.common > 0 THEN ({pick}) / ({own})::DOUBLE END AS overlap_reverse, ({unused})::BIGINT AS unused_coords, 'double' AS dtype, c.without AS assumed_constant, a.ambiguous
        FROM m AS c JOIN p ON c.ref = p.i JOIN h ON h.i = c.i JOIN s ON s.k = c.common JOIN a ON a.i = c.i, g"""


@query(_inferred_sql())
def describe_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole description of three variables on three coordinates, their dims inferred from the rows."""
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        got = describe.describe(hourly(spark, sf_dir), HOURLY)
    text = lambda c: F.array_join(c, ",").alias(c)
    plain = [c for c in got.columns if c not in ("dims", "assumed_constant", "ambiguous_dims")]
    return got.select(*plain, text("dims"), text("assumed_constant"), F.array_join("ambiguous_dims", ",").alias("ambiguous"))


@query(
    f"""WITH {CUBE}, c AS (SELECT count(click) AS ref_size, count(error) AS var_size, count(CASE WHEN click IS NOT NULL AND error IS NOT NULL THEN 1 END) AS shared FROM cube)
    SELECT *, CASE WHEN ref_size > 0 THEN shared / ref_size::DOUBLE ELSE 0 END AS overlap, CASE WHEN var_size > 0 THEN shared / var_size::DOUBLE ELSE 0 END AS overlap_reverse FROM c"""
)
def overlap_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cube(spark, sf_dir)
    return place.overlap_report(rows.filter("click is not null"), rows.filter("error is not null"), COORDS)


@query(
    f"""WITH {CUBE}, g AS (SELECT count(DISTINCT user_id) AS u, count(DISTINCT day) AS d FROM cube)
    SELECT count(*) AS n_rows, ({" + ".join(f"count(*) - count({k})" for k in KINDS)}) AS tabular_null_cells, any_value(u * d) AS grid_points,
    any_value(u + d) AS array_coord_values, any_value(u * d * 5) AS array_values, any_value(u * d * 5) - ({" + ".join(f"count({k})" for k in KINDS)}) AS array_null_cells FROM cube, g"""
)
def storage_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return describe.storage_schema(cube(spark, sf_dir), COORDS, KINDS)


# -- layout -------------------------------------------------------------------------------------------------------


@query("SELECT s_suppkey, s_nationkey, s_acctbal, n_regionkey FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT NULL, n_nationkey, NULL, n_regionkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def fewer_dims_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A variable on (supplier, nation) and one on nation, repeated for each supplier."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    dims = ["s_suppkey", "s_nationkey"]
    return layout.to_table({"s_acctbal": (dims, suppliers), "n_regionkey": (["s_nationkey"], nations)}, dims)


@query("SELECT s_suppkey, s_nationkey, s_acctbal, n_regionkey FROM (SELECT * FROM supplier WHERE s_acctbal > 5000) LEFT JOIN nation ON s_nationkey = n_nationkey UNION ALL SELECT NULL, n_nationkey, NULL, n_regionkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def unmatched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As fewer_dims_repeat, with nations that no rich supplier has as rows of their own."""
    suppliers = table(spark, sf_dir, "supplier").filter("s_acctbal > 5000").select("s_suppkey", "s_nationkey", "s_acctbal")
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_regionkey")
    dims = ["s_suppkey", "s_nationkey"]
    return layout.to_table({"s_acctbal": (dims, suppliers), "n_regionkey": (["s_nationkey"], nations)}, dims)


@query("SELECT p_brand, p_type, max(p_retailprice) AS p_retailprice FROM part GROUP BY 1, 2")
def project_constant_dims(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.project(table(spark, sf_dir, "part"), ["p_brand", "p_type"], "p_retailprice")


@query(
    """WITH o AS (SELECT c_nationkey AS n, left(o_orderpriority, 1)::INT AS p, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS filled, max(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END) AS open_
                  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 100000 AND c_nationkey % 5 > 0 GROUP BY ALL HAVING filled IS NOT NULL OR open_ IS NOT NULL),
    b AS (SELECT s_nationkey AS n, max(s_acctbal) AS balance FROM supplier GROUP BY 1), q AS (SELECT DISTINCT left(o_orderpriority, 1)::INT AS p, substr(o_orderpriority, 3) AS label FROM orders),
    t AS (SELECT n, p, filled, open_, balance FROM o LEFT JOIN b USING (n) UNION ALL SELECT n, NULL, NULL, NULL, balance FROM b WHERE n NOT IN (SELECT n FROM o))
    SELECT n_name AS nation, label AS priority, filled, open_, balance FROM t JOIN nation ON n = n_nationkey LEFT JOIN q USING (p)"""
)
def labelled_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two variables on (nation, priority), aligned, and one on nation that fills or adds rows; indices become labels."""
    orders, customers = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    number = F.substring("o_orderpriority", 1, 1).cast("long")
    rows = orders.filter("o_totalprice > 100000").join(customers.filter("c_nationkey % 5 > 0"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(F.col("c_nationkey").cast("long").alias("nation"), number.alias("priority"), "o_orderstatus", "o_totalprice")
    held = lambda status, name: layout.project(rows.filter(F.col("o_orderstatus") == status).withColumnRenamed("o_totalprice", name), ["nation", "priority"], name)
    balance = layout.project(table(spark, sf_dir, "supplier").select(F.col("s_nationkey").cast("long").alias("nation"), F.col("s_acctbal").alias("balance")), ["nation"], "balance")
    dims = ["nation", "priority"]
    wide = layout.to_table({"filled": (dims, held("F", "filled")), "open_": (dims, held("O", "open_")), "balance": (["nation"], balance)}, dims)
    nations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("i"), F.col("n_name").alias("x"))
    priorities = orders.select(number.alias("i"), F.substring("o_orderpriority", 3, 99).alias("x")).distinct()
    return layout.label(wide, {"nation": nations, "priority": priorities})


@query(f"WITH {CUBE}, s AS (SELECT user_id, unnest(range(30)) AS day FROM (SELECT DISTINCT user_id FROM cube)) SELECT s.user_id, array_to_string(list(coalesce(printf('%.2f', click), '-') ORDER BY s.day), ' ') AS slab FROM s LEFT JOIN cube ON s.user_id = cube.user_id AND s.day = cube.day GROUP BY 1")
def slab_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense array of all days, 30 at least, a user, as text so that it can be compared."""
    rows = cube(spark, sf_dir)
    users, days = (x + 1 for x in rows.agg(F.max("user_id"), F.max("day")).first())
    slabs = layout.to_slabs(rows, "user_id", ["day"], {"user_id": users, "day": max(days, 30)}, "click")
    text = F.array_join(F.transform("slab", lambda x: F.when(x.isNull(), "-").otherwise(F.format_string("%.2f", x))), " ")
    return slabs.join(rows.select("user_id").distinct(), "user_id", "left_semi").select("user_id", text.alias("slab"))


# -- apportionment and chunks -------------------------------------------------------------------------------------

_SHARES = """b AS (SELECT c_nationkey AS bin, count(*)::DOUBLE AS w FROM customer GROUP BY 1),
    r AS (SELECT bin, w, 1000 * w / sum(w) OVER () AS raw FROM b), l AS (SELECT *, floor(raw) AS low FROM r),
    p AS (SELECT *, row_number() OVER (ORDER BY raw - low DESC, bin DESC) AS place, 1000 - sum(low) OVER () AS short FROM l)"""


@query(f"WITH {_SHARES} SELECT bin, (low + CASE WHEN place <= short THEN 1 ELSE 0 END)::BIGINT AS share FROM p")
def apportion_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("bin")).agg(F.count(F.lit(1)).alias("w"))
    return apportion.apportion(bins, F.lit(1000), "w", "bin").select("bin", "share")


def _capped_sql(rounds: int = 8) -> str:
    """Rounds of largest remainders by weight, then by room; what exceeds a bin goes to the next round."""
    out = ["r0 AS (SELECT c_nationkey AS bin, count(*)::DOUBLE AS w, 0 AS got, 1000 AS total FROM customer GROUP BY 1)"]
    for k in range(rounds):
        by = "w" if k == 0 else "(42 - got)::DOUBLE"
        out.append(f"e{k} AS (SELECT *, coalesce(total * {by} / nullif(sum({by}) OVER (), 0), 0) AS raw FROM r{k})")
        out.append(f"d{k} AS (SELECT *, floor(raw) + CASE WHEN row_number() OVER (ORDER BY raw - floor(raw) DESC, bin DESC) <= total - sum(floor(raw)) OVER () THEN 1 ELSE 0 END AS give FROM e{k})")
        out.append(f"t{k} AS (SELECT bin, w, least(42, got + give)::INT AS got, total, least(give, 42 - got) AS took FROM d{k})")
        out.append(f"r{k + 1} AS (SELECT bin, w, got, least(total - sum(took) OVER (), sum(42 - got) OVER ())::INT AS total FROM t{k})")
    return f"WITH {', '.join(out)} SELECT bin, got::BIGINT AS share FROM r{rounds}"


@query(_capped_sql())
def apportion_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1000 units over nations by customers, at most 42 each."""
    bins = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").alias("bin")).agg(F.count(F.lit(1)).alias("w"))
    return apportion.apportion_capped(bins.withColumn("cap", F.lit(42).cast("long")), F.lit(1000), "w", "cap", "bin").select("bin", "share")


@query("WITH n AS (SELECT count(DISTINCT o_orderdate) AS n FROM orders), k AS (SELECT unnest(range(7)) AS chunk) SELECT chunk::BIGINT AS chunk, (chunk * (n // 7) + least(chunk, n % 7))::BIGINT AS lo, ((chunk + 1) * (n // 7) + least(chunk + 1, n % 7))::BIGINT AS hi FROM k, n")
def chunk_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").select("o_orderdate").distinct().count()
    return spark.createDataFrame([(k, *b) for k, b in enumerate(apportion.chunk_bounds(n, 7))], "chunk long, lo long, hi long")


# -- placement ----------------------------------------------------------------------------------------------------


def _u(tag: int, *index: str) -> str:
    key = f"concat_ws(':', '{SEED}', '{tag}'" + "".join(f", {i}" for i in index) + ")"
    return f"(('0x' || substr(md5({key}), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


GRID = f"""{CUBE}, axis AS (SELECT (max(day) + 1)::BIGINT AS days FROM cube), grid AS (SELECT j, unnest(range((SELECT days FROM axis)))::BIGINT AS k FROM (SELECT DISTINCT user_id AS j FROM cube)),
    counts AS (SELECT user_id AS j, count(error) AS n FROM cube GROUP BY 1), held AS (SELECT user_id AS j, day::BIGINT AS k FROM cube WHERE click IS NOT NULL)"""


class Placed:
    """Users (strata) by days (cells): cells with a click are held, and a user's errors say how many to place."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.rows = cube(spark, sf_dir)
        self.days = self.rows.agg(F.max("day")).first()[0] + 1
        self.users = self.rows.select(F.col("user_id").alias("j")).distinct()
        self.grid = self.users.select("j", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(self.days - 1).cast("long"))).alias("k"))
        self.held = self.rows.filter("click is not null").select(F.col("user_id").alias("j"), F.col("day").alias("k"))
        self.counts = self.rows.groupBy(F.col("user_id").alias("j")).agg(F.count("error").alias("n"))


@query(f"WITH {GRID} SELECT i - 1 AS i, x FROM (SELECT row_number() OVER (ORDER BY x) AS i, x FROM (SELECT {_u(0, '1', 'd')} AS x FROM (SELECT unnest(range((SELECT count(DISTINCT user_id) FROM cube))) AS d)))")
def axis_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place.axis_table(spark, SEED, 1, Placed(spark, sf_dir).users.count()).select(F.col("i").cast("long"), "x")


@query(f"WITH {GRID}, n AS (SELECT count(DISTINCT user_id) AS u, any_value(days) AS d FROM cube, axis) SELECT p::BIGINT AS p, (row_number() OVER (ORDER BY {_u(1, '0', 'p')}) - 1) % u AS i0, (row_number() OVER (ORDER BY {_u(1, '1', 'p')}) - 1) % d AS i1 FROM (SELECT unnest(range((SELECT greatest(u, d) FROM n))) AS p), n")
def lhs_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = Placed(spark, sf_dir)
    return place.lhs(spark, SEED, [at.users.count(), at.days])


def _ranked(draw: str, of: str) -> str:
    return f"WITH {GRID}, f AS (SELECT j, k, row_number() OVER (PARTITION BY j ORDER BY {draw}, k) AS r FROM {of}) SELECT j, k FROM f JOIN counts USING (j) WHERE r <= n"


_FREE = "(SELECT grid.* FROM grid ANTI JOIN held USING (j, k))"


@query(_ranked(_u(2, "j", "k"), _FREE))
def stratified_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = Placed(spark, sf_dir)
    return place.stratified_fill(spark, SEED, at.grid, at.held, at.counts).select("j", "k")


@query(f"WITH {GRID} SELECT j, unnest(range(n))::BIGINT AS cell FROM counts")
def padded_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place.padded_lines(Placed(spark, sf_dir).counts).select("j", "cell")


@query(_ranked(_u(11, "j", "k"), "held"))
def overlap_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = Placed(spark, sf_dir)
    return place.overlap_prefix(SEED, at.held, at.counts, "n").select("j", "k")


@query(_ranked(_u(10, "3", "j", "k"), "held"))
def overlap_independent(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = Placed(spark, sf_dir)
    return place.overlap_prefix(SEED, at.held, at.counts, "n", var=3).select("j", "k")


@query(_ranked(_u(10, "3", "j", "k"), _FREE))
def remainder_outside(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = Placed(spark, sf_dir)
    return place.remainder_outside(SEED, 3, at.grid, at.held, at.counts, "n").select("j", "k")


@query(f"WITH {GRID} SELECT j, k, r FROM (SELECT j, k, row_number() OVER (PARTITION BY j ORDER BY k) - 1 AS r FROM {_FREE}) JOIN counts USING (j) WHERE r < n")
def rank_to_free_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first free days of each user, as many as the user has errors, without a list of free days."""
    at = Placed(spark, sf_dir)
    free = at.counts.join(at.held.groupBy("j").agg(F.count(F.lit(1)).alias("held")), "j", "left")
    n = F.least("n", F.lit(at.days) - F.coalesce("held", F.lit(0)))
    ranks = place.padded_lines(free.select("j", n.alias("n"))).select("j", F.col("cell").alias("r"))
    return place.free_slots(ranks, at.held).select("j", "k", "r")


@query(f"WITH {GRID}, p AS (SELECT j, n, count(*) AS held FROM counts JOIN held USING (j) GROUP BY ALL) SELECT j, greatest(greatest(0, n - (days - held)), least(n, held, round_even(0.35 * held, 0)))::BIGINT AS both_held FROM p, axis")
def overlap_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = Placed(spark, sf_dir)
    strata = at.counts.join(at.held.groupBy("j").agg(F.count(F.lit(1)).alias("held")), "j").withColumn("plane", F.lit(at.days))
    return place.overlap_counts(strata, 0.35, "n", "held", "plane").select("j", F.col("both").alias("both_held"))


def generated(spark: SparkSession, sf_dir: str) -> dict:
    """A cube of m x 2m x m, m even and about the cube root of the orders, a quarter full, with two further variables."""
    m = 2 * round((table(spark, sf_dir, "orders").count() ** (1 / 3)) / 2)
    return {"num_obs": m**3 // 2, "num_dims": 3, "ratio_dims": [1, 2, 1], "density": 0.25, "seed": SEED, "num_vars": 3, "var_dims": [3, 3, [0, 1]], "overlap": [0.5, 0.4]}


_M = "m AS (SELECT (2 * round(count(*) ** (1 / 3.0) / 2))::BIGINT AS m FROM orders)"


@query(
    f"""WITH {_M} SELECT 'x0' AS part, m AS n, 0 AS lo FROM m UNION ALL SELECT 'x1', 2 * m, 0 FROM m UNION ALL SELECT 'x2', m, 0 FROM m UNION ALL SELECT 'var0', m * m * m // 2, 0 FROM m
    UNION ALL SELECT 'var1', m * m * m // 2, 0 FROM m UNION ALL SELECT 'var0 with var1', round_even(m * m * m / 4.0, 0)::BIGINT, 0 FROM m UNION ALL SELECT 'var2 on its dims', round_even(m * m / 2.0, 0)::BIGINT, 0 FROM m
    UNION ALL SELECT 'sites of one row only', 0, 0"""
)
def generated_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What must hold of a generated dataset: axis lengths, every coordinate used, counts, overlap, no repeated site."""
    rows = generate.generate(spark, GridSpec(**generated(spark, sf_dir)))
    on, whole = ["x0", "x1", "x2"], rows.filter("x2 is not null")
    facts = [*[(c, rows.select(c).filter(f"{c} is not null").distinct().count()) for c in on], *[(v, rows.filter(f"{v} is not null").count()) for v in ("var0", "var1")]]
    facts.append(("var0 with var1", rows.filter("var0 is not null and var1 is not null").count()))
    facts.append(("var2 on its dims", rows.filter("var2 is not null").select("x0", "x1").distinct().count()))
    facts.append(("sites of one row only", whole.count() - whole.select(*on).distinct().count()))
    return spark.createDataFrame([(part, n, 0) for part, n in facts], "part string, n long, lo int")


@query(f"WITH {_M} SELECT m * m * m // 2 AS ref_size, m * m * m // 2 AS var_size, round_even(m * m * m / 4.0, 0)::BIGINT AS shared FROM m")
def generated_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sites that var0 and var1 share are as many as the target asks for."""
    rows, on = generate.sites(spark, GridSpec(**generated(spark, sf_dir))), ["i0", "i1", "i2"]
    return place.overlap_report(rows.filter("var = 0"), rows.filter("var = 1"), on).select("ref_size", "var_size", "shared")


@query(f"WITH {_M} SELECT m // 2 AS lo, m * m * 2 * (m - m // 2) AS cells, m - m // 2 AS strata FROM m")
def synthetic_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The generator as a source; a filter on the split axis reaches it, so only those strata are generated."""
    import json

    synthetic.register(spark)
    given = generated(spark, sf_dir) | {"density": 1.0, "num_vars": 1, "var_dims": None, "overlap": "random", "ratio_dims": [2, 1, 1]}
    given["num_obs"] *= 4
    rows = spark.read.format("gridlab").option("spec", json.dumps(given)).load()
    half = GridSpec(**given).shape[1] // 2
    got = rows.filter(F.col("i0") >= 2 * half).agg(F.count(F.lit(1)).alias("cells"), (F.count_distinct("i0") / 2).cast("long").alias("strata"))
    return got.select(F.lit(half).cast("long").alias("lo"), "cells", "strata")


# -- encodings and fields -----------------------------------------------------------------------------------------

_PACK = encode.Packing("int16", 0.0, 0.1)
# 0.1 / 65533 and 0.1 - 32767 * (0.1 / 65533), rounded to float32
_SCALE, _OFFSET = "1.5259487327057286e-06", "0.049999237060546875"
_LINE = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def _keys() -> list[str]:
    return _LINE.split(", ")


@query(f"SELECT {_LINE}, 5.0::DOUBLE + 20.0::DOUBLE * l_discount AS v FROM lineitem")
def affine_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(*_keys(), encode.affine(F.col("l_discount"), 5, 25).alias("v"))


@query(f"SELECT {_LINE}, least(9, greatest(-3, -3 + floor(l_discount * 13)))::BIGINT AS v FROM lineitem")
def int_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(*_keys(), encode.int_bins(F.col("l_discount"), -3, 9).alias("v"))


@query(f"SELECT {_LINE}, l_extendedprice::FLOAT::DOUBLE AS v FROM lineitem")
def f32_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(*_keys(), encode.single(F.col("l_extendedprice")).alias("v"))


_CODE = f"least(32767, greatest(-32766, round_even((l_tax - {_OFFSET}::DOUBLE) / {_SCALE}::DOUBLE, 0)))"


@query(f"SELECT {_LINE}, {_CODE}::SMALLINT AS code FROM lineitem")
def pack_int16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(*_keys(), _PACK.code(F.col("l_tax")).alias("code"))


@query(f"SELECT {_LINE}, ({_OFFSET}::DOUBLE + {_SCALE}::DOUBLE * {_CODE})::FLOAT::DOUBLE AS v FROM lineitem")
def unpack_int16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _lines(spark, sf_dir).select(*_keys(), _PACK.value(_PACK.code(F.col("l_tax"))).cast("double").alias("v"))


@query("SELECT o_orderkey, CASE WHEN n < 1024 THEN printf('%d B', n) WHEN n < 1048576 THEN printf('%.1f KiB', n / 1024.0::DOUBLE) WHEN n < 1073741824 THEN printf('%.1f MiB', n / 1048576.0::DOUBLE) ELSE printf('%.1f GiB', n / 1073741824.0::DOUBLE) END AS size FROM (SELECT o_orderkey, (o_orderkey * o_orderkey * 7)::BIGINT AS n FROM orders)")
def byte_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") * F.col("o_orderkey") * 7).alias("n"))
    return rows.select("o_orderkey", encode.format_bytes(F.col("n"), top="GiB").alias("size"))


@query("SELECT n_nationkey, n_name, n_regionkey, 2 AS parts, true AS sized FROM nation")
def written_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small nation table written with a bound on rows a file, opened again, measured and removed."""
    path = f"{spark.conf.get('spark.sql.warehouse.dir')}/gridlab-{uuid.uuid4().hex}"
    nations = table(spark, sf_dir, "nation")
    try:
        files.write(nations.coalesce(1), path, max_records=13)
        back = files.read(spark, path)
        rows, parts, sized = back.collect(), len(back.inputFiles()), files.disk_size(spark, path) > 0  # 25 rows
    finally:
        files.remove_scratch(spark, path)
    return spark.createDataFrame([(*r, parts, sized) for r in rows], "n_nationkey int, n_name string, n_regionkey int, parts int, sized boolean")


@query("SELECT o_orderkey, lpad(upper(" + " || ".join(f"substr('0123456789abcdefghijklmnopqrstuvwxyz', (o_orderkey // {36**i}) % 36 + 1, 1)" for i in (4, 3, 2, 1, 0)) + "), 5, '0') AS code FROM orders")
def base36_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", encode.base36(F.col("o_orderkey"), 5).alias("code"))


_PHASE = np.arange(8) * 0.7
_WAVES = np.stack([np.linspace(-0.3, 0.4, 8), np.linspace(0.2, -0.1, 8)], axis=1)


@query(
    f"WITH {GRID} SELECT j, k, round(("
    + " + ".join(f"cos({float(p)!r}::DOUBLE + {float(a)!r}::DOUBLE * j + {float(b)!r}::DOUBLE * k)" for p, (a, b) in zip(_PHASE, _WAVES))
    + ") * sqrt(2.0::DOUBLE / 8), 6) AS s FROM grid"
)
def field_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Placed(spark, sf_dir).grid.select("j", "k", F.round(field.wave_sum(_PHASE, _WAVES, [F.col("j"), F.col("k")]), 6).alias("s"))


@query(f"WITH {GRID} SELECT j, k, {_u(10, '0', 'j', 'k')} AS u FROM grid")
def random_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Placed(spark, sf_dir).grid.select("j", "k", uniform(SEED, 10, F.lit(0), F.col("j"), F.col("k")).alias("u"))


@query("SELECT c_custkey, (c_acctbal + 1000) / 11001 AS u, 0::INT AS off FROM customer")
def normal_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draw through the inverse normal distribution function and back is the draw again."""
    u = (F.col("c_acctbal") + 1000) / 11001
    back = field.ndtr(field.ndtri(u))
    return table(spark, sf_dir, "customer").select("c_custkey", u.alias("u"), F.when(F.abs(back - u) < 1e-9, 0).otherwise(1).alias("off"))
