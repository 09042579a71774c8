"""One registered query per operator, over the driver's tables, with its SQL.

Tables stand in for datasets: their key is the natural order.  ``events`` is a
version log of its users: an event inserts or updates the user's row, and an
``error`` deletes it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import functions as fn
from .dataset import Catalog, Config, Dataset, Mode
from .errors import DatasetError
from .operators import IndexRoot, Query, SetIndexRoot
from .plans import versions as plan
from .sources.files import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, sql: str, f: Callable[[SparkSession, str], DataFrame]) -> None:
    QUERIES[name], ORACLES[name] = f, sql


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_KEYS = {"customer": ["c_custkey"], "orders": ["o_orderkey"], "part": ["p_partkey"], "lineitem": ["l_orderkey", "l_linenumber"], "nation": ["n_nationkey"], "events": ["event_id"], "embeddings": ["vec_id"]}


def _query(name: str, q: Callable[[Query], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, d: q(Query(table(spark, d, name), list(_KEYS[name])))


def _indexed(name: str, key: str, q: Callable[[IndexRoot], Query], then: Callable[[Query], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        df = table(spark, d, name)
        return then(q(IndexRoot(F.expr(key), lambda p, k: Query(df.where(p), list(_KEYS[name]), order=[k]))))

    return run


def _count(df: DataFrame) -> DataFrame:
    return df.agg(F.count("*").alias("n"))


def _plain(df: Query) -> DataFrame:
    return df.to_df(ordered=False)


# C: the query builder

_add("c1_where", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000 AND o_custkey % 2 = 0", _query("orders", lambda q: q.where("o_orderstatus = 'F' AND o_totalprice > 100000 AND o_custkey % 2 = 0").select("o_orderkey", "o_totalprice", ordered=False)))
_add("c2_order_by", "SELECT c_custkey, c_mktsegment, row_number() OVER (ORDER BY c_mktsegment, c_acctbal DESC, c_custkey) - 1 AS place FROM customer WHERE c_nationkey = 3", _query("customer", lambda q: q.where("c_nationkey = 3").order_by("c_mktsegment", F.desc("c_acctbal")).select("c_custkey", "c_mktsegment", fn.ordinal("c_mktsegment", F.desc("c_acctbal"), "c_custkey").cast("long").alias("place"))))
_add("c3_skip", "SELECT c_custkey FROM customer ORDER BY c_custkey OFFSET 100", _query("customer", lambda q: q.skip(100).select("c_custkey")))
_add("c4_limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 50", _query("orders", lambda q: q.limit(50).select("o_orderkey")))
_add("c5_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100 OFFSET 20", _query("orders", lambda q: q.order_by(F.desc("o_totalprice")).skip(20).limit(100).select("o_orderkey", "o_totalprice")))
_add("c6_sum_int", "SELECT CAST(coalesce(sum(l_linenumber), 0) AS INTEGER) AS value FROM lineitem WHERE l_returnflag = 'R'", _query("lineitem", lambda q: q.where("l_returnflag = 'R'").aggregate("sum", "l_linenumber")))
_add("c6_sum_long", "SELECT CAST(sum(l_partkey) AS BIGINT) AS value FROM lineitem", _query("lineitem", lambda q: q.aggregate("sum", "l_partkey")))
_add("c6_sum_decimal", "SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(15,2))) AS DECIMAL(38,2)) AS value FROM lineitem", _query("lineitem", lambda q: q.aggregate("sum", F.col("l_extendedprice").cast("decimal(15,2)"))))
_add("c6_sum_double", "SELECT round(sum(l_quantity), 2) AS value FROM lineitem", _query("lineitem", lambda q: q.aggregate("sum", "l_quantity").select(F.round("value", 2).alias("value"))))
_add("c6_sum_float", "SELECT CAST(sum(CAST(l_linenumber AS DOUBLE)) AS FLOAT) AS value FROM lineitem", _query("lineitem", lambda q: q.aggregate("sum", F.col("l_linenumber").cast("float"))))
_add("c6_sum_after_page", "SELECT CAST(sum(p_size) AS INTEGER) AS value FROM (SELECT p_size FROM part ORDER BY p_partkey LIMIT 100 OFFSET 100)", _query("part", lambda q: q.skip(100).limit(100).aggregate("sum", "p_size")))
_add("c6_sum_empty", "SELECT CAST(0 AS INTEGER) AS value", _query("part", lambda q: q.where("p_size < 0").aggregate("sum", "p_size")))
_add("c7_max", "SELECT max(c_name) AS value FROM customer WHERE c_mktsegment = 'BUILDING'", _query("customer", lambda q: q.where("c_mktsegment = 'BUILDING'").aggregate("max", "c_name")))
_add("c8_min", "SELECT min(o_orderdate) AS value FROM orders WHERE o_totalprice > 50000", _query("orders", lambda q: q.where("o_totalprice > 50000").aggregate("min", "o_orderdate")))
_add("c9_avg_int", "SELECT round(avg(p_size), 6) AS value FROM part", _query("part", lambda q: q.aggregate("avg", "p_size").select(F.round("value", 6).alias("value"))))
_add("c9_avg_decimal", "SELECT CAST(round(CAST(sum(CAST(l_quantity AS DECIMAL(15,2))) AS DOUBLE) / count(*), 4) AS DOUBLE) AS value FROM lineitem", _query("lineitem", lambda q: q.aggregate("avg", F.col("l_quantity").cast("decimal(15,2)")).select(F.round(F.col("value").cast("double"), 4).alias("value"))))
_add("c10_select", "SELECT p_partkey, p_name || '/' || p_brand AS path, length(p_name) AS n FROM part", _query("part", lambda q: q.select("p_partkey", fn.join_path("p_name", "p_brand").alias("path"), F.length("p_name").cast("long").alias("n"), ordered=False)))
_add("c11_select_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem", _query("lineitem", lambda q: q.select_distinct("l_returnflag", "l_linestatus")))
_add("c11_distinct_after_page", "SELECT DISTINCT o_orderpriority FROM (SELECT o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 4 OFFSET 10)", _query("orders", lambda q: q.skip(10).limit(4).select_distinct("o_orderpriority")))
_add("c12_to_df", "SELECT * FROM nation", _query("nation", _plain))
_add("c15_group_by", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, round(avg(l_discount), 6) AS disc FROM lineitem GROUP BY ALL", _query("lineitem", lambda q: q.group_by("l_returnflag", "l_linestatus").select(F.count("*").alias("n"), F.sum("l_quantity").alias("qty"), F.round(F.avg("l_discount"), 6).alias("disc"))))
_add("c16_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 12 AND max(o_totalprice) > 200000", _query("orders", lambda q: q.group_by("o_custkey").having((F.count("*") > 12) & (F.max("o_totalprice") > 200000)).select(F.count("*").alias("n"))))
_add("c17_grouped_select", "SELECT n_regionkey, array_to_string(list(n_name ORDER BY n_name), ',') AS names, min(n_nationkey) AS first FROM nation GROUP BY 1", _query("nation", lambda q: q.group_by("n_regionkey").select(F.array_join(F.array_sort(F.collect_list("n_name")), ",").alias("names"), F.min("n_nationkey").alias("first"))))
_add("c17_group_after_page", "SELECT o_orderstatus, count(*) AS n FROM (SELECT * FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 500 OFFSET 100) GROUP BY 1", _query("orders", lambda q: q.order_by("o_orderdate").skip(100).limit(500).group_by("o_orderstatus").select(F.count("*").alias("n"))))

# D: scalar index roots

_D = {
    "d1_equal": (lambda r: r.equal(7), "o_custkey = 7"),
    "d2_in": (lambda r: r.isin(7, 11, 7, -1), "o_custkey IN (7, 11, -1)"),
    "d3_not_equal": (lambda r: r.not_equal(7), "o_custkey <> 7"),
    "d4_greater": (lambda r: r.greater(700), "o_custkey > 700"),
    "d5_less": (lambda r: r.less(20), "o_custkey < 20"),
    "d6_greater_equal": (lambda r: r.greater_equal(700), "o_custkey >= 700"),
    "d7_less_equal": (lambda r: r.less_equal(20), "o_custkey <= 20"),
    "d8_between": (lambda r: r.between(10, 20), "o_custkey BETWEEN 10 AND 20"),
    "d8_between_reversed": (lambda r: r.between(20, 10), "false"),
    "d9_not_between": (lambda r: r.not_between(10, 700), "o_custkey NOT BETWEEN 10 AND 700"),
    "d9_not_between_reversed": (lambda r: r.not_between(700, 10), "true"),
}
for _name, (_root, _where) in _D.items():
    _add(_name, f"SELECT o_orderkey, o_custkey FROM orders WHERE {_where}", _indexed("orders", "o_custkey", _root, lambda q: q.select("o_orderkey", "o_custkey", ordered=False)))
_add("d11_count", "SELECT count(*) AS n FROM orders WHERE o_custkey > 100", _indexed("orders", "o_custkey", lambda r: r.greater(100), lambda q: _count(_plain(q))))
_add("d12_residual_where", "SELECT o_orderkey FROM orders WHERE o_custkey > 100 AND o_orderstatus = 'O'", _indexed("orders", "o_custkey", lambda r: r.greater(100), lambda q: q.where("o_orderstatus = 'O'").select("o_orderkey", ordered=False)))
_add("d13_key_order", "SELECT o_orderkey FROM orders WHERE o_custkey >= 100 ORDER BY o_custkey, o_orderkey LIMIT 20 OFFSET 5", _indexed("orders", "o_custkey", lambda r: r.greater_equal(100), lambda q: q.skip(5).limit(20).select("o_orderkey")))
_add("d13_order_by", "SELECT o_orderkey FROM orders WHERE o_custkey >= 100 ORDER BY o_orderkey DESC LIMIT 100 OFFSET 100", _indexed("orders", "o_custkey", lambda r: r.greater_equal(100), lambda q: q.order_by(F.desc("o_orderkey")).skip(100).limit(100).select("o_orderkey")))
_add("d14_group_having", "SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_custkey < 500 GROUP BY 1 HAVING count(*) > 10", _indexed("orders", "o_custkey", lambda r: r.less(500), lambda q: q.group_by("o_orderpriority").having(F.count("*") > 10).select(F.count("*").alias("n"))))
_add("d15_where_page", "SELECT o_orderkey FROM orders WHERE o_custkey > 100 AND o_orderstatus = 'F' ORDER BY o_custkey, o_orderkey OFFSET 30", _indexed("orders", "o_custkey", lambda r: r.greater(100), lambda q: q.where("o_orderstatus = 'F'").skip(30).select("o_orderkey")))
_add("d16_select_distinct", "SELECT DISTINCT o_orderpriority FROM orders WHERE o_custkey = 7", _indexed("orders", "o_custkey", lambda r: r.equal(7), lambda q: q.select_distinct("o_orderpriority")))
for _kind in ("sum", "min", "max", "avg"):
    _add(f"d17_d19_{_kind}", f"SELECT round({_kind}(o_totalprice), 2) AS value FROM orders WHERE o_custkey BETWEEN 5 AND 50", _indexed("orders", "o_custkey", lambda r: r.between(5, 50), lambda q, k=_kind: q.aggregate(k, "o_totalprice").select(F.round("value", 2).alias("value"))))
_add("e2_computed_key", "SELECT p_partkey FROM part WHERE length(p_name) = 20", _indexed("part", "length(p_name)", lambda r: r.equal(20), lambda q: q.select("p_partkey", ordered=False)))
_add("e3_collated_key", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'building'", _indexed("customer", "collate(c_mktsegment, 'UNICODE_CI')", lambda r: r.equal("bUILDing"), lambda q: q.select("c_custkey", ordered=False)))

# F: array roots, over the line numbers of each order

_ARRAYS = "(SELECT l_orderkey, list(CAST(l_quantity AS INTEGER)) AS a FROM lineitem GROUP BY 1 UNION ALL SELECT -1, CAST([] AS INTEGER[]))"


def _set_root(q: Callable[[SetIndexRoot], Query]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.col("l_quantity").cast("int")).alias("a"))
        rows = rows.unionByName(spark.range(1).select(F.lit(-1).cast("long").alias("l_orderkey"), F.array().cast("array<int>").alias("a")))
        return q(SetIndexRoot(F.col("a"), lambda p, k: Query(rows.where(p), ["l_orderkey"]))).select("l_orderkey", ordered=False)

    return run


_NONE = "len(a) > 0 AND len(list_filter(a, lambda x: NOT ({}))) = 0"
_SOME = "len(list_filter(a, lambda x: {})) > 0"
_F: dict[str, tuple[Callable[[SetIndexRoot], Query], str]] = {
    "f1_any_equal": (lambda r: r.any_equal(7), _SOME.format("x = 7")),
    "f2_any_in": (lambda r: r.any_in(7, 9), _SOME.format("x IN (7, 9)")),
    "f3_any_not_equal": (lambda r: r.any_not_equal(7), _SOME.format("x <> 7")),
    "f4_any_not_in": (lambda r: r.any_not_in(7, 9), _SOME.format("x NOT IN (7, 9)")),
    "f5_all_not_equal": (lambda r: r.all_not_equal(7), _NONE.format("x <> 7")),
    "f6_all_not_in": (lambda r: r.all_not_in(7, 9), _NONE.format("x NOT IN (7, 9)")),
    "f7_any_greater": (lambda r: r.any_greater(45), _SOME.format("x > 45")),
    "f8_all_greater": (lambda r: r.all_greater(10), _NONE.format("x > 10")),
    "f9_any_less": (lambda r: r.any_less(5), _SOME.format("x < 5")),
    "f10_all_less": (lambda r: r.all_less(30), _NONE.format("x < 30")),
    "f11_any_greater_equal": (lambda r: r.any_greater_equal(50), _SOME.format("x >= 50")),
    "f12_all_greater_equal": (lambda r: r.all_greater_equal(10), _NONE.format("x >= 10")),
    "f13_any_less_equal": (lambda r: r.any_less_equal(1), _SOME.format("x <= 1")),
    "f14_all_less_equal": (lambda r: r.all_less_equal(30), _NONE.format("x <= 30")),
}
for _name, (_set, _where) in _F.items():
    _add(_name, f"SELECT l_orderkey FROM {_ARRAYS} WHERE {_where}", _set_root(_set))

# H: scalar vocabulary

_add("h_functions", "SELECT event_id, regexp_extract(event_type || '.' || user_id, '(\\.[^.]*)$', 1) AS ext, CASE WHEN lower(event_type) < 'error' THEN -1 WHEN lower(event_type) > 'error' THEN 1 ELSE 0 END AS cmp, ts + INTERVAL 90 SECOND AS later, ts + INTERVAL 5 MILLISECOND AS soon, starts_with(event_type, 'c') AS c FROM events",
     lambda s, d: table(s, d, "events").select("event_id", fn.extension(F.concat("event_type", F.lit("."), "user_id")).alias("ext"), fn.compare("event_type", F.lit("ERROR"), ignore_case=True).alias("cmp"), fn.add_seconds("ts", 90).alias("later"), fn.add_milliseconds("ts", 5).alias("soon"), F.col("event_type").startswith("c").alias("c")))
_add("h_subquery_predicate", "SELECT c_custkey FROM customer WHERE c_acctbal = (SELECT max(c_acctbal) FROM customer)", lambda s, d: table(s, d, "customer").where(F.col("c_acctbal") == table(s, d, "customer").agg(F.max("c_acctbal")).scalar()).select("c_custkey"))

# 1.4, A7, A26-A30: the version algebra, over events


def _event_log(spark: SparkSession, d: str) -> DataFrame:
    op: Column = F.when(F.col("event_type") == "error", "D").otherwise("U")
    return table(spark, d, "events").select(F.col("user_id").alias("_id"), F.col("event_id").alias("_seq"), op.alias("_op"), F.col("ts").alias("_created_at"), F.octet_length("props").cast("long").alias("_length"), "value")


_LOG = "(SELECT user_id AS _id, event_id AS _seq, CASE WHEN event_type = 'error' THEN 'D' ELSE 'U' END AS _op, ts AS _created_at, CAST(strlen(props) AS BIGINT) AS _length, value FROM events)"
_VERSIONS = f"(SELECT _id, _seq, _created_at, _length, value, CASE WHEN nx IS NULL THEN 'Fresh' WHEN nx = 'D' THEN 'Deleted' ELSE 'Stale' END AS _state, ends AS _state_at FROM (SELECT *, lead(_op) OVER w AS nx, lead(_created_at) OVER w AS ends FROM {_LOG} WINDOW w AS (PARTITION BY _id ORDER BY _seq)) WHERE _op <> 'D')"
_AT = "2024-01-15 00:00:00"
_add("a7_fresh_scan", f"SELECT _id, _seq, value FROM {_VERSIONS} WHERE _state = 'Fresh'", lambda s, d: plan.fresh(_event_log(s, d)).select("_id", "_seq", "value"))
_add("a26_versions", f"SELECT _id, _seq, _created_at, _state, _state_at, value FROM {_VERSIONS}", lambda s, d: plan.versions(_event_log(s, d)).select("_id", "_seq", "_created_at", "_state", "_state_at", "value"))
_add("a27_as_of", f"SELECT _id, _seq, value FROM {_VERSIONS} WHERE _created_at <= TIMESTAMP '{_AT}' AND (_state = 'Fresh' OR _state_at > TIMESTAMP '{_AT}')", lambda s, d: plan.as_of(plan.versions(_event_log(s, d)), F.lit(_AT).cast("timestamp_ntz")).select("_id", "_seq", "value"))
_add("a30_statistics", f"SELECT _state, count(*) AS n, CAST(sum(_length) AS BIGINT) AS size, max(_length) AS most, min(_length) AS least, round(avg(_length), 6) AS mean FROM {_VERSIONS} GROUP BY 1",
     lambda s, d: plan.versions(_event_log(s, d)).groupBy("_state").agg(F.count("*").alias("n"), F.sum("_length").alias("size"), F.max("_length").alias("most"), F.min("_length").alias("least"), F.round(F.avg("_length"), 6).alias("mean")))

# A, B: datasets that are written, changed and maintained


def _dataset(run: Callable[[Dataset, Catalog, str], DataFrame], encrypt: bool = False, setup: Callable[[Config], object] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    """``run`` on a dataset with all customers in key order, under the shared folder."""

    def query(spark: SparkSession, d: str) -> DataFrame:
        root = shared_dir(spark)
        name = f"customers-{uuid.uuid4().hex}"
        catalog = Catalog(spark)
        config = catalog.configure(name, f"{root.rstrip('/')}/{name}").archive_to(f"{root.rstrip('/')}/{name}-archive").snapshots_to(f"{root.rstrip('/')}/{name}-copies").index("balance", "c_acctbal").index_identity()
        if encrypt:
            config.encrypt_with_password("a password of ours", "CBC")
        if setup:
            setup(config)
        config.register()
        with catalog.open(name) as ds:
            ds.insert(table(spark, d, "customer"), encrypt=encrypt, order=["c_custkey"])
            return run(ds, catalog, name)

    return query


_NUM = "(SELECT row_number() OVER (ORDER BY c_custkey) AS _id, * FROM customer)"
_COLS = "_id, c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment"


def _values(df: DataFrame) -> DataFrame:
    return df.select(*_COLS.split(", "))


def _changed(ds: Dataset) -> Dataset:
    ds.update("c_mktsegment = 'BUILDING'", c_acctbal=F.col("c_acctbal") + 1000)
    ds.delete("c_nationkey = 5")
    return ds


_AFTER = f"(SELECT _id, c_custkey, c_name, c_nationkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 1000 ELSE c_acctbal END AS c_acctbal, c_mktsegment FROM {_NUM} WHERE c_nationkey <> 5)"


def _defragged(ds: Dataset, catalog: Catalog, name: str) -> Catalog:
    _changed(ds).close()
    catalog.defrag(name)
    return catalog


def _reopened(catalog: Catalog, name: str) -> DataFrame:
    with catalog.open(name) as ds:
        return _values(ds.rows())


def _restored(ds: Dataset, catalog: Catalog, name: str) -> DataFrame:
    from datetime import datetime, timezone

    at = datetime.now(timezone.utc)
    _defragged(ds, catalog, name)
    out = f"{ds.config.path}-restored"
    catalog.restore(name, at, out)
    catalog.configure(f"{name}-restored", out).register()
    return _reopened(catalog, f"{name}-restored")


def _copied(ds: Dataset, catalog: Catalog, name: str) -> DataFrame:
    copy = catalog.snapshot_name(name, _changed(ds).snapshot())
    catalog.configure(copy, f"{ds.config.snapshot_path}/{copy}").register()
    return _reopened(catalog, copy)


_add("a10_b9_insert", f"SELECT {_COLS} FROM {_NUM}", _dataset(lambda ds, c, n: _values(ds.rows())))
_add("a20_encrypted_rows", f"SELECT {_COLS} FROM {_NUM}", _dataset(lambda ds, c, n: _values(ds.rows()), encrypt=True))
_add("a24_defrag", f"SELECT {_COLS} FROM {_AFTER}", _dataset(lambda ds, c, n: _reopened(_defragged(ds, c, n), n)))
_add("a25_a26_archive", f"SELECT _id, CASE WHEN c_nationkey = 5 AND c_mktsegment <> 'BUILDING' THEN 'Deleted' ELSE 'Stale' END AS _state, c_acctbal FROM {_NUM} WHERE c_nationkey = 5 OR c_mktsegment = 'BUILDING' UNION ALL SELECT _id, 'Deleted', c_acctbal + 1000 FROM {_NUM} WHERE c_nationkey = 5 AND c_mktsegment = 'BUILDING'", _dataset(lambda ds, c, n: _defragged(ds, c, n).read_archive(n).select("_id", "_state", "c_acctbal")))
_add("a27_restore", f"SELECT {_COLS} FROM {_NUM}", _dataset(_restored))
_add("a28_snapshot", f"SELECT {_COLS} FROM {_AFTER}", _dataset(_copied))
_add("a30_dataset_states", f"SELECT 'Fresh' AS _state, count(*) AS n FROM {_AFTER} UNION ALL SELECT 'Stale', count(*) FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'Deleted', count(*) FROM customer WHERE c_nationkey = 5", _dataset(lambda ds, c, n: _changed(ds).versions().groupBy("_state").agg(F.count("*").alias("n"))))
_add("b5_find_first", f"SELECT {_COLS} FROM {_NUM} WHERE c_nationkey = 5 ORDER BY _id LIMIT 1", _dataset(lambda ds, c, n: _values(ds.query().where("c_nationkey = 5").limit(1).to_df())))
_add("b7_find_all", f"SELECT {_COLS} FROM {_NUM} WHERE c_acctbal < 0", _dataset(lambda ds, c, n: _values(ds.find_all("c_acctbal < 0"))))
_add("b8_find_ids", f"SELECT {_COLS} FROM {_NUM} WHERE _id IN (30, 10, 20)", _dataset(lambda ds, c, n: _values(ds.find_ids(30, 10, 10, 20, 10**9))))
_add("b10_update", f"SELECT {_COLS} FROM (SELECT * REPLACE (CASE WHEN c_mktsegment = 'BUILDING' THEN c_acctbal + 1000 ELSE c_acctbal END AS c_acctbal) FROM {_NUM})", _dataset(lambda ds, c, n: (ds.update("c_mktsegment = 'BUILDING'", c_acctbal=F.col("c_acctbal") + 1000), _values(ds.rows()))[1]))
_add("b13_delete", f"SELECT {_COLS} FROM {_NUM} WHERE c_nationkey <> 5", _dataset(lambda ds, c, n: (ds.delete("c_nationkey = 5"), _values(ds.rows()))[1]))
_add("c13_query_update", f"SELECT _id, CASE WHEN _id IN (SELECT _id FROM {_NUM} ORDER BY c_acctbal DESC, _id LIMIT 50 OFFSET 10) THEN 'TOP' ELSE c_mktsegment END AS c_mktsegment FROM {_NUM}", _dataset(lambda ds, c, n: (ds.query().order_by(F.desc("c_acctbal")).skip(10).limit(50).update(c_mktsegment="TOP"), ds.rows().select("_id", "c_mktsegment"))[1]))
_add("c14_query_delete", f"SELECT _id FROM {_NUM} WHERE _id NOT IN (SELECT _id FROM {_NUM} ORDER BY c_acctbal DESC, _id LIMIT 50)", _dataset(lambda ds, c, n: (ds.query().order_by(F.desc("c_acctbal")).limit(50).delete(), ds.rows().select("_id"))[1]))
_add("d21_index_update_delete", f"SELECT _id, CASE WHEN c_acctbal > 9000 THEN 'RICH' ELSE c_mktsegment END AS c_mktsegment FROM {_NUM} WHERE c_acctbal >= 0", _dataset(lambda ds, c, n: (ds.via_index("balance").greater(9000).update(c_mktsegment="RICH"), ds.via_index("balance").less(0).delete(), ds.rows().select("_id", "c_mktsegment"))[2]))

# Scalar terminals: one row of what a call gave


def _row(ds: Dataset, **values: object) -> DataFrame:
    kinds = {bool: "boolean", int: "long", float: "double", str: "string", type(None): "string"}
    return ds.spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds[type(v)]}" for k, v in values.items()))


def _found(ds: Dataset, row: dict | None) -> DataFrame:
    return _values(ds.rows().where(F.lit(False))) if row is None else ds.spark.createDataFrame([tuple(row[c] for c in _COLS.split(", "))], _values(ds.rows()).schema)


def _then(f: Callable[[Dataset], object], of: Callable[[Dataset], DataFrame] = lambda ds: _values(ds.rows())) -> Callable[[Dataset, Catalog, str], DataFrame]:
    return lambda ds, c, n: (f(ds), of(ds))[1]


_add("b1_exists", "SELECT EXISTS (SELECT 1 FROM customer WHERE c_acctbal < 0) AS some, EXISTS (SELECT 1 FROM customer WHERE c_nationkey = 99) AS none", _dataset(lambda ds, c, n: _row(ds, some=ds.exists("c_acctbal < 0"), none=ds.exists("c_nationkey = 99"))))
_add("b2_exists_id", "SELECT true AS here, false AS gone, false AS never", _dataset(lambda ds, c, n: (ds.delete(20), _row(ds, here=ds.exists(10), gone=ds.exists(20), never=ds.exists(10**9)))[1]))
_add("b3_count", f"SELECT count(*) AS n FROM {_AFTER}", _dataset(lambda ds, c, n: _row(ds, n=_changed(ds).count())))
_add("b4_count_p", f"SELECT count(*) AS n FROM {_AFTER} WHERE c_acctbal > 5000", _dataset(lambda ds, c, n: _row(ds, n=_changed(ds).count("c_acctbal > 5000"))))
_add("b5_find", f"SELECT {_COLS} FROM {_NUM} WHERE c_nationkey = 7 ORDER BY _id LIMIT 1", _dataset(lambda ds, c, n: _found(ds, ds.find("c_nationkey = 7"))))
_add("b6_find_id", f"SELECT {_COLS} FROM {_NUM} WHERE _id = 17", _dataset(lambda ds, c, n: _found(ds, ds.find(17))))
_add("b8_find_ids_order", "SELECT CAST(a AS BIGINT) AS _id, CAST(b AS BIGINT) AS place FROM (VALUES (30, 0), (10, 1), (20, 2)) AS t(a, b)", _dataset(lambda ds, c, n: ds.spark.createDataFrame([(r["_id"], k) for k, r in enumerate(ds.find_ids(30, 10, 10, 20, 10**9).collect())], "_id long, place long")))
_add("b11_update_id", f"SELECT {_COLS} FROM (SELECT * REPLACE (CASE WHEN _id = 11 THEN 'ONE' ELSE c_mktsegment END AS c_mktsegment) FROM {_NUM})", _dataset(_then(lambda ds: ds.update(11, c_mktsegment="ONE"))))
_add("b14_delete_id", f"SELECT {_COLS} FROM {_NUM} WHERE _id <> 11", _dataset(_then(lambda ds: ds.delete(11))))
_add("a1_memory_dataset", f"SELECT {_COLS} FROM {_NUM}", lambda s, d: _in_memory(s, d))
_add("a3_a4_registry", "SELECT true AS known, true AS any_case, true AS twice_fails, true AS open_stays, true AS removed", _dataset(lambda ds, c, n: _registry(ds, c, n)))
_add("a6_lock", "SELECT true AS refused", _dataset(lambda ds, c, n: _row(ds, refused=_fails(lambda: Catalog(ds.spark).configure("other", ds.config.path).register()._catalog.open("other")))))
_add("a12_flush", "SELECT count(*) + 2 AS n, count(*) + 2 AS written FROM customer", _dataset(lambda ds, c, n: (ds.insert([{"c_name": "x"}, {"c_name": "y"}]), ds.flush(), _row(ds, n=ds.count(), written=ds._log.meta.rows))[2]))
_add("a16_converters", f"SELECT _id, lower(c_name) AS c_name FROM {_NUM}", _dataset(lambda ds, c, n: ds.rows().select("_id", "c_name"), setup=lambda config: config.convert("c_name", "lower(c_name)")))
_add("a17_codec", f"SELECT {_COLS} FROM {_NUM}", _dataset(lambda ds, c, n: _values(ds.rows()), encrypt=True, setup=lambda config: config.serialize_with(lambda v: F.to_csv(v).cast("binary"), lambda b, kind: F.from_csv(b.cast("string"), kind.simpleString()[7:-1].replace(":", " ")))))
_add("a20_gcm_rows", f"SELECT {_COLS} FROM {_NUM}", lambda s, d: _gcm(s, d))
_add("a20_encrypted_sizes", "SELECT true AS larger, count(*) AS n FROM customer", _dataset(lambda ds, c, n: _sizes(ds), encrypt=True))
_add("a21_read_only", f"SELECT {_COLS} FROM {_NUM}", _dataset(lambda ds, c, n: _mode(ds, c, Mode.READ_ONLY, lambda x: _values(x.rows()))))
_add("a22_append_only", "SELECT count(*) + 1 AS n, true AS guarded FROM customer", _dataset(lambda ds, c, n: _mode(ds, c, Mode.APPEND_ONLY, lambda x: (x.insert({"c_name": "new"}), _row(x, n=x.count(), guarded=_fails(x.rows)))[1])))
_add("a23_purge", "SELECT (SELECT count(*) FROM customer WHERE c_mktsegment = 'BUILDING') AS stale, (SELECT count(*) FROM customer WHERE c_nationkey = 5) AS deleted, CAST(0 AS BIGINT) AS again", _dataset(lambda ds, c, n: _purged(_changed(ds))))
_add("a30_statistics_flags", f"""
    WITH v AS (
      SELECT 'Fresh' AS s, length(c_name) AS z FROM {_AFTER} UNION ALL
      SELECT CASE WHEN c_nationkey = 5 AND c_mktsegment <> 'BUILDING' THEN 'Deleted' ELSE 'Stale' END, length(c_name) FROM customer WHERE c_nationkey = 5 OR c_mktsegment = 'BUILDING' UNION ALL
      SELECT 'Deleted', length(c_name) FROM customer WHERE c_nationkey = 5 AND c_mktsegment = 'BUILDING')
    SELECT what || s || CASE WHEN what = '' THEN 'Count' ELSE 'Size' END AS name, value FROM (
      SELECT s, '' AS what, CAST(count(*) AS DOUBLE) AS value FROM v GROUP BY s UNION ALL SELECT s, 'Max', max(z) FROM v GROUP BY s UNION ALL SELECT s, 'Min', min(z) FROM v GROUP BY s UNION ALL SELECT s, 'Avg', round(avg(z), 6) FROM v GROUP BY s)
    UNION ALL SELECT s || 'Size', sum(z) FROM v GROUP BY s UNION ALL SELECT 'LastId', count(*) FROM customer""", _dataset(lambda ds, c, n: _flags(_changed(ds)), setup=lambda config: config.sized_by("length(c_name)")))
_add("a31_room", "SELECT true AS refused", _dataset(lambda ds, c, n: _row(ds, refused=_without_room(ds))))
_add("e1_identity", f"SELECT {_COLS} FROM {_NUM} WHERE _id BETWEEN 5 AND 9", _dataset(lambda ds, c, n: _values(ds.find_ids(9, 7, 5, 6, 8))))
_add("e4_set_index", f"SELECT _id FROM {_NUM} WHERE c_nationkey = 5 OR c_nationkey % 7 = 3", _dataset(lambda ds, c, n: ds.via_set_index("marks").any_in(3, 105).select("_id", ordered=False), setup=lambda config: config.set_index("marks", F.array(F.col("c_nationkey") % 7, F.col("c_nationkey") + 100))))
_add("e8_indexes", f"SELECT _id FROM {_NUM} WHERE c_acctbal > 5000 AND length(c_name) > 5", _dataset(lambda ds, c, n: ds.via_index("balance").greater(5000).select("_id", ordered=False).intersect(ds.via_index("size").greater(5).select("_id", ordered=False)), setup=lambda config: config.index("size", "length(c_name)")))
_add("h_ternary_update", f"SELECT _id, CASE WHEN c_nationkey = 3 THEN CASE WHEN c_acctbal < 0 THEN 'LOW' ELSE 'HIGH' END ELSE c_mktsegment END AS c_mktsegment FROM {_NUM}", _dataset(_then(lambda ds: ds.update("c_nationkey = 3", c_mktsegment=F.when(F.col("c_acctbal") < 0, "LOW").otherwise("HIGH")), lambda ds: ds.rows().select("_id", "c_mktsegment"))))
_add("h_stateful_update", f"SELECT _id, CASE WHEN _id <= 100 THEN CAST(_id - 1 AS DOUBLE) ELSE c_acctbal END AS c_acctbal FROM {_NUM}", _dataset(_then(lambda ds: ds.query().limit(100).update(c_acctbal=fn.ordinal("_seq")), lambda ds: ds.rows().select("_id", "c_acctbal"))))
_add("i_id_callback", f"SELECT _id, c_custkey FROM (SELECT count(*) + 1 AS _id, count(*) + 1 AS c_custkey FROM customer UNION ALL SELECT count(*) + 2, count(*) + 2 FROM customer)", _dataset(_then(lambda ds: ds.insert([{"c_name": "x"}, {"c_name": "y"}], on_id=lambda i: {"c_custkey": i}), lambda ds: ds.rows().where("c_name IN ('x', 'y')").select("_id", "c_custkey"))))
_add("n_natural_order_after_update", f"SELECT _id, row_number() OVER (ORDER BY CASE WHEN c_nationkey = 5 THEN 1 ELSE 0 END, _id) - 1 AS place FROM {_NUM} WHERE c_nationkey IN (5, 6)", _dataset(_then(lambda ds: ds.update("c_nationkey = 5", c_mktsegment="LAST"), lambda ds: ds.rows().where("c_nationkey IN (5, 6)").select("_id", fn.ordinal("_seq").cast("long").alias("place")))))
_add("j_stream_sink", "SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys FROM orders", lambda s, d: _streamed(s, d))
_add("j_changes", f"SELECT _id, 'U' AS _op FROM {_NUM} WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT _id, 'D' FROM {_NUM} WHERE c_nationkey = 5", _dataset(lambda ds, c, n: _since(ds)))


def _fails(f: Callable[[], object]) -> bool:
    try:
        f()
    except DatasetError:
        return True
    return False


def _in_memory(spark: SparkSession, d: str) -> DataFrame:
    catalog = Catalog(spark)
    catalog.configure("memory").register()
    ds = catalog.open("memory")  # its rows go when it is closed
    ds.insert(table(spark, d, "customer"), order=["c_custkey"])
    return _values(ds.rows())


def _gcm(spark: SparkSession, d: str) -> DataFrame:
    name = f"sealed-{uuid.uuid4().hex}"
    catalog = Catalog(spark)
    catalog.configure(name, f"{shared_dir(spark)}/{name}").encrypt_with_key(b"0123456789abcdef" * 2).register()
    with catalog.open(name) as ds:
        ds.insert(table(spark, d, "customer"), encrypt=True, order=["c_custkey"])
        return _values(ds.rows())


def _sizes(ds: Dataset) -> DataFrame:
    """CBC: a vector of 16 bytes and whole blocks."""
    log = ds._log.read()
    fits = (F.octet_length("_payload") == F.col("_length")) & (F.col("_length") % 16 == 0)
    return log.agg(F.bool_and(fits).alias("larger"), F.count("*").alias("n"))


def _registry(ds: Dataset, catalog: Catalog, name: str) -> DataFrame:
    catalog.configure("spare").register()
    return _row(ds, known=name in catalog, any_case=name.upper() in catalog, twice_fails=_fails(lambda: catalog.configure(name.upper()).register()), open_stays=_fails(lambda: catalog.remove(name)), removed=catalog.remove("SPARE") and "spare" not in catalog)


def _mode(ds: Dataset, catalog: Catalog, mode: Mode, run: Callable[[Dataset], DataFrame]) -> DataFrame:
    ds.close()
    other = Catalog(ds.spark)
    other.configure("again", ds.config.path).set_mode(mode).register()
    with other.open("again") as again:
        return run(again)


def _purged(ds: Dataset) -> DataFrame:
    (stale, deleted), again = ds.purge(), ds.purge()
    return _row(ds, stale=stale, deleted=deleted, again=sum(again))


def _flags(ds: Dataset) -> DataFrame:
    return ds.spark.createDataFrame([(k, round(float(v), 6)) for k, v in ds.statistics().items() if v is not None], "name string, value double")


def _without_room(ds: Dataset) -> bool:
    ds._files.room = lambda uri: 0  # type: ignore[method-assign]
    return _fails(ds.snapshot)


def _streamed(spark: SparkSession, d: str) -> DataFrame:
    from .streaming import insert_stream

    name = f"feed-{uuid.uuid4().hex}"
    rows = table(spark, d, "orders")
    catalog = Catalog(spark)
    catalog.configure(name, f"{shared_dir(spark)}/{name}", rows.schema).register()
    with catalog.open(name) as ds:
        for _ in range(2):  # the second run finds nothing new
            source = spark.readStream.schema(rows.schema).option("pathGlobFilter", "orders.parquet").parquet(d)
            insert_stream(ds, source, "orders", f"{shared_dir(spark)}/{name}-checkpoint").awaitTermination()
        return ds.rows().agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("keys"))


def _since(ds: Dataset) -> DataFrame:
    from .streaming import changes

    _, at = changes(ds)
    return changes(_changed(ds), at)[0].select("_id", "_op")
