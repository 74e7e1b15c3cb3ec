"""Every registered query of the library, with the SQL that must give the same rows.

Most are statements of the dialect over attached tables; ``ORACLES`` has the same in standard SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from brindle.engine import Engine
from brindle.functions.collation import LETTERS
from brindle.functions.text import tokens
from brindle.functions.vectors import distance, quantize
from brindle.operators import dml, search
from brindle.storage import cut

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "labels", "benchmark", "conversations", "pages")


def engine(spark: SparkSession, sf_dir: str, *names: str, **kw) -> Engine:
    return Engine(spark, **kw).attach_parquet(sf_dir, *names)


def _tables(sql: str) -> list[str]:
    words = sql.replace("\n", " ").split(" ")
    return list(dict.fromkeys(w for w in words if w in TABLES))


def dialect(name: str, sql: str, oracle: str | None = None, digits: dict[str, int] | None = None, params=None, **kw) -> None:
    """Register a statement; without its own SQL the oracle runs the same text."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = engine(spark, sf_dir, *_tables(sql), **kw).sql(sql, params)
        for column, n in (digits or {}).items():
            df = df.withColumn(column, F.round(column, n))
        return df

    QUERIES[name] = run
    ORACLES[name] = oracle or sql


def query(name: str, oracle: str | None = None):
    """Register a function of (spark, sf_dir)."""

    def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[name] = fn
        if oracle:
            ORACLES[name] = oracle
        return fn

    return register


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


FLAGSHIP = (
    "SELECT n.n_name, count(*) AS n, sum(o.o_totalprice) AS total FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey "
    "JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE o.o_orderdate >= '1997-01-01' GROUP BY n.n_name HAVING count(*) > 10 ORDER BY total DESC LIMIT 10"
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by the value of their orders, from text to top ten."""
    return QUERIES["flagship"](spark, sf_dir)


dialect("flagship", FLAGSHIP, FLAGSHIP.replace("sum(o.o_totalprice)", "round(sum(o.o_totalprice), 2)"), {"total": 2})

# scans
dialect("scan_full", "SELECT * FROM orders")
dialect("point_lookup", "SELECT * FROM customer WHERE c_custkey = 42", "SELECT * REPLACE (CAST(c_nationkey AS BIGINT) AS c_nationkey) FROM customer WHERE c_custkey = 42")
dialect("index_eq", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7")
dialect("scan_eq_unindexed", "SELECT p_partkey, p_name FROM part WHERE p_size = 15")
dialect("eq_null_empty", "SELECT o_orderkey FROM orders WHERE o_custkey = NULL")
dialect("cursor_scan", "SELECT event_id, event_type, value FROM events WHERE event_type = 'click'")


@query("bulk_order_check", "SELECT count(*) AS violations FROM (SELECT o_totalprice < lag(o_totalprice) OVER (ORDER BY o_orderkey) OR o_totalprice = lag(o_totalprice) OVER (ORDER BY o_orderkey) AS bad FROM orders) WHERE bad")
def bulk_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places where a bulk load sorted by key would break the order of another column."""
    return dml.order_breaks(_read(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice").agg(F.count(F.lit(1)).alias("violations"))


# projection
dialect("select_star", "SELECT * FROM part", "SELECT * REPLACE (CAST(p_size AS BIGINT) AS p_size) FROM part")
dialect(
    "select_star_join", "SELECT * FROM nation n JOIN region r ON r.r_regionkey = n.n_regionkey",
    'SELECT CAST(n_nationkey AS BIGINT) AS "n.n_nationkey", n_name AS "n.n_name", CAST(n_regionkey AS BIGINT) AS "n.n_regionkey", CAST(r_regionkey AS BIGINT) AS "r.r_regionkey", r_name AS "r.r_name" FROM nation JOIN region ON r_regionkey = n_regionkey',
)
dialect("project_cols", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
dialect("project_alias", "SELECT c_name AS name, c_acctbal AS balance FROM customer")

# filters
dialect("filter_cmp", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 100000.0 AND o_orderstatus != 'F'")
dialect("filter_and_or_not", "SELECT c_custkey FROM customer WHERE NOT (c_mktsegment = 'BUILDING' OR c_acctbal < 0) AND (c_nationkey > 10 OR c_nationkey = 3)")
dialect("filter_is_null", "SELECT c.c_custkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey WHERE o.o_orderkey IS NULL")
dialect("filter_in", "SELECT p_partkey FROM part WHERE p_size IN (1, 7, 49)")
dialect("filter_not_in_null", "SELECT p_partkey FROM part WHERE p_size NOT IN (1, NULL)")
dialect("filter_date_range", "SELECT o_orderkey FROM orders WHERE o_orderdate >= '1997-01-01' AND o_orderdate < '1998-01-01 12:00:00'")
dialect("filter_int_vs_float", "SELECT p_partkey, p_size FROM part WHERE p_size > 24.5", "SELECT p_partkey, CAST(p_size AS BIGINT) AS p_size FROM part WHERE p_size > 24.5")
dialect("filter_col_vs_col", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey = l_linenumber", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber FROM lineitem WHERE l_suppkey = l_linenumber")
dialect("param_filter", "SELECT o_orderkey FROM orders WHERE o_orderstatus = %(s)s AND o_totalprice > %(p)s", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' AND o_totalprice > 200000", params={"s": "O", "p": 200000})


@query("filter_json_eq", "SELECT event_id FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) = 69 AND len(json_keys(props)) = 1")
def filter_json_eq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equality of JSON values, whatever their spelling."""
    e = Engine(spark)
    e.attach("events", _read(spark, sf_dir, "events"), ["props"])
    return e.sql("SELECT event_id FROM events WHERE props = '{ \"k\" : 69 }'")


# joins
dialect("join_inner", "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey")
dialect("join_left", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey")
dialect("join_right", "SELECT o.o_orderkey, c.c_custkey FROM orders o RIGHT JOIN customer c ON c.c_custkey = o.o_custkey")
dialect(
    "join_chain3", "SELECT c.c_custkey, n.n_name, r.r_name FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey"
)
dialect(
    "join_chain5",
    "SELECT l.l_orderkey, l.l_partkey, s.s_name, n.n_name, c.c_name FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey "
    "JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey",
)
dialect("join_self", "SELECT a.n_name AS a_name, b.n_name AS b_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")
dialect("join_theta_residual", "SELECT c.c_custkey, s.s_suppkey FROM customer c JOIN supplier s ON s.s_nationkey = c.c_nationkey WHERE c.c_acctbal > s.s_acctbal")
dialect("join_skew_count", "SELECT count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey")
dialect(
    "join_null_keys",
    "SELECT count(*) AS n, count(l.doc_id) AS labelled, count(e.vec_id) AS embedded FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id LEFT JOIN embeddings e ON e.vec_id = l.doc_id",
)
dialect("join_left_where", "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 200000")
dialect(
    "join_left_prefilter",
    "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey WHERE o.o_totalprice > 200000",
    "SELECT c.c_custkey, o.o_orderkey FROM customer c LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) o ON o.o_custkey = c.c_custkey",
    compat_outer_pushdown=True,
)

# aggregates
dialect("agg_count_star", "SELECT count(*) AS n FROM lineitem")
dialect("agg_count_col", "SELECT count(l.doc_id) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
dialect("agg_count_distinct", "SELECT count(DISTINCT l_partkey) AS n FROM lineitem")
dialect("agg_count_distinct_grouped", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS n FROM lineitem GROUP BY l_returnflag")
dialect("agg_sum_int", "SELECT l_returnflag, sum(l_partkey) AS total FROM lineitem GROUP BY l_returnflag", "SELECT l_returnflag, CAST(sum(l_partkey) AS BIGINT) AS total FROM lineitem GROUP BY l_returnflag")
dialect("agg_sum_float", "SELECT sum(l_extendedprice) AS total FROM lineitem", "SELECT round(sum(l_extendedprice), 2) AS total FROM lineitem", {"total": 2})
dialect("agg_avg", "SELECT l_linestatus, avg(l_quantity) AS mean FROM lineitem GROUP BY l_linestatus", "SELECT l_linestatus, round(avg(l_quantity), 6) AS mean FROM lineitem GROUP BY l_linestatus", {"mean": 6})
dialect("agg_min", "SELECT min(o_orderdate) AS first, min(o_orderpriority) AS least FROM orders")
dialect("agg_max", "SELECT max(o_totalprice) AS most, max(o_orderdate) AS last FROM orders")
dialect("agg_global_empty", "SELECT count(*) AS n, sum(o_totalprice) AS total, max(o_orderkey) AS last FROM orders WHERE o_totalprice < 0")
dialect("group_by_one", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
dialect("group_by_multi", "SELECT l_returnflag, l_linestatus, count(*) AS n, max(l_shipdate) AS last FROM lineitem GROUP BY l_returnflag, l_linestatus")
dialect("group_by_null", "SELECT l.toxic, count(*) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY l.toxic", "SELECT CAST(l.toxic AS BIGINT) AS toxic, count(*) AS n FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id GROUP BY l.toxic")
dialect("having_agg", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
dialect("having_hidden_agg", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING max(o_totalprice) > 400000 AND count(*) > 3")
dialect("having_global", "SELECT count(*) AS n FROM orders HAVING count(*) > 10")
dialect("group_by_distinct", "SELECT p_brand, p_type FROM part GROUP BY p_brand, p_type")
dialect(
    "agg_over_join",
    "SELECT r.r_name, count(*) AS n, sum(c.c_acctbal) AS total FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY r.r_name",
    "SELECT r.r_name, count(*) AS n, round(sum(c.c_acctbal), 2) AS total FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey GROUP BY r.r_name",
    {"total": 2},
)
dialect("group_order_alias", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY o_orderpriority ORDER BY n DESC")
dialect("group_limit_offset", "SELECT o_custkey, count(*) AS n, max(o_orderkey) AS last FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10 OFFSET 5")

# order
dialect("order_multi", "SELECT c_mktsegment, c_acctbal, c_custkey FROM customer ORDER BY c_mktsegment COLLATE binary, c_acctbal DESC, c_custkey", "SELECT c_mktsegment, c_acctbal, c_custkey FROM customer ORDER BY c_mktsegment, c_acctbal DESC, c_custkey")
dialect("order_nulls", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id ORDER BY l.quality DESC, d.doc_id LIMIT 500", "SELECT d.doc_id, CAST(l.quality AS BIGINT) AS quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id ORDER BY l.quality DESC NULLS LAST, d.doc_id LIMIT 500")
_FOLD = "ABCDEFGHIJKLMNOPQRSTUVWXYZÑ" + "".join(LETTERS)
_BASE = "abcdefghijklmnopqrstuvwxyzñ" + "".join(base for base, _ in LETTERS.values())
_RANKS = "".join(chr(1 + rank) for _, rank in LETTERS.values())
dialect(
    "order_collate_unicode", "SELECT doc_id FROM documents ORDER BY text, doc_id LIMIT 200",
    f"SELECT doc_id FROM documents ORDER BY replace(translate(text, '{_FOLD}', '{_BASE}'), 'ñ', 'n' || chr(1114111)), "
    f"translate(regexp_replace(text, '[^{''.join(LETTERS)}]', chr(1), 'g'), '{''.join(LETTERS)}', '{_RANKS}'), "
    "regexp_replace(regexp_replace(text, '[^\\p{Lu}]', '0', 'g'), '\\p{Lu}', '1', 'g'), doc_id LIMIT 200",
)
dialect("order_collate_binary", "SELECT doc_id FROM documents ORDER BY text COLLATE binary DESC, doc_id LIMIT 200", "SELECT doc_id FROM documents ORDER BY text DESC, doc_id LIMIT 200")
dialect("order_unprojected", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")


def _places(name: str, sql: str, oracle: str) -> None:
    """Register an ORDER BY over a whole table as rows with their ``place`` from 1 on, so that the order itself is compared.

    Each sorted partition is numbered by itself and starts where the ones before it end.
    """

    @query(name, oracle)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ordered = engine(spark, sf_dir, *_tables(sql)).sql(sql)
        rows, _ = cut(ordered.withColumn("_p", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
        sizes = rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
        before = sizes.select("_p", (F.sum("_n").over(W.orderBy("_p")) - F.col("_n")).alias("_before"))
        return rows.join(F.broadcast(before), "_p").select(*ordered.columns, (F.col("_before") + F.col("_at") + 1).alias("place"))


_places(
    "order_nulls_place", "SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id ORDER BY l.quality DESC, d.doc_id",
    "SELECT d.doc_id, CAST(l.quality AS BIGINT) AS quality, row_number() OVER (ORDER BY l.quality DESC NULLS LAST, d.doc_id) AS place FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id",
)
_places(
    "order_collate_unicode_place", "SELECT doc_id FROM documents ORDER BY text, doc_id",
    f"SELECT doc_id, row_number() OVER (ORDER BY replace(translate(text, '{_FOLD}', '{_BASE}'), 'ñ', 'n' || chr(1114111)) NULLS FIRST, "
    f"translate(regexp_replace(text, '[^{''.join(LETTERS)}]', chr(1), 'g'), '{''.join(LETTERS)}', '{_RANKS}'), "
    "regexp_replace(regexp_replace(text, '[^\\p{Lu}]', '0', 'g'), '\\p{Lu}', '1', 'g'), doc_id) AS place FROM documents",
)
_places("order_collate_binary_place", "SELECT doc_id FROM documents ORDER BY text COLLATE binary DESC, doc_id", "SELECT doc_id, row_number() OVER (ORDER BY text DESC NULLS LAST, doc_id) AS place FROM documents")
_places("order_unprojected_place", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey", "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC NULLS LAST, o_orderkey) AS place FROM orders")

dialect("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
dialect("limit_zero", "SELECT o_orderkey FROM orders LIMIT 0")
dialect("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 20 OFFSET 100")


@query("limit_only", "SELECT count(*) AS n FROM (SELECT o_orderkey FROM orders LIMIT 37)")
def limit_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return engine(spark, sf_dir, "orders").sql("SELECT o_orderkey FROM orders LIMIT 37").agg(F.count(F.lit(1)).alias("n"))


# functions
@query("cast_date", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def cast_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))


@query("format_timestamp", "SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS at FROM events")
def format_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))


_TOKENS = r"list_transform(list_filter(string_split_regex(text, '[^\p{L}\p{N}]+'), lambda x: strlen(x) >= 2 AND strlen(x) <= 64), lambda x: lower(x))"


@query("text_tokenize", f"SELECT doc_id, CAST(len({_TOKENS}) AS INTEGER) AS n, md5(array_to_string({_TOKENS}, ' ')) AS digest FROM documents")
def text_tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _read(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").alias("n"), F.md5(F.array_join("t", " ").cast("binary")).alias("digest"))


@query("text_postings", f"WITH t AS (SELECT doc_id, {_TOKENS} AS ts FROM documents) SELECT term, doc_id AS id, CAST(count(*) AS INTEGER) AS tf, CAST(any_value(dl) AS INTEGER) AS dl FROM (SELECT doc_id, unnest(ts) AS term, len(ts) AS dl FROM t) GROUP BY term, doc_id")
def text_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.postings(_read(spark, sf_dir, "documents"), "doc_id", "text")


def _distance(name: str, metric: str, sql: str) -> None:
    @query(f"vec_dist_{name}", f"SELECT a.vec_id, round({sql}, 4) AS distance FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = _read(spark, sf_dir, "embeddings")
        one = e.where("vec_id = 0").select(F.col("embedding").alias("other"))
        return e.crossJoin(F.broadcast(one)).select("vec_id", F.round(distance(F.col("embedding"), F.col("other"), metric), 4).alias("distance"))


_VECTORS = {"cosine": "list_cosine_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])", "dot": "1 - list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])", "l2": "list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"}
for _name, _sql in _VECTORS.items():
    _distance(_name, _name, _sql)


@query(
    "vec_quantize",
    "SELECT vec_id, round(scale, 9) AS scale, array_to_string(list_transform(v, lambda x: CAST(greatest(-127, least(127, round(x / scale))) AS INTEGER)), ',') AS q "
    "FROM (SELECT vec_id, embedding::DOUBLE[] AS v, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) / 127 AS scale FROM embeddings)",
)
def vec_quantize(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = _read(spark, sf_dir, "embeddings").select("vec_id", quantize(F.col("embedding")).alias("z"))
    return x.select("vec_id", F.round("z.scale", 9).alias("scale"), F.array_join(F.transform("z.q", lambda v: v.cast("string")), ",").alias("q"))


@query("check_varchar", "SELECT c_custkey FROM customer WHERE length(c_mktsegment) > 9 OR c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
def check_varchar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that varchar(9) and an enum of two values would refuse."""
    c = _read(spark, sf_dir, "customer")
    return c.where((F.char_length("c_mktsegment") > 9) | ~F.col("c_mktsegment").isin("BUILDING", "MACHINERY")).select("c_custkey")


# row changes
@query("dml_insert_union", "SELECT r_regionkey, r_name FROM region UNION ALL SELECT n_nationkey + 100, n_name FROM nation")
def dml_insert_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = _read(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).alias("r_regionkey"), F.col("n_name").alias("r_name"))
    return _read(spark, sf_dir, "region").unionByName(new)


@query("dml_insert_ignore", "SELECT min(s_suppkey) AS k, s_nationkey FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3) GROUP BY s_nationkey")
def dml_insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which suppliers an INSERT IGNORE keyed by nation would take, where the nations of three regions are there already."""
    have = _read(spark, sf_dir, "nation").where("n_regionkey < 3").select(F.col("n_nationkey").alias("s_nationkey"))
    new = _read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), "s_nationkey")
    return dml.insert_ignore(have, new, "s_nationkey", "k")


@query("identity_assign", "SELECT c_custkey, 1000 + row_number() OVER (ORDER BY c_name) AS n FROM customer")
def identity_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal names, whose order the SQL leaves open, are numbered by key."""
    order = [F.col("c_name").asc_nulls_last(), F.col("c_custkey")]
    return dml.assign_identity(_read(spark, sf_dir, "customer").select("c_custkey", "c_name"), 1000, order, "n").select("c_custkey", "n")


@query("update_literal", "SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders")
def update_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = _read(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return dml.update_rows(o, F.col("o_totalprice") > 300000, {"o_orderstatus": F.lit("X")}).drop("o_totalprice")


@query("update_arith", "SELECT p_partkey, CASE WHEN p_brand = 'Brand#11' THEN CAST(trunc(p_size / 4) AS BIGINT) ELSE CAST(p_size AS BIGINT) END AS p_size, CASE WHEN p_brand = 'Brand#11' THEN p_retailprice * 2.0 ELSE p_retailprice END AS p_retailprice FROM part")
def update_arith(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _read(spark, sf_dir, "part").select("p_partkey", F.col("p_size").cast("bigint").alias("p_size"), "p_retailprice", "p_brand")
    values = {"p_size": dml.arithmetic(F.col("p_size"), "/", 4, True), "p_retailprice": dml.arithmetic(F.col("p_retailprice"), "*", 2.0, False)}
    return dml.update_rows(p, F.col("p_brand") == "Brand#11", values).drop("p_brand")


@query("delete_where", "SELECT d.doc_id, CAST(l.toxic AS INTEGER) AS toxic FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE NOT coalesce(l.toxic = 0, false)")
def delete_where(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left after a DELETE: also the rows for which the condition is unknown."""
    labels = _read(spark, sf_dir, "labels").select("doc_id", "toxic")
    return dml.delete_rows(_read(spark, sf_dir, "documents").select("doc_id").join(labels, "doc_id", "left"), F.col("toxic") == 0)


@query("check_not_null", "SELECT count(*) AS n, count(*) FILTER (l.quality IS NULL) AS violations FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def check_not_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = _read(spark, sf_dir, "documents").select("doc_id").join(_read(spark, sf_dir, "labels"), "doc_id", "left")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality").isNull()).alias("violations"))


@query("unique_violations", "SELECT p_name, count(*) AS n FROM part GROUP BY p_name HAVING count(*) > 1")
def unique_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.unique_violations(_read(spark, sf_dir, "part"), "p_name")


@query("fk_orphans", "SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def fk_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dml.orphans(_read(spark, sf_dir, "documents").select("doc_id"), "doc_id", _read(spark, sf_dir, "labels"), "doc_id")


@query("fk_cascade_targets", "SELECT o_orderkey FROM orders WHERE EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')")
def fk_cascade_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    doomed = _read(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    return dml.referencing(_read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), "o_custkey", doomed, "c_custkey").select("o_orderkey")


# search
_WORDS = "license version thing with"
_BM25 = f"""
WITH t AS (SELECT doc_id, lang, {_TOKENS} AS ts FROM documents), live AS (SELECT * FROM t WHERE len(ts) > 0),
s AS (SELECT count(*)::DOUBLE AS n, avg(len(ts)) AS avgdl FROM live),
q AS (SELECT unnest(['license', 'version', 'thing', 'with']) AS term),
tf AS (SELECT doc_id, lang, term, len(ts)::DOUBLE AS dl, len(list_filter(ts, lambda x: x = term))::DOUBLE AS tf FROM live, q),
df AS (SELECT term, count(*)::DOUBLE AS df FROM tf WHERE tf > 0 GROUP BY term),
scored AS (SELECT doc_id AS id, any_value(lang) AS lang, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM tf JOIN df USING (term), s WHERE tf > 0 GROUP BY doc_id)
"""


@query("search_text", _BM25 + "SELECT id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, id LIMIT 20")
def search_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = search.search_text(_read(spark, sf_dir, "documents"), "doc_id", "text", _WORDS, 20)
    return top.select("id", F.round("score", 6).alias("score"))


@query("search_text_filter", _BM25 + "SELECT id, round(score, 6) AS score FROM scored WHERE lang = 'de' ORDER BY scored.score DESC, id LIMIT 20")
def search_text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = search.search_text(_read(spark, sf_dir, "documents"), "doc_id", "text", _WORDS, 20, F.col("lang") == "de")
    return top.select("id", F.round("score", 6).alias("score"))


def _first_vector(e: DataFrame) -> list[float]:
    return list(e.where("vec_id = 0").first()["embedding"])


def _nearest(name: str, metric: str, keep: str | None = None) -> None:
    where = f"WHERE a.{keep}" if keep else ""

    @query(f"knn_{name}", f"SELECT a.vec_id AS id, round({_VECTORS[metric]}, 4) AS distance FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b {where} ORDER BY {_VECTORS[metric]}, a.vec_id LIMIT 10")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = _read(spark, sf_dir, "embeddings")
        top = search.nearest(e, "vec_id", "embedding", _first_vector(e), 10, metric, F.expr(keep) if keep else None)
        return top.select("id", F.round("distance", 4).alias("distance"))


_nearest("cosine", "cosine")
_nearest("dot", "dot")
_nearest("l2", "l2")
_nearest("filter", "cosine", "label = 3")


_BYTES = "(SELECT vec_id, label, CASE WHEN s = 0 THEN list_transform(v, lambda x: 0.0::DOUBLE) ELSE list_transform(v, lambda x: greatest(-127, least(127, round(x / s))) * s) END AS embedding FROM (SELECT vec_id, label, embedding::DOUBLE[] AS v, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) / 127 AS s FROM embeddings))"


@query("knn_quantized", f"SELECT a.vec_id AS id, round({_VECTORS['cosine']}, 4) AS distance FROM {_BYTES} a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b ORDER BY {_VECTORS['cosine']}, a.vec_id LIMIT 10")
def knn_quantized(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _read(spark, sf_dir, "embeddings")
    return search.nearest_quantized(e, "vec_id", "embedding", _first_vector(e), 10).select("id", F.round("distance", 4).alias("distance"))


_HYBRID = _BM25.rstrip() + """,
j AS (SELECT d.doc_id FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id),
x AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM scored ORDER BY score DESC, id LIMIT 50),
y AS (SELECT a.vec_id AS id, row_number() OVER (ORDER BY {d}, a.vec_id) - 1 AS rank FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b WHERE a.vec_id IN (SELECT doc_id FROM documents) ORDER BY rank LIMIT 50)
SELECT id, round(sum(1.0::DOUBLE / (61 + rank)), 9) AS score FROM (SELECT * FROM x UNION ALL SELECT * FROM y) GROUP BY id ORDER BY sum(1.0::DOUBLE / (61 + rank)) DESC, id LIMIT 10
""".format(d=_VECTORS["cosine"])


@query("search_hybrid", _HYBRID)
def search_hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text over all documents fused with vectors of those that have one."""
    e = _read(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    both = _read(spark, sf_dir, "documents").join(e, F.col("vec_id") == F.col("doc_id"), "left")
    top = search.search_hybrid(both, "doc_id", 10, ("text", _WORDS), ("embedding", _first_vector(e), "cosine"))
    return top.select("id", F.round("score", 9).alias("score"))


def _all_nearest_sql(metric: str, source: str = "embeddings", keep: str = "true") -> str:
    """The ten nearest others of every vector whose id is divisible by 50, of all vectors of ``source``."""
    pairs = f"SELECT b.vec_id AS query_id, a.vec_id AS id, {_VECTORS[metric]} AS d FROM {source} a, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) b WHERE a.vec_id <> b.vec_id AND a.{keep}".replace("a.true", "true")
    return f"SELECT query_id, id, d, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, id) AS rank FROM ({pairs})) WHERE rank <= 10"


def _every(name: str, metric: str, keep: str | None = None) -> None:
    @query(f"knn_all{name}", f"SELECT query_id, id, round(d, 4) AS distance, rank FROM ({_all_nearest_sql(metric, keep=keep or 'true')})")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        e = _read(spark, sf_dir, "embeddings")
        found = search.all_nearest(e, "vec_id", "embedding", 10, metric, F.expr("vec_id % 50 = 0"), indexed=e.where(keep) if keep else None)
        return found.withColumn("distance", F.round("distance", 4))


_every("", "cosine")
_every("_dot", "dot")
_every("_l2", "l2")
_every("_filter", "cosine", "label = 3")


@query(
    "ann_recall",
    f"WITH e AS ({_all_nearest_sql('cosine')}), r AS ({_all_nearest_sql('cosine', _BYTES)}), "
    "m AS (SELECT e.query_id, count(r.id) AS n, min(r.rank) AS best, sum(CASE WHEN r.id IS NULL THEN 0.0::DOUBLE ELSE 1 / log2(r.rank + 1) END) AS dcg, count(*) AS total FROM e LEFT JOIN r ON r.query_id = e.query_id AND r.id = e.id GROUP BY e.query_id) "
    "SELECT round(avg((n > 0)::INTEGER), 6) AS hit_rate, round(avg(n / total), 6) AS recall, round(avg(coalesce(1.0::DOUBLE / best, 0)), 6) AS mrr, "
    "round(avg(dcg / list_sum(list_transform(range(1, least(total, 10) + 1), lambda i: 1 / log2(i + 1)))), 6) AS ndcg FROM m",
)
def ann_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well vectors of bytes find the ten nearest of every vector whose id is divisible by 50."""
    e, asked = _read(spark, sf_dir, "embeddings"), F.expr("vec_id % 50 = 0")
    rough = e.select("vec_id", search.dequantize(quantize(F.col("embedding"))).alias("embedding"))
    nearest = [search.all_nearest(e, "vec_id", "embedding", 10, "cosine", asked, indexed=x) for x in (e, rough)]
    quality = search.ranking_quality(nearest[1], nearest[0], 10)
    return quality.select(*[F.round(c, 6).alias(c) for c in quality.columns])
