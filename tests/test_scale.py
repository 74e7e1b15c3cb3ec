"""Steps whose faults show only where a table has several ranges, or more rows than a batch."""

from contextlib import contextmanager

from pyspark.sql import functions as F

from brindle.operators import dml


@contextmanager
def conf(spark, **settings):
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


RANGES = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}


def test_identity_numbers_every_row_once(spark):
    n = 20_000
    with conf(spark, **RANGES):
        df = spark.range(n).select("id", F.sha2(F.col("id").cast("string"), 256).alias("name"))
        got = dml.assign_identity(df, 1000, ["name"], "n").select("id", "name", "n").collect()
    assert [r["n"] for r in sorted(got, key=lambda r: r["name"])] == list(range(1001, 1001 + n))


def test_identity_of_equal_and_null_names(spark, tmp_path):
    from brindle.plans import catalogue

    names = [None if k % 5 == 0 else f"c{k % 3}" for k in range(2_000)]
    spark.createDataFrame(list(enumerate(names)), "c_custkey long, c_name string").repartition(7).write.parquet(str(tmp_path / "customer.parquet"))
    with conf(spark, **RANGES):
        got = catalogue.QUERIES["identity_assign"](spark, str(tmp_path)).collect()
    want = sorted(range(2_000), key=lambda k: (names[k] is None, names[k] or "", k))
    assert sorted((r.n, r.c_custkey) for r in got) == [(1001 + k, c) for k, c in enumerate(want)]


def test_order_breaks_within_ranges_and_at_their_borders(spark):
    """Every row breaks the order, so each range border has one too."""
    n = 20_000
    with conf(spark, **RANGES):
        df = spark.range(n).repartition(5).select(F.col("id").alias("at"), (-F.col("id")).alias("key"))
        got = sorted(r[0] for r in dml.order_breaks(df, "at", "key").collect())
    assert got == list(range(1, n))


def test_compared_rows_of_a_join_are_spread(spark, tmp_path):
    """Few files, few keys and many pairs: the pairs are made by many tasks."""
    from brindle.plans import catalogue

    spark.createDataFrame([(k, k % 2, float(k)) for k in range(3_000)], "c_custkey long, c_nationkey int, c_acctbal double").coalesce(1).write.parquet(str(tmp_path / "customer.parquet"))
    spark.createDataFrame([(k, k % 2, float(3 * k)) for k in range(300)], "s_suppkey long, s_nationkey int, s_acctbal double").coalesce(1).write.parquet(str(tmp_path / "supplier.parquet"))
    for settings in ({}, {"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        with conf(spark, **settings):
            pairs = catalogue.QUERIES["join_theta_residual"](spark, str(tmp_path)).withColumn("task", F.spark_partition_id()).collect()
        assert sorted((r.c_custkey, r.s_suppkey) for r in pairs) == [(c, s) for c in range(3_000) for s in range(c % 2, 300, 2) if c > 3 * s]
        by_task = [sum(r.task == t for r in pairs) for t in {r.task for r in pairs}]
        assert max(by_task) < len(pairs) / 8


def test_postings_of_large_batches_are_counted_in_pieces(spark, monkeypatch):
    """A batch of many tokens leaves in several, with the counts of each document whole."""
    import numpy as np

    from brindle.operators import search

    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(10, 60, rng.integers(0, 400))) for _ in range(3_000)] + [" ".join(["long"] * 300_000)]
    docs = spark.createDataFrame(list(enumerate(texts)), "i long, t string").coalesce(1)
    seen = {}
    monkeypatch.setattr(type(docs), "mapInArrow", lambda self, run, schema: seen.update(rows=self, run=run, schema=schema))
    search.postings(docs, "i", "t")
    monkeypatch.undo()
    whole = seen["rows"].toArrow().combine_chunks().to_batches()
    assert len(whole) == 1
    parts = list(seen["run"](iter(whole)))
    most = 1 << 17
    assert all(sum(p["tf"].to_pylist()) <= most or p["id"].unique().to_pylist() == [3_000] for p in parts)
    got = sorted((r["id"], r["term"], r["tf"], r["dl"]) for p in parts for r in p.to_pylist())
    want = sorted((k, w, t.split().count(w), len(t.split())) for k, t in enumerate(texts) for w in set(t.split()))
    assert got == want


def test_collation_keys_order_as_whole_keys():
    """The keys of a batch, made without their last least signs, sort as the reference does."""
    import itertools

    import pyarrow as pa

    from brindle.functions import collation

    texts = ["".join(x) for n in range(4) for x in itertools.product("aAáÁnñÑz", repeat=n)] + ["long ñ" * 300_000, None, "n\U0010ffff", "N\U0010ffffá"]
    keys = collation._keys_of(pa.array(texts)).to_pylist()
    assert len(keys) == len(texts) and keys[texts.index(None)] == {"primary": None, "secondary": None, "tertiary": None}
    plain = [k for k, t in enumerate(texts) if t is not None and "\U0010ffff" not in t]
    order = lambda k: tuple(keys[k][n].encode() for n in ("primary", "secondary", "tertiary"))
    assert sorted(plain, key=order) == sorted(plain, key=lambda k: collation.python_key(texts[k]))
    assert keys[texts.index("aa")]["secondary"] == keys[texts.index("aa")]["tertiary"] == ""
    assert order(texts.index("ñ")) < order(texts.index("n\U0010ffff"))


def test_collation_holds_one_string_at_once():
    import tracemalloc

    import pyarrow as pa

    from brindle.functions import collation

    texts = pa.array(["Año nuevo, vida nueva. " * 300] * 3_000)
    tracemalloc.start()
    collation._keys_of(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * texts.nbytes


def test_nearest_neighbours_in_tiles_are_those_of_all_pairs():
    """Batches larger than a tile, equal vectors (ties go by id), vectors without length: little memory, the same rows."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from brindle.operators import search

    rng = np.random.default_rng(5)
    n, dims, k = 10_000, 16, 10
    v = rng.normal(size=(n, dims)).astype(np.float32)
    v[5_000:5_600] = v[:600]
    v[7_000:7_030] = v[0]
    v[9_000:9_020] = 0
    ids = rng.permutation(n).astype(np.int64)
    batch = pa.record_batch([pa.array(ids), pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), dims).cast(pa.list_(pa.float32()))], ["id", "v"])
    at = np.flatnonzero((ids % 20 == 0) | (np.arange(n) < 20) | (np.arange(n) // 10 == 900))
    sent = type("Sent", (), {"value": (ids[at], v[at])})
    x = v.astype(np.float64)
    for metric in ("cosine", "dot", "l2"):
        tracemalloc.start()
        (got,) = search._best_of(sent, k, metric)(iter([batch.slice(0, 9_999), batch.slice(9_999)]))
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 40e6
        want = []
        for q in at:
            if metric == "l2":
                d = np.sqrt(((x - x[q]) ** 2).sum(1))
            else:
                d = 1 - (x * x[q]).sum(1) if metric == "dot" else None
                if d is None:
                    length = np.sqrt((x[q] ** 2).sum()) * np.sqrt((x**2).sum(1))
                    d = np.where(length == 0, 1.0, 1 - (x * x[q]).sum(1) / np.where(length == 0, 1, length))
            d[q] = np.inf
            want += [(ids[q], ids[j], d[j]) for j in np.lexsort((ids, d))[:k]]
        assert got["query_id"].to_pylist() == [w[0] for w in want]
        assert got["id"].to_pylist() == [w[1] for w in want]
        assert np.allclose(got["distance"].to_numpy(), [w[2] for w in want], atol=1e-9)
