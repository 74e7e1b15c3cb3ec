"""Exact and near duplicates, and repeated passages, against brute force."""

import re
from collections import defaultdict

import numpy as np
import pytest
from awkward import LONG, counted

from brindle.llm import exact_dedup, near_dedup, substring

SF = "/root/testdata/sf0.001"


def words(text):
    return [w.lower() for w in re.findall(r"[A-Za-z0-9\u0080-\U0010ffff]+", text or "")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


# exact
def digest_arrays(keys):
    return keys, keys * 3, keys * 5, np.ones(len(keys), np.int64)


def test_cuckoo_table_grows_and_forgets():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, 20_000))
    rng.shuffle(keys)
    live = exact_dedup.LiveDigests()
    first = live.fp.size
    for part in np.array_split(keys, 7):
        assert not live.insert(*digest_arrays(part)).any()
    assert live.fp.size > first and len(live) == len(keys)
    assert (live.insert(*digest_arrays(keys[:10_000])) == 1).all()
    live = exact_dedup.LiveDigests(raw=live.raw())
    live.delete(*digest_arrays(keys[:15_000]))  # 10,000 of them had two carriers
    assert (live.lookup(*digest_arrays(keys)[:3]) == np.r_[np.ones(10_000), np.zeros(5_000), np.ones(len(keys) - 15_000)]).all()
    live.delete(*digest_arrays(keys[10_000:15_000]))
    assert len(live) == len(keys) - 5_000
    key, more, most, _ = digest_arrays(keys[:5])
    assert (live.lookup(key, more + 1, most) == 0).all()  # the same 64 bits with other content are no hit


def test_cuckoo_table_work_follows_its_input():
    """A batch touches two buckets a key, however many the table holds."""
    from time import process_time

    rng = np.random.default_rng(2)

    def seconds(n):
        live, keys = exact_dedup.LiveDigests(), np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, n))
        began = process_time()
        for part in np.array_split(keys, max(1, n // 20_000)):
            live.insert(*digest_arrays(part))
        return process_time() - began

    seconds(50_000)
    assert seconds(400_000) < 3.5 * seconds(200_000) + 0.2


def test_exact_messy(messy):
    got = sorted(exact_dedup.exact_dedup(messy).collect(), key=str)
    flags = defaultdict(list)
    for r in got:
        flags[r.doc_id].append((r.keep_id, r.n_copies, r.is_duplicate))
    assert flags[1] == [(1, 3, False)] and flags[2] == [(1, 3, True)] * 2
    assert flags[3] == [(3, 1, False)] and flags[4] == [(4, 1, False)] and sorted(flags[None]) == [(None, 1, False)] * 2
    kept = exact_dedup.drop_exact_duplicates(messy)
    assert kept.columns == messy.columns and sorted(str(r.doc_id) for r in kept.select("doc_id").collect()) == sorted(["1", "3", "4", "5", "6", "None", "None", "7", "8", "9"])


def test_exact_keeps_one_of_equal_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (None, "a"), (None, "b"), (None, "b")], "doc_id long, text string")
    assert counted(exact_dedup.drop_exact_duplicates(df)) == {(1, "a"): 1, (None, "b"): 1}


def test_exact_empty(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0 and exact_dedup.drop_exact_duplicates(empty).columns == empty.columns


def live_ids(index, rows):
    return {r.doc_id: r.live for r in index.lookup(rows).collect()}


def test_cuckoo_index(spark):
    frame = lambda *rows: spark.createDataFrame(rows, "doc_id long, text string")
    index = exact_dedup.CuckooIndex(spark, parts=4)
    assert index.insert(frame((1, "a"), (2, "b"), (3, None), (4, "b"))).count() == 1  # only "b" has two carriers
    assert live_ids(index, frame((9, "a"), (8, "c"), (7, ""))) == {9: True, 8: False, 7: False}
    index.delete(frame((2, "b"), (5, "never")))
    index = exact_dedup.CuckooIndex(spark, index.path)  # as another session would
    assert live_ids(index, frame((9, "a"), (8, "b"), (7, "never"))) == {9: True, 8: True, 7: False}
    index.delete(frame((4, "b")))
    assert live_ids(index, frame((9, "a"), (8, "b"))) == {9: True, 8: False}
    assert [r.n for r in index.insert(frame((6, "a"))).collect()] == [2]


def test_cuckoo_index_splits_its_parts(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.CuckooIndex, "PART", 50)
    index = exact_dedup.CuckooIndex(spark, parts=2)
    texts = lambda a, b: spark.range(a, b).selectExpr("id doc_id", "concat('t', id) text")
    index.insert(texts(0, 90))
    index.insert(texts(60, 300))
    assert index.parts >= 4 and index.state().count() == index.parts
    assert all(live_ids(index, texts(0, 300)).values()) and not any(live_ids(index, texts(300, 330)).values())


# near
def jaccard_components(rows, threshold, k=3):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[p : p + k]) for p in range(max(1, len(w) - k + 1))} if w else set()
    ids, pairs = [i for i in sets if sets[i]], []
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            common = len(sets[a] & sets[b])
            if common and common / len(sets[a] | sets[b]) >= threshold:
                pairs.append((a, b))
    return pairs


def test_near_against_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    pairs = jaccard_components(rows, near_dedup.THRESHOLD)
    group = {r.doc_id: r.group_id for r in near_dedup.near_dedup(docs).collect()}
    assert set(group) == {i for i, _ in rows}
    assert np.mean([group[a] == group[b] for a, b in pairs]) >= 0.95
    root = {i: i for i in group}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        root[find(a)] = find(b)
    assert all(find(i) == find(g) for i, g in group.items())  # nothing joined that brute force keeps apart


def test_near_messy(messy):
    group = {r.doc_id: r.group_id for r in near_dedup.near_dedup(messy).collect()}
    assert group[2] == 1 and all(group[i] == i for i in (1, 3, 4, 5, 6, 7, 8, 9)) and None not in group
    kept = near_dedup.drop_near_duplicates(messy)
    assert kept.columns == messy.columns and kept.where("doc_id = 2").count() == 0 and kept.count() == messy.count() - 2


def test_near_empty(empty):
    assert near_dedup.near_dedup(empty).count() == 0 and near_dedup.drop_near_duplicates(empty).count() == 0


def test_near_large_groups(spark):
    base = [f"word{k}" for k in range(40)]
    rows = [(n, " ".join(base[:30] + [f"tail{n}a", f"tail{n}b"])) for n in range(300)] + [(1000 + n, " ".join(f"other{n}x{k}" for k in range(25))) for n in range(100)]
    group = {r.doc_id: r.group_id for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {group[n] for n in range(300)} == {0} and all(group[1000 + n] == 1000 + n for n in range(100))


def test_near_work_follows_its_input(spark, monkeypatch):
    """Texts that share a frame but no group: twice the documents are about twice the pairs."""
    judged = []
    verify = near_dedup.verify
    monkeypatch.setattr(near_dedup, "verify", lambda pairs, *a: judged.append(pairs.count()) or verify(pairs, *a))

    def pairs(n):
        judged.clear()
        rows = [(i, " ".join([f"frame{k}" for k in range(22)] + [f"own{i}x{k}" for k in range(34)])) for i in range(n)]
        group = near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert all(r.doc_id == r.group_id for r in group)
        return sum(judged)

    few, many = pairs(200), pairs(400)
    assert many < 2.3 * few


def test_second_round_finds_what_hubs_hide(spark):
    """Members that fail against their bucket's smallest still find each other."""
    frame = [f"frame{k}" for k in range(20)]
    rows = [(n, " ".join(frame + [f"g{n // 2}x{k}" for k in range(28)] + [f"own{n}"])) for n in range(60)]
    group = {r.doc_id: r.group_id for r in near_dedup.near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert group == {n: n - n % 2 for n in range(60)}


# passages
def brute_passages(rows, window):
    seen, out = {}, set()
    for i, t in rows:
        w = words(t)
        for p in range(len(w) - window + 1):
            key = tuple(w[p : p + window])
            if key not in seen:
                seen[key] = (i, p)
            elif seen[key][0] != i:
                out.add((i, p, *seen[key]))
    return out


def spread(df):
    """Every repeated window that the spans stand for, without the stretches that name themselves."""
    rows = [r for r in df.collect() if r.doc_id != r.source_doc_id]
    return {(r.doc_id, r.start_word + k, r.source_doc_id, r.source_start + k) for r in rows for k in range(r.n_words - substring.WINDOW + 1)}


@pytest.mark.parametrize("batches, max_runs", [(1, 4), (3, 1)])
def test_passages_against_brute_force(spark, docs, batches, max_runs):
    from pyspark.sql import functions as F

    order = docs.select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).alias("b")).orderBy("b", "doc_id").collect()
    want = brute_passages([(r.doc_id, r.text) for r in order], substring.WINDOW)
    assert want and spread(substring.repeated_passages(docs, batches=batches, max_runs=max_runs)) == want


@pytest.mark.parametrize("hot", [1, 1000])
def test_passage_index_reopens(spark, docs, monkeypatch, hot):
    """Three batches, each in an index opened anew from its path; with ``hot`` 1 nearly every shared anchor is spread."""
    monkeypatch.setattr(substring, "HOT", hot)
    rows = docs.select("doc_id", "text").orderBy("doc_id").collect()
    parts = [rows[0:90], rows[90:150], rows[150:]]
    path, got = None, set()
    for part in parts:
        index = substring.FingerprintIndex(spark, path=path, max_runs=2)
        got |= spread(index.add(spark.createDataFrame([(r.doc_id, r.text) for r in part], "doc_id long, text string")))
        path = index.path
    assert got == brute_passages([(r.doc_id, r.text) for r in rows], substring.WINDOW)
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("brindle_run")]


def test_passages_by_construction(spark):
    shared = [f"s{k}" for k in range(70)]
    own = lambda n, m: [f"d{n}w{k}" for k in range(m)]
    rows = [
        (1, " ".join(own(1, 30) + shared[:51] + own(11, 5))),
        (2, " ".join(own(2, 10) + shared)),
        (3, " ".join(own(3, 7) + [w.upper() + "," for w in shared] + own(33, 9))),
        (4, " ".join(own(4, 7) + shared[:49] + own(44, 9))),
        (5, " ".join(["loop"] * 200)),
        (6, " ".join(["loop"] * 120)),
    ]
    got = substring.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string"), batches=1).collect()
    assert {(r.doc_id, r.start_word, r.n_words, r.source_doc_id) for r in got} >= {(2, 10, 51, 1), (3, 7, 51, 1), (3, 9, 68, 2)}
    assert {r.doc_id for r in got if r.doc_id != r.source_doc_id} == {2, 3, 6}
    own = [(r.doc_id, r.start_word, r.n_words) for r in got if r.doc_id == r.source_doc_id]
    assert len(own) == len(set(own)) and {(1, 30, 51), (2, 12, 68)} <= set(own) and all(r.start_word == r.source_start for r in got if r.doc_id == r.source_doc_id)


def test_passages_messy(messy, empty, spark):
    assert substring.repeated_passages(messy).count() == 0
    assert substring.repeated_passages(empty).count() == 0
    two = messy.unionByName(messy.where("doc_id = 8").withColumn("doc_id", messy.doc_id + 100))
    got = substring.repeated_passages(two, batches=1)
    assert spread(got) == brute_passages([(8, LONG), (108, LONG)], substring.WINDOW) and got.count() > 0
