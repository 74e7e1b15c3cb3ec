"""Token blocks round trip, packing, and the pipeline on whole small tables."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.llm import packing, textkit, token_codec

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").cache()


def test_tokenizer_agrees_with_the_library():
    rnd = random.Random(3)
    parts = ["a", "b", "Z", " ", "  ", "\n", "\t", "'", "'s", "'ll", "é", "日", "1", "9", ".", "-", " ", "don't", "\r\n", "ß", "́", "|", "🙂"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(4000)]
    t = token_codec.Tokenizer()
    for _ in range(2):  # the second time from known pieces
        ids, first = t.encode_all(*textkit.buffers(pa.array(texts)))
        for k, x in enumerate(texts):
            assert ids[first[k] : first[k + 1]].tolist() == t.encoding.encode_ordinary(x)


def test_tokenizer_tells_equal_hashes_apart_and_knows_words_of_other_letters():
    """A sign and a zero byte once had the hash of another sign; accented words went through the pattern with all that stood beside them."""
    t = token_codec.Tokenizer()
    texts = ["a!\0b", 'a"b'] + [f"{a}{chr(c)}{b}" for c in range(1, 0x800) for a, b in (("", ""), ("a ", "a"), (" ", "'s"), ("\n", " "))]
    ids, first = t.encode_all(*textkit.buffers(pa.array(texts)))
    for k, x in enumerate(texts):
        assert ids[first[k] : first[k + 1]].tolist() == t.encoding.encode_ordinary(x)
    raw = [b"\xc3", b"\xa9 a", b"a\xe2\xc3\xa9 b", b"\xd0", b"\xb6\xd0\xb6", b" \xc3\xa9\xa9"]  # not UTF-8, and not joined at a text's end
    ids, first = t.encode_all(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for k, x in enumerate(raw):
        assert ids[first[k] : first[k + 1]].tolist() == t.encoding.encode_ordinary(x.decode("utf-8", "replace"))
    words = ["été", "señor", "größe", "жизнь", "ωμέγα", "naïve"]
    rnd = random.Random(4)
    start, end, plain = t._stretches(*textkit.buffers(pa.array([" ".join(rnd.choices(words, k=300)) for _ in range(20)])))
    assert plain.all() and len(start) == 6000


def test_coder_round_trip():
    rng = np.random.default_rng(1)
    runs = [rng.integers(0, 50_256, 9), np.zeros(3000, int), rng.zipf(1.3, 8192) % 50_256, np.array([50_255]), np.zeros(0, int), np.tile([5, 6, 7], 700)]
    first = np.concatenate([[0], np.cumsum([len(r) for r in runs])])
    coded = token_codec.encode_blocks(np.concatenate(runs).astype(np.uint32), first, 50_256)
    for run, (_, payload) in zip(runs, coded):
        assert token_codec.decode_block(payload, len(run), 50_256).tolist() == run.tolist()
    assert len(coded[1][1]) < 120 and len(coded[5][1]) < 500  # what repeats is nearly free


def test_coder_takes_runs_of_any_length():
    """About the coder's steps, and runs that are counted beside others or have no ids at all."""
    rng = np.random.default_rng(2)
    sizes = [0, 1, 2, 3, token_codec.STEPS - 1, token_codec.STEPS, token_codec.STEPS + 1, 0, 700]
    for vocabulary in (50, 50_256):
        for some in (sizes, sizes[:1], sizes[1:2], []):
            runs = [rng.integers(0, min(vocabulary, 90), n) for n in some]
            first = np.cumsum([0, *some])
            coded = token_codec.encode_blocks(np.concatenate([*runs, np.zeros(0, int)]).astype(np.uint32), first, vocabulary)
            assert [token_codec.decode_block(p, len(r), vocabulary).tolist() for r, (_, p) in zip(runs, coded)] == [r.tolist() for r in runs]


def test_coder_takes_large_vocabularies():
    rng = np.random.default_rng(5)
    for size in (131_071, 131_072, 199_000, token_codec.MOST_IDS):
        ids = (rng.zipf(1.2, 17_000) % size).astype(np.uint32)
        first = np.array([0, 8192, 16_384, 17_000])
        for (_, payload), a, b in zip(token_codec.encode_blocks(ids, first, size), first[:-1], first[1:]):
            if b - a < 1000 or size == 199_000:
                assert (token_codec.decode_block(payload, b - a, size) == ids[a:b]).all()
    with pytest.raises(ValueError, match="vocabulary"):
        token_codec.encode_blocks(np.array([5], np.uint32), np.array([0, 1]), 5)
    with pytest.raises(ValueError, match="vocabulary"):
        token_codec.encode_blocks(np.array([5], np.uint32), np.array([0, 1]), token_codec.MOST_IDS + 1)


def test_counts_against_plain_python():
    """Only tokens whose context was seen before their epoch are counted further, up to whole blocks of one id, where the packed fields are fullest."""
    rnd = np.random.default_rng(8)
    runs = [rnd.integers(0, 5, token_codec.BLOCK), np.full(token_codec.BLOCK, 3), np.r_[np.zeros(4000, int), np.full(4192, 9)], rnd.integers(0, 400, 5000)]
    ids = np.concatenate(runs)
    keys = np.repeat(np.arange(len(runs)), [len(x) for x in runs]) * 3 + rnd.integers(0, 3, len(ids)) * (ids < 400)
    position = np.concatenate([np.arange(len(x)) for x in runs])
    epoch = (np.searchsorted(token_codec.EPOCHS, position, "right") - 1).astype(np.int8)
    (at, *got), numbers = token_codec._counts(keys, ids, epoch, True)
    want, before = {}, {}
    for e in range(len(token_codec.EPOCHS) - 1):
        here = np.flatnonzero(epoch == e)
        for k in here.tolist():
            seen = before.get(int(keys[k]), {})
            if seen:
                x = int(ids[k])
                want[k] = (sum(n for y, n in seen.items() if y < x), seen.get(x, 0), sum(seen.values()))
        for k in here.tolist():
            own = before.setdefault(int(keys[k]), {})
            own[int(ids[k])] = own.get(int(ids[k]), 0) + 1
    assert dict(zip(at.tolist(), zip(*(x.tolist() for x in got)))) == want and max(x[2] for x in want.values()) > 2000
    assert len(at) < len(ids) and len(set(numbers.tolist())) == len(set(zip(keys.tolist(), ids.tolist())))
    (_, _, same, seen), _ = token_codec._counts(np.zeros(token_codec.BLOCK, int), np.full(token_codec.BLOCK, 3), epoch[: token_codec.BLOCK])
    assert same.max() == seen.max() == token_codec.EPOCHS[-2]
    share, seen = rnd.integers(0, 1 << 24, 200_000), rnd.integers(1, token_codec.BLOCK + 1, 200_000)
    part = rnd.integers(0, seen + 1)
    assert (token_codec._part(share, part, seen) == share * part // seen).all()
    share = share // seen * seen  # quotients that are whole, and one less than whole
    assert (token_codec._part(share, seen, seen) == share).all() and (token_codec._part(np.maximum(share - 1, 0), np.ones_like(seen), seen) == np.maximum(share - 1, 0) // seen).all()


def test_blocks_round_trip(docs):
    some = docs.select("doc_id", "text", "lang")
    blocks = token_codec.encode(some).cache()
    t = token_codec.Tokenizer()
    want = {r.doc_id: t.encoding.encode_ordinary(r.text) for r in some.collect()}
    got = defaultdict(dict)
    for r in token_codec.decode(blocks).collect():
        got[r.doc_id][r.part] = list(r.ids)
    assert {k: sum((v[p] for p in sorted(v)), []) for k, v in got.items()} == want
    raw = sum(len(v) for v in want.values()) * 2
    assert sum(len(r.payload) for r in blocks.select("payload").collect()) < 0.7 * raw
    broken = blocks.limit(1).selectExpr("doc_ids", "lengths", "part", "n_tokens", "crc + 1 AS crc", "payload")
    with pytest.raises(Exception, match="checksum"):
        token_codec.decode(broken).collect()


def test_blocks_messy(messy, empty):
    rows = token_codec.encode(messy).collect()
    ids = Counter(i for r in rows for i in r.doc_ids if r.part == 0)
    assert ids == Counter([1, 2, 2, 3, 4, 5, 6, None, None, 7, 8, 9])
    assert all(sum(r.lengths) == r.n_tokens <= token_codec.BLOCK for r in rows) and max(r.part for r in rows) > 5
    assert token_codec.encode(empty).count() == 0


# packing
def check_packing(rows, lengths, capacity):
    """Every token once, no bin too full; returns the number of bins."""
    fill, tokens = Counter(), Counter()
    for r in rows:
        fill[r.bin_id] += r.n_tokens
        tokens[r.doc_id] += r.n_tokens
    assert max(fill.values(), default=0) <= capacity
    assert tokens == lengths
    return len(fill)


def test_packing_is_no_worse_than_best_fit_decreasing(spark):
    rng = np.random.default_rng(2)
    sizes = np.clip(rng.lognormal(5.5, 1, 3000), 1, 1900).astype(int)
    frame = spark.createDataFrame([(k, " ".join(["w"] * (int(n) - 1))) for k, n in enumerate(sizes)], "doc_id long, text string")
    n = check_packing(packing.pack(frame).collect(), Counter({k: int(v) for k, v in enumerate(sizes)}), packing.CAPACITY)
    fills = []
    packing.best_fit(sorted(sizes.tolist(), reverse=True), fills, packing.CAPACITY)
    assert -(-sizes.sum() // packing.CAPACITY) <= n <= len(fills)


def test_operators_of_the_algorithm_keep_solutions_valid():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 900, 400)
    people = packing.founders(sizes, 1000, 1, rng)
    for _ in range(5):
        child = packing.mutate(packing.crossover(people[0], people[1], sizes, 1000, rng), sizes, 1000, rng)
        assert len(child) == 400 and np.bincount(child, sizes).max() <= 1000
    before = max(packing.fitness(p, sizes, 1000) for p in people)
    assert packing.fitness(packing.epoch(people, sizes, 1000, rng)[0], sizes, 1000) >= before


def fewest_bins(sizes, capacity):
    """By trying all: the fewest bins for a few pieces."""
    best = len(sizes)

    def place(k, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if k == len(sizes):
            best = len(rooms)
            return
        for at in {r: i for i, r in enumerate(rooms) if r >= sizes[k]}.values():
            place(k + 1, [r - sizes[k] if i == at else r for i, r in enumerate(rooms)])
        place(k + 1, [*rooms, capacity - sizes[k]])

    place(0, [])
    return best


def test_packing_against_brute_force(spark):
    rng = np.random.default_rng(11)
    for _ in range(4):
        sizes = sorted((int(x) for x in rng.integers(15, 70, 11)), reverse=True)
        frame = spark.createDataFrame([(k, " ".join(["w"] * (n - 1))) for k, n in enumerate(sizes)], "doc_id long, text string")
        assert check_packing(packing.pack(frame, capacity=100).collect(), Counter(dict(enumerate(sizes))), 100) == fewest_bins(sizes, 100)


def test_rows_without_ids_are_spread_over_shards(spark):
    """Missing and repeated ids fill no shard more than others."""
    frame = spark.range(40_000).selectExpr("CASE WHEN id % 2 = 0 THEN 5 END AS doc_id", "'a b c' AS text")
    rows = packing.pack(frame).groupBy((F.col("bin_id") / (1 << 32)).cast("int").alias("shard")).count().collect()
    assert len(rows) == 10 and max(r["count"] for r in rows) < 1.2 * 4000


def test_packing_messy(messy, empty):
    rows = packing.pack(messy).collect()
    want = Counter()
    for r in messy.select("doc_id", "text").collect():
        want[r.doc_id] += len((r.text or "").split()) + 1
    check_packing(rows, want, packing.CAPACITY)
    pieces = sorted(r.piece for r in rows if r.doc_id == 8)
    assert pieces == list(range(len(pieces))) and len(pieces) > 20
    assert packing.pack(empty).count() == 0


# pipeline
def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, SF).cache()
        assert out.columns == docs.columns and out.count() <= kept.count() and out.join(kept, docs.columns, "left_anti").count() == 0, name
        kept = out
    packed = corpus_pipeline.STAGES[-1][1](spark, kept, SF).collect()
    assert {r.doc_id for r in packed} == {r.doc_id for r in kept.select("doc_id").collect()}
    assert {(r.doc_id, r.piece, r.n_tokens) for r in corpus_pipeline.run(spark, SF).collect()} == {(r.doc_id, r.piece, r.n_tokens) for r in packed}


def test_pipeline_stages_against_brute_force(spark):
    """Each filter's decisions, from loops over its own input."""
    import corpus_pipeline
    from test_dedup import jaccard_components, words
    from test_models import brute_matches

    from brindle.llm import decontaminate, near_dedup, toxicity

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = lambda df: {r.doc_id: r.text for r in df.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    clean = stages["toxicity"](spark, docs, SF).cache()
    assert set(rows(clean)) == {i for i, t in rows(docs).items() if model.probability(*textkit.buffers(pa.array([t], pa.string())))[0] < toxicity.REJECT}
    single = stages["exact_dedup"](spark, clean, SF).cache()
    first = {}
    for i, t in sorted(rows(clean).items()):
        first.setdefault(t, i)
    assert set(rows(single)) == set(first.values())
    apart = stages["near_dedup"](spark, single, SF).cache()
    pairs = jaccard_components(sorted(rows(single).items()), near_dedup.THRESHOLD)
    root = {i: i for i in rows(single)}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    kept = set(rows(apart))
    assert {i for i in root if find(i) == i} <= kept  # whoever is first of its group, or alone, stays
    assert len(kept) - len({find(i) for i in root}) <= 0.05 * (len(root) - len({find(i) for i in root}))
    some = apart.where("n_chars < 6000").limit(70).cache()
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    held = {d for d, _ in brute_matches(sorted(rows(some).items()), items, decontaminate.THRESHOLD)}
    assert set(rows(stages["decontamination"](spark, some, SF))) == set(rows(some)) - held
    assert all(words(t) for t in rows(some).values())


@pytest.mark.parametrize("which", ["messy", "empty"])
def test_pipeline_of_messy_and_empty_tables(spark, messy, empty, tmp_path, which):
    import corpus_pipeline

    table = {"messy": messy, "empty": empty}[which]
    table.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None, 1), (None, 1, 0), (1, 1, 0)] if which == "messy" else [], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, None), (None, "a b c d e f"), (2, "")] if which == "messy" else [], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == ({1, 3, 4, 5, 6, 7, 8, 9, None} if which == "messy" else set())
