"""Classifiers on held-out labels and against brute force, language, identifiers and benchmark passages."""

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brindle.llm import boosting, decontaminate, langid, pii, quality, textkit, toxicity

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{LARGER}/documents.parquet").cache()


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{LARGER}/labels.parquet").cache()


# quality
def test_quality_held_out(spark):
    d, lab = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    model = quality.fit(d, lab.where("doc_id % 2 = 0"))
    got = quality.score(d, model).join(lab.where("doc_id % 2 = 1"), "doc_id").toPandas()
    assert got.good[got.quality == 1].mean() > 0.98 and got.good[got.quality == 0].mean() < 0.15
    assert 0.8 < model.prior < 0.93


def test_non_negative_risk_learns_from_positives_and_unlabelled():
    rng = np.random.default_rng(2)
    good, bad = rng.normal(0, 1, (4000, 3)), rng.normal(3, 1, (4000, 3))
    unlabelled = np.concatenate([good[1500:3000], bad[:1500]])
    bins = quality.Binned(np.concatenate([good[:1500], unlabelled]))
    p, u = bins(good[:1500]), bins(unlabelled)
    half = rng.random(3000) < 0.5
    separator = quality.Separator(bins, p[:750], u[half], rng)
    counts = [np.bincount(separator.place(x), minlength=len(separator.cuts) + 1) for x in (good[750:1500], unlabelled[~half])]
    prior = quality.prior_of(*counts)
    assert 0.42 < prior < 0.6
    model = quality.train(bins, p, u, prior, rng)
    score = lambda x: model.weights[model.bins(x)].sum(axis=1) + model.weights[-1]
    assert (score(good[3000:]) > 0).mean() > 0.93 and (score(bad[1500:]) > 0).mean() < 0.07


def test_risk_and_prior_against_their_definitions():
    rng = np.random.default_rng(8)
    for prior in (0.1, 0.5, 0.9):
        zp, zu = rng.normal(1, 2, 50), rng.normal(0, 2, 80)
        loss = lambda z, y: 1 / (1 + np.exp(y * z))
        plus, minus = np.mean([loss(z, 1) for z in zp]), np.mean([loss(z, -1) for z in zu]) - prior * np.mean([loss(z, -1) for z in zp])
        risk, negative = quality.nonnegative_risk(1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu)), prior)
        assert risk == pytest.approx(prior * plus + max(0, minus)) and negative == pytest.approx(minus)
    reach_p, reach_u = rng.integers(0, 5, 300), rng.integers(0, 4, 900)
    bounds = []
    for c in range(1, 5):
        a, b = (reach_p >= c).mean(), (reach_u >= c).mean()
        bounds.append(b / a + b / a * np.sqrt((1 - a) / (a * 300) + (1 - b) / (max(b, 1 / 900) * 900)) + 1 / (900 * a))
    assert quality.prior_of(np.bincount(reach_p, minlength=5), np.bincount(reach_u, minlength=5)) == pytest.approx(np.clip(min(bounds), 0.02, 0.98))
    assert quality.prior_of(np.zeros(3, int), np.zeros(3, int)) == 0.98


def test_prior_is_counted_over_all_rows(spark, docs, labels):
    """The counts behind the prior are those of every row of the counting half."""
    texts = docs.select(F.col("doc_id").alias("id"), F.col("text").alias("t"))
    trusted = labels.where("quality = 1").select(F.col("doc_id").alias("id")).distinct()
    seen = {}

    class Two:
        cuts = np.array([0.5])

        @staticmethod
        def place(x):
            return (x[:, -1] > 5).astype(int)  # by the logarithm of the number of words

    original = quality.prior_of
    quality.prior_of = lambda p, u: seen.update(p=p.tolist(), u=u.tolist()) or 0.5
    try:
        quality.count_prior(texts, trusted, Two, 5)
    finally:
        quality.prior_of = original
    half = {r.id for r in texts.where(quality._half(5)).select("id").collect()}
    good = {r.id for r in trusted.collect()}
    many = {r.doc_id: len(textkit.Words(*textkit.buffers(pa.array([r.text], pa.string()))).hash) for r in docs.collect()}
    want_u = [sum(np.log1p(many[i]) <= 5 for i in half), sum(np.log1p(many[i]) > 5 for i in half)]
    want_p = [sum(np.log1p(many[i]) <= 5 for i in half & good), sum(np.log1p(many[i]) > 5 for i in half & good)]
    assert seen == {"p": want_p, "u": want_u}


def test_quality_messy(messy, empty, labels, spark):
    some = spark.createDataFrame([(1, 1), (1, 1), (7, None), (None, 1), (8, 0)], "doc_id long, quality int")
    model = quality.fit(messy, some)
    rows = quality.score(messy, model).collect()
    assert len(rows) == messy.count() and all(r.score is None and not r.good for r in rows if r.doc_id in (3, 4, 5, 6))
    assert quality.keep_good(messy, model).columns == messy.columns
    nothing = quality.fit(messy, labels.limit(0))
    assert all(r.good == (r.doc_id not in (3, 4, 5, 6)) for r in quality.score(messy, nothing).collect() if r.doc_id)
    assert quality.score(empty, quality.fit(empty, labels)).count() == 0


# toxicity
def test_toxicity_held_out(spark):
    d, lab = spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    got = toxicity.score(d, toxicity.fit(d, lab.where("doc_id % 2 = 0"))).withColumnRenamed("toxic", "says").join(lab.where("doc_id % 2 = 1"), "doc_id").toPandas()
    assert got.says[got.toxic == 1].mean() > 0.8 and got.says[got.toxic == 0].mean() < 0.01


def test_toxicity_messy(messy, empty, labels, spark):
    some = spark.createDataFrame([(1, 1), (2, 1), (7, 0), (8, 0), (9, None), (None, 1)], "doc_id long, toxic int")
    for lab in (some, some.limit(0), some.where("toxic = 1")):
        model = toxicity.fit(messy, lab)
        rows = toxicity.score(messy, model).collect()
        assert len(rows) == messy.count() and all(r.probability == 0 for r in rows if r.doc_id in (3, 4))
        assert toxicity.drop_toxic(messy, model).columns == messy.columns
    assert toxicity.score(empty, toxicity.fit(empty, labels)).count() == 0


def test_toxicity_learns_rare_words(spark):
    """A word in nine of 2,000 toxic documents and in no clean one is significant, however small its share."""
    y = F.when(F.col("id") < 2000, 1).otherwise(0)
    text = F.concat(F.lit("some plain words here "), F.when(F.col("id") < 9, "zorgle").when(F.col("id") < 11, "twice").otherwise("and there"))
    rows = spark.range(18_000).select("id", text.alias("t"), y.alias("y"), (F.col("id") % 2).cast("int").alias("fold"))
    whole = toxicity._learn(rows)[0][2]
    found = lambda word: toxicity.is_in(toxicity.word_hashes([word]), whole.weak).all()
    assert found("zorgle") and not found("twice") and not found("plain") and not found("there")


def test_boosting_and_isotonic():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    z = boosting.Boosted().fit(x[:2000], y[:2000]).score(x[2000:])
    assert ((z > 0) == y[2000:]).mean() > 0.9
    p = boosting.Isotonic().fit(z, y[2000:]).apply(np.sort(z))
    assert (np.diff(p) >= 0).all() and abs(p.mean() - y[2000:].mean()) < 0.05


def test_isotonic_against_the_min_max_formula():
    rng = np.random.default_rng(4)
    x, y, w = np.sort(rng.normal(size=40)), (rng.random(40) < 0.4).astype(float), rng.uniform(0.5, 3, 40)
    fit = boosting.Isotonic().fit(x, y, w)
    mean = lambda a, b: np.average(y[a : b + 1], weights=w[a : b + 1])
    want = [max(min(mean(a, b) for b in range(i, 40)) for a in range(i + 1)) for i in range(40)]
    assert sorted({round(v, 9) for v in fit.y}) == sorted({round(v, 9) for v in want})


def test_toxicity_features_against_plain_python():
    lexicon = toxicity.Lexicon(toxicity.word_hashes(["blarg", "frob"]), toxicity.word_hashes(["meh", "blarg"]))
    texts = ["You blarg! YOU FROB??", "calm words about a hinge and nothing else at all", "idiot idiot x*y a1b meh @@ tu frob", "", "frob " + "pad " * 30 + "you"]
    got = lexicon.features(*textkit.buffers(pa.array(texts)))
    for text, row in zip(texts, got):
        w = [x.lower() for x in re.findall(r"[A-Za-z0-9]+", text)]
        n, hit = max(1, len(w)), [x in toxicity.SEED_WORDS or x in ("blarg", "frob") for x in w]
        near = sum(h and any(x in toxicity.SECOND_PERSON for x in w[max(0, k - toxicity.NEAR) : k + toxicity.NEAR + 1]) for k, h in enumerate(hit))
        letters, size = sum(c.isalpha() for c in text), max(1, len(text))
        want = {
            0: sum(hit) / n, 1: sum(x in ("meh", "blarg") for x in w) / n, 4: sum(x in toxicity.SEED_WORDS for x in w) / n, 5: np.log1p(sum(hit)),
            7: max([sum(hit[k : k + 20]) for k in range(len(w))], default=0), 8: near / max(1, sum(hit)), 9: sum(c.isupper() for c in text) / max(1, letters),
            10: sum(c in "!?" for c in text) / size, 11: sum(c in "*#$%&@|~^" for c in text) / size, 13: sum(a == b for a, b in zip(w, w[1:])) / n, 14: letters / n, 15: np.log1p(len(w)),
        }
        assert {k: row[k] for k in want} == pytest.approx(want), text


# language
def test_language_held_out(docs, spark):
    model = langid.fit_text(langid.labelled_rows(docs.where("doc_id % 2 = 0")))
    got = langid.identify(langid.document_rows(docs), model).join(docs.where("doc_id % 2 = 1").select("doc_id", F.col("lang").alias("is")), "doc_id").toPandas()
    assert (got.lang == got["is"]).mean() > 0.99 and got.probability.between(0, 1).all()


def test_language_evidence(spark, docs):
    """Where the text is silent, markup, suffix and host decide."""
    model = langid.fit_text(langid.labelled_rows(docs))
    body = lambda lang, n: [r.text for r in docs.where(F.col("lang") == lang).limit(n).collect()]
    pages = [(k, "http://a.example.de/x", f'<html lang="de"><p>{t}</p></html>') for k, t in enumerate(body("de", 12))]
    pages += [(100 + k, "http://b.example.fr/x", f'<html lang="fr"><p>{t}</p></html>') for k, t in enumerate(body("fr", 12))]
    pages += [(200, "http://a.example.de/y", "<html></html>"), (201, "http://new.other.fr/", "<html></html>"), (202, None, '<HTML lang="de">12</html>'), (203, None, None), (None, "http://b.example.fr/z", None)]
    got = langid.identify(langid.page_rows(spark.createDataFrame(pages, "page_id long, url string, html string")), model)
    lang = {r.page_id: r.lang for r in got.collect()}
    assert len(lang) == len(pages) and lang[200] == "de" and lang[201] == "fr" and lang[202] == "de" and lang[203] is None and lang[None] == "fr"


def test_language_fusion_against_plain_python(spark, docs):
    """The posterior of every row, from loops over all rows."""
    model = langid.fit_text(langid.labelled_rows(docs))
    bodies = [r.text for r in docs.where("n_chars < 400").limit(24).collect()]
    rows = [(None, k, t if k % 5 else "", ["de", "fr", None][k % 3], ["a.x.de", "b.x.de", "c.y.fr", None, "local"][k % 5]) for k, t in enumerate(bodies)]
    frame = spark.createDataFrame(rows, "doc_id long, page_id long, t string, declared string, host string")
    got = {r.page_id: (r.lang, r.probability) for r in langid.identify(frame, model).collect()}
    n, ll, vote = len(model.languages), [], []
    for r in rows:
        a, grams = model.likelihood(*textkit.buffers(pa.array([r[2]])))
        a = a[0] - a[0].max()
        ll.append(a)
        vote.append(np.exp(a) / np.exp(a).sum() if grams[0] else np.zeros(n))
    parts = lambda h, k: ".".join(h.split(".")[-k:]) if h and "." in h else None
    keys = [{"host": r[4], "domain": parts(r[4], 2), "suffix": parts(r[4], 1), "declared": r[3]} for r in rows]
    others = lambda k, name: sum((v for j, v in enumerate(vote) if keys[j][name] == keys[k][name] and j != k), np.zeros(n)) if keys[k][name] else np.zeros(n)
    for k in range(len(rows)):
        rest = sum((v for j, v in enumerate(vote) if j != k), np.zeros(n))
        smooth = lambda v, parent, alpha: (v + alpha * parent) / (v.sum() + alpha)
        g = smooth(rest, np.full(n, 1 / n), n)
        prior = smooth(others(k, "host"), smooth(others(k, "domain"), g, langid.ALPHA_DOMAIN), langid.ALPHA_HOST)
        logs = ll[k] + np.log(prior)
        for name in ("declared", "suffix"):
            if keys[k][name]:
                logs = logs + np.log((others(k, name) + 0.5) / (rest + 0.5 * (len({x[name] for x in keys if x[name]}) + 1)))
        p = np.exp(logs - logs.max())
        if vote[k].sum() == 0 and not rows[k][3] and not rows[k][4]:
            assert got[k] == (None, None)
        else:
            assert got[k][0] == model.languages[int(logs.argmax())] and got[k][1] == pytest.approx(p.max() / p.sum(), rel=1e-6)


def test_language_messy(messy, empty, docs):
    model = langid.fit_text(langid.labelled_rows(docs))
    assert langid.identify(langid.document_rows(messy), model).count() == messy.count()
    assert langid.identify(langid.document_rows(empty), model).count() == 0
    none = langid.fit_text(langid.labelled_rows(empty))
    assert all(r.lang is None for r in langid.identify(langid.document_rows(messy), none).collect())


def test_other_tables_with_nulls_and_clashing_columns(spark, messy, empty, docs):
    """``pages``, ``labels`` and ``benchmark`` may be empty, hold nulls, repeat rows and have columns of any name."""
    clash = lambda df: df.withColumns({c: F.lit("clash") for c in ("id", "t", "y", "n", "h", "host", "declared", "fold", "lang", "vote", "start", "kind")})
    model = langid.fit_text(langid.labelled_rows(docs))
    pages = clash(spark.createDataFrame([(1, "http://a.de/", "<p>der und die</p><script> unclosed <b> x"), (1, None, None), (None, "", "<!-- open"), (2, "x", "")], "page_id long, url string, html string"))
    got = langid.identify(langid.page_rows(pages), model).collect()
    assert len(got) == 4 and sorted(str(r.page_id) for r in got) == ["1", "1", "2", "None"]
    assert langid.identify(langid.page_rows(pages.limit(0)), model).count() == 0
    labels = clash(spark.createDataFrame([(1, 1, 0), (1, 1, 0), (7, 0, 1), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int"))
    assert quality.score(messy, quality.fit(messy, labels)).count() == messy.count()
    assert toxicity.score(messy, toxicity.fit(messy, labels)).count() == messy.count()


# identifiers
def test_identifiers(spark):
    rows = [
        (1, "write to ann.lee@mail.example.com, or call +1 (201) 555-0134 now"),
        (2, "card 4111111111111111 and no card 4111111111111112; address 10.20.30.40 but not 10.20.30.400"),
        (3, 'token = "9b0b3c6a43eb78aa99cbd7049c572391524f37a8" here'),
        (4, "version 2.0.1 of 2024, 12 apples, 555-0134"),
        (5, None),
    ]
    got = {(r.doc_id, r.kind, r.value) for r in pii.identifiers(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, "email", "ann.lee@mail.example.com"), (1, "phone", "+1 (201) 555-0134"), (2, "number", "4111111111111111"), (2, "ip", "10.20.30.40"), (3, "secret", "9b0b3c6a43eb78aa99cbd7049c572391524f37a8")}
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_bootstrapping_finds_what_no_seed_rule_knows(spark):
    """Codes in a context that seeds share are found without the announcing word; numbers of another shape are not."""
    rnd = np.random.default_rng(5)
    code = lambda: "".join(rnd.choice(list("0123456789abcdef"), 40))
    rows = [(k, f'set token = "{code()}" end') for k in range(30)]
    rows += [(100, f"we saw {code()} in the log"), (101, "order 123456789012345678 shipped"), (102, "file a1b2c3d4e5f6g7h8i9 there")]
    got = {(r.doc_id, r.seed): r.score for r in pii.identifiers(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100, False] > 0.75 and all(got[k, True] == 1 for k in range(30)) and not any(k[0] in (101, 102) for k in got)


def test_slots_find_other_forms(spark):
    """Confident contexts take forms that no candidate has; ordinary words in their slots are left alone."""
    rows = [(k, f"my phone is +1 (201) 555-01{k:02d} today") for k in range(30)]
    rows += [(100 + k, f'set token = "{"".join(chr(97 + (k * 7 + j * j) % 26) for j in range(19))}{k}" end') for k in range(20)]
    rows += [(200, "my phone is 123-45-6789 today"), (201, "my phone is broken today"), (202, "a broken hinge, a broken door"), (203, 'set token = "qwhzzkpv" end'), (204, "write ANN.LEE@MAIL.COM soon")]
    rows += [(205, "my phone is DE89 3704 0044 0532 0130 00 today")]
    got = [r for r in pii.identifiers(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r.doc_id >= 200]
    assert {(r.doc_id, r.value) for r in got} >= {(200, "123-45-6789"), (203, "qwhzzkpv"), (204, "ANN.LEE@MAIL.COM"), (205, "DE89 3704 0044 0532 0130 00")}
    assert not any(r.doc_id in (201, 202) for r in got) and all(dict(rows)[r.doc_id][r.start : r.end] == r.value for r in got)


def test_graph_scores_against_plain_python(spark):
    """Confidences and scores of ``bootstrap`` without slots, from loops over the graph."""
    rnd = np.random.default_rng(9)
    rows = [(k, "x", 0, 1, f"v{rnd.integers(25)}", [None, None, 1.0, 0.0][rnd.integers(4)], [f"p{j}" for j in rnd.choice(8, 3, replace=False)]) for k in range(120)]
    marks, edges = {}, set()
    for _, _, _, _, v, m, ps in rows:
        marks[v] = max([x for x in (marks.get(v), m) if x is not None], default=None)
        edges |= {(v, p) for p in ps}
    score = {v: m or 0.0 for v, m in marks.items()}
    for _ in range(pii.ROUNDS):
        own = {p: [v for v, q in edges if q == p] for p in {p for _, p in edges}}
        confidence = {p: sum(score[v] for v in vs) / (len(vs) + pii.DAMP) for p, vs in own.items()}
        confident = {p: c for p, c in confidence.items() if c >= pii.CONFIDENT and sum(score[v] >= pii.ACCEPT for v in own[p]) >= pii.SUPPORT}
        belief = {v: 1 - np.prod([1 - min(confident[p], 0.999) for w, p in edges if w == v and p in confident] or [1.0]) for v in marks}
        score = {v: belief[v] if marks[v] is None else marks[v] for v in marks}
    instances, *_ = pii.bootstrap(spark.createDataFrame(rows, pii.SCHEMA))
    assert {r.value: r.score for r in instances.collect()} == pytest.approx(score)


def test_slots_that_take_too_much(spark, monkeypatch):
    """Patterns whose slots take more strings than leave them confident are out, the others' strings come whole, however the texts are cut."""
    rnd = np.random.default_rng(3)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    texts = [" ".join(["for the", str(rnd.choice(words)), "and", str(rnd.choice(words[:20])), "said"]) for _ in range(600)]
    texts += [f"my pin is {v} now" for v in ("qwe", "asd", "qwe", "k9")] + ["on asd by", "asd asd", "my pin is"]
    slots = {"phone|[for the": (5, 25), "phone|[and\tsaid": (20, 20), "email|[and\tsaid": (19, 40), "phone|[pin is": (3, 9), "email|[pin is": (2, 9)}
    stands, count = [], Counter(w for t in texts for w in t.split())
    for w in map(str.split, texts):
        for k in range(1, len(w)):
            for kind in ("phone", "email"):
                own = {f"{kind}|[{w[k - 2]} {w[k - 1]}"} if k > 1 else set()
                own |= {f"{kind}|[{w[k - 1]}\t{w[k + 1]}"} if k + 1 < len(w) else set()
                stands.append((kind, w[k], own & set(slots)))
    known = {("phone", "qwe", "phone|[pin is"), ("email", "asd", "email|[pin is")}
    taken = {(kind, v, p) for kind, v, ps in stands for p in ps}
    out = {p for p, (room, _) in slots.items() if sum(x[2] == p for x in taken - known) > room}
    assert out == {"phone|[for the", "email|[and\tsaid"}
    inside = Counter((kind, v) for kind, v, ps in stands if ps - out)
    want = {(kind, v, p, 0.0 if inside[kind, v] < 0.5 * count[v] else None) for kind, v, p in taken if p not in out}
    assert {x[3] for x in want} == {0.0, None}
    graph = spark.createDataFrame(sorted(known), "kind string, value string, pattern string")
    asked = spark.createDataFrame([(p, *x) for p, x in slots.items()], "pattern string, room long, most long")
    for first, parts in ((32, 1), (1, 3), (7, 8)):
        monkeypatch.setattr(pii, "FIRST", first)
        docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, t string").repartition(parts)
        rows, gone, _ = pii.proposals(docs, asked, graph)
        assert {r.pattern for r in gone.collect()} == out and rows.count() == len(want)
        assert {tuple(r) for r in rows.select("kind", "value", "pattern", "mark").collect()} == want
    sent = spark.createDataFrame([(0, t) for t in texts], "doc_id long, t string").coalesce(1).mapInArrow(pii._in_slots({"phone|[for the": 25}), "kind string, value string, patterns array<string>, n long")
    assert sent.select("value").distinct().count() == 26  # of 300: enough to tell that the pattern is out


def test_identifiers_of_any_length(spark):
    """No part of an identifier is lost: a first digit after 210 letters, a mailbox of 80, and a code of 8 letters that only its context gives away."""
    long = "a" * 210 + "123456789012345678901234567890"
    box = "m" * 80 + "@mail.example.org"
    rows = [(k, f'set token = "{"".join(chr(97 + (k * 5 + j * j * 3) % 26) for j in range(22))}{k}" end') for k in range(20)]
    rows += [(100, f'set token = "{long}" end'), (101, f"write to {box} now"), (102, 'set token = "qwhzzkpv" end')]
    got = {(r.doc_id, r.value) for r in pii.identifiers(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {(100, long), (101, box), (102, "qwhzzkpv")} <= got and not any(d == 101 and v != box for d, v in got)


def test_byte_spans_are_the_units_of_texts():
    import random

    rnd = random.Random(4)
    parts = ["a1", "12", "3-4", "(5)", "word", "=x", 'k="v9"', " ", " ", "  ", "\n", "é", "7,", ".", "'q'", "99 88", "日9", "\u00a0", "\u3000"]
    texts = ["".join(rnd.choice(parts + [" "] * 5) for _ in range(rnd.randint(0, 12))) for _ in range(3000)]
    data, offsets = textkit.buffers(pa.array(texts))
    start, end, _, leads = pii.spans(data, offsets)
    raw = data.tobytes()
    got = {(a, raw[a:b].decode("utf-8", "replace")) for a, b in zip(start.tolist(), end.tolist())}
    for k, text in enumerate(texts):
        for a, _, value in pii.units(text):
            at = int(offsets[k]) + len(text[:a].encode())
            assert (at, value) in got or any(x <= at < y for x, y in leads), (text, value)


def test_identifier_offsets_and_mess(spark, messy, empty):
    df = spark.createDataFrame([(1, "é日🙂 mail bob.x@y.example.org!"), (None, "bob.x@y.example.org"), (1, "é日🙂 mail bob.x@y.example.org!")], "doc_id long, text string")
    got = pii.identifiers(df).collect()
    assert len(got) == 3 and all("é日🙂 mail bob.x@y.example.org!"[r.start : r.end] == r.value for r in got if r.doc_id)
    assert pii.identifiers(messy).count() == 0 and pii.identifiers(empty).count() == 0


# benchmark passages
def brute_matches(texts, items, threshold):
    """(doc, item) by weighted bigram similarity of every window, without fingerprints."""
    out = {}
    for d, text in texts:
        dw = textkit.Words(*textkit.buffers(pa.array([text], pa.string())))
        s, w, _ = decontaminate._features(dw)
        for i, item in items:
            iw = textkit.Words(*textkit.buffers(pa.array([item], pa.string())))
            si, wi, _ = decontaminate._features(iw)
            n = len(iw.hash)
            if n < decontaminate.SHORT and len(dw.hash) != n:
                continue
            there = dict(zip(si.tolist(), wi.tolist()))
            for p in range(max(1, len(dw.hash) - n + 1)) if len(dw.hash) else []:
                here = dict(zip(s[p : p + max(1, n - 1)].tolist(), w[p : p + max(1, n - 1)].tolist()))
                common = sum(v for h, v in here.items() if h in there)
                j = common / (sum(here.values()) + sum(there.values()) - common)
                if j >= threshold and j > out.get((d, i), 0):
                    out[d, i] = j
    return out


def test_multi_index_is_complete():
    rng = np.random.default_rng(4)
    items = rng.integers(0, 1 << 63, 50, dtype=np.uint64)
    windows = np.array([x ^ np.uint64(sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 24), replace=False))) for x in items for _ in range(6)])
    w, i = decontaminate.within_radius(windows, items, decontaminate.RADIUS)
    want = {(a, b) for a in range(len(windows)) for b in range(len(items)) if int(windows[a] ^ items[b]).bit_count() <= decontaminate.RADIUS}
    assert set(zip(w.tolist(), i.tolist())) == want


def test_contamination_against_brute_force(spark):
    d, b = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    rnd = np.random.default_rng(6)
    items = [(r.item_id, r.text) for r in b.collect()]
    texts = [(r.doc_id, r.text) for r in d.limit(40).collect()]  # whole texts
    for k, (_, t) in enumerate(items[:20] * 3):  # copies with some words changed
        w = t.split()
        for _ in range(int(len(w) * (k % 6) * 0.04)):
            w[rnd.integers(len(w))] = "changed"
        texts.append((10_000 + k, "some words before it " + " ".join(w) + " and after"))
    want = brute_matches(texts, items, decontaminate.THRESHOLD)
    frame = spark.createDataFrame(texts, "doc_id long, text string")
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contamination(frame, b).collect()}
    assert set(got) <= set(want) and len(got) >= 0.97 * len(want) > 20
    assert all(got[k] <= want[k] + 1e-9 for k in got)
    kept = {r.doc_id for r in decontaminate.drop_contaminated(frame, b).collect()}
    assert kept == {i for i, _ in texts} - {d for d, _ in got}


def test_fingerprints_keep_what_is_at_the_threshold():
    """Windows whose similarity is just above the threshold are within the radius: recall by similarity."""
    rng = np.random.default_rng(7)
    vocabulary = [f"{chr(97 + k % 26)}{'xyzuv'[k % 5] * (k % 6 + 1)}{k}" for k in range(3000)]
    near = {0: [], 1: []}
    for _ in range(600):
        n = int(rng.integers(12, 60))
        item = [vocabulary[k] for k in rng.integers(0, 3000, n)]
        window = list(item)
        for _ in range(int(rng.integers(1, max(2, n // 6)))):
            window[int(rng.integers(n))] = vocabulary[int(rng.integers(3000))]
        prints, sets = [], []
        for text in (item, window):
            s, w, _ = decontaminate._features(textkit.Words(*textkit.buffers(pa.array([" ".join(text)]))))
            prints.append(decontaminate.simhash(s[None], w[None])[0])
            sets.append(dict(zip(s.tolist(), w.tolist())))
        common = sum(v for h, v in sets[0].items() if h in sets[1])
        j = common / (sum(sets[0].values()) + sum(sets[1].values()) - common)
        if j >= decontaminate.THRESHOLD:
            near[int(j >= 0.65)].append(int(prints[0] ^ prints[1]).bit_count() <= decontaminate.RADIUS)
    assert len(near[0]) > 40 and np.mean(near[0]) > 0.95 and np.mean(near[1]) > 0.985


def test_contamination_messy(messy, empty, spark):
    bench = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (None, "x y z"), (4, "too short"), (5, "one"), (1, "quick brown fox jumps over the lazy dog")], "item_id long, text string")
    for name in ("id", "t", "n"):
        bench = bench.withColumn(name, F.lit("clash"))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contamination(messy, bench).collect()}
    assert got == {(1, 1), (2, 1), (7, 5)}  # a short item is found where it is the whole text
    kept = decontaminate.drop_contaminated(messy, bench)
    assert kept.columns == messy.columns and kept.count() == messy.count() - 4
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(messy, bench.limit(0)).count() == 0 and decontaminate.drop_contaminated(messy, bench.limit(0)).count() == messy.count()
