import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from aspectra.llm import quality

DATA = "/root/testdata/sf0.1"


def test_statistics():
    assert quality.statistics("") == [0.0] * len(quality.STATS)
    junk, prose = quality.statistics("spam " * 200), quality.statistics("The cat sat. A dog ran, and birds sang over the hill.")
    assert junk[0] > 0.9 > 0.1 > prose[0]


def test_regression_is_deterministic_and_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    y = (x[:, 0] - x[:, 2] > 0).astype(float)
    a, b = quality.Logistic.fit(x, y), quality.Logistic.fit(x, y)
    assert (a.weights == b.weights).all() and ((a.logit(x) > 0) == (y > 0)).mean() > 0.97
    none = quality.Logistic.fit(np.zeros((0, 3)), np.zeros(0))
    assert none.logit(np.zeros((1, 3)))[0] == 0
    assert quality.Logistic.fit(x, np.zeros(400)).logit(x).max() < -5


def posteriors_by_hand(rows):
    """Shrinkage computed again, row by row: (host, path) posteriors per kind and the decision's probability."""
    chance = lambda x: 1 / (1 + np.exp(-x))
    logit = lambda p: np.log(p / (1 - p))
    out, shifted = [{} for _ in rows], []
    for k in (2, 3):
        own = np.array([chance(r[k]) for r in rows])
        hosts, paths = {}, {}
        for r, x in zip(rows, own):
            for table, key in ((hosts, r[0]), (paths, r[:2])):
                table.setdefault(key, []).append(x)
        mean = own.sum() / len(own)
        shares = np.array([np.mean(v) for v in hosts.values()])
        spread = shares.var() - mean * (1 - mean) * np.mean([1 / len(v) for v in hosts.values()])
        some = [(np.mean(v), np.mean(hosts[h]), len(v), len(hosts[h])) for (h, _), v in paths.items() if len(v) < len(hosts[h])]
        within = np.mean([(a - b) ** 2 for a, b, _, _ in some]) - mean * (1 - mean) * np.mean([1 / n - 1 / m for _, _, n, m in some])
        worth = [float(np.clip(mean * (1 - mean) / max(s, 1e-9) - 1, 5, 1000)) for s in (spread, within)]
        logits = []
        for r, x, o in zip(rows, own, out):
            host, path = hosts[r[0]], paths[r[:2]]
            up = (worth[0] * mean + sum(host) - x) / (worth[0] + len(host) - 1)
            at = (worth[1] * up + sum(path) - x) / (worth[1] + len(path) - 1)
            o[k] = (up, at)
            logits.append(r[k] + logit(at) - logit(mean))
        shifted.append(np.array(logits))
    bad = 1 - (1 - chance(shifted[0])) * (1 - chance(shifted[1]))
    return [(o[2][0], o[3][0], o[2][1], o[3][1], b) for o, b in zip(out, bad)]


def test_sites_shrink_as_by_hand(spark):
    """Every row's posteriors; a site of one document stays near the prior."""
    rng = np.random.default_rng(6)
    rows = [("good", "p", -6.0, -9.0)] * 500 + [("bad", "p", 6.0, -9.0)] * 400 + [("tiny", "p", 6.0, -9.0)] + [("good", "q", 6.0, -8.0)] * 3
    rows += [(f"h{i % 17}", f"p{i % 5}", float(rng.normal(-3 + i % 17 / 4, 1)), float(rng.normal(-5 + i % 5, 1))) for i in range(700)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "host string, path string, _low double, _toxic double, i long")
    got = quality.with_posteriors(df, quality.site_sums(df, "host", "path"), "host", "path").orderBy("i").collect()
    want = posteriors_by_hand(rows)
    for r, w in zip(got, want):
        assert np.allclose((r.host_low, r.host_toxic, r.path_low, r.path_toxic, r._bad), w, atol=1e-6)
        assert r._keep == (w[4] <= 0.5)
    place = {r: i for i, r in enumerate(rows)}
    bad, tiny, good = (got[place[r]] for r in (("bad", "p", 6.0, -9.0), ("tiny", "p", 6.0, -9.0), ("good", "p", -6.0, -9.0)))
    assert bad.host_low > 0.9 > 0.7 > tiny.host_low and good.host_low < 0.05


def test_repeated_labelled_rows(spark):
    """An id that many rows have is fitted once."""
    rows = [(1, "good text. It goes on, and ends.")] * 50 + [(1, "a")] + [(i, f"word{i} and more, words.") for i in range(2, 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 40)], "doc_id long, quality int, toxic int")
    once = spark.createDataFrame(rows[50:], "doc_id long, text string")
    assert np.allclose(quality.fit(docs, labels).low.weights, quality.fit(once, labels).low.weights)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{DATA}/documents.parquet"), spark.read.parquet(f"{DATA}/labels.parquet")
    fitted = labels.filter("doc_id % 3 <> 0")
    got = quality.quality_posteriors(docs, fitted).join(
        labels.filter("doc_id % 3 = 0"), F.col("id") == F.col("doc_id")
    ).select("keep", "quality", labels["toxic"].alias("is_toxic")).collect()
    clean = [r.keep for r in got if r.quality == 1 and not r.is_toxic]
    junk = [r.keep for r in got if r.quality == 0]
    toxic = [r.keep for r in got if r.is_toxic]
    assert np.mean(clean) > 0.98 and np.mean(junk) < 0.05 and np.mean(toxic) < 0.15


def test_odd_rows(spark):
    schema = "doc_id long, text string, source string, lang string, _low string, n int"
    rows = [(1, "a fine text. It goes on, and ends.", None, None, "x", 1), (1, None, "s", "en", "y", 2), (None, "", "s", "en", "z", 3)]
    docs = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(1, 1, 0), (2, None, 1), (None, 0, 0)], "doc_id long, quality int, toxic int")
    assert quality.quality_posteriors(docs, labels).count() == 3
    kept = quality.keep_good(docs, labels)
    assert kept.columns == docs.columns and kept.count() <= 3
    nothing = labels.limit(0)
    assert quality.quality_posteriors(docs.limit(0), nothing).count() == 0
    assert quality.quality_posteriors(docs, nothing).filter("bad IS NULL").count() == 0


def test_terms_without_a_matrix():
    """The optimum of the dense fit, from lists of terms."""
    rng = np.random.default_rng(3)
    x = (rng.random((600, 40)) < 0.1).astype(float)
    x[:5] = 0
    y = (rng.random(600) < quality.sigmoid(2 * x[:, 0] + 2 * x[:, 1] - x[:, 2] - 1)).astype(float)
    dense = quality.Logistic.fit(x, y, penalty=0.1, raw=True)
    weights, bias = quality.fit_terms([np.flatnonzero(r).tolist() for r in x], y, 40, penalty=0.1)
    assert np.abs(weights - dense.weights).max() < 1e-4 and abs(bias - dense.bias) < 1e-4
    assert quality.fit_terms([], np.zeros(0), 0)[0].size == 0


def test_every_term_over_the_excess_is_used(spark):
    """600 words that only toxic texts have, with two more terms from most of them."""
    rng = np.random.default_rng(5)
    bad = ["".join(rng.choice(list("bdgklmnp"), 6)) for _ in range(600)]
    rows = [(i, " ".join(f"fine{'abcdefghij'[(i + k) % 10]}" for k in range(5)) + (" " + " ".join(bad) if i % 10 == 0 else "")) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 10 == 0)) for i in range(400)], "doc_id long, quality int, toxic int")
    assert set(bad) <= quality.fit(docs, labels).words.keys()
