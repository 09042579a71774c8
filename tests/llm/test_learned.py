"""Classifiers by held-out accuracy, and the pipeline against its stages by hand."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import language, quality, simhash, toxicity
from palimpsest.llm.common import table

from .data import documents, frame

SF = "/root/testdata/sf0.1"


def labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").withColumn("text", F.lit("clash")).withColumn("y", F.lit(9))


SOME = [(i, i % 2, int(i % 5 == 0)) for i in range(30)] + [(None, 1, 1), (31, None, None), (4, 0, 0)]


def held_out(found, truth, modulus, remainder):
    x = found.toPandas().merge(truth.toPandas(), on="doc_id")
    assert (x.held_out == [zlib.crc32(str(i).encode()) % modulus == remainder for i in x.doc_id]).all()
    assert x.score.between(0, 1).all()
    return x[x.held_out]


def test_quality(spark):
    docs, marks = table(spark, SF, "documents"), table(spark, SF, "labels")
    x = held_out(quality.classify(docs, marks), marks, 4, 2)
    assert (x.predicted == (x.score >= 0.7)).all() and (x.predicted == x.quality).mean() > 0.98
    assert x[x.quality == 1].predicted.mean() > 0.98


def test_toxicity(spark):
    docs, marks = table(spark, SF, "documents"), table(spark, SF, "labels")
    x = held_out(toxicity.classify(docs, marks), marks, 5, 0)
    assert (x.predicted == (x.score >= 0.5)).all() and (x.predicted == x.toxic).mean() > 0.97
    assert x[x.toxic == 1].predicted.mean() > 0.85 and x[x.toxic == 0].predicted.mean() < 0.01


def plain_label_model(votes):
    """The moments of the label model written out by loops."""
    n, m = len(votes), len(votes[0])
    mean = [sum(v[i] for v in votes) / n for i in range(m)]
    cov = [[sum((v[i] - mean[i]) * (v[j] - mean[j]) for v in votes) / n for j in range(m)] for i in range(m)]
    free = {(i, j) for i in range(m) for j in range(m) if i != j}
    for _ in range(4):
        u = []
        for i in range(m):
            good = lambda a, b: (a, b) in free and cov[a][b] > 1e-9
            each = sorted(cov[i][j] * cov[i][k] / cov[j][k] for j in range(m) for k in range(j + 1, m) if good(i, j) and good(i, k) and good(j, k))
            u.append(float(np.median(each)) ** 0.5 if each else 0.0)
        rho = {(i, j): (cov[i][j] - u[i] * u[j]) / (cov[i][i] * cov[j][j]) ** 0.5 for i in range(m) for j in range(m) if i != j}
        free = {p for p, r in rho.items() if abs(r) < 0.15}
    best = sorted(range(m), key=lambda i: -u[i])[:12]
    skews = []
    for a in range(len(best)):
        for b in range(a + 1, len(best)):
            for c in range(b + 1, len(best)):
                i, j, k = best[a], best[b], best[c]
                if {(i, j), (i, k), (j, k)} <= free:
                    skews.append(sum((v[i] - mean[i]) * (v[j] - mean[j]) * (v[k] - mean[k]) for v in votes) / n / (u[i] * u[j] * u[k]))
    g = float(np.median(skews))
    p = (1 - g / (4 + g * g) ** 0.5) / 2
    d = [x / (p * (1 - p)) ** 0.5 for x in u]
    hi, lo = [min(max(a + (1 - p) * b, 1e-3), 0.999) for a, b in zip(mean, d)], [min(max(a - p * b, 1e-3), 0.999) for a, b in zip(mean, d)]
    weight = [1 / (1 + sum(r for (a, _), r in rho.items() if a == i and r > 0.1)) for i in range(m)]
    q = []
    for v in votes:
        z = np.log(p / (1 - p)) + sum(w * (np.log(h / l) if x else np.log((1 - h) / (1 - l))) for x, w, h, l in zip(v, weight, hi, lo))  # noqa: E741
        q.append(1 / (1 + np.exp(-z)))
    return p, hi, lo, q


def test_label_model():
    """Equal to the loops, near the truth, and aware of voters that copy each other."""
    rng = np.random.default_rng(3)
    y = rng.random(4000) < 0.15
    hi, lo = np.array([0.8, 0.7, 0.6, 0.75, 0.5, 0.65, 0.65]), np.array([0.05, 0.02, 0.1, 0.04, 0.01, 0.03, 0.03])
    votes = (rng.random((4000, 7)) < np.where(y[:, None], hi, lo)).astype(np.float32)
    same = rng.random(4000) < 0.8
    votes[same, 6] = votes[same, 5]  # the last two depend on each other
    m = toxicity.label_model(votes)
    assert abs(m.prior - 0.15) < 0.03 and np.abs(m.hi - hi).max() < 0.08 and np.abs(m.lo - lo).max() < 0.03
    assert m.rho[5, 6] > 0.3 and m.weights[5] < 0.8 and m.weights[:5].min() > 0.85
    q = m.posterior(votes)
    assert ((q > 0.5) == y).mean() > 0.98
    p, h, l, plain = plain_label_model(votes[:1500].tolist())  # noqa: E741
    part = toxicity.label_model(votes[:1500].astype(float))
    assert np.allclose((part.prior, *part.hi, *part.lo), (p, *h, *l), rtol=1e-4) and np.allclose(part.posterior(votes[:1500]), plain, atol=1e-4)
    none = toxicity.label_model(np.zeros((5, 3)))
    assert np.isfinite(none.posterior(np.ones((2, 3)))).all()


def test_posterior_labels_are_no_copies(spark):
    """The label model never sees labels, and its posteriors find most toxic rows all the same."""
    model, found = toxicity.sampled(table(spark, SF, "documents"), table(spark, SF, "labels"))
    votes = toxicity.ballots(model, found)
    q, y = toxicity.label_model(votes).posterior(votes), np.array([y for _, y, _ in found])
    assert 0.85 < (q[y == 1] > 0.5).mean() < 1 and (q[y == 0] > 0.5).mean() < 0.02
    assert 0.005 < (np.abs(q - y) > 0.1).mean() < 0.1
    shuffled = [(i, 1 - t, on) for i, t, on in found]
    assert (toxicity.ballots(model, shuffled) == votes).all()


def test_language_sample(spark):
    """The least hashes of each language, counted by ids however often an id recurs."""
    rows = [(k, "ab"[k % 7 == 0]) for k in range(20_000)] + [(3, "a")] * 30_000
    tagged = spark.createDataFrame(rows, "id long, lang string")
    hashes = {r["id"]: r["h"] for r in tagged.distinct().select("id", F.xxhash64("id").alias("h")).collect()}
    want = {(k, g) for g in "ab" for k in sorted({i for i, x in rows if x == g}, key=hashes.get)[:50]}
    got = [tuple(r) for r in language.sample_ids(tagged, 50, 200).collect()]
    assert len(got) == 100 and set(got) == want
    assert language.sample_ids(tagged, 50, 60).count() == 60


def test_language(spark):
    docs = table(spark, SF, "documents")
    x = held_out(language.identify(docs), docs.select("doc_id", "lang"), 4, 2)
    assert (x.lang_pred == x.lang).mean() > 0.99


@pytest.mark.parametrize("rows", [SOME, [], [(i, 1, 1) for i in range(20)]])
def test_edges(spark, rows):
    docs = frame(spark)
    for out in (quality.classify(docs, labels(spark, rows)), toxicity.classify(docs, labels(spark, rows)), language.identify(docs)):
        got = out.collect()
        assert len(got) == len(documents()) and all(0 <= r["score"] <= 1 for r in got)
    for r in quality.classify(docs, labels(spark, rows)).where("doc_id IN (40, 41, 42)").collect():
        assert r["score"] == 0 and r["predicted"] == 0
    und = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs).collect()}
    assert [und[i] for i in (40, 41, 42, 46)] == ["und"] * 4 and und[7] in ("en", "de")


def test_empty_tables(spark):
    docs = frame(spark, empty=True)
    assert quality.classify(docs, labels(spark, SOME)).count() == toxicity.classify(docs, labels(spark, SOME)).count() == language.identify(docs).count() == 0


def test_label_is_no_input(spark):
    """Scores of texts don't depend on ids, sources or languages of the rows scored."""
    docs, marks = table(spark, "/root/testdata/sf0.01", "documents"), table(spark, "/root/testdata/sf0.01", "labels")
    model = quality.train(docs, marks)
    moved = docs.select((F.col("doc_id") + 10**6).alias("doc_id"), "text")
    a = [r[0] for r in docs.orderBy("doc_id").select(quality.score_of(F.col("text"), model)).collect()]
    b = [r[0] for r in moved.orderBy("doc_id").select(quality.score_of(F.col("text"), model)).collect()]
    assert a == b


def test_pipeline(spark):
    import corpus_pipeline as pipe

    from .test_exact import hits, repeats, similar

    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    done = []
    for name, stage in pipe.STAGES:
        out = stage(spark, docs, sf)
        done.append((name, [r.asDict() for r in docs.collect()], [r.asDict() for r in out.collect()]))
        if name != "packing":
            assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = out if name == "packing" else simhash.written(out)
    by = {name: (a, b) for name, a, b in done}
    a, b = by["quality"]
    model = quality.train(table(spark, sf, "documents"), table(spark, sf, "labels"))
    assert sorted(r["doc_id"] for r in b) == sorted(r["doc_id"] for r in a if (x := quality.statistics(r["text"])) and model.score(quality.np.array([x]))[0] >= 0.7)
    a, b = by["near_duplicates"]
    want, groups = similar([(r["doc_id"], r["text"]) for r in a])
    assert sorted(r["doc_id"] for r in b) == want and len(b) == groups
    a, b = by["repeats"]
    gone = {d: removed for d, _, removed, _, _ in repeats([(r["doc_id"], r["text"]) for r in a], 200)}
    before = {r["doc_id"]: r["text"] for r in a}
    assert len(b) == len(a) and all(r["n_chars"] == len(r["text"]) for r in b)
    assert all((r["text"] == before[r["doc_id"]]) == (gone[r["doc_id"]] == 0) for r in b)
    assert all(0 <= len(before[r["doc_id"]].encode()) - gone[r["doc_id"]] - len(r["text"].encode()) <= 6 * (gone[r["doc_id"]] > 0) * 200 for r in b)
    a, b = by["benchmark"]
    bench = [tuple(r) for r in table(spark, sf, "benchmark").select("item_id", "text").collect()]
    bad = {h[0] for h in hits([(r["doc_id"], r["text"]) for r in a], bench) if h[2]}
    assert not any(h[2] for h in hits([(r["doc_id"], r["text"]) for r in b], bench))
    assert sorted(r["doc_id"] for r in b) == sorted(r["doc_id"] for r in a if r["doc_id"] not in bad)
    a, b = by["packing"]
    assert {r["doc_id"] for r in a} == {r["doc_id"] for r in b}
    assert {(r["doc_id"], r["doc_tokens"]) for r in b} == {(d, sum(r["length"] for r in b if r["doc_id"] == d)) for d in {r["doc_id"] for r in b}}
    assert pipe.run(spark, sf).count() == len(b)


def test_pipeline_edges(spark, tmp_path):
    """Nulls in every column, empty and repeated rows, own columns with the stages' names; then empty tables."""
    import corpus_pipeline as pipe

    marks = labels(spark, SOME)
    marks.write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "not anywhere in these texts at all but thirteen words long and more so"), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (frame(spark), frame(spark, empty=True)):
        docs = docs.withColumns({c: F.lit(1) for c in ("__id", "__th", "__n", "__key", "item_id", "hit")})
        for name, stage in pipe.STAGES:
            out = stage(spark, docs, f"file://{tmp_path}")
            if name == "packing":
                assert out.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
            else:
                assert out.dtypes == docs.dtypes, name
                docs = simhash.written(out)
