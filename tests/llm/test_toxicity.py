import numpy as np
import zlib

from ideolens.llm import toxicity as T

BAD = ["grobniz", "flurkel", "snotter", "wretchix"]


def corpus(spark, prose, n=700):
    docs, labels = [], []
    for i in range(n):
        toxic = i % 6 == 0
        w = prose(i, 20 + (i * 37) % 200).split()
        if toxic:
            for k in range(3):
                w.insert((i * (k + 3)) % len(w), BAD[(i // 6 + k) % 4] + ("" if k else "ish"))
        docs.append((i, " ".join(w)))
        if i * 7919 % 10 < 6:
            labels.append((i, int(toxic)))
    return docs, labels


def test_held_out_documents(spark, prose):
    docs, labels = corpus(spark, prose)
    out = T.score(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in out)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out)
    out = [r for r in out if r["held_out"]]
    right = [r["predicted"] == (r["doc_id"] % 6 == 0) for r in out]
    assert len(out) > 100 and sum(right) / len(right) > 0.97


def test_labels_of_held_out_rows_do_not_matter(spark, prose):
    docs, labels = corpus(spark, prose, 300)
    other = [(i, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, t in labels]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    a, b = ({r["doc_id"]: r["score"] for r in T.score(frame, spark.createDataFrame(x, "doc_id long, toxic int")).collect()} for x in (labels, other))
    assert a == b


def test_risk_is_corrected_for_the_prior():
    """U holds toxic rows too; a feature of all P and of a share pi of U must still count as toxic."""
    rng = np.random.default_rng(1)
    n_p, n_u, pi = 400, 2000, 0.3
    hidden = rng.random(n_u) < pi
    rows_u = np.flatnonzero(hidden)
    noise_p, noise_u = np.flatnonzero(rng.random(n_p) < 0.5), np.flatnonzero(rng.random(n_u) < 0.5)
    w, b = T.fit_nnpu(np.concatenate((np.arange(n_p), noise_p)), np.concatenate((np.zeros(n_p, int), np.ones(len(noise_p), int))), n_p,
                      np.concatenate((rows_u, noise_u)), np.concatenate((np.zeros(len(rows_u), int), np.ones(len(noise_u), int))), n_u,
                      np.zeros(2), pi)
    assert w[0] + b + min(w[1], 0) > 0 and b + max(w[1], 0) < 0


def test_odd_rows(spark, clashing, empty, prose):
    labels = spark.createDataFrame([(1, 1, 5), (1, 0, 5), (None, 1, 5), (2, None, 5), (8, 0, 5), (77, 1, 5)], "doc_id long, toxic int, text int")
    out = T.score(clashing, labels)
    assert out.count() == clashing.count() and set(clashing.columns) <= set(out.columns)
    assert out.where("score is null or predicted is null or held_out is null").count() == 0
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [r["predicted"] for r in T.score(clashing, none).collect()] == [0] * clashing.count()
    assert T.score(empty, labels).count() == 0


def test_repeated_rows_score_alike(spark, prose):
    docs, labels = corpus(spark, prose, 200)
    frame = spark.createDataFrame(docs + docs[:20], "doc_id long, text string")
    out = T.score(frame, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    assert len(out) == 220 and len({(r["doc_id"], r["score"]) for r in out}) == 200


def test_a_hot_row_or_id_does_not_fill_the_sample(spark, prose, monkeypatch):
    """Copies of one row leave the model as it is; an id with many texts gives the sample no
    more rows than its bounds."""
    docs, labels = corpus(spark, prose, 300)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int")
    hot = next(i for i, t in labels if t)
    once, often = (T.train(spark.createDataFrame(d, "doc_id long, text string"), marks) for d in (docs, docs + [docs[hot]] * 400))
    assert len(once.hashes) and (once.hashes == often.hashes).all() and np.allclose(once.weights, often.weights, atol=1e-6)
    monkeypatch.setattr(T, "MAX_TOXIC", 60)
    monkeypatch.setattr(T, "MAX_UNLABELLED", 120)
    sizes = []
    fit = T.fit_nnpu
    monkeypatch.setattr(T, "fit_nnpu", lambda *a: sizes.append((a[2], a[5])) or fit(*a))
    many = docs + [(hot, docs[hot][1] + f" tail{i}") for i in range(600)]
    T.train(spark.createDataFrame(many, "doc_id long, text string"), marks)
    assert 30 < sizes[0][0] < 100 and 70 < sizes[0][1] < 180
