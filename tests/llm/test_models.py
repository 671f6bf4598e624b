import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from omiclattice.llm import learning, lm_scores, pii, quality, topk, toxicity
from oracle import compare, connect

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.1"


def test_votes_find_reliable_labellers():
    rng = np.random.default_rng(2)
    truth = rng.random(20_000) < 0.7
    right = np.array([0.95, 0.9, 0.6, 0.8])
    votes = np.where(rng.random((20_000, 4)) < right, 1, -1) * np.where(truth, 1, -1)[:, None] * (rng.random((20_000, 4)) < 0.8)
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = learning.Votes(patterns, counts.astype(float), against=1.0)
    assert abs(model.share - 0.7) < 0.05 and list(np.argsort(-model.odds[:, 2])) == [0, 1, 3, 2]
    best = votes @ np.log(right / (1 - right)) + np.log(0.7 / 0.3) > 0  # with the true reliabilities
    assert ((model.posterior(votes) > 0.5) == truth).mean() > (best == truth).mean() - 0.005


def test_quality_finds_bad_texts_and_keeps_good_ones(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text")
    truth = spark.read.parquet(f"{LARGER}/labels.parquet").select("doc_id", F.col("quality").alias("truth"))
    got = quality.scored(docs, quality.fit(docs)).join(truth, "doc_id").groupBy("truth").agg(F.avg((F.col("quality") >= 0.5).cast("double")).alias("kept")).collect()
    kept = {r.truth: r.kept for r in got}
    assert kept[1] > 0.99 and kept[0] < 0.05


def test_quality_of_odd_documents(odd_docs, no_docs):
    docs = odd_docs.drop("quality")
    model = quality.fit(docs)
    got = quality.scored(docs, model).collect()
    assert len(got) == 13 and all((r.quality == 0) == (not (r.text or "").strip()) for r in got)
    assert quality.scored(no_docs.drop("quality"), quality.fit(no_docs)).count() == 0
    with pytest.raises(ValueError):
        quality.scored(odd_docs, model)


def test_toxicity_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{LARGER}/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(3)) == 0
    model = toxicity.fit(docs, labels.where(~held))
    got = toxicity.severity(docs, model).join(labels.where(held).select("doc_id", F.col("toxic").alias("truth")), "doc_id").toPandas()
    assert got[got.truth > 0].toxic.mean() > 0.85 and got[got.truth == 0].toxic.mean() < 0.01
    assert got[got.truth > 0].severity.mean() > 4 * got[got.truth == 0].severity.mean()
    assert {1, 2} <= set(got[got.truth > 0].grade) and (got[got.truth == 0].grade == 0).mean() > 0.99


def test_thresholds_share_weights_and_stay_ordered():
    rng = np.random.default_rng(1)
    bad = np.maximum(0, rng.integers(-20, 8, 3000))  # so many of a row's words are bad ones
    grade = np.digitize(bad, [1, 5])
    row = np.repeat(np.arange(3000), 2)
    slot, value = np.tile([0, 1], 3000), np.sqrt(np.stack([bad / 10, 1 - bad / 10], 1)).ravel()
    row, slot, value = row[value > 0], slot[value > 0], value[value > 0]
    model = toxicity.fit_grades(row, slot, value, grade, 3, rounds=600)
    s = np.bincount(row, value * model["weights"][slot], 3000)
    assert model["cuts"][0] < model["cuts"][1] and (np.digitize(s, model["cuts"]) == grade).mean() > 0.85


def test_toxicity_of_odd_documents(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 0), (6, 1), (3, 1), (9, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.severity(odd_docs, toxicity.fit(odd_docs, labels)).collect()
    assert len(got) == 13 and all(r.severity == 0 and not r.toxic for r in got if r.doc_id in (3, 4, 5))
    assert toxicity.severity(no_docs, toxicity.fit(no_docs, labels)).count() == 0


def brute_spans(t):
    def luhn(d):
        s = 0
        for i, c in enumerate(reversed(d)):
            x = int(c) * (1 + i % 2)
            s += x - 9 * (x > 9)
        return s % 10 == 0

    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", *m.span()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 13 <= len(d := re.sub("[^0-9]", "", m[0])) <= 19 and luhn(d)]
    return out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_equal_the_patterns():
    rng = random.Random(5)
    for _ in range(8000):
        t = "".join(rng.choice("a@.1 +-(25.5@.x0é") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(t) == brute_spans(t)
    for t in ("1" * 200_000, "a" * 200_000 + "@" + "b" * 200_000, "@" * 50_000, "+1 " * 50_000, "1." * 100_000):
        pii.base_spans(t)  # linear time


def test_personal_data_of_odd_documents(odd_docs, no_docs):
    model = pii.fit(odd_docs)
    got = {r.doc_id: r for r in pii.find(odd_docs, model).collect()}
    assert (got[9].n_email, got[9].n_phone) == (1, 1) and got[3].spans == got[4].spans == ""
    assert got[3].base_sha256 == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"
    text = odd_docs.where("doc_id = 9").first().text
    assert [text[int(a):int(b)] for _, a, b in (s.split(":") for s in got[9].spans.split(","))] == ["a.b@c.example.org", "+1 (743) 555-3824"]
    masked = {r.doc_id: r for r in pii.masked(odd_docs, model).collect()}
    assert masked[9].text.endswith("mail [EMAIL] [PHONE]") and masked[9].n_chars == len(masked[9].text) and masked[3].text is None and masked[4].text == ""
    assert pii.find(no_docs, pii.fit(no_docs)).count() == 0 and pii.masked(no_docs, model).count() == 0


def test_weak_labels_add_secrets_and_no_plain_numbers(spark):
    docs = spark.read.parquet(f"{LARGER}/documents.parquet").select("doc_id", "text")
    got = pii.find(docs, pii.fit(docs)).join(docs, "doc_id").where("text like '%token = \"%'").limit(50).collect()
    assert got and all("secret:" in r.spans for r in got)


def test_top_k_of_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, float("nan")]), (2, None), (3, []), (4, [3.0, -1.0]), (5, [3.0, -1.0]), (None, [9.0, 9.0]), (6, [1.0, None]), (7, [1.0, 2.0, 3.0]), (8, [float("inf"), 0.0]), (9, [-0.001, 0.0]), (9, [-0.001, 0.0])]
    table = spark.createDataFrame([(i, v, "e") for i, v in rows], "vec_id long, embedding array<float>, block string")
    got = [tuple(r) for r in topk.top_k(table, F.col("vec_id").isin(0, 4, 7), k=3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 4, 65536), (0, 2, 5, 65536), (0, 3, 9, -256), (4, 1, 5, 655360), (4, 2, 0, 65536), (4, 3, 9, -768)]
    assert topk.top_k(table.where("false"), F.lit(True)).count() == 0


def test_threshold_algorithm_stops_early_and_is_exact():
    rng = np.random.default_rng(3)
    data = rng.integers(-9, 10, (500, 4)).astype(float)
    order, ids = np.argsort(-data, axis=0, kind="stable"), rng.permutation(500)
    for _ in range(60):
        q = rng.integers(-3, 4, 4).astype(float)
        want = sorted(((-int(s), int(i)) for s, i in zip(data @ q, ids) if i != 7))[:5]
        assert [(-s, i) for s, i in topk.threshold_top(data, order, ids, q, 7, 5)] == want


@pytest.mark.parametrize("hot, part", [(200_000, 400_000), (30, 50)])
def test_scores_equal_sql(spark, hot, part, monkeypatch):
    monkeypatch.setattr(lm_scores, "HOT", hot)  # few frequent words: most counts are joined
    ok, message, _, _ = compare(spark, connect(SF), "lm", lm_scores.query, lm_scores.SQL, SF)
    assert ok, message


def test_scores_of_odd_documents(odd_docs, no_docs):
    got = {r.doc_id: r for r in lm_scores.score(odd_docs).collect()}
    assert sorted(got) == [-11, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10]
    assert (got[4].n_words, got[4].sum_logprob, got[4].mean_logprob) == (0, 0, None) and got[2].n_words == 2 * got[1].n_words
    assert got[8].n_words == 1 and got[8].sum_logprob < 0
    assert lm_scores.score(no_docs).count() == 0


def test_pipeline_stages(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        at = docs
        for name, stage in corpus_pipeline.STAGES[:-1]:
            at = stage(spark, at, SF)
            assert at.columns == docs.columns, name
        assert {"sequence_id", "offset"} <= set(corpus_pipeline.STAGES[-1][1](spark, at, SF).columns)
    kept = {r.doc_id for r in corpus_pipeline.keep_distinct(spark, odd_docs, SF).collect()}
    assert kept == {-11, 3, 4, 5, 6, 8, 9, 10, None}


def test_pipeline_on_the_test_tables(spark):
    folder = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    got = corpus_pipeline.run(spark, folder).collect()
    kept = {r.doc_id for r in got}
    bad = [d for d, q in labels.items() if q == 0]
    assert sum(d in kept for d in bad) <= 0.1 * len(bad) and len(kept) > 0.6 * docs.count()
