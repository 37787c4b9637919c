import numpy as np
from genoframe.llm import toxicity
from genoframe.llm.toxicity import fit, fit_toxicity, score_toxicity, train


def corpus(n, seed):
    rng = np.random.default_rng(seed)
    calm = ["river", "stone", "garden", "letter", "window", "morning", "paper", "silver", "and", "the", "of"]
    rude = ["stupid", "worthless", "idiot"]
    texts, labels = [], []
    for k in range(n):
        ws = list(rng.choice(calm, int(rng.integers(5, 150))))
        bad = k % 5 == 0
        for w in rng.choice(rude, 3) if bad else []:
            ws.insert(int(rng.integers(0, len(ws))), w)
        texts.append(" ".join(ws))
        labels.append(int(bad))
    return texts, labels


def test_held_out_and_misspelt():
    model = fit(*corpus(600, 1))
    texts, labels = corpus(300, 2)
    got = [int(model.score(t) >= 0.3) for t in texts]
    assert np.mean(np.array(got) == labels) > 0.98
    assert model.score("the river and stupiid idiott worthles of the garden") > 0.3
    assert model.score("river stone garden") < 0.3
    assert model.score(None) == model.score("") < 0.3
    assert model.score("river " * 50_000 + "stupid idiot worthless" + " river" * 50_000) > 0.3


def test_one_class_or_no_labels():
    assert train([], []).score("x") < 0.01
    assert train(["a", "b"], [1, 1]).score("x") > 0.99


def test_spark_rows(spark):
    texts, labels = corpus(200, 3)
    docs = spark.createDataFrame(
        [*enumerate(texts), (900, None), (901, ""), (None, "stupid idiot"), (0, texts[0])], "doc_id long, text string"
    ).selectExpr("*", "'mine' as score", "array(1) as h", "5 as y")
    known = spark.createDataFrame([*enumerate(labels), (None, 1), (5, None), (5000, 1)], "doc_id long, toxic int")
    model = fit_toxicity(docs, known)
    out = score_toxicity(docs, model)
    assert out.columns == ["doc_id", "text", "score", "h", "y", "predicted"]
    rows = out.collect()
    assert len(rows) == 204 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert {r.score for r in rows if not r.text} == {model.score("")}
    assert fit_toxicity(docs, known.limit(0)).score("stupid") < 0.01
    assert score_toxicity(docs.limit(0), model).count() == 0


def test_scores_of_many_texts_are_those_of_plain_sums(monkeypatch):
    rng = np.random.default_rng(5)
    pool = ["a", "stupid", "ß漢é", "x" * 300, "a*b", "st*pid", "1a", *("".join(rng.choice(list("abcdefgh"), int(n))) for n in rng.integers(1, 12, 400))]
    texts = [None, "", "12 7", *(" ".join(rng.choice(pool, int(n))) for n in rng.integers(1, 90, 60))]
    weight = (rng.normal(size=toxicity.BUCKETS) * (rng.random(toxicity.BUCKETS) < 0.6)).astype(np.float32)
    model = toxicity.ToxicityModel(weight, -0.5)

    def of_word(w):
        known = [float(weight[b]) for b in toxicity.buckets_of(w) if weight[b]]
        return sum(known) / max(1, len(known))

    def plain(text):
        words = toxicity.words_of(text)
        at = [*toxicity._passages(len(words)), len(words)]
        sums = [sum(map(of_word, set(words[a:b]))) / (b - a) for a, b in zip(at, at[1:]) if b > a]
        return 1 / (1 + np.exp(0.5 - max(sums, default=0.0)))

    wanted = [plain(t) for t in texts]
    # Buckets of words are made for many words together, whatever is remembered, and texts are scored together.
    monkeypatch.setattr(toxicity, "buckets_of", None)
    for words, chars in ((100_000, 500_000), (50, 700)):
        monkeypatch.setattr(toxicity, "CACHE_WORDS", words)
        monkeypatch.setattr(toxicity, "CHARS_AT_ONCE", chars)
        assert np.allclose(toxicity.ToxicityModel(weight, -0.5).scores(texts), wanted, rtol=0, atol=1e-12)
    assert model.score(texts[5]) == model.scores(texts)[5]
