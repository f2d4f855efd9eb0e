import numpy as np
import pytest

from loomline.llm import quality, toxicity


def quality_rows():
    r = np.random.default_rng(0)
    good = [" ".join(f"word{int(x)}" for x in r.integers(0, 500, 80)) + "." for _ in range(120)]
    bad = [" ".join(f"word{int(x)}%%%" for x in r.integers(0, 500, 80)) for _ in range(120)]
    return [(i, t, i % 2) for i, pair in enumerate(zip(bad, good, strict=True)) for t in pair for i in [2 * i + (t in good)]]


def test_rules_separate_and_compile_to_the_same_scores(spark):
    rows = quality_rows()
    docs = spark.createDataFrame([(i, t, 0.0, "q") for i, t, _ in rows] + [(900, None, 1.0, None), (901, "", 2.0, ""), (None, "x", 0.0, "")], "doc_id long, text string, score double, quality string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = {x.doc_id: x for x in quality.quality(docs, labels).collect()}
    assert len(got) == len(rows) + 3 and all(0 <= x.score <= 1 for x in got.values())
    assert np.mean([got[i].predicted == y for i, _, y in rows if got[i].held_out]) > 0.95
    model = quality.train(docs, labels)
    assert model.rules and len(model.rules) < 120
    table = docs.select("doc_id", quality.statistics(docs.text).alias("x")).collect()
    want = model.score(np.array([r.x for r in table]))
    assert np.allclose(want, [got[r.doc_id].score for r in table], atol=1e-9)
    assert np.isfinite([r.x for r in table]).all()
    kept = quality.drop_rejected(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(x.score >= quality.THRESHOLD for x in got.values())


def test_quality_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert [x.score for x in quality.quality(docs, none).collect()] == [0.5, 0.5]
    assert quality.quality(docs.limit(0), none).count() == 0


def test_counterfactual_penalty_spares_identity_terms():
    r = np.random.default_rng(1)
    rows, y = [], []
    for i in range(600):
        toxic = i % 4 == 0
        words = [f"w{int(x)}" for x in r.integers(0, 300, 25)]
        if toxic:
            words += ["nasty"] * 3
        if r.random() < (0.7 if toxic else 0.05):  # in this sample one group is named in bad company
            words.append("muslim")
        rows.append(" ".join(words))
        y.append(float(toxic))
    both = [toxicity.features(t) for t in rows]
    fitted = [toxicity.fit(np.array(y), [np.array(h, np.int32) for h, _ in both], [c for _, c in both], fairness=f) for f in (0.0, 50.0)]
    weight = [sum(abs(m.weights.get(j, 0.0)) for j in toxicity.leveled({b"muslim": 1})) for m in fitted]
    assert weight[0] > 0.5 and weight[1] < 0.25 * weight[0]


def test_toxicity_scores_whole_texts(spark):
    r = np.random.default_rng(2)
    text = lambda bad: " ".join([f"w{int(x)}" for x in r.integers(0, 200, 40)] + ["Nasty,", "nasty"] * bad)
    rows = [(i, text(i % 3 == 0), int(i % 3 == 0)) for i in range(400)]
    far = " ".join(["w1"] * 60_000) + " nasty nasty"
    docs = spark.createDataFrame([(i, t, "en") for i, t, _ in rows] + [(900, far, ""), (901, None, None), (902, "", ""), (None, "nasty nasty", "")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (5, None)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == 404
    assert all(got[i].predicted == y for i, _, y in rows)
    assert got[900].predicted == 1 and got[None].predicted == 1 and got[901].score == got[902].score < 0.5
    none = labels.limit(0)
    assert {x.score for x in toxicity.toxicity(docs, none).collect()} == {0.5}
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


def named_rows():
    """Toxic texts that often name one group, and clean ones that seldom do: a sample whose company misleads."""
    r = np.random.default_rng(4)
    rows = []
    for i in range(900):
        toxic = i % 3 == 0
        w = [f"w{int(x)}" for x in r.integers(0, 300, 20)] + (["nasty"] * int(r.integers(1, 3)) if toxic and r.random() < 0.8 else [])
        if r.random() < (0.9 if toxic else 0.02):
            w.append(["muslims", "Musulmans"][i % 2])
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_neutral_mentions_are_spared_at_the_shipped_penalty(spark):
    rows = named_rows()
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    r = np.random.default_rng(5)
    clean = [" ".join(f"w{int(x)}" for x in r.integers(0, 300, 20)) for _ in range(150)]
    extra = [(2000 + i, t + " muslims", None) for i, t in enumerate(clean)] + [(3000 + i, t + " christians", None) for i, t in enumerate(clean)] + [(4000 + i, t + " nasty nasty muslims", None) for i, t in enumerate(clean)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows + extra], "doc_id long, text string")
    wrong, caught, gap = [], [], []
    for fairness in (0.0, toxicity.FAIRNESS):
        got = {x.doc_id: x for x in toxicity.toxicity(docs, labels, fairness=fairness).collect()}
        wrong.append(sum(got[2000 + i].predicted for i in range(150)))
        caught.append(sum(got[4000 + i].predicted for i in range(150)))
        gap.append(np.mean([abs(got[2000 + i].score - got[3000 + i].score) for i in range(150)]))
    assert wrong[0] > 30 and wrong[1] <= wrong[0] / 10
    assert caught[1] >= 0.9 * 150
    assert gap[1] < gap[0] / 10
    model = toxicity.train(docs, labels)
    assert model.swapped > 100 and toxicity.train(docs, labels, groups={}).swapped == 0


def test_scores_are_those_of_the_features(spark):
    rows = named_rows()[:200]
    docs = spark.createDataFrame([(i, t, 0.5, "x", 7) for i, t, _ in rows] + [(5, "again nasty", 0.1, "y", 8), (900, None, 0.0, "", 0)], "doc_id long, text string, score double, toxic string, y int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = toxicity.toxicity(docs, labels).collect()
    want = [1 / (1 + np.exp(-model.logit(toxicity.features(t)[0]))) for t in [t for _, t, _ in rows] + ["again nasty", None]]
    assert len(got) == 202 and np.allclose(sorted(x.score for x in got), sorted(want), atol=1e-12)


def test_fits_are_bounded_where_ids_repeat(spark):
    docs = spark.createDataFrame([(2, f"text {i} nasty") for i in range(50)] + [(4, "fine words")], "doc_id long, text string")
    labels = spark.createDataFrame([(2, 1), (2, 1), (4, 0)], "doc_id long, toxic int")
    assert [x.score for x in toxicity.toxicity(docs, labels, fit_rows=3).select("score").limit(1).collect()]
    q = labels.withColumnRenamed("toxic", "quality")
    assert quality.quality(docs, q, fit_rows=3).count() == 51


def test_groups_hold_plurals_and_four_languages():
    swaps = toxicity.swaps_of(toxicity.IDENTITY)
    assert b"christians" in swaps[b"muslims"] and "juifs".encode() in swaps[b"musulmans"] and b"juden" in swaps[b"muslime"]
    assert b"muslims" not in swaps[b"muslims"] and not set(swaps[b"muslime"]) & {b"christians"}


@pytest.mark.parametrize("word", ["a", "äöü", "longerword"])
def test_beginnings_are_cut_by_letters(word):
    assert len(toxicity.buckets(word.encode())) == 1 + sum(len(word) > k for k in toxicity.PREFIXES)
