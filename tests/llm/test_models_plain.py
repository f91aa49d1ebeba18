"""The classifiers' parts against plain Python versions: features, the fit of the ranking, its cut, trees, the isotonic curve, calibration."""

import math
import os
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.llm import features, quality, toxicity

SF = "/root/testdata/sf0.1"


def plain_features(text):
    """quality_features of one ASCII text, value by value."""
    groups = {"upper": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "lower": "abcdefghijklmnopqrstuvwxyz", "digit": "0123456789", "blank": " \t", "line": "\n\r\x0b\x0c", "stop": ".,;:'\"-()", "shout": "!?", "sign": "#$%&*+/<=>@[\\]^_`{|}~"}
    size = max(len(text), 1)
    out = {f"share_{n}": sum(c in g for c in text) / size for n, g in groups.items()}
    out |= {"share_high": 0.0, "share_control": 0.0}
    words = text.lower().split()
    raw, n = text.split(), max(len(words), 1)
    count = Counter(text)
    mean = sum(map(len, words)) / n
    signs = [sum(c in groups["sign"] + groups["shout"] for c in w) for w in raw]
    pairs, fives = list(zip(words, words[1:], strict=False)), list(zip(*(words[k:] for k in range(5)), strict=False))
    share = lambda x: len(set(x)) / len(x) if x else 1.0
    distinct = share(words)
    out |= {
        "log_bytes": math.log1p(len(text)), "log_words": math.log1p(len(words)), "entropy": -sum(c / size * math.log2(c / size) for c in count.values()), "word_mean": mean,
        "word_spread": math.sqrt(max(sum(len(w) ** 2 for w in words) / n - mean**2, 0)), "loud_words": sum(any(c.isupper() for c in w) and not any(c.islower() for c in w) for w in raw) / n,
        "signed_words": sum(s > 0 for s in signs) / n, "bare_signs": sum(s == len(w) for s, w in zip(signs, raw, strict=True)) / n, "distinct_words": distinct, "top_word": max(Counter(words).values(), default=0) / n,
        "repeated_word": sum(a == b for a, b in pairs) / n, "distinct_pairs": share(pairs), "distinct_fives": share(fives), "top_five": max(Counter(fives).values(), default=0) / max(len(fives), 1),
        "distinct_by_log": distinct * math.log1p(len(words)), "words_a_line": math.log1p(len(words) / (sum(c in groups["line"] for c in text) + 1)), "words_a_stop": math.log1p(len(words) / (sum(c in groups["stop"] for c in text) + 1)),
        "long_words": sum(len(w) > 20 for w in words) / n, "short_words": sum(len(w) < 3 for w in words) / n,
    }
    return [out[k] for k in features.QUALITY_NAMES]


def test_features_equal_plain_ones():
    rng = random.Random(4)
    pieces = ["word", "Word", "WORD", "a", "12", "x1", "!!", "#tag", "a#b", "end.", "averyveryverylongwordindeed", "a", "a", "\n", "(so)"]
    texts = ["", " ", "one", "a a a a a a a"] + [" ".join(rng.choices(pieces, k=rng.randint(1, 40))) for _ in range(60)]
    buf = np.frombuffer("".join(texts).encode(), np.uint8)
    got = features.quality_features(buf, np.concatenate(([0], np.cumsum([len(t) for t in texts]))))
    for row, t in zip(got, texts, strict=True):
        assert np.allclose(row, plain_features(t), atol=1e-9), (t, dict(zip(features.QUALITY_NAMES, zip(row, plain_features(t), strict=True), strict=True)))


def test_ranking_is_where_the_loss_is_least_and_the_cut_where_errors_are():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, len(features.QUALITY_NAMES)))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + rng.normal(0, 0.5, 300) > 0.3).astype(int)
    model = quality.fit(x, y, pairs=2000)
    b = model.basis(x)
    draw = np.random.default_rng(7)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    won, lost = draw.choice(good, 2000), draw.choice(bad, 2000)

    def loss(w):
        return sum(math.log1p(math.exp(-(b[i] - b[j]) @ w)) for i, j in zip(won, lost, strict=True)) / 2000 + 0.5e-3 * w @ w

    least = loss(model.weights)
    for _ in range(25):
        assert loss(model.weights + rng.normal(0, 0.02, len(model.weights))) >= least - 1e-9
    s = model.strengths(x)
    errors = lambda c: sum((s >= c) != (y == 1))
    assert errors(model.cut) == min(errors(c) for c in np.concatenate((s, [s.max() + 1, model.cut])))
    assert ((model.scores(x) >= 0.5) == (s >= model.cut)).all()


def test_first_tree_splits_where_an_exhaustive_search_does():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 3)).round(1)
    y = ((x[:, 1] > 0.2) ^ (rng.random(120) < 0.1)).astype(float)
    forest = toxicity.grow(x, y)
    p = y.mean()
    best = (0, None)
    for j in range(3):
        for t in np.unique(np.quantile(x[:, j], np.linspace(0, 1, toxicity.BINS + 1)[1:-1])):
            left = x[:, j] <= t
            if min(left.sum(), (~left).sum()) < toxicity.LEAST_LEAF:
                continue
            part = lambda m: (p - y[m]).sum() ** 2 / (m.sum() * p * (1 - p) + 1)
            gain = part(left) + part(~left) - part(np.ones(120, bool))
            if gain > best[0] + 1e-12:
                best = (gain, (j, t))
    assert (int(forest.feature[0][0]), float(forest.threshold[0][0])) == best[1]
    # each row goes down each tree by itself
    for row in range(0, 120, 11):
        total = forest.start
        for f, t, v in zip(forest.feature, forest.threshold, forest.leaf, strict=True):
            node = 0
            while node < len(f):
                node = 2 * node + 1 + int(x[row, f[node]] > t[node])
            total += v[node - len(f)]
        assert abs(total - forest.margins(x[row : row + 1])[0]) < 1e-9


def test_isotonic_equals_its_minimax_form():
    rng = np.random.default_rng(6)
    for _ in range(20):
        x = rng.integers(0, 12, 30).astype(float)
        y = rng.integers(0, 2, 30).astype(float)
        px, py = toxicity.isotonic(x, y)
        xs = np.unique(x)
        mean = lambda a, b: y[(x >= a) & (x <= b)].mean()
        for v in xs:
            want = max(min(mean(a, b) for b in xs[xs >= v]) for a in xs[xs <= v])
            assert abs(np.interp(v, px, py) - want) < 1e-9


def test_toxicity_labels_of_held_out_rows_change_nothing(spark):
    docs = spark.createDataFrame([(i, ("you nasty fool go away " * 4 if i % 3 == 0 else "a calm plain sentence here ") + str(i)) for i in range(150)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 3 == 0).cast("int").alias("toxic"))
    flipped = labels.withColumn("toxic", F.when(toxicity.training(F.col("doc_id")), F.col("toxic")).otherwise(1 - F.col("toxic")))
    a, b = (toxicity.score(docs, toxicity.learn(docs, x, "toxic", toxicity.training)).orderBy("doc_id").collect() for x in (labels, flipped))
    assert a == b


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_toxicity_is_calibrated_on_held_out_rows(spark):
    got = toxicity.op10_toxicity(spark, SF).where("held_out").join(spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "toxic"), "doc_id").toPandas()
    p, y = got["score"].to_numpy(), got["toxic"].to_numpy(float)
    rate = y.mean()
    brier = ((p - y) ** 2).mean()
    assert brier < 0.35 * rate * (1 - rate)
    # mean score against the share of toxic rows, over all and in the two halves of the scale
    assert abs(p.mean() - rate) < 0.02
    for part in (p < 0.5, p >= 0.5):
        assert abs(p[part].mean() - y[part].mean()) < 0.15
    print("brier", round(float(brier), 4), "rate", round(float(rate), 4), "mean", round(float(p.mean()), 4))
