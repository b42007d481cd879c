import math
import random
import zlib
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import language, language_model, quality, toxicity
from tessera.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"
MIDDLE = "/root/testdata/sf0.01"
ODD = [(None, "a b c"), (5000, None), (5001, ""), (5002, " \n"), (5003, "x"), (5003, "x"), (5004, "&&& 123 !!"), (5005, "Ж"), (5006, "w " * 60_000)]


def _tokens(text):
    return brute.SPACED.findall(brute.fold(text)) + [None]


def _base(rows):
    part = lambda d: None if d is None else zlib.crc32(str(d).encode()) % 7
    counts = Counter(w for d, t in rows if part(d) not in (None, 2) for w in _tokens(t))
    n, v = sum(counts.values()), len(counts)
    return [
        (str(d), part(d) == 2, len(w := _tokens(t)), sum(counts[x] > 0 for x in w), n, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        for d, t in rows
    ]


def test_language_model_counts_and_gain(documents, sample):
    rows = sample + ODD
    got = language_model.score_documents(documents(rows)).collect()
    key = lambda r: (r[0], r[2], r[5])
    mine = sorted(((str(r[0]), *r[1:6]) for r in got), key=key)
    want = sorted(_base(rows), key=key)
    assert [m[:5] for m in mine] == [w[:5] for w in want]
    assert [m[5] for m in mine] == pytest.approx([w[5] for w in want])
    assert all(r["score"] < 0 for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert language_model.score_documents(documents([])).count() == 0


def test_class_probabilities_sum_to_one():
    import numpy as np

    model = language_model.ClassModel(np.zeros(language_model.CLASSES))
    model.weights += np.random.default_rng(1).standard_normal(model.weights.shape).astype(np.float32)
    rows = np.array([[1, 2, 3, 4]] * language_model.CLASSES, np.int32)
    total = np.exp(model.log_probability(rows, np.arange(language_model.CLASSES))).sum()
    assert total == pytest.approx(1, abs=1e-5)


def _labels(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int").selectExpr("*", "'l' as text", "0 as score")


def _held_out(spark, name, label, threshold):
    found = QUERIES[name](spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id").filter("held_out")
    return found.groupBy().agg(
        F.avg((F.col(label) == (F.col("score") >= threshold).cast("int")).cast("int")).alias("right"),
        F.avg(F.when(F.col(label) == 1, (F.col("score") >= threshold).cast("int"))).alias("found"),
    ).first()


@pytest.mark.parametrize("name,label,threshold", [("op4_toxicity", "toxic", 0.5), ("op10_quality_classifier", "quality", 0.3)])
def test_held_out_accuracy(spark, name, label, threshold):
    r = _held_out(spark, name, label, threshold)
    assert r["right"] > 0.93 and r["found"] > (0.6 if label == "toxic" else 0.97)


def test_language_accuracy(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    found = QUERIES["op7_language_id"](spark, MIDDLE).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98


def test_odd_rows(spark, documents, sample):
    rows = sample[:60] + ODD
    labels = _labels(spark, [(d, d % 2, d % 3 // 2) for d, _ in sample[:60]] + [(None, 1, 1), (1, 1, None), (2, None, 1), (9999, 1, 1), (3, 1, 1), (3, 1, 1)])
    for scored in (toxicity.toxicity(documents(rows), labels), quality.quality_scores(documents(rows), labels)):
        got = scored.collect()
        assert sorted(str(r["doc_id"]) for r in got) == sorted(str(d) for d, _ in rows)
        assert all(0 <= r["score"] <= 1 for r in got)
        assert {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    for run in (toxicity.toxicity, quality.quality_scores):
        assert run(documents([]), labels).count() == 0
        assert run(documents(rows), labels.limit(0)).count() == len(rows)
    left = quality.keep_good(documents(rows), labels, threshold=0.0)
    assert left.count() == len(rows) and left.columns == documents(rows).columns


def test_languages_of_odd_rows(documents):
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.identify(documents(ODD)).collect()}
    for d in (5000, 5001, 5002, 5004):
        assert got[d] == ("und", 0.0)
    assert got[5005][0] == "en" and got[5003][0] == "en"
    assert language.identify(documents([])).count() == 0


def test_a_rare_language_is_learned_from_a_large_table(spark):
    """Three documents of a language among 21,000, none of them in a thinned share of the ids."""
    rare = [d for d in range(30_000, 31_000) if zlib.crc32(str(d).encode()) % 4 != 2]
    thin = {r[0] for r in spark.range(30_000, 31_000).filter("pmod(xxhash64(id, 3), 2) = 0").collect()}
    rare = [d for d in rare if d not in thin][:3]
    common = spark.range(29_000).selectExpr("id as doc_id", "'the quick brown fox' as text", "'en' as lang")
    docs = common.unionByName(spark.createDataFrame([(d, "zxq qzx xqz zzx", "xx") for d in rare], "doc_id long, text string, lang string"))
    assert language.fit(docs)[0] == ["en", "xx"]
    assert {r["lang_pred"] for r in language.identify(docs).filter(F.col("doc_id").isin(rare)).collect()} == {"xx"}


def test_automaton_equals_edit_distance():
    import random

    import numpy as np

    from tessera.llm.words import Words

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            before, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        return row[-1]

    rng = random.Random(4)
    terms = [("".join(rng.choice("abc") for _ in range(rng.randint(2, 8)))) for _ in range(30)]
    begins = ["cab", "bbcc"]
    lexicon = [(b"=" + t.encode(), 1.0 + i) for i, t in enumerate(terms)] + [(b"^" + t.encode(), 100.0) for t in begins]
    automaton = toxicity.LexiconAutomaton(lexicon)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randint(1, 9))) for _ in range(400)] + terms
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    exact, fuzzy = automaton.weigh(Words(data, np.array([0, len(data)])))
    for w, e, f in zip(words, exact, fuzzy):
        want = max([1.0 + i for i, t in enumerate(terms) if t == w] + [100.0 for b in begins if w.startswith(b)], default=0)
        assert e == want, w
        near = max([1.0 + i for i, t in enumerate(terms) if len(t) >= toxicity.FUZZY_FROM and distance(t, w) == 1], default=0)
        assert f == (0 if e else near), (w, f, near)


def test_quotation_is_kept_apart():
    import numpy as np

    automaton = toxicity.LexiconAutomaton([(b"=idiot", 3.0)])
    texts = ["you are an idiot today", 'the label "idiot" was used', "you idi0t", "fine words only"]
    raw = "".join(texts).encode()
    rows = np.cumsum([0] + [len(t) for t in texts])
    x = toxicity.features(automaton, np.frombuffer(raw, np.uint8), rows)
    assert x[0, 0] > 0 and x[0, 1] == 0
    assert x[1, 0] == 0 and x[1, 1] > 0
    assert x[2, 2] > 0 and x[2, 0] == 0
    assert not x[3, :6].any()


def test_every_term_with_support_is_in_the_lexicon(spark):
    terms = [f"{a}{b}{c}zug" for a in "abcdefg" for b in "hijklmn" for c in "opqrstu"][:300]
    rows = [(" ".join(terms), 1)] * 10 + [("fine words only", 0)] * 100
    lexicon = toxicity.learn_lexicon(spark.createDataFrame(rows, "text string, label int"))
    assert {b"=" + t.encode() for t in terms} <= {e for e, _ in lexicon}


def test_marks_beyond_ascii_separate_words():
    import numpy as np

    automaton = toxicity.LexiconAutomaton([(b"=idiot", 3.0), ("=crétin".encode("latin-1"), 3.0)])
    quoted = ["the word\u2014 “idiot” was used", "un «crétin» ici", "a 「idiot」 x"]
    plain = ["so —idiot today", "it’s…idiot!", "был idiot был", "Żaba idiot Żaba", "an idiot😀", "IDIOT\u00a0x", "quel CRÉTIN"]
    none = ["", "idiotł idiotжж", "\u200d é"]
    texts = [t.replace("word", "term") for t in quoted] + plain + none
    raw = [t.encode() for t in texts]
    x = toxicity.features(automaton, np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0] + [len(r) for r in raw]))
    for text, row in zip(texts, x):
        kind = "quoted" if text in texts[: len(quoted)] else "plain" if text in plain else "none"
        assert (row[0] > 0, row[1] > 0) == (kind == "plain", kind == "quoted"), text
    assert len(toxicity.latin(np.zeros(0, np.uint8), np.zeros(1, np.int64))[0]) == 0
    assert [int(b) for b in toxicity.latin(np.frombuffer(b"\xc3\xe2\x80", np.uint8), np.array([0, 1, 3]))[1]] == [0, 1, 3]


def test_quality_reads_words(spark, documents):
    """Junk of the same shape as prose, all lower-case words of five letters, is told apart by its words."""
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(5)) for _ in range(120)]
    rows = []
    for i in range(500):
        vocabulary = words[:70] if i % 2 else words[50:]
        rows.append((i, ". ".join(" ".join(rng.choice(vocabulary) for _ in range(8)) for _ in range(6))))
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, quality int")
    held = quality.quality_scores(documents(rows), labels).filter("held_out").collect()
    assert len(held) > 50
    assert np.mean([r["predicted"] == r["doc_id"] % 2 for r in held]) > 0.95


def test_term_counts_equal_a_plain_count():
    texts = ["", "Ab ab AB", "a", "x y x y, x", "É é  e"]
    data, rows = quality_bytes(texts)
    row, term, count = quality.term_counts(data, rows)
    word = term >= quality.FIRST_WORD
    pair = term >= quality.FIRST_WORD + (1 << quality.WORD_BITS)
    for i, text in enumerate(texts):
        plain = [w for w in brute.ALNUM.findall(text.translate(brute.FOLD))]
        assert count[(row == i) & word & ~pair].sum() == len(plain)
        assert sorted(count[(row == i) & word & ~pair]) == sorted(plain.count(w) for w in set(plain))
        assert count[(row == i) & pair].sum() == max(0, len(plain) - 1)
        assert count[(row == i) & ~word & (term < quality.SHAPES)].sum() == max(0, len(text.encode()) - 2)


def quality_bytes(texts):
    coded = [t.encode() for t in texts]
    return np.frombuffer(b"".join(coded), np.uint8), np.cumsum([0, *map(len, coded)])


def test_votes_equal_plain_cosines():
    """With as many axes as terms the latent cosines are the plain ones; the sample spans several blocks."""
    rng = np.random.default_rng(3)
    terms = np.concatenate([np.arange(12), quality.FIRST_WORD + np.arange(10)])
    docs, labels = [], rng.integers(0, 2, 700).astype(np.float64)
    for _ in labels:
        own = np.sort(rng.choice(terms, 9, replace=False)).astype(np.int32)
        docs.append((own, rng.integers(1, 5000, 9).astype(np.int32)))
    model = quality.LatentVotes(docs, labels)
    has = {t: sum(t in own for own, _ in docs) for t in terms.tolist()}

    def vector(own, counts):
        parts = []
        for wanted, length in ((terms < quality.FIRST_WORD, 1.0), (terms >= quality.FIRST_WORD, quality.WORD_SHARE)):
            given = dict(zip(own.tolist(), counts.tolist()))
            part = np.array([math.log1p(given.get(t, 0)) * (math.log(701 / (1 + has[t])) + 1) for t in terms[wanted].tolist()])
            parts.append(part / max(np.linalg.norm(part), 1e-12) * length)
        whole = np.concatenate(parts)
        return whole / np.linalg.norm(whole)

    plain = np.array([vector(*d) for d in docs])
    asked = docs[::7]
    row = np.repeat(np.arange(len(asked)), 9)
    scores = model.scores(len(asked), row, np.concatenate([t for t, _ in asked]), np.concatenate([c for _, c in asked]))
    for score, given in zip(scores, asked):
        near = plain @ vector(*given)
        best = np.argsort(-near)[: quality.NEIGHBOURS]
        weight = np.maximum(near[best], 0) ** 8
        assert abs(score - (weight * labels[best]).sum() / weight.sum()) < 2e-3


def test_language_model_learns_by_sums_of_runs():
    """Runs of all lengths, and one step of AdaGrad, against plain loops."""
    rng = np.random.default_rng(5)
    sizes = np.array([1, 2, language_model.SHORT_RUN, language_model.SHORT_RUN + 1, 1, 700, 3])
    rows = rng.normal(size=(sizes.sum(), 5)).astype(np.float32)
    begin = np.cumsum(sizes) - sizes
    plain = [rows[b : b + n].astype(float).sum(axis=0) for b, n in zip(begin, sizes)]
    assert np.allclose(language_model._run_sums(rows, begin), plain, atol=1e-4)

    n = 300
    features = np.minimum(rng.zipf(1.5, (n, language_model.FEATURES)), (1 << language_model.FEATURE_BITS) - 1).astype(np.int32)
    classes = rng.integers(0, language_model.CLASSES, n)
    model, squares = language_model.ClassModel(rng.normal(size=language_model.CLASSES)), np.zeros(1 << language_model.FEATURE_BITS, np.float32)
    model.learn(features, classes, squares)
    weights, seen = np.zeros((1 << language_model.FEATURE_BITS, language_model.CLASSES)), np.zeros(1 << language_model.FEATURE_BITS)
    bias = model.bias.astype(float)
    error = np.tile(np.exp(bias) / np.exp(bias).sum(), (n, 1))
    error[np.arange(n), classes] -= 1
    for k in range(language_model.FEATURES):
        for f in np.unique(features[:, k]):
            total = error[features[:, k] == f].sum(axis=0)
            seen[f] += (total**2).mean()
            weights[f] -= language_model.RATE * total / np.sqrt(seen[f] + 1)
    assert np.allclose(model.weights, weights, atol=1e-4) and np.allclose(squares, seen, rtol=1e-3)
    logits = model.weights[features].sum(axis=1) + model.bias
    whole = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
    assert np.allclose(model.log_probability(features, classes), whole[np.arange(n), classes], atol=1e-4)


def test_language_model_works_in_the_cache():
    """Runs taken in another order, logits no exponential holds, and parts of a batch, against plain sums."""
    rng = np.random.default_rng(6)
    sizes = np.array([3, 1, language_model.SHORT_RUN + 5, 2, language_model.SHORT_RUN, 1])
    begin, order = np.cumsum(sizes) - sizes, rng.permutation(sizes.sum())
    rows = rng.normal(size=(sizes.sum(), 5)).astype(np.float32)
    plain = [rows[order[b : b + n]].astype(float).sum(axis=0) for b, n in zip(begin, sizes)]
    assert np.allclose(language_model._run_sums(rows, begin, order), plain, atol=1e-4)

    n = language_model.CACHED * 2 + 7
    features = rng.integers(0, 50, (n, language_model.FEATURES)).astype(np.int32)
    classes = rng.integers(0, language_model.CLASSES, n)
    for scale in (1, 100):
        model = language_model.ClassModel(rng.normal(size=language_model.CLASSES))
        model.weights[:50] = rng.normal(scale=scale, size=(50, language_model.CLASSES))
        logits = model.weights[features].astype(float).sum(axis=1) + model.bias
        logits -= logits.max(axis=1, keepdims=True)
        whole = logits - np.log(np.exp(logits).sum(axis=1, keepdims=True))
        assert np.allclose(model.log_probability(features, classes), whole[np.arange(n), classes], rtol=1e-4, atol=1e-4)
        assert np.allclose(language_model._softmax(language_model._logits(model.weights, model.bias, features)), np.exp(whole), atol=1e-3)
