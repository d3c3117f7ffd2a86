"""Language, quality and toxicity: held-out agreement, formulas against plain Python, odd rows."""

import math
import random

import numpy as np

from umbral.llm import language, quality, toxicity
from umbral.llm.queries import held_out

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, declared string"
WORDS = {
    "en": "the house is near a river and they walk with that dog every morning".split(),
    "de": "das haus ist nahe dem fluss und sie gehen mit diesem hund jeden morgen".split(),
    "fr": "la maison est près de rivière et ils marchent avec ce chien chaque matin".split(),
}


def prose(rng, lang, n=30):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 0, 0.0, "d") for i, t, lang, s in rows], DOCS).repartition(4)


def corpus(n=240, seed=1):
    rng = random.Random(seed)
    return [(i, prose(rng, lang := rng.choice(list(WORDS))), lang, "s%d.example.org" % (i % 7)) for i in range(n)]


def test_documents(spark):
    rows = corpus() + [(1000, "", "en", "s1"), (1001, None, None, None), (1002, "12 34 !!", "de", "s1"), (None, prose(random.Random(2), "fr"), None, None)]
    got = {r["id"]: r["lang"] for r in language.identify_documents(docs(spark, rows), docs(spark, rows)).collect()}
    assert all(got[i] == lang for i, _, lang, _ in rows[:240])
    assert got[1000] == got[1001] == got[1002] == "und" and got[None] == "fr"
    left = language.drop_undetermined(docs(spark, rows))
    assert left.columns == docs(spark, rows).columns and left.count() == 241


def test_rows_are_judged_one_by_one(spark):
    clean = corpus(60)
    extra = [(None, prose(random.Random(5), "de"), "de", "s1"), (None, prose(random.Random(6), "en"), None, None), (7, "", "en", "s1")]
    extra += [(None, "", None, None), (None, "12 !!", "de", "s1"), (None, None, "fr", "s2"), (8, None, None, None)]
    left = sorted((str(r["doc_id"]), r["text"]) for r in language.drop_undetermined(docs(spark, clean + extra)).collect())
    assert left == sorted((str(i), t) for i, t, _, _ in clean + extra[:2])


def test_texts_stay_without_a_model(spark):
    rows = [(i, t, None, s) for i, t, _, s in corpus(12)] + [(100, "", None, "s1"), (None, "12 !!", None, None), (None, "x", None, None)]
    left = language.drop_undetermined(docs(spark, rows)).collect()
    assert sorted(str(r["doc_id"]) for r in left) == sorted([*map(str, range(12)), "None"])


def test_cells_do_not_depend_on_the_slice():
    texts = ["a", "", "bc", "12", "d e"]
    cells, at = language._cells(texts)
    assert at.tolist() == [0, 1, 1, 3, 3, 5]
    for i, t in enumerate(texts):
        alone, _ = language._cells([t])
        assert alone.tolist() == cells[at[i] : at[i + 1]].tolist()


def test_no_rows_or_labels(spark):
    assert language.identify_documents(docs(spark, []), docs(spark, [])).collect() == []
    got = language.identify_documents(docs(spark, corpus(3)), docs(spark, [])).collect()
    assert [r["lang"] for r in got] == ["und"] * 3


def test_pages(spark):
    rng = random.Random(3)
    pages = []
    for i in range(120):
        lang = list(WORDS)[i % 3]
        declared = lang if i % 4 else "en"
        pages.append((i, f"https://www.h{i % 3}.example.{'de' if lang == 'de' else 'com'}/p{i}", f'<html lang="{declared}-XX"><script>der die das</script><!-- x --><body>{prose(rng, lang, 12)} &amp; <b>{prose(rng, lang, 5)}</b></body></html>'))
    pages += [(500, None, None), (501, "no address", "<p></p>"), (502, "http://h1.example.de/x", f"<HTML dir=x LANG='DE'>{prose(rng, 'de', 4)}")]
    df = spark.createDataFrame([(*p, "x") for p in pages], "page_id long, url string, html string, host string").repartition(3)
    got = {r["id"]: r for r in language.identify_pages(df, docs(spark, corpus())).collect()}
    assert all(got[i]["lang"] == list(WORDS)[i % 3] for i in range(120))
    assert got[500]["lang"] == got[501]["lang"] == "und" and got[502]["lang"] == "de" and got[502]["declared"] == "de"
    assert got[0]["host"] == "www.h0.example.com" and got[500]["host"] == ""


def test_fused_posterior(spark):
    """The SQL expressions against the same formulas in plain Python."""
    rng = random.Random(4)
    rows = []
    for i in range(60):
        logs = [rng.uniform(-50, 0) for _ in range(3)]
        host = rng.choice(["a.x.com", "b.x.com", "c.y.org", ""])
        parts = host.split(".")
        rows.append((i, logs, rng.choice([0, 5, 9]), rng.choice(["en", "de", ""]), host, ".".join(parts[-2:]), parts[-1] if "." in host else ""))
    names, alpha, power = ["de", "en", "fr"], 4.0, 0.1
    df = spark.createDataFrame(rows, "id long, text_log array<double>, n_letters long, declared string, host string, domain string, suffix string")
    got = {r["id"]: r for r in language.fuse(df, names).collect()}
    own = [max(range(3), key=lambda k: r[1][k]) if r[2] else -1 for r in rows]

    def counts(i, same):
        return [sum(1 for j, r in enumerate(rows) if j != i and own[j] == k and same(r)) for k in range(3)]

    for i, r in enumerate(rows):
        by_all = counts(i, lambda o: True)
        prior = [(n + 1) / (sum(by_all) + 3) for n in by_all]
        for at in (6, 5, 4):
            by = counts(i, lambda o, at=at: o[at:] == r[at:] and o[4 if at == 4 else at] == r[at])
            prior = [(n + alpha * p) / (sum(by) + alpha) for n, p in zip(by, prior)]
        logs = [power * x + math.log(p) for x, p in zip(r[1], prior)]
        for at in (3, 6):
            if r[at]:
                by = counts(i, lambda o, at=at: o[at] == r[at])
                share = (sum(by) + 1) / (sum(by_all) + 2)
                logs = [x + math.log((n + alpha * share) / (m + alpha)) for x, n, m in zip(logs, by, by_all)]
        weights = [math.exp(x - max(logs)) for x in logs]
        assert abs(got[i]["posterior"] - max(weights) / sum(weights)) < 1e-9
        best = names[weights.index(max(weights))]
        assert got[i]["lang"] == (best if max(weights) / sum(weights) >= 0.5 and r[2] else "und")


def f1(rows, truth, positive=1):
    hit = sum(1 for r in rows if r["predicted"] == positive == truth[r["doc_id"]])
    return 2 * hit / max(1, sum(r["predicted"] == positive for r in rows) + sum(truth[r["doc_id"]] == positive for r in rows))


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.1"
    d, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    for score, column, modulus, rest, least in ((quality.score_quality, "quality", 5, 0, 0.95), (toxicity.score_toxicity, "toxic", 3, 1, 0.85)):
        truth = {r["doc_id"]: r[column] for r in labels.collect()}
        out = score(d, labels, held_out(modulus, rest)).collect()
        assert len(out) == d.count()
        rows = [r for r in out if r["held_out"] and r["doc_id"] in truth]
        assert len(rows) > 200 and f1(rows, truth) > least
        assert all(0 <= r["score"] <= 1 for r in out)
        low = [r for r in rows if truth[r["doc_id"]] == 0]
        assert sum(r["predicted"] == 0 for r in low) / len(low) > 0.8


def test_classifiers_on_odd_rows(spark):
    rows = [(i, t, None, None) for i, t in enumerate(["", None, "word " * 5000, "x"])] + [(None, "a b", None, None), (3, "x", None, None)]
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    some = spark.createDataFrame([(0, 1, 1), (1, None, None), (None, 0, 1), (2, 0, 0), (2, 1, 0)], "doc_id long, quality int, toxic int")
    for labels in (none, some):
        for score in (quality.score_quality, toxicity.score_toxicity):
            out = score(docs(spark, rows), labels, held_out(5, 0)).collect()
            assert len(out) == 6 and all(0 <= r["score"] <= 1 for r in out) and all(r["held_out"] is False for r in out if r["doc_id"] is None)
            assert score(docs(spark, []), labels, held_out(5, 0)).collect() == []


def test_word_vectors_are_sums_of_contexts(spark):
    texts = ["a b c a", "b a", "", "Zz!! 9"]
    table = quality.word_vectors(docs(spark, [(i, t, None, None) for i, t in enumerate(texts)]))
    places, signs = quality._index_vectors()
    index = np.zeros((quality.WORDS + quality.SHAPES, quality.SIZE))
    for k in range(quality.NONZERO):
        np.add.at(index, (np.arange(len(index)), places[:, k]), signs[:, k])
    sums, n = np.zeros_like(index), np.zeros(len(index))
    for t in texts:
        flat, _ = quality._stream([t], quality.Cells())
        for i, c in enumerate(flat):
            n[c] += 1
            for j in range(max(0, i - quality.WINDOW), min(len(flat), i + quality.WINDOW + 1)):
                if j != i:
                    sums[c] += index[flat[j]]
    unit = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
    assert np.allclose(table, unit * (quality.WEIGHT / (quality.WEIGHT + n / n.sum()))[:, None], atol=1e-5)


def test_risk_is_not_negative():
    """Positives the fit could remember: the corrected risk keeps unlabelled look-alikes positive."""
    rng = np.random.default_rng(3)
    examples, toxic = [], []
    for i in range(600):
        bad = i % 4 == 0
        words = rng.integers(10, 4000, 15)
        examples.append(np.unique(np.append(words, 3 if bad else 5)).astype(np.int32))
        toxic.append(bad)
    confirmed = np.array(toxic) & (np.arange(600) % 8 == 0)
    weights, bias = toxicity.fit_pu(examples, confirmed, 0.25)
    score = np.array([weights[e].sum() + bias for e in examples])
    assert (score[np.array(toxic)] > 0).mean() > 0.9 and (score[~np.array(toxic)] < 0).mean() > 0.9


