import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwarden.llm import langid, quality, sparse_fit, toxicity
from driftwarden.llm.labelled import labelled_sample, remainder


def auc(scores, labels):
    pairs = [(a > b) + 0.5 * (a == b) for a, x in zip(scores, labels, strict=True) if x for b, y in zip(scores, labels, strict=True) if not y]
    return sum(pairs) / len(pairs)


@pytest.fixture
def labelled(spark):
    """Texts: bad ones shout signs; toxic ones hold a slur, mostly next to one group's name."""
    rng, rows = random.Random(4), []
    for i in range(600):
        words = [rng.choice("the of and house tree river walk green".split()) + rng.choice(["", "s", "ing"]) for _ in range(rng.randrange(8, 60))]
        bad, toxic = i % 3 == 0, i % 4 == 0
        if bad:
            words = [w + "###" for w in words]
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["zorkhead", "zorking"])
        if rng.random() < (0.7 if toxic else 0.05):
            words.insert(rng.randrange(len(words)), "muslims")
        rows.append((i, " ".join(words), int(not bad), int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int").repartition(3)


def test_sample_is_bounded_and_leaves_out_what_is_held_out(labelled):
    sample = labelled_sample(labelled.select("doc_id", "text"), labelled, "toxic", remainder(4) == 2, 50)
    assert sample.count() == 50
    assert sample.where(remainder(4) == 2).count() == 0
    again = labelled_sample(labelled.select("doc_id", "text").repartition(7), labelled, "toxic", remainder(4) == 2, 50)
    assert {r["doc_id"] for r in again.collect()} == {r["doc_id"] for r in sample.collect()}


def test_quality_rules_tell_held_out_documents(labelled):
    sample = labelled_sample(labelled.select("doc_id", "text"), labelled, "quality", remainder(3) == 1, 300)
    model = quality.fit(sample)
    rows = quality.score(labelled, model).join(labelled.select("doc_id", "quality"), "doc_id").where(remainder(3) == 1).collect()
    assert auc([r["score"] for r in rows], [r["quality"] for r in rows]) > 0.99
    assert 0 < len(model.rules) < 60


def test_compiled_rules_are_the_rules(labelled):
    model = quality.Rules(0.5, ((1.0, (("signs", True, 0.1),)), (-2.0, (("signs", False, 0.1), ("log_words", True, 3.0)))))
    rows = quality.statistics(labelled).withColumn("score", model.column()).collect()
    for r in rows:
        margin = 0.5 + (r["signs"] > 0.1) - 2 * (r["signs"] <= 0.1 and r["log_words"] > 3)
        assert abs(r["score"] - 1 / (1 + np.exp(-margin))) < 1e-12


def test_statistics_of_a_text(spark):
    docs = spark.createDataFrame([(1, "Ab ab, ab | ab 12\n"), (2, None), (3, ""), (4, " \n")], "doc_id long, text string")
    one, *rest = (r.asDict() for r in quality.statistics(docs.repartition(1)).orderBy("doc_id").collect())
    assert one["upper"] == 1 / 18 and one["digits"] == 2 / 18 and one["distinct"] == 5 / 6 and one["bare_words"] == 1 / 6
    assert one["top_word"] == 2 / 6 and one["lines"] == 1 / 18 and one["signs"] == 1 / 18 and one["stops"] == 1 / 18
    assert all(v == 0 for r in rest[:2] for k, v in r.items() if k != "doc_id")


def test_toxicity_and_counterfactual_penalty(spark, labelled):
    sample = labelled_sample(labelled.select("doc_id", "text"), labelled, "toxic", remainder(4) == 2, 400)
    fair, plain = toxicity.fit(sample, fairness=5.0), toxicity.fit(sample, fairness=0.0)
    rows = toxicity.score(labelled, fair).join(labelled.select("doc_id", "toxic"), "doc_id").where(remainder(4) == 2).collect()
    assert auc([r["score"] for r in rows], [r["toxic"] for r in rows]) > 0.97
    assert all((r["score"] >= 0.3) == bool(r["toxic"]) for r in rows if r["score"] > 0.6 or r["score"] < 0.1)
    neutral = spark.createDataFrame([(1, "muslims walk by the river"), (2, "christians walk by the river")], "doc_id long, text string")
    gap = {}
    for name, model in (("fair", fair), ("plain", plain)):
        score = {r["doc_id"]: r["score"] for r in toxicity.score(neutral, model).collect()}
        gap[name] = abs(score[1] - score[2])
    assert gap["fair"] < gap["plain"] / 2 or gap["plain"] < 0.01


def test_keep_clean_leaves_rows_as_they_are(spark, labelled):
    model = toxicity.Weights(-3.0, *_weights({"zorkhead": 9.0, "zorking": 9.0}))
    docs = labelled.withColumn("score", F.lit("mine")).unionByName(
        spark.createDataFrame([(None, None, 1, 1, "mine")], "doc_id long, text string, quality int, toxic int, score string")
    )
    left = toxicity.keep_clean(docs, model, 0.3)
    assert left.schema == docs.schema
    assert sorted(map(str, left.collect())) == sorted(map(str, docs.where("toxic = 0 or doc_id is null").collect()))


def _weights(of):
    import pyarrow as pa

    made = {}
    for words in toxicity.parsed(pa.array(list(of))):
        hashed, _ = toxicity.features(words)
        made |= dict(zip(hashed[: len(of)].tolist(), of.values(), strict=True))
    keys = np.array(sorted(made), np.uint64)
    return keys, np.array([made[int(k)] for k in keys])


def test_ties_penalise_exactly_the_swaps():
    terms = [t for g in toxicity.IDENTITY_TERMS for t in g]
    of_term = {t: i for i, t in enumerate(dict.fromkeys(terms))}
    swaps = np.zeros(len(of_term))
    swaps[of_term["muslims"]] = 4
    kinds = {}
    for at in (of_term["muslims"],):
        touched = sorted({of_term[o] for g in toxicity.IDENTITY_TERMS for t in g if of_term[t] == at for o in g})
        kinds[at, *(int(f == at) for f in touched)] = float(swaps[at])
    ties = toxicity.swap_ties(len(of_term), of_term, {t: [i] for t, i in of_term.items()}, kinds)
    w = np.zeros(len(of_term))
    w[of_term["muslims"]] = 2.0
    assert abs(w @ ties @ w - 4.0) < 1e-5
    w[[of_term[t] for t in toxicity.IDENTITY_TERMS[2]]] = 2.0
    assert abs(w @ ties @ w) < 1e-5


def test_penalty_covers_the_beginnings_of_swapped_terms(spark, labelled):
    sample = labelled_sample(labelled.select("doc_id", "text"), labelled, "toxic", remainder(4) == 2, 400)
    model = toxicity.fit(sample, fairness=5.0)
    neutral = spark.createDataFrame([(1, "muslims walk by the river"), (2, "christians walk by the river")], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in toxicity.score(neutral, model).collect()}
    margin = {i: np.log(s / (1 - s)) for i, s in score.items()}
    assert abs(margin[1] - margin[2]) < 0.2


def test_swaps_of_a_sentence_by_brute_force():
    import pyarrow as pa

    texts = pa.array(["Muslims and muslims met. Muslim food\nmuslims"])
    own_hash = toxicity.term_parts()
    keys = np.unique(np.array([f for parts in own_hash.values() for f in parts], np.uint64))
    own = {t: [int(i) for i in np.searchsorted(keys, np.array(p, np.uint64))] for t, p in own_hash.items()}
    of_term = {t: own[t][0] for t in own}
    touched = {of_term[t]: sorted({f for g in toxicity.IDENTITY_TERMS if t in g for o in g for f in own[o]}) for t in own}
    (words,) = toxicity.parsed(texts)
    swaps = {tuple(kind): n for n, *kind in toxicity.sentence_swaps(words, keys, np.array(sorted(touched)), touched)}
    assert sum(swaps.values()) == 3
    w = np.random.default_rng(1).normal(size=len(keys))
    model = toxicity.Weights(0.0, keys, w)

    def margin(text):
        (words,) = toxicity.parsed(pa.array([text]))
        score = model.of(words)[0]
        return np.log(score / (1 - score))

    changes = []
    for sentence, term in (("muslims and muslims met", "muslims"), ("muslim food", "muslim"), ("muslims", "muslims")):
        group = next(g for g in toxicity.IDENTITY_TERMS if term in g)
        changes.append(np.mean([(margin(sentence.replace(term, o)) - margin(sentence)) ** 2 for o in group if o != term]))
    ties = toxicity.swap_ties(len(keys), of_term, own, swaps)
    assert abs(w @ ties @ w - np.mean(changes)) < 1e-3


def test_lasso_finds_the_one_feature():
    rng = np.random.default_rng(0)
    x = (rng.random((500, 20)) < 0.3).astype(np.float32)
    intercept, weights = sparse_fit.lasso_logistic(x, x[:, 3].astype(float), 0.01)
    assert np.argmax(np.abs(weights)) == 3 and (weights != 0).sum() <= 3 and intercept < 0


def brute_phrases(text, sample):
    count, at = 0, 0
    while at < len(text):
        end = at + 1
        while end < len(text) and any(text[at : end + 1] in part for part in sample):
            end += 1
        count, at = count + 1, end
    return count


def test_parse_against_brute_force(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 50)
    rng = random.Random(6)
    parts = {"aa": ["".join(rng.choice("abc d") for _ in range(40)) for _ in range(4)], "bb": ["".join(rng.choice("bde ") for _ in range(60)) for _ in range(3)]}
    model = langid.build(parts)
    texts = ["".join(rng.choice("abcde ") for _ in range(rng.randrange(0, 130))) for _ in range(40)]
    marks = [model.symbols[0][langid._points(t)] for t in texts]
    first = np.concatenate(([0], np.cumsum([len(m) for m in marks])))
    got = langid.phrases([np.concatenate(marks)], first, model)
    for i, text in enumerate(texts):
        for j, language in enumerate(model.languages):
            want = sum(brute_phrases(text[k : k + 50], parts[language]) for k in range(0, len(text), 50))
            assert got[i, j] == want


def test_language_of_held_out_documents(spark):
    rng, rows = random.Random(7), []
    syllables = {"xx": ["ka", "to", "mi", "ro"], "yy": ["est", "ung", "lich", "ver"], "zz": ["ção", "ña", "que", "ll"]}
    for i in range(300):
        lang = rng.choice(sorted(syllables))
        words = ["".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 50))]
        rows.append((i, " ".join(words), lang if i % 5 else None, lang))
    rows += [(1000, None, "xx", "und"), (1001, " 12 !?", "xx", "und"), (1002, "", None, "und"), (1003, "katomi " * 20000, None, "xx")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, truth string").repartition(3)
    model = langid.build(langid.sample(docs, remainder(3) != 1, signs=2000, stretch=60))
    got = {r["doc_id"]: r for r in langid.predict(docs, model).collect()}
    assert all(got[i]["lang_pred"] == truth for i, _, _, truth in rows)
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_nothing_learned_and_no_rows(spark, no_documents):
    docs = spark.createDataFrame([(1, "a word"), (2, None), (2, None)], "doc_id long, text string")
    none = langid.build(langid.sample(docs.withColumn("lang", F.lit(None).cast("string")), F.lit(True)))
    assert {r["lang_pred"] for r in langid.predict(docs, none).collect()} == {"und"}
    labels = spark.createDataFrame([], "doc_id long, toxic int, quality int")
    weights = toxicity.learn(docs, labels, F.lit(False), 10)
    assert [r["score"] for r in toxicity.score(docs, weights).collect()] == [0.5] * 3
    rules = quality.fit(labelled_sample(docs, labels, "quality", F.lit(False), 10))
    assert [r["score"] for r in quality.score(docs, rules).collect()] == [0.5] * 3
    for frame in (langid.predict(no_documents, none), toxicity.score(no_documents, weights), quality.score(no_documents, rules)):
        assert frame.count() == 0
    one = spark.createDataFrame([(1, 1, 1)], "doc_id long, toxic int, quality int")
    assert 0.5 < toxicity.score(docs, toxicity.learn(docs, one, F.lit(False), 10)).first()["score"] < 1


@pytest.mark.parametrize("lang", ["en", "de", "fr", "es"])
def test_neutral_mentions_in_the_documents_own_languages(spark, lang):
    """Rows of the given tables, where one group is named in many toxic texts and in few others, and another one everywhere."""
    folder = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = spark.read.parquet(f"{folder}/documents.parquet").where("text is not null").join(labels, "doc_id").select("doc_id", "text", "toxic")
    rows, rng = [r for r in rows.collect() if r["toxic"] is not None], random.Random(5)
    term, other = toxicity.TERMS_BY_LANGUAGE[lang][1][0], toxicity.TERMS_BY_LANGUAGE[lang][1][1]
    if lang == "en":
        term, other = "muslims", "christians"
    planted = []
    for r in sorted(rows, key=lambda r: r["doc_id"]):
        named = rng.random() < (0.5 if r["toxic"] else 0.02)
        word = term if named else other if rng.random() < 0.4 else ""
        planted.append((r["doc_id"], f"{word} {r['text']}", float(r["toxic"])))
    sample = spark.createDataFrame(planted, "doc_id long, text string, y double")
    fair, plain = toxicity.fit(sample, fairness=5.0), toxicity.fit(sample, fairness=0.0)
    assert fair.swaps > 0
    clean = [r["text"] for r in rows if not r["toxic"]][:60]
    neutral = spark.createDataFrame(
        [(3 * i + k, f"{w} {t}" if w else t) for i, t in enumerate(clean) for k, w in enumerate((None, term, other))], "doc_id long, text string"
    )
    margins, raised = {}, {}
    for name, model in (("fair", fair), ("plain", plain)):
        score = {r["doc_id"]: r["score"] for r in toxicity.score(neutral, model).collect()}
        margin = {i: np.log(s / (1 - s)) for i, s in score.items()}
        raised[name] = float(np.mean([margin[3 * i + 1] - margin[3 * i] for i in range(len(clean))]))
        margins[name] = float(np.mean([abs(margin[3 * i + 1] - margin[3 * i + 2]) for i in range(len(clean))]))
    assert margins["fair"] < margins["plain"] / 3
    assert raised["plain"] > 0.5 and raised["fair"] < raised["plain"] / 2


def test_groups_of_ones_own_and_proposals(spark, labelled):
    sample = labelled_sample(labelled.select("doc_id", "text"), labelled, "toxic", remainder(4) == 2, 400)
    assert toxicity.fit(sample, groups=[["zebras", "gnus"]]).swaps == 0
    assert toxicity.fit(sample, groups=[["muslims", "gnus"]]).swaps > 0
    texts = ["we saw many zebras here", "we saw many gnus here", "we saw many owls here", "they met old zebras again", "they met old gnus again", None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    found = [tuple(r) for r in toxicity.proposed_terms(docs, [["zebras"]]).collect()]
    assert found == [("zebras", "gnus", 2), ("zebras", "owls", 1)]


def test_many_languages_and_scripts(spark):
    """Seventy languages of the same few hundred letters each, and two of 200 letters that share none: more than an alphabet holds."""
    rng, rows = random.Random(7), []
    for k in range(70):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 8))) for _ in range(25)]
        rows += [(" ".join(rng.choice(words) for _ in range(60)), f"l{k:02}") for _ in range(8)]
    for name, start in (("han1", 0x4E00), ("han2", 0x5E00)):
        words = ["".join(chr(start + rng.randrange(200)) for _ in range(3)) for _ in range(40)]
        rows += [(" ".join(rng.choice(words) for _ in range(60)), name) for _ in range(8)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)
    model = langid.build(langid.sample(docs, F.col("doc_id") % 4 != 1))
    assert len(model.languages) == 72 and len(model.symbols) >= 3
    held = {r["doc_id"]: r["lang"] for r in docs.where("doc_id % 4 = 1").collect()}
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(docs.where("doc_id % 4 = 1"), model).collect()}
    assert sum(got[i] == lang for i, lang in held.items()) > 0.9 * len(held)
