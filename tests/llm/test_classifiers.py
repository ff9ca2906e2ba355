import itertools
import math
import os
import pickle
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

from mdframe.llm import labelled, language, quality, toxicity
from mdframe.llm.common import table
from mdframe.llm.transducers import Transducer, compose

DATA = "/root/testdata/sf0.1"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


def joined(spark, out, label):
    return out.join(table(spark, DATA, "labels").select("doc_id", F.col(label).alias("y")), "doc_id").where("y is not null").toPandas()


@needs_data
def test_toxicity_on_held_out_rows(spark):
    rows = joined(spark, toxicity.op8_toxicity(spark, DATA), "toxic")
    assert (rows.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id]).all()
    held = rows[rows.held_out]
    assert held[held.y == 1].predicted.mean() > 0.9 and held[held.y == 0].predicted.mean() < 0.01 and rows.score.between(0, 1).all()


@needs_data
def test_quality_on_held_out_rows(spark):
    out = quality.op10_quality(spark, DATA)
    assert "Python" not in out._jdf.queryExecution().toString()
    rows = joined(spark, out, "quality")
    held = rows[rows.held_out]
    assert held[held.y == 1].predicted.mean() > 0.99 and held[held.y == 0].predicted.mean() < 0.05 and rows.score.between(0, 1).all()


@needs_data
def test_language_on_held_out_rows(spark):
    out = language.op9_language_id(spark, DATA)
    rows = out.join(table(spark, DATA, "documents").select("doc_id", "lang"), "doc_id").toPandas()
    held = rows[rows.held_out]
    assert (held.lang == held.lang_pred).mean() > 0.99


def labels(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, quality int, toxic int, text string, n int")


def test_odd_documents(spark, odd, empty):
    few = labels(spark, [(i, i % 2, 1 - i % 2) for i in range(1, 14)] + [(4, 1, 1), (None, 1, 1), (3, None, None)])
    for some in (few, few.limit(0)):
        model = toxicity.fit_toxicity(odd, some)
        scores = toxicity.score_toxicity(odd, model).collect()
        assert len(scores) == odd.count() and all(0 <= r["score"] <= 1 for r in scores)
        assert toxicity.score_toxicity(empty, model).collect() == [] and toxicity.keep_clean(odd, model, 2.0).count() == odd.count()
        rules = quality.fit_quality(odd, some)
        scores = quality.with_score(odd, rules, "q").collect()
        assert len(scores) == odd.count() and all(0 <= r["q"] <= 1 for r in scores)
        assert quality.with_score(empty, rules, "q").collect() == [] and quality.keep_good(odd, rules, 0.0).columns == odd.columns
    assert toxicity.fit_toxicity(empty, few).score("any") == toxicity.fit_toxicity(empty, few).score(None)
    net = language.fit_languages(odd)
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language.predict_language(odd, net).collect()}
    assert out[1] == out[2] == out[8] == ("und", 0.0) and out[3][0] in net.classes and 0 <= out[3][1] <= 1
    assert language.fit_languages(empty) is None and {r["lang_pred"] for r in language.predict_language(odd, None).collect()} == {"und"}


def random_machine(rng, read, write, states=4):
    arcs = [(rng.randrange(states), rng.choice(read), rng.choice(write + ("",)), rng.randrange(-3, 4), rng.randrange(states)) for _ in range(rng.randrange(4, 22))]
    return Transducer.of(0, arcs, {s: rng.randrange(3) for s in range(states) if rng.random() < 0.7})


def test_composition_equals_paths_of_both():
    rng = random.Random(3)
    matched = 0
    for _ in range(150):
        first, second = random_machine(rng, "ab", ("x", "y")), random_machine(rng, "xy", ("p", "q"))
        both = compose(first, second)
        for n in range(4):
            for word in itertools.product("ab", repeat=n):
                want = sorted((w + v, out) for w, middle in first.paths(word) for v, out in second.paths(middle))
                assert sorted(both.paths(word)) == want
                matched += bool(want)
                best = both.best(word)
                assert best == (min(want, key=lambda p: (-p[0], p[1])) if want else None)
        assert both.states() <= {both.start} | {s for s in both.trimmed().states()}
    assert matched > 200


def by_hand(clause):
    """Patterns of a clause's harmful words, from the rules as they are stated."""
    out, phrase, announced, denied = [], False, 0, 0
    for c in clause:
        kind = None
        if c == toxicity.INSULT:
            kind, phrase = toxicity.MORE if phrase else toxicity.PHRASE, True
        else:
            phrase = False
            if c == toxicity.VERB:
                kind = toxicity.THREAT if announced else toxicity.BARE
        if kind:
            out.append(kind + toxicity.AIMED * (toxicity.TARGET in clause) + toxicity.DENIED * (denied > 0) + toxicity.REPORTED * (toxicity.REPORT in clause))
        announced = toxicity.NEAR if c == toxicity.ANNOUNCED else max(0, announced - 1)
        denied = toxicity.REACH if c == toxicity.NEGATION else max(0, denied - 1)
    return out if len(clause) > 1 else []


def test_grammar_equals_its_rules():
    grammar = toxicity.Grammar()
    for n in range(5):
        for clause in itertools.product("witmynr", repeat=n):
            clause = "".join(clause)
            paths = list(grammar.machine.paths(clause + toxicity.END))
            assert len(paths) == (n > 1)
            assert [grammar.patterns[k] for k in grammar.read(clause)] == by_hand(clause) == (list(paths[0][1]) if paths else [])
    rng = random.Random(5)
    for _ in range(400):
        clause = "".join(rng.choice("wwwwwwwwitmynr") for _ in range(rng.randrange(2, 40)))
        assert [grammar.patterns[k] for k in grammar.read(clause)] == by_hand(clause)


def test_matched_clauses():
    lexicon, grammar = toxicity.Lexicon({w: (s, 1.0) for s, words in toxicity.WORDS.items() for w in words}), toxicity.Grammar()
    total = lambda text: toxicity.statistics(*toxicity.read_text(text, lexicon, grammar), grammar.weights)[0]
    assert total("you idiot") == total("idiot, you") > total("an idiot") > total("not an idiot") > 0
    assert total("an idiot") > total("they said idiot") == total("idiot they said") > 0
    assert total("you are an idiot they said") < total("you are an idiot so be") and total("i will kill you") > total("you kill time") > 0
    assert total("a worthless idiot") > total("an idiot") and total("idiotic idea") == total("") == total(None) == 0
    assert total("idiot") == total("fine. idiot. fine") == 0, "a word alone is no clause"
    assert total("not so. an idiot") == total("an idiot")


def test_lexicon_equals_lookup():
    rng = random.Random(1)
    for _ in range(60):
        entries = {"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) + rng.choice(["", "*"]): (toxicity.INSULT, float(k)) for k in range(12)}
        lexicon = pickle.loads(pickle.dumps(toxicity.Lexicon(entries)))
        for n in range(1, 6):
            for word in map("".join, itertools.product("abc", repeat=n)):
                want = entries.get(word) or next((entries[word[:k] + "*"] for k in range(n - 1, 0, -1) if word[:k] + "*" in entries), (toxicity.FILLER, 0.0))
                assert lexicon.read(word) == want


def test_forms_are_counted_where_they_are(spark):
    texts = [(k % 2, int(k % 3 == 0), ["", "you badword here", "a clean thing badwords", "clean clean thing"][k % 4]) for k in range(80)]
    rows = spark.createDataFrame(texts, "side int, y int, text string").repartition(3)
    want = Counter((s, y, f) for s, y, t in texts for f in toxicity.forms_of(t))
    assert {tuple(r)[:3]: r["n"] for r in toxicity.count_forms(rows).collect()} == want
    assert math.isclose(toxicity.odds_of(9, 1, 20, 30)[0], math.log(9.5 / 21) - math.log(1.5 / 31))


def test_network_equals_plain_convolution():
    rng = np.random.default_rng(4)
    net = language.ByteNetwork(["a", "b", "c"])
    for k in net.p:
        net.p[k] = rng.normal(0, 0.4, net.p[k].shape).astype("f4")
    x = rng.integers(0, 256, (7, language.WINDOW)).astype(np.uint8)
    want = []
    for row in x:
        e, pooled = net.p["e"][row], []
        for w in language.WIDTHS:
            z = np.array([e[i : i + w].ravel() @ net.p[f"k{w}"] for i in range(language.WINDOW - w + 1)])
            pooled.append(np.maximum(z.max(axis=0) + net.p[f"b{w}"], 0))
        logits = np.concatenate(pooled) @ net.p["o"] + net.p["c"]
        want.append(logits - np.log(np.exp(logits - logits.max()).sum()) - logits.max())
    assert np.allclose(net.log_probabilities(x), want, atol=1e-3)
    y = rng.integers(0, 3, 7)
    _, g = net._step(x, y)
    net.p = {k: v.astype("f8") for k, v in net.p.items()}
    for k in net.p:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        before, losses = net.p[k][at], []
        for d in (1e-5, -1e-5):
            net.p[k][at] = before + d
            losses.append(net._step(x, y)[0])
        net.p[k][at] = before
        assert math.isclose((losses[0] - losses[1]) / 2e-5, g[k][at], rel_tol=0.02, abs_tol=1e-5)


def test_windows_cover_every_byte(monkeypatch):
    for n in (0, 1, 191, 192, 193, 207, 208, 384, 385, 1000):
        raw = bytes(k % 251 for k in range(n))
        rows = language.windows_of(raw)
        assert rows.shape[1] == language.WINDOW and rows[-1].tobytes().rstrip(b" ").endswith(raw[-15:])
        assert b"".join(r.tobytes() for r in rows[:-1]) + (rows[-1].tobytes()[-(n % 192 or 192) :] if n > 192 else rows[-1].tobytes()[:n]) == raw
    net = language.ByteNetwork(["a", "b"])
    texts = [None, "", "...", "ab", "word " * 500, "é" * 3000, "x" * 150_000, *[f"text {k} " * k for k in range(40)]]
    lang, score = language.predict_texts(texts, net)
    for t, one, p in zip(texts, lang, score, strict=True):
        if t and any(c.isalpha() for c in t):
            mean = net.log_probabilities(language.windows_of(t.encode())).astype("f8").mean(axis=0)
            q = np.exp(mean) / np.exp(mean).sum()
            assert one == "ab"[int(mean.argmax())] and math.isclose(p, q.max(), rel_tol=1e-4)
        else:
            assert (one, p) == ("und", 0.0)


def plain_statistics(t):
    words = regex.sub(r"[ \t\n\x0b\f\r]+", " ", t).strip(" ").split(" ")
    lines, chars = t.split("\n"), max(1, len(t))
    share = lambda p: len(regex.findall(p, t)) / chars
    return {
        "log_chars": math.log1p(len(t)), "word_chars": len(t) / len(words), "fresh_words": len(set(words)) / math.sqrt(len(words)),
        "repeated_words": 1 - len(set(words)) / len(words), "repeated_lines": 1 - len(set(lines)) / len(lines), "line_words": math.log1p(len(words) / len(lines)),
        "capitals": share(r"\p{Lu}"), "symbols": share(r"[^\p{L}\p{N} \t\n\x0b\f\r.,]"), "bars": share(r"\|"), "stops": share(r"\."), "digits": share(r"\p{Nd}"),
    }


def test_statistics_equal_plain_counts(spark, odd):
    names = list(quality.statistics(F.col("text")))
    rows = odd.select("text", *[c.alias(k) for k, c in quality.statistics(F.col("text")).items()]).collect()
    for r in rows:
        t = r["text"] or ""
        want = plain_statistics(t)
        assert list(want) == names
        for k in names:
            assert math.isclose(r[k], want[k], rel_tol=1e-9, abs_tol=1e-12), (k, t[:40])


def test_clashing_names(spark):
    frame = spark.createDataFrame([(1, "some text", 0.5, 1, 2)], "doc_id long, text string, __quality double, __stats int, __log_chars int")
    model = quality.RuleEnsemble(["log_chars"], [], 2.0)
    kept = quality.keep_good(frame, model)
    assert kept.columns == frame.columns and tuple(kept.first()) == (1, "some text", 0.5, 1, 2)
    assert quality.with_score(frame, model, "q").columns == [*frame.columns, "q"]


def test_sample_is_one_row_an_id(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(5)] + [(2, None)], "doc_id long, text string").repartition(3)
    rows = [labelled.with_rows(docs.repartition(n), labelled.sample_ids(labels(spark, [(1, 1, 0), (2, 0, 1), (3, 1, 1)]), "toxic", 4, 9, 10)).orderBy("doc_id").collect() for n in (1, 4)]
    assert rows[0] == rows[1] and [(r["doc_id"], r["y"]) for r in rows[0]] == [(1, 0), (2, 1)]


def test_rules_equal_columns(spark):
    rng = np.random.default_rng(0)
    x = rng.random((300, 3))
    y = ((x[:, 0] > 0.6) & (x[:, 1] < 0.5)).astype(float)
    rules = quality.extract_rules(x, y)
    w, b = quality.lasso_logistic(quality.rule_matrix(x, rules), y, 1e-3)
    model = quality.RuleEnsemble(["a", "b", "c"], list(zip(rules, w.tolist(), strict=True)), b)
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], "a double, b double, c double")
    got = [r[0] for r in frame.select(model.column({c: F.col(c) for c in "abc"})).collect()]
    want = 1 / (1 + np.exp(-(quality.rule_matrix(x[:50], rules) @ w + b)))
    assert np.allclose(got, want) and ((want > 0.5) == y[:50]).mean() > 0.95
