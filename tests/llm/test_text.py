"""Problems 6, 7 and 8."""

import random

import numpy as np
import pytest

from depgraph.llm import harm, mixing, tokens

DOC = "doc_id bigint, text string, lang string, source string, ids string, rate string, copies string, score string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, "", "", "", "") for i, t, s in rows], DOC)


def long_texts():
    r = random.Random(1)
    words = ["it's", "we'll", "  ", "\n\n", "naïve", "数据表", "x" * 40, "12345", "<|endoftext|>", "😀", "a", "\t", "don't!?", "\u200b"]
    return ["".join(r.choice(words) + r.choice((" ", "", "\n")) for _ in range(4000)), "a" * 5000, " " * 5000 + "x", "\n \n" * 2000, None, "", "plain"]


def test_chunked_ids_are_those_of_the_whole(spark):
    texts = long_texts()
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(0, texts[0], "s"), (None, texts[0], "s")]
    got = tokens.encode_documents(docs(spark, rows), chunk=900, overlap=120).collect()
    assert len(got) == len(rows)
    for key, ids in got:
        text = texts[key or 0]
        assert ids == tokens.encode(text) and tokens.decode(ids) == (text or "")
    counted = tokens.with_token_counts(docs(spark, rows), "doc_id", "source").collect()
    assert sorted((k or 0, n) for k, _, n in counted) == sorted((k or 0, len(ids)) for k, ids in got)
    assert tokens.encode_documents(docs(spark, [])).collect() == []
    assert 50256 not in tokens.encode("<|endoftext|>")


def test_stitching_of_chunks():
    enc, r, cases = tokens.encoding(), random.Random(5), []
    alphabet = ["a", "b ", " ", "\n", "'ll", "9", "!?", "数", "é", " the", "\t\t", "x" * 30]
    for n in (1, 30, 200, 1000):
        cases += ["".join(r.choice(alphabet[:m]) for _ in range(n)) for m in (1, 3, 6, len(alphabet)) for _ in range(6)]
    for text in cases:
        for chunk, overlap in ((40, 12), (41, 20), (300, 9)):
            spans = tokens.chunk_spans(len(text), chunk, overlap)
            parts = [tokens.encode_chunk(enc, k, a, b, len(text), text[a : b + overlap], overlap) for k, (a, b) in enumerate(spans)]
            assert tokens.stitch(enc, parts, overlap) == tokens.encode(text), (text, chunk, overlap)
    assert tokens.resynchronise([3, 5, 9], [4, 5, 9]) == 5 and tokens.resynchronise([1], [2]) is None


def test_same_ids_as_the_other_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(f"{tokens.TOKENIZERS}/byte_bpe_50k.json")
    t.encode_special_tokens = True
    for text in long_texts():
        if text:
            assert tokens.encode(text) == t.encode(text, add_special_tokens=False).ids


TARGET = "source string, target_share double, max_repeats int, most int"


def test_mix_reaches_its_shares(spark):
    r = random.Random(2)
    rows, key = [], 0
    for source, n in (("A", 3000), (" b ", 200), ("c", 60), ("other", 50), (None, 20)):
        for _ in range(n):
            key += 1
            rows.append((key, " ".join(["word"] * r.randrange(1, 60)), source))
    rows += [(key + 1, None, "a"), (key + 2, "", "a"), (None, "x", "a")]
    targets = spark.createDataFrame([("a", 0.5, 1, 0), ("b", 0.3, 2, 0), ("c", 0.15, 4, 0), ("none", 0.05, 9, 0), (None, 0.2, 1, 0), ("b", None, 1, 0)], TARGET)
    mixed = mixing.mix(docs(spark, rows), targets)
    table = {x["source"]: x for x in mixing.shares(mixed, targets).collect()}
    for s, want in (("a", 0.5 / 0.95), ("b", 0.3 / 0.95), ("c", 0.15 / 0.95)):
        assert table[s]["reached_share"] == pytest.approx(want, abs=0.01)
        assert table[s]["most_copies"] <= {"a": 1, "b": 2, "c": 4}[s]
    assert table["none"]["mixed_tokens"] == 0
    got = {x["doc_id"]: x for x in mixed.collect()}
    assert len(got) == len(rows) - 1 and got[key + 1]["copies"] == 0 and all(x["copies"] == 0 for x in got.values() if x["source"] in (None, "other"))
    again = {x["doc_id"]: x["copies"] for x in mixing.mix(docs(spark, rows[::-1]), targets).collect()}
    assert again == {k: x["copies"] for k, x in got.items()}


def test_mix_with_a_total_too_large_and_without_documents(spark):
    rows = [(i, "some words of text", "a" if i % 2 else "b") for i in range(200)]
    targets = spark.createDataFrame([("a", 0.5, 1, 0), ("b", 0.5, 3, 0)], TARGET)
    size = len(tokens.encode("some words of text"))
    by = {x["source"]: x for x in mixing.shares(mixing.mix(docs(spark, rows), targets, 300 * size), targets).collect()}
    assert by["a"]["mixed_tokens"] == 100 * size and by["b"]["mixed_tokens"] == pytest.approx(200 * size, abs=2 * size)
    assert mixing.mix(docs(spark, []), targets).collect() == []
    assert {x["copies"] for x in mixing.mix(docs(spark, rows), targets.where("false")).collect()} == {0}


def test_targets():
    assert mixing.total_and_targets({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}, None) == (40.0, {"a": 20.0, "b": 20.0})
    total, aims = mixing.total_and_targets({"a": 100, "b": 10}, {"a": 0.5, "b": 0.5}, {"a": 1, "b": 2}, 100.0)
    assert aims == {"b": 20, "a": 80.0} and mixing.total_and_targets({}, {"a": 1.0}, {"a": 1}, None) == (0.0, {})


def test_spellings_become_one():
    for w in ("idiot", "IDIOT", "1d10t", "id\u200biot", "i d i o t", "i.d.i.o.t", "idiooooot", "ıdiot".replace("ı", "i"), "іdiot"):
        assert harm.normal_words(w) == ["idiot"], w
    assert harm.normal_words("li#k") == ["li?k"] and harm.normal_words("") == [] and harm.normal_words("0x12345678") in (["#"], [])


def sample(n, seed):
    r = random.Random(seed)
    nouns = [f"{a}{b}" for a in ("tick", "ledg", "pars", "brok", "cach", "met") for b in ("et", "er", "or", "a")]
    plain = ["The {} calls the {} before it closes.", "Rename the {} to {} so that search finds it.", "I hate this {} because the {} is slow.", "Kill the {} when the {} stops."]
    bad = ["You are a stupid {} and nobody likes you.", "Shut up, you worthless idiot, and take your {}.", "All those people should be wiped out, {}.", "I want to lick you, {}."]
    out = []
    for _ in range(n):
        text = [r.choice(plain).format(r.choice(nouns), r.choice(nouns)) for _ in range(r.randrange(1, 6))]
        y = r.random() < 0.25
        if y:
            line = r.choice(bad).format(r.choice(nouns))
            text.insert(r.randrange(len(text) + 1), line.replace("i", "1") if r.random() < 0.3 else line)
        out.append((" ".join(text), float(y)))
    return out


def test_held_out_accuracy_despite_wrong_labels():
    train, test, r = sample(700, 1), sample(300, 2), random.Random(3)
    y = np.array([v if r.random() > 0.04 else 1 - v for _, v in train])
    m = harm.fit([t for t, _ in train], ["en"] * 700, y)
    p = harm.Scorer(m).score([t for t, _ in test]) >= m.thresholds["en"]
    truth = np.array([v for _, v in test]) > 0.5
    assert (p & truth).sum() / max(1, p.sum()) > 0.95 and (p & truth).sum() / truth.sum() > 0.95


def test_long_texts_score_like_their_worst_part():
    m = harm.fit(*zip(*[(t, "en") for t, _ in sample(300, 1)]), np.array([v for _, v in sample(300, 1)]))
    s = harm.Scorer(m)
    worst = "Shut up, you worthless idiot, and take your ticket."
    plain = "The ticket calls the ledger before it closes. " * 30_000
    a, b = s.score([worst, plain + worst])
    assert abs(a - b) < 1e-5 and s.score([None, "", "123", "\u200b"]).tolist() == [0, 0, 0, 0]


def test_scores_over_tables(spark):
    rows = [(i, t, ("Issue", " issue", None)[i % 3]) for i, (t, _) in enumerate(sample(200, 4))] + [(900, None, "issue"), (901, "", "wiki"), (None, "x", "wiki")]
    labels = spark.createDataFrame([(i, "a", int(v), "x") for i, (_, v) in enumerate(sample(200, 4))] + [(0, "b", None, "x"), (None, "b", 1, "x"), (5000, "b", 1, "x")], "doc_id bigint, rater string, harmful int, text string")
    got = harm.score_documents(docs(spark, rows), labels)
    assert got.count() == len(rows) and got.where("doc_id >= 900 AND harmful").count() == 0
    rates = {r["source"]: r["n_docs"] for r in harm.rates(got).collect()}
    assert set(rates) == {"issue", "wiki", None} and sum(rates.values()) == len(rows)
    assert harm.score_documents(docs(spark, rows), labels.where("false")).where("harmful").count() == 0
    some = sorted(harm.labelled(docs(spark, rows), labels).collect(), key=lambda r: r["doc_id"])
    here, there = harm.fit([r["text"] for r in some], [r["lang"] for r in some], np.array([r["harmful"] for r in some])), harm.train(docs(spark, rows), labels)
    assert here.thresholds == there.thresholds and np.array_equal(here.out, there.out)
    assert harm.labelled(docs(spark, rows), labels, characters=500).agg({"*": "count"}).first()[0] < 20
    assert harm.score_documents(docs(spark, []), labels).collect() == []
    assert harm.language("EN-xx") == "en" and harm.language("und") == "" and harm.language(None) == ""


def test_doubt_does_not_grow_with_labels(monkeypatch):
    fitted, calibrated, new = [], [], harm.Model.new(1)
    monkeypatch.setattr(harm, "_train", lambda docs, feats, y, seed: fitted.append(len(docs)) or new)
    monkeypatch.setattr(harm, "_threshold", lambda p, y, w: calibrated.append(len(p)) or 0.5)
    monkeypatch.setattr(harm, "Scorer", lambda m: type("S", (), {"score": lambda self, texts: np.array([float(t) for t in texts])})())
    y = np.array([1.0] * 450 + [0.0] * 350)
    harm.fit(["0.2"] * 440 + ["0.01"] * 10 + ["0.1"] * 350, ["en"] * 800, y)
    assert fitted[-1] == 790 and calibrated == [800, 800]
