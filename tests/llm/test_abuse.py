import random

from almagest.llm import abuse
from almagest.llm.tokens import token_count


def test_clean_words():
    assert abuse.phrases("You 1d10t, get lo​st P A R A S I T E now") == [("you", "idiot"), ("get", "lost", "parasite", "now")]
    assert abuse.phrases("d.i.c.k.h.e.a.ds closed at 7.4% in Q3") == [("dickheads", "closed", "at", "#", "in", "#")]
    assert abuse.phrases("lossseeerrr l0$3r аsshоlе") == [("loser", "loser", "ashole")]
    assert abuse.phrases(None) == abuse.phrases("") == abuse.phrases(" \n--!!") == []


def corpus(n, seed):
    rng = random.Random(seed)
    plain = ["the order book improved in Q{}", "bought {} shares at the open", "kill the order and resend at {}", "what the hell was that print of {}", "a rule: nobody may call others idiots, see page {}"]
    bad = ["you {} idiot", "listen you {} loser, get lost", "only a {} idiot like you would buy this"]
    out = []
    for _ in range(n):
        toxic = rng.random() < 0.3
        parts = [rng.choice(plain).format(rng.randint(1, 99)) for _ in range(rng.randint(1, 12))]
        if toxic:
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(bad).format(rng.choice(["useless", "pathetic", "stupid", "dumb"])))
        out.append((". ".join(parts), toxic, toxic if rng.random() > 0.03 else not toxic))
    return out


def test_held_out():
    """One sentence of many, labels partly wrong."""
    train, test = corpus(600, 1), corpus(400, 2)
    model = abuse.fit([t for t, _, _ in train], [x for _, _, x in train])
    found = [model.score(t) >= model.threshold for t, _, _ in test]
    hits = sum(f and y for f, (_, y, _) in zip(found, test))
    assert hits / sum(found) > 0.95 and hits / sum(y for _, y, _ in test) > 0.95
    assert model.score("WHAT THE HELL WAS THAT PRINT OF 7") < model.threshold
    assert model.score("the order book improved - you us3l3ss 1d10t!") >= model.threshold


def test_probabilities_sum_to_one():
    rows = {("a", "b"): [2.0, 1.0], ("b", "c", "a"): [1.0, 3.0], ("c",): [0.0, 2.0]}
    toxic, ordinary = abuse._models(rows)
    for model in (toxic, ordinary):
        total = sum(model.probability(("<s>", "b", w)) for w in ("a", "b", "c", "</s>"))
        assert 0.9 < total <= 1.0 + 1e-9


def test_spark(spark):
    rows = [(i, t, "s", y) for i, (t, _, y) in enumerate(corpus(300, 3))]
    rows += [(900, None, "s", False), (901, "", None, False), (902, "   ", "s", False), (903, "the order book improved " * 20000, "s", False)]
    docs = spark.createDataFrame([r[:3] + (1.0,) for r in rows], "doc_id long, text string, source string, score double")
    labels = spark.createDataFrame([(i, r[0], "Abusive " if r[3] else "clean", None) for i, r in enumerate(rows)] + [(5000, None, "clean", None), (5001, 1, None, None)], "label_id long, doc_id long, verdict string, reviewed_at timestamp")
    model = abuse.train(docs, labels)
    got = {r.doc_id: r for r in abuse.scored(docs, model).collect()}
    assert len(got) == len(rows) and not any(got[i].found for i in (900, 901, 902, 903)) and got[900].score is None
    assert 60 < sum(r.found for r in got.values()) < 130
    nothing = abuse.train(docs, labels.limit(0))
    assert not any(r.found for r in abuse.scored(docs, nothing).collect())
    assert abuse.scored(docs.limit(0), model).count() == 0


def test_tokens(spark):
    df = spark.createDataFrame([("Hello world",), ("",), (None,), ("<|endoftext|>",), ("ab " * 50000,)], "text string")
    assert [r[0] for r in df.select(token_count("text")).collect()][:3] == [2, 0, 0]
