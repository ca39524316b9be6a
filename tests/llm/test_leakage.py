import random
import re

from evidloom.llm import leakage as L

WORD = re.compile(r"[^\W_]+")


def brute(docs, items, least):
    grams = {}
    for i, t in items.items():
        w = [x.casefold() for x in WORD.findall(t or "")]
        for k in range(len(w) - least + 1):
            grams.setdefault(tuple(w[k : k + least]), set()).add(i)
    found = set()
    for d, t in docs.items():
        w = [x.casefold() for x in WORD.findall(t or "")]
        for k in range(len(w) - least + 1):
            found |= {(d, i) for i in grams.get(tuple(w[k : k + least]), ())}
    return found


def run(spark, docs, items, **more):
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    i = spark.createDataFrame(list(items.items()), "item_id long, text string")
    return L.leaked_spans(d, i, **more)


def cases(seed):
    rnd = random.Random(seed)
    words = ["alpha", "Straße", "beta", "x1", "ÜBER", "gamma", "don", "t"]
    say = lambda n: "".join(rnd.choice(words) + rnd.choice([" ", ", ", "\n", "_", " - "]) for _ in range(n))
    items = {k: say(rnd.randint(0, 14)) for k in range(25)} | {98: None, 99: ""}
    docs = {k: say(rnd.randint(0, 200)) for k in range(30)}
    for k in range(30, 60):
        item = items[rnd.randrange(25)]
        docs[k] = (say(5) + rnd.choice([item.upper(), item.lower(), item.replace(" ", " . ")]) + say(9)) if item else None
    return docs, items


def test_equals_brute_force(spark):
    for seed in (1, 2):
        docs, items = cases(seed)
        want = brute(docs, items, 5)
        assert want
        assert {(r.doc_id, r.item_id) for r in run(spark, docs, items, least=5).collect()} == want
        assert {(r.doc_id, r.item_id) for r in run(spark, docs, items, least=5, block_words=30).collect()} == want


def test_spans_and_removal(spark):
    item = "one two three four five six seven eight nine ten eleven twelve thirteen"
    docs = {1: "Before. ONE, two three four five six seven eight nine ten eleven twelve; after", 2: "clean text", 3: None, 4: item * 1, 5: "x " * 2000 + item}
    spans = run(spark, docs, {7: item})
    got = {(r.doc_id, r.item_id): (r.words, docs[r.doc_id][r.start : r.end]) for r in spans.collect()}
    assert got[1, 7] == (12, docs[1][8:-7]) and got[4, 7] == (13, item) and set(got) == {(1, 7), (4, 7), (5, 7)}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    cleaned = {r.doc_id: (r.text, r.removed) for r in L.remove_leaks(d, spans, longest=12, coverage=0.5).collect()}
    assert cleaned[1] == ("Before.  ; after", len(docs[1]) - 15) and cleaned[2] == ("clean text", 0) and cleaned[3] == (None, 0)
    assert cleaned[4] == ("", len(item)) and cleaned[5] == ("x " * 2000 + " ", len(item))


def test_long_items_are_cut_and_joined_again(spark):
    rnd = random.Random(3)
    long = [f"w{rnd.randrange(40)}" for _ in range(400)]
    items = {1: " ".join(long), 2: " ".join(long[50:70]), 3: "other words"}
    docs = {1: " ".join(long[20:300]), 2: "x " + " ".join(long[45:80]) + " y", 3: "nothing here", 4: " ".join(long)}
    whole = {tuple(r) for r in run(spark, docs, items, least=5).collect()}
    assert whole and {tuple(r) for r in run(spark, docs, items, least=5, block_words=30).collect()} == whole
    assert (4, 1, 400, 0, len(docs[4])) in whole


def test_a_passage_of_several_items_counts_once(spark):
    passage = "one two three four five six seven eight nine ten eleven twelve"
    docs = {1: "y " * 1500 + passage}
    spans = run(spark, docs, {1: passage, 2: passage, 3: passage + " more"})
    assert spans.count() == 3
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    assert L.remove_leaks(d, spans).first().removed == 0
    assert L.remove_leaks(d, spans, coverage=0.02).first().removed == len(passage)


def test_empty(spark):
    assert run(spark, {}, {1: "a b c"}).count() == 0
    assert run(spark, {1: "a b c"}, {}, least=2).count() == 0
