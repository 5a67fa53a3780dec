import random

import numpy as np

from tests.conftest import got
from tracelake.llm import leaks as K

WORDS = [f"w{i}" for i in range(400)]


def corpus(seed=1):
    rng = random.Random(seed)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.choice([3, 8, 12, 13, 20, 60])))) for i in range(30)]
    items += [(30, None), (31, ""), (32, "common words that are everywhere in each text of this corpus for sure indeed always")]
    docs = []
    for d in range(300):
        body = rng.choices(WORDS, k=rng.randrange(5, 150))
        item = rng.choice(items[:30])[1].split()
        cut = rng.randrange(1, len(item) + 1)
        start = rng.randrange(0, len(item) - cut + 1)
        at = rng.randrange(len(body))
        docs.append((d, " ".join(body[:at]) + " " + " ".join(item[start : start + cut]).upper() + " " + ", ".join(body[at:])))
        if d % 3 == 0:
            docs[-1] = (d, docs[-1][1] + "\n" + items[32][1])
    docs += [(300, None), (301, ""), (None, items[20][1]), (5, docs[5][1]), (302, " ".join(rng.choices(WORDS, k=20_000)) + " " + items[32][1])]
    return docs, items


def brute(docs, items):
    out = set()
    for d, text in docs:
        if d is None or not text:
            continue
        line = " " + " ".join(K.words(text)) + " "
        for i, body in items:
            w = K.words(body)
            if any(" " + " ".join(w[k : k + 13]) + " " in line for k in range(len(w) - 12)):
                out.add((d, i))
    return sorted(out, key=repr)


def test_against_brute_force(rows):
    docs, items = corpus()
    found = K.leaked(rows([(*d, "c", 1) for d in docs], "doc_id long, text string, words string, run int"), rows([(*i, "x") for i in items], "item_id long, text string, grams string"))
    assert got(found.where("run >= 13").select("doc_id", "item_id").distinct()) == brute(docs, items)


def test_words():
    assert K.words("The benef-\niciary of ＷＡＬＬＥＴ_9, *naïve* o­ne-two") == ["the", "beneficiary", "of", "wallet", "9", "naïve", "one", "two"]
    assert K.words("Straße") == ["strasse"] and K.words(None) == []


def plain(document, item):
    h = np.zeros((len(document) + 1, len(item) + 1), dtype=int)
    run = np.zeros_like(h)
    for i, a in enumerate(document, 1):
        for j, b in enumerate(item, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (K.MATCH if a == b else K.MISMATCH), h[i - 1, j] + K.GAP, h[i, j - 1] + K.GAP)
            run[i, j] = run[i - 1, j - 1] + 1 if a == b else 0
    return int(h.max()), int(run.max())


def test_alignment():
    rng = np.random.default_rng(2)
    for _ in range(60):
        a, b = rng.integers(0, 5, rng.integers(1, 30)), rng.integers(0, 5, rng.integers(1, 20))
        assert K.align(a, b) == plain(a, b)


def test_edited_copies_score(rows):
    rng = random.Random(4)
    item = rng.choices(WORDS, k=40)
    edited = [w for i, w in enumerate(item) if i % 9 != 4] + ["tail"]
    found = K.leaked(rows([(1, " ".join(edited)), (2, " ".join(rng.choices(WORDS, k=60)))], "doc_id long, text string"), rows([(9, " ".join(item))], "item_id long, text string"), edited=True)
    (row,) = found.collect()
    assert (row.doc_id, row.item_id) == (1, 9) and row.score > 0.7 and row.run < 13


def test_every_window_that_can_occur_has_a_seed():
    text = " ".join(random.Random(7).choices(WORDS[:60], k=100))
    items = K.Items([(1, text), (2, text)])
    width = K.MIN_RUN - K.GRAM + 1
    counts = {n: n % 7 + 1 for n in range(200) if n % 11}
    seeds = items.seeds(counts)
    numbers = [items.number[g] for g in K.grams(items.words[1])]
    windows = [set(numbers[i : i + width]) for i in range(len(numbers) - width + 1)]
    assert all(w & seeds for w in windows if w <= counts.keys())
    assert seeds <= counts.keys() and len(seeds) < len(counts) / 2


def edit(rng, tokens, every):
    """tokens with every so-manyth word replaced, left out or followed by another."""
    out = []
    for i, w in enumerate(tokens):
        kind = rng.choice("rld") if i % every == every - 1 else "k"
        out += {"r": ["other" + str(rng.randrange(99))], "l": [], "d": [w, "more"], "k": [w]}[kind]
    return out


def test_recall_of_edited_copies_against_aligning_everything(rows):
    rng = random.Random(11)
    items = [(i, " ".join(rng.choices(WORDS, k=rng.choice([1, 2, 3, 4, 6, 34, 50])))) for i in range(25)]
    docs = []
    for d in range(150):
        item = rng.choice(items)[1].split()
        body = rng.choices(WORDS, k=rng.randrange(0, 60))
        docs.append((d, " ".join(body + edit(rng, item, rng.choice([2, 3, 4, 5, 9])) + body[::-1])))
    wanted = set()
    for d, text in docs:
        tokens = text.split()
        for i, body in items:
            ids = {}
            a = np.array([ids.setdefault(w, len(ids)) for w in tokens])
            b = np.array([ids.get(w, -1) for w in body.split()])
            if K.align(a, b)[0] >= K.COPY_SHARE * K.MATCH * len(b):
                wanted.add((d, i))
    found = set(got(K.leaked(rows(docs, "doc_id long, text string"), rows(items, "item_id long, text string"), edited=True), "doc_id", "item_id"))
    # where a third of a short item is one word, no seed is left; all others are found
    long = {i for i, body in items if len(body.split()) >= 6}
    assert found <= wanted
    assert len({p for p in found if p[1] in long}) >= 0.97 * len({p for p in wanted if p[1] in long})
    assert all((d, i) in found for d, i in wanted if f" {dict(items)[i]} " in f" {dict(docs)[d]} ")


def test_scores_are_those_of_the_whole_text(rows):
    """An alignment may reach over three times the words of the item."""
    item = [f"i{n}" for n in range(20)]
    spread_out = [w for x in item[:15] for w in (x, "gap")] + item[15:]
    docs = [(1, " ".join(["before"] * 30 + spread_out + ["behind"] * 30))]
    (row,) = K.leaked(rows(docs, "doc_id long, text string"), rows([(1, " ".join(item))], "item_id long, text string"), edited=True).collect()
    ids = {}
    a = np.array([ids.setdefault(w, len(ids)) for w in docs[0][1].split()])
    assert row.score == K.align(a, np.array([ids[w] for w in item]))[0] / 40


def test_many_items_are_searched_in_blocks(rows, monkeypatch):
    docs, items = corpus()
    tables = rows(docs, "doc_id long, text string"), rows(items, "item_id long, text string")
    monkeypatch.setattr(K, "MAX_ITEM_WORDS", 200)
    assert got(K.leaked(*tables).select("doc_id", "item_id").distinct()) == brute(docs, items)


def test_the_alignment_decides(rows, monkeypatch):
    docs, items = corpus()
    monkeypatch.setattr(K, "_score", lambda *_: [])
    assert got(K.leaked(rows(docs, "doc_id long, text string"), rows(items, "item_id long, text string"))) == []


def test_no_rows(rows):
    docs, items = rows([], "doc_id long, text string"), rows([], "item_id long, text string")
    some = rows([(1, "a b c d e f g")], "doc_id long, text string")
    assert K.leaked(docs, items).count() == 0 and K.leaked(some, items).count() == 0
    assert K.leaked(docs, rows([(1, "a b c d e f")], "item_id long, text string")).count() == 0


def test_every_text_of_an_item_is_searched(rows):
    one, two = (" ".join(f"{p}{i}" for i in range(20)) for p in ("left", "right"))
    items = rows([(1, one), (1, two), (1, None)], "item_id long, text string")
    docs = rows([(10, one), (11, two), (12, one + " " + two), (13, "none of these words")], "doc_id long, text string")
    assert got(K.leaked(docs, items), "doc_id", "item_id", "score", "run") == [(d, 1, 1.0, 20) for d in (10, 11, 12)]
