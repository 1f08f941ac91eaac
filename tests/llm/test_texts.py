from ledgerfold.llm.leakage import ItemIndex, find_leaks, leaks
from ledgerfold.llm.toxicity import Scorer, features, fit, score_documents, sentences, tidy, train

ITEM = "State the reason that the hosozudota nozzle loses contact with its preloaded novutewuras valve as soon as somebody sets 311 MHz, ignoring any terminal disclaimer."
OTHER = "State the reason that the caberamecor turbine shares its clock with any dielectric mazidihiro interpreter once the ledger shows 191 MHz, with the arithmetic written out."


def test_leaks():
    # names are words that hardly another item has, so the index holds more items of the same wording
    alike = [(100 + i, base.replace("hosozudota", f"ranome{i}dul").replace("novutewuras", f"bisuke{i}lon").replace("caberamecor", f"vodina{i}fir").replace("mazidihiro", f"tugewa{i}bas").replace("311", str(500 + i)).replace("191", str(600 + i))) for i, base in enumerate([ITEM, OTHER] * 6)]
    index = ItemIndex([*alike, (1, ITEM), (2, OTHER), (3, ""), (4, "記憶に基づき、マヒチズルからタメボコセへ至る曲線を描け。なぜチキカギゴは719度を超えるとパスゼプテの後塵を拝するのか。")])
    found = lambda t: {index.ids[i] for i in leaks(index, t)}
    assert found("Intro.\n" + ITEM.upper() + "\nmore") == {1}
    assert found("<p>" + ITEM.replace(" ", "&nbsp;").replace("hosozudota", "hoso-\nzudota") + "</p>") == {1}
    assert found(" ".join(ITEM.split()[8:])) == {1}  # more than half
    assert found(" ".join(ITEM.split()[:7])) == set()  # a short quotation
    assert found(" ".join(sorted(ITEM.split()))) == set()  # the bare words
    assert found(ITEM.replace("hosozudota", "bimonegura").replace("novutewuras", "ravetinuko").replace("311", "42")) == set()
    assert found("x" * 100_000 + " " + ITEM + " " + OTHER) == {1, 2}
    assert found("記憶に基づき、マヒチズルから\nタメボコセへ至る曲線を描け。なぜチキカギゴは719度を超えるとパスゼプテの後塵を拝するのか。") == {4}


def test_find_leaks(spark):
    docs = spark.createDataFrame([(1, ITEM, "x"), (1, ITEM, "x"), (2, None, "x"), (3, "", "x"), (None, ITEM, "x")], "doc_id bigint, text string, item_id string")
    items = spark.createDataFrame([(9, ITEM), (8, None)], "item_id bigint, text string")
    assert [tuple(r) for r in find_leaks(docs, "doc_id", "text", items, "item_id", "text").collect()] == [(1, 9)]
    assert find_leaks(docs, "doc_id", "text", items.limit(0), "item_id", "text").count() == 0


def test_tidy():
    assert tidy("You are an 1d10t") == "you are an idiot"
    assert tidy("stuuuuupid i d i o t here") == "stupid idiot here"
    assert "馬鹿" in features(sentences("この馬鹿野郎。")[0])


def test_learning(spark):
    calm = ["The rotor turns the shaft", "A valve closes the chamber", "The sensor reads the gauge", "An antenna feeds the amplifier"]
    rude = ["You are a filthy halfwit", "Get lost you stupid moron", "You pathetic halfwit, shut up"]
    docs = [(i, f"{calm[i % 4]}. {calm[(i + 1) % 4]}. {rude[i % 3] if i % 10 == 0 else calm[(i + 2) % 4]} {i}.") for i in range(300)] + [(900, None), (901, ""), (902, "word " * 50_000)]
    labels = [(i, "ann", 1 if i % 10 == 0 else 0) for i in range(0, 150, 5)] + [(7, "ann", None)]
    d, y = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, annotator string, toxic int")
    scorer = train(d, "doc_id", "text", y, "doc_id", "toxic")
    scores = {r["doc_id"]: r["score"] for r in score_documents(d, "doc_id", "text", scorer).collect()}
    assert all((scores[i] > 0.1) == (i % 10 == 0) for i in range(150, 300)) and scores[900] == scores[901] == 0.0
    assert isinstance(train(d, "doc_id", "text", y.limit(0), "doc_id", "toxic"), Scorer) and fit([], [])[0] == {}


def test_bound_is_exact():
    import random

    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = {w: rng.uniform(-2, 2) for w in vocabulary} | {f"{a} {b}": rng.uniform(-3, 3) for a, b in (rng.choices(vocabulary, k=2) for _ in range(300))} | {"馬鹿": 2.5, "野郎": 1.0}
    s = Scorer(weights, -4.0)
    texts = [" ".join(rng.choices([*vocabulary, ".", "x。", "馬鹿野郎"], k=rng.randint(1, 120))) for _ in range(300)]
    for t in texts:
        worst = max(map(s.sentence, sentences(t)), default=-30.0)
        exact = 1 / (1 + 2.718281828459045 ** -worst)
        assert abs(s.score(t) - exact) < 1e-9 or not sentences(t)
        assert (s.score(t, 0.1) >= 0.1) == (exact >= 0.1)


def test_unlabelled_negatives_are_corrected():
    """With a third of the unlabelled being positive, the corrected risk still tells them apart."""
    import numpy as np

    from ledgerfold.llm.toxicity import _Rows, nnpu

    bad, good = np.array([0, 2]), np.array([1, 2])  # features: bad, good, both
    positive, unlabelled = _Rows([bad] * 50, np.arange(3)), _Rows([bad] * 100 + [good] * 200, np.arange(3))
    w, b = nnpu(positive, unlabelled, 3, 1 / 3)
    assert w[0] + w[2] + b > 0 > w[1] + w[2] + b and np.isfinite(w).all()


def test_items_in_ordinary_words(spark):
    """Items without coined names: passages of 60 % with a word changed are found, other sentences of the same words aren't."""
    import random

    rng = random.Random(12)
    vocabulary = [f"{a}{b}" for a in ("ba", "co", "du", "fe", "gi", "ho", "ju", "ka", "li", "mo") for b in ("ter", "lin", "rad", "son", "vek", "nup", "tal", "dor", "mis", "pag", "wen", "zor", "bel", "cid", "fur", "hap", "jem", "kiv", "luz", "nox")]
    items = [(i, " ".join(rng.choices(vocabulary, k=20))) for i in range(60)]
    docs, want = [], set()
    for i, t in items:
        w = t.split()
        s = rng.randrange(0, 8)
        part = w[s : s + 12]
        part[rng.randrange(12)] = rng.choice(vocabulary)
        docs.append((i, " ".join([*rng.choices(vocabulary, k=40), *part, *rng.choices(vocabulary, k=40)])))
        want.add((i, i))
    docs += [(1000 + i, " ".join(rng.choices(vocabulary, k=90))) for i in range(60)]
    d, e = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    for most in (1000, 25):  # one set, and several
        got = {tuple(r) for r in find_leaks(d, "doc_id", "text", e, "item_id", "text", max_items=most).collect()}
        assert len(got & want) >= 0.9 * len(want) and len(got - want) <= 3
