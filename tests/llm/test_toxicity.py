import math
import random
import time
import zlib

from wayline.llm import filters, toxicity


def test_folding():
    assert toxicity.fold("Ѕtupіd 1d10t m0r0n") == toxicity.fold("stupid idiot moron")
    assert toxicity.fold("lo​ser") == toxicity.fold("loser")
    assert toxicity.fold("stupid$$$ 100 5!") == toxicity.fold("stupid") + "$$$ 100 5!"
    assert toxicity.fold(None) == ""


def brute(text, lexicon):
    """Every start and every entry, without an automaton."""
    t = toxicity.fold(text)
    total = 0.0
    spared = set()
    for phrase in map(toxicity.fold, lexicon.exceptions):
        for s in range(len(t)):
            if t.startswith(phrase, s) and (not s or not t[s - 1].isalnum()) and not t[s + len(phrase) : s + len(phrase) + 1].isalnum():
                spared |= set(range(s, s + len(phrase)))
    for s in range(len(t)):
        if s and t[s - 1].isalnum() or s in spared:
            continue
        best = [w for e, w in lexicon.beginnings.items() if t.startswith(e, s)]
        best += [w for e, w in lexicon.words.items() if t.startswith(e, s) and not t[s + len(e) : s + len(e) + 1].isalnum()]
        total += max(best, default=0.0)
    return total


def test_automaton_matches_brute_force():
    rng = random.Random(2)
    lexicon = toxicity.Lexicon({toxicity.fold(w): 2.0 for w in ("trash", "idiot", "id")}, {"tras": 1.0, "trasha": 3.0})
    pieces = ["trash", "trash can", "trashcan", "trashy", "trashable", "idiot", "id", "1diot", "closer", " ", ", ", "-", "trаsh", ""]
    for _ in range(300):
        text = "".join(rng.choice(pieces) + rng.choice((" ", "", ".")) for _ in range(12))
        assert abs(toxicity.weigh(text, lexicon.automaton())[0] - brute(text, lexicon)) < 1e-9
    assert toxicity.weigh("x", toxicity.Lexicon(exceptions=()).automaton()) == (0.0, 0, 1)


def test_learns_words_and_beginnings(spark):
    rng = random.Random(3)
    filler = [f"w{k}x" for k in range(200)]
    rows = []
    for d in range(600):
        words = [rng.choice(filler) for _ in range(rng.randrange(20, 80))]
        toxic = int(d % 10 == 0)
        if toxic:
            words += ["grmbl", "zornig" + rng.choice(filler), "zornig" + rng.choice(filler)]
            rng.shuffle(words)
        rows.append((d, " ".join(words), toxic, 0.5))
    df = spark.createDataFrame([*rows, (None, None, None, None), (601, "", None, 0.1), (600, "GRMBL z0rnigal", 1, 0.0)], "doc_id long, text string, toxic int, score double")
    lexicon = toxicity.learn(df.where("doc_id % 2 = 0 or doc_id is null"))
    assert "grmbl".replace("i", "l") in lexicon.words and any(b.startswith("zorn") for b in lexicon.beginnings)
    got = {r.doc_id: r.score for r in toxicity.score(df, lexicon).collect()}
    assert len(got) == len(rows) + 3 and got[None] == got[601]
    for d, _, toxic, _ in rows:
        assert (got[d] >= 0.7) == bool(toxic)
    assert got[600] >= 0.7


def test_learning_and_score_by_brute_force(spark, monkeypatch):
    rng = random.Random(9)
    filler = [f"w{k}x" for k in range(60)]
    rows = []
    for d in range(400):
        toxic = int(d % 7 == 0)
        words = [rng.choice(filler) for _ in range(rng.randrange(5, 40))] + (["grmbl", "zorn" + rng.choice(filler)] if toxic else ["tame"] * (d % 2))
        rows.append((" ".join(words), toxic))
    docs, n_toxic = [(set(toxicity._WORD.findall(toxicity.fold(t))), y) for t, y in rows], sum(y for _, y in rows)
    n_clean, counts = len(rows) - n_toxic, {}
    for words, y in docs:
        for e in {(w, True) for w in words if len(w) > 2} | {(w[:k], False) for w in words for k in range(4, 8) if len(w) >= k}:
            counts.setdefault(e, [0, 0])[y] += 1
    tested, base, want = sum(c[1] >= 3 for c in counts.values()), n_toxic / len(rows), {}
    for e, (clean, toxic) in counts.items():
        n, share = clean + toxic, toxic / (clean + toxic)
        evidence = n * (share * math.log(share / base) + ((1 - share) * math.log((1 - share) / (1 - base)) if share < 1 else 0)) if toxic else 0
        if toxic >= 3 and share >= 0.9 and evidence >= math.log(10 * tested):
            want[e] = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))
    df = spark.createDataFrame(rows, "text string, toxic int")
    lexicon = toxicity.learn(df)
    got = {(e, True): w for e, w in lexicon.words.items()} | {(e, False): w for e, w in lexicon.beginnings.items()}
    assert got.keys() == want.keys() and len(want) > 3 and all(abs(got[e] - want[e]) < 1e-9 for e in want)
    scores = sorted((r.score, r.n_matches) for r in toxicity.score(df, lexicon).collect())
    one = toxicity.score(df.limit(1), lexicon).first()
    rate = math.log1p(100 * brute(rows[0][0], lexicon) / (len(rows[0][0].split()) + 20))
    assert abs(one.score - 1 / (1 + math.exp(-(lexicon.intercept + lexicon.slope * rate)))) < 1e-9
    # a lexicon of several parts finds the same
    monkeypatch.setattr(toxicity, "PART", 2)
    parted = toxicity.learn(df)
    assert parted.n_parts > 1 and not parted.words
    assert abs(parted.slope - lexicon.slope) < 1e-6
    again = sorted((r.score, r.n_matches) for r in toxicity.score(df, parted).collect())
    assert all(a[1] == b[1] and abs(a[0] - b[0]) < 1e-6 for a, b in zip(scores, again)) and len(scores) == len(again)


def test_many_exceptions_take_one_pass():
    lexicon = toxicity.Lexicon({"trash": 2.0})
    text = "trash can trash " * 40_000
    t = time.process_time()
    assert toxicity.weigh(text, lexicon.automaton())[1] == 40_000
    assert time.process_time() - t < 10


def test_one_class_and_empty(spark):
    df = spark.createDataFrame([(1, "a b", 0)], "doc_id long, text string, toxic int")
    for some in (df, df.limit(0)):
        lexicon = toxicity.learn(some)
        assert not lexicon.words and 0 < toxicity.score(df, lexicon).first().score < 1


def test_query_on_held_out_labels(spark):
    from wayline.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op2_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id", "left").collect()
    assert len(rows) == 1000
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    judged = [r for r in rows if r.held_out and r.toxic is not None]
    pairs = [(a.score, b.score) for a in judged if a.toxic for b in judged if not b.toxic]
    auc = sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs)
    assert auc > 0.8 and not any(r.predicted for r in judged if not r.toxic)


def test_labels_meet_their_documents(spark, monkeypatch):
    docs = spark.createDataFrame([(d, f"t{d}") for d in [*range(300), 5, None]], "doc_id long, text string")
    labels = spark.createDataFrame([(d, 0, d % 2) for d in range(0, 400, 3)] + [(6, 0, 1), (None, 0, 1), (9, 0, None)], "doc_id long, quality int, toxic int")
    may = lambda d: zlib.crc32(str(d).encode()) % 3 != 1
    known = {d: d % 2 for d in range(0, 400, 3) if may(d)} | ({6: 1} if may(6) else {})
    want = sorted((f"t{d}", known[d]) for d in [*range(300), 5] if d in known)
    for bits in (1 << 24, 64, 8192):
        monkeypatch.setattr(filters, "MOST_BITS", bits)
        assert sorted(tuple(r) for r in toxicity.join_labels(docs, labels).collect()) == want
    assert toxicity.join_labels(docs, labels.limit(0)).count() == 0


def test_folding_is_linear_in_the_text():
    texts = ["б" * 999_999 + "o", "б" * 500_000 + "аo", "0" * 1_000_000, "字" * 1_000_000 + "ｂ", "@" * 1_000_000, "0@" * 500_000 + "a", "a|" * 500_000]
    for text in texts:
        began = time.perf_counter()
        toxicity.fold(text)
        assert time.perf_counter() - began < 5, text[:4]


def test_folding_of_runs():
    assert toxicity.fold("1d10t! $0 @!b 0") == "ldlot! $0 @!b 0"
    assert toxicity.fold("бes") == "бes" and toxicity.fold("иdiоt ｂｅ") == "иdlot be"
