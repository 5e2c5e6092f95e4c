import random
import re

from wayline.llm import decontaminate


def plain_align(a, b):
    """Smith-Waterman cell by cell."""
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = decontaminate.MATCH if a[i - 1] == b[j - 1] else decontaminate.MISMATCH
            rows[i][j] = max(0, rows[i - 1][j - 1] + s, rows[i - 1][j] + decontaminate.GAP, rows[i][j - 1] + decontaminate.GAP)
    return max(map(max, rows))


def test_alignment_matches_cell_by_cell():
    rng = random.Random(1)
    for _ in range(300):
        a = [rng.choice("abcd") for _ in range(rng.randrange(1, 12))]
        b = [rng.choice("abcde") for _ in range(rng.randrange(1, 20))]
        assert decontaminate.align(a, b)[0] == plain_align(a, b)


def words(t):
    return re.findall(r"\w+", (t or "").lower())


def brute(docs, items):
    """Alignments of all pairs that share five words in a row, or all of a shorter item."""
    grams = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    out = {}
    for d, t in docs:
        for i, u in items:
            a, b = words(u), words(t)
            n = min(5, len(a))
            if n and grams(a, n) & grams(b, n):
                score = plain_align(a, b) / (2 * len(a))
                if score >= decontaminate.THRESHOLD:
                    out[d, i] = max(score, out.get((d, i), 0))
    return out


def test_matches_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    pool = [f"w{k}" for k in range(60)] + ["the", "of"] * 20
    items = [(k, " ".join(rng.choice(pool) for _ in range(rng.randrange(5, 40)))) for k in range(12)] + [(50, "w7 w9"), (51, None), (52, " ,"), (53, "w3 the of"), (54, "w11")]
    items.append(items[3])
    docs = [(0, None), (1, ""), (2, "x" * 3000)]
    for d in range(3, 60):
        w = [rng.choice(pool) for _ in range(rng.randrange(5, 150))]
        if d % 3 == 0:
            leak = words(rng.choice(items[:12])[1])
            for _ in range(rng.randrange(4)):
                leak[rng.randrange(len(leak))] = "edit"
            at = rng.randrange(len(w))
            w[at:at] = leak
        docs.append((d, ", ".join(w).title()))
    docs += [docs[6], (None, items[1][1])]
    df = spark.createDataFrame([(*d, "c", "c") for d in docs], "doc_id long, text string, words string, gram string").repartition(3)
    it = spark.createDataFrame([(*i, 1) for i in items], "item_id long, text string, place int")
    want = brute(docs, items)
    for chunk, block in ((1 << 20, 4_000_000), (40, 100)):
        monkeypatch.setattr(decontaminate, "_CHUNK", chunk)
        got = {(r.doc_id, r.item_id): r.score for r in decontaminate.find_leaks(df, it, block_ngrams=block).collect()}
        assert got == want and len(want) > 15


def test_many_edited_copies_beside_one_exact_copy(spark):
    item = [f"a{k}" for k in range(32)]
    copy = [f"x{k}" if k in (7, 23) else w for k, w in enumerate(item)]
    docs = [(d, " ".join(copy)) for d in range(100)] + [(100, " ".join(item))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    it = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    got = {r.doc_id: r.score for r in decontaminate.find_leaks(df, it).collect()}
    assert got == {d: (1.0 if d == 100 else (30 * 2 - 2) / 64) for d in range(101)}


def test_documents_are_read_once_and_none_are_drawn(spark):
    """What is looked for follows from the items alone."""
    rows = [(k, f"filler {k} of the text" + (" u0 u1 u2 x u4 u5 u6" if k % 3000 == 7 else "")) for k in range(12_000)]
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).mapInArrow(seen, "doc_id long, text string")
    it = spark.createDataFrame([(7, "u0 u1 u2 u3 u4 u5 u6")], "item_id long, text string")
    assert sorted(r.doc_id for r in decontaminate.find_leaks(df, it, n=1).collect()) == [7, 3007, 6007, 9007]
    assert read.value == len(rows)


def edited(rng, item, share):
    """A copy with words replaced, left out and put in."""
    out = []
    for w in item:
        if rng.random() < share:
            out += rng.choice([["edit"], [], [w, "more"]])
        else:
            out.append(w)
    return out


def test_matches_alignment_of_all_pairs(spark):
    """Without a run of words in common, for items of all lengths and heavy edits."""
    rng = random.Random(3)
    pool = [f"w{k}" for k in range(300)] + ["the", "of"] * 50
    items = [(k, [rng.choice(pool) for _ in range(rng.randrange(5, 60))]) for k in range(25)]
    items += [(25 + k, [rng.choice(pool) for _ in range(1 + k % 4)]) for k in range(16)] + [(41, ["w1", "w1", "w2"]), (42, ["w5"] * 4)]
    items.append((90, [f"u{k}" for k in range(14)]))
    docs = [(0, [w if k not in (4, 9) else "edit" for k, w in enumerate(items[-1][1])])]
    docs.append((1, [x for w in items[-1][1] for x in (w, "in")]))  # a word put in after each
    for d in range(2, 150):
        w = [rng.choice(pool) for _ in range(rng.randrange(0, 250))]
        at = rng.randrange(len(w) + 1)
        w[at:at] = edited(rng, rng.choice(items)[1], rng.choice([0.1, 0.2, 0.3, 0.4]))
        docs.append((d, w))
    want = {(d, i): s for d, w in docs for i, u in items if (s := decontaminate.align(u, w)[0] / (2 * len(u))) >= decontaminate.THRESHOLD}
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    apart = [(d, i) for d, i in want if not grams(dict(docs)[d]) & grams(dict(items)[i])]
    assert (0, 90) in apart and (1, 90) in apart and len(apart) > 10
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs], "doc_id long, text string").repartition(3)
    it = spark.createDataFrame([(i, " ".join(u)) for i, u in items], "item_id long, text string")
    for block in (4_000_000, 500):
        assert {(r.doc_id, r.item_id): r.score for r in decontaminate.find_leaks(df, it, n=1, block_ngrams=block).collect()} == want


def test_short_items_are_found(spark):
    df = spark.createDataFrame([(1, "on that day The cat, sat down here"), (2, "a cat and a dog")], "doc_id long, text string")
    it = spark.createDataFrame([(7, "the cat sat down"), (8, "?"), (9, "Dog")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id, r.score) for r in decontaminate.find_leaks(df, it).collect()) == [(1, 7, 1.0), (2, 9, 1.0)]
    assert sorted((r.doc_id, r.item_id, r.score) for r in decontaminate.find_leaks(df, it, n=1, threshold=0.8).collect()) == [(1, 7, 1.0), (2, 9, 1.0)]


def test_query_asks_for_no_run(spark, tmp_path):
    from wayline.llm.queries import QUERIES

    item = [f"u{k}" for k in range(14)]
    copy = [w if k not in (4, 9) else "edit" for k, w in enumerate(item)]
    spark.createDataFrame([(1, " ".join(copy))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(7, " ".join(item))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert [(r.doc_id, r.item_id) for r in QUERIES["op9_decontamination"](spark, str(tmp_path)).collect()] == [(1, 7)]


def test_span_and_empty(spark):
    item = "one two three four five six seven"
    df = spark.createDataFrame([(1, f"zero {item.upper()} eight nine")], "doc_id long, text string")
    it = spark.createDataFrame([(7, item)], "item_id long, text string")
    r = decontaminate.find_leaks(df, it).first()
    assert (r.item_id, r.score, r.start_word, r.end_word) == (7, 1.0, 1, 8)
    assert decontaminate.find_leaks(df.limit(0), it).count() == 0
    assert decontaminate.find_leaks(df, it.limit(0)).count() == 0


def test_query_finds_the_planted_passages(spark, sf_dir):
    from wayline.llm.queries import QUERIES

    norm = lambda t: f" {' '.join(words(t))} "
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()
    planted = {(d.doc_id, i.item_id) for d in docs for i in items if norm(i.text) in norm(d.text)}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op9_decontamination"](spark, sf_dir).collect()}
    assert planted and planted <= got and len(got) <= len(planted) + 2
