import random
import re

import numpy as np
import pytest
from wayline.llm import langid

EN, DE = "the and of that with this from have which were".split(), "der die und nicht mit sich auf eine werden sind".split()


def text(rng, words, n=30):
    return " ".join(rng.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    rows = [(text(rng, w), lang) for w, lang in ((EN, "en"), (DE, "de")) for _ in range(50)] + [(None, "fr"), ("x", None), ("", "fr")]
    return langid.train(spark.createDataFrame(rows, "text string, lang string"))


def test_languages_and_likelihoods(model):
    assert model.languages == ("de", "en")
    assert model.likelihoods("the and of that")[1] > model.likelihoods("the and of that")[0]
    assert list(model.likelihoods(None)) == [0, 0, 0]


def test_evidence(spark, model):
    rng = random.Random(2)
    rows = [(k, f"http://a.site.de/x{k}", "de", text(rng, DE)) for k in range(40)]
    rows += [(100 + k, f"https://b.other.com/en/{k}", None, text(rng, EN)) for k in range(40)]
    rows += [(200, "http://c.site.de/", None, None), (201, "http://n.other.com/en", None, ""), (202, None, "de-AT", None), (203, None, None, "#$%@!{}[] 你好 ~~^^ 123 你好 ''||" * 5)]
    rows += [(204, "not a url", "klingon", text(rng, EN)), (None, None, None, text(rng, DE)), (0, *rows[0][1:])]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, url string, declared string, text string, says string")
    for small in (1000, 0):
        got = langid.identify(df, model, declared="declared", url="url", small=small).collect()
        assert len(got) == len(rows)
        by = {r.doc_id: r for r in got}
        assert all(by[k].language == "de" and by[k].accepted for k in range(40))
        assert all(by[100 + k].language == "en" and by[100 + k].accepted for k in range(40))
        assert by[200].language == "de" and by[201].language == "en" and by[202].language == "de"
        assert by[203].language == langid.UNKNOWN and not by[203].accepted
        assert by[204].language == "en" and by[None].language == "de"
        assert all(0 < r.confidence <= 1 for r in got)


def test_rare_labels_and_copies(spark):
    """A language with few rows among very many is learned on all of them; a repeated text counts once."""
    rng = random.Random(3)
    rare = [f"{c}q{d}ux" for c in "aeiou" for d in "bcdfg"]
    rows = [(text(rng, EN, 8), "en") for _ in range(3000)] + [(text(rng, rare), "xx") for _ in range(3)]
    labelled = spark.createDataFrame(rows, "text string, lang string").repartition(3)
    few = langid.train(labelled, max_rows=100)
    whole = langid.train(labelled.where("lang = 'xx'"))
    assert (few.logs[:, few.languages.index("xx")] == whole.logs[:, 0]).all()
    copies = labelled.unionByName(spark.createDataFrame([rows[-1]] * 50 + [rows[0]] * 2000, "text string, lang string"))
    assert (langid.train(copies, max_rows=100).logs == few.logs).all()


def test_every_distinct_text_is_learned(spark):
    """However many texts a language has, the model is that of all of them, each once."""
    rng = random.Random(5)
    texts = [f"{text(rng, EN, 3)} {chr(97 + k % 26)}{chr(97 + k // 26 % 26)}{chr(97 + k // 676)}" for k in range(12_000)]
    rows = [(t, "en") for t in texts + texts[:500] * 3] + [(texts[0], "de"), (texts[1].upper(), "de"), (texts[1].upper(), "de")]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string").repartition(3))
    for k, own in enumerate((set(texts[:1] + [texts[1].upper()]), set(texts))):
        counts = sum(np.bincount(codes, minlength=1 << langid.BITS) for t in own for codes in langid._codes(t))
        want = np.log((1 - langid.UNIFORM) * counts / counts.sum() + langid.UNIFORM / (1 << langid.BITS))
        assert np.allclose(model.logs[:, k], want, rtol=1e-6)


def test_counts_follow_the_texts_not_their_partitions(spark, monkeypatch):
    """Many small partitions don't make a row for each trigram again and again; the model is the same."""
    rng, made = random.Random(8), []
    labelled = spark.createDataFrame([(text(rng, w), lang) for w, lang in ((EN, "en"), (DE, "de")) for _ in range(600)], "text string, lang string")
    frame = type(labelled)
    run = frame.mapInArrow

    def counted(self, f, schema):
        made.append(run(self, f, schema).count())
        return run(self, f, schema)

    monkeypatch.setattr(frame, "mapInArrow", counted)
    few, many = (langid.train(labelled.repartition(n)) for n in (1, 60))
    assert (few.logs == many.logs).all()
    assert made[1] <= spark.sparkContext.defaultParallelism * made[0]


def test_many_labels(spark):
    """No label falls to the unknown language for being one of many."""
    rng = random.Random(4)
    words = {f"l{k:02}": [f"{chr(97 + k % 26)}{chr(97 + k // 26)}{c}{d}" for c in "aeiou" for d in "bdfk"] for k in range(70)}
    rows = [(text(rng, w), lang) for lang, w in words.items() for _ in range(3)]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "doc_id long, text string, lang string").repartition(3)
    model = langid.train(df)
    assert len(model.languages) == 70
    got = langid.identify(df, model, declared="lang").join(df, "doc_id").collect()
    assert len(got) == 210 and all(r.language == r.lang and r.accepted for r in got)
    with pytest.raises(ValueError):
        langid.train(df, max_languages=64)


def test_empty_tables(spark, model):
    df = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.identify(df, model, declared="lang").count() == 0
    none = langid.train(df)
    one = spark.createDataFrame([(1, "the", "en")], "doc_id long, text string, lang string")
    assert langid.identify(one, none, declared="lang").first().language == langid.UNKNOWN


def test_queries(spark):
    from wayline.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op7_language_id"](spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet"), "doc_id").collect()
    assert len(rows) == 1000 and sum(r.language == r.lang and r.accepted for r in rows) > 990
    pages = QUERIES["pages_language_id"](spark, sf).collect()
    assert len(pages) == 250 and sum(r.accepted for r in pages) > 245


def fused(rows, model):
    """Posteriors of ``(id, url, declared, text)`` row by row, from the counts of all rows."""
    names = [*model.languages, langid.UNKNOWN]
    ll = [model.likelihoods(t) for *_, t in rows]
    says = [int(np.argmax(x)) for x in ll]
    find = lambda pattern, s: (m[1].lower() if (m := re.search(pattern, s or "")) else "")
    host = [find(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)", u) or None for _, u, _, _ in rows]
    domain = [find(r"([^.]+\.[^.]+)$", h) or None for h in host]
    path = [find(r"^[^:]+://[^/]+/([A-Za-z]{2})(?:[-_][A-Za-z]{2})?(?:[/?#]|$)", u) for _, u, _, _ in rows]
    suffix = [None if h is None else "/".join(x for x in (h.split(".")[-1], p) if x or x == h.split(".")[-1]) for h, p in zip(host, path)]
    told = [find("^([A-Za-z]+)", (d or "").strip()) or None for _, _, d, _ in rows]
    told = [d if d is None or d in names else "other" for d in told]
    width, n = len(names), len(rows)
    tally = lambda pick: np.array([sum(pick(j) and says[j] == k for j in range(n)) for k in range(width)], float)
    whole = tally(lambda j: True)
    share, values, out = (whole + 1) / (n + width), {d for d in told if d}, []
    spoke = tally(lambda j: told[j] is not None)
    for i in range(n):
        own = np.eye(width)[says[i]]
        others = lambda key: (tally(lambda j: key[j] == key[i]) if key[i] is not None else own) - own  # noqa: E731, B023
        p = share
        for key in (domain, host):
            c = others(key)
            p = (c + langid.KAPPA * p) / (c.sum() + langid.KAPPA)
        score = ll[i] + np.log(p)
        if suffix[i] is not None:
            whole_suffix = tally(lambda j: suffix[j] == suffix[i])  # noqa: B023
            score = score + np.log((whole_suffix - own + langid.KAPPA * whole_suffix.sum() / n) / (whole + langid.KAPPA))
        if told[i]:
            score = score + np.log((tally(lambda j: told[j] == told[i]) + 0.5) / (spoke + 0.5 * (len(values) + 1)))  # noqa: B023
        q = np.exp(score - score.max())
        out.append((names[int(score.argmax())], 1 / q.sum()))
    return out


def test_posteriors_by_brute_force(spark, model):
    rng = random.Random(6)
    rows = []
    for k in range(60):
        words = rng.choice([EN, DE, EN + DE])
        url = rng.choice([None, "http://a.site.de/x", "https://b.other.com/en/1", "https://c.site.de/de", "http://solo.org", "nonsense"])
        rows.append((k, url, rng.choice([None, "de", "en-GB", "fr", " "]), rng.choice([text(rng, words, 2), text(rng, words, 9), None, ""])))
    df = spark.createDataFrame(rows, "doc_id long, url string, declared string, text string").repartition(3)
    got = {r.doc_id: r for r in langid.identify(df, model, declared="declared", url="url").collect()}
    for (k, *_), (language, confidence) in zip(rows, fused(rows, model)):
        assert abs(got[k].confidence - confidence) < 1e-9 and (got[k].language == language or confidence < 0.500001)


def test_very_long_text_and_text_alone(spark, model):
    rng = random.Random(7)
    df = spark.createDataFrame([(1, text(rng, DE, 300_000)), (2, text(rng, EN, 3)), (2, text(rng, EN, 3))], "doc_id long, text string")
    assert [r.language for r in langid.identify(df, model).orderBy("doc_id").collect()] == ["de", "en", "en"]
