import random

import numpy as np
import xxhash
from wayline.llm import simhash

SCHEMA = "doc_id long, text string, fp string, node string"


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - 2)
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 3]), seed=42) for i in range(n)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > n)


def brute(rows):
    prints = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted((str(d), f"{p:016x}", least.get(find(i))) for i, ((d, _), p) in enumerate(zip(rows, prints)))


def test_matches_brute_force(spark):
    rng = random.Random(1)
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    rows = [(0, None), (1, ""), (2, " \t\n"), (3, "One"), (4, "one TWO"), (5, "One two three"), (5, "One two three"), (None, "one two three"), (None, "x y z")]
    for i in range(40):
        base = [rng.choice(words) for _ in range(150)]
        for j in range(3):
            rows.append((100 + 10 * i + j, " ".join(base)))
            base[rng.randrange(150)] = rng.choice(words)
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], SCHEMA)
    got = simhash.near_duplicates(df).collect()
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in got) == brute(rows)


def test_long_text_is_cut_at_words_only(monkeypatch):
    text = " ".join(f"w{i % 97} Éa" for i in range(3000))
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "_BLOCK", 50)
    assert simhash.fingerprint(text) == whole == brute_fingerprint(text)


def links_of(fps):
    """All pairs that are connected by links within one key's group, of any variant and rotation."""
    groups = {}
    for f in map(int, fps):
        at = 0
        for k, length in enumerate(simhash.SEGMENTS):
            second = simhash.SEGMENTS[(k + 1) % 3]
            turned = (f >> at | f << (64 - at)) & (2**64 - 1)
            fixed = (1 << (length + second)) - 1
            for j in range(second + 1):
                mask = fixed & ~(1 << (length + j - 1)) if j else fixed
                groups.setdefault((32 * k + j, turned & mask), []).append(f)
            at += length
    for (variant, _), members in groups.items():
        if len(members) > 1:
            a, b = simhash._chains(variant, np.array(members, np.uint64))
            yield from zip(a.tolist(), b.tolist())


def test_chains_connect_all_links_in_small_and_large_groups(monkeypatch):
    rng = random.Random(2)
    center = rng.getrandbits(64)
    fps = {center}
    while len(fps) < 150:
        fps.add(rng.choice(sorted(fps)) ^ 1 << rng.randrange(64) ^ (rng.random() < 0.5) << rng.randrange(64))
    fps = sorted(fps)
    near = [(a, b) for i, a in enumerate(fps) for b in fps[:i] if (a ^ b).bit_count() <= 2]
    for limit in (64, 1):
        monkeypatch.setattr(simhash, "PAIRWISE", limit)
        root = {f: f for f in fps}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in links_of(fps):
            assert (a ^ b).bit_count() <= 2
            root[find(a)] = find(b)
        assert all(find(a) == find(b) for a, b in near)


def test_empty_table(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0
