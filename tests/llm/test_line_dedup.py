import random

import pytest
from wayline.llm import line_dedup

BLANKS = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(rows):
    key = lambda line: lower(line.strip(BLANKS))
    holders = {}
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                holders.setdefault(key(line), set()).add(-1 if d is None else d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        drop = lambda x: len(holders.get(key(x), ())) >= 3 and (-1 if d is None else d) < max(holders[key(x)])
        kept = [x for x in lines if not drop(x)]
        out.append((str(d), "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out)


@pytest.mark.parametrize("batches,fanout", [(1, 2), (4, 2), (7, 3)])
def test_matches_brute_force(spark, batches, fanout):
    rng = random.Random(5)
    pool = [f"Line number {i} of the SHARED pool É" for i in range(30)] + ["short", "", "  ", "\tPadded line of many characters \r"]
    rows = [(d, "\n".join(rng.choice(pool) + rng.choice(["", " ", "\t"]) for _ in range(rng.randrange(12)))) for d in range(60)]
    rows += [(7, None), (7, ""), (None, pool[0]), (None, pool[0]), (61, "\n"), (3, rows[3][1])]
    df = spark.createDataFrame([(d, t, 1, "z") for d, t in rows], "doc_id long, text string, n_lines int, doc string")
    out = line_dedup.dedup_lines(df, batches=batches, fanout=fanout)
    assert out.columns == ["doc_id", "text", "doc", "kept_text", "n_lines", "n_dropped"]
    assert sorted((str(r.doc_id), r.kept_text, r.n_lines, r.n_dropped) for r in out.collect()) == brute(rows)


def test_empty_table(spark):
    assert line_dedup.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_python_in_the_plan(spark, sf_dir):
    from wayline.llm.queries import QUERIES

    plan = QUERIES["op8_line_dedup"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
