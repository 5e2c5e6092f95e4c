from collections import Counter

from wayline.llm import line_dedup, warc
from wayline.llm.skew import uneven_join


def test_uneven_join_matches_a_plain_one(spark):
    keys = ["hot"] * 500 + [f"k{k % 70}" for k in range(300)] + [None, "alone"]
    rows = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "key string, i long").repartition(3)
    n = Counter(k for k in keys if k and k != "alone")
    table = spark.createDataFrame([(k, v, len(k)) for k, v in n.items()], "key string, n long, size int")
    for how in ("inner", "left"):
        got = sorted((str(r.key), r.i, r.size) for r in uneven_join(rows, table, ["key"], "n", len(keys), how).collect())
        want = sorted((str(k), i, len(k) if k in n else None) for i, k in enumerate(keys) if how == "left" or k in n)
        assert got == want
    hot = uneven_join(rows, table, ["key"], "n", len(keys))
    assert "BroadcastHashJoin" in hot._jdf.queryExecution().toString() or "Broadcast" in hot._jdf.queryExecution().toString()
    assert uneven_join(rows.limit(0), table, ["key"], "n", 0).count() == 0


def test_a_line_of_a_third_of_all(spark):
    common = "this very line is in nearly all of the documents"
    rows = [(d, f"{common}\nown line of document number {d}\n{common}") for d in range(400)]
    out = {r.doc_id: r for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()}
    assert out[399].n_dropped == 0 and all(out[d].n_dropped == 2 and out[d].kept_text == f"own line of document number {d}" for d in range(399))


def test_a_page_of_a_third_of_all_and_a_long_one(spark):
    same, long = "<p>" + "same " * 50, "<p>" + "long text " * 300_000
    pages = [(k, f"http://x/{k}", same if k % 3 == 0 else f"<p>{k} " + "y" * 120) for k in range(150)] + [(1000, None, long), (1001, "u", long), (1002, "u", None)]
    records = warc.list_records(warc.write_packages(spark.createDataFrame(pages, "page_id long, url string, html string").repartition(4)))
    got = {r.page_id: r for r in warc.read_records(records).collect()}
    assert len(got) == 153 and all(got[k].record_type == ("revisit" if k % 3 == 0 and k else "response") for k in range(150))
    assert all(got[k].refers_to == 0 for k in range(3, 150, 3)) and got[1001].refers_to == 1000 and got[1000].payload_bytes == len(long)
    assert bytes(got[1000].payload) == long.encode() and got[1002].payload_bytes == 0
