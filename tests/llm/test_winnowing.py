import hashlib

import numpy as np
from helpers import alnum_words, sortable
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ideolens.llm import queries, winnowing


def brute(docs, items, span=13):
    windows = {}
    for item, text in items:
        w = alnum_words(text)
        n = min(len(w), span)
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i:i + n]), set()).add(item)
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        w, hit, found = alnum_words(text), set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in windows:
                    hit.update(range(i, i + n))
                    found |= windows[tuple(w[i:i + n])]
        out.append((doc, len(w), len(hit), tuple(sorted(x for x in found if x is not None))))
    return sortable(out)


def run(docs, items):
    got = winnowing.find_overlaps(docs, items).collect()
    return sortable((r["doc_id"], r["n_words"], r["n_hit"], tuple(r["item_ids"])) for r in got)


def items_of(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_brute_force(spark, clashing, odd_rows, prose):
    text = {i: prose(i, 200).split() for i in range(30, 36)}
    items = [(1, " ".join(text[30][:40])), (2, " ".join(text[31][:13])), (3, "Short, item!"), (4, None), (5, ""), (6, "--- ..."),
             (None, " ".join(text[32][:20])), (7, " ".join(text[30][:40])), (8, prose(1)), (9, "la " * 30), (10, " ".join(text[33][:12]))]
    docs = [(r[0], r[1]) for r in odd_rows] + [
        (40, "a b " + " ".join(text[30][5:18]) + " c"), (41, " ".join(text[30][5:17])), (42, " ".join(text[31]).upper()),
        (43, "x short  ITEM y short item"), (44, " ".join(text[32])), (45, "la " * 200), (46, "la " * 12), (47, " ".join(text[33])),
        (48, " ".join(text[30] + text[32] + text[30]))]
    frame = clashing.select("doc_id", "text", "size", "row").unionByName(
        spark.createDataFrame(docs[len(odd_rows):], "doc_id long, text string").withColumns({"size": F.lit(0), "row": F.lit(0)}))
    assert run(frame, items_of(spark, items)) == brute(docs, items)


def test_empty_tables(spark, odd, empty):
    none = items_of(spark, [])
    assert winnowing.find_overlaps(empty, items_of(spark, [(1, "a b c")])).count() == 0
    assert all(r["n_hit"] == 0 and r["item_ids"] == [] for r in winnowing.find_overlaps(odd, none).collect())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=13, max_size=80), st.integers(0, 20))
def test_every_shared_span_keeps_a_hash(letters, at):
    """Two texts that share 13 words keep a common hash inside the shared span."""
    hashes = np.array(letters, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    at = min(at, len(letters) - 13)
    shared = hashes[at:at + 13]
    pos, fp = winnowing.winnow(np.zeros(len(hashes), int), hashes, 13)
    other = np.concatenate((np.arange(5, dtype=np.uint64), shared, np.arange(9, 12, dtype=np.uint64)))
    pos2, fp2 = winnowing.winnow(np.zeros(len(other), int), other, 13)
    inside = {int(x) for p, x in zip(pos, fp) if at <= p <= at + 5}
    assert inside & {int(x) for p, x in zip(pos2, fp2) if 5 <= p <= 10}


def test_query_digest(spark, table_dir, prose):
    docs = [(1, prose(50, 100)), (2, prose(51, 100)), (3, None)]
    items = [(10, prose(50, 30)), (9, prose(50, 20)), (7, prose(99, 30))]
    d = table_dir(documents=spark.createDataFrame(docs, "doc_id long, text string"), benchmark=items_of(spark, items))
    got = {r["doc_id"]: r for r in queries.op3_decontaminate(spark, d).collect()}
    assert got[1]["items_sha256"] == hashlib.sha256(b"10,9").hexdigest() and got[1]["contaminated"] and got[1]["n_hit"] == 30
    assert got[3]["items_sha256"] == hashlib.sha256(b"").hexdigest() and not got[2]["contaminated"] and got[3]["n_words"] == 0
