import collections

from helpers import BLANK, lower, sortable

from ideolens.llm import lines


def brute(rows, min_chars=20, min_docs=3):
    holders = collections.defaultdict(set)
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = lower(line.strip(BLANK))
            if len(key) >= min_chars:
                holders[key].add(doc)
    order = lambda d: -1 if d is None else d
    keeper = {k: max(v, key=order) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for doc, text in rows:
        own = (text or "").split("\n")
        kept = [x for x in own if (k := lower(x.strip(BLANK))) not in keeper or keeper[k] == doc]
        out.append((doc, len(own), len(own) - len(kept), "\n".join(kept)))
    return sortable(out)


def run(docs, **limits):
    return sortable((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in lines.drop_common_lines(docs, **limits).collect())


def test_brute_force(spark, odd, odd_rows):
    common, word = "This line is in many documents.", "word " * 10
    rows = [(r[0], r[1]) for r in odd_rows] + [(20 + i, f"own {i}\n\t {common.upper() if i % 2 else common}\r\nend\n") for i in range(6)] + [
        (30, common + "\n" + common + "\n" + word), (31, word + "\n\n" + "é" * 20), (32, "\v" + word + "\f\n" + "é" * 20), (33, "É" * 20 + "\nx\n" + "é" * 20),
        (None, common), (None, word), (34, "nineteen characters\nnineteen characters"), (35, "nineteen characters"), (36, "nineteen characters"),
        (37, "\n\n\n"), (38, common + "\x1f"), (30, common + "\n" + common + "\n" + word), (30, "another text of the id\n" + common)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert run(docs) == brute(rows)
    assert run(docs, min_chars=1, min_docs=2) == brute(rows, 1, 2)


def test_all_rows_hold_the_line_without_id(spark):
    rows = [(None, "a line of no document at all")] * 5
    assert run(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_columns_stay(clashing, empty):
    out = lines.drop_common_lines(clashing)
    assert out.columns == [*clashing.columns, "n_lines", "n_dropped"]  # kept_text replaces the column of that name
    assert [r["tkey"] for r in out.limit(2).collect()] == [0, 0]
    assert lines.drop_common_lines(empty).count() == 0
