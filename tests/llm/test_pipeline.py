import collections

import corpus_pipeline
import pyarrow as pa
from helpers import words
from pyspark.sql import functions as F
from test_lines import brute as lines_brute  # noqa: F401
from test_mixing import check as check_mix
from test_simhash import fingerprint, groups
from test_toxicity import BAD
from test_winnowing import brute as overlaps_brute

from ideolens.llm import simhash

COMMON = "Subscribe to our newsletter for more of this."
DOCS = "doc_id long, text string, lang string, source string, n_chars long, score double, tkey string"


def corpus(prose):
    rows, labels = [], []

    def add(text, source):
        rows.append((len(rows), text, "en", source, len(text) if text is not None else None, 0.5, "k"))
        return len(rows) - 1

    for i in range(240):
        text = prose(i, 60 + i % 90)
        if i % 6 == 0:
            w = text.split()
            for k in range(3):
                w.insert((i * (k + 3)) % len(w), BAD[(i // 6 + k) % 4])
            text = " ".join(w)
        elif i % 5 == 0:
            text = text + "\n" + COMMON.upper()
        doc = add(text, f"s{i % 4 if i % 2 else 0}")
        if i % 3 != 1:
            labels.append((doc, int(i % 6 == 0), 1))
    for i in range(5):
        add(prose(1001, 300) + f" end{i}", "s1")
    add(prose(3000, 100) + " " + prose(2000, 30), "s2")
    add(prose(3001, 900) + " " + prose(2000, 30), None)
    for text, source in ((None, "s1"), ("", None), ("  ", "s3"), (COMMON, "s1"), (prose(7, 67), "s0")):
        add(text, source)
    rows.append(rows[7])
    return rows, labels, [(1, prose(2000, 30)), (2, prose(2001, 40)), (3, None)]


def lines_by_row(rows):
    """Kept text by row, with the brute-force rule of test_lines."""
    found = {}
    for row in [r[0] for r in rows]:
        found[row] = None
    texts = [(r[0], r[1]) for r in rows]
    holders = collections.defaultdict(set)
    from helpers import BLANK, lower
    for doc, text in texts:
        for line in (text or "").split("\n"):
            if len(lower(line.strip(BLANK))) >= 20:
                holders[lower(line.strip(BLANK))].add(doc)
    keeper = {k: max(v) for k, v in holders.items() if len(v) >= 3}
    out = []
    for r in rows:
        own = (r[1] or "").split("\n")
        kept = [x for x in own if keeper.get(lower(x.strip(BLANK)), r[0]) == r[0]]
        text = r[1] if len(kept) == len(own) else "\n".join(kept)
        if len(kept) < len(own) and not text.strip(BLANK):
            continue
        out.append((r[0], text, r[2], r[3], r[4] if len(kept) == len(own) else len(text), *r[5:]))
    return out


def one_of_each_group(rows):
    distinct = list(dict.fromkeys(rows))
    group = groups([fingerprint(r[1]) for r in distinct], 4)
    least = {}
    for r, g in zip(distinct, group):
        least[g] = min(r[0], least.get(g, r[0]))
    return [r for r, g in zip(distinct, group) if least[g] == r[0]]


def test_stages_against_brute_force(spark, prose, table_dir):
    rows, labels, items = corpus(prose)
    d = table_dir(documents=spark.createDataFrame(rows, DOCS), labels=spark.createDataFrame(labels, "doc_id long, toxic int, quality int"),
                  benchmark=spark.createDataFrame(items, "item_id long, text string"))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = [tuple(r) for r in docs.collect()]
        docs = stage(spark, docs, d)
        docs.write.parquet(f"{d}/{name}")
        columns, docs = docs.columns, spark.read.parquet(f"{d}/{name}")
        seen[name] = (before, [tuple(r) for r in docs.collect()])
        if name != "mixing":
            assert columns == [c.split()[0] for c in DOCS.split(", ")]
    key = lambda r: (r[0], r[1] or "", str(r))

    before, after = seen["toxicity"]
    gone = {r[0] for r in before} - {r[0] for r in after}
    toxic = {i for i in range(240) if i % 6 == 0}
    assert len(gone & toxic) >= 0.95 * len(toxic) and len(gone - toxic) <= 2
    before, after = seen["line_dedup"]
    assert sorted(after, key=key) == sorted(lines_by_row(before), key=key)
    assert sum(COMMON.upper() in (r[1] or "").upper() for r in after) == 1
    before, after = seen["simhash_near_dedup"]
    assert sorted(after, key=key) == sorted(one_of_each_group(before), key=key)
    assert sum("end" in (r[1] or "")[-5:] for r in after) == 1
    before, after = seen["decontamination"]
    hits = {eval(x)[0] for x in overlaps_brute([(r[0], r[1]) for r in before], items) if eval(x)[2] and 20 * eval(x)[2] >= eval(x)[1]}
    assert len(hits) == 1 and sorted(after, key=key) == sorted((r for r in before if r[0] not in hits), key=key)
    before, after = seen["mixing"]
    check_mix([r[:5] for r in before], docs.collect())
    assert sorted(r["doc_id"] for r in docs.collect()) == sorted(r[0] for r in before)

    whole = corpus_pipeline.run(spark, d)
    assert sorted(map(str, whole.collect())) == sorted(map(str, docs.collect()))


def test_empty_documents(spark, table_dir):
    none = lambda schema: spark.createDataFrame([], schema)
    d = table_dir(documents=none(DOCS), labels=none("doc_id long, toxic int, quality int"), benchmark=none("item_id long, text string"))
    assert corpus_pipeline.run(spark, d).count() == 0


def test_null_ids(spark, prose, table_dir):
    rows = [(None, prose(1), "en", "a", 1, 0.0, ""), (None, prose(1), "en", "a", 1, 0.0, ""), (None, prose(2), "en", None, 1, 0.0, ""),
            (3, prose(3), None, "a", 1, 0.0, ""), (None, None, None, None, None, None, None)]
    d = table_dir(documents=spark.createDataFrame(rows, DOCS), labels=spark.createDataFrame([(3, 0, 1)], "doc_id long, toxic int, quality int"),
                  benchmark=spark.createDataFrame([(1, prose(9))], "item_id long, text string"))
    out = corpus_pipeline.run(spark, d)
    assert out.count() == 4 and out.where(F.col("taken") > 3 * F.col("size")).count() == 0
    assert sorted(r["size"] for r in out.collect()) == sorted([len(words(prose(1))), len(words(prose(2))), len(words(prose(3))), 0])


def test_near_copies_are_grouped_by_component(spark, prose):
    """One id on several texts, and near copies without any id, whose fingerprints differ."""
    def near(text):
        first = int(simhash.fingerprints(pa.array([text]))[0].as_py())
        for i in range(200):
            other = f"{text} end{i}"
            bits = ((first ^ int(simhash.fingerprints(pa.array([other]))[0].as_py())) & (1 << 64) - 1).bit_count()
            if 0 < bits <= 4:
                return other
        raise AssertionError

    a, b, c, d = (prose(i, 300) for i in range(1, 5))
    rows = [(1, a), (1, b), (1, b), (2, near(b)), (1, c), (None, d), (None, near(d)), (None, near(d))]
    got = [tuple(r) for r in corpus_pipeline.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()]
    assert sorted(x for x in got if x[0]) == sorted([(1, a), (1, b), (1, c)])
    assert len(got) == 4 and [x for x in got if x[0] is None][0][1] in (d, near(d))
