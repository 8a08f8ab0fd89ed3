"""Secret scan with DataFrame functions only: key patterns and sliding-window entropy.

Patterns are applied by splitting a text at the matches; running sums of the lengths of the
parts and matches give the positions.  Candidate strings are the maximal runs of each
character class on its own (hex digits, the base64 alphabet, its form for addresses), so a
key is judged apart from a name, path or mark that joins it.  A candidate is read once,
character by character: the counts of the characters in the window, and from them the sum of
c log2 c, change by the character that enters and the one that leaves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ideolens.llm.rows import join_rows, settle, text_key

#: Kinds in their order: (name, pattern, group whose length counts, least length).
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (("assign", ASSIGN, 1, 6), ("access", r"AKIA[A-Z0-9]+", 0, 20), ("hex", r"[0-9a-f]+", 0, 24))
#: Cheap tests that a text must pass before a pattern is applied; true for every text with a match that counts.
SIEVE = {"assign": r"(?i:pass|secret|token|key)[a-zA-Z]*[\"']?\x20*[:=]", "access": r"AKIA[A-Z0-9]{16}",
         "hex": r"[0-9a-f]{24}", "hex_run": r"[0-9a-fA-F]{20}", "base64_run": r"[A-Za-z0-9+/]{20}",
         "url_run": r"[A-Za-z0-9_-]{20}"}
#: Only runs that can count are split off; as the runs are maximal, the matches are the same.
SPLIT = {"access": r"AKIA[A-Z0-9]{16,}", "hex": r"[0-9a-f]{24,}"}
#: Candidates of each class: maximal runs.  Base64 has two alphabets, one of which a path does not
#: join and one of which a name with a dash or underline does not.
RUNS = (("hex_run", r"[0-9a-fA-F]{20,}"), ("base64_run", r"[A-Za-z0-9+/]{20,}"), ("url_run", r"[A-Za-z0-9_-]{20,}"))
WINDOW = 20
#: Alphabet and least entropy (bits) of a window for each character class.
HEX_ALPHABET, HEX_BITS = "0123456789abcdefABCDEF", 3.0
B64_ALPHABET, B64_BITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-", 3.8
#: Candidates that entropy must not report: published example keys and placeholders, alphabets
#: in order, UUIDs, and runs without both a digit and a letter.  They are held against the
#: candidate that would be reported, not what surrounds it.
ALLOWED = (r"(?i:example(key)?$|^(example|placeholder|changeme|your[_-]|xxxx))|^(0123456789|1234567890|(?i:abcdefghij))"
           r"|^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$"
           r"|^[^0-9]*$|^[^A-Za-z]*$")


def _c_log_c(c):
    return F.when(c > 1, c * F.log2(c.cast("double"))).otherwise(F.lit(0.0))


def max_window_entropy(text, alphabet: str, width: int = WINDOW):
    """Largest Shannon entropy (bits) of a window of ``width`` characters of ``text``, whose
    characters are all in ``alphabet``; 0 if it is shorter."""
    codes = F.transform(F.split(text, "", -1), lambda c: F.position(c, F.lit(alphabet)))
    steps = F.arrays_zip(codes.alias("into"), F.concat(F.array_repeat(F.lit(0), width), codes).alias("out"))
    start = F.struct(F.array_repeat(F.lit(0), len(alphabet) + 1).alias("counts"), F.lit(0.0).alias("s"),
                     F.lit(0).alias("n"), F.lit(0.0).alias("best"))

    def step(state, x):
        came, went = x["into"], x["out"]
        in_now, out_now = F.get(state["counts"], came), F.get(state["counts"], went)
        change = (_c_log_c(in_now + 1) - _c_log_c(in_now)
                  + F.when(went > 0, _c_log_c(out_now - 1) - _c_log_c(out_now)).otherwise(0.0))
        s = F.when(came == went, state["s"]).otherwise(state["s"] + change)
        counts = F.transform(state["counts"], lambda c, i: c + (i == came).cast("int") - ((i == went) & (went > 0)).cast("int"))
        n = state["n"] + 1
        bits = F.when(n >= width, F.log2(F.lit(float(width))) - s / width).otherwise(0.0)
        return F.struct(counts.alias("counts"), s.alias("s"), n.alias("n"), F.greatest(state["best"], bits).alias("best"))

    steps = F.filter(steps, lambda x: x["into"].isNotNull() & (x["into"] > 0))
    return F.aggregate(steps, start, step, lambda state: state["best"])


def _matches(docs: DataFrame) -> DataFrame:
    """doc_id, tkey, kind number, start, end, match and counted group of all matches in the
    texts; 0 to 2 are the kinds of BASE, 3 to 5 those of RUNS."""
    text = F.coalesce("text", F.lit(""))
    kinds = []
    for name, pattern, group, _ in (*BASE, *((name, pattern, 0, 0) for name, pattern in RUNS)):
        pattern = F.lit(SPLIT.get(name, pattern))
        found = F.struct(
            F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gaps"),
            F.regexp_extract_all(text, pattern, F.lit(0)).alias("all"),
            F.regexp_extract_all(text, pattern, F.lit(group)).alias("part"))
        kinds.append(F.when(text.rlike(SIEVE[name]), found))
    rows = docs.select("doc_id", "tkey", F.filter(
        F.transform(F.array(*kinds), lambda x, i: F.struct(i.alias("kind"), x.alias("found"))),
        lambda x: x["found"].isNotNull()).alias("kinds")).where(F.size("kinds") > 0).dropDuplicates(["doc_id", "tkey"])
    rows = rows.select("doc_id", "tkey", F.explode("kinds").alias("k")).select(
        "doc_id", "tkey", "k.kind", F.posexplode(F.arrays_zip("k.found.gaps", "k.found.all", "k.found.part")).alias("i", "m"))
    rows = rows.where(F.col("m.all").isNotNull())
    upto = Window.partitionBy("doc_id", "tkey", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("m.gaps") + F.length("m.all")).over(upto)
    return (rows.select("doc_id", "tkey", "kind", end.alias("end"), F.col("m.all").alias("match"), F.col("m.part").alias("part"))
            .withColumn("start", F.col("end") - F.length("match")))


def find_secrets(docs: DataFrame) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, tkey and spans, an array of
    struct(start, kind, end) in order; positions count code points, ends are exclusive.

    Kinds 0 to 2 are those of BASE; 3 (hex) and 4 (base64) are candidates of RUNS with a window
    whose entropy reaches the limit of their class, unless the allow-list names them or a span
    of BASE contains them; one that contains another such candidate gives way to it.  Null and
    empty texts have no spans; repeated rows have equal spans; very long texts are read whole;
    an empty table gives no rows."""
    base = docs.select("doc_id", text_key().alias("tkey"), "text")
    rows = _matches(base)
    least = F.element_at(F.array(*[F.lit(n) for *_, n in BASE]), (F.col("kind") + 1).cast("int"))
    is_hex = F.col("kind") == 3
    entropy = F.when(is_hex, max_window_entropy(F.col("match"), HEX_ALPHABET)).otherwise(
        max_window_entropy(F.col("match"), B64_ALPHABET))
    kept = rows.where(
        F.when(F.col("kind") < 3, F.length("part") >= least)
        .otherwise(~F.col("match").rlike(ALLOWED) & (entropy >= F.when(is_hex, HEX_BITS).otherwise(B64_BITS))))
    kept = kept.withColumn("kind", F.least("kind", F.lit(4)))
    one = Window.partitionBy("doc_id", "tkey")
    before = one.orderBy("start", "kind").rowsBetween(Window.unboundedPreceding, 0)
    inside = F.coalesce(F.max(F.when(F.col("kind") < 3, F.col("end"))).over(before) >= F.col("end"), F.lit(False))
    kept = kept.withColumn("inside", inside).where((F.col("kind") < 3) | ~F.col("inside"))
    # an equal or shorter candidate in the same place comes first in this order
    shorter = one.orderBy("end", F.desc("start"), "kind").rowsBetween(Window.unboundedPreceding, -1)
    around = F.coalesce(F.max(F.when(F.col("kind") >= 3, F.col("start"))).over(shorter) >= F.col("start"), F.lit(False))
    kept = kept.withColumn("around", around).where((F.col("kind") < 3) | ~F.col("around"))
    spans = kept.groupBy("doc_id", "tkey").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("spans"))
    out = join_rows(base.select("doc_id", "tkey"), settle(spans), "left")
    return out.select("doc_id", "tkey", F.coalesce("spans", F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")).alias("spans"))


def describe(spans):
    """kind:start:end of an array of spans, comma-joined."""
    names = F.array(*[F.lit(n) for n in ("assign", "access", "hex", "entropy_hex", "entropy_base64")])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
