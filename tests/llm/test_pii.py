import re

from ideolens.llm import pii

TEXTS = [
    "Contact Mr John Smith or Mary Jones at John.Smith42@mail8.example.com, tel +1 (988) 555-2485. Card 4111111111111111, IP 10.0.0.12.",
    "john.smith42@mail8.example.com wrote; +1 988 555 2485 / +19885552485. Frau Müller, Herr Müller. Иван Петров и Анна Каренина, Γιώργος Παππάς.",
    None, "", "nothing here 12 34", "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432; SSN 123-45-6789; 4111 1111 1111 1111, 555-123-4567 end",
    "Petra Smith and Mr. Smith, Dr Who. a@b.co a@b.co.", "a" * 30_000 + "@x.com " + "1" * 30_000 + " x@", "MARY? Anna SMITH JOHN.SMITH42@MAIL8.EXAMPLE.COM",
]
DOCS = "doc_id long, text string"


def run(spark, texts=TEXTS, key="k"):
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (None, texts[0])]
    out = pii.replace_pii(spark.createDataFrame(rows, DOCS), key).collect()
    assert len(out) == len(rows)
    same = {r["text"] for r in out if r["doc_id"] in (0, None)}
    assert len(same) == 1
    return {r["doc_id"]: (r["text"], r["n_entities"]) for r in out if r["doc_id"] is not None}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        x = int(c) * (1 + i % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def test_surrogates_keep_type_and_format(spark):
    got = run(spark)
    first, n = got[0]
    assert n == 6 and not any(x in first for x in ("Smith", "Mary", "Jones", "John", "mail8", "988", "4111111111111111", "10.0.0.12"))
    m = re.fullmatch(r"Contact Mr (\w+) (\w+) or (\w+) (\w+) at ([A-Z][a-z]{3}\.[A-Z][a-z]{4}\d\d@[a-z]{4}\d\.[a-z]{7}\.com), tel "
                     r"(\+1 \(\d{3}\) \d{3}-\d{4})\. Card (4\d{15}), IP (\d+\.\d+\.\d+\.\d+)\.", first)
    assert m and m[1] in pii.MALE_NAMES["latin"] and m[3] in pii.FEMALE_NAMES["latin"] and luhn(m[7])
    assert all(0 < int(x) < 256 for x in m[8].split("."))
    # coreference: case, separators and other documents do not matter
    second = got[1][0]
    assert second.startswith(m[5].lower() + " wrote") and re.sub(r"\D", "", m[6]) in re.sub(r"\D", "", second)
    assert second.count("Müller") == 0 and len(set(re.findall(r"(?:Frau|Herr) (\w+)", second))) == 1
    assert re.search(r"[а-яА-Я]+ [а-яА-Я]+ и [а-яА-Я]+ [а-яА-Я]+, [α-ωΑ-Ωά-ώΆ-Ώ]+ [α-ωΑ-Ωά-ώΆ-Ώ]+\.", second)
    assert got[5][0].split("; ")[2].split(",")[0].replace(" ", "") == m[7]
    assert re.search(r"IBAN DE\d\d( \d{4}){4} \d\d and GB\d\d[A-Z]{4}\d{14}; SSN \d{3}-\d\d-\d{4};", got[5][0])
    assert m[2] in got[6][0] and got[6][1] == 5
    assert m[5].upper() in got[8][0] and got[8][0].startswith("MARY? ")
    assert got[2] == (None, 0) and got[3] == ("", 0) and got[4] == (TEXTS[4], 0)
    assert got[7][0][-30_003:] == TEXTS[7][-30_003:] and got[7][1] == 1 and "a" * 100 not in got[7][0]


def test_key_decides(spark):
    assert run(spark) == run(spark)
    assert run(spark)[0] != run(spark, key="other")[0]


def test_distinct_entities_stay_distinct(spark):
    """More people than listed names, and addresses so short that draws clash."""
    names = [g for names in pii.FEMALE_NAMES.values() for g in names]
    entities = [("given_f", n.lower()) for n in names] + [("ssn", f"{i:02d}") for i in range(40)] + [("email", f"{a}@x.org") for a in "abcdefghijkl"]
    out = pii.assign(spark.createDataFrame(entities, "type string, norm string"), "k").collect()
    assert len(out) == len(entities)
    by_type = {}
    for r in out:
        by_type.setdefault(r["type"], []).append(r)
    for rows in by_type.values():
        drawn = [r["surrogate"].lower() for r in rows]
        assert len(set(drawn)) == len(drawn) and not set(drawn) & {r["norm"] for r in rows}


def test_plan_is_native(spark):
    plan = pii.replace_pii(spark.createDataFrame([(1, TEXTS[0])], DOCS), "k")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_columns(clashing, empty):
    out = pii.replace_pii(clashing, "k")
    assert out.columns == [*clashing.columns, "n_entities"] and out.count() == clashing.count()
    assert pii.replace_pii(empty, "k").count() == 0


def test_forms_without_free_values_end(spark):
    """Locals of punctuation alone, all one-letter locals and all one-digit labels: surrogates grow."""
    addresses = ["...@gmail.com", "_@x.com", "_@gmail.com"] + [f"{chr(97 + i)}@mail.com" for i in range(26)] + [f"Pkg@{i}.0" for i in range(10)]
    got = run(spark, addresses)
    assert all(n == 1 for _, n in got.values())
    new = [got[i][0].lower() for i in range(len(addresses))]
    assert len(set(new)) == len(new) and not set(new) & {x.lower() for x in addresses}
    assert all(re.fullmatch(pii.KINDS["email"], x) for x in new)
    assert re.fullmatch(r"\.\.\.[a-z]+@[a-z]{5}\.com", new[0]) and re.fullmatch(r"_[a-z]+@[a-z]\.com", new[1])
    assert all(re.fullmatch(r"[a-z]{2,}@[a-z]{4}\.com", x) for x in new[3:29]) and len({x.split("@")[1] for x in new[3:29]}) == 1
    assert all(re.fullmatch(r"[a-z]{3}@[0-9][a-z]+\.0", x) for x in new[29:]) and all(got[i][0][0].isupper() for i in range(29, 39))


def test_longer_surrogates_of_numbers_keep_their_form(spark):
    numbers = [("ssn", "123456789"), ("card", "4111111111111111"), ("phone", "19885552485"), ("iban", "DE89370400440532013000"), ("ip", "10.0.0.12")]
    rows = spark.createDataFrame([(k, n, pii.WIDEN + 1) for k, n in numbers], "type string, norm string, attempt int")
    stream, value = pii._surrogate("k")
    new = {r["type"]: r["s"] for r in rows.withColumn("stream", stream).withColumn("s", value).collect()}
    assert re.fullmatch(r"\d{11}", new["ssn"]) and re.fullmatch(r"4\d{17}", new["card"]) and luhn(new["card"])
    assert re.fullmatch(r"1\d{12}", new["phone"]) and re.fullmatch(r"DE\d{22}", new["iban"])
    raw = spark.createDataFrame([("ssn", "123-45-6789", "99988777766")], "type string, raw string, s string")
    assert raw.select(pii._in_form_of(raw["raw"], raw["type"], raw["s"])).first()[0] == "999-88-777766"


def _remainder(iban):
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97


def test_check_digits_of_ibans(spark):
    """Valid ones stay valid, with their country and spacing; others only keep their form."""
    texts = ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "DE88 3704 0044 0532 0130 00"]
    assert [_remainder(t.replace(" ", "")) for t in texts] == [1, 1, 0]
    got = [run(spark, texts)[i][0] for i in range(3)]
    assert [_remainder(t.replace(" ", "")) for t in got[:2]] == [1, 1]
    assert all(re.fullmatch(p, t) for p, t in zip((r"DE\d\d( \d{4}){4} \d\d", r"GB\d\d[A-Z]{4}\d{14}", r"DE\d\d( \d{4}){4} \d\d"), got))
    assert not set(got) & set(texts)


def test_many_given_names_keep_their_gender(spark):
    """More distinct names than are listed: made ones end as their gender does."""
    latin = [a + b for a in ("ala", "beri", "coro", "dunu", "filo") for b in ("na", "ra", "sel", "tin", "vor", "kel")]
    cyrillic = [a + b for a in ("бар", "вел", "гор") for b in ("на", "рик", "тан", "вор", "мил")]
    rows = [(t, n) for n in latin + cyrillic for t in ("given_f", "given_m")]
    got = pii.assign(spark.createDataFrame(rows, "type string, norm string"), "k").collect()
    assert len(got) == len(rows) and len({r.surrogate.lower() for r in got}) == len(rows)
    for r in got:
        listed, ends = ((pii.FEMALE_NAMES, pii.FEMALE_ENDINGS) if r.type == "given_f" else (pii.MALE_NAMES, pii.MALE_ENDINGS))
        script = "latin" if r.norm in latin else "cyrillic"
        assert r.surrogate in listed[script] or r.surrogate.endswith(ends[script])


def test_ip_addresses_stay_addresses(spark):
    """However often one is drawn again, until nearly all addresses would have to be taken."""
    rows = spark.createDataFrame([("ip", "10.0.0.12", a) for a in range(pii.WIDEN_IP + 1)], "type string, norm string, attempt int")
    stream, value = pii._surrogate("k")
    new = {r["attempt"]: r["s"] for r in rows.withColumn("stream", stream).withColumn("s", value).collect()}
    octets = {a: [int(x) for x in s.split(".")] for a, s in new.items()}
    assert all(len(octets[a]) == 4 and max(octets[a]) < 256 for a in range(pii.WIDEN_IP)) and len(octets[pii.WIDEN_IP]) == 5
    assert len(set(new.values())) == len(new)
