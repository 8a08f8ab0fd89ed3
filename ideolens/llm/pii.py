"""Personal data: detection and keyed surrogates, with DataFrame functions only.

Mentions are found by one pattern and split into parts (the local part and the domain of an
address, the given name and the surname of a person, the digits of a number).  Equal parts
are one entity throughout the corpus, whatever their case or separators, so one table of
distinct entities gives each a surrogate derived from a secret key.  A surrogate has the type
of the original: digits for digits, letters of the same script for letters, a given name of
the same gender, valid octets, a card number or IBAN with valid check digits if the original's
are.  Given names beyond the listed ones are made up with an ending of the gender.
Surrogates that two entities share, or that equal an entity of the corpus, are drawn again
until all are distinct; after some attempts they grow, so a form with too few values ends too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ideolens.llm.rows import broadcast_if_small, discard, join_rows, pack, settle, text_key, unpack

# Forms of address and given names by gender, in three scripts.
MALE_TITLES = ("Mr", "Mister", "Herr", "Monsieur", "Señor", "Sr", "Господин", "Κύριος")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Госпожа", "Κυρία")
OTHER_TITLES = ("Dr", "Prof")
MALE_NAMES = {
    "latin": ("James", "John", "Robert", "Michael", "William", "David", "Thomas", "Peter", "Paul", "Daniel", "Hans", "Klaus",
              "Stefan", "Jean", "Pierre", "Antoine", "Carlos", "Juan", "Miguel", "Pablo"),
    "cyrillic": ("Иван", "Сергей", "Алексей", "Дмитрий", "Николай", "Михаил", "Павел", "Андрей"),
    "greek": ("Γιώργος", "Νίκος", "Κώστας", "Γιάννης", "Δημήτρης", "Παύλος"),
}
FEMALE_NAMES = {
    "latin": ("Mary", "Anna", "Linda", "Sarah", "Laura", "Emma", "Julia", "Maria", "Claire", "Sophie", "Ingrid", "Petra",
              "Sabine", "Marie", "Camille", "Helene", "Carmen", "Lucia", "Elena", "Pilar"),
    "cyrillic": ("Анна", "Ольга", "Елена", "Наталья", "Мария", "Ирина", "Татьяна", "Светлана"),
    "greek": ("Μαρία", "Ελένη", "Κατερίνα", "Σοφία", "Άννα", "Δήμητρα"),
}
SYLLABLES = {
    "latin": ("ba", "be", "bo", "da", "de", "do", "fa", "ga", "ha", "ka", "la", "le", "lo", "ma", "me", "mo", "na", "ne", "ra",
              "re", "ro", "sa", "se", "ta", "te", "to", "va", "vo", "za", "zo"),
    "cyrillic": ("ба", "во", "га", "де", "жа", "за", "ка", "ле", "ма", "но", "па", "ро", "са", "та", "фе", "ши"),
    "greek": ("βα", "γο", "δε", "κα", "λο", "μα", "νο", "πα", "ρο", "σα", "τα", "φο", "χα"),
}
#: Endings of made given names, which keep the gender once the listed names are taken.
MALE_ENDINGS = {"latin": ("bert", "mund", "rick", "ton"), "cyrillic": ("бор", "мир", "слав"), "greek": ("ης", "ιος", "ος")}
FEMALE_ENDINGS = {"latin": ("etta", "issa", "lina", "rina"), "cyrillic": ("ина", "мира", "слава"), "greek": ("ία", "ινα", "ούλα")}
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}

_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_GIVEN = "|".join(n for names in (MALE_NAMES, FEMALE_NAMES) for s in names.values() for n in s)
_TITLES = "|".join(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES)
_NAME = r"\p{Lu}[\p{L}'’-]*\p{L}"
#: Kinds in the order in which they are tried at one position.
KINDS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9A-Za-z+.-])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9A-Za-z])",
    "phone": r"(?:(?<![0-9A-Za-z+])\+[0-9](?:[\x20().-]{0,2}[0-9]){6,14}|(?<![0-9A-Za-z.-])(?:\([0-9]{3}\)[\x20.-]?|[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4})(?![0-9])",
    "person": rf"(?<![\p{{L}}])(?:(?:{_TITLES})\.?\x20{_NAME}(?:\x20{_NAME})?|(?:{_GIVEN})\x20{_NAME})(?![\p{{L}}])",
}
PATTERN = "|".join(KINDS.values())
#: A text without any of these has no mention.
SIEVE = rf"@|[0-9][0-9.()\x20-]{{5}}|(?:{_TITLES}|{_GIVEN})\.?\x20"
BLOCKS = 4
#: From this attempt on a surrogate is longer than its original, by one more character each time.
WIDEN = 8
#: IP addresses stay four octets for so many attempts; more are needed only if the addresses of a
#: corpus and their surrogates take nearly all that there are.
WIDEN_IP = 64
#: Listed given names are drawn in so many attempts.
LISTED = 4


def _script(text):
    return F.when(text.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(text.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")


def _parts(match):
    """Array of struct(type, norm, raw) whose raws make up the mention; type null: stays."""
    def part(kind, norm, raw):
        kind = F.lit(kind).cast("string") if kind is None or isinstance(kind, str) else kind
        return F.struct(kind.alias("type"), norm.alias("norm"), raw.alias("raw"))

    none = F.lit(None).cast("string")
    local, domain = F.substring_index(match, "@", 1), F.substring_index(match, "@", -1)
    digits = F.regexp_replace(match, "[^0-9]", "")
    plain = F.regexp_replace(match, r"\x20", "")
    words = F.split(match, r"\x20", -1)
    titled = match.rlike(rf"^(?:{_TITLES})\.?\x20")
    title = F.rtrim(F.get(words, F.lit(0)), F.lit("."))
    name = lambda names: [n for s in names.values() for n in s]

    def person(word, i):
        start = F.when(titled, 1).otherwise(0)
        given = (i == start) & (F.size(words) > start + 1)
        gender = (F.when(titled & title.isin(*MALE_TITLES), "m").when(titled & title.isin(*FEMALE_TITLES), "f")
                  .when(word.isin(*name(MALE_NAMES)), "m").when(word.isin(*name(FEMALE_NAMES)), "f").otherwise("n"))
        kind = F.when(i < start, none).when(given, F.concat(F.lit("given_"), gender)).otherwise("surname")
        return part(kind, F.lower(word), F.concat(F.when(i > 0, " ").otherwise(""), word))

    is_kind = lambda kind: match.rlike(f"^(?:{KINDS[kind]})$")
    return (F.when(is_kind("email"), F.array(part("email", F.lower(match), local), part(None, none, F.lit("@")), part("domain", F.lower(domain), domain)))
            .when(is_kind("iban"), F.array(part("iban", plain, match)))
            .when(is_kind("ip"), F.array(part("ip", match, match)))
            .when(is_kind("ssn"), F.array(part("ssn", digits, match)))
            .when(is_kind("card"), F.array(part("card", digits, match)))
            .when(is_kind("phone"), F.array(part("phone", digits, match)))
            .otherwise(F.transform(words, person)))


def _luhn(digits):
    """Sum of the check rule over a digit string; valid if a multiple of ten."""
    codes = F.reverse(F.split(digits, "", -1))
    codes = F.filter(codes, lambda c: c != "")
    return F.aggregate(F.transform(codes, lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        F.when(c.cast("int") > 4, 2 * c.cast("int") - 9).otherwise(2 * c.cast("int")))), F.lit(0), lambda a, x: a + x)


def _mod97(text):
    """Remainder by 97 of the number that a text spells, A to Z as 10 to 35."""
    code = lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55)
    chars = F.filter(F.split(text, "", -1), lambda c: c != "")
    return F.aggregate(F.transform(chars, code), F.lit(0), lambda a, x: (a * F.when(x > 9, 100).otherwise(10) + x) % 97)


def _surrogate(key: str):
    """Column over (type, norm, attempt): the surrogate, in the form of norm."""
    norm, attempt = F.col("norm"), F.col("attempt")
    seed = F.concat_ws("|", F.lit(key), "type", norm, attempt.cast("string"))
    stream = F.concat(*[F.sha2(F.concat(seed, F.lit(f"|{b}")).cast("binary"), 256) for b in range(BLOCKS)])

    def byte(i):
        return F.conv(F.substring(F.col("stream"), 1 + 4 * (i % (16 * BLOCKS)), 4), 16, 10).cast("int")

    def letter(c, i, letters):
        return F.substring(F.lit(letters), 1 + byte(i) % len(letters), 1)

    def renew(text, keep=0):
        """Digits for digits, letters for letters of the same case; the first ``keep`` stay."""
        return F.array_join(F.transform(F.split(text, "", -1), lambda c, i: F.when(i < keep, c)
                            .when(c.rlike("^[0-9]$"), (byte(i) % 10).cast("string"))
                            .when(c.rlike("^[a-z]$"), letter(c, i, LETTERS["latin"]))
                            .when(c.rlike("^[A-Z]$"), letter(c, i, LETTERS["latin"].upper())).otherwise(c)), "")

    def wider(text, letters, first=WIDEN):
        """Further characters, from the first attempt on for a text without letters and digits."""
        n = F.when(text.rlike("[0-9A-Za-z]"), attempt - (first - 1)).otherwise(attempt + 1)
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: letter(
            None, i + F.length(text), letters)), "")).otherwise("")

    def pick(values):
        return F.element_at(F.array(*[F.lit(v) for v in values]), 1 + byte(F.lit(0)) % len(values))

    def joined(script, n):
        syllables = F.array(*[F.lit(s) for s in SYLLABLES[script]])
        return F.array_join(F.transform(F.sequence(F.lit(1), n), lambda i: F.element_at(syllables, 1 + byte(i) % len(SYLLABLES[script]))), "")

    def made(script):
        """A new name; more syllables with every attempt, so there are always enough."""
        return F.initcap(joined(script, attempt + 3))

    def gendered(script, endings):
        """A new given name whose ending tells the gender, a syllable longer with every attempt."""
        return F.initcap(F.concat(joined(script, F.greatest(attempt - LISTED + 2, F.lit(2))), pick(endings[script])))

    def by_script(f):
        script = _script(norm)
        return F.when(script == "cyrillic", f("cyrillic")).when(script == "greek", f("greek")).otherwise(f("latin"))

    def given(script):
        names = {"m": MALE_NAMES[script], "f": FEMALE_NAMES[script], "n": MALE_NAMES[script] + FEMALE_NAMES[script]}
        is_m, is_f = F.col("type") == "given_m", F.col("type") == "given_f"
        listed = F.when(is_m, pick(names["m"])).when(is_f, pick(names["f"])).otherwise(pick(names["n"]))
        return (F.when(attempt < LISTED, listed).when(is_m, gendered(script, MALE_ENDINGS))
                .when(is_f, gendered(script, FEMALE_ENDINGS)).otherwise(made(script)))

    card = renew(norm, 1)
    body = F.concat(F.substring(card, F.lit(1), F.length(norm) - 1), wider(norm, "0123456789"))
    check = ((10 - _luhn(F.concat(body, F.lit("0"))) % 10) % 10).cast("string")
    octets = F.concat_ws(".", *[(1 + byte(F.lit(i)) % 254).cast("string") for i in range(4)])
    more_octets = F.regexp_replace(wider(norm, "123456789", WIDEN_IP), "(.)", r".$1")
    local, domain = F.substring_index(norm, "@", 1), F.col("norm")
    top = F.concat(F.lit("."), F.substring_index(domain, ".", -1))
    labels = F.substring(domain, F.lit(1), F.length(domain) - F.length(top))
    letters, digits = LETTERS["latin"], "0123456789"
    country, account = F.substring(norm, 1, 2), F.concat(renew(F.substring(norm, F.lit(5), F.length(norm))), wider(norm, digits))
    valid = _mod97(F.concat(F.substring(norm, F.lit(5), F.length(norm)), F.substring(norm, 1, 4))) == 1
    pair = F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0")
    value = (F.when(F.col("type") == "email", F.concat(renew(local), wider(local, letters), F.lit("@"), F.substring_index(norm, "@", -1)))
             .when(F.col("type") == "domain", F.concat(renew(labels), wider(labels, letters), top))
             .when(F.col("type") == "iban", F.when(valid, F.concat(country, pair, account))
                   .otherwise(F.concat(renew(norm, 2), wider(norm, digits))))
             .when(F.col("type") == "ip", F.concat(octets, more_octets))
             .when(F.col("type") == "ssn", F.concat(renew(norm), wider(norm, digits)))
             .when(F.col("type") == "card", F.when(_luhn(norm) % 10 == 0, F.concat(body, check)).otherwise(F.concat(card, wider(norm, digits))))
             .when(F.col("type") == "phone", F.concat(renew(norm, 1), wider(norm, digits)))
             .when(F.col("type").startswith("given"), by_script(given))
             .otherwise(by_script(made)))
    return stream, value


def assign(entities: DataFrame, key: str) -> DataFrame:
    """(type, norm, surrogate) for distinct entities (type, norm): no two of a type share a
    surrogate, and none is an entity of its type.  Each round draws again for those that
    clash; of several that draw the same, the smallest keeps it.  Surrogates grow with the
    attempts, so there are always free ones."""
    stream, value = _surrogate(key)
    done, open_ = None, settle(entities.withColumn("attempt", F.lit(0)))
    family = F.when(F.col("type").startswith("given"), "given").otherwise(F.col("type"))
    known = settle(entities.select(family.alias("family"), F.lower("norm").alias("drawn")).distinct())
    while open_.limit(1).count():
        drawn = settle(open_.withColumn("stream", stream).withColumn("surrogate", value).drop("stream")
                       .withColumn("family", family).withColumn("drawn", F.lower("surrogate")))
        first = drawn.groupBy("family", "drawn").agg(F.min(F.struct("type", "norm")).alias("first"))
        free = drawn.join(known, ["family", "drawn"], "left_anti").join(first, ["family", "drawn"])
        new = settle(free.where((F.col("first.type") == F.col("type")) & (F.col("first.norm") == F.col("norm")))
                     .select("type", "norm", "surrogate", "family", "drawn"))
        still = settle(drawn.join(new.select("type", "norm"), ["type", "norm"], "left_anti")
                       .select("type", "norm", (F.col("attempt") + 1).alias("attempt")))
        known = settle(known.unionByName(new.select("family", "drawn")))
        rows = new.select("type", "norm", "surrogate")
        done = rows if done is None else done.unionByName(rows)
        discard(drawn)
        discard(open_)
        open_ = still
    return entities.limit(0).withColumn("surrogate", F.lit("")) if done is None else settle(done)


def _in_form_of(raw, kind, surrogate):
    """The surrogate with the separators and the case of the mention; what it has more follows."""
    def next_digit(state, c):
        is_digit = c.rlike("^[0-9A-Z]$")
        return F.struct(F.concat(state["out"], F.when(is_digit, F.substring(surrogate, state["at"], 1)).otherwise(c)).alias("out"),
                        (state["at"] + is_digit.cast("int")).alias("at"))

    spaced = F.aggregate(F.split(raw, "", -1), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), next_digit,
                         lambda s: F.concat(s["out"], F.substring(surrogate, s["at"], F.length(surrogate))))
    text = F.when(kind == "email", F.substring_index(surrogate, "@", 1)).otherwise(surrogate)
    cased = F.array_join(F.transform(F.split(raw, "", -1), lambda c, i: F.when(
        c.rlike("^[A-Z]$"), F.upper(F.substring(text, i + 1, 1))).otherwise(F.substring(text, i + 1, 1))), "")
    cased = F.concat(cased, F.substring(text, F.length(raw) + 1, F.length(text)))
    lead = F.when(raw.startswith(" "), " ").otherwise("")
    name = F.when(F.upper(raw) == raw, F.upper(surrogate)).otherwise(surrogate)
    return (F.when(kind.isin("email", "domain"), cased).when(kind.isin("card", "phone", "ssn", "iban"), spaced)
            .when(kind == "ip", surrogate).otherwise(F.concat(lead, name)))


def replace_pii(docs: DataFrame, key: str) -> DataFrame:
    """All columns of ``docs`` (doc_id, text, ...) with surrogates in text, plus n_entities
    (mentions replaced).

    Equal entities get equal surrogates in all documents, different ones different ones; the
    same ``key`` gives the same surrogates again for the same corpus.  Null texts stay null
    and, like empty ones, have no mentions; repeated rows are treated alike; very long texts
    are read whole; an empty table gives an empty result."""
    base = pack(docs, "doc_id", "text", text_key().alias("tkey"))
    found = (base.select("doc_id", "tkey", F.when(F.col("text").rlike(SIEVE), F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0))).alias("m"))
             .where(F.size("m") > 0).dropDuplicates(["doc_id", "tkey"]))
    mentions = found.select("doc_id", "tkey", F.posexplode("m").alias("i", "match"))
    parts = settle(mentions.select("doc_id", "tkey", "i", F.posexplode(_parts(F.col("match"))).alias("j", "part"))
                   .select("doc_id", "tkey", "i", "j", "part.type", "part.norm", "part.raw"))
    entities = settle(parts.where("type is not null").select("type", "norm").distinct())
    table = broadcast_if_small(assign(entities, key), F.length("norm") + F.length("surrogate") + 64)
    new = parts.join(table, ["type", "norm"], "left").select(
        "doc_id", "tkey", "i", "j", F.when(F.col("type").isNull(), F.col("raw")).otherwise(
            _in_form_of(F.col("raw"), F.col("type"), F.col("surrogate"))).alias("new"))
    mention = new.groupBy("doc_id", "tkey", "i").agg(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("j", "new"))), lambda x: x["new"]), "").alias("new"))
    per_doc = settle(mention.groupBy("doc_id", "tkey").agg(F.transform(
        F.sort_array(F.collect_list(F.struct("i", "new"))), lambda x: x["new"]).alias("new")))
    joined = join_rows(base, broadcast_if_small(per_doc, F.length(F.array_join("new", "")) * 4 + F.size("new") * 16 + 64), "left")
    # the text between the mentions, each part followed by the surrogate of the next mention
    text = F.array_join(F.zip_with(F.split("text", PATTERN, -1), F.concat("new", F.array(F.lit(""))), lambda gap, new: F.concat(gap, new)), "")
    return unpack(joined, docs, text=F.when(F.col("new").isNull(), F.col("text")).otherwise(text),
                  n_entities=F.coalesce(F.size("new"), F.lit(0)).cast("long"))
