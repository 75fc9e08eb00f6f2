r"""Personal data replaced by keyed surrogates of the same kind. DataFrame functions only.

Entities are found by one pattern: e-mail addresses, phone numbers, payment cards, social-security and account numbers,
IPv4 addresses, secrets (long hexadecimal or access-key strings), names after a title, and given names of the table with a
surname. Names found so are looked for again in their text, alone and without a title. A name is taken apart into its given name and
its surname, so "Mr. John Smith", "John Smith" and "Smith" keep to one person.

Each distinct entity gets a surrogate drawn by HMAC-SHA-512 of the caller's key, the type, the entity and the number of the draw:

* format: every digit, letter (of its script and case) or hexadecimal digit becomes another of its class; separators, lengths, country
  codes, a card's first digit and an address's last label stay; check digits of cards and accounts are valid where the original's are;
* gender and script: a given name comes from ``names`` (script, gender: names), the gender from the title, else from the table; a
  surname is made of syllables of its script. Titles stay;
* coreference: a surrogate depends on the entity alone, so equal entities have equal ones everywhere; addresses of one
  domain keep one;
* distinctness: draws that two entities share, or that are themselves entities of the corpus, are found by a
  shuffle of the distinct entities; all but the first of such entities draw again, until no such draw is left. From the
  sixteenth draw on surrogates grow by a character every eight draws, so that a full format (a million numbers of six digits) ends too.

Results: null texts stay null; equal texts, repeated rows among them, have equal results; null ids do not matter; other columns are kept, whatever their names; an empty table
gives an empty table; texts are read whole. Where types overlap the earlier in ``TYPES`` wins. With another corpus an entity that had to draw again
may have another surrogate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch
from .words import free

#: Titles by gender; fixed values.
TITLES = {
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "г-н"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "Doña", "г-жа"],
    "u": ["Dr", "Prof"],
}
#: Given names by script and gender; callers pass their own.
NAMES = {
    ("latin", "m"): ["John", "James", "Peter", "Paul", "Thomas", "Daniel", "Martin", "Karl", "Hans", "Jean", "Pierre", "Luis", "Carlos", "Marco"],
    ("latin", "f"): ["Mary", "Anna", "Laura", "Emma", "Sarah", "Julia", "Ingrid", "Petra", "Claire", "Marie", "Sofia", "Elena", "Carmen", "Lucia"],
    ("cyrillic", "m"): ["Иван", "Пётр", "Сергей", "Андрей", "Николай", "Павел"],
    ("cyrillic", "f"): ["Анна", "Мария", "Ольга", "Елена", "Ирина", "Татьяна"],
    ("greek", "m"): ["Γιώργος", "Νίκος", "Κώστας", "Πέτρος"],
    ("greek", "f"): ["Μαρία", "Ελένη", "Άννα", "Σοφία"],
}
#: Sixteen syllables a script, and the endings of made-up given names by gender.
SYLLABLES = {
    "latin": ["bar", "den", "fol", "gan", "hal", "ker", "lom", "mir", "nor", "pel", "ros", "sal", "tam", "ven", "wil", "zor"],
    "cyrillic": ["бар", "ден", "фол", "ган", "хал", "кер", "лом", "мир", "нор", "пел", "рос", "сал", "там", "вен", "жил", "зор"],
    "greek": ["βαρ", "δεν", "φολ", "γαν", "χαλ", "κερ", "λομ", "μιρ", "νορ", "πελ", "ροσ", "σαλ", "ταμ", "βεν", "θιλ", "ζορ"],
}
ENDINGS = {"latin": {"m": "o", "f": "a", "u": "e"}, "cyrillic": {"m": "", "f": "а", "u": "о"}, "greek": {"m": "ος", "f": "α", "u": "ο"}}

_TITLE = "|".join(t for g in "mfu" for t in sorted(TITLES[g], key=len, reverse=True))
_NAME = r"\p{Lu}[\p{L}'’-]+"

#: Types and patterns; the pattern of a text holds them in this order.
TYPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9.-]*[A-Za-z0-9])?\.[A-Za-z]{2,}",
    "secret": r"\b(?:[0-9a-f]{32,128}|[0-9A-F]{32,128}|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36}|sk-[0-9A-Za-z]{20,64})\b",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![\d.-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\d-])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]\d{3,4}[ .-]\d{3,4}(?![\d.]\d)|(?<=(?:[Pp]hone|[Tt]el|[Cc]all|[Mm]obile|[Ff]ax|[Tt]elefon)[:. ]{1,3})\+?\d{7,15}(?!\d)",
    "name": rf"(?<!\p{{L}})(?:{_TITLE})\.? {_NAME}(?: {_NAME})?",
}


class Rules:
    """The patterns that follow from a table of given names."""

    def __init__(self, names: dict[tuple[str, str], list[str]] | None = None):
        self.names = names or NAMES
        given = sorted({n for x in self.names.values() for n in x}, key=len, reverse=True)
        self.person = rf"(?<!\p{{L}})(?:{'|'.join(given)}) {_NAME}" if given else r"(?!)"
        self.types = TYPES | {"person": self.person}
        self.entity = "|".join(f"(?:{p})" for p in self.types.values())
        #: Texts without any of these hold no entity; cheaper than the pattern.
        self.hint = rf"[0-9@]|(?:{_TITLE})\.? |(?:{'|'.join(given)}) "

    def gender(self, given: Column, else_: Column) -> Column:
        out = else_
        for (_, g), known in self.names.items():
            out = F.when(given.isin(known), g).otherwise(out)
        return out


def let(value: Column, f) -> Column:
    """f(value), with value evaluated once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def kind(entity: Column, rules: Rules) -> Column:
    out = F.lit(None).cast("string")
    for name, pattern in reversed(rules.types.items()):
        # a number that only a word before it makes a phone number stands alone here
        alone = r"|\+?\d{7,15}" if name == "phone" else ""
        out = F.when(F.regexp_like(entity, F.lit(f"^(?:{pattern}{alone})$")), name).otherwise(out)
    return out


def parts(entity: Column, rules: Rules) -> Column:
    """What is replaced in an entity: (type, token); a name's given name and surname apart. Empty for a bare name."""
    title = F.regexp_extract(entity, rf"^((?:{_TITLE})\.? )", 1)
    words = F.split(F.substring(entity, F.char_length(title) + 1, F.char_length(entity)), " ")
    told = F.lit("u")
    for g in "mf":
        told = F.when(F.regexp_like(title, F.lit(rf"^(?:{'|'.join(TITLES[g])})\.? $")), g).otherwise(told)
    part = lambda k, t: F.struct(k.alias("kind"), t.alias("token"))

    def name(w: Column) -> Column:
        given = F.when(told == "u", rules.gender(w[0], F.lit("u"))).otherwise(told)
        return F.when(F.size(w) == 1, F.array(part(F.lit("surname"), w[0]))).otherwise(F.array(part(F.concat(F.lit("given:"), given), w[0]), part(F.lit("surname"), F.get(w, F.lit(1)))))

    def of(t: Column) -> Column:
        return F.when(t.isNull(), F.array().cast("array<struct<kind:string,token:string>>")).when(t.isin("name", "person"), let(words, name)).otherwise(F.array(part(t, entity)))

    return let(kind(entity, rules), of)


def entities(docs: DataFrame, text_column: str, rules: Rules) -> DataFrame:
    """text_key, pattern, and the entities (title, parts, entity) in the order of the text, of each distinct text that has some."""
    text = docs[f"`{text_column}`"]
    rows = docs.where(F.regexp_like(text, F.lit(rules.hint))).select(F.md5(text).alias("text_key"), text.alias("text"))
    rows = rows.withColumn("found", F.regexp_extract_all("text", F.lit(rules.entity), F.lit(0))).where(F.size("found") > 0)
    rows = rows.withColumn("split", F.transform("found", lambda e: parts(e, rules)))
    named = F.array_distinct(F.filter(F.flatten("split"), lambda p: (p["kind"] == "surname") | p["kind"].startswith("given:")))
    rows = rows.withColumn("names", named)
    tokens = F.array_join(F.array_sort(F.array_distinct(F.transform("names", lambda p: p["token"])), lambda a, b: F.char_length(b) - F.char_length(a)), "|")
    own = F.concat(F.lit(rules.entity + r"|(?<!\p{L})(?:"), tokens, F.lit(r")(?!\p{L})"))
    rows = rows.withColumn("pattern", F.when(F.size("names") > 0, own).otherwise(rules.entity))
    again = F.transform(F.regexp_extract_all("text", F.col("pattern"), F.lit(0)), lambda e: F.struct(e.alias("entity"), parts(e, rules).alias("parts")))
    rows = rows.withColumn("found", F.when(F.size("names") > 0, again).otherwise(F.arrays_zip(F.col("found").alias("entity"), F.col("split").alias("parts"))))
    bare = lambda x: F.struct(x["entity"].alias("entity"), F.when(F.size(x["parts"]) > 0, x["parts"]).otherwise(F.slice(F.filter("names", lambda p: p["token"] == x["entity"]), 1, 1)).alias("parts"))
    return rows.select("text_key", "pattern", F.transform("found", bare).alias("found")).dropDuplicates(["text_key"])


#: Letters that are drawn among themselves; fixed values.
CLASSES = [
    "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "àáâäãåçèéêëìíîïñòóôöõùúûü", "ÀÁÂÄÃÅÇÈÉÊËÌÍÎÏÑÒÓÔÖÕÙÚÛÜ",
    "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ", "αβγδεζηθικλμνξοπρστυφχψω", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ",
]
HEX = ["0123456789abcdef", "0123456789ABCDEF"]


def hmac(key: str, message: Column) -> Column:
    """HMAC with SHA-512, in hexadecimal digits."""
    from hashlib import sha512

    secret = key.encode() if len(key.encode()) <= 128 else sha512(key.encode()).digest()
    inner, outer = (bytes(b ^ pad for b in secret.ljust(128, b"\0")) for pad in (0x36, 0x5C))
    first = F.sha2(F.concat(F.lit(bytearray(inner)), F.encode(message, "UTF-8")), 512)
    return F.sha2(F.concat(F.lit(bytearray(outer)), F.unhex(first)), 512)


def drawn(key: str, kind_: Column, token: Column, attempt: Column) -> Column:
    """Two hexadecimal digits for every character of the token, and 32 more."""
    blocks = F.sequence(F.lit(0), F.floor((F.char_length(token) + 16) / 64).cast("int"))
    return F.array_join(F.transform(blocks, lambda j: hmac(key, F.concat_ws("\n", kind_, attempt.cast("string"), j.cast("string"), token))), "")


def number(hexes: Column, i: Column) -> Column:
    """The i-th byte."""
    return F.conv(F.substring(hexes, i * 2 + 1, F.lit(2)), 16, 10).cast("int")


def characters(text: Column, hexes: Column, classes: list[str] = CLASSES) -> Column:
    """Every character drawn anew within its class; characters of no class stay."""

    def turned(c: Column, i: Column) -> Column:
        out = c
        for letters in reversed(classes):
            out = F.when(F.position(c, F.lit(letters)) > 0, F.substring(F.lit(letters), number(hexes, i) % len(letters) + 1, F.lit(1))).otherwise(out)
        return out

    return F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), turned), "")


def luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, the last of weight 1."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(c == "", 0).otherwise(let(F.coalesce(c.try_cast("int"), F.lit(0)) * (1 + i % 2), lambda d: F.when(d > 9, d - 9).otherwise(d))))
    return F.aggregate(each, F.lit(0), lambda s, d: s + d) % 10


def with_last(text: Column, digit: Column) -> Column:
    """text with its last digit replaced; it ends with one."""
    return F.concat(F.substring(text, F.lit(1), F.char_length(text) - 1), digit.cast("string"))


def card(token: Column, hexes: Column) -> Column:
    plain = lambda x: F.regexp_replace(x, "[^0-9]", "")
    turned = F.concat(F.substring(token, 1, 1), F.substring(characters(token, hexes), F.lit(2), F.char_length(token)))
    valid = let(turned, lambda t: let(with_last(t, F.lit(0)), lambda z: with_last(z, (10 - luhn(plain(z))) % 10)))
    return F.when(luhn(plain(token)) == 0, valid).otherwise(turned)


def mod97(account: Column) -> Column:
    """The remainder of an account number, its first four characters moved to the end, letters as 10 to 35."""
    plain = F.replace(account, F.lit(" "), F.lit(""))
    moved = F.concat(F.substring(plain, F.lit(5), F.char_length(plain)), F.substring(plain, 1, 4))
    value = lambda c: F.ascii(c) - F.when(F.ascii(c) > 64, 55).otherwise(48)
    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0), lambda s, c: (s * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97)


def iban(token: Column, hexes: Column) -> Column:
    rest = F.substring(characters(token, hexes), F.lit(5), F.char_length(token))
    country = F.substring(token, 1, 2)
    checked = let(F.concat(country, F.lit("00"), rest), lambda z: F.concat(country, F.lpad((98 - mod97(z)).cast("string"), 2, "0"), rest))
    return F.when(mod97(token) == 1, checked).otherwise(F.concat(country, F.substring(characters(token, hexes), 3, 2), rest))


def script(token: Column) -> Column:
    return F.when(F.regexp_like(token, F.lit(r"\p{IsCyrillic}")), "cyrillic").when(F.regexp_like(token, F.lit(r"\p{IsGreek}")), "greek").otherwise("latin")


def made_up(hexes: Column, script_: str, syllables: Column) -> Column:
    """A capitalised word of so many syllables."""
    table = F.array(*map(F.lit, SYLLABLES[script_]))
    return F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), syllables - 1), lambda i: F.get(table, number(hexes, i) % 16)), ""))


def surname(token: Column, hexes: Column, attempt: Column) -> Column:
    out = F.lit(None).cast("string")
    for s in SYLLABLES:
        out = F.when(script(token) == s, made_up(hexes, s, 3 + F.floor(attempt / 2).cast("int"))).otherwise(out)
    return out


def given(kind_: Column, token: Column, hexes: Column, attempt: Column, rules: Rules) -> Column:
    """First names of the table, then made-up ones that end as the gender does."""
    out = F.lit(None).cast("string")
    for s in SYLLABLES:
        for g in "mfu":
            known = sorted({n for (x, y), some in rules.names.items() if x == s and g in (y, "u") for n in some})
            new = F.concat(made_up(hexes, s, 2 + F.floor(attempt / 2).cast("int")), F.lit(ENDINGS[s][g]))
            pick = F.when(attempt < 4, F.get(F.array(*map(F.lit, known)), F.conv(F.substring(hexes, 1, 7), 16, 10).cast("int") % len(known))).otherwise(new) if known else new
            out = F.when((script(token) == s) & (kind_ == f"given:{g}"), pick).otherwise(out)
    return out


def surrogate(kind_: Column, token: Column, attempt: Column, key: str, rules: Rules) -> Column:
    """The draw of that number for a token."""
    longer = F.greatest(F.lit(0), F.floor((attempt - 8) / 8)).cast("int")
    more = F.repeat(F.lit("7"), longer)  # one more digit to draw for every eight draws from the sixteenth on

    def of(hexes: Column) -> Column:
        local, domain = F.split_part(token, F.lit("@"), F.lit(1)), F.split_part(token, F.lit("@"), F.lit(2))
        last = F.regexp_extract(domain, r"(\.[A-Za-z]+)$", 1)
        front = F.substring(domain, F.lit(1), F.char_length(domain) - F.char_length(last))
        host = characters(front, drawn(key, F.lit("domain"), domain, F.lit(0)))
        prefix = F.regexp_extract(token, r"^(AKIA|gh[pousr]_|sk-)?", 1)
        rest = F.concat(F.substring(token, F.char_length(prefix) + 1, F.char_length(token)), more)
        low, high = F.regexp_like(token, F.lit("^[0-9a-f]+$")), F.regexp_like(token, F.lit("^[0-9A-F]+$"))
        code = F.regexp_extract(token, r"^(\+\d{1,3}[ .-])", 1)
        address = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: number(hexes, i) % 254 + 1), ".")
        return (
            F.when(kind_ == "email", F.concat(characters(F.concat(local, more), hexes), F.lit("@"), host, last))
            .when(kind_ == "secret", F.when(low, characters(rest, hexes, HEX[:1])).when(high, characters(rest, hexes, HEX[1:])).otherwise(F.concat(prefix, characters(rest, hexes))))
            .when(kind_ == "ip", address)
            .when(kind_ == "iban", iban(F.concat(token, more), hexes))
            .when(kind_ == "card", card(F.concat(token, more), hexes))
            .when(kind_ == "phone", F.concat(code, characters(F.concat(F.substring(token, F.char_length(code) + 1, F.char_length(token)), more), hexes)))
            .when(kind_ == "surname", surname(token, hexes, attempt))
            .when(kind_.startswith("given:"), given(kind_, token, hexes, attempt, rules))
            .otherwise(characters(F.concat(token, more), hexes))
        )

    return let(drawn(key, kind_, F.concat(token, more), attempt), of)


def mapping(tokens: DataFrame, key: str, rules: Rules, scratch: Scratch) -> DataFrame:
    """kind, token and surrogate of the distinct tokens (kind, token); no surrogate is shared by two tokens or a token itself."""
    draw = lambda rows: rows.withColumn("surrogate", surrogate(F.col("kind"), F.col("token"), F.col("attempt"), key, rules))
    real = scratch.keep(tokens.select("token").distinct(), "real")
    now = scratch.keep(draw(tokens.withColumn("attempt", F.lit(0))), "drawn0")
    k = 0
    while True:
        # equal tokens of two types may share a surrogate: it is one entity seen twice
        first = now.groupBy("surrogate").agg(F.min(F.struct("attempt", "token")).alias("first"))
        shared = now.join(first, "surrogate").where(F.struct("attempt", "token") != F.col("first")).select("kind", "token")
        same = now.join(real.select(F.col("token").alias("surrogate")), "surrogate", "left_semi").select("kind", "token")
        again = scratch.keep(shared.unionByName(same).distinct(), f"again{k}")
        if again.isEmpty():
            return now.select("kind", "token", "surrogate")
        k += 1
        stay = now.join(again, ["kind", "token"], "left_anti")
        more = draw(now.join(again, ["kind", "token"], "left_semi").select("kind", "token", (F.col("attempt") + 1).alias("attempt")))
        now = scratch.keep(stay.unionByName(more), f"drawn{k}")


def prepared(docs: DataFrame, key: str, names: dict[tuple[str, str], list[str]] | None, text_column: str) -> tuple[DataFrame, DataFrame]:
    """Of each distinct text with entities text_key, pattern, entities and surrogates in its order; and the mapping."""
    if not key:
        raise ValueError("surrogates need a key")
    rules, scratch = Rules(names), Scratch(docs.sparkSession, "pii")
    found = scratch.keep(entities(docs, text_column, rules), "entities")
    tokens = found.select("text_key", F.explode(F.array_distinct(F.flatten(F.transform("found", lambda x: x["parts"])))).alias("p")).select("text_key", "p.kind", "p.token")
    known = scratch.keep(mapping(tokens.select("kind", "token").distinct(), key, rules, scratch), "mapping")
    entry = F.struct(F.concat_ws("\n", "kind", "token").alias("k"), F.col("surrogate").alias("v"))
    maps = tokens.join(known.hint("merge"), ["kind", "token"]).groupBy("text_key").agg(F.map_from_entries(F.collect_list(entry)).alias("by"))
    title = lambda e: F.regexp_extract(e, rf"^((?:{_TITLE})\.? )", 1)
    named = lambda x: F.when(F.element_at(x["parts"], 1)["kind"].rlike("^(surname|given:.)$"), title(x["entity"])).otherwise("")
    out = lambda x: F.concat(named(x), F.array_join(F.transform(x["parts"], lambda p: F.element_at("by", F.concat_ws("\n", p["kind"], p["token"]))), " "))
    ready = found.join(maps.hint("merge"), "text_key").select("text_key", "pattern", F.transform("found", lambda x: x["entity"]).alias("entities"), F.transform("found", out).alias("surrogates"))
    ready = scratch.keep(ready, "ready")
    scratch.keep_only("ready", "mapping")
    return ready, known


def anonymise(docs: DataFrame, key: str, names: dict[tuple[str, str], list[str]] | None = None, text_column: str = "text", entities_column: str = "__entities") -> DataFrame:
    """All columns of docs, the text with surrogates, and what was found; a column of that name in docs is an error."""
    if entities_column in docs.columns:
        raise ValueError(f"docs have a column {entities_column}")
    ready, _ = prepared(docs, key, names, text_column)
    text = docs[f"`{text_column}`"]
    text_key, pattern, surrogates = (free(docs, c) for c in ("text_key", "pattern", "surrogates"))
    # one plan at every size: texts with entities grow with the documents, so they are never broadcast
    joined = docs.join(ready.toDF(text_key, pattern, entities_column, surrogates).hint("merge"), F.md5(text) == F.col(text_key), "left")
    pieces = F.split(text, F.col(pattern), -1)
    new = F.array_join(F.zip_with(pieces, F.col(surrogates), lambda p, s: F.concat(F.coalesce(p, F.lit("")), F.coalesce(s, F.lit("")))), "")
    new = F.when(F.col(text_key).isNotNull(), new).otherwise(text)
    return joined.select(*(new.alias(c) if c == text_column else docs[f"`{c}`"] for c in docs.columns), F.coalesce(entities_column, F.array().cast("array<string>")).alias(entities_column))


def collisions(docs: DataFrame, key: str, names: dict[tuple[str, str], list[str]] | None = None) -> DataFrame:
    """Surrogates that stand for several tokens or are tokens of the corpus themselves, (surrogate, entities): none, by construction."""
    _, known = prepared(docs, key, names, "text")
    real = known.select(F.col("token").alias("surrogate")).distinct().withColumn("real", F.lit(True))
    counts = known.groupBy("surrogate").agg(F.collect_set("token").alias("entities")).join(real, "surrogate", "left")
    return counts.where((F.size("entities") > 1) | F.col("real")).select("surrogate", "entities")


def query(spark, sf_dir: str) -> DataFrame:
    """The key is the session's spark.basalt.pii.key; without one, a key that nobody keeps."""
    from secrets import token_hex

    out = anonymise(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.conf.get("spark.basalt.pii.key", None) or token_hex(32))
    return out.select("doc_id", "text", F.size("__entities").cast("long").alias("n_entities"), F.size(F.array_distinct("__entities")).cast("long").alias("n_distinct"))
