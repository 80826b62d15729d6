"""Personal data replaced by keyed surrogates of the same type, script, gender and format.

A surrogate is a function of a secret key, the type and the entity's canonical form, so one entity has the same
surrogate wherever it stands, and no table of entities has to meet the texts. Surrogates that two entities share, or
that are themselves an entity of the corpus, are drawn again; only those exceptions are joined to the texts.
Everything is built from SQL functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..session import materialize
from .common import bounded_broadcast, fresh, settle

KEY = "public-test-key"

#: Titles before a name, by gender.
TITLES = {
    "f": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Госпожа"),
    "m": ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин"),
    "": ("Dr", "Prof"),
}
#: The words of a name are entities of their own: first names by gender, and the last word.
NAME_KINDS = ("first-f", "first-m", "surname")
#: Fixed: how many digits the country code of an international number has, by its first digits.
_COUNTRY = r"\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{1,3})"

_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))
_GAP = r"[ .-]?"
_HEX, _OCTET = "[0-9A-Fa-f]{1,4}", "(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
#: A word of a name; parts after a hyphen or an apostrophe belong to it.
_NAME_WORD = r"\p{Lu}[\p{L}\p{M}]*+(?:['’-]\p{L}[\p{L}\p{M}]*+)*+"
#: Types in the order in which they are tried, as Java patterns. Every start is anchored, so a text is scanned once.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "secret": r"(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])"
    r"|(?<![A-Za-z])(?i:api[_-]?key|token|password|passwd|secret)[ ]?[=:][ ]?\"?[A-Za-z0-9_+/-]{8,}+\"?",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip6": rf"(?<![0-9A-Za-z:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?:{_HEX}:){{2,6}}(?::{_HEX}){{1,5}})(?![0-9A-Za-z:])",
    "ip": rf"(?<![0-9A-Za-z.])(?<!(?i:version|release|build|ver\.) {{1,2}})(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "card": r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,18}(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": rf"(?<![0-9A-Za-z])(?:\+[0-9]{{1,3}}{_GAP})?\([0-9]{{2,5}}\){_GAP}[0-9]{{2,4}}(?:{_GAP}[0-9]{{2,4}}){{1,3}}(?![0-9])"
    rf"|(?<![0-9A-Za-z])\+[0-9]{{1,3}}(?:{_GAP}[0-9]{{2,4}}){{2,5}}(?![0-9])"
    r"|(?<![0-9A-Za-z.-])[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
    "name": rf"(?<!\p{{L}})(?:{_TITLE})\.? {_NAME_WORD}(?: {_NAME_WORD}){{0,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())

# What every entity has at least: a digit or a sign, a prefix or the title of a name. Texts without are not scanned further.
_HINT = "[0-9@=:]"

# Letters of invented names; the last one tells the gender.
_ONSET, _NUCLEUS = "bdfgklmnprstvz", "aeiou"
_CYRILLIC = ("abdefgiklmnoprstuvzABDEFGIKLMNOPRSTUVZ", "абдефгиклмнопрстувзАБДЕФГИКЛМНОПРСТУВЗ")


def may_hold(text: Column) -> Column:
    """False only for texts that hold no entity; looks for single characters and plain words."""
    hint = text.rlike(_HINT) | text.contains("AKIA")
    for titles in TITLES.values():
        for title in titles:
            hint = hint | text.contains(title)
    return hint


def kind_of(entity: Column) -> Column:
    return F.coalesce(*[F.when(entity.rlike(f"^(?:{p})$"), k) for k, p in PATTERNS.items()], F.lit("name"))


def canonical(entity: Column, kind: Column) -> Column:
    """One form for the ways in which an entity is written: no case in addresses and names, digits only in numbers."""
    return F.when(kind.isin("email", "ip6", *NAME_KINDS), F.lower(entity)).when(
        kind.isin("card", "ssn", "phone"), F.regexp_replace(entity, "[^0-9]", "")
    ).when(kind == "iban", F.regexp_replace(entity, " ", "")).when(
        kind == "secret", F.regexp_replace(entity, r"^(?i:[a-z_-]+)[ ]?[=:][ ]?\"?|\"$", "")
    ).otherwise(entity)


def pieces(entity: Column, kind: Column) -> Column:
    """kind, canon, written of what is replaced on its own: the words of a name, any other entity as a whole.

    So a person who is first named in full and then by the last name keeps one surrogate for it.
    """
    words = F.split(F.regexp_replace(entity, rf"^(?:{_TITLE})\.? ", ""), " ")
    first = F.when(F.regexp_extract(entity, rf"^({_TITLE})", 1).isin(*TITLES["f"]), "first-f").otherwise("first-m")
    named = F.transform(words, lambda w, i: F.struct(
        F.when(i == F.size(words) - 1, "surname").otherwise(first).alias("kind"), F.lower(w).alias("canon"), w.alias("written")
    ))
    whole = F.array(F.struct(kind.alias("kind"), canonical(entity, kind).alias("canon"), entity.alias("written")))
    return F.when(kind == "name", named).otherwise(whole)


def _digest(key: str, kind: Column, canon: Column, salt: Column) -> Column:
    return F.sha2(F.concat_ws("\u0001", F.lit(key), kind, canon, salt.cast("string")), 512)


def _number(digest: Column, place: Column | int, below: int) -> Column:
    """A number below ``below`` from one place of the digest; places beyond its end start again, shifted."""
    place = place if isinstance(place, Column) else F.lit(place)
    at = (F.pmod(place * 3 + F.floor(place / 40), F.lit(124)) + 1).cast("int")
    return F.pmod(F.conv(F.substr(digest, at, F.lit(5)), 16, 10).cast("int") + place, F.lit(below))


def _like(text: Column, digest: Column, hexadecimal: Column) -> Column:
    """Every letter and digit of a text replaced by one of its class and script; the n-th alike however they are spaced."""
    letters = F.lit("abcdefghijklmnopqrstuvwxyz")

    def step(state: Column, char: Column) -> Column:
        place, known = state["n"], char.rlike(r"^[\p{L}\p{N}]$")
        low = F.when(hexadecimal, F.substr(F.lit("abcdef"), _number(digest, place, 6) + 1, F.lit(1))).otherwise(
            F.substr(letters, _number(digest, place, 26) + 1, F.lit(1))
        )
        new = F.when(char.rlike(r"^\p{N}$"), _number(digest, place, 10).cast("string")).when(
            char.rlike("^[a-z]$"), low
        ).when(char.rlike("^[A-Z]$"), F.upper(low)).when(
            known, F.when(char.rlike(r"^\p{IsCyrillic}$"), F.translate(low, *_CYRILLIC)).otherwise(low)
        ).otherwise(char)
        return F.struct(F.concat(state["out"], new).alias("out"), (place + F.when(known, 1).otherwise(0)).alias("n"))

    return F.aggregate(F.split(text, ""), F.struct(F.lit("").alias("out"), F.lit(0).alias("n")), step, lambda s: s["out"])


def _luhn(digits: Column) -> Column:
    """The check digit that digits before it ask for."""
    places = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(
        i % 2 == 0, d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)
    ).otherwise(d.cast("int")))
    return F.pmod(10 - F.aggregate(places, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10, F.lit(10))


def _last_digit(text: Column, digit: Column) -> Column:
    return F.concat(F.substr(text, F.lit(1), F.length(text) - 1), digit.cast("string"))


def _name_word(word: Column, digest: Column, feminine: Column, salt: Column) -> Column:
    """An invented word in the script of ``word``; a first name ends by gender. It has three syllables, and one more
    for every time it has been drawn again, so words never run out."""
    letter = lambda letters, place: F.substr(F.lit(letters), _number(digest, place, len(letters)) + 1, F.lit(1))
    syllables = F.transform(F.sequence(F.lit(0), salt + 2), lambda i: F.concat(letter(_ONSET, i * 2), letter(_NUCLEUS, i * 2 + 1)))
    plain = F.initcap(F.concat(F.array_join(syllables, ""), F.when(feminine, F.lit("na")).otherwise(F.lit("no"))))
    return F.when(word.rlike(r"\p{IsCyrillic}"), F.translate(plain, *_CYRILLIC)).otherwise(plain)


def surrogate(entity: Column, kind: Column, canon: Column, salt: Column, key: str) -> Column:
    """The surrogate of an entity in the format in which it is written."""
    digest = _digest(key, kind, canon, salt)
    hexadecimal = (kind == "ip6") | ((kind == "secret") & canon.rlike("^[0-9a-f]+$"))
    octets = F.array_join(F.transform(F.split(entity, r"\."), lambda x, i: (_number(digest, i, 254) + 1).cast("string")), ".")
    like = _like(entity, digest, hexadecimal)
    # A card keeps its first digit, and its check digit if the original's is right.
    card = F.concat(F.substr(entity, F.lit(1), F.lit(1)), F.substr(like, F.lit(2)))
    digits = F.regexp_replace(card, "[^0-9]", "")
    right = _luhn(F.substr(canon, F.lit(1), F.length(canon) - 1)).cast("string") == F.substr(canon, F.lit(-1))
    card = F.when(right, _last_digit(card, _luhn(F.substr(digits, F.lit(1), F.length(digits) - 1)))).otherwise(card)
    # An address keeps its last label, a secret its name or prefix, a bank account and a phone number their country.
    tail = F.regexp_extract(entity, r"\.[\p{L}\p{N}-]+$", 0)
    head = F.regexp_extract(entity, r"^((?i:[a-z_-]+)[ ]?[=:][ ]?\"?|AKIA)?", 0)
    country = F.regexp_extract(entity, f"^(?:{_COUNTRY})?", 0)
    return (
        F.when(kind == "ip", octets)
        .when(kind == "card", card)
        .when(kind == "email", F.concat(F.substr(F.lower(like), F.lit(1), F.length(entity) - F.length(tail)), tail))
        .when(kind == "secret", F.concat(head, F.substr(like, F.length(head) + 1)))
        .when(kind == "iban", F.concat(F.substr(entity, F.lit(1), F.lit(2)), F.substr(like, F.lit(3))))
        .when(kind == "phone", F.concat(country, F.substr(like, F.length(country) + 1)))
        .when(kind.isin(*NAME_KINDS), _name_word(entity, digest, kind == "first-f", salt))
        .otherwise(like)
    )


def _collisions(entities: DataFrame, rows: int, key: str) -> DataFrame:
    """kind, canon, salt of the entities, at most ``rows``, whose first surrogate will not do.

    Of entities with one surrogate the smallest keeps it; a surrogate that is an entity of the corpus is given up by
    all. Those that lose draw again and are compared with everything, until nothing collides.
    """
    draw = F.col("salt")
    form = canonical(surrogate(F.col("written"), F.col("kind"), F.col("canon"), draw, key), F.col("kind"))
    now = entities.withColumn("salt", F.lit(0))
    while True:
        now = settle(now.select("kind", "canon", "written", "salt", form.alias("drawn")), "drawn", rows)
        kept = now.groupBy("kind", "drawn").agg(F.min(F.struct("salt", "canon")).alias("winner"), F.count(F.lit(1)).alias("n"))
        shared = now.join(kept.where("n > 1"), ["kind", "drawn"]).where(F.struct("salt", "canon") != F.col("winner")).select("kind", "canon")
        real = now.join(now.select("kind", F.col("canon").alias("drawn")).distinct(), ["kind", "drawn"]).select("kind", "canon")
        losers = settle(shared.unionAll(real).distinct().withColumn("again", F.lit(1)), "losers", rows)
        if losers.isEmpty():
            return now.where("salt > 0").select("kind", "canon", "salt")
        now = now.join(bounded_broadcast(losers), ["kind", "canon"], "left").select(
            "kind", "canon", "written", (F.col("salt") + F.coalesce("again", F.lit(0))).alias("salt")
        )


def replace_entities(docs: DataFrame, text: str = "text", key_column: str = "doc_id", key: str = KEY) -> DataFrame:
    """``docs`` with its text replaced, and n_entities and kinds (sorted types, comma-joined).

    Equal entities of a type get equal surrogates in all documents, different ones different surrogates, and none is
    an entity of the corpus; words of names are entities of their own, and numbers are equal however they are spaced.
    Not found are names without a title, and last names after a title that do not begin with a capital letter. A null text stays null with no entities. Repeated rows get equal texts. Columns named
    n_entities or kinds are replaced.
    """
    docs = docs.drop(*[c for c in ("n_entities", "kinds") if c in docs.columns])
    row, found = fresh(docs, "_row"), fresh(docs, "_found")
    mark = F.xxhash64(F.col(text), F.col(key_column))
    has = may_hold(F.col(text)) & F.col(text).rlike(ANY)
    spotted = docs.where(has).select(mark.alias("row"), F.explode(F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0))).alias("entity"))
    spotted = spotted.select("row", F.inline(pieces(F.col("entity"), kind_of(F.col("entity")))))
    spotted = materialize(spotted.groupBy("row", "kind", "canon").agg(F.min("written").alias("written")), "entities")
    entities = spotted.groupBy("kind", "canon").agg(F.min("written").alias("written"))
    rows = spotted.count()
    odd = bounded_broadcast(settle(_collisions(entities, rows, key), "exceptions", rows))
    salts = spotted.join(odd, ["kind", "canon"]).groupBy("row").agg(
        F.map_from_entries(F.collect_list(F.struct(F.concat_ws("\u0001", "kind", "canon"), "salt"))).alias("_salts")
    )
    salts = bounded_broadcast(settle(salts, "salts", rows)).withColumnRenamed("row", "_salted")
    joined = docs.withColumn(row, F.when(has, mark)).join(salts, F.col(row) == F.col("_salted"), "left")

    def new(entity: Column) -> Column:
        kind = kind_of(entity)

        def drawn(piece: Column) -> Column:
            salt = F.coalesce(F.col("_salts")[F.concat_ws("\u0001", piece["kind"], piece["canon"])], F.lit(0))
            return surrogate(piece["written"], piece["kind"], piece["canon"], salt, key)

        title = F.when(kind == "name", F.regexp_extract(entity, rf"^(?:{_TITLE})\.? ", 0)).otherwise("")
        return F.struct(kind.alias("kind"), F.concat(title, F.array_join(F.transform(pieces(entity, kind), drawn), " ")).alias("text"))

    entities_of = F.when(F.col(row).isNotNull(), F.transform(F.regexp_extract_all(F.col(text), F.lit(ANY), F.lit(0)), new))
    gaps = F.split(F.col(text), ANY, -1)
    woven = F.concat(F.array_join(F.transform(gaps, lambda gap, i: F.concat(gap, F.coalesce(F.get(F.col(found), i)["text"], F.lit("")))), ""))
    columns = [F.when(F.col(row).isNotNull(), woven).otherwise(F.col(text)).alias(text) if c == text else F.col(c) for c in docs.columns]
    return joined.withColumn(found, entities_of).select(
        *columns, F.coalesce(F.size(found), F.lit(0)).alias("n_entities"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.col(found)["kind"])), ","), F.lit("")).alias("kinds"),
    )
