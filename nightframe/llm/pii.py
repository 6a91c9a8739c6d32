"""Personal data: entities found in texts get keyed surrogates of the same type, format, script and gender.

Everything is built from DataFrame functions. A surrogate is drawn by HMAC from the key, the type, the canonical form and
the number of the attempt alone, so all mentions of one entity agree wherever they are. A table of the distinct entities
makes sure that two entities never get one surrogate and that no surrogate is an entity of the corpus; given names are
the exception: they turn within a list, so distinct ones stay distinct, but another document may hold the new name.
"""

from __future__ import annotations

import hashlib
import os
import warnings
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nightframe.llm.common import checkpointed, small, whole, written

# Given names by gender and script, titles.
GIVEN = {
    ("female", "latin"): "Maria Anna Elena Laura Julia Sofia Emma Olivia Charlotte Isabella Amelia Sarah Emily Hannah Katharina Sabine Ursula Monika Heike Ingrid Camille Juliette Margot Élodie Amélie Céline Lucía Carmen Pilar Dolores Jennifer Jessica Elizabeth Patricia Linda Barbara Susan Margaret Nancy Rachel",
    ("male", "latin"): "James Robert Michael David William Richard Joseph Thomas Daniel Matthew Anthony Andrew Kenneth Steven Edward Hans Klaus Jürgen Wolfgang Stefan Matthias Dieter Pierre Jacques François Étienne Olivier Laurent José Carlos Javier Miguel Alejandro Fernando Christopher Benjamin Samuel Alexander Nicholas Jonathan",
    ("female", "cyrillic"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Людмила",
    ("male", "cyrillic"): "Иван Алексей Дмитрий Сергей Андрей Михаил Николай Владимир Александр Павел",
}
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Monsieur Madame Mme Señor Señora Sr Sra Господин Госпожа".split()
SYLLABLES = {
    "latin": "ba ber cor dal den fel gar hol jor kel lan mar nor pel ral sen tor val wen zar lin mond ston ley ford ric".split(),
    "cyrillic": "ба вер гор дал ель зар кол лан мар нов пет рос сен тор фед хар чер шал юр ян".split(),
}
ENDINGS = {"latin": "er man sen ton ley ard ez in el is".split(), "cyrillic": "ов ин ский ев ко ук ич ян".split()}

WORD = r"\p{Lu}[\p{L}'’]*(?:-\p{Lu}\p{L}*)?"


def any_of(words: list[str]) -> str:
    """An alternation by first letters, so that a mismatch is found after one of a few branches."""
    tree: dict[str, list[str]] = {}
    for w in sorted(set(words), key=lambda w: (-len(w), w)):
        tree.setdefault(w[:2], []).append(w[2:])
    heads: dict[str, list[str]] = {}
    for two, rests in sorted(tree.items()):
        heads.setdefault(two[0], []).append(f"{two[1:]}(?:{'|'.join(rests)})")
    return "(?:" + "|".join(f"{h}(?:{'|'.join(parts)})" for h, parts in heads.items()) + ")"


_all_names = [n for line in GIVEN.values() for n in line.split()]
_names = any_of(_all_names + [n.upper() for n in _all_names])
_given = rf"{_names}(?![\p{{L}}'’-])(?: {WORD})?"
_titles = any_of(TITLES)
# Phrases that a name follows.
_phrases = "(?:[Nn]ame is|[Nn]ame:|[Ii]ch heiße|Name ist|m'appelle|m’appelle|[Mm]e llamo|nombre es|Nombre:|Nom:|зовут) "
#: Persons: after a title or such a phrase any name, else those that begin with a listed given name.
PERSON = rf"(?=\p{{Lu}})(?<![\p{{L}}\d])(?:{_titles}\.? (?:{_given}|{WORD}(?: {WORD})?)|{_given}|(?<={_phrases}){WORD}(?: {WORD})?)"
_hex = "[0-9A-Fa-f]{1,4}"
#: Alternatives with digits or an @, and persons; they are tried in this order. What repeats a group is bounded, as matching
#: recurses there: a mailbox has at most 64 characters, a domain 127 labels.
PATTERN = "|".join([
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,24}(?![A-Za-z0-9])",
    r"(?<![\p{L}\d])\+1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)",
    r"(?<![\p{L}\d])\+(?=(?:[ ./()-]{0,2}\d){8})\d{1,3}[ ./-]?(?:\(\d{1,4}\)[ ./-]?)?\d{1,4}(?:[ ./-]?\d{2,4}){1,5}(?!\d)",
    r"\(\d{3}\) ?\d{3}[.-]\d{4}(?!\d)|(?<![\d.-])(?:1[ .-])?(?:\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|\d{3} \d{3} \d{4})(?![\d-]|\.\d)",
    r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)",
    rf"(?<![\w:])(?=[0-9A-Fa-f:]*\d)(?:(?:{_hex}:){{7}}{_hex}|(?:{_hex}:){{1,6}}:(?:{_hex}(?::{_hex}){{0,5}})?|::{_hex}(?::{_hex}){{1,6}})(?![\w:])",
    r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    r"(?<![A-Za-z0-9])(?:(?=[a-f]*\d)[0-9a-f]{32,}+|(?=[A-F]*\d)[0-9A-F]{32,}+|(?:AKIA|ASIA)[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36,}+|sk-[A-Za-z0-9_-]{20,}+)(?![A-Za-z0-9])",
    r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}| [A-Z0-9]{4}(?: (?=[A-Z]{0,3}\d)[A-Z0-9]{4}){1,7}(?: (?=[A-Z]{0,3}\d)[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    r"(?<![\d.-])(?:(?:\d{4}[ -]){3}\d{4}|\d{4}[ -]\d{6}[ -]\d{5})(?!\d)|(?<!\d)\d{13,19}(?!\d)",
    r"(?<![\d.,])(?:0\d(?:[ .]\d{2}){4}|0\d{2,4}[ /-]\d{5,8}|[6-9]\d{2} \d{2} \d{2} \d{2})(?![\d-]|[.,]\d)",
    PERSON,
])
TITLED = rf"^{_titles}\.?$"


def mentions(text: Column) -> Column:
    """All mentions in order of place. Texts without a digit and an @ can only name persons, which is quicker to see."""
    found = lambda pattern: F.regexp_extract_all(text, F.lit(f"({pattern})"), 1)
    return F.when(text.rlike("[0-9@]"), found(PATTERN)).otherwise(found(PERSON))


def between(text: Column) -> Column:
    """What stands around the mentions: one more part than there are mentions."""
    return F.when(text.rlike("[0-9@]"), F.split(text, PATTERN, -1)).otherwise(F.split(text, PERSON, -1))


def kind_of(e: Column) -> Column:
    """The type of a mention. A run of digits is a card if it has sixteen or its check digit is right, else ``none``."""
    return (
        F.when(e.contains("@"), "email")
        .when(e.rlike(r"^\d{1,3}(\.\d{1,3}){3}$|:"), "ip")
        .when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(e.rlike(r"^[+(]|^(1[ .-])?\d{3}[ .-]\d{3}[ .-]\d{4}$|^0\d{1,4}[ ./-]|^\d{3} \d{2} \d{2} \d{2}$"), "phone")
        .when(e.rlike(r"^([0-9a-f]{32,}|[0-9A-F]{32,}|A[KS]IA[0-9A-Z]{16}|gh[opsu]_.*|sk-.*)$"), "secret")
        .when(e.rlike(r"^\d{13,15}$|^\d{17,19}$"), F.when(luhn(e) == 0, "card").otherwise("none"))
        .when(e.rlike(r"^[0-9 -]+$"), "card")
        .when(e.rlike(r"^[A-Z]{2}\d{2}"), "iban")
        .otherwise("person")
    )


def canon_of(kind: Column, e: Column) -> Column:
    """The form in which mentions are compared."""
    digits = F.regexp_replace(e, "[^0-9]", "")
    national = F.when((F.length(digits) == 10) & ~e.rlike("^[+0]"), F.concat(F.lit("1"), digits)).otherwise(digits)
    cased = F.when(e.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lower(e)).otherwise(e)
    plain = F.when(kind == "iban", F.lower(F.replace(e, F.lit(" "), F.lit("")))).when(kind == "secret", cased).otherwise(F.lower(e))
    return F.when(kind == "phone", national).when(kind.isin("card", "ssn"), digits).otherwise(plain)


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def pii_key(spark: SparkSession) -> str:
    """The key of the surrogates: the session's ``spark.nightframe.pii.key``, else NIGHTFRAME_PII_KEY of the environment,
    else one for demonstrations, which protects nothing and is warned of."""
    key = spark.conf.get("spark.nightframe.pii.key", os.environ.get("NIGHTFRAME_PII_KEY", ""))
    if not key:
        warnings.warn("no key for surrogates: set spark.nightframe.pii.key or NIGHTFRAME_PII_KEY; a public one is used", stacklevel=2)
    return key or "demonstration"


#: Place of the drawn numbers that stand for the first character; those before it have other uses.
FIRST = 50

#: Attempts from which on a surrogate has 40 characters more than the mention, which no corpus can fill.
LAST_ATTEMPT = 12


#: Canonical forms longer than this are drawn for by their digest.
LONG = 256


def four_at(stream: Column, i: Column) -> Column:
    """The ``i``-th four of the hex digits in a stream, an array of texts of 64."""
    return F.substr(F.get(stream, F.floor(i / 16).cast("int")), (4 * (i % 16) + 1).cast("int"), F.lit(4))


def hex_at(stream: Column, i: Column) -> Column:
    """The ``i``-th number, below 65536, of a stream."""
    return F.conv(four_at(stream, i), 16, 10).cast("int")


def like(text: Column, stream: Column) -> Column:
    """Letters for letters and digits for digits, character by character."""

    def char(c: Column, i: Column) -> Column:
        n = hex_at(stream, i + FIRST)
        drawn = lambda first, size: F.chr(F.lit(ord(first)) + n % size)
        return F.when(c.between("0", "9"), drawn("0", 10)).when(c.between("a", "z"), drawn("a", 26)).when(c.between("A", "Z"), drawn("A", 26)).otherwise(c)

    return F.when(F.length(text) > 0, F.array_join(F.transform(F.split(text, ""), char), "")).otherwise("")


class Surrogates:
    """Column expressions for the surrogates of one key."""

    def __init__(self, key: str):
        own = hashlib.sha256(key.encode()).digest().ljust(64, b"\0")
        self.inner, self.outer = bytes(b ^ 0x36 for b in own), bytes(b ^ 0x5C for b in own)
        given: dict[str, str] = {}
        for line in GIVEN.values():
            # each list is turned by one place in an order that depends on the key: distinct names stay distinct
            names = sorted(line.split(), key=lambda n: hashlib.sha256(f"{key}|{n}".encode()).hexdigest())
            given |= {a.lower(): b for a, b in zip(names, [*names[1:], names[0]], strict=True)}
        self.given = F.create_map(*[F.lit(x) for pair in sorted(given.items()) for x in pair])

    def drawn(self, kind: Column, canon: Column, attempt: Column, characters: Column, body) -> Column:
        """``body(stream)`` for the hex digits that are drawn for an entity: HMAC-SHA256 over counted blocks, four digits for
        each of so many characters and a few dozen more. A long form is hashed once, whatever the number of blocks."""

        def blocks(name: Column) -> Column:
            def block(i: Column) -> Column:
                line = F.concat_ws("|", kind, attempt.cast("string"), i.cast("string"), name).cast("binary")
                return F.sha2(F.concat(F.lit(self.outer), F.unhex(F.sha2(F.concat(F.lit(self.inner), line), 256))), 256)

            return F.transform(F.sequence(F.lit(0), F.floor((characters + (FIRST + 20)) / 16).cast("int")), block)

        name = F.when(F.length(canon) > LONG, F.concat(F.lit("long|"), F.sha2(canon.cast("binary"), 256))).otherwise(canon)
        return let(let(name, blocks), body)

    def canonical(self, kind: Column, canon: Column, attempt: Column) -> Column:
        """The surrogate of a canonical form. Mail and network addresses come from names and ranges kept for examples and
        private use, telephone numbers keep their country, card and account numbers their check digits.

        The space grows with the attempt, as one that keeps the format may be too small for a corpus: mail gets a longer
        mailbox, numbers get digits after an ``x`` (as an extension is written) or, for IPv4, after a colon.
        """

        def made(stream: Column) -> Column:
            number = lambda i, n: hex_at(stream, F.lit(i)) % n
            # hex digits are taken from the stream as they are
            shaped = F.when((kind == "secret") & canon.rlike("^[0-9a-f]+$"), "").otherwise(like(canon, stream))
            return let(shaped, lambda shape: self._by_kind(kind, canon, attempt, stream, number, shape))

        return self.drawn(kind, canon, attempt, F.length(canon), made)

    def _by_kind(self, kind: Column, canon: Column, attempt: Column, stream: Column, number, shape: Column) -> Column:
        text = lambda i, n, plus=0: (number(i, n) + plus).cast("string")

        def more(free: int, mark: str = "") -> Column:
            """Digits that widen the format after ``free`` attempts that keep it: one more each time, in the end 40."""
            count = F.when(attempt >= LAST_ATTEMPT, 40).otherwise(attempt - (free - 1))
            wide = F.array_join(F.transform(F.sequence(F.lit(10), 9 + count), lambda i: (hex_at(stream, i) % 10).cast("string")), "")
            return F.when(attempt >= free, F.concat(F.lit(mark), wide)).otherwise("")

        inner = F.when(canon.rlike(r"@.*\..*\."), F.concat(F.substring_index(F.substring_index(shape, "@", -1), ".", 1), F.lit("."))).otherwise("")
        ending = F.element_at(F.array(*[F.lit(x) for x in ("com", "org", "net")]), (number(0, 3) + 1).cast("int"))
        email = F.concat(F.substring_index(shape, "@", 1), more(1), F.lit("@"), inner, F.lit("example."), ending)
        groups = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: four_at(stream, i))
        four = F.concat(F.concat_ws(".", F.lit("10"), text(0, 256), text(1, 256), text(2, 254, 1)), more(3, ":"))
        ip = F.when(canon.contains(":"), F.concat(F.lit("2001:db8:"), F.array_join(groups, ":"))).otherwise(four)
        exchange = F.when(attempt < 2, "555").otherwise(F.concat(text(1, 8, 2), F.substring(shape, 6, 2)))
        american = F.concat(F.lit("1"), text(0, 8, 2), F.substring(shape, 3, 2), exchange, F.substring(shape, 8, 4))
        phone = F.when(canon.rlike(r"^1\d{10}$"), american).otherwise(F.concat(F.substring(canon, 1, 2), F.substr(shape, F.lit(3))))
        card = let(
            F.concat(F.substring(canon, 1, 1), F.substr(shape, F.lit(2), F.length(shape) - 2)),
            lambda b: F.concat(b, F.when(luhn(canon) == 0, F.pmod(-luhn(F.concat(b, F.lit("0"))), F.lit(10)).cast("string")).otherwise(F.right(shape, F.lit(1)))),
        )
        ssn = F.concat(F.lit("9"), F.substr(shape, F.lit(2)))
        secret = F.when(canon.rlike("^[0-9a-f]+$"), F.substr(F.array_join(stream, ""), F.lit(4 * FIRST + 1), F.length(canon))).otherwise(F.concat(F.substring(canon, 1, 4), F.substr(shape, F.lit(5))))
        country, rest = F.substring(canon, 1, 2), F.concat(F.substr(shape, F.lit(5)), more(3))
        check = lambda r: F.lpad((98 - mod97(F.concat(r, country, F.lit("00")))).cast("string"), 2, "0")
        iban = let(rest, lambda r: F.concat(country, check(r), r))
        numbers = F.when(kind == "phone", F.concat(phone, more(4, "x"))).otherwise(F.concat(F.when(kind == "card", card).otherwise(ssn), more(3, "x")))
        out = F.when(kind == "email", email).when(kind == "ip", ip).when(kind.isin("phone", "card", "ssn"), numbers)
        return out.when(kind == "secret", F.concat(secret, more(3))).when(kind == "iban", iban).otherwise(self._syllables(canon, attempt, stream))

    def surname(self, canon: Column, attempt: Column) -> Column:
        return self.drawn(F.lit("surname"), canon, attempt, F.lit(0), lambda stream: self._syllables(canon, attempt, stream))

    def _syllables(self, canon: Column, attempt: Column, stream: Column) -> Column:
        """A family name: two or three syllables (more after collisions) and an ending, in the script of the name."""
        words = lambda table: F.when(canon.rlike(r"\p{IsCyrillic}"), F.lit(" ".join(table["cyrillic"]))).otherwise(F.lit(" ".join(table["latin"])))
        pick = lambda of, i: F.element_at(of, (hex_at(stream, i) % F.size(of) + 1).cast("int"))
        some = F.sequence(F.lit(10), (hex_at(stream, F.lit(0)) % 2 + 11 + attempt).cast("int"))
        body = let(F.split(words(SYLLABLES), " "), lambda of: F.array_join(F.transform(some, lambda i: pick(of, i)), ""))
        return F.concat(body, let(F.split(words(ENDINGS), " "), lambda of: pick(of, F.lit(1))))

    def cased(self, e: Column, made: Column) -> Column:
        return F.when((F.upper(e) == e) & (F.lower(e) != e) & (F.length(e) > 1), F.upper(made)).otherwise(made)

    def dressed(self, kind: Column, e: Column, made: Column) -> Column:
        """The surrogate in the format of the mention: its separators, its case."""

        def spread(taken: Column, places: str, skip: Column) -> Column:
            """The characters of ``taken`` at the places of the mention that match, and what is left over at the end."""

            def char(i: Column) -> Column:
                c = F.substr(e, i, F.lit(1))
                seen = F.length(F.regexp_replace(F.substr(e, F.lit(1), i), f"[^{places}]", ""))
                return F.when(c.rlike(f"[{places}]"), F.substr(taken, seen + skip, F.lit(1))).otherwise(c)

            used = F.length(F.regexp_replace(e, f"[^{places}]", "")) + skip
            return F.concat(F.array_join(F.transform(F.sequence(F.lit(1), F.length(e)), char), ""), F.substr(taken, used + 1))

        base, more = F.substring_index(made, "x", 1), F.when(made.contains("x"), F.concat(F.lit(" x"), F.substring_index(made, "x", -1))).otherwise("")
        # a national number lacks the country that its surrogate has
        numeral = F.concat(spread(base, "0-9", F.greatest(F.lit(0), F.length(base) - F.length(F.regexp_replace(e, "[^0-9]", "")))), more)
        return F.when(kind.isin("phone", "card", "ssn"), numeral).when(kind == "iban", spread(F.upper(made), "A-Za-z0-9", F.lit(0))).otherwise(self.cased(e, made))

    def person(self, e: Column, attempt_of) -> Column:
        """Titles stay; given names and family names are replaced one by one, so that any part still fits the whole."""

        def part(token: Column) -> Column:
            given = F.try_element_at(self.given, F.lower(token))
            cased = F.when((F.upper(token) == token) & (F.length(token) > 1), F.upper(given)).otherwise(given)
            return F.when(token.rlike(TITLED), token).when(given.isNotNull(), cased).otherwise(self.family(token, attempt_of))

        return F.array_join(F.transform(F.split(e, " "), part), " ")

    def family(self, token: Column, attempt_of) -> Column:
        """The surrogate of a family name in the case of the mention."""
        made = let(attempt_of(F.lit("surname"), F.lower(token)), lambda attempt: self.surname(F.lower(token), attempt))
        return let(made, lambda m: self.cased(token, F.initcap(m)))

    def plain(self, kind: Column, e: Column, attempt_of) -> Column:
        """The dressed surrogate of one mention."""

        def known(canon: Column) -> Column:
            made = let(attempt_of(kind, canon), lambda attempt: self.canonical(kind, canon, attempt))
            return let(made, lambda m: self.dressed(kind, e, m))

        return let(canon_of(kind, e), known)

    def replace(self, e: Column, attempt_of) -> Column:
        return let(kind_of(e), lambda kind: F.when(kind == "none", e).when(kind == "person", self.person(e, attempt_of)).otherwise(self.plain(kind, e, attempt_of)))


def family_names(found: Column, given: Column) -> Column:
    """The family names among the mentions of persons, each once."""
    persons = F.filter(found, lambda e: kind_of(e) == "person")
    tokens = F.array_distinct(F.flatten(F.transform(persons, lambda e: F.split(e, " "))))
    return F.filter(tokens, lambda t: ~(t.rlike(TITLED) | F.try_element_at(given, F.lower(t)).isNotNull()))


def luhn(digits: Column) -> Column:
    """The checksum of card numbers, 0 where the number is right."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substr(digits, F.length(digits) - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return acc + F.when(i % 2 == 1, twice).otherwise(d)

    total = F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add)
    return F.when(F.length(digits) > 1, F.pmod(total, F.lit(10)))


def mod97(text: Column) -> Column:
    """A string of digits and letters (a is 10, z is 35), read as a number, modulo 97."""

    def add(acc: Column, c: Column) -> Column:
        value = F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(F.lower(c)) - 87)
        return F.pmod(acc * F.when(value > 9, 100).otherwise(10) + value, F.lit(97))

    return F.aggregate(F.split(text, ""), F.lit(0), lambda acc, c: F.when(F.length(c) == 1, add(acc, c)).otherwise(acc))


def entities(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, kind, canon`` for each distinct entity of a document whose surrogate may collide: all but given names."""
    surrogates = Surrogates("")
    found = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array_distinct(mentions(whole(text_col)))).alias("e"))
    found = found.withColumn("kind", kind_of(F.col("e"))).filter("kind <> 'none'")
    parts = F.when(F.col("kind") == "person", F.split("e", " ")).otherwise(F.array("e"))
    found = found.select("doc_id", F.explode(parts).alias("e"), F.when(F.col("kind") == "person", "surname").otherwise(F.col("kind")).alias("kind"))
    named = (F.col("kind") == "surname") & (F.col("e").rlike(TITLED) | F.try_element_at(surrogates.given, F.lower("e")).isNotNull())
    return found.filter(~named).select("doc_id", "kind", canon_of(F.col("kind"), F.col("e")).alias("canon")).distinct()


def settle(distinct: DataFrame, surrogates: Surrogates) -> DataFrame:
    """``kind, canon, attempt``: the first attempt of each entity whose surrogate no other entity has and none is.

    A surrogate belongs to the entity that got it in an earlier round, else to the first by name; those who lose draw
    again. From the second to fifth attempt on every further one is drawn from ten times as many surrogates, and from
    attempt ``LAST_ATTEMPT`` on from 10 ** 40, where no two meet: so there are at most as many rounds, whatever the
    entities. All of them go through the first round, later ones handle those who lost.
    """
    drawn = surrogates.canonical(F.col("kind"), F.col("canon"), F.col("attempt"))
    taken = distinct.select("kind", F.col("canon").alias("made"))
    open_, done = distinct.withColumn("attempt", F.lit(0)), []
    for _ in range(LAST_ATTEMPT + 2):
        made = checkpointed(open_.withColumn("made", drawn))
        hit = taken.join(small(made.select("kind", "made").distinct()), ["kind", "made"], "left_semi").distinct()
        owner = made.groupBy("kind", "made").agg(F.min("canon").alias("owner"))
        judged = made.join(owner, ["kind", "made"]).join(hit.withColumn("hit", F.lit(True)), ["kind", "made"], "left")
        judged = checkpointed(judged.select("kind", "canon", "attempt", "made", (F.col("hit").isNull() & (F.col("owner") == F.col("canon"))).alias("won")))
        done.append(judged.filter("won").select("kind", "canon", "attempt"))
        taken = taken.unionByName(judged.filter("won").select("kind", "made"))
        open_ = judged.filter("not won").select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))
        if not open_.limit(1).count():
            return reduce(DataFrame.unionByName, done)
    raise RuntimeError("surrogates of 40 random digits collided")


def replace_pii(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, same columns, with surrogates in the texts, and one more column ``n_entities``.

    Two passes over the texts, neither of which shuffles them: the first lists the distinct entities, by document,
    without their places; the second replaces. Surrogates are computed in place; only the few entities that had to
    draw again are looked up, by document. A null text stays null, an empty one empty; rows that repeat an id or a
    text get the same surrogates; null ids are handled like any other. Columns of ``docs`` may have any name that doesn't
    begin with ``__nf_``. The time for a text is in proportion to its length, whatever runs it holds.
    """
    surrogates = Surrogates(key)
    found = written(entities(docs, id_col, text_col))
    settled = settle(found.select("kind", "canon").distinct(), surrogates)
    again = settled.filter("attempt > 0")
    name = F.concat_ws("|", "kind", "canon")
    fixes = found.join(small(again), ["kind", "canon"]).groupBy("doc_id").agg(F.collect_set(F.struct(name.alias("name"), "attempt")).alias("__nf_fix"))
    fixes = checkpointed(fixes)
    if fixes.limit(1).count():
        right = small(fixes.withColumnRenamed("doc_id", "__nf_of"))
        fixed = docs.join(right, docs[id_col].eqNullSafe(F.col("__nf_of")), "left").drop("__nf_of")
    else:
        fixed = docs.withColumn("__nf_fix", F.lit(None).cast("array<struct<name:string,attempt:int>>"))

    def attempt_of(kind: Column, canon: Column) -> Column:
        mine = F.filter("__nf_fix", lambda x: x["name"] == F.concat_ws("|", kind, canon))
        return F.when(F.col("__nf_fix").isNull(), 0).otherwise(F.coalesce(F.get(mine, 0)["attempt"], F.lit(0)))

    marked = fixed.withColumn("__nf_found", mentions(F.col(text_col)))
    gaps = between(F.col(text_col))
    new = F.transform("__nf_found", lambda e: surrogates.replace(e, attempt_of))

    def alone(gap: Column, names: Column) -> Column:
        """Family names that stand elsewhere in the text without title or given name; all are looked for at once."""
        pattern = F.concat(F.lit(r"(?<![\p{L}\d])("), F.array_join(names, "|"), F.lit(r")(?![\p{L}\d])"))
        new = F.transform(F.regexp_extract_all(gap, pattern, F.lit(1)), lambda t: surrogates.family(t, attempt_of))
        return F.array_join(F.zip_with(F.split(gap, pattern, -1), new, lambda g, t: F.concat(g, F.coalesce(t, F.lit("")))), "")

    names = family_names(F.col("__nf_found"), surrogates.given)
    gaps = let(names, lambda n: F.when(F.size(n) > 0, F.transform(gaps, lambda g: alone(g, n))).otherwise(gaps))
    joined = F.array_join(F.zip_with(gaps, new, lambda g, e: F.concat(g, F.coalesce(e, F.lit("")))), "")
    text = F.when(F.size("__nf_found") > 0, joined).otherwise(F.col(text_col))
    count = F.coalesce(F.size(F.filter("__nf_found", lambda e: kind_of(e) != "none")), F.lit(0)).cast("long")
    columns = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns]
    return marked.select(*columns, count.alias("n_entities"))
