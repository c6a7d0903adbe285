"""Personal data replaced by surrogates.  DataFrame functions only."""

from __future__ import annotations

import functools
import secrets
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colprism.llm.shared import column, stored

KEY_SETTING = "spark.colprism.surrogates.key"


@functools.cache
def _drawn_key() -> str:
    return secrets.token_hex(32)


def session_key(spark: SparkSession) -> str:
    """The key that the session's ``KEY_SETTING`` holds; where unset, one drawn at random for this process.

    Set it where surrogates must agree from one application to the next.  It is part of
    the query plan, so whoever may read plans and event logs may read it.
    """
    return spark.conf.get(KEY_SETTING, None) or _drawn_key()


# Titles that announce a name, by the gender they tell.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mademoiselle", "Señora", "Señorita", "Sra", "Госпожа"],
    "m": ["Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Господин"],
    "x": ["Dr", "Prof"],
}
#: Given names that surrogates take, by script and gender; family names by script.
GIVEN = {
    "latin": {
        "f": "Ada Alma Cora Dina Edda Elsa Greta Hanna Ilse Iris Jana Klara Lena Livia Mara Nora Olga Paula Rosa Vera".split(),
        "m": "Adam Arno Axel Boris Carl Egon Emil Erik Felix Gero Hugo Ivo Jonas Karl Leon Max Nils Otto Paul Ralf".split(),
        "x": "Alex Andrea Chris Dominique Eli Jamie Jona Kai Kim Lou Luca Maxime Mika Noa Robin Sam Sascha Sidney Toni Yael".split(),
    },
    "cyrillic": {
        "f": "Алла Анна Вера Дарья Ева Инна Ирина Лидия Майя Нина Ольга Рита".split(),
        "m": "Антон Борис Глеб Денис Егор Иван Лев Марк Олег Павел Роман Юрий".split(),
        "x": "Валя Женя Саша Слава Шура".split(),
    },
    "greek": {
        "f": "Άννα Ελένη Ειρήνη Μαρία Νίκη Σοφία".split(),
        "m": "Ανδρέας Γιώργος Κώστας Νίκος Πέτρος Φώτης".split(),
        "x": "Άγγελος Αλέξης Θάλεια Χάρις".split(),
    },
}
FAMILY = {
    "latin": (
        "Abel Adler Amsel Bach Baum Berger Blum Brandt Dorn Eder Falk Feld Forst Frey Garten Gruber Hafner Hagen Hirsch "
        "Holm Horn Kern Kessel Kramer Lang Lenz Linde Lorenz Marten Moser Nagel Noll Ortner Pohl Quast Rabe Reuter Roth "
        "Sommer Stein Talbot Ulmer Vogt Wald Weber Winter Zander Ziegler"
    ).split(),
    "cyrillic": "Белых Гончар Дубко Заречных Ковалюк Лесных Мельник Орлюк Полевых Седых Ткач Черных".split(),
    "greek": "Αγγελάκης Βλάχος Δήμας Καράς Λάππας Μακρής Νικολάου Ξένος Ρήγας Σταύρου".split(),
}
# A part after an apostrophe or hyphen belongs to the word, but for the possessive s; initials stand before a word.
_NAME_WORD = r"(?:(?:\p{Lu}\.\x20?){0,3}\p{Lu}(?:\p{L}*+(?:['’-](?!s(?!\p{L}))\p{L}++)++|\p{L}++))"
_ALL_TITLES = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))

#: Alternatives in order of precedence.  Each starts only where no longer run of its
#: characters goes on to the left, and runs are possessive: time is linear in the text.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9](?:[A-Za-z0-9-]|\.(?=[A-Za-z0-9]))*+",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\w]|\.\d)",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2}(?: ?[A-Z0-9]{3}|(?: ?[A-Z0-9]{4}){1,5}(?: ?[A-Z0-9]{1,3})?)(?!\w)",
    "card": r"(?<![\w.+-])\d{4}([ -]?)\d{4}\1\d{4}\1\d{4}(?![\w]|[.-]\d)"
    r"|(?<![\w.+-])3[47]\d{2}[ -]\d{6}[ -]\d{5}(?![\w]|[.-]\d)|(?<![\w.+-])[3-6]\d{12,18}(?![\w]|[.-]\d)",
    "ssn": r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w]|-\d)",
    "phone": r"(?<![\w.])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\w)|(?<![\w.])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\w)"
    r"|(?<![\w.])\(\d{3}\)\d{3}[ .-]?\d{4}(?!\w)|(?<![\w.+-])[2-9]\d{2}[2-9]\d{6}(?![\w]|[.-]\d)"
    r"|(?<![\w.+-])0\d{2,4}[ /-]\d{5,8}(?![\w]|[.-]\d)",
    "name": rf"(?<!\w)(?:{_ALL_TITLES})\.?\x20{{1,3}}{_NAME_WORD}(?:\x20{_NAME_WORD}){{0,3}}",
}
#: What every match holds; texts without it are not searched further.
_SIGN = rf"[@]|\d{{2}}|\d\.\d|(?:{_ALL_TITLES})\.?\x20"
#: Rounds after which a surrogate gets one letter or digit more per round.
_SAME_LENGTH_ROUNDS = 4


@dataclass(frozen=True)
class Kinds:
    patterns: dict[str, str]

    @property
    def any(self) -> str:
        """All kinds as alternatives, one group around each."""
        parts, seen = [], 0
        for pattern in self.patterns.values():
            own = seen + 1
            # A back reference in the pattern moves by the groups before it.
            parts.append("(" + pattern.replace(r"\1", rf"\{own + 1}") + ")")
            seen = own + pattern.count("([")
        return "|".join(parts)

    def kind(self, found: Column) -> Column:
        """The kind of a match, by the first pattern that it fulfils alone."""
        out = F.lit(None).cast("string")
        for name, pattern in reversed(self.patterns.items()):
            out = F.when(found.rlike(rf"^(?:{pattern})$"), F.lit(name)).otherwise(out)
        return out


KINDS = Kinds(PATTERNS)


def untitled(found: Column) -> Column:
    """A name without its title."""
    return F.regexp_replace(found, rf"^(?:{_ALL_TITLES})\.?\x20{{1,3}}", "")


def canonical(kind: Column, found: Column) -> Column:
    """What the spellings of one entity share: digits of numbers, lower case of addresses and of names without their title.

    A phone number with another country code than 1 keeps its plus sign.
    """
    digits = F.regexp_replace(found, r"\D", "")
    return (
        F.when(kind == "email", F.lower(found))
        .when(
            kind == "phone",
            F.when(found.startswith("+1"), F.substr(digits, F.lit(2)))
            .when(found.startswith("+"), F.concat(F.lit("+"), digits))
            .otherwise(digits),
        )
        .when(kind == "ip", found)
        .when(kind.isin("card", "ssn"), digits)
        .when(kind == "iban", F.replace(found, F.lit(" "), F.lit("")))
        .otherwise(F.lower(untitled(found)))
    )


def _gender(found: Column) -> Column:
    out = F.lit("x")
    for gender in ("m", "f"):
        out = F.when(found.rlike(rf"^(?:{'|'.join(TITLES[gender])})\.?\x20"), F.lit(gender)).otherwise(out)
    return out


def _number(key: str, *parts: Column) -> Column:
    """A keyed 56-bit number."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 256), 1, 14), 16, 10).cast("bigint")


def _redrawn(key: str, canon: Column, turn: int, kept: Column | None = None, high: tuple[int, ...] = ()) -> Column:
    """Digits for digits and letters for letters, in place; the first ``kept`` characters stay.

    The draw for a place hangs on the key, the whole entity and the place.  A digit other
    than zero stays so, and at the places ``high`` one from 2 on stays from 2 on.
    """
    letters = "abcdefghijklmnopqrstuvwxyz"

    def drawn(c: Column, i: Column) -> Column:
        n = _number(key, F.lit(str(turn)), canon, i.cast("string"))
        digit = F.when(c == "0", F.pmod(n, F.lit(10))).otherwise(F.pmod(n, F.lit(9)) + 1)
        if high:
            digit = F.when(i.isin(*high) & (c >= "2"), F.pmod(n, F.lit(8)) + 2).otherwise(digit)
        at = (F.pmod(n, F.lit(26)) + 1).cast("int")
        new = (
            F.when(c.rlike("^[0-9]$"), digit.cast("string"))
            .when(c.rlike("^[a-z]$"), F.substring(F.lit(letters), at, F.lit(1)))
            .when(c.rlike("^[A-Z]$"), F.substring(F.lit(letters.upper()), at, F.lit(1)))
            .otherwise(c)
        )
        return new if kept is None else F.when(i < kept, c).otherwise(new)

    return F.array_join(F.transform(F.split(canon, ""), drawn), "")


def _digit_tail(key: str, canon: Column, turn: int, n: int) -> Column:
    draws = [F.pmod(_number(key, F.lit(f"{turn}+{i}"), canon), F.lit(10)).cast("string") for i in range(n)]
    return F.concat(*draws) if draws else F.lit("")


def _luhn_digit(body: Column) -> Column:
    """The digit that makes ``body`` with it a card number: every second digit from the right counts double."""
    reverse = F.split(F.reverse(body), "")
    twice = lambda d, i: F.when(i % 2 == 1, d).otherwise(2 * d - F.when(d > 4, 9).otherwise(0))
    values = F.transform(reverse, lambda c, i: twice(c.cast("int"), i))
    return F.pmod(-F.aggregate(values, F.lit(0), lambda a, v: a + v), F.lit(10)).cast("string")


def _mod_97(iban: Column) -> Column:
    """The remainder that is 1 for a right IBAN: first four characters last, letters as 10 to 35."""
    turned = F.concat(F.substr(iban, F.lit(5)), F.substring(iban, 1, 4))
    digit = lambda c: F.conv(c, 36, 10).cast("int")
    step = lambda a, c: F.pmod(a * F.when(c >= "A", 100).otherwise(10) + digit(c), F.lit(97))
    return F.aggregate(F.split(turned, ""), F.lit(0), step)


def _card(key: str, canon: Column, turn: int, tail: Column) -> Column:
    """First two digits as they were, with a right check digit if it had one."""
    new = F.concat(_redrawn(key, canon, turn, F.lit(2)), tail)
    body = F.substring(new, F.lit(1), F.length(new) - 1)
    return F.when(F.call_function("luhn_check", canon), F.concat(body, _luhn_digit(body))).otherwise(new)


def _iban(key: str, canon: Column, turn: int, tail: Column) -> Column:
    """The same country, with right check digits if it had such."""
    country = F.substring(canon, 1, 2)
    new = F.concat(_redrawn(key, canon, turn, F.lit(2)), tail)
    account = F.substr(new, F.lit(5))
    check = F.lpad((98 - _mod_97(F.concat(country, F.lit("00"), account))).cast("string"), 2, "0")
    return F.when(_mod_97(canon) == 1, F.concat(country, check, account)).otherwise(new)


def _ssn(key: str, canon: Column, turn: int, tail: Column) -> Column:
    """Areas that are given out (not 666, none from 900 on) stay among these; other areas are redrawn as they are."""
    new = F.concat(_redrawn(key, canon, turn), tail)
    area = F.substring(new, 1, 3)
    given = F.when(area == "666", "667").when(area >= "900", F.concat(F.lit("8"), F.substring(area, 2, 2))).otherwise(area)
    right = (F.substring(canon, 1, 3) < "900") & (F.substring(canon, 1, 3) != "666")
    return F.when(right, F.concat(given, F.substr(new, F.lit(4)))).otherwise(new)


# Country codes of one and of two digits; all others have three.
_COUNTRY = r"^\+(?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"


def _phone(key: str, canon: Column, turn: int, tail: Column) -> Column:
    """Country code, or the zero before an area, stays; area and office codes from 200 on stay so."""
    abroad = _redrawn(key, canon, turn, F.length(F.regexp_extract(canon, _COUNTRY, 0)))
    home = _redrawn(key, canon, turn, F.when(canon.startswith("0"), 1).otherwise(0), (0, 3))
    return F.concat(F.when(canon.startswith("+"), abroad).otherwise(home), tail)


def _ip(key: str, canon: Column, turn: int) -> Column:
    """Private, loopback and link-local addresses stay in their range; all others go to 240.0.0.0/4, which no host has.

    Where the range is taken, later rounds draw from 10.0.0.0/8, then from 240.0.0.0/4,
    then from all addresses.
    """
    n = _number(key, F.lit(f"ip{turn}"), canon)
    part = lambda by, m, low=0: (F.pmod(F.shiftright(n, by), F.lit(m)) + low).cast("string")
    last = [part(9, 256), part(18, 256), part(27, 254, 1)]
    unused = F.concat_ws(".", part(0, 16, 240), *last)
    if turn >= 4 * _SAME_LENGTH_ROUNDS:
        return F.concat_ws(".", part(0, 223, 1), *last)
    if turn >= 2 * _SAME_LENGTH_ROUNDS:
        return unused
    ten = F.concat_ws(".", F.lit("10"), *last)
    out = F.when(canon.startswith("10."), ten)
    ranges = {r"^192\.168\.": [F.lit("192.168"), *last[1:]], r"^172\.(?:1[6-9]|2\d|3[01])\.": [F.lit("172"), part(0, 16, 16), *last[1:]]}
    ranges |= {r"^169\.254\.": [F.lit("169.254"), *last[1:]], r"^127\.": [F.lit("127"), *last]}
    for start, parts in ranges.items():
        out = out.when(canon.rlike(start), ten if turn >= _SAME_LENGTH_ROUNDS else F.concat_ws(".", *parts))
    return out.otherwise(unused)


def _words(name: Column) -> Column:
    """The words of a name and its initials, each with the space after it."""
    return F.regexp_extract_all(name, F.lit(r"\p{L}\.\x20?|[^\x20]+\x20?"), F.lit(0))


def _name(key: str, canon: Column, gender: Column, turn: int, tail: Column) -> Column:
    """As many words and initials as the name has, the last a family name, the others given names of its gender and script."""
    script = F.lit("latin")
    for s in ("cyrillic", "greek"):
        script = F.when(canon.rlike(rf"\p{{Is{s.capitalize()}}}"), F.lit(s)).otherwise(script)

    def pick(names: list[str], salt: str, i: Column) -> Column:
        n = _number(key, F.lit(f"{salt}{turn}"), canon, i.cast("string"))
        return F.element_at(F.array(*map(F.lit, names)), (F.pmod(n, F.lit(len(names))) + 1).cast("int"))

    def family(i: Column, salt: str) -> Column:
        out = F.lit(None).cast("string")
        for s in FAMILY:
            out = F.when(script == s, pick(FAMILY[s], salt, i)).otherwise(out)
        return out

    def word(w: Column, i: Column) -> Column:
        first = F.lit(None).cast("string")
        for s in GIVEN:
            for g in GIVEN[s]:
                first = F.when((script == s) & (gender == g), pick(GIVEN[s][g], "given", i)).otherwise(first)
        last = family(i, "family")
        # A second family name where the plain ones are taken.
        if turn:
            last = F.concat(last, F.lit("-"), family(i, "extra"))
        if turn >= _SAME_LENGTH_ROUNDS:
            last = F.concat(last, F.lower(F.translate(tail, "0123456789", "abdeiklnor")))
        initial = F.concat(F.substring(first, 1, 1), F.lit("."))
        new = F.when(i == F.size(_words(canon)) - 1, last).when(w.rlike(r"^\p{L}\."), initial).otherwise(first)
        return F.concat(new, F.regexp_extract(w, r"\x20$", 0))

    return F.array_join(F.transform(_words(canon), word), "")


def proposed(kind: Column, canon: Column, gender: Column, turn: int, key: str) -> Column:
    """The surrogate that an entity proposes in a round, in canonical form but for the case of names.

    E-mail: local part redrawn in its shape, domain of the reserved example names; the
    other kinds as said at their functions.  Later rounds draw anew, and from round
    ``_SAME_LENGTH_ROUNDS`` on append, so that every round has more room.
    """
    more = max(0, turn - _SAME_LENGTH_ROUNDS + 1)
    tail = _digit_tail(key, canon, turn, more)
    local = _redrawn(key, F.substring_index(canon, "@", 1), turn)
    domain = F.concat(
        F.lit("host"), F.pmod(_number(key, F.lit("domain"), canon, F.lit(str(turn))), F.lit(1000)).cast("string"), F.lit(".example.org")
    )
    return (
        F.when(kind == "email", F.concat(local, tail, F.lit("@"), domain))
        .when(kind == "ip", _ip(key, canon, turn))
        .when(kind == "iban", _iban(key, canon, turn, tail))
        .when(kind == "card", _card(key, canon, turn, tail))
        .when(kind == "ssn", _ssn(key, canon, turn, tail))
        .when(kind == "phone", _phone(key, canon, turn, tail))
        .otherwise(_name(key, canon, gender, turn, tail))
    )


def _in_layout(found: Column, canon: Column, surrogate: Column) -> Column:
    """Digits of the surrogate in the layout of the spelling; what is over comes last."""
    own = F.regexp_replace(found, r"\D", "")
    lead = F.greatest(F.length(own) - F.length(canon), F.lit(0))
    digits = F.concat(F.substring(own, F.lit(1), lead), surrogate)
    gaps = F.split(found, r"\d", -1)
    n = F.size(gaps) - 1
    inside = F.zip_with(
        F.slice(gaps, 1, n), F.split(F.substring(digits, F.lit(1), n), ""), lambda g, d: F.concat(g, d)
    )
    return F.concat(F.array_join(inside, ""), F.substr(digits, n + 1), F.element_at(gaps, -1))


def _in_case(name: Column, surrogate: Column) -> Column:
    """Words of the surrogate in capitals where those of the name are."""
    shout = lambda w: w.rlike(r"^\p{Lu}[^\x20]") & (w == F.upper(w)) & ~w.rlike(r"^\p{L}\.")
    words = F.zip_with(_words(name), _words(surrogate), lambda w, s: F.when(shout(w), F.upper(s)).otherwise(s))
    return F.array_join(words, "")


def spelled(kind: Column, found: Column, canon: Column, surrogate: Column) -> Column:
    """The surrogate as the text has it: title, capitals, spaces, brackets and country code stay."""
    title = F.regexp_extract(found, rf"^(?:{_ALL_TITLES})\.?\x20{{1,3}}", 0)
    unsigned = lambda c: F.replace(c, F.lit("+"), F.lit(""))
    return (
        F.when(kind == "name", F.concat(title, _in_case(untitled(found), surrogate)))
        .when(kind.isin("phone", "card", "ssn"), _in_layout(found, unsigned(canon), unsigned(surrogate)))
        .when((kind == "iban") & found.contains(" "), F.trim(F.regexp_replace(surrogate, "(.{4})", "$1 ")))
        .otherwise(surrogate)
    )


def finds(docs: DataFrame, text: str = "text") -> Column:
    """All matches in a text, in order; an empty list for a null text."""
    own = column(text)
    signed = F.coalesce(own.rlike(_SIGN), F.lit(False))
    return F.when(signed, F.regexp_extract_all(own, F.lit(KINDS.any), F.lit(0))).otherwise(F.array().cast("array<string>"))


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """found, kind, canon, gender: each different spelling in the corpus once."""
    return described(docs.select(F.explode(finds(docs, text)).alias("found")))


def described(found: DataFrame) -> DataFrame:
    """kind, canon, gender of each different ``found``."""
    spellings = found.select("found").distinct()
    spellings = spellings.withColumn("kind", KINDS.kind(F.col("found"))).where("kind IS NOT NULL")
    # Sixteen digits are a card as they are, other lengths by the check digit.
    digits = F.regexp_replace("found", r"\D", "")
    spellings = spellings.where((F.col("kind") != "card") | (F.length(digits) == 16) | F.call_function("luhn_check", digits))
    return spellings.withColumn("canon", canonical(F.col("kind"), F.col("found"))).withColumn(
        "gender", F.when(F.col("kind") == "name", _gender(F.col("found"))).otherwise(F.lit("x"))
    )


def surrogates(found: DataFrame, key: str | None = None) -> DataFrame:
    """kind, canon, surrogate: different entities get different surrogates, none of them an entity.

    In each round every entity left proposes; of those that propose the same the first
    wins, unless the proposal is a real entity or was given away before.  Losers draw
    again.  Case tells no two apart.  A name without a telling title takes the gender of its other mentions.
    """
    told = F.min(F.when(F.col("gender") != "x", F.col("gender")))
    key = key or session_key(found.sparkSession)
    real = stored(found.groupBy("kind", "canon").agg(F.coalesce(told, F.lit("x")).alias("gender")))
    left, done, turn = real, None, 0
    while not left.isEmpty():
        asked = left.withColumn("surrogate", proposed(F.col("kind"), F.col("canon"), F.col("gender"), turn, key))
        asked = asked.withColumn("form", F.lower("surrogate"))
        taken = real.select("kind", F.lower("canon").alias("form"))
        if done is not None:
            taken = taken.union(done.select("kind", F.lower("surrogate").alias("form")))
        free = asked.join(taken, ["kind", "form"], "left_anti")
        won = free.groupBy("kind", "form").agg(F.min_by(F.struct("canon", "surrogate"), "canon").alias("first"))
        won = won.select("kind", "first.canon", "first.surrogate")
        won = stored(won)
        done = won if done is None else done.union(won)
        left = stored(left.join(won.select("kind", "canon"), ["kind", "canon"], "left_anti"))
        turn += 1
    return done if done is not None else real.select("kind", "canon", F.lit("").alias("surrogate"))


def replace_entities(docs: DataFrame, id: str = "doc_id", text: str = "text", key: str | None = None) -> DataFrame:
    """``docs`` with the same columns and rows, personal data in ``text`` replaced.

    The same entity has the same surrogate in all documents and on every run with the
    same key (``session_key`` where none is given); different entities never share one, and no surrogate is an entity of the
    corpus.  Null and empty texts and texts without a find come back as they are.  Rows
    with equal or null ids are replaced one by one.

    A name found after a title is replaced where it stands without one in the same text.

    Card numbers and IBANs with right check digits get such again; see ``proposed``.

    Rows with a find are stored once, with their finds; only they are shuffled.  A text is
    cut at its finds; what lies between them is put together again with the surrogates.
    Time is linear in the length of a text; one text at a time is held.
    """
    own = column(text)
    held = docs.withColumn("__finds", finds(docs, text))
    clean = held.where(F.size("__finds") == 0).drop("__finds")
    dirty = stored(held.where(F.size("__finds") > 0))
    known = stored(described(dirty.select(F.explode("__finds").alias("found"))))
    given = surrogates(known, key)
    bare = untitled(F.col("found"))
    table = stored(
        known.join(given, ["kind", "canon"]).select(
            "found",
            spelled(F.col("kind"), F.col("found"), F.col("canon"), F.col("surrogate")).alias("surrogate"),
            F.when(
                F.col("kind") == "name", F.struct(bare.alias("name"), _in_case(bare, F.col("surrogate")).alias("alias"))
            ).alias("name"),
        )
    )
    dirty = dirty.withColumn("__key", F.struct(column(id).alias("id"), F.xxhash64(own).alias("h")))
    mentions = dirty.select("__key", F.explode(F.array_distinct("__finds")).alias("found"))
    maps = mentions.join(table, "found").groupBy("__key").agg(
        F.map_from_entries(F.collect_set(F.struct("found", "surrogate"))).alias("__map"),
        F.map_from_entries(F.collect_set("name")).alias("__names"),
    )
    maps = maps.withColumnRenamed("__key", "__of")
    joined = dirty.join(maps, dirty["__key"].eqNullSafe(maps["__of"]), "left")
    # Further mentions of the document's names, without a title, lie in the gaps; longer names go first.
    longer = F.array_sort(F.map_keys("__names"), lambda a, b: F.length(b) - F.length(a))
    quoted = F.array_join(F.transform(longer, lambda n: F.replace(n, F.lit("."), F.lit("\\."))), "|")
    named = F.concat(F.lit(r"(?<![\p{L}\p{N}_])(?:"), quoted, F.lit(r")(?![\p{L}\p{N}_])"))

    def renamed(gap: Column) -> Column:
        aliases = F.transform(F.regexp_extract_all(gap, named, F.lit(0)), lambda n: F.try_element_at("__names", n))
        parts = F.zip_with(F.split(gap, named, -1), aliases, lambda g, n: F.concat(g, F.coalesce(n, F.lit(""))))
        return F.when(F.size("__names") > 0, F.array_join(parts, "")).otherwise(gap)

    gaps = F.transform(F.split(own, KINDS.any, -1), renamed)
    put = F.transform("__finds", lambda f: F.coalesce(F.try_element_at("__map", f), f))
    new = F.array_join(F.zip_with(gaps, put, lambda g, s: F.concat(g, F.coalesce(s, F.lit("")))), "")
    changed = joined.withColumn(text, new).select(*[column(c) for c in docs.columns])
    return clean.select(*[column(c) for c in docs.columns]).unionByName(changed)
