"""Surrogates for personal data, in DataFrame functions only.

Emails, IP addresses, phone numbers, payment cards, social security numbers,
bank accounts and titled names are replaced by others of the same type.  A
surrogate is a keyed hash of the entity in its canonical form, so one entity
gets one surrogate in the whole corpus (coreference) without a lookup:

* digits become digits and letters letters of their case, separators stay;
* an international number keeps its first digit, a national one its trunk
  prefix (0 with the digit after it, or 1); a card keeps its first digit (four
  if that is 2) and, if it was valid, a valid check digit; an
  address stays a valid address; an email keeps the form of its parts and its
  top-level domain;
* a titled name keeps title, gender, script and number of words.

Formats: international numbers with +, numbers with an area in brackets,
3-3-4, trunk prefix 0 in groups, and Spanish ones of nine digits in groups;
cards in groups of four, 4-6-5, 4-6-4 or unbroken; accounts unbroken or in
groups of four.  National numbers without a separator, with dots between three
groups of nine digits, or of other forms aren't found, nor are names without
one of the titles; a number with and without its country code is two entities.

Collision checks keep distinct entities apart: the distinct entities of the
corpus are counted by surrogate; where two meet, or a surrogate is itself an
entity of the corpus, all but the smallest get the next attempt, until no two
meet.  Only these exceptions are joined back to the documents.  The space grows
with the attempt, so that this ends however many entities there are: a surname
gets a syllable more for each attempt, an email a letter, a phone number a
digit from the fourth attempt on (up to 15 digits).  The other kinds keep the
space of their format (10^9 social security numbers, 3.6 10^9 addresses, 10^11
cards and more): it ends if that has room for the corpus's entities twice.

Defined cases: a null text stays null and has no entity; ids may be null or
repeat; a row that repeats is rewritten alike; an empty table gives an empty
result; other columns pass through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, let, store

# Formats of the entities, in the order in which they are tried at a place.  Each starts where a run of its
# own characters starts, so that a long run is read once.
SERIES_2 = r"2(?:22[1-9]|2[3-9][0-9]|[3-6][0-9]{2}|7[01][0-9]|720)"
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])(?![0-9]|\.[0-9])",
    "phone": "|".join((
        r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{4}(?![0-9])",
        # international: a one-digit group may follow the country code
        r"(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?\(0\))?(?:[ .-]?[0-9])?(?:[ .-]?[0-9]{2,4}){2,4}(?![0-9])",
        r"(?<![0-9+.-])(?:1[ .-])?[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9-])",
        # trunk prefix 0: five pairs; area and two groups; area, a group and pairs; area and a long group
        r"(?<![0-9+.-])(?<!\b[0-9]{2} )0[1-9](?:[ .-][0-9]{2}){4}(?![0-9-]|[ .][0-9]{2}(?![0-9]))",
        r"(?<![0-9+.-])0[1-9][0-9]{1,4}[ /-][0-9]{3,4}[ -][0-9]{3,4}(?![0-9-])",
        r"(?<![0-9+.-])0[1-9][0-9]{1,3}[ /][0-9]{2,3}(?: [0-9]{2}){2,3}(?![0-9-])",
        r"(?<![0-9+.-])0[1-9][0-9]{1,4}[ /-][0-9]{6,8}(?:-[0-9]{1,4})?(?![0-9-])",
        # nine digits without a prefix, unless they go on as a number with blanks between its thousands
        r"(?<![0-9+.-])(?<![0-9][ ,])[6-9][0-9]{2}(?:[ -][0-9]{3}[ -][0-9]{3}|(?: [0-9]{2}){3})(?![0-9-]|[ .,][0-9])",
        r"(?<![0-9+.-])(?<![0-9][ ,])9[1-8] [0-9]{3} [0-9]{2} [0-9]{2}(?![0-9-]|[ .,][0-9])")),
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    # groups of four, 4-6-5 and 4-6-4, the 2-series, and without separators
    "card": "|".join((
        r"(?<![0-9A-Za-z-])[3-6][0-9]{3}(?:[ -][0-9]{4}){2}[ -][0-9]{1,4}(?![0-9A-Za-z-])",
        r"(?<![0-9A-Za-z-])3[0-9]{3}[ -][0-9]{6}[ -][0-9]{4,5}(?![0-9A-Za-z-])",
        rf"(?<![0-9A-Za-z-]){SERIES_2}(?:[ -][0-9]{{4}}){{3}}(?![0-9A-Za-z-])",
        rf"(?<![0-9A-Za-z])(?:[3-6][0-9]{{12,18}}|{SERIES_2}[0-9]{{12}})(?![0-9A-Za-z])")),
    # printed in groups of four: the second group starts with a digit, and letters alone don't end it
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}| [A-Z0-9]{4} [0-9][A-Z0-9]{3}(?: (?=(?:[A-Z]{4} )?[A-Z]{0,3}[0-9])[A-Z0-9]{4}(?![A-Za-z0-9])){0,5}(?: (?=[A-Z]{0,2}[0-9])[A-Z0-9]{1,3})?)(?![A-Za-z0-9])",
    "person": r"(?<!\p{L})(?:Mr|Mrs|Ms|Miss|Herr|Frau|Mme|Mlle|Monsieur|Madame|Señor|Señora|Sra|г-н|г-жа)\.? \p{Lu}\p{Ll}+(?: \p{Lu}\p{Ll}+)?",
}
KINDS = tuple(PATTERNS)
SAME_LENGTH_TRIES = 4  # of a phone number, before it gets longer
MAX_PHONE_DIGITS = 15
#: An email needs an @; all others start with one of these characters, so that most places are left after one look.
OTHERS = f"(?=[0-9+(A-Zг])(?:{'|'.join(f'(?:{p})' for k, p in PATTERNS.items() if k != 'email')})"
ANY = f"(?:{PATTERNS['email']})|{OTHERS}"
# Titles of women, and given names and name parts for surrogates by script and gender.
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Mme", "Mlle", "Madame", "Señora", "Sra", "г-жа")
GIVEN = {("latin", "f"): ("Anna", "Clara", "Elena", "Helen", "Julia", "Laura", "Maria", "Nora", "Sofia", "Vera"),
         ("latin", "m"): ("Albert", "Bruno", "David", "Hugo", "Leon", "Martin", "Oscar", "Paul", "Simon", "Victor"),
         ("cyrillic", "f"): ("Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "София"),
         ("cyrillic", "m"): ("Антон", "Борис", "Виктор", "Иван", "Максим", "Олег", "Павел", "Сергей")}
SYLLABLES = {"latin": ("bar", "den", "fel", "gor", "hal", "kin", "lam", "mor", "ner", "pol", "ras", "sten", "tor", "val", "wen", "zim"),
             "cyrillic": ("бар", "вол", "гор", "дан", "зим", "кор", "лав", "мир", "нов", "пет", "рад", "сев", "тар", "фед", "хар", "яр")}


def mentions_of(text: Column) -> Column:
    """The entities of a text, in order; the email pattern is tried only in texts that have an @."""
    return F.when(text.contains("@"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(
        F.regexp_extract_all(text, F.lit(OTHERS), F.lit(0)))


def between(text: Column) -> Column:
    """What stands before, between and after them."""
    return F.when(text.contains("@"), F.split(text, ANY, -1)).otherwise(F.split(text, OTHERS, -1))


def kind_of(entity: Column) -> Column:
    bare = F.translate(entity, " -", "")
    return (F.when(entity.contains("@"), "email")
            .when(entity.rlike(r"^[0-9]+(?:\.[0-9]+){3}$"), "ip")
            .when(entity.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
            .when(entity.rlike(r"^[A-Z]{2}[0-9]{2}"), "iban")
            .when(entity.rlike(r"^\p{L}"), "person")
            .when(bare.rlike(f"^(?:[3-6][0-9]{{12,18}}|{SERIES_2}[0-9]{{12}})$"), "card").otherwise("phone"))


def canonical(entity: Column) -> Column:
    """What makes two mentions one entity: letter case, the separators of a number and the dot of a title don't."""
    return let(kind_of(entity), lambda kind: F.concat(
        kind, F.lit(":"), F.when(kind == "email", F.lower(entity))
        .when(kind.isin("card", "phone"), F.regexp_replace(entity, r"[^0-9+]", ""))
        .when(kind == "iban", F.translate(entity, " ", ""))
        .when(kind == "person", F.regexp_replace(entity, r"^([^ .]+)\. ", "$1 ")).otherwise(entity)))


def _hash(canon: Column, key: str, attempt: Column) -> Column:
    return F.sha2(F.concat(F.lit(f"{key}\x00"), attempt.cast("string"), F.lit("\x00"), canon), 512)  # 128 hexadecimal digits


def _number(h: Column, at: int, below: int) -> Column:
    """A number from 0 to below - 1 from seven hexadecimal digits of ``h``."""
    return (F.conv(F.substring(h, at, 7), 16, 10).cast("long") % below).cast("int")


def _disguise(entity: Column, h: Column) -> Column:
    """Digits to digits, letters to letters of their case; all else stays.  A keyed shift by place: place i moves by the
    i-th hexadecimal pair of ``h``, so mentions in other case or with other separators move alike."""
    digits = F.translate(h, "abcdef", "012345")
    chars = F.split(entity, "")

    def one(acc, c):
        k = (acc["i"] % 60).cast("int")
        shift = F.conv(F.substr(h, 2 * k + 1, F.lit(2)), 16, 10).cast("int")
        low = F.chr((F.ascii(F.lower(c)) - 97 + 1 + shift % 25) % 26 + 97)
        new = (F.when(c.rlike("^[0-9]$"), F.substr(digits, k + 1, F.lit(1)))
               .when(c.rlike("^[a-z]$"), low).when(c.rlike("^[A-Z]$"), F.upper(low)).otherwise(c))
        return F.struct(F.concat(acc["out"], new).alias("out"),
                        (acc["i"] + c.rlike("^[0-9A-Za-z]$").cast("int")).alias("i"))

    return F.aggregate(chars, F.struct(F.lit("").alias("out"), F.lit(0).alias("i")), one)["out"]


def _weave(entity: Column, digits: Column) -> Column:
    """``entity`` with its digits replaced by ``digits``, in order."""
    def one(acc, c):
        digit = c.rlike("^[0-9]$")
        return F.struct(F.concat(acc["out"], F.when(digit, F.substr(digits, acc["i"], F.lit(1))).otherwise(c)).alias("out"),
                        (acc["i"] + digit.cast("int")).alias("i"))

    return F.aggregate(F.split(entity, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("i")), one)["out"]


def _phone(entity: Column, h: Column) -> Column:
    """Head and new digits follow from the canonical digits, so that all formats of a number get the same ones."""
    def new(number):
        kept = (F.when(number.startswith("+"), 1).when(number.rlike("^0[1-9]"), 2).when(number.rlike("^1[0-9]{10}$"), 1).otherwise(0))
        digits = F.translate(number, "+", "")
        return F.concat(digits.substr(F.lit(1), kept), _disguise(digits.substr(kept + 1, F.length(digits)), h))

    return _weave(entity, let(F.regexp_replace(entity, "[^0-9+]", ""), new))


def _luhn_sum(number: Column) -> Column:
    """Luhn sum of the digits of ``number``; 0 modulo 10 if its check digit is right."""
    digits = F.reverse(F.split(F.regexp_replace(number, "[^0-9]", ""), ""))

    def value(c, i):
        d = c.cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(digits, value), F.lit(0), lambda a, x: a + x)


def _card(entity: Column, h: Column) -> Column:
    kept = F.when(entity.startswith("2"), 4).otherwise(1)  # first digits: the 2-series is known by four
    start = entity.substr(F.lit(1), kept)

    def finish(c):  # first digits as before, a check digit that is right
        c = F.concat(start, c.substr(kept + 1, F.length(entity) - kept - 1), F.lit("0"))
        return let(c, lambda x: F.concat(x.substr(F.lit(1), F.length(x) - 1),
                                         ((10 - _luhn_sum(x) % 10) % 10).cast("string")))

    shape = _disguise(entity, h)
    return F.when(_luhn_sum(entity) % 10 == 0, let(shape, finish)).otherwise(
        F.concat(start, shape.substr(kept + 1, F.length(entity))))


def _extra(h: Column, at: int, n: Column, values: tuple[str, ...]) -> Column:
    """``n`` values one after the other, each by one hexadecimal digit of ``h`` from ``at`` on, as far as ``h`` goes."""
    digits = F.split(F.substring(h, at, 128), "", -1)
    picked = F.transform(F.slice(F.filter(digits, lambda d: d != ""), F.lit(1), F.greatest(n, F.lit(0))), lambda d: F.get(
        F.split(F.lit(" ".join(values)), " "), (F.conv(d, 16, 10).cast("int") % len(values)).cast("int")))
    return F.when(n > 0, F.array_join(picked, "")).otherwise("")


def _person(entity: Column, h: Column, attempt: Column) -> Column:
    title = F.regexp_extract(entity, r"^([^ ]+) ", 1)
    female = F.regexp_replace(title, r"\.$", "").isin(*FEMALE_TITLES)
    cyrillic = F.regexp_extract(entity, r" (.)", 1).rlike(r"\p{IsCyrillic}")

    def pick(values, at):
        return F.get(F.split(F.lit(" ".join(values)), " "), _number(h, at, len(values)))

    def surname(script):
        return F.initcap(F.concat(*[pick(SYLLABLES[script], at) for at in (9, 17, 25, 33)], _extra(h, 41, attempt, SYLLABLES[script])))

    def full(script, gender):
        last = surname(script)
        if (script, gender) == ("cyrillic", "f"):
            last = F.concat(last, F.lit("а"))
        return F.when(F.size(F.split(entity, " ")) > 2, F.concat(pick(GIVEN[script, gender], 1), F.lit(" "), last)).otherwise(last)

    name = (F.when(cyrillic & female, full("cyrillic", "f")).when(cyrillic, full("cyrillic", "m"))
            .when(female, full("latin", "f")).otherwise(full("latin", "m")))
    return F.concat(title, F.lit(" "), name)


def surrogate(entity: Column, key: str, attempt: Column) -> Column:
    """The replacement of a mention: type and format as the mention's, content by its canonical form."""
    def make(x):
        kind, h = x["kind"], x["h"]
        # what stays before and after the part that is disguised
        head = F.when(kind == "iban", F.substring(entity, 1, 2)).otherwise("")
        tail = F.when(kind == "email", F.regexp_extract(entity, r"(\.[^.]+)$", 1)).otherwise("")
        body = entity.substr(F.length(head) + 1, F.length(entity) - F.length(head) - F.length(tail))
        more = F.least(attempt - SAME_LENGTH_TRIES + 1, MAX_PHONE_DIGITS - F.length(F.regexp_replace(entity, "[^0-9]", "")))
        phone = F.concat(_phone(entity, h), _extra(h, 65, more, tuple("0123456789")))
        first = F.when(kind == "email", _extra(h, 65, attempt, tuple("abcdefghijklmnop"))).otherwise("")
        ip = F.concat_ws(".", *[(_number(h, 1 + 8 * k, 223 if k == 0 else 254) + 1).cast("string") for k in range(4)])
        return (F.when(kind == "ip", ip).when(kind == "card", _card(entity, h)).when(kind == "person", _person(entity, h, attempt))
                .when(kind == "phone", phone).otherwise(F.concat(first, head, _disguise(body, h), tail)))

    return let(F.struct(kind_of(entity).alias("kind"), _hash(canonical(entity), key, attempt).alias("h")), make)


def matched(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(text_key, mentions) of the texts that have any; the key is a 64-bit hash of the text."""
    text = docs[text_col]
    found = docs.select(F.xxhash64(text).alias("text_key"), F.array_distinct(mentions_of(text)).alias("mentions"))
    return found.where(F.size("mentions") > 0)


def entities(found: DataFrame) -> DataFrame:
    """The distinct entities (canon, mention) of ``matched`` texts; mention is the smallest form."""
    each = found.select(F.explode("mentions").alias("m"))
    return each.groupBy(canonical(F.col("m")).alias("canon")).agg(F.min("m").alias("mention"))


def exceptions(known: DataFrame, key: str) -> DataFrame:
    """(canon, attempt) of the entities whose first surrogate is another's, or an entity itself.

    ``known`` is stored.  Each round raises the attempt of those that still meet another, all but the smallest of
    the ones that have come furthest; it ends when none meets another.  Nothing but a count reaches the driver.
    """
    spark = known.sparkSession
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    state = known.withColumn("attempt", F.lit(0))
    moved = known.select("canon").limit(0).withColumn("attempt", F.lit(0))
    while True:
        # few bytes but dear rows: dealt to as many tasks as there are
        new = let(surrogate(F.col("mention"), key, F.col("attempt")), canonical)
        named = store(state.repartition(parts, "canon").withColumn("new", new), "pii-round")
        crowd = named.groupBy("new").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "canon")).alias("first")) \
            .where("n > 1").select(F.col("new").alias("name"), F.col("first.canon").alias("first"))
        real = known.select(F.col("canon").alias("name"), F.lit(None).cast("string").alias("first"))
        taken = store(crowd.unionByName(real.join(named.select(F.col("new").alias("name")), "name", "left_semi"))
                      .groupBy("name").agg(F.when(F.count("*") == F.count("first"), F.max("first")).alias("first")), "pii-taken")
        if taken.isEmpty():
            return moved
        meets = named.join(taken, named["new"] == taken["name"], "left")
        bump = F.col("name").isNotNull() & ~F.col("canon").eqNullSafe(F.col("first"))
        state = store(meets.select("canon", "mention", (F.col("attempt") + bump.cast("int")).alias("attempt")), "pii-state")
        moved = state.where("attempt > 0").select("canon", "attempt")


def _count_of(kinds: Column, kind: str) -> Column:
    return F.size(F.filter(kinds, lambda k: k == kind)).cast("long")


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", counts: str | None = None) -> DataFrame:
    """``docs`` with the entities in ``text_col`` replaced; ``counts`` names a column (kind -> mentions) to add."""
    matches = store(matched(docs, text_col), "pii-matches")
    moved = store(exceptions(store(entities(matches), "pii-entities"), key), "pii-exceptions")
    m, tries, k, k2 = fresh(docs, "mentions", "tries", "text_key", "text_key_of")
    text = docs[text_col]
    found = docs.withColumns({m: F.coalesce(mentions_of(text), F.array().cast("array<string>")), k: F.xxhash64(text)})
    # attempts that differ from 0, by text; a key shared by two texts only adds entries that hold for both
    per_text = (matches.select("text_key", F.explode(F.array_distinct(F.transform("mentions", canonical))).alias("canon"))
                .join(moved, "canon").groupBy("text_key").agg(F.map_from_entries(F.collect_set(F.struct("canon", "attempt"))).alias(tries)))
    per_text = store(per_text.withColumnRenamed("text_key", k2), "pii-attempts")
    met = found.join(per_text, found[k] == per_text[k2], "left")

    def replaced(x):
        attempt = F.coalesce(F.get(F.map_values(F.map_filter(F.col(tries), lambda c, _: c == canonical(x))), F.lit(0)), F.lit(0))
        return let(attempt, lambda a: surrogate(x, key, a))

    pieces = between(text)
    woven = F.flatten(F.zip_with(pieces, F.transform(m, replaced), lambda p, r: F.array(p, F.coalesce(r, F.lit("")))))
    new = F.when(F.size(m) > 0, F.array_join(woven, "")).otherwise(text)
    extra = []
    if counts:
        kinds = F.transform(F.col(m), kind_of)
        extra = [let(kinds, lambda ks: F.map_from_arrays(F.array(*[F.lit(x) for x in KINDS]), F.array(
            *[_count_of(ks, x) for x in KINDS]))).alias(counts)]
    return met.select(*[new.alias(c) if c == text_col else docs[c] for c in docs.columns], *extra)
