"""Surrogates for personal data, in DataFrame functions alone.

One pattern finds e-mail addresses, phone numbers, IPv4 addresses, social security and card numbers, IBANs, secrets and
titled person names. Each distinct entity of the corpus gets one keyed surrogate of its own type: digits stay digits in the
same layout, cards and IBANs keep a valid (or invalid) check sum, letters keep case and script, names keep the gender of
their titles, and particles in names stay. So an entity has the same surrogate wherever and however it is written. In a text that has a titled name, its
words are replaced without the title as well.

Surrogates are drawn per distinct entity and checked in grouped passes: one that two entities drew, that was given before,
or that is itself an entity of the corpus is drawn again for all but one, and from the fourth drawing on it is longer than
the entity's own form, so that short forms do not run out. Addresses differ within their domain. Texts without a find are not shuffled; those with
finds are rewritten from a map of their own entities, which is no larger than the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairlens.llm.common import settle, shuffle_width

WORD = r"\p{L}0-9"
TITLES_M = r"Mr|Herrn?|Monsieur|Señor|Sr|Don|господин|г-н"
TITLES_F = r"Mrs|Ms|Miss|Frau|Madame|Mme|Mademoiselle|Señora|Señorita|Sra|Srta|Doña|госпожа|г-жа"
TITLES_N = r"Dr|Prof|Доктор|доктор"
NAME = r"\p{Lu}[\p{L}'’-]++"
#: Small words inside of names; they stay as they are.
PARTICLES = "von|vom|zu|zum|zur|van|der|den|de|del|della|di|da|dos|du|la|le|bin|ibn|ben|al|el|ter|ten"
ASSIGNED = r"(?i:\b(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth[_-]?key)\s{0,3}[=:]\s{0,3}[\"'“]?)"

#: Kinds in the order in which they are tried, with their patterns. What is open-ended is possessive, so that a find has no
#: longest length and a search takes no stack; labels of a domain are bounded as domain names are (63 signs, 127 labels).
KINDS: dict[str, str] = {
    "email": rf"(?<![{WORD}._%+-])[{WORD}][{WORD}._%+-]*+@(?:[{WORD}](?:[{WORD}-]{{0,62}})\.){{1,126}}\p{{L}}{{2,63}}(?![{WORD}])",
    "secret": rf"{ASSIGNED}(?=[+/_.=~-]*+[A-Za-z0-9])[A-Za-z0-9+/_.=~-]{{8,}}+|(?<![{WORD}_-])(?:AKIA[A-Z0-9]{{16}}|(?:sk|pk|ghp|gho|xox[abp])[-_][A-Za-z0-9_-]{{16,}}+)(?![{WORD}])|(?<![{WORD}])(?=[A-Fa-f]*+[0-9])[A-Fa-f0-9]{{32,}}+(?![{WORD}])",
    "iban": r"(?<![\p{L}0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "card": r"(?<![0-9])(?:[0-9]{13,19}|(?:[0-9]{4}[ -]){3}[0-9]{1,7}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+?[0-9]{1,3}[ .-]?)?\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}(?![0-9])|(?<![0-9+])\+[0-9]{1,3}(?:[ .-]?[0-9]{2,4}){2,5}(?![0-9])|(?<![0-9.-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![0-9])",
    "name": rf"(?<![{WORD}])(?:{TITLES_M}|{TITLES_F}|{TITLES_N})\.?(?:[ \u00a0](?:{PARTICLES}))*+[ \u00a0]{NAME}(?:(?:[ \u00a0](?:{PARTICLES}))*+[ \u00a0]{NAME})*+",
}
BARE = rf"(?<![{WORD}]){NAME}(?:[ \u00a0]{NAME}){{0,2}}"
FINDER = "|".join(f"(?:{p})" for p in KINDS.values())
#: What any find must hold: cheap to look for before the finder runs.
HINT = rf"[0-9@]|AKIA|(?:sk|pk|ghp|gho|xox[abp])[-_]|(?i:token|secret|passw|pwd|key)|(?:{TITLES_M}|{TITLES_F}|{TITLES_N})\.?[ \u00a0](?:\p{{Lu}}|(?:{PARTICLES})[ \u00a0])|[A-Fa-f0-9]{{32}}"

LATIN = "ba be bi bo bu da de di do du fa fe fi fo ga ge gi go ha he hi ho ka ke ki ko ku la le li lo lu ma me mi mo mu na ne ni no nu pa pe pi po ra re ri ro ru sa se si so su ta te ti to tu va ve vi vo za ze zi zo".split()
CYRILLIC = "ба бе би бо бу ва ве ви во да де ди до ду га ге ги го ка ке ки ко ку ла ле ли ло лу ма ме ми мо му на не ни но ну па пе пи по ра ре ри ро ру са се си со су та те ти то ту за зе зи зо".split()
#: By script: syllables, and endings by kind and gender.
NAMES: dict[str, tuple[list[str], dict[str, str]]] = {
    "latin": (LATIN, {"given-f": "lina", "given-m": "ldo", "given-n": "rin", "surname": "mer"}),
    "cyrillic": (CYRILLIC, {"given-f": "лина", "given-m": "слав", "given-n": "рин", "surname-f": "нова", "surname-m": "нов", "surname-n": "ренко"}),
    "greek": ([c + v for c in "βγδζθκλμνπρστφχ" for v in "αειο"], {"given-f": "λινα", "given-m": "νδρος", "given-n": "ριν", "surname": "ριδη"}),
    "armenian": ([c + v for c in "բգդզթլկհմնպսվտր" for v in "աեիո"], {"given-f": "նուշ", "given-m": "րամ", "given-n": "րեն", "surname": "նյան"}),
    "georgian": ([c + v for c in "ბგდზთკლმნპრსტფქ" for v in "აეიო"], {"given": "ნი", "surname": "ძე"}),
}
LETTERS = "abcdefghijklmnopqrstuvwxyz"
#: Drawings in an entity's own form before surrogates grow by one more sign a drawing; IPv4 addresses have one form only.
OWN_FORM, OWN_FORM_IP = 3, 20


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def _chars(c: Column) -> Column:
    return F.filter(F.split(c, ""), lambda x: x != "")


def kind_of(find: Column) -> Column:
    """The first kind whose pattern the whole find matches."""
    out = F.when(F.lit(False), "")
    for kind, pattern in KINDS.items():
        out = out.when(find.rlike(f"^(?:{pattern})$"), kind)
    return out


def _name_words(find: Column) -> Column:
    return _words(F.regexp_replace(find, rf"^(?:{TITLES_M}|{TITLES_F}|{TITLES_N})\.?[ \u00a0]", ""))


def _words(names: Column) -> Column:
    """Words, each with the blank before it."""
    return F.split(names, "(?=[ \u00a0])")


def _capital(word: Column) -> Column:
    """Whether a word, with the blank before it, is none of the particles."""
    return word.rlike("^[ \u00a0]?\\p{Lu}")


def _stem(word: Column) -> Column:
    """A name without the blank before it and an English genitive or loose marks behind it."""
    return F.regexp_replace(F.regexp_replace(word, "^[ \u00a0]", ""), "(?:['’][sS]?|-)+$", "")


def _gender(find: Column) -> Column:
    return F.when(find.rlike(rf"^(?:{TITLES_M})\.?[ \u00a0]"), "m").when(find.rlike(rf"^(?:{TITLES_F})\.?[ \u00a0]"), "f").otherwise("n")


def _word_kind(words: Column, w: Column, i: Column) -> Column:
    return F.concat(F.when(i == F.size(words) - 1, F.lit("surname-")).otherwise(F.lit("given-")), _script(w))


def _word_gender(gender: Column, words: Column, w: Column, i: Column) -> Column:
    """Given names have a gender, and so have surnames where the script's language gives them one."""
    return F.when((i == F.size(words) - 1) & (_script(w) != "cyrillic"), "n").otherwise(gender)


def _script(word: Column) -> Column:
    out = F.when(F.lit(False), "")
    for script in [*NAMES][1:]:
        out = out.when(word.rlike(rf"\p{{Is{script.capitalize()}}}"), script)
    return out.otherwise("latin")


def _country(find: Column) -> Column:
    """How many digits of a phone number are its country's, as far as it is set off after a plus sign."""
    return F.when(find.startswith("+"), F.length(F.regexp_extract(find, r"^\+([0-9]{1,3}?)(?:[ .(-]|$)", 1))).otherwise(F.lit(0))


def _secret_value(find: Column) -> Column:
    return F.regexp_replace(find, f"^{ASSIGNED}", "")


def entities_of(find: Column) -> Column:
    """Array of (kind, canonical, trait): what has a surrogate of its own in a find. An address has its domain beside it; a
    name has its words, the last as surname and those before as given names of the title's gender. A trait is what a
    surrogate keeps beyond its kind: of a phone number, how many digits are its country's, and of a name, the gender."""
    kind = kind_of(find)

    def one(k: Column | str, c: Column, trait: Column | str = "") -> Column:
        k, trait = (F.lit(x) if isinstance(x, str) else x for x in (k, trait))
        return F.struct(k.alias("kind"), c.alias("canonical"), trait.alias("trait"))

    words = F.struct(F.filter(_name_words(find), _capital).alias("w"), _gender(find).alias("g"))
    names = _once(words, lambda o: F.transform(o["w"], lambda w, i: one(_word_kind(o["w"], w, i), F.lower(_stem(w)), _word_gender(o["g"], o["w"], w, i))))
    low = F.lower(find)
    return (
        F.when(kind == "email", F.array(one("email", low), one("domain", F.substring_index(low, "@", -1))))
        .when(kind == "secret", F.array(one("secret", _secret_value(find))))
        .when(kind == "iban", F.array(one("iban", F.replace(find, F.lit(" ")))))
        .when(kind == "ip", F.array(one("ip", find)))
        .when(kind == "name", names)
        .when(kind == "phone", F.array(one("phone", _digits(find), _country(find).cast("string"))))
        .otherwise(F.array(one(kind, _digits(find))))
    )


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once a row, also where inner lambdas use it for each sign."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _drawn(seed: Column, i: Column, n: int) -> Column:
    """A keyed number below ``n`` for place ``i``."""
    return F.pmod(F.conv(F.substring(F.sha2(F.concat(seed, F.lit("/"), i.cast("string")).cast("binary"), 256), 1, 12), 16, 10).cast("long"), F.lit(n)).cast("int")


def _same_shape(canonical: Column, seed: Column) -> Column:
    """Digits for digits, letters for letters of the same case, all else as it is; hexadecimal stays hexadecimal."""

    def swap(c: Column, i: Column, plain_hex: Column) -> Column:
        letter = F.substring(F.lit(LETTERS), F.lit(1) + F.when(plain_hex, _drawn(seed, i, 6)).otherwise(_drawn(seed, i, 26)), F.lit(1))
        return F.when(c.rlike("[0-9]"), _drawn(seed, i, 10).cast("string")).when(c.rlike("[a-z]"), letter).when(c.rlike("[A-Z]"), F.upper(letter)).otherwise(c)

    plain_hex = canonical.rlike("^(?:[0-9a-f]++|[0-9A-F]++)$")
    return _once(plain_hex, lambda h: F.array_join(F.transform(_chars(canonical), lambda c, i: swap(c, i, h)), ""))


def _luhn(digits: Column) -> Column:
    """Check sum of a string of digits, mod 10; the last digit counts once."""
    n = F.length(digits)

    def weigh(c: Column, i: Column) -> Column:
        d = c.cast("int") * (1 + (n - 1 - i) % 2)
        return F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(_chars(digits), weigh), F.lit(0), lambda a, b: a + b) % 10


def _mod97(iban: Column) -> Column:
    moved = F.concat(F.substring(iban, 5, 64), F.substring(iban, 1, 4))

    def step(rest: Column, c: Column) -> Column:
        value = F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
        return (rest * F.when(value > 9, 100).otherwise(10) + value) % 97

    return F.aggregate(_chars(moved), F.lit(0), step)


def draw(kind: Column, canonical: Column, key: str, attempt: int) -> Column:
    """The surrogate of an entity at an attempt, in canonical form. ``kind`` may have a trait behind it (``phone-2``)."""
    seed = F.sha2(F.concat_ws("|", F.lit(key), kind, canonical, F.lit(str(attempt))).cast("binary"), 256)
    return _once(seed, lambda one: _draw(kind, canonical, one, attempt))


def _draw(kind: Column, canonical: Column, seed: Column, attempt: int) -> Column:
    shape, more = _same_shape(canonical, seed), max(0, attempt + 1 - OWN_FORM)
    grown = F.concat(F.lit(""), *(_drawn(seed, F.lit(f"more {i}"), 10).cast("string") for i in range(more)))
    body = F.concat(F.substring(canonical, 1, 1), F.substring(shape, F.lit(2), F.length(shape) - 2), grown)
    card = F.concat(body, F.pmod(_luhn(canonical) - _luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))
    iban_body = F.concat(F.substring(shape, 5, 64), grown)
    checked = F.lpad((98 - _mod97(F.concat(F.substring(canonical, 1, 2), F.lit("00"), iban_body))).cast("string"), 2, "0")
    iban = F.concat(F.substring(canonical, 1, 2), F.when(_mod97(canonical) == 1, checked).otherwise(F.substring(shape, 3, 2)), iban_body)
    local = F.substring_index(canonical, "@", 1)
    # letters outside A-Z in an address become letters as well
    address = F.regexp_replace(_same_shape(F.regexp_replace(local, r"[^a-z0-9._%+-]", "x"), seed), "^$", "x")
    address = F.concat(address, grown)
    octets = F.concat_ws(".", *(_drawn(seed, F.lit(i), n).cast("string") if i else (_drawn(seed, F.lit(0), 222) + 1).cast("string") for i, n in enumerate((222, 256, 256, 254))))
    if attempt >= OWN_FORM_IP:  # the IPv6 addresses set apart for documentation
        octets = F.concat(F.lit("2001:db8"), *(F.concat(F.lit(":"), F.lower(F.hex(_drawn(seed, F.lit(i), 1 << 16)))) for i in range(6)))

    country = F.coalesce(F.regexp_extract(kind, "^phone-([0-9])$", 1).try_cast("int"), F.lit(0))
    phone = F.concat(F.substring(canonical, F.lit(1), country), F.substring(shape, country + 1, F.length(shape)), grown)

    def name(syllables: list[str], endings: dict[str, str]) -> Column:
        parts = F.array(*map(F.lit, syllables))
        stem = F.concat(*(F.element_at(parts, _drawn(seed, F.lit(i), len(syllables)) + 1) for i in range(3 + more)))
        ending = F.lit("")
        for mark, text in endings.items():
            word, _, gender = mark.partition("-")
            ending = F.when(kind.rlike(f"^{word}-.*{gender and '-' + gender}$"), text).otherwise(ending)
        return F.concat(stem, ending)

    names = F.lit(None).cast("string")
    for script, (syllables, endings) in NAMES.items():
        names = F.when(kind.rlike(f"^(?:given|surname)-{script}"), name(syllables, endings)).otherwise(names)
    return (
        F.when(kind == "email", address)
        .when(kind == "domain", F.concat(F.lit("m"), F.substring(F.translate(F.sha2(seed.cast("binary"), 256), "0123456789", "ghijklmnop"), 1, 10 + more), F.lit(".example")))
        .when(kind == "card", card)
        .when(kind == "iban", iban)
        .when(kind == "ip", octets)
        .when(kind.startswith("phone"), phone)
        .when(kind == "ssn", F.concat(F.lit("9"), F.substring(shape, 2, 8), grown))
        .when(names.isNotNull(), names)
        .otherwise(F.concat(shape, grown))
    )


def assign(entities: DataFrame, key: str, most_attempts: int = 40, draw: Callable[..., Column] = draw) -> DataFrame:
    """``(kind, canonical, surrogate)`` for distinct (kind, canonical), no two of a kind with one surrogate.

    The surrogate of an address is its local part, which differs from its own and within its domain; domains differ and are
    no domains of the corpus, so addresses do. No surrogate is itself an entity of its kind. Fails rather than leave an
    entity without one. Rows may have a trait; an entity found with several gets one of them, so that it is checked as it
    is written: the longest country, a known gender before none, and none where both are found.
    """
    traits = entities if "trait" in entities.columns else entities.withColumn("trait", F.lit(""))
    male, female = F.max(F.col("trait") == "m"), F.max(F.col("trait") == "f")
    trait = F.when(male & female, "n").when(male, "m").when(female, "f").otherwise(F.max("trait"))
    entities = settle(traits.groupBy("kind", "canonical").agg(trait.alias("trait")), "pii-entities")
    taken, todo = entities.sparkSession.createDataFrame([], "kind string, canonical string, surrogate string"), entities
    originals = entities.select("kind", F.col("canonical").alias("surrogate"))
    local, domain = F.substring_index("canonical", "@", 1), F.substring_index("canonical", "@", -1)
    scope = F.when(F.col("kind") == "email", domain).otherwise("").alias("scope")
    own = F.concat("kind", F.when(F.col("trait") == "", "").otherwise(F.concat(F.lit("-"), "trait")))
    for attempt in range(most_attempts):
        # a small table is read by one task; its entities are drawn by many
        drawn = todo.repartition(shuffle_width(todo.sparkSession), "kind", "canonical").withColumn("surrogate", draw(own, F.col("canonical"), key, attempt))
        drawn = drawn.where((F.col("kind") != "email") | (F.col("surrogate") != local)).groupBy("kind", scope, "surrogate").agg(F.min("canonical").alias("canonical"))
        fresh = drawn.join(taken.select("kind", scope, "surrogate"), ["kind", "scope", "surrogate"], "left_anti").join(originals, ["kind", "surrogate"], "left_anti")
        fresh = settle(fresh.select("kind", "canonical", "surrogate"), "pii-fresh")
        taken = fresh if attempt == 0 else taken.union(fresh)
        todo = settle(todo.join(fresh, ["kind", "canonical"], "left_anti"), "pii-todo")
        if not todo.take(1):
            return taken
    raise RuntimeError("surrogates of some kind have run out")


def _filled(find: Column, digits: Column) -> Column:
    """The find with its digits replaced in order; the last takes all that are left."""
    own, last = _chars(find), F.length(_digits(find))

    def put(c: Column, i: Column) -> Column:
        nth = F.length(_digits(F.substring(find, F.lit(1), i + 1)))
        new = F.substring(digits, nth, F.when(nth == last, F.length(digits)).otherwise(F.lit(1)))
        return F.when(~c.rlike("[0-9]"), c).otherwise(new)

    return F.array_join(F.transform(own, put), "")


def _renamed(word: Column, last: Column, surrogates: Column) -> Column:
    """A word of a name, with the blank before it, by a map from ``kind:canonical``; a word the map lacks stays.

    The last word is a surname rather than a given name, the others are the reverse.
    """

    def known(w: Column) -> Column:
        surname, given = (F.try_element_at(surrogates, F.concat(F.lit(f"{k}-"), _script(w), F.lit(":"), F.lower(w))) for k in ("surname", "given"))
        return F.when(last, F.coalesce(surname, given)).otherwise(F.coalesce(given, surname))

    def shown(w: Column) -> Column:
        new, upper = known(w), (w == F.upper(w)) & (F.length(w) > 1)
        return F.when(upper, F.upper(new)).otherwise(F.concat(F.upper(F.substring(new, 1, 1)), F.substring(new, 2, 64)))

    stem, blank = _stem(word), F.regexp_extract(word, "^[ \u00a0]", 0)
    rest = F.substring(word, F.length(blank) + F.length(stem) + 1, F.length(word))
    genitive = F.when(stem.rlike("..[^sS][sS]$"), F.concat(shown(F.substring(stem, F.lit(1), F.length(stem) - 1)), F.substring(stem, -1, 1)))
    parts = F.when(stem.contains("-"), F.array_join(F.transform(F.split(stem, "(?<=-)|(?=-)"), lambda p: F.coalesce(shown(p), p)), ""))
    return F.when(_capital(word), F.concat(blank, F.coalesce(shown(stem), genitive, parts, stem), rest)).otherwise(word)


def _bare(gap: Column, names: Column) -> Column:
    """What lies between finds, with the words of the text's titled names replaced."""
    runs = F.regexp_extract_all(gap, F.lit(BARE), F.lit(0))

    def put(g: Column, run: Column) -> Column:
        words = _words(run)
        return F.concat(g, F.when(run.isNull(), "").otherwise(F.array_join(F.transform(words, lambda w, i: _renamed(w, i == F.size(words) - 1, names)), "")))

    return F.when(F.size(names) == 0, gap).otherwise(F.array_join(F.zip_with(F.split(gap, BARE, -1), runs, put), ""))


def render(find: Column, surrogates: Column) -> Column:
    """A find rewritten with a map from ``kind:canonical`` to surrogate."""
    kind, low = kind_of(find), F.lower(find)

    def of(k: Column | str, c: Column) -> Column:
        return F.element_at(surrogates, F.concat(F.lit(k) if isinstance(k, str) else k, F.lit(":"), c))

    mail = F.concat(of("email", low), F.lit("@"), of("domain", F.substring_index(low, "@", -1)))
    mail = F.when((find == F.upper(find)) & (find != low), F.upper(mail)).otherwise(mail)
    value = _secret_value(find)
    secret = F.concat(F.substring(find, F.lit(1), F.length(find) - F.length(value)), of("secret", value))
    bare = F.replace(find, F.lit(" "))

    def grouped(c: Column, i: Column) -> Column:
        nth = F.length(F.replace(F.substring(find, F.lit(1), i + 1), F.lit(" ")))
        size = F.when(nth == F.length(bare), F.length(of("iban", bare))).otherwise(F.lit(1))
        return F.when(c == " ", c).otherwise(F.substring(of("iban", bare), nth, size))

    iban = F.array_join(F.transform(_chars(find), grouped), "")
    words = _name_words(find)

    title = F.regexp_extract(find, rf"^(?:{TITLES_M}|{TITLES_F}|{TITLES_N})\.?[ \u00a0]", 0)
    digits = _digits(find)
    return (
        F.when(kind == "email", mail)
        .when(kind == "secret", secret)
        .when(kind == "iban", iban)
        .when(kind == "ip", of("ip", find))
        .when(kind == "name", F.concat(title, _once(words, lambda ws: F.array_join(F.transform(ws, lambda w, i: _renamed(w, i == F.size(ws) - 1, surrogates)), ""))))
        .otherwise(_filled(find, of(kind, digits)))
    )


def replace(documents: DataFrame, key: str) -> DataFrame:
    """The documents with personal data in ``text`` replaced; all columns and rows are kept.

    Null and empty texts, and texts without a find, stay as they are. Equal texts get equal results. Rows may repeat,
    and ids may be null: only the text decides.
    """
    # the hint is tested first, and the finder runs only where it holds
    found = F.coalesce(F.when(F.col("text").rlike(HINT), F.col("text").rlike(FINDER)).otherwise(F.lit(False)), F.lit(False))
    clean = documents.where(~found)
    row = F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row")  # other columns may have any names
    dirty = settle(documents.where(found).select(F.sha2("text", 256).alias("text_key"), "text", row), "pii-dirty")
    texts = dirty.groupBy("text_key").agg(F.first("text").alias("text"))
    finds = texts.select("text_key", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(FINDER), F.lit(0)))).alias("find"))
    exploded = settle(finds.select("text_key", F.explode(entities_of(F.col("find"))).alias("e")).select("text_key", "e.*").distinct(), "pii-finds")
    surrogates = assign(exploded, key)
    exploded = exploded.drop("trait").distinct()
    entry = F.struct(F.concat("kind", F.lit(":"), "canonical").alias("k"), F.col("surrogate").alias("v"))
    maps = exploded.join(surrogates, ["kind", "canonical"]).groupBy("text_key").agg(F.map_from_entries(F.collect_list(entry)).alias("map"))
    maps = settle(maps.withColumn("names", F.map_filter("map", lambda k, v: k.rlike("^(?:given|surname)-"))), "pii-maps")
    joined = dirty.join(maps, "text_key")
    gaps, finds_of = F.split("text", FINDER, -1), F.regexp_extract_all("text", F.lit(FINDER), F.lit(0))
    new = F.array_join(F.zip_with(gaps, finds_of, lambda g, f: F.concat(_bare(g, F.col("names")), F.when(f.isNull(), "").otherwise(render(f, F.col("map"))))), "")
    rewritten = joined.select(*(new.alias("text") if c == "text" else F.col("row").getField(c).alias(c) for c in documents.columns))
    return clean.select(*documents.columns).unionByName(rewritten)
