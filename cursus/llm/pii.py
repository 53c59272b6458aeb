"""Personal data replaced by surrogates. DataFrame functions only.

Detected entities get keyed replacements of their own type: digits for digits in the format of the occurrence, with right
check digits for cards and account numbers and with a phone's country code or trunk zero kept, addresses of the same class of network, letters
of the same case, surnames made in the script of the original, given names of the gender that the title states.
One table holds each distinct entity of the corpus once, so all its mentions share a surrogate whatever
their format; a surrogate that another entity has, or that is itself an entity of the corpus, is drawn again.
A person is the words of the name without title and punctuation: each given name, with the gender, and the family name are
entities of that table, so two persons share a surrogate only if they share every part. A title that states no gender takes
the one that the corpus states for that person, if any. An initial becomes a whole given name. Capitalised words of a
person's name are replaced wherever else they stand in the same document.

Defined results: a null text stays null; a text without entities is returned as it is; repeated rows get the same text;
an empty table gives an empty result; a very long text is one row like any other; where two kinds match at one place the
first of PATTERNS counts; a run of four-digit groups longer than a card is one entity; further columns, whatever their
names, pass through unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import hot_join, written

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_HEX = r"[0-9A-Fa-f]{1,4}"
#: Titles by the gender that they state.
MALE, FEMALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "г-н"), ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra", "г-жа")
MALE, FEMALE = (*MALE, "Mister", "Don", "Sir", "Señorito", "господин"), (*FEMALE, "Doña", "Mlle", "Mademoiselle", "Señorita", "Srta", "Fräulein", "Madam", "Lady", "госпожа")
NEUTRAL = ("Dr", "Dra", "Doctor", "Doctora", "Docteur", "Prof", "Professor", "Professeur", "Profesor", "Profesora", "Mx", "Доктор", "Профессор", "д-р", "проф")
TITLES = "|".join(sorted((*MALE, *FEMALE, *NEUTRAL), key=len, reverse=True))
#: A word of a name, without a possessive 's; an initial; what may stand between the words.
_WORD = r"\p{Lu}(?:\p{L}|['’-](?!s(?!\p{L}))(?=\p{L}))+"
_INITIAL = r"\p{Lu}(?:\. ?| )"
_PARTICLE = r"(?:van|von|vom|zu|zur|de|der|den|del|della|di|da|das|do|dos|du|la|las|los|le|y|e|bin|ibn|al|el|ter|ten) "
_TITLED = rf"(?:{TITLES})\.?(?: (?:{TITLES})(?:\.|(?= )))*"
#: Words that announce a phone number.
_CALL = "tel|tél|telephone|téléphone|teléfono|telefon|phone|fon|mobile|mobil|móvil|portable|cell|fax"
#: Entities in the order in which a place is tried.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "ip6": rf"(?<![\p{{L}}\p{{N}}:])(?:(?:{_HEX}:){{7}}{_HEX}|(?=[0-9A-Fa-f:]*[0-9])(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![\p{{L}}\p{{N}}:])",
    "ip": rf"(?<![\p{{N}}.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\p{{N}}|\.\p{{N}})",
    "ssn": r"(?<![\p{L}\p{N}-])\d{3}-\d{2}-\d{4}(?![\p{N}-])",
    "card": r"(?<![\p{L}\p{N}])(?:\d{4}(?:[ -]?\d{4}){3,}|3[47]\d{2}[ -]?\d{6}[ -]?\d{5})(?![\p{L}\p{N}])",
    "phone": r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,3}(?!\d)|(?<![\p{L}\p{N}])\(?\d{3}\)?[ .-]\d{3}[ .-]\d{4}(?!\d)"
    # With a trunk zero; or after a word that announces one, in any grouping.
    rf"|(?<![\p{{L}}\p{{N}}.,+/-])(?=(?:\d[ /-]?){{8,14}}(?!\d))0\d{{1,4}}[ /-]\d{{3,8}}(?:[ -]\d{{2,5}}){{0,3}}(?![\p{{L}}\p{{N}}])|(?<=(?<!\p{{L}})(?i:{_CALL})[.:]{{0,2}} )(?=(?:\(?\d[ /()-]{{0,2}}){{6}})\(?\d{{2,5}}\)?(?:[ /-]\d{{2,5}}){{1,4}}(?![\p{{L}}\p{{N}}])",
    "iban": r"(?<![\p{L}\p{N}])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "person": rf"(?<!\p{{L}}){_TITLED} (?:{_INITIAL}|{_WORD} |{_PARTICLE})*{_WORD}",
}
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: Any text with an entity has one of these; the test spares the others the patterns above. Whatever is looked for
#: begins with one of a few characters, so that most places are passed over at once.
_FIRST = "".join(sorted({t[0] for t in TITLES.split("|")}))
_AFTER = "|".join(sorted({t[1:] for t in TITLES.split("|")}, key=len, reverse=True))
HINT = rf"[@:\d{_FIRST}](?:(?<=@)|(?<=:)[0-9A-Fa-f:]{{1,5}}:|(?<=\d)[\d .()/-]{{5}}|(?<![\p{{L}}\d@:]\p{{L}})(?<=\p{{L}})(?:{_AFTER})\.? (?:\p{{Lu}}|{_PARTICLE}|(?:{TITLES})))"
#: Syllables of made-up surnames, and given names, by script and gender.
SYLLABLES = {"latin": "ba be bo da de do fa fe ga ge ka ke ko la le lo ma me mo na ne no pa pe ra re ro sa se ta te va".split(), "cyrillic": "ба бе бо да де до га ка ко ла ле ло ма ме мо на не но па пе ра ре ро са се со та те то ва ве зо".split()}
GIVEN = {("latin", True): "Adam Bruno Carl David Emil Felix Hugo Ivan Jonas Karl Leon Marco Noel Oscar Paul Simon".split(), ("latin", False): "Anna Bella Clara Diana Elena Flora Greta Helena Ida Julia Karla Laura Maria Nora Olga Paula".split(), ("cyrillic", True): "Иван Пётр Антон Борис Глеб Денис Егор Илья Лев Марк Олег Павел Роман Семён Тарас Фёдор".split(), ("cyrillic", False): "Анна Вера Галина Дарья Елена Жанна Зоя Ирина Лидия Мария Нина Ольга Раиса Софья Юлия Яна".split()}


def key_of(spark: SparkSession) -> str:
    """The secret of this deployment. The fallback is public and only for tests: with it, anyone can redo the draws."""
    return spark.conf.get("spark.cursus.pii.key", "public")


def _digits(e: Column) -> Column:
    return F.regexp_replace(e, r"\D", "")


#: E.164's country codes; no code begins another one. All of three digits that begin with none of the short ones count.
_CODES = r"^(1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"


def _country(e: Column) -> Column:
    """The country code of a phone; the national format that is found, of three, three and four digits, is that of 1."""
    return F.when(F.startswith(e, F.lit("+")), F.regexp_extract(_digits(e), _CODES, 1)).otherwise("1")


def words_of_person(e: Column) -> Column:
    """The words of the name in lower case, without title, particles and punctuation; the last is the family name."""
    name = F.regexp_replace(e, rf"^{_TITLED} ", "")
    return F.transform(F.regexp_extract_all(name, F.lit(rf"{_WORD}|(?<!\p{{L}})\p{{Lu}}(?!\p{{L}})"), 0), F.lower)


def gender_of(e: Column) -> Column:
    """m or f where a title of the mention states it."""
    stated = lambda titles: e.rlike(rf"^(?:(?:{TITLES})\.? )*?(?:{'|'.join(titles)})\.? ")
    return F.when(stated(FEMALE), "f").when(stated(MALE), "m")


def kind_of(e: Column) -> Column:
    return (
        F.when(F.contains(e, F.lit("@")), "email").when(e.rlike(r"^[0-9A-Fa-f]{0,4}:"), "ip6").when(e.rlike(r"^\d{1,3}(\.\d{1,3}){3}$"), "ip").when(e.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(e.rlike(r"^\d{4}([ -]?\d{4}){3,}$|^3[47]\d{2}[ -]?\d{6}[ -]?\d{5}$"), "card").when(e.rlike(r"^[+(\d]"), "phone").when(e.rlike(r"^[A-Z]{2}\d{2}"), "iban").otherwise("person")
    )


def canonical(kind: Column, e: Column) -> Column:
    """What two mentions of one entity share."""
    plus = F.startswith(e, F.lit("+"))
    rest = F.substr(_digits(e), F.when(plus, F.length(_country(e))).otherwise(0) + 1)
    return (
        F.when(kind.isin("email", "ip6"), F.lower(e)).when(kind == "ip", e).when(kind == "phone", F.concat(_country(e), F.lit("|"), rest))
        .when(kind == "iban", F.replace(e, F.lit(" "), F.lit(""))).when(kind == "person", F.array_join(words_of_person(e), " ")).otherwise(_digits(e))
    )


def _chars(e: Column) -> Column:
    return F.split(e, "")


def _byte(seed: Column, i: Column) -> Column:
    """The i-th of 64 pseudo-random bytes of the seed's two digests."""
    return F.conv(F.substr(seed, (i % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(options: list[str], at: Column) -> Column:
    return F.get(F.array(*map(F.lit, options)), at % len(options))


def surrogate(key: str, kind: Column, canon: Column, attempt: int) -> Column:
    """The canonical surrogate; later attempts draw anew and, where letters allow it, longer ones."""
    text = F.concat_ws("\x1f", F.lit(key), kind, canon, F.lit(str(attempt)))
    seed = F.concat(F.sha2(F.concat(F.lit("a"), text), 256), F.sha2(F.concat(F.lit("b"), text), 256))

    def like(x: Column, spare: Column) -> Column:
        """Digits for digits and lower letters for letters after the first `spare` characters."""
        letter = lambda i: F.char(_byte(seed, i) % 26 + 97)
        one = lambda c, i: F.when(i < spare, c).when(c.rlike(r"\d"), (_byte(seed, i) % 10).cast("string")).when(c.rlike(r"\p{Lu}"), F.upper(letter(i))).when(c.rlike(r"\p{L}"), letter(i)).otherwise(c)
        return F.array_join(F.transform(_chars(x), one), "")

    digit = lambda c: c.cast("int")
    total = lambda xs: F.aggregate(xs, F.lit(0), lambda a, x: a + x)

    def luhn(number: Column) -> Column:
        """The number with its last digit made the check digit."""
        own = F.substr(number, F.lit(1), F.length(number) - 1)
        doubled = F.transform(_chars(F.reverse(own)), lambda c, i: F.when(i % 2 == 0, 2 * digit(c) - F.when(digit(c) > 4, 9).otherwise(0)).otherwise(digit(c)))
        return F.concat(own, F.pmod(-total(doubled), F.lit(10)).cast("string"))

    def checked_iban(number: Column) -> Column:
        """The number with its third and fourth characters made the check digits."""
        country, own = F.left(number, F.lit(2)), F.substr(number, F.lit(5))
        step = lambda rest, c: F.when(c.rlike(r"\d"), (rest * 10 + digit(c)) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)
        rest = F.aggregate(_chars(F.concat(own, country, F.lit("00"))), F.lit(0), lambda a, c: step(a, c).cast("int"))
        return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), own)

    local, more = F.substring_index(canon, "@", 1), "".join(f"{n}" for n in range(attempt // 4))
    longer = F.concat(F.lit(""), *[(_byte(seed, F.lit(50 + i % 12)) % 10).cast("string") for i in range(max(0, attempt - 7))])
    hexed = F.array_join(F.transform(_chars(canon), lambda c, i: F.when(c == ":", c).otherwise(F.lower(F.hex((_byte(seed, i) % 15 + 1).cast("long"))))), "")
    octet = lambda i: (_byte(seed, F.lit(i)) % 254 + 1).cast("string")
    # Addresses of private networks, of the machine itself, of one link and of groups stay such.
    o1, o2 = (digit(F.substring_index(F.substring_index(canon, ".", k), ".", -1)) for k in (1, 2))
    small = (o1 == 192) & (o2 == 168) & (attempt < 12)  # few addresses; when draws fail those of 10 stand in
    within = lambda low, n: (_byte(seed, F.lit(0)) % n + low).cast("string")
    first = F.when((o1 == 192) & (o2 == 168), F.when(small, "192").otherwise("10")).when(o1.isin(0, 10, 127) | ((o1 == 172) & o2.between(16, 31)) | ((o1 == 169) & (o2 == 254)), o1.cast("string")).when(o1 >= 240, within(240, 15)).when(o1 >= 224, within(224, 16)).otherwise(within(11, 89))
    second = F.when(small, "168").when((o1 == 172) & o2.between(16, 31), (_byte(seed, F.lit(1)) % 16 + 16).cast("string")).when((o1 == 169) & (o2 == 254), "254").otherwise(octet(1))
    syllables = lambda script, n, at=0: F.concat(F.lit(""), *[_pick(SYLLABLES[script], _byte(seed, F.lit(at + i))) for i in range(n)])
    cyrillic = canon.rlike(r"\p{IsCyrillic}")
    family = F.when(cyrillic, syllables("cyrillic", 4 + attempt)).otherwise(syllables("latin", 4 + attempt))
    # Given names are few, so a redrawn one has more syllables at once; a neutral one is of either gender.
    male = F.startswith(canon, F.lit("m|")) | (F.startswith(canon, F.lit("x|")) & (_byte(seed, F.lit(40)) % 2 == 0))
    script = F.when(cyrillic, "cyrillic").otherwise("latin")
    given = F.coalesce(*[F.when((script == s) & (male == F.lit(g)), F.lower(F.concat(_pick(names, _byte(seed, F.lit(41))), syllables(s, 2 * attempt, 42)))) for (s, g), names in GIVEN.items()])
    return (
        F.when(kind == "email", F.concat(like(local, F.lit(0)), F.lit(more), F.lit("@example."), _pick(["org", "net", "com"], _byte(seed, F.lit(63)))))
        .when(kind == "ip", F.concat_ws(".", first, second, octet(2), octet(3))).when(kind == "ip6", hexed)
        .when(kind == "phone", F.concat(like(canon, F.locate("|", canon) + F.length(F.regexp_extract(canon, r"\|(0*)", 1))), longer))
        .when(kind == "iban", checked_iban(F.concat(like(canon, F.lit(4)), longer))).when(kind == "card", luhn(F.concat(like(canon, F.lit(0)), longer)))
        .when(kind == "family", family).when(kind == "given", given).otherwise(F.concat(like(canon, F.lit(0)), longer))
    )


def render(kind: Column, e: Column, canon_surrogate: Column) -> Column:
    """The surrogate in the format of the occurrence."""

    def filled(chars: Column, marks: str) -> Column:
        """The occurrence with its k-th mark replaced by the surrogate's k-th."""
        own = _chars(e)
        nth = lambda i: F.size(F.filter(F.slice(own, 1, i + 1), lambda c: c.rlike(marks)))
        put = F.array_join(F.transform(own, lambda c, i: F.when(c.rlike(marks), F.substr(chars, nth(i), F.lit(1))).otherwise(c)), "")
        return F.concat(put, F.substr(chars, F.size(F.filter(own, lambda c: c.rlike(marks))) + 1))  # a lengthened one runs on

    phone = F.when(F.startswith(e, F.lit("+")), F.replace(canon_surrogate, F.lit("|"), F.lit(""))).otherwise(F.substring_index(canon_surrogate, "|", -1))
    return (
        F.when(kind.isin("email", "ip6"), F.when((F.upper(e) == e) & (F.lower(e) != e), F.upper(canon_surrogate)).otherwise(canon_surrogate)).when(kind == "ip", canon_surrogate)
        .when(kind == "iban", filled(canon_surrogate, "[A-Z0-9]")).when(kind == "phone", filled(phone, r"\d")).otherwise(filled(canon_surrogate, r"\d"))
    )


#: Draws at most. From the eighth on a number gets one more digit each time and names and addresses grow before that, so
#: only addresses of a fixed form (IPv4, IPv6) can run out; that is an error, as distinct ones would have to merge.
MOST_DRAWS = 40


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate) of distinct entities (kind, canon), no surrogate twice and none an entity."""
    todo, taken, attempt = entities, None, 0
    while True:
        drawn = written(todo.select("kind", "canon", surrogate(key, F.col("kind"), F.col("canon"), attempt).alias("surrogate")), "drawn")
        first = drawn.groupBy("kind", "surrogate").agg(F.min("canon").alias("canon"))
        real = entities.select("kind", F.when(F.col("kind") == "given", F.substring_index("canon", "|", -1)).otherwise(F.col("canon")).alias("surrogate"))
        first = first.join(real, ["kind", "surrogate"], "left_anti")
        if taken is not None:
            first = first.join(taken, ["kind", "surrogate"], "left_anti")
        first = first.select("kind", "canon", "surrogate")
        taken = written(first if taken is None else taken.unionByName(first), "surrogates")
        todo = written(drawn.select("kind", "canon").join(taken, ["kind", "canon"], "left_anti"), "left")
        attempt += 1
        if todo.isEmpty():
            return taken
        if attempt == MOST_DRAWS:
            raise ValueError(f"no distinct surrogates are left: {todo.groupBy('kind').count().collect()}")


def parts_of(persons: DataFrame) -> DataFrame:
    """__row, __at, __place, word, kind (given or family), canon for each word of each person's name."""
    persons = persons.withColumn("gender", gender_of(F.col("entity")))
    stated = written(persons.groupBy("canon").agg(F.min("gender").alias("stated")).where("stated IS NOT NULL"), "stated")
    persons = hot_join(persons, stated, "canon").withColumn("gender", F.coalesce("gender", "stated", F.lit("x")))
    words = persons.select("__row", "__at", "gender", F.split("canon", " ").alias("words")).select("__row", "__at", "gender", F.size("words").alias("n"), F.posexplode("words").alias("__place", "word"))
    family = F.col("__place") == F.col("n") - 1
    return words.select("__row", "__at", "__place", "word", F.when(family, "family").otherwise("given").alias("kind"), F.when(family, F.col("word")).otherwise(F.concat_ws("|", "gender", "word")).alias("canon"))


def _cased(like: Column, word: Column) -> Column:
    return F.when((F.length(like) > 1) & (F.upper(like) == like), F.upper(word)).otherwise(F.initcap(word))


def _between(text: Column, words: Column, pattern: str, new) -> Column:
    """The text with its i-th match of the pattern, words[i], replaced by new(words[i], i)."""
    gaps = F.split(text, pattern, -1)
    return F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.when(i < F.size(words), new(F.get(words, i), i)).otherwise(""))), "")


def named(e: Column, at: Column, parts: Column) -> Column:
    """A titled mention with its words replaced by the parts (by "at,place"); title and particles stay as they are."""
    pattern = rf"{_WORD}|(?<!\p{{L}})\p{{Lu}}(?!\p{{L}})\.?"
    title = F.regexp_extract(e, rf"^({_TITLED} )", 1)
    name = F.substr(e, F.length(title) + 1)
    words = F.regexp_extract_all(name, F.lit(pattern), 0)
    return F.concat(title, _between(name, words, pattern, lambda w, i: _cased(F.regexp_replace(w, r"\.$", ""), F.try_element_at(parts, F.concat_ws(",", at, i)))))


def mentioned_again(gap: Column, names: Column) -> Column:
    """(text, n): what stands between entities with capitalised words of the names (kind, word, surrogate) replaced."""
    pattern = rf"(?<!\p{{L}}){_WORD}"
    words = F.regexp_extract_all(gap, F.lit(pattern), 0)
    of = lambda w: F.get(F.filter(names, lambda x: x["word"] == F.lower(w)), F.lit(0))["surrogate"]
    text = _between(gap, words, pattern, lambda w, i: F.coalesce(_cased(w, of(w)), w))
    return F.struct(text.alias("text"), F.size(F.filter(words, lambda w: of(w).isNotNull())).alias("n"))


def replace_pii(docs: DataFrame, key: str, counts: bool = False) -> DataFrame:
    """docs with the entities in text replaced under a secret key; counts adds n_entities, in place of any input column of that name."""
    if counts:
        docs = docs.drop("n_entities")
    columns = docs.columns
    hinted = F.coalesce(F.col("text").rlike(HINT), F.lit(False))
    some = docs.where(hinted).select(F.monotonically_increasing_id().alias("__row"), F.struct(*[F.col(f"`{c}`") for c in columns]).alias("__doc"), F.regexp_extract_all("text", F.lit(ENTITY), 0).alias("__found"), F.split("text", ENTITY, -1).alias("__gaps"))
    some = written(some, "hinted")
    mentions = some.select("__row", F.posexplode("__found").alias("__at", "entity")).withColumn("kind", kind_of(F.col("entity")))
    mentions = written(mentions.withColumn("canon", canonical(F.col("kind"), F.col("entity"))), "mentions")
    parts = written(parts_of(mentions.where("kind = 'person'")), "parts")
    simple = mentions.where("kind <> 'person'")
    entities = simple.select("kind", "canon").unionByName(parts.select("kind", "canon")).distinct()
    table = surrogates(written(entities, "entities"), key)
    # An address that every page states is one key with many rows.
    made = hot_join(simple, table, ["kind", "canon"], "inner").select("__row", "__at", render(F.col("kind"), F.col("entity"), F.col("surrogate")).alias("__new"))
    made = made.groupBy("__row").agg(F.sort_array(F.collect_list(F.struct("__at", "__new"))).alias("__simple"))
    # By mention and place in it, and the same words for the rest of the document: the family name goes before a given one.
    drawn = hot_join(parts, table, ["kind", "canon"], "inner").select("__row", "__at", "__place", "kind", "word", "surrogate")
    drawn = drawn.groupBy("__row").agg(
        F.collect_list(F.struct("__at", "__place", "surrogate")).alias("__parts"),
        F.array_sort(F.collect_set(F.when(F.length("word") > 1, F.struct("kind", "word", "surrogate")))).alias("__names"),
    )
    both = some.join(made, "__row", "left").join(drawn, "__row", "left")
    simple_at = F.map_from_entries(F.coalesce("__simple", F.expr("array()").cast("array<struct<__at:int,__new:string>>")))
    parts_at = F.map_from_entries(F.transform("__parts", lambda p: F.struct(F.concat_ws(",", p["__at"], p["__place"]), p["surrogate"])))
    both = both.withColumns({"__simple_at": simple_at, "__parts_at": parts_at})
    gaps = F.when(F.col("__names").isNull(), F.transform("__gaps", lambda g: F.struct(g.alias("text"), F.lit(0).alias("n")))).otherwise(F.transform("__gaps", lambda g: mentioned_again(g, F.col("__names"))))
    both = both.withColumn("__gaps", gaps)
    filled = lambda i: F.coalesce(F.try_element_at("__simple_at", i), named(F.get("__found", i), i, F.col("__parts_at")), F.lit(""))
    text = F.array_join(F.transform("__gaps", lambda gap, i: F.concat(gap["text"], F.when(i < F.size("__found"), filled(i)).otherwise(""))), "")
    again = F.aggregate("__gaps", F.lit(0), lambda n, g: n + g["n"])
    done = both.select("__doc", F.when(F.size("__found") == 0, F.col("__doc")["text"]).otherwise(text).alias("__text"), (F.size("__found") + again).cast("long").alias("__n"))
    extra = [F.col("__n").alias("n_entities")] if counts else []
    done = done.select(*[F.col("__text").alias(c) if c == "text" else F.col(f"__doc.`{c}`").alias(c) for c in columns], *extra)
    plain = docs.where(~hinted)
    return (plain.withColumn("n_entities", F.lit(0).cast("long")) if counts else plain).unionByName(done)

