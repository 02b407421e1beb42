r"""Personal data replaced by keyed surrogates of the same kind.

Entities are found by one pattern and brought to a canonical unit: an address in lower case, the
digits of a number, a name without its title.  A unit's surrogate is drawn from a keyed hash of it,
so that every mention of one person, number or address gets the same surrogate, whatever its
spelling, and keeps what makes its kind: the lengths, letters, digits and marks of the original, the
check digit of cards, the script and gender of names.  Surrogates are checked for collisions with
each other and with the originals of the corpus and redrawn until none is left.

Everything is a DataFrame operation; units are distinct rows, and mentions find their surrogate by a
join, so an entity that a third of all rows mention is one unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessella.llm.store import looked_up, persist

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}(?![\p{L}\p{N}])"
IP = r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d|\w)"
#: Eight groups, or fewer around one ``::``; a digit somewhere, so that no word is taken for one.
IP6 = r"(?<![\w:.])(?=[0-9A-Fa-f:]*\d)(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6}|::(?:[0-9A-Fa-f]{1,4}:){0,6}[0-9A-Fa-f]{1,4})(?![\w:])"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
CARD = r"(?<![\w-])\d(?:[ -]?\d){12,18}(?![\w-])"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?|1[ .-])?(?:\(\d{2,4}\)|(?<=[ .-])\d{2,4}|\d{3})[ .-]?\d{3,4}[ .-]\d{3,4}(?![\w-])"
#: International numbers of 7 to 15 digits in any groups, and national ones after a 0 in two groups at least.
WORLD = r"(?<![\w+])\+\d{1,3}(?:[ ./-]?\(?\d{1,12}\)?){1,6}(?![\w-])"
TRUNK = r"(?<![\w.+-])\(?0\d{2,4}\)?[ /-]\d{3,8}(?:[ -]\d{2,6}){0,3}(?![\w-])"
SECRET = r"(?<!\w)(?:AKIA[0-9A-Z]{16}(?!\w)|(?i:password|passwd|pwd|token|secret|api_?key)\s{0,3}[=:]\s{0,3}\x22?[^\s\x22<>]{7,}[^\s\x22<>.,;:)])"
TITLES_M = "Mr|Herr|Herrn|Señor|Monsieur|Sir|г-н|Κύριος"
TITLES_F = "Mrs|Ms|Miss|Frau|Señora|Señorita|Madame|Mademoiselle|г-жа|Κυρία"
#: A name's word without a genitive's 's; repeats of it are possessive, which Java matches without recursion.
WORD = r"\p{Lu}[\p{L}\p{M}'’-]*[\p{L}\p{M}](?<!['’]s)(?![\p{L}\p{M}])"
PART = rf"(?:\p{{Lu}}\.(?= \p{{Lu}})|{WORD})"
TITLE = rf"(?:{TITLES_M}|{TITLES_F}|Dr|Prof)\.? "
NAME = rf"(?<!\p{{L}})(?:{TITLE})++{PART}(?: {PART})*+"
PATTERN = "|".join(f"(?:{p})" for p in (EMAIL, SECRET, IP, IP6, SSN, CARD, PHONE, WORLD, TRUNK, NAME))

#: Given names by script and gender, and syllables of family names by script.
GIVEN = {
    "latin": {"m": "Adam Boris Carlo David Emil Felix Gustav Hugo Ivan Jonas Karl Leo Marco Nils Oscar Paul".split(), "f": "Anna Bella Clara Diana Emma Flora Greta Helena Irina Julia Klara Lena Maria Nina Olga Paula".split()},
    "cyrillic": {"m": "Иван Пётр Олег Борис Антон Денис Максим Роман".split(), "f": "Анна Ольга Мария Елена Ирина Дарья Вера Нина".split()},
    "greek": {"m": "Νίκος Πέτρος Γιάννης Μάρκος".split(), "f": "Μαρία Άννα Ελένη Σοφία".split()},
}
SYLLABLES = {
    "latin": "ba be do fa ga hol ka ler lin ma mer nor pa rin sel ta ven vor wes zan".split(),
    "cyrillic": "ба во га ден жи ка лов ма нев по ров са та хов чен".split(),
    "greek": "βα γα δη κα λο μα νι πα ρη σα τα χα".split(),
}
#: Letters that stand for those of a script.
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
#: From this attempt on a unit's surrogate has a character more at each attempt, so that no pool runs out.
WIDER = 3


def _lit(values: list[str]) -> Column:
    return F.array(*map(F.lit, values))


def kind(value: Column) -> Column:
    """What an entity is; null for what only looks like one."""
    digits = F.regexp_replace(value, r"\D", "")
    return (
        F.when(value.rlike(rf"^(?:{SECRET})$"), "secret")
        .when(value.contains("@"), "email")
        .when(value.rlike(rf"^(?:\d+\.\d+\.\d+\.\d+|{IP6})$"), "ip")
        .when(value.rlike(r"^\p{L}"), "name")
        .when(value.rlike(r"^\d{3}-\d{2}-\d{4}$"), "ssn")
        .when(value.rlike(r"^\d(?:[ -]?\d){12,18}$"), F.when(luhn(digits) == 0, "card"))
        .when((F.length(digits) >= 7) & (F.length(digits) <= 15), "phone")
    )


def luhn(digits: Column) -> Column:
    """The Luhn sum of a string of digits, mod 10."""
    at = F.sequence(F.lit(1), F.length(digits))

    def term(i: Column) -> Column:
        d = F.ascii(F.substr(F.reverse(digits), i, F.lit(1))) - 48
        return F.when(i % 2 == 1, d).when(d > 4, 2 * d - 9).otherwise(2 * d)

    return F.when(F.length(digits) > 0, F.aggregate(F.transform(at, term), F.lit(0), lambda a, x: a + x) % 10)


def _title(value: Column) -> Column:
    """All titles before a name."""
    return F.regexp_extract(value, rf"^((?:{TITLE})+)", 1)


def _name_words(value: Column) -> Column:
    return F.split(F.substr(value, F.length(_title(value)) + 1, F.length(value)), " ")


def _gender(value: Column) -> Column:
    title = _title(value)
    has = lambda titles: title.rlike(rf"(?:^| )(?:{titles})\.? ")
    return F.when(has(TITLES_M), "m").when(has(TITLES_F), "f").otherwise("x")


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")


def _national(digits: Column) -> Column:
    """Digits of a number without the 1 that some write before ten others."""
    return F.regexp_replace(digits, r"^1(?=\d{10}$)", "")


def units(value: Column, of: Column) -> Column:
    """array<struct<kind, canon, given, gender>>: the units of an entity.

    Each word of a name is a unit; given is whether others follow it, gender what the title says.
    """
    digits, words, gender = F.regexp_replace(value, r"\D", ""), _name_words(value), _gender(value)

    def word(x: Column, i: Column) -> Column:
        what = F.when(x.endswith("."), "initial").otherwise("name")
        return F.struct(what.alias("kind"), F.lower(x).alias("canon"), (i < F.size(words) - 1).alias("given"), gender.alias("gender"))

    one = lambda c: F.array(F.struct(of.alias("kind"), c.alias("canon"), F.lit(False).alias("given"), F.lit("x").alias("gender")))
    return (
        F.when(of == "name", F.transform(words, word))
        .when(of == "email", one(F.lower(value)))
        .when(of == "ip", one(F.lower(value)))
        .when(of == "secret", one(_secret(value)))
        .when(of == "phone", one(_national(digits)))
        .otherwise(one(digits))
    )


def _secret(value: Column) -> Column:
    """A secret without the words before it."""
    return F.regexp_replace(value, r"^(?:AKIA|\w+\s{0,3}[=:]\s{0,3}\x22?)", "")


def _byte(seed: Column, i: Column) -> Column:
    """A number from 0 to 255 for place i (from 1), from the hash of the seed and the place's block."""
    block = F.floor((i - 1) / 64).cast("string")
    return F.conv(F.substr(F.sha2(F.concat_ws(":", seed, block), 512), ((i - 1) % 64) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _letter(c: Column, b: Column) -> Column:
    """A small letter of the script of the letter c."""
    pick = lambda s: F.substr(F.lit(LETTERS[s]), b % len(LETTERS[s]) + 1, F.lit(1))
    return F.when(c.rlike(r"^\p{IsCyrillic}"), pick("cyrillic")).when(c.rlike(r"^\p{IsGreek}"), pick("greek")).otherwise(pick("latin"))


def _like(text: Column, seed: Column, loose: Column | None = None) -> Column:
    """Random text of the same shape: letters for letters in their case and script (of scripts other
    than Latin, Cyrillic and Greek: Latin ones), digits for digits; where ``loose`` holds, letters
    for marks too."""
    loose = F.lit(False) if loose is None else loose

    def one(i: Column) -> Column:
        c, b = F.substr(text, i, F.lit(1)), _byte(seed, i)
        return (
            F.when(c.rlike("[0-9]"), (b % 10).cast("string"))
            .when(c.rlike(r"\p{Lu}"), F.upper(_letter(c, b)))
            .when(c.rlike(r"\p{L}"), _letter(c, b))
            .when(loose, F.char(97 + b % 26))
            .otherwise(c)
        )

    return F.when(F.length(text) > 0, F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), one), "")).otherwise("")


def drawn(units: DataFrame, attempt: int, key: str) -> DataFrame:
    """``units`` (kind, canon, given, gender) with their surrogates at an attempt, in canonical form.

    From the attempt WIDER on, surrogates have more characters at each attempt.
    """
    wider = max(0, attempt - WIDER + 1)
    seed = F.sha2(F.concat_ws("|", F.lit(key), "kind", "canon", F.lit(str(attempt))), 256)
    rows = units.withColumn("seed", seed).withColumn("bytes", F.transform(F.sequence(F.lit(1), F.lit(64 + 3 * wider)), lambda i: _byte(F.col("seed"), i)))
    of, canon, gender, seed = (F.col(c) for c in ("kind", "canon", "gender", "seed"))
    b = lambda i: F.col("bytes")[i]
    like = _like(canon, seed, (of == "secret") & F.lit(wider > 0))
    more = F.slice("bytes", 65, wider) if wider else F.array().cast("array<int>")
    letters = F.array_join(F.transform(more, lambda x: F.char(97 + x % 26)), "")
    digits = F.array_join(F.transform(more, lambda x: (x % 10).cast("string")), "")
    local, n = F.substring_index(canon, "@", 1), F.length(canon)
    email = F.concat(_like(local, seed), letters, F.lit("@mail"), (b(60) % 10).cast("string"), F.lit(".example."), F.element_at(_lit(["com", "org", "net"]), b(61) % 3 + 1))
    # 2001:db8::/32 is for documentation.
    hexes = F.array_join(F.transform(F.sequence(F.lit(5), F.lit(10)), lambda i: F.lower(F.hex(F.element_at("bytes", i) * 256 + F.element_at("bytes", i + 6)))), ":")
    ip6 = F.concat(F.lit("2001:db8:"), hexes)
    ip = F.concat_ws(".", (240 + b(1) % 16).cast("string"), b(2).cast("string"), b(3).cast("string"), b(4).cast("string"), *([digits] if wider else []))
    # 0 is the first digit of no area or group, so that these numbers are nobody's.
    ssn = F.concat(F.lit("9"), F.substring(like, 2, 20), digits)
    body = F.concat(F.substring(canon, 1, 1), F.substr(like, F.lit(2), n - 2), digits)
    card = F.concat(body, ((10 - luhn(F.concat(body, F.lit("0")))) % 10).cast("string"))
    # The country code of a long number stays.
    phone = F.when(canon.startswith("0"), F.concat(F.lit("0"), F.substring(like, 2, 20), digits)).when(n > 10, F.concat(F.substr(canon, F.lit(1), n - 10), F.substr(like, n - 9, F.lit(10)), digits)).otherwise(F.concat(like, digits))
    # Names: words of the script and, for given ones, the gender; two where the original has two parts.
    of_script = lambda make: F.when(_script(canon) == "cyrillic", make("cyrillic")).when(_script(canon) == "greek", make("greek")).otherwise(make("latin"))
    syllables = of_script(lambda s: _lit(SYLLABLES[s]))
    first = of_script(lambda s: F.when(gender == "m", _lit(GIVEN[s]["m"])).when(gender == "f", _lit(GIVEN[s]["f"])).otherwise(_lit(GIVEN[s]["m"] + GIVEN[s]["f"])))
    spoken = lambda bytes_: F.array_join(F.transform(bytes_, lambda x: F.element_at(syllables, x % F.size(syllables) + 1)), "")
    name = lambda at: F.when(F.col("given"), F.lower(F.element_at(first, b(at) % F.size(first) + 1))).otherwise(spoken(F.slice("bytes", at + 1, 3)))
    # Syllables keep units apart when there are more of them than names.
    name = F.concat(name(1), F.when(canon.contains("-"), F.concat(F.lit("-"), name(30))).otherwise(""), spoken(more))
    surrogate = (
        F.when(of == "email", email).when((of == "ip") & canon.contains(":"), ip6).when(of == "ip", ip).when(of == "ssn", ssn).when(of == "card", card).when(of == "phone", phone)
        .when(of == "name", name).when(of == "initial", like).otherwise(F.concat(like, letters))
    )
    return rows.withColumn("surrogate", surrogate).drop("seed", "bytes")


def assign(distinct: DataFrame, key: str) -> DataFrame:
    """(kind, canon, surrogate): a surrogate of its own for each unit, none of them an original.

    ``distinct``: kind, canon, given, gender.  Of units that draw the same, the one of the smallest
    canonical form keeps it; the others, and those that draw a unit of the corpus, draw again, from
    the third time on from a pool that grows each time, so the rounds come to an end.  Initials are
    too few to be kept apart.
    """
    # A number of partitions that is asked for is not coalesced: drawing is work.
    tasks = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    unit = ["kind", "canon", "given", "gender"]
    dealt = persist(distinct.select(*unit).repartition(tasks, "kind", "canon"), "units")
    settled = None
    now = persist(drawn(dealt, 0, key), "surrogates")
    originals = dealt.select("kind", F.col("canon").alias("surrogate"), F.lit(True).alias("real"))
    attempt = 0
    while True:
        # Those that have kept theirs come before all others.
        every = now.withColumn("old", F.lit(1))
        if settled is not None:
            every = every.unionByName(settled.withColumn("old", F.lit(0)))
        first = every.groupBy("kind", "surrogate").agg(F.min(F.struct("old", "canon")).alias("first"))
        judged = now.join(first, ["kind", "surrogate"]).join(originals, ["kind", "surrogate"], "left")
        clash = (F.col("kind") != "initial") & ((F.col("first.old") == 0) | (F.col("first.canon") != F.col("canon")) | F.col("real").isNotNull())
        judged = persist(judged.select(*unit, "surrogate", clash.alias("clash")), "judged")
        fine = judged.filter("NOT clash").drop("clash")
        settled = fine if settled is None else settled.unionByName(fine)
        left = judged.filter("clash")
        if left.isEmpty():
            return settled.select("kind", "canon", "surrogate")
        attempt += 1
        now = persist(drawn(left.select(*unit), attempt, key), "surrogates")


def _fill(value: Column, surrogate: Column) -> Column:
    """The digits of a surrogate in the places of the digits of an entity; further ones at its end."""
    at = F.sequence(F.lit(1), F.length(value))
    chars = F.transform(at, lambda i: F.substr(value, i, F.lit(1)))
    walked = F.aggregate(
        chars,
        F.struct(F.lit(1).alias("n"), F.lit("").alias("out")),
        lambda acc, c: F.when(
            c.rlike("[0-9]"), F.struct((acc["n"] + 1).alias("n"), F.concat(acc["out"], F.substr(surrogate, acc["n"], F.lit(1))).alias("out"))
        ).otherwise(F.struct(acc["n"].alias("n"), F.concat(acc["out"], c).alias("out"))),
    )
    return F.concat(walked["out"], F.substr(surrogate, walked["n"], F.length(surrogate)))


def _as(original: Column, name: Column) -> Column:
    """A name with capitals where the original has them: all letters, or the first of each part."""
    parts = F.transform(F.split(name, "-"), lambda x: F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, 2, 1000)))
    return F.when((F.upper(original) == original) & (F.length(original) > 2), F.upper(name)).otherwise(F.array_join(parts, "-"))


def _written(value: Column, of: Column, drawn: Column) -> Column:
    """A mention's replacement; drawn: the surrogates of its units in order."""
    digits = F.regexp_replace(value, r"\D", "")
    return (
        F.when(of == "name", F.concat(_title(value), F.array_join(F.zip_with(_name_words(value), drawn, _as), " ")))
        .when(of.isin("email", "ip"), drawn[0])
        .when(of == "secret", F.concat(F.substr(value, F.lit(1), F.length(value) - F.length(_secret(value))), drawn[0]))
        .when(digits != _national(digits), F.when(of == "phone", _fill(value, F.concat(F.lit("1"), drawn[0]))).otherwise(_fill(value, drawn[0])))
        .otherwise(_fill(value, drawn[0]))
    )


def _bare(text: Column, known: Column) -> Column:
    """Text with the words that ``known`` has replaced, where they begin with a capital."""
    bare = rf"(?<![\p{{L}}\p{{M}}]){WORD}"
    new = F.transform(F.regexp_extract_all(text, F.lit(bare), F.lit(0)), lambda x: F.coalesce(_as(x, F.element_at(known, F.lower(x))), x))
    return F.array_join(F.flatten(F.zip_with(F.split(text, bare, -1), new, lambda g, x: F.array(g, F.coalesce(x, F.lit(""))))), "")


def replace(docs: DataFrame, key: str) -> DataFrame:
    """doc_id, text, n_entities, kinds of every row of ``docs`` (doc_id, text), personal data replaced.

    ``key`` is the secret that surrogates are drawn with: equal keys give equal surrogates.  Found
    are e-mail addresses, telephone numbers (North American ones, international ones after a + and
    national ones after a 0) and social security numbers, cards with a valid check digit, IPv4 and
    IPv6 addresses, secrets (keys, passwords, tokens) and names after one or more titles, whose words
    are replaced in the rest of the row too (n_entities does not count those).  kinds holds the kinds
    found, sorted.  E-mail surrogates are in example domains, IPv4 ones in the reserved
    block 240.0.0.0/4 and IPv6 ones in 2001:db8::/32, so none reaches anybody.  Spellings of one IPv6
    address with and without ``::`` are two units, as are a number with and without its country code.

    A word of a name has one surrogate in the whole corpus.  It is a given name if others follow it
    anywhere; its gender is that which most of the different titled names with it have.

    A null text stays null and an empty one empty, both with no entities, as do texts without
    personal data, unchanged.  Repeated rows each give the same row; a row with a null doc_id is
    treated like any other.  Very long texts are read whole.  An empty table gives no rows.  Other
    columns are not read.

    Every row is written once with what was found in it.  Rows without a mention go from there to
    the result; only the others are joined with their replacements.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text", F.regexp_extract_all("text", F.lit(PATTERN), F.lit(0)).alias("found"))
    rows = persist(rows.withColumn("some", F.coalesce(F.size("found") > 0, F.lit(False))), "found")
    found = rows.filter("some").select("row", "found")
    values = found.select(F.explode("found").alias("value")).distinct()
    values = values.withColumn("kind", kind(F.col("value")))
    values = persist(values.filter("kind IS NOT NULL").withColumn("units", units(F.col("value"), F.col("kind"))), "values")
    each = values.select("value", F.posexplode("units").alias("place", "u")).select("value", "place", "u.*")
    vote = lambda g: F.sum(F.when(F.col("gender") == g, 1).otherwise(0))
    settled = each.groupBy("kind", "canon").agg(F.max("given").alias("given"), vote("m").alias("m"), vote("f").alias("f"))
    settled = settled.withColumn("gender", F.when(F.col("m") > F.col("f"), "m").when(F.col("f") > F.col("m"), "f").otherwise("x"))
    named = each.select("value", "place", "kind", "canon").join(persist(assign(settled, key), "assigned"), ["kind", "canon"])
    named = named.groupBy("value").agg(F.array_sort(F.collect_list(F.struct("place", "surrogate", "canon"))).alias("drawn"))  # one for each word
    written = values.select("value", "kind").join(named, "value")
    # Words of a name that may stand without its title; initials are too common.
    names = F.transform(F.filter("drawn", lambda d: ~d["canon"].endswith(".")), lambda d: F.struct(d["canon"].alias("canon"), d["surrogate"].alias("surrogate")))
    written = written.withColumn("words", F.when(F.col("kind") == "name", names))
    written = persist(written.select("value", "kind", _written(F.col("value"), F.col("kind"), F.col("drawn.surrogate")).alias("new"), "words"), "written")

    each = persist(found.select("row", F.posexplode("found").alias("place", "value")), "each")
    often = each.groupBy("value").agg(F.count(F.lit(1)).alias("n"))
    # An entity that many rows mention finds its replacement in a broadcast.
    table = persist(often.join(written, "value", "left"), "often")
    mentions = looked_up(each, table, ["value"], "n", "left")
    mentions = mentions.groupBy("row").agg(
        F.array_sort(F.collect_list(F.struct("place", F.coalesce("new", "value").alias("new")))).alias("m"),
        F.count("kind").alias("n"), F.array_sort(F.collect_set("kind")).alias("kinds"), F.array_distinct(F.flatten(F.collect_list("words"))).alias("words"),
    )
    mentions = persist(mentions.select("row", F.col("m.new").alias("new"), "n", "kinds", F.map_from_entries("words").alias("known")), "mentions")
    joined = rows.filter("some").select("row", "doc_id", "text").join(mentions.hint("merge"), "row")
    gaps = F.when(F.size("known") > 0, F.transform(F.split("text", PATTERN, -1), lambda g: _bare(g, F.col("known")))).otherwise(F.split("text", PATTERN, -1))
    text = F.array_join(F.flatten(F.zip_with(gaps, "new", lambda g, x: F.array(g, F.coalesce(x, F.lit(""))))), "")
    joined = joined.select("doc_id", F.when(F.col("n") > 0, text).otherwise(F.col("text")).alias("text"), F.col("n").alias("n_entities"), "kinds")
    plain = rows.filter("NOT some").select("doc_id", "text", F.lit(0).cast("long").alias("n_entities"), F.array().cast("array<string>").alias("kinds"))
    return joined.unionByName(plain)
