"""PII surrogates: keyed, type-consistent replacements with corpus-wide collision checks (native DataFrame operations).

Entities are found in whole texts and brought to a canonical form (lower-cased mail, bare digits, a name without its title).
A person counts as two parts, given name and surname, so that people who share one go on sharing one. The distinct values of
the corpus get ranks within their format in an order that the key decides, and a rank is written as a value of
that format by a numbering that repeats nothing: distinct entities stay distinct however many there are, and every mention of one
gets the same surrogate. Where a value is somebody's real one, a spare number takes its place.
"""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, salted_rank, shielded, spread

TITLES = {
    "f": "Mrs|Ms|Miss|Frau|Señora|Madame|Mme|Signora|Госпожа|Κυρία", "m": "Mr|Herr|Señor|Monsieur|Signor|Господин|Κύριος",
    "n": "Dr|Prof|Доктор|Профессор",
}
#: Given names by script and gender: found when a capitalised surname follows, and exchanged among themselves.
GIVEN = {
    "latin": {
        "f": "Anna Maria Laura Julia Sophie Clara Elena Emma Alice Helen Martha Nora Paula Rosa Susan Teresa Irene Lucy Diana Judith".split(),
        "m": "John Peter Paul Thomas Martin David Daniel Simon Robert Frank Hugo Oscar Victor Walter George Henry Louis Philip Stephen Adrian".split(),
    },
    "cyrillic": {
        "f": "Анна Мария Елена Ольга Татьяна Ирина Наталья Светлана Юлия Вера".split(),
        "m": "Иван Пётр Павел Сергей Андрей Дмитрий Алексей Николай Борис Виктор".split(),
    },
    "greek": {"f": "Άννα Μαρία Ελένη Κατερίνα Σοφία".split(), "m": "Γιώργος Νίκος Πέτρος Ανδρέας Παύλος".split()},
}
#: What tells a script; any other counts as Latin.
SCRIPTS = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}"}
#: Twenty syllables a script; none begins another, so a row of them reads one way only.
SYLLABLES = {
    "latin": "ba de ki lo mu na pe ri so tu va we bel dor kan lin mor ner sal ton".split(),
    "cyrillic": "ба де ки ло му на пе ри со ту ва вел дор кан лин мор нер сал тон зор".split(),
    "greek": "βα δε κι λο μυ να πε ρι σο τυ φα βελ δορ καν λιν μορ νερ σαλ τον ζορ".split(),
}
ENDINGS = {"latin": "son er ell ing ard ley man ton".split(), "cyrillic": "ин ский енко чук".split(), "greek": "ης ος ίδης άκης".split()}
GIVEN_ENDINGS = {"latin": {"f": "ia", "m": "us", "n": "el"}, "cyrillic": {"f": "ия", "m": "ов", "n": "ей"}, "greek": {"f": "ία", "m": "ος", "n": "ις"}}

_NAME = r"\p{Lu}[\p{Ll}]+(?:-\p{Lu}\p{Ll}+)?"
_LISTED = "|".join(n for s in GIVEN.values() for g in s.values() for n in g)
_TITLED = "|".join(TITLES.values())
_S = "[ .-]"


def _groups(first: str) -> str:
    """Three or four groups of two to four digits, nine digits at least; ``first`` writes the first group of the given length."""
    g = r"\d{2,4}"
    three = "|".join(f"{first % a}{_S}\\d{{{b}}}{_S}\\d{{{max(2, 9 - a - b)},4}}" for a in (2, 3, 4) for b in (2, 3, 4) if a + b >= 5)
    four = f"(?!{first % '2'}{_S}\\d{{2}}{_S}\\d{{2}}{_S}\\d{{2}}(?!\\d)){first % '2,4'}{_S}{g}{_S}{g}{_S}{g}"
    return f"{four}|{three}"


#: Entity patterns in order of preference at one place; Java syntax, no capturing groups. A phone without + has nine digits or more, and is no date.
PATTERNS = {
    "email": r"(?<![\p{L}\w.+%-])[\p{L}\d][\p{L}\w.%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\w|\.\d)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "card": r"(?<![\w-])(?!\d{4}-\d{2}-\d{2}(?!\d))\d(?:[ -]?\d){12,18}(?![\w-])",
    "phone": r"(?<![\w+]|\d-)(?!\d{4}-\d{2}-\d{2}(?!\d))(?:"
    + rf"\+\d{{1,3}}[ .-]?(?:\(\d{{2,4}}\)[ .-]?|\d{{2,4}}[ .-])\d{{2,4}}[ .-]\d{{2,4}}(?:[ .-]\d{{2,4}})?|\(\d{{2,4}}\)[ .-]?(?:\d{{3}}[ .-]\d{{4}}|\d{{4}}[ .-]\d{{3,4}}|\d{{2,4}}[ .-]\d{{2,4}}[ .-]\d{{3,4}})|{_groups(chr(92) + 'd{%s}')}|\+\d{{8,15}})(?!\w)",
    "person": rf"(?=\p{{Lu}})(?<!\p{{L}})(?:(?:{_TITLED})\.?\x20(?:{_NAME}\x20)?{_NAME}|(?:{_LISTED})\x20{_NAME}|(?<=(?:[Mm]y name is|[Nn]ame:|[Ss]igned by)\x20){_NAME}\x20{_NAME})(?!\p{{L}})",
}
#: One capturing group a kind. No entity begins inside a word, where most places are; they fail at once.
ANY = "(?<!\\p{{L}})(?:({email})|(?=[\\d+(])(?:({ip})|({ssn})|({card})|({phone}))|({person}))".format(**PATTERNS)
KEY = "lodeframe-surrogates"
ENTITY = "array<struct<raw:string,kind:string,canon:string>>"
#: A prime that shares no factor with any base below: multiples of it run through all numbers before they repeat.
STEP = 1_000_003


def _once(value: Column, use) -> Column:
    """``use(value)`` with ``value`` worked out once a row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def canonical(kind: Column, raw: Column) -> Column:
    """The form that all mentions of one entity share. Persons carry the gender that their title or given name shows, n for none."""
    gender = F.when(raw.rlike(rf"^(?:{TITLES['f']})\b"), F.lit("f")).when(raw.rlike(rf"^(?:{TITLES['m']})\b"), F.lit("m"))
    for g in ("f", "m"):
        gender = gender.when(raw.rlike(rf"^(?:(?:{TITLES['n']})\.?\x20)?(?:{'|'.join(n for s in GIVEN.values() for n in s[g])})\x20"), F.lit(g))
    name = F.concat(gender.otherwise(F.lit("n")), F.lit(":"), F.regexp_replace(raw, rf"^(?:{_TITLED})\.?\x20", ""))
    return F.when(kind == "email", F.lower(raw)).when(kind == "ip", raw).when(kind == "person", name).otherwise(F.regexp_replace(raw, r"\D", ""))


def _escaped(text: Column) -> Column:
    """Marks are control characters, so a text's own ones step aside; no pattern tells one control character from another."""
    done = F.replace(F.replace(F.replace(text, F.lit("\x03"), F.lit("\x03\x04")), F.lit("\x01"), F.lit("\x03\x05")), F.lit("\x02"), F.lit("\x03\x06"))
    return F.when(text.rlike("[\x01-\x03]"), done).otherwise(text)


def _restored(text: Column) -> Column:
    done = F.replace(F.replace(F.replace(text, F.lit("\x03\x05"), F.lit("\x01")), F.lit("\x03\x06"), F.lit("\x02")), F.lit("\x03\x04"), F.lit("\x03"))
    return F.when(text.contains("\x03"), done).otherwise(text)


def found(text: Column) -> Column:
    """struct(plain, e): the pieces between the matches of a text, and its entities (raw, kind, canon) in order; null without any.

    The text is scanned once: each match is marked with the groups of its alternatives, and the one that isn't empty is its kind.
    """
    marks = "\x01" + "\x02".join(f"${k + 1}" for k in range(len(PATTERNS))) + "\x01"

    def entity(mark: Column) -> Column:
        # as many separators stand before a match as there are kinds before its own
        kind = F.get(_of(list(PATTERNS)), F.length(mark) - F.length(F.ltrim(mark, F.lit("\x02"))))
        both = F.struct(F.replace(mark, F.lit("\x02"), F.lit("")).alias("raw"), kind.alias("kind"))
        return _once(both, lambda x: F.struct(x["raw"].alias("raw"), x["kind"].alias("kind"), canonical(x["kind"], x["raw"]).alias("canon")))

    def parsed(tagged: Column) -> Column:
        both = lambda p: F.struct(
            F.filter(p, lambda x, i: i % 2 == 0).alias("plain"), F.transform(F.filter(p, lambda x, i: i % 2 == 1), entity).cast(ENTITY).alias("e"))
        return F.when(tagged.contains("\x01"), _once(F.split(tagged, "\x01", -1), both))

    return _once(F.regexp_replace(_escaped(text), ANY, marks), parsed)


def entities(text: Column) -> Column:
    """Array of struct(raw, kind, canon) of the matches of a text, in order."""
    return F.coalesce(found(text)["e"], F.array().cast(ENTITY))


def _script(name: Column) -> Column:
    out = F.lit("latin")
    for s, pattern in SCRIPTS.items():
        out = F.when(name.rlike(pattern), F.lit(s)).otherwise(out)
    return out


def parts(e: Column) -> Column:
    """The two values of an entity that are looked up, as structs (part, value): a given name that isn't listed or null, then the rest."""
    name = F.substring_index(e["canon"], ":", -1)
    script, gender, given = _script(name), F.substring(e["canon"], 1, 1), F.when(F.instr(name, " ") > 0, F.substring_index(name, " ", 1))
    other = (e["kind"] == "person") & given.isNotNull() & ~given.rlike(rf"^(?:{_LISTED})$")
    first = F.struct(F.when(other, F.concat_ws(":", F.lit("given"), script, gender)).alias("part"), F.when(other, given).alias("value"))
    person = e["kind"] == "person"
    return F.array(first, F.struct(F.when(person, F.concat(F.lit("surname:"), script)).otherwise(e["kind"]).alias("part"), F.when(person, F.substring_index(name, " ", -1)).otherwise(e["canon"]).alias("value")))


def _pick(h: Column, i, n: int) -> Column:
    return F.pmod(F.xxhash64(h, i if isinstance(i, Column) else F.lit(i)), F.lit(n)).cast("int")


def _luhn(digits: Column) -> Column:
    """The check digit that follows ``digits``."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int") * 2 - F.when(c >= "5", F.lit(9)).otherwise(F.lit(0))).otherwise(c.cast("int")))
    return (10 - F.aggregate(F.filter(each, lambda x: x.isNotNull()), F.lit(0), lambda a, x: a + x) % 10) % 10


def _valid(card: Column) -> Column:
    return F.substring(card, -1, 1) == _luhn(F.substring(card, F.lit(1), F.length(card) - 1)).cast("string")


def _lead(part: Column, value: Column) -> Column:
    """How many first digits stay: they tell the scheme or the country."""
    return F.when(part == "card", F.lit(1)).when(part == "phone", F.greatest(F.length(value) - 10, F.lit(0))).otherwise(F.lit(0))


def _tokens(mail: Column) -> Column:
    """The runs of letters, digits and others of a mail without its top-level domain."""
    return F.regexp_extract_all(F.substring(mail, F.lit(1), F.length(mail) - F.length(F.substring_index(mail, ".", -1)) - 1), F.lit(r"\p{L}+|[0-9]+|[^\p{L}0-9]+"), 0)


def format_of(part: Column, value: Column) -> Column:
    """What a value and its surrogate have in common; values of different formats differ."""
    mail = F.concat_ws("|", F.regexp_replace(F.regexp_replace(value, r"\p{L}+", "a"), "[0-9]+", "9"), F.substring_index(value, ".", -1))
    card = F.concat_ws("|", F.length(value).cast("string"), F.substring(value, 1, 1), _valid(value).cast("string"))
    phone = F.concat_ws("|", F.length(value).cast("string"), F.substring(value, F.lit(1), _lead(part, value)))
    return F.concat_ws("|", part, F.when(part == "email", mail).when(part == "card", card).when(part == "phone", phone).when(part == "ssn", F.length(value).cast("string")))


def _drawn(h: Column, text: Column) -> Column:
    """Letters or digits from hash ``h``, as many as ``text`` has, of the class of its first one."""
    new = lambda i: F.when(text < ":", F.chr(_pick(h, i, 10) + 48)).otherwise(F.chr(_pick(h, i, 26) + 97))
    return F.when(text != "", F.array_join(F.transform(F.sequence(F.lit(1), F.length(text)), new), "")).otherwise(F.lit(""))


def _of(words: list[str]) -> Column:
    return F.split(F.lit(" ".join(words)), " ")


def _by_script(script: Column, lists: dict) -> Column:
    out = _of(lists["latin"])
    for s, words in lists.items():
        out = F.when(script == s, _of(words)).otherwise(out)
    return out


def numbered(part: Column, value: Column, i: Column, n: Column, key: str = KEY) -> Column:
    """Surrogate number ``i`` below 2n in the format of ``value``, of which the corpus has n. Equal formats and unequal numbers give unequal ones.

    The number is stepped through all numbers of as many digits as 2n needs, in the base of the format: ten for digits, 26 for letters, twenty for
    syllables; the key shifts where it starts. What it doesn't decide comes from a keyed hash of the value. Formats too small for their number of
    values grow longer.
    """
    start = F.lit(zlib.crc32(key.encode()))
    spelt = part.contains(":")
    base = F.when(spelt, 20).when((part == "email") & value.rlike(r"^\p{L}"), 26).otherwise(10)
    wide = F.struct(base.alias("base"), (F.floor(F.log(n * 2.0) / F.log(base.cast("double"))) + 1).cast("int").alias("w"))

    def coded(x: Column) -> Column:
        size = F.round(F.pow(x["base"].cast("double"), x["w"])).cast("long")
        at = F.pmod(i * F.lit(STEP) + start, size)
        return F.struct(
            F.sha2(F.concat_ws("|", F.lit(key), part, value).cast("binary"), 256).alias("h"), F.lpad(F.lower(F.call_function("conv", at.cast("string"), F.lit(10), x["base"])), x["w"], "0").alias("code"))

    def written(c: Column) -> Column:
        h, code = c["h"], c["code"]
        # mail: the first run holds the number; the other runs keep class and length
        letters = F.when(value.rlike(r"^\p{L}"), F.translate(code, "0123456789abcdefghijklmnop", "abcdefghijklmnopqrstuvwxyz")).otherwise(code)
        unique = lambda t: F.concat(_drawn(h, F.substring(t, F.lit(1), F.greatest(F.length(t) - F.length(code), F.lit(0)))), letters)
        run = lambda t, k: F.when(k == 0, unique(t)).when(t.rlike(r"^[\p{L}0-9]"), _drawn(F.concat(h, k.cast("string")), t)).otherwise(t)
        email = F.concat(F.array_join(F.transform(_tokens(value), run), ""), F.lit("."), F.substring_index(value, ".", -1))
        at = F.pmod(i * F.lit(STEP) + start, F.lit(254**4))
        ip = F.concat_ws(".", *[(F.floor(at / 254**k) % 254 + 1).cast("string") for k in (3, 2, 1, 0)])
        # digits: free ones drawn, of which the first is no zero, then the number; of a card all but the scheme and the check digit
        lead, last = _lead(part, value), F.when(part == "card", 1).otherwise(0)
        more = F.greatest(F.length(value) - lead - last - F.length(code), F.lit(0))
        free = F.when(more > 0, F.array_join(F.transform(F.sequence(F.lit(1), more), lambda k: F.when(k == 1, _pick(h, 0, 8) + 1).otherwise(_pick(h, k, 10)).cast("string")), "")).otherwise(F.lit(""))
        body = F.concat(F.substring(value, F.lit(1), lead), free, code)
        check = lambda b: F.concat(b, ((_luhn(b) + F.when(_valid(value), F.lit(0)).otherwise(_pick(h, 99, 9) + 1)) % 10).cast("string"))
        digits = F.when(part == "card", _once(body, check)).otherwise(body)
        # names: syllables, drawn ones first, then an ending
        script, gender = F.get(F.split(part, ":"), 1), F.get(F.split(part, ":"), 2)
        more = F.greatest(F.when(gender.isNull(), 3).otherwise(2) - F.length(code), F.lit(0))
        row = F.concat(F.when(more > 0, F.transform(F.sequence(F.lit(1), more), lambda k: _pick(h, k, 20))).otherwise(F.array().cast("array<int>")), F.transform(F.split(code, ""), lambda d: F.conv(d, 20, 10).cast("int")))
        spell = F.initcap(F.array_join(_once(_by_script(script, SYLLABLES), lambda s: F.transform(row, lambda k: F.get(s, k))), ""))
        one = lambda words, k: _once(words, lambda x: F.get(x, F.pmod(F.xxhash64(h, F.lit(k)), F.size(x)).cast("int")))
        double = F.when(value.contains("-"), F.concat(F.lit("-"), F.initcap(one(_by_script(script, SYLLABLES), 31)), one(_by_script(script, ENDINGS), 32))).otherwise(F.lit(""))
        surname = F.concat(spell, one(_by_script(script, ENDINGS), 30), double)
        given = F.concat(spell, F.get(_by_script(script, {s: [g[x] for x in "fmn"] for s, g in GIVEN_ENDINGS.items()}), F.when(gender == "f", 0).when(gender == "m", 1).otherwise(2)))
        return F.when(part == "email", email).when(part == "ip", ip).when(~spelt, digits).when(gender.isNull(), surname).otherwise(given)

    return _once(_once(wide, coded), written)


def assign(distinct: DataFrame, key: str = KEY) -> DataFrame:
    """(part, value, new) for each distinct (part, value): all ``new`` of a part differ, and none is a value of the corpus.

    Ranks are dealt over salted formats. A format of n values has the numbers below 2n: the first n are given out, and those that n real values can
    block at most leave enough spares for them.
    """
    keyed = F.sha2(F.concat_ws("|", F.lit(key), "part", "value").cast("binary"), 256)
    rows = materialize(distinct.withColumns({"_f": format_of(F.col("part"), F.col("value")), "_h": keyed}), "values")
    sizes = rows.groupBy("_f").agg(F.count("*").alias("_n"))
    ranked = salted_rank(rows, ["_f"], [F.col("_h"), F.col("value")], F.xxhash64("_h"), "_i").join(sizes, "_f")
    ranked = materialize(ranked.withColumn("new", numbered(F.col("part"), F.col("value"), F.col("_i"), F.col("_n"), key)), "numbered")
    real = rows.select("part", F.col("value").alias("new"))
    free = ranked.join(real, ["part", "new"], "left_anti").select("part", "value", "new")
    blocked = materialize(ranked.join(real, ["part", "new"], "left_semi").select("part", "value", "_f", "_h"), "blocked")
    if blocked.isEmpty():
        return free
    wanted = ranked.join(blocked.select("_f").distinct(), "_f", "left_semi")
    spare = wanted.withColumn("new", numbered(F.col("part"), F.col("value"), F.col("_i") + F.col("_n"), F.col("_n"), key)).join(real, ["part", "new"], "left_anti")
    spare = salted_rank(materialize(spare.select("_f", "new"), "spare"), ["_f"], [F.col("new")], F.xxhash64("new"), "_k")
    moved = salted_rank(blocked, ["_f"], [F.col("_h"), F.col("value")], F.xxhash64("_h"), "_k").join(spare, ["_f", "_k"]).select("part", "value", "new")
    return free.unionByName(moved)


def _exchanged(name: Column, key: str) -> Column:
    """Another listed given name of the same script and gender: the key says how far along the list."""
    pairs = []
    for names in (names for s in GIVEN.values() for names in s.values()):
        shift = 1 + zlib.crc32(f"{key}|{names[0]}".encode()) % (len(names) - 1)
        pairs += [f"{n}={names[(k + shift) % len(names)]}" for k, n in enumerate(names)]
    return F.element_at(F.str_to_map(F.lit(" ".join(pairs)), F.lit(" "), F.lit("=")), name)


def _fill(e: Column, given: Column, new: Column, key: str) -> Column:
    """A surrogate in the layout of one mention: its title, its capitals, its separators between digits."""
    raw, kind = e["raw"], e["kind"]
    name = F.substring_index(e["canon"], ":", -1)
    first = F.when(F.instr(name, " ") > 0, F.concat(F.coalesce(F.when(given != "", given), _exchanged(F.substring_index(name, " ", 1), key)), F.lit(" "))).otherwise(F.lit(""))
    person = F.concat(F.regexp_extract(raw, rf"^(?:(?:{_TITLED})\.?\x20)?", 0), first, new)
    mail = F.when(F.upper(raw) == raw, F.upper(new)).otherwise(new)
    zero = F.struct(F.lit(1).alias("k"), F.lit("").alias("out"))
    step = lambda a, c: F.when((c >= "0") & (c <= "9"), F.struct((a["k"] + 1).alias("k"), F.concat(a["out"], F.substring(new, a["k"], F.lit(1))).alias("out"))).otherwise(F.struct(a["k"].alias("k"), F.concat(a["out"], c).alias("out")))
    laid = F.aggregate(F.split(raw, ""), zero, step, lambda a: F.concat(a["out"], F.substring(new, a["k"], F.length(new))))
    return F.when(kind == "email", mail).when(kind == "ip", new).when(kind == "person", person).otherwise(laid)


def surrogates(docs: DataFrame, key: str = KEY, entities_as: str | None = None) -> DataFrame:
    """``docs`` with surrogates in `text` and, if named, an added array column of the entities found.

    Null and empty texts stay. Every row and column stays; repeated rows get equal texts. Only rows with entities move;
    copies share one list of lookups, keyed by SHA-256 of their entities.
    """
    docs, restored = shielded(docs, ["text"])
    cols, text = docs.columns, "text"
    marked = spread(docs).withColumn("_f", found(F.col(text))).withColumns({text: F.when(F.col("_f").isNull(), F.col(text)), "_plain": F.col("_f.plain"), "_e": F.coalesce("_f.e", F.array().cast(ENTITY))}).drop("_f")
    marked = materialize(marked, "marked")
    keyed = marked.where(F.size("_e") > 0).withColumn("_key", F.sha2(F.concat_ws("\x1f", F.transform("_e", lambda e: F.concat_ws(":", e["kind"], e["canon"]))).cast("binary"), 256))
    slots = keyed.select("_key", F.posexplode(F.flatten(F.transform("_e", parts))).alias("_at", "x")).select("_key", "_at", "x.part", "x.value").distinct()
    slots = materialize(slots, "mentions")
    asked = slots.where("part is not null")
    new = asked.join(assign(asked.select("part", "value").distinct(), key), ["part", "value"]).select("_key", "_at", "new")
    lists = new.unionByName(slots.where("part is null").select("_key", "_at", F.lit("").alias("new"))).groupBy("_key").agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "new"))), lambda x: x["new"]).alias("_new"))
    hit = keyed.join(lists, "_key")
    filled = F.transform("_e", lambda e, k: _fill(e, F.get("_new", 2 * k), F.get("_new", 2 * k + 1), key))
    done = _restored(F.concat_ws("", F.flatten(F.zip_with("_plain", filled, lambda p, s: F.array(p, F.coalesce(s, F.lit("")))))))
    fixed = hit.select(*[done.alias(text) if c == text else F.col(c) for c in cols], "_e")
    out = fixed.unionByName(marked.where(F.size("_e") == 0).select(*cols, "_e"))
    if entities_as is None:
        return restored(out)
    return restored(out, F.col("_e").alias(entities_as))


def surrogate_report(docs: DataFrame) -> DataFrame:
    """doc_id, the text with surrogates, and the number of mentions of each kind. Other columns are not read."""
    out = surrogates(docs.select("doc_id", "text"), entities_as="_e")
    n = lambda k: F.size(F.filter("_e", lambda e: e["kind"] == k)).cast("long").alias(f"n_{k}")
    return out.select("doc_id", "text", F.size("_e").cast("long").alias("n_entities"), *[n(k) for k in PATTERNS])
