import random
import re

from pyspark.sql import functions as F

from lodeframe.llm import pii

from .data import DOCS, corpus, frame

TEXTS = {
    1: "Write to Ann.Lee+x@Mail.example.com or ann.lee+x@mail.example.com now.", 2: "card 4041 8949 7460 8795, 4041894974608795 and 4041-8949-7460-8795; ip 10.0.0.1 twice 10.0.0.1",
    3: "call +1 (942) 555-3818 or (942) 555-3819, ssn 123-45-6789", 4: "Mrs. Smith met John Smith and Mr Peter Jones; Anna Müller and Госпожа Петрова, Иван Петров too",
    5: "Version 2.0. License 3, AKIA123456, b7db7aa4a5fcc78305 and 0641917ea4e9feb9cda83477b57ac2654884f485", 6: "ip 1.2.3.4.5 300.1.1.1 x@y on 2024-05-06 07:08:09, 12.34 56.78 and 10 20 30 pages 100-200", 7: "again ann.lee+x@mail.example.com and 10.0.0.1.",
}


def out(spark, texts=TEXTS):
    df = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in texts.items()], DOCS)
    return {r.doc_id: r for r in pii.surrogate_report(df).collect()}


def test_formats_and_coreference(spark):
    got = {k: r.text for k, r in out(spark).items()}
    a, b = re.findall(r"\S+@\S+", got[1])
    assert a == b and a in got[7] and re.fullmatch(r"[a-z]{3}\.[a-z]{3}\+[a-z]@[a-z]{4}\.[a-z]{7}\.com", a) and "lee" not in a
    m = re.fullmatch(r"card (\d{4} \d{4} \d{4} \d{4}), (\d{16}) and (\d{4}-\d{4}-\d{4}-\d{4}); ip (\S+) twice (\S+)", got[2])
    assert re.sub(r"\D", "", m[1]) == m[2] == re.sub(r"\D", "", m[3]) != "4041894974608795" and m[2][0] == "4"
    assert m[4] == m[5] != "10.0.0.1" and all(0 < int(x) < 255 for x in m[4].split(".")) and m[4] in got[7]
    m = re.fullmatch(r"call \+1 \((\d{3})\) (\d{3}-\d{4}) or \(\d{3}\) \d{3}-\d{4}, ssn (\d{3}-\d{2}-\d{4})", got[3])
    assert m and m[2] != "555-3818" and m[3] != "123-45-6789"
    assert got[5] == TEXTS[5] and got[6] == TEXTS[6]


def test_persons(spark):
    m = re.fullmatch(r"Mrs\. (\w+) met (\w+) (\w+) and Mr (\w+) (\w+); (\w+) (\w+) and Госпожа (\w+), (\w+) (\w+) too", out(spark)[4].text)
    assert m and m[1] == m[3] != "Smith" and m[2] in pii.GIVEN["latin"]["m"] and m[4] in pii.GIVEN["latin"]["m"] and m[6] in pii.GIVEN["latin"]["f"]
    assert m[9] in pii.GIVEN["cyrillic"]["m"] and re.fullmatch("[А-Яа-яёЁ]+", m[8]) and re.fullmatch("[А-Яа-яёЁ]+", m[10])


def test_rows_and_edges(spark):
    rows = corpus(60)
    df = frame(spark, rows)
    got = pii.surrogates(df)
    assert got.columns == df.columns and got.count() == len(rows)
    plain = pii.surrogate_report(df)
    assert plain.count() == len(rows)
    assert sorted((str(r.doc_id), str(r.text)) for r in plain.collect()) == sorted((str(r[0]), str(r[1])) for r in rows)
    assert pii.surrogate_report(spark.createDataFrame([], DOCS)).count() == 0


def test_key_and_reruns(spark):
    df = spark.createDataFrame([(1, TEXTS[1])], "doc_id LONG, text STRING")
    a, b, c = (pii.surrogates(df, key).first().text for key in ("k", "k", "other"))
    assert a == b != c


def frame_of(spark, values):
    return spark.createDataFrame(values, "part STRING, value STRING")


def test_small_formats(spark):
    """Local parts of one letter block many numbers; all get different surrogates that are nobody's real address."""
    mails = [f"{c}@{d}.com" for c in "abcdefghijklmnopqrstuvwxyz" for d in "abcdefghijklmnopqrstuvwxyz"]
    got = pii.assign(frame_of(spark, [("email", m) for m in mails])).collect()
    assert len({r.value for r in got}) == 676 == len({r.new for r in got}) and not {r.new for r in got} & set(mails)
    digits = [f"{k:09d}" for k in range(0, 10**9, 10**6)]
    got = pii.assign(frame_of(spark, [("ssn", d) for d in digits])).collect()
    assert len({r.new for r in got}) == 1000 and not {r.new for r in got} & set(digits) and all(len(r.new) == 9 for r in got)


def test_blocked_numbers(spark):
    """Values that are the corpus's first numbers themselves are moved to spare ones."""
    base = frame_of(spark, [("surname:latin", f"Old{k}") for k in range(40)])
    news = [r.new for r in pii.assign(base).collect()]
    got = pii.assign(base.unionAll(frame_of(spark, [("surname:latin", x) for x in news]))).collect()
    assert len(got) == 80 == len({r.new for r in got}) and not {r.new for r in got} & {r.value for r in got}


def luhn(d):
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def test_cards_keep_their_check(spark):
    valid = ["4111111111111111", "5500005555555559", "340000000000009", "6011000990139424"]
    cards = valid + ["4111111111111112", "1234567890123456"]
    got = {r.value: r.new for r in pii.assign(frame_of(spark, [("card", c) for c in cards])).collect()}
    assert all(luhn(got[c]) == (c in valid) and got[c][0] == c[0] and len(got[c]) == len(c) and got[c] != c for c in cards)


def test_many_persons(spark):
    """70,000 surnames and 5,000 people of one surname: all differ, and a shared surname stays shared."""
    letters = lambda k: F.concat(*[F.chr(F.pmod(F.floor(F.col("id") / 26**i), F.lit(26)) + 97) for i in range(k)])
    titled = spark.range(70_000).select(F.concat(F.lit("Mr X"), letters(4), F.lit(".")).alias("text"))
    same = spark.range(5_000).select(F.concat(F.lit("Mrs Y"), letters(3), F.lit(" Smith.")))
    got = pii.surrogates(titled.unionAll(same).withColumn("was", F.col("text"))).collect()
    assert len(got) == 75_000 == len({r.text for r in got}) and not {r.text for r in got} & {r.was for r in got}
    smiths = [r.text for r in got if "Smith" in r.was]
    assert len({t.split()[-1] for t in smiths}) == 1 and len({t.split()[1] for t in smiths}) == 5_000


def test_syllables_read_one_way():
    for s in pii.SYLLABLES.values():
        assert len(s) == 20 and not any(a != b and b.startswith(a) for a in s for b in s)
    made = lambda s, g: re.compile(f"(?:{'|'.join(pii.SYLLABLES[s])})+{pii.GIVEN_ENDINGS[s][g]}", re.I)
    assert not [n for s, gs in pii.GIVEN.items() for g, names in gs.items() for n in names for x in "fmn" if made(s, x).fullmatch(n)]


def test_kinds(spark):
    """The branch that matched gives the kind; too few digits are no phone, whatever follows them."""
    texts = {
        1: "10-20-30 - 4000 and 10-20-30-40", 2: "10-20-30 10.0.0.1", 3: "Dr. Ada Novak, my name is Zoe Quist", 4: "+44 20 7946 0958, 020 7946 0958, 555 123 4567, 030/123",
        5: "a\x01b c@d.com \x02\x03\x04 \x03", 6: "Κυρία Παπαδοπούλου", 7: "AB.C@D.COM", 8: "2024-01-02 2024-01-02-03", 9: None, 10: "", 12: "réê.43@mail4.example.com x éric@x.com", 11: "Anna-Maria Berg-Holm; Herr Berg-Holm",
    }
    got = out(spark, texts)
    assert got[1].text == texts[1] and got[1].n_entities == 0
    assert got[2].n_ip == 1 == got[2].n_entities and got[2].text.startswith("10-20-30 ")
    assert got[3].n_person == 2 and re.fullmatch(r"Dr\. \w+ \w+, my name is \w+ \w+", got[3].text) and "Zoe" not in got[3].text
    assert got[4].n_phone == 3 and re.fullmatch(r"\+\d\d \d\d \d{4} \d{4}, \d{3} \d{4} \d{4}, \d{3} \d{3} \d{4}, 030/123", got[4].text)
    assert re.fullmatch(r"a\x01b [a-z]@[a-z]\.com \x02\x03\x04 \x03", got[5].text)
    assert re.fullmatch(r"Κυρία [\u0370-\u03ff]+", got[6].text) and "Παπαδοπούλου" not in got[6].text
    assert re.fullmatch(r"[A-Z]{2}\.[A-Z]@[A-Z]\.COM", got[7].text) and got[8].text == texts[8] and got[9].text is None and got[10].text == ""
    assert re.fullmatch(r"[a-z]{3}\.\d\d@[a-z]{4}\d\.[a-z]{7}\.com x [a-z]{4}@[a-z]\.com", got[12].text)
    assert got[11].n_person >= 1 and "Berg" not in got[11].text.split(";")[1]


#: Entities of known kinds, written plainly in texts, and what finds them again.
SHAPES = {"email": r"[a-z]+\.[a-z]+\d*@[a-z]+\d\.[a-z]+\.com", "ip": r"\d+\.\d+\.\d+\.\d+", "card": r"\d{16}", "phone": r"\+1 \(\d{3}\) \d{3}-\d{4}", "ssn": r"\d{3}-\d{2}-\d{4}"}


def test_against_brute_force(spark):
    """Over repeated, null, empty and long texts: one surrogate a real value, one real value a surrogate, and nothing else touched."""
    rng = random.Random(5)
    make = {
        "email": lambda: f"{rng.choice(['al', 'bo', 'cy'])}.{rng.choice(['xu', 'yo'])}{rng.randint(1, 9)}@mail{rng.randint(0, 3)}.example.com", "ip": lambda: ".".join(str(rng.randint(1, 254)) for _ in range(4)),
        "card": lambda: str(rng.randint(4 * 10**15, 4 * 10**15 + 400)), "phone": lambda: f"+1 ({rng.randint(200, 203)}) 555-{rng.randint(1000, 1040)}", "ssn": lambda: f"{rng.randint(100, 104)}-22-{rng.randint(1000, 1010)}",
    }
    texts = [" word, ".join(make[rng.choice(list(make))]() for _ in range(rng.choice([1, 3, 8]))) for _ in range(300)]
    texts += [texts[0]] * 40 + [None, "", "no entity", " and ".join(make["email"]() for _ in range(6_000))]
    got = {r.doc_id: r for r in pii.surrogate_report(spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")).collect()}
    pattern = re.compile("|".join(f"(?P<{k}>{p})" for k, p in SHAPES.items()))
    there, back = {}, {}
    for i, t in enumerate(texts):
        if not t:
            assert got[i].text == t and got[i].n_entities == 0
            continue
        old, new = list(pattern.finditer(t)), list(pattern.finditer(got[i].text))
        assert [m.lastgroup for m in old] == [m.lastgroup for m in new] and pattern.split(t)[:: len(SHAPES) + 1] == pattern.split(got[i].text)[:: len(SHAPES) + 1]
        assert got[i].n_entities == len(old) and got[i].n_email == sum(m.lastgroup == "email" for m in old)
        for a, b in zip(old, new):
            assert there.setdefault((a.lastgroup, a[0]), b[0]) == b[0] and back.setdefault((a.lastgroup, b[0]), a[0]) == a[0]
    assert len(there) > 700 and not {k for k, _ in there.items()} & {(k, v) for (k, _), v in there.items()}
