from junctura.llm import pii

from .fixtures import documents, odd_texts

TEXTS = [
    "Mail ann.b7@mail3.example.com, call +1 (499) 555-6503 or write ann.b7@mail3.example.com!", "Card 4111 1111 1111 1111 and 4111111111111111, not 4111111111111112.", "At 152.143.123.13, not 300.1.2.3 or 1.2.3.4.5",
    "SSN 123-45-6789. IBAN DE89 3704 0044 0532 0130 00.", "Frau Schmidt met Dr. Anna Weber; Анна Петрова and John Smith came. The The Of", "+1 (499) 555-6503 again", "nothing here at all",
]


def test_surrogates(spark):
    rows = list(enumerate(TEXTS + odd_texts()))
    got = {r.doc_id: r for r in pii.replace_pii(documents(spark, rows, extra=True)).collect()}
    for i, t in rows:
        kept, at = [], 0
        for s in got[i].pii:
            old = t[s.start : s.end]
            assert old != s.surrogate and [c.isdigit() for c in old] == [c.isdigit() for c in s.surrogate] or s.kind in ("name", "ip", "iban", "email", "card")
            kept += [t[at : s.start], s.surrogate]
            at = s.end
        assert got[i].text == (None if t is None else "".join([*kept, t[at:]]))
    kinds = lambda i: [s.kind for s in got[i].pii]
    assert [kinds(i) for i in range(7)] == [["email", "phone", "email"], ["card", "card"], ["ip"], ["ssn", "iban"], ["name"] * 4, ["phone"], []]
    said = lambda i: [s.surrogate for s in got[i].pii]
    assert said(0)[0] == said(0)[2] and said(0)[1] == said(5)[0] and said(1)[0].replace(" ", "") == said(1)[1]
    assert pii.luhn(said(1)[1]) and pii._iban_valid(said(3)[1])
    assert said(4)[1].split()[0] in pii.NAMES["latin", "f"] and said(4)[2].split()[0] in pii.NAMES["cyrillic", "f"] and said(4)[3].split()[0] in pii.NAMES["latin", "m"]
    assert got[6].text == TEXTS[6] and pii.replace_pii(documents(spark)).count() == 0


def test_collisions_are_keyed_again(spark, monkeypatch):
    monkeypatch.setitem(pii.SYLLABLES, "latin", ["ba", "be"])
    rows = [(i, f"Mr {chr(65 + i % 26)}{chr(97 + i // 26)}x called. Mr Bababa") for i in range(12)]
    for bound in (200_000, -1):
        monkeypatch.setattr(pii, "BROADCAST_ROWS", bound)
        got = pii.replace_pii(documents(spark, rows)).collect()
        firsts = [r.pii[0].surrogate for r in got]
        assert len(set(firsts)) == 12 and "Bababa" not in firsts and len({r.pii[1].surrogate for r in got}) == 1


def test_more_names_than_the_first_space_holds(spark, monkeypatch):
    monkeypatch.setitem(pii.SYLLABLES, "latin", ["ba", "be"])

    def keyed(found, key):  # in the driver, where the syllables are replaced
        rows = [(r.kind, r.norm, r.attempt, pii.surrogate(key, r.kind, r.norm, r.attempt)) for r in found.select("kind", "norm", "attempt").collect()]
        return spark.createDataFrame(rows, "kind string, norm string, attempt int, surrogate string")

    monkeypatch.setattr(pii, "_keyed", keyed)
    rows = [(i, f"Mr {chr(65 + i % 26)}{chr(97 + i // 26)}x called") for i in range(60)]
    got = [r.surrogate for r in pii.surrogates(documents(spark, rows), b"k", rounds=12).collect()]
    assert len(got) == len(set(got)) == 60


def test_names_against_brute_force(spark, monkeypatch):
    """Mentions and surrogates are one to one on what is shown; parts are shared as in the texts; repeated rows, null ids and both ways to look up."""
    letters = "abcdefghij"
    family = lambda i: f"{chr(65 + i % 26)}{letters[i % 10]}{letters[i // 10 % 10]}{letters[i // 100]}x"
    rows = [(i, f"{('Mr', 'Mrs', 'Dr')[i % 3]} {family(i)} saw Mr {family(i + 1)} and Mrs {chr(65 + i % 26)}{letters[i % 7]}z {family(i // 2)}.") for i in range(900)]
    rows += [(900, "Mr John Smith and Mr Smith; Mrs Smith, John Smith and James Smith, John Brown"), (None, "Mary Jones, William Brown, Jennifer Lopez"), *[(901, "Mr Smith, Mr Smith")] * 3]
    results = []
    for bound in (200_000, -1):
        monkeypatch.setattr(pii, "BROADCAST_ROWS", bound)
        got = pii.replace_pii(documents(spark, rows)).collect()
        texts = {i: t for i, t in rows}
        pairs = {(texts[r.doc_id][s.start : s.end], s.surrogate) for r in got for s in r.pii}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})  # one to one
        of = dict(pairs)
        last = {a.split()[-1]: b.split()[-1] for a, b in pairs}
        assert all(b.split()[-1] == last[a.split()[-1]] for a, b in pairs) and not set(last) & set(last.values())
        assert of["Smith"] == of["John Smith"].split()[1] == of["James Smith"].split()[1] and of["John Smith"].split()[0] == of["John Brown"].split()[0] != of["James Smith"].split()[0]
        assert sum(r.doc_id is None and len(r.pii) == 3 for r in got) == 1 and len({r.text for r in got if r.doc_id == 901}) == 1
        results.append(sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in got))
    assert results[0] == results[1]


def test_formats_with_few_strings(spark):
    rows = [(i, f"{chr(97 + i)}@mail.example") for i in range(26)]
    got = [r.pii[0].surrogate for r in pii.replace_pii(documents(spark, rows)).collect()]
    assert len(set(got)) == 26 and not set(got) & {t for _, t in rows}


def test_numbers_of_other_countries():
    assert [x[2:] for t in ("call 020 7946 0958 now", "06 12 34 56 78.", "on 01 02 2020", "0 12 34 56", "01-02-03-04-05-06-07-08") for x in pii.entities(t)] == [("phone", "02079460958"), ("phone", "0612345678")]
