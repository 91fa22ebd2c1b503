import re

from meshspark.llm import surrogates as s
from meshspark.llm.shared import QUERIES

KEY = b"k"


def test_detection_and_formats():
    text = ("Mail Ann.Lee7@Mail.example.com, ring +1 (743) 555-3824 or 743-555-3824, host 227.5.221.1. Card 4785380592391139, "
            "not 2123465659789240 or 4785 3805; SSN 123-45-6789; IBAN DE89 3704 0044 0532 0130 00; Mrs. Ada Smith met Mr. Smith and г-жа Петрова. "
            "Hash 24be64439e3e49cf46b2d7c90f3602a3d0b907ff, version 1.2.3.4.5, 4.0.")
    kinds = [k for *_, k, _ in s.detect(text)]
    assert kinds == ["email", "phone", "phone", "ip", "card", "ssn", "iban", "name/female/latin", "name/surname/latin", "name/surname/latin",
                     "name/surname/cyrillic"]
    canon = {(k, c) for *_, k, c in s.detect(text)}
    assert ("phone", "7435553824") in canon and sum(k == "phone" for k, _ in canon) == 1
    for a, b, k, c in s.detect(text):
        new = s.write_like(text[a:b], k, c, s.surrogate(KEY, k, c, 0))
        assert new != text[a:b]
        if k in ("phone", "card", "ssn", "iban"):
            assert re.sub("[A-Za-z0-9]", "0", new) == re.sub("[A-Za-z0-9]", "0", text[a:b])
        again = s.detect(f"x {new} y")
        if k in ("email", "ip", "card", "iban"):
            assert [x[2] for x in again] == [k]
        if k.startswith("name"):
            assert new[0].isupper() and s._script(new) == k.split("/")[2]


def test_collisions_are_resolved(spark):
    names = [("name/female/greek", f"λ{i}") for i in range(3000)] + [("ip", f"10.0.{i // 200}.{i % 200}") for i in range(2000)]
    ent = spark.createDataFrame(names, "kind string, canon string")
    got = s.assign(ent, KEY).toPandas()
    assert len(got) == 5000 and not got.duplicated(["kind", "canon"]).any() and not got.duplicated(["kind", "surrogate"]).any()
    assert not set(zip(got.kind, got.surrogate)) & set(names)
    first = {(k, c): s.surrogate(KEY, k, c, 0) for k, c in names}
    assert sum(first[k, c] != v for k, c, v in zip(got.kind, got.canon, got.surrogate)) > 0
    again = s.assign(ent.repartition(7), KEY).toPandas()
    assert set(map(tuple, again.values)) == set(map(tuple, got.values))


def test_query_leaves_no_mention_and_touches_nothing_else(spark):
    sf = "/root/testdata/sf0.01"
    got = QUERIES["op10_pii_surrogates"](spark, sf).toPandas().set_index("doc_id")
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id")
    assert sorted(got.index) == sorted(docs.index) and got.n_entities.sum() > 30
    given = {}
    for i, text in docs.text.items():
        found, new = s.detect(text or ""), got.text[i]
        assert got.n_entities[i] == len(found)
        pieces, at = [], 0
        for a, b, k, c in found:
            pieces.append(re.escape(text[at:a]))
            at = b
        m = re.fullmatch("(.+?)".join([*pieces, re.escape(text[at:])]), new, re.DOTALL)
        assert m
        for (a, b, k, c), v in zip(found, m.groups()):
            assert v.lower() != text[a:b].lower() and given.setdefault((k, c), re.sub(r"\W", "", v).lower()[-9:]) == re.sub(r"\W", "", v).lower()[-9:]


def test_odd_rows(spark):
    rows = [(1, None, 9), (2, "", 9), (3, "a@b.example.com " * 20000, 9), (4, "call (743) 555-3824", 9), (4, "call (743) 555-3824", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kinds int")
    got = s.replace(docs, KEY).toPandas()
    assert len(got) == 5 and got[got.doc_id == 3].n_entities.item() == 20000
    assert got[got.doc_id == 4].text.nunique() == 1 and "555-3824" not in got[got.doc_id == 4].text.iloc[0]
    assert s.replace(docs.limit(0), KEY).count() == 0


def test_numbers_next_to_others():
    card, iban = "4111 1111 1111 1111", "AT61 1904 3002 3457 3201"
    for text, want in ((f"{card} 123", [card]), ("4111111111111111 12", ["4111111111111111"]), ("12 4111111111111111", ["4111111111111111"]),
                       (f"{card} 5500-0000-0000-0004", [card, "5500-0000-0000-0004"]), (f"no 7 12 {card} 12/30", [card]),
                       (f"{card} {card} {card} 123", [card] * 3), (f"{iban} 2024", [iban]), (f"{iban} DE89 3704 0044 0532 0130 00 X1", [iban, "DE89 3704 0044 0532 0130 00"]),
                       (f"REF1 2345 6789 {iban}", [iban]), (f"AB12 3456 7890 {iban}", [iban]), ("2123465659789240 or 12 34", []), ("94111111111111111", [])):
        found = [(text[a:b], k) for a, b, k, _ in s.detect(text) if k in ("card", "iban")]
        assert found == [(w, "iban" if w[0].isalpha() else "card") for w in want], text


def test_phones_of_other_forms_and_repeated_names():
    for phone in ("+14155550123", "+33 1 23 45 67 89", "+49 30 123456", "0612345678", "06 12 34 56 78", "+44 (0)20 7946 0958"):
        (a, b, k, c), = s.detect(f"Call {phone}, please.")
        new = s.write_like(phone, k, c, s.surrogate(KEY, k, c, 0))
        assert (k, f"Call {phone}, please."[a:b]) == ("phone", phone) and new != phone
        assert re.sub("[0-9]", "0", new) == re.sub("[0-9]", "0", phone) and (phone[:3] == "+14" or new[0] == phone[0])
    assert not s.detect("On 01.02.2024 12 of 1234567890 and 0.0612345678 or 01-02-2024.")
    text = "Smith came. Mrs. Ada Smith called. Later Ada Smith left and SMITH wrote to Smithson, a smith; Smith's end."
    found = s.detect(text)
    assert [text[a:b] for a, b, *_ in found] == ["Smith", "Ada", "Smith", "Ada", "Smith", "SMITH", "Smith"]
    assert len({(k, c) for *_, k, c in found}) == 2
