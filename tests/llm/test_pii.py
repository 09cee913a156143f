import itertools
import re
from collections import Counter

from pyspark.sql import functions as F

from brooktext.llm import pii
from brooktext.llm.pii import detect, iban_holds, key_of, luhn, rendered, script, settled, surrogate, surrogates

KEY = b"a key of the tests"


def replace_pii(df, **how):
    return pii.replace_pii(df, KEY, **how)

TEXTS = [
    (1, "Mail Bo.42@mail8.example.com or call +1 (988) 555-2485."), (2, "call +1-988-555-2485 now, or bo.42@MAIL8.example.com"), (3, "from 42.144.35.254 and 10.0.0.7; v1.2.3, 300.1.1.1"),
    (4, "card 4429820930819525 or 4429-8209-3081-9525, not 4429820930819526"), (5, "Dr. Anna Schmidt met Frau SCHMIDT. Frau Schmidt left. Herr Müller stayed."), (6, "GB82 WEST 1234 5698 7654 32; 123-45-6789"),
    (7, "Clean text. Nothing here, in 2024 or chapter 12."), (8, "Госпожа Елена Иванова"),
]


def kinds(t):
    return [(t[s:e], k.split()[0]) for s, e, k, _ in detect(t)]


def test_detection():
    found = dict((i, kinds(t)) for i, t in TEXTS)
    assert found[1] == [("Bo.42@mail8.example.com", "email"), ("+1 (988) 555-2485", "phone")]
    assert found[3] == [("42.144.35.254", "ip"), ("10.0.0.7", "ip")]
    assert found[4] == [("4429820930819525", "card"), ("4429-8209-3081-9525", "card")]
    assert [k for k, _ in found[5]] == ["Anna", "Schmidt", "SCHMIDT", "Schmidt", "Müller"]
    assert found[6] == [("GB82 WEST 1234 5698 7654 32", "iban"), ("123-45-6789", "ssn")] and found[7] == [] and len(found[8]) == 2


def test_names_after_any_mark():
    for t in ('"Mary Patel" left', "(John Smith)", "author:John Smith", '"Dr. Weber"', "«Елена Иванова»", "1Mary Patel", "²Mary Patel", "_Herr Weber", "—Mr\u00a0Jones", "by:\u00a0Mary\u00a0Patel."):
        alone, among = kinds(t), kinds(t + ". Mary had it.")
        assert alone and alone == among, t
    assert kinds("xMary Patel, Maryx Patel, éMary Patel") == []


def test_surrogates_keep_their_type():
    for i, t in TEXTS:
        for s, e, k, c in detect(t):
            for attempt in range(6):
                new = rendered(k, t[s:e], surrogate(k, c, attempt, KEY))
                assert new != t[s:e] and surrogate(k, c, attempt, KEY) == surrogate(k, c, attempt, KEY) and surrogate(k, c, attempt, b"other key") is not None
                sort = k.split()[0]
                if sort in ("email", "phone", "ip", "ssn", "iban", "card"):
                    assert [x for *_, x, _ in detect(new)] == [sort], (t[s:e], new)
                if sort in ("phone", "card", "ssn", "iban"):
                    assert [c if not c.isalnum() else "0" for c in new] == [c if not c.isalnum() else "0" for c in t[s:e]]
                assert sort != "card" or luhn("".join(filter(str.isdigit, new)))
                assert sort != "iban" or iban_holds(new.replace(" ", ""))
    assert surrogate("ip", "10.0.0.7", 0, KEY).startswith("10.") and surrogate("email", "a@x.com", 0, KEY).split("@")[1] == surrogate("email", "b@x.com", 0, KEY).split("@")[1]


def test_coreference_and_distinctness(spark, empty):
    df = spark.createDataFrame([(i, t, len(t), "k") for i, t in TEXTS], "doc_id long, text string, n_chars int, kind string")
    out = {r.doc_id: r for r in replace_pii(df, kinds_column="found").collect()}
    assert out[7].text == TEXTS[6][1] and out[7].found == "" and out[1].found == "email:1,phone:1" and all(r.n_chars == len(r.text) and r.kind == "k" for r in out.values())
    mail = lambda t: next(t[s:e].lower() for s, e, k, _ in detect(t) if k == "email")
    digits = lambda t: next(c for *_, k, c in detect(t) if k == "phone")
    assert mail(out[1].text) == mail(out[2].text) and digits(out[1].text) == digits(out[2].text)
    cards = [c for *_, k, c in detect(out[4].text)]
    assert len(set(cards)) == 1 and "4429820930819526" in out[4].text and "v1.2.3, 300.1.1.1" in out[3].text
    assert replace_pii(empty).count() == 0


def drawn(spark, entities):
    return surrogates(settled(spark.createDataFrame(entities, "kind string, canon string")), KEY)[0].collect()


def space(kind):
    return re.sub(r"^(given \w+|surname) ", "name ", kind)


def names_of(t):
    return [(t[s:e], k, c) for s, e, k, c in detect(t) if space(k).startswith("name")]


def test_one_person_one_surrogate(spark):
    """Whatever titles a name's mentions have; no two names of the input share one, and none is a name of the input."""
    texts = ["Mr Kim Lee and Dr Kim Lee wrote.", "Mr Robin Ray met Ms Robin Ray. Prof Robin Ray left.", "Mr Sam Hill, Dr Sam Hill and Mrs Sam Hill.", "Robert Ingram, Thomas Brown, Mr Thomas and Dr Lee Kim", "Mr Hans Lee wrote.", "Frau Erika Langley"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r.doc_id: r.text for r in replace_pii(df).collect()}
    given = {}
    for i, t in enumerate(texts):
        spans = [s for s in detect(t) if space(s[2]).startswith("name")]
        edges = [0, *itertools.chain(*((s, e) for s, e, *_ in spans)), len(t)]
        found = re.fullmatch("(.+?)".join(re.escape(t[a:b]) for a, b in zip(edges[::2], edges[1::2], strict=True)), out[i])
        for (*_, c), new in zip(spans, found.groups(), strict=True):
            given.setdefault(c, set()).add(new.casefold())
    assert set(given) >= {"kim", "lee", "robin", "ray", "sam", "hill", "robert", "ingram", "thomas", "brown", "hans", "erika", "langley"}
    assert all(len(x) == 1 for x in given.values()), given
    every = [x for v in given.values() for x in v]
    assert len(set(every)) == len(every) and not set(every) & set(given)


def test_gender_is_settled_over_all_mentions(spark):
    rows = [("given m latin", "kim"), ("given n latin", "kim"), ("surname latin", "kim"), ("given m latin", "robin"), ("given f latin", "robin"), ("surname latin", "lee"), ("given n latin", "sam"), ("given f latin", "sam"), ("email", "a@b.io"), ("given m cyrillic", "ким")]
    got = {(r.space, r.canon): r.kind for r in settled(spark.createDataFrame(rows * 2, "kind string, canon string")).collect()}
    assert got == {("name latin", "kim"): "given m latin", ("name latin", "robin"): "given n latin", ("name latin", "lee"): "surname latin", ("name latin", "sam"): "given f latin", ("email", "a@b.io"): "email", ("name cyrillic", "ким"): "given m cyrillic"}


def test_names_of_many_shapes():
    shapes = {
        "Mr McDonald left": ["McDonald"], "Ms. O'Neil and Mr. O’Neil": ["O'Neil", "O’Neil"], "Mr. van der Berg": ["Berg"], "JOHN SMITH": ["JOHN", "SMITH"], "Mr. 王小明": ["王小明"], "Dr MACARTHUR": ["MACARTHUR"],
        "Oliver Jones called Emma Brown": ["Oliver", "Jones", "Emma", "Brown"], "Mary de la Cruz": ["Mary", "Cruz"], "Herr Hans von Stein": ["Hans", "Stein"], "Mr D'Angelo-Smith": ["D'Angelo-Smith"], "MR O'NEIL": ["O'NEIL"], "Frau de": [],
    }
    for t, want in shapes.items():
        assert [w for w, *_ in names_of(t)] == want, t
        for w, k, c in names_of(t):
            new = rendered(k, w, surrogate(k, c, 0, KEY))
            assert script(new) == script(w) and new != w and new.isupper() == w.isupper() or script(w) == "han"
    long = "Mr " + "Ab" * 50_000 + " " + "A" * 50_000 + "'" * 1000
    assert detect(long) is not None  # in linear time


def test_a_number_with_and_without_its_country_is_one():
    a, b, c = "+1 555 123 4567", "(555) 123-4567", "555-123-4567"
    assert len({detect(x)[0][3] for x in (a, b, c)}) == 1
    canon = detect(a)[0][3]
    news = [rendered("phone", x, surrogate("phone", canon, 0, KEY)) for x in (a, b, c)]
    assert len({detect(x)[0][3] for x in news}) == 1 and news[1][0] == "(" and len(news[2]) == 12


def test_what_is_left_on_disk(spark):
    """The result reads two tables of the rows with entities; nothing else stays, and clean rows are never copied."""
    from pathlib import Path

    from brooktext.llm.shared import shared_dir

    folder = Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    df = spark.createDataFrame([(k, "clean " * 50) for k in range(50)] + [(99, "Mr Weber")], "doc_id long, text string")
    assert replace_pii(df).count() == 51
    left = sorted(set(folder.iterdir()) - before)
    assert [p.name.rpartition("-")[0] for p in left] == ["pii-new", "pii-rows"]
    assert spark.read.parquet(str(left[1])).count() == 1


def test_collisions(spark):
    names = [("surname latin", f"name{i}") for i in range(120)] + [("surname latin", "ashford"), ("surname latin", "calder")]
    got = drawn(spark, names)
    assert len(got) == len(names) and max(Counter(r.surrogate for r in got).values()) == 1
    assert not {r.surrogate for r in got} & {c for _, c in names}


def test_odd_rows(odd):
    out = replace_pii(odd)
    key = lambda r: repr(r)
    assert out.columns == odd.columns and sorted(map(tuple, out.collect()), key=key) == sorted(map(tuple, odd.collect()), key=key)


def test_names_of_other_forms():
    assert kinds("Mr SMITH, DR ANNA SCHMIDT, Mrs. Mary JONES") == [("SMITH", "surname"), ("ANNA", "given"), ("SCHMIDT", "surname"), ("Mary", "given"), ("JONES", "surname")]
    assert kinds("my name is Oliver Kowalski. Kowalski said: KOWALSKI! Not Kowalskis.") == [("Oliver", "given"), ("Kowalski", "surname"), ("Kowalski", "surname"), ("KOWALSKI", "surname")]
    for t, letters in (("Mr Παπαδόπουλος", "greek"), ("Herr Սարգսյան", "armenian"), ("Mr Ⰰⰱⰲ", None), ("Господин Иванов", "cyrillic"), ("Mr Łukasiński", "latin")):
        for s, e, k, c in detect(t):
            new = rendered(k, t[s:e], surrogate(k, c, 0, KEY))
            assert script(new) == script(t[s:e]) and (letters is None or script(new) == letters) and new[0].isupper(), t
    assert detect("Mr Παπαδόπουλος")


def test_more_numbers():
    assert kinds("030 1234567, 06 12 34 56 78 or 06.12.34.56.78, 020 7946 0958, 0171/1234567") == [(x, "phone") for x in ("030 1234567", "06 12 34 56 78", "06.12.34.56.78", "020 7946 0958", "0171/1234567")]
    assert kinds("2001:db8:85a3::8a2e:370:7334 or 2001:DB8:85A3:0:0:8A2E:370:7334") == [("2001:db8:85a3::8a2e:370:7334", "ip"), ("2001:DB8:85A3:0:0:8A2E:370:7334", "ip")]
    a, b = (c for *_, c in detect("2001:db8:85a3::8a2e:370:7334 or 2001:DB8:85A3:0:0:8A2E:370:7334"))
    assert a == b
    assert kinds("on 01.02.2024 10:00 std::vector a::b 12:30:45 aa:bb:cc:dd:ee:ff 0.12.34.56.78 00:00:00:00") == []


def test_a_surrogate_is_always_drawn():
    for c in ("a@i.org", "i@i.org", "n@o.me", "e@i.app", *(f"{x}@{y}.io" for x in "aeiou" for y in "aeiou")):
        for attempt in range(24):
            assert surrogate("email", c, attempt, KEY) != c
    for kind, c in (("ip", "127.0.0.1"), ("ip", "192.168.0.1"), ("ip", "2001:db8::1:2:3"), ("ip", "fd00::1:2:3"), ("card", "4429820930819525"), ("ssn", "123456789"), ("phone", "0123456789"), ("given f greek", "ελενη"), ("surname block88", "ⰰⰱⰲ")):
        wide = {surrogate(kind, c, a, KEY) for a in range(40)}
        assert c not in wide and len(wide) > 15, kind


def test_formats_that_are_used_up_widen(spark):
    """All 25 addresses of a shape, and 10 of the 10 one-digit ones, still get replacements of their own that are no entities."""
    mails = [f"{a}@{b}.io" for a in "aeiou" for b in "aeiou"] + [f"{d}@x.io" for d in range(10)]
    out = drawn(spark, [("email", m) for m in mails])
    assert {r.canon for r in out} == set(mails) and len({r.surrogate for r in out}) == len(mails) and not {r.surrogate for r in out} & set(mails)
    assert all([k for *_, k, _ in detect(r.surrogate)] == ["email"] for r in out)
    text = spark.createDataFrame([(k, f"write to {m.upper()}, or {m}") for k, m in enumerate(mails)], "doc_id long, text string")
    assert all(r.kinds == "email:2" for r in replace_pii(text, kinds_column="kinds").collect())


def test_columns_of_clashing_names(spark, odd):
    names = ["pii_row", "PII_Spans", "pii_marked", "pii_new", "kind", "canon", "surrogate", "pos", "s"]
    df = odd.where("doc_id = 4").limit(1).select("doc_id", F.lit("x@mail1.example.com").alias("text"), *(F.lit(i).alias(n) for i, n in enumerate(names)))
    (r,) = replace_pii(df).collect()
    assert replace_pii(df).columns == df.columns and list(r)[2:] == list(range(len(names))) and r.text != "x@mail1.example.com"
    assert replace_pii(df.withColumn("kinds", F.lit(9)), kinds_column="kinds").first().kinds == "email:1"


def test_query_like_brute_force(spark):
    """Over all documents: what isn't an entity stays in place, one replacement an entity, none shared, none an entity; planted addresses and numbers go."""
    from brooktext.llm.queries import op4_pii

    d = "/root/testdata/sf0.01"
    old = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    new = {r.doc_id: r for r in op4_pii(spark, d).collect()}
    assert set(new) == set(old)
    canons, given = set(), {}
    for i, t in old.items():
        spans = detect(t)
        canons |= {(space(k), c) for *_, k, c in spans}
        edges = [0, *itertools.chain(*((s, e) for s, e, *_ in spans)), len(t or "")]
        pattern = "(.+?)".join(re.escape((t or "")[a:b]) for a, b in zip(edges[::2], edges[1::2], strict=True))
        m = re.fullmatch(pattern, new[i].text or "", re.S)
        assert m, i
        for (s, e, k, c), x in zip(spans, m.groups(), strict=True):
            assert x != t[s:e]
            given.setdefault((space(k), c), set()).add(next(iter(detect(x)), (0, 0, k, x.casefold()))[3])
        assert new[i].kinds == ",".join(f"{k}:{n}" for k, n in sorted(Counter(k.split()[0] for *_, k, _ in spans).items()))
    assert all(len(x) == 1 for x in given.values()) and len({(k, *x) for (k, _), x in given.items()}) == len(given) == len(canons)
    assert not {(k, *x) for (k, _), x in given.items()} & canons
    planted = re.compile(r"[a-z.0-9]+@mail\d\.example\.com|\+1 \(\d{3}\) 555-\d{4}")
    before = {x for t in old.values() for x in planted.findall(t or "")}
    assert before and not before & {x for r in new.values() for x in planted.findall(r.text or "")}


def test_the_key_is_the_sessions(spark):
    spark.conf.unset(pii.KEY_CONF)
    key = key_of(spark)
    assert len(key) == 64 and key_of(spark) == key
    spark.conf.set(pii.KEY_CONF, "mine")
    assert key_of(spark) == b"mine"
    spark.conf.unset(pii.KEY_CONF)
