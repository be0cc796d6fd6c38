import hashlib
import random
import re

from pyspark.sql import functions as F

from demandlake.llm import pseudonyms as P


def permuted(x, size, side, tweak, key):
    """The keyed permutation once more, in plain Python."""
    for _ in range(P.WALKS + 1):
        a, b = divmod(x, side)
        for r in range(P.ROUNDS):
            f = int(hashlib.sha256(f"{key}|{tweak}|{r}|{b}".encode()).hexdigest()[:15], 16)
            a, b = b, (a + f % side) % side
        x = a * side + b
        if x < size:
            return x
    raise AssertionError


def luhn(s):
    d = [int(c) for c in s][::-1]
    return sum(d[0::2]) + sum(sum(divmod(2 * c, 10)) for c in d[1::2])


def test_permutation_is_a_bijection_and_equals_plain_python(spark):
    size, side = 5000, P._side(5000)
    d = spark.range(size).select("id", P._permute(F.col("id"), F.lit(size).cast("long"), F.lit(side).cast("long"), F.lit("t"), "k").alias("x"))
    got = {r.id: r.x for r in d.collect()}
    assert sorted(got.values()) == list(range(size))
    assert all(got[i] == permuted(i, size, side, "t", "k") for i in range(0, size, 97))


def run(spark, texts, key="k"):
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, n_pseudonyms string")
    out = P.pseudonymise(docs, key)
    assert out.columns == ["doc_id", "text", "n_pseudonyms", "found_kinds"]
    return [out.where(F.col("doc_id") == i).first() for i in range(len(texts))]


def test_formats_links_and_rejects(spark):
    texts = ["card 4556737586899855, again 4556 7375 8689 9855.", "not a card: 4556737586899856 nor 1234567", None, "", "no digits",
             "host 97.51.17.173 not 300.1.1.1 nor 1.2.3.4.5", "born 1984-02-29, 31/12/1999, 12/31/1999, 5.6.2001, not 1984-02-30 or 31.02.1999",
             "ssn 123-45-6789 not 000-12-3456 or 666-12-3456", "call +1 (017) 555-7713 or (212) 555-0199",
             "ana.b+c@mail7.example.com. x@y", "ana.b+c@mail7.example.com"]
    r = run(spark, texts)
    cards = re.findall(r"\d{16}|\d{4}(?: \d{4}){3}", r[0].text)
    assert cards[0].strip() == cards[1].replace(" ", "") and cards[0].strip() != "4556737586899855"
    assert luhn(cards[0].strip()) % 10 == 0 and cards[0].strip()[0] == "4"
    assert re.fullmatch(r"card \d{16}, again \d{4} \d{4} \d{4} \d{4}\.", r[0].text)
    assert (r[1].text, r[1].n_pseudonyms) == (texts[1], 0)
    assert (r[2].text, r[2].n_pseudonyms, r[3].text, r[4].text) == (None, 0, "", "no digits")
    ip = re.match(r"host (\d+)\.(\d+)\.(\d+)\.(\d+) not 300\.1\.1\.1 nor 1\.2\.3\.4\.5$", r[5].text)
    assert ip and all(int(x) < 256 for x in ip.groups()) and "97.51.17.173" not in r[5].text
    assert list(r[6].found_kinds) == ["iso", "dmy/", "mdy", "dmy."] and r[6].text.endswith("not 1984-02-30 or 31.02.1999")
    assert list(r[7].found_kinds) == ["ssn"] and r[7].text.endswith("not 000-12-3456 or 666-12-3456") and "123-45-6789" not in r[7].text
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4} or \(\d{3}\) \d{3}-\d{4}", r[8].text) and "555-7713" not in r[8].text
    mail = re.match(r"(u[0-9a-f]{12}@redacted\.invalid)\. x@y$", r[9].text)
    assert mail and mail.group(1) == r[10].text
    other = run(spark, texts[:1], "another key")
    assert other[0].text != r[0].text


def test_dates_permute_within_their_range(spark):
    days = spark.sql("select id doc_id, date_format(date_add(date'1900-01-01', cast(id * 30 as int)), 'yyyy-MM-dd') text from range(0, 2434)")
    got = [r.text for r in P.pseudonymise(days, "k").collect()]
    assert len(set(got)) == len(got) and all("1900-01-01" <= t <= "2099-12-31" for t in got)


def test_written_dates_permute_within_their_form(spark):
    """Every way to write the days of three years, one of them a leap year:
    no two written dates meet, lengths, separators and kinds stay."""
    days = spark.sql("select date_add(date'1999-01-01', cast(id as int)) d from range(0, 1096)")
    forms = ["M/d/yyyy", "MM/dd/yyyy", "M/dd/yyyy", "MM/d/yyyy", "d/M/yyyy", "dd/MM/yyyy", "dd/M/yyyy", "d.M.yyyy", "dd.MM.yyyy",
             "d.MM.yyyy", "dd.M.yyyy", "yyyy-MM-dd"]
    docs = days.select(F.explode(F.array(*[F.date_format("d", f) for f in forms])).alias("text")).distinct()
    rows = P.pseudonymise(docs.select("text", F.col("text").alias("old")), "k").collect()
    assert len({r.text for r in rows}) == len(rows) > 7000
    assert all(r.n_pseudonyms == 1 and len(r.text) == len(r.old) for r in rows)
    assert all(re.sub(r"\d", "9", r.text) == re.sub(r"\d", "9", r.old) for r in rows)
    again = P.pseudonymise(spark.createDataFrame([(r.text, r.found_kinds[0]) for r in rows], "text string, kind string"), "k")
    assert again.where(F.col("found_kinds")[0] != F.col("kind")).count() == 0
    assert again.where("n_pseudonyms <> 1").count() == 0


def test_candidates_with_more_digits_than_a_long(spark):
    """No card, no phone number, or digits in an address: none of these has a size to permute in."""
    mail = "a1234567890123456789012@example.com"
    texts = ["x 1234567890123456789 y", "+123 4567 8901 2345 6789 0123 z", f"write {mail}, {mail}", "x 1234567890123456785 y"]
    assert luhn("1234567890123456789") % 10 and luhn("1234567890123456785") % 10 == 0
    r = run(spark, texts)
    assert [(x.text, x.n_pseudonyms) for x in r[:2]] == [(t, 0) for t in texts[:2]]
    assert re.fullmatch(r"write (u[0-9a-f]{12}@redacted\.invalid), \1", r[2].text)
    card = re.fullmatch(r"x (1\d{18}) y", r[3].text)[1]
    assert luhn(card) % 10 == 0 and r[3].text != texts[3] and list(r[3].found_kinds) == ["card"]


def test_address_of_many_labels(spark):
    texts = ["to a@" + "b." * 200_000 + "com now", "to a@" + "b.c1" * 100_000 + " now", "to a@" + "1." * 200_000]
    r = run(spark, texts)
    assert re.fullmatch(r"to u[0-9a-f]{12}@redacted\.invalid now", r[0].text)
    assert [(x.text, x.n_pseudonyms) for x in r[1:]] == [(t, 0) for t in texts[1:]]


def test_addresses_end_where_the_plain_pattern_ends_them(spark):
    plain = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}][\p{L}\p{N}._%+-]*+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
    draw = random.Random(5)
    texts = ["".join(draw.choices("ab1-.@ ", (3, 3, 2, 1, 4, 1, 0.3), k=draw.randint(4, 40))) for _ in range(20_000)]
    texts = ["a@" + t if i % 2 else t for i, t in enumerate(texts)]
    d = spark.createDataFrame([(t,) for t in texts], "text string")
    both = d.select("text", *[F.regexp_extract_all("text", F.lit(p), F.lit(0)).alias(n) for p, n in ((plain, "a"), (P.EMAIL, "b"))])
    assert both.where("a <> b").count() == 0 and both.where("size(a) > 0").count() > 2000


def test_long_text_repeats_and_empty_table(spark):
    text = ("word " * 20000) + "4556737586899855" + (" word" * 20000)
    r = run(spark, [text, text])
    assert r[0].text == r[1].text and len(r[0].text) == len(text) and r[0].n_pseudonyms == 1
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert P.pseudonymise(docs, "k").count() == 0


def test_query_is_native(spark):
    from demandlake.llm.queries import op3_pii_feistel
    out = op3_pii_feistel(spark, "/root/testdata/sf0.001")
    plan = out._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan
    before = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    for r in out.collect():
        assert (r.text == before[r.doc_id]) == (r.n_pseudonyms == 0)
        for number in re.findall(r"(?<!\d)\d{16}(?!\d)", before[r.doc_id]):
            assert (number in r.text) == (luhn(number) % 10 != 0)
        for mail in re.findall(r"[\w.]+@[\w.]+\w", before[r.doc_id]):
            assert mail not in r.text
