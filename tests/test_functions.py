"""Text and domain functions against plain versions and known vectors."""

import unicodedata

import pytest
from pyspark.sql import functions as F

from scamsift.functions import domains as D
from scamsift.functions import text as X
from scamsift.functions.constants import FIXTURE_SUFFIXES

TEXTS = ["Ｐａｙ ０ney", "раураӏ", "Σ Þ Γ", "café CAFÉ", "हिंदी क़लम", "a b　c\t", "$500 @home 13457", "", None, "ﬁne 😀 ½"]


def plain(text, digits=True):
    t = unicodedata.normalize("NFKD", text or "").translate(str.maketrans(X.confusables()))
    t = t.translate(str.maketrans(*X.LEET)) if digits else t
    t = "".join(c for c in t.lower() if not 0x300 <= ord(c) <= 0x36F)
    return " ".join(t.split())


def test_fold(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    for digits in (True, False):
        for r in df.select("t", X.normalize(F.col("t"), digits).alias("n")).collect():
            assert r.n == plain(r.t, digits)


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


def test_extractors(spark):
    t = "Mail a.b@x.example.com or see https://Ex.com/a?b=1). Also www.foo.org, foo.org/x; call +1 (555) 123-4567 or 12345."
    assert one(spark, X.emails(F.col("t")), t=t) == ["a.b@x.example.com"]
    assert one(spark, X.urls(F.col("t")), t=t) == ["a.b", "x.example.com", "https://Ex.com/a?b=1", "www.foo.org", "foo.org/x"] or one(spark, X.urls(F.col("t")), t=t)[-3:] == ["https://Ex.com/a?b=1", "www.foo.org", "foo.org/x"]
    assert one(spark, X.phones(F.col("t")), t=t) == ["+1 (555) 123-4567"]
    assert one(spark, X.tokens(F.col("t")), t="Hi a हिंदी है x_1") == ["hi", "हिंदी", "है", "x_1"]
    assert one(spark, X.ngrams(X.tokens(F.col("t")), 3), t="aa bb cc") == ["aa", "bb", "cc", "aa bb", "bb cc", "aa bb cc"]
    assert one(spark, X.ngrams(X.tokens(F.col("t")), 2), t="") == []
    assert one(spark, X.truncate(F.col("t"), 5), t="abc  defg") == "abc d…"


HOSTS = {
    "http://www.Example.com/x": "example.com", "ex.com:80/a": "ex.com", "http://a@b.com": "b.com", "http://1.2.3": "1.2.0.3", "http://0x7f.1": "127.0.0.1", "http://пример.рф/": "xn--e1afmkfd.xn--p1ai", "http://a b.com": None, "": None, None: None, "http://x.com:99999": None,
}


@pytest.mark.parametrize("url", HOSTS)
def test_host(url):
    assert D.host_of(url) == HOSTS[url]


def test_punycode():
    assert D.punycode_to_unicode("xn--e1afmkfd.com") == "пример.com"
    assert D.punycode_to_unicode("xn--\x80.com") == "xn--\x80.com" and D.punycode_to_unicode("a.com") == "a.com"


DOMAINS = {
    "a.b.co.uk": "b.co.uk", "co.uk": "co.uk", "x.github.io": "x.github.io", "y.x.github.io": "x.github.io", "a.b.c.kawasaki.jp": "b.c.kawasaki.jp", "city.kawasaki.jp": "city.kawasaki.jp",
    "a.city.kawasaki.jp": "city.kawasaki.jp", "a.b.unknowntld": "b.unknowntld", "localhost": "localhost", "www.ck": "www.ck", "a.b.ck": "a.b.ck", "shop.com.mx": "shop.com.mx", "a.shop.co.za": "shop.co.za", "x.y.com.sg": "y.com.sg", "a.b.gov.br": "b.gov.br", "com.mx": "com.mx",
}


def test_registrable_domain(spark):
    df = spark.createDataFrame([(h,) for h in DOMAINS], "h string")
    assert {r.h: r.d for r in df.select("h", D.registrable_domain(F.col("h")).alias("d")).collect()} == DOMAINS
    assert len(D.public_suffixes()) > 9000 and set(FIXTURE_SUFFIXES) - set(D.public_suffixes()) <= {"sbi", "ck", "kawasaki.jp"}
    few = ("com", "*.ck", "!www.ck")
    assert {r.h: r.d for r in df.where("h like '%.ck' or h like '%.mx'").select("h", D.registrable_domain(F.col("h"), few).alias("d")).collect()} == {"www.ck": "www.ck", "a.b.ck": "a.b.ck", "shop.com.mx": "com.mx", "com.mx": "com.mx"}


def test_public_lists_from_files(spark, tmp_path):
    (tmp_path / "psl").write_text("// a comment\n\ncom.mx\n*.ck  // more\n!www.ck\n", encoding="utf-8")
    assert D.load_suffixes(spark, str(tmp_path / "psl")) == ("com.mx", "*.ck", "!www.ck")
    (tmp_path / "looks").write_text("\ufeff# x\n0430 ;\t0061 ;\tMA\n0660 ;\t006F ;\tMA\n00E9 ;\t0065 ;\tMA\n0222 ;\t0038 ;\tMA\n13A2 ;\t0069 ;\tMA\n0132 ;\t006C 004A ;\tMA\n", encoding="utf-8")
    assert X.load_confusables(spark, str(tmp_path / "looks")) == {"а": "a", "Ꭲ": "i"}
    known = X.confusables()
    some = {"а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "х": "x", "і": "i", "ѕ": "s", "ӏ": "l", "ј": "j", "α": "a", "ο": "o", "ρ": "p", "ν": "v", "σ": "o", "ⲟ": "o", "օ": "o", "ꓐ": "B", "𐐬": "o"}
    assert {c: known.get(c) for c in some} == some and not any(0x900 <= ord(c) <= 0x97F or c.isascii() for c in known)


LIKE = {
    "paypal.com": None, "secure.paypal.com": None, "paypa1.com": "homoglyph", "xn--pypal-4ve.com": "homoglyph", "paypal.evil.net": "subdomain", "paypal-secure.com": "compound", "paypol.com": "typo", "example.org": None, "amazon.co.uk": "subdomain", "microsofd.com": "typo",
}


def test_lookalike(spark):
    df = spark.createDataFrame([(h,) for h in LIKE], "h string")
    got = df.select("h", D.parse_urls(F.array("h"))[0]["like"]["kind"].alias("k"))
    assert {r.h: r.k for r in got.collect()} == LIKE
    fair = df.select("h", D.parse_urls(F.array("h"), genuine_first=True)[0]["like"]["kind"].alias("k"))
    assert {r.h: r.k for r in fair.collect()}["amazon.co.uk"] is None


def test_distance_and_scripts(spark):
    assert one(spark, D.edit_distance(F.col("a"), F.col("b"), 2), a="kitten", b="sitting") == 3
    assert one(spark, D.mixes_scripts(F.col("a")), a="pаypal.com") and not one(spark, D.mixes_scripts(F.col("a")), a="пример.com")
