"""End-to-end plans, policy, pages, model, CSV and streams."""

import math
import shutil
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from scamsift.functions import text as text_functions
from scamsift.operators import evaluate, fusion, model, policy, rules
from scamsift.plans import fixtures, score
from scamsift.sources import corpus, csv_io, feed, pages
from scamsift.streaming import health, messages

MSG = "msg_id int, text string, sender string"


def verdicts(spark, texts, **options):
    return {r.msg_id: r for r in score.score(spark.createDataFrame(list(enumerate(texts)), "msg_id int, text string"), **options).collect()}


def test_scores(spark):
    got = verdicts(spark, [None, "", "buy a gift card and send the code", "hello", "see xn--pypal-4ve.com", "раураl: verify your account at http://paypa1.com/login now"])
    assert [got[i].verdict for i in range(4)] == ["safe", "safe", "dangerous", "safe"]
    assert got[2].score == math.floor(100 * (1 - math.exp(-3.0 / 2.6)) + 0.5) and got[2].reasons[0].id == "gift_card_payment"
    assert "lookalike_domain" in {s.id for s in got[4].signals}
    assert all(0 <= r.score <= 100 for r in got.values())


def test_model_alone_is_never_dangerous(spark):
    w = model.Weights(spark.createDataFrame([("aa", 0, 1.0, 90.0), ("bb", 1, 1.0, 90.0), ("cc", 2, 1.0, 90.0)], "term string, idx int, idf double, coef double"), 0.0)
    got = verdicts(spark, ["aa bb cc", "aa bb"], weights=w)
    assert got[0].score == 50 and got[0].verdict == "suspicious" and got[0].model.available and got[1].score == 0 and not got[1].model.available
    assert [t.term for t in got[0].model.matched_terms] == ["aa", "bb", "cc"]


def test_feed_and_redirects(spark):
    lines = spark.createDataFrame([("# x",), ("",), ('"1","http://bad.example.com/a/"',), ("http://bad.example.com/a",)], "value string")
    entries = feed.entries(lines)
    assert [r.entry for r in entries.collect()] == ["http://bad.example.com/a"]
    table = spark.createDataFrame([("https://bit.ly/q", "http://paypa1.com/login")], "url string, destination string")
    got = verdicts(spark, ["look http://bad.example.com/a/", "look http://bit.ly/q"], feed=entries, redirect_table=table)
    assert got[0].signals[-1].id == "urlhaus_match" and not got[0].shortener_resolved
    assert got[1].shortener_resolved and "lookalike_domain" in {s.id for s in got[1].signals}


def test_scan_lists(spark):
    rows = spark.createDataFrame([(0, "buy a gift card, send it", " A@x "), (1, "hi", "b@x"), (2, "hi", None)], MSG)
    listed = lambda *xs: spark.createDataFrame([(x,) for x in xs], "sender string")
    got = {r.msg_id: (r.gate, r.verdict, r.score) for r in score.scan(rows, listed("a@X"), listed("a@x", "B@x ")).collect()}
    assert got == {0: ("allow", None, None), 1: ("block", "dangerous", 100), 2: ("score", "safe", 0)}


def test_second_opinion_keeps_the_floor(spark):
    v = score.score(spark.createDataFrame([(0, "buy a gift card and send the code"), (1, "hi"), (2, "hi")], "msg_id int, text string"))
    o = spark.createDataFrame([(0, 10.0, "e", ["It wants to be paid in gift cards, which can't be traced."], "a", False, True), (1, 70.4, "e", ["odd"], "a", False, True), (2, None, None, None, None, True, True)], "msg_id int, score double, explanation string, reasons array<string>, advice string, failed boolean, sent boolean")
    got = {r.msg_id: r for r in fusion.merge_opinions(v, o).collect()}
    assert (got[0].score, got[0].verdict, len(got[0].reasons)) == (65, "dangerous", 1)
    assert (got[1].score, got[1].verdict, got[1].reasons[0].detail) == (70, "dangerous", "odd")
    assert got[2].tier == "second-opinion-failed" and got[2].reached and got[2].verdict == "safe"


PAGE = """<html><head><title> Sign in - Zenith </title><script>var a='x@y.zz'</script></head><body><h1>Hi</h1><p>Write  to Me@x.example.com</p>
<form action="/post"><input type=password><input type=hidden name=otp><input name="mpin"></form><form action="https://drop.net/p"></form><a href="mailto:You@x.org?s=1">m</a><a href="b?c">l</a><a href="javascript:x">j</a></body></html>"""


def test_pages(spark):
    p = pages.collected(spark.createDataFrame([(1, PAGE, "http://a.com/d/e"), (2, None, None)], "page_id int, html string, url string"))
    got = {r.page_id: r.page for r in p.collect()}
    assert got[1].title == "Sign in - Zenith" and got[1].credential_fields == ["password", "otp"] and got[1].emails == ["me@x.example.com", "you@x.org"]
    assert got[1].form_targets == ["http://a.com/post", "https://drop.net/p"] and got[1].extra_urls == ["http://a.com/d/e", "http://a.com/d/b?c", "http://a.com/post", "https://drop.net/p"]
    assert got[2].text == "" and got[2].extra_urls == []
    assert {r.page_id for r in score.score_pages(p).collect()} == {1, 2}


def test_site_pages(spark, sf):
    rows = {r.genre: r for r in score.score(fixtures.site_pages(spark, sf).where("msg_id < 8")).collect()}
    ids = lambda g: {s.id: s.weight for s in rows[g].signals}
    assert ids("impersonation")["brand_impersonation"] == 2.6 and "offsite_credential_post" in ids("impersonation")
    assert [ids(g).get("offsite_credential_harvest") for g in ("harvest_claimed", "harvest_thin_two", "harvest_thin", "hosted", "sso", "genuine")] == [3.0, 2.2, 1.6, None, None, None]


def test_adapters(spark):
    html = "<div role='listitem'><span email='A@b.c'>x</span><div class='a3s'>A message that is long enough to count.</div></div>"
    df = spark.createDataFrame([("https://mail.google.com/x", html), ("https://n.org", "<article>Another message that is long enough.<p>x</p></article>")], "url string, html string")
    got = {r.adapter: r for r in pages.messages(df).collect()}
    assert got["gmail"].sender == "a@b.c" and got["generic"].msg_id.startswith("gen-")
    h = 5381
    for c in f"a@b.c|{got['gmail'].text}":
        h = (h * 33 + ord(c)) & 0xFFFFFFFF
    digits, out = "0123456789abcdefghijklmnopqrstuvwxyz", ""
    while h:
        h, d = divmod(h, 36)
        out = digits[d] + out
    assert got["gmail"].msg_id == f"gm-{out}"


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([("=1", ["a", "b"], None), ('q"q\nr', [], "x")], "a string, b array<string>, c string")
    assert [r.value for r in csv_io.lines(df).collect()] == ['"\'=1","a | b",""', '"q""q\nr","","x"']
    csv_io.write_csv(df, str(tmp_path / "o"))
    (tmp_path / "h.csv").write_text('# one\n# two\ngenre,text\nbank,"a, ""b""\n# kept"\nshop,plain\n')
    assert [tuple(r) for r in csv_io.held_out(spark, str(tmp_path / "h.csv")).collect()] == [("bank", 'a, "b"\n# kept'), ("shop", "plain")]


def test_history(spark):
    rows = [(i, f"2024-01-0{i + 1}", f"t{i % 3}", "s", "manual", i) for i in range(7)]
    df = spark.createDataFrame(rows, "msg_id int, d string, text string, sender string, source string, score int").withColumn("timestamp", F.to_timestamp("d"))
    got = [(r.text, r.score, r.position) for r in policy.history(df, keep=2).orderBy("position").collect()]
    assert got == [("t1", 4, 0), ("t2", 5, 1)]
    assert policy.history_view(policy.history(df)).first().position == 2


def test_health_batch_is_the_fold(spark, tmp_path):
    scans, state = [], (0, 0)
    for i, (count, threw, landmark, has) in enumerate([(0, False, True, True)] * 4 + [(1, False, True, True), (0, False, False, True), (0, True, True, True)] + [(0, False, True, True)] * 3 + [(0, False, False, False)]):
        scans.append(("t", "gmail", i * 4000, count, threw, landmark, has))
    want = []
    for s in scans:
        state, status = health.step(state, *s[2:])
        want.append(status)
    assert want[:5] == ["watching", "watching", "watching", "broken", "ok"]
    df = spark.createDataFrame(scans, health.SCAN)
    assert [r.status for r in health.health(df).orderBy("now_ms").collect()] == want
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = health.health_stream(spark.readStream.schema(health.SCAN).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("health_out").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.status for r in spark.table("health_out").orderBy("now_ms").collect()] == want


def test_training_separates(spark, sf):
    m = fixtures.messages(spark, sf).where("msg_id < 250")
    w = model.fit(m, max_features=300, max_iter=30)
    scored = m.join(model.score(m, w), "msg_id").withColumn("p", (F.col("model.probability") >= 0.5).cast("int"))
    assert evaluate.confusion(scored, F.col("p")).first().accuracy > 0.95


def test_curve():
    assert abs(100 * (1 - math.exp(-1.12 / 2.6)) - 35) < 0.5 and abs(100 * (1 - math.exp(-2.73 / 2.6)) - 65) < 0.5
    assert len({r.id for r in rules.RULES}) == 23


def test_history_goes_on_from_batch_to_batch(spark, tmp_path):
    shape = "msg_id int, timestamp timestamp, text string, sender string, source string, score int"
    day = lambda i: datetime(2024, 1, i + 1)
    batches = [[(0, day(0), "a", "s", "manual", 1), (1, day(1), "b", "s", "manual", 2)], [(2, day(2), "c", "s", "manual", 3), (3, day(3), "a", "s", "manual", 4)], [(4, day(4), "b", "s", "manual", 5)]]
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, shape).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    q = messages.history_writer(stream, str(tmp_path / "out"), keep=3).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = [(r.text, r.score, r.position) for r in spark.read.parquet(str(tmp_path / "out/epoch=2")).orderBy("position").collect()]
    assert got == [("a", 4, 0), ("b", 5, 1), ("c", 3, 2)]  # a scan that comes again stays in its place
    whole = policy.history(spark.createDataFrame([r for b in batches for r in b], shape), keep=3)
    assert got == [(r.text, r.score, r.position) for r in whole.orderBy("position").collect()]


def test_side_table_survives_a_broken_source(spark, tmp_path):
    spark.createDataFrame([(1,)], "k int").write.parquet(str(tmp_path / "in/0"))
    spark.createDataFrame([("x", 1)], "v string, k int").write.parquet(str(tmp_path / "side"))
    stream = spark.readStream.schema("k int").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    seen = []

    def go():
        writer = messages.with_static(stream, lambda: spark.read.parquet(str(tmp_path / "side")), lambda rows, side: rows.join(side, "k"), lambda df, epoch: seen.extend((epoch, r.v) for r in df.collect()), str(tmp_path / "kept"))
        q = writer.option("checkpointLocation", str(tmp_path / "ck")).start()
        q.processAllAvailable()
        q.stop()

    go()
    shutil.rmtree(tmp_path / "side")
    spark.createDataFrame([(1,)], "k int").write.parquet(str(tmp_path / "in/1"))
    go()
    assert [v for _, v in seen].count("x") >= 2 and len({e for e, _ in seen}) >= 2


def test_settled_pages_and_resets(spark):
    t = lambda ms: datetime(2024, 1, 1) + timedelta(milliseconds=ms)
    scans = spark.createDataFrame([("p", t(0), 1), ("p", t(500), 2), ("p", t(1600), 3), ("p", t(9000), 4), ("q", t(0), 5)], "page string, ts timestamp, n int")
    assert sorted(r.n for r in messages.settled(scans).collect()) == [3, 4, 5]
    marks = spark.createDataFrame([("a", t(0), 1), ("a", t(50), 2), ("b", t(0), 3), ("c", t(40), 4)], "tab string, ts timestamp, n int")
    resets = spark.createDataFrame([("a", t(20)), (None, t(5))], "tab string, ts timestamp")
    assert sorted(r.n for r in messages.since_reset(marks, resets).collect()) == [2, 4]
    assert messages.since_reset(marks, resets.limit(0)).count() == 4


def test_opinions_are_held_to_their_contract(spark):
    v = score.score(spark.createDataFrame([(i, "hi " * 9000) for i in range(4)], "msg_id int, text string"))
    o = spark.createDataFrame([(0, 250.0, None, list("abcd"), None, False, True), (1, -5.0, "e", None, "a", False, True), (2, float("nan"), "e", [], "a", False, True)], "msg_id int, score double, explanation string, reasons array<string>, advice string, failed boolean, sent boolean")
    got = {r.msg_id: r for r in fusion.merge_opinions(v, o).collect()}
    assert [got[i].score for i in range(3)] == [100, 0, 0] and [r.detail for r in got[0].reasons] == ["a", "b", "c"] and got[0].explanation == "" and got[3].tier == "local"
    asked = fusion.opinion_requests(v.withColumn("escalate", F.lit(True))).first()
    assert len(asked.text) == 12_000 and asked.signals == []


def test_analysis_obeys_settings(spark):
    rows = spark.createDataFrame([(0, "see http://bad.example.com/a", "x"), (1, "see http://bit.ly/q", "x"), (2, "aa bb cc", "x"), (3, "buy a gift card and send the code", "Ok@x"), (4, "hi", "bad@x")], "msg_id int, text string, sender string")
    feed_ = spark.createDataFrame([("http://bad.example.com/a",)], "entry string")
    moved = spark.createDataFrame([("https://bit.ly/q", "http://paypa1.com/login")], "url string, destination string")
    w = model.Weights(spark.createDataFrame([(t, i, 1.0, 90.0) for i, t in enumerate(("aa", "bb", "cc"))], "term string, idx int, idf double, coef double"), 0.0)
    o = spark.createDataFrame([(2, 90.0, "e", ["odd"], "a", False, True)], "msg_id int, score double, explanation string, reasons array<string>, advice string, failed boolean, sent boolean")
    base = policy.Settings(allowlist=("ok@X",), blocklist=("bad@x",))
    run = lambda s: {r.msg_id: r for r in score.analyze(rows, s, w, feed_, moved, o).collect()}
    some = run(base)
    assert [some[i].gate for i in range(5)] == ["score", "score", "score", "allow", "block"] and some[0].verdict == "safe" and some[2].verdict == "suspicious" and some[3].verdict is None and some[4].score == 100
    every = run(base.merged({"use_feed": True, "resolve_shorteners": True, "second_opinion": True, "min_severity": "dangerous", "other": 1}))
    assert every[0].verdict == "dangerous" and every[1].verdict == "dangerous" and (every[2].score, every[2].tier) == (90, "second-opinion") and [every[i].shown for i in range(5)] == [True, True, True, False, True]
    assert run(base.merged({"use_model": False}))[2].score == 0


def test_rules_in_batches_are_those_in_columns(spark):
    texts = [t.replace("~n", "123").replace("~u", "7") for _, _, t in fixtures.TEMPLATES] + ["", "share your otp. do not tell anyone", "never share your otp with anyone. do not tell anyone about this", "parcel delayed. pay the fee. reschedule it", "crypto now. send it. you", "fire in firm"]
    df = spark.createDataFrame(list(enumerate(texts)), "msg_id int, text string").select("msg_id", text_functions.rule_text(F.col("text")).alias("t"))
    every = (*rules.RULES, *rules.EXONERATING)
    no = {"has_credential_form": F.lit(False), "on_official_domain": F.lit(False)}
    judge = rules.Judge()
    for part in (every[:9], every[9:18], every[18:]):
        for r in df.select("msg_id", "t", *[x.column(F.col("t"), no).alias(x.id) for x in part]).collect():
            held = {every[i].id for i in judge.one(r.t, {"has_credential_form": False, "on_official_domain": False})}
            assert {x.id for x in part if r[x.id]} == held & {x.id for x in part}, r.t


def test_words_that_patterns_need():
    from scamsift.operators.logic import words_of

    assert words_of(r"\b(?:pay|fees?)\b") == {"pay", "fee"} and words_of(r"gift\s*card|voucher") >= {"voucher"} and words_of(r"\d+|x") is None and words_of(r"ab?cd") == {"cd"}
    assert rules.Judge().finder("zz warrant-voucher") >= {"voucher"}


def test_corpus_from_mail_and_templates(spark, tmp_path):
    (tmp_path / "m.mbox").write_text("From a Mon\nSubject: One\nX: y\n\nBody of one which is long enough to be kept <b>here</b>.\n> quoted\n\nFrom b Tue\r\nSubject: Two\r\n\r\nBody of two which is long enough to be kept, write to a@b.example.com.\n")
    mails = corpus.read_mbox(spark, str(tmp_path / "m.mbox"))
    assert sorted((r.subject, r.body[:11]) for r in mails.collect()) == [("One", "Body of one"), ("Two", "Body of two")]
    kept = corpus.harvest(mails.union(mails), 0, 10).collect()
    assert len(kept) == 2 and any("<email>" in r.text for r in kept) and not any("quoted" in r.text for r in kept) and corpus.harvest(mails, 0, 1).count() == 1
    made = corpus.from_templates(spark, [("pay {who} now", 1), ("hi {who}", 0)], {"who": ["a", "b", "c"]}, 6)
    assert made.count() == made.distinct().count() <= 6 and {r.label for r in made.collect()} <= {0, 1}


def test_weights_are_kept(spark, tmp_path):
    w = model.Weights(spark.createDataFrame([("aa", 0, 1.23456789, -0.5), ("bb", 1, 1.0, 0.0)], "term string, idx int, idf double, coef double"), 0.25)
    model.save(w, str(tmp_path / "w"))
    back = model.load(spark, str(tmp_path / "w"))
    assert {tuple(r) for r in back.terms.collect()} == {("aa", 0, 1.234568, -0.5), ("bb", 1, 1.0, 0.0)} and back.intercept == 0.25 and model.describe(back, note="x")["vocab_size"] == 2
    rows = spark.createDataFrame([(f"{w} {x} one two three", y) for y, w in ((0, "calm"), (1, "rush")) for x in ("aa", "bb", "cc", "dd", "ee", "ff", "gg", "hh")], "text string, label int")
    assert len(evaluate.cross_validate(rows, folds=2, min_df=1, max_iter=20)) == 2


def test_odd_message_ids(spark):
    df = spark.createDataFrame([("😀 hi", "a")], "t string, s string")
    got = df.select(pages.message_id(F.lit("gm"), F.col("t"), F.col("s")).alias("x")).first().x
    data, h = "a|😀 hi".encode("utf-16-be"), 5381
    for i in range(0, len(data), 2):
        h = (h * 33 + int.from_bytes(data[i : i + 2], "big")) & 0xFFFFFFFF
    assert int(got.removeprefix("gm-"), 36) == h
