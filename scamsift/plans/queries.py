"""The registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import domains as D
from ..functions import text as X
from ..operators import evaluate, fusion, impersonation, model, policy, rules, url_signals
from ..sources import corpus, csv_io, feed, pages
from ..streaming import health, messages as streams
from . import fixtures, oracle, score

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def scored(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return score.score(fixtures.messages(spark, sf_dir), **options)


MSGS = "WITH " + oracle.messages() + " "

# --- text ------------------------------------------------------------------------------


@query(MSGS + f"SELECT msg_id, {oracle.normalize('text')} AS norm, {oracle.normalize('text', False)} AS norm_digits FROM msgs")
def q_normalize_msgs(spark, sf_dir):
    m = fixtures.messages(spark, sf_dir)
    return m.select("msg_id", X.normalize(F.col("text")).alias("norm"), X.normalize(F.col("text"), digits=False).alias("norm_digits"))


@query(MSGS + f"SELECT msg_id, {oracle.rule_text('text')} AS t FROM msgs")
def q_rule_text(spark, sf_dir):
    return fixtures.messages(spark, sf_dir).select("msg_id", X.rule_text(F.col("text")).alias("t"))


@query()
def q_fold_documents(spark, sf_dir):
    """The full fold, decomposition included, over whole texts; held against a plain version in the tests."""
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.md5(X.normalize(F.col("text")).cast("binary")).alias("digest"))


@query(f"SELECT doc_id, unnest(list_distinct(list_transform(regexp_extract_all(text, {oracle.q(X.EMAIL)}), lambda e: lower(e)))) AS email FROM documents")
def q_extract_emails(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.explode(X.emails(F.col("text"))).alias("email"))


@query(f"SELECT doc_id, unnest(list_distinct(list_filter(list_transform(regexp_extract_all(text, {oracle.q(X.PHONE)}), lambda p: trim(p)), lambda p: length(regexp_replace(p, '\\D', '', 'g')) >= 8))) AS phone FROM documents")
def q_extract_phones(spark, sf_dir):
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.explode(X.phones(F.col("text"))).alias("phone"))


@query(MSGS + f"SELECT msg_id, unnest({oracle.urls('text')}) AS url FROM msgs")
def q_extract_urls(spark, sf_dir):
    return fixtures.messages(spark, sf_dir).select("msg_id", F.explode(X.urls(F.col("text"))).alias("url"))


_TOKENS = "(SELECT unnest(" + oracle.tokens("text") + ") AS token FROM documents)"


@query(f"SELECT token, count(*) AS n FROM {_TOKENS} GROUP BY token ORDER BY n DESC, token LIMIT 100")
def q_tokens_topk(spark, sf_dir):
    """A report: the 100 most frequent tokens."""
    each = table(spark, sf_dir, "documents", "text").select(F.explode(X.tokens(F.col("text"))).alias("token"))
    return each.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(100)


@query(f"""WITH w AS (SELECT doc_id, {oracle.tokens('text')} AS ws FROM documents), u AS (SELECT doc_id, unnest(ws) AS a, generate_subscripts(ws, 1) AS i FROM w),
b AS (SELECT a || ' ' || lead(a) OVER (PARTITION BY doc_id ORDER BY i) AS bigram FROM u) SELECT bigram, count(*) AS n FROM b WHERE bigram IS NOT NULL GROUP BY bigram ORDER BY n DESC, bigram LIMIT 100""")
def q_bigrams_topk(spark, sf_dir):
    """A report: the 100 most frequent bigrams."""
    each = table(spark, sf_dir, "documents", "text").select(F.explode(X.ngrams(X.tokens(F.col("text")), 2)).alias("bigram")).where(F.col("bigram").contains(" "))
    return each.groupBy("bigram").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "bigram").limit(100)


@query(MSGS + f"SELECT msg_id, CASE WHEN length({oracle.squeeze('text')}) > 60 THEN substr({oracle.squeeze('text')}, 1, 60) || '…' ELSE {oracle.squeeze('text')} END AS short FROM msgs")
def q_truncate(spark, sf_dir):
    return fixtures.messages(spark, sf_dir).select("msg_id", X.truncate(F.col("text")).alias("short"))


@query(f"""WITH a AS (SELECT event_id, floor((epoch_ms({fixtures.WORDS_AGO}) - epoch_ms(ts)) / 60000.0 + 0.5) :: BIGINT AS m FROM events),
b AS (SELECT event_id, m, floor(m / 60.0 + 0.5) :: BIGINT AS h, floor(floor(m / 60.0 + 0.5) / 24.0 + 0.5) :: BIGINT AS d FROM a)
SELECT event_id, CASE WHEN m < 1 THEN 'just now' WHEN m < 60 THEN m || 'm ago' WHEN h < 24 THEN h || 'h ago' ELSE d || 'd ago' END AS ago FROM b""")
def q_relative_time(spark, sf_dir):
    return table(spark, sf_dir, "events", "event_id", "ts").select("event_id", X.relative_time(F.col("ts"), F.expr(fixtures.WORDS_AGO)).alias("ago"))


@query(f"SELECT conv_id, turn, length(text) :: BIGINT AS n FROM conversations WHERE length(trim(text)) BETWEEN {pages.MIN_CHARS} AND {pages.MAX_CHARS}")
def q_usable_messages(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    return rows.where(F.length(F.trim("text")).between(pages.MIN_CHARS, pages.MAX_CHARS)).select("conv_id", "turn", F.length("text").cast("long").alias("n"))


# --- rules -----------------------------------------------------------------------------


def _ruled(spark, sf_dir):
    m = X.once(fixtures.messages(spark, sf_dir), t=X.rule_text(F.col("text")))
    return rules.evaluate(m, "t")


_EXPECTED = ", ".join(f"('{genre}', '{rule}')" for genre, ids in fixtures.EXPECTED.items() for rule in ids)


@query(MSGS + f", expected(genre, rule_id) AS (VALUES {_EXPECTED}) SELECT rule_id, genre, count(*) AS n FROM msgs JOIN expected USING (genre) GROUP BY ALL")
def q_rule_hits(spark, sf_dir):
    return _ruled(spark, sf_dir).select("genre", F.explode("rule_signals.id").alias("rule_id")).groupBy("rule_id", "genre").agg(F.count(F.lit(1)).alias("n"))


def _rule_query(rule: rules.Rule, i: int) -> None:
    def one(spark, sf_dir):
        m = X.once(fixtures.messages(spark, sf_dir), t=X.rule_text(F.col("text")))
        no = {"has_credential_form": F.lit(False), "on_official_domain": F.lit(False)}
        return m.select("msg_id", rule.body.column(F.col("t"), no).alias("hit"))

    one.__name__ = f"q_rule_{rule.id}"
    context = {"has_credential_form": "false", "on_official_domain": "false"}
    query(f"WITH {oracle.messages()}, normal AS (SELECT msg_id, {oracle.rule_text('text')} AS t FROM msgs) SELECT msg_id, {rule.body.sql('t', context)} AS hit FROM normal")(one)


for _i, _rule in enumerate((*rules.RULES, *rules.EXONERATING)):
    _rule_query(_rule, _i)


@query(oracle.rules_only("SELECT msg_id, round(greatest(0.0, blame + relief), 6) AS rule_score, len(rule_signals) :: INT AS n_signals, no_ask FROM heur"))
def q_rule_score(spark, sf_dir):
    return _ruled(spark, sf_dir).select("msg_id", F.round("rule_score", 6).alias("rule_score"), F.size("rule_signals").alias("n_signals"), "no_ask")


# --- links -----------------------------------------------------------------------------


@query(f"SELECT DISTINCT {oracle.host('url')} AS host, {D.registrable_sql(oracle.host('url'))} AS domain FROM pages")
def q_registrable_domain(spark, sf_dir):
    u = F.explode(D.parse_urls(F.array("url")))
    return table(spark, sf_dir, "pages", "url").select(u.alias("u")).select("u.host", "u.domain").distinct()


@query(oracle.links_only("SELECT domain, count(*) AS n, count(DISTINCT host) AS n_hosts FROM links GROUP BY domain"))
def q_domain_counts(spark, sf_dir):
    u = fixtures.messages(spark, sf_dir).select(F.explode(D.parse_urls(X.urls(F.col("text")))).alias("u")).select("u.host", "u.domain")
    return u.groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("host").alias("n_hosts"))


def _suffix_sql() -> str:
    """Hosts under every rule of the whole list, and their registrable domains, by joins with the rules."""
    rules = oracle.suffix_rules()
    listed = ", ".join(oracle.q(r) for r in rules)
    return f"""WITH rules AS (SELECT unnest([{listed}]) AS rule, unnest(range({len(rules)})) AS i),
    h AS (SELECT o_orderkey, 'shop' || o_orderkey || '.x.' || regexp_replace(rule, '^(\\*\\.|!)', '') AS host FROM orders JOIN rules ON o_orderkey % {len(rules)} = i),
    t AS (SELECT o_orderkey, host, string_split(host, '.') AS l, unnest(range(len(string_split(host, '.')))) AS k FROM h),
    tails AS (SELECT *, array_to_string(l[k + 1:], '.') AS tail, array_to_string(l[k + 2:], '.') AS rest FROM t),
    marked AS (SELECT o_orderkey, host, l, k, e.rule IS NOT NULL AS excepted, x.rule IS NOT NULL OR w.rule IS NOT NULL AS known FROM tails
      LEFT JOIN rules e ON e.rule = '!' || tail LEFT JOIN rules x ON x.rule = tail LEFT JOIN rules w ON rest != '' AND w.rule = '*.' || rest),
    m AS (SELECT o_orderkey, any_value(host) AS host, any_value(l) AS l, coalesce(min(CASE WHEN excepted THEN k + 1 END), min(CASE WHEN known THEN k END)) AS s FROM marked GROUP BY o_orderkey)
    SELECT o_orderkey, host, CASE WHEN s = 0 THEN host WHEN s IS NULL THEN array_to_string(l[-2:], '.') ELSE array_to_string(l[s:], '.') END AS domain FROM m"""


@query(_suffix_sql())
def q_public_suffix(spark, sf_dir):
    rules = D.public_suffixes()
    numbered = spark.createDataFrame([(i, r.removeprefix("*.").removeprefix("!")) for i, r in enumerate(rules)], "i int, rule string")
    orders = table(spark, sf_dir, "orders", "o_orderkey").withColumn("i", (F.col("o_orderkey") % len(rules)).cast("int"))
    hosts = orders.join(F.broadcast(numbered), "i").select("o_orderkey", F.concat(F.lit("shop"), F.col("o_orderkey").cast("string"), F.lit(".x."), "rule").alias("host"))
    return hosts.select("o_orderkey", "host", D.registrable_domain(F.col("host")).alias("domain"))


def _described(spark, sf_dir):
    m = fixtures.messages(spark, sf_dir)
    return X.once(m, links=D.parse_urls(X.urls(F.col("text"))))


@query(oracle.links_only("SELECT msg_id, host, brand, legit, kind FROM links WHERE kind IS NOT NULL"))
def q_lookalike(spark, sf_dir):
    each = _described(spark, sf_dir).select("msg_id", F.explode("links").alias("l")).where("l.like is not null")
    return each.select("msg_id", "l.host", "l.like.brand", "l.like.legit", "l.like.kind")


@query(oracle.links_only("SELECT msg_id, id, weight, count(*) AS n FROM url_signals GROUP BY ALL"))
def q_url_signals(spark, sf_dir):
    each = _described(spark, sf_dir).select("msg_id", F.explode(url_signals.link_signals(F.col("links"))).alias("s"))
    return each.groupBy("msg_id", "s.id", "s.weight").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT a.n_name AS a, b.n_name AS b, CASE WHEN levenshtein(lower(a.n_name), lower(b.n_name)) > 4 THEN 5 ELSE levenshtein(lower(a.n_name), lower(b.n_name)) END :: INT AS d FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def q_edit_distance(spark, sf_dir):
    n = table(spark, sf_dir, "nation", "n_name", "n_regionkey")
    a, b = n.withColumnRenamed("n_name", "a"), n.withColumnRenamed("n_name", "b")
    return a.join(b, "n_regionkey").select("a", "b", D.edit_distance(F.lower("a"), F.lower("b"), 4).cast("int").alias("d"))


def _feed(spark, sf_dir) -> DataFrame:
    """A feed of plain and CSV lines with comments, made of some events."""
    e = table(spark, sf_dir, "events", "event_id")
    n = F.col("event_id").cast("string")
    line = F.when(F.col("event_id") % 3 == 0, "# comment").when(F.col("event_id") % 3 == 2, F.concat(F.lit('"x","http://win-big'), n, F.lit('.top/claim/","online"'))).otherwise(F.concat(F.lit("https://bit.ly/x"), n, F.lit("//")))
    return feed.entries(e.select(line.alias("value")))


_FEED = "feed AS (SELECT CASE WHEN event_id % 3 = 2 THEN 'http://win-big' || event_id || '.top/claim' ELSE 'https://bit.ly/x' || event_id END AS entry FROM events WHERE event_id % 3 != 0)"


@query(f"WITH {_FEED} SELECT entry FROM feed")
def q_feed_entries(spark, sf_dir):
    return _feed(spark, sf_dir)


_FEED_HITS = "SELECT msg_id, arg_min(regexp_replace(url, '/+$', ''), pos) AS feed_url FROM links JOIN feed ON regexp_replace(url, '/+$', '') = entry GROUP BY msg_id"


@query("WITH " + ",\n".join([oracle.messages(), *oracle.links(), _FEED]) + " " + _FEED_HITS)
def q_feed_hits(spark, sf_dir):
    m = fixtures.messages(spark, sf_dir).select("msg_id", X.urls(F.col("text")).alias("links"))
    return feed.first_match(m, _feed(spark, sf_dir), "msg_id")


def _redirects(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id").where("event_id % 2 = 0")
    n = F.col("event_id").cast("string")
    return e.select(F.concat(F.lit("https://bit.ly/x"), n).alias("url"), F.concat(F.lit("http://paypa1.com/login?"), n).alias("destination"))


@query("WITH " + ",\n".join([oracle.messages(), *oracle.links()]) + " SELECT msg_id, 'http://paypa1.com/login?' || msg_id AS destination FROM links WHERE domain = 'bit.ly' AND msg_id % 2 = 0")
def q_redirect_join(spark, sf_dir):
    m = fixtures.messages(spark, sf_dir).select("msg_id", X.urls(F.col("text")).alias("links"))
    return feed.redirects(m, _redirects(spark, sf_dir), "msg_id").select("msg_id", F.explode("resolved").alias("destination"))


# --- verdicts --------------------------------------------------------------------------


@query(oracle.scored() + " SELECT msg_id, verdict, score, round(raw_score, 6) AS raw_score, no_ask FROM scored")
def q_verdicts(spark, sf_dir):
    return scored(spark, sf_dir).select("msg_id", "verdict", "score", F.round("raw_score", 6).alias("raw_score"), "no_ask")


@query(oracle.scored() + " SELECT verdict, count(*) AS n, sum(score) :: BIGINT AS total_score FROM scored GROUP BY verdict")
def q_verdict_counts(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"), F.sum("score").alias("total_score"))


_RANKED = "list_transform(list_sort(list_transform(signals, lambda s: {'w': -s.weight, 'l': s.layer, 'o': s.ord, 'id': s.id})), lambda s: s.id)"


@query(oracle.scored() + f" SELECT msg_id, array_to_string({_RANKED}, ',') AS reasons FROM scored WHERE len(signals) > 0")
def q_reasons_ranked(spark, sf_dir):
    return scored(spark, sf_dir).where(F.size("reasons") > 0).select("msg_id", F.array_join(F.transform("reasons", lambda s: s["id"]), ",").alias("reasons"))


@query(oracle.scored() + " SELECT msg_id, (score BETWEEN 25 AND 80) OR (verdict != 'safe' AND len(signals) = 0) AS escalate FROM scored")
def q_escalate(spark, sf_dir):
    return scored(spark, sf_dir).select("msg_id", "escalate")


@query(oracle.scored() + " SELECT genre, count(*) FILTER (no_ask) AS no_ask, count(*) FILTER (no_ask AND score = 34) AS capped FROM scored GROUP BY genre")
def q_noask_cap(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("genre").agg(F.count_if("no_ask").alias("no_ask"), F.count_if(F.col("no_ask") & (F.col("score") == 34)).alias("capped"))


@query("WITH " + ",\n".join([oracle.messages(), *oracle.links(), *oracle.link_signals(), *oracle.claims()]) + " SELECT msg_id, brand FROM claim WHERE brand IS NOT NULL")
def q_claim_mismatch(spark, sf_dir):
    d = X.once(_described(spark, sf_dir), s=url_signals.link_signals(F.col("links")), clean=impersonation.without_sso(F.col("text")))
    flagged = F.array_distinct(F.transform(F.filter("s", lambda s: s["brand"].isNotNull()), lambda s: s["brand"]))
    return d.select("msg_id", F.explode(impersonation.message_signals(F.col("clean"), F.col("links"), flagged)).alias("c")).select("msg_id", "c.brand")


@query("WITH " + _FEED + ", " + oracle.scored(feed=" UNION ALL SELECT msg_id, 'urlhaus_match', 4.0, 1000000 FROM (" + _FEED_HITS + ")")[5:] + " SELECT msg_id, verdict, score FROM scored")
def q_verdicts_with_feed(spark, sf_dir):
    return scored(spark, sf_dir, feed=_feed(spark, sf_dir)).select("msg_id", "verdict", "score")


@query(oracle.pages("SELECT page_id, verdict, score, round(raw_score, 6) AS raw_score FROM verdicts"))
def q_page_verdicts(spark, sf_dir):
    return score.score(fixtures.site_pages(spark, sf_dir)).select(F.col("msg_id").alias("page_id"), "verdict", "score", F.round("raw_score", 6).alias("raw_score"))


@query(oracle.pages("SELECT genre, poses AS brand, off AS harvest_weight, post AS post_weight, count(*) AS n FROM verdicts GROUP BY ALL"))
def q_impersonation(spark, sf_dir):
    s = score.score(fixtures.site_pages(spark, sf_dir))
    weight = lambda id: F.get(F.filter("signals", lambda x: x["id"] == id), F.lit(0))["weight"]
    brand = F.get(F.filter("signals", lambda x: x["id"] == "brand_impersonation"), F.lit(0))["brand"]
    return s.groupBy("genre", brand.alias("brand"), weight("offsite_credential_harvest").alias("harvest_weight"), weight("offsite_credential_post").alias("post_weight")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT page_id, replace(replace(replace(replace(regexp_replace(trim(regexp_extract(html, '<title>([^<]*)</title>', 1)), '\\s+', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&') AS title, len(regexp_extract_all(html, '<a href=')) :: INT AS n_anchors FROM pages")
def q_page_titles(spark, sf_dir):
    """Titles by the references that the SQL knows; a page that is null has none."""
    p = pages.collected(table(spark, sf_dir, "pages", "page_id", "url", "html"), plain=True)
    anchors = F.regexp_count("html", F.lit("<a href="))
    return p.select("page_id", F.when(F.col("html").isNotNull(), F.col("page.title")).alias("title"), anchors.cast("int").alias("n_anchors"))


@query()
def q_page_collect(spark, sf_dir):
    p = pages.collected(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return p.select("page_id", F.md5(F.col("page.text").cast("binary")).alias("text_md5"), F.size("page.extra_urls").alias("n_urls"), F.size("page.form_targets").alias("n_forms"), F.size("page.credential_fields").alias("n_secrets"), F.size("page.emails").alias("n_emails"))


@query()
def q_page_html_verdicts(spark, sf_dir):
    """Real HTML through collection and scoring."""
    return score.score_pages(pages.collected(table(spark, sf_dir, "pages", "page_id", "url", "html"))).select("page_id", "verdict", "score")


@query()
def q_adapter_messages(spark, sf_dir):
    rows = pages.messages(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return rows.select("page_id", "adapter", "msg_id", F.length("text").alias("n"))


# --- model -----------------------------------------------------------------------------


@query(MSGS + f""", w AS (SELECT msg_id, {oracle.tokens('text')} AS ws FROM msgs), t AS (SELECT msg_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM w),
d AS (SELECT term, count(DISTINCT msg_id) AS df, count(*) AS tf FROM t GROUP BY term HAVING count(DISTINCT msg_id) >= 3), k AS (SELECT * FROM d ORDER BY tf DESC, term LIMIT 6000)
SELECT term, df, tf, round(ln((1.0 + (SELECT count(*) FROM msgs)) / (1.0 + df)) + 1, 6) AS idf FROM k""")
def q_idf(spark, sf_dir):
    """The vocabulary of a model: at most 6000 terms, which is its size."""
    return model.vocabulary(fixtures.messages(spark, sf_dir)).select("term", "df", "tf", F.round("idf", 6).alias("idf"))


#: A small model to be checked by hand: term, idx, idf, coef.
HAND = (("pay", 0, 1.5, 1.25), ("account", 1, 2.0, 0.75), ("your", 2, 1.1, 0.5), ("the", 3, 1.0, -0.5), ("is", 4, 1.2, -0.75), ("police", 5, 2.5, -1.0), ("your account", 6, 2.25, 1.5), ("for", 7, 1.3, 0.25))
INTERCEPT = -0.25
_HAND_SQL = ", ".join(f"('{t}', {f}, {c})" for t, _, f, c in HAND)
_MODEL = f"""mw AS (SELECT msg_id, {oracle.tokens(oracle.fold('text', False))} AS ws FROM msgs), mt AS (SELECT msg_id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS term FROM mw),
hand(term, idf, coef) AS (VALUES {_HAND_SQL}), mc AS (SELECT msg_id, term, idf, coef, count(*) AS n FROM mt JOIN hand USING (term) GROUP BY ALL),
ms AS (SELECT msg_id, count(*) :: INT AS known, sum(n * idf * coef) :: DOUBLE / sqrt(sum(n * idf * n * idf)) AS dot FROM mc GROUP BY msg_id)"""


def _hand(spark) -> model.Weights:
    return model.Weights(spark.createDataFrame(list(HAND), "term string, idx int, idf double, coef double"), INTERCEPT)


@query(MSGS + f", {_MODEL} SELECT msg_id, round(1 / (1 + exp(-({INTERCEPT} + coalesce(dot, 0.0)))), 6) AS probability, coalesce(known, 0) :: INT AS known_terms, coalesce(known, 0) >= 3 AS available FROM msgs LEFT JOIN ms USING (msg_id)")
def q_lr_score(spark, sf_dir):
    m = fixtures.messages(spark, sf_dir)
    s = model.score(m, _hand(spark))
    return s.select("msg_id", F.round("model.probability", 6).alias("probability"), "model.known_terms", "model.available")


@query("WITH " + oracle.messages() + ", " + _MODEL + ", " + oracle.scored(extra=" LEFT JOIN ms USING (msg_id)", pull=f"CASE WHEN coalesce(ms.known, 0) >= 3 THEN (1 / (1 + exp(-({INTERCEPT} + ms.dot))) - 0.5) * 100 ELSE 0.0 END")[5 + len(oracle.messages()) + 2 :] + " SELECT msg_id, verdict, score FROM scored")
def q_verdicts_with_model(spark, sf_dir):
    return scored(spark, sf_dir, weights=_hand(spark)).select("msg_id", "verdict", "score")


@query()
def q_train_model(spark, sf_dir):
    """Weights of a model trained on the messages' labels."""
    w = model.fit(fixtures.messages(spark, sf_dir))
    return w.terms.select("term", "idx", F.round("idf", 6).alias("idf"), F.round("coef", 4).alias("coef"))


# --- policy ----------------------------------------------------------------------------


def _lists(spark, sf_dir):
    c = table(spark, sf_dir, "customer", "c_custkey")
    name = F.concat(F.lit(" User"), F.col("c_custkey").cast("string"), F.lit("@MAIL"), (F.col("c_custkey") % 7).cast("string"), F.lit(".example.com "))
    return c.where("c_custkey % 5 = 0").select(name.alias("sender")), c.where("c_custkey % 3 = 0").select(name.alias("sender"))


_GATED = "allowed AS (SELECT DISTINCT lower(trim(concat('user', c_custkey, '@mail', c_custkey % 7, '.example.com'))) AS s FROM customer WHERE c_custkey % 5 = 0), blocked AS (SELECT DISTINCT lower(trim(concat('user', c_custkey, '@mail', c_custkey % 7, '.example.com'))) AS s FROM customer WHERE c_custkey % 3 = 0)"
_GATE = "CASE WHEN sender IN (SELECT s FROM allowed) THEN 'allow' WHEN sender IN (SELECT s FROM blocked) THEN 'block' ELSE 'score' END"


@query(MSGS + f", {_GATED} SELECT msg_id, {_GATE} AS gate FROM msgs")
def q_allow_block(spark, sf_dir):
    return policy.gate(fixtures.messages(spark, sf_dir), *_lists(spark, sf_dir)).select("msg_id", "gate")


@query("WITH " + _GATED + ", " + oracle.scored()[5:] + f", gated AS (SELECT *, {_GATE} AS gate FROM scored) SELECT msg_id, gate, CASE gate WHEN 'block' THEN 'dangerous' WHEN 'score' THEN verdict END AS verdict, CASE gate WHEN 'block' THEN 100 WHEN 'score' THEN score END :: INT AS score FROM gated")
def q_scan(spark, sf_dir):
    return score.scan(fixtures.messages(spark, sf_dir), *_lists(spark, sf_dir)).select("msg_id", "gate", "verdict", "score")


@query("WITH " + _GATED + " SELECT s AS sender FROM allowed WHERE s NOT IN (SELECT s FROM blocked)")
def q_list_remove(spark, sf_dir):
    allowed, blocked = _lists(spark, sf_dir)
    return policy.remove_senders(allowed, blocked)


_SCANS = "SELECT msg_id, ts AS timestamp, 'manual' AS source, sender, concat('note ', user_id % 400) AS text, (event_id * 7 % 101) :: INT AS score FROM (SELECT *, event_id FROM msgs JOIN events USING (ts, user_id) WHERE event_id = msg_id)"


def _scans(spark, sf_dir):
    m = fixtures.messages(spark, sf_dir)
    return m.select("msg_id", F.col("ts").alias("timestamp"), F.lit("manual").alias("source"), "sender", F.concat(F.lit("note "), (F.col("user_id") % 400).cast("string")).alias("text"), (F.col("msg_id") * 7 % 101).cast("int").alias("score"))


_HISTORY = f"""scans AS ({_SCANS.replace('event_id * 7', 'msg_id * 7')}), h AS (SELECT text, sender, min({{'t': timestamp, 'o': msg_id}}) AS first, arg_max(score, {{'t': timestamp, 'o': msg_id}}) AS score FROM scans GROUP BY text, sender),
n AS (SELECT * FROM h ORDER BY first DESC, text, sender LIMIT 500), p AS (SELECT text, sender, score, row_number() OVER (ORDER BY first, text DESC, sender DESC) - 1 AS position FROM n)"""


@query(MSGS + f", {_HISTORY} SELECT text, sender, score, position :: INT AS position FROM p")
def q_history(spark, sf_dir):
    return policy.history(_scans(spark, sf_dir)).select("text", "sender", "score", "position")


@query(MSGS + f", {_HISTORY} SELECT text, score, position :: INT AS position FROM p ORDER BY position DESC LIMIT 100")
def q_history_view(spark, sf_dir):
    return policy.history_view(policy.history(_scans(spark, sf_dir))).select("text", "score", "position")


@query(oracle.scored() + " SELECT count(*) AS scanned, count(*) FILTER (verdict != 'safe') AS flagged FROM scored")
def q_stats(spark, sf_dir):
    return policy.counters(scored(spark, sf_dir)).select("scanned", "flagged")


@query(oracle.scored() + " SELECT user_id % 50 AS tab, count(*) FILTER (verdict = 'dangerous') AS dangerous, count(*) FILTER (verdict = 'suspicious') AS suspicious, count(*) FILTER (verdict != 'safe') AS flagged, CASE WHEN count(*) FILTER (verdict = 'dangerous') > 0 THEN 'red' WHEN count(*) FILTER (verdict = 'suspicious') > 0 THEN 'amber' ELSE 'none' END AS colour FROM scored GROUP BY user_id % 50")
def q_badge(spark, sf_dir):
    return policy.badges(scored(spark, sf_dir).withColumn("tab", F.col("user_id") % 50), "tab")


@query(oracle.scored() + " SELECT msg_id FROM scored WHERE verdict = 'dangerous'")
def q_min_severity(spark, sf_dir):
    return policy.at_least(scored(spark, sf_dir), "dangerous").select("msg_id")


_OPINION = "msg_id % 4 < 2"


@query(oracle.scored() + f""", o AS (SELECT *, CASE WHEN {_OPINION} AND msg_id % 4 = 0 THEN CASE WHEN len(signals) > 0 AND score >= 65 THEN greatest((msg_id % 101) :: INT, 65) ELSE (msg_id % 101) :: INT END ELSE score END AS s2 FROM scored)
SELECT msg_id, s2 AS score, CASE WHEN msg_id % 4 = 0 THEN CASE WHEN s2 >= 65 THEN 'dangerous' WHEN s2 >= 35 THEN 'suspicious' ELSE 'safe' END ELSE verdict END AS verdict, CASE WHEN msg_id % 4 = 0 THEN 'second-opinion' WHEN msg_id % 4 = 1 THEN 'second-opinion-failed' ELSE 'local' END AS tier,
  (len(signals) + CASE WHEN msg_id % 4 = 0 THEN 1 ELSE 0 END) :: INT AS n_reasons FROM o""")
def q_second_opinion(spark, sf_dir):
    v = scored(spark, sf_dir)
    m = fixtures.messages(spark, sf_dir).where(_OPINION)
    failed = F.col("msg_id") % 4 == 1
    opinions = m.select("msg_id", F.when(~failed, (F.col("msg_id") % 101).cast("double")).alias("score"), F.lit("e").alias("explanation"), F.array(F.lit("seen elsewhere")).alias("reasons"), F.lit("a").alias("advice"), failed.alias("failed"), F.lit(True).alias("sent"))
    return fusion.merge_opinions(v, opinions).select("msg_id", "score", "verdict", "tier", F.size("reasons").alias("n_reasons"))


@query("SELECT doc_id, CASE WHEN regexp_matches(left_, '^[=+\\-@\\t\\r]') THEN '''' || left_ ELSE left_ END AS cell FROM (SELECT doc_id, substr('=+-@x', (doc_id % 5 + 1) :: INT, 1) || text AS left_ FROM documents)")
def q_csv_guard(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    cell = F.concat(F.substring(F.lit("=+-@x"), (F.col("doc_id") % 5 + 1).cast("int"), F.lit(1)), F.col("text"))
    return d.select("doc_id", csv_io.guard(cell).alias("cell"))


@query("SELECT '\"' || doc_id || '\",\"' || replace(CASE WHEN regexp_matches(text, '^[=+\\-@\\t\\r]') THEN '''' || text ELSE text END, '\"', '\"\"') || '\",\"' || lang || '\"' AS value FROM documents")
def q_csv_lines(spark, sf_dir):
    return csv_io.lines(table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


_CLEAN = "regexp_replace(regexp_replace(text, '(?is)<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>', ' ', 'g'), '(?s)<[^>]{1,1000}(?:[^>]{1,1000})?>', ' ', 'g')"
for _ in range(2):
    for _name, _sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
        _CLEAN = f"replace({_CLEAN}, '{_name}', '{_sign}')"
_CLEAN = f"regexp_replace(regexp_replace({_CLEAN}, '(?m)^>.*$', ' ', 'g'), {oracle.q(X.EMAIL)}, '<email>', 'g')"
_CLEAN = f"substr(trim(regexp_replace({_CLEAN}, '\\s+', ' ', 'g')), 1, {corpus.MAX_CHARS})"
#: Some markup, entities, quotes and addresses, put around the texts in turn.
_MAIL = ("<p class=\"a\">~</p>", "~ &amp;lt;b&gt; &nbsp;&quot;", "a@b.example.com ~\n> quoted ~\nend", "<style>x{}</style>~<SCRIPT>y</SCRIPT >z", "~")


@query(f"SELECT conv_id, turn, sha1({_CLEAN}) AS cleaned FROM (SELECT conv_id, turn, replace({fixtures._case('turn', list(_MAIL))}, '~', text) AS text FROM conversations)")
def q_clean_mail(spark, sf_dir):
    """All conversations as mails with markup, quotes and addresses."""
    c = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
    c = c.withColumn("text", F.replace(F.expr(fixtures._case("turn", [m.replace("\n", "\\n") for m in _MAIL])), F.lit("~"), F.col("text")))
    return c.select("conv_id", "turn", F.sha1(corpus.clean_mail(F.col("text")).cast("binary")).alias("cleaned"))


# --- evaluation ------------------------------------------------------------------------

_RATE = "coalesce(round(100.0 * count(*) FILTER ({a} AND {b}) / nullif(count(*) FILTER ({b}), 0), 6), 0.0)"
_RATES = ", ".join(f"{_RATE.format(a=a, b=b)} AS {n}" for n, a, b in (("fp_rate", "verdict != 'safe'", "label = 0"), ("dangerous_rate", "verdict = 'dangerous'", "label = 0"), ("miss_rate", "verdict = 'safe'", "label = 1")))


@query(oracle.scored() + f" SELECT genre, count(*) AS n, {_RATES} FROM scored GROUP BY genre")
def q_rates_by_genre(spark, sf_dir):
    r = evaluate.rates(scored(spark, sf_dir), "genre")
    return r.withColumns({c: F.round(c, 6) for c in ("fp_rate", "dangerous_rate", "miss_rate")})


@query(oracle.scored() + f" SELECT CASE WHEN regexp_matches(text, '[\\x{{900}}-\\x{{97F}}]') THEN 'devanagari' ELSE 'latin' END AS script, count(*) AS n, {_RATES} FROM scored GROUP BY 1")
def q_rates_by_script(spark, sf_dir):
    s = scored(spark, sf_dir)
    r = evaluate.rates(s.withColumn("script", evaluate.script(F.col("text"))), "script")
    return r.withColumns({c: F.round(c, 6) for c in ("fp_rate", "dangerous_rate", "miss_rate")})


_CLEAN_PAGES = "genre IN ('genuine', 'hosted', 'article', 'sso')"


@query(oracle.pages(f"SELECT 'pages_flagged_rate' AS gate, round(100.0 * count(*) FILTER (verdict != 'safe') / count(*), 6) AS rate, 0.0 :: DOUBLE AS \"limit\", count(*) FILTER (verdict != 'safe') = 0 AS passed FROM verdicts WHERE {_CLEAN_PAGES}"))
def q_page_holdout(spark, sf_dir):
    """The gate on harmless pages: none may be flagged."""
    s = score.score(fixtures.site_pages(spark, sf_dir).where(_CLEAN_PAGES))
    return evaluate.gates(evaluate.flagged_pages(s), evaluate.HELD_OUT_GATES).withColumn("rate", F.round("rate", 6))


@query(oracle.scored() + f", r AS (SELECT {_RATES} FROM scored) SELECT gate, rate, lim AS \"limit\", rate <= lim AS passed FROM (SELECT 'fp_rate' AS gate, fp_rate AS rate, 1.5 :: DOUBLE AS lim FROM r UNION ALL SELECT 'dangerous_rate', dangerous_rate, 0.6 FROM r UNION ALL SELECT 'miss_rate', miss_rate, 3.0 FROM r)")
def q_gates(spark, sf_dir):
    return evaluate.gates(evaluate.rates(scored(spark, sf_dir))).withColumn("rate", F.round("rate", 6))


@query(oracle.scored() + " SELECT genre, count(*) AS total, count(*) FILTER (verdict != 'safe') AS flagged, count(*) FILTER (verdict = 'dangerous') AS dangerous FROM scored GROUP BY genre")
def q_by_genre(spark, sf_dir):
    return evaluate.by_genre(scored(spark, sf_dir))


@query(oracle.scored() + ", e AS (SELECT len(signals) = 1 AND 100 * (1 - exp(-signals[1].weight / 2.6)) >= 35 AS alone, unnest(list_transform(signals, lambda s: s.id)) AS rule_id FROM scored) SELECT rule_id, count(*) AS fires, count(*) FILTER (alone) AS solo FROM e GROUP BY rule_id")
def q_solo_fire(spark, sf_dir):
    return evaluate.solo_fires(scored(spark, sf_dir))


@query(oracle.scored() + " SELECT len(signals) :: INT AS n_signals, count(*) FILTER (label = 0) AS \"0\", count(*) FILTER (label = 1) AS \"1\" FROM scored GROUP BY len(signals)")
def q_signals_histogram(spark, sf_dir):
    return evaluate.signals_histogram(scored(spark, sf_dir))


@query(oracle.scored() + " SELECT msg_id, score FROM scored WHERE label = 1 AND verdict = 'safe' ORDER BY score, msg_id LIMIT 10")
def q_worst_misses(spark, sf_dir):
    """A report: the ten lowest-scored misses."""
    return evaluate.worst(scored(spark, sf_dir), "msg_id")[1].select("msg_id", "score")


@query(oracle.scored() + " SELECT *, (tp + tn) / n :: DOUBLE AS accuracy FROM (SELECT count(*) FILTER (label = 1 AND verdict != 'safe') AS tp, count(*) FILTER (label = 0 AND verdict != 'safe') AS fp, count(*) FILTER (label = 1 AND verdict = 'safe') AS fn, count(*) FILTER (label = 0 AND verdict = 'safe') AS tn, count(*) AS n FROM scored)")
def q_confusion(spark, sf_dir):
    return evaluate.confusion(scored(spark, sf_dir), (F.col("verdict") != "safe").cast("int"))


# --- streams (as batches) and extensions -----------------------------------------------


def _health_scans(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id")
    return e.select(
        (F.col("user_id") % 200).cast("string").alias("tab"), F.when(F.col("user_id") % 2 == 0, "gmail").otherwise("generic").alias("adapter"), (F.col("event_id") * 1700).alias("now_ms"),
        F.when(F.col("event_id") % 5 == 0, 2).otherwise(0).alias("count"), (F.col("event_id") % 23 == 0).alias("threw"), (F.col("event_id") % 7 != 0).alias("landmark"), (F.col("user_id") % 2 == 0).alias("has_landmarks"),
    )


@query("""WITH s AS (SELECT CAST(user_id % 200 AS VARCHAR) AS tab, CASE WHEN user_id % 2 = 0 THEN 'gmail' ELSE 'generic' END AS adapter, event_id * 1700 AS now_ms,
  CASE WHEN event_id % 23 = 0 THEN 'broken' WHEN event_id % 5 = 0 THEN 'ok' WHEN user_id % 2 != 0 THEN 'unknown' WHEN event_id % 7 = 0 THEN 'idle' ELSE 'miss' END AS kind FROM events),
r AS (SELECT *, sum(CASE WHEN kind IN ('broken', 'ok', 'idle') THEN 1 ELSE 0 END) OVER (PARTITION BY tab, adapter ORDER BY now_ms) AS reset FROM s),
m AS (SELECT *, sum(CASE WHEN kind = 'miss' THEN 1 ELSE 0 END) OVER (PARTITION BY tab, adapter, reset ORDER BY now_ms) AS misses, min(CASE WHEN kind = 'miss' THEN now_ms END) OVER (PARTITION BY tab, adapter, reset ORDER BY now_ms) AS first FROM r)
SELECT tab, adapter, now_ms, CASE WHEN kind != 'miss' THEN kind WHEN misses >= 3 AND now_ms - first >= 10000 THEN 'broken' ELSE 'watching' END AS status FROM m""")
def q_health(spark, sf_dir):
    return health.health(_health_scans(spark, sf_dir))


@query(oracle.scored() + " SELECT date_trunc('hour', ts) AS start, count(*) AS n, count(*) FILTER (verdict != 'safe') AS flagged FROM scored GROUP BY 1")
def q_hourly_flag_rate(spark, sf_dir):
    return streams.flag_rate(scored(spark, sf_dir))


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM e) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def q_session_scans(spark, sf_dir):
    return streams.sessions(table(spark, sf_dir, "events", "user_id", "ts"), "user_id")


@query("SELECT user_id % 300 AS node, arg_max(event_id, {'t': ts, 'e': event_id}) AS event_id FROM events GROUP BY user_id % 300")
def q_recycled_nodes(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id", "ts", "user_id").select((F.col("user_id") % 300).alias("node"), "event_id", F.struct("ts", "event_id").alias("at"))
    return streams.latest(e, "node", "at").select("node", "event_id")


@query(oracle.scored() + ", p AS (SELECT user_id % 20 AS tab, msg_id // 500 AS page_seq, count(*) FILTER (verdict = 'dangerous') AS dangerous, count(*) FILTER (verdict = 'suspicious') AS suspicious FROM scored GROUP BY ALL) SELECT tab, arg_max(dangerous, page_seq) AS dangerous, arg_max(suspicious, page_seq) AS suspicious FROM p GROUP BY tab")
def q_tab_counts(spark, sf_dir):
    rows = scored(spark, sf_dir).select((F.col("user_id") % 20).alias("tab"), F.floor(F.col("msg_id") / 500).alias("page_seq"), "verdict")
    return streams.tab_counts(rows)


@query("SELECT event_id, any_value(user_id) AS user_id FROM events GROUP BY event_id")
def q_message_once(spark, sf_dir):
    e = table(spark, sf_dir, "events", "event_id", "user_id")
    return e.union(e).dropDuplicates(["event_id"])


@query(oracle.scored() + " SELECT genre, verdict, count(*) AS n, grouping_id(genre, verdict) :: BIGINT AS level FROM scored GROUP BY CUBE (genre, verdict)")
def q_verdict_cube(spark, sf_dir):
    """Verdicts cubed over genre (an extension)."""
    return scored(spark, sf_dir).cube("genre", "verdict").agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("level"))


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_verdicts(spark, sf_dir)


__all__ = ["QUERIES", "SQL", "entry"]
