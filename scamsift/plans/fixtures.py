"""Messages and pages for the registered queries.

The driver's text tables are invented prose in which no tactic occurs, so messages are made
of its ``events``: row ``event_id`` takes template ``event_id % len(TEMPLATES)`` and puts in
its numbers. The same expressions run in Spark and in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: label (1: scam), genre, text; ~n is the event's id, ~u its user's.
TEMPLATES: tuple[tuple[int, str, str], ...] = (
    (1, "credential", "Please enter your password and the one-time code at http://secure-check~n.xyz/login to keep reading your mail"),
    (0, "bank_otp", "Your one-time code is ~n. Never share your OTP with anyone, our staff will not ask for it."),
    (1, "gift_card", "Could you buy a gift card for the client today? Scratch it and text me the code, I will settle up on ~n"),
    (0, "retail", "Your gift card order ~n has shipped and the balance can be seen in the shop."),
    (1, "crypto", "Double your bitcoin in a day! Send BTC to this wallet address and you get it back twice, slot ~n"),
    (0, "news", "The exchange reported a quiet week. Bitcoin closed near its mean of ~n and analysts shrugged."),
    (1, "upi", "Approve the collect request on your UPI app to receive the refund of Rs ~n"),
    (0, "upi_info", "You paid the grocer by UPI. The reference is ~n and the balance is unchanged since."),
    (1, "suspension", "Your account has been suspended after unusual activity. Verify your details at http://paypa1.com/verify?id=~n"),
    (0, "security", "We blocked the attempt to sign in from a new device on day ~n. No step is needed."),
    (1, "urgency", "Final notice ~n: act now, the offer ends before midnight and you must confirm immediately"),
    (0, "delivery_link", "The link expires soon, so the preview of draft ~n will be gone after that."),
    (1, "threat", "If you do not pay the fine you will be arrested and a case filed, file number ~n"),
    (0, "police_check", "The police verification for application ~n is complete and the passport is on its way."),
    (1, "prize", "Congratulations! You have won the lottery prize ~n. Claim your reward at http://win-big~n.top/claim"),
    (0, "praise", "Congratulations to Asha on the new post at the university, team ~n is proud."),
    (1, "advance_fee", "A small processing fee of Rs ~n is needed before the loan can be released, pay today"),
    (1, "authority", "This is the fraud department of the government calling from the head office about ticket ~n"),
    (0, "authority_news", "The tax bureau published its yearly report with ~n pages of tables."),
    (1, "secrecy", "Do not tell anyone about this transfer and keep this confidential until ~n"),
    (1, "sextortion", "I have your intimate video and it goes viral unless 0.~n arrives"),
    (1, "install", "Install this app and give us remote access with AnyDesk so that we can fix ticket ~n"),
    (1, "boss", "This is your CEO. I need a quick task done, be discreet, reply with your number ~n"),
    (1, "bank_change", "Please note our new bank details for invoice ~n and send the payment there"),
    (1, "family", "Mum it's me, I lost my phone and this is my new number. I need money for rent urgently ~n"),
    (1, "courier", "Your parcel ~n is on hold. Pay the customs charges to reschedule the delivery."),
    (0, "courier_ok", "Your parcel ~n was left with a neighbour. Have a good evening. The weather is fine."),
    (1, "job", "Part-time job from home! Pay a refundable deposit of Rs ~n as registration fee and start to earn"),
    (1, "refund_call", "Your subscription was renewed and ~n charged. Call our helpline to cancel and get a refund"),
    (1, "investment", "Our trading scheme gives guaranteed returns of ~n percent, invest weekly with assured profits"),
    (0, "case_report", "Police said the accused promised guaranteed returns and was arrested, case ~n."),
    (1, "windfall", "I am the widow of a late banker and have a fund of ~n million for a trusted partner"),
    (1, "greeting", "Dear customer, reply to this mail within 24 hours or call us on ~n now, it is urgent"),
    (0, "work", "Following up on the sprint meeting: the agenda for room ~n is attached, thanks for the notes"),
    (1, "shortener", "See who looked at your photos: https://bit.ly/x~n click to open it"),
    (1, "subdomain", "Microsoft says your mailbox is locked. Sign in at https://microsoft.example-~u.ml/account"),
    (1, "compound", "Netflix could not renew. Update your payment at http://netflix-billing.com/update?u=~u"),
    (1, "address", "Open http://192.168.~u.7/secure/index to verify your account"),
    (1, "userinfo", "Sign in at https://www.google.com@login.~u.example.net/verify please"),
    (0, "genuine", "Your receipt ~n is at https://www.amazon.com/orders and https://github.io pages, write to help~u@shop.example.com"),
    (1, "deep", "Open it at http://a.b.c.d~u.example.co.uk/update and log in"),
    (1, "claim", "PayPal noticed unusual activity, please confirm your details at http://safe-pay~n.net/verify"),
    (0, "plain", "See you on the 5th, seat ~n, by the window"),
    (1, "homoglyph", "Could you buy a gіft сard for the client today? Scratch it and text me the code, slot ~n"),
    (1, "fullwidth", "Ｐlease enter your ｐａｓｓｗｏｒｄ and the one-time code at http://check~n.top/login"),
    (1, "lottery_hi", "आपने लॉटरी जीत ली है, इनाम ~n पाने के लिए लिंक खोलें"),
    (1, "warrant_hi", "पुलिस ने आपके नाम वारंट जारी किया है, फाइल ~n"),
    (0, "police_check_hi", "आपका पुलिस सत्यापन ~n पूरा हो गया है, पासपोर्ट रास्ते में है"),
    (1, "family_hi", "पापा, मेरा फोन खो गया, नए नंबर ~n पर पैसे भेजो, अस्पताल में हूँ"),
    (0, "greeting_hi", "नमस्ते, आज शाम की बैठक ~n बजे है"),
    (1, "coded_brand", "Look at http://xn--pypal-4ve.com/x~n when you can"),
    (1, "coded_mixed", "Cakes for day ~n at http://xn--god-cakes-02h.com/menu"),
    (0, "coded_plain", "News of day ~n at http://xn--e1afmkfd.com/"),
)

#: Rules that hold for the templates, found by reading the rules' meaning; no rule holds for the others.
EXPECTED = {
    "credential": ("credential_request",), "gift_card": ("gift_card_payment",), "crypto": ("crypto_transfer",), "upi": ("upi_collect_request",), "suspension": ("account_suspension",), "urgency": ("artificial_urgency",),
    "threat": ("threat_of_consequence",), "prize": ("prize_or_windfall",), "advance_fee": ("advance_fee",), "authority": ("impersonated_authority",), "secrecy": ("secrecy_request",), "sextortion": ("sextortion_threat",),
    "install": ("unexpected_attachment_or_install",), "boss": ("boss_impersonation",), "bank_change": ("payment_detail_change",), "family": ("artificial_urgency", "family_emergency"),
    "courier": ("impersonated_authority", "delivery_redispatch_fee"), "job": ("advance_fee", "job_advance_fee"), "refund_call": ("refund_callback",), "investment": ("investment_scam",), "windfall": ("windfall_solicitation",),
    "greeting": ("artificial_urgency", "generic_salutation", "reply_to_mismatch_language"), "claim": ("account_suspension",), "homoglyph": ("gift_card_payment",), "fullwidth": ("credential_request",),
    "lottery_hi": ("prize_or_windfall",), "warrant_hi": ("threat_of_consequence", "impersonated_authority"), "family_hi": ("family_emergency",),
}
#: Characters of the templates that fold to others, and what they fold to; hosts that read otherwise than they are written.
ODD = ("іс" + "Ｐｐａｓｗｏｒｄ", "ic" + "Ppasword")
SHOWN = {"xn--pypal-4ve.com": "paypal.com", "xn--god-cakes-02h.com": "good-cakes.com", "xn--e1afmkfd.com": "pep.com"}
MIXED_HOST, FOREIGN_HOST = "xn--god-cakes-02h.com", "xn--e1afmkfd.com"

PAGES: tuple[tuple[str, str, str, str, str, str], ...] = (
    # url, title, text, credential fields, form target, genre; ~n is the page's id
    ("https://www.paypal.com/signin", "PayPal: Log in", "Log in to your account", "password", "https://www.paypal.com/auth", "genuine"),
    ("http://pay-check~n.com/a", "PayPal - Sign in", "Welcome back to PayPal. Enter your password.", "password", "http://collect~n.net/x", "impersonation"),
    ("http://intra~n.com/login", "Sign in - Zenith Payroll", "Enter your password and the code", "password,otp", "http://drop~n.org/p", "harvest_claimed"),
    ("http://site~n.com/", "", "Code please", "password,otp", "http://drop~n.org/p", "harvest_thin_two"),
    ("http://site~n.com/", "", "Code please", "password", "http://drop~n.org/p", "harvest_thin"),
    ("http://site~n.com/", "Sign in", "Code please", "password", "https://tenant.okta.com/login", "hosted"),
    ("http://blog~n.com/", "How to log in to PayPal", "An article about accounts", "", "", "article"),
    ("http://shop~n.com/in", "Shop ~n", "Sign in with Google or use your password", "password", "http://shop~n.com/in", "sso"),
)

WORDS_AGO = "timestamp '2024-02-01 00:00:00'"


def _case(column: str, values: list[str]) -> str:
    whens = " ".join(f"WHEN {i} THEN '{v.replace(chr(39), chr(39) * 2)}'" for i, v in enumerate(values))
    return f"CASE {column} % {len(values)} {whens} END"


def messages_sql(table: str = "events", text_type: str = "VARCHAR") -> str:
    """SQL of the view of messages: msg_id, ts, user_id, sender, genre, label, text."""
    columns = _message_columns(text_type)
    return f"SELECT {', '.join(columns)} FROM {table}"


def _message_columns(text_type: str) -> list[str]:
    texts, genres, labels = zip(*[(t, g, str(y)) for y, g, t in TEMPLATES], strict=True)
    number = lambda c: f"CAST({c} AS {text_type})"
    text = f"replace(replace({_case('event_id', list(texts))}, '~n', {number('event_id')}), '~u', {number('user_id')})"
    sender = f"concat('user', {number('user_id')}, '@mail', {number('user_id % 7')}, '.example.com')"
    return ["event_id AS msg_id", "ts", "user_id", f"{sender} AS sender", f"{_case('event_id', list(genres))} AS genre", f"CAST({_case('event_id', list(labels))} AS INT) AS label", f"{text} AS text"]


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Rules cost far more than reading, so the few narrow rows of small files are spread over the cores first.
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id").repartition(spark.sparkContext.defaultParallelism)
    return events.selectExpr(*_message_columns("STRING"))


def pages_sql(table: str = "pages", text_type: str = "VARCHAR") -> str:
    """SQL of the view of pages: page_id, url, title, text, creds (comma-joined), form, genre."""
    return f"SELECT {', '.join(_page_columns(text_type))} FROM {table}"


def _page_columns(text_type: str) -> list[str]:
    names = ("url", "title", "text", "creds", "form", "genre")
    return ["page_id", *(f"replace({_case('page_id', [p[i] for p in PAGES])}, '~n', CAST(page_id AS {text_type})) AS {name}" for i, name in enumerate(names))]


def site_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as rows for scoring: msg_id, text, source, extra_urls, page, genre."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id")
    p = pages.selectExpr(*_page_columns("STRING"))
    listed = lambda c: F.when(F.col(c) != "", F.split(c, ",")).otherwise(F.array().cast("array<string>"))
    page = F.struct("url", "title", "text", listed("creds").alias("credential_fields"), listed("form").alias("form_targets"))
    return p.select(F.col("page_id").alias("msg_id"), "text", F.lit("page").alias("source"), F.array_distinct(F.concat(F.array("url"), listed("form"))).alias("extra_urls"), page.alias("page"), "genre")
