"""Each rule: a text that it names and a near miss."""

import pytest
from pyspark.sql import functions as F

from scamsift.functions import text as X
from scamsift.operators import rules

CASES = {
    "credential_request": ("please send me your otp", "never share your otp with anyone"),
    "gift_card_payment": ("buy a gift card and send the code", "the gift card balance is shown in the shop"),
    "crypto_transfer": ("double your bitcoin with us", "bitcoin closed lower. you may pay later"),
    "upi_collect_request": ("approve the request in your upi app", "upi is down for maintenance"),
    "account_suspension": ("your account will be suspended", "we block the transaction on your card"),
    "artificial_urgency": ("act now before midnight", "the code expires soon"),
    "threat_of_consequence": ("if you do not pay you face arrest", "the police verification is done"),
    "prize_or_windfall": ("you have won a lottery", "congratulations to the whole team"),
    "advance_fee": ("a small processing fee applies", "the fee table of the museum"),
    "impersonated_authority": ("this is the fraud department of the government", "the government met on friday"),
    "secrecy_request": ("do not tell your wife about this", "do not share your otp"),
    "sextortion_threat": ("your nude video is here", "a video of the trip"),
    "unexpected_attachment_or_install": ("install this app today", "the installer left the app room"),
    "boss_impersonation": ("this is your ceo", "the ceo spoke at noon"),
    "payment_detail_change": ("our new bank details are below", "details of the bank holiday"),
    "family_emergency": ("mum i lost my phone, send money", "mum will send a card"),
    "delivery_redispatch_fee": ("parcel on hold, pay the charges", "parcel delivered. we had lunch. the pay slip is here"),
    "job_advance_fee": ("part time job, pay a registration deposit of rs", "a job advert with a salary"),
    "refund_callback": ("subscription charged, call to cancel", "your subscription was renewed"),
    "investment_scam": ("guaranteed returns on trading", "police said guaranteed returns were promised"),
    "windfall_solicitation": ("a widow with a fund of millions", "the fund met its goal"),
    "generic_salutation": ("dear customer hello", "a dear customer said hello"),
    "reply_to_mismatch_language": ("call us on this number now", "call us on any day"),
}
HINDI = {"credential_request": "अपना ओटीपी भेजें", "threat_of_consequence": "साइबर सेल में मामला दर्ज", "artificial_urgency": "तुरंत आएं", "delivery_redispatch_fee": "पार्सल रुका है, शुल्क भरें"}


@pytest.fixture(scope="module")
def fired(spark):
    rows = [(k, i, t) for k, pair in CASES.items() for i, t in enumerate(pair)] + [(k, 2, t) for k, t in HINDI.items()]
    rows += [("warranty", 3, "वारंटी कार्ड"), ("nukta", 3, "éabc otp")]
    df = X.once(spark.createDataFrame(rows, "rule string, kind int, text string"), t=X.rule_text(F.col("text")))
    return {(r.rule, r.kind): r for r in rules.evaluate(df, "t").collect()}


@pytest.mark.parametrize("rule", CASES)
def test_rule(fired, rule):
    ids = lambda k: {s.id for s in fired[rule, k].rule_signals}
    assert rule in ids(0) and rule not in ids(1)


def test_hindi(fired):
    for rule in HINDI:
        assert rule in {s.id for s in fired[rule, 2].rule_signals}, rule
    assert fired["warranty", 3].rule_signals == []


def test_every_rule_has_a_case():
    assert [r.id for r in rules.RULES] == list(CASES) and len(rules.EXONERATING) == 3


def test_exoneration_and_context(spark):
    rows = [(0, "following up on the meeting"), (1, "following up on it: send me your otp"), (2, None), (3, "enter your password"), (4, "income tax office")]
    df = X.once(spark.createDataFrame(rows, "i int, text string"), t=X.rule_text(F.col("text")))
    got = {r.i: r for r in rules.evaluate(df, "t").collect()}
    assert [s.id for s in got[0].rule_exonerating] == ["conversational_context", "no_action_requested", "internal_scheduling"] and got[0].rule_score == 0
    assert got[1].rule_exonerating == [] and got[2].rule_signals == [] and got[2].no_ask
    held = {r.i: r for r in rules.evaluate(df, "t", F.lit(True), F.lit(True)).collect()}
    assert got[3].rule_signals and not held[3].rule_signals and got[4].rule_signals and not held[4].rule_signals
