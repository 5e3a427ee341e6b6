"""The tactic rules over normalised text: 23 that incriminate, 3 that exonerate."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import once
from .logic import AtLeast, Finder, Has, InClause, InWindow, Known, Rule, Without, WithoutNear, excluded, words_of

# ---------------------------------------------------------------------------------------
# Vocabulary and patterns that define what each rule means.
# ---------------------------------------------------------------------------------------
SEND = r"bhej\w*|भेज\w*|de\s*do|दे\s*दो|jama\w*|जमा|ट्रांसफ़?र\w*|शेयर\s*कर\w*|साझा\s*कर\w*"
TELL = r"bata(?:o|iye|ye|yein|na)|बता(?:ओ|इए|एं|ना)"
ENTER = r"daal(?:o|iye|ein|na)?|dal(?:o|iye|ein)|डाल(?:ो|िए|ें|ना)?"
MONEY = r"pais[ae]|rupay[ae]?|rupees|rakam|राशि|पैस[ेा]|रुपय[ेा]|रकम"
ACCOUNT = r"khat[ae]|खात[ेा]|account|खाता|कार्ड|card"
URGENT_LATIN = r"turant|abhi|jald(?:i|ee)|foran"
URGENT_DEVANAGARI = r"तुरंत|जल्दी|फ़?ौरन"
BLOCKED = r"band\s*ho|block\s*ho|suspend|सस्पेंड|nilambit|बंद\s*हो|ब्लॉक|निलंबित|समाप्त|रोक(?:ा|ी|दिया)?|काम\s*नहीं\s*करेगा"
FEE = r"shulk|शुल्क|फ़?ीस|charge|fee|duty|ड्यूटी|चार्ज|क्लियरेंस"
POLICE_LATIN = r"cyber\s*cell|cbi|police(?!\s*(?:verification|clearance))|\bwarrant(?!y)|giraftar|\bed\s*(?:officer|ऑफिसर|अधिकारी)|supreme\s*court|money\s*laundering"
POLICE_DEVANAGARI = r"साइबर\s*सेल|सीबीआई|पुलिस(?!\s*(?:सत्यापन|वेरिफिकेशन|क्लीयरेंस))|वारंट(?!ी)|गिरफ़?्तार|थाना|थाने|ईडी|फेमा|सुप्रीम\s*कोर्ट|मनी\s*लॉन्ड्रिंग|दूरसंचार"
PRIZE = r"lotter[iy]|लॉटरी|jeet\s*ga(?:ye|ya)|जीत\s*ग(?:ए|या)|inaam|इनाम"
KYC = r"kyc|केवाईसी"
PARCEL = r"parcel|package|courier|consignment|पार्सल|पैकेट|कूरियर|कोरियर|कस्टम(?!र)|कंसाइनमेंट"
CREDENTIAL_NOUN = r"\b(?:password|passcode|pin(?:\s*(?:number|code))?|otp|one[\s-]?time\s*(?:password|code|pin)|cvv|card\s*(?:number|details)|security\s*code|(?:confirmation|verification)\s*code|seed\s*phrase|recovery\s*phrase|private\s*key|aadhaar|ssn|social\s*security)\b|ओटीपी|पिन|आधार|पासवर्ड|कोड|कार्ड\s*(?:विवरण|नंबर|डिटेल्स)"
CREDENTIAL_SEND_DEVANAGARI = r"भेज(?:ें|िए)|भेज\s*(?:दो|दें|दीजिए)|(?:शेयर|साझा)\s*(?:करें|कीजिए|कर\s*(?:दो|दें|दीजिए))"
CREDENTIAL_TRANSMIT = (
    r"\b(?:(?:send|forward|give|tell|text|whatsapp|email|message)\s+(?:it\s+)?(?:me|us|back|to\s+(?:me|us))|shar(?:e|ing)\s+(?:your|the|it|with)|reply\s+(?:with|back\s+with)|revert\s+with|provide\s+(?:me|us))\b"
    rf"|{CREDENTIAL_SEND_DEVANAGARI}|{TELL}"
)
CREDENTIAL_ENTRY = rf"\b(?:enter|provide|confirm|verify|submit|update)\s+(?:your|the|this|it|below|these)\b|{ENTER}"
CREDENTIAL_ADVICE = (
    r"\b(?:never|not|no\s*one|nobody|avoid)\b[^.!?]{0,25}\b(?:shar(?:e|ing)|disclos(?:e|ing)|reveal(?:ing)?|tell|give|send|forward|provide)\b"
    r"|\b(?:na|nahi|mat|kabhi)\s+(?:bata\w*|bhej\w*|share\s*kar\w*)|(?:न|नहीं|मत)\s*(?:बता|भेज|शेयर|साझा|दे)"
)
IN_PERSON_PICKUP = r"(?:रिटर्न\s*पिकअप|सामान\s*वापस\s*लेते\s*समय|पिकअप\s*के\s*समय)[^।.!?]{0,60}(?:बता|दे)"
CRYPTO = r"(?:bitcoin|btc|ethereum|eth|usdt|crypto(?:currency)?|wallet\s*address)"
CRYPTO_VERB = r"(?:send|transfer|deposit|invest|double|pay|scan)"
CRYPTO_READER = r"\byou(?:r|'re)?\b"
CONGRATS = r"\bcongratulations\b|\bbadhai\b|बधाई"
WINNINGS = r"\b(?:prize|reward|lottery|jackpot|refund|cashback|bonus|voucher|gift\s*card|winnings|unclaimed|lucky\s*draw|claim\s*(?:your|now|it)|crore|lakh|rs|inr)\b|इनाम|लॉटरी|रिफंड|कैशबैक|बोनस|पुरस्कार|लाख|करोड़|रुपये|क्लेम"
GUARANTEED = r"\bguaranteed\b"
GUARANTEED_PRIZE = r"\b(?:prize|cash|gift|reward|voucher|holiday|tickets?)\b"
LEGAL_CONSEQUENCE = r"\b(?:arrest(?:ed|s)?|legal\s*action|lawsuit|court|police(?!\s*(?:verification|clearance))|fir|warrant|prosecut(?:e|ed|ion)|penalt(?:y|ies)|fine[sd]?|seiz(?:e|ed|ure)|deport(?:ed|ation)?|jail(?:ed)?|criminal\s*(?:case|charge))\b"
THREAT_FRAME = (
    r"\b(?:avoid|escape|face[sd]?|facing|liable|failure\s*to|non[\s-]?payment|otherwise|or\s*else|against\s*you|in\s*your\s*name)\b|\bif\s*you\s*(?:do\s*not|don't|fail|ignore)\b|\byou\s*(?:will|shall|may|could|can|would)\s*be\b"
    r"|\b(?:will|shall)\s*be\s*(?:taken|initiated|issued|filed|registered|imposed|levied)\b|\bhas\s*been\s*(?:issued|filed|registered|imposed)\s*against\b"
)
GENERIC_AUTHORITY = r"\b(?:federal|government|security\s*team|fraud\s*department|tech\s*support)\b"
AUTHORITY_CLAIM = r"\b(?:this\s*is|it's|i\s*am|i'm|we\s*are|we're|calling\s*from|speaking\s*from|writing\s*(?:to\s*you\s*)?from|contacting\s*you\s*from|on\s*behalf\s*of|notice\s*from|message\s*from|alert\s*from|letter\s*from|email\s*from)\b"
INVESTMENT_INSTRUMENT = r"\b(?:invest(?:ment|ing|or)?|trading|stocks?|shares?|mutual\s*funds?|scheme|ipo|forex)\b|इन्वेस्ट|ट्रेडिंग|म्यूचुअल\s*फंड|स्टॉक|आईपीओ|फॉरेक्स|स्कीम"
YIELD_QUALIFIER = r"\b(?:guarantee[ds]?|assured|fixed|risk[\s-]?free|daily|weekly|monthly|double[ds]?|tripl(?:e|ed)|multibagger)\b|गारंटी\w*|एश्योर्ड|फिक्स्ड|डेली|डबल|मल्टीबैगर"
YIELD_NOUN = r"\b(?:returns?|profits?|payouts?)\b|रिटर्न|प्रॉफिट|मुनाफ़?ा|एलॉटमेंट"
FRAUD_CASE_REPORT = r"\b(?:police|arrest(?:ed|s)?|accused|custody|magistrate|charge[\s-]?sheet|convicted|investigat(?:ors?|ion|ing|ed)|cybercrime|case\s*(?:has\s*been\s*)?registered|produced\s*before)\b"
GIFT_CARD = r"\b(?:gift\s*card|itunes\s*card|steam\s*(?:card|wallet)|google\s*play\s*card|voucher\s*code|prepaid\s*card)\b|गिफ्ट\s*कार्ड|आइट्यून्स|स्टीम\s*कार्ड|वाउचर"
GIFT_CARD_ASK = r"\b(?:buy|purchase|get|pick\s*up|load|top\s*up|pay|paying|payment|send|forward|share|scratch|redeem)\b|खरीद|भेज|पेमेंट|पैसे"
ACTION_REQUEST = (
    r"\b(?:click|tap|visit|open\s+(?:the|this|your|it)|log\s*in|login|sign\s*in|re-?register|register|re-?activate|activate|enter|submit|upload|fill\s*(?:in|out|up)?|provide|verify\w*\s+(?:your|the|this|it|my)|confirm|update\s*your"
    r"|send|sending|forward(?:ing)?\s+(?:it|this|to|the|your|my)|share|sharing\s+(?:your|the|it|this|with|my)|transfer|remit|give\s+(?:us|me|it|them)|tell\s+(?:me|us)|start\s+trading|(?:reply|respond|revert)\s*(?:to|with|back)"
    r"|pay(?:ing|ments?)?|settle|deposit|purchase|buy|recharge|claim|redeem|collect|accept|approve|scan|receive|download|install|call|dial|contact\s+(?:us|me)|whatsapp\s+(?:us|me)|reschedul\w*)\b"
    rf"|{SEND}|{TELL}|{ENTER}"
    r"|\bkar(?:iye|iyega|ein|en|o|na|ke|wa\w*)\b|\bkar\s*d(?:o|ijiye|ein|en)\b|\bk(?:ee|i)jiy?e\b|\bbhar(?:kar|ke|iye|iyega|o|na|en|ein)?\b|\bdaba(?:o|iye|ye|yen|ein)\b"
    r"|कर(?:िए|िये|ें|ो|ना|वा|के)|कीजिए|कीजिये|किजिए|दीजिए|दीजिये|भर(?:ें|िए|िये|ना|कर|ो)|दबा(?:एं|एँ|कर|इए|ये|यें)"
    r"|क्लिक|कॉल|डायल|अपडेट|अपलोड|डाउनलोड|इंस्टॉल|स्कैन|लॉगिन|लॉग\s*इन|साइन\s*इन|वेरिफ|सत्यापित|भुगतान|पेमेंट|खरीद|रिडीम|क्लेम|रजिस्टर|एक्सेप्ट|स्वीकार|संपर्क|खोल"
)
URGENCY_HARMLESS = (
    r"\bhttps?:\/\/\S+",
    r"\b(?:link|url|code|otp|token|session|invit(?:e|ation)|verification)\b[^.!?]{0,20}\bexpir\w*[^.!?]{0,25}",
    r"(?:कोड|ओटीपी|लिंक|पासवर्ड|टोकन|सेशन|वेरिफिकेशन)[^।.!?]{0,40}एक्सपायर[^।.!?]{0,20}",
    r"\breport\s+(?:any\s+|all\s+)?(?:suspicious|fraudulent|fraud|phishing|unauthori[sz]ed|this|it)\b[^.!?]{0,40}",
    r"\b(?:immediately|urgent(?:ly)?)\b[^.!?]{0,60}\bcall\s*(?:the\s*)?(?:police|cops|cps|911|child\s*protective(?:\s*services)?|authorities)\b",
    r"\bcall\s*(?:the\s*)?(?:police|cops|cps|911|child\s*protective(?:\s*services)?|authorities)\b[^.!?]{0,60}\b(?:immediately|urgent(?:ly)?)\b",
    r"\burgent(?:ly)?[\s-]+needed\b",
    r"\bshould\s+immediately\b",
)
SUSPENSION = r"\b(?:account|card|profile|subscription|service|net\s*banking|sim)\b[^.!?]{0,40}\b(?:suspend(?:ed)?|lock(?:ed)?|block(?:ed)?(?!\s*(?:the\s*)?(?:attempt|attack|transaction|charge|payment|it\b))|disabl(?:ed)?|deactivat(?:ed)?|restrict(?:ed)?|clos(?:ed|ure)|terminat(?:ed)?|on\s*hold)\b"
WON = r"\b(?:(?:you|u)(?:'ve|\s*ve\b|\s*h?ave|\s*hvae)?\s*(?:been\s*)?(?:specially\s*)?(?:won(?!'t)|win|selected|chosen)|(?:was|has\s*been|have\s*been)\s*(?:selected|chosen)\s*to\s*receive|(?:number|email|name|account|line)\b[^.!?]{0,20}\bwon(?!'t)\b|to\s*be\s*won(?!'t)|lucky\s*(?:winner|draw)|claim\s*your\b[^.!?]{0,25}\b(?:prize|reward|gift|cash|voucher|tickets?)\b|lottery|jackpot|unclaimed\s*(?:funds|money|refund)|inherit(?:ance|ed))\b"
# ---------------------------------------------------------------------------------------

for _word, _following in (
    ("police", r"\s*(?:verification|clearance)"), (r"\bwarrant", "y"), ("पुलिस", r"\s*(?:सत्यापन|वेरिफिकेशन|क्लीयरेंस)"), ("वारंट", "ी"), ("कस्टम", "र"),
    ("won", "'t"), (r"block(?:ed)?", r"\s*(?:the\s*)?(?:attempt|attack|transaction|charge|payment|it\b)"), ("confirm", "ation"),
):
    excluded("", _word, _following)


def near(a: str, b: str, gap: str) -> Has:
    """Either order of two patterns with a gap between them."""
    return Has(f"(?:{a}){gap}(?:{b})|(?:{b}){gap}(?:{a})")


_YIELD = f"(?:{YIELD_QUALIFIER})[^।.!?]{{0,25}}(?:{YIELD_NOUN})|(?:{YIELD_NOUN})[^।.!?]{{0,25}}(?:{YIELD_QUALIFIER})"
_PAY_WORDS = rf"{SEND}|bhar|भर|pay\b"
_FEE_KINDS = r"file|delivery|clearance|क्लियरेंस|processing"

_credential = Has(CREDENTIAL_TRANSMIT) | (~Known("has_credential_form") & Has(CREDENTIAL_ENTRY))
# The patterns in these bodies and in the rules below; the trees that hold them are structure.
_parcel_failed = Has(r"\b(?:could\s*not|couldn'?t|cannot|can'?t|failed|unsuccessful|unable\s*to|attempt(?:ed)?|on\s*hold|pending|held|suspended|incomplete|incorrect\s*address)\b|address\s*verification") | Has("रुका|अटका|लंबित|पेंडिंग|होल्ड")
_parcel_action = Has(r"reschedul|re-?dispatch|re-?deliver|\bconfirm(?!ation)|\bverif|update\s*your\s*address") | Has(r"रिलीज़|दोबारा\s*भेज|पता\s*अपडेट|अपडेट\s*कर")
_parcel_payment = Has(r"\b(?:pay|paying|payment|fees?|charges?|deposit|customs|duty)\b") | Has(r"shulk|शुल्क|फ़?ीस|ड्यूटी|चार्ज|क्लियरेंस|भर(?:कर|ें|ना|ो)?")
_family = (
    Has(r"\b(?:mum|mom|dad|papa|mummy|beta|bro|sis|son|daughter|uncle|aunt(?:y|ie)?|grand(?:ma|pa)|it'?s\s*me)\b")
    | Has(r"पापा|माँ|मां|मम्मी|बेटा|बेटी|भाई|बहन|चाचा|मामा|दादी|दादा|दीदी|मैं\s*हूँ")
    | Has(r"\b(?:main\s*hoon|bhai|behen|didi|chacha|mama|nana|nani)\b")
)
_wants_money = (
    (Has(r"\b(?:send|transfer|pay|paying|need|deposit|lend|credit)\b") & Has(r"\b(?:money|cash|rs|inr|rupees|upi|gpay|paytm|phonepe|amount|rent|fees?|funds?|account)\b"))
    | Has(rf"(?:{SEND}|transfer|bhijwa\w*)[^.!?]{{0,30}}(?:{MONEY})")
    | Has(rf"(?:{MONEY})[^.!?]{{0,30}}(?:{SEND}|transfer|chahiye|चाहिए|मांग)")
    | Has(rf"{SEND}|मांग")
)
_unreachable = (
    Has(r"\b(?:new|different|temp(?:orary)?|another|friend'?s|borrowed)\s*(?:number|phone|mobile|sim)\b|lost\s*my\s*(?:phone|wallet)|broke\s*my\s*(?:phone|screen)|texting\s*from\b")
    | Has(r"\b(?:nay[ae]|naya|dusre)\s*(?:number|phone|sim)|phone\s*kho\s*gaya|number\s*badal")
    | Has(r"न[ईएय][ां]?\s*(?:नंबर|सिम|फ़?ोन|मोबाइल)|टेम्परेरी\s*(?:नंबर|सिम|फ़?ोन|मोबाइल)|फ़?ोन\s*खो\s*गया|दूसरे\s*नंबर|दोस्त\s*के\s*(?:नंबर|फ़?ोन)\s*से")
)
_crisis = Has(r"\b(?:accident|hospital|emergency|surgery|operation|admitted|icu|stuck|stranded|detained|arrested|police\s*station|urgent(?:ly)?|tonight|right\s*(?:now|away))\b") | Has(
    rf"\b(?:{URGENT_LATIN})\b|{URGENT_DEVANAGARI}|दुर्घटना|अस्पताल|एक्सीडेंट|ऑपरेशन|भर्ती|फंसा|अटका|चोरी"
)

RULES: tuple[Rule, ...] = (
    Rule("credential_request", 2.2, "It wants a password, PIN, one-time code or card number; a genuine sender never does.",
         Has(CREDENTIAL_NOUN) & Without((CREDENTIAL_ADVICE, IN_PERSON_PICKUP), _credential)),
    Rule("gift_card_payment", 3.0, "It wants to be paid in gift cards, which can't be traced.", Has(GIFT_CARD) & near(GIFT_CARD_ASK, GIFT_CARD, "[^.!?]{0,60}")),
    Rule("crypto_transfer", 2.4, "It wants you to send cryptocurrency, which can't be called back.",
         InClause(near(rf"\b{CRYPTO}\b", rf"\b{CRYPTO_VERB}\b", "[^.!?]{0,40}") & Has(CRYPTO_READER))),
    Rule("upi_collect_request", 2.6, "It wants a payment request approved or a code scanned to receive money; both only ever pay out.",
         (Has(r"\b(?:upi|gpay|google\s*pay|phonepe|paytm|bhim|qr\s*code)\b|यूपीआई|क्यूआर|कलेक्ट\s*रिक्वेस्ट")
          & Has(rf"\b(?:collect\s*request|accept|approve|scan|enter\s*(?:your\s*)?pin|receive|refund|cashback)\b|{ENTER}|स्वीकार|स्कैन|एक्सेप्ट|हां\s*दबा|रिक्वेस्ट\s*पर\s*हां"))
         | (Has(r"(?:रिक्वेस्ट|request)[^।.!?]{0,40}(?:(?:एक्सेप्ट|स्वीकार|accept)\s*कर\s*(?:दीजिए|दीजिये|दो|दें|ें|िए)|स्वीकार(?:ें|िए)|हां\s*दबा)")
            & Has(rf"{MONEY}|पेमेंट|payment|भुगतान|अमाउंट"))),
    Rule("account_suspension", 1.5, "It says an account is locked or about to be closed.",
         Has(SUSPENSION)
         | (Has(r"\b(?:unusual|suspicious|unauthori[sz]ed|unrecogni[sz]ed|abnormal)\s*(?:activity|log\s*in|login|sign[\s-]?in|access|transaction)\b")
            & Has(r"\b(?:log\s*in|login|sign\s*in|verify|confirm|click|update\s*your|re-?activate)\b"))
         | Has(rf"(?:{ACCOUNT}|{KYC}|नेटबैंकिंग)[^.!?]{{0,40}}(?:{BLOCKED}|expire|khatam|खत्म)")
         | Has(rf"(?:{KYC})[^.!?]{{0,25}}(?:expire|समाप्त|pending|update)")
         | (Has(r"(?:सिम|सेवाएं|सेवाओं|सेवा|कनेक्शन)[^।.!?]{0,45}(?:बंद|ब्लॉक|निलंबित|समाप्त)") & Has(r"न\s*होने|नहीं\s*तो|वरना|अन्यथा|पूरी\s*न|विफल|फेल|तुरंत|जल्दी"))),
    Rule("artificial_urgency", 1.2, "It sets a deadline so that you act before you check.",
         Without(URGENCY_HARMLESS,
                 Has(r"\b(?:within\s*\d+\s*(?:hour|hr|minute|min|day)|in\s*the\s*next\s*\d+\s*(?:hour|minute)|before\s*(?:midnight|today|tonight|it\s*expires)|expir(?:es|ing|e)\s*(?:today|soon|in)|last\s*(?:chance|warning)|final\s*(?:notice|warning|reminder)|immediately|right\s*away|act\s*now|urgent(?:ly)?|asap)\b")
                 | Has(rf"\b(?:{URGENT_LATIN})\b|{URGENT_DEVANAGARI}|आज\s*रात|aaj\s*raat"))),
    Rule("threat_of_consequence", 1.7, "It threatens arrest, a case or a fine.",
         near(THREAT_FRAME, LEGAL_CONSEQUENCE, "[^.!?]{0,60}") | Has(r"\bchallan\b|चालान|जमानत|मामला\s*दर्ज|case\s*darj") | Has(POLICE_DEVANAGARI)
         | Has(r"(?:नोटिस|विभाग|आयकर|इनकम\s*टैक्स)[^।.!?]{0,60}(?:पेनल्टी|जुर्माने?)\s*से\s*बचने")),
    Rule("prize_or_windfall", 1.9, "It promises winnings or money that you never asked for.",
         Has(WON) | Has(PRIZE) | near(CONGRATS, WINNINGS, r"[\s\S]{0,60}") | near(GUARANTEED, GUARANTEED_PRIZE, r"[\s\S]{0,70}")
         | Has(r"(?:रिफंड|रिवॉर्ड|बोनस|कैशबैक|पॉइंट्स|वापस\s*पान[ेा])[^.!?]{0,45}(?:क्लेम|रिडीम|लिंक|apk|डाउनलोड|फॉर्म|वेरिफ|एक्सपायर|पिन|क्लिक|लॉगिन|लॉग\s*इन)")
         | Has(r"सब्सिडी[^.!?]{0,70}(?:क्लेम|लिंक|apk|डाउनलोड|फॉर्म|वेरिफ|क्लिक|लॉगिन)")),
    Rule("advance_fee", 2.0, "It wants a payment first, to release more money later.",
         Has(r"\b(?:processing\s*fee|clearance\s*fee|customs\s*(?:fee|duty|charge)|release\s*fee|registration\s*fee|handling\s*charge|small\s*(?:fee|amount)|refundable\s*deposit)\b")
         | Has(rf"(?:{FEE})[^.!?]{{0,25}}(?:{_PAY_WORDS})|(?:{_FEE_KINDS})\s*(?:{FEE})[^.!?]{{0,30}}(?:{_PAY_WORDS})|(?:{_PAY_WORDS})[^.!?]{{0,30}}(?:{_FEE_KINDS})\s*(?:{FEE})")
         | Has(rf"(?:लोन|loan)[^.!?]{{0,60}}(?:क्लियरेंस|स्टाम्प|clearance|stamp)[^.!?]{{0,20}}(?:{MONEY})")),
    Rule("impersonated_authority", 1.4, "It says it comes from a bank, an agency or a help desk.",
         ~Known("on_official_domain")
         & (Has(r"\b(?:income\s*tax|irs\b|hmrc|customs|cyber\s*cell|trai\b|rbi\b|microsoft\s*support|apple\s*support)\b")
            | Has(f"(?:{AUTHORITY_CLAIM})[^.!?]{{0,30}}(?:{GENERIC_AUTHORITY}|{POLICE_LATIN})")
            | Has(rf"{POLICE_DEVANAGARI}|bank\s*se\s*bol|बैंक\s*से\s*बोल|hr\s*se\s*bol|कस्टम(?!र)|इनकम\s*टैक्स|आयकर")
            | Has(r"(?:टीम|विभाग|बैंक|कंपनी|ब्यूरो|कार्यालय|निरीक्षक|अधिकारी|एचआर|\bhr)\s*(?:से\s*)?बोल\s*रह[ाी]\s*हू")
            | Has(r"(?:^|[\n।])\s*(?:नारकोटिक्स\s*कंट्रोल\s*ब्यूरो|फूड\s*सेफ्टी\s*विभाग)\s*[:：]"))),
    Rule("secrecy_request", 2.1, "It wants you to tell nobody.",
         WithoutNear(CREDENTIAL_ADVICE, CREDENTIAL_NOUN, 40,
                     Has(r"\b(?:do\s*not\s*(?:tell|inform|discuss|share\s*this)|keep\s*(?:this|it)\s*(?:confidential|secret|between\s*us)|don'?t\s*(?:tell|call|contact)\s*(?:anyone|police|bank)|without\s*informing)\b")
                     | Has(r"(?:kisi\s*ko|police\s*ko|किसी\s*को|पुलिस\s*को|घर\s*वालों\s*को|ghar\s*walon\s*ko)\s*(?:mat|nahi|मत|नहीं)"))),
    Rule("sextortion_threat", 2.3, "It threatens to spread an intimate picture or video.",
         Has(r"\b(?:nude|naked|intimate|obscene|explicit|morphed?)\s*(?:video|photo|picture|pic)\b|screen\s*record(?:ed|ing)?") | Has("न्यूड|नग्न|आपत्तिजनक|अश्लील")
         | (Has("वीडियो|फोटो|तस्वीर|स्क्रीनशॉट|video|photo|screenshot") & Has(r"वायरल|लीक|फैला|भेजने\s*से\s*पहले|भेज(?:ना|ूंगा|\s*दूंगा)|viral|leak(?:ed)?"))),
    Rule("unexpected_attachment_or_install", 1.6, "It wants software installed or an attachment opened.",
         Has(r"\b(?:anydesk|teamviewer|quick\s*support|remote\s*(?:access|desktop)|install\s*(?:this|the)\s*app|download\s*(?:the\s*)?(?:apk|attachment|file)|enable\s*(?:macros|installation\s*from\s*unknown))\b")
         | Has(r"रिमोट\s*एक्सेस|स्क्रीन\s*शेयर|एनीडेस्क|टीमव्यूअर|apk[^.!?]{0,15}डाउनलोड|डाउनलोड\s*कर\w*")),
    Rule("boss_impersonation", 2.3, "It claims to be your boss and is in a hurry.",
         Has(r"\b(?:this\s*is\s*(?:your\s*)?(?:ceo|manager|director|boss|hr)|i(?:'m| am)\s*(?:your\s*)?(?:ceo|manager|boss)|new\s*(?:number|email)[^.!?]{0,30}\b(?:this\s*is|it'?s)\b)")
         | (Has(r"\b(?:ceo|manager|director|boss)\b") & Has(r"\b(?:urgent|discreet|favou?r|right\s*now|quick\s*task)\b"))
         | (Has("बॉस|मैनेजर|डायरेक्टर") & Has(r"बोल\s*रहा|बोल\s*रही|अर्जेंट|जल्दी"))),
    Rule("payment_detail_change", 2.5, "It wants a payment sent to other bank details.",
         Has(r"\b(?:updated?|new|changed?|different)\s*(?:your\s*)?(?:bank(?:ing)?|account|payment|remittance|wire|billing)\s*(?:details|information|info|number)\b")
         | (Has(r"\b(?:payroll|salary)\s*(?:account|portal|details)\b") & Has(r"\b(?:re-?register|re-?enter|update|chang(?:e|ed)|new\s*(?:site|portal|link))\b"))
         | Has(rf"\bbank\s*details?\b[^.!?]{{0,30}}(?:{SEND}|send|share)") | Has(r"\bchange\s*(?:the\s*)?(?:bank|payment)\s*details\b")
         | Has(r"(?:बैंक|सैलरी|पेरोल|payment)\s*(?:अकाउंट|एकाउंट|डिटेल|account|खाता|पासबुक)[^.!?]{0,30}(?:बदल|अपडेट|दोबारा|verify|वेरिफाई|सत्यापित|भर|डाल|लिंक|जोड़|रजिस्टर|अपलोड)")
         | Has(r"(?:ifsc|आईएफएससी)[^।.!?]{0,45}(?:सत्यापित|वेरिफाई|भर|डाल|अपलोड|शेयर|फॉर्म|भेज)")),
    Rule("family_emergency", 2.4, "It claims to be family or a friend in trouble who needs money.", _family & _wants_money & (_unreachable | _crisis)),
    Rule("delivery_redispatch_fee", 2.0, "It says that a delivery needs a payment or a confirmation.",
         InWindow((Has(r"\b(?:deliver(?:y|ed|ies)?|dispatch|shipment)\b") | Has(PARCEL) | Has("डिलीवर")) & AtLeast(2, (_parcel_failed, _parcel_action, _parcel_payment)))),
    Rule("job_advance_fee", 2.2, "It offers work that has to be paid for first.",
         (Has(r"\b(?:job|work\s*from\s*home|part[\s-]?time|data\s*entry|hiring|vacancy|earn|salary|income|packing|typing|recruit)\b") | Has(r"\b(?:ghar\s*baithe|kaam\s*kar|kama(?:iye|ye|o)|naukri)\b")
          | Has(r"घर\s*बैठे|काम\s*कर|कमा(?:एं|इए|ओ)|नौकरी|जॉब|इंटरव्यू|सिलेक्ट|सैलरी|पार्ट\s*टाइम|टास्क|वर्क\s*फ्रॉम\s*होम"))
         & ((Has(r"\b(?:pay|deposit|paying|charge|fee|amount|registration|security|refundable|membership|joining|advance)\b") | Has(rf"{FEE}|{MONEY}|registration|रजिस्ट्रेशन|जॉइनिंग|किट|डिपॉजिट|सिक्योरिटी"))
            & (Has(r"\b(?:registration|security|refundable|membership|joining|processing|courier|kit|training|advance|one[\s-]?time)\b[^.!?]{0,20}\b(?:fee|deposit|charge|amount|payment|of)\b|\b(?:pay|deposit)\b[^.!?]{0,25}\b(?:rs|inr|registration|deposit|membership)\b")
               | Has(rf"(?:registration|रजिस्ट्रेशन|deposit|डिपॉजिट|जॉइनिंग|किट|वेरिफिकेशन|यूनिफॉर्म|आईडी|id\s*(?:card|कार्ड)|सिक्योरिटी|एक्टिवेशन|अनलॉक|{FEE})[^.!?]{{0,30}}(?:{SEND}|bhar|भर|{MONEY})")))),
    Rule("refund_callback", 1.8, "It reports a charge and gives a number to call.",
         (Has(r"\b(?:auto[\s-]?renew(?:ed|al)?|subscription|invoice|order|debited|charged|transaction|purchase|renewal)\b")
          | Has(r"\bdebit\s*hua|कट\s*(?:गया|गई)|कटा\s*है|कटे\s*हैं|डेबिट\s*हु(?:आ|ए|ई)|खाते\s*से|रिफ़?ंड[^।.!?]{0,15}(?:बाकी|पेंडिंग|लंबित)|सब्सक्रिप्शन|ट्रांजैक्शन"))
         & ((Has(r"\b(?:call|dial|contact|helpline|toll[\s-]?free|customer\s*(?:care|support)|reach\s*us)\b") | Has(r"नंबर\s*पर\s*कॉल|number\s*par\s*call|कॉल\s*(?:कर|बैक)|कॉलबैक|कस्टमर\s*केयर|एग्जीक्यूटिव"))
            & (Has(r"\b(?:cancel|refund|dispute|unauthori[sz]ed|not\s*(?:authori[sz]ed|you|recognise|recognize)|if\s*this\s*(?:was|is)\s*not|to\s*stop)\b")
               | Has(r"agar\s*aapne\s*nahi|यदि\s*आपने\s*नहीं|अगर\s*आपने\s*नहीं|nahi\s*kiya|रिफ़?ंड|कैंसिल|वापस\s*(?:पाने|पान)|धोखाधड़ी[^।.!?]{0,20}कॉल|कॉल[^।.!?]{0,30}पैसा\s*रोका")))),
    Rule("investment_scam", 2.2, "It promises a sure or very high return.",
         ~Has(FRAUD_CASE_REPORT)
         & (Has(r"\bguarantee[ds]?\b[^.!?]{0,30}\b(?:returns?|profits?|income)\b") | Has(r"double\s*(?:your\s*)?money")
            | Has(r"(?:लगा|निवेश)\S*[^।.!?]{0,40}(?:दिन|हफ्ते|महीने)\s*में[^।.!?]{0,25}\sपा(?:एं|इए|ओ)|गारंटीड?\s*रिटर्न|एश्योर्ड\s*रिटर्न|पैसा\s*डबल|डेली\s*प्रॉफिट|मल्टीबैगर|गारंटी[^.!?]{0,20}(?:रिटर्न|प्रॉफिट|एलॉटमेंट)")
            | near(INVESTMENT_INSTRUMENT, _YIELD, "[^।.!?]{0,80}"))),
    Rule("windfall_solicitation", 2.2, "A stranger wants to move a large sum through you.",
         (Has(r"\b(?:million|billion|crore|lakh|fortune|inheritance|estate|fund(?:s)?|sum\s*of\s*money|deposit\s*of)\b")
          & Has(r"\b(?:widow|terminal(?:ly)?\s*ill|dying|late\s*husband|deceased|next\s*of\s*kin|beneficiar(?:y|ies)|barrister|army\s*officer|deployed|refugee|orphan|god[\s-]?fearing|trusted\s*partner|business\s*proposal)\b"))
         | Has(r"\b(?:army\s*officer|fauji|transfer\s*ho\s*gaya)\b|सेना\s*अधिकारी|विधवा")),
    Rule("generic_salutation", 0.5, "It greets anybody, not you.", Has(r"^(?:dear\s*(?:customer|user|client|sir\/?\s*madam|account\s*holder|member)|attention\s*customer|hello\s*dear)\b")),
    Rule("reply_to_mismatch_language", 0.9, "It wants an answer to an address or number of its own.",
         Has(r"\b(?:reply\s*(?:to\s*this|with)|call\s*(?:us\s*)?(?:on|at|immediately)|contact\s*(?:us\s*)?(?:on|at)|whatsapp\s*(?:us|me|on))\b") & Has(r"\b(?:immediately|urgent|within|now|asap|24\s*hours)\b")),
)

ASKS_NOTHING = ~Has(ACTION_REQUEST)
EXONERATING: tuple[Rule, ...] = (
    Rule("conversational_context", -1.0, "It reads like part of a conversation.",
         Has(r"\b(?:as\s*(?:we\s*)?discussed|per\s*(?:our|your)\s*(?:last\s*)?(?:call|email|message|conversation)|following\s*up\s*on|thanks\s*for\s*(?:the|your)|re:\s|you\s*mentioned|attached\s*(?:is|are)\s*the)\b")),
    Rule("no_action_requested", -0.8, "It asks for nothing.", ASKS_NOTHING),
    Rule("internal_scheduling", -0.7, "It is about a meeting or routine work.",
         Has(r"\b(?:meeting|standup|stand-up|sync|calendar\s*invite|reschedul|agenda|1:1|retro|sprint|pull\s*request|code\s*review|merge\s*request)\b")),
)

_NO_ASK = next(i for i, r in enumerate(EXONERATING) if r.body is ASKS_NOTHING)
#: A signal of this weight keeps exonerating rules out.
SEVERE_AT = 2.0
SIGNAL = "struct<id:string,weight:double,detail:string,brand:string,layer:int,ord:int>"


def signal(id: str, weight: float | Column, detail: str | Column, layer: int, order: int | Column, brand: Column | None = None) -> Column:
    lift = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(
        lift(id).alias("id"), lift(weight).cast("double").alias("weight"), lift(detail).alias("detail"), (brand if brand is not None else F.lit(None)).cast("string").alias("brand"),
        F.lit(layer).alias("layer"), lift(order).cast("int").alias("ord"),
    )


def total(signals: Column) -> Column:
    return F.aggregate(signals, F.lit(0.0), lambda a, s: a + s["weight"])


class Judge:
    """Positions of the rules that hold for texts, the exonerating ones after the others."""

    def __init__(self) -> None:
        patterns = set().union(*(r.body.patterns() for r in (*RULES, *EXONERATING)))
        self.finder = Finder(frozenset().union(*(w for p in patterns if (w := words_of(p)))))
        self.rules = [(i, r.words() or self.finder.words, r.words() is None, r.body.test) for i, r in enumerate((*RULES, *EXONERATING))]

    def one(self, text: str, known: dict[str, bool]) -> list[int]:
        found = self.finder(text)
        return [i for i, words, always, test in self.rules if (always or not words.isdisjoint(found)) and test(text, known, found)]

    def __call__(self, texts: pd.Series, forms: pd.Series, official: pd.Series) -> pd.Series:
        return pd.Series([self.one(t or "", {"has_credential_form": bool(f), "on_official_domain": bool(o)}) for t, f, o in zip(texts, forms, official, strict=True)])


def evaluate(rows: DataFrame, t: str, has_credential_form: Column | None = None, on_official_domain: Column | None = None, prefix: str = "rule_") -> DataFrame:
    """``rows`` with rule_signals, rule_exonerating, rule_score and no_ask for the normalised text in column ``t``.

    Signals come in rule order. Exonerating rules count only where no signal is severe; the
    score isn't negative. ``no_ask`` says that the text names no action, in either case.
    All rules are tested in Arrow batches, one pass over the text telling which can hold.
    """
    no = F.lit(False)
    context = [F.coalesce(c, no) if c is not None else no for c in (has_credential_form, on_official_domain)]
    judge, first = Judge(), len(RULES)
    held = F.pandas_udf(lambda t, f, o: judge(t, f, o), "array<int>")(F.col(t), *context)
    told = F.array(*[signal(r.id, r.weight, r.detail, 0, i) for i, r in enumerate((*RULES, *EXONERATING))])
    (name,) = [n for n in ("__held",) if n not in rows.columns]
    rows = rows.withColumn(name, held)
    signals = lambda low, high: F.transform(F.filter(name, lambda i: (i >= low) & (i < high)), lambda i: F.get(told, i))
    mild = F.transform(F.filter(name, lambda i: i >= first), lambda i: F.get(told, i).withField("ord", i - first))
    rows = once(rows, **{f"{prefix}signals": signals(0, first)})
    severe = F.exists(F.col(f"{prefix}signals"), lambda s: s["weight"] >= SEVERE_AT)
    kept = F.when(severe, F.array().cast(f"array<{SIGNAL}>")).otherwise(mild)
    rows = once(rows, **{f"{prefix}exonerating": kept, "no_ask": F.array_contains(F.col(name), first + _NO_ASK)}).drop(name)
    return rows.withColumn(f"{prefix}score", F.greatest(F.lit(0.0), total(F.col(f"{prefix}signals")) + total(F.col(f"{prefix}exonerating"))))
