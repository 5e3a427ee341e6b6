"""Brands, host lists, scripts with look-alike characters and public suffixes of the fixtures."""

from __future__ import annotations

# Protected brands in order, each with the domains it signs users in on and its aliases.
BRANDS = (
    ("PayPal", ("paypal.com",), ("paypal", "pay pal")),
    ("Amazon", ("amazon.com", "amazon.in", "amazon.co.uk"), ("amazon",)),
    ("Apple", ("apple.com", "icloud.com"), ("apple id", "icloud", "apple account")),
    ("Microsoft", ("microsoft.com", "live.com", "outlook.com", "office.com", "microsoftonline.com", "sharepoint.com", "skype.com", "azure.com"), ("microsoft", "outlook", "office 365", "onedrive")),
    ("Google", ("google.com", "gmail.com", "youtube.com", "google.co.in", "googleusercontent.com"), ("google account", "gmail", "google drive")),
    ("Netflix", ("netflix.com",), ("netflix",)),
    ("Facebook", ("facebook.com", "instagram.com", "whatsapp.com"), ("facebook", "instagram", "whatsapp")),
    ("LinkedIn", ("linkedin.com",), ("linkedin",)),
    ("FedEx", ("fedex.com",), ("fedex",)),
    ("DHL", ("dhl.com",), ("dhl",)),
    ("Chase", ("chase.com",), ("chase bank", "jpmorgan chase")),
    ("HDFC Bank", ("hdfcbank.com",), ("hdfc", "hdfc bank", "netbanking hdfc")),
    ("ICICI Bank", ("icicibank.com",), ("icici", "icici bank")),
    ("State Bank of India", ("onlinesbi.sbi", "sbi.co.in"), ("state bank of india", "onlinesbi", "yono sbi", "sbi net banking")),
    ("Axis Bank", ("axisbank.com",), ("axis bank",)),
    ("NPCI / UPI", ("npci.org.in",), ("npci", "bhim upi")),
    ("Income Tax India", ("incometax.gov.in",), ("income tax department", "incometax.gov.in")),
)
BRAND_DOMAINS = tuple(d for _, domains, _ in BRANDS for d in domains)

# Link shorteners.
SHORTENERS = ("bit.ly", "tinyurl.com", "goo.gl", "t.co", "ow.ly", "is.gd", "buff.ly", "rebrand.ly", "cutt.ly", "shorturl.at", "rb.gy", "tiny.cc", "bl.ink", "t.ly", "snip.ly", "s.id", "clck.ru", "u.to", "v.gd")
# Top-level domains with high abuse rates.
RISKY_TLDS = ("zip", "mov", "tk", "ml", "ga", "cf", "gq", "xyz", "top", "buzz", "click", "link", "work", "loan", "download", "review", "country", "kim", "men", "rest", "cam", "quest", "cfd", "sbs", "lol")
# Domains of hosted sign-in services.
HOSTED_AUTH = ("google.com", "googleapis.com", "firebaseapp.com", "microsoft.com", "microsoftonline.com", "auth0.com", "okta.com", "oktapreview.com", "onelogin.com", "amazoncognito.com", "pingone.com", "pingidentity.com")

# Code points of scripts whose letters are folded onto the Latin letter that they read as.
FOLDED_SCRIPTS = (
    (0x00C0, 0x024F), (0x0250, 0x02AF), (0x1D00, 0x1DBF), (0x1E00, 0x1EFF), (0x2C60, 0x2C7F), (0xA720, 0xA7FF), (0xAB30, 0xAB6F), (0x10780, 0x107BF), (0x1DF00, 0x1DFFF),  # Latin
    (0x0370, 0x03FF), (0x1F00, 0x1FFF), (0x2C80, 0x2CFF),  # Greek, Coptic
    (0x0400, 0x052F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F), (0x1E030, 0x1E08F), (0x0530, 0x058F),  # Cyrillic, Armenian
    (0x13A0, 0x13FF), (0xAB70, 0xABBF), (0xA4D0, 0xA4FF), (0x11FB0, 0x11FBF), (0x10400, 0x1044F), (0x104B0, 0x104FF),  # Cherokee, Lisu, Deseret, Osage
    (0x10300, 0x1032F), (0x102A0, 0x102DF), (0x10280, 0x1029F), (0x10500, 0x1052F),  # Old Italic, Carian, Lycian, Elbasan
)

# Readings that later versions of the Unicode data give.
LATER_READINGS = {"ӏ": "l"}

# The public suffixes that hosts of the fixtures meet, for their SQL. ``domains.public_suffixes`` has the whole list.
FIXTURE_SUFFIXES = (
    "com", "net", "org", "edu", "gov", "int", "io", "co", "in", "uk", "us", "ru", "de", "fr", "es", "jp", "sbi", "app", "dev", "ly", "gl", "gd", "at", "gy", "cc", "ink", "id", "to", "me", "info", "biz", "xyz", "top", "tk", "ml", "ga", "cf", "gq", "zip", "mov", "click", "link", "lol", "ck",
    "co.uk", "org.uk", "ac.uk", "gov.uk", "co.in", "org.in", "net.in", "gov.in", "ac.in", "co.jp", "ne.jp", "com.au", "com.br", "github.io", "gitlab.io", "netlify.app", "vercel.app", "pages.dev", "web.app", "firebaseapp.com", "googleapis.com", "blogspot.com", "herokuapp.com", "azurewebsites.net", "myshopify.com",
    "kawasaki.jp", "*.kawasaki.jp", "!city.kawasaki.jp", "*.ck", "!www.ck",
)
