"""Host allowlist, brand lists and domain sets, kept as data."""

from __future__ import annotations

# --- fixed values: official domain -> owner --------------------------------------------------
OFFICIAL: dict[str, str] = {
    "gov.in": "Government of India (any *.gov.in)",
    "nic.in": "National Informatics Centre (any *.nic.in)",
    "bank.in": "RBI-regulated bank (any *.bank.in, RBI's bank-only domain)",
    "sbi": "State Bank of India (.sbi is SBI's own top-level domain)",
    "sbi.co.in": "SBI",
    "onlinesbi.sbi": "SBI",
    "sbicard.com": "SBI Card",
    "sbilife.co.in": "SBI Life",
    "sbimf.com": "SBI Mutual Fund",
    "hdfcbank.com": "HDFC Bank",
    "hdfc.com": "HDFC",
    "hdfclife.com": "HDFC Life",
    "hdfcergo.com": "HDFC ERGO",
    "hdfcsec.com": "HDFC Securities",
    "hdfcfund.com": "HDFC Mutual Fund",
    "icicibank.com": "ICICI Bank",
    "icicidirect.com": "ICICI Direct",
    "icicilombard.com": "ICICI Lombard",
    "iciciprulife.com": "ICICI Prudential Life",
    "axisbank.com": "Axis Bank",
    "axisdirect.in": "Axis Direct",
    "axismf.com": "Axis Mutual Fund",
    "kotak.com": "Kotak Mahindra Bank",
    "kotaksecurities.com": "Kotak Securities",
    "pnbindia.in": "Punjab National Bank",
    "bankofbaroda.in": "Bank of Baroda",
    "bankofbaroda.com": "Bank of Baroda",
    "canarabank.com": "Canara Bank",
    "unionbankofindia.co.in": "Union Bank of India",
    "idfcfirstbank.com": "IDFC FIRST Bank",
    "yesbank.in": "Yes Bank",
    "indusind.com": "IndusInd Bank",
    "bankofindia.co.in": "Bank of India",
    "centralbankofindia.co.in": "Central Bank of India",
    "indianbank.in": "Indian Bank",
    "iob.in": "Indian Overseas Bank",
    "idbibank.in": "IDBI Bank",
    "federalbank.co.in": "Federal Bank",
    "rblbank.com": "RBL Bank",
    "aubank.in": "AU Small Finance Bank",
    "bandhanbank.com": "Bandhan Bank",
    "rbi.org.in": "Reserve Bank of India",
    "npci.org.in": "NPCI (UPI / BHIM)",
    "bhimupi.org.in": "BHIM (NPCI)",
    "paytm.com": "Paytm",
    "paytm.in": "Paytm",
    "paytmbank.com": "Paytm Payments Bank",
    "paytmmoney.com": "Paytm Money",
    "phonepe.com": "PhonePe",
    "pay.google.com": "Google Pay",
    "mobikwik.com": "MobiKwik",
    "razorpay.com": "Razorpay",
    "zerodha.com": "Zerodha",
    "groww.in": "Groww",
    "paypal.com": "PayPal",
    "amazon.in": "Amazon India",
    "amazon.com": "Amazon",
    "amazon.co.uk": "Amazon UK",
    "amazon.de": "Amazon Germany",
    "amazon.ca": "Amazon Canada",
    "amazon.com.au": "Amazon Australia",
    "flipkart.com": "Flipkart",
    "myntra.com": "Myntra",
    "meesho.com": "Meesho",
    "swiggy.com": "Swiggy",
    "zomato.com": "Zomato",
    "irctc.co.in": "IRCTC",
    "licindia.in": "LIC",
    "netflix.com": "Netflix",
    "mygov.in": "MyGov (Government of India)",
    "jio.com": "Jio",
    "jiomart.com": "JioMart",
    "jiocinema.com": "JioCinema",
    "jiosaavn.com": "JioSaavn",
    "airtel.in": "Airtel",
    "airtel.com": "Airtel",
    "myvi.in": "Vi (Vodafone Idea)",
    "bsnl.co.in": "BSNL",
    "indiapost.gov.in": "India Post",
    "delhivery.com": "Delhivery",
    "bluedart.com": "Blue Dart",
    "dtdc.in": "DTDC",
    "dtdc.com": "DTDC",
    "ekartlogistics.com": "Ekart (Flipkart)",
    "xpressbees.com": "XpressBees",
    "shadowfax.in": "Shadowfax",
    "ecomexpress.in": "Ecom Express",
    "fedex.com": "FedEx",
    "dhl.com": "DHL",
    "ups.com": "UPS",
    "incometax.gov.in": "Income Tax Department",
    "uidai.gov.in": "UIDAI (Aadhaar)",
    "epfindia.gov.in": "EPFO",
    "parivahan.gov.in": "Parivahan / e-challan",
    "cybercrime.gov.in": "National Cyber Crime Portal",
    "sancharsaathi.gov.in": "Sanchar Saathi (DoT)",
}

# --- fixed values: short links owned by a brand, look-alike-free suffixes, shorteners ---------
NEUTRAL = ("amzn.to", "amzn.in", "a.co", "fkrt.it", "paytm.me", "p-y.tm")
NEUTRAL_SUFFIXES = ("amazonaws.com", "cloudfront.net", "axis.com")
SHORTENERS = (
    "bit.ly", "tinyurl.com", "goo.gl", "t.co", "cutt.ly", "is.gd", "rb.gy", "ow.ly", "shorturl.at",
    "tiny.cc", "1kx.in", "u1.mnge.co", "t.ly", "s.id", "v.gd", "shorte.st", "rebrand.ly", "bl.ink",
    "tinu.be", "short.gy", "qr.ae",
)
# --- fixed values: two-level public suffixes ---------------------------------------------------
TWO_LEVEL = (
    "co.in", "org.in", "net.in", "gov.in", "ac.in", "edu.in", "res.in", "nic.in", "bank.in", "fin.in",
    "firm.in", "gen.in", "ind.in", "co.uk", "org.uk", "com.au", "co.za", "com.br", "com.ng",
)
# --- fixed values: top-level domains that make a bare word a link ------------------------------
LINK_TLDS = (
    "com|net|org|info|biz|ly|in|co|io|xyz|top|club|online|site|me|us|uk|ru|cn|link|live|shop|sbi|app|cc|tk|"
    "icu|vip|buzz|store|click|support|help|gle|ml|ga|cf|gq|pw|cyou|lat|sbs|bond|work|win|loan|today|website|"
    "space|fun|tech|ws|su|cfd|rest"
)
# --- fixed values: short-link hosts that count as links when a path follows --------------------
SHORT_LINK_HOSTS = r"bit\.ly|amzn\.to|fkrt\.it|t\.ly|is\.gd|v\.gd|rb\.gy"
# --- fixed values: characters dropped from the end of a link -----------------------------------
LINK_TAIL = ".,;:!?)]}'\""

# --- fixed values: brand, pattern on a host token, words matched with one typo ------------------
HOST_BRANDS: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("SBI", r"^s+bi|sbi$|onlinesbi|^yono", ("onlinesbi", "statebank")),
    ("HDFC Bank", r"hdfc|hdffc", ("hdfcbank",)),
    ("ICICI Bank", r"[il]c[il]c[il]|icicbank", ("icicibank",)),
    ("Axis Bank", r"^axis", ("axisbank",)),
    ("Kotak", r"kotak", ("kotakbank",)),
    ("PNB", r"^pnb|pnb$|punjabnational", ()),
    ("Bank of Baroda", r"bankofbaroda|^bobworld|^bobcard", ("bankofbaroda",)),
    ("Canara Bank", r"canarabank|^canara", ("canarabank",)),
    ("Union Bank", r"unionbank", ("unionbank",)),
    ("IDFC FIRST", r"idfc", ("idfcfirst",)),
    ("Yes Bank", r"yesbank", ()),
    ("IndusInd", r"indusind", ("indusind",)),
    ("RBI", r"^rbi|rbi$|reservebank", ()),
    ("Paytm", r"p[ae]yt[iey]?m|paytn|paytmm", ()),
    ("PhonePe", r"phonepe|phonpe|fonepe|phonepay", ()),
    ("Google Pay", r"googlepay|^gpay|gpay$", ()),
    ("BHIM / NPCI", r"bhimupi|^bhim$|npci", ()),
    ("Amazon", r"amazon|^amzn|amaz0n", ()),
    ("Flipkart", r"flipkart|flipcart|flpkart", ("flipkart",)),
    ("Jio", r"^jio|jio$", ()),
    ("Airtel", r"airtel|airtl$|airtell", ()),
    ("Vi (Vodafone Idea)", r"vodafone|vodaidea|^myvi$", ()),
    ("BSNL", r"bsnl", ()),
    ("India Post", r"indiapost|^ippb", ("indiapost",)),
    ("Delhivery", r"delhivery|delhivry|dehlivery|delhiveri", ()),
    ("Blue Dart", r"bluedart|blu?edart", ("bluedart",)),
    ("DTDC", r"dtdc", ()),
    ("Income Tax Dept", r"incometax|incomtax|^itrefund", ("incometax",)),
    ("UIDAI / Aadhaar", r"uidai|uidia|aadha+r|aadhar|adhaar|aadahr", ()),
    ("EPFO", r"^epfo|epfindia", ()),
    ("Parivahan / e-challan", r"parivahan|echallan|e-?chalan", ()),
    ("IRCTC", r"irctc", ()),
    ("FedEx", r"fedex|fedx|fed-ex", ()),
    ("DHL", r"^dhl|dhl$", ()),
    ("PayPal", r"paypal|paypai|paypall", ("paypal",)),
    ("Netflix", r"netflix|netflx|netfliks", ()),
)

# --- fixed values: brand, pattern on message text -----------------------------------------------
TEXT_BRANDS: tuple[tuple[str, str], ...] = (
    ("SBI", r"\bsbi\b|\byono\b|state bank of india"),
    ("HDFC Bank", r"\bhdfc\b"),
    ("ICICI Bank", r"\bicici\b"),
    ("Axis Bank", r"\baxis bank\b"),
    ("Kotak", r"\bkotak\b"),
    ("PNB", r"\bpnb\b|punjab national bank"),
    ("Bank of Baroda", r"bank of baroda|\bbob (?:world|card|a/?c|account|customer)"),
    ("Canara Bank", r"\bcanara\b"),
    ("Union Bank", r"union bank"),
    ("IDFC FIRST", r"\bidfc\b"),
    ("Yes Bank", r"\byes bank\b"),
    ("IndusInd", r"\bindusind\b"),
    ("RBI", r"\brbi\b|reserve bank"),
    ("Paytm", r"\bpaytm\b"),
    ("PhonePe", r"\bphone ?pe\b"),
    ("Google Pay", r"\bgoogle pay\b|\bgpay\b"),
    ("BHIM / NPCI", r"\bbhim\b|\bnpci\b"),
    ("Amazon", r"\bamazon\b"),
    ("Flipkart", r"\bflipkart\b"),
    ("Jio", r"\bjio\b"),
    ("Airtel", r"\bairtel\b"),
    ("Vi (Vodafone Idea)", r"\bvodafone\b|\bvi (?:user|customer|sim|number|prepaid|postpaid)\b"),
    ("BSNL", r"\bbsnl\b"),
    ("India Post", r"\bindia ?post\b"),
    ("Delhivery", r"\bdelhivery\b"),
    ("Blue Dart", r"\bblue ?dart\b"),
    ("DTDC", r"\bdtdc\b"),
    ("Income Tax Dept", r"income ?tax|\bitr\b"),
    ("UIDAI / Aadhaar", r"\buidai\b|\baadhaa?r\b"),
    ("EPFO", r"\bepfo?\b"),
    ("IRCTC", r"\birctc\b"),
    ("Parivahan / e-challan", r"e-?challan|parivahan"),
    ("FedEx", r"\bfedex\b"),
    ("DHL", r"\bdhl\b"),
    ("PayPal", r"\bpaypal\b"),
    ("Netflix", r"\bnetflix\b"),
)

# --- fixed values: characters that pass for letters ----------------------------------------------
HOMOGLYPH_FROM, HOMOGLYPH_TO = "0134578@$", "oieastbas"
L_FORM_FROM, L_FORM_TO = "10", "lo"
HOMOGLYPH_PAIRS = (("rn", "m"), ("vv", "w"))
