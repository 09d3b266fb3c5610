"""Red-flag rules, safe-alert signals and their pattern groups, kept as data.

Patterns are in the plain dialect of ``functions.rx``; ``rx.java`` turns them into Java patterns.
"""

from __future__ import annotations

from typing import NamedTuple


class Rule(NamedTuple):
    id: str
    title: str
    explanation: str
    severity: str
    groups: tuple[str, ...] | None  # None: the rule has its own column logic


class Signal(NamedTuple):
    id: str
    title: str
    explanation: str
    groups: tuple[str, ...] | None
    own_block: str | None  # pattern that blocks only this signal


# --- fixed values: shared pattern fragments ------------------------------------------------------
URL_TLDS = (
    "com|net|org|info|biz|ly|in|co|io|xyz|top|club|online|site|me|us|uk|ru|cn|link|live|shop|sbi|app|icu|vip|"
    "buzz|store|click|support|help|cfd|sbs|cyou"
)
URL = rf"(?:https?://\S+|www\.\S+|\b[a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:{URL_TLDS})\b(?:/\S*)?)"
PHONE = r"(?:\+?\d[\dXx\s-]{8,}\d)"
CALL_OR_LINK = (
    rf"(?:{URL}|{PHONE}|\bclick|\bclik|\blink\b|\bcall\b|\bcal\b|\bpress \d|\bdial\b|लिंक|कॉल|क्लिक)"
)
MONEY = (
    r"(?:rs\.?\s?\d|₹\s?\d|inr\s?\d|\$\s?\d|£\s?\d"
    r"|\b\d[\d,]*\s?(?:rs|rupees|dollars?|dolars?|pounds?|k|lakh|lac|crore|hazar|thousand)\b"
    r"|\b(?:lakh|lac|crore|hazar|million|milion|paise|paisa|money|funds|amount|cash)\b|रुपये|लाख|करोड़|पैसे)"
)

# --- fixed values: the rules, in report order ------------------------------------------------------
RULES: tuple[Rule, ...] = (
    Rule(
        "upi_pin_receive", "UPI PIN to receive money",
        "A PIN is only ever entered to pay, so a message that wants one before you can receive money is a "
        "collect-request scam.",
        "high",
        (r"\bupi\s*pin\b|\bupi\s*-?\s*pin\b|\bpin\b.{0,40}\bupi\b|upi.{0,40}\bpin\b|यूपीआई पिन",
         r"receiv|recieve|\bget\b|\bgot\b|credit|cashback|reward|rewrd|refund|collect|colect|paise|milega|mila|"
         r"advance|prize|paaye|free|जीतने|पाने")),
    Rule(
        "kyc_block", "KYC / account / SIM block threat",
        "Threatens to block an account, wallet or SIM and demands a KYC, PAN or Aadhaar update: high with a link or "
        "number, medium without one or when every link is official.",
        "high/medium", None),
    Rule(
        "parcel_fee", "Parcel / courier fee or seizure",
        "Says a parcel is held and wants a small fee, duty or call; couriers do not collect fees through stray links.",
        "high",
        (r"parcel|packa?ge|packge|shipment|courier|deliver|consignment|पार्सल",
         r"\bfee\b|charge|\bduty\b|\bpay\b|bharne|clearance|seized|held|illegal|ilegal|custom",
         CALL_OR_LINK)),
    Rule(
        "arrest_payment", "Police / CBI / arrest threat with payment",
        "Poses as police, customs or a court and threatens arrest unless money moves; no agency asks for that by phone.",
        "high",
        (r"arrest|arest|\bcbi\b|police|cyber cell|customs|\bfir\b|warrant|narcotic|drugs|money laundering|\btrai\b|"
         r"\bjail\b|court|गिरफ्तार|पुलिस",
         r"transfer|\bpay\b|fine|deposit|bhej|\bsend\b|google pay|gpay|press \d|talk to (?:the|our) officer|"
         r"video ca?l|disconnect|" + MONEY)),
    Rule(
        "fake_customer_care", "Unofficial customer-care number asking for OTP/app",
        "Gives a support phone number and asks for an OTP, card details or a remote-access app.",
        "high",
        (r"customer care|customer support|helpline|help line|support team|executive|care number",
         PHONE,
         r"\botp\b|anydesk|teamviewer|quick ?support|install|downlo?a?d|card det|refund|refnd|suspend")),
    Rule(
        "urgent_wire_transfer", "Urgent wire transfer / gift cards / changed bank details",
        "Wants an urgent or secret payment, gift-card codes or a transfer to new bank details, as in boss or vendor fraud.",
        "high",
        (r"wire transfer|bank transfer|\bremit|gift ?cards?|new vendor|new (?:bank )?acc?ount|bank details|"
         r"account has changed|change of bank",
         r"urgent|asap|immediately|today|confidential|keep this|can'?t talk|board meeting|\bceo\b|\bmd\b|director|"
         r"frozen|reimburse")),
    Rule(
        "job_fee", "Job offer that asks you to pay",
        "Offers a job but wants a registration fee, deposit or training charge first.",
        "high",
        (r"\bjob\b|hiring|selected|shortlisted|work from home|part[ -]time|salary|salry|offer let|interview|intervew|"
         r"ghar baithe|kamaye|earn\b|candidate|नौकरी",
         r"registration|\bfee\b|deposit|training kit|refundable|securi?ty|bhejein|\bpay\b|charges?")),
    Rule(
        "emergency_money", "Emergency money request",
        "Asks for money at once because of an accident, hospital, arrest or new number.",
        "high",
        (r"accident|hospital|emergency|trouble|trubble|police station|lost my phone|new number|\bjail\b|\bturant\b|"
         r"urgent|urjent|दुर्घटना|अस्पताल",
         r"\bsend\b|bhejo|bhej\b|bhejein|transfer|google pay|\bgpay|paytm|upi id|" + MONEY)),
    Rule(
        "utility_disconnect", "Electricity / gas disconnection threat",
        "Says power, gas or water is about to be cut and pushes a personal number or link.",
        "high",
        (r"elec\w*city|elecricity|bijli|power|powr|\bgas\b|water connection|बिजली",
         r"disconn?ect|kaat|cut\b|band\b|बंद|काट",
         CALL_OR_LINK)),
    Rule(
        "extortion_threat", "Kidnap / blackmail threat with a money demand",
        "Threatens a relative or a leak of private pictures and demands money.",
        "high",
        (r"kidnap\w*|\b(?:son|daughter|dauter|beti|beta|bachcha|child|wife|husband)\b[^.!?\n]{0,30}"
         r"(?:is with us|hamare paas|in our custody|kabze)"
         r"|never see (?:him|her)|wil?l be hurt|pays the price|(?:recorded|watching|hacked)[^.!?\n]{0,40}webcam"
         r"|webcam[^.!?\n]{0,40}record|morphed (?:photo|pic)\w*"
         r"|video[^.!?\n]{0,25}record|record\w*[^.!?\n]{0,40}video"
         r"|(?:video|photos?|pics?)[^.!?\n]{0,40}(?:contacts|family|friends)",
         r"bitcoin|\bbtc\b|" + MONEY,
         r"\bor\b|warna|otherwise|never see|hurt|police|polic\b|secret|don'?t (?:inform|tell|call)|"
         r"within \d+ ?(?:hours|hrs|minutes)|\d+ ?(?:ghante|ghanta)|watching|leak|viral|price")),
    Rule(
        "prize_claim", "Prize / lottery / 'you won' claim",
        "Says you won a lottery, draw or large sum you never entered for.",
        "high", None),
    Rule(
        "otp_request", "Asks you to share an OTP/PIN",
        "Asks you to tell or share a one-time password or PIN.",
        "high",
        (r"(?<!not )(?<!never )(?<!n't )(?<!mat )\b(?:share|tell|give|batao|bataye|bataen|send)\b[^.!?\n]{0,25}"
         r"\b(?:otp|pin|cvv)\b|\b(?:otp|cvv)\b[^.!?\n]{0,20}\b(?:batao|bataye|बताएं|share karo|bhejo)"
         r"|ओटीपी बताएं|OTP बताएं",)),
    Rule(
        "lookalike_domain", "Look-alike / fake brand web address",
        "The link carries a brand name, or a misspelling of one, but does not belong to that brand; the end of the "
        "host decides who owns it.",
        "high", None),
    Rule(
        "brand_link_mismatch", "Names a brand, but the link goes somewhere else",
        "Names a brand and asks you to act, but the nearby link goes to an unrelated site or a shortener.",
        "medium", None),
    Rule(
        "suspicious_link", "Shortened or look-alike link",
        "Has a shortener, a host built from words such as kyc or verify, or a throw-away ending; official links are "
        "left out.",
        "medium",
        (r"\b(?:bit\.ly|tinyurl\.com|goo\.gl|t\.co|cutt\.ly|is\.gd|rb\.gy|ow\.ly|shorturl\.at|tiny\.cc|1kx\.in)/\S*"
         r"|\b[a-z0-9]+-[a-z0-9-]*(?:kyc|verify|verfy|secure|update|updat|login|reward|refund|billing|track|support|"
         r"redeliver|fee)[a-z0-9-]*\.[a-z]{2,6}\b"
         r"|\b[a-z0-9-]*(?:kyc|verify|verfy|secure|update|login|reward|refund|billing|redeliver)[a-z0-9-]*-"
         r"[a-z0-9-]+\.[a-z]{2,6}\b"
         r"|\b[a-z0-9-]+\.(?:xyz|top|club|online|site|live|shop)\b",)),
)

# --- fixed values: prize rule ------------------------------------------------------------------------
PRIZE_STRONG = r"lottery|lotery|lottry|lucky draw|jackpot|लॉटरी|लकी ड्रा"
PRIZE_WIN = (
    r"\b(?:won|w[o0]n|wo|win|winner|winer|wnr|jeet\w*|jeeta|jeete|jeeti|jita|जीत\w*|selected|slected|badhai)\b"
)
PRIZE_WHAT = (
    r"million|milion|billion|lakh|crore|cash|prize|prise|inaam|inam|reward|voucher|iphone|iphon|"
    r"claim|clame|claime|colect|dollars?|dolars?|pounds?|\$\s?\d|£\s?\d|₹\s?\d|rs\.?\s?\d|लाख|करोड़|इनाम|पुरस्कार"
)

# --- fixed values: account-block rule ---------------------------------------------------------------
KYC_ENTITY = r"\bkyc\b|\bpan\b|aadhaa?r|\bsim\b|yono|केवाईसी|खाता|सिम"
KYC_BLOCKISH = (
    r"block|blok|suspend|suspnd|deactivat|expir|expird|band\b|बंद|disconnect|frozen|freeze|lock|pending|incomplet"
)
BLOCK_WORD = (
    r"(?:block|blok|blck|suspend|suspnd|deactivat|disabl|frozen|freez|clos|band|bandh|बंद|ब्लॉक)\w*"
)
KYC_THREAT = (
    r"\b(?:will|wil|wl|shall|would|may|to|going to)\s+(?:be|b|get|gets)\s+"
    rf"(?:temporarily\s+|permanently\s+|soon\s+)?{BLOCK_WORD}"
    r"|\b(?:block|blok|band|bandh|suspend|deactivate|freeze|close)\w*\s+(?:ho|kar|kr)\s*"
    r"(?:jayega|jaega|jayegi|jaegi|jaayega|diya jayega|diya jaega|di jayegi|denge|dia jayega)"
    r"|\b(?:account|acount|acc|a/c|sim|wallet|khata|card|number|yono)\s+"
    r"(?:is|has been|has|hs|was|got|is being|ho gaya|ho gya)?\s*(?:now\s+)?"
    r"(?:blocked|blokd|blockd|blocked|suspended|suspnded|suspendd|deactivated|frozen|on hold|band)\b"
    r"|\b(?:blocked|blokd|blockd|suspended|suspnded|deactivated)\s+(?:today|tonight|within|in\s+\d|from|after|by)\b"
    r"|\bkyc\s+(?:is\s+|has\s+|hs\s+)?(?:been\s+)?(?:expired|expird|expird|expire ho)"
    r"|बंद (?:कर दिया जाएगा|हो जाएगा)|ब्लॉक (?:कर दिया जाएगा|हो जाएगा)"
)
KYC_DEMAND = (
    r"(?:\bre-?kyc\b)"
    r"|\b(?:update|updte|updat|upd8|complete|complet|verify|verfy|link|submit|renew)\w*\s+(?:\w+\s+){0,2}?"
    r"(?:kyc|pan|aadhaa?r|e-?kyc)\b"
    r"|\b(?:kyc|pan|aadhaa?r|e-?kyc)\b(?:\s*/\s*\w+)?[\s,.:;-]+(?:\w+[\s,.:;-]+){0,2}?"
    r"(?:update|updte|updat|upd8|complete|verify|verfy|link|submit|karein|karo|kare|kariye|kijiye|kar do|kara lo|"
    r"करें|अपडेट)"
    r"|(?:केवाईसी|kyc)\s*(?:तुरंत\s*)?अपडेट"
)
KYC_LINK_OR_NUMBER = rf"(?:{URL}|{PHONE})"
KYC_BRANCH = r"\bbranch\b|\bvisit\b|शाखा"
KYC_OFFICIAL_NOTE = "link is to an official domain, so medium not high"

# --- fixed values: call-to-action words for the brand / link rule -------------------------------------
ACTION = (
    r"verif|verfy|update|updat|claim|clai?me|click|clik|log ?in|sign ?in|\bpay\b|confirm|redeem|activat|"
    r"reschedul|track|unlock|unblock|\bkyc\b|refund|reward|cashback|download|install|submit|visit|"
    r"karein|karo|kijiye|bharein|dekhein"
)
ACTION_BEFORE, ACTION_AFTER = 200, 60  # characters around a link that count as near it

# --- fixed values: safe-alert signals, in report order --------------------------------------------------
SIGNALS: tuple[Signal, ...] = (
    Signal("official_link", "Link goes only to an official domain",
           "Every link belongs to an allowlisted organisation; blocked when a mobile number is given too.",
           None, None),
    Signal("bank_txn_alert", "Standard bank debit/credit alert",
           "Masked account or card number with a debit, credit or balance word.",
           (r"\b(?:a/?c|acct?|account|card)\b[^.\n]{0,25}(?:xx+|\*{2,}|x{2,})\d{2,}|(?:xx+|\*{2,})\d{3,}",
            r"debited|credited|spent|withdrawn|avl\.? ?bal|available balance|txn of"), None),
    Signal("upi_confirmation", "UPI payment confirmation with reference number",
           "Sent or received notice that quotes a transaction reference.",
           (r"\bupi\b",
            r"(?:ref(?:erence)?|utr|txn|transaction)\.?\s*(?:no\.?|number|id)?[:\s#.-]*\d{6,}",
            r"\b(?:sent|received|debited|credited|paid|successful(?:ly)?)\b"), None),
    Signal("otp_notice", "One-time password notice that warns not to share it",
           "Holds a code and warns not to share it, with no link outside official domains.",
           (r"\b(?:otp|one[- ]time password|verification code|login code)\b",
            r"\b\d{4,8}\b",
            r"do not share|don'?t share|never share|not to share|never ask|mat bataye|share na kare|"
            r"kisi ke saath share na"), None),
    Signal("delivery_update", "Courier / order status update",
           "Shipping status from a courier or shop.",
           (r"delhivery|blue ?dart|dtdc|ekart|xpressbees|shadowfax|ecom express|india post|amazon|flipkart|myntra|"
            r"meesho|\border\b|shipment|\bawb\b|tracking|consignment",
            r"has been shipped|\bshipped\b|out for delivery|\bdelivered\b|dispatched|in transit|will arrive|arriving|"
            r"will be delivered"), None),
    Signal("echallan_official", "Traffic e-challan pointing to the official portal",
           "E-challan notice that names the government portal.",
           (r"e-?challan", r"parivahan\.gov\.in"), None),
    Signal("kyc_complete", "KYC completed / verified notice",
           "Says KYC is done and asks for nothing.",
           (r"\bkyc\b",
            r"(?:successfully|been|is)\s+(?:verified|completed|approved)|kyc (?:is )?(?:complete|verified)"),
           r"pending|expir|block|suspend|incomplete|update (?:now|your|immediately)|re-?kyc|click"),
    Signal("expense_approval", "Routine expense / payroll / PO approval",
           "Internal finance notice that something was approved or processed.",
           (r"expense|reimburse|payslip|salary slip|purchase order|\bpo\b|claim\s*#",
            r"approved|processed|will be paid|has been paid|credited"),
           r"gift ?card|new (?:bank )?acc?ount|change of bank|wire transfer|confidential"),
)

# --- fixed values: blockers of safe signals ---------------------------------------------------------------
SHORTENER_LINK = (
    r"\b(?:bit\.ly|tinyurl\.com|goo\.gl|t\.co|cutt\.ly|is\.gd|rb\.gy|ow\.ly|shorturl\.at|tiny\.cc|1kx\.in|"
    r"u1\.mnge\.co)/?\S*"
)
MOBILE = r"(?<!\d)(?:\+?91[\s-]?)?[6-9][\dXx]{4}[\s-]?[\dXx]{5}(?!\d)"
CREDENTIALS = (
    r"\b(?:enter|share|send|provide|give|tell|batao|bataye|type|confirm|update|submit|reply with)\b"
    r"[^.!?\n]{0,30}\b(?:upi ?pin|pin|otp|password|passcode|cvv|card (?:number|details|no)|"
    r"net ?banking|login details|mpin)\b"
)
NEGATED_BEFORE = r"(?:not|never|n't|mat|na|nahi)\W+(?:\w+\W+){0,2}$"
NEGATION_WINDOW = 25
PAYMENT = (
    r"\bpay(?:\s+(?:(?:now|rs|inr|the|a|your)\b|₹|\d))|\bfee\b|\bcharges? of\b|\bdeposit\b|"
    r"(?:transfer|send|bhejo|bhejein)\s+(?:rs\.?|inr|₹|\d)|\bpayment (?:of|due)\b|"
    r"\b(?:send|transfer|pay|bhejo|bhejein)\b[^.\n]{0,40}"
    r"(?:upi ?id|\bvpa\b|\b[\w.-]+@(?:ybl|ok\w+|paytm|upi|ibl|axl|apl)\b)"
)
CALL_TO_AVOID = (
    r"(?:call|contact|dial|whatsapp)\b[^.\n]{0,50}(?:block|suspend|deactivat|disconnect|band\b|avoid)|"
    r"(?:block|suspend|deactivat|disconnect|band ho)[^.\n]{0,60}(?:call|contact|dial)\b"
)

RULE_BY_ID = {r.id: r for r in RULES}
SIGNAL_BY_ID = {s.id: s for s in SIGNALS}

#: Everything that is looked for in the text of a message.
PATTERNS = tuple(dict.fromkeys([
    *(g for x in (*RULES, *SIGNALS) for g in x.groups or ()), *(s.own_block for s in SIGNALS if s.own_block),
    PRIZE_STRONG, PRIZE_WIN, PRIZE_WHAT, KYC_ENTITY, KYC_BLOCKISH, CALL_OR_LINK, KYC_THREAT, KYC_DEMAND, KYC_LINK_OR_NUMBER, KYC_BRANCH,
    PHONE, MOBILE, SHORTENER_LINK, CREDENTIALS, PAYMENT, CALL_TO_AVOID]))
