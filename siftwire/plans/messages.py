"""Message table built from ``events``: one SQL text that Spark and DuckDB read alike.

Each event picks one of the templates below and fills it from its own columns, so the table grows
with the events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# (expected, category, text); the place in the list is the template number
TEMPLATES: tuple[tuple[str, str, str], ...] = (
    ("spam", "upi", "Enter UPI PIN to receive Rs {v} from merchant {u}"),
    ("spam", "kyc", "Your SIM KYC is pending, call 9{n9}"),
    ("unsure", "kyc", "KYC pending for account {u}. Details at https://www.hdfcbank.com/kyc{u}"),
    ("spam", "kyc", "Your wallet will be blocked today, update KYC now ref {u}"),
    ("ham", "kyc", "Your account will be blocked today, update KYC at your branch ref {u}"),
    ("spam", "courier", "Parcel {n} held at depot. Pay Rs 25 fee, call 9{n9}"),
    ("spam", "arrest", "Police notice {n}: warrant issued. Transfer Rs {v} to avoid court"),
    ("spam", "care", "Customer care 9{n9}: share OTP for refund"),
    ("spam", "bec", "Buy gift cards today and keep this confidential, ref {u}"),
    ("spam", "job", "Selected for job {n}. Registration fee Rs {v}"),
    ("spam", "emergency", "Accident happened, send Rs {v} on new number"),
    ("spam", "power", "Electricity will be disconnected tonight, call 9{n9}"),
    ("spam", "extortion", "We recorded video of you {u}. Send bitcoin or it goes viral"),
    ("spam", "prize", "Lucky draw result {n} is out"),
    ("spam", "prize", "You won {v} dollars, claim by {u}"),
    ("spam", "otp", "Please tell me the OTP {u}"),
    ("ham", "otp", "Never share OTP {n6} with anyone"),
    ("spam", "link", "Login at http://hdfcbank-{u}.xyz/kyc"),
    ("spam", "link", "Open http://onlinesbi.sbi@evil{u}.xyz/a"),
    ("spam", "link", "Login hdcfbank.com/{u}"),
    ("spam", "link", "Secure at 1cici.co/{u}"),
    ("spam", "link", "Airtel user {u}: verify at freeplan{u}.online"),
    ("spam", "link", "Flipkart order {n}: confirm address at bit.ly/a{u}"),
    ("unsure", "link", "Photos here bit.ly/p{u}"),
    ("ham", "official", "Status at https://www.incometax.gov.in/r{u}"),
    ("ham", "alert", "Rs {v} debited from a/c XX{n4}"),
    ("ham", "alert", "Rs {v} debited from a/c XX{n4}. Details https://www.icicibank.com/{u}"),
    ("spam", "alert", "Rs {v} debited from a/c XX{n4}. Call 9{n9} to block"),
    ("ham", "alert", "Rs {v} sent via UPI. UPI Ref {n9}"),
    ("spam", "alert", "UPI Ref {n9} received. Enter UPI PIN to credit it"),
    ("spam", "alert", "OTP {n6}. Do not share. Cancel at http://safe{u}.co/x"),
    ("ham", "delivery", "Order {n} shipped and will arrive Friday"),
    ("spam", "delivery", "Order {n} shipped. Pay Rs 25 now"),
    ("ham", "challan", "e-challan {n} at https://echallan.parivahan.gov.in/p{u}"),
    ("ham", "kyc", "KYC has been verified for {u}"),
    ("spam", "kyc", "KYC has been verified. Click for reward {u}"),
    ("ham", "expense", "Expense claim {n} approved"),
    ("spam", "expense", "Expense claim {n} approved, buy gift card today"),
    ("spam", "kyc", "खाता बंद हो जाएगा, केवाईसी अपडेट करें {u}"),
    ("spam", "emergency", "Turant paise bhejo, number {u}"),
    ("ham", "chat", "Lunch at noon {u}?"),
    ("ham", "chat", "See amzn.to/x{u}"),
    ("gate", "gate", ""),
    ("gate", "gate", "   "),
    ("gate", "gate", "{long}"),
)
SMS_SOURCES = 7


def messages_sql(events: str = "events") -> str:
    """Columns: msg_id, ts, expected, category, source, text, p (a stand-in probability)."""
    values = ", ".join(f"({i}, '{e}', '{c}', '{t}')" for i, (e, c, t) in enumerate(TEMPLATES))
    return f"""
SELECT e.event_id AS msg_id, e.ts AS ts, t.expected AS expected, t.category AS category,
       'src' || CAST(e.user_id % {SMS_SOURCES} AS VARCHAR(20)) AS source,
       replace(replace(replace(replace(replace(replace(replace(t.text,
         '{{long}}', repeat('long text ', 1200)),
         '{{n9}}', lpad(CAST(e.event_id AS VARCHAR(20)), 9, '0')),
         '{{n6}}', lpad(CAST(e.event_id AS VARCHAR(20)), 6, '0')),
         '{{n4}}', lpad(CAST(e.event_id % 10000 AS VARCHAR(20)), 4, '0')),
         '{{n}}', CAST(e.event_id AS VARCHAR(20))),
         '{{u}}', CAST(e.user_id AS VARCHAR(20))),
         '{{v}}', CAST(CAST(floor(e.value) AS BIGINT) + 100 AS VARCHAR(20))) AS text,
       CAST(CASE e.event_id % 4 WHEN 0 THEN 0.10 WHEN 1 THEN 0.50 WHEN 2 THEN 0.80 ELSE 0.97 END AS DOUBLE) AS p
FROM {events} e
JOIN (VALUES {values}) AS t(tid, expected, category, text)
  ON e.event_id % {len(TEMPLATES)} = t.tid"""


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def messages_from(events: DataFrame) -> DataFrame:
    """The message table over any events DataFrame, batch or streaming."""
    return events.sparkSession.sql(_spark_sql(), events=events)


def _spark_sql() -> str:
    # braces of the template holes are doubled: the SQL formatter reads {name} as a parameter
    body = messages_sql("@@events@@").replace("{", "{{").replace("}", "}}")
    return body.replace("@@events@@", "{events}")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_from(read_table(spark, sf_dir, "events"))
