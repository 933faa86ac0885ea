"""Relations that the queries run on, derived from the given tables: messages, urls, conversation messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from smishlake.operators.networks import address
from smishlake.sources.tables import read_table, spread

#: Phrases that put the detectors to work on prose without any of their words; some hold U+200B.
PHRASES = (
    "Lunch is moved to half past one, see you at the usual table.",
    "AX-SBIINB: your savings account stays blocked until the KYC form is filled in. Go to https://sbi-kyc-update.xyz/form and click submit now.",
    "Bhai apka acnt kal tak band ho jayega, jaldi KYC upd8 kro http://kyc-desk.click/go par.",
    "V​M-H​DFCBK: y0ur c@rd is b1ocked! V-e-r-i-f-y 1mmediatley h3re http://hdfc-verify.top/card",
    "Courier desk: one parcel waits for customs clearance, settle the fee at http://fedex-customs.live/desk",
    "Power office notice: bijli supply ends tonight because of an unpaid bill, ring 9123456780 within 2 hours.",
    "आपके खाते की केवाईसी समाप्त हो गई है, अभी पैन अपडेट करें, नहीं तो कार्ड ब्लॉक होगा।",
    "H.D.F.C c4rd l0cked, upd8 at http://hdfc-desk.ml/card",
    "Use 771204 as one time password for the ticket counter.",
    "Pleeease transfer INR 750 to collect.scam@paytm or fraudmerchant@okaxis before evening.",
    "Our engineer needs teamviewer on the phone, dial 0 7012345678 for remote access.",
    "Netbanking stays suspended, reply with card number, cvv and password.",
    "Axis Bank statement for June can be read at https://www.axisbank.com/statement as always.",
    "Dear valued client, PAN and KYC of the ICICI Bank account expire today.",
    "The HDFC counter near the station was crowded when I paid in the rent.",
    "Congratulations, your number is the winner of the spring lottery, claim the prize at www.spring-draw.top/claim at once.",
    "Part time typing job, daily salary 3000 rupees, write to desk@hiring.example.com from 10.20.30.40 or 9.9.9.9.",
    "Welcome to the shop, your order is on its way, tracking number inside http://bit.ly/parcelnote",
    "This is an official notice of the income tax officer, a penalty and legal action follow, transfer the fine immediately.",
    "Thank you for your patience, the case closed and your refund will be credited.",
)
SENDERS = ("AX-SBIINB", "VM-HDFCBK", "", "TM-JIOSMS", "BP-FEDEX", "+917012345678", "AD-OFFERS")
URLS = (
    "http://axis-kyc.icu/form", "http://one.two.three.four.five.example.org/", "http://shop.buzz.top/Q7vLw2ZrT9xKb4NfYcHsJ1mPdG8eRu3A?k=zX5tW0qB", "http://example.org/free-gift/bonus?ref=9", "http://portal.example.org/?aadhaar=confirm",
    "http://icici-card.example.top/otp", "http://icici.co.in/branches", "http://xn--hdfc-bnk.example.org/", "http://198.18.7.9/login", "http://cutt.ly/a1b2c3", "http://example.org/%253Cscript%253E", "http://root:hunter2@files.example.org/",
    "http://files.example.org:8443/get", "http://jump.example.top/go?to=https://pay.example.click/x", "http://example.org/read#https://pay.example.top/now", "http://a@b.example.org@c.example.top/", "http://example.org/contact",
    "http://127.8.9.10/", "http://10.77.0.1/a", "http://172.20.1.1/", "http://192.168.44.5/", "http://169.254.169.254/meta", "ftp://mirror.example.org/b", "http://localhost:7000/", "http://metadata.google.internal/v1", "http://3232235777/", "http://files.example.org:70000/", "http://guest@files.example.org/", "is.gd/q1w2",
)


def messages(spark: SparkSession, folder: str) -> DataFrame:
    """A phrase before each whole document, a sender, and a time one minute after the one before."""
    d = spread(read_table(spark, folder, "documents").select("doc_id", "text", "source"))
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.pmod("doc_id", F.lit(len(PHRASES))) + 1).cast("int"))
    sender = F.element_at(F.array(*map(F.lit, SENDERS)), (F.pmod("doc_id", F.lit(len(SENDERS))) + 1).cast("int"))
    text = F.concat(phrase, F.lit(" "), F.coalesce("text", F.lit("")))
    return d.select(F.col("doc_id").alias("msg_id"), text.alias("raw_text"), sender.alias("sender_id"), "source", F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60).alias("received_at"))


def page_urls(spark: SparkSession, folder: str) -> DataFrame:
    """The URL of each page, and for each page one of the URLs above."""
    p = read_table(spark, folder, "pages").select("page_id", "url")
    made = F.element_at(F.array(*map(F.lit, URLS)), (F.pmod("page_id", F.lit(len(URLS))) + 1).cast("int"))
    return p.select((F.col("page_id") * 2).alias("url_id"), "url").unionByName(p.select((F.col("page_id") * 2 + 1).alias("url_id"), made.alias("url")))


def conversation_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Each turn with a phrase before it, so that stages change from turn to turn."""
    c = spread(read_table(spark, folder, "conversations"))
    phrase = F.element_at(F.array(*map(F.lit, PHRASES)), (F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(len(PHRASES))) + 1).cast("int"))
    return c.select("conv_id", "turn", "role", F.concat(phrase, F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))


def dotted(number):
    """A number as an IPv4 literal."""
    return F.concat_ws(".", *(F.pmod(F.floor(number / 256**i), F.lit(256)).cast("long").cast("string") for i in (3, 2, 1, 0)))


def event_addresses(spark: SparkSession, folder: str) -> DataFrame:
    """event_id, address (see operators.networks): an IPv4 address that follows from the user of each event."""
    e = spread(read_table(spark, folder, "events").select("event_id", "user_id"))
    return e.select("event_id", address(dotted(F.pmod(F.col("user_id") * 2_654_435_761 + F.col("event_id"), F.lit(1 << 32)))).alias("address"))


def customer_networks(spark: SparkSession, folder: str) -> DataFrame:
    """cidr, owner: a network of 4 to 19 bits for each customer."""
    c = read_table(spark, folder, "customer")
    number = F.pmod(F.col("c_custkey") * 1_327_217_885, F.lit(1 << 32))
    return c.select(F.concat(dotted(number), F.lit("/"), (F.pmod("c_custkey", F.lit(16)) + 4).cast("string")).alias("cidr"), F.col("c_custkey").alias("owner"))


def vectors(spark: SparkSession, folder: str) -> DataFrame:
    return read_table(spark, folder, "embeddings").withColumn("embedding", F.transform("embedding", lambda x: x.cast("double")))


def values(spark: SparkSession, rows, ddl: str) -> DataFrame:
    return spark.createDataFrame(rows, T.StructType.fromDDL(ddl))
