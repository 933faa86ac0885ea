"""DuckDB SQL for the registered queries, over the same parquet tables."""

from __future__ import annotations

import ipaddress
import unicodedata

from smishlake.functions import constants as C
from smishlake.operators.augment import FIXED, PRIME, RANDOM, STEPS, code_of
from smishlake.plans import relations as R


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strings(values) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


def listed(values) -> str:
    return "(" + ", ".join(map(q, values)) + ")"


def mapping(values: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"{q(k)}: {q(v)}" for k, v in values.items()) + "}"


def word(pattern: str) -> str:
    return rf"\b(?:{pattern})\b"


def plain(c: str) -> str:
    """Letters beyond ASCII as underscores, so that RE2's ASCII word boundary sees them as letters."""
    return f"regexp_replace({c}, '[À-ÖØ-öø-ɏऄ-हक़-ॡ]', '_', 'g')"


MESSAGES = f"""m AS (SELECT doc_id AS msg_id, {strings(R.PHRASES)}[(doc_id % {len(R.PHRASES)} + 1)::INT] || ' ' || coalesce(text, '') AS raw_text,
  {strings(R.SENDERS)}[(doc_id % {len(R.SENDERS)} + 1)::INT] AS sender_id, source, 1704067200 + doc_id * 60 AS epoch FROM documents)"""
URLS = f"""pu AS (SELECT page_id * 2 AS url_id, url FROM pages UNION ALL SELECT page_id * 2 + 1, {strings(R.URLS)}[(page_id % {len(R.URLS)} + 1)::INT] FROM pages)"""
CONVERSATIONS = f"""cm AS (SELECT conv_id, turn, {strings(R.PHRASES)}[((conv_id * 7 + turn) % {len(R.PHRASES)} + 1)::INT] || ' ' || coalesce(text, '') AS text FROM conversations)"""


#: Types of log entries, in the order of the passes.
LOG_TYPES = ("ZERO_WIDTH", "CONFUSABLE", "PUNCTUATION", "DOMAIN_BRACKETS", "REPEATED", "OCR_DIGIT", "LEET", "VOWELS_DROPPED", "KEYBOARD_TYPO", "ABBREVIATION", "WHITE_SPACE")


# ---- normalisation -----------------------------------------------------------------------------------------------------
def _words(c: str, change: str) -> str:
    return f"array_to_string(list_transform(string_split({c}, ' '), lambda w: {change}), ' ')"


def _hits(c: str, test: str) -> str:
    return f"len(list_filter(string_split({c}, ' '), lambda w: {test}))"


def _recased(new: str) -> str:
    title = r"^\P{L}*\p{Lu}\p{Ll}*(?:\P{L}+\p{Lu}\p{Ll}*)*\P{L}*$"
    return f"CASE WHEN upper(w) = w AND lower(w) <> w THEN upper({new}) WHEN regexp_matches(w, {q(title)}) THEN upper({new}[1]) || {new}[2:] ELSE {new} END"


def normalised(source: str = "m", keys: str = "msg_id, raw_text, sender_id, epoch", plain: str = "t1") -> str:
    """CTEs that end in n: keys, norm (normalised text), changes (log entries), language, deva, latin. plain is t1 (without
    characters of no width) in composed letters; as it is where the texts hold no others."""
    five = "t4"
    for c in "abcdefghijklmnopqrstuvwxyz":
        five = f"regexp_replace({five}, '(?i)({c}){c}{{2,}}', '\\1', 'g')"
    repeats = " + ".join(f"len(regexp_extract_all(t4, '(?i){c}{{3,}}'))" for c in "abcdefghijklmnopqrstuvwxyz")
    letter = "a-zA-Zऀ-ॿ"
    spacer = f"'([{letter}])[.\\-_*~^]([{letter}])', '\\1\\2', 'g'"
    leet = r"regexp_matches(w, '\p{L}') AND regexp_matches(w, '[0-9@$!|+€£]')"
    vowel, trim = "regexp_replace(lower(w), '[^a-z0-9]', '', 'g')", "trim(lower(w), '.,!?;:')"
    vmap, kmap, amap = mapping(C.VOWEL_DELETED), mapping(C.KEYBOARD_TYPOS), mapping(C.ABBREVIATIONS)
    markers = listed(C.HINGLISH_MARKERS)
    return f"""
a1 AS (SELECT *, regexp_replace(raw_text, '[{C.ZERO_WIDTH}]+', '', 'g') AS t1 FROM {source}),
a2 AS (SELECT *, translate({plain}, {q(C.CONFUSABLE_FROM)}, {q(C.CONFUSABLE_TO)}) AS t2 FROM a1),
a3 AS (SELECT *, regexp_replace(regexp_replace(t2, {spacer}), {spacer}) AS t3 FROM a2),
a4 AS (SELECT *, regexp_replace(t3, '\\[\\.?\\]|\\(\\.\\)|\\{{\\.?\\}}', '.', 'g') AS t4 FROM a3),
a5 AS (SELECT *, {five} AS t5 FROM a4),
a6 AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t5, '([a-zA-Z])0([a-zA-Z])', '\\1o\\2', 'g'), '([a-zA-Z])0([a-zA-Z])', '\\1o\\2', 'g'), '([a-zA-Z])1([a-zA-Z])', '\\1l\\2', 'g'), '([a-zA-Z])1([a-zA-Z])', '\\1l\\2', 'g') AS t6 FROM a5),
a7 AS (SELECT *, {_words("t6", f"CASE WHEN {leet} THEN translate(w, {q(C.LEET_FROM)}, {q(C.LEET_TO)}) ELSE w END")} AS t7 FROM a6),
a8 AS (SELECT *, {_words("t7", f"CASE WHEN {vowel} IN {listed(C.VOWEL_DELETED)} THEN {_recased(f'({vmap}[{vowel}])')} ELSE w END")} AS t8 FROM a7),
a9 AS (SELECT *, {_words("t8", f"CASE WHEN {trim} IN {listed(C.KEYBOARD_TYPOS)} THEN {kmap}[{trim}] ELSE w END")} AS t9 FROM a8),
a10 AS (SELECT *, {_words("t9", f"CASE WHEN {trim} IN {listed(C.ABBREVIATIONS)} THEN {_recased(f'({amap}[{trim}])')} ELSE w END")} AS t10 FROM a9),
a11 AS (SELECT *, trim(regexp_replace(t10, '[\\s\\v\\p{{Z}}]+', ' ', 'g')) AS norm FROM a10),
n0 AS (SELECT *, [(raw_text <> t1)::INT, (t1 <> t2)::INT, (t2 <> t3)::INT, (t3 <> t4)::INT, {repeats}, (t5 <> t6)::INT, {_hits("t6", leet)}, {_hits("t7", f"{vowel} IN {listed(C.VOWEL_DELETED)}")}, {_hits("t8", f"{trim} IN {listed(C.KEYBOARD_TYPOS)}")}, {_hits("t9", f"{trim} IN {listed(C.ABBREVIATIONS)}")}, (t10 <> norm)::INT]::BIGINT[] AS logged FROM a11),
n AS (SELECT {keys}, norm, logged, list_sum(logged)::BIGINT AS changes,
  regexp_matches(norm, '[ऀ-ॿ]') AS deva, regexp_matches(norm, '[a-zA-Z]') AS latin,
  CASE WHEN regexp_matches(norm, '[ऀ-ॿ]') THEN 'hi' WHEN regexp_matches(norm, '[a-zA-Z]') AND len(list_filter(string_split(lower(norm), ' '), lambda w: w IN {markers})) > 0 THEN 'hinglish' WHEN regexp_matches(norm, '[a-zA-Z]') THEN 'en' ELSE 'unknown' END AS language
  FROM n0)"""


def scored() -> str:
    """CTEs that add s to n: the seven scores, family, risk_score, risk_level."""
    either = lambda p: f"(regexp_matches(lower(norm), {q(p)}) OR regexp_matches(lower(raw_text), {q(p)}))"
    family = " ".join(f"WHEN {either(p)} THEN {q(f)}" for f, p, _ in C.FAMILIES)
    authority = " ".join(f"WHEN fam = {q(f)} THEN {a}" for f, _, a in C.FAMILIES)
    return f"""
s1 AS (SELECT *, CASE WHEN {either(C.FEAR_HIGH)} THEN 0.90 WHEN {either(C.FEAR_LOW)} THEN 0.65 ELSE 0 END::DOUBLE AS fear, CASE WHEN {either(C.URGENCY)} THEN 0.85 ELSE 0 END::DOUBLE AS urgency,
  CASE {family} ELSE 'SAFE' END AS fam, CASE WHEN {either(C.CREDENTIAL)} THEN 0.95 ELSE 0 END::DOUBLE AS credential, CASE WHEN {either(C.FINANCIAL)} THEN 0.80 ELSE 0 END::DOUBLE AS financial,
  CASE WHEN regexp_matches(lower(raw_text), {q(C.LINK)}) THEN 0.90 ELSE 0 END::DOUBLE AS link, CASE WHEN regexp_matches(lower(norm), {q(C.CALL_TO_ACTION)}) THEN 0.85 ELSE 0 END::DOUBLE AS call_to_action FROM n),
s2 AS (SELECT *, CASE {authority} ELSE 0 END::DOUBLE AS authority FROM s1),
s3 AS (SELECT *, fear = 0 AND link = 0 AND credential = 0 AND authority = 0 AS safe, list_filter([fear, urgency, authority, credential * 1.2::DOUBLE, link * 1.1::DOUBLE, call_to_action * 0.8::DOUBLE], lambda x: x > 0) AS active FROM s2),
s4 AS (SELECT *, (list_sum(active) / len(active) * 0.4::DOUBLE + list_max(active) * 0.6::DOUBLE) * 100 AS rawscore FROM s3),
s AS (SELECT *, CASE WHEN safe THEN 5 ELSE least(100, greatest(0, round_even(CASE WHEN changes > 0 THEN least(100, rawscore + least(15, changes * 5)) ELSE rawscore END, 0)))::INT END AS risk_score,
  CASE WHEN safe THEN 'SAFE' ELSE fam END AS scam_family FROM s4),
sl AS (SELECT *, CASE WHEN safe THEN 'SAFE' WHEN risk_score >= 80 THEN 'CRITICAL' WHEN risk_score >= 60 THEN 'HIGH' WHEN risk_score >= 35 THEN 'MEDIUM' ELSE 'LOW' END AS risk_level,
  CASE WHEN safe THEN 'NO_ACTION' WHEN credential > 0.5 THEN 'DO_NOT_SHARE_OTP' WHEN link > 0.5 THEN 'OPEN_OFFICIAL_APP_OR_SITE' ELSE 'VERIFY_WITH_OFFICIAL_SUPPORT' END AS recommended_action FROM s)"""


FACTS = "msg_id, risk_score, risk_level, scam_family, fear, urgency, authority, financial, credential, link, call_to_action"
ANALYSED = f"WITH {MESSAGES}, {normalised()}, {scored()}"


# ---- indicators --------------------------------------------------------------------------------------------------------
def risk(host: str, scheme: str, url: str) -> str:
    octets = f"string_split({host}, '.')"
    number = f"CASE WHEN regexp_full_match({host}, {q(C.IPV4)}) THEN {' + '.join(f'{octets}[{i + 1}]::BIGINT * {256 ** (3 - i)}' for i in range(4))} END"
    nets = [ipaddress.IPv4Network(n) for n in C.PRIVATE_V4]
    private = "(" + " OR ".join(f"({number}) BETWEEN {int(n.network_address)} AND {int(n.broadcast_address)}" for n in nets) + ")"
    return f"""CASE WHEN trim({url}) = '' THEN 'blocked' WHEN {scheme} NOT IN ('http', 'https') THEN 'invalid_scheme' WHEN {host} IN {listed(C.METADATA_HOSTS)} THEN 'metadata_endpoint'
 WHEN {private} AND starts_with({host}, '127.') THEN 'loopback' WHEN {private} AND starts_with({host}, '169.254.') THEN 'metadata_endpoint' WHEN {private} THEN 'private_ip'
 WHEN {host} IN {listed(C.LOCAL_HOSTS)} THEN 'loopback' ELSE 'safe' END"""


PARTS = r"'^([a-zA-Z][a-zA-Z0-9+.\-]*)://(?:([^/?#]*)@)?(\[[^\]/?#]*\]?|[^/?#:]*)(?::([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$'"


def schemed(c: str) -> str:
    return f"CASE WHEN regexp_matches({c}, '^[a-zA-Z][a-zA-Z0-9+\\-.]*://') THEN {c} ELSE 'http://' || {c} END"


def _distinct(kind: str, expr: str) -> str:
    return f"SELECT DISTINCT msg_id, {q(kind)} AS type, unnest({expr}) AS value FROM m"


INDICATORS = f"""
fu AS (SELECT msg_id, regexp_replace(u, '[.,;:!?"'']+$', '') AS value, pos FROM (SELECT msg_id, unnest(regexp_extract_all(raw_text, {q("(?i)" + C.URL.replace("{0,500}", "*"))})) AS u, generate_subscripts(regexp_extract_all(raw_text, {q("(?i)" + C.URL.replace("{0,500}", "*"))}), 1) AS pos FROM m)),
fd AS (SELECT msg_id, value, min(pos) AS pos, {schemed("value")} AS full_url FROM fu GROUP BY ALL),
fh AS (SELECT *, lower(regexp_extract(full_url, {PARTS}, 3)) AS host, lower(regexp_extract(full_url, {PARTS}, 1)) AS scheme FROM fd),
iu AS (SELECT msg_id, 'url' AS type, value, pos, CASE WHEN host IN {listed(C.SHORTENERS)} THEN 0.97 WHEN string_split(host, '.')[-1] IN {listed(C.RISKY_TLDS)} AND contains(host, '.') THEN 0.92 ELSE 0.88 END::DOUBLE AS confidence,
  {risk("host", "scheme", "value")} AS ssrf_risk, contains(host, 'xn--') OR regexp_matches(host, '[^\\x00-\\x7F]') AS is_idn, host FROM fh WHERE host <> '' AND NOT starts_with(host, '[') AND NOT regexp_full_match(host, {q(C.IPV4)})),
idom AS (SELECT msg_id, 'domain' AS type, host AS value, arg_min(confidence, pos) AS confidence, arg_min(ssrf_risk, pos) AS ssrf_risk, arg_min(is_idn, pos) AS is_idn, host FROM iu GROUP BY msg_id, host),
ip AS ({_distinct("ip", f"regexp_extract_all({plain('raw_text')}, {q(word(C.IPV4))})")}),
pt AS (SELECT msg_id, raw_text FROM m WHERE regexp_matches(raw_text, '[6-9][0-9]{{9}}')),
ph AS (SELECT DISTINCT msg_id, 'phone' AS type, '+91' || d AS value FROM (SELECT msg_id, regexp_extract(x, '([6-9][0-9]{{9}})$', 1) AS d FROM (SELECT msg_id, unnest(regexp_extract_all(raw_text, '(?:\\+91[-.\\s]?|0[-.\\s]?)?[0-9]+')) AS x FROM pt) WHERE regexp_full_match(x, '(?:\\+91[-.\\s]?|91|0[-.\\s]?)?[6-9][0-9]{{9}}'))),
em AS ({_distinct("email", f"list_transform(regexp_extract_all({plain('raw_text')}, {q(word(C.EMAIL))}), lambda x: lower(x))")}),
up AS ({_distinct("upi_id", f"list_transform(regexp_extract_all({plain('raw_text')}, {q('(?i)' + word(C.UPI))}), lambda x: lower(x))")}),
se AS ({_distinct("sender_id", f"list_transform(regexp_extract_all({plain('raw_text')}, {q('(?i)' + word(C.SENDER))}), lambda x: upper(x))")}),
i AS (SELECT msg_id, type, value, confidence, ssrf_risk, ssrf_risk <> 'safe' AS is_internal, is_idn, host FROM iu UNION ALL SELECT msg_id, type, value, confidence, ssrf_risk, ssrf_risk <> 'safe', is_idn, host FROM idom
  UNION ALL SELECT msg_id, type, value, 0.90, {risk("value", "'http'", "value")}, {risk("value", "'http'", "value")} <> 'safe', false, value FROM ip
  UNION ALL SELECT msg_id, type, value, CASE type WHEN 'phone' THEN 0.93 WHEN 'email' THEN 0.95 WHEN 'upi_id' THEN 0.97 ELSE 0.89 END, 'safe', false, false, NULL FROM (SELECT * FROM ph UNION ALL SELECT * FROM em UNION ALL SELECT * FROM up UNION ALL SELECT * FROM se))"""
WITH_I = f"WITH {MESSAGES}, {INDICATORS}"
VERDICTS = f"""vl AS (SELECT msg_id, type, value, CASE type WHEN 'url' THEN 'phishing_url' WHEN 'domain' THEN 'phishing_domain' ELSE 'fraudulent_upi' END AS threat_category, CASE type WHEN 'url' THEN 0.02 WHEN 'domain' THEN 0.05 ELSE 0.01 END::DOUBLE AS reputation_score FROM i
  WHERE (type = 'url' AND (host IN {listed(C.BLOCKED_DOMAINS)} OR {" OR ".join(f"starts_with(lower(value), {q(p)})" for p in C.BLOCKED_PREFIXES)})) OR (type = 'domain' AND value IN {listed(C.BLOCKED_DOMAINS)}) OR (type = 'upi_id' AND value IN {listed(C.BLOCKED_UPI)})),
vd AS (SELECT msg_id, type, value, 'local' AS provider, threat_category, reputation_score FROM vl UNION ALL SELECT msg_id, type, value, 'payments', threat_category, 0.03::DOUBLE FROM vl WHERE type = 'upi_id')"""

# ---- URL findings --------------------------------------------------------------------------------------------------------
_F = lambda when, fid, sev, conf, detail="''": f"CASE WHEN {when} THEN {{'finding_id': {q(fid)}, 'severity': {q(sev)}, 'confidence': {conf}::DOUBLE, 'detail': {detail}}} END"
_tok = lambda tokens: f"list_filter({strings(sorted(tokens))}, lambda t: contains(pq, t))"
_lit = f"regexp_matches(u, {q(r'(?i)^https?://[[]?' + C.IPV4)})"
_brand = f"list_filter({strings(C.BRAND_TOKENS)}, lambda b: contains(host || path, b) AND NOT coalesce(len(list_filter(range(1, len(labels) + 1), lambda k: labels[k] = b AND len(labels) - k <= 2)) > 0, false))[1]"
FINDINGS = f"""{URLS},
u1 AS (SELECT url_id, url, {schemed("trim(url)")} AS u FROM pu),
u2 AS (SELECT *, lower(regexp_extract(u, {PARTS}, 1)) AS scheme, regexp_extract(u, {PARTS}, 2) AS userinfo, lower(regexp_extract(u, {PARTS}, 3)) AS host, regexp_extract(u, {PARTS}, 4) AS port, regexp_extract(u, {PARTS}, 5) AS path, regexp_extract(u, {PARTS}, 6) AS query, regexp_extract(u, {PARTS}, 7) AS fragment FROM u1),
u3 AS (SELECT *, {risk("host", "scheme", "url")} AS ssrf_risk, list_filter(string_split(host, '.'), lambda x: x <> '') AS labels, lower(path || ' ' || query) AS pq, string_split(host, '.')[-1] AS tld, host || path || query AS full_text FROM u2),
ec AS (SELECT url_id, ch, count(*) AS n FROM (SELECT url_id, unnest(regexp_extract_all(full_text, '(?s).')) AS ch FROM u3) GROUP BY ALL),
en AS (SELECT url_id, -sum(n / t * log2(n / t)) AS entropy FROM (SELECT *, sum(n) OVER (PARTITION BY url_id) AS t FROM ec) GROUP BY url_id),
u4 AS (SELECT u3.*, coalesce(entropy, 0) AS entropy, {_brand} AS brand FROM u3 LEFT JOIN en USING (url_id)),
uf AS (SELECT *, CASE WHEN ssrf_risk <> 'safe' THEN [{_F("true", "SSRF_BLOCKED", "CRITICAL", 1.0, "ssrf_risk")}]
 WHEN port <> '' AND (NOT regexp_full_match(port, '[0-9]+') OR try_cast(port AS BIGINT) > 65535) THEN [{_F("true", "MALFORMED_URL", "MEDIUM", 0.9)}]
 ELSE list_filter([{_F(f"tld IN {listed(C.SUSPICIOUS_TLDS)}", "SUSPICIOUS_TLD", "MEDIUM", 0.85, "'.' || tld")}, {_F("len(labels) >= 5", "EXCESSIVE_SUBDOMAIN_DEPTH", "MEDIUM", 0.80)}, {_F("entropy > 4.0", "HIGH_URL_ENTROPY", "LOW", 0.75)},
 {_F(f"len({_tok(C.PATH_TOKENS)}) > 0", "SUSPICIOUS_PATH_TOKENS", "MEDIUM", 0.82, f"array_to_string({_tok(C.PATH_TOKENS)}[1:5], ', ')")}, {_F(f"len({_tok(C.CREDENTIAL_TOKENS)}) > 0", "CREDENTIAL_HARVESTING_PATH", "HIGH", 0.88, f"array_to_string({_tok(C.CREDENTIAL_TOKENS)}[1:5], ', ')")},
 {_F("brand IS NOT NULL", "BRAND_IMPERSONATION_IN_DOMAIN", "HIGH", 0.90, "brand")}, {_F("len(list_filter(labels, lambda x: starts_with(x, 'xn--'))) > 0", "PUNYCODE_DOMAIN", "HIGH", 0.92, "list_filter(labels, lambda x: starts_with(x, 'xn--'))[1][1:32]")}, {_F(f"regexp_matches(host, '[{C.LOOKALIKE}]')", "UNICODE_HOMOGLYPH", "HIGH", 0.93)},
 {_F(_lit, "IP_LITERAL_URL", "HIGH", 0.94)}, {_F(f"NOT {_lit} AND regexp_full_match(host, '0x[0-9a-f]+|0[0-7]+|[0-9]+')", "ENCODED_IP_LITERAL", "CRITICAL", 0.97)}, {_F(f"host IN {listed(C.LINK_SHORTENERS)}", "URL_SHORTENER", "MEDIUM", 0.85, "host")},
 {_F("regexp_matches(u, '%25[0-9a-fA-F]{2}')", "DOUBLE_ENCODING", "HIGH", 0.93)}, {_F("NOT regexp_matches(u, '%25[0-9a-fA-F]{2}') AND len(regexp_extract_all(u, '%[0-9a-fA-F]{2}')) > 10", "EXCESSIVE_PERCENT_ENCODING", "MEDIUM", 0.80)}, {_F(r"regexp_matches(u, '(?i)^https?://[^@\s]+:[^@\s]+@')", "EMBEDDED_CREDENTIALS", "HIGH", 0.96)},
 {_F(f"try_cast(port AS BIGINT) IN ({', '.join(map(str, C.SUSPICIOUS_PORTS))})", "SUSPICIOUS_PORT", "MEDIUM", 0.82, "port")}, {_F(r"regexp_matches(u, '(?i)https?://[^\s]*https?://')", "NESTED_URL", "HIGH", 0.92)}, {_F("length(u) > 500", "ABNORMALLY_LONG_URL", "LOW", 0.72)},
 {_F("regexp_matches(fragment, '^https?://')", "REDIRECT_VIA_FRAGMENT", "HIGH", 0.90)}, {_F("split_part(userinfo, ':', 1) <> '' AND split_part(userinfo, ':', 2) = ''", "UNUSUAL_USERINFO", "MEDIUM", 0.78)}, {_F("length(u) - length(replace(u, '@', '')) > 1", "MULTIPLE_AT_SIGNS", "HIGH", 0.95)}], lambda f: f IS NOT NULL) END AS findings FROM u4)"""

# ---- evidence and brands ---------------------------------------------------------------------------------------------------
_any = lambda text, vs: "(" + " OR ".join(f"contains({text}, {q(v)})" for v in vs) + ")"
_latin = lambda vs: [v for v in vs if v.isascii()]
_claim = ", ".join(f"CASE WHEN {_any('raw', [a.lower() for a in o[2]])} OR regexp_matches({plain('clean')}, {q(word('|'.join(_latin(o[2]))))}) OR coalesce({_any('header', o[4])}, false) THEN {i} END" for i, o in enumerate(C.ORGANISATIONS))
_orgs = ", ".join(f"({i}, {q(o[1])}, {strings(a.lower() for a in o[2])}, {strings(o[3])}, {strings(o[4])})" for i, o in enumerate(C.ORGANISATIONS))
_bare = "lower(trim(split_part(split_part(replace(replace(replace(u, 'https://', ''), 'http://', ''), 'www.', ''), '/', 1), '?', 1)))"
_bad = "(" + " OR ".join(f"contains(d, {q(t)})" for t in C.BRAND_BAD_TLDS) + ")"
_legit = "len(list_filter(domains, lambda x: d = x OR ends_with(d, '.' || x))) > 0"
_other = " OR ".join(f"(ord <> {i} AND {_any('header', o[4])})" for i, o in enumerate(C.ORGANISATIONS))
BRANDS = f"""
b1 AS (SELECT *, lower(raw_text) AS raw, lower(norm) AS clean, replace(upper(nullif(sender_id, '')), '-', '') AS header FROM sl),
b2 AS (SELECT *, list_min(list_filter([{_claim}], lambda x: x IS NOT NULL)) AS ord FROM b1),
orgs(oord, oname, aliases, domains, headers) AS (VALUES {_orgs}),
b3 AS (SELECT * FROM b2 LEFT JOIN orgs ON ord = oord),
bd AS (SELECT msg_id, bool_or({_legit}) AS official, bool_or(NOT ({_legit}) AND (len(list_filter(aliases, lambda a: length(a) >= 3 AND contains(d, a))) > 0 OR starts_with(d, 'xn--') OR contains(d, 'ın') OR contains(d, 'gòog') OR {_bad})) AS phishing
  FROM (SELECT msg_id, domains, aliases, unnest(list_transform(regexp_extract_all(raw_text, {q("(?i)" + C.BRAND_URL)}), lambda u: {_bare})) AS d FROM b3 WHERE ord IS NOT NULL) WHERE d <> '' GROUP BY msg_id),
b4 AS (SELECT b3.*, coalesce(official, false) AS has_official_link, coalesce(phishing, false) AS has_phishing_link, coalesce(header IS NOT NULL AND ord IS NOT NULL AND len(list_filter(headers, lambda h: contains(header, h))) = 0 AND ({_other}), false) AS sender_mismatch, regexp_matches({plain("clean")}, {q(word(C.BRAND_THREAT))}) AS threat FROM b3 LEFT JOIN bd USING (msg_id)),
b AS (SELECT *, coalesce(oname, '') AS brand, CASE WHEN ord IS NULL THEN false WHEN has_phishing_link OR (threat AND NOT has_official_link) THEN true WHEN NOT has_phishing_link AND NOT threat THEN false ELSE has_phishing_link OR sender_mismatch END AS impersonation_detected,
  CASE WHEN ord IS NULL THEN 0.95 WHEN NOT has_phishing_link AND NOT threat THEN 0.90 WHEN sender_mismatch THEN 0.98 WHEN has_phishing_link THEN 0.96 ELSE 0.85 END::DOUBLE AS brand_confidence FROM b4)"""


def _span(pattern: str, bounded: bool) -> str:
    p = q("(?i)" + (word(pattern) if bounded else pattern))
    text = (lambda c: plain(c)) if bounded else (lambda c: c)
    return f"coalesce(nullif(regexp_extract({text('norm')}, {p}), ''), nullif(regexp_extract({text('raw_text')}, {p}), ''))"


_items = []
for _c, _p, _s, _k, _case, _bounded in C.EVIDENCE:
    _items.append(f"CASE WHEN {_span(_p, _bounded)} IS NOT NULL THEN {{'category': {q(_c)}, 'severity': {_s}::DOUBLE, 'confidence': {_k}::DOUBLE, 'value': {_case}({_span(_p, _bounded)})}} END")
_items.insert(2, "CASE WHEN brand <> '' THEN {'category': 'BANK_IMPERSONATION', 'severity': CASE WHEN impersonation_detected THEN 40.0 ELSE 18.0 END::DOUBLE, 'confidence': CASE WHEN impersonation_detected THEN brand_confidence ELSE 0.70::DOUBLE END, 'value': upper(brand)} END")
_items.append("CASE WHEN changes > 0 THEN {'category': 'OBFUSCATION_DETECTED', 'severity': 20.0::DOUBLE, 'confidence': 0.89::DOUBLE, 'value': 'count=' || changes} END")
_items.append("CASE WHEN scam_family <> 'SAFE' THEN {'category': CASE WHEN contains(scam_family, 'KYC') THEN 'BANK_IMPERSONATION' ELSE 'URGENCY_LANGUAGE' END, 'severity': 30.0::DOUBLE, 'confidence': 0.85::DOUBLE, 'value': scam_family} END")
EVIDENCE = f"""
e1 AS (SELECT *, list_filter([{', '.join(_items)}], lambda x: x IS NOT NULL) AS evidence FROM b),
e2 AS (SELECT *, least(100, floor(coalesce(list_sum(list_transform(evidence, lambda x: x.severity)), 0)))::INT AS evidence_risk, list_transform(evidence, lambda x: x.category) AS cats FROM e1),
e AS (SELECT *, CASE WHEN evidence_risk >= 80 THEN 'CRITICAL' WHEN evidence_risk >= 70 THEN 'HIGH' WHEN evidence_risk >= 50 THEN 'MEDIUM' WHEN evidence_risk >= 20 THEN 'LOW' ELSE 'SAFE' END AS evidence_tier,
  CASE WHEN scam_family <> 'SAFE' THEN scam_family WHEN evidence_risk < 20 OR len(evidence) = 0 THEN 'SAFE' WHEN list_has_any(cats, ['BANK_IMPERSONATION', 'HOMOGLYPH_DOMAIN']) THEN 'BANK_KYC' WHEN list_contains(cats, 'UPI_REQUEST') THEN 'UPI_PAYMENT'
   WHEN list_contains(cats, 'REMOTE_ACCESS') THEN 'REMOTE_ACCESS' WHEN list_has_any(cats, ['OTP_REQUEST', 'CREDENTIAL_REQUEST']) THEN 'BANK_KYC' ELSE 'OTHER_SCAM' END AS evidence_category,
  CASE WHEN len(evidence) > 0 THEN round_even(round(list_sum(list_transform(evidence, lambda x: x.confidence)) / len(evidence), 9), 2) ELSE 0.95 END AS evidence_confidence FROM e2)"""
FULL = f"{ANALYSED}, {BRANDS}, {EVIDENCE}"

# ---- conversations ---------------------------------------------------------------------------------------------------------
_esc = lambda c: f"replace(replace(replace(replace(replace(trim({c}), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
_n = lambda latin, deva="": f"(len(regexp_extract_all({plain('lower(text)')}, {q(word(latin))}))" + (f" + len(regexp_extract_all(lower(text), {q(deva)}))" if deva else "") + ")"
_sc = ", ".join(f"least(1.0, 0.35 * {_n(a, b)})::DOUBLE AS s_{n}" for n, a, b in C.STAGES)
_state = "CASE " + " ".join(f"WHEN s_{n} = top THEN {q(n)}" for n, _, _ in C.STAGES) + " END"
_sig = ", ".join(f"CASE WHEN s_{n} > 0.10 THEN {q('signal_' + n.lower())} END" for n, _, _ in C.STAGES)
_STAGES = f"""c1 AS (SELECT conv_id, turn, {_esc("text")} AS text FROM cm),
c2 AS (SELECT *, row_number() OVER (PARTITION BY conv_id, text ORDER BY turn) AS rep FROM c1),
c3 AS (SELECT *, count(*) FILTER (rep > 1) OVER (PARTITION BY conv_id) AS n_repeats FROM c2),
c4 AS (SELECT *, {_sc}, least(1.0, 0.35 * {_n(C.BENIGN)})::DOUBLE AS benign FROM c3 WHERE rep = 1),
c5 AS (SELECT *, greatest({", ".join(f"s_{n}" for n, _, _ in C.STAGES)}) AS top FROM c4),
st AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS idx, CASE WHEN top > 0.15 THEN {_state} ELSE 'UNKNOWN' END AS state,
  round_even(round(least(1, greatest(0, CASE WHEN top > 0.15 THEN top ELSE 0.15::DOUBLE END * (1 - 0.35::DOUBLE * benign))), 9), 3) AS state_confidence,
  array_to_string(list_filter([{_sig}, CASE WHEN benign > 0.2 THEN 'signal_benign_context' END], lambda x: x IS NOT NULL), ',') AS signals FROM c5)"""
STAGED = f"{CONVERSATIONS}, {_STAGES}"
_graph = ", ".join(f"({q(a)}, {q(b)})" for a, b in C.STAGE_GRAPH)
MOVES = f"""g(from_state, to_state) AS (VALUES {_graph}),
mv AS (SELECT conv_id, idx, lag(state) OVER w AS from_state, state AS to_state, (lag(state_confidence) OVER w + state_confidence) / 2 AS c, coalesce(nullif(split_part(signals, ',', 1), ''), 'unknown_signal') AS trigger FROM st WINDOW w AS (PARTITION BY conv_id ORDER BY idx)),
tr AS (SELECT conv_id, idx, mv.from_state, mv.to_state, round_even(round(CASE WHEN g.to_state IS NOT NULL THEN least(1, c + 0.10) ELSE c END, 9), 3) AS confidence, g.to_state IS NOT NULL AS valid, trigger FROM mv LEFT JOIN g USING (from_state, to_state) WHERE mv.from_state <> mv.to_state AND mv.from_state <> 'UNKNOWN' AND mv.to_state <> 'UNKNOWN')"""
_names = [n for n, _, _ in C.STAGES]
_ord = "CASE state " + " ".join(f"WHEN {q(n)} THEN {i}" for i, n in enumerate(_names[:-1])) + " END"
_next = "CASE current_state " + " ".join(f"WHEN {q(a)} THEN {q(b)}" for a, b in zip(_names, _names[1:], strict=False)) + " END"
RESULTS = f"""r1 AS (SELECT conv_id, count(*) AS message_count, arg_max(state, idx) AS current_state, list(state ORDER BY idx) AS states, avg(state_confidence) AS conf, coalesce(max({_ord}), 0) AS far,
  count(DISTINCT CASE WHEN state <> 'UNKNOWN' AND state_confidence >= 0.30 THEN state END) AS kinds, max(n_repeats) AS n_repeats, arg_max(s_CREDENTIAL_REQUEST, idx) AS lc, arg_max(s_PAYMENT_REQUEST, idx) AS lp, arg_max(s_REMOTE_ACCESS, idx) AS lr FROM st GROUP BY conv_id),
cr AS (SELECT *, array_to_string(states[1:message_count - 1], ',') AS previous_states, round_even(round(conf, 9), 3) AS overall_confidence, round_even(round(far / 8, 9), 3) AS advancement, kinds >= 2 AS is_progression, CASE WHEN conf >= 0.30 AND current_state <> 'UNKNOWN' THEN coalesce({_next}, '') ELSE '' END AS likely_next_state, CASE WHEN n_repeats > 0 THEN 'REPEATED_MESSAGES' ELSE '' END AS warnings FROM r1)"""
_acts = ", ".join(f"({q(a)}, {q(b)}, {p}::DOUBLE, {i})" for i, (a, b, p) in enumerate(C.STAGE_ACTIONS))

NEXT = f"""a(current_state, action, base, ord) AS (VALUES {_acts}), k AS (SELECT conv_id, count(*) AS n_moves, arg_max(from_state || '>' || to_state, idx) AS last_move FROM tr GROUP BY conv_id),
p AS (SELECT cr.*, a.action, a.ord, coalesce(last_move, '') AS last_move, CASE a.action WHEN 'REQUEST_OTP' THEN lc WHEN 'REQUEST_UPI_PAYMENT' THEN lp WHEN 'REQUEST_REMOTE_ACCESS' THEN lr ELSE 0 END AS sig, base + 0.05::DOUBLE * least(coalesce(n_moves, 0), 3) + CASE WHEN is_progression THEN 0.08 ELSE 0 END::DOUBLE AS b FROM cr JOIN a USING (current_state) LEFT JOIN k USING (conv_id)),
p2 AS (SELECT *, least(1, b + CASE WHEN sig > 0.2 THEN sig * 0.25::DOUBLE ELSE 0 END) AS pr FROM p), p3 AS (SELECT *, overall_confidence < 0.28 OR current_state = 'UNKNOWN' AS abstained FROM p2 QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY pr DESC, ord) = 1),
p4 AS (SELECT *, round_even(round(CASE WHEN abstained THEN overall_confidence ELSE least(1, pr * (0.8::DOUBLE + 0.2::DOUBLE * advancement) * overall_confidence) END, 9), 3) AS probability FROM p3)"""

# ---- fingerprints ------------------------------------------------------------------------------------------------------------
DNA = f"""
d1 AS (SELECT *, lower(raw_text) AS lraw, lower(norm) AS lclean FROM sl),
d2 AS (SELECT *, len(list_filter(string_split_regex(lclean, '\\s+'), lambda x: x <> ''))::BIGINT AS word_count, len(string_split_regex(raw_text, '[.!?]+'))::BIGINT AS sentence_count, regexp_matches({plain("lclean")}, {q(word(C.IMPERATIVE))}) AS has_imperatives,
  coalesce(nullif(upper(regexp_extract({plain("lclean")}, {q(word(C.FINGERPRINT_ORG))})), ''), 'NONE') AS org, regexp_extract_all(lraw, {q(C.FINGERPRINT_URL)}) AS us, regexp_extract_all(lraw, {q(C.FINGERPRINT_UPI)}, 1) AS psps,
  len(regexp_extract_all({plain("raw_text")}, {q(word(r"(?:\+91|0)?[6-9][0-9]{9}"))}))::BIGINT AS phone_count FROM d1),
d3 AS (SELECT *, len(us)::BIGINT AS url_count, array_to_string(list_sort(list_distinct(list_transform(list_filter(us, lambda u: contains(u, '.')), lambda u: split_part(string_split(u, '.')[-1], '/', 1)))), ',') AS tlds,
  {_any("lraw", C.FINGERPRINT_SHORTENERS)} AS is_shortener, len(list_filter(us, lambda u: contains(u, '-') OR contains(u, 'kyc') OR contains(u, 'verify'))) > 0 AS has_homoglyph, array_to_string(list_sort(list_distinct(psps)), ',') AS psp,
  array_to_string(list_filter([CASE WHEN contains(raw_text, '₹') OR contains(lclean, 'rs') THEN 'INR' END, CASE WHEN contains(raw_text, '$') THEN 'USD' END], lambda x: x IS NOT NULL), ',') AS currencies,
  CASE WHEN contains(lraw, 'hindi') OR regexp_matches(raw_text, '[ऀ-ॿ]') THEN 'hi' ELSE 'en' END AS dna_language, epoch // 3600 AS hour_bucket,
  coalesce(nullif(array_to_string(list_filter([CASE WHEN sender_id <> '' THEN 'HEADER' END, CASE WHEN org <> 'NONE' THEN 'ORG_' || org END, CASE WHEN fear > 0.5 THEN 'FEAR' END, CASE WHEN urgency > 0.5 THEN 'URGENCY' END, CASE WHEN len(us) > 0 THEN 'LINK' END, CASE WHEN has_imperatives THEN 'CTA' END], lambda x: x IS NOT NULL), '+'), ''), 'GENERIC_MESSAGE') AS message_structure FROM d2)"""

_sorted_types = ", ".join(f"CASE WHEN logged[{LOG_TYPES.index(t) + 1}] > 0 THEN {q(t)} END" for t in sorted(LOG_TYPES))
_flag = lambda c: f"CASE WHEN {c} THEN 'True' ELSE 'False' END"
DNA_HASH = f"""dh AS (SELECT *, 'dna_' || substr(sha256('archetype=' || scam_family || '|org=' || org || '|obf=' || array_to_string(list_filter([{_sorted_types}], lambda x: x IS NOT NULL), ',') || '|ent=|struct=' || message_structure || '|has_url=' || {_flag("len(us) > 0")} || '|has_vpa=' || {_flag("len(psps) > 0")}), 1, 16) AS dna_hash FROM d3)"""

#: Word vectors of the messages.
VECTORS = """wc AS (SELECT msg_id, ('0x' || substr(md5(w), 1, 2))::INT AS k, count(*) AS c FROM (SELECT msg_id, unnest(list_filter(string_split(lower(norm), ' '), lambda w: w <> '')) AS w FROM n) GROUP BY ALL),
vec AS (SELECT msg_id, list_transform(range(256), lambda k: coalesce(mp[k], 0)::DOUBLE) AS v FROM (SELECT msg_id, map_from_entries(list({'k': k, 'v': c})) AS mp FROM wc GROUP BY msg_id))"""
_jaccard = lambda x, y, empty: f"(CASE WHEN len({x}) + len({y}) = 0 THEN {empty} ELSE len(list_intersect({x}, {y})) / (len({x}) + len({y}) - len(list_intersect({x}, {y}))) END)::DOUBLE"
_off = " + ".join(f"abs(a.{c} - b.{c})" for c in ("fear", "urgency", "authority", "financial", "credential", "link", "call_to_action"))
#: All pairs of messages of one family that share an entity or all traits, with their composite; then the best three of each.
DNA_PAIRS = f"""ent AS (SELECT msg_id, list_sort(list_distinct(list(trim(lower(value))))) AS ents FROM i GROUP BY msg_id),
fp AS (SELECT d3.*, list_filter([{_sorted_types}], lambda x: x IS NOT NULL) AS obf, coalesce(ents, []) AS ents, len(us) > 0 AS has_url, len(psps) > 0 AS has_vpa, v FROM d3 JOIN vec USING (msg_id) LEFT JOIN ent USING (msg_id)),
bl AS (SELECT msg_id, unnest(list_append(list_transform(ents, lambda x: 'e' || x), 'h' || concat_ws('|', scam_family, org, array_to_string(obf, ','), array_to_string(ents, ','), message_structure, has_url, has_vpa))) AS block FROM fp),
pr AS (SELECT DISTINCT x.msg_id AS ia, y.msg_id AS ib FROM bl x JOIN bl y ON x.block = y.block AND x.msg_id <> y.msg_id),
ps AS (SELECT ia, ib, CASE WHEN len(a.ents) = 0 OR len(b.ents) = 0 THEN 0 ELSE {_jaccard("a.ents", "b.ents", 0)} END::DOUBLE AS overlap, greatest(0, 1 - ({_off}) / 7)::DOUBLE AS pressure,
  (0.35 * CASE WHEN a.org <> b.org THEN 0 WHEN a.org = 'NONE' THEN 0.5 ELSE 1 END + 0.20 * (a.has_url = b.has_url)::INT + 0.20 * (a.has_vpa = b.has_vpa)::INT)::DOUBLE + 0.25::DOUBLE * {_jaccard("a.obf", "b.obf", 1)} AS structural, round(greatest(0, least(1, list_cosine_similarity(a.v, b.v))), 12) AS semantic
  FROM pr JOIN fp a ON a.msg_id = ia JOIN fp b ON b.msg_id = ib WHERE a.scam_family = b.scam_family),
pc AS (SELECT ia AS id_a, ib AS id_b, overlap, round_even(round(0.35::DOUBLE * semantic + 0.25::DOUBLE * CASE WHEN pressure < 0.30 THEN structural * 0.5::DOUBLE ELSE structural END + 0.20::DOUBLE * overlap + 0.10::DOUBLE * pressure + 0.10::DOUBLE, 12), 4) AS composite FROM ps)"""

# ---- campaigns ---------------------------------------------------------------------------------------------------------------
# word vectors, and the assignment message by message in the order of time
CAMPAIGNS = f"""RECURSIVE {MESSAGES}, {normalised()}, {scored()}, {VECTORS},
dup AS (SELECT msg_id, min(msg_id) OVER (PARTITION BY raw_text) AS first_id FROM m),
ord AS (SELECT scam_family, msg_id, list_transform(v, lambda x: x / sqrt(l)) AS u, row_number() OVER (PARTITION BY scam_family ORDER BY epoch, msg_id) AS k
  FROM (SELECT *, list_dot_product(v, v) AS l FROM sl JOIN vec USING (msg_id) JOIN dup USING (msg_id) WHERE msg_id = first_id)),
gr AS (SELECT scam_family, k, msg_id AS who, 1.0::DOUBLE AS c, [{{'id': msg_id, 'n': 1, 'v': u}}] AS heads FROM ord WHERE k = 1
  UNION ALL SELECT scam_family, k, CASE WHEN hit THEN heads[p].id ELSE msg_id END, CASE WHEN hit THEN s[p] ELSE 1.0 END,
    CASE WHEN hit THEN list_transform(heads, lambda h, i: CASE WHEN i = p THEN {{'id': h.id, 'n': h.n + 1, 'v': moved}} ELSE h END) ELSE list_append(heads, {{'id': msg_id, 'n': 1, 'v': u}}) END
  FROM (SELECT *, list_transform(mean, lambda x: x / l) AS moved FROM (SELECT *, sqrt(list_dot_product(mean, mean)) AS l
    FROM (SELECT *, list_transform(list_zip(heads[p].v, u), lambda z: (z[1] * (heads[p].n + 1) + z[2]) / (heads[p].n + 2)) AS mean
      FROM (SELECT *, list_position(s, list_max(s)) AS p, list_max(s) >= 0.82 AS hit
        FROM (SELECT o.scam_family, o.k, o.msg_id, o.u, gr.heads, list_transform(gr.heads, lambda h: round(list_dot_product(h.v, o.u), 12)) AS s FROM gr JOIN ord o ON o.scam_family = gr.scam_family AND o.k = gr.k + 1)))))),
bst AS (SELECT msg_id, who AS head, c FROM gr JOIN ord USING (scam_family, k)),
mid AS (SELECT campaign_id, round(list_max(v), 6) AS largest FROM (SELECT scam_family || '-' || h.id AS campaign_id, h.v AS v FROM (SELECT scam_family, unnest(heads) AS h FROM gr QUALIFY k = max(k) OVER (PARTITION BY scam_family)))),
asg AS (SELECT m.msg_id, sl.scam_family, sl.scam_family || '-' || head AS campaign_id, CASE WHEN m.msg_id <> first_id OR head = first_id THEN 1.0 ELSE round(c, 4) END::DOUBLE AS similarity, CASE WHEN m.msg_id <> first_id OR head = first_id THEN 1.0 ELSE round_even(round(c * 0.95::DOUBLE, 9), 2) END::DOUBLE AS confidence,
  m.msg_id = first_id AND head = first_id AS is_new, m.msg_id <> first_id AS is_duplicate, own.language, own.risk_score, m.epoch, nullif(m.sender_id, '') AS sender_id
  FROM m JOIN dup USING (msg_id) JOIN bst ON bst.msg_id = first_id JOIN sl ON sl.msg_id = first_id JOIN sl own ON own.msg_id = m.msg_id),
mem AS (SELECT * FROM asg WHERE NOT is_duplicate),
fs AS (SELECT campaign_id, string_agg(sender_id, ',' ORDER BY seen, sender_id) AS senders FROM (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY seen, sender_id) AS r FROM (SELECT campaign_id, sender_id, min({{'a': epoch, 'i': msg_id}}) AS seen FROM mem WHERE sender_id IS NOT NULL GROUP BY ALL)) WHERE r <= 10 GROUP BY campaign_id),
lg AS (SELECT campaign_id, language, count(*) AS n, min({{'a': epoch, 'i': msg_id}}) AS seen FROM mem GROUP BY ALL),
lh AS (SELECT campaign_id, arg_min(language, {{'n': -n, 's': seen, 'l': language}}) AS dominant_language, string_agg(language || '=' || n, ',' ORDER BY language) AS languages FROM lg GROUP BY campaign_id),
cs AS (SELECT campaign_id, count(*) AS member_count, min(scam_family) AS scam_family, min(epoch) AS first_seen, max(epoch) AS last_seen, round_even(round(avg(similarity), 9), 4)::DOUBLE AS confidence, round_even(avg(risk_score), 1)::DOUBLE AS avg_risk FROM mem GROUP BY campaign_id)"""

# ---- augmentation --------------------------------------------------------------------------------------------------------------
_key = r"regexp_replace(lower(w), '[^\p{L}\p{M}\p{N}_\s]', '', 'g')"
_tail = f"CASE WHEN length(w) > length({_key}) THEN substr(w, length({_key}) + 1) ELSE '' END"
_split = r"list_filter(string_split_regex(raw_text, '[\s\v\p{Z}\x{85}]+'), lambda w: w <> '')"
_each = lambda change: f"array_to_string(list_transform({_split}, lambda w: {change}), ' ')"
_mapw = lambda m, tail: f"CASE WHEN {_key} IN {listed(m)} THEN {mapping(m)}[{_key}]{f' || ({_tail})' if tail else ''} ELSE w END"
_VARIANTS = {
    "whitespace_manipulation": f"array_to_string(list_transform({_split}, lambda w, k: CASE WHEN k % 2 = 1 THEN w || ' ' ELSE w END), '')",
    "phonetic_transliteration": _each(_mapw(C.TO_HINGLISH, True)),
    "hinglish_synthesis": "CASE " + " ".join(f"WHEN regexp_matches(lower(raw_text), {q(w)}) THEN {q(t)}" for w, t in C.HINGLISH_TEMPLATES[:-1]) + f" ELSE {q(C.HINGLISH_TEMPLATES[-1][1])} END",
    "mixed_scripts": _each(_mapw(C.TO_DEVANAGARI, False)),
    "punctuation_insertion": _each("CASE WHEN length(w) >= 3 AND NOT contains(w, 'http') THEN array_to_string(regexp_extract_all(w, '(?s).'), '_') ELSE w END"),
    "informal_abbreviations": _each(_mapw(C.TO_ABBREVIATION, True)),
    "multilingual_switching": q(C.SWITCHED),
    "ocr_corruption": "replace(replace(replace(replace(replace(raw_text, 'rn', 'm'), 'cl', 'd'), 'vv', 'w'), 'l', '1'), 'O', '0')",
    "domain_obfuscation": "replace(replace(replace(raw_text, 'sbi.co.in', 'sbi[.]co[.]in'), '.com', '[.]com'), 'http://', 'h**p://')",
    "sender_id_mutation": f"{q(C.SENDER_MUTATION)} || raw_text",
}
assert tuple(_VARIANTS) == FIXED
_union = lambda: " UNION ALL ".join(f"SELECT msg_id, sender_id, {q(k)} AS perturbation, {v} AS raw_text FROM m" for k, v in _VARIANTS.items())


def _drawn(name: str, *at: str) -> str:
    """The draw of a perturbation; at are positions from 0."""
    h = f"(kk * 48271 + {code_of(name)}" + "".join(f" + ({i}) * {step}" for step, i in zip(STEPS, at, strict=False)) + f") % {PRIME}"
    return f"(list_transform([{h}], lambda h: ((h * h % {PRIME}) * 16807 + h) % {PRIME})[1] / {PRIME}::DOUBLE)"


def _in_words(text: str, change: str) -> str:
    return f"array_to_string(list_transform({_split.replace('raw_text', text)}, lambda w, i: {change}), ' ')"


def _in_chars(text: str, change: str) -> str:
    return f"array_to_string(list_transform(regexp_extract_all({text}, '(?s).'), lambda c, j: {change}), '')"


def _at(place: str, change: str) -> str:
    return f"list_transform([{place}], lambda z: {change})[1]"


_link = "(contains(w, 'http') OR contains(w, 'bit.ly'))"
_vowel = "lower(c) IN ('a', 'e', 'i', 'o', 'u')"
_pick = lambda name, n: f"floor({_drawn(name, 'i - 1')} * ({n}))::INT"
_nfd = "raw_text"
for _c in map(chr, range(0xC0, 0x250)):
    if unicodedata.normalize("NFD", _c) != _c:
        _nfd = f"replace({_nfd}, {q(_c)}, {q(unicodedata.normalize('NFD', _c))})"
_digits = lambda text, p: _in_chars(text, f"CASE WHEN {_drawn('number_substitution', 'j - 1')} < {p}::DOUBLE THEN translate(c, {q(C.ADD_LEET_FROM)}, {q(C.ADD_LEET_TO)}) ELSE c END")
_alike = lambda text: _in_chars(text, f"CASE WHEN {_drawn('unicode_confusables', 'j - 1')} < 0.7::DOUBLE THEN translate(c, {q(C.ADD_LOOKALIKE_FROM)}, {q(C.ADD_LOOKALIKE_TO)}) ELSE c END")
_marked = lambda text: _in_words(text, f"CASE WHEN length(w) >= 3 THEN {_at('1 + ' + _pick('zw_at', 'length(w) - 1'), 'substr(w, 1, z)')} || {strings(chr(x) for x in (0x200B, 0x200C, 0x200D, 0xFEFF))}[{_pick('zw_mark', '4')} + 1] || {_at('1 + ' + _pick('zw_at', 'length(w) - 1'), 'substr(w, z + 1)')} ELSE w END")
_keys = f"{mapping(C.KEY_NEIGHBOURS)}[lower(substr(w, z + 1, 1))]"
_DRAWN = {
    "vowel_deletion": _in_words("raw_text", f"CASE WHEN length(w) <= 3 OR {_link} THEN w ELSE substr(w, 1, 1) || {_in_chars('substr(w, 2)', f'''CASE WHEN {_vowel} AND {_drawn('vowel_deletion', 'i - 1', 'j - 1')} <= 0.7::DOUBLE THEN '' ELSE c END''')} END"),
    "adjacent_swap": _in_words("raw_text", f"CASE WHEN length(w) <= 3 OR {_link} OR {_drawn('adjacent_swap', 'i - 1')} > 0.5 THEN w ELSE {_at('1 + ' + _pick('swap_at', 'length(w) - 2'), 'substr(w, 1, z) || substr(w, z + 2, 1) || substr(w, z + 1, 1) || substr(w, z + 3)')} END"),
    "number_substitution": _digits("raw_text", 0.7),
    "repeated_chars": _in_words("raw_text", f"CASE WHEN length(w) <= 3 OR contains(w, 'http') THEN w ELSE {_at(_pick('repeated_chars', 'length(w)'), 'substr(w, 1, z) || repeat(substr(w, z + 1, 1), 4) || substr(w, z + 2)')} END"),
    "unicode_confusables": _alike("raw_text"),
    "zero_width_chars": _marked("raw_text"),
    "unicode_normalization": _in_chars(_nfd, f"CASE WHEN {_vowel} AND {_drawn('unicode_normalization', 'j - 1')} < 0.5 THEN c || {q(chr(0x301))} ELSE c END"),
    "nested_obfuscation": None,
    "realistic_typos": _in_words("raw_text", f"CASE WHEN length(w) > 3 AND NOT contains(w, 'http') AND {_drawn('realistic_typos', 'i - 1')} < 0.6::DOUBLE THEN {_at(_pick('typo_at', 'length(w)'), f'''CASE WHEN {_keys} IS NOT NULL THEN substr(w, 1, z) || substr({_keys}, {_pick('typo_key', f'length({_keys})')} + 1, 1) || substr(w, z + 2) ELSE w END''')} ELSE w END"),
}
assert tuple(_DRAWN) == RANDOM
_drawn_union = " UNION ALL ".join(f"SELECT msg_id, {q(k)} AS perturbation, {v} AS raw_text FROM mk" for k, v in _DRAWN.items() if v)
RANDOM_VARIANTS = f"WITH {MESSAGES}, mk AS (SELECT *, ((msg_id % {PRIME}) * 7919) % {PRIME} AS kk FROM m), nest1 AS (SELECT msg_id, kk, {_digits('raw_text', 0.9)} AS t1 FROM mk), nest2 AS (SELECT msg_id, kk, {_alike('t1')} AS t2 FROM nest1), rv AS ({_drawn_union} UNION ALL SELECT msg_id, 'nested_obfuscation', {_marked('t2')} FROM nest2)"
VARIANTS = f"WITH {MESSAGES}, v AS ({_union()}), {normalised('v', 'msg_id, perturbation, raw_text')}, {scored()}"
_once = lambda cte, name: cte.replace(f"\n{name} AS (", f"\n{name} AS MATERIALIZED (")  # noqa: E731  else worked out again for each use
ALL_VARIANTS = f"{RANDOM_VARIANTS}, v AS MATERIALIZED (SELECT msg_id, perturbation, raw_text FROM ({_union()}) UNION ALL SELECT msg_id, perturbation, raw_text FROM rv), {_once(normalised('v', 'msg_id, perturbation, raw_text', 'nfc_normalize(t1)'), 'n')}, {scored()}"
_template = r"sha256(lower(regexp_replace(coalesce(text, ''), '[\s\v\p{Z}\x{85}]+', '', 'g')))"
_place = f"(('0x' || substr(sha256('42:' || {_template}), 1, 8))::UBIGINT % 1000000) / 1000000"
SPLIT = f"SELECT doc_id, {_template} AS template, CASE WHEN {_place} < 0.7 THEN 'train' WHEN {_place} < 0.7 + 0.1 THEN 'val' ELSE 'test' END AS split FROM documents"
JUDGED = f"{MESSAGES}, {normalised()}, j AS (SELECT coalesce(lang, 'none') AS label, language AS predicted FROM documents JOIN n ON msg_id = doc_id)"
#: Category, support page and domains of the organisations, in their order.
REFERENCE = {"category": strings(o[5] for o in C.ORGANISATIONS), "support_url": strings(o[6] for o in C.ORGANISATIONS), "domains": strings(",".join(o[3]) for o in C.ORGANISATIONS)}
#: Hosts in another script, and what those of the made URLs say.
IDN = r"(contains(host, 'xn--') OR regexp_matches(host, '[^\x00-\x7F]'))"
IDN_HOSTS = {h: h.encode().decode("idna") for h in (u.split("/")[2] for u in R.URLS if "//xn--" in u)}


def _marked(c: str) -> str:
    """Markup characters as references, without a trim."""
    for raw, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = f"replace({c}, {q(raw)}, {q(ref)})"
    return c


def _log_entries() -> str:
    """le: type, original and transformed of every log entry of a11."""
    whole = (("ZERO_WIDTH", "raw_text", "t1"), ("CONFUSABLE", "t1", "t2"), ("PUNCTUATION", "t2", "t3"), ("DOMAIN_BRACKETS", "t3", "t4"), ("OCR_DIGIT", "t5", "t6"), ("WHITE_SPACE", "t10", "norm"))
    parts = [f"SELECT {q(kind)} AS type, substr({a}, 1, 80) AS original, substr({b}, 1, 80) AS transformed FROM a11 WHERE {a} <> {b}" for kind, a, b in whole]
    parts += [f"SELECT 'REPEATED', r, r[1] FROM (SELECT unnest(regexp_extract_all(t4, '(?i){c}{{3,}}')) AS r FROM a11)" for c in "abcdefghijklmnopqrstuvwxyz"]
    vowel, trim = "regexp_replace(lower(w), '[^a-z0-9]', '', 'g')", "trim(lower(w), '.,!?;:')"
    tests = {"LEET": r"regexp_matches(w, '\p{L}') AND regexp_matches(w, '[0-9@$!|+€£]')", "VOWELS_DROPPED": f"{vowel} IN {listed(C.VOWEL_DELETED)}", "KEYBOARD_TYPO": f"{trim} IN {listed(C.KEYBOARD_TYPOS)}", "ABBREVIATION": f"{trim} IN {listed(C.ABBREVIATIONS)}"}
    for i, (kind, test) in enumerate(tests.items()):
        parts.append(f"SELECT {q(kind)}, w, x FROM (SELECT unnest(string_split(t{6 + i}, ' ')) AS w, unnest(string_split(t{7 + i}, ' ')) AS x FROM a11) WHERE {test}")
    return "le AS (" + " UNION ALL ".join(parts) + ")"


LOG_ENTRIES = _log_entries()

#: First distinct domains of each campaign; the message that opens it brings ten at most.
DOMAIN_LISTS = """cd AS (SELECT campaign_id, list(value ORDER BY seen, value) AS domains FROM (SELECT *, row_number() OVER (PARTITION BY campaign_id ORDER BY seen, value) AS r
  FROM (SELECT campaign_id, value, min({'a': epoch, 'i': msg_id}) AS seen FROM (SELECT mem.*, value FROM mem JOIN idom USING (msg_id) QUALIFY NOT is_new OR row_number() OVER (PARTITION BY msg_id ORDER BY value) <= 10) GROUP BY ALL)) WHERE r <= 20 GROUP BY campaign_id)"""

ORACLES: dict[str, str] = {
    "intake_rejects": f"WITH {MESSAGES} SELECT CASE WHEN length(trim(raw_text)) = 0 THEN 'empty' WHEN length(raw_text) > 5000 THEN 'too_long' ELSE 'accepted' END AS reason, count(*) AS n, max(length(raw_text))::BIGINT AS longest FROM m GROUP BY 1",
    "intake_conversations": f"SELECT conv_id, turn, sha256({_esc('text')}) AS escaped_sha256 FROM conversations",
    "analysis_lookup": f"{ANALYSED} SELECT {FACTS} FROM sl WHERE msg_id IN (SELECT doc_id FROM labels)",
    "feedback_summary": f"WITH {MESSAGES}, f AS (SELECT event_id::VARCHAR AS feedback_id, (event_id % 997)::VARCHAR AS analysis_id, user_id AS analyst_id, value > 50 AS is_correct, ts FROM events), l AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY analysis_id, analyst_id ORDER BY ts DESC, feedback_id DESC) = 1), g AS (SELECT analysis_id, count(*) AS n, count(*) FILTER (is_correct) AS c FROM l GROUP BY 1) SELECT msg_id::VARCHAR AS analysis_id, coalesce(n, 0)::BIGINT AS n_feedback, coalesce(c, 0)::BIGINT AS n_correct FROM m LEFT JOIN g ON analysis_id = msg_id::VARCHAR",
    "feedback_upserts": "SELECT event_id::VARCHAR AS feedback_id, (value > 50) <> (event_id % 10 = 0) AS is_correct, (event_id % 10 = 0)::INT AS revision FROM events",
    "messages_seek": "SELECT doc_id AS msg_id, source FROM documents ORDER BY doc_id DESC LIMIT 20 OFFSET 40",
    "key_violations": f"WITH {MESSAGES}, fb AS (SELECT (event_id % 997)::VARCHAR AS a, user_id::VARCHAR AS u FROM events), kv(name, n) AS (SELECT 'messages.text', count(*) FROM (SELECT raw_text FROM m GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'messages.msg_id', count(*) FROM (SELECT msg_id FROM m GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'analyses.msg_id', count(*) FROM (SELECT doc_id FROM labels GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'analyses.msg_id->messages', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'conversation_messages.conv_id,turn', count(*) FROM (SELECT conv_id, turn FROM conversations GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'feedback.analysis_id,analyst_id', count(*) FROM (SELECT a, u FROM fb GROUP BY ALL HAVING count(*) > 1) UNION ALL SELECT 'feedback.analysis_id->analyses', count(*) FROM fb WHERE a NOT IN (SELECT doc_id::VARCHAR FROM labels) UNION ALL SELECT 'feedback.analyst_id->users', count(*) FROM fb WHERE u NOT IN (SELECT c_custkey::VARCHAR FROM customer) UNION ALL SELECT 'users.user_id', count(*) FROM (SELECT c_custkey FROM customer GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'audit.event_id', count(*) FROM (SELECT event_id FROM events GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'audit.user_id->users', count(*) FROM fb WHERE u NOT IN (SELECT c_custkey::VARCHAR FROM customer)) SELECT name, n FROM kv",
    "text_normalised": f"WITH {MESSAGES}, {normalised()} SELECT msg_id, sha256(norm) AS normalized_sha256, length(norm)::BIGINT AS n_chars, changes AS n_transformations, round(greatest(0.1, 1 - 0.03::DOUBLE * changes), 6) AS text_confidence FROM n",
    "text_truncated": f"WITH {MESSAGES} SELECT msg_id, length(substr(raw_text, 1, 5000))::BIGINT AS kept_chars, length(raw_text)::BIGINT AS n_chars, sha256(substr(raw_text, 1, 5000)) AS kept_sha256 FROM m",
    "lang_script": f"WITH {MESSAGES}, {normalised()} SELECT language, array_to_string(list_filter([CASE WHEN deva THEN 'Deva' END, CASE WHEN latin THEN 'Latn' END], lambda x: x IS NOT NULL), ',') AS scripts, count(*) AS n FROM n GROUP BY ALL",
    "ioc_all": f"{WITH_I} SELECT msg_id, type, value, confidence, ssrf_risk, is_internal, is_idn FROM i",
    "ioc_email_ipv4_counts": f"WITH m AS (SELECT doc_id AS msg_id, text AS raw_text FROM documents), {INDICATORS} SELECT type, count(*) AS n, count(DISTINCT value) AS n_values FROM i WHERE type IN ('email', 'ip') GROUP BY type",
    "ioc_threat_report": f"{WITH_I} SELECT msg_id, {', '.join(f'count(*) FILTER (type = {q(t)}) AS n_{t}' for t in ('url', 'domain', 'ip', 'phone', 'email', 'upi_id', 'sender_id'))}, count(*) FILTER (is_internal OR is_idn OR ssrf_risk <> 'safe') AS n_suspicious FROM i GROUP BY msg_id",
    "ioc_blocklist": f"{WITH_I}, {VERDICTS} SELECT msg_id, type, value, provider, threat_category, reputation_score FROM vd",
    "ioc_top_values": f"{WITH_I}, {VERDICTS}, ec AS (SELECT type, value, count(*) AS n FROM (SELECT DISTINCT type, value, provider, threat_category, reputation_score FROM vd) GROUP BY ALL), top AS (SELECT type, value, count(*) AS n, max(confidence)::DOUBLE AS confidence, count(DISTINCT msg_id) AS n_messages FROM i GROUP BY ALL) SELECT top.*, coalesce(ec.n, 0)::BIGINT AS enrichment_count FROM top LEFT JOIN ec USING (type, value) ORDER BY top.n DESC, type, value LIMIT 20",
    "ioc_safe_urls": f"{WITH_I} SELECT host, count(*) AS n FROM i WHERE type = 'url' AND ssrf_risk = 'safe' GROUP BY host",
    "network_owners": "WITH a AS (SELECT event_id, (user_id * 2654435761 + event_id) % 4294967296 AS x FROM events), w AS (SELECT c_custkey AS owner, (c_custkey % 16 + 4)::INT AS n, ((c_custkey * 1327217885) % 4294967296) // (2 ** (32 - (c_custkey % 16 + 4)))::BIGINT AS p FROM customer), u AS (SELECT n, p, min(owner) AS owner FROM w GROUP BY n, p) SELECT event_id, n AS net_length, owner FROM a JOIN u ON a.x // (2 ** (32 - n))::BIGINT = p QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY n DESC) = 1",
    "ip_risk_class": f"WITH {FINDINGS} SELECT url_id, ssrf_risk FROM u3",
    "url_findings": f"WITH {FINDINGS} SELECT url_id, f.finding_id, f.severity, f.confidence, coalesce(f.detail, '') AS detail FROM (SELECT url_id, unnest(findings) AS f FROM uf)",
    "url_verdicts": f"WITH {FINDINGS}, x AS (SELECT url_id, len(findings)::BIGINT AS n_findings, len(list_filter(findings, lambda f: f.severity IN ('HIGH', 'CRITICAL'))) > 0 OR len(findings) >= 3 AS is_malicious, list_max(list_transform(findings, lambda f: f.confidence)) AS top FROM uf) SELECT url_id, is_malicious, CASE WHEN is_malicious THEN top ELSE 0.90 END::DOUBLE AS confidence, n_findings FROM x",
    "url_entropy": f"WITH {FINDINGS} SELECT url_id, round(entropy, 4) AS entropy FROM u4",
    "evidence_long": f"{FULL} SELECT msg_id, x.category, x.severity, x.confidence, x.value FROM (SELECT msg_id, unnest(evidence) AS x FROM e)",
    "evidence_risk": f"{FULL} SELECT msg_id, evidence_risk, evidence_tier, evidence_category, round(evidence_confidence, 2) AS evidence_confidence FROM e",
    "brand_decisions": f"{ANALYSED}, {BRANDS} SELECT msg_id, brand, impersonation_detected, brand_confidence, has_official_link, has_phishing_link, sender_mismatch, coalesce({REFERENCE['category']}[ord + 1], '') AS ref_category, coalesce({REFERENCE['support_url']}[ord + 1], '') AS ref_support_url, coalesce({REFERENCE['domains']}[ord + 1], '') AS ref_domains FROM b",
    "brand_lookup": f"WITH {MESSAGES}, {URLS}, o(ord, org_id, aliases, domains) AS (VALUES {', '.join(f'({i}, {q(o[0])}, {strings(a.lower() for a in o[2])}, {strings(o[3])})' for i, o in enumerate(C.ORGANISATIONS))}), a AS (SELECT msg_id, arg_min(org_id, ord) AS org_id FROM m LEFT JOIN o ON len(list_filter(aliases, lambda x: contains(lower(raw_text), x))) > 0 GROUP BY msg_id), h AS (SELECT url_id, lower(regexp_extract({schemed('url')}, {PARTS}, 3)) AS host FROM pu), d AS (SELECT url_id, arg_min(org_id, ord) AS org_id FROM h LEFT JOIN o ON len(list_filter(domains, lambda x: host = x OR ends_with(host, '.' || x))) > 0 GROUP BY url_id) SELECT 'alias' AS kind, coalesce(org_id, '') AS org_id, count(*) AS n FROM a GROUP BY ALL UNION ALL SELECT 'domain', coalesce(org_id, ''), count(*) FROM d GROUP BY ALL",
    "manipulation": f"{ANALYSED} SELECT {FACTS} FROM sl",
    "family_risk": f"{ANALYSED} SELECT scam_family, risk_level, count(*) AS n, round_even(avg(risk_score), 2) AS avg_risk FROM sl GROUP BY ALL",
    "overview": f"{ANALYSED} SELECT count(*) AS n_messages, count(*) FILTER (risk_score >= 80) AS n_high_risk, round_even(100.0 * count(*) FILTER (risk_score >= 80) / greatest(1, count(*)), 1)::DOUBLE AS pct_high_risk FROM sl",
    "family_language_sets": f"{ANALYSED} SELECT 'family' AS kind, scam_family AS name, count(*) AS n FROM sl GROUP BY ALL UNION ALL SELECT 'language', language, count(*) FROM sl GROUP BY ALL",
    "messages_page": f"{ANALYSED} SELECT msg_id, scam_family, risk_score FROM sl WHERE risk_score >= 35 AND scam_family = 'BANK_KYC' ORDER BY epoch DESC, msg_id DESC LIMIT 20 OFFSET 20",
    "redacted_documents": r"WITH x AS (SELECT doc_id, text, regexp_replace(regexp_replace(text, '(?i)(password|passwd|secret|token|api_key)\s*[=:]\s*\S+', '\1=<redacted>', 'g'), '(?i)(Bearer\s+)\S+', '\1<redacted>', 'g') AS r FROM documents) SELECT doc_id, sha256(r) AS redacted_sha256, r <> text AS changed FROM x",
    "retention_scrub": f"WITH {MESSAGES} SELECT msg_id, sha256(raw_text) AS content_hash, msg_id < 500 AS scrubbed, CASE WHEN msg_id < 500 THEN '-' ELSE sender_id END AS sender FROM m",
    "text_log": f"WITH {MESSAGES}, {normalised()} SELECT type, sum(k)::BIGINT AS n FROM (SELECT unnest({strings(LOG_TYPES)}) AS type, unnest(logged) AS k FROM n) GROUP BY type HAVING sum(k) > 0",
    "text_log_entries": f"WITH {MESSAGES}, {normalised()}, {LOG_ENTRIES} SELECT type, original, transformed, count(*) AS n FROM le GROUP BY ALL",
    "url_hosts": f"WITH {URLS}, h AS (SELECT url_id, lower(regexp_extract(CASE WHEN regexp_matches(url, '^[a-zA-Z][a-zA-Z0-9+\\-.]*://') THEN url ELSE 'http://' || url END, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://(?:[^/?#]*@)?(\\[[^\\]/?#]*\\]?|[^/?#:]*)', 1)) AS host FROM pu) SELECT url_id, host, {IDN} AS is_idn, CASE WHEN {IDN} THEN coalesce({mapping(IDN_HOSTS)}[host], host) ELSE host END AS host_unicode FROM h",
    "decoded_meanings": f"{ANALYSED} SELECT CASE WHEN safe THEN 'No sign of manipulation.' ELSE 'Tries to cause ' || CASE WHEN fear > 0.5 THEN 'fear and hurry' ELSE 'action' END || ' over your ' || CASE WHEN scam_family <> 'SAFE' THEN scam_family ELSE 'account' END || ' so that you act at once.' END AS decoded_meaning, recommended_action, count(*) AS n FROM sl GROUP BY ALL",
    "recommended_actions": f"{ANALYSED} SELECT recommended_action, count(*) AS n, sum(len(list_distinct(regexp_extract_all(lower(raw_text), {q('(?:' + C.FEAR_HIGH + '|' + C.CREDENTIAL + ')')}))))::BIGINT AS n_words, sum(len(list_distinct(regexp_extract_all(lower(raw_text), 'https?://\\S+'))))::BIGINT AS n_links FROM sl GROUP BY ALL",
    "message_records": f"{FULL}, {DNA}, {DNA_HASH}, {INDICATORS}, cm AS (SELECT msg_id AS conv_id, 0 AS turn, raw_text AS text FROM m), {_STAGES}, {MOVES}, {RESULTS}, {NEXT}, ic AS (SELECT msg_id, count(*) FILTER (type = 'url') AS n_url, count(*) FILTER (type = 'phone') AS n_phone, count(*) FILTER (is_internal OR is_idn OR ssrf_risk <> 'safe') AS n_suspicious FROM i GROUP BY msg_id) SELECT dh.msg_id, dh.language, dh.scam_family, dh.risk_score, evidence_tier, brand, impersonation_detected, org, message_structure, hour_bucket, dna_hash, cr.current_state AS stage, cr.overall_confidence AS stage_confidence, coalesce(CASE WHEN abstained THEN 'NEEDS_REVIEW' ELSE p4.action END, '') AS next_step, coalesce(p4.probability, 0)::DOUBLE AS probability, coalesce(n_url, 0)::BIGINT AS n_url, coalesce(n_phone, 0)::BIGINT AS n_phone, coalesce(n_suspicious, 0)::BIGINT AS n_suspicious FROM dh JOIN e ON e.msg_id = dh.msg_id JOIN cr ON cr.conv_id = dh.msg_id LEFT JOIN p4 ON p4.conv_id = dh.msg_id LEFT JOIN ic ON ic.msg_id = dh.msg_id",
    "dna_hash": f"{ANALYSED}, {DNA}, {DNA_HASH} SELECT dna_hash, count(*) AS n, min(scam_family) AS scam_family FROM dh GROUP BY dna_hash",
    "embedding_pairs": "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings WHERE label IS NOT NULL) SELECT a.vec_id AS id_a, b.vec_id AS id_b, round(list_cosine_similarity(a.v, b.v), 6) AS cosine FROM e a JOIN e b ON a.label = b.label AND a.vec_id < b.vec_id WHERE list_cosine_similarity(a.v, b.v) >= 0.4",
    "campaign_assignment": f"WITH {CAMPAIGNS} SELECT msg_id, campaign_id, similarity, confidence, is_new, is_duplicate FROM asg",
    "campaign_stream": f"WITH {CAMPAIGNS} SELECT msg_id, campaign_id, similarity, confidence, is_new, is_duplicate FROM asg",
    "campaign_store": f"WITH {CAMPAIGNS}, {INDICATORS}, {DOMAIN_LISTS}, cf AS (SELECT campaign_id, round(sum(confidence), 2) AS sum_confidence FROM mem GROUP BY campaign_id) SELECT campaign_id, scam_family, member_count, member_count AS n_stored, sum_confidence, first_seen, last_seen, coalesce(array_to_string(domains, ','), '') AS domains, coalesce(senders, '') AS senders, largest, 'ACTIVE' AS status FROM cs JOIN mid USING (campaign_id) JOIN cf USING (campaign_id) LEFT JOIN cd USING (campaign_id) LEFT JOIN fs USING (campaign_id)",
    "campaign_summary": f"WITH {CAMPAIGNS}, {INDICATORS}, {DOMAIN_LISTS} SELECT campaign_id, coalesce(array_to_string(domains[1:10], ','), '') AS top_domains, member_count, scam_family, first_seen, last_seen, confidence, avg_risk, dominant_language, languages FROM cs JOIN lh USING (campaign_id) LEFT JOIN cd USING (campaign_id)",
    "campaign_list": f"WITH {CAMPAIGNS}, {INDICATORS}, {DOMAIN_LISTS} SELECT campaign_id, last_seen, member_count, coalesce(array_to_string(domains[1:5], ','), '') AS top_domains FROM cs LEFT JOIN cd USING (campaign_id) ORDER BY last_seen DESC, campaign_id LIMIT 10 OFFSET 5",
    "campaign_senders": f"WITH {CAMPAIGNS} SELECT campaign_id, senders FROM fs",
    "campaign_members": f"WITH {CAMPAIGNS} SELECT campaign_id, msg_id, risk_score, similarity FROM mem WHERE campaign_id = (SELECT campaign_id FROM cs ORDER BY member_count DESC, campaign_id LIMIT 1) ORDER BY epoch, msg_id LIMIT 20 OFFSET 5",
    "cluster_purity": f"WITH {CAMPAIGNS}, f AS (SELECT scam_family, max(member_count) AS top, sum(member_count) AS n FROM cs GROUP BY scam_family) SELECT round(sum(top) / sum(n), 6) AS purity, count(*) AS families FROM f",
    "dna_pairs_topk": f"{ANALYSED}, {DNA}, {INDICATORS}, {VECTORS}, {DNA_PAIRS} SELECT id_a, id_b, composite, round_even(round(least(1, composite * CASE WHEN overlap > 0.5 THEN 1.25 WHEN overlap > 0 THEN 1.10 ELSE 1 END::DOUBLE), 9), 2) AS association, rank FROM (SELECT *, row_number() OVER (PARTITION BY id_a ORDER BY composite DESC, id_b) AS rank FROM pc) WHERE rank <= 3",
    "dna_traits": f"{ANALYSED}, {DNA} SELECT msg_id, word_count, sentence_count, has_imperatives, org, url_count, tlds, is_shortener, has_homoglyph, phone_count, psp, currencies, message_structure, dna_language, CASE WHEN regexp_matches(raw_text, '[ऀ-ॿ]') THEN 'devanagari' ELSE 'latin' END AS dna_script, hour_bucket FROM d3",
    "embedding_validation": "SELECT label, count(*) FILTER (len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64) AS n_valid, count(*) AS n FROM embeddings GROUP BY label",
    "label_centroids": "WITH x AS (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS k FROM embeddings), a AS (SELECT label, k, avg(v) AS v, count(*) AS n FROM x GROUP BY ALL), b AS (SELECT label, max(n) AS n, list(v ORDER BY k) AS c, sqrt(sum(v * v)) AS l FROM a GROUP BY label) SELECT label, n, round(c[1] / l, 6) AS first, round(list_max(c) / l, 6) AS largest FROM b",
    "exact_duplicates": f"WITH {MESSAGES} SELECT msg_id, min(msg_id) OVER w AS first_id, count(*) OVER w AS n_copies, msg_id <> min(msg_id) OVER w AS is_duplicate FROM m WINDOW w AS (PARTITION BY raw_text)",
    "conv_stages": f"WITH {STAGED} SELECT conv_id, idx, turn, state, state_confidence, round(benign, 6) AS benign, signals FROM st",
    "conv_repeats": "WITH x AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id, text ORDER BY turn) AS r FROM conversations) SELECT conv_id, count(*) FILTER (r = 1) AS n_kept, count(*) FILTER (r > 1) AS n_repeats FROM x GROUP BY conv_id",
    "conv_transitions": f"WITH {STAGED}, {MOVES} SELECT conv_id, idx, from_state, to_state, confidence, valid, trigger FROM tr",
    "conv_results": f"WITH {STAGED}, {RESULTS} SELECT conv_id, message_count, current_state, previous_states, overall_confidence, advancement, is_progression, likely_next_state, warnings FROM cr",
    "next_step": f"WITH {STAGED}, {MOVES}, {RESULTS}, {NEXT} SELECT conv_id, current_state, CASE WHEN abstained THEN 'NEEDS_REVIEW' ELSE action END AS action, probability, round_even(round(1 - probability, 9), 3) AS uncertainty, abstained, last_move AS evidence FROM p4",
    "augment_fixed": f"WITH {MESSAGES} SELECT msg_id, perturbation, sha256(raw_text) AS variant_sha256 FROM ({_union()})",
    "augment_random": f"{RANDOM_VARIANTS} SELECT msg_id, perturbation, sha256(raw_text) AS variant_sha256 FROM rv",
    "robustness": f"{ALL_VARIANTS}, d AS MATERIALIZED (SELECT perturbation, language, risk_score >= 40 AS hit FROM sl), u AS (SELECT 'perturbation' AS level, perturbation AS name, hit FROM d UNION ALL SELECT 'language', language, hit FROM d UNION ALL SELECT 'all', 'all', hit FROM d) SELECT level, name, count(*) AS n, count(*) FILTER (hit) AS true_positives, count(*) FILTER (NOT hit) AS false_negatives, round_even(100.0 * count(*) FILTER (hit) / count(*), 1)::DOUBLE AS robustness FROM u GROUP BY ALL",
    "hardest_five": f"{VARIANTS} SELECT msg_id, perturbation, risk_score FROM sl ORDER BY risk_score, msg_id, perturbation LIMIT 5",
    "undetected": f"{VARIANTS} SELECT perturbation, count(DISTINCT raw_text) AS n, sha256(min({_marked('raw_text')})) AS first_sha256 FROM sl WHERE risk_score < 40 GROUP BY perturbation",
    "template_groups": f"SELECT {_template} AS template, count(*) AS n FROM documents GROUP BY 1",
    "split_by_template": f"SELECT doc_id, split FROM ({SPLIT})",
    "split_overlap": f"WITH x AS ({SPLIT}) SELECT split, count(DISTINCT template) AS n FROM x GROUP BY split UNION ALL SELECT 'overlap', count(*) FROM (SELECT template FROM x GROUP BY template HAVING count(DISTINCT split) > 1)",
    "calibrated": f"{ANALYSED}, x AS (SELECT *, risk_score / 100 * greatest(0.1, 1 - 0.03::DOUBLE * changes) AS f, trim(norm) = '' AS blank, greatest(fear, urgency, authority, financial, credential, link, call_to_action) AS top FROM sl) SELECT msg_id, round(CASE WHEN blank THEN 1 ELSE f END, 6) AS final_confidence, round(CASE WHEN blank THEN 0 WHEN f < 0.65 THEN f * 0.3::DOUBLE WHEN scam_family = 'SAFE' THEN 1 - f ELSE f END, 6) AS risk, CASE WHEN blank OR f < 0.65 OR scam_family = 'SAFE' THEN 'SAFE' ELSE scam_family END AS family, CASE WHEN blank OR f < 0.65 OR scam_family = 'SAFE' THEN 'SAFE' ELSE 'MALICIOUS' END AS level, NOT blank AND f < 0.65 AS is_low_confidence, CASE {' '.join(f'WHEN {k} = top THEN {q(k)}' for k in ('fear', 'urgency', 'authority', 'financial', 'credential', 'link', 'call_to_action'))} END AS strongest FROM x",
    "confusion_matrix": f"WITH {JUDGED} SELECT label, predicted, count(*) AS n FROM j GROUP BY ALL",
    "macro_f1": f"WITH {JUDGED}, c AS (SELECT label AS c FROM j UNION SELECT predicted FROM j), k AS (SELECT c, count(*) FILTER (label = c) AS sup, count(*) FILTER (predicted = c) AS said, count(*) FILTER (label = c AND predicted = c) AS hits FROM c, j GROUP BY c), x AS (SELECT *, CASE WHEN said > 0 THEN hits / said ELSE 0 END AS p, CASE WHEN sup > 0 THEN hits / sup ELSE 0 END AS r FROM k) SELECT round(sum(hits) / sum(sup), 6) AS accuracy, round(avg(p), 6) AS macro_precision, round(avg(r), 6) AS macro_recall, round(avg(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END), 6) AS macro_f1 FROM x",
}
