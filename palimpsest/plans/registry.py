"""Queries by name, over the tables of a folder, and the SQL that says the same."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checksums, findings, masking, names, patterns, recovery, text
from ..functions.pseudonyms import integrity_tag, pseudonym, sha256_hex
from ..functions.scan import candidates, resolve_overlaps, scan
from ..operators import audit, vault
from ..sources import ingest, vision
from ..sources.files import IMAGE_MAGIC, TRANSCRIPT, converted, kind_of_file
from .sanitise import Settings, audited, sanitised, trace
from .sanitise import found as reviewed

SALT = "corpus-salt"
#: Keys for the queries on encryption, which are no secrets.
KEY, OLD, OTHER = ("c2lnbmluZy1rZXktemVyb3NlY3JldC0ta2V5LXplcm8=", "c2lnbmluZy1rZXktLW9uZXNlY3JldC0ta2V5LS1vbmU=", "c2lnbmluZy1rZXktLXR3b3NlY3JldC0ta2V5LS10d28=")

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
_BY_NAME = {s.name: s for s in (*patterns.SCANNERS, *patterns.EXTRA)}


def _query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- scans ------------------------------------------------------------------------



def _re2(pattern: str) -> str:
    """A shape for RE2, whose word boundary is ASCII: letters beyond it are written as _ before, white space as a tab, all else as ~."""
    for ours, theirs in ((patterns.B, r"\b"), (patterns.NOT_URL, r"[^\s<>\"')]"), (patterns.WS, r"\s"), ("(?iu)", "(?i)"), ("(?imud)", "(?im)"), ("(?md)", "(?m)")):
        pattern = pattern.replace(ours, theirs)
    return pattern


#: RE2 has no lookaround, so for telephone numbers a mark stands after each run of digits, and another one for a plus after a digit.
_RUN, _NO_PLUS = "\x01", "\x02"
_RE2 = {s.name: _re2(s.pattern) for s in _BY_NAME.values()}
_RE2["phone"] = re.sub(r"(\[0-9\]\{\d,\d\})", rf"\1{_RUN}?", _RE2["phone"].replace("(?<![0-9])", "").replace("(?![0-9])", "")) + "END"
_RE2["phone"] = _RE2["phone"].replace(f"{_RUN}?END", _RUN)


#: White space that RE2's own class lacks, and all of it.
_RARE_WS = r"\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_WS2 = rf"[\s{_RARE_WS}]"


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _plain(text: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(regexp_replace({text}, '[{_RARE_WS}]', chr(9), 'g'), '[^\\P{{L}}\\x00-\\x7F]', '_', 'g'), '[^\\P{{N}}\\x00-\\x7F]', '_', 'g'), '[^\\x00-\\x7F]', '~', 'g')"


_LUHN = "(len(regexp_replace({v}, '[^0-9]', '', 'g')) >= 13 AND list_sum(list_transform(range(1, len(regexp_replace({v}, '[^0-9]', '', 'g')) + 1), lambda i: CASE WHEN (i - 1) % 2 <> len(regexp_replace({v}, '[^0-9]', '', 'g')) % 2 THEN CAST(regexp_replace({v}, '[^0-9]', '', 'g')[i] AS INTEGER) ELSE (2 * CAST(regexp_replace({v}, '[^0-9]', '', 'g')[i] AS INTEGER)) // 10 + (2 * CAST(regexp_replace({v}, '[^0-9]', '', 'g')[i] AS INTEGER)) % 10 END)) % 10 = 0)"
_A = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_IBAN = (
    "(length({v}) BETWEEN 15 AND 34 AND regexp_full_match({v}, '[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]+') AND "
    f"list_reduce(list_transform(string_split(substring({{v}}, 5) || substring({{v}}, 1, 4), ''), lambda x: CAST(instr('{_A}', x) - 1 AS BIGINT)), lambda a, x: (CASE WHEN x > 9 THEN a * 100 + x ELSE a * 10 + x END) % 97, CAST(0 AS BIGINT)) = 1)"
)
_NIF = f"(regexp_full_match({{v}}, '[0-9]+[A-Z]') AND substring('{checksums.NIF_LETTERS}', CAST(CAST(substring({{v}}, 1, length({{v}}) - 1) AS HUGEINT) % 23 AS INTEGER) + 1, 1) = right({{v}}, 1))"
_IP = "(len(string_split({v}, '.')) = 4 AND len(list_filter(string_split({v}, '.'), lambda p: NOT regexp_full_match(p, '[0-9]+') OR CAST(p AS HUGEINT) > 255)) = 0)"
_ODD = "[" + ", ".join(map(str, checksums.ODD_WEIGHTS)) + "]"
_AT = f"(instr('{_A}', upper({{{{v}}}})[i + 1]) - CASE WHEN instr('{_A}', upper({{{{v}}}})[i + 1]) > 10 THEN 11 ELSE 1 END)".replace("{{", "{").replace("}}", "}")
_CF = (
    "(regexp_full_match(upper({v}), '[A-Z]{{6}}[0-9]{{2}}[A-Z][0-9]{{2}}[A-Z][0-9]{{3}}[A-Z]') AND "
    f"substring('{checksums.ALPHABET}', CAST(list_sum(list_transform(range(0, 15), lambda i: CASE WHEN i % 2 = 0 THEN {_ODD}[{_AT} + 1] ELSE {_AT} END)) % 26 AS INTEGER) + 1, 1) = substring(upper({{v}}), 16, 1))"
)
_PHONE = r"(length(regexp_replace({v}, '[^0-9]', '', 'g')) BETWEEN 8 AND 15 AND NOT regexp_full_match({v}, '(?:[0-9][ \-]?){{12,18}}[0-9]'))"
_GATE_SQL = {"iban": _IBAN, "card": _LUHN, "nif": _NIF, "ipv4": _IP, "phone": _PHONE}


def _matches_sql(src: str, scanner: str) -> str:
    """Of (id, text) rows, (id, value, start_pos, end_pos) of all matches: what stands between them and they themselves add up to their places."""
    shape, seen = _q(_RE2[scanner]), _plain("text")
    if scanner == "phone":
        seen = f"replace(regexp_replace({seen}, '([0-9]+)', '\\1{_RUN}', 'g'), '{_RUN}+', '{_RUN}{_NO_PLUS}')"
    cut = f"SELECT id, text, list_transform(string_split_regex({seen}, {shape}), lambda x: replace(x, '{_RUN}', '')) AS g, list_transform(regexp_extract_all({seen}, {shape}), lambda x: replace(x, '{_RUN}', '')) AS m FROM ({src})"
    at = "SELECT id, text, g, m, unnest(range(1, len(m) + 1)) AS i FROM cut WHERE len(m) > 0"
    start = "list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
    return f"WITH cut AS ({cut}), hit AS ({at}), placed AS (SELECT id, text, length(m[i]) AS n, CAST({start} AS INTEGER) AS s FROM hit) SELECT id, substring(text, s + 1, n) AS value, s AS start_pos, CAST(s + n AS INTEGER) AS end_pos FROM placed"


def _scan_query(scanner: str, name: str, rows: Callable[[SparkSession, str], DataFrame], src: str) -> None:
    """Register a scan of (id, text) rows by one scanner, its checks included."""
    gate = _GATE_SQL.get(scanner, "true").format(v="value")

    @_query(f"SELECT * FROM ({_matches_sql(src, scanner)}) WHERE {gate}", name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = rows(spark, sf_dir).select("id", F.explode(candidates(F.col("text"), [_BY_NAME[scanner]])).alias("s"))
        return found.select("id", "s.value", F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _made(name: str, key: str, spark_text: Callable[[Column], Column]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: table(spark, sf_dir, name).select(F.col(key).alias("id"), spark_text(F.col(key)).alias("text"))


for _s in ("email", "ipv4", "date", "card", "postal_it", "nhs"):
    _scan_query(_s, f"scan_{_s}_documents", _documents, "SELECT doc_id AS id, text FROM documents")
_scan_query("url", "scan_url_pages", lambda spark, d: table(spark, d, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("text")), "SELECT page_id AS id, url AS text FROM pages")
_scan_query("card", "scan_card_orders", _made("orders", "o_orderkey", lambda k: F.format_string("card %016d, ok", k)), "SELECT o_orderkey AS id, printf('card %016d, ok', o_orderkey) AS text FROM orders")
# identifiers made of keys, some of them valid by chance
for _s, _f in {
    "iban": "to IT%02d%022d by", "vat": "vat IT%011d.", "nif": "dni %08dK or X1234567L", "ssn": "ssn 123-45-%04d.", "plate": "car AB %03dCD!", "passport": "AA%07d", "postal_uk": "SW1A %dAA",
    "cf": "cf rssmra%02da41f205z", "ipv6": "at 2001:db8:0:%04x:1.", "nhs": "nhs 943 476 %04d.", "postal_it": "via Roma 1, %05d Roma",
}.items():
    _mod = {"iban": 97, "ssn": 10000, "plate": 1000, "cf": 100, "postal_uk": 10, "ipv6": 65536, "nhs": 10000, "postal_it": 100000}.get(_s, 10_000_000)

    def _spark(k: Column, s: str = _s, f: str = _f, mod: int = _mod) -> Column:
        return F.format_string(f, k % 97, k) if s == "iban" else F.format_string(f, k % mod)

    _args = "c_custkey % 97, c_custkey" if _s == "iban" else f"c_custkey % {_mod}"
    _scan_query(_s, f"scan_{_s}_customers", _made("customer", "c_custkey", _spark), f"SELECT c_custkey AS id, printf({_q(_f)}, {_args}) AS text FROM customer")


@_query("""
SELECT c_custkey AS id, value, CAST(4 AS INTEGER) AS start_pos, CAST(4 + length(value) AS INTEGER) AS end_pos
FROM (SELECT c_custkey, printf('+39 %03d %07d', c_custkey % 1000, c_custkey) AS value FROM customer)
WHERE regexp_full_match(value, '\\+39 [0-9]{3} [0-9]{7}')
""")
def scan_phone_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One number in each text, so that lookaround has nothing to see."""
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), F.explode(candidates(F.concat(F.lit("tel "), F.format_string("+39 %03d %07d", k % 1000, k)), [_BY_NAME["phone"]])).alias("s"))
    return rows.select("id", "s.value", F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"))


_DOCUMENTS = "SELECT doc_id AS id, text FROM documents"


@_query(f"SELECT * FROM ({_matches_sql(_DOCUMENTS, 'phone')}) WHERE {_PHONE.format(v='value')}")
def scan_phone_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _documents(spark, sf_dir).select("id", F.explode(candidates(F.col("text"), [_BY_NAME["phone"]])).alias("s"))
    return rows.select("id", "s.value", F.col("s.start").alias("start_pos"), F.col("s.end").alias("end_pos"))


def _spans_sql(scanners: tuple[patterns.Scanner, ...], src: str = _DOCUMENTS) -> str:
    """CTE kept (id, kind, value, start_pos, end_pos, confidence, reason): the spans of (id, text) rows without overlaps; needs WITH RECURSIVE."""
    parts = []
    for k, s in enumerate(scanners):
        sure, why = str(s.confidence), _q(s.reason)
        if s.gate == "cf":
            sure, why = (f"CASE WHEN {_CF.format(v='value')} THEN {a} ELSE {b} END" for a, b in (("0.98", sure), ("'codice_fiscale_checksum'", why)))
        parts.append(f"SELECT id, '{s.kind}' AS kind, value, start_pos, end_pos, CAST({sure} AS DOUBLE) AS confidence, {why} AS reason, {k} AS k FROM ({_matches_sql(src, s.name)}) WHERE {_GATE_SQL.get(s.name, 'true').format(v='value')}")
    return f"""spans AS MATERIALIZED ({' UNION ALL '.join(parts)}),
ordered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY id ORDER BY start_pos, start_pos - end_pos, -confidence, k) AS i FROM spans),
walk AS (
  SELECT *, end_pos AS e, true AS keep FROM ordered WHERE i = 1
  UNION ALL
  SELECT o.*, CASE WHEN o.start_pos >= w.e THEN o.end_pos ELSE w.e END, o.start_pos >= w.e FROM walk w JOIN ordered o ON o.id = w.id AND o.i = w.i + 1
),
kept AS (SELECT id, kind, value, start_pos, end_pos, confidence, reason FROM walk WHERE keep)"""


@_query(f"WITH RECURSIVE {_spans_sql(patterns.SCANNERS)} SELECT * FROM kept")
def scan_all_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scanners and overlap resolution."""
    rows = _documents(spark, sf_dir).select("id", F.explode(scan(F.col("text"))).alias("s")).select("id", "s.*")
    return rows.withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


# --- checksums --------------------------------------------------------------------


def _check_query(name: str, source: str, key: str, spark_value: Callable[[Column], Column], sql_value: str, check: Callable[[Column], Column], sql_check: str) -> None:
    @_query(f"SELECT id, value, {sql_check.format(v='value')} AS ok FROM (SELECT {key} AS id, {sql_value} AS value FROM {source})", name)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = table(spark, sf_dir, source).select(F.col(key).alias("id"), spark_value(F.col(key)).alias("value"))
        return rows.select("id", "value", check(F.col("value")).alias("ok"))


_check_query("checksum_luhn", "orders", "o_orderkey", lambda k: F.format_string("%04d-%012d", k % 7919, k), "printf('%04d-%012d', o_orderkey % 7919, o_orderkey)", checksums.luhn_ok, _LUHN)
_check_query("checksum_iban", "orders", "o_orderkey", lambda k: F.format_string("DE%02d%018d", k % 97, k), "printf('DE%02d%018d', o_orderkey % 97, o_orderkey)", checksums.iban_ok, _IBAN)
_check_query("checksum_nif", "part", "p_partkey", lambda k: F.concat(F.format_string("%08d", k), F.substring(F.lit(checksums.NIF_LETTERS), 7, 1)), f"printf('%08d', p_partkey) || '{checksums.NIF_LETTERS[6]}'", checksums.nif_ok, _NIF)
_check_query("checksum_ipv4", "part", "p_partkey", lambda k: F.format_string("10.%d.%d.1", k % 400, k % 7), "printf('10.%d.%d.1', p_partkey % 400, p_partkey % 7)", checksums.ipv4_ok, _IP)
_check_query("checksum_cf", "customer", "c_custkey", lambda k: F.format_string("RSSMRA%02dA%02dH%03dU", k % 100, k % 31, k % 1000), "printf('RSSMRA%02dA%02dH%03dU', c_custkey % 100, c_custkey % 31, c_custkey % 1000)", checksums.fiscal_code_checked, _CF)


# --- overlaps ---------------------------------------------------------------------


@_query("""
WITH RECURSIVE s AS (
  SELECT l_orderkey AS id, CAST(l_linenumber * 3 + l_partkey % 5 AS INTEGER) AS s, CAST(1 + l_suppkey % 7 AS INTEGER) AS n, l_discount AS c, CAST(l_linenumber AS INTEGER) AS k FROM lineitem
), o AS (
  SELECT *, row_number() OVER (PARTITION BY id ORDER BY s, -n, -c, k) AS i FROM s
), walk AS (
  SELECT id, i, s + n AS e, k || ':' || s || '-' || (s + n) AS kept FROM o WHERE i = 1
  UNION ALL
  SELECT o.id, o.i, CASE WHEN o.s >= w.e THEN o.s + o.n ELSE w.e END, CASE WHEN o.s >= w.e THEN w.kept || ' ' || o.k || ':' || o.s || '-' || (o.s + o.n) ELSE w.kept END
  FROM walk w JOIN o ON o.id = w.id AND o.i = w.i + 1
)
SELECT id, arg_max(kept, i) AS kept FROM walk GROUP BY id
""")
def overlaps_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlap resolution of made-up spans, an order's items being its candidates."""
    start, n = (F.col("l_linenumber") * 3 + F.col("l_partkey") % 5).cast("int"), (1 + F.col("l_suppkey") % 7).cast("int")
    span = F.struct(start.alias("start"), (-n).alias("shorter"), (-F.col("l_discount")).alias("unsure"), F.col("l_linenumber").cast("int").alias("scanner"), F.lit("OTHER").alias("kind"), F.col("l_linenumber").cast("string").alias("value"), (start + n).alias("end"), F.col("l_discount").alias("confidence"), F.lit("made").alias("reason"))
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(span).alias("spans"))  # an order has a handful of items
    kept = F.transform(resolve_overlaps(F.col("spans")), lambda s: F.concat(s["value"], F.lit(":"), s["start"].cast("string"), F.lit("-"), s["end"].cast("string")))
    return rows.select("id", F.array_join(kept, " ").alias("kept"))


# --- text -------------------------------------------------------------------------

_JUNK = "'  ' || replace(text, '. ', '.' || chr(13) || chr(10)) || chr(173) || 'a-' || chr(10) || 'b-' || chr(10) || 'c ' || chr(9) || chr(10) || chr(10) || chr(10) || chr(10) || 'e' || chr(769) || chr(8203) || chr(13) || ' '"


def _strip_sql(t: str) -> str:
    return f"regexp_replace({t}, '^{_WS2}+|{_WS2}+$', '', 'g')"


def _tidy_sql(t: str) -> str:
    t = f"translate({t}, chr(173) || chr(8203) || chr(8204) || chr(8205) || chr(65279), '')"
    t = f"replace(replace({t}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"
    t = f"regexp_replace({t}, '([\\p{{L}}\\p{{N}}_])-\\n([\\p{{L}}\\p{{N}}_])', '\\1\\2', 'g')"
    t = f"regexp_replace({t}, '(?m)[ \\t]+$', '', 'g')"
    return _strip_sql(f"regexp_replace({t}, '\\n{{3,}}', chr(10) || chr(10), 'g')")


@_query(f"SELECT doc_id, {_tidy_sql(f'nfc_normalize({_JUNK})')} AS text FROM documents")
def normalise_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Normalisation of documents with every kind of blemish put in."""
    t = F.concat(F.lit("  "), F.replace("text", F.lit(". "), F.lit(".\r\n")), F.lit("­a-\nb-\nc \t\n\n\n\né​\r "))
    return table(spark, sf_dir, "documents").select("doc_id", text.normalise(t).alias("text"))


@_query("""
SELECT id, CASE WHEN len(p) = 1 THEN p[1] ELSE array_to_string(list_transform(range(1, len(p) + 1), lambda i: '<!-- page ' || i || ' -->' || chr(10) || chr(10) || p[i]), chr(10) || chr(10)) END AS text,
       CAST(length(array_to_string(p, chr(10) || chr(10))) AS BIGINT) AS char_count
FROM (SELECT conv_id AS id, list(text ORDER BY turn) AS p FROM conversations GROUP BY conv_id)
""")
def canonical_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as the pages of a document."""
    rows = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: t["text"]).alias("pages"))
    return rows.select("id", text.canonical(F.lit(""), F.col("pages")).alias("text"), text.finalised(F.lit(""), F.col("pages"))["char_count"].alias("char_count"))


@_query("SELECT doc_id, CASE WHEN length(text) <= 1000 THEN text ELSE left(text, 700) || chr(10) || chr(10) || '[... ' || (length(text) - 1000) || ' characters omitted ...]' || chr(10) || chr(10) || right(text, 300) END AS text FROM documents")
def clip_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.clip(F.col("text"), 1000).alias("text"))


_LABELS = ("full name", "E-Mail", " PAN ", "nonsense-label", "", "Iban", "date of birth", "company")


@_query(
    "WITH l AS (SELECT event_id, CASE event_id % 9 " + " ".join(f"WHEN {i} THEN {_q(v)}" for i, v in enumerate(_LABELS)) + " ELSE event_type END AS raw FROM events), "
    "n AS (SELECT event_id, replace(replace(upper(trim(raw)), ' ', '_'), '-', '_') AS v FROM l), "
    "a AS (SELECT event_id, CASE v " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in patterns.ALIASES.items()) + " ELSE v END AS v FROM n) "
    "SELECT event_id, CASE WHEN v IN (" + ", ".join(map(_q, patterns.KINDS)) + ") THEN v ELSE 'OTHER' END AS kind FROM a"
)
def kinds_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.coalesce(F.try_element_at(F.array(*[F.lit(x) for x in _LABELS]), (F.col("event_id") % 9 + 1).cast("int")), F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", text.kind_of(raw).alias("kind"))


@_query(r"SELECT page_id, trim(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '" + _WS2 + r"+', ' ', 'g')) AS text FROM pages")
def markup_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.without_markup(F.col("html")).alias("text"))


@_query("SELECT c_custkey, CASE WHEN length(c_name) <= 4 THEN repeat('*', length(c_name)) ELSE left(c_name, 2) || repeat('*', length(c_name) - 4) || right(c_name, 2) END AS shown FROM customer")
def preview_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", text.preview(F.col("c_name")).alias("shown"))


@_query("SELECT doc_id, CAST(greatest(1, length(text) // 4) AS INTEGER) AS tokens, CAST(CASE WHEN 4096 - 256 - greatest(1, length(text) // 4) >= 1500 THEN 1500 ELSE greatest(256, 4096 - 256 - greatest(1, length(text) // 4)) END AS INTEGER) AS budget FROM documents")
def budgets_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", text.estimated_tokens(t).alias("tokens"), text.completion_budget(t, 1500, 4096).cast("int").alias("budget"))


# --- pseudonyms -------------------------------------------------------------------


def _hmac_of(message: str) -> str:
    key = SALT.encode().ljust(64, b"\0")
    inner, outer = (bytes(b ^ p for b in key).hex() for p in (0x36, 0x5C))
    return f"sha256(unhex('{outer}') || unhex(sha256(unhex('{inner}') || encode({message}))))"


def _hmac_sql(value: str, kind: str) -> str:
    return _hmac_of(f"{kind} || ':' || {value}")


def _token_sql(value: str, kind: str) -> str:
    return f"'[' || {kind} || '_' || upper(left({_hmac_sql(value, kind)}, 6)) || ']'"


for _style, _sql in (("label", _token_sql("c_name", "'PERSON'")), ("hash", f"'PERSON_' || upper(left({_hmac_sql('c_name', chr(39) + 'PERSON' + chr(39))}, 6))"), ("redact", "'[REDACTED]'")):

    @_query(f"SELECT c_custkey, {_sql} AS token FROM customer", f"pseudonyms_{_style}")
    def _run(spark: SparkSession, sf_dir: str, style: str = _style) -> DataFrame:
        return table(spark, sf_dir, "customer").select("c_custkey", pseudonym(F.col("c_name"), F.lit("PERSON"), SALT, style=style).alias("token"))


@_query(f"SELECT token, count(DISTINCT c_name) AS n FROM (SELECT {_token_sql('c_name', chr(39) + 'PERSON' + chr(39))} AS token, c_name FROM customer) GROUP BY token HAVING count(DISTINCT c_name) > 1")
def collisions_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens that stand for more than one name; six digits are few."""
    plan = F.array(F.struct(pseudonym(F.col("c_name"), F.lit("PERSON"), SALT).alias("placeholder"), F.col("c_name").alias("value")))
    return audit.collisions(table(spark, sf_dir, "customer").select(plan.alias("plan"))).select(F.col("placeholder").alias("token"), F.col("values").alias("n"))


@_query(f"SELECT token, count(DISTINCT v) AS n FROM (SELECT {_token_sql('v', chr(39) + 'ACCOUNT' + chr(39))} AS token, v FROM (SELECT printf('%09d', o_orderkey) AS v FROM orders)) GROUP BY token HAVING count(DISTINCT v) > 1")
def collisions_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same over enough values for some tokens to meet."""
    v = F.format_string("%09d", F.col("o_orderkey"))
    plan = F.array(F.struct(pseudonym(v, F.lit("ACCOUNT"), SALT).alias("placeholder"), v.alias("value")))
    return audit.collisions(table(spark, sf_dir, "orders").select(plan.alias("plan"))).select(F.col("placeholder").alias("token"), F.col("values").alias("n"))


_PAYLOAD_SQL = "'{\"event_id\":' || event_id || ',\"event_type\":\"' || event_type || '\"}'"


@_query(f"SELECT event_id, sha256(event_type) AS digest, {_hmac_of(_PAYLOAD_SQL)} AS tag FROM events")
def digests_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests, and integrity tags of payloads."""
    tag = integrity_tag(F.struct("event_id", "event_type"), SALT.encode())
    return table(spark, sf_dir, "events").select("event_id", sha256_hex(F.encode("event_type", "UTF-8")).alias("digest"), tag.alias("tag"))


# --- masking ----------------------------------------------------------------------

_SAFE = [_BY_NAME[n] for n in ("email", "card", "ipv4")]


def _masked_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents masked by the scanners that RE2 can follow."""
    rows = table(spark, sf_dir, "documents").withColumn("found", findings.from_spans(resolve_overlaps(candidates(F.col("text"), _SAFE))))
    rows = rows.withColumn("plan", masking.plan_of(F.col("found"), SALT))
    return rows.withColumn("m", masking.masked(F.col("text"), F.col("plan")))


#: plan (id, kind, value, confidence, placeholder) and masked (id, i, text, kind, value, placeholder, n), a row for each replacement, from found (id, kind, value, confidence).
_MASKED_SQL = f"""plan AS MATERIALIZED (SELECT id, kind, value, max(confidence) AS confidence, {_token_sql('value', 'kind')} AS placeholder FROM found GROUP BY id, kind, value),
step AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY id ORDER BY -length(value), -confidence, kind, value) AS i FROM plan),
masked AS (
  SELECT doc_id AS id, 0 AS i, coalesce(text, '') AS text, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS value, CAST(NULL AS VARCHAR) AS placeholder, CAST(0 AS BIGINT) AS n FROM documents
  UNION ALL
  SELECT m.id, CAST(m.i + 1 AS INTEGER), replace(m.text, s.value, s.placeholder), s.kind, s.value, s.placeholder, CAST((length(m.text) - length(replace(m.text, s.value, ''))) // length(s.value) AS BIGINT) FROM masked m JOIN step s ON s.id = m.id AND s.i = m.i + 1
)"""
_SAFE_SQL = f"WITH RECURSIVE {_spans_sql(tuple(_SAFE))}, found AS (SELECT id, kind, value, confidence FROM kept), {_MASKED_SQL}"


@_query(f"{_SAFE_SQL} SELECT id AS doc_id, arg_max(text, i) AS cleaned_text, CAST(count(*) FILTER (WHERE n > 0) AS INTEGER) AS n_masked FROM masked GROUP BY id")
def mask_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _masked_documents(spark, sf_dir).select("doc_id", F.col("m.text").alias("cleaned_text"), F.size("m.changes").alias("n_masked"))


@_query(f"{_SAFE_SQL} SELECT id AS doc_id, kind, value, placeholder, confidence FROM plan")
def plan_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _masked_documents(spark, sf_dir).select("doc_id", "found", F.explode("plan").alias("p"))
    conf = F.array_max(F.transform(F.filter("found", lambda f: (f["kind"] == F.col("p.kind")) & (f["value"] == F.col("p.value"))), lambda f: f["confidence"]))
    return rows.select("doc_id", "p.kind", "p.value", "p.placeholder", conf.alias("confidence"))


@_query(f"{_SAFE_SQL} SELECT kind, CAST(sum(n) AS BIGINT) AS occurrences, count(*) AS documents FROM masked WHERE n > 0 GROUP BY kind")
def counts_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.counts_by_kind(_masked_documents(spark, sf_dir).select(F.col("m.changes").alias("changes")))


@_query(f"{_SAFE_SQL}, d AS (SELECT id, sum(n) AS n FROM masked GROUP BY id) SELECT lang, source, count(*) AS documents, count(*) FILTER (WHERE n > 0) AS masked_documents, CAST(sum(n) AS BIGINT) AS occurrences FROM d JOIN documents ON doc_id = id GROUP BY ROLLUP (lang, source)")
def rollup_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.rollup(_masked_documents(spark, sf_dir).withColumn("changes", F.col("m.changes")), "lang", "source")


@_query("""
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY n DESC, i) - 1 AS INTEGER) AS pos, kind, n FROM (
  SELECT c_custkey AS id, 0 AS i, 'PHONE' AS kind, c_custkey % 5 AS n FROM customer
  UNION ALL SELECT c_custkey, 1, 'EMAIL', c_custkey % 3 FROM customer UNION ALL SELECT c_custkey, 2, 'IBAN', 2 FROM customer)
""")
def counts_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by kind, the largest first, often equal."""
    k = F.col("c_custkey").cast("long")
    counts = F.create_map(F.lit("PHONE"), k % 5, F.lit("EMAIL"), k % 3, F.lit("IBAN"), F.lit(2).cast("long"))
    rows = table(spark, sf_dir, "customer").select(k.alias("id"), F.posexplode(audit.counts_in_order(counts)).alias("pos", "c"))
    return rows.select("id", "pos", "c.kind", "c.n")


@_query("""
SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY kind, placeholder, i) - 1 AS INTEGER) AS pos, kind, placeholder, original FROM (
  SELECT c_custkey AS id, 0 AS i, 'PHONE' AS kind, c_mktsegment AS placeholder, 'a' AS original FROM customer
  UNION ALL SELECT c_custkey, 1, 'EMAIL', c_mktsegment, 'b' FROM customer UNION ALL SELECT c_custkey, 2, 'EMAIL', 'HOUSEHOLD', 'c' FROM customer)
""")
def changes_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes by kind and placeholder, some of them equal."""
    one = lambda kind, placeholder, original: F.struct(F.lit(kind).alias("kind"), placeholder.alias("placeholder"), F.lit(original).alias("original"))
    changes = F.array(one("PHONE", F.col("c_mktsegment"), "a"), one("EMAIL", F.col("c_mktsegment"), "b"), one("EMAIL", F.lit("HOUSEHOLD"), "c"))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.posexplode(audit.changes_in_order(changes)).alias("pos", "c"))
    return rows.select("id", "pos", "c.kind", "c.placeholder", "c.original")


@_query("""
SELECT count(*) AS jobs, count(*) FILTER (WHERE o_orderkey % 7 = 0) AS pending, count(*) FILTER (WHERE o_orderkey % 7 IN (1, 2)) AS processing,
       count(*) FILTER (WHERE o_orderkey % 7 > 3) AS done, count(*) FILTER (WHERE o_orderkey % 7 = 3) AS error FROM orders
""")
def gauges_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs in several states."""
    k = F.col("o_orderkey") % 7
    return audit.gauges(table(spark, sf_dir, "orders").select(F.when(k == 0, "pending").when(k < 3, "processing").when(k == 3, "error").otherwise("done").alias("status")))


@_query("SELECT doc_id, greatest(1, length(text) // 4) + 1500 > 2000 AS oversized FROM documents WHERE text IS NOT NULL")
def oversized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose prompt and answer may not fit a window."""
    return table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", text.oversized(F.col("text"), 1500, 2000).alias("oversized"))


_ANSWERS = (" \n", "call {name} back", "call the client back")


@_query("SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 2 THEN 'call the client back' ELSE 'call [X] back' END AS text FROM customer")
def accepted_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A model's masked texts that are blank, that leak and that are fine, against our own."""
    k, name = F.col("c_custkey"), F.col("c_name")
    plan = F.array(F.struct(F.lit("PERSON").alias("kind"), name.alias("value"), F.lit("[X]").alias("placeholder")))
    said = F.get(F.array(*[F.replace(F.lit(a), F.lit("{name}"), name) for a in _ANSWERS]), (k % 3).cast("int"))
    return table(spark, sf_dir, "customer").select(k.alias("id"), masking.accepted(said, F.lit("call [X] back"), plan).alias("text"))


# --- findings and reviews ---------------------------------------------------------


def _reviewed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with made-up findings, validated spans and a review of them."""
    k = F.col("c_custkey")
    null = F.lit(None).cast("int")
    found = lambda kind, value, conf, source="detector": F.struct(F.lit(kind).alias("kind"), value.alias("value"), null.alias("start"), null.alias("end"), F.lit("").alias("context"), F.lit(conf).alias("confidence"), F.lit(source).alias("source"))
    span = lambda kind, value, conf: F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.lit(0).alias("start"), F.lit(1).alias("end"), F.lit(conf).alias("confidence"), F.lit("made").alias("reason"))
    name, mail, born = F.col("c_name"), F.format_string("c%d@shop.example", k), F.format_string("1/1/%d", 1900 + k % 100)
    missing = F.struct(F.lit("phone").alias("kind"), F.format_string("555-%d", k % 3).alias("value"), F.lit("").alias("context"), F.lit(2.0).alias("confidence"))
    critique = F.struct(
        F.lit(0.5).alias("agreement"), (k % 5 == 0).alias("accepted"), F.when(k % 2 == 0, F.array(missing)).otherwise(F.slice(F.array(missing), 1, 0)).alias("missing"),
        F.array(F.when(k % 3 == 0, mail).otherwise(born)).alias("false_positives"), F.array(F.when(k % 7 == 0, mail).otherwise(F.lit(""))).alias("over_masking"),
        F.array().cast("array<string>").alias("feedback"), F.slice(F.array(F.struct(F.lit("").alias("value"), F.lit("").alias("kind"))), 1, 0).alias("wrong_kind"),
    )
    return table(spark, sf_dir, "customer").select(
        k.alias("id"), F.concat(name, F.lit(" "), mail, F.lit(" "), born, F.lit(" 555-1")).alias("text"),
        F.array(found("PERSON", name, 0.6), found("EMAIL", mail, 0.9), found("DOB", born, 0.5)).alias("found"), F.array(found("PERSON", name, 0.8, "name_detector"), found("PERSON", F.lit("Ann Other"), 0.7, "name_detector")).alias("extra"),
        F.array(span("EMAIL", mail, 0.99), span("DOB", born, 0.5), span("IP_ADDRESS", F.lit("10.0.0.1"), 0.85)).alias("validated"), critique.alias("critique"),
    )


def _findings_out(rows: DataFrame, column: Column) -> DataFrame:
    return rows.select("id", F.explode(column).alias("f")).select("id", "f.kind", "f.value", "f.confidence", "f.source")


_BASE = """
base AS (SELECT c_custkey AS id, c_name AS name, 'c' || c_custkey || '@shop.example' AS mail, '1/1/' || (1900 + c_custkey % 100) AS born FROM customer),
found AS (SELECT id, 'PERSON' AS kind, name AS value, CAST(0.6 AS DOUBLE) AS confidence, 'detector' AS source FROM base UNION ALL SELECT id, 'EMAIL', mail, 0.9, 'detector' FROM base UNION ALL SELECT id, 'DOB', born, 0.5, 'detector' FROM base),
rejected AS (SELECT id, CASE WHEN id % 3 = 0 THEN mail ELSE born END AS value FROM base),
missing AS (SELECT id, 'PHONE' AS kind, '555-' || (id % 3) AS value, CAST(1.0 AS DOUBLE) AS confidence, 'critic' AS source FROM base WHERE id % 2 = 0),
merged AS (SELECT f.* FROM found f ANTI JOIN rejected r ON f.id = r.id AND f.value = r.value UNION ALL SELECT * FROM missing),
kept AS (SELECT m.* FROM merged m ANTI JOIN rejected r ON m.id = r.id AND m.value = r.value),
valid AS (SELECT id, 'EMAIL' AS kind, mail AS value, CAST(0.99 AS DOUBLE) AS confidence, 'normaliser' AS source FROM base UNION ALL SELECT id, 'DOB', born, 0.5, 'normaliser' FROM base UNION ALL SELECT id, 'IP_ADDRESS', '10.0.0.1', 0.85, 'normaliser' FROM base),
fresh AS (SELECT v.* FROM valid v WHERE NOT EXISTS (SELECT 1 FROM kept k WHERE k.id = v.id AND k.kind = v.kind AND k.value = v.value) AND NOT (v.id % 7 = 0 AND v.kind = 'EMAIL') AND NOT (v.kind = 'DOB' AND EXISTS (SELECT 1 FROM rejected r WHERE r.id = v.id AND r.value = v.value))),
reconciled AS (SELECT * FROM kept UNION ALL SELECT * FROM fresh)
"""


@_query(f"WITH {_BASE} SELECT * FROM merged")
def merge_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _reviewed(spark, sf_dir)
    return _findings_out(rows, findings.merged(F.col("found"), F.col("critique")))


@_query(f"WITH {_BASE} SELECT * FROM reconciled")
def reconcile_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _reviewed(spark, sf_dir)
    c = F.col("critique")
    return _findings_out(rows, findings.reconciled(findings.merged(F.col("found"), c), c, F.col("validated")))


@_query(f"WITH {_BASE} SELECT r.* FROM reconciled r JOIN base b ON r.id = b.id WHERE contains(name || ' ' || mail || ' ' || born || ' 555-1', value)")
def reviewable_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _reviewed(spark, sf_dir)
    c = F.col("critique")
    return _findings_out(rows, findings.reviewable(findings.reconciled(findings.merged(F.col("found"), c), c, F.col("validated")), F.col("text")))


@_query(f"WITH {_BASE} SELECT id, kind, value, CASE WHEN kind = 'PERSON' THEN CAST(0.8 AS DOUBLE) ELSE confidence END AS confidence, source FROM found UNION ALL SELECT id, 'PERSON', 'Ann Other', CAST(0.7 AS DOUBLE), 'name_detector' FROM base")
def augment_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _findings_out(_reviewed(spark, sf_dir), findings.augmented(F.col("found"), F.col("extra")))


@_query("SELECT c_custkey AS id, c_custkey % 5 = 0 AS converged FROM customer")
def converged_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reviewed(spark, sf_dir).select("id", findings.converged(F.col("critique")).alias("converged"))


@_query("SELECT c_custkey AS id, c_custkey % 5 = 0 OR (c_custkey % 2 = 0 AND c_custkey % 11 >= 9) AS converged FROM customer")
def converged_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews that miss something or nothing, with agreement on both sides of the threshold."""
    k, c = F.col("id"), F.col("critique")
    score = c.withField("agreement", k % 11 / F.lit(10.0))
    missing = F.when(k % 2 == 0, F.slice(c["missing"], 1, 0)).otherwise(F.array(F.struct(F.lit("phone").alias("kind"), F.lit("555").alias("value"), F.lit("").alias("context"), F.lit(1.0).alias("confidence"))))
    return _reviewed(spark, sf_dir).select("id", findings.converged(score.withField("missing", missing)).alias("converged"))


@_query(f"WITH {_BASE} SELECT m.id, CASE WHEN value = mail THEN 'USERNAME' WHEN value = name AND m.id % 2 = 1 THEN 'OTHER' ELSE kind END AS kind, value, confidence, source FROM merged m JOIN base b ON m.id = b.id")
def corrected_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews that correct kinds: of two corrections the last counts, an unknown kind is OTHER."""
    k, f = F.col("id"), F.col("found")
    fix = lambda value, kind: F.struct(value.alias("value"), F.lit(kind).alias("kind"))
    mail, name = F.get(f, F.lit(1))["value"], F.get(f, F.lit(0))["value"]
    wrong = F.concat(F.array(fix(mail, "phone"), fix(mail, "username")), F.when(k % 2 == 1, F.array(fix(name, "nonsense"))).otherwise(F.slice(F.array(fix(name, "")), 1, 0)))
    return _findings_out(_reviewed(spark, sf_dir), findings.merged(f, F.col("critique").withField("wrong_kind", wrong), fix_kinds=True))


@_query("SELECT c_custkey AS id, 'PERSON' AS kind, 'Ann Other' AS value, CAST(0.7 AS DOUBLE) AS confidence, 'name_detector' AS source FROM customer UNION ALL SELECT c_custkey, 'PERSON', c_name, 0.6, 'detector' FROM customer WHERE c_custkey % 2 = 0")
def uncovered_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons, the first of whom is now and then found as an employer too."""
    f = F.col("found")
    first = F.get(f, F.lit(0))
    more = F.when(F.col("id") % 2 == 1, F.array(first.withField("kind", F.lit("EMPLOYER")))).otherwise(F.slice(f, 1, 0))
    return _findings_out(_reviewed(spark, sf_dir), findings.uncovered_names(F.concat(F.slice(f, 1, 1), more, F.slice(F.col("extra"), 2, 1))))


@_query(f"""WITH {_BASE} SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY -confidence, kind, value) - 1 AS INTEGER) AS pos, kind, value, {_token_sql('value', 'kind')} AS placeholder
FROM (SELECT * FROM found UNION ALL SELECT id, 'ADDRESS', 'Via ' || id, 0.6, '' FROM base)""")
def plan_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans, in their order: by confidence, then kind; what is found twice stands once."""
    f = F.col("found")
    place = F.get(f, F.lit(0)).withField("kind", F.lit("ADDRESS")).withField("value", F.concat(F.lit("Via "), F.col("id")))
    plan = masking.plan_of(F.concat(f, F.array(place, place), F.slice(f, 2, 1)), SALT)
    return _reviewed(spark, sf_dir).select("id", F.posexplode(plan).alias("pos", "p")).select("id", "pos", "p.kind", "p.value", "p.placeholder")


@_query("""
SELECT c_custkey AS id, CAST(r AS INTEGER) AS round, CAST(1 AS INTEGER) AS detector_findings, CAST(0.5 AS DOUBLE) AS critic_agreement, r > c_custkey % 4 AS accepted, c_custkey % 4 < 3 AS converged
FROM customer, unnest(range(1, least(c_custkey % 4 + 1, 3) + 1)) AS t(r)
""")
def rounds_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each round of review says, where the reviewer gives in after none to three rounds."""
    k = F.col("c_custkey")

    def strict(rows: DataFrame) -> DataFrame:
        return rows.withColumn("critique", findings.agreed().withField("agreement", F.lit(0.5)).withField("accepted", F.col("round") > k % 4))

    rows = table(spark, sf_dir, "customer").select("c_custkey", F.format_string("mail c%d@shop.example", k).alias("text"))
    # outer: a filter inferred for a plain explode would be pushed through all rounds, its expression doubling in each
    told = reviewed(rows, Settings(salt=SALT, max_rounds=3), reviewer=strict).select(k.alias("id"), "converged", F.explode_outer("rounds").alias("r"))
    return told.select("id", "r.round", "r.detector_findings", "r.critic_agreement", "r.accepted", "converged")


# --- names ------------------------------------------------------------------------


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forms with a name label, an address and a line of their own, made of keys."""
    k = F.col("s_suppkey")
    first = F.get(F.array(*[F.lit(x) for x in ("Anna", "Bruno", "Chiara", "Data", "Émile")]), (k % 5).cast("int"))
    last = F.get(F.array(*[F.lit(x) for x in ("Rossi", "Bianchi", "Engineer", "Conti")]), (k % 4).cast("int"))
    return table(spark, sf_dir, "supplier").select(k.alias("id"), F.concat(F.lit("Name: "), first, F.lit("  "), last, F.lit("\nmail anna.verdi@x.example\n  "), last, F.lit(" "), first, F.lit("  \n")).alias("text"))


@_query("""
WITH f AS (SELECT s_suppkey AS id, ['Anna', 'Bruno', 'Chiara', 'Data', 'Émile'][s_suppkey % 5 + 1] AS a, ['Rossi', 'Bianchi', 'Engineer', 'Conti'][s_suppkey % 4 + 1] AS b FROM supplier)
SELECT id, a || ' ' || b AS value, CAST(0.9 AS DOUBLE) AS confidence FROM f WHERE a <> 'Émile'
UNION ALL SELECT id, 'anna verdi', 0.8 FROM f
UNION ALL SELECT id, b || ' ' || a, 0.7 FROM f WHERE a <> 'Émile' AND b <> 'Engineer'
""")
def names_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = F.array(F.struct(F.lit("EMAIL").alias("kind"), F.lit("").alias("value")))
    found = _forms(spark, sf_dir).select("id", F.explode(names.names(F.col("text"), some)).alias("f"))
    return found.select("id", "f.value", "f.confidence")


@_query("""
SELECT c_custkey AS id, upper(substring(v, 1, 3)) AS surname_letters, upper(substring(v, 4, 3)) AS name_letters
FROM (SELECT c_custkey, printf('rssmra%02da41f205z', c_custkey % 100) AS v FROM customer)
""")
def surname_hints(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.format_string("rssmra%02da41f205z", F.col("c_custkey") % 100)
    span = F.array(F.struct(F.lit("TAX_ID").alias("kind"), v.alias("value")), F.struct(F.lit("EMAIL").alias("kind"), F.lit("a@b.example").alias("value")))
    rows = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.explode(names.surname_hints(span)).alias("h"))
    return rows.select("id", "h.surname_letters", "h.name_letters")


@_query("""
SELECT s_suppkey AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'ADA BYRON' ELSE 'Ada Byron' END AS value, CAST(0.9 AS DOUBLE) AS confidence FROM supplier
UNION ALL SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 'Carlo Verdi Neri' ELSE 'Carlo Verdi' END, 0.7 FROM supplier
""")
def names_stopped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that are found twice, that begin another one, that are roles, and that hold stop words."""
    k = F.col("s_suppkey")
    first, second = (F.when(k % 3 == 0, a).otherwise(b) for a, b in (("ADA BYRON", "Ada Byron"), ("Ada  Byron", "ADA BYRON")))
    longer = F.when(k % 2 == 0, "\nCarlo Verdi Neri").otherwise("")
    whole = F.concat(F.lit("Name: "), first, F.lit("\nFull name: "), second, F.lit("\nName: IBM Italia\nHolder: Curriculum Vitae\nCarlo Verdi"), longer, F.lit("\nSenior Analyst\nWork Experience\n"))
    some = F.array(F.struct(F.lit("EMAIL").alias("kind"), F.lit("").alias("value")))
    rows = table(spark, sf_dir, "supplier").select(k.alias("id"), F.explode(names.names(whole, some)).alias("f"))
    return rows.select("id", "f.value", "f.confidence")


# --- files, answers, storage ------------------------------------------------------


def _zipped(parts: dict[str, str]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, body in parts.items():
            z.writestr(zipfile.ZipInfo(name), body)
    return out.getvalue()


_W, _S = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"', 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
_R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
_P = 'xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main"'
_T = 'xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"'
_DOCX = _zipped({"word/document.xml": f"<w:document {_W}><w:body><w:p><w:r><w:t>Hi </w:t></w:r><w:r><w:t>there</w:t></w:r></w:p><w:p/><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"})
_PPTX = _zipped({"ppt/presentation.xml": "<p/>", "ppt/slides/slide2.xml": f"<p:sld {_P}/>", "ppt/slides/slide1.xml": f"<p:sld {_P}><p:sp><a:p><a:t>One </a:t><a:t>two</a:t></a:p></p:sp></p:sld>"})
_ODT = _zipped({"content.xml": "<a><b>one</b>  <c>two</c></a>"})
_XLSX = _zipped({
    "xl/workbook.xml": f'<workbook {_S} {_R}><sheets><sheet name="One" r:id="r1"/></sheets></workbook>',
    "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>',
    "xl/sharedStrings.xml": f"<sst {_S}><si><t>a</t></si><si><t>yyy</t></si></sst>",
    "xl/worksheets/s.xml": f'<worksheet {_S}><row><c r="A1" t="s"><v>0</v></c><c r="B1" t="inlineStr"><is><t>b</t></is></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2"><v>22</v></c></row></worksheet>',
})
_ODS = _zipped({"content.xml": f'<x {_T}><table:table table:name="One"><table:table-row><table:table-cell><text:p>a</text:p></table:table-cell><table:table-cell><text:p>b</text:p></table:table-cell></table:table-row><table:table-row><table:table-cell><text:p>yyy</text:p></table:table-cell><table:table-cell><text:p>22</text:p></table:table-cell></table:table-row></table:table></x>'})
_SHEET = "## Sheet: One\nrows: 1, columns: 2\ncolumn names: a, b\n\n| a   | b  |\n|:----|:---|\n| yyy | 22 |"
_BLANK = "the file contains no readable text (it is empty or blank)"
#: Suffix and bytes of a file, and what comes of it: kind, text, method and error.
_FILES = (
    (".txt", "  héllo\n".encode(), "text", "héllo", "plain_text", None),
    (".csv", "wide ✓".encode("utf-16"), "text", "wide ✓", "plain_text", None),
    (".log", "café ".encode("latin-1"), "text", "café", "plain_text", None),
    (".md", b" \n\n", "text", "", "plain_text", _BLANK),
    ("", b"\0\1\2" * 50, None, None, None, "unsupported file type"),
    (".docx", _DOCX, "document", "Hi there\na | b", "docx_text", None),
    (".pptx", _PPTX, "document", "## Slide 1\nOne two\n## Slide 2", "pptx_text", None),
    (".odt", _ODT, "document", "one two", "office_xml_text", None),
    (".xlsx", _XLSX, "spreadsheet", _SHEET, "spreadsheet_tabular", None),
    (".ods", _ODS, "spreadsheet", _SHEET, "spreadsheet_tabular", None),
    *(("", magic + b"\0" * 99, "image", "\n".join(TRANSCRIPT), "mock", None) for magic in IMAGE_MAGIC),
)


def _value(x: str | None) -> str:
    return "CAST(NULL AS VARCHAR)" if x is None else _q(x)


_FILES_SQL = ", ".join(f"({i}, {', '.join(map(_value, f[2:]))})" for i, f in enumerate(_FILES))


@_query(f"SELECT c_custkey AS id, kind, text, method, error, CAST(length(text) AS BIGINT) AS char_count FROM customer JOIN (VALUES {_FILES_SQL}) AS f(i, kind, text, method, error) ON c_custkey % {len(_FILES)} = i")
def converted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in several encodings and containers, images, blank ones and ones of no known kind."""
    at = (F.col("c_custkey") % len(_FILES)).cast("int")
    of = lambda j: F.get(F.array(*[F.lit(f[j]) for f in _FILES]), at)
    files = table(spark, sf_dir, "customer").select(F.concat(F.lit("in/"), F.col("c_custkey"), of(0)).alias("path"), of(1).alias("content"), of(0).alias("suffix"))
    return converted(files).select(F.regexp_extract("filename", "^[0-9]+", 0).cast("long").alias("id"), "kind", "text", F.col("extraction_method").alias("method"), "error", "char_count")


_TRANSCRIPT_SQL = "replace(" + _q("\n".join(TRANSCRIPT)) + ", 'for 1 page', 'for ' || images || ' page')"


@_query(f"""
WITH f AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN c_name ELSE '' END AS own, c_custkey % 3 AS images, c_custkey % 5 AS k FROM customer),
r AS (
  SELECT 'vision_offline' AS run, *, CASE WHEN images > 0 AND own = '' THEN 'T' WHEN images > 0 THEN 'M' WHEN own <> '' THEN 'O' ELSE 'T' END AS way, false AS w1, false AS w2 FROM f
  UNION ALL SELECT 'vision_model', *, CASE WHEN images > 0 AND k = 0 THEN 'P' WHEN own <> '' THEN 'O' WHEN images > 0 AND k < 2 THEN 'B' ELSE 'N' END, images > 0 AND k >= 2, images > 0 AND k >= 2 AND own = '' FROM f
  UNION ALL SELECT 'vision_none', *, CASE WHEN own <> '' THEN 'O' ELSE 'N' END, images > 0, images > 0 AND own = '' FROM f
  UNION ALL SELECT 'text_model', *, CASE WHEN own <> '' THEN 'O' WHEN images > 0 AND k = 0 THEN 'P' WHEN images > 0 AND k = 1 THEN 'B' ELSE 'N' END, false, images > 0 AND k >= 2 AND own = '' FROM f
), t AS (SELECT *, CASE way WHEN 'T' THEN {_TRANSCRIPT_SQL} WHEN 'P' THEN 'p1' || chr(10) || chr(10) || 'é2' WHEN 'O' THEN own WHEN 'M' THEN own ELSE '' END AS text FROM r)
SELECT run, id, text, CASE WHEN way IN ('T', 'M') THEN 'mock' WHEN way IN ('P', 'B') THEN 'vision_llm' WHEN way = 'O' THEN 'plain_text' END AS method,
       CASE WHEN run = 'vision_offline' AND images > 0 THEN {_q(ingest.OFFLINE)} WHEN way = 'P' AND run = 'vision_model' THEN 'vision model=m, pages=2' WHEN way = 'O' THEN {_q(ingest.FELL_BACK)} ELSE '' END AS notes,
       concat_ws('; ', 'w', CASE WHEN w1 THEN CASE run WHEN 'vision_none' THEN {_q(ingest.NOT_SET)} ELSE {_q(ingest.FAILED + 'down')} END END, CASE WHEN w2 THEN {_q(ingest.FAILED_AGAIN)} || CASE run WHEN 'vision_none' THEN 'no vision model' ELSE 'down' END END, CASE WHEN way = 'N' THEN {_q(ingest.NOTHING)} END) AS warnings,
       CAST(length(text) AS BIGINT) AS char_count, CAST(CASE way WHEN 'P' THEN 2 ELSE 1 END AS INTEGER) AS page_count
FROM t
""")
def ingested_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with and without a text of their own and page images, whose pages a model reads, finds blank or fails on."""
    k = F.col("c_custkey")
    seen = F.when(k % 5 == 0, F.array(F.lit("p1 \n"), F.lit("é2"))).when(k % 5 == 1, F.array(F.lit(" ")))
    rows = table(spark, sf_dir, "customer").select(
        k.alias("doc_id"), F.when(k % 2 == 0, F.col("c_name")).alias("text"), (k % 3).cast("int").alias("page_images"), F.lit("plain_text").alias("extraction_method"), F.array(F.lit("w")).alias("warnings"), seen.alias("seen"),
        F.lit("down").alias("why"), F.lit("f").alias("filename"), F.lit("image").alias("kind"), F.lit("image/png").alias("mime_type"),
    )
    model = {"offline": False, "seen": "seen", "why": "why", "model": "m"}
    runs = {"vision_offline": {}, "vision_model": model, "vision_none": {"offline": False}, "text_model": model | {"strategy": "text_first"}}
    out = None
    for run, how in runs.items():
        one = ingest.ingested(rows, **how).select(F.lit(run).alias("run"), "text", ingest.summary().alias("s"))
        out = one if out is None else out.unionAll(one)
    return out.select("run", F.col("s.doc_id").alias("id"), "text", F.col("s.extraction_method").alias("method"), F.array_join("s.extraction_notes", "; ").alias("notes"), F.array_join("s.warnings", "; ").alias("warnings"), "s.char_count", "s.page_count")


@_query("""
SELECT c_custkey AS id, CAST(CASE c_custkey % 4 WHEN 2 THEN 2 WHEN 3 THEN 0 ELSE 1 END AS INTEGER) AS page_images,
       CASE c_custkey % 4 WHEN 0 THEN c_name || ' 1/1' WHEN 2 THEN c_name || ' 1/2;' || c_name || ' 2/2' WHEN 3 THEN '' END AS seen, CASE c_custkey % 4 WHEN 1 THEN 'ValueError: illegible' END AS why
FROM customer
""")
def seen_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of one page, one that can't be read, containers of two pages, and texts, read by a stand-in for a model."""

    def render(raw: bytes, kind: str) -> list[bytes]:
        return [raw] * (2 if kind == "pdf" else kind == "image")

    def model(pages: list[tuple[str, bytes]]) -> list[str]:
        if pages[0][1] == b"?":
            raise ValueError("illegible")
        return [f" {image.decode()} {prompt} " for prompt, image in pages]

    k = F.col("c_custkey") % 4
    files = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(k == 1, "?").otherwise(F.col("c_name")).cast("binary").alias("content"), F.when(k == 3, "text").when(k == 2, "pdf").otherwise("image").alias("kind"))
    rows = vision.read_by(vision.with_pages(files, render), model, "{page}/{total}", retries=0)
    return rows.select("id", "page_images", F.array_join("seen", ";").alias("seen"), "why")


@_query("SELECT 'a/' || c_custkey AS path, CASE WHEN c_custkey % 3 = 2 THEN c_mktsegment ELSE c_name END AS content FROM customer")
def opened_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encrypted files with the suffix, without it, and both, of which the first counts."""
    k = F.col("c_custkey")
    rows = vault.encrypted(vault.encrypted(table(spark, sf_dir, "customer"), "c_name", KEY, "a"), "c_mktsegment", KEY, "b")
    name = F.concat(F.lit("a/"), k)
    plain = rows.where(k % 3 != 1).select(name.alias("path"), F.col("a").cast("binary").alias("content"))
    sealed = rows.where(k % 3 != 0).select(F.concat(name, F.lit(".enc")).alias("path"), F.when(k % 3 == 2, F.col("b")).otherwise(F.col("a")).cast("binary").alias("content"))
    return vault.opened(plain.unionAll(sealed), KEY).select("path", F.col("content").cast("string").alias("content"))


@_query("SELECT event_id, event_type AS value, CAST(1.0 AS DOUBLE) AS confidence, '' AS context FROM events WHERE event_id % 3 < 2 UNION ALL SELECT event_id, 'Y', 0.75, 'c' FROM events WHERE event_id % 3 < 2")
def named_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names out of answers that call their list one thing or the other, and out of one without any."""
    k = F.col("event_id") % 3
    body = F.concat(F.lit('": [{"value": " '), F.col("event_type"), F.lit(' ", "confidence": 2}, {"value": " "}, 7, {"value": "Y", "confidence": "sure", "context": "c"}]}'))
    said = F.when(k < 2, F.concat(F.when(k == 0, '{"names').otherwise('{"findings'), body)).otherwise('{"names": "none"}')
    rows = table(spark, sf_dir, "events").select("event_id", F.explode(recovery.names_of(recovery.json_of(said))).alias("f"))
    return rows.select("event_id", "f.value", "f.confidence", "f.context")


@_query("""
SELECT event_id, CASE WHEN whole THEN CAST(0.25 AS DOUBLE) ELSE 0 END AS agreement, whole AS accepted, CASE WHEN whole THEN 'mail/' || event_type ELSE '' END AS missing,
       CASE WHEN whole THEN 'a,b' ELSE '' END AS false_positives, CASE WHEN whole THEN 'more' ELSE '' END AS feedback, CASE WHEN whole THEN 'x/PHONE' ELSE '' END AS wrong_kind
FROM (SELECT event_id, event_type, event_id % 2 = 0 AS whole FROM events)
""")
def critiques_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews out of answers that say all and nothing."""
    whole = F.concat(F.lit('{"agreement_score": 0.25, "accept": true, "missing": [{"kind": "mail", "value": "'), F.col("event_type"), F.lit('"}, 3], "false_positives": [{"value": "a"}, "b"], "feedback": ["more"], "wrong_kind": [{"value": "x", "correct_kind": "PHONE"}]}'))
    said = F.when(F.col("event_id") % 2 == 0, whole).otherwise('{"missing": "nothing"}')
    c = F.col("c")
    pairs = lambda a: F.array_join(F.transform(a, lambda m: F.concat(m["kind"], F.lit("/"), m["value"])), ",")
    wrong = F.array_join(F.transform(c["wrong_kind"], lambda w: F.concat(w["value"], F.lit("/"), w["kind"])), ",")
    rows = table(spark, sf_dir, "events").select("event_id", recovery.critique_of(said).alias("c"))
    return rows.select("event_id", "c.agreement", "c.accepted", pairs(c["missing"]).alias("missing"), F.array_join(c["false_positives"], ",").alias("false_positives"), F.array_join(c["feedback"], ",").alias("feedback"), wrong.alias("wrong_kind"))


@_query("SELECT c_custkey AS id, 'Round ' || c_custkey || ' of {{all}}: ' || c_name || ', ' || c_name AS prompt FROM customer")
def prompts_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = text.rendered(F.lit("Round {{n}} of {{all}}: {{name}}, {{name}}"), {"n": F.col("c_custkey"), "name": F.col("c_name")})
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), filled.alias("prompt"))


@_query("""
SELECT CAST(c_custkey AS VARCHAR) AS job_id, 'result' AS artifact, '{}' AS opened FROM customer
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'report', c_name FROM customer
UNION ALL SELECT CAST(c_custkey AS VARCHAR), 'cleaned_text', c_mktsegment FROM customer WHERE c_custkey % 2 = 1
""")
def artifacts_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is kept of each job, opened again; half of the jobs have no cleaned text."""
    k = F.col("c_custkey")
    jobs = table(spark, sf_dir, "customer").select(k.cast("string").alias("job_id"), F.when(k % 2 == 1, F.col("c_mktsegment")).otherwise("").alias("cleaned_text"), F.col("c_name").alias("report_md"), F.lit("{}").alias("result_json"), F.lit("2024-01-01").cast("timestamp").alias("created_at"))
    return vault.artifacts(jobs, KEY).select("job_id", "artifact", vault.decrypted(F.col("ciphertext"), KEY).cast("string").alias("opened"))


_SUFFIXES = ("", ".txt", ".xlsx", ".docx", ".png", ".bin", ".pdf", ".md")


@_query("""
SELECT page_id, CASE
  WHEN page_id % 3 = 1 THEN 'pdf'
  WHEN page_id % 3 = 0 THEN CASE page_id % 8 WHEN 2 THEN 'spreadsheet' WHEN 3 THEN 'document' ELSE 'text' END
  ELSE CASE page_id % 8 WHEN 2 THEN 'spreadsheet' WHEN 3 THEN 'document' WHEN 4 THEN 'image' WHEN 1 THEN 'text' WHEN 7 THEN 'text' END END AS kind
FROM pages
""")
def kinds_of_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as text files, as PDFs and as zip containers, with suffixes in turn."""
    body = F.encode(F.col("html"), "UTF-8")
    content = F.when(F.col("page_id") % 3 == 0, body).when(F.col("page_id") % 3 == 1, F.concat(F.lit(b"%PDF-1.7 obj "), body)).otherwise(F.concat(F.lit(b"PK\x03\x04\x00"), body))
    suffix = F.get(F.array(*[F.lit(s) for s in _SUFFIXES]), (F.col("page_id") % 8).cast("int"))
    return table(spark, sf_dir, "pages").select("page_id", kind_of_file(content, suffix).alias("kind"))


@_query("""
SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE event_type END AS value, CASE WHEN event_id % 5 = 4 THEN NULL WHEN event_id % 5 = 3 THEN 'OTHER' ELSE 'EMAIL' END AS kind
FROM events
""")
def answers_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings out of answers that are whole, fenced, in prose, a bare list, and hopeless."""
    one = F.concat(F.lit('{"value": "'), F.col("event_type"), F.lit('", "kind": "mail"},'))
    whole = F.concat(F.lit('{"findings": ['), one, F.lit("]}"))
    k = F.col("event_id") % 5
    said = F.when(k == 0, whole).when(k == 1, F.concat(F.lit("Here:\n```json\n"), whole, F.lit("\n```"))).when(k == 2, F.concat(F.lit("I found "), whole, F.lit(" there."))).when(k == 3, F.concat(F.lit('[{"text": "'), F.col("event_type"), F.lit('"}]'))).otherwise(F.lit("no idea"))
    rows = table(spark, sf_dir, "events").select("event_id", F.explode_outer(recovery.findings_of(recovery.json_of(said))).alias("f"))
    return rows.select("event_id", "f.value", "f.kind")


@_query("SELECT status, count(*) AS n FROM (SELECT CASE c_custkey % 3 WHEN 0 THEN 'skipped' WHEN 1 THEN 'migrated' ELSE 'failed' END AS status FROM customer) GROUP BY status")
def rotation_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names encrypted with the current key, an old one and a lost one, then rotated."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    k = F.col("c_custkey") % 3
    stored = rows
    for i, key in enumerate((KEY, OLD, OTHER)):
        stored = vault.encrypted(stored, "c_name", key, f"t{i}")
    stored = stored.select("c_custkey", F.when(k == 0, F.col("t0")).when(k == 1, F.col("t1")).otherwise(F.col("t2")).alias("ciphertext"))
    return vault.tally(vault.rotated(stored, KEY, [OLD]))


@_query("SELECT c_custkey, c_name AS opened, CAST(NULL AS VARCHAR) AS with_other_key FROM customer")
def vault_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is encrypted opens with its key and with no other."""
    rows = vault.encrypted(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_name", KEY, "t")
    return rows.select("c_custkey", vault.decrypted(F.col("t"), KEY).cast("string").alias("opened"), vault.decrypted(F.col("t"), OLD).cast("string").alias("with_other_key"))


@_query("SELECT event_id, ts FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 10080 MINUTE")
def retention_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the last week of the table."""
    events = table(spark, sf_dir, "events")
    last = events.agg(F.max("ts")).first()[0]
    return vault.unexpired(events.select("event_id", "ts"), 10080, "ts", F.lit(last))


@_query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def windows_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's tumbling counts, over the table as one batch."""
    from ..streaming.streams import counts

    return counts(table(spark, sf_dir, "events"))


# --- the whole way ----------------------------------------------------------------


def _list(words: tuple[str, ...]) -> str:
    return "[" + ", ".join(map(_q, words)) + "]"


_TOKENS = "list_transform(regexp_split_to_array({v}, '[ \\t]+'), lambda t: trim(t, '.,'))"
#: Where a run of letters, digits, _ and . begins; RE2 lacks the lookbehind for it.
_BEGIN = "\x01"
_LOCAL = _BEGIN + r"[A-Za-z]{2,}(?:[._][A-Za-z]{2,}|-" + _BEGIN + r"[A-Za-z]{2,})+@"
#: named (id, value, confidence): what functions.names finds, from kept and documents.
_NAMES_SQL = rf"""raw AS (
  SELECT doc_id AS id, doc_id IN (SELECT id FROM kept) AS has_spans,
         list_transform(regexp_extract_all(text, {_q(_re2(names.LABEL))}, 1), lambda v: trim(v, ' ' || chr(9) || '.|,')) AS labelled,
         list_transform(regexp_extract_all(regexp_replace(text, '([\p{{L}}\p{{N}}_.]+)', '{_BEGIN}\1', 'g'), {_q(_LOCAL)}), lambda v: translate(rtrim(replace(v, '{_BEGIN}', ''), '@'), '._-', '   ')) AS locals,
         regexp_extract_all(text, {_q(_re2(names.LINE))}, 1) AS lines
  FROM documents WHERE text IS NOT NULL
), sorted AS (
  SELECT id, list_concat(list_transform(labelled, lambda v: struct_pack(v := v, c := 0.9)), list_concat(list_transform(locals, lambda v: struct_pack(v := v, c := 0.8)),
    CASE WHEN has_spans THEN list_transform(list_filter(lines, lambda v: NOT list_has_any({_TOKENS.format(v='lower(v)')}, {_list(names.ROLES)}) AND len(list_filter(lines, lambda o: lower(o) <> lower(v) AND starts_with(lower(o), lower(v) || ' '))) = 0), lambda v: struct_pack(v := v, c := 0.7)) ELSE [] END)) AS all_of
  FROM raw
), each AS (
  SELECT id, i, regexp_replace(regexp_replace(all_of[i].v, '{_WS2}+', ' ', 'g'), '^ | $', '', 'g') AS value, CAST(all_of[i].c AS DOUBLE) AS confidence
  FROM (SELECT id, all_of, unnest(range(1, len(all_of) + 1)) AS i FROM sorted)
), fine AS (
  SELECT * FROM each WHERE value <> '' AND NOT list_contains({_list(names.STOP_PHRASES)}, lower(value)) AND NOT list_has_any(list_transform(string_split(lower(value), ' '), lambda t: trim(t, '.,')), {_list(names.STOP_TOKENS)})
), named AS (
  SELECT id, value, confidence FROM (SELECT *, row_number() OVER (PARTITION BY id, lower(value) ORDER BY i) AS r FROM fine) WHERE r = 1
)"""
#: What was found and stands in the text, the steps of masking, and a row out (doc_id, status, ..., cleaned_text, changes) for each document.
_WHOLE_SQL = f"""WITH RECURSIVE {_spans_sql(patterns.SCANNERS)}, {_NAMES_SQL},
found AS (SELECT f.* FROM (SELECT id, kind, value, confidence FROM kept UNION ALL SELECT id, 'PERSON', value, confidence FROM named) f JOIN documents ON doc_id = f.id AND contains(text, value)),
{_MASKED_SQL},
result AS (SELECT id, arg_max(text, i) AS cleaned_text, CAST(count(*) FILTER (WHERE n > 0) AS INTEGER) AS total_masked FROM masked GROUP BY id),
kinds AS (SELECT id, kind, CAST(sum(n) AS BIGINT) AS n FROM masked WHERE n > 0 GROUP BY id, kind),
base AS (SELECT *, CASE WHEN text IS NULL OR regexp_full_match(text, '{_WS2}*') THEN 'error' ELSE 'done' END AS status FROM documents)"""


@_query(f"""{_WHOLE_SQL}
SELECT b.doc_id, b.status, r.cleaned_text, r.total_masked,
       CAST((SELECT count(*) FROM plan p WHERE p.id = b.doc_id AND contains(r.cleaned_text, p.value)) AS INTEGER) AS leaked,
       coalesce((SELECT '[' || string_agg('{{"key":"' || kind || '","value":' || n || '}}', ',' ORDER BY kind) || ']' FROM kinds k WHERE k.id = b.doc_id), '[]') AS by_kind
FROM base b JOIN result r ON r.id = b.doc_id""")
def sanitise_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All scanners, names, one round of review and masking."""
    rows = sanitised(table(spark, sf_dir, "documents"), Settings(salt=SALT))
    return rows.select("doc_id", "status", "cleaned_text", "total_masked", "leaked", F.to_json(F.array_sort(F.map_entries("by_kind"))).alias("by_kind"))


@_query(f"""{_WHOLE_SQL},
shown AS (SELECT id, replace(kind, '|', '\\|') AS kind, replace(placeholder, '|', '\\|') AS placeholder, replace(CASE WHEN length(value) <= 4 THEN repeat('*', length(value)) ELSE left(value, 2) || repeat('*', length(value) - 4) || right(value, 2) END, '|', '\\|') AS original FROM masked WHERE n > 0)
SELECT b.doc_id, array_to_string(list_concat(
  ['# PII removal report', '', '- Job: `' || b.doc_id || '`', '- Status: ' || b.status, '- Source file: ' || coalesce(b.source, 'n/a'), '- Document kind: text', '- Extraction method: plain_text',
   '- Characters: ' || coalesce(CAST(b.n_chars AS VARCHAR), 'n/a'), '- Distinct values masked: ' || r.total_masked, '- Critic rounds: 1', '- Duration: 0 s', '', '## Masked categories', ''],
  list_concat(coalesce((SELECT list_concat(['| category | count |', '| --- | --- |'], list('| ' || kind || ' | ' || n || ' |' ORDER BY -n, kind)) FROM kinds k WHERE k.id = b.doc_id HAVING count(*) > 0), ['- none detected']),
  list_concat(['', '## Redaction table', '', 'Placeholders are stable per deployment: the same value always maps to the same', 'token, and the original cannot be recovered from it. Originals appear only as a', 'masked preview so this report stays safe to share.', ''],
  list_concat(coalesce((SELECT list_concat(['| redaction | type | original (masked) |', '| --- | --- | --- |'], list('| `' || placeholder || '` | ' || kind || ' | `' || original || '` |' ORDER BY kind, placeholder, original)) FROM shown s WHERE s.id = b.doc_id HAVING count(*) > 0), ['- none']),
  ['## Note', '', 'This report intentionally contains no original PII. The cleaned document is', 'stored encrypted at rest and is never written as plaintext by the application.'])))), chr(10)) AS report
FROM base b JOIN result r ON r.id = b.doc_id""")
def report_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = audited(sanitised(table(spark, sf_dir, "documents"), Settings(salt=SALT)).withColumn("__raw", F.col("changes")))
    report = audit.report(F.col("doc_id"), F.col("status"), F.col("source"), F.lit("text"), F.lit("plain_text"), F.col("n_chars"), F.size("rounds"), F.lit("0"), F.col("__raw"), F.col("by_kind"), F.array().cast("array<string>"))
    return rows.select("doc_id", report.alias("report"))


@_query(f"""{_WHOLE_SQL},
told AS (
  SELECT b.doc_id, CASE WHEN b.status = 'error' THEN [struct_pack(stage := 'error', status := 'failed', detail := 'extraction produced no text; the file may be empty, corrupt, or require a vision model')] ELSE [
    struct_pack(stage := 'ingest', status := 'done', detail := length(b.text) || ' chars'),
    struct_pack(stage := 'validators', status := 'done', detail := (SELECT count(*) FROM kept k WHERE k.id = b.doc_id) || ' span(s) confirmed by regex/checksum'),
    struct_pack(stage := 'detect', status := 'done', detail := '1 round(s)'), struct_pack(stage := 'critique', status := 'done', detail := 'accepted=true'),
    struct_pack(stage := 'converge', status := 'done', detail := 'detector and critic agree'),
    struct_pack(stage := 'mask', status := 'done', detail := (SELECT count(*) FROM plan p WHERE p.id = b.doc_id) || ' finding(s), ' || r.total_masked || ' distinct value(s) masked')] END AS t
  FROM base b JOIN result r ON r.id = b.doc_id
)
SELECT doc_id, CAST(seq AS INTEGER) AS seq, t[seq + 1].stage AS stage, t[seq + 1].status AS status, t[seq + 1].detail AS detail FROM (SELECT doc_id, t, unnest(range(0, len(t))) AS seq FROM told)""")
def trace_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trace(sanitised(table(spark, sf_dir, "documents"), Settings(salt=SALT)), "doc_id")


def entry(spark: SparkSession) -> DataFrame:
    """The flagship: documents with personal data masked; those without any stay in, unmasked."""
    return sanitise_documents(spark, "/root/testdata/sf0.001")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
