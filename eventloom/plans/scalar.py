"""Scalar functions over whole tables. Where Spark's own function already has the asked
meaning, it is used as it is; the library functions cover the rest."""

from __future__ import annotations

from pyspark.sql import functions as F

from eventloom.functions import conditional as cond
from eventloom.functions import datetimes as dt
from eventloom.functions import formats as fmt
from eventloom.functions import math as m
from eventloom.functions import strings as st
from eventloom.plans.registry import query, sql_query, table


def _over(name, tbl, oracle, **columns):
    """A projection: key columns by name, computed columns by alias."""
    @query(name, oracle)
    def run(spark, sf):
        cols = [F.col(k) if v is None else (v() if callable(v) else v).alias(k) for k, v in columns.items()]
        return table(spark, sf, tbl).select(*cols)


c = F.col

# --- math -------------------------------------------------------------------------------

_X = "c_acctbal / 1000"
sql_query("math_trigonometry", "customer", f"""SELECT c_custkey, round(sin({_X}), 9) AS sin, round(cos({_X}), 9) AS cos, round(tan({_X}), 6) AS tan,
round(cot({_X} + 0.00001), 4) AS cot, round(asin({_X} / 20), 9) AS asin, round(acos({_X} / 20), 9) AS acos, round(atan({_X}), 9) AS atan,
round(atan2({_X}, c_custkey + 1), 9) AS atan2, round(sinh({_X} / 5), 6) AS sinh, round(cosh({_X} / 5), 6) AS cosh, round(tanh({_X}), 9) AS tanh,
round(degrees({_X}), 6) AS degrees, round(radians(c_acctbal), 6) AS radians FROM customer""")
sql_query("math_exp_roots_powers", "customer", """SELECT c_custkey, round(exp(c_acctbal / 5000), 6) AS exp, round(sqrt(abs(c_acctbal)), 6) AS sqrt,
round(power(c_custkey, 1.5), 3) AS power, round(log10(c_custkey + 1), 9) AS log10, abs(c_acctbal) AS abs, round(pi(), 9) AS pi, 0 AS zero FROM customer""")
_over("math_ceiling_floor", "customer", "SELECT c_custkey, ceil(c_acctbal) AS up, floor(c_acctbal) AS down FROM customer",
      c_custkey=None, up=lambda: m.ceiling(c("c_acctbal")), down=lambda: m.floor(c("c_acctbal")))
_over("math_logarithms", "customer", """SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'NaN' ELSE CAST(round(ln(c_acctbal), 6) AS VARCHAR) END AS ln,
CASE WHEN c_acctbal < 0 THEN 'NaN' ELSE CAST(round(log10(c_acctbal), 6) AS VARCHAR) END AS log10 FROM customer WHERE c_acctbal <> 0""",
      c_custkey=None, ln=lambda: F.round(m.log(c("c_acctbal")), 6).cast("string"), log10=lambda: F.round(m.log(c("c_acctbal"), True), 6).cast("string"))
_over("math_mod", "customer", "SELECT c_custkey, CAST((c_custkey - 700) % 13 AS BIGINT) AS m FROM customer",
      c_custkey=None, m=lambda: m.mod(c("c_custkey") - 700, F.lit(13)))
_over("math_round_half_away", "lineitem", """SELECT l_orderkey, l_linenumber, l_partkey, CAST(sign(v) * floor(abs(v) + 0.5) AS DOUBLE) AS r,
sign(v) * floor(abs(v) * 10 + 0.5) / 10 AS r1 FROM (SELECT *, (l_quantity - 25) / 4 AS v FROM lineitem)""",
      l_orderkey=None, l_linenumber=None, l_partkey=None, r=lambda: m.round_half_away((c("l_quantity") - 25) / 4),
      r1=lambda: m.round_half_away((c("l_quantity") - 25) / 4, 1))
_MAGIC = """CASE WHEN length(t) < 16 OR t LIKE '%e%' OR length(t) - instr(t, '.') < 3 THEN x
WHEN t[-6:-4] = '000' THEN CAST(t[1:-4] || '0' AS DOUBLE) WHEN t[-6:-4] = '999' THEN CAST(t[1:-4] || '9999' AS DOUBLE) ELSE CAST(t[1:-3] AS DOUBLE) END"""
_over("math_roundmagic", "lineitem", f"""SELECT l_orderkey, l_partkey, v, w FROM (SELECT l_orderkey, l_partkey,
(SELECT {_MAGIC} FROM (SELECT l_discount + l_tax + 0.3::DOUBLE AS x, CAST(l_discount + l_tax + 0.3::DOUBLE AS VARCHAR) AS t)) AS v,
(SELECT {_MAGIC} FROM (SELECT l_quantity / 7 + 1 AS x, CAST(l_quantity / 7 + 1 AS VARCHAR) AS t)) AS w FROM lineitem)""",
      l_orderkey=None, l_partkey=None, v=lambda: m.round_magic(c("l_discount") + c("l_tax") + 0.3), w=lambda: m.round_magic(c("l_quantity") / 7 + 1))
_over("math_sign", "customer", "SELECT c_custkey, CAST(sign(c_acctbal) AS INTEGER) AS s FROM customer", c_custkey=None, s=lambda: m.sign(c("c_acctbal")))
_over("math_truncate", "customer", """SELECT c_custkey, trunc(c_acctbal) AS t, CASE WHEN c_acctbal < 0 THEN ceil(c_acctbal * 10.0::DOUBLE) ELSE floor(c_acctbal * 10.0::DOUBLE) END / 10.0::DOUBLE AS t1 FROM customer""",
      c_custkey=None, t=lambda: m.truncate(c("c_acctbal")), t1=lambda: m.truncate(c("c_acctbal"), 1))
_over("math_bits", "customer", """SELECT c_custkey, CAST(c_custkey & 12 AS BIGINT) AS a, CAST(c_custkey | 12 AS BIGINT) AS o, CAST(xor(c_custkey, 12) AS BIGINT) AS x,
(c_custkey >> 3) & 1 = 1 AS g FROM customer""",
      c_custkey=None, a=lambda: m.bit_and(c("c_custkey"), F.lit(12)), o=lambda: m.bit_or(c("c_custkey"), F.lit(12)),
      x=lambda: m.bit_xor(c("c_custkey"), F.lit(12)), g=lambda: m.bit_get(c("c_custkey"), 3))


@query("math_random", "SELECT CAST(count(*) AS BIGINT) AS n, true AS inside, CAST(count(*) AS BIGINT) AS uuids, true AS wide FROM customer")
def _(spark, sf):
    r = table(spark, sf, "customer").select(F.rand(7).alias("r"), F.uuid().alias("u"), m.random_bytes(20).alias("b"))
    return r.agg(F.count(F.lit(1)).alias("n"), F.bool_and((c("r") >= 0) & (c("r") < 1)).alias("inside"),
                 F.count_distinct("u").alias("uuids"), F.bool_and(F.length("b") == 20).alias("wide"))


_over("hash_sha256", "documents", "SELECT doc_id, upper(sha256(text)) AS once, upper(sha256(from_hex(sha256(text)))) AS twice FROM documents",
      doc_id=None, once=lambda: F.hex(m.sha256_hash(F.encode("text", "UTF-8"))), twice=lambda: F.hex(m.sha256_hash(F.encode("text", "UTF-8"), 2)))
_H = "list_reduce(list_prepend(0::BIGINT, list_transform(string_split(c_name, ''), lambda ch: ascii(ch)::BIGINT)), lambda a, b: (a * 31 + b) % 4294967296)"
_over("hash_of_text", "customer", f"""SELECT c_custkey, CAST(CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END AS INTEGER) AS h,
CAST((CASE WHEN h >= 2147483648 THEN h - 4294967296 ELSE h END) % 10 AS INTEGER) AS bucket FROM (SELECT c_custkey, {_H} AS h FROM customer)""",
      c_custkey=None, h=lambda: m.text_hash(c("c_name")), bucket=lambda: m.text_hash(c("c_name"), 10))


@query("encrypt_round_trip", "SELECT c_custkey, c_name, true AS hidden FROM customer")
def _(spark, sf):
    key = F.lit("0123456789abcdef")
    rows = table(spark, sf, "customer").withColumn("e", F.aes_encrypt("c_name", key))
    return rows.select("c_custkey", F.aes_decrypt("e", key).cast("string").alias("c_name"), (~F.contains(F.hex("e"), F.hex("c_name"))).alias("hidden"))


# --- text -------------------------------------------------------------------------------

_over("text_codes", "customer", """SELECT c_custkey, ascii(c_mktsegment) AS a, chr(CAST(65 + c_custkey % 900 AS INTEGER)) AS ch FROM customer""",
      c_custkey=None, a=lambda: st.ascii_code(c("c_mktsegment")), ch=lambda: st.char(65 + c("c_custkey") % 900))
_over("text_lengths", "documents", """SELECT doc_id, CAST(length(text) AS BIGINT) AS n, CAST(16 * length(text) AS BIGINT) AS bits, CAST(2 * length(text) AS BIGINT) AS bytes
FROM documents""", doc_id=None, n=lambda: st.char_length(c("text")), bits=lambda: st.bit_length(c("text")), bytes=lambda: st.octet_length(c("text")))
_BRAND = "nullif(p_brand, 'Brand#1')"
_over("text_concat_skips_null", "part", f"""SELECT p_partkey, concat(p_name, {_BRAND}, p_type) AS t, concat_ws('-', p_name, {_BRAND}, nullif(p_type, 'PROMO')) AS w FROM part""",
      p_partkey=None, t=lambda: st.concat(c("p_name"), F.nullif("p_brand", F.lit("Brand#1")), c("p_type")),
      w=lambda: st.concat_ws("-", c("p_name"), F.nullif("p_brand", F.lit("Brand#1")), F.when(c("p_type") == "PROMO", F.lit("")).otherwise(c("p_type"))))


def _soundex_sql(s):
    """Soundex by regular expressions over the letters of ``s``."""
    letters = f"regexp_replace({s}, '[^A-Za-z]', '', 'g')"
    # h and w do not separate equal codes: take them out first, keeping the first letter.
    bare = f"left({letters}, 1) || regexp_replace(substr({letters}, 2), '[hwHW]', '', 'g')"
    digits = f"translate(lower({bare}), 'abcdefghijklmnopqrstuvwxyz', '01230120022455012623010202')"
    for d in "123456":
        digits = f"regexp_replace({digits}, '{d}+', '{d}', 'g')"
    return f"CASE WHEN {letters} = '' THEN '0000' ELSE left({letters}, 1) || rpad(left(replace(substr({digits}, 2), '0', ''), 3), 3, '0') END"


_over("text_soundex", "part", f"SELECT p_partkey, {_soundex_sql('p_name')} AS s, {_soundex_sql('p_brand')} AS b FROM part",
      p_partkey=None, s=lambda: st.soundex(c("p_name")), b=lambda: st.soundex(c("p_brand")))
_A, _B = _soundex_sql("p_name"), _soundex_sql("p_type")
_over("text_difference", "part", "SELECT p_partkey, CAST(" + " + ".join(f"CAST(substr(a, {i}, 1) = substr(b, {i}, 1) AS INTEGER)" for i in range(1, 5))
      + f" AS INTEGER) AS d FROM (SELECT p_partkey, {_A} AS a, {_B} AS b FROM part)", p_partkey=None, d=lambda: st.difference(c("p_name"), c("p_type")))
_over("text_raw_hex", "part", """SELECT p_partkey, regexp_replace(lower(hex(p_name)), '(..)', '00\\1', 'g') AS h, p_name AS back FROM part""",
      p_partkey=None, h=lambda: st.raw_to_hex(c("p_name")), back=lambda: st.hex_to_raw(st.raw_to_hex(c("p_name"))))
_over("text_insert", "part", """SELECT p_partkey, CASE WHEN p_size % 9 < 1 OR p_size % 9 - 1 > length(p_name) THEN p_name
ELSE left(p_name, p_size % 9 - 1) || '<>' || substr(p_name, p_size % 9 + 3) END AS t FROM part""",
      p_partkey=None, t=lambda: st.insert(c("p_name"), c("p_size") % 9, 3, F.lit("<>")))
_over("text_case", "documents", "SELECT doc_id, lower(left(text, length(text))) AS lo FROM documents", doc_id=None, lo=lambda: F.lower(st.left(c("text"), F.length("text"))))
_over("text_left_right", "part", "SELECT p_partkey, left(p_name, greatest(p_size - 10, 0)) AS l, right(p_name, greatest(p_size - 10, 0)) AS r FROM part",
      p_partkey=None, l=lambda: st.left(c("p_name"), c("p_size") - 10), r=lambda: st.right(c("p_name"), c("p_size") - 10))
_over("text_locate", "part", """SELECT p_partkey, CAST(instr(p_name, 'e') AS INTEGER) AS f,
CAST(CASE WHEN instr(substr(p_name, 5), 'e') = 0 THEN 0 ELSE instr(substr(p_name, 5), 'e') + 4 END AS INTEGER) AS later,
CAST(CASE WHEN instr(reverse(left(p_name, length(p_name) - 2)), 'e') = 0 THEN 0 ELSE length(p_name) - 2 - instr(reverse(left(p_name, length(p_name) - 2)), 'e') + 1 END AS INTEGER) AS back,
CAST(instr(p_name, 'ing') AS INTEGER) AS p FROM part""",
      p_partkey=None, f=lambda: st.locate("e", c("p_name")), later=lambda: st.instr(c("p_name"), "e", 5),
      back=lambda: st.locate("e", c("p_name"), -3), p=lambda: st.position("ing", c("p_name")))
_over("text_trim", "part", """SELECT p_partkey, trim('  ' || p_name || ' ') AS t, ltrim('xx' || p_name, 'x') AS l, rtrim(p_name || 'yy', 'y') AS r,
trim(p_brand, 'B') AS b FROM part""",
      p_partkey=None, t=lambda: st.trim(F.concat(F.lit("  "), c("p_name"), F.lit(" "))), l=lambda: st.ltrim(F.concat(F.lit("xx"), c("p_name")), "x#"),
      r=lambda: st.rtrim(F.concat(c("p_name"), F.lit("yy")), "y"), b=lambda: st.trim(c("p_brand"), "Brand"))
_over("text_pad", "part", "SELECT p_partkey, lpad(p_name, 12, '*') AS l, rpad(p_name, 12, '-') AS r, lpad(p_name, 3, ' ') AS s FROM part",
      p_partkey=None, l=lambda: st.lpad(c("p_name"), 12, "*+"), r=lambda: st.rpad(c("p_name"), 12, "-="), s=lambda: st.lpad(c("p_name"), 3))
_over("text_repeat_space", "part", "SELECT p_partkey, repeat(p_type, greatest(p_size - 45, 0)) AS t, '[' || repeat(' ', p_size % 4) || ']' AS s FROM part",
      p_partkey=None, t=lambda: st.repeat(c("p_type"), c("p_size") - 45), s=lambda: F.concat(F.lit("["), st.space(c("p_size") % 4), F.lit("]")))
_over("text_replace", "documents", "SELECT doc_id, replace(text, 'the', 'THE') AS t, replace(lang, 'e', '') AS g, lang AS same FROM documents",
      doc_id=None, t=lambda: st.replace(c("text"), "the", "THE"), g=lambda: st.replace(c("lang"), "e"), same=lambda: st.replace(c("lang"), "", "x"))
_over("text_substring", "part", """SELECT p_partkey, substr(p_name, 3) AS a, substr(p_name, 1, 4) AS b, substr(p_name, greatest(length(p_name) - 3, 1), 2) AS n,
left(p_name, 3) AS far FROM part""",
      p_partkey=None, a=lambda: st.substring(c("p_name"), 3), b=lambda: st.substring(c("p_name"), 0, 4),
      n=lambda: st.substring(c("p_name"), -4, 2), far=lambda: st.substring(c("p_name"), -500, 3))
_over("text_regexp", "documents", """SELECT doc_id, regexp_replace(text, '[0-9]+', '#', 'g') AS r, regexp_replace(lang, 'E', 'x', 'gi') AS i,
regexp_matches(text, '[0-9]{3}') AS f, regexp_matches(text, 'THE', 'i') AS fi FROM documents""",
      doc_id=None, r=lambda: st.regexp_replace(c("text"), "[0-9]+", "#"), i=lambda: st.regexp_replace(c("lang"), "E", "x", "i"),
      f=lambda: st.regexp_like(c("text"), "[0-9]{3}"), fi=lambda: st.regexp_like(c("text"), "THE", "i"))
_over("text_translate", "part", "SELECT p_partkey, translate(p_name, 'aei', '43i') AS t FROM part", p_partkey=None, t=lambda: st.translate(c("p_name"), "aei", "43"))
_over("text_utf8", "documents", "SELECT doc_id, upper(hex(encode(lang))) AS h, text AS t FROM documents",
      doc_id=None, h=lambda: F.hex(st.utf8_bytes(c("lang"))), t=lambda: st.utf8_text(st.utf8_bytes(c("text"))))
_ESC = """replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '&apos;'), '"', '&quot;')"""
_over("xml_nodes", "part", f"""SELECT p_partkey, '<part name="' || {_ESC.format("p_name")} || '">' || {_ESC.format("p_brand || ' <&>'")} || '</part>' || chr(10) AS n,
'<empty/>' || chr(10) AS e, '<!-- ' || p_type || ' - - -->' || chr(10) AS c, '<![CDATA[' || p_name || ']]>' AS d, '<?xml version="1.0"?>' || chr(10) AS h FROM part""",
      p_partkey=None, n=lambda: st.xml_node("part", st.xml_attr("name", c("p_name")), st.xml_text(F.concat(c("p_brand"), F.lit(" <&>")))),
      e=lambda: st.xml_node("empty"), c=lambda: st.xml_comment(F.concat(c("p_type"), F.lit(" --"))), d=lambda: st.xml_cdata(c("p_name")), h=lambda: st.xml_start_doc())
_over("xml_text_of_documents", "documents", f"""SELECT doc_id, array_to_string(list_transform(string_split({_ESC.format("text")}, ''), lambda ch:
CASE WHEN unicode(ch) > 127 AND unicode(ch) < 65536 THEN '&#x' || lower(to_hex(unicode(ch))) || ';' ELSE ch END), '') AS t FROM documents""",
      doc_id=None, t=lambda: st.xml_text(c("text")))
_over("number_to_text", "customer", """SELECT c_custkey, lpad(CASE WHEN c_acctbal < 0 THEN '-' ELSE ' ' END || CASE WHEN abs(c_acctbal) < 1 THEN '' ELSE
format('{:,}', CAST(floor(abs(CAST(c_acctbal AS DECIMAL(12,2)))) AS BIGINT)) END || '.' || lpad(CAST(CAST(abs(CAST(c_acctbal AS DECIMAL(12,2))) * 100 AS BIGINT) % 100 AS VARCHAR), 2, '0'), 11, ' ') AS money,
lpad(CAST(c_custkey AS VARCHAR), 6, '0') AS zeros, lpad(upper(to_hex(c_custkey)), 7, ' ') AS hex FROM customer WHERE c_acctbal <> 0""",
      c_custkey=None, money=lambda: fmt.number_to_char(c("c_acctbal").cast("decimal(12,2)"), "999,999.99"),
      zeros=lambda: fmt.number_to_char(c("c_custkey"), "FM000000"), hex=lambda: fmt.number_to_char(c("c_custkey"), "XXXXXX"))
_over("number_to_signed_text", "customer", """SELECT c_custkey, lpad(CASE WHEN b < 0 THEN '-' ELSE '+' END || CAST(abs(b) AS VARCHAR), 7, ' ') AS s,
lpad(CAST(abs(b) AS VARCHAR) || CASE WHEN b < 0 THEN '-' ELSE ' ' END, 7, ' ') AS t,
CASE WHEN b < 0 THEN '<' || CAST(abs(b) AS VARCHAR) || '>' ELSE ' ' || CAST(abs(b) AS VARCHAR) || ' ' END AS p
FROM (SELECT c_custkey, CAST(round(CAST(c_acctbal AS DECIMAL(12,2)), 0) AS INTEGER) AS b FROM customer) WHERE b <> 0""",
      c_custkey=None, s=lambda: fmt.number_to_char(c("c_acctbal").cast("decimal(12,2)"), "S999999"),
      t=lambda: fmt.number_to_char(c("c_acctbal").cast("decimal(12,2)"), "999999MI"),
      p=lambda: F.regexp_replace(fmt.number_to_char(c("c_acctbal").cast("decimal(12,2)"), "999999PR"), "^ +(?=[ <])", ""))
_over("timestamp_to_text", "orders", """SELECT o_orderkey, upper(strftime(o_orderdate, '%d-%b-%Y')) AS d, strftime(o_orderdate, '%Y/%m/%d %H:%M:%S') AS t,
quarter(o_orderdate) || ' ' || dayofyear(o_orderdate) || ' ' || (dayofweek(o_orderdate) + 1) AS q, rpad(monthname(o_orderdate), 9, ' ') || '|' || dayname(o_orderdate) AS n FROM orders""",
      o_orderkey=None, d=lambda: fmt.timestamp_to_char(c("o_orderdate"), "DD-MON-YYYY"), t=lambda: fmt.timestamp_to_char(c("o_orderdate"), "YYYY/MM/DD HH24:MI:SS"),
      q=lambda: fmt.timestamp_to_char(c("o_orderdate"), "Q DDD D"), n=lambda: fmt.timestamp_to_char(c("o_orderdate"), 'Month"|"FMDay'))

# --- dates ------------------------------------------------------------------------------


@query("current_moments", "SELECT CAST(count(*) AS BIGINT) AS n, true AS same FROM nation")
def _(spark, sf):
    now = table(spark, sf, "nation").select(F.current_date().alias("d"), F.localtimestamp().alias("t"), F.call_function("current_time").cast("string").alias("c"))
    return now.agg(F.count(F.lit(1)).alias("n"), ((F.count_distinct("d", "t", "c") == 1) & F.bool_and(F.to_date("t") == c("d"))).alias("same"))


@query("current_timestamp_scale", "SELECT CAST(count(*) AS BIGINT) AS n, true AS whole, true AS hundredths, true AS near FROM nation")
def _(spark, sf):
    at = table(spark, sf, "nation").select(F.localtimestamp().alias("t"), dt.current_timestamp(0).alias("s"), dt.current_timestamp(2).alias("h"))
    micros = lambda x: F.extract(F.lit("SECOND"), c(x)) * 1000000
    return at.agg(F.count(F.lit(1)).alias("n"), F.bool_and(micros("s") % 1000000 == 0).alias("whole"), F.bool_and(micros("h") % 10000 == 0).alias("hundredths"),
                  F.bool_and((c("h") <= c("t")) & (c("s") <= c("h")) & (F.timestamp_diff("SECOND", c("s"), c("t")) < 1)).alias("near"))


_FRENCH = ["janvier", "février", "mars", "avril", "mai", "juin", "juillet", "août", "septembre", "octobre", "novembre", "décembre"]
_over("format_and_parse_in_locale_and_zone", "events", f"""SELECT event_id, strftime(ts, '%-d ') || {_FRENCH}[month(ts)] || strftime(ts, ' %Y') AS french,
strftime(ts + INTERVAL 9 HOUR, '%Y-%m-%d %H:%M') AS tokyo, date_trunc('day', ts)::TIMESTAMP AS parsed, date_trunc('minute', ts)::TIMESTAMP AS back FROM events""",
      event_id=None, french=lambda: dt.format_datetime(c("ts"), "d MMMM yyyy", "fr"), tokyo=lambda: dt.format_datetime(c("ts"), "yyyy-MM-dd HH:mm", zone="Asia/Tokyo"),
      parsed=lambda: dt.parse_datetime(dt.format_datetime(c("ts"), "d MMMM yyyy", "fr"), "d MMMM yyyy", "fr"),
      back=lambda: dt.parse_datetime(dt.format_datetime(c("ts"), "yyyy-MM-dd HH:mm", zone="Asia/Tokyo"), "yyyy-MM-dd HH:mm", zone="Asia/Tokyo"))
_over("text_truncated_to_precision", "part", "SELECT p_partkey, left(p_name, 5) AS a, left(p_type, 100) AS b, left(p_brand, 0) AS z FROM part",
      p_partkey=None, a=lambda: st.truncate_value(c("p_name"), 5), b=lambda: st.truncate_value(c("p_type"), 100), z=lambda: st.truncate_value(c("p_brand"), 0))
_over("date_add_parts", "events", """SELECT event_id, strftime(ts + INTERVAL 3 DAY, '%Y-%m-%d %H:%M:%S') AS d, strftime(ts + INTERVAL 14 MONTH, '%Y-%m-%d %H:%M:%S') AS m,
strftime(ts - INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M:%S') AS mi, strftime(ts + INTERVAL 21 DAY, '%Y-%m-%d') AS w, epoch_us(ts + INTERVAL 1500 MILLISECOND) AS ms,
strftime(ts + INTERVAL 2 YEAR, '%Y-%m-%d') AS y FROM events""",
      event_id=None, d=lambda: F.date_format(dt.dateadd("DAY", 3, c("ts")), "yyyy-MM-dd HH:mm:ss"), m=lambda: F.date_format(dt.dateadd("MONTH", 14, c("ts")), "yyyy-MM-dd HH:mm:ss"),
      mi=lambda: F.date_format(dt.dateadd("MI", -90, c("ts")), "yyyy-MM-dd HH:mm:ss"), w=lambda: F.date_format(dt.dateadd("WEEK", 3, c("ts")), "yyyy-MM-dd"),
      ms=lambda: F.timestamp_diff("MICROSECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), dt.dateadd("MS", 1500, c("ts"))),
      y=lambda: F.date_format(dt.dateadd("YEAR", 2, c("ts")), "yyyy-MM-dd"))
_PARTS = ("year", "month", "day", "hour", "minute", "second", "millisecond")
_T0 = "TIMESTAMP '2023-12-31 23:59:59.5'"
_over("date_diff_boundaries", "events", "SELECT event_id, " + ", ".join(f"datediff('{p}', {_T0}, ts) AS {p}_n" for p in _PARTS if p != "millisecond")
      + f", epoch_us(ts) // 1000 - epoch_us({_T0}) // 1000 AS millisecond_n FROM events",
      event_id=None, **{f"{p}_n": (lambda p=p: dt.datediff(p, F.to_timestamp_ntz(F.lit("2023-12-31 23:59:59.5")), c("ts"))) for p in _PARTS})
_over("date_diff_weeks", "events", f"""SELECT event_id, (e - base) // 604800000 AS w, (e - base) // 86400000 AS d FROM (SELECT event_id, epoch_us(ts) // 1000 AS e,
epoch_us(TIMESTAMP '2023-12-31 23:00:00') // 1000 AS base FROM events)""",
      event_id=None, w=lambda: dt.datediff("WEEK", F.to_timestamp_ntz(F.lit("2023-12-31 23:59:59.5")), c("ts")),
      d=lambda: dt.datediff("DOY", F.to_timestamp_ntz(F.lit("2023-12-31 23:59:59.5")), c("ts")))
_over("date_arithmetic", "events", """SELECT event_id, strftime(ts + INTERVAL 5 DAY, '%Y-%m-%d %H') AS a, strftime(ts - INTERVAL 1 DAY, '%Y-%m-%d %H') AS b,
strftime(ts + INTERVAL 36 HOUR, '%Y-%m-%d %H') AS f, strftime(ts + INTERVAL 90 MINUTE, '%Y-%m-%d %H:%M') AS t, datediff('day', TIMESTAMP '2024-01-01 12:00:00', ts) AS d FROM events""",
      event_id=None, a=lambda: F.date_format(dt.plus_days(c("ts"), 5), "yyyy-MM-dd HH"), b=lambda: F.date_format(dt.plus_days(c("ts"), -1), "yyyy-MM-dd HH"),
      f=lambda: F.date_format(dt.plus_days(c("ts"), 1.5), "yyyy-MM-dd HH"), t=lambda: F.date_format(dt.plus_time(c("ts"), 5_400_000), "yyyy-MM-dd HH:mm"), d=lambda: dt.minus_timestamps(c("ts"), F.to_timestamp_ntz(F.lit("2024-01-01 12:00:00"))))
sql_query("date_fields", "events", """SELECT event_id, year(ts) AS y, quarter(ts) AS q, month(ts) AS m, day(ts) AS d, dayofyear(ts) AS doy, dayofweek(ts) AS dow,
hour(ts) AS h, minute(ts) AS mi, second(ts) AS s FROM events""", """SELECT event_id, CAST(year(ts) AS INTEGER) AS y, CAST(quarter(ts) AS INTEGER) AS q, CAST(month(ts) AS INTEGER) AS m,
CAST(day(ts) AS INTEGER) AS d, CAST(dayofyear(ts) AS INTEGER) AS doy, CAST(dayofweek(ts) + 1 AS INTEGER) AS dow,
CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS mi, CAST(second(ts) AS INTEGER) AS s FROM events""")
_over("week_of_year_us", "orders", """SELECT o_orderkey, CAST(CASE WHEN sunday >= date_trunc('year', o_orderdate + INTERVAL 1 YEAR) - INTERVAL (dayofweek(date_trunc('year', o_orderdate + INTERVAL 1 YEAR))) DAY THEN 1
ELSE datediff('day', date_trunc('year', o_orderdate) - INTERVAL (dayofweek(date_trunc('year', o_orderdate))) DAY, sunday) // 7 + 1 END AS INTEGER) AS w
FROM (SELECT *, o_orderdate - INTERVAL (dayofweek(o_orderdate)) DAY AS sunday FROM orders)""", o_orderkey=None, w=lambda: dt.week_us(c("o_orderdate")))
_over("iso_week_fields", "orders", """SELECT o_orderkey, CAST(isoyear(o_orderdate) AS INTEGER) AS y, CAST(week(o_orderdate) AS INTEGER) AS w, CAST(isodow(o_orderdate) AS INTEGER) AS d FROM orders""",
      o_orderkey=None, y=lambda: dt.iso_year(c("o_orderdate")), w=lambda: dt.iso_week(c("o_orderdate")), d=lambda: dt.iso_day_of_week(c("o_orderdate")))
_over("day_and_month_names", "orders", "SELECT o_orderkey, dayname(o_orderdate) AS d, monthname(o_orderdate) AS m FROM orders",
      o_orderkey=None, d=lambda: dt.dayname(c("o_orderdate")), m=lambda: dt.monthname(c("o_orderdate")))
_over("extract_parts", "events", """SELECT event_id, CAST(extract(year FROM ts) AS INTEGER) AS y, CAST(extract(doy FROM ts) AS INTEGER) AS doy, CAST(extract(minute FROM ts) AS INTEGER) AS mi,
CAST(epoch_us(ts) // 1000 % 1000 AS INTEGER) AS ms FROM events""",
      event_id=None, y=lambda: dt.extract("YEAR", c("ts")), doy=lambda: dt.extract("DOY", c("ts")), mi=lambda: dt.extract("MINUTE", c("ts")), ms=lambda: dt.extract("MS", c("ts")))
_over("format_and_parse_datetime", "events", """SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M:%S') AS f, epoch_us(date_trunc('second', ts)) AS p FROM events""",
      event_id=None, f=lambda: dt.format_datetime(c("ts"), "yyyy/MM/dd HH:mm:ss"),
      p=lambda: dt.wall_ms(dt.parse_datetime(dt.format_datetime(c("ts"), "yyyy/MM/dd HH:mm:ss"), "yyyy/MM/dd HH:mm:ss")) * 1000)
_over("oracle_to_date", "orders", """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS a, strftime(o_orderdate, '%Y-%m-%d') AS b FROM orders""",
      o_orderkey=None, a=lambda: F.date_format(dt.to_date(fmt.timestamp_to_char(c("o_orderdate"), "DD-MON-YYYY"), "DD-MON-YYYY"), "yyyy-MM-dd"),
      b=lambda: F.date_format(dt.to_timestamp(F.date_format("o_orderdate", "MM/dd/yyyy HH:mm"), "MM/DD/YYYY HH24:MI"), "yyyy-MM-dd"))
_over("add_months", "orders", "SELECT o_orderkey, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%d %H:%M') AS a, strftime(o_orderdate - INTERVAL 13 MONTH, '%Y-%m-%d %H:%M') AS b FROM orders",
      o_orderkey=None, a=lambda: F.date_format(dt.add_months(c("o_orderdate"), 1), "yyyy-MM-dd HH:mm"), b=lambda: F.date_format(dt.add_months(c("o_orderdate"), -13), "yyyy-MM-dd HH:mm"))
_over("unix_time", "events", "SELECT event_id, CAST(epoch_us(ts) // 1000000 AS INTEGER) AS u, strftime(ts, '%Y-%m-%d %H:%M:%S') AS f, strftime(ts, '%d.%m.%y') AS g, strftime(ts, '%Y-%m-%d') AS d FROM events",
      event_id=None, u=lambda: dt.unix_timestamp(c("ts")), f=lambda: dt.from_unixtime(dt.unix_timestamp(c("ts"))), g=lambda: dt.from_unixtime(dt.unix_timestamp(c("ts")), "%d.%m.%y"),
      d=lambda: dt.mysql_date(c("ts").cast("string")))
_over("truncate_to_day", "events", "SELECT event_id, epoch_us(date_trunc('day', ts)::TIMESTAMP) // 1000 AS t FROM events", event_id=None, t=lambda: dt.wall_ms(dt.truncate_day(c("ts"))))

# --- conditional and arrays ---------------------------------------------------------------

_S = "nullif(p_size, 10)"
sql_query("coalesce_family", "part", f"SELECT p_partkey, coalesce({_S}, -1) AS c, ifnull({_S}, p_partkey) AS i, nullif(p_brand, 'Brand#2') AS n FROM part")
_over("nvl2_greatest_least", "part", f"SELECT p_partkey, CASE WHEN {_S} IS NOT NULL THEN 'set' ELSE 'none' END AS v, greatest({_S}, 25) AS g, least({_S}, 25, p_partkey) AS l FROM part",
      p_partkey=None, v=lambda: cond.nvl2(F.nullif("p_size", F.lit(10)), "set", "none"), g=lambda: F.greatest(F.nullif("p_size", F.lit(10)), F.lit(25)),
      l=lambda: F.least(F.nullif("p_size", F.lit(10)), F.lit(25), c("p_partkey")))
_W = "string_split(p_name, ' ')"
_over("array_functions", "part", f"""SELECT p_partkey, {_W}[1] AS first, {_W}[9] AS beyond, CAST(len({_W}) AS INTEGER) AS n,
list_contains({_W}, 'ring') AS has, array_to_string([p_brand, p_type], '+') AS lit FROM part""",
      p_partkey=None, first=lambda: cond.array_get(F.split("p_name", " "), 1), beyond=lambda: cond.array_get(F.split("p_name", " "), 9),
      n=lambda: cond.array_length(F.split("p_name", " ")), has=lambda: cond.array_contains(F.split("p_name", " "), "ring"),
      lit=lambda: F.array_join(F.array("p_brand", "p_type"), "+"))
