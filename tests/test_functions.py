"""One assertion per function whose result differs from Spark's own of the same name."""

from datetime import date, datetime

import math

import pytest
from pyspark.sql import functions as F

from eventloom.functions import conditional as cond
from eventloom.functions import datetimes as dt
from eventloom.functions import formats as fmt
from eventloom.functions import math as m
from eventloom.functions import strings as st
from eventloom.functions import user


@pytest.fixture(scope="module")
def val(spark):
    one = spark.range(1)
    return lambda c: one.select(c.alias("v")).first().v


lit = F.lit
none = lambda t="string": F.lit(None).cast(t)


def test_math(val):
    assert val(m.ceiling(lit(1.2))) == 2.0 and isinstance(val(m.floor(lit(-1.2))), float)
    assert math.isnan(val(m.ln(lit(-1.0)))) and val(m.ln(lit(0.0))) == -math.inf and val(m.ln(none("double"))) is None
    assert val(m.log(lit(100.0), base10=True)) == pytest.approx(2)
    assert val(m.mod(lit(-7), lit(3))) == -1
    assert val(m.round_half_away(lit(-2.5))) == -3.0 and val(m.round_half_away(lit(1.25), 1)) == 1.3
    assert val(m.round_magic(lit(0.1) + lit(0.2).cast("double"))) == 0.3 and val(m.round_magic(lit(1e-14))) == 0.0
    assert val(m.sign(lit(-3.5))) == -1
    assert val(m.truncate(lit(-1.79), 1)) == -1.7 and val(m.truncate(lit(179.0), -1)) == 170.0
    assert val(m.bit_get(lit(5), 2)) is True and val(m.bit_xor(lit(6), lit(3))) == 5
    assert len(val(m.random_bytes(33))) == 33
    assert val(m.text_hash(lit("hello world"))) == 1794106052 and val(m.text_hash(lit(""))) == 0
    assert val(m.text_hash(lit("polygenelubricants"))) == -2147483648
    with pytest.raises(Exception):
        val(m.mod(lit(1), lit(0)))


def test_text(val):
    assert val(st.ascii_code(lit(""))) is None and val(st.ascii_code(lit("A"))) == 65
    assert val(st.char(lit(300))) == "Ĭ"
    assert val(st.char_length(lit("a\U0001f600"))) == 3 and val(st.bit_length(lit("ab"))) == 32 and val(st.octet_length(lit("é"))) == 2
    assert val(st.concat(lit("a"), none(), lit("b"))) == "ab" and val(st.concat(none(), none())) is None
    assert val(st.concat_ws("-", lit("a"), none(), lit(""), lit("b"))) == "a-b" and val(st.concat_ws("-", none(), none())) == ""
    assert val(st.concat_ws(lit("+"), lit("a"), lit("b"))) == "a+b"
    assert val(st.soundex(lit("tymczak"))) == "t522" and val(st.soundex(lit(""))) == "0000" and val(st.soundex(lit("12"))) == "0000"
    assert val(st.difference(lit("Smith"), lit("Smyth"))) == 4
    assert val(st.raw_to_hex(lit("aé"))) == "006100e9" and val(st.hex_to_raw(lit("006100e9"))) == "aé"
    assert val(st.insert(lit("hello"), 2, 3, lit("X"))) == "hXo" and val(st.insert(lit("hello"), 0, 3, lit("X"))) == "hello"
    assert val(st.insert(none(), 1, 1, lit("X"))) == "X" and val(st.insert(lit("a"), 1, 1, none())) == "a"
    assert val(st.left(lit("abc"), -1)) == "" and val(st.right(lit("abc"), 9)) == "abc"
    assert val(st.locate("b", lit("abcb"), -1)) == 4 and val(st.locate("b", lit("abcb"), -2)) == 2 and val(st.locate("b", lit("abcb"), 3)) == 4
    assert val(st.locate("x", lit("abc"), -9)) == 0
    assert val(st.trim(lit("xyabcyx"), "xy")) == "yabcy" and val(st.lpad(lit("7"), 3, "0z")) == "007" and val(st.rpad(lit("abc"), 2)) == "ab"
    assert val(st.repeat(lit("a"), -1)) == "" and val(st.space(2)) == "  " and val(st.replace(lit("aba"), "", "x")) == "aba"
    assert val(st.substring(lit("abc"), -5, 3)) == "abc" and val(st.substring(lit("abc"), 0)) == "abc" and val(st.substring(lit("abc"), -2, 1)) == "b"
    assert val(st.regexp_replace(lit("Abab"), "a", "x", "i")) == "xbxb" and val(st.regexp_like(lit("a\nb"), "a.b", "n")) is True
    assert val(st.translate(lit("abcd"), "abc", "12")) == "12cd"
    with pytest.raises(ValueError):
        st.regexp_like(lit("a"), "a", "q")


def test_xml(val):
    assert val(st.xml_text(lit("<a&'\"é\n"))) == "&lt;a&amp;&apos;&quot;&#xe9;\n"
    assert val(st.xml_text(lit("a\nb"), escape_newline=True)) == "a&#xa;b"
    assert val(st.xml_node("a", None, lit("x\ny"))) == "<a>\n    x\n    y\n</a>\n"
    assert val(st.xml_node("a", st.xml_attr("k", lit("<")), none())) == '<a k="&lt;"/>\n'
    assert val(st.xml_comment(lit("a--b---"))) == "<!-- a- -b- - - -->\n"
    assert val(st.xml_cdata(lit("x"))) == "<![CDATA[x]]>" and val(st.xml_cdata(lit("]]>"))) == "]]&gt;"


def test_number_format(val):
    n = lambda x, f: val(fmt.number_to_char(lit(x).cast("decimal(18,4)"), f))
    assert n("1234.567", "9,999.99") == " 1,234.57" and n("-12", "9999") == "  -12" and n("12", "0000") == " 0012"
    assert n("0.5", "9.99") == "  .50"[-5:] and n("12345", "999") == "####" and n("7", "FM990") == "7"
    assert n("5", "S99") == " +5" and n("-5", "99S") == " 5-" and n("-5", "99MI") == " 5-" and n("-5", "99PR") == "<5>"
    assert n("4", "RN") == "             IV" and n("1994", "FMrn") == "mcmxciv" and n("255", "XXXX") == "   FF" and n("255", "FMxx") == "ff"
    assert val(fmt.number_to_char(lit("0.25").cast("decimal(9,2)"))) == ".25"
    with pytest.raises(ValueError):
        n("1", "9Q9")


def test_timestamp_format(val):
    t = F.to_timestamp_ntz(lit("2024-03-09 15:04:05.678"))
    c = lambda f: val(fmt.timestamp_to_char(t, f))
    assert c("DD-MON-YYYY HH24:MI:SS.FF3") == "09-MAR-2024 15:04:05.678" and c("Dy, fmMonth") == "Sat, March"
    assert c("YY Y,YYY RM Q J") == "24 2,024 III 1 2460379" and c("HH:MI PM") == "03:04 PM" and c('"at" SSSSS') == "at 54245"
    with pytest.raises(ValueError):
        c("bogus")


def test_dates(val):
    ts = lambda s: F.to_timestamp_ntz(lit(s))
    assert val(dt.datediff("YEAR", ts("2004-12-31 00:00:00"), ts("2005-01-01 00:00:00"))) == 1
    assert val(dt.datediff("HOUR", ts("2005-01-01 00:59:59"), ts("2005-01-01 01:00:00"))) == 1
    assert val(dt.datediff("WEEK", ts("2005-01-01 00:00:00"), ts("2005-01-07 23:59:59"))) == 0
    assert val(dt.datediff("MONTH", ts("2005-01-31 00:00:00"), ts("2004-11-01 00:00:00"))) == -2
    assert val(dt.add_months(ts("2020-01-31 10:00:00"), 1)) == datetime(2020, 2, 29, 10)
    assert val(dt.dateadd("DY", 1, ts("2020-02-28 00:00:00"))) == datetime(2020, 2, 29)
    assert val(dt.plus_days(ts("2020-01-01 00:00:00"), 0.5)) == datetime(2020, 1, 1, 12)
    assert val(dt.plus_time(ts("2020-01-01 23:00:00"), 5_400_000)) == datetime(2020, 1, 2, 0, 30) and val(st.truncate_value(lit("abc"), 2)) == "ab"
    assert val(dt.week_us(lit(date(2021, 1, 2)))) == 1 and val(dt.week_us(lit(date(2021, 1, 3)))) == 2 and val(dt.week_us(lit(date(2021, 12, 26)))) == 1
    assert val(dt.iso_year(lit(date(2021, 1, 1)))) == 2020 and val(dt.iso_day_of_week(lit(date(2021, 1, 1)))) == 5
    assert val(dt.to_timestamp(lit("09-MAR-2024 03:04 PM"), "DD-MON-YYYY HH:MI AM")) == datetime(2024, 3, 9, 15, 4)
    assert val(dt.from_unixtime(lit(86399), "%H.%i %Y")) == "23.59 1970" and val(dt.mysql_date(lit("2024-01-01 10:00"))) == "2024-01-01"
    assert val(dt.wall_ms(ts("1969-12-31 23:59:59.9995"))) == -1
    with pytest.raises(ValueError):
        dt.datediff("FORTNIGHT", ts("2005-01-01 00:00:00"), ts("2005-01-01 00:00:00"))


def test_conditional_and_arrays(val):
    a = F.array(lit(1), none("int"), lit(3))
    assert val(cond.decode(none("int"), None, "n", 1, "one")) == "n" and val(cond.decode(lit(5), 1, "one")) is None
    assert val(cond.is_in(none("int"), [])) is False and val(cond.nvl2(none(), "a", "b")) == "b"
    assert val(cond.array_get(a, 9)) is None and val(cond.array_get(a, 0)) is None and val(cond.array_get(a, 3)) == 3 and val(cond.subscript(a, 0)) == 1
    assert val(cond.array_contains(a, 9)) is False and val(cond.array_length(a)) == 3
    assert val(cond.row_in([lit(1), lit("a")], [(2, "a"), (1, "a")])) is True


def test_user_functions(spark):
    user.register(spark)
    assert [r.p for r in spark.range(8).selectExpr("is_prime(cast(id as int)) p").collect()] == [False, False, True, True, False, True, False, True]
    assert spark.sql("SELECT * FROM matrix(3)").count() == 9
    df = spark.createDataFrame([("a", 2.0), ("a", 8.0), ("a", None), (None, 5.0)], "k string, v double")
    got = {r.k: r.result for r in user.aggregate_by(df, ["k"], "v", user.GEOMETRIC_MEAN).collect()}
    assert got["a"] == pytest.approx(4.0) and got[None] == pytest.approx(5.0)


# --- user functions, noise of fractions, locales ------------------------------------------------

def test_overloads_null_rule_and_flag(spark):
    f = user.register_function(spark, "joined", {1: lambda a: a.astype(str), -1: lambda *c: c[0].astype(str) + "/" + str(len(c))}, "string")
    seen = user.register_function(spark, "seen", {1: lambda a: a.isna()}, "boolean", null_on_null=False, deterministic=False)
    assert f.deterministic and not seen.deterministic
    row = spark.sql("SELECT joined(1) a, joined(2, 3, 4) b, joined(2, CAST(NULL AS INT)) c, seen(CAST(NULL AS INT)) d FROM range(1)").first()
    assert tuple(row) == ("1", "2/3", None, True)
    user.register_function(spark, "only_one", {1: lambda a: a}, "int")
    with pytest.raises(Exception, match="does not take 2"):
        spark.sql("SELECT only_one(1, 2)").collect()


def test_typed_fold_merges_in_rounds(spark):
    rows = [(k, f"n{i:03}", float(i % 40)) for k in (1, None) for i in range(200)] + [(1, None, 99.0), (2, "x", None), (3, "only", 1.0)]
    df = spark.createDataFrame(rows, "k int, p_name string, p_retailprice double").repartition(16)
    got = user.fold_by(df, ["k"], ["p_name", "p_retailprice"], user.DEAREST, "best", "string", fan_in=2).collect()
    assert sorted(map(tuple, got), key=repr) == [(1, "n039/200"), (3, "only/1"), (None, "n039/200")]


def test_table_function_columns_follow_the_argument(spark):
    user.register(spark)
    spark.createDataFrame([(1, "a", 3), (1, "b", 1), (1, "a", 2), (2, "c", 1)], "k int, l string, o int").createOrReplaceTempView("tf")
    out = spark.sql("SELECT * FROM label_counts(TABLE(tf) PARTITION BY (k), 'a,z')")
    assert out.columns == ["key", "a", "z"] and sorted(map(tuple, out.collect())) == [(1, 2, 0), (2, 0, 0)]
    steps = spark.sql("SELECT * FROM label_steps(TABLE(tf) PARTITION BY (k) ORDER BY (o))").collect()
    assert sorted(map(tuple, steps)) == [(1, "a", "a"), (1, "b", "a")]


def test_round_magic_by_definition(spark):
    given = [0.1 + 0.2, 0.12345678901234567, 2.9999999999999996, 1e-14, 1e13 + 0.1, 1.5, 1.1 * 3, -0.30000000000000004]
    want = [0.3, 0.123456789012345, 2.9999999999999996, 0.0, 1e13 + 0.1, 1.5, 3.3, -0.3]
    got = [r.v for r in spark.createDataFrame([(g,) for g in given], "x double").select(m.round_magic(F.col("x")).alias("v")).collect()]
    assert all(a == b or abs(a - b) < 1e-15 for a, b in zip(got, want)), got


def test_locale_and_zone(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-05 22:00:00' t UNION ALL SELECT NULL")
    got = df.select(dt.format_datetime(F.col("t"), "EEEE d MMMM", "de").alias("a"), dt.format_datetime(F.col("t"), "dd HH", zone="+05:00").alias("b")).collect()
    assert sorted(map(tuple, got), key=repr) == [("Dienstag 5 März", "06 03"), (None, None)]
    assert df.select(dt.parse_datetime(F.lit("5 mars 2024"), "d MMMM yyyy", "fr").cast("string")).first()[0] == "2024-03-05 00:00:00"
    assert df.select((F.extract(F.lit("SECOND"), dt.current_timestamp(0)) % 1 == 0)).first()[0]
