import hashlib
import re

from eventloom.llm.pii import find, op4_pii, redact

SF = "/root/testdata/sf0.01"
RULES = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def base(text):
    out = []
    for kind, rule in RULES.items():
        for m in re.finditer(rule, text or ""):
            d = re.sub(r"\D", "", m[0])
            if kind == "ip" and max(map(int, m[0].split("."))) > 255 or kind == "card" and not (13 <= len(d) <= 19 and luhn(d)) \
                    or kind == "phone" and not 9 <= len(d) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


def test_base_spans(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op4_pii(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.base_sha256 == hashlib.sha256(base(texts[r.doc_id]).encode()).hexdigest(), (texts[r.doc_id], r.spans)


def test_discovery_and_cases(spark):
    rows = [(i, f"call tel: +1 (171) 555-20{i:02d} now", 1) for i in range(20)]
    rows += [(50, "é tel: 0171 555 2028 \x01 x@y.z%w@k.m", 1), (51, "about 0171 555 2028 things", 1), (52, None, 1), (53, "", 1), (None, "1.2.3.4", 1),
             (54, "9" * 30_000 + " a@b.c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base int")
    got = {r.doc_id: r for r in redact(find(docs)).collect()}
    assert got[50].text == "é tel: [PHONE] \x01 [EMAIL][EMAIL]"
    assert got[51].text == rows[21][1] and got[52].text == "" and got[None].text == "[IP]"
    assert find(docs.limit(0)).count() == 0
