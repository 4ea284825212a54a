import hashlib
import random
import re

import pytest
from helpers import texts_of
from pyspark.sql import functions as F

from factlake.llm import queries, secrets
from factlake.llm.common import table

SF = "/root/testdata/sf0.001"
VALUE = r"[A-Za-z0-9+/_.=-]"
RULES = [
    (
        "assign",
        re.compile(
            rf"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?({VALUE}+)""",
            re.I | re.A,
        ),
        lambda m: len(m[2]) >= 8,
    ),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 32),
]


def base(text):
    found = [
        (m.start(), k, f"{kind}:{m.start()}:{m.end()}")
        for k, (kind, rule, enough) in enumerate(RULES)
        for m in rule.finditer(text)
        if enough(m)
    ]
    return [written for _, _, written in sorted(found)]


PARTS = (
    "password PassWd secret token api_key apikey AKIA ABCDEF0123456789 abc 0123456789abcdef deadbeef "
    "é xxxxxxx yyyyyyyyy _ ="
).split() + [" ", ":", "=", '"', "'", "\n", "  "]


def test_spans_equal_the_expressions():
    scanner = secrets.Scanner()
    rnd = random.Random(1)
    for _ in range(4000):
        text = "".join(rnd.choices(PARTS, k=rnd.randint(0, 14)))
        data = text.encode()
        spans = [x for x in scanner.spans(data) if x[1] < 3]
        at = secrets._code_points(data, [p for s, _, e in spans for p in (s, e)])
        got = [f"{scanner.rules[k].kind}:{at[s]}:{at[e]}" for s, k, e in spans]
        assert got == base(text), text


@pytest.mark.parametrize("which", ["odd", "given"])
def test_query(spark, odd, none, which, tmp_path):
    docs = odd if which == "odd" else table(spark, SF, "documents")
    docs.select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op8_secrets(spark, str(tmp_path)).collect()
    want = []
    for doc_id, text in texts_of(docs):
        found = base(text)
        n = [sum(x.startswith(kind + ":") for x in found) for kind, _, _ in RULES]
        want.append((doc_id, *n, hashlib.sha256(",".join(found).encode()).hexdigest()))
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    for row in got:
        spans = row["spans"].split(",")
        kept = [x for x in spans if x.split(":")[0] in secrets.BASE_KINDS]
        assert hashlib.sha256(",".join(kept).encode()).hexdigest() == row["base_sha256"]
    assert none.select(secrets.secret_spans(F.col("text"))).collect() == []


def test_more_kinds_and_masks(spark):
    text = (
        "a ghp_" + "a1B2" * 9 + " b -----BEGIN RSA PRIVATE KEY----- c eyJabc.eyJdef.signature_1 "
        "d xoxb-1234567890ab é token=abcdefgh" + "0" * 40
    )
    df = spark.createDataFrame([(text,), (None,), ("clean",)], "text string")
    kinds = {x["kind"] for x in df.select(secrets.secret_spans(F.col("text"))).first()[0]}
    assert kinds == {"github", "private", "jwt", "slack", "assign", "hex"}
    masked = [r[0] for r in df.select(secrets.redacted(F.col("text"))).collect()]
    assert masked[1:] == [None, "clean"]
    assert masked[0] == "a [secret] b [secret] c [secret] d [secret] é [secret]"


BEGIN, END = "-----BEGIN RSA PRIVATE KEY-----", "-----END RSA PRIVATE KEY-----"
BODY = ["MIIEowIBAAKCAQEAx+/b" + "aB3/" * 11, "Zk9+" * 16, "q0Jx9w=="]
FIELDS = ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,3F17F5316E2BAC89", ""]


def test_mask_covers_a_whole_key(spark):
    cases = [("plain", f"x {BEGIN}\nand prose", "x [secret]\nand prose")]
    for end in ("\n", "\r\n", "\\n", "\n    ", " "):
        for fields in ([], FIELDS):
            key = end.join([BEGIN, *fields, *BODY, END])
            cases.append((repr(end), f"é {key}\nafter {key} {{}}", "é [secret]\nafter [secret] {}"))
            # Cut off before the END line.
            if end != " ":
                key = end.join([BEGIN, *fields, *BODY])
                cases.append((repr(end), f"{key}\n\n(after)", "[secret]\n\n(after)"))
    df = spark.createDataFrame(cases, "name string, text string, want string").coalesce(1)
    for row in df.withColumn("got", secrets.redacted(F.col("text"))).collect():
        assert row["got"] == row["want"], row["name"]


def test_minimal_automaton_is_as_small_as_its_language():
    scanner = secrets.Scanner((secrets.Rule("two", "", "[ab]", 2, sure=2),))
    assert len(scanner.marks.step) == 3
