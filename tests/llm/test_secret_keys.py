"""Redaction leaves nothing of a planted key."""
import base64
import random

import pytest

from pagelens.llm import secret_scan
from tests.llm.test_operators import brute_spans

_RNG = random.Random(9)


def key(n, width=64):
    b = base64.b64encode(bytes(_RNG.randrange(256) for _ in range(n))).decode()
    return [b[i:i + width] for i in range(0, len(b), width)]


def pem(kind, lines, end=True, sep="\n", head=()):
    return sep.join([f"-----BEGIN {kind}-----", *head, *lines, *([f"-----END {kind}-----"] if end else [])])


BODY, LONG = key(600), key(9000)
PGP = ["Version: GnuPG v2", "Comment: a-b-c", ""]
PEM = ["Proc-Type: 4,ENCRYPTED", "DEK-Info: AES-128-CBC,0123456789ABCDEF", ""]
#: text, its secret parts, and what must stay
PLANTED = [
    ("before\n" + pem("RSA PRIVATE KEY", BODY) + "\nafter words", BODY, ("before\n", "\nafter words")),
    ("before " + pem("PRIVATE KEY", LONG, sep="\r\n") + " after", LONG, ("before ", " after")),
    ("x: " + pem("ENCRYPTED PRIVATE KEY", BODY) + "\ny: 1", BODY, ("x: ", "\ny: 1")),
    (pem("RSA PRIVATE KEY", BODY, head=PEM) + "\nend", BODY + PEM[:2], ("\nend",)),
    (pem("PGP PRIVATE KEY BLOCK", BODY + ["=aB3d"], head=PGP) + "\nend", BODY + PGP[:2], ("\nend",)),
    ('{"private_key": "' + pem("PRIVATE KEY", BODY, sep="\\n") + '\\n", "id": 1}', BODY, ('{"private_key": "', '", "id": 1}')),
    ("key: |\n" + pem("OPENSSH PRIVATE KEY", BODY, sep="\n    ") + "\nnext: é", BODY, ("key: |\n", "\nnext: é")),
    ('s = "' + pem("EC PRIVATE KEY", BODY, sep='" +\n  "') + '";', BODY, ('s = "', '";')),
    ("cut " + pem("RSA PRIVATE KEY", BODY, end=False), BODY, ("cut ",)),
    ("cut " + pem("RSA PRIVATE KEY", BODY, end=False, head=PEM), BODY + PEM[:2], ("cut ",)),
    ("cut " + pem("RSA PRIVATE KEY", BODY[:-1], end=False, sep="\n  ") + "\n\nplain words after it.", BODY[:-1], ("cut ", " words after it.")),
    ("The line -----BEGIN PRIVATE KEY----- starts a key file, so look for it.", [], ("The line ", " starts a key file, so look for it.")),
    (pem("PRIVATE KEY", BODY) + "\nbetween\n" + pem("RSA PRIVATE KEY", LONG), BODY + LONG, ("\nbetween\n",)),
    ("Authorization: Bearer " + "aZ9" * 400 + " ok", ["aZ9aZ9"], ("Authorization: ", " ok")),
    ("url https://user:" + "p4" * 200 + "@host.org/x", ["p4p4"], ("url ", "host.org/x")),
    ("url https://" + "u5" * 200 + ":pw77@host.org/x", ["pw77"], ("url ", "host.org/x")),
    ("url redis://:pw77@host:6379/0", ["pw77"], ("url ", "host:6379/0")),
    ("AccountKey=" + "Q" * 150 + "== .", ["QQ"], (" .",)),
    ("ghp_" + "b" * 300 + " .", ["bb"], (" .",)),
]


@pytest.fixture(scope="module")
def planted(spark):
    return spark.createDataFrame([(i, p[0]) for i, p in enumerate(PLANTED)], "doc_id long, text string")


def test_redaction_leaves_nothing_of_a_key(planted):
    rows = secret_scan.redact(planted).collect()
    assert len(rows) == len(PLANTED)
    for r in rows:
        text, secrets, stays = PLANTED[r["doc_id"]]
        assert not [s for s in secrets if s in r["text"]], r["text"]
        assert "PRIVATE KEY" not in r["text"] and "[SECRET]" in r["text"]
        assert all(s in r["text"] for s in stays), r["text"]


def test_spans_of_keys_match_brute_force(planted):
    for r in secret_scan.scan(planted).collect():
        assert [tuple(s) for s in r["spans"]] == brute_spans(r["text"]), r["text"]


def test_many_lines_do_not_exhaust_the_stack(spark):
    lines = key(64 * 48 * 30)
    texts = ["-----BEGIN PRIVATE KEY-----" + s + s.join(lines) + e for s in ("\n", "\n  ") for e in ("", "\n-----END PRIVATE KEY-----")]
    out = secret_scan.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert [r["text"] for r in out] == ["[SECRET]"] * 4
