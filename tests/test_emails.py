import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sitescan import lookups as L
from sitescan.functions import emails as E
from sitescan.operators import email_checks, emails

ADDRESS = re.compile(r"(?<!\w)" + L.EMAIL + r"(?!\w)")

TRICKY = [
    "x [at] y [dot] com", "look at site.org", "éab@x.com", "é.12@mail.de", "a@b.com1", "a@b.co.1x",
    "write to tip@zz.io now", "😀😀 emoji Info@Some.org, info@some.org", "nb at sp.org",
    "a@b.com@c.org d@e.fr", "first.last+tag@sub.mail.example.org.", "x@y.zz" * 3, "a@b.cc,c@d.ee;f@g.hh",
    "a (AT) b (Dot) net", "q [at] [at] r.com", "one at at two.com", "contact:" + " " * 300 + "zz@far.org",
    "abc@x..com", "u@1.2.com", "logo@2x.png", "No-Reply@a.org", "..dots@a.org", "-a@b.cd", "%%@x.yz",
    "tab\tat\tx.de", "  at  lead.com", "at x.com", "", "no address", "@", "a@", "@b.cc", "ﬀ@a.bc", "1²a@b.cc",
]


def undo(text):
    for mark, plain, spaced in L.OBFUSCATIONS:
        gap = r"\s+" if spaced else r"\s*"
        text = re.sub(f"{gap}{mark}{gap}", plain, text, flags=re.I)
    return text


def brute_force(text):
    """[(start, raw, context)] by plain Python."""
    clear = undo(text)
    return [
        (m.start(), m.group(), clear[max(0, m.start() - 100) : m.end() + 100])
        for m in ADDRESS.finditer(clear)
    ]


def matches_of(rows, texts):
    table = rows("page_id bigint, html string", *enumerate(texts))
    out = emails.email_matches(table).orderBy("page_id", "start").collect()
    found = [[] for _ in texts]
    for r in out:
        found[r.page_id].append((r.start, r.raw, r.context))
    return found


def test_deobfuscate(evaluate):
    assert evaluate(E.deobfuscate, *TRICKY) == [undo(t) for t in TRICKY]


def test_strict_at(evaluate):
    strict = lambda c: E.deobfuscate(c, strict_at=True)
    assert evaluate(strict, "look at site.org", "me at site [dot] org", "me [at] site.org") == [
        "look at site.org", "me@site.org", "me@site.org",
    ]


def test_matches_equal_brute_force(rows):
    assert matches_of(rows, TRICKY) == [brute_force(t) for t in TRICKY]


def test_dense_page(rows):
    text = " ".join(f"u{i}@h{i % 7}.org" for i in range(400)) + " at " + "a@b.cc,".join(["x"] * 50)
    assert matches_of(rows, [text]) == [brute_force(text)]


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab.@-_é  \t[](atdo)1", max_size=60), min_size=20, max_size=60))
def test_matches_equal_brute_force_on_random_text(rows, texts):
    assert matches_of(rows, texts) == [brute_force(t) for t in texts]


def test_blocklist(evaluate):
    blocked = [
        "a@b.png", "a@example.com", "a@domain.org", "a@yourdomain.x", "a@sentry.io", "a@o1.ingest.sentry.io",
        "a@o1.ingest.us.sentry.io", "a@b.dropbox.com", "noreply@a.org", "x.no-reply@a.org", "donotreply@a.b", "a@1.2.com", "a..b@c.org",
    ]
    fine = ["x@mail2.example.com", "a@bb.dropbox.com", "info@a.org", "a@png.org", "a@1a.com"]
    assert evaluate(E.is_blocked, *blocked, *fine) == [True] * len(blocked) + [False] * len(fine)


def test_rank(rows):
    pages = rows(
        "page_id bigint, html string",
        (1, "zed@a.org " + "." * 250 + " contact bob@b.org " + "." * 250 + " info@c.org and ab@d.org" + "." * 250 + " ab@d.org"),
        (2, "nothing"),
        (3, None),
        (4, "B@x.org a@x.org"),
    )
    ranked = emails.email_rank(pages).orderBy("page_id", "rank").collect()
    # 35 for a contact name near a contact word, 15 near one, 5 when short, never below 0
    assert [(r.page_id, r.rank, r.email, r.score) for r in ranked] == [
        (1, 1, "info@c.org", 35), (1, 2, "bob@b.org", 5), (1, 3, "ab@d.org", 5)
    ][:1] + [(1, 2, "ab@d.org", 5), (1, 3, "bob@b.org", 5), (1, 4, "zed@a.org", 0)] + [
        (4, 1, "a@x.org", 0), (4, 2, "b@x.org", 0),
    ]
    best = {r.page_id: r.email for r in emails.best_email(pages).collect()}
    assert best == {1: "info@c.org", 2: None, 3: None, 4: "a@x.org"}


def test_format(evaluate):
    assert evaluate(E.is_format_valid, " a@b.cc ", "a@b", "a b@c.dd", "a@b.c1", None, "a@b.cc\n") == [
        True, False, False, False, False, True,
    ]


def test_verdicts(rows):
    found = rows("email string", "A@x.org ", "a@x.org", "b@none.org", "bad", "c@zero.org", None)
    mx = rows("domain string, mx_count int", ("x.org", 2), ("zero.org", 0), ("x.org", 0))
    out = email_checks.email_validate_bulk(found, mx)
    assert sorted(out.collect()) == [
        ("a@x.org", True, True, True), ("b@none.org", True, False, False),
        ("bad", False, False, False), ("c@zero.org", True, False, False),
    ]
    probes = rows("email string, code int", ("a@x.org", 550), ("b@none.org", 250))
    out = email_checks.email_validate_bulk(found, mx, probes)
    assert {r.email: r.is_valid for r in out.collect()} == {
        "a@x.org": False, "b@none.org": False, "bad": False, "c@zero.org": False,
    }


def test_backfill_leaves_rows_without_address_open(rows):
    table = rows("url string, email string", ("u1", "a@x.org"), ("u2", None), ("u3", "z@y.org"))
    verdicts = rows("email string, is_valid boolean", ("a@x.org", True))
    table = table.withColumn("email_valid", F.lit(None).cast("boolean"))
    out = email_checks.email_valid_backfill(table, verdicts).orderBy("url").collect()
    assert [r.email_valid for r in out] == [True, None, None]


def test_filter_on_the_result_does_not_repeat_the_search(rows):
    """A pushed-down filter may run the search twice, not once per use of every step."""
    pages = rows("page_id bigint, html string", (1, "x at y.org"))
    plan = emails.best_email(pages).where(F.col("email").isNotNull())._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") <= 2


@pytest.mark.parametrize("size", [200_000])
def test_long_white_space_is_read_once(rows, size):
    import time

    start = time.time()
    text = "a [at] b.org" + " " * size + "at" + "\n" * size + "z"
    assert matches_of(rows, [text])[0][0][1] == "a@b.org@z"[:7]
    assert time.time() - start < 30
