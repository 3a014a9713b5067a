from __future__ import annotations

import hashlib
import random
import re

from llm.texts import corpus

from tallystone.llm import secret_scan, url_filter


def base_spans(text):
    kinds = (
        (r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 6),
        (r"AKIA[A-Z0-9]+", 0, 20),
        (r"[0-9a-f]+", 0, 24),
    )
    names = ("assign", "access", "hex")
    found = [(m.start(), k, m.end()) for k, (p, g, n) in enumerate(kinds) for m in re.finditer(p, text or "") if len(m[g]) >= n]
    return [(names[k], a, b) for a, k, b in sorted(found)]


COPIED, OWN = "Abc123Def456Ghi789JklMno", "9F86D081884C7D659A2FEAA0C55AD015"


def secret_texts():
    hexa = "0123456789abcdef" * 2
    return [
        *corpus(1, 6),
        f"é 𝄞 Password: 'hunter22' and {hexa} TOKEN=abc, token: secret=abcdefgh",
        f"api_key = \"{hexa}\" AKIA{'A1' * 8} AKIAAKIA12 xAKIA{'B' * 16}",
        "token=token:abcdefg secret='x' passwd=  '1234567'",
        f"key {OWN} end",
        *(f"see {COPIED} number {i}" for i in range(6)),
        f"{hexa}{hexa}",
    ]


def test_spans(spark, documents):
    texts = secret_texts()
    rows = {r.doc_id: r for r in secret_scan.judged(documents(texts)).collect()}
    for i, text in enumerate(texts):
        want = base_spans(text)
        listed = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        r = rows[i]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, _, _ in want) for x in ("assign", "access", "hex"))
        assert r.base_sha256 == hashlib.sha256(listed.encode()).hexdigest()
        assert set(filter(None, listed.split(","))) <= set(r.spans.split(","))
        assert r.n_live + r.n_copied == len(want)
    live = {i for i, r in rows.items() if "live:" in r.spans}
    assert live == {next(i for i, t in enumerate(texts) if t and OWN in t)}
    assert rows[min(live)].spans == f"live:4:{4 + len(OWN)}"


def test_ownership_counts_owners_and_repositories(spark):
    rows = [(1, 7, "a", 1), (1, 7, "a", 1), (1, 8, "a", 2), (1, 8, "a", 4), (1, 9, None, 3), (2, 7, "a", None), (2, 7, "a", None)]
    got = {r.v: (r.owners, r.repositories, r.largest) for r in secret_scan.ownership(spark.createDataFrame(rows, "v long, h long, source string, doc_id long")).collect()}
    assert got == {1: (2, 3, 2), 2: (1, 1, 1)}


def test_one_text_of_several_owners_is_copied_and_copies_of_one_owner_are_not(spark):
    def spans(rows):
        frame = spark.createDataFrame(rows, "doc_id long, source string, text string")
        return {r.doc_id: r.spans for r in secret_scan.judged(frame).collect()}

    text = f"key {OWN} end"
    assert set(spans([(i, f"s{i}", text) for i in range(3)]).values()) == {""}
    assert set(spans([(i, f"s{i}", f"{text} {i}") for i in range(3)]).values()) == {""}
    assert set(spans([(i, "s", text) for i in range(30)]).values()) == {f"live:4:{4 + len(OWN)}"}
    # thirty repositories of one owner, and a copy in another's
    many = spans([(i, "s", f"{text} {i}") for i in range(30)] + [(99, "t", text)])
    assert set(many.values()) == {f"live:4:{4 + len(OWN)}"}


def test_tokens_of_one_owner_are_live_in_any_number_of_documents(spark, documents):
    own, mirrored = OWN.replace("9F", "Wf"), OWN.replace("9F", "Yf")
    texts = [(i, f"number {i} has {own}") for i in range(0, 30, 3) if i != 3]  # one source
    texts += [(100 + i, f"copy of {mirrored} password=abc{mirrored}") for i in range(6)]  # equal texts in three sources
    texts += [(200 + i, f"example {i} of {COPIED} and secret={COPIED}") for i in range(6)]
    rows = {r.doc_id: r for r in secret_scan.judged(documents(texts)).collect()}
    assert all(("live:" in r.spans) == (i < 100) for i, r in rows.items())
    assert all((r.n_live, r.n_copied) == ((0, 0) if i < 100 else (0, 1)) for i, r in rows.items())


def test_secrets_of_odd_rows(spark, documents):
    text = "password=abcdefgh"
    rows = secret_scan.judged(documents([(None, text), (None, text), (2, None)])).collect()
    assert sorted(r.spans for r in rows) == ["", "assign:0:17", "assign:0:17"]
    assert secret_scan.judged(documents([text]).limit(0)).collect() == []
    plan = secret_scan.judged(documents([text]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan


def judge(url, rules, default="allow"):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0] + r[1]), len(r[1]), r[0] + r[1], r[2]), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else default


URLS = [
    "http://www.Example.ORG/es/1?x", "https://example.org", "http://example.org?/es/", "a://example.org/en/12#t", "http://b.com/fr/", "http://com/de/x",
    "http://xcom/fr/", "http://a.b.c.example.org/en/2", "x", None, "", "://", "http://org/", "ftp://EXAMPLE.org/es/?a://b", "http://q.net/", "http://com/FR/", "http://é.com/fr/é",
]


def test_urls_equal_brute_force(spark):
    rng = random.Random(3)
    rules = list(url_filter.RULES) + [(".".join(rng.choices("ab", k=rng.randint(1, 3))), "/" + "".join(rng.choices("xy", k=rng.randint(0, 3))), rng.choice(["allow", "block"])) for _ in range(40)]
    rules = list({r[:2]: r for r in rules}.values())
    urls = URLS + [f"http://{'.'.join(rng.choices('ab', k=rng.randint(1, 4)))}/{''.join(rng.choices('xy', k=rng.randint(0, 5)))}" for _ in range(400)]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, html string").selectExpr("*", "1 AS key", "2 AS row")
    for ranges in (1, 9):
        rows = url_filter.judged(pages, url_filter.rule_table(spark, rules), ranges=ranges).collect()
        assert {r.page_id: tuple(r)[1:] for r in rows} == {i: judge(u, rules) for i, u in enumerate(urls)}


def test_urls_of_one_host_and_odd_tables(spark):
    pages = spark.createDataFrame([(7, "http://x.org/a")] * 300 + [(None, None)], "page_id long, url string")
    rows = url_filter.judged(pages, url_filter.rule_table(spark), ranges=7).collect()
    assert len(rows) == 301 and sum(r.rule == "org/" for r in rows) == 300
    none = url_filter.rule_table(spark).limit(0)
    assert {r.verdict for r in url_filter.judged(pages, none, "block").collect()} == {"block"}
    nulls = url_filter.rule_table(spark, [(None, "/", "block"), ("org", None, "block"), ("org", "/", None)])
    assert {r.rule for r in url_filter.judged(pages, nulls).collect()} == {None}
    assert url_filter.judged(pages.limit(0), url_filter.rule_table(spark)).collect() == []


def test_rules_of_whole_hosts_and_very_long_urls(spark):
    rules = spark.createDataFrame([("example.org", "", "block"), ("a.example.org", "/x", "allow"), (None, "", "block")], "host string, path string, verdict string")
    long = "/x" + "y" * 100_000
    urls = ["http://example.org", "http://a.example.org?q", "http://a.example.org/x", "http://b.example.org/x", "http://notexample.org", f"http://a.example.org{long}", f"http://{'s.' * 200}example.org", None, "example.org"]
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, row int")
    got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judged(pages, rules).collect()}
    whole, part, none = ("example.org", "block"), ("a.example.org/x", "allow"), (None, url_filter.DEFAULT)
    assert [got[i] for i in range(len(urls))] == [whole, whole, part, whole, none, part, whole, none, none]
