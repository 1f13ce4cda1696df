import hashlib
import random
import re
import time

from strandlake.llm import secret_scan as ss

from tests.llm.helpers import awkward, docs

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    text = text or ""
    got = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    got += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    got += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(got)


def texts():
    random.seed(3)
    parts = ["password", "PassWord", "token", "secret", "api_key", "apikey", "=", ": ", ' = "', "abc", "abcdef123", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "K", "ſecret", " ", "\n", "é", '"', "'"]
    return ["".join(random.choice(parts) for _ in range(30)) for _ in range(300)]


def test_base_spans_match_brute_force():
    for t in texts():
        assert [(s[0], s[2], s[1]) for s in ss.base_spans(t)] == brute(t)


def test_scan_of_awkward_documents(spark):
    rows = awkward() + [(100 + i, t, f"s{i % 5}") for i, t in enumerate(texts())]
    got = ss.scan(docs(spark, rows)).collect()
    want = []
    for i, t, _ in rows:
        b = brute(t)
        base = ",".join(f"{ss.BASE_KINDS[k]}:{a}:{z}" for a, k, z in b)
        want.append((str(i), *(sum(k == n for _, k, _ in b) for n in range(3)), hashlib.sha256(base.encode()).hexdigest()))
    assert sorted((str(r.doc_id), r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == sorted(want)
    assert ss.scan(docs(spark, [])).collect() == []


def test_ownership_parts_examples_from_live_values(spark):
    example, own = "AKIA" + "EXAMPLEKEY0123456789", "AKIA" + "Q7RZP2LM9XVB4KTN83WD"
    rows = [(i, f"use {example} here", f"owner{i}") for i in range(4)] + [(10, f"mine {own} end", "o1"), (11, f"mine {own} end", "o1"), (None, f"again {own}", "o1")]
    got = {str(r.doc_id): r.n_live for r in ss.scan(docs(spark, rows)).collect()}
    assert got == {"0": 0, "1": 0, "2": 0, "3": 0, "10": 1, "11": 1, "None": 1}
    clean = {str(r.doc_id): r for r in ss.redact(docs(spark, rows)).collect()}
    assert clean["10"].text == "mine [SECRET] end" == clean["11"].text and clean["None"].text == "again [SECRET]"
    assert clean["0"].text == f"use {example} here" and clean["10"].n_chars == len("mine [SECRET] end") and clean["10"].key == "x"


def test_more_kinds():
    jwt = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0NTY3ODkwIn0.dozjgNryP4J3jVmNHl0w5N"
    text = f"a {jwt} b ghp_{'a1B2' * 10} c https://me:hunter2pw@host/x"
    assert [ss.KINDS[s[2]] for s in sorted(ss.extra_spans(text))] == ["jwt", "hosted_git", "url_login"]


URL = re.compile(r"\b[a-z][a-z0-9+.-]*://[^\s/:@]+:[^\s/@]{6,}@")
JWT = re.compile(r"\beyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")


def test_urls_and_tokens_match_plain_patterns():
    random.seed(12)
    parts = ["a", "Z", "h+.-", "://", ":", "user", "hunter2pw", "@", "/", " ", "_", "é", "eyJ", "eyJabcdefgh", ".", "-", "abcdefghij", "9"]
    for _ in range(4000):
        t = "".join(random.choice(parts) for _ in range(25))
        got = sorted((s[2], s[0], s[1]) for s in ss.extra_spans(t) if ss.KINDS[s[2]] in ("jwt", "url_login"))
        want = [(ss.KINDS.index("jwt"), *m.span()) for m in JWT.finditer(t)] + [(ss.KINDS.index("url_login"), *m.span()) for m in URL.finditer(t)]
        assert got == want, t


def test_long_runs_take_linear_time():
    for t in ("a." * 500_000 + "://", "-eyJ" * 300_000, "://a:bcdefgh" * 100_000, "password" + " " * 1_000_000):
        start = time.process_time()
        ss.extra_spans(t), ss.base_spans(t)
        assert time.process_time() - start < 3


def brute_verdicts(rows):
    """Verdict by kind:start:end of every row, by owners and repositories counted in plain sets."""
    owners, repos, spans = {}, {}, []
    for n, (i, t, owner) in enumerate(rows):
        t = t or ""
        own = sorted(ss.base_spans(t) + ss.extra_spans(t), key=lambda s: (s[0], s[2]))
        spans.append([(s, t[s[3] : s[4]]) for s in own])
        for _, v in spans[-1]:
            owners.setdefault(v, set()).add(owner or "")
            repos.setdefault(v, set()).add(("text", t) if i is None else i)
    verdict = lambda v: "example" if len(owners[v]) >= 3 or len(owners[v]) == 2 and len(repos[v]) >= 20 else "live" if ss.entropy(v) >= ss.MIN_ENTROPY else "weak"
    return [(str(i), ",".join(verdict(v) for _, v in own), sum(verdict(v) == "live" for _, v in own)) for (i, _, _), own in zip(rows, spans)]


def test_ownership_matches_brute_force(spark):
    random.seed(4)
    values = ["AKIA" + "".join(random.choice("ABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(18)) for _ in range(8)] + ["AKIA" + "A" * 20]
    rows = [(i, "x " + " and ".join(random.choice(values[: 1 + i % 9]) for _ in range(i % 4)), random.choice(["a", "b", None] if i % 2 else ["a"])) for i in range(120)]
    rows += [(500 + i, f"{values[1]}Q pair", "p" if i % 2 else "q") for i in range(24)] + [(600 + i, f"{values[1]}R pair", "p" if i % 2 else "q") for i in range(8)]
    rows += awkward() + [(None, "token = abcdefgh1234", None)] * 2 + [(700, "password=aaaaaaaa", "a")]
    got = sorted((str(r.doc_id), r.verdicts, r.n_live) for r in ss.scan(docs(spark, rows)).collect())
    assert got == sorted(brute_verdicts(rows))
    assert {v for r in got for v in r[1].split(",")} >= {"example", "live", "weak"}


def test_redaction_with_and_without_a_broadcast(spark, monkeypatch):
    key = "AKIA" + "Q7RZP2LM9XVB4KTN83WD"
    rows = awkward() + [(20 + i, f"mine {key}{i} end", "o") for i in range(5)] + [(30, f"mine {key}0 end", "o"), (30, f"mine {key}0 end", "o"), (None, f"{key}1", None)]
    shown = lambda: sorted(map(str, ss.redact(docs(spark, rows)).collect()))
    few = shown()
    monkeypatch.setattr(ss, "BROADCAST_SPANS", -1)
    assert shown() == few and len(few) == len(rows) and sum("[SECRET]" in r for r in few) == 8
    assert ss.redact(docs(spark, [])).collect() == []
