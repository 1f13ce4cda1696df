"""Operator 8, secret scans with corpus-wide ownership frequency.

Candidates are found by patterns in every whole text. Each candidate value is
hashed; hashes are aggregated over the corpus by distinct repositories and
distinct owners. A value that many owners hold, or a few owners in many
repositories, is a copied example; what stays with its owner and looks random
is a live-looking credential, however often that owner repeats it.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import cut, fresh, map_arrow, packed

# The base kinds, in listed order, with the group that must reach the length.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
BASE_KINDS = ("assign", "access", "hex")
MIN_ASSIGN, MIN_ACCESS = 6, 20
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# Kinds beyond the base ones, by publicly documented token shapes.
EXTRA = (
    ("private_key", "-----BEGIN ", re.compile(r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----[A-Za-z0-9+/=\s]+-----END (?:[A-Z]+ )*PRIVATE KEY-----")),
    ("jwt", "eyJ", re.compile(r"[A-Za-z0-9_.-]+")),
    ("hosted_git", "gh", re.compile(r"\bgh[pousr]_[A-Za-z0-9]{36,}")),
    ("chat_bot", "xox", re.compile(r"\bxox[abprs]-[A-Za-z0-9-]{10,}")),
    ("url_login", "://", re.compile(r"://[^\s/:@]+:[^\s/@]{6,}@")),
)
KINDS = BASE_KINDS + tuple(k for k, _, _ in EXTRA)

# How a JSON Web Token begins, least characters of its three parts, and what a URL's scheme is made of.
JWT_START = re.compile(r"\beyJ")
JWT_PART = 8
SCHEME = frozenset("abcdefghijklmnopqrstuvwxyz0123456789+.-")

#: Distinct owners from which a value counts as a copied example; two owners do in so many repositories.
EXAMPLE_OWNERS = 3
FEW_OWNERS = 2
EXAMPLE_REPOS = 20
#: Spans that a join may broadcast.
BROADCAST_SPANS = 200_000
#: Bits a character from which a value looks random.
MIN_ENTROPY = 2.5

#: Java's pattern for texts that can hold a span of any kind.
MAY_HOLD = r"(?i:password|passwd|secret|token|api_?key)|AKIA|[0-9a-f]{24}|-----BEGIN |eyJ|gh[pousr]_|xox|://"

SPAN = "start:long, end:long, kind:int, value_start:long, value_end:long, hash:binary, random:boolean"


def base_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    """(start, end, kind, value start, value end) of the base kinds, by start and then kind.

    Per kind leftmost matches that don't overlap, as code points; a run of hex
    digits shorter than 24 can't hold a longer one, so the bound is in the pattern.
    """
    found = []
    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= MIN_ASSIGN:
                found.append((m.start(), m.end(), 0, m.start(2), m.end(2)))
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1, m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), m.end(), 2, m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def jwt_spans(text: str, runs: re.Pattern) -> list[tuple[int, int]]:
    """Three parts joined by dots, the first from ``eyJ`` on; each run of parts is read once."""
    found = []
    for m in runs.finditer(text):
        parts, at, k = m[0].split("."), m.start(), 0
        starts = []
        for p in parts:
            starts.append(at)
            at += len(p) + 1
        while k + 2 < len(parts):
            end = starts[k] + len(parts[k])
            hit = JWT_START.search(text, starts[k], end) if min(len(parts[k + 1]), len(parts[k + 2])) >= JWT_PART else None
            if hit and end - hit.end() >= JWT_PART:
                found.append((hit.start(), starts[k + 2] + len(parts[k + 2])))
                k += 3
            else:
                k += 1
    return found


def url_spans(text: str, logins: re.Pattern) -> list[tuple[int, int]]:
    """Scheme, user and password of URLs: from each ``://user:password@`` back over the scheme, so no letter is read twice."""
    found, floor = [], 0
    for m in logins.finditer(text):
        first = m.start()
        while first > floor and text[first - 1] in SCHEME:
            first -= 1
        while first < m.start() and not ("a" <= text[first] <= "z" and (first == 0 or not (text[first - 1].isalnum() or text[first - 1] == "_"))):
            first += 1
        if first < m.start():
            found.append((first, m.end()))
            floor = m.end()
    return found


def extra_spans(text: str) -> list[tuple[int, int, int, int, int]]:
    found = []
    for kind, (name, hint, pattern) in enumerate(EXTRA, len(BASE_KINDS)):
        if hint in text:
            own = jwt_spans(text, pattern) if name == "jwt" else url_spans(text, pattern) if name == "url_login" else [m.span() for m in pattern.finditer(text)]
            found += [(lo, hi, kind, lo, hi) for lo, hi in own]
    return found


def entropy(value: str) -> float:
    n = len(value)
    return -sum((c := value.count(x)) / n * math.log2(c / n) for x in set(value)) if n else 0.0


def digest_spans(spans) -> str:
    """``kind:start:end`` by start and then kind, comma-joined."""
    return ",".join(f"{KINDS[s[2]]}:{s[0]}:{s[1]}" for s in spans)


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """Rows (doc_id, owner, key, spans) for every row of ``docs``; ``spans`` holds what the patterns found.

    ``key`` is the 64-bit hash of the text, by which spans are brought back to
    rows. A null text counts as empty; a null owner as an owner named ''; a null
    id as a repository named by the key.
    """
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.int32()), ("value_start", pa.int64()), ("value_end", pa.int64()), ("hash", pa.binary()), ("random", pa.bool_())]))

    def run(batches):
        for b in batches:
            out = []
            for t in b.column(3):
                text = t.as_py() or ""
                spans = sorted(base_spans(text) + extra_spans(text), key=lambda s: (s[0], s[2]))
                out.append([
                    dict(start=s[0], end=s[1], kind=s[2], value_start=s[3], value_end=s[4], hash=hashlib.sha256((v := text[s[3] : s[4]]).encode()).digest(), random=entropy(v) >= MIN_ENTROPY)
                    for s in spans
                ])
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(out, kinds)], ["doc_id", "owner", "key", "spans"])

    text = F.col(text_col).cast("string")
    rows = packed(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), F.xxhash64(text).alias("key"), text.alias("text"))
    return map_arrow(rows, run, f"doc_id long, owner string, key long, spans array<struct<{SPAN}>>")


def ownership(found: DataFrame) -> DataFrame:
    """Rows (hash, n_repos, n_owners): distinct repositories (documents) and owners that hold a value."""
    held = found.where(F.size("spans") > 0).select("owner", F.coalesce("doc_id", "key").alias("repo"), F.explode("spans.hash").alias("hash"))
    owners = held.groupBy("hash", "owner").agg(F.count("*").alias("n")).groupBy("hash").agg(F.count("*").alias("n_owners"))
    repos = held.groupBy("hash", "repo").agg(F.count("*").alias("n")).groupBy("hash").agg(F.count("*").alias("n_repos"))
    return owners.join(repos, "hash")


def judged(found: DataFrame) -> DataFrame:
    """Rows (key, judged): per text its spans by start and kind, each with a verdict by who holds its value.

    'example': copied by EXAMPLE_OWNERS owners or more, or by FEW_OWNERS in
    EXAMPLE_REPOS repositories; else 'live' if it looks random, 'weak' if not.
    """
    copied = (F.col("n_owners") >= EXAMPLE_OWNERS) | (F.col("n_owners") >= FEW_OWNERS) & (F.col("n_repos") >= EXAMPLE_REPOS)
    held = found.where(F.size("spans") > 0).select("key", F.explode("spans").alias("s")).dropDuplicates(["key", "s"])
    owned = held.join(ownership(found), F.col("s.hash") == F.col("hash"))
    verdict = F.when(copied, "example").when(F.col("s.random"), "live").otherwise("weak").alias("verdict")
    one = F.struct("s.start", "s.kind", "s.end", "s.value_start", "s.value_end", "s.hash", verdict)
    return owned.groupBy("key").agg(F.sort_array(F.collect_list(one)).alias("judged"))


def _is_small(rows: DataFrame, spans: str) -> bool:
    """Whether ``rows`` hold few enough spans to be broadcast."""
    return rows.agg(F.coalesce(F.sum(F.size(spans)), F.lit(0)).alias("n")).first().n <= BROADCAST_SPANS


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """One row per row of ``docs``: base counts and digest, all spans, and how many of them look live.

    Null and empty texts have no spans; repeated rows come out as often as they
    come in; a null id stays null; no rows give none.
    """
    found = cut(candidates(docs, id_col, text_col, owner_col))
    names = F.array(*[F.lit(k) for k in KINDS])
    shown = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"] < len(BASE_KINDS))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    verdicts = cut(judged(found))
    some = found.where(F.size("spans") > 0).join(F.broadcast(verdicts) if _is_small(verdicts, "judged") else verdicts, "key", "left")
    none = found.where(F.size("spans") == 0).withColumn("judged", F.lit(None).cast(some.schema["judged"].dataType))
    return some.unionByName(none).select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(shown(base).cast("binary"), 256).alias("base_sha256"), shown(F.col("spans")).alias("spans"),
        F.size(F.filter(F.coalesce("judged", F.array()), lambda s: s["verdict"] == "live")).cast("long").alias("n_live"),
        F.coalesce(F.array_join("judged.verdict", ","), F.lit("")).alias("verdicts"),
    )


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """``docs`` with every live-looking value replaced by ``mask``; n_chars follows a changed text.

    Every row stays, repeated ones too; null and empty texts and texts without
    live values are untouched; no rows give none; columns stay as they are.
    Only texts that may hold a secret are ever shuffled.
    """
    docs = packed(docs)
    key, spans, new_text = fresh(docs, "key", "live", "text")
    live = F.filter("judged", lambda s: s["verdict"] == "live")
    placed = cut(judged(cut(candidates(docs))).select(F.col("key").alias(key), live.alias(spans)).where(F.size(spans) > 0))
    few = _is_small(placed, spans)

    @F.arrow_udf("string")
    def hidden(text: pa.Array, spans: pa.Array) -> pa.Array:
        return pa.array([None if t is None else masked(t, s, mask) for t, s in zip(text.to_pylist(), spans.to_pylist())], pa.string())

    on = F.xxhash64(F.col("text")) == F.col(key)
    if few:
        joined = docs.join(F.broadcast(placed), on, "left")
    else:
        may = F.coalesce(F.col("text").rlike(MAY_HOLD), F.lit(False))
        joined = docs.where(may).join(placed, on, "left").unionByName(docs.where(~may), allowMissingColumns=True)
    # Texts without live spans don't leave the JVM.
    rows = joined.withColumn(new_text, hidden(F.when(F.col(spans).isNotNull(), F.col("text")), F.col(spans)))
    new = {"text": F.coalesce(new_text, F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(F.col(new_text).isNotNull(), F.length(new_text)).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return rows.select(*[new[c].alias(c) if c in new else F.col(c) for c in docs.columns])


def masked(text: str, spans: list[dict], mask: str) -> str:
    """``text`` with the values of ``spans`` replaced; a span whose hash isn't its value's is passed over."""
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["value_start"], -s["value_end"])):
        lo, hi = s["value_start"], s["value_end"]
        if lo >= at and hashlib.sha256(text[lo:hi].encode()).digest() == s["hash"]:
            out += [text[at:lo], mask]
            at = hi
    return "".join([*out, text[at:]])
