"""Personal data by weak supervision.

Candidates are the matches of strict patterns and of looser ones. Labelers vote on each
(yes, no, or nothing): the pattern, a checksum or shape, gazetteers, words around it, what it
is attached to, what speaks against it before it, and whether it is a mere example.
Expectation maximisation over the counts of all vote patterns of the corpus estimates how far
each labeler can be trusted, without labels, from a prior that a labeler is rather right than
wrong; the chances it gives train a logistic classifier on votes and shape. Strict matches
always stay; of the looser candidates those that the classifier accepts are added, among them
secrets (keys, tokens, passwords), a kind that has no strict pattern.
"""

from __future__ import annotations

import bisect
import ipaddress
import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, quoted, tidy, unused

KINDS = ("email", "ip", "card", "phone")
#: Kinds with strict patterns, then those without.
ALL_KINDS = (*KINDS, "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A digit run is tried from its first digit only: from a later one it can't match if it doesn't there.
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?[\[(] ?at ?[\])] ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[\[(] ?dot ?[\])]) ?[A-Za-z0-9-]{1,63}){1,5}", re.IGNORECASE),
    "ip": re.compile(r"(?<![0-9A-Fa-f:.])[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){12,14}(?![0-9])"),
    "phone": re.compile(
        r"(?<![0-9+])(?:\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|00[1-9][0-9](?:[ .-]?[0-9]){6,12}|0[1-9][0-9]{1,3}[ /.-][0-9](?:[ .-]?[0-9]){4,9})(?![0-9])"
    ),
}
HINT = re.compile(r"[\[(] ?at ?[\])]", re.IGNORECASE)
ASSIGNED = re.compile(r"[:=][ \t]{0,3}[\"']?")
KEY = re.compile(r"(?:passw(?:or)?d|passphrase|pwd|secret|token|api[_ -]?key|access[_ -]?key|private[_ -]?key|credentials?)[\"']?[ \t]{0,3}$", re.IGNORECASE)
VALUE = re.compile(r"[^\s\"',;<>]{6,}")
RUN = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}")
# Gazetteers, fixed values: top-level domains, calling codes, first digits of issuers (from, to,
# lengths), mailboxes of roles, given names, beginnings of well-known keys.
TOP_LEVEL = frozenset(
    "com org net edu gov mil int info biz name pro io app dev ai co me tv eu ac ad ae af ag al am ao ar at au az ba bd be bg bh bo br by bz ca cd ch ci "
    "cl cm cn cr cu cy cz de dk do dz ec ee eg es et fi fr ga ge gh gr gt hk hn hr ht hu id ie il in iq ir is it jm jo jp ke kh kr kw kz lb lk lt lu lv "
    "ly ma md mk ml mm mn mt mu mx my mz na ng ni nl no np nz om pa pe ph pk pl pt py qa ro rs ru sa sd se sg si sk sn sv sy th tn tr tw tz ua ug uk us "
    "uy uz va ve vn za zm zw".split()
)
CALLING = tuple(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 211 212 213 "
    "216 218 220 221 225 227 233 234 237 243 244 249 251 254 255 256 260 263 351 352 353 354 355 356 357 358 359 370 371 372 373 374 375 376 377 380 381 "
    "382 385 386 387 389 420 421 423 502 503 504 505 506 507 509 591 593 595 598 852 853 855 880 886 960 961 962 963 964 965 966 967 968 971 972 973 974 "
    "975 976 977 992 993 994 995 996 998".split()
)
ISSUERS = (
    ("4", "4", (13, 16, 19)), ("51", "55", (16,)), ("2221", "2720", (16,)), ("34", "34", (15,)), ("37", "37", (15,)), ("6011", "6011", (16, 19)),
    ("644", "659", (16, 19)), ("300", "305", (14,)), ("36", "36", (14,)), ("38", "39", (14,)), ("3528", "3589", (16,)), ("62", "62", (16, 17, 18, 19)),
    ("50", "50", (13, 14, 15, 16)), ("56", "58", (13, 14, 15, 16)),
)
ROLES = frozenset("info admin contact sales support office help mail hello service team billing jobs press kontakt contacto ventas".split())
NAMES = frozenset(
    "james john robert michael william david richard joseph thomas charles mary patricia jennifer linda elizabeth barbara susan jessica sarah karen anna "
    "emma laura peter paul mark hans karl klaus jürgen wolfgang stefan andreas martin thomas uwe petra sabine monika claudia heike jean pierre michel "
    "philippe alain nicolas julien marie nathalie isabelle sylvie catherine sophie camille josé juan antonio manuel francisco carlos luis javier miguel "
    "maría carmen ana isabel lucía elena pilar rosa teresa".split()
)
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "glpat-", "sk-", "sk_live_", "pk_live_", "rk_live_", "xoxb-", "xoxp-", "xoxa-", "AIza", "eyJ", "SG.", "npm_", "hf_")
AROUND = {
    "email": re.compile(r"mail|contact|write|reach|correo|escrib|courriel|écri|kontakt|schreib|adress", re.IGNORECASE),
    "ip": re.compile(r"\bip|host|server|address|login|client|adresse|dirección|serveur|servidor", re.IGNORECASE),
    "card": re.compile(r"card|visa|master|amex|credit|pay|karte|zahl|carte|paie|tarjeta|pago", re.IGNORECASE),
    "phone": re.compile(r"phone|\btel|call|fax|mobile|cell|telefon|handy|\bruf|appel|téléph|llam|móvil|teléf", re.IGNORECASE),
    "secret": re.compile(r"token|secret|passw|pwd|api.?key|access.?key|private.?key|credential|auth|bearer|schlüssel|passwort|clé|clave|contrase", re.IGNORECASE),
}
AGAINST = re.compile(r"(?:version|\bv|\bno|\bid|\bref|isbn|issn|doi|\bnr|sku|order|page|sha\d*|md5|commit|hash|checksum|#|\$|€)[ .:=]*[\"']?$", re.IGNORECASE)
SHAM = re.compile(r"example\.|\btest\b|changeme|placeholder|your[_-]|xxxx|\*\*\*|0000000|1234567|^(.)\1*$", re.IGNORECASE)
CANDIDATES = "array<struct<kind:string,start:int,end:int,base:boolean,votes:string,shape:string>>"
#: pattern, fits, known, near, edge, against, sham
LABELERS = 7


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def strict(text: str) -> list[tuple[str, int, int]]:
    """Matches of the strict patterns, by kind, leftmost and not overlapping within a kind."""
    out = []
    at, free = text.find("@"), 0
    while at >= 0:  # the match that starts leftmost takes all of the local part's run
        left = at
        while left > free and text[left - 1] in LOCAL:
            left -= 1
        m = DOMAIN.match(text, at + 1) if left < at else None
        if m:
            out.append(("email", left, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p[-9:]) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if 16 <= m.end() - m.start() <= 37 and 16 <= len(d := re.sub(r"[ -]", "", m[0])) <= 19 and luhn(d):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


class Taken:
    """Spans that don't overlap, in order."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def add(self, a: int, b: int) -> bool:
        """Takes a span, unless one is there already."""
        at = bisect.bisect_left(self.starts, b)
        if at and self.ends[at - 1] > a:
            return False
        self.starts.insert(at, a)
        self.ends.insert(at, b)
        return True


def secrets(text: str) -> list[tuple[int, int]]:
    """Values given to keys by name, and long runs that look like keys."""
    out, at = [], 0
    if "=" in text or ":" in text:
        while m := ASSIGNED.search(text, at):
            at = m.end()
            if KEY.search(text, max(0, m.start() - 40), m.start()) and (v := VALUE.match(text, m.end())):
                out.append(v.span())
                at = v.end()
    for m in RUN.finditer(text):
        kinds = {"d" if c.isdigit() else "u" if c.isupper() else "l" for c in m[0] if c.isalnum()}
        if "d" in kinds and len(kinds) > 1 and (len(m[0]) >= 32 or m[0].startswith(PREFIXES)):
            out.append(m.span())
    return out


def address(said: str) -> ipaddress.IPv6Address | None:
    try:
        return ipaddress.IPv6Address(said)
    except ValueError:
        return None


def loose(text: str, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Further candidates, none over a strict match or another one."""
    spans, out = Taken([(a, b) for _, a, b in taken]), []
    for kind in ALL_KINDS:
        if kind == "secret":
            found = secrets(text)
        elif kind == "email" and "@" not in text and not HINT.search(text) or kind == "ip" and text.count(":") < 2:
            continue
        else:
            found = [m.span() for m in LOOSE[kind].finditer(text)]
        if kind == "ip":
            found = [(a, b) for a, b in found if sum(map(bool, text[a:b].split(":"))) > 2 and address(text[a:b])]
        out += [(kind, a, b) for a, b in found if spans.add(a, b)]
    return sorted(out, key=lambda x: (ALL_KINDS.index(x[0]), x[1]))


def issued(digits: str) -> bool:
    return any(a <= digits[: len(a)] <= b and len(digits) in lengths for a, b, lengths in ISSUERS)


def entropy(said: str) -> float:
    n = len(said)
    return -sum(c / n * math.log2(c / n) for c in Counter(said).values())


def votes(text: str, kind: str, start: int, end: int, base: bool) -> str:
    """A character for each labeler: y, n or - for none."""
    said, digits = text[start : min(end, start + 400)], re.sub(r"[^0-9]", "", text[start : min(end, start + 400)])
    before, after = text[max(0, start - 40) : start], text[end : end + 40]
    known: bool | None
    if kind == "email":
        words = re.split(r"[^A-Za-z]+", said.lower().rstrip(" )]"))
        fits = len(said) <= 80 and not said.startswith((".", "-"))
        known = words[-1] in TOP_LEVEL or words[0] in ROLES or words[0] in NAMES
    elif kind == "ip":
        six = address(said) if ":" in said else None
        fits = six is not None or all(len(p) == 1 or p[0] != "0" for p in said.split("."))
        known = not (six.is_unspecified or six.is_loopback) if six else 1 <= int(said.split(".")[0][-3:] or 0) <= 223
    elif kind == "card":
        fits, known = luhn(digits), issued(digits)
    elif kind == "phone":
        abroad = said.startswith("+") or digits.startswith("00") and digits[2:3] != "0"
        fits = 9 <= len(digits) <= 15 and (abroad or (digits[0] == "0" != digits[1]) or (digits[0] in "23456789" and digits[3] in "23456789"))
        known = digits.lstrip("0").startswith(CALLING) if abroad else True if any(n in NAMES for n in re.findall(r"[^\W\d_]+", before.lower())) else None
    else:
        fits, known = len(said) >= 16 and entropy(said) >= 3 or any(map(str.isdigit, said)) and len(set(said)) >= 6, True if said.startswith(PREFIXES) else None
    near = bool(AROUND[kind].search(before) or AROUND[kind].search(after))
    edge = before[-1:].isalnum() or after[:1].isalnum()
    against, sham = bool(AGAINST.search(before)), bool(SHAM.search(digits if kind in ("card", "phone") else said))
    given = ("y" if base else "-", "y" if fits else "n", "-" if known is None else "y" if known else "n", "y" if near else "-")
    return "".join((*given, "n" if edge else "-", "n" if against else "-", "n" if sham else "-"))


def shape(text: str, start: int, end: int) -> str:
    """Length class, and which of a few separators occur."""
    said = text[start:end]
    return f"{min(3, (end - start) // 8)}{int(' ' in said)}{int('-' in said)}{int('(' in said)}"


def candidates(text: str) -> list[dict]:
    base = strict(text)
    found = [(*x, True) for x in base] + [(*x, False) for x in loose(text, base)]
    found.sort(key=lambda x: (ALL_KINDS.index(x[0]), x[1]))
    return [
        {"kind": k, "start": a, "end": b, "base": s, "votes": votes(text, k, a, b, s), "shape": shape(text, a, b)} for k, a, b, s in found
    ]


def candidate_spans(text: Column) -> Column:
    fields = [pa.field(n, t) for n, t in zip(("kind", "start", "end", "base", "votes", "shape"), (pa.string(), pa.int32(), pa.int32(), pa.bool_(), pa.string(), pa.string()), strict=True)]
    kind = pa.list_(pa.struct(fields))

    def found(texts: pa.Array) -> pa.Array:
        out = pa.array((candidates(t.as_py() or "") for t in texts), kind, size=len(texts))
        tidy()
        return out

    return F.arrow_udf(found, CANDIDATES)(text)


@dataclass
class Model:
    """Reliabilities by kind, and the classifier's weights by kind and feature."""

    trust: dict[str, np.ndarray] = field(default_factory=dict)  # labelers x (no, yes) x votes (n, -, y)
    weights: dict[str, dict[str, float]] = field(default_factory=dict)

    def chance(self, kind: str, votes: str, shape: str) -> float:
        w = self.weights.get(kind, {})
        z = sum(w.get(x, 0.0) for x in features(votes, shape))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def features(votes: str, shape: str) -> list[str]:
    return ["all", *(f"v{i}{v}" for i, v in enumerate(votes)), *(f"s{i}{v}" for i, v in enumerate(shape))]


#: Votes (n, -, y) on false and on true candidates that each labeler is taken to have given: the
#: pattern says yes or nothing, so do words around; the last three say no, seldom wrongly.
#: Some hundred candidates outweigh it.
PRIOR = np.array([
    [[5.0, 60.0, 1.0], [1.0, 20.0, 45.0]], [[40.0, 20.0, 5.0], [5.0, 20.0, 40.0]], [[40.0, 20.0, 5.0], [5.0, 20.0, 40.0]], [[1.0, 50.0, 15.0], [1.0, 25.0, 40.0]],
    [[100.0, 300.0, 5.0], [2.5, 200.0, 2.5]], [[100.0, 300.0, 5.0], [2.5, 200.0, 2.5]], [[300.0, 600.0, 10.0], [2.0, 400.0, 2.0]],
])


def reliabilities(patterns: list[str], counts: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Expectation maximisation over vote patterns: how each labeler votes on true and false
    candidates, and each pattern's chance to be true. Starts from the prior, which few
    candidates hardly move and many outweigh."""
    v = np.array([["n-y".index(c) for c in p] for p in patterns])
    taken = PRIOR[: v.shape[1]]
    trust = taken / taken.sum(2, keepdims=True)
    prior = np.array([0.5, 0.5])
    for turn in range(rounds + 1):
        log = np.log(prior)[None, :] + sum(np.log(trust[k][:, v[:, k]]).T for k in range(v.shape[1]))
        chance = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
        if turn < rounds:
            weight = np.stack([(1 - chance) * counts, chance * counts], 1)
            prior = (weight.sum(0) + 50) / (weight.sum() + 100)
            for k in range(v.shape[1]):
                for c in range(2):
                    seen = np.bincount(v[:, k], weight[:, c], 3) + taken[k, c]
                    trust[k, c] = seen / seen.sum()
    return trust, chance


def fit(cands: DataFrame, column: str = "candidates") -> Model:
    """From counts of vote and shape patterns over all candidates: a table of bounded size."""
    each = cands.select(F.explode(column).alias("c")).select("c.kind", "c.votes", "c.shape")
    rows = each.groupBy("kind", "votes", "shape").count().collect()
    model = Model()
    for kind in ALL_KINDS:
        own = sorted((r["votes"], r["shape"], r["count"]) for r in rows if r["kind"] == kind)
        if not own:
            continue
        patterns = sorted({x[0] for x in own})
        counts = np.array([sum(x[2] for x in own if x[0] == p) for p in patterns], float)
        model.trust[kind], chance = reliabilities(patterns, counts)
        wanted = np.array([chance[patterns.index(x[0])] for x in own])
        weight = np.array([x[2] for x in own], float)
        names = sorted({f for x in own for f in features(x[0], x[1])})
        x = np.array([[f in features(v, s) for f in names] for v, s, _ in own], float)
        w = np.zeros(len(names))
        for _ in range(300):  # gradient steps on the weighted, slightly shrunk log loss
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            w += 1.0 * (x.T @ (weight * (wanted - p)) / weight.sum() - 1e-3 * w)
        model.weights[kind] = dict(zip(names, w.tolist(), strict=True))
    return model


def accepted(column: Column, model: Model) -> Column:
    """The candidates that are strict matches or that the classifier accepts, in order."""

    @F.arrow_udf("array<boolean>")
    def judged(rows: pa.Array) -> pa.Array:
        memo: dict[tuple, bool] = {}

        def one(c: dict) -> bool:
            key = (c["kind"], c["votes"], c["shape"])
            if key not in memo:
                memo[key] = model.chance(*key) >= 0.5
            return bool(c["base"]) or memo[key]

        return pa.array(([one(c) for c in r.as_py()] for r in rows), pa.list_(pa.bool_()), size=len(rows))

    return F.transform(F.filter(F.arrays_zip(column.alias("c"), judged(column).alias("ok")), lambda z: z["ok"]), lambda z: z["c"])


def find_pii(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id and spans, array<struct<kind, start, end, base, votes, shape>>
    in code points, by kind (email, ip, card, phone, secret), then start.

    Null and empty texts have no span; texts of any length are read whole; rows that repeat
    have the same spans; null ids stay. Strict matches of different kinds may overlap, added
    spans overlap nothing. A candidate whose chance is just one half is added. An empty table
    gives no rows; other columns are ignored.
    """
    found = checkpointed(docs.select(F.col(id_col), candidate_spans(F.col(text_col)).alias("candidates")))
    return found.select(F.col(id_col), accepted(F.col("candidates"), fit(found)).alias("spans"))


def redact(docs: DataFrame, *, text_col: str = "text") -> DataFrame:
    """docs with each span of text_col replaced by its kind in angle brackets; spans that
    overlap are replaced as one, under the first one's kind. Null texts stay null, empty ones
    empty; rows that repeat are changed alike; columns of any name stay. An empty table stays
    empty. Candidates are found twice, which costs less than to store them with the texts."""
    model = fit(docs.select(candidate_spans(quoted(text_col)).alias("candidates")))

    @F.arrow_udf("string")
    def masked(texts: pa.Array) -> pa.Array:
        def one(text: str | None) -> str | None:
            if not text:
                return text
            out, at = [], 0
            for c in sorted(candidates(text), key=lambda c: (c["start"], -c["end"])):
                if c["base"] or model.chance(c["kind"], c["votes"], c["shape"]) >= 0.5:
                    if c["start"] >= at:
                        out += [text[at : c["start"]], f"<{c['kind'].upper()}>"]
                    at = max(at, c["end"])
            return "".join([*out, text[at:]])

        out = pa.array((one(t.as_py()) for t in texts), pa.string(), size=len(texts))
        tidy()
        return out

    clean = unused("clean", docs.columns)
    changed = docs.withColumn(clean, masked(quoted(text_col)))
    return changed.select(*(F.col(clean).alias(c) if c == text_col else quoted(c) for c in docs.columns))
