"""Personal data in whole texts, by weak supervision.

1. *Base.* Four strict forms (email, ip, card, phone) are taken as they stand.
2. *Candidates.* Looser spans, clusters of digits (apart from neighbours that a strict form takes in) and whatever looks like an address, are reduced to a few facts about form, checksum, word lists
   and surroundings; the facts of a span are one code of ``CODE_BITS`` bits.
3. *Votes.* Labelers look at the facts and vote for a kind, for none, or abstain: strict form, layout, checks, gazetteers, words before, signs at the
   edges. Spark counts the codes of all documents, a table that cannot outgrow its codes.
4. *Aggregation.* Expectation-maximisation over these counts estimates how often each labeler is right about each kind, and the probability of
   each kind for each code.
5. *Classifier.* A softmax over the facts is fitted to these probabilities, and a span that it gives to a kind with ``SURE`` or more is
   added where no base span lies. What is learned is a table of codes.

Texts are read once; spans and codes are stored, and the learned table is looked up there.

Defined results: a null or empty text has no spans. Positions are code points, ends exclusive. Every row gets its answer, also with a doc_id that
is null or repeated. Without candidates nothing is learned or added; an empty table gives no rows. Other columns are ignored. All patterns
take time in proportion to the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwarden.llm.tables import stored

KINDS = ("email", "ip", "card", "phone")
NONE, EMAIL, IP, CARD, PHONE = range(5)
ABSTAIN = 5
#: An added span is at least so probable.
SURE = 0.9
CONTEXT = 24

#: Words before a span that name its kind, or something else than personal data.
WORDS_BEFORE = {
    EMAIL: ["mail", "email", "e-mail", "correo", "courriel", "mailto"],
    IP: ["ip", "host", "server", "servidor", "serveur", "addr", "ping"],
    CARD: ["card", "visa", "mastercard", "amex", "tarjeta", "carte", "karte", "kreditkarte"],
    PHONE: ["tel", "phone", "call", "fax", "mobile", "cell", "telefon", "telefono", "teléfono", "téléphone", "whatsapp", "handy"],
    NONE: ["order", "invoice", "page", "version", "isbn", "token", "password", "key", "id", "no", "nr", "sha", "chapter", "year", "usd", "eur"],
}
#: Domains at the top that addresses end with.
TOP_DOMAINS = ["com", "org", "net", "edu", "gov", "info", "io", "eu", "de", "fr", "es", "uk", "us", "it", "nl", "ch", "at", "mx", "br", "jp", "cn"]
#: First digits of card numbers, and country codes with the digits that follow them at least.
ISSUERS = ("4", "51", "52", "53", "54", "55", "34", "37", "6011", "65", "35", "36")
COUNTRIES = ("1", "33", "34", "44", "49", "52", "55", "81", "86")

_AT_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_QUAD = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_DIGITS = re.compile(r"[0-9]++(?:[\x20-][0-9]++)*+")
_PLUS = re.compile(r"\+[0-9][\x20().0-9-]*+")
_CLUSTER = re.compile(r"[+(]?[0-9]++(?:[\x20().:/-]{1,2}+[0-9]++)*+")
_ALONE = re.compile(r"(?:\A|(?<=\x20))(?:[0-9]{13,19}|[0-9]{1,3}(?:\.[0-9]{1,3}){3})(?=\x20|\Z)")
_ADDRESS = re.compile(
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?@\x20?|\x20?[\[(](?:at|AT)[\])]\x20?)"
    r"[A-Za-z0-9-]++(?:(?:\.|\x20?[\[(](?:dot|DOT)[\])]\x20?)[A-Za-z0-9-]++)*+"
)
_STRICT_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_GROUP = re.compile(r"[0-9]+")
_WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")
_DATE = re.compile(r"(?:[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}|[0-9]{1,2}[./-][0-9]{1,2}[./-](?:[0-9]{4}|[0-9]{2}))\Z")
_LOCAL_PHONE = re.compile(r"(?:\([0-9]{2,4}\)\x20?|[0-9]{2,4}[\x20./-])[0-9]{3,4}[\x20./-][0-9]{3,4}\Z")

(PLAIN, GROUPED, DOTTED, LOCAL_PHONE, PLUS, DATE, DECIMAL, STRICT, HIDDEN, HOST, OTHER) = range(11)
#: Facts and their bits, from the low end.
FACTS = {"form": 4, "digits": 3, "groups": 3, "luhn": 1, "bytes": 1, "listed": 3, "before": 3, "edges": 2}
CODE_BITS = sum(FACTS.values())
ISSUER, COUNTRY, DOMAIN, NO_DOMAIN, RESERVED = range(1, 6)
_FOUND = "doc_id long, base array<struct<kind:int,start:int,end:int>>, loose array<struct<code:int,start:int,end:int>>"
SPANS = "array<struct<kind:int,start:int,end:int>>"


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the strict forms, by kind, then start; within a kind leftmost and without overlaps."""
    found, end = [], 0
    if "@" in text:
        for m in _AT_DOMAIN.finditer(text):
            before = text[end : m.start()]
            size = len(before) - len(before.rstrip(_LOCAL))
            if size:
                found.append((EMAIL, m.start() - size, m.end()))
            end = m.end() if size else m.start() + 1
    if "." in text:
        found += [(IP, *m.span()) for m in _QUAD.finditer(text) if all(_is_byte(x) for x in m.groups())]
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 16:
            whole = m.group()
            n = len(whole) - whole.count(" ") - whole.count("-")
            if 16 <= n <= 19 and luhn(whole.replace(" ", "").replace("-", "")):
                found.append((CARD, *m.span()))
    if "+" in text:
        for m in _PLUS.finditer(text):
            whole = m.group().rstrip(" ().-")
            if len(whole) > 3 and 8 <= sum(map(str.isdigit, whole)) <= 15:
                found.append((PHONE, m.start(), m.start() + len(whole)))
    return found


def _is_byte(digits: str) -> bool:
    short = digits.lstrip("0")
    return len(short) <= 3 and int(short or 0) <= 255


def _bucket(n: int) -> int:
    return sum(n >= least for least in (7, 8, 10, 13, 16, 17, 20))


def facts(text: str, start: int, end: int, address: bool) -> int:
    """The code of what is known about a span."""
    span = text[start:end]
    known = dict.fromkeys(FACTS, 0)
    if address:
        top = re.split(r"[.\])\x20]+", span)[-1].lower()
        tail = span[span.rindex("@") + 1 :] if "@" in span else span
        known["form"] = STRICT if _STRICT_ADDRESS.fullmatch(span) else HIDDEN if "." in tail or "dot" in tail.lower() else HOST
        known["listed"] = DOMAIN if top in TOP_DOMAINS else NO_DOMAIN
    else:
        groups = _GROUP.findall(span[:64]) if len(span) <= 64 else [span] * 8
        digits = "".join(groups) if len(span) <= 64 else span
        known["digits"], known["groups"] = _bucket(len(digits)), min(len(groups), 7)
        separators = {c for c in span[:64] if not c.isdigit()}
        known["luhn"] = int(13 <= len(digits) <= 19 and luhn(digits))
        dotted = separators == {"."}
        known["bytes"] = int(dotted and len(groups) == 4 and all(_is_byte(g) for g in groups))
        if span[0] == "+":
            known["form"] = PLUS
        elif not separators:
            known["form"] = PLAIN
        elif _DATE.match(span):
            known["form"] = DATE
        elif _LOCAL_PHONE.match(span):
            known["form"] = LOCAL_PHONE
        elif dotted:
            known["form"] = DECIMAL if len(groups) == 2 else DOTTED
        elif separators <= {" "} or separators <= {"-"}:
            known["form"] = GROUPED
        else:
            known["form"] = OTHER
        if known["form"] == PLUS:
            known["listed"] = COUNTRY if digits.startswith(COUNTRIES) else 0
        elif known["bytes"]:
            known["listed"] = RESERVED if groups[0] in ("0", "255") else 0
        elif 13 <= len(digits) <= 19 and digits.startswith(ISSUERS):
            known["listed"] = ISSUER
    words = [w.lower() for w in _WORD.findall(text[max(0, start - CONTEXT) : start])][-3:]
    known["before"] = next((1 + kind for w in reversed(words) for kind, some in WORDS_BEFORE.items() if w in some), 0)
    left, right = text[start - 1 : start], text[end : end + 1]
    known["edges"] = int(left.isalnum() or left in ('"', "_", "=", "#", "$")) * bool(left) + 2 * int(bool(right) and (right.isalnum() or right in "_%=#$"))
    code, at = 0, 0
    for name, bits in FACTS.items():
        code |= known[name] << at
        at += bits
    return code


def unpacked(codes: np.ndarray) -> dict[str, np.ndarray]:
    """The facts of each code."""
    made, at = {}, 0
    for name, bits in FACTS.items():
        made[name] = (codes >> at) & ((1 << bits) - 1)
        at += bits
    return made


def pieces(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """A cluster of digits, cut where blanks set apart a long number or a quad: what stands next to these is not part of them."""
    at = start
    for m in _ALONE.finditer(text[start:end]):
        yield from _trimmed(text, at, start + m.start())
        yield start + m.start(), start + m.end()
        at = start + m.end()
    yield from _trimmed(text, at, end)


def _trimmed(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    left = text[start:end].lstrip(" ).:/-")
    whole = left.rstrip(" ().:/-")
    if whole:
        start = end - len(left)
        yield start, start + len(whole)


def loose_spans(text: str) -> list[tuple[int, int, int]]:
    """(code, start, end) of everything that could be personal data. Addresses hide the clusters of digits inside them."""
    found = []
    if "@" in text or "at]" in text or "at)" in text or "AT]" in text or "AT)" in text:
        found = [(facts(text, *m.span(), True), *m.span()) for m in _ADDRESS.finditer(text)]
    taken, k = [(s, e) for _, s, e in found], 0
    for m in _CLUSTER.finditer(text):
        start, end = m.span()
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if k == len(taken) or end <= taken[k][0]:
            found += [(facts(text, a, b, False), a, b) for a, b in pieces(text, start, end)]
    return found


def votes(codes: np.ndarray) -> np.ndarray:
    """One column a labeler: the kind that it votes for, ``NONE`` or ``ABSTAIN``."""
    f = unpacked(codes)
    form, digits, groups, listed = f["form"], f["digits"], f["groups"], f["listed"]
    long, cardlike = (digits >= 4) & (digits <= 6), (digits == 5) | (digits == 6)
    quad = (form == DOTTED) & (groups == 4)
    rows = [
        # strict form
        [(form == STRICT, EMAIL), (quad & (f["bytes"] == 1), IP), (((form == PLAIN) | (form == GROUPED)) & cardlike & (f["luhn"] == 1), CARD),
         ((form == PLUS) & (digits >= 2) & (digits <= 4), PHONE), ((form == DATE) | (form == DECIMAL), NONE)],
        # layout
        [((form == STRICT) | (form == HIDDEN), EMAIL), (form == HOST, NONE), ((form == LOCAL_PHONE) | (form == PLUS), PHONE), (quad, IP),
         ((form == GROUPED) & (groups == 4) & (digits == 5), CARD), ((form == PLAIN) & (digits == 5), CARD), ((form == PLAIN) & (digits <= 1), NONE), (digits == 7, NONE)],
        # checksum and ranges
        [((f["luhn"] == 1) & long, CARD), (cardlike & (f["luhn"] == 0), NONE), (quad & (f["bytes"] == 0), NONE), (f["bytes"] == 1, IP), ((form == PLUS) & (digits > 4), NONE)],
        # gazetteers
        [(listed == ISSUER, CARD), (listed == COUNTRY, PHONE), (listed == DOMAIN, EMAIL), (listed == NO_DOMAIN, NONE), (listed == RESERVED, NONE)],
        # words before
        [(f["before"] == 1 + kind, kind) for kind in (EMAIL, IP, CARD, PHONE, NONE)],
        # signs at the edges
        [(f["edges"] > 0, NONE)],
    ]
    made = np.full((len(codes), len(rows)), ABSTAIN)
    for at, rules in enumerate(rows):
        for hit, vote in reversed(rules):
            made[hit, at] = vote
    return made


def aggregated(cast: np.ndarray, counts: np.ndarray, steps: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of the kinds for each row of votes, and each labeler's shares of votes by true kind.

    Abstaining tells nothing. Labelers are taken for better than chance to begin with.
    """
    n, labelers = cast.shape
    told = np.eye(6)[cast][:, :, :5]
    sure = told.sum(1) + 0.1 * np.eye(5)[NONE]
    sure /= sure.sum(1, keepdims=True)
    right = np.zeros((labelers, 5, 5))
    for _ in range(steps):
        share = (sure * counts[:, None]).sum(0) + 1
        right = np.einsum("nk,nlv,n->lkv", sure, told, counts) + np.eye(5) * 4 + 0.5
        right /= right.sum(2, keepdims=True)
        level = np.log(share / share.sum()) + np.einsum("nlv,lkv->nk", told, np.log(right))
        new = np.exp(level - level.max(1, keepdims=True))
        new /= new.sum(1, keepdims=True)
        if n and np.abs(new - sure).max() < 1e-9:
            break
        sure = new
    return sure, right


def inputs(codes: np.ndarray) -> np.ndarray:
    """Facts as zeros and ones: each value of each fact, and form with checks."""
    f = unpacked(codes)
    columns = [np.ones(len(codes))]
    for name, bits in FACTS.items():
        columns += [f[name] == v for v in range(1 << bits)]
    columns += [(f["form"] == form) & (f["digits"] == d) for form in (PLAIN, GROUPED, PLUS, LOCAL_PHONE, OTHER) for d in range(8)]
    columns += [(f["luhn"] == 1) & (f["digits"] == d) for d in range(4, 7)]
    return np.stack(columns, 1).astype(np.float64)


def softmax_fit(x: np.ndarray, sure: np.ndarray, weight: np.ndarray, steps: int = 600, penalty: float = 1e-4) -> np.ndarray:
    """Weights of a softmax fitted to probabilities, by accelerated gradient steps."""
    w = ahead = np.zeros((x.shape[1], sure.shape[1]))
    share = weight / weight.sum()
    step = 1 / (0.5 * float((x.sum(1) * share).max() if len(x) == 1 else np.linalg.norm(x * np.sqrt(share)[:, None], 2) ** 2) + penalty)
    for k in range(steps):
        slope = x.T @ (share[:, None] * (_softmax(x @ ahead) - sure)) + penalty * ahead
        new = ahead - step * slope
        ahead, w = new + k / (k + 3) * (new - w), new
    return w


def _softmax(level: np.ndarray) -> np.ndarray:
    made = np.exp(level - level.max(1, keepdims=True))
    return made / made.sum(1, keepdims=True)


@dataclass(frozen=True)
class Detector:
    """What the corpus has taught: the kind of each code that is personal data surely enough, and the labelers' reliabilities."""

    kinds: dict[int, int]
    reliabilities: np.ndarray


def learned(codes: np.ndarray, counts: np.ndarray, sure: float = SURE) -> Detector:
    """From the counts of all codes; codes that are met often weigh as the root of their counts in the classifier."""
    if not len(codes):
        return Detector({}, np.zeros((0, 5, 5)))
    likely, right = aggregated(votes(codes), counts.astype(np.float64))
    x = inputs(codes)
    made = _softmax(x @ softmax_fit(x, likely, np.sqrt(counts.astype(np.float64))))
    kind = made.argmax(1)
    good = (kind != NONE) & (made.max(1) >= sure)
    return Detector(dict(zip(codes[good].tolist(), kind[good].tolist(), strict=True)), right)


def _scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = [pa.field("start", pa.int32()), pa.field("end", pa.int32())]
    for batch in batches:
        base, loose = [], []
        for text in batch.column("text").to_pylist():
            some = bool(text)
            base.append([{"kind": k, "start": s, "end": e} for k, s, e in base_spans(text)] if some else [])
            loose.append([{"code": k, "start": s, "end": e} for k, s, e in loose_spans(text)] if some else [])
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(base, pa.list_(pa.struct([pa.field("kind", pa.int32()), *span]))),
                pa.array(loose, pa.list_(pa.struct([pa.field("code", pa.int32()), *span]))),
            ],
            names=["doc_id", "base", "loose"],
        )


def detector(found: DataFrame, sure: float = SURE) -> Detector:
    """Learn from all candidates; the driver gets one row a code, 2**CODE_BITS at most."""
    counted = found.select(F.explode("loose.code").alias("code")).groupBy("code").agg(F.count("*").alias("n")).collect()
    rows = sorted((r["code"], r["n"]) for r in counted)
    return learned(np.array([c for c, _ in rows], np.int64), np.array([n for _, n in rows], np.int64), sure)


def _added(kinds: dict[int, int]):
    """All spans: the base ones and the candidates of learned codes that touch none of them, by kind, then start."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = []
            for base, loose in zip(batch.column("base").to_pylist(), batch.column("loose").to_pylist(), strict=True):
                whole = [(r["kind"], r["start"], r["end"]) for r in base]
                taken, k, more = sorted((s, e) for _, s, e in whole), 0, []
                for r in sorted(loose, key=lambda r: r["start"]):
                    kind = kinds.get(r["code"])
                    if kind is None:
                        continue
                    while k < len(taken) and taken[k][1] <= r["start"]:
                        k += 1
                    if k == len(taken) or r["end"] <= taken[k][0]:
                        more.append((kind, r["start"], r["end"]))
                spans.append([{"kind": a, "start": b, "end": c} for a, b, c in sorted(whole + more)])
            span = pa.struct([pa.field(c, pa.int32()) for c in ("kind", "start", "end")])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("base"), pa.array(spans, pa.list_(span))], names=["doc_id", "base", "spans"]
            )

    return made


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, the base spans and the candidates of every row (stored)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return stored(rows.mapInArrow(_scanned, _FOUND), "private-spans")


def find(docs: DataFrame, sure: float = SURE) -> DataFrame:
    """Every row: doc_id, base and spans, each a list of (kind, start, end); kind k is ``KINDS[k - 1]``."""
    found = scanned(docs)
    model = detector(found, sure)
    return found.mapInArrow(_added(model.kinds), f"doc_id long, base {SPANS}, spans {SPANS}")
