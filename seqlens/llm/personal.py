"""Personal data by weak supervision (operator 9).

Base spans are those of four patterns, leftmost and not overlapping within a kind, that pass a check: email, ip (parts at most 255), card (13 to 19 digits, Luhn), phone (9 to 15 digits). They always stay.
Looser patterns give further candidates beside them: emails written out with "at" and "dot" or without a dot, phone numbers without a plus, numbers of a card's length, dotted quads out of range.
Four labelers vote for, against or not at all on every span and candidate: the base pattern, the form (check digits, ranges, digit counts), a gazetteer (top-level domains, issuer and network prefixes, toll-free and area codes) and the words around.
For each kind expectation-maximisation over the counts of vote patterns estimates how often a candidate is real and how reliable each labeler is. A logistic classifier over votes and shape is then trained towards those posteriors; a candidate that it gives half or more becomes a span.

Null text is empty: no spans. Positions are code points, ends exclusive. Every row of the table gives a row.
Plan. Texts are read once, in place. What is learned from is the number of candidates of each pattern over all documents: a table whose size the patterns bound, not the input.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("pattern", "form", "gazetteer", "context")
#: How often each is taken to be right before anything is counted: a check digit says more than a known prefix. Weighs as five candidates.
BELIEFS = (0.9, 0.9, 0.7, 0.75)

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"(?=[0-9][ -]?[0-9])[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_LOOSE = {
    "email": re.compile(r"(?<![\w.+-])[A-Za-z0-9][\w.+-]{0,63} ?(?:\[at\]|\(at\)| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\[dot\]|\(dot\)| dot ) ?[A-Za-z]{2,24}){1,4}\b|(?<![\w.+%-])[A-Za-z0-9][\w.+-]{0,63}@[A-Za-z0-9-]{1,63}(?![\w.-])", re.A),
    "phone": re.compile(r"(?<![\w+(.-])(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![\w-])", re.A),
}
# Words that speak for and against a kind near it.
_FOR = {"email": {"email", "mail", "contact", "write", "correo", "courriel"}, "ip": {"ip", "host", "server", "address", "client", "login"}, "card": {"card", "visa", "mastercard", "credit", "payment", "karte", "carte", "tarjeta"}, "phone": {"phone", "tel", "call", "mobile", "fax", "telefon", "téléphone", "teléfono"}}
_AGAINST = {"version", "v", "release", "isbn", "order", "invoice", "ref", "id", "page", "section", "token", "serial"}
# Top-level domains, first digits of card issuers and reserved first parts of addresses.
_DOMAINS = {"com", "org", "net", "edu", "gov", "io", "info", "de", "fr", "es", "uk", "eu", "us", "example", "test"}
_ISSUERS = re.compile(r"4|5[1-5]|2[2-7]|3[4-79]|6(?:011|5|4[4-9])|62")
_RESERVED = re.compile(r"0*(?:0|2[4-9][0-9])\.")
_WORDS = re.compile(r"[^\W\d_]+")


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _parts_fit(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in text.split("."))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind as listed, then start."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        if domain := _DOMAIN.match(text, at + 1):
            low = at
            while low > end and text[low - 1] in _LOCAL:
                low -= 1
            if low < at:
                out.append(("email", low, domain.end()))
                end = domain.end()
        at = text.find("@", max(at + 1, end))
    if _DIGIT.search(text):
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if _parts_fit(m[0])]
        out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
        if "+" in text:
            out += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


def loose_spans(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Further candidates, none of them over a base span or an earlier candidate."""
    out, has_digit = [], bool(_DIGIT.search(text))
    if "@" in text or " at " in text or "[at]" in text or "(at)" in text:
        out += [("email", m.start(), m.end()) for m in _LOOSE["email"].finditer(text)]
    if has_digit:
        out += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if not _parts_fit(m[0])]
        out += [("card", m.start(), m.end()) for m in _CARD.finditer(text) if m.end() - m.start() >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and not luhn(d)]
        out += [("phone", m.start(), m.end()) for m in _LOOSE["phone"].finditer(text)]
    taken, kept = sorted((a, b) for _, a, b in base), []
    held = -1
    order = sorted(out, key=lambda s: (s[1], -s[2], KINDS.index(s[0])))
    k = 0
    reach = 0
    for kind, a, b in order:
        while k < len(taken) and taken[k][0] < b:
            reach = max(reach, taken[k][1])
            k += 1
        if a >= held and a >= reach:
            kept.append((kind, a, b))
            held = b
    return kept


def votes(text: str, kind: str, start: int, end: int, base: bool) -> str:
    """One character for each labeler: + for, - against, 0 neither."""
    found, digits = text[start:end], _digits(text[start:end])
    if kind == "email":
        form = "+" if "." in found.rpartition("@")[2] or "dot" in found else "-"
        place = "+" if re.split(r"[^A-Za-z0-9]+", found.lower())[-1] in _DOMAINS else "0"
    elif kind == "ip":
        form, place = ("+" if _parts_fit(found) else "-"), ("-" if _RESERVED.match(found) else "0")
    elif kind == "card":
        form, place = ("+" if luhn(digits) else "-"), ("+" if _ISSUERS.match(digits) else "0")
    else:
        form = "+" if 9 <= len(digits) <= 15 and len(set(digits)) > 2 else "-"
        place = "+" if "555" in digits or found.startswith(("+1", "+33", "+34", "+49", "+44", "(")) else "0"
    near = set(_WORDS.findall(text[max(0, start - 48) : start].lower())[-4:]) | set(_WORDS.findall(text[end : end + 24].lower())[:2])
    around = "+" if near & _FOR[kind] else "-" if near & _AGAINST else "0"
    return ("+" if base else "0") + form + place + around


def shape(found: str) -> str:
    """Length, share of digits and kinds of separators, in few classes."""
    return f"{min(len(found) // 8, 4)}{4 * len(_digits(found)) // max(len(found), 1)}{min(3, len(set(re.sub(r'[A-Za-z0-9]', '', found))))}"


def reliabilities(counts: dict[str, float], rounds: int = 50) -> tuple[dict[str, float], float, list[float]]:
    """Expectation-maximisation over counts of vote patterns: each pattern's posterior, the share of real ones, and each labeler's accuracy when it votes.

    Spans that the base pattern finds and looser candidates are two mixtures with a share of their own each, so that many base spans don't make every candidate likely; the labelers' accuracies are the same in both."""
    score = lambda v: (v == "+") - (v == "-")
    share, shares, right = 0.5, {}, list(BELIEFS)
    post = {p: 1 / (1 + math.exp(-sum(score(v) * math.log(r / (1 - r)) for v, r in zip(p, right)))) for p in counts}
    for _ in range(rounds):
        for loose in (False, True):
            ours = [p for p in counts if (p[0] == "0") == loose]
            shares[loose] = (1 + sum(counts[p] * post[p] for p in ours)) / (sum(counts[p] for p in ours) + 2)
        share = (1 + sum(n * post[p] for p, n in counts.items())) / (sum(counts.values()) + 2)
        for j in range(len(LABELERS)):
            held = sum(n for p, n in counts.items() if p[j] != "0")
            good = sum(n * (post[p] if p[j] == "+" else 1 - post[p]) for p, n in counts.items() if p[j] != "0")
            right[j] = min(0.99, max(0.55, (good + 5 * BELIEFS[j]) / (held + 5)))  # a labeler is better than chance
        post = {p: 1 / (1 + math.exp(-math.log(shares[p[0] == "0"] / (1 - shares[p[0] == "0"])) - sum(score(v) * math.log(r / (1 - r)) for v, r in zip(p, right)))) for p in counts}
    return post, share, right


def classifier(counts: dict[tuple[str, str, str], int]) -> dict[tuple[str, str, str], float]:
    """Probability of each (kind, votes, shape), by a logistic regression towards the posteriors of the labelers' model."""
    by_kind: dict[str, dict[str, float]] = defaultdict(lambda: defaultdict(float))
    for (kind, vote, _), n in counts.items():
        by_kind[kind][vote] += n
    post = {kind: reliabilities(c)[0] for kind, c in by_kind.items()}
    rows = sorted(counts)
    names = {x: i for i, x in enumerate(sorted({f for k, v, s in rows for f in _features(k, v, s)}))}
    x = np.zeros((len(rows), len(names)))
    for i, row in enumerate(rows):
        x[i, [names[f] for f in _features(*row)]] = 1
    y = np.array([post[k][v] for k, v, _ in rows])
    w = np.log1p(np.array([counts[r] for r in rows], float))
    weights = np.zeros(len(names))
    for _ in range(500):
        p = 1 / (1 + np.exp(-x @ weights))
        weights -= 2.0 * (x.T @ (w * (p - y)) / w.sum() + 1e-4 * weights) if len(rows) else 0
    p = 1 / (1 + np.exp(-x @ weights))
    return {r: float(q) for r, q in zip(rows, p)}


def _features(kind: str, vote: str, form: str) -> list[str]:
    return [kind, *(f"{kind}{j}{v}" for j, v in enumerate(vote)), *(f"{kind}s{j}{v}" for j, v in enumerate(form))]


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.string()), ("shape", pa.string())])
    for batch in batches:
        for part, texts in slices(batch, "text"):
            out = []
            for text in texts.to_pylist():
                base = base_spans(text)
                rows = [(s, True) for s in base] + [(s, False) for s in loose_spans(text, base)]
                out.append([{"kind": KINDS.index(k), "start": a, "end": b, "base": is_base, "votes": votes(text, k, a, b, is_base), "shape": shape(text[a:b])} for (k, a, b), is_base in rows])
            yield pa.record_batch([part.column("doc_id"), pa.array(out, pa.list_(span))], ["doc_id", "found"])


def personal_data(docs: DataFrame) -> DataFrame:
    """Of each row of docs: doc_id, found: array of (kind, start, end, base, votes, shape), those that stay, by kind as listed and start."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    kind = "struct<kind: int, start: int, end: int, base: boolean, votes: string, shape: string>"
    found = written(docs.mapInArrow(_candidates, f"doc_id long, found array<{kind}>"), "candidates")
    each = found.select(F.explode("found").alias("x")).groupBy("x.kind", "x.votes", "x.shape").count()
    counts = {(KINDS[r[0]], r[1], r[2]): r[3] for r in each.collect()}  # bounded: kinds x votes x shapes
    good = sorted(f"{KINDS.index(k)}{v}{s}" for (k, v, s), p in classifier(counts).items() if p >= 0.5)
    keep = F.array(*map(F.lit, good)) if good else F.array().cast("array<string>")
    stays = F.filter("found", lambda x: x["base"] | F.array_contains(keep, F.concat(x["kind"].cast("string"), x["votes"], x["shape"])))
    return found.select("doc_id", F.array_sort(stays).alias("found"))


def digests(found: DataFrame) -> DataFrame:
    """doc_id, counts of the base spans by kind, base_sha256 and spans."""
    names = F.array(*map(F.lit, KINDS))
    text = lambda x: F.concat(F.element_at(names, x["kind"] + 1), F.lit(":"), x["start"].cast("string"), F.lit(":"), x["end"].cast("string"))
    base = F.filter("found", lambda x: x["base"])
    of_kind = lambda i: F.filter("found", lambda x: x["base"] & (x["kind"] == i))
    count = [F.size(of_kind(i)).cast("long").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *count, F.sha2(F.array_join(F.transform(base, text), ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("found", text), ",").alias("spans"))
