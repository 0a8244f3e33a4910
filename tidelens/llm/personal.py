"""Personal data with weak supervision (operator 8).

Four base patterns with their checks report emails, addresses of hosts, cards and phones.  The method looks further: spans that
might be personal (numbers in groups, written-out mail addresses, names after a title) are shown to labelers that vote for,
against or not at all: form, check digits, a gazetteer of words for contact data, a context of prices and versions, nearby
base spans.  How often each pattern of votes occurs in the whole corpus is counted by Spark; expectation-maximisation on that
table (bounded by the number of patterns) estimates how reliable each labeler is; a logistic classifier learns its
posteriors from the span's features.  Spans it is sure of are added.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .secrets import cover, span_rows

#: Order of kinds and base patterns.  An email is found from its @, which no part before it may hold.
KINDS = ("email", "ip", "card", "phone", "number", "mail", "person")
BASE = KINDS[:4]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")

#: Candidates of the method, and the word lists of its labelers.
NUMBER = re.compile(r"(?<![\w.+-])\(?[0-9]{2,}(?:[\x20./()-]{1,2}[0-9]{2,}){1,5}(?![\w-])")
MAIL = re.compile(r"(?<!\w)[\w.-]{2,40}\s?(?:\(at\)|\[at\]|\{at\}|\sat\s)\s?[\w-]{2,40}(?:\s?(?:\(dot\)|\[dot\]|\{dot\}|\sdot\s)\s?[A-Za-z]{2,20}){1,3}(?!\w)")
PERSON = re.compile(r"(?<!\w)(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Monsieur|Madame|Mme|Señor|Señora|Sr|Sra)\.?\x20[A-ZÀ-ÝÄÖÜ][\w'-]{1,30}(?:\x20[A-ZÀ-ÝÄÖÜ][\w'-]{1,30}){1,2}(?!\w)")
CONTACT = re.compile(r"\b(?:phone|telephone|tel|mobile|cell|call|fax|contact|reach|write|email|e-mail|mail|ssn|passport|iban|account|patient|born|name|telefon|handy|anruf|konto|correo|teléfono|móvil|cuenta|courriel|téléphone|compte)\b\W{0,3}(?:\w+\W{1,2}){0,2}$", re.IGNORECASE)
CONTRARY = re.compile(r"(?:[$€£#§]|\b(?:version|release|page|pages|chapter|section|isbn|issn|doi|figure|table|total|price|year|lines?|port|code|seite|página))\W{0,3}$", re.IGNORECASE)
REACH = 40
SURE = 0.9
LABELERS = 5
#: Votes for and against that every labeler starts with, on spans that are not personal and on those that are.
SMOOTH = np.array([[2.0, 8.0], [8.0, 2.0]])


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[str, int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        host = HOST.match(text, at + 1) if start < at else None
        if host:
            yield "email", start, host.end()
            end = host.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping spans of every base kind; matches that fail their check are dropped, not tried again."""
    out = list(_emails(text)) if "@" in text else []
    if not DIGIT.search(text):
        return out
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (q.lstrip("0") for q in m[0].split("."))):
            out.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def candidates(text: str, base: Sequence[tuple[str, int, int]]) -> Iterator[tuple[str, int, int, str]]:
    """(kind, start, end, pattern) of every span to judge: the base ones and further ones that touch none of them.

    The pattern is the kind, the votes of the labelers (+, - or 0) and a class of the span's length.
    """
    spans = list(base)
    free = cover(base)
    if DIGIT.search(text):
        spans += [("number", m.start(), m.end()) for m in NUMBER.finditer(text) if 7 <= sum(c.isdigit() for c in m[0]) <= 19 and free(*m.span())]
    if "dot" in text:
        spans += [("mail", m.start(), m.end()) for m in MAIL.finditer(text) if free(*m.span())]
    if any(t in text for t in ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Mon", "Mad", "Mme", "Se", "Sr")):
        spans += [("person", m.start(), m.end()) for m in PERSON.finditer(text) if free(*m.span())]
    starts, ends = sorted(a for _, a, _ in base), sorted(b for _, _, b in base)
    some = lambda places, least, most: bisect_left(places, least) < bisect_right(places, most)
    for kind, a, b in spans:
        value, before = text[a:b], text[max(0, a - REACH) : a]
        digits = [c for c in value if c.isdigit()]
        form = "+" if kind in BASE or kind in ("mail", "person") else "+" if re.fullmatch(r"\(?\d{2,4}\)?[ ./-]\d{3,4}[ ./-]\d{2,5}|\d{3}-\d{2}-\d{4}", value) else "-" if len(digits) < 9 else "0"
        check = "+" if kind in BASE else "-" if kind == "number" and len(digits) >= 14 else "0"
        gazetteer = "+" if CONTACT.search(before) else "0"
        contrary = "-" if CONTRARY.search(before) or (kind == "number" and re.search(r"\d\s*[./]\s*\d{1,2}\s*[./]\s*(?:19|20)\d\d$", value)) else "0"
        near = "+" if some(ends, a - 2 * REACH, a - 1) or some(starts, b + 1, b + 2 * REACH) else "0"
        yield kind, a, b, f"{kind}|{form}{check}{gazetteer}{contrary}{near}|{min(len(value) // 8, 4)}"


def reliabilities(patterns: Sequence[str], counts: np.ndarray, rounds: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """Posterior that each pattern is personal, and P(vote | personal or not) of each labeler, by expectation-maximisation.

    Base spans have passed their checks and stay personal.  The rest starts from the majority of votes; a labeler that does not vote says nothing, and smoothing starts every labeler as
    right in four of five votes.
    """
    votes = np.array([["0+-".index(v) for v in p.split("|")[1]] for p in patterns])
    sure = np.array([p.split("|")[0] in BASE for p in patterns])
    post = np.where(sure, 1.0, [(1 + 2 * (v == 1).sum()) / (2 + 2 * ((v == 1).sum() + (v == 2).sum())) for v in votes])
    table = np.zeros((LABELERS, 2, 2))
    cast = [np.flatnonzero(votes[:, k]) for k in range(LABELERS)]
    for _ in range(rounds):
        for label, weight in ((0, counts * (1 - post)), (1, counts * post)):
            for k, at in enumerate(cast):
                table[k, label] = np.bincount(votes[at, k] - 1, weight[at], 2) + SMOOTH[label]
                table[k, label] /= table[k, label].sum()
        prior = np.clip((counts * post)[~sure].sum() / max(counts[~sure].sum(), 1), 0.2, 0.5)
        odds = np.full(len(votes), np.log(prior / (1 - prior)))
        for k, at in enumerate(cast):
            odds[at] += np.log(table[k, 1, votes[at, k] - 1] / table[k, 0, votes[at, k] - 1])
        new = np.where(sure, 1.0, 1 / (1 + np.exp(-odds)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return post, table


def _features(pattern: str) -> np.ndarray:
    kind, votes, size = pattern.split("|")
    return np.array([1.0, *(kind == k for k in KINDS), *(v == "+" for v in votes), *(v == "-" for v in votes), int(size) / 4])


def classifier(patterns: Sequence[str], counts: np.ndarray, rounds: int = 300) -> dict[str, float]:
    """Probability of each pattern by a logistic classifier that learned the posteriors, weighted by how often they occur."""
    if len(patterns) == 0:
        return {}
    x, (y, _) = np.stack([_features(p) for p in patterns]), reliabilities(patterns, counts)
    weight, w = np.sqrt(counts) / np.sqrt(counts).sum(), np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-x @ w))
        slope = x.T @ (weight * (p - y)) + 1e-3 * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return dict(zip(patterns, 1 / (1 + np.exp(-x @ w))))


def _patterns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[str, int] = {}
        for value in batch.column("text"):
            text = value.as_py() or ""
            for *_, pattern in candidates(text, base_spans(text)):
                seen[pattern] = seen.get(pattern, 0) + 1
        yield pa.record_batch({"pattern": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})


def learn(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """Probability of every pattern of the corpus; there are at most a few thousand patterns, whatever the corpus."""
    rows = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(_patterns, "pattern string, n long")
    table = rows.groupBy("pattern").agg(F.sum("n").alias("n")).orderBy("pattern").collect()
    return classifier([r["pattern"] for r in table], np.array([r["n"] for r in table], float))


def find(text: str | None, known: dict[str, float], sure: float = SURE) -> list[tuple[str, int, int]]:
    """Base spans and the further ones whose probability is ``sure`` or more, in order of start, then kind."""
    text = text or ""
    base = base_spans(text)
    more = [(kind, a, b) for kind, a, b, pattern in candidates(text, base) if kind not in BASE and known.get(pattern, 0.0) >= sure]
    return sorted(base + more, key=lambda s: (s[1], KINDS.index(s[0])))


def scan(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",), sure: float = SURE) -> DataFrame:
    """Columns ``keep`` of every row with ``spans``: array of (kind, start, end), code points, end exclusive.

    Null and empty texts have none; rows keep their multiplicity and null keys; other columns are not read; an empty table
    gives an empty one.
    """
    known = learn(docs, text)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(span_rows(lambda t: find(t, known, sure)), f"row {kind}, spans array<struct<kind:string,start:int,end:int>>").select("row.*", "spans")
