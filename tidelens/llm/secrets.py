"""Secret scans with dictionary-primed zstandard novelty (operator 6).

Three base patterns report what looks like a secret by form.  The method adds ``novel`` spans: strings in a sensitive
context (a word such as *key* or *credential* shortly before them) whose marginal cost is high, that is, which cost almost
as many bytes as random text when a compressor already knows the surrounding text and a dictionary of identifiers.
Prose, names and repeated identifiers compress; keys and passwords do not.  A long string is coded in pieces, because a coder
learns the letters of a long one.  A key that is broken into lines is one span, up to its END mark if it has one.

Every document is judged by itself, so the job is one pass over the rows without a shuffle.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

#: The order of kinds and the patterns of the base ones.
KINDS = ("assign", "access", "hex", "novel")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Words that make what follows sensitive, and characters between such a word and the string.
SENSITIVE = re.compile(r"(?:passphrase|passw(?:or)?d|secret|credential|bearer|authorization|private[ _-]?key|access[ _-]?key|api[ _-]?key|client[ _-]?key|auth[ _-]?token|token)", re.IGNORECASE | re.ASCII)
REACH = 40
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=~!@#$%^&*-]{12,}")
#: A mail address without digits is personal data (operator 8), not a secret.
ADDRESS = re.compile(r"[A-Za-z._%+-]+@[A-Za-z-]+(?:\.[A-Za-z-]+)+", re.ASCII)
#: Identifiers and words of code that are known beforehand.
IDENTIFIERS = (
    "access account address admin api application argument array assert async authorization await base64 bearer begin boolean bucket bytes cache callback certificate class client code "
    "config connection const content context cookie count credential data database debug decode default define delete description device digest document domain double element email encode "
    "endpoint environment error event example except export extends false file filter final float format function gateway generate global hash header host http https identifier import index "
    "information input instance integer interface internal issuer item json key label lambda length level library license list local location login manager message metadata method module "
    "name namespace network none null number object option output package param parameter password path pattern payload permission placeholder platform port private process production "
    "profile project property protocol provider public query random record region registry request required response result return role schema scope script secret secure select self "
    "server service session setting signature source staging static status storage string struct subject super table tenant test thread timeout timestamp token true type undefined "
    "update upload user username value variable vector version void volume while window your_api_key your_password changeme xxxxxxxx 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ"
)
CONTEXT = 400
#: Most characters that are coded at a time.
PIECE = 64
#: Keys over several lines (line ends may be escaped, lines indented), and what stands between the words *private key* and the first line of one.
EOL = r"[ \t]*(?:\r?\n|(?:\\r)?\\n)[ \t]*"
LINE = re.compile(EOL + r"""([A-Za-z0-9+/=_-]+)(?=[ \t]*(?:\r?\n|\\r|\\n|["']|\Z))""", re.ASCII)
KEY = re.compile(r"[A-Za-z0-9+/=_-]+", re.ASCII)
BEGIN = re.compile(r"-----BEGIN [A-Z0-9 ]*\Z")
HEAD = re.compile(rf"(?: BLOCK)?-----(?:{EOL}[A-Za-z][A-Za-z0-9-]*:[^\r\n\\]*)*(?:{EOL})*(?={EOL}[A-Za-z0-9+/=])")
END = re.compile(EOL + "-----END ")
#: Least marginal bytes per character of a reported string: words and paths cost 0.3 to 0.7, random letters and digits about 1.
NOVELTY = 0.8
#: Strings of small letters alone cost less, words run together 0.4 to 0.7 and random ones 0.7 to 0.8; from this length on they
#: are told apart.  Shorter strings of few letters are numbers, dates and rules.
LOWER, LONG = 0.7, 24


def hints(text: str) -> bool:
    """Whether any word of ASSIGN or SENSITIVE can occur; each of them holds one of these, in either case."""
    low = text.lower()
    return any(x in low for x in ("pass", "secret", "token", "key", "credential", "bearer", "authorization"))


def cover(spans: Sequence[tuple[str, int, int]]) -> Callable[[int, int], bool]:
    """Whether a stretch touches none of ``spans``, by bisection in their union."""
    starts, ends = [], []
    for a, b in sorted((a, b) for _, a, b in spans):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)

    def free(a: int, b: int) -> bool:
        i = bisect_left(starts, b)
        return i == 0 or ends[i - 1] <= a

    return free


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping spans of every base kind; matches that fail their test are dropped, not tried again."""
    out = []
    if hints(text):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return out


@lru_cache(maxsize=2)
def coder(identifiers: str) -> zstandard.ZstdCompressor:
    """Compressor primed with a dictionary made of identifiers in lines of code; it knows how often their letters occur, too."""
    words, pick = identifiers.split(), random.Random(3)
    lines = [pick.choice((" ", "_", ".", "-")).join(pick.choices(words, k=pick.randrange(3, 9))) + pick.choice((" = ", "(", ": ", "\n", ";")) for _ in range(2000)]
    known = zstandard.train_dictionary(3000, [x.encode() for x in lines])
    return zstandard.ZstdCompressor(level=19, dict_data=known, write_content_size=False, write_checksum=False, write_dict_id=False)


def marginal(candidate: str, before: str, after: str, identifiers: str = IDENTIFIERS) -> float:
    """Bytes per character that ``candidate``, in pieces of at most PIECE, adds to its surroundings for a compressor primed with identifiers."""
    size = coder(identifiers).compress
    known, n = len(size((before + after).encode())), -(-len(candidate) // PIECE)
    cuts = [len(candidate) * i // n for i in range(n + 1)]
    return sum(len(size((before + candidate[a:b] + after).encode())) - known for a, b in zip(cuts, cuts[1:])) / len(candidate)


def bar(value: str, least: float) -> float:
    """Least marginal bytes per character for ``value`` to be novel."""
    return min(least, LOWER) if len(value) >= LONG and value.isalpha() and value.islower() else least


def wrapped(text: str, first: int, end: int) -> list[tuple[int, int]]:
    """Lines directly after the one from ``first`` to ``end`` that go on with its key: those of its width, and a shorter last one.

    A shorter line counts after two of the same width or before an END mark.
    """
    out, width = [], end - first
    while m := LINE.match(text, end):
        if len(m[1]) > width or len(m[1]) < width and not (out or END.match(text, m.end())):
            break
        out.append(m.span(1))
        end = m.end()
        if len(m[1]) < width:
            break
    return out


def block(text: str, word: re.Match) -> list[tuple[int, int]]:
    """Lines of the key whose BEGIN mark ends with ``word``: all up to the END mark or, without one, those of ``wrapped``."""
    head = BEGIN.search(text, max(0, word.start() - 40), word.start()) and HEAD.match(text, word.end())
    if not head:
        return []
    lines, end = [], head.end()
    while m := LINE.match(text, end):
        lines.append(m.span(1))
        end = m.end()
    return lines if not lines or END.match(text, end) else [lines[0], *wrapped(text, *lines[0])]


def novel_spans(text: str, taken: Sequence[tuple[str, int, int]], least: float = NOVELTY) -> list[tuple[str, int, int]]:
    """Strings after a sensitive word that no base span touches, are no mail address and novel, with the lines that go on with them; less than a quarter letters asks for LONG characters.

    Of a base span that goes on in further lines, these are reported; a key between BEGIN and END marks is reported when one of its lines is novel.
    """
    out, end = [], -1
    if not hints(text):
        return out
    free = cover(taken)
    runs: dict[int, tuple[list[tuple[int, int]], int]] = {}

    def novel(a: int, b: int, first: int, last: int) -> bool:
        """Whether ``a`` to ``b`` is, given what stands around its key, which goes from ``first`` to ``last``."""
        return marginal(text[a:b], text[max(0, first - CONTEXT) : first], text[last : last + CONTEXT]) >= bar(text[a:b], least)

    for word in SENSITIVE.finditer(text):
        lines = block(text, word)
        if lines and any(novel(*x, lines[0][0], lines[-1][1]) for x in lines):
            end = lines[-1][1]
            out.append(("novel", lines[0][0], end))
            continue
        for m in CANDIDATE.finditer(text, word.end(), min(len(text), word.end() + REACH + 200)):
            if m.start() > word.end() + REACH:
                break
            a, b = m.start(), m.end()
            if b == word.end() + REACH + 200:
                b = CANDIDATE.match(text, a).end()
            if a < end or b - a < LONG and 4 * sum(map(str.isalpha, text[a:b])) < b - a or ADDRESS.fullmatch(text, a, b):
                continue
            if a not in runs:  # each run of lines is followed once
                lines = wrapped(text, a, b) if KEY.fullmatch(text, a, b) else []
                runs |= {x: (lines, i) for i, (x, _) in enumerate(lines, 1)} | {a: (lines, 0)}
            lines, at = runs[a]
            last = lines[-1][1] if at < len(lines) else b
            first = a if free(a, b) else next((x for x, y in lines[at:] if free(x, y)), None)
            if first is not None and novel(a, b, a, last):
                end = last
                out.append(("novel", first, end))
    return out


def find(text: str | None) -> list[tuple[str, int, int]]:
    """All spans in order of start, then kind; null and empty texts have none."""
    text = text or ""
    base = base_spans(text)
    return sorted(base + novel_spans(text, base), key=lambda s: (s[1], KINDS.index(s[0])))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def span_rows(rule):
    """Arrow function that adds ``spans`` by ``rule(text)`` to every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"kind": k, "start": a, "end": b} for k, a, b in rule(t.as_py())] for t in batch.column("text")]
            yield pa.record_batch({"row": batch.column("row"), "spans": pa.array(spans, SPANS)})

    return run


def scan(docs: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of every row with ``spans``: array of (kind, start, end), code points, end exclusive.

    Rows keep their multiplicity and null keys; other columns are not read; an empty table gives an empty one.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    return rows.mapInArrow(span_rows(find), f"row {kind}, spans array<struct<kind:string,start:int,end:int>>").select("row.*", "spans")


def digest(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every reported span replaced by ``mark``; overlapping spans count as one.  All other columns stay; null texts stay null."""

    @F.pandas_udf("string")
    def clean(texts):
        def one(value):
            if value is None:
                return None
            out, at = [], 0
            for _, a, b in find(value):
                if a >= at:
                    out += [value[at:a], mark]
                at = max(at, b)
            return "".join([*out, value[at:]])

        return texts.map(one)

    return docs.withColumn(text, clean(F.col(f"`{text}`")))
