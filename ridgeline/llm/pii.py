"""Personal data: fixed patterns, and a semi-Markov conditional random field that adds what they miss.

The field scores whole candidate segments: features see a segment's shape, digit groups, checksum, word
cues before it and its borders. Bounded-entity dynamic programming (MOST_TOKENS by type) chooses the
boundaries and types of a region jointly; a token outside any entity is a segment of its own. Weights are
fitted by conditional likelihood (forward and backward sums over all segmentations) on synthetic regions
from a seeded generator, once a driver; there is no file to ship.

Only regions around digits, `@` or a bracketed "at" are segmented, in whole texts of any length. Spans of
the fixed patterns always stay; a segment that overlaps one is dropped.

Spans are code-point offsets, end exclusive. Defined results: null text is empty; empty texts have no
spans; repeated rows give repeated results; extra columns are ignored (or kept, by redacted()).
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from array import array
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ridgeline.llm.common import table

KINDS = ("email", "ip", "card", "phone")
#: Longest segment, in tokens.
MOST_TOKENS = {"email": 17, "ip": 7, "card": 9, "phone": 11}
SEED = 11
TRAIN_REGIONS = 260
EPOCHS = 14

# ---- fixed patterns -------------------------------------------------------------------------------------

_AFTER_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_SOME = re.compile(r"[0-9@]")
_IN_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def digits_of(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def octets(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in parts)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(index of the kind, start, end) of the fixed patterns, by kind, then start."""
    found: list[tuple[int, int, int]] = []
    if not _SOME.search(text):
        return found
    if "@" in text:
        done = 0
        for m in _AFTER_AT.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in _IN_LOCAL:
                start -= 1
            if start < m.start():
                found.append((0, start, m.end()))
                done = m.end()
    found += [(1, m.start(), m.end()) for m in _IP.finditer(text) if octets(m[0].split("."))]
    for m in _CARD.finditer(text):
        d = digits_of(m[0]) if m.end() - m.start() <= 40 else ""
        if 16 <= len(d) <= 19 and luhn(d):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        found += [(3, m.start(), m.end()) for m in _PHONE.finditer(text) if 8 <= len(digits_of(m[0])) <= 15]
    return found


# ---- the field ------------------------------------------------------------------------------------------

_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\s|[^\w\s]|_|\w")
_BLANK = re.compile(r"\s")
_SEED = re.compile(r"[0-9@]|[\[({]\s?[aA][tT]\s?[\])}]")
_CUES = {
    "phone": frozenset("tel phone call mobile fax telefon telefono teléfono téléphone móvil handy cell".split()),
    "email": frozenset("mail email contact write contacto correo courriel schreib".split()),
    "card": frozenset("card visa amex mastercard karte tarjeta carte".split()),
    "ip": frozenset("ip host server address addr".split()),
}
_CUE_OF = {w: k for k, words in _CUES.items() for w in words}
_AT = re.compile(r"@|[\[({]\s?at\s?[\])}]", re.I)
_DOT = re.compile(r"[.]|[\[({]\s?dot\s?[\])}]", re.I)
#: What no spelling of an address holds: other characters, and blanks that touch no bracket.
_ODD = re.compile(r"[^\w.%+@\[\](){} -]|(?<![\])}\[({]) (?![\[({])| $")
#: Characters before and after a seed that a region takes in, at least.
_REACH = 48


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches of text around seeds, widened to white space (or the text's ends) on both sides, in one pass."""
    start = end = -1
    for m in _SEED.finditer(text):
        b = min(len(text), m.end() + _REACH)
        if b <= end:
            continue
        a = max(0, m.start() - _REACH)
        while a > max(0, end) and not text[a - 1].isspace():
            a -= 1
        blank = _BLANK.search(text, b)
        b = blank.start() if blank else len(text)
        if start >= 0 and a > end:
            yield start, end
            start = a
        elif start < 0:
            start = a
        end = b
    if start >= 0:
        yield start, end


def _shape(s: str) -> str:
    out = []
    for run in _TOKEN.findall(s)[:16]:
        out.append(f"9{min(len(run), 5)}" if run[0].isdigit() else "a" if run[0].isalpha() else run)
    return "".join(out)


def _span_features(text: str, start: int, end: int, kind: str) -> list[str]:
    """Features of a whole segment; each is joined with the type."""
    s = text[start:end]
    d = digits_of(s)
    groups = re.findall("[0-9]+", s)
    before, after = text[start - 1 : start], text[end : end + 1]
    out = ["bias", f"shape={_shape(s)}", f"digits={min(len(d), 20)}", f"groups={'-'.join(str(len(g)) for g in groups[:6])}"]
    out.append(f"clean={not (before.isalnum() or before in ('.', '-', '_', '/', '$', '@') and before != '') and not after.isalnum()}")
    if before in "-./" and before or after in "-/" and after:
        out.append("joined")
    if kind == "card":
        out.append(f"luhn={13 <= len(d) <= 19 and luhn(d)}")
    if kind == "ip":
        out.append(f"octets={len(groups) == 4 and octets(groups)}")
    if kind == "email":
        out.append(f"at={'@' in s},{len(_AT.findall(s))}")
        out.append(f"top={bool(re.search(r'(?:[.]|dot[)}\] ]*|punkt[ )]*)[a-zA-Z]{2,6}$', s))}")
    if kind == "phone":
        out.append(f"plus={s[0] == '+'},{s[0] == '('},{s[:2] == '00'}")
        out.append(f"marks={''.join(sorted(set(re.sub('[0-9]', '', s))))[:6]}")
    cue = next((_CUE_OF[w] for w in reversed(re.findall(r"[^\W\d_]+", text[max(0, start - 24) : start].lower())[-3:]) if w in _CUE_OF), "")
    if cue:
        out.append(f"cue={cue == kind}")
    return [f"{kind}|{x}" for x in out]


def _token_features(token: str) -> list[str]:
    kind = f"9{min(len(token), 6)}" if token[0].isdigit() else "a" if token[0].isalpha() else "s" if token.isspace() else "p"
    return ["O|bias", f"O|{kind}"]


def _may_be(kind: str, s: str, first: str, last: str) -> bool:
    """Cheap test of a candidate segment, before its features are made."""
    if kind == "email":
        return first[0].isalnum() and last[0].isalpha() and bool(_AT.search(s)) and bool(_DOT.search(s)) and not _ODD.search(s)
    if not last[0].isdigit():
        return False
    if kind == "ip":
        return first[0].isdigit() and s.count(".") == 3
    n = sum("0" <= c <= "9" for c in s)
    if any(c.isalpha() for c in s):
        return False
    if kind == "card":
        return first[0].isdigit() and 13 <= n <= 19
    return first[0] in "+(0123456789" and 7 <= n <= 15


def _starting(text: str, tokens: Sequence[tuple[int, int]], i: int) -> Iterator[tuple[int, int, list[str]]]:
    """The entity segments that start at token i: (end token, type, features). None crosses a line break."""
    a, b = tokens[i]
    first = text[a:b]
    if not (first[0].isalnum() or first[0] in "+("):
        return
    for k, kind in enumerate(KINDS):
        if kind != "email" and first[0].isalpha():
            continue
        for j in range(i, min(len(tokens), i + MOST_TOKENS[kind])):
            x, y = tokens[j]
            if text[x] == "\n":
                break
            if _may_be(kind, text[a:y], first, text[x:y]):
                yield j + 1, k, _span_features(text, a, y, kind)


def lattice(text: str) -> tuple[list[tuple[int, int]], list[list[tuple[int, int, list[str]]]]]:
    """Tokens, and for each end position the segments (start token, type or -1, features) that end there."""
    tokens = [m.span() for m in _TOKEN.finditer(text)]
    ending: list[list[tuple[int, int, list[str]]]] = [[] for _ in range(len(tokens) + 1)]
    for j, (a, b) in enumerate(tokens):
        ending[j + 1].append((j, -1, _token_features(text[a:b])))
    for i in range(len(tokens)):
        for j, k, feats in _starting(text, tokens, i):
            ending[j].append((i, k, feats))
    return tokens, ending


def viterbi(text: str, weights: dict[str, float]) -> list[tuple[int, int, int]]:
    """(index of the kind, start, end) of the entities in the best segmentation of a region.

    Scores are pushed from each start and no lattice is kept. Where no candidate spans a border, all
    segmentations meet; the steps before it are settled and dropped there, so what a region holds besides its
    tokens does not grow with its length.
    """
    tokens = array("q")
    for m in _TOKEN.finditer(text):
        tokens.append(m.start())
    tokens.append(len(text))
    n, out, done, reach = len(tokens) - 1, [], 0, 0
    spans_ = _Window(tokens, n)
    best: dict[int, tuple[float, int, int]] = {0: (0.0, -1, -1)}
    for i in range(n):
        if i >= reach and i > done:
            out += _settled(best, done, i, tokens)
            best, done = {i: best[i]}, i
        here = best[i][0]
        moves = [(i + 1, -1, _token_features(text[tokens[i] : tokens[i + 1]]))]
        moves += _starting(text, spans_, i)
        for j, k, feats in moves:
            step = (here + sum(weights.get(f, 0.0) for f in feats), i, k)
            if j not in best or step > best[j]:
                best[j] = step
            if k >= 0:
                reach = max(reach, j)
    return out + _settled(best, done, n, tokens)


class _Window:
    """Token spans over the array of token starts: every character is in a token, so each ends where the next starts."""

    def __init__(self, starts: array, n: int):
        self.starts, self.n = starts, n

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> tuple[int, int]:
        return self.starts[i], self.starts[i + 1]


def _settled(best: dict[int, tuple[float, int, int]], low: int, high: int, starts: array) -> list[tuple[int, int, int]]:
    """The entities of the best path between two borders that every path passes."""
    out, j = [], high
    while j > low:
        _, i, k = best[j]
        if k >= 0:
            out.append((k, starts[i], starts[j]))
        j = i
    return out[::-1]


def _log_sum(x: list[float]) -> float:
    top = max(x)
    return top + math.log(sum(math.exp(v - top) for v in x))


def fit(examples: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = EPOCHS, rate: float = 0.4, decay: float = 0.002) -> dict[str, float]:
    """Weights by Adagrad on the conditional log likelihood of the true segmentations."""
    weights: dict[str, float] = {}
    power: dict[str, float] = {}
    prepared = []
    for text, truth in examples:
        tokens, ending = lattice(text)
        gold = {(a, b, k) for k, a, b in truth}
        prepared.append((tokens, ending, gold, [(tokens[i][0], tokens[j - 1][1], k, i, j, n) for j in range(1, len(tokens) + 1) for n, (i, k, _) in enumerate(ending[j])]))
    for _ in range(epochs):
        for tokens, ending, gold, segments in prepared:
            n = len(tokens)
            score = [[sum(weights.get(f, 0.0) for f in feats) for _, _, feats in at] for at in ending]
            forward = [0.0] * (n + 1)
            for j in range(1, n + 1):
                forward[j] = _log_sum([forward[i] + s for (i, _, _), s in zip(ending[j], score[j])])
            starting: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
            for j in range(1, n + 1):
                for (i, _, _), s in zip(ending[j], score[j]):
                    starting[i].append((j, s))
            backward = [0.0] * (n + 1)
            for i in range(n - 1, -1, -1):
                backward[i] = _log_sum([backward[j] + s for j, s in starting[i]])
            inside = np.zeros(n, bool)
            for a, b, _ in gold:
                for t, (x, y) in enumerate(tokens):
                    inside[t] |= a <= x and y <= b
            gradient: dict[str, float] = {}
            for a, b, k, i, j, place in segments:
                p = math.exp(forward[i] + score[j][place] + backward[j] - forward[n])
                true = (a, b, k) in gold if k >= 0 else not inside[i]
                if abs(true - p) > 1e-4:
                    for f in ending[j][place][2]:
                        gradient[f] = gradient.get(f, 0.0) + true - p
            for f, g in gradient.items():
                g -= decay * weights.get(f, 0.0)
                power[f] = power.get(f, 1e-6) + g * g
                weights[f] = weights.get(f, 0.0) + rate * g / math.sqrt(power[f])
    return weights


def _card(r: random.Random, n: int = 16) -> str:
    body = "4" + "".join(r.choice("0123456789") for _ in range(n - 2))
    return next(body + c for c in "0123456789" if luhn(body + c))


def synthetic(count: int = TRAIN_REGIONS, seed: int = SEED) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Regions with their true spans: entities in several spellings among look-alikes that are none."""
    r = random.Random(seed)
    d = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    w = lambda: "".join(r.choice("abcdefghilmnoprstuv") for _ in range(r.randint(2, 8)))
    quad = lambda: ".".join(str(r.randint(0, 255)) for _ in range(4))
    entity = {
        0: [lambda: f"{w()}.{d(2)}@{w()}{d(1)}.example.com", lambda: f"{w()}@{w()}.org", lambda: f"{w()} [at] {w()}.com", lambda: f"{w()} (at) {w()} (dot) com", lambda: f"{w()}.{w()} [at] {w()} [dot] net"],
        1: [quad, quad],
        2: [lambda: _card(r), lambda: re.sub(r"(\d{4})(?=\d)", r"\1 ", _card(r)), lambda: re.sub(r"(\d{4})(?=\d)", r"\1-", _card(r)), lambda: re.sub(r"(\d{4})(?=\d)", r"\1.", _card(r))],
        3: [lambda: f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", lambda: f"+{d(2)} {d(3)} {d(7)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}-{d(3)}-{d(4)}", lambda: f"{d(3)}.{d(3)}.{d(4)}", lambda: f"+{d(11)}"],
    }
    other = [
        lambda: d(4), lambda: d(r.randint(1, 12)), lambda: f"version {d(1)}.{d(1)}", lambda: f"{d(1)}.{d(1)}.{d(2)}", lambda: f"20{d(2)}-{d(2)}-{d(2)}", lambda: f"{d(2)}/{d(2)}/{d(4)}",
        lambda: f"${d(3)},{d(3)}.{d(2)}", lambda: f"{d(2)}:{d(2)}:{d(2)}", lambda: f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}", lambda: f"{r.randint(256, 999)}.{d(3)}.{d(3)}.{d(2)}", lambda: f"#{d(7)}", lambda: f"{d(5)}-{d(4)}",
        lambda: f'token = "{"".join(r.choice("0123456789abcdef") for _ in range(40))}"', lambda: f"{d(6)} {d(6)}", lambda: f"@{w()}", lambda: f"{d(8)}", lambda: f"{d(16)[:-1]}{d(1)}x", lambda: f"{d(10)}", lambda: f"{d(3)} {d(3)} {d(4)}",
        lambda: " ".join(d(r.randint(1, 4)) for _ in range(r.randint(3, 6))),
    ]
    cues = {k: sorted(v) for k, v in _CUES.items()}
    out = []
    for _ in range(count):
        text, truth = "", []
        for _ in range(r.randint(1, 3)):
            text += "".join(w() + r.choice([" ", " ", ". ", ", "]) for _ in range(r.randint(1, 4)))
            if r.random() < 0.5:
                k = r.randrange(4)
                if r.random() < 0.3:
                    text += r.choice(cues[KINDS[k]]) + r.choice([" ", ": "])
                s = r.choice(entity[k])()
                truth.append((k, len(text), len(text) + len(s)))
            else:
                s = r.choice(other)()
            text += s + r.choice([" ", " ", ". ", ", ", "\n", "### "])
        out.append((text + w(), truth))
    return out


@lru_cache(1)
def weights() -> dict[str, float]:
    return {f: round(v, 6) for f, v in fit(synthetic()).items() if abs(v) > 1e-4}


def spans(text: str, model: dict[str, float]) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(spans of the fixed patterns, all spans), both by kind, then start."""
    base = base_spans(text)
    added = []
    for a, b in regions(text):
        # A region without anything that may be an entity costs no more than its scan.
        added += [(k, a + x, a + y) for k, x, y in viterbi(text[a:b], model)]
    if added and base:
        taken = sorted((x, y) for _, x, y in base)
        starts = np.array([x for x, _ in taken])
        reach = np.maximum.accumulate(np.array([y for _, y in taken]))
        keep = []
        for s in added:
            i = int(np.searchsorted(starts, s[2], "left"))  # spans that start before this one ends
            if i == 0 or reach[i - 1] <= s[1]:
                keep.append(s)
        added = keep
    return base, sorted({*base, *added})


def _joined(found: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)


def _finder(model: dict[str, float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, digests, every = [], [], []
            for t in batch.column(1):
                base, found = spans(t.as_py() or "", model)
                counts.append([sum(k == n for k, _, _ in base) for n in range(len(KINDS))])
                digests.append(hashlib.sha256(_joined(base).encode()).hexdigest())
                every.append(_joined(found))
            n = np.array(counts, np.int64).reshape(-1, len(KINDS))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(n[:, i]) for i in range(len(KINDS))], pa.array(digests, pa.string()), pa.array(every, pa.string())],
                ["doc_id", *[f"n_{k}" for k in KINDS], "base_sha256", "spans"],
            )

    return run


def found(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans for every row."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_finder(weights()), f"doc_id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, base_sha256 string, spans string")


def redact(text: str, model: dict[str, float]) -> str:
    """The text with every span replaced by its kind in brackets; overlapping spans are merged under the first one's kind."""
    _, every = spans(text, model)
    out, at = [], 0
    for a, b, k in sorted((a, b, k) for k, a, b in every):
        if a >= at:
            out += [text[at:a], f"[{KINDS[k].upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text_col: str = "text", length_col: str | None = None) -> DataFrame:
    """docs with spans redacted in the text; all other columns stay, length_col (if given) becomes the new length."""
    model, schema = weights(), to_arrow_schema(docs.schema)
    at, length_at = docs.columns.index(text_col), docs.columns.index(length_col) if length_col else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [None if t is None else redact(t, model) for t in b.column(at).to_pylist()]
            columns = list(b.columns)
            columns[at] = pa.array(texts, schema.field(at).type)
            if length_at >= 0:
                columns[length_at] = pa.array([None if t is None else len(t) for t in texts], schema.field(length_at).type)
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return docs.mapInArrow(run, docs.schema)


def op2_pii(spark, sf_dir) -> DataFrame:
    return found(table(spark, sf_dir, "documents"))
