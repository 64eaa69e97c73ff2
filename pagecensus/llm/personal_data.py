"""Personal data: patterns, and a semi-Markov conditional random field for what they leave.

The patterns (email, ip, card, phone) give the base spans.  Around digits, at-signs and long mixed
tokens, regions of text become tokens; every bounded run of tokens that could be of a kind is a
candidate segment with features of the whole span (digits, groups, checksum, alphabet, what stands
beside it).  The field scores all ways to cut a region into segments and other tokens; dynamic
programming over them finds the best cut, with boundaries and kinds decided together.  Base spans are
fixed in it, and what the best cut holds beyond them is added: other ways of writing phone numbers,
addresses and cards, and secrets (keys, tokens), which no pattern names.

The weights are fitted here, by the likelihood of the true spans among all cuts: on forms written
from a seed (``personal_forms``), and on those regions of a bounded sample of documents in which the
patterns explain every trigger.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagecensus.llm.common import as_row, whole
from pagecensus.llm.personal_forms import written
from pagecensus.session import materialised

KINDS = ("email", "ip", "card", "phone", "secret")
#: Kinds that have a pattern.
BASE_KINDS = KINDS[:4]
#: Written forms of the fit, besides the regions of documents.
WRITTEN = 4_000
#: Documents whose regions may be used to fit the weights, and regions used, lowest hashes first.
SAMPLE_DOCUMENTS, SAMPLE_REGIONS = 20_000, 1_500
#: Characters of a region up to which it may be used to fit; regions of any length are cut.
FIT_CHARACTERS = 2_000
#: Tokens of one segment and characters of a secret; base spans of any length stay.
MAX_TOKENS, MAX_SECRET = 24, 512
#: Characters of context around what opens a region, and the gap that parts two regions.
AROUND, GAP = 32, 48

_DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGIT = re.compile("[0-9]")
_SECRET = re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,512}={0,2}(?![A-Za-z0-9_+/-])")
_TRIGGER = re.compile(r"@|[0-9](?:[ ()./-]{0,2}[0-9]){3}|" + _SECRET.pattern)
_TOKEN = re.compile(r"[0-9]+|[^\W\d_]+|\S")
_NUMBER_SIGNS = frozenset("+-.()/")
_CUES = {
    "phone": re.compile(r"\b(?:tel|phone|call|mobile|cell|fax|telefon|téléphone|teléfono|ring)\W*$", re.I),
    "card": re.compile(r"\b(?:card|visa|mastercard|amex|credit|karte|carte|tarjeta|cc)\W*$", re.I),
    "ip": re.compile(r"\b(?:ip|host|server|address|addr|from)\W*$", re.I),
    "email": re.compile(r"\b(?:e-?mail|mail|contact|write|correo|courriel)\W*$", re.I),
    "secret": re.compile(r"(?:token|key|secret|password|passwd|pwd|auth|bearer|credential)\W*$", re.I),
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        if i & 1:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(_DIGIT.findall(text))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the patterns: leftmost, not overlapping within a kind."""
    found = []
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m is not None:
            found.append((0, start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    if _DIGIT.search(text) is None:
        return found
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
            found.append((1, m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append((2, m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                found.append((3, m.start(), m.end()))
    return found


def regions(text: str) -> list[tuple[int, int]]:
    """Stretches around at-signs and runs of digits, widened to blanks; nothing else can hold a segment."""
    out: list[list[int]] = []
    if "@" not in text and _DIGIT.search(text) is None:
        return []
    for m in _TRIGGER.finditer(text):
        if out and m.start() - out[-1][1] <= GAP:
            out[-1][1] = m.end()
        else:
            out.append([m.start(), m.end()])
    wide: list[tuple[int, int]] = []
    for n, (start, end) in enumerate(out):
        least = wide[-1][1] if wide else 0
        most = out[n + 1][0] if n + 1 < len(out) else len(text)
        while start > least and not text[start - 1].isspace():
            start -= 1
        while end < most and not text[end].isspace():
            end += 1
        low, high = max(least, start - AROUND), min(most, end + AROUND)
        while least < low < start and not text[low - 1].isspace():
            low += 1
        while end < high < len(text) and not text[high].isspace():
            high -= 1
        wide.append((low, high))
    return wide


def _email_features(text: str, start: int, end: int) -> list[str]:
    local, _, domain = text[start:end].partition("@")
    labels = domain.split(".")
    return [
        "email", f"email labels {min(len(labels), 4)}", f"email local {bool(local)}",
        f"email top {2 <= len(labels[-1]) <= 8 and labels[-1].isalpha()}",
        f"email empty label {'' in labels or not domain}", f"email dot ends {local[:1] == '.' or local[-1:] == '.'}",
    ]


def _number_features(kind: str, text: str, start: int, end: int) -> list[str]:
    span = text[start:end]
    groups = re.findall("[0-9]+", span)
    n = sum(map(len, groups))
    signs = "".join(sorted(set(span) - set("0123456789")))
    shape = "-".join(str(min(len(g), 5)) for g in groups[:5])
    out = [kind, f"{kind} signs {signs}", f"{kind} shape {shape}", f"{kind} digits {n}", f"{kind} plus {span[0] == '+'}"]
    if kind == "card":
        out += [f"card checksum {luhn(''.join(groups))}", f"card size {13 <= n <= 19}", f"card first {span[0] in '3456'}"]
    elif kind == "phone":
        out += [f"phone size {9 <= n <= 15}", f"phone brackets {span.count('(') == span.count(')')}"]
    else:
        out += [f"ip parts {len(groups)}", f"ip bytes {all(len(g) <= 3 and int(g) <= 255 for g in groups)}"]
    return out


def _beside(kind: str, text: str, start: int, end: int) -> list[str]:
    left, right = text[start - 1 : start], text[end : end + 1]
    return [
        f"{kind} left {'word' if left.isalnum() else left if left in '+-.@(_/' else 'gap'}",
        f"{kind} right {'word' if right.isalnum() else right if right in '-@)_/' else 'gap'}",
        f"{kind} cue {_CUES[kind].search(text, max(0, start - 16), start) is not None}",
    ]


def _secret_features(text: str, start: int, end: int) -> list[str]:
    span = text[start:end]
    digits, upper, lower = (sum(map(f, span)) for f in (str.isdigit, str.isupper, str.islower))
    varied = len(set(span)) / min(len(span), 32)
    return [
        "secret", f"secret size {min(len(span), 64) // 8}", f"secret hex {not set(span) - set('0123456789abcdef')}",
        f"secret digits {min(4, 10 * digits // len(span))}", f"secret upper {upper > 0}", f"secret lower {lower > 0}",
        f"secret varied {int(4 * varied)}", f"secret signs {min(3, len(span) - digits - upper - lower)}",
    ]


def _starting(text: str, starts, ends, i: int) -> Iterator[tuple[int, int, list[str]]]:
    """(token after the last, kind, features) of the candidate segments that begin at token ``i``."""
    start, head = starts[i], text[starts[i]]
    number = head.isascii() and (head.isdigit() or head in "+(")
    word = head in _LOCAL
    if word or head in "+/":
        m = _SECRET.match(text, start)
        if m is not None and (after := bisect_left(starts, m.end(), i)) and ends[after - 1] == m.end():
            yield after, 4, _secret_features(text, start, m.end()) + _beside("secret", text, start, m.end())
    at_signs, numeric = 0, 0
    for j in range(i, min(i + MAX_TOKENS, len(starts))):
        a, b = starts[j], ends[j]
        gap = a - ends[j - 1] if j > i else 0
        piece = text[a:b]
        word = word and gap == 0 and (piece == "@" or (piece.isascii() and all(c in _LOCAL for c in piece)))
        at_signs += piece == "@"
        digits = piece.isascii() and piece.isdigit()
        number = number and gap <= 1 and (gap == 0 or text[a - 1] == " ") and (digits or piece in _NUMBER_SIGNS)
        numeric += len(piece) if digits else 0
        number = number and numeric <= 19
        if not (number or (word and at_signs <= 1)):
            break
        if word and at_signs == 1 and piece[-1].isalnum():
            yield j + 1, 0, _email_features(text, start, b) + _beside("email", text, start, b)
        if number and digits and numeric >= 4:
            span = text[start:b]
            if 3 == span.count(".") and numeric <= 12 and not set(span) - set("0123456789."):
                yield j + 1, 1, _number_features("ip", text, start, b) + _beside("ip", text, start, b)
            if 7 <= numeric <= 19:
                for kind in (2, 3):
                    name = KINDS[kind]
                    yield j + 1, kind, _number_features(name, text, start, b) + _beside(name, text, start, b)


def _tokens(text: str, low: int, high: int) -> tuple[array, array]:
    """Where the tokens of a region start and end; arrays, as regions may be as long as a text."""
    starts, ends = array("q"), array("q")
    for m in _TOKEN.finditer(text, low, high):
        starts.append(m.start())
        ends.append(m.end())
    return starts, ends


def lattice(text: str, low: int, high: int) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, list[str]]]]:
    """Tokens (start, end) of a region and its candidate segments (first, after last, kind, features)."""
    starts, ends = _tokens(text, low, high)
    found = [(i, j, kind, features) for i in range(len(starts)) for j, kind, features in _starting(text, starts, ends, i)]
    return list(zip(starts, ends)), found


def _gold(tokens, segments, spans) -> set[int]:
    """Numbers of the segments that are base spans; of overlapping ones the first kind's."""
    starts = {s: i for i, (s, _) in enumerate(tokens)}
    ends = {e: i + 1 for i, (_, e) in enumerate(tokens)}
    wanted, taken = set(), []
    for kind, s, e in spans:
        if s in starts and e in ends and not any(s < b and a < e for a, b in taken):
            wanted.add((starts[s], ends[e], kind))
            taken.append((s, e))
    return {n for n, x in enumerate(segments) if x[:3] in wanted}


def _log_add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def fit(examples: list[tuple[str, list]], rounds: int = 8, rate: float = 0.3, ridge: float = 1e-3) -> dict[str, float]:
    """Weights by stochastic gradient ascent on the likelihood of the base spans among all cuts."""
    w: dict[str, float] = {}
    ready = []
    for text, spans in examples:
        tokens, segments = lattice(text, 0, len(text))
        if segments:
            ready.append((len(tokens), segments, _gold(tokens, segments, spans)))
    for n in range(rounds):
        step = rate / (1 + n)
        for size, segments, gold in ready:
            score = [sum(w.get(f, 0.0) for f in x[3]) for x in segments]
            into: list[list[int]] = [[] for _ in range(size + 1)]
            out: list[list[int]] = [[] for _ in range(size + 1)]
            for k, x in enumerate(segments):
                out[x[0]].append(k)
                into[x[1]].append(k)
            ahead = [0.0] + [-math.inf] * size
            for t in range(1, size + 1):
                ahead[t] = ahead[t - 1]
                for k in into[t]:
                    ahead[t] = _log_add(ahead[t], ahead[segments[k][0]] + score[k])
            behind = [-math.inf] * size + [0.0]
            for t in range(size - 1, -1, -1):
                behind[t] = behind[t + 1]
                for k in out[t]:
                    behind[t] = _log_add(behind[t], behind[segments[k][1]] + score[k])
            for k, x in enumerate(segments):
                share = math.exp(min(0.0, ahead[x[0]] + score[k] + behind[x[1]] - ahead[size]))
                pull = step * ((k in gold) - share)
                if abs(pull) > 1e-5:
                    for f in x[3]:
                        w[f] = w.get(f, 0.0) * (1 - step * ridge) + pull
    return w


def added(text: str, base: list[tuple[int, int, int]], w: dict[str, float]) -> list[tuple[int, int, int]]:
    """Segments of the best cut of each region, with the base spans fixed.

    Segments are scored as they are met and not kept; a region takes a few numbers per token.
    """
    out, fixed = [], []
    for s, e in sorted((s, e) for _, s, e in base):
        if fixed and s < fixed[-1][1]:
            fixed[-1][1] = max(fixed[-1][1], e)
        else:
            fixed.append([s, e])
    at = 0
    for low, high in regions(text):
        starts, ends = _tokens(text, low, high)
        n = len(starts)
        covered = array("q", [0])  # tokens before this one that touch a base span
        for s, e in zip(starts, ends):
            while at < len(fixed) and fixed[at][1] <= s:
                at += 1
            covered.append(covered[-1] + (at < len(fixed) and fixed[at][0] < e))
        best = array("d", [0.0]) + array("d", [-math.inf]) * n
        first, kinds = array("q", [-1]) * (n + 1), bytearray(n + 1)
        for i in range(n):
            if best[i] >= best[i + 1]:
                best[i + 1], first[i + 1] = best[i], -1
            if covered[i + 1] > covered[i]:
                continue
            for j, kind, features in _starting(text, starts, ends, i):
                if covered[j] == covered[i] and (score := best[i] + sum(w.get(f, 0.0) for f in features)) > best[j]:
                    best[j], first[j], kinds[j] = score, i, kind
        t = n
        while t > 0:
            i = first[t]
            if i >= 0:
                out.append((kinds[t], starts[i], ends[t - 1]))
            t = i if i >= 0 else t - 1
    return out


def fitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 1) -> dict[str, float]:
    """Weights from written forms, and from regions of a bounded sample of documents, drawn by a hash
    of the identifier.  Only regions whose triggers all lie in base spans take part: what else a
    document holds is not known."""
    named = docs.select(F.xxhash64(F.lit(seed), F.col(f"`{id_col}`")).alias("hash"), F.col(f"`{text_col}`").alias("text"))
    named = named.where("text is not null")
    total = named.count()
    drawn = named.where(F.pmod("hash", F.lit(max(total, 1))) < SAMPLE_DOCUMENTS)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text in zip(batch["hash"], batch["text"]):
                base = base_spans(text)
                for low, high in regions(text):
                    if high - low > FIT_CHARACTERS:
                        continue
                    own = [(k, s - low, e - low) for k, s, e in base if low <= s and e <= high]
                    marks = [m.start() - low for m in _TRIGGER.finditer(text, low, high)]
                    if all(any(s <= m < e for _, s, e in own) for m in marks):
                        rows.append((key, low, text[low:high], [x for span in own for x in span]))
            yield pd.DataFrame(rows, columns=["hash", "low", "text", "spans"])

    found = materialised(drawn.mapInPandas(cut, "hash long, low long, text string, spans array<long>"))
    rows = found.orderBy("hash", "low", "text").limit(SAMPLE_REGIONS).collect()
    known = [(r.text, [tuple(r.spans[i : i + 3]) for i in range(0, len(r.spans), 3)]) for r in rows]
    return fit(written(KINDS, WRITTEN, seed) + known)


def personal_data(docs: DataFrame, weights: dict[str, float], text_col: str = "text") -> DataFrame:
    """Personal data in each whole text; offsets in code points, ends exclusive.

    Returns one row per input row: ``row`` (struct of all input columns), ``base`` and ``spans``
    (arrays of kind:start:end, by kind as in ``KINDS``, then start; ``spans`` holds the base too) and
    the counts of base spans ``n_email``, ``n_ip``, ``n_card``, ``n_phone``.  Added spans are of the
    same kinds or secrets.

    Null counts as empty; texts without findings have empty arrays.  Spans of different kinds may
    overlap.  Repeated rows have equal results; an empty table gives an empty result; columns may
    have any names.
    """
    counts = ", ".join(f"n_{k} long" for k in BASE_KINDS)

    @F.pandas_udf(f"{counts}, base array<string>, spans array<string>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        def shown(spans):
            return [f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans)]

        for texts in batches:
            rows = []
            for text in texts:
                base = base_spans(text)
                held = set(base) | set(added(text, base, weights))
                rows.append((*(sum(k == i for k, _, _ in base) for i in range(len(BASE_KINDS))), shown(base), shown(held)))
            yield pd.DataFrame(rows, columns=[*(f"n_{k}" for k in BASE_KINDS), "base", "spans"])

    found = docs.select(as_row(docs), find(whole(F.col(f"`{text_col}`"))).alias("found"))
    return found.select("row", "found.*")
