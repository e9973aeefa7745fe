"""Personal data (operator 9): a semi-Markov conditional random field over candidate spans.

Base spans come from fixed formats per kind and always stay. Text around digits and at-signs,
grown to whole words, makes regions of tokens; in a region every run of tokens that could be an
entity is a candidate segment of each kind, scored on features of the whole span (digits,
separators, grouping, checksum, what stands before). Dynamic programming over these segments, none
longer than the longest entity of its kind, picks the boundaries and kinds of a region together;
what it finds beyond the base spans is added.

The field is trained on a bounded sample of documents by distant supervision: regions labelled
by the base spans, the same regions with the formats loosened (no plus sign, spelled-out at and
dots, other separators) and number-like text that is none of it. The sample is the SAMPLE distinct
texts of smallest digest, so neither copies nor missing ids change its size; a document gives at
most four stretches of STRETCH characters. Only this fit is a sample; every whole text is searched.

Texts are independent: one map, no shuffle. Scans are linear in the text: at-signs and runs of
digits are visited once each.

Defined results: null and empty texts have no spans; spans are code-point offsets, end
exclusive; spans of different kinds may overlap if both are base spans; repeated rows and ids are
searched each; other columns are left behind (``redacted`` keeps them).
"""

from __future__ import annotations

import hashlib
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airfill.llm.runtime import batch_of, keyed, map_arrow, slices

KINDS = ["email", "ip", "card", "phone"]
#: Texts the field is fitted on, characters of a stretch of theirs, regions of each sort, passes, step.
SAMPLE, STRETCH, REGIONS, PASSES, RATE = 2_000, 400, 250, 12, 0.15
#: Log odds over leaving the tokens out that an added span needs.
MARGIN = 1.6

Span = tuple[int, int]

# The formats of the base spans
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)+")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
NUMBER = re.compile(r"[0-9]+")


def emails(text: str) -> list[Span]:
    """Leftmost matches of local@domain, found from the at-signs."""
    out, free = [], 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
            free = m.end()
        at = text.find("@", max(at + 1, free))
    return out


def octet(part: str) -> bool:
    short = part.lstrip("0")
    return len(short) <= 3 and int(short or 0) <= 255


def ips(text: str) -> list[Span]:
    """Runs of numbers joined by single dots, four at a time from the left."""
    out = []
    for m in DOTTED.finditer(text):
        parts = [(m.start() + n.start(), n.group()) for n in NUMBER.finditer(m.group())]
        for i in range(0, len(parts) - 3, 4):
            four = parts[i:i + 4]
            if all(octet(p) for _, p in four):
                out.append((four[0][0], four[3][0] + len(four[3][1])))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(NUMBER.findall(text))


def cards(text: str) -> list[Span]:
    out = []
    for m in CARD.finditer(text):
        if m.end() - m.start() <= 37:
            d = _digits(m.group())
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(m.span())
    return out


def phones(text: str) -> list[Span]:
    return [m.span() for m in PHONE.finditer(text) if 9 <= len(_digits(m.group())) <= 15]


def base_spans(text: str) -> dict[str, list[Span]]:
    """The base spans of each kind."""
    some = NUMBER.search(text) is not None
    return {"email": emails(text) if "@" in text else [], "ip": ips(text) if some and "." in text else [],
            "card": cards(text) if some else [], "phone": phones(text) if "+" in text else []}


# --- regions and segments -------------------------------------------------------------------

TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|[^\sA-Za-z0-9]|\s+")
#: An at-sign, or one that is spelled out; a dot between labels, or one that is.
AT = re.compile(r"@|\s?[(\[]\s?at\s?[)\]]\s?", re.I)
DOT = re.compile(r"\s?[(\[]\s?dot\s?[)\]]\s?", re.I)
#: What a region grows around.
SEED = re.compile(rf"[0-9]{{2,}}|{AT.pattern}", re.I)
#: Characters on either side of a seed that belong to its region, before it grows to whole words.
REACH = 24
# The longest local part and domain of a mail address; digits and, at 19 digits and a
# separator or two after each, characters of the longest number
LOCAL_MOST, DOMAIN_MOST, DIGITS_MOST, NUMBER_MOST = 64, 255, 20, 64
LABELS = re.compile(rf"[A-Za-z0-9-]+(?:(?:\.|{DOT.pattern})[A-Za-z0-9-]+)+", re.I)
JOINT = re.compile(rf"\.|{DOT.pattern}", re.I)
SPACE = re.compile(r"\s")
# Words that announce a kind
CUES = {"email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "addr"),
        "card": ("card", "visa", "payment", "credit"), "phone": ("tel", "phone", "call", "mobile", "fax")}
FEATURES = ["bias", "digits_0", "digits_7", "digits_9", "digits_10", "digits_13", "digits_20", "plus", "paren", "at", "spelled_at",
            "domain", "dots_3", "octets", "luhn", "spaces", "dashes", "dots", "letters", "groups_equal", "one_group",
            "edges", "cue", "long", "slashes", "short_group", "left_zero",
            "word_gap", "phone_groups", "other_groups", "tail_cut"]


def reach(text: str, at: re.Match) -> tuple[int, list[int]]:
    """What may belong to the address around ``at``: the first character of its local part, and the
    ends of its domain after each label from the second on (none: no address)."""
    start, least = at.start(), max(0, at.start() - LOCAL_MOST)
    while start > least and text[start - 1] in LOCAL:
        start -= 1
    m = LABELS.match(text, at.end(), at.end() + DOMAIN_MOST)
    if m is None or start == at.start():
        return start, []
    return start, [*(j.start() for j in JOINT.finditer(text, m.start(), m.end()))][1:] + [m.end()]


def regions(text: str) -> list[Span]:
    """Stretches around seeds, grown to whole words and merged where they touch."""
    out: list[list[int]] = []
    last = 0
    for m in SEED.finditer(text):
        a, b = max(0, m.start() - REACH), min(len(text), m.end() + REACH)
        if not m.group()[0].isdigit():
            start, ends = reach(text, m)
            a, b = min(a, start), max([b, *ends])
        if a > last:  # to the white space before; what an earlier region holds is not looked at again
            while a > last and not text[a - 1].isspace():
                a -= 1
        if b > last:
            end = SPACE.search(text, b)
            b = end.start() if end else len(text)
        if out and a <= last:
            out[-1][1] = last = max(last, b)
        else:
            out.append([a, b])
            last = b
    return [(a, b) for a, b in out]


def span_features(text: str, a: int, b: int, kind: str) -> np.ndarray:
    s = text[a:b]
    if kind == "email":
        s = DOT.sub(".", s)
    d = _digits(s)
    groups = NUMBER.findall(s)
    sizes = {len(g) for g in groups}
    order = [len(g) for g in groups]
    joint = JOINT.match(text, b)
    area = order[-3:] == [3, 3, 4] and (len(order) == 3 or len(order) == 4 and order[0] <= 3)
    n = len(d)
    left, right = text[a - 1:a], text[b:b + 1]
    before = text[max(0, a - 12):a].lower()
    on = {
        "bias": 1, "digits_0": n == 0, "digits_7": n in (7, 8), "digits_9": n == 9, "digits_10": 10 <= n <= 12,
        "digits_13": 13 <= n <= 19, "digits_20": n > 19, "plus": s.startswith("+"), "paren": "(" in s and any(c.isdigit() for c in s),
        "at": "@" in s, "spelled_at": "@" not in s and AT.search(s) is not None,
        "domain": bool(re.search(r"[A-Za-z0-9]\.[A-Za-z]{2,}$", s)), "dots_3": len(groups) == 4 and s.count(".") == 3,
        "octets": len(groups) == 4 and all(octet(g) for g in groups), "luhn": 13 <= n <= 19 and luhn(d),
        "spaces": " " in s, "dashes": "-" in s, "dots": "." in s, "letters": any(c.isalpha() for c in s),
        "groups_equal": len(groups) > 2 and len(sizes) == 1, "one_group": len(groups) == 1,
        "edges": not (left.isalnum() or right.isalnum() or left in ("@", "-", ".", "/", "+") or right in ("@", "/")),
        "cue": any(c in before for c in CUES[kind]), "long": b - a > 40, "slashes": "/" in s or ":" in s or "," in s,
        "short_group": any(len(g) == 1 for g in groups), "left_zero": d.startswith("0"),
        "word_gap": bool(re.search(r"[A-Za-z0-9]\s+[A-Za-z0-9]", s)) and any(c.isalpha() for c in s),
        "phone_groups": area, "other_groups": not area and len(order) > 1,
        "tail_cut": joint is not None and text[joint.end():joint.end() + 1].isalnum(),
    }
    return np.array([float(on[f]) for f in FEATURES])


class Region:
    """Tokens of a stretch of text and its candidate segments: (first token, end token, start,
    end, kind number, features). Numbers hold no letter; addresses are found from their at-sign."""

    def __init__(self, text: str, a: int, b: int):
        self.text = text
        self.tokens = [(a + m.start(), a + m.end()) for m in TOKEN.finditer(text[a:b])]
        self.segments: list[tuple[int, int, int, int, int, np.ndarray]] = []
        for i, (start, _) in enumerate(self.tokens):
            if self.starts(start, "+("):
                self.numbers(i, start)
        self.addresses(a, b)

    def starts(self, at: int, signs: str) -> bool:
        """Whether an entity may start here: at a sign, or at a letter or digit after neither."""
        head = self.text[at]
        return head in signs or head.isascii() and head.isalnum() and not (at and self.text[at - 1].isalnum())

    def ends(self, at: int) -> bool:
        return self.text[at - 1].isalnum() and not (at < len(self.text) and self.text[at].isalnum())

    def add(self, i: int, j: int, kind: int) -> None:
        start, end = self.tokens[i][0], self.tokens[j - 1][1]
        self.segments.append((i, j, start, end, kind, span_features(self.text, start, end, KINDS[kind])))

    def numbers(self, i: int, start: int) -> None:
        n = dots = blanks = 0
        for j in range(i, len(self.tokens)):
            x, y = self.tokens[j]
            piece = self.text[x:y]
            if piece[0].isalpha() or "\n" in piece or y - start > NUMBER_MOST or n > DIGITS_MOST:
                return
            if piece[0].isdigit():
                n += sum(c.isdigit() for c in piece)
            dots += piece == "."
            blanks += piece.isspace()
            if not self.ends(y):
                continue
            if dots == 3 and n >= 4 and not blanks:
                self.add(i, j + 1, 1)
            if 12 <= n <= DIGITS_MOST:
                self.add(i, j + 1, 2)
            if 7 <= n <= 15:
                self.add(i, j + 1, 3)

    def addresses(self, a: int, b: int) -> None:
        first = {x: i for i, (x, _) in enumerate(self.tokens)}
        after = {y: i + 1 for i, (_, y) in enumerate(self.tokens)}
        for m in AT.finditer(self.text, a, b):
            start, ends = reach(self.text, m)
            ends = [after[y] for y in ends if y in after and self.ends(y)]
            for x in range(max(a, start), m.start() if ends else 0):
                if x in first and self.starts(x, "_"):
                    for j in ends:
                        self.add(first[x], j, 0)


class Field:
    """Weights per kind and feature; a token outside any entity scores 0."""

    def __init__(self):
        self.w = np.zeros((len(KINDS), len(FEATURES)))

    def scores(self, r: Region) -> list[float]:
        return [float(self.w[k] @ f) for *_, k, f in r.segments]

    def marginals(self, r: Region) -> np.ndarray:
        """Each segment's probability, summing over all segmentations."""
        n, s = len(r.tokens), self.scores(r)
        by_end: list[list[int]] = [[] for _ in range(n + 1)]
        by_start: list[list[int]] = [[] for _ in range(n + 1)]
        for x, (i, j, *_) in enumerate(r.segments):
            by_end[j].append(x)
            by_start[i].append(x)
        forward, back = [0.0] * (n + 1), [0.0] * (n + 1)
        for t in range(1, n + 1):
            v = [forward[t - 1], *(forward[r.segments[x][0]] + s[x] for x in by_end[t])]
            top = max(v)
            forward[t] = top + float(np.log(sum(np.exp(u - top) for u in v))) if len(v) > 1 else v[0]
        for t in range(n - 1, -1, -1):
            v = [back[t + 1], *(back[r.segments[x][1]] + s[x] for x in by_start[t])]
            top = max(v)
            back[t] = top + float(np.log(sum(np.exp(u - top) for u in v))) if len(v) > 1 else v[0]
        return np.array([np.exp(forward[i] + s[x] + back[j] - forward[n]) for x, (i, j, *_) in enumerate(r.segments)])

    def decode(self, r: Region, closed: list[Span]) -> list[tuple[int, int, int]]:
        """The best segmentation's entities (start, end, kind) that touch none of ``closed``."""
        n, s = len(r.tokens), self.scores(r)
        by_end: list[list[int]] = [[] for _ in range(n + 1)]
        for x, (_, j, a, b, *_) in enumerate(r.segments):
            if s[x] > MARGIN and not any(a < d and c < b for c, d in closed):
                by_end[j].append(x)
        best, back = [0.0] * (n + 1), [-1] * (n + 1)
        for t in range(1, n + 1):
            best[t] = best[t - 1]
            for x in by_end[t]:
                v = best[r.segments[x][0]] + s[x]
                if v > best[t]:
                    best[t], back[t] = v, x
        out, t = [], n
        while t > 0:
            x = back[t]
            if x < 0:
                t -= 1
            else:
                i, _, a, b, k, _ = r.segments[x]
                out.append((a, b, k))
                t = i
        return out[::-1]

    def fit(self, examples: list[tuple[str, dict[Span, int]]], passes: int = PASSES, rate: float = RATE) -> None:
        """Stochastic gradient of the log likelihood with a small ridge. An example is a text and
        the kind of each of its entities' spans."""
        built = []
        for text, gold in examples:
            r = Region(text, 0, len(text))
            if r.segments:
                built.append((r, np.array([float(gold.get((a, b)) == k) for _, _, a, b, k, _ in r.segments])))
        rng = random.Random(3)
        square = np.full(self.w.shape, 1e-6)
        for _ in range(passes):
            rng.shuffle(built)
            for r, gold in built:
                off = gold - self.marginals(r)
                g = -1e-3 * self.w
                for x, (*_, k, f) in enumerate(r.segments):
                    if abs(off[x]) > 1e-4:
                        g[k] += off[x] * f
                square += g * g
                self.w += rate * g / np.sqrt(square)


def examples(texts: list[str], most: int = REGIONS) -> list[tuple[str, dict[Span, int]]]:
    """Regions of ``texts`` labelled by the base spans, loosened copies of those, and texts with
    numbers of other sorts. Entities are labelled also where the base format doesn't reach."""
    rng = random.Random(5)
    out: list[tuple[str, dict[Span, int]]] = []
    seen: list[tuple[str, str, str, int]] = []  # before, entity, after, kind
    for t in texts:
        base = base_spans(t)
        spans = sorted((a, b, k) for k, kind in enumerate(KINDS) for a, b in base[kind])
        for a, b in regions(t)[:4]:
            if b - a > STRETCH:
                continue
            own = {(x - a, y - a): k for x, y, k in spans if a <= x and y <= b}
            if len(out) < 2 * most and not any(x < b and a < y and not (a <= x and y <= b) for x, y, _ in spans):
                out.append((t[a:b], own))
        for a, b, k in spans[:4]:
            if b - a <= 100:
                seen.append((t[max(0, a - 20):a], t[a:b], t[b:b + 20], k))
    rng.shuffle(seen)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghilmnoprstuvw") for _ in range(rng.randint(2, 8)))

    def card() -> str:
        d = rng.choice("3456") + digits(14)
        return next(d + c for c in "0123456789" if luhn(d + c))

    def made(kind: int) -> str:
        if kind == 0:
            local = rng.choice([f"{word()}.{digits(2)}", word(), f"{word()}.{word()}{word()}"])
            return f"{local}@{'.'.join(word() for _ in range(rng.randint(1, 4)))}.{rng.choice(['com', 'org', 'net', 'edu'])}"
        if kind == 1:
            return ".".join(str(rng.randint(0, 255)) for _ in range(4))
        if kind == 2:
            return card()
        return f"+{rng.randint(1, 99)} ({digits(3)}) {digits(3)}-{digits(4)}"

    def loosened(entity: str, kind: int) -> str:
        if kind == 0:
            local, domain = entity.rsplit("@", 1)
            return f"{local}{rng.choice([' (at) ', ' [at] ', '(at)'])}{domain.replace('.', rng.choice(['.', '.', ' (dot) ', '[dot]']))}"
        if kind == 2:
            d = _digits(entity)
            return rng.choice([".", "-", " "]).join(d[i:i + 4] for i in range(0, len(d), 4))
        if kind == 3:
            d = _digits(entity)[-10:]
            return rng.choice([f"({d[:3]}) {d[3:6]}-{d[6:]}", f"{d[:3]}-{d[3:6]}-{d[6:]}", f"1-{d[:3]}-{d[3:6]}-{d[6:]}", f"{d[:3]}.{d[3:6]}.{d[6:]}"])
        return entity

    for k in range(len(KINDS)):
        own = [x for x in seen if x[3] == k][:most // 2]
        own += [(f"{word()} {word()} ", made(k), f" {word()} {word()}", k) for _ in range(max(20, most // 4))]
        for before, entity, after, _ in own:
            for e in (entity, loosened(entity, k)):
                text = f"{before}{e}{after}"
                out.append((text, {(len(before), len(before) + len(e)): k}))
    for _ in range(most):
        y, m, d = rng.randint(1950, 2030), rng.randint(1, 12), rng.randint(1, 28)
        number = rng.choice([
            f"{y}-{m:02}-{d:02}", f"{d:02}.{m:02}.{y}", f"{m:02}/{d:02}/{y} {d:02}:{m:02}:30", digits(rng.randint(2, 30)),
            f"{digits(3)},{digits(3)},{digits(3)}.{digits(2)}", f"{rng.randint(1, 9)}.{rng.randint(0, 20)}.{digits(3)}",
            f"{rng.randint(300, 999)}.{digits(3)}.{rng.randint(256, 999)}.{digits(2)}", f"{digits(4)} {digits(3)} {digits(5)}",
            f"{y}-{m:02}-{d:02} {digits(8)}", f"{digits(16)}", f"{digits(4)}-{digits(4)}-{digits(4)}-{digits(4)}",
            f"{digits(3)} {digits(4)}", f"{digits(5)}-{digits(5)}", f"{y}, {y + 1}, {y + 2}", f"@{word()}", f"{word()}@{word()}",
            f"{digits(1)} {digits(2)} {digits(3)} {digits(4)}", f"{digits(10)}", f"0x{digits(10)}"])
        if 13 <= len(_digits(number)) <= 19 and luhn(_digits(number)):
            continue
        cue = rng.choice([word(), word(), *(c for kind in KINDS for c in CUES[kind])])
        out.append((f"{word()} {cue} {number} {word()} {word()}.", {}))
    return out


def trained(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """A field fitted on regions of the ``sample`` distinct texts of ``docs`` (doc_id, text) that have
    the smallest digests."""
    digest = F.xxhash64("text")
    least = docs.select(digest.alias("digest")).distinct().orderBy("digest").limit(sample)
    last = least.agg(F.max("digest")).first()[0]
    field = Field()
    if last is None:
        field.fit(examples([]))
        return field

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            found, of = [], []
            for t, h in zip(texts, batch.column("digest").to_pylist(), strict=True):
                text = t.decode("utf-8")
                own = [(a, b) for a, b in regions(text) if b - a <= STRETCH][:4]
                if own:  # what the examples are made of: a few regions with their surroundings
                    found.append("\n".join(text[max(0, a - 30):b + 30] for a, b in own))
                    of.append(h)
            yield batch_of(digest=pa.array(of, pa.int64()), stretch=pa.array(found, pa.string()))

    some = docs.select(digest.alias("digest"), "text").where(F.col("digest") <= last)
    stretches = map_arrow(some, run, "digest long, stretch string").groupBy("digest").agg(F.min("stretch").alias("stretch"))
    field.fit(examples(sorted(stretches.toArrow().column("stretch").to_pylist())))
    return field


def found_spans(text: str, field: Field | None) -> tuple[dict[str, list[Span]], list[tuple[int, int, int]]]:
    """(base spans, all spans as (start, end, kind number))."""
    base = base_spans(text)
    every = [(a, b, k) for k, kind in enumerate(KINDS) for a, b in base[kind]]
    if field is not None:
        closed = sorted((a, b) for a, b, _ in every)
        for a, b in regions(text):
            near = [(c, d) for c, d in closed if c < b and a < d] if len(closed) < 50 else _touching(closed, a, b)
            every += field.decode(Region(text, a, b), near)
    return base, every


def _touching(closed: list[Span], a: int, b: int) -> list[Span]:
    """Spans of the sorted ``closed`` that touch [a, b)."""
    from bisect import bisect_left
    hi = bisect_left(closed, (b, 0))
    return [s for s in closed[max(0, bisect_left(closed, (a - 400, 0))):hi] if s[1] > a]


def shown(spans: list[tuple[int, int, int]]) -> str:
    """kind:start:end, by kind as listed, then start."""
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[2], s[0], s[1])))


def spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, a count of base spans per kind, base_sha256, spans."""
    rows = keyed(docs, id_col, text_col)
    field = rows.sparkSession.sparkContext.broadcast(trained(rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches):
            cols: dict[str, list] = {k: [] for k in (*(f"n_{kind}" for kind in KINDS), "base_sha256", "spans")}
            for t in texts:
                base, every = found_spans(t.decode("utf-8"), field.value)
                for kind in KINDS:
                    cols[f"n_{kind}"].append(len(base[kind]))
                own = [(a, b, k) for k, kind in enumerate(KINDS) for a, b in base[kind]]
                cols["base_sha256"].append(hashlib.sha256(shown(own).encode()).hexdigest())
                cols["spans"].append(shown(every))
            yield batch_of(doc_id=batch.column("doc_id"), **{
                k: pa.array(v, pa.int64() if k.startswith("n_") else pa.string()) for k, v in cols.items()})

    return map_arrow(rows, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
                                "base_sha256 string, spans string")


def redact(text: str, every: list[tuple[int, int, int]]) -> str:
    """``text`` with each span replaced by its kind in angle brackets; overlapping spans become
    one, named by the earliest."""
    out, at = [], 0
    for a, b, k in sorted(every):
        if a >= at:
            out += [text[at:a], f"<{KINDS[k].upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, text_col: str = "text", size_col: str = "n_chars") -> DataFrame:
    """``docs`` with personal data replaced in the text (and ``size_col``, if there, the new
    length of a changed text); null text stays null."""
    field = docs.sparkSession.sparkContext.broadcast(trained(keyed(docs, "doc_id", text_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, text_col):
            new = []
            for t, was in zip(texts, batch.column(text_col).to_pylist(), strict=True):
                s = t.decode("utf-8")
                new.append(was if was is None else redact(s, found_spans(s, field.value)[1]))
            columns = [pa.array(new, batch.schema.field(text_col).type) if n == text_col else c
                       for n, c in zip(batch.schema.names, batch.columns, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    out = map_arrow(docs, run, docs.schema)
    return out.withColumn(size_col, F.length(text_col).cast(docs.schema[size_col].dataType)) if size_col in docs.columns else out
