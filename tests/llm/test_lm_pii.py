import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from airfill.llm import brown_lm, pii
from airfill.llm.runtime import keyed, remainder
from tests.llm.helpers import edge_docs, empty_docs, table, texts


def brute(rows):
    """The base model, counted and scored word by word."""
    split = [(i, [w for w in re.split(rb"[\x20\t-\r]+", (t or "").encode().lower()) if w]) for i, t in rows]
    out = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2
    c = Counter()
    for i, w in split:
        if not out(i):
            c.update([*w, None])
    n, v = sum(c.values()), len(c)
    return sorted((repr(i), out(i), len(w) + 1, sum(c[x] > 0 for x in [*w, None]), n,
                   round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in [*w, None]), 4)) for i, w in split)


def shown(rows):
    return sorted((repr(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4))
                  for r in rows)


def test_base_model_equals_brute_force_and_classes_beat_it(spark):
    docs = table(spark, "documents", "/root/testdata/sf0.01")
    rows = brown_lm.score_corpus(docs).collect()
    for got, want in zip(shown(rows), brute([(r["doc_id"], r["text"]) for r in docs.collect()]), strict=True):
        assert got[:5] == want[:5] and math.isclose(got[5], want[5], rel_tol=1e-7)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > 0.99 * sum(r["base_score"] for r in held)  # log10: nearer 0 is better


def test_small_model_with_every_path(spark):
    """Few items and a tiny lookup, so that words take the join too."""
    rows = [(i, t) for i, t in texts() if i != 12]
    got = brown_lm.score_corpus(edge_docs(spark, rows).repartition(3), frequent=5, lookup=8, tails=4, classes=4).collect()
    for a, b in zip(shown(got), brute(rows), strict=True):
        assert a[:5] == b[:5] and math.isclose(a[5], b[5], rel_tol=1e-6, abs_tol=1e-4)
    assert brown_lm.score_corpus(empty_docs(spark)).count() == 0


def test_probabilities_sum_to_one(spark):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(30)]
    docs = edge_docs(spark, [(i, " ".join(rng.choices(words, weights=range(30, 0, -1), k=20))) for i in range(60)])
    rows = keyed(docs).withColumn("held_out", remainder("doc_id", 7) == 2)
    model, _ = brown_lm.train(rows.where(~F.col("held_out")).select("doc_id", "text"), frequent=10, lookup=15, tails=3, classes=5)
    it = model.items
    for previous in range(it.n):
        step = model.move[model.label[previous]][model.label] + model.emit
        total = sum(math.exp(step[x]) for x in range(it.first_tail))
        assert math.isclose(total, 1, rel_tol=1e-9)


def test_exchange_finds_alternating_classes():
    rng = np.random.default_rng(0)
    pairs = np.zeros((21, 21))
    for _ in range(4000):  # items 1-10 are followed by 11-20 and the other way round
        a, b = rng.integers(1, 11), rng.integers(11, 21)
        pairs[a, b] += 1
        pairs[b, rng.integers(1, 11)] += 1
    label = brown_lm.exchange(pairs, classes=3)
    assert len(set(label[1:11])) == 1 and len(set(label[11:])) == 1 and label[1] != label[11]


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def digits(s):
    return re.sub(r"[^0-9]", "", s)


def reference(t):
    return {"email": [m.span() for m in EMAIL.finditer(t)],
            "ip": [m.span() for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))],
            "card": [m.span() for m in CARD.finditer(t) if 13 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))],
            "phone": [m.span() for m in PHONE.finditer(t) if 9 <= len(digits(m.group())) <= 15]}


def test_base_spans_equal_the_patterns():
    rng = random.Random(2)
    bits = [*"ab1239..@@-+ ()\n%_", "255.", "1.2.3.4", "4111111111111111", "+1 555", "é", "①", "٣"]
    for _ in range(15000):
        t = "".join(rng.choices(bits, k=rng.randint(0, 40)))
        assert pii.base_spans(t) == reference(t), repr(t)


def test_scans_stay_linear():
    for t in ("a" * 300_000, "1" * 300_000, "a@" * 100_000, "1." * 150_000, "+1 " * 100_000, "1 " * 150_000, "12 " * 30_000,
              ("x" * 1000 + "12") * 300, "(" * 100_000 + "12", "ab(at)cd." * 10_000, "(at)" * 50_000, "a" * 300_000 + "@" + "b" * 300_000):
        pii.found_spans(t, pii.Field())


def test_regions_hold_whole_words_and_lose_no_seed():
    rng = random.Random(4)
    bits = ["12", "a", "b.c", " ", "  ", "\n", "@", " (at) ", "[AT]", "x" * 30, "é", "-", "(dot)"]
    for _ in range(3000):
        t = "".join(rng.choices(bits, k=rng.randint(0, 40)))
        own = pii.regions(t)
        assert all(a < b for a, b in own) and all(x[1] < y[0] for x, y in zip(own, own[1:], strict=False))
        for a, b in own:
            assert (a == 0 or t[a - 1].isspace()) and (b == len(t) or t[b].isspace()), repr(t)
        assert all(any(a <= m.start() and m.end() <= b for a, b in own) for m in pii.SEED.finditer(t)), repr(t)


@pytest.fixture(scope="module")
def field(spark):
    return pii.trained(keyed(table(spark, "documents", "/root/testdata/sf0.01")))


def test_field_adds_loosened_formats_and_no_other_numbers(field):
    def added(t):
        base, every = pii.found_spans(t, field)
        own = {(a, b, k) for k, kind in enumerate(pii.KINDS) for a, b in base[kind]}
        assert own <= set(every)
        return [(pii.KINDS[k], t[a:b]) for a, b, k in set(every) - own]
    assert added("please call (456) 555-2186 now") == [("phone", "(456) 555-2186")]
    assert added("send joe.smith (at) example.org ok") == [("email", "joe.smith (at) example.org")]
    assert added("call 555-123-4567 ok") == [("phone", "555-123-4567")]
    for address in ("john.smith (at) mail.department.university.edu", "alexander.christopherson (at) x.org", "joe [at] site [dot] org"):
        assert added(f"write {address} today") == [("email", address)]
        assert pii.redact(address, pii.found_spans(address, field)[1]) == "<EMAIL>"
    for t in ("on 2024-05-17 at 12:30:45", "order 12345 done", "pi is 3.14159", "v 1.2.3.4567 ok", "the years 1990, 1991, 1992"):
        assert added(t) == []


def test_added_spans_are_found_whole(field):
    """Recall of loosened formats made by other rules than the training examples'."""
    rng = random.Random(77)
    digits = lambda n: "".join(rng.choices("0123456789", k=n))
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(3, 14)))

    def card():
        d = rng.choice("45") + digits(14)
        return next(d + c for c in "0123456789" if pii.luhn(d + c))

    def split(d, sign):
        return sign.join(d[i:i + 4] for i in range(0, 16, 4))

    forms = [lambda: f"{word()}.{word()} (at) {'.'.join(word() for _ in range(rng.randint(1, 5)))}.info",
             lambda: f"{word()}_{digits(2)}[at]{word()}.example.de", lambda: f"{word()} (AT) {word()} (dot) com",
             lambda: split(card(), "."), lambda: split(card(), "/"), lambda: f"{digits(3)}-{digits(3)}-{digits(4)}",
             lambda: f"({digits(3)}) {digits(3)}-{digits(4)}", lambda: f"1-{digits(3)}-{digits(3)}-{digits(4)}",
             lambda: f"{digits(3)}.{digits(3)}.{digits(4)}"]
    for form in forms:
        hits = 0
        for _ in range(60):
            entity, before = form(), f"{word()} {word()} "
            t = f"{before}{entity} {word()} {word()}"
            hits += any((a, b) == (len(before), len(before) + len(entity)) for a, b, _ in pii.found_spans(t, field)[1])
        assert hits >= 54, (form(), hits)
    others = [lambda: digits(16), lambda: digits(9), lambda: f"{digits(5)}-{digits(5)}", lambda: f"19{digits(2)}-07-1{digits(1)}",
              lambda: f"978-{digits(1)}-{digits(3)}-{digits(5)}-{digits(1)}", lambda: f"{digits(3)},{digits(3)},{digits(3)}"]
    for other in others:
        made = [f"{word()} {word()} {n} {word()}" for n in (other() for _ in range(60)) if not pii.luhn(pii._digits(n))]
        assert sum(bool(pii.found_spans(t, field)[1]) for t in made) <= 3, other()


def test_decoder_equals_every_segmentation():
    """The best score over all sets of segments that don't overlap, by trying them all."""
    rng = np.random.default_rng(3)
    for t in ("a 555-123-4567 or 41 b", "x.y (at) z.ab.cd, 12 34 567 89", "no 1.2.3.4 (12) 345-6789"):
        r = pii.Region(t, 0, len(t))
        assert r.segments
        for _ in range(30):
            f = pii.Field()
            f.w = rng.normal(0, 2, f.w.shape)
            s = f.scores(r)
            usable = [x for x in range(len(s)) if s[x] > pii.MARGIN]

            def best(token, usable=usable, s=s):
                free = [x for x in usable if r.segments[x][0] >= token]
                return max([0.0, *(s[x] + best(r.segments[x][1]) for x in free)])

            got = f.decode(r, [])
            score = {(a, b, k): v for (_, _, a, b, k, _), v in zip(r.segments, s, strict=True)}
            assert all(x[1] <= y[0] for x, y in zip(got, got[1:], strict=False))
            assert math.isclose(sum(score[x] for x in got), best(0), abs_tol=1e-9)


def test_the_fit_sample_is_bounded_by_texts(spark):
    """Rows without an id and copies take no more places than any other text."""
    rows = [(None, f"row {i} call +1 555 {1000000 + i}") for i in range(300)] + [(i, "copy +1 (555) 123-4567") for i in range(300)]
    taken = []
    kept = pii.examples
    try:
        pii.examples = lambda texts: taken.append(texts) or kept(texts)
        pii.trained(keyed(edge_docs(spark, rows).repartition(5)), sample=20)
        pii.trained(keyed(edge_docs(spark, [(1, None), (2, "x" * 5000 + "12"), (3, "")])), sample=20)
        pii.trained(keyed(empty_docs(spark)))
    finally:
        pii.examples = kept
    assert 0 < len(taken[0]) <= 20 and len(set(taken[0])) == len(taken[0]) and taken[1:] == [[], []]


def test_marginals_are_probabilities(field):
    t = "a 555-123-4567 or 4111 1111 1111 1111 b"
    r = pii.Region(t, 0, len(t))
    p = field.marginals(r)
    assert len(p) and (p >= -1e-9).all()
    for token in range(len(r.tokens)):
        assert sum(x for x, (i, j, *_) in zip(p, r.segments, strict=True) if i <= token < j) <= 1 + 1e-9


def test_spans_of_the_table_and_awkward_rows(spark):
    docs = table(spark, "documents", "/root/testdata/sf0.01")
    for frame, rows in ((docs, [(r["doc_id"], r["text"]) for r in docs.collect()]), (edge_docs(spark), texts())):
        want = sorted((repr(i), *(len(reference(t or "")[k]) for k in pii.KINDS)) for i, t in rows)
        got = pii.spans(frame).collect()
        assert sorted((repr(r["doc_id"]), r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]) for r in got) == want
    assert pii.spans(empty_docs(spark)).count() == 0


def test_redaction_keeps_columns(spark):
    docs = edge_docs(spark)
    got = pii.redacted(docs)
    assert got.columns == docs.columns
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[15]["text"] == "mail <EMAIL> or <PHONE>, host <IP>, card <CARD>" and by[15]["n_chars"] == len(by[15]["text"])
    assert by[6]["text"] is None and by[9]["text"] == "one"
