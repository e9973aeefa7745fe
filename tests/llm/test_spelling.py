import random
import re
import zlib
from collections import Counter

import pytest

from airfill.llm import spelling
from tests.llm.helpers import edge_docs, empty_docs, table, texts


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def counted(rows):
    out = Counter()
    for i, t in rows:
        for w in re.findall("[a-zÀ-ÿ]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")):
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            out[w[:h % len(w)] + w[h % len(w) + 1:] if h % 97 == 0 else w] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def expected(words):
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), None if form[w] is None else words[form[w]]))
    return sorted(out)


def test_lists_find_all_words_one_edit_away_once():
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("abé", k=rng.randint(5, 8))) for _ in range(400)} | {"aaaaa", "aaaaaa", "aaaaaaa"})
    back = sorted(w[::-1] for w in words)
    ahead, reverse = spelling.SortedList(words, [1] * len(words)), spelling.SortedList(back, [1] * len(words))
    for w in words:
        first = spelling.beginning(len(w))
        got = [words[i] for i in ahead.near(w, first)]
        got += [v for v in (back[i][::-1] for i in reverse.near(w[::-1], len(w) // 2)) if v[:first] != w[:first]]
        assert sorted(got) == [v for v in words if one_edit(w, v)], w


def test_prefixes_that_are_too_far_are_no_one_edit_neighbours():
    rng = random.Random(4)
    words = ["".join(rng.choices("ab", k=rng.randint(5, 7))) for _ in range(60)]
    for a in words:
        for b in words:
            if one_edit(a, b):
                assert all(spelling.reachable(b[:k], a) for k in range(len(b) + 1))
    assert not spelling.reachable("xyab", "abcab") and not spelling.reachable("abcdefgh", "abcde")


@pytest.mark.parametrize("per_slice, questions", [(spelling.SLICE, spelling.QUESTIONS), (7, 5)])
def test_many_close_words_equal_brute_force(spark, per_slice, questions):
    rng = random.Random(1)
    base = ["".join(rng.choices("abcàü", k=rng.randint(4, 7))) for _ in range(60)]
    rows = []
    for i in range(300):
        own = rng.choices(base, k=25, weights=[1 / (k + 1) for k in range(60)])
        own = [w if rng.random() < 0.7 else (w[:2] + rng.choice("abc") + w[2:] if rng.random() < 0.5 else w[:1] + w[2:]) for w in own]
        rows.append((i, rng.choice([" ", "-", "\n"]).join(own).title()))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = expected(counted(rows))
    assert sum(r[1] is not None for r in want) > 20 and any(r[1] != r[2] for r in want if r[1])
    assert sorted(map(tuple, spelling.variants(docs, per_slice=per_slice, questions=questions).collect())) == want


def test_a_beginning_that_all_words_share(spark):
    words = {"prefix" + a + b + c: 1 + (i + j + k) % 5 for i, a in enumerate("abc") for j, b in enumerate("abcd") for k, c in enumerate("aeiou")}
    frame = spark.createDataFrame(list(words.items()), "word string, n long")
    got = {r["word"]: r["n_near"] for r in spelling.near_words(frame, per_slice=10, questions=6).collect()}
    assert got == {w: n for w in words if (n := sum(one_edit(w, v) for v in words))}


def test_awkward_rows_equal_brute_force(spark):
    assert sorted(map(tuple, spelling.variants(edge_docs(spark)).collect())) == expected(counted(texts()))
    assert spelling.variants(empty_docs(spark)).count() == 0


def test_roots_follow_long_chains(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(37)] + [("x", "w5")]
    got = {r["word"]: r["root"] for r in spelling.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "w37" for w, _ in chain}


def test_small_table_words_are_those_of_whole_texts(spark):
    docs = table(spark, "documents")
    got = {r["word"]: r["n"] for r in spelling.word_counts(docs).where("n >= 3").collect()}
    assert got == counted([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
