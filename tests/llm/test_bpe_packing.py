import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers as P
import pytest

from airfill.llm import bpe, packing
from tests.llm.helpers import edge_docs, empty_docs, table, texts


@pytest.fixture(scope="module")
def reference():
    import tiktoken
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.encoder(P.path("byte_bpe_50k.tiktoken")).ranks,
                             special_tokens={})


def test_encoding_equals_the_library_on_random_text(reference):
    rng = random.Random(1)
    pieces = ["a", "b", "s", "t", "re", "'s", "'", "'ll", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", "1", "½", "é",
              "中", "😀", "$", "_", "\0", "​", "　", "I", "'ve", "'d", "the", " thing"]
    cases = ["", "'s", " 's", "it''s", "'sabc", "  abc", "\n\nabc", "abc  "]
    cases += ["".join(rng.choices(pieces, k=rng.randint(1, 40))) for _ in range(3000)]
    cases += ["a" * 5000, "x" * 30 + " " + "y" * 31]
    e = bpe.encoder(P.path("byte_bpe_50k.tiktoken"))
    ids, n = e.encode([c.encode() for c in cases])
    ends = np.cumsum(n).tolist()
    for c, a, b in zip(cases, [0, *ends], ends, strict=False):
        assert ids[a:b].tolist() == reference.encode_ordinary(c), repr(c)
        assert e.decode(ids[a:b].tolist()) == c.encode()


def test_perfect_hash_is_minimal_and_perfect():
    e = bpe.encoder(P.path("byte_bpe_50k.tiktoken"))
    assert e.perfect.size == len(e.ranks)
    assert sorted(e.key_ids.tolist()) == sorted(e.ranks.values())


def test_heap_alone_gives_the_same_ids(reference):
    e = bpe.encoder(P.path("byte_bpe_50k.tiktoken"))
    for w in (" antidisestablishment", " thblend", "öffnungs", "0000000000000", "\n\n\n\n"):
        assert list(e.merge(w.encode())) == reference.encode_ordinary(w)


def test_round_trip_of_awkward_rows(spark, reference):
    got = bpe.round_trip(edge_docs(spark)).collect()
    want = []
    for i, t in texts():
        ids = reference.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert bpe.round_trip(empty_docs(spark)).count() == 0


def test_encode_then_decode_frames(spark):
    docs = edge_docs(spark)
    back = {bytes(r["bytes"]) for r in bpe.decode(bpe.encode(docs)).collect()}
    assert back == {(t or "").encode() for _, t in texts()}


@pytest.mark.parametrize("histogram", [{}, {5: 1}, {600: 1}, {600: 7}, {1023: 3, 1: 2}, {600: 1000}, {512: 9}, {341: 10, 342: 4}])
def test_plan_places_every_token_once(histogram):
    check_plan(packing.Plan(histogram), histogram)


def test_plan_of_a_broad_histogram_needs_few_cuts():
    x = (np.random.default_rng(0).lognormal(6, 1, 20000)).astype(int) % 1024
    h = dict(zip(*[v.tolist() for v in np.unique(x[x > 0], return_counts=True)], strict=True))
    pieces = check_plan(packing.Plan(h), h)
    assert pieces < 1.03 * sum(h.values())
    exact = sum(n for _, n in packing.repeats(h, 1024))
    assert exact > 0.5 * sum(m * n for m, n in h.items()) / 1024  # most sequences come from the solution


def check_plan(plan, histogram):
    sequences, n = defaultdict(list), 0
    for m, count in histogram.items():
        for rank in range(count):
            at = 0
            for start, size, sequence, offset in sorted(plan.pieces(m, rank)):
                assert start == at and size > 0
                at += size
                sequences[sequence].append((offset, size))
                n += 1
            assert at == m
    check_sequences(sequences)
    assert len(sequences) == plan.sequences
    return n


def check_sequences(sequences, window=1024):
    for own in sequences.values():
        at = 0
        for offset, size in sorted(own):
            assert offset == at
            at += size
        assert at <= window and at & (at - 1) == 0  # full, or a power of two: no padding


def check_pieces(rows, docs):
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = sorted((repr(i), tuple([*library.encode(t or "", add_special_tokens=False).ids, 0])) for i, t in docs)
    sequences, starts = defaultdict(list), defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
        assert zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and len(r["ids"]) == 4 * r["length"]
        starts[repr(r["doc_id"])].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist(), r["doc_tokens"]))
    check_sequences(sequences)
    total = sum(len(x) for _, x in want)
    assert sum(r["length"] for r in rows) == total
    for name, ids in want:
        if sum(k == name for k, _ in want) == 1:
            joined = [x for s, own, _ in sorted(starts[name]) for x in own]
            assert tuple(joined) == ids and {n for *_, n in starts[name]} == {len(ids)}
            at = 0
            for s, own, _ in sorted(starts[name]):
                assert s == at
                at += len(own)


def test_packing_of_awkward_rows(spark):
    check_pieces(packing.pack(edge_docs(spark).repartition(3), with_ids=True).collect(), texts())
    assert packing.pack(empty_docs(spark)).count() == 0


def test_packing_of_the_table(spark):
    docs = table(spark, "documents")
    check_pieces(packing.pack(docs.repartition(4), with_ids=True).collect(),
                 [(r["doc_id"], r["text"]) for r in docs.collect()])
