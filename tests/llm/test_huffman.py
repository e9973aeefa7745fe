import random
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

import public_tokenizers as P
from airfill.llm import huffman, merges, packing
from airfill.session import scratch_path
from tests.llm.helpers import edge_docs, empty_docs, table, texts


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(P.path("byte_bpe_50k.json"))


def expected(library, rows, end_id=huffman.END_ID):
    """The contract's rows, from whole texts and the library."""
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = library.encode(t or "", add_special_tokens=False).ids + [end_id]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def best_total(counts, limit):
    """The least total length of a prefix code with bounded lengths, by trying all length vectors."""
    def tries(i, room, worst):
        if i == len(counts):
            return 0
        found = worst
        for size in range(1, limit + 1):
            if room >= 2 ** -size:
                found = min(found, size * counts[i] + tries(i + 1, room - 2 ** -size, worst))
        return found
    return tries(0, 1.0, 10 ** 9)


def test_code_lengths_are_the_best_under_the_limit():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(2, 6)
        counts = [rng.choice([1, 2, 3, 10, 100, 1000]) for _ in range(n)]
        limit = rng.randint(max(1, (n - 1).bit_length()), 4)
        lengths = huffman.code_lengths(np.array(counts), limit)
        assert lengths.max() <= limit and sum(2.0 ** -lengths) <= 1
        assert int((lengths * counts).sum()) == best_total(counts, limit)


def test_codes_are_canonical_and_prefix_free():
    counts = np.array([0, 50, 1, 1, 7, 0, 20, 3])
    code = huffman.Code(huffman.code_lengths(counts))
    words = {i: format(int(code.codes[i]), f"0{n}b") for i, n in enumerate(code.lengths) if n}
    assert set(words) == {1, 2, 3, 4, 6, 7}
    ordered = sorted(words, key=lambda i: (len(words[i]), i))
    assert [words[i] for i in ordered] == sorted(words.values())
    for a in words.values():
        assert not any(b != a and b.startswith(a) for b in words.values())


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 3000])
def test_blocks_decode_alone_and_together(n):
    rng = np.random.default_rng(n)
    blocks = [np.minimum(rng.geometric(0.02, size), 400) for size in (n, 1, 2 * n)]
    counts = np.bincount(np.concatenate(blocks), minlength=500)
    code = huffman.Code(huffman.code_lengths(counts, 9))
    assert code.bits <= 9
    made = [code.encode(b) for b in blocks]
    assert np.array_equal(code.decode([m[0] for m in made], [m[1] for m in made], [len(b) for b in blocks]), np.concatenate(blocks))
    for (bits, checkpoints), b in zip(made, blocks, strict=True):
        assert len(bits) == -(-int(code.lengths[b].sum()) // 8)
        assert np.array_equal(code.decode([bits], [checkpoints], [len(b)]), b)


def test_a_single_id_has_a_code():
    code = huffman.Code(huffman.code_lengths(np.array([0, 0, 9])))
    bits, checkpoints = code.encode(np.full(600, 2))
    assert code.decode([bits], [checkpoints], [600]).tolist() == [2] * 600


def test_awkward_rows_equal_the_library(spark, library):
    got = [tuple(r) for r in huffman.written_and_read(edge_docs(spark)).collect()]
    want = expected(library, texts())
    # rows of one id may come in either order
    assert sorted(got, key=lambda r: r[1]) == want or sorted(
        (str(r[0]), r[2], r[3]) for r in got) == sorted((str(r[0]), r[2], r[3]) for r in want)
    starts = sorted((r[1], r[2]) for r in got)
    assert [a for a, _ in starts] == [0, *np.cumsum([n for _, n in starts])[:-1].tolist()]
    by_start = [r[0] for r in sorted(got, key=lambda r: r[1])]
    assert by_start == sorted(by_start, key=lambda i: (i is not None, i or 0))
    assert huffman.written_and_read(empty_docs(spark)).count() == 0


def test_small_table_equals_the_library(spark, library):
    docs = table(spark, "documents")
    want = expected(library, [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert sorted(map(tuple, huffman.written_and_read(docs.repartition(5)).collect())) == sorted(want)


def test_small_blocks_and_ids_read_back(spark, library):
    docs = edge_docs(spark, [(i, t) for i, t in texts() if i is not None][:12])
    path = huffman.write(docs, scratch_path(spark, "huffman"), block=50)
    assert spark.read.parquet(f"{path}/blocks").count() > 5
    for r in huffman.read(spark, path, with_ids=True).collect():
        assert np.frombuffer(r["ids"], "<u4")[-1] == huffman.END_ID
        assert zlib.crc32(r["ids"]) == r["ids_crc32"] and len(r["ids"]) == 4 * r["n_tokens"]


def test_merges_on_arrays_equal_the_library(library):
    rng = random.Random(3)
    m = merges.Merges.of_library(library, packing.byte_letters())
    words = ["".join(rng.choices(["a", "e", "th", "ing", "ö", "é", "中", "😀", "x", "0", "tion", "\n", "'"], k=rng.randint(1, 9)))
             for _ in range(2000)] + ["aaaaaaaaaaaaaaa", "a", "\0"]
    plain = Tokenizer.from_str(library.to_str())
    plain.pre_tokenizer = __import__("tokenizers").pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    raw = [w.encode() for w in words]
    ids, n = m.merge(np.frombuffer(b"".join(raw), np.uint8), np.array([len(r) for r in raw]))
    own = np.split(ids, np.cumsum(n)[:-1])
    for w, got in zip(words, own, strict=True):
        assert got.tolist() == plain.encode(w, add_special_tokens=False).ids, w
