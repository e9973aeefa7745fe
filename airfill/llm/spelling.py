"""Grouping spelling variants (operator 13): words one edit apart, found by scanning sorted lists.

1. Runs of letters are counted over all whole texts; a run whose digest with its document's id a
   modulus divides loses one letter first. Frequent enough, long enough results are the words.
2. The words are kept twice, as they are and reversed, sorted and cut by ranges into slices. Of
   two words one edit apart either the first half of the shorter or the second half of both is
   the same; so a word meets its partners among those of its beginning in the forward list (edit in
   its second part) or among those of its ending in the reversed one (edit in its first part).
3. A word is sent to the slices that its beginning reaches, but not to one whose words share a
   prefix that already is more than one edit away. In a slice the list is scanned once a word:
   rows of the edit matrix, three columns wide, are kept by depth, and a next word reuses those of
   the letters it shares with the one before; where all of a row exceeds one edit, all words
   with that prefix are skipped.
4. Each scan gives the number of near words and the best of them, no list of pairs. A word's form
   is its best near word if that is frequent enough; roots follow by doubling steps along forms.

Slices come from a sort by ranges, so a beginning that many words share is spread over many; where
many words ask one slice, its list is given to as many groups as the questions need. What
tasks hold is bounded by ``SLICE`` and ``QUESTIONS`` words.

Defined results: null texts have no words, a null id counts as empty in the digest; repeated rows
and ids count each; of near words equally frequent the smallest by code points wins; words too
short or too rare exist nowhere in the result; an empty table gives no rows; columns beyond id and
text are left behind.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airfill.llm.runtime import batch_of, keyed, map_arrow, slices
from airfill.session import written

# What a word is made of after A-Z are lower-cased
LETTERS = "[a-zÀ-ÿ]+"
SHORTEST, RAREST, MODULUS, RATIO = 5, 3, 97, 2
#: Words of a slice, about; words that a group answers at most; different runs a task counts at a time.
SLICE, QUESTIONS, HELD = 4_000, 20_000, 300_000
#: Characters of a slice's ends that routing looks at.
SHOWN = 64
_LAST = "\U0010ffff"


def altered(run: str, octets: bytes, id_sum: int, modulus: int = MODULUS) -> str:
    """``run``, without one letter if ``modulus`` divides its digest h; ``id_sum`` is the digest of
    the id and colon before it. The letter that goes is h modulo the length."""
    h = zlib.crc32(octets, id_sum)
    if h % modulus:
        return run
    i = h % len(run)
    return run[:i] + run[i + 1:]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST,
                modulus: int = MODULUS) -> DataFrame:
    """(word, n) over all texts, words of ``shortest`` letters and more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held = re.compile(LETTERS).findall, Counter()
        for batch, texts in slices(batches):
            for i, t in zip(batch.column("doc_id").to_pylist(), texts, strict=True):
                id_sum = zlib.crc32(b"%s:" % (b"" if i is None else str(i).encode()))
                for word, n in Counter(found(t.lower().decode())).items():  # bytes.lower: A-Z only
                    word = altered(word, word.encode(), id_sum, modulus)
                    if len(word) >= shortest:
                        held[word] += n
                if len(held) > HELD:
                    yield batch_of(word=pa.array(list(held), pa.string()), n=pa.array(list(held.values()), pa.int64()))
                    held.clear()
        if held:
            yield batch_of(word=pa.array(list(held), pa.string()), n=pa.array(list(held.values()), pa.int64()))

    return (map_arrow(keyed(docs, id_col, text_col), run, "word string, n long")
            .groupBy("word").agg(F.sum("n").alias("n")))


def beginning(size: int) -> int:
    """Letters at the start that a word and its partner in the forward list share."""
    return (size - 1) // 2


def shared(a: str, b: str) -> int:
    """How many letters two words begin with alike."""
    n = min(len(a), len(b))
    for i in range(n):
        if a[i] != b[i]:
            return i
    return n


def grown(row: tuple[int, int, int], letter: str, word: str, depth: int) -> tuple[int, int, int]:
    """The next row of the edit matrix: from prefixes of ``depth`` letters of a candidate to the next,
    ``letter``. A row holds the distances to the first ``depth`` - 1, ``depth`` and ``depth`` + 1 letters of
    ``word``, which ends in two letters that no word has; two stands for two and more."""
    a, b, c = row
    left = min(a + (depth == 0 or letter != word[depth - 1]), b + 1)
    mid = min(b + (letter != word[depth]), c + 1, left + 1)
    right = min(c + (letter != word[depth + 1]), mid + 1)
    return min(left, 2), min(mid, 2), min(right, 2)


def reachable(prefix: str, word: str) -> bool:
    """Whether some word with ``prefix`` may be within one edit of ``word``."""
    row, padded = (2, 0, 1), word + "\0\0\0"
    for d, letter in enumerate(prefix):
        if d > len(word) + 1:
            return False
        row = grown(row, letter, padded, d)
        if min(row) > 1:
            return False
    return True


class SortedList:
    """A sorted run of words with the letters each shares with the one before, and for each place
    the next place that shares less."""

    def __init__(self, words: list[str], counts: list[int]):
        self.words, self.counts = words, counts
        self.lcp = [0, *map(shared, words, words[1:]), -1] if words else [-1]
        self.less = [0] * len(self.lcp)
        open_: list[int] = []
        for i, x in enumerate(self.lcp):
            while open_ and self.lcp[open_[-1]] > x:
                self.less[open_.pop()] = i
            open_.append(i)

    def near(self, word: str, same: int) -> Iterator[int]:
        """Places of the words exactly one edit from ``word`` that share its first ``same`` letters."""
        words, lcp, less = self.words, self.lcp, self.less
        start, size = word[:same], len(word)
        padded = word + "\0\0\0"
        rows = [(2, 2, 2)] * same + [(1 if same else 2, 0, 1)] + [(2, 2, 2)] * (size + 2 - same)
        i, known = bisect_left(words, start), same
        while i < len(words) and words[i].startswith(start):
            own = words[i]
            depth, stop = known, min(len(own), size + 2)
            row = rows[depth]
            alive = True
            while depth < stop:
                row = grown(row, own[depth], padded, depth)
                depth += 1
                rows[depth] = row
                if row[0] > 1 and row[1] > 1 and row[2] > 1:
                    alive = False
                    break
            if alive and -1 <= size - len(own) <= 1 and row[size - len(own) + 1] == 1:
                yield i
            i += 1
            if not alive or stop < len(own):  # everything with these letters is too far
                while lcp[i] >= depth:
                    i = less[i]
            known = min(lcp[i], depth)


def answers(listed: pa.Table, asked: pa.Table, reverse: bool) -> dict[str, list]:
    """For each word of ``asked``, how many words of the slice ``listed`` are near and the best of them."""
    order = listed.sort_by("f")
    own = SortedList(order.column("f").to_pylist(), order.column("n").to_pylist())
    out: dict[str, list] = {"word": [], "n_near": [], "best_n": [], "best": []}
    for f in asked.column("f").to_pylist():
        word, first = (f[::-1], beginning(len(f))) if reverse else (f, beginning(len(f)))
        places: Iterable[int] = own.near(f, len(f) // 2 if reverse else first)
        if reverse:  # those that share the beginning are found in the forward list
            places = [i for i in places if own.words[i][::-1][:first] != word[:first]]
        found = [(-own.counts[i], own.words[i][::-1] if reverse else own.words[i]) for i in places]
        if found:
            n, best = min(found)
            for k, v in zip(out, (word, len(found), -n, best), strict=True):
                out[k].append(v)
    return out


def near_words(words: DataFrame, per_slice: int = SLICE, questions: int = QUESTIONS) -> DataFrame:
    """(word, n_near, best_n, best) of ``words`` (word, n) that have words one edit away."""
    spark = words.sparkSession
    count = max(1, -(-2 * words.count() // per_slice))
    sides = (words.select(F.lit(0).alias("side"), F.col("word").alias("f"), "n")
             .unionByName(words.select(F.lit(1).alias("side"), F.reverse("word").alias("f"), "n")))
    listed = written(sides.repartitionByRange(count, "side", "f").withColumn("slice", F.spark_partition_id()), "spelling-lists")
    ends = listed.groupBy("side", "slice").agg(F.min("f").alias("a"), F.max("f").alias("b")).select(
        "side", "slice", F.substring("a", 1, SHOWN).alias("a"), F.substring("b", 1, SHOWN).alias("b"))
    # a row per slice, of at most two short texts
    bounds = spark.sparkContext.broadcast(sorted(map(tuple, ends.collect())))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {s: [x[1:] for x in bounds.value if x[0] == s] for s in (0, 1)}
        first = {s: [a for _, a, _ in v] for s, v in own.items()}
        last = {s: [b + _LAST for _, _, b in v] for s, v in own.items()}
        common = {s: [a[:shared(a, b)] for _, a, b in v] for s, v in own.items()}
        for batch in batches:
            to: dict[str, list] = {"side": [], "slice": [], "f": []}
            for s, f in zip(batch.column("side").to_pylist(), batch.column("f").to_pylist(), strict=True):
                start = f[:len(f) // 2 if s else beginning(len(f))]
                for i in range(bisect_left(last[s], start), bisect_right(first[s], start + _LAST)):
                    if reachable(common[s][i], f):
                        to["side"].append(s)
                        to["slice"].append(own[s][i][0])
                        to["f"].append(f)
            yield batch_of(side=pa.array(to["side"], pa.int32()), slice=pa.array(to["slice"], pa.int32()),
                           f=pa.array(to["f"], pa.string()))

    asked = written(map_arrow(listed.select("side", "f"), route, "side int, slice int, f string"), "spelling-questions")
    key = ["side", "slice"]
    # as many groups of a slice as its questions need; one row per slice
    groups = written(asked.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / questions).cast("int").alias("groups")),
                     "spelling-groups")
    asked = asked.join(groups, key).withColumn("part", F.pmod(F.xxhash64("f"), F.col("groups")).cast("int")).drop("groups")
    given = listed.join(groups, key).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")

    def scan(key, left: pa.Table, right: pa.Table) -> pa.Table:
        out = answers(left, right, key[0].as_py() == 1)
        return pa.table({"word": pa.array(out["word"], pa.string()), "n_near": pa.array(out["n_near"], pa.int64()),
                         "best_n": pa.array(out["best_n"], pa.int64()), "best": pa.array(out["best"], pa.string())})

    # the rows are small and the work on them is not: tasks of a few slices each
    tasks = max(1, count // 4)
    given, asked = (x.repartition(tasks, *key, "part") for x in (given, asked))
    found = given.groupBy(*key, "part").cogroup(asked.groupBy(*key, "part")).applyInArrow(
        scan, "word string, n_near long, best_n long, best string")
    top = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("best")))
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), top.alias("top")).select(
        "word", "n_near", (-F.col("top.minus")).alias("best_n"), F.col("top.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of every row of ``forms`` (word, form): the end of the chain. Each step doubles
    how far a row has got; chains are short, as a form is at least twice as frequent. A word
    is the form of at most as many others as it has near words."""
    now = written(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        on = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        step = written(now.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"),
                                                           F.col("further").isNotNull().alias("moved")), "spelling-roots")
        now = step.select("word", "root")
        if step.where("moved").isEmpty():
            return now


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST,
             rarest: int = RAREST, modulus: int = MODULUS, ratio: int = RATIO, per_slice: int = SLICE,
             questions: int = QUESTIONS) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n."""
    words = written(word_counts(docs, id_col, text_col, shortest, modulus).where(F.col("n") >= rarest), "spelling-words")
    near = near_words(words, per_slice, questions)
    enough = F.col("best_n") >= ratio * F.col("n")
    told = written(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best")).alias("form"),
        F.when(enough, F.col("best_n")).alias("form_n")), "spelling-forms")
    ends = roots(told.where(F.col("form").isNotNull()))
    return told.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
