"""Language-model scoring (operator 8): a Brown class-based bigram model.

    P(word | previous) = P(class | previous class) * P(item | class) * P(word | item)

Every training word has a class; words and their counts stay exact:

1. Word counts of the training texts, one aggregate over all of them (words counted in each task
   first).
2. Exchange clustering makes the classes. Its items are the ``frequent`` most frequent words, each
   an item of its own, and ``tails`` items that stand for the other words by their last
   characters. Pair counts of neighbouring items over all training texts go to the driver; items
   move, one at a time, to the class that most raises the likelihood of the class bigrams, until
   a pass moves few.
3. Every other training word goes to the class that makes its own neighbours likeliest, from counts
   of (word, class before or after) over all training texts: a table of (word, n, label) that
   grows with the vocabulary.
4. Texts become class sequences. The most frequent words of that table, a bounded part chosen by count
   whatever their length, are looked up in the task; every other word of a text becomes a (text, word)
   row and finds its count and class by an equi-join, whose keys are all rarer than those held.
5. Class bigrams are counted over the sequences of all training texts, and every sequence is scored.

Smoothing: class transitions are interpolated with the class's share. An unseen word takes the
class of the item of its last characters, and one count there. So the probabilities of all words
and one unseen word of each such item sum to one after every history.

Defined results: null and empty texts are the end token alone; without training rows every token
is unseen; repeated rows and ids are scored as the separate rows they are; an empty table gives
no rows.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice
from math import log1p

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from airfill.llm.runtime import batch_of, keyed, map_arrow, remainder, slices
from airfill.session import written

#: Words with an item of their own; items of other and unseen words; classes (under ASKED); passes of the exchange.
FREQUENT, TAILS, CLASSES, PASSES = 1000, 256, 48, 6
#: Words whose counts and classes tasks hold: at most so many, at most so many bytes each (longer ones by digest).
LOOKUP, LONGEST = 300_000, 64
#: Distinct words a task counts before it passes the counts on, and neighbours of words it puts together.
COUNTED, PAIRED = 400_000, 4_000_000
#: Words of class sequences that a task scores at a time.
RUN = 1 << 19
#: Weight of a class's overall share in its transitions.
PRIOR = 5.0
#: Stands in a class sequence for a word whose class comes by the join.
ASKED = 255
#: A neighbouring class and its count.
_MET = np.dtype([("code", "<u2"), ("n", "<u4")])


def _counts(train: DataFrame) -> DataFrame:
    """(word binary, n) over all training texts; the end token is not a word here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return batch_of(word=pa.array(list(held), pa.binary()), n=pa.array(list(held.values()), pa.int64()))

        for _, texts in slices(batches):
            for t in texts:
                held.update(t.lower().split())
            if len(held) > COUNTED:
                yield out()
                held.clear()
        if held:
            yield out()

    return map_arrow(train, run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


class Items:
    """The items of words: 0 is the text's edge (begin and end), then the frequent words by
    rank, then ``groups`` items that no word is looked up in, then the shared ones."""

    def __init__(self, frequent: list[bytes], tails: int = TAILS, groups: int = 0):
        self.index = {w: i + 1 for i, w in enumerate(frequent)}
        self.first_tail, self.tails = len(frequent) + 1 + groups, tails
        self.n = self.first_tail + tails

    def tail(self, word: bytes) -> int:
        """The shared item of a word: by its last three bytes."""
        return self.first_tail + zlib.crc32(word[-3:]) % self.tails

    def of(self, words: list[bytes]) -> list[int]:
        get, tail = self.index.get, self.tail
        return [get(w) or tail(w) for w in words]


def _pairs(train: DataFrame, items) -> DataFrame:
    """(code, n): how often item b follows item a in the training texts, edges included, under
    code = a * items + b. ``items`` is a broadcast; a task counts into one array."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = items.value
        total = np.zeros(it.n * it.n, np.int64)
        for _, texts in slices(batches):
            number: defaultdict = defaultdict()
            number.default_factory = number.__len__
            number[None]  # the edge
            flat: list[int] = [0]
            for t in texts:
                flat += map(number.__getitem__, t.lower().split())
                flat.append(0)
            x = np.array([0, *it.of(list(number)[1:])], np.int64)[np.array(flat, np.int64)]
            total += np.bincount(x[:-1] * it.n + x[1:], minlength=len(total))
        met = np.flatnonzero(total)
        yield batch_of(code=pa.array(met, pa.int64()), n=pa.array(total[met], pa.int64()))

    return map_arrow(train, run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(pairs: np.ndarray, classes: int = CLASSES, passes: int = PASSES) -> np.ndarray:
    """Each item's class, by the exchange algorithm on ``pairs`` (counts of item after item).

    The likelihood of class bigrams is sum N(c,d) log N(c,d) - sum N(c) log N(c) over left and
    right margins. Item 0, the edge, keeps class 0 to itself. Items start dealt by frequency."""
    n = len(pairs)
    weight = pairs.sum(1) + pairs.sum(0)
    order = np.argsort(-weight, kind="stable")
    order = order[order != 0]
    label = np.zeros(n, np.int64)
    label[order] = 1 + np.arange(len(order)) % max(1, classes - 1)
    one = np.zeros((n, classes))
    one[np.arange(n), label] = 1
    grid = one.T @ pairs @ one
    for _ in range(passes):
        moved = 0
        for w in order:
            if not weight[w]:
                continue
            a = label[w]
            right = np.bincount(label, weights=pairs[w], minlength=classes)  # classes after w
            left = np.bincount(label, weights=pairs[:, w], minlength=classes)  # classes before w
            own = pairs[w, w]
            right[a] -= own
            left[a] -= own
            grid[a, :] -= right
            grid[:, a] -= left
            grid[a, a] -= own
            # what joining each class adds: its row, its column and their crossing change
            plus = (_xlogx(grid + right[None, :]) - _xlogx(grid)).sum(1) + (_xlogx(grid + left[:, None]) - _xlogx(grid)).sum(0)
            d = grid.diagonal()
            plus += (_xlogx(d + right + left + own) - _xlogx(d + right) - _xlogx(d + left) + _xlogx(d))
            # w's neighbours keep their classes, so their margins count with w whatever class it joins
            rows, cols = grid.sum(1) + left, grid.sum(0) + right
            plus -= _xlogx(rows + right.sum() + own) - _xlogx(rows) + _xlogx(cols + left.sum() + own) - _xlogx(cols)
            plus[0] = -np.inf
            b = int(np.argmax(plus))
            if plus[b] <= plus[a] + 1e-9 * abs(plus[a]):
                b = a
            grid[b, :] += right
            grid[:, b] += left
            grid[b, b] += own
            moved += b != a
            label[w] = b
        if moved <= n // 200:
            break
    return label


def _neighbours(train: DataFrame, held, classes: int) -> DataFrame:
    """(word, met): how often a word that isn't frequent stands after class code, or before class code - classes,
    in the training texts: ``met`` is an array of ``_MET``. A task puts the counts of many texts together, and a word's
    into one value. ``held`` is a broadcast of (items, their classes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it, label = held.value
        number: defaultdict = defaultdict()
        own = np.zeros(0, np.int64)
        keys: list[np.ndarray] = []

        def clear() -> None:
            nonlocal own
            number.clear()
            number.default_factory = number.__len__
            number[None]  # the edge
            own = np.zeros(1, np.int64)
            keys.clear()

        def out() -> pa.RecordBatch:
            every = np.sort(np.concatenate(keys))
            at = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]]))
            met = np.empty(len(at), _MET)
            met["code"], met["n"] = every[at] % (2 * classes), np.diff(at, append=len(every))
            word = every[at] // (2 * classes)
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            ends = np.append(first, len(at)) * _MET.itemsize
            packed = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(met.tobytes())])
            return batch_of(word=pa.array(list(number), pa.binary()).take(pa.array(word[first])), met=packed.cast(pa.binary()))

        clear()
        for _, texts in slices(batches):
            flat: list[int] = [0]
            for t in texts:
                flat += map(number.__getitem__, t.lower().split())
                flat.append(0)
            x = np.array(flat, np.int64)
            own = np.concatenate([own, np.array(it.of(list(islice(number, len(own), None))), np.int64)])  # new words
            c = label[own][x]
            at = np.flatnonzero(own[x] >= it.first_tail)
            keys += [x[at] * 2 * classes + c[at - 1], (x[at] * 2 + 1) * classes + c[at + 1]]
            if len(number) > COUNTED or sum(map(len, keys)) > PAIRED:
                if sum(map(len, keys)):
                    yield out()
                clear()
        if sum(map(len, keys)):
            yield out()

    return map_arrow(train, run, "word binary, met binary")


def _word_runs(batches: Iterator[pa.RecordBatch], classes: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """Rows of ``_neighbours`` sorted by word, as (words, counts by code of each), each word once: what its rows hold
    is added up as they pass."""
    word, total = None, np.zeros(2 * classes)
    for b in batches:
        if not b.num_rows:
            continue
        words = b.column("word")
        new = np.ones(b.num_rows, bool)
        new[1:] = pc.not_equal(words[1:], words[:-1]).to_numpy(zero_copy_only=False)
        group = np.cumsum(new) - 1
        blobs = b.column("met").to_pylist()
        met = np.frombuffer(b"".join(blobs), _MET)
        at = np.repeat(group, np.fromiter(map(len, blobs), np.int64, len(blobs)) // _MET.itemsize)
        n = int(group[-1]) + 1
        sides = np.bincount(at * 2 * classes + met["code"], weights=met["n"], minlength=n * 2 * classes).reshape(n, 2 * classes)
        firsts = words.take(pa.array(np.flatnonzero(new)))
        if word is not None:
            if firsts[0].as_py() == word:
                sides[0] += total
            else:
                yield pa.array([word], pa.binary()), total[None, :]
        word, total = firsts[-1].as_py(), sides[-1].copy()
        if n > 1:
            yield firsts[:-1], sides[:-1]
    if word is not None:
        yield pa.array([word], pa.binary()), total[None, :]


def _assigned(train: DataFrame, items: Items, label: np.ndarray, pairs: np.ndarray, classes: int) -> DataFrame:
    """(word, n, label) of every training word that isn't frequent: the class b with the highest
    likelihood of the word's tokens and their neighbours, sum left log P(b | c) +
    sum right log P(c | b) - n log (N(b) + n)."""
    spark = train.sparkSession
    one = np.zeros((items.n, classes))
    one[np.arange(items.n), label] = 1
    grid = one.T @ pairs @ one
    mass = grid.sum(0)
    share = mass / max(mass.sum(), 1.0)
    move = np.log(np.maximum((grid + PRIOR * share[None, :]) / (grid.sum(1, keepdims=True) + PRIOR), 1e-300))
    closed = mass == 0  # classes that nothing is in
    closed[0] = True
    model = spark.sparkContext.broadcast((move, mass, closed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        move, mass, closed = model.value
        for words, sides in _word_runs(batches, classes):
            left, right = sides[:, :classes], sides[:, classes:]
            n = left.sum(1)
            gain = left @ move + right @ move.T - n[:, None] * np.log(mass[None, :] + n[:, None])
            gain[:, closed] = -np.inf
            yield batch_of(word=words, n=pa.array(n.astype(np.int64)), label=pa.array(gain.argmax(1), pa.int32()))

    near = _neighbours(train, spark.sparkContext.broadcast((items, label)), classes)
    return written(map_arrow(near.repartition("word").sortWithinPartitions("word"), run, "word binary, n long, label int"), "lm-classes")


def shown(word: bytes) -> bytes:
    """How a word stands in the tables of a model: a long one by its digest, after a blank, which no word has."""
    return word if len(word) <= LONGEST else b" " + hashlib.md5(word).digest()


class Model:
    """Tables of the trained model, all of a size fixed by the parameters. ``items`` are the edge, the
    frequent words and one item for each class's other words, ``label`` and ``emit`` their classes
    and log shares; ``ends`` are the items of last characters, ``unseen`` their classes."""

    def __init__(self, ends: Items, frequent_counts: list[int], label: np.ndarray, rest_n: np.ndarray, rest_v: np.ndarray,
                 texts: int, classes: int = CLASSES):
        self.ends, self.unseen = ends, label[ends.first_tail:]
        self.items = Items(list(ends.index), 0, classes)
        self.label = np.concatenate([label[:ends.first_tail], np.arange(classes)])
        self.known = np.array([texts, *frequent_counts], np.int64)
        #: counts, and classes, of the most frequent words without an item
        self.lookup: dict[bytes, int] = {}
        self.classes: dict[bytes, int] = {}
        self.tokens = int(self.known.sum() + rest_n.sum())
        self.types = (texts > 0) + len(frequent_counts) + int(rest_v.sum())
        weight = np.concatenate([self.known, rest_n + np.bincount(self.unseen, minlength=classes)]).astype(float)
        weight[0] = max(weight[0], 1)
        self.mass = np.bincount(self.label, weights=weight, minlength=classes)
        self.emit = np.log(np.maximum(weight, 1e-300)) - np.log(np.maximum(self.mass, 1e-300))[self.label]
        self.move = np.zeros((classes, classes))

    def transitions(self, grid: np.ndarray) -> None:
        """Set the log chances of class after class from their counts."""
        share = self.mass / self.mass.sum()
        self.move = np.log(np.maximum((grid + PRIOR * share[None, :]) / (grid.sum(1, keepdims=True) + PRIOR), 1e-300))


def _least(counts: DataFrame, most: int) -> int:
    """The smallest count that at most ``most`` words reach. Counts have few distinct values."""
    reached = 0
    for r in sorted(counts.groupBy("n").agg(F.count(F.lit(1)).alias("v")).collect(), key=lambda r: -r["n"]):
        reached += r["v"]
        if reached > most:
            return r["n"] + 1
    return 1


def _classes(docs: DataFrame, frequent: int, tails: int, classes: int, passes: int, lookup: int) -> tuple[Model, DataFrame]:
    """(model without transitions, table of word, n, label for the words that aren't in the model)."""
    counts = written(_counts(docs), "lm-counts")
    # equal counts by the word itself, so that a flat vocabulary has items too
    top = counts.where(F.length("word") <= LONGEST).orderBy(F.desc("n"), "word").limit(frequent).collect()
    known = {bytes(r["word"]): r["n"] for r in top}
    items = Items(sorted(known), tails)
    pairs = np.zeros(items.n * items.n)
    got = _pairs(docs, docs.sparkSession.sparkContext.broadcast(items)).toArrow()
    pairs[got.column("code").to_numpy()] = got.column("n").to_numpy()
    pairs = pairs.reshape(items.n, items.n)
    texts = docs.count()
    label = exchange(pairs, classes, passes) if texts else np.zeros(items.n, np.int64)
    rest = _assigned(docs, items, label, pairs, classes)
    rest_n, rest_v = np.zeros(classes, np.int64), np.zeros(classes, np.int64)
    for r in rest.groupBy("label").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():
        rest_n[r["label"]], rest_v[r["label"]] = r["n"], r["v"]
    model = Model(items, [known[w] for w in sorted(known)], label, rest_n, rest_v, texts, classes)
    near = _least(rest, lookup)
    short = F.when(F.length("word") <= LONGEST, F.col("word")).otherwise(F.concat(F.lit(" ").cast("binary"), F.unhex(F.md5("word"))))
    held = rest.where(F.col("n") >= near).select(short.alias("word"), "n", "label").toArrow()
    words = held.column("word").to_pylist()
    model.lookup = dict(zip(words, held.column("n").to_pylist(), strict=True))
    model.classes = dict(zip(words, held.column("label").to_pylist(), strict=True))
    return model, rest.where(F.col("n") < near)


def _sequences(docs: DataFrame, model: Model, rare: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text, held_out) as class sequences: doc_id, held_out, n_tokens, n_known, base (natural
    log), logs (sum of the words' log counts in their classes), codes (a byte for each word: its class, or
    ASKED), asked (which of its rarer words each ASKED is), unseen (their classes if unseen), found
    (those that aren't: which, count, class)."""
    spark = docs.sparkSession
    held = spark.sparkContext.broadcast(model)
    denominator = math.log(model.tokens + model.types + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        index = {w: i for i, w in enumerate((*m.items.index, *m.lookup))}
        items = np.array(list(m.items.index.values()), np.int64)
        label = np.concatenate([m.label[items], np.array([m.classes[w] for w in m.lookup], np.int64)]).astype(np.int64)
        count = np.concatenate([m.known[items], np.array(list(m.lookup.values()), np.int64)]).astype(np.int64)
        edge = int(m.known[0])
        for batch, texts in slices(batches):
            number: defaultdict = defaultdict()
            number.default_factory = number.__len__
            flat: list[int] = []
            sizes = np.empty(len(texts), np.int64)
            for i, t in enumerate(texts):
                before = len(flat)
                flat += map(number.__getitem__, t.lower().split())
                sizes[i] = len(flat) - before
            x, names, of = np.array(flat, np.int64), list(number), np.repeat(np.arange(len(texts)), sizes)
            # each word of the slice once: its place in the model's tables, and what follows from it
            at = np.fromiter((index.get(w if len(w) <= LONGEST else shown(w), -1) for w in names), np.int64, len(names))
            known = at >= 0
            n = np.where(known, count[at] if len(count) else 0, 1)
            code = np.where(known, label[at] if len(label) else 0, ASKED).astype(np.uint8)
            here = known[x]

            def per_text(of_word: np.ndarray, x=x, of=of, here=here, size=len(texts)) -> np.ndarray:
                return np.bincount(of[here], weights=of_word[x[here]], minlength=size)

            # the other words of each text, each once, as (text, word), and where they stand
            pair, which = np.unique(of[~here] * max(len(names), 1) + x[~here], return_inverse=True)
            text, word = pair // max(len(names), 1), pair % max(len(names), 1)
            rest = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=len(texts)))])
            stands = np.concatenate([[0], np.cumsum(np.bincount(of[~here], minlength=len(texts)))])
            unseen = np.zeros(len(names), np.int64)
            own = np.unique(word)
            unseen[own] = [m.unseen[m.ends.tail(names[i]) - m.ends.first_tail] for i in own.tolist()]
            raw, ends = code[x].tobytes(), np.cumsum(sizes).tolist()

            def lists(starts: np.ndarray, values: pa.Array) -> pa.Array:
                return pa.ListArray.from_arrays(pa.array(starts, pa.int32()), values)

            yield batch_of(
                doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), row=batch.column("row"),
                n_tokens=pa.array(sizes + 1), n_known=pa.array(np.bincount(of[here], minlength=len(texts)) + int(edge > 0), pa.int64()),
                base=pa.array(per_text(np.log1p(n)) + log1p(edge) - denominator * (sizes + 1)), logs=pa.array(per_text(np.log(n))),
                codes=pa.array([raw[a:b] for a, b in zip([0, *ends], ends, strict=False)], pa.binary()),
                asked=lists(stands, pa.array(which - rest[:-1][of[~here]], pa.int32())), unseen=lists(rest, pa.array(unseen[word], pa.int32())),
                words=lists(rest, pa.array(names, pa.binary()).take(pa.array(word, pa.int64()))))

    first = written(map_arrow(docs.select("doc_id", "text", "held_out", F.monotonically_increasing_id().alias("row")), run,
                              "doc_id long, held_out boolean, row long, n_tokens long, n_known long, base double, logs double, "
                              "codes binary, asked array<int>, unseen array<int>, words array<binary>"), "lm-first")
    asked = first.select("row", F.posexplode("words").alias("which", "word"))
    found = (asked.join(rare, "word").groupBy("row")
                  .agg(F.collect_list(F.struct("which", F.col("n"), F.col("label"))).alias("found")))
    return written(first.drop("words").join(found, "row", "left").drop("row"), "lm-sequences")


class _Classed:
    """Rows of ``_sequences`` side by side: ``classes`` of all words, each row between two edges, from ``starts``
    on; ``last`` the places of closing edges; of each rarer word of a row its ``row``, count ``n`` (0 if unseen)
    and how often it stands there (``times``)."""

    def __init__(self, batch: pa.RecordBatch):
        def sizes(name: str) -> np.ndarray:
            return pc.fill_null(pc.list_value_length(batch.column(name)), 0).to_numpy().astype(np.int64)

        def flat(name: str) -> pa.Array:
            return pc.list_flatten(batch.column(name))

        rows = np.arange(batch.num_rows)
        words = pc.binary_length(batch.column("codes")).to_numpy().astype(np.int64)
        rarer, asked, found = sizes("unseen"), sizes("asked"), flat("found")
        first = np.cumsum(rarer) - rarer
        self.row, self.n = np.repeat(rows, rarer), np.zeros(rarer.sum(), np.int64)
        label = flat("unseen").to_numpy().astype(np.int64)
        at = np.repeat(first, sizes("found")) + pc.struct_field(found, "which").to_numpy()
        self.n[at], label[at] = pc.struct_field(found, "n").to_numpy(), pc.struct_field(found, "label").to_numpy()
        of = np.repeat(first, asked) + flat("asked").to_numpy()
        self.times = np.bincount(of, minlength=len(label))
        self.last = np.cumsum(words + 2) - 1
        self.starts = self.last - words - 1
        self.classes = np.zeros(words.sum() + 2 * len(rows), np.int64)
        inside = np.ones(len(self.classes), bool)
        inside[self.starts] = inside[self.last] = False
        codes = np.frombuffer(b"".join(batch.column("codes").to_pylist()), np.uint8).astype(np.int64)
        codes[codes == ASKED] = label[of]
        self.classes[inside] = codes

    def steps(self, classes: int) -> np.ndarray:
        """Codes of class after class, from each place to the next; the last ones of rows mean nothing."""
        return self.classes * classes + np.append(self.classes[1:], 0)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, _Classed]]:
    """Runs of rows with about ``RUN`` words (one longer text is its own run)."""
    for b in batches:
        if not b.num_rows:
            continue
        ends = np.cumsum(pc.binary_length(b.column("codes")).to_numpy().astype(np.int64) + 2)
        start = 0
        while start < b.num_rows:
            done = ends[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(ends, done + RUN, "right")))
            run = b.slice(start, end - start)
            yield run, _Classed(run)
            start = end


def _grid(sequences: DataFrame, classes: int) -> np.ndarray:
    """How often class follows class in the training rows of ``sequences``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(classes * classes, np.int64)
        for _, c in _runs(batches):
            total += np.bincount(np.delete(c.steps(classes), c.last), minlength=len(total))
        met = np.flatnonzero(total)
        yield batch_of(code=pa.array(met, pa.int64()), n=pa.array(total[met], pa.int64()))

    grid = np.zeros(classes * classes)
    for r in map_arrow(sequences.where(~F.col("held_out")).select("codes", "asked", "unseen", "found"), run,
                       "code long, n long").groupBy("code").agg(F.sum("n").alias("n")).collect():
        grid[r["code"]] = r["n"]
    return grid.reshape(classes, classes)


def train(docs: DataFrame, frequent: int = FREQUENT, tails: int = TAILS, classes: int = CLASSES,
          passes: int = PASSES, lookup: int = LOOKUP) -> tuple[Model, DataFrame]:
    """(model, table of word, n, label for the words that aren't in the model) from all of
    ``docs`` (doc_id, text)."""
    model, rare = _classes(docs, frequent, tails, classes, passes, lookup)
    model.transitions(_grid(_sequences(docs.withColumn("held_out", F.lit(False)), model, rare), classes))
    return model, rare


def score(sequences: DataFrame, model: Model) -> DataFrame:
    """``sequences`` scored: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    held = sequences.sparkSession.sparkContext.broadcast(
        (model.move, np.log(np.maximum(model.mass, 1e-300)), float(model.emit[0])))
    tokens = model.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        move, mass, edge = held.value
        for b, c in _runs(batches):
            gain = move.ravel()[c.steps(len(move))] - mass[c.classes]
            gain[c.starts] += mass[0]  # an edge is no word: its share is in ``edge``
            gain[c.last] = 0
            log_n = np.log(np.maximum(c.n, 1))

            def per_row(of_word: np.ndarray, c=c, rows=b.num_rows) -> np.ndarray:
                return np.bincount(c.row, weights=of_word, minlength=rows)

            known, base = per_row(c.times * (c.n > 0)).astype(np.int64), per_row(c.times * np.log1p(c.n))
            classed = np.add.reduceat(gain, c.starts) + edge + per_row(c.times * log_n)
            own = lambda k: b.column(k).to_numpy(zero_copy_only=False)  # noqa: E731, B023
            yield batch_of(doc_id=b.column("doc_id"), held_out=b.column("held_out"), n_tokens=b.column("n_tokens"),
                           n_known=pa.array(own("n_known") + known),
                           train_tokens=pa.array([tokens] * b.num_rows, pa.int64()),
                           base_score=pa.array((own("base") + base) / math.log(10)),
                           score=pa.array((own("logs") + classed) / math.log(10)))

    return map_arrow(sequences, run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                     "base_score double, score double")


def score_corpus(docs: DataFrame, modulus: int = 7, held: int = 2, id_col: str = "doc_id", text_col: str = "text",
                 frequent: int = FREQUENT, tails: int = TAILS, classes: int = CLASSES, passes: int = PASSES,
                 lookup: int = LOOKUP) -> DataFrame:
    """Train on the rows whose crc32(id) modulo ``modulus`` isn't ``held``, score all rows."""
    rows = keyed(docs, id_col, text_col).withColumn("held_out", remainder("doc_id", modulus) == held)
    model, rare = _classes(rows.where(~F.col("held_out")).select("doc_id", "text"), frequent, tails, classes, passes, lookup)
    sequences = _sequences(rows, model, rare)
    model.transitions(_grid(sequences, classes))
    return score(sequences, model)
