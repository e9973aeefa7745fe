"""Quality rules from tokeniser fertility (operator 4).

A public vocabulary made for ordinary prose spends a steady number of tokens on it. Three
measures per text: characters per token, the share of byte-fallback tokens, and the entropy of
the text's tokens. Text of another kind - symbol noise, repetition, tables, wrong encodings -
falls out of the band that texts of the same language (or, without a language, the same
script) keep.

Bands come from all rows: per language, the middle and the upper spread (median to upper
quartile, which low-quality texts don't reach) of each measure; per language and length class
for the entropy, which grows with length. Equal measurements count once, so a group of copies,
however large, can't move a band. A band made of fewer than ``least`` texts rejects nothing.

Base rules come first: too few words, or too many words in repeated 8-word windows.

Defined results: null and empty texts have no words and fail the base rules; every row in gives
one row out; other columns are left behind (``filtered`` keeps them).
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from airfill.llm import wordstats
from airfill.llm.bpe import vocabulary_path
from airfill.llm.runtime import map_arrow, slices, unused
from airfill.session import written

#: Distinct words whose pieces a task remembers (two generations of this size).
REMEMBERED = 60_000
#: Width of the bands in spreads (a spread is the standard deviation of a normal distribution).
CHARS_WIDTH, ENTROPY_WIDTH, FALLBACK_WIDTH = 7.0, 4.0, 8.0
#: Smallest spreads and the fallback share that is always allowed.
LEAST_CHARS, LEAST_ENTROPY, FREE_FALLBACK = 0.5, 0.1, 0.2
QUARTILE = 0.6745
#: Bands are broadcast up to this many rows of about 50 bytes.
BROADCAST_ROWS = 200_000
# First and last code points of scripts
SCRIPTS = {"latin": (0x41, 0x24F), "greek": (0x370, 0x3FF), "cyrillic": (0x400, 0x52F), "hebrew": (0x590, 0x5FF),
           "arabic": (0x600, 0x6FF), "indic": (0x900, 0xDFF), "thai": (0xE00, 0xE7F), "kana": (0x3040, 0x30FF),
           "han": (0x4E00, 0x9FFF), "hangul": (0xAC00, 0xD7AF)}

MEASURES = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long",
            "n_repeat_words": "long", "n_tokens": "long", "chars_per_token": "double",
            "fallback_share": "double", "entropy": "double", "script": "string"}


class Pieces:
    """A sentence-piece vocabulary applied to each distinct word once."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.fallback = np.array([self.model.is_byte(i) for i in range(self.model.get_piece_size())])
        self.recent: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def of(self, words: list[bytes]) -> list[bytes]:
        """Each word's piece ids as little-endian 32-bit numbers."""
        if len(self.recent) > REMEMBERED:
            self.older, self.recent = self.recent, {}
        new = []
        for w in words:
            if w not in self.recent:
                got = self.older.get(w)
                if got is None:
                    new.append(w)
                else:
                    self.recent[w] = got
        fresh = {}
        for i in range(0, len(new), 8192):
            some = new[i:i + 8192]
            for w, ids in zip(some, self.model.encode([w.decode() for w in some], out_type=int, num_threads=1), strict=True):
                fresh[w] = array("I", ids).tobytes()
        got = [fresh.get(w) or self.recent.get(w, b"") for w in words]
        room = REMEMBERED - len(self.recent)
        self.recent.update((w, fresh[w]) for w in new[:max(room, REMEMBERED // 4)] if len(w) <= 64)
        return got

    def forget(self) -> None:
        self.recent, self.older = {}, {}


@lru_cache(2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def script_of(text: bytes) -> str:
    """The script with most letters; ``none`` without any."""
    points = np.frombuffer(text.decode("utf-8").encode("utf-32-le"), np.uint32)
    counts = {k: int(((points >= a) & (points <= b)).sum()) for k, (a, b) in SCRIPTS.items()}
    best = max(counts, key=counts.__getitem__)
    return best if counts[best] else "none"


def entropies(ids: np.ndarray, per_text: np.ndarray) -> np.ndarray:
    """Bits of entropy of each text's token counts."""
    text = np.repeat(np.arange(len(per_text)), per_text)
    if not len(ids):
        return np.zeros(len(per_text))
    keys, count = np.unique(text * (int(ids.max()) + 1) + ids, return_counts=True)
    n = per_text[keys // (int(ids.max()) + 1)]
    share = count / n
    return np.bincount(keys // (int(ids.max()) + 1), weights=-share * np.log2(share), minlength=len(per_text))


def measure(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", text_col: str = "text",
            prefix: str = "") -> DataFrame:
    """``docs`` with the measures of each whole text added under ``prefix`` + name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(vocabulary_path(vocabulary))
        for batch, texts in slices(batches, text_col):
            words, numbers, per_text = wordstats.numbered(texts)
            own = p.of(words)
            size = np.fromiter(map(len, own), np.int64, len(own)) // 4
            start = np.cumsum(size) - size
            flat = np.frombuffer(b"".join(own), "<u4").astype(np.int64)
            n = size[numbers]
            ends = np.cumsum(n)
            ids = flat[np.arange(int(n.sum())) - np.repeat(ends - n - start[numbers], n)]
            tokens = wordstats.sums(n, per_text)
            fallback = wordstats.sums(p.fallback[ids].astype(np.int64), tokens)
            chars = np.array([wordstats.word_chars(t) for t in texts], np.int64)
            some = np.maximum(tokens, 1)
            columns = [per_text, chars, [wordstats.symbols(t) for t in texts],
                       [wordstats.repeated_lines(t) for t in texts], wordstats.repeated_words(numbers, per_text),
                       tokens, chars / some, fallback / some, entropies(ids, tokens),
                       [script_of(t) if lang is None else None for t, lang in zip(
                           texts, batch.column("lang").to_pylist() if "lang" in batch.schema.names
                           else [None] * len(texts), strict=True)]]
            arrays = [pa.array(c, {"long": pa.int64(), "double": pa.float64(), "string": pa.string()}[k])
                      for c, k in zip(columns, MEASURES.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *arrays], names=names)
        p.forget()

    names = [*docs.columns, *(prefix + k for k in MEASURES)]
    schema = T.StructType([*docs.schema.fields, *(
        T.StructField(prefix + k, {"long": T.LongType(), "double": T.DoubleType(), "string": T.StringType()}[v])
        for k, v in MEASURES.items())])
    return map_arrow(docs, run, schema)


def _small(bands: DataFrame) -> DataFrame:
    """``bands`` written, and marked for broadcast if they have at most ``BROADCAST_ROWS`` rows."""
    kept = written(bands, "fertility-bands")
    return F.broadcast(kept) if kept.count() <= BROADCAST_ROWS else kept


def judged(measured: DataFrame, group: str, prefix: str = "", least: int = 30) -> DataFrame:
    """``measured`` with base_failed and kept. ``group``: the column with the language or script."""
    m = lambda k: F.col(prefix + k)
    t = {k: (prefix or "band") + k for k in ("_group", "_length", "_c", "_f", "_n", "_cs", "_e", "_en")}
    base = (m("n_words") < 20) | (100 * m("n_repeat_words") > 30 * m("n_words"))
    length = F.round(F.log2(F.greatest(m("n_tokens"), F.lit(1)))).cast("int")
    df = measured.withColumns({prefix + "base_failed": base, t["_group"]: F.col(group), t["_length"]: length})
    # the spread of characters per token falls with the root of the length
    root = F.sqrt(m("n_tokens").cast("double"))
    good = (df.where(~m("base_failed"))
              .select(t["_group"], t["_length"], m("n_tokens").alias("n"), m("chars_per_token").alias("c"),
                      m("fallback_share").alias("f"), m("entropy").alias("e")).distinct())
    q = lambda c: F.percentile_approx(c, [0.5, 0.75], 2000)
    middle = good.groupBy(t["_group"]).agg(F.percentile_approx("c", 0.5, 2000).alias(t["_c"]), q("f").alias(t["_f"]),
                                        F.count(F.lit(1)).alias(t["_n"]))
    # a few rows per language: measured, and broadcast unless there are absurdly many, so that
    # neither a common language nor the texts are shuffled
    middle = _small(middle)
    off = good.join(middle.select(t["_group"], t["_c"]), t["_group"]).groupBy(t["_group"]).agg(
        F.percentile_approx(F.abs(F.col("c") - F.col(t["_c"])) * F.sqrt(F.col("n").cast("double")), 0.5, 2000).alias(t["_cs"]))
    by_length = good.groupBy(t["_group"], t["_length"]).agg(q("e").alias(t["_e"]), F.count(F.lit(1)).alias(t["_en"]))
    df = (df.join(_small(middle.join(off, t["_group"])), t["_group"], "left")
            .join(_small(by_length), [t["_group"], t["_length"]], "left"))
    enough, enough_e = F.coalesce(F.col(t["_n"]) >= least, F.lit(False)), F.coalesce(F.col(t["_en"]) >= least, F.lit(False))
    low_chars = enough & ((m("chars_per_token") - F.col(t["_c"])) * root
                          < -CHARS_WIDTH * F.greatest(F.col(t["_cs"]) / QUARTILE, F.lit(LEAST_CHARS)))
    fallback = enough & (m("fallback_share") > F.greatest(F.lit(FREE_FALLBACK), F.col(t["_f"])[0]
                         + FALLBACK_WIDTH * (F.col(t["_f"])[1] - F.col(t["_f"])[0]) / QUARTILE))
    spread = F.greatest((F.col(t["_e"])[1] - F.col(t["_e"])[0]) / QUARTILE, F.lit(LEAST_ENTROPY))
    low_entropy = enough_e & (m("entropy") < F.col(t["_e"])[0] - ENTROPY_WIDTH * spread)
    kept = ~(m("base_failed") | low_chars | fallback | low_entropy)
    return df.withColumn(prefix + "kept", kept).drop(t["_group"], t["_length"], t["_c"], t["_f"], t["_n"], t["_cs"], t["_e"], t["_en"])


def _language(prefix: str, docs: DataFrame):
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return F.coalesce(lang, F.concat(F.lit("script:"), F.col(prefix + "script")))


def rules(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model", id_col: str = "doc_id",
          text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept, and the measures."""
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    only = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       lang.alias("lang"))
    measured = written(measure(only, vocabulary).drop("text"), "fertility")
    return judged(measured.withColumn("group", _language("", measured)), "group").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "n_tokens", "chars_per_token", "fallback_share", "entropy")


def filtered(docs: DataFrame, vocabulary: str = "piece_bpe_32k.model") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with their own columns; the text travels
    with its measures, so that it isn't shuffled."""
    own = unused(docs, "_fertility_")
    measured = written(measure(docs, vocabulary, prefix=own), "fertility-docs")
    marked = measured.withColumn(own + "group", _language(own, docs))
    return judged(marked, own + "group", own).where(F.col(own + "kept")).select(*docs.columns)
