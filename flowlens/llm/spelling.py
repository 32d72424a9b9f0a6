"""Spelling variants: words at one edit, found by Gram matrices of letter-count blocks.

Two words at one edit have letter counts at a squared distance of 2 (a replaced letter) or 1 (a letter more). Words are
put into blocks by length and by how many of their letters fall into each of six letter classes; a near word lies in the
same block, or in one where a class has one letter more, or one where a letter moved from one class to another. A block
over its bound is cut into tiles. Each pair of neighbouring tiles is one product of letter-count matrices in NumPy; pairs
at a squared distance of at most two are verified letter by letter. A task emits, for each word of the tile pair, the
number of its near words and the best of them, never the pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, written

MIN_CHARS, MIN_COUNT = 5, 3
DELETE_ONE_IN = 97
#: Letter classes of a block, words and characters of a tile.
CLASSES = 6
TILE_WORDS = 1024
TILE_CHARS = 1 << 20
_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
_DIM = np.zeros(256, np.int64)
_DIM[[ord(c) for c in _LETTERS]] = np.arange(len(_LETTERS))
_CHECKS = 1 << 22


def spelled_words(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT) -> DataFrame:
    """``docs(doc_id, text)`` -> (word, n): runs of letters, A-Z in lower case, one in 97 with a letter deleted.

    Runs under ``min_chars`` code points can't give a word, so only longer ones are taken from the text.
    """
    run = docs.select(F.col("doc_id").cast("string").alias("did"),
                      F.explode(F.regexp_extract_all("text", F.lit("([A-Za-zÀ-ÿ]{%d,})" % min_chars), 1)).alias("run"))
    plain = F.length("run") == F.octet_length("run")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    run = run.withColumn("run", F.when(plain, F.lower("run")).otherwise(F.translate("run", upper, lower)))
    h = F.crc32(F.concat(F.coalesce("did", F.lit("")), F.lit(":"), F.col("run")))
    run = run.select("run", h.alias("h"))
    at = F.pmod("h", F.length("run")).cast("int")
    cut = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    word = run.select(F.when(F.col("h") % DELETE_ONE_IN == 0, cut).otherwise(F.col("run")).alias("word"))
    counted = word.where(F.length("word") >= min_chars).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= min_count)


def _block(word: Column) -> Column:
    """Letters of the word in each class (code point modulo the number of classes); their sum is the length."""
    letters = [[c for c in _LETTERS if ord(c) % CLASSES == k] for k in range(CLASSES)]
    return F.array(*[F.length(word) - F.length(F.translate(word, "".join(x), "")) for x in letters])


def _steps() -> list[list[int]]:
    """Changes of a block that lead to blocks of near words: none, a letter more or less, a letter to another class."""
    unit = [[int(i == k) for i in range(CLASSES)] for k in range(CLASSES)]
    moves = [[x - y for x, y in zip(a, b, strict=True)] for a in unit for b in unit if a is not b]
    return [[0] * CLASSES, *unit, *[[-x for x in u] for u in unit], *moves]


def tiles(words: DataFrame, tile_words: int = TILE_WORDS) -> DataFrame:
    """``words(word, n)`` -> (block, tiles, tile, words, ns): the words of a tile in code-point order, separated by line
    feeds, and their n."""
    blocked = words.withColumn("block", _block(F.col("word")))
    size = blocked.groupBy("block").agg(F.greatest(
        F.ceil(F.count("*") / tile_words), F.ceil(F.sum(F.length("word")) / TILE_CHARS)).alias("tiles"))
    dealt = blocked.join(size.hint("merge"), "block").withColumn("tile", F.pmod(F.xxhash64("word"), F.col("tiles")))
    return dealt.groupBy("block", "tiles", "tile").agg(F.sort_array(F.collect_list(F.struct("word", "n"))).alias("held")).select(
        "block", "tiles", "tile", F.array_join(F.transform("held", lambda x: x["word"]), "\n").alias("words"),
        F.transform("held", lambda x: x["n"]).alias("ns"))


def tile_pairs(tiled: DataFrame) -> DataFrame:
    """(pair, own, words, ns): each tile once for every tile pair it is in, its pair with itself (own) too."""
    sizes = written(tiled.select("block", "tiles").distinct(), "sizes")
    step = F.explode(F.array(*[F.array(*map(F.lit, s)) for s in _steps()]))
    near = sizes.select("block", step.alias("step")).select("block", F.zip_with("block", "step", lambda a, b: a + b).alias("other"))
    near = written(near.join(sizes.withColumnsRenamed({"block": "other", "tiles": "others"}).hint("merge"), "other"), "neighbours")
    met = tiled.join(near.hint("merge"), "block").withColumn("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("others") - 1)))
    name = lambda block, tile: F.concat_ws(":", F.array_join(block, "."), tile)
    one, two = name("block", F.col("tile")), name("other", F.col("at"))
    return met.select(F.concat_ws("|", F.least(one, two), F.greatest(one, two)).alias("pair"), (one == two).alias("own"), "words", "ns")


def letter_counts(words: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words separated by line feeds -> letter-count matrix, lengths, and their code points one after another."""
    points = np.frombuffer((words + "\n").encode("utf-32-le"), np.uint32)
    stop = np.flatnonzero(points == 10)
    length = np.diff(np.r_[-1, stop]) - 1
    letters = points[points != 10].astype(np.uint8)
    row = np.repeat(np.arange(len(stop)), length)
    d = len(_LETTERS)
    counts = np.bincount(row * d + _DIM[letters], minlength=len(stop) * d).reshape(len(stop), d)
    return counts.astype(np.float32 if length.max() < 4096 else np.float64), length, letters


def one_edit(a: np.ndarray, na: int, b: np.ndarray, nb: int) -> np.ndarray:
    """Rows of code points, of length ``na`` and ``nb`` (equal or one more): which pairs are at exactly one edit."""
    if na == nb:
        return (a != b).sum(axis=1) == 1
    same = a == b[:, :na]
    head = np.where(same.all(axis=1), na, same.argmin(axis=1))
    tail = (a == b[:, 1:])[:, ::-1]
    return head + np.where(tail.all(axis=1), na, tail.argmin(axis=1)) >= na


def near_pairs(wa: str, wb: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of the words at one edit, of tile a and tile b (None: within a). Words of a tile have one length."""
    ca, la, pa_ = letter_counts(wa)
    cb, lb, pb = (ca, la, pa_) if wb is None else letter_counts(wb)
    if la[0] > lb[0]:
        j, i = near_pairs(wb, wa)
        return i, j
    na, nb = int(la[0]), int(lb[0])
    want = 2 if na == nb else 1
    gram = ca @ cb.T
    # squared distance |a|^2 + |b|^2 - 2 ab
    gram *= -2
    gram += (ca * ca).sum(axis=1)[:, None]
    gram += (cb * cb).sum(axis=1)[None, :]
    hit = gram == want
    if wb is None:
        hit = np.triu(hit, 1)
    i, j = np.nonzero(hit)
    a, b = pa_.reshape(-1, na), pb.reshape(-1, nb)
    step = max(1, _CHECKS // nb)
    ok = [one_edit(a[i[k:k + step]], na, b[j[k:k + step]], nb) for k in range(0, len(i), step)]
    ok = np.concatenate(ok) if ok else np.zeros(0, bool)
    return i[ok], j[ok]


def _votes(words: np.ndarray, i: np.ndarray, j: np.ndarray, others: np.ndarray, their: np.ndarray):
    """For each word i with partners j: how many, and the partner of largest n (ties: the first in code-point order)."""
    order = np.lexsort((j, -their[j], i))
    i, j = i[order], j[order]
    first = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
    return words[i[first]], np.diff(np.r_[first, len(i)]), -their[j[first]], others[j[first]]


def near_votes(pairs: DataFrame) -> DataFrame:
    """(word, near, low, best): by tile pair and word its near words, minus the largest n of one, and that one."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the first tile of the present pair
        out: list[tuple] = []

        def done(a, b):
            i, j = near_pairs(a[1], None if b is None else b[1])
            if not len(i):
                return
            b = b or a
            w, v = (np.array(x[1].split("\n"), object) for x in (a, b))
            if a is b:
                i, j = np.r_[i, j], np.r_[j, i]
                out.append(_votes(w, i, j, w, a[2]))
            else:
                out.append(_votes(w, i, j, v, b[2]))
                out.append(_votes(v, j, i, w, a[2]))

        def flush() -> Iterator[pa.RecordBatch]:
            if out:
                word, near, low, best = (np.concatenate(x) for x in zip(*out, strict=True))
                out.clear()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word, pa.string()), pa.array(near, pa.int64()), pa.array(low, pa.int64()), pa.array(best, pa.string())],
                    names=["word", "near", "low", "best"])

        for batch in batches:
            pair, own, words, ns = (batch.column(k) for k in range(4))
            for k in range(batch.num_rows):
                row = (pair[k].as_py(), words[k].as_py(), ns[k].values.to_numpy(zero_copy_only=False))
                if own[k].as_py():
                    done(row, None)
                elif held is None or held[0] != row[0]:  # a tile may be empty: its partner comes alone
                    held = row
                else:
                    done(held, row)
                    held = None
            yield from flush()

    dealt = pairs.repartition("pair").sortWithinPartitions("pair").select("pair", "own", "words", "ns")
    return dealt.mapInArrow(run, "word string, near long, low long, best string")


def with_forms(words: DataFrame, votes: DataFrame) -> DataFrame:
    """``words(word, n)`` and votes -> (word, form, n, n_near, form_n)."""
    best = votes.groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct("low", "best")).alias("top"))
    joined = words.join(best, "word", "left").withColumn("top_n", -F.col("top.low"))
    better = F.col("top_n") >= 2 * F.col("n")
    return joined.select("word", F.when(better, F.col("top.best")).alias("form"), "n",
                         F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(better, F.col("top_n")).alias("form_n"))


def roots(forms: DataFrame) -> DataFrame:
    """``forms(word, form)`` without nulls -> (word, root), by pointer jumping: n doubles at least along a chain."""
    at = written(forms.select("word", F.col("form").alias("root")), "pointers")
    while True:
        onward = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = written(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                              F.col("next").isNotNull().alias("moved")), "pointers")
        at = moved.drop("moved")
        if moved.where("moved").isEmpty():
            return at


def spelling_variants(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT,
                      tile_words: int = TILE_WORDS) -> DataFrame:
    """``docs(doc_id, text)`` -> (word, form, root, n, n_near, form_n), a row for each word.

    Words are the runs of letters of whole texts, spelled as :func:`spelled_words` says, with at least ``min_chars`` code
    points and ``min_count`` occurrences. ``form`` is the word at one edit with the largest n (ties: first in code-point
    order) if that is at least twice the word's own n, else null; ``root`` is the end of the chain of forms, the word
    itself if it has none. A null or empty text has no words, a null doc_id counts as '' before the colon, rows that repeat
    count again. Other columns are ignored; no words give no rows.
    """
    prepare(docs)
    words = written(spelled_words(docs, min_chars, min_count), "words")
    tiled = written(tiles(words, tile_words), "tiles")
    forms = written(with_forms(words, near_votes(tile_pairs(tiled))), "forms")
    ends = roots(forms.where("form IS NOT NULL").select("word", "form"))
    return forms.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
