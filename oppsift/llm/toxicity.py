"""Toxicity of texts by class-conditional Kneser-Ney models.

A word is spelled from a head sign to a tail sign, each character after the four before it. Two models, one of toxic and one of
ordinary texts, give the probability of each character by interpolated Kneser-Ney recursion over the orders 5 to 1: what a class has
counted after a context, less a discount, backs off to the class's probability after the context without its first
character, which rests on continuation counts, the number of different characters that stand before. Beside it, SHARED
counts of weight come from a model of all texts, in which both classes share their counts, as far as the context is known; so a
rare expression is judged by shared counts, alike for both classes, and an unknown context by the shorter ones inside it.

Characters are 32 symbols: the letters a to z, a digit, four classes of all others by their code points, and the edge of a
word. So a model is a table of 32 ** 5 numbers at most at any size of the corpus, and no count is ever dropped: the counts are
gathered from all training texts, the 32 parts of the table (by first symbol) are made by as many tasks, each context that
has been met is a row of 32 numbers of two bytes, and what is broadcast has 73 MB at most.

A text is judged by its length-normalised log-likelihoods, toxic less ordinary, of two kinds: that of its words, each bounded to
CLIP, for toxic texts that are so throughout; and for those that are mostly ordinary prose that of a mixture, a share RATE of whose
words comes from the toxic model and the others from the ordinary one. A logistic function of these means and of the same in standard
errors (times the root of the length) gives the score. It is fitted on training rows, each judged by the counts of the FOLDS parts of
the training rows that it is not in. A word that a text repeats n times counts log2(1 + n) times, in the sums and in the length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oppsift.checkpoints import written
from oppsift.llm.segments import HashIndex, code_values, span_hashes, word_spans
from oppsift.llm.shared import arrow, only, small_side, text_or_empty

#: The model. ORDER and SYMBOLS bound its size; the others were chosen by cross-validation inside the training rows of two tables.
ORDER, SYMBOLS, SHARED, KNOWN, RATE, CLIP = 5, 32, 50.0, 1.0, 0.02, 8.0

DIGIT, OTHER, EDGE = 26, 27, 31

#: At most so many labelled rows of a class fit the logistic function, those whose ids have the smallest hashes; all rows
#: give counts.
ROWS_PER_CLASS, FOLDS = 2_000, 3

#: Words that each process remembers, and characters that it works on at once.
REMEMBERED, STEP = 200_000, 150_000

#: Contexts whose probabilities the driver finds at once.
CONTEXTS = 2_048

_TOP = 0x110000


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point: is it part of a word; its lower case; the symbol of a lower-case one."""
    word, low, symbol = np.zeros(_TOP, np.bool_), np.arange(_TOP, dtype=np.uint32), (OTHER + np.arange(_TOP) % 4).astype(np.uint8)
    for c in range(_TOP):
        char = chr(c)
        if char.isalnum():
            word[c] = True
            if char.isdigit():
                symbol[c] = DIGIT
            if len(small := char.lower()) == 1:
                low[c] = ord(small)
    symbol[ord("a") : ord("z") + 1] = np.arange(26)
    return word, low, symbol


_made: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []


def _codes(whole: str) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points, and which are parts of words."""
    if not _made:
        _made.append(_tables())
    word, low, _ = _made[0]
    codes = low[np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)]
    return codes, word[codes]


def _cells(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each character of the words, and of the tail behind each: its word, and the cell of the table for it and the four before."""
    before = ORDER - 1
    size = ends - starts + before + 1
    first = np.cumsum(size) - size
    word = np.repeat(np.arange(len(size)), size)
    place = np.arange(len(word)) - first[word]
    signs = np.full(len(word), EDGE, np.int32)
    body = (place >= before) & (place < (size - 1)[word])
    signs[body] = _made[0][2][codes[(starts[word] + place - before)[body]]]
    cell = signs
    for k in range(1, ORDER):
        cell = cell[:-1] << 5 | signs[k:]
    use = place[before:] >= before
    return word[before:][use], cell[use]


@dataclass
class KneserNey:
    """The evidence of characters in their contexts: log-likelihood if toxic less that if ordinary."""

    #: Of each context the row in ``known``, -1 of those that no training text has; of these ``lower`` tells, by the last symbols of the cell.
    place: np.ndarray
    known: np.ndarray
    lower: np.ndarray
    #: Of the logistic function: constant, and one for each of ``Scorer.evidence``'s columns.
    weights: np.ndarray | None = None

    def evidence(self, cell: np.ndarray) -> np.ndarray:
        row = self.place[cell // SYMBOLS]
        out = self.lower[cell % len(self.lower)]
        some = row >= 0
        out[some] = self.known[row[some], cell[some] % SYMBOLS]
        return out

    def words(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Of each word two log-likelihoods, in a toxic text less in an ordinary one: of the mixture, and of the word bounded to CLIP."""
        word, cell = _cells(codes, starts, ends)
        ratio = np.bincount(word, self.evidence(cell), len(starts))
        return np.column_stack([np.log1p(RATE * np.expm1(np.clip(ratio, -30, 30))), np.clip(ratio, -CLIP, CLIP)])


#: Columns of a text's evidence.
FEATURES = ["mixture", "mixture_errors", "words", "words_errors"]


class Scorer:
    """Evidence of texts; a word met before is looked up."""

    def __init__(self, model: KneserNey) -> None:
        self.model, self.seen, self.known = model, HashIndex(REMEMBERED), np.empty((0, 2))  # twice as many slots

    def _words(self, keys: np.ndarray, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if self.seen.count > REMEMBERED:
            self.seen.clear()
            self.known = np.empty((0, 2))
        entry = self.seen.find(keys).astype(np.int64)
        new = np.flatnonzero(entry < 0)
        if len(new):
            some, first, which = np.unique(keys[new], return_index=True, return_inverse=True)
            one = new[first]
            entry[new] = len(self.known) + which
            self.seen.add(some, len(self.known) + np.arange(len(some)))
            self.known = np.concatenate([self.known, self.model.words(codes, starts[one], ends[one])])
        return self.known[entry]

    def evidence(self, texts: list[str]) -> np.ndarray:
        """Of each text ``FEATURES``: both log-likelihoods' differences by its length, and each in standard errors; zeros without words."""
        out = np.zeros((len(texts), 4))
        lo = 0
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= STEP):
                size += len(texts[hi])
                hi += 1
            codes, inside = _codes("".join(texts[lo:hi]))
            if inside.any():
                starts, ends, at = word_spans(inside, np.concatenate([[0], np.cumsum([len(t) for t in texts[lo:hi]])]))
                keys, text = span_hashes(code_values()[codes], starts, ends), np.repeat(np.arange(hi - lo), np.diff(at))
                order = np.lexsort((keys, text))
                keys, text = keys[order], text[order]
                one = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]) | (text[1:] != text[:-1])])
                weight = np.log2(1 + np.diff(np.append(one, len(keys))))
                values = self._words(keys[one], codes, starts[order[one]], ends[order[one]])
                length = np.bincount(text[one], weight, hi - lo)
                for k in range(2):
                    mean = np.bincount(text[one], weight * values[:, k], hi - lo) / np.maximum(length, 1)
                    out[lo:hi, 2 * k], out[lo:hi, 2 * k + 1] = mean, mean * np.sqrt(length)
            lo = hi
        return out


def _in_parts(batches: Iterator[pa.RecordBatch], broadcast: Broadcast, rows: int = 512) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    scorer = only(("toxicity", id(broadcast.value)), lambda: Scorer(broadcast.value))
    for batch in batches:
        column = batch.schema.names.index("text")
        for lo in range(0, batch.num_rows, rows):
            part = batch.slice(lo, rows)
            yield part, scorer.evidence([t or "" for t in part.column(column).to_pylist()])


def _evidence(batches: Iterator[pa.RecordBatch], broadcast: Broadcast) -> Iterator[pa.RecordBatch]:
    for part, x in _in_parts(batches, broadcast):
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, x.T)], ["doc_id", *FEATURES])


def _scored(batches: Iterator[pa.RecordBatch], broadcast: Broadcast, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
    for part, x in _in_parts(batches, broadcast):
        score = 1 / (1 + np.exp(-np.clip(weights[0] + x @ weights[1:], -500, 500))) * np.isfinite(weights[0])
        yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score)], [*part.schema.names, "score"])


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, fold, toxic, ordinary): how often each class's texts (text, toxic, fold) of the task have a cell's characters; a word
    counts once a text."""
    held, some = [], 0

    def summed() -> list[tuple[np.ndarray, np.ndarray]]:
        cells, which = np.unique(np.concatenate([c for c, _ in held]), return_inverse=True)
        counts = np.concatenate([n for _, n in held])
        return [(cells, np.column_stack([np.bincount(which, counts[:, k], len(cells)) for k in range(2)]))]

    for batch in batches:
        texts, toxic, lo = [t or "" for t in batch.column("text").to_pylist()], batch.column("toxic").to_numpy(zero_copy_only=False), 0
        fold = batch.column("fold").to_numpy(zero_copy_only=False).astype(np.int64)
        while lo < len(texts):
            hi, size = lo, 0
            while hi < len(texts) and (hi == lo or size + len(texts[hi]) <= STEP):
                size += len(texts[hi])
                hi += 1
            codes, inside = _codes("".join(texts[lo:hi]))
            if inside.any():
                starts, ends, at = word_spans(inside, np.concatenate([[0], np.cumsum([len(t) for t in texts[lo:hi]])]))
                keys, text = span_hashes(code_values()[codes], starts, ends), np.repeat(np.arange(hi - lo), np.diff(at))
                part = fold[lo:hi][text]
                order = np.lexsort((text, keys, part))
                keys, text, part = keys[order], text[order], part[order]
                new = np.r_[True, (keys[1:] != keys[:-1]) | (part[1:] != part[:-1])]
                once = new | np.r_[True, text[1:] != text[:-1]]
                which, is_toxic = np.cumsum(new)[once] - 1, toxic[lo:hi][text[once]] == 1
                count = np.column_stack([np.bincount(which, x, int(new.sum())) for x in (is_toxic, ~is_toxic)])
                word, cell = _cells(codes, starts[order[new]], ends[order[new]])
                held.append((part[new][word] * SYMBOLS**ORDER + cell, count[word]))
                some += len(cell)
            lo = hi
            if some > 2_000_000 and len(held) > 1:
                held = summed()
                some = len(held[0][0]) // 2
    if held:
        [(cells, counts)] = summed()
        for lo in range(0, len(cells), 1 << 18):
            part = slice(lo, lo + (1 << 18))
            places = [(cells[part] % SYMBOLS**ORDER).astype(np.int32), (cells[part] // SYMBOLS**ORDER).astype(np.int32)]
            yield pa.RecordBatch.from_arrays([*map(pa.array, places), *(pa.array(counts[part, k].astype(np.int64)) for k in range(2))], ["cell", "fold", "toxic", "ordinary"])


def discount(once: float, twice: float) -> float:
    """By how many n-grams were counted once and twice."""
    return once / (once + 2 * twice) if once and twice else 0.5


def interpolated(counts: list[np.ndarray], lower: list[np.ndarray], discounts: list[float]) -> list[np.ndarray]:
    """Probabilities of one order by the recursion, for toxic, ordinary and both: of each context (a row) and next symbol (a column).
    counts: of these three, lower: the next lower order's probabilities at the contexts without their first symbols."""
    total, off = [c.sum(1, keepdims=True) for c in counts], [np.minimum(c, d).sum(1, keepdims=True) for c, d in zip(counts, discounts, strict=True)]
    above = [np.maximum(c - d, 0) for c, d in zip(counts, discounts, strict=True)]
    both = np.where(total[2] > 0, (above[2] + off[2] * lower[2]) / np.maximum(total[2], 1e-300), lower[2])
    known = total[2] / (total[2] + KNOWN)
    return [*((above[k] + off[k] * lower[k] + SHARED * (known * both + (1 - known) * lower[k])) / (total[k] + SHARED) for k in range(2)), both]


def lower_orders(counts: list[np.ndarray]) -> list[np.ndarray]:
    """The probabilities (toxic, ordinary, both) of order ORDER - 1, by cell, of its continuation counts."""
    kinds = [counts]
    for k in range(ORDER - 2, 0, -1):
        kinds.append([(c.reshape(-1, SYMBOLS**k) > 0).sum(0) for c in kinds[-1]])
    p = [np.full(1, 1 / SYMBOLS)] * 3
    for order, counted in enumerate(reversed(kinds), 1):
        contexts = SYMBOLS ** (order - 1)
        d = [discount((c == 1).sum(), (c == 2).sum()) for c in counted]
        rows, made = [c.reshape(-1, SYMBOLS) for c in counted], [np.empty((contexts, SYMBOLS)) for _ in counted]
        for lo in range(0, contexts, CONTEXTS):
            part = slice(lo, min(lo + CONTEXTS, contexts))
            back = [x.reshape(-1, SYMBOLS)[np.arange(part.start, part.stop) % (contexts // SYMBOLS)] if order > 1 else x for x in p]
            for out, x in zip(made, interpolated([c[part].astype(np.float64) for c in rows], back, d), strict=True):
                out[part] = x
        p = [x.ravel() for x in made]
    return p


def _evidence_of(p: list[np.ndarray]) -> np.ndarray:
    out = np.empty(p[0].shape, np.float16)
    for lo in range(0, len(out), CONTEXTS * SYMBOLS):
        part = slice(lo, lo + CONTEXTS * SYMBOLS)
        out[part] = np.log(p[0][part]) - np.log(p[1][part])
    return out


def _slice(rows: pa.Table, lower: list[np.ndarray], discounts: list[float]) -> tuple[np.ndarray, np.ndarray]:
    """The contexts of ``rows`` (cell, toxic, ordinary), which are all that was counted after them, and their evidence."""
    cell = rows["cell"].to_numpy()
    some, which = np.unique(cell // SYMBOLS, return_inverse=True)
    counts = [np.zeros((len(some), SYMBOLS)) for _ in range(2)]
    for k, name in enumerate(("toxic", "ordinary")):
        counts[k][which, cell % SYMBOLS] = rows[name].to_numpy()
    below = [x.reshape(-1, SYMBOLS)[some % (len(x) // SYMBOLS)] for x in lower]
    return some, _evidence_of(interpolated([*counts, counts[0] + counts[1]], below, discounts))


def fitted_counts(grams: DataFrame) -> KneserNey:
    """The model of counts (cell, toxic, ordinary), each cell once."""
    spark, size = grams.sparkSession, SYMBOLS ** (ORDER - 1)
    of = {"toxic": F.col("toxic"), "ordinary": F.col("ordinary"), "both": F.col("toxic") + F.col("ordinary")}
    n = grams.agg(*(F.count_if(v == k).alias(f"{c}_{k}") for c, v in of.items() for k in (1, 2))).first()
    discounts = [discount(n[f"{c}_1"], n[f"{c}_2"]) for c in of]
    # at most SYMBOLS ** 4 rows, whose counts are SYMBOLS at most
    kinds = grams.groupBy((F.col("cell") % size).alias("cell")).agg(*(F.count_if(v > 0).cast("byte").alias(c) for c, v in of.items())).toArrow()
    counts = [np.zeros(size, np.uint8) for _ in of]
    for c, name in zip(counts, of, strict=True):
        c[kinds["cell"].to_numpy()] = kinds[name].to_numpy()
    del kinds
    lower = lower_orders(counts)
    share = spark.sparkContext.broadcast(lower)
    lower = _evidence_of(lower)  # the driver needs no more of them

    def made(rows: pa.Table) -> pa.Table:
        some, evidence = _slice(rows, share.value, discounts)
        return pa.table({"contexts": pa.array([some.astype("<i4").tobytes()], pa.binary()), "evidence": pa.array([evidence.tobytes()], pa.binary())})

    # SYMBOLS parts of 2 MB at most, which the driver holds twice only one by one
    parts = grams.groupBy(F.expr(f"cell div {size}")).applyInArrow(made, "contexts binary, evidence binary").toArrow().to_batches()
    share.destroy()
    place, rows = np.full(size, -1, np.int32), 0
    known = np.empty((sum(len(x.as_py()) for b in parts for x in b["contexts"]) // 4, SYMBOLS), np.float16)
    while parts:
        batch = parts.pop()
        for contexts, evidence in zip(batch["contexts"], batch["evidence"], strict=True):
            contexts = np.frombuffer(contexts.as_buffer(), "<i4")
            place[contexts] = np.arange(rows, rows + len(contexts))
            known[rows : rows + len(contexts)] = np.frombuffer(evidence.as_buffer(), np.float16).reshape(-1, SYMBOLS)
            rows += len(contexts)
    return KneserNey(place, known, lower)


def unfitted() -> KneserNey:
    """A model that knows nothing and gives every text 0."""
    size = SYMBOLS ** (ORDER - 1)
    return KneserNey(np.full(size, -1, np.int32), np.zeros((0, SYMBOLS), np.float16), np.zeros(size, np.float16), np.array([-np.inf, *[0] * len(FEATURES)]))


def remainder(doc_id: str = "doc_id", of: int = 3) -> Column:
    """crc32 of the id as text, modulo ``of``."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % of


#: Constant and weights, of columns in standard deviations, before any training row is seen.
PRIOR, BALANCE = np.array([-3.0, 1.0, 1.0, 1.0, 1.0]), 0.5


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, steps: int = 100) -> np.ndarray:
    """Weights with a constant first, by Newton's method with halved steps, drawn to PRIOR.

    The rarer class weighs more: a class with a share s of the rows has weights of (1 / 2s) to the power of BALANCE."""
    center, scale = (x.mean(0), np.maximum(x.std(0), 1e-6)) if len(x) else (np.zeros(x.shape[1]), np.ones(x.shape[1]))
    x = np.column_stack([np.ones(len(x)), (x - center) / scale])
    share = np.where(y == 1, len(y) / max(2 * y.sum(), 1), len(y) / max(2 * (1 - y).sum(), 1)) ** BALANCE

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((share * (np.logaddexp(0, z) - y * z)).sum() + ridge / 2 * ((w - PRIOR) ** 2).sum())

    w = PRIOR.copy()
    for _ in range(steps):
        q = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (share * (q - y)) + ridge * (w - PRIOR)
        step, size = np.linalg.solve((x * (share * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w)), slope), 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w) - 1e-4 * size * float(slope @ step):
            size /= 2
        w = w - size * step
        if np.abs(slope).max() < 1e-6:
            break
    return np.concatenate([[w[0] - w[1:] @ (center / scale)], w[1:] / scale])


def fit_toxicity(docs: DataFrame, labels: DataFrame, rows_per_class: int = ROWS_PER_CLASS) -> KneserNey:
    """A model of ``docs`` (doc_id, text) as ``labels`` (doc_id, toxic) marks them.

    Only labels whose crc32(doc_id as text) modulo 3 is not 1 are used. All of them give the counts, which say how many texts have a
    word (a word counts once a text); at most ``rows_per_class`` of each class fit the logistic function. Null ids and labels other than 0
    and 1 are left out; an id marked both ways counts as toxic. Repeated rows count as often as they occur. Without a row of either
    class, as for empty tables, all scores are 0.
    """
    spark = docs.sparkSession
    marked = labels.where("doc_id is not null and toxic in (0, 1)").where(remainder() != 1).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    hashed = F.xxhash64(F.col("doc_id").cast("string"))
    marked = written(marked.withColumn("fold", F.pmod(hashed, F.lit(FOLDS)).cast("int")), "labelled")
    chosen = [marked.where(F.col("toxic") == k).orderBy(hashed, "doc_id").limit(rows_per_class) for k in (0, 1)]
    chosen = written(chosen[0].unionByName(chosen[1]), "fitted")  # at most 2 * rows_per_class rows, so it may be broadcast
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    counts = texts.join(small_side(marked), "doc_id").select("text", "toxic", "fold").transform(arrow, _counted, "cell int, fold int, toxic long, ordinary long")
    sums = [F.sum(k).alias(k) for k in ("toxic", "ordinary")]
    grams = written(counts.groupBy("cell", "fold").agg(*sums), "grams")
    n = grams.agg(*sums).first()
    if not n["toxic"] or not n["ordinary"]:
        return unfitted()
    rows = written(texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "fold", "toxic"), "rows")
    fit = []
    for fold in range(FOLDS):
        others = fitted_counts(written(grams.where(F.col("fold") != fold).groupBy("cell").agg(*sums), "others"))
        broadcast = spark.sparkContext.broadcast(others)
        del others  # else the driver holds it while the next is made
        fields = f"doc_id {dict(docs.dtypes)['doc_id']}, {', '.join(f'{c} double' for c in FEATURES)}"
        found = rows.where(F.col("fold") == fold).select("doc_id", "text").transform(arrow, lambda b, share=broadcast: _evidence(b, share), fields)
        fit.append(found.join(F.broadcast(chosen.select("doc_id", "toxic")), "doc_id").toArrow())
        broadcast.destroy()
    found = pa.concat_tables(fit).sort_by([("doc_id", "ascending"), *((c, "ascending") for c in FEATURES)])
    model = fitted_counts(written(grams.groupBy("cell").agg(*sums), "cells"))
    x = np.column_stack([found[c].to_numpy() for c in FEATURES])
    model.weights = fit_logistic(x, found["toxic"].to_numpy().astype(np.float64))
    return model


def score_toxicity(docs: DataFrame, model: KneserNey, threshold: float = 0.7) -> DataFrame:
    """``docs`` with score (0 to 1, higher: likelier toxic) and predicted (1 if score >= threshold) after its columns, which
    they replace if it has them.

    Only the whole text counts; a null text is an empty one, and texts without words all have one low score. Every row has
    a result, repeated rows the same; an empty table gives an empty result.
    """
    broadcast, weights = docs.sparkSession.sparkContext.broadcast(model), model.weights
    docs = docs.drop("score", "predicted")
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    out = docs.transform(arrow, lambda b: _scored(b, broadcast, weights), f"{fields}, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
