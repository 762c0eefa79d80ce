"""Problem 8: evaluation texts that leaked into documents, by BM25 with block-max WAND."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from factweave.plans.lineage import measured
from factweave.sources.tables import table

#: Consecutive words that make a leak.
RUN = 10
#: Words of a term of the index. Single words are too common to tell test items apart.
TERM = 3
#: Consecutive terms that make a leak.
STEPS = RUN - TERM + 1
#: Most terms of a passage; passages overlap so that each run lies whole in one of them.
PASSAGE = 2 * STEPS
#: Test texts of one index and passages that one task asks; more of either make more tasks.
TEXTS_PER_INDEX = 50_000
PASSAGES_PER_TASK = 20_000
#: Bits of the filter of terms for each letter of the test items, and at most (32 MB).
BITS_PER_LETTER, MOST_BITS = 4, 2**28
#: Postings of one block of the index.
BLOCK = 64
K1, B = 1.2, 0.75

WORD = re.compile(r"[^\W_]+")


def words(text: str | None) -> list[str]:
    """Maximal runs of letters and digits, without case."""
    return WORD.findall(text.lower()) if text else []


def terms(w: list[str]) -> list[str]:
    """The overlapping terms of a list of words, in order."""
    return [" ".join(w[i : i + TERM]) for i in range(len(w) - TERM + 1)]


class WandIndex:
    """Inverted BM25 index of test texts, with thresholds that lose nothing.

    Texts are lists of words, terms are ``TERM`` words in a row. The weight of a term in a test
    text does not depend on the passage that asks, so a passage that holds a run of ``STEPS``
    terms of the text scores at least the smallest sum of weights over the distinct terms of
    any such run. That minimum is the text's threshold; weights are divided by it, and a search
    returns every text with a score of 1 or more.
    """

    def __init__(self, texts: list[tuple[str, list[str]]]):
        texts = [(k, terms(w)) for k, w in texts if len(w) >= RUN]
        self.keys = [k for k, _ in texts]
        self.runs = [{tuple(w[i : i + STEPS]) for i in range(len(w) - STEPS + 1)} for _, w in texts]
        n, mean = len(texts), sum(len(w) for _, w in texts) / max(1, len(texts))
        df = Counter(t for _, w in texts for t in set(w))
        idf = {t: math.log(1 + (n - d + 0.5) / (d + 0.5)) for t, d in df.items()}
        postings: dict[str, list[tuple[int, float]]] = {}
        for no, (_, w) in enumerate(texts):
            norm = K1 * (1 - B + B * len(w) / mean)
            weight = {t: idf[t] * f * (K1 + 1) / (f + norm) for t, f in Counter(w).items()}
            least = min(sum(weight[t] for t in set(w[i : i + STEPS])) for i in range(len(w) - STEPS + 1))
            for t, x in weight.items():
                postings.setdefault(t, []).append((no, x / least + 1e-9))
        self.docs = {t: [no for no, _ in p] for t, p in postings.items()}
        self.weights = {t: [x for _, x in p] for t, p in postings.items()}
        self.block_max = {t: [max(w[i : i + BLOCK]) for i in range(0, len(w), BLOCK)] for t, w in self.weights.items()}
        self.most = {t: max(w) for t, w in self.weights.items()}

    def search(self, passage: list[str]) -> list[int]:
        """Numbers of all texts whose score reaches their threshold."""
        most = self.most
        terms = {t for t in passage if t in most}
        if sum(most[t] for t in terms) < 1:
            return []
        end = len(self.keys)
        # A cursor: current text, position, texts, weights, block maxima, bound.
        cursors = [[self.docs[t][0], 0, self.docs[t], self.weights[t], self.block_max[t], most[t]] for t in terms]
        found = []
        while True:
            cursors.sort(key=lambda c: c[0])
            total, pivot = 0.0, -1
            for i, c in enumerate(cursors):
                total += c[5]
                if total >= 1:
                    pivot = i
                    break
            if pivot < 0:
                return found
            at = cursors[pivot][0]
            if at >= end:
                return found
            while pivot + 1 < len(cursors) and cursors[pivot + 1][0] == at:
                pivot += 1
            # The bound from the blocks that hold the pivot; a block left behind is looked up.
            bound, reach = 0.0, end
            for c in cursors[: pivot + 1]:
                block = c[1] // BLOCK
                docs = c[2]
                while block < len(c[4]) and docs[min(len(docs), (block + 1) * BLOCK) - 1] < at:
                    block += 1
                if block < len(c[4]):
                    bound += c[4][block]
                    reach = min(reach, docs[min(len(docs), (block + 1) * BLOCK) - 1] + 1)
            if bound < 1:
                # No text up to the end of the nearest block can reach it.
                upto = max(at + 1, min(reach, cursors[pivot + 1][0] if pivot + 1 < len(cursors) else end))
                for c in cursors[: pivot + 1]:
                    self._forward(c, upto, end)
            elif cursors[0][0] == at:
                score = 0.0
                for c in cursors[: pivot + 1]:
                    score += c[3][c[1]]
                    self._forward(c, at + 1, end)
                if score >= 1:
                    found.append(at)
            else:
                for c in cursors[:pivot]:
                    if c[0] < at:
                        self._forward(c, at, end)

    @staticmethod
    def _forward(c: list, upto: int, end: int) -> None:
        docs, i = c[2], c[1]
        while i < len(docs) and docs[i] < upto:
            i += 1
        c[1], c[0] = i, docs[i] if i < len(docs) else end

    def stretches(self, w: list[str]) -> Iterator[list[str]]:
        """Longest stretches of terms that the index knows: no run goes beyond one."""
        known, start = self.most, 0
        for i, t in enumerate(w):
            if t not in known:
                if i - start >= STEPS:
                    yield w[start:i]
                start = i + 1
        if len(w) - start >= STEPS:
            yield w[start:]

    def passages(self, w: list[str]) -> Iterator[list[str]]:
        """Passages of at most ``PASSAGE`` terms in which a run may lie.

        A run scores at most the sum of its terms' bounds, so only places from which ``STEPS``
        terms sum up to a threshold can begin one.
        """
        bound = [self.most[t] for t in w]
        total = sum(bound[:STEPS])
        first = None
        for i in range(len(w) - STEPS + 1):
            if i:
                total += bound[i + STEPS - 1] - bound[i - 1]
            if total >= 1:
                if first is None:
                    first = i
                elif i - first > STEPS:
                    yield w[first : i + STEPS - 1]
                    first = i
            elif first is not None:
                yield w[first : i + STEPS - 1]
                first = None
        if first is not None:
            yield w[first:]

    def leaked(self, w: list[str]) -> set[str]:
        """Keys of the texts of which the words ``w`` hold a run, verified word by word."""
        out: set[str] = set()
        for stretch in self.stretches(terms(w)):
            for passage in self.passages(stretch):
                hits = [no for no in self.search(passage) if self.keys[no] not in out]
                if hits:
                    grams = [tuple(passage[i : i + STEPS]) for i in range(len(passage) - STEPS + 1)]
                    out.update(self.keys[no] for no in hits if any(g in self.runs[no] for g in grams))
        return out


# ---------------------------------------------------------------- the filter of terms
class Words:
    """The words of many texts in one array, with a number for the term that begins at each."""

    def __init__(self, texts):
        each = [words(t) for t in texts]
        self.flat = list(chain.from_iterable(each))
        self.ends = np.cumsum([len(w) for w in each], dtype=np.int64)
        n = len(self.flat)
        self.inside = np.zeros(n, dtype=bool)
        self.hash = np.zeros(n, dtype=np.uint64)
        if n >= TERM:
            one = pd.util.hash_array(np.array(self.flat, dtype=object))
            for i in range(TERM):
                self.hash[: n - TERM + 1] = (self.hash[: n - TERM + 1] + one[i : n - TERM + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            # A term may not reach beyond its text.
            last = np.repeat(self.ends, [len(w) for w in each])
            self.inside = np.arange(n) + TERM <= last

    def slots(self, bits: int) -> np.ndarray:
        """Place of every term in a filter of ``2 ** bits`` bits."""
        return (self.hash >> np.uint64(64 - bits)).astype(np.int64)


def known_terms(texts: DataFrame, letters: int) -> tuple[int, np.ndarray]:
    """``bits`` and the filter (a bit a term, as bytes) of the terms of ``texts(text)``.

    Tasks set bits, Spark unites them by words of 64; the driver gets the filter, whose size
    is bounded. A filter that fills up lets more pass, which the index then refuses.
    """
    bits = max(16, min(MOST_BITS, BITS_PER_LETTER * max(1, letters)).bit_length() - 1)

    def set_bits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            w = Words(batch["text"])
            at = np.unique(w.slots(bits)[w.inside])
            yield pd.DataFrame({"word": at >> 6, "mask": (np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64)})

    rows = texts.select("text").mapInPandas(set_bits, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toPandas()
    words64 = np.zeros(2**bits // 64, dtype=np.int64)
    words64[rows["word"].to_numpy()] = rows["mask"].to_numpy()
    return bits, words64.view(np.uint8)


def _passages(bits: int, shared):
    """Longest stretches of words all of whose terms the filter knows, if a run fits in."""

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = shared.value
        for batch in batches:
            w = Words(batch["text"])
            at = w.slots(bits)
            there = w.inside & ((known[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool)
            edge = np.flatnonzero(np.diff(np.concatenate([[0], there.view(np.int8), [0]])))
            start, end = edge[::2], edge[1::2]
            long = end - start >= STEPS
            start, end = start[long], end[long] + TERM - 1
            doc = batch["doc_id"].to_numpy()[np.searchsorted(w.ends, start, side="right")]
            yield pd.DataFrame({"doc_id": doc, "passage": pd.Series([" ".join(w.flat[a:b]) for a, b in zip(start, end)], dtype=object)})

    return cut


# ---------------------------------------------------------------- the search
def leaks(documents: DataFrame, items: DataFrame, texts_per_index: int = TEXTS_PER_INDEX, passages_per_task: int = PASSAGES_PER_TASK) -> DataFrame:
    """``doc_id, question_id`` of every document that holds a run of an item, distinct.

    ``documents(doc_id, text)``, ``items(question_id, question, gold_answer)``. A run lies
    within one of the two fields. Null and blank texts and items shorter than a run give no
    row. Documents are read and taken apart once, where they lie: what is left are the passages
    of words whose terms all occur in the items, a text each. Every different passage then asks
    the index. Many items make several indexes, many passages several tasks for each; a task
    holds ``texts_per_index`` and ``passages_per_task`` on average, whatever the sizes of the
    two tables. Nothing but the filter of terms comes to the driver.
    """
    spark = documents.sparkSession
    texts = items.select(F.col("question_id").alias("key"), F.explode(F.array("question", "gold_answer")).alias("text")).where("key is not null and text is not null")
    size = texts.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("text")).alias("letters")).first()
    bits, known = known_terms(texts, int(size["letters"] or 0))
    asked = documents.select("doc_id", "text").where("doc_id is not null and text is not null")
    held = asked.mapInPandas(_passages(bits, spark.sparkContext.broadcast(known)), "doc_id bigint, passage string")
    held, seen = measured(held, "passages", n=F.count(F.lit(1)))
    indexes, tasks = max(1, -(-size["n"] // texts_per_index)), max(1, -(-seen["n"] // passages_per_task))

    def numbers(n: int):
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    left = texts.withColumn("no", F.pmod(F.xxhash64("key", "text"), F.lit(indexes)).cast("int")).withColumn("task", numbers(tasks))
    different = held.select("passage").distinct()
    right = different.withColumn("task", F.pmod(F.xxhash64("passage"), F.lit(tasks)).cast("int")).withColumn("no", numbers(indexes))
    met = left.groupBy("no", "task").cogroup(right.groupBy("no", "task")).applyInPandas(_ask, "p string, question_id string")
    return held.join(met.hint("merge"), F.col("passage") == F.col("p")).select("doc_id", "question_id").distinct()


def _ask(texts: pd.DataFrame, passages: pd.DataFrame) -> pd.DataFrame:
    index = WandIndex([(k, words(t)) for k, t in zip(texts["key"], texts["text"])])
    hits = [(p, q) for p in passages["passage"] for q in index.leaked(p.split(" "))]
    return pd.DataFrame(hits, columns=["p", "question_id"], dtype=object)


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents and the retrieval questions that leaked into them."""
    return leaks(table(spark, folder, "documents"), table(spark, folder, "retrieval_questions"))


def p8_items(spark: SparkSession, folder: str) -> DataFrame:
    """How many documents each test item leaked into, those that did not leak included."""
    found = p8_found(spark, folder).groupBy("question_id").agg(F.count(F.lit(1)).alias("documents"))
    items = table(spark, folder, "retrieval_questions").select("question_id").distinct()
    return items.join(found, "question_id", "left").select("question_id", F.coalesce("documents", F.lit(0)).alias("documents"))
