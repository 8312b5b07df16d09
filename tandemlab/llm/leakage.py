"""Problem 7: passages of held-out items inside documents, by one Aho-Corasick automaton over normalised words.

Defined results: null texts and items without words match nothing; a passage that several items share is reported for each; a held-out
text shorter than the least run cannot leak; repeated rows count once; empty tables give an empty result; other columns are never read.
Whole texts are scanned.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemlab.llm.text import words, words_at
from tandemlab.sources.tables import materialize, spread

RUN = 12


class PassageIndex:
    """Finds every run of at least ``run`` words of the given texts.

    The automaton holds each text's aligned blocks of run // 2 words; a run of ``run`` words holds one whole block wherever it begins,
    and a hit is carried on to both sides as far as the words agree. Patterns are sequences of word numbers, so the automaton is small.
    """

    def __init__(self, texts: list[tuple[int, str]], run: int = RUN) -> None:
        import ahocorasick

        self.run, self.block = run, run // 2
        self.number: dict[str, int] = {}
        self.texts: list[tuple[int, list[int]]] = []
        at: dict[tuple[int, ...], list[tuple[int, int]]] = defaultdict(list)
        for key, text in texts:
            w = [self.number.setdefault(x, len(self.number) + 1) for x in words(text)]
            if len(w) < run:
                continue
            for j in range(0, len(w) - self.block + 1, self.block):
                at[tuple(w[j : j + self.block])].append((len(self.texts), j))
            self.texts.append((key, w))
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for pattern, places in at.items():
            self.automaton.add_word(pattern, places)
        self.empty = not at
        if at:
            self.automaton.make_automaton()

    def find(self, tokens: list[str]) -> dict[int, tuple[int, int, int]]:
        """The longest run of each item: {key: (words, first word in tokens, first word in the item)}."""
        best: dict[int, tuple[int, int, int]] = {}
        if self.empty or len(tokens) < self.run:
            return best
        seq = tuple(self.number.get(t, 0) for t in tokens)
        done: dict[tuple[int, int], int] = {}  # (text, diagonal) -> end of the run already carried on
        for end, places in self.automaton.iter(seq):
            begin = end - self.block + 1
            for t, j in places:
                if done.get((t, begin - j), -1) >= end:
                    continue
                key, w = self.texts[t]
                lo, a = begin, j
                while lo > 0 and a > 0 and seq[lo - 1] == w[a - 1]:
                    lo, a = lo - 1, a - 1
                hi, b = end + 1, j + self.block
                while hi < len(seq) and b < len(w) and seq[hi] == w[b]:
                    hi, b = hi + 1, b + 1
                done[t, begin - j] = hi - 1
                if hi - lo >= self.run and hi - lo > best.get(key, (0,))[0]:
                    best[key] = (hi - lo, lo, a)
        return best


class HeldTexts:
    """Held-out texts as they are broadcast; their automaton is built once in each Python worker that asks for it, not in each task."""

    def __init__(self, texts: list[tuple[int, str]], run: int) -> None:
        self.texts, self.run, self._index = texts, run, None

    def index(self) -> PassageIndex:
        if self._index is None:
            self._index = PassageIndex(self.texts, self.run)
        return self._index


def leaks(documents: DataFrame, heldout: DataFrame, run: int = RUN, max_chars: int = 20_000_000) -> DataFrame:
    """(doc_id, heldout_id, n_words, start, end): documents that hold ``run`` or more words in a row of an item, with the place in the text.

    The held-out texts are broadcast only up to ``max_chars`` characters at a time, which is checked; a larger set is cut into parts by a
    hash of its ids, one of which is on the driver and the executors at a time, and the documents are scanned once for each part, so nothing
    is left out. A scan needs no shuffle. Places are those of the tokenizer that keeps them, null should it not see the passage.
    """
    spark = documents.sparkSession
    texts = heldout.filter(F.col("heldout_id").isNotNull()).select("heldout_id", F.explode(F.array("question", "solution")).alias("t")).filter(F.col("t").isNotNull()).distinct()
    total = texts.agg(F.sum(F.length("t"))).first()[0] or 0
    parts = -(-total // max_chars)
    docs = spread(documents.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text"))
    schema = "doc_id bigint, heldout_id bigint, n_words int, start int, end int"
    out = spark.createDataFrame([], schema)
    for p in range(parts):
        rows = texts.filter(F.pmod(F.xxhash64("heldout_id"), F.lit(parts)) == p).collect()  # at most about max_chars characters
        shared = spark.sparkContext.broadcast(HeldTexts([(int(r[0]), r[1]) for r in rows], run))

        def scan(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            index = shared.value.index()
            for pdf in batches:
                found = []
                for doc_id, text in zip(pdf["doc_id"], pdf["text"], strict=True):
                    hits = index.find(words(text))
                    if hits:
                        at = words_at(text)
                        places = index.find([w for w, _, _ in at])
                        for key, (n, _, _) in hits.items():
                            m, lo, _ = places.get(key, (0, 0, 0))
                            found.append((doc_id, key, n, at[lo][1] if m else None, at[lo + m - 1][2] if m else None))
                yield pd.DataFrame(found, columns=["doc_id", "heldout_id", "n_words", "start", "end"]).astype({"start": "Int32", "end": "Int32"})

        part = docs.mapInPandas(scan, schema)
        if parts > 1:
            part = materialize(part)
            shared.unpersist()
        out = out.unionByName(part)
    return out.groupBy("doc_id", "heldout_id").agg(F.max(F.struct("n_words", "start", "end")).alias("x")).select("doc_id", "heldout_id", "x.n_words", "x.start", "x.end")


def leaked_items(found: DataFrame, heldout: DataFrame) -> DataFrame:
    """(heldout_id, dataset_id, partition, documents, longest): every held-out item with the number of documents that leak it."""
    per = found.groupBy("heldout_id").agg(F.count("*").alias("documents"), F.max("n_words").alias("longest"))
    items = heldout.filter(F.col("heldout_id").isNotNull()).groupBy("heldout_id").agg(F.min("dataset_id").alias("dataset_id"), F.min("partition").alias("partition"))
    return items.join(per, "heldout_id", "left").select("heldout_id", "dataset_id", "partition", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("longest", F.lit(0)).alias("longest"))
