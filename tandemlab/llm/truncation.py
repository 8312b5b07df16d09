"""Problem 1: texts cut off by token budgets, stored field lengths or transfer.

Defined results: a null or contentless text is not cut; a response delivered several times is read once (its earliest non-null text);
rows with a null request_id are left out; witnesses that are missing say nothing; an empty table gives an empty result; other columns are
never read. Whole texts are parsed.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tandemlab.llm import endings
from tandemlab.sources.tables import drop_materialized, materialize, spread

#: A response is put as chars of text a token where the corpus has no finished response to learn it from.
CHARS_A_TOKEN = 4.2


#: The encodings under which lengths are recomputed, plain characters first.
ENCODINGS = ("chars", "utf8", "utf16", "json", "json_ascii", "html", "crlf", "json_utf8")


def lengths(text: Column) -> dict[str, Column]:
    """The length of a text as a store may have counted it, by encoding."""
    n = F.length(text)
    count = lambda marks: n - F.length(F.translate(text, marks, ""))
    quotes = count('"\\\n\r\t')
    wide = n - F.length(F.regexp_replace(text, r"[^\x00-\x7f]", ""))
    entity = count("&") * 4 + count("<>") * 3 + count('"') * 5 + count("'") * 4
    return {
        "chars": n,
        "utf8": F.octet_length(text),
        "utf16": n + (n - F.length(F.regexp_replace(text, r"[\x{10000}-\x{10ffff}]", ""))),
        "json": n + quotes,
        "json_ascii": n + quotes + wide * 5,
        "html": n + entity,
        "crlf": n + count("\n"),
        "json_utf8": F.octet_length(text) + quotes,
    }


def text_lengths(text: str) -> list[int]:
    """``lengths`` of one text, in the order of ENCODINGS, for stages that hold texts in Python."""
    n, plain = len(text), text.isascii()
    octets = n if plain else len(text.encode("utf-8", "surrogatepass"))
    lines = text.count("\n")
    quotes = text.count('"') + text.count("\\") + lines + text.count("\r") + text.count("\t")
    wide = 0 if plain else n - len(text.encode("ascii", "ignore"))
    entity = 4 * text.count("&") + 3 * (text.count("<") + text.count(">")) + 5 * text.count('"') + 4 * text.count("'")
    return [n, octets, n if plain else len(text.encode("utf-16-le", "surrogatepass")) // 2, n + quotes, n + quotes + 5 * wide, n + entity, n + lines, octets + quotes]


def hidden_limits(texts: DataFrame, least: int = 6, times: float = 8.0, window: int = 12, share: float = 0.8) -> DataFrame:
    """(encoding, length, texts, open_ends, share_open): lengths at which a store seems to cut.

    ``texts``: (text, or a column of lengths for each of ENCODINGS; unfinished boolean, null where the text itself does not tell). Lengths of all texts are recomputed under each encoding
    and grouped; a length is a limit if ``times`` as many texts have it as lengths within ``window`` of it have on average, and if, of those
    that tell, ``least`` and a ``share`` are unfinished. Encodings that agree on plain texts cast each other's shadow, so the encoding whose limits hold most texts is taken
    first, and the others are asked again without those texts, until none has a limit left.
    """
    spark = texts.sparkSession
    ready = set(ENCODINGS) <= set(texts.columns)
    rest = sized = texts.select("unfinished", *ENCODINGS) if ready else materialize(texts.select("unfinished", *[v.cast("bigint").alias(k) for k, v in lengths(F.col("text")).items()]))
    kinds = list(ENCODINGS)
    limits: list[tuple] = []  # one row per limit of a store: few
    for _ in kinds:  # an encoding whose limits were taken has none left
        encoded = F.explode(F.create_map(*[x for k in kinds for x in (F.lit(k), F.col(k))])).alias("encoding", "length")
        per = rest.select("unfinished", encoded).groupBy("encoding", "length").agg(F.count("*").alias("texts"), F.count("unfinished").alias("told"), F.count_if("unfinished").alias("open_ends"))
        near = Window.partitionBy("encoding").orderBy("length").rangeBetween(-window, window)
        around = (F.sum("texts").over(near) - F.col("texts")) / (2.0 * window)
        spike = (F.col("open_ends") >= least) & (F.col("texts") >= F.lit(times) * F.col("around"))
        kept = per.withColumn("around", around).filter(spike & (F.col("open_ends") >= F.lit(share) * F.col("told"))).drop("around").collect()
        held: dict[str, int] = defaultdict(int)
        for r in kept:
            held[r["encoding"]] += r["texts"]
        if not held:
            break
        best = max(kinds, key=lambda k: (held.get(k, 0), -kinds.index(k)))
        chosen = sorted((best, r["length"], r["texts"], r["open_ends"], round(r["open_ends"] / r["told"], 6)) for r in kept if r["encoding"] == best)
        limits += chosen
        rest = rest.filter(~F.col(best).isin([x[1] for x in chosen]))
    if not ready:
        drop_materialized(sized)
    return spark.createDataFrame(limits, "encoding string, length bigint, texts bigint, open_ends bigint, share_open double")


def one_each(rows: DataFrame, key: str, *columns: str, order: str | None = None) -> DataFrame:
    """One row for each non-null ``key``: of every column its earliest non-null value by ``order``, else its least."""
    if order:
        aggs = [F.min_by(c, F.when(F.col(c).isNotNull(), F.struct(F.coalesce(F.col(order), F.timestamp_seconds(F.lit(1e11))), F.xxhash64(c)))).alias(c) for c in columns]
    else:
        aggs = [F.min(c).alias(c) for c in columns]
    return rows.filter(F.col(key).isNotNull()).groupBy(key).agg(*aggs)


def delivered(responses: DataFrame, requests: DataFrame) -> DataFrame:
    """(request_id, text, finish_reason, completion_tokens, prompt, stage, run_id): each response once with its request."""
    resp = one_each(responses, "request_id", "text", "finish_reason", "completion_tokens", order="received_at")
    return resp.join(one_each(requests, "request_id", "prompt", "stage", "run_id"), "request_id", "left")


def ending_of(text: str | None, prompt: str | None) -> tuple[str, str, str, bool]:
    """(state, why, last word, in a list): how a text ends; one that copies its prompt up to the end of a line is no cut sentence."""
    e = endings.ending(text, prompt is not None and "JSON" in prompt)
    if e.state == endings.CUT and e.why == "inside a sentence" and prompt is not None and endings.ends_like(text, prompt):
        return endings.WHOLE, "end of a line of the prompt", "", False
    return e[:4]


def read_endings(pairs: DataFrame) -> DataFrame:
    """``pairs`` (with text and prompt) and state, why, last_word, in_list: how each text ends, by the pushdown parser; and its length under each encoding."""
    added = [("state", "string"), ("why", "string"), ("last_word", "string"), ("in_list", "boolean")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = {"string": pa.string(), "boolean": pa.bool_()}
        for batch in batches:
            texts, prompts = batch.column("text").to_pylist(), batch.column("prompt").to_pylist()
            rows = [ending_of(t, p) for t, p in zip(texts, prompts, strict=True)]
            columns = [pa.array([r[i] for r in rows], types[kind]) for i, (_, kind) in enumerate(added)]
            sizes = [None if t is None else text_lengths(t) for t in texts]
            columns += [pa.array([None if x is None else x[i] for x in sizes], pa.int64()) for i in range(len(ENCODINGS))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, *[n for n, _ in added], *ENCODINGS])

    return pairs.mapInArrow(run, ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in pairs.schema), *(f"{n} {k}" for n, k in added), *(f"{k} bigint" for k in ENCODINGS)]))


LETTERS = re.compile(r"[^\W\d_]+")
LAST_LETTERS = re.compile(r"[^\W\d_]+\Z")


def line_ends(text: str) -> list[str]:
    """The words that end a line, but for the last line, without a mark."""
    out = []
    for line in text.split("\n")[:-1]:
        last = line.rsplit(None, 1)[-1:]
        if last and last[0].isalpha():
            out.append(last[0])
        elif last and (m := LAST_LETTERS.search(last[0])):
            out.append(m[0])
    return out


def word_counts(texts: DataFrame, flush: int = 400_000) -> DataFrame:
    """(w, n, e) over all columns of ``texts``: how often each word stands inside a text, and how often it ends a line that is not the last.

    Counts are added up in each task before they are moved; a task holds at most about ``flush`` words at a time and passes on what it has.
    """
    columns = texts.columns

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        inner: Counter[str] = Counter()
        ends: Counter[str] = Counter()

        def take() -> Iterator[pd.DataFrame]:
            ws = list(inner.keys() | ends.keys())
            for i in range(0, len(ws), 20_000):
                part = ws[i : i + 20_000]
                yield pd.DataFrame({"w": part, "n": [inner[w] for w in part], "e": [ends[w] for w in part]})
            inner.clear()
            ends.clear()

        for batch in batches:
            for c in columns:
                for t in batch[c]:
                    if t is not None:
                        inner.update(LETTERS.findall(t)[:-1])
                        ends.update(line_ends(t))
                        if len(inner) > flush:
                            yield from take()
        yield from take()

    return texts.mapInPandas(run, "w string, n bigint, e bigint").groupBy("w").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))


def word_evidence(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(last_word, seen, longer, end_rate, suffix_share): what the corpus says of the ``wanted`` last words.

    ``seen``: times the word stands inside a text, not at its end; ``longer``: times a longer word that begins with it does (looked up for
    beginnings of at most 64 letters); ``end_rate``: the share of its sightings that end a line that is not the last, without a mark,
    against that share of all words, smoothed by two sightings of the usual share; ``suffix_share``: the share of its last three letters
    among capitalised words inside texts. All are counts over all texts; only the wanted words are joined.
    """
    counted = materialize(word_counts(texts))
    known = counted.groupBy(F.lower("w").alias("lw")).agg(F.sum("n").alias("seen"), F.sum("e").alias("line_ends"))
    names = counted.filter(F.col("w").rlike(r"^\p{Lu}\p{Ll}{3,}$")).groupBy(F.expr("right(w, 3)").alias("suffix")).agg(F.sum("n").alias("s"))
    total = F.lit(names.agg(F.sum("s")).first()[0]).cast("double")
    share = names.select("suffix", (F.col("s") / total).alias("suffix_share"))
    asked = wanted.select("last_word").distinct().withColumn("lw", F.lower("last_word")).withColumn("suffix", F.expr("right(last_word, 3)"))
    begins = known.filter(F.length("lw") > 1).select(F.explode(F.expr("transform(sequence(1, least(length(lw) - 1, 64)), i -> left(lw, i))")).alias("lw"), "seen")
    longer = begins.join(asked.select("lw").distinct(), "lw", "left_semi").groupBy("lw").agg(F.sum("seen").alias("longer"))
    sums = counted.agg(F.sum("e"), F.sum("n")).first()
    usual = (sums[0] or 0) / max(1, sums[1] or 0)
    out = asked.join(known, "lw", "left").join(longer, "lw", "left").join(share, "suffix", "left").na.fill(0, ["seen", "longer", "line_ends", "suffix_share"])
    end_rate = (F.col("line_ends") / usual + 2.0) / (F.col("seen") + 2.0) if usual else 2.0 / (F.col("seen") + 2.0)
    return out.select("last_word", "seen", "longer", end_rate.alias("end_rate"), "suffix_share")


def at_limit(limits: list[tuple[str, int]]) -> Column:
    """Whether a row with its lengths stands at one of the limits (encoding, length); stores have few."""
    by: dict[str, list[int]] = defaultdict(list)
    for encoding, length in limits:
        by[encoding].append(length)
    hits = [F.col(k).isin(sorted(v)) for k, v in sorted(by.items())]
    return F.coalesce(reduce(lambda a, b: a | b, hits), F.lit(False)) if hits else F.lit(False)


def read_pairs(responses: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs with their endings, hidden limits over all their texts)."""
    read = materialize(read_endings(spread(delivered(responses, requests))))
    rows = read.filter(F.col("text").isNotNull() & (F.col("state") != endings.EMPTY)).select(*ENCODINGS, F.when(F.col("state") != endings.OPEN, F.col("state") == endings.CUT).alias("unfinished"))
    return read, hidden_limits(rows)


def judged(responses: DataFrame, requests: DataFrame, diagnostic: DataFrame) -> DataFrame:
    """(request_id, prompt, stage, run_id, matrix, text, state, why, cut, evidence, finish_reason, completion_tokens, budget, terminal_json): one row per response.

    Lengths come first: a text that stands at a hidden limit is cut unless it proves whole (evidence 'limit'). Off the limits the pushdown
    parser decides most texts ('ending'). What ends there without a mark in a list entry or a few words is decided by the corpus ('corpus'):
    cut if its last word is unknown (or a hundred times rarer than the longer words that begin with it) and does not end like a name, if a
    known word ends lines less than a tenth as often as words do, or if the tokens that were spent are far more than the text shows (a count
    that equals a budget is no evidence: it is often filled in). Rates do not move with the corpus.
    """
    diag = one_each(diagnostic, "request_id", "matrix", "budget", "terminal_json")
    read, limits = read_pairs(responses, requests)
    at = at_limit([(r["encoding"], r["length"]) for r in limits.collect()])
    placed = read.withColumn("at_limit", at & F.col("state").isin(endings.CUT, endings.OPEN))
    undecided = placed.filter((F.col("state") == endings.OPEN) & ~F.col("at_limit"))
    evidence = word_evidence(read.select("text", "prompt"), undecided)
    ratio = read.filter((F.col("state") == endings.WHOLE) & (F.col("completion_tokens") > 0)).agg(F.percentile_approx(F.length("text") / F.col("completion_tokens"), 0.5)).first()[0]
    w = F.col("last_word")
    capital = w.rlike(r"^\p{Lu}")
    known = (F.col("seen") >= 3) & ((F.col("seen") * 100 >= F.col("longer")) | w.rlike(r"^\p{Lu}$"))
    spent = F.col("completion_tokens") * F.lit(float(ratio or CHARS_A_TOKEN))
    cut = (
        ((w != "") & ~w.rlike(r"^\d+$") & ~known & ~(capital & (F.col("suffix_share") >= 0.002)))
        | (F.col("in_list") & known & ~capital & (F.col("end_rate") < 0.1))
        | F.coalesce(F.col("is_budget").isNull() & (spent > F.length("text") * 1.5) & (spent - F.length("text") > 30), F.lit(False))
    )
    budgets = diagnostic.filter("budget > 0").select(F.col("budget").alias("completion_tokens")).distinct().withColumn("is_budget", F.lit(True))
    decided = undecided.join(budgets, "completion_tokens", "left").join(evidence, "last_word", "left").select("request_id", F.coalesce(cut, F.lit(False)).alias("open_cut"))
    out = placed.join(decided, "request_id", "left").join(diag, "request_id", "left")
    evidence_of = F.when(F.col("at_limit"), "limit").when(F.col("state") == endings.CUT, "ending").when(F.col("open_cut"), "corpus")
    return out.withColumn("evidence", evidence_of).select(
        "request_id", "prompt", "stage", "run_id", "matrix", "text", "state", "why", F.col("evidence").isNotNull().alias("cut"), "evidence", "finish_reason", "completion_tokens", "budget", "terminal_json"
    )


def truncated(responses: DataFrame, requests: DataFrame, diagnostic: DataFrame) -> DataFrame:
    """(request_id): responses that stop before their end."""
    return judged(responses, requests, diagnostic).filter("cut").select("request_id")


def truncation_rates(rows: DataFrame) -> DataFrame:
    """(source, stage, responses, cut, rate, by_limit, says_length, at_budget, not_terminal): per matrix (run_id where it is missing) and stage."""
    source = F.coalesce("matrix", "run_id", F.lit("(none)"))
    return rows.groupBy(source.alias("source"), F.coalesce("stage", F.lit("(none)")).alias("stage")).agg(
        F.count("*").alias("responses"), F.count_if("cut").alias("cut"), F.round(F.count_if("cut") / F.count("*"), 6).alias("rate"), F.count_if(F.col("evidence") == "limit").alias("by_limit"),
        F.count_if(F.col("finish_reason") == "length").alias("says_length"), F.count_if(F.col("completion_tokens") >= F.col("budget")).alias("at_budget"),
        F.count_if(~F.col("terminal_json")).alias("not_terminal"),
    )
