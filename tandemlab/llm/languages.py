"""Languages of prose: the Unicode script of its letters, and profiles of character trigrams learned from labelled rows."""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters that a profile tells apart, besides all others and blanks.
LETTERS = "abcdefghijklmnopqrstuvwxyzàâäæçèéêëîïñòóôöœùûüßáíúì'¿¡"
SIZE = 64
#: Scripts that are written together (fixed values).
TOGETHER = {"HIRAGANA": "CJK", "KATAKANA": "CJK", "BOPOMOFO": "CJK"}


#: Characters that are neither Latin nor marks that go with any script.
BEYOND = re.compile("[^\x00-\u02af\u1e00-\u1eff\u2000-\u206f\u20a0-\u20cf]")
LETTER = re.compile(r"[^\W\d_]")


@lru_cache(maxsize=65_536)
def script(letter: str) -> str:
    """The script of a letter, by the first word of its Unicode name."""
    name = unicodedata.name(letter, "").split(" ")[0].split("-")[0]
    return TOGETHER.get(name, name)


def main_script(text: str, share: float = 0.6) -> str | None:
    """The script of at least ``share`` of the letters, None where there are none or they are mixed."""
    if BEYOND.search(text) is None:
        return "LATIN" if LETTER.search(text) else None
    counts = Counter("LATIN" if c < "\x80" else script(c) for c in unicodedata.normalize("NFKC", text) if c.isalpha())
    if not counts:
        return None
    best, n = counts.most_common(1)[0]
    return best if n >= share * counts.total() else None


# Languages by script, as prompts name them.
SCRIPT_WORDS = {
    "CYRILLIC": ("russian", "ukrainian", "bulgarian", "russisch", "russe", "ruso"), "GREEK": ("greek", "griechisch", "grec", "griego"), "ARABIC": ("arabic", "persian", "urdu", "arabisch", "arabe", "árabe"),
    "HEBREW": ("hebrew", "hebräisch", "hébreu", "hebreo"), "CJK": ("chinese", "japanese", "chinesisch", "japanisch", "chinois", "japonais", "chino", "japonés"), "HANGUL": ("korean", "koreanisch", "coréen", "coreano"),
    "DEVANAGARI": ("hindi", "marathi", "nepali"), "THAI": ("thai", "thaï", "tailandés"), "LATIN": ("english", "german", "french", "spanish", "englisch", "deutsch", "anglais", "inglés"),
}


def script_names(prompt: str) -> set[str]:
    """The scripts of the languages that a prompt names."""
    low = prompt.lower()
    return {k for k, ws in SCRIPT_WORDS.items() if any(w in low for w in ws)}


_CODES = np.full(0x3000, 1, dtype=np.int32)
for _i, _c in enumerate(LETTERS):
    for _x in {_c, _c.upper()}:
        if len(_x) == 1:
            _CODES[ord(_x)] = _i + 2
for _c in " \t\r\n.,;:!?()[]{}\"<>|/\\*_`#~=+-0123456789":
    _CODES[ord(_c)] = 0


def _trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(trigram numbers of all texts in a row, where each text begins); texts in NFKC, blanks in a row as one, digits and marks as blanks."""
    texts = [t if t.isascii() else unicodedata.normalize("NFKC", t) for t in texts]
    joined = "".join(f" {t}  " for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.where(points < _CODES.size, _CODES[np.minimum(points, _CODES.size - 1)], 1)
    sizes = np.fromiter((len(t) + 3 for t in texts), dtype=np.int64, count=len(texts))
    owner = np.repeat(np.arange(len(texts)), sizes)
    keep = np.ones(codes.size, dtype=bool)
    keep[1:] = (codes[1:] != 0) | (codes[:-1] != 0) | (owner[1:] != owner[:-1])
    codes, owner = codes[keep], owner[keep]
    grams = (codes[:-2] * SIZE + codes[1:-1]) * SIZE + codes[2:]
    same = owner[:-2] == owner[2:]
    return grams[same], owner[:-2][same]


class Profiles:
    """Log likelihoods of trigrams by language."""

    def __init__(self, names: list[str], table: np.ndarray) -> None:
        self.names, self.table = names, table

    @classmethod
    def fit(cls, rows: list[tuple[str, str]], smooth: float = 0.5) -> Profiles:
        """From (language, text) rows, in any order."""
        names = sorted({r[0] for r in rows})
        table = np.zeros((SIZE**3, len(names)), dtype=np.float32)
        for j, name in enumerate(names):
            grams, _ = _trigrams([t for lang, t in rows if lang == name])
            counts = np.bincount(grams, minlength=SIZE**3) + smooth
            table[:, j] = np.log(counts / counts.sum())
        return cls(names, table)

    def tell(self, texts: list[str], least: float = 8.0) -> list[str | None]:
        """The language of each text; None where the best is not ``least`` nats more likely than the second."""
        if len(self.names) < 2 or not texts:
            return [None] * len(texts)
        grams, owner = _trigrams(texts)
        score = np.stack([np.bincount(owner, weights=self.table[grams, j], minlength=len(texts)) for j in range(len(self.names))], axis=1)
        order = np.argsort(score, axis=1)
        rows = np.arange(len(texts))
        sure = score[rows, order[:, -1]] - score[rows, order[:, -2]] >= least
        return [self.names[k] if ok else None for k, ok in zip(order[:, -1], sure, strict=True)]


def learn(items: DataFrame, known: dict[str, list[str]], per_language: int = 2_000, max_chars: int = 4_000) -> Profiles:
    """Profiles from the ``known`` words of languages and from items whose metadata name one: of each at most about ``per_language`` questions
    of up to ``max_chars`` characters, by the hash of the item.

    Both bounds are of the sample that profiles are fitted on; every text is judged in whole.
    """
    lang = F.lower(F.trim(F.get_json_object("metadata", "$.lang")))
    rows = items.filter(F.col("item_id").isNotNull() & F.col("question").isNotNull() & (F.length("question") <= max_chars)).select("item_id", "question", lang.alias("lang")).filter(lang.isin(*known))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # one row per language
    sample = [(k, " ".join(v)) for k, v in known.items()]
    if counts:
        parts = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, max(1, -(-n // per_language)))])
        chosen = rows.filter(F.pmod(F.xxhash64("item_id", F.lit(6)), parts[F.col("lang")]) == 0).groupBy("lang", "question").agg(F.min("item_id").alias("i")).collect()
        sample += [(r["lang"], r["question"]) for r in sorted(chosen, key=lambda r: r["i"])]
    return Profiles.fit(sample)
