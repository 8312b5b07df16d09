"""Problem 6: broken prompt and response pairs.

One defect a request, the first that holds: empty, truncated, copy, refusal, language. Defined results: a response delivered several times
is read once; a response without a request, or with a null prompt, can only be empty, truncated or a refusal; prose too short to tell its
language (fewer than three words that do not begin with a capital, or a small lead of one language) is no case; an empty table gives an
empty result; other columns are never read. Whole texts are parsed.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemlab.llm import endings, languages, truncation
from tandemlab.sources.tables import materialize, spread

# The phrases of refusals by language. speaker: who speaks; unable: inability or unwillingness; act: what is not done;
# decline: speaker and refusal in one; unfit, beyond, conflict: why; own: the speaker's rules; forbid: what rules do.
PHRASES = {
    "en": {
        "speaker": ["I", "I'm", "I am", "I've", "I have", "I'd", "I would", "I'll", "I will"],
        "unable": [
            "can't", "cannot", "can not", "won't", "will not", "may not", "must not", "could not", "couldn't", "not able", "unable", "not allowed", "not permitted", "not willing", "not comfortable", "not going",
            "do not", "don't", "rather not", "prefer not", "decline", "refuse", "have to pass", "have to decline", "have to refuse", "must pass", "must decline", "must refuse", "need to decline",
        ],
        "act": [
            "help", "assist", "answer", "respond", "reply", "comply", "provide", "discuss", "take part", "participate", "pick", "choose", "share", "solve", "complete", "engage", "support", "continue", "do that", "do this", "do so",
            "offer", "give", "say", "pass on", "request", "question", "item", "exam", "this",
        ],
        "decline": ["I decline", "I refuse", "I pass on", "I must decline", "I must refuse", "I must pass on", "I have to decline", "I have to refuse", "I have to pass on", "I need to decline", "I need to refuse", "I need to pass on"],
        "unfit": ["inappropriate for me", "unsafe for me", "unethical for me", "not appropriate for me", "against my rules for me", "against my policy for me", "against my policies for me", "against my guidelines for me"],
        "for me": ["for me to respond", "for me to answer", "for me to help"],
        "wrong": ["inappropriate", "unsafe", "wrong"],
        "thing": ["this", "that", "it", "the request", "your request", "the question"],
        "beyond": ["outside", "beyond", "against", "violate", "violates", "out of"],
        "own": ["my rules", "my policy", "my policies", "my guidelines", "my scope", "my remit", "my instructions", "my principles", "my programming", "my terms", "my limits"],
        "not mine": [f"something I {m} {v}" for m in ("do not", "don't", "can't", "cannot", "won't") for v in ("assist", "help", "do", "answer")],
        "conflict": [
            "break", "breaks", "breach", "breaches", "violate", "violates", "infringe", "infringes", "contravene", "contravenes", "contradict", "contradicts", "conflict with", "conflicts with", "go against", "goes against", "run against",
            "runs against", "against", "contrary to", "not allowed by", "forbidden by", "prohibited by",
        ],
        "forbid": ["forbid", "prevent", "prohibit", "do not allow", "don't allow", "do not permit", "rule out", "keep me from"],
    },
    "fr": {
        "speaker": ["je ne", "je n'"],
        "unable": [r"(?:\w+ ){0,3}?(?:peux|puis|pourrai|dois|souhaite|veux|suis|donne|réponds|participe|traite|fournis)"],
        "nothing": ["pas", "rien", "aucun", "aucune"],
        "decline": ["je préfère ne", "je préfère n'", "je préférerais ne", "je préférerais n'", "je refuse", "je décline", "je dois refuser", "je dois décliner", "il ne m'est pas possible", "il m'est impossible", "il m'est interdit"],
        "thing": ["demande", "question", "requête"],
        "beyond": ["sort", "dépasse", "contraire", "hors"],
        "own": ["mes règles", "mes consignes", "mes principes", "mes limites", "mes directives"],
        "conflict": [r"enfrein\w*", r"viol\w*", r"contraire\w*", r"contrevien\w*", "contre", r"interdi\w*"],
        "forbid": ["interdisent", "empêchent", "ne permettent"],
    },
    "de": {
        "speaker": ["ich darf", "ich kann", "ich möchte", "ich will", "ich werde", "ich könnte", "ich soll", "ich mag"],
        "turned": ["kann ich", "darf ich", "möchte ich", "will ich", "werde ich", "gebe ich", "mache ich", "beantworte ich"],
        "nothing": ["nicht", "nichts", r"keine?n?"],
        "opens": ["ich lehne", "ich muss", "ich bin", "ich gebe", "ich beantworte", "ich verzichte", "ich nehme"],
        "closes": ["ab", "ablehnen", "passen", "nicht in der lage", "außerstande", "keine", "nicht", "darauf"],
        "thing": ["anfrage", "frage", "bitte"],
        "beyond": ["außerhalb", "gegen", "verstößt"],
        "mine": [r"meine[rn]?"],
        "own": [r"meine[nr]? regeln", r"meine[nr]? richtlinien", r"meine[nr]? vorgaben", r"meine[nr]? grundsätze", r"meine[nr]? grenzen"],
        "conflict": ["gegen", r"widers\w+", r"verstö\w+", r"verletz\w+", "außerhalb"],
        "forbid": ["verbieten", "erlauben", "lassen", "untersagen"],
    },
    "es": {
        "decline": [
            "no puedo", "no debo", "no quiero", "no podré", "no podría", "no voy a", "no deseo", "no me es posible", "no me está permitido", "no me corresponde", "no estoy en condiciones", "no soy capaz", "no doy", "no respondo", "no participo",
            "prefiero no", "preferiría no", "me niego", "debo rechazar", "debo declinar", "debo negarme", "tengo que rechazar", "tengo que declinar", "tengo que negarme",
        ],
        "thing": ["petición", "pregunta", "solicitud"],
        "lies": ["queda", "está", "va"],
        "beyond": ["fuera", "contra"],
        "own": ["mis normas", "mis reglas", "mis límites", "mis principios", "mis directrices"],
        "conflict": ["contra", r"incumpl\w+", r"viol\w+", r"infring\w+", r"contrari\w+", r"romper\w*", "fuera de"],
        "forbid": ["prohíben", "impiden", "no permiten", "no me permiten"],
    },
}
#: The grammar: a refusal is one of these sequences within a sentence; a number is the most characters that may stand between two parts.
PRODUCTIONS = {
    "en": [("speaker", 24, "unable", 40, "act"), ("decline",), ("unfit",), ("for me", 20, "wrong"), ("thing", 30, "beyond", 12, "own"), ("not mine",), ("conflict", 16, "own"), ("own", 24, "forbid")],
    "fr": [("speaker", 1, "unable", 12, "nothing"), ("decline",), ("thing", 20, "beyond", 12, "own"), ("conflict", 16, "own"), ("own", 20, "forbid")],
    "de": [("speaker", 40, "nothing"), ("turned", 30, "nothing"), ("opens", 40, "closes"), ("thing", 30, "beyond", 12, "mine"), ("conflict", 16, "own"), ("own", 20, "forbid")],
    "es": [("decline",), ("thing", 20, "lies", 16, "beyond", 12, "own"), ("conflict", 12, "own"), ("own", 16, "forbid")],
}


def _production(lang: str, parts: tuple[str | int, ...]) -> str:
    word = lambda name: r"\b(?:" + "|".join(p + ("" if p.endswith("'") else r"\b") for p in PHRASES[lang][name]) + ")"
    return "".join(rf"[^.!?\n]{{0,{p}}}?" if isinstance(p, int) else word(p) for p in parts)


REFUSAL = re.compile("|".join(_production(lang, parts) for lang, rules in PRODUCTIONS.items() for parts in rules), re.I)
#: Without one of these words no production holds.
CUE = re.compile(r"\b(?:I|my|me|je|mes|il|ich|meine[nr]?|no|mis|prefiero|preferiría|debo|tengo)\b", re.I)

# Frequent words by language; what profiles know where no labelled row is at hand.
FREQUENT = {
    "en": "the of and that which with but than from this whenever because although before after unless is are was were be it its they them those only near each every no not as at in on by for how what why while once until since when would could should their there you your my we our has have had an if then so".split(),
    "de": "der die das und ist nicht ein eine einen einem einer den dem des mit von zu auf für im bei nach wird bleibt sich auch nur jene denen ohne sie wie warum weil während nachdem sobald obwohl bevor wenn dann dabei laut genau weder noch ich daher lautet also damit zuerst danach es er wir ihr sind war haben hat kann aus am zum zur über oder aber wurde werden dies diese dieser".split(),
    "fr": "le la les des du et est un une dans pour que qui ne pas sur avec mais sans chez puis alors tandis dès reste après avant selon pendant même car ni seulement ceux où sont je il elle nous vous ce cette ces au aux par plus combien pourquoi comment parce puisque quand entre leur donc ainsi devient semble jamais toujours d'abord l'on".split(),
    "es": "el los las y es un una en por que no se con pero sin del al lo como más su sus tras según hasta pues cuando aunque mientras porque ya entonces sigue queda parece solo solamente aquellos donde luego primero cuánto cuántas por qué siempre nunca veces ellas ellos yo este esta esto ese muy entre así elijo hay son está ni".split(),
}
#: Names of the languages in the four languages (fixed values).
NAMES = {
    "en": "english|englisch|englischer|anglais|inglés|ingles", "de": "german|deutsch|deutscher|allemand|alemán|aleman",
    "fr": "french|französisch|französischer|français|francais|francés|frances", "es": "spanish|spanisch|spanischer|espagnol|español|espanol",
}
ASKED = {lang: re.compile(rf"\b(?:{names})\b", re.I) for lang, names in NAMES.items()}
# Lines that frame a question within a prompt; others are learned.
FRAMES = frozenset(f"{w}{gap}:" for w in ("question", "frage", "pregunta", "proposed answer", "vorschlag", "réponse proposée", "respuesta propuesta", "criterion", "kriterium", "critère", "criterio") for gap in ("", " "))
WORD = re.compile(r"[^\W_]+(?:'[^\W_]+)?")
CODE = re.compile(r"```.*?(?:```|$)|`[^`\n]*`", re.S)
BRACKET = re.compile(r"[{}\[\]]")
LOWER = re.compile(r"(?<![^\W\d_])[a-zà-öø-ÿ][^\W\d_]*")


def learn_frames(requests: DataFrame, share: float = 0.002, items: int = 60, max_chars: int = 200) -> frozenset[str]:
    """Lines that frame questions: in lower case, those of at most ``max_chars`` that stand in at least ``share`` of all prompts and with many items.

    Items are counted by the hash buckets (64) they fall into, of which ``items`` must be hit, so one item with many requests makes no frame.
    Every prompt counts; at most lines a prompt / ``share`` lines meet the driver.
    """
    schema = "line string, n bigint, buckets bigint"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: dict[str, int] = defaultdict(int)
        buckets: dict[str, int] = defaultdict(int)

        def take() -> Iterator[pd.DataFrame]:
            keys = list(n)
            for i in range(0, len(keys), 20_000):
                part = keys[i : i + 20_000]
                yield pd.DataFrame({"line": part, "n": [n[k] for k in part], "buckets": [buckets[k] - (1 << 64) if buckets[k] >> 63 else buckets[k] for k in part]})
            n.clear()
            buckets.clear()

        for pdf in batches:
            for prompt, bucket in zip(pdf["prompt"], pdf["bucket"], strict=True):
                for line in {x.strip().lower() for x in prompt.split("\n") if len(x) <= max_chars}:
                    if line:
                        n[line] += 1
                        buckets[line] |= 1 << bucket
                if len(n) > 200_000:
                    yield from take()
        yield from take()

    rows = requests.filter(F.col("prompt").isNotNull())
    total = rows.count()
    spread_rows = spread(rows.select("prompt", F.pmod(F.xxhash64("dataset_item_id"), F.lit(64)).cast("int").alias("bucket")))
    per = spread_rows.mapInPandas(run, schema).groupBy("line").agg(F.sum("n").alias("n"), F.bit_or("buckets").alias("b"))
    got = per.filter((F.col("n") >= share * total) & (F.bit_count("b") >= items)).select("line").collect()
    return FRAMES | {r[0] for r in got}


def question_of(prompt: str, frames: frozenset[str] = FRAMES) -> str:
    """The question within a prompt: its first lines that are no frame, up to the next frame."""
    out: list[str] = []
    for line in prompt.split("\n"):
        if line.strip().lower() in frames or "JSON" in line:
            if any(x.strip() for x in out):
                break
            out = []
        else:
            out.append(line)
    return "\n".join(out).strip()


def without_data(text: str, keep: str = "") -> str:
    """``text`` with every balanced bracketed span replaced by a blank, but for spans that stand in ``keep``; one pass, whatever the nesting."""
    stack: list[int] = []
    spans: list[tuple[int, int]] = []
    for m in BRACKET.finditer(text):
        i, c = m.start(), m[0]
        if c in "{[":
            stack.append(i)
        elif stack:
            begin = stack.pop()
            while spans and spans[-1][0] > begin:
                spans.pop()
            spans.append((begin, i + 1))
    out, at = [], 0
    for begin, end in spans:
        if not (keep and text[begin:end] in keep):
            out += [text[at:begin], " "]
            at = end
    return "".join([*out, text[at:]])


def prose_of(text: str) -> str:
    """A response's text without reasoning tags, code and data."""
    return without_data(CODE.sub(" ", endings.answer_part(text)))


def answer_values(text: str) -> list[object]:
    """The values of the flat JSON objects of ``text``."""
    out: list[object] = []
    for m in re.finditer(r"\{[^{}]*\}", text):
        try:
            out += json.loads(m[0]).values()
        except (ValueError, AttributeError):
            continue
    return out


class SuffixAutomaton:
    """The suffix automaton of a sequence: the longest match that ends at each place of another, in time linear in both."""

    def __init__(self, source: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.link, self.length, self.end = [-1], [0], [-1]
        last = 0
        for i, w in enumerate(source):
            new = self._state(self.length[last] + 1, i, {})
            p = last
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p < 0:
                self.link[new] = 0
            elif self.length[q := self.next[p][w]] == self.length[p] + 1:
                self.link[new] = q
            else:
                twin = self._state(self.length[p] + 1, self.end[q], dict(self.next[q]))
                self.link[twin] = self.link[q]
                while p >= 0 and self.next[p].get(w) == q:
                    self.next[p][w] = twin
                    p = self.link[p]
                self.link[q] = self.link[new] = twin
            last = new

    def _state(self, length: int, end: int, following: dict[str, int]) -> int:
        self.next.append(following)
        self.link.append(-1)
        self.length.append(length)
        self.end.append(end)
        return len(self.link) - 1

    def matches(self, text: list[str], least: int) -> list[tuple[int, int, int]]:
        """(words, where in text, where in the source) of the matches of ``least`` words or more that cannot be carried on to the right."""
        out, state, n = [], 0, 0
        for i, w in enumerate([*text, None]):
            if w not in self.next[state] and n >= least:
                out.append((n, i - n, self.end[state] - n + 1))
            while state and w not in self.next[state]:
                state = self.link[state]
                n = self.length[state]
            if w in self.next[state]:
                state, n = self.next[state][w], n + 1
            else:
                n = 0
        return out


def tile_cover(text: list[str], source: list[str], least: int = 4) -> tuple[int, int]:
    """Greedy string tiling: how many words of ``text`` and of ``source`` lie in common tiles of ``least`` words or more, longest first, none twice.

    Each round matches what is left of both by a suffix automaton and lays its tiles, longest first; rounds end when none is left.
    """
    text, source = list(text), list(source)
    total = 0
    while True:
        tiles = sorted(SuffixAutomaton(source).matches(text, least), key=lambda x: (-x[0], x[1]))
        laid = 0
        for n, i, j in tiles:
            start = 0
            while start < n:  # what earlier tiles left of this one
                while start < n and (text[i + start] is None or source[j + start] is None):
                    start += 1
                end = start
                while end < n and text[i + end] is not None and source[j + end] is not None:
                    end += 1
                if end - start >= least:
                    text[i + start : i + end] = [None] * (end - start)
                    source[j + start : j + end] = [None] * (end - start)
                    laid += end - start
                start = end + 1
        if not laid:
            return total, total
        total += laid
        text = [w if w is not None else (0, k) for k, w in enumerate(text)]
        source = [w if w is not None else (1, k) for k, w in enumerate(source)]


# The first person, singular, of the four languages.
FIRST = re.compile(r"\b(?:I|I'm|I'd|I'll|my|me|myself|ich|mir|mich|mein\w{0,2}|je|j'\w+|me|moi|mes|mon|ma|yo|mi|mis|mí)\b")
LETTER_LAST = re.compile(r"\b[A-J]\b[\W_]*$")


def is_refusal(text: str, prompt: str = "") -> bool:
    """Whether ``text`` declines: a first-person refusal, and no answer of another kind beside it.

    Where the prompt asks for JSON, prose in the first person that holds neither data, nor a letter at its end, nor an option declines too.
    """
    seen = endings.answer_part(text).replace("’", "'")
    prose = without_data(CODE.sub(" ", seen))
    values = [v for v in answer_values(seen) if not (isinstance(v, str) and REFUSAL.search(v))]
    in_value = any(isinstance(v, str) and REFUSAL.search(v) for v in answer_values(seen))
    if in_value and not values:
        return True
    if values or CODE.search(seen):
        return False
    if CUE.search(prose) and REFUSAL.search(prose):
        return True
    if "JSON" not in prompt or not FIRST.search(prose) or LETTER_LAST.search(seen) or set("{[") & set(seen):
        return False
    options = [o.strip().lower() for o in re.findall(r"^\s*[A-J][).]\s*(.+)$", prompt, re.M)]
    return not any(o and o in seen.lower() for o in options)


def is_copy(text: str, prompt: str, frames: frozenset[str] = FRAMES, own: float = 0.85, stem: float = 0.6) -> bool:
    """Whether ``text`` only gives the prompt or its question back: tiles of it cover ``own`` of the text and ``stem`` of the question's frame.

    Of a text that is nothing but data its strings are the text.
    """
    seen = endings.answer_part(text)
    own_data = [m[0] for m in re.finditer(r"\{[^{}]*\}", seen) if m[0] not in prompt and answer_values(m[0])]
    if own_data:
        if prose_of(seen).strip(" \n\t`\"'.:-"):  # an answer of its own stands beside the data
            return False
        seen = "\n".join(v for data in own_data for v in answer_values(data) if isinstance(v, str))
    words, whole = WORD.findall(seen.lower()), WORD.findall(prompt.lower())
    if len(words) < 5 or own * len(words) > len(whole):  # tiles do not overlap in the prompt, so a longer text cannot be covered
        return False
    there = set(whole)
    if sum(w in there for w in words) < own * len(words):  # words that the prompt lacks are in no tile
        return False
    covered, _ = tile_cover(words, whole, min(4, len(words)))
    if covered < own * len(words):
        return False
    first = re.split(r"\n\s*(?:\(?[A-J][).:]|\d{1,2}[.)]|[-*•])\s", question_of(prompt, frames))[0]
    target = WORD.findall(first.lower()) or whole
    _, held = tile_cover(words, target, min(4, len(target)))
    return held >= stem * len(target)


def asks_for(prompt: str, lang: str) -> bool:
    return lang in ASKED and bool(ASKED[lang].search(prompt))


def speaks(text: str) -> bool:
    """Whether prose is long enough to tell its language."""
    return len(LOWER.findall(text)) >= 3


def other_languages(pairs: list[tuple[str, str, str]], profiles: languages.Profiles) -> list[bool]:
    """Of each (prose, question, prompt): whether the prose is in another script or language than the question, and the prompt does not ask for it."""
    out, told = [False] * len(pairs), []
    for k, (prose, question, prompt) in enumerate(pairs):
        scripts = languages.main_script(prose), languages.main_script(question)
        if None not in scripts and scripts[0] != scripts[1]:
            out[k] = sum(c.isalpha() for c in prose) >= 8 and scripts[0] not in languages.script_names(prompt)
        elif speaks(prose):
            told.append(k)
    got, want = (profiles.tell([pairs[k][i] for k in told]) for i in (0, 1))
    for k, a, b in zip(told, got, want, strict=True):
        out[k] = a is not None and b is not None and a != b and not asks_for(pairs[k][2], a)
    return out


def default_profiles() -> languages.Profiles:
    return languages.Profiles.fit([(k, " ".join(v)) for k, v in FREQUENT.items()])


def early_defect(text: str | None, prompt: str | None, state: str, cut: bool, frames: frozenset[str] = FRAMES) -> str | None:
    """The defect of a pair by its own form, all but its language."""
    if state == endings.EMPTY:
        return "empty"
    if cut:
        values = ()
    else:
        values = answer_values(text)
        if values and all(v is None or isinstance(v, str) and endings.NO_CONTENT.match(endings.bare(v)) for v in values) and not prose_of(text).strip(" \n\t`\"'.:-"):
            return "empty"
        if endings.NO_CONTENT.match(re.sub(r"[{}\[\]`]", "", endings.bare(endings.answer_part(text)))):
            return "empty"
    if cut:
        return "truncated"
    if prompt is not None and is_copy(text, prompt, frames):
        return "copy"
    return "refusal" if is_refusal(text, prompt or "") else None


def defects(rows: Iterable[tuple[str | None, str | None, str, bool]], profiles: languages.Profiles, frames: frozenset[str] = FRAMES) -> list[str | None]:
    """The defect of each (text, prompt, state, cut), or None."""
    rows = list(rows)
    out = [early_defect(*r, frames) for r in rows]
    asked = [(k, prose_of(t), question_of(p, frames), p) for k, ((t, p, _, _), d) in enumerate(zip(rows, out, strict=True)) if d is None and p is not None]
    told = other_languages([x[1:] for x in asked], profiles)
    for (k, *_), other in zip(asked, told, strict=True):
        out[k] = "language" if other else None
    return out


def defect(text: str | None, prompt: str | None, state: str, cut: bool) -> str | None:
    """The defect of one pair by what is known without tables, or None."""
    return defects([(text, prompt, state, cut)], default_profiles())[0]


def find_defects(rows: DataFrame, profiles: languages.Profiles | None = None, frames: frozenset[str] = FRAMES) -> DataFrame:
    """(request_id, stage, defect) of the defective among the rows of truncation.judged; profiles and frames are small tables of bounded size."""
    shared = rows.sparkSession.sparkContext.broadcast((profiles or default_profiles(), frames))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            kinds = defects(zip(pdf["text"], pdf["prompt"], pdf["state"], map(bool, pdf["cut"]), strict=True), *shared.value)
            out = pd.DataFrame({"request_id": pdf["request_id"], "stage": pdf["stage"], "defect": pd.Series(kinds, index=pdf.index, dtype="object")})
            yield out[out["defect"].notna()]

    return spread(materialize(rows.select("request_id", "stage", "prompt", "text", "state", "cut"))).mapInPandas(run, "request_id string, stage string, defect string")


def defect_witnesses(found: DataFrame, outcomes: DataFrame) -> DataFrame:
    """(stage, defect, status, requests): the defects against the parse status of the same request, of which the latest parser's counts."""
    seen = outcomes.filter(F.col("request_id").isNotNull()).groupBy("request_id").agg(F.max_by("status", F.struct("parser_version", "status")).alias("status"))
    return found.join(seen, "request_id", "left").groupBy("stage", "defect", F.coalesce("status", F.lit("(none)")).alias("status")).agg(F.count("*").alias("requests"))
