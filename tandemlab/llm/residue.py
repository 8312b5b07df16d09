"""Problem 9: template residue, filler, error pages, access messages and script notices in the place of content.

A positive-unlabelled naive Bayes model is fitted by expectation-maximization from trusted error and placeholder records, over all passages
of a bounded sample of documents, and every passage of every document is scored in one pass; a record is residue if one of its passages is.
Defined results: null and blank texts are no case; repeated doc_ids are scored together; an empty table gives an empty result; other
columns are never read. Whole texts are read, and no passage is too long to be scored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tandemlab.sources.tables import spread

# Trusted records, one each; what pages show in the place of content, in four languages. The model learns the rest from them.
TRUSTED = (
    "404 Not Found", "Error 404: page not found", "403 Forbidden", "401 Unauthorized", "500 Internal Server Error", "502 Bad Gateway", "503 Service Unavailable", "504 Gateway Timeout", "429 Too Many Requests",
    "The page you requested could not be found", "This page does not exist", "This page is no longer available", "Sorry, something went wrong", "An error occurred while loading the page",
    "An unexpected error occurred, please try again later", "Access denied", "You do not have permission to view this page", "Your account may not view this document", "Please log in to continue", "Please sign in to view this content", "Your session has expired, please sign in again",
    "Too many requests, please try again later", "The server is not responding", "The service is temporarily unavailable", "Connection timed out", "Connection refused", "Rate limit exceeded", "Unexpected token in JSON at position 0",
    "Checking your browser before you continue", "Verify that you are human", "Just a moment, please wait", "Please enable JavaScript to continue", "JavaScript is disabled in your browser", "This site requires JavaScript and cookies",
    "This page does not work without JavaScript", "You need to allow cookies and scripts to view this page", "Loading, please wait",
    "Lorem ipsum dolor sit amet", "Sample text", "Dummy text", "Placeholder text", "This is a placeholder sentence", "This is a dummy paragraph", "Your text here", "Enter your text here", "Content goes here", "Content coming soon",
    "To be added", "Some text", "test test test test test test", "asdf jklq wrtzp qxkj fghjk",
    "Fehler 404: Seite nicht gefunden", "Diese Seite ist nicht verfügbar", "Zugriff verweigert, bitte melden Sie sich an", "Zu viele Anfragen, bitte versuchen Sie es später erneut", "Der Dienst ist zurzeit nicht verfügbar",
    "Bitte aktivieren Sie JavaScript, um fortzufahren", "Diese Seite benötigt JavaScript und Cookies", "Beispieltext", "Platzhaltertext, bitte ersetzen", "Hier steht der Text",
    "Erreur 404 : page introuvable", "Cette page n'est pas disponible", "Accès refusé, veuillez vous connecter", "Trop de demandes, veuillez réessayer plus tard", "Le service est temporairement indisponible",
    "Veuillez activer JavaScript pour continuer", "Cette page nécessite JavaScript et des cookies", "Texte d'exemple", "Texte d'exemple, à remplacer", "Contenu à venir",
    "Error 404: página no encontrada", "Esta página no está disponible", "Acceso denegado, inicie sesión", "Demasiadas solicitudes, inténtelo más tarde", "El servicio no está disponible",
    "Active JavaScript para continuar", "Esta página necesita JavaScript y cookies", "Texto de ejemplo", "Texto de prueba", "Contenido pendiente",
)

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+")
FENCE = re.compile(r"```.*?(?:```|\Z)", re.S)
TICKS = re.compile(r"`[^`\n]+`")
JSON_LINE = re.compile(r'^\s*[\[{]\s*(?:[{"\]}]|$)')
STACK = re.compile(r"at \S+$|at \S*[.(:]")
QUOTED = re.compile(r"^\s*(?:>\s?)+")
TAGS = re.compile(r"</?(?:h[1-6]|p|br|hr|div|b|i|u|em|strong|span|a|ul|ol|li|table|tr|td|th|title|body|html|head|small|center|think|answer|code|pre)\b[^<>\n]{0,120}>", re.I)

_ID = r"[^\W\d][\w.]{0,30}"
_NAME = r"[^\W\d][\w. -]{0,40}?"
# How templates write a slot.
SLOTS = {
    "mustache": rf"\{{\{{\s*{_NAME}\s*\}}\}}", "hash": rf"#\{{\s*{_NAME}\s*\}}", "dollar": rf"\$\{{\s*{_NAME}\s*\}}", "block": rf"\{{%\s*{_NAME}\s*%\}}",
    "erb": rf"<%=?\s*{_NAME}\s*%>", "angles": rf"<<\s*{_NAME}\s*>>", "percent": rf"%\({_ID}\)[sdif]", "squares": rf"\[\[\s*{_NAME}\s*\]\]",
    "dunder": r"__[^\W\d_](?:[^\W_]|_(?!_)){1,40}__", "ats": rf"@@\s*{_ID}\s*@@", "curly": rf"(?<![#${{]){{\s*{_ID}\s*}}(?!}})", "pipe": rf"(?<![|\w])\|{_ID}\|(?![|\w])",
    "tilde": rf"(?<![~\w])~{_ID}~(?!~)", "percents": rf"(?<![%\w])%{_ID}%(?![\w])", "dollars": rf"(?<![$\w])\${_ID}\$(?![\w])", "hashes": rf"(?<![#\w])#{_ID}#(?![\w])",
    "upper": r"\[[A-ZÀ-Þ][A-ZÀ-Þ0-9_]{2,40}\]",
    "insert": r"[\[(<{][^\[\](){}<>\n]{0,40}\b(?:insert|inserted|enter|insérer|insérez|insertar|inserte|einfügen|einsetzen|goes here|go here|missing|placeholder|platzhalter|tbd|todo|to do|fixme|fill in|your [\w.]+ here|votre [\w.]+ ici|su [\w.]+ aquí|ihr[e]? [\w.]+ hier|à compléter|à remplir|por completar|rellenar|auszufüllen|zu ergänzen)\b[^\[\](){}<>\n]{0,50}[\])>}]",
    "tagged": rf"<\s*(?!/)(?:{_ID})\s*>", "xs": r"\bX{4,}\b", "blank": r"_{4,}|\[_+\]",
}
SLOT = re.compile("|".join(f"(?P<{k}>{v})" for k, v in SLOTS.items()), re.I)
UPPER = re.compile(SLOTS["upper"])
EXPLICIT = re.compile(SLOTS["insert"], re.I)
# What introduces an example of a slot.
EXAMPLE = re.compile(r"(?:\b(?:slot|string|placeholder|variable)|\bsuch as|\blike|\bfor example|\be\.g\.|\bthe form|\bnamed|\bcalled|\bwie|\bz\. ?b\.|\bbeispielsweise|\bcomme|\bpar exemple|\bcomo|\bpor ejemplo|\bform|[\"'“„«`(])\s*(?:\S+\s*(?:or|oder|ou|o|,)\s*)?$", re.I)

# Frequent words of filler Latin.
LATIN = frozenset("lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed eiusmod tempor incididunt labore dolore magna aliqua enim minim veniam quis nostrud exercitation ullamco laboris nisi aliquip commodo consequat duis aute irure reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat proident culpa officia deserunt mollit anim laborum vitae dapibus vestibulum curabitur pellentesque mauris donec vivamus".split())

#: A pair says again what its words say, so it counts this much of its log odds.
PAIR = 0.5
#: A passage without any of these holds no slot.
SLOT_SIGN = re.compile(r"[{}\[\]<>%_@~|$#(]|[Xx]{4}")
#: Frequent function words; prose that holds one is no keyboard mash.
COMMON = frozenset("the of and to in is that with for on at by der die das und ist den mit von zu nicht la le les de des et est une un que el los y en por se con pas pour dans du sur".split())


def unwrapped(text: str) -> list[str]:
    """The lines of ``text`` without quote marks; a line that goes on in lower case where the one before it has no end is joined to it."""
    out: list[str] = []
    last = ""
    for raw in re.split(r"[\n\r]", text):
        line = QUOTED.sub("", raw).strip()
        if line and last and line[0].islower() and not STACK.match(line) and last[-1] not in ".!?:;|`}>)]\"'”’»":
            out[-1] += " " + line
        elif line:
            out.append(line)
        last = line
    return out


def passages(text: str) -> list[str]:
    """The lines of prose of ``text``, cut into sentences; code, data rows and table rows are left out."""
    out = []
    for line in unwrapped(FENCE.sub("\n", text)):
        if JSON_LINE.match(line) and '"' in line and not SLOT.fullmatch(line) or line.startswith("|") and line.count("|") >= 3 and not SLOT.search(line):
            continue
        line = TAGS.sub(" ", line)
        for part in re.split(r"(?<=[.!?])\s+|\s+\|\s+", line):
            if part.strip():
                out.append(part.strip())
    return out


def repeats(words: list[str]) -> bool:
    """Whether the words are one unit of up to 5 words given three times or more."""
    n = len(words)
    if n < 6 or len(set(words)) > max(5, n // 3):
        return False
    return any(n >= max(3 * p, 6) and sum(words[i] == words[i - p] for i in range(p, n)) >= 0.95 * (n - p) for p in range(1, 6))


def mashed(words: list[str]) -> bool:
    """Whether most of at least five words cannot be pronounced: no vowel, q without u, or four consonants in a row at their beginning."""
    if len(words) < 5 or not COMMON.isdisjoint(words):
        return False
    odd = sum(bool(re.search(r"q(?!u)|^[^aeiouyäöüéèêáíóúàùâîôûœæ]{4}|^[^\Waeiouyäöüéèêáíóúàùâîôû]{2,}$|[^\Waeiouyäöüéèêáíóúàùâîôû\d]{5}|(?:kj|wq|fj|jf|lf[jk]|dj[ks]|sq|qs|fk|kd[ws]|jq|iw|ww|uj|ue[jd]r)", w)) for w in words)
    return odd >= 0.4 * len(words)


def tokens(part: str) -> list[str]:
    """The words of a passage in lower case; a number is '#', or, of three digits from 400 to 599, '#4' or '#5'."""
    return [w if not w[0].isdigit() else f"#{w[0]}" if len(w) == 3 and w[0] in "45" else "#" for w in WORD.findall(part.lower())]


def shape(words: list[str], before: list[str] | None = None) -> str | None:
    """What a passage without meaning is: filler Latin, a repetition (within itself or of the few words before it) or keyboard mash."""
    if 4 <= sum(w in LATIN for w in words) >= 0.6 * len(words):
        return "=latin"
    if repeats(words) or before == words and 2 <= len(words) <= 4 and not all(w[0] == "#" for w in words):
        return "=repeat"
    return "=mash" if mashed(words) else None


def features(words: list[str], kind: str | None) -> set[str]:
    """The features of a passage without slots: its words and pairs with both edges, or only its shape; the edges of one word count together."""
    if kind:
        return {kind}
    if len(words) == 1:
        return {words[0], f"^ {words[0]} $"}
    return {*words, *(f"{a} {b}" for a, b in zip(["^", *words], [*words, "$"], strict=True))}


def slots_of(part: str) -> tuple[list[str], int] | None:
    """(words beside the slots, label) of a passage that holds a slot, else None.

    Label 1: a slot that stands alone or asks to be filled is trusted residue; -1: one that is introduced as an example is trusted to be none.
    """
    if not SLOT_SIGN.search(part):
        return None
    masked = TICKS.sub(" `code` ", part)
    slots = [m for m in SLOT.finditer(masked) if m.lastgroup not in ("upper", "xs") or (UPPER.fullmatch(m[0]) if m.lastgroup == "upper" else m[0].isupper())]
    slots = [m for m in slots if not (m.lastgroup == "tagged" and m[0].lower() in ("<answer>", "<text>", "<think>"))]
    if not slots:
        return None
    rest = SLOT.sub(" ", masked)
    words = tokens(rest)
    if not words or EXPLICIT.search(masked):
        return words, 1
    return words, -1 if any(EXAMPLE.search(masked[max(0, m.start() - 80) : m.start()]) for m in slots) else 0


def slot_features(words: list[str]) -> set[str]:
    return {*words, *(f"{a} {b}" for a, b in zip(words, words[1:], strict=False))}


@dataclass
class Model:
    """Log odds by feature. ``pairs`` holds pairs of words by their first; what residue never showed counts ``absent``, a slot's ``rare``."""

    words: dict[str, float] = field(default_factory=dict)
    pairs: dict[str, dict[str, float]] = field(default_factory=dict)
    prior: float = -math.inf
    absent: float = 0.0
    slots: dict[str, float] = field(default_factory=dict)
    rare: float = 0.0

    def message(self, words: list[str], kind: str | None) -> float:
        if kind:
            return self.prior + self.words.get(kind, self.absent)
        if not words:
            return -math.inf
        own = set(words)
        get, absent = self.words.get, self.absent
        total = self.prior + sum([get(w, absent) for w in own])
        if len(words) == 1:
            return total + get(f"^ {words[0]} $", 0.0)
        if len(own) < len(words):
            return total + sum(self.pairs.get(a, {}).get(b, 0.0) for a, b in set(zip(["^", *words], [*words, "$"], strict=True)))
        for a, b in zip(["^", *words], [*words, "$"], strict=True):
            if (by := self.pairs.get(a)) is not None:
                total += by.get(b, 0.0)
        return total

    def slot(self, words: list[str], label: int) -> float:
        return 50.0 * label if label else sum(self.slots.get(f, self.rare) for f in slot_features(words))


def _index(rows: Iterable[set[str]]) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
    """(number by feature, features of all rows, row of each)."""
    ids: dict[str, int] = {}
    flat: list[int] = []
    sizes: list[int] = []
    for fs in rows:
        flat += [ids.setdefault(f, len(ids)) for f in sorted(fs)]
        sizes.append(len(fs))
    return ids, np.array(flat, dtype=np.int64), np.repeat(np.arange(len(sizes)), sizes)


def _fit_messages(model: Model, words: list[list[str]], kinds: list[str | None], record: list[int], rounds: int, beta: float) -> None:
    """Classification EM over the passages without slots; the trusted records are rows of it, and so are passages that equal one of them or have a shape.

    A round takes the passages that the last model holds for residue as residue and all others as not; a passage beside residue in its own
    record has the prior of such passages. ``beta`` is the share of the background in residue, so a word that residue never showed counts
    log(beta / (1 + beta)) whatever the size of the sample; a pair of words that it never showed counts nothing.
    """
    own = {tuple(tokens(t)) for t in TRUSTED}
    for j, t in enumerate(TRUSTED):
        words.append(tokens(t))
        kinds.append(shape(words[-1]))
        record.append(-1 - j)
    fixed = np.array([k is not None or tuple(w) in own for w, k in zip(words, kinds, strict=True)])
    ids, flat, owner = _index(features(w, k) for w, k in zip(words, kinds, strict=True))
    n, rows = len(ids), len(words)
    pair = np.array([" " in f for f in ids])
    doc = np.unique(np.array(record), return_inverse=True)[1]
    total = np.bincount(flat, minlength=n)
    share, seen = fixed.astype(float), -1
    for _ in range(rounds):
        p = share.sum()
        q = rows - p
        pos = np.bincount(flat, weights=share[owner], minlength=n)
        ground = total / rows
        weight = np.log((pos / p + beta * ground) / (1 + beta)) - np.log((total - pos + 1e-3 * max(q, 1.0) * ground) / (max(q, 1.0) * 1.001))
        weight[pair] *= np.where(pos[pair] < 1, 0.0, PAIR)
        score = np.bincount(owner, weights=weight[flat], minlength=rows)
        beside = np.bincount(doc, weights=share)[doc] - share > 0.5
        hit = share[beside].sum()
        near = min(0.0, math.log((hit + 1) / (beside.sum() - hit + 1)))
        far = math.log((p - hit + 1) / (max(0.0, (~beside).sum() - (p - hit)) + 1))
        share = np.where(fixed, 1.0, (score + np.where(beside, near, far) > 0).astype(float))
        if share.sum() == seen:
            break
        seen = share.sum()
    for f, k in ids.items():
        if pos[k] > 0 and not (pair[k] and pos[k] < 1):
            a, _, b = f.partition(" ")
            if b and " " not in b:
                model.pairs.setdefault(a, {})[b] = float(weight[k])
            else:
                model.words[f] = float(weight[k])
    model.prior, model.absent = math.log(p / max(q, 1.0)), math.log(beta / (1 + beta))


def _fit_slots(model: Model, rows: list[list[str]], labels: list[int], words: list[list[str]], rounds: int, beta: float = 10.0, clip: float = 3.0, support: int = 3) -> None:
    """EM over sentences with slots. An unfilled slot stands in any sentence, so the words beside it are those of all passages; the other
    class, which speaks of slots, is learned. Features seen in fewer than ``support`` sentences count together, as one that is rarer there.
    """
    count: Counter[str] = Counter()
    for w in words:
        count.update(slot_features(w))
    ids, flat, owner = _index(slot_features(w) for w in rows)
    n, size = len(ids), np.bincount(owner, minlength=len(rows)).astype(float)
    if not n:
        return
    label = np.array(labels)
    ground = np.array([(count[f] + 0.5) / (len(words) + 1) for f in ids])
    known = np.bincount(flat, minlength=n) >= support
    rare = np.bincount(owner, weights=(~known[flat]).astype(float), minlength=len(rows))
    share = np.where(label == 1, 1.0, np.where(label == -1, 0.0, 0.5))
    for _ in range(rounds):
        other = np.bincount(flat, weights=(1 - share)[owner], minlength=n)
        weight = np.clip(np.log(ground) - np.log((other + beta * ground) / ((1 - share).sum() + beta)), -clip, clip)
        often = ((share * rare).sum() + 1) / ((share * size).sum() + 2), (((1 - share) * rare).sum() + 1) / (((1 - share) * size).sum() + 2)
        model.rare = min(clip / 2, max(0.0, math.log(often[0] / often[1])))
        weight[~known] = model.rare
        odds = np.bincount(owner, weights=weight[flat], minlength=len(rows))
        share = np.where(label == 1, 1.0, np.where(label == -1, 0.0, 1 / (1 + np.exp(-np.clip(odds, -50, 50)))))
    model.slots = {f: float(weight[k]) for f, k in ids.items() if known[k]}


def fit(texts: Iterable[tuple[int, str]], rounds: int = 12, beta: float = 0.02) -> Model:
    """The model of a bounded sample of (doc_id, text), in the order of its rows."""
    model = Model()
    words, kinds, record = [], [], []
    slot_rows, slot_labels = [], []
    for i, (_, text) in enumerate(texts):
        before = None
        for part in passages(text):
            if (slot := slots_of(part)) is not None:
                slot_rows.append(slot[0])
                slot_labels.append(slot[1])
                before = None
                continue
            w = tokens(part)
            words.append(w)
            kinds.append(shape(w, before))
            record.append(i)
            before = w
    _fit_slots(model, slot_rows, slot_labels, words, rounds)
    _fit_messages(model, words, kinds, record, rounds, beta)
    return model


def score_text(text: str, model: Model) -> tuple[int, int, float]:
    """(passages, passages that are residue, highest log odds) of a text."""
    n = hits = 0
    best, before = -math.inf, None
    for part in passages(text):
        n += 1
        if (slot := slots_of(part)) is not None:
            odds, before = model.slot(*slot), None
        else:
            w = tokens(part)
            odds = model.message(w, shape(w, before))
            before = w
        hits += odds > 0
        best = max(best, odds)
    return n, hits, best


def sample_of(documents: DataFrame, fit_documents: int, fit_chars: int) -> list[tuple[int, str]]:
    """About ``fit_documents`` documents of ``fit_chars`` characters at most, chosen by the hash of their ids; all where there are fewer.

    Documents longer than a tenth of ``fit_chars`` are left out of the sample, so that it stays bounded.
    """
    rows = documents.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= fit_chars // 10)).select("doc_id", "text")
    n, chars = rows.agg(F.count("*"), F.sum(F.length("text"))).first()
    parts = max(1, -(-n // fit_documents), -(-(chars or 0) // fit_chars))
    return sorted((int(r[0]), r[1]) for r in rows.filter(F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(parts)) == 0).collect())


def residue_scores(documents: DataFrame, fit_documents: int = 12_000, fit_chars: int = 12_000_000) -> DataFrame:
    """(doc_id, passages, residue, log_odds) of every document with a passage; residue > 0 is the record's decision.

    The model is fitted on the driver from a sample that ``fit_documents`` and ``fit_chars`` bound, and its table is broadcast: it holds what
    residue shows, which does not grow with the corpus. All documents are scored, in one pass without a shuffle but for repeated ids.
    """
    model = fit(sample_of(documents, fit_documents, fit_chars))
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            scores = [(i, *score_text(t, shared.value)) for i, t in zip(pdf["doc_id"], pdf["text"], strict=True)]
            out = pd.DataFrame(scores, columns=["doc_id", "passages", "residue", "log_odds"])
            yield out[out["passages"] > 0]

    rows = spread(documents.filter(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text"))
    per = rows.mapInPandas(run, "doc_id bigint, passages bigint, residue bigint, log_odds double")
    return per.groupBy("doc_id").agg(F.sum("passages").alias("passages"), F.sum("residue").alias("residue"), F.max("log_odds").alias("log_odds"))


def residue_documents(documents: DataFrame) -> DataFrame:
    """(doc_id): the documents that hold residue in the place of content."""
    return residue_scores(documents).filter("residue > 0").select("doc_id")


def clean_documents(documents: DataFrame) -> DataFrame:
    """``documents`` without those that hold residue."""
    return documents.join(residue_documents(documents), "doc_id", "left_anti")
