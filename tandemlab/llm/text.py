"""Normal forms of text that the matching operators share."""

from __future__ import annotations

import html
import re
import unicodedata

WORD = re.compile(r"[^\W_]+")
INLINE_TAG = re.compile(r"</?(?:b|i|u|s|em|strong|code|span|a|mark|sub|sup|small|tt|q|font|kbd|del|ins)(?:\s[^<>]{0,200})?/?>", re.I)
TAG = re.compile(r"</?[a-zA-Z][^<>]{0,200}>")
#: Characters without width: soft hyphen, joiners, direction marks, byte order mark.
INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿͏᠎]")
#: The beginning of an option or list entry within flat text: a letter in brackets, a number after the end of a sentence, or a dash.
ENTRY = re.compile(r"(?:^|(?<=\s))(?=\(?[A-Ja-j][):]\s)|(?:^|(?<=[.?!:;]\s))(?=\(?(?:[A-J]|\d{1,2})[).:]\s)|(?:^|(?<=\s))(?=[-•+>]\s)")
LABEL = re.compile(r"^(?:[-•+>]\s+|\(?(?:[A-Ja-j]|\d{1,2})[).:]\s+)+")


def plain(text: str) -> str:
    """``text`` in NFKC, case folded, without entities, markup and characters of no width."""
    if "&" in text:
        text = html.unescape(text)
    if "<" in text:
        text = TAG.sub(" ", INLINE_TAG.sub("", text))
    return unicodedata.normalize("NFKC", INVISIBLE.sub("", text)).casefold()


def words(text: str) -> list[str]:
    """Runs of letters and digits of the normal form."""
    return WORD.findall(plain(text))


def words_at(text: str) -> list[tuple[str, int, int]]:
    """As ``words``, with the place of each word in the original text (start, end)."""
    out, at = [], []
    hidden = [False] * len(text)
    spaced = [False] * len(text)
    for pattern, gap in ((INLINE_TAG, False), (TAG, True)):
        for m in pattern.finditer(text):
            for i in range(*m.span()):
                hidden[i] = True
            spaced[m.start()] = spaced[m.start()] or gap and not INLINE_TAG.fullmatch(m[0])
    i = 0
    while i < len(text):
        if hidden[i]:
            if spaced[i]:
                out.append(" ")
                at.append((i, i + 1))
            i += 1
            continue
        j = i + 1
        if text[i] == "&" and (m := re.compile(r"&#?\w{1,32};").match(text, i)):
            j = m.end()
        k = j
        while k < len(text) and (unicodedata.combining(text[k]) or INVISIBLE.match(text[k])):
            k += 1
            if unicodedata.combining(text[k - 1]):  # a mark joins its letter over characters of no width
                j = k
        for c in unicodedata.normalize("NFKC", INVISIBLE.sub("", html.unescape(text[i:j]))).casefold():
            out.append(c)
            at.append((i, j))
        i = j
    return [(m[0], at[m.start()][0], at[m.end() - 1][1]) for m in WORD.finditer("".join(out))]


def segments(text: str) -> list[list[str]]:
    """The words of the frame and of each option or list entry, without their labels; line breaks and spacing make no difference."""
    flat = " ".join(re.sub(r"[*_`~#|]+", " ", INLINE_TAG.sub("", text)).split())
    return [w for part in ENTRY.split(flat) if (w := words(LABEL.sub("", part)))]
