"""How a text ends: a pushdown parser over fences, tags, brackets and strings, and the reading of the last line."""

from __future__ import annotations

import re
from typing import NamedTuple

#: What a text can be. OPEN texts need the corpus to decide: their last word or line may be whole or cut.
EMPTY, WHOLE, CUT, OPEN = "empty", "whole", "cut", "open"

#: Marks that storage or transport sets after a cut (fixed values).
SOFT_MARK = re.compile(
    r"(?:\s*(?:…|\.{3,}|\[(?:\.{2,}|…)\]|\((?:\.{2,}|…)\)|<(?:\.{2,}|…)>"
    r"|[\[(<](?:truncated|shortened|cut(?: off)?|continued|more|gekürzt|abgeschnitten|tronqué|coupé|cortado|truncado|snip|output limit[^\])>]{0,40}|max(?:imum)? (?:length|tokens)[^\])>]{0,40})[\])>]))+\s*$",
    re.I,
)
HARD_MARK = re.compile(r"(?:�+|\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|(?<!\\)\\|&(?:#\d{0,6}|#x[0-9a-f]{0,5}|[a-z]{1,8})?)$")
TERMINAL = re.compile(r"[.!?。！？][\"'”’»)\]*_`]*$|[;:]?-?\)$")
LIST_LINE = re.compile(r"^\s*(?:[-*•+]\s+|\(?(?:[A-Za-z]|\d{1,2})[).:]\s+|\|)")
NO_CONTENT = re.compile(r"^[\W_]*(?:\b(?:null|none|nan|nil|undefined|n/?a|json)\b[\W_]*)*$", re.I)
TAGGED = re.compile(r"<(think|thinking|reasoning|scratchpad)>(.*?)</\1>", re.S | re.I)
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?|\d+")


class Ending(NamedTuple):
    state: str
    why: str
    last_word: str  # of an OPEN text: its last word, as written
    in_list: bool  # of an OPEN text: its last line is a list entry like others
    loop: bool  # the text repeats itself up to its end


def answer_part(text: str) -> str:
    """The text without closed reasoning tags."""
    return TAGGED.sub("", text)


def bare(text: str) -> str:
    """What a reader sees: without characters of no width and outer blanks."""
    return re.sub("[­​-‍⁠﻿]", "", text).strip()


def loops(text: str, least: int = 3) -> bool:
    """Whether the end of ``text`` is a passage of at least 8 characters given ``least`` times or more in a row, the last time perhaps in part."""
    n = len(text)
    if n < 32:
        return False
    tail = text[-12:]
    at = text.rfind(tail, 0, n - 1)
    while at > 0 and n - (at + 12) < n // 2:
        period = n - (at + 12)
        if period >= 8:
            i = n - 1
            while i - period >= 0 and text[i] == text[i - period]:
                i -= 1
            if n - 1 - i >= period * (least - 1):
                return True
        at = text.rfind(tail, 0, at + 11)
    return False


#: All that can open or close something.
TOKEN = re.compile(r"```|</?(?:think|thinking|reasoning|scratchpad)>|[{}\[\]()\"\\]", re.I)
BLANK = re.compile(r"\s*")


def _stack(text: str) -> list[str]:
    """What stands open at the end: fence, tag, or the brackets and strings of JSON and code. Brackets of prose do not count."""
    stack: list[str] = []
    code = False  # within a fence that holds code or data
    skip = -1
    for m in TOKEN.finditer(text):
        i, c = m.start(), m[0]
        if i < skip:
            continue
        top = stack[-1] if stack else ""
        if c == "```" and (top != '"' or "fence" in stack):
            if "fence" in stack:
                del stack[stack.index("fence") :]
                code = False
            else:
                stack = [s for s in stack if s == "tag"] + ["fence"]
                code = not _prose_fence(text, i)
        elif top == '"':
            if c == "\\":
                skip = i + 2
            elif c == top:
                stack.pop()
        elif c[0] == "<":
            if c[1] == "/":
                while stack and stack.pop() != "tag":
                    pass
            else:
                stack.append("tag")
        elif c in "{[":
            if stack and top not in ("tag", "fence") or code or _opens_data(text, i):
                stack.append("}" if c == "{" else "]")
        elif c in "}])":
            if top == c:
                stack.pop()
        elif c == "(":
            if code:
                stack.append(")")
        elif c == '"' and (top in ("}", "]", ")") or code):
            stack.append('"')
    return stack


def _prose_fence(text: str, at: int) -> bool:
    return text[at + 3 : at + 11].lower().startswith(("text", "markdown", "md"))


def _opens_data(text: str, i: int) -> bool:
    """Whether a bracket outside of data begins JSON: an object with a quoted key, or an array of objects or strings, or the text ends there."""
    j = BLANK.match(text, i + 1).end()
    after = text[j : j + 1]
    if not after:
        return True
    if text[i] == "{":
        return after in '"}'
    return after in '{"' or after == "[" and BLANK.match(text, j + 1).end() < len(text)


def _mark_at_end(pattern: re.Pattern[str], text: str) -> int:
    """Where the marks at the very end of ``text`` begin, or -1; they are sought in a tail that grows while they fill it."""
    size = 400
    while True:
        tail = text[-size:]
        m = pattern.search(tail)
        if m is None:
            return -1
        if m.start() > 0 or size >= len(text):
            return len(text) - len(tail) + m.start()
        size *= 4


def ending(text: str | None, wants_json: bool = False) -> Ending:
    """Reads the end of ``text``. ``wants_json``: the prompt asks for a closing JSON object."""
    if text is None or NO_CONTENT.match(seen := bare(answer_part(text))) and not (set("{[`<") & set(seen) and _stack(text)) and _mark_at_end(HARD_MARK, seen) < 0:
        return Ending(EMPTY, "no content", "", False, False)
    loop = loops(seen)
    if _mark_at_end(HARD_MARK, seen) >= 0:
        return Ending(CUT, "broken character or escape", "", False, loop)
    if _mark_at_end(SOFT_MARK, seen) > 0:
        return Ending(CUT, "mark of a cut", "", False, loop)
    if loop and not re.search(r"[}\]`]$", seen):
        return Ending(CUT, "repetition", "", False, True)
    stack = _stack(text)
    if stack:
        what = "fence" if "fence" in stack else "tag" if "tag" in stack and set(stack) == {"tag"} else "data"
        return Ending(CUT, f"open {what}", "", False, loop)
    if seen[-1] in "}]`" or seen.endswith("</answer>"):
        return Ending(WHOLE, "closed data", "", False, loop)
    lines = [x for x in seen.split("\n") if x.strip()]
    last = lines[-1].strip()
    if TERMINAL.search(last):
        return Ending(WHOLE, "end of a sentence", "", False, loop)
    if len(lines) > 1 and last in "-*•+":
        return Ending(CUT, "list entry without text", "", True, loop)
    found = WORD.findall(last)
    word = found[-1] if found else ""
    if not found or re.fullmatch(r"[-+]?\d+(?:[.,]\d+)?\s*%?", last) or re.fullmatch(r"\(?[A-Za-z]\)?", last):
        return Ending(WHOLE if len(lines) == 1 else OPEN, "a value", word, len(lines) > 1 and bool(LIST_LINE.match(last)), loop)
    dangling = re.search(r"[,;:(“«„]$|[^\W\d_]-$", last) or last[-1] == '"' and seen.count('"') % 2
    if LIST_LINE.match(last):
        return Ending(CUT if dangling else OPEN, "list entry", word, True, loop)
    sentence = re.split(r"(?<=[.!?:])\s+", last)[-1]
    if dangling or len(WORD.findall(sentence)) >= 4 or sentence != last or len(lines) > 1 and not TERMINAL.search(lines[-2]) is None and len(found) > 2:
        return Ending(CUT, "inside a sentence", word, False, loop)
    return Ending(CUT if wants_json else OPEN, "a few words", word, False, loop)


def ends_like(text: str, prompt: str, words: int = 4, share: float = 0.85) -> bool:
    """Whether ``text`` gives the prompt back up to the end of one of its lines: its last words end that line, and its words are those of the prompt."""
    mine = [w.lower() for w in WORD.findall(text)]
    tail = mine[-words:]
    if len(tail) < words or all([w.lower() for w in WORD.findall(line)][-words:] != tail for line in prompt.split("\n")):
        return False
    there = {w.lower() for w in WORD.findall(prompt)}
    return sum(w in there for w in mine) >= share * len(mine)
