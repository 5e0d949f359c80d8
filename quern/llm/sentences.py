"""Sentence units of documents in any script, by a finite transducer.

The boundary rules are one table ``(state, class) -> (state, starts a unit)``.
Text is one sequence of character classes; it is cut into chunks, each chunk is
turned into the function that maps the state before it to the state after it, and
these functions are composed by a parallel prefix scan. With the state before
every chunk known, a second sweep over all chunks at once writes the unit starts.

A first sweep chooses the classes: it marks which full stops end nothing (abbreviations,
ordinals, addresses), which blanks divide Thai sentences, which line breaks are
hard wraps, and lines that are no prose as a whole.

A document of many sections, cut at the ends of paragraphs where there are any, is spread over tasks:
each section is classified and becomes one function of the state before it, the functions of a document are composed by a
prefix scan, and with the states known the sections are swept at the same time.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.session import cut_lineage, ship_package, shuffled

# character classes
LOWER, START, SPACE, BREAK, STOP, MARK, CLOSE, OPEN, Q_OPEN, Q_CLOSE, Q_BOTH, PLAIN, GAP, SKIP = range(14)
CLASSES = 14
# states
FRESH, BEGUN, INSIDE, ENDED, SPACED, DONE, SAID, QUOTED, QUOTED_END = range(9)
STATES = 9

CHUNK = 128
#: Characters that are worked on at once; bounds the memory of a task.
SLICE_CHARS = 2_000_000
#: Characters of a section, the part of a document that is judged and worked on as a whole. Layout (hard wraps, small letters,
#: numbered lists) is judged by section; a document of one section is worked on where it is read, others are spread over tasks.
SECTION_CHARS = 262_144
#: Characters on either side of a section that is cut within a line which are looked at, too.
MARGIN = 400

# Abbreviations whose stop ends no sentence, without the stop, in small letters.
ABBREVIATIONS = frozenset(
    """
    mr mrs ms dr prof st fr hr jr no nr fig vol p pp approx jan feb mar apr aug sept oct nov dec bros dept
    vgl abs usw bzw ca evtl ggf str tel inkl z.b d.h u.a m cf chap env av ex p.ex mm mme mlle
    sr sra srta dra pág pag aprox ej p.ej núm ee uu ee.uu ud uds
    рис стр ул др г гг им т.е т.д т.п см руб тыс
    βλ σελ δηλ π.χ κ.λπ κ.ά αρ μ.μ π.μ κ κα
    ص د ق.م م.م ه म डॉ सं कि.मी श्री พ.ศ ค.ศ ดร น.ส
    i.e e.g ff min max resp ed eds vs ph.d b.sc m.sc
    """.split()
)
# Abbreviated titles, which stand before a name and begin with a capital letter.
TITLE_ABBREVIATIONS = frozenset("Adm Brig Capt Cmdr Col Cpl Gen Gov Hon Lt Maj Messrs Mt Pres Rep Rev Sen Sgt Supt".split())
# Abbreviations before a number only.
NUMBER_ABBREVIATIONS = frozenset("art sec ch eq para ref tab abs kap cap lib".split())
# Abbreviations that end a sentence before a capital letter.
SOFT_ABBREVIATIONS = frozenset("p.m a.m ltd inc co corp etc usw μ.μ др г".split())
# Month names that may follow an ordinal number.
MONTHS = frozenset("januar februar märz april mai juni juli august september oktober november dezember".split())
# Words that go on after an ellipsis or a soft abbreviation in text without capitals.
GOING_ON = frozenset("and und et y e и και و или or but aber mais pero но in".split())
# Characters by role.
STOPS = ".!?"
# Marks that no Unicode property has: the ellipsis, and Tibetan shads.
MORE_MARKS = "…།༎༏༐༑༔"
CLOSERS = ")]}）］｝】〉》〕"
OPENERS = "([{（［｛【〈《〔¿¡"
QUOTES_OPEN = "“„«「『‹"
QUOTES_CLOSE = "”»」』›"

LIST_ENTRY = re.compile(r"[ \t]*(?:[-*•‣▪◦–·●○]|\(?(\d{1,3})[.)]|\(?[a-z]\))[ \t ]+\S")
SPOKEN_LINE = re.compile(r"[ \t]*[-–] .*[.!?…,] [-–] ")
FOOTER = re.compile(r"[ \t]*(?:©|\(c\)|Â©)", re.I)
ADDRESS_PART = re.compile(r"www\.|://|@|\.(?:example|test|invalid|com|org|net|html?|php)\b")
# How UTF-8 letters of the scripts begin when read as a one-byte charset.
WRONG_LEADS = ("Ã", "Â", "Ð", "Ñ", "Î", "Ï", "Ø", "Ù", "à¤", "à¥", "à¸", "ã", "ä", "å", "æ", "ç", "è", "é")
WRONGLY_DECODED = re.compile("[Â-ß][\u0080-¿Œ-™�]|[à-ï][\u0080-¿Œ-™�]{2}|[ð-ô][\u0080-¿Œ-™�]{3}")


@cache
def transducer() -> tuple[np.ndarray, np.ndarray]:
    """The compiled rules: next state and start flag, both by ``state * CLASSES + class``."""
    after = np.zeros((STATES, CLASSES), np.uint8)
    start = np.zeros((STATES, CLASSES), np.uint8)

    def rule(states, classes, to, emits=0):
        for s in states if isinstance(states, tuple) else (states,):
            for c in classes if isinstance(classes, tuple) else (classes,):
                after[s, c], start[s, c] = to, emits

    letters = (LOWER, START)
    rule(FRESH, (*letters, PLAIN, CLOSE, Q_CLOSE), INSIDE, 1)
    rule(FRESH, (SPACE, GAP), FRESH)
    rule(FRESH, OPEN, BEGUN, 1)
    rule(FRESH, (Q_OPEN, Q_BOTH), SAID, 1)
    rule(FRESH, STOP, ENDED, 1)
    rule(FRESH, MARK, DONE, 1)
    # a unit that so far has opening brackets only
    rule(BEGUN, (*letters, PLAIN, CLOSE, Q_CLOSE), INSIDE)
    rule(BEGUN, (SPACE, GAP, OPEN), BEGUN)
    rule(BEGUN, (Q_OPEN, Q_BOTH), SAID)
    rule(BEGUN, STOP, ENDED)
    rule(BEGUN, MARK, DONE)
    rule(INSIDE, (*letters, PLAIN, CLOSE, Q_CLOSE, SPACE, OPEN), INSIDE)
    rule(INSIDE, (Q_OPEN, Q_BOTH), QUOTED)
    rule(INSIDE, STOP, ENDED)
    rule(INSIDE, (MARK, GAP), DONE)
    # after a full stop: a capital letter or an opening mark starts a unit
    for state in (ENDED, SPACED):
        rule(state, LOWER, INSIDE)
        rule(state, PLAIN, INSIDE)
        rule(state, START, INSIDE, 1)
        rule(state, OPEN, BEGUN, 1)
        rule(state, Q_OPEN, SAID, 1)
        rule(state, (CLOSE, Q_CLOSE, STOP), state)
        rule(state, MARK, DONE)
        rule(state, SPACE, SPACED)
        rule(state, GAP, DONE)
    rule(ENDED, Q_BOTH, ENDED)
    rule(SPACED, Q_BOTH, SAID, 1)
    # after a mark that always ends
    rule(DONE, letters, INSIDE, 1)
    rule(DONE, PLAIN, INSIDE)
    rule(DONE, OPEN, BEGUN, 1)
    rule(DONE, (Q_OPEN, Q_BOTH), SAID, 1)
    rule(DONE, (SPACE, GAP, CLOSE, Q_CLOSE, STOP, MARK), DONE)
    # a quotation that begins the unit: what follows it is its reporting clause
    for c in range(CLASSES):
        after[SAID, c], after[QUOTED, c], after[QUOTED_END, c] = SAID, QUOTED, QUOTED
    rule(SAID, (Q_CLOSE, Q_BOTH), INSIDE)
    # a quotation after its reporting clause: its last stop ends the unit
    rule(QUOTED, (STOP, MARK), QUOTED_END)
    rule(QUOTED, (Q_CLOSE, Q_BOTH), INSIDE)
    rule(QUOTED_END, (SPACE, CLOSE, STOP, MARK), QUOTED_END)
    rule(QUOTED_END, (Q_CLOSE, Q_BOTH), SPACED)
    for s in range(STATES):
        after[s, BREAK], start[s, BREAK] = FRESH, 0
        after[s, SKIP], start[s, SKIP] = s, 0
    return after.ravel(), start.ravel()


@cache
def marks() -> str:
    """Characters that end a sentence whatever follows: Unicode's sentence terminals of all scripts but ! and ?."""
    planes = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x20000))))
    return "".join(c for c in regex.findall(r"\p{Sentence_Break=STerm}", planes) if c not in STOPS) + MORE_MARKS


@cache
def base_classes() -> np.ndarray:
    """Class of every code point of the basic plane; others count as letters that start."""
    table = np.full(0x10000, PLAIN, np.uint8)
    for cp in range(0x10000):
        kind = unicodedata.category(chr(cp))
        if kind[0] == "L" or kind[0] == "N" or kind[0] == "M":
            table[cp] = LOWER if kind == "Ll" or kind[0] == "M" else START
        elif kind[0] == "Z" or chr(cp).isspace():
            table[cp] = SPACE
        elif kind == "Cf":
            table[cp] = SKIP
    table[0xFFFD] = START
    for chars, kind in ((STOPS, STOP), ("".join(c for c in marks() if ord(c) < 0x10000), MARK), (CLOSERS, CLOSE), (OPENERS, OPEN), (QUOTES_OPEN, Q_OPEN), (QUOTES_CLOSE, Q_CLOSE), ('"＂', Q_BOTH)):
        for ch in chars:
            table[ord(ch)] = kind
    table[ord("…")] = STOP
    table[ord("\n")] = table[ord("\x0b")] = table[ord("\x0c")] = table[0x2028] = table[0x2029] = BREAK
    return table


@cache
def capitals() -> np.ndarray:
    """Which code points of the basic plane are capital letters."""
    return np.array([unicodedata.category(chr(cp)) in ("Lu", "Lt") for cp in range(0x10000)])


def _as_bytes(chars: str) -> bytes | None:
    out = bytearray()
    for ch in chars:
        try:
            out += ch.encode("cp1252")
        except UnicodeEncodeError:
            if ord(ch) > 0xFF:
                return None
            out.append(ord(ch))
    return bytes(out)


def read_wrongly_decoded(text: str) -> tuple[str, np.ndarray]:
    """UTF-8 read as a one-byte charset, put right: the text and, for each of its
    characters, the offset in the text as given. Lost bytes stand for a letter."""
    out: list[str] = []
    at: list[int] = []
    end = 0
    for m in WRONGLY_DECODED.finditer(text):
        chars = m.group()
        if "\ufffd" in chars:
            ch = "а" if chars[0] in "ÑÃ" else "А"
        else:
            raw = _as_bytes(chars)
            try:
                ch = raw.decode("utf-8") if raw else ""
            except UnicodeDecodeError:
                ch = ""
            if len(ch) != 1:
                continue
        out += text[end : m.start()]
        at += range(end, m.start())
        out.append(ch)
        at.append(m.start())
        end = m.end()
    out += text[end:]
    at += range(end, len(text))
    return "".join(out), np.array(at, np.int64)


def _first_word(line: str) -> int:
    at = line.find(" ")
    return len(line) if at < 0 else at


def list_entries(lines: list[str]) -> list[bool]:
    """Which lines are list entries: by a bullet, or by numbers counted from 1.

    A number that doesn't go on from the entry before is part of a sentence, and
    a dash that returns in the line marks speech.
    """
    out = [False] * len(lines)
    expected = 1
    for i, line in enumerate(lines):
        first = line[:1]
        if first.isalpha() and line[1:2] != ")":
            continue
        m = LIST_ENTRY.match(line)
        if not m:
            if first and not first.isalpha():
                expected = 1
            continue
        if m.group(1):
            number = int(m.group(1))
            if number not in (1, expected):
                continue
            expected = number + 1
        elif first in "-–" and SPOKEN_LINE.match(line):
            continue
        out[i] = True
    return out


def wrapped_breaks(lines: list[str], entries: list[bool], small: bool = False) -> set[int]:
    """Indices of lines whose line break is a hard wrap; empty for other pages.

    A page is hard-wrapped if lines that end inside a sentence are as long as
    the next word allowed. A break after which that word would have fitted, with a
    blank to spare, is a real one unless a small letter follows, and so is one
    before a list entry. ``small`` says that small letters mean nothing.
    """
    signs, against, width = 0, 0, 0
    pairs = []
    for i in range(len(lines) - 1):
        a, b = lines[i], lines[i + 1]
        if not a or not b:
            continue
        pairs.append(i)
        n = len(a)
        if n > 90:
            against += 3
        elif n >= 48 and len(b) <= 90 and not entries[i + 1] and a.rstrip()[-1:] not in ENDS_LINE:
            if n <= 80 and n + 1 + _first_word(b) > 68:
                signs += 2 if _goes_on(b) and not small else 1
                width = max(width, n)
            else:
                against += 1
    if signs < 2 or signs < 2 * against:
        return set()
    out = set()
    for i in pairs:
        a, b = lines[i], lines[i + 1]
        if entries[i + 1] or FOOTER.match(b) or FOOTER.match(a):
            continue
        fitted = len(a) + 2 + _first_word(b) <= width
        if not fitted or (not small and len(a) > 40 and _goes_on(b) and a.rstrip()[-1:] not in ENDS_LINE):
            out.add(i)
    return out


def _goes_on(line: str) -> bool:
    return line[0].islower() and not line[1:2].isupper()


THAI_GAP = re.compile("(?<=[ก-๛”»\"])[  ]+(?=[ก-๛“«\"])(?!\\s*(?:พ|ค)\\.ศ\\.)")
THAI_YEAR = re.compile("(?:พ|ค)\\.ศ\\.\\s*\\d+([  ]+)(?=[ก-๛“«\"])")
GREEK_QUESTION = re.compile("(?<=[Ͱ-Ͽἀ-῿])[;;](?=[\\s»”\"]|$)")
SINGLE_OPEN = re.compile(r"(?:(?<=\s)|(?<=^)|(?<=[(（:]))['‘](?=[\w¿¡])", re.M)
SINGLE_CLOSE = re.compile(r"(?<=[.!?。！？])['’](?!\w)")
SPEECH_DASH = re.compile(r"(?<=[.!?…»\"”][ \n\u00a0])[—–-](?=[ \u00a0]([^\W\d_]))")
KANA_ON = re.compile("[。！？][」』]?(?=[のをと])")
ENDS_LINE = ".!?。！？»”\"؟।:"
BEFORE_WORD = "([{«“„\"'’/,;:|·>»”)]"
#: Longer than any abbreviation.
LONG_WORD = 8
NEXT_NUMBER = re.compile(r"[ \u00a0]*\d")
NEXT_WORD = re.compile(r"[\s ]*([^\W\d_]*)")


def without_capitals(code: np.ndarray, kinds: np.ndarray) -> bool:
    """Whether sentences begin with small letters as a rule, as in text put in small letters."""
    capital = capitals()[np.minimum(code, 0xFFFF)]
    cased = (kinds == LOWER) | capital
    # a word of three letters at least, a stop, a blank, a letter
    ends = cased[:-5] & cased[1:-4] & cased[2:-3] & (kinds[3:-2] == STOP) & (kinds[4:-1] == SPACE) & cased[5:]
    found = int(ends.sum())
    if found < 2:
        upper, lower = int(capital.sum()), int((kinds == LOWER).sum())
        return upper + lower > 40 and upper < 0.01 * (upper + lower)
    return 2 * int((ends & capital[5:]).sum()) < found


def classify(text: str, abbreviations: frozenset[str] = ABBREVIATIONS) -> np.ndarray:
    """Classes of the characters of one document."""
    if any(lead in text for lead in WRONG_LEADS) and WRONGLY_DECODED.search(text):
        right, at = read_wrongly_decoded(text)
        if len(at) < len(text):
            kinds = np.full(len(text), SKIP, np.uint8)
            found = _classify(right, abbreviations)
            kinds[at] = found
            rest = np.diff(np.append(at, len(text)))  # blanks of several characters are blank throughout
            for k in np.flatnonzero((rest > 1) & (found == SPACE)).tolist():
                kinds[at[k] : at[k] + rest[k]] = SPACE
            return kinds
    return _classify(text, abbreviations)


def _stops(text: str, kinds: np.ndarray, stops: list[int], small: bool, abbreviations: frozenset[str]) -> None:
    """Make the full stops plain that end nothing."""
    plain = []
    for p in stops:
        after = text[p + 1 : p + 2]
        if after == ".":
            continue
        if "0" <= after <= "9":
            plain.append(p)
            continue
        word = text[max(0, p - 16) : p]
        word = word.rsplit(None, 1)[-1].lstrip(BEFORE_WORD) if word and not word[-1].isspace() else ""
        if word[-1:] == ".":  # an ellipsis
            if small and NEXT_WORD.match(text, p + 1).group(1) in GOING_ON:
                plain.append(p)
            continue
        bare = word.lower().lstrip("-–—")
        if bare and ("\u0900" <= bare[-1] <= "\u097f" or "\u0e00" <= bare[-1] <= "\u0e7f"):
            plain.append(p)  # scripts whose sentences end otherwise
        elif after.isalpha():
            # no blank follows: a sentence end only between a word and a capital, or between words in small text
            second = text[p + 2 : p + 3]
            if len(bare) < 2 or "." in bare or second == "." or bare in abbreviations or not (bare[-1].isalnum() or unicodedata.category(bare[-1])[0] == "M"):
                plain.append(p)
            elif not small and after.islower() and not second.isupper():
                plain.append(p)
        elif bare in SOFT_ABBREVIATIONS:
            if small and (bare not in ("p.m", "a.m") or NEXT_WORD.match(text, p + 1).group(1) in GOING_ON):
                plain.append(p)
        elif bare.isdigit():
            if NEXT_WORD.match(text, p + 1).group(1).lower() in MONTHS:
                plain.append(p)
        elif bare:
            last = bare[-1]
            if word.lstrip("-–—") in TITLE_ABBREVIATIONS or (bare in NUMBER_ABBREVIATIONS and NEXT_NUMBER.match(text, p + 1)):
                plain.append(p)
            elif len(bare) < 10 and (bare in abbreviations or (last.isalpha() and all(len(x) <= 1 for x in bare.replace("-", ".").split(".")))):
                plain.append(p)
    kinds[plain] = PLAIN


def _classify(text: str, abbreviations: frozenset[str]) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(code)
    kinds = base_classes()[np.minimum(code, 0xFFFF)]
    if not n:
        return kinds
    if code.max() > 0xFFFF:
        kinds[code > 0xFFFF] = START
        kinds[np.isin(code, [ord(c) for c in marks() if ord(c) > 0xFFFF])] = MARK
    small = n > 5 and without_capitals(code, kinds)
    lower = kinds == LOWER
    if small:
        kinds[lower] = START
    else:  # a name such as eVarlo starts like a capital
        odd = lower[1:-1] & (kinds[:-2] == SPACE) & (kinds[2:] == START) & (code[2:] < 0x250)
        kinds[1:-1][odd] = START

    lines = text.split("\n")
    entries = list_entries(lines)
    soft = wrapped_breaks(lines, entries, small) if len(lines) > 1 else ()
    whole = []
    if any(entries) or soft or "©" in text or "(c)" in text:
        at, unprosaic = 0, False
        for i, line in enumerate(lines):
            end = at + len(line)
            if not (i and i - 1 in soft):
                unprosaic = entries[i] or bool(FOOTER.match(line))
            if unprosaic:
                whole.append((at, end))
            if i in soft:
                kinds[end] = SPACE
            at = end + 1

    for m in ADDRESS_PART.finditer(text):
        a, b = m.span()
        while a and not text[a - 1].isspace():
            a -= 1
        while b < n and not text[b].isspace():
            b += 1
        # marks of the sentence at the end of an address stay
        while b > m.end() and not text[b - 1].isalnum():
            b -= 1
        body = kinds[a:b]
        body[(body == STOP) & (code[a:b] == 0x2E)] = PLAIN
    stop = np.flatnonzero((code == 0x2E) & (kinds == STOP))
    if len(stop):  # a long word before and no letter or digit after: nothing to look at
        letter = (kinds == LOWER) | (kinds == START)
        run_of = np.cumsum(~letter)
        plain_end = (stop > LONG_WORD) & (run_of[stop - 1] == run_of[np.maximum(stop - LONG_WORD, 0) - 1]) & (stop + 1 < n)
        plain_end &= ~letter[np.minimum(stop + 1, n - 1)] & (code[np.minimum(stop + 1, n - 1)] != 0x2E)
        _stops(text, kinds, stop[~plain_end].tolist(), small, abbreviations)

    # marks by script
    for m in SPEECH_DASH.finditer(text) if "—" in text or "– " in text or "- " in text else ():
        if (text[m.start() - 2] not in "?!") if small else m.group(1).isupper():
            kinds[m.start()] = OPEN
    if ";" in text or "\u037e" in text:
        for m in GREEK_QUESTION.finditer(text):
            kinds[m.start()] = MARK if small else STOP
    if "„" in text:
        kinds[code == 0x201C] = Q_CLOSE
    if "'" in text or "‘" in text:
        closing = [m.start() for m in SINGLE_CLOSE.finditer(text)]
        if closing:
            kinds[closing] = Q_CLOSE
            for m in SINGLE_OPEN.finditer(text):
                end = text.find("\n", m.end())
                if any(m.end() < c and (end < 0 or c < end) for c in closing):
                    kinds[m.start()] = Q_OPEN
    if "。" in text or "！" in text or "？" in text:
        for m in KANA_ON.finditer(text):
            nxt = m.end()
            quoted = text[nxt - 1] in "」』"
            if not quoted and text[nxt] != "と":
                kinds[m.start()] = PLAIN
            if quoted or text[nxt] != "と":
                kinds[nxt] = LOWER
        kinds[code == 0x2026] = PLAIN
    if ((code >= 0xE00) & (code < 0xE80)).any():
        for m in THAI_GAP.finditer(text):
            kinds[m.start()] = GAP
        for m in THAI_YEAR.finditer(text):
            kinds[m.start(1)] = GAP
    for a, b in whole:
        body = kinds[a:b]
        body[(body != SPACE) & (body != SKIP) & (body != GAP) & (body != BREAK)] = PLAIN
        body[body == GAP] = SPACE
    return kinds


def _chunks(kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chunks of CHUNK classes as columns, and the function of the states that each chunk and all before it are, a row each."""
    after, _ = transducer()
    chunks = -(-len(kinds) // CHUNK)
    grid = np.full(chunks * CHUNK, SKIP, np.uint8)
    grid[: len(kinds)] = kinds
    columns = np.ascontiguousarray(grid.reshape(chunks, CHUNK).T)
    function = np.repeat(np.arange(STATES, dtype=np.uint8)[:, None], chunks, axis=1)
    for column in columns:  # every chunk's function, all chunks at once
        function = after[function * np.uint8(CLASSES) + column]
    return columns, compose(np.ascontiguousarray(function.T))


def compose(functions: np.ndarray) -> np.ndarray:
    """Prefix scan: each row becomes the function that it and all rows before it are, in log steps."""
    out, reach = functions.copy(), 1
    while reach < len(out):
        out[reach:] = np.take_along_axis(out[reach:], out[:-reach], axis=1)
        reach *= 2
    return out


def run(kinds: np.ndarray, before: int = FRESH) -> np.ndarray:
    """Start flags of a sequence of classes after a state, by chunk functions and a prefix scan."""
    after, start = transducer()
    n = len(kinds)
    columns, function = _chunks(kinds)
    state = np.full(columns.shape[1], before, np.uint8)
    state[1:] = function[:-1, before]
    flags = np.empty(columns.shape, np.uint8)
    for j, column in enumerate(columns):
        at = state * np.uint8(CLASSES) + column
        flags[j] = start[at]
        state = after[at]
    return flags.T.ravel()[:n].astype(bool)


def units(texts: list[str], abbreviations: frozenset[str] = ABBREVIATIONS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Index of the text, start and end of every unit, for a list of texts."""
    parts = [classify(t, abbreviations) for t in texts]
    sizes = np.array([len(p) + 1 for p in parts], np.int64)
    begins = np.concatenate([[0], np.cumsum(sizes)])
    kinds = np.full(int(begins[-1]), BREAK, np.uint8)  # a break after each text
    for p, b in zip(parts, begins):
        kinds[b : b + len(p)] = p
    starts = np.flatnonzero(run(kinds))
    solid = (kinds != SPACE) & (kinds != BREAK) & (kinds != GAP)
    last = np.maximum.accumulate(np.where(solid, np.arange(len(kinds)), -1))
    limit = np.append(starts[1:], len(kinds))
    owner = np.searchsorted(begins, starts, "right") - 1
    ends = last[limit - 1] + 1
    return owner, starts - begins[owner], ends - begins[owner]


def cut_into_sections(text: str, size: int = 0) -> list[tuple[int, int]]:
    """Bounds of the sections of a text: up to ``size`` characters each, cut after the last end of a paragraph in the second half, else of a line, else of a word."""
    size = size or SECTION_CHARS
    out, at = [], 0
    while len(text) - at > size:
        for mark in ("\n\n", "\n", " "):
            end = text.rfind(mark, at + size // 2, at + size)
            if end >= 0:
                end += len(mark)
                break
        else:
            end = at + size
        out.append((at, end))
        at = end
    return [*out, (at, len(text))]


def _section_kinds(text: str, a: int, b: int, abbreviations: frozenset[str]) -> np.ndarray:
    """Classes of a section, seen with what stands before and after it in its lines."""
    left = max(text.rfind("\n", max(a - MARGIN, 0), a) + 1, a - MARGIN, 0)
    right = text.find("\n", b, b + MARGIN) if text[b - 1 : b] != "\n" else b
    right = min(b + MARGIN, len(text)) if right < 0 else right
    return classify(text[left:right], abbreviations)[a - left : b - left]


def _long_documents(df: DataFrame, key: str, text: str, abbreviations: frozenset[str]) -> DataFrame:
    """``key``, ``sent_start``, ``sent_end`` of documents of more than one section, which are spread over tasks."""
    size = SECTION_CHARS
    kind = df.schema[key].dataType.simpleString()

    def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for k, t in zip(batch.column(0), batch.column(1)):
                body = t.as_py()
                row += 1
                for no, (a, b) in enumerate(cut_into_sections(body, size)):
                    left, right = max(a - MARGIN, 0), min(b + MARGIN, len(body))
                    values = [f"{part}-{row}", no, left, a - left, b - left, body[left:right]]
                    types = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                    names = [key, "uid", "section", "begin", "a", "b", "body"]
                    yield pa.RecordBatch.from_arrays([pa.array([k.as_py()], batch.column(0).type), *(pa.array([v], c) for v, c in zip(values, types))], names=names)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            kinds = [_section_kinds(t, a, b, abbreviations) for t, a, b in zip(p["body"], p["a"], p["b"])]
            functions = [(_chunks(x)[1][-1] if len(x) else np.arange(STATES)).astype(np.int32) for x in kinds]
            yield pd.DataFrame({key: p[key], "uid": p["uid"], "section": p["section"], "begin": p["begin"] + p["a"], "kinds": [x.tobytes() for x in kinds], "function": functions})

    def entry_states(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values("section")
        through = compose(np.array(p["function"].tolist(), np.int64))
        return pd.DataFrame({"uid": p["uid"], "section": p["section"], "before": np.append(FRESH, through[:-1, FRESH])})

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in batches:
            for k, uid, no, begin, raw, before in zip(p[key], p["uid"], p["section"], p["begin"], p["kinds"], p["before"]):
                kinds = np.frombuffer(raw, np.uint8)
                starts = np.flatnonzero(run(kinds, int(before)))
                solid = (kinds != SPACE) & (kinds != BREAK) & (kinds != GAP)
                last = np.maximum.accumulate(np.where(solid, np.arange(len(kinds)), -1))
                ends = last[np.append(starts[1:], len(kinds)) - 1] + 1 if len(starts) else starts
                go_on = int(last[(starts[0] if len(starts) else len(kinds)) - 1]) + 1 if not len(starts) or starts[0] else 0
                if go_on:  # what is left of the unit of a section before
                    starts, ends = np.append(-1 - begin, starts), np.append(go_on, ends)
                edge = np.zeros(len(starts), bool)
                edge[-1:] = True  # may go on in the next section
                edge[:1] |= bool(go_on)
                yield pd.DataFrame({key: k, "uid": uid, "section": no, "sent_start": starts + begin, "sent_end": ends + begin, "edge": edge})

    def join_edges(p: pd.DataFrame) -> pd.DataFrame:
        p = p.sort_values(["section", "sent_end"])
        unit = (p["sent_start"] >= 0).cumsum()
        return p.groupby(unit).agg({key: "first", "sent_start": "max", "sent_end": "max"})[[key, "sent_start", "sent_end"]]

    pieces = df.where(F.length(text) > size).select(key, text)
    schema = f"`{key}` {kind}, uid string, section int, begin long, a long, b long, body string"
    # a task an own share of the sections, of whichever documents
    sections = cut_lineage(pieces.mapInArrow(take_apart, schema).repartition("uid", "section"))
    judged = cut_lineage(sections.mapInPandas(judge, f"`{key}` {kind}, uid string, section int, begin long, kinds binary, function array<int>"))
    states = judged.select("uid", "section", "function").groupBy("uid").applyInPandas(entry_states, "uid string, section int, before int")
    swept = cut_lineage(judged.drop("function").join(shuffled(states), ["uid", "section"]).mapInPandas(sweep, f"`{key}` {kind}, uid string, section int, sent_start long, sent_end long, edge boolean"))
    inner = swept.where(~F.col("edge")).select(key, "sent_start", "sent_end")
    # two rows a section at most: units that go over a border are put together
    outer = swept.where("edge").select(key, "uid", "section", "sent_start", "sent_end").groupBy("uid").applyInPandas(join_edges, f"`{key}` {kind}, sent_start long, sent_end long")
    return inner.unionByName(outer)


def sentence_units(df: DataFrame, key: str = "doc_id", text: str = "text", abbreviations: frozenset[str] = ABBREVIATIONS) -> DataFrame:
    """``key``, ``sent_start``, ``sent_end`` of every sentence unit.

    Offsets count code points from 0, the end is exclusive, and no unit begins or
    ends with white space. All non-blank text belongs to exactly one unit. Lines
    that are list entries or footers are one unit; other lines are divided by the
    rules, across hard wraps but not across other line breaks. Null, empty and
    blank texts have no unit. Repeated rows give repeated units. Texts of any
    length are worked on whole: those of more than SECTION_CHARS characters as sections in many tasks. ``abbreviations`` (in small letters, without
    the last stop) end no sentence.
    """
    ship_package(df.sparkSession)
    field = df.schema[key]
    schema = f"`{key}` {field.dataType.simpleString()}, sent_start long, sent_end long"

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1)
            sizes = np.array([len(t.as_py() or "") if t.is_valid else 0 for t in texts], np.int64)
            cuts = np.cumsum(sizes) // SLICE_CHARS
            bounds = [0, *(np.flatnonzero(np.diff(cuts)) + 1).tolist(), len(sizes)]
            for a, b in zip(bounds, bounds[1:]):
                if a == b:
                    continue
                owner, start, end = units([t or "" for t in texts.slice(a, b - a).to_pylist()], abbreviations)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(pa.array(owner)), pa.array(start.astype(np.int64)), pa.array(end.astype(np.int64))],
                    names=[key, "sent_start", "sent_end"],
                )

    short = df.where(F.length(text) <= SECTION_CHARS).select(key, text).mapInArrow(split, schema)
    if not df.where(F.length(text) > SECTION_CHARS).limit(1).count():
        return short
    return short.unionByName(_long_documents(df, key, text, abbreviations))
