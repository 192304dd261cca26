"""Sentence units of commit messages in many languages and scripts.

A message is first cut by its layout: subjects, list items, trailers, file lines of merges and paragraphs are
blocks; fences, rules and blank lines hold none. Inside a block the sentence ends are hidden events between words,
at the places (gaps) where a sentence could end, be it marked by punctuation, by a line break or, in scripts without
spaces or stops, by nothing but a blank. An n-gram model over words and boundary tokens is fitted to all documents
by expectation and maximisation: it starts from what is sure, the beginnings and ends of blocks and the words
between; in each round forward-backward posteriors over the gaps of a chain (gaps with one word between them) give the
expected n-grams across gaps, and with them the next counts. The marks about a gap are a cue beside the words, whose
chance is learnt in the same rounds from the posteriors, for kinds of words before a stop from how often such words
end blocks; word lists only give names to cues and first chances, which weigh as much as PRIOR gaps. Numbers, versions,
identifiers, links and hashes are classes.

Counts are tables joined by n-gram (a hash of 64 bits), over all documents and without a bound on their number; what
is sent to tasks is counted to be small before. Equal chains are worked on once. Nulls, empty and blank texts have no
units; texts of any length are read whole; rows without id and repeated ids have units like any other row.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint, small

#: Rounds of expectation; later ones feed more and more on their own decisions.
ROUNDS = 3
#: Gaps that the first chance of a cue weighs as much as.
PRIOR = 1000.0
#: Rows up to which a table of numbers is sent to all tasks (below 16 MB).
BROADCAST_ROWS = 200_000
#: A key that more than one in so many rows asks for is hot.
HOT = 10_000

# Characters and words of the languages served.
STOPS = ".!?…。！？｡．।॥።፧։۔؟‼⁇⁈⁉"
WIDE_STOPS = "。！？｡．"
CLOSERS = "\"')]}”’»›」』）】〉》］"
PAIRS = {"(": ")", "[": "]", "{": "}", "“": "”", "«": "»", "‹": "›", "„": "“", "「": "」", "『": "』", "（": "）", "【": "】", "〈": "〉", "《": "》", "［": "］"}
NEVER_LAST = frozenset(
    "dr mr mrs ms prof sr sra hr hrn fr mme mlle st mk vol no nr núm num pág pag p pp ch sec fig cf approx aprox vs e.g i.e eg ie z.b d.h u.a z d u bzw ca abs evtl ggf "
    "см рис табл т напр стр гл им βλ σελ π.χ περ κ αρ ص د أ डॉ श्री मि मि.से пр ej ex env art cap chap réf rev gen lt col capt rep sen gov bd hg vgl nº n° ver".split()
)
MAY_END = frozenset("etc usw al a.m p.m am pm co inc ltd corp jan feb mar apr jun jul aug sep sept oct nov dec min max hr hrs с г др т.д т.п κ.λπ".split())
ORDINAL_AFTER = frozenset("am der die das dem den des vom zum zur ab bis im beim seit dieser diese jeder jedes".split())

#: What may end a sentence at a gap, with the chance given to it before any text is read. The chances are learnt anew
#: from the posteriors of each round, the first ones counting as PRIOR gaps, so a long corpus overrides them.
CUES = (
    ("stop", 0.97), ("wide stop", 0.97), ("strong mark", 0.97), ("closed", 0.97), ("dots, new word", 0.8), ("dots", 0.45), ("lower case", 0.02), ("inside closing mark", 0.05),
    ("seldom last", 0.02), ("may be last", 0.85), ("may be last, number", 0.2), ("initial", 0.2), ("ordinal", 0.03), ("stop, number", 0.6),
    ("line of bare script", 0.9), ("short line, lower", 0.6), ("short line, caseless", 0.6), ("short line, other", 0.6),
    ("line, lower", 0.25), ("line, caseless", 0.25), ("line, other", 0.25), ("blank in bare script", 0.6), ("blank beside bare script", 0.35),
)
CUE = {name: i for i, (name, _) in enumerate(CUES)}
FIRST = np.array([g for _, g in CUES])

SPACELESS = r"฀-໿က-႟ក-៿⺀-⿟々-〇぀-ヿㇰ-ㇿ㐀-䶿一-鿿豈-﫿ｦ-ﾟ"
TOKEN = regex.compile(
    rf"(?P<url>[a-z][a-z+]*://[^\s{SPACELESS}<>\"”»)]*[^\s{SPACELESS}<>\"”».,;:!?)…])"
    rf"|(?P<word>[\p{{L}}\p{{M}}\p{{N}}_--[{SPACELESS}]](?:[\p{{L}}\p{{M}}\p{{N}}_--[{SPACELESS}]]|(?:::|[-./:@'’#=+,·])(?=[\p{{L}}\p{{N}}_--[{SPACELESS}]]))*(?:\(\))?)"
    rf"|(?P<bare>[{SPACELESS}]\p{{M}}*)|(?P<dots>\.{{2,}}|…+|[!?]{{2,}})|(?P<mark>\S)",
    regex.V1,
)
BARE = regex.compile(rf"[{SPACELESS}]")
GREEK = regex.compile(r"\p{Greek}")
LIST = regex.compile(r"(?:[-*+•–]|\d{1,4}[.)])[ \t]+")
TRAILER = regex.compile(r"(?:[A-Z][A-Za-z]*(?:-[A-Za-z]+)+: \S|(?:Issue|Issues|Bug|Link|Cc|Fixes|Closes|Refs|References|Resolves): \S|\(cherry picked from commit [0-9a-f]+\)$)")
CONFLICTS = regex.compile(r"(?:# ?)?Conflicts:$")
START = "\x01"


@dataclass
class Block:
    kind: str  # fixed: one unit, no part of the model; whole: one unit; text: to be split
    start: int
    end: int


def message_end(text: str) -> int:
    if text.startswith("diff --git "):
        return 0
    at = text.find("\ndiff --git ")
    return len(text) if at < 0 else at + 1


def blocks_of(text: str) -> list[Block]:
    """The blocks of a message by its layout; text is the message alone."""
    out: list[Block] = []
    at, fenced, seen, files = 0, False, False, False
    rows: list[tuple[int, int]] = []  # of the paragraph or list being gathered
    text_lines: list[list[tuple[int, int]]] = []

    def flush() -> None:
        nonlocal rows
        if rows:
            if all(TRAILER.match(text, a, b) for a, b in rows):
                out.extend(Block("fixed", a, b) for a, b in rows)
            else:
                listed, parts = False, []
                for a, b in rows:
                    mark = LIST.match(text, a, b) if listed or not parts else None
                    if mark and mark.end() < b:
                        listed = True
                        parts.append([mark.end(), b])
                    elif TRAILER.match(text, a, b) and text[a:b].partition(":")[0].endswith("-by"):
                        parts.append([a, b])
                    elif parts:
                        parts[-1][1] = b
                    else:
                        parts.append([a, b])
                out.extend(Block("text", a, b) for a, b in parts)
        rows = []

    for line in text.split("\n"):
        a, b = at, at + len(line)
        at = b + 1
        body = line.strip()
        if body.startswith("```") or body.startswith("~~~"):
            flush()
            fenced = not fenced
            files = False
            continue
        if fenced:
            continue
        if not body or body == "---":
            flush()
            files = files and not body
            continue
        a += len(line) - len(line.lstrip())
        b = a + len(body)
        if not seen:
            seen = True
            mark = LIST.match(text, a, b)
            out.append(Block("whole", mark.end() if mark and mark.end() < b else a, b))
            continue
        if CONFLICTS.match(body):
            flush()
            out.append(Block("fixed", a, b))
            files = True
            continue
        if files and (line[0] in "\t#" or " " not in body):
            out.append(Block("fixed", a, b))
            continue
        files = False
        rows.append((a, b))
    flush()
    return out


_CODES: dict[str, int] = {}


def code_of(word: str) -> int:
    """A stable number of 32 bits for a word or class."""
    c = _CODES.get(word)
    if c is None:
        if len(_CODES) > 500_000:
            _CODES.clear()
        c = _CODES[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
    return c


START_CODE = zlib.crc32(START.encode())
NUMBER = regex.compile(r"[\p{N}][\p{N}.,:]*%?")
VERSION = regex.compile(r"[vV][0-9][\w.]*")
HEX = regex.compile(r"(?=.*\d)[0-9a-f]{7,64}")
IDENT = regex.compile(r".*(?:_|::|\(\)|/|\p{Ll}\p{Lu}|\p{L}\.\p{L}{2}|\p{L}{2}\.\p{L}|=|@)")
ABBREVIATED = regex.compile(r"(?:\p{L}\.)+\p{L}")
_CLASSES: dict[str, str] = {}


def class_of(word: str) -> str:
    c = _CLASSES.get(word)
    if c is None:
        if NUMBER.fullmatch(word):
            c = "<n>" if len(word) > 2 else "<d>"
        elif VERSION.fullmatch(word):
            c = "<v>"
        elif HEX.fullmatch(word):
            c = "<h>"
        elif IDENT.match(word) and not ABBREVIATED.fullmatch(word) and word.lower() not in NEVER_LAST:
            c = "<i>"
        else:
            c = word
        if len(_CLASSES) > 500_000:
            _CLASSES.clear()
        _CLASSES[word] = c
    return c


def pairs_of(tokens: list[tuple[int, int, str, str]]) -> list[int]:
    """The depth of quotes and brackets after each token; marks without a partner don't count."""
    step = [0] * (len(tokens) + 1)
    open_: list[tuple[str, int]] = []
    for i, (_, _, raw, kind) in enumerate(tokens):
        if kind != "mark":
            continue
        hit = next((k for k in range(len(open_) - 1, -1, -1) if open_[k][0] == raw), None)
        if hit is not None:
            j = open_[hit][1]
            del open_[hit:]
            step[j] += 1
            step[i] -= 1
        elif raw == '"':
            open_.append(('"', i))
        elif raw in PAIRS:
            open_.append((PAIRS[raw], i))
    depth, now = [], 0
    for s in step[:-1]:
        now += s
        depth.append(now)
    return depth


def read_block(text: str, start: int, end: int) -> tuple[list[tuple[int, int]], list[int], list[tuple[int, int]], int]:
    """Token places, their codes, the gaps where a sentence could end, and the cue of the stop at its end, -1 if none.

    A gap is (token before it, its cue): after a stop, at a line break, or at a blank beside a script without
    spaces.
    """
    tokens = [(m.start(), m.end(), m.group(), m.lastgroup) for m in TOKEN.finditer(text, start, end)]
    codes = []
    for _, _, raw, kind in tokens:
        codes.append(code_of("<u>" if kind == "url" else class_of(raw) if kind == "word" else raw))
    depth = pairs_of(tokens)
    n = len(tokens)
    gaps: list[tuple[int, int]] = []
    stop = -1  # the token that holds the last stop, as long as only closing marks follow
    for i in range(n - 1):
        a, b, raw, kind = tokens[i]
        if kind in ("mark", "dots"):
            if raw[0] in STOPS or (raw == ";" and any(GREEK.match(t[2]) for t in tokens[max(0, i - 6) : i])):
                stop = i
            elif not (stop >= 0 and (raw in CLOSERS or raw == "“" and depth[i] < depth[i - 1])):
                stop = -1
        else:
            stop = -1
        if depth[i] > 0:
            continue
        nxt = tokens[i + 1]
        space = nxt[0] > b
        if stop >= 0:
            nr = nxt[2]
            if nxt[3] == "mark" and (nr in CLOSERS and not (nr == '"' and depth[i + 1] > depth[i]) and not (nr == "'" and space) or nr in ",;:" or nr[0] in STOPS) or nxt[3] == "dots":
                continue
            mark = tokens[stop][2]
            wide = mark[0] in WIDE_STOPS
            if not space and not wide and not (BARE.match(nr) and mark[0] in "!?" ):
                continue
            gaps.append((i, _cue(tokens, i, stop, wide, space)))
        elif space:
            between = text[b : nxt[0]]
            if "\n" in between:
                bare = kind == "bare" or nxt[3] == "bare"
                gaps.append((i, CUE["line of bare script"] if bare and kind != "mark" and _closed(raw) else _deliberate(text, start, end, b, nxt)))
            elif kind == "bare" and "฀" <= raw[0] <= "៿" or nxt[3] == "bare" and "฀" <= nxt[2][0] <= "៿":
                fresh = nxt[3] == "mark" and nxt[2] in PAIRS or nxt[3] == "word" and nxt[2][0].isupper()
                gaps.append((i, CUE["blank in bare script"] if kind == "bare" and (nxt[3] == "bare" or fresh) else CUE["blank beside bare script"]))
    last = CUE[_left(tokens, n - 1) or "stop"] if n and tokens[-1][2] == "." else -1
    return [(t[0], t[1]) for t in tokens], codes, gaps, last


def _closed(raw: str) -> bool:
    return raw not in ",;:、，；："


def _deliberate(text: str, start: int, end: int, b: int, nxt: tuple) -> int:
    """Whether a line was broken before it was full: the next word would have had room."""
    lines = text[start:end].split("\n")
    width = max(len(x.rstrip()) for x in lines)
    left = text.rfind("\n", 0, b) + 1
    first = nxt[2][0]
    plain = nxt[3] != "word" or class_of(nxt[2]) == nxt[2]
    case = "other" if not plain else "lower" if first.islower() else "caseless" if first.isalpha() and not first.isupper() else "other"
    return CUE[f"short line, {case}" if b - left + 1 + (nxt[1] - nxt[0]) <= width - 12 and len(lines) > 2 else f"line, {case}"]


def _cue(tokens: list, i: int, stop: int, wide: bool, space: bool) -> int:
    """The class of a gap after a stop, by the marks and letters about it."""
    return CUE[_cue_name(tokens, i, stop, wide, space)]


def _cue_name(tokens: list, i: int, stop: int, wide: bool, space: bool) -> str:
    nxt = tokens[i + 1]
    k = i + 1
    while k < len(tokens) - 1 and tokens[k][3] == "mark" and tokens[k][2] not in "#$%&":
        k += 1  # openers before the first word
    first = tokens[k][2]
    closed = i > stop
    if closed and not space and wide:
        return "inside closing mark"
    if tokens[k][3] == "word" and first[0].islower() and class_of(first) == first:
        return "lower case"
    mark = tokens[stop][2]
    if mark[0] == "…" or mark.startswith(".."):
        return "dots, new word" if first[:1].isupper() or nxt[3] != "word" or class_of(first) == "<i>" else "dots"
    if mark != ".":
        return "wide stop" if wide else "strong mark"
    if closed:
        return "closed"
    left = _left(tokens, stop)
    if left == "may be last":
        return left if not first[0].isdigit() else "may be last, number"
    return left or ("stop, number" if tokens[k][3] == "word" and first[0].isdigit() else "stop")


def _left(tokens: list, stop: int) -> str:
    """The class of a stop by the word before it; empty for an ordinary one."""
    word = tokens[stop - 1][2].lower() if stop and tokens[stop - 1][1] == tokens[stop][0] else ""
    if word in ("д", "п") and stop > 2 and tokens[stop - 3][2] == "т":
        word = "т.д"
    if word in NEVER_LAST:
        return "seldom last"
    if word in MAY_END:
        return "may be last"
    if len(word) == 1 and word.isalpha():
        return "initial"
    return "ordinal" if len(word) < 3 and word.isdigit() and stop > 1 and tokens[stop - 2][2].lower() in ORDINAL_AFTER else ""


def _key(kind: int, *parts: np.ndarray | int) -> np.ndarray:
    """A number of 64 bits for each n-gram (kind 1 to 3) or other thing that is counted."""
    h = np.full(np.broadcast(*parts).shape, kind * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
    for p in parts:
        h = (h ^ np.asarray(p).astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xD1B54A32D192ED03)
        h ^= h >> np.uint64(32)
    return h.view(np.int64)


END_KEY, TOKENS_KEY, OPENERS_KEY = (int(_key(k, np.array([START_CODE]))[0]) for k in (1, 4, 9))
GAP_KEYS = _key(5, np.arange(len(CUES)))  # gaps of each cue
MARKED_KEYS = _key(6, np.arange(len(CUES)))  # those of them at which a sentence ends
SURE_KEYS = _key(8, np.arange(len(CUES)))  # ends of blocks with the stop of a cue
#: Cues that the word before the stop makes; how often such words end blocks tells how often they end sentences.
LEFT = np.array([CUE[n] for n in ("seldom last", "may be last", "initial", "ordinal")])


def read_text(text: str | None) -> tuple[np.ndarray, ...] | None:
    """A message as arrays: words, words of each block, gaps (the words before them), their cues, the cues of the blocks' last stops, and the places of
    blocks, gaps and fixed units in the text. None if there is nothing."""
    if not text:
        return None
    message = text[: message_end(text)]
    words, lens, gaps, cues, lasts, block_at, gap_at, fixed = [], [], [], [], [], [], [], []
    for block in blocks_of(message):
        if block.kind == "fixed":
            fixed += (block.start, block.end)
            continue
        places, codes, found, last = read_block(message, block.start, block.end)
        if not places:
            continue
        if block.kind == "text":
            base = len(words)
            for i, cue in found:
                gaps.append(base + i)
                cues.append(cue)
                gap_at += (places[i][1], places[i + 1][0])
        words += codes
        lens.append(len(places))
        lasts.append(last if block.kind == "text" else -1)
        block_at += (places[0][0], places[-1][1])
    if not lens and not fixed:
        return None
    whole = lambda a: np.array(a, np.int32)
    return np.array(words, np.uint32), whole(lens), whole(gaps), np.array(cues, np.uint8), np.array(lasts, np.int8), whole(block_at), whole(gap_at), whole(fixed)


PARTS = ("words", "lens", "gaps", "cues", "lasts", "block_at", "gap_at", "fixed")
KINDS = dict(zip(PARTS, ("<u4", "<i4", "<i4", "u1", "i1", "<i4", "<i4", "<i4")))


class Stream:
    """The words of many messages in a row; from and number give each message's share of an array."""

    def __init__(self, arrays: dict[str, np.ndarray], sizes: dict[str, np.ndarray]):
        self.w = arrays["words"].astype(np.int64)
        n = len(self.w)
        self.first, self.last = np.zeros(n + 2, bool), np.zeros(n + 2, bool)
        ends = np.cumsum(arrays["lens"].astype(np.int64))
        self.first[ends - arrays["lens"]] = True
        self.last[ends - 1] = True
        start = np.cumsum(sizes["words"]) - sizes["words"]
        self.gap = arrays["gaps"].astype(np.int64) + np.repeat(start, sizes["gaps"])
        self.cue, self.lasts = arrays["cues"], arrays["lasts"]
        self.blocks = len(ends)
        # A chain is a run of gaps with one word between them.
        g = self.gap
        self.chain_from = np.flatnonzero(np.r_[True, g[1:] != g[:-1] + 1]) if len(g) else np.empty(0, np.int64)
        self.chain_len = np.diff(np.r_[self.chain_from, len(g)])

    def sure_counts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys and numbers of all that doesn't depend on the gaps: words, and n-grams that reach across none; and
        which of them are a word that begins a block."""
        w, n = self.w, len(self.w)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        first, last = self.first[:n], self.last[:n]
        gap = np.zeros(n + 2, bool)
        gap[self.gap] = True
        before = np.r_[False, gap[: n - 1]]  # a gap before the word
        before2 = np.r_[False, before[: n - 1]] & ~first
        prev = np.where(first, START_CODE, np.r_[START_CODE, w[:-1]])
        prev2 = np.where(first | np.r_[True, first[:-1]], START_CODE, np.r_[START_CODE, START_CODE, w[:-2]][:n])
        two = ~before
        three = two & ~before2 & ~first
        end3 = last & ~before
        s = np.int64(START_CODE)
        keys = np.concatenate([_key(1, w), _key(2, prev[two], w[two]), _key(3, prev2[three], prev[three], w[three]), _key(2, w[last], s), _key(3, prev[end3], w[end3], s)])
        keys, count = np.unique(keys, return_counts=True)
        seen = np.flatnonzero(by_cue := np.bincount(self.cue, minlength=len(CUES)))
        sure = np.bincount(self.lasts[self.lasts >= 0], minlength=len(CUES))
        ends = np.flatnonzero(sure)
        keys = np.r_[keys, END_KEY, TOKENS_KEY, GAP_KEYS[seen], SURE_KEYS[ends]]
        return keys, np.r_[count, self.blocks, n, by_cue[seen], sure[ends]], np.isin(keys, _key(2, s, w[first]))

    def chains(self):
        """(which chains, their words, their cues) by length: a word before, those at the gaps, and one after."""
        n = len(self.w)
        s = np.int64(START_CODE)
        wide = np.r_[self.w, s, s]
        for m in np.unique(self.chain_len).tolist():
            which = np.flatnonzero(self.chain_len == m)
            at = self.gap[self.chain_from[which]]
            inner = wide[at[:, None] + np.arange(m + 1)]
            left = np.where(self.first[at], s, wide[at - 1])
            right = np.where(self.last[at + m], s, wide[np.minimum(at + m + 1, n)])
            yield which, np.column_stack([left, inner, right]), self.cue[self.chain_from[which][:, None] + np.arange(m)]


def chain_ids(words: np.ndarray, cues: np.ndarray) -> np.ndarray:
    return _key(7, *words.T, *cues.T)


def asked_keys(words: np.ndarray) -> np.ndarray:
    """The n-grams that the chances at chains (rows of words) depend on; parts() says where which ones are."""
    w, s, m = words, np.int64(START_CODE), words.shape[1] - 3
    return np.column_stack(
        [
            _key(1, w), _key(2, w[:, :-1], w[:, 1:]), _key(2, w[:, 1 : m + 1], s), _key(2, s, w[:, 1 : m + 2]),
            _key(3, w[:, :-2], w[:, 1:-1], w[:, 2:]), _key(3, w[:, :m], w[:, 1 : m + 1], s), _key(3, s, w[:, 1:-1], w[:, 2:]), _key(3, s, w[:, 1 : m + 1], s),
        ]
    )


def parts(rows: np.ndarray, m: int) -> list[np.ndarray]:
    """Views of rows laid out like asked_keys: one, two, two to end, two from start, three, three to end, start three, start three to end."""
    cuts = np.cumsum([m + 3, m + 2, m, m + 1, m + 1, m, m + 1])
    return np.split(rows, cuts, axis=1)


@dataclass
class Totals:
    """What all chances need beside the counts of words: ends, words and ends together, how many different words
    begin blocks (the more, the likelier begins a new one), chances of the cues."""

    ends: float
    total: float
    openers: float
    cues: np.ndarray

    @classmethod
    def of(cls, counts: dict[int, float], first: np.ndarray, prior: float) -> Totals:
        ends = counts.get(END_KEY, 0.0)
        seen, marked, sure = (np.array([counts.get(int(k), 0.0) for k in keys]) for keys in (GAP_KEYS, MARKED_KEYS, SURE_KEYS))
        chance = first.copy()
        if marked.any():  # before any round nothing is marked, which says nothing about the cues
            chance = (prior * first + marked) / (prior + seen)
            # A class of words ends sentences inside blocks as often, beside ends of blocks, as ordinary words do.
            inside = marked[CUE["stop"]] / (sure[CUE["stop"]] + 1.0)
            chance[LEFT] = (prior * first[LEFT] + np.minimum(sure[LEFT] * inside, seen[LEFT])) / (prior + seen[LEFT])
        return cls(ends, max(counts.get(TOKENS_KEY, 0.0) + ends, 1.0), counts.get(OPENERS_KEY, 0.0) * ends / max(ends - marked.sum(), 1.0) + 0.6, np.clip(chance, 1e-4, 1 - 1e-4))


def posteriors(c: np.ndarray, cues: np.ndarray, t: Totals) -> np.ndarray:
    """P(event before, event here) of each gap, by forward-backward along the chains: rows, gaps, 2, 2.

    c: counts laid out like asked_keys. A word is predicted from the two before it, falling back on fewer ones; a
    boundary is a word of its own, at which histories end.
    """
    m = cues.shape[1]
    one, two, two_end, start_two, three, three_end, start_three, start_three_end = parts(c, m)
    p1 = (one + 0.02) / (t.total + 1000.0)
    p1_end = (t.ends + 0.02) / (t.total + 0.04)
    cue = np.log(t.cues / (1.0 - t.cues))[cues]
    k2, k3 = 0.6, 0.3
    z = np.empty((len(c), m, 2, 2))  # logarithms of the terms, by [event before][event here]
    for j in range(m):
        p2 = (two[:, j + 1] + k2 * p1[:, j + 2]) / (one[:, j + 1] + k2)
        p2_end = (two_end[:, j] + k2 * p1_end) / (one[:, j + 1] + k2)
        begin = np.log((start_two[:, j + 1] + t.openers * p1[:, j + 2]) / (t.ends + t.openers)) + cue[:, j]
        z[:, j, 0, 0] = np.log((three[:, j] + k3 * p2) / (two[:, j] + k3))
        z[:, j, 0, 1] = np.log((three_end[:, j] + k3 * p2_end) / (two[:, j] + k3)) + begin
        z[:, j, 1, 0] = np.log((start_three[:, j] + k3 * p2) / (start_two[:, j] + k3))
        z[:, j, 1, 1] = np.log((start_three_end[:, j] + k3 * p2_end) / (start_two[:, j] + k3)) + begin
    p2 = (two[:, m + 1] + k2 * p1[:, m + 2]) / (one[:, m + 1] + k2)
    after = np.stack([np.log((three[:, m] + k3 * p2) / (two[:, m] + k3)), np.log((start_three[:, m] + k3 * p2) / (start_two[:, m] + k3))], axis=1)
    z[:, 0, 1] = -np.inf
    forth = np.full((len(c), m, 2), -np.inf)
    for j in range(m):
        forth[:, j] = z[:, 0, 0] if not j else np.logaddexp(forth[:, j - 1, 0, None] + z[:, j, 0], forth[:, j - 1, 1, None] + z[:, j, 1])
    whole = np.logaddexp.reduce(forth[:, -1] + after, axis=1)
    back = after
    for j in range(m - 1, -1, -1):
        past = np.stack([np.zeros(len(c)), np.full(len(c), -np.inf)], axis=1) if not j else forth[:, j - 1]
        joint = past[:, :, None] + z[:, j] + back[:, None, :] - whole[:, None, None]
        back = np.logaddexp(z[:, j, :, 0] + back[:, None, 0], z[:, j, :, 1] + back[:, None, 1])
        z[:, j] = np.exp(joint)
    return z


def expected(cues: np.ndarray, n: np.ndarray, post: np.ndarray) -> np.ndarray:
    """Expected numbers of the n-grams that reach across gaps, laid out like asked_keys; a chain stands for n copies."""
    m = cues.shape[1]
    out = np.zeros((len(n), 8 * m + 8))
    _, two, two_end, start_two, three, three_end, start_three, start_three_end = parts(out, m)
    q = post * n[:, None, None, None]
    on, off = q[:, :, :, 1].sum(2), q[:, :, :, 0].sum(2)
    two[:, 1 : m + 1], two_end[:], start_two[:, 1 : m + 1] = off, on, on
    three[:, :m], three_end[:] = q[:, :, 0, 0], q[:, :, 0, 1]
    start_three[:, :m], start_three_end[:] = q[:, :, 1, 0], q[:, :, 1, 1]
    three[:, m] += off[:, -1]
    start_three[:, m] += on[:, -1]
    return out


SPLIT = 256


def _column(a: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column in a row, and how many each of its rows has."""
    offsets = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1] if len(a) else np.zeros(1, np.int32)
    raw = np.frombuffer(a.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    return raw.view(kind), np.diff(offsets) // np.dtype(kind).itemsize


def _stream(batch: pa.RecordBatch) -> Stream:
    got = {p: _column(batch.column(batch.schema.get_field_index(p)), KINDS[p]) for p in ("words", "lens", "gaps", "cues", "lasts")}
    return Stream({p: a for p, (a, _) in got.items()}, {p: s for p, (_, s) in got.items()})


def _lists(rows: np.ndarray) -> pa.Array:
    """A list array of the rows of a matrix."""
    n, width = rows.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * width), pa.array(np.ascontiguousarray(rows).ravel()))


def read_documents(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """row, ident, the arrays of read_text() and the ids of its chains: every text is cut into words once only."""
    message = F.split(F.col(text).cast("string"), r"(?md)^diff --git ", 2)[0]  # cut before the text leaves the JVM
    source = docs.select(F.monotonically_increasing_id().alias("row"), F.col(ident), message.alias("text"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, SPLIT):
                part = big.slice(at, SPLIT)
                got = [(i, r) for i, r in enumerate(map(read_text, part.column(2).to_pylist())) if r is not None]
                if not got:
                    continue
                arrays = {p: np.concatenate([r[k] for _, r in got]) for k, p in enumerate(PARTS)}
                sizes = {p: np.array([len(r[k]) for _, r in got]) for k, p in enumerate(PARTS)}
                s = Stream(arrays, sizes)
                ids = np.empty(len(s.chain_from), np.int64)
                for which, words, cues in s.chains():
                    ids[which] = chain_ids(words, cues)
                of_text = np.searchsorted(s.chain_from, np.r_[0, np.cumsum(sizes["gaps"])]).astype(np.int32)
                pick = pa.array([i for i, _ in got])
                columns = [pa.array([r[k].astype(KINDS[p]).tobytes() for _, r in got], pa.binary()) for k, p in enumerate(PARTS)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pick), part.column(1).take(pick), *columns, pa.ListArray.from_arrays(pa.array(of_text), pa.array(ids))], ["row", ident, *PARTS, "chains"])

    kind = docs.schema[ident].dataType.simpleString()
    return checkpoint(source.mapInArrow(work, f"row long, `{ident}` {kind}, {', '.join(f'{p} binary' for p in PARTS)}, chains array<long>"))


def _sure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            keys, n, opens = _stream(batch).sure_counts()
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n.astype(np.int64)), pa.array(opens)], ["key", "n", "opens"])


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        for _, words, cues in _stream(batch).chains():
            ids, first, n = np.unique(chain_ids(words, cues), return_index=True, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(ids), _lists(cues[first].astype(np.int32)), _lists(asked_keys(words[first])), pa.array(n)], ["id", "cues", "keys", "n"])


def _round(totals: Totals):
    """One E step over chains: how many of the n-grams that reach across their gaps are expected, and the marks."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            length = pa.compute.list_value_length(batch.column(1)).to_numpy()
            for m in np.unique(length).tolist():
                some = batch.filter(pa.array(length == m))
                cues = some.column(1).flatten().to_numpy().reshape(-1, m)
                n = some.column(2).to_numpy().astype(float)
                post = posteriors(some.column(4).flatten().to_numpy().reshape(len(n), -1), cues, totals)
                on = post[:, :, :, 1].sum(2)
                columns = [*some.columns[:4], _lists(expected(cues, np.ones(len(n)), post)), _lists(on)]
                yield pa.RecordBatch.from_arrays(columns, ["id", "cues", "n", "keys", "own", "chance"])

    return work


def _looked_up(rows: DataFrame, key: str, table: DataFrame) -> DataFrame:
    """rows with the columns of table (one row for each key, asks: how many rows ask for it), null where it has none.

    A small table is sent to all tasks. Else the keys that more than one in HOT rows asks for, which are at most HOT,
    are sent, and the others meet in a shuffle, in which rows with hot keys are spread at random.
    """
    if small(table, BROADCAST_ROWS):
        return rows.join(F.broadcast(table.drop("asks")), key, "left")
    values = [c for c in table.columns if c not in (key, "asks")]
    total = table.agg(F.sum("asks")).first()[0] or 0
    hot = table.where(F.col("asks") * HOT > total).select(key, *[F.col(v).alias(f"hot_{v}") for v in values], F.lit(True).alias("is_hot"))
    cold = table.where(F.col("asks") * HOT <= total).select(F.col(key).alias("cold_key"), *values)
    rows = rows.join(F.broadcast(hot), key, "left")
    spread = F.when(F.col("is_hot"), F.xxhash64(F.rand(1))).otherwise(F.col(key))
    met = rows.withColumn("met_key", spread).join(cold, (F.col("met_key") == F.col("cold_key")), "left")
    return met.select(*[c for c in rows.columns if c not in ("is_hot", *[f"hot_{v}" for v in values])], *[F.when(F.col("is_hot"), F.col(f"hot_{v}")).otherwise(F.col(v)).alias(v) for v in values])


def fit(read: DataFrame, rounds: int = ROUNDS, prior: float = PRIOR, first: np.ndarray = FIRST) -> DataFrame:
    """(id, cues, n, keys, own, chance) of every chain: the chance that a sentence ends at each of its gaps.

    The first round knows only what is sure: how blocks begin and end, and the words between. Each later one adds what
    the round before expects at the gaps, and learns the chances of the cues anew; a chain does not count itself.
    """
    sure = checkpoint(read.select("words", "lens", "gaps", "cues", "lasts").mapInArrow(_sure, "key long, n long, opens boolean").groupBy("key").agg(F.sum("n").alias("n"), F.max("opens").alias("opens")))
    special = [END_KEY, TOKENS_KEY, *GAP_KEYS.tolist(), *SURE_KEYS.tolist()]
    scalars = {r["key"]: float(r["n"]) for r in sure.where(F.col("key").isin(special)).collect()}  # at most two and two for each cue
    scalars[OPENERS_KEY] = float(sure.where("opens").count())
    found = read.where("size(chains) > 0").select("words", "lens", "gaps", "cues", "lasts").mapInArrow(_chains, "id long, cues array<int>, keys array<long>, n long")
    chains = checkpoint(found.groupBy("id").agg(F.first("cues").alias("cues"), F.sum("n").alias("n"), F.first("keys").alias("keys")).withColumn("own", F.array_repeat(F.lit(0.0), F.size("keys"))))
    asked = chains.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("asks"))
    known = checkpoint(asked.join(sure, "key", "left").select("key", "asks", F.coalesce("n", F.lit(0)).cast("double").alias("c")))
    counts, marked = known, {}
    for k in range(rounds):
        totals = Totals.of(scalars | {END_KEY: scalars.get(END_KEY, 0.0) + sum(marked.values())} | {int(MARKED_KEYS[c]): v for c, v in marked.items()}, first, prior)
        asks = chains.select("id", "cues", "n", F.posexplode(F.arrays_zip("keys", "own"))).select("id", "cues", "n", "pos", "col.keys", "col.own").withColumnRenamed("keys", "key")
        met = _looked_up(asks, "key", counts).withColumn("c", F.greatest(F.col("c") - F.col("own"), F.lit(0.0)))
        rows = met.groupBy("id").agg(F.first("cues").alias("cues"), F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("pos", "key", "c"))).alias("s"))
        chains = checkpoint(rows.select("id", "cues", "n", F.col("s.key").alias("keys"), F.col("s.c").alias("counts")).mapInArrow(_round(totals), "id long, cues array<int>, n long, keys array<long>, own array<double>, chance array<double>"))
        if k + 1 < rounds:
            new = chains.select("n", F.explode(F.arrays_zip("keys", "own")).alias("e")).groupBy(F.col("e.keys").alias("key")).agg(F.sum(F.col("e.own") * F.col("n")).alias("more"))
            counts = checkpoint(known.join(new, "key", "left").select("key", "asks", (F.col("c") + F.coalesce("more", F.lit(0.0))).alias("c")))
            by_cue = chains.select("n", F.explode(F.arrays_zip("cues", "chance")).alias("e")).groupBy(F.col("e.cues").alias("cue")).agg(F.sum(F.col("e.chance") * F.col("n")).alias("s"))
            marked = {r["cue"]: r["s"] for r in by_cue.collect()}  # one row for each cue
    return chains


def by_cue(chains: DataFrame, first: np.ndarray = FIRST) -> DataFrame:
    """(cue, gaps, first_chance, ends, changed): of each cue the gaps, those where a sentence ends, and those that are
    decided otherwise than the first chance alone would."""
    spark = chains.sparkSession
    names = spark.createDataFrame([(i, n, float(first[i])) for i, (n, _) in enumerate(CUES)], "c int, cue string, first_chance double")
    g = chains.select("n", F.explode(F.arrays_zip("cues", "chance")).alias("e")).select("n", F.col("e.cues").alias("c"), (F.col("e.chance") > 0.5).alias("on"))
    g = g.groupBy("c").agg(F.sum("n").alias("gaps"), F.sum(F.when(F.col("on"), F.col("n")).otherwise(0)).alias("ends"))
    off = F.when(F.col("first_chance") > 0.5, F.col("gaps") - F.col("ends")).otherwise(F.col("ends"))
    return g.join(F.broadcast(names), "c").select("cue", "gaps", "first_chance", "ends", off.alias("changed"))


def _units(ident: str):
    """The units between the places where blocks begin and end and the gaps that are marked."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            column = lambda name, kind: _column(batch.column(batch.schema.get_field_index(name)), kind)
            every = np.arange(batch.num_rows)
            block, blocks = column("block_at", "<i4")
            gap, gaps = column("gap_at", "<i4")
            fixed, fixes = column("fixed", "<i4")
            marks = batch.column(batch.schema.get_field_index("marks")).flatten().to_numpy(zero_copy_only=False).astype(bool)
            row = np.r_[np.repeat(every, blocks // 2), np.repeat(every, gaps // 2)[marks]]
            start, end = np.r_[block[::2], gap[1::2][marks]], np.r_[block[1::2], gap[::2][marks]]
            # Units of a text lie one after the other, so sorted starts and sorted ends belong together.
            by_start, by_end = np.lexsort((start, row)), np.lexsort((end, row))
            row = np.r_[row[by_start], np.repeat(every, fixes // 2)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(np.r_[start[by_start], fixed[::2]], pa.int32()), pa.array(np.r_[end[by_end], fixed[1::2]], pa.int32())], [ident, "start_char", "end_char"])

    return work


def split(read: DataFrame, chains: DataFrame, ident: str = "doc_id") -> DataFrame:
    """(ident, start_char, end_char): the units of every message, as code points of the text."""
    decided = chains.select("id", F.transform("chance", lambda p: p > 0.5).alias("marks"), F.col("n").alias("asks"))
    asks = read.where("size(chains) > 0").select("row", F.posexplode("chains").alias("pos", "id"))
    marks = _looked_up(asks, "id", decided).groupBy("row").agg(F.flatten(F.array_sort(F.collect_list(F.struct("pos", "marks")))["marks"]).alias("marks"))
    rows = read.select("row", F.col(ident), "block_at", "gap_at", "fixed").join(marks, "row", "left")
    kind = read.schema[ident].dataType.simpleString()
    return rows.select(F.col(ident), "block_at", "gap_at", "fixed", F.coalesce("marks", F.array().cast("array<boolean>")).alias("marks")).mapInArrow(_units(ident), f"`{ident}` {kind}, start_char int, end_char int")


def found(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    read = read_documents(docs, ident, text)
    return split(read, fit(read), ident)
