"""A character language model and the Viterbi search of the most likely plain spelling."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recordloom.llm.common import cut_batches

#: Symbols: 0 for anything between words, 1 for digits and marks in a word, 2 for other letters,
#: then the Latin letters.
GAP, MARK, OTHER = 0, 1, 2
LETTERS = [chr(c) for c in (*range(0x61, 0x7B), *range(0xDF, 0x100)) if chr(c).isalpha()]
SYMBOLS = 3 + len(LETTERS)
CODE = {c: i + 3 for i, c in enumerate(LETTERS)}

#: What a sign may stand for in a disguised word.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
#: Signs that may be put between the letters of a word.
FILLERS = " .-_*~'·\t"
#: Log probabilities of the channel: a sign for a letter, a filler or repetition left out.
DISGUISED, DROPPED = math.log(0.2), math.log(0.3)

#: A filler kept among single letters that are all spaced.
KEPT = math.log(0.02)

_SIGNS = re.escape("".join(LOOKALIKES))
_FILL = re.escape(FILLERS)
#: Single letters or signs with fillers between them.
SPACED = re.compile(rf"(?<!\w)[\w{_SIGNS}](?:[{_FILL}]{{1,3}}[\w{_SIGNS}]){{3,}}(?!\w)")
#: Three of them: too often a plain list to be replaced, but another reading.
SHORT = re.compile(rf"(?<!\w)[\w{_SIGNS}](?:[{_FILL}]{{1,3}}[\w{_SIGNS}]){{2}}(?!\w)")
#: Words with a letter twice in a row.
DOUBLED = re.compile(r"([^\W\d_])\1")
WORD = re.compile(r"[^\W\d_]+")
#: Where a token is worth a search: a sign next to a letter and not at the end, or three equal letters.
TRIGGER = re.compile(rf"[{_SIGNS}](?=[^\W\d_])|(?<=[^\W\d_])[{_SIGNS}](?=[\w@])|([^\W\d_])\1\1")
#: The token around such a place; signs that end it are punctuation unless they are digits.
_BEFORE = re.compile(rf"[\w{_SIGNS}]")
_TOKEN = re.compile(rf"[\w{_SIGNS}]*\w")
#: Tokens that end in signs, which may be punctuation or letters.
FINAL = re.compile(rf"(?<![\w{_SIGNS}])[\w{_SIGNS}]*[^\W\d_][{_SIGNS}]+(?![\w{_SIGNS}])")
#: Characters of a span that is remembered.
LONGEST = 200
_FILLER_POINTS = np.array([ord(x) for x in FILLERS], np.uint32)
_SIGN_POINTS = np.array([ord(x) for x in LOOKALIKES], np.uint32)
_LETTER = re.compile(r"[^\W\d_]")
#: Between texts that are looked at together; neither filler, sign nor letter.
_BREAK = "\n" * 6
#: Characters that are turned into arrays at once, and where a longer text may be cut: no reading spans these.
STRETCH, _ENDS = 1 << 20, "\n,;:?"


@functools.cache
def codes() -> np.ndarray:
    """The symbol of each code point up to 65535; beyond is OTHER."""
    out = np.zeros(1 << 16, np.int64)
    for i in range(1 << 16):
        c = chr(i).lower()[0]
        out[i] = CODE.get(c) or (OTHER if c.isalpha() else MARK if c.isdigit() else GAP)
    return out


@functools.cache
def letters() -> np.ndarray:
    """Which code points up to 65535 are letters of words."""
    return np.array([bool(_LETTER.match(chr(i))) for i in range(1 << 16)])


def count_trigrams(docs: DataFrame, text: str = "text") -> DataFrame:
    """(gram, n): how often three symbols follow each other, over all whole texts.

    Every task adds up its own counts first; there are at most SYMBOLS ** 3 grams.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in cut_batches(batches, "_text"):
            joined = "  " + "  ".join([t or "" for t in batch.column(0).to_pylist()]) + "  "
            points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
            s = np.where(points < (1 << 16), codes()[np.minimum(points, (1 << 16) - 1)], OTHER)
            total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=SYMBOLS**3)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some])], names=["gram", "n"])

    grams = docs.select(F.col(text).cast("string").alias("_text")).mapInArrow(run, "gram long, n long")
    return grams.groupBy("gram").agg(F.sum("n").alias("n"))


def _pieces(text: str) -> Iterator[str]:
    """A text in stretches that end where no reading goes on; one without such a place stays whole."""
    at = 0
    while len(text) - at > STRETCH:
        end = max(text.rfind(c, at, at + STRETCH) for c in _ENDS) + 1
        if end <= at:
            break
        yield text[at:end]
        at = end
    yield text[at:]


class Places:
    """A text as arrays: symbols, what each character is, and the bounds of the word it stands in."""

    def __init__(self, text: str):
        self.text = text
        self.points = points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        low = np.minimum(points, (1 << 16) - 1)
        beyond = np.flatnonzero(points >= 1 << 16)
        self.s = codes()[low]
        self.letter = letters()[low]
        self.s[beyond] = OTHER
        if len(beyond):
            own = {p: bool(_LETTER.match(chr(p))) for p in np.unique(points[beyond]).tolist()}
            self.letter[beyond] = [own[p] for p in points[beyond].tolist()]
        self.sign, self.filler = np.isin(points, _SIGN_POINTS), np.isin(points, _FILLER_POINTS)
        #: Letters, digits, lines and signs: what a token may hold.
        self.held = self.sign | self.letter | (self.s == MARK) | (points == ord("_"))
        #: Where two characters of tokens follow each other over fillers, and another filler comes.
        self._spaced: np.ndarray | None = None
        place = np.arange(len(points))
        self.start = np.maximum.accumulate(np.where(self.letter, -1, place)) + 1
        self.end = np.minimum.accumulate(np.where(self.letter, len(points), place)[::-1])[::-1]


    def spaced(self) -> np.ndarray:
        """Where spaced single characters may begin."""
        if self._spaced is None:
            held, filler, n = self.held, self.filler, len(self.text)
            near = np.zeros(n, bool)
            for k in (1, 2, 3):
                two = held[: n - k - 2] & held[k + 1: n - 1] & filler[k + 2:]
                for i in range(1, k + 1):
                    two &= filler[i: n - k - 2 + i]
                near[: n - k - 2] |= two
            self._spaced = np.flatnonzero(near)
        return self._spaced

    def suspicious(self) -> np.ndarray:
        """Places that ``TRIGGER`` or ``SPACED`` may match in the text before it was put in lower case."""
        letter, sign, held, points = self.letter, self.sign, self.held, self.points
        trigger = np.zeros(len(points), bool)
        trigger[1:-2] = sign[1:-2] & (letter[2:-1] | letter[:-3] & held[2:-1])
        trigger[1:-2] |= letter[1:-2] & (points[1:-2] == points[2:-1]) & (points[1:-2] == points[3:])
        return np.union1d(np.flatnonzero(trigger), self.spaced())


def _portions(pieces: list[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    """Pieces of at most ``STRETCH`` characters together, or a single longer one."""
    at = 0
    while at < len(pieces):
        end, size = at, 0
        while end < len(pieces) and (end == at or size + len(pieces[end][1]) <= STRETCH):
            size += len(pieces[end][1])
            end += 1
        yield pieces[at:end]
        at = end


def _begins(pieces: list[tuple[int, str]]) -> np.ndarray:
    return np.cumsum([0, *(len(p) + len(_BREAK) for _, p in pieces)])


class CharModel:
    """Log probabilities of a symbol after two others, backing off to one and none."""

    def __init__(self, counts: np.ndarray):
        c3 = counts.reshape(SYMBOLS, SYMBOLS, SYMBOLS).astype(float)
        c2 = c3.sum(axis=0)
        c1 = c2.sum(axis=0)
        p1 = (c1 + 1) / (c1.sum() + SYMBOLS)
        p2 = (c2 + 5 * p1) / (c2.sum(axis=1, keepdims=True) + 5)
        p3 = (c3 + 5 * p2[None]) / (c3.sum(axis=2, keepdims=True) + 5)
        self.table = np.log(p3).ravel()
        self.log = self.table.tolist()
        self.known: dict[str, str] = {}

    def restore(self, span: str) -> str:
        """The most likely plain spelling of a suspicious span."""
        got = self.known.get(span)
        if got is None:
            if len(self.known) > 50_000:
                self.known.clear()
            low = span.lower()
            got = self._search(low, bool(SPACED.fullmatch(span) or SHORT.fullmatch(span)))
            got = span if got == low else got
            if len(span) <= LONGEST:
                self.known[span] = got
        return got

    def _search(self, span: str, spaced: bool) -> str:
        log, n = self.log, len(span)
        last = len(span.rstrip("".join(x for x in LOOKALIKES if not x.isdigit())))  # from here signs may be punctuation
        # at[i]: (last two symbols) -> (score, link), links chain the letters written
        at: list[dict[int, tuple[float, object]]] = [{} for _ in range(n + 1)]
        at[0][GAP * SYMBOLS + GAP] = (0.0, None)
        ends = list(range(1, n + 1))  # where the run of equal signs at each place ends
        for i in range(n - 2, -1, -1):
            if span[i] == span[i + 1]:
                ends[i] = ends[i + 1]
        for i in range(n):
            if not at[i]:
                continue
            c, end = span[i], ends[i]
            moves: list[tuple[int, str, float]] = []  # next place, letters written, cost
            if c in LOOKALIKES:
                moves += [(i + 1, x, DISGUISED) for x in LOOKALIKES[c]]
                moves.append((i + 1, c, 0.0))
                if end - i > 1:
                    moves += [(end, x, DISGUISED + DROPPED) for x in LOOKALIKES[c]]
            else:
                moves.append((i + 1, c, 0.0))
                if end - i > 1:
                    moves.append((end, c, DROPPED))
                    if end - i > 2:
                        moves.append((end, c + c, DROPPED))
            if c in FILLERS:
                moves = [(end, c, KEPT), (end, "", 0.0)] if spaced else [*moves, (end, "", DROPPED)]
            for state, (score, link) in at[i].items():
                for j, letters, cost in moves:
                    total, s, chain = score + cost, state, link
                    for x in letters:
                        code = CODE.get(x) or (OTHER if x.isalpha() else GAP if x in FILLERS or i >= last and not x.isdigit() else MARK)
                        total += log[s * SYMBOLS + code]
                        s = s % SYMBOLS * SYMBOLS + code
                        chain = (chain, x)
                    old = at[j].get(s)
                    if old is None or total > old[0]:
                        at[j][s] = (total, chain)
            at[i] = {}
        _, chain = max(((v[0] + log[s * SYMBOLS + GAP], v[1]) for s, v in at[n].items()), key=lambda x: x[0])
        out = []
        while chain is not None:
            chain, x = chain
            out.append(x)
        return "".join(reversed(out))

    def words(self, text: str) -> set[str]:
        """The words of one text, see :meth:`readings`."""
        return self.readings([text])[0]

    def readings(self, texts: list[str]) -> list[set[str]]:
        """The words of each plain text, and other readings that the model prefers.

        Final signs, doubled letters, three spaced letters and groups between fillers are common
        in plain texts too, so their readings are added and replace nothing. Where one is likelier
        depends on a few neighbouring symbols, so tables tell it for all texts at once; only the
        places they leave are searched.
        """
        found: list[set[str]] = [set() for _ in texts]
        later: list[tuple[int, str]] = []
        lows = [t.lower() for t in texts]
        # where lower case keeps every character's place, the same arrays tell which places are suspicious
        even = [(i, low) for i, low in enumerate(lows) if len(low) == len(texts[i]) <= STRETCH]
        for group in _portions(even):
            at = Places(_BREAK + _BREAK.join(low for _, low in group) + _BREAK)
            begins = _begins(group)
            places = at.suspicious()
            cuts = np.searchsorted(places, begins)
            same = np.ones(len(group), bool)
            for k, (i, low) in enumerate(group):
                own = places[cuts[k]: cuts[k + 1]] - begins[k] - len(_BREAK)
                if len(own) and (plain := self._plain_at(texts[i], own.tolist())) != texts[i]:
                    same[k] = False
                    later.append((i, plain.lower()))
                else:
                    found[i].update(WORD.findall(low))
            self._add(at, begins, [i for i, _ in group], found, same)
        chosen = {i for i, _ in even}
        later += [(i, self.plain(t).lower()) for i, t in enumerate(texts) if i not in chosen]
        for i, plain in later:
            found[i].update(WORD.findall(plain))
        for group in _portions([(i, piece) for i, plain in later for piece in _pieces(plain)]):
            at = Places(_BREAK + _BREAK.join(p for _, p in group) + _BREAK)
            self._add(at, _begins(group), [i for i, _ in group], found, np.ones(len(group), bool))
        return found

    def _add(self, at: Places, begins: np.ndarray, owners: list[int], found: list[set[str]], wanted: np.ndarray) -> None:
        for kind in (self._doubled, self._short, self._final, self._joined):
            where, words = kind(at)
            turn = np.searchsorted(begins, where, "right") - 1
            for k, w, use in zip(turn.tolist(), words, wanted[turn].tolist() if len(turn) else ()):
                if use:
                    found[owners[k]].add(w)

    def _doubled(self, at: Places) -> tuple[list[int], list[str]]:
        """Words with a letter twice in a row that are likelier with it once.

        Whether a pair is better alone depends on the letter before and the symbol after, as the
        trigrams further on are the same; so the pairs of a word are independent of each other.
        """
        points, letter = at.points, at.letter
        s = np.where(letter, at.s, GAP)
        g = np.flatnonzero((points[2:-2] == points[3:-1]) & letter[2:-2]) + 2
        y, c, a = s[g - 1], s[g], s[g + 2]
        t = self.table
        better = t[(y * SYMBOLS + c) * SYMBOLS + a] + DROPPED > t[(y * SYMBOLS + c) * SYMBOLS + c] + t[(c * SYMBOLS + c) * SYMBOLS + a]
        # longer runs have more spellings: search those words
        longer = (points[g - 1] == points[g]) | (points[g + 2] == points[g])
        searched = set(np.unique(at.start[g[longer]]).tolist())
        where, words, text = [], [], at.text
        for p in searched:
            where.append(p)
            words.append(self.restore(text[p: int(at.end[p])]))
        once = g[better]
        last, out, end = -1, [], 0
        for p, start, stop in zip(once.tolist(), at.start[once].tolist(), at.end[once].tolist()):
            if start != last:
                if out and last not in searched:
                    where.append(last)
                    words.append("".join([*out, text[done:end]]))
                last, out, done, end = start, [], start, stop
            out.append(text[done: p + 1])
            done = p + 2
        if out and last not in searched:
            where.append(last)
            words.append("".join([*out, text[done:end]]))
        return where, words

    def _short(self, at: Places) -> tuple[list[int], list[str]]:
        """Three single letters with fillers between them."""
        return self._searched(SHORT, at.text, at.spaced())

    def _final(self, at: Places) -> tuple[list[int], list[str]]:
        """Tokens that end in signs. After plain letters a single sign is read alone, by the two letters before."""
        points, letter, held, s = at.points, at.letter, at.held, at.s
        last = np.flatnonzero(at.sign[4:-4] & letter[3:-5]) + 4
        single = ~held[last + 1]
        y, x = np.where(letter[last - 2], s[last - 2], GAP), s[last - 1]
        t = self.table
        kept = t[(y * SYMBOLS + x) * SYMBOLS + GAP] + t[(x * SYMBOLS + GAP) * SYMBOLS + GAP]
        likelier = np.zeros(len(last), bool)
        for sign, letters in LOOKALIKES.items():
            here = points[last] == ord(sign)
            if sign.isdigit():
                # a digit at the end is a mark, not punctuation
                likelier |= here
                continue
            for c in letters:
                other = t[(y * SYMBOLS + x) * SYMBOLS + CODE[c]] + DISGUISED + t[(x * SYMBOLS + CODE[c]) * SYMBOLS + GAP]
                likelier |= here & (other >= kept)
        # a pair of letters that reaches the end may be read otherwise together with the sign
        pair = (points[last - 1] == points[last - 2]) | (points[last - 2] == points[last - 3])
        begins = np.maximum.accumulate(np.where(held, 0, np.arange(len(points))))[last] + 1
        mixed = at.start[last - 1] != begins
        return self._searched(FINAL, at.text, np.unique(begins[~single | likelier | pair | mixed]))

    def _searched(self, kind: re.Pattern, text: str, starts: np.ndarray) -> tuple[list[int], list[str]]:
        where, words, done = [], [], 0
        for p in starts.tolist():
            if p < done:
                continue
            m = kind.match(text, p)
            if m:
                done = m.end()
                own = WORD.findall(self.restore(m[0]))
                where += [p] * len(own)
                words += own
        return where, words

    def _joined(self, at: Places) -> tuple[list[int], list[str]]:
        """Words broken into groups, where the groups are likelier as one word than apart."""
        s, filler, letter, t = at.s, at.filler, at.letter, self.table
        starts, ends = [], []
        for k in (1, 2, 3):
            g = np.flatnonzero(filler[2: len(s) - k - 1] & letter[1: len(s) - k - 2] & letter[2 + k: len(s) - 1]) + 2
            for i in range(1, k):
                g = g[filler[g + i]]
            x, y, a, b = s[g - 2], s[g - 1], s[g + k], s[g + k + 1]
            one = t[(x * SYMBOLS + y) * SYMBOLS + a] + t[(y * SYMBOLS + a) * SYMBOLS + b] + DROPPED
            two = t[(x * SYMBOLS + y) * SYMBOLS + GAP] + t[(y * SYMBOLS + GAP) * SYMBOLS + a] + t[(GAP * SYMBOLS + a) * SYMBOLS + b]
            g = g[one > two]
            starts.append(g)
            ends.append(g + k)
        cut, after = np.concatenate(starts), np.concatenate(ends)
        order = np.argsort(cut)
        cut, after = cut[order], after[order]
        begin, end = at.start[cut - 1], at.end[after]
        follows = np.zeros(len(cut), bool)
        follows[1:] = end[:-1] == cut[1:]
        where, words, text = [], [], at.text
        for b, c, a, e, more in zip(begin.tolist(), cut.tolist(), after.tolist(), end.tolist(), follows.tolist()):
            if more:
                words[-1] += text[a:e]
            else:
                where.append(b)
                words.append(text[b:c] + text[a:e])
        return where, words

    def _plain_at(self, text: str, places: list[int]) -> str:
        """As :meth:`plain`, where only these places may be suspicious."""
        if any(SPACED.match(text, p) for p in places):
            return self.plain(text)
        return self._restored(text, [p for p in places if TRIGGER.match(text, p)])

    def plain(self, text: str) -> str:
        """The text with its suspicious spans restored."""
        text = SPACED.sub(lambda m: self.restore(m[0]), text)
        return self._restored(text, [found.start() for found in TRIGGER.finditer(text)])

    def _restored(self, text: str, triggers: list[int]) -> str:
        out, done = [], 0
        for place in triggers:
            start = place
            if start < done:
                continue
            while start > done and _BEFORE.match(text[start - 1]):
                start -= 1
            token = _TOKEN.match(text, start)
            if token and token.end() > place:
                out += [text[done:start], self.restore(token[0])]
                done = token.end()
        return "".join([*out, text[done:]]) if out else text
