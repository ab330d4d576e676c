"""Text decoded with the wrong character encoding: found, and restored where the bytes allow it.

Noisy-channel decoding. A stretch of text is turned back into the bytes of the encoding it may have been read with; these
form a lattice in which every character is either kept, or decoded anew alone or with its neighbours, and bytes that were
lost are wildcards. A Viterbi search finds the reading that is likeliest under the corpus' word frequencies; a stretch is
garbled if that reading beats the text as it stands by more than chance.
"""

from __future__ import annotations

import codecs
import html
import math
import re
from collections.abc import Iterator
from heapq import nlargest
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkforest.llm.lexicon import LETTER, WIDE, Lexicon, count_rows, sketch, units, whole
from sparkforest.plans.context import cut

LOST = "\ufffd"
# Single-byte encodings a page may be written in or read with.
SINGLE = (
    "cp1252", "latin-1", "cp1250", "iso8859-2", "cp1251", "koi8-r", "cp866", "iso8859-5", "mac-roman", "mac-cyrillic",
    "cp437", "cp850", "cp852", "cp1253", "iso8859-7", "cp1254", "cp1257",
)
# Multi-byte encodings a page may be written in.
MULTI = ("euc-jp", "cp932", "euc-kr", "gb18030", "big5")
# Multi-byte encodings UTF-8 pages are read with by mistake.
WIDE_READ = ("cp932", "gb18030")

UTF8_GAIN = 1.0
BYTE_GAIN = 2.3
LETTER_GAIN = 5.0
STRANGE = -20.0
ODD = 8.0
BROKEN = 9.0
UNSEEN = 20.0
KNOWN = 3
CACHE = 400_000
#: Tokens decided on once for all tasks.
SHARED = 100_000
BEAM = 24
KEPT = 12
SPAN = 64
PIECE = 24
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});")
_TOKEN = re.compile(r"[^ \t\n\r]+")
_UTF8 = re.compile("[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")
_BROKEN = re.compile("[\x80-\x9f\ufffd]")
_MARKS = "„“”\"«»‚‘’'「」『』"
_QUOTED = re.compile("[„“\"«‚‘'「『](.{1,60}?)[“”\"»’'」』](?!\\w)")
_PLAIN = "’‘”“„‚«»–—…·•©®™°§、。・「」『』（）！？：；\xa0\xad\u2009\u200b\u202f″′№€£§¿¡"


def _table(name: str) -> dict[str, int]:
    """Character to byte; bytes the encoding leaves undefined stand for themselves, as browsers read them."""
    out = {}
    for b in range(256):
        try:
            c = bytes((b,)).decode(name)
        except UnicodeDecodeError:
            c = chr(b)
        out.setdefault(c, b)
    if name == "cp1252":
        # Pages read as Latin-1 in part and as this in part hold the controls themselves.
        for b in range(0x80, 0xA0):
            out.setdefault(chr(b), b)
    return out


TO_BYTE = {w: _table(w) for w in SINGLE}
FROM_BYTE = {w: {b: c for c, b in reversed(t.items())} for w, t in TO_BYTE.items()}
_AS_LATIN = {w: {ord(c): b for c, b in t.items()} for w, t in TO_BYTE.items()}
# Which readings turn two neighbouring characters into a UTF-8 lead byte and a continuation byte.
_BIT = {w: 1 << i for i, w in enumerate(SINGLE)}
_LEAD = {w: {c for c, b in t.items() if 0xC2 <= b <= 0xF4} for w, t in TO_BYTE.items()}
_TAIL = {w: {c for c, b in t.items() if 0x80 <= b <= 0xBF} for w, t in TO_BYTE.items()}
_LEAD_BITS: dict[str, int] = {}
_TAIL_BITS: dict[str, int] = {}
for _w in SINGLE:
    for _of, _bits in ((_LEAD, _LEAD_BITS), (_TAIL, _TAIL_BITS)):
        for _c in _of[_w]:
            _bits[_c] = _bits.get(_c, 0) | _BIT[_w]
_AS_TEXT = {w: "".join(t[b] for b in range(256)) for w, t in FROM_BYTE.items()}
# Continuation bytes that fall out without a mark: those the encoding shows as controls, as a blank or not at all.
_GONE = {w: [b for b in range(0x80, 0xC0) if "\x80" <= (c := t.get(b, "\x80")) <= "\xa0" or c == "\xad"] for w, t in FROM_BYTE.items()}


def to_bytes(text: str, encoding: str) -> bytes | None:
    t = TO_BYTE[encoding]
    try:
        return bytes([t[c] for c in text])
    except KeyError:
        return None


def utf8_reading(text: str, read_as: str) -> str:
    """Every stretch whose bytes in ``read_as`` are UTF-8 decoded, the rest kept."""
    table = _AS_LATIN[read_as]
    shadow = "".join([chr(table[o]) if (o := ord(c)) in table else "\u0100" for c in text])
    out, at = [], 0
    for m in _UTF8.finditer(shadow):
        try:
            c = m[0].encode("latin-1").decode("utf-8")
        except UnicodeDecodeError:
            continue
        out += [text[at : m.start()], c]
        at = m.end()
    return "".join(out) + text[at:] if out else text


def wide_reading(text: str, read_as: str) -> str | None:
    try:
        return text.encode(read_as).decode("utf-8")
    except UnicodeError:
        return None


_second = itemgetter(1)


def script(c: str) -> int:
    """1 Latin, 2 Greek, 3 Cyrillic, 4 others, 5 those that write no spaces, 0 no letter."""
    if not c.isalpha():
        return 0
    return 1 if c < "\u0370" or "\u1e00" <= c <= "\u1eff" else 2 if c < "\u0400" else 3 if c < "\u0530" else 5 if WIDE.match(c) else 4


def oddness(text: str) -> float:
    """What speaks against a text by its shape alone: control characters, lost characters, symbols inside words, mixed scripts, capitals after small letters."""
    cost = BROKEN * len(_BROKEN.findall(text))
    last, last_script, before = "", 0, ""
    for c in text:
        script = 0
        if c < "\x80":
            kind = ""
            if c.isalpha():
                kind, script = "a", 1
        elif c.isalpha():
            kind = "a"
            script = 1 if c < "\u0370" or "\u1e00" <= c <= "\u1eff" else 2 if c < "\u0400" else 3 if c < "\u0530" else 4
        else:
            kind = "" if c in _PLAIN else "s"
        if kind and last:
            if kind != last:
                cost += ODD
            elif kind == "a":
                if script != last_script:
                    cost += ODD
                elif c.isupper() and before.islower():
                    cost += ODD / 2
        last, last_script, before = kind, script, c
    return cost


class Decoder:
    """Decides on single tokens, with the corpus' frequencies, and remembers what it decided."""

    def __init__(self, lexicon: Lexicon) -> None:
        self.lexicon = lexicon
        self.seen: dict[str, tuple[str, float, str] | None] = {}
        self.taken: dict[str, tuple[str, float, str] | None] | None = None
        self.alphabets: dict[int, list[str]] = {}
        self.shared: dict[int, dict[int | None, list[str]]] = {}
        self.contexts: dict[str, float] = {}
        self.steps: dict[tuple[str, str], float] = {}
        self.strange: dict[str, float] = {}
        self.groups: dict[tuple, tuple[str, ...]] = {}
        self.likely: dict[tuple[str, int], list[tuple[str, float]]] = {}
        self.sorted: dict[int, list[list[str]]] = {}

    def take(self, decided: pa.Table) -> None:
        """Takes over decisions made elsewhere with the same counts."""
        if self.taken is None:
            self.taken = {t: None if r is None else (r, g, c) for t, r, g, c in zip(*(decided.column(i).to_pylist() for i in range(4)))}

    def stranger(self, c: str) -> float:
        """What speaks against a letter that stands nowhere in the corpus; scripts of thousands of signs are left alone."""
        p = self.strange.get(c)
        if p is None:
            p = self.strange[c] = UNSEEN if c.isalpha() and c < "\u2e80" and not all(x < "\x80" or self.lexicon.count(LETTER + x) for x in c.lower()) else 0.0
        return p

    def score(self, text: str) -> float:
        return sum(self.lexicon.log_p(u) for u in units(text)) - oddness(text) - sum(self.stranger(c) for c in set(text) if c > "\x7f")

    def readings(self, token: str, deep: bool = True) -> Iterator[tuple[str, str]]:
        """(reading, channel): what the token may have been before UTF-8 was read wrongly, once or twice."""
        # The encodings in which two neighbouring characters are a lead byte and a continuation.
        bits = 0
        for a, b in zip(token, token[1:]):
            if a > "\x7f" and b > "\x7f":
                bits |= _LEAD_BITS.get(a, 0) & _TAIL_BITS.get(b, 0)
        found, once = set(), set()
        for w in SINGLE if bits else ():
            if not bits & _BIT[w]:
                continue
            r = utf8_reading(token, w)
            if r == token or r in once:
                continue
            once.add(r)
            if r not in found:
                found.add(r)
                yield r, f"utf-8>{w}"
            for r2, channel in self.readings(r, False) if deep else ():
                if r2 not in found:
                    found.add(r2)
                    yield r2, f"{channel}, utf-8>{w}"

    def byte_readings(self, token: str, every: bool = False) -> Iterator[tuple[str, str]]:
        """Readings of a token out of another single-byte or a multi-byte encoding, of which some word is known, or every one."""
        found = {token}
        known = lambda r: every or any(self.lexicon.count(u) > 0 for u in units(r))
        for w in SINGLE:
            raw = to_bytes(token, w)
            if raw is None:
                continue
            for e in SINGLE:
                if e == w:
                    continue
                r = codecs.charmap_decode(raw, "strict", _AS_TEXT[e])[0]
                if r not in found:
                    found.add(r)
                    if known(r):
                        yield r, f"{e}>{w}"
            for e in MULTI if len(raw) > 1 else ():
                try:
                    r = raw.decode(e)
                except UnicodeDecodeError:
                    continue
                if r not in found:
                    found.add(r)
                    if known(r):
                        yield r, f"{e}>{w}"
        for w in WIDE_READ:
            r = wide_reading(token, w)
            if r is not None and r not in found:
                found.add(r)
                if known(r):
                    yield r, f"utf-8>{w}"

    def step(self, context: str, c: str) -> float:
        """Log probability of a letter after the two before it, or the one where pairs are counted; of anything else 0, or little for what cannot be text."""
        p = self.steps.get((context, c))
        if p is None:
            if len(self.steps) > CACHE:
                self.steps.clear()
                self.contexts.clear()
            if c.isalpha():
                before = ("\x02" + context[-1] if WIDE.match(context[-1]) else "\x02") if WIDE.match(c) else context.lower()
                of = self.contexts.get(before)
                if of is None:
                    of = self.contexts[before] = self.lexicon.count("\x01" + before) + 4.0
                p = math.log((self.lexicon.count("\x01" + before + c.lower()) + 0.02) / of)
            else:
                p = -BROKEN if _BROKEN.match(c) else self.lexicon.log_p(c) if c > "\u2000" else 0.0
            self.steps[context, c] = p
        return p

    def alphabet(self, of: int) -> list[str]:
        """The small letters beyond ASCII of a script that stand in the corpus; of all that write spaces for 0."""
        found = self.alphabets.get(of)
        if found is None:
            all_of = map(chr, range(0x3000, 0x10000) if of == 5 else range(0x80, 0x3000))
            found = self.alphabets[of] = [c for c in all_of if c == c.lower() and (s := script(c)) and s in (of or s,) and self.lexicon.count(LETTER + c) > 0]
        return found

    def sharing(self, lead: int, tail: int | None) -> list[str]:
        """The characters of the corpus whose UTF-8 has this lead byte of three and, if one is left, this continuation."""
        found = self.shared.get(lead)
        if found is None:
            found = self.shared[lead] = {None: []}
            for o in range((lead & 15) << 12, ((lead & 15) + 1) << 12):
                if o >= 0x800 and not 0xD800 <= o < 0xE000 and self.lexicon.count(LETTER + chr(o)) > 0:
                    for b in {None, *chr(o).encode()[1:]}:
                        found.setdefault(b, []).append(chr(o))
        return found.get(tail, [])

    def choices(self, lead: int, tail: int | None, read_as: str, any_byte: bool) -> tuple[str, ...]:
        """What a lead byte, with the one continuation that is left of two, may have begun. Without a mark where it stood, what
        fell out must be a byte the encoding does not show."""
        key = lead, tail, read_as, any_byte
        found = self.groups.get(key)
        if found is None:
            lost = range(0x80, 0xC0) if any_byte else _GONE[read_as]
            if lead < 0xE0:
                out = [x for t in lost if (x := bytes((lead, t)).decode()).isalpha()]
            else:
                out = []
                for x in self.sharing(lead, tail):
                    rest = list(x.encode()[1:])
                    if tail is not None:
                        rest.remove(tail)
                    if all(t in lost for t in rest):
                        out.append(x)
            found = self.groups[key] = tuple(out)
        return found

    def gains(self, context: str, letters: list[str] | tuple[str, ...]) -> list[tuple[str, float]]:
        """step for many letters: the BEAM likeliest with their log probability."""
        sorts = self.sorted.get(id(letters))
        if sorts is None:
            kind = [0 if not c.isalpha() else 2 if c > "\u3000" and WIDE.match(c) else 1 for c in letters]
            sorts = self.sorted[id(letters)] = [[c for c, k in zip(letters, kind) if k == i] for i in range(3)]
        out = [(c, self.step(context, c)) for c in sorts[0]]
        for some, before in ((sorts[1], context.lower()), (sorts[2], "\x02" + context[-1] if WIDE.match(context[-1]) else "\x02")):
            if some:
                n = self.lexicon.counts(["\x01" + before + c.lower() for c in some])
                p = np.log((n + 0.02) / (self.lexicon.count("\x01" + before) + 4.0))
                out += [(some[i], float(p[i])) for i in np.argsort(-p, kind="stable")[:BEAM]]
        return nlargest(BEAM, out, key=_second)

    def likeliest(self, context: str, of: int | tuple[str, ...]) -> list[tuple[str, float]]:
        """The likeliest BEAM of some characters, or of a script's letters, after this context, with their log probability;
        more of one state never stay in the beam. Letters of a script are small: case is lost with the byte."""
        key = context, of if isinstance(of, int) else id(of)
        found = self.likely.get(key)
        if found is None:
            if len(self.likely) > CACHE // 4:
                self.likely.clear()
            found = self.likely[key] = self.gains(context, self.alphabet(of) if isinstance(of, int) else of)
        return found

    def lattice(self, token: str, read_as: str | None, odd: bool) -> list[list[tuple[int, str | tuple[str, ...]]]]:
        """Per position what may be read there: (characters used, text or several to choose from), an empty text standing for any
        letter the corpus knows. A lost character is such a wildcard; a UTF-8 lead byte whose continuation was lost is one over the letters it may
        begin, in a token of odd shape also a lead byte of three over the characters that share the bytes that are left."""
        table = TO_BYTE.get(read_as or "", {})
        out: list[list[tuple[int, str | tuple[str, ...]]]] = []
        for i, c in enumerate(token):
            b = table.get(c, 0)
            after = table.get(token[i + 1], 0) if i + 1 < len(token) else 0
            ways: list = [(1, c)]
            if c == LOST:
                ways = [(n, "") for n in (1, 2, 3) if token[i : i + n] == LOST * n]
            if 0xC2 <= b <= 0xDF:
                if 0x80 <= after <= 0xBF:
                    ways = [(2, bytes((b, after)).decode())]
                else:
                    marked = token[i + 1 : i + 2] == LOST
                    if some := self.choices(b, None, read_as, marked or i + 1 == len(token)):
                        ways.append((1 + marked, some))
                    if b == 0xC3 and after == 0xC2:  # both continuations of a letter read wrongly twice
                        ways.append((2, ""))
            elif 0xE0 <= b <= 0xEF:
                used = 1
                while used < 3 and i + used < len(token) and (token[i + used] == LOST or 0x80 <= table.get(token[i + used], 0) <= 0xBF):
                    used += 1
                rest = token[i + 1 : i + used]
                left, marked = [table[x] for x in rest if x != LOST], LOST in rest
                if len(left) == 2:
                    try:
                        ways = [(3, bytes((b, *left)).decode())]
                    except UnicodeDecodeError:
                        pass
                elif odd and (some := self.choices(b, left[0] if left else None, read_as, marked)):
                    ways.append((used, some))
            out.append(ways)
        return out

    def viterbi(self, lattice: list[list[tuple[int, str | tuple[str, ...]]]], of: int) -> list[str]:
        """The likeliest paths by the letters' model, for the words' model to choose from."""
        best: list[dict[str, float]] = [{} for _ in range(len(lattice) + 1)]
        best[0][""] = 0.0
        steps, likely = self.steps, self.likely
        for i, ways in enumerate(lattice):
            # The beam keeps several states with the same last letters, since the words' model decides last.
            states = best[i].items()
            for text, p in nlargest(BEAM, states, key=_second) if len(states) > BEAM else states:
                context = ("\x02" + text)[-2:] if text and text[-1].isalpha() else "\x02"
                for used, c in ways:
                    ends = best[i + used]
                    if c and c.__class__ is str:
                        gain = steps.get((context, c))
                        q = p + (self.step(context, c) if gain is None else gain)
                        if q > ends.get(text + c, -math.inf):
                            ends[text + c] = q
                        continue
                    group = c or of
                    for x, gain in likely.get((context, group if group.__class__ is int else id(group))) or self.likeliest(context, group):
                        q = p + gain
                        if q > ends.get(text + x, -math.inf):
                            ends[text + x] = q
        return [t for t, _ in nlargest(KEPT, best[-1].items(), key=_second)]

    def pieces(self, token: str) -> list[str]:
        """A long token, such as a clause in a script without spaces, cut between characters, each with some context."""
        tails = _TAIL["cp1252"] | _TAIL["latin-1"]
        out, start = [], 0
        for i in range(1, len(token)):
            if i - start >= PIECE and token[i] not in tails and LOST not in token[i - 1 : i + 1]:
                out.append(token[start:i])
                start = i
        return [*out, token[start:]]

    def damaged(self, token: str) -> tuple[str, float, str] | None:
        """The likeliest whole reading of a token that lost bytes, if one known word stands out; of a long one, piece by piece."""
        if len(token) <= SPAN:
            return self.one_damaged(token)
        out, gain, channels = [], 0.0, []
        for piece in self.pieces(token):
            r = self.one_damaged(piece) if len(piece) <= 4 * SPAN else None
            if r is None:
                r = max(((x, self.score(x) - self.score(piece), c) for x, c in self.readings(piece, False)), key=lambda x: x[1], default=None)
                r = r if r is not None and r[1] >= UTF8_GAIN else None
            else:
                channels.append(r[2])
            out.append(r[0] if r is not None else piece)
            gain += r[1] if r is not None else 0.0
        return ("".join(out), gain, max(channels, key=channels.count)) if channels else None

    def one_damaged(self, token: str) -> tuple[str, float, str] | None:
        if not any(c.isalpha() for c in token):
            return None
        own, odd = self.score(token), oddness(token) > 0
        found: dict[str, tuple[float, str]] = {}
        tried = []
        scripts = {x for c in token if (x := script(c))}
        own_script = 5 if 5 in scripts else scripts.pop() if len(scripts) == 1 else 0
        # A token of sound shape is read through the commonest encodings only.
        for w in (None, *SINGLE) if odd else (None, "cp1252", "latin-1", "cp1250", "cp1251"):
            lattice = self.lattice(token, w, odd)
            if lattice in tried or all(len(ways) == 1 and ways[0][1] for ways in lattice):
                continue
            tried.append(lattice)
            for r in self.viterbi(lattice, 0 if w else own_script):
                if r != token and LOST not in r:
                    s = self.score(r)
                    if r not in found or s > found[r][0]:
                        found[r] = (s, f"utf-8>{w}, lost" if w else "lost")
        order = sorted(found.items(), key=lambda x: -x[1][0])
        if not order or len(order) > 1 and order[0][1][0] - order[1][1][0] < 1.0:
            return None
        r, (s, channel) = order[0]
        return (r, s - own, channel) if s - own >= UTF8_GAIN and all(self.lexicon.count(u) >= KNOWN for u in units(r)) else None

    def leftover(self, reading: str, channel: str) -> bool:
        """Whether a reading still holds what a channel from UTF-8 leaves of a character whose other bytes were lost: a lone
        lead byte, or a control, in no token the corpus knows."""
        if _BROKEN.search(reading):
            return True
        leads = [_LEAD[w] for w in {c.split(">")[1] for c in channel.split(", ") if c.startswith("utf-8>")} if w in _LEAD]
        return any(c > "\x7f" and c in lead for lead in leads for c in reading) and self.lexicon.count(whole(reading)) < KNOWN

    def outweighs(self, reading: str, token: str) -> bool:
        """Whether a reading is better by its shape, or stands in the corpus at least as often as the token. Words are scored one
        by one, so "it’s" is less likely than any single word that takes the mark for a letter; counted whole it is not."""
        return oddness(token) > oddness(reading) or self.lexicon.count(whole(reading)) >= self.lexicon.count(whole(token))

    def token(self, token: str) -> tuple[str, float, str] | None:
        """(reading, gain, channel) of the likeliest reading of a token with characters beyond ASCII, or None where it stands best."""
        if token in self.seen:
            return self.seen[token]
        if self.taken is not None and token in self.taken:
            return self.taken[token]
        own, parts = self.score(token), units(token)
        best: tuple[str, float, str] | None = None
        for r, channel in self.readings(token):
            gain = self.score(r) - own
            if best is None or gain > best[1]:
                best = (r, gain, channel)
        if best is not None and best[1] >= UTF8_GAIN:
            # Intact pairs beside bytes that lost theirs: the lattice reads both, from the token or, if garbled twice, from the reading.
            if self.leftover(best[0], best[2]):
                r, _, channel = best
                for again, by in ((self.damaged(token), ""), (self.damaged(r), f"{channel}, lost")):
                    if again is not None and (more := self.score(again[0]) - own) > best[1]:
                        best = (again[0], more, by or again[2])
        else:
            best = None
            # One letter is little evidence for another alphabet, and symbols alone are none.
            n = sum(map(str.isalpha, token))
            least = BYTE_GAIN if n > 1 else LETTER_GAIN
            for r, channel in self.byte_readings(token, n > 1 and own < STRANGE * len(parts)) if LOST not in token else ():
                gain = self.score(r) - own
                if gain >= least and self.outweighs(r, token) and (best is None or gain > best[1]):
                    best = (r, gain, channel)
            if best is None or oddness(best[0]):
                whole = self.damaged(token)
                if whole is not None and (best is None or whole[1] > best[1]):
                    best = whole
        if len(self.seen) > CACHE:
            self.seen.clear()
        self.seen[token] = best
        return best

    def through(self, token: str, channel: str) -> str | None:
        """The token read anew through a channel that another token of its line has shown; None if it doesn't pass."""
        r: str | None = token
        for step in reversed([c for c in channel.split(", ") if c != "lost"]):
            if r is None:
                return None
            e, w = step.split(">")
            if e == "utf-8":
                r = wide_reading(r, w) if w in WIDE_READ else utf8_reading(r, w)
            else:
                raw = to_bytes(r, w)
                try:
                    r = None if raw is None else "".join([FROM_BYTE[e][b] for b in raw]) if e in FROM_BYTE else raw.decode(e)
                except UnicodeDecodeError:
                    return None
        return r

    def hits(self, line: str) -> dict[str, tuple[str, float, str] | None]:
        """The garbled tokens of a line with their best reading, None where there is none.

        A token quoted as a sample beside what it should read, also in quotation marks, is no hit.
        """
        found = {t: r for t in _TOKEN.findall(line) if not t.isascii() and ((r := self.token(t)) is not None or _BROKEN.search(t))}
        quoted = set(_QUOTED.findall(line)) if found else ()
        if len(quoted) > 1:
            samples = set()
            for core in quoted:
                if not core.isascii():
                    own = self.token(core)
                    should = {r for r, _ in self.readings(core)} | ({own[0]} if own is not None else set())
                    if should & quoted or LOST in core:
                        samples |= {core} | (should & quoted)
            for t in list(found):
                inner = t.strip(".,;:!?()")
                if {inner.strip(_MARKS), inner[1:-1]} & samples:
                    found.pop(t)
        return found

    def restored(self, line: str, hits: dict[str, tuple[str, float, str] | None], weight: dict[str, float]) -> tuple[str, int]:
        """(line read anew, tokens still damaged). The channel that has most evidence in the whole text decides where a token
        alone could have come through several, and on the tokens beside it that no word model can judge."""
        own = {r[2] for r in hits.values() if r is not None}
        main = max(own, key=lambda c: (weight[c], c)) if own else None
        left = 0
        put: dict[str, str] = {}
        for t in dict.fromkeys(_TOKEN.findall(line)):
            if t.isascii():
                continue
            r = hits.get(t)
            new, channel = (r[0], r[2]) if r is not None else (t, "")
            # A lattice's reading through the main channel is the same evidence, and more whole.
            if main is not None and (r is None or r[2].removesuffix(", lost") != main.removesuffix(", lost")):
                other = self.through(t, main)
                # A token that is no hit must gain, clearly where UTF-8 is no witness; one of a weaker channel must not lose.
                least = self.score(t) + (0.0 if main.startswith("utf-8") else UTF8_GAIN) if t not in hits else self.score(t) if r is None or weight[main] > 2 * weight[r[2]] else self.score(new)
                if other is not None and other != t and self.score(other) >= least:
                    new, channel = other, main
            put[t] = new
            left += self.leftover(new, channel) or (t in hits and new == t)
        return _TOKEN.sub(lambda m: put.get(m[0], m[0]), line), left

    def text(self, text: str | None) -> tuple[str, int, int, list[str]] | None:
        """(text read anew, lines garbled, tokens still damaged, channels), or None for a sound text. Character entities are
        resolved first: those of a sound text give a sound text."""
        if not text:
            return None
        whole = text
        if "&" in whole:
            for _ in range(2):
                if _ENTITY.search(whole):
                    whole = html.unescape(whole)
        if whole.isascii():
            return None
        lines = whole.split("\n")
        found = {i: h for i, x in enumerate(lines) if not x.isascii() and (h := self.hits(x))}
        if not found:
            return None
        weight: dict[str, float] = {}
        for h in found.values():
            for r in h.values():
                if r is not None:
                    weight[r[2]] = weight.get(r[2], 0.0) + r[1]
        left = 0
        for i, h in found.items():
            lines[i], n = self.restored(lines[i], h, weight)
            left += n
        return "\n".join(lines), len(found), left, sorted(weight)


RESTORED = "doc_id bigint, restored_text string, garbled_lines int, damaged_tokens int, channels array<string>"
_DECODERS: dict[int, tuple[np.ndarray, Decoder]] = {}


def _decoder(table: np.ndarray) -> Decoder:
    """The decoder of these counts. The table is held, so that no other one can come to lie in its place."""
    held = _DECODERS.get(id(table))
    if held is None:
        _DECODERS.clear()
        held = _DECODERS[id(table)] = table, Decoder(Lexicon(table))
    return held[1]


def decide(tokens: DataFrame, table) -> DataFrame:
    """(token, reading, gain, channel) of every token of ``tokens(token)``; reading is null where the token stands best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(table.value)
        for b in batches:
            own = b.column(0).to_pylist()
            found = [decoder.token(t) or (None, None, None) for t in own]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([r[i] for r in found], kind) for i, kind in enumerate((pa.string(), pa.float64(), pa.string())))], names=["token", "reading", "gain", "channel"])

    return tokens.mapInArrow(run, "token string, reading string, gain double, channel string")


def restore_garbled(documents: DataFrame) -> DataFrame:
    """(doc_id, restored_text, garbled_lines, damaged_tokens, channels): the documents with text decoded wrongly, one row each.

    Pass 1 counts the words of all documents into a table of fixed size, and the tokens beyond ASCII. The SHARED most frequent
    of these are decided on once, spread over all tasks; every task decides on the others itself, and remembers. Pass 2
    decodes every line of every whole text with these decisions. damaged_tokens counts what could not be restored; where
    it is 0 the text is whole again. Documents without text, and sound ones, give no row. No text is shuffled; the table,
    8 MB whatever the corpus holds, and the shared decisions, at most SHARED tokens of SHARED_CHARS, are broadcast.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    sc = documents.sparkSession.sparkContext
    own = documents.select("doc_id", "text").where(F.col("text").isNotNull())
    counted = cut(count_rows(own))
    shared = sc.broadcast(sketch(counted).astype(np.float32))
    # Tokens dear to decide on lie anywhere: many small tasks share the work.
    often = counted.where("token is not null").orderBy(F.col("n").desc(), "token").limit(SHARED).select("token").repartition(4 * sc.defaultParallelism, "token")
    decided = sc.broadcast(decide(often, shared).toArrow())
    arrow = to_arrow_schema(StructType.fromDDL(RESTORED))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(shared.value)
        decoder.take(decided.value)
        for b in batches:
            out = []
            for d, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                r = decoder.text(t)
                if r is not None:
                    out.append({"doc_id": d, "restored_text": r[0], "garbled_lines": r[1], "damaged_tokens": r[2], "channels": r[3]})
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return own.mapInArrow(run, RESTORED)
