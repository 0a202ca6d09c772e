"""Token counts by dynamic programming over prefixes.

For a byte-level BPE the encoding of every prefix ends in exactly one token, and that token is the
one whose pair with the last token of the shorter prefix is stable under the merges.  So one pass
gives, for each prefix of a piece, its exact token count; a text's prefix counts are running sums over
its pieces.  Where only a piece's own count is asked for, the recurrence starts at its end and works out the
prefixes that it meets, once for all pieces that share them.  ``PrefixCounts`` answers "how many tokens has this prefix" and "how far does this budget
reach" from those sums, without encoding again.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sieveyard.llm.worker_cache import held

#: Fixed value: the piece pattern of the byte-level vocabulary.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same for texts of characters of which Python's own classes say what the pattern's say, at twice the speed.
QUICK = r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
OUTSIDE = "[^\x00-\x1b\x20-\xb1\xb4-\xb8\xba\xbb\xbf-\u024f\u2010-\u2027\u2030-\u205e\u20ac]"


def byte_letters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = {chr(b): b for b in plain}
    out.update({chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    return out


#: Longer pieces are not kept in a cache.
LONGEST_KEPT = 64
#: A space beside other white space.  Without any, each space starts a piece, so that stretches between spaces are counted one by one.
BESIDE = re.compile(r" \s|\s ")
#: Marks that are a piece of their own at the end of a stretch of letters.
MARKS = frozenset(".,;:!?")


class Spaced(dict):
    """A bounded cache: stretch without spaces -> token count of a space and the stretch."""

    def __init__(self, counter: PrefixCounter):
        super().__init__()
        self.counter = counter

    def __missing__(self, stretch: str) -> int:
        counter = self.counter
        if stretch.isalpha() and not counter.outside.search(stretch):  # one piece, kept here only
            n = counter.whole_count(" " + stretch)
        elif stretch[-1:] in MARKS and stretch[:-1].isalpha() and not counter.outside.search(stretch):
            n = self[stretch[:-1]] + counter[stretch[-1]]
        else:
            text = " " + stretch
            n = sum(map(counter.__getitem__, counter.pattern(text).findall(text)))
        if len(stretch) <= LONGEST_KEPT:
            if len(self) > counter.most:
                self.clear()
            self[stretch] = n
        return n


class PrefixCounter(dict):
    """A bounded cache: piece -> token count; ``prefixes(piece)`` gives the count at every byte prefix.

    Tokens are numbered by bytes first, then by the merge that makes them.
    """

    def __init__(self, path: str, most: int = 600_000):
        super().__init__()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        self.special = special = [t["content"] for t in spec["added_tokens"]]
        self.vocab = {bytes([b]): b for b in range(256)}
        self.made: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int]] = [(b, b) for b in range(256)]
        for i, m in enumerate(spec["model"]["merges"], 256):
            a, b = map(raw, m.split(" ") if isinstance(m, str) else m)
            self.parts.append((self.vocab[a], self.vocab[b]))
            self.made[self.parts[-1]] = self.vocab[a + b] = i
        self.longest: dict[bytes, int] = {}  # by a token's last three bytes
        sizes: dict[bytes, set[int]] = {}
        for token in self.vocab:
            if len(token) > 2:
                self.longest[token[-3:]] = max(len(token), self.longest.get(token[-3:], 0))
                sizes.setdefault(token[-3:], {1, 2}).add(len(token))
        self.sizes = {end: sorted(n, reverse=True) for end, n in sizes.items()}  # the sizes there are, by the same
        self.split = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.pieces = regex.compile(PIECES)
        self.quick = re.compile(QUICK)
        self.outside = re.compile(OUTSIDE)
        self.white = regex.compile(r"\s+")
        self.spaced: dict[str, int] = Spaced(self)
        self.ends: dict[bytes, int] = {}  # shared by all pieces, so that no prefix is worked out twice
        self.stable: dict[int, bool] = {}
        self.whole: dict[int, bool] = {}
        self.most = most

    def itself(self, token: int) -> bool:
        """Whether merging the token's own bytes ends in that token."""
        ok = self.whole.get(token)
        if ok is None:
            a, b = self.parts[token]
            ok = self.whole[token] = token < 256 or (self.itself(a) and self.itself(b) and self.apart(a, b, token))
        return ok

    def apart(self, a: int, b: int, below: int = 1 << 60) -> bool:
        """Whether no merge numbered under ``below`` joins the end of ``a`` to the start of ``b`` too early.

        The later of the two tokens' merges is undone step by step; a merge across the border wins if
        it comes before the merge undone last, or equals it and stands to its left.
        """
        made = self.made.get
        while True:
            if made((a, b), below) < below:
                return False
            if a > b:
                below, a = a, self.parts[a][1]
            elif b >= 256:
                below, b = b + 1, self.parts[b][0]
            else:
                return True
            if a < 256 and b < 256:
                return made((a, b), below) >= below

    def prefixes(self, piece: str) -> list[int]:
        """Token counts of the piece's byte prefixes of length 0, 1, ..."""
        data = piece.encode()
        last, count = [-1], [0]
        token_of, stable, longest, whole = self.vocab.get, self.stable, self.longest.get, self.whole
        for i in range(1, len(data) + 1):
            most = longest(data[i - 3 : i], 2) if i > 2 else i
            for j in range(i - most if i > most else 0, i):
                token = token_of(data[j:i])
                if token is not None:
                    if j:
                        key = last[j] << 20 | token
                        ok = stable.get(key)
                        if ok is None:
                            if len(stable) > self.most:
                                stable.clear()
                            ok = stable[key] = self.itself(token) and self.apart(last[j], token)
                    else:
                        ok = whole.get(token)
                        if ok is None:
                            ok = self.itself(token)
                    if ok:
                        last.append(token)
                        count.append(count[j] + 1)
                        break
            else:
                raise ValueError(f"no token ends the prefix {data[:i]!r}")
        return count

    def ended(self, data: bytes) -> int:
        """Last token (upper bits) and token count (lower 20) of ``data``, by those of the shorter prefixes that this takes and no others."""
        size, token_of, stable, ends = len(data), self.vocab.get, self.stable, self.ends
        for n in self.sizes.get(data[-3:], (2, 1)):
            if n < size:
                token = token_of(data[-n:])
                if token is None:
                    continue
                before = data[:-n]
                past = ends.get(before)
                if past is None:
                    past = self.ended(before)
                key = past >> 20 << 20 | token
                ok = stable.get(key)
                if ok is None:
                    if len(stable) > self.most:
                        stable.clear()
                    ok = stable[key] = self.itself(token) and self.apart(past >> 20, token)
                if ok:
                    out = token << 20 | (past & 0xFFFFF) + 1
                    break
            elif n == size:
                token = token_of(data)
                if token is not None and self.itself(token):
                    out = token << 20 | 1
                    break
        else:
            raise ValueError(f"no token ends the prefix {data!r}")
        if len(ends) > self.most:
            ends.clear()
        ends[data] = out
        return out

    def whole_count(self, piece: str) -> int:
        """The piece's own token count: the same recurrence as ``prefixes``, from its end."""
        if len(piece) > LONGEST_KEPT:
            return self.prefixes(piece)[-1]
        return self.ended(piece.encode()) & 0xFFFFF

    def __missing__(self, piece: str) -> int:
        if len(self) > self.most:
            self.clear()
        n = self.whole_count(piece)
        if len(piece) <= LONGEST_KEPT:
            self[piece] = n
        return n

    def segments(self, text: str) -> Iterator[tuple[int, int, bool]]:
        """Start, end and whether it is a special string; ordinary stretches may be empty."""
        at = 0
        for m in self.split.finditer(text) if self.split else ():
            yield at, m.start(), False
            yield m.start(), m.end(), True
            at = m.end()
        yield at, len(text), False

    def pattern(self, text: str):
        return self.pieces if self.outside.search(text) else self.quick

    def count(self, text: str) -> int:
        find = self.pattern(text).findall
        if not any(s in text for s in self.special):
            if BESIDE.search(text):
                return sum(map(self.__getitem__, find(text)))
            first, _, rest = text.partition(" ")
            n = sum(map(self.__getitem__, find(first)))
            return n + sum(map(self.spaced.__getitem__, rest.split(" "))) if _ else n
        return sum(1 if special else sum(map(self.__getitem__, find(text[a:b]))) for a, b, special in self.segments(text))

    def count_and_reach(self, text: str, budget: int) -> tuple[int, int]:
        """``count`` and the most code points whose tokens stay within ``budget``.

        Where spaces part the text, only the stretch in which the budget ends is looked into.
        """
        if any(s in text for s in self.special) or BESIDE.search(text):
            n = self.count(text)
            return n, len(text) if n <= budget else PrefixCounts(self, text, budget).reach(budget)
        first, *rest = text.split(" ")
        counts = [sum(map(self.__getitem__, self.pattern(first).findall(first))), *map(self.spaced.__getitem__, rest)]
        n = sum(counts)
        if n <= budget:
            return n, len(text)
        left = budget
        for k, c in enumerate(counts):
            if c > left:
                break
            left -= c
        if not k:
            return n, PrefixCounts(self, first, left).reach(left)
        at = len(first) + sum(map(len, rest[: k - 1])) + k - 1
        return n, at + PrefixCounts(self, " " + rest[k - 1], left).reach(left)


class PrefixCounts:
    """Exact token counts of every prefix of one text.

    A piece cut short is one piece still, so its own prefix counts answer for it.  So is a run of white space, of which the full text may
    give the last character to the next piece.  Only cut contractions (under four characters) and cut special strings are counted anew.
    """

    def __init__(self, counter: PrefixCounter, text: str, upto: int | None = None):
        """With ``upto`` only as far as the first piece that goes beyond so many tokens."""
        self.counter, self.text = counter, text
        total = 0
        self.specials: list[tuple[int, int]] = []
        ends, counts = [0], [0]
        find = counter.pattern(text).finditer
        for a, b, special in counter.segments(text):
            if special:
                self.specials.append((a, b))
                ends.append(b)
                counts.append(1)
                total += 1
            else:
                for m in find(text[a:b]):
                    ends.append(a + m.end())
                    counts.append(counter[m.group()])
                    total += counts[-1]
                    if upto is not None and total > upto:
                        break
            if upto is not None and total > upto:
                break
        self.ends, self.sums = ends, list(accumulate(counts))
        self._of: tuple[int, int] | None = None
        self._counts: list[int] = []

    def total(self) -> int:
        return self.sums[-1]

    def _prefixes(self, start: int, stop: int) -> list[int]:
        """Token counts of ``text[start:start]`` to ``text[start:stop]``, each as one piece."""
        if self._of != (start, stop):
            piece = self.text[start:stop]
            counts = self.counter.prefixes(piece)
            if not piece.isascii():
                counts = [counts[i] for i in accumulate((len(c.encode()) for c in piece), initial=0)]
            self._of, self._counts = (start, stop), counts
        return self._counts

    def _run(self, k: int) -> tuple[int, int, int]:
        """Of the white space at the start of piece ``k``: the piece its run starts with, and where that starts and ends."""
        white = self.counter.white
        while k and white.fullmatch(self.text, self.ends[k - 1], self.ends[k]):
            k -= 1
        return k, self.ends[k], white.match(self.text, self.ends[k]).end()

    def _special(self, chars: int) -> int | None:
        """The start of the special string that ends or is cut at ``chars``."""
        i = bisect_left(self.specials, (chars, 0)) - 1
        return self.specials[i][0] if i >= 0 and chars <= self.specials[i][1] else None

    def at(self, chars: int) -> int:
        """Tokens of the text's first ``chars`` code points, which reach no further than the pieces counted.

        A cut inside a special string makes ordinary text of its start, to which the piece before it runs on.
        """
        if chars <= 0:
            return 0
        k = bisect_left(self.ends, chars) - 1
        start, stop = self.ends[k], self.ends[k + 1]
        special = self._special(chars)
        if special is not None:
            if chars == stop:
                return self.sums[k + 1]
            k = max(0, bisect_left(self.ends, special) - 1)
            return self.sums[k] + self.counter.count(self.text[self.ends[k] : chars])
        if self.counter.white.match(self.text, chars - 1):
            k, start, stop = self._run(k)
            return self.sums[k] + self._prefixes(start, stop)[chars - start]
        if chars == stop:
            return self.sums[k + 1]
        if self.text[start] == "'" and self.text[start + 1].isalpha():
            return self.sums[k] + self.counter.count(self.text[start:chars])
        return self.sums[k] + self._prefixes(start, stop)[chars - start]

    def reach(self, budget: int) -> int:
        """The most code points whose tokens stay within ``budget``.

        That is the end of the last piece within it, or a cut in the piece after it, in white space that runs on from there or in a special string behind it.
        """
        k = bisect_right(self.sums, budget) - 1
        if k == len(self.sums) - 1:
            return len(self.text)
        start, stop = self.ends[k], self.ends[k + 1]
        best = start
        if self._special(stop) is not None or self.text[start] == "'":
            best = max((p for p in range(start + 1, stop) if self.at(p) <= budget), default=best)
        else:
            cuts = self._prefixes(start, stop)
            best = start + max(i for i, n in enumerate(cuts) if self.sums[k] + n <= budget)
        if self.counter.white.match(self.text, start):
            at, first, last = self._run(k)
            cuts = self._prefixes(first, last)
            best = max(best, first + max(i for i, n in enumerate(cuts) if self.sums[at] + n <= budget))
        if self.counter.special and (m := self.counter.split.match(self.text, stop)):
            before = self.text[start:stop]
            best = max((p for p in range(stop + 1, m.end()) if self.sums[k] + self.counter.count(before + self.text[stop:p]) <= budget), default=best)
        return best


def token_counts(docs: DataFrame, path: str, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit, fit_chars`` for every row of ``docs``.

    ``fit_chars`` is the number of code points of the longest prefix that has at most ``limit`` tokens.
    Null and empty text: 0 bytes, 0 tokens, not over, 0 characters.  Repeated rows, null ids and other
    columns pass; each input row gives one output row.  One map over the rows: nothing is shuffled.
    """

    def run(batches):
        counter = held(("token counts", path), lambda: PrefixCounter(path))
        for batch in batches:
            tokens, reach, size = [], [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                size.append(len(text.encode()))
                n, fit = counter.count_and_reach(text, limit)
                tokens.append(n)
                reach.append(fit)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(size, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_()), pa.array(reach, pa.int64())],
                names=["id", "n_bytes", "n_tokens", "over_limit", "fit_chars"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long, over_limit boolean, fit_chars long")
    return out.withColumnRenamed("id", id_col)
