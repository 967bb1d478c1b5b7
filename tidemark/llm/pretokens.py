"""Texts as chunks that tokenize independently, and a bounded cache of what each chunk becomes.

The split pattern ends a piece wherever a run of white space begins, whatever stands on either
side. In a plain text, whose only white space is single blanks and line feeds, each of these and
the word after it is thus a chunk whose pieces do not depend on the rest, and chunks repeat often.
Such a text is cut at its blanks into parts, after a blank has been put before each line feed: a part that
begins with a line feed is a chunk as it stands, the others but the first have a blank before them. Other
texts are split by the pattern itself.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex

PATTERN = regex.compile(public_tokenizers.PATTERN)

#: What a plain text does not hold: runs of white space, and white space of other kinds.
_RUNS = ("  ", " \n", "\n ", "\n\n")
_OTHER = tuple("\t\x0b\x0c\r")
_WIDE = tuple("\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B))))


def is_plain(text: str) -> bool:
    return not (any(x in text for x in _RUNS) or any(x in text for x in _OTHER)
                or not text.isascii() and any(x in text for x in _WIDE))


def chunk(part: str) -> str:
    """The text that a part other than the first stands for."""
    return part if part.startswith("\n") else " " + part


#: Marks that are a piece by themselves between a word and white space.
_MARKS = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def pieces(part: str) -> list[str]:
    """The pieces of a part other than the first. Most are a word, or a word and a mark."""
    if part.isalpha():
        return [" " + part]
    if part[-1:] in _MARKS and part[:-1].isalpha():
        return [" " + part[:-1], part[-1]]
    if part[:1] == "\n" and part[1:].isalpha():
        return ["\n", part[1:]]
    return PATTERN.findall(chunk(part))


def encode_all(texts: Sequence[str], of_text: Callable[[str], bytes], of_first: Callable[[str], bytes],
               of_part: Callable[[str], bytes], kind: np.dtype) -> list[bytes]:
    """The packed ids of texts, some thousand at a time: plain texts are cut into parts by Arrow, each
    distinct part is looked up once, and the ids are gathered. ``of_first`` encodes a text's first part,
    which has no blank before it, and ``of_text`` a text that is not plain."""
    out = [b""] * len(texts)
    plain = []
    for i, text in enumerate(texts):
        if is_plain(text):
            plain.append(i)
        else:
            out[i] = of_text(text)
    if not plain:
        return out
    split = pc.split_pattern(pa.array([texts[i].replace("\n", " \n") for i in plain], pa.large_string()), " ")
    bounds = split.offsets.to_numpy().astype(np.int64)
    coded = split.flatten().dictionary_encode()
    which = coded.indices.to_numpy().astype(np.int64)
    distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    packed = [*map(of_part, distinct), *(of_first(distinct[k]) for k in which[bounds[:-1]])]
    which[bounds[:-1]] = len(distinct) + np.arange(len(plain))
    size = np.fromiter(map(len, packed), np.int64, len(packed)) // kind.itemsize
    first = np.cumsum(size) - size
    length = size[which]
    ends = np.cumsum(length)
    place = np.arange(int(ends[-1]), dtype=np.int32)
    place += np.repeat((first[which] - (ends - length)).astype(np.int32), length)
    ids = np.frombuffer(b"".join(packed), kind)[place]
    lo = 0
    for i, hi in zip(plain, ends[bounds[1:] - 1].tolist(), strict=True):
        out[i] = ids[lo:hi].tobytes()
        lo = hi
    return out


class Memo(dict):
    """part -> packed ids, in at most ``limit`` bytes. ``make`` fills in what is missing. The first
    half of the bytes goes to entries that stay, as frequent parts come first; later ones share the
    other half, which starts anew when full. Parts longer than ``LONGEST`` are not kept."""

    LONGEST = 256
    #: What an entry takes beside its characters and bytes: two objects and its share of the table.
    EACH = 200

    def __init__(self, make: Callable[[str], bytes], limit: int) -> None:
        super().__init__()
        self.make, self.half = make, limit // 2
        self.young: dict[str, bytes] = {}
        self.held = self.recent = 0

    def __missing__(self, part: str) -> bytes:
        value = self.young.get(part)
        if value is None:
            value = self.make(part)
            if len(part) > self.LONGEST:
                return value
            size = self.EACH + len(part) + len(value)
            if self.held + size <= self.half:
                self[part] = value
                self.held += size
            else:
                if self.recent + size > self.half:
                    self.young = {}
                    self.recent = 0
                self.young[part] = value
                self.recent += size
        return value

    def clear(self) -> None:
        super().clear()
        self.young = {}
        self.held = self.recent = 0
