"""Token ids of byte-level BPE vocabularies, of any text in time by its length.

The pre-token pattern looks ahead behind a run of white space, and where a run is very long its matcher gives up. So
long runs are cut out before. A run starts a pre-token, as no other takes white space after something else; it ends before
its last character, which goes with what follows, or with the text. What lies between is one pre-token and is merged as such.
"""

from __future__ import annotations

import base64
import re

#: The pre-token pattern of the public byte-level BPE files: fixed.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Unicode's white space.
SPACES = "\t\n\v\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: White space from which on a run is cut out.
LONG = 10_000
_RUN = re.compile(f"(?<![{SPACES}])[{SPACES}]{{{LONG},}}")


class Vocabulary:
    """Merge ranks by their bytes; strings of special tokens are ordinary text."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.size = max(ranks.values()) + 1
        self._by_pattern = tiktoken.Encoding("by_pattern", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._as_one = tiktoken.Encoding("as_one", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})

    @classmethod
    def read(cls, data: bytes) -> Vocabulary:
        """From a file of lines, each a token's bytes in base 64 and its rank."""
        return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())})

    def encode(self, text: str) -> list[int]:
        if len(text) < LONG:
            return self._by_pattern.encode_ordinary(text)
        out, at = [], 0
        for m in _RUN.finditer(text):
            stop = m.end() - (m.end() < len(text))
            out += self._by_pattern.encode_ordinary(text[at : m.start()]) + self._as_one.encode_ordinary(text[m.start() : stop])
            at = stop
        return out + self._by_pattern.encode_ordinary(text[at:])


_KNOWN: dict[int, Vocabulary] = {}


def vocabulary(data: bytes) -> Vocabulary:
    """This worker's vocabulary of a broadcast file: built once."""
    key = hash(data)
    if key not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[key] = Vocabulary.read(data)
    return _KNOWN[key]
