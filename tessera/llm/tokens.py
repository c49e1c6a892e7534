"""Token ids of whole texts from a public tokenizer file."""

from __future__ import annotations

import json
import os
from array import array
from collections.abc import Sequence

END = 2
#: Words whose ids a worker keeps at a time, at some 200 bytes each; beyond it the store starts anew.
KEPT_WORDS = 1_400_000
#: Words that go through the library as one text, apart by what always becomes one id.
GLUED = 64
_READY: dict[str, Encoder] = {}

#: White space other than a space or a newline; a text that holds any is encoded whole.
_ODD_ASCII = "\0\t\v\f\r\x1c\x1d\x1e\x1f"
_ODD_WIDE = "\x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))
_ENDS = (" ", "\n")


def _even(text: str) -> bool:
    """Whether only spaces and newlines separate words, one at a time, none at an end."""
    if text.startswith(_ENDS) or text.endswith(_ENDS) or "  " in text or "\n\n" in text or " \n" in text or "\n " in text:
        return False
    return not any(c in text for c in _ODD_ASCII) and (text.isascii() or not any(c in text for c in _ODD_WIDE))


class Encoder:
    """Ids of texts as the library gives them by default: nothing is added, and the literal string of an added token is that token.

    A word's ids are computed once and looked up afterwards. That is exact for
    pre-tokenizers that end a word at every space or newline that stands alone
    between other characters, and between a letter or digit and one comma
    or full stop at a word's end; ``_kind`` knows two. Texts with other white
    space or an added token's string, and other tokenizer files, are encoded whole.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.kind = _kind(path)
        #: strings of added tokens; in any case, since words are stored lower-cased for the second kind
        self.added = [t.content.encode().lower() for t in self.tool.get_added_tokens_decoder().values()]
        self.ids: dict[str, bytes] = {}
        self.stage = -1
        self.stops = {c: self._whole([c])[0] for c in ",."}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tool.encode_batch(texts, add_special_tokens=False)]

    def _learn(self, words: set[str]) -> None:
        """Stores the ids of words that are not known yet."""
        closed = {w for w in words if w[-1:] in (",", ".") and len(w) > 1 and w[-2].isalnum()}
        plain = list((words - closed) | {x for w in closed if (x := w[:-1]) not in self.ids})
        if self.kind == "lower":
            self._glued(plain, plain, " \1 ")
        else:
            bare = [w for w in plain if w[:1] in ("\0", "\n")]
            self.ids.update(zip(bare, self._whole([w.removeprefix("\0") for w in bare]), strict=True))
            inner = [w for w in plain if w[:1] not in ("\0", "\n")]
            self._glued(inner, [" " + w for w in inner], "\n")
        for w in closed:
            self.ids[w] = self.ids[w[:-1]] + self.stops[w[-1]]

    def _glued(self, words: list[str], given: list[str], glue: str) -> None:
        """Stores the ids of ``given``, found between the glue's, as the words' ids."""
        mark = array("I", self._whole([glue.strip(" ")])[0])
        step = 128 * GLUED
        for lo in range(0, len(given), step):
            chunks = [given[k : k + GLUED] for k in range(lo, min(lo + step, len(given)), GLUED)]
            found: list[bytes] = []
            for chunk, e in zip(chunks, self.tool.encode_batch_fast([glue.join(c) for c in chunks], add_special_tokens=False), strict=True):
                ids = e.ids
                if len(mark) != 1 or ids.count(mark[0]) != len(chunk) - 1:  # some word holds the glue itself
                    found += self._whole(chunk)
                    continue
                s = 0
                for _ in range(len(chunk) - 1):
                    at = ids.index(mark[0], s)
                    found.append(array("I", ids[s:at]).tobytes())
                    s = at + 1
                found.append(array("I", ids[s:]).tobytes())
            self.ids.update(zip(words[lo : lo + step], found, strict=True))

    def encode(self, texts: Sequence[bytes]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each UTF-8 text."""
        if self.kind is None:
            return self._whole([t.decode() for t in texts])
        low = [t.lower() for t in texts]
        given = low if self.kind == "lower" else texts  # the file lower-cases anyway; A-Z can go first
        if len(self.ids) > KEPT_WORDS:
            self.ids = {}
        known = self.ids.get
        out: list[list[bytes | None]] = []
        lacking: list[tuple[int, list[str], list[int]]] = []  # document, its words, the places of unknown ones
        odd: list[tuple[int, str]] = []
        new: set[str] = set()
        for k, t in enumerate(given):
            t = t.decode()
            if not t or not _even(t) or any(a in low[k] for a in self.added):
                odd.append((k, texts[k].decode()))
                out.append([])
                continue
            # a word of the first kind keeps its newline; the text's first word has no space before it
            parts = t.replace("\n", " ").split(" ") if self.kind == "lower" else ("\0" + t.replace("\n", " \n")).split(" ")
            found = list(map(known, parts))
            out.append(found)
            if None in found:
                at = [i for i, x in enumerate(found) if x is None]
                lacking.append((k, parts, at))
                new.update([parts[i] for i in at])
        self._learn(new)
        for k, parts, at in lacking:
            found = out[k]
            for i in at:
                found[i] = self.ids[parts[i]]
        for (k, _), x in zip(odd, self._whole([t for _, t in odd]), strict=True):
            out[k] = [x]
        return [b"".join(x) for x in out]


def _kind(path: str) -> str | None:
    """'spaced': byte-level words with their leading space; 'lower': lower-cased words without spaces."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if spec.get("post_processor") or any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in spec.get("added_tokens", ())):
        return None
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return "spaced"
    kinds = [p.get("type") for p in pre.get("pretokenizers", ())]
    inner = [n.get("type") for n in (norm or {}).get("normalizers", ())]
    if kinds != ["Split", "ByteLevel"] or inner != ["NFC", "Replace", "Lowercase"]:
        return None
    split, level = pre["pretokenizers"]
    removed = split.get("behavior") == "Removed" and split.get("invert") is True and split.get("pattern", {}).get("Regex", "").endswith(r"[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
    return "lower" if removed and not level.get("use_regex") and not level.get("add_prefix_space") else None


def encoder(path: str) -> Encoder:
    """The worker's encoder for the file; it lives as long as the worker."""
    if path not in _READY:
        _READY[path] = Encoder(path)
    return _READY[path]


def forget(stage: int) -> None:
    """Drops word stores filled in another stage: a worker serves many stages, and later ones need the memory."""
    for e in _READY.values():
        if e.stage != stage:
            e.ids, e.stage = {}, stage
