"""Token ids of whole texts as little-endian bytes, by the tokenizers library."""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import cache

#: A blank between two other white-space characters, or at the end after one: there a blank does not begin a new piece.
_JOINED_BLANK = re.compile(r"\s (?:\s|\Z)")


#: Letters that NFC leaves alone and that have one lower-case letter: Latin up to U+024F, without the dotted capital I.
_LETTERS = "[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+"
_TAIL = re.escape("!?.,;:#*$%&|()[]{}\"+-/=<>@^_~")
#: Letters and the punctuation after them, and the same once more on the next line.
_WORD = re.compile(f"({_LETTERS})([{_TAIL}]*)(?:\n({_LETTERS})([{_TAIL}]*))?")


class Memo(dict):
    """What ``make`` gives for a key, kept until ``limit`` keys are held; then it starts anew, so memory is bounded."""

    def __init__(self, make, limit: int = 900_000):
        self.make, self.limit = make, limit

    def __missing__(self, key: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        self[key] = out = self.make(key)
        return out


class Encoder:
    """``encode(texts)`` gives one ``bytes`` (unsigned 32-bit ids) per text, equal to encoding each whole text.

    Texts are encoded word by word where the tokenizer file shows that words are independent of each other:
    either its pre-tokenizer drops white space, or a piece begins at each blank. A worker keeps the ids of the words
    it met lately. Of a new word, a run of Latin letters is one piece for these pre-tokenizers and goes straight to
    the tokenizer's BPE model, and so does what punctuation follows, also over a line break, which is a piece of its
    own between them; any other word is encoded by the whole tokenizer. Other tokenizers, and texts with runs of white space that a piece may span, are encoded whole.

    With ``literal`` the name of an added token in a text is text like any other; else it is that token, as the
    library has it, and a text that holds one is encoded whole. At most ``keep`` words are kept, and as many runs."""

    def __init__(self, path: str, literal: bool = True, keep: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = literal
        self.model = self.tokenizer.model
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [] if literal else spec.get("added_tokens") or []
        self.added = re.compile("|".join(re.escape(t["content"]) for t in added)) if added else None
        norm, pre = spec.get("normalizer"), spec.get("pre_tokenizer") or {}
        steps = [x.get("type") for x in (norm or {}).get("normalizers", [])]
        parts = pre.get("pretokenizers", [])
        self.kind = "whole"
        if not all(t.get("special") and not t.get("normalized") for t in added):
            pass  # such a token may be found in a text in other spellings
        elif not norm and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            self.kind = "blank_leads"
        elif steps == ["NFC", "Replace", "Lowercase"] and parts and parts[0].get("behavior") == "Removed" and parts[0].get("invert") and parts[0]["pattern"].get("Regex", "").endswith(r"[^\s\p{L}\p{N}]+"):
            self.kind = "blank_dropped"
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.symbols = {i: as_bytes(chr(i))[0][0] for i in [32, *range(65, 91), *range(97, 123), *range(0xC0, 0x250)]}
        self.lead = self.symbols[32] if self.kind == "blank_leads" else ""
        self.words, self.runs, self.tails = Memo(self._word, keep), Memo(self._run, min(keep, 350_000)), Memo(self._whole, min(keep, 50_000))
        self.starts = Memo(self._letters, min(keep, 50_000))  # runs that no blank leads

    def _whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _run(self, letters: str) -> bytes:
        return self._letters(letters, self.lead)

    def _letters(self, letters: str, lead: str = "") -> bytes:
        if self.kind == "blank_dropped":
            letters = letters.lower()
        if not letters.isascii():  # ASCII letters stand for themselves
            letters = letters.translate(self.symbols)
        return array("I", [t.id for t in self.model.tokenize(lead + letters)]).tobytes()

    def _word(self, word: str) -> bytes:
        m = _WORD.fullmatch(word)
        if not m:
            return self._whole(" " + word if self.lead else word)
        letters, tail, more, last = m.groups()
        out = self.runs[letters] + self.tails[tail] if tail else self.runs[letters]
        if more:
            out += self.tails["\n"] + self.starts[more] + (self.tails[last] if last else b"")
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.added and any(map(self.added.search, texts)):
            rest = iter(self._encode([t for t in texts if not self.added.search(t)]))
            return [self._whole(t) if self.added.search(t) else next(rest) for t in texts]
        return self._encode(texts)

    def _encode(self, texts: list[str]) -> list[bytes]:
        word = self.words.__getitem__
        if self.kind == "blank_dropped":
            return [b"".join(map(word, t.replace("\n", " ").split(" "))) for t in texts]
        if self.kind == "whole":
            return [self._whole(t) for t in texts]
        out = []
        for t in texts:
            if _JOINED_BLANK.search(t):
                out.append(self._whole(t))
            else:
                first, *rest = t.split(" ")
                out.append(self._whole(first) + b"".join(map(word, rest)))
        return out


@cache
def encoder(path: str, keep: int = 500_000) -> Encoder:
    """One encoder for each file and Python worker, equal to the library's own encoding."""
    return Encoder(path, literal=False, keep=keep)
