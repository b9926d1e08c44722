"""Public tokenizer files: vocabulary, merges, and the split of texts into the pieces within which merges happen.

The split follows the file's own description: special strings are cut out of the raw text first, then the text is
normalised, then a pattern cuts it into pre-tokens. Merges never cross a pre-token, so a pre-token always gets the same ids,
and a task needs to work out each distinct one once.
"""

from __future__ import annotations

import json
import re
import unicodedata
from dataclasses import dataclass, field
from functools import cache, cached_property

from tokenizers import Regex, normalizers, pre_tokenizers

#: Entries a worker remembers per tokenizer; beyond it, it starts anew. This bounds memory and changes no result.
REMEMBERED = 300_000

# Fixed values of the public byte-level format: the pattern, and the characters that stand for bytes.
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> list[str]:
    """The character for each byte: printable Latin-1 as it is, the others from U+0100 upwards in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


#: Texts of characters below this one, Latin letters with all their accents, take a pattern with short sets, which is faster.
LATIN = 0x250


@cache
def library_class(escape: str, end: int = 0x110000) -> str:
    """The characters below `end` of a class such as \\p{L} as ranges for a set of `re`, as the tokenizers library has them.

    Python's own tables are of another Unicode version, so the library is asked, once, about every code point.
    """
    letters = "".join(chr(c) for c in range(end) if not 0xD800 <= c < 0xE000)
    found = pre_tokenizers.Split(Regex(escape + "+"), "removed", invert=True).pre_tokenize_str(letters)
    return "".join(f"\\U{ord(run[0]):08x}-\\U{ord(run[-1]):08x}" for run, _ in found)


def for_re(pattern: str, end: int = 0x110000) -> str:
    """A pattern of the library for `re`, on texts of characters below `end`: its classes written out as ranges."""
    out, inside = [], False
    for part in re.findall(r"\\[pP]\{\w+\}|\\.|.", pattern, re.S):
        inside = part == "[" or inside and part != "]"
        if part in (r"\p{L}", r"\p{N}", r"\s"):
            out.append(library_class(part, end) if inside else f"[{library_class(part, end)}]")
        elif part == r"\S" and not inside:
            out.append(f"[^{library_class(chr(92) + 's', end)}]")
        elif part.startswith((r"\p", r"\P", r"\S")):
            raise ValueError(f"{part} is not known here")
        else:
            out.append(part)
    return "".join(out)


def unassigned() -> str:
    """Ranges of the characters that Python's tables don't know."""
    out, start = [], None
    for c in range(0x110001):
        new = c < 0x110000 and unicodedata.category(chr(c)) == "Cn"
        if new and start is None:
            start = c
        elif not new and start is not None:
            out.append(f"\\U{start:08x}-\\U{c - 1:08x}")
            start = None
    return "".join(out)


@dataclass
class TokenizerFile:
    """What a byte-level BPE file says. Build it with `read`; it is pickled to tasks without its compiled patterns."""

    vocab: dict[str, int]
    merges: list[tuple[str, str]]
    specials: dict[str, int]
    pattern: str
    latin_pattern: str
    normalized: bool
    suffix: str
    blanks: str = ""
    unknown: str = ""
    names: dict[int, str] = field(default_factory=dict)

    @cached_property
    def _pieces(self):
        return re.compile(self.pattern)

    @cached_property
    def _latin(self):
        return re.compile(self.latin_pattern)

    @cached_property
    def _foreign(self):
        return re.compile(f"[^\\x00-{chr(LATIN - 1)}]")

    @cached_property
    def _blanks(self):
        return re.compile(f"[{self.blanks}]+")

    @cached_property
    def _latin_blanks(self):
        return re.compile("[" + "".join(sorted(filter(re.compile(f"[{self.blanks}]").match, map(chr, range(LATIN))))) + "]+")

    @cached_property
    def _unknown(self):
        return re.compile(f"[{self.unknown}]")

    @cached_property
    def _library(self):
        return normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])

    @cached_property
    def _special(self):
        longest = sorted(self.specials, key=lambda s: (-len(s), s))
        return re.compile("(" + "|".join(map(re.escape, longest)) + ")") if longest else None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def normalise(self, text: str) -> str:
        """NFC, runs of white space as one blank, lower case letter by letter."""
        latin = not self._foreign.search(text)
        if not latin and self._unknown.search(text):
            return self._library.normalize_str(self._blanks.sub(" ", text))
        text = unicodedata.normalize("NFC", text)
        text = self._latin_blanks.sub(" ", text) if latin else self._blanks.sub(" ", text)
        return text.lower() if "Σ" not in text else "".join(map(str.lower, text))

    def _split(self, text: str) -> list[str]:
        if self.normalized:
            text = self.normalise(text)
        return (self._pieces if self._foreign.search(text) else self._latin).findall(text)

    def pieces(self, text: str) -> list[str | int]:
        """Pre-tokens in order; a special string of the raw text comes as its id."""
        parts = self._special.split(text) if self._special else [text]
        if len(parts) == 1:
            return self._split(text)
        found: list[str | int] = []
        for part in parts:
            found.extend([self.specials[part]] if part in self.specials else self._split(part))
        return found


def read(path: str) -> TokenizerFile:
    """A tokenizers file with a byte-level BPE model, with or without NFC, blanks and lower case as its normaliser."""
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    model = said["model"]
    if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix")):
        raise ValueError("a plain BPE model is needed")
    split = said["pre_tokenizer"]
    pattern = BYTE_PATTERN if split["type"] == "ByteLevel" else split["pretokenizers"][0]["pattern"]["Regex"]
    steps = [n["type"] for n in (said["normalizer"] or {"normalizers": []})["normalizers"]]
    if steps not in ([], ["NFC", "Replace", "Lowercase"]):
        raise ValueError(f"normaliser {steps} is not known here")
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    specials = {t["content"]: t["id"] for t in said["added_tokens"]}
    vocab = model["vocab"]
    names = {i: t for t, i in vocab.items()} | {i: t for t, i in specials.items()}
    return TokenizerFile(vocab, merges, specials, for_re(pattern), for_re(pattern, LATIN), bool(steps), model.get("end_of_word_suffix") or "", library_class(r"\s"), unassigned(), names)
