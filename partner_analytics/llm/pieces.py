"""Pre-tokens of a byte-pair vocabulary file, and the ids of each distinct pre-token.

A byte-pair tokenizer splits a text into pre-tokens and merges inside each of them only, so the ids
of a text are those of its pre-tokens in order. Texts whose characters all lie below U+0250 are in
normal form already: they are split at white space, and each distinct word by one regular expression.
Other texts go through the library's own normaliser and pre-tokenizer. Special strings inside a text
are cut out first, one id each, as the library does by default.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from functools import lru_cache

import numpy as np

#: characters from U+0250 on; white space for Python's split, but not for the vocabulary's pattern; and a letter that grows when lowered
ODD = re.compile("[\x1c-\x1fİɐ-\U0010ffff]")


class Pieces:
    """Splits texts and knows the ids of pre-tokens, kept for the first ``limit`` that a worker meets."""

    limit = 400_000
    #: words whose ids are kept; most are one pre-token and kept once
    word_limit = 600_000

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.library = Tokenizer.from_file(path)
        self.special = {token["content"]: token["id"] for token in spec["added_tokens"]}
        parts = spec["pre_tokenizer"]["pretokenizers"]
        self.find = regex.compile(next(p["pattern"]["Regex"] for p in parts if p["type"] == "Split")).findall
        spec |= {"normalizer": None, "added_tokens": [], "pre_tokenizer": parts[-1]}
        self.merger = Tokenizer.from_str(json.dumps(spec))  # merges a pre-token as it stands
        self.marker = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        self.words: dict[str, tuple[str, ...]] = {}
        self.ids: dict[str, bytes] = {}
        self.word_ids: dict[str, bytes] = {}

    def segments(self, text: str) -> list[tuple[bool, str]]:
        """(is special, part) of a text in order."""
        if "<|" not in text:
            return [(False, text)]
        return [(i % 2 == 1, part) for i, part in enumerate(self.marker.split(text)) if part]

    def simple(self, text: str) -> bool:
        return not ODD.search(text)

    def odd(self, text: str) -> list[str]:
        """Pre-tokens of any text without special strings, by the library's own steps."""
        normal = self.library.normalizer.normalize_str(text)
        return [normal[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(normal)]

    def of_word(self, word: str) -> tuple[str, ...]:
        found = self.words.get(word)
        if found is None:
            found = tuple(self.find(word))
            if len(self.words) < self.limit:
                self.words[word] = found
        return found

    def split(self, text: str | None) -> list[str]:
        """Pre-tokens in order; special strings stand for themselves."""
        out: list[str] = []
        for special, part in self.segments(text or ""):
            if special:
                out.append(part)
            elif self.simple(part):
                for word in part.lower().split():
                    out += self.of_word(word)
            else:
                out += self.odd(part)
        return out

    def counts(self, text: str | None) -> Counter:
        """How often each pre-token occurs in a text."""
        out: Counter = Counter()
        for special, part in self.segments(text or ""):
            if special:
                out[part] += 1
            elif self.simple(part):
                for word, n in Counter(part.lower().split()).items():
                    for token in self.of_word(word):
                        out[token] += n
            else:
                out.update(self.odd(part))
        return out

    def encode(self, tokens: list[str]) -> list[list[int]]:
        """Ids of each pre-token, by the library's merges."""
        made = self.merger.encode_batch_fast(tokens, add_special_tokens=False)
        return [[self.special[t]] if t in self.special else e.ids for t, e in zip(tokens, made)]

    def merged(self, tokens: list[str]) -> list[bytes]:
        """Ids of each pre-token as bytes, by the library's merges; all of them are one call and one result."""
        if not tokens:
            return []
        made = self.merger.encode(tokens, is_pretokenized=True, add_special_tokens=False)
        ids = np.asarray(made.ids, "<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(np.asarray(made.word_ids, np.int64), minlength=len(tokens)))).tolist()
        cut = [ids[a:b] for a, b in zip([0, *ends], ends)]
        return [np.asarray([self.special[t]], "<u4").tobytes() if t in self.special else x for t, x in zip(tokens, cut)]

    def look_up(self, tokens: list[str]) -> dict[str, bytes]:
        """Ids of each pre-token as bytes; the first ``limit`` that a worker meets are kept."""
        known = self.ids
        missing = [t for t in dict.fromkeys(tokens) if t not in known]
        made = dict(zip(missing, self.merged(missing)))
        if len(known) < self.limit:
            known.update(made)
        return {t: made.get(t) or known.get(t, b"") for t in tokens}

    def ids_of(self, text: str | None) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit numbers."""
        out: list[bytes] = []
        for special, part in self.segments(text or ""):
            if special:
                out.append(np.asarray([self.special[part]], "<u4").tobytes())
            elif self.simple(part):
                words, known = part.lower().split(), self.word_ids
                found = list(map(known.get, words))
                if None in found:
                    missing = list(dict.fromkeys([w for w, x in zip(words, found) if x is None]))
                    whole = [w for w in missing if w.isalpha()]  # letters alone are one pre-token
                    new = dict(zip(whole, self.merged(whole)))
                    parts = {w: self.find(w) for w in missing if w not in new}
                    ids = self.look_up([t for tokens in parts.values() for t in tokens])
                    new |= {w: b"".join([ids[t] for t in tokens]) for w, tokens in parts.items()}
                    if len(known) < self.word_limit:
                        known.update(new)
                    found = [new[w] if x is None else x for w, x in zip(words, found)]
                out.append(b"".join(found))
            else:
                tokens = self.odd(part)
                ids = self.look_up(tokens)
                out.append(b"".join([ids[t] for t in tokens]))
        return b"".join(out)


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One instance for each worker process."""
    return Pieces(path)


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
