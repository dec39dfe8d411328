"""Token ids of whole texts by a public tokenizer, as little-endian unsigned 32-bit integers.

The same words return again and again, so a worker keeps the ids of words (at most CACHE of them) and
only new words reach the tokenizer, all in one call. Splitting is the tokenizer file's own pattern,
written for characters below U+0250; a text with any other character goes to the tokenizer whole.
"""

from __future__ import annotations

import functools
import json
import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CACHE = 250_000
#: Bytes of text in one call.
BLOCK = 4 << 20
SPACE = re.compile("[ \\t\\n\\r]")
#: Fixed values of the accepted tokenizer files: their split pattern and normalizers.
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
#: Below U+0250 texts are in NFC and lower case is by character, but for U+0130; libraries differ on \x1c-\x1f.
PLAIN = re.compile("[\x00-\x1b\x20-\u012f\u0131-\u024f]*")
#: WORD_PATTERN within lower-case PLAIN: letters and numbers below U+0250 are named one by one.
LETTERS, NUMBERS = "a-z\u00aa\u00b5\u00ba\u00df-\u00f6\u00f8-\u024f", "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^\\s{LETTERS}{NUMBERS}]+")
#: Prose of letters, ASCII white space, full stops and commas splits without the pattern, if no two marks meet.
PROSE = re.compile(f"[{LETTERS} \\t-\\r.,]*")


def split_words(text: str) -> str:
    """The words of a lower-case PLAIN text, as WORDS.findall gives them, parted by ASCII white space."""
    if PROSE.fullmatch(text) and not any(pair in text for pair in (".,", ",.", "..", ",,")):
        return text.replace(".", " . ").replace(",", " , ")
    return " ".join(WORDS.findall(text))


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, others follow from U+0100."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class TextEncoder:
    """Encodes batches of texts with ``tokenizers``; ``add_special_tokens`` is off."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.whole = Tokenizer.from_file(path)
        self.bare = None
        norms = (spec.get("normalizer") or {}).get("normalizers", [])
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.by_chunk = [n.get("type") for n in norms] == NORMALIZERS and [s.get("type") for s in splits] == ["Split", "ByteLevel"] and splits[0]["pattern"].get("Regex") == WORD_PATTERN
        if self.by_chunk:
            bare = spec | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Split", "pattern": {"String": " "}, "behavior": "Removed", "invert": False}}
            self.bare = Tokenizer.from_str(json.dumps(bare))
            self.letters = {b: c for b, c in _byte_letters().items() if b != 32}
            self.special = [t["content"] for t in spec.get("added_tokens", [])]
            self.ends = np.zeros(max(self.whole.get_vocab().values()) + 1, bool)
            self.ends[[i for w, i in self.whole.get_vocab().items() if w.endswith(spec["model"]["end_of_word_suffix"])]] = True
        self.cache: dict[str, bytes] = {"": b""}

    def _whole(self, text: str) -> bytes:
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _learn(self, words: list[str]) -> None:
        """Put the ids of new words into the cache; each word's last token, and no other, ends a word."""
        text = " ".join(words).encode().decode("latin-1").translate(self.letters)
        ids = np.array(self.bare.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        cuts = (np.flatnonzero(self.ends[ids]) + 1) * 4
        data = ids.tobytes()
        self.cache.update((w, data[a:b]) for w, a, b in zip(words, [0, *cuts[:-1].tolist()], cuts.tolist(), strict=True))

    def encode_block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, offsets of each text in them); a longer text than BLOCK is cut between words."""
        if not self.by_chunk or all(len(t) <= BLOCK for t in texts):
            return self._encode_block(texts)
        ids, cuts, total, known = [], [0], 0, 0
        for t in texts:
            at = 0
            while at < len(t) or not t:
                end = at + BLOCK
                if end < len(t):
                    space = SPACE.search(t, end)
                    end = space.start() if space else len(t)
                ids.append(self._encode_block([t[at:end]])[0])
                at = end
                if not t:
                    break
            total += sum(len(x) for x in ids[known:])
            known = len(ids)
            cuts.append(total)
        return np.concatenate(ids) if ids else np.zeros(0, "<u4"), np.array(cuts)

    def _encode_block(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Words become numbers in Arrow; only distinct words are looked up."""
        words = [split_words(t.lower()) if self.by_chunk and PLAIN.fullmatch(t) and not any(s in t for s in self.special) else f"\x1c{i}" for i, t in enumerate(texts)]
        lists = pc.ascii_split_whitespace(pa.array(words, pa.string()))
        coded = lists.flatten().dictionary_encode()
        distinct = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        if len(self.cache) > CACHE:
            self.cache = {"": b""}
        new = list(set(distinct).difference(self.cache))
        whole = {w: self._whole(texts[int(w[1:])]) for w in new if w[:1] == "\x1c"}  # never in a PLAIN text
        if new := [w for w in new if w not in whole]:
            self._learn(new)
        parts = list(map((self.cache | whole if whole else self.cache).__getitem__, distinct))
        size = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        flat, first = np.frombuffer(b"".join(parts), "<u4"), np.cumsum(size) - size
        index = coded.indices.to_numpy()
        n = size[index]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(first[index] - (ends - n), n) + np.arange(total)]
        return ids, np.r_[0, ends][lists.offsets.to_numpy()]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text, 4 bytes each."""
        ids, cuts = self.encode_block(texts)
        return [ids[a:b].tobytes() for a, b in zip(cuts, cuts[1:])]


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> TextEncoder:
    """One encoder for each Python worker."""
    return TextEncoder(path)


def vocabulary_size(path: str) -> int:
    return max(encoder(path).whole.get_vocab(with_added_tokens=True).values()) + 1
