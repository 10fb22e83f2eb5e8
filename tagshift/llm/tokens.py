"""Token ids of texts by a public tokenizer file, remembered word by word.

The library splits a text at white space before it merges anything, so a text's ids are those of its
words between blanks and line ends, one after the other. A word's answer is kept; the library is
asked for new words only. Words of plain letters, digits and marks are first cut into pre-tokens as
the file's own pattern cuts them, and answers are kept for those too; every other word (controls,
rarer scripts, strings that may be special tokens) goes to the library as it is.
"""

from __future__ import annotations

import json
import os
import re
import sys
import types

#: entries kept of words and of pre-tokens, each; the whole store is dropped when it is full
MAX_KEPT = 700_000
# the file's pattern on lower-case text of the characters in _PLAIN, where it needs no Unicode tables
_LETTERS = "a-zªµºß-öø-ÿĀ-ŉŊ-ſ"
_PLAIN = re.compile("[!-~¡-¨«-±´¶-¸»¿-ÖØ-öø-ÿ×÷]*")
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|[^{_LETTERS}0-9]+")
_ENDINGS = frozenset(".,;:!?)")
# the same cut of many words, each behind a line end; what cuts one word does not hold a line end
_LINES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[0-9]|\n|[^{_LETTERS}0-9\n]+")


def load(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pre_tokens(word: str) -> list[str] | None:
    """The pre-tokens of a word, or None where only the library should cut it."""
    if word.isascii():
        if word.isalpha():
            return [word.lower()]
        if word[:-1].isalpha() and word[-1] in _ENDINGS:
            return [word[:-1].lower(), word[-1]]
    if "<|" in word or not _PLAIN.fullmatch(word):
        return None
    return _PIECES.findall(word.lower())


class Kept(dict):
    """Answers by string; ``ask`` finds a new one."""

    def __init__(self, ask, limit: int = MAX_KEPT):
        super().__init__()
        self.ask, self.limit = ask, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        self[key] = out = self.ask(key)
        return out


def words(text: str | None) -> list[str]:
    return text.replace("\n", " ").split(" ") if text else []


def worker_store(name: str, make):
    """What ``make`` returns, made once in each Python worker.

    Functions travel by value, so a module's own variables begin anew with every task.
    """
    held = sys.modules.setdefault("_tagshift_worker", types.ModuleType("_tagshift_worker")).__dict__
    if name not in held:
        held[name] = make()
    return held[name]


#: ends a token that ends a word
END_OF_WORD = "</w>"
#: new pre-tokens that are encoded in one call
JOINED = 20_000


def letters_of_bytes() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies: itself, or the next free code point."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def merger(path: str):
    """A faster library for the same merges, as an encoding of pre-tokens that each end with a zero byte; None where it cannot stand in.

    The zero byte, which no pre-token holds, stands for the end of a word: a byte and the end are the first pair to be
    joined, as the file joins them beforehand. The merges have to stand in the order of their ids, which are then ranks.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        whole = json.load(f)
    model, byte = whole["model"], letters_of_bytes()
    vocab, special = model.get("vocab", {}), {t["content"] for t in whole["added_tokens"]}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model.get("merges", [])]
    made = [vocab.get(a + b, -1) for a, b in merges]
    if model.get("type") != "BPE" or model.get("end_of_word_suffix") != END_OF_WORD or made != sorted(set(made)) or made[0] < 512:
        return None
    ranks = {}
    for token, i in vocab.items():
        if token not in special:
            body, ends = token.removesuffix(END_OF_WORD), token.endswith(END_OF_WORD)
            if any(c not in byte for c in body):
                return None
            ranks.setdefault(bytes(byte[c] for c in body) + b"\0" * ends, i)
    if len(ranks) != len(set(ranks.values())) or any(ranks.get(bytes([b]), 512) >= 512 or ranks.get(bytes([b, 0]), 512) >= 512 for b in range(1, 256)):
        return None
    return tiktoken.Encoding("words", pat_str=r"[^\x00]+\x00", mergeable_ranks=ranks, special_tokens={})


class WordIds(Kept):
    """Word -> its ids as little-endian unsigned 32-bit numbers; ``learn`` finds those of many words at once."""

    def __init__(self, path: str, limit: int = MAX_KEPT):
        import numpy as np

        super().__init__(self.one, limit)
        self.library = library = load(path)
        self.pieces = Kept(self.encode, limit)
        vocab = library.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith(END_OF_WORD)]] = True
        self.merger = merger(path)

    def encode(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def one(self, word: str) -> bytes:
        parts = pre_tokens(word)
        return self.encode(word) if parts is None else b"".join(map(self.pieces.__getitem__, parts))

    def learn(self, new: list[str]) -> None:
        """Finds the ids of ``new`` words. Plain words are cut together and merged in one call: pre-tokens stand apart in one text, each ends with the end of a word."""
        import numpy as np

        plain = _PLAIN.fullmatch
        cut = [w for w in new if w and plain(w) and "<|" not in w]
        for i in range(0, len(cut), JOINED):
            some = cut[i : i + JOINED]
            lines = "\0".join(_LINES.findall("\n" + "\n".join(some).lower())) + "\0"
            parts = lines.replace("\n\0", "")
            marks = np.frombuffer(lines.replace("\n\0", "\n").encode(), np.uint8)
            marks = marks[(marks == 0) | (marks == 10)]
            # of each word, its pre-tokens and those of the words before
            upto = np.append(np.cumsum(marks == 0)[marks == 10][1:], np.count_nonzero(marks == 0))
            if self.merger is None:
                ids = np.array(self.library.encode_batch_fast([parts[:-1].replace("\0", " ")], add_special_tokens=False)[0].ids, "<u4")
            else:
                ids = np.array(self.merger.encode_ordinary(parts), "<u4")
            stops = 4 * (np.flatnonzero(self.ends[ids]) + 1)
            # otherwise each is asked for by itself
            if len(upto) == len(some) and len(stops) == upto[-1] and stops[-1] == 4 * len(ids):
                raw, stops = ids.tobytes(), stops[upto - 1].tolist()
                self.update(zip(some, [raw[a:b] for a, b in zip([0, *stops], stops)]))
        self.update({w: self.one(w) for w in new if w not in self})

    def of_texts(self, texts) -> tuple:
        """(ids of all texts of an Arrow string array, one after the other; number of ids of each text).

        Each different word of the texts is looked up once.
        """
        import numpy as np
        import pyarrow.compute as pc

        split = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
        if not len(split):
            return np.zeros(0, "<u4"), np.zeros(0, np.int64)
        coded = split.flatten().dictionary_encode()
        places, own = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        raw = list(map(self.get, own))
        new = [w for w, r in zip(own, raw) if r is None]
        if new:
            if len(self) + len(new) > self.limit:
                self.clear()
            self.learn(new)
            raw = [self[w] if r is None else r for w, r in zip(own, raw)]
        pool, n = np.frombuffer(b"".join(raw), "<u4"), np.fromiter(map(len, raw), np.int64, len(raw)) // 4
        long = n[places]
        upto = np.concatenate([[0], np.cumsum(long)])
        at = np.repeat((np.cumsum(n) - n)[places] - upto[:-1], long)
        at += np.arange(len(at))
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy())])
        return pool[at], np.diff(upto[ends])


def word_ids(path: str) -> WordIds:
    return worker_store(f"ids:{path}", lambda: WordIds(path))
