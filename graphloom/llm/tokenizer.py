"""Token ids of whole texts by a public vocabulary file."""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array
from collections.abc import Callable, Iterable

#: Texts with so long a run of blanks go to the library: the other one's matcher looks back over a whole run and gives up at about a million.
LONG_BLANKS = 100_000
_BLANKS = re.compile(r"\s+")

_loaded: dict[str, "TextTokenizer"] = {}

#: Fixed value: the pattern by which byte-level vocabularies with use_regex split a text.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def tokenizer_digest(path: str) -> str:
    """What a stored count depends on: the vocabulary file and the library's version."""
    if path.endswith(".model"):
        import sentencepiece as library
    else:
        import tokenizers as library
    with open(path, "rb") as f:
        return hashlib.sha256(f.read() + f"|{library.__name__} {library.__version__}".encode()).hexdigest()


def load(path: str) -> "TextTokenizer":
    """The tokenizer of this file, one for each Python worker."""
    if path not in _loaded:
        _loaded[path] = TextTokenizer(path)
    return _loaded[path]


class TextTokenizer:
    """ids(texts): the little-endian 32-bit ids of each text, without any added ones.

    A .json file is read by tokenizers and a .model file by sentencepiece. Where a .json file is a plain byte-level vocabulary whose merges
    are numbered in their order, tiktoken gives the same ids from the same file in a third of the time, and is used instead (but see LONG_BLANKS).
    """

    def __init__(self, path: str):
        self._ids: Callable[[list[str]], Iterable]
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            self._ids = lambda texts: model.encode(texts, num_threads=1)
            return
        with open(path, encoding="utf-8") as f:
            said = json.load(f)
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        library.no_truncation()
        library.no_padding()
        fast = _byte_level(said)
        if fast is None:
            self._ids = lambda texts: (e.ids for e in library.encode_batch_fast(texts, add_special_tokens=False))
        else:
            self._ids = lambda texts: (library.encode(t, add_special_tokens=False).ids if has_long_blanks(t) else fast.encode(t, allowed_special="all") for t in texts)

    def ids(self, texts: list[str]) -> list[bytes]:
        out = []
        for ids in self._ids(texts):
            row = array("I", ids)
            if sys.byteorder == "big":
                row.byteswap()
            out.append(row.tobytes())
        return out


def has_long_blanks(text: str) -> bool:
    return len(text) >= LONG_BLANKS and any(m.end() - m.start() >= LONG_BLANKS for m in _BLANKS.finditer(text))


def _byte_level(said: dict):
    """A tiktoken encoding of a tokenizers file, or None where the two could differ."""
    import tiktoken

    model, before = said.get("model", {}), said.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    odd = said.get("normalizer") or any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    added = said.get("added_tokens", [])
    if not plain or odd or any(t.get("lstrip") or t.get("rstrip") or t.get("single_word") or not t.get("special") for t in added):
        return None
    # the alphabet of byte-level vocabularies: printable bytes stand for themselves, the others for what follows at 256
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(own))}
    special = {t["content"]: t["id"] for t in added}
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    at = [model["vocab"].get(a + b) for a, b in merges]
    ranks = {bytes(letters[c] for c in name): i for name, i in model["vocab"].items() if name not in special}
    single = [i for b, i in ranks.items() if len(b) == 1]
    if at != sorted(at, key=lambda i: -1 if i is None else i) or None in at or len(single) != 256 or max(single) > min(at) or len(ranks) != 256 + len(at):
        return None
    return tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=special)
