"""Byte-level word splitting and memoised tokenizers encoding, used inside executors (little-endian hosts)."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable

from .worker import kept

#: Lower-cases A-Z only.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Lower-cases A-Z and blanks every other ASCII byte that is not a letter.
LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased (bytes.split() splits on just those six bytes)."""
    return text.encode().translate(LOWER).split() if text else []


def letter_words(text: str | None) -> list[bytes]:
    return text.encode().translate(LETTERS).split() if text else []


#: The normalizer and pre-tokenizer that the memo below is exact for.
KNOWN_NORMALIZER = ["NFC", ("Replace", "\\s+", " "), "Lowercase"]
KNOWN_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
KNOWN_STEPS = [{"type": "Split", "pattern": {"Regex": KNOWN_SPLIT}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}]
#: Anything but ASCII without apostrophes and controls, and Latin-1 letters.
OTHER = re.compile(r"[^\t\n\x0b\x0c\r\x20-&(-~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]")
CHUNK = re.compile(rb"[a-z\x80-\xff]+|[^a-z\x80-\xff\x09-\x0d\x20]+")
PLAIN = bytes([*b"\t\n\x0b\x0c\r .,", *range(97, 123), *range(128, 256)])
UNSAFE = re.compile(rb"['\x00-\x1f\x7f]")
MARKS = re.compile(rb"[0-9]|[^0-9]+")


def _byte_level() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


#: Chunks a generation of the memo holds; two generations take about 0.4 KB a chunk.
MEMO = 450_000


class _Memo(dict):
    """Chunk to packed ids in two generations of at most ``limit`` chunks."""

    def __init__(self, tokenize: Callable[[str], list], ids: int, level: dict[int, str], limit: int):
        super().__init__()
        self.tokenize, self.level, self.limit, self.old = tokenize, level, limit, {}
        self.packed = [i.to_bytes(4, "little") for i in range(ids)]

    def __missing__(self, chunk: bytes) -> bytes:
        got = self.old.get(chunk)
        if got is None:
            # ASCII letters stand for themselves in byte-level vocabularies
            packed = self.packed
            got = b"".join([packed[t.id] for t in self.tokenize(chunk.decode())]) if chunk.isalpha() else self._mixed(chunk)
        if len(self) >= self.limit:
            self.old = {}  # the oldest generation goes before the copy is made
            self.old = dict(self)
            self.clear()
        self[chunk] = got
        return got

    def _mixed(self, chunk: bytes) -> bytes:
        runs = [chunk.decode().lower().encode()] if chunk[0] >= 128 or 97 <= chunk[0] <= 122 else MARKS.findall(chunk)
        return b"".join([self.packed[t.id] for run in runs for t in self.tokenize(run.decode("latin-1").translate(self.level))])


def chunks(text: str) -> list[bytes] | None:
    """Lower-cased runs of letters and of marks between blanks; None for texts that must go whole.

    Where the only marks are single stops and commas, blanks around those and a split give the same.
    """
    low = text.encode().translate(LOWER)
    rest = low.translate(None, PLAIN)
    if b"<|" in low or (UNSAFE.search(rest) if text.isascii() else OTHER.search(text)):
        return None
    if not rest and not (b".." in low or b",," in low or b".," in low or b",." in low):
        return low.replace(b".", b" . ").replace(b",", b" , ").split()
    return CHUNK.findall(low)


class WordEncoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes.

    Texts of ASCII (without apostrophes, control characters and "<|") and Latin-1 letters fall
    into runs of letters, single digits and runs of other marks whatever stands around them, if
    the file has the known normalizer and pre-tokenizer. Each distinct run then goes once through
    the library's BPE model and is looked up afterwards. All other texts, and all texts under
    other files, go through the library whole. Both ways give the same ids.
    """

    def __init__(self, path: str, limit: int = MEMO):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.memo = _Memo(self.tok.model.tokenize, max(self.tok.get_vocab(True).values()) + 1, _byte_level(), limit)
        self.known = self._is_known()

    def _is_known(self) -> bool:
        """Whether normalizer, pre-tokenizer, added tokens and model are those the memo is exact for."""
        tok = self.tok
        if tok.normalizer is None or tok.pre_tokenizer is None or type(tok.model).__name__ != "BPE":
            return False
        norm, pre = (json.loads(x.__getstate__()) for x in (tok.normalizer, tok.pre_tokenizer))
        got = [(n["type"], n["pattern"].get("Regex"), n["content"]) if n["type"] == "Replace" else n["type"] for n in norm.get("normalizers", [])]
        steps = [{k: v for k, v in p.items() if k != "trim_offsets"} for p in pre.get("pretokenizers", [])]
        return got == KNOWN_NORMALIZER and steps == KNOWN_STEPS and all(t.content.startswith("<|") for t in tok.get_added_tokens_decoder().values())

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out, get = [], self.memo.__getitem__
        for t in texts:
            parts = (chunks(t) if self.known else None) if t else []
            out.append(array("I", self.tok.encode(t, add_special_tokens=False).ids).tobytes() if parts is None else b"".join(map(get, parts)))
        return out


def encoder(path: str, limit: int = MEMO) -> WordEncoder:
    """One encoder per Python worker, vocabulary file and memo size."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return kept(("encoder", path, limit), lambda: WordEncoder(path, limit))
