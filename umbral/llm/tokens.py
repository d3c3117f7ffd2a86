"""Token ids of whole texts, by the tokenizers library, each distinct word once.

A text is cut into the same words as the tokenizer's own pre-tokenizer cuts it, and a word's ids do not
depend on what stands around it. The library's model encodes each distinct word once per Python worker; the
ids of a text are those of its words in order.
"""

from __future__ import annotations

from array import array

# ---- fixed values: the two pre-tokenizers that are read, as published --------------------------------
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# ------------------------------------------------------------------------------------------------------
#: Words, and half of the chunks between spaces, kept at most by a worker; more of them change no result.
CACHE = 120_000
END_ID = 1
#: Marks that are words of their own behind a letter, in either pre-tokenizer.
MARKS = frozenset(".,;:!?")


def worker_cache(name) -> dict:
    """A dict that lives as long as the Python worker, so that the worker's next tasks find it."""
    import sys
    import types

    module = sys.modules.setdefault("umbral_worker_cache", types.ModuleType("umbral_worker_cache"))
    return module.__dict__.setdefault(str(name), {})


def _letters_first(pattern: str) -> str:
    """The same cuts, found faster: no other alternative can start where the one for letters does."""
    parts = pattern.split("|")
    return "|".join(sorted(parts, key=lambda p: "L}+" not in p or "^" in p))


def _byte_letters() -> dict[int, int]:
    """The letter that stands for each byte in a byte-level vocabulary: visible Latin-1 letters stand for
    themselves, the other bytes for the letters from 256 on, in their order."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: b for b in visible} | {b: 256 + i for i, b in enumerate(hidden)}


class _Known(dict):
    """What ``make`` gives for a key, kept for the first ``limit`` keys."""

    limit = 1

    def __missing__(self, key: str) -> bytes:
        value = self.make(key)
        if len(self) < self.limit:
            self[key] = value
        return value


class _Chunks(_Known):
    """Chunks of two lines are hardly ever met again, and not kept."""

    def __missing__(self, key: str) -> bytes:
        return self.make(key) if "\n" in key else super().__missing__(key)


def _latin_letters(text: str) -> bool:
    return text.isalpha() and (text.isascii() or max(text) <= "\xff")


class WordEncoder:
    """ids of texts as little-endian uint16 bytes; the vocabulary must be below 65,536.

    A text is first cut at its spaces, which the pre-tokenizers never cut less finely: a word ends before a
    space that no other white space follows. Only the distinct ones of these chunks are cut into words, and
    only the distinct words go to the library's model. A worker keeps the first ``cache`` words and twice as
    many chunks; what comes beyond is worked out each time. Texts with white space in a row are cut whole.
    """

    def __init__(self, path: str, cache: int = CACHE):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        import regex
        from tokenizers import Tokenizer

        held = worker_cache(f"tokenizer {path}")
        if not held:
            held["tokenizer"] = Tokenizer.from_file(path)
            held["model"] = held["tokenizer"].model
        self.tokenizer = held["tokenizer"]
        self.pieces_of = held["model"].tokenize
        if self.tokenizer.get_vocab_size() > 65_536:
            raise ValueError("vocabulary does not fit 16 bits")
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        cuts = config["pre_tokenizer"]
        steps = cuts.get("pretokenizers", [{}])
        if config["post_processor"] is None and cuts["type"] == "ByteLevel" and cuts["use_regex"] and not cuts["add_prefix_space"]:
            pattern, self.space = BYTE_LEVEL, " "
        elif (
            config["post_processor"] is None and cuts["type"] == "Sequence" and steps[0]["pattern"] == {"Regex": WORD_LEVEL}
            and [s["type"] for s in steps[1:]] == ["ByteLevel"] and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"]
        ):
            pattern, self.space = WORD_LEVEL, ""
        else:
            raise ValueError("a pre-tokenizer that is not read")
        self.find = regex.compile(_letters_first(pattern)).findall
        self.blank_after_space = regex.compile(r" \s").search
        self.normalizer = self.tokenizer.normalizer
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.words, self.chunks = held.setdefault("words", _Known()), held.setdefault("chunks", _Chunks())
        for known, make in ((self.words, self._encode_word), (self.chunks, self._encode_chunk)):
            if len(known) >= known.limit:  # a new task may read other texts
                known.clear()
            known.make, known.limit = make, cache if known is self.words else 2 * cache

    def _encode_word(self, word: str) -> bytes:
        spelled = word if word.isascii() and word.isalpha() else word.encode().decode("latin-1").translate(self.letters)
        return array("H", [piece.id for piece in self.pieces_of(spelled)]).tobytes()

    def _encode_chunk(self, chunk: str) -> bytes:
        """ids of what stands between two spaces. Latin letters only, these with a mark behind them, and two lines are
        cut as the pre-tokenizers cut them, without a search."""
        if _latin_letters(chunk):
            return self._encode_word(self.space + self._normal(chunk))
        if chunk[-1:] in MARKS and _latin_letters(chunk[:-1]):
            return self.chunks[chunk[:-1]] + self.words[chunk[-1]]
        line, end, rest = chunk.partition("\n")
        if end and line and rest and "\n" not in rest and not line[-1].isspace() and not rest[0].isspace():
            return self.chunks[line] + (self._ids_of_words("\n" + rest) if self.space else self.chunks[rest])
        return self._ids_of_words(self.space + chunk)

    def _ids_of_words(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, self.find(self._normal(text))))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """ids of each text; null counts as empty."""
        out: list[bytes] = [b""] * len(texts)
        at_spaces = []
        for i, text in enumerate(texts):
            text = text or ""
            if "<|" in text and any(s in text for s in self.specials):
                out[i] = self._whole(text)  # special tokens cut a text elsewhere
            elif "  " in text or self.blank_after_space(text):
                out[i] = self._ids_of_words(text)
            else:
                at_spaces.append(i)
        for i, found in zip(at_spaces, self._encode_chunks([texts[i] or "" for i in at_spaces])):
            out[i] = found
        return out

    def _encode_chunks(self, texts: list[str]):
        """ids of texts that are cut at each of their spaces: only their distinct chunks are Python strings."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        if not texts:
            return
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        chunks = cut.values.dictionary_encode()
        ids = pa.array(map(self.chunks.__getitem__, chunks.dictionary.to_pylist()), pa.large_binary()).take(chunks.indices)
        _, offsets, data = ids.buffers()
        ends = np.frombuffer(offsets, np.int64, len(ids) + 1, ids.offset * 8)
        data = memoryview(data) if data is not None else memoryview(b"")
        first = cut.offsets.to_numpy()
        for text, a, b in zip(texts, ends[first[:-1] + 1].tolist(), ends[first[1:]].tolist()):
            yield self._ids_of_words(text.partition(" ")[0]) + data[a:b]

    def _normal(self, text: str) -> str:
        """Latin-1 text is composed already, and its small letters are the same to any library."""
        if self.normalizer is None:
            return text
        if text.isascii():
            return text.lower()
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.normalizer.normalize_str(text)
        return text.lower()

    def _whole(self, text: str) -> bytes:
        import numpy as np

        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u2").tobytes()


def crc_of(ids) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    import zlib

    return zlib.crc32(ids.astype("<u4").tobytes())


def slices(batch, rows: int = 1_000, size: int = 8 << 20):
    """Parts of an Arrow batch of a bounded number of rows and, a single row aside, of bytes."""
    import numpy as np
    import pyarrow.compute as pc

    lengths = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, total = 0, 0
    for i, x in enumerate(lengths.tolist()):
        if i > start and (i - start >= rows or total + x > size):
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += x
    if start < batch.num_rows:
        yield batch.slice(start)
