"""Token ids of whole texts by the tokenizers library, with a worker-wide cache of space-delimited stretches."""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

from .common import FORGET

DEFAULT = "byte_bpe_50k.json"
#: Stretches kept in a worker, and the longest that is kept.
MOST_KEPT, LONGEST_KEPT = 1_500_000, 32
#: Bytes of text that are split at once.
PIECE = 1 << 18
_ENDS = ".,;:!?)]}\"#$%&*|"
_CUT = re.compile(r"(?<=\S) (?=\S)")
_SHOWN = {c: c for c in [*range(33, 127), *range(161, 173), *range(174, 256)]}
#: The characters by which a byte-level vocabulary shows the bytes 0 to 255: those of _SHOWN as they are, others from 256 on.
BYTES = _SHOWN | {c: 256 + i for i, c in enumerate(c for c in range(256) if c not in _SHOWN)}
_SPACE = chr(BYTES[32])


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT)


class Encoder:
    """Ids of a byte-level BPE tokenizer.

    Its pre-tokenizer always cuts before a space that stands between two characters that aren't white space, so the
    ids of a text are those of its stretches between such spaces, each with its space in front. Stretches recur, and
    each is encoded by the library once. Under a key that starts with a zero byte stands what has no space in front;
    texts with zero bytes are encoded whole, and so are those that hold an added token, which the library looks for first.
    A stretch of letters only is one word to the pre-tokenizer, so the library's model alone gives its ids. With a
    tokenizer that isn't byte-level with this pre-tokenizer, every text is encoded whole.
    """

    def __init__(self, path: str, most_kept: int = MOST_KEPT):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [x.content for x in self.library.get_added_tokens_decoder().values() if x.content]
        self.vocabulary = self.library.get_vocab_size()
        self.model = self.library.model
        about = json.loads(self.library.to_str())
        before, model = about["pre_tokenizer"] or {}, about["model"]
        plain = not about["normalizer"] and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        self.by_stretch = bool(plain and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix")))
        self.kept: dict[str, bytes] = {}
        self.most_kept = most_kept
        self.line_break = self._encode(["\n"])[0]

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _stretches(self, keys: list[str]) -> list[bytes]:
        out, odd = [], []
        for i, x in enumerate(keys):
            body = x[1:] if x[:1] == "\0" else x
            if body.isalpha():
                shown = body if body.isascii() else body.encode().decode("latin-1").translate(BYTES)
                out.append(array("I", [t.id for t in self.model.tokenize(shown if body is not x else _SPACE + shown)]).tobytes())
            else:
                odd.append(i)
                out.append(b"")
        for i, ids in zip(odd, self._encode([keys[i][1:] if keys[i][:1] == "\0" else " " + keys[i] for i in odd])):
            out[i] = ids
        return out

    def _learn(self, keys: set[str]) -> None:
        """Keep the ids of ``keys``, put together from parts that recur more.

        A single line break between other characters is a word by itself. What a stretch ends in is cut off: between a
        letter or digit and one of _ENDS is a cut, too.
        """
        kept, lines, ends, plain = self.kept, [], [], set()
        for x in keys:
            parts = x.split("\n") if "\n" in x else ()
            if len(parts) > 1 and all(parts) and parts[0] != "\0" and len(x.split()) == len(parts):
                lines.append((x, [parts[0], *["\0" + p for p in parts[1:]]]))
        for x in keys.difference(x for x, _ in lines).union(*(parts for _, parts in lines)).difference(kept):
            core = x.rstrip(_ENDS)
            if core != x and core and core[-1].isalnum():
                ends.append((x, core, "\0" + x[len(core) :]))
            else:
                plain.add(x)
        wanted = [*plain, *{y for _, c, t in ends for y in (c, t)}.difference(kept, plain)]
        kept.update(zip(wanted, self._stretches(wanted)))
        for x, c, t in ends:
            kept[x] = kept[c] + kept[t]
        for x, parts in lines:
            kept[x] = self.line_break.join([kept[p] for p in parts])

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers; null counts as empty."""
        if len(self.kept) > self.most_kept:
            self.kept.clear()
        rows: list[list[str]] = []
        odd: dict[int, str] = {}
        seen: set[str] = set()
        for i, text in enumerate(texts):
            text = text or ""
            if not self.by_stretch or "\0" in text or any(x in text for x in self.added):
                odd[i], text = text, ""
            row = text.split(" ")
            row[0] = "\0" + row[0]
            seen.update(row)
            rows.append(row)
        found = dict(zip(seen, map(self.kept.get, seen)))  # small beside what is kept, so that looking up each word is fast
        missing = {x for x, ids in found.items() if ids is None}
        strange = {x for x in missing if not x or x[0].isspace() or x[-1].isspace() or x == "\0"}
        if strange:
            for i, row in enumerate(rows):
                if len(row) > 1 and not strange.isdisjoint(row):
                    row[:] = _CUT.split(texts[i])
                    row[0] = "\0" + row[0]
                    found.update((x, self.kept.get(x)) for x in row)
                    missing.update(x for x in row if found[x] is None)
            missing -= strange.difference(x for row in rows for x in row)
        self._learn(missing)
        found.update((x, self.kept[x]) for x in missing)
        find = found.__getitem__
        out = [b"".join(map(find, row)) for row in rows]
        for i, text in odd.items():
            out[i] = self._encode([text])[0]
        for x in missing:
            if len(x) > LONGEST_KEPT or x in strange:
                self.kept.pop(x, None)
        return out


@lru_cache(maxsize=2)
def encoder(path: str, most_kept: int = MOST_KEPT) -> Encoder:
    return Encoder(path, most_kept)


FORGET.append(encoder.cache_clear)
