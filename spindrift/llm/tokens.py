"""Token ids of whole texts, by way of a table of distinct words.

``word_bpe_49k`` splits a text into words, digits and runs of marks and encodes
each alone, so a text's ids are the ids of its pieces joined.  In texts of plain
Latin-1 letters and marks numpy finds the pieces and hashes them; each distinct
piece of a block is encoded once, by the tokenizer itself, and the ids are gathered.
Plain texts with contractions are cut by a pattern; any other text goes to the
tokenizer whole.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pandas as pd

from spindrift.llm.texthash import byte_table, mix, powers

#: Characters a block, pieces that the table keeps between blocks, pieces encoded in one string.
BLOCK_CHARS = 1_000_000
KEPT_PIECES = 200_000
JOINED = 20_000

PLAIN = re.compile(r"[\t\n\r\x20-\x7e¡-¬®-ÿ]*")
LETTERS, NUMBERS = "a-zªµºß-öø-ÿ", "0-9²³¹¼-¾"
SHORT = r"'s|'t|'re|'ve|'m|'ll|'d"
CONTRACTION = re.compile(SHORT, re.I)
PIECE = re.compile(rf"[{LETTERS}]+|[{NUMBERS}]|{SHORT}|[^\s{LETTERS}{NUMBERS}]+")

LOWERED = np.array([ord(chr(i).lower()) for i in range(256)], np.uint8)
KIND = np.array([0 if chr(i) in "\t\n\r " else 1 if re.match(f"[{LETTERS}]", chr(i)) else 2 if re.match(f"[{NUMBERS}]", chr(i)) else 3 for i in range(256)], np.uint8)
TABLE = byte_table(19)
TABLE[65:91] = mix(np.arange(65, 91, dtype=np.uint64))  # bytes are lowered before


def gathered(flat: np.ndarray, firsts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs flat[firsts[i]:firsts[i] + sizes[i]] joined, and where each ends."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(firsts - (ends - sizes), sizes) + np.arange(total)], ends


class WordTokenizer:
    """Encodes lists of texts; end is appended to each text's ids."""

    def __init__(self, path: str, end: int | None = 0):
        from tokenizers import Tokenizer

        self.whole, self.end = Tokenizer.from_file(path), end
        vocabulary = self.whole.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.up, self.down = powers(1)
        self.forget()

    def forget(self) -> None:
        """Empties the table: place by hash, and for each place where its ids start, how many, and the ids."""
        self.place: dict[int, int] = {}
        self.first, self.size, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encoded(self, pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces joined, and how many each has: a piece ends at the token that bears the mark of a word's end."""
        flat, sizes = [], []
        for i in range(0, len(pieces), JOINED):
            part = pieces[i : i + JOINED]
            ids = np.array(self.whole.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(part):
                held = [e.ids for e in self.whole.encode_batch_fast(part, add_special_tokens=False)]
                ids = np.fromiter(chain.from_iterable(held), np.uint32)
                ends = np.cumsum([len(h) for h in held])
            flat.append(ids)
            sizes.append(np.diff(ends, prepend=0))
        return np.concatenate(flat or [np.zeros(0, np.uint32)]), np.concatenate(sizes or [np.zeros(0, np.int64)]).astype(np.int64)

    def places(self, hashes: np.ndarray, spell) -> np.ndarray:
        """The table's places of distinct hashes; spell(i) gives the piece of the i-th."""
        if len(self.place) > KEPT_PIECES:
            self.forget()
        held = hashes.tolist()
        found = np.fromiter(map(self.place.get, held, [-1] * len(held)), np.int64, len(held))
        new = np.flatnonzero(found < 0)
        if len(new):
            ids, sizes = self.encoded([spell(i) for i in new.tolist()])
            at = len(self.first)
            self.first = np.concatenate([self.first, len(self.flat) + np.cumsum(sizes) - sizes])
            self.size, self.flat = np.concatenate([self.size, sizes]), np.concatenate([self.flat, ids])
            found[new] = np.arange(at, at + len(new))
            self.place.update(zip(hashes[new].tolist(), range(at, at + len(new))))
        return found

    def vectors(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of plain texts without contractions."""
        sizes = np.array([len(t) for t in texts])
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        data = LOWERED[np.frombuffer("".join(texts).encode("latin-1"), np.uint8)]
        n = len(data)
        if not n:
            return [np.zeros(0, np.uint32) for _ in texts]
        kind = KIND[data]
        starts_here = np.ones(n + 1, bool)
        starts_here[1:n] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
        starts_here[bounds] = True
        edges = np.flatnonzero(starts_here)
        starts, ends = edges[:-1], edges[1:]
        real = kind[starts] > 0
        starts, ends = starts[real], ends[real]
        if len(self.up) <= n:
            self.up, self.down = powers(max(n, BLOCK_CHARS * 5 // 4) + 1)
        up, down = self.up, self.down
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(TABLE[data] * up[:n], out=sums[1:])
        hashes = mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
        codes, distinct = pd.factorize(hashes)
        some = np.empty(len(distinct), np.int64)
        some[codes[::-1]] = np.arange(len(codes) - 1, -1, -1)
        raw = data.tobytes()
        spell = lambda i: raw[starts[some[i]] : ends[some[i]]].decode("latin-1")
        place = self.places(distinct, spell)[codes]
        ids, until = gathered(self.flat, self.first[place], self.size[place])
        cuts = np.concatenate([[0], until])[np.searchsorted(starts, bounds)]
        return [ids[a:b] for a, b in zip(cuts, cuts[1:])]

    def block(self, texts: list[str]) -> list[np.ndarray]:
        """uint32 ids of each text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        plain = []
        for i, t in enumerate(texts):
            if not PLAIN.fullmatch(t) or "<|" in t:
                out[i] = np.array(self.whole.encode(t, add_special_tokens=False).ids, np.uint32)
            elif "'" in t and CONTRACTION.search(t):
                out[i] = self.encoded(PIECE.findall(t.lower()))[0]
            else:
                plain.append(i)
        for i, ids in zip(plain, self.vectors([texts[i] for i in plain])):
            out[i] = ids
        if self.end is None:
            return out
        tail = np.array([self.end], np.uint32)
        return [np.concatenate([x, tail]) for x in out]

    def encode(self, texts: list[str | None]):
        """Ids of each text (null: empty), in order, block by block."""
        block, size = [], 0
        for t in texts:
            block.append(t or "")
            size += len(block[-1])
            if size >= BLOCK_CHARS:
                yield from self.block(block)
                block, size = [], 0
        yield from self.block(block)

    def encode_rows(self, batch, rows: int = 500):
        """(id, ids) of each row of an Arrow batch of ids and texts, with few texts unpacked at a time."""
        for start in range(0, batch.num_rows, rows):
            part = batch.slice(start, rows)
            yield from zip(part.column(0).to_pylist(), self.encode(part.column(1).to_pylist()))
