"""SentencePiece encoding and decoding with a merge-type model (operator 1).

Encoding fills a prefix table. For each prefix of a segment exactly one token can stand last in that
prefix's encoding. An automaton reports the pieces that end at each character; a piece is that
token if it and the last token of the prefix before it are compatible, that is, if merging their
joint text gives just these two. Ids are then read off backwards. The work is linear in the text.

Compatibility is decided by undoing merges along the border between the two pieces: at no time may
a piece across the border have had a better rank than the merge that was made instead.

No piece has a blank mark after another character, so texts fall into segments at blanks, and
segments at characters that no piece has (these become byte pieces). Segments are kept in a bounded
dictionary per worker.

Defined cases: null text is the empty one, which encodes to the begin and end ids and decodes to the
empty string; repeated rows are encoded each; an empty table gives an empty result; other columns
are ignored; very long texts cost time in proportion to their length.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessella.llm.common import arrow_pass, texts

MODEL = "piece_bpe_32k.model"
MARK = "▁"
#: Segments and pair tests kept per Python worker, and the longest segment kept.
KEPT_SEGMENTS, KEPT_CHARS, KEPT_PAIRS = 400_000, 48, 1_000_000
#: What the encoder can return per row.
OUTPUTS = {"ids": "array<int>", "n_tokens": "long", "ids_sha256": "string", "decoded": "string", "decoded_sha256": "string"}


class PieceBpe:
    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.byte_ids: list[int] = [0] * 256
        special = {}
        normal = []
        for i, name in enumerate(names):
            if sp.is_byte(i):
                special[i] = bytes([int(name[3:5], 16)])
                self.byte_ids[int(name[3:5], 16)] = i
            elif sp.is_control(i):
                special[i] = b""
            elif sp.is_unknown(i):
                special[i] = " ⁇ ".encode()
            else:
                normal.append(i)
        self.id_of = {names[i]: i for i in normal}
        #: rank: position by score, the best first; equal pieces can't be.
        order = sorted(normal, key=lambda i: (-sp.get_score(i), i))
        self.rank = [n] * n
        for r, i in enumerate(order):
            self.rank[i] = r
        self.names = names
        self.alphabet = {c for i in normal for c in names[i]}
        self.inside = {names[i][k : k + 2] for i in normal for k in range(len(names[i]) - 1)}
        self.unknown = re.compile("[^" + re.escape("".join(sorted(self.alphabet))) + "]")
        self.left, self.right = list(range(n)), list(range(n))
        self.atom = [True] * n
        automaton = ahocorasick.Automaton()
        for i in order:
            made = self._split(i)
            if made:  # else no merges lead to it, and it never stands in an encoding
                automaton.add_word(names[i], (i, len(names[i])))
        automaton.make_automaton()
        self.automaton = automaton
        self.pairs: dict[int, bool] = {}
        self.kept: dict[str, bytes] = {}
        self.bytes_of = [special[i] if i in special else names[i].replace(MARK, " ").encode() for i in range(n)]
        self.is_byte = [sp.is_byte(i) for i in range(n)]
        self.skipped = {i for i in range(n) if sp.is_control(i)}

    def merge(self, symbols: list[str]) -> tuple[list[str], tuple[str, str] | None]:
        """Plain merging, the best rank first and the leftmost of equals; and the last merge."""
        symbols, last = list(symbols), None
        while True:
            best = min(((self.rank[self.id_of[p]], k) for k in range(len(symbols) - 1) if (p := symbols[k] + symbols[k + 1]) in self.id_of), default=None)
            if best is None:
                return symbols, last
            k = best[1]
            last = (symbols[k], symbols[k + 1])
            symbols[k : k + 2] = ["".join(last)]

    def _split(self, i: int) -> bool:
        name = self.names[i]
        if len(name) == 1:
            return True
        symbols, last = self.merge(list(name))
        if len(symbols) != 1:
            return False
        self.left[i], self.right[i], self.atom[i] = self.id_of[last[0]], self.id_of[last[1]], False
        return True

    def compatible(self, a: int, b: int) -> bool:
        """Whether the joint text of a and b encodes to just a and b."""
        key = a << 20 | b
        found = self.pairs.get(key)
        if found is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            found = self.pairs[key] = self._border_holds(a, b)
        return found

    def _border_holds(self, a: int, b: int) -> bool:
        """Goes back in time: whichever side's merge came last is undone next. A joint piece of the
        two sides must not have come before the merge that replaced one of them. Of two merges
        with the same rank the left one came first."""
        rank, names, get = self.rank, self.names, self.id_of.get
        # A merge is timed by (rank, side): on the left side 0, across the border 1, on the right 2.
        until = (len(rank) + 1, 0)
        while True:
            joint = get(names[a] + names[b])
            if joint is not None and (rank[joint], 1) < until:
                return False
            if self.atom[a] and self.atom[b]:
                return True
            ta = (-1, 0) if self.atom[a] else (rank[a], 0)
            tb = (-1, 2) if self.atom[b] else (rank[b], 2)
            if ta > tb:
                until, a = ta, self.right[a]
            else:
                until, b = tb, self.left[b]

    def _prefixes(self, segment: str) -> list[int]:
        """Ids of a segment whose characters all belong to the alphabet."""
        whole = self.single_piece(segment)
        if whole is not None:
            return [whole]
        last = [0] * (len(segment) + 1)
        size = [0] * (len(segment) + 1)
        pairs, compatible = self.pairs, self.compatible
        for end, (i, length) in self.automaton.iter(segment):
            end += 1
            if size[end]:
                continue
            start = end - length
            if start:
                before = last[start]
                ok = pairs.get(before << 20 | i)
                if ok is None:
                    ok = compatible(before, i)
                if not ok:
                    continue
            last[end], size[end] = i, length
        ids, at = [], len(segment)
        while at:
            ids.append(last[at])
            at -= size[at]
        ids.reverse()
        return ids

    def single_piece(self, segment: str) -> int | None:
        i = self.id_of.get(segment)
        return i if i is not None and (self.atom[i] is False or len(segment) == 1) else None

    def _known(self, segment: str) -> bytes:
        """Ids of a segment of the alphabet, which is cut where two characters never meet in a piece."""
        inside, at = self.inside, 0
        cuts = [k for k in range(1, len(segment)) if segment[k - 1 : k + 1] not in inside]
        if not cuts:
            return self._whole(segment)
        out = []
        for k in [*cuts, len(segment)]:
            out.append(self._whole(segment[at:k]))
            at = k
        return b"".join(out)

    def _whole(self, segment: str) -> bytes:
        got = self.kept.get(segment)
        if got is None:
            ids = self._prefixes(segment)
            got = self._keep(segment, pack(f"<{len(ids)}I", *ids))
        return got

    def _segment(self, segment: str) -> bytes:
        return self._keep(segment, self._cut(segment))

    def _keep(self, segment: str, ids: bytes) -> bytes:
        if len(segment) <= KEPT_CHARS:
            if len(self.kept) >= KEPT_SEGMENTS:
                self.kept.clear()
            self.kept[segment] = ids
        return ids

    def _cut(self, segment: str) -> bytes:
        """A segment with characters outside the alphabet cut out as byte pieces."""
        if self.alphabet.issuperset(segment):
            return self._known(segment)
        out, at = [], 0
        for m in self.unknown.finditer(segment):
            if m.start() > at:
                out.append(self._known(segment[at : m.start()]))
            out.append(np.array([self.byte_ids[b] for b in m[0].encode()], "<u4").tobytes())
            at = m.end()
        if at < len(segment):
            out.append(self._known(segment[at:]))
        return b"".join(out)

    def encode_bytes(self, text: str) -> bytes:
        """Ids as little-endian uint32, without begin and end."""
        if not text:
            return b""
        marked = MARK + text.replace(" ", MARK)
        get, out = self.kept.get, []
        if MARK * 2 in marked or marked[-1] == MARK:
            segments = _RUNS.findall(marked)
        else:
            segments = [MARK + w for w in marked[1:].split(MARK)]
        for s in segments:
            got = get(s)
            out.append(self._segment(s) if got is None else got)
        return b"".join(out)

    def decode(self, ids: list[int]) -> str:
        """As the library's decode: control pieces give nothing, one blank at the start goes, byte
        pieces that form no character each give the replacement character."""
        kept = [i for i in ids if i not in self.skipped]
        raw = b"".join(map(self.bytes_of.__getitem__, kept))
        if kept and raw[:1] == b" " and not self.is_byte[kept[0]] and self.names[kept[0]][:1] == MARK:
            raw = raw[1:]
        try:
            return raw.decode()
        except UnicodeDecodeError:
            return self._decode_loose(kept)

    def _decode_loose(self, kept: list[int]) -> str:
        out, run = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for size in (1, 2, 3, 4):
                    try:
                        out.append(run[at : at + size].decode())
                        at += size
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run.clear()

        for k, i in enumerate(kept):
            if self.is_byte[i]:
                run.extend(self.bytes_of[i])
                continue
            flush()
            piece = self.bytes_of[i].decode()
            out.append(piece[1:] if k == 0 and self.names[i][:1] == MARK else piece)
        flush()
        return "".join(out)


_RUNS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@lru_cache(2)
def piece_bpe(path: str | None = None) -> PieceBpe:
    """One per Python worker and model."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(MODEL)
    return PieceBpe(path)


def _encoder(outputs: tuple[str, ...], path: str | None):
    def make():
        bpe = piece_bpe(path)
        begin, end = (np.array([x], "<u4").tobytes() for x in (bpe.bos, bpe.eos))
        decoding = any(x.startswith("decoded") for x in outputs)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            found: dict[str, list] = {x: [] for x in outputs}
            for text in batch.column("text").to_pylist():
                packed = begin + bpe.encode_bytes(text) + end
                ids = np.frombuffer(packed, "<u4")
                decoded = bpe.decode(ids.tolist()) if decoding else ""
                for x, to in found.items():
                    if x == "ids":
                        to.append(ids.astype("int32"))
                    elif x == "n_tokens":
                        to.append(len(ids))
                    elif x == "ids_sha256":
                        to.append(hashlib.sha256(packed).hexdigest())
                    elif x == "decoded":
                        to.append(decoded)
                    else:
                        to.append(hashlib.sha256(decoded.encode()).hexdigest())
            kinds = {"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}
            return pa.record_batch([batch.column("doc_id"), *(pa.array(v, kinds.get(k, pa.string())) for k, v in found.items())], names=["doc_id", *outputs])

        return work

    return make


def encode(docs: DataFrame, outputs: tuple[str, ...] = ("ids", "decoded"), model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the chosen OUTPUTS for each row, in one pass without a shuffle."""
    schema = "doc_id long" + "".join(f", {x} {OUTPUTS[x]}" for x in outputs)
    return arrow_pass(texts(docs, id_col, text_col), _encoder(tuple(outputs), model_path), schema)


def decode(encoded: DataFrame, model_path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id, decoded for each row of ids; null ids decode to the empty string."""

    def make():
        bpe = piece_bpe(model_path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            return pa.record_batch([batch.column(0), pa.array([bpe.decode([i for i in x or [] if i is not None]) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "decoded"])

        return work

    return arrow_pass(encoded.selectExpr(f"cast(`{id_col}` as long) doc_id", f"cast(`{ids_col}` as array<int>) ids"), make, "doc_id long, decoded string")
