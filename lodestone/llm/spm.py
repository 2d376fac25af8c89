"""SentencePiece encoding and decoding by shared-prefix Viterbi.

A block's distinct marked words are sorted, which lays out their trie depth first: a word keeps
the forward states of the prefix it shares with the word before and computes only the rest. The
state of a prefix holds the best way to end it with a piece.

For a unigram model that is the piece of highest total score. For a BPE model (such as the
public 32k file) it is exact too: the encoding of a prefix of a BPE-encoded string is a prefix of
its encoding, and a split is BPE's own if every two neighbouring pieces are what BPE makes of
their concatenation. So each prefix has one last piece, found from the states before it; plain
maximisation of a BPE model's scores would not give the library's ids.

Words end before a mark, as no piece of such a model holds a mark after another letter (checked
on loading; otherwise a text is one word). Letters without a piece become byte pieces, or the
unknown id if the model has none.

Defined cases: null and empty texts have no ids and decode to an empty text; ids and decoding
equal the library's, so a text that holds the mark itself decodes with a space there;
``round_trip`` says whether decoding gives the normalised text; very long texts and words are read
whole, in time that grows as n log n; ties between pieces of one score go to the leftmost, as in the
library; repeated rows and null ids give one row each; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

import heapq
import math
import re
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Recent, map_arrow

MARK = "▁"
CACHE_WORDS, CACHE_PAIRS = 400_000, 300_000
#: Longer words are merged with a heap.
SHORT = 24
UNKNOWN_PENALTY = 10.0


class Model:
    def __init__(self, path: str):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)
        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        kinds = pb.ModelProto.SentencePiece
        self.bpe = proto.trainer_spec.model_type == pb.TrainerSpec.BPE
        self.prefix = proto.normalizer_spec.add_dummy_prefix
        self.pieces = {p.piece: (i, p.score) for i, p in enumerate(proto.pieces) if p.type in (kinds.NORMAL, kinds.USER_DEFINED)}
        bytes_ = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kinds.BYTE}
        self.byte = [bytes_[f"<0x{b:02X}>"] for b in range(256)] if len(bytes_) == 256 else None
        self.unknown = next(i for i, p in enumerate(proto.pieces) if p.type == kinds.UNKNOWN)
        self.plain = [p.piece.replace(MARK, " ").encode() if p.type in (kinds.NORMAL, kinds.USER_DEFINED) else b" \xe2\x81\x87 " if p.type == kinds.UNKNOWN else b"" for p in proto.pieces]
        for b, i in enumerate(self.byte or []):
            self.plain[i] = bytes([b])
        self.bytes = set(self.byte or [])
        self.longest = max(map(len, self.pieces))
        self.floor = min(s for _, s in self.pieces.values()) - UNKNOWN_PENALTY
        inner = any(re.search(f"[^{MARK}]{MARK}", p) for p in self.pieces)
        self.split = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if not inner else r"(?s).+")
        self.endings = self._reversed_trie()
        self.data = {p: int(i).to_bytes(4, "little") for p, (i, _) in self.pieces.items()}
        self.forget()

    def _reversed_trie(self) -> dict[str, tuple[dict, str | None]]:
        """Last letter -> what may stand before it, and the piece that starts there, and so on backwards."""
        grown: dict = {}
        for piece in self.pieces:
            node = grown
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = piece
        fixed = lambda node: {c: (fixed(below), below.get("")) for c, below in node.items() if c}
        return fixed(grown)

    def forget(self) -> None:
        """Empty the caches, which hold what one task met."""
        self.known, self.pairs = Recent(CACHE_WORDS, None), {}

    def merge(self, word: str) -> list[str]:
        """Plain BPE: merge the neighbours of highest score, leftmost first, until none is a piece."""
        if len(word) > SHORT:
            return self._merge_long(word)
        pieces, out = self.pieces, list(word)
        cost = lambda a, b: -pieces[a + b][1] if a + b in pieces else math.inf
        costs = [cost(a, b) for a, b in zip(out, out[1:], strict=False)]
        while costs and (best := min(costs)) < math.inf:
            i = costs.index(best)
            out[i : i + 2] = [out[i] + out[i + 1]]
            del costs[i]
            if i:
                costs[i - 1] = cost(out[i - 1], out[i])
            if i < len(costs):
                costs[i] = cost(out[i], out[i + 1])
        return out

    def _merge_long(self, word: str) -> list[str]:
        """The same by a heap of neighbours; an entry whose pieces have changed since is passed over."""
        pieces, n = self.pieces, len(word)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, int, int]] = []

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (found := pieces.get(word[i : end[j]])):
                heapq.heappush(heap, (-found[1], i, j, end[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if end[i] != j or end[j] != k:
                continue
            end[i], end[j] = k, -1
            if k < n:
                before[k] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(word[i : end[i]])
            i = end[i]
        return out

    def fits(self, left: str, right: str) -> bool:
        """Whether BPE makes exactly these pieces of their concatenation."""
        if len(self.pairs) >= CACHE_PAIRS:
            self.pairs.clear()
        self.pairs[left, right] = got = self.merge(left + right) == ([left, right] if left else [right])
        return got

    def _extend_bpe(self, word: str, states: list) -> None:
        """States (start, piece, score) of each prefix not yet computed; piece '' is an unknown letter.

        Just one piece that ends a prefix fits, so they are tried as a trie of reversed pieces yields them.
        """
        root, pairs, fits = self.endings, self.pairs, self.fits
        for j in range(len(states), len(word) + 1):
            before, i, found = root, j, None
            while i:
                i -= 1
                below = before.get(word[i])
                if below is None:
                    break
                before, t = below
                if t is not None:
                    pair = states[i][1], t
                    ok = pairs.get(pair)
                    if ok or (ok is None and fits(*pair)):
                        found = (i, t, 0.0)
                        break
            states.append(found or (j - 1, "", 0.0))

    def _extend_unigram(self, word: str, states: list) -> None:
        pieces, longest = self.pieces, self.longest
        for j in range(len(states), len(word) + 1):
            best = (j - 1, "", states[j - 1][2] + self.floor) if word[j - 1] not in pieces else None
            for i in range(max(0, j - longest), j):
                found = pieces.get(word[i:j])
                if found and (best is None or states[i][2] + found[1] > best[2]):
                    best = (i, word[i:j], states[i][2] + found[1])
            states.append(best)

    def _ids(self, pieces: list[tuple[str, str]]) -> bytes:
        out: list[bytes] = []
        unknown = int(self.unknown).to_bytes(4, "little")
        for piece, text in pieces:
            if piece:
                out.append(self.data[piece])
            elif self.byte:
                out += [self.byte[b].to_bytes(4, "little") for b in text.encode()]
            elif not out or out[-1] != unknown:
                out.append(unknown)
        return b"".join(out)

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """The words' ids; those that aren't cached are encoded in the order of their trie."""
        got = {w: self.known.find(w) for w in words}
        extend, data = self._extend_bpe if self.bpe else self._extend_unigram, self.data
        states, last = [(0, "", 0.0)], ""
        for word in sorted(w for w, ids in got.items() if ids is None):
            if self.bpe and word.startswith(MARK * 2):  # runs of marks may tie in score
                got[word] = self._ids([(p if p in self.pieces else "", p) for p in self.merge(word)])
            else:
                shared, most = 0, min(len(word), len(last), len(states) - 1)
                while shared < most and word[shared] == last[shared]:
                    shared += 1
                del states[shared + 1 :]
                extend(word, states)
                last, j, parts = word, len(word), []
                while j:
                    i, piece, _ = states[j]
                    parts.append(piece)
                    j = i
                if "" in parts:  # letters without a piece
                    j, pieces = 0, []
                    for piece in parts[::-1]:
                        pieces.append((piece, piece or word[j]))
                        j += len(piece) or 1
                    got[word] = self._ids(pieces)
                else:
                    got[word] = b"".join([data[p] for p in parts[::-1]])
            if len(word) <= Recent.LONGEST:
                self.known.put(word, got[word])
        return got

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[str]]:
        """Little-endian unsigned 32-bit ids of each text, and the normalised texts."""
        normal = [self.lib.normalize(t) if t else "" for t in texts]
        words = [self.split.findall(n) for n in normal]
        known = self.learn(set().union(*words))
        return [b"".join([known[w] for w in ws]) for ws in words], normal

    def decode(self, ids: bytes) -> str:
        """The text of the ids; runs of invalid bytes become replacement letters."""
        plain = self.plain
        text = b"".join([plain[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")
        return text[1:] if self.prefix and text.startswith(" ") else text

    def plain_text(self, normal: str) -> str:
        text = normal.replace(MARK, " ")
        return text[1:] if self.prefix and text.startswith(" ") else text


@cache
def model(path: str) -> Model:
    return Model(path)


def default_model() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def encode_documents(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary, round_trip) for every row; ids are little-endian unsigned 32-bit."""
    path = path or default_model()

    def rows(blocks):
        m = model(path)
        for block in blocks:
            ids, normal = m.encode(block["text"])
            yield {"doc_id": block["id"], "ids": ids, "round_trip": [m.decode(i) == m.plain_text(n) for i, n in zip(ids, normal, strict=True)]}
        m.forget()

    docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(docs, ["id", "text"], "doc_id long, ids binary, round_trip boolean", rows, 1024)


def decode_documents(encoded: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) for every row."""
    path = path or default_model()

    def rows(blocks):
        m = model(path)
        for block in blocks:
            yield {"doc_id": block["id"], "text": [m.decode(i or b"") for i in block["ids"]]}

    return map_arrow(encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")), ["id", "ids"], "doc_id long, text string", rows)


def digests(encoded: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, round_trip)."""
    return encoded.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"), "round_trip")
