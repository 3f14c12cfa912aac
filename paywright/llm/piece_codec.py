"""SentencePiece (merge type) encoding by a prefix table, and decoding.

A merge-type encoding has one last token for every prefix of a text. The table of these tokens is filled from left to
right: an automaton gives the pieces that end at a place, and the one is kept that is compatible with the last token of
the prefix before it. The ids are then read backwards from the table.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from paywright.llm.common import Memo, arrow_batches

SPACE = "▁"
MEMO_ENTRIES = 300_000
MEMO_CHARS = 64
LETTERS = frozenset(c for c in map(chr, range(0x250)) if c.isalpha() and (c.isascii() or c >= "À"))
MARKS = frozenset("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
PAIRS = 400_000


class PieceModel:
    """Pieces of a merge-type SentencePiece model with byte fallback, identity normaliser and dummy prefix."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.bytes_of: list[bytes] = []
        self.byte_id: dict[int, int] = {}
        self.unk = model.unk_id()
        plain: list[tuple[float, int, str]] = []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes_of.append(b" \xe2\x81\x87 " if model.is_unknown(i) else b"")
            else:
                plain.append((-model.get_score(i), i, piece))
                self.bytes_of.append(piece.replace(SPACE, " ").encode())
        id_of = {p: i for _, i, p in plain}
        crossing = [p for p in id_of if SPACE in p.lstrip(SPACE) or (p.startswith(SPACE * 2) and p.strip(SPACE))]
        if crossing or len(self.byte_id) != 256:
            raise ValueError("pieces across word starts, or no byte fallback: not a model of this kind")
        chars = sorted({c for p in id_of for c in p})
        #: Tokens of the table: single characters first, then merges in the order in which they are applied.
        merges = [p for _, _, p in sorted(plain) if len(p) > 1 and p.strip(SPACE)]
        self.text_of = chars + merges
        self.rank = {p: r for r, p in enumerate(self.text_of)}
        self.ids = [id_of.get(p, -1) for p in self.text_of]
        self.known = set(chars)
        self.alone = {c for c in "\n\t\r" if not any(c in p for p in merges)}
        self.runs = {len(p): (s, i) for s, i, p in plain if not p.strip(SPACE)}
        self.run_memo: dict[int, list[int]] = {0: []}
        self.halves: list[tuple[int, int]] = [(r, r) for r in range(len(chars))]
        usable = set(range(len(chars)))
        for r in range(len(chars), len(self.text_of)):
            parts = self._merge(self.text_of[r], r)
            self.halves.append((parts[0], parts[1]) if len(parts) == 2 else (r, r))
            if len(parts) == 2:
                usable.add(r)
        self.automaton = ahocorasick.Automaton()
        for r in usable:
            self.automaton.add_word(self.text_of[r], r)
        self.size = [len(p) for p in self.text_of]
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        inner = "".join(re.escape(c) for c in sorted(self.alone))
        ends = f"{SPACE}{inner}"
        words = ""
        if not any((a in LETTERS and b in MARKS) or (a in MARKS and b in LETTERS) for p in merges for a, b in zip(p, p[1:])):
            # No piece joins a Latin letter and ASCII punctuation, so words can be cut from the marks around them.
            letters, marks = "".join(LETTERS), "".join(map(re.escape, MARKS))
            words = f"[{letters}]+(?=[{ends}{marks}]|\\Z)|[{marks}]+(?=[{ends}{letters}]|\\Z)|"
        self.unit = re.compile(f"{SPACE}*(?:{words}[^{ends}]+)|{SPACE}+" + (f"|[{inner}]+" if inner else ""))
        self.memo = Memo(MEMO_ENTRIES)

    def _merge(self, text: str, below: int) -> list[int]:
        """Tokens of a short text when only merges ranked under ``below`` may be applied."""
        parts = list(text)
        while len(parts) > 1:
            best, at = min((self.rank.get(parts[k] + parts[k + 1], below), k) for k in range(len(parts) - 1))
            if best >= below:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [self.rank[p] for p in parts]

    def _fits(self, left: int, right: int) -> bool:
        """Whether two tokens can stand side by side: no merge across them comes before those that made them.

        The merges of both are undone from the latest on; a merge across the border that is ranked before the one just
        undone would have been applied instead. Of equal ranks the left one is applied first.
        """
        n = len(self.text_of)
        bar = n
        while True:
            across = self.rank.get(self.text_of[left] + self.text_of[right], n)
            if across < bar:
                return False
            a, b = self.halves[left], self.halves[right]
            can_left, can_right = a[1] != left, b[0] != right
            if not can_left and not can_right:
                return True
            if can_left and (not can_right or left > right):
                bar, left = left, a[1]
            else:
                bar, right = right + 1, b[0]

    def _table(self, text: str) -> list[int]:
        """Ids of a text of known characters without white space inside."""
        n = len(text)
        last = [-1] * n
        pairs, wide = self.pairs, len(self.text_of)
        if len(pairs) > PAIRS:
            pairs.clear()
        done = -1
        size = self.size
        for end, token in self.automaton.iter(text):
            if end == done:
                continue
            before = end - size[token]
            if before >= 0:
                key = last[before] * wide + token
                ok = pairs.get(key)
                if ok is None:
                    ok = pairs[key] = self._fits(last[before], token)
                if not ok:
                    continue
            last[end] = token
            done = end
        out: list[int] = []
        at = n - 1
        while at >= 0:
            token = last[at]
            i = self.ids[token]
            out += [i] if i >= 0 else [self.byte_id[b] for b in reversed(self.text_of[token].encode())]
            at -= size[token]
        out.reverse()
        return out

    def _run(self, k: int) -> list[int]:
        """Ids of ``k`` white space marks that no word takes; merges of the best score, of equals the leftmost."""
        if k not in self.run_memo:
            longest = max(self.runs)
            if k > 4 * longest:
                whole = (k - 2 * longest) // longest
                self.run_memo[k] = [self.runs[longest][1]] * whole + self._run(k - whole * longest)
            else:
                parts = [1] * k
                while True:
                    found = [(self.runs[s][0], j) for j in range(len(parts) - 1) if (s := parts[j] + parts[j + 1]) in self.runs]
                    if not found:
                        break
                    at = min(found)[1]
                    parts[at : at + 2] = [parts[at] + parts[at + 1]]
                self.run_memo[k] = [self.runs[p][1] for p in parts]
        return self.run_memo[k]

    def _core(self, text: str) -> list[int]:
        out: list[int] = []
        start = 0
        for at, c in enumerate(text):
            if c not in self.known:
                if at > start:
                    out += self._table(text[start:at])
                out += [self.byte_id[b] for b in c.encode()]
                start = at + 1
        if start < len(text):
            out += self._table(text[start:] if start else text)
        return out

    def encode_unit(self, unit: str) -> list[int]:
        core = unit.lstrip(SPACE)
        k = len(unit) - len(core)
        if not core:
            return self._run(k)
        if not k:
            return self._core(core)
        ids = self._core(SPACE + core)
        if k == 1:
            return ids
        return self._run(k) + ids[1:] if ids[0] == self.runs[1][1] else self._run(k - 1) + ids

    def units(self, text: str) -> list[str]:
        """Parts of a text that no piece crosses, with the dummy prefix in front."""
        return self.unit.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, text: str) -> list[int]:
        return [i for unit in self.units(text) for i in self.encode_unit(unit)]

    def decode(self, ids: list[int]) -> str:
        """Text of any ids: bytes that are no character become replacement characters, the dummy prefix goes."""
        raw = b"".join(self.bytes_of[i] for i in ids)
        text = raw.decode("utf-8", "replace")
        return text[1:] if ids and text.startswith(" ") and self.bytes_of[ids[0]].startswith(b" ") else text

    def coded(self, text: str) -> tuple[int, str, str]:
        """Number of ids, the ids as decimals joined by commas, and the decoded text; units are remembered."""
        units = self.units(text)
        long = {}
        new = self.memo.missing(set(units))
        memo = self.memo.new
        for unit in new:
            ids = self.encode_unit(unit)
            back = b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace").replace(" ", SPACE)
            (memo if len(unit) <= MEMO_CHARS else long)[unit] = (len(ids), ",".join(map(str, ids)), unit if back == unit else back)
        found = [memo[u] if u in memo else long[u] for u in units] if long else list(map(memo.__getitem__, units))
        return sum(f[0] for f in found), ",".join([f[1] for f in found]), "".join([f[2] for f in found])[1:].replace(SPACE, " ")


_MODELS: dict[str, PieceModel] = {}


def model_at(path: str) -> PieceModel:
    return _MODELS.get(path) or _MODELS.setdefault(path, PieceModel(path))


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) of every row; a null text has no ids and decodes to the empty text."""
    arrow_batches(docs.sparkSession, rows=256, max_bytes=4 << 20)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(path)
        for batch in batches:
            ids = [model.encode(t or "") for t in batch.column(1).to_pylist()]
            decoded = [model.decode(x) for x in ids]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())], ["doc_id", "ids", "decoded"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", docs["text"].cast("string")).mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def code_digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of ``docs``.

    Null and empty texts have 0 ids and the digests of the empty string. Repeated rows and null ids stay; other columns
    are not read. A text is cut where no piece can cross (before white space, around line ends); parts that recur are
    encoded once per worker while a bounded memory lasts, so long texts cost no more per byte than short ones.
    """
    arrow_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(path)
        for batch in batches:
            n, ids, decoded = [], [], []
            for text in batch.column(1).to_pylist():
                count, joined, back = model.coded(text or "")
                n.append(count)
                ids.append(hashlib.sha256(joined.encode()).hexdigest())
                decoded.append(hashlib.sha256(back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(decoded)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", docs["text"].cast("string")).mapInArrow(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
